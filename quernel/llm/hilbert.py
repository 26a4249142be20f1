"""Sharding by Hilbert-curve order, with DataFrame functions only.

Several metadata dimensions are quantised to ``bits`` bits each, the cell's place on the Hilbert
curve through that grid becomes the sort key, and the sorted rows are cut into runs of equal
counts. Rows of one shard then lie close together in every dimension, so a filter on any of them
prunes files by their min/max statistics.

Law ``rows``: shard sizes in rows differ by at most one. Ranks come from a range partitioning on
(curve index, text hash, id) plus one offset per partition, so no key, however hot, meets in one
task, and only one row per partition is summed up in one place.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernel.workspace import stage


def _bind(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def _long(value: int) -> Column:
    return F.lit(value).cast("long")


def hilbert_index(dims: list[Column], bits: int) -> Column:
    """Place of an integer point on the Hilbert curve, as a long.

    Every dimension must lie in [0, 2^bits). Coordinates travel as one array: per level from the
    top the lower bits are reflected or swapped, then the whole is Gray coded and interleaved.
    """
    n = len(dims)
    if not 0 < n * bits <= 62:
        raise ValueError("the index must fit a long")

    def turn(x: Column, i: int, bit: Column) -> Column:
        """Reflect the bits of x[0] below ``bit`` if x[i] has it; else swap them with those of x[i]."""
        low = bit - 1

        def body(a: Column) -> Column:
            hit = a[i].bitwiseAND(bit) != 0
            differ = a[0].bitwiseXOR(a[i]).bitwiseAND(low)
            first = F.when(hit, a[0].bitwiseXOR(low)).otherwise(a[0].bitwiseXOR(differ))
            ith = F.when(hit, a[i]).otherwise(a[i].bitwiseXOR(differ))
            return F.array(*[first if j == 0 else ith if j == i else a[j] for j in range(n)])

        return _bind(x, body)

    levels = F.array(*[_long(1 << b) for b in range(bits - 1, 0, -1)])
    x = F.array(*[d.cast("long") for d in dims])
    if bits > 1:
        x = F.aggregate(levels, x, lambda a, bit: reduce(lambda v, i: turn(v, i, bit), range(n), a))

    def gray(x: Column, i: int) -> Column:
        return _bind(x, lambda a: F.array(*[a[j].bitwiseXOR(a[j - 1]) if j == i else a[j] for j in range(n)]))

    x = reduce(gray, range(1, n), x)
    if bits > 1:
        x = _bind(x, lambda a: F.struct(a.alias("a"), F.aggregate(levels, _long(0), lambda t, bit: F.when(a[n - 1].bitwiseAND(bit) != 0, t.bitwiseXOR(bit - 1)).otherwise(t)).alias("t")))
        x = _bind(x, lambda s: F.transform(s["a"], lambda v: v.bitwiseXOR(s["t"])))
    place = lambda a, i, b: F.shiftleft(F.shiftright(a[i], b).bitwiseAND(_long(1)), b * n + n - 1 - i)
    return _bind(x, lambda a: reduce(Column.bitwiseOR, [place(a, i, b) for b in range(bits) for i in range(n)]))


def by_hash(col: Column, bits: int) -> Column:
    """Cell of a value without a useful order; null is cell 0."""
    return F.when(col.isNull(), _long(0)).otherwise(F.pmod(F.xxhash64(col), _long(1 << bits)))


def by_log(col: Column, bits: int) -> Column:
    """Cell of a magnitude: two cells for each doubling; null, negative: 0; the top cell is open."""
    size = F.greatest(F.coalesce(col.cast("double"), F.lit(0.0)), F.lit(0.0))
    return F.least(F.floor(F.log2(size + 1) * 2), _long((1 << bits) - 1)).cast("long")


def hilbert_shards(rows: DataFrame, dims: list[Column], id_col: str = "doc_id", text_col: str = "text", bits: int = 6, shards: int = 40) -> DataFrame:
    """``(doc_id, size, text_crc32, curve, shard, slot)``, one row per input row.

    ``dims`` are quantised columns of ``rows``. A null text counts as empty. Equal points are
    ordered by text hash, so that copies compress together, then by id (null first). Rows that
    are equal in all of it get slots in any order. An empty table gives an empty result.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    keyed = rows.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.xxhash64(text).alias("text_hash"),
        hilbert_index(dims, bits).alias("curve"),
    )
    order = ["curve", "text_hash", "doc_id"]
    ordered = stage(keyed, "curve").repartitionByRange(*order).sortWithinPartitions(*order)
    # The id holds the partition in its upper bits and the place within it in the lower 33.
    placed = stage(ordered.withColumn("at", F.monotonically_increasing_id()), "ordered")
    part = F.shiftright("at", 33)
    counts = placed.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    everything = Window.orderBy("part")
    offsets = counts.select("part", (F.sum("n").over(everything) - F.col("n")).alias("before"), F.sum("n").over(everything.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("total"))
    # One row per partition: as small as Spark's own task list, so it may be broadcast.
    ranked = placed.withColumn("part", part).join(F.broadcast(offsets), "part").withColumn("rank", F.col("before") + F.col("at").bitwiseAND(_long((1 << 33) - 1)))
    shard = F.expr(f"(rank * {shards}) div total")
    return ranked.withColumn("shard", shard).select(
        "doc_id", "size", "text_crc32", "curve", F.col("shard").cast("int").alias("shard"), F.expr(f"rank - (shard * total + {shards - 1}) div {shards}").alias("slot")
    )


def document_shards(docs: DataFrame, shards: int = 40, bits: int = 6) -> DataFrame:
    """Shards of ``documents`` over source, language and length."""
    return hilbert_shards(docs, [by_hash(F.col("source"), bits), by_log(F.col("n_chars"), bits), by_hash(F.col("lang"), bits)], bits=bits, shards=shards)
