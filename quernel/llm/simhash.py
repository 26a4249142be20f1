"""SimHash near-duplicates by multi-index hashing.

A fingerprint is 64 bits wide: bit i is 1 if it is set in over half the XXH64 hashes (seed 42) of
the text's word shingles. Fingerprints are cut into segments and stored once per segment under the
segment's bits. A probe enumerates a small Hamming ball within each segment, fetches the table's
matches and verifies the complete distance.

Two probing schemes:

* ``exact_links``: two segments of 32 bits, balls of radius 1 and 0. If two fingerprints differ in
  at most 2 bits, the first segments differ in at most 1 or the second ones don't differ at all, so
  no link is missed.
* ``wide_links``: three segments and larger distances. Bits that flip between similar texts are
  those whose vote was close, so the ball holds up to ``flips`` of the ``weak`` closest votes of
  each segment. A large entry is held against two leaders only, in work that grows with the rows.

``near_duplicates`` has three passes, and each makes pairs of texts only that are not in one component
yet: a text of a large group has been linked to a leader or two by then, and needn't meet the others.
The first holds the rows of a MinHash band entry against the entry's first row, the second one is
``wide_links``, and the third has no cap. MinHash bands meet by the similarity of the
shingle sets alone, whatever the edit looks like, and each two texts of a band entry that are still
apart are compared. All passes leave out pairs that can't be similar. Texts of m and n
shingles and a similarity of s differ in at most (1 - s) / (1 + s) * (m + n) of them, and each
shingle that only one of two texts has flips one bit of their parity sketches: if more bits differ,
the pair is unlike for certain. Pairs whose MinHash sketches lie too far apart go as well; the rest
is verified on the whole texts by word-shingle Jaccard similarity.

Nulls and texts without words have fingerprint zero and link like any other. Rows that share a
fingerprint (or, for whole texts, a digest) are one node of the link graph, so a group of any number
of copies is one row there. Rows without an id are linked like others; a component's id is the
smallest one of its members, and null if none has any.
"""

from __future__ import annotations

import hashlib
import math
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernel.operators.components import connected_components
from quernel.workspace import drop_staged, release, stage

#: (lowest bit, width) of each segment.
EXACT_SEGMENTS = ((32, 32), (0, 32))
WIDE_SEGMENTS = ((0, 22), (22, 21), (43, 21))


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z only) runs of bytes other than ASCII white space."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingles_of(words: list[bytes], k: int) -> list[bytes]:
    """All ``k``-word shingles, repeats included; fewer words: the whole sequence; none: nothing."""
    if len(words) < k:
        return [b" ".join(words)] if words else []
    return [b" ".join(s) for s in zip(*(words[i:] for i in range(k)), strict=False)]


def votes_of(text: str | None, k: int) -> tuple[np.ndarray, int]:
    """For each bit, how many shingle hashes have it set; and the number of hashes."""
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(s, 42) for s in shingles_of(words_of(text), k)], dtype="<u8")
    votes = np.zeros(64, dtype=np.int64)
    for at in range(0, len(h), 1 << 16):  # a very long text must not hold 64 bytes a word at once
        votes += np.unpackbits(h[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return votes, len(h)


def fingerprint_of(text: str | None, k: int = 3) -> int:
    votes, n = votes_of(text, k)
    return int.from_bytes(np.packbits(votes * 2 > n, bitorder="little").tobytes(), "little")


SKETCH = ("s0", "s1", "s2", "s3")  #: columns of 64 bits
PARITY = tuple(f"o{i}" for i in range(8))  #: columns of 64 bits: whether a text has an odd number of the shingles of each bit
FOLDED = tuple(f"p{i}" for i in range(4))  #: the same of half as many parts, as a probe carries it
#: Drawn at random: the least values under multiples of one constant would depend on each other.
_TURNS = np.random.default_rng(42).integers(0, 1 << 63, 64 * len(SKETCH), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Bands and least hashes in each: texts of similarity 0.8 share no band with probability
#: (1 - 0.8 ** 6) ** 40 = 5e-6, those of similarity 0.3 share one with probability 0.03.
BANDS, BAND_ROWS = 40, 6


def set_hashes(text: str | None, k: int) -> np.ndarray:
    """A hash of each different shingle."""
    return np.array([xxhash.xxh64_intdigest(x, 7) for x in set(shingles_of(words_of(text), k))], dtype=np.uint64)


def parity_of(h: np.ndarray) -> bytes:
    """One bit for each of 512 parts of the hashes: the number of hashes in it, modulo 2."""
    return np.packbits(np.bincount((h >> np.uint64(55)).astype(np.int64), minlength=512) & 1, bitorder="little").tobytes()


def least_of(h: np.ndarray) -> np.ndarray:
    """The least of the shingle hashes in each of some orders (MinHash)."""
    low = np.full(len(_TURNS), np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(h), 2048):
        low = np.minimum(low, ((h[at : at + 2048, None] ^ (h[at : at + 2048, None] >> np.uint64(29))) * _TURNS).min(axis=0))
    return low


def sketch_bits(low: np.ndarray) -> bytes:
    return np.packbits(np.bitwise_count(low) & 1, bitorder="little").tobytes()


def sketch_of(text: str | None, k: int) -> bytes:
    """Some bits, each from the least of the shingle hashes in an order of its own (one-bit MinHash).

    Two texts of similarity s agree in a bit with probability (1 + s) / 2.
    """
    return sketch_bits(least_of(set_hashes(text, k)))


def bands_of(low: np.ndarray) -> np.ndarray:
    """One hash a band; two texts of similarity s agree in it with probability s ** BAND_ROWS."""
    key = np.arange(BANDS, dtype=np.uint64)
    for column in low[: BANDS * BAND_ROWS].reshape(BANDS, BAND_ROWS).T:
        key = (key ^ column) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return key.view(np.int64)


def sketch_limit(similarity: float) -> int:
    """Bits of two sketches that may differ: the mean at this similarity and 6 standard deviations."""
    p, n = (1 - similarity) / 2, len(_TURNS)
    return math.ceil(n * p + 6 * math.sqrt(n * p * (1 - p)))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, weak: int = 0, sketch: int = 5) -> DataFrame:
    """``(doc_id, fp long)``; with ``weak`` also ``close``, the places of the closest votes of each wide
    segment, ``s0`` to ``s3``, a sketch of the set of ``sketch``-word shingles, ``same``, a digest
    that equal texts share, ``bands``, the hashes of the set's MinHash bands, ``n``, its size, and
    ``o0`` to ``o7``, its parity sketch."""

    def run(batches):
        for batch in batches:
            fps, close, same, sketches, bands, sizes, parities = [], [], [], [], [], [], []
            for text in batch.column(1).to_pylist():
                votes, n = votes_of(text, shingle)
                fps.append(np.packbits(votes * 2 > n, bitorder="little").tobytes())
                if weak:
                    margin = np.abs(votes * 2 - n)
                    close.append(bytes(lo + int(i) for lo, width in WIDE_SEGMENTS for i in np.argsort(margin[lo : lo + width], kind="stable")[:weak]))
                    h = set_hashes(text, sketch)
                    low = least_of(h)
                    sizes.append(len(h))
                    parities.append(parity_of(h))
                    sketches.append(sketch_bits(low))
                    bands.append(bands_of(low))
                    same.append(hashlib.md5((text or "").encode()).digest())
            out = [batch.column(0), pa.array(np.frombuffer(b"".join(fps), dtype="<i8"))]
            if weak:
                halves = np.frombuffer(b"".join(sketches), dtype="<i8").reshape(-1, len(SKETCH))
                out += [pa.array(close, pa.binary()), *(pa.array(np.ascontiguousarray(halves[:, i])) for i in range(len(SKETCH))), pa.array(same, pa.binary())]
                out.append(pa.ListArray.from_arrays(pa.array(np.arange(len(fps) + 1, dtype=np.int32) * BANDS), pa.array(np.concatenate([*bands, np.zeros(0, dtype=np.int64)]))))
                odd = np.frombuffer(b"".join(parities), dtype="<i8").reshape(-1, len(PARITY))
                out += [pa.array(sizes, pa.int32()), *(pa.array(np.ascontiguousarray(odd[:, i])) for i in range(len(PARITY)))]
            yield pa.RecordBatch.from_arrays(out, ["doc_id", "fp", "close", *SKETCH, "same", "bands", "n", *PARITY][: len(out)])

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(run, "doc_id long, fp long" + f", close binary, {' long, '.join(SKETCH)} long, same binary, bands array<long>, n int, {' long, '.join(PARITY)} long" * bool(weak))


def _key(seg: int, low: int, width: int, fp):
    """Segment number above, segment bits below."""
    return F.shiftrightunsigned(fp, low).bitwiseAND(F.lit((1 << width) - 1)).bitwiseOR(F.lit(seg << 40))


def exact_links(fps: DataFrame, radius: int = 2) -> DataFrame:
    """Pairs ``(src, dst)`` of ids whose fingerprints differ in at most ``radius`` (0 to 2) bits.

    ``fps(id long, fp long)`` with distinct fingerprints. Emits 34 probes and 2 table rows for each.
    """
    if not 0 <= radius <= 2:
        raise ValueError("two segments with balls of radius 1 and 0 cover distances up to 2")
    (lo0, w0), (lo1, w1) = EXACT_SEGMENTS
    masks = F.array(*[F.lit(m).cast("long") for m in (0, *(1 << b for b in range(w0)))])
    table = fps.select(F.col("id").alias("t_id"), F.col("fp").alias("t_fp"), F.explode(F.array(_key(0, lo0, w0, F.col("fp")), _key(1, lo1, w1, F.col("fp")))).alias("key"))
    probes = fps.select("id", "fp", F.explode(F.concat(F.transform(masks, lambda m: _key(0, lo0, w0, F.col("fp")).bitwiseXOR(m)), F.array(_key(1, lo1, w1, F.col("fp"))))).alias("key"))
    near = (F.bit_count(F.col("fp").bitwiseXOR(F.col("t_fp"))) <= radius) & (F.col("id") < F.col("t_id"))
    return probes.join(table, (probes.key == table.key) & near).select(F.col("id").alias("src"), F.col("t_id").alias("dst"))


def fingerprint_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 2) -> DataFrame:
    """One row per document: ``(doc_id, fp long, component_id)``; component = smallest id reachable."""
    prints = stage(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("id"))
    comps = connected_components(exact_links(nodes.select(F.col("fp").alias("id"), "fp"), radius))
    # Written out, so that the join below is one of two plain tables, whose hot keys Spark can split.
    classes = stage(_classes(nodes, comps, "fp").select("fp", "component_id"), "classes")
    return prints.join(classes, "fp").select("doc_id", "fp", "component_id")


def _classes(nodes: DataFrame, comps: DataFrame, node: str) -> DataFrame:
    """``nodes`` with ``root``, their component, and ``component_id``, the smallest ``id`` in it."""
    placed = nodes.join(comps.select(F.col("node").alias(node), "component"), node, "left").withColumn("root", F.coalesce("component", node)).drop("component")
    return placed.join(placed.groupBy("root").agg(F.min("id").alias("component_id")), "root")


def hex_of(fp):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def _differ(c: str) -> Column:
    return F.bit_count(F.col(c).bitwiseXOR(F.col(f"t_{c}")))


def _sketches_near(apart: int) -> Column:
    return reduce(Column.__add__, map(_differ, SKETCH)) <= apart


def wide_rows(reps: DataFrame, comps: DataFrame) -> DataFrame:
    """``(id, fp, close, component, n, s0, .., p0, ..)``: what ``wide_links`` needs of ``reps`` and ``comps(node, component)``."""
    folded = [F.col(PARITY[i]).bitwiseXOR(F.col(PARITY[i + len(FOLDED)])).alias(c) for i, c in enumerate(FOLDED)]
    placed = reps.join(comps.withColumnRenamed("node", "id"), "id", "left")
    return placed.select("id", "fp", "close", F.coalesce("component", "id").alias("component"), "n", *SKETCH, *folded)


def wide_links(prints: DataFrame, segment: int, weak: int, flips: int, radius: int, apart: int, similarity: float) -> DataFrame:
    """Candidate pairs ``(src, dst)`` by one segment, within ``radius`` bits, of different components, at most two for each probe.

    ``prints`` as of ``wide_rows``; sketches may differ in ``apart`` bits, and pairs that sizes or parity
    sketches prove unlike are left out. The rows of a table entry are led by two of them, and each
    probe is held against these only: the first one in an order of all ids, so that a large group
    gathers around the same few leaders, and the first one in an order of the entry's own, which
    differs from entry to entry. So the work stays in proportion to the rows however many texts are
    alike. A pair of which neither leads a common entry is missed.
    """
    masks = [c for f in range(flips + 1) for c in combinations(range(weak), f)]
    low, width = WIDE_SEGMENTS[segment]
    told = ("fp", "component", "n", *SKETCH, *FOLDED)

    def probe(batches):
        for batch in batches:
            fp = batch.column(1).to_numpy().astype("<i8").view(np.uint64)
            close = np.frombuffer(b"".join(batch.column(batch.num_columns - 1).to_pylist()), dtype=np.uint8).reshape(len(fp), len(WIDE_SEGMENTS), weak)
            bit = np.uint64(1) << close[:, segment].astype(np.uint64)
            keys = []
            for m in masks:
                flipped = fp ^ bit[:, list(m)].sum(1, dtype=np.uint64)
                keys.append(((flipped >> np.uint64(low)) & np.uint64((1 << width) - 1)) | np.uint64(segment << 40))
            columns = [pa.array(np.tile(batch.column(c).to_numpy(), len(keys))) for c in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(np.concatenate(keys).view(np.int64))], ["id", *told, "key"])

    table = prints.select(*[F.col(c).alias(f"t_{c}") for c in ("id", *told)], _key(segment, low, width, F.col("fp")).alias("key"))
    rows = tuple(f"t_{c}" for c in ("id", *told))
    first = lambda *by: F.min(F.struct(F.xxhash64(*by).alias("rank"), *rows))
    led = table.groupBy("key").agg(first("t_id").alias("l0"), first("key", "t_id").alias("l1"))
    led = led.select("key", F.explode(F.array_distinct(F.array(*[F.struct(*[F.col(f"{x}.{c}").alias(c) for c in rows]) for x in ("l0", "l1")]))).alias("l")).select("key", "l.*")
    probes = prints.select("id", *told, "close").mapInArrow(probe, f"id long, fp long, component long, n int, {' long, '.join((*SKETCH, *FOLDED))} long, key long")
    near = (_differ("fp") <= radius) & _sketches_near(apart) & (F.col("component") != F.col("t_component")) & _may_be_similar(similarity, FOLDED)
    found = probes.join(led, (probes.key == led.key) & near)
    return found.select(F.least("id", "t_id").alias("src"), F.greatest("id", "t_id").alias("dst")).distinct()


def band_rows(prints: DataFrame) -> DataFrame:
    """``(key, id, s0, ..)``: the band entries with more than one row."""
    entries = prints.select("id", F.explode("bands").alias("key"))
    shared = entries.groupBy("key").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high").select("key")
    return entries.join(shared, "key").join(prints.select("id", *SKETCH), "id").select("key", "id", *SKETCH)


def band_leaders(rows: DataFrame, apart: int) -> DataFrame:
    """Pairs ``(src, dst)`` of each band row and the first one of its entry."""
    led = rows.groupBy("key").agg(F.min(F.struct(F.xxhash64("id").alias("rank"), *[F.col(c).alias(f"t_{c}") for c in ("id", *SKETCH)])).alias("l")).select(F.col("key").alias("t_key"), "l.*")
    found = rows.join(led, (F.col("key") == F.col("t_key")) & (F.col("id") != F.col("t_id")) & _sketches_near(apart))
    return found.select(F.least("id", "t_id").alias("src"), F.greatest("id", "t_id").alias("dst")).distinct()


def apart_rows(rows: DataFrame, comps: DataFrame) -> DataFrame:
    """The band rows of entries that hold several components ``comps(node, component)``, with their
    ``component`` and the entry's largest one, ``main``. Entries within one component, as those of
    large groups mostly are, have no pair left."""
    placed = rows.join(comps.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    sizes = placed.groupBy("key", "component").agg(F.count("*").alias("n"))
    mixed = sizes.groupBy("key").agg(F.max(F.struct("n", "component")).alias("m"), F.count("*").alias("parts")).where("parts > 1").select("key", F.col("m.component").alias("main"))
    return placed.join(mixed, "key")


def _may_be_similar(similarity: float, parity: tuple[str, ...] = PARITY) -> Column:
    """No pair of this similarity fails: parity sketches differ in no more bits than the sets in shingles."""
    apart = (F.col("n") + F.col("t_n")) * ((1 - similarity) / (1 + similarity))
    return (F.abs(F.col("n") - F.col("t_n")) <= apart + 1e-6) & (reduce(Column.__add__, map(_differ, parity)) <= apart + 1e-6)


def possible(pairs: DataFrame, reps: DataFrame, similarity: float) -> DataFrame:
    """The pairs that sizes and parity sketches of ``reps`` don't rule out."""
    one = reps.select(F.col("id").alias("src"), "n", *PARITY)
    other = reps.select(F.col("id").alias("t_id"), *[F.col(c).alias(f"t_{c}") for c in ("n", *PARITY)])
    return pairs.join(one, "src").join(other, (F.col("dst") == F.col("t_id")) & _may_be_similar(similarity)).select("src", "dst")


def band_rest(live: DataFrame, reps: DataFrame, apart: int, similarity: float) -> DataFrame:
    """All pairs ``(src, dst)`` of ``live`` that share a band entry, lie in different components and may be similar enough.

    Rows of an entry's largest component needn't probe: each pair that crosses components has an end
    outside it.
    """
    live = live.join(reps.select("id", "n", *PARITY), "id")
    table = live.select(*[F.col(c).alias(f"t_{c}") for c in ("key", "id", "component", "main", "n", *SKETCH, *PARITY)])
    once = (F.col("t_component") == F.col("t_main")) | (F.col("id") < F.col("t_id"))
    found = live.where("component <> main").join(table, (F.col("key") == F.col("t_key")) & (F.col("component") != F.col("t_component")) & once & _may_be_similar(similarity) & _sketches_near(apart))
    return found.select(F.least("id", "t_id").alias("src"), F.greatest("id", "t_id").alias("dst")).distinct()


def shingle_jaccard(a: str | None, b: str | None, k: int) -> float:
    """Similarity of the sets of ``k``-word shingles; two texts without words are alike."""
    x, y = set(shingles_of(words_of(a), k)), set(shingles_of(words_of(b), k))
    return len(x & y) / len(x | y) if x or y else 1.0


def verified(pairs: DataFrame, texts_of, k: int, similarity: float) -> DataFrame:
    """The pairs whose whole texts (``texts_of(ids)`` -> ``(id, text)``) are similar enough."""

    def run(batches):
        for batch in batches:
            good = [shingle_jaccard(a.as_py(), b.as_py(), k) >= similarity for a, b in zip(batch.column(2), batch.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["src", "dst"]).filter(pa.array(good, pa.bool_()))

    texts = texts_of(pairs.select(F.explode(F.array("src", "dst")).alias("id")).distinct())
    first = pairs.join(texts.select(F.col("id").alias("src"), F.col("text").alias("a")), "src")
    both = first.join(texts.select(F.col("id").alias("dst"), F.col("text").alias("b")), "dst")
    return both.select("src", "dst", "a", "b").mapInArrow(run, "src long, dst long")


def _digest(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text.cast("string"), F.lit(""))))


def text_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, shingle: int = 5, similarity: float = 0.8, fp_shingle: int = 3, weak: int = 6, flips: int = 3, radius: int = 15) -> tuple[DataFrame, DataFrame]:
    """The rows ``(doc_id, same)`` and their different texts ``(same, id, root, component_id)``.

    ``same`` is a text's digest, ``id`` its smallest id, ``root`` its component. Large groups are
    gathered around leaders, of MinHash bands and then of SimHash entries over ``fp_shingle`` words
    (short shingles move fewer bits for the same edit); then all pairs of a band entry that are still apart
    are compared. The decision comes from ``shingle`` words. Texts are told apart by digests alone,
    so ids may be null or repeat.
    """
    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    prints = stage(fingerprints(picked, shingle=fp_shingle, weak=weak, sketch=shingle), "prints")
    columns = ("fp", "close", *SKETCH, "bands", "n", *PARITY)
    first_row = prints.groupBy("same").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"), F.first(F.struct(*columns)).alias("r"))  # equal texts, equal columns
    reps = stage(first_row.select(F.monotonically_increasing_id().alias("id"), "same", "doc_id", "copies", *[F.col(f"r.{c}").alias(c) for c in columns]), "reps")
    narrow = stage(prints.select("doc_id", "same"), "rows")
    drop_staged(prints)

    def texts_of(ids: DataFrame) -> DataFrame:
        """Most texts have no copies, so that they needn't be grouped."""
        wanted = stage(reps.select("id", "same", "copies").join(ids, "id", "left_semi"), "wanted")
        with_same = picked.select("text", _digest(F.col("text")).alias("same"))
        alone = with_same.join(wanted.where("copies = 1"), "same").select("id", "text")
        return alone.unionByName(with_same.join(wanted.where("copies > 1"), "same").groupBy("id").agg(F.first("text").alias("text")))

    apart = sketch_limit(similarity)
    rows = stage(band_rows(reps), "bands")
    pairs = stage(possible(band_leaders(rows, apart), reps, similarity), "pairs")
    gathered = connected_components(verified(pairs, texts_of, shingle, similarity))
    release(docs.sparkSession)
    wide = stage(wide_rows(reps, gathered), "wide")
    found = []
    for segment in range(len(WIDE_SEGMENTS)):  # one after the other, so that the disk holds the probes of one only
        found.append(stage(wide_links(wide, segment, weak, flips, radius, apart, similarity), "found"))
        release(docs.sparkSession)
    more = stage(possible(reduce(DataFrame.union, found).distinct(), reps, similarity), "pairs")
    first = connected_components(gathered.select(F.col("node").alias("src"), F.col("component").alias("dst")).union(verified(more, texts_of, shingle, similarity)))
    live = stage(apart_rows(rows, first), "apart")
    drop_staged(rows)
    release(docs.sparkSession)
    rest = stage(band_rest(live, reps, apart, similarity), "pairs")
    links = verified(rest, texts_of, shingle, similarity)
    comps = connected_components(first.select(F.col("node").alias("src"), F.col("component").alias("dst")).union(links))
    classes = stage(_classes(reps.select(F.col("id").alias("node"), "same", F.col("doc_id").alias("id")), comps, "node").select("same", "id", "root", "component_id"), "classes")
    for done in (reps, pairs, wide, *found, more, live, rest):
        drop_staged(done)
    release(docs.sparkSession)
    return narrow, classes


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per document: ``(doc_id, component_id)`` of texts with shingle similarity >= 0.8; see ``text_classes``."""
    rows, classes = text_classes(docs, id_col, text_col, **options)
    return rows.join(classes, "same").select("doc_id", "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that stay if each group of near duplicates keeps one; all columns.

    It is the row with the group's smallest id; of several texts under that id the one with the
    smallest digest, and of rows that repeat both, one (the least as JSON). Without any id in a group, the smallest
    digest stays.
    """
    rows, classes = text_classes(docs, id_col, text_col, **options)
    least = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "same")).alias("f")
    kept = classes.groupBy("root").agg(least).select(F.col("f.id").alias("id"), F.col("f.same").alias("same"))
    counts = rows.join(kept, rows.same.eqNullSafe(kept["same"]) & rows.doc_id.eqNullSafe(kept["id"])).groupBy("id", kept["same"]).agg(F.count("*").alias("n"))
    counts = stage(counts, "kept")
    names = {c.lower() for c in docs.columns}
    free = lambda name: name if name not in names else free(name + "_")
    key_id, key_same = free("kept_id"), free("kept_same")
    found = lambda keys: docs.join(keys.select(F.col("id").alias(key_id), F.col("same").alias(key_same)), docs[id_col].cast("long").eqNullSafe(F.col(key_id)) & (_digest(docs[text_col]) == F.col(key_same)), "left_semi")
    once, more = counts.where("n = 1"), counts.where("n > 1")
    if more.isEmpty():
        return found(once)
    packed = found(more).select(F.struct(*docs.columns).alias("r"), docs[id_col].cast("long").alias("i"), _digest(docs[text_col]).alias("s"))
    repeated = packed.groupBy("i", "s").agg(F.min_by("r", F.to_json("r")).alias("r")).select("r.*")
    return found(once).unionByName(repeated)
