"""Conflict-constrained best-fit packing of documents into bins of equal capacity.

A bin may hold at most one document of each source and at most one of each duplicate cluster. Items
are placed by falling size. Open bins are ordered by what is left in them; the search starts at the
smallest bin that is large enough and goes on to the next larger one until one without a conflict
is found, so the bin taken is the tightest compatible one. Bins carry two bitmaps, of their
sources and of their clusters; a conflict is a bit in common.

Documents larger than a bin are cut into full bins and a rest, which is packed like any other item;
nothing is dropped. The cluster of a document is that of its text without case and outer space:
near copies are no conflict. Best fit holds within groups: rows are dealt into packing groups of about ``group_rows`` rows by a hash of
their id, each of which is packed by one task: the bound on its memory and time. A source or
cluster that holds a third of all rows holds a third of each group, which costs bins, not memory.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PLACED = "group int, bin int, place int, start long, doc_id long, piece int, piece_start long, size long, source string, cluster string"


class Bins:
    """Open bins in order of what is left, with their bitmaps. Best fit among those that agree."""

    def __init__(self, capacity: int) -> None:
        self.capacity = capacity
        self.open: list[tuple[int, int]] = []  #: (left, bin)
        self.left: list[int] = []
        self.sources: list[int] = []
        self.clusters: list[int] = []

    def add(self, size: int, source: int, cluster: int) -> tuple[int, int]:
        """Bin and offset for an item with these bits (0: in conflict with nothing)."""
        at = bisect_left(self.open, (size, -1))
        while at < len(self.open):
            left, b = self.open[at]
            if not (self.sources[b] & source or self.clusters[b] & cluster):
                del self.open[at]
                break
            at += 1
        else:
            b, left = len(self.left), self.capacity
            self.left.append(left)
            self.sources.append(0)
            self.clusters.append(0)
        self.sources[b] |= source
        self.clusters[b] |= cluster
        self.left[b] = left - size
        if left > size:
            insort(self.open, (left - size, b))
        return b, self.capacity - left


def pack_items(items: list[tuple], capacity: int) -> list[tuple]:
    """Items ``(size, source or None, cluster or None, *key)`` -> ``(bin, start, *item)``.

    By falling size, ties by the rest of the item. Sizes lie in 0 .. capacity; an item of size 0
    needs a bin without a conflict like any other.
    """
    bins, bit = Bins(capacity), ({}, {})
    out = []
    for item in sorted(items, key=lambda x: (-x[0], *((v is not None, v) for v in x[1:]))):
        bits = [0 if name is None else 1 << seen.setdefault(name, len(seen)) for name, seen in zip(item[1:3], bit, strict=True)]
        out.append((*bins.add(item[0], *bits), *item))
    return out


def pieces_of(size: int, capacity: int) -> list[tuple[int, int, int]]:
    """(number, start, size) of the full bins and the rest; an empty document is one empty piece."""
    return [(i, s, min(capacity, size - s)) for i, s in enumerate(range(0, max(1, size), capacity))]


def best_fit(items: DataFrame, capacity: int, group_rows: int = 4000) -> DataFrame:
    """``items(doc_id, size, source, cluster)`` -> one row per piece, see ``PLACED``.

    ``bin`` counts from 0 in each group; ``place`` is the item's number within the bin, ``start``
    its offset, ``piece_start`` the offset of the piece within its document. A null source or
    cluster is in conflict with nothing; a null or negative size counts as 0.
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")
    groups = max(1, -(-items.count() // group_rows))

    def pack(table: pa.Table) -> pa.Table:
        rows = [
            (size, source, cluster, doc, number, start)
            for doc, whole, source, cluster in zip(*(table.column(c).to_pylist() for c in ("doc_id", "size", "source", "cluster")), strict=True)
            for number, start, size in pieces_of(whole, capacity)
        ]
        group, place, out = table.column("group")[0].as_py(), {}, []
        for b, start, size, source, cluster, doc, number, piece_start in pack_items(rows, capacity):
            place[b] = place.get(b, -1) + 1
            out.append((group, b, place[b], start, doc, number, piece_start, size, source, cluster))
        kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string()}
        fields = [f.split() for f in PLACED.split(", ")]
        return pa.table([pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*out, strict=True), fields, strict=True)], names=[n for n, _ in fields])

    dealt = items.select(
        # Rows without an id may be equal in everything; their place in the input deals them out.
        F.pmod(F.xxhash64(F.col("doc_id").cast("long"), "size", "source", "cluster", F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id())), F.lit(groups)).cast("int").alias("group"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.greatest(F.lit(0), F.coalesce(F.col("size").cast("long"), F.lit(0))).cast("long").alias("size"),
        F.col("source").cast("string").alias("source"),
        F.col("cluster").cast("string").alias("cluster"),
    )
    return dealt.groupBy("group").applyInArrow(pack, PLACED)


def word_count(text: Column) -> Column:
    """Runs of other than ASCII white space; null: none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def pack_documents(docs: DataFrame, capacity: int = 2048, group_rows: int = 4000) -> DataFrame:
    """Packs whole texts, measured in words; equal texts (without case and outer space) are a cluster."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    items = docs.select(F.col("doc_id"), word_count(text).alias("size"), F.col("source"), F.md5(F.lower(F.trim(text))).alias("cluster"))
    return best_fit(items, capacity, group_rows)
