"""Packing: against a plain search over all bins, and the constraints on whole tables."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from quernel.llm import packing


def plain(items, capacity):
    """Looks at every bin for every item; the tightest one without a conflict, first number on ties."""
    bins, out = [], []
    for item in sorted(items, key=lambda x: (-x[0], *((v is not None, v) for v in x[1:]))):
        size, source, cluster = item[:3]
        fits = [(b["left"], i) for i, b in enumerate(bins) if b["left"] > 0 and b["left"] >= size and (source is None or source not in b["s"]) and (cluster is None or cluster not in b["c"])]
        if fits:
            i = min(fits)[1]
        else:
            bins.append({"left": capacity, "s": set(), "c": set()})
            i = len(bins) - 1
        b = bins[i]
        out.append((i, capacity - b["left"], *item))
        b["left"] -= size
        b["s"].add(source)
        b["c"].add(cluster)
    return out


@pytest.mark.parametrize("seed", range(12))
def test_equals_plain_search(seed):
    rnd = random.Random(seed)
    capacity = rnd.choice([1, 10, 100])
    items = [(rnd.randint(0, capacity), rnd.choice([None, "hot", "hot", *"abcd"]), rnd.choice([None, "copy", *map(str, range(30))]), i) for i in range(150)]
    items += items[:3]
    assert packing.pack_items(items, capacity) == plain(items, capacity)


def test_pieces():
    assert packing.pieces_of(0, 5) == [(0, 0, 0)] and packing.pieces_of(5, 5) == [(0, 0, 5)]
    assert packing.pieces_of(12, 5) == [(0, 0, 5), (1, 5, 5), (2, 10, 2)]


def check(got, sizes, capacity):
    whole = defaultdict(int)
    for r in got:
        whole[r.doc_id] += r.size
    assert whole == sizes
    bins = defaultdict(list)
    for r in got:
        bins[r.group, r.bin].append(r)
    for rows in bins.values():
        rows.sort(key=lambda r: r.place)
        assert [r.place for r in rows] == list(range(len(rows)))
        assert sum(r.size for r in rows) <= capacity
        at = 0
        for r in rows:
            assert r.start == at
            at += r.size
        for col in ("source", "cluster"):
            names = [r[col] for r in rows if r[col] is not None]
            assert len(set(names)) == len(names)


def test_documents(spark):
    rnd = random.Random(8)
    rows = [(i, "w " * rnd.randint(0, 300), "hot" if i % 3 == 0 else f"s{rnd.randrange(9)}") for i in range(300)]
    rows += [(1000 + i, "the same copy again", f"s{i % 9}") for i in range(60)] + [(2000, None, None), (2001, "", "hot"), (2002, "long " * 5000, "hot")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("group", F.lit("clash")).withColumn("size", F.lit(1))
    got = packing.pack_documents(docs, capacity=256, group_rows=100).collect()
    check(got, {i: len((t or "").split()) for i, t, _ in rows}, 256)
    assert len({r.group for r in got}) > 1
    again = packing.pack_documents(docs.repartition(5), capacity=256, group_rows=100).collect()
    assert sorted(map(tuple, again), key=str) == sorted(map(tuple, got), key=str)
    assert packing.pack_documents(docs.limit(0)).count() == 0


def test_null_sizes_and_repeated_rows(spark):
    items = spark.createDataFrame([(1, None, "a", "x"), (1, None, "a", "x"), (None, -3, None, None), (2, 7, "a", "y")], "doc_id long, size long, source string, cluster string")
    got = packing.best_fit(items, 5).collect()
    assert sorted((r.doc_id or 0, r.size) for r in got) == [(0, 0), (1, 0), (1, 0), (2, 2), (2, 5)]
