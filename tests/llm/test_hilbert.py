"""Hilbert order: the curve's defining property, and the law of the shards."""

import math
import zlib
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from quernel.llm import hilbert


@pytest.mark.parametrize(("n", "bits"), [(2, 1), (2, 3), (3, 2), (3, 3)])
def test_curve_visits_every_cell_by_unit_steps(spark, n, bits):
    side = 1 << bits
    cells = spark.range(side**n).select(*[(F.floor(F.col("id") / side**i) % side).alias(f"d{i}") for i in range(n)])
    rows = cells.select("*", hilbert.hilbert_index([F.col(f"d{i}") for i in range(n)], bits).alias("h")).collect()
    at = {r.h: r[:n] for r in rows}
    assert sorted(at) == list(range(side**n))
    assert all(sum(abs(a - b) for a, b in zip(at[i], at[i + 1], strict=True)) == 1 for i in range(side**n - 1))


def documents(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, shard string, rank int")


def check(rows, got, shards):
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t, *_ in rows)
    per = Counter(r.shard for r in got)
    assert set(per) <= set(range(shards))
    sizes = [per.get(i, 0) for i in range(shards)]
    assert max(sizes) - min(sizes) <= 1
    for s in per:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(per[s]))
    order = sorted(got, key=lambda r: (r.shard, r.slot))
    assert [r.curve for r in order] == sorted(r.curve for r in got)


def test_shards_are_even_runs_of_the_curve(spark):
    rows = [(i, None if i % 17 == 0 else f"text {i % 50} ä", [None, "en", "de"][i % 3], f"src{0 if i % 3 else i % 7}", None if i % 11 == 0 else i * i, "x", 1) for i in range(333)]
    rows += [(5, "again", "en", "src0", 3, None, None)] * 3 + [(None, "no id", None, None, None, None, None), (400, "y" * 200_000, "en", "s", 200_000, "", 0)]
    got = hilbert.document_shards(documents(spark, rows)).collect()
    check(rows, got, 40)


def test_fewer_rows_than_shards_and_none(spark):
    assert hilbert.document_shards(documents(spark, [])).count() == 0
    rows = [(i, "t", "en", "s", 1, "", 0) for i in range(7)]
    check(rows, hilbert.document_shards(documents(spark, rows)).collect(), 40)


def plain_index(point, bits):
    """Axes to curve, on plain numbers: undo the levels from the top, then Gray code and interleave."""
    x, n = list(point), len(point)
    for level in range(bits - 1, 0, -1):
        bit, low = 1 << level, (1 << level) - 1
        for i in range(n):
            if x[i] & bit:
                x[0] ^= low
            else:
                differ = (x[0] ^ x[i]) & low
                x[0] ^= differ
                x[i] ^= differ
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn = 0
    for level in range(bits - 1, 0, -1):
        if x[-1] >> level & 1:
            turn ^= (1 << level) - 1
    text = "".join(str((v ^ turn) >> level & 1) for level in range(bits - 1, -1, -1) for v in x)
    return int(text, 2)


def test_whole_result_equals_a_plain_version(spark):
    rows = [(i, None if i % 17 == 0 else f"text {i % 50} ä", [None, "en", "de"][i % 3], f"src{0 if i % 3 else i % 7}", None if i % 11 == 0 else i * i, "x", 1) for i in range(500)]
    rows += [(None, "no id", "fr", None, -4, None, None), (900, "y" * 70_000, "en", "s", 70_000, "", 0)]
    cell = lambda v: 0 if v is None else xxhash.xxh64_intdigest(v.encode(), 42) % 64
    signed = lambda v: (h := xxhash.xxh64_intdigest(v.encode(), 42)) - (h >> 63 << 64)
    keyed = []
    for d, text, lang, source, n_chars, *_ in rows:
        size = min(63, math.floor(math.log2(max(0, n_chars or 0) + 1) * 2))
        keyed.append((plain_index((cell(source), size, cell(lang)), 6), signed(text or ""), d is not None, d or 0, text or ""))
    want, n = [], len(rows)
    for rank, (curve, _, known, d, text) in enumerate(sorted(keyed)):
        shard = rank * 40 // n
        want.append((d if known else None, len(text.encode()) + 16, zlib.crc32(text.encode()), curve, shard, rank - -(-shard * n // 40)))
    got = hilbert.document_shards(documents(spark, rows)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
