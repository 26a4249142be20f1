"""Stupid backoff against a dictionary version."""

import math
import random
from collections import Counter

import pytest

from quernel.llm import lm_score
from quernel.llm.simhash import words_of


def by_hand(texts, order, alpha=0.4):
    grams = lambda ws: Counter(tuple(ws[i - n + 1 : i + 1]) for n in range(1, order + 1) for i in range(n - 1, len(ws)))
    docs = [words_of(t) for t in texts]
    total = sum((grams(d) for d in docs), Counter())
    words = sum(map(len, docs))
    out = []
    for d in docs:
        own, rest, score = grams(d), max(1, words - len(d)), 0.0
        for i in range(len(d)):
            value = alpha**order / rest
            for n in range(min(order, i + 1), 0, -1):
                g = tuple(d[i - n + 1 : i + 1])
                if total[g] > own[g]:
                    value = alpha ** (min(order, i + 1) - n) * (total[g] - own[g]) / (total[g[:-1]] - own[g[:-1]] if n > 1 else rest)
                    break
            score += math.log(value)
        out.append((len(d), score))
    return out


@pytest.mark.parametrize(("order", "chunk_words"), [(1, 10**6), (2, 10**6), (2, 40), (3, 100), (4, 1)])
def test_equals_brute_force(spark, tmp_path, order, chunk_words):
    rnd = random.Random(order)
    texts = [None, "", "  ", "alone", "The the THE", *(" ".join(rnd.choice("abcdefghij") * rnd.randint(1, 2) for _ in range(rnd.randint(1, 60))) for _ in range(60))]
    texts += texts[-5:] * 3 + ["z " * 3000]
    path = str(tmp_path / "docs")
    spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, slot string, chunk int").repartition(3).write.parquet(path)
    docs = spark.read.parquet(path)
    got = {r.doc_id: (r.n_words, r.log_score) for r in lm_score.backoff_scores(docs, order=order, chunk_words=chunk_words, bucket_bytes=100).collect()}
    for i, (n, score) in enumerate(by_hand(texts, order)):
        assert got[i][0] == n and got[i][1] == pytest.approx(score, abs=1e-6), texts[i]


def test_empty_table_null_ids_and_repeats(spark):
    assert lm_score.backoff_scores(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    got = lm_score.backoff_scores(spark.createDataFrame([(None, "a b"), (1, "a b"), (1, "a b")], "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.n_words, round(r.log_score, 6)) for r in got) == [(0, 2, round(math.log(2 / 4), 6)), (1, 2, round(math.log(2 / 4), 6)), (1, 2, round(math.log(2 / 4), 6))]


def test_rows_that_change_their_order_are_noticed():
    import pyarrow as pa

    table = pa.table({"mark": [1, 2], "kind": [0, 1], "part": [0, 0], "a": [b"", b""], "b": [b"", b""]})
    with pytest.raises(RuntimeError, match="order"):
        lm_score.score_chunk(table, 3, 0.4)


def test_packing_round_trip():
    import numpy as np

    for values in (np.array([], dtype="<u8"), np.array([1, 5, 1 << 60], dtype="<u8")):
        assert (lm_score.unpack(lm_score.pack(values), "<u8") == values).all()
