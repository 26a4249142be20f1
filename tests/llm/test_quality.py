"""Co-training: the views by hand, what pseudo-labels add, accuracy on rows that were held out."""

import random

import numpy as np
import pytest

from quernel.llm import quality as q
from quernel.llm.logistic import fit


def test_views_of_odd_texts():
    assert q.text_view(None) == q.text_view(" \n") == [0.0] * len(q.TEXT_FEATURES)
    got = dict(zip(q.TEXT_FEATURES, q.text_view("AB ab ab 12 $$ x."), strict=True))
    assert got["share of upper case"] == 2 / 7 and got["repeated neighbours"] == 1 / 6 and got["share of digits"] == 2 / 17
    assert len(q.page_view(None, None, None, None)) == len(q.PAGE_FEATURES)
    assert q.page_view("a\nb", None, "en", "s")[1] == pytest.approx(1000 * 2 / 3, abs=600)
    assert all(np.isfinite(q.text_view("w" * 300_000 + " x" * 100_000)))


def test_pseudo_labels_help_the_weaker_view():
    """Few labels, a large pool, and views that are independent given the class."""
    rnd = np.random.default_rng(2)
    make = lambda n: (y := rnd.integers(0, 2, n).astype(float), (2 * y - 1)[:, None] * 2.2 + rnd.normal(size=(n, 2)), (2 * y - 1)[:, None] * 0.8 + rnd.normal(size=(n, 6)))
    y, xa, xb = make(16)
    _, ua, ub = make(3000)
    t, ta, tb = make(4000)
    model = q.co_train(xa, xb, y, q.array_sums(ua, ub), np.zeros(16, dtype=bool))
    alone = fit(xb, y)
    right = lambda p: ((p >= 0.5) == t).mean()
    assert right(model.page.probability(tb)) > right(alone.probability(tb))
    assert right(model.probabilities(ta, tb)[2]) > 0.97


def test_pools_in_parts_and_in_one_give_one_model():
    rnd = np.random.default_rng(3)
    y = rnd.integers(0, 2, 40).astype(float)
    xa, xb, ua, ub = ((2 * y - 1)[:, None] + rnd.normal(size=(40, d)) for d in (2, 3, 2, 3))
    ua, ub = np.tile(ua, (50, 1)) + rnd.normal(size=(2000, 2)) / 9, np.tile(ub, (50, 1))
    whole = q.co_train(xa, xb, y, q.array_sums(ua, ub), np.zeros(40, dtype=bool))
    parts = lambda f, width: sum((f(ua[i : i + 300], ub[i : i + 300]) for i in range(0, 2000, 300)), np.zeros(width))
    split = q.co_train(xa, xb, y, parts, np.zeros(40, dtype=bool))
    assert np.allclose(whole.probabilities(xa, xb), split.probabilities(xa, xb))


@pytest.mark.parametrize("n", [0, 1, 5])
def test_hardly_any_labels(n):
    model = q.co_train(np.zeros((n, 2)), np.ones((n, 3)), np.ones(n), q.array_sums(np.zeros((4, 2)), np.zeros((4, 3))), np.zeros(n, dtype=bool))
    assert all(np.isfinite(p).all() for p in model.probabilities(np.zeros((3, 2)), np.ones((3, 3))))


def test_scores_all_rows(spark):
    rnd = random.Random(4)
    rows, labels = [], []
    for i in range(500):
        words = [rnd.choice("lorem ipsum dolor sit amet elit sed do".split()) for _ in range(60)]
        bad = i % 3 == 0
        rows.append((i, " ".join(w.upper() + "!!" if bad else w for w in words), "en", f"s{i % 4}", 300, "clash"))
        if i % 2:
            labels.append((i, int(not bad)))
    rows += [(900, None, None, None, None, None), (901, "", "en", "s1", 0, ""), (901, "", "en", "s1", 0, ""), (None, "x", "en", "s", 1, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int, p_text string")
    table = spark.createDataFrame([*labels, (None, 1), (2, None)], "doc_id long, quality int")
    got = q.quality(docs, table).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    right = [r.keep == (r.doc_id % 3 != 0) for r in got if r.held_out and r.doc_id < 500]
    assert len(right) > 50 and sum(right) / len(right) > 0.97
    assert q.quality(docs.limit(0), table).count() == 0
    assert q.quality(docs, table.limit(0)).count() == len(rows)
