"""The grammar on clauses by hand, composition against running in turn, and held-out accuracy."""

import random
import zlib

import numpy as np

from quernel.llm import toxicity as t
from quernel.llm.logistic import fit

MODEL = t.Model({"idiot$": 3.0, "dumm": 2.0}, fit(np.zeros((0, len(t.FEATURES))), np.zeros(0), t.PRIOR))


def marks(text):
    symbols = [MODEL.symbol(w)[0] for w in t.TOKEN.findall(text.lower())]
    return [(o & 7, o >> 3) for o in MODEL.machine.run([s for s in symbols if s >= 0])]


def test_rewrites():
    assert marks("an idiot")[1] == (t.INSULT, 0)
    assert marks("not an idiot")[2] == (t.INSULT, 1)
    assert marks("not that one two three idiot")[-1] == (t.INSULT, 0)
    assert marks("she said idiot")[2] == (t.INSULT, 2 | 4)
    assert marks('the "idiot" x idiot') == [(0, 0), (6, 0), (1, 2), (6, 0), (0, 0), (1, 0)]
    assert marks("you are an idiot")[3] == (t.INSULT, 4)
    assert marks("idiot are you")[2] == (t.TARGET, 4)
    assert marks("kill the time")[0] == (t.OTHER, 0)
    assert marks("you i kill")[2] == (t.THREAT, 4)
    assert marks("so ein dummkopf")[2] == (t.INSULT, 0)


def test_composition_equals_running_in_turn():
    rnd = random.Random(1)
    parity = t.Transducer.of(lambda s, x: (s ^ x & 1, x + s), [0, 1, 2])
    delay = t.Transducer.of(lambda s, x: (x, x * 10 + s), parity.outputs())
    both = parity.compose(delay)
    for _ in range(50):
        word = [rnd.randrange(3) for _ in range(rnd.randrange(12))]
        assert both.run(word) == delay.run(parity.run(word))


def test_weights_multiply_along_composed_arcs():
    half = t.Transducer.of(lambda s, x: (1 - s, x, 0.5 if s else 1.0), [0, 1])
    double = t.Transducer.of(lambda s, x: (s, x, 2.0 if x else 1.0), half.outputs())
    assert half.compose(double).weighted([1, 1, 0, 0]) == [(1, 2.0), (1, 1.0), (0, 1.0), (0, 0.5)]
    machine = t.grammar()
    assert [w for _, w in machine.weighted([t.INSULT, t.NEGATION, t.INSULT, t.REPORT, t.INSULT, t.OTHER])] == [1.0, 1.0, 0.5, 1.0, 0.5, 1.0]


def test_features_of_odd_texts():
    assert MODEL.features(None) == MODEL.features("") == MODEL.features("...") == [0.0] * len(t.FEATURES)
    assert MODEL.features("idiot " * 50_000)[7] > 0
    negated, plain = MODEL.features("no idiot here"), MODEL.features("an idiot here")
    assert MODEL.head.probability(np.array([plain]))[0] > MODEL.head.probability(np.array([negated]))[0] > MODEL.head.probability(np.array([MODEL.features("fine")]))[0]


def test_learned_scores(spark):
    rnd = random.Random(5)
    rows, labels = [], []
    for i in range(600):
        words = [rnd.choice("lorem ipsum dolor sit amet elit sed do".split()) + rnd.choice("abcd") for _ in range(40)]
        toxic = i % 4 == 0
        if toxic:
            for w in ("grobian", "fies" + rnd.choice("abcdefg") * 2, "grobian"):
                words.insert(rnd.randrange(40), w)
        rows.append((i, " ".join(words), "x", 1.0))
        labels.append((i, int(toxic), 1))
    rows += [(1000, None, "x", 1.0), (1001, "", "x", 1.0), (1001, "", "x", 1.0), (None, "grobian grobian fiesaa", "x", 1.0)]
    labels += [(0, None, 1), (None, 1, 1), (4, 1, 0), (9999, 1, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string, y double")
    table = spark.createDataFrame(labels, "doc_id long, toxic int, text int")
    got = t.toxicity(docs, table).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    right = [r.predicted == (r.doc_id % 4 == 0) for r in got if r.held_out and r.doc_id < 600]
    assert sum(right) / len(right) > 0.97
    assert next(r for r in got if r.doc_id is None).predicted == 1
    nothing = t.toxicity(docs, table.limit(0)).collect()
    assert len(nothing) == len(rows) and all(0 <= r.score <= 1 for r in nothing)
    assert t.toxicity(docs.limit(0), table).count() == 0


def test_lexicon_needs_more_than_chance():
    from collections import Counter

    got = t.learn_lexicon(Counter(bad=30, rare=3, both=40), Counter(both=360), 50, 450, 1000)
    assert set(got) == {"bad"}
