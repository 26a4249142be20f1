"""Decontamination: the distance by hand, the walks' property, planted passages against brute force."""

import random

import numpy as np
import pytest

from quernel.llm import decontam as d


def plain_infix(item, part):
    row = [0] * (len(part) + 1)
    for i, w in enumerate(item, 1):
        last, row = row, [i]
        for j, x in enumerate(part, 1):
            row.append(min(last[j - 1] + (w != x), last[j] + 1, row[j - 1] + 1))
    return min(row)


def plain_edit(a, b):
    row = list(range(len(b) + 1))
    for i, w in enumerate(a, 1):
        last, row = row, [i]
        for j, x in enumerate(b, 1):
            row.append(min(last[j - 1] + (w != x), last[j] + 1, row[j - 1] + 1))
    return row[-1]


@pytest.mark.parametrize("seed", range(30))
def test_infix_distance(seed):
    rnd = random.Random(seed)
    item, part = [rnd.choice("abc") for _ in range(rnd.randint(1, 8))], [rnd.choice("abc") for _ in range(rnd.randint(0, 15))]
    number = lambda words: np.array([ord(w) for w in words], dtype=np.int64)
    edits, a, b = d.infix_distance(number(item), number(part), 99)
    assert edits == plain_infix(item, part) == plain_edit(item, part[a:b])


def edited(rnd, words, edits):
    words = list(words)
    for _ in range(edits):
        at = rnd.randrange(len(words))
        how = rnd.randrange(3)
        if how == 0:
            words[at] = f"new{rnd.randrange(999)}"
        elif how == 1:
            words.insert(at, f"new{rnd.randrange(999)}")
        else:
            del words[at]
    return words


def test_tables_reach_the_recall_wanted():
    """Items with as many edits as are allowed, in texts of other items' words, at several lengths."""
    rnd = random.Random(5)
    vocabulary = [f"w{i}" for i in range(3000)]
    items, texts = [], []
    for n in (5, 11, 17, 25, 40, 60, 140, 300):
        for _ in range(40):
            item = [rnd.choice(vocabulary) for _ in range(n)]
            items.append((len(items), " ".join(item)))
            around = [rnd.choice(vocabulary) for _ in range(rnd.randrange(80))]
            at = rnd.randint(0, len(around))
            texts.append(" ".join(around[:at] + edited(rnd, item, n // 5) + around[at:]))
    found = {(i, m) for i, m, *_ in d.Items(items, 0.8, d.Walks()).matches(texts)}
    assert sum((i, i) in found for i in range(len(items))) >= 0.99 * len(items)


def test_unlike_texts_are_seldom_candidates():
    rnd = random.Random(6)
    vocabulary = [f"w{i}" for i in range(3000)]
    say = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n))
    items = d.Items([(i, say(40)) for i in range(200)], 0.8, d.Walks())
    docs = [items.coded(say(500)) for _ in range(200)]
    assert len(items.candidates(docs)[0]) < 2000  # of 100,000 starts and 200 items


def test_planted_passages(spark):
    rnd = random.Random(9)
    vocabulary = [f"w{i}" for i in range(400)]
    items = [(i, " ".join(rnd.choice(vocabulary) for _ in range(n))) for i, n in enumerate([1, 2, 4, 6, 9, 14, 20, 37, 59])]
    rows, planted = [], {}
    for i in range(120):
        body = [rnd.choice(vocabulary) for _ in range(rnd.randint(0, 150))]
        if i % 2:
            number, text = items[rnd.randrange(3, len(items))]
            words = text.split()
            allowed = int(0.2 * len(words))
            at = rnd.randint(0, len(body))
            body[at:at] = edited(rnd, words, rnd.randint(0, allowed) if i % 4 == 1 else 0)
            planted[i] = number
        rows.append((i, ", ".join(body).upper() if i % 3 else "\n".join(body)))
    rows += [(500, None), (501, ""), (502, "?!"), (503, (items[7][1] + " ") * 300), (503, items[7][1]), (None, items[8][1])]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame([*items, (90, None), (91, ""), (None, "w1 w2 w3"), (7, items[7][1])], "item_id long, text string")
    got = d.contaminated(docs, bench).collect()
    found = {(r.doc_id, r.item_id): r.edits for r in got}
    text = {i: d.words_of(t) for i, t in rows}
    want = {}
    for i, w in text.items():
        for number, t in items:
            item = t.split()
            edits = plain_infix(item, w) if w else len(item)
            if edits <= int(0.2 * len(item) + 1e-9):
                want[i, number] = edits
    assert set(found) <= set(want) and all(found[x] >= want[x] for x in found)
    assert len(found) >= 0.99 * len(want)
    assert all((i, n) in found for i, n in planted.items() if want.get((i, n)) == 0)
    parts = d.contaminated(docs, bench, part_bytes=60).collect()
    assert {(r.doc_id, r.item_id) for r in parts} == set(found)
    assert all(plain_edit(dict(items)[r.item_id].split(), text[r.doc_id][r.start_word : r.end_word]) == r.edits for r in got)
    kept = d.without_contaminated(docs, bench, part_bytes=300)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0) for r in kept.collect()) == sorted((i or 0) for i, _ in rows if i not in {r.doc_id for r in got})
    assert d.contaminated(docs, bench.limit(0)).count() == 0 and d.contaminated(docs.limit(0), bench).count() == 0


def test_repeated_rows_and_similarity(spark):
    docs = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (2, "b c"), (3, "A, B!\nC d")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    got = d.contaminated(docs, bench, similarity=1.0).collect()
    assert sorted((r.doc_id, r.start_word, r.end_word, r.edits) for r in got) == [(1, 0, 3, 0), (1, 0, 3, 0), (3, 0, 3, 0)]
    with pytest.raises(ValueError, match="similarity"):
        d.contaminated(docs, bench, similarity=0)


def test_a_very_long_text(spark):
    rnd = random.Random(2)
    items = [(i, " ".join(f"w{rnd.randrange(400)}" for _ in range(30))) for i in range(5)]
    words = [f"w{rnd.randrange(400)}" for _ in range(300_000)]
    words[250_000:250_000] = items[3][1].split()
    found = list(d.Items(items, 0.8, d.Walks()).matches([None, " ".join(words), ""]))
    assert found == [(1, 3, 250_000, 250_030, 0)]
