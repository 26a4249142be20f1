"""SimHash: fingerprints by hand, links and components against brute force."""

import random

import pytest
import xxhash
from pyspark.sql import functions as F

from quernel.llm import simhash
from quernel.operators.components import connected_components


def brute_components(nodes, linked):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def by_hand(text, k):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] if len(words) >= k else [b" ".join(words)] * bool(words)
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


WORDS = [f"w{i}" for i in range(60)]


def corpus(seed=3):
    rnd = random.Random(seed)
    texts = [None, "", " \t\n", "One", "one", "two Words", "ÄÖ é ä", "x " * 5000]
    for _ in range(25):
        base = [rnd.choice(WORDS) for _ in range(rnd.randint(20, 90))]
        texts.append(" ".join(base))
        for _ in range(rnd.randint(0, 4)):
            edit = list(base)
            for _ in range(rnd.randint(0, 3)):
                edit[rnd.randrange(len(edit))] = rnd.choice(WORDS)
            texts.append("  ".join(edit))
    return list(enumerate(texts))


def test_fingerprint_by_hand():
    for _, text in corpus():
        assert simhash.fingerprint_of(text) == by_hand(text, 3)
    assert simhash.fingerprint_of(None) == simhash.fingerprint_of("  ") == 0
    assert simhash.words_of("A Ä\x0bb\x1cc") == ["a Ä".encode(), b"b\x1cc"]


@pytest.mark.parametrize("radius", [0, 1, 2])
def test_links_equal_brute_force(spark, radius):
    rnd = random.Random(radius)
    fps = {0, (1 << 64) - 1}
    while len(fps) < 300:
        x = rnd.getrandbits(64) if rnd.random() < 0.3 else rnd.choice(sorted(fps))
        for _ in range(rnd.randint(0, 4)):
            x ^= 1 << rnd.randrange(64)
        fps.add(x)
    rows = list(enumerate(sorted(fps)))
    df = spark.createDataFrame([(i, x - (1 << 64) if x >> 63 else x) for i, x in rows], "id long, fp long")
    got = {(r.src, r.dst) for r in simhash.exact_links(df, radius).collect()}
    assert got == {(a, b) for a, x in rows for b, y in rows if a < b and (x ^ y).bit_count() <= radius}


def test_components_of_fingerprints(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit("clash")).withColumn("key", F.lit(1))
    got = {r.doc_id: (r.fp, r.component_id) for r in simhash.fingerprint_components(docs.unionByName(docs.limit(0))).collect()}
    fp = {i: by_hand(t, 3) for i, t in rows}
    want = brute_components(fp, [(a, b) for a in fp for b in fp if a < b and (fp[a] ^ fp[b]).bit_count() <= 2])
    assert {i: c for i, (_, c) in got.items()} == want
    assert {i: f % (1 << 64) for i, (f, _) in got.items()} == fp


def test_empty_table_and_repeated_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.fingerprint_components(empty).count() == 0
    assert simhash.near_duplicates(empty).count() == 0
    twice = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (2, "a b c")], "doc_id long, text string")
    assert sorted((r.doc_id, r.component_id) for r in simhash.fingerprint_components(twice).collect()) == [(1, 1), (1, 1), (2, 1)]
    assert sorted((r.doc_id, r.component_id) for r in simhash.near_duplicates(twice).collect()) == [(1, 1), (1, 1), (2, 1)]


def test_near_duplicates_find_similar_texts(spark):
    """Only pairs over the threshold are linked, and nearly all of those are found."""
    rnd = random.Random(11)
    rows = []
    for i in range(60):
        base = [f"{rnd.randrange(4000)}x" for _ in range(200)]
        rows.append((2 * i, " ".join(base)))
        for _ in range(rnd.randint(0, 8)):
            base[rnd.randrange(200)] = "changed"
        rows.append((2 * i + 1, " ".join(base)))
    rows.append((999, None))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs).collect()}
    text = dict(rows)
    want = {i: simhash.shingle_jaccard(text[2 * i], text[2 * i + 1], 5) >= 0.8 for i in range(60)}
    found = {i: got[2 * i] == got[2 * i + 1] for i in range(60)}
    assert all(want[i] for i in found if found[i])
    assert sum(found[i] for i in want if want[i]) >= 0.95 * sum(want.values())
    assert got[999] == 999


def test_a_pair_that_leads_no_entry_is_found(spark):
    """A repeated phrase rules the fingerprints, so that all rows share all entries."""
    rnd = random.Random(5)
    rows = []
    for i in range(60):
        base = [f"{rnd.randrange(4000)}x" for _ in range(100)]
        rows += [(2 * i, " ".join(["of", "the", "same"] * 800 + base)), (2 * i + 1, " ".join(["of", "the", "same"] * 800 + base[:-3]))]
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: i // 2 * 2 for i in range(120)}


def edited(rnd, n, shape):
    """A text of n words and a version of it with a similarity just over 0.8."""
    base = [f"{rnd.randrange(10**6)}x" for _ in range(n)]
    other = list(base)
    while True:
        last = list(other)
        if shape == "append":
            other.append(f"{rnd.randrange(10**6)}y")
        elif shape == "cut":
            other.pop()
        elif shape == "middle":
            other.insert(n // 2, f"{rnd.randrange(10**6)}y")
        else:
            other[rnd.randrange(n)] = f"{rnd.randrange(10**6)}y"
        if simhash.shingle_jaccard(" ".join(base), " ".join(other), 5) < 0.8:
            return " ".join(base), " ".join(last)


def test_every_edit_shape_at_the_threshold_is_found(spark):
    rnd = random.Random(8)
    texts = [t for shape in ("append", "cut", "middle", "words") for _ in range(60) for t in edited(rnd, rnd.randint(30, 150), shape)]
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {i: i // 2 * 2 for i in range(len(texts))}


def test_ids_that_are_null_or_repeat(spark):
    a = " ".join(f"a{i}" for i in range(60))
    b = a + " more"
    c = b + " words here and there are too"
    rows = [(None, a), (None, b), (7, c), (3, "x y"), (5, "u v"), (5, "x y"), (5, "u v"), (None, "u v"), (9, None), (8, "")]
    docs = spark.createDataFrame([(i, t, f"s{n}", n, "q", b"z") for n, (i, t) in enumerate(rows)], "doc_id long, text string, same string, kept_id int, id string, kept_same binary")
    sim = simhash.shingle_jaccard
    assert sim(a, b, 5) >= 0.8 and sim(b, c, 5) >= 0.8 and sim("x y", "u v", 5) == 0
    got = sorted(((r.doc_id or 0, r.component_id) for r in simhash.near_duplicates(docs).collect()), key=str)
    assert got == sorted([(0, 7), (0, 7), (7, 7), (3, 3), (5, 5), (5, 3), (5, 5), (0, 5), (9, 8), (8, 8)], key=str)
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id, r.text, r.kept_id) for r in kept.collect()) == [(3, "x y", 3), (5, "u v", 4), (7, c, 2), (8, "", 9)]
    near = [(None, "a b c d e f"), (4, "a b c d e f"), (None, "p q"), (None, "p q")]
    prints = simhash.fingerprint_components(spark.createDataFrame(near, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in prints) == [(0, 0), (0, 0), (0, 4), (4, 4)]


def plain_components(rows, similarity=0.8):
    group = {i: i for i, _ in rows}
    sets = [(i, set(simhash.shingles_of(simhash.words_of(t), 5))) for i, t in rows]
    links = [(i, j) for n, (i, x) in enumerate(sets) for j, y in sets[n + 1 :] if (len(x & y) >= similarity * len(x | y) if x or y else True)]
    return brute_components(group, links)


def test_a_large_group_of_near_copies_equals_brute_force(spark):
    """Copies of one text with few and many edits, some linked, some not, and a passage that many texts share."""
    rnd = random.Random(4)
    base, passage = [f"b{rnd.randrange(10**6)}" for _ in range(120)], [f"p{i}" for i in range(60)]
    texts = []
    for i in range(260):
        t = list(base)
        for _ in range(rnd.randint(0, 9)):
            t[rnd.randrange(len(t))] = f"e{rnd.randrange(10**6)}"
        texts.append(" ".join(t))
        own = [f"o{rnd.randrange(10**6)}" for _ in range(rnd.randint(5, 60))]
        texts.append(" ".join(own + passage))
    rows = list(enumerate(texts))
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = plain_components(rows)
    assert got == want and 3 < len(set(want.values())) < 500


def test_parity_sketches_never_rule_out_a_similar_pair():
    rnd = random.Random(3)
    for n in (0, 1, 5, 40, 200, 3000):
        for edits in (0, 1, 3, n // 20, n // 3):
            base = [f"{rnd.randrange(4000)}x" for _ in range(n)]
            other = list(base)
            for _ in range(edits if n else 0):
                other[rnd.randrange(n)] = f"{rnd.randrange(10**6)}y"
            x, y = (set(simhash.shingles_of(simhash.words_of(" ".join(w)), 5)) for w in (base, other))
            a, b = (int.from_bytes(simhash.parity_of(simhash.set_hashes(" ".join(w), 5)), "little") for w in (base, other))
            assert (a ^ b).bit_count() <= len(x ^ y)


def test_sketches_estimate_similarity():
    rnd = random.Random(2)
    base = [f"{rnd.randrange(4000)}x" for _ in range(400)]
    for edits in (0, 5, 9, 200):
        other = list(base)
        for i in rnd.sample(range(400), edits):
            other[i] = "new"
        a, b = " ".join(base), " ".join(other)
        same = simhash.shingle_jaccard(a, b, 5)
        apart = (int.from_bytes(simhash.sketch_of(a, 5), "big") ^ int.from_bytes(simhash.sketch_of(b, 5), "big")).bit_count()
        assert abs(apart / 256 - (1 - same) / 2) < 0.15
        assert same < 0.8 or apart <= simhash.sketch_limit(0.8)


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(7, i) for i in range(8, 60)] + [(5, 5), (7, 8)]
    df = spark.createDataFrame([*edges, (None, 3)], "src long, dst long")
    got = {r.node: r.component for r in connected_components(df).collect()}
    assert got == brute_components({n for e in edges for n in e}, edges)


def test_candidates_of_large_groups_grow_with_the_rows(spark, monkeypatch):
    """Near copies of one text, all linked, and as many unlike texts around a common passage."""
    rnd = random.Random(6)
    base, passage = [f"b{rnd.randrange(10**6)}" for _ in range(120)], [f"p{i}" for i in range(90)]
    rows = []
    for i in range(100):
        t = list(base)
        t[rnd.randrange(len(t))] = f"e{rnd.randrange(10**6)}"
        rows += [(2 * i, " ".join(t)), (2 * i + 1, " ".join(passage + [f"o{rnd.randrange(10**6)}" for _ in range(rnd.randint(28, 40))]))]
    made, possible = [], simhash.possible
    monkeypatch.setattr(simhash, "possible", lambda pairs, *rest: made.append(pairs.count()) or possible(pairs, *rest))
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == plain_components(rows)
    assert len({got[2 * i] for i in range(100)}) == 1 and len(set(got.values())) > 90
    assert sum(made) <= 8 * len(rows)
