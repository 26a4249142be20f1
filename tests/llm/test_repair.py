"""Re-Pair shards: exact round trips, random access, and ids equal to the tokenizer's."""

import random
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quernel.llm import repair

PATH = public_tokenizers.path("byte_bpe_50k.json")


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.integers(0, 4), max_size=40), max_size=8), st.integers(1, 6))
def test_round_trip(docs, rounds):
    ends = np.cumsum([len(d) for d in docs]).astype(np.int64)
    ids = np.array([i for d in docs for i in d], dtype="<u4")
    block = repair.Block(repair.write_block([None if i % 3 == 0 else i for i in range(len(docs))], ids, ends, 5, rounds))
    assert block.doc_ids == [None if i % 3 == 0 else i for i in range(len(docs))]
    for n, d in enumerate(docs):
        assert block.document(n).tolist() == d
        for a, b in ((0, 1), (1, len(d)), (len(d) // 2, len(d) // 2 + 3), (5, 2)):
            assert block.tokens(n, a, b).tolist() == d[a:b]


def test_grammar_shrinks_what_repeats():
    rnd = random.Random(1)
    phrase = [rnd.randrange(1000) for _ in range(64)]
    ids = np.array((phrase + [1000]) * 500, dtype="<u4")
    symbols, ends, rules = repair.compress(ids, np.array([len(ids)]), 1001, rounds=12)
    assert len(symbols) < len(ids) / 20 and ends.tolist() == [len(symbols)]
    assert (repair.expand(symbols, rules, 1001) == ids).all()
    lengths = repair.rule_lengths(rules, 1001)
    assert all(len(repair.expand(np.array([1001 + i]), rules, 1001)) == n for i, n in enumerate(lengths))


@settings(max_examples=120, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=120), max_size=4), st.integers(1, 3))
def test_no_frequent_pair_is_left(docs, per_round):
    check_grammar(np.array([i for d in docs for i in d], dtype="<u4"), np.cumsum([len(d) for d in docs]).astype(np.int64), 3, per_round=per_round)


def check_grammar(ids, ends, terminals, least=4, **options):
    """No pair within a document occurs ``least`` times, and the ids come back."""
    symbols, stops, rules = repair.compress(ids, ends, terminals, least=least, **options)
    assert (repair.expand(symbols, rules, terminals) == ids).all()
    x = symbols.astype(np.uint64)
    inside = np.ones(max(0, len(x) - 1), dtype=bool)
    inside[[s - 1 for s in stops if 0 < s < len(x)]] = False
    _, counts = np.unique(((x[:-1] << np.uint64(32)) | x[1:])[inside], return_counts=True)
    assert counts.max(initial=0) < least
    return symbols, rules


def test_grammar_of_real_texts_is_complete_past_2_to_the_16():
    texts = [r[0] for r in duckdb.sql("SELECT text FROM '/root/testdata/sf0.01/documents.parquet'").fetchall()]
    encoder = repair.Encoder.of(PATH)
    ids, ends = encoder.encode(pa.array(texts * 2))
    symbols, rules = check_grammar(ids, ends, encoder.vocabulary())
    assert encoder.vocabulary() + len(rules) > 1 << 16 and len(symbols) < len(ids) / 2


def test_rounds_sort_frequent_pairs_only(monkeypatch):
    texts = [r[0] for r in duckdb.sql("SELECT text FROM '/root/testdata/sf0.01/documents.parquet'").fetchall()]
    encoder = repair.Encoder.of(PATH)
    ids, ends = encoder.encode(pa.array(texts))
    seen, sort = [], np.sort
    monkeypatch.setattr(repair.np, "sort", lambda a, *args, **kwargs: (seen.append(len(a)), sort(a, *args, **kwargs))[1])
    repair.compress(ids, ends, encoder.vocabulary())
    assert sum(seen) < 5 * len(ids)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=120), max_size=4), st.integers(1, 4))
def test_expansion_and_lengths_agree(docs, per_round):
    ids = np.array([i for d in docs for i in d], dtype="<u4")
    symbols, _, rules = repair.compress(ids, np.cumsum([len(d) for d in docs]).astype(np.int64), 3, per_round=per_round)
    lengths = repair.rule_lengths(rules, 3)
    assert [len(repair.expand(np.array([3 + i]), rules, 3)) for i in range(len(rules))] == lengths.tolist()
    many = np.tile(np.arange(3 + len(rules)), 2)  # more symbols than rules: each is unrolled once
    assert repair.expand(many, rules, 3).tolist() == [t for s in many for t in repair.expand(np.array([s]), rules, 3)]


TEXTS = ["", " ", "  ", "a", " a", "a ", "a  b", "a   b", "a \n b", "a\n \nb", "x \ty", "x   y", "x  y ", "tab\t z\t", "\n ", " \n", "it's 12 o'clock -- ok?", "ÄÖ ß é", "日本 語", "<|endoftext|> x", "<|endoftext|> hi", "a<|endoftext|>", "b <|endoftext|>.\n c", "<|endoftext|", "<|ENDOFTEXT|> y", "é a   b", "w\x0b \x0bz", "w\x85 \x85z", "r\r \rz", "\x1c \x1d", "a.\nB, c!\n\nd", "x,\ry. \nz", "nul \0x y", "\0", "it's, he'll. o'", "e\u0301, x", "a.b c.. .d", "1, 2.\n3", "a,\u00a0b", "ab#%. \n"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(alphabet="ab1.' \n\t  é", max_size=12), max_size=6))
def test_encoder_equals_the_library(texts):
    check_encoder(texts)


def check_encoder(texts):
    plain = Tokenizer.from_file(PATH)
    ids, ends = repair.Encoder.of(PATH).encode(pa.array(texts, pa.string()))
    at = 0
    for text, end in zip(texts, ends, strict=True):
        assert ids[at:end].tolist() == [*plain.encode(text or "", add_special_tokens=False).ids, 0], repr(text)
        at = end
    assert at == len(ids)


def test_encoder_on_odd_texts():
    check_encoder([*TEXTS, None, "long " * 30_000, "nospace" * 3000])
    small = repair.Encoder(PATH, keep=10)
    for _ in range(3):
        assert small.encode(pa.array(TEXTS))[0].tolist() == repair.Encoder.of(PATH).encode(pa.array(TEXTS))[0].tolist()


@pytest.mark.parametrize("block_tokens", [1, 50, 1 << 20])
def test_documents(spark, block_tokens):
    rnd = random.Random(3)
    rows = [(i * 7 % 101, " ".join(rnd.choice(["alpha", "beta", "gamma!", "Ä"]) for _ in range(rnd.randrange(30)))) for i in range(101)]
    rows += [(500, None), (501, ""), (502, "same"), (502, "same"), (502, "other"), (None, "no id"), (600, "x " * 4000)]
    docs = spark.createDataFrame([(i, t, 9, "s") for i, t in rows], "doc_id long, text string, block int, shard string").repartition(4)
    got = repair.token_ids(docs, PATH, block_tokens=block_tokens).collect()
    plain = Tokenizer.from_file(PATH)
    want, start = [], 0
    place = {(r.doc_id, r.text): r.hash for r in docs.selectExpr("doc_id", "text", "xxhash64(coalesce(text, '')) AS hash").collect()}
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, place[r])):
        ids = np.array([*plain.encode(t or "", add_special_tokens=False).ids, 0], dtype="<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted((tuple(r) for r in got), key=lambda r: r[1]) == want
    assert repair.token_ids(docs.limit(0), PATH).count() == 0
