"""Stupid-backoff language-model scores from n-gram count tables that are partitioned by hash.

For every word w with context c of up to ``order - 1`` words:

    S(w | c) = count(c w) / count(c)            if the n-gram occurs elsewhere in the corpus
             = alpha * S(w | c without its first word)   otherwise; at the end count(w) / words,
    and alpha^order / words for a word that occurs nowhere else.

"Elsewhere": each document's own occurrences are taken out of every count, so that a document
can't vouch for itself. A document's score is the sum of log S over its words.

The relational plan is count(n-gram) over all rows, joined back to each row's n-grams, summed per
document. To keep it small, its rows are blocks. Texts are read in chunks of about ``chunk_words``
words. A chunk sends each bucket of the hash space its distinct n-grams, sorted and with counts (an
n-gram is sent once a chunk however often it occurs, so frequent ones make no hot key). The bucket,
a part of the count table, adds up and answers in the same order how often each occurs in other
chunks. The answers are joined to the chunk, whose n-grams are exploded there, and summed per
document. Both shuffles carry byte planes of sorted hashes: 5 to 6 bytes an n-gram instead of a
40-byte row. A chunk's own words don't pass the buckets: they are read a second time.

There is a bucket for every ``bucket_bytes`` of text, so a bucket, and the task that adds it up, stay
as large as they are however large the corpus is; the smallest blocks are single n-grams.

N-grams are identified by 64-bit hashes. Nulls and texts without words score 0; repeated rows are
documents of their own. The input must give its rows in the same order when it is read again, as
files do (a change is noticed and is an error).
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernel.llm.simhash import words_of
from quernel.workspace import stage

BLOCKS = "slot long, chunk long, mark long, kind int, part int, a binary, b binary"
SCORES = "doc_id long, n_words long, log_rest double, n_longest long, n_first long, n_unknown long"
FIELDS = [f.split()[0] for f in BLOCKS.split(", ")]


class Vocabulary(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def pack(values: np.ndarray) -> bytes:
    """Byte planes, compressed: the upper bytes of small numbers cost next to nothing."""
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(data: bytes, dtype: str) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8)
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).reshape(-1).view(dtype)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix): a bijection, so it adds no collisions."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def ngram_hashes(words: np.ndarray, depth: np.ndarray, order: int) -> list[np.ndarray]:
    """For n = 1 .. order the hashes of the n-grams that end at the places with depth >= n.

    ``words``: hashes of all words of a chunk; ``depth``: place within the document, from 1.
    """
    out, last = [], words
    for n in range(1, order + 1):
        if n > 1:
            longer = np.zeros_like(words)
            longer[1:] = mix(last[:-1] * np.uint64(0x9E3779B97F4A7C15) + words[1:] + np.uint64(n))
            last = longer
        out.append(last[depth >= n])
    return out


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], FIELDS)


def _depth(lengths: np.ndarray) -> np.ndarray:
    starts = np.repeat(np.cumsum(lengths) - lengths, lengths)
    return np.arange(len(starts)) - starts + 1


def chunk_state(ids: list, lengths: list[int], stream: np.ndarray, table: np.ndarray):
    """The chunk itself (kind 0): whose words they are, and the words."""
    known = np.array([i is not None for i in ids])
    head = np.array([i or 0 for i in ids], dtype="<i8").tobytes() + np.array(lengths, dtype="<i8").tobytes() + known.tobytes()
    packed = pack(table)
    yield 0, 0, len(ids), head, len(packed).to_bytes(8, "big") + packed + pack(stream)


def chunk_counts(lengths: list[int], stream: np.ndarray, table: np.ndarray, order: int, buckets: int):
    """The chunk's n-gram counts by bucket (kind = n)."""
    grams = ngram_hashes(table[stream], _depth(np.array(lengths)), order)
    bounds = np.arange(1, buckets, dtype=np.uint64) * np.uint64((1 << 64) // buckets)
    for n, g in enumerate(grams, 1):
        keys, counts = np.unique(g, return_counts=True)
        cuts = [0, *np.searchsorted(keys, bounds), len(keys)]
        for b in range(buckets):
            own = keys[cuts[b] : cuts[b + 1]]
            if len(own):
                yield n * buckets + b, n, b, pack(np.diff(own, prepend=np.uint64(0))), pack(counts[cuts[b] : cuts[b + 1]].astype("<u4"))


def blocks(docs: DataFrame, order: int, buckets: int, chunk_words: int, counts: bool) -> DataFrame:
    """The chunks' counts, or the chunks themselves; ``mark`` tells if both saw the same words."""

    def run(batches):
        part, seq, ids, lengths, streams, held, vocabulary = 0, 0, [], [], [], 0, Vocabulary()

        def flush():
            stream = np.concatenate(streams) if streams else np.zeros(0, dtype="<u4")
            table = np.fromiter((xxhash.xxh64_intdigest(w, 42) for w in vocabulary), dtype=np.uint64, count=len(vocabulary))
            mark = xxhash.xxh64_intdigest(stream.tobytes() + table.tobytes()) >> 1
            made = chunk_counts(lengths, stream, table, order, buckets) if counts else chunk_state(ids, lengths, stream, table)
            got = []
            for slot, *rest in made:
                got.append((slot, part << 32 | seq, mark, *rest))
                if len(got) == 64:
                    yield _rows(got)
                    got = []
            if got:
                yield _rows(got)

        for batch in batches:
            part = batch.column(2)[0].as_py() if batch.num_rows else part
            for ident, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = words_of(text.as_py())
                ids.append(ident)
                lengths.append(len(words))
                streams.append(np.fromiter(map(vocabulary.__getitem__, words), dtype="<u4", count=len(words)))
                held += len(words)
                if held >= chunk_words:
                    yield from flush()
                    seq, ids, lengths, streams, held, vocabulary = seq + 1, [], [], [], 0, Vocabulary()
        if ids:
            yield from flush()

    return docs.mapInArrow(run, BLOCKS)


def add_up(asked: pa.Table) -> pa.Table:
    """One bucket of one n-gram length: occurrences in other chunks, answered to each in its own order."""
    keys = [np.cumsum(unpack(a.as_py(), "<u8"), dtype=np.uint64) for a in asked.column("a")]
    counts = [unpack(b.as_py(), "<u4") for b in asked.column("b")]
    _, where = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(where, weights=np.concatenate(counts)).astype("<u8")
    out, at = [], 0
    for c in counts:
        out.append(pack(total[where[at : at + len(c)]] - c))
        at += len(c)
    return asked.set_column(5, "a", pa.array(out, pa.binary())).set_column(6, "b", pa.nulls(len(out), pa.binary()))


def score_chunk(table: pa.Table, order: int, alpha: float) -> pa.Table:
    """A chunk's words and the counts that came back for them -> one row per document.

    ``log_rest`` leaves out the division by the corpus size, which comes in at the end.
    """
    if len(pc.unique(table.column("mark"))) > 1:
        raise RuntimeError("the rows came in another order when they were read again: write them to a table first")
    by_kind: dict[int, list] = {}
    for kind, part, a, b in zip(*(table.column(c).to_pylist() for c in ("kind", "part", "a", "b")), strict=True):
        by_kind.setdefault(kind, []).append((part, a, b))
    ((n_docs, head, body),) = by_kind[0]
    ids = np.frombuffer(head[: 8 * n_docs], dtype="<i8")
    lengths = np.frombuffer(head[8 * n_docs : 16 * n_docs], dtype="<i8")
    known = np.frombuffer(head[16 * n_docs :], dtype=bool)
    cut = 8 + int.from_bytes(body[:8], "big")
    words, stream = unpack(body[8:cut], "<u8"), unpack(body[cut:], "<u4")
    depth, doc = _depth(lengths), np.repeat(np.arange(n_docs), lengths)
    elsewhere = []  # by n, for every place: occurrences of the n-gram that ends there, outside the document
    for n, g in enumerate(ngram_hashes(words[stream], depth, order), 1):
        at = depth >= n
        _, where, here = np.unique(g, return_inverse=True, return_counts=True)
        answers = [unpack(a, "<u8") for _, a, _ in sorted(by_kind.get(n, []))]
        total = (np.concatenate(answers).astype(np.int64) + here)[where] if answers else np.zeros(0, dtype=np.int64)
        _, mine, own = np.unique(doc[at] * (where.max(initial=0) + 1) + where, return_inverse=True, return_counts=True)
        out = np.zeros(len(stream), dtype=np.int64)
        out[at] = total - own[mine]
        elsewhere.append(out)
    log = np.full(len(stream), order * math.log(alpha))  # a word that occurs nowhere else
    open_ = np.ones(len(stream), dtype=bool)
    reached = np.zeros(len(stream), dtype=np.int64)
    for n in range(order, 0, -1):
        hit = open_ & (elsewhere[n - 1] > 0) & (depth >= n)
        value = np.log(elsewhere[n - 1][hit])
        if n > 1:
            value -= np.log(elsewhere[n - 2][np.flatnonzero(hit) - 1])
        steps = np.minimum(order, depth[hit]) - n  # no step is taken past a context that isn't there
        log[hit] = value + steps * math.log(alpha)
        reached[hit] = n
        open_ &= ~hit
    add = lambda x: np.bincount(doc, weights=x, minlength=n_docs)
    count = lambda x: add(x).astype(np.int64)
    return pa.table(
        {"doc_id": pa.array(ids, mask=~known), "n_words": lengths, "log_rest": add(log), "n_longest": count(reached == order), "n_first": count(reached == 1), "n_unknown": count(reached == 0)}
    )


def backoff_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = 3, alpha: float = 0.4, chunk_words: int = 1_500_000, bucket_bytes: int = 24 << 20) -> DataFrame:
    """``(doc_id, n_words, log_score, mean_log_score, n_longest, n_first, n_unknown)``, a row per row.

    ``n_longest``: words scored by an n-gram of full length; ``n_first``: by their own count;
    ``n_unknown``: words found nowhere else. ``chunk_words`` bounds a task's memory (some 150 bytes
    a word); a longer single document is a chunk of its own.
    """
    if order < 1 or not 0 < alpha <= 1:
        raise ValueError("order from 1, alpha in (0, 1]")
    # The number of the input's own partition: a task's number would count on after a union.
    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.spark_partition_id().cast("long").alias("part"))
    size = picked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = 1 << max(3, (-(-size // bucket_bytes) - 1).bit_length())
    answers = blocks(picked, order, buckets, chunk_words, True).groupBy("slot").applyInArrow(add_up, BLOCKS)
    chunks = blocks(picked, order, buckets, chunk_words, False)
    counted = answers.unionByName(chunks)
    scored = stage(counted.groupBy("chunk").applyInArrow(lambda t: score_chunk(t, order, alpha), SCORES), "scores")
    words = scored.agg(F.sum("n_words")).first()[0] or 0
    rest = F.greatest(F.lit(1), F.lit(words) - F.col("n_words"))
    score = F.col("log_rest") - (F.col("n_first") + F.col("n_unknown")) * F.log(rest)
    return scored.select(
        "doc_id", "n_words", score.alias("log_score"), F.when(F.col("n_words") > 0, score / F.col("n_words")).otherwise(0.0).alias("mean_log_score"), "n_longest", "n_first", "n_unknown"
    )
