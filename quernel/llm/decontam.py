"""Benchmark passages in documents, by CGK embedding, bit-sampling LSH and exact edit distance.

Texts are sequences of words (runs of letters, digits and underscores, lower-cased). A document
holds an item of n words if some part of it is within k = floor((1 - similarity) * n) word edits.

1. CGK walks map a sequence to another one: step i writes the current word and moves on to the next
   one if a random bit of (i, word) says so. Two sequences within few edits fall into step again
   soon, so edit distance becomes Hamming distance. Several walks with bits of their own.
2. LSH tables: each table samples some places of one walk. Items are dealt into rungs of similar
   length (each a third longer than the last); a rung of length L samples places below 2L, where a
   walk has gone about L words far. The sampled words of an item, hashed, are its key; the table
   maps keys to items. How many tables a rung needs for the recall wanted is measured when the
   tables are made, on random items with as many random edits as are allowed.
3. Every place of a document is the start of an item-sized window. Its walks are followed, the same
   places sampled, and the keys looked up: equal keys make (start, item) a candidate. Only places
   that can't hold any item of a rung are left out before: an item of n words within k edits has
   n - k of its words among the n + k that follow its start, so fewer words that any item of the
   rung knows mean that there is none. That drops no match.
4. Candidates are verified by the exact edit distance between the item and the best part of the
   document around the window. Before, word grams thin them out: an item of n words with k edits
   keeps n - q + 1 - k * q of its grams of q words. That drops no match, either.

Rungs from 128 words on look at every (L / 64)-th start only, so the work for a document's word is
bounded however long items are; the edits that a shift adds are part of the measured recall.

Items go to every task in parts of at most ``part_bytes`` of text (one item at least); a benchmark
that is larger is searched part by part. Documents are read whole, without any shuffle. Null or
empty texts and items, and items without an id, match nothing. Repeated rows each have their
matches; of an item that a document holds several times the best place found is given.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = re.compile(r"\w+")
MATCHES = "doc_id long, item_id long, start_word int, end_word int, n_words int, edits int, similarity double"
CHUNK_WORDS = 100_000  #: words that are looked at together, unless a single document has more
SLICE = 1 << 16  #: starts that are walked together


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def edits_allowed(n: int, similarity: float) -> int:
    return math.floor((1 - similarity) * n + 1e-9)


def infix_distance(item: np.ndarray, part: np.ndarray, most: int) -> tuple[int, int, int]:
    """Least edits that turn ``item`` into some run of ``part``: (edits, first, end); ``most`` + 1 if more.

    Sellers' dynamic programme, a row per word of the item; the run's start travels along.
    """
    row = np.zeros(len(part) + 1, dtype=np.int64)
    begin = np.arange(len(part) + 1)
    for i, w in enumerate(item, 1):
        change = row[:-1] + (part != w)
        drop = row[1:] + 1
        best = np.minimum(change, drop)
        from_ = np.where(change <= drop, begin[:-1], begin[1:])
        # Insertions run along the row: value[j] = min over k <= j of best[k] + (j - k).
        full = np.concatenate([[i], best]) - np.arange(len(part) + 1)
        low = np.minimum.accumulate(full)
        source = np.maximum.accumulate(np.where(full == low, np.arange(len(part) + 1), 0))
        row = low + np.arange(len(part) + 1)
        begin = np.concatenate([[0], from_])[source]
    end = int(np.argmin(row))
    edits = int(row[end])
    return (edits, int(begin[end]), end) if edits <= most else (most + 1, 0, 0)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@dataclass(frozen=True)
class Walks:
    """What walks and tables are made of; equal for all that share a seed."""

    walks: int = 8
    sampled: int = 3
    recall: float = 0.99  #: at the largest edit distance allowed
    trials: int = 400
    most_tables: int = 256
    seed: int = 20_240_601

    def bits(self, symbols: np.ndarray, walk: int, block: int) -> np.ndarray:
        """64 steps' random bits of each symbol (given by its hash)."""
        return mix(symbols ^ mix(np.array([self.seed + 7919 * walk + 104_729 * block], dtype=np.uint64)))


def rung_lengths(most: int) -> list[int]:
    """1, 2, 3, 4, 5, 6, 8, ...: each a third longer than the last."""
    out = [1]
    while out[-1] < most:
        out.append(max(out[-1] + 1, out[-1] * 4 // 3))
    return out


def sample_places(length: int, exact: bool, walks: Walks) -> np.ndarray:
    """For each of ``most_tables`` tables the sampled steps of its walk; table t belongs to walk t % walks."""
    rnd = np.random.default_rng(walks.seed + length)
    # Without edits allowed, steps below the length can't lie past a window's end.
    return rnd.integers(0, length if exact else 2 * length, (walks.most_tables, walks.sampled))


def stride_of(length: int) -> int:
    return max(1, length // 64) if length >= 128 else 1


def follow(words: np.ndarray, starts: np.ndarray, walk: int, wanted: np.ndarray, symbols: np.ndarray, walks: Walks, bits: dict | None = None):
    """Walks from all ``starts`` at once: ``(step, places)`` for each wanted step, in order.

    ``words`` are numbers of ``symbols``, which are hashes; ``bits`` keeps what is derived from them.
    """
    at, bits = starts.astype(np.int64), {} if bits is None else bits
    wanted = set(wanted.tolist())
    for i in range(max(wanted) + 1):
        if i in wanted:
            yield i, at
        if (walk, i >> 6) not in bits:
            bits[walk, i >> 6] = walks.bits(symbols, walk, i >> 6)
        step = bits[walk, i >> 6].take(words.take(at))
        step >>= np.uint64(i & 63)
        step &= np.uint64(1)
        at = at + step.view(np.int64)


FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], dtype=np.uint64)


def table_keys(words: np.ndarray, starts: np.ndarray, ends: np.ndarray | None, places: np.ndarray, symbols: np.ndarray, walks: Walks, bits: dict | None = None):
    """``(table, keys, valid)`` for every table; ``valid``: no sampled place lies at or past its ``ends``."""
    for walk in range(min(walks.walks, len(places))):
        own = places[walk :: walks.walks]
        seen = {}
        for step, at in follow(words, starts, walk, np.unique(own), symbols, walks, bits):
            seen[step] = symbols.take(words.take(at)), None if ends is None else at < ends
        for t, steps in enumerate(own):
            key = reduce(np.add, [seen[s][0] * FACTORS[j % len(FACTORS)] for j, s in enumerate(steps.tolist())])
            valid = None if ends is None else reduce(np.logical_and, [seen[s][1] for s in steps.tolist()])
            yield t * walks.walks + walk, key, valid


def edited(rnd: np.random.Generator, words: list[int], edits: int, fresh: int) -> list[int]:
    """``words`` after random changes, insertions and deletions; new words count from ``fresh``."""
    words = list(words)
    for _ in range(edits):
        at, how = int(rnd.integers(len(words))), int(rnd.integers(3))
        if how == 0:
            words[at] = fresh
        elif how == 1:
            words.insert(at, fresh)
        elif len(words) > 1:
            del words[at]
        fresh += 1
    return words


def tables_needed(length: int, edits: int, walks: Walks) -> int:
    """The least number of tables that find the share ``recall`` of random items with ``edits`` edits.

    Starts near the true one count as well: all that a search would look at. Tables come in turns of
    one for each walk, so that walks, which may go wrong as a whole, are all in use.
    """
    rnd, stride = np.random.default_rng(walks.seed ^ length), stride_of(length)
    around = np.unique(np.arange(-(edits // 2), edits // 2 + 1) // stride * stride)
    pad = int(max(around.max(), edits) + 2 * stride + 2)
    words, at, item_at, next_ = [], [], [], 0
    for _ in range(walks.trials):
        item = list(range(next_, next_ + length))
        next_ += length
        shift = int(rnd.integers(stride))
        here = edited(rnd, item, edits, next_)
        next_ += edits
        filler = range(next_, next_ + 2 * pad + 2 * length)
        next_ += 2 * pad + 2 * length
        item_at.append(len(words))
        words += [*item, *filler[: 2 * length]]
        at.append(len(words) + pad + shift)
        words += [*filler[2 * length : 2 * length + pad], *here, *filler[2 * length + pad :], *filler[: 2 * length]]
    words = np.array([*words, *([next_] * (4 * length + 2))], dtype=np.int64)
    symbols = mix(np.arange(next_ + 1, dtype=np.uint64) + np.uint64(1))
    starts = (np.array(at)[:, None] + around).reshape(-1)
    item_at = np.array(item_at)
    places = sample_places(length, edits == 0, walks)
    items = {t: np.where(valid, key, 0) for t, key, valid in table_keys(words, item_at, item_at + length, places, symbols, walks)}
    hits = np.zeros((walks.most_tables, walks.trials), dtype=bool)
    for t, key, _ in table_keys(words, starts, None, places, symbols, walks):
        hits[t] = ((key.reshape(walks.trials, -1) == items[t][:, None]) & (items[t][:, None] != 0)).any(axis=1)
    reached = np.logical_or.accumulate(hits, axis=0).mean(axis=1) >= walks.recall
    if not reached.any():
        return walks.most_tables
    return min(walks.most_tables, -(-(int(np.argmax(reached)) + 1) // walks.walks) * walks.walks)


class Rung:
    """Items of similar length with their LSH tables."""

    def __init__(self, length: int, members: list[int], items: Items, walks: Walks) -> None:
        self.length, self.members, self.stride = length, members, stride_of(length)
        sizes = sorted({(len(items.words[m]), items.edits[m]) for m in members})
        self.sizes = sizes
        self.known = np.zeros(len(items.symbols), dtype=np.uint8)
        for m in members:
            self.known[items.words[m]] = 1
        n = tables_needed(length, max(k for _, k in sizes), walks)
        self.places = sample_places(length, all(k == 0 for _, k in sizes), walks)[:n]
        self.shift = np.uint64(64 - min(22, max(10, math.ceil(math.log2(len(members) * 64)))))
        self.tables: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [None] * n  #: (filter, keys in order, their items)
        pad = 2 * length + 2
        flat = np.concatenate([np.concatenate([items.words[m], np.zeros(pad, dtype=np.int64)]) for m in members])
        lengths = np.array([len(items.words[m]) for m in members])
        starts = np.cumsum(lengths + pad) - lengths - pad
        number = np.array(members)
        for t, key, valid in table_keys(flat, starts, starts + lengths, self.places, items.symbols, walks):
            key, own = key[valid], number[valid]
            order = np.argsort(key, kind="stable")
            filter_ = np.zeros(1 << (64 - int(self.shift)), dtype=bool)
            filter_[(key >> self.shift).astype(np.int64)] = True
            self.tables[t] = filter_, key[order], own[order]

    def starts(self, words: np.ndarray, last: int) -> np.ndarray:
        """The places below ``last`` that may be the start of a window."""
        known = np.concatenate([[0], np.cumsum(self.known.take(words), dtype=np.int32)])
        hit = np.zeros(last, dtype=bool)
        for n, k in self.sizes:
            stop = np.minimum(np.arange(n + k, n + k + last), len(words))
            hit |= known[stop] - known[:last] >= n - k
        near = hit.copy()  # starts next to a possible one are windows, too: they are chances to be found
        for d in range(1, max(3, self.stride) + 1):
            near[d:] |= hit[:-d]
            near[:-d] |= hit[d:]
        at = np.flatnonzero(near)
        return at[at % self.stride == 0] if self.stride > 1 else at

    def candidates(self, words: np.ndarray, last: int, items: Items, walks: Walks, bits: dict):
        """Arrays (starts, items) of equal keys."""
        starts = self.starts(words, last)
        for lo in range(0, len(starts), SLICE):
            part = starts[lo : lo + SLICE]
            for t, key, _ in table_keys(words, part, None, self.places, items.symbols, walks, bits):
                filter_, keys, own = self.tables[t]
                maybe = np.flatnonzero(filter_.take((key >> self.shift).astype(np.int64)))
                if not len(maybe):
                    continue
                first, end = np.searchsorted(keys, key[maybe]), np.searchsorted(keys, key[maybe], side="right")
                many = end - first
                if many.any():
                    which = np.repeat(first - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
                    yield np.repeat(part[maybe], many), own[which]


class Items:
    """A part of the benchmark: words as numbers (0: no item has it), allowed edits, and the tables."""

    def __init__(self, rows: list[tuple[int, str | None]], similarity: float, walks: Walks) -> None:
        self.walks, self.similarity = walks, similarity
        self.vocabulary: dict[str, int] = {}
        self.ids, self.words, self.edits, self.gram = [], [], [], []
        for ident, text in rows:
            words = words_of(text)
            if not words or ident is None:
                continue
            n = len(words)
            k = edits_allowed(n, similarity)
            self.ids.append(ident)
            self.words.append(np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words], dtype=np.int64))
            self.edits.append(k)
            # The longest gram of which k edits can't spoil all.
            self.gram.append(next((q for q in (3, 2, 1) if n >= q and n - q + 1 - k * q >= 1), 1))
        self.symbols = np.array([0x9E3779B9, *(xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"), 42) for w in self.vocabulary)], dtype=np.uint64)
        self.symbols = mix(self.symbols | np.uint64(1))
        self.grams = [np.unique(self._grams(w, q)) for w, q in zip(self.words, self.gram, strict=True)]
        ladder = rung_lengths(max(map(len, self.words), default=1))
        dealt: dict[int, list[int]] = {}
        for number, w in enumerate(self.words):
            dealt.setdefault(max(x for x in ladder if x <= len(w)), []).append(number)
        self.rungs = [Rung(length, members, self, walks) for length, members in sorted(dealt.items())]
        self.longest = max((2 * r.length for r in self.rungs), default=0) + 2
        self._bits: dict = {}

    def __getstate__(self):
        return self.__dict__ | {"_bits": {}}

    @staticmethod
    def _grams(words: np.ndarray, q: int) -> np.ndarray:
        """Words below 2^21 fit three to a number; larger vocabularies wrap, which only lets more through."""
        out = words[: len(words) - q + 1].copy()
        for i in range(1, q):
            out = (out << 21) ^ words[i : len(words) - q + 1 + i]
        return out

    def _keeps_enough(self, number: int, part: np.ndarray) -> bool:
        q, n = self.gram[number], len(self.words[number])
        if len(part) < q:
            return False
        return int(np.isin(self._grams(part, q), self.grams[number]).sum()) >= max(1, n - q + 1 - self.edits[number] * q)

    def coded(self, text: str | None) -> np.ndarray:
        words = words_of(text)
        return np.fromiter(map(self.vocabulary.get, words, repeat(0)), dtype=np.int64, count=len(words))

    def matches(self, texts: list[str | None]):
        """``(text, item number, first word, end word, edits)`` of every item that a text holds."""
        held, first, size = [], 0, 0
        for i, text in enumerate(texts):
            held.append(self.coded(text))
            size += len(held[-1]) + 1
            if size >= CHUNK_WORDS:
                yield from self._matches(held, first)
                held, first, size = [], i + 1, 0
        yield from self._matches(held, first)

    def candidates(self, docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, start within it, item), in order, of all that meet in a table."""
        lengths = np.array([len(d) for d in docs], dtype=np.int64)
        begins = np.cumsum(lengths + 1) - lengths - 1
        last = int((lengths + 1).sum())
        gap = np.zeros(1, dtype=np.int64)
        words = np.concatenate([*(x for d in docs for x in (d, gap)), np.zeros(self.longest, dtype=np.int64)])
        found = [got for r in self.rungs for got in r.candidates(words, last, self, self.walks, self._bits)]
        if not found:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        start, item = (np.concatenate(x) for x in zip(*found, strict=True))
        pairs = np.unique(start * len(self.ids) + item)
        start, item = pairs // len(self.ids), pairs % len(self.ids)
        doc = np.searchsorted(begins, start, side="right") - 1
        order = np.lexsort((start, item, doc))
        return doc[order], (start - begins[doc])[order], item[order]

    def _matches(self, docs: list[np.ndarray], first: int):
        if not self.ids or not any(map(len, docs)):
            return
        doc, start, item = self.candidates(docs)
        edge = np.flatnonzero((np.diff(doc, prepend=-1) != 0) | (np.diff(item, prepend=-1) != 0))
        for lo, hi in zip(edge, np.append(edge, len(doc))[1:], strict=True):
            d, number = int(doc[lo]), int(item[lo])
            best = self._best_place(number, docs[d], start[lo:hi])
            if best:
                yield first + d, number, *best

    def _best_place(self, number: int, words: np.ndarray, starts: np.ndarray) -> tuple[int, int, int] | None:
        """(first word, end word, edits) of the best place around the starts, if it is good enough."""
        n, k = len(self.words[number]), self.edits[number]
        pad = 2 * k + stride_of(n)
        best, lo = None, 0
        while lo < len(starts):
            hi = lo
            while hi + 1 < len(starts) and starts[hi + 1] - starts[hi] <= pad:
                hi += 1  # overlapping looks are one
            a, b = max(0, int(starts[lo]) - pad), min(len(words), int(starts[hi]) + n + pad)
            lo = hi + 1
            part = words[a:b]
            if not self._keeps_enough(number, part):
                continue
            edits, x, y = infix_distance(self.words[number], part, k)
            if edits <= k and (best is None or edits < best[2]):
                best = a + x, a + y, edits
                if not edits:
                    break
        return best


def parts_of(benchmark: DataFrame, similarity: float, walks: Walks, part_bytes: int, id_col: str = "item_id", text_col: str = "text"):
    """The benchmark as ``Items`` of about ``part_bytes`` of text each; one part at a time is on the driver."""
    rows = benchmark.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("id IS NOT NULL AND text IS NOT NULL")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-size // part_bytes))
    for p in range(n):
        own = rows.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == p) if n > 1 else rows
        yield Items(sorted((r.id, r.text) for r in own.collect()), similarity, walks)


def contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8, walks: Walks | None = None, part_bytes: int = 8 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document and item that it holds: see ``MATCHES``; documents without any have none."""
    if not 0 < similarity <= 1:
        raise ValueError("similarity in (0, 1]")
    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def search(shared) -> DataFrame:
        def run(batches):
            items = shared.value
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.float64()]
            for batch in batches:
                ids, rows = batch.column(0).to_pylist(), []
                for i, number, a, b, edits in items.matches(batch.column(1).to_pylist()):
                    n = len(items.words[number])
                    rows.append((ids[i], items.ids[number], a, b, n, edits, 1 - edits / n))
                cols = list(zip(*rows, strict=True)) or [[]] * len(kinds)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], [f.split()[0] for f in MATCHES.split(", ")])

        return picked.mapInArrow(run, MATCHES)

    # What is broadcast is bounded by part_bytes.
    return reduce(DataFrame.unionByName, [search(docs.sparkSession.sparkContext.broadcast(items)) for items in parts_of(benchmark, similarity, walks or Walks(), part_bytes)])


def without_contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8, walks: Walks | None = None, part_bytes: int = 8 << 20, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that hold an item; all columns, no shuffle."""
    if not 0 < similarity <= 1:
        raise ValueError("similarity in (0, 1]")
    at = docs.columns.index(text_col)

    def without(rows: DataFrame, shared) -> DataFrame:
        def run(batches):
            items = shared.value
            for batch in batches:
                clean = np.ones(batch.num_rows, dtype=bool)
                clean[[m[0] for m in items.matches(batch.column(at).to_pylist())]] = False
                yield batch.filter(pa.array(clean))

        return rows.mapInArrow(run, rows.schema)

    shared = [docs.sparkSession.sparkContext.broadcast(items) for items in parts_of(benchmark, similarity, walks or Walks(), part_bytes)]
    return reduce(without, shared, docs)
