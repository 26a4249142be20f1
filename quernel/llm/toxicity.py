"""Toxicity by a weighted finite-state pattern grammar.

A text is a stream of symbols in clauses: insult (with a weight), threat, target, negation, report,
quotation mark, other. Four letter transducers rewrite the stream; each is a small table of states:

* negation marks insults and threats within three words after a negating word,
* report marks those after a word of reported speech or inside quotation marks,
* target marks those within four words of a person addressed or meant, before or after,
* threat takes a threat word for one only if a target is near; otherwise it is an ordinary word.

Arcs carry weights: one that marks a negated or reported word lets half of its weight through. The
transducers are composed into one machine, whose arcs have the products; it runs over each clause and
gives every word's class, marks and weight. What a clause matches (plain, targeted, negated, reported
insults, threats; the sum of lexicon weight times arc weight) makes the features of the document; a
logistic model turns these into a score, starting from the grammar's own signs.

The insult lexicon is learned: whole words and word beginnings that are commoner in texts labelled
toxic than chance over all candidates can explain. Fitting takes ``max_rows`` labelled rows at most
(those with the smallest hash of their id), a bound on what the driver and each task hold; scoring
takes every document whole. Null and empty texts match nothing and get the score of no match.
"""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from quernel.llm.logistic import Logistic, fit
from quernel.workspace import drop_staged, stage

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, QUOTE = range(7)
NEGATED, REPORTED, TARGETED = 8, 16, 32

# Closed-class words of the corpus' languages (en, de, fr, es).
TARGETS = "you your yours u they them he she him her du dich dir dein deine ihr euch sie tu te toi ton ta tes vous votre vos usted ustedes vosotros ti tus vuestro"
NEGATIONS = "not no never isn aren wasn don doesn didn cannot nor nicht kein keine keinen nie niemals pas jamais aucun aucune ni nunca jamás ningún ninguna"
REPORTS = "said says say saying wrote writes claimed claims called calls quoted quote according reported sagte sagt schrieb nannte laut behauptet dit disait écrit selon appelé dijo dice escribió según llamó"
THREATS = "kill hurt beat shoot stab destroy burn hang murder töten umbringen schlagen erschießen verbrennen tuer frapper brûler détruire matar golpear quemar destruir"

TOKEN = re.compile(r"\w+|[.!?;:\n…]+|[\"“”„«»]")
STOP = re.compile(r"[.!?;:\n…]")


class Transducer:
    """A deterministic weighted letter transducer: (state, symbol) -> (state, symbol, weight); it starts in state 0."""

    def __init__(self, table: dict[tuple[int, int], tuple[int, int, float]]) -> None:
        self.table = table

    @classmethod
    def of(cls, step, symbols) -> Transducer:
        """Tabulate ``step(state, symbol)`` -> (state, symbol [, weight]) over all states that can be reached."""
        table, todo = {}, [0]
        while todo:
            state = todo.pop()
            for symbol in symbols:
                if (state, symbol) not in table:
                    got = step(state, symbol)
                    table[state, symbol] = (*got, 1.0) if len(got) == 2 else got
                    if (got[0], symbols[0]) not in table:
                        todo.append(got[0])
        return cls(table)

    def outputs(self) -> list[int]:
        return sorted({out for _, out, _ in self.table.values()})

    def compose(self, other: Transducer) -> Transducer:
        """The machine that rewrites with this one first and with ``other`` next; weights multiply."""
        names: dict[tuple[int, int], int] = {(0, 0): 0}
        table, todo, symbols = {}, [(0, 0)], sorted({s for _, s in self.table})
        while todo:
            pair = todo.pop()
            for symbol in symbols:
                a, mid, v = self.table[pair[0], symbol]
                b, out, w = other.table[pair[1], mid]
                if (a, b) not in names:
                    names[a, b] = len(names)
                    todo.append((a, b))
                table[names[pair], symbol] = names[a, b], out, v * w
        return Transducer(table)

    def weighted(self, symbols: list[int]) -> list[tuple[int, float]]:
        """What each symbol becomes, and the weight of the arc it took."""
        state, out, table = 0, [], self.table
        for s in symbols:
            state, o, w = table[state, s]
            out.append((o, w))
        return out

    def run(self, symbols: list[int]) -> list[int]:
        return [o for o, _ in self.weighted(symbols)]


HALF = 0.5  #: what a negated or a reported word still weighs


def _kind(symbol: int) -> int:
    return symbol & 7


def grammar() -> Transducer:
    hot = (INSULT, THREAT)

    def negation(state, s):
        if _kind(s) == NEGATION:
            return 3, s
        return (state - 1, s | NEGATED, HALF) if state and _kind(s) in hot else (max(0, state - 1), s)

    def report(state, s):
        """Bit 0: after a word of report; bit 1: inside quotation marks."""
        if _kind(s) == REPORT:
            return state | 1, s
        if _kind(s) == QUOTE:
            return state ^ 2, s
        # A word that is negated as well has been halved already.
        return (state, s | REPORTED, 1.0 if s & NEGATED else HALF) if state and _kind(s) in hot else (state, s)

    def target(state, s):
        """0: nothing near; 1-4: a target was so many words ago; 5-8: an insult or threat was."""
        if _kind(s) == TARGET:
            return 4, s | TARGETED if state > 4 else s
        near = 0 < state <= 4
        if _kind(s) in hot:
            return 8, s | TARGETED if near else s
        return (0 if state in (0, 1, 5) else state - 1), s

    def threat(state, s):
        """An untargeted threat is no threat, unless a target follows (which then carries the mark)."""
        return 0, OTHER if _kind(s) == THREAT and not s & TARGETED else s

    machine = Transducer.of(negation, list(range(7)))
    for step in (report, target, threat):
        machine = machine.compose(Transducer.of(step, machine.outputs()))
    return machine


FEATURES = ("clauses with insults", "strongest clause", "summed weight", "targeted", "negated", "reported", "threats", "distinct insults", "weight per word")
#: Signs of the grammar before anything is learned, on standardised features.
PRIOR = np.array([0.5, 1.0, 0.5, 0.2, -0.2, -0.2, 0.2, 1.0, 0.5])
BEGINNINGS = range(3, 9)  #: lengths of word beginnings that may be lexicon entries


def pieces_of(word: str):
    """What of a word may be an entry: the whole (ending in $) and its beginnings."""
    yield word + "$"
    for n in BEGINNINGS:
        if n > len(word):
            return
        yield word[:n]


@dataclass
class Model:
    lexicon: dict[str, float]
    head: Logistic
    cache: dict[str, tuple[int, float]] = field(default_factory=dict, repr=False, compare=False)
    machine: Transducer = field(default_factory=grammar, repr=False, compare=False)

    def __getstate__(self):
        return {"lexicon": self.lexicon, "head": self.head}

    def __setstate__(self, state):
        self.__init__(state["lexicon"], state["head"])

    def __post_init__(self) -> None:
        for words, kind in ((THREATS, THREAT), (REPORTS, REPORT), (NEGATIONS, NEGATION), (TARGETS, TARGET)):
            self.fixed = {**getattr(self, "fixed", {}), **dict.fromkeys(words.split(), kind)}

    def symbol(self, token: str) -> tuple[int, float]:
        """Class and weight; clause ends are -1."""
        got = self.cache.get(token)
        if got is None:
            weight = max((self.lexicon[p] for p in pieces_of(token) if p in self.lexicon), default=0.0)
            if weight > 0:
                got = INSULT, weight
            elif token in self.fixed:
                got = self.fixed[token], 0.0
            elif STOP.match(token):
                got = -1, 0.0
            else:
                got = (QUOTE if token in "\"“”„«»" else OTHER), 0.0
            if len(self.cache) > 500_000:
                self.cache.clear()
            self.cache[token] = got
        return got

    def features(self, text: str | None) -> list[float]:
        out = [0.0] * len(FEATURES)
        tokens = TOKEN.findall((text or "").lower())
        symbols = [self.symbol(t) for t in tokens]
        if not any(k == INSULT or k == THREAT for k, _ in symbols):
            return out
        clause: list[tuple[int, float]] = []
        for s in [*symbols, (-1, 0.0)]:
            if s[0] >= 0:
                clause.append(s)
                continue
            if any(k == INSULT or k == THREAT for k, _ in clause):
                total = 0.0
                for (_, weight), (o, through) in zip(clause, self.machine.weighted([k for k, _ in clause]), strict=True):
                    if _kind(o) == INSULT:
                        out[3] += bool(o & TARGETED)
                        out[4] += bool(o & NEGATED)
                        out[5] += bool(o & REPORTED)
                        total += weight * through
                    elif _kind(o) == TARGET and o & TARGETED:
                        out[3] += 1
                    out[6] += _kind(o) == THREAT and not o & (NEGATED | REPORTED)
                out[0] += total > 0
                out[1] = max(out[1], total)
                out[2] += total
            clause = []
        out[7] = len({t for t, (k, _) in zip(tokens, symbols, strict=True) if k == INSULT})
        out[8] = 100 * out[2] / max(20, len(tokens))
        return [math.log1p(v) if i != 1 else v for i, v in enumerate(out)]


def learn_lexicon(positive: Counter, negative: Counter, n_positive: int, n_negative: int, candidates: int) -> dict[str, float]:
    """Entries whose share of toxic texts can't be chance, with their log odds (at most 6).

    ``candidates`` pieces were looked at, so the log likelihood ratio against the base rate must
    exceed the log of their number (and 3 to spare).
    """
    base = (n_positive + 1) / (n_positive + n_negative + 2)
    bar, out = math.log(max(2, candidates)) + 3, {}
    for piece, p in positive.items():
        n = negative.get(piece, 0)
        share = p / (p + n)
        if share <= base:
            continue
        ratio = p * math.log(share / base) + (n * math.log((1 - share) / (1 - base)) if n else 0.0)
        odds = math.log((p + 0.5) / (n_positive + 1)) - math.log((n + 0.5) / (n_negative + 1))
        if ratio > bar and odds > 1:
            out[piece] = min(6.0, odds)
    return out


def prune_lexicon(lexicon: dict[str, float], positive: Counter, texts: list[list[str]], least: float, times: int = 3) -> dict[str, float]:
    """The entries that explain something the others don't.

    ``texts``: the entries in each toxic text. Greedily takes the entry with the most toxic texts
    that aren't explained ``times`` times yet, until the next one explains fewer than ``least``.
    That keeps out words that copies of a toxic text happen to share. Of entries for the same
    texts, whole words come first, then longer beginnings.
    """
    where: dict[str, list[int]] = {}
    for i, pieces in enumerate(texts):
        for p in pieces:
            where.setdefault(p, []).append(i)
    cover, out = [0] * len(texts), {}
    same: dict[str, set[int]] = {}  # per piece, the texts in which a taken entry is part of it, or it of one
    rank = lambda p, gain: (-gain * lexicon[p], -positive[p], not p.endswith("$"), -len(p), p)
    heap = [rank(p, len(w)) for p, w in where.items()]
    heapq.heapify(heap)
    while heap:
        piece = heapq.heappop(heap)[-1]
        told = set().union(*(same[q] for q in out if q.rstrip("$").startswith(piece.rstrip("$")) or piece.rstrip("$").startswith(q.rstrip("$"))))
        now = rank(piece, sum(cover[i] < times and i not in told for i in where[piece]))
        if heap and now > heap[0]:
            heapq.heappush(heap, now)
            continue
        if -now[0] < least * lexicon[piece]:
            break
        out[piece], same[piece] = lexicon[piece], set(where[piece])
        for i in same[piece] - told:
            cover[i] += 1
    return out


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, max_rows: int, id_col: str = "doc_id", columns: tuple[str, ...] = ("text",)) -> DataFrame:
    """``(doc_id, y, *columns)`` of up to ``max_rows`` labelled rows that aren't held out, written out.

    Rows with the smallest hash of the id; a document with several labels counts by the largest. Of
    rows that repeat an id the one whose columns have the smallest hash (then the smallest columns) counts.
    """
    ids = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    ids = ids.where(~held_out(F.col("doc_id"))).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), *columns).join(F.broadcast(ids), "doc_id")
    one = picked.groupBy("doc_id", "y").agg(F.min(F.struct(F.xxhash64(*columns).alias("hash"), *columns)).alias("r"))
    return stage(one.select("doc_id", "y", *[F.col(f"r.{c}").alias(c) for c in columns]), "sample")


def _pieces(text: str | None) -> set[str]:
    return {p for w in set(re.findall(r"\w+", (text or "").lower())) for p in pieces_of(w)}


def _count_pieces(sample: DataFrame, only: frozenset[str] | None) -> DataFrame:
    def run(batches):
        found: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                found.update(_pieces(text) if only is None else _pieces(text) & only)
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["piece", "n"])

    return sample.select("text").mapInArrow(run, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n"))


def fit_model(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, id_col: str = "doc_id", text_col: str = "text") -> Model:
    sample = labelled_sample(docs.withColumn("text", F.col(text_col)), labels, "toxic", max_rows, id_col)
    sizes = dict(sample.groupBy("y").count().collect())
    n_positive, n_negative = sizes.get(1, 0), sizes.get(0, 0)
    counts = stage(_count_pieces(sample.where("y = 1"), None), "pieces")
    candidates = counts.count()
    base = (n_positive + 1) / (n_positive + n_negative + 2)
    least = max(2, math.ceil((math.log(max(2, candidates)) + 3) / -math.log(base)))  # fewer can't pass the bar
    positive = Counter({r.piece: r.n for r in counts.where(F.col("n") >= least).collect()})
    negative = Counter({r.piece: r.n for r in _count_pieces(sample.where("y = 0"), frozenset(positive)).collect()})
    lexicon = learn_lexicon(positive, negative, n_positive, n_negative, candidates)

    def entries(batches):
        for batch in batches:
            rows = [sorted(_pieces(t) & lexicon.keys()) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.string()))], ["pieces"])

    texts = [r.pieces for r in sample.where("y = 1").select("text").mapInArrow(entries, "pieces array<string>").collect()]
    lexicon = prune_lexicon(lexicon, positive, texts, least)
    blank = Model(lexicon, fit(np.zeros((0, len(FEATURES))), np.zeros(0), PRIOR))

    def run(batches):
        for batch in batches:
            rows = [blank.features(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.float64()))], ["y", "x"])

    rows = sample.select("y", "text").mapInArrow(run, "y int, x array<double>").collect()
    drop_staged(sample)
    drop_staged(counts)
    x = np.array([r.x for r in rows], dtype=float).reshape(-1, len(FEATURES))
    return Model(lexicon, fit(x, np.array([r.y for r in rows], dtype=float), PRIOR))


def score(docs: DataFrame, model: Model, text_col: str = "text", name: str = "toxicity") -> DataFrame:
    """``docs`` with a column ``name``: the probability of label 1, from the whole text."""
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            x = np.array([model.features(t) for t in batch.column(at).to_pylist()], dtype=float).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(model.head.probability(x))], [*batch.schema.names, name])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(name, DoubleType())]))


def without_toxic(docs: DataFrame, model: Model, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """``docs`` without the rows that score ``least`` or more; all columns, whatever their names."""
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            x = np.array([model.features(t) for t in batch.column(at).to_pylist()], dtype=float).reshape(-1, len(FEATURES))
            yield batch.filter(pa.array(model.head.probability(x) < least))

    return docs.mapInArrow(run, docs.schema)


def toxicity(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000) -> DataFrame:
    """``(doc_id, held_out, score, predicted)``, one row per row of ``docs``."""
    model = fit_model(docs, labels, max_rows)
    found = score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), model, name="score")
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
