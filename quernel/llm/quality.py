"""Text quality by co-training of two views.

View ``text``: what the characters and words of a text look like (repeats, symbols, case, lengths,
punctuation). View ``page``: what is known of it without reading the words (source, language,
length, the shape of its lines). Each view has a classifier of its own. Over several rounds each
view labels the unlabelled rows it is surest about for the other one, which is fitted again. The
views are then calibrated on labelled rows that took no part in the fitting (Platt scaling), and
the calibrated log odds are combined by a third logistic model.

Fitting takes at most ``max_rows`` labelled rows (those with the smallest hash of their id), whose
features, some 50 numbers each, reach the driver, and every unlabelled row there is: those stay in a
table of features, over which tasks add up histograms of confidence and the sums of Newton steps, so
the driver sees two matrices a step. The sums are whole numbers (of 2^-20), so that no order of tasks
changes a model. Scoring takes every document whole. Null and empty texts have all text features zero
and get the score that follows. Rows whose crc32 of the id is divisible by 5 are held out and never
used in fitting; unlabelled rows without an id are used, and rows that repeat count as often as they
are there. Extra columns don't matter, whatever their names.
"""

from __future__ import annotations

import operator
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from quernel.llm.logistic import Logistic, blank, fit, newton_step, newton_sums, sigmoid
from quernel.llm.toxicity import held_out, labelled_sample
from quernel.workspace import drop_staged, stage

TEXT_FEATURES = (
    "share of upper case", "share of digits", "share of symbols", "share of bytes over 127", "share of white space", "symbols per word", "repeated neighbours",
    "share of distinct words", "word length", "long words", "one-letter words", "words that end in marks", "words all upper case", "words without letters", "commonest word", "lower-case starts",
)
HASHED = 16  #: cells for source and for language
PAGE_FEATURES = ("log length", "lines per 1000 characters", "log line length", "short lines", "distinct lines", "empty", "log length squared", *(f"source {i}" for i in range(HASHED)), *(f"language {i}" for i in range(HASHED)))
CLASS = np.zeros(256, dtype=np.uint8)  # 0 other, 1 lower case, 2 upper case, 3 digit, 4 white space, 5 usual punctuation, 6 symbol, 7 over 127
CLASS[33:127] = 6
CLASS[97:123], CLASS[65:91], CLASS[48:58], CLASS[128:] = 1, 2, 3, 7
CLASS[[9, 10, 11, 12, 13, 32]] = 4
CLASS[[ord(c) for c in ".,;:'\"-()?"]] = 5


def text_view(text: str | None) -> list[float]:
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = text.split()
    if not words:
        return [0.0] * len(TEXT_FEATURES)
    c = np.bincount(CLASS[np.frombuffer(raw, dtype=np.uint8)], minlength=8)
    n, b = len(words), len(raw)
    letters = max(1, int(c[1] + c[2]))
    counts: dict[str, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=n)
    return [
        c[2] / letters, c[3] / b, c[6] / b, c[7] / b, c[4] / b, min(3.0, c[6] / n),
        sum(map(operator.eq, words, words[1:])) / n, len(counts) / n**0.9, min(20.0, float(lengths.mean())), float((lengths > 14).mean()), float((lengths == 1).mean()),
        sum(not w[-1].isalnum() for w in words) / n, sum(map(str.isupper, words)) / n, sum(not any(map(str.isalpha, w)) for w in counts) / len(counts),
        max(counts.values()) / n, sum(map(str.islower, words)) / n,
    ]


def page_view(text: str | None, n_chars: int | None, lang: str | None, source: str | None) -> list[float]:
    text = text or ""
    size = max(0, len(text) if n_chars is None else n_chars)
    lines = text.split("\n")
    mean = max(1.0, len(text) / len(lines))
    cells = [0.0] * (2 * HASHED)
    cells[xxhash.xxh32_intdigest((source or "").encode()) % HASHED] = 1.0
    cells[HASHED + xxhash.xxh32_intdigest((lang or "").encode()) % HASHED] = 1.0
    log = float(np.log1p(size))
    return [log, min(100.0, 1000 * len(lines) / max(1, size)), float(np.log(mean)), sum(len(x) < 20 for x in lines) / len(lines), len(set(lines)) / len(lines), float(not text), log * log, *cells]


@dataclass(frozen=True)
class CoTrained:
    """Two views, their calibration (slope, offset) and the weights that combine them."""

    text: Logistic
    page: Logistic
    calibration: tuple[Logistic, Logistic]
    joint: Logistic

    def odds(self, x_text: np.ndarray, x_page: np.ndarray) -> np.ndarray:
        """Calibrated log odds of each view, as columns."""
        raw = (self.text.margin(x_text), self.page.margin(x_page))
        return np.stack([np.clip(c.margin(m[:, None]), -12, 12) for c, m in zip(self.calibration, raw, strict=True)], axis=1)

    def probabilities(self, x_text: np.ndarray, x_page: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        odds = self.odds(x_text, x_page)
        return sigmoid(odds[:, 0]), sigmoid(odds[:, 1]), self.joint.probability(odds)


BINS, FINEST = 2000, 20.0  #: margins from that of ``sure`` to this are told apart by so many bins
STEPS = 8  #: Newton steps after each exchange, at most


def array_sums(ua: np.ndarray, ub: np.ndarray):
    """Sums over a pool that is at hand; see ``co_train``."""
    return lambda f, width: f(ua, ub) if len(ua) else np.zeros(width)


def _lent(models_by_round: list, xa: np.ndarray, xb: np.ndarray) -> list[np.ndarray]:
    """The pseudo-labels (-1: none) that rows were lent for view 0 and 1, in the first round that chose them."""
    out = [np.full(len(xa), -1), np.full(len(xb), -1)]
    for givers, cuts in models_by_round:
        for giver, x in enumerate((xa, xb)):
            m, taken = givers[giver].margin(x), out[1 - giver]
            free = taken < 0
            taken[free & (m >= cuts[giver][0])] = 1
            taken[free & (m <= -cuts[giver][1])] = 0
    return out


def co_train(xa, xb, y, pool_sums, calibrate: np.ndarray, rounds: int = 5, grow: float = 0.05, sure: float = 0.95) -> CoTrained:
    """Views ``xa``, ``xb`` of labelled rows with labels ``y``; ``pool_sums`` adds up over the unlabelled ones.

    ``pool_sums(f, width)`` is the sum of ``f(ua, ub)``, a vector of that width, over all parts of the
    pool. ``calibrate``: rows of the labelled ones that are kept from fitting. Per round each view
    hands over the rows it is surest about, about ``grow`` of the pool for each class (to the next
    bin of its margin), and only rows with a probability over ``sure``; every row is handed over once
    per view. Pseudo-labels weigh half, and all of them half of the labelled rows at most.
    """
    own = ~calibrate
    views = (xa[own], xb[own])
    models = [fit(v, y[own]) for v in views]
    low = float(np.log(sure / (1 - sure)))
    edges = low + (FINEST - low) * np.arange(BINS) / BINS
    history: list = []
    n_pool = int(pool_sums(lambda a, b: np.array([len(a)], dtype=float), 1)[0])
    for _ in range(rounds if n_pool else 0):
        now, was = tuple(models), list(history)

        def histograms(a, b, now=now, was=was):
            lent, out = _lent(was, a, b), []
            for giver, x in enumerate((a, b)):
                m = now[giver].margin(x)[lent[1 - giver] < 0]
                for side in (m, -m):
                    at = np.floor((side[side >= low] - low) / (FINEST - low) * BINS)
                    out.append(np.bincount(np.minimum(at, BINS - 1).astype(int), minlength=BINS))
            return np.concatenate(out).astype(float)

        counts = pool_sums(histograms, 4 * BINS).reshape(2, 2, BINS)
        if not counts.any():
            break
        cuts = []
        for giver in (0, 1):
            above = np.cumsum(counts[giver][:, ::-1], axis=1)[:, ::-1]
            # The lowest bin with at most that many rows from it on; the highest one that has any, at least.
            first = [max(0, min(int(np.argmax(a <= max(1, grow * n_pool))) if (a <= max(1, grow * n_pool)).any() else BINS, int(np.flatnonzero(c).max(initial=-1)) if c.any() else BINS)) for a, c in zip(above, counts[giver], strict=True)]
            cuts.append(tuple(float(edges[i]) if i < BINS else np.inf for i in first))
        history.append((now, tuple(cuts)))
        models = [blank(m) for m in models]  # from a standstill: far off, Newton steps overshoot
        for _ in range(STEPS):
            now, was = tuple(models), list(history)

            def parts(a, b, now=now, was=was):
                lent = _lent(was, a, b)
                return np.concatenate([np.append(newton_sums(m, x[t >= 0], t[t >= 0].astype(float), 1.0), (t >= 0).sum()) for m, x, t in zip(now, (a, b), lent, strict=True)])

            sizes = [(v.shape[1] + 1) * (v.shape[1] + 2) + 1 for v in views]
            total = np.split(pool_sums(parts, sum(sizes)), [sizes[0]])
            # All pseudo-labels of a view weigh half of its labelled rows at most, however large the pool is.
            weights = [0.5 * len(v) / max(len(v), t[-1]) for v, t in zip(views, total, strict=True)]
            steps = [newton_step(m, newton_sums(m, v, y[own], 1.0) + w * t[:-1]) for m, v, t, w in zip(models, views, total, weights, strict=True)]
            moving = [np.abs(a.weights - b.weights).max(initial=0) > 1e-3 for a, b in zip(models, steps, strict=True)]
            models = steps
            if not any(moving):
                break
    rest = calibrate if calibrate.any() else own
    margins = [models[0].margin(xa[rest])[:, None], models[1].margin(xb[rest])[:, None]]
    calibration = tuple(fit(m, y[rest], prior=np.ones(1) * max(1e-6, m.std() if len(m) else 1.0)) for m in margins)
    half = CoTrained(models[0], models[1], calibration, fit(np.zeros((0, 2)), np.zeros(0), np.array([0.5, 0.5])))
    odds = half.odds(xa[rest], xb[rest])
    return CoTrained(models[0], models[1], calibration, fit(odds, y[rest], prior=np.full(2, 0.5) * np.maximum(odds.std(0), 1e-6) if len(odds) else np.full(2, 0.5)))


COLUMNS = ("text", "n_chars", "lang", "source")


def _picked(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("n_chars").cast("long").alias("n_chars"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"))


def _views(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    rows = list(zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in COLUMNS), strict=True))
    return np.array([text_view(r[0]) for r in rows], dtype=float).reshape(-1, len(TEXT_FEATURES)), np.array([page_view(*r) for r in rows], dtype=float).reshape(-1, len(PAGE_FEATURES))


def _collect(sample: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    def run(batches):
        for batch in batches:
            a, b = _views(batch)
            rows = pa.array(list(np.hstack([a, b])), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), rows], ["doc_id", "y", "x"])

    rows = sample.select("doc_id", "y", *COLUMNS).mapInArrow(run, "doc_id long, y int, x array<double>").collect()
    rows.sort(key=lambda r: r.doc_id)
    x = np.array([r.x for r in rows], dtype=float).reshape(-1, len(TEXT_FEATURES) + len(PAGE_FEATURES))
    return np.array([r.doc_id for r in rows], dtype=np.int64), np.array([r.y for r in rows], dtype=float), x[:, : len(TEXT_FEATURES)], x[:, len(TEXT_FEATURES) :]


SCALE = float(1 << 20)


def _spark_sums(pool: DataFrame):
    """Sums over a table of features ``x``, exact in multiples of 1 / SCALE."""

    def sums(f, width: int) -> np.ndarray:
        def run(batches):
            total = np.zeros(width)
            for batch in batches:
                x = batch.column(0).flatten().to_numpy().astype(float).reshape(-1, len(TEXT_FEATURES) + len(PAGE_FEATURES))
                total += f(x[:, : len(TEXT_FEATURES)], x[:, len(TEXT_FEATURES) :])
            fixed = np.round(total * SCALE).astype(np.int64)
            at = np.flatnonzero(fixed)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(fixed[at])], ["at", "v"])

        out = np.zeros(width)
        for r in pool.select("x").mapInArrow(run, "at int, v long").groupBy("at").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect():
            out[r.at] = float(r.v) / SCALE
        return out

    return sums


def _features(picked: DataFrame) -> DataFrame:
    """``(doc_id, x)``: the features of both views, one after the other."""

    def run(batches):
        for batch in batches:
            a, b = _views(batch)
            flat = np.hstack([a, b]).astype(np.float32)
            offsets = np.arange(len(flat) + 1, dtype=np.int32) * flat.shape[1]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.reshape(-1)))], ["doc_id", "x"])

    return picked.mapInArrow(run, "doc_id long, x array<float>")


def fit_model(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000) -> CoTrained:
    picked = _picked(docs)
    sample = labelled_sample(picked, labels, "quality", max_rows, columns=COLUMNS)
    ids, y, xa, xb = _collect(sample)
    known = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    pool = stage(_features(picked.where(~held_out(F.col("doc_id")))).join(known, "doc_id", "left_anti").select("x"), "pool")
    calibrate = np.array([zlib.crc32(str(i).encode()) % 5 == 1 for i in ids], dtype=bool)
    model = co_train(xa, xb, y, _spark_sums(pool), calibrate)
    drop_staged(sample)
    drop_staged(pool)
    return model


def score(docs: DataFrame, model: CoTrained) -> DataFrame:
    """``docs`` with ``p_text``, ``p_page`` and ``quality_score``; needs text, n_chars, lang, source."""

    def run(batches):
        for batch in batches:
            a, b = _views(batch)
            p = model.probabilities(a, b)
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, p)], [*batch.schema.names, "p_text", "p_page", "quality_score"])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, *(StructField(n, DoubleType()) for n in ("p_text", "p_page", "quality_score"))]))


def without_poor(docs: DataFrame, model: CoTrained, least: float = 0.5) -> DataFrame:
    """``docs`` without the rows that score under ``least``; all columns, whatever their names."""

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(model.probabilities(*_views(batch))[2] >= least))

    return docs.mapInArrow(run, docs.schema)


def quality(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000) -> DataFrame:
    """``(doc_id, held_out, p_text, p_page, score, keep)``, one row per row of ``docs``."""
    found = score(_picked(docs), fit_model(docs, labels, max_rows))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "p_text", "p_page", F.col("quality_score").alias("score"), (F.col("quality_score") >= 0.5).alias("keep"))
