"""Vector measures (built-in expressions) and string similarity (Arrow, for what SQL can't say)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

ZERO = 0.0


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(ZERO), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    """0 for empty vectors, lengths that differ and zero norms."""
    norm = F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0) & (norm > 0), _dot(a, b) / norm).otherwise(ZERO)


def unit(a: Column) -> Column:
    """The vector at length 1; null without a direction."""
    norm = F.sqrt(_dot(a, a))
    return F.transform(F.array(norm), lambda n: F.when(n > 0, F.transform(a, lambda x: x.cast("double") / n)))[0]


def unit_cosine(a: Column, b: Column) -> Column:
    """``cosine`` of vectors that are at length 1 already; 0 for nulls and lengths that differ."""
    return F.when(F.size(a) == F.size(b), _dot(a, b)).otherwise(ZERO)


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(ZERO), lambda s, v: s + v))


def distance_score(distance: Column) -> Column:
    """Distance in [0, 2] -> similarity in [0, 1]."""
    return F.greatest(F.lit(ZERO), 1 - distance / 2)


def length_ratio(a: Column, b: Column) -> Column:
    """Shorter through longer trimmed length; 0 if one is blank."""
    x, y = F.length(F.trim(a)), F.length(F.trim(b))
    return F.when((x > 0) & (y > 0), F.least(x, y) / F.greatest(x, y)).otherwise(ZERO)


def jaro(a: str | None, b: str | None) -> float:
    """Trimmed and lower-cased; half the transpositions count, without rounding down."""
    a, b = (a or "").strip().lower(), (b or "").strip().lower()
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    free, common = [True] * len(b), []
    for i, ch in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if free[j] and b[j] == ch:
                free[j] = False
                common.append(ch)
                break
    if not common:
        return 0.0
    m = len(common)
    moved = sum(x != y for x, y in zip(common, (b[j] for j in range(len(b)) if not free[j]), strict=True)) / 2
    return (m / len(a) + m / len(b) + (m - moved) / m) / 3


def jaro_winkler(a: str | None, b: str | None, prefix_weight: float = 0.1) -> float:
    """Jaro plus a bonus for up to four equal first characters, whatever the Jaro value is."""
    base = jaro(a, b)
    x, y = (a or "").strip().lower(), (b or "").strip().lower()
    same = 0
    for p, q in zip(x[:4], y[:4], strict=False):
        if p != q:
            break
        same += 1
    return base + same * prefix_weight * (1 - base)


@F.pandas_udf(DoubleType())
def jaro_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([jaro(x, y) for x, y in zip(a, b, strict=True)])


@F.pandas_udf(DoubleType())
def jaro_winkler_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([jaro_winkler(x, y) for x, y in zip(a, b, strict=True)])


def fake_embedding(text: Column | str, dim: int = 128) -> Column:
    """Deterministic vector of a text: hex digits of its SHA-256, repeated, mapped to [-1, 1)."""
    digest = F.sha2(text, 256)
    digit = lambda i: F.conv(F.substring(digest, i % 64 + 1, F.lit(1)), 16, 10).cast("double")
    return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: (digit(i) - 8) / 8)
