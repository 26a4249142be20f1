"""Case folds, tokens and query cleaning. Three folds live side by side and must not be mixed up:

* ``nocase``: A-Z only, for name lookups in the graph,
* ``unicode_fold``: full lower case, for walk scores and communities,
* ``term_fold``: lower case plus single accents removed, for full-text terms.
"""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()

# Words that never seed a graph search.
STOP_WORDS = (
    "là và của có cho với được này đó các một những trong để từ theo về hay hoặc nhưng mà nếu khi thì đã sẽ đang rồi "
    "nào gì thế sao tại vì bị do qua lại như hơn nhất rất quá cũng vẫn còn chỉ tôi anh em bạn mình chúng họ ai "
    "the is are was were what who how why"
).split()


def nocase(col: Column | str) -> Column:
    return F.translate(col, UPPER, LOWER)


def unicode_fold(col: Column | str) -> Column:
    return F.lower(col)


@cache
def accent_table() -> tuple[str, str]:
    """Precomposed lower-case letters with exactly one mark, and their base letters."""
    pairs = []
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        letter = chr(code).lower()
        parts = unicodedata.normalize("NFD", letter)
        if len(letter) == 1 and len(parts) == 2 and unicodedata.combining(parts[1]) and parts[0].isalpha():
            pairs.append((letter, parts[0]))
    pairs = sorted(set(pairs))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def term_fold(col: Column | str) -> Column:
    """Lower case; letters with one mark lose it, letters with two keep both."""
    return F.translate(F.lower(col), *accent_table())


def terms(col: Column | str) -> Column:
    """Full-text terms in order: folded runs of letters and digits ("_" separates)."""
    return F.regexp_extract_all(term_fold(F.coalesce(col, F.lit("")) if isinstance(col, Column) else F.coalesce(F.col(col), F.lit(""))), F.lit(r"[\p{L}\p{N}\p{Co}]+"), F.lit(0))


def seed_words(col: Column) -> Column:
    """Words of a query that may seed a graph search: no stop words, two characters at least."""
    words = F.regexp_extract_all(F.lower(col), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    stop = F.array(*map(F.lit, STOP_WORDS))
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) >= 2) & ~F.array_contains(stop, w)))


def whole_word(name: Column, word: str) -> Column:
    """``word`` in ``name`` without a letter, digit or "_" on either side, in any case."""
    quoted = word.replace("\\E", "\\E\\\\E\\Q")
    return name.rlike(rf"(?iu)(?<![\p{{L}}\p{{N}}_])\Q{quoted}\E(?![\p{{L}}\p{{N}}_])")


def clean_query(text: str, entity_mode: bool = False) -> str:
    """Search operators (entity mode) or everything but words and blanks (plain mode) become blanks."""
    import re

    return re.sub(r'[&|*"^()]', " ", text).strip() if entity_mode else re.sub(r"[^\w\s]", " ", text).strip()


def csv_list(col: Column | str) -> Column:
    """"a, b ,, c" -> [a, b, c]."""
    return F.filter(F.transform(F.split(col, ","), lambda x: F.trim(x)), lambda x: x != "")


def joined_list(col: Column | str) -> Column:
    """Names joined by "|||" -> array without blanks."""
    return F.filter(F.split(col, r"\|\|\|"), lambda x: x != "")
