"""Figure extraction and comparison for text audits."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkbook.operators.common import col

# The audit patterns and word lists.
# A number-like token: optional currency symbol, grouped digits, decimals, a
# compact M/K suffix and a percent sign, never inside an identifier.
NUMERIC_TOKEN = (r"(?<![A-Za-z0-9_])(?:£|€|\$)?\d[\d,]*(?:\.\d+)?(?:\s?[MmKk]\b)?%?(?![A-Za-z0-9_])")
# A quantity word in front of a figure.
HEDGE = r"(?i)\b(?:roughly|approximately|about|nearly|almost|around|circa|some)\s+(?:£|€|\$)?\d"
BANNED_CHARS = ["—"]
IMPERATIVE_OPENERS = ["feed ", "review ", "set ", "agree ", "implement ", "adjust ", "investigate ",
                      "put ", "start ", "use ", "turn ", "move ", "check ", "give ", "run ", "make "]


def numeric_tokens(text) -> Column:
    """Array of number-like tokens in text order (NULL text -> empty)."""
    return F.coalesce(F.regexp_extract_all(col(text), F.lit(NUMERIC_TOKEN), 0), F.array().cast("array<string>"))


#: A figure without symbols and separators: digits, decimals up to their
#: trailing zeros, thousands or millions, per cent.
_FIGURE = r"^(\d*)(?:\.(\d*?)0*)?([mk]?)(%?)%*$"


def canonical_figure(token) -> Column:
    """Comparable form of a figure: its digits, its decimals without trailing
    zeros, and its k, m or per cent sign."""
    bare = F.regexp_replace(F.lower(col(token)), "[, £€$]", "")
    whole, decimals, size, cent = (F.regexp_extract(bare, _FIGURE, g) for g in (1, 2, 3, 4))
    dot = F.when(decimals != "", F.concat(F.lit("."), decimals)).otherwise(F.lit(""))
    return F.when(bare.rlike(_FIGURE), F.concat(whole, dot, size, cent)).otherwise(bare)


def hedged(text) -> Column:
    return F.coalesce(col(text).rlike(HEDGE), F.lit(False))


def banned(text) -> Column:
    cond = F.lit(False)
    for ch in BANNED_CHARS:
        cond = cond | F.coalesce(col(text).contains(ch), F.lit(False))
    return cond


def imperative_opener(text) -> Column:
    body = F.lower(F.regexp_replace(F.coalesce(col(text), F.lit("")), r"^\s+|\s+$", ""))
    pattern = "^(?:" + "|".join(o.strip() for o in IMPERATIVE_OPENERS) + ") "
    return body.rlike(pattern)


def word_count(text) -> Column:
    return F.size(F.regexp_extract_all(F.coalesce(col(text), F.lit("")), F.lit(r"\S+"), 0))


def char_count(text) -> Column:
    return F.length(F.regexp_replace(F.coalesce(col(text), F.lit("")), r"^\s+|\s+$", ""))
