"""Figure formatting as column expressions (F1–F3). Values are rounded
half-even first, so the printed digits never depend on a printf tie rule."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkbook.config import DEFAULT
from inkbook.operators.common import col, rnd

def _na():
    return F.lit("n/a")


def fmt_money(c, symbol: str = DEFAULT.base_currency_symbol) -> Column:
    """Compact money: 1.2M, 759k, 1,234; NULL -> n/a."""
    v = col(c).cast("double")
    a = F.abs(v)
    sign = F.when(v < 0, "-").otherwise("")
    body = (F.when(a >= 1_000_000, F.concat(F.format_string("%.1f", rnd(a / 1_000_000, 1)), F.lit("M")))
            .when(a >= 1_000, F.concat(F.format_string("%.0f", rnd(a / 1_000, 0)), F.lit("k")))
            .otherwise(F.format_number(rnd(a, 0), 0)))
    return F.when(v.isNull(), _na()).otherwise(F.concat(sign, F.lit(symbol), body))


def fmt_money_exact(c, symbol: str = DEFAULT.base_currency_symbol) -> Column:
    v = col(c).cast("double")
    return F.when(v.isNull(), _na()).otherwise(F.concat(F.lit(symbol), F.format_number(rnd(F.abs(v), 0), 0)))


def fmt_pct(c, digits: int = 1) -> Column:
    v = col(c).cast("double")
    return F.when(v.isNull(), _na()).otherwise(F.concat(F.format_string(f"%.{digits}f", rnd(v, digits)), F.lit("%")))


def fmt_count(c) -> Column:
    v = col(c)
    return F.when(v.isNull(), _na()).otherwise(F.format_number(v.cast("bigint"), 0))


def fmt_days(c) -> Column:
    """Days as 'in Nd' / 'Nd ago' / 'today' (reorder table labels)."""
    v = col(c).cast("bigint")
    return (F.when(v.isNull(), _na()).when(v > 0, F.concat(F.lit("in "), v.cast("string"), F.lit("d")))
            .when(v < 0, F.concat((-v).cast("string"), F.lit("d ago"))).otherwise(F.lit("today")))


def cadence_label(days, regularity) -> Column:
    """Mean gap with its regularity: '30.5d (Regular)'; NULL -> n/a."""
    v = col(days).cast("double")
    number = F.when(v == F.floor(v), v.cast("bigint").cast("string")).otherwise(v.cast("string"))
    return F.when(v.isNull(), _na()).otherwise(F.concat(number, F.lit("d ("), col(regularity), F.lit(")")))


def expected_label(date, days) -> Column:
    """Expected order date with its distance: '2024-05-01 (in 5d)', '... (3d
    ago)'; NULL -> n/a."""
    d, n = col(date), col(days).cast("bigint")
    away = F.when(n >= 0, F.concat(F.lit("in "), n.cast("string"), F.lit("d"))) \
        .otherwise(F.concat((-n).cast("string"), F.lit("d ago")))
    return F.when(d.isNull(), _na()).when(n.isNull(), d.cast("string")) \
        .otherwise(F.concat(d.cast("string"), F.lit(" ("), away, F.lit(")")))


def plural(n, singular: str, plural_form: str | None = None) -> Column:
    return F.when(col(n) == 1, F.lit(singular)).otherwise(F.lit(plural_form or f"{singular}s"))


def name_list(arr) -> Column:
    """["a"] -> "a"; ["a","b"] -> "a and b"; ["a","b","c"] -> "a, b and c"."""
    a = F.filter(col(arr), lambda x: x.isNotNull() & (x != ""))
    n = F.size(a)
    return (F.when(n == 0, F.lit("the leading account"))
            .when(n == 1, F.element_at(a, 1))
            .otherwise(F.concat(F.array_join(F.slice(a, 1, n - 1), ", "), F.lit(" and "), F.element_at(a, -1))))


# Small numbers as words and ordinals.
WORDS = ["One", "Two", "Three", "Four", "Five", "Six", "Seven", "Eight", "Nine", "Ten"]
ORDINALS = ["first", "second", "third", "fourth", "fifth", "sixth", "seventh", "eighth", "ninth", "tenth"]


def number_word(n) -> Column:
    v = col(n).cast("int")
    return F.when(v.between(1, 10), F.element_at(F.array(*map(F.lit, WORDS)), v)).otherwise(v.cast("string"))


def ordinal(n) -> Column:
    v = col(n).cast("int")
    return (F.when(v.isNull(), F.lit("next"))
            .when(v.between(1, 10), F.element_at(F.array(*map(F.lit, ORDINALS)), v))
            .otherwise(F.concat(v.cast("string"), F.lit("th"))))
