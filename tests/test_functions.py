"""Figure formatting (F1–F3, X3), small library helpers and orderings."""
import copy

import pytest
from pyspark.sql import functions as F

from inkbook.functions import fmt
from inkbook.operators import reorder
from inkbook.operators import textaudit as ta
from inkbook.sources import library
from tests.frames import d, derived


def one(spark, col):
    return spark.range(1).select(col.alias("v")).first().v


@pytest.mark.parametrize("v,out", [(1_452_429.0, "£1.5M"), (-2_250_000.0, "-£2.2M"), (759_400.0, "£759k"),
                                   (999.4, "£999"), (12.0, "£12"), (None, "n/a"), (1234.0, "£1k")])
def test_fmt_money(spark, v, out):
    assert one(spark, fmt.fmt_money(F.lit(v).cast("double"))) == out


def test_fmt_exact_pct_count_days(spark):
    assert one(spark, fmt.fmt_money_exact(F.lit(-1452429.4))) == "£1,452,429"
    assert one(spark, fmt.fmt_pct(F.lit(22.25))) == "22.2%"
    assert one(spark, fmt.fmt_pct(F.lit(22.5), 0)) == "22%"
    assert one(spark, fmt.fmt_count(F.lit(12345))) == "12,345"
    assert one(spark, fmt.fmt_days(F.lit(5))) == "in 5d"
    assert one(spark, fmt.fmt_days(F.lit(-3))) == "3d ago"
    assert one(spark, fmt.fmt_days(F.lit(0))) == "today"


def test_names_words_ordinals(spark):
    assert one(spark, fmt.name_list(F.array(F.lit("a")))) == "a"
    assert one(spark, fmt.name_list(F.array(F.lit("a"), F.lit("b")))) == "a and b"
    assert one(spark, fmt.name_list(F.array(F.lit("a"), F.lit("b"), F.lit("c")))) == "a, b and c"
    assert one(spark, fmt.name_list(F.array().cast("array<string>"))) == "the leading account"
    assert one(spark, fmt.number_word(F.lit(3))) == "Three"
    assert one(spark, fmt.number_word(F.lit(12))) == "12"
    assert one(spark, fmt.ordinal(F.lit(2))) == "second"
    assert one(spark, fmt.ordinal(F.lit(11))) == "11th"
    assert one(spark, fmt.plural(F.lit(1), "account")) == "account"
    assert one(spark, fmt.plural(F.lit(2), "account")) == "accounts"


def test_report_count(spark):
    ev = spark.createDataFrame([(1, 0, None, "ready", *[None] * 8),
                                (2, 0, None, "deleted", *[None] * 8)], library.EVENT_SCHEMA)
    assert library.report_count(library.report_state(ev)).first().reports == 1


def test_brief_verdict(spark):
    brief = {"title": "T", "metrics": [], "hero": {"value": "22.5%", "caption": "of value in two accounts",
                                                    "body": "x" * 200},
             "breakdown": {"title": "B", "columns": [], "rows": []}, "actions": {"title": "A", "items": []}}
    bad = copy.deepcopy(brief)
    bad["hero"]["body"] = "Review this — " + "y" * 200
    comp = spark.createDataFrame(ta.brief_to_rows(brief, 1, "a"), ta.BRIEF_SCHEMA)
    gen = spark.createDataFrame(ta.brief_to_rows(brief, 1, "a") + ta.brief_to_rows(bad, 2, "a"), ta.BRIEF_SCHEMA)
    comp2 = comp.union(spark.createDataFrame(ta.brief_to_rows(brief, 2, "a"), ta.BRIEF_SCHEMA))
    v = {r.report_id: r for r in ta.brief_verdict(gen, comp2).collect()}
    assert v[1].accepted and not v[2].accepted
    assert any("banned" in p for p in v[2].problems) and any("instructions" in p for p in v[2].problems)


def test_reorder_presentation_order(spark):
    jd = derived(spark, [dict(customer_id=c, customer_name=c, sales_in=d(x)) for c, x in
                         [("A", "2024-01-01"), ("A", "2024-02-01"), ("A", "2024-03-01"),
                          ("B", "2024-01-01"), ("C", "2023-01-01"), ("C", "2023-06-01"), ("C", "2023-12-01")]])
    out = [r.customer_id for r in reorder.reorder_forecast(jd).orderBy(*reorder.reorder_order()).collect()]
    assert out == ["A", "C", "B"]   # due in 30 days, in 76 days, then insufficient history
