"""Computed briefs: rows, documents and JSON, and the audit on them."""
import tempfile

from inkbook.operators import briefs, textaudit as ta
from inkbook.sources import library

METRICS = "report_id bigint, area string, ordinal bigint, label string, value_text string, sublabel string"
TABLE = "report_id bigint, area string, ordinal bigint, category string, value_text string, share_text string"


def _rows(spark):
    m = [(r, a, i, f"L{i}", f"{10 * i + r}%", f"of {i} accounts") for r in (1, 2) for a in ("churn", "reorder") for i in (1, 2, 3)]
    t = [(r, a, i, f"row {i}", f"{100 + i}", f"{i}%") for r in (1, 2) for a in ("churn", "reorder") for i in (0, 1)]
    t += [(1, "delivery", None, c, "5 days", "9 days") for c in ("web", "litho")]
    return briefs.computed_rows(spark.createDataFrame(m, METRICS), spark.createDataFrame(t, TABLE))


def _set(df):
    return sorted((tuple(r) for r in df.select("report_id", "area", "section", "ordinal", "field", "text").collect()), key=repr)


def test_rows_documents_and_json_round_trip(spark):
    rows = _rows(spark)
    docs = briefs.nest(rows)
    d = docs.filter("report_id = 1 and area = 'delivery'").first()
    assert [x.category for x in d.breakdown.rows] == ["litho", "web"] and d.metrics == [] and d.title is None
    assert docs.filter("report_id = 2 and area = 'churn'").first().hero.value == "12%"
    root = tempfile.mkdtemp(dir="/tmp")
    library.write_payload({"briefs": briefs.to_json(docs)}, root)
    back = briefs.from_json(library.read_payload(spark, root, 2, ["briefs"])["briefs"])
    assert _set(briefs.unnest(back)) == _set(rows.filter("report_id = 2"))


def test_supplied_brief_round_trip(spark):
    """Every field of a whole brief, the empty ones left out."""
    brief = {"title": "T", "metrics": [{"label": "a", "value": "1"}, {"label": "b", "value": "2", "sublabel": "s"}],
             "hero": {"value": "9%", "caption": "c", "body": "text"},
             "breakdown": {"title": "B", "columns": ["x", "y"], "rows": [{"category": "k", "description": "d e f",
                                                                         "value": "7", "share": "1%"}]},
             "actions": {"title": "A", "items": [{"title": "i", "badge": "b", "tone": "t", "body": "do"}]}}
    rows = spark.createDataFrame(ta.brief_to_rows(brief, 3, "pricing"), ta.BRIEF_SCHEMA)
    assert _set(briefs.unnest(briefs.from_json(briefs.to_json(briefs.nest(rows))))) == _set(rows)
    assert briefs.nest(rows.limit(0)).count() == 0


def test_audit_and_merge_on_computed_rows(spark):
    """A generated brief with a wrong figure is rejected, and set right."""
    computed = _rows(spark).filter("report_id = 1 and area = 'churn'")
    good = "The share of quiet accounts has reached 11% of the book. " * 4
    made = [(1, "churn", "hero", None, "value", "99%"), (1, "churn", "hero", None, "caption", "of accounts are quiet"),
            (1, "churn", "metrics", 1, "value", "12%")]
    generated = spark.createDataFrame([*made, (1, "churn", "hero", None, "body", good)], ta.BRIEF_SCHEMA)
    wrong = spark.createDataFrame([*made, (1, "churn", "hero", None, "body", good.replace("11%", "57%"))], ta.BRIEF_SCHEMA)
    assert ta.brief_verdict(generated, computed).first().accepted
    bad = ta.brief_verdict(wrong, computed).first()
    assert not bad.accepted and any("57%" in p for p in bad.problems)
    merged = {(r.section, r.ordinal, r.field): r.text for r in ta.authoritative_merge(generated, computed).collect()}
    assert merged["hero", None, "value"] == "11%" and merged["metrics", 1, "value"] == "21%"


def test_briefs_computed_from_jobs(spark):
    """From job rows to an audited document: figures, sublabels, verdict."""
    import datetime as dt

    from inkbook.operators import findings
    from tests.frames import d, derived
    jobs = derived(spark, [dict(report_id=1, customer_id=c, customer_name=c, job_id=f"t{i % 3}", sell_price=50.0 + i,
                                va_amount=20.0 + i, sales_in=d("2023-01-10") + dt.timedelta(days=40 * i),
                                ship_date=d("2023-01-20") + dt.timedelta(days=40 * i)) for i in range(12) for c in "AB"],
                   extra=("report_id",), by=("report_id",)).persist()
    by = ("report_id",)
    marts = findings.area_marts(jobs, by)
    metrics = findings.brief_metrics(jobs, by, marts=marts, with_sublabel=True)
    rows = briefs.computed_rows(metrics.filter("area != 'quote_guard'"), findings.brief_breakdown(jobs, by, marts=marts)
                                .filter("area != 'quote_guard'")).persist()
    got = {(r.area, r.section, r.ordinal, r.field): r.text for r in rows.collect()}
    assert got["overview", "metrics", 2, "sublabel"] == "With 24 jobs" and got["overview", "metrics", 2, "value"] == "2"
    assert got["customer_value", "breakdown", 0, "category"] == "Litho"
    assert got["churn", "hero", None, "value"] == got["churn", "metrics", 0, "value"]
    assert _set(briefs.unnest(briefs.from_json(briefs.to_json(briefs.nest(rows))))) == _set(rows)
    jobs.unpersist(), rows.unpersist()
