"""What large tables cost, read off plans: lineitem is scanned once where one
aggregate serves, and moved no more often than its joins ask for."""
import pytest

SF = "/root/testdata/sf0.001"


def _plan(df) -> list[str]:
    return df._jdf.queryExecution().executedPlan().toString().splitlines()


def _depth(line: str) -> int:
    return len(line) - len(line.lstrip(" :+-"))


@pytest.mark.parametrize("key", ["monthly_series", "seasonal_index", "seasonal_forecast", "forecast_backtest"])
def test_monthly_figures_scan_lineitem_once(spark, key):
    from inkbook.plans.queries import REGISTRY
    scans = [x for x in _plan(REGISTRY[key](spark, SF)) if "FileScan parquet" in x and "l_orderkey" in x]
    assert len(scans) == 1


def test_orders_meet_customers_before_lineitem(spark):
    from inkbook.sources.fixtures import jobs_view
    key = "spark.sql.autoBroadcastJoinThreshold"
    old = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        lines = _plan(jobs_view(spark, SF).select("customer_name", "sell_price"))
    finally:
        spark.conf.set(key, old)
    moved = [i for i, x in enumerate(lines) if "Exchange hashpartitioning(o_custkey" in x]
    assert moved
    for i in moved:
        below = []
        for x in lines[i + 1:]:
            if _depth(x) <= _depth(lines[i]):
                break
            below.append(x)
        assert not any("l_orderkey" in x for x in below)


def test_shared_marts_are_kept(spark):
    from inkbook.operators import findings
    from inkbook.plans.queries import finding_jobs
    kept = []

    def keep(df):
        kept.append(df)
        return df
    findings.area_marts(finding_jobs(spark, SF), keep=keep)
    assert any("expected_price" in x.columns for x in kept)


def test_customer_totals_are_kept(spark):
    from inkbook.operators import findings
    from inkbook.plans.queries import finding_jobs
    kept = []
    findings.area_marts(finding_jobs(spark, SF), keep=lambda df: kept.append(df) or df)
    assert any("total_va_amount" in x.columns for x in kept)


@pytest.mark.parametrize("key", ["at_stake", "executive_findings", "brief_metrics", "brief_breakdown"])
def test_findings_never_move_jobs_by_label(spark, key):
    """Labels are made canonical where they come from, on the parts."""
    from inkbook.plans.queries import REGISTRY
    spark.catalog.clearCache()
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        lines = _plan(REGISTRY[key](spark, SF))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    moved = [i for i, x in enumerate(lines) if "Exchange hashpartitioning(_lk" in x]
    assert moved
    for i in moved:
        assert "l_extendedprice" not in lines[i + 1] + lines[i + 2]
        below = []
        for x in lines[i + 1:]:
            if _depth(x) <= _depth(lines[i]):
                break
            below.append(x)
        assert not any("FileScan" in x and "l_extendedprice" in x for x in below)


def test_job_rows_are_the_jobs(spark, tmp_path):
    """With keys that repeat or are null, and spellings that tie."""
    import datetime as dt
    import random

    from inkbook.operators import quote
    from inkbook.operators.derive import derive
    from inkbook.sources.fixtures import SCHEMAS, as_jobs, job_rows, jobs_view
    rng = random.Random(7)
    day = dt.datetime(2024, 1, 1)

    def some(values):
        return rng.choice([*values, None])
    rows = {
        "region": [(0, "EUROPE"), (1, "AMERICA")],
        "nation": [(0, "A", 0), (1, "B", 1), (2, "C", None)],
        "customer": [(k, some(["x", "y"]), some([0, 1, 2]), 1.0, some(["S"])) for k in (1, 2, 2, 3, None)],
        "supplier": [(k, some(["s"]), 0, 1.0) for k in (1, 2, 2, None)],
        "part": [(k, n, some(["b"]), some(["t", "u"]), some([3]), some([10.0])) for k, n in
                 ((1, "red pen"), (1, "Red Pen"), (2, "RED-PEN"), (3, None), (4, "unspecified"), (5, "ink"), (None, "ink"))],
        "orders": [(k, some([1, 2, 3]), "F", 1.0, some([day]), "1") for k in (1, 2, 2, 97, None, 5)],
        "lineitem": [(some([1, 2, 97, 5]), some([1, 2, 3, 4, 5]), some([1, 2, 3]), some(range(1, 8)), some([2.0, 5.0]),
                      some([90.0, 100.0]), some([0.0, 0.1]), 0.02, "A", "F", some([day + dt.timedelta(9)])) for _ in range(400)],
    }
    for name, data in rows.items():
        spark.createDataFrame(data, SCHEMAS[name]).write.parquet(f"{tmp_path}/{name}.parquet")
    want = quote.holdout_split(derive(jobs_view(spark, str(tmp_path))))
    got = derive(as_jobs(job_rows(spark, str(tmp_path), quote.holdout_split)))
    assert set(got.columns) == set(want.columns)
    cols = sorted(want.columns)
    assert sorted(map(repr, got.select(*cols).collect())) == sorted(map(repr, want.select(*cols).collect()))
    assert got.count() > 100


def test_briefs_move_no_cells_of_customer_and_label(spark):
    from inkbook.plans.queries import REGISTRY
    spark.catalog.clearCache()
    lines = _plan(REGISTRY["brief_metrics"](spark, SF))
    assert not any("Exchange hashpartitioning(customer_id" in x and "product_type" in x for x in lines)


def test_summary_of_jobs_at_hand_is_the_same(spark):
    from inkbook.operators import value
    from tests.frames import derived
    rows = [dict(customer_id=c, product_type=p, va_pct=v, report_id=r) for c, p, v, r in
            [("A", "Book", 0.1, 1), ("A", "book", 0.2, 1), ("B", None, 0.3, 1), ("C", "Card", 0.4, 2), (None, "Card", 0.5, 2),
             ("C", "Card", 0.6, None)]]
    jd = derived(spark, rows, extra=("report_id",))
    for by in ((), ("report_id",)):
        for jobs in (jd, jd.limit(0)):
            a, b = (sorted(map(repr, value.dataset_summary(jobs, by, x).collect())) for x in (False, True))
            assert a == b
