"""Hand-computed frames for the analytic edge cases."""
import datetime as dt

from pyspark.sql import functions as F

from inkbook.config import Config
from inkbook.operators import churn, delivery, pricing, quote, reorder, repeat, season, value
from inkbook.operators.derive import derive
from tests.frames import d, derived, jobs_frame, rows

#: The tests fit fewer rounds than the library's default of 400.
SHORT_FIT = Config(gbt_max_iter=30, gbt_step_size=0.2)


def test_null_keys_are_dropped_and_unknown_currency_converts_at_one(spark):
    jd = derived(spark, [
        dict(customer_id="A", customer_name="A", work_type=None, currency="USD", sell_price=100.0),
        dict(customer_id="A", customer_name="A", work_type="Litho", currency="Euro", sell_price=100.0),
        dict(customer_id=None, customer_name="X", work_type="Litho"),
    ])
    wt = rows(value.work_type_breakdown(jd))
    assert [r["work_type"] for r in wt] == ["Litho"]
    fx = {r["currency"]: r["fx_rate"] for r in jd.select("currency", "fx_rate").distinct().collect()}
    assert fx["USD"] == 1.0 and fx["Euro"] == 0.86 and fx["Stg"] == 1.0
    cust = rows(value.customer_value(jd))
    assert [r["customer_id"] for r in cust] == ["A"]


def test_churn_relative_and_absolute(spark):
    jd = derived(spark, [
        dict(customer_id="A", customer_name="A", sales_in=d("2024-01-01")),
        dict(customer_id="A", customer_name="A", sales_in=d("2024-01-11")),
        dict(customer_id="A", customer_name="A", sales_in=d("2024-01-21")),
        dict(customer_id="A", customer_name="A", sales_in=d("2024-01-21")),
        dict(customer_id="B", customer_name="B", sales_in=d("2024-02-10")),
        dict(customer_id="B", customer_name="B", sales_in=d("2024-02-10")),
        dict(customer_id="C", customer_name="C", sales_in=d("2023-06-01")),
        dict(customer_id="C", customer_name="C", sales_in=d("2023-07-01")),
    ])
    st = {r["customer_id"]: r for r in rows(churn.churn_status(jd))}
    assert st["A"]["order_count"] == 3 and st["A"]["basis"] == "relative"
    assert st["A"]["avg_interval_days"] == 10.0 and st["A"]["days_since_last_order"] == 20
    assert st["A"]["status"] == "At Risk"  # 20 / 10 = 2.0
    assert st["B"]["status"] == "Active" and st["B"]["basis"] == "absolute"
    assert st["C"]["days_since_last_order"] == 224 and st["C"]["status"] == "At Risk"
    s = rows(churn.churn_summary(churn.churn_status(jd)))[0]
    assert (s["active"], s["at_risk"], s["dormant"]) == (1, 2, 0)


def test_churn_is_invariant_to_shifting_all_dates(spark):
    base = [dict(customer_id=c, customer_name=c, sales_in=d(x)) for c, x in
            [("A", "2024-01-01"), ("A", "2024-03-01"), ("A", "2024-05-01"), ("B", "2023-01-01"),
             ("C", "2024-04-01"), ("C", "2024-06-01")]]
    shifted = [{**r, "sales_in": r["sales_in"] + dt.timedelta(days=400)} for r in base]
    a = [(r["customer_id"], r["status"]) for r in rows(churn.churn_status(derived(spark, base)), "customer_id")]
    b = [(r["customer_id"], r["status"]) for r in rows(churn.churn_status(derived(spark, shifted)), "customer_id")]
    assert a == b


def test_reorder_next_date_rounds_half_even(spark):
    jd = derived(spark, [
        dict(customer_id="A", customer_name="A", sales_in=d("2024-01-01")),
        dict(customer_id="A", customer_name="A", sales_in=d("2024-01-04")),
        dict(customer_id="A", customer_name="A", sales_in=d("2024-01-06")),   # mean gap 2.5 -> 2
        dict(customer_id="B", customer_name="B", sales_in=d("2024-01-01")),
        dict(customer_id="B", customer_name="B", sales_in=d("2024-01-04")),
        dict(customer_id="B", customer_name="B", sales_in=d("2024-01-08")),   # mean gap 3.5 -> 4
        dict(customer_id="C", customer_name="C", sales_in=d("2024-01-08")),
    ])
    f = {r["customer_id"]: r for r in rows(reorder.reorder_forecast(jd))}
    assert f["A"]["predicted_next_order_date"] == d("2024-01-08")
    assert f["B"]["predicted_next_order_date"] == d("2024-01-12")
    assert f["C"]["status"] == "Insufficient history" and f["C"]["predicted_next_order_date"] is None


def test_reprint_edges(spark):
    same_day = [dict(customer_id="A", customer_name="A", job_id="X", sales_in=d("2023-01-01"))] * 2
    start = d("2022-01-01")
    cycle_299 = [dict(customer_id="A", customer_name="A", job_id="Y", sales_in=start + dt.timedelta(days=k))
                 for k in (0, 30, 60, 90, 120, 150, 180, 210, 240, 270, 299)]   # 10 gaps over 299 days
    cycle_30 = [dict(customer_id="A", customer_name="A", job_id="Z", sales_in=start + dt.timedelta(days=k))
                for k in (0, 30)]
    late = [dict(customer_id="B", customer_name="B", job_id="W", sales_in=d("2024-01-01"))]
    jd = derived(spark, same_day + cycle_299 + cycle_30 + late)
    rep = {r["job_id"]: r for r in rows(repeat.repeat_titles(jd))}
    assert rep["X"]["avg_cycle_days"] == 0.0 and rep["X"]["cycles_overdue"] is None
    assert rep["Y"]["avg_cycle_days"] == 29.9 and rep["Z"]["avg_cycle_days"] == 30.0
    due = {r["job_id"] for r in rows(repeat.due_for_reprint(jd))}
    assert due == {"Z"}
    s = rows(repeat.repeat_summary(jd))[0]
    assert s["repeat_titles"] + s["one_off_titles"] == s["distinct_titles"] == 4


def _values_frame(spark, vals):
    return derived(spark, [dict(customer_id=f"C{i:02d}", customer_name=f"N{i:02d}", va_amount=v)
                           for i, v in enumerate(vals)])


def test_concentration_shape_closed_form(spark):
    bc = value.by_customer(_values_frame(spark, [100, 95, 50, 48, 47, 10]))
    s = rows(value.concentration_shape(bc))[0]
    assert (s["leading_count"], s["tied_count"], s["ahead_count"]) == (5, 2, 5)
    assert s["break_drop_pct"] == 78.7 and s["flattens_at_rank"] == 3


def test_concentration_single_and_no_positive(spark):
    one = rows(value.concentration_shape(value.by_customer(_values_frame(spark, [100]))))[0]
    assert (one["leading_count"], one["tied_count"], one["ahead_count"], one["flattens_at_rank"]) == (1, 1, 1, None)
    neg = rows(value.concentration_shape(value.by_customer(_values_frame(spark, [-5, -10]))))[0]
    assert (neg["leading_count"], neg["tied_count"], neg["ahead_count"]) == (0, 0, 0)
    summ = rows(value.concentration_summary(value.by_customer(_values_frame(spark, [-5, -10]))))[0]
    assert summ["leading_count"] == 1


def test_pareto_and_shares(spark):
    bc = value.by_customer(_values_frame(spark, [50, 30, 10, 10]))
    p = rows(value.pareto_80(bc))[0]
    assert p["customers_for_80pct_value"] == 2 and p["pct_of_customers_for_80pct_value"] == 50.0
    top = rows(value.customer_value(_values_frame(spark, [50, 30, 10, 10])))
    assert round(sum(r["value_share_pct"] for r in top), 6) == 100.0


def _monthly(spark, values, start="2022-01-01"):
    s = d(start)
    out = []
    for i, v in enumerate(values):
        m = dt.date(s.year + (s.month - 1 + i) // 12, (s.month - 1 + i) % 12 + 1, 1)
        out.append(dict(sales_in=m, sell_price=v, press_hrs=1.0))
    return derived(spark, out)


def test_forecast_needs_fourteen_months_and_clips_growth(spark):
    assert season.seasonal_forecast(_monthly(spark, [100.0] * 13)).count() == 0
    f = rows(season.seasonal_forecast(_monthly(spark, [100.0] * 14)).filter(F.col("series") == "sales"), "step")
    assert [r["forecast"] for r in f] == [100.0] * 6
    # recent level 10x the year-ago window: growth clipped at 2.0
    g = rows(season.seasonal_forecast(_monthly(spark, [100.0] * 11 + [1000.0] * 3))
             .filter(F.col("series") == "sales"), "step")
    assert g[0]["forecast"] == 200.0


def test_month_grid_fills_gaps_and_index_averages_100(spark):
    jd = derived(spark, [dict(sales_in=d("2024-01-05"), sell_price=10.0),
                         dict(sales_in=d("2024-03-05"), sell_price=20.0)])
    m = rows(season.monthly_series(jd), "month_start")
    assert [r["sell_price"] for r in m] == [10.0, 0.0, 20.0]
    idx = rows(season.seasonal_index(jd).filter(F.col("series") == "sales"))
    assert abs(sum(r["seasonal_index"] for r in idx) / len(idx) - 100.0) < 0.2


def test_delivery_edges(spark):
    jd = derived(spark, [dict(product_type="P19", ship_date=d("2024-01-03"))] * 19
                 + [dict(product_type="P20", ship_date=d("2024-01-05"))] * 20
                 + [dict(product_type="X", ship_date=d("2023-01-01"))])   # negative lead: unmeasured
    prod = {r["product_type"] for r in rows(delivery.turnaround_by_product(jd))}
    assert prod == {"P20"}
    s = rows(delivery.turnaround_summary(jd))[0]
    assert s["jobs_measured"] == 39 and s["direction"] == "stable"
    none = derived(spark, [dict(ship_date=None)])
    assert delivery.turnaround_by_work_type(none).count() == 0


def test_pricing_uplift_only(spark):
    jd = derived(spark, [dict(manual_adjustment=5.0), dict(manual_adjustment=0.0)])
    assert pricing.discount_by_customer(jd).count() == 0
    s = rows(pricing.pricing_summary(jd))[0]
    assert s["discount_total"] == 0.0 and s["uplift_total"] == 5.0 and s["net_adjustment"] == 5.0
    assert s["top_discount_customer"] is None and s["top_discount_amount"] == 0.0


def test_discounts_plus_uplifts_equal_net(spark):
    jd = derived(spark, [dict(manual_adjustment=v, customer_name=f"c{i}") for i, v in
                         enumerate([-3.25, 1.5, -0.25, 0.0, 7.0])])
    s = rows(pricing.pricing_summary(jd))[0]
    assert round(s["uplift_total"] - s["discount_total"], 2) == s["net_adjustment"] == 5.0


def test_model_gate(spark):
    rows199 = [dict(row_key=f"r{i}", sell_price=10.0 + i) for i in range(199)]
    split = quote.holdout_split(quote.price_features(jobs_frame(spark, rows199).transform(derive)))
    model, reason = quote.train_price_model(split, SHORT_FIT)
    assert model is None and "Not enough" in reason


def test_by_report_isolation(spark):
    base = [dict(customer_id="A", customer_name="A", sales_in=d("2024-01-01")),
            dict(customer_id="A", customer_name="A", sales_in=d("2024-02-01")),
            dict(customer_id="A", customer_name="A", sales_in=d("2024-03-01")),
            dict(customer_id="B", customer_name="B", sales_in=d("2024-06-01"))]
    two = [{**r, "report_id": 1} for r in base] + \
          [{**r, "report_id": 2, "sales_in": r["sales_in"] + dt.timedelta(days=30)} for r in base[:3]]
    jd = derive(jobs_frame(spark, two, extra=("report_id",)), by=("report_id",))
    st = churn.churn_status(jd, by=("report_id",))
    one = rows(churn.churn_status(derived(spark, base)), "customer_id")
    r1 = rows(st.filter("report_id = 1").drop("report_id"), "customer_id")
    assert r1 == one
    r2 = rows(st.filter("report_id = 2"), "customer_id")
    assert [r["customer_id"] for r in r2] == ["A"] and r2[0]["status"] == "Active"


def test_results_do_not_depend_on_partitioning(spark):
    from inkbook.plans.queries import REGISTRY
    sf = "/root/testdata/sf0.001"
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    a = sorted(map(tuple, REGISTRY["customer_value"](spark, sf).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    b = sorted(map(tuple, REGISTRY["customer_value"](spark, sf).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert a == b


def test_boosted_model_beats_comparable_baseline(spark):
    from inkbook.plans.queries import REGISTRY
    sf = "/root/testdata/sf0.001"
    from inkbook.sources.fixtures import jobs_view
    split = quote.holdout_split(quote.price_features(derive(jobs_view(spark, sf))))
    model, _ = quote.train_price_model(split, SHORT_FIT)
    gbt = quote.benchmark_metrics(quote.model_predictions(model, split), split).first()
    base = REGISTRY["benchmark_metrics"](spark, sf).first()
    assert gbt.test_rows == base.test_rows > 0
    assert gbt.median_abs_pct_error < base.median_abs_pct_error
    assert gbt.r2_log > base.r2_log


def test_model_is_reproducible_with_a_seed(spark):
    from inkbook.sources.fixtures import jobs_view
    split = quote.holdout_split(quote.price_features(derive(jobs_view(spark, "/root/testdata/sf0.001"))))
    a, _ = quote.train_price_model(split, SHORT_FIT)
    b, _ = quote.train_price_model(split, SHORT_FIT)
    pa = sorted((r.row_key, round(r.expected_price, 6)) for r in quote.model_predictions(a, split).collect())
    pb = sorted((r.row_key, round(r.expected_price, 6)) for r in quote.model_predictions(b, split).collect())
    assert pa == pb


def test_dates_drop_time_of_day_and_accept_day_first(spark):
    from inkbook.sources import ingest
    df = spark.createDataFrame([("2024-01-05 13:45:00", "05/01/2024", "junk")],
                               "sales_in string, sales_out string, ship_date string")
    r = ingest.coerce_dates(df).first()
    assert r.sales_in == d("2024-01-05") and r.sales_out == d("2024-01-05") and r.ship_date is None


def test_canonical_label_ties_take_the_smallest_spelling(spark):
    jd = derived(spark, [dict(product_type="Price List"), dict(product_type="price list"),
                         dict(product_type="PRICE-LIST"), dict(product_type="PRICE-LIST"),
                         dict(product_type="Price List"), dict(product_type=None)])
    got = {r.product_type: r.product_type_clean for r in jd.select("product_type", "product_type_clean").collect()}
    # "PRICE-LIST" and "Price List" both appear twice: the smaller string wins
    assert got["price list"] == got["Price List"] == got["PRICE-LIST"] == "PRICE-LIST"
    assert got[None] == "Unspecified"


def test_lead_time_bounds(spark):
    jd = derived(spark, [dict(sales_in=d("2024-01-01"), ship_date=d("2024-01-01")),
                         dict(sales_in=d("2024-01-01"), ship_date=d("2024-06-29")),   # 180 days
                         dict(sales_in=d("2024-01-01"), ship_date=d("2024-06-30")),   # 181 days
                         dict(sales_in=d("2024-01-02"), ship_date=d("2024-01-01"))])  # negative
    got = sorted((r.lead_time_days is None, r.lead_time_days or 0) for r in jd.collect())
    assert got == [(False, 0), (False, 180), (True, 0), (True, 0)]


def test_dataset_summary_counts_without_expanding_rows(spark):
    rows = [dict(customer_id="A", product_type="Book", report_id=1), dict(customer_id="A", product_type="book", report_id=1),
            dict(customer_id="B", product_type=None, currency="USD", report_id=1),
            dict(customer_id="C", product_type="Card", report_id=2), dict(customer_id="C", report_id=None)]
    jd = derived(spark, rows, extra=("report_id",))
    got = {r.report_id: r for r in value.dataset_summary(jd, ["report_id"]).collect()}
    assert set(got) == {1, 2}
    r = got[1]
    assert (r.row_count, r.customer_count, r.raw_product_types, r.unmapped_currency_jobs) == (3, 2, 2, 1)
    assert (r.total_sell_price, r.avg_va_pct, got[2].customer_count) == (300.0, 40.0, 1)
    none = value.dataset_summary(jd.limit(0)).first()
    assert (none.row_count, none.customer_count, none.raw_product_types, none.total_sell_price) == (0, 0, 0, None)
    plan = value.dataset_summary(jd)._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan


def test_comparable_work_needs_enough_priced_jobs(spark):
    rows = [dict(row_key=f"r{i}", sell_price=10.0 + i) for i in range(200)]
    for n, any_rows in ((199, False), (200, True)):
        split = quote.holdout_split(quote.price_features(derived(spark, rows[:n])))
        scored = quote.comparable_baseline(split)
        assert bool(scored.count()) == any_rows
        s = quote.underpriced_summary(scored).first()
        assert any_rows or (s.flagged_count, s.flagged_share_pct, s.value_gap) == (0, 0.0, 0.0)


def test_reorder_labels(spark):
    f = spark.sql("""SELECT * FROM VALUES
        ('A', 'A', 5L, 30.0D, 'Regular', DATE'2024-01-01', DATE'2024-02-01', 0L, 'Due soon'),
        ('B', 'B', 5L, 30.5D, 'Variable', DATE'2024-01-01', DATE'2024-02-01', -3L, 'Overdue'),
        ('C', 'C', 1L, NULL, 'Insufficient history', DATE'2024-01-01', NULL, NULL, 'Insufficient history')
        AS t(customer_id, customer_name, order_count, avg_interval_days, regularity, last_order_date,
             predicted_next_order_date, days_until_predicted, status)""")
    got = {r.customer_id: (r.cadence, r.expected) for r in reorder.reorder_labels(f).collect()}
    assert got == {"A": ("30d (Regular)", "2024-02-01 (in 0d)"), "B": ("30.5d (Variable)", "2024-02-01 (3d ago)"),
                   "C": ("n/a", "n/a")}
