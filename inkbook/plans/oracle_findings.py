"""Oracle SQL: money at stake per area, ranked findings, brief metrics."""
from inkbook.plans.oracle import R, cte, q
from inkbook.plans.oracle_misc import money


def pct(x: str, d: int = 1) -> str:
    return f"CASE WHEN {x} IS NULL THEN 'n/a' ELSE printf('%.{d}f', {R(x, d)}) || '%' END"


def count(x: str) -> str:
    return f"CASE WHEN {x} IS NULL THEN 'n/a' ELSE format('{{:,}}', CAST({x} AS BIGINT)) END"


def days(x: str) -> str:
    return f"printf('%.0f', {R(x, 0)}) || ' days'"


cte("yrs", "SELECT greatest(date_diff('day', min(sales_in), max(sales_in)) / 365.25, 0.25) AS years FROM jd", "jd")
cte("ro_counts", """
SELECT count(*) FILTER (WHERE status = 'Overdue') AS overdue_count,
       count(*) FILTER (WHERE status = 'Due soon') AS due_soon_count FROM reorder""", "reorder")

cte("st_raw", f"""
SELECT 'customer_value' AS area,
       CAST((SELECT coalesce({R("sum(CAST(" + R('total_va_amount') + " AS DECIMAL(28,8)))")}, 0) FROM bc
             WHERE rank <= (SELECT leading_count FROM conc)) AS DOUBLE) AS raw,
       true AS per_year, 'Value added a year that depends on the largest accounts' AS basis
UNION ALL SELECT 'pricing', (SELECT abs(below_cost_va) + discount_total FROM q_pricing_summary), true,
       'Discounts a year and the loss on jobs below cost'
UNION ALL SELECT 'repeat_business', (SELECT reprint_pipeline_value FROM q_repeat_summary), false,
       'Value of reprints past their usual interval'
UNION ALL SELECT 'churn', (SELECT dormant_lifetime_value_at_stake FROM q_churn_summary), true,
       'Value added a year lost with dormant accounts'
UNION ALL SELECT 'reorder', CAST((SELECT coalesce(sum(CAST(predicted_next_order_value AS DECIMAL(28,8)))
                  FILTER (WHERE status = 'Overdue' AND predicted_next_order_value <> 0), 0) FROM reorder) AS DOUBLE),
       false, 'Expected orders of customers past their usual date'
UNION ALL SELECT 'seasonality', CAST((SELECT sum(CAST(greatest(lvl - av, 0) AS DECIMAL(28,8))) FROM (
                  SELECT av, CAST(sum(CAST(av AS DECIMAL(28,8))) OVER () AS DOUBLE) / count(*) OVER () AS lvl
                  FROM (SELECT {R('avg_value', 1)} AS av FROM sidx WHERE series = 'sales') a) b) AS DOUBLE),
       false, 'Sales a year missing in months below the average'
UNION ALL SELECT 'quote_guard', (SELECT abs(s.value_gap) * CASE WHEN m.test_rows > 0
                  THEN (m.test_rows + m.train_rows) / m.test_rows ELSE 1 END
                  FROM q_underpriced_summary s, q_benchmark_metrics m), true,
       'Shortfall a year on jobs priced under comparable work'
UNION ALL SELECT 'delivery', 0.0, false, 'A measure of service without a price'
""", "bc", "conc", "q_pricing_summary", "q_repeat_summary", "q_churn_summary", "reorder", "sidx",
    "q_underpriced_summary", "q_benchmark_metrics")

cte("st", f"""
SELECT area, {R('v', 2)} AS at_stake, basis, area <> 'delivery' AND v > 0 AS include
FROM (SELECT area, basis, coalesce(CASE WHEN per_year THEN raw / greatest(years, 0.25) ELSE raw END, 0) AS v
      FROM st_raw, yrs) t
""", "st_raw", "yrs")

cte("headline", f"""
SELECT 'customer_value' AS area, {pct('leading_share_pct')} AS value FROM conc
UNION ALL SELECT 'pricing', {pct('overridden_pct')} FROM q_pricing_summary
UNION ALL SELECT 'repeat_business', {money('reprint_pipeline_value')} FROM q_repeat_summary
UNION ALL SELECT 'churn', {money('dormant_lifetime_value_at_stake')} FROM q_churn_summary
UNION ALL SELECT 'reorder', {count('overdue_count')} FROM ro_counts
UNION ALL SELECT 'seasonality', CASE WHEN peak_to_trough_ratio IS NULL THEN 'n/a'
              ELSE printf('%.1f', {R('peak_to_trough_ratio', 1)}) || '×' END FROM q_seasonality_summary
UNION ALL SELECT 'delivery', {days('median_days')} FROM q_turnaround_summary
UNION ALL SELECT 'quote_guard', {pct('median_abs_pct_error')} FROM q_benchmark_metrics
""", "conc", "q_pricing_summary", "q_repeat_summary", "q_churn_summary", "ro_counts", "q_seasonality_summary",
    "q_turnaround_summary", "q_benchmark_metrics")

q("at_stake", "SELECT * FROM st", "st")
q("executive_findings", f"""
SELECT CAST(rank AS BIGINT) AS rank, area, at_stake, {money('at_stake')} AS at_stake_label, basis, headline
FROM (SELECT s.area, s.at_stake, s.basis, h.value AS headline,
             row_number() OVER (ORDER BY s.at_stake DESC, s.area) AS rank
      FROM st s LEFT JOIN headline h USING (area) WHERE s.include) t
WHERE rank <= 5""", "st", "headline")


def m(area, ordinal, label, num, text, src):
    return (f"SELECT '{area}' AS area, CAST({ordinal} AS BIGINT) AS ordinal, {label} AS label, "
            f"CAST({num} AS DOUBLE) AS value_num, {text} AS value_text FROM {src}")


LEAD_LABEL = ("CASE WHEN tied_count > 1 THEN 'Top ' || lower(CASE leading_count WHEN 1 THEN 'One' WHEN 2 THEN 'Two' "
              "WHEN 3 THEN 'Three' WHEN 4 THEN 'Four' WHEN 5 THEN 'Five' WHEN 6 THEN 'Six' WHEN 7 THEN 'Seven' "
              "WHEN 8 THEN 'Eight' WHEN 9 THEN 'Nine' WHEN 10 THEN 'Ten' ELSE CAST(leading_count AS VARCHAR) END) "
              "|| ' accounts, level' ELSE 'Largest account' END")
ROWS = [
    m("customer_value", 1, LEAD_LABEL, "leading_share_pct", pct("leading_share_pct"), "conc"),
    m("customer_value", 2, "'Clearly ahead of the field'", "ahead_count", count("ahead_count"), "conc"),
    m("customer_value", 3, "'Accounts for 80% of value'", "customers_for_80pct_value",
      count("customers_for_80pct_value"), "conc"),
    m("pricing", 1, "'Quotes overridden'", "overridden_pct", pct("overridden_pct"), "q_pricing_summary"),
    m("pricing", 2, "'Price reductions'", "discount_total", money("discount_total"), "q_pricing_summary"),
    m("pricing", 3, "'Jobs below cost'", "below_cost_jobs", count("below_cost_jobs"), "q_pricing_summary"),
    m("reorder", 1, "'Overdue now'", "overdue_count", count("overdue_count"), "ro_counts"),
    m("reorder", 2, "'Due within 14 days'", "due_soon_count", count("due_soon_count"), "ro_counts"),
    m("reorder", 3, "'Expected next 30 days'", "expected_value_next_30_days",
      money("expected_value_next_30_days"), "q_reorder_summary"),
    m("churn", 1, "'At risk'", "at_risk", count("at_risk"), "q_churn_summary"),
    m("churn", 2, "'Dormant'", "dormant", count("dormant"), "q_churn_summary"),
    m("churn", 3, "'Value at stake'", "dormant_lifetime_value_at_stake",
      money("dormant_lifetime_value_at_stake"), "q_churn_summary"),
    m("seasonality", 1, "'Busiest month'", "peak_index", "peak_month", "q_seasonality_summary"),
    m("seasonality", 2, "'Quietest month'", "trough_index", "trough_month", "q_seasonality_summary"),
    m("seasonality", 3, "'Next month projected'", "forecast_next_month_sales",
      money("forecast_next_month_sales"), "q_seasonality_summary"),
    m("delivery", 1, "'Typical turnaround'", "median_days", days("median_days"), "q_turnaround_summary"),
    m("delivery", 2, "'Slowest tenth'", "p90_days", days("p90_days"), "q_turnaround_summary"),
    m("delivery", 3, "'Recent trend'", "recent_vs_prior_days",
      f"printf('%+.1f', {R('recent_vs_prior_days', 1)}) || ' days'", "q_turnaround_summary"),
    m("quote_guard", 1, "'Typical accuracy'", "median_abs_pct_error", pct("median_abs_pct_error"),
      "q_benchmark_metrics"),
    m("quote_guard", 2, "'Within 25%'", "within_25pct", pct("within_25pct"), "q_benchmark_metrics"),
    m("quote_guard", 3, "'Underpriced jobs found'", "flagged_count", count("flagged_count"), "q_underpriced_summary"),
    m("repeat_business", 1, "'Reprint revenue'", "repeat_revenue_pct", pct("repeat_revenue_pct"), "q_repeat_summary"),
    m("repeat_business", 2, "'Recurring titles'", "repeat_titles", count("repeat_titles"), "q_repeat_summary"),
    m("repeat_business", 3, "'Overdue a reprint'", "titles_due_reprint", count("titles_due_reprint"),
      "q_repeat_summary"),
    m("overview", 1, "'Total sales'", "total_sell_price", money("total_sell_price"), "q_dataset_summary"),
    m("overview", 2, "'Value added'", "total_va_amount", money("total_va_amount"), "q_dataset_summary"),
    m("overview", 3, "'Customers'", "customer_count", count("customer_count"), "q_dataset_summary"),
    m("data_quality", 1, "'Reporting currency'", "NULL", "'GBP'", "q_dataset_summary"),
    m("data_quality", 2, "'Overstatement avoided'", "naive_overstatement", money("naive_overstatement"),
      "q_dataset_summary"),
    m("data_quality", 3, "'Jobs analysed'", "row_count", count("row_count"), "q_dataset_summary"),
]
q("brief_metrics", "\nUNION ALL\n".join(ROWS), "conc", "q_pricing_summary", "ro_counts", "q_reorder_summary",
  "q_churn_summary", "q_seasonality_summary", "q_turnaround_summary", "q_benchmark_metrics",
  "q_underpriced_summary", "q_repeat_summary", "q_dataset_summary")


def num0(x: str) -> str:
    return f"format('{{:,.0f}}', {R(x, 0)})"


def pct0(x: str) -> str:
    return pct(x, 0)


def b(area, ordinal, category, val, share, src):
    o = "CAST(NULL AS BIGINT)" if ordinal is None else f"CAST({ordinal} AS BIGINT)"
    return (f"SELECT '{area}' AS area, {o} AS ordinal, {category} AS category, {val} AS value_text, "
            f"{share} AS share_text FROM {src}")


cte("pricing_sell", f"SELECT p.*, (SELECT CAST(sum(CAST(sell_price_base AS DECIMAL(28,8))) AS DOUBLE) FROM jd) AS sell "
    "FROM q_pricing_summary p", "q_pricing_summary", "jd")
cte("ro_b", """
SELECT count(*) FILTER (WHERE status = 'Overdue') AS overdue, count(*) FILTER (WHERE status = 'Due soon') AS due,
       count(*) FILTER (WHERE status <> 'Insufficient history') AS predictable_customers FROM reorder""", "reorder")
BROWS = [
    b("pricing", 0, "'Price reductions'", money("discount_total"), pct("discount_as_pct_of_sales"), "pricing_sell"),
    b("pricing", 1, "'Price uplifts'", money("uplift_total"),
      f"CASE WHEN sell <> 0 THEN {pct('uplift_total / sell * 100')} ELSE 'n/a' END", "pricing_sell"),
    b("pricing", 2, "'Jobs below cost'", "'-' || " + money("abs(below_cost_va)"),
      count("below_cost_jobs") + " || ' jobs'", "pricing_sell"),
    b("pricing", 3, "'Low-margin work'", money("low_margin_sell_value"), pct("low_margin_pct") + " || ' of jobs'",
      "pricing_sell"),
    b("reorder", 0, "'Overdue'", count("overdue"), "'Call now'", "ro_b"),
    b("reorder", 1, "'Due soon'", count("due"), "'Call in two weeks'", "ro_b"),
    b("reorder", 2, "'On track'", count("greatest(predictable_customers - overdue - due, 0)"), "'No action'", "ro_b"),
    b("churn", 0, "'Active'", count("active"), "'None'", "q_churn_summary"),
    b("churn", 1, "'At risk'", count("at_risk"), "'Call soon'", "q_churn_summary"),
    b("churn", 2, "'Dormant'", count("dormant"), "'Offer to return'", "q_churn_summary"),
    b("seasonality", 0, "'Peak (' || peak_month || ')'", pct0("peak_index"), "'Reserve presses ahead'",
      "q_seasonality_summary"),
    b("seasonality", 1, "'Trough (' || trough_month || ')'", pct0("trough_index"), "'Time for upkeep'",
      "q_seasonality_summary"),
    b("seasonality", 2, "'Recent press load'", num0("press_hours_recent_avg") + " || ' hrs'", "'Usual load'",
      "q_seasonality_summary"),
    b("seasonality", 3, "'Peak press load'", num0("press_hours_peak_month") + " || ' hrs'", "'Highest load'",
      "q_seasonality_summary"),
    b("repeat_business", 0, "'Recurring titles'", count("repeat_titles"), "'Orders that come again'",
      "q_repeat_summary"),
    b("repeat_business", 1, "'Overdue a reprint'", count("titles_due_reprint"),
      money("reprint_pipeline_value") + " || ' to ask for'", "q_repeat_summary"),
    b("repeat_business", 2, "'One-off titles'", count("one_off_titles"), "'Ordered once'",
      "q_repeat_summary"),
    b("repeat_business", 3, "'Most reprinted title'", "CAST(max_runs AS VARCHAR) || ' runs'", "'Most repeats'",
      "q_repeat_summary"),
    b("quote_guard", 0, "'Typical error'", pct("median_abs_pct_error"), "'Middle error'", "q_benchmark_metrics"),
    b("quote_guard", 1, "'Within 10%'", pct("within_10pct"), "'Close'", "q_benchmark_metrics"),
    b("quote_guard", 2, "'Within 25%'", pct("within_25pct"), "'Near'", "q_benchmark_metrics"),
    b("quote_guard", 3, "'Tested on'", count("test_rows") + " || ' jobs'", "'Held out'", "q_benchmark_metrics"),
    b("customer_value", None, "work_type", money("total_va_amount"),
      pct0("total_va_amount / CASE WHEN t <> 0 THEN t ELSE 1.0 END * 100"),
      "(SELECT w.*, (SELECT CAST(sum(CAST(total_va_amount AS DECIMAL(28,8))) AS DOUBLE) "
      "FROM q_work_type_breakdown) AS t FROM q_work_type_breakdown w) x"),
    b("delivery", None, "work_type", days("median_days"), days("p90_days"), "q_turnaround_by_work_type"),
    b("data_quality", None, "currency", num0("sell_price_native"), money("sell_price_base"), "q_currency_split"),
    b("data_quality", None, "'Reported total (GBP)'", "'n/a'", money("total_sell_price"), "q_dataset_summary"),
]
q("brief_breakdown", "\nUNION ALL\n".join(BROWS), "pricing_sell", "ro_b", "q_churn_summary", "q_seasonality_summary",
  "q_repeat_summary", "q_benchmark_metrics", "q_work_type_breakdown", "q_turnaround_by_work_type",
  "q_currency_split", "q_dataset_summary")
