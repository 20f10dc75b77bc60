"""Oracle SQL: cleaning steps, derived columns, report library, helpers."""
from inkbook.plans.oracle import M, R, cte, q

cte("rawk", """
SELECT *, CAST(split_part(row_key, ':', 1) AS BIGINT) AS okey, CAST(split_part(row_key, ':', 2) AS INTEGER) AS line
FROM jd
""", "jd")

q("coerce_numeric", """
SELECT row_key, CASE WHEN okey % 11 = 0 THEN 0 ELSE quantity END AS quantity,
       CASE WHEN line = 7 THEN 0 ELSE sell_price END AS sell_price,
       CASE WHEN okey % 13 = 0 THEN 0 ELSE va_pct END AS va_pct
FROM rawk""", "rawk")
q("coerce_dates", """
SELECT row_key, CASE WHEN okey % 89 = 0 THEN NULL ELSE sales_in END AS sales_in,
       CASE WHEN line = 6 THEN NULL ELSE ship_date END AS ship_date FROM rawk""", "rawk")
q("clean_keys", """
SELECT row_key, CASE WHEN okey % 83 = 0 OR okey % 79 = 0 THEN NULL ELSE customer_id END AS customer_id,
       customer_name FROM rawk""", "rawk")
q("drop_unusable", """
SELECT row_key, customer_id, sales_in FROM rawk
WHERE okey % 89 <> 0 AND okey % 83 <> 0 AND okey % 79 <> 0""", "rawk")
q("fx_convert", f"""
SELECT row_key, currency, fx_rate, {R('sell_price_base', 4)} AS sell_price_base,
       {R('va_amount_base', 4)} AS va_amount_base, {R('manual_adjustment_base', 4)} AS manual_adjustment_base
FROM jd""", "jd")
q("canonical_labels", """
SELECT label_value, product_type_clean, count(*) AS job_count FROM jd GROUP BY 1, 2""", "jd")
q("lead_time", "SELECT row_key, sales_in, ship_date, lead_time_days FROM jd", "jd")
q("margin_flags", f"""
SELECT row_key, {R('va_amount', 4)} AS va_amount, {R('va_pct', 6)} AS va_pct, is_below_cost, is_low_margin
FROM jd""", "jd")
q("month_start", "SELECT row_key, sales_in, month_start FROM jd", "jd")
q("as_of", "SELECT max(sales_in) AS as_of FROM jd", "jd")
q("years_of_data", f"""
SELECT {R("greatest(date_diff('day', min(sales_in), max(sales_in)) / 365.25, 0.25)", 2)} AS years_of_data
FROM jd""", "jd")

cte("rev", """
SELECT user_id AS report_id, event_id AS seq, ts,
       CASE event_type WHEN 'signup' THEN 'generating' WHEN 'view' THEN 'generating'
                       WHEN 'click' THEN 'generating' WHEN 'purchase' THEN 'ready'
                       WHEN 'error' THEN 'failed' END AS status,
       event_type AS progress,
       least(greatest(CAST(floor(value) AS INTEGER), 0), 100) AS progress_pct,
       'report ' || CAST(user_id AS VARCHAR) AS name,
       CASE WHEN event_type = 'error' THEN props END AS message,
       CASE WHEN event_type = 'purchase' THEN CAST(floor(value) AS BIGINT) END AS rows,
       CASE WHEN event_type = 'purchase' THEN CAST(floor(value / 2) AS BIGINT) END AS customers,
       CASE WHEN event_type = 'purchase' THEN CAST(ts AS DATE) - 30 END AS period_from,
       CASE WHEN event_type = 'purchase' THEN CAST(ts AS DATE) END AS period_to
FROM events
""")
cte("rstate", """
SELECT * FROM (
  SELECT report_id, min(ts) AS created_at,
         first(status ORDER BY ts DESC, seq DESC) AS status,
         first(progress ORDER BY ts DESC, seq DESC) FILTER (WHERE progress IS NOT NULL) AS progress,
         first(progress_pct ORDER BY ts DESC, seq DESC) FILTER (WHERE progress_pct IS NOT NULL) AS progress_pct,
         first(name ORDER BY ts DESC, seq DESC) FILTER (WHERE name IS NOT NULL) AS name,
         max(ts) FILTER (WHERE status = 'ready') AS completed_at,
         first(message ORDER BY ts DESC, seq DESC) FILTER (WHERE status = 'failed') AS error,
         count(*) AS event_count,
         first(rows ORDER BY ts DESC, seq DESC) FILTER (WHERE rows IS NOT NULL) AS rows,
         first(customers ORDER BY ts DESC, seq DESC) FILTER (WHERE customers IS NOT NULL) AS customers,
         first(period_from ORDER BY ts DESC, seq DESC) FILTER (WHERE period_from IS NOT NULL) AS period_from,
         first(period_to ORDER BY ts DESC, seq DESC) FILTER (WHERE period_to IS NOT NULL) AS period_to
  FROM rev GROUP BY report_id) t
WHERE status <> 'deleted'
""", "rev")
q("report_state_latest", "SELECT * FROM rstate", "rstate")
q("report_list", """
SELECT report_id, name, created_at, completed_at, status, progress, progress_pct, error, rows, customers,
       period_from, period_to FROM rstate""", "rstate")
q("latest_ready", """
SELECT report_id, created_at FROM rstate WHERE status = 'ready'
ORDER BY created_at DESC, report_id DESC LIMIT 1""", "rstate")

cte("bc_region", f"""
SELECT region, customer_id, customer_name, {M('va_amount_base')} AS va
FROM jd WHERE region IS NOT NULL AND customer_id IS NOT NULL AND customer_name IS NOT NULL
GROUP BY 1, 2, 3
""", "jd")
q("top_k_per_group", f"""
SELECT region, customer_id, customer_name, {R('va')} AS total_va_amount, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY region ORDER BY va DESC, customer_id, customer_name) AS rank
  FROM bc_region) t WHERE rank <= 3""", "bc_region")


def money(x: str) -> str:
    a = f"abs({x})"
    return f"""CASE WHEN {x} IS NULL THEN 'n/a' ELSE
  (CASE WHEN {x} < 0 THEN '-' ELSE '' END) || '£' ||
  CASE WHEN {a} >= 1000000 THEN printf('%.1f', {R(a + ' / 1000000', 1)}) || 'M'
       WHEN {a} >= 1000 THEN printf('%.0f', {R(a + ' / 1000', 0)}) || 'k'
       ELSE format('{{:,.0f}}', {R(a, 0)}) END END"""


q("formatted_figures", f"""
SELECT work_type, {money('va')} AS va_compact,
       CASE WHEN va IS NULL THEN 'n/a' ELSE '£' || format('{{:,.0f}}', {R('abs(va)', 0)}) END AS va_exact,
       printf('%.1f', {R('va / (sum(va) OVER ()) * 100', 1)}) || '%' AS va_share,
       format('{{:,}}', jobs) AS jobs,
       {money('sell / -1000')} AS sell_thousandth_negative
FROM (SELECT work_type, {R(M('va_amount_base'))} AS va, {R(M('sell_price_base'))} AS sell, count(job_id) AS jobs
      FROM jd WHERE work_type IS NOT NULL GROUP BY work_type) t""", "jd")
