"""Oracle SQL: order events, cadence, reorder forecast, churn."""
from inkbook.plans.oracle import FIRST, M, MD, R, cte, q

cte("events", f"""
SELECT customer_id, customer_name, sales_in,
       {MD('sell_price_base')} AS order_value, {MD('va_amount_base')} AS order_va
FROM jd WHERE customer_id IS NOT NULL AND customer_name IS NOT NULL AND sales_in IS NOT NULL
GROUP BY customer_id, customer_name, sales_in
""", "jd")

cte("events_gaps", """
SELECT *, CAST(date_diff('day', lag(sales_in) OVER (PARTITION BY customer_id, customer_name ORDER BY sales_in), sales_in) AS DOUBLE) AS gap,
       row_number() OVER (PARTITION BY customer_id, customer_name ORDER BY sales_in DESC) AS rn_desc
FROM events
""", "events")

cte("cadence", f"""
SELECT customer_id, customer_name, count(*) AS order_count,
       min(sales_in) AS first_order_date, max(sales_in) AS last_order_date,
       avg(gap) AS mean_gap, stddev_pop(gap) AS std_gap,
       {MD('order_value')} / count(*) AS avg_order_value,
       CAST(sum(CAST(order_value AS DECIMAL(28,8))) FILTER (WHERE rn_desc <= 3) AS DOUBLE)
         / count(*) FILTER (WHERE rn_desc <= 3) AS recent_value
FROM events_gaps GROUP BY customer_id, customer_name
""", "events_gaps")

cte("reorder", f"""
SELECT customer_id, customer_name, order_count,
       CASE WHEN order_count >= 3 THEN {R('mean_gap', 1)} END AS avg_interval_days,
       CASE WHEN order_count < 3 THEN 'Insufficient history'
            WHEN cv < 0.4 THEN 'Regular' WHEN cv < 0.9 THEN 'Variable' ELSE 'Irregular' END AS regularity,
       last_order_date,
       CASE WHEN order_count >= 3 THEN nxt END AS predicted_next_order_date,
       CASE WHEN order_count >= 3 THEN date_diff('day', (SELECT as_of FROM asofd), nxt) END AS days_until_predicted,
       {R('avg_order_value')} AS avg_order_value,
       CASE WHEN order_count >= 3 THEN {R('recent_value')} END AS predicted_next_order_value,
       CASE WHEN order_count < 3 THEN 'Insufficient history'
            WHEN date_diff('day', (SELECT as_of FROM asofd), nxt) < 0 THEN 'Overdue'
            WHEN date_diff('day', (SELECT as_of FROM asofd), nxt) <= 14 THEN 'Due soon'
            ELSE 'On track' END AS status
FROM (SELECT *, CASE WHEN mean_gap <> 0 THEN coalesce(std_gap, 0) / mean_gap ELSE 0 END AS cv,
             CAST(last_order_date + CAST(round_even(mean_gap, 0) AS INTEGER) AS DATE) AS nxt
      FROM cadence) t
""", "cadence", "asofd")

cte("churn", f"""
SELECT customer_id, customer_name, industry, region, rep, order_count, last_order_date,
       days_since_last_order,
       CASE WHEN order_count >= 3 THEN {R('gap', 1)} END AS avg_interval_days,
       CASE WHEN order_count >= 3 THEN 'relative' ELSE 'absolute' END AS basis,
       CASE WHEN order_count >= 3 THEN
              CASE WHEN ratio <= 1.25 THEN 'Active' WHEN ratio <= 2.5 THEN 'At Risk' ELSE 'Dormant' END
            ELSE CASE WHEN days_since_last_order <= 120 THEN 'Active'
                      WHEN days_since_last_order <= 270 THEN 'At Risk' ELSE 'Dormant' END
       END AS status,
       {R('va')} AS lifetime_va_amount, {R('sell')} AS lifetime_sell_price
FROM (
  SELECT *, CASE WHEN gap <> 0 THEN days_since_last_order / gap ELSE CAST(days_since_last_order AS DOUBLE) END AS ratio
  FROM (
    SELECT customer_id, customer_name, count(DISTINCT sales_in) AS order_count,
           max(sales_in) AS last_order_date,
           date_diff('day', max(sales_in), (SELECT as_of FROM asofd)) AS days_since_last_order,
           date_diff('day', min(sales_in), max(sales_in)) / CAST(count(DISTINCT sales_in) - 1 AS DOUBLE) AS gap,
           {M('va_amount_base')} AS va, {M('sell_price_base')} AS sell,
           {FIRST('industry')} AS industry, {FIRST('region')} AS region, {FIRST('rep')} AS rep
    FROM jd WHERE customer_id IS NOT NULL AND customer_name IS NOT NULL
    GROUP BY customer_id, customer_name) a) b
""", "jd", "asofd")

q("order_events", "SELECT * FROM events", "events")
q("order_cadence", f"""
SELECT customer_id, customer_name, order_count, first_order_date, last_order_date,
       {R('mean_gap', 4)} AS mean_gap, {R('std_gap', 4)} AS std_gap,
       {R('avg_order_value', 2)} AS avg_order_value, {R('recent_value', 2)} AS recent_value
FROM cadence""", "cadence")
q("reorder_forecast", "SELECT * FROM reorder", "reorder")
q("reorder_labels", """
SELECT customer_id, customer_name, order_count,
       CASE WHEN avg_interval_days IS NULL THEN 'n/a'
            ELSE CASE WHEN avg_interval_days = floor(avg_interval_days)
                      THEN CAST(CAST(avg_interval_days AS BIGINT) AS VARCHAR)
                      ELSE CAST(avg_interval_days AS VARCHAR) END || 'd (' || regularity || ')' END AS cadence,
       last_order_date,
       CASE WHEN predicted_next_order_date IS NULL THEN 'n/a'
            ELSE CAST(predicted_next_order_date AS VARCHAR) || ' ('
                 || CASE WHEN days_until_predicted >= 0 THEN 'in ' || days_until_predicted || 'd'
                         ELSE (-days_until_predicted) || 'd ago' END || ')' END AS expected,
       status
FROM reorder""", "reorder")
q("reorder_summary", f"""
SELECT count(*) FILTER (WHERE status <> 'Insufficient history') AS predictable_customers,
       count(*) FILTER (WHERE status = 'Overdue') AS overdue_count,
       count(*) FILTER (WHERE status = 'Due soon') AS due_soon_count,
       {R("coalesce(sum(CAST(predicted_next_order_value AS DECIMAL(28,8))) FILTER (WHERE status <> 'Insufficient history' AND days_until_predicted BETWEEN -10000 AND 30), 0)")} AS expected_value_next_30_days
FROM reorder""", "reorder")
q("churn_status", "SELECT * FROM churn", "churn")
q("follow_up", "SELECT * FROM churn WHERE status IN ('At Risk', 'Dormant')", "churn")
q("churn_summary", f"""
SELECT count(*) FILTER (WHERE status = 'Active') AS active,
       count(*) FILTER (WHERE status = 'At Risk') AS at_risk,
       count(*) FILTER (WHERE status = 'Dormant') AS dormant,
       count(*) AS customers,
       {R("coalesce(sum(CAST(lifetime_va_amount AS DECIMAL(28,8))) FILTER (WHERE status = 'Dormant'), 0)")} AS dormant_lifetime_value_at_stake
FROM churn""", "churn")
