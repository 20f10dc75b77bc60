"""Oracle SQL: monthly grid, seasonal index, recursive forecast, backtest."""
from inkbook.plans.oracle import M, R, cte, q

MONTHS = "['Jan','Feb','Mar','Apr','May','Jun','Jul','Aug','Sep','Oct','Nov','Dec']"

cte("mon", f"""
SELECT month_start, {M('sell_price_base')} AS sell_price, {M('va_amount_base')} AS va_amount,
       {M('press_hrs')} AS press_hours, {M('impressions')} AS impressions, count(job_id) AS job_count
FROM jd WHERE month_start IS NOT NULL GROUP BY month_start
""", "jd")

cte("grid", """
SELECT g.month_start,
       coalesce(m.sell_price, 0) AS sell_price, coalesce(m.va_amount, 0) AS va_amount,
       coalesce(m.press_hours, 0) AS press_hours, coalesce(m.impressions, 0) AS impressions,
       coalesce(m.job_count, 0) AS job_count
FROM (SELECT CAST(unnest(generate_series(min(month_start), max(month_start), INTERVAL 1 MONTH)) AS DATE) AS month_start
      FROM mon) g
LEFT JOIN mon m ON m.month_start = g.month_start
""", "mon")

cte("glong", """
SELECT 'sales' AS series, month_start, CAST(sell_price AS DOUBLE) AS value, sell_price AS dvalue FROM grid
UNION ALL
SELECT 'press' AS series, month_start, CAST(press_hours AS DOUBLE) AS value, press_hours AS dvalue FROM grid
""", "grid")

cte("sidx", """
SELECT p.series, p.month_num, p.avg_value,
       CASE WHEN o.overall <> 0 THEN p.avg_value / o.overall * 100 ELSE 100 END AS seasonal_index
FROM (SELECT series, month(month_start) AS month_num, CAST(sum(dvalue) AS DOUBLE) / count(*) AS avg_value
      FROM glong GROUP BY 1, 2) p
JOIN (SELECT series, CAST(sum(dvalue) AS DOUBLE) / count(*) AS overall FROM glong GROUP BY 1) o USING (series)
""", "glong")

cte("fbase", """
SELECT series, list(value ORDER BY month_start) AS vals, max(month_start) AS last_month
FROM glong GROUP BY series HAVING count(*) >= 14
""", "glong")

cte("frec", """
SELECT series, last_month, vals, 0 AS step FROM fbase
UNION ALL
SELECT series, last_month,
       list_append(vals, vals[len(vals) - 11] *
         least(greatest(CASE WHEN p <> 0 THEN r / p ELSE 1.0 END, 0.5), 2.0)),
       step + 1
FROM (SELECT series, last_month, vals, step,
             (vals[len(vals) - 2] + vals[len(vals) - 1] + vals[len(vals)]) / 3.0 AS r,
             (vals[len(vals) - 13] + vals[len(vals) - 12] + vals[len(vals) - 11]) / 3.0 AS p
      FROM frec WHERE step < 6) t
""", "fbase", recursive=True)

cte("fc", """
SELECT series, i AS step, CAST(last_month + to_months(CAST(i AS INTEGER)) AS DATE) AS month_start,
       vals[len(vals) - 6 + i] AS value
FROM frec, range(1, 7) r(i) WHERE frec.step = 6
""", "frec")

cte("bt", """
SELECT series, month_start, value AS actual,
       l12 * least(greatest(CASE WHEN prior <> 0 THEN recent / prior ELSE 1.0 END, 0.5), 2.0) AS predicted
FROM (SELECT *, (l3 + l2 + l1) / 3.0 AS recent,
             (coalesce(l14, 0) + coalesce(l13, 0) + l12)
               / (1 + CASE WHEN l13 IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN l14 IS NOT NULL THEN 1 ELSE 0 END) AS prior
      FROM (SELECT series, month_start, value,
                   row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY series) AS n,
                   lag(value, 1) OVER w AS l1, lag(value, 2) OVER w AS l2, lag(value, 3) OVER w AS l3,
                   lag(value, 12) OVER w AS l12, lag(value, 13) OVER w AS l13, lag(value, 14) OVER w AS l14
            FROM glong WINDOW w AS (PARTITION BY series ORDER BY month_start)) a
      WHERE n >= 14 AND i >= greatest(n - 6, 12) AND value > 0) b
""", "glong")

q("monthly_series", f"""
SELECT month_start, {R('sell_price')} AS sell_price, {R('va_amount')} AS va_amount,
       {R('press_hours')} AS press_hours, {R('impressions')} AS impressions, job_count FROM grid""", "grid")
q("seasonal_index", f"""
SELECT series, month_num, {R('avg_value', 1)} AS avg_value, {R('seasonal_index', 1)} AS seasonal_index,
       {MONTHS}[month_num] AS month_name, seasonal_index >= 100 AS at_or_above_average FROM sidx""", "sidx")
q("seasonal_forecast", f"SELECT series, step, month_start, {R('greatest(value, 0)')} AS forecast FROM fc", "fc")
q("forecast_backtest", f"""
SELECT series, month_start, {R('actual')} AS actual, {R('predicted')} AS predicted,
       {R('abs(predicted - actual) / actual * 100')} AS abs_pct_error FROM bt""", "bt")
q("peak_month_mix", f"""
SELECT industry, {R(M('sell_price_base'))} AS sell_price FROM jd
WHERE industry IS NOT NULL
  AND month(sales_in) = (SELECT first(month_num ORDER BY seasonal_index DESC, month_num) FROM sidx WHERE series = 'sales')
GROUP BY industry ORDER BY sum(CAST(sell_price_base AS DECIMAL(28,8))) DESC, industry LIMIT 6""", "jd", "sidx")
q("seasonality_summary", f"""
SELECT {MONTHS}[pk.peak_num] AS peak_month, {R('pk.peak_idx', 1)} AS peak_index,
       {MONTHS}[pk.trough_num] AS trough_month, {R('pk.trough_idx', 1)} AS trough_index,
       CASE WHEN pk.trough_idx <> 0 THEN {R('pk.peak_idx / pk.trough_idx', 2)} END AS peak_to_trough_ratio,
       {R("(SELECT avg(abs(predicted - actual) / actual) * 100 FROM bt WHERE series = 'sales')", 1)} AS sales_forecast_mape,
       {R("(SELECT avg(abs(predicted - actual) / actual) * 100 FROM bt WHERE series = 'press')", 1)} AS press_forecast_mape,
       CAST(6 AS BIGINT) AS forecast_horizon_months,
       {R('(SELECT max(press_hours) FROM grid)', 1)} AS press_hours_peak_month,
       {R('(SELECT CAST(sum(press_hours) AS DOUBLE) / count(*) FROM (SELECT press_hours FROM grid ORDER BY month_start DESC LIMIT 12))', 1)} AS press_hours_recent_avg,
       {R("(SELECT greatest(value, 0) FROM fc WHERE series = 'sales' AND step = 1)")} AS forecast_next_month_sales,
       {R("(SELECT greatest(value, 0) FROM fc WHERE series = 'press' AND step = 1)")} AS forecast_next_month_press
FROM (SELECT first(month_num ORDER BY seasonal_index DESC, month_num) AS peak_num, max(seasonal_index) AS peak_idx,
             first(month_num ORDER BY seasonal_index, month_num) AS trough_num, min(seasonal_index) AS trough_idx
      FROM sidx WHERE series = 'sales') pk""", "sidx", "bt", "grid", "fc")
q("actual_vs_forecast", f"""
SELECT month_start, {R('sell_price')} AS actual,
       CASE WHEN month_start = (SELECT max(month_start) FROM grid) THEN {R('sell_price')} END AS forecast
FROM grid
UNION ALL
SELECT month_start, CAST(NULL AS DOUBLE) AS actual, {R('greatest(value, 0)')} AS forecast
FROM fc WHERE series = 'sales'""", "grid", "fc")
