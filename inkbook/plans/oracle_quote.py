"""Oracle SQL: price features, hash split, comparable-work baseline and its
evaluation."""
from inkbook.plans.oracle import R, cte, q

cte("pf", """
SELECT row_key, job_id, customer_name, quantity, impressions, plates, press_hrs, paper_base, labour_base,
       purchases_base, coalesce(work_type, 'Unknown') AS work_type, coalesce(region, 'Unknown') AS region,
       coalesce(currency, 'Unknown') AS currency, coalesce(product_type_clean, 'Unknown') AS product_type_clean,
       sell_price_base AS actual_price, ln(1 + sell_price_base) AS label
FROM jd WHERE sell_price_base > 0
""", "jd")
cte("psplit", """
SELECT *, CAST(('0x' || substr(md5(row_key), 1, 8)) AS BIGINT) % 4 = 0 AS is_test FROM pf
""", "pf")
cte("ptrain", """
SELECT *, ln(1 + actual_price / quantity) AS lpu FROM psplit WHERE NOT is_test AND quantity > 0
""", "psplit")
cte("pbase", """
SELECT s.*, (exp(coalesce(m1.m, m2.m, m3.m)) - 1) * s.quantity AS expected_price
FROM psplit s
LEFT JOIN (SELECT work_type, product_type_clean, quantile_cont(lpu, 0.5) AS m FROM ptrain GROUP BY 1, 2) m1
       ON m1.work_type = s.work_type AND m1.product_type_clean = s.product_type_clean
LEFT JOIN (SELECT work_type, quantile_cont(lpu, 0.5) AS m FROM ptrain GROUP BY 1) m2 ON m2.work_type = s.work_type
CROSS JOIN (SELECT quantile_cont(lpu, 0.5) AS m FROM ptrain) m3
WHERE s.is_test AND (SELECT count(*) FROM psplit) >= 200
""", "psplit", "ptrain")

NUM = ["quantity", "impressions", "plates", "press_hrs", "paper_base", "labour_base", "purchases_base"]
q("price_features", "SELECT row_key, " + ", ".join(f"{R(c, 4)} AS {c}" for c in NUM)
  + f", work_type, region, currency, product_type_clean, {R('label', 6)} AS label FROM pf", "pf")
q("holdout_split", "SELECT row_key, is_test FROM psplit", "psplit")
q("comparable_baseline", f"SELECT row_key, {R('expected_price', 4)} AS expected_price FROM pbase", "pbase")
q("benchmark_metrics", f"""
SELECT {R('1 - sum((y - p) * (y - p)) / sum((y - ybar) * (y - ybar))', 3)} AS r2_log,
       {R('avg(abs(e - a))')} AS mae, {R('quantile_cont(pe, 0.5) * 100', 1)} AS median_abs_pct_error,
       {R('avg(CASE WHEN pe <= 0.10 THEN 1.0 ELSE 0.0 END) * 100', 1)} AS within_10pct,
       {R('avg(CASE WHEN pe <= 0.25 THEN 1.0 ELSE 0.0 END) * 100', 1)} AS within_25pct,
       (SELECT count(*) FROM psplit WHERE NOT is_test) AS train_rows,
       (SELECT count(*) FROM psplit WHERE is_test) AS test_rows
FROM (SELECT label AS y, ln(1 + expected_price) AS p, expected_price AS e, actual_price AS a,
             abs(expected_price - actual_price) / actual_price AS pe, avg(label) OVER () AS ybar FROM pbase) t
""", "pbase", "psplit")
q("underpriced_jobs", f"""
SELECT row_key, job_id, customer_name, product_type_clean AS product_type, work_type, {R('quantity')} AS quantity,
       {R('actual_price')} AS actual_price, {R('expected_price', 4)} AS expected_price, {R('gap', 4)} AS gap,
       {R('gap_pct', 4)} AS gap_pct
FROM (SELECT *, actual_price - expected_price AS gap,
             (actual_price - expected_price) / expected_price * 100 AS gap_pct FROM pbase) t
WHERE gap_pct <= -20 ORDER BY gap, row_key LIMIT 20""", "pbase")
q("underpriced_summary", f"""
SELECT count(*) FILTER (WHERE gap_pct <= -20) AS flagged_count,
       {R('count(*) FILTER (WHERE gap_pct <= -20) / count(*) * 100', 1)} AS flagged_share_pct,
       {R('coalesce(sum(CAST(gap AS DECIMAL(28,8))) FILTER (WHERE gap_pct <= -20), 0)')} AS value_gap,
       CAST(20.0 AS DOUBLE) AS threshold_pct
FROM (SELECT *, actual_price - expected_price AS gap,
             (actual_price - expected_price) / expected_price * 100 AS gap_pct FROM pbase) t""", "pbase")

LABELS = {
    "quantity": "Order quantity", "impressions": "Impressions (sheets)", "plates": "Printing plates",
    "press_hrs": "Press hours", "paper_base": "Paper cost", "labour_base": "Labour cost",
    "purchases_base": "Bought-in cost", "work_type": "Work type", "region": "Region", "currency": "Currency",
    "product_type_clean": "Product type"}
q("features_used", " UNION ALL ".join(
    f"SELECT CAST({i} AS BIGINT) AS ordinal, '{f}' AS feature, '{t}' AS label, "
    f"(SELECT count(*) FROM psplit WHERE CAST({f} AS VARCHAR) <> 'Unknown') AS jobs_with_value"
    for i, (f, t) in enumerate(LABELS.items(), 1)), "psplit")
