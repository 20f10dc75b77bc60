"""Oracle SQL: customer value, concentration, dataset summary."""
from inkbook.plans.oracle import FIRST, M, R, cte, q

cte("bc0", f"""
SELECT customer_id, customer_name,
       {M('sell_price_base')} AS total_sell_price, {M('va_amount_base')} AS total_va_amount,
       {M('quantity')} AS total_quantity, count(job_id) AS job_count, avg(va_pct) AS avg_va_pct,
       max(sales_in) AS last_order, min(sales_in) AS first_order,
       {FIRST('industry')} AS industry, {FIRST('region')} AS region, {FIRST('rep')} AS rep
FROM jd WHERE customer_id IS NOT NULL AND customer_name IS NOT NULL
GROUP BY customer_id, customer_name
""", "jd")

cte("twt", f"""
SELECT customer_id, first(work_type ORDER BY va DESC, work_type) AS top_work_type
FROM (SELECT customer_id, work_type, {M('va_amount_base')} AS va FROM jd
      WHERE customer_id IS NOT NULL AND work_type IS NOT NULL GROUP BY 1, 2) t
GROUP BY customer_id
""", "jd")

cte("bc", """
SELECT b.*, w.top_work_type, t.total AS total_all,
       CASE WHEN t.total <> 0 THEN CAST(b.total_va_amount AS DOUBLE) / CAST(t.total AS DOUBLE) * 100
            ELSE CAST(0 AS DOUBLE) END AS value_share_pct,
       row_number() OVER (ORDER BY b.total_va_amount DESC, b.customer_id, b.customer_name) AS rank
FROM bc0 b LEFT JOIN twt w USING (customer_id)
CROSS JOIN (SELECT sum(total_va_amount) AS total FROM bc0) t
""", "bc0", "twt")

cte("pareto", f"""
SELECT count(*) AS customer_count,
       greatest(count(*) FILTER (WHERE cs <= 80), 1) AS customers_for_80pct_value,
       {R('greatest(count(*) FILTER (WHERE cs <= 80), 1) / greatest(count(*), 1) * 100', 1)} AS pct_of_customers_for_80pct_value
FROM (SELECT CASE WHEN total_all <> 0 THEN CAST(sum(total_va_amount) OVER (ORDER BY rank ROWS UNBOUNDED PRECEDING) AS DOUBLE)
                  / CAST(total_all AS DOUBLE) * 100 ELSE 0 END AS cs
      FROM bc) t
""", "bc")

cte("drops", """
SELECT rank, total_va_amount AS v, customer_name,
       CASE WHEN rank <= 10 AND total_va_amount > 0 AND nv > 0
            THEN 1 - CAST(nv AS DOUBLE) / CAST(total_va_amount AS DOUBLE) END AS dr
FROM (SELECT rank, total_va_amount, customer_name,
             lead(total_va_amount) OVER (ORDER BY rank) AS nv FROM bc WHERE rank <= 12) t
""", "bc")

cte("shape_raw", """
SELECT (SELECT count(*) FROM bc WHERE total_va_amount > 0) AS n_pos,
       (SELECT first(rank ORDER BY dr DESC, rank) FROM drops WHERE dr IS NOT NULL) AS lead_raw,
       (SELECT max(dr) FROM drops) AS brk,
       (SELECT min(rank) FROM drops WHERE dr IS NOT NULL AND rank >= 3 AND dr < 0.08) AS flat,
       (SELECT count(*) FROM bc WHERE total_va_amount > 0 AND
          1 - CAST(total_va_amount AS DOUBLE) / CAST((SELECT max(total_va_amount) FROM bc) AS DOUBLE) <= 0.12) AS tied_raw
""", "bc", "drops")

cte("shape", f"""
SELECT CAST(CASE WHEN n_pos = 0 THEN 0 WHEN lead_raw IS NULL THEN n_pos ELSE lead_raw END AS BIGINT) AS leading_count,
       CAST(CASE WHEN n_pos = 0 THEN 0 ELSE tied_raw END AS BIGINT) AS tied_count,
       CAST(CASE WHEN n_pos = 0 THEN 0 ELSE greatest(coalesce(flat - 1,
            CASE WHEN lead_raw IS NULL THEN n_pos ELSE lead_raw END),
            CASE WHEN lead_raw IS NULL THEN n_pos ELSE lead_raw END) END AS BIGINT) AS ahead_count,
       {R('CASE WHEN n_pos = 0 THEN 0 ELSE coalesce(brk, 0) END * 100', 1)} AS break_drop_pct,
       CAST(CASE WHEN n_pos > 0 THEN flat END AS BIGINT) AS flattens_at_rank
FROM shape_raw
""", "shape_raw")

cte("conc", f"""
SELECT p.customer_count, p.customers_for_80pct_value, p.pct_of_customers_for_80pct_value,
       (SELECT customer_name FROM bc WHERE rank = 1) AS top_customer_name,
       {R("coalesce((SELECT sum(total_va_amount) FROM bc WHERE rank = 1), 0) / tot * 100", 1)} AS top_customer_share_pct,
       {R("coalesce((SELECT sum(total_va_amount) FROM bc WHERE rank <= 5), 0) / tot * 100", 1)} AS top_5_share_pct,
       lead_n AS leading_count,
       (SELECT string_agg(customer_name, ', ' ORDER BY rank) FROM bc WHERE rank <= lead_n) AS leading_names,
       {R("coalesce((SELECT sum(total_va_amount) FROM bc WHERE rank <= lead_n), 0) / tot * 100", 1)} AS leading_share_pct,
       tied_n AS tied_count,
       CASE WHEN tied_n > 1 AND v1 <> 0 THEN
            {R("(v1 - (SELECT CAST(min(total_va_amount) AS DOUBLE) FROM bc WHERE total_va_amount > 0 AND 1 - CAST(total_va_amount AS DOUBLE) / v1 <= 0.12)) / v1 * 100", 1)}
            ELSE 0 END AS tied_spread_pct,
       ahead_n AS ahead_count,
       {R("coalesce((SELECT sum(total_va_amount) FROM bc WHERE rank <= ahead_n), 0) / tot * 100", 1)} AS ahead_share_pct,
       s.break_drop_pct, s.flattens_at_rank,
       coalesce({R("(SELECT sum(total_va_amount) FROM bc WHERE rank = lead_n + 1) / tot * 100", 1)}, 0) AS next_after_leading_share_pct,
       (SELECT customer_name FROM bc WHERE rank = lead_n + 1) AS next_after_leading_name,
       {R('tot / p.customer_count', 2)} AS mean_va,
       CASE WHEN tot / p.customer_count <> 0 THEN
            {R("(SELECT CAST(total_va_amount AS DOUBLE) FROM bc WHERE rank = ahead_n + 1) / (tot / p.customer_count)", 2)} END AS first_tail_vs_mean,
       CASE WHEN (SELECT sum(total_va_amount) FROM bc WHERE rank <= lead_n) > 0 THEN
            {R("(SELECT CAST(total_va_amount AS DOUBLE) FROM bc WHERE rank = lead_n + 1) / (CAST((SELECT sum(total_va_amount) FROM bc WHERE rank <= lead_n) AS DOUBLE) / lead_n)", 2)} END AS next_vs_leading_ratio
FROM pareto p, shape s,
     (SELECT greatest(leading_count, 1) AS lead_n, greatest(tied_count, 1) AS tied_n,
             greatest(ahead_count, 1) AS ahead_n FROM shape) f,
     (SELECT CAST(sum(total_va_amount) AS DOUBLE) AS tot, CAST(max(total_va_amount) AS DOUBLE) AS v1 FROM bc) t
""", "pareto", "shape", "bc", "shape_raw")

CUST_COLS = f"""customer_id, customer_name, {R('total_sell_price')} AS total_sell_price,
       {R('total_va_amount')} AS total_va_amount, {R('total_quantity')} AS total_quantity, job_count,
       {R('avg_va_pct')} AS avg_va_pct, last_order, first_order, industry, region, rep, top_work_type,
       {R('value_share_pct')} AS value_share_pct"""

q("customer_value", f"SELECT {CUST_COLS} FROM bc WHERE rank <= 20", "bc")
q("top_work_type", "SELECT customer_id, top_work_type FROM twt", "twt")
BREAK = f"""{R(M('va_amount_base'))} AS total_va_amount, {R(M('sell_price_base'))} AS total_sell_price,
       count(job_id) AS job_count, {R('avg(va_pct)')} AS avg_va_pct"""
q("work_type_breakdown", f"SELECT work_type, {BREAK} FROM jd WHERE work_type IS NOT NULL GROUP BY work_type", "jd")
q("product_breakdown", f"""
SELECT product_type_clean AS product_type, {BREAK} FROM jd WHERE product_type_clean IS NOT NULL
GROUP BY product_type_clean ORDER BY total_va_amount DESC, product_type LIMIT 10""", "jd")
q("industry_breakdown", f"""
SELECT industry, {R(M('va_amount_base'))} AS total_va_amount, count(job_id) AS job_count,
       count(DISTINCT customer_id) AS customer_count
FROM jd WHERE industry IS NOT NULL GROUP BY industry""", "jd")
q("pareto_80", "SELECT * FROM pareto", "pareto")
q("concentration_shape", "SELECT * FROM shape", "shape")
q("concentration_summary", "SELECT * FROM conc", "conc")
q("tied_accounts", f"""
SELECT customer_id, customer_name, {R('total_va_amount')} AS total_va_amount,
       {R('(1 - CAST(total_va_amount AS DOUBLE) / (SELECT CAST(max(total_va_amount) AS DOUBLE) FROM bc)) * 100', 1)} AS below_top_pct
FROM bc WHERE total_va_amount > 0
  AND 1 - CAST(total_va_amount AS DOUBLE) / (SELECT CAST(max(total_va_amount) AS DOUBLE) FROM bc) <= 0.12""", "bc")
q("dataset_summary", f"""
SELECT count(*) AS row_count, count(DISTINCT customer_id) AS customer_count,
       {R(M('sell_price_base'))} AS total_sell_price, {R(M('va_amount_base'))} AS total_va_amount,
       {R('avg(va_pct) * 100', 1)} AS avg_va_pct, {R(M('sell_price'))} AS naive_mixed_total,
       {R(M('sell_price') + ' - ' + M('sell_price_base'))} AS naive_overstatement,
       min(sales_in) AS date_from, max(sales_in) AS date_to,
       count(*) FILTER (WHERE coalesce(currency, '') NOT IN ('Stg', 'Euro')) AS unmapped_currency_jobs,
       count(DISTINCT product_type) AS raw_product_types,
       count(DISTINCT product_type_clean) AS canonical_product_types
FROM jd""", "jd")
q("currency_split", f"""
SELECT currency, count(job_id) AS job_count, {R(M('sell_price'))} AS sell_price_native,
       {R(M('sell_price_base'))} AS sell_price_base
FROM jd WHERE currency IS NOT NULL GROUP BY currency""", "jd")
q("dataset_facts", """
SELECT count(*) AS rows, count(DISTINCT customer_id) AS customers, min(sales_in) AS period_from,
       max(sales_in) AS period_to FROM jd""", "jd")
q("dataset_profile", """
SELECT (SELECT string_agg(w, '|' ORDER BY w) FROM (SELECT DISTINCT work_type AS w FROM jd WHERE work_type IS NOT NULL)) AS work_types,
       (SELECT string_agg(i, '|' ORDER BY i) FROM (SELECT DISTINCT industry AS i FROM jd WHERE industry IS NOT NULL ORDER BY i LIMIT 12)) AS industries,
       (SELECT count(*) FROM jd) AS jobs, (SELECT count(DISTINCT customer_id) FROM jd) AS customers""", "jd")

q("customer_value_chart", f"""
SELECT b.customer_id, b.customer_name, CAST(b.rank AS BIGINT) AS rank, {R('b.total_va_amount')} AS total_va_amount,
       b.top_work_type, b.rank <= c.ahead_count AS is_ahead, c.mean_va
FROM bc b, conc c WHERE b.rank <= 20""", "bc", "conc")
