"""Oracle SQL: repeat work, pricing, delivery."""
from inkbook.plans.oracle import FIRST, M, R, cte, q

# --- repeat work ------------------------------------------------------------
cte("titles", f"""
SELECT customer_id, customer_name, job_id, count(sales_in) AS print_runs,
       min(sales_in) AS first_run, max(sales_in) AS last_run,
       {M('sell_price_base')} AS total_sell, {M('va_amount_base')} AS total_va, {M('quantity')} AS total_quantity,
       {FIRST('product_type_clean')} AS product_type
FROM jd WHERE customer_id IS NOT NULL AND customer_name IS NOT NULL AND job_id IS NOT NULL
GROUP BY customer_id, customer_name, job_id
""", "jd")

cte("rep", f"""
SELECT *, CAST(days_since_last_run AS DOUBLE) / nullif(avg_cycle_days, 0) AS cycles_overdue,
       CAST(total_sell AS DOUBLE) / print_runs AS avg_value_per_run
FROM (SELECT *, {R("date_diff('day', first_run, last_run) / CAST(print_runs - 1 AS DOUBLE)", 1)} AS avg_cycle_days,
             date_diff('day', last_run, (SELECT as_of FROM asofd)) AS days_since_last_run
      FROM titles WHERE print_runs > 1) t
""", "titles", "asofd")

TITLE_COLS = f"""customer_id, customer_name, job_id, print_runs, first_run, last_run,
       {R('total_sell')} AS total_sell, {R('total_va')} AS total_va, {R('total_quantity')} AS total_quantity,
       product_type, {R('avg_cycle_days')} AS avg_cycle_days, days_since_last_run,
       {R('cycles_overdue')} AS cycles_overdue, {R('avg_value_per_run')} AS avg_value_per_run,
       job_id || ' · ' || customer_name AS title_label"""

q("title_runs", f"""
SELECT customer_id, customer_name, job_id, print_runs, first_run, last_run, {R('total_sell')} AS total_sell,
       {R('total_va')} AS total_va, {R('total_quantity')} AS total_quantity, product_type FROM titles""", "titles")
q("repeat_titles", f"""
SELECT {TITLE_COLS} FROM rep ORDER BY total_sell DESC, customer_id, customer_name, job_id LIMIT 20""", "rep")
q("due_for_reprint", f"""
SELECT {TITLE_COLS} FROM rep WHERE cycles_overdue >= 1 AND avg_cycle_days >= 30
ORDER BY avg_value_per_run DESC, customer_id, customer_name, job_id LIMIT 20""", "rep")
q("repeat_by_product", f"""
SELECT product_type, count(job_id) AS titles, {R("sum(total_sell)")} AS total_sell, CAST(sum(print_runs) AS BIGINT) AS runs
FROM rep WHERE product_type IS NOT NULL GROUP BY product_type
ORDER BY sum(total_sell) DESC, product_type LIMIT 8""", "rep")
q("repeat_summary", f"""
SELECT a.distinct_titles, coalesce(r.repeat_titles, 0) AS repeat_titles, a.one_off_titles,
       {R('coalesce(r.repeat_titles, 0) / a.distinct_titles * 100', 1)} AS repeat_title_pct,
       {R('coalesce(r.rep_sell, 0)')} AS repeat_revenue,
       CASE WHEN a.all_sell <> 0 THEN {R('CAST(coalesce(r.rep_sell, 0) AS DOUBLE) / CAST(a.all_sell AS DOUBLE) * 100', 1)} ELSE 0 END AS repeat_revenue_pct,
       coalesce({R('r.avg_runs', 1)}, 0) AS avg_runs_per_repeat_title,
       coalesce(r.max_runs, 0) AS max_runs, coalesce(r.due, 0) AS titles_due_reprint,
       {R('coalesce(r.pipe, 0)')} AS reprint_pipeline_value
FROM (SELECT count(*) AS distinct_titles, count(*) FILTER (WHERE print_runs = 1) AS one_off_titles,
             sum(total_sell) AS all_sell FROM titles) a,
     (SELECT count(*) AS repeat_titles, sum(total_sell) AS rep_sell, avg(print_runs) AS avg_runs,
             max(print_runs) AS max_runs,
             count(*) FILTER (WHERE cycles_overdue >= 1 AND avg_cycle_days >= 30) AS due,
             sum(CAST(avg_value_per_run AS DECIMAL(28,8))) FILTER (WHERE cycles_overdue >= 1 AND avg_cycle_days >= 30) AS pipe
      FROM rep) r""", "titles", "rep")

# --- pricing ------------------------------------------------------------------
def disc(key: str) -> str:
    return f"""
SELECT {key} AS k, abs({M('manual_adjustment_base')} FILTER (WHERE manual_adjustment_base < 0)) AS disc,
       count(job_id) FILTER (WHERE manual_adjustment_base < 0) AS discounted_jobs,
       count(job_id) AS all_jobs, {M('sell_price_base')} AS sell
FROM jd WHERE {key} IS NOT NULL GROUP BY {key}
HAVING count(*) FILTER (WHERE manual_adjustment_base < 0) > 0"""


cte("disc_customer", disc("customer_name"), "jd")
cte("disc_rep", disc("rep"), "jd")
cte("disc_work_type", disc("work_type"), "jd")

DISC_COLS = f"""{R('disc')} AS discount_total, discounted_jobs, all_jobs, {R('sell')} AS sell_total,
       {R("coalesce(CAST(disc AS DOUBLE) / nullif(CAST(sell AS DOUBLE), 0) * 100, 0)")} AS discount_as_pct_of_sales"""
q("discount_by_customer", f"SELECT k AS customer_name, {DISC_COLS} FROM disc_customer ORDER BY disc DESC, k LIMIT 12",
  "disc_customer")
q("discount_by_rep", f"SELECT k AS name, {DISC_COLS} FROM disc_rep", "disc_rep")
q("discount_by_work_type", f"SELECT k AS name, {DISC_COLS} FROM disc_work_type", "disc_work_type")

cte("below", f"""
SELECT customer_name, count(job_id) AS job_count, {M('va_amount_base')} AS va, {M('sell_price_base')} AS sell
FROM jd WHERE is_below_cost AND customer_name IS NOT NULL GROUP BY customer_name
""", "jd")
q("below_cost_by_customer", f"""
SELECT customer_name, job_count, {R('va')} AS va_amount, {R('sell')} AS sell_price
FROM below ORDER BY va, customer_name LIMIT 12""", "below")

q("pricing_summary", f"""
SELECT total_jobs, overridden_jobs, {R('overridden_jobs / total_jobs * 100', 1)} AS overridden_pct,
       discounted_jobs, uplifted_jobs, {R('abs(d)')} AS discount_total, {R('u')} AS uplift_total,
       {R('u + d')} AS net_adjustment,
       CASE WHEN sell <> 0 THEN {R('CAST(abs(d) AS DOUBLE) / CAST(sell AS DOUBLE) * 100', 2)} ELSE 0 END AS discount_as_pct_of_sales,
       below_cost_jobs, {R('bva')} AS below_cost_va, low_margin_jobs,
       {R('low_margin_jobs / total_jobs * 100', 1)} AS low_margin_pct, {R('lm')} AS low_margin_sell_value,
       (SELECT first(customer_name ORDER BY va, customer_name) FROM below) AS worst_below_cost_customer,
       CASE WHEN (SELECT count(*) FROM below) > 0 AND bva <> 0
            THEN {R('CAST((SELECT min(va) FROM below) AS DOUBLE) / CAST(bva AS DOUBLE) * 100', 1)} ELSE 0 END AS worst_below_cost_share_pct,
       (SELECT first(k ORDER BY disc DESC, k) FROM disc_customer) AS top_discount_customer,
       coalesce({R('(SELECT max(disc) FROM disc_customer)')}, 0) AS top_discount_amount,
       CASE WHEN d <> 0 THEN {R('CAST(u AS DOUBLE) / CAST(abs(d) AS DOUBLE)', 2)} END AS uplift_to_discount_ratio
FROM (SELECT count(*) AS total_jobs,
             count(*) FILTER (WHERE manual_adjustment_base <> 0) AS overridden_jobs,
             count(*) FILTER (WHERE manual_adjustment_base < 0) AS discounted_jobs,
             count(*) FILTER (WHERE manual_adjustment_base > 0) AS uplifted_jobs,
             coalesce({M('manual_adjustment_base')} FILTER (WHERE manual_adjustment_base < 0), 0) AS d,
             coalesce({M('manual_adjustment_base')} FILTER (WHERE manual_adjustment_base > 0), 0) AS u,
             {M('sell_price_base')} AS sell,
             count(*) FILTER (WHERE is_below_cost) AS below_cost_jobs,
             coalesce({M('va_amount_base')} FILTER (WHERE is_below_cost), 0) AS bva,
             count(*) FILTER (WHERE is_low_margin) AS low_margin_jobs,
             coalesce({M('sell_price_base')} FILTER (WHERE is_low_margin), 0) AS lm
      FROM jd) t""", "jd", "below", "disc_customer")

# --- delivery -----------------------------------------------------------------
cte("dm", "SELECT * FROM jd WHERE lead_time_days IS NOT NULL", "jd")
q("turnaround_by_work_type", f"""
SELECT work_type, count(job_id) AS job_count, {R('median(lead_time_days)', 1)} AS median_days,
       {R('avg(lead_time_days)', 1)} AS mean_days, {R('quantile_cont(lead_time_days, 0.9)', 1)} AS p90_days
FROM dm WHERE work_type IS NOT NULL GROUP BY work_type""", "dm")
q("turnaround_by_product", f"""
SELECT product_type_clean AS product_type, count(job_id) AS job_count,
       {R('median(lead_time_days)', 1)} AS median_days, {R('quantile_cont(lead_time_days, 0.9)', 1)} AS p90_days,
       {R(M('sell_price_base'), 1)} AS sell_price
FROM dm WHERE product_type_clean IS NOT NULL GROUP BY product_type_clean HAVING count(job_id) >= 20""", "dm")
cte("trend", """
SELECT month_start, median(lead_time_days) AS median_days, count(job_id) AS job_count,
       row_number() OVER (ORDER BY month_start DESC) AS rn
FROM dm WHERE month_start IS NOT NULL GROUP BY month_start
""", "dm")
q("turnaround_trend", f"SELECT month_start, {R('median_days', 1)} AS median_days, job_count FROM trend", "trend")
q("slowest_vs_norm", f"""
SELECT job_id, customer_name, pt AS product_type, work_type, lead_time_days,
       {R('over', 1)} AS days_over_product_norm, {R('sell_price_base', 1)} AS sell_price
FROM (SELECT d.job_id, d.customer_name, d.work_type, d.lead_time_days, d.sell_price_base,
             d.product_type_clean AS pt, d.lead_time_days - m.norm AS over
      FROM dm d JOIN (SELECT product_type_clean, median(lead_time_days) AS norm FROM dm
                      WHERE product_type_clean IS NOT NULL GROUP BY 1) m USING (product_type_clean)) t
ORDER BY over DESC, job_id, customer_name, pt, work_type, lead_time_days DESC, sell_price_base DESC
LIMIT 15""", "dm")
cte("wt_stats", """
SELECT work_type, median(lead_time_days) AS med FROM dm WHERE work_type IS NOT NULL GROUP BY work_type
""", "dm")
q("turnaround_summary", f"""
SELECT o.jobs_measured, {R('o.jobs_measured / (SELECT count(*) FROM jd) * 100', 1)} AS coverage_pct,
       {R('o.med', 1)} AS median_days, {R('o.mean', 1)} AS mean_days, {R('o.p90', 1)} AS p90_days,
       (SELECT first(work_type ORDER BY med, work_type) FROM wt_stats) AS fastest_work_type,
       {R('(SELECT min(med) FROM wt_stats)', 1)} AS fastest_median_days,
       (SELECT first(work_type ORDER BY med DESC, work_type DESC) FROM wt_stats) AS slowest_work_type,
       {R('(SELECT max(med) FROM wt_stats)', 1)} AS slowest_median_days,
       {R('t.change', 1)} AS recent_vs_prior_days,
       CASE WHEN t.change > 0.5 THEN 'slower' WHEN t.change < -0.5 THEN 'faster' ELSE 'stable' END AS direction,
       (SELECT count(*) FROM dm WHERE lead_time_days > o.p90) AS tail_job_count,
       {R("coalesce((SELECT " + M('sell_price_base') + " FROM dm WHERE lead_time_days > o.p90), 0)")} AS tail_job_value
FROM (SELECT count(*) AS jobs_measured, median(lead_time_days) AS med, avg(lead_time_days) AS mean,
             quantile_cont(lead_time_days, 0.9) AS p90 FROM dm) o,
     (SELECT CASE WHEN count(*) > 6 THEN avg(median_days) FILTER (WHERE rn <= 6)
                  - avg(median_days) FILTER (WHERE rn > 6) ELSE 0 END AS change FROM trend) t""",
  "jd", "dm", "wt_stats", "trend")
