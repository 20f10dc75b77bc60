"""Turnaround against each product's own norm.

Percentiles are exact: lead time is an integer in 0..180, so the per-group
value-count buffer behind ``percentile`` has at most 181 entries whatever
the group size."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkbook.config import DEFAULT, Config
from inkbook.operators.common import attach, msum, not_null, pct_of, rnd, top_k

def _lead():
    return F.col("lead_time_days")


def measured(jobs: DataFrame) -> DataFrame:
    return jobs.filter(_lead().isNotNull())


def _stats(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.count("job_id").alias("job_count"),
        F.median(_lead()).alias("median_days"),
        F.avg(_lead()).alias("mean_days"),
        F.percentile(_lead(), 0.9).alias("p90_days"),
        msum("sell_price_base").alias("_sell"))


def turnaround_by_work_type(jobs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    s = _stats(not_null(measured(jobs), *by, "work_type"), [*by, "work_type"])
    return s.select(*by, "work_type", "job_count", rnd("median_days", 1).alias("median_days"),
                    rnd("mean_days", 1).alias("mean_days"), rnd("p90_days", 1).alias("p90_days"))


def turnaround_by_product(jobs: DataFrame, by: Sequence[str] = (), cfg: Config = DEFAULT) -> DataFrame:
    s = _stats(not_null(measured(jobs), *by, "product_type_clean"), [*by, "product_type_clean"])
    return s.filter(F.col("job_count") >= cfg.min_product_jobs).select(
        *by, F.col("product_type_clean").alias("product_type"), "job_count",
        rnd("median_days", 1).alias("median_days"), rnd("p90_days", 1).alias("p90_days"),
        rnd("_sell", 1).alias("sell_price"))


def _trend(jobs: DataFrame, by: Sequence[str]) -> DataFrame:
    return not_null(measured(jobs), *by, "month_start").groupBy(*by, "month_start").agg(
        F.median(_lead()).alias("median_days"), F.count("job_id").alias("job_count"))


def turnaround_trend(jobs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return _trend(jobs, by).select(*by, "month_start", rnd("median_days", 1).alias("median_days"),
                                   "job_count")


def slowest_vs_norm(jobs: DataFrame, by: Sequence[str] = (), cfg: Config = DEFAULT) -> DataFrame:
    """Jobs furthest over their own product's median lead time. The medians
    are a grouped aggregate joined back (one row per product)."""
    d = not_null(measured(jobs), *by, "product_type_clean")
    med = d.groupBy(*by, "product_type_clean").agg(F.median(_lead()).alias("_norm"))
    j = d.join(med, on=[*by, "product_type_clean"]).withColumn("_over", _lead() - F.col("_norm"))
    order = [F.col("_over").desc(), F.col("job_id").asc(), F.col("customer_name").asc(),
             F.col("product_type_clean").asc(), F.col("work_type").asc(), _lead().desc(),
             F.col("sell_price_base").desc()]
    top = top_k(j, order, cfg.top_slowest_jobs, by)
    return top.select(*by, "job_id", "customer_name", F.col("product_type_clean").alias("product_type"),
                      "work_type", "lead_time_days", rnd("_over", 1).alias("days_over_product_norm"),
                      rnd("sell_price_base", 1).alias("sell_price"))


def turnaround_summary(jobs: DataFrame, by: Sequence[str] = (), cfg: Config = DEFAULT) -> DataFrame:
    by = list(by)
    d = measured(jobs)
    overall = d.groupBy(*by).agg(
        F.count(F.lit(1)).alias("jobs_measured"),
        F.median(_lead()).alias("_median"), F.avg(_lead()).alias("_mean"),
        F.percentile(_lead(), 0.9).alias("_p90"))
    all_rows = jobs.groupBy(*by).agg(F.count(F.lit(1)).alias("_all"))
    wt = _stats(not_null(d, *by, "work_type"), [*by, "work_type"]).groupBy(*by).agg(
        F.min_by("work_type", F.struct("median_days", "work_type")).alias("fastest_work_type"),
        F.min("median_days").alias("_fast"),
        F.max_by("work_type", F.struct("median_days", "work_type")).alias("slowest_work_type"),
        F.max("median_days").alias("_slow"))
    tr = _trend(jobs, by)
    w = Window.partitionBy(*by).orderBy(F.col("month_start").desc())
    tr = tr.withColumn("_rn", F.row_number().over(w))
    recent = F.col("_rn") <= cfg.trend_recent_months
    trend = tr.groupBy(*by).agg(
        F.count(F.lit(1)).alias("_months"),
        F.avg(F.when(recent, F.col("median_days"))).alias("_recent"),
        F.avg(F.when(~recent, F.col("median_days"))).alias("_prior"))
    df = attach(attach(attach(overall, all_rows, by), wt, by), trend, by)
    tail = attach(d, overall.select(*by, "_p90"), by).filter(_lead() > F.col("_p90")).groupBy(*by).agg(
        F.count(F.lit(1)).alias("tail_job_count"), msum("sell_price_base").alias("_tail_sell"))
    df = attach(df, tail, by)
    change = F.when(F.col("_months") > cfg.trend_recent_months,
                    F.col("_recent") - F.col("_prior")).otherwise(F.lit(0.0))
    th = cfg.trend_direction_days
    return df.select(
        *by, "jobs_measured", pct_of("jobs_measured", "_all", 1).alias("coverage_pct"),
        rnd("_median", 1).alias("median_days"), rnd("_mean", 1).alias("mean_days"),
        rnd("_p90", 1).alias("p90_days"),
        "fastest_work_type", rnd("_fast", 1).alias("fastest_median_days"),
        "slowest_work_type", rnd("_slow", 1).alias("slowest_median_days"),
        rnd(change, 1).alias("recent_vs_prior_days"),
        F.when(change > th, "slower").when(change < -th, "faster").otherwise("stable").alias("direction"),
        F.coalesce(F.col("tail_job_count"), F.lit(0)).cast("bigint").alias("tail_job_count"),
        rnd(F.coalesce(F.col("_tail_sell"), F.lit(0))).alias("tail_job_value"),
    )
