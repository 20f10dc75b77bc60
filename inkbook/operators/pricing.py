"""Pricing discipline and margin integrity (P1–P4). Every breakdown is one
conditional aggregate per group: cut totals and all-job totals in one pass."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkbook.config import DEFAULT, Config
from inkbook.operators.common import attach, msum, not_null, pct_of, rnd, top_k

def _adj():
    return F.col("manual_adjustment_base")


def _discounts(jobs: DataFrame, key: str, by: Sequence[str]) -> DataFrame:
    cut = _adj() < 0
    agg = not_null(jobs, *by, key).groupBy(*by, key).agg(
        F.abs(msum(F.when(cut, _adj()))).alias("_disc"),
        F.count(F.when(cut, F.col("job_id"))).alias("discounted_jobs"),
        F.count(F.when(cut, 1)).alias("_cut_rows"),
        F.count("job_id").alias("all_jobs"),
        msum("sell_price_base").alias("_sell"))
    return agg.filter(F.col("_cut_rows") > 0).drop("_cut_rows")


def _present(df: DataFrame, key: str, by: Sequence[str], name: str) -> DataFrame:
    return df.select(*by, F.col(key).alias(name), rnd("_disc").alias("discount_total"), "discounted_jobs",
                     "all_jobs", rnd("_sell").alias("sell_total"),
                     rnd(pct_of("_disc", "_sell")).alias("discount_as_pct_of_sales"))


def discount_by_customer(jobs: DataFrame, by: Sequence[str] = (), cfg: Config = DEFAULT) -> DataFrame:
    d = _discounts(jobs, "customer_name", by)
    top = top_k(d, [F.col("_disc").desc(), F.col("customer_name").asc()], cfg.top_pricing, by)
    return _present(top, "customer_name", by, "customer_name")


def discount_by_bucket(jobs: DataFrame, key: str, by: Sequence[str] = ()) -> DataFrame:
    """Any dimension (rep, work type): every group with a cut."""
    return _present(_discounts(jobs, key, by), key, by, "name")


def below_cost_by_customer_all(jobs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return not_null(jobs.filter(F.col("is_below_cost")), *by, "customer_name") \
        .groupBy(*by, "customer_name").agg(
            F.count("job_id").alias("job_count"),
            msum("va_amount_base").alias("_va"),
            msum("sell_price_base").alias("_sell"))


def below_cost_by_customer(jobs: DataFrame, by: Sequence[str] = (), cfg: Config = DEFAULT) -> DataFrame:
    b = below_cost_by_customer_all(jobs, by)
    top = top_k(b, [F.col("_va").asc(), F.col("customer_name").asc()], cfg.top_pricing, by)
    return top.select(*by, "customer_name", "job_count", rnd("_va").alias("va_amount"),
                      rnd("_sell").alias("sell_price"))


def pricing_summary(jobs: DataFrame, by: Sequence[str] = (), cfg: Config = DEFAULT) -> DataFrame:
    main = jobs.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total_jobs"),
        F.count(F.when(_adj() != 0, 1)).alias("overridden_jobs"),
        F.count(F.when(_adj() < 0, 1)).alias("discounted_jobs"),
        F.count(F.when(_adj() > 0, 1)).alias("uplifted_jobs"),
        F.coalesce(msum(F.when(_adj() < 0, _adj())), F.lit(0)).alias("_disc"),
        F.coalesce(msum(F.when(_adj() > 0, _adj())), F.lit(0)).alias("_upl"),
        msum("sell_price_base").alias("_sell"),
        F.count(F.when(F.col("is_below_cost"), 1)).alias("below_cost_jobs"),
        F.coalesce(msum(F.when(F.col("is_below_cost"), F.col("va_amount_base"))), F.lit(0)).alias("_bva"),
        F.count(F.when(F.col("is_low_margin"), 1)).alias("low_margin_jobs"),
        F.coalesce(msum(F.when(F.col("is_low_margin"), F.col("sell_price_base"))), F.lit(0)).alias("_lm_sell"),
    )
    worst = below_cost_by_customer_all(jobs, by).groupBy(*by).agg(
        F.min_by("customer_name", F.struct("_va", "customer_name")).alias("worst_below_cost_customer"),
        F.min("_va").alias("_worst_va"))
    top_disc = _discounts(jobs, "customer_name", by).groupBy(*by).agg(
        F.min_by("customer_name", F.struct(-F.col("_disc"), F.col("customer_name"))).alias("top_discount_customer"),
        F.max("_disc").alias("_top_disc"))
    df = attach(attach(main, worst, by), top_disc, by)
    return df.select(
        *by, "total_jobs", "overridden_jobs", pct_of("overridden_jobs", "total_jobs", 1).alias("overridden_pct"),
        "discounted_jobs", "uplifted_jobs",
        rnd(F.abs("_disc")).alias("discount_total"), rnd("_upl").alias("uplift_total"),
        rnd(F.col("_upl") + F.col("_disc")).alias("net_adjustment"),
        pct_of(F.abs("_disc"), "_sell", 2).alias("discount_as_pct_of_sales"),
        "below_cost_jobs", rnd("_bva").alias("below_cost_va"),
        "low_margin_jobs", pct_of("low_margin_jobs", "total_jobs", 1).alias("low_margin_pct"),
        rnd("_lm_sell").alias("low_margin_sell_value"),
        "worst_below_cost_customer",
        F.when(F.col("worst_below_cost_customer").isNotNull(), pct_of("_worst_va", "_bva", 1))
        .otherwise(0.0).alias("worst_below_cost_share_pct"),
        "top_discount_customer",
        F.coalesce(rnd("_top_disc"), F.lit(0.0)).alias("top_discount_amount"),
        # How closely uplifts offset reductions (the published text asserts it).
        F.when(F.col("_disc") != 0, rnd(F.col("_upl").cast("double") / F.abs("_disc").cast("double"), 2)).alias("uplift_to_discount_ratio"),
    )
