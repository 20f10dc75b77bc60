"""Churn against each customer's own rhythm."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkbook.config import DEFAULT, Config
from inkbook.operators.cadence import CUSTOMER
from inkbook.operators.common import attach, dbl, first_by_date, msum, not_null, rnd
from inkbook.operators.derive import as_of

STATUSES = ("Active", "At Risk", "Dormant")


def churn_status(jobs: DataFrame, by: Sequence[str] = (), cfg: Config = DEFAULT) -> DataFrame:
    """One row per customer. The mean gap between distinct booking dates
    telescopes to (last - first) / (dates - 1), so no per-customer arrays or
    windows are needed: a single hash aggregate."""
    cust = [*by, *CUSTOMER]
    firsts = [c for c in ("industry", "region", "rep") if c in jobs.columns and c not in by]
    agg = not_null(jobs, *cust).groupBy(*cust).agg(
        F.count_distinct("sales_in").alias("order_count"),
        F.min("sales_in").alias("_first"),
        F.max("sales_in").alias("last_order_date"),
        msum("va_amount_base").alias("_va"),
        msum("sell_price_base").alias("_sell"),
        *[first_by_date(c).alias(c) for c in firsts],
    )
    df = attach(agg, as_of(jobs, by), by)
    days = F.datediff("as_of", "last_order_date")
    relative = F.col("order_count") >= cfg.min_orders_for_cadence
    gap = F.datediff("last_order_date", "_first") / (F.col("order_count") - 1).cast("double")
    ratio = F.when(gap != 0, days / gap).otherwise(days.cast("double"))
    rel_status = (F.when(ratio <= cfg.at_risk_multiple, "Active")
                  .when(ratio <= cfg.dormant_multiple, "At Risk").otherwise("Dormant"))
    abs_status = (F.when(days <= cfg.fallback_at_risk_days, "Active")
                  .when(days <= cfg.fallback_dormant_days, "At Risk").otherwise("Dormant"))
    return df.select(
        *cust, *firsts,
        F.col("order_count").cast("bigint").alias("order_count"),
        "last_order_date",
        days.cast("bigint").alias("days_since_last_order"),
        F.when(relative, rnd(gap, 1)).alias("avg_interval_days"),
        F.when(relative, "relative").otherwise("absolute").alias("basis"),
        F.when(relative, rel_status).otherwise(abs_status).alias("status"),
        rnd("_va", 2).alias("lifetime_va_amount"),
        rnd("_sell", 2).alias("lifetime_sell_price"),
    )


def follow_up(status: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """At Risk and Dormant customers; presentation order in ``follow_up_order``."""
    return status.filter(F.col("status").isin("At Risk", "Dormant"))


def follow_up_order(by: Sequence[str] = ()):
    return [*[F.col(b) for b in by], F.col("status").asc(), F.col("lifetime_va_amount").desc(),
            F.col("customer_id").asc()]


def churn_summary(status: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    dormant = F.col("status") == "Dormant"
    return status.groupBy(*by).agg(
        F.count(F.when(F.col("status") == "Active", 1)).alias("active"),
        F.count(F.when(F.col("status") == "At Risk", 1)).alias("at_risk"),
        F.count(F.when(dormant, 1)).alias("dormant"),
        F.count(F.lit(1)).alias("customers"),
        rnd(F.coalesce(F.sum(F.when(dormant, F.col("lifetime_va_amount").cast("decimal(28,8)"))),
                       F.lit(0)), 2).alias("dormant_lifetime_value_at_stake"),
    )
