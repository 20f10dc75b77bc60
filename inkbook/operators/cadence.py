"""Order events and cadence (O1, O2), shared by reorder and churn.

An order event is one (customer, booking date). Pre-aggregating to events
bounds every per-customer window by the number of distinct days, however
many jobs a hot customer books."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkbook.config import DEFAULT, Config
from inkbook.operators.common import dbl, msum, not_null

CUSTOMER = ("customer_id", "customer_name")


def order_events(jobs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    keys = [*by, *CUSTOMER, "sales_in"]
    return (not_null(jobs, *keys).groupBy(*keys)
            .agg(dbl(msum("sell_price_base")).alias("order_value"),
                 dbl(msum("va_amount_base")).alias("order_va")))


def order_cadence(jobs: DataFrame, by: Sequence[str] = (), cfg: Config = DEFAULT) -> DataFrame:
    """Per customer: events, mean and population std of the gaps between
    events, their CV, last event date, mean event value and the mean of the
    last ``recent_orders`` events."""
    ev = order_events(jobs, by)
    cust = [*by, *CUSTOMER]
    w = Window.partitionBy(*cust).orderBy("sales_in")
    wd = Window.partitionBy(*cust).orderBy(F.col("sales_in").desc())
    ev = ev.withColumns({
        "_gap": F.datediff("sales_in", F.lag("sales_in").over(w)).cast("double"),
        "_rn": F.row_number().over(wd),
    })
    n = F.count(F.lit(1))
    agg = ev.groupBy(*cust).agg(
        n.alias("order_count"),
        F.min("sales_in").alias("first_order_date"),
        F.max("sales_in").alias("last_order_date"),
        F.avg("_gap").alias("mean_gap"),
        F.stddev_pop("_gap").alias("std_gap"),
        (dbl(msum("order_value")) / n).alias("avg_order_value"),
        (dbl(msum(F.when(F.col("_rn") <= cfg.recent_orders, F.col("order_value"))))
         / F.count(F.when(F.col("_rn") <= cfg.recent_orders, 1))).alias("recent_value"),
    )
    return agg.withColumn(
        "cv", F.when(F.col("mean_gap") != 0,
                     F.coalesce(F.col("std_gap"), F.lit(0.0)) / F.col("mean_gap")).otherwise(F.lit(0.0)))
