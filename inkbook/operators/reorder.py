"""Reorder forecast (O3, O4): when each customer should next order, and
what it is likely to be worth."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkbook.config import DEFAULT, Config
from inkbook.functions.fmt import cadence_label, expected_label
from inkbook.operators.cadence import CUSTOMER, order_cadence
from inkbook.operators.common import attach, rnd
from inkbook.operators.derive import as_of

INSUFFICIENT = "Insufficient history"


def reorder_forecast(jobs: DataFrame, by: Sequence[str] = (), cfg: Config = DEFAULT) -> DataFrame:
    cad = attach(order_cadence(jobs, by, cfg), as_of(jobs, by), by)
    ok = F.col("order_count") >= cfg.min_orders_for_prediction
    step = F.bround("mean_gap", 0).cast("int")
    nxt = F.date_add("last_order_date", step)
    until = F.datediff(nxt, "as_of").cast("bigint")
    regularity = (F.when(F.col("cv") < cfg.regular_cv, "Regular")
                  .when(F.col("cv") < cfg.variable_cv, "Variable").otherwise("Irregular"))
    status = (F.when(until < 0, "Overdue")
              .when(until <= cfg.due_soon_days, "Due soon").otherwise("On track"))
    return cad.select(
        *by, *CUSTOMER,
        F.col("order_count").cast("bigint").alias("order_count"),
        F.when(ok, rnd("mean_gap", 1)).alias("avg_interval_days"),
        F.when(ok, regularity).otherwise(INSUFFICIENT).alias("regularity"),
        "last_order_date",
        F.when(ok, nxt).alias("predicted_next_order_date"),
        F.when(ok, until).alias("days_until_predicted"),
        rnd("avg_order_value", 2).alias("avg_order_value"),
        F.when(ok, rnd("recent_value", 2)).alias("predicted_next_order_value"),
        F.when(ok, status).otherwise(INSUFFICIENT).alias("status"),
    )


def reorder_order(by: Sequence[str] = ()):
    """Presentation order: predictable customers soonest first, then the rest."""
    return [*[F.col(b) for b in by], (F.col("status") == INSUFFICIENT).asc(),
            F.col("days_until_predicted").asc(), F.col("customer_id").asc(), F.col("customer_name").asc()]


def reorder_summary(forecast: DataFrame, by: Sequence[str] = (), cfg: Config = DEFAULT) -> DataFrame:
    pred = F.col("status") != INSUFFICIENT
    window = pred & F.col("days_until_predicted").between(cfg.overdue_floor_days, cfg.forecast_horizon_days)
    return forecast.groupBy(*by).agg(
        F.count(F.when(pred, 1)).alias("predictable_customers"),
        F.count(F.when(F.col("status") == "Overdue", 1)).alias("overdue_count"),
        F.count(F.when(F.col("status") == "Due soon", 1)).alias("due_soon_count"),
        rnd(F.coalesce(F.sum(F.when(window, F.col("predicted_next_order_value").cast("decimal(28,8)"))),
                       F.lit(0)), 2).alias("expected_value_next_30_days"),
    )


def reorder_labels(forecast: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The forecast as its table reads: cadence and expected date as text."""
    return forecast.select(*by, *CUSTOMER, "order_count", cadence_label("avg_interval_days", "regularity").alias("cadence"),
                           "last_order_date",
                           expected_label("predicted_next_order_date", "days_until_predicted").alias("expected"), "status")
