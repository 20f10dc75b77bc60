"""Build a whole report: every mart as a lazy DataFrame over one shared,
persisted derived-jobs frame, optionally for many reports at once via ``by``.

The derived frame is persisted MEMORY_AND_DISK (recomputable from lineage if
an executor is lost). Catalyst plans each mart; nothing reaches the driver."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame

from inkbook.config import DEFAULT, Config
from inkbook.operators import (cadence, churn, delivery, findings, pricing, quote, reorder, repeat, season,
                               value)
from inkbook.operators.derive import derive
from inkbook.session import ensure_checkpoint_dir


def prepare(jobs: DataFrame, cfg: Config = DEFAULT, by: Sequence[str] = (), reliable: bool = False) -> DataFrame:
    """The derived jobs frame every mart reads, computed once.

    ``reliable=True`` writes it to the cluster's shared checkpoint folder
    (``spark.checkpoint.dir``; a scratch folder is made only when the session
    names none), cutting the lineage so a lost executor never re-runs the
    upstream joins. Otherwise it is persisted MEMORY_AND_DISK, which is
    recomputed from lineage if blocks are lost."""
    df = derive(jobs, cfg, by)
    if reliable:
        ensure_checkpoint_dir(df.sparkSession)
        return df.checkpoint(eager=True)
    return df.persist(StorageLevel.MEMORY_AND_DISK)


def build_report(jd: DataFrame, cfg: Config = DEFAULT, by: Sequence[str] = ()) -> dict[str, DataFrame]:
    """All marts for the derived jobs frame ``jd`` (from ``prepare``)."""
    by = list(by)
    bc = value.by_customer(jd, by)
    status = churn.churn_status(jd, by, cfg)
    fc = reorder.reorder_forecast(jd, by, cfg)
    split = quote.holdout_split(quote.price_features(jd, by), cfg)
    base = quote.comparable_baseline(split, by)
    areas = findings.area_marts(jd, by, cfg, base=base, split=split)
    return {
        "dataset_summary": value.dataset_summary(jd, by),
        "currency_split": value.currency_split(jd, by),
        "customer_value": value.customer_value(jd, by, cfg),
        "work_type_breakdown": value.work_type_breakdown(jd, by),
        "product_breakdown": value.product_breakdown(jd, by, cfg),
        "industry_breakdown": value.industry_breakdown(jd, by),
        "concentration_summary": value.concentration_summary(bc, by, cfg),
        "repeat_titles": repeat.repeat_titles(jd, by, cfg),
        "due_for_reprint": repeat.due_for_reprint(jd, by, cfg),
        "repeat_by_product": repeat.repeat_by_product(jd, by, cfg),
        "repeat_summary": repeat.repeat_summary(jd, by, cfg),
        "order_events": cadence.order_events(jd, by),
        "reorder_forecast": fc,
        "reorder_summary": reorder.reorder_summary(fc, by, cfg),
        "churn_status": status,
        "follow_up": churn.follow_up(status, by),
        "churn_summary": churn.churn_summary(status, by),
        "pricing_summary": pricing.pricing_summary(jd, by, cfg),
        "discount_by_customer": pricing.discount_by_customer(jd, by, cfg),
        "discount_by_rep": pricing.discount_by_bucket(jd, "rep", by),
        "discount_by_work_type": pricing.discount_by_bucket(jd, "work_type", by),
        "below_cost_by_customer": pricing.below_cost_by_customer(jd, by, cfg),
        "monthly_series": season.monthly_series(jd, by),
        "seasonal_index": season.seasonal_index(jd, by),
        "seasonal_forecast": season.seasonal_forecast(jd, by, cfg),
        "forecast_backtest": season.forecast_backtest(jd, by, cfg),
        "peak_month_mix": season.peak_month_mix(jd, by, cfg),
        "seasonality_summary": season.seasonality_summary(jd, by, cfg),
        "turnaround_by_work_type": delivery.turnaround_by_work_type(jd, by),
        "turnaround_by_product": delivery.turnaround_by_product(jd, by, cfg),
        "turnaround_trend": delivery.turnaround_trend(jd, by),
        "slowest_vs_norm": delivery.slowest_vs_norm(jd, by, cfg),
        "turnaround_summary": delivery.turnaround_summary(jd, by, cfg),
        "benchmark_metrics": quote.benchmark_metrics(base, split, by),
        "underpriced_jobs": quote.underpriced_jobs(base, by, cfg),
        "underpriced_summary": quote.underpriced_summary(base, by, cfg),
        "at_stake": findings.at_stake(jd, by, cfg, marts=areas),
        "executive_findings": findings.executive_findings(jd, by, cfg, marts=areas),
        "brief_metrics": findings.brief_metrics(jd, by, cfg, marts=areas),
        "brief_breakdown": findings.brief_breakdown(jd, by, cfg, marts=areas),
        "pareto_80": value.pareto_80(bc, by),
        "tied_accounts": value.tied_accounts(bc, by, cfg),
        "concentration_shape": value.concentration_shape(bc, by, cfg),
        "dataset_facts": value.dataset_facts(jd, by),
    }
