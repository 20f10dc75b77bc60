"""Query registry: one callable (spark, sf_dir) -> DataFrame per query key.

Each query reads the driver tables through the fixture views and runs the
mart over the whole data."""
from __future__ import annotations

import hashlib
import weakref
from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkbook.config import DEFAULT
from inkbook.operators import churn, reorder
from inkbook.operators.cadence import order_cadence, order_events
from inkbook.operators.common import rnd
from inkbook.operators.derive import derive
from inkbook.session import ensure_checkpoint_dir
from inkbook.sources.fixtures import as_jobs, job_rows, jobs_view

QueryFn = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, QueryFn] = {}


def register(key: str):
    def deco(fn: QueryFn) -> QueryFn:
        REGISTRY[key] = fn
        return fn
    return deco


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derived jobs. Every query derives its own, so its plan prunes
    columns and pushes filters down to the tables, and building a query runs
    nothing."""
    return derive(jobs_view(spark, sf_dir))


def reading_once(source: DataFrame, build: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``build(source)`` for results that read ``source`` many times: it is
    persisted when the result is first computed (lost blocks come back from the
    lineage) and let go together with the result, so the tables are scanned and
    joined once and nothing is shared between queries."""
    kept = source.persist(StorageLevel.MEMORY_AND_DISK)
    result = build(kept)
    weakref.finalize(result, kept.unpersist).atexit = False
    return result


#: What the findings and briefs read of the tables: the jobs' other columns
#: follow from these, so they are not kept beside them.
FINDING_ROWS = ["is_test", "c_custkey", "c_name", "r_name", "p_brand", "p_type", "p_size", "p_retailprice", "product_type",
                "product_type_clean", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "_placed", "_ship"]


def finding_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return job_rows(spark, sf_dir, quote.holdout_split).select(*FINDING_ROWS)


def finding_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(as_jobs(finding_rows(spark, sf_dir)))


@register("order_events")
def q_order_events(spark, sf_dir):
    return order_events(jobs(spark, sf_dir))


@register("order_cadence")
def q_order_cadence(spark, sf_dir):
    c = order_cadence(jobs(spark, sf_dir))
    return c.select("customer_id", "customer_name", F.col("order_count").cast("bigint").alias("order_count"),
                    "first_order_date", "last_order_date",
                    rnd("mean_gap", 4).alias("mean_gap"), rnd("std_gap", 4).alias("std_gap"),
                    rnd("avg_order_value", 2).alias("avg_order_value"),
                    rnd("recent_value", 2).alias("recent_value"))


@register("reorder_forecast")
def q_reorder_forecast(spark, sf_dir):
    return reorder.reorder_forecast(jobs(spark, sf_dir))


@register("reorder_labels")
def q_reorder_labels(spark, sf_dir):
    return reorder.reorder_labels(q_reorder_forecast(spark, sf_dir))


@register("reorder_summary")
def q_reorder_summary(spark, sf_dir):
    return reorder.reorder_summary(q_reorder_forecast(spark, sf_dir))


@register("churn_status")
def q_churn_status(spark, sf_dir):
    return churn.churn_status(jobs(spark, sf_dir))


@register("follow_up")
def q_follow_up(spark, sf_dir):
    return churn.follow_up(churn.churn_status(jobs(spark, sf_dir)))


@register("churn_summary")
def q_churn_summary(spark, sf_dir):
    return churn.churn_summary(churn.churn_status(jobs(spark, sf_dir)))


# --- customer value and dataset summary ------------------------------------
from inkbook.operators import value  # noqa: E402


@register("customer_value")
def q_customer_value(spark, sf_dir):
    return value.customer_value(jobs(spark, sf_dir))


@register("customer_value_chart")
def q_customer_value_chart(spark, sf_dir):
    return value.customer_value_chart(jobs(spark, sf_dir))


@register("top_work_type")
def q_top_work_type(spark, sf_dir):
    return value.top_work_type(jobs(spark, sf_dir))


@register("work_type_breakdown")
def q_work_type_breakdown(spark, sf_dir):
    return value.work_type_breakdown(jobs(spark, sf_dir))


@register("product_breakdown")
def q_product_breakdown(spark, sf_dir):
    return value.product_breakdown(jobs(spark, sf_dir))


@register("industry_breakdown")
def q_industry_breakdown(spark, sf_dir):
    return value.industry_breakdown(jobs(spark, sf_dir))


@register("pareto_80")
def q_pareto_80(spark, sf_dir):
    return value.pareto_80(value.by_customer(jobs(spark, sf_dir)))


@register("concentration_shape")
def q_concentration_shape(spark, sf_dir):
    return value.concentration_shape(value.by_customer(jobs(spark, sf_dir)))


@register("concentration_summary")
def q_concentration_summary(spark, sf_dir):
    return value.concentration_summary(value.by_customer(jobs(spark, sf_dir)))


@register("tied_accounts")
def q_tied_accounts(spark, sf_dir):
    return value.tied_accounts(value.by_customer(jobs(spark, sf_dir)))


@register("dataset_summary")
def q_dataset_summary(spark, sf_dir):
    return value.dataset_summary(jobs(spark, sf_dir))


@register("currency_split")
def q_currency_split(spark, sf_dir):
    return value.currency_split(jobs(spark, sf_dir))


@register("dataset_facts")
def q_dataset_facts(spark, sf_dir):
    return value.dataset_facts(jobs(spark, sf_dir))


@register("dataset_profile")
def q_dataset_profile(spark, sf_dir):
    return value.dataset_profile(jobs(spark, sf_dir))


# --- repeat work, pricing, delivery ---------------------------------------------
from inkbook.operators import delivery, pricing, repeat  # noqa: E402


@register("title_runs")
def q_title_runs(spark, sf_dir):
    t = repeat.title_runs(jobs(spark, sf_dir))
    return t.select("customer_id", "customer_name", "job_id", "print_runs", "first_run", "last_run",
                    rnd("total_sell").alias("total_sell"), rnd("total_va").alias("total_va"),
                    rnd("total_quantity").alias("total_quantity"), "product_type")


@register("repeat_titles")
def q_repeat_titles(spark, sf_dir):
    return repeat.repeat_titles(jobs(spark, sf_dir))


@register("due_for_reprint")
def q_due_for_reprint(spark, sf_dir):
    return repeat.due_for_reprint(jobs(spark, sf_dir))


@register("repeat_by_product")
def q_repeat_by_product(spark, sf_dir):
    return repeat.repeat_by_product(jobs(spark, sf_dir))


@register("repeat_summary")
def q_repeat_summary(spark, sf_dir):
    return repeat.repeat_summary(jobs(spark, sf_dir))


@register("pricing_summary")
def q_pricing_summary(spark, sf_dir):
    return pricing.pricing_summary(jobs(spark, sf_dir))


@register("discount_by_customer")
def q_discount_by_customer(spark, sf_dir):
    return pricing.discount_by_customer(jobs(spark, sf_dir))


@register("discount_by_rep")
def q_discount_by_rep(spark, sf_dir):
    return pricing.discount_by_bucket(jobs(spark, sf_dir), "rep")


@register("discount_by_work_type")
def q_discount_by_work_type(spark, sf_dir):
    return pricing.discount_by_bucket(jobs(spark, sf_dir), "work_type")


@register("below_cost_by_customer")
def q_below_cost_by_customer(spark, sf_dir):
    return pricing.below_cost_by_customer(jobs(spark, sf_dir))


@register("turnaround_by_work_type")
def q_turnaround_by_work_type(spark, sf_dir):
    return delivery.turnaround_by_work_type(jobs(spark, sf_dir))


@register("turnaround_by_product")
def q_turnaround_by_product(spark, sf_dir):
    return delivery.turnaround_by_product(jobs(spark, sf_dir))


@register("turnaround_trend")
def q_turnaround_trend(spark, sf_dir):
    return delivery.turnaround_trend(jobs(spark, sf_dir))


@register("slowest_vs_norm")
def q_slowest_vs_norm(spark, sf_dir):
    return delivery.slowest_vs_norm(jobs(spark, sf_dir))


@register("turnaround_summary")
def q_turnaround_summary(spark, sf_dir):
    return delivery.turnaround_summary(jobs(spark, sf_dir))


# --- seasonality ------------------------------------------------------------------
from inkbook.operators import season  # noqa: E402


@register("monthly_series")
def q_monthly_series(spark, sf_dir):
    return season.monthly_series(jobs(spark, sf_dir))


@register("seasonal_index")
def q_seasonal_index(spark, sf_dir):
    return season.seasonal_index(jobs(spark, sf_dir))


@register("seasonal_forecast")
def q_seasonal_forecast(spark, sf_dir):
    return season.seasonal_forecast(jobs(spark, sf_dir))


@register("forecast_backtest")
def q_forecast_backtest(spark, sf_dir):
    return season.forecast_backtest(jobs(spark, sf_dir))


@register("peak_month_mix")
def q_peak_month_mix(spark, sf_dir):
    return season.peak_month_mix(jobs(spark, sf_dir))


@register("seasonality_summary")
def q_seasonality_summary(spark, sf_dir):
    return season.seasonality_summary(jobs(spark, sf_dir))


@register("actual_vs_forecast")
def q_actual_vs_forecast(spark, sf_dir):
    return season.actual_vs_forecast(jobs(spark, sf_dir))


# --- ingest, derive, library, helpers ------------------------------------------------
from inkbook.functions import fmt  # noqa: E402
from inkbook.operators.common import top_k  # noqa: E402
from inkbook.operators.derive import as_of as _as_of, years_of_data as _years  # noqa: E402
from inkbook.sources import ingest, library  # noqa: E402
from inkbook.sources.fixtures import raw_jobs_view, table  # noqa: E402


@register("coerce_numeric")
def q_coerce_numeric(spark, sf_dir):
    return ingest.coerce_numeric(raw_jobs_view(spark, sf_dir)).select(
        "row_key", "quantity", "sell_price", "va_pct")


@register("coerce_dates")
def q_coerce_dates(spark, sf_dir):
    return ingest.coerce_dates(raw_jobs_view(spark, sf_dir)).select("row_key", "sales_in", "ship_date")


@register("clean_keys")
def q_clean_keys(spark, sf_dir):
    return ingest.clean_keys(raw_jobs_view(spark, sf_dir)).select("row_key", "customer_id", "customer_name")


@register("drop_unusable")
def q_drop_unusable(spark, sf_dir):
    return ingest.clean(raw_jobs_view(spark, sf_dir)).select("row_key", "customer_id", "sales_in")


@register("fx_convert")
def q_fx_convert(spark, sf_dir):
    return jobs(spark, sf_dir).select("row_key", "currency", "fx_rate",
                                      rnd("sell_price_base", 4).alias("sell_price_base"),
                                      rnd("va_amount_base", 4).alias("va_amount_base"),
                                      rnd("manual_adjustment_base", 4).alias("manual_adjustment_base"))


@register("canonical_labels")
def q_canonical_labels(spark, sf_dir):
    j = jobs(spark, sf_dir)
    lv = F.trim(F.coalesce(F.col("product_type"), F.lit("Unspecified")))
    return j.groupBy(lv.alias("label_value"), "product_type_clean").agg(F.count(F.lit(1)).alias("job_count"))


@register("lead_time")
def q_lead_time(spark, sf_dir):
    return jobs(spark, sf_dir).select("row_key", "sales_in", "ship_date", "lead_time_days")


@register("margin_flags")
def q_margin_flags(spark, sf_dir):
    return jobs(spark, sf_dir).select("row_key", rnd("va_amount", 4).alias("va_amount"),
                                      rnd("va_pct", 6).alias("va_pct"), "is_below_cost", "is_low_margin")


@register("month_start")
def q_month_start(spark, sf_dir):
    return jobs(spark, sf_dir).select("row_key", "sales_in", "month_start")


@register("as_of")
def q_as_of(spark, sf_dir):
    return _as_of(jobs(spark, sf_dir))


@register("years_of_data")
def q_years_of_data(spark, sf_dir):
    return _years(jobs(spark, sf_dir)).select(rnd("years", 2).alias("years_of_data"))


def _report_state(spark, sf_dir):
    return library.report_state(library.events_as_report_events(table(spark, sf_dir, "events")))


@register("report_state_latest")
def q_report_state_latest(spark, sf_dir):
    return _report_state(spark, sf_dir)


@register("report_list")
def q_report_list(spark, sf_dir):
    return library.report_list(_report_state(spark, sf_dir))


@register("latest_ready")
def q_latest_ready(spark, sf_dir):
    return library.latest_ready(_report_state(spark, sf_dir))


@register("top_k_per_group")
def q_top_k_per_group(spark, sf_dir):
    bc = value.by_customer(jobs(spark, sf_dir), by=("region",))
    top = top_k(bc, value.customer_order(), 3, ("region",), rank_col="rank")
    return top.select("region", "customer_id", "customer_name", rnd("total_va_amount").alias("total_va_amount"),
                      F.col("rank").cast("bigint").alias("rank"))


@register("formatted_figures")
def q_formatted_figures(spark, sf_dir):
    wt = value.work_type_breakdown(jobs(spark, sf_dir))
    total = wt.agg(F.sum("total_va_amount").alias("t"))
    share = F.col("total_va_amount") / total.select("t").scalar() * 100
    return wt.select("work_type", fmt.fmt_money("total_va_amount").alias("va_compact"),
                     fmt.fmt_money_exact("total_va_amount").alias("va_exact"),
                     fmt.fmt_pct(share).alias("va_share"), fmt.fmt_count("job_count").alias("jobs"),
                     fmt.fmt_money(F.col("total_sell_price") / -1000).alias("sell_thousandth_negative"))


# --- text audits ---------------------------------------------------------------------
from inkbook.functions import text as tx  # noqa: E402
from inkbook.operators import textaudit  # noqa: E402
from inkbook.sources.fixtures import claims_view  # noqa: E402


@register("numeric_tokens")
def q_numeric_tokens(spark, sf_dir):
    return textaudit.token_rows(claims_view(spark, sf_dir), ["claim_id"]).select("claim_id", "pos", "token")


@register("canonical_figure")
def q_canonical_figure(spark, sf_dir):
    return textaudit.token_rows(claims_view(spark, sf_dir), ["claim_id"]).select("claim_id", "token", "canonical")


@register("figure_violations")
def q_figure_violations(spark, sf_dir):
    c = claims_view(spark, sf_dir)
    return textaudit.figure_violations(c.select("claim_id", "text"), c.select("claim_id", "allowed"), ["claim_id"])


@register("hedged_figures")
def q_hedged_figures(spark, sf_dir):
    return claims_view(spark, sf_dir).select("claim_id", tx.hedged("text").alias("hedged"))


@register("banned_characters")
def q_banned_characters(spark, sf_dir):
    return claims_view(spark, sf_dir).select("claim_id", tx.banned("text").alias("banned"))


@register("text_quality")
def q_text_quality(spark, sf_dir):
    return textaudit.text_quality(claims_view(spark, sf_dir), ["claim_id"])


@register("text_quality_documents")
def q_text_quality_documents(spark, sf_dir):
    return textaudit.text_quality(table(spark, sf_dir, "documents"), ["doc_id"])


@register("audit_verdict")
def q_audit_verdict(spark, sf_dir):
    c = claims_view(spark, sf_dir)
    return textaudit.audit_verdict(c.select("claim_id", "text"), c.select("claim_id", "allowed"), ["claim_id"])


@register("document_figures")
def q_document_figures(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.size(tx.numeric_tokens("text")).cast("bigint").alias("n_figures"),
                    tx.hedged("text").alias("hedged"), tx.banned("text").alias("banned"))


# --- quote benchmark -------------------------------------------------------------------
from inkbook.llm.common import store  # noqa: E402
from inkbook.operators import quote  # noqa: E402


def _split(spark, sf_dir):
    return quote.holdout_split(quote.price_features(jobs(spark, sf_dir)))


def _on_split(spark, sf_dir, build):
    """``build`` over the split, which the medians and the scoring read."""
    return reading_once(_split(spark, sf_dir), build)


@register("price_features")
def q_price_features(spark, sf_dir):
    f = quote.price_features(jobs(spark, sf_dir))
    return f.select("row_key", *[rnd(c, 4).alias(c) for c in quote.NUMERIC_FEATURES],
                    *quote.CATEGORICAL_FEATURES, rnd("label", 6).alias("label"))


@register("holdout_split")
def q_holdout_split(spark, sf_dir):
    return _split(spark, sf_dir).select("row_key", "is_test")


@register("comparable_baseline")
def q_comparable_baseline(spark, sf_dir):
    # Model estimates (exp/log of medians) sit within a few ulps of half-cent
    # ties often; engines' libm differ in the last bits, so 4 dp.
    return _on_split(spark, sf_dir, lambda s: quote.comparable_baseline(s).select(
        "row_key", rnd("expected_price", 4).alias("expected_price")))


@register("benchmark_metrics")
def q_benchmark_metrics(spark, sf_dir):
    return _on_split(spark, sf_dir, lambda s: quote.benchmark_metrics(quote.comparable_baseline(s), s))


@register("underpriced_jobs")
def q_underpriced_jobs(spark, sf_dir):
    return _on_split(spark, sf_dir, lambda s: quote.underpriced_jobs(quote.comparable_baseline(s)))


@register("underpriced_summary")
def q_underpriced_summary(spark, sf_dir):
    return _on_split(spark, sf_dir, lambda s: quote.underpriced_summary(quote.comparable_baseline(s)))


def _scored(spark, sf_dir):
    """The held-out jobs as the price model of these data scores them. The
    features and the model are made once per application and data, and stored in
    the shared folder; later queries load them."""
    name = hashlib.sha256(f"{spark.sparkContext.applicationId}:{sf_dir}".encode()).hexdigest()[:16]
    path = f"{ensure_checkpoint_dir(spark)}/price-model-{name}"
    if library.path_exists(spark, f"{path}/split/_SUCCESS"):
        s = spark.read.parquet(f"{path}/split")
    else:
        s = store(quote.price_features(derive(as_jobs(job_rows(spark, sf_dir, quote.holdout_split))), ["is_test"]),
                  "split", f"{path}/split")
    if library.path_exists(spark, f"{path}/codes/_SUCCESS"):
        return quote.model_predictions(quote.PriceModel.load(spark, path), s), s, None
    model, reason = quote.train_price_model(s)
    if model is not None:
        model.save(path)
    return quote.model_predictions(model, s), s, reason


@register("train_price_model")
def q_train_price_model(spark, sf_dir):
    scored, _, reason = _scored(spark, sf_dir)
    return scored.select("row_key", rnd("expected_price", 2).alias("expected_price"),
                         F.lit(reason).cast("string").alias("reason"))


@register("price_model_metrics")
def q_price_model_metrics(spark, sf_dir):
    scored, s, reason = _scored(spark, sf_dir)
    return quote.benchmark_metrics(scored, s).withColumn("reason", F.lit(reason).cast("string"))


@register("model_underpriced_jobs")
def q_model_underpriced_jobs(spark, sf_dir):
    return quote.underpriced_jobs(_scored(spark, sf_dir)[0])


@register("model_underpriced_summary")
def q_model_underpriced_summary(spark, sf_dir):
    return quote.underpriced_summary(_scored(spark, sf_dir)[0])


@register("features_used")
def q_features_used(spark, sf_dir):
    return quote.features_used(_split(spark, sf_dir))


# --- findings and brief metrics -----------------------------------------------------------
from inkbook.operators import findings  # noqa: E402


def _on_marts(spark, sf_dir, build):
    """``build`` over the jobs and their marts; what several marts read is kept
    as the jobs are, and let go with the result."""
    kept = []

    def keep(df):
        kept.append(df.persist(StorageLevel.MEMORY_AND_DISK))
        return kept[-1]

    def over(rows):
        j = derive(as_jobs(rows))
        return build(j, marts=findings.area_marts(j, split=quote.price_features(j, ["is_test"]), keep=keep))
    result = reading_once(finding_rows(spark, sf_dir), over)
    for df in kept:
        weakref.finalize(result, df.unpersist).atexit = False
    return result


@register("at_stake")
def q_at_stake(spark, sf_dir):
    return _on_marts(spark, sf_dir, findings.at_stake)


@register("executive_findings")
def q_executive_findings(spark, sf_dir):
    return _on_marts(spark, sf_dir, findings.executive_findings)


@register("brief_metrics")
def q_brief_metrics(spark, sf_dir):
    return _on_marts(spark, sf_dir, findings.brief_metrics)


@register("brief_breakdown")
def q_brief_breakdown(spark, sf_dir):
    return _on_marts(spark, sf_dir, findings.brief_breakdown)
