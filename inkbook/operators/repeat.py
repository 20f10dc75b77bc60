"""Repeat and reprint work (R1–R5). A title is one (customer, job title);
its rows are print runs."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkbook.config import DEFAULT, Config
from inkbook.operators.cadence import CUSTOMER
from inkbook.operators.common import attach, dbl, first_by_date, msum, not_null, pct_of, rnd, top_k
from inkbook.operators.derive import as_of

TITLE = (*CUSTOMER, "job_id")


def title_runs(jobs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    keys = [*by, *TITLE]
    return not_null(jobs, *keys).groupBy(*keys).agg(
        F.count("sales_in").alias("print_runs"),
        F.min("sales_in").alias("first_run"),
        F.max("sales_in").alias("last_run"),
        msum("sell_price_base").alias("total_sell"),
        msum("va_amount_base").alias("total_va"),
        msum("quantity").alias("total_quantity"),
        # the title is a key: dates and values alone tell its runs apart
        first_by_date("product_type_clean", "sales_in").alias("product_type"),
    )


def _cycles(titles: DataFrame) -> DataFrame:
    """Cycle and overdue state of titles beside ``as_of``; null for titles with
    fewer than two runs. The cycle is rounded to 1 dp before it is used, as
    published."""
    again = F.col("print_runs") > 1
    cycle = rnd(F.try_divide(F.datediff("last_run", "first_run").cast("double"), (F.col("print_runs") - 1).cast("double")), 1)
    return titles.withColumns({
        "avg_cycle_days": F.when(again, cycle),
        "days_since_last_run": F.when(again, F.datediff("as_of", "last_run").cast("bigint")),
    }).withColumns({
        "cycles_overdue": F.try_divide(F.col("days_since_last_run").cast("double"),
                                       F.nullif(F.col("avg_cycle_days"), F.lit(0.0))),
        "avg_value_per_run": F.when(again, F.try_divide(dbl("total_sell"), F.col("print_runs").cast("double"))),
    }).drop("as_of")


def repeat_titles_all(jobs: DataFrame, by: Sequence[str] = (), titles: DataFrame | None = None) -> DataFrame:
    """Every title with more than one run, with its cycle and overdue state."""
    t = titles if titles is not None else title_runs(jobs, by)
    return _cycles(attach(t.filter(F.col("print_runs") > 1), as_of(jobs, by), by))


def _present(df: DataFrame, by: Sequence[str]) -> DataFrame:
    return df.select(
        *by, *TITLE, "print_runs", "first_run", "last_run",
        rnd("total_sell").alias("total_sell"), rnd("total_va").alias("total_va"),
        rnd("total_quantity").alias("total_quantity"), "product_type",
        rnd("avg_cycle_days").alias("avg_cycle_days"), "days_since_last_run",
        rnd("cycles_overdue").alias("cycles_overdue"), rnd("avg_value_per_run").alias("avg_value_per_run"),
        F.concat_ws(" · ", "job_id", "customer_name").alias("title_label"),
    )


def _due(rep: DataFrame, cfg: Config) -> DataFrame:
    return rep.filter((F.col("cycles_overdue") >= 1.0) & (F.col("avg_cycle_days") >= cfg.min_reprint_cycle_days))


def repeat_titles(jobs: DataFrame, by: Sequence[str] = (), cfg: Config = DEFAULT) -> DataFrame:
    """Top repeat titles by sales (R2)."""
    rep = repeat_titles_all(jobs, by)
    order = [F.col("total_sell").desc(), *[F.col(c).asc() for c in TITLE]]
    return _present(top_k(rep, order, cfg.top_titles, by), by)


def due_for_reprint(jobs: DataFrame, by: Sequence[str] = (), cfg: Config = DEFAULT) -> DataFrame:
    """Titles a full cycle overdue, on cycles of at least 30 days."""
    due = _due(repeat_titles_all(jobs, by), cfg)
    order = [F.col("avg_value_per_run").desc(), *[F.col(c).asc() for c in TITLE]]
    return _present(top_k(due, order, cfg.top_titles, by), by)


def repeat_by_product(jobs: DataFrame, by: Sequence[str] = (), cfg: Config = DEFAULT) -> DataFrame:
    rep = not_null(repeat_titles_all(jobs, by), "product_type")
    agg = rep.groupBy(*by, "product_type").agg(
        F.count("job_id").alias("titles"),
        F.sum("total_sell").alias("_sell"),
        F.sum("print_runs").alias("runs"))
    top = top_k(agg, [F.col("_sell").desc(), F.col("product_type").asc()], cfg.top_repeat_products, by)
    return top.select(*by, "product_type", "titles", rnd("_sell").alias("total_sell"), "runs")


def repeat_summary(jobs: DataFrame, by: Sequence[str] = (), cfg: Config = DEFAULT) -> DataFrame:
    """One aggregate over the titles, so that they are built once."""
    titles = _cycles(attach(title_runs(jobs, by), as_of(jobs, by), by))
    again = F.col("print_runs") > 1
    due = again & (F.col("cycles_overdue") >= 1.0) & (F.col("avg_cycle_days") >= cfg.min_reprint_cycle_days)
    df = titles.groupBy(*by).agg(
        F.count(F.lit(1)).alias("distinct_titles"),
        F.count(F.when(F.col("print_runs") == 1, 1)).alias("one_off_titles"),
        F.sum("total_sell").alias("_all_sell"),
        F.count(F.when(again, 1)).alias("repeat_titles"),
        F.sum(F.when(again, F.col("total_sell"))).alias("_rep_sell"),
        F.avg(F.when(again, F.col("print_runs"))).alias("_avg_runs"),
        F.max(F.when(again, F.col("print_runs"))).alias("max_runs"),
        F.count(F.when(due, 1)).alias("titles_due_reprint"),
        F.sum(F.when(due, F.col("avg_value_per_run").cast("decimal(28,8)"))).alias("_pipe"))
    n_rep = F.coalesce(F.col("repeat_titles"), F.lit(0))
    return df.select(
        *by, "distinct_titles", n_rep.cast("bigint").alias("repeat_titles"), "one_off_titles",
        pct_of(n_rep, "distinct_titles", 1).alias("repeat_title_pct"),
        rnd(F.coalesce(F.col("_rep_sell"), F.lit(0))).alias("repeat_revenue"),
        pct_of(F.coalesce(F.col("_rep_sell"), F.lit(0)), "_all_sell", 1).alias("repeat_revenue_pct"),
        F.coalesce(rnd("_avg_runs", 1), F.lit(0.0)).alias("avg_runs_per_repeat_title"),
        F.coalesce(F.col("max_runs"), F.lit(0)).cast("bigint").alias("max_runs"),
        F.coalesce(F.col("titles_due_reprint"), F.lit(0)).cast("bigint").alias("titles_due_reprint"),
        rnd(F.coalesce(F.col("_pipe"), F.lit(0))).alias("reprint_pipeline_value"),
    )
