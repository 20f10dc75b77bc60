"""Reporting-ready columns."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkbook.config import DEFAULT, Config
from inkbook.sources.schema import MONEY_COLUMNS


def fx_rate(cfg: Config = DEFAULT) -> Column:
    """Rate for the row's currency; unknown currencies convert at 1.0. The
    rates are a literal map, so no join is needed."""
    pairs = []
    for k, v in cfg.fx_rates.items():
        pairs += [F.lit(k), F.lit(float(v))]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), F.col("currency")), F.lit(1.0))


def convert_money(df: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    df = df.withColumn("fx_rate", fx_rate(cfg))
    return df.withColumns({f"{c}_base": F.col(c) * F.col("fx_rate") for c in MONEY_COLUMNS})


def label_key(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "")


def canonical_labels(df: DataFrame, column: str, out: str, by: Sequence[str] = (),
                     counted: DataFrame | None = None) -> DataFrame:
    """Merge spelling variants: rows whose lower-cased alphanumeric key is the
    same take the key's most frequent spelling (ties: the smallest). NULL
    reads as 'Unspecified'.

    The spelling counts are a grouped aggregate (one row per spelling), joined
    back on the key; the planner broadcasts that table when its measured size
    allows and shuffles otherwise. Where ``df`` does not hold a label as often
    as it occurs, ``counted`` has the labels with their numbers of ``rows``."""
    by = list(by)
    value = F.trim(F.coalesce(F.col(column).cast("string"), F.lit("Unspecified")))

    def tag(d):
        return d.withColumns({"_lv": value}).withColumn("_lk", label_key(F.col("_lv")))
    tagged = tag(df)
    counts = (tagged if counted is None else tag(counted)).groupBy(*by, "_lk", "_lv").agg(
        (F.count(F.lit(1)) if counted is None else F.sum("rows")).alias("_n"))
    canon = counts.groupBy(*by, "_lk").agg(
        F.min_by("_lv", F.struct(-F.col("_n"), F.col("_lv"))).alias("_canon"))
    return (tagged.join(canon, on=[*by, "_lk"], how="left")
            .withColumn(out, F.coalesce("_canon", "_lv"))
            .drop("_lv", "_lk", "_canon"))


def lead_time(cfg: Config = DEFAULT) -> Column:
    days = F.datediff("ship_date", "sales_in")
    return F.when(days.between(0, cfg.max_plausible_lead_days), days).cast("bigint")


def derive(jobs: DataFrame, cfg: Config = DEFAULT, by: Sequence[str] = ()) -> DataFrame:
    """Add fx_rate, twelve *_base money columns, product_type_clean,
    lead_time_days, is_below_cost, is_low_margin and month_start."""
    df = convert_money(jobs, cfg)
    if "product_type_clean" not in df.columns:      # rows may come with it (``fixtures.job_rows``)
        df = canonical_labels(df, "product_type", "product_type_clean", by)
    return df.withColumns({
        "lead_time_days": lead_time(cfg),
        "is_below_cost": F.col("va_amount") < 0,
        "is_low_margin": F.col("va_pct") < cfg.low_margin_va_pct,
        "month_start": F.trunc("sales_in", "month"),
    })


def as_of(jobs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Reference date per group: its latest booking, never the wall clock."""
    return jobs.groupBy(*by).agg(F.max("sales_in").alias("as_of"))


def years_of_data(jobs: DataFrame, by: Sequence[str] = (), cfg: Config = DEFAULT) -> DataFrame:
    span = F.datediff(F.max("sales_in"), F.min("sales_in"))
    return jobs.groupBy(*by).agg(
        F.greatest(span / F.lit(cfg.days_per_year), F.lit(cfg.min_years)).alias("years"))
