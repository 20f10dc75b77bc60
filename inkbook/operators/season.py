"""Seasonality, capacity and a back-tested projection.

The monthly series is a grid with no gaps (months without bookings are
zeros). The 6-month projection is recursive (each projected month feeds the
next), so it runs as an ``aggregate`` over one array per series: one element
per month, so the state is tiny and scales with the number of series, not
rows. The backtest needs no recursion and is a plain window over lags."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkbook.config import DEFAULT, Config
from inkbook.operators.common import ONE_GROUP, attach, dbl, join_on, msum, not_null, one_group, rnd, top_k

# Month labels in calendar order.
MONTH_NAMES = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]
# Series that are indexed and projected: label -> monthly column.
SERIES = {"sales": "sell_price", "press": "press_hours"}


#: Monthly totals of the grid.
TOTALS = ("sell_price", "va_amount", "press_hours", "impressions")


def _filled(m: DataFrame, by: Sequence[str]) -> DataFrame:
    """Monthly totals (one row per month) on a grid without gaps, and the
    group's last month. Bounds and totals come from one aggregate (an element
    per month), so what is below is computed once."""
    by, sums = list(by), [c for c in m.columns if c not in (*by, "month_start")]
    months = m.groupBy(*by).agg(F.min("month_start").alias("_lo"), F.max("month_start").alias("_last"), F.map_from_entries(
        F.collect_list(F.struct("month_start", F.struct(*sums)))).alias("_m"))
    grid = months.select(*by, "_last", "_m", F.explode(F.sequence("_lo", "_last", F.expr("INTERVAL 1 MONTH")))
                         .alias("month_start"))
    had = F.try_element_at("_m", F.col("month_start"))
    return grid.select(*by, "month_start", "_last", *[
        F.coalesce(had[c], F.lit(0)).cast("bigint" if c == "job_count" else "decimal(38,8)").alias(c) for c in sums])


def monthly_grid(jobs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Exact monthly totals on a complete month grid (decimals kept)."""
    return _filled(_monthly(jobs, by), by).drop("_last")


def _monthly(jobs: DataFrame, by: Sequence[str]) -> DataFrame:
    return not_null(jobs, *by, "month_start").groupBy(*by, "month_start").agg(
        msum("sell_price_base").alias("sell_price"),
        msum("va_amount_base").alias("va_amount"),
        msum("press_hrs").alias("press_hours"),
        msum("impressions").alias("impressions"),
        F.count("job_id").alias("job_count"))


def monthly_series(jobs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    g = monthly_grid(jobs, by)
    return g.select(*by, "month_start", *[rnd(c).alias(c) for c in TOTALS],
                    "job_count")


def _long(grid: DataFrame, by: Sequence[str], series: dict[str, str] = SERIES) -> DataFrame:
    """(by, series, month_start, value, dvalue): value a double, dvalue the
    exact decimal (for order-independent means). The grid is read once."""
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("series"), dbl(v).alias("value"), F.col(v).alias("dvalue"))
                               for k, v in series.items()])).alias("_s")
    return grid.select(*by, "month_start", rows).select(*by, "_s.series", "month_start", "_s.value", "_s.dvalue")


def _month_name(num: Column) -> Column:
    return F.element_at(F.array(*[F.lit(m) for m in MONTH_NAMES]), num.cast("int"))


def seasonal_index_raw(grid: DataFrame, by: Sequence[str] = (), series: dict[str, str] = SERIES) -> DataFrame:
    long = _long(grid, by, series).withColumn("month_num", F.month("month_start"))
    per = long.groupBy(*by, "series", "month_num").agg(F.sum("dvalue").alias("_sum"), F.count(F.lit(1)).alias("_n"))
    # at most 12 rows to a window
    w = Window.partitionBy(*by, "series")
    overall = dbl(F.sum("_sum").over(w)) / F.sum("_n").over(w)
    per = per.withColumns({"avg_value": dbl("_sum") / F.col("_n"), "_overall": overall})
    return per.withColumn("seasonal_index", F.when(F.col("_overall") != 0,
                                                   F.col("avg_value") / F.col("_overall") * 100)
                          .otherwise(F.lit(100.0))).drop("_overall", "_sum", "_n")


def seasonal_index(jobs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    idx = seasonal_index_raw(monthly_grid(jobs, by), by)
    return idx.select(*by, "series", F.col("month_num").cast("bigint").alias("month_num"),
                      rnd("avg_value", 1).alias("avg_value"), rnd("seasonal_index", 1).alias("seasonal_index"),
                      _month_name(F.col("month_num")).alias("month_name"),
                      (F.col("seasonal_index") >= 100).alias("at_or_above_average"))


def _growth(recent: Column, prior: Column, cfg: Config) -> Column:
    g = F.when(prior != 0, recent / prior).otherwise(F.lit(1.0))
    return F.least(F.greatest(g, F.lit(cfg.growth_floor)), F.lit(cfg.growth_cap))


def seasonal_forecast_raw(grid: DataFrame, by: Sequence[str] = (), cfg: Config = DEFAULT,
                          series: dict[str, str] = SERIES) -> DataFrame:
    """(by, series, step, month_start, value) for the next ``horizon`` months;
    value is unclipped (it feeds later steps), callers clip for output."""
    long = _long(grid, by, series)
    arr = long.groupBy(*by, "series").agg(
        F.array_sort(F.collect_list(F.struct("month_start", "value"))).alias("_pts"),
        F.max("month_start").alias("_last"))
    arr = arr.withColumn("_vals", F.transform("_pts", lambda p: p["value"])) \
        .filter(F.size("_vals") >= cfg.min_months_for_forecast)

    def step(acc, _i):
        m = F.size(acc)
        seasonal = F.element_at(acc, m - 11)
        recent = (F.element_at(acc, m - 2) + F.element_at(acc, m - 1) + F.element_at(acc, m)) / 3.0
        prior = (F.element_at(acc, m - 13) + F.element_at(acc, m - 12) + F.element_at(acc, m - 11)) / 3.0
        return F.concat(acc, F.array(seasonal * _growth(recent, prior, cfg)))

    ext = arr.withColumn("_ext", F.aggregate(F.sequence(F.lit(1), F.lit(cfg.forecast_horizon_months)),
                                             F.col("_vals"), step))
    out = ext.select(*by, "series", "_last", F.posexplode(
        F.slice("_ext", F.size("_vals") + 1, cfg.forecast_horizon_months)).alias("_p", "value"))
    return out.select(*by, "series", (F.col("_p") + 1).cast("bigint").alias("step"),
                      F.add_months("_last", F.col("_p") + 1).alias("month_start"), "value")


def seasonal_forecast(jobs: DataFrame, by: Sequence[str] = (), cfg: Config = DEFAULT) -> DataFrame:
    f = seasonal_forecast_raw(monthly_grid(jobs, by), by, cfg)
    return f.select(*by, "series", "step", "month_start",
                    rnd(F.greatest(F.col("value"), F.lit(0.0)), 2).alias("forecast"))


def forecast_backtest_raw(grid: DataFrame, by: Sequence[str] = (), cfg: Config = DEFAULT) -> DataFrame:
    """Each of the last ``backtest_months`` months (index >= 12, actual > 0)
    predicted from earlier months only."""
    long = _long(grid, by)
    w = Window.partitionBy(*by, "series").orderBy("month_start")
    v = F.col("value")
    lag = {k: F.lag(v, k).over(w) for k in (1, 2, 3, 12, 13, 14)}
    df = long.withColumns({
        "_i": F.row_number().over(w) - 1,
        "_n": F.count(F.lit(1)).over(Window.partitionBy(*by, "series")),
        "_seasonal": lag[12],
        "_recent": (lag[3] + lag[2] + lag[1]) / 3.0,
        "_prior": (F.coalesce(lag[14], F.lit(0.0)) + F.coalesce(lag[13], F.lit(0.0)) + lag[12])
        / (1 + F.when(lag[13].isNotNull(), 1).otherwise(0) + F.when(lag[14].isNotNull(), 1).otherwise(0)),
    })
    df = df.filter((F.col("_n") >= cfg.min_months_for_forecast)
                   & (F.col("_i") >= F.greatest(F.col("_n") - cfg.backtest_months, F.lit(12)))
                   & (v > 0))
    pred = F.col("_seasonal") * _growth(F.col("_recent"), F.col("_prior"), cfg)
    return df.select(*by, "series", "month_start", v.alias("actual"), pred.alias("predicted")) \
        .withColumn("ape", F.abs(F.col("predicted") - F.col("actual")) / F.col("actual"))


def forecast_backtest(jobs: DataFrame, by: Sequence[str] = (), cfg: Config = DEFAULT) -> DataFrame:
    b = forecast_backtest_raw(monthly_grid(jobs, by), by, cfg)
    return b.select(*by, "series", "month_start", rnd("actual").alias("actual"),
                    rnd("predicted").alias("predicted"), rnd(F.col("ape") * 100, 2).alias("abs_pct_error"))


def _peak(idx: DataFrame, by: Sequence[str]) -> DataFrame:
    s = idx.filter(F.col("series") == "sales")
    return s.groupBy(*by).agg(
        F.min_by("month_num", F.struct(-F.col("seasonal_index"), F.col("month_num"))).alias("peak_num"),
        F.max("seasonal_index").alias("_peak_idx"),
        F.min_by("month_num", F.struct(F.col("seasonal_index"), F.col("month_num"))).alias("trough_num"),
        F.min("seasonal_index").alias("_trough_idx"))


def peak_month_mix(jobs: DataFrame, by: Sequence[str] = (), cfg: Config = DEFAULT) -> DataFrame:
    """Industries behind the peak calendar month (top 6 by sales). Peak and mix
    are both read off one aggregate per industry and month."""
    by = list(by)
    cells = not_null(jobs, *by).groupBy(*by, "industry", "month_start", F.month("sales_in").alias("_month")) \
        .agg(msum("sell_price_base").alias("_sell"))
    months = not_null(cells, "month_start").groupBy(*by, "month_start").agg(F.sum("_sell").alias("sell_price"))
    sales = {"sales": "sell_price"}
    peak = _peak(seasonal_index_raw(_filled(months, by), by, sales), by).select(*by, "peak_num")
    j = attach(not_null(cells, "industry"), peak, by).filter(F.col("_month") == F.col("peak_num"))
    agg = j.groupBy(*by, "industry").agg(F.sum("_sell").alias("_sell"))
    top = top_k(agg, [F.col("_sell").desc(), F.col("industry").asc()], cfg.top_peak_industries, by)
    return top.select(*by, "industry", rnd("_sell").alias("sell_price"))


def seasonality_summary(jobs: DataFrame, by: Sequence[str] = (), cfg: Config = DEFAULT) -> DataFrame:
    by = list(by)
    if not by:
        return seasonality_summary(one_group(jobs), [ONE_GROUP], cfg).drop(ONE_GROUP)
    grid = monthly_grid(jobs, by)
    peak = _peak(seasonal_index_raw(grid, by), by)
    bt = forecast_backtest_raw(grid, by, cfg).groupBy(*by).agg(
        (F.avg(F.when(F.col("series") == "sales", F.col("ape"))) * 100).alias("_smape"),
        (F.avg(F.when(F.col("series") == "press", F.col("ape"))) * 100).alias("_pmape"))
    fc = seasonal_forecast_raw(grid, by, cfg).filter(F.col("step") == 1).groupBy(*by).agg(
        F.max(F.when(F.col("series") == "sales", F.greatest(F.col("value"), F.lit(0.0)))).alias("_fs"),
        F.max(F.when(F.col("series") == "press", F.greatest(F.col("value"), F.lit(0.0)))).alias("_fp"))
    w = Window.partitionBy(*by).orderBy(F.col("month_start").desc())
    # read off the same rows as the series, so that the grid is computed once
    press = _long(grid, by).filter(F.col("series") == "press").withColumnRenamed("dvalue", "press_hours").withColumn("_rn", F.row_number().over(w)).groupBy(*by).agg(
        F.max("press_hours").alias("_pmax"),
        (dbl(F.sum(F.when(F.col("_rn") <= 12, F.col("press_hours"))))
         / F.count(F.when(F.col("_rn") <= 12, 1))).alias("_precent"))
    df = join_on(join_on(join_on(peak, bt, by, "left"), fc, by, "left"), press, by, "left")
    return df.select(
        *by,
        _month_name(F.col("peak_num")).alias("peak_month"), rnd("_peak_idx", 1).alias("peak_index"),
        _month_name(F.col("trough_num")).alias("trough_month"), rnd("_trough_idx", 1).alias("trough_index"),
        F.when(F.col("_trough_idx") != 0, rnd(F.col("_peak_idx") / F.col("_trough_idx"), 2))
        .alias("peak_to_trough_ratio"),
        rnd("_smape", 1).alias("sales_forecast_mape"), rnd("_pmape", 1).alias("press_forecast_mape"),
        F.lit(cfg.forecast_horizon_months).cast("bigint").alias("forecast_horizon_months"),
        rnd("_pmax", 1).alias("press_hours_peak_month"), rnd("_precent", 1).alias("press_hours_recent_avg"),
        rnd("_fs", 2).alias("forecast_next_month_sales"), rnd("_fp", 2).alias("forecast_next_month_press"),
    )


def actual_vs_forecast(jobs: DataFrame, by: Sequence[str] = (), cfg: Config = DEFAULT) -> DataFrame:
    """Chart series: booked sales by month, the projection appended, and the
    last booked value repeated as the projection's first point."""
    grid = _filled(_monthly(jobs, by), by)
    actual = grid.select(
        *by, "month_start", rnd("sell_price").alias("actual"),
        F.when(F.col("month_start") == F.col("_last"), rnd("sell_price")).alias("forecast"))
    proj = seasonal_forecast_raw(grid, by, cfg, {"sales": "sell_price"}).select(
        *by, "month_start", F.lit(None).cast("double").alias("actual"),
        rnd(F.greatest(F.col("value"), F.lit(0.0)), 2).alias("forecast"))
    return actual.unionByName(proj)
