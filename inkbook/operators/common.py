"""Small building blocks shared by the marts."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


MONEY = "decimal(28,8)"


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def msum(c) -> Column:
    """Order-independent money sum: each row is fixed to 8 dp (above the 6 decimals converted prices carry, so no rounding ties) and summed as a
    decimal, so every partitioning gives the same total."""
    return F.sum(col(c).cast(MONEY))


def dbl(c) -> Column:
    return col(c).cast("double")


def rnd(c, digits: int = 2) -> Column:
    """Half-even rounding to a double, as Python's ``round``. Rounds on a
    10-decimal decimal so ties break the same way on every engine."""
    return F.bround(col(c).try_cast("decimal(38,10)"), digits).cast("double")


def safe_div(num, den) -> Column:
    return F.try_divide(col(num).cast("double"), F.nullif(col(den).cast("double"), F.lit(0.0)))


def pct_of(num, den, digits: int | None = None) -> Column:
    """num / den * 100, 0.0 when den is 0 or NULL."""
    v = F.coalesce(safe_div(num, den) * F.lit(100.0), F.lit(0.0))
    return rnd(v, digits) if digits is not None else v


def first_by_date(c, *order) -> Column:
    """pandas ``first`` over non-null values, made deterministic: the value of
    the earliest booking, ties broken by job title and the value itself."""
    order = order or ("sales_in", "job_id")
    # the value is the key's last field, so the key alone is kept
    key = F.struct(*[col(o).alias(f"o{i}") for i, o in enumerate(order)], col(c).alias("v"))
    return F.min(F.when(col(c).isNotNull(), key))["v"]


def not_null(df: DataFrame, *cols: str) -> DataFrame:
    """pandas groupby drops NULL keys; Spark keeps a NULL group."""
    cond = None
    for c in cols:
        cond = F.col(c).isNotNull() if cond is None else cond & F.col(c).isNotNull()
    return df if cond is None else df.filter(cond)


def top_k(df: DataFrame, order: Sequence[Column], k: int | None,
          by: Sequence[str] = (), rank_col: str | None = None) -> DataFrame:
    """The k first rows in ``order`` (per ``by`` group). Ungrouped this is a
    TakeOrderedAndProject; grouped it is a window with a group limit."""
    by = list(by)
    if k is None and rank_col is None:
        return df
    w = Window.partitionBy(*by).orderBy(*order) if by else None
    if not by and rank_col is None:
        return df.orderBy(*order).limit(k)
    if not by and k is not None:
        # Take the k rows first (TakeOrderedAndProject), then number them:
        # the window sees k rows, never the whole mart.
        df = df.orderBy(*order).limit(k)
        w = Window.orderBy(*order)
    elif not by:
        raise ValueError("ranking a whole ungrouped mart needs running_sum-style plans")
    out = df.withColumn("_rk", F.row_number().over(w))
    if k is not None:
        out = out.filter(F.col("_rk") <= k)
    if rank_col:
        return out.withColumnRenamed("_rk", rank_col)
    return out.drop("_rk")


# A constant grouping key: plans that must run "grouped" over the whole data
# use it; its per-group tables have exactly one row.
ONE_GROUP = "_g"


def one_group(df: DataFrame) -> DataFrame:
    return df.withColumn(ONE_GROUP, F.lit(0))


def join_on(df: DataFrame, other: DataFrame, by: Sequence[str], how: str = "inner") -> DataFrame:
    """Join per-group tables on ``by``. On the constant key the other side has
    one row and is broadcast (Catalyst folds the constant key away, so an
    unhinted join would plan as a cartesian product)."""
    by = list(by)
    if by == [ONE_GROUP]:
        return df.join(F.broadcast(other), on=by, how=how)
    return df.join(other, on=by, how=how)


def attach(df: DataFrame, small: DataFrame, by: Sequence[str]) -> DataFrame:
    """Attach per-``by`` aggregates (one row per group) to every row.

    Ungrouped, each column is a scalar subquery. On the constant key the
    one-row side is broadcast (its size is proven); with real ``by`` keys it
    has one row per group and the join is planned by measured size (AQE
    broadcasts it when small, and splits skewed groups otherwise)."""
    by = list(by)
    if by == [ONE_GROUP]:
        return df.join(F.broadcast(small), on=by, how="left")
    if by:
        return df.join(small, on=by, how="left")
    # One row: each column becomes a scalar subquery, which Spark evaluates
    # once (merged into a single subquery) and inlines as a literal.
    return df.withColumns({c: small.select(c).scalar() for c in small.columns})


# --- order statistics and prefix sums ---------------------------------------------
# ``exact_quantiles`` brackets each wanted rank by approximate quantiles, whose
# error is bounded, and counts: everything outside the brackets falls into one
# count per gap, values inside are counted one by one. The rank is then read off
# an array of about a 2500th of the group's rows. Both passes are aggregates that
# combine in the map tasks.
# ``prefix_sums`` splits a group into ranges by approximate quantiles, as many as
# its size asks for, sums the ranges up in an array of at most RANGES elements and
# runs a window inside each range only.

#: Inverse of the relative rank error of the approximate quantiles.
ACCURACY = 10_000
#: Half width of a bracket in relative ranks: twice that error.
MARGIN = 2 / ACCURACY
#: Value ranges of a group at most, and rows that one range should hold.
RANGES = 512
RANGE_ROWS = 4096


def _join(df: DataFrame, small: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``small`` (one row per group) beside every row; keys may be null."""
    keys = list(keys)
    if not keys or keys == [ONE_GROUP]:
        return attach(df, small, keys)
    right = small.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
                         *[c for c in small.columns if c not in keys])
    on = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    return df.join(right, on=on).drop(*[f"_k{i}" for i in range(len(keys))])


def exact_quantiles(df: DataFrame, value, keys: Sequence[str], qs: dict[str, float]) -> DataFrame:
    """Exact linearly interpolated quantiles of a continuous column per group;
    nulls are left out. Equals ``percentile`` / DuckDB ``quantile_cont``."""
    keys, names = list(keys), list(qs)
    d = df.select(*keys, col(value).cast("double").alias("_v")).filter(F.col("_v").isNotNull())
    ends = [e for m in names for e in (max(0.0, qs[m] - MARGIN), min(1.0, qs[m] + MARGIN))]
    bounds = d.groupBy(*keys).agg(F.percentile_approx("_v", ends, ACCURACY).alias("_b"))
    b, v = F.col("_b"), F.col("_v")

    def between(i, m):
        low = v >= b[2 * i] if qs[m] > MARGIN else F.lit(True)
        high = v <= b[2 * i + 1] if qs[m] < 1 - MARGIN else F.lit(True)
        return low & high
    inside = F.lit(False)
    gap = F.lit(0)
    for i, m in enumerate(names):
        inside = inside | between(i, m)
        gap = gap + (v > b[2 * i + 1]).cast("int")
    # one row per value inside a bracket, one per gap between brackets
    counted = _join(d, bounds, keys).select(*keys, gap.alias("_g"), F.when(inside, v).alias("_x"), "_v") \
        .groupBy(*keys, "_g", "_x").agg(F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    rows = counted.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_hi", "_lo", "_c"))).alias("_a"),
                                      F.sum("_c").alias("_n"))
    start = F.struct(F.lit(0).cast("bigint").alias("before"),
                     *[F.lit(None).cast("double").alias(f"{m}{e}") for m in names for e in ("_f", "_t")])

    def step(acc, x):
        def read(m, e):
            pos = (F.col("_n") - 1).cast("double") * F.lit(float(qs[m]))
            rank = (F.floor(pos) if e == "_f" else F.ceil(pos)).cast("bigint")
            found = (acc["before"] <= rank) & (rank < acc["before"] + x["_c"])
            # a rank may be the value next to a bracket; further inside a gap it
            # would mean a broken error bound
            exact = F.when(rank == acc["before"], x["_lo"]).when(rank == acc["before"] + x["_c"] - 1, x["_hi"]) \
                .when(x["_lo"] == x["_hi"], x["_hi"]) \
                .otherwise(F.raise_error(F.lit("quantile outside its bracket")).cast("double"))
            return F.when(found, exact).otherwise(acc[f"{m}{e}"]).alias(f"{m}{e}")
        return F.struct((acc["before"] + x["_c"]).alias("before"), *[read(m, e) for m in names for e in ("_f", "_t")])

    out = rows.filter("_n > 0").withColumn("_q", F.aggregate("_a", start, step))

    def interpolated(m):
        pos = (F.col("_n") - 1).cast("double") * F.lit(float(qs[m]))
        lo, hi = F.col(f"_q.{m}_f"), F.col(f"_q.{m}_t")
        return (lo + (pos - F.floor(pos)) * (hi - lo)).alias(m)
    return out.select(*keys, *[interpolated(m) for m in names])


def prefix_sums(distinct: DataFrame, value: str, by: Sequence[str], sums: dict[str, Column],
                ascending: bool = True) -> DataFrame:
    """Per ``by`` group, sums over all rows before each row in the order of
    ``value``; the rows hold each value of a group once. The result does not
    depend on where the ranges lie."""
    by, names = list(by), list(sums)
    v = F.col(value).cast("double")
    steps = F.expr("array(" + ", ".join(f"{i / RANGES!r}D" for i in range(1, RANGES)) + ")")
    bounds = distinct.groupBy(*by).agg(F.percentile_approx(v, steps, F.lit(4 * RANGES)).alias("_all"),
                                       F.count(F.lit(1)).alias("_size"))
    wanted = F.least(F.ceil(F.col("_size") / RANGE_ROWS), F.lit(RANGES))
    bounds = bounds.select(*by, F.array_distinct(F.filter(
        "_all", lambda b, i: F.floor((i + 1) * wanted / RANGES) > F.floor(i * wanted / RANGES))).alias("_b"))
    d = _join(distinct, bounds, by).withColumn("_r", F.size(F.filter("_b", lambda b: b < v))).drop("_b")
    totals = d.groupBy(*by, "_r").agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    # at most RANGES totals a group, in one array that is summed up in order
    side = F.col("_r") if ascending else -F.col("_r")
    ranges = totals.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(
        side.alias("_s"), "_r", *names))).alias("_t"))
    kinds = {n: totals.schema[n].dataType for n in names}
    zero = {n: F.lit(0).cast(kinds[n]) for n in names}

    def ahead(n):
        def total(x):
            return F.aggregate(F.filter("_t", lambda y: y["_s"] < x["_s"]), zero[n],
                               lambda a, y: (a + y[n]).cast(kinds[n]))
        return total
    base = ranges.select(*by, F.explode(F.transform("_t", lambda x: F.struct(
        x["_r"].alias("_r"), *[ahead(n)(x).alias(f"{n}_base") for n in names]))).alias("_x")).select(*by, "_x.*")
    order = F.col(value).asc() if ascending else F.col(value).desc()
    inside = Window.partitionBy(*by, "_r").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    local = d.withColumns({n: F.coalesce(F.sum(c).over(inside), zero[n]) for n, c in sums.items()})
    out = _join(local, base, [*by, "_r"])
    return out.withColumns({n: F.col(n) + F.col(f"{n}_base") for n in names}).drop("_r", *[f"{n}_base" for n in names])
