"""Grouped price model (G3, G5, G6 with ``by``): boosted trees for all reports
at once.

Every level of every report's tree is one aggregate: gradient sums per
(report, node, input, bin), combined in the map tasks. From it each node's best
split is read off. What is kept between levels is the model, one row per
report; the training rows are stored once and their node and residual follow
from the model they meet in a join. So a report with a third of all jobs is
counted like any other, and nothing is gathered but bounded trees.

Inputs are binned by a fixed rule (sixteenths of the logarithm), so bins need
no pass and do not depend on other reports; gradients are summed as integers.
A report's trees therefore equal those of a fit of its own, whatever the
partitioning.

Defined cases: rows whose ``by`` key is null are dropped; a report with fewer
than ``min_priced_jobs`` priced jobs, or without training jobs, has no model and no
predictions; rows that repeat a key are jobs of their own; a category that training lacks takes the mean of all; an empty
split gives an empty model."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inkbook.config import DEFAULT, Config
from inkbook.operators.common import ONE_GROUP, not_null
from inkbook.operators.quote import CATEGORICAL_FEATURES, NUMERIC_FEATURES, _fold, _row_key
from inkbook.session import ensure_checkpoint_dir

#: Bins per unit of the logarithm, and their largest number (ln 1p up to 25).
FINE, MOST_BINS = 16, 400
#: Labels and residuals are summed as integers of this unit.
UNIT = float(1 << 24)
#: Least jobs on each side of a split.
LEAF = 20
#: The cut of a node that is not split: all go left.
NO_CUT = MOST_BINS + 1


def _units(c: Column) -> Column:
    return F.round(c * UNIT).cast("long")


def _bin(v: Column) -> Column:
    """Bin of a value: sixteenths of ln(1 + v); null, NaN and negative are 0."""
    safe = F.greatest(F.coalesce(F.nanvl(v, F.lit(0.0)), F.lit(0.0)), F.lit(0.0))
    return F.least(F.floor(F.log1p(safe) * FINE), F.lit(MOST_BINS)).cast("int")


def _code_bin(v: Column) -> Column:
    """Bin of a category's code, which is a logarithm already."""
    return F.least(F.greatest(F.floor(v * FINE), F.lit(0)), F.lit(MOST_BINS)).cast("int")


def binned(split: DataFrame, keys: list[str], cfg: Config) -> DataFrame:
    """The rows of groups that have enough jobs, with ``start`` (the mean
    training label of the group) and ``bins`` (one per input). A category's code is the smoothed mean label of its training jobs in
    the group, without the job's own fold."""
    rows = split.withColumn("_f", _fold())
    train = rows.filter(~F.col("is_test"))
    start = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_jobs"), F.count(F.when(~F.col("is_test"), 1)).alias("_n"),
        F.sum(F.when(~F.col("is_test"), _units(F.col("label")))).alias("_s")) \
        .filter((F.col("_jobs") >= cfg.min_priced_jobs) & (F.col("_n") > 0)) \
        .select(*keys, (F.col("_s") / F.col("_n") / UNIT).alias("start"))
    pair = F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).alias("v"))
                               for c in CATEGORICAL_FEATURES])).alias("_p")
    sums = train.select(*keys, pair, "_f", _units(F.col("label")).alias("_u")) \
        .groupBy(*keys, "_p", "_f").agg(F.sum("_u").alias("s"), F.count(F.lit(1)).alias("n"))
    # a fold's codes leave its own jobs out; fold -1 (held out) has them all
    others = F.explode(F.filter(F.array(*map(F.lit, range(-1, 5))), lambda g: g != F.col("_f"))).alias("_o")
    sums = sums.select(*keys, "_p", others, "s", "n").groupBy(*keys, "_p", "_o") \
        .agg(F.sum("s").alias("s"), F.sum("n").alias("n")).join(start, keys)
    codes = sums.select(*keys, "_p", F.col("_o").alias("_f"), _code_bin(
        (F.col("s") / UNIT + F.col("start") * cfg.code_prior) / (F.col("n") + cfg.code_prior)).alias("code"))
    out = rows.join(start, keys)
    for c in CATEGORICAL_FEATURES:
        own = codes.filter(F.col("_p.c") == c).select(*keys, F.col("_p.v").alias(c), "_f", F.col("code").alias(f"_{c}"))
        out = out.join(own, list(dict.fromkeys([*keys, c, "_f"])), "left") \
            .withColumn(f"_{c}", F.coalesce(f"_{c}", _code_bin(F.col("start"))))
    return out.select(*split.columns, "start", F.array(
        *[_bin(F.col(c)) for c in NUMERIC_FEATURES], *[F.col(f"_{c}") for c in CATEGORICAL_FEATURES]).alias("bins"))


def _node(tree: Column, depth: int) -> Column:
    """The node (1 is the root, 2p and 2p + 1 its children) a row reaches."""
    if depth == 0:
        return F.lit(1)
    bins = F.col("bins")
    return F.aggregate(F.array(*[F.lit(k) for k in range(depth)]), F.lit(1), lambda p, _: p * 2 + F.when(
        F.get(bins, F.get(tree["feature"], p - 1)) > F.get(tree["cut"], p - 1), 1).otherwise(0))


def _predicted(depth: int) -> Column:
    """Predicted label of a row beside its group's ``trees``."""
    leaves = 1 << depth
    return F.aggregate("trees", F.col("start"), lambda total, t: total + F.get(t["value"], _node(t, depth) - leaves))


def _best_splits(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Per group and node: input and cut of its best split, and the mean
    residuals left and right of it (both the node's own where none helps)."""
    cells = rows.select(*keys, "_node", "_res", F.posexplode("bins").alias("_i", "_bin")) \
        .groupBy(*keys, "_node", "_i", "_bin").agg(F.sum("_res").alias("g"), F.count(F.lit(1)).alias("n"))
    # at most MOST_BINS + 1 rows to a window
    part = Window.partitionBy(*keys, "_node", "_i")
    upto = part.orderBy("_bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cells = cells.withColumns({"gl": F.sum("g").over(upto), "nl": F.sum("n").over(upto),
                               "ga": F.sum("g").over(part), "na": F.sum("n").over(part)})
    gl, nl, ga, na = (F.col(c).cast("double") for c in ("gl", "nl", "ga", "na"))
    gain = F.when((nl >= LEAF) & (na - nl >= LEAF),
                  gl * gl / nl + (ga - gl) * (ga - gl) / (na - nl) - ga * ga / na)
    mean = ga / na / UNIT
    best = F.max(F.when(gain > 0, F.struct(
        gain.alias("gain"), (-F.col("_i")).alias("i"), (-F.col("_bin")).alias("b"),
        (gl / nl / UNIT).alias("left"), ((ga - gl) / (na - nl) / UNIT).alias("right")))).alias("best")
    return cells.groupBy(*keys, "_node").agg(best, F.max(mean).alias("mean")).select(
        *keys, "_node", F.struct(
            F.coalesce(-F.col("best.i"), F.lit(0)).alias("feature"), F.coalesce(-F.col("best.b"), F.lit(NO_CUT)).alias("cut"),
            F.coalesce("best.left", "mean").alias("left"), F.coalesce("best.right", "mean").alias("right")).alias("s"))


def fit_grouped(rows: DataFrame, keys: list[str], cfg: Config = DEFAULT, *, rounds: int | None = None,
                depth: int = 3) -> DataFrame:
    """Models of all groups of the stored ``binned`` rows: keys, start and trees
    (arrays of input, cut and leaf value, nodes in heap order)."""
    rounds = cfg.gbt_max_iter if rounds is None else rounds
    train = rows.filter(~F.col("is_test")).select(*keys, "label", "bins")
    tree_type = "struct<feature:array<int>,cut:array<int>,value:array<double>>"
    empty = F.from_json(F.lit('{"feature":[],"cut":[],"value":[]}'), tree_type)
    model = rows.groupBy(*keys).agg(F.max("start").alias("start")) \
        .withColumns({"trees": F.array().cast(f"array<{tree_type}>"), "now": empty}).checkpoint()
    for _ in range(rounds):
        for level in range(depth):
            first = 1 << level
            met = train.join(model, keys).select(
                *keys, "bins", _node(F.col("now"), level).cast("int").alias("_node"),
                _units(F.col("label") - _predicted(depth)).alias("_res"))
            # a group's splits of this level: at most 2^level
            found = _best_splits(met, keys).groupBy(*keys).agg(F.map_from_entries(
                F.collect_list(F.struct("_node", "s"))).alias("found"))
            got = model.join(found, keys, "left")
            nodes = F.sequence(F.lit(first), F.lit(2 * first - 1))
            split = lambda p: F.try_element_at(F.col("found"), p)
            feature = F.concat("now.feature", F.transform(nodes, lambda p: F.coalesce(split(p)["feature"], F.lit(0))))
            cut = F.concat("now.cut", F.transform(nodes, lambda p: F.coalesce(split(p)["cut"], F.lit(NO_CUT))))
            value = F.flatten(F.transform(nodes, lambda p: F.array(
                F.coalesce(split(p)["left"], F.lit(0.0)) * cfg.gbt_step_size,
                F.coalesce(split(p)["right"], F.lit(0.0)) * cfg.gbt_step_size)))
            model = got.withColumn("now", F.struct(feature.alias("feature"), cut.alias("cut"), value.alias("value"))
                                   .cast(tree_type)).drop("found")
            if level == depth - 1:
                model = model.withColumn("trees", F.concat("trees", F.array("now"))).withColumn("now", empty)
            model = model.checkpoint()
    return model.drop("now")


def grouped_predictions(split: DataFrame, by: Sequence[str] = (), cfg: Config = DEFAULT, *,
                        rounds: int | None = None, depth: int = 3) -> tuple[DataFrame, DataFrame]:
    """The held-out rows of ``split`` with ``expected_price``, and the models
    (one row per group), fitted per ``by``."""
    ensure_checkpoint_dir(split.sparkSession)
    own = _row_key(not_null(split, *by) if by else split)
    keys = list(by) or [ONE_GROUP]
    keyed = own if by else own.withColumn(ONE_GROUP, F.lit(0))
    kept = keyed.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        rows = binned(kept, keys, cfg).checkpoint()
        model = fit_grouped(rows, keys, cfg, rounds=rounds, depth=depth)
    finally:
        kept.unpersist()
    scored = rows.filter("is_test").join(model.drop("start"), keys)
    return scored.select(*own.columns, F.expm1(_predicted(depth)).alias("expected_price")), model
