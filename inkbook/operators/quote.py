"""Quote benchmark (G1–G6): what comparable work sells for.

Two predictors share one evaluation: a boosted-tree regression in log
space (``trees``, fitted on the training split) and a transparent
comparable-work median that SQL can restate exactly. The split is a hash of
the row key, so it does not depend on partitioning or on row order."""
from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkbook.config import DEFAULT, Config
from inkbook.operators.common import attach, exact_quantiles, rnd, top_k
from inkbook.operators.trees import Trees, fit, predicted

# Model inputs. Price outcomes (VA, markup, manual adjustment,
# handling) are left out on purpose: they would let the model read the answer.
NUMERIC_FEATURES = ["quantity", "impressions", "plates", "press_hrs", "paper_base", "labour_base",
                    "purchases_base"]
CATEGORICAL_FEATURES = ["work_type", "region", "currency", "product_type_clean"]
# How the inputs are named to readers.
FEATURE_LABELS = {
    "quantity": "Order quantity", "impressions": "Impressions (sheets)", "plates": "Printing plates",
    "press_hrs": "Press hours", "paper_base": "Paper cost", "labour_base": "Labour cost",
    "purchases_base": "Bought-in cost", "work_type": "Work type", "region": "Region", "currency": "Currency",
    "product_type_clean": "Product type",
}


def _row_key(df: DataFrame) -> DataFrame:
    if "row_key" in df.columns:
        return df
    return df.withColumn("row_key", F.sha2(F.to_json(F.struct(*df.columns)), 256))


def price_features(jobs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Priced jobs with model features; NULL categories read 'Unknown'."""
    d = _row_key(jobs).filter(F.col("sell_price_base") > 0)
    # a grouping key that is a feature too stays as it is, once
    own = [c for c in CATEGORICAL_FEATURES if c not in by]
    return d.select(*by, "row_key", "job_id", "customer_name",
                    *[F.col(c).cast("double").alias(c) for c in NUMERIC_FEATURES],
                    *[F.coalesce(F.col(c).cast("string"), F.lit("Unknown")).alias(c) for c in own],
                    F.col("sell_price_base").alias("actual_price"),
                    F.log1p("sell_price_base").alias("label"))


def features_used(split: DataFrame) -> DataFrame:
    """The model's inputs and how they read (one row per input)."""
    rows = [(i + 1, f, FEATURE_LABELS[f]) for i, f in enumerate([*NUMERIC_FEATURES, *CATEGORICAL_FEATURES])]
    names = F.explode(F.array(*[F.struct(F.lit(i).cast("bigint").alias("ordinal"), F.lit(f).alias("feature"),
                                         F.lit(t).alias("label")) for i, f, t in rows])).alias("x")
    # how many of the split's jobs have a value for it
    present = split.agg(*[F.count(F.when(F.col(f).cast("string") != "Unknown", 1)).alias(f) for _, f, _ in rows])
    pairs = F.create_map(*[e for _, f, _ in rows for e in (F.lit(f), F.col(f))])
    return present.select(names, pairs.alias("m")).select("x.*", F.col("m")[F.col("x.feature")].alias("jobs_with_value"))


def holdout_split(features: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """1 bucket in ``holdout_buckets`` is held out, chosen by a hash of the
    row key (identical on every engine and partitioning)."""
    h = F.conv(F.substring(F.md5("row_key"), 1, 8), 16, 10).cast("bigint")
    return features.withColumn("is_test", (h % cfg.holdout_buckets) == 0)


def comparable_baseline(split: DataFrame, by: Sequence[str] = (), cfg: Config = DEFAULT) -> DataFrame:
    """Expected price of each held-out job = median log price per unit of its
    (work type, product) on the training split, falling back to work type and
    then to all training jobs; times its quantity. Fewer than ``min_priced_jobs`` priced
    jobs are too few to compare with: they give no rows."""
    by = list(by)
    enough = split.groupBy(*by).agg(F.count(F.lit(1)).alias("_priced"))
    train = split.filter(~F.col("is_test") & (F.col("quantity") > 0)) \
        .withColumn("_lpu", F.log1p(F.col("actual_price") / F.col("quantity")))
    test = attach(split.filter(F.col("is_test")), enough, by) \
        .filter(F.col("_priced") >= cfg.min_priced_jobs).drop("_priced")

    def median(keys, name):
        return exact_quantiles(train, "_lpu", [*by, *keys], {name: 0.5})
    m1, m2, m3 = median(["work_type", "product_type_clean"], "_m1"), median(["work_type"], "_m2"), median([], "_m3")
    j = test.join(m1, on=[*by, "work_type", "product_type_clean"], how="left") \
        .join(m2, on=[*by, "work_type"], how="left")
    j = attach(j, m3, by)
    m = F.coalesce("_m1", "_m2", "_m3")
    return j.withColumn("expected_price", F.expm1(m) * F.col("quantity")).drop("_m1", "_m2", "_m3")


@dataclass
class PriceModel:
    """Boosted trees with what they need of the training jobs: per category of
    each categorical input its smoothed mean log price (``codes``: feature,
    value, code) and the mean of all."""
    trees: Trees
    codes: DataFrame
    mean: float

    def save(self, path: str) -> None:
        """Store the model (under its report, say); ``load`` brings it back."""
        spark = self.codes.sparkSession
        spark.createDataFrame([(self.trees.to_json(), self.mean)], "trees string, mean double") \
            .coalesce(1).write.mode("overwrite").parquet(f"{path}/trees")
        self.codes.write.mode("overwrite").parquet(f"{path}/codes")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "PriceModel":
        codes = spark.read.schema("feature string, value string, fold int, code double").parquet(f"{path}/codes")
        own = spark.read.schema("trees string, mean double").parquet(f"{path}/trees").first()
        return cls(Trees.from_json(own.trees), codes, own.mean)


FOLDS = 5


def _fold() -> Column:
    """The fold of a training job; held-out jobs have none."""
    return F.when(F.col("is_test"), F.lit(-1)).otherwise(F.pmod(F.xxhash64("row_key"), F.lit(FOLDS)).cast("int"))


def category_codes(train: DataFrame, cfg: Config = DEFAULT) -> tuple[DataFrame, float]:
    """(feature, value, fold, code) of every category and the overall mean: the
    mean log price of its jobs, drawn to the overall mean as if by
    ``code_prior`` further jobs. A fold's codes leave its own jobs out, so the
    trees do not learn a job's price from itself; fold -1 has all of them. One
    aggregate for all features, and a tree sees one number per category, so its
    work does not grow with their number."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("value"))
                                for c in CATEGORICAL_FEATURES])).alias("_p")
    fold = F.col("_fold") if "_fold" in train.columns else _fold()
    sums = train.select(pairs, fold.alias("_f"), "label").groupBy("_p", "_f").agg(
        F.sum("label").alias("s"), F.count(F.lit(1)).alias("n"))
    others = F.explode(F.filter(F.array(*map(F.lit, range(-1, FOLDS))), lambda g: g != F.col("_f"))).alias("fold")
    sums = sums.select("_p", others, "s", "n").groupBy("_p", "fold").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    mean = train.agg(F.avg("label")).first()[0] or 0.0
    code = (F.col("s") + F.lit(cfg.code_prior * mean)) / (F.col("n") + cfg.code_prior)
    return sums.select("_p.feature", "_p.value", "fold", code.alias("code")), mean


INPUTS = [*NUMERIC_FEATURES, *[f"_{c}" for c in CATEGORICAL_FEATURES]]


def _inputs(split: DataFrame, codes: DataFrame, mean: float) -> DataFrame:
    """``split`` with the model's inputs; categories by their codes."""
    out = split if "_fold" in split.columns else split.withColumn("_fold", _fold())
    for c in CATEGORICAL_FEATURES:
        own = codes.filter(F.col("feature") == c).select(F.col("value").alias(c), F.col("fold").alias("_fold"),
                                                         F.col("code").alias(f"_{c}"))
        out = out.join(own, [c, "_fold"], "left").withColumn(f"_{c}", F.coalesce(f"_{c}", F.lit(mean)))
    return out


def _known(c: str) -> Column:
    return F.coalesce(F.nanvl(F.col(c), F.lit(None)), F.lit(0.0))


def train_price_model(split: DataFrame, cfg: Config = DEFAULT):
    """Fit the boosted trees on the training split. Returns the model and None,
    or None with a reason (then the predictions are empty) when fewer than
    ``min_priced_jobs`` rows are priced.

    What training reads of the split is stored once, and so are the codes: their
    size is then known, and few codes go to the jobs, not the jobs to them."""
    from inkbook.llm.common import store

    train = split.filter(~F.col("is_test")).select(
        _fold().alias("_fold"), "label", *[_known(c).alias(c) for c in NUMERIC_FEATURES], *CATEGORICAL_FEATURES)
    train = store(train.withColumn("is_test", F.lit(False)), "train")
    if split.filter("is_test").count() + train.count() < cfg.min_priced_jobs:
        return None, "Not enough priced jobs to train a reliable model."
    codes, mean = category_codes(train, cfg)
    codes = store(codes, "codes")
    trees = fit(_inputs(train, codes, mean), INPUTS, "label", rounds=cfg.gbt_max_iter, depth=cfg.gbt_max_depth,
                step=cfg.gbt_step_size, bins=cfg.gbt_max_bins, leaf=20)
    return PriceModel(trees, codes, mean), None


def model_predictions(model: PriceModel | None, split: DataFrame) -> DataFrame:
    """Held-out jobs scored by the fitted model (expected price in money)."""
    if model is None:
        return split.filter(F.lit(False)).withColumn("expected_price", F.lit(None).cast("double"))
    numbers = {c: f"_n_{c}" for c in NUMERIC_FEATURES}
    rows = _inputs(split.filter(F.col("is_test")), model.codes, model.mean) \
        .withColumns({own: _known(c) for c, own in numbers.items()})
    pred = predicted(rows, [*numbers.values(), *INPUTS[len(numbers):]], model.trees, "prediction")
    return pred.select(*split.columns, F.expm1("prediction").alias("expected_price"))


def benchmark_metrics(scored: DataFrame, split: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """R² in log space, MAE, median absolute % error, share within 10% / 25%,
    and split sizes."""
    by = list(by)
    s = scored.withColumns({
        "_y": F.col("label"), "_p": F.log1p("expected_price"),
        "_pe": F.abs(F.col("expected_price") - F.col("actual_price")) / F.col("actual_price")})
    # One pass: total sum of squares as sum(y^2) - (sum y)^2 / n (log prices
    # are small, so the subtraction loses nothing that rounding keeps).
    agg = s.groupBy(*by).agg(
        (F.lit(1.0) - F.sum((F.col("_y") - F.col("_p")) ** 2)
         / (F.sum(F.col("_y") ** 2) - F.sum("_y") ** 2 / F.count(F.lit(1)))).alias("_r2"),
        F.avg(F.abs(F.col("expected_price") - F.col("actual_price"))).alias("_mae"),
        F.avg(F.when(F.col("_pe") <= 0.10, 1.0).otherwise(0.0)).alias("_w10"),
        F.avg(F.when(F.col("_pe") <= 0.25, 1.0).otherwise(0.0)).alias("_w25"))
    med = exact_quantiles(s, "_pe", by, {"_med": 0.5})
    sizes = split.groupBy(*by).agg(F.count(F.when(~F.col("is_test"), 1)).alias("train_rows"),
                                   F.count(F.when(F.col("is_test"), 1)).alias("test_rows"))
    df = attach(attach(agg, med, by), sizes, by)
    return df.select(*by, rnd("_r2", 3).alias("r2_log"), rnd("_mae", 2).alias("mae"),
                     rnd(F.col("_med") * 100, 1).alias("median_abs_pct_error"),
                     rnd(F.col("_w10") * 100, 1).alias("within_10pct"),
                     rnd(F.col("_w25") * 100, 1).alias("within_25pct"), "train_rows", "test_rows")


def _gaps(scored: DataFrame) -> DataFrame:
    return scored.withColumns({
        "gap": F.col("actual_price") - F.col("expected_price"),
        "gap_pct": F.try_divide(F.col("actual_price") - F.col("expected_price"), F.col("expected_price")) * 100})


def underpriced_jobs(scored: DataFrame, by: Sequence[str] = (), cfg: Config = DEFAULT) -> DataFrame:
    """The held-out jobs furthest below the going rate (gap% <= -20)."""
    g = _gaps(scored).filter(F.col("gap_pct") <= -cfg.underpriced_threshold_pct * 100)
    top = top_k(g, [F.col("gap").asc(), F.col("row_key").asc()], cfg.top_flagged_jobs, by)
    return top.select(*by, "row_key", "job_id", "customer_name", F.col("product_type_clean").alias("product_type"),
                      "work_type", rnd("quantity").alias("quantity"), rnd("actual_price").alias("actual_price"),
                      # model estimates: 4 dp (their last bits depend on the math library)
                      rnd("expected_price", 4).alias("expected_price"), rnd("gap", 4).alias("gap"),
                      rnd("gap_pct", 4).alias("gap_pct"))


def underpriced_summary(scored: DataFrame, by: Sequence[str] = (), cfg: Config = DEFAULT) -> DataFrame:
    g = _gaps(scored)
    flag = g["gap_pct"] <= -cfg.underpriced_threshold_pct * 100
    return g.groupBy(*by).agg(
        F.count(F.when(flag, 1)).alias("flagged_count"),
        rnd(F.coalesce(F.try_divide(F.count(F.when(flag, 1)), F.count(F.lit(1))), F.lit(0.0)) * 100, 1)
        .alias("flagged_share_pct"),
        rnd(F.coalesce(F.sum(F.when(flag, F.col("gap").cast("decimal(28,8)"))), F.lit(0)), 2).alias("value_gap"),
        F.lit(round(cfg.underpriced_threshold_pct * 100, 0)).alias("threshold_pct"))
