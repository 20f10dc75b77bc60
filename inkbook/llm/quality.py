"""Operator 5: quality rules, with robust multivariate outliers per language
and source. DataFrame functions only.

Base rules count words, characters, symbols, repeated lines and words of
repeated 3-word windows inside each text. What passes them is judged by the
minimum covariance determinant of its group (language, source): transformed
statistics (``FEATURES``) start from medians and quartiles; concentration
steps then take the mean and covariance of the three quarters of the rows
nearest so far; after a reweighting step, rows whose squared Mahalanobis
distance exceeds CUTOFF are rejected. Distances are ranked in fine log-scale
classes, so that the rank cut is an exact, partially aggregated count of a
bounded number of classes and no group is ever sorted or gathered. A floor
under each variance keeps statistics that hardly vary (symbols in clean prose)
from turning a single one into an outlier.

Groups with fewer than MIN_GROUP rows are judged together with the other small
groups of their language; where even those are too few, with all small groups;
below that nothing is rejected beyond the base rules.

Defined cases: a null text has no words and fails the base rules; a null
language or source counts as the empty name; repeated rows are kept, each with
its verdict; an empty table gives an empty result. Only the id, text, language
and source columns are read by ``judge``; ``keep`` returns the rows it is given
with all their columns."""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkbook.llm import common

MIN_WORDS = 50
MIN_GROUP = 40
#: Share of the rows that the concentration steps keep, and their number.
SUBSET, STEPS = 0.75, 3
FEATURES = ("f_words", "f_length", "f_symbols", "f_lines", "f_repeats")
#: Least standard deviation of each feature.
FLOORS = (0.3, 0.04, 0.03, 0.12, 0.12)
#: Medians and quantiles of chi-square with five degrees of freedom, and the
#: bound on the squared distance: documents of rare but sound kinds lie well
#: beyond the normal tail, so it is far out.
CHI2_MEDIAN, CHI2_975, CUTOFF = 4.351, 12.83, 60.0
STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
Q_COLUMNS = [f"q__{c}" for c in STATISTICS]
WHITE = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"


# --------------------------------------------------------- text statistics
def with_statistics(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds the base statistics as columns ``q__n_words`` and so on. (Plain
    columns: fields of a struct would be pulled into every use.)"""
    keep = df.columns
    body = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    df = df.withColumn("q__body", body)
    flat = F.translate(F.col("q__body"), WHITE, " " * len(WHITE))
    df = df.withColumn("q__words", F.array_remove(F.split(F.trim(flat), " "), ""))
    w = F.col("q__words")
    # one hash per 3-word window
    df = df.withColumn("q__windows", F.when(F.size(w) >= 3, F.transform(
        F.sequence(F.lit(1), F.size(w) - 2), lambda i: F.xxhash64(w[i - 1], w[i], w[i + 1])))
        .otherwise(F.array().cast("array<bigint>")))
    h = F.col("q__windows")
    # the rest only where some window occurs twice: windows sorted by hash,
    # the places of equal neighbours, and the words these places cover
    df = df.withColumn("q__sorted", F.when(F.size(F.array_distinct(h)) < F.size(h), F.array_sort(
        F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))
    s = F.col("q__sorted")
    equal_before = lambda x, k: (k > 0) & (s[F.greatest(k - 1, F.lit(0))]["h"] == x["h"])
    equal_after = lambda x, k: (k < F.size(s) - 1) & (s[F.least(k + 1, F.size(s) - 1)]["h"] == x["h"])
    df = df.withColumn("q__places", F.when(s.isNotNull(), F.array_sort(F.transform(
        F.filter(s, lambda x, k: equal_before(x, k) | equal_after(x, k)), lambda x: x["i"]))))
    p = F.col("q__places")
    covered = F.aggregate(p, F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")),
                          lambda a, i: F.struct((i + 3).alias("end"),
                                                (a["n"] + (i + 3 - F.greatest(i, a["end"]))).alias("n")),
                          lambda a: a["n"])
    lines = F.filter(F.split(F.col("q__body"), "\n"), lambda x: F.translate(x, WHITE, "") != "")
    df = df.withColumn("q__lines", lines)
    b = F.col("q__body")
    stats = {
        "n_words": F.size(w).cast("long"),
        "word_chars": F.char_length(F.translate(b, WHITE, "")).cast("long"),
        "n_symbols": (F.char_length(b) - F.char_length(F.translate(b, SYMBOLS, ""))).cast("long"),
        "n_dup_lines": (F.size("q__lines") - F.size(F.array_distinct("q__lines"))).cast("long"),
        "n_repeat_words": F.when(p.isNull(), F.lit(0).cast("long")).otherwise(covered),
        "n_lines": F.size("q__lines").cast("long")}
    return df.select(*keep, *[stats[c].alias(f"q__{c}") for c in STATISTICS])


def q(name: str) -> Column:
    return F.col(f"q__{name}")


def base_failed() -> Column:
    return (q("n_words") < MIN_WORDS) | (100 * q("n_repeat_words") > 50 * q("n_words"))


def features() -> list[Column]:
    """Transformed statistics: logarithms of sizes, roots of shares."""
    n = F.greatest(q("n_words"), F.lit(1)).cast("double")
    values = (F.log(n),
              F.log(F.greatest(q("word_chars"), F.lit(1)) / n),
              F.sqrt(q("n_symbols") / F.greatest(q("word_chars"), F.lit(1))),
              F.sqrt(q("n_dup_lines") / F.greatest(q("n_lines"), F.lit(1))),
              F.sqrt(q("n_repeat_words") / n))
    return [F.round(v, 4).alias(f) for v, f in zip(values, FEATURES)]


# ------------------------------------------------- estimates of the groups
def _centred(row: str = "", params: str = "p__") -> list[Column]:
    p = F.col(params)
    return [F.col(f) - p["m"][i] for i, f in enumerate(FEATURES)]


def distance(params: str = "p__") -> Column:
    """Squared Mahalanobis distance: the rows of the inverse factor, each
    applied to the centred features."""
    c, p, at, total = _centred(params=params), F.col(params), 0, None
    for i in range(len(FEATURES)):
        dot = None
        for j in range(i + 1):
            term = p["w"][at] * c[j]
            dot, at = term if dot is None else dot + term, at + 1
        total = dot * dot if total is None else total + dot * dot
    return total


def _factor(moments: DataFrame, keys: list[str]) -> DataFrame:
    """From n, sums s0.. and products t0_0.. of each group: the mean ``m`` and
    the inverse Cholesky factor ``w`` (lower triangle, by rows) of the floored
    covariance, scaled by ``scale``."""
    d = len(FEATURES)
    df = moments
    for i in range(d):
        df = df.withColumn(f"m{i}", F.col(f"s{i}") / F.col("n"))
    for i in range(d):
        for j in range(i + 1):
            cov = (F.col(f"t{i}_{j}") / F.col("n") - F.col(f"m{i}") * F.col(f"m{j}")) * F.col("scale")
            if i == j:
                cov = F.greatest(cov, F.lit(0.0)) + FLOORS[i] ** 2
            df = df.withColumn(f"c{i}_{j}", cov)
    # Cholesky: c = l l'
    for i in range(d):
        for j in range(i + 1):
            rest = F.col(f"c{i}_{j}")
            for k in range(j):
                rest = rest - F.col(f"l{i}_{k}") * F.col(f"l{j}_{k}")
            df = df.withColumn(f"l{i}_{j}", F.sqrt(F.greatest(rest, F.lit(1e-12))) if i == j
                               else rest / F.col(f"l{j}_{j}"))
    # its inverse, column by column
    for j in range(d):
        for i in range(j, d):
            rest = F.lit(1.0 if i == j else 0.0)
            for k in range(j, i):
                rest = rest - F.col(f"l{i}_{k}") * F.col(f"w{k}_{j}")
            df = df.withColumn(f"w{i}_{j}", rest / F.col(f"l{i}_{i}"))
    return df.select(*keys, F.struct(F.array(*[F.col(f"m{i}") for i in range(d)]).alias("m"),
                                     F.array(*[F.col(f"w{i}_{j}") for i in range(d) for j in range(i + 1)]).alias("w"))
                     .alias("p__"))


def _moments(rows: DataFrame, keys: list[str], scale: Column) -> DataFrame:
    sums = [F.sum(f).alias(f"s{i}") for i, f in enumerate(FEATURES)]
    products = [F.sum(F.col(FEATURES[i]) * F.col(FEATURES[j])).alias(f"t{i}_{j}")
                for i in range(len(FEATURES)) for j in range(i + 1)]
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), scale.alias("scale"), *sums, *products)


#: Distance classes: this many per unit of ln(1 + d2), up to a bounded number.
FINE, CLASSES = 32, 1000


def _class(d2: Column) -> Column:
    return F.least(F.floor(F.log(1 + d2) * FINE), F.lit(CLASSES)).cast("int")


def estimate(rows: DataFrame) -> DataFrame:
    """Mean and inverse factor (``p__``) of every group ``g__`` of the feature
    rows that has enough of them. The rows must be a stored table: every step
    reads it again."""
    keys = ["g__"]
    d = len(FEATURES)
    # classes of 0.01 keep the quartiles' counts bounded
    # what follows joins these groups, so the small ones end here
    quart = rows.groupBy("g__").agg(F.count("*").alias("n"), *[F.percentile(F.round(f, 2), F.array(*map(F.lit, (0.25, 0.5, 0.75)))).alias(f"q{i}")
                                      for i, f in enumerate(FEATURES)]).where(F.col("n") >= MIN_GROUP)
    spread = [F.greatest((F.col(f"q{i}")[2] - F.col(f"q{i}")[0]) / 1.349, F.lit(FLOORS[i])) for i in range(d)]
    start = quart.select("g__", F.struct(
        F.array(*[F.col(f"q{i}")[1] for i in range(d)]).alias("m"),
        F.array(*[1 / spread[i] if i == j else F.lit(0.0) for i in range(d) for j in range(i + 1)]).alias("w")).alias("p__"))
    params = common.store(start, "mcd")
    for _ in range(STEPS):
        near = rows.join(params, "g__").withColumn("k", _class(distance()))
        cut = near.groupBy("g__").agg(F.ceil(F.percentile("k", F.lit(SUBSET))).alias("cut"))
        subset = near.join(cut, "g__").where(F.col("k") <= F.col("cut"))
        params = common.store(_factor(_moments(subset, keys, F.lit(1.0)), keys), "mcd")
    # the subset's spread understates the whole's: match the median distance
    d2 = rows.join(params, "g__").withColumn("d2", distance())
    typical = d2.groupBy("g__").agg(
        F.greatest((F.exp((F.percentile(_class(F.col("d2")), F.lit(0.5)) + 0.5) / FINE) - 1) / CHI2_MEDIAN, F.lit(1.0))
        .alias("factor"))
    inner = d2.join(typical, "g__").where(F.col("d2") <= CHI2_975 * F.col("factor"))
    return common.store(_factor(_moments(inner, keys, F.lit(1.0)), keys), "mcd")


def grouped(rows: DataFrame, lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """Group ``g__`` of each (language, source): its name's hash, since every join
    on a string key holds a page of memory in the driver, on a number far less."""
    pair = rows.groupBy("lang__", "source__").count()
    small = F.col("count") < MIN_GROUP
    per_lang = pair.where(small).groupBy("lang__").agg(F.sum("count").alias("rest"))
    return pair.join(per_lang, "lang__", "left").select(
        "lang__", "source__",
        F.when(~small, F.xxhash64(F.lit("pair"), "lang__", "source__"))
        .when(F.col("rest") >= MIN_GROUP, F.xxhash64(F.lit("lang"), "lang__"))
        .otherwise(F.xxhash64(F.lit("all"))).alias("g__"))


def _named(df: DataFrame, lang_col: str, source_col: str) -> DataFrame:
    return (df.withColumn("lang__", F.coalesce(F.col(lang_col).cast("string"), F.lit("")))
            .withColumn("source__", F.coalesce(F.col(source_col).cast("string"), F.lit(""))))


def fit(stats: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(groups, estimates) from stored rows with lang__, source__ and the statistics."""
    passed = stats.where(~base_failed())
    groups = common.store(grouped(passed), "mcd-groups")
    rows = common.store(passed.join(groups, ["lang__", "source__"])
                        .select("g__", *features()), "mcd-rows")
    return groups, estimate(rows)


def verdict(stats: DataFrame, groups: DataFrame, params: DataFrame) -> DataFrame:
    """Adds base_failed, d2 (null without an estimate) and kept to rows with
    lang__, source__ and the statistics."""
    rows = (stats.join(groups, ["lang__", "source__"], "left").join(params, "g__", "left")
            .select(*stats.columns, "p__", *features()))
    return (rows.withColumn("base_failed", base_failed())
            .withColumn("d2", F.when(F.col("p__").isNotNull(), distance()))
            .withColumn("kept", ~F.col("base_failed") & (F.coalesce(F.col("d2"), F.lit(0.0)) <= CUTOFF)))


def judge(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          source_col: str = "source") -> DataFrame:
    """doc_id, the base statistics, base_failed, d2, kept of every document."""
    common.prepare(docs.sparkSession)
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text__"),
                      F.col(lang_col).alias("lang"), F.col(source_col).alias("source"))
    stats = common.store(_named(with_statistics(own, "text__"), "lang", "source")
                         .select("doc_id", "lang__", "source__", *Q_COLUMNS), "quality")
    out = verdict(stats, *fit(stats))
    return out.select("doc_id", *[q(c).alias(c) for c in STATISTICS[:-1]], "base_failed", "kept", "d2")


def keep(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """The rows of ``docs`` that are kept, with their columns. The statistics
    are computed a second time beside the texts: neither a copy of the texts
    nor a shuffle of them is needed."""
    common.prepare(docs.sparkSession)

    def stated(df):
        own = df.select(F.struct("*").alias("row__"), F.col(text_col).alias("text__"),
                        F.col(lang_col).alias("lang"), F.col(source_col).alias("source"))
        # a row number that the last filter reads: the optimiser does not carry
        # a filter below it, where it would repeat every statistic's expression
        return _named(with_statistics(own, "text__"), "lang", "source") \
            .select("row__", "lang__", "source__", *Q_COLUMNS, F.monotonically_increasing_id().alias("mark__"))
    light = common.store(stated(docs).select("lang__", "source__", *Q_COLUMNS), "quality")
    return verdict(stated(docs), *fit(light)).where("kept AND mark__ >= 0").select("row__.*")
