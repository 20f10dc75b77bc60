"""Grouped price model: reports fitted together equal their own fits, and the
trees equal a brute-force boosting of the same bins."""
from __future__ import annotations

import dataclasses
import math

import pytest
from pyspark.sql import functions as F

from inkbook.config import DEFAULT
from inkbook.operators import boosting, quote
from inkbook.operators.derive import derive
from inkbook.sources.fixtures import jobs_view

SF = "/root/testdata/sf0.001"
SHORT = dict(rounds=2, depth=2)


@pytest.fixture(scope="module")
def split(spark):
    jobs = derive(jobs_view(spark, SF)).withColumn("report_id", F.pmod(F.xxhash64("row_key"), F.lit(4)))
    jobs = jobs.withColumn("report_id", F.when(F.col("report_id") < 2, 1).otherwise(F.col("report_id")))
    return quote.holdout_split(quote.price_features(jobs, ["report_id"])).persist()


def prices(df):
    """Rows may share a key, so pairs in order."""
    return sorted((r.row_key, r.expected_price) for r in df.collect())


def test_each_report_equals_its_own_fit(split):
    together, models = boosting.grouped_predictions(split, ["report_id"], **SHORT)
    assert together.count() == split.filter("is_test").count() and models.count() == 3
    alone, _ = boosting.grouped_predictions(split.filter("report_id = 2"), **SHORT)
    own = prices(alone)
    assert own and own == prices(together.filter("report_id = 2"))


def brute(rows, rounds, depth, step):
    """Predicted labels by the same rules in plain Python."""
    train = [r for r in rows if not r["is_test"]]
    pred = {r["row_key"]: r["start"] for r in rows}

    def unit(x):
        return int(math.copysign(math.floor(abs(x) * boosting.UNIT + 0.5), x))
    for _ in range(rounds):
        g = {r["row_key"]: unit(r["label"] - pred[r["row_key"]]) for r in train}

        def grow(mine, level):
            total, n = sum(g[r["row_key"]] for r in mine), len(mine)
            best = None
            for i in range(len(rows[0]["bins"])):
                for b in sorted({r["bins"][i] for r in mine}):
                    left = [r for r in mine if r["bins"][i] <= b]
                    nl, gl = len(left), sum(g[r["row_key"]] for r in left)
                    if nl < boosting.LEAF or n - nl < boosting.LEAF:
                        continue
                    gain = float(gl) * gl / nl + float(total - gl) * (total - gl) / (n - nl) - float(total) * total / n
                    if gain > 0 and (best is None or gain > best[0]):
                        best = (gain, i, b)
            if best is None:
                value = total / n / boosting.UNIT if n else 0.0
                return lambda r: value
            _, i, b = best
            sides = [[r for r in mine if (r["bins"][i] > b) == s] for s in (False, True)]
            if level == depth - 1:
                means = [sum(g[r["row_key"]] for r in s) / len(s) / boosting.UNIT for s in sides]
                return lambda r: means[r["bins"][i] > b]
            kids = [grow(s, level + 1) for s in sides]
            return lambda r: kids[r["bins"][i] > b](r)
        tree = grow(train, 0)
        for r in rows:
            pred[r["row_key"]] += step * tree(r)
    return pred


def test_trees_equal_brute_force(spark, split):
    keys = ["report_id"]
    rows = boosting.binned(split, keys, DEFAULT).filter("report_id = 3").persist()
    model = boosting.fit_grouped(rows, keys, rounds=3, depth=2)
    got = sorted((r.row_key, r.p) for r in rows.join(model.drop("start"), keys)
                 .select("row_key", boosting._predicted(2).alias("p")).collect())
    own = [r.asDict() for r in rows.collect()]
    pred = brute([{**r, "row_key": i} for i, r in enumerate(own)], 3, 2, DEFAULT.gbt_step_size)
    want = sorted((r["row_key"], pred[i]) for i, r in enumerate(own))
    assert [k for k, _ in got] == [k for k, _ in want]
    assert max(abs(g - w) for (_, g), (_, w) in zip(got, want)) < 1e-9


def test_codes_leave_the_own_fold_out(spark, split):
    """A category that occurs in one fold only has no code there but the mean's."""
    one = split.withColumn("work_type", F.when(quote._fold() == 2, "rare").otherwise(F.col("work_type")))
    rows = boosting.binned(one, ["report_id"], DEFAULT)
    at = len(quote.NUMERIC_FEATURES)
    off = rows.filter("work_type = 'rare' AND NOT is_test") \
        .filter(F.col("bins")[at] != boosting._code_bin(F.col("start"))).count()
    assert off == 0


def test_small_empty_and_null_groups(spark, split):
    few = split.limit(150)
    scored, models = boosting.grouped_predictions(few, **SHORT)
    assert scored.count() == 0 and models.count() == 0
    scored, models = boosting.grouped_predictions(split.limit(0), ["report_id"], **SHORT)
    assert scored.count() == 0 and models.count() == 0
    lost = split.withColumn("report_id", F.lit(None).cast("long"))
    assert boosting.grouped_predictions(lost, ["report_id"], **SHORT)[0].count() == 0


def test_more_rounds_lower_the_error(split):
    cfg = dataclasses.replace(DEFAULT, gbt_step_size=0.3)

    def error(rounds):
        scored, _ = boosting.grouped_predictions(split, ["report_id"], cfg, rounds=rounds, depth=3)
        s = split.withColumn("expected_price", F.lit(0.0))
        m = quote.benchmark_metrics(scored.select(*s.columns), split, ["report_id"]).collect()
        assert {r.report_id for r in m} == {1, 2, 3}
        return sum(r.mae for r in m)
    assert error(6) < error(1)
