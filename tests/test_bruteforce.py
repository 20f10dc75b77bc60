"""Queries without a SQL oracle, checked against brute force on small data,
and grouping-key properties."""
import re

import pytest
from pyspark.sql import functions as F

from inkbook.functions.text import HEDGE, NUMERIC_TOKEN
from inkbook.operators import churn
from inkbook.operators.derive import derive
from inkbook.sources.fixtures import jobs_view

SF = "/root/testdata/sf0.001"


def test_document_figures_match_python_regex(spark):
    import __spark_entry__ as E
    got = {r.doc_id: (r.n_figures, r.hedged, r.banned) for r in E.queries()["document_figures"](spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    tok = re.compile(NUMERIC_TOKEN, re.ASCII)
    hedge = re.compile(HEDGE, re.ASCII)
    want = {d.doc_id: (len(tok.findall(d.text or "")), bool(hedge.search(d.text or "")), "—" in (d.text or ""))
            for d in docs}
    assert got == want


def test_grouped_equals_filtered(spark):
    jd = derive(jobs_view(spark, SF), by=("region",))
    grouped = churn.churn_status(jd, by=("region",))
    regions = [r.region for r in jd.select("region").distinct().collect()]
    for reg in regions:
        alone = churn.churn_status(derive(jobs_view(spark, SF).filter(F.col("region") == reg)))
        a = sorted(tuple(r) for r in grouped.filter(F.col("region") == reg).drop("region").collect())
        b = sorted(tuple(r) for r in alone.drop("region").collect())
        assert a == b, reg


def test_statuses_partition_customers(spark):
    st = churn.churn_status(derive(jobs_view(spark, SF)))
    s = churn.churn_summary(st).first()
    assert s.active + s.at_risk + s.dormant == s.customers == st.count()


def test_quantiles_when_one_value_holds_most_rows(spark):
    import numpy as np
    from inkbook.operators.common import exact_quantiles
    rng = np.random.default_rng(1)
    rows = [("a", 5.0)] * 900 + [("a", float(x)) for x in rng.normal(5, 3, 100)] + \
        [(None, float(x)) for x in range(7)] + [("b", None), ("c", 1.5)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(7)
    got = {r["k"]: (r["lo"], r["m"], r["hi"]) for r in exact_quantiles(df, "v", ["k"], {"lo": .05, "m": .5, "hi": .95}).collect()}
    for k in ("a", None, "c"):
        want = np.percentile([v for kk, v in rows if kk == k], [5, 50, 95])
        assert np.allclose(got[k], want)
    assert "b" not in got
    one = exact_quantiles(df.where("k = 'a'"), "v", [], {"m": .5}).first()
    assert one["m"] == 5.0


def test_every_tied_account_is_named(spark):
    from inkbook.operators import value
    bc = spark.createDataFrame([(f"c{i}", f"N{i}", 100.0 - (i == 19) * 50) for i in range(20)],
                               "customer_id string, customer_name string, total_va_amount double")
    assert {r["customer_id"] for r in value.tied_accounts(bc).collect()} == {f"c{i}" for i in range(19)}


def test_pareto_by_rank(spark):
    import random
    from pyspark.sql import functions as F
    from inkbook.operators import value
    rng = random.Random(2)
    for values in ([10] * 50, [rng.randint(1, 9) for _ in range(80)], [5, 5, 0, 0, -3, -4], [0, 0], [100, -20, -20], [7]):
        bc = spark.createDataFrame([(f"c{i}", f"n{i}", v) for i, v in enumerate(values)],
                                   "customer_id string, customer_name string, v long") \
            .withColumn("total_va_amount", F.col("v").cast("decimal(28,8)")) \
            .withColumn("_total_va", F.lit(sum(values)).cast("decimal(28,8)"))
        cum = n = 0
        for v in sorted(values, reverse=True):
            cum += v
            n += sum(values) == 0 or cum / sum(values) * 100 <= 80
        got = value.pareto_80(bc).first()
        assert (got["customer_count"], got["customers_for_80pct_value"]) == (len(values), max(n, 1)), values


@pytest.mark.parametrize("n", [1, 2, 3, 7, 100, 40_000])
def test_quantiles_and_prefix_sums_of_any_size(spark, n):
    """Equal to the built-in percentile and to a plain running sum."""
    from inkbook.operators import common
    df = spark.range(n).select((F.xxhash64("id") % 100_003 / 7).alias("v"), (F.col("id") % 3 == 0).alias("k"))
    qs = {"a": .0, "b": .05, "c": .5, "d": .93, "e": 1.0}
    want = {r["k"]: r for r in df.groupBy("k").agg(*[F.percentile("v", q).alias(m) for m, q in qs.items()]).collect()}
    got = common.exact_quantiles(df, "v", ["k"], qs)
    assert "Window" not in got._jdf.queryExecution().executedPlan().toString()
    for r in got.collect():
        assert [r[m] for m in qs] == pytest.approx([want[r["k"]][m] for m in qs], rel=1e-12)
    d = df.groupBy("k", "v").agg(F.count(F.lit(1)).alias("c"))
    out = common.prefix_sums(d, "v", ["k"], {"before": F.col("c")}, ascending=False).collect()
    for k in {r.k for r in out}:
        total = 0
        for r in sorted((r for r in out if r.k == k), key=lambda r: -r.v):
            assert r.before == total
            total += r.c
