"""Operator 12 against a plain restatement of its contract."""
import hashlib
import random
import re

import numpy as np
import pytest

from inkbook.llm import common, passages
from tests.llm.frames import empty_like, odd_documents


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute(rows, order, window=20):
    """rows: (doc_id, text); order: place of each row's document."""
    first = {}
    docs = [words_of(t) for _, t in rows]
    for o, w in zip(order, docs):
        for i in range(len(w) - window + 1):
            key = tuple(w[i:i + window])
            first[key] = min(first.get(key, (o, i)), (o, i))
    out = []
    for (doc_id, _), o, w in zip(rows, order, docs):
        gone = set()
        for i in range(len(w) - window + 1):
            if first[tuple(w[i:i + window])] != (o, i):
                gone.update(range(i, i + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((doc_id, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def rows_of(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_words", "n_removed", "kept_sha256").collect()), key=repr)


def corpus(seed):
    """Copies, near copies, shared passages, repeated lines and plain texts."""
    rng = random.Random(seed)

    def prose(n, vocabulary=400):
        return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]
    passage, line = prose(60), prose(22)
    texts = [prose(rng.randrange(0, 150)) for _ in range(40)]
    base = prose(300)
    texts += [base] * 5
    for _ in range(15):
        t = base[:]
        t[rng.randrange(300)] = "edit"
        texts.append(t)
    for _ in range(25):
        k = rng.randrange(20, 61)
        texts.append(prose(rng.randrange(30)) + passage[60 - k:] + prose(rng.randrange(30)))
    texts += [line * 30, prose(5) + line * 3, ["same"] * 500, ["same"] * 19, ["a", "b"] * 60, ["same"] * 25 + ["end"]]
    rng.shuffle(texts)
    return [(i * 3 % 997, " ".join(t)) for i, t in enumerate(texts)]


def test_nodes_of_the_tree():
    """Leaves of one node hold the same window; windows cross no segment."""
    rng = np.random.default_rng(1)
    sizes = rng.integers(20, 60, 30)
    words = rng.integers(0, 2, int(sizes.sum())).astype(np.uint64)
    words[:200] = words[200:400]
    place, node = passages.subtree(words, sizes, 20)
    ends = np.cumsum(sizes)
    inside = [i for lo, hi in zip(ends - sizes, ends) for i in range(lo, hi - 19)]
    assert sorted(place.tolist()) == inside
    groups = {}
    for p, n in zip(place.tolist(), node.tolist()):
        groups.setdefault(n, set()).add(tuple(words[p:p + 20].tolist()))
    assert all(len(g) == 1 for g in groups.values())
    assert len(groups) == len({tuple(words[p:p + 20].tolist()) for p in inside})


@pytest.mark.parametrize("heavy", [0, 3, 4096])
def test_repeats(spark, heavy):
    """Any split into short and long prefixes gives the same result."""
    common.prepare(spark)
    rows = corpus(heavy + 1)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = brute(rows, [i for i, _ in rows])
    assert rows_of(passages.remove_repeats(docs, heavy=heavy)) == want
    assert sum(r[2] for r in want) > 5000


def test_small_groups_and_pieces(spark, monkeypatch):
    common.prepare(spark)
    monkeypatch.setattr(passages, "TREE_WORDS", 50)
    rows = corpus(9)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert rows_of(passages.remove_repeats(docs)) == brute(rows, [i for i, _ in rows])


def test_odd_rows(spark):
    """Null and repeated ids, equal rows, empty and long texts, odd columns."""
    common.prepare(spark)
    long = " ".join(f"u{i}" for i in range(50))
    docs = odd_documents(spark, [long, long + " x", "y " + long])
    extra = docs.filter("doc_id = 27 or doc_id = 28").withColumn("doc_id", docs.doc_id * 0)
    docs = docs.unionByName(extra).unionByName(docs.filter("doc_id > 25"))
    docs = docs.unionByName(extra.withColumn("doc_id", extra.doc_id + passages.F.lit(None).cast("long")))
    keyed = docs.selectExpr("doc_id", "text", f"coalesce(doc_id, {passages.LAST}) as o", "xxhash64(coalesce(text, '')) as h")
    rows = keyed.collect()
    want = brute([(r.doc_id, r.text) for r in rows], [(r.o, r.h) for r in rows])
    assert rows_of(passages.remove_repeats(docs)) == want


def test_empty_table(spark):
    common.prepare(spark)
    assert passages.remove_repeats(empty_like(odd_documents(spark))).count() == 0


def test_query_over_the_table(spark):
    from inkbook.llm.queries import QUERIES
    sf = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert rows_of(QUERIES["op12_passages"](spark, sf)) == brute(rows, [i for i, _ in rows])
