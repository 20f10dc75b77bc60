"""Operator 13 against a plain restatement of its contract."""
import hashlib
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from inkbook.llm import common, importance, wordscan
from tests.llm.frames import empty_like, odd_documents

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    raw = (text or "").encode().translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"))
    return WORD.findall(raw)


def buckets_of(text):
    w = words_of(text)
    return [zlib.crc32(b" ".join(w[i:i + n])) % 10000 for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def brute(docs, target):
    s, t = np.zeros(10000, int), np.zeros(10000, int)
    for _, x in docs:
        np.add.at(s, buckets_of(x), 1)
    for x in target:
        np.add.at(t, buckets_of(x), 1)
    S, T = int(s.sum()), int(t.sum())
    gain = [math.floor(1000 * math.log((b + 1) * (S + 10000) / ((a + 1) * (T + 10000))))
            for a, b in zip(s.tolist(), t.tolist())]
    rows = []
    for i, x in docs:
        f = buckets_of(x)
        weight = sum(gain[b] for b in f)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))),
                     len(words_of(x))])
    able = sorted((r for r in rows if r[4] >= 20), key=lambda r: (-r[3], r[0] is None, r[0]))
    for k, r in enumerate(able):
        r.append(k + 1 if k < 5 * len(able) // 100 else None)
    return sorted([(r[0], r[1], r[2], r[3], r[5] if len(r) > 5 else None) for r in rows], key=repr)


def rows_of(df):
    return sorted([tuple(r) for r in df.select("doc_id", "n_features", "weight", "score", "rank").collect()], key=repr)


def test_shifts_cancel_prefixes():
    rng = np.random.default_rng(5)
    data = rng.integers(0, 256, 70_000, dtype=np.uint8).tobytes()
    cuts = [(0, 1), (3, 7), (10, 137), (10, 138), (100, 66_000), (5, 5)]
    crc = np.array([zlib.crc32(data[:a]) for a, _ in cuts], np.uint32)
    whole = np.array([zlib.crc32(data[:b]) for _, b in cuts], np.uint32)
    got = whole ^ importance.shift(crc, np.array([b - a for a, b in cuts]))
    assert got.tolist() == [zlib.crc32(data[a:b]) for a, b in cuts]


def test_texts_cut_into_pieces(monkeypatch):
    """A text longer than a piece has the same features."""
    text = "Ab ça 9 x-y " * 60
    monkeypatch.setattr(common, "CHUNK", 50)
    got = sorted(int(b) for _, bucket, _ in importance.features(pa.array(["one two", text, "", "three"]))
                 for b in bucket)
    assert got == sorted(buckets_of("one two") + buckets_of(text) + buckets_of("three"))


def test_odd_rows(spark):
    common.prepare(spark)
    docs = odd_documents(spark, ["alpha beta " * 40, "gamma delta epsilon " * 30, *[f"w{i} alpha beta " * 15 for i in range(60)]])
    target = spark.createDataFrame([(1, "alpha beta gamma"), (2, None), (3, "word word")], "item_id long, text string")
    pairs = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    want = brute(pairs, ["alpha beta gamma", None, "word word"])
    assert rows_of(importance.resample(docs, target)) == want
    assert sum(r[4] is not None for r in want) > 0


def test_empty_tables(spark):
    common.prepare(spark)
    docs = odd_documents(spark)
    target = spark.createDataFrame([], "item_id long, text string")
    assert importance.resample(empty_like(docs), target).count() == 0
    assert importance.resample(docs, target).count() == docs.count()


def test_query_over_the_table(spark):
    from inkbook.llm.queries import QUERIES
    sf = "/root/testdata/sf0.01"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    target = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert rows_of(QUERIES["op13_importance"](spark, sf)) == brute(docs, target)
