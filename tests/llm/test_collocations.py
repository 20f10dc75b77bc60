"""Operator 11 against a plain restatement of its contract."""
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from inkbook.llm import collocations, common
from tests.llm.frames import empty_like, odd_documents

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def pieces(text):
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(FOLD))]


def brute(docs, least=10, top=2000):
    """docs: (lang, text)"""
    f, out = {}, []
    for lang, text in docs:
        c = f.setdefault(lang or "und", Counter())
        for w in pieces(text):
            for k in (1, 2, 3):
                c.update(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    for lang, c in f.items():
        n = sum(v for g, v in c.items() if len(g) == 1)
        cand = {g: a for g, a in c.items() if len(g) > 1 and a >= least}
        rows = []
        for g, a in cand.items():
            if len(g) == 2 and any(2 * v >= a and g in (t[:2], t[1:]) for t, v in cand.items() if len(t) == 3):
                continue
            s, k = min((1000000 * a * a // (c[g[:k]] * c[g[k:]]), k) for k in range(1, len(g)))
            rows.append((-s, -a, " ".join(g).encode(), c[g[:k]], c[g[k:]]))
        out += [(lang, i + 1, p.decode(), -a, l, r, n, -s) for i, (s, a, p, l, r) in enumerate(sorted(rows)[:top])]
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def test_index_counts_every_pattern():
    """Extensions to both sides, from the same index after a file round trip."""
    rng = np.random.default_rng(3)
    text = np.concatenate([[0], np.where(rng.random(3000) < .1, 0, rng.integers(1, 9, 3000)), [0]])
    index = collocations.Index.load(collocations.Index.of(text, 9).dump())
    every = np.arange(9) > 0
    t = text.tolist()
    want = {k: Counter(g for g in zip(*[t[i:] for i in range(k)]) if 0 not in g) for k in (1, 2, 3)}
    ids = np.flatnonzero(every)
    assert dict(zip(ids.tolist(), index.words(ids)[2].tolist())) == {g[0]: n for g, n in want[1].items()}
    left, right, _, n = collocations.pairs(index, every)
    assert {(a, b): c for a, b, c in zip(left.tolist(), right.tolist(), n.tolist())} == want[2]
    keys = np.sort(left * 9 + right)
    a, b, c, n = collocations.triples(index, every, keys)
    assert {(x, y, z): k for x, y, z, k in zip(a.tolist(), b.tolist(), c.tolist(), n.tolist())} == want[3]
    # the other way: words to the right, then words to the left of those pairs
    lo, back, width = index.words(ids)
    i, word, forward, n, _ = index.extend(back, lo, width, left=False, allowed=every, deeper=True)
    assert {(ids[p], w): k for p, w, k in zip(i.tolist(), word.tolist(), n.tolist())} == want[2]
    j, before, _, n = index.extend(forward, forward, n, left=True, allowed=every)
    assert {(w, ids[i[p]], word[p]): k for p, w, k in zip(j.tolist(), before.tolist(), n.tolist())} == want[3]


def test_two_left_extensions():
    text = np.array([0, 1, 2, 3, 0, 1, 2, 3, 2, 3, 0])
    index, every = collocations.Index.of(text, 4), np.arange(4) > 0
    ids = np.array([3])
    i, word, back, n, place = index.extend(*index.words(ids), left=True, allowed=every, deeper=True)
    assert list(zip(word.tolist(), n.tolist())) == [(2, 3)]
    i, word, back, n = index.extend(place, back, n, left=True, allowed=every)
    assert list(zip(word.tolist(), n.tolist())) == [(1, 2), (3, 1)]


@pytest.mark.parametrize("size", [1, 7, 1000])
def test_shards_end_where_pieces_end(monkeypatch, size):
    """Whatever the sizes of shards and scan pieces, all n-grams are counted."""
    monkeypatch.setattr(common, "CHUNK", 40)
    texts = ["a b c " * 30, "x, y z. " * 20, "", "one", "a b. c d\n" * 9, "long " * 50 + "." + " b c" * 20, " . ", "p q"]
    langs = ["en", "de", "en", "de", "en", "en", "fr", "en"]
    batch = pa.RecordBatch.from_arrays([pa.array(langs), pa.array(texts)], names=["lang", "body"])
    got = Counter()
    for lang, shard in collocations.shards_of(iter([batch]), size):
        index, names, counts = shard.index()
        every = np.arange(index.symbols) > 0
        names = ["", *names]
        got.update({(lang, names[i + 1]): int(c) for i, c in enumerate(counts)})
        left, right, _, n = collocations.pairs(index, every)
        for a, b, c in zip(left, right, n):
            got[lang, names[a], names[b]] += int(c)
        for a, b, c, k in zip(*collocations.triples(index, every, np.sort(left * index.symbols + right))):
            got[lang, names[a], names[b], names[c]] += int(k)
    want = Counter()
    for lang, text in zip(langs, texts):
        for w in pieces(text):
            for k in (1, 2, 3):
                want.update((lang, *w[i:i + k]) for i in range(len(w) - k + 1))
    assert got == want


def test_odd_rows(spark, monkeypatch):
    common.prepare(spark)
    monkeypatch.setattr(collocations, "SHARD_WORDS", 50)
    more = ["Alpha beta gamma, delta " * 12, "alpha beta. " * 9 + "beta gamma! " * 12, "İx éA éa É\t" * 11]
    docs = odd_documents(spark, more * 2)
    want = brute([(r.lang, r.text) for r in docs.select("lang", "text").collect()])
    assert rows_of(collocations.collocations(docs)) == want and len(want) >= 10


def test_empty_table(spark):
    common.prepare(spark)
    assert collocations.collocations(empty_like(odd_documents(spark))).count() == 0


def test_query_over_the_table(spark):
    from inkbook.llm.queries import QUERIES
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("lang", "text").collect()
    assert rows_of(QUERIES["op11_collocations"](spark, sf)) == brute([(r.lang, r.text) for r in docs])
