"""Jaccard join, quality rules, personal data, scoring, neighbours, pipeline."""
import hashlib
import math
import random
import re
import string
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from inkbook.llm import ann, common, graph, jaccard, lm, pii, quality
from inkbook.llm.tagger import KINDS, Tagger
from tests.llm.frames import odd_documents

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def words(text):
    return [w.translate(LOWER) for w in WORD.findall(text or "")]


def shingles(text, n):
    w = words(text)
    return frozenset(tuple(w[k:k + n]) for k in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def linked(a, b, percent):
    both = len(a & b)
    return bool(both) and 100 * both >= percent * (len(a) + len(b) - both)


def find(up, x):
    while up[x] != x:
        x = up[x]
    return x


# --------------------------------------------------------------- near copies
@given(st.lists(st.lists(st.integers(0, 12), min_size=1, max_size=12), min_size=2, max_size=25),
       st.sampled_from([50, 70, 80, 85, 100]), st.booleans())
@settings(max_examples=150, deadline=None)
def test_trie_finds_every_link(sets, percent, two_sided):
    sets = [np.unique(np.array(s)) for s in sets]
    own = [frozenset(s.tolist()) for s in sets]
    if two_sided:
        half = len(sets) // 2
        got = set(jaccard.trie_links(sets[:half], sets[half:], percent)) if half else set()
        want = {(i, j) for i in range(half) for j in range(len(sets) - half) if linked(own[i], own[half + j], percent)}
    else:
        got = set(jaccard.trie_links(sets, None, percent))
        want = {(i, j) for i in range(len(sets)) for j in range(i) if linked(own[i], own[j], percent)}
    assert got == want


def families(seed=1, n=12, copies=9):
    rng = random.Random(seed)
    vocab = ["w" + str(i) for i in range(300)] + ["The", "of", "and"] * 30
    passage = " ".join(rng.choice(vocab) for _ in range(60))
    out = []
    for f in range(n):
        base = [rng.choice(vocab) for _ in range(rng.randint(3, 120))] + (passage.split() if f % 3 == 0 else [])
        for _ in range(copies):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 30))):
                w[rng.randrange(len(w))] = "e" + str(rng.randrange(10_000))
            out.append(rng.choice([" ", "\n", "\t "]).join(w))
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("n, percent, chunk", [(4, 85, 512), (5, 80, 3)])
def test_components_equal_brute_force(spark, monkeypatch, n, percent, chunk):
    monkeypatch.setattr(jaccard, "CHUNK", chunk)
    df = odd_documents(spark, families())
    rows = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
    got = jaccard.jaccard_components(df, words=n, percent=percent).collect()
    sets = {t: shingles(t, n) for _, t in rows}
    nodes = list({s for s in sets.values() if s})
    up = {s: s for s in nodes}
    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if linked(a, b, percent):
                up[find(up, a)] = find(up, b)
    least = {}
    for i, t in rows:
        if sets[t] and i is not None:
            root = find(up, sets[t])
            least[root] = min(i, least.get(root, i))
    want = Counter((i, len(sets[t]), least.get(find(up, sets[t])) if sets[t] else i) for i, t in rows)
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == want
    assert len(least) < len(nodes)


def test_chunks_and_parts_of_large_blocks(spark, monkeypatch):
    """Chunks take about one copy of each set and share the leading ones; pairs
    of chunks let any two sets of different parts meet, and none of one large
    part."""
    monkeypatch.setattr(jaccard, "CHUNK", 20)
    parts = [1] * 300 + [2] * 90 + list(range(3, 40))
    rows = spark.createDataFrame([(i, 7, p) for i, p in enumerate(parts)], "id long, token long, part long")
    blocks = {}
    for r in jaccard.chunked(rows).collect():
        blocks.setdefault(r["block"], []).append(r)
    leads = [{r["id"] for r in b if r["lead"]} for b in blocks.values()]
    assert len(blocks) == 22 and all(x == leads[0] for x in leads) and 4 <= len(leads[0]) <= 40
    assert {r["id"] for b in blocks.values() for r in b} == set(range(len(parts)))
    assert sum(map(len, blocks.values())) == len(parts) + 21 * len(leads[0])
    blocks, met, copies = {}, set(), Counter()
    for r in jaccard.paired(rows).collect():
        blocks.setdefault(r["block"], []).append(r)
        copies[r["id"]] += 1
    for b in blocks.values():
        for x in b:
            for y in b:
                if x["id"] < y["id"] and (x["side"] != y["side"] or not any(z["side"] for z in b)):
                    met.add((x["id"], y["id"]))
    assert met >= {(i, j) for j in range(len(parts)) for i in range(j) if parts[i] != parts[j]}
    assert not any(parts[i] == parts[j] < 3 for i, j in met)
    assert all(copies[i] <= 7 for i in range(300))       # 5 chunks of part 2, 2 shared ones


def test_first_test_keeps_sets_with_a_partner(spark):
    rng, texts = random.Random(5), []
    for n in [9, 9, 15, 16, 20, 29, 49, 54, 63] * 3:
        base = ["".join(rng.choice(string.ascii_lowercase) for _ in range(rng.randint(3, 7))) for _ in range(n)]
        texts += [" ".join(base), " ".join(["z" * rng.randint(15, 40)] * (1 + (n > 40)) + base)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [shingles(t, 4) for t in texts]
    pairs = [(i, i + 1) for i in range(0, len(texts), 2) if linked(sets[i], sets[i + 1], 85)]
    got = {r["doc_id"]: r["component_id"] for r in jaccard.jaccard_components(df).collect()}
    assert len(pairs) > 20
    assert [(i, j) for i, j in pairs if got[j] != i] == []


@given(st.integers(1, 400), st.integers(1, 400), st.sampled_from([50, 80, 85, 100]))
@settings(max_examples=300, deadline=None)
def test_shown_shingles_reach_what_a_partner_counts(a, b, percent):
    both = -(-percent * (a + b) // (100 + percent))
    if both <= min(a, b):
        assert jaccard.shown(b, percent) >= min(b, jaccard.counted(a, percent) + b - both)


def test_empty_tables(spark):
    df = odd_documents(spark).limit(0)
    assert jaccard.jaccard_components(df).count() == 0
    assert quality.judge(df).count() == 0
    assert pii.find(df).count() == 0
    assert lm.score_texts(df).count() == 0


def test_components_of_a_chain(spark):
    pairs = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (101, 102), (7, 7)]
    df = spark.createDataFrame(pairs, "a long, b long")
    got = {r["node"]: r["root"] for r in graph.components(df, "a", "b").collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, 100: 100, 101: 100, 102: 100}


# ------------------------------------------------------------ quality rules
def base_statistics(t):
    w, seen, dup = WORD.findall(t or ""), set(), 0
    for line in (t or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = Counter(zip(w, w[1:], w[2:]))
    covered = {j for i, x in enumerate(zip(w, w[1:], w[2:])) if windows[x] > 1 for j in (i, i + 1, i + 2)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), dup, len(covered)


def prose(rng, n):
    vocab = ["the", "of", "and"] * 5 + ["".join(rng.choice("aeinrst") for _ in range(rng.randint(2, 9))) for _ in range(200)]
    return " ".join(rng.choice(vocab) + (".\n" if rng.random() < 0.08 else "") for _ in range(n))


def test_quality_rules(spark):
    rng = random.Random(3)
    clean = [prose(rng, rng.randint(60, 600)) for _ in range(120)]
    junk = [re.sub(r" ", lambda m: rng.choice(["*** ", "$$$ ", "%%% "]), prose(rng, 200)) for _ in range(8)]
    df = odd_documents(spark, clean + junk + ["a b c d e f\n" * 40])
    got = quality.judge(df).collect()
    texts = defaultdict(list)
    for r in df.collect():
        texts[r["doc_id"]].append(r["text"])
    want = Counter((i, *base_statistics(t)) for i, ts in texts.items() for t in ts)
    assert Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"])
                   for r in got) == want
    for r in got:
        failed = r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]
        assert r["base_failed"] == failed and not (failed and r["kept"])
        text = texts[r["doc_id"]][0]
        if text in clean:
            assert r["kept"]
        if text in junk:
            assert not r["kept"]
    kept = quality.keep(df)
    assert kept.columns == df.columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(r["doc_id"] for r in got if r["kept"])


def test_estimate_leaves_small_groups_out(spark):
    """Without a join of the groups' sizes, and on numbers as keys."""
    rows = [(g, *[float(i % 7 + j) for j in range(5)]) for g, n in ((1, quality.MIN_GROUP), (2, quality.MIN_GROUP - 1))
            for i in range(n)]
    stored = common.store(spark.createDataFrame(rows, ["g__", *quality.FEATURES]), "t")
    assert [r["g__"] for r in quality.estimate(stored).collect()] == [1]
    pairs = spark.createDataFrame([("en", "web")] * quality.MIN_GROUP + [("en", "x"), ("de", "y")], ["lang__", "source__"])
    groups = quality.grouped(pairs)
    assert dict(groups.dtypes)["g__"] == "bigint"
    assert len({r["g__"] for r in groups.collect()}) == 2


def test_keep_one_sends_no_table_through_the_driver(spark, monkeypatch):
    """Bitmaps and counts of fixed size are read by the tasks, where code that
    held them was a broadcast of its own."""
    sent = []
    plain = type(spark.sparkContext).broadcast
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda self, x: sent.append(len(x)) or plain(self, x))
    text = " ".join(f"word{i}" for i in range(60))
    docs = spark.createDataFrame([(1, text), (2, text + " end"), (3, "another text of its own"), (4, text)], ["doc_id", "text"])
    assert sorted(r["doc_id"] for r in jaccard.keep_one(docs).collect()) == [1, 3]
    assert sent == []


def test_covariance_estimate_equals_numpy(spark):
    """The concentration steps, spelt out in numpy."""
    rng = np.random.default_rng(2)
    x = rng.normal(0, 1, (400, 5)) @ rng.normal(0, 1, (5, 5)) + 3
    x[:40] += 30
    x = x.round(4)
    rows = common.store(spark.createDataFrame([("g", *map(float, r)) for r in x], ["g__", *quality.FEATURES]), "t")
    got = quality.estimate(rows).first()["p__"]
    floors = np.array(quality.FLOORS)
    q = np.percentile(x.round(2), [25, 50, 75], axis=0)
    mean, w = q[1], np.diag(1 / np.maximum((q[2] - q[0]) / 1.349, floors))

    def distances():
        return (((x - mean) @ w.T) ** 2).sum(1)

    def classes(d):
        return np.minimum(np.floor(np.log(1 + d) * quality.FINE), quality.CLASSES)

    def refit(part):
        cov = part.T @ part / len(part) - np.outer(part.mean(0), part.mean(0)) + np.diag(floors ** 2)
        return part.mean(0), np.linalg.inv(np.linalg.cholesky(cov))
    for _ in range(quality.STEPS):
        k = classes(distances())
        mean, w = refit(x[k <= math.ceil(np.percentile(k, 100 * quality.SUBSET))])
    d = distances()
    factor = max((math.exp((np.percentile(classes(d), 50) + 0.5) / quality.FINE) - 1) / quality.CHI2_MEDIAN, 1.0)
    mean, w = refit(x[d <= quality.CHI2_975 * factor])
    assert np.allclose(got["m"], mean) and np.allclose(got["w"], w[np.tril_indices(5)], rtol=1e-6, atol=1e-9)
    assert (distances()[:40] > quality.CUTOFF).all()


# ------------------------------------------------------------- personal data
def base_rules(t):
    out = [(0, m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(1, m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t)
            if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        if 16 <= len(d) <= 19 and sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(d[::-1])) % 10 == 0:
            out.append((2, m.start(), m.end()))
    return out + [(3, m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t)
                  if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


@given(st.lists(st.sampled_from(["1", "23", "255", ".", "@", "a", "b.c", "+", "+4", " ", "-", "(", "4111111111111111",
                                 "1.2.3.4", "é", "\n"]), max_size=25).map("".join))
@settings(max_examples=800, deadline=None)
def test_base_rules_equal_the_patterns(text):
    assert pii.base_spans(text) == base_rules(text)


def test_long_runs_take_linear_time():
    assert pii.base_spans("a" * 400_000 + "1" * 400_000 + "+" * 1000 + "1." * 3) == []


def test_gradients():
    rng = np.random.default_rng(0)
    m, ids, tags = Tagger(hidden=3, seed=1), rng.integers(0, 40, (2, 9)), np.zeros((2, 9), int)
    tags[0, 2:5], tags[1, 4] = [1, 2, 2], 5
    _, grad = m._loss(ids, tags)
    for k, g in grad.items():
        at = tuple(int(i) for i in np.unravel_index(int(np.abs(g).argmax()), g.shape))
        old = m.p[k][at]
        m.p[k][at] = old + 1e-5
        up, _ = m._loss(ids, tags)
        m.p[k][at] = old - 1e-5
        down, _ = m._loss(ids, tags)
        m.p[k][at] = old
        assert abs((up - down) / 2e-5 - g[at]) < 1e-5 * max(1, abs(g[at]))


@pytest.fixture(scope="module")
def tagger():
    rng = random.Random(5)
    return pii.train([prose(rng, 60) for _ in range(60)])


def test_held_out_accuracy(tagger):
    rng = random.Random(6)
    ids, tags = pii.training_windows([prose(rng, 60) for _ in range(40)], 250, seed=77)
    hit = said = there = 0
    for row, spans in zip(tags, tagger.decode(ids)):
        truth = set()
        for a in np.flatnonzero(row % 2 == 1).tolist():
            b = a + 1
            while b < len(row) and row[b] == row[a] + 1:
                b += 1
            truth.add(((int(row[a]) - 1) // 2, a, b))
        got = {s[:3] for s in spans}
        hit, said, there = hit + len(got & truth), said + len(got), there + len(truth)
    assert hit >= 0.85 * said and hit >= 0.8 * there


def test_added_spans_and_clean_texts(tagger):
    rng = random.Random(8)
    inside = [("email", "john.doe [at] mail.example.com"), ("phone", "(859) 555-5433"), ("ip", "10[.]0[.]0[.]12")]
    for kind, s in inside:
        text = prose(rng, 200) + " " + s + " " + prose(rng, 200)
        spans, = pii.added_spans(tagger, [text], [pii.base_spans(text)])
        assert [(KINDS[k], text[a:b]) for k, a, b in spans] == [(kind, s)]
    clean = [prose(rng, 300) + f" version {i}.0 of 20{i:02d}, $1,234.50 and 12:30 " + prose(rng, 50) for i in range(30)]
    assert pii.added_spans(tagger, clean, [[] for _ in clean]) == [[] for _ in clean]


class Runs:
    """Takes every run without a space for an email."""

    def decode(self, ids):
        space = pii.symbols(" ")[0]
        out = []
        for row in ids:
            inside = np.diff(np.concatenate([[0], ((row != space) & (row != 0)).astype(int), [0]]))
            out.append([(0, int(a), int(b), 0.99) for a, b in zip(np.flatnonzero(inside == 1), np.flatnonzero(inside == -1))])
        return out


@pytest.mark.parametrize("n", [20, 56, 97, 700])
def test_spans_longer_than_the_overlap(n):
    item = "u" * (n // 2 - 4) + "[at]" + "h" * (n - n // 2 - 4) + ".com"
    for offset in range(100, 148):
        text = "x" * 9 + " a" * 200 + " "
        text = text[:offset - 1] + " " + item + " and b" + " c" * 100
        spans, = pii.added_spans(Runs(), [text], [[]])
        assert [(KINDS[k], text[a:b]) for k, a, b in spans] == [("email", item)]


def test_long_addresses_at_every_offset(tagger):
    item = "benjamin_foster [at] database [dot] hostings [dot] com"
    hit = 0
    for offset in range(48):
        text = prose(random.Random(8), 60).ljust(400)[:200 + offset] + " " + item + " " + prose(random.Random(9), 60)
        spans, = pii.added_spans(tagger, [text], [pii.base_spans(text)])
        hit += any(text[a:b] == item for _, a, b in spans)
    assert hit >= 44


@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 30), st.integers(1, 8), st.floats(0.1, 1)), max_size=9))
@settings(max_examples=100, deadline=None)
def test_reconciled_spans_are_the_best(spans):
    spans = [(k, a, a + n, p) for k, a, n, p in spans]
    got = pii.reconcile(spans)
    best = {}
    for k, a, b, p in spans:
        best[k, a, b] = max(p, best.get((k, a, b), 0))

    def worth(chosen):
        return sum(best[s] * (s[2] - s[1]) for s in chosen)

    def brute(rest, end):
        return max([0.0] + [best[s] * (s[2] - s[1]) + brute(rest, s[2]) for s in rest if s[1] >= end])
    assert all(x[2] <= y[1] for x, y in zip(got, got[1:]))
    assert abs(worth(got) - brute(list(best), 0)) < 1e-9


def test_find_and_redact(spark):
    df = odd_documents(spark)
    texts = Counter((r["doc_id"], r["text"] or "") for r in df.collect())
    got = pii.find(df).collect()
    want = Counter()
    for (i, t), n in texts.items():
        spans = base_rules(t)
        named = ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)
        want[(i, *(sum(s[0] == k for s in spans) for k in range(4)), hashlib.sha256(named.encode()).hexdigest())] += n
    assert Counter((r["doc_id"], r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"]) for r in got) == want
    for r in got:
        own = set(filter(None, r["spans"].split(",")))
        assert len(own) == r["n_email"] + r["n_ip"] + r["n_card"] + r["n_phone"] + r["n_added"]
    out = pii.redact(df)
    assert out.columns == df.columns
    for r in out.collect():
        assert not base_rules(r["text"] or "")
    # one text per id but for the row that repeats an id
    masked = [r["text"] for r in out.collect() if r["text"] and "[EMAIL]" in r["text"]]
    assert masked == ["mail [EMAIL] or [PHONE] or [CARD] or [IP] now"] * 2


# ------------------------------------------------------------------- scoring
def test_scores(spark):
    rng = random.Random(9)
    df = odd_documents(spark, [prose(rng, 150) for _ in range(60)])
    rows = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
    counts = Counter()
    for i, t in rows:
        if not held(i):
            counts.update([*words(t), None])
    n, v = sum(counts.values()), len(counts)
    want = defaultdict(list)
    for i, t in rows:
        w = [*words(t), None]
        base = sum(math.log10((counts[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)
        want[i].append((held(i), len(w), sum(counts[x] > 0 for x in w), n, round(base, 6)))
    got = defaultdict(list)
    for r in lm.score_texts(df).collect():
        got[r["doc_id"]].append((r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)))
        assert math.isfinite(r["score"]) and r["score"] < 0
    assert {k: sorted(x) for k, x in got.items()} == {k: sorted(x) for k, x in want.items()}


def test_words_beyond_the_hot_table(spark, monkeypatch):
    df = odd_documents(spark)
    whole = sorted(map(str, lm.score_texts(df).select("doc_id", "n_known", F.round("base_score", 6)).collect()))
    monkeypatch.setattr(lm, "HOT", 4)
    assert sorted(map(str, lm.score_texts(df).select("doc_id", "n_known", F.round("base_score", 6)).collect())) == whole


def test_contexts_beyond_the_dense_tables(spark, monkeypatch):
    rng = random.Random(14)
    # a word leaves three to follow, the one before it tells which is likely, and
    # the one before that whether it is certain
    def chain():
        z, a, b = (rng.randrange(30) for _ in range(3))
        for _ in range(200):
            yield f"w{b}"
            z, a, b = a, b, (b * 3 + (a + (z % 2 and rng.random() < 0.5)) % 3) % 30
    df = spark.createDataFrame([(i, " ".join(chain())) for i in range(300)], "doc_id long, text string")

    def scores():
        return {r["doc_id"]: (r["n_tokens"], r["score"]) for r in lm.score_texts(df).collect()}
    whole = scores()
    for states in (20, 1):      # the same states, whatever the dense tables hold
        monkeypatch.setattr(lm, "STATES", states)
        monkeypatch.setattr(lm, "PAIRS", 500, raising=False)
        got = scores()
        assert got.keys() == whole.keys() and all(abs(got[i][1] - whole[i][1]) < 0.01 for i in whole)
    # pairs alone would leave log10 of 0.57 a word
    assert sum(s for _, s in whole.values()) / sum(n for n, _ in whole.values()) > -0.2


def test_contexts_of_both_levels_are_moved_once(spark, monkeypatch):
    rng = random.Random(15)

    def chain():
        a, b = rng.randrange(12), rng.randrange(12)
        for _ in range(200):
            yield f"w{b}"
            a, b = b, (b * 3 + a % 3 + (rng.random() < 0.2)) % 12
    df = spark.createDataFrame([(i, " ".join(chain())) for i in range(80)], "doc_id long, text string")
    monkeypatch.setattr(lm, "STATES", 3)
    folded = lm.folded(df, "doc_id", "text")
    w = lm.Words(lm.word_counts(folded), folded.where(~F.col("held_out")).count())
    rows = lm.symbolise(folded, spark.sparkContext.broadcast(w))
    tree = lm.grow(rows, w.symbol_c)
    states = lm._decided(lm._cell_counts(rows, spark.sparkContext.broadcast(tree)))
    plan = states._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
    # the counts behind them are those of the texts
    want = {}
    for r in rows.collect():
        seq = [0, 0, 0, *np.frombuffer(r["symbols"], "<u2").tolist(), 0]
        for i in range(3, len(seq)):
            if tree.often[seq[i - 1], seq[i - 2]] and not tree.tried[0][seq[i - 1], seq[i - 2]]:
                cell = (seq[i - 1] * lm.ALPHABET + seq[i - 2], seq[i - 3], seq[i])
                want[cell] = want.get(cell, 0) + (not r["held_out"])
    got = lm._cell_counts(rows, spark.sparkContext.broadcast(tree)).where("part < 0").collect()
    assert want and {(r["pair"], r["oldest"], r["x"]): r["n"] for r in got} == want


def test_shuffle_files_go_with_a_stored_table(spark):
    kept = spark.conf.get(common.LET_GO, "false")
    seen = []

    class Told:
        def __getattr__(self, name):
            return getattr(spark.range(3).write, name)

        def parquet(self, path):
            seen.append(spark.conf.get(common.LET_GO))
            spark.range(3).write.parquet(path)

    class Frame:
        sparkSession, schema, write = spark, spark.range(3).schema, Told()
    assert common.store(Frame, "told").count() == 3
    assert seen == ["true"] and spark.conf.get(common.LET_GO, "false") == kept


def test_distributions_are_proper(spark):
    rng = random.Random(10)
    # "a b" is followed by "c", "x b" by "d": a state of two words
    texts = [" ".join(rng.choice(["a b c", "x b d", "e f"]) for _ in range(60)) for _ in range(40)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    folded = lm.folded(df, "doc_id", "text")
    counts = lm.word_counts(folded)
    w = lm.Words(counts, folded.where(~F.col("held_out")).count())
    tree = lm.grow(lm.symbolise(folded, spark.sparkContext.broadcast(w)), w.symbol_c)
    for level in tree.log:
        if len(level):
            assert np.allclose((10.0 ** level.astype(float)).sum(1), 1, atol=1e-3)
    symbol = {x: int(w.symbol[np.searchsorted(w.word, h)]) for x, h in zip(
        "abcdx", common.word_hashes(__import__("pyarrow").array(["a b c d x"]))[1])}
    assert tree.levels >= 2
    state = tree.state[0][symbol["b"], symbol["a"]]
    assert state >= 0 and tree.log[1][state, symbol["c"]] > math.log10(0.9)
    # a class: its known words and the unseen one share it fully
    w.class_n[3], w.class_v[3] = 10, 4
    shares = [10 ** float(w.inner(np.array(c), np.array(3))) for c in (4, 3, 2, 1)]
    assert abs(sum(shares) + 10 ** float(w.inner(np.array(0), np.array(3))) - 1) < 1e-9


# ---------------------------------------------------------------- neighbours
def vectors(rng, n, dim=16):
    centres = rng.normal(0, 1, (12, dim))
    return (centres[rng.integers(0, 12, n)] + rng.normal(0, 0.6, (n, dim))).astype(np.float32)


@pytest.mark.parametrize("n, hot", [(3000, 0), (900, 300), (15, 0)])
def test_recall(spark, monkeypatch, n, hot):
    monkeypatch.setattr(ann, "SHARD", 500)
    rng = np.random.default_rng(4)
    x = vectors(rng, n)
    x[:hot] = x[0]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    odd = [(n, None), (n + 1, [0.0] * 16), (n + 2, [float("nan")] * 16), (n + 3, [1.0] * 15), (n + 4, [None] * 16),
           (None, [9.0] * 16), (n + 5, [float("inf")] * 16), (0, x[0].tolist())]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>")
    for c in ("vec", "list", "shard", "rank", "score"):
        df = df.withColumn(c, F.lit("clash"))
    got = defaultdict(list)
    for r in ann.search(df).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    y, hit, there = x.astype(float), 0, 0
    assert set(got) == set(range(0, n, 20)) if n > 1 else True
    for q, rows_ in got.items():
        s = y @ y[q]
        s[q] = -np.inf
        best = np.lexsort((np.arange(n), -s))[:min(20, n - 1)]
        rows_.sort()
        assert [r[0] for r in rows_] == list(range(1, len(rows_) + 1)) and len(rows_) == len(best)
        assert [(-r[2], r[1]) for r in rows_] == sorted((-r[2], r[1]) for r in rows_)
        assert all(abs(r[2] - s[r[1]]) < 1e-9 for r in rows_)
        # equal scores count as found
        hit += sum(s[r[1]] >= s[best[-1]] - 1e-9 for r in rows_)
        there += len(best)
    assert hit >= 0.9 * there
    assert ann.search(df.limit(0)).count() == 0


def recall(spark, x, **how):
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    hit = there = 0
    found = defaultdict(list)
    for r in ann.search(df, **how).collect():
        found[r["query_id"]].append(r["vec_id"])
    for q in range(0, len(x), 20):
        s = x @ x[q]
        s[q] = -np.inf
        hit += len(set(found[q]) & set(np.argsort(-s)[:20].tolist()))
        there += 20
    return hit / there


def test_many_lists_whose_distances_hardly_differ(spark, monkeypatch):
    monkeypatch.setattr(ann, "LIST", 4)
    x = np.random.default_rng(8).normal(size=(3000, 24))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    assert recall(spark, x) >= 0.9


def test_every_list_within_the_ratio_is_visited():
    rng = np.random.default_rng(9)
    g = ann.Graph(rng.normal(size=(900, 24)))
    q, homes = rng.normal(size=(40, 24)), np.full(900, 200)
    for ratio in (1.0, 1.2, 1.5, 100.0):
        for x, lists in zip(q, ann.to_visit(g, q, homes, ratio, 0)):
            d = np.sqrt(((g.c - x) ** 2).sum(1))
            # the graph may miss a few of the lists it searches, none of those beyond its width
            want = set(np.flatnonzero(d <= d.min() * ratio).tolist())
            assert set(lists.tolist()) == want if len(want) > ann.PROBES else set(lists.tolist()) <= want


# ------------------------------------------------------------------ pipeline
def test_pipeline(spark, tmp_path):
    import corpus_pipeline
    rng = random.Random(12)
    base = [prose(rng, rng.randint(80, 300)) for _ in range(60)]
    near = [b.replace("the", "THE", 3) + " tail" for b in base[:15]]
    texts = base + near + base[:5] + ["too short", None, ""] + [b + " call +1 (859) 555-5433 x" for b in base[20:25]]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        docs = common.store(stage(spark, docs, str(tmp_path)), "test-pipeline")
        after = {r["doc_id"]: r["text"] for r in docs.collect()}
        assert docs.columns == columns
        if name == "quality_rules":
            assert set(after) == {i for i, t in before.items() if len(words(t)) >= 50}
        elif name == "near_duplicates":
            sets = {i: shingles(t, 5) for i, t in before.items()}
            up = {i: i for i in sets}
            for i in sets:
                for j in sets:
                    if j < i and linked(sets[i], sets[j], 80):
                        a, b = find(up, i), find(up, j)
                        up[max(a, b)] = min(a, b)
            assert set(after) == {i for i in up if find(up, i) == i} and len(after) == 60
        elif name == "personal_data":
            assert set(after) == set(before) and not any(base_rules(t) for t in after.values())
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    assert {r["doc_id"] for r in packed} == set(after)
    assert Counter(map(str, packed)) == Counter(map(str, corpus_pipeline.run(spark, str(tmp_path)).collect()))


def test_repeated_ids_in_keep_one(spark):
    """One row of each component, whatever ids its rows have or share."""
    df = odd_documents(spark)
    kept = jaccard.keep_one(df)
    assert kept.columns == df.columns
    texts = [r["text"] for r in kept.collect()]
    worded = [t for t in texts if t and words(t)]
    assert sorted(worded) == sorted({r["text"] for r in df.collect() if r["text"] and words(r["text"])})
    assert len(texts) - len(worded) == sum(1 for r in df.collect() if not (r["text"] and words(r["text"])))
    a, b, c = ("alpha beta gamma delta epsilon zeta", "one two three four five six", "null id text of some words here")
    rows = [(1, a), (5, a), (5, b), (None, c), (None, c), (7, c + " "), (9, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, jaccard.keep_one(df).collect())) == [(1, a), (5, b), (7, c + " "), (9, "")]


def test_queries_run(spark):
    """Every query on the smallest tables, against its contract's columns."""
    from inkbook.llm.queries import QUERIES
    columns = {
        "op1": "doc_id start n_tokens ids_crc32", "op2": "page_id url text n_chars", "op3": "doc_id n_shingles component_id",
        "op4": "doc_id n_email n_ip n_card n_phone base_sha256 spans",
        "op5": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
        "op6": "doc_id piece start length ids_crc32 sequence_id offset",
        "op7": "doc_id held_out n_tokens n_known train_tokens base_score score",
        "op8": "doc_id n_tokens ids_sha256 decoded_sha256", "op9": "query_id rank vec_id score",
        "op10": "page_id payload_bytes payload_digest record_type refers_to",
        "op11": "lang rank phrase a l r n score", "op12": "doc_id n_words n_removed kept_sha256",
        "op13": "doc_id n_features weight score rank"}
    assert sorted(n.split("_")[0] for n in QUERIES) == sorted(columns)
    for name, fn in QUERIES.items():
        assert fn(spark, "/root/testdata/sf0.001").columns[:len(columns[name.split("_")[0]].split())] == \
            columns[name.split("_")[0]].split()


@given(st.lists(st.sets(st.integers(0, 400), min_size=1, max_size=200), min_size=2, max_size=8), st.sampled_from([60, 85]))
@settings(max_examples=60, deadline=None)
def test_sketches_never_lose_a_link(sets, percent):
    arrays = [np.array(sorted(s), np.uint64) for s in sets]
    m = len(sets)
    good = jaccard.may_link(np.array([len(s) for s in sets]), [np.frombuffer(jaccard.sketch(a), np.uint8) for a in arrays],
                            np.zeros(m, int), np.arange(m), percent)
    for i in range(m):
        for j in range(i):
            if linked(frozenset(sets[i]), frozenset(sets[j]), percent):
                assert good[i] and good[j]
