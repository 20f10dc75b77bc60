"""Token store, byte BPE and packing against the tokenizers library."""
import hashlib
import io
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from inkbook.llm import bpe, encode, packing, token_store
from tests.llm.frames import ODD_TEXTS, empty_like, odd_documents


@pytest.fixture(scope="module")
def word_bpe():
    return Tokenizer.from_file(encode.vocabulary(encode.DEFAULT_WORD_BPE))


@pytest.fixture(scope="module")
def byte_bpe():
    return Tokenizer.from_file(encode.vocabulary(bpe.DEFAULT_BYTE_BPE))


def raw(ids):
    return np.array(ids, "<u4").tobytes()


def library(tok, text):
    return tok.encode(text or "", add_special_tokens=False).ids


class Memory:
    def __init__(self, data):
        self.data = data

    def size(self):
        return len(self.data)

    def read_at(self, n, at):
        return self.data[at:at + n]


@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=1500))
@settings(max_examples=60, deadline=None)
def test_codes_are_directly_addressable(ids):
    ids = np.array(ids, np.uint32)
    s = token_store.Segment(token_store.encode_segment(ids))
    assert (s.all() == ids).all()
    assert [s.token(i) for i in range(len(ids))] == ids.tolist()


def test_file_over_many_segments(monkeypatch):
    monkeypatch.setattr(token_store, "SEGMENT", 64)
    rng, out = np.random.default_rng(1), io.BytesIO()
    docs = [(i if i else None, rng.integers(0, 70_000, int(rng.integers(0, 400))).astype(np.uint32)) for i in range(30)]
    w = token_store.Writer(out)
    for d in docs:
        w.add(*d)
    w.close()
    r = token_store.Reader(Memory(out.getvalue()))
    whole = np.concatenate([x for _, x in docs])
    assert r.tokens == len(whole) and [r.token(i) for i in range(len(whole))] == whole.tolist()
    assert [(d, n, c) for d, _, n, c in r.documents()] == [(d, len(x), zlib.crc32(raw(x))) for d, x in docs]


def test_token_store_equals_library(spark, word_bpe):
    df = odd_documents(spark)
    got = sorted(map(tuple, token_store.token_store(df).collect()), key=lambda r: r[1])
    rows = sorted(((r["doc_id"] if r["doc_id"] is not None else -1, r["text"] or "") for r in df.collect()))
    at, want = 0, []
    for i, t in rows:
        ids = library(word_bpe, t) + [1]
        want.append((None if i < 0 else i, at, len(ids), zlib.crc32(raw(ids))))
        at += len(ids)
    assert got == want
    assert token_store.token_store(empty_like(df)).count() == 0


PIECES = st.text(alphabet="aeinrst hou.,'\n=-0中é🙂 \t", max_size=60)


@given(PIECES)
@settings(max_examples=200, deadline=None)
def test_backtracking_gives_the_merges(text):
    tok = Tokenizer.from_file(encode.vocabulary(bpe.DEFAULT_BYTE_BPE)) if not hasattr(test_backtracking_gives_the_merges, "t") \
        else test_backtracking_gives_the_merges.t
    test_backtracking_gives_the_merges.t = tok
    codec = bpe.byte_bpe(encode.vocabulary(bpe.DEFAULT_BYTE_BPE))
    got = codec.encode(text)
    assert got == raw(library(tok, text))
    assert codec.decode(np.frombuffer(got, "<u4")).decode() == text


@given(st.text(max_size=40))
@settings(max_examples=200, deadline=None)
def test_word_encoder_equals_library(text):
    enc = encode.word_encoder(encode.vocabulary(encode.DEFAULT_WORD_BPE))
    assert enc.encode(text) == raw(library(enc.whole, text))


def test_caches_rotate(word_bpe):
    enc = encode.WordEncoder(encode.vocabulary(encode.DEFAULT_WORD_BPE))
    enc.words, enc.pieces = encode.Cache(5), encode.Cache(3)
    for t in [t for t in ODD_TEXTS if t and len(t) < 1000] * 3:
        assert enc.encode(t) == raw(library(word_bpe, t))


def test_round_trip_query(spark, byte_bpe):
    df = odd_documents(spark)
    got = Counter(map(tuple, bpe.round_trip(df).collect()))
    want = Counter()
    for r in df.collect():
        ids = library(byte_bpe, r["text"])
        text = byte_bpe.decode(ids, skip_special_tokens=False)
        want[r["doc_id"], len(ids), hashlib.sha256(raw(ids)).hexdigest(), hashlib.sha256(text.encode()).hexdigest()] += 1
    assert got == want
    encoded = bpe.encode_texts(df)
    assert Counter(map(tuple, bpe.decode_ids(encoded).collect())) == Counter(
        (r["doc_id"], r["text"] or "") for r in df.collect())
    assert bpe.round_trip(empty_like(df)).count() == 0


# ------------------------------------------------------------------ packing
def bins_of(runs, capacity):
    held, n = Counter(), 0
    for times, content in runs:
        assert times > 0 and sum(l * k for l, k in content) <= capacity
        n += times
        for l, k in content:
            held[l] += times * k
    return held, n


@given(st.integers(4, 80), st.data())
@settings(max_examples=80, deadline=None)
def test_plan_holds_every_item(capacity, data):
    counts = data.draw(st.dictionaries(st.integers(1, capacity), st.integers(0, 60), max_size=25))
    held, n = bins_of(packing.plan(counts, capacity), capacity)
    assert held == Counter({l: c for l, c in counts.items() if c})
    total = sum(l * c for l, c in counts.items())
    assert n >= -(-total // capacity)
    # first-fit decreasing, spelt out
    bins = []
    for l in sorted((l for l, c in counts.items() for _ in range(c)), reverse=True):
        for i, room in enumerate(bins):
            if room >= l:
                bins[i] -= l
                break
        else:
            bins.append(capacity - l)
    assert n <= len(bins) * 1.1 + 2


def test_plan_is_close_to_the_least():
    rng = np.random.default_rng(0)
    lengths = np.clip(np.exp(rng.normal(6.2, 1.2, 30_000)), 1, 4096).astype(int)
    counts = Counter(lengths.tolist())
    _, n = bins_of(packing.plan(counts), 4096)
    assert n <= 1.002 * lengths.sum() / 4096 + 2


def test_pack_documents(spark, word_bpe, monkeypatch):
    monkeypatch.setattr(packing, "RANKED", 3)
    df = odd_documents(spark, ["some words here"] * 20 + ["w " * 9000])
    rows = packing.pack_documents(df, ).collect()
    want = Counter()
    for r in df.collect():
        ids = library(word_bpe, r["text"]) + [1]
        for k in range(0, len(ids), 4096):
            want[r["doc_id"], k // 4096, k, len(ids[k:k + 4096]), zlib.crc32(raw(ids[k:k + 4096]))] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    sequences = defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(sequences) <= sum(r["length"] for r in rows) / 4096 + 2
    assert packing.pack_documents(empty_like(df)).count() == 0


def test_pack_with_one_id_on_all_rows(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(packing, "RANKED", 20)
    rows = [(None, 0, 0, 5 + i % 4, i) for i in range(400)] + [(7, 0, 0, 6, 1)] * 30
    spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long") \
        .write.parquet(str(tmp_path / "cut"))
    got = packing.pack(spark.read.parquet(str(tmp_path / "cut")), capacity=32).collect()
    assert Counter(tuple(r)[:5] for r in got) == Counter(rows)
    held = {}
    for r in got:
        held.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in held.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 32
    assert len(held) <= -(-sum(r[3] for r in rows) // 32) * 1.1
