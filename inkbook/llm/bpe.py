"""Operator 8: byte-level BPE by backtracking, and decoding by offset table.

Encoding a piece takes the longest token at each place (an Aho-Corasick
automaton over the vocabulary) and keeps it only if it can stand after the
token before it, that is if merging the two tokens' bytes by rank would give
just these two. If not, the next shorter token that is a prefix is tried; if
none is left, the last token is taken back and its place is barred. Every
place is barred at most once, so the work is linear, and the outcome is the
one that merging by rank gives.

Whether two tokens can stand side by side follows from the merge table alone:
undo the later of the two merges step by step along the seam and see whether
some pair there would have been merged earlier.

Decoding looks up each id's place in one blob of all tokens' bytes.

Defined cases: a null text counts as empty and has no tokens; repeated rows
are kept; an empty table gives an empty result; texts of any length are
handled whole. Only the id and text columns are read."""
from __future__ import annotations

import hashlib
import json
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkbook.llm import common
from inkbook.llm.encode import Cache, byte_letters, vocabulary

DEFAULT_BYTE_BPE = "byte_bpe_50k.json"
#: Fixed value: the split pattern of the byte-level tokenizer.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class Backtracker:
    """The encoder's tables: automaton, prefixes, merges and their inverse."""

    def __init__(self, path: str):
        import ahocorasick
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        value = {c: b for b, c in enumerate(byte_letters())}
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*vocab.values(), *special.values()]) + 1
        self.bytes: list[bytes] = [b""] * size
        for token, i in vocab.items():
            if token not in special:
                self.bytes[i] = bytes(value[c] for c in token)
        self.special = special
        # a token's merge rank orders the merges; single bytes have none
        self.rank = [-1] * size
        self.parts: list[tuple[int, int]] = [(i, i) for i in range(size)]
        self.merged: dict[tuple[int, int], int] = {}
        for r, (a, b) in enumerate(merges):
            left, right, whole = vocab[a], vocab[b], vocab[a + b]
            self.merged[left, right] = whole
            if self.rank[whole] < 0:
                self.rank[whole], self.parts[whole] = r, (left, right)
        self.compatible = Cache(400_000)
        self.automaton = ahocorasick.Automaton()
        ids = {self.bytes[i]: i for i in range(size) if self.bytes[i]}
        for b, i in ids.items():
            if self.rank[i] < 0 or self._stands(*self.parts[i], whole=i):
                self.automaton.add_word(b.decode("latin-1"), (i, len(b)))
        self.automaton.make_automaton()
        self.shorter = [-1] * size
        known = {w for w in self.automaton.keys()}
        for b, i in ids.items():
            s = b.decode("latin-1")
            for n in range(len(s) - 1, 0, -1):
                if s[:n] in known:
                    self.shorter[i] = ids[b[:n]]
                    break
        for text, i in special.items():
            self.bytes[i] = text.encode()

    def _stands(self, left: int, right: int, whole: int | None = None) -> bool:
        """Would merging by rank keep a seam between ``left`` and ``right``
        (until ``whole``, made of the two, is merged)?"""
        merged, rank, parts = self.merged, self.rank, self.parts
        # the seam's pair at each time of the merging, latest first
        limit = 1 << 60
        if whole is not None:
            limit = rank[whole]
        a, b = left, right
        while True:
            joined = merged.get((a, b))
            if joined is not None and rank[joined] < limit and joined != whole:
                return False
            # undo whichever of the two was merged last
            if rank[a] < 0 and rank[b] < 0:
                return True
            if rank[a] > rank[b] or (rank[a] == rank[b]):
                # on equal ranks the left one was merged first
                if rank[a] == rank[b]:
                    limit, b = rank[b] + 0.5, parts[b][0]
                else:
                    limit, a = rank[a], parts[a][1]
            else:
                limit, b = rank[b] + 0.5, parts[b][0]

    def fits(self, left: int, right: int) -> bool:
        key = left << 32 | right
        got = self.compatible.young.get(key)
        if got is None:
            got = self.compatible.old.get(key)
            got = self.compatible.put(key, self._stands(left, right) if got is None else got)
        return got

    def encode(self, piece: bytes) -> list[int]:
        """Ids of one piece of text."""
        text, n = piece.decode("latin-1"), len(piece)
        longest, shorter, size = self.automaton.iter_long, self.shorter, self.bytes
        barred = bytearray(n + 1)
        out: list[int] = []
        at, token = 0, next(longest(text))[1][0]
        while True:
            end = at + len(size[token])
            if not barred[end] and (not out or self.fits(out[-1], token)):
                out.append(token)
                at = end
                if at == n:
                    return out
                token = next(longest(text, at))[1][0]
            elif shorter[token] >= 0:
                token = shorter[token]
            else:
                barred[at] = 1
                token = out.pop()
                at -= len(size[token])


class ByteBPE:
    """Texts to ids and back."""

    def __init__(self, path: str):
        self.tables = Backtracker(path)
        self.split = regex.compile(PATTERN).findall
        # texts whose white space is single spaces and line ends between words
        self.odd = regex.compile(r"\s\s|[^\S \n]|^\s|\s$").search
        self.pieces, self.first, self.rest = Cache(), Cache(), Cache()
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.tables.special)) + ")").split \
            if self.tables.special else None
        self.newline = self._piece("\n")
        blob = self.tables.bytes
        self.blob = np.frombuffer(b"".join(blob), np.uint8)
        self.lengths = np.array([len(b) for b in blob], np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])

    def _piece(self, p: str) -> bytes:
        got = self.pieces.young.get(p)
        if got is None:
            got = self.pieces.old.get(p)
            if got is None:
                got = array("I", self.tables.encode(p.encode())).tobytes()
            if len(p) <= 256:
                self.pieces.put(p, got)
        return got

    def _pieces(self, text: str) -> bytes:
        return b"".join([self._piece(p) for p in self.split(text)])

    def _word(self, cache: Cache, w: str, lead: str) -> bytes:
        got = cache.old.get(w)
        got = self._pieces(lead + w) if got is None else got
        return cache.put(w, got) if len(w) <= 256 else got

    def _plain(self, text: str) -> bytes:
        if self.odd(text):
            return self._pieces(text)
        out = []
        for line in text.split("\n"):
            first, *words = line.split(" ")
            x = self.first.young.get(first)
            out.append(self._word(self.first, first, "") if x is None else x)
            find = self.rest.young.get
            got = [find(w) for w in words]
            if None in got:
                got = [self._word(self.rest, w, " ") if x is None else x for w, x in zip(words, got)]
            out += got
            out.append(self.newline)
        out.pop()
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if self.cut and any(s in text for s in self.tables.special):
            return b"".join([np.array([self.tables.special[p]], "<u4").tobytes()
                             if p in self.tables.special else self._plain(p) for p in self.cut(text) if p])
        return self._plain(text)

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes of the tokens, one lookup in the offset table each."""
        n = self.lengths[ids]
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        at = np.repeat(self.offsets[ids] - (ends - n), n)
        at += np.arange(total)
        return self.blob[at].tobytes()


#: Ids decoded at a time.
STEP = 1 << 17


@lru_cache(maxsize=2)
def byte_bpe(path: str) -> ByteBPE:
    """One codec per worker process and file."""
    return ByteBPE(path)


def encode_texts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                 vocab: str = DEFAULT_BYTE_BPE) -> DataFrame:
    """(doc_id, ids binary): the ids as little-endian unsigned 32-bit integers."""
    common.prepare(docs.sparkSession)
    path = vocabulary(vocab)

    def run(rows):
        codec = byte_bpe(path)
        for b in common.batches(rows):
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([codec.encode(t) for t in b.column(1).to_pylist()], pa.binary())],
                names=["doc_id", "ids"])
    return (docs.select(F.col(id_col).cast("long").alias("id"), common.text_or_empty(text_col).alias("body"))
            .mapInArrow(run, "doc_id long, ids binary"))


def decode_ids(encoded: DataFrame, *, vocab: str = DEFAULT_BYTE_BPE) -> DataFrame:
    """(doc_id, text) of ``encode_texts``'s rows."""
    common.prepare(encoded.sparkSession)
    path = vocabulary(vocab)

    def run(rows):
        codec = byte_bpe(path)
        for b in common.batches(rows):
            texts = [codec.decode(np.frombuffer(x or b"", "<u4")).decode("utf-8", "replace")
                     for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])
    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
               vocab: str = DEFAULT_BYTE_BPE) -> DataFrame:
    """Encode and decode every text in one pass: doc_id, n_tokens, ids_sha256,
    decoded_sha256."""
    common.prepare(docs.sparkSession)
    path = vocabulary(vocab)

    def digest(codec, raw: bytes) -> tuple[int, str, str]:
        ids = np.frombuffer(raw, "<u4")
        out = b"".join([codec.decode(ids[k:k + STEP]) for k in range(0, len(ids), STEP)])
        try:
            out.decode()
        except UnicodeDecodeError:
            out = out.decode("utf-8", "replace").encode()
        return len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(out).hexdigest()

    def run(rows):
        codec = byte_bpe(path)
        for b in common.batches(rows):
            got = [digest(codec, codec.encode(t)) for t in b.column(1).to_pylist()]
            n, ids, out = zip(*got) if got else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()),
                                              pa.array(out, pa.string())],
                                             names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
    return (docs.select(F.col(id_col).cast("long").alias("id"), common.text_or_empty(text_col).alias("body"))
            .mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"))
