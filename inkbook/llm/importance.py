"""Operator 13: importance resampling towards a target distribution.

Features are runs of 1 to 3 words, hashed by CRC-32 into BUCKETS buckets. Each
text is scanned once with its words joined by single spaces, and the running
CRC is kept at the end of every word. CRC is linear over GF(2): the CRC of a
substring is the CRC of the prefix that ends with it, with the CRC of the
prefix before it cancelled after a shift by the substring's length. So every
feature costs one table look-up per byte of a CRC, however long it is.

Counts per bucket (a fixed number) are summed in each task before they are
shuffled. The gains of the buckets are the only thing that goes back to the
tasks: BUCKETS numbers, whatever the corpus holds. The draw ranks (score, id)
in ranges of a sort; ranks within a range are added to the rows before it.

Defined cases: a null text counts as empty; texts without words have no
features, weight 0 and take no part in the draw; a null id reads ``42:`` in
the noise, and null ids rank after all others; rows that repeat an id are
ranked each, in any order where they are equal; an empty table gives an empty
result. Only the id and text columns are read, so further columns of any name
do no harm."""
from __future__ import annotations

import hashlib
import math
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkbook.llm import common, wordscan

BUCKETS = 10_000
WORDS = 3
LEAST_WORDS = 20
PERCENT = 5
SEED = 42
# Word characters are digits, letters and all beyond ASCII.
SEPARATOR = np.ones(256, bool)
SEPARATOR[0x30:0x3A] = SEPARATOR[0x61:0x7B] = SEPARATOR[0x41:0x5B] = SEPARATOR[0x80:] = False
#: Shifts by fewer bytes than this have tables of their own (4 x 256 numbers).
SHORT = 128


# ------------------------------------------------------- GF(2) shifts of CRCs
@lru_cache(maxsize=1)
def _byte_table() -> np.ndarray:
    """CRC-32 of single bytes (reflected polynomial EDB88320)."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1).astype(np.uint32)
    return t


def _zero_byte(c: np.ndarray) -> np.ndarray:
    """The linear part of appending one zero byte."""
    return _byte_table()[c & np.uint32(0xFF)] ^ (c >> np.uint32(8))


@lru_cache(maxsize=1)
def _short_tables() -> np.ndarray:
    """[n, k, v]: byte k of a CRC, being v, shifted by n bytes."""
    out = np.empty((SHORT, 4, 256), np.uint32)
    out[0] = np.arange(256, dtype=np.uint32)[None] << (np.uint32(8) * np.arange(4, dtype=np.uint32))[:, None]
    for n in range(1, SHORT):
        out[n] = _zero_byte(out[n - 1])
    return out


@lru_cache(maxsize=64)
def _power_table(k: int) -> np.ndarray:
    """[4, 256]: shift by SHORT * 2**k bytes."""
    if k == 0:
        return _zero_byte(_short_tables()[SHORT - 1])
    half = _power_table(k - 1)
    return _look_up(half, half)


def _look_up(table: np.ndarray, c: np.ndarray) -> np.ndarray:
    low = np.uint32(0xFF)
    return (table[0][c & low] ^ table[1][(c >> np.uint32(8)) & low]
            ^ table[2][(c >> np.uint32(16)) & low] ^ table[3][c >> np.uint32(24)])


def shift(crc: np.ndarray, n: np.ndarray) -> np.ndarray:
    """``crc`` shifted by ``n`` bytes each: what is cancelled from a prefix."""
    tables, low, near = _short_tables().reshape(-1), np.uint32(0xFF), n % SHORT
    at = near * 1024
    out = (tables[at + (crc & low)] ^ tables[at + 256 + ((crc >> np.uint32(8)) & low)]
           ^ tables[at + 512 + ((crc >> np.uint32(16)) & low)] ^ tables[at + 768 + (crc >> np.uint32(24))])
    far, k = n // SHORT, 0
    while far.any():
        odd = np.flatnonzero(far & 1)
        out[odd] = _look_up(_power_table(k), out[odd])
        far, k = far >> 1, k + 1
    return out


def running_crcs(text: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """CRCs of the prefixes of ``text`` that end before and after each word;
    the words are joined by one space."""
    view, crc, after = memoryview(text), 0, np.zeros(len(end), np.uint32)
    crc32, at = zlib.crc32, 0
    sums = []
    for e in end.tolist():
        crc = crc32(view[at:e], crc)
        sums.append(crc)
        at = e
    after[:] = sums
    before = np.zeros(len(end), np.uint32)
    # one space more than the prefix that ends with the word before
    before[1:] = ~_byte_table()[(~after[:-1] ^ np.uint32(0x20)) & np.uint32(0xFF)] ^ (~after[:-1] >> np.uint32(8))
    return before, after


def features(col: pa.Array):
    """(row, bucket) of every feature of the texts, words in pieces: yields
    arrays; also the rows of the words themselves."""
    held = None  # the last words of a piece, when a text goes on behind it
    for w in wordscan.scan(col, SEPARATOR, wordscan.LOWER):
        if not len(w.row):
            continue
        text, start, end = wordscan.joined(w)
        row, fresh = w.row, 0
        if held is not None and held[0] == row[0]:
            lead = held[1]
            text = np.concatenate([lead, np.array([0x20], np.uint8), text])
            more = np.array(held[2], np.int64)
            start, end = (np.concatenate([more[:, i], x + len(lead) + 1]) for i, x in ((0, start), (1, end)))
            row, fresh = np.concatenate([np.full(len(more), row[0]), row]), len(more)
        before, after = running_crcs(text, start, end)
        for n in range(1, WORDS + 1):
            k = len(row) - n + 1
            # features that end in words seen before are not counted again
            lo = max(0, fresh - n + 1)
            if k <= lo:
                continue
            one = np.flatnonzero(row[lo:k] == row[lo + n - 1:]) + lo
            crc = after[one + n - 1] ^ shift(before[one], end[one + n - 1] - start[one])
            yield row[one], (crc % np.uint32(BUCKETS)).astype(np.int64), n
        tail = np.flatnonzero(row[-(WORDS - 1):] == row[-1]) + max(0, len(row) - (WORDS - 1))
        at = start[tail[0]]
        held = row[-1], text[at:], [(int(start[i] - at), int(end[i] - at)) for i in tail]


# ----------------------------------------------------------------- the corpus
def bucket_counts(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """(bucket, n): features of all texts; each task sums its own first."""
    def count(rows):
        total = np.zeros(BUCKETS, np.int64)
        for b in common.batches(rows):
            for _, bucket, _ in features(b.column(0)):
                total += np.bincount(bucket, minlength=BUCKETS)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["bucket", "n"])

    made = texts.select(common.text_or_empty(text_col).alias("body")).mapInArrow(count, "bucket long, n long")
    return made.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The gain of each bucket: how much more often the target holds it."""
    S, T = float(source.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1.0) * (S + BUCKETS) / ((s + 1.0) * (T + BUCKETS))))
                     for s, t in zip(source.tolist(), target.tolist())], np.int64)


def noise(doc_id) -> int:
    h = int(hashlib.sha256(f"{SEED}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weigh(docs: DataFrame, gain: np.ndarray, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_words, n_features, weight, score."""
    def score(rows):
        for b in common.batches(rows):
            n, ids = b.num_rows, b.column(0).to_pylist()
            n_words, n_features, weight = (np.zeros(n, np.int64) for _ in range(3))
            for row, bucket, size in features(b.column(1)):
                count = np.bincount(row, minlength=n)
                n_features += count
                if size == 1:
                    n_words += count
                # whole numbers below 2**53 add up exactly as doubles
                weight += np.bincount(row, gain[bucket], n).astype(np.int64)
            score = weight + np.array([noise(i) for i in ids], np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), *map(pa.array, (n_words, n_features, weight, score))],
                names=["doc_id", "n_words", "n_features", "weight", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), common.text_or_empty(text_col).alias("body")) \
        .mapInArrow(score, "doc_id long, n_words long, n_features long, weight long, score long")


def draw(scored: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """``scored`` (stored) with ``rank``: the first floor(percent * N / 100) of
    the N long enough documents by score, ties to the smaller id."""
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("row").asc()]
    numbered = common.store(scored.withColumn("row", F.monotonically_increasing_id()), "importance-scores")
    enough = F.col("n_words") >= least_words
    ranges = common.store(numbered.filter(enough).repartitionByRange(*order)
                          .withColumn("part", F.spark_partition_id()), "importance-ranges")
    sizes = ranges.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    w = Window.orderBy("part")  # one row per range of the sort
    ahead = sizes.select("part", (F.sum("n").over(w) - F.col("n")).alias("ahead"))
    drawn = F.floor(sizes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).select("n").scalar()
                    * F.lit(percent) / F.lit(100))
    place = F.row_number().over(Window.partitionBy("part").orderBy(*order)) + F.col("ahead")
    ranked = ranges.join(F.broadcast(ahead), "part").withColumn("rank", place.cast("long"))
    keep = ["doc_id", "n_features", "weight", "score"]
    return ranked.select(*keep, F.when(F.col("rank") <= drawn, F.col("rank")).alias("rank")) \
        .unionByName(numbered.filter(~enough).select(*keep, F.lit(None).cast("long").alias("rank")))


def resample(docs: DataFrame, target: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
             target_text: str = "text", percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """Every document with its weight towards ``target`` and, where it is
    drawn, its rank."""
    def table(counts):  # at most BUCKETS rows, whatever the corpus holds
        out = np.zeros(BUCKETS, np.int64)
        for r in counts.collect():
            out[r.bucket] = r.n
        return out

    gain = gains(table(bucket_counts(docs, text_col)), table(bucket_counts(target, target_text)))
    return draw(weigh(docs, gain, id_col=id_col, text_col=text_col), percent, least_words)
