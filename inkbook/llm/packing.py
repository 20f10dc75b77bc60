"""Operator 6: packing documents into sequences by linear grouping.

1. Tasks encode the texts and cut those longer than a sequence into pieces.
2. The counts per length (no more rows than a sequence has tokens, whatever
   the corpus) go to the driver, which plans on counts alone:
   large lengths are put in groups of equal cardinality and rounded up to the
   longest of their group; the few sizes left are packed by whole-bin
   configurations (column generation: the duals price a knapsack); real
   lengths then take the places of the rounded ones; what the configurations
   leave over and all small lengths go best-fit into the room that is left.
   Bins of equal content are one entry of the plan ("run"), so the plan's size
   depends on the number of lengths, not on the number of documents.
3. Every piece gets its rank among the pieces of its length, and the plan says
   which sequence and place that rank has.

A length shared by very many pieces is ranked in salted parts.

Defined cases: a null or empty text is one piece with the end id alone; null
ids and rows that repeat an id are documents like others; an empty table gives
an empty result. Only the id and text columns are read."""
from __future__ import annotations

import bisect
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkbook.llm import common, encode

CAPACITY = 4096
END_ID = 1
#: Lengths above CAPACITY / SMALL are large; large ones form GROUPS groups.
SMALL = 8
GROUPS = 64
#: Pieces of one length that one window task ranks.
RANKED = 1000


# ----------------------------------------------------- planning on counts
def _knapsack(sizes: list[int], values: np.ndarray, capacity: int, most: int) -> tuple[float, list[int]]:
    """Best multiset of at most ``most`` sizes within ``capacity``."""
    best = np.zeros(capacity + 1)
    picks = []
    for _ in range(most):
        new, pick = best.copy(), np.full(capacity + 1, -1)
        for g, (s, v) in enumerate(zip(sizes, values)):
            if v > 1e-12:
                cand = best[:capacity + 1 - s] + v
                better = cand > new[s:] + 1e-12
                new[s:][better] = cand[better]
                pick[s:][better] = g
        picks.append(pick)
        if not (pick >= 0).any():
            break
        best = new
    counts, room = [0] * len(sizes), capacity
    for pick in reversed(picks):
        if pick[room] >= 0:
            counts[pick[room]] += 1
            room -= sizes[pick[room]]
    return float(best[capacity]), counts


def configurations(sizes: list[int], demand: list[int], capacity: int) -> list[tuple[list[int], int]]:
    """Whole-bin configurations and how often to use each, from the linear
    programme over all configurations, rounded down."""
    m = len(sizes)
    if not m:
        return []
    most = capacity // min(sizes)
    basis = np.diag([float(capacity // s) for s in sizes])
    need = np.array(demand, float)
    for _ in range(60 * m):
        inverse = np.linalg.inv(basis)
        amounts = inverse @ need
        duals = inverse.sum(0)
        value, column = _knapsack(sizes, duals, capacity, most)
        if value <= 1 + 1e-7:
            break
        step = inverse @ np.array(column, float)
        ratio = np.where(step > 1e-9, amounts / np.where(step > 1e-9, step, 1), np.inf)
        basis[:, int(np.argmin(ratio))] = column
    amounts = np.linalg.inv(basis) @ need
    left, out = list(demand), []
    for k in np.argsort(-amounts):
        config = [int(round(x)) for x in basis[:, k]]
        times = min([int(amounts[k] + 1e-6), *(left[g] // a for g, a in enumerate(config) if a)])
        if times > 0:
            out.append((config, times))
            left = [x - a * times for x, a in zip(left, config)]
    return out


class _Bins:
    """Runs of bins with equal content, found by the room that is left."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.by_room: dict[int, list] = defaultdict(list)
        self.rooms: list[int] = []

    def add(self, n: int, content: tuple, room: int) -> None:
        if not self.by_room[room]:
            bisect.insort(self.rooms, room)
        self.by_room[room].append((n, content))

    def best_fit(self, length: int, count: int) -> None:
        """Each item in turn goes where least room stays; bins that take the
        same items are filled at once."""
        while count:
            at = bisect.bisect_left(self.rooms, length)
            if at < len(self.rooms):
                room = self.rooms[at]
                n, content = self.by_room[room].pop()
                if not self.by_room[room]:
                    self.rooms.pop(at)
            else:
                room, content, n = self.capacity, (), -(-count // (self.capacity // length))
            each = room // length
            full = min(n, count // each)
            if full:
                self.add(full, (*content, (length, each)), room - each * length)
            count -= full * each
            n -= full
            if count and n:
                self.add(1, (*content, (length, count)), room - count * length)
                n, count = n - 1, 0
            if n and content:
                self.add(n, content, room)


def plan(counts: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS) -> list[tuple[int, tuple]]:
    """Runs (number of bins, ((length, items per bin), ...)) that hold the
    given number of items of every length."""
    counts = {l: c for l, c in counts.items() if c > 0}
    if any(not 0 < l <= capacity for l in counts):
        raise ValueError("a length is not between 1 and the capacity")
    bins = _Bins(capacity)
    left = dict(counts)
    large = sorted((l for l in counts if l * SMALL > capacity and l < capacity), reverse=True)
    # groups of equal cardinality, longest first; a length may span groups
    total = sum(counts[l] for l in large)
    members: list[list[list[int]]] = []
    if total:
        share, room = -(-total // groups), 0
        for l in large:
            c = counts[l]
            while c:
                if not room:
                    members.append([])
                    room = share
                take = min(c, room)
                members[-1].append([l, take])
                c, room = c - take, room - take
    sizes = [m[0][0] for m in members]
    demand = [sum(c for _, c in m) for m in members]
    # groups of one size are one row of the programme
    rows = sorted(set(sizes), reverse=True)
    row_of = {s: i for i, s in enumerate(rows)}
    stock: list[list[list[int]]] = [[] for _ in rows]
    for s, m in zip(sizes, members):
        stock[row_of[s]] += m
    need = [0] * len(rows)
    for s, d in zip(sizes, demand):
        need[row_of[s]] += d
    for config, times in configurations(rows, need, capacity):
        wanted = [(g, a) for g, a in enumerate(config) if a]
        while times:
            run = min(stock[g][0][1] // a for g, a in wanted)
            run = max(1, min(run, times))
            content: dict[int, int] = defaultdict(int)
            for g, a in wanted:
                if stock[g][0][1] >= a * run:
                    content[stock[g][0][0]] += a
                    stock[g][0][1] -= a * run
                else:                       # only with run == 1
                    for _ in range(a):
                        while not stock[g][0][1]:
                            stock[g].pop(0)
                        content[stock[g][0][0]] += 1
                        stock[g][0][1] -= 1
                while stock[g] and not stock[g][0][1]:
                    stock[g].pop(0)
            for l, a in content.items():
                left[l] -= a * run
            bins.add(run, tuple(content.items()), capacity - sum(l * a for l, a in content.items()))
            times -= run
    for l in sorted(left, reverse=True):
        if left[l]:
            bins.best_fit(l, left[l])
    return [run for room in sorted(bins.by_room) for run in bins.by_room[room]]


def places(runs: list[tuple[int, tuple]]) -> np.ndarray:
    """The plan as intervals of ranks, sorted: length, first rank, items per
    bin, first sequence, place in the sequence."""
    out, rank, seq = [], defaultdict(int), 0
    for n, content in runs:
        at = 0
        for length, each in content:
            out.append((length, rank[length], each, seq, at))
            rank[length] += n * each
            at += length * each
        seq += n
    return np.array(sorted(out), np.int64).reshape(-1, 5)


# ------------------------------------------------------------- on Spark
def pieces(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
           vocabulary: str = encode.DEFAULT_WORD_BPE) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece."""
    common.prepare(docs.sparkSession)
    path = encode.vocabulary(vocabulary)
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()),
                        ("length", pa.int64()), ("ids_crc32", pa.int64())])
    end = np.uint32(END_ID).astype("<u4").tobytes()

    def run(rows):
        enc, step = encode.word_encoder(path), 4 * capacity
        for b in common.batches(rows):
            got = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                raw = enc.encode(text) + end
                for k, at in enumerate(range(0, len(raw), step)):
                    part = raw[at:at + step]
                    got.append((doc_id, k, at // 4, len(part) // 4, zlib.crc32(part)))
            cols = zip(*got) if got else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, schema.types)], schema=schema)
    return (docs.select(F.col(id_col).cast("long").alias("id"), common.text_or_empty(text_col).alias("body"))
            .mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long"))


def pack(cut: DataFrame, *, capacity: int = CAPACITY, groups: int = GROUPS) -> DataFrame:
    """Adds sequence_id and offset to the rows of ``pieces`` (which must be a
    stored table: it is read for the counts and again for the ranks)."""
    spark = common.prepare(cut.sparkSession)
    hist = cut.groupBy("length").count()
    counts = {r["length"]: r["count"] for r in hist.collect()}      # at most `capacity` rows
    table = places(plan(counts, capacity, groups))
    if not len(table):
        return cut.select("*", F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    # ranks: salted parts of each length (by content too, so that rows which share
    # an id spread), then the parts' sizes summed up
    parts = spark.createDataFrame([(l, -(-c // RANKED)) for l, c in sorted(counts.items())],
                                  "length long, parts long")
    salted = (cut.join(F.broadcast(parts), "length")
              .withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32"), F.col("parts"))).drop("parts"))
    within = Window.partitionBy("length", "part").orderBy("doc_id", "piece", "ids_crc32")
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = salted.groupBy("length", "part").count().select(
        "length", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    ranked = (salted.withColumn("rank", F.row_number().over(within) - 1)
              .join(sizes, ["length", "part"])
              .select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("base")).alias("rank")))

    def place(rows):
        # (length, rank) as one sortable number: lengths are at most `capacity`
        keys = table[:, 0].astype(np.int64) * (1 << 48) + table[:, 1]
        for b in rows:
            length = b.column(3).to_numpy(zero_copy_only=False)
            rank = b.column(5).to_numpy(zero_copy_only=False)
            at = table[np.searchsorted(keys, length * (1 << 48) + rank, "right") - 1]
            step = rank - at[:, 1]
            seq = at[:, 3] + step // at[:, 2]
            off = at[:, 4] + step % at[:, 2] * length
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(seq), pa.array(off)],
                                             names=["doc_id", "piece", "start", "length", "ids_crc32",
                                                    "sequence_id", "offset"])
    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, "
                                    "sequence_id long, offset long")


def pack_documents(docs: DataFrame, **options) -> DataFrame:
    """Cut, plan and place: one row per piece."""
    return pack(common.store(pieces(docs, **options), "pieces"))
