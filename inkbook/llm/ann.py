"""Operator 9: nearest neighbours by balanced posting lists.

Vectors are laid in posting lists around centroids. The centroids come from a
balanced hierarchical clustering of a bounded sample (SAMPLE rows, chosen by a
hash of the id); every vector is indexed. A vector near a border goes to up to
REPLICAS lists: those whose centroid is at most REPLICA_RATIO times as far as
the nearest. Centroids are found through an in-memory neighbour graph, by
best-first search, or all compared where that finds too few. A query visits
every list whose centroid is at most so many times as far as its nearest one
(at least enough lists to hold a fair number of vectors), and scores their
vectors exactly. That ratio is fitted: PILOTS queries are answered from all
vectors, and it is the least, from PROBE_RATIO on, at which the visited lists
hold the share AIM of their true neighbours, however many lists there are.

Largest inner product becomes smallest distance by one more coordinate,
sqrt(M^2 - |x|^2) with M the largest norm (zero for queries), so vectors need
not be normalised.

Work is dealt out by shard: whole lists up to SHARD vectors, parts of longer
ones (many equal vectors), and queries in parts of SHARD too, so no task holds
an unbounded group. The driver sees the sample, the centroids and one count
per list or shard.

Defined cases: vectors that are null, zero, of another length than most, or
hold null or non-finite components take no part; a row whose id is null is no
query and no candidate; of rows that repeat an id one is kept (the
least vector); equal scores go to the smaller
id; with fewer candidates than asked for all are returned; an empty table
gives an empty result. Only the id and vector columns are read."""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkbook.llm import common

#: Rows the centroids are fitted on, vectors per list aimed at, most lists.
SAMPLE, LIST, LISTS = 40_000, 200, 16_384
REPLICAS, REPLICA_RATIO = 4, 1.15
PROBE_RATIO, PROBES = 1.10, 512
#: Queries the ratio is fitted on, share of their neighbours to be found.
PILOTS, AIM = 256, 0.95
DEGREE = 16
SHARD = 32_768
#: Queries scored at a time.
BLOCK = 64


# ------------------------------------------------------------ the centroids
def _split(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """Labels of a k-means that pays for crowded clusters."""
    n = len(x)
    c = x[rng.choice(n, k, replace=False)]
    spread = float(x.var(0).sum()) + 1e-12
    size, label = np.full(k, n / k), np.zeros(n, int)
    for _ in range(8):
        cost = (c * c).sum(1) - 2 * x @ c.T + spread * (size / (n / k) - 1) * 0.3
        label = cost.argmin(1)
        size = (size + np.bincount(label, minlength=k)) / 2
        for j in range(k):
            own = x[label == j]
            c[j] = own.mean(0) if len(own) else x[rng.integers(n)]
    return label


def fit_centroids(x: np.ndarray, lists: int, seed: int = 7) -> np.ndarray:
    """About ``lists`` centroids: clusters are split until each has its share."""
    if not len(x):
        return np.zeros((0, x.shape[1] if x.ndim == 2 else 0))
    rng, share = np.random.default_rng(seed), max(1.0, len(x) / max(1, lists))
    done, todo = [], [x]
    while todo:
        part = todo.pop()
        k = int(min(8, round(len(part) / share)))
        if k < 2 or len(part) <= 2:
            done.append(part.mean(0))
            continue
        label = _split(part, k, rng)
        pieces = [p for p in (part[label == j] for j in range(k)) if len(p)]
        if len(pieces) < 2:                       # equal vectors
            done.append(part.mean(0))
        else:
            todo += pieces
    return np.array(done)


class Graph:
    """Neighbour graph of the centroids with best-first search of a batch."""

    def __init__(self, centroids: np.ndarray, degree: int = DEGREE):
        self.c, n = centroids, len(centroids)
        self.sq = (centroids ** 2).sum(1)
        links = np.empty((n, min(degree, n) + 1), np.int32)
        for lo in range(0, n, 512):
            d = self.sq - 2 * centroids[lo:lo + 512] @ centroids.T
            near = np.argpartition(d, links.shape[1] - 2, axis=1)[:, :links.shape[1] - 1]
            links[lo:lo + 512, :-1] = near
        links[:, -1] = (np.arange(n) + 1) % max(n, 1)     # a ring keeps it connected
        self.links = links
        self.start = np.linspace(0, n - 1, min(n, 16)).astype(int) if n else np.zeros(0, int)

    def search(self, q: np.ndarray, width: int, at_once: int = 8) -> tuple[np.ndarray, np.ndarray]:
        """The ``width`` nearest centroids found for each query and their
        distances, nearest first."""
        b, n = len(q), len(self.c)
        width = min(width, n)
        qq = (q * q).sum(1)
        dist, open_ = np.full((b, n), np.inf), np.zeros((b, n), bool)

        def visit(rows, nodes):
            fresh = np.isinf(dist[rows, nodes])
            rows, nodes = rows[fresh], nodes[fresh]
            d = qq[rows] + self.sq[nodes] - 2 * np.einsum("ij,ij->i", q[rows], self.c[nodes])
            dist[rows, nodes], open_[rows, nodes] = d, True
        visit(np.repeat(np.arange(b), len(self.start)), np.tile(self.start, b))
        while True:
            bound = np.partition(dist, width - 1, axis=1)[:, width - 1:width]
            ahead = np.where(open_ & (dist <= bound), dist, np.inf)
            m = min(at_once, n)
            nodes = np.argpartition(ahead, m - 1, axis=1)[:, :m]
            live = np.isfinite(np.take_along_axis(ahead, nodes, 1))
            if not live.any():
                break
            rows = np.repeat(np.arange(b), m).reshape(b, m)[live]
            nodes = nodes[live]
            open_[rows, nodes] = False
            visit(np.repeat(rows, self.links.shape[1]), self.links[nodes].ravel())
        best = np.argpartition(dist, width - 1, axis=1)[:, :width]
        d = np.take_along_axis(dist, best, 1)
        order = np.argsort(d, axis=1, kind="stable")
        return (np.take_along_axis(best, order, 1),
                np.sqrt(np.maximum(np.take_along_axis(d, order, 1), 0)))


    def all(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All centroids and their distances, nearest first."""
        d = (q * q).sum(1, keepdims=True) + self.sq - 2 * q @ self.c.T
        order = np.argsort(d, axis=1, kind="stable")
        return order, np.sqrt(np.maximum(np.take_along_axis(d, order, 1), 0))


def to_visit(graph: Graph, q: np.ndarray, homes: np.ndarray, ratio: float, least: int, width: int = PROBES) \
        -> list[np.ndarray]:
    """The lists each query visits: all within the ratio, and the nearest until
    ``least`` vectors are held. Where the last of the ``width`` centroids that
    the graph finds is still wanted, all centroids are looked at."""
    def wanted(near, d):
        held = np.cumsum(homes[near], axis=1) - homes[near]
        return (d <= d[:, :1] * ratio) | (held < least)
    near, d = graph.search(q, width)
    take = wanted(near, d)
    out = [n[t] for n, t in zip(near, take)]
    more = np.flatnonzero(take[:, -1]) if near.shape[1] < len(graph.c) else []
    for lo in range(0, len(more), 16):
        part = more[lo:lo + 16]
        near, d = graph.all(q[part])
        for r, n, t in zip(part, near, wanted(near, d)):
            out[r] = n[t]
    return out


def fitted_ratio(graph: Graph, q: np.ndarray, homes: np.ndarray, hits: list[tuple[int, list[int]]], ratio: float,
                 least: int, aim: float = AIM) -> float:
    """The least ratio, from ``ratio`` on, at which queries visit a list of the
    share ``aim`` of ``hits``: (query, lists that hold one of its neighbours)."""
    need = []
    by: dict[int, list[list[int]]] = {}
    for i, lists in hits:
        by.setdefault(i, []).append(lists)
    for i, each in by.items():
        near, d = (x[0] for x in graph.all(q[i:i + 1]))
        far = np.empty(len(d))
        far[near] = d
        held = np.cumsum(homes[near]) - homes[near]
        free = d[held < least].max(initial=0.0)            # visited at any ratio
        for lists in each:
            f = far[lists].min()
            need.append(1.0 if f <= free else f / d[0] if d[0] > 0 else np.inf)
    if not need:
        return ratio
    return float(max(ratio, np.sort(need)[int(np.ceil(aim * len(need))) - 1] * (1 + 1e-9)))


def exact_scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products summed in component order, so that equal vectors score
    equally wherever they lie."""
    out = np.zeros(len(x))
    for j in range(x.shape[1]):
        out += q[j] * x[:, j]
    return out


def nearest(q: np.ndarray, own: int, ids: np.ndarray, x: np.ndarray, rough: np.ndarray, error: float, k: int):
    """The k best (score, id) among candidates, in which an id may occur up to
    REPLICAS times. ``rough`` scores, off by ``error`` at most, are a sieve."""
    many = REPLICAS * (k + 1)
    at = np.arange(len(ids))
    if len(at) > many:
        bound = np.partition(rough, len(rough) - many)[len(rough) - many]
        at = np.flatnonzero(rough >= bound - 2 * error)
    at = at[np.unique(ids[at], return_index=True)[1]]
    at = at[ids[at] != own]
    score = exact_scores(q, x[at])
    top = np.lexsort((ids[at], -score))[:k]
    return score[top], ids[at][top]


class _Rows:
    """Rows ``at`` of a matrix, fetched when they are asked for."""

    def __init__(self, x: np.ndarray, at: np.ndarray):
        self.x, self.at = x, at

    def __getitem__(self, i):
        return self.x[self.at[i]]


def _matrix(col: pa.Array) -> np.ndarray:
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(col), -1) if len(col) else np.zeros((0, 0))


# ------------------------------------------------------------- on Spark
def usable_vectors(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, vec) of the rows that take part."""
    v = F.col("vec")
    good = (F.col("vec_id").isNotNull() & v.isNotNull()
            & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
            & F.exists(v, lambda x: x != 0))
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("vec")).where(good)
    dims = rows.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").first()
    kept = rows.where(F.size("vec") == (dims["n"] if dims else 0))
    return kept.groupBy("vec_id").agg(F.min("vec").alias("vec"))


def search(df: DataFrame, *, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 20,
           query_every: int = 20, probe_ratio: float = PROBE_RATIO) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row whose id
    ``query_every`` divides."""
    spark = common.prepare(df.sparkSession)
    rows = common.store(usable_vectors(df, id_col, vec_col), "vectors")
    norm2 = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    n, top2 = rows.agg(F.count("*"), F.max(norm2)).first()
    share = min(1.0, SAMPLE / max(1, n))
    sample = rows.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 20)) < int(share * (1 << 20))) \
        .select("vec_id", "vec").toArrow().sort_by("vec_id")
    raw = _matrix(sample["vec"])

    def lifted(x: np.ndarray) -> np.ndarray:
        return np.hstack([x, np.sqrt(np.maximum(top2 - (x * x).sum(1, keepdims=True), 0))])
    graph = Graph(fit_centroids(lifted(raw), int(min(LISTS, max(1, n // LIST)))) if len(raw) else np.zeros((1, 1)))
    one_list = len(graph.c) <= 1

    def lay(batches):
        for b in common.batches(batches, 1 << 20):
            x = _matrix(b.column(1))
            for lo in range(0, len(x), 256):
                part = b.slice(lo, 256)
                if one_list:
                    near, d = np.zeros((part.num_rows, 1), int), np.ones((part.num_rows, 1))
                else:
                    near, d = graph.search(lifted(x[lo:lo + 256]), max(REPLICAS, 32))
                take = d[:, :REPLICAS] <= d[:, :1] * REPLICA_RATIO + 1e-12
                at, j = np.nonzero(take)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(near[at, j].astype(np.int32)), pa.array(j == 0), part.column(0).take(pa.array(at)),
                     part.column(1).take(pa.array(at))], names=["list", "home", "vec_id", "vec"])
    kind = rows.schema["vec"].dataType.simpleString()
    postings = common.store(rows.mapInArrow(lay, f"list int, home boolean, vec_id long, vec {kind}"), "postings")
    counts = {r["list"]: (r["n"], r["home"]) for r in postings.groupBy("list").agg(
        F.count("*").alias("n"), F.sum(F.col("home").cast("int")).alias("home")).collect()}   # one row per list

    # shards: whole lists, or parts of a long one
    base, parts, used, shard = {}, {}, 0, 0
    for i in sorted(counts):
        size = counts[i][0]
        if size > SHARD:
            shard += used > 0
            base[i], parts[i], used = shard, -(-size // SHARD), 0
            shard += parts[i]
            continue
        if used + size > SHARD:
            shard, used = shard + 1, 0
        base[i], parts[i], used = shard, 1, used + size
    homes = np.zeros(len(graph.c), np.int64)
    for i, (_, h) in counts.items():
        homes[i] = h

    wanting = rows.where(F.col("vec_id") % query_every == 0)
    if not one_list:
        pilots = wanting.orderBy(F.xxhash64("vec_id"), "vec_id").limit(PILOTS).toArrow().sort_by("vec_id")
        pilot_ids, pilot = pilots["vec_id"].to_numpy(), _matrix(pilots["vec"])
        many = REPLICAS * (k + 1)

        def true_hits(batches):
            """The rows of a partition that may be among the best of a pilot."""
            best = [np.zeros((len(pilot), 0)), np.zeros((len(pilot), 0), np.int64), np.zeros((len(pilot), 0), np.int32)]
            for b in common.batches(batches, 1 << 20):
                for lo in range(0, b.num_rows, 4096):
                    part = b.slice(lo, 4096)
                    ids, lists = part.column(1).to_numpy(), part.column(0).to_numpy()
                    got = pilot @ _matrix(part.column(2)).T
                    got[pilot_ids[:, None] == ids] = -np.inf
                    every = [np.hstack([best[0], got]), np.hstack([best[1], np.broadcast_to(ids, got.shape)]),
                             np.hstack([best[2], np.broadcast_to(lists, got.shape)])]
                    if every[0].shape[1] > many:
                        at = np.argpartition(-every[0], many - 1, axis=1)[:, :many]
                        every = [np.take_along_axis(x, at, 1) for x in every]
                    best = every
            r, j = np.nonzero(np.isfinite(best[0]))
            yield pa.RecordBatch.from_arrays([pa.array(r.astype(np.int32)), *(pa.array(x[r, j]) for x in best)],
                                             names=["pilot", "score", "vec_id", "list"])
        hits = []
        if len(pilot):
            seen = postings.select("list", "vec_id", "vec").mapInArrow(
                true_hits, "pilot int, score double, vec_id long, list int") \
                .groupBy("pilot", "vec_id").agg(F.max("score").alias("score"), F.collect_set("list").alias("lists"))
            best = seen.groupBy("pilot").agg(F.slice(F.sort_array(F.collect_list(
                F.struct((-F.col("score")).alias("down"), "vec_id", "lists"))), 1, k).alias("top"))
            hits = [(r["pilot"], h["lists"]) for r in best.collect() for h in r["top"]]      # k rows per pilot
        probe_ratio = fitted_ratio(graph, np.hstack([pilot, np.zeros((len(pilot), 1))]), homes, hits, probe_ratio, 10 * k)

    def probe(batches):
        for b in common.batches(batches, 1 << 20):
            x = _matrix(b.column(1))
            got = []
            for lo in range(0, len(x), 64):
                q = x[lo:lo + 64]
                # enough lists to hold ten times what is asked for
                visit = [np.zeros(1, int)] * len(q) if one_list else \
                    to_visit(graph, np.hstack([q, np.zeros((len(q), 1))]), homes, probe_ratio, 10 * k)
                for r in range(len(q)):
                    by: dict[int, list[int]] = {}
                    for i in visit[r].tolist():
                        for p in range(parts.get(i, 0)):
                            by.setdefault(base[i] + p, []).append(i)
                    got += [(s, lo + r, lists) for s, lists in by.items()]
            at = pa.array([g[1] for g in got], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array([g[0] for g in got], pa.int32()), b.column(0).take(at), b.column(1).take(at),
                 pa.array([g[2] for g in got], pa.list_(pa.int32()))], names=["shard", "query_id", "vec", "lists"])
    asked = common.store(wanting.mapInArrow(
        probe, f"shard int, query_id long, vec {kind}, lists array<int>"), "probes")
    asking = {r["shard"]: -(-r["count"] // SHARD) for r in asked.groupBy("shard").count().collect()}

    places = spark.createDataFrame([(i, base[i], parts[i]) for i in base] or [(0, 0, 1)], "list int, base int, parts int")
    turns = spark.createDataFrame(list(asking.items()) or [(0, 1)], "shard int, turns int")
    dealt = (postings.join(F.broadcast(places), "list")
             .withColumn("shard", (F.col("base") + F.pmod(F.xxhash64("vec_id"), F.col("parts"))).cast("int"))
             .join(F.broadcast(turns), "shard")
             .select("shard", F.explode(F.sequence(F.lit(0), F.col("turns") - 1)).alias("turn"), "list", "vec_id", "vec"))
    queries = (asked.join(F.broadcast(turns), "shard")
               .select("shard", F.pmod(F.xxhash64("query_id"), F.col("turns")).cast("int").alias("turn"),
                       "query_id", "vec", "lists"))

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows and right.num_rows:
            order = np.argsort(left["list"].to_numpy(), kind="stable")
            lists = left["list"].to_numpy()[order]
            ids, x = left["vec_id"].to_numpy()[order], _matrix(left["vec"])[order]
            names, first, many = np.unique(lists, return_index=True, return_counts=True)
            where = {int(l): slice(f, f + c) for l, f, c in zip(names, first, many)}
            q, low = _matrix(right["vec"]), x.astype(np.float32)
            error = 1e-6 * x.shape[1] * float(np.abs(x).max()) * float(np.abs(q).max()) * x.shape[1] ** 0.5
            for lo in range(0, len(q), BLOCK):
                rough = q[lo:lo + BLOCK].astype(np.float32) @ low.T
                for r, (own, wanted) in enumerate(zip(right["query_id"][lo:lo + BLOCK].to_pylist(),
                                                      right["lists"][lo:lo + BLOCK].to_pylist())):
                    at = np.concatenate([np.arange(where[i].start, where[i].stop) for i in wanted if i in where]
                                        or [np.zeros(0, int)])
                    s, v = nearest(q[lo + r], own, ids[at], _Rows(x, at), rough[r, at],
                                   error, k)
                    out.append((own, [{"down": -a, "vec_id": b} for a, b in zip(s.tolist(), v.tolist())]))
        own, top = zip(*out) if out else ((), ())
        return pa.table({"query_id": pa.array(own, pa.int64()), "top": pa.array(top, pa.list_(pa.struct(
            [("down", pa.float64()), ("vec_id", pa.int64())])))})
    found = dealt.groupBy("shard", "turn").cogroup(queries.groupBy("shard", "turn")).applyInArrow(
        score, "query_id long, top array<struct<down double, vec_id long>>")
    # a query has k rows from each shard it visits; a replica may be in two
    merged = found.groupBy("query_id").agg(F.flatten(F.collect_list("top")).alias("top")).select(
        "query_id", F.posexplode(F.slice(F.sort_array(F.array_distinct("top")), 1, k)).alias("pos", "hit"))
    return merged.select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"),
                         (-F.col("hit.down")).alias("score"))
