"""Operator 3: exact n-gram Jaccard join over prefix trees.

1. Every text becomes its set of distinct word shingles (64-bit codes: total
   length, long first, then a hash). Equal sets are one class from here on.
2. Long shingles are rare, so the longest ones decide first: a set that shares
   too few of them with any other set cannot have a partner (a partner leaves
   at most the share 1 - t of a set unmatched). Every set shows more of them than
   it counts, so that a partner finds each shared one. Which shingles occur in
   one class only is a partially aggregated min/max per shingle.
3. The remaining classes are read again (found through a Bloom bitmap of fixed
   size; false hits are harmless) and ordered rare shingles first, by counts in
   a table of fixed size: one global order.
4. Two similar sets share a shingle of their prefixes in that order. Sets that
   share one form a block; blocks of equal members are kept once.
5. A block first sees its sets' sketches only: counts of shingles per hash
   bucket, an eighth of the set or less. The sum of the lesser counts bounds an
   overlap from above, so a set whose bounds against all others of its block
   fall short has no partner there and is left out. For the others a task
   stores the ordered sets in a trie and walks it once for all probing sets
   together: overlaps along a shared path are counted once, and a subtree is
   left as soon as the lengths that remain cannot reach the threshold for any
   probe. The links of a block go out as stars around the least set of
   each component.
   In the first rounds every set goes to one block only, and of a large block to
   one chunk, which a few leading sets of the block join: they connect the
   chunks, so a large family costs one copy of each set. Sets connected by then
   need not meet again in the last round, which deals a block out as pairs of
   chunks of different parts.
6. Connected components of the links, on stored tables.

No pair is emitted that is not a link, and copies are never expanded.

Defined cases: a text with fewer words than a shingle is one shingle; a text
that is null or has no words has the empty set, is linked with nothing and is
its own component; rows that repeat an id share the component of their text
(the id is not a node; the text's class is); a null id is never the smallest;
an empty table gives an empty result. Only the id and text columns are read."""
from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkbook.llm import common, graph

WORDS, PERCENT = 4, 85
#: Share of a set's shingles that the first test looks at, times (1 - t).
FIRST = 4 / 3
BLOOM_BITS = 1 << 26
TABLE = 1 << 20
#: Rounds in which a set goes to one block only.
ROUNDS = 2
#: Sets of a block that one trie holds.
CHUNK = 512
#: Leading sets of a large block, on average, that every chunk of it holds in
#: the first rounds.
LEADS = 16
MOST_BUCKETS = 4096
#: Names of sets that a task remembers in order not to send one twice.
REMEMBERED = 1 << 17


# ------------------------------------------------------------- the sets
def shingle_sets(col: pa.Array, words: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle codes of each text of a column."""
    rows, h, start, end = common.word_hashes(col, spans=True)
    n = len(h)
    length = (end - start).astype(np.uint64)
    cut = np.searchsorted(rows, np.arange(len(col) + 1))
    m = max(0, n - words + 1)
    code, total = np.zeros(m, np.uint64), np.zeros(m, np.uint64)
    for k in range(words):
        code = common.mix(code * np.uint64(31) + h[k:k + m] + np.uint64(k + 1))
        total += length[k:k + m]
    code = _coded(code, total)
    for i in range(len(col)):
        a, b = cut[i], cut[i + 1]
        if a == b:
            yield np.zeros(0, np.uint64)
        elif b - a >= words:
            yield np.unique(code[a:b - words + 1])
        else:
            one = np.zeros(1, np.uint64)
            for x in h[a:b]:
                one = common.mix(one * np.uint64(31) + x + np.uint64(77))
            yield _coded(one, length[a:b].sum(keepdims=True))


def _coded(code: np.ndarray, total: np.ndarray) -> np.ndarray:
    return (np.uint64(255) - np.minimum(total, 255)) << np.uint64(56) | code >> np.uint64(8)


def signature(s: np.ndarray) -> bytes:
    """128 bits that name a set."""
    a = common.mix(s).sum(dtype=np.uint64)
    b = common.mix(s ^ np.uint64(0xD6E8FEB86659FD93)).sum(dtype=np.uint64)
    return np.array([a, b], "<u8").tobytes()


def allowed(n: int, percent: int) -> int:
    """Shingles of a set that a partner may leave unmatched."""
    return n - -(-percent * n // 100)


def counted(n: int, percent: int) -> int:
    """Longest shingles of a set that the first test counts."""
    return min(n, int(np.ceil(n * (100 - percent) / 100 * FIRST)) + 1)


@lru_cache(1 << 16)
def shown(n: int, percent: int) -> int:
    """Longest shingles of a set that hold every shared one that a partner
    counts: before such a one stand here at most those that the partner has
    before it, and those that this set leaves unmatched."""
    m = np.arange(-(-percent * n // 100), 100 * n // percent + 1)      # sizes of partners
    unmatched = n - -(-percent * (m + n) // (100 + percent))
    first = np.minimum(m, np.ceil(m * (100 - percent) / 100 * FIRST).astype(np.int64) + 1)
    return int(min(n, (first + unmatched)[unmatched >= 0].max()))


def sketch(s: np.ndarray) -> bytes:
    """Counts per hash bucket (255: that many or more), a power of two of buckets
    with one shingle each or less, so that sets which differ by a little more
    than allowed are told apart; MOST_BUCKETS bound the sketches of long sets."""
    n = 16
    while n < min(len(s), MOST_BUCKETS):
        n *= 2
    return np.minimum(np.bincount((common.mix(s) & np.uint64(n - 1)).astype(np.int64), minlength=n), 255) \
        .astype(np.uint8).tobytes()


def may_link(sizes: np.ndarray, sketches: list[np.ndarray], side: np.ndarray, part: np.ndarray,
             percent: int) -> np.ndarray:
    """Which sets of a block may have a partner there, by sizes and sketches;
    partners are of another part, and of the other side if there are two."""
    m = len(sizes)
    width = min(map(len, sketches))
    # a wider sketch folds: its bucket modulo the narrower number of buckets
    flat = np.stack([x.reshape(-1, width).sum(0, dtype=np.int32) for x in sketches])
    full = np.array([(x == 255).any() for x in sketches])
    out = np.zeros(m, bool)
    two = bool(side.any())
    for i in range(m):
        with_ = (part != part[i]) & (100 * np.minimum(sizes, sizes[i]) >= percent * np.maximum(sizes, sizes[i]))
        if two:
            with_ &= side != side[i]
        with_[:i + 1] = False
        at = np.flatnonzero(with_)
        if not len(at):
            continue
        bound = np.minimum(flat[at], flat[i]).sum(1)
        bound = np.where(full[at] | full[i], sizes[at], bound)
        good = bound * (100 + percent) >= percent * (sizes[at] + sizes[i])
        out[at[good]] = True
        out[i] |= good.any()
    return out


# ------------------------------------------------------------- the trie
def trie_links(sets: list[np.ndarray], probes: list[np.ndarray] | None, percent: int) -> list[tuple[int, int]]:
    """(set, probe) pairs that link. Sets and probes hold ranks in the global
    order, ascending; without probes the sets are joined with themselves
    (probe < set)."""
    own = probes is None
    probes = sets if own else probes
    n_p = np.array([len(p) for p in probes], np.int64)
    order = sorted(range(len(sets)), key=lambda i: sets[i].astype(">u4").tobytes())
    recs = [sets[i] for i in order]
    size = np.array([len(r) for r in recs], np.int64)
    # which probes hold which shingle; shingles of one holder match nothing
    ranks, first, inverse = np.unique(np.concatenate(probes), return_index=True, return_inverse=True)
    held = np.zeros((len(ranks) + 1, len(probes)), np.uint8)
    held[inverse, np.repeat(np.arange(len(probes)), n_p)] = 1
    rows = []
    for r in recs:
        at = np.minimum(np.searchsorted(ranks, r), len(ranks) - 1)
        rows.append(np.where(ranks[at] == r, at, len(ranks)))
    shared = np.zeros(len(recs), np.int64)            # with the record before
    for i in range(1, len(recs)):
        m = min(size[i], size[i - 1])
        differ = np.flatnonzero(recs[i][:m] != recs[i - 1][:m])
        shared[i] = differ[0] if len(differ) else m
    out: list[tuple[int, int]] = []
    whole = 100 + percent
    stack = [(0, len(recs), 0, np.arange(len(probes)), np.zeros(len(probes), np.int64))]
    while stack:
        lo, hi, depth, act, got = stack.pop()
        least, most = size[lo:hi].min(), size[lo:hi].max()
        end = int(shared[lo + 1:hi].min()) if hi - lo > 1 else int(size[lo])
        while True:
            # what can still be reached, by the lengths that remain
            top = got + np.minimum(most - depth, n_p[act] - got)
            alive = (top * whole >= percent * (n_p[act] + least)) & (100 * n_p[act] >= percent * least) \
                & (100 * most >= percent * n_p[act])
            if not alive.all():
                act, got = act[alive], got[alive]
            if not len(act) or depth >= end:
                break
            step = min(end, depth + 32)
            got = got + held[rows[lo][depth:step]][:, act].sum(0)
            depth = step
        if not len(act):
            continue
        i = lo
        while i < hi and size[i] == end:              # sets that end here
            link = got * whole >= percent * (n_p[act] + end)
            for p in act[link].tolist():
                if not own or p < order[i]:
                    out.append((order[i], p))
                elif own and p > order[i]:
                    out.append((p, order[i]))
            i += 1
        while i < hi:                                 # children
            j = i + 1
            while j < hi and shared[j] > end:
                j += 1
            stack.append((i, j, end, act, got))
            i = j
    return out


def spanning(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """(member, least member) of every component of the pairs."""
    up: dict[int, int] = {}

    def find(x):
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x
    for a, b in pairs:
        x, y = find(a), find(b)
        up[max(x, y)] = min(x, y)
    return [(x, find(x)) for x in list(up) if find(x) != x]


def block_links(sets: list[np.ndarray], side: list[int], weight, percent: int) -> list[tuple[int, int]]:
    """Links within a block (all of side 0) or between its two sides."""
    tokens, inverse = np.unique(np.concatenate(sets), return_inverse=True)
    rank = np.empty(len(tokens), np.int64)
    rank[np.lexsort((tokens, weight(tokens)))] = np.arange(len(tokens))
    ends = np.cumsum([len(s) for s in sets])
    ranked = [np.sort(rank[inverse[e - len(s):e]]) for s, e in zip(sets, ends)]
    if not any(side):
        return spanning(trie_links(ranked, None, percent))
    left = [i for i, s in enumerate(side) if not s]
    right = [i for i, s in enumerate(side) if s]
    if not left or not right:
        return []
    found = trie_links([ranked[i] for i in left], [ranked[i] for i in right], percent)
    return spanning([(left[a], right[b]) for a, b in found])


# ------------------------------------------------------------- on Spark
def _bodies(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), common.text_or_empty(text_col).alias("body"))


def _slot(tokens: np.ndarray) -> np.ndarray:
    return (common.mix(tokens) >> np.uint64(44)).astype(np.int64)


def classes(docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """doc_id, n, sig (null for the empty set) of every document."""
    def run(rows):
        for b in common.batches(rows):
            n, sig = [], []
            for s in shingle_sets(b.column(1), words):
                n.append(len(s))
                sig.append(signature(s) if len(s) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int32()), pa.array(sig, pa.binary())],
                                             names=["doc_id", "n", "sig"])
    return common.store(_bodies(docs, id_col, text_col).mapInArrow(run, "doc_id long, n int, sig binary"),
                        "shingle-classes")


def with_partners(docs: DataFrame, light: DataFrame, id_col: str, text_col: str, words: int,
                  percent: int) -> DataFrame:
    """(sig, n) of the classes that may have a partner."""
    def longest(rows):
        for b in common.batches(rows):
            keys, parts = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
            for s in shingle_sets(b.column(1), words):
                if not len(s):
                    continue
                part = s[:shown(len(s), percent)]
                # the lowest bit tells the tokens that count for their own set
                key = np.full(len(part), _key(signature(s)), np.int64) << 1
                key[:counted(len(s), percent)] |= 1
                parts.append(part)
                keys.append(key)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(parts).view(np.int64))],
                                             names=["key", "token"])
    tokens = _bodies(docs, id_col, text_col).mapInArrow(longest, "key long, token long")
    single = tokens.groupBy("token").agg(F.min("key").alias("key"), F.max("key").alias("other")) \
        .where((F.col("key") == F.col("other")) & (F.col("key").bitwiseAND(F.lit(1)) == 1))
    alone = single.groupBy(F.shiftrightunsigned("key", 1).alias("key")).agg(F.count("*").alias("alone"))
    one = light.where(F.col("sig").isNotNull()).groupBy("sig").agg(F.first("n").alias("n")).withColumn("key", _sql_key())
    bound = F.col("n") - F.ceil(F.col("n") * percent / 100)
    return one.join(alone, "key", "left").where(F.coalesce("alone", F.lit(0)) <= bound).select("sig", "n")


def _key(sig: bytes) -> int:
    """Eight bytes of a signature as a number (63 bits), in Python ..."""
    return int.from_bytes(sig[:8], "big") >> 1


def _sql_key():
    """... and in Spark."""
    return F.shiftrightunsigned(F.conv(F.hex(F.substring("sig", 1, 8)), 16, -10).cast("long"), 1)


def bloom(keys: DataFrame, bits: int = BLOOM_BITS) -> str:
    """Bitmap of the rows' ``key`` hashes, of fixed size, in the shared folder."""
    at = F.pmod(F.col("key"), F.lit(bits)) + 1        # Spark's positions count from 1
    return common.place(keys.select(F.bitmap_bucket_number(at).alias("bucket"), F.bitmap_bit_position(at).alias("bit"))
                        .groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("map")), "bitmap")


@lru_cache(1)
def bitmap(uri: str, bits: int = BLOOM_BITS) -> np.ndarray:
    """The bitmap, read once by every Python worker."""
    out = np.zeros(bits // 8, np.uint8)
    for rows in common.placed(uri):
        for bucket, part in zip(rows["bucket"], rows["map"]):
            lo = (bucket.as_py() - 1) * 4096
            part = np.frombuffer(part.as_buffer(), np.uint8)[:len(out) - lo]
            out[lo:lo + len(part)] = part
    return out


def candidate_sets(docs: DataFrame, light: DataFrame, id_col: str, text_col: str, words: int,
                   percent: int, parts: int) -> DataFrame:
    """sig, n, tokens (codes), sketch, id of the classes that may have a partner,
    in ``parts`` partitions by id."""
    shown_by = bloom(with_partners(docs, light, id_col, text_col, words, percent).select(_sql_key().alias("key")))

    def run(rows):
        seen, sent = bitmap(shown_by), set()
        for b in common.batches(rows):
            out = []
            for s in shingle_sets(b.column(1), words):
                if not len(s):
                    continue
                sig = signature(s)
                at = _key(sig) % BLOOM_BITS
                if seen[at >> 3] >> (at & 7) & 1 and sig not in sent:
                    if len(sent) >= REMEMBERED:
                        sent.clear()
                    sent.add(sig)
                    out.append((sig, len(s), s.astype("<u8").tobytes(), sketch(s)))
            cols = list(zip(*out)) if out else [()] * 4
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, (pa.binary(), pa.int32(), pa.binary(), pa.binary()))],
                names=["sig", "n", "tokens", "sketch"])
    rows = _bodies(docs, id_col, text_col).mapInArrow(run, "sig binary, n int, tokens binary, sketch binary") \
        .withColumn("id", F.xxhash64("sig"))
    # tasks send a set once, so it is enough to meet by the short name, by which
    # the sets are then stored
    return rows.repartition(parts, "id").groupBy("id", "sig").agg(*[F.first(c).alias(c) for c in ("n", "tokens", "sketch")])


def rarity(sets: DataFrame) -> str:
    """Counts of the shingles' slots, a table of fixed size, in the shared folder."""
    def run(rows):
        total = np.zeros(TABLE, np.int64)
        for b in rows:
            slots, n = np.unique(_slot(np.frombuffer(b"".join(b.column(0).to_pylist()), "<u8")), return_counts=True)
            total[slots] += n
        at = np.flatnonzero(total)
        for k in range(0, len(at), 50_000):
            part = at[k:k + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(total[part])], names=["slot", "n"])
    return common.place(sets.select("tokens").mapInArrow(run, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")),
                        "rarity")


@lru_cache(1)
def slot_counts(uri: str) -> np.ndarray:
    """The counts, read once by every Python worker."""
    out = np.zeros(TABLE, np.int32)
    for rows in common.placed(uri):
        out[rows["slot"].to_numpy()] = np.minimum(rows["n"].to_numpy(), 2**31 - 1)
    return out


def blocks(sets: DataFrame, weight, percent: int) -> DataFrame:
    """(id, token, members): which sets (by a short name; two sets of one name
    only meet in vain) are in which block, each membership kept once."""
    def prefixes(rows):
        for b in rows:
            key, token = [], []
            for name, n, t in zip(*(c.to_pylist() for c in b.columns)):
                t = np.frombuffer(t, "<u8")
                w = weight(t)
                first = np.lexsort((t, w))[:allowed(n, percent) + 1]
                first = first[w[first] > 1]
                key.append(np.full(len(first), name, np.int64))
                token.append(t[first].view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x) if x else np.zeros(0, np.int64))
                                              for x in (key, token)], names=["id", "token"])
    posts = sets.select("id", "n", "tokens").mapInArrow(prefixes, "id long, token long")
    block = posts.groupBy("token").agg(
        F.count("*").alias("members"), F.bit_xor(F.xxhash64("id")).alias("x"),
        F.sum(F.xxhash64(F.lit(1), "id").bitwiseAND(F.lit((1 << 40) - 1))).alias("y")).where(F.col("members") > 1)
    kept = block.groupBy("members", "x", "y").agg(F.min("token").alias("token")).select("token", "members")
    return common.store(posts.join(kept, "token"), "shingle-blocks")


def chunked(rows: DataFrame) -> DataFrame:
    """(id, part, block, side, lead): blocks of ``rows`` (id, token, part) by
    chunks, a set in one of them and the leading sets in all."""
    size = rows.groupBy("token").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"),
                                     F.count("*").alias("m")).where("m > 1")
    lead = (F.col("chunks") > 1) & (F.pmod(F.xxhash64(F.lit(2), "id"), F.col("m")) < LEADS)
    own = F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int")
    return rows.join(size, "token").withColumn("lead", lead.cast("int")) \
        .withColumn("chunk", F.explode(F.when(lead, F.sequence(F.lit(0), F.col("chunks") - 1)).otherwise(F.array(own)))) \
        .select("id", "part", F.xxhash64("token", "chunk").alias("block"), F.lit(0).alias("side"), "lead")


def paired(rows: DataFrame) -> DataFrame:
    """(id, part, block, side, lead): blocks of ``rows`` (id, token, part) as
    pairs of chunks, so that any two sets of different parts meet. A large part
    has chunks of its own, which need not meet each other; the small parts of a
    block share chunks."""
    parts = rows.groupBy("token", "part").agg(F.count("*").alias("m")).withColumn("large", F.col("m") * 2 > CHUNK)
    chunks = F.ceil(F.col("m") / CHUNK).cast("int")
    per_block = parts.groupBy("token").agg(
        F.ceil(F.sum(F.when(~F.col("large"), F.col("m")).otherwise(0)) / CHUNK).cast("int").alias("shared"),
        F.collect_list(F.when(F.col("large"), F.struct("part", chunks.alias("chunks")))).alias("own"))
    at = lambda large, part, i: F.struct(F.lit(large).alias("large"), part.alias("part"), i.cast("int").alias("i"))
    numbers = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    every = F.concat(F.transform(numbers(F.col("shared")), lambda i: at(False, F.lit(0).cast("long"), i)),
                     F.flatten(F.transform("own", lambda o: F.transform(numbers(o["chunks"]),
                                                                        lambda i: at(True, o["part"], i)))))
    meets = parts.join(per_block.select("token", "shared", every.alias("every")), "token").select(
        "token", "part", "large", F.when(F.col("large"), chunks).otherwise(F.col("shared")).alias("chunks"),
        F.filter("every", lambda x: ~(F.col("large") & x["large"] & (x["part"] == F.col("part")))).alias("others"))
    name = lambda large, part, i: F.xxhash64(large, part, i)
    me = F.when(F.col("large"), name(F.col("large"), F.col("part"), F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int"))) \
        .otherwise(name(F.col("large"), F.lit(0).cast("long"), F.pmod(F.xxhash64("part"), F.col("chunks")).cast("int")))
    return rows.join(meets, ["token", "part"]).withColumn("me", me).withColumn("o", F.explode("others")) \
        .withColumn("other", name(F.col("o.large"), F.col("o.part"), F.col("o.i"))) \
        .select("id", "part", F.xxhash64("token", F.least("me", "other"), F.greatest("me", "other")).alias("block"),
                (F.col("me") > F.col("other")).cast("int").alias("side"), F.lit(0).alias("lead"))


def within_blocks(dealt: DataFrame, sets: DataFrame, weight, percent: int) -> DataFrame:
    """(a, b): the links of blocks dealt by ``chunked`` or ``paired`` between
    sets of different parts."""
    def grouped(batches):
        """(block, the other columns of its rows), one block after another."""
        block, held = None, []
        for b in common.batches(batches):
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if row[0] != block:
                    if len(held) > 1:
                        yield block, held
                    block, held = row[0], []
                held.append(row[1:])
        if len(held) > 1:
            yield block, held

    def sieve(batches):
        out = []
        schema = pa.schema([("block", pa.int64()), ("side", pa.int32()), ("lead", pa.int32()), ("id", pa.int64())])
        for block, held in grouped(batches):
            side, lead, name, part, n, sk = zip(*held)
            good = may_link(np.array(n, np.int64), [np.frombuffer(x, np.uint8) for x in sk], np.array(side),
                            np.array(part), percent)
            out += [(block, side[i], lead[i], name[i]) for i in np.flatnonzero(good).tolist()]
            if len(out) > 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)

    def join(batches):
        found = []

        def pairs():
            batch = pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.binary()),
                                                pa.array([f[1] for f in found], pa.binary())], names=["a", "b"])
            found.clear()
            return batch
        for _, held in grouped(batches):
            # leading sets first: the stars of a block's chunks share centres
            held.sort(key=lambda h: (-h[1], h[2]))
            own = [np.frombuffer(h[3], "<u8") for h in held]
            for a, b in block_links(own, [h[0] for h in held], weight, percent):
                found.append((held[a][2], held[b][2]))
            if len(found) > 5000:
                yield pairs()
        yield pairs()
    light = dealt.join(sets.select("id", "n", "sketch"), "id").select("block", "side", "lead", "id", "part", "n", "sketch")
    left = light.repartition("block").sortWithinPartitions("block").mapInArrow(sieve, "block long, side int, lead int, id long")
    whole = left.join(sets.select("id", "sig", "tokens"), "id").select("block", "side", "lead", "sig", "tokens")
    return common.store(whole.repartition("block").sortWithinPartitions("block")
                        .mapInArrow(join, "a binary, b binary"), "shingle-links")


def links(sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): links between classes, enough of them to connect what is linked.

    In the first ROUNDS rounds every set goes to one block only, that of its
    least shingle by the round's hash: similar sets mostly choose the same one,
    so most of a family is connected at the cost of one copy of each set. Then
    go all blocks whose members are not all connected yet."""
    counts = rarity(sets)
    weight = lambda tokens: slot_counts(counts)[_slot(tokens)]
    rows = blocks(sets, weight, percent).select("id", "token")
    found = None
    for turn in range(ROUNDS + 1):
        if found is None:
            open_ = rows.withColumn("part", F.col("id"))
        else:
            if turn < ROUNDS:
                # links go from a set to the first of its block's component, so
                # sets with one root are connected (the reverse need not hold)
                known = found.groupBy(F.col("a").alias("sig")).agg(F.min("b").alias("root"))
            else:
                # a large family's stars of the rounds overlap: as one component
                # its blocks are closed, as several parts each would go again
                known = graph.components(found, "a", "b").withColumnRenamed("node", "sig")
            part = sets.select("id", "sig").join(known, "sig", "left") \
                .select("id", F.xxhash64(F.coalesce("root", "sig")).alias("part"))
            open_ = rows.join(part, "id")
            apart = open_.groupBy("token").agg(F.min("part").alias("lo"), F.max("part").alias("hi")) \
                .where("lo < hi").select("token")
            open_ = open_.join(apart, "token")
        if turn < ROUNDS:
            open_ = open_.groupBy("id").agg(
                F.min(F.struct(F.xxhash64(F.lit(turn), "token").alias("h"), "token")).alias("t"),
                F.first("part").alias("part")).select("id", "t.token", "part")
        dealt = chunked(open_) if turn < ROUNDS else paired(open_)
        more = within_blocks(dealt, sets, weight, percent)
        found = more if found is None else found.union(more)
    return found


def jaccard_components(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS,
                       percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable by
    links) and class_id (the set's name, null if empty) of every document."""
    common.prepare(docs.sparkSession)
    light = classes(docs, id_col, text_col, words)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    candidates = candidate_sets(docs, light, id_col, text_col, words, percent, parts)
    with common.bucketed(candidates, "shingle-sets", "id", parts) as sets:
        found = links(sets, percent)
    roots = graph.components(found, "a", "b")
    firsts = light.where(F.col("sig").isNotNull()).groupBy("sig").agg(F.min("doc_id").alias("least"))
    named = firsts.join(roots.select(F.col("node").alias("sig"), "root"), "sig", "left") \
        .withColumn("root", F.coalesce("root", "sig"))
    top = named.groupBy("root").agg(F.min("least").alias("component_id"))
    per_class = named.join(top, "root").select("sig", "component_id")
    return light.join(per_class, "sig", "left").select(
        "doc_id", F.col("n").cast("long").alias("n_shingles"),
        F.coalesce("component_id", "doc_id").alias("component_id"), F.hex("sig").alias("class_id"))


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 5,
             percent: int = 80) -> DataFrame:
    """``docs`` with one row of each component, the one with the smallest id (no
    id comes last; then the smallest text hash); all columns stay. Decisions go
    by row, told by id and text: texts that are linked to nothing stay, whatever
    rows share their ids, and of equal rows that were to stay one stays. Rows
    without words are linked to nothing and stay."""
    common.prepare(docs.sparkSession)
    body, key = common.text_or_empty(text_col), F.col(id_col).cast("long")
    # ids that no two texts share, so that the join's rows are told apart
    row = F.xxhash64(key.isNull(), key, body)
    named = docs.select(row.alias("doc_id"), body.alias("body"))
    # only the texts' hashes and their classes are kept of the join
    group = jaccard_components(named, id_col="doc_id", text_col="body", words=words, percent=percent) \
        .where(F.col("class_id").isNotNull()).select(F.col("doc_id").alias("row__"), F.col("component_id").alias("group__"))
    group = common.store(group.distinct(), "components")
    rank = F.struct(key.isNull().alias("none"), key.alias("id"), F.xxhash64(body).alias("text"), row.alias("row"))
    ranks = docs.select(row.alias("row__"), rank.alias("rank__")).distinct()
    first = ranks.join(group, "row__").groupBy("group__").agg(F.min("rank__").alias("first__"))
    gone = group.join(first.select("group__", F.col("first__.row").alias("stays__")), "group__") \
        .where(F.col("row__") != F.col("stays__")).select("row__")
    # only rows that a bitmap of what goes shows are shuffled with their texts
    gone = common.store(gone, "gone-rows")
    shown_by = bloom(gone.select(F.col("row__").alias("key")))

    @F.pandas_udf("boolean")
    def shown_gone(key: pd.Series) -> pd.Series:
        seen, at = bitmap(shown_by), key.to_numpy() % BLOOM_BITS
        return pd.Series((seen[at >> 3] >> (at & 7) & 1).astype(bool))
    marked = docs.withColumn("row__", row).withColumn("seen__", shown_gone("row__"))
    left = marked.where("NOT seen__").drop("seen__") \
        .unionByName(marked.where("seen__").drop("seen__").join(gone, "row__", "left_anti"))
    again = common.store(docs.select(row.alias("row__")).join(group.select("row__"), "row__", "left_semi").groupBy("row__")
                         .count().where("count > 1").select("row__"), "repeated-rows")
    if again.isEmpty():
        return left.drop("row__")
    once = left.join(again, "row__", "left_semi").groupBy("row__").agg(F.first(F.struct(*docs.columns)).alias("kept__"))
    return left.join(again, "row__", "left_anti").drop("row__").unionByName(once.select("kept__.*"))
