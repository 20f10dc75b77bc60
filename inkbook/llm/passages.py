"""Operator 12: repeated passages, by suffix trees partitioned by prefixes.

A window is WINDOW consecutive words. A window whose words also start earlier
(order: id, hash of the text, place) is repeated, and all its words go.

1. **Prefixes.** Each window has an anchor: its least run of ANCHOR words (by
   hash), so equal windows have equal anchors. Anchors are the prefixes that
   split the windows into groups. A unit is a run of windows with one anchor in
   one place; of equal units only the first occurrence stays live, since every
   window of the others starts earlier too (a batch of texts drops its own equal
   units before they are shuffled). A prefix with one live unit has no other
   repeat below it and is done. A prefix with more than ``heavy`` live units is
   made longer, up to all the words of the window.
2. **Subtrees.** A group fits a task's memory. Its windows' suffixes are sorted
   by doubling, neighbours' common prefixes are measured, and an internal node
   of depth WINDOW or more holds the occurrences of one repeat: all leaves but
   the earliest are repeated. At full length a node is one key, whose earliest
   leaf is an aggregate; what is not that leaf is repeated.
3. Texts without windows in groups are done at once; the others meet the repeats
   found in them.

Only units (one row for some eight words), the texts, and the words of live
units in groups are shuffled.

Defined cases: a null text counts as empty; fewer than WINDOW words are never
removed; null ids come after all others; rows that share an id but not the text
are documents of their own, in the order of a hash of the text; rows with equal
id and text are one document and get the same result; an empty table gives an
empty result. Words and windows are compared by 64-bit hashes of their words.
Only the id and text columns are read, so further columns of any name do no
harm."""
from __future__ import annotations

import hashlib
import struct

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkbook.llm import common, wordscan

WINDOW = 20
ANCHOR = 6
#: Live units of a prefix that make one group of a task at most.
HEAVY = 4096
#: Words of the groups that a task sorts at once.
TREE_WORDS = 1 << 18
LAST = (1 << 63) - 1


# -------------------------------------------------------- words and windows
class Texts:
    """Words, windows and anchors of the texts of a batch."""

    def __init__(self, col: pa.Array, window: int):
        offsets, self.raw = common.text_buffers(col)
        pieces = list(wordscan.scan(col, wordscan.WHITE))

        def cat(parts, kind=np.int64):
            return np.concatenate([*parts, np.zeros(0, kind)]).astype(kind, copy=False)
        self.row = cat([w.row for w in pieces])
        self.start = cat([w.start + w.base for w in pieces])
        self.end = cat([w.end + w.base for w in pieces])
        self.hash = cat([w.hashes() for w in pieces], np.uint64)
        #: first word of each row
        self.first = np.searchsorted(self.row, np.arange(len(col) + 1))
        self.window = window
        n, size = len(self.hash), max(0, len(self.hash) - window + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(self.hash * common._pow(common._P, n), out=sums[1:])
        self._sums = sums
        self.valid = self.row[:size] == self.row[window - 1:]
        self.windows = self.run(np.arange(size), window)
        # anchors: least hash of a run of words, the first of equal ones
        grams = max(0, n - ANCHOR + 1)
        self.gram = self.run(np.arange(grams), ANCHOR)
        key = (self.gram >> np.uint64(32) << np.uint64(32)) | np.arange(grams, dtype=np.uint64)
        span, have = window - ANCHOR + 1, 1
        while size and have < span:
            step = min(have, span - have)
            key = np.minimum(key[:len(key) - step], key[step:])
            have += step
        self.anchor = (key[:size] & np.uint64(0xFFFFFFFF)).astype(np.int64)

    def run(self, at: np.ndarray, words) -> np.ndarray:
        """Hashes of runs of words."""
        return common.mix((self._sums[at + words] - self._sums[at]) * common._pow(common._PINV, len(self.hash) + 1)[at])

    def units(self):
        """(first window, windows) of every run of windows with one anchor."""
        at = np.flatnonzero(self.valid)
        fresh = np.append(True, (self.row[at[1:]] != self.row[at[:-1]]) | (self.anchor[at[1:]] != self.anchor[at[:-1]]))
        head = np.flatnonzero(fresh[:len(at)])
        return at[head], np.diff(np.append(head, len(at)))

    def kept(self, gone: np.ndarray) -> tuple[np.ndarray, list[str]]:
        """Per row: words removed, and the SHA-256 of the others joined by one
        space; ``gone`` flags words."""
        rows = len(self.first) - 1
        removed = np.bincount(self.row, gone, rows).astype(np.int64) if rows else np.zeros(0, np.int64)
        keep = np.flatnonzero(~gone)
        text, start, end = wordscan.joined(wordscan.Words(self.raw, self.row[keep], self.start[keep], self.end[keep]))
        view, first = memoryview(text), np.searchsorted(self.row[keep], np.arange(rows + 1)).tolist()
        none = hashlib.sha256(b"").hexdigest()
        return removed, [none if a == b else hashlib.sha256(view[start[a]:end[b - 1]]).hexdigest()
                         for a, b in zip(first, first[1:])]

    def covered(self, gone_windows: np.ndarray) -> np.ndarray:
        """Flags of the words that the flagged windows cover."""
        edge = np.zeros(len(self.hash) + 1, np.int64)
        at = np.flatnonzero(gone_windows)
        np.add.at(edge, at, 1)
        np.add.at(edge, at + self.window, -1)
        return np.cumsum(edge[:-1]) > 0


def _bits(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


def _flags(bits: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(bits, np.uint8), count=n).astype(bool)


def _packed(text: str) -> bytes:
    data = text.encode()
    return struct.pack("<Q", len(data)) + bytes(pa.Codec("zstd").compress(data))


def _unpacked(col: pa.Array) -> pa.Array:
    codec = pa.Codec("zstd")
    return pa.array([bytes(codec.decompress(x[8:], struct.unpack_from("<Q", x)[0])).decode() for x in col.to_pylist()],
                    pa.large_string())


# ----------------------------------------------------------------- subtrees
def subtree(words: np.ndarray, sizes: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix tree of segments (``words`` in a row, of ``sizes``), as the sorted
    suffixes and the depths at which neighbours part: (places of the suffixes
    that hold a window, number of the node of depth ``window`` or more above
    each; leaves of one node hold the same window)."""
    ends = np.cumsum(sizes)
    left = np.repeat(ends, sizes) - np.arange(len(words))  # words up to the segment's end
    at = np.flatnonzero(left >= window)
    ranks, size = {1: np.unique(words, return_inverse=True)[1].reshape(-1)}, 1
    while size * 2 <= window:
        r = ranks[size]
        behind = np.append(r[size:], np.zeros(min(size, len(r)), r.dtype))
        ranks[size * 2] = np.unique(r * (int(r.max(initial=0)) + 1) + behind, return_inverse=True)[1].reshape(-1)
        size *= 2
    order = at[np.lexsort([ranks[size][at + window - size], ranks[size][at]])]
    a, b = order[:-1], order[1:]
    depth, step = np.zeros(len(a), np.int64), size
    most = np.minimum(left[a], left[b])
    while step:
        for _ in range(2 if step == size else 1):  # depths up to 2 * window - 1 are told apart
            x, y = np.minimum(a + depth, len(words) - 1), np.minimum(b + depth, len(words) - 1)
            depth += step * ((ranks[step][x] == ranks[step][y]) & (depth + step <= most))
        step //= 2
    node = np.cumsum(np.append(True, depth < window)[:len(order)])
    return order, node


def repeats(table: pa.Table, window: int) -> pa.RecordBatch:
    """(id, dh, start) of the windows of some whole groups that start earlier."""
    segments = table.column("words").to_pylist()
    words = np.frombuffer(b"".join(segments), np.uint64)
    sizes = np.array([len(x) // 8 for x in segments], np.int64)
    place, node = subtree(words, sizes, window)
    segment = np.repeat(np.arange(len(sizes)), sizes)[place]
    offset = place - (np.cumsum(sizes) - sizes)[segment]
    doc, text, start = (table.column(c).to_numpy()[segment] for c in ("id", "dh", "start"))
    start = start + offset
    order = np.lexsort([start, text, doc, node])
    doc, text, start, node = (x[order] for x in (doc, text, start, node))
    fresh = np.append(True, node[1:] != node[:-1])[:len(node)]
    head = np.flatnonzero(fresh)[np.cumsum(fresh) - 1] if len(node) else node
    late = (doc != doc[head]) | (text != text[head]) | (start != start[head])
    return pa.RecordBatch.from_arrays([pa.array(x[late]) for x in (doc, text, start)], names=["id", "dh", "start"])


def _whole_groups(rows, limit: int):
    """Tables of whole groups (rows arrive sorted by ``gram``) of about
    ``limit`` words or more."""
    held, size = [], 0
    for b in rows:
        b = pa.Table.from_batches([b])
        if not b.num_rows:
            continue
        gram = b.column("gram").to_numpy()
        # the last group may go on in the next batch
        cut = int(np.searchsorted(gram, gram[-1]))
        if size >= limit and held:
            if held[-1].column("gram")[-1].as_py() != gram[0]:
                yield pa.concat_tables(held)
                held, size = [b], b.nbytes // 8
                continue
            if cut:
                yield pa.concat_tables([*held, b.slice(0, cut)])
                held, size = [b.slice(cut)], b.slice(cut).nbytes // 8
                continue
        held.append(b)
        size += b.nbytes // 8
    if held:
        yield pa.concat_tables(held)


# --------------------------------------------------------------- the corpus
def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    body = common.text_or_empty(text_col)
    doc_id = F.col(id_col).cast("long")
    return docs.select(doc_id.alias("doc_id"), F.coalesce(doc_id, F.lit(LAST)).alias("id"),
                       F.xxhash64(body).alias("dh"), body.alias("body"))


def find_units(texts: DataFrame, window: int) -> DataFrame:
    """Units of all texts: gram (their anchor), unit (hash), id, dh, start, n;
    the first of equal ones of a batch."""
    def run(rows):
        for b in common.batches(rows):
            t = Texts(b.column(2), window)
            at, n = t.units()
            row = t.row[at]
            gram = t.gram[t.anchor[at]].astype(np.int64)
            unit = t.run(at, n + window - 1).astype(np.int64)
            doc, text = (b.column(i).to_numpy()[row] for i in (0, 1))
            start = at - t.first[row]
            order = np.lexsort([start, text, doc, unit])
            order = order[np.append(True, unit[order[1:]] != unit[order[:-1]])[:len(order)]]
            # back to the order of the texts, in which ids lie side by side
            order.sort()
            yield pa.RecordBatch.from_arrays(
                [pa.array(x[order]) for x in (gram, unit, doc, text)]
                + [pa.array(x[order].astype(np.int32)) for x in (start, n)],
                names=["gram", "unit", "id", "dh", "start", "n"])

    return texts.select("id", "dh", "body").mapInArrow(
        run, "gram long, unit long, id long, dh long, start int, n int")


_PARTS = ("kind int, id long, dh long, doc_id long, n_words long, n_removed long, kept_sha256 string, body binary, "
          "gone binary, heavy binary, gram long, start long, words binary")
DONE, OPEN, SEGMENT, FULL = range(4)


def split(texts: DataFrame, window: int) -> DataFrame:
    """What the live units say of each text (``units``: its live ones; ``kind``
    0: alone with their prefix, 1: in a group, 2: of long prefixes): DONE texts; OPEN ones, with the windows that are gone
    and those of long prefixes; SEGMENTs of groups; windows of FULL length."""
    names = [p.split()[0] for p in _PARTS.split(", ")]
    types = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    schema = pa.schema([(n, types[p.split()[1]]) for n, p in zip(names, _PARTS.split(", "))])

    def batch(kind, k, **columns):
        return pa.RecordBatch.from_arrays(
            [pa.array([kind] * k, pa.int32()) if f.name == "kind" else
             pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(k, f.type) for f in schema], schema=schema)

    def run(rows):
        for b in common.batches(rows):
            t = Texts(b.column(3), window)
            doc_ids, ids, hashes = (b.column(i).to_pylist() for i in range(3))
            units = b.column(4)
            of = np.repeat(np.arange(b.num_rows), pc.fill_null(pc.list_value_length(units), 0).to_numpy(zero_copy_only=False))
            start, size, sort = (units.flatten().field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3))
            lo = t.first[of] + start
            hi = lo + size
            edge = np.zeros((2, len(t.valid) + 1), np.int64)
            for k, which in ((0, sort >= 0), (1, sort == 2)):
                np.add.at(edge[k], lo[which], 1)
                np.add.at(edge[k], hi[which], -1)
            live, heavy = np.cumsum(edge, 1)[:, :-1] > 0
            gone = t.valid & ~live
            is_open = np.bincount(of, sort > 0, b.num_rows) > 0 if b.num_rows else np.zeros(0, bool)
            grouped = np.flatnonzero(sort == 1)
            grams = t.gram[t.anchor[lo[grouped]]].astype(np.int64)
            segments = list(zip(of[grouped].tolist(), grams.tolist(), lo[grouped].tolist(), (hi[grouped] + window - 1).tolist()))
            full = [(row, p) for row, x, y, s in zip(of.tolist(), lo.tolist(), hi.tolist(), sort.tolist()) if s == 2
                    for p in range(x, y)]
            removed, sums = t.kept(t.covered(gone))
            done = np.flatnonzero(~is_open).tolist()
            n_words = np.diff(t.first)
            yield batch(DONE, len(done), doc_id=[doc_ids[i] for i in done], n_words=n_words[done],
                        n_removed=removed[done], kept_sha256=[sums[i] for i in done])
            wait = np.flatnonzero(is_open).tolist()
            if wait:
                spans = [slice(int(t.first[i]), min(int(t.first[i + 1]), len(gone))) for i in wait]
                yield batch(OPEN, len(wait), id=[ids[i] for i in wait], dh=[hashes[i] for i in wait],
                            doc_id=[doc_ids[i] for i in wait], body=[_packed(x) for x in b.column(3).take(pa.array(wait)).to_pylist()],
                            gone=[_bits(gone[s]) for s in spans], heavy=[_bits(heavy[s]) for s in spans])
            for lo in range(0, len(segments), 4096):
                part = segments[lo:lo + 4096]
                yield batch(SEGMENT, len(part), id=[ids[s[0]] for s in part], dh=[hashes[s[0]] for s in part],
                            gram=[s[1] for s in part], start=[s[2] - int(t.first[s[0]]) for s in part],
                            words=[t.hash[s[2]:s[3]].tobytes() for s in part])
            for lo in range(0, len(full), 1 << 16):
                part = full[lo:lo + (1 << 16)]
                at = np.array([p for _, p in part])
                yield batch(FULL, len(part), id=[ids[r] for r, _ in part], dh=[hashes[r] for r, _ in part],
                            gram=t.windows[at].astype(np.int64), start=[p - int(t.first[r]) for r, p in part])

    return texts.select("doc_id", "id", "dh", "body", "units").mapInArrow(run, _PARTS)


def finish(texts: DataFrame, window: int) -> DataFrame:
    """OPEN texts with the windows found repeated (``late``) and the earliest
    ones of long prefixes (``early``)."""
    def run(rows):
        for b in common.batches(rows):
            t = Texts(_unpacked(b.column(1)), window)
            gone = np.zeros(len(t.valid), bool)
            columns = [b.column(i).to_pylist() for i in range(2, 6)]
            for row, (bits, long_ones, late, early) in enumerate(zip(*columns)):
                base, stop = int(t.first[row]), min(int(t.first[row + 1]), len(gone))
                mine = _flags(bits, stop - base)
                rest = _flags(long_ones, stop - base)
                rest[np.array(early or [], np.int64)] = False
                mine |= rest
                mine[np.array(late or [], np.int64)] = True
                gone[base:stop] = mine
            removed, sums = t.kept(t.covered(gone))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.diff(t.first)), pa.array(removed), pa.array(sums, pa.string())],
                                             names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    return texts.select("doc_id", "body", "gone", "heavy", "late", "early").mapInArrow(
        run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
                   heavy: int = HEAVY) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept_sha256 (of the words that
    stay, joined by one space)."""
    texts = _keyed(docs, id_col, text_col)
    groups = find_units(texts, window).repartition("gram").groupBy("gram", "unit").agg(
        F.min(F.struct("id", "dh", "start", "n")).alias("x"))
    k = F.count(F.lit(1)).over(Window.partitionBy("gram"))
    kind = F.when(k == 1, 0).when(k <= heavy, 1).otherwise(2).cast("byte")
    by_text = groups.select("x.*", kind.alias("kind")).groupBy("id", "dh").agg(
        F.collect_list(F.struct("start", "n", "kind")).alias("units"))
    parts = common.store(split(texts.join(by_text, ["id", "dh"], "left"), window), "passage-parts")

    def part(kind, *columns):
        return parts.filter(F.col("kind") == kind).select(*columns)

    def trees(rows):
        for table in _whole_groups(rows, TREE_WORDS):
            yield repeats(table, window)

    late = part(SEGMENT, "gram", "id", "dh", "start", "words").repartition("gram").sortWithinPartitions("gram") \
        .mapInArrow(trees, "id long, dh long, start long")
    late = late.groupBy("id", "dh").agg(F.collect_list("start").alias("late"))
    early = part(FULL, "gram", "id", "dh", "start").groupBy("gram").agg(F.min(F.struct("id", "dh", "start")).alias("x"))
    early = early.select("x.*").groupBy("id", "dh").agg(F.collect_list("start").alias("early"))
    rest = part(OPEN, "id", "dh", "doc_id", "body", "gone", "heavy") \
        .join(late, ["id", "dh"], "left").join(early, ["id", "dh"], "left")
    result = ["doc_id", "n_words", "n_removed", "kept_sha256"]
    return part(DONE, *result).unionByName(finish(rest, window))
