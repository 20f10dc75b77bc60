"""Operator 11: collocations mined from FM-indexes over word ids, one per shard.

A shard is a run of pieces of one language, as word ids with 0 between pieces.
Its index holds the Burrows-Wheeler transform of the text and that of the text
reversed (both in the order of the first DEPTH words, which is all that
patterns of DEPTH words ask for). A pattern is a pair of intervals of the same
width, one in each. Extending it to the left splits the first interval by the
word before, extending it to the right splits the second by the word behind;
the other interval follows by counting the smaller words. The width is the
pattern's count.

Only what can still count is extended, level by level over all shards:

1. words: counts per language are summed over the shards; those with fewer than
   ``least`` occurrences cannot be part of a candidate;
2. pairs: each shard extends its frequent words to the left by frequent words;
   counts are summed, and the frequent pairs go back to the shards with them;
3. triples: each shard extends its frequent pairs to the right; those whose
   last two words are a frequent pair are emitted and summed.

So a phrase with ``least`` occurrences is never lost, and no task or broadcast
holds more than the words and pairs of one shard. Shard indexes are files in
the shared folder; a task that is tried again writes the same file again.

Defined cases: a null text counts as empty; a null language reads ``und``;
repeated rows and ids count each time; an empty table gives an empty result.
Words are told apart by a 64-bit hash within a shard. Only the language and
text columns are read, so further columns of any name do no harm."""
from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkbook.llm import common, wordscan

DEPTH = 3
LEAST = 10
TOP = 2000
#: A longer candidate takes a phrase's place when it holds this part of it.
COVER_PERCENT = 50
#: Words of a shard: bounds the memory of a task.
SHARD_WORDS = 1 << 21
#: Rows of one Arrow batch of counts.
ROWS = 1 << 16
# Bytes that end a piece, and those that end a word.
PIECE_END = np.zeros(256, bool)
PIECE_END[[ord(c) for c in ".,;:!?\n\v\f\r"]] = True
WORD_END = PIECE_END.copy()
WORD_END[[0x20, 0x09]] = True


# ------------------------------------------------------------- the FM-index
def transform(text: np.ndarray, symbols: int) -> np.ndarray:
    """The word before each suffix of ``text`` (circular), suffixes in the
    order of their first DEPTH words and then of their places."""
    ahead = [np.roll(text, -d) for d in range(DEPTH)]
    if symbols ** DEPTH < 1 << 64:
        key = np.zeros(len(text), np.uint64)
        for x in ahead:
            key = key * np.uint64(symbols) + x.astype(np.uint64)
        order = np.argsort(key, kind="stable")
    else:
        order = np.lexsort(ahead[::-1])
    return text[order - 1]


class Index:
    """Both transforms of a shard and the words' counts."""

    def __init__(self, forward: np.ndarray, backward: np.ndarray, symbols: int):
        self.forward, self.backward, self.symbols = forward, backward, symbols
        self.first = np.zeros(symbols + 1, np.int64)
        np.cumsum(np.bincount(forward, minlength=symbols), out=self.first[1:])

    @classmethod
    def of(cls, text: np.ndarray, symbols: int) -> "Index":
        """``text`` starts and ends with 0."""
        return cls(transform(text, symbols), transform(text[::-1], symbols), symbols)

    def words(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place forward, place backward, width) of one-word patterns."""
        lo = self.first[ids]
        return lo, lo, self.first[ids + 1] - lo

    def extend(self, lo, other, width, *, left: bool, allowed: np.ndarray, deeper: bool = False):
        """Every extension of patterns by one word that ``allowed`` flags, to
        the left (``lo`` are places forward) or to the right (backward):
        (pattern, word, place in the other index, width), with ``deeper`` also
        the place in the index that is extended."""
        bwt = self.forward if left else self.backward
        # the word beside every occurrence, pattern by pattern
        pattern = np.repeat(np.arange(len(lo)), width)
        at = np.arange(len(pattern)) + np.repeat(lo - np.cumsum(width) + width, width)
        key = pattern * self.symbols + bwt[at]
        order = np.argsort(key, kind="stable")
        key = key[order]
        head = np.flatnonzero(np.append(True, key[1:] != key[:-1])[:len(key)])
        n = np.diff(np.append(head, len(key)))
        pattern, word = key[head] // self.symbols, key[head] % self.symbols
        # in the other index, the occurrences beside smaller words come first
        before = np.cumsum(n) - n
        fresh = np.append(True, pattern[1:] != pattern[:-1])[:len(pattern)]
        smaller = before - np.maximum.accumulate(np.where(fresh, before, 0))
        keep = allowed[word]
        out = pattern[keep], word[keep], (other[pattern] + smaller)[keep], n[keep]
        if deeper:
            out += (self.first[word[keep]] + self._rank(bwt)[at[order[head[keep]]]],)
        return out

    def _rank(self, bwt: np.ndarray) -> np.ndarray:
        """How often the word at each place of a transform occurs before it."""
        order = np.argsort(bwt, kind="stable")
        ranks = np.empty(len(bwt), np.int64)
        ranks[order] = np.arange(len(bwt)) - self.first[bwt[order]]
        return ranks

    # ---- the file
    def dump(self) -> bytes:
        codec = pa.Codec("zstd")
        parts = [bytes(codec.compress(a.astype("<u4").tobytes())) for a in (self.forward, self.backward)]
        return struct.pack("<QQQQ", len(self.forward), self.symbols, *map(len, parts)) + b"".join(parts)

    @classmethod
    def load(cls, data: bytes) -> "Index":
        n, symbols, a, b = struct.unpack_from("<QQQQ", data)
        codec = pa.Codec("zstd")
        parts = [np.frombuffer(codec.decompress(data[lo:lo + size], n * 4), "<u4").astype(np.int64)
                 for lo, size in ((32, a), (32 + a, b))]
        return cls(*parts, symbols)


def pairs(index: Index, frequent: np.ndarray):
    """Patterns of two frequent words: (left, right, place backward, width)."""
    ids = np.flatnonzero(frequent)
    i, left, back, n = index.extend(*index.words(ids), left=True, allowed=frequent)
    return left, ids[i], back, n


def triples(index: Index, frequent: np.ndarray, pair_keys: np.ndarray):
    """Patterns of three words whose two pairs are both in ``pair_keys``
    (sorted, left * symbols + right): (first, second, third, width)."""
    left, right, back, n = pairs(index, frequent)
    keep = _among(left * index.symbols + right, pair_keys)
    left, right, back, n = left[keep], right[keep], back[keep], n[keep]
    # the last step asks for no places, so those forward are not followed
    i, third, _, n = index.extend(back, back, n, left=False, allowed=frequent)
    keep = _among(right[i] * index.symbols + third, pair_keys)
    return left[i][keep], right[i][keep], third[keep], n[keep]


def _among(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(table, values), len(table) - 1)
    return table[at] == values


# ---------------------------------------------------------------- the shards
class Shard:
    """Pieces of one language as hashes of words (0 between pieces), with the
    text of every hash."""

    def __init__(self):
        self.parts, self.size, self.names = [], 0, {}

    def add(self, words: wordscan.Words, hashes: np.ndarray, breaks: np.ndarray, which: np.ndarray) -> None:
        """Words numbered ``which``; ``breaks`` flags those that start a piece."""
        if not len(which):
            return
        h, cut = hashes[which], breaks[which]
        out = np.zeros(len(h) + int(cut.sum()), np.uint64)
        out[np.arange(len(h)) + np.cumsum(cut)] = h
        self.parts.append(out)
        self.size += len(h)
        seen, first = np.unique(h, return_index=True)
        for k, i in zip(seen.tolist(), which[first].tolist()):
            if k not in self.names:
                self.names[k] = words.data[words.start[i]:words.end[i]].tobytes()

    def index(self) -> tuple[Index, list[str], np.ndarray]:
        """The FM-index, the words by id (from 1) and their counts."""
        text = np.concatenate([*self.parts, np.zeros(1, np.uint64)])
        symbols, ids = np.unique(text, return_inverse=True)  # 0 comes first
        index = Index.of(ids.reshape(-1), len(symbols))
        names = [self.names[h].decode("utf-8", "replace") for h in symbols[1:].tolist()]
        return index, names, np.diff(index.first)[1:]


def shards_of(rows, size: int):
    """(language, Shard) of batches (lang, body). The shards held at a time
    have about ``size`` words together; a shard ends where a piece ends."""
    held: dict[str, Shard] = {}
    for b in common.batches(rows):
        codes = b.column(0).dictionary_encode()
        langs, code = codes.dictionary.to_pylist(), codes.indices.to_numpy(zero_copy_only=False)
        last = None  # (row, did its piece end) of the scan's last word
        for w in wordscan.scan(b.column(1), WORD_END, wordscan.LOWER):
            if not len(w.row):
                if last is not None and PIECE_END[w.data].any():
                    last = last[0], True
                continue
            ends = np.append(0, np.cumsum(PIECE_END[w.data]))
            breaks = np.ones(len(w.row), np.int64)
            breaks[1:] = (w.row[1:] != w.row[:-1]) | (ends[w.start[1:]] != ends[w.end[:-1]])
            if last is not None and last[0] == w.row[0]:
                breaks[0] = last[1] or ends[w.start[0]] > 0
            last = w.row[-1], bool(ends[-1] != ends[w.end[-1]])
            hashes, of = np.maximum(w.hashes(), np.uint64(1)), code[w.row]
            # what goes on from the words before belongs to their shard
            lead = int(breaks.argmax()) if breaks.any() else len(breaks)
            if lead:
                held[langs[of[0]]].add(w, hashes, breaks, np.arange(lead))
            while lead < len(breaks) and held and sum(s.size for s in held.values()) >= size:
                lang = max(held, key=lambda k: (held[k].size, k))
                yield lang, held.pop(lang)
            for c in np.unique(of[lead:]).tolist():
                held.setdefault(langs[c], Shard()).add(w, hashes, breaks, np.flatnonzero(of[lead:] == c) + lead)
    for lang in sorted(held):
        yield lang, held[lang]


def build_shards(docs: DataFrame, folder: str, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """One row per word of each shard: shard, lang, local (its id there), word,
    n; the shards' indexes are files of ``folder``."""
    size = SHARD_WORDS

    def build(rows):
        task = TaskContext.get().partitionId()
        for k, (lang, shard) in enumerate(shards_of(rows, size)):
            number = (task << 24) + k
            index, names, counts = shard.index()
            common.write_atomically(folder, f"shard-{number}.fm", lambda out: out.write(index.dump()))
            yield from _emit(("shard", "lang", "local", "word", "n"), np.full(len(names), number),
                             np.full(len(names), lang, object), np.arange(1, len(names) + 1),
                             np.array(names, object), counts)

    slim = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"),
                       common.text_or_empty(text_col).alias("body"))
    return common.store(slim.mapInArrow(build, "shard long, lang string, local long, word string, n long"),
                        "collocation-words")


def vocabulary(words: DataFrame, least: int) -> DataFrame:
    """Words with ``least`` occurrences in their language, stored: lang, word,
    f, gid (numbers from 0 without gaps)."""
    made = words.groupBy("lang", "word").agg(F.sum("n").alias("f")).filter(F.col("f") >= least)
    made = common.store(made.withColumn("mark", F.monotonically_increasing_id()), "collocation-vocabulary")
    part = F.shiftright("mark", 33)
    sizes = made.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("k"))
    # one row per partition that wrote the table
    ahead = sizes.select("part", (F.sum("k").over(Window.orderBy("part")) - F.col("k")).alias("ahead"))
    return made.join(F.broadcast(ahead), part == F.col("part")).select(
        "lang", "word", "f", (F.col("ahead") + F.col("mark").bitwiseAND((1 << 33) - 1)).alias("gid"))


def _load(folder: str, shard: int) -> Index:
    fsys, path = common.filesystem(folder)
    with fsys.open_input_file(f"{path}/shard-{shard}.fm") as f:
        return Index.load(f.read())


def _frequent(index: Index, local, gid) -> tuple[np.ndarray, np.ndarray]:
    """(global number of every local word, which are frequent)."""
    numbers, flags = np.zeros(index.symbols, np.int64), np.zeros(index.symbols, bool)
    local = np.asarray(local, np.int64)
    numbers[local], flags[local] = np.asarray(gid, np.int64), True
    return numbers, flags


def _emit(names, *columns):
    for lo in range(0, len(columns[0]), ROWS):
        yield pa.RecordBatch.from_arrays([pa.array(c[lo:lo + ROWS]) for c in columns], names=list(names))


def count_pairs(shards: DataFrame, folder: str) -> DataFrame:
    """(shard, pair, n) from ``shards`` (shard, known: its frequent words);
    ``pair`` is the two words' numbers in one long."""
    def run(rows):
        for b in rows:
            for shard, known in zip(b.column(0).to_pylist(), b.column(1)):
                index = _load(folder, shard)
                number, flags = _frequent(index, known.values.field("local"), known.values.field("gid"))
                left, right, _, n = pairs(index, flags)
                key = (number[left] << 31) | number[right]
                order = np.argsort(key)
                yield from _emit(("shard", "pair", "n"), np.full(len(key), shard), key[order], n[order])

    return shards.select("shard", "known").mapInArrow(run, "shard long, pair long, n long")


def count_triples(shards: DataFrame, folder: str) -> DataFrame:
    """(pair, third, n): ``pair`` the first two words, from ``shards`` (shard,
    known, pairs: its frequent pairs)."""
    def run(rows):
        for b in rows:
            for shard, known, held in zip(b.column(0).to_pylist(), b.column(1), b.column(2)):
                index = _load(folder, shard)
                local, gid = np.asarray(known.values.field("local")), np.asarray(known.values.field("gid"))
                number, flags = _frequent(index, local, gid)
                order = np.argsort(gid)
                key = np.asarray(held.values, np.int64)
                low = (1 << 31) - 1
                back = [local[order][np.searchsorted(gid[order], x)] for x in (key >> 31, key & low)]
                first, second, third, n = triples(index, flags, np.sort(back[0] * index.symbols + back[1]))
                key = (number[first] << 31) | number[second]
                order = np.argsort(key, kind="stable")
                yield from _emit(("pair", "third", "n"), key[order], number[third][order], n[order])

    return shards.select("shard", "known", "pairs").mapInArrow(run, "pair long, third long, n long")


# ------------------------------------------------------------- the candidates
def _whole_score(a: str, l: str, r: str) -> Column:
    """floor(1000000 * a * a / (l * r)), in whole numbers of up to 38 digits."""
    d = [f"cast({x} as decimal(18,0))" for x in (a, l, r)]
    return F.expr(f"(cast(1000000 as decimal(7,0)) * ({d[0]} * {d[0]})) div ({d[1]} * {d[2]})")


def collocations(docs: DataFrame, *, lang_col: str = "lang", text_col: str = "text", least: int = LEAST,
                 top: int = TOP) -> DataFrame:
    """Each language's first ``top`` phrases of two and three words: lang,
    rank, phrase, a, l, r, n, score."""
    spark = docs.sparkSession
    folder = common.scratch(spark, "collocation-shards")
    words = build_shards(docs, folder, lang_col, text_col)
    vocab = common.store(vocabulary(words, least), "collocation-ids")

    known = words.join(vocab, ["lang", "word"]).groupBy("shard") \
        .agg(F.collect_list(F.struct("local", "gid")).alias("known"))
    known = common.store(known, "collocation-known")
    # pairs meet once: their sum over the shards stands beside each shard's own
    whole = F.sum("n").over(Window.partitionBy("pair")).alias("f")
    found = common.store(count_pairs(known, folder).select("shard", "pair", whole).filter(F.col("f") >= least),
                         "collocation-pairs")
    held = found.groupBy("shard").agg(F.collect_list("pair").alias("pairs"))
    three = count_triples(known.join(held, "shard"), folder).groupBy("pair", "third").agg(F.sum("n").alias("a"))
    three = common.store(three.filter(F.col("a") >= least), "collocation-triples")
    two = found.groupBy("pair").agg(F.max("f").alias("a"))

    low = (1 << 31) - 1
    head, tail = F.shiftright("pair", 31), F.col("pair").bitwiseAND(low)

    def word(i, key):
        return vocab.select(F.col("gid").alias(key), F.col("word").alias(f"w{i}"), F.col("f").alias(f"f{i}"),
                            *(["lang"] if i == 1 else []))

    first = two.select("pair", "a", head.alias("g1"), tail.alias("g2")).join(word(1, "g1"), "g1").join(word(2, "g2"), "g2")
    longer = three.select("a", F.explode(F.array("pair", F.shiftleft(tail, 31).bitwiseOR(F.col("third")))).alias("pair")) \
        .groupBy("pair").agg(F.max("a").alias("longer"))
    first = first.join(longer, "pair", "left") \
        .filter(F.coalesce(F.col("longer") * 100 < F.col("a") * COVER_PERCENT, F.lit(True))) \
        .select("lang", F.concat_ws(" ", "w1", "w2").alias("phrase"), "a", F.col("f1").alias("l"), F.col("f2").alias("r"),
                _whole_score("a", "f1", "f2").alias("score"))

    rest = F.shiftleft(tail, 31).bitwiseOR(F.col("third"))
    second = three.select("pair", "a", head.alias("g1"), tail.alias("g2"), F.col("third").alias("g3"), rest.alias("rest")) \
        .join(two.select("pair", F.col("a").alias("f12")), "pair") \
        .join(two.select(F.col("pair").alias("rest"), F.col("a").alias("f23")), "rest") \
        .join(word(1, "g1"), "g1").join(word(2, "g2"), "g2").join(word(3, "g3"), "g3") \
        .withColumns({"s1": _whole_score("a", "f1", "f23"), "s2": _whole_score("a", "f12", "f3")})
    one = F.col("s1") <= F.col("s2")
    second = second.select("lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), "a",
                           F.when(one, F.col("f1")).otherwise(F.col("f12")).alias("l"),
                           F.when(one, F.col("f23")).otherwise(F.col("f3")).alias("r"),
                           F.least("s1", "s2").alias("score"))

    place = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc())
    best = first.unionByName(second).withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= top)
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    return best.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r",
                                            "n", "score")
