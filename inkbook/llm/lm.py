"""Operator 7: language-model scoring with a probabilistic suffix tree.

The model predicts a text's words and its end from variable-length contexts.

* Words are counted over all training texts. The OWN most frequent ones are
  symbols of their own; others share a symbol by their last two letters (which
  tell languages and word kinds apart), and inside it a word's share is
  discounted so that unseen words have a proper part.
* The tree's states are contexts of up to three symbols. A context is a
  candidate if it occurs often enough and its suffix is a state; it is kept if
  the divergence of its next-symbol distribution from that of its suffix, times
  its count, beats the cost of its parameters (half a logarithm of the count
  each). The STATES most frequent ones of a level lie in dense tables; all
  others are tried and kept by the same rules as rows of a table.
* A state's distribution is mixed with its suffix's by the number of distinct
  next symbols (Witten-Bell), down to the smoothed frequencies of symbols. All
  are proper distributions.
* A text is scored by its longest suffix state at each word: by the dense
  tables first; where a context outside them may apply, a join on the context
  and its next symbol gives the difference.

What grows with the corpus is counted by Spark: (word, count) pairs and
(context, next symbol) pairs, each first summed within a task. The driver and
the tasks hold tables of fixed size only: counts of the HOT most frequent
words, and the dense tables of symbols. Words beyond these are looked up by a
join on their hash.

Defined cases: a null or empty text is its end alone; a null id counts as the
empty text for the fold (so held out); rows that repeat an id are texts of
their own; without training texts every distribution is uniform; an empty
table gives an empty result. Only the id and text columns are read."""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkbook.llm import common

#: Words whose counts every task holds; symbols; classes of the other words.
HOT, ALPHABET, CLASSES = 1 << 20, 2048, 127
OWN = ALPHABET - CLASSES - 1
#: Contexts of a level in dense tables, symbols of the longest, occurrences of a context.
STATES, DEPTH, LEAST = 2048, 3, 100
#: Distinct (context, next symbol) pairs that a task sums up before it hands them on.
PAIRS = 1 << 20
#: Slots that tell which contexts of three symbols may be states.
SLOTS = 1 << 24
#: Discount of words in a class, and additive smoothing of symbols.
DISCOUNT, ALPHA = 0.5, 0.1
END = 0


def word_classes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Class of each word, 0 .. CLASSES - 1, by its last two (lower-cased) bytes."""
    last = common._LOWER[raw[end - 1]].astype(np.uint64)
    before = np.where(end - start > 1, common._LOWER[raw[np.maximum(end - 2, 0)]], 0).astype(np.uint64)
    return (common.mix(last * np.uint64(256) + before + np.uint64(1)) % np.uint64(CLASSES)).astype(np.int16)


def folded(docs: DataFrame, id_col: str, text_col: str, folds: int = 10) -> DataFrame:
    key = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.crc32(key) % folds == 0).alias("held_out"),
                       common.text_or_empty(text_col).alias("body"))


# ------------------------------------------------------------ word counts
def word_counts(texts: DataFrame) -> DataFrame:
    """word (hash), class, c: counts of the training words."""
    def run(rows):
        for b in common.batches(rows):
            col = b.column(0)
            _, raw = common.text_buffers(col)
            _, h, s, e = common.word_hashes(col, spans=True)
            words, first, n = np.unique(h, return_index=True, return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(words.view(np.int64)), pa.array(word_classes(raw, s, e)[first]), pa.array(n)],
                names=["word", "class", "n"])
    rows = texts.where(~F.col("held_out")).select("body").mapInArrow(run, "word long, class short, n long")
    return common.store(rows.groupBy("word").agg(F.min("class").alias("class"), F.sum("n").alias("c")), "words")


class Words:
    """Counts of the frequent words, symbols, and the classes' totals."""

    def __init__(self, counts: DataFrame, n_docs: int):
        total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
        self.n, self.v = total[0] + n_docs, total[1] + (n_docs > 0)      # with the ends
        self.n_docs = n_docs
        # the frequent words: whole classes of counts, from the top
        rank = F.floor(F.log2(F.col("c").cast("double")) * 64).cast("int")
        room, cut = HOT, None
        for r in counts.groupBy(rank.alias("k")).count().orderBy(F.desc("k")).collect():   # at most 64 * 64 rows
            if r["count"] > room:
                break
            room, cut = room - r["count"], r["k"]
        rows = counts.where(rank >= cut if cut is not None else F.lit(False)).toArrow()
        word = rows["word"].to_numpy().view(np.uint64)
        c, kind = rows["c"].to_numpy(), rows["class"].to_numpy()
        own = np.lexsort((word, -c))[:OWN]
        symbol = kind.astype(np.int16) + 1
        symbol[own] = np.arange(CLASSES + 1, CLASSES + 1 + len(own))
        order = np.argsort(word)
        self.word, self.c, self.symbol = word[order], c[order], symbol[order]
        # the classes' totals: all words less those with a symbol of their own
        sums = {r["class"]: (r["n"], r["v"]) for r in counts.groupBy("class").agg(
            F.sum("c").alias("n"), F.count("*").alias("v")).collect()}                    # CLASSES rows
        self.class_n = np.array([sums.get(k, (0, 0))[0] for k in range(CLASSES)], float)
        self.class_v = np.array([sums.get(k, (0, 0))[1] for k in range(CLASSES)], float)
        np.subtract.at(self.class_n, kind[own], c[own])
        np.subtract.at(self.class_v, kind[own], 1)
        self.symbol_c = np.zeros(ALPHABET)
        self.symbol_c[END] = n_docs
        self.symbol_c[1:CLASSES + 1] = self.class_n
        self.symbol_c[CLASSES + 1:CLASSES + 1 + len(own)] = c[own]

    def base(self, c):
        """log10 of the base model's probability of a word counted c times."""
        return np.log10((c + 0.1) / (self.n + 0.1 * (self.v + 1)))

    def inner(self, c, kind):
        """log10 of a word's share of its class symbol; c = 0: unseen words."""
        n, v = self.class_n[kind], self.class_v[kind]
        unseen = np.where(n > 0, DISCOUNT * v / np.maximum(n, 1), 1.0)
        return np.log10(np.where(c > 0, np.maximum(c - DISCOUNT, DISCOUNT) / np.maximum(n, 1), unseen))


def symbolise(texts: DataFrame, words) -> DataFrame:
    """One row per text: key, doc_id, held_out, n_tokens, n_known, base and
    inner (sums over the frequent words), symbols, tail and tail_class (words
    that are to be looked up). ``words`` is a broadcast ``Words``."""
    def run(rows):
        w, at = words.value, TaskContext.get().partitionId() << 40
        base_hot, inner_hot = w.base(w.c), w.inner(w.c, np.maximum(w.symbol - 1, 0) % CLASSES)
        inner_hot = np.where(w.symbol > CLASSES, 0.0, inner_hot)
        end = w.base(np.array([w.n_docs]))[0]
        for b in common.batches(rows):
            col, n = b.column(2), b.num_rows
            _, raw = common.text_buffers(col)
            row, h, s, e = common.word_hashes(col, spans=True)
            kind = word_classes(raw, s, e)
            distinct, inverse = np.unique(h, return_inverse=True)
            found = np.minimum(np.searchsorted(w.word, distinct), max(len(w.word) - 1, 0))
            known = w.word[found] == distinct if len(w.word) else np.zeros(len(distinct), bool)
            found, hot = found[inverse], known[inverse]
            symbols = (kind + 1).astype(np.uint16)
            symbols[hot] = w.symbol[found[hot]]
            hit = found[hot]
            sums = [np.bincount(row[hot], weights=x, minlength=n).astype(float) for x in (base_hot[hit], inner_hot[hit])]
            count, n_hot = np.bincount(row, minlength=n), np.bincount(row[hot], minlength=n)
            cuts = np.concatenate([[0], np.cumsum(count)])
            tail, tail_kind = h[~hot], kind[~hot]
            tail_cuts = np.concatenate([[0], np.cumsum(count - n_hot)])
            part = lambda x, c: [x[c[i]:c[i + 1]].tobytes() for i in range(n)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(at, at + n)), b.column(0), b.column(1), pa.array(count + 1),
                 pa.array(n_hot + (w.n_docs > 0)), pa.array(sums[0] + end), pa.array(sums[1]),
                 pa.array(part(symbols, cuts), pa.binary()), pa.array(part(tail, tail_cuts), pa.binary()),
                 pa.array(part(tail_kind, tail_cuts), pa.binary())],
                names=["key", "doc_id", "held_out", "n_tokens", "n_known", "base", "inner", "symbols", "tail",
                       "tail_class"])
            at += n
    return common.store(texts.mapInArrow(
        run, "key long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, inner double, "
             "symbols binary, tail binary, tail_class binary"), "symbols")


def tail_sums(texts: DataFrame, counts: DataFrame, words: Words) -> DataFrame:
    """key, n_known, base, inner over the words looked up by a join."""
    def explode(rows):
        for b in rows:
            tails = [np.frombuffer(x, "<i8") for x in b.column(1).to_pylist()]
            kinds = [np.frombuffer(x, "<i2") for x in b.column(2).to_pylist()]
            key = np.repeat(b.column(0).to_numpy(), [len(t) for t in tails])
            for k in range(0, len(key), 200_000):
                sl = slice(k, k + 200_000)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key[sl]), pa.array(np.concatenate(tails)[sl]), pa.array(np.concatenate(kinds)[sl])],
                    names=["key", "word", "kind"])
    rows = texts.select("key", "tail", "tail_class").mapInArrow(explode, "key long, word long, kind short")
    per = rows.groupBy("key", "word").agg(F.count("*").alias("times"), F.first("kind").alias("kind"))
    hit = per.join(counts.select("word", "c"), "word", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    # the same formulas as in Words, in SQL: class totals as literal arrays
    n = F.element_at(F.array(*[F.lit(float(x)) for x in words.class_n]), F.col("kind") + 1)
    v = F.element_at(F.array(*[F.lit(float(x)) for x in words.class_v]), F.col("kind") + 1)
    share = F.when(F.col("c") > 0, F.greatest(F.col("c") - DISCOUNT, F.lit(DISCOUNT)) / F.greatest(n, F.lit(1.0))) \
        .when(n > 0, DISCOUNT * v / n).otherwise(1.0)
    base = F.log10((F.col("c") + 0.1) / (words.n + 0.1 * (words.v + 1)))
    return hit.groupBy("key").agg(
        F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("more_known"),
        F.sum(F.col("times") * base).alias("more_base"), F.sum(F.col("times") * F.log10(share)).alias("more_inner"))


# ---------------------------------------------------------------- the tree
def _sequences(col: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All texts' symbols in one array, each with three leading ends and its
    end; and the places where a symbol is predicted."""
    pad, end = b"\0" * 6, b"\0" * 2
    seq = np.frombuffer(b"".join([pad + x + end for x in col]), "<u2").astype(np.int64)
    lengths = np.array([len(x) // 2 + 4 for x in col])
    valid = np.ones(len(seq), bool)
    starts = np.cumsum(lengths) - lengths
    for k in range(3):
        valid[starts + k] = False
    return seq, np.flatnonzero(valid)


class Tree:
    """Dense tables: level 1 by symbol; levels 2 and 3 by state number. A
    context without a state has the distribution of its suffix."""

    def __init__(self, symbol_c: np.ndarray):
        p = (symbol_c + ALPHA) / (symbol_c.sum() + ALPHA * len(symbol_c))
        self.root = p
        self.log = [np.tile(np.log10(p).astype(np.float32), (ALPHABET, 1))]
        self.state: list[np.ndarray] = []        # (state of the suffix, symbol before) -> state, or -1
        self.tried: list[np.ndarray] = []        # (state of the suffix, symbol before): decided in the tables
        self.often = np.zeros((ALPHABET, ALPHABET), bool)   # (symbol, symbol before): may be a state
        self.levels = 1

    def states(self, seq: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Number of the deepest level's candidate at each place, -1 for none."""
        now = seq[at - 1]
        for k, table in enumerate(self.state):
            now = np.where(now >= 0, table[now, seq[at - 2 - k]], -1)
        return now.astype(np.int64)        # a table's 16 bits do not hold a cell's number

    def score(self, seq: np.ndarray, at: np.ndarray) -> np.ndarray:
        """log10 of each predicted symbol by its longest suffix state."""
        now, x = seq[at - 1], seq[at]
        out = self.log[0][now, x]
        for k, (table, log) in enumerate(zip(self.state, self.log[1:])):
            now = np.where(now >= 0, table[now, seq[at - 2 - k]], -1)
            has = now >= 0
            out[has] = log[now[has], x[has]]
        return out


def smooth(counts: np.ndarray, parent: np.ndarray) -> np.ndarray:
    """Rows of counts mixed with the suffix's distributions."""
    n, kinds = counts.sum(1, keepdims=True), (counts > 0).sum(1, keepdims=True)
    return (counts + kinds * parent) / np.maximum(n + kinds, 1) if len(counts) else counts


def diverges(counts: np.ndarray, parent: np.ndarray) -> np.ndarray:
    """Does each row's distribution differ from its suffix's by more than its
    parameters cost?"""
    n = counts.sum(1)
    share = counts / np.maximum(n, 1)[:, None]
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = np.where(counts > 0, counts * np.log(share / parent), 0.0).sum(1)
    cost = 0.5 * np.maximum((counts > 0).sum(1) - 1, 1) * np.log(np.maximum(n, 2))
    return (n >= LEAST) & (gain > cost)


def _count(texts: DataFrame, tree, rows: int) -> np.ndarray:
    """Counts of (context, next symbol) over the training texts."""
    size = rows * ALPHABET

    def run(batches):
        t, total = tree.value, np.zeros(size, np.int32)
        for b in batches:
            seq, at = _sequences(b.column(0).to_pylist())
            now = t.states(seq, at)
            has = now >= 0
            keys, n = np.unique(now[has] * ALPHABET + seq[at[has]], return_counts=True)
            total[keys] += n.astype(np.int32)
        keys = np.flatnonzero(total)
        for k in range(0, len(keys), 100_000):
            part = keys[k:k + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(total[part].astype(np.int64))],
                                             names=["cell", "n"])
    got = texts.where(~F.col("held_out")).select("symbols").mapInArrow(run, "cell int, n long") \
        .groupBy("cell").agg(F.sum("n").alias("n")).toArrow()         # at most `size` rows
    out = np.zeros(size)
    out[got["cell"].to_numpy()] = got["n"].to_numpy()
    return out.reshape(rows, ALPHABET)


def grow(texts: DataFrame, symbol_c: np.ndarray) -> Tree:
    """The tree, level by level: each level's counts are taken for contexts
    whose suffix was kept and which occur often enough."""
    sc, tree = texts.sparkSession.sparkContext, Tree(symbol_c)
    shared = sc.broadcast(tree)
    counts = _count(texts, shared, ALPHABET)
    shared.destroy()
    kept = diverges(counts, tree.root[None, :])
    dist = np.where(kept[:, None], smooth(counts, tree.root[None, :]), tree.root[None, :])
    tree.log[0] = np.log10(dist).astype(np.float32)
    # how often symbol a stands before suffix state s: for level 2 the pair
    # counts themselves, deeper the counts of the state one symbol earlier
    before = counts
    tree.often = kept[:, None] & (counts.T >= LEAST)
    while tree.levels < DEPTH and len(dist):
        n_suffix = len(dist)
        freq = before.T if tree.levels == 1 else before
        freq = np.where(kept[:, None], freq, 0) if len(freq) == n_suffix else freq
        cells = np.flatnonzero(freq >= LEAST)
        cells = cells[np.argsort(-freq.ravel()[cells], kind="stable")][:STATES]
        suffix, symbol = cells // ALPHABET, cells % ALPHABET
        table = np.full((n_suffix, ALPHABET), -1, np.int16)
        table[suffix, symbol] = np.arange(len(cells))
        tree.state.append(table)
        tree.tried.append(table >= 0)
        tree.log.append(np.zeros((len(cells), ALPHABET), np.float32))
        if not len(cells):
            break
        trial = sc.broadcast(tree)
        counts = _count(texts, trial, len(cells))
        trial.destroy()
        parent = dist[suffix]
        keep = diverges(counts, parent)
        # renumber the kept states
        number = np.full(len(cells), -1, np.int16)
        number[keep] = np.arange(keep.sum())
        table[suffix, symbol] = number
        new = smooth(counts[keep], parent[keep])
        tree.log[-1] = np.log10(np.maximum(new, 1e-30)).astype(np.float32)
        # occurrences of (a, context) = of the state (a, older symbols) followed by the newest
        before = np.zeros((int(keep.sum()), ALPHABET))
        if tree.levels + 1 < DEPTH:
            newest, older = suffix[keep], symbol[keep]       # level 2: suffix = newest symbol
            pair = np.full((ALPHABET, ALPHABET), -1, np.int64)
            pair[suffix, symbol] = np.arange(len(cells))     # (s1, s2) -> candidate
            for a in range(ALPHABET):
                c = pair[older, a]                           # candidate (older, a): a before older
                has = c >= 0
                before[has, a] = counts[c[has], newest[has]]
        dist, kept = new, np.ones(len(new), bool)
        tree.levels += 1
    return tree


# ------------------------------------- contexts outside the dense tables
def _pairs(t: Tree, seq: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The places (indexes into ``at``) whose two symbols before may be a state
    that the dense tables do not decide."""
    s1, s2 = seq[at - 1], seq[at - 2]
    return np.flatnonzero(t.often[s1, s2] & ~t.tried[0][s1, s2]) if t.tried else np.zeros(0, np.int64)


def _triples(t: Tree, seq: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The same for three symbols whose suffix is a state of the dense tables."""
    s1, s2, s3 = seq[at - 1], seq[at - 2], seq[at - 3]
    if not t.state:
        return np.zeros(0, np.int64)
    state = t.state[0][s1, s2]
    inside = state >= 0
    if len(t.tried) > 1 and len(t.tried[1]):
        inside &= ~t.tried[1][np.maximum(state, 0), s3]
    return np.flatnonzero(inside)


def _cells(seq: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """The two symbols before each place, the nearest first, and the one there,
    as one number; with a ``depth`` of three, the symbol before these last. So
    in their order, rows that differ in the oldest symbol alone are neighbours."""
    cell = (seq[at - 1] * ALPHABET + seq[at - 2]) * ALPHABET + seq[at]
    return cell if depth == 2 else cell * ALPHABET + seq[at - 3]


def _low(t: Tree, cell: np.ndarray) -> np.ndarray:
    """log10 of the last symbol of a cell of three in the dense tables, by its
    pair or the symbol before."""
    x, s1, s2 = cell // ALPHABET % ALPHABET, cell // ALPHABET ** 3, cell // ALPHABET ** 2 % ALPHABET
    state = t.state[0][s1, s2].astype(np.int64)
    low, deep = t.log[0][s1, x], state >= 0
    if deep.any():
        low[deep] = t.log[1][state[deep], x[deep]]
    return low


def _cell_counts(texts: DataFrame, tree) -> DataFrame:
    """pair, part, oldest, x, n, low of the cells of three symbols that the dense
    tables do not decide, in all texts; n counts training texts. Summed within a
    task, then moved once: a pair that is to be decided too (part -1) with all
    that stands before it, others by all three symbols (part: the oldest)."""
    def rows_of(t, cell, n):
        for k in range(0, len(cell), 100_000):
            c = cell[k:k + 100_000]
            pair, rest = c // ALPHABET ** 2, c % ALPHABET ** 2
            undecided = ~t.tried[0][pair // ALPHABET, pair % ALPHABET]
            yield pa.RecordBatch.from_arrays(
                [pa.array(pair.astype(np.int32)), pa.array(np.where(undecided, -1, rest % ALPHABET).astype(np.int32)),
                 pa.array(rest.astype(np.int32)), pa.array(n[k:k + 100_000].astype(np.int32)), pa.array(_low(t, c))],
                names=["pair", "part", "rest", "n", "low"])

    def run(batches):
        t, cells, counts, held = tree.value, [], [], 0

        def summed():
            cell, inverse = np.unique(np.concatenate(cells), return_inverse=True)
            return cell, np.bincount(inverse, weights=np.concatenate(counts)).astype(np.int64)
        for b in batches:
            seq, at = _sequences(b.column(0).to_pylist())
            train = np.repeat(~np.array(b.column(1).to_pylist(), bool), b.column(2).to_numpy())
            found = np.concatenate([_pairs(t, seq, at), _triples(t, seq, at)])
            cell, inverse = np.unique(_cells(seq, at[found], 3), return_inverse=True)
            cells.append(cell)
            counts.append(np.bincount(inverse, weights=train[found], minlength=len(cell)).astype(np.int64))
            held += len(cell)
            if held > 2 * PAIRS:
                one = summed()
                cells, counts, held = [one[0]], [one[1]], len(one[0])
                if held > PAIRS:
                    yield from rows_of(t, *one)
                    cells, counts, held = [], [], 0
        if held:
            yield from rows_of(t, *summed())
    rows = texts.select("symbols", "held_out", "n_tokens").mapInArrow(run, "pair int, part int, rest int, n int, low float")
    cells = rows.repartition("pair", "part").groupBy("pair", "part", "rest").agg(F.sum("n").alias("n"), F.first("low").alias("low"))
    return cells.select("pair", "part", (F.col("rest") % ALPHABET).alias("oldest"), F.expr(f"rest div {ALPHABET}").alias("x"),
                        F.col("n").cast("double").alias("n"), F.col("low").cast("double").alias("low"))


def _fit(n, p):
    return F.when(n > 0, n * F.ln(n / p)).otherwise(0.0)


def _diverges(n, kinds, fit):
    """``diverges`` from a context's count, distinct next symbols and sum of ``_fit``."""
    return (n >= LEAST) & (fit - n * F.ln(n) > 0.5 * F.greatest(kinds - 1, F.lit(1)) * F.ln(n))


def _decided(cells: DataFrame) -> DataFrame:
    """pair, oldest, x and what is added to log10 of x's probability by a state:
    more2 by the pair (on one row of each x), more3 by all three symbols. Rules
    as in ``smooth`` and ``diverges``. What a pair counts are the sums over the
    symbols before it, and its distribution is the suffix's of these, so both
    levels are read off rows that lie together."""
    group = ["pair", "part"]
    n, low, undecided = F.col("n"), F.pow(F.lit(10.0), "low"), F.col("part") < 0
    same = Window.partitionBy(*group, "x")
    rows = cells.withColumns({"_n2": F.sum("n").over(same), "_first": F.col("oldest") == F.min("oldest").over(same)})
    each, n2, first = Window.partitionBy(*group), F.col("_n2"), F.col("_first")
    rows = rows.withColumns({"_all": F.sum("n").over(each), "_kinds": F.count(F.when(first & (n2 > 0), 1)).over(each),
                             "_fit2": F.sum(F.when(first, _fit(n2, low)).otherwise(0.0)).over(each)})
    rows = rows.where((F.col("_all") >= LEAST) & (~undecided | _diverges(F.col("_all"), F.col("_kinds"), F.col("_fit2"))))
    mixed = F.when(undecided, (n2 + F.col("_kinds") * low) / (F.col("_all") + F.col("_kinds"))).otherwise(low)
    rows = rows.select("pair", "part", "oldest", "x", "n", mixed.alias("_p"),
                       F.when(undecided & first, F.log10(mixed) - F.col("low")).alias("more2"))
    three, p = Window.partitionBy(*group, "oldest"), F.col("_p")
    rows = rows.withColumns({"_all": F.sum("n").over(three), "_kinds": F.count(F.when(n > 0, 1)).over(three),
                             "_fit3": F.sum(_fit(n, p)).over(three)})
    own = (n + F.col("_kinds") * p) / (F.col("_all") + F.col("_kinds"))
    more3 = F.when(_diverges(F.col("_all"), F.col("_kinds"), F.col("_fit3")), F.log10(own) - F.log10(p))
    return rows.select("pair", "oldest", "x", "more2", more3.alias("more3")) \
        .where(F.col("more2").isNotNull() | F.col("more3").isNotNull())


def _slots(ctx: np.ndarray) -> np.ndarray:
    return (common.mix(ctx.astype(np.uint64)) % np.uint64(SLOTS)).astype(np.int64)


def beyond_sums(texts: DataFrame, tree) -> DataFrame:
    """key, beyond: what the states outside the dense tables add to each text's
    score by these. A state's probability of the next symbol is set against its
    suffix's."""
    spark = texts.sparkSession
    states = common.store(_decided(_cell_counts(texts, tree)), "states")
    pair = F.col("pair").cast("long")
    two = states.where("more2 IS NOT NULL").select("pair", (pair * ALPHABET + F.col("x")).alias("cell"), F.col("more2").alias("more"))
    three = states.where("more3 IS NOT NULL").select(
        (pair * ALPHABET + F.col("oldest")).alias("ctx"), ((pair * ALPHABET + F.col("x")) * ALPHABET + F.col("oldest")).alias("cell"),
        F.col("more3").alias("more"))
    pairs = np.zeros((ALPHABET, ALPHABET), bool)
    got = two.select("pair").distinct().toArrow()["pair"].to_numpy()        # at most ALPHABET ** 2 numbers
    pairs[got // ALPHABET, got % ALPHABET] = True
    known = spark.sparkContext.broadcast(pairs)

    # SLOTS numbers at most: a context in none of them is no state
    def slot(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(_slots(b.column(0).to_numpy())))], names=["slot"])
    taken = np.zeros(SLOTS, bool)
    taken[three.select("ctx").distinct().mapInArrow(slot, "slot long").distinct().toArrow()["slot"].to_numpy()] = True
    taken = spark.sparkContext.broadcast(taken)

    def explode(batches):
        t = tree.value
        for b in batches:
            seq, at = _sequences(b.column(1).to_pylist())
            key = np.repeat(b.column(0).to_numpy(), b.column(2).to_numpy())
            found = _pairs(t, seq, at)
            found = found[known.value[seq[at[found] - 1], seq[at[found] - 2]]]
            deep = np.concatenate([found, _triples(t, seq, at)])
            cell = _cells(seq, at[deep], 3)
            may = taken.value[_slots(cell // ALPHABET ** 2 * ALPHABET + cell % ALPHABET)]
            # a number tells its level: pairs count below zero
            cell = np.concatenate([-1 - _cells(seq, at[found], 2), cell[may]])
            key = np.concatenate([key[found], key[deep[may]]])
            for k in range(0, len(cell), 200_000):
                sl = slice(k, k + 200_000)
                yield pa.RecordBatch.from_arrays([pa.array(key[sl]), pa.array(cell[sl])], names=["key", "cell"])
    more = two.select((-1 - F.col("cell")).alias("cell"), "more").unionByName(three.select("cell", "more"))
    rows = texts.select("key", "symbols", "n_tokens").mapInArrow(explode, "key long, cell long")
    return rows.join(more, "cell").groupBy("key").agg(F.sum("more").alias("beyond"))


# ------------------------------------------------------------- on Spark
def score_texts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of
    every text."""
    spark = common.prepare(docs.sparkSession)
    texts = folded(docs, id_col, text_col)
    counts = word_counts(texts)
    n_docs = texts.where(~F.col("held_out")).count()
    words = Words(counts, n_docs)
    rows = symbolise(texts, spark.sparkContext.broadcast(words))
    tree = spark.sparkContext.broadcast(grow(rows, words.symbol_c))

    def run(batches):
        t = tree.value
        for b in batches:
            seq, at = _sequences(b.column(1).to_pylist())
            n = b.column(2).to_numpy()
            got = np.add.reduceat(t.score(seq, at).astype(float), np.cumsum(n) - n) if len(n) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got)], names=["key", "tree"])
    more = tail_sums(rows, counts, words)
    outside = beyond_sums(rows, tree)
    tree_score = rows.select("key", "symbols", "n_tokens").mapInArrow(run, "key long, tree double")
    whole = rows.select("key", "doc_id", "held_out", "n_tokens", "n_known", "base", "inner") \
        .join(tree_score, "key").join(more, "key", "left") \
        .join(outside, "key", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return whole.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + zero("more_known")).alias("n_known"),
        F.lit(words.n).cast("long").alias("train_tokens"),
        (F.col("base") + zero("more_base")).alias("base_score"),
        (F.col("tree") + F.col("inner") + zero("more_inner") + zero("beyond")).alias("score"))
