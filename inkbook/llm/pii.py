"""Operator 4: personal data by rules and a trained character tagger.

Base rules find emails, IP addresses, card and phone numbers in their usual
forms. A character-level bidirectional LSTM with CRF transitions (``tagger``)
adds spans in other forms: written-out or bracketed separators, numbers
without a plus sign, cards with other separators. It is trained here on
labelled spans: generated data of each kind set into context taken from a
bounded sample of the texts (SAMPLE documents), beside numbers that are none
(versions, dates, amounts, keys).

A text is cut into overlapping windows. A span must hold a digit, an ``@`` or
a bracketed "at", so windows without one have none and are not decoded; all
others are, whatever the text's length. Windows are reconciled over the whole
text: spans cut by a window's edge yield to the neighbour that holds them
whole, or else to a window set around them and widened until it does; of the
spans that remain the set of greatest total probability
without overlaps is taken. Spans that meet a base span, are unsure, or do not
read as their kind once separators are undone are left out.

Defined cases: a null or empty text has no spans; repeated rows are kept; an
empty table gives an empty result. ``find`` reads the id and text columns;
``redact`` returns all columns it is given."""
from __future__ import annotations

import hashlib
import re
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkbook.llm import common
from inkbook.llm.tagger import KINDS, Tagger, symbols

#: Documents that lend context, windows trained on, window length and stride.
SAMPLE, TRAINED, WINDOW, STRIDE = 400, 1500, 96, 48
SURE = 0.8
CUE = re.compile(r"[0-9@]|[\[({] ?at ?[\])}]", re.I)


# -------------------------------------------------------------- base rules
# The rules' patterns. Those whose plain form rescans a long run
# of their own characters from every place in it are written from the sign
# that must be there.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+").match
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}").finditer
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+").finditer
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]").finditer


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _emails(text: str):
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and part <= "255"


def _digits(s: str) -> str:
    return re.sub(r"[^0-9]", "", s)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the base rules, by kind, then start."""
    out = []
    if "@" in text:
        out += [(0, a, b) for a, b in _emails(text)]
    if _any_digit(text):
        out += [(1, m.start(), m.end()) for m in _IP(text) if all(map(_small, m[0].split(".")))]
        for m in _CARD(text):
            if m.end() - m.start() >= 16:
                d = _digits(m[0])
                if 16 <= len(d) <= 19 and luhn(d):
                    out.append((2, m.start(), m.end()))
        if "+" in text:
            out += [(3, m.start(), m.end()) for m in _PHONE(text) if 8 <= len(_digits(m[0])) <= 15]
    return out


_any_digit = re.compile("[0-9]").search


# ---------------------------------------------------------- labelled spans
def _pick(rng, options):
    return options[int(rng.integers(len(options)))]


def _number(rng, n: int) -> str:
    return "".join(map(str, rng.integers(0, 10, n)))


def _card_number(rng) -> str:
    body = str(rng.integers(3, 7)) + _number(rng, 14)
    return next(body + str(d) for d in range(10) if luhn(body + str(d)))


def generated(rng, kind: int) -> str:
    """One piece of personal data, in a usual form or in another."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    word = lambda a, b: "".join(_pick(rng, letters) for _ in range(rng.integers(a, b)))
    if kind == 0:
        user = word(2, 9) + _pick(rng, ["", "", ".", "_", "-"]) * 1
        user = (user + word(2, 7) if user[-1] in "._-" else user) + _pick(rng, ["", "", _number(rng, 2)])
        at = _pick(rng, ["@", "@", "@", " [at] ", "[at]", " (at) ", "(at)", " @ ", "{at}"])
        dot = _pick(rng, [".", ".", "."] + ([" [dot] ", "[dot]", " (dot) ", " dot "] if at != "@" else []))
        return user + at + dot.join([word(3, 10)] * 1 + ([word(3, 8)] if rng.random() < 0.4 else []) +
                                    [_pick(rng, ["com", "org", "net", "de", "io", "co"])])
    if kind == 1:
        sep = _pick(rng, [".", ".", "[.]", " . ", "(.)", " dot ", "[dot]"])
        return sep.join(str(rng.integers(0, 256)) for _ in range(4))
    if kind == 2:
        d, sep = _card_number(rng), _pick(rng, ["", "", " ", "-", ".", "/", "_"])
        return sep.join(d[k:k + 4] for k in range(0, 16, 4))
    a, b, c = _number(rng, 3), _number(rng, 3), _number(rng, 4)
    country = _pick(rng, ["+1 ", "+44 ", "+", "00", "001 ", "", "", ""])
    return country + _pick(rng, [f"({a}) {b}-{c}", f"({a}) {b} {c}", f"{a}-{b}-{c}", f"({a}){b}-{c}", f"{a}/{b}-{c}"])


def decoy(rng) -> str:
    """A number or key that is no personal data."""
    n = lambda k: _number(rng, k)
    hexes = "".join(_pick(rng, "0123456789abcdef") for _ in range(int(rng.integers(12, 41))))
    key = "".join(_pick(rng, "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(16))
    return _pick(rng, [
        f"{rng.integers(1, 20)}.{rng.integers(0, 10)}", f"{rng.integers(1, 9)}.{rng.integers(0, 10)}.",
        f"v{rng.integers(1, 9)}.{rng.integers(0, 20)}.{rng.integers(0, 20)}", f"{rng.integers(1900, 2030)}",
        f"{rng.integers(1900, 2030)}-{rng.integers(1, 13):02d}-{rng.integers(1, 29):02d}",
        f"{rng.integers(1, 13)}/{rng.integers(1, 29)}/{rng.integers(1990, 2030)}", f"${n(3)}.{n(2)}", f"{n(2)}%",
        f"{rng.integers(1, 999)},{n(3)}", f"{rng.integers(1, 9)},{n(3)},{n(3)}", hexes, f'"{hexes}"', "AKIA" + key,
        f"password={hexes}", f"#{n(4)}", f"{n(int(rng.integers(1, 8)))}", f"({rng.integers(1, 30)})", f"[{rng.integers(1, 99)}]",
        f"{rng.integers(1, 13)}:{rng.integers(10, 60)}", f"{rng.integers(1, 40)}.", f"@{key.lower()[:7]}", f"{n(2)}-{n(2)}",
        f"{n(3)}.{n(3)}.{n(3)}", f"{n(int(rng.integers(17, 30)))}", "-" * 20 + n(1)])


def training_windows(contexts: list[str], n: int = TRAINED, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, tags) of ``n`` windows with generated data set into context."""
    rng = np.random.default_rng(seed)
    contexts = [c for c in contexts if c and not CUE.search(c)] or ["the form of and that", "is in. Of the,"]
    ids, tags = np.zeros((n, WINDOW), np.int64), np.zeros((n, WINDOW), np.int64)
    for i in range(n):
        text, marks = "", []
        while len(text) < WINDOW:
            c = _pick(rng, contexts)
            at = int(rng.integers(0, max(1, len(c) - 40)))
            text += c[at:at + int(rng.integers(5, 45))] + _pick(rng, [" ", " ", "\n", ": ", ", ", " ("])
            roll = rng.random()
            if roll < 0.62:
                kind = int(rng.integers(4))
                item = generated(rng, kind)
                marks.append((kind, len(text), len(text) + len(item)))
                text += item
            elif roll < 0.92:
                text += decoy(rng)
            text += _pick(rng, [" ", " ", ". ", ", ", "\n", ") "])
        cut = int(rng.integers(0, max(1, len(text) - WINDOW + 1)))
        ids[i] = symbols(text)[cut:cut + WINDOW]
        for kind, a, b in marks:
            a, b = a - cut, b - cut
            # pieces cut off at the window's edge are left out of the window
            if b <= 0 or a >= WINDOW:
                continue
            if a < 0 or b > WINDOW:
                ids[i, max(a, 0):max(b, 0)] = symbols(" ")[0]
                continue
            tags[i, a] = 1 + 2 * kind
            tags[i, a + 1:b] = 2 + 2 * kind
    return ids, tags


def train(contexts: list[str]) -> Tagger:
    model = Tagger()
    model.fit(*training_windows(contexts))
    return model


# ----------------------------------------------------------- reconciliation
def reads_as(kind: int, s: str) -> bool:
    """Does a span read as its kind once unusual separators are undone?"""
    s = re.sub(r"\s*[\[({]\s*(dot|\.)\s*[\])}]\s*|\s+dot\s+|\s+\.\s+", ".", s, flags=re.I)
    s = re.sub(r"\s*[\[({]\s*at\s*[\])}]\s*|\s+@\s+", "@", s, flags=re.I)
    d = _digits(s)
    if kind == 0:
        return re.fullmatch(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}", s) is not None
    if kind == 1:
        return re.fullmatch(r"[0-9]{1,3}(\.[0-9]{1,3}){3}", s) is not None and all(map(_small, s.split(".")))
    if kind == 2:
        return re.fullmatch(r"[0-9]+([ ./_-]{1,3}[0-9]+)*", s) is not None and 13 <= len(d) <= 19 and luhn(d)
    return re.fullmatch(r"\+?[0-9(][0-9() ./-]*[0-9]", s) is not None and 9 <= len(d) <= 15 \
        and re.search(r"[() /-]", s) is not None and not re.fullmatch(r"[0-9]+([.,/-][0-9]+)?", s)


def reconcile(spans: list[tuple[int, int, int, float]]) -> list[tuple[int, int, int]]:
    """The non-overlapping spans of greatest total probability."""
    best: dict[tuple[int, int, int], float] = {}
    for kind, a, b, sure in spans:
        best[kind, a, b] = max(sure, best.get((kind, a, b), 0.0))
    order = sorted(best, key=lambda s: (s[2], s[1], s[0]))
    ends = [s[2] for s in order]
    value, take = [0.0], []
    for i, s in enumerate(order):
        before = bisect_left(ends, s[1] + 1, 0, i)
        gain = value[before] + best[s] * (s[2] - s[1])
        take.append((gain > value[-1], before))
        value.append(max(gain, value[-1]))
    out, i = [], len(order)
    while i:
        taken, before = take[i - 1]
        if taken:
            out.append(order[i - 1])
            i = before
        else:
            i -= 1
    return out[::-1]


def windows(text: str) -> list[int]:
    """Starts of the windows that can hold a span."""
    starts, last = [], -1
    n = len(text)
    for m in CUE.finditer(text):
        lo = max(0, (m.start() - WINDOW) // STRIDE + 1)
        for k in range(max(lo, last + 1), m.start() // STRIDE + 1):
            if k == 0 or k * STRIDE + WINDOW - STRIDE < n:      # beyond: covered by the one before
                starts.append(k * STRIDE)
                last = k
    return starts


def _decoded(model: Tagger, texts: list[str], part: list[tuple[int, int, int]]):
    """(window, span) of windows (text, start, end) of one width; what reaches
    beyond the text is no span."""
    ids = np.zeros((len(part), part[0][2] - part[0][1]), np.int64)
    for r, (i, s, e) in enumerate(part):
        piece = symbols(texts[i][s:e])
        ids[r, :len(piece)] = piece
    for (i, s, e), spans in zip(part, model.decode(ids)):
        for kind, a, b, sure in spans:
            if s + b <= len(texts[i]):
                yield (i, s, e), (kind, s + a, s + b, sure)


def not_held(cut: list[tuple[int, int, int, int]], whole: list[list]) -> list[tuple[int, int, int, int]]:
    """The cut pieces (text, kind, start, end) that lie in no whole span of
    their kind."""
    reach: dict[tuple[int, int], tuple[list[int], list[int]]] = {}
    for i in {c[0] for c in cut}:
        for kind, a, b, _ in sorted(whole[i]):
            starts, ends = reach.setdefault((i, kind), ([], []))
            starts.append(a)
            ends.append(max(b, ends[-1] if ends else 0))
    out = []
    for i, kind, a, b in cut:
        starts, ends = reach.get((i, kind), ([], []))
        k = bisect_left(starts, a + 1)
        if not k or ends[k - 1] < b:
            out.append((i, kind, a, b))
    return out


def around(model: Tagger, texts: list[str], cut: list[tuple[int, int, int, int]]):
    """(text, span) decoded in windows around the cut pieces, which are joined
    where they meet; while an edge still cuts a span, the margin is doubled."""
    margin = STRIDE
    while cut:
        joined: list[list[int]] = []
        for i, kind, a, b in sorted(cut):
            if joined and joined[-1][:2] == [i, kind] and a <= joined[-1][3]:
                joined[-1][3] = max(b, joined[-1][3])
            else:
                joined.append([i, kind, a, b])
        by: dict[int, list[tuple[int, int, int]]] = {}
        pieces: dict[tuple[int, int, int], list[tuple[int, int]]] = {}
        for i, _, a, b in joined:
            s = max(0, a - margin)
            w = (i, s, s - (s - b - margin) // STRIDE * STRIDE)       # widths are multiples of the stride
            if w not in pieces:
                by.setdefault(w[2] - s, []).append(w)
            pieces.setdefault(w, []).append((a, b))
        cut = []
        for width, parts in by.items():
            step = max(1, 256 * WINDOW // width)
            for lo in range(0, len(parts), step):
                for (i, s, e), (kind, a, b, sure) in _decoded(model, texts, parts[lo:lo + step]):
                    if not any(a < y and x < b for x, y in pieces[i, s, e]):
                        continue
                    if a == s > 0 or b == e < len(texts[i]):
                        cut.append((i, kind, a, b))
                    else:
                        yield i, (kind, a, b, sure)
        margin *= 2


def added_spans(model: Tagger, texts: list[str], base: list[list[tuple[int, int, int]]]) -> list[list[tuple[int, int, int]]]:
    """The model's spans of each text beyond its base spans."""
    where = [(i, s) for i, t in enumerate(texts) for s in windows(t)]
    whole: list[list] = [[] for _ in texts]
    cut: list[tuple[int, int, int, int]] = []
    for lo in range(0, len(where), 256):
        part = [(i, s, s + WINDOW) for i, s in where[lo:lo + 256]]
        for (i, s, e), (kind, a, b, sure) in _decoded(model, texts, part):
            if a == s > 0 or b == e < len(texts[i]):
                cut.append((i, kind, a, b))
            else:
                whole[i].append((kind, a, b, sure))
    for i, span in around(model, texts, not_held(cut, whole)):
        whole[i].append(span)
    found = [[s for s in spans if s[3] >= SURE] for spans in whole]
    out = []
    for text, own, spans in zip(texts, base, found):
        good = []
        taken = sorted((a, b) for _, a, b in own)
        for kind, a, b, sure in spans:
            while a < b and text[a].isspace():
                a += 1
            while b > a and text[b - 1].isspace():
                b -= 1
            k = bisect_left(taken, (b, 0))
            if (k and taken[k - 1][1] > a) or not reads_as(kind, text[a:b]):
                continue
            good.append((kind, a, b, sure))
        out.append(reconcile(good))
    return out


# ------------------------------------------------------------- on Spark
def fit(docs: DataFrame, id_col: str, text_col: str) -> Tagger:
    """Train on context from about SAMPLE documents, chosen by a hash of id."""
    share = min(1.0, SAMPLE / max(1, docs.count()))
    rows = docs.where(F.pmod(F.xxhash64(F.col(id_col)), F.lit(1 << 20)) < int(share * (1 << 20)) + 1) \
        .select(F.col(id_col).cast("long").alias("i"), F.substring(common.text_or_empty(text_col), 1, 2000).alias("t")) \
        .orderBy("i", "t").limit(2 * SAMPLE).collect()
    # context is cut where numbers and signs of data stand
    return train([c for r in rows for c in CUE.split(r["t"])[:3] if c and len(c) > 20])


def _spans(model: Tagger, texts: list[str]):
    base = [base_spans(t) for t in texts]
    return base, added_spans(model, texts, base)


def _joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def find(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, counts of base spans, base_sha256, spans, n_added of every text."""
    spark = common.prepare(docs.sparkSession)
    model = spark.sparkContext.broadcast(fit(docs, id_col, text_col))

    def run(rows):
        for b in common.batches(rows):
            base, added = _spans(model.value, b.column(1).to_pylist())
            counts = [[sum(s[0] == k for s in own) for own in base] for k in range(4)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array(c, pa.int64()) for c in counts),
                 pa.array([hashlib.sha256(_joined(s).encode()).hexdigest() for s in base], pa.string()),
                 pa.array([_joined(sorted(s + x)) for s, x in zip(base, added)], pa.string()),
                 pa.array([len(x) for x in added], pa.int64())],
                names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"])
    return (docs.select(F.col(id_col).cast("long").alias("id"), common.text_or_empty(text_col).alias("body"))
            .mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, "
                             "base_sha256 string, spans string, n_added long"))


def blanked(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with every span replaced by its kind; overlapping spans become
    one, named by the first."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2], s[0])):
        if a >= at:
            out += [text[at:a], f"[{KINDS[kind].upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
           length_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with personal data in the text replaced by its kind; a null
    text stays null; ``length_col``, if given, gets the new length where the
    text changed."""
    spark = common.prepare(docs.sparkSession)
    model = spark.sparkContext.broadcast(fit(docs, id_col, text_col))
    schema, at = docs.schema, docs.columns.index(text_col)
    size = docs.columns.index(length_col) if length_col in docs.columns else None

    def run(rows):
        for b in common.batches(rows):
            old = b.column(at).to_pylist()
            base, added = _spans(model.value, [t or "" for t in old])
            new = [t if not (s or x) else blanked(t, s + x) for t, s, x in zip(old, base, added)]
            cols = list(b.columns)
            cols[at] = pa.array(new, b.schema.field(at).type)
            if size is not None:
                had = b.column(size).to_pylist()
                cols[size] = pa.array([h if t is u else len(u) for h, t, u in zip(had, old, new)],
                                      b.schema.field(size).type)
            yield pa.RecordBatch.from_arrays(cols, schema=b.schema)
    return docs.mapInArrow(run, schema)
