"""Operator 1: token ids in a binary file format of directly addressable codes.

An id is split into 8-bit chunks, lowest first. Level 0 holds the first chunk
of every token; level k+1 holds the next chunk of the tokens that continue
after level k. A bitmap per level says which do, and a rank directory (one
count per 512 bits) turns a position on one level into that on the next. So
any single token is found with one byte per level and a bounded bit count;
no block is decoded.

File layout (little-endian):
``IKDAC1\\0\\0`` | segments | document table | footer.
A segment holds SEGMENT tokens (the last of a file may hold fewer), which
bounds the writer's and the reader's memory; documents run across segments.
The document table has (doc_id, has_id, first token, token count) per
document; the footer has the segments' places. Files are named
``part-<number>.dac``; ids ascend within a file and from file to file.

Defined cases: a null text counts as empty; a document without tokens holds
the end id alone; null ids sort first and stay null; rows that repeat an id
are kept, each as a document, ordered by text; an empty table gives an empty
result. Only the id and text columns are read, so further columns of any name
do no harm. A task that is tried again writes the same files again."""
from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkbook.llm import common, encode

MAGIC = b"IKDAC1\0\0"
SEGMENT = 1 << 18
RANK_BITS = 512
END_ID = 1
_POP = np.array([bin(i).count("1") for i in range(256)], np.uint8)


# -------------------------------------------------------------- the codes
def encode_segment(ids: np.ndarray) -> bytes:
    """Levels of ``ids``: for each level its chunks, and while some tokens
    continue, the bitmap and the rank directory."""
    levels, rest = [], ids.astype(np.uint32)
    while True:
        more = rest > 0xFF
        chunks = (rest & 0xFF).astype(np.uint8).tobytes()
        if not more.any():
            levels.append((chunks, b"", b""))
            break
        bits = np.zeros(-(-len(rest) // RANK_BITS) * RANK_BITS, bool)
        bits[:len(rest)] = more
        packed = np.packbits(bits, bitorder="little")
        per_block = _POP[packed].reshape(-1, RANK_BITS // 8).sum(1, dtype=np.uint32)
        ranks = np.concatenate([[0], np.cumsum(per_block[:-1])]).astype("<u4")
        levels.append((chunks, packed.tobytes(), ranks.tobytes()))
        rest = rest[more] >> 8
    out = [struct.pack("<II", len(ids), len(levels))]
    for part in levels:
        out.append(struct.pack("<III", *map(len, part)))
    for part in levels:
        out.extend(part)
    return b"".join(out)


class Segment:
    """The levels of an encoded segment, as views of its bytes."""

    def __init__(self, data: memoryview | bytes):
        self.n, n_levels = struct.unpack_from("<II", data)
        at, self.levels = 8 + 12 * n_levels, []
        for k in range(n_levels):
            sizes, views = struct.unpack_from("<III", data, 8 + 12 * k), []
            for size, kind in zip(sizes, (np.uint8, np.uint8, np.dtype("<u4"))):
                views.append(np.frombuffer(data, kind, size // np.dtype(kind).itemsize, at))
                at += size
            self.levels.append(views)

    def token(self, i: int) -> int:
        """One token: a byte and a rank per level."""
        value = shift = 0
        for chunks, bits, ranks in self.levels:
            value |= int(chunks[i]) << shift
            if not len(bits) or not bits[i >> 3] >> (i & 7) & 1:
                break
            block = i // RANK_BITS
            before = int(_POP[bits[block * RANK_BITS // 8:i >> 3]].sum())
            before += bin(int(bits[i >> 3]) & ((1 << (i & 7)) - 1)).count("1")
            i, shift = int(ranks[block]) + before, shift + 8
        return value

    def all(self) -> np.ndarray:
        """Every token of the segment."""
        out, at = np.zeros(self.n, np.uint32), None
        for k, (chunks, bits, _) in enumerate(self.levels):
            part = chunks.astype(np.uint32) << np.uint32(8 * k)
            if at is None:
                out |= part
            else:
                out[at] |= part
            if not len(bits):
                break
            more = np.unpackbits(bits, bitorder="little", count=len(chunks)).astype(bool)
            at = np.flatnonzero(more) if at is None else at[more]
        return out


class Writer:
    """Streams documents into a file."""

    def __init__(self, stream):
        self.out, self.at, self.places = stream, 0, []
        self.held, self.n_held, self.tokens = [], 0, 0
        self.docs: list[tuple[int, int, int, int]] = []
        self._put(MAGIC)

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((doc_id or 0, int(doc_id is not None), self.tokens, len(ids)))
        self.tokens += len(ids)
        self.held.append(ids)
        self.n_held += len(ids)
        if self.n_held >= SEGMENT:
            self._flush(last=False)

    def _flush(self, last: bool) -> None:
        whole = np.concatenate(self.held) if self.held else np.zeros(0, np.uint32)
        end = len(whole) if last else len(whole) // SEGMENT * SEGMENT
        for k in range(0, end, SEGMENT):
            self.places.append(self.at)
            self._put(encode_segment(whole[k:min(end, k + SEGMENT)]))
        self.held, self.n_held = [whole[end:]], len(whole) - end

    def close(self) -> None:
        self._flush(last=True)
        self.places.append(self.at)
        self._put(np.array(self.docs, "<i8").reshape(-1, 4).tobytes())
        footer = np.array(self.places, "<i8").tobytes()
        self._put(footer + struct.pack("<qqq", len(self.places), len(self.docs), self.tokens) + MAGIC)


class Reader:
    """Random access to a file by (file-wide) token position."""

    def __init__(self, stream):
        self.f = stream
        size = stream.size()
        tail = 24 + len(MAGIC)
        end = stream.read_at(tail, size - tail)
        if end[24:] != MAGIC:
            raise ValueError("not a token file")
        n_places, n_docs, self.tokens = struct.unpack("<qqq", end[:24])
        at = size - tail - 8 * n_places
        self.places = np.frombuffer(stream.read_at(8 * n_places, at), "<i8")
        table = stream.read_at(32 * n_docs, int(self.places[-1]))
        self.docs = np.frombuffer(table, "<i8").reshape(-1, 4)
        self._kept: tuple[int, Segment] | None = None

    def segment(self, k: int) -> Segment:
        if self._kept is None or self._kept[0] != k:
            lo, hi = int(self.places[k]), int(self.places[k + 1])
            self._kept = k, Segment(self.f.read_at(hi - lo, lo))
        return self._kept[1]

    def token(self, i: int) -> int:
        return self.segment(i // SEGMENT).token(i % SEGMENT)

    def documents(self) -> Iterator[tuple[int | None, int, int, int]]:
        """(doc_id, first token, token count, crc32 of the ids) in file order,
        with one decoded segment in memory at a time."""
        k, ids = -1, np.zeros(0, np.uint32)
        for doc_id, has_id, start, n in self.docs.tolist():
            crc, at = 0, start
            while at < start + n:
                if at // SEGMENT != k:
                    k = at // SEGMENT
                    ids = self.segment(k).all().astype("<u4")
                upto = min(start + n, (k + 1) * SEGMENT)
                crc = zlib.crc32(ids[at - k * SEGMENT:upto - k * SEGMENT].tobytes(), crc)
                at = upto
            yield (doc_id if has_id else None), start, n, crc


# ------------------------------------------------------------ on Spark
def write_tokens(docs: DataFrame, folder: str, *, id_col: str = "doc_id", text_col: str = "text",
                 vocabulary: str = encode.DEFAULT_WORD_BPE) -> DataFrame:
    """Encode every text and write the token files in ascending id order; the
    result is one row per file (number, file, n_docs, n_tokens).

    One range shuffle of (id, text) puts the documents in order; encoding and
    writing happen in the tasks that read it."""
    spark = common.prepare(docs.sparkSession)
    path = encode.vocabulary(vocabulary)

    def write(rows):
        enc, number = encode.word_encoder(path), TaskContext.get().partitionId()
        rows = common.batches(rows)
        head = next(rows, None)
        if head is None:
            return
        state = {}

        def fill(stream):
            w = Writer(stream)
            batch = head
            while batch is not None:
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    ids = np.frombuffer(enc.encode(text), "<u4")
                    w.add(doc_id, np.append(ids, np.uint32(END_ID)))
                batch = next(rows, None)
            w.close()
            state.update(n_docs=len(w.docs), n_tokens=w.tokens)
        name = f"part-{number:06d}.dac"
        common.write_atomically(folder, name, fill)
        yield pa.RecordBatch.from_pydict({"number": [number], "file": [f"{folder}/{name}"],
                                          "n_docs": [state["n_docs"]], "n_tokens": [state["n_tokens"]]},
                                         schema=pa.schema([("number", pa.int64()), ("file", pa.string()),
                                                           ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))

    ordered = (docs.select(F.col(id_col).cast("long").alias("id"), common.text_or_empty(text_col).alias("body"))
               .repartitionByRange(F.col("id").asc_nulls_first())
               .sortWithinPartitions(F.col("id").asc_nulls_first(), "body"))
    made = ordered.mapInArrow(write, "number long, file string, n_docs long, n_tokens long")
    return common.store(made, "token-files")


def read_tokens(spark: SparkSession, files: DataFrame) -> DataFrame:
    """Documents of the files of ``write_tokens``: doc_id, start (tokens of all
    documents before it), n_tokens, ids_crc32."""
    common.prepare(spark)

    def read(rows):
        schema = pa.schema([("number", pa.int64()), ("doc_id", pa.int64()), ("at", pa.int64()),
                            ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
        for b in rows:
            for number, file in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                fsys, path = common.filesystem(file)
                with fsys.open_input_file(path) as f:
                    got = []
                    for row in Reader(f).documents():
                        got.append((number, *row))
                        if len(got) == 10_000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*got), schema.types)], schema=schema)
                            got = []
                    if got:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*got), schema.types)], schema=schema)

    # one row per file: the prefix sum sees files, never documents
    base = files.select("number", F.coalesce(F.sum("n_tokens").over(
        Window.orderBy("number").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    spread = files.select("number", "file").repartitionByRange(spark.sparkContext.defaultParallelism * 4, "number")
    rows = spread.mapInArrow(read, "number long, doc_id long, at long, n_tokens long, ids_crc32 long")
    return rows.join(base, "number").select("doc_id", (F.col("at") + F.col("base")).alias("start"),
                                            "n_tokens", "ids_crc32")


def token_store(docs: DataFrame, **options) -> DataFrame:
    """Write ``docs`` as token files in the shared folder and read them back."""
    spark = docs.sparkSession
    files = write_tokens(docs, common.scratch(spark, "tokens"), **options)
    return read_tokens(spark, files)
