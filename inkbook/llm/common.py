"""Shared plumbing of the training-data operators.

* ``prepare`` ships the package to the executors and keeps Arrow batches small;
* ``scratch`` / ``store`` put intermediate tables into the folder the session
  names in ``spark.checkpoint.dir`` (shared by driver and executors), so a lost
  executor never takes results with it;
* ``word_hashes`` finds and hashes the words of an Arrow text column without
  making a Python object per word.
"""
from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of one Arrow batch handed to Python code: bounds the memory
#: of a Python worker whatever the size of a partition.
BATCH_ROWS = 1000
BATCH_BYTES = 4 << 20


# --------------------------------------------------------------- the session
def prepare(spark: SparkSession) -> SparkSession:
    """Ship this package to the executors once per application and bound the
    Arrow batches. Safe to call again."""
    sc = spark.sparkContext
    if not getattr(sc, "_inkbook_shipped", False):
        root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        fd, path = tempfile.mkstemp(prefix="inkbook-", suffix=".zip")
        with os.fdopen(fd, "wb") as out, zipfile.ZipFile(out, "w") as z:
            for folder, _, names in os.walk(root):
                for n in sorted(names):
                    if n.endswith(".py"):
                        full = os.path.join(folder, n)
                        z.write(full, os.path.join("inkbook", os.path.relpath(full, root)))
        sc.addPyFile(path)
        sc._inkbook_shipped = True
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def shared_root(spark: SparkSession) -> str:
    """The shared folder of the session. A local session without one gets its
    own; on a cluster a missing setting is an error, since a folder of one
    machine cannot hold what others must read."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    root = tempfile.mkdtemp(prefix="inkbook-shared-")
    spark.sparkContext.setCheckpointDir(root)
    return root


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name below the shared folder."""
    return f"{shared_root(spark)}/inkbook-llm/{name}-{uuid.uuid4().hex[:12]}"


#: With it Spark lets go of a query's shuffle files when the query has ended.
LET_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def store(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage,
    and later readers do not compute it again. What was shuffled for it goes
    as soon as it is written."""
    spark = df.sparkSession
    path = path or scratch(spark, name)
    before = spark.conf.get(LET_GO, "false")
    spark.conf.set(LET_GO, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(LET_GO, before)
    return spark.read.schema(df.schema).parquet(path)


def place(df: DataFrame, name: str, files: int = 4) -> str:
    """Write a table of bounded size for tasks to read with ``placed``; returns
    its folder. Neither the driver nor a task's code holds the rows."""
    store(df.repartition(files), name, path := scratch(df.sparkSession, name))
    return path


def placed(uri: str) -> Iterator[pa.RecordBatch]:
    """The rows that ``place`` wrote, batch by batch, inside a task: a worker
    holds what it makes of them, never the whole table beside it."""
    from pyarrow import fs, parquet
    fsys, folder = filesystem(uri)
    for info in fsys.get_file_info(fs.FileSelector(folder)):
        if info.base_name.endswith(".parquet"):
            with fsys.open_input_file(info.path) as file:
                yield from parquet.ParquetFile(file).iter_batches(use_threads=False)
    pa.default_memory_pool().release_unused()


@contextmanager
def bucketed(df: DataFrame, name: str, key: str, parts: int):
    """``df`` stored like ``store``, in buckets of ``key``: joins on the key read
    the buckets where they lie and shuffle the other side only. ``df`` should be
    partitioned by the key already (``parts`` partitions), or every task writes
    to every bucket. The table's name goes with the context; what reads it must
    be stored by then."""
    spark = df.sparkSession
    table = f"inkbook_{uuid.uuid4().hex[:12]}"
    df.write.bucketBy(parts, key).sortBy(key) \
        .option("path", scratch(spark, name)).format("parquet").saveAsTable(table)
    try:
        yield spark.table(table)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {table}")


def text_or_empty(col: str) -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def filesystem(uri: str):
    """(Arrow file system, path) of a folder named by URI or absolute path."""
    from pyarrow import fs
    if "://" not in uri and uri.startswith("file:"):
        uri = "file://" + uri[5:]
    return fs.FileSystem.from_uri(uri)


def write_atomically(uri: str, name: str, write) -> None:
    """Call ``write(stream)`` on a temporary file and rename it into place: a
    task that is tried again, or twice at once, leaves one whole file."""
    fsys, folder = filesystem(uri)
    fsys.create_dir(folder, recursive=True)
    tmp = f"{folder}/.{name}-{uuid.uuid4().hex[:8]}"
    with fsys.open_output_stream(tmp) as out:
        write(out)
    fsys.move(tmp, f"{folder}/{name}")


# ------------------------------------------------------------ words in numpy
_SEP = np.zeros(256, bool)
_SEP[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_TABLE = np.random.default_rng(20240).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_P = 0x9E3779B97F4A7C15
_PINV = pow(_P, -1, 2**64)
#: Bytes of text hashed at a time.
CHUNK = 1 << 20


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POW: dict[int, np.ndarray] = {}


def _pow(base: int, n: int) -> np.ndarray:
    have = _POW.get(base)
    if have is None or len(have) < n:
        have = _POW[base] = _powers(base, max(n, CHUNK + 1))
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Finalising mixer of 64-bit hashes (a bijection)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a string column without nulls."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if not pa.types.is_large_string(col.type):
        col = col.cast(pa.large_string())
    _, off, data = col.buffers()
    offsets = np.frombuffer(off, np.int64)[col.offset:col.offset + len(col) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return offsets, raw


def _spans(offsets: np.ndarray, raw: np.ndarray) -> Iterator[tuple[int, int]]:
    """Byte ranges of about CHUNK bytes that cut no word: they end at a text's
    end, or at a separator of a longer text."""
    i, n = 0, len(offsets) - 1
    while i < n:
        lo = int(offsets[i])
        j = int(np.searchsorted(offsets, lo + CHUNK, "right")) - 1
        if j > i:
            yield lo, int(offsets[j])
            i = j
            continue
        end = int(offsets[i + 1])
        while end - lo > CHUNK:
            cut = lo + CHUNK
            while cut < end and not _SEP[raw[cut]]:
                cut += 1
            if cut == end:
                break
            yield lo, cut
            lo = cut
        yield lo, end
        i += 1


def word_hashes(col: pa.Array, *, spans: bool = False):
    """Words ``[^\\x20\\x09-\\x0D]+`` of each text, A-Z lower-cased, as 64-bit
    hashes in text order: (row of each word, hash of each word); with ``spans``
    also each word's byte start and end in the column's buffer."""
    offsets, raw = text_buffers(col)
    rows, hashes, starts, ends = [], [], [], []
    for lo, hi in _spans(offsets, raw):
        if hi <= lo:
            continue
        data = _LOWER[raw[lo:hi]]
        word = ~_SEP[data]
        first = word.copy()
        first[1:] &= ~word[:-1]
        cuts = offsets[np.searchsorted(offsets, lo):np.searchsorted(offsets, hi)] - lo
        first[cuts] = word[cuts]
        last = word.copy()
        last[:-1] &= ~word[1:]
        cuts = cuts[cuts > 0] - 1
        last[cuts] = word[cuts]
        s = np.flatnonzero(first)
        if not len(s):
            continue
        e = np.flatnonzero(last) + 1
        sums = np.empty(len(data) + 1, np.uint64)
        sums[0] = 0
        np.cumsum(_TABLE[data] * _pow(_P, len(data)), out=sums[1:])
        hashes.append(mix((sums[e] - sums[s]) * _pow(_PINV, len(data))[s]))
        rows.append((np.searchsorted(offsets, s + lo, "right") - 1).astype(np.int32))
        if spans:
            starts.append(s + lo)
            ends.append(e + lo)
    def cat(parts, kind):
        return np.concatenate(parts) if parts else np.zeros(0, kind)
    out = cat(rows, np.int32), cat(hashes, np.uint64)
    return (*out, cat(starts, np.int64), cat(ends, np.int64)) if spans else out


def batches(rows: Iterator[pa.RecordBatch], budget: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of the incoming batches of at most about ``budget`` bytes."""
    for b in rows:
        step = max(1, int(b.num_rows * budget / max(1, b.nbytes)))
        for k in range(0, b.num_rows, step):
            yield b.slice(k, step)
