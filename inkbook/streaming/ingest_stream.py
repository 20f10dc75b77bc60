"""New export files arriving in a folder become stored reports.

The stream carries file names only; each micro-batch reads its files by their
own headers. Files with equal headers are read together, columns are taken by
name (so a reordered file loads right), and a file that lacks a column of the
contract becomes a ``failed`` report that names what is missing, while the
others go on. The same holds for a report whose marts cannot be built.

Rows and marts of a batch are written under its version, and its commit shows
both at once; until then, and where marts cannot be built, readers keep what
they had. Every write is idempotent (partitions by report and version; events
keyed by (report_id, batch), timed by the files), so a replayed batch after a
failure changes nothing. Progress is tracked in the checkpoint folder, which
must be on shared storage on a cluster."""
from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkbook.config import DEFAULT, Config
from inkbook.operators.derive import derive
from inkbook.plans.report import build_report
from inkbook.sources import ingest, library
from inkbook.sources.schema import HEADER_MAP, JOBS_COLUMNS

#: Files of a micro-batch: bounds what a batch keeps on the driver.
MAX_FILES = 100
NO_ROWS = "None of the rows has both a customer and a booking date."


def report_id_from_path(path_col) -> F.Column:
    """report id from a file name like ``report_42.csv``; otherwise a stable
    hash of the path."""
    digits = F.regexp_extract(path_col, r"report[_=-]?(\d+)", 1)
    return F.when(digits != "", digits.cast("bigint")).otherwise(F.abs(F.xxhash64(path_col)))


def _read(spark: SparkSession, paths: Sequence[str], fmt: str) -> DataFrame:
    reader = spark.read.format(fmt)
    if fmt == "csv":
        reader = reader.option("header", "true").option("inferSchema", "false")
    return reader.load(list(paths))


def missing_columns(headers: Sequence[str]) -> list[str]:
    """Contract columns that a file's header has under neither name, sorted."""
    have = set(headers)
    return sorted(c for h, c in HEADER_MAP.items() if c in JOBS_COLUMNS and h not in have and c not in have)


def process_files(spark: SparkSession, files: Sequence[tuple[str, datetime]], batch_id: int, root: str,
                  cfg: Config = DEFAULT, write_marts: bool = True, fmt: str = "csv") -> None:
    """One micro-batch over (path, modification time) of its files."""
    if not files:
        return
    when = max(t for _, t in files)
    ids = {r.path: r.report_id for r in spark.createDataFrame([(p,) for p, _ in files], "path string")
           .select("path", report_id_from_path(F.col("path")).alias("report_id")).collect()}

    def event(report_id, step, status, **more):
        return {"report_id": report_id, "seq": batch_id * 10 + step, "status": status,
                "ts": when + timedelta(microseconds=step), **more}
    # the header line of each file; files with equal headers go together
    by_header: dict[tuple, list[str]] = {}
    failed = []
    for path, _ in files:
        headers = tuple(_read(spark, [path], fmt).columns)
        lacking = missing_columns(headers)
        if lacking:
            failed.append(event(ids[path], 0, library.FAILED, name=f"report {ids[path]}",
                                message="Columns missing from the file: " + ", ".join(lacking)))
        else:
            by_header.setdefault(headers, []).append(path)
    if failed:
        library.append_report_events(spark, root, failed)
    if not by_header:
        return
    parts = []
    for paths in by_header.values():
        df = _read(spark, paths, fmt)
        named = [F.col(f"`{h}`" if h in df.columns else f"`{c}`").alias(c) for h, c in HEADER_MAP.items()]
        parts.append(df.select(*named, report_id_from_path(F.col("_metadata.file_path")).alias("report_id")))
    raw = parts[0]
    for p in parts[1:]:
        raw = raw.unionByName(p)
    jobs = ingest.clean(raw)
    facts = {r.report_id: r for r in jobs.groupBy("report_id").agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("customer_id").alias("customers"),
        F.min("sales_in").alias("period_from"), F.max("sales_in").alias("period_to")).collect()}   # one row per file
    good = sorted({ids[p] for paths in by_header.values() for p in paths})
    library.append_report_events(spark, root, [
        event(i, 0, library.GENERATING, progress="Stored the dataset", progress_pct=15, name=f"report {i}",
              **{c: facts[i][c] for c in library.FACTS}) if i in facts else
        event(i, 0, library.FAILED, name=f"report {i}", message=NO_ROWS) for i in good])
    if not facts:
        return
    version = library.version_of(when)
    library.write_jobs(jobs, root, version)
    broken = _build(spark, root, sorted(facts), version, cfg) if write_marts else {}
    done = {i: version for i in sorted(facts) if i not in broken}
    if done:
        library.commit(spark, root, done)
    library.append_report_events(spark, root, [
        event(i, 1, library.FAILED, message=broken[i]) if i in broken else
        event(i, 1, library.READY, progress="Complete", progress_pct=100) for i in sorted(facts)])


def _build(spark: SparkSession, root: str, ids: list[int], version: int, cfg: Config) -> dict[int, str]:
    """Build the marts of the touched reports at once; if that fails, one by
    one, so that only the reports at fault fail. Returns their messages."""
    touched = spark.createDataFrame([(i,) for i in ids], "report_id bigint")
    stored = library.read_version(spark, root, version).join(touched, "report_id", "left_semi")
    try:
        library.write_payload(build_report(derive(stored, cfg, ("report_id",)), cfg, ("report_id",)), root, version)
        return {}
    except Exception as error:
        if len(ids) == 1:
            return {ids[0]: str(error)}
        out: dict[int, str] = {}
        for i in ids:
            out |= _build(spark, root, [i], version, cfg)
        return out


def ingest_stream(spark: SparkSession, source_dir: str, root: str, checkpoint: str, cfg: Config = DEFAULT,
                  write_marts: bool = True, fmt: str = "csv"):
    """Start (and, with availableNow, finish) ingestion of every file now in
    ``source_dir``. Returns the StreamingQuery."""
    # only names and times are read: the contents' column is pruned
    names = (spark.readStream.format("binaryFile")
             .schema("path string, modificationTime timestamp, length long, content binary").option("maxFilesPerTrigger", MAX_FILES).load(source_dir)
             .select("path", "modificationTime"))

    def batch(df: DataFrame, batch_id: int) -> None:
        files = [(r.path, r.modificationTime.replace(tzinfo=None)) for r in df.collect()]     # at most MAX_FILES
        process_files(spark, sorted(files), batch_id, root, cfg, write_marts, fmt)
    return (names.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())
