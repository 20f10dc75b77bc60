"""Operator 10: converting legacy ARC archives to WARC.

An ARC file starts with a version block that says which fields a header line
has: version 1 has five (URL, IP address, date, type, length), version 2 ten
(result code, checksum, location, offset and file name before the length). A
record is its header line and as many bytes as declared. Every record becomes
a WARC record: the date turned into a timestamp, an identifier derived from
file and place, the type from URL scheme and content (HTTP messages are
``response``, others ``resource``), block and payload digests computed.
Payloads that occur again are stored once: others refer to that record
(``revisit``, profile identical-payload-digest).

``write_arc`` makes ARC files of a table of pages, ``convert`` turns ARC files
into WARC files one by one, ``read_warc`` reads records back. Files hold about
FILE_BYTES each and are written under a temporary name first, so a task that
is tried again leaves the same whole file; which record keeps a payload is
decided by an aggregation by digest, before any WARC is written.

Defined cases: a null html is an empty payload; a null page id stays null (and
never wins over a number); a page without an HTTP URL gets a placeholder one;
rows that repeat an id are records of their own (of equal payloads under one
id the first in file order is kept); an empty table gives an empty result.
Only the id, url and html columns are read."""
from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkbook.llm import common

#: Payload bytes after which a new archive file begins.
FILE_BYTES = 16 << 20
#: Payloads from this many bytes on are stored once.
REVISIT_FROM = 1000
LEVEL = 4
DATE = "20240101000000"
#: Header fields of the two ARC versions.
FIELDS = {
    "1": ["URL", "IP-address", "Archive-date", "Content-type", "Archive-length"],
    "2": ["URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset",
          "Filename", "Archive-length"],
}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


# ------------------------------------------------------------------ ARC
def arc_header(version: str, values: dict[str, str]) -> bytes:
    return (" ".join(values.get(f, "-") for f in FIELDS[version]) + "\n").encode()


def arc_version_block(version: str, name: str, date: str = DATE) -> bytes:
    body = f"{version} 0 inkbook\n{' '.join(FIELDS[version])}\n\n".encode()
    return arc_header(version, {"URL": f"filedesc://{name}", "IP-address": "0.0.0.0", "Archive-date": date,
                                "Content-type": "text/plain", "Result-code": "200", "Offset": "0",
                                "Filename": name, "Archive-length": str(len(body))}) + body + b"\n"


def arc_records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, content) of each record; the first is the version block.
    ``stream`` is a binary file, compressed record by record or not."""
    head = stream.peek(2)[:2]
    f = io.BufferedReader(gzip.GzipFile(fileobj=stream)) if head == b"\x1f\x8b" else stream
    fields: list[str] | None = None
    while line := f.readline():
        if line in (b"\n", b"\r\n"):
            continue
        parts = line.decode("utf-8", "replace").split()
        n = int(parts[-1])
        content = f.read(n)
        if len(content) != n:
            raise ValueError("an ARC record is shorter than declared")
        if fields is None:
            if not parts[0].startswith("filedesc:"):
                raise ValueError("no ARC version block")
            version = content.split(None, 1)[0].decode()
            if version not in FIELDS:
                raise ValueError(f"ARC version {version}")
            fields = FIELDS[version]
        if len(parts) > len(fields):         # spaces in a URL of old crawls
            extra = len(parts) - len(fields)
            parts = ["%20".join(parts[:extra + 1]), *parts[extra + 1:]]
        if len(parts) != len(fields):
            raise ValueError(f"an ARC header has {len(parts)} fields")
        yield dict(zip(fields, parts)), content


def http_message(content: bytes) -> tuple[bytes, bytes] | None:
    """(head with its empty line, payload) of an HTTP response."""
    if not content.startswith(b"HTTP/"):
        return None
    m = re.search(rb"\r?\n\r?\n", content)
    return (content, b"") if m is None else (content[:m.end()], content[m.end():])


def http_field(head: bytes, name: str) -> str | None:
    m = re.search(rb"(?im)^" + re.escape(name.encode()) + rb":[ \t]*([^\r\n]*)", head)
    return m[1].decode("utf-8", "replace").strip() if m else None


# ----------------------------------------------------------------- WARC
def warc_record(fields: dict[str, str], block: bytes) -> bytes:
    head = ["WARC/1.1", *(f"{k}: {v}" for k, v in fields.items()), f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def labelled(sha1: bytes) -> str:
    return "sha1:" + base64.b32encode(sha1).decode()


def timestamp(date14: str) -> str:
    """An ARC date (14 digits; missing ones are taken as the least) in ISO form."""
    d = (re.sub(r"\D", "", date14) + "00000101000000"[len(re.sub(r"\D", "", date14)):])[:14]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def record_id(file: str, number: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'arc:{file}#{number}')}>"


def convert_record(file: str, number: int, head: dict[str, str], content: bytes,
                   original: dict | None = None) -> bytes:
    """The WARC record that is equivalent to an ARC record. ``original``: the
    record that keeps an equal payload (record_id, url, date, page_id)."""
    fields = {"WARC-Record-ID": record_id(file, number), "WARC-Date": timestamp(head["Archive-date"])}
    if head["URL"].startswith("filedesc:"):
        info = f"software: inkbook\r\nformat: WARC File Format 1.1\r\nconverted-from: {file}\r\n".encode()
        return warc_record({"WARC-Type": "warcinfo", **fields, "WARC-Filename": file,
                            "Content-Type": "application/warc-fields"}, info)
    fields["WARC-Target-URI"] = head["URL"]
    if re.fullmatch(r"[0-9a-fA-F.:]+", head["IP-address"]) and head["IP-address"] != "0.0.0.0":
        fields["WARC-IP-Address"] = head["IP-address"]
    message = http_message(content)
    if message is None:
        digest = labelled(hashlib.sha1(content).digest())
        return warc_record({"WARC-Type": "resource", **fields, "WARC-Block-Digest": digest,
                            "Content-Type": head["Content-type"]}, content)
    top, payload = message
    block = content if original is None else top
    fields |= {"WARC-Payload-Digest": labelled(hashlib.sha1(payload).digest()),
               "WARC-Block-Digest": labelled(hashlib.sha1(block).digest()),
               "Content-Type": "application/http;msgtype=response"}
    if original is None:
        return warc_record({"WARC-Type": "response", **fields}, block)
    fields |= {"WARC-Refers-To": original["record_id"], "WARC-Refers-To-Target-URI": original["url"],
               "WARC-Refers-To-Date": timestamp(original["date"]), "WARC-Profile": PROFILE}
    if original.get("page_id") is not None:
        fields["X-Refers-To-Page-Id"] = str(original["page_id"])
    return warc_record({"WARC-Type": "revisit", **fields}, block)


def warc_records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, block) of each record."""
    head = stream.peek(2)[:2]
    f = io.BufferedReader(gzip.GzipFile(fileobj=stream)) if head == b"\x1f\x8b" else stream
    while line := f.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError("no WARC version line")
        fields = {}
        while (line := f.readline()).strip():
            k, _, v = line.decode("utf-8", "replace").partition(":")
            fields[k.strip()] = v.strip()
        n = int(fields["Content-Length"])
        block = f.read(n)
        if len(block) != n:
            raise ValueError("a WARC record is shorter than declared")
        yield fields, block


# ------------------------------------------------------------- on Spark
def _open(uri: str):
    fsys, path = common.filesystem(uri)
    return io.BufferedReader(fsys.open_input_file(path), 1 << 20)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, schema.types)], schema=schema)


def write_arc(pages: DataFrame, folder: str, *, id_col: str = "page_id", url_col: str = "url",
              html_col: str = "html", date: str = DATE) -> DataFrame:
    """Write the pages as compressed ARC files, as old crawlers did; one row
    (file, name) per file. Files of odd partitions are version 1, others
    version 2. The page id travels in an HTTP header field."""
    spark = common.prepare(pages.sparkSession)
    schema = pa.schema([("file", pa.string()), ("name", pa.string())])

    def record(version, name, page_id, url, html):
        body = (html or "").encode()
        own = "" if page_id is None else f"X-Page-Id: {page_id}\r\n"
        url = re.sub(r"\s", "%20", url or "")
        if not re.match(r"https?://.", url):
            url = f"http://page.invalid/{'' if page_id is None else page_id}"
        content = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
                   f"Content-Length: {len(body)}\r\n{own}\r\n").encode() + body
        return arc_header(version, {"URL": url, "IP-address": "0.0.0.0", "Archive-date": date,
                                    "Content-type": "text/html", "Result-code": "200", "Filename": name,
                                    "Archive-length": str(len(content))}) + content + b"\n"

    def write(rows):
        part, k, made = TaskContext.get().partitionId(), 0, []
        version = "12"[part % 2 == 0]
        source = ((p, u, h) for b in common.batches(rows) for p, u, h in zip(*(c.to_pylist() for c in b.columns)))
        pending = next(source, None)
        while pending is not None:
            name = f"part-{part:06d}-{k:04d}.arc.gz"

            def fill(out):
                nonlocal pending
                out.write(gzip.compress(arc_version_block(version, name, date), LEVEL, mtime=0))
                size = 0
                while pending is not None and size < FILE_BYTES:
                    rec = record(version, name, *pending)
                    size += len(rec)
                    out.write(gzip.compress(rec, LEVEL, mtime=0))
                    pending = next(source, None)
            common.write_atomically(folder, name, fill)
            made.append((f"{folder}/{name}", name))
            k += 1
        yield _batch(made, schema)
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("u"),
                        F.col(html_col).cast("string").alias("h"))
    return common.store(rows.mapInArrow(write, "file string, name string"), "arc-files")


def _spread(files: DataFrame) -> DataFrame:
    """A few files per task."""
    return files.repartitionByRange(files.sparkSession.sparkContext.defaultParallelism * 4, "file")


def index_arc(files: DataFrame) -> DataFrame:
    """One row per HTTP record of the ARC files: file, number, record_id, url,
    date, page_id, size, digest."""
    common.prepare(files.sparkSession)
    schema = pa.schema([("file", pa.string()), ("number", pa.int64()), ("record_id", pa.string()),
                        ("url", pa.string()), ("date", pa.string()), ("page_id", pa.int64()),
                        ("size", pa.int64()), ("digest", pa.binary())])

    def run(rows):
        for b in rows:
            for file, name in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                got = []
                with _open(file) as f:
                    for number, (head, content) in enumerate(arc_records(f)):
                        message = http_message(content)
                        if message is None:
                            continue
                        page = http_field(message[0], "X-Page-Id")
                        got.append((file, number, record_id(name, number), head["URL"], head["Archive-date"],
                                    int(page) if page else None, len(message[1]),
                                    hashlib.sha1(message[1]).digest()))
                yield _batch(got, schema)
    return _spread(files.select("file", "name")).mapInArrow(
        run, "file string, number long, record_id string, url string, date string, page_id long, size long, "
             "digest binary")


def choose_originals(index: DataFrame, revisit_from: int = REVISIT_FROM) -> DataFrame:
    """Per ARC file the records that will refer to another one, with that one.

    The keeper of a payload is found by a partially aggregated maximum by
    digest; the list per file holds no more than that file's records."""
    big = index.where(F.col("size") >= revisit_from)
    # largest page id first (null least); among equal ones the first in file order
    keeper = (big.groupBy("digest", "size")
              .agg(F.max(F.coalesce("page_id", F.lit(-2**63))).alias("top"), F.count("*").alias("n"))
              .where("n > 1"))
    tied = big.withColumn("top", F.coalesce("page_id", F.lit(-2**63))).join(keeper, ["digest", "size", "top"]) \
        .groupBy("digest", "size").agg(F.min(F.struct("file", "number", "record_id", "url", "date", "page_id")).alias("o"))
    chosen = big.join(tied, ["digest", "size"]) \
        .where((F.col("file") != F.col("o.file")) | (F.col("number") != F.col("o.number")))
    return chosen.groupBy("file").agg(F.collect_list(F.struct(
        "number", "o.record_id", "o.url", "o.date", "o.page_id")).alias("refers"))


def convert(files: DataFrame, folder: str, *, revisit_from: int = REVISIT_FROM) -> DataFrame:
    """Convert each ARC file to a WARC file; one row (file) per WARC file."""
    spark = common.prepare(files.sparkSession)
    refers = choose_originals(common.store(index_arc(files), "arc-index"), revisit_from)
    plan = files.join(refers, "file", "left").select("file", "name", "refers")
    schema = pa.schema([("file", pa.string())])

    def run(rows):
        for b in rows:
            for row in b.to_pylist():
                refer = {r["number"]: r for r in row["refers"] or []}
                name = re.sub(r"(\.arc)?(\.gz)?$", "", row["name"]) + ".warc.gz"

                def fill(out):
                    with _open(row["file"]) as f:
                        for number, (head, content) in enumerate(arc_records(f)):
                            rec = convert_record(row["name"], number, head, content, refer.get(number))
                            out.write(gzip.compress(rec, LEVEL, mtime=0))
                common.write_atomically(folder, name, fill)
                yield _batch([(f"{folder}/{name}",)], schema)
    return common.store(_spread(plan).mapInArrow(run, "file string"), "warc-files")


def read_warc(files: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, url,
    record_id of the HTTP records of WARC files. A stored payload whose digest
    does not match its header is an error."""
    common.prepare(files.sparkSession)
    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                        ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()),
                        ("record_id", pa.string())])

    def run(rows):
        for b in rows:
            for file in b.column(0).to_pylist():
                got = []
                with _open(file) as f:
                    for fields, block in warc_records(f):
                        kind = fields["WARC-Type"]
                        if kind not in ("response", "revisit"):
                            continue
                        top, payload = http_message(block)
                        digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:"))
                        size = len(payload) if kind == "response" else int(http_field(top, "Content-Length"))
                        if kind == "response" and hashlib.sha1(payload).digest() != digest:
                            raise ValueError(f"payload digest of {fields['WARC-Record-ID']}")
                        page, other = http_field(top, "X-Page-Id"), fields.get("X-Refers-To-Page-Id")
                        got.append((int(page) if page else None, size, digest.hex(), kind,
                                    int(other) if other else None, fields["WARC-Target-URI"],
                                    fields["WARC-Record-ID"]))
                yield _batch(got, schema)
    return _spread(files.select("file")).mapInArrow(
        run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, "
             "url string, record_id string")


def archive_pages(pages: DataFrame, **options) -> DataFrame:
    """Pages to ARC, ARC to WARC, and the WARC records read back."""
    spark = pages.sparkSession
    arcs = write_arc(pages, common.scratch(spark, "arc"), **options)
    return read_warc(convert(arcs, common.scratch(spark, "warc")))
