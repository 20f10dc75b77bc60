"""Report library on files and the streaming ingestion path."""
import json
import csv
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from inkbook.sources import ingest, library
from inkbook.sources.schema import HEADER_MAP
from tests.frames import d, jobs_frame


def _root():
    return tempfile.mkdtemp(prefix="inkbook-lib-", dir="/tmp")


def test_store_load_replace_one_partition(spark):
    root = _root()
    library.store_jobs(jobs_frame(spark, [dict(customer_id="A")] * 3), root, 1)
    library.store_jobs(jobs_frame(spark, [dict(customer_id="B")] * 2), root, 2)
    library.store_jobs(jobs_frame(spark, [dict(customer_id="C")]), root, 1)   # replace report 1 only
    got = {(r.report_id, r.n) for r in library.load_jobs(spark, root).groupBy("report_id")
           .agg(F.count(F.lit(1)).alias("n")).collect()}
    assert got == {(1, 1), (2, 2)}
    assert library.load_jobs(spark, root, 2).count() == 2


def test_lifecycle_state_list_latest_delete_purge(spark):
    root = _root()
    t = [d("2024-01-01")]
    import datetime as dt
    ts = lambda h: dt.datetime(2024, 1, 1, h)
    library.append_report_events(spark, root, [
        {"report_id": 1, "seq": 0, "ts": ts(1), "status": "generating", "name": "first", "progress_pct": 150},
        {"report_id": 1, "seq": 1, "ts": ts(2), "status": "ready", "progress_pct": 100},
        {"report_id": 2, "seq": 0, "ts": ts(3), "status": "generating", "name": "second", "progress_pct": -5},
        {"report_id": 3, "seq": 0, "ts": ts(4), "status": "generating", "name": "third"},
        {"report_id": 3, "seq": 1, "ts": ts(5), "status": "failed", "message": "x" * 2000},
    ])
    st = {r.report_id: r for r in library.report_state(library.read_events(spark, root)).collect()}
    assert st[1].status == "ready" and st[1].progress_pct == 100 and st[1].name == "first"
    assert st[2].progress_pct == 0 and st[3].status == "failed" and len(st[3].error) == 1000
    latest = library.latest_ready(library.report_state(library.read_events(spark, root))).collect()
    assert [r.report_id for r in latest] == [1]
    assert library.delete_report(spark, root, 2) is None          # refused while generating
    library.store_jobs(jobs_frame(spark, [dict(customer_id="A")]), root, 1)
    assert library.load_jobs(spark, root, 1).count() == 1
    assert {r.report_id for r in library.delete_report(spark, root, 1).collect()} == {2, 3}
    assert library.load_jobs(spark, root).count() == 0              # hidden at once, before the purge
    st2 = library.report_state(library.read_events(spark, root))
    assert {r.report_id for r in st2.collect()} == {2, 3}
    assert library.purge_deleted(spark, root) >= 1
    assert not os.path.exists(f"{root}/jobs/report_id=1")
    assert library.recover_interrupted(spark, root) == 1            # report 2 was left generating
    st3 = {r.report_id: r.status for r in library.report_state(library.read_events(spark, root)).collect()}
    assert st3[2] == "failed"
    _ = t


def test_payload_round_trip(spark):
    root = _root()
    m = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0)], "report_id bigint, k string, v double")
    library.write_payload({"m": m}, root)
    back = library.read_payload(spark, root, 2, ["m"])["m"].collect()
    assert [(r.k, r.v) for r in back] == [("b", 2.0)]
    js = library.payload_json({"m": m}).filter("report_id = 1").first().json
    assert '"k":"a"' in js


def test_payload_refuses_row_marts(spark):
    m = spark.range(30).selectExpr("id % 3 AS report_id", "id AS v", "CAST(NULL AS STRING) AS k")
    docs = library.payload_json({"m": m}, most_rows=10).collect()
    assert len(docs) == 3 and all(len(json.loads(r.json)) == 10 for r in docs)
    assert [x["v"] for x in json.loads(next(r.json for r in docs if r.report_id == 1))] == list(range(1, 30, 3))
    with pytest.raises(Exception, match="more than 9 rows"):
        library.payload_json({"m": m}, most_rows=9).collect()
    assert library.payload_json({"m": m.limit(0)}).count() == 0


def test_read_jobs_csv_and_cleaning(spark, tmp_path):
    path = tmp_path / "export.csv"
    headers = list(HEADER_MAP)
    with open(path, "w", newline="") as f:
        w = csv.writer(f)
        w.writerow(headers)
        row = {h: "" for h in headers}
        row.update({"Title": "T", "CustomerID": " 7 ", "Customer Name": " Acme ", "SalesIn": "2024-02-01",
                    "Sell Price": "1,000", "VA Amount": "oops", "Quantity": "5", "Currency": "Euro"})
        w.writerow([row[h] for h in headers])
        row2 = dict(row, **{"CustomerID": "nan"})
        w.writerow([row2[h] for h in headers])
    df = ingest.clean(ingest.read_jobs(spark, str(path), "csv"))
    out = df.collect()
    assert len(out) == 1
    r = out[0]
    assert r.customer_id == "7" and r.customer_name == "Acme" and r.quantity == 5.0
    assert r.sell_price == 0.0 and r.va_amount == 0.0 and r.sales_in == d("2024-02-01")


def test_missing_headers_are_named(spark):
    import pytest
    df = spark.createDataFrame([("x",)], "Title string")
    with pytest.raises(ingest.DatasetError) as e:
        ingest.rename_headers(df)
    assert "customer_id" in str(e.value)


def test_stream_ingests_files_idempotently(spark, tmp_path):
    from inkbook.streaming.ingest_stream import ingest_stream
    src = tmp_path / "in"
    src.mkdir()
    headers = list(HEADER_MAP)
    for rid, cust in ((5, "A"), (6, "B")):
        with open(src / f"report_{rid}.csv", "w", newline="") as f:
            w = csv.writer(f)
            w.writerow(headers)
            for day in ("2024-01-01", "2024-02-01", "2024-03-01"):
                row = {h: "1" for h in headers}
                row.update({"Title": "T", "CustomerID": cust, "Customer Name": cust, "SalesIn": day,
                            "Ship date": day, "Currency": "Stg", "Work Type": "Litho", "Rep": "R",
                            "Region": "N", "Industry": "I", "Product Type": "P", "Binding Type": "",
                            "Job Status": "C", "SalesOut": day})
                w.writerow([row[h] for h in headers])
    root, ckpt = str(tmp_path / "lib"), str(tmp_path / "ckpt")
    q = ingest_stream(spark, str(src), root, ckpt, write_marts=True)
    q.awaitTermination(600)
    st = {r.report_id: r.status for r in library.report_state(library.read_events(spark, root)).collect()}
    assert st == {5: "ready", 6: "ready"}
    churn = library.read_payload(spark, root, 5, ["churn_status"])["churn_status"].collect()
    assert [r.customer_id for r in churn] == ["A"]
    # a second run over the same folder finds nothing new and changes nothing
    q2 = ingest_stream(spark, str(src), root, ckpt, write_marts=False)
    q2.awaitTermination(600)
    assert library.load_jobs(spark, root).count() == 6


def _export(path, customer, headers=None, days=("2024-01-01",), **more):
    headers = headers or list(HEADER_MAP)
    with open(path, "w", newline="") as f:
        w = csv.writer(f)
        w.writerow(headers)
        for day in days:
            row = {h: "1" for h in HEADER_MAP} | {"Title": "T", "CustomerID": customer, "Customer Name": customer,
                                                  "SalesIn": day, "Currency": "Stg"} | more
            w.writerow([row[h] for h in headers])


def test_replayed_batch_changes_nothing(spark, tmp_path):
    import datetime as dt
    from inkbook.streaming.ingest_stream import process_files
    _export(tmp_path / "report_9.csv", "A", days=("2024-01-01", "2024-02-03", "2024-03-01"))
    root, files = str(tmp_path / "lib"), [(str(tmp_path / "report_9.csv"), dt.datetime(2024, 5, 1))]
    process_files(spark, files, 0, root, write_marts=False)
    before = library.report_state(library.read_events(spark, root)).collect()
    process_files(spark, files, 0, root, write_marts=False)      # the same batch again, as after a failure
    assert library.load_jobs(spark, root, 9).count() == 3
    assert library.report_state(library.read_events(spark, root)).collect() == before
    r, = before
    assert (r.report_id, r.status, r.event_count, r.rows, r.customers, r.period_from, r.period_to) == \
        (9, "ready", 2, 3, 1, d("2024-01-01"), d("2024-03-01"))


def test_headers_decide_per_file(spark, tmp_path):
    import datetime as dt
    from inkbook.streaming.ingest_stream import process_files
    names = list(HEADER_MAP)
    _export(tmp_path / "report_1.csv", "A", headers=names[::-1])                       # reordered
    _export(tmp_path / "report_2.csv", "B", headers=[h for h in names if h not in ("CustomerID", "Rep")])
    _export(tmp_path / "report_3.csv", "C")
    _export(tmp_path / "report_4.csv", "", SalesIn="never")                            # no usable row
    root = str(tmp_path / "lib")
    process_files(spark, [(str(tmp_path / f"report_{i}.csv"), dt.datetime(2024, 5, 1)) for i in (1, 2, 3, 4)], 3, root,
                  write_marts=False)
    st = {r.report_id: r for r in library.report_state(library.read_events(spark, root)).collect()}
    assert {i: r.status for i, r in st.items()} == {1: "ready", 2: "failed", 3: "ready", 4: "failed"}
    assert "customer_id, rep" in st[2].error
    got = {r.report_id: (r.customer_id, r.job_id) for r in library.load_jobs(spark, root).collect()}
    assert {i: c for i, (c, _) in got.items()} == {1: "A", 3: "C"} and len({j for _, j in got.values()}) == 1


def test_a_failing_build_fails_its_report_only(spark, tmp_path, monkeypatch):
    import datetime as dt
    from inkbook.streaming import ingest_stream as S
    for i, c in ((1, "A"), (2, "B")):
        _export(tmp_path / f"report_{i}.csv", c)

    def build(jobs, cfg, by):
        if jobs.filter("customer_id = 'B'").count():
            raise RuntimeError("cannot build B")
        return {"m": jobs.groupBy("report_id").count()}
    monkeypatch.setattr(S, "build_report", build)
    root = str(tmp_path / "lib")
    S.process_files(spark, [(str(tmp_path / f"report_{i}.csv"), dt.datetime(2024, 5, 1)) for i in (1, 2)], 0, root)
    st = {r.report_id: (r.status, r.error) for r in library.report_state(library.read_events(spark, root)).collect()}
    assert st == {1: ("ready", None), 2: ("failed", "cannot build B")}


def test_report_build_with_reliable_checkpoint(spark):
    from inkbook.plans.report import build_report, prepare
    from inkbook.sources.fixtures import jobs_view
    jd = prepare(jobs_view(spark, "/root/testdata/sf0.001"), reliable=True)
    marts = build_report(jd)
    assert marts["churn_summary"].first().customers == 150
    assert marts["executive_findings"].count() >= 1


def test_a_failed_build_leaves_the_old_report(spark, tmp_path, monkeypatch):
    """Stopped between rows and marts, readers see the old rows with the old
    marts; the replay shows the new ones together."""
    import datetime as dt
    from inkbook.streaming import ingest_stream as S
    root, path = str(tmp_path / "lib"), tmp_path / "report_1.csv"

    def seen():
        return ([r.customer_id for r in library.load_jobs(spark, root).collect()],
                [r.customer_id for r in library.read_payload(spark, root, 1, ["m"])["m"].collect()])
    monkeypatch.setattr(S, "build_report", lambda jobs, cfg, by: {"m": jobs.select("report_id", "customer_id")})
    _export(path, "A")
    S.process_files(spark, [(str(path), dt.datetime(2024, 5, 1))], 0, root)
    assert seen() == (["A"], ["A"])
    _export(path, "B")

    class Killed(BaseException):
        pass

    def killed(jobs, cfg, by):
        raise Killed
    with monkeypatch.context() as m:
        m.setattr(S, "build_report", killed)
        try:
            S.process_files(spark, [(str(path), dt.datetime(2024, 5, 2))], 1, root)
        except Killed:
            pass
    assert seen() == (["A"], ["A"])
    S.process_files(spark, [(str(path), dt.datetime(2024, 5, 2))], 1, root)
    assert seen() == (["B"], ["B"])
    assert library.purge_superseded(spark, root) == 2 and seen() == (["B"], ["B"])
    assert library.purge_superseded(spark, root) == 0


def test_compacted_events_keep_the_state(spark):
    """Few files, the same state; nothing changes when called again."""
    root = _root()
    import datetime as dt

    def add(k):
        library.append_report_events(spark, root, [
            {"report_id": k % 4, "seq": k, "ts": dt.datetime(2024, 1, 1) + dt.timedelta(hours=k), "progress_pct": k,
             "status": ("generating", "ready", "failed", "deleted")[k % 7 % 4], "name": f"n{k}"}])

    def state():
        return sorted(map(tuple, library.report_state(library.read_events(spark, root)).collect()))

    def files():
        return len([n for n in os.listdir(f"{root}/events") if n.startswith("part-")])
    for k in range(12):
        add(k)
    before, many = state(), files()
    assert library.compact_events(spark, root) == 0 and state() == before
    assert library.compact_events(spark, root) == many and files() == 0 and state() == before
    assert library.compact_events(spark, root) == 0 and state() == before
    add(12)
    after = state()
    assert after != before
    library.compact_events(spark, root)
    # a compaction that was stopped before it was complete leaves no trace
    os.makedirs(f"{root}/event-snapshots/99999999999999999999")
    assert state() == after and library.compact_events(spark, root) == 1 and state() == after
    assert len([n for n in os.listdir(f"{root}/event-snapshots") if not n.endswith("-files")]) <= 3
