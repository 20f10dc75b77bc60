"""Side-by-side check of queries() against oracle_sql() on DuckDB, the way the
driver does it: row count, column names and order-insensitive values."""
from __future__ import annotations

import math
import os
import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 6)
    if hasattr(v, "isoformat") and not isinstance(v, str):
        return str(v)[:10] if len(str(v)) >= 10 and str(v)[10:].strip("0: ") == "" else str(v)
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(_norm(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda t: tuple((x is None, str(x)) for x in t))


SPARK_TO_DUCK = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
                 "date": "DATE", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP", "timestamp": "TIMESTAMP"}


def type_mismatches(df, cur) -> list[str]:
    duck = {d[0]: str(d[1]) for d in cur.description}
    out = []
    for name, t in df.dtypes:
        want = SPARK_TO_DUCK.get(t, t.upper())
        got = duck.get(name, "?").upper()
        if want != got:
            out.append(f"{name}: spark {t} vs duck {got}")
    return out


def compare(spark, sf_dir: str, keys=None, verbose=True):
    sys.path.insert(0, "/root/repo")
    import __spark_entry__ as E
    qs, sql = E.queries(), E.oracle_sql()
    con = duck(sf_dir)
    results = {}
    for k in keys or sorted(qs):
        t = time.time()
        try:
            df = qs[k](spark, sf_dir)
            scols = df.columns
            srows = [tuple(r) for r in df.collect()]
        except Exception as e:  # noqa: BLE001
            results[k] = f"SPARK ERROR {type(e).__name__}: {str(e)[:300]}"
            print(k, results[k]) if verbose else None
            continue
        if k not in sql:
            results[k] = f"rows-only {len(srows)}"
            print(k, results[k], f"{time.time()-t:.1f}s") if verbose else None
            continue
        try:
            cur = con.execute(sql[k])
            dcols = [d[0] for d in cur.description]
            tmis = type_mismatches(df, cur)
            drows = cur.fetchall()
        except Exception as e:  # noqa: BLE001
            results[k] = f"DUCK ERROR {str(e)[:300]}"
            print(k, results[k]) if verbose else None
            continue
        if sorted(scols) != sorted(dcols):
            results[k] = f"COLUMNS spark={sorted(scols)} duck={sorted(dcols)}"
        elif len(srows) != len(drows):
            results[k] = f"ROWCOUNT spark={len(srows)} duck={len(drows)}"
        else:
            a, b = rows_of(scols, srows), rows_of(dcols, drows)
            bad = [(x, y) for x, y in zip(a, b) if x != y]
            results[k] = ("OK" if not tmis else f"TYPES {tmis}") if not bad \
                else f"VALUES {len(bad)} differ, e.g. {bad[0]}"
        if verbose:
            print(k, results[k][:600], f"({len(srows)} rows, {time.time()-t:.1f}s)")
    return results


if __name__ == "__main__":
    sys.path.insert(0, "/root/repo")
    from inkbook.session import local_session
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    keys = sys.argv[2].split(",") if len(sys.argv) > 2 else None
    spark = local_session(8)
    res = compare(spark, sf, keys)
    print("SUMMARY", sum(v == "OK" for v in res.values()), "/", len(res))
