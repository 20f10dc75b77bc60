"""Hand-made job frames for unit tests."""
from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from inkbook.operators.derive import derive
from inkbook.sources.schema import JOBS_COLUMNS, JOBS_SCHEMA

DEFAULTS = dict(job_id="T1", customer_id="C1", customer_name="Cust 1", job_status="C", quantity=10.0,
                sell_price=100.0, va_amount=40.0, va_pct=0.4, manual_adjustment=0.0, rep="Rep A",
                region="North", industry="Print", work_type="Litho", product_type="Book", currency="Stg",
                press_hrs=1.0, impressions=1000.0, plates=4.0, paper=10.0, labour=5.0, purchases=2.0)


def d(s: str) -> dt.date:
    return dt.date.fromisoformat(s)


def jobs_frame(spark, rows: list[dict], extra: tuple[str, ...] = ()):
    data = []
    for i, r in enumerate(rows):
        full = {**DEFAULTS, **r}
        full.setdefault("sales_in", d("2024-01-01"))
        full.setdefault("ship_date", None)
        full.setdefault("row_key", f"k{i}")
        vals = []
        for c in JOBS_COLUMNS:
            v = full.get(c)
            t = JOBS_SCHEMA[c].dataType.typeName()
            if t == "double":
                v = 0.0 if v is None else float(v)
            vals.append(v)
        data.append(tuple(vals) + (full["row_key"],) + tuple(full.get(e) for e in extra))
    from pyspark.sql import types as T
    schema = T.StructType(list(JOBS_SCHEMA.fields)).add("row_key", "string")
    for e in extra:
        schema = schema.add(e, "string" if e != "report_id" else "long")
    return spark.createDataFrame(data, schema)


def derived(spark, rows, extra=(), by=()):
    return derive(jobs_frame(spark, rows, extra), by=by)


def rows(df, *order):
    return [r.asDict() for r in (df.orderBy(*order) if order else df).collect()]
