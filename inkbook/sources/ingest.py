"""Reading and cleaning job exports."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkbook.sources.schema import DATE_COLUMNS, HEADER_MAP, JOBS_COLUMNS, NUMERIC_COLUMNS


class DatasetError(ValueError):
    """The export cannot be used, with a reason worth showing."""


def read_jobs(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """Read an export with the 36-header contract and rename to column names.

    CSV is read as text (no schema inference) and coerced later, so a bad
    cell turns into 0.0 / NULL instead of failing the read."""
    reader = spark.read.format(fmt)
    if fmt == "csv":
        reader = reader.option("header", "true").option("inferSchema", "false")
    df = reader.load(path)
    return rename_headers(df)


def rename_headers(df: DataFrame) -> DataFrame:
    """Map export headers to column names; already-renamed columns pass
    through, extra columns are dropped (the contract is closed)."""
    present = set(df.columns)
    out = []
    for header, name in HEADER_MAP.items():
        if header in present:
            out.append(F.col(f"`{header}`").alias(name))
        elif name in present:
            out.append(F.col(name))
    if "row_key" in present:
        out.append(F.col("row_key"))
    return validate_columns(df.select(*out))


def validate_columns(df: DataFrame) -> DataFrame:
    """Reject a frame missing any contract column, naming them sorted."""
    missing = sorted(set(JOBS_COLUMNS) - set(df.columns))
    if missing:
        raise DatasetError("The export is missing expected columns: " + ", ".join(missing))
    return df


def coerce_numeric(df: DataFrame) -> DataFrame:
    """22 numeric columns; unparseable, NaN or missing become 0.0."""
    types = dict(df.dtypes)

    def num(c):
        v = F.trim(F.col(c)).try_cast("double") if types[c] == "string" \
            else F.col(c).cast("double")
        return F.coalesce(F.nanvl(v, F.lit(0.0)), F.lit(0.0))
    return df.withColumns({c: num(c) for c in NUMERIC_COLUMNS})


def coerce_dates(df: DataFrame) -> DataFrame:
    """3 date columns; unparseable become NULL. ISO dates and timestamps are
    accepted; a time of day is dropped (an order event is a calendar day)."""
    types = dict(df.dtypes)

    def dt(c):
        if types[c] == "date":
            return F.col(c)
        if types[c].startswith("timestamp"):
            return F.col(c).cast("date")
        s = F.trim(F.col(c).cast("string"))
        return F.coalesce(s.try_cast("date"),
                          F.to_date(F.try_to_timestamp(s, F.lit("dd/MM/yyyy"))))
    return df.withColumns({c: dt(c) for c in DATE_COLUMNS})


def clean_keys(df: DataFrame) -> DataFrame:
    """Trim id and name; a blank or literal 'nan' id counts as missing."""
    cid = F.trim(F.col("customer_id").cast("string"))
    return df.withColumns({
        "customer_id": F.when((cid == "") | (F.lower(cid) == "nan"), F.lit(None)).otherwise(cid),
        "customer_name": F.trim(F.col("customer_name").cast("string")),
    })


def drop_unusable(df: DataFrame) -> DataFrame:
    """Rows with no booking date or customer cannot be analysed."""
    return df.filter(F.col("sales_in").isNotNull() & F.col("customer_id").isNotNull())


def clean(df: DataFrame) -> DataFrame:
    return drop_unusable(clean_keys(coerce_dates(coerce_numeric(validate_columns(df)))))


def require_rows(df: DataFrame) -> DataFrame:
    """Edge check for an upload: an empty dataset is rejected (one action)."""
    if df.isEmpty():
        raise DatasetError("No usable rows: every row is missing a booking date or customer.")
    return df
