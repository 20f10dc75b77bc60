"""Computed briefs as documents and as the audit's rows.

A brief is one row per (report_id, area) with nested fields, or rows (section,
ordinal, field, text), the form that the audit and the merge read. ``nest`` and
``unnest`` turn one into the other; as JSON a document is stored and reopened
with one read. A brief holds as many elements as its area has rows to show."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkbook.operators.textaudit import BRIEF_KEYS

# The nested form.
METRIC = ["label", "value", "sublabel"]
HERO = ["value", "caption", "body"]
ROW = ["category", "description", "value", "share"]
ACTION = ["title", "badge", "tone", "body"]


def _struct(fields: list[str]) -> str:
    return "struct<" + ", ".join(f"{f}: string" for f in fields) + ">"


DOCUMENT_SCHEMA = (f"title string, metrics array<{_struct(METRIC)}>, hero {_struct(HERO)}, "
                   f"breakdown struct<title: string, columns: array<string>, rows: array<{_struct(ROW)}>>, "
                   f"actions struct<title: string, items: array<{_struct(ACTION)}>>")


def computed_rows(metrics: DataFrame, breakdown: DataFrame) -> DataFrame:
    """The audit's rows of ``brief_metrics`` (with its sublabels) and
    ``brief_breakdown``, both by report_id. The headline figure is the first
    metric; rows without an ordinal are numbered by category."""
    def rows(df, section, fields):
        pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(c).cast("string").alias("text"))
                                    for f, c in fields.items()])).alias("_x")
        return df.select(*BRIEF_KEYS, F.lit(section).alias("section"), F.col("_o").cast("int").alias("ordinal"), pairs) \
            .select(*BRIEF_KEYS, "section", "ordinal", "_x.*").filter(F.col("text").isNotNull())

    places = metrics.withColumn("_o", F.col("ordinal") - 1)
    head = places.filter("_o = 0").withColumn("_o", F.lit(None))
    # an area's rows are those of one table of a page
    order = Window.partitionBy(*BRIEF_KEYS).orderBy(F.col("ordinal").asc_nulls_first(), "category")
    table = breakdown.withColumn("_o", F.row_number().over(order) - 1)
    return rows(places, "metrics", {"label": "label", "value": "value_text", "sublabel": "sublabel"}) \
        .unionByName(rows(head, "hero", {"value": "value_text"})) \
        .unionByName(rows(table, "breakdown", {"category": "category", "value": "value_text", "share": "share_text"}))


def nest(rows: DataFrame) -> DataFrame:
    """One document per (report_id, area)."""
    # the elements of the lists, one row each
    fields = sorted({*METRIC, *HERO, *ROW, *ACTION, "text"})
    parts = rows.groupBy(*BRIEF_KEYS, "section", "ordinal").agg(
        *[F.max(F.when(F.col("field") == f, F.col("text"))).alias(f) for f in fields])

    def only(section, field):
        return F.max(F.when((F.col("section") == section) & F.col("ordinal").isNull(), F.col(field)))

    def elements(section, names):
        one = F.struct("ordinal", *names)
        mine = (F.col("section") == section) & F.col("ordinal").isNotNull()
        found = F.array_sort(F.collect_list(F.when(mine, one)))
        return F.transform(found, lambda x: x["text"] if names == ["text"] else F.struct(*[x[n].alias(n) for n in names]))
    return parts.groupBy(*BRIEF_KEYS).agg(
        only("title", "text").alias("title"), elements("metrics", METRIC).alias("metrics"),
        F.struct(*[only("hero", f).alias(f) for f in HERO]).alias("hero"),
        F.struct(only("breakdown", "title").alias("title"), elements("columns", ["text"]).alias("columns"),
                 elements("breakdown", ROW).alias("rows")).alias("breakdown"),
        F.struct(only("actions", "title").alias("title"), elements("actions", ACTION).alias("items")).alias("actions"))


def unnest(documents: DataFrame) -> DataFrame:
    """The audit's rows of nested briefs; empty fields have none."""
    def entry(section, ordinal, field, text):
        return F.struct(F.lit(section).alias("section"), ordinal.cast("int").alias("ordinal"),
                        F.lit(field).alias("field"), text.alias("text"))
    none = F.lit(None)

    def many(column, section, names):
        def of(x, i):
            return F.array(*[entry(section, i, n, x if names == ["text"] else x[n]) for n in names])
        return F.coalesce(F.flatten(F.transform(column, of)), F.array().cast(kind))
    kind = "array<struct<section: string, ordinal: int, field: string, text: string>>"
    single = F.array(entry("title", none, "text", F.col("title")), *[entry("hero", none, f, F.col(f"hero.{f}")) for f in HERO],
                     entry("breakdown", none, "title", F.col("breakdown.title")),
                     entry("actions", none, "title", F.col("actions.title")))
    every = F.concat(single, many(F.col("metrics"), "metrics", METRIC),
                     many(F.col("breakdown.columns"), "columns", ["text"]),
                     many(F.col("breakdown.rows"), "breakdown", ROW), many(F.col("actions.items"), "actions", ACTION))
    return documents.select(*BRIEF_KEYS, F.explode(F.filter(every, lambda e: e["text"].isNotNull())).alias("_e")) \
        .select(*BRIEF_KEYS, "_e.*")


def to_json(documents: DataFrame) -> DataFrame:
    """(report_id, area, json): what ``write_payload`` stores."""
    rest = [c for c in documents.columns if c not in BRIEF_KEYS]
    return documents.select(*BRIEF_KEYS, F.to_json(F.struct(*rest)).alias("json"))


def from_json(stored: DataFrame) -> DataFrame:
    """The documents of ``to_json`` again."""
    return stored.select(*BRIEF_KEYS, F.from_json("json", DOCUMENT_SCHEMA).alias("_d")).select(*BRIEF_KEYS, "_d.*")
