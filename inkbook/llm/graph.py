"""Connected components of links that do not fit one machine."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkbook.llm import common


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One star step on edges (a, b), a > b. Large: every node hands its larger
    neighbours its least one (itself included). Small: it hands its smaller
    neighbours, and itself, its least one. A node's neighbours are reduced by a
    partially aggregated minimum, never gathered."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        both = both.union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    least = least.select("u", F.least("m", "u").alias("m"))
    joined = both.join(least, "u")
    if large:
        out = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("v").alias("a"), F.col("m").alias("b")) \
            .union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.where(F.col("a") != F.col("b")).distinct()


def components(links: DataFrame, left: str, right: str) -> DataFrame:
    """(node, root) of every linked node: the least node of its component, by
    alternating large-star and small-star until the edges stay the same. Each
    step is a stored table, so a lost executor costs at most one step."""
    edges = common.store(links.select(F.greatest(left, right).alias("a"), F.least(left, right).alias("b"))
                         .where("a != b").distinct(), "links")
    mark = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
    while mark[0]:
        edges = common.store(_stars(_stars(edges, True), False), "links")
        new = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if new == mark:
            break
        mark = new
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        edges.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
