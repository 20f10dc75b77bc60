"""Queries of the training-data operators: (spark, sf_dir) -> DataFrame."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from inkbook.llm import (ann, archive, bpe, collocations, common, html_text, importance, jaccard, lm, packing, passages, pii,
                         quality, token_store)

QUERIES = {}


def register(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    common.prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@register
def op1_token_store(spark, sf_dir):
    return token_store.token_store(table(spark, sf_dir, "documents"))


@register
def op8_bpe(spark, sf_dir):
    return bpe.round_trip(table(spark, sf_dir, "documents"))


@register
def op6_packing(spark, sf_dir):
    return packing.pack_documents(table(spark, sf_dir, "documents"))


@register
def op10_archive(spark, sf_dir):
    out = archive.archive_pages(table(spark, sf_dir, "pages"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@register
def op2_html_text(spark, sf_dir):
    return html_text.extract_text(table(spark, sf_dir, "pages"))


@register
def op9_ann(spark, sf_dir):
    return ann.search(table(spark, sf_dir, "embeddings"))


@register
def op5_quality(spark, sf_dir):
    out = quality.judge(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                      "base_failed", "kept")


@register
def op3_jaccard(spark, sf_dir):
    out = jaccard.jaccard_components(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_shingles", "component_id")


@register
def op7_lm(spark, sf_dir):
    return lm.score_texts(table(spark, sf_dir, "documents"))


@register
def op4_pii(spark, sf_dir):
    return pii.find(table(spark, sf_dir, "documents"))


@register
def op13_importance(spark, sf_dir):
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@register
def op11_collocations(spark, sf_dir):
    return collocations.collocations(table(spark, sf_dir, "documents"))


@register
def op12_passages(spark, sf_dir):
    return passages.remove_repeats(table(spark, sf_dir, "documents"))
