"""Small fixtures: odd rows that every operator must handle."""
from __future__ import annotations

from pyspark.sql import functions as F

ODD_TEXTS = [
    None, "", "   \n\t ", "one", "One two", "the and of", "x" * 20_000, "naïve Ünïcode 中文 🙂 İstanbul Σας",
    "<|endoftext|> it's we'LL\r\n tab\there  double", " lead and trail ", "a\n\nb\n\na\n\nb",
    "word " * 3_000, "mail bob.x@mail.example.com or +1 (859) 555-5433 or 4111111111111111 or 10.0.0.1 now",
]


def odd_documents(spark, more=()):
    """The odd texts twice (repeated rows), a repeated id, a null id, and
    columns whose names clash with those that operators make."""
    texts = [*ODD_TEXTS, *ODD_TEXTS, *more]
    rows = [(i, t, "en" if i % 3 else None, f"src{i % 2}" if i % 5 else None, len(t) if t else 0)
            for i, t in enumerate(texts)]
    rows += [(3, "one", "en", "src1", 3), (3, "another text", "en", "src1", 12), (None, "no id at all", "en", "src1", 12)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for c in ("id", "body", "n_tokens", "key", "sig", "piece", "length", "q__body", "word", "start", "html", "rank"):
        df = df.withColumn(c, F.lit("clash"))
    return df


def empty_like(df):
    return df.limit(0)
