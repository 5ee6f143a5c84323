"""Small tables with everything that may go wrong in them."""

from __future__ import annotations

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"

WORDS = "the of and in to that is for river stone market garden winter letter morning captain window silver bridge harbor forest candle village teacher music summer".split()


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) for _ in range(n))


def documents(spark, texts, lang="en", source="s0"):
    rows = [(i, t, lang, source, len(t or "")) if not isinstance(t, tuple) else t for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def awkward(spark):
    """Nulls in every column, empty and white texts, ties, repeated rows, a long text, and columns that operators also use."""
    long = prose(1, 30_000)
    rows = [
        (0, prose(2, 80), "en", "a", 1), (1, prose(2, 80), "en", "a", 1), (1, prose(2, 80), "en", "a", 1), (2, None, "en", None, None), (3, "", None, "a", 0),
        (4, " \t\n", "en", "a", 3), (5, long, "fr", "b", len(long)), (None, prose(3, 60), "en", "a", 5), (6, "x", None, None, 1), (7, "é" * 70 + "\0" + "🙂 " * 40, "en", "a", 9),
        (8, "a" * 5000, "en", "a", 9), (9, long, "fr", "b", len(long)),
    ]
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, DOCS)
    for name in ("id", "n", "score", "kept", "label", "key", "task", "grp", "refers_to", "length", "html", "url", "found", "sha", "size"):
        df = df.withColumn(name, F.lit("clash"))
    return df


def by_id(df, *names):
    return {r["doc_id"]: tuple(r[n] for n in names) for r in df.collect()}
