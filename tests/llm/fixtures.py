"""Small tables with nulls, empty and long texts, repeated rows and clashing columns."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

CLASHING = (
    "key _key _id n set_id bucket buckets label score base spans words print start size rate domain copies "
    "token unit licence reference slot blocks html_ url_ own low high component_id n_items p0 _spans"
).split()


def documents(spark, rows, lang=None):
    """``(doc_id, text, lang, source, n_chars)`` and columns whose names operators use inside."""
    full = [(i, t, (lang or {}).get(i), None, None) for i, t in rows]
    df = spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({c: F.lit(c) for c in CLASHING})


def empty(spark):
    return documents(spark, [])


def sentence(rng: random.Random, words: int, vocabulary: int = 5000) -> str:
    return " ".join(f"w{rng.randrange(vocabulary)}x" for _ in range(words))
