"""Random texts and small tables for the corpus operators."""

from __future__ import annotations

import random

from pyspark.sql import types as T

DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
])
WORDS = [a + b for a in ("ka", "lo", "mi", "nu", "re", "sta", "ti", "vo", "za", "he") for b in ("", "n", "ra", "del", "po", "sk")]


def docs(spark, rows):
    """Documents from ``(doc_id, text)``; the other columns are null."""
    return spark.createDataFrame([(i, t, None, None, None) for i, t in rows], DOCS)


def prose(seed: int, words: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(words))


def edited(text: str, seed: int, edits: int) -> str:
    rng, words = random.Random(seed), text.split(" ")
    for at in rng.sample(range(len(words)), edits):
        words[at] = f"new{seed}x{at}"
    return " ".join(words)


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)
