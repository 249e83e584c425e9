"""Hashed embeddings against plain Python, and what they cost."""

import hashlib
import math

import pytest
from pyspark.sql import functions as F

from kinfold.operators import blocking


def plain(text, dim, size=3):
    low = (text or "").lower()
    v = [0.0] * dim
    for g in [low] if len(low) < size else [low[i : i + size] for i in range(len(low) - size + 1)]:
        if g:
            h = int(hashlib.md5(g.encode()).hexdigest()[:8], 16)
            v[h % dim] += 1.0 if h // dim % 2 == 0 else -1.0
    norm = math.sqrt(sum(x * x for x in v))
    return [x / norm if norm else 0.0 for x in v]


def test_embeddings_equal_plain_python(spark):
    texts = ["Large ring SARL", "", None, "ab", "é", "\U0001f600 straße नमस्ते", "aaaa aaaa", "x" * 500 + " a long one"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    for dim in (8, 64):
        for r in df.select("id", blocking.hashed_embedding(F.col("text"), dim).alias("v")).collect():
            assert r.v == pytest.approx(plain(texts[r.id], dim), abs=1e-12)


def test_every_gram_is_hashed_once(spark):
    """The hash stands once in the plan, outside the lambdas over axes and components."""
    df = spark.createDataFrame([("a",)], "text string").select(blocking.hashed_embedding(F.col("text")).alias("v"))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("md5(") == 1
