"""Joins on keys of which one may hold a large share of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key with over 1/HOT_SHARE of the rows is hot, so there are fewer than HOT_SHARE of them.
HOT_SHARE = 256


def unused(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have."""
    have = {c.lower() for c in df.columns}
    name = f"__{name}"
    while name in have:
        name += "_"
    return name


def hot_keys(counts: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """Keys with over total / HOT_SHARE rows: fewer than HOT_SHARE rows by construction, so safe to broadcast."""
    return counts.where(F.col(count) * HOT_SHARE > F.lit(total)).where(F.col(key).isNotNull()).select(key)


def hot_left_join(left: DataFrame, right: DataFrame, key: str, hot: DataFrame, on: Column | None = None) -> DataFrame:
    """left LEFT JOIN right on ``key`` (and ``on``), with the rows of hot keys joined where they lie.

    ``right`` holds few rows for a key (one, or a bound its caller states), so its
    part for the hot keys is bounded and broadcast; every other key has at most
    total / HOT_SHARE rows and goes through an ordinary shuffle. Both columns
    named ``key`` are merged; the other names must differ.
    """
    theirs = unused(left, "theirs")
    right = right.withColumnRenamed(key, theirs)
    match = F.col(key) == F.col(theirs) if on is None else (F.col(key) == F.col(theirs)) & on
    few = F.broadcast(hot.select(F.col(key).alias("__hot")))
    there = right.join(few, F.col(theirs) == F.col("__hot"), "left_semi")
    mine = left.join(few, F.col(key) == F.col("__hot"), "left_semi").join(F.broadcast(there), match, "left")
    rest = left.join(few, F.col(key) == F.col("__hot"), "left_anti").join(right, match, "left")
    return mine.unionByName(rest).drop(theirs)
