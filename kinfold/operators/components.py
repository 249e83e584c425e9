"""Connected components by alternating stars over edge tables in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.operators.joins import hot_keys, hot_left_join
from kinfold.session import written


def _with_least(edges: DataFrame) -> DataFrame:
    """edges (u, v) with ``m``, the least v of each u. A hot u keeps its rows in place."""
    least = written(edges.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")), "cc-least")
    total = least.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return hot_left_join(edges, least.select("u", "m"), "u", hot_keys(least, "u", "n", total))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): root is the least node reachable.

    Large stars hang every larger neighbour of a node on the least of its
    neighbourhood, small stars every smaller one; the edges become stars round
    the roots in a number of rounds that grows with the logarithm of the nodes.
    Loops and repeated edges do no harm; no edges give no rows.
    """
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "cc")
    mark = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(written(both, "cc-both")).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
        down = written(large.where("u <> v").distinct(), "cc-large")  # every u hangs on smaller ones
        hang = F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))
        small = _with_least(down).select(F.explode(hang).alias("e")).select("e.u", "e.v")
        now = written(small.where("u <> v").distinct(), "cc")
        last, mark = mark, now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == last:
            roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
            return roots.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
