"""Order statistics without a global sort: prefix sums over range buckets, AUC, KS, Spearman."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The least number of buckets, and rows a bucket should hold.
BUCKETS, BUCKET_ROWS = 64, 200_000


def range_buckets(df: DataFrame, x: str, buckets: int | None = None) -> Column:
    """A bucket number that rises with ``x``, cut at approximate quantiles (one small aggregate job); more buckets for more rows."""
    buckets = buckets or max(BUCKETS, math.ceil(df.count() / BUCKET_ROWS))
    cuts = df.agg(F.approx_percentile(x, F.array(*(F.lit(i / buckets) for i in range(1, buckets))), F.lit(max(1000, 10 * buckets)))).first()[0] or []
    return F.size(F.filter(F.array(*(F.lit(float(c)) for c in sorted(set(cuts)))).cast("array<double>"), lambda c: c <= F.col(x).cast("double")))


def prefix_sums(df: DataFrame, order: list[Column], bucket: Column, sums: dict[str, str], keys: tuple[str, ...] = ()) -> DataFrame:
    """Add ``before_<name>``: the sum of each column over all rows that come earlier.

    Each bucket is summed, the sums are added up along the buckets, and rows are
    ordered within their bucket only; no task sees more than a bucket.
    """
    df = df.withColumn("__bucket", bucket)
    totals = df.groupBy(*keys, "__bucket").agg(*(F.sum(c).alias(f"__t_{n}") for n, c in sums.items()))
    along = Window.partitionBy(*keys).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    ahead = totals.select(*keys, "__bucket", *(F.coalesce(F.sum(f"__t_{n}").over(along), F.lit(0)).alias(f"__a_{n}") for n in sums))
    inside = Window.partitionBy(*keys, "__bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    joined = df.join(ahead, [*keys, "__bucket"])
    added = {f"before_{n}": F.col(f"__a_{n}") + F.coalesce(F.sum(c).over(inside), F.lit(0)) for n, c in sums.items()}
    return joined.withColumns(added).drop("__bucket", *(f"__a_{n}" for n in sums))


def quantiles(df: DataFrame, x: str, levels: Sequence[float], keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, n, q: exact quantiles of ``x`` at ``levels``, interpolated between neighbours, and the rows that have ``x``.

    Rows are counted by value and placed by prefix sums; only the two values round
    each level are kept, so no task holds all values.
    """
    values = df.where(F.col(x).isNotNull()).groupBy(*keys, F.col(x).alias("x")).agg(F.count(F.lit(1)).alias("n"))
    run = prefix_sums(values, [F.col("x")], range_buckets(values, "x"), {"n": "n"}, keys)
    total = values.groupBy(*keys).agg(F.sum("n").alias("__all"))
    joined = run.join(total, list(keys)) if keys else run.join(F.broadcast(total))  # a single row
    places = F.array(*(f(F.lit(float(q)) * (F.col("__all") - 1)).cast("bigint") for q in levels for f in (F.floor, F.ceil)))
    mine = F.filter(F.transform(places, lambda p, i: F.struct(i.alias("i"), p.alias("p"))), lambda e: (e.p >= F.col("before_n")) & (e.p < F.col("before_n") + F.col("n")))
    few = joined.select(*keys, "__all", "x", F.explode(mine).alias("e")).select(*keys, "__all", F.col("e.i").alias("i"), F.col("x").cast("double").alias("x"))
    sides = few.groupBy(*keys, "__all").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda e: e.x).alias("__v"))  # two for each level

    def between(j: int, level: float) -> Column:
        at = F.lit(float(level)) * (F.col("__all") - 1)
        low, high = F.col("__v")[2 * j], F.col("__v")[2 * j + 1]
        return low + (high - low) * (at - F.floor(at))

    return sides.select(*keys, F.col("__all").alias("n"), F.array(*(between(j, q) for j, q in enumerate(levels))).alias("q"))


def by_value(df: DataFrame, x: str, label: str) -> DataFrame:
    """x, n, pos: rows and positives of each distinct value; combined before the exchange."""
    return df.where(F.col(x).isNotNull()).groupBy(F.col(x).alias("x")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("bigint")).alias("pos"))


def auc(df: DataFrame, x: str, label: str) -> DataFrame:
    """One row: auc by average ranks, n and n_pos; null where a class is missing."""
    values = by_value(df, x, label)
    ranked = prefix_sums(values, [F.col("x")], range_buckets(values, "x"), {"n": "n"})
    total = ranked.agg(F.sum("n").alias("n"), F.sum("pos").alias("n_pos"), F.sum(F.col("pos") * (F.col("before_n") + (F.col("n") + 1) / 2)).alias("s"))
    neg = F.col("n") - F.col("n_pos")
    return total.select(F.when((F.col("n_pos") > 0) & (neg > 0), (F.col("s") - F.col("n_pos") * (F.col("n_pos") + 1) / 2) / (F.col("n_pos") * neg)).alias("auc"), "n", "n_pos")


def average_precision(df: DataFrame, x: str, label: str) -> DataFrame:
    """One row: pr_auc by steps of recall (equal scores are one step) and the best F0.5 of any threshold."""
    values = by_value(df, x, label).withColumn("minus", -F.col("x"))
    run = prefix_sums(values, [F.col("minus")], range_buckets(values, "minus"), {"n": "n", "pos": "pos"})
    total = values.agg(F.sum("pos").alias("all_pos"))
    p = (F.col("before_pos") + F.col("pos")) / (F.col("before_n") + F.col("n"))
    r = F.when(F.col("all_pos") > 0, (F.col("before_pos") + F.col("pos")) / F.col("all_pos"))
    f = F.when((F.col("p") > 0) | (F.col("r") > 0), 1.25 * F.col("p") * F.col("r") / (0.25 * F.col("p") + F.col("r")))
    steps = run.join(F.broadcast(total)).withColumn("p", p).withColumn("r", r).withColumn("f", f)
    return steps.agg(F.sum(F.when(F.col("all_pos") > 0, F.col("pos") / F.col("all_pos")) * F.col("p")).alias("pr_auc"), F.max("f").alias("pair_f05_best"))


def ks_two_sample(df: DataFrame, x: str, group: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """For each key: ks (largest distance of the two distributions of x) and null_gap; ``group`` is boolean."""
    g = F.col(group)
    sizes = df.groupBy(*keys).agg(F.count_if(g & F.col(x).isNotNull()).alias("n1"), F.count_if(~g & F.col(x).isNotNull()).alias("n2"), F.abs(F.avg(F.when(g, F.col(x).isNull().cast("double"))) - F.avg(F.when(~g, F.col(x).isNull().cast("double")))).alias("null_gap"))
    values = df.where(F.col(x).isNotNull()).groupBy(*keys, F.col(x).alias("x")).agg(F.count_if(g).alias("c1"), F.count_if(~g).alias("c2"))
    run = prefix_sums(values, [F.col("x")], range_buckets(values, "x"), {"c1": "c1", "c2": "c2"}, keys)
    joined = run.join(F.broadcast(sizes), list(keys)) if keys else run.join(F.broadcast(sizes))
    apart = F.abs((F.col("before_c1") + F.col("c1")) / F.col("n1") - (F.col("before_c2") + F.col("c2")) / F.col("n2"))
    return joined.groupBy(*keys, "n1", "n2", "null_gap").agg(F.max(apart).alias("ks"))


def average_ranks(df: DataFrame, x: str, out: str) -> DataFrame:
    """df with the average rank of x (null values have none)."""
    values = df.where(F.col(x).isNotNull()).groupBy(x).agg(F.count(F.lit(1)).alias("n"))
    ranks = prefix_sums(values, [F.col(x)], range_buckets(values, x), {"n": "n"}).select(F.col(x).alias("__x"), (F.col("before_n") + (F.col("n") + 1) / 2).alias(out))
    return df.join(ranks, F.col(x) == F.col("__x"), "left").drop("__x")


def univariate_scan(df: DataFrame, features: Sequence[str], label: str, suspect: float = 0.99) -> DataFrame:
    """feature, auc, ap, n, suspect: direction-free AUC and average precision of each feature alone."""
    out = None
    for x in features:
        either = auc(df, x, label).select("n", F.greatest("auc", 1 - F.col("auc")).alias("auc"))
        row = either.join(F.broadcast(average_precision(df.where(F.col(x).isNotNull()), x, label).select(F.col("pr_auc").alias("ap"))))  # single rows
        row = row.select(F.lit(x).alias("feature"), "auc", "ap", "n", (F.col("auc") >= suspect).alias("suspect"))
        out = row if out is None else out.unionByName(row)
    return out


def category_means(df: DataFrame, category: str, label: str) -> DataFrame:
    """value, n, mean of the label: what a category tells of it."""
    return df.groupBy(F.col(category).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col(label).cast("double")).alias("mean"))


def redundant_pairs(df: DataFrame, features: Sequence[str], limit: float = 0.97) -> DataFrame:
    """a, b, rho of the features whose rank correlation is ``limit`` or more either way."""
    out = None
    for i, a in enumerate(features):
        for b in features[i + 1 :]:
            row = spearman(df, a, b).select(F.lit(a).alias("a"), F.lit(b).alias("b"), "rho")
            out = row if out is None else out.unionByName(row)
    return out.where(F.abs("rho") >= limit)


def group_percentiles(df: DataFrame, by: str, features: Sequence[str]) -> DataFrame:
    """by, feature, p50, p90: a look at groups without labels."""
    out = None
    for x in features:
        row = quantiles(df, x, (0.5, 0.9), (by,)).select(by, F.lit(x).alias("feature"), F.col("q")[0].alias("p50"), F.col("q")[1].alias("p90"))
        out = row if out is None else out.unionByName(row)
    return out


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: rank correlation of two columns over the rows that have both."""
    both = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(a, b)
    return average_ranks(average_ranks(both, a, "__ra"), b, "__rb").agg(F.corr("__ra", "__rb").alias("rho"))


def hash_unit(x: Column) -> Column:
    """A number in [0, 1) from an id, the same in any engine: eight hex digits of its MD5, modulo a million."""
    return F.pmod(F.conv(F.substring(F.md5(x.cast("string").cast("binary")), 1, 8), 16, 10).cast("bigint"), F.lit(1_000_000)) / 1_000_000
