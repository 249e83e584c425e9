"""Operator 9: mix sources to target weights. DataFrame functions only.

Every row gets a hash-random key of its id and text. The leading bits of the key
are a range partition of its source into buckets; sums by bucket, summed up along
the buckets, give the words before each bucket, and only the bucket in which a
source's budget ends is looked into further: by whole keys, and among rows with
one key (copies with one id, or none) by a random number drawn once for each row.
No group grows with a hot source, or with copies of one row: a bucket holds about
1 / 2**bits of them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinfold.llm.common import hot_keys, hot_left_join, words, written

WEIGHTS = (3, 1, 2)
SHARE = 1.5
CAP = 2.0
#: Bits of the key, and rows a bucket should hold.
KEY_BITS, BUCKET_ROWS = 60, 20_000


def random_key(doc_id: Column, text: Column) -> Column:
    """60 bits that look random and depend on id and text alone, so that reruns agree."""
    digest = F.md5(F.coalesce(text.cast("string"), F.lit("")).cast("binary"))
    ident = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit("|"), digest)
    return F.conv(F.substring(F.md5(ident.cast("binary")), 1, 15), 16, 10).cast("bigint")


def row_number() -> Column:
    """60 bits for each row, random among equal ones; fixed once the rows are written."""
    return F.shiftrightunsigned(F.xxhash64(F.monotonically_increasing_id()), 64 - KEY_BITS)


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """source, source_size -> + target: the weighted share of ``share`` x all sizes, at most ``cap`` x the own size.

    The level at which capped and uncapped targets use up the total is found in
    one pass over the sources in order of the level at which each is capped:
    the first whose level isn't above its own cap fixes it. This table has one
    row for each source and is worked on by one task: a million sources are about
    100 MB.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_level = Window.orderBy("__full_at", "__n")
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_level.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    weight = F.element_at(F.array(*map(F.lit, weights)), F.pmod(F.col("__n") - 1, F.lit(len(weights))).cast("int") + 1)
    return (
        sources.withColumn("__n", F.row_number().over(by_name))
        .withColumn("__w", weight)
        .withColumn("__cap", F.lit(cap) * F.col("source_size"))
        .withColumn("__full_at", F.col("__cap") / F.col("__w"))
        .withColumn("__total", F.lit(share) * F.sum("source_size").over(everything))
        .withColumn("__level", (F.col("__total") - F.coalesce(F.sum("__cap").over(before), F.lit(0.0))) / F.sum("__w").over(rest))
        .withColumn("__place", F.row_number().over(by_level))
        .withColumn("__lambda", F.min_by("__level", F.when(F.col("__level") <= F.col("__full_at"), F.col("__place"))).over(everything))
        .withColumn("target", F.coalesce(F.least("__cap", F.col("__w") * F.col("__lambda")), F.col("__cap")))
        .select(*sources.columns, "target")
    )


def cut_in(rows: DataFrame, plan: DataFrame, level: int, bucket: Column) -> DataFrame:
    """plan with ``__cut<level>``, the bucket in which each source's rest ends, and ``__ahead`` up to that bucket.

    ``rows`` are those in which it ends by the levels before. A source whose rest
    is 0 ends nowhere and gets no cut.
    """
    sums = rows.groupBy("__sid", bucket.alias("__bucket")).agg(F.sum("size").alias("__words"))
    along = Window.partitionBy("__sid").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("__words").over(along), F.lit(0))
    here = sums.withColumn("__inside", before.cast("bigint")).withColumnRenamed("__sid", "__of")
    inside = (F.col("__ahead") + F.col("__inside") < F.col("__rest")) & (F.col("__ahead") + F.col("__inside") + F.col("__words") >= F.col("__rest"))
    joined = plan.join(here, (F.col("__sid") == F.col("__of")) & inside, "left")
    more = joined.withColumns({f"__cut{level}": F.col("__bucket"), "__ahead": F.col("__ahead") + F.coalesce("__inside", F.lit(0))})
    return written(more.drop("__of", "__bucket", "__words", "__inside"), f"mix-plan{level}")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size, source_size, target, taken (and ``keep``) for every row of ``docs`` (doc_id, text, source).

    taken: whole epochs of the source, then rows in key order until its budget,
    the target rounded to words; the row at the cut is taken in part, so a
    source's taken words are its budget exactly.

    Defined cases: a null text has no words and is taken 0 times; a very long text
    counts whole; a null source is a source of its own, last in order; rows with
    one id and different texts have keys of their own, rows with one key are
    ordered at random, and as they are equal that gives the same result rows;
    sources whose targets are capped at one level share the rest by weight all
    the same; an empty table gives an empty result; a source without words has
    target 0. Other columns are left out unless named in ``keep``, which can't
    hold the names of results.
    """
    if clash := {"size", "source_size", "target", "taken"} & set(keep):
        raise ValueError(f"keep names results: {sorted(clash)}")
    fresh = [c for c in keep if c != "doc_id"]
    extra = [F.col(c).alias(f"__keep{i}") for i, c in enumerate(fresh)]
    sid = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("null"))
    mine = docs.select("doc_id", "source", sid.alias("__sid"), words(F.col("text")).alias("size"), random_key(F.col("doc_id"), F.col("text")).alias("__key"), row_number().alias("__row"), *extra)
    rows = written(mine, "mix")
    counts = written(rows.groupBy("source", "__sid").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("__n")), "mix-sources")
    n = counts.agg(F.coalesce(F.sum("__n"), F.lit(0))).first()[0]
    hot = hot_keys(counts, "__sid", "__n", n)
    bits = min(30, max(10, math.ceil(math.log2(max(1, n) / BUCKET_ROWS))))
    high = lambda name: F.shiftright(name, KEY_BITS - bits)
    buckets = (high("__key"), F.col("__key"), high("__row"))

    budget = F.floor(F.col("target") + 0.5).cast("bigint")
    goal = (
        targets(counts.select("source", "__sid", "source_size"), weights, share, cap)
        .withColumn("__epochs", F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("bigint"))
        .withColumn("__rest", budget - F.col("__epochs") * F.col("source_size"))
        .withColumn("__ahead", F.lit(0).cast("bigint"))
        .drop("source")
    )
    plan, slim = written(goal, "mix-goal"), rows.select("__sid", "size", "__key", "__row")
    for level, bucket in enumerate(buckets):
        plan = cut_in(slim, plan, level, bucket)
        if level < len(buckets) - 1:
            # What is left is one bucket of each source, whatever its size.
            inside = hot_left_join(slim, plan.select("__sid", f"__cut{level}"), "__sid", hot).where(bucket == F.col(f"__cut{level}"))
            slim = written(inside.drop(f"__cut{level}"), f"mix-cut{level}")
    return taken(rows, plan, hot, buckets, fresh)


def taken(rows: DataFrame, plan: DataFrame, hot: DataFrame, buckets: tuple[Column, ...], fresh: list[str]) -> DataFrame:
    """Every row with what the mix takes of it, by the cuts of its source's plan."""
    planned = hot_left_join(rows, plan, "__sid", hot)
    before, at_cut = F.lit(False), F.lit(True)
    for i, bucket in enumerate(buckets):
        cut = F.col(f"__cut{i}")
        before |= at_cut & F.coalesce(bucket < cut, F.lit(False))
        at_cut &= F.coalesce(bucket == cut, F.lit(False))
    out = ["doc_id", "size", "source_size", "target", "taken", *(F.col(f"__keep{i}").alias(c) for i, c in enumerate(fresh))]
    planned = planned.withColumn("__before", before).withColumn("__at", at_cut)
    whole = planned.where("NOT __at").withColumn("taken", F.col("__epochs") * F.col("size") + F.when(F.col("__before"), F.col("size")).otherwise(0))
    in_order = Window.partitionBy("__sid").orderBy("__row", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("__rest") - F.col("__ahead") - F.coalesce(F.sum("size").over(in_order), F.lit(0))
    cut = planned.where("__at").withColumn("taken", F.col("__epochs") * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), left)))
    return whole.select(out).unionByName(cut.select(out))


ORACLE = """
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || '|' || md5(coalesce(text, ''))), 1, 15))::BIGINT AS k
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) AS n FROM d GROUP BY source),
w AS (SELECT *, CASE (n - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS w, 2.0::DOUBLE * source_size AS cap FROM s),
l AS (
  SELECT *, cap / w AS full_at, row_number() OVER (ORDER BY cap / w, n) AS place,
         (1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / w, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / (sum(w) OVER (ORDER BY cap / w, n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level
  FROM w),
t AS (SELECT source, source_size, least(cap, w * (SELECT arg_min(level, place) FROM l WHERE level <= full_at)) AS target FROM l),
b AS (SELECT *, floor(target + 0.5)::BIGINT AS budget, CASE WHEN source_size > 0 THEN floor(target + 0.5)::BIGINT // source_size ELSE 0 END AS epochs FROM t),
o AS (
  SELECT d.*, b.source_size, b.target, b.epochs, b.budget - b.epochs * b.source_size AS rest,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
  FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, rest - ahead)))::BIGINT AS taken FROM o
"""
