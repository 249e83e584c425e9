"""Candidate retrieval: gated top-K similarity, coverage and completeness."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinfold.operators import stats, tiles


def vectors(batch: pa.RecordBatch) -> np.ndarray:
    """The vectors (column vec, doubles of one length) of a batch."""
    return batch.column("vec").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def inner_products(k: int) -> tiles.Scorer:
    """The k largest inner products of each query within a block.

    One matrix product finds them; those kept are summed again, each by itself,
    so that equal vectors score alike wherever they lie.
    """

    def of_block(block: pa.RecordBatch) -> Callable:
        rows = vectors(block)

        def answer(queries: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            asked = vectors(queries)
            q, r = tiles.largest(asked @ rows.T, k, 1e-9)
            return q, r, (asked[q] * rows[r]).sum(axis=1)

        return answer

    return of_block


def gated_topk(queries: DataFrame, pool: DataFrame, gate: str, k: int) -> DataFrame:
    """The k best pool records (source, cand_id, vec, gate) for each query (s1_id, vec, gate) within its gate value.

    The score is the inner product in double precision; ties go to the smaller
    (source, cand_id). A gate's pool is searched in blocks, whatever its size;
    vectors must have one length and no null.
    """
    number = F.xxhash64("source", "cand_id")
    vec = F.col("vec").cast("array<double>").alias("vec")
    asked = queries.select(F.col("s1_id").cast("bigint").alias("id"), vec, F.col(gate).alias("gate"))
    rows = pool.select(number.alias("id"), vec, F.col(gate).alias("gate"))
    found = tiles.best_of(asked, rows, "id", F.col("gate"), lambda: inner_products(k))
    named = found.join(pool.select(number.alias("found"), "source", "cand_id", gate), "found")
    best = Window.partitionBy("asking").orderBy(F.desc("score"), "source", "cand_id")
    ranked = named.withColumn("rank", F.row_number().over(best).cast("bigint")).where(F.col("rank") <= k)
    return ranked.select(F.col("asking").alias("s1_id"), "source", "cand_id", gate, "score", "rank")


def label_candidates(candidates: DataFrame, positives: DataFrame, split: str = "train") -> DataFrame:
    """candidates with label: 1 if the pair is positive, else 0; null on the test split."""
    if split == "test":
        return candidates.withColumn("label", F.lit(None).cast("tinyint"))
    known = positives.select("s1_id", "source", "cand_id").distinct().withColumn("__hit", F.lit(True))
    return candidates.join(known, ["s1_id", "source", "cand_id"], "left").withColumn("label", F.col("__hit").isNotNull().cast("tinyint")).drop("__hit")


def positives_sidecar(positives: DataFrame, pool: DataFrame, candidates: DataFrame) -> DataFrame:
    """positives with in_pool and rank_found (0: missed)."""
    pair = ["s1_id", "source", "cand_id"]
    there = pool.select("source", "cand_id").distinct().withColumn("in_pool", F.lit(True))
    out = positives.join(there, ["source", "cand_id"], "left").join(candidates.select(*pair, F.col("rank").alias("rank_found")), pair, "left")
    return out.withColumn("in_pool", F.coalesce("in_pool", F.lit(False))).withColumn("rank_found", F.coalesce("rank_found", F.lit(0)))


def list_sizes(queries: DataFrame, candidates: DataFrame) -> DataFrame:
    """s1_id, n_cands for every query; 0 where the pool was empty."""
    return queries.select("s1_id").join(candidates.groupBy("s1_id").agg(F.count(F.lit(1)).alias("n_cands")), "s1_id", "left").na.fill(0, ["n_cands"])


LEVELS = (0.05, 0.25, 0.5, 0.75, 0.95)


def top1_percentiles(candidates: DataFrame, by: str) -> DataFrame:
    """Percentiles of the best score of each list, exact."""
    first = candidates.where("rank = 1")
    names = [f"p{int(q * 100):02d}" for q in LEVELS]
    return stats.quantiles(first, "score", LEVELS, (by,)).select(by, F.col("n").alias("n_s1"), *(F.col("q")[i].alias(c) for i, c in enumerate(names)))


def coverage_report(expected: DataFrame, produced: DataFrame, k: int) -> DataFrame:
    """One row of counts: queries missing, extra, listed twice, of another gate, with short and with empty lists."""
    mine = produced.groupBy("s1_id").agg(F.count(F.lit(1)).alias("times"), F.first("gate").alias("gate2"), F.max("n_cands").alias("n_cands"))
    both = expected.select("s1_id", "gate", F.lit(True).alias("want")).join(mine, "s1_id", "full")
    return both.agg(
        F.count_if("want").alias("expected"),
        F.count_if(F.col("times").isNull()).alias("missing"),
        F.count_if(F.col("want").isNull()).alias("extra"),
        F.count_if(F.col("times") > 1).alias("duplicate"),
        F.count_if(F.col("gate") != F.col("gate2")).alias("gate_mismatch"),
        F.count_if((F.col("n_cands") > 0) & (F.col("n_cands") < k)).alias("short_lists"),
        F.count_if(F.col("n_cands") == 0).alias("zero_lists"),
    )


def completeness(sidecar: DataFrame, ks: tuple[int, ...], by: str) -> DataFrame:
    """k, by (null: all), pair recall and its mean over queries, one pass for all k and both groupings."""
    hit = (F.col("rank_found") > 0) & (F.col("rank_found") <= F.col("k"))
    each = sidecar.select("s1_id", by, "rank_found", F.explode(F.array(*map(F.lit, ks))).alias("k"))
    per = each.groupBy("k", by, "s1_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(hit).alias("h"))
    return per.groupingSets([[F.col("k"), F.col(by)], [F.col("k")]], F.col("k"), F.col(by)).agg((F.sum("h") / F.sum("n")).alias("pair_recall"), F.avg(F.col("h") / F.col("n")).alias("s1_recall"), F.sum("n").alias("n_pairs"))


def choose_k(recall: DataFrame, target: float = 0.995) -> DataFrame:
    """One row: the smallest k whose pooled recall reaches the target, else the largest."""
    return recall.agg(F.coalesce(F.min(F.when(F.col("pair_recall") >= target, F.col("k"))), F.max("k")).alias("k_final"))


def volume(sizes: DataFrame, ks: tuple[int, ...]) -> DataFrame:
    """k, pairs that lists cut at k hold."""
    return sizes.select(F.explode(F.array(*map(F.lit, ks))).alias("k"), "n_cands").groupBy("k").agg(F.sum(F.least("n_cands", "k")).cast("bigint").alias("n_pairs"))


def weighted_percentiles(parts: DataFrame, by: str, weight: str, columns: tuple[str, ...]) -> DataFrame:
    """Mean of the parts' percentiles, weighted by their queries."""
    return parts.groupBy(by).agg(*((F.sum(F.col(c) * F.col(weight)) / F.sum(weight)).alias(c) for c in columns))


def shard_problems(promised: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """keys, problem of the shards whose stored rows differ from the promised number (n_rows), or that miss on either side."""
    counts = stored.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    both = promised.join(counts, keys, "full")
    problem = F.when(F.col("n_rows").isNull(), "not promised").when(F.col("__n").isNull() & (F.col("n_rows") > 0), "missing").when(F.coalesce("__n", F.lit(0)) != F.col("n_rows"), "other row count")
    return both.select(*keys, problem.alias("problem")).where("problem IS NOT NULL")


def routed(df: DataFrame, country: str, routes: dict[str, str], default: str = "US") -> DataFrame:
    """df with ``route``: the model that serves its country, the default's where it has none of its own."""
    table = F.create_map(*(F.lit(x) for kv in routes.items() for x in kv))
    return df.withColumn("route", F.coalesce(F.try_element_at(table, F.col(country)), F.lit(default)))


def dense_texts(records: DataFrame, prefix: str) -> Column:
    """The text that is embedded: prefix, name, a bar and address; missing parts are empty."""
    part = lambda c: F.coalesce(F.col(c), F.lit(""))
    return F.concat(F.lit(prefix), part("name_norm"), F.lit(" | "), part("addr_norm"))


def hashed_embedding(text: Column, dim: int = 64, size: int = 3) -> Column:
    """A vector of length one from signed hashes of the text's character n-grams (all of it, if shorter); zero for an empty text.

    A model-free stand-in for a sentence encoder, by built-in functions alone; every
    n-gram is hashed once.
    """
    bound = lambda value, then: F.transform(F.array(value), then)[0]  # noqa: E731  what a lambda names is worked out once, what it spells out every time
    grams = lambda low: F.when(F.length(low) < size, F.array(low)).otherwise(F.transform(F.sequence(F.lit(1), F.length(low) - size + 1), lambda i: F.substring(low, i, F.lit(size))))
    # A hash modulo 2 dim: its axis, and dim more for a negative sign.
    place = lambda g: (F.conv(F.substring(F.md5(g.cast("binary")), 1, 8), 16, 10).cast("bigint") % (2 * dim)).cast("int")
    places = lambda low: F.transform(F.filter(grams(low), lambda g: g != ""), place)
    axis = lambda found, i: F.aggregate(found, F.lit(0), lambda s, p: s + F.when(p == i, 1).when(p == i + dim, -1).otherwise(0)).cast("double")
    raw = lambda found: F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: axis(found, i))
    norm = lambda vector: F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x * x))
    unit = lambda vector: bound(norm(vector), lambda n: F.transform(vector, lambda x: F.when(n > 0, x / n).otherwise(0.0)))
    return bound(F.lower(text), lambda low: bound(places(low), lambda found: bound(raw(found), unit)))
