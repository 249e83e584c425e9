"""Pair scorers on Spark ML, pair mining and error reports."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from itertools import product

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinfold.operators import stats

#: Columns that tell the label and may never be features.
BANNED = frozenset("label is_match cluster_id entity_role n_matches n_true rank_found matched_entity_id source1_entity_id has_cross group_id stratum match_bucket is_singleton".split())


def check_features(columns: Sequence[str]) -> None:
    if leak := BANNED & set(columns):
        raise ValueError(f"label-bearing features: {sorted(leak)}")


def filled(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Missing values as -1 with a flag of their own; trees and margins know no null."""
    return df.withColumns({f"{c}__null": F.col(c).isNull().cast("double") for c in columns} | {f"{c}__f": F.coalesce(F.col(c).cast("double"), F.lit(-1.0)) for c in columns})


def assemble(numeric: Sequence[str], categories: Sequence[str]) -> list:
    check_features([*numeric, *categories])
    indexers = [StringIndexer(inputCol=c, outputCol=f"{c}__i", handleInvalid="keep") for c in categories]
    inputs = [f"{c}{s}" for c in numeric for s in ("__f", "__null")] + [f"{c}__i" for c in categories]
    return [*indexers, VectorAssembler(inputCols=inputs, outputCol="features")]


def fit_trees(train: DataFrame, dev: DataFrame, numeric: Sequence[str], categories: Sequence[str] = (), rounds: int = 20, depth: int = 4, seed: int = 0) -> PipelineModel:
    """Gradient-boosted trees with early stopping on ``dev``."""
    data = train.withColumn("__dev", F.lit(False)).unionByName(dev.withColumn("__dev", F.lit(True)))
    trees = GBTClassifier(labelCol="label", maxIter=rounds, maxDepth=depth, stepSize=0.1, seed=seed, validationIndicatorCol="__dev")
    return Pipeline(stages=[*assemble(numeric, categories), trees]).fit(filled(data, numeric))


def fit_margin(train: DataFrame, numeric: Sequence[str]) -> PipelineModel:
    """Logistic regression: the light scorer whose raw margin is a logit."""
    return Pipeline(stages=[*assemble(numeric, ()), LogisticRegression(labelCol="label", maxIter=50, regParam=1e-3)]).fit(filled(train, numeric))


def score(model: PipelineModel, df: DataFrame, numeric: Sequence[str], prob: str = "p", logit: str = "logit") -> DataFrame:
    out = model.transform(filled(df, numeric))
    p = vector_to_array("probability")[1]
    safe = F.least(F.greatest(p, F.lit(1e-9)), F.lit(1 - 1e-9))
    return out.withColumn(prob, p).withColumn(logit, F.ln(safe / (1 - safe))).select(*df.columns, prob, logit)


def context_coverage(features: DataFrame, ctx: DataFrame, keys: Sequence[str], least: float = 0.98) -> DataFrame:
    """One row: feature rows, those with a context, and whether their share is at least ``least``."""
    there = ctx.select(*keys).distinct().withColumn("__c", F.lit(True))
    one = features.join(there, list(keys), "left").agg(F.count(F.lit(1)).alias("rows"), F.count("__c").alias("covered"))
    return one.withColumn("enough", F.col("covered") >= least * F.col("rows"))


def join_context(features: DataFrame, ctx: DataFrame, keys: Sequence[str]) -> DataFrame:
    """features LEFT JOIN ctx, failing if ctx repeats a pair."""
    once = ctx.withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    once = once.withColumn("__ok", F.when(F.col("__n") > 1, F.raise_error(F.lit("context repeats a pair"))).otherwise(True)).where("__ok").drop("__n", "__ok")
    return features.join(once, list(keys), "left")


def mine_pairs(pairs: DataFrame, positives: DataFrame, hard: int = 15, hard_rank: int = 30, read: int = 50, random: int = 3) -> DataFrame:
    """Training pairs of each query: its positives, its hardest negatives, a few deeper ones by hash, and positives of the pool that retrieval missed.

    Negatives are numbered by rank; the first ``hard`` are taken where their rank
    is at most ``hard_rank``, the deeper ones come from the rest. positives:
    s1_id, source, cand_id, in_pool; one that isn't in the pool can't be missed.
    """
    pair = ["s1_id", "source", "cand_id"]
    cols = [*pair, "label", "kind"]
    lists = pairs.where(F.col("rank") <= read)
    numbered = lists.where("label = 0").withColumn("__k", F.row_number().over(Window.partitionBy("s1_id").orderBy("rank", "cand_id")))
    tough = numbered.where((F.col("__k") <= hard) & (F.col("rank") <= hard_rank)).withColumn("kind", F.lit("hard"))
    shuffled = Window.partitionBy("s1_id").orderBy(F.md5(F.concat_ws("|", *pair).cast("binary")))
    deep = numbered.where(F.col("__k") > hard).withColumn("__d", F.row_number().over(shuffled)).where(F.col("__d") <= random).withColumn("kind", F.lit("random"))
    good = lists.where("label = 1").withColumn("kind", F.lit("positive"))
    missed = positives.where("in_pool").select(pair).join(lists, pair, "left_anti").withColumns({"label": F.lit(1), "kind": F.lit("missed")})
    out = good.select(cols).unionByName(tough.select(cols)).unionByName(deep.select(cols)).unionByName(missed.select(cols))
    return out.dropDuplicates(pair)


def pair_texts(pairs: DataFrame, s1: DataFrame, pool: DataFrame, native: bool = True) -> DataFrame:
    """pairs with s1_text, cand_text and cross_script; the job fails at the first pair whose record is missing.

    s1 (id) and pool (source, id) hold name_norm, addr_norm, name_script and, for
    the romanised form, name_latin and addr_latin.
    """
    part = lambda c: F.coalesce(F.col(c), F.lit(""))
    plain = F.concat(part("name_norm"), F.lit(" | "), part("addr_norm"))
    text = plain if native else F.concat(plain, F.lit(" | "), part("name_latin"), F.lit(" | "), part("addr_latin"))
    a = s1.select(F.col("id").alias("s1_id"), text.alias("s1_text"), F.col("name_script").alias("__a"))
    b = pool.select("source", F.col("id").alias("cand_id"), text.alias("cand_text"), F.col("name_script").alias("__b"))
    joined = pairs.join(a, "s1_id", "left").join(b, ["source", "cand_id"], "left")
    missing = F.col("s1_text").isNull() | F.col("cand_text").isNull()
    pair = F.concat_ws("|", "s1_id", "source", "cand_id")
    checked = F.when(missing, F.raise_error(F.concat(F.lit("no record for pair "), pair))).otherwise(F.col("s1_text"))
    return joined.withColumn("s1_text", checked).withColumn("cross_script", (F.col("__a") != F.col("__b")).cast("int")).drop("__a", "__b")


def length_limit(lengths: DataFrame, x: str, level: float = 0.99, step: int = 8, most: int = 256) -> DataFrame:
    """One row: p50, p90 and p99 of token lengths, and the length to cut at: ``level``, rounded up to a multiple of ``step``, at most ``most``."""
    found = stats.quantiles(lengths, x, (0.5, 0.9, 0.99, level)).select(*(F.col("q")[i].alias(n) for i, n in enumerate(("p50", "p90", "p99", "__at"))))
    return found.select("p50", "p90", "p99", F.least(F.ceil(F.col("__at") / step) * step, F.lit(most)).cast("bigint").alias("max_len"))


def resolved_params(defaults: dict, tuned: dict | None, given: dict | None, grow: float = 1.25) -> dict:
    """Parameters in force: given ones before tuned before defaults; tuned rounds grow, as the final model sees more rows."""
    out = defaults | (tuned or {})
    if tuned and "rounds" in tuned:
        out["rounds"] = round(tuned["rounds"] * grow)
    return out | (given or {})


def trials(space: dict[str, Sequence], count: int, seed: int = 0) -> list[dict]:
    """``count`` settings of a space in an order by hash, so that a search that stops early has tried a random part of it."""
    every = [dict(zip(space, values, strict=True)) for values in product(*space.values())]
    return sorted(every, key=lambda s: hashlib.md5(f"{seed}|{sorted(s.items())}".encode()).hexdigest())[:count]


def search(train: DataFrame, dev: DataFrame, numeric: Sequence[str], space: dict[str, Sequence], count: int, categories: Sequence[str] = (), seed: int = 0) -> list[tuple[dict, float]]:
    """Settings of boosted trees (rounds, depth) with their area under the precision-recall curve on ``dev``, the best first."""
    found = []
    for setting in trials(space, count, seed):
        model = fit_trees(train, dev, numeric, categories, **setting)
        found.append((setting, stats.average_precision(score(model, dev, numeric), "p", "label").first().pr_auc or 0.0))
    return sorted(found, key=lambda x: (-x[1], sorted(x[0].items())))


def with_texts(examples: DataFrame, texts: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Examples with columns of the raw record (texts: id and columns) that ``key`` names."""
    return examples.join(texts.select(F.col("id").alias(key), *columns), key, "left")


def error_examples(scored: DataFrame, prob: str, threshold: float, n: int) -> DataFrame:
    """The n surest false positives and the n least likely positives, most wrong first."""
    fp = scored.where((F.col("label") == 0) & (F.col(prob) >= threshold)).orderBy(F.desc(prob), "s1_id", "cand_id").limit(n).withColumn("error", F.lit("false positive"))
    fn = scored.where((F.col("label") == 1) & (F.col(prob) < threshold)).orderBy(prob, "s1_id", "cand_id").limit(n).withColumn("error", F.lit("false negative"))
    return fp.unionByName(fn)
