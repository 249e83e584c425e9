"""Metric, threshold and policy queries over retrieved candidates; a candidate is true if its label is the query's."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.operators import evaluate, stats
from kinfold.plans.retrieval import TOPK_SQL, topk
from kinfold.session import table

GRID = [round(0.02 * i, 2) for i in range(41)]


def universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fifth vector asks; its true matches are the candidates of its label that lie in the pool, capped by a rule of ids."""
    return table(spark, sf_dir, "embeddings").where("vec_id % 5 = 0").select(F.col("vec_id").alias("s1_id"), F.pmod("vec_id", F.lit(3)).alias("country"), F.when(F.col("vec_id") % 4 == 0, 0).otherwise(F.lit(6)).cast("bigint").alias("n_true"))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates with label (never for queries without true matches) and a probability."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("v"), F.col("label").alias("l"))
    q = e.select(F.col("v").alias("s1_id"), F.col("l").alias("ql"))
    c = e.select(F.col("v").alias("cand_id"), F.col("l").alias("cl"))
    label = ((F.col("ql") == F.col("cl")) & (F.col("s1_id") % 4 != 0)).cast("bigint")
    return topk(spark, sf_dir).join(q, "s1_id").join(c, "cand_id").withColumn("label", label).withColumn("p", F.round(F.col("score") + F.col("label") * 0.15, 6)).drop("ql", "cl")


PAIRS = f"""{TOPK_SQL},
pairs AS (SELECT t.*, (q.label = c.label AND t.s1_id % 4 <> 0)::BIGINT AS label, round(t.score + (q.label = c.label AND t.s1_id % 4 <> 0)::BIGINT * 0.15::DOUBLE, 6) AS p
  FROM topk t JOIN embeddings q ON q.vec_id = t.s1_id JOIN embeddings c ON c.vec_id = t.cand_id),
universe AS (SELECT vec_id AS s1_id, vec_id % 3 AS country, CASE WHEN vec_id % 4 = 0 THEN 0 ELSE 6 END AS n_true FROM embeddings WHERE vec_id % 5 = 0)"""
F05 = "CASE WHEN n_true = 0 THEN (n_pred = 0)::DOUBLE WHEN tp > 0 THEN 1.25 * (tp / n_pred) * (tp / n_true) / (0.25 * (tp / n_pred) + tp / n_true) ELSE 0 END"


def per_query_sql(rule: str, pairs: str = "pairs") -> str:
    return f"""counts AS (SELECT s1_id, count(*) FILTER ({rule}) AS n_pred, count(*) FILTER (({rule}) AND label = 1) AS tp FROM {pairs} GROUP BY s1_id),
f AS (SELECT s1_id, country, n_true, n_pred, tp, {F05} AS f FROM (SELECT u.*, coalesce(n_pred, 0)::DOUBLE AS n_pred, coalesce(tp, 0)::DOUBLE AS tp FROM universe u LEFT JOIN counts c ON u.s1_id = c.s1_id))"""


def s1_macro_f05(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = evaluate.per_query(universe(spark, sf_dir), pairs(spark, sf_dir), F.col("p") >= 0.45)
    return out.select("s1_id", "n_true", "n_pred", "tp", F.round("f", 6).alias("f05"))


def slices_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = evaluate.slices(evaluate.per_query(universe(spark, sf_dir), pairs(spark, sf_dir), F.col("p") >= 0.45), "country")
    return out.select("country", F.col("singleton").cast("bigint").alias("singleton"), F.round("s1_macro_f05", 6).alias("s1_macro_f05"), "n_s1", F.round("accepted_per_s1", 6).alias("accepted_per_s1"), "singletons_with_false_accept")


def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = evaluate.threshold_curve(universe(spark, sf_dir), pairs(spark, sf_dir), "p", GRID)
    return out.select(F.round("threshold", 6).alias("threshold"), F.round("s1_macro_f05", 6).alias("s1_macro_f05"))


SWEEP = f"""WITH {PAIRS}, g AS (SELECT round(i * 0.02, 2)::DOUBLE AS t FROM range(41) r(i)),
c AS (SELECT t, u.s1_id, u.n_true, count(*) FILTER (p >= t)::DOUBLE AS n_pred, count(*) FILTER (p >= t AND label = 1)::DOUBLE AS tp FROM g CROSS JOIN universe u LEFT JOIN pairs USING (s1_id) GROUP BY ALL)
SELECT t AS threshold, round(avg({F05}), 6) AS s1_macro_f05 FROM c GROUP BY t"""


def best_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, f = evaluate.best_threshold(universe(spark, sf_dir), pairs(spark, sf_dir), "p")
    return spark.createDataFrame([(round(t, 6), round(f, 6))], "threshold double, s1_macro_f05 double")


def best_grid_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best of the fixed grid, the lowest of equals."""
    return threshold_sweep(spark, sf_dir).orderBy(F.desc("s1_macro_f05"), "threshold").limit(1)


def pr_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = stats.average_precision(pairs(spark, sf_dir), "p", "label")
    return out.select(F.round("pr_auc", 6).alias("pr_auc"), F.round("pair_f05_best", 6).alias("pair_f05_best"))


PR = f"""WITH {PAIRS}, v AS (SELECT p AS x, count(*) AS n, sum(label) AS pos FROM pairs GROUP BY p),
r AS (SELECT x, pos, sum(pos) OVER w / sum(n) OVER w AS pr, sum(pos) OVER w / (sum(pos) OVER ()) AS re, pos / (sum(pos) OVER ()) AS step FROM v WINDOW w AS (ORDER BY x DESC))
SELECT round(sum(step * pr), 6)::DOUBLE AS pr_auc, round(max(CASE WHEN pr > 0 OR re > 0 THEN 1.25 * pr * re / (0.25 * pr + re) END), 6)::DOUBLE AS pair_f05_best FROM r"""


def hit_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = pairs(spark, sf_dir)
    out = evaluate.hit_at(d, F.col("rank"), "retrieval").unionByName(evaluate.hit_at(d, F.desc("p"), "model"))
    return out.select("order_by", F.round("hit_at_1", 6).alias("hit_at_1"), F.round("hit_at_3", 6).alias("hit_at_3"), "n_s1")


def hit_sql(name: str, order: str) -> str:
    return f"SELECT '{name}' AS order_by, round(avg(h1), 6) AS hit_at_1, round(avg(h3), 6) AS hit_at_3, count(*) AS n_s1 FROM (SELECT s1_id, max(CASE WHEN k = 1 THEN label END) AS h1, max(CASE WHEN k <= 3 THEN label END) AS h3 FROM (SELECT *, row_number() OVER (PARTITION BY s1_id ORDER BY {order}, rank) AS k FROM pairs) GROUP BY s1_id HAVING max(label) = 1)"


def policy_thr_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = pairs(spark, sf_dir).withColumn("acc", evaluate.policy("thr_top", 0.45, 0.35))
    return d.select("s1_id", "source", "cand_id", F.col("acc").cast("bigint").alias("acc"))


def weak_single_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = evaluate.weak_single_empty(pairs(spark, sf_dir).withColumn("acc", evaluate.policy("thr_top", 0.45, 0.35)), 0.45)
    return d.select("s1_id", "source", "cand_id", F.col("acc").cast("bigint").alias("acc"))


TOPPED = "acc AS (SELECT *, (p >= 0.45 OR (p = max(p) OVER (PARTITION BY s1_id) AND p >= 0.35)) AS a FROM pairs)"
WEAK = f"""WITH {PAIRS}, {TOPPED}
SELECT s1_id, source, cand_id, (a AND NOT (count(*) FILTER (a) OVER q = 1 AND max(CASE WHEN a THEN p END) OVER q < 0.45))::BIGINT AS acc FROM acc WINDOW q AS (PARTITION BY s1_id)"""


def crossfit_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, _ = evaluate.crossfit(universe(spark, sf_dir), pairs(spark, sf_dir).drop("source", "gate"), (stats.hash_unit(F.col("s1_id")) * 2).cast("int"))
    return out.select("s1_id", "n_true", "n_pred", "tp", F.round("f", 6).alias("f05"))


def paired_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    u, d = universe(spark, sf_dir), pairs(spark, sf_dir)
    out = evaluate.paired_bootstrap(evaluate.per_query(u, d, F.col("score") >= 0.45), evaluate.per_query(u, d, F.col("p") >= 0.45))
    return out.select(*(F.round(c, 6).alias(c) for c in ("delta", "low", "high", "p_not_better")), "verdict")


QUERIES = {f.__name__: f for f in (s1_macro_f05, slices_grouping_sets, threshold_sweep, best_grid_threshold, best_threshold, pr_auc, hit_at_k, policy_thr_top, weak_single_empty, crossfit_policy, paired_bootstrap)}
ORACLE = {
    "s1_macro_f05": f"WITH {PAIRS}, {per_query_sql('p >= 0.45')} SELECT s1_id, n_true, n_pred::BIGINT AS n_pred, tp::BIGINT AS tp, round(f, 6) AS f05 FROM f",
    "slices_grouping_sets": f"WITH {PAIRS}, {per_query_sql('p >= 0.45')}, g AS (SELECT *, (n_true = 0)::BIGINT AS singleton FROM f) SELECT country, singleton, round(avg(f), 6) AS s1_macro_f05, count(*) AS n_s1, round(avg(n_pred), 6) AS accepted_per_s1, count(*) FILTER (n_true = 0 AND n_pred > 0) AS singletons_with_false_accept FROM g GROUP BY GROUPING SETS ((country, singleton), (country), (singleton), ())",
    "threshold_sweep": SWEEP,
    "best_grid_threshold": f"SELECT * FROM ({SWEEP}) ORDER BY s1_macro_f05 DESC, threshold LIMIT 1",
    "pr_auc": PR,
    "hit_at_k": f"WITH {PAIRS} {hit_sql('retrieval', 'rank')} UNION ALL {hit_sql('model', 'p DESC')}",
    "policy_thr_top": f"WITH {PAIRS}, {TOPPED} SELECT s1_id, source, cand_id, a::BIGINT AS acc FROM acc",
    "weak_single_empty": WEAK,
}
