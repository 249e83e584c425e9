"""Retrieval queries over ``embeddings``: every fifth vector asks, the rest answer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.operators import blocking
from kinfold.session import table

K = 5


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").where("vec_id % 5 = 0").select(F.col("vec_id").alias("s1_id"), F.col("embedding").alias("vec"), F.pmod("vec_id", F.lit(2)).alias("gate"))


def pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").where("vec_id % 5 <> 0").select(F.when(F.col("vec_id") % 5 <= 2, "S2").otherwise("S3").alias("source"), F.col("vec_id").alias("cand_id"), F.col("embedding").alias("vec"), F.pmod("vec_id", F.lit(2)).alias("gate"))


def topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = blocking.gated_topk(asked(spark, sf_dir), pool(spark, sf_dir), "gate", K)
    return found.withColumn("score", F.round("score", 6))


TOPK_SQL = f"""
dots AS MATERIALIZED (
  SELECT q.vec_id AS s1_id, CASE WHEN p.vec_id % 5 <= 2 THEN 'S2' ELSE 'S3' END AS source, p.vec_id AS cand_id, q.vec_id % 2 AS gate,
         list_sum(list_transform(list_zip(q.embedding, p.embedding), lambda z: z[1]::DOUBLE * z[2]::DOUBLE)) AS score
  FROM embeddings q JOIN embeddings p ON q.vec_id % 2 = p.vec_id % 2
  WHERE q.vec_id % 5 = 0 AND p.vec_id % 5 <> 0),
topk AS (
  SELECT * REPLACE (round(score, 6) AS score) FROM (SELECT *, row_number() OVER (PARTITION BY s1_id ORDER BY score DESC, source, cand_id) AS rank FROM dots)
  WHERE rank <= {K})"""

QUERIES = {"blocking_topk": topk}
ORACLE = {"blocking_topk": f"WITH {TOPK_SQL} SELECT s1_id, source, cand_id, gate, score, rank FROM topk"}

KS = (1, 2, 3, 5)


def positives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """True pairs: the queries' neighbours by id with the same gate that lie in the pool, every third missing."""
    near = F.explode(F.array(*(F.lit(d) for d in range(-40, 41, 2)))).alias("d")
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("cand_id"), F.col("label").alias("cl"))
    q = table(spark, sf_dir, "embeddings").where("vec_id % 5 = 0").select(F.col("vec_id").alias("s1_id"), F.col("label").alias("ql"), near)
    out = q.withColumn("cand_id", F.col("s1_id") + F.col("d")).join(e, "cand_id").where("ql = cl AND cand_id <> s1_id AND (s1_id + cand_id) % 3 <> 0")
    return out.select("s1_id", F.when(F.col("cand_id") % 5 <= 2, "S2").otherwise("S3").alias("source"), "cand_id", F.pmod("s1_id", F.lit(4)).alias("bucket"))


POSITIVES = """pos AS (SELECT q.vec_id AS s1_id, CASE WHEN c.vec_id % 5 <= 2 THEN 'S2' ELSE 'S3' END AS source, c.vec_id AS cand_id, q.vec_id % 4 AS bucket
  FROM embeddings q JOIN embeddings c ON abs(c.vec_id - q.vec_id) <= 40 AND (c.vec_id - q.vec_id) % 2 = 0 AND c.vec_id <> q.vec_id AND q.label = c.label
  WHERE q.vec_id % 5 = 0 AND (q.vec_id + c.vec_id) % 3 <> 0),
side AS (SELECT p.*, p.cand_id % 5 <> 0 AS in_pool, coalesce(t.rank, 0) AS rank_found FROM pos p LEFT JOIN topk t ON p.s1_id = t.s1_id AND p.source = t.source AND p.cand_id = t.cand_id)"""


def sidecar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocking.positives_sidecar(positives(spark, sf_dir), pool(spark, sf_dir), topk(spark, sf_dir))


def positives_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sidecar(spark, sf_dir).select("s1_id", "source", "cand_id", F.col("in_pool").cast("bigint").alias("in_pool"), F.col("rank_found").cast("bigint").alias("rank_found"))


def missed_positives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return positives_found(spark, sf_dir).where("rank_found = 0 OR rank_found > 3").select("s1_id", "source", "cand_id")


def candidate_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocking.label_candidates(topk(spark, sf_dir), positives(spark, sf_dir)).select("s1_id", "source", "cand_id", "rank", F.col("label").cast("bigint").alias("label"))


def blocking_recall_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = blocking.completeness(sidecar(spark, sf_dir), KS, "bucket")
    return out.select(F.col("k").cast("bigint").alias("k"), "bucket", F.round("pair_recall", 6).alias("pair_recall"), F.round("s1_recall", 6).alias("s1_recall"), "n_pairs")


RECALL = f"""WITH {TOPK_SQL}, {POSITIVES}, p AS (SELECT k, bucket, s1_id, count(*) AS n, count(*) FILTER (rank_found > 0 AND rank_found <= k) AS h FROM side CROSS JOIN (SELECT unnest([1, 2, 3, 5])::BIGINT AS k) GROUP BY ALL)
SELECT k, bucket, round(sum(h) / sum(n), 6) AS pair_recall, round(avg(h / n), 6) AS s1_recall, sum(n)::BIGINT AS n_pairs FROM p GROUP BY GROUPING SETS ((k, bucket), (k))"""


def choose_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocking.choose_k(blocking_recall_at_k(spark, sf_dir).where("bucket IS NULL"), 0.03)


def sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """List sizes; every 35th query gets no list and every 45th a short one, so that reports have something to report."""
    lists = topk(spark, sf_dir).where("s1_id % 35 <> 0 AND NOT (s1_id % 45 = 0 AND rank > 2)")
    return blocking.list_sizes(asked(spark, sf_dir), lists)


SIZES = "sizes AS (SELECT q.vec_id AS s1_id, count(t.s1_id) AS n_cands FROM embeddings q LEFT JOIN topk t ON q.vec_id = t.s1_id AND t.s1_id % 35 <> 0 AND NOT (t.s1_id % 45 = 0 AND t.rank > 2) WHERE q.vec_id % 5 = 0 GROUP BY q.vec_id)"


def volume_by_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocking.volume(sizes(spark, sf_dir), KS).withColumn("k", F.col("k").cast("bigint"))


def coverage_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = sizes(spark, sf_dir).withColumn("gate", F.when(F.col("s1_id") % 70 == 0, 1 - F.pmod("s1_id", F.lit(2))).otherwise(F.pmod("s1_id", F.lit(2))))
    made = made.where("s1_id % 55 <> 0").unionByName(made.where("s1_id % 65 = 0")).unionByName(made.where("s1_id % 75 = 0").withColumn("s1_id", -1 - F.col("s1_id")))
    return blocking.coverage_report(asked(spark, sf_dir), made, K)


COVERAGE = f"""WITH {TOPK_SQL}, {SIZES}, m AS (SELECT *, CASE WHEN s1_id % 70 = 0 THEN 1 - s1_id % 2 ELSE s1_id % 2 END AS gate FROM sizes),
made AS (SELECT * FROM m WHERE s1_id % 55 <> 0 UNION ALL SELECT * FROM m WHERE s1_id % 65 = 0 UNION ALL SELECT -1 - s1_id, n_cands, gate FROM m WHERE s1_id % 75 = 0),
g AS (SELECT s1_id, count(*) AS times, any_value(gate) AS gate2, max(n_cands) AS n_cands FROM made GROUP BY s1_id), w AS (SELECT vec_id AS s1_id, vec_id % 2 AS gate, TRUE AS want FROM embeddings WHERE vec_id % 5 = 0)
SELECT count(*) FILTER (want) AS expected, count(*) FILTER (times IS NULL) AS missing, count(*) FILTER (want IS NULL) AS extra, count(*) FILTER (times > 1) AS duplicate, count(*) FILTER (gate <> gate2) AS gate_mismatch,
  count(*) FILTER (n_cands > 0 AND n_cands < {K}) AS short_lists, count(*) FILTER (n_cands = 0) AS zero_lists FROM w FULL JOIN g USING (s1_id)"""
PCT = ("p05", "p25", "p50", "p75", "p95")


def top1_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = blocking.top1_percentiles(topk(spark, sf_dir), "gate")
    return out.select("gate", "n_s1", *(F.round(p, 9).alias(p) for p in PCT))


QUERIES |= {f.__name__: f for f in (positives_found, missed_positives, candidate_labels, blocking_recall_at_k, choose_k, volume_by_k, coverage_report, top1_percentiles)}
ORACLE |= {
    "positives_found": f"WITH {TOPK_SQL}, {POSITIVES} SELECT s1_id, source, cand_id, in_pool::BIGINT AS in_pool, rank_found FROM side",
    "missed_positives": f"WITH {TOPK_SQL}, {POSITIVES} SELECT s1_id, source, cand_id FROM side WHERE rank_found = 0 OR rank_found > 3",
    "candidate_labels": f"WITH {TOPK_SQL}, {POSITIVES} SELECT t.s1_id, t.source, t.cand_id, t.rank, (p.s1_id IS NOT NULL)::BIGINT AS label FROM topk t LEFT JOIN pos p USING (s1_id, source, cand_id)",
    "blocking_recall_at_k": RECALL,
    "choose_k": f"SELECT coalesce(min(CASE WHEN pair_recall >= 0.03 THEN k END), max(k)) AS k_final FROM ({RECALL}) WHERE bucket IS NULL",
    "volume_by_k": f"WITH {TOPK_SQL}, {SIZES} SELECT k, sum(least(n_cands, k))::BIGINT AS n_pairs FROM sizes CROSS JOIN (SELECT unnest([1, 2, 3, 5])::BIGINT AS k) GROUP BY k",
    "coverage_report": COVERAGE,
    "top1_percentiles": f"WITH {TOPK_SQL} SELECT gate, count(*) AS n_s1, {', '.join(f'round(quantile_cont(score, 0.{p[1:]}), 9) AS {p}' for p in PCT)} FROM topk WHERE rank = 1 GROUP BY gate",
}
