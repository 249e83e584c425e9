"""Context queries over retrieved candidates, with logits made from scores and ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.operators import context
from kinfold.plans.retrieval import TOPK_SQL, topk
from kinfold.session import written

V1 = "CASE WHEN (s1_id * 7 + cand_id) % 11 = 0 THEN NULL ELSE ((s1_id * 31 + cand_id * 17) % 101) / 10.0 - 5.0 END"
V2 = "CASE WHEN (s1_id + cand_id) % 13 = 0 THEN NULL ELSE score * 20.0 - 7.0 END"
IDS = ("s1_id", "source", "cand_id")


def rounded(df: DataFrame, keep: tuple[str, ...], values: tuple[str, ...]) -> DataFrame:
    return df.select(*keep, *(F.round(F.col(v).cast("double"), 6).alias(v) for v in values))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk(spark, sf_dir).withColumn("v1_logit", F.expr(V1).cast("double")).withColumn("v2_logit", F.expr(V2).cast("double"))


SCORED_SQL = f"{TOPK_SQL}, scored AS (SELECT *, ({V1})::DOUBLE AS v1_logit, ({V2})::DOUBLE AS v2_logit FROM topk)"


def list_context_g1(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = context.list_scores(topk(spark, sf_dir))
    return rounded(out, (*IDS, "n_cands", "is_rank1"), ("score_gap_top1", "score_ratio_top1", "score_gap_next", "score_gap_prev"))


LIST_G1 = f"""WITH {TOPK_SQL}
SELECT s1_id, source, cand_id, count(*) OVER q AS n_cands, (rank = 1)::BIGINT AS is_rank1, round(score - max(score) OVER q, 6) AS score_gap_top1,
  round(CASE WHEN max(score) OVER q > 0 THEN score / max(score) OVER q END, 6) AS score_ratio_top1,
  round(score - lead(score) OVER o, 6) AS score_gap_next, round(lag(score) OVER o - score, 6) AS score_gap_prev
FROM topk WINDOW q AS (PARTITION BY s1_id), o AS (PARTITION BY s1_id ORDER BY rank, cand_id)"""


def sims(df: DataFrame) -> DataFrame:
    return df.withColumn("name_sim", F.expr("CASE WHEN (s1_id + cand_id) % 9 = 0 THEN NULL ELSE (s1_id * 13 + cand_id * 7) % 21 / 20.0 END").cast("double")).withColumn("addr_sim", F.expr("CASE WHEN cand_id % 5 = 0 THEN NULL ELSE (s1_id * 3 + cand_id * 11) % 11 / 10.0 END").cast("double"))


def list_context_g8(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = context.list_similarity(sims(topk(spark, sf_dir)), "name_sim", "addr_sim")
    return rounded(out, (*IDS, "name_sim_rank_in_list", "name_sim_n_ge90", "name_addr_n_strong"), ("name_sim_gap_best", "addr_sim_gap_best"))


LIST_G8 = f"""WITH {TOPK_SQL}, s AS (SELECT *, CASE WHEN (s1_id + cand_id) % 9 = 0 THEN NULL ELSE (s1_id * 13 + cand_id * 7) % 21 / 20.0 END AS n,
  CASE WHEN cand_id % 5 = 0 THEN NULL ELSE (s1_id * 3 + cand_id * 11) % 11 / 10.0 END AS a FROM topk)
SELECT s1_id, source, cand_id, row_number() OVER (PARTITION BY s1_id ORDER BY coalesce(n, -1) DESC, rank) AS name_sim_rank_in_list,
  (count(*) FILTER (n >= 0.9) OVER q) AS name_sim_n_ge90, (count(*) FILTER (n >= 0.9 AND a >= 0.7) OVER q) AS name_addr_n_strong,
  round(max(coalesce(n, -1)) OVER q - coalesce(n, -1), 6)::DOUBLE AS name_sim_gap_best, round(CASE WHEN a IS NOT NULL THEN max(a) OVER q - a END, 6)::DOUBLE AS addr_sim_gap_best
FROM s WINDOW q AS (PARTITION BY s1_id)"""


def claimant_context_g9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(context.claimant_scores(topk(spark, sf_dir)), (*IDS, "cand_fanin", "cand_is_best_s1"), ("cand_best_margin",))


CLAIM_G9 = f"""WITH {TOPK_SQL}, r AS (SELECT *, count(*) OVER w AS n, max(score) OVER w AS best, row_number() OVER (PARTITION BY source, cand_id ORDER BY score DESC, s1_id) AS k FROM topk WINDOW w AS (PARTITION BY source, cand_id)),
z AS (SELECT source, cand_id, score AS second FROM r WHERE k = 2)
SELECT s1_id, r.source, r.cand_id, least(n, 32767) AS cand_fanin, (score >= best - 1e-6)::BIGINT AS cand_is_best_s1, round(CASE WHEN score >= best - 1e-6 THEN score - second ELSE score - best END, 6) AS cand_best_margin
FROM r LEFT JOIN z ON r.source = z.source AND r.cand_id = z.cand_id"""


def ctx_ensemble_l0(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(context.ensemble(scored(spark, sf_dir), "v2_logit", "v1_logit"), (*IDS, "ce_sign_agree"), ("ens_logit", "ce_min", "ce_absdiff"))


ENS_SQL = "ens AS (SELECT *, coalesce((v1_logit + v2_logit) / 2, v1_logit, v2_logit) AS ens_logit FROM scored)"
ENSEMBLE_L0 = f"""WITH {SCORED_SQL}, {ENS_SQL}
SELECT s1_id, source, cand_id, CASE WHEN v1_logit IS NOT NULL AND v2_logit IS NOT NULL THEN ((v1_logit > 0) = (v2_logit > 0))::BIGINT END AS ce_sign_agree,
  round(ens_logit, 6) AS ens_logit, round(CASE WHEN v1_logit IS NOT NULL AND v2_logit IS NOT NULL THEN least(v1_logit, v2_logit) END, 6) AS ce_min, round(abs(v1_logit - v2_logit), 6) AS ce_absdiff FROM ens"""


def ctx_base_l1(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = context.ensemble(scored(spark, sf_dir), "v2_logit", "v1_logit")
    for x, prefix in (("v2_logit", "v2"), ("v1_logit", "v1"), ("ens_logit", "ens")):
        df = context.group_context(df, context.LIST, x, ("rank", "cand_id"), prefix)
    df = df.withColumn("rank_shift", F.col("rank") - F.col("ens_rank")).withColumnRenamed("v2_n_valid", "v2_n_scored")
    return rounded(df, (*IDS, "v2_rank", "v2_n_pos", "v2_n_scored", "v1_rank", "ens_rank", "rank_shift"), ("v2_logit", "v2_gap_top", "v2_gap_next", "v2_share", "v1_gap_top", "ens_gap_top", "ens_gap_next", "ens_share", "ens_entropy", "ens_z"))


def stats_sql(table: str, name: str, keys: str, x: str, ties: str) -> str:
    """The group context of x, as plain window SQL."""
    return f"""{name}_a AS (SELECT *, max({x}) OVER (PARTITION BY {keys}) AS mx, CASE WHEN {x} IS NOT NULL THEN row_number() OVER (PARTITION BY {keys} ORDER BY {x} DESC NULLS LAST, {ties}) END AS rk,
    lead({x}) OVER (PARTITION BY {keys} ORDER BY {x} DESC NULLS LAST, {ties}) AS nx, count({x}) OVER (PARTITION BY {keys}) AS nv, count(*) FILTER ({x} > 0) OVER (PARTITION BY {keys}) AS np,
    avg({x}) OVER (PARTITION BY {keys}) AS av, stddev_pop({x}) OVER (PARTITION BY {keys}) AS sd FROM {table}),
{name}_b AS (SELECT *, exp({x} - mx) / sum(exp({x} - mx)) OVER (PARTITION BY {keys}) AS sh, max(CASE WHEN rk = 2 THEN {x} END) OVER (PARTITION BY {keys}) AS sec FROM {name}_a),
{name} AS (SELECT s1_id, source, cand_id, {x} AS x, rk, mx - {x} AS gap_top, CASE WHEN {x} IS NOT NULL THEN {x} - nx END AS gap_next, CASE WHEN {x} IS NOT NULL THEN CASE WHEN rk = 1 THEN sec ELSE mx END END AS other_best,
    sh, CASE WHEN {x} IS NOT NULL THEN sum(-sh * ln(sh)) OVER (PARTITION BY {keys}) END AS ent, nv, np, CASE WHEN {x} IS NOT NULL THEN CASE WHEN sd > 1e-6 THEN ({x} - av) / sd ELSE 0 END END AS z FROM {name}_b)"""


BASE_L1 = f"""WITH {SCORED_SQL}, {ENS_SQL}, {stats_sql("ens", "c2", "s1_id", "v2_logit", "rank, cand_id")}, {stats_sql("ens", "c1", "s1_id", "v1_logit", "rank, cand_id")}, {stats_sql("ens", "ce", "s1_id", "ens_logit", "rank, cand_id")}
SELECT e.s1_id, e.source, e.cand_id, c2.rk AS v2_rank, c2.np AS v2_n_pos, c2.nv AS v2_n_scored, c1.rk AS v1_rank, ce.rk AS ens_rank, e.rank - ce.rk AS rank_shift,
  round(c2.x, 6) AS v2_logit, round(c2.gap_top, 6) AS v2_gap_top, round(c2.gap_next, 6) AS v2_gap_next, round(c2.sh, 6) AS v2_share, round(c1.gap_top, 6) AS v1_gap_top,
  round(ce.gap_top, 6) AS ens_gap_top, round(ce.gap_next, 6) AS ens_gap_next, round(ce.sh, 6) AS ens_share, round(ce.ent, 6) AS ens_entropy, round(ce.z, 6) AS ens_z
FROM ens e JOIN c2 USING (s1_id, source, cand_id) JOIN c1 USING (s1_id, source, cand_id) JOIN ce USING (s1_id, source, cand_id)"""


def ctx_l2_mutual_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = context.ensemble(scored(spark, sf_dir), "v2_logit", "v1_logit")
    df = context.group_context(df, context.LIST, "ens_logit", ("rank", "cand_id"), "ens")
    df = written(df, "listed")
    df = context.mutual_best(context.group_context(df, context.CLAIM, "ens_logit", ("s1_id",), "rec", context.hot_groups(df, context.CLAIM)))
    df = df.withColumn("rec_gap_best", F.col("ens_logit") - F.col("rec_other_best"))
    return rounded(df, (*IDS, "rec_rank", "rec_n_pos", "mutual_best"), ("rec_gap_best", "rec_share"))


L2 = f"""WITH {SCORED_SQL}, {ENS_SQL}, {stats_sql("ens", "ce", "s1_id", "ens_logit", "rank, cand_id")}, {stats_sql("ens", "cr", "source, cand_id", "ens_logit", "s1_id")}
SELECT e.s1_id, e.source, e.cand_id, cr.rk AS rec_rank, cr.np AS rec_n_pos, CASE WHEN e.ens_logit IS NOT NULL THEN (cr.rk = 1 AND ce.rk <= greatest(ce.np, 1))::BIGINT END AS mutual_best,
  round(cr.x - cr.other_best, 6) AS rec_gap_best, round(cr.sh, 6) AS rec_share
FROM ens e JOIN ce USING (s1_id, source, cand_id) JOIN cr USING (s1_id, source, cand_id)"""

QUERIES = {f.__name__: f for f in (list_context_g1, list_context_g8, claimant_context_g9, ctx_ensemble_l0, ctx_base_l1, ctx_l2_mutual_best)}
ORACLE = {"list_context_g1": LIST_G1, "list_context_g8": LIST_G8, "claimant_context_g9": CLAIM_G9, "ctx_ensemble_l0": ENSEMBLE_L0, "ctx_base_l1": BASE_L1, "ctx_l2_mutual_best": L2}
