"""Ground-truth queries: orders and the parts of their lines stand in for queries and matched records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.functions import text
from kinfold.operators import labels
from kinfold.session import table

TRUTH = "t AS (SELECT l_orderkey AS s1_id, string_agg(rec, ',' ORDER BY rec) AS matched FROM (SELECT DISTINCT l_orderkey, CASE WHEN l_partkey % 2 = 0 THEN 'S2-' ELSE 'S3-' END || l_partkey AS rec FROM lineitem) GROUP BY l_orderkey)"
PAIRS = f"{TRUTH}, pairs AS (SELECT s1_id, unnest(string_split(matched, ',')) AS rec_id FROM t)"

def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """s1_id and a comma list, made of two lists for each order, one of them with blanks."""
    rec = F.concat(F.when(F.col("l_partkey") % 2 == 0, "S2-").otherwise("S3-"), F.col("l_partkey").cast("string"))
    read = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("s1_id"), rec.alias("r"), (F.col("l_partkey") % 3 == 0).alias("half")).distinct()
    return labels.merge_lists(read.groupBy("s1_id", "half").agg(F.array_join(F.sort_array(F.collect_list("r")), " , ").alias("matched")))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.explode_pairs(truth(spark, sf_dir))


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("s1_id"), F.col("o_orderpriority").alias("country"), (F.col("o_custkey") % 7).alias("cust"))


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.concat(F.when(F.col("p_partkey") % 2 == 0, "S2-").otherwise("S3-"), F.col("p_partkey").cast("string")).alias("rec_id"), F.col("p_brand").alias("brand"))


def gt_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs(spark, sf_dir)


def gt_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pairs(spark, sf_dir)
    spoiled = p.unionByName(p.where("s1_id % 50 = 0")).unionByName(p.where("s1_id % 70 = 1").withColumn("rec_id", F.concat(F.lit("X"), "rec_id"))).unionByName(p.where("s1_id % 90 = 2").withColumn("s1_id", -F.col("s1_id")))
    return labels.integrity(spoiled, orders(spark, sf_dir), parts(spark, sf_dir), r"^S[23]-")


INTEGRITY = f"""WITH {PAIRS}, x AS (SELECT * FROM pairs UNION ALL SELECT * FROM pairs WHERE s1_id % 50 = 0 UNION ALL SELECT s1_id, 'X' || rec_id FROM pairs WHERE s1_id % 70 = 1 UNION ALL SELECT -s1_id, rec_id FROM pairs WHERE s1_id % 90 = 2),
d AS (SELECT DISTINCT * FROM x), r AS (SELECT CASE WHEN p_partkey % 2 = 0 THEN 'S2-' ELSE 'S3-' END || p_partkey AS rec_id FROM part)
SELECT (SELECT count(*) FROM x) AS n_pairs, (SELECT count(*) FROM x WHERE NOT regexp_matches(rec_id, '^S[23]-')) AS bad_prefix, (SELECT count(*) FROM d) AS n_distinct,
  (SELECT count(*) FROM d WHERE rec_id NOT IN (SELECT rec_id FROM r)) AS dangling_records, (SELECT count(*) FROM d WHERE s1_id NOT IN (SELECT o_orderkey FROM orders)) AS unknown_s1, (SELECT count(*) FROM x) - (SELECT count(*) FROM d) AS duplicate_pairs"""


def multi_claimed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.multi_claimed(pairs(spark, sf_dir))


def entity_groups_cc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The groups of all orders over all pairs."""
    return labels.entity_groups(orders(spark, sf_dir).select("s1_id"), pairs(spark, sf_dir))


GROUPS = f"""WITH RECURSIVE {PAIRS}, l AS MATERIALIZED (SELECT s1_id, min(s1_id) OVER (PARTITION BY rec_id) AS least FROM pairs), e AS MATERIALIZED (SELECT DISTINCT s1_id AS a, least AS b FROM l WHERE s1_id <> least UNION SELECT DISTINCT least, s1_id FROM l WHERE s1_id <> least),
g(s, g) USING KEY (s) AS (SELECT o_orderkey, o_orderkey FROM orders UNION SELECT e.b, min(g.g) FROM g JOIN e ON g.s = e.a JOIN recurring.g r ON r.s = e.b WHERE g.g < r.g GROUP BY e.b)
SELECT s AS s1_id, g AS group_id FROM g"""


def match_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = labels.s1_profile(orders(spark, sf_dir), pairs(spark, sf_dir), F.col("rec_id").startswith("S2-"), F.col("rec_id").endswith("1"))
    return out.select("s1_id", "n_matches", "n_s2", "n_s3", F.col("has_cross_script").cast("bigint").alias("has_cross"), F.col("is_singleton").cast("bigint").alias("is_singleton"), "match_bucket")


BUCKETS = f"""WITH {PAIRS} SELECT o_orderkey AS s1_id, count(rec_id) AS n_matches, count(*) FILTER (rec_id LIKE 'S2-%') AS n_s2, count(*) FILTER (rec_id LIKE 'S3-%') AS n_s3, coalesce(max((rec_id LIKE '%1')::BIGINT), 0) AS has_cross,
  (count(rec_id) = 0)::BIGINT AS is_singleton, CASE WHEN count(rec_id) = 0 THEN '0' WHEN count(rec_id) = 1 THEN '1' WHEN count(rec_id) = 2 THEN '2' WHEN count(rec_id) <= 5 THEN '3-5' ELSE '6+' END AS match_bucket
FROM orders LEFT JOIN pairs ON o_orderkey = s1_id GROUP BY o_orderkey"""


def roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    strata = orders(spark, sf_dir).withColumn("stratum", F.concat_ws("|", "country", "cust"))
    return labels.assign_roles(strata, "stratum", "s1_id")


def role_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roles(spark, sf_dir).select("s1_id", "stratum", F.round("pos", 6).alias("pos"), "entity_role")


ROLES = """roles AS (SELECT *, CASE WHEN pos < 0.3 THEN 'CE-FIT' WHEN pos < 0.35 THEN 'CE-DEV' WHEN pos < 0.65 THEN 'TREE-FIT' WHEN pos < 0.75 THEN 'TREE-DEV' WHEN pos < 0.85 THEN 'CALIBRATION' ELSE 'HOLDOUT' END AS entity_role
  FROM (SELECT o_orderkey AS s1_id, o_orderpriority AS country, o_orderpriority || '|' || o_custkey % 7 AS stratum, (row_number() OVER (PARTITION BY stratum ORDER BY md5('42|' || o_orderkey), o_orderkey) - 0.5::DOUBLE) / count(*) OVER (PARTITION BY stratum) AS pos FROM orders))"""


def role_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.role_balance(roles(spark, sf_dir), "country").select("country", "entity_role", "n", F.round("share", 6).alias("share"), F.round("deviation", 6).alias("deviation"))


BALANCE = f"""WITH {ROLES} SELECT country, entity_role, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY country), 6)::DOUBLE AS share,
  round(count(*) / sum(count(*)) OVER (PARTITION BY country) - map {{'CE-FIT': 0.3::DOUBLE, 'CE-DEV': 0.05, 'TREE-FIT': 0.3, 'TREE-DEV': 0.1, 'CALIBRATION': 0.1, 'HOLDOUT': 0.15}}[entity_role], 6)::DOUBLE AS deviation FROM roles GROUP BY country, entity_role"""


def record_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.finalise(parts(spark, sf_dir), labels.first_claim(pairs(spark, sf_dir)), roles(spark, sf_dir)).select("rec_id", "cluster_id", "entity_role")


def country_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("source", F.regexp_replace("source", r"\d$", "").alias("family"))
    return labels.value_audit(docs, "source", "family")


def test_only_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "part").select("p_partkey", F.concat_ws("-", "p_brand", "p_size").alias("kind"))
    return labels.only_in(t.where("p_partkey % 3 = 0"), t.where("p_partkey % 3 <> 0"), "kind")


def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kinfold.operators.stats import hash_unit

    p = parts(spark, sf_dir)
    fractions = {"Brand#11": 0.3, "Brand#12": 0.0} | {f"Brand#{i}": 0.1 for i in range(1, 26) if i not in (11, 12)}
    return labels.stratified_sample(p, "brand", hash_unit(F.col("rec_id")), fractions, pairs(spark, sf_dir).where("s1_id % 10 = 0"), "rec_id").select("rec_id")


SAMPLE = f"""WITH {PAIRS}, r AS (SELECT CASE WHEN p_partkey % 2 = 0 THEN 'S2-' ELSE 'S3-' END || p_partkey AS rec_id, p_brand FROM part)
SELECT rec_id FROM r WHERE (('0x' || substr(md5(rec_id), 1, 8))::BIGINT % 1000000) / 1000000 < CASE p_brand WHEN 'Brand#11' THEN 0.3 WHEN 'Brand#12' THEN 0 ELSE 0.1 END OR rec_id IN (SELECT rec_id FROM pairs WHERE s1_id % 10 = 0)"""

def scripted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with role and a script by id; some are missing."""
    script = F.when(F.col("s1_id") % 5 == 0, "devanagari").when(F.col("s1_id") % 7 == 0, "numeric").otherwise("latin")
    return roles(spark, sf_dir).where("s1_id % 23 <> 0").select("s1_id", "entity_role", "country", script.alias("script"))


def record_side(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts with the role and owner of their first claim and a script by id; some are missing."""
    r = labels.finalise(parts(spark, sf_dir), labels.first_claim(pairs(spark, sf_dir)), roles(spark, sf_dir))
    return r.where("rec_id NOT LIKE '%77'").withColumn("script", F.when(F.col("rec_id").endswith("3"), "tamil").otherwise("latin"))


def positive_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = labels.positive_pairs(pairs(spark, sf_dir), scripted(spark, sf_dir), record_side(spark, sf_dir))
    return out.select("s1_id", "rec_id", "entity_role", "country", "s1_script", "match_script", "match_role", "cluster_id")


def positive_pair_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = positive_pairs(spark, sf_dir)
    out = labels.pair_checks(labelled, labels.multi_claimed(pairs(spark, sf_dir)), text.is_cross_script(F.col("s1_script"), F.col("match_script")))
    return out.withColumn("cross_script_pct", F.round("cross_script_pct", 6))


def qa_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checks over records of which some have another owner, and pairs of which some name no record."""
    p = pairs(spark, sf_dir)
    r = labels.finalise(parts(spark, sf_dir), labels.first_claim(p), roles(spark, sf_dir))
    spoiled = r.withColumn("cluster_id", F.when(F.col("rec_id").endswith("99"), "x").otherwise(F.col("cluster_id")))
    out = labels.qa_checks(orders(spark, sf_dir).select("s1_id"), spoiled, p.unionByName(p.where("s1_id % 500 = 1").withColumn("rec_id", F.concat("rec_id", F.lit("?")))), roles(spark, sf_dir))
    return out.withColumn("passed", F.col("passed").cast("bigint"))


QA = f"""WITH {PAIRS}, {ROLES}, n AS (SELECT count(*) FILTER (s1_id % 500 = 1) AS unknown FROM pairs), o AS (SELECT count(*) AS other FROM part WHERE p_partkey % 100 = 99),
sh AS (SELECT count(*) FILTER (abs(s - t) > 0.02) AS far FROM (SELECT count(*) / sum(count(*)) OVER () AS s, map {{'CE-FIT': 0.3::DOUBLE, 'CE-DEV': 0.05, 'TREE-FIT': 0.3, 'TREE-DEV': 0.1, 'CALIBRATION': 0.1, 'HOLDOUT': 0.15}}[entity_role] AS t FROM roles GROUP BY entity_role)),
x(section, "check", n) AS (SELECT 'labels', 'no pair twice', 0 UNION ALL SELECT 'labels', 'queries known', 0 UNION ALL SELECT 'labels', 'records known', unknown FROM n UNION ALL SELECT 'records', 'ids unique', 0 UNION ALL SELECT 'records', 'owner is the first claim', other FROM o
  UNION ALL SELECT 'records', 'role of the owner', 0 UNION ALL SELECT 'roles', 'one role a query', 0 UNION ALL SELECT 'roles', 'every query has one', 0 UNION ALL SELECT 'roles', 'shares near their targets', far FROM sh)
SELECT section, "check", (n = 0)::BIGINT AS passed, n::VARCHAR AS detail FROM x"""


POSITIVE = f"""{PAIRS}, {ROLES}, c AS (SELECT rec_id, min(s1_id) AS s1_id FROM pairs GROUP BY rec_id),
rs AS (SELECT CASE WHEN p_partkey % 2 = 0 THEN 'S2-' ELSE 'S3-' END || p_partkey AS rec_id FROM part),
rr AS (SELECT rs.rec_id, coalesce(c.s1_id::VARCHAR, '') AS cluster_id, coalesce(entity_role, 'POOL') AS match_role, CASE WHEN rs.rec_id LIKE '%3' THEN 'tamil' ELSE 'latin' END AS match_script
  FROM rs LEFT JOIN c USING (rec_id) LEFT JOIN roles USING (s1_id) WHERE rs.rec_id NOT LIKE '%77'),
ss AS (SELECT s1_id, entity_role, country, CASE WHEN s1_id % 5 = 0 THEN 'devanagari' WHEN s1_id % 7 = 0 THEN 'numeric' ELSE 'latin' END AS s1_script FROM roles WHERE s1_id % 23 <> 0),
pp AS (SELECT p.s1_id, p.rec_id, entity_role, country, s1_script, match_script, match_role, cluster_id FROM pairs p LEFT JOIN ss USING (s1_id) LEFT JOIN rr USING (rec_id))"""
POSITIVE_CHECKS = f"""WITH {POSITIVE}, m AS (SELECT rec_id FROM pairs GROUP BY rec_id HAVING count(DISTINCT s1_id) > 1), x AS (SELECT pp.*, m.rec_id IS NOT NULL AS several FROM pp LEFT JOIN m USING (rec_id))
SELECT count(*) AS pairs, count(*) FILTER (s1_script IS NULL) AS missing_s1_record, count(*) FILTER (match_script IS NULL) AS missing_match_record, count(*) FILTER (entity_role IS DISTINCT FROM match_role) AS role_mismatch,
  count(*) FILTER (several) AS on_multi_claimed, count(*) FILTER (cluster_id IS DISTINCT FROM s1_id::VARCHAR AND NOT several) AS owner_disagrees,
  round(100 * avg(coalesce(s1_script <> match_script AND s1_script <> 'numeric' AND match_script <> 'numeric', FALSE)::INT), 6) AS cross_script_pct FROM x"""

QUERIES = {f.__name__: f for f in (gt_pairs, gt_integrity, multi_claimed, entity_groups_cc, match_buckets, role_assignment, role_balance, record_roles, country_audit, test_only_labels, stratified_sample, positive_pairs, positive_pair_checks, qa_checks)}
ORACLE = {
    "gt_pairs": f"WITH {PAIRS} SELECT * FROM pairs",
    "gt_integrity": INTEGRITY,
    "multi_claimed": f"WITH {PAIRS} SELECT rec_id, count(DISTINCT s1_id) AS n_s1 FROM pairs GROUP BY rec_id HAVING count(DISTINCT s1_id) > 1",
    "entity_groups_cc": GROUPS,
    "match_buckets": BUCKETS,
    "role_assignment": f"WITH {ROLES} SELECT s1_id, stratum, round(pos, 6) AS pos, entity_role FROM roles",
    "role_balance": BALANCE,
    "record_roles": f"WITH {PAIRS}, {ROLES}, c AS (SELECT rec_id, min(s1_id) AS s1_id FROM pairs GROUP BY rec_id), r AS (SELECT CASE WHEN p_partkey % 2 = 0 THEN 'S2-' ELSE 'S3-' END || p_partkey AS rec_id FROM part) SELECT r.rec_id, coalesce(c.s1_id::VARCHAR, '') AS cluster_id, coalesce(entity_role, 'POOL') AS entity_role FROM r LEFT JOIN c ON r.rec_id = c.rec_id LEFT JOIN roles ON roles.s1_id = c.s1_id",
    "country_audit": "SELECT regexp_replace(source, '[0-9]$', '') AS family, count(*) AS n, count(DISTINCT source) AS n_variants, string_agg(DISTINCT source, '|' ORDER BY source) AS variants FROM documents GROUP BY 1",
    "test_only_labels": "SELECT DISTINCT p_brand || '-' || p_size AS kind FROM part WHERE p_partkey % 3 = 0 AND p_brand || '-' || p_size NOT IN (SELECT p_brand || '-' || p_size FROM part WHERE p_partkey % 3 <> 0)",
    "stratified_sample": SAMPLE,
    "positive_pairs": f"WITH {POSITIVE} SELECT * FROM pp",
    "positive_pair_checks": POSITIVE_CHECKS,
    "qa_checks": QA,
}
