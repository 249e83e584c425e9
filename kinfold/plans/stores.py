"""Sources and sinks: what is written to the shared folder reads back as the SQL says it should."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.operators import blocking, evaluate, models
from kinfold.plans import decisions, retrieval
from kinfold.plans.retrieval import TOPK_SQL, topk
from kinfold.session import scratch, table, written
from kinfold.sources import tables
from kinfold.streaming.prepare import prepare_new_files

RAW_SQL = """raw AS (SELECT 'S1-' || c_custkey AS entity_id, CASE WHEN c_custkey % 5 = 0 THEN 'NA' ELSE c_name || ' "' || c_mktsegment || '" co' END AS business_name,
  CASE WHEN c_custkey % 4 = 0 THEN '' ELSE c_custkey || ' road' END AS business_address, ['US', 'INDIA', 'FRANCE'][(c_nationkey % 3)::INT + 1] AS country FROM customer)"""


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as raw records, with quotes, empty fields and words that others take for null."""
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        F.concat(F.lit("S1-"), k.cast("string")).alias("entity_id"),
        F.when(k % 5 == 0, "NA").otherwise(F.concat("c_name", F.lit(' "'), "c_mktsegment", F.lit('" co'))).alias("business_name"),
        F.when(k % 4 == 0, "").otherwise(F.concat(k.cast("string"), F.lit(" road"))).alias("business_address"),
        F.element_at(F.array(*map(F.lit, ("US", "INDIA", "FRANCE"))), (F.col("c_nationkey") % 3 + 1).cast("int")).alias("country"),
    )


def raw_files(spark: SparkSession, sf_dir: str) -> str:
    path = scratch(spark, "raw")
    raw(spark, sf_dir).write.csv(path, sep="\t", header=True, quote='"', escape='"', emptyValue="")
    return path


def tsv_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.read_tsv(spark, raw_files(spark, sf_dir))


def tsv_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.read_tsv(spark, raw_files(spark, sf_dir), columns=["country", "entity_id"])


def tsv_line_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = raw_files(spark, sf_dir)
    return tables.line_counts(spark, path, tables.read_tsv(spark, path))


def record_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns of records by a row filter and a set of ids."""
    path = scratch(spark, "records")
    raw(spark, sf_dir).withColumn("source", F.lit("S1")).write.partitionBy("source").parquet(path)
    ids = raw(spark, sf_dir).where("entity_id LIKE '%7'")
    return tables.read_records(spark, path, ["entity_id", "country"], "source = 'S1' AND country <> 'US'", ids)


def record_scan_reused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One scan, written once, read by two counts."""
    path = scratch(spark, "records")
    raw(spark, sf_dir).write.parquet(path)
    kept = written(tables.read_records(spark, path, ["entity_id", "business_name", "country"], "business_name <> 'NA'"), "scan")
    one = kept.groupBy("country").agg(F.count(F.lit(1)).alias("n"))
    return one.join(kept.groupBy("country").agg(F.max("entity_id").alias("last_id")), "country")


def country_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of two sources of one country, each once."""
    r = raw(spark, sf_dir).select("entity_id", F.col("country").alias("country_norm"), F.when(F.col("business_name") == "NA", "S1").when(F.col("business_address") == "", "S2").otherwise("S3").alias("source"))
    return tables.country_pool(r.unionByName(r), "INDIA").select("source", "entity_id")


def shard_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "shards")
    raw(spark, sf_dir).repartition(3).write.parquet(path)
    return tables.distinct_values(spark, path, "country")


def role_of(column: str) -> Column:
    return F.when(F.col(column) % 3 == 0, "TREE-FIT").when(F.col(column) % 3 == 1, "TREE-DEV").otherwise("HOLDOUT")


ROLE_SQL = "CASE s1_id % 3 WHEN 0 THEN 'TREE-FIT' WHEN 1 THEN 'TREE-DEV' ELSE 'HOLDOUT' END"


def candidate_store(spark: SparkSession, sf_dir: str) -> str:
    path = scratch(spark, "candidates")
    df = topk(spark, sf_dir).withColumns({"split": F.lit("train"), "role": role_of("s1_id"), "country": F.concat(F.lit("c"), F.col("gate").cast("string"))})
    tables.write_partitioned(df, path, ["split", "role", "country"])
    tables.write_partitioned(df.where("role = 'HOLDOUT'"), path, ["split", "role", "country"])  # a rerun replaces its own partitions
    return path


def ranked_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates up to rank 3 of two roles and one country, from partitions."""
    found = tables.read_candidates(spark, candidate_store(spark, sf_dir), "train", ["TREE-FIT", "HOLDOUT"], ["c1"], 3)
    return found.select("s1_id", "source", "cand_id", "rank", "role")


def candidate_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tables.manifest(spark.read.parquet(candidate_store(spark, sf_dir)), ["role", "country"])
    return found.select("role", "country", "n_rows", "n_s1")


def selected_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tables.manifest(spark.read.parquet(candidate_store(spark, sf_dir)), ["split", "role", "country"])
    return tables.select_shards(found, "train", ["TREE-DEV"]).select("role", "country", "n_rows")


def shard_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards against promises that are wrong for one, miss another and name one too many."""
    stored = spark.read.parquet(candidate_store(spark, sf_dir))
    counts = stored.groupBy("role", "country").agg(F.count(F.lit(1)).alias("n_rows"))
    spoiled = counts.where("NOT (role = 'HOLDOUT' AND country = 'c0')").withColumn("n_rows", F.when((F.col("role") == "TREE-DEV") & (F.col("country") == "c1"), F.col("n_rows") + 1).otherwise(F.col("n_rows")))
    promised = spoiled.unionByName(spark.createDataFrame([("TEST", "c9", 5), ("TEST", "c8", 0)], "role string, country string, n_rows long"))
    return blocking.shard_problems(promised, stored, ["role", "country"])


def checked_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features with the context of the first three of a list, which holds each pair once."""
    pair = ["s1_id", "source", "cand_id"]
    path = scratch(spark, "ctx")
    topk(spark, sf_dir).where("rank <= 3").select(*pair, (F.col("score") * 2).alias("double_score")).write.parquet(path)
    joined = models.join_context(topk(spark, sf_dir).select(*pair, "rank"), tables.read_once(spark, path, pair), pair)
    return joined.select(*pair, "rank", F.round("double_score", 6).alias("double_score"))


def context_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    all_ = topk(spark, sf_dir)
    out = models.context_coverage(all_, all_.where("rank <= 3"), ["s1_id", "source", "cand_id"])
    return out.select("rows", "covered", F.col("enough").cast("bigint").alias("enough"))


def probability_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two files of scores, one of which repeats pairs of the other."""
    path = scratch(spark, "probabilities")
    p = topk(spark, sf_dir).select("s1_id", "source", "cand_id", F.col("score").alias("prob"))
    p.write.parquet(f"{path}/part=1")
    p.where("s1_id % 2 = 0").write.parquet(f"{path}/part=2")
    return tables.read_probabilities(spark, f"{path}/*").select("s1_id", "source", "cand_id", "p")


def listed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    order = retrieval.asked(spark, sf_dir).select(F.col("s1_id").cast("string").alias("s1_id"), F.col("s1_id").alias("position"))
    pairs = topk(spark, sf_dir).where("score >= 0.3").select(F.col("s1_id").cast("string").alias("s1_id"), F.concat("source", F.lit("-"), F.col("cand_id").cast("string")).alias("entity_id"), "rank")
    return order, pairs


LISTED_SQL = "listed AS (SELECT s1_id::VARCHAR AS s1_id, source || '-' || cand_id AS entity_id, rank FROM topk WHERE score >= 0.3)"


def matching_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists by rank, written and read again."""
    order, pairs = listed(spark, sf_dir)
    path = scratch(spark, "matching")
    tables.write_lists(tables.matching_lists(pairs, order, "rank"), path)
    return tables.read_matching(spark, path)


def matching_mirrored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists with brackets and semicolons, found out and written again in that way: the lines of the new file."""
    order, pairs = listed(spark, sf_dir)
    path = scratch(spark, "mirror")
    tables.write_like(pairs, order, f"{path}/a", tables.Layout("id", "matches", ";", True))
    layout = tables.matching_layout(spark, f"{path}/a")
    tables.write_like(tables.read_matching(spark, f"{path}/a"), order, f"{path}/b", layout)
    lines = spark.read.csv(f"{path}/b", sep="\t", header=True, quote="")
    return lines.select("id", F.coalesce("matches", F.lit("")).alias("matches"))


def matching_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file without the queries of 35 and with ids that no record has."""
    order, pairs = listed(spark, sf_dir)
    path = scratch(spark, "checked")
    spoiled = pairs.withColumn("entity_id", F.when(F.col("s1_id").endswith("15"), F.concat("entity_id", F.lit("x"))).otherwise(F.col("entity_id")))
    tables.write_lists(tables.matching_lists(spoiled, order.where("position % 35 <> 0")), path)
    return tables.file_checks(spark, path, "source1_entity_id\tmatched_entity_ids", order.select("s1_id"), pairs.select("entity_id"), pairs.select("s1_id", "entity_id"))


CHECKED = f"""WITH {TOPK_SQL}, {LISTED_SQL}, s AS (SELECT s1_id, CASE WHEN s1_id LIKE '%15' THEN entity_id || 'x' ELSE entity_id END AS entity_id FROM listed WHERE s1_id::BIGINT % 35 <> 0)
SELECT 0::BIGINT AS bad_headers, 0::BIGINT AS bad_rows, 0::BIGINT AS repeated_s1, (SELECT count(*) FROM embeddings WHERE vec_id % 5 = 0 AND vec_id % 35 = 0) AS missing_s1, 0::BIGINT AS unknown_s1, 0::BIGINT AS repeated_ids,
  (SELECT count(*) FROM s WHERE entity_id NOT IN (SELECT entity_id FROM listed)) AS unknown_ids, (SELECT count(*) FROM s WHERE (s1_id, entity_id) NOT IN (SELECT (s1_id, entity_id) FROM listed)) AS not_allowed"""


def run_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two logged runs and their scores, compared from the log."""
    path = scratch(spark, "runs")
    u, d = decisions.universe(spark, sf_dir), decisions.pairs(spark, sf_dir)
    for name, column in (("score", "score"), ("p", "p")):
        tables.append_run(spark, path, name, {"column": column}, evaluate.per_query(u, d, F.col(column) >= 0.45).select("s1_id", "f"))
    found = tables.compare_runs(spark, path, "score", "p").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("a"), 6).alias("a"), F.round(F.avg("b"), 6).alias("b"))
    return found.join(F.broadcast(tables.load_runs(spark, path).agg(F.count(F.lit(1)).alias("runs"), F.min("name").alias("first"))))


def report_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "report")
    tables.write_report(table(spark, sf_dir, "customer").agg(F.count(F.lit(1)).alias("customers"), F.max("c_custkey").alias("last")), path)
    return spark.read.schema("customers long, last long").json(path)


def upload_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two uploads, each registered before its lists are written."""
    path = scratch(spark, "uploads")
    order, pairs = listed(spark, sf_dir)
    lists = tables.matching_lists(pairs, order).select("source1_entity_id", "matched_entity_ids")
    tables.register_upload(spark, path, "first", "", "all lists", lists)
    tables.register_upload(spark, path, "second", "first", "no list", lists.where("false"))
    return tables.load_uploads(spark, path)


def prepared_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files prepared as they come; the second run finds nothing new."""
    path, files = scratch(spark, "stream"), raw_files(spark, sf_dir)
    for _ in range(2):
        prepare_new_files(spark, files, f"{path}/out", f"{path}/state", "S1", "train")
    return spark.read.parquet(f"{path}/out").select("entity_id", F.col("country_norm").cast("string").alias("country_norm"), "addr_norm", F.col("name_missing").cast("bigint").alias("name_missing"))


def weighted_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles of shards merged by gate, weighted by their queries."""
    parts = topk(spark, sf_dir).withColumn("shard", F.concat_ws("-", F.col("gate").cast("string"), (F.col("s1_id") % 3).cast("string")))
    found = blocking.top1_percentiles(parts, "shard").withColumn("gate", F.split("shard", "-")[0].cast("bigint"))
    out = blocking.weighted_percentiles(found, "gate", "n_s1", retrieval.PCT)
    return out.select("gate", *(F.round(p, 6).alias(p) for p in retrieval.PCT))


def resumed(spark: SparkSession, sf_dir: str) -> tuple[str, list[int]]:
    """Scores of candidates by shard: a run over some roles, one over all, and one that finds nothing to do."""
    path = scratch(spark, "scores")
    source = written(topk(spark, sf_dir).withColumns({"role": role_of("s1_id"), "country": F.concat(F.lit("c"), F.col("gate").cast("string"))}), "shards")
    make = lambda df: df.withColumn("twice", F.col("score") * 2)
    return path, [tables.fill_shards(part, path, ["role", "country"], make) for part in (source.where("role <> 'HOLDOUT'"), source, source)]


def resumed_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, _ = resumed(spark, sf_dir)
    return spark.read.parquet(path).select("s1_id", "source", "cand_id", "role", F.round("twice", 6).alias("twice"))


def resumed_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards made by each of the three runs."""
    return spark.createDataFrame(list(enumerate(resumed(spark, sf_dir)[1])), "run long, shards long")


RESUMED = f"""WITH {TOPK_SQL}, s AS (SELECT DISTINCT {ROLE_SQL} AS role, gate FROM topk) SELECT 0::BIGINT AS run, count(*) FILTER (role <> 'HOLDOUT') AS shards FROM s UNION ALL SELECT 1, count(*) FILTER (role = 'HOLDOUT') FROM s UNION ALL SELECT 2, 0"""

QUERIES = {
    f.__name__: f
    for f in (
        tsv_scan, tsv_columns, tsv_line_counts, record_scan, record_scan_reused, country_pool, shard_values, ranked_candidates, candidate_manifest, selected_shards, shard_problems, checked_join,
        context_coverage, probability_files, matching_files, matching_mirrored, matching_checks, run_comparison, report_file, upload_log, prepared_stream, weighted_percentiles, resumed_scores, resumed_runs,
    )
}
ORACLE = {
    "resumed_scores": f"WITH {TOPK_SQL} SELECT s1_id, source, cand_id, {ROLE_SQL} AS role, round(score * 2, 6) AS twice FROM topk",
    "resumed_runs": RESUMED,
    "tsv_scan": f"WITH {RAW_SQL} SELECT * FROM raw",
    "tsv_columns": f"WITH {RAW_SQL} SELECT country, entity_id FROM raw",
    "tsv_line_counts": "SELECT count(*) AS raw_lines, count(*) AS parsed_rows FROM customer",
    "record_scan": f"WITH {RAW_SQL} SELECT entity_id, country FROM raw WHERE country <> 'US' AND entity_id LIKE '%7'",
    "record_scan_reused": f"WITH {RAW_SQL} SELECT country, count(*) AS n, max(entity_id) AS last_id FROM raw WHERE business_name <> 'NA' GROUP BY country",
    "country_pool": f"WITH {RAW_SQL} SELECT CASE WHEN business_address = '' THEN 'S2' ELSE 'S3' END AS source, entity_id FROM raw WHERE country = 'INDIA' AND business_name <> 'NA'",
    "shard_values": f"WITH {RAW_SQL} SELECT DISTINCT country FROM raw",
    "ranked_candidates": f"WITH {TOPK_SQL} SELECT s1_id, source, cand_id, rank, {ROLE_SQL} AS role FROM topk WHERE rank <= 3 AND gate = 1 AND s1_id % 3 <> 1",
    "candidate_manifest": f"WITH {TOPK_SQL} SELECT {ROLE_SQL} AS role, 'c' || gate AS country, count(*) AS n_rows, count(DISTINCT s1_id) AS n_s1 FROM topk GROUP BY ALL",
    "selected_shards": f"WITH {TOPK_SQL} SELECT {ROLE_SQL} AS role, 'c' || gate AS country, count(*) AS n_rows FROM topk WHERE s1_id % 3 = 1 GROUP BY ALL",
    "shard_problems": "SELECT * FROM (VALUES ('HOLDOUT', 'c0', 'not promised'), ('TREE-DEV', 'c1', 'other row count'), ('TEST', 'c9', 'missing')) t(role, country, problem)",
    "checked_join": f"WITH {TOPK_SQL} SELECT s1_id, source, cand_id, rank, CASE WHEN rank <= 3 THEN round(score * 2, 6) END AS double_score FROM topk",
    "context_coverage": f"WITH {TOPK_SQL} SELECT count(*) AS rows, count(*) FILTER (rank <= 3) AS covered, (count(*) FILTER (rank <= 3) >= 0.98 * count(*))::BIGINT AS enough FROM topk",
    "probability_files": f"WITH {TOPK_SQL} SELECT s1_id, source, cand_id, score AS p FROM topk",
    "matching_files": f"WITH {TOPK_SQL}, {LISTED_SQL} SELECT s1_id, entity_id FROM listed",
    "matching_mirrored": f"WITH {TOPK_SQL}, {LISTED_SQL} SELECT vec_id::VARCHAR AS id, '[' || coalesce(string_agg(entity_id, ';' ORDER BY entity_id), '') || ']' AS matches FROM embeddings LEFT JOIN listed ON vec_id::VARCHAR = s1_id WHERE vec_id % 5 = 0 GROUP BY vec_id",
    "matching_checks": CHECKED,
    "run_comparison": f"""WITH {decisions.PAIRS}, {decisions.per_query_sql("score >= 0.45").replace("counts AS", "ca AS").replace("f AS (", "fa AS (", 1).replace("LEFT JOIN counts c", "LEFT JOIN ca c")}, {decisions.per_query_sql("p >= 0.45")}
SELECT count(*) AS n, round(avg(fa.f), 6) AS a, round(avg(f.f), 6) AS b, 2::BIGINT AS runs, 'p' AS first FROM fa JOIN f USING (s1_id)""",
    "report_file": "SELECT count(*) AS customers, max(c_custkey) AS last FROM customer",
    "upload_log": "SELECT * FROM (VALUES ('first', '', 'all lists'), ('second', 'first', 'no list')) t(name, parent, change)",
    "prepared_stream": f"WITH {RAW_SQL} SELECT entity_id, country AS country_norm, business_address AS addr_norm, (business_name = 'NA')::BIGINT AS name_missing FROM raw",
    "weighted_percentiles": f"""WITH {TOPK_SQL}, s AS (SELECT gate, s1_id % 3 AS m, count(*) AS n, {", ".join(f"quantile_cont(score, 0.{p[1:]}) AS {p}" for p in retrieval.PCT)} FROM topk WHERE rank = 1 GROUP BY ALL)
SELECT gate, {", ".join(f"round(sum({p} * n) / sum(n), 6) AS {p}" for p in retrieval.PCT)} FROM s GROUP BY gate""",
}
