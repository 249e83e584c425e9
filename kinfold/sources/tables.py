"""Sources and sinks: tab-separated text, partitioned Parquet, matching files, manifests, run logs."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

RAW_SCHEMA = "entity_id string, business_name string, business_address string, country string"


def read_tsv(spark: SparkSession, path: str, schema: str = RAW_SCHEMA, columns: list[str] | None = None) -> DataFrame:
    """All columns as text under a fixed schema; an empty field is '', never null, and no word means null."""
    df = spark.read.csv(path, sep="\t", header=True, schema=schema, quote='"', escape='"', nullValue="\u0000", emptyValue="", mode="PERMISSIVE")
    df = df.na.fill("")
    return df.select(*columns) if columns else df


def line_counts(spark: SparkSession, path: str, parsed: DataFrame) -> DataFrame:
    """One row: raw lines without headers, and parsed rows; they differ where quotes merged lines."""
    files = spark.read.text(path).groupBy(F.input_file_name().alias("f")).agg((F.count(F.lit(1)) - 1).alias("n"))
    return files.agg(F.sum("n").alias("raw_lines")).join(F.broadcast(parsed.agg(F.count(F.lit(1)).alias("parsed_rows"))))


def read_records(spark: SparkSession, path: str, columns: list[str], where: str | None = None, ids: DataFrame | None = None) -> DataFrame:
    """Columns of prepared records; filters reach the scan (partitions too), a set of ids is a semi-join."""
    df = spark.read.parquet(path)
    if where:
        df = df.where(where)
    if ids is not None:
        df = df.join(ids.select("entity_id"), "entity_id", "left_semi")
    return df.select(*columns)


def country_pool(records: DataFrame, country: str) -> DataFrame:
    """The searched records (S2 and S3) of a country, one for each source and id."""
    return records.where(F.col("source").isin("S2", "S3") & (F.col("country_norm") == country)).dropDuplicates(["source", "entity_id"])


def write_partitioned(df: DataFrame, path: str, by: list[str]) -> None:
    """Parquet by partition columns; a rerun replaces only the partitions it writes, and the committer makes each write whole or nothing."""
    df.repartition(*by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy(*by).parquet(path)


def read_probabilities(spark: SparkSession, pattern: str, columns: tuple[str, ...] = ("p", "prob", "probability", "score")) -> DataFrame:
    """Score files by pattern: the first known probability column as p, one row for each pair."""
    df = spark.read.option("mergeSchema", "true").parquet(pattern)
    found = next((c for c in columns if c in df.columns), None)
    if found is None:
        raise ValueError(f"no probability column in {df.columns}")
    return df.withColumnRenamed(found, "p").dropDuplicates(["s1_id", "source", "cand_id"])


def matching_lists(pairs: DataFrame, order: DataFrame, rank: str | None = None) -> DataFrame:
    """source1_entity_id and the comma list of its matches, for every query of ``order``, '' without any."""
    entry = F.struct(F.col(rank) if rank else F.lit(0), F.col("entity_id"))
    lists = pairs.groupBy("s1_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(entry)), lambda e: e["entity_id"]), ",").alias("matched"))
    return order.select("s1_id", "position").join(lists, "s1_id", "left").select("position", F.col("s1_id").alias("source1_entity_id"), F.coalesce("matched", F.lit("")).alias("matched_entity_ids"))


def write_lists(lists: DataFrame, path: str, column: str = "matched_entity_ids") -> None:
    """Two tab-separated columns with a header in every part, in the order of ``position`` (range-sorted, not gathered)."""
    lists.orderBy("position").select("source1_entity_id", F.col("matched_entity_ids").alias(column)).write.mode("overwrite").csv(path, sep="\t", header=True, quote="", emptyValue="")


def read_matching(spark: SparkSession, path: str) -> DataFrame:
    """s1_id, entity_id of a matching file: wide lists (commas, semicolons, bars or blanks, with or without brackets and quotes) or long rows."""
    lines = spark.read.text(path).withColumn("cells", F.split("value", "\t"))
    lines = lines.where(F.size("cells") >= 2).where(~F.lower(F.col("cells")[0]).rlike("entity_id|s1_id|^id$"))
    cleaned = F.regexp_replace(F.col("cells")[1], r"[\[\]{}()'\"]", "")
    return lines.select(F.trim(F.col("cells")[0]).alias("s1_id"), F.explode(F.split(cleaned, r"[,;| ]+")).alias("entity_id")).where("entity_id <> ''").distinct()


def file_checks(spark: SparkSession, path: str, header: str, universe: DataFrame, known: DataFrame, allowed: DataFrame | None = None) -> DataFrame:
    """One row of counts that should be 0: bad headers, rows of another width, repeated, missing and unknown queries, repeated and unknown ids, ids outside the allowed pairs."""
    raw = spark.read.text(path)
    heads = raw.where(F.col("value").startswith("source1_entity_id"))
    rows = raw.where(~F.col("value").startswith("source1_entity_id")).withColumn("cells", F.split("value", "\t"))
    lists = rows.select(F.col("cells")[0].alias("s1_id"), F.coalesce(F.get("cells", F.lit(1)), F.lit("")).alias("list"), F.size("cells").alias("n"))
    each = lists.select("s1_id", F.explode(F.split("list", ",")).alias("entity_id")).where("entity_id <> ''")
    parts = [
        heads.agg(F.count_if(F.col("value") != header).alias("bad_headers")),
        lists.agg(F.count_if(F.col("n") != 2).alias("bad_rows")),
        lists.groupBy("s1_id").count().agg(F.count_if(F.col("count") > 1).alias("repeated_s1")),
        universe.join(lists, "s1_id", "left_anti").agg(F.count(F.lit(1)).alias("missing_s1")),
        lists.join(universe, "s1_id", "left_anti").agg(F.count(F.lit(1)).alias("unknown_s1")),
        each.groupBy("s1_id", "entity_id").count().agg(F.count_if(F.col("count") > 1).alias("repeated_ids")),
        each.join(known.select("entity_id"), "entity_id", "left_anti").agg(F.count(F.lit(1)).alias("unknown_ids")),
    ]
    if allowed is not None:
        parts.append(each.join(allowed.select("s1_id", "entity_id"), ["s1_id", "entity_id"], "left_anti").agg(F.count(F.lit(1)).alias("not_allowed")))
    out = parts[0]
    for p in parts[1:]:
        out = out.join(F.broadcast(p))  # single rows
    return out


def manifest(df: DataFrame, by: list[str]) -> DataFrame:
    """Rows, queries and files of each partition of a table that is read from files."""
    named = df.select(*by, "s1_id", F.col("_metadata.file_path").alias("__file"))
    return named.groupBy(*by).agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("s1_id").alias("n_s1"), F.count_distinct("__file").alias("n_files"))


def append_run(spark: SparkSession, path: str, name: str, report: dict, per_query: DataFrame | None = None) -> None:
    """One JSON line in the log of runs, and the per-query scores of the run beside it."""
    spark.createDataFrame([(name, json.dumps(report, sort_keys=True))], "name string, report string").coalesce(1).write.mode("append").json(f"{path}/runs")
    if per_query is not None:
        per_query.withColumn("run", F.lit(name)).write.mode("append").partitionBy("run").parquet(f"{path}/scores")


def load_runs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("name string, report string").json(f"{path}/runs")


def distinct_values(spark: SparkSession, path: str, column: str) -> DataFrame:
    """The values that a column takes over all shards under a path."""
    return spark.read.parquet(path).select(column).distinct()


def select_shards(manifest: DataFrame, split: str, roles: Sequence[str] | None = None, countries: Sequence[str] | None = None) -> DataFrame:
    """The shards of a manifest (split, role, country) of a split, and of some roles and countries."""
    keep: Column = F.col("split") == split
    for column, values in (("role", roles), ("country", countries)):
        if values is not None:
            keep &= F.col(column).isin(list(values))
    return manifest.where(keep)


def read_candidates(spark: SparkSession, path: str, split: str, roles: Sequence[str] | None = None, countries: Sequence[str] | None = None, k: int | None = None) -> DataFrame:
    """Candidates (split, role, country are partitions) with rank <= k; other partitions aren't listed, the rank filter reaches the scan."""
    found = select_shards(spark.read.parquet(path), split, roles, countries)
    return found if k is None else found.where(F.col("rank") <= k)


def read_once(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    """A table that may hold each key once; the job fails at the first that repeats."""
    df = spark.read.parquet(path)
    counted = df.withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    bad = F.raise_error(F.concat(F.lit("repeated key "), F.concat_ws("|", *keys)))
    return counted.withColumn(keys[0], F.when(F.col("__n") > 1, bad.cast(df.schema[keys[0]].dataType)).otherwise(F.col(keys[0]))).drop("__n")


@dataclass(frozen=True)
class Layout:
    """How a matching file is written: its two columns, the sign between ids, brackets, or one pair a row."""

    s1: str = "source1_entity_id"
    match: str = "matched_entity_ids"
    sign: str = ","
    brackets: bool = False
    long: bool = False


def matching_layout(spark: SparkSession, path: str) -> Layout:
    """The layout of a matching file with a header, from one pass over its lines."""
    lines = spark.read.text(path)
    head = lines.where(F.lower("value").rlike("^(source1_entity_id|s1_id|id)\\t")).first()
    names = head[0].split("\t") if head else ["source1_entity_id", "matched_entity_ids"]
    rows = lines.where(F.col("value") != "\t".join(names)).withColumn("list", F.get(F.split("value", "\t"), F.lit(1)))
    signs = (",", ";", "|", " ")
    seen = rows.agg(F.count_if(F.col("list").startswith("[")).alias("brackets"), F.count(F.lit(1)).alias("rows"), F.count_distinct(F.split("value", "\t")[0]).alias("ids"), *(F.count_if(F.col("list").contains(c)).alias(f"s{i}") for i, c in enumerate(signs))).first()
    sign = next((c for i, c in enumerate(signs) if seen[f"s{i}"]), None)
    return Layout(names[0], names[1], sign or ",", seen["brackets"] > 0, sign is None and seen["ids"] < seen["rows"])


def write_like(long: DataFrame, order: DataFrame, path: str, layout: Layout) -> None:
    """Write pairs (s1_id, entity_id) in a layout: a row for each pair, or for each query of ``order`` (s1_id, position) with its sorted distinct ids."""
    if layout.long:
        out = long.select(F.col("s1_id").alias(layout.s1), F.col("entity_id").alias(layout.match))
    else:
        lists = long.groupBy("s1_id").agg(F.array_join(F.sort_array(F.collect_set("entity_id")), layout.sign).alias("m"))
        joined = order.select("s1_id", "position").join(lists, "s1_id", "left").withColumn("m", F.coalesce("m", F.lit("")))
        wrapped = F.concat(F.lit("["), "m", F.lit("]")) if layout.brackets else F.col("m")
        out = joined.orderBy("position").select(F.col("s1_id").alias(layout.s1), wrapped.alias(layout.match))
    out.write.mode("overwrite").csv(path, sep="\t", header=True, quote="", emptyValue="")


def write_report(row: DataFrame, path: str) -> None:
    """A report of one row as a JSON file; the committer makes it whole or nothing."""
    row.coalesce(1).write.mode("overwrite").json(path)


def register_upload(spark: SparkSession, path: str, name: str, parent: str, change: str, lists: DataFrame) -> None:
    """Register an upload before it is written, then write its lists once; a name that was used before is refused."""
    known = load_uploads(spark, path)
    if known is not None and known.where(F.col("name") == name).limit(1).count():
        raise ValueError(f"upload {name} exists and is never overwritten")
    entry = spark.createDataFrame([(name, parent, change)], "name string, parent string, change string")
    entry.coalesce(1).write.mode("append").json(f"{path}/uploads")
    lists.write.mode("errorifexists").csv(f"{path}/{name}", sep="\t", header=True, quote="", emptyValue="")


def load_uploads(spark: SparkSession, path: str) -> DataFrame | None:
    """name, parent, change of every registered upload; None if there is none."""
    if not exists(spark, f"{path}/uploads"):
        return None
    return spark.read.schema("name string, parent string, change string").json(f"{path}/uploads")


def read_vocabulary(spark: SparkSession, path: str, most: int = 10_000) -> dict[str, str]:
    """Native words and their spelling from a tab-separated file; a map that plans carry, so of bounded size."""
    rows = spark.read.csv(path, sep="\t", schema="word string, spelling string").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a vocabulary of more than {most} words doesn't fit a plan")
    return {r.word: r.spelling for r in rows}


def compare_runs(spark: SparkSession, path: str, base: str, new: str) -> DataFrame:
    """s1_id, a, b of the queries that both runs scored."""
    scores = spark.read.parquet(f"{path}/scores")
    side = lambda run, name: scores.where(F.col("run") == run).select("s1_id", F.col("f").alias(name))
    return side(base, "a").join(side(new, "b"), "s1_id")


def exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def pending_shards(source: DataFrame, stored: DataFrame | None, keys: Sequence[str]) -> DataFrame:
    """The shards of ``source`` that are not stored, or with another number of rows."""
    want = source.groupBy(*keys).agg(F.count(F.lit(1)).alias("__want"))
    if stored is None:
        return want.select(*keys)
    have = stored.groupBy(*keys).agg(F.count(F.lit(1)).alias("__have"))
    return want.join(have, list(keys), "left").where(~F.col("__want").eqNullSafe(F.col("__have"))).select(*keys)


def fill_shards(source: DataFrame, path: str, keys: Sequence[str], make: Callable[[DataFrame], DataFrame]) -> int:
    """Make and store the shards that miss under a path, a row for each row of ``source``; how many there were.

    A run that stopped is gone on with by the next; a shard is stored whole or not at all.
    """
    spark = source.sparkSession
    stored = spark.read.parquet(path) if exists(spark, path) else None
    pending = [tuple(r) for r in pending_shards(source, stored, keys).collect()]  # names of shards
    if pending:
        names = spark.createDataFrame(pending, source.select(*keys).schema)
        write_partitioned(make(source.join(F.broadcast(names), list(keys), "left_semi")), path, list(keys))
    return len(pending)
