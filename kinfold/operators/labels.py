"""Ground truth: pairs from comma lists, integrity, groups, profiles, stratified roles and audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinfold.operators.components import components
from kinfold.operators.joins import hot_keys, hot_left_join
from kinfold.session import written

ROLES = (("CE-FIT", 0.30), ("CE-DEV", 0.05), ("TREE-FIT", 0.30), ("TREE-DEV", 0.10), ("CALIBRATION", 0.10), ("HOLDOUT", 0.15))


def merge_lists(truth: DataFrame) -> DataFrame:
    """One row for each s1_id: its non-empty lists, sorted and joined by commas."""
    return truth.groupBy("s1_id").agg(F.array_join(F.sort_array(F.collect_list(F.when(F.trim("matched") != "", F.trim("matched")))), ",").alias("matched"))


def explode_pairs(truth: DataFrame) -> DataFrame:
    """s1_id, rec_id for every entry of the comma lists, trimmed, empty ones dropped."""
    return truth.select("s1_id", F.explode(F.split("matched", ",")).alias("rec_id")).withColumn("rec_id", F.trim("rec_id")).where("rec_id <> ''")


def integrity(pairs: DataFrame, s1: DataFrame, records: DataFrame, prefix: str) -> DataFrame:
    """One row: pairs, repeated pairs, wrong prefixes, records and queries that don't exist."""
    one = pairs.distinct()
    counts = pairs.agg(F.count(F.lit(1)).alias("n_pairs"), F.count_if(~F.col("rec_id").rlike(prefix)).alias("bad_prefix"))
    more = [
        one.agg(F.count(F.lit(1)).alias("n_distinct")),
        one.join(records.select("rec_id"), "rec_id", "left_anti").agg(F.count(F.lit(1)).alias("dangling_records")),
        one.join(s1.select("s1_id"), "s1_id", "left_anti").agg(F.count(F.lit(1)).alias("unknown_s1")),
    ]
    for m in more:
        counts = counts.join(F.broadcast(m))  # single rows
    return counts.withColumn("duplicate_pairs", F.col("n_pairs") - F.col("n_distinct"))


def multi_claimed(pairs: DataFrame) -> DataFrame:
    """rec_id, n_s1 for records that several queries claim."""
    return pairs.groupBy("rec_id").agg(F.count_distinct("s1_id").alias("n_s1")).where("n_s1 > 1")


def first_claim(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("rec_id").agg(F.min("s1_id").alias("s1_id"))


def entity_groups(s1: DataFrame, pairs: DataFrame) -> DataFrame:
    """s1_id, group_id: queries that share a record, directly or over others, are one group named by its least id.

    Every claimant of a record is linked with the record's least claimant; the
    components of these links are the groups. A record with very many claimants
    and a group with very many queries keep their rows where they lie.
    """
    claims = written(pairs.select("s1_id", "rec_id").distinct(), "claims")
    least = written(claims.groupBy("rec_id").agg(F.min("s1_id").alias("least"), F.count(F.lit(1)).alias("n")), "claims-least")
    total = least.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    linked = hot_left_join(claims, least.select("rec_id", "least"), "rec_id", hot_keys(least, "rec_id", "n", total))
    found = components(linked.select(F.col("s1_id").alias("a"), F.col("least").alias("b"))).withColumnRenamed("node", "s1_id")
    named = s1.select("s1_id").distinct().join(found, "s1_id", "left")
    return named.select("s1_id", F.coalesce("root", "s1_id").alias("group_id"))


def match_bucket(n: Column) -> Column:
    return F.when(n == 0, "0").when(n == 1, "1").when(n == 2, "2").when(n <= 5, "3-5").otherwise("6+")


def s1_profile(s1: DataFrame, pairs: DataFrame, is_s2: Column, is_cross: Column) -> DataFrame:
    """s1_id with n_matches, n_s2, n_s3, has_cross_script, is_singleton and match_bucket."""
    counts = pairs.groupBy("s1_id").agg(F.count(F.lit(1)).alias("n_matches"), F.count_if(is_s2).alias("n_s2"), F.max(is_cross).alias("has_cross_script"))
    out = s1.join(counts, "s1_id", "left").na.fill(0, ["n_matches", "n_s2"]).na.fill(False, ["has_cross_script"])
    return out.withColumn("n_s3", F.col("n_matches") - F.col("n_s2")).withColumn("is_singleton", F.col("n_matches") == 0).withColumn("match_bucket", match_bucket(F.col("n_matches")))


def assign_roles(groups: DataFrame, stratum: str, unit: str, seed: int = 42) -> DataFrame:
    """groups (one row for each unit) with entity_role: dealt in hash order within each stratum by cumulative shares.

    Units are groups of queries, so that a group never straddles roles.
    """
    order = F.md5(F.concat_ws("|", F.lit(seed).cast("string"), F.col(unit).cast("string")).cast("binary"))
    place = (F.row_number().over(Window.partitionBy(stratum).orderBy(order, unit)) - 0.5) / F.count(F.lit(1)).over(Window.partitionBy(stratum))
    role, bound = None, 0.0
    for name, share in ROLES[:-1]:
        bound = round(bound + share, 6)
        role = F.when(F.col("pos") < bound, name) if role is None else role.when(F.col("pos") < bound, name)
    return groups.withColumn("pos", place).withColumn("entity_role", role.otherwise(ROLES[-1][0]))


def role_balance(roles: DataFrame, by: str) -> DataFrame:
    """by, entity_role, n, share of the value's rows and distance to the target share."""
    target = F.element_at(F.create_map(*(F.lit(x) for kv in ROLES for x in kv)), F.col("entity_role"))
    out = roles.groupBy(by, "entity_role").agg(F.count(F.lit(1)).alias("n"))
    out = out.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(by)))
    return out.withColumn("deviation", F.col("share") - target)


def finalise(records: DataFrame, claims: DataFrame, roles: DataFrame) -> DataFrame:
    """Records with cluster_id ('' if unmatched) and role (POOL if unmatched) of the query that owns them."""
    mine = records.join(claims.select("rec_id", F.col("s1_id").alias("cluster_id")), "rec_id", "left").join(roles.select(F.col("s1_id").alias("cluster_id"), "entity_role"), "cluster_id", "left")
    return mine.withColumn("entity_role", F.coalesce("entity_role", F.lit("POOL"))).withColumn("cluster_id", F.coalesce(F.col("cluster_id").cast("string"), F.lit("")))


def value_audit(df: DataFrame, raw: str, norm: str) -> DataFrame:
    """norm, n, n_variants and the raw variants that collapse to it."""
    return df.groupBy(norm).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(raw).alias("n_variants"), F.array_join(F.sort_array(F.collect_set(raw)), "|").alias("variants"))


def only_in(test: DataFrame, train: DataFrame, column: str) -> DataFrame:
    """Values of the test side that the training side lacks."""
    return test.select(column).distinct().join(train.select(column).distinct(), column, "left_anti")


def stratified_sample(df: DataFrame, stratum: str, unit: Column, fractions: dict[str, float], forced: DataFrame, key: str) -> DataFrame:
    """Of each stratum the rows whose hash of ``unit`` lies below its fraction (0 if it has none), and all rows of ``forced`` keys."""
    table = F.create_map(*(F.lit(x) for kv in fractions.items() for x in kv))
    below = unit < F.coalesce(F.try_element_at(table, F.col(stratum)), F.lit(0.0))
    return df.where(below).unionByName(df.where(~below).join(forced.select(key), key, "left_semi"))


def positive_pairs(pairs: DataFrame, s1: DataFrame, records: DataFrame) -> DataFrame:
    """pairs (s1_id, rec_id) with role, country and script of the query and script, role and owner of the record; null where one is missing.

    s1: s1_id, entity_role, country, script; records: rec_id, script, entity_role, cluster_id.
    """
    mine = s1.select("s1_id", "entity_role", "country", F.col("script").alias("s1_script"))
    theirs = records.select("rec_id", F.col("script").alias("match_script"), F.col("entity_role").alias("match_role"), "cluster_id")
    return pairs.join(mine, "s1_id", "left").join(theirs, "rec_id", "left")


def pair_checks(labelled: DataFrame, multi: DataFrame, cross: Column) -> DataFrame:
    """One row of counts over ``positive_pairs``: records missing on either side, roles and owners that differ, records claimed twice, cross-script share."""
    several = multi.select("rec_id", F.lit(True).alias("__several"))
    df = labelled.join(several, "rec_id", "left").withColumn("__several", F.coalesce("__several", F.lit(False))).withColumn("__cross", cross)
    other = ~F.col("cluster_id").eqNullSafe(F.col("s1_id").cast("string"))
    return df.agg(
        F.count(F.lit(1)).alias("pairs"),
        F.count_if(F.col("s1_script").isNull()).alias("missing_s1_record"),
        F.count_if(F.col("match_script").isNull()).alias("missing_match_record"),
        F.count_if(~F.col("entity_role").eqNullSafe(F.col("match_role"))).alias("role_mismatch"),
        F.count_if("__several").alias("on_multi_claimed"),
        F.count_if(other & ~F.col("__several")).alias("owner_disagrees"),
        (100 * F.avg(F.coalesce(F.col("__cross"), F.lit(False)).cast("double"))).alias("cross_script_pct"),
    )


def qa_checks(s1: DataFrame, records: DataFrame, pairs: DataFrame, roles: DataFrame, slack: float = 0.02) -> DataFrame:
    """section, check, passed, detail: what must hold of labels, records and roles before anything is trained on them.

    s1: s1_id; records: rec_id, cluster_id, entity_role; pairs: s1_id, rec_id;
    roles: s1_id, entity_role.
    """
    first = first_claim(pairs).withColumnRenamed("s1_id", "__owner")
    owned = records.join(first, "rec_id", "left").join(roles.select(F.col("s1_id").alias("__owner"), F.col("entity_role").alias("__role")), "__owner", "left")
    target = F.element_at(F.create_map(*(F.lit(x) for kv in ROLES for x in kv)), F.col("entity_role"))
    share = roles.groupBy("entity_role").agg(F.count(F.lit(1)).alias("n")).withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))  # one row for each role
    zero = lambda df, condition, section, name: df.agg(F.count_if(condition).alias("n")).select(F.lit(section).alias("section"), F.lit(name).alias("check"), (F.col("n") == 0).alias("passed"), F.col("n").cast("string").alias("detail"))
    several = lambda df, key: df.groupBy(key).agg(F.count(F.lit(1)).alias("c"))
    parts = [
        zero(pairs.groupBy("s1_id", "rec_id").agg(F.count(F.lit(1)).alias("c")), F.col("c") > 1, "labels", "no pair twice"),
        zero(pairs.join(s1.select("s1_id", F.lit(True).alias("__k")), "s1_id", "left"), F.col("__k").isNull(), "labels", "queries known"),
        zero(pairs.join(records.select("rec_id", F.lit(True).alias("__k")), "rec_id", "left"), F.col("__k").isNull(), "labels", "records known"),
        zero(several(records, "rec_id"), F.col("c") > 1, "records", "ids unique"),
        zero(owned, F.col("cluster_id") != F.coalesce(F.col("__owner").cast("string"), F.lit("")), "records", "owner is the first claim"),
        zero(owned, F.col("entity_role") != F.coalesce("__role", F.lit("POOL")), "records", "role of the owner"),
        zero(several(roles, "s1_id"), F.col("c") > 1, "roles", "one role a query"),
        zero(s1.join(roles, "s1_id", "left"), F.col("entity_role").isNull(), "roles", "every query has one"),
        zero(share, F.abs(F.col("share") - target) > slack, "roles", "shares near their targets"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
