"""Operator 10: URL filters against a dated list. DataFrame functions only.

Dated entries (key, listed_on, action, category) become validity intervals by
key; the intervals of a host and of its parent domains are cut at their ends
into disjoint segments, each with the entry that counts in it; every capture
then looks up the one segment in force on its day.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinfold.llm.common import hot_keys, hot_left_join, written

HOST = r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:@]+)"


def host(url: Column) -> Column:
    """Lower-case host of an absolute URL without user, port and final dots; null if there is none."""
    return F.nullif(F.regexp_replace(F.regexp_extract(F.lower(url), HOST, 1), r"\.+$", ""), F.lit(""))


def suffixes(name: Column) -> Column:
    """The host and its parent domains of two labels or more; an address in brackets has none."""
    parts = F.split(name, r"\.")
    n = F.size(parts)
    return F.when((n >= 2) & ~name.startswith("["), F.transform(F.sequence(F.lit(0), n - 2), lambda i: F.array_join(F.slice(parts, i + 1, n - i), "."))).otherwise(F.array(name))


def intervals(entries: DataFrame) -> DataFrame:
    """key, category, valid_from, valid_to (null: open) of the times in which an entry is active.

    A category's removal ends that category alone. Of entries of a key and a
    category on one day the last action by name counts (a removal beats an
    addition), so both have no more intervals than the list has days.
    """
    daily = entries.where("key IS NOT NULL AND listed_on IS NOT NULL").groupBy("key", "category", "listed_on").agg(F.max("action").alias("__last"))
    by_day = Window.partitionBy("key", "category").orderBy("listed_on")
    dated = daily.withColumn("valid_to", F.lead("listed_on").over(by_day)).where("__last = 'add'")
    return dated.select("key", "category", F.col("listed_on").alias("valid_from"), "valid_to")


def timeline(hosts: DataFrame, entries: DataFrame) -> DataFrame:
    """host, seg_from, seg_to and the entry that counts: of the longest key, then the latest, then the last category by name.

    A domain above very many hosts keeps them where they lie and is sent its
    intervals: as many as it has categories and days in the list.
    """
    keyed = written(hosts.select("host", F.explode(suffixes(F.col("host"))).alias("key")), "url-keys")
    uses = written(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")), "url-uses")
    total = uses.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    held = written(hot_left_join(keyed, intervals(entries), "key", hot_keys(uses, "key", "n", total)).where("valid_from IS NOT NULL"), "url-held")
    ends = held.select("host", F.explode(F.array("valid_from", "valid_to")).alias("seg_from")).where("seg_from IS NOT NULL").distinct()
    cuts = ends.withColumn("seg_to", F.lead("seg_from").over(Window.partitionBy("host").orderBy("seg_from")))
    inside = (F.col("valid_from") <= F.col("seg_from")) & (F.col("valid_to").isNull() | (F.col("valid_to") > F.col("seg_from")))
    best = F.max(F.struct(F.length("key").alias("n"), "valid_from", "key", "category")).alias("best")
    counted = cuts.join(held, "host").where(inside).groupBy("host", "seg_from", "seg_to").agg(best)
    entry = (F.col("best.key").alias("matched_key"), F.col("best.category").alias("category"), F.col("best.valid_from").alias("listed_on"))
    return counted.select("host", "seg_from", "seg_to", *entry)


def url_filter(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """Each capture (page_id, url, fetched_on) with blocked, matched_key, category and listed_on.

    Captures of a host with over 1/256 of all rows stay where they are and get
    that host's segments, at most one for each day of the list, by broadcast.

    Defined cases: a null or relative url has a null host and isn't blocked, nor
    is a capture without a day; final dots of a host don't count, an address in
    brackets is a host without parents; an entry counts from its day on, a removal
    from its day on and for its category alone; entries with a null key or day are
    void, a null category is one of its own, null actions do nothing; very long
    urls are read whole; repeated rows stay as they are; empty tables give no
    rows, or none blocked; other columns of either table are left out.
    """
    seen = captures.select("page_id", "url", "fetched_on", host(F.col("url")).alias("host"))
    hosts = written(seen.groupBy("host").agg(F.count(F.lit(1)).alias("n")), "url-hosts")
    total = hosts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    lines = written(timeline(hosts.where("host IS NOT NULL"), entries.select("key", "listed_on", "action", "category")), "url-timeline")
    at = (F.col("seg_from") <= F.col("fetched_on")) & (F.col("seg_to").isNull() | (F.col("fetched_on") < F.col("seg_to")))
    joined = hot_left_join(seen, lines, "host", hot_keys(hosts, "host", "n", total), at)
    return joined.select("page_id", "url", "host", "fetched_on", F.col("matched_key").isNotNull().alias("blocked"), "matched_key", "category", "listed_on")


def page_captures(pages: DataFrame) -> DataFrame:
    """``pages`` carry no fetch times; the query gives each a day of two years by its id."""
    return pages.select("page_id", "url", F.date_add(F.lit("2024-01-01").cast("date"), F.pmod(F.col("page_id"), F.lit(730)).cast("int")).alias("fetched_on"))


def page_entries(pages: DataFrame) -> DataFrame:
    """A dated list over the domains of ``pages``, made from a hash of the domain: added, some removed and added again."""
    keys = pages.select(host(F.col("url")).alias("host")).where("host IS NOT NULL").distinct().select(F.explode(suffixes(F.col("host"))).alias("key")).distinct()
    h = F.conv(F.substring(F.md5(F.col("key").cast("binary")), 1, 8), 16, 10).cast("bigint")
    kind = F.element_at(F.array(*map(F.lit, ("adult", "malware", "spam"))), F.pmod(F.col("h"), F.lit(3)).cast("int") + 1)
    day = F.date_add(F.lit("2024-01-01").cast("date"), F.pmod(F.floor(F.col("h") / 32), F.lit(365)).cast("int"))
    made = F.array(
        F.struct(F.col("day").alias("listed_on"), F.lit("add").alias("action"), F.pmod("h", F.lit(4)).alias("every")),
        F.struct(F.date_add("day", 90).alias("listed_on"), F.lit("remove").alias("action"), F.pmod("h", F.lit(8)).alias("every")),
        F.struct(F.date_add("day", 200).alias("listed_on"), F.lit("add").alias("action"), F.pmod("h", F.lit(16)).alias("every")),
    )
    return keys.withColumn("h", h).withColumn("day", day).select("key", kind.alias("category"), F.explode(made).alias("e")).where("e.every = 0").select("key", "e.listed_on", "e.action", "category")


ORACLE = r"""
WITH c AS (
  SELECT page_id, url, nullif(regexp_replace(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:@]+)', 1), '\.+$', ''), '') AS host,
         DATE '2024-01-01' + (page_id % 730)::INTEGER AS fetched_on
  FROM pages),
x AS (SELECT DISTINCT host, string_split(host, '.') AS p FROM c WHERE host IS NOT NULL),
k AS (
  SELECT host, unnest(CASE WHEN len(p) >= 2 AND NOT starts_with(host, '[') THEN list_transform(generate_series(1, len(p) - 1), lambda i: array_to_string(p[i:], '.')) ELSE [host] END) AS key FROM x),
h AS (SELECT DISTINCT key, ('0x' || substr(md5(key), 1, 8))::BIGINT AS h FROM k),
g AS (SELECT key, h, ['adult', 'malware', 'spam'][(h % 3)::INTEGER + 1] AS category, DATE '2024-01-01' + ((h // 32) % 365)::INTEGER AS day FROM h),
e AS (
  SELECT key, category, day AS listed_on, 'add' AS action FROM g WHERE h % 4 = 0
  UNION ALL SELECT key, category, day + 90, 'remove' FROM g WHERE h % 8 = 0
  UNION ALL SELECT key, category, day + 200, 'add' FROM g WHERE h % 16 = 0),
v AS (SELECT * FROM (SELECT key, category, action, listed_on AS valid_from, lead(listed_on) OVER (PARTITION BY key, category ORDER BY listed_on) AS valid_to FROM e) WHERE action = 'add'),
m AS (
  SELECT c.page_id, c.url, k.key, v.category, v.valid_from,
         row_number() OVER (PARTITION BY c.page_id ORDER BY length(k.key) DESC, v.valid_from DESC, v.category DESC) AS r
  FROM c JOIN k ON c.host = k.host JOIN v ON v.key = k.key AND v.valid_from <= c.fetched_on AND (v.valid_to IS NULL OR c.fetched_on < v.valid_to))
SELECT c.page_id, c.url, c.host, strftime(c.fetched_on, '%Y-%m-%d') AS fetched_on, m.key IS NOT NULL AS blocked, m.key AS matched_key, m.category,
       strftime(m.valid_from, '%Y-%m-%d') AS listed_on
FROM c LEFT JOIN m ON c.page_id = m.page_id AND m.r = 1
"""
