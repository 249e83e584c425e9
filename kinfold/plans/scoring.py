"""Token weights, similarity, statistics and model queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.functions import similarity
from kinfold.operators import evaluate, features, models, records, stats
from kinfold.plans import decisions, keys, retrieval
from kinfold.session import cut, table

WORDS = r"list_distinct(list_filter(regexp_split_to_array({x}, '[^\p{{L}}\p{{N}}_]+'), lambda t: t <> ''))"
IDF_SQL = f"""idf AS (SELECT token, count(*) AS df, ln((1.0 + (SELECT count(*) FROM conversations)) / (1 + count(*))) + 1 AS idf FROM (SELECT unnest({WORDS.format(x="text")}) AS token FROM conversations) GROUP BY token)"""


def idf_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = features.fit_idf(table(spark, sf_dir, "documents"), "text")
    return out.select("token", "df", F.round("idf", 6).alias("idf"))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    nxt = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("b"))
    return c.select("conv_id", "turn", F.col("text").alias("a")).join(nxt, ["conv_id", "turn"])


def token_overlap_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = features.overlap(turns(spark, sf_dir), "a", "b", features.fit_idf(table(spark, sf_dir, "conversations"), "text"), ["conv_id", "turn"])
    return out.select("conv_id", "turn", *(F.round(c, 6).alias(c) for c in out.columns[2:]))


OVERLAP = f"""WITH {IDF_SQL}, p AS (SELECT x.conv_id, x.turn, {WORDS.format(x="x.text")} AS a, {WORDS.format(x="y.text")} AS b FROM conversations x JOIN conversations y ON x.conv_id = y.conv_id AND y.turn = x.turn + 1),
e AS (SELECT conv_id, turn, a, b, unnest(list_distinct(list_concat(a, b))) AS token FROM p), w AS (SELECT conv_id, turn, list_contains(a, e.token) AS ia, list_contains(b, e.token) AS ib, idf AS w FROM e LEFT JOIN idf USING (token)),
s AS (SELECT conv_id, turn, sum(CASE WHEN ia AND ib THEN w ELSE 0 END) AS wi, sum(CASE WHEN ia THEN w ELSE 0 END) AS wa, sum(CASE WHEN ib THEN w ELSE 0 END) AS wb, count(*) FILTER (ia AND ib) AS ni, count(*) AS nu, coalesce(max(CASE WHEN ia AND ib THEN w END), 0) AS r FROM w GROUP BY ALL)
SELECT conv_id, turn, round(ni / nu, 6) AS tok_jaccard, round(wi / (wa + wb - wi), 6) AS idf_jaccard, round(CASE WHEN least(wa, wb) > 0 THEN wi / least(wa, wb) END, 6) AS idf_cover_min,
  round(CASE WHEN wa > 0 THEN 1 - wi / wa END, 6) AS s1_unmatched, round(CASE WHEN wb > 0 THEN 1 - wi / wb END, 6) AS cand_unmatched, round(r, 6) AS rarest_shared_idf FROM s"""


def name_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each name with the next and the seventh next."""
    n = keys.names(spark, sf_dir).select("id", "name")
    other = n.select(F.col("id").alias("id2"), F.col("name").alias("b"))
    return n.withColumn("id2", F.explode(F.array(F.col("id") + 1, F.col("id") + 7))).join(other, "id2").select("id", "id2", F.col("name").alias("a"), "b")


def name_lev_jw(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = similarity.score_pairs(name_pairs(spark, sf_dir), [("a", "b", "s")], ("jw",))
    return out.select("id", "id2", F.round("s.lev", 6).alias("lev"), F.round("s.jw", 6).alias("jw"))


LEV_JW = f"""WITH {keys.NAMES_SQL} SELECT x.id, y.id AS id2, round(1 - levenshtein(x.name, y.name) / greatest(length(x.name), length(y.name)), 6) AS lev, round(jaro_winkler_similarity(x.name, y.name), 6) AS jw
FROM names x JOIN names y ON y.id = x.id + 1 OR y.id = x.id + 7"""


def fuzz_ratio_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = similarity.score_pairs(name_pairs(spark, sf_dir), [("a", "b", "s")], ("ratio", "tset", "tsort", "partial"))
    return out.select("id", "id2", *(F.round(f"s.{c}", 6).alias(c) for c in ("ratio", "tset", "tsort", "partial")))


def char_ngram_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part name asks with its country, each kind of part name answers; equal questions are scored once."""
    n = keys.names(spark, sf_dir)
    pool = n.groupBy("name").agg(F.min("id").alias("cand_id"))
    asks = n.select(F.col("id").alias("asking"), F.concat_ws(" ", "name", "country").alias("ask"))
    kinds = cut(asks.groupBy("ask").agg(F.min("asking").alias("s1_id")))
    best = features.ngram_topk(kinds.select("s1_id", F.col("ask").alias("name")), pool, "name", 5)
    return asks.join(kinds, "ask").join(best, "s1_id").select(F.col("asking").alias("s1_id"), "cand_id", F.round("score", 6).alias("score"), "rank")


def pair_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All comparison features between prepared records; each asks for its four next neighbours by id."""
    raw = keys.raw_records(spark, sf_dir)
    ready = cut(records.prepare(raw).withColumn("id", F.regexp_replace("entity_id", "^S1-", "").cast("bigint")))
    pool = ready.withColumn("source", F.lit("S2"))
    pairs = ready.select(F.col("id").alias("s1_id"), F.lit("S2").alias("source"), F.explode(F.sequence(F.lit(1), F.lit(4))).alias("rank")).withColumn("cand_id", F.col("s1_id") + F.col("rank"))
    return features.pair_features(pairs, ready, pool, features.fit_idf(ready, "name_latin"), features.fit_idf(ready, "addr_latin"))


def leak_scan_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Direction-free AUC of each measure of a text for its quality label; near 1 is suspect."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").withColumn("words", F.size(F.split("text", " "))).withColumn("id_mod", F.col("doc_id") % 100)
    out = None
    for x in ("n_chars", "words", "id_mod"):
        row = stats.auc(d, x, "quality").select(F.lit(x).alias("feature"), F.round(F.greatest("auc", 1 - F.col("auc")), 6).alias("auc"), "n", "n_pos")
        out = row if out is None else out.unionByName(row)
    return out


def auc_sql(name: str, x: str) -> str:
    return f"""SELECT '{name}' AS feature, round(greatest(a, 1 - a), 6) AS auc, n, n_pos FROM (SELECT (sum(CASE WHEN y = 1 THEN r END) - np * (np + 1) / 2) / (np * (n - np)) AS a, n, np AS n_pos FROM
  (SELECT quality AS y, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0::DOUBLE AS r, count(*) OVER () AS n, (sum(quality) OVER ())::BIGINT AS np FROM (SELECT quality, {x} AS x FROM documents JOIN labels USING (doc_id))) GROUP BY n, np)"""


def spearman_redundant(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "orders").withColumn("keyed", F.col("o_orderkey") % 1000 + F.col("o_totalprice") / 1000)
    return stats.spearman(d, "o_totalprice", "keyed").select(F.round("rho", 6).alias("rho"))


SPEARMAN = """WITH r AS (SELECT rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0::DOUBLE AS ra, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2.0::DOUBLE AS rb FROM (SELECT o_totalprice AS a, o_orderkey % 1000 + o_totalprice / 1000 AS b FROM orders))
SELECT round(corr(ra, rb), 6) AS rho FROM r"""


def ks_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per event type: distance of the values of even and odd users; drop where over 0.1 (or null gap over 0.05)."""
    e = table(spark, sf_dir, "events").withColumn("side", F.col("user_id") % 2 == 0).withColumn("x", F.when(F.col("event_id") % 17 != 0, F.col("value")))
    out = stats.ks_two_sample(e, "x", "side", ("event_type",))
    return out.select("event_type", "n1", "n2", F.round("ks", 6).alias("ks"), F.round("null_gap", 6).alias("null_gap"), ((F.col("ks") > 0.1) | (F.col("null_gap") > 0.05)).cast("bigint").alias("drop"))


KS = """WITH e AS (SELECT event_type AS t, user_id % 2 = 0 AS g, CASE WHEN event_id % 17 <> 0 THEN value END AS x FROM events), s AS (SELECT t, count(*) FILTER (g AND x IS NOT NULL) AS n1, count(*) FILTER (NOT g AND x IS NOT NULL) AS n2, abs(avg(CASE WHEN g THEN (x IS NULL)::INT END) - avg(CASE WHEN NOT g THEN (x IS NULL)::INT END)) AS gap FROM e GROUP BY t),
c AS (SELECT t, x, sum(count(*) FILTER (g)) OVER w AS a, sum(count(*) FILTER (NOT g)) OVER w AS b FROM e WHERE x IS NOT NULL GROUP BY t, x WINDOW w AS (PARTITION BY t ORDER BY x))
SELECT t AS event_type, n1, n2, round(max(abs(a / n1 - b / n2)), 6) AS ks, round(gap, 6) AS null_gap, (max(abs(a / n1 - b / n2)) > 0.1 OR any_value(gap) > 0.05)::BIGINT AS drop FROM c JOIN s USING (t) GROUP BY ALL"""


def s1_subsample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").where(stats.hash_unit(F.col("o_orderkey")) < 0.2).select(F.col("o_orderkey").alias("s1_id"))


def error_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = models.error_examples(decisions.pairs(spark, sf_dir), "p", 0.45, 10)
    return out.select("s1_id", "source", "cand_id", "error", "p")


ERRORS = f"""WITH {decisions.PAIRS}, fp AS (SELECT s1_id, source, cand_id, 'false positive' AS error, p FROM pairs WHERE label = 0 AND p >= 0.45 ORDER BY p DESC, s1_id, cand_id LIMIT 10),
fn AS (SELECT s1_id, source, cand_id, 'false negative' AS error, p FROM pairs WHERE label = 1 AND p < 0.45 ORDER BY p, s1_id, cand_id LIMIT 10) SELECT * FROM fp UNION ALL SELECT * FROM fn"""


def hard_negative_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.mine_pairs(decisions.pairs(spark, sf_dir), retrieval.sidecar(spark, sf_dir).where("s1_id % 4 <> 0"), hard=2, hard_rank=3, random=1).withColumn("label", F.col("label").cast("bigint"))


MINING = f"""WITH {decisions.PAIRS}, {retrieval.POSITIVES}, neg AS (SELECT *, row_number() OVER (PARTITION BY s1_id ORDER BY rank, cand_id) AS k FROM pairs WHERE label = 0),
d AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY s1_id ORDER BY md5(s1_id || '|' || source || '|' || cand_id)) AS d FROM neg WHERE k > 2) WHERE d <= 1)
SELECT s1_id, source, cand_id, 1::BIGINT AS label, 'positive' AS kind FROM pairs WHERE label = 1 UNION ALL SELECT s1_id, source, cand_id, 0, 'hard' FROM neg WHERE k <= 2 AND rank <= 3 UNION ALL SELECT s1_id, source, cand_id, 0, 'random' FROM d
UNION ALL SELECT s1_id, source, cand_id, 1, 'missed' FROM side WHERE in_pool AND s1_id % 4 <> 0 AND (s1_id, source, cand_id) NOT IN (SELECT (s1_id, source, cand_id) FROM pairs)"""

NUMERIC = ("score", "rank", "score_gap_top1", "score_gap_next")


def training(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kinfold.operators import context

    return context.list_scores(decisions.pairs(spark, sf_dir).drop("p")).withColumn("u", stats.hash_unit(F.col("s1_id")))


def pair_model_gbt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p for every pair by boosted trees that never see the fold they score."""
    d = training(spark, sf_dir)
    model = models.fit_trees(d.where("u < 0.6"), d.where("u >= 0.6 AND u < 0.8"), NUMERIC, ("source",))
    return models.score(model, d, NUMERIC).select("s1_id", "source", "cand_id", "label", "p")


def scorer_logreg(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = training(spark, sf_dir)
    return models.score(models.fit_margin(d.where("u < 0.6"), NUMERIC), d, NUMERIC).select("s1_id", "source", "cand_id", "label", "logit")


def group_bakeoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leave-one-group-out margins against the full model, by paired resampling of the queries."""
    d, u = training(spark, sf_dir), decisions.universe(spark, sf_dir)
    scored = lambda cols: models.score(models.fit_margin(d.where("u < 0.6"), cols), d, cols)
    base = evaluate.per_query(u, scored(NUMERIC), F.col("p") >= 0.5)
    out = None
    for name, cols in (("without gaps", NUMERIC[:2]), ("without rank", (NUMERIC[0], *NUMERIC[2:]))):
        row = evaluate.paired_bootstrap(base, evaluate.per_query(u, scored(cols), F.col("p") >= 0.5)).withColumn("variant", F.lit(name))
        out = row if out is None else out.unionByName(row)
    return out


QUERIES = {f.__name__: f for f in (idf_fit, token_overlap_idf, name_lev_jw, fuzz_ratio_family, char_ngram_topk, pair_features, leak_scan_auc, spearman_redundant, ks_parity, s1_subsample, error_examples, hard_negative_mining, pair_model_gbt, scorer_logreg, group_bakeoff)}
ORACLE = {
    "idf_fit": "SELECT token, count(*) AS df, round(ln((1.0 + (SELECT count(*) FROM documents)) / (1 + count(*))) + 1, 6) AS idf FROM (SELECT unnest(" + WORDS.format(x="text") + ") AS token FROM documents) GROUP BY token",
    "token_overlap_idf": OVERLAP,
    "name_lev_jw": LEV_JW,
    "leak_scan_auc": " UNION ALL ".join(auc_sql(*x) for x in (("n_chars", "n_chars"), ("words", "len(string_split(text, ' '))"), ("id_mod", "doc_id % 100"))),
    "spearman_redundant": SPEARMAN,
    "ks_parity": KS,
    "s1_subsample": "SELECT o_orderkey AS s1_id FROM orders WHERE (('0x' || substr(md5(o_orderkey::VARCHAR), 1, 8))::BIGINT % 1000000) / 1000000 < 0.2",
    "error_examples": ERRORS,
    "hard_negative_mining": MINING,
}
