"""Queries on features, slices, coverage and text forms, with SQL of their own wording."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.functions import text, vocab
from kinfold.operators import blocking, context, evaluate, features, models, records, stats
from kinfold.plans import decisions, keys
from kinfold.plans.context import ENS_SQL, SCORED_SQL, rounded, scored, stats_sql
from kinfold.plans.retrieval import TOPK_SQL, topk
from kinfold.plans.stores import ROLE_SQL, role_of
from kinfold.session import cut, table

IDS = ("s1_id", "source", "cand_id")


def dense_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = keys.names(spark, sf_dir).select("id", F.col("name").alias("name_norm"), F.when(F.col("id") % 6 != 0, F.col("addr")).alias("addr_norm"))
    return n.select("id", blocking.dense_texts(n, "query: ").alias("text"))


def hashed_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vector of eight components for every name, one row for each component."""
    n = keys.names(spark, sf_dir).select("id", "name").repartition("id")  # a small file is one task otherwise
    n = n.select("id", blocking.hashed_embedding(F.col("name"), 8).alias("v"))
    return n.select("id", F.posexplode("v").alias("axis", "x")).select("id", F.col("axis").cast("bigint").alias("axis"), F.round("x", 6).alias("x"))


EMBEDDED = f"""WITH {keys.NAMES_SQL}, g AS (SELECT id, unnest(CASE WHEN length(name) < 3 THEN [lower(name)] ELSE list_transform(generate_series(1, length(name) - 2), lambda i: substr(lower(name), i, 3)) END) AS g FROM names),
h AS (SELECT id, ('0x' || substr(md5(g), 1, 8))::BIGINT AS h FROM g), s AS (SELECT id, h % 8 AS axis, sum(CASE WHEN (h // 8) % 2 = 0 THEN 1.0 ELSE -1.0 END) AS x FROM h GROUP BY ALL),
a AS (SELECT names.id, r.axis, coalesce(s.x, 0)::DOUBLE AS x FROM names CROSS JOIN range(8) r(axis) LEFT JOIN s ON s.id = names.id AND s.axis = r.axis)
SELECT id, axis, round(CASE WHEN sqrt(sum(x * x) OVER (PARTITION BY id)) > 0 THEN x / sqrt(sum(x * x) OVER (PARTITION BY id)) ELSE 0 END, 6) AS x FROM a"""


def routed_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocking.routed(keys.names(spark, sf_dir).select("id", "country"), "country", {"INDIA": "india-model", "US": "us-model"}, "us-model").select("id", "route")


def script_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Made-up scripts by id: family and group."""
    script = F.element_at(F.array(*map(F.lit, ("latin", "tamil", "empty", "numeric", "cjk"))), (F.col("p_partkey") % 5 + 1).cast("int"))
    d = table(spark, sf_dir, "part").select("p_partkey", script.alias("script"), (F.col("p_partkey") % 7 == 0).alias("mixed"))
    return d.select("p_partkey", text.script_family(F.col("script")).alias("family"), text.script_group(F.col("script"), F.col("mixed")).alias("grp"))


SCRIPT_GROUPS = """WITH s AS (SELECT p_partkey, ['latin', 'tamil', 'empty', 'numeric', 'cjk'][(p_partkey % 5)::INT + 1] AS s, p_partkey % 7 = 0 AS m FROM part)
SELECT p_partkey, CASE WHEN s IN ('empty', 'numeric') THEN 'none' ELSE s END AS family, CASE WHEN s IN ('empty', 'numeric') THEN 'none' WHEN m THEN 'mixed' WHEN s = 'latin' THEN 'latin' ELSE 'non_latin' END AS grp FROM s"""


def native_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names with some words replaced by a vocabulary."""
    n = keys.names(spark, sf_dir)
    return n.select("id", text.native_vocabulary(F.col("name"), {"small": "petit", "ring": "anneau", "ltd": "limitada"}).alias("name"))


NATIVE = f"WITH {keys.NAMES_SQL} SELECT id, array_to_string(list_transform(string_split(name, ' '), lambda t: CASE t WHEN 'small' THEN 'petit' WHEN 'ring' THEN 'anneau' WHEN 'ltd' THEN 'limitada' ELSE t END), ' ') AS name FROM names"


def romanised_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brand names in Cyrillic letters, romanised again."""
    written = F.translate(F.lower("p_brand"), "brand#", "бранд ")
    return table(spark, sf_dir, "part").select("p_partkey", text.romanise(written).alias("roman"))


def text_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """URL tails, repeated words, countries and token counts of made-up rows."""
    k = F.col("p_partkey")
    raw = F.concat("p_name", F.when(k % 3 == 0, F.concat(F.lit(" | www."), F.replace("p_name", F.lit(" "), F.lit("-")), F.lit(".com/x"))).otherwise(""))
    country = F.element_at(F.array(*map(F.lit, ("u.s.a.", "India", "bharat", "fra", " ", "Peru"))), (k % 6 + 1).cast("int"))
    d = table(spark, sf_dir, "part").select("p_partkey", raw.alias("raw"), F.concat_ws(" ", "p_name", "p_name", F.lit("x")).alias("twice"), country.alias("country"))
    return d.select("p_partkey", text.strip_name_url(F.col("raw")).alias("name"), text.collapse_repeats(F.col("twice")).alias("once"), text.normalise_country(F.col("country")).alias("country"), text.n_tokens(F.col("twice")).cast("bigint").alias("n"))


MARKS = """SELECT p_partkey, p_name AS name, p_name || ' x' AS once, ['US', 'INDIA', 'INDIA', 'FRANCE', 'UNKNOWN', 'PERU'][(p_partkey % 6)::INT + 1] AS country, 2 * (length(p_name) - length(replace(p_name, ' ', '')) + 1) + 1 AS n FROM part"""
PHRASES = {"private limited": "pvt ltd", "limited liability company": "llc", "international": "intl", "saint": "st", "and": "&"}


def canonical_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names with a phrase behind them, initials before them."""
    phrase = F.element_at(F.array(*map(F.lit, PHRASES)), (F.col("p_partkey") % len(PHRASES) + 1).cast("int"))
    d = table(spark, sf_dir, "part").select("p_partkey", F.concat_ws(" ", F.lit("j k"), "p_name", phrase).alias("name"))
    return d.select("p_partkey", text.canonical_name(F.col("name")).alias("name"))


CANONICAL = f"SELECT p_partkey, 'jk ' || p_name || ' ' || {list(PHRASES.values())}[(p_partkey % {len(PHRASES)})::INT + 1] AS name FROM part"


def name_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folded names and their keys without legal forms and stop words."""
    n = keys.names(spark, sf_dir)
    k = text.parse_name(F.upper("name"))
    return n.select("id", text.fold(F.upper("name")).alias("folded"), k["name_key"].alias("name_key"), F.array_join(F.array_sort(k["name_toks"]), " ").alias("toks"), k["name_first"].alias("name_first"))


DROP = ", ".join(f"'{w}'" for w in sorted(vocab.LEGAL_FORMS | vocab.STOP_WORDS))
NAME_KEYS = f"""WITH {keys.NAMES_SQL}, f AS (SELECT id, trim(regexp_replace(lower(name), '[^a-z0-9]+', ' ', 'g')) AS folded FROM names), t AS (SELECT id, folded, list_filter(string_split(folded, ' '), lambda t: t <> '' AND t NOT IN ({DROP})) AS t FROM f)
SELECT id, folded, array_to_string(t, ' ') AS name_key, array_to_string(list_sort(list_distinct(t)), ' ') AS toks, coalesce(t[1], '') AS name_first FROM t"""


def pair_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postal codes, street numbers and first words of neighbours compared."""
    n = keys.names(spark, sf_dir).withColumn("postal", text.postal_code(F.lower("addr"), F.col("country"))).withColumn("street", text.street_number(F.lower("addr"), F.col("postal")))
    n = n.select("id", "postal", "street", F.split("name", " ")[0].alias("word"))
    b = n.select((F.col("id") - 1).alias("id"), *(F.col(c).alias(f"b_{c}") for c in ("postal", "street", "word")))
    col = F.col
    return n.join(b, "id").select(
        "id", features.postal_state(col("postal"), col("b_postal")).cast("bigint").alias("postal_state"), features.state(col("street"), col("b_street")).cast("bigint").alias("street_state"),
        features.equal_nonempty(col("word"), col("b_word")).cast("bigint").alias("first_eq"),
    )


STATES = rf"""WITH {keys.NAMES_SQL}, p AS (SELECT id, name, country, lower(addr) AS a FROM names), q AS (SELECT *, {keys.postal_sql()} AS postal FROM p),
s AS (SELECT id, postal, CASE WHEN regexp_extract(a, '^(\d{{1,6}}[a-z]?)\b', 1) <> postal THEN regexp_extract(a, '^(\d{{1,6}}[a-z]?)\b', 1) ELSE '' END AS street, string_split(name, ' ')[1] AS word FROM q)
SELECT x.id, CASE WHEN x.postal = '' AND y.postal = '' THEN 0 WHEN x.postal = '' OR y.postal = '' THEN 1 WHEN x.postal = y.postal THEN 2 WHEN levenshtein(x.postal, y.postal) = 1 THEN 3 ELSE 4 END AS postal_state,
  CASE WHEN x.street = '' AND y.street = '' THEN 0 WHEN x.street = '' OR y.street = '' THEN 1 WHEN x.street = y.street THEN 2 ELSE 3 END AS street_state, (x.word = y.word AND x.word <> '')::BIGINT AS first_eq FROM s x JOIN s y ON y.id = x.id + 1"""


def record_histograms(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = records.prepare(keys.raw_records(spark, sf_dir))
    return records.histograms(r, ("country_norm", "name_script", "name_missing", "name_is_mixed_script", "has_landmark"))


HISTOGRAMS = f"""WITH {keys.NAMES_SQL}, v AS (SELECT unnest(['country_norm', 'name_script', 'name_missing', 'name_is_mixed_script', 'has_landmark']) AS "column", unnest([country, 'latin', 'false', 'false', 'true']) AS value FROM names)
SELECT "column", value, count(*) AS n FROM v GROUP BY ALL"""


def pair_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of neighbours; their scripts differ by a rule of ids."""
    script = F.when(F.col("id") % 4 == 0, "tamil").otherwise("latin")
    r = keys.names(spark, sf_dir).select("id", F.col("name").alias("name_norm"), F.col("addr").alias("addr_norm"), script.alias("name_script"), F.upper("name").alias("name_latin"), F.upper("addr").alias("addr_latin"))
    pairs = r.select(F.col("id").alias("s1_id"), F.lit("S2").alias("source"), (F.col("id") + 1).alias("cand_id")).join(r.select(F.col("id").alias("cand_id")), "cand_id", "left_semi")
    out = models.pair_texts(pairs, r, r.withColumn("source", F.lit("S2")), native=False)
    return out.select("s1_id", "cand_id", "s1_text", "cand_text", F.col("cross_script").cast("bigint").alias("cross_script"))


PAIR_TEXTS = f"""WITH {keys.NAMES_SQL}, t AS (SELECT id, name || ' | ' || addr || ' | ' || upper(name) || ' | ' || upper(addr) AS t, id % 4 = 0 AS s FROM names)
SELECT x.id AS s1_id, y.id AS cand_id, x.t AS s1_text, y.t AS cand_text, (x.s <> y.s)::BIGINT AS cross_script FROM t x JOIN t y ON y.id = x.id + 1"""


def token_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "conversations").withColumn("n", F.size(F.split("text", " ")))
    return models.length_limit(d, "n").select(*(F.round(c, 6).alias(c) for c in ("p50", "p90", "p99")), "max_len")


LENGTHS = """WITH n AS (SELECT len(string_split(text, ' ')) AS n FROM conversations), q AS (SELECT quantile_cont(n, 0.5) AS p50, quantile_cont(n, 0.9) AS p90, quantile_cont(n, 0.99) AS p99 FROM n)
SELECT round(p50, 6) AS p50, round(p90, 6) AS p90, round(p99, 6) AS p99, least(ceil(p99 / 8) * 8, 256)::BIGINT AS max_len FROM q"""


def claimants_of_all_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claimant context of two roles, among the claimants of all three."""
    df = context.ensemble(scored(spark, sf_dir), "v2_logit", "v1_logit").withColumn("role", role_of("s1_id"))
    out = context.claimants_of_all_roles(df, "ens_logit", ("s1_id",), ("TREE-FIT", "TREE-DEV"))
    return rounded(out, (*IDS, "rec_rank", "rec_n_valid"), ("rec_gap_top", "rec_share"))


ALL_ROLES = f"""WITH {SCORED_SQL}, {ENS_SQL}, {stats_sql("ens", "cr", "source, cand_id", "ens_logit", "s1_id")}
SELECT s1_id, source, cand_id, rk AS rec_rank, nv AS rec_n_valid, round(gap_top, 6) AS rec_gap_top, round(sh, 6) AS rec_share FROM cr WHERE {ROLE_SQL} <> 'HOLDOUT'"""


def feature_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of each variant, with and without a first scorer."""
    rows = [(upto, int(first), i, f) for upto in context.LEVELS for first in (True, False) for i, f in enumerate(context.variant(["score"], upto, first))]
    return spark.createDataFrame(rows, "variant string, first_scorer long, place long, feature string")


def variants_sql() -> str:
    """The lists written out level by level, each variant with those before it."""
    names = {"BASE": "v2_logit v2_rank v2_gap_top v2_gap_next v2_share", "L0": "ens_logit ce_min ce_absdiff ce_sign_agree", "L1": "ens_rank ens_gap_top ens_gap_next ens_share ens_entropy ens_z v1_rank v1_gap_top rank_shift", "L2": "rec_rank rec_n_pos rec_share rec_gap_best mutual_best"}
    rows = ", ".join(f"({i}, '{level}', '{f}', {j})" for i, (level, fs) in enumerate(names.items()) for j, f in enumerate(fs.split()))
    return f"""WITH l(lv, level, feature, j) AS (VALUES (-1, '', 'score', 0), {rows}), v AS (SELECT DISTINCT lv, level FROM l WHERE lv >= 0), s AS (SELECT unnest([1, 0])::BIGINT AS first_scorer)
SELECT v.level AS variant, first_scorer, row_number() OVER (PARTITION BY v.level, first_scorer ORDER BY l.lv, l.j) - 1 AS place, l.feature FROM v CROSS JOIN s JOIN l ON l.lv <= v.lv
WHERE first_scorer = 1 OR l.feature NOT IN ('ce_min', 'ce_absdiff', 'ce_sign_agree', 'v1_rank', 'v1_gap_top')"""


def group_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "orders").withColumn("digits", F.col("o_orderkey") % 97)
    out = stats.group_percentiles(e, "o_orderpriority", ("o_totalprice", "digits"))
    return out.select("o_orderpriority", "feature", F.round("p50", 4).alias("p50"), F.round("p90", 4).alias("p90"))


PERCENTILES = " UNION ALL ".join(f"SELECT o_orderpriority, '{n}' AS feature, round(quantile_cont({x}, 0.5), 4)::DOUBLE AS p50, round(quantile_cont({x}, 0.9), 4)::DOUBLE AS p90 FROM orders GROUP BY 1" for n, x in (("o_totalprice", "o_totalprice"), ("digits", "o_orderkey % 97")))


def logit_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logits miss for some pairs and exist for some beyond the limit."""
    all_ = topk(spark, sf_dir).withColumn("role", role_of("s1_id"))
    logits = all_.where("(rank <= 3 AND NOT (role = 'HOLDOUT' AND cand_id % 9 = 0)) OR (role = 'TREE-DEV' AND rank = 4 AND cand_id % 7 = 0)")
    return context.logit_coverage(all_, logits, ("role",), 3).withColumn("ok", F.col("ok").cast("bigint"))


COVERAGE = f"""WITH {TOPK_SQL}, r AS (SELECT *, {ROLE_SQL} AS role FROM topk), c AS (SELECT role, rank <= 3 AS w, (rank <= 3 AND NOT (role = 'HOLDOUT' AND cand_id % 9 = 0)) OR (role = 'TREE-DEV' AND rank = 4 AND cand_id % 7 = 0) AS h FROM r)
SELECT role, count(*) FILTER (w) AS rows, count(*) FILTER (h) AS logits, count(*) FILTER (w AND NOT h) AS missing, count(*) FILTER (h AND NOT w) AS extra, (count(*) FILTER (w <> h) = 0)::BIGINT AS ok FROM c GROUP BY role"""


def named_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = evaluate.per_query(decisions.universe(spark, sf_dir), decisions.pairs(spark, sf_dir), F.col("p") >= 0.45).withColumn("cross", (F.col("n_true") > 0) & (F.col("s1_id") % 7 < 2))
    return evaluate.named_slices(per, "country", "cross").select("slice", F.round("s1_macro_f05", 6).alias("s1_macro_f05"), "n_s1")


SLICES = f"""WITH {decisions.PAIRS}, {decisions.per_query_sql("p >= 0.45")}, c AS (SELECT *, n_true > 0 AND s1_id % 7 < 2 AS cross_, 'country=' || country AS g FROM f),
l AS (SELECT f, unnest(list_filter([CASE WHEN n_true = 0 THEN 'singleton' ELSE 'matched' END, CASE WHEN cross_ THEN 'cross_script' WHEN n_true > 0 THEN 'same_script' END, g, CASE WHEN n_true = 0 THEN g || '|singleton' END, CASE WHEN cross_ THEN g || '|cross_script' END], lambda x: x IS NOT NULL)) AS slice FROM c)
SELECT slice, round(avg(f), 6) AS s1_macro_f05, count(*) AS n_s1 FROM l GROUP BY slice"""


def pair_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = decisions.pairs(spark, sf_dir).withColumn("side", F.when(F.col("cand_id") % 4 != 0, F.col("cand_id") % 2))
    return evaluate.pair_slices(d, "p", 0.45, ("source", "side")).select("slice", "n", "n_pos", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f05")))


PAIR_SLICES = f"""WITH {decisions.PAIRS}, l AS (SELECT label, p >= 0.45 AS a, unnest(list_filter(['source=' || source, CASE WHEN cand_id % 4 <> 0 THEN 'side=' || cand_id % 2 END], lambda x: x IS NOT NULL)) AS slice FROM pairs),
s AS (SELECT slice, count(*) AS n, sum(label)::BIGINT AS n_pos, count(*) FILTER (a)::DOUBLE AS k, count(*) FILTER (a AND label = 1)::DOUBLE AS tp FROM l GROUP BY slice)
SELECT slice, n, n_pos, round(CASE WHEN k > 0 THEN tp / k END, 6) AS precision, round(CASE WHEN n_pos > 0 THEN tp / n_pos END, 6) AS recall, round(CASE WHEN tp > 0 THEN 1.25 * (tp / k) * (tp / n_pos) / (0.25 * tp / k + tp / n_pos) ELSE 0 END, 6) AS f05 FROM s"""


def label_sanity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of unknown queries, odd labels and repeated pairs by rules of ids."""
    d = decisions.pairs(spark, sf_dir).select(*IDS, "label")
    odd = d.withColumn("label", F.when(F.col("cand_id") % 31 == 0, 2).otherwise(F.col("label")))
    spoiled = odd.unionByName(odd.where("s1_id % 35 = 0")).unionByName(odd.where("s1_id % 45 = 0").withColumn("s1_id", -1 - F.col("s1_id")))
    return evaluate.label_sanity(decisions.universe(spark, sf_dir), spoiled)


SANITY = f"""WITH {decisions.PAIRS}, o AS (SELECT s1_id, source, cand_id, CASE WHEN cand_id % 31 = 0 THEN 2 ELSE label END AS label FROM pairs),
x AS (SELECT * FROM o UNION ALL SELECT * FROM o WHERE s1_id % 35 = 0 UNION ALL SELECT -1 - s1_id, source, cand_id, label FROM o WHERE s1_id % 45 = 0)
SELECT (SELECT count(*) FROM x WHERE s1_id NOT IN (SELECT s1_id FROM universe)) AS unknown_s1_pairs, (SELECT count(*) FROM x WHERE label NOT IN (0, 1)) AS odd_labels,
  (SELECT count(*) FROM (SELECT s1_id, count(*) FILTER (label = 1) AS n FROM x GROUP BY s1_id) JOIN universe USING (s1_id) WHERE n > n_true) AS too_many_positives,
  (SELECT count(*) FROM (SELECT 1 FROM x GROUP BY s1_id, source, cand_id HAVING count(*) > 1)) AS repeated_pairs"""


def univariate_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = decisions.pairs(spark, sf_dir)
    out = stats.univariate_scan(d, ("score", "rank"), "label", 0.6)
    return out.select("feature", F.round("auc", 6).alias("auc"), F.round("ap", 6).alias("ap"), "n", F.col("suspect").cast("bigint").alias("suspect"))


def scan_sql(x: str) -> str:
    return f"""SELECT '{x}' AS feature, round(greatest(a, 1 - a), 6) AS auc, round(ap, 6) AS ap, n, (greatest(a, 1 - a) >= 0.6)::BIGINT AS suspect FROM
  (SELECT (sum(CASE WHEN y = 1 THEN r END) - np * (np + 1) / 2) / (np * (n - np)) AS a, n FROM (SELECT label AS y, rank() OVER (ORDER BY {x}) + (count(*) OVER (PARTITION BY {x}) - 1) / 2.0::DOUBLE AS r, count(*) OVER () AS n, (sum(label) OVER ())::BIGINT AS np FROM pairs) GROUP BY n, np),
  (SELECT sum(step * pr)::DOUBLE AS ap FROM (SELECT pos / (sum(pos) OVER ()) AS step, sum(pos) OVER w / sum(c) OVER w AS pr FROM (SELECT {x} AS x, count(*) AS c, sum(label) AS pos FROM pairs GROUP BY 1) WINDOW w AS (ORDER BY x DESC)))"""


def category_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.category_means(decisions.pairs(spark, sf_dir), "source", "label").select("value", "n", F.round("mean", 6).alias("mean"))


def redundant_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "orders").select(F.col("o_totalprice").alias("price"), (F.col("o_totalprice") * 2 + F.col("o_orderkey") % 3).alias("twice"), (-F.col("o_totalprice")).alias("minus"), (F.col("o_orderkey") % 101).alias("other"))
    return stats.redundant_pairs(d, ("price", "twice", "minus", "other")).select("a", "b", F.round("rho", 4).alias("rho"))


REDUNDANT = """WITH d AS (SELECT o_totalprice AS price, o_totalprice * 2 + o_orderkey % 3 AS twice, -o_totalprice AS minus, o_orderkey % 101 AS other FROM orders),
r AS (SELECT rank() OVER (ORDER BY price) + (count(*) OVER (PARTITION BY price) - 1) / 2.0::DOUBLE AS p, rank() OVER (ORDER BY twice) + (count(*) OVER (PARTITION BY twice) - 1) / 2.0::DOUBLE AS t, rank() OVER (ORDER BY minus) + (count(*) OVER (PARTITION BY minus) - 1) / 2.0::DOUBLE AS m FROM d)
SELECT 'price' AS a, 'twice' AS b, round(corr(p, t), 4) AS rho FROM r UNION ALL SELECT 'price', 'minus', round(corr(p, m), 4) FROM r UNION ALL SELECT 'twice', 'minus', round(corr(t, m), 4) FROM r"""


def error_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The worst errors with the label of the record that each names."""
    worst = models.error_examples(decisions.pairs(spark, sf_dir), "p", 0.45, 10)
    raw = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.concat(F.lit("cluster "), F.col("label").cast("string")).alias("described"))
    return models.with_texts(worst, raw, "cand_id", ("described",)).select(*IDS, "error", "described")


ERROR_TEXTS = f"""WITH {decisions.PAIRS}, fp AS (SELECT s1_id, source, cand_id, 'false positive' AS error FROM pairs WHERE label = 0 AND p >= 0.45 ORDER BY p DESC, s1_id, cand_id LIMIT 10),
fn AS (SELECT s1_id, source, cand_id, 'false negative' AS error FROM pairs WHERE label = 1 AND p < 0.45 ORDER BY p, s1_id, cand_id LIMIT 10), e AS (SELECT * FROM fp UNION ALL SELECT * FROM fn)
SELECT s1_id, source, cand_id, error, 'cluster ' || label AS described FROM e JOIN embeddings ON vec_id = cand_id"""


def key_bakeoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall of two keys, and of both together, of every part by its own name written otherwise, by a kind of part."""
    p = table(spark, sf_dir, "part")
    join = lambda *cs: F.concat_ws(" ", *(F.col(c).cast("string") for c in cs)).alias("k")
    asks = lambda *cs: p.select(F.col("p_partkey").alias("s1_id"), join(*cs))
    holds = lambda *cs: p.select(F.col("p_partkey").alias("cand_id"), join(*cs))
    name = cut(features.ngram_topk(asks("p_name", "p_brand"), holds("p_name", "p_type"), "k", 3))
    kind = cut(features.ngram_topk(asks("p_brand", "p_size"), holds("p_brand", "p_size", "p_type"), "k", 3))
    want = p.select(F.col("p_partkey").alias("s1_id"), F.col("p_partkey").alias("cand_id"), F.when(F.col("p_partkey") % 3 == 0, "third").otherwise("other").alias("kind"))
    out = None
    for key, found in (("name", name), ("kind", kind), ("both", features.merged_keys(name, kind, 3))):
        row = features.key_recall(found, want, "kind").select(F.lit(key).alias("key"), "kind", F.round("recall", 6).alias("recall"), "n")
        out = row if out is None else out.unionByName(row)
    return out


def topk_sql(name: str, asks: str, holds: str, k: int) -> str:
    """Tables that end in ``name`` (s1_id, cand_id, score, rank): TF-IDF of character n-grams, each step a table."""
    cut = ", ".join(f"CASE WHEN length(w) >= {n} THEN list_transform(generate_series(1, length(w) - {n - 1}), lambda i: substr(w, i, {n})) ELSE [w] END" for n in (2, 3, 4))
    grams = lambda src: f"SELECT id, g, count(*) AS tf FROM (SELECT id, unnest(list_distinct(flatten([{cut}]))) AS g FROM (SELECT id, ' ' || unnest(list_filter(regexp_split_to_array(lower(txt), '[^\\p{{L}}\\p{{N}}_]+'), lambda t: t <> '')) || ' ' AS w FROM ({src}))) GROUP BY ALL"
    weigh = lambda t: f"SELECT id, g, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY id)) AS w FROM {t} JOIN {name}_i USING (g)"
    return f"""{name}_q AS MATERIALIZED ({grams(asks)}), {name}_p AS MATERIALIZED ({grams(holds)}),
{name}_i AS MATERIALIZED (SELECT g, ln((1.0::DOUBLE + (SELECT count(*) FROM ({holds}))) / (1 + count(*))) + 1 AS idf FROM {name}_p GROUP BY g),
{name}_a AS MATERIALIZED ({weigh(f"{name}_q")}), {name}_b AS MATERIALIZED ({weigh(f"{name}_p")}),
{name}_s AS MATERIALIZED (SELECT a.id AS s1_id, b.id AS cand_id, round(sum(a.w * b.w), 9) AS score FROM {name}_a a JOIN {name}_b b USING (g) GROUP BY ALL),
{name} AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY s1_id ORDER BY score DESC, cand_id) AS rank FROM {name}_s) WHERE rank <= {k})"""


def bakeoff_sql() -> str:
    sides = {"name": ("p_name || ' ' || p_brand", "p_name || ' ' || p_type"), "kind": ("p_brand || ' ' || p_size", "p_brand || ' ' || p_size || ' ' || p_type")}
    steps = ", ".join(topk_sql(f"k_{n}", f"SELECT p_partkey AS id, {a} AS txt FROM part", f"SELECT p_partkey AS id, {b} AS txt FROM part", 3) for n, (a, b) in sides.items())
    found = "SELECT 'name' AS key, s1_id, cand_id FROM k_name UNION ALL SELECT 'kind', s1_id, cand_id FROM k_kind UNION SELECT 'both', s1_id, cand_id FROM k_name UNION SELECT 'both', s1_id, cand_id FROM k_kind"
    return f"""WITH {steps}, found AS (SELECT DISTINCT * FROM ({found})), w AS (SELECT k.key, p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN 'third' ELSE 'other' END AS kind FROM part CROSS JOIN (SELECT unnest(['name', 'kind', 'both']) AS key) k),
h AS (SELECT w.key, w.kind, (f.s1_id IS NOT NULL)::INT AS hit FROM w LEFT JOIN found f ON f.key = w.key AND f.s1_id = w.id AND f.cand_id = w.id)
SELECT key, kind, round(avg(hit), 6) AS recall, count(*) AS n FROM h GROUP BY GROUPING SETS ((key, kind), (key))"""


NGRAMS = f"""WITH {keys.NAMES_SQL}, {topk_sql("best", "SELECT id, name || ' ' || country AS txt FROM names", "SELECT min(id) AS id, name AS txt FROM names GROUP BY name", 5)}
SELECT s1_id, cand_id, round(score, 6) AS score, rank FROM best"""
LEVELS = [0.8 * i / 40 for i in range(41)] + [0.8 + 0.1995 * i / 199 for i in range(200)]


def threshold_sql() -> str:
    """The coarse grid of quantiles and the fine one round its best, every threshold against every query."""
    curve = lambda grid: f"SELECT t, round(avg({decisions.F05}), 9) AS f FROM (SELECT t, u.s1_id, u.n_true, count(*) FILTER (p >= t)::DOUBLE AS n_pred, count(*) FILTER (p >= t AND label = 1)::DOUBLE AS tp FROM {grid} CROSS JOIN universe u LEFT JOIN pairs USING (s1_id) GROUP BY ALL) GROUP BY t"
    return f"""WITH {decisions.PAIRS}, g AS MATERIALIZED (SELECT DISTINCT t FROM (SELECT unnest(quantile_cont(p, {LEVELS})) AS t FROM pairs UNION ALL SELECT max(p) + 1e-9 * greatest(1, abs(max(p))) FROM pairs)),
c AS MATERIALIZED ({curve("g")}), o AS MATERIALIZED (SELECT *, lag(t) OVER (ORDER BY t) AS low, lead(t) OVER (ORDER BY t) AS high FROM c), b AS MATERIALIZED (SELECT * FROM o ORDER BY f DESC, t LIMIT 1),
g2 AS MATERIALIZED (SELECT DISTINCT coalesce(low, t) + (coalesce(high, t) - coalesce(low, t)) * k / 59 AS t FROM b CROSS JOIN range(60) r(k)), c2 AS MATERIALIZED ({curve("g2")}), b2 AS MATERIALIZED (SELECT * FROM c2 ORDER BY f DESC, t LIMIT 1)
SELECT round(CASE WHEN b2.f > b.f THEN b2.t ELSE b.t END, 6) AS threshold, round(greatest(b.f, b2.f), 6) AS s1_macro_f05 FROM b, b2"""


def crossfit_sql() -> str:
    """Each half scored with the policy that is best on the other: a threshold, or one of nine with a lower bar for the top of a list."""
    fold = lambda s: f"floor((('0x' || substr(md5({s}::VARCHAR), 1, 8))::BIGINT % 1000000) / 1000000::DOUBLE * 2)"
    options = ", ".join(f"({3 * i + j}, {a}::DOUBLE, {b}::DOUBLE)" for i, a in enumerate((0.0, 0.05, 0.1)) for j, b in enumerate((0.1, 0.2, 0.3)))
    count = lambda rule: f"count(*) FILTER ({rule})::DOUBLE AS n_pred, count(*) FILTER (({rule}) AND label = 1)::DOUBLE AS tp"
    steps, out = [], []
    for g in (0, 1):
        n = lambda name, g=g: f"{name}{g}"
        curve = lambda grid, n=n: f"SELECT t, round(avg({decisions.F05}), 9) AS f FROM (SELECT t, u.s1_id, u.n_true, {count('p >= t')} FROM {grid} CROSS JOIN {n('u')} u LEFT JOIN {n('p')} USING (s1_id) GROUP BY ALL) GROUP BY t"
        steps.append(f"""{n("p")} AS MATERIALIZED (SELECT s1_id, p, label, top FROM topped WHERE fold <> {g}), {n("u")} AS MATERIALIZED (SELECT s1_id, n_true FROM universe WHERE {fold("s1_id")} <> {g}),
{n("g")} AS MATERIALIZED (SELECT DISTINCT t FROM (SELECT unnest(quantile_cont(p, {LEVELS})) AS t FROM {n("p")} UNION ALL SELECT max(p) + 1e-9 * greatest(1, abs(max(p))) FROM {n("p")})), {n("c")} AS MATERIALIZED ({curve(n("g"))}),
{n("o")} AS MATERIALIZED (SELECT *, lag(t) OVER (ORDER BY t) AS low, lead(t) OVER (ORDER BY t) AS high FROM {n("c")}), {n("b")} AS MATERIALIZED (SELECT * FROM {n("o")} ORDER BY f DESC, t LIMIT 1),
{n("h")} AS MATERIALIZED (SELECT DISTINCT coalesce(low, t) + (coalesce(high, t) - coalesce(low, t)) * k / 59 AS t FROM {n("b")} CROSS JOIN range(60) r(k)), {n("d")} AS MATERIALIZED (SELECT * FROM ({curve(n("h"))}) ORDER BY f DESC, t LIMIT 1),
{n("t")} AS MATERIALIZED (SELECT CASE WHEN d.f > b.f THEN d.t ELSE b.t END AS t, greatest(b.f, d.f) AS f FROM {n("b")} b, {n("d")} d),
{n("v")} AS MATERIALIZED (SELECT i, t + a AS t1, t - z AS t2 FROM {n("t")} CROSS JOIN (VALUES {options}) x(i, a, z) WHERE t - z > 0.05),
{n("w")} AS MATERIALIZED (SELECT i, t1, t2, round(avg({decisions.F05}), 9) AS f FROM (SELECT i, t1, t2, u.s1_id, u.n_true, {count("p >= t1 OR (top AND p >= t2)")} FROM {n("v")} CROSS JOIN {n("u")} u LEFT JOIN {n("p")} USING (s1_id) GROUP BY ALL) GROUP BY i, t1, t2),
{n("k")} AS MATERIALIZED (SELECT t1, t2 FROM (SELECT -1 AS i, t AS t1, NULL::DOUBLE AS t2, f FROM {n("t")} UNION ALL SELECT * FROM {n("w")}) ORDER BY f DESC, i LIMIT 1)""")
        out.append(f"SELECT u.s1_id, u.n_true, {count('p >= t1 OR (t2 IS NOT NULL AND top AND p >= t2)')} FROM universe u CROSS JOIN {n('k')} LEFT JOIN topped USING (s1_id) WHERE {fold('u.s1_id')} = {g} GROUP BY ALL")
    return f"""WITH {decisions.PAIRS}, topped AS MATERIALIZED (SELECT s1_id, p, label, p = max(p) OVER (PARTITION BY s1_id) AS top, {fold("s1_id")} AS fold FROM pairs), {", ".join(steps)}, s AS ({" UNION ALL ".join(out)})
SELECT s1_id, n_true, n_pred::BIGINT AS n_pred, tp::BIGINT AS tp, round({decisions.F05}, 6) AS f05 FROM s"""


def bootstrap_sql() -> str:
    """Weights of 200 rounds by the same hash, summed round by round."""
    tails, tail, term = [], 0.0, 1.0 / 2.718281828459045
    for k in range(8):
        tail += term
        tails.append(f"(u > {tail!r}::DOUBLE)::INT")
        term /= k + 1
    side = lambda rule, n: decisions.per_query_sql(rule).replace("counts AS", f"c{n} AS").replace("f AS (", f"f{n} AS (", 1).replace("LEFT JOIN counts c", f"LEFT JOIN c{n} c")
    return f"""WITH {decisions.PAIRS}, {side("score >= 0.45", 1)}, {side("p >= 0.45", 2)}, d AS MATERIALIZED (SELECT s1_id, f2.f - f1.f AS d FROM f1 JOIN f2 USING (s1_id)),
r AS (SELECT d, k, (('0x' || substr(md5(s1_id || '|' || k || '|0'), 1, 8))::BIGINT % 1073741824 + 0.5::DOUBLE) / 1073741824 AS u FROM d CROSS JOIN range(1, 201) x(k)),
m AS (SELECT k, sum(({" + ".join(tails)}) * d) / sum({" + ".join(tails)}) AS mean FROM r GROUP BY k), q AS (SELECT quantile_cont(mean, 0.025) AS low, quantile_cont(mean, 0.975) AS high, avg((mean <= 0)::INT) AS p_not_better FROM m)
SELECT round((SELECT avg(d) FROM d), 6) AS delta, round(low, 6) AS low, round(high, 6) AS high, round(p_not_better, 6) AS p_not_better, CASE WHEN low > 0 THEN 'BETTER' WHEN high < 0 THEN 'WORSE' ELSE 'WITHIN NOISE' END AS verdict FROM q"""


QUERIES = {
    f.__name__: f
    for f in (
        dense_texts, hashed_embeddings, routed_models, script_groups, native_words, romanised_letters, text_marks, canonical_names, name_keys, pair_states, record_histograms, pair_texts, token_lengths,
        claimants_of_all_roles, feature_variants, group_percentiles, logit_coverage, named_slices, pair_slices, label_sanity, univariate_scan, category_means, redundant_features, error_texts, key_bakeoff,
    )
}
ORACLE = {
    "dense_texts": f"WITH {keys.NAMES_SQL} SELECT id, 'query: ' || name || ' | ' || CASE WHEN id % 6 <> 0 THEN addr ELSE '' END AS text FROM names",
    "hashed_embeddings": EMBEDDED,
    "routed_models": f"WITH {keys.NAMES_SQL} SELECT id, CASE country WHEN 'INDIA' THEN 'india-model' ELSE 'us-model' END AS route FROM names",
    "script_groups": SCRIPT_GROUPS,
    "native_words": NATIVE,
    "romanised_letters": "SELECT p_partkey, 'brand ' || substr(p_brand, 7) AS roman FROM part",
    "text_marks": MARKS,
    "canonical_names": CANONICAL,
    "name_keys": NAME_KEYS,
    "pair_states": STATES,
    "record_histograms": HISTOGRAMS,
    "pair_texts": PAIR_TEXTS,
    "token_lengths": LENGTHS,
    "claimants_of_all_roles": ALL_ROLES,
    "feature_variants": variants_sql(),
    "group_percentiles": PERCENTILES,
    "logit_coverage": COVERAGE,
    "named_slices": SLICES,
    "pair_slices": PAIR_SLICES,
    "label_sanity": SANITY,
    "univariate_scan": f"WITH {decisions.PAIRS} {scan_sql('score')} UNION ALL {scan_sql('rank')}",
    "category_means": f"WITH {decisions.PAIRS} SELECT source AS value, count(*) AS n, round(avg(label), 6) AS mean FROM pairs GROUP BY source",
    "redundant_features": REDUNDANT,
    "error_texts": ERROR_TEXTS,
    "key_bakeoff": bakeoff_sql(),
    # Of queries in other modules, whose SQL takes the steps above.
    "char_ngram_topk": NGRAMS,
    "best_threshold": threshold_sql(),
    "paired_bootstrap": bootstrap_sql(),
    "crossfit_policy": crossfit_sql(),
}
