"""Text-key queries: conversations, documents and made-up business names over ``part``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.functions import text, vocab
from kinfold.operators import records
from kinfold.session import cut, table

TAILS = ("", " pvt ltd", " co inc", " sarl", " & llc", " gmbh", " d/b/a other names ltd", ".com")
COUNTRIES = ("US", "INDIA", "FRANCE")
NAMES_SQL = f"""names AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 11 = 0 THEN 'the ' ELSE '' END || p_name || {list(TAILS)}[(p_partkey % 8)::INT + 1] AS name, {list(COUNTRIES)}[(p_size % 3)::INT + 1] AS country,
  (p_partkey % 900 + 1) || CASE WHEN p_partkey % 4 = 0 THEN 'b' ELSE '' END || ' road near ' || p_brand || ' ' || (10000 + p_partkey % 80000) || CASE WHEN p_partkey % 5 = 0 THEN ' 1234' ELSE '' END AS addr FROM part)"""


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, name, country and address with every kind of mark the keys look for."""
    k = F.col("p_partkey")
    pick = lambda values, i: F.element_at(F.array(*map(F.lit, values)), (i + 1).cast("int"))
    return table(spark, sf_dir, "part").select(
        k.alias("id"), F.concat(F.when(k % 11 == 0, "the ").otherwise(""), "p_name", pick(TAILS, k % 8)).alias("name"), pick(COUNTRIES, F.col("p_size") % 3).alias("country"),
        F.concat((k % 900 + 1).cast("string"), F.when(k % 4 == 0, "b").otherwise(""), F.lit(" road near "), "p_brand", F.lit(" "), (10000 + k % 80000).cast("string"), F.when(k % 5 == 0, " 1234").otherwise("")).alias("addr"),
    )


def punct_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").withColumn("norm", text.normalise_address(F.col("text")))
    return c.select("conv_id", "turn", F.md5(F.col("norm").cast("binary")).alias("norm_md5"), text.n_tokens(F.col("norm")).cast("bigint").alias("n_tokens"))


def normal_sql(x: str) -> str:
    lowered = f"replace(lower({x}), 'ß', 'ss')"
    spaced = f"replace(regexp_replace(replace(regexp_replace({lowered}, '[\\p{{Cf}}''’‘`´]', '', 'g'), '&', chr(57344)), '[\\p{{P}}\\p{{S}}\\p{{Cc}}]', ' ', 'g'), chr(57344), ' & ')"
    return f"trim(regexp_replace({spaced}, '\\s+', ' ', 'g'))"


JUNK_LIST = ", ".join(f"'{j}'" for j in vocab.JUNK)
PUNCT = f"""WITH n AS (SELECT conv_id, turn, {normal_sql("text")} AS n FROM conversations), j AS (SELECT conv_id, turn, CASE WHEN n IN ({JUNK_LIST}) OR NOT regexp_matches(n, '[\\p{{L}}\\p{{N}}]') THEN '' ELSE n END AS n FROM n)
SELECT conv_id, turn, md5(n) AS norm_md5, CASE WHEN n = '' THEN 0 ELSE length(n) - length(replace(n, ' ', '')) + 1 END AS n_tokens FROM j"""


def junk_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every eighth name is replaced by a placeholder or by marks."""
    junk = F.element_at(F.array(*map(F.lit, ("N/A", "---", "Unknown", "Null", "x1"))), (F.col("id") % 5 + 1).cast("int"))
    n = names(spark, sf_dir).withColumn("raw", F.when(F.col("id") % 8 == 0, junk).otherwise(F.col("name"))).withColumn("norm", text.normalise_name(F.col("raw")))
    return n.select("id", "norm", (F.col("norm") == "").cast("bigint").alias("missing"))


JUNK = f"""WITH {NAMES_SQL}, r AS (SELECT id, CASE WHEN id % 8 = 0 THEN ['N/A', '---', 'Unknown', 'Null', 'x1'][(id % 5)::INT + 1] ELSE name END AS raw FROM names), n AS (SELECT id, {normal_sql("raw")} AS n FROM r),
j AS (SELECT id, CASE WHEN n IN ({JUNK_LIST}) OR NOT regexp_matches(n, '[\\p{{L}}\\p{{N}}]') THEN '' ELSE n END AS norm FROM n) SELECT id, norm, (norm = '')::BIGINT AS missing FROM j"""


def strip_phone(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", text.has_phone(F.col("text")).cast("bigint").alias("had_phone"), F.md5(text.strip_phone(F.col("text")).cast("binary")).alias("text_md5"))


PHONE = r"""SELECT doc_id, regexp_matches(text, '\d{10,}')::BIGINT AS had_phone,
  md5(CASE WHEN regexp_matches(text, '\d{10,}') THEN trim(regexp_replace(text, '(?:\s*[-–—|:,/]\s*)?\+?\d{10,}', ' ', 'g')) ELSE text END) AS text_md5 FROM documents"""


def domain_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    hosts = table(spark, sf_dir, "pages").select("page_id", F.regexp_replace(F.lower("url"), r"^(https?://[^/]*).*$", "$1").alias("site"))
    return hosts.select("page_id", text.domain_root(F.col("site")).alias("root"))


DOMAIN = rf"""SELECT page_id, trim(regexp_replace(regexp_extract(regexp_replace(lower(url), '^(https?://[^/]*).*$', '\1'), '{text.DOMAIN}', 1), '[.\-_]+', ' ', 'g')) AS root FROM pages"""


def alias_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    name, alias = text.split_alias(F.col("name"))
    return names(spark, sf_dir).select("id", name.alias("name"), alias.alias("alias"))


ALIAS = rf"""WITH {NAMES_SQL}, s AS (SELECT id, name, regexp_matches(name, '{text.ALIAS}') AS hit, trim(regexp_replace(name, '{text.ALIAS}.*$', '')) AS head, trim(regexp_replace(name, '^.*?{text.ALIAS.replace("(?i)", "")}', '', 'i')) AS tail FROM names)
SELECT id, CASE WHEN hit AND head <> '' AND tail <> '' THEN head || ' ' || tail ELSE name END AS name, CASE WHEN hit AND head <> '' AND tail <> '' THEN tail ELSE '' END AS alias FROM s"""


def legal_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    core, suffix = text.legal_suffix(F.col("name"), F.col("country"))
    return names(spark, sf_dir).select("id", core.alias("core"), suffix.alias("suffix"))


def suffix_sql(f: str, arg: str) -> str:
    cases = "".join(f"WHEN country = '{c}' THEN {f}(name, '{text.suffix_pattern((*vocab.LEGAL_SUFFIXES, *more))}', {arg}) " for c, more in vocab.LEGAL_SUFFIXES_BY_COUNTRY.items())
    return f"CASE {cases} ELSE {f}(name, '{text.suffix_pattern(vocab.LEGAL_SUFFIXES)}', {arg}) END"


LEGAL = rf"""WITH {NAMES_SQL} SELECT id, trim(regexp_replace(regexp_replace({suffix_sql("regexp_replace", "''")}, '^(?:&\s*)+|(?:\s*&)+$', '', 'g'), '^the\s+', '')) AS core, trim(regexp_replace({suffix_sql("regexp_extract", "1")}, '\s+', ' ', 'g')) AS suffix FROM names"""


def skeleton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names(spark, sf_dir).select("id", text.skeleton(F.col("name")).alias("skeleton"))


def skeleton_sql(x: str) -> str:
    s = "t"
    for a, b in vocab.DIGRAPHS:
        s = f"replace({s}, '{a}', '{b}')"
    s = f"replace(regexp_replace({s}, 'c([eiy])', 's\\1', 'g'), 'c', 'k')"
    for _ in range(2):  # neighbours overlap
        s = f"regexp_replace({s}, 'm([{vocab.NASAL_BEFORE}])', 'n\\1', 'g')"
    s = f"translate(regexp_replace({s}, '[aeiouyh]', '', 'g'), 'gdb', 'ktp')"
    for letter in "bcdfgjklmnpqrstvwxz":
        s = f"regexp_replace({s}, '{letter}+', '{letter}', 'g')"
    return f"array_to_string(list_filter(list_transform(list_filter(string_split({x}, ' '), lambda t: t <> '&'), lambda t: CASE WHEN regexp_matches(t, '^\\d+$') THEN t ELSE {s} END), lambda t: t <> ''), ' ')"


def leet_fix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names with a letter written as a digit by a rule of ids."""
    marked = F.when(F.col("id") % 3 == 0, F.replace("name", F.lit("o"), F.lit("0"))).when(F.col("id") % 3 == 1, F.regexp_replace("name", "s(?=[a-z])", "5")).otherwise(F.col("name"))
    return names(spark, sf_dir).withColumn("name", marked).select("id", text.fix_leet(F.col("name")).alias("name"))


LEET = rf"""WITH {NAMES_SQL}, m AS (SELECT id, CASE id % 3 WHEN 0 THEN replace(name, 'o', '0') WHEN 1 THEN regexp_replace(name, 's([a-z])', '5\1', 'g') ELSE name END AS name FROM names)
SELECT id, array_to_string(list_transform(string_split(name, ' '), lambda t: CASE WHEN (regexp_matches(t, '^[a-z]+[0135][a-z]+$') AND length(t) > {vocab.LEET_INNER}) OR (regexp_matches(t, '^[0135][a-z]+$') AND length(t) > {vocab.LEET_LEADING}) THEN translate(t, '0135', 'oles') ELSE t END), ' ') AS name FROM m"""


def postal_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = names(spark, sf_dir).withColumn("postal", text.postal_code(F.lower("addr"), F.col("country")))
    return n.select("id", "postal", text.street_number(F.lower("addr"), F.col("postal")).alias("street"), text.has_landmark(F.lower("addr")).cast("bigint").alias("landmark"))


def postal_sql() -> str:
    hit = lambda ps: "coalesce(" + ", ".join(f"nullif(regexp_extract(a, '{p}', 1), '')" for p in ps) + ", '')"
    return "replace(CASE country " + "".join(f"WHEN '{c}' THEN {hit(p)} " for c, p in vocab.POSTAL.items()) + f"ELSE {hit(vocab.POSTAL_DEFAULT)} END, ' ', '')"


POSTAL = rf"""WITH {NAMES_SQL}, p AS (SELECT id, country, lower(addr) AS a FROM names), q AS (SELECT *, {postal_sql()} AS postal FROM p)
SELECT id, postal, CASE WHEN regexp_extract(a, '^(\d{{1,6}}[a-z]?)\b', 1) <> postal THEN regexp_extract(a, '^(\d{{1,6}}[a-z]?)\b', 1) ELSE '' END AS street, regexp_matches(a, '\b(?:{text.alternation(vocab.LANDMARKS)})\b')::BIGINT AS landmark FROM q"""


def script_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.groupBy(text.name_script(F.col("text")).alias("script"), text.is_mixed_script(F.col("text")).cast("bigint").alias("mixed")).agg(F.count(F.lit(1)).alias("n"))


SCRIPT = r"SELECT CASE WHEN text = '' THEN 'empty' WHEN regexp_matches(text, '[A-Za-z\x{00C0}-\x{024F}]') THEN 'latin' WHEN regexp_matches(text, '\p{N}') THEN 'numeric' ELSE 'other' END AS script, 0::BIGINT AS mixed, count(*) AS n FROM documents GROUP BY 1"


def raw_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names(spark, sf_dir).select(F.concat(F.lit("S1-"), F.col("id").cast("string")).alias("entity_id"), F.col("name").alias("business_name"), F.col("addr").alias("business_address"), "country")


def record_prepare(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.assert_latin(records.prepare(raw_records(spark, sf_dir)))


def record_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = raw_records(spark, sf_dir)
    return records.checks(records.prepare(raw), raw, "S1-").select("check", F.col("passed").cast("bigint").alias("passed"), "detail")


CHECKS = "SELECT unnest(['rows kept', 'ids unique', 'id prefix', 'no nulls', 'latin keys']) AS \"check\", 1::BIGINT AS passed, unnest([(SELECT count(*) FROM part)::VARCHAR, '0', '0', '0', '0']) AS detail"


def shard_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.profile(records.prepare(raw_records(spark, sf_dir)), "country_norm").select("country_norm", "n", "n_is_domain_name", "n_name_missing", "n_has_landmark", "n_postal")


PROFILE = rf"""WITH {NAMES_SQL}, p AS (SELECT *, lower(addr) AS a FROM names), q AS (SELECT *, {postal_sql()} AS postal FROM p)
SELECT country AS country_norm, count(*) AS n, count(*) FILTER (id % 8 = 7 AND regexp_matches(lower(name), '{text.DOMAIN}')) AS n_is_domain_name, 0::BIGINT AS n_name_missing, count(*) AS n_has_landmark, count(*) FILTER (postal <> '') AS n_postal FROM q GROUP BY country"""


def resolver_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = records.resolver_keys(cut(records.prepare(raw_records(spark, sf_dir))))
    return found.withColumns({"name_toks": F.array_join(F.array_sort("name_toks"), " "), "street": F.array_join("street", " ")})


#: What the marks of a made-up name become in its normal form, by its place in TAILS.
NORMAL_TAILS = ("", " pvt ltd", " co inc", " sarl", " & llc", " gmbh", " other names ltd", " com")
#: The legal form at its end, and what is left of the mark before it.
FORMS, LEFT = ("", "pvt ltd", "co inc", "sarl", "llc", "gmbh", "ltd", ""), ("", "", "", "", "", "", " other names", " com")


def prepared_sql() -> str:
    """Prepared records said from how the names and addresses are made."""
    at = lambda values: f"{list(values)}[t]"
    plain = "CASE WHEN w[1] = w[2] THEN w[1] ELSE p END"  # adjacent repeats become one
    return f"""WITH {NAMES_SQL}, m AS (SELECT names.*, p_name AS p, string_split(p_name, ' ') AS w, (id % 8)::INT + 1 AS t, CASE WHEN id % 11 = 0 THEN 'the ' ELSE '' END AS the FROM names JOIN part ON p_partkey = id),
n AS (SELECT *, replace(lower(addr), '#', ' ') AS addr_norm, the || p || {at(NORMAL_TAILS)} AS name_norm, the || {plain} || {at(NORMAL_TAILS)} AS name_latin,
  CASE WHEN t = 4 AND country <> 'FRANCE' THEN '' ELSE {at(FORMS)} END AS legal_suffix, {plain} || CASE WHEN t = 4 AND country <> 'FRANCE' THEN ' sarl' ELSE {at(LEFT)} END AS name_core FROM m),
l AS (SELECT *, replace(replace(regexp_replace(addr_norm, 'brand ', 'brand '), ' road ', ' rd '), ' near ', ' nr ') AS a FROM n),
q AS (SELECT *, {postal_sql()} AS postal, regexp_extract(a, '^(\\d{{1,6}}[a-z]?)\\b', 1) AS num, len(string_split(name_latin, ' ')) AS nn, len(string_split(a, ' ')) AS na FROM l)
SELECT 'S1-' || id AS entity_id, country AS country_raw, country AS country_norm, name AS name_raw, addr AS addr_raw, FALSE AS name_has_embedded_phone, FALSE AS addr_has_embedded_phone, addr_norm, name_norm, FALSE AS is_domain_name, name_latin, a AS addr_latin,
  name_core, legal_suffix, CASE WHEN t = 7 THEN 'other names' ELSE '' END AS name_aka, {skeleton_sql("name_core")} AS name_skeleton, 'latin' AS name_script, 'latin' AS addr_script, FALSE AS name_is_mixed_script, FALSE AS name_was_romanized, FALSE AS addr_was_romanized,
  postal AS postal_code, TRUE AS has_landmark, FALSE AS name_missing, FALSE AS addr_missing, nn::SMALLINT AS name_n_tokens, na::SMALLINT AS addr_n_tokens, CASE WHEN num <> postal THEN num ELSE '' END AS street_number, FALSE AS addr_is_multi_location FROM q"""


def resolver_sql() -> str:
    """Keys of the same records: an English address has 'road' for a street, a French one has none."""
    drop = ", ".join(f"'{w}'" for w in sorted(vocab.LEGAL_FORMS | vocab.STOP_WORDS))
    return f"""WITH r AS ({prepared_sql()}), t AS (SELECT *, list_filter(string_split(regexp_replace(name_latin, '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: x <> '' AND x NOT IN ({drop})) AS k, regexp_extract(addr_latin, '^(\\d{{1,4}}[a-z]?) ', 1) AS h,
  regexp_extract(addr_latin, ' (\\d{{5}})( |$)', 1) AS five, country_norm = 'FRANCE' AS fr FROM r),
x AS (SELECT entity_id AS id, array_to_string(k, ' ') AS name_key, list_distinct(k) AS toks, k[1] AS name_first, CASE WHEN country_norm = 'INDIA' THEN postal_code ELSE five END AS postal, h AS house, CASE WHEN fr THEN 'brand nr rd' ELSE 'brand road' END AS street, NOT fr AS strong, country_norm AS country FROM t)
SELECT id, name_key, array_to_string(list_sort(toks), ' ') AS name_toks, name_first, postal, house, street, strong AS street_strong, country, country || '|' || postal || '|' || house || '|' || street AS building FROM x"""


QUERIES = {f.__name__: f for f in (punct_normalise, junk_mask, strip_phone, domain_detect, alias_split, legal_suffix, skeleton, leet_fix, postal_extract, script_profile, record_prepare, record_checks, shard_profile, resolver_keys)}
ORACLE = {
    "punct_normalise": PUNCT,
    "junk_mask": JUNK,
    "strip_phone": PHONE,
    "domain_detect": DOMAIN,
    "alias_split": ALIAS,
    "legal_suffix": LEGAL,
    "skeleton": f"WITH {NAMES_SQL} SELECT id, {skeleton_sql('name')} AS skeleton FROM names",
    "leet_fix": LEET,
    "postal_extract": POSTAL,
    "script_profile": SCRIPT,
    "record_checks": CHECKS,
    "shard_profile": PROFILE,
    "record_prepare": prepared_sql(),
    "resolver_keys": resolver_sql(),
}
