"""Resolver queries. Claims: orders ask, parts are the records, discounts and taxes make probabilities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.operators import resolver
from kinfold.session import table, written

P = "round(max(l_discount) * 5 + max(l_tax) * 4 + (l_orderkey % 10) * 0.015, 6)"
CLAIMS_SQL = f"""claims AS (SELECT l_orderkey AS s1_id, CASE WHEN l_partkey % 3 = 0 THEN 'S2' ELSE 'S3' END AS source, l_partkey AS cand_id, ({P})::DOUBLE AS p,
  (min(l_linenumber) + l_orderkey) % 4 - 1 AS name_agree, (max(l_linenumber) + l_partkey) % 4 - 1 AS addr_agree, l_orderkey % 5 AS bldg_n_names, l_partkey % 5 AS name_n_places
  FROM lineitem GROUP BY l_orderkey, l_partkey),
pairs AS (SELECT *, p >= 0.4 AS acc FROM claims)"""


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_partkey").agg(F.max("l_discount").alias("d"), F.max("l_tax").alias("t"), F.min("l_linenumber").alias("lo"), F.max("l_linenumber").alias("hi"))
    return lines.select(
        F.col("l_orderkey").alias("s1_id"), F.when(F.col("l_partkey") % 3 == 0, "S2").otherwise("S3").alias("source"), F.col("l_partkey").alias("cand_id"),
        F.round(F.col("d") * 5 + F.col("t") * 4 + (F.col("l_orderkey") % 10) * F.lit(0.015), 6).alias("p"),
        ((F.col("lo") + F.col("l_orderkey")) % 4 - 1).alias("name_agree"), ((F.col("hi") + F.col("l_partkey")) % 4 - 1).alias("addr_agree"),
        (F.col("l_orderkey") % 5).alias("bldg_n_names"), (F.col("l_partkey") % 5).alias("name_n_places"),
    ).withColumn("acc", F.col("p") >= 0.4)


def shown(df: DataFrame) -> DataFrame:
    return df.select("s1_id", "source", "cand_id", F.col("reason").cast("bigint").alias("reason"), F.col("acc_new").cast("bigint").alias("acc_new"))


def vetoed_sql(k: resolver.Knobs) -> str:
    crowd = f"WHEN bldg_n_names >= {k.c1} AND name_agree < 1 THEN 1" if k.crowd_on else ""
    tmpl = f"WHEN name_n_places >= {k.c2} AND addr_agree < {int(k.tmpl_need_addr)} THEN 2" if k.tmpl_on else ""
    return f"vetoed AS (SELECT *, CASE WHEN NOT acc THEN 9 {crowd} {tmpl} ELSE 0 END AS r0 FROM pairs)"


def resolved_sql(k: resolver.Knobs) -> str:
    owner = {
        "drop_all": f"CASE WHEN r0 = 0 AND n >= {k.owner_min_claims} THEN 4 ELSE r0 END",
        "off": "r0",
        "resolve": f"CASE WHEN r0 <> 0 OR n < {k.owner_min_claims} THEN r0 WHEN lead_ok THEN CASE WHEN rp = 1 THEN 0 ELSE 3 END WHEN proof_ok THEN CASE WHEN re = 1 THEN 0 ELSE 3 END ELSE 4 END",
    }[k.owner_mode]
    return f"""{vetoed_sql(k)},
o1 AS (SELECT *, name_agree + addr_agree AS e, count(*) FILTER (r0 = 0) OVER (PARTITION BY source, cand_id) AS n,
  row_number() OVER (PARTITION BY source, cand_id, r0 = 0 ORDER BY p DESC, s1_id) AS rp, row_number() OVER (PARTITION BY source, cand_id, r0 = 0 ORDER BY name_agree + addr_agree DESC, p DESC, s1_id) AS re FROM vetoed),
o2 AS (SELECT *, max(CASE WHEN rp = 1 THEN p END) OVER w - max(CASE WHEN rp = 2 THEN p END) OVER w >= {k.m1} AND max(CASE WHEN rp = 1 THEN e END) OVER w >= max(CASE WHEN rp > 1 THEN e END) OVER w AS lead_ok,
  max(CASE WHEN re = 1 THEN e END) OVER w - max(CASE WHEN re = 2 THEN e END) OVER w >= {k.e_gap} AND max(CASE WHEN re = 1 THEN p END) OVER w >= {k.p_floor} AS proof_ok
  FROM o1 WINDOW w AS (PARTITION BY source, cand_id, r0 = 0)),
resolved AS (SELECT s1_id, source, cand_id, p, name_agree, addr_agree, bldg_n_names, {owner} AS reason FROM o2)"""


SHOWN = "SELECT s1_id, source, cand_id, reason::BIGINT AS reason, (reason IN (0, 5))::BIGINT AS acc_new FROM resolved"


def veto_crowd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(resolver.vetoes(claims(spark, sf_dir), resolver.knobs(tmpl_on=False)))


def veto_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(resolver.vetoes(claims(spark, sf_dir), resolver.knobs("strict", crowd_on=False)))


def one_owner_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(resolver.resolve(claims(spark, sf_dir), resolver.knobs()))


def one_owner_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(resolver.resolve(claims(spark, sf_dir), resolver.knobs("strict")))


def one_owner_drop_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(resolver.resolve(claims(spark, sf_dir), resolver.knobs("dropall2")))


def twins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts are twins of the next part."""
    key = lambda c: F.concat_ws("|", F.when(c % 3 == 0, "S2").otherwise("S3"), c.cast("string"))
    return table(spark, sf_dir, "part").where("p_partkey % 2 = 0").select(key(F.col("p_partkey")).alias("a"), key(F.col("p_partkey") + 1).alias("b"))


def twin_rescue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(resolver.resolve(claims(spark, sf_dir), resolver.knobs("strict", rescue_on=True, p_hi=0.6), twins(spark, sf_dir)))


RESCUE = f"""WITH {CLAIMS_SQL}, {resolved_sql(resolver.knobs("strict"))},
k AS MATERIALIZED (SELECT *, source || '|' || cand_id AS k FROM resolved),
t AS MATERIALIZED (SELECT CASE WHEN p_partkey % 3 = 0 THEN 'S2' ELSE 'S3' END || '|' || p_partkey AS a, CASE WHEN (p_partkey + 1) % 3 = 0 THEN 'S2' ELSE 'S3' END || '|' || (p_partkey + 1) AS b FROM part WHERE p_partkey % 2 = 0),
e AS MATERIALIZED (SELECT a, b FROM t UNION ALL SELECT b, a FROM t),
own AS MATERIALIZED (SELECT DISTINCT k AS own_k FROM k WHERE reason = 0),
want AS MATERIALIZED (SELECT DISTINCT k.s1_id, e.b AS k FROM k JOIN e ON k.k = e.a WHERE k.reason = 0 AND k.p >= 0.6),
open AS MATERIALIZED (SELECT k.* FROM k LEFT JOIN own ON k.k = own.own_k WHERE own.own_k IS NULL AND k.reason <> 0 AND k.p >= 0.3 AND k.name_agree >= 0 AND k.addr_agree >= 0),
hit AS MATERIALIZED (SELECT open.k, min(open.s1_id) AS s1_id FROM open JOIN want ON open.s1_id = want.s1_id AND open.k = want.k GROUP BY open.k)
SELECT k.s1_id, k.source, k.cand_id, (CASE WHEN hit.k IS NOT NULL THEN 5 ELSE k.reason END)::BIGINT AS reason, (hit.k IS NOT NULL OR k.reason = 0)::BIGINT AS acc_new
FROM k LEFT JOIN hit ON k.k = hit.k AND k.s1_id = hit.s1_id"""


def with_group(df: DataFrame) -> DataFrame:
    return df.withColumn("country", F.pmod("s1_id", F.lit(3)))


def reason_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolver.reason_counts(with_group(resolver.resolve(claims(spark, sf_dir), resolver.knobs())), "country")


REASON_COUNTS = f"""WITH {CLAIMS_SQL}, {resolved_sql(resolver.knobs())} SELECT s1_id % 3 AS country, {", ".join(f"count(*) FILTER (reason = {i}) AS {n}" for i, n in resolver.REASONS.items())} FROM resolved GROUP BY 1"""


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_group(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("s1_id")))


def profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resolver.profile(orders(spark, sf_dir), resolver.resolve(claims(spark, sf_dir), resolver.knobs("off")), "country")
    return out.select("country", "claimed_3_plus", *(F.round(c, 6).alias(c) for c in ("empty_share", "accepts_per_s1", "crowded_share", "collision_rate")))


PROFILE = f"""WITH {CLAIMS_SQL}, a AS (SELECT * FROM pairs WHERE acc), u AS (SELECT o_orderkey AS s1_id, o_orderkey % 3 AS country FROM orders),
m AS (SELECT u.s1_id, country, count(a.s1_id) AS n, coalesce(max((bldg_n_names >= 3)::INT), 0) AS crowded FROM u LEFT JOIN a ON u.s1_id = a.s1_id GROUP BY ALL),
c AS (SELECT country, source, cand_id, count(*) AS c FROM a JOIN u USING (s1_id) GROUP BY ALL),
d AS (SELECT country, round(avg((c >= 2)::INT), 6) AS collision_rate, count(*) FILTER (c >= 3) AS claimed_3_plus FROM c GROUP BY country)
SELECT m.country, d.claimed_3_plus, round(avg((n = 0)::INT), 6) AS empty_share, round(avg(n), 6) AS accepts_per_s1, round(avg(crowded), 6) AS crowded_share, d.collision_rate FROM m JOIN d ON m.country = d.country GROUP BY ALL"""


def output_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = claims(spark, sf_dir)
    return resolver.diff(resolver.resolve(c, resolver.knobs("off")).where("acc_new"), resolver.resolve(c, resolver.knobs()).where("acc_new"))


DIFF = f"""WITH {CLAIMS_SQL}, {resolved_sql(resolver.knobs())}, j AS (SELECT p.s1_id, p.acc, r.reason = 0 AS b FROM pairs p JOIN resolved r USING (s1_id, source, cand_id))
SELECT s1_id, count(*) FILTER (acc) AS n_a, count(*) FILTER (b) AS n_b, count(*) FILTER (acc AND b) AS n_both FROM j GROUP BY s1_id HAVING n_a <> n_both OR n_b <> n_both"""


def validate_submission(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = claims(spark, sf_dir)
    accepted = resolver.resolve(c, resolver.knobs("off")).where("acc_new").select("s1_id", "source", "cand_id")
    spoiled = accepted.unionByName(accepted.where("s1_id % 100 = 1")).unionByName(accepted.where("s1_id % 100 = 2").withColumn("s1_id", -F.col("s1_id")))
    return resolver.validate(spoiled, orders(spark, sf_dir), c)


VALIDATE = f"""WITH {CLAIMS_SQL}, a AS (SELECT s1_id, source, cand_id FROM pairs WHERE acc), x AS (SELECT * FROM a UNION ALL SELECT * FROM a WHERE s1_id % 100 = 1 UNION ALL SELECT -s1_id, source, cand_id FROM a WHERE s1_id % 100 = 2)
SELECT (SELECT count(*) FROM (SELECT 1 FROM x GROUP BY s1_id, source, cand_id HAVING count(*) > 1)) AS duplicate_pairs, (SELECT count(*) FROM x WHERE s1_id NOT IN (SELECT o_orderkey FROM orders)) AS unknown_s1,
  (SELECT count(*) FROM x WHERE (s1_id, cand_id) NOT IN (SELECT (s1_id, cand_id) FROM pairs)) AS not_candidates,
  (SELECT count(*) FILTER (c >= 2) FROM (SELECT count(*) AS c FROM x GROUP BY source, cand_id)) AS claimed_2_plus, (SELECT count(*) FILTER (c >= 3) FROM (SELECT count(*) AS c FROM x GROUP BY source, cand_id)) AS claimed_3_plus"""

def active_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolver.active_rows(claims(spark, sf_dir)).select("s1_id", "source", "cand_id", "p")


def long_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accepted pairs to a long list and back; probabilities come from the claims of even records alone."""
    c = claims(spark, sf_dir)
    long = resolver.pairs_to_long(resolver.resolve(c, resolver.knobs("dropall2")))
    back = resolver.accept_from_long(c.drop("acc"), long)
    out = resolver.attach_probabilities(back, c.where("cand_id % 2 = 0"))
    return out.select("s1_id", "source", "cand_id", "p", F.col("acc").cast("bigint").alias("acc"))


LONG = f"""WITH {CLAIMS_SQL}, {resolved_sql(resolver.knobs("dropall2"))}
SELECT s1_id, source, cand_id, CASE WHEN cand_id % 2 = 0 THEN p ELSE 0 END AS p, (reason = 0)::BIGINT AS acc FROM resolved"""


def splice_countries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strict answers for the queries of one group, unresolved ones for the rest."""
    c = claims(spark, sf_dir)
    taken = lambda preset: resolver.resolve(c, resolver.knobs(preset)).where("acc_new").select("s1_id", "source", "cand_id")
    universe = orders(spark, sf_dir).withColumn("country", F.col("country").cast("string"))
    return resolver.splice(taken("off"), taken("strict"), universe, ["1"])


SPLICE = f"""WITH {CLAIMS_SQL}, {resolved_sql(resolver.knobs("strict"))}
SELECT s1_id, source, cand_id FROM pairs WHERE acc AND s1_id % 3 <> 1 UNION ALL SELECT s1_id, source, cand_id FROM resolved WHERE reason = 0 AND s1_id % 3 = 1"""


def preset_query(preset: str) -> object:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return shown(resolver.resolve(claims(spark, sf_dir), resolver.knobs(preset)))

    return query


#: A small space, so that the SQL resolves each of its behaviours.
GRID = resolver.knob_grid({"owner_mode": ("resolve", "drop_all"), "owner_min_claims": (2, 3), "m1": (0.05, 0.3), "tmpl_on": (True, False)})
LABEL = "(s1_id + cand_id) % 3 = 0"


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return claims(spark, sf_dir).withColumn("label", F.expr(LABEL).cast("int"))


def true_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    have = labelled(spark, sf_dir).groupBy("s1_id").agg(F.sum("label").alias("n_true"))
    return orders(spark, sf_dir).join(have, "s1_id", "left").na.fill(0, ["n_true"])


def scored_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolver.grid_scores(true_counts(spark, sf_dir), labelled(spark, sf_dir), GRID, F.pmod("s1_id", F.lit(2)))


def knob_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored_grid(spark, sf_dir).select(F.col("config").cast("bigint").alias("config"), "fold", "n", F.round("f", 4).alias("f"))


def knob_crossfit(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resolver.crossfit_picks(written(scored_grid(spark, sf_dir), "grid"))
    return out.select("fold", F.col("config").cast("bigint").alias("config"), F.round("f", 6).alias("f"))


def grid_sql() -> str:
    """The configurations one by one, with every step a table of its own."""
    parts = []
    for i, k in enumerate(GRID):
        resolved = f"WITH {resolved_sql(k)} SELECT s1_id, count(*)::DOUBLE AS n_pred, count(*) FILTER ({LABEL})::DOUBLE AS tp FROM resolved WHERE reason = 0 GROUP BY s1_id"
        parts.append(f"SELECT {i} AS config, u.*, coalesce(n_pred, 0) AS n_pred, coalesce(tp, 0) AS tp FROM u LEFT JOIN ({resolved}) USING (s1_id)")
    f = "CASE WHEN n_true = 0 THEN (n_pred = 0)::DOUBLE WHEN tp > 0 THEN 1.25 * (tp / n_pred) * (tp / n_true) / (0.25 * (tp / n_pred) + tp / n_true) ELSE 0 END"
    return f"""WITH {CLAIMS_SQL.replace("claims AS (", "claims AS MATERIALIZED (")}, nt AS (SELECT s1_id, count(*) FILTER ({LABEL}) AS n_true FROM claims GROUP BY s1_id),
u AS MATERIALIZED (SELECT o_orderkey AS s1_id, o_orderkey % 2 AS fold, coalesce(n_true, 0)::DOUBLE AS n_true FROM orders LEFT JOIN nt ON o_orderkey = s1_id),
g AS ({" UNION ALL ".join(parts)}), s AS MATERIALIZED (SELECT config::BIGINT AS config, fold, count(*) AS n, sum({f}) AS f FROM g GROUP BY ALL)"""


CROSSFIT = f"""{grid_sql()}, o AS (SELECT d.fold AS fold, s.config, round(sum(s.f) / sum(s.n), 9) AS f FROM s JOIN (SELECT DISTINCT fold FROM s) d ON s.fold <> d.fold GROUP BY ALL),
p AS (SELECT fold, config FROM (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY f DESC, config) AS r FROM o) WHERE r = 1)
SELECT fold, config, round(s.f / s.n, 6) AS f FROM s JOIN p USING (fold, config)"""
TRIED = ("default", "loose", "strict", "dropall2")


def preset_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Presets by how near they bring one group's profile to that of the others."""
    universe = orders(spark, sf_dir).withColumn("country", F.col("country").cast("string"))
    out = resolver.rank_presets(claims(spark, sf_dir), universe, "country", "2", ("0", "1"), {p: resolver.knobs(p) for p in TRIED})
    return out.select("preset", F.col("passed").cast("bigint").alias("passed"), F.round("distance", 6).alias("distance"), F.col("place").cast("bigint").alias("place"))


def ranking_sql() -> str:
    prof = """SELECT country, avg((n = 0)::INT) AS empty_share, avg(n) AS accepts_per_s1, coalesce(max(collision), 0) AS collision_rate FROM
  (SELECT u.s1_id, u.country, count(a.s1_id) AS n FROM u LEFT JOIN a ON u.s1_id = a.s1_id GROUP BY ALL) LEFT JOIN
  (SELECT country, avg((c >= 2)::INT) AS collision FROM (SELECT country, source, cand_id, count(*) AS c FROM a JOIN u USING (s1_id) GROUP BY ALL) GROUP BY country) USING (country) GROUP BY country"""
    parts = [f"SELECT 'off' AS preset, * FROM (WITH a AS (SELECT * FROM pairs WHERE acc) {prof})"]
    parts += [f"SELECT '{p}' AS preset, * FROM (WITH {resolved_sql(resolver.knobs(p))}, a AS (SELECT * FROM resolved WHERE reason = 0) {prof})" for p in TRIED]
    gap = lambda side, m: f"abs({side}.{m} - r.{m})"
    distance = " + ".join(f"{gap('n', m)} / greatest(abs(r.{m}), 0.001)" for m in ("empty_share", "accepts_per_s1", "collision_rate"))
    return f"""WITH {CLAIMS_SQL.replace("claims AS (", "claims AS MATERIALIZED (")}, u AS (SELECT o_orderkey AS s1_id, o_orderkey % 3 AS country FROM orders), all_ AS MATERIALIZED ({" UNION ALL ".join(parts)}),
r AS (SELECT avg(empty_share) AS empty_share, avg(accepts_per_s1) AS accepts_per_s1, avg(collision_rate) AS collision_rate FROM all_ WHERE preset = 'off' AND country IN (0, 1)),
d AS (SELECT n.preset, ({gap("n", "collision_rate")} <= {gap("o", "collision_rate")} + 1e-12 AND {gap("n", "accepts_per_s1")} <= {gap("o", "accepts_per_s1")} + 1e-12 AND n.empty_share <= r.empty_share + 0.05)::BIGINT AS passed, {distance} AS distance
  FROM all_ n, all_ o, r WHERE n.preset <> 'off' AND n.country = 2 AND o.preset = 'off' AND o.country = 2)
SELECT preset, passed, round(distance, 6) AS distance, row_number() OVER (ORDER BY passed DESC, distance, preset) AS place FROM d"""


def made_keys(df: DataFrame, key: str) -> DataFrame:
    """Keys of a record by rules of its id; every fourth has no building."""
    k = F.col(key)
    return df.select(
        k.alias("id"), F.when(k % 9 == 0, "").otherwise(F.concat(F.lit("n"), (k % 7).cast("string"))).alias("name_key"), F.array(F.concat(F.lit("n"), (k % 7).cast("string")), F.lit("co")).alias("name_toks"),
        F.lit("x").alias("name_first"), F.lpad((k % 5).cast("string"), 5, "0").alias("postal"), (k % 3).cast("string").alias("house"), F.array(F.lit("street"), F.concat(F.lit("s"), (k % 4).cast("string"))).alias("street"),
        F.lit(True).alias("street_strong"), F.when(k % 4 == 0, "").otherwise(F.concat(F.lit("b"), (k % 50).cast("string"))).alias("building"),
    )


def prepared_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = claims(spark, sf_dir).drop("name_agree", "addr_agree", "bldg_n_names", "name_n_places")
    s1 = made_keys(orders(spark, sf_dir), "s1_id")
    p = table(spark, sf_dir, "part").where("p_partkey % 29 <> 0")
    pool = made_keys(p, "p_partkey").withColumn("source", F.when(F.col("id") % 3 == 0, "S2").otherwise("S3"))
    out = resolver.prepare(c, s1, pool, 0.35)
    return out.select("s1_id", "source", "cand_id", *(F.col(x).cast("bigint").alias(x) for x in ("name_agree", "addr_agree", "bldg_n_names", "name_n_places")))


def made_sql(k: str) -> str:
    return f"CASE WHEN {k} % 9 = 0 THEN '' ELSE 'n' || {k} % 7 END AS name_key, {k} % 7 AS nt, {k} % 5 AS po, {k} % 3 AS ho, {k} % 4 AS st, CASE WHEN {k} % 4 = 0 THEN '' ELSE 'b' || {k} % 50 END AS building"


PREPARED = f"""WITH {CLAIMS_SQL}, s AS (SELECT o_orderkey AS id, {made_sql("o_orderkey")} FROM orders), b AS (SELECT p_partkey AS id, {made_sql("p_partkey")} FROM part WHERE p_partkey % 29 <> 0),
cr AS (SELECT building, count(DISTINCT name_key) AS nn FROM s WHERE building <> '' GROUP BY building), np AS (SELECT name_key, count(DISTINCT CASE WHEN building <> '' THEN building ELSE lpad(po::VARCHAR, 5, '0') END) AS nn FROM s WHERE name_key <> '' GROUP BY name_key),
j AS (SELECT c.*, s.name_key AS ka, b.name_key AS kb, s.nt AS na, b.nt AS nb, s.po AS pa, b.po AS pb, s.ho AS ha, b.ho AS hb, s.st AS ta, b.st AS tb, b.id IS NOT NULL AND s.id IS NOT NULL AND (acc OR p >= 0.35) AS ok, s.building, s.name_key AS sk
  FROM pairs c LEFT JOIN s ON c.s1_id = s.id LEFT JOIN b ON c.cand_id = b.id)
SELECT s1_id, source, cand_id, CASE WHEN NOT ok OR ka = '' OR kb = '' THEN 0 WHEN ka = kb THEN 2 WHEN na = nb THEN 1 ELSE -1 END AS name_agree,
  CASE WHEN NOT ok THEN 0 WHEN ta = tb AND ha = hb THEN 2 ELSE 0 END AS addr_agree, coalesce(cr.nn, 1) AS bldg_n_names, coalesce(np.nn, 1) AS name_n_places
FROM j LEFT JOIN cr ON j.building = cr.building LEFT JOIN np ON j.sk = np.name_key"""

QUERIES = {f.__name__: f for f in (veto_crowd, veto_template, one_owner_resolve, one_owner_strict, one_owner_drop_all, twin_rescue, reason_counts, profile, output_diff, validate_submission, active_pairs, long_round_trip, splice_countries, knob_grid, knob_crossfit, preset_ranking, prepared_pairs)}
QUERIES |= {f"preset_{p}": preset_query(p) for p in ("loose", "drop3")}
ORACLE = {
    "veto_crowd": f"WITH {CLAIMS_SQL}, {vetoed_sql(resolver.knobs(tmpl_on=False))} SELECT s1_id, source, cand_id, r0::BIGINT AS reason, (r0 = 0)::BIGINT AS acc_new FROM vetoed",
    "veto_template": f"WITH {CLAIMS_SQL}, {vetoed_sql(resolver.knobs('strict', crowd_on=False))} SELECT s1_id, source, cand_id, r0::BIGINT AS reason, (r0 = 0)::BIGINT AS acc_new FROM vetoed",
    "one_owner_resolve": f"WITH {CLAIMS_SQL}, {resolved_sql(resolver.knobs())} {SHOWN}",
    "one_owner_strict": f"WITH {CLAIMS_SQL}, {resolved_sql(resolver.knobs('strict'))} {SHOWN}",
    "one_owner_drop_all": f"WITH {CLAIMS_SQL}, {resolved_sql(resolver.knobs('dropall2'))} {SHOWN}",
    "twin_rescue": RESCUE,
    "reason_counts": REASON_COUNTS,
    "profile": PROFILE,
    "output_diff": DIFF,
    "validate_submission": VALIDATE,
    "active_pairs": f"WITH {CLAIMS_SQL} SELECT s1_id, source, cand_id, p FROM pairs WHERE acc OR p >= 0.2",
    "long_round_trip": LONG,
    "splice_countries": SPLICE,
    "knob_grid": f"{grid_sql()} SELECT config, fold, n, round(f, 4) AS f FROM s",
    "knob_crossfit": CROSSFIT,
    "preset_ranking": ranking_sql(),
    "prepared_pairs": PREPARED,
    **{f"preset_{p}": f"WITH {CLAIMS_SQL}, {resolved_sql(resolver.knobs(p))} {SHOWN}" for p in ("loose", "drop3")},
}
