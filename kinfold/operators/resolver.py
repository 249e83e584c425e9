"""Entity resolver: agreement of keys, vetoes, one owner for each record, rescue by twins, and reports."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass, replace
from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinfold.operators.evaluate import f05
from kinfold.operators.joins import hot_keys, hot_left_join
from kinfold.session import written

#: What became of a pair.
REASONS = {0: "kept", 1: "veto_crowd", 2: "veto_template", 3: "owner_lost", 4: "owner_dropped_all", 5: "rescued", 9: "not_accepted"}


@dataclass(frozen=True)
class Knobs:
    """Settings; the values here and in PRESETS are fixed."""

    crowd_on: bool = True
    c1: int = 3
    tmpl_on: bool = True
    c2: int = 3
    tmpl_need_addr: bool = False
    owner_mode: str = "resolve"  # or drop_all, off
    owner_min_claims: int = 2
    m1: float = 0.15
    e_gap: int = 2
    p_floor: float = 0.5
    rescue_on: bool = False
    p_hi: float = 0.9
    p_lo: float = 0.3

    def __post_init__(self) -> None:
        if self.owner_min_claims < 2:
            raise ValueError("the one-owner rule compares two claimants: owner_min_claims is at least 2")


NO_VETO = {"crowd_on": False, "tmpl_on": False}
PRESETS = {
    "default": Knobs(),
    "strict": Knobs(c1=2, c2=2, tmpl_need_addr=True, m1=0.3, e_gap=3, p_floor=0.7),
    "loose": Knobs(c1=5, tmpl_on=False, m1=0.05, e_gap=1, p_floor=0.4),
    "drop3": Knobs(**NO_VETO, owner_mode="drop_all", owner_min_claims=3),
    "dropall2": Knobs(**NO_VETO, owner_mode="drop_all", owner_min_claims=2),
    "off": Knobs(**NO_VETO, owner_mode="off"),
}


def knobs(preset: str = "default", **over: object) -> Knobs:
    return replace(PRESETS[preset], **over)


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays of distinct tokens; null if one is empty."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def name_agree(a: str, b: str) -> Column:
    """2 same key, 1 compatible (half the tokens, or the same first token of three letters), 0 one missing, -1 different."""
    key_a, key_b, first = F.col(f"{a}.name_key"), F.col(f"{b}.name_key"), F.col(f"{a}.name_first")
    alike = (jaccard(F.col(f"{a}.name_toks"), F.col(f"{b}.name_toks")) >= 0.5) | ((first == F.col(f"{b}.name_first")) & (F.length(first) >= 3))
    return F.when((key_a == "") | (key_b == ""), 0).when(key_a == key_b, 2).when(F.coalesce(alike, F.lit(False)), 1).otherwise(-1)


def postal_conflict(a: Column, b: Column) -> Column:
    """Both there and more than one substitution apart, or of different lengths."""
    differ = F.aggregate(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: (x != y).cast("int")), F.lit(0), lambda s, x: s + x)
    return (a != "") & (b != "") & (a != b) & F.when(F.length(a) == F.length(b), differ > 1).otherwise(True)


def addr_agree(a: str, b: str) -> Column:
    """2 same street and house, 1 same street and no other house, 0 unknown, -1 conflict. Street evidence goes before postal codes."""
    s1, s2, h1, h2 = F.col(f"{a}.street"), F.col(f"{b}.street"), F.col(f"{a}.house"), F.col(f"{b}.house")
    j = jaccard(s1, s2)
    nothing = ((F.size(s1) == 0) & (h1 == "")) | ((F.size(s2) == 0) & (h2 == ""))
    return (
        F.when(nothing, 0)
        .when((j >= 0.5) & (h1 != "") & (h1 == h2), 2)
        .when((j >= 0.5) & (h1 != "") & (h2 != ""), 0)
        .when(j >= 0.5, 1)
        .when(postal_conflict(F.col(f"{a}.postal"), F.col(f"{b}.postal")), -1)
        .when((j == 0) & F.col(f"{a}.street_strong") & F.col(f"{b}.street_strong"), -1)
        .otherwise(0)
    )


def attach_agreement(pairs: DataFrame, s1_keys: DataFrame, pool_keys: DataFrame) -> DataFrame:
    """pairs (s1_id, source, cand_id) with name_agree and addr_agree; 0 where a side has no keys."""
    pack = lambda df, name: F.struct(*(c for c in df.columns if c not in ("id", "source"))).alias(name)
    a = s1_keys.select(F.col("id").alias("s1_id"), pack(s1_keys, "a"))
    b = pool_keys.select("source", F.col("id").alias("cand_id"), pack(pool_keys, "b"))
    joined = pairs.join(a, "s1_id", "left").join(b, ["source", "cand_id"], "left")
    both = F.col("a").isNotNull() & F.col("b").isNotNull()
    return joined.withColumn("name_agree", F.when(both, name_agree("a", "b")).otherwise(0)).withColumn("addr_agree", F.when(both, addr_agree("a", "b")).otherwise(0)).drop("a", "b")


def s1_context(keys: DataFrame) -> DataFrame:
    """id, bldg_n_names, name_n_places over all queries: names in its building, places of its name (1 if unknown).

    Queries without a building or a name aren't joined on the empty key; a
    building or a name of very many queries keeps them where they lie.
    """
    total = keys.count()
    mine = keys.select("id", F.nullif("building", F.lit("")).alias("building"), F.nullif("name_key", F.lit("")).alias("name_key"))
    crowd = written(keys.where("building <> ''").groupBy("building").agg(F.count_distinct("name_key").alias("bldg_n_names"), F.count(F.lit(1)).alias("n")), "crowd")
    place = F.when(F.col("building") != "", F.col("building")).otherwise(F.col("postal"))
    places = written(keys.where("name_key <> ''").groupBy("name_key").agg(F.count_distinct(place).alias("name_n_places"), F.count(F.lit(1)).alias("n")), "places")
    housed = hot_left_join(mine, crowd.drop("n"), "building", hot_keys(crowd, "building", "n", total))
    named = hot_left_join(housed, places.drop("n"), "name_key", hot_keys(places, "name_key", "n", total))
    return named.select("id", F.coalesce("bldg_n_names", F.lit(1)).alias("bldg_n_names"), F.coalesce("name_n_places", F.lit(1)).alias("name_n_places"))


def vetoes(pairs: DataFrame, k: Knobs) -> DataFrame:
    """Add acc_new and reason: crowded buildings need an agreeing name, common names an address without conflict."""
    acc = F.col("acc")
    crowd = acc & (F.col("bldg_n_names") >= k.c1) & (F.col("name_agree") < 1) if k.crowd_on else F.lit(False)
    tmpl = acc & (F.col("name_n_places") >= k.c2) & (F.col("addr_agree") < (1 if k.tmpl_need_addr else 0)) if k.tmpl_on else F.lit(False)
    return pairs.withColumn("reason", F.when(~acc, 9).when(crowd, 1).when(tmpl, 2).otherwise(0)).withColumn("acc_new", F.col("reason") == 0)


def one_owner(pairs: DataFrame, k: Knobs) -> DataFrame:
    """Of the accepted claimants of a record (source, cand_id) at most one stays.

    The likeliest wins with a lead of m1 and no less evidence than any other;
    else the one with the most evidence wins with a lead of e_gap and p_floor;
    else nobody. Only accepted rows are sorted, and the rest passes by.
    """
    if k.owner_mode == "off":
        return pairs
    record = Window.partitionBy("source", "cand_id")
    claims = pairs.where("acc_new").withColumn("__n", F.count(F.lit(1)).over(record))
    contested = F.col("__n") >= k.owner_min_claims
    if k.owner_mode == "drop_all":
        settled = claims.withColumn("reason", F.when(contested, 4).otherwise(F.col("reason")))
    else:
        by_p, by_e = record.orderBy(F.desc("p"), "s1_id"), record.orderBy(F.desc("__e"), F.desc("p"), "s1_id")
        ranked = claims.withColumn("__e", F.col("name_agree") + F.col("addr_agree")).withColumn("__rp", F.row_number().over(by_p)).withColumn("__re", F.row_number().over(by_e))
        of = lambda rank, at, x: F.max(F.when(F.col(rank) == at, F.col(x))).over(record)
        lead = (of("__rp", 1, "p") - of("__rp", 2, "p") >= k.m1) & (of("__rp", 1, "__e") >= F.max(F.when(F.col("__rp") > 1, F.col("__e"))).over(record))
        proof = (of("__re", 1, "__e") - of("__re", 2, "__e") >= k.e_gap) & (of("__re", 1, "p") >= k.p_floor)
        ranked = ranked.withColumn("__lead", lead).withColumn("__proof", proof)
        wins = F.when(F.col("__lead"), F.col("__rp") == 1).when(F.col("__proof"), F.col("__re") == 1).otherwise(False)
        anyone = F.col("__lead") | F.col("__proof")
        settled = ranked.withColumn("reason", F.when(~contested | wins, F.col("reason")).when(anyone, 3).otherwise(4))
    settled = settled.withColumn("acc_new", F.col("reason") == 0).select(pairs.columns)
    return settled.unionByName(pairs.where("NOT acc_new"))


def rescue(pairs: DataFrame, k: Knobs, twins: DataFrame) -> DataFrame:
    """Unowned twins (a, b: records 'source|id') of strongly won records, if likely and free of conflict; one query for each."""
    key = F.concat_ws("|", "source", "cand_id")
    marked = pairs.withColumn("__key", key)
    edges = twins.select("a", "b").unionByName(twins.select(F.col("b").alias("a"), F.col("a").alias("b")))
    won = marked.where(F.col("acc_new") & (F.col("p") >= k.p_hi)).select("s1_id", F.col("__key").alias("a"))
    want = won.join(edges, "a").select("s1_id", F.col("b").alias("__key")).distinct()
    owned = marked.where("acc_new").select("__key").distinct()
    open_ = marked.where(~F.col("acc_new") & (F.col("p") >= k.p_lo) & (F.col("name_agree") >= 0) & (F.col("addr_agree") >= 0))
    hits = open_.join(want, ["s1_id", "__key"], "left_semi").join(owned, "__key", "left_anti")
    first = hits.groupBy("__key").agg(F.min("s1_id").alias("__to"))
    joined = marked.join(first, "__key", "left")
    took = F.col("__to").isNotNull() & (F.col("s1_id") == F.col("__to"))
    return joined.withColumn("acc_new", F.col("acc_new") | took).withColumn("reason", F.when(took, 5).otherwise(F.col("reason"))).select(pairs.columns)


def resolve(pairs: DataFrame, k: Knobs, twins: DataFrame | None = None) -> DataFrame:
    """pairs (s1_id, source, cand_id, p, acc, name_agree, addr_agree, bldg_n_names, name_n_places) with acc_new and reason."""
    out = one_owner(vetoes(pairs, k), k)
    return rescue(out, k, twins) if k.rescue_on and twins is not None else out


def reason_counts(resolved: DataFrame, by: str) -> DataFrame:
    """One row for each value of ``by``, one column for each reason; 0 where it never occurs."""
    counts = (F.count_if(F.col("reason") == code).alias(name) for code, name in REASONS.items())
    return resolved.groupBy(by).agg(*counts)


def profile(universe: DataFrame, resolved: DataFrame, by: str) -> DataFrame:
    """For each value of ``by``: empty share, accepted pairs a query, share of records claimed twice and three times, crowded share."""
    taken = resolved.where("acc_new")
    mine = universe.join(taken.groupBy("s1_id").agg(F.count(F.lit(1)).alias("n"), F.max((F.col("bldg_n_names") >= 3).cast("int")).alias("crowded")), "s1_id", "left").na.fill(0, ["n", "crowded"])
    heads = mine.groupBy(by).agg(F.avg((F.col("n") == 0).cast("double")).alias("empty_share"), F.avg("n").alias("accepts_per_s1"), F.avg("crowded").alias("crowded_share"))
    claims = taken.join(universe.select("s1_id", by), "s1_id").groupBy(by, "source", "cand_id").agg(F.count(F.lit(1)).alias("c")).groupBy(by).agg(F.avg((F.col("c") >= 2).cast("double")).alias("collision_rate"), F.count_if(F.col("c") >= 3).alias("claimed_3_plus"))
    return heads.join(claims, by, "left").na.fill(0)


def diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """s1_id, n_a, n_b, n_both for the queries whose accepted sets (s1_id, source, cand_id) differ."""
    both = a.select("s1_id", "source", "cand_id", F.lit(1).alias("x")).join(b.select("s1_id", "source", "cand_id", F.lit(1).alias("y")), ["s1_id", "source", "cand_id"], "full")
    counts = both.groupBy("s1_id").agg(F.count("x").alias("n_a"), F.count("y").alias("n_b"), F.count_if(F.col("x").isNotNull() & F.col("y").isNotNull()).alias("n_both"))
    return counts.where("n_a <> n_both OR n_b <> n_both")


def splice(base: DataFrame, other: DataFrame, universe: DataFrame, countries: list[str]) -> DataFrame:
    """Accepted pairs of ``other`` for the queries of some countries, of ``base`` for the rest."""
    some = universe.where(F.col("country").isin(countries)).select("s1_id")
    return base.join(some, "s1_id", "left_anti").unionByName(other.join(some, "s1_id", "left_semi"))


def validate(accepted: DataFrame, universe: DataFrame, candidates: DataFrame) -> DataFrame:
    """One row of counts that should be 0 (claims may not be): duplicate pairs, unknown queries, pairs that were no candidates, records claimed twice and three times."""
    pair = ["s1_id", "source", "cand_id"]
    checks = [
        accepted.groupBy(*pair).count().where("count > 1").agg(F.count(F.lit(1)).alias("duplicate_pairs")),
        accepted.join(universe.select("s1_id"), "s1_id", "left_anti").agg(F.count(F.lit(1)).alias("unknown_s1")),
        accepted.join(candidates.select(pair), pair, "left_anti").agg(F.count(F.lit(1)).alias("not_candidates")),
        accepted.groupBy("source", "cand_id").agg(F.count(F.lit(1)).alias("c")).agg(F.count_if(F.col("c") >= 2).alias("claimed_2_plus"), F.count_if(F.col("c") >= 3).alias("claimed_3_plus")),
    ]
    out = checks[0]
    for c in checks[1:]:
        out = out.join(F.broadcast(c))  # single rows
    return out


# --- preparation and tuning


def active_rows(pairs: DataFrame, p_lo: float = 0.2) -> DataFrame:
    """Rows that resolution can change or count: accepted ones and candidates for a rescue. Tuning on them is exact."""
    return pairs.where(F.col("acc") | (F.col("p") >= p_lo))


def prepare(pairs: DataFrame, s1_keys: DataFrame, pool_keys: DataFrame, p_lo: float = 0.2) -> DataFrame:
    """pairs with agreement and the context of their query: all that ``resolve`` needs.

    Only active rows are compared, so only records that they name are joined;
    the context counts all queries, whatever their pairs. A query without keys has
    context 1 and 1.
    """
    active = F.col("acc") | (F.col("p") >= p_lo)
    named = pairs.where(active).select("source", F.col("cand_id").alias("id")).distinct()
    compared = attach_agreement(pairs.where(active), s1_keys, pool_keys.join(named, ["source", "id"], "left_semi"))
    rest = pairs.where(~active).withColumns({"name_agree": F.lit(0), "addr_agree": F.lit(0)})
    context = s1_context(s1_keys).withColumnRenamed("id", "s1_id")
    out = compared.unionByName(rest).join(context, "s1_id", "left")
    return out.na.fill(1, ["bldg_n_names", "name_n_places"])


#: The space searched by default.
SPACE = {"owner_mode": ("resolve", "drop_all"), "owner_min_claims": (2, 3), "m1": (0.05, 0.15, 0.3), "crowd_on": (True, False), "c1": (3, 5), "tmpl_on": (True, False), "c2": (3, 5)}


def behaviour(k: Knobs) -> tuple:
    """The settings that make a difference; knobs with one behaviour resolve alike."""
    owner = {"off": (), "drop_all": (k.owner_min_claims,), "resolve": (k.owner_min_claims, k.m1, k.e_gap, k.p_floor)}[k.owner_mode]
    crowd = (k.c1,) if k.crowd_on else ()
    template = (k.c2, k.tmpl_need_addr) if k.tmpl_on else ()
    return k.owner_mode, owner, crowd, template, (k.p_hi, k.p_lo) if k.rescue_on else ()


def knob_grid(space: dict[str, Sequence] | None = None, preset: str = "default") -> list[Knobs]:
    """All combinations of a space, the first of each behaviour."""
    space = SPACE if space is None else space
    found: dict[tuple, Knobs] = {}
    for values in product(*space.values()):
        k = knobs(preset, **dict(zip(space, values, strict=True)))
        found.setdefault(behaviour(k), k)
    return list(found.values())


def grid_scores(universe: DataFrame, pairs: DataFrame, grid: Iterable[Knobs], fold: Column, twins: DataFrame | None = None) -> DataFrame:
    """config (place in the grid), fold, n, f: sum of F0.5 of the fold's queries, resolved with each configuration.

    Resolution runs over all pairs, as records couple queries; only the scores
    are split by fold. Queries without accepted pairs are counted from the
    universe, so a configuration's rows are one for each query that accepts.
    """
    base = universe.select("s1_id", "n_true", fold.alias("fold"))
    none = base.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("n_true") == 0).cast("double")).alias("f0"))
    rows = written(active_rows(pairs), "active")
    parts = None
    for i, k in enumerate(grid):
        counts = resolve(rows, k, twins).where("acc_new").groupBy("s1_id").agg(F.count(F.lit(1)).alias("n_pred"), F.count_if(F.col("label") == 1).alias("tp"))
        part = counts.withColumn("config", F.lit(i))
        parts = part if parts is None else parts.unionByName(part)
    scored = parts.join(base, "s1_id").withColumn("change", f05(F.col("tp"), F.col("n_pred"), F.col("n_true")) - (F.col("n_true") == 0).cast("double"))
    sums = scored.groupBy("config", "fold").agg(F.sum("change").alias("change"))
    every = none.withColumn("config", F.explode(F.sequence(F.lit(0), F.lit(i))))
    return every.join(sums, ["config", "fold"], "left").select("config", "fold", "n", (F.col("f0") + F.coalesce("change", F.lit(0.0))).alias("f"))


def crossfit_picks(scores: DataFrame) -> DataFrame:
    """fold, config, f: for every fold the configuration that is best on the others (the first of equals, to nine digits), and its mean F there."""
    folds = scores.select("fold").distinct().withColumnRenamed("fold", "__out")
    others = scores.join(F.broadcast(folds), F.col("fold") != F.col("__out")).groupBy("__out", "config").agg(F.round(F.sum("f") / F.sum("n"), 9).alias("__f"))
    picks = others.groupBy("__out").agg(F.max_by("config", F.struct("__f", -F.col("config"))).alias("__pick"))
    own = scores.select("fold", "config", (F.col("f") / F.col("n")).alias("f"))
    return own.join(F.broadcast(picks), (F.col("fold") == F.col("__out")) & (F.col("config") == F.col("__pick"))).select("fold", "config", "f")


def toward(before: DataFrame, after: DataFrame, by: str, target: str, references: Sequence[str], slack: float = 0.05) -> DataFrame:
    """One row: whether a group's profile has moved toward that of the references, and its distance to theirs; no row where either is missing.

    Collisions and accepted pairs a query may not be further from the mean of the
    references than before, and the empty share not above theirs by more than
    ``slack``.
    """
    measures = ("empty_share", "accepts_per_s1", "collision_rate")
    pick = lambda df, name: df.where(F.col(by) == target).select(*(F.col(m).alias(f"{name}_{m}") for m in measures))
    ref = before.where(F.col(by).isin(list(references))).agg(*(F.avg(m).alias(f"ref_{m}") for m in measures)).where(F.col("ref_empty_share").isNotNull())
    one = pick(before, "old").join(F.broadcast(pick(after, "new"))).join(F.broadcast(ref))  # single rows
    gap = lambda side, m: F.abs(F.col(f"{side}_{m}") - F.col(f"ref_{m}"))
    nearer = lambda m: gap("new", m) <= gap("old", m) + 1e-12
    empty = F.col("new_empty_share") <= F.col("ref_empty_share") + slack
    distance = sum((gap("new", m) / F.greatest(F.abs(F.col(f"ref_{m}")), F.lit(1e-3)) for m in measures), F.lit(0.0))
    return one.select(nearer("collision_rate").alias("collision_toward"), nearer("accepts_per_s1").alias("accepts_toward"), empty.alias("empty_ok"), distance.alias("distance")).withColumn("passed", F.col("collision_toward") & F.col("accepts_toward") & F.col("empty_ok"))


def rank_presets(pairs: DataFrame, universe: DataFrame, by: str, target: str, references: Sequence[str], candidates: dict[str, Knobs]) -> DataFrame:
    """preset, passed, distance, place: candidates by gate, then by distance of the target's profile to the references'."""
    rows = written(active_rows(pairs), "active")
    before = profile(universe, resolve(rows, knobs("off")), by)
    out = None
    for name, k in candidates.items():
        row = toward(before, profile(universe, resolve(rows, k), by), by, target, references).withColumn("preset", F.lit(name))
        out = row if out is None else out.unionByName(row)
    order = Window.orderBy(F.desc("passed"), "distance", "preset")  # one row for each preset
    return out.select("preset", "passed", "distance", F.row_number().over(order).alias("place"))


# --- pairs and long lists


def pairs_to_long(resolved: DataFrame) -> DataFrame:
    """s1_id, entity_id of the accepted pairs."""
    return resolved.where("acc_new").select("s1_id", F.col("cand_id").alias("entity_id"))


def accept_from_long(pairs: DataFrame, long: DataFrame) -> DataFrame:
    """pairs with acc: whether the list holds them. Pairs of the list that are no candidates are passed over."""
    held = long.select("s1_id", F.col("entity_id").alias("cand_id")).distinct().withColumn("acc", F.lit(True))
    return pairs.drop("acc").join(held, ["s1_id", "cand_id"], "left").withColumn("acc", F.coalesce("acc", F.lit(False)))


def attach_probabilities(pairs: DataFrame, probabilities: DataFrame) -> DataFrame:
    """pairs with p; 0, never accepted, where there is none."""
    return pairs.drop("p").join(probabilities.select("s1_id", "source", "cand_id", "p"), ["s1_id", "source", "cand_id"], "left").na.fill(0.0, ["p"])
