"""List and claimant context: how a pair's score stands among its rivals.

Two groups matter: a query's candidate list (``s1_id``) and a record's claimants
(``source``, ``cand_id``). One generic transform serves both; it skips null
scores, and its outputs are null for rows without a score.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinfold.operators import stats
from kinfold.operators.joins import HOT_SHARE
from kinfold.session import written

LIST = ("s1_id",)
CLAIM = ("source", "cand_id")


#: Rows of a group that one task sorts without trouble.
GROUP_ROWS = 100_000


def hot_groups(df: DataFrame, keys: Sequence[str], least: int = GROUP_ROWS) -> DataFrame | None:
    """The groups with over 1/HOT_SHARE of the rows, and over ``least``: fewer than HOT_SHARE, so safe to broadcast. None if there are none."""
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    total = df.count()
    found = sizes.where((F.col("__n") * HOT_SHARE > F.lit(total)) & (F.col("__n") > least)).select(*keys)
    return written(found, "hot-groups") if total > least and found.limit(1).count() else None


def group_context(df: DataFrame, keys: Sequence[str], x: str, ties: Sequence[str], prefix: str, hot: DataFrame | None = None) -> DataFrame:
    """Add for each row of its group: rank, gap_top, gap_next, other_best, share, entropy, z, n_valid and n_pos of ``x``.

    The sums run over one sort of the group; ties are broken by ``ties``. Groups
    named by ``hot`` (see ``hot_groups``) are too large for one task: their sums
    are combined before the exchange, and their rows are placed by prefix sums.
    """
    if hot is None:
        return sorted_context(df, keys, x, ties, prefix)
    few = F.broadcast(hot)
    calm = sorted_context(df.join(few, list(keys), "left_anti"), keys, x, ties, prefix)
    return calm.unionByName(summed_context(df.join(few, list(keys), "left_semi"), keys, x, ties, prefix))


def summed_context(df: DataFrame, keys: Sequence[str], x: str, ties: Sequence[str], prefix: str) -> DataFrame:
    """As ``sorted_context``, for few groups of very many rows: no task sorts a whole group."""
    value = F.col(x)
    df = written(df, "hot-group")
    mean = df.groupBy(*keys).agg(F.max(x).alias("__top"), F.count(x).alias(f"{prefix}_n_valid"), F.count_if(value > 0).alias(f"{prefix}_n_pos"), F.avg(x).alias("__avg"), F.stddev_pop(x).alias("__std"))
    joined = df.join(F.broadcast(mean), list(keys))  # fewer than HOT_SHARE rows
    weight = F.exp(value - F.col("__top"))
    below = F.max(F.when(value < F.col("__top"), value))
    more = joined.groupBy(*keys).agg(F.sum(weight).alias("__sum"), F.sum(weight * (value - F.col("__top"))).alias("__moment"), F.count_if(value == F.col("__top")).alias("__tops"), below.alias("__below"))
    joined = joined.join(F.broadcast(more), list(keys))

    there = joined.where(value.isNotNull()).withColumns({"__minus": -value, "__one": F.lit(1)})
    there = written(there.withColumn("__place", stats.range_buckets(there, "__minus")), "hot-placed")
    order = [value.desc(), *map(F.col, ties)]
    ranked = stats.prefix_sums(there, order, F.col("__place"), {"one": "__one"}, tuple(keys))
    tops = there.groupBy(*keys, "__place").agg(F.max(x).alias("__best"))
    after = tops.withColumn("__follow", F.lead("__best").over(Window.partitionBy(*keys).orderBy("__place"))).drop("__best")
    inside = F.lead(x).over(Window.partitionBy(*keys, "__place").orderBy(*order))
    ranked = ranked.withColumn("__next", inside).join(F.broadcast(after), [*keys, "__place"]).withColumn("__next", F.coalesce("__next", "__follow")).drop("__place", "__follow")
    ranked = ranked.withColumn(f"{prefix}_rank", (F.col("before_one") + 1).cast("bigint")).drop("before_one", "__minus", "__one")
    none = joined.where(value.isNull()).withColumns({"__next": F.lit(None).cast("double"), f"{prefix}_rank": F.lit(None).cast("bigint")})

    both = ranked.unionByName(none)
    own = lambda c: F.when(value.isNotNull(), c)
    second = F.when(F.col("__tops") > 1, F.col("__top")).otherwise(F.col("__below"))
    out = {
        f"{prefix}_gap_top": own(F.col("__top") - value),
        f"{prefix}_gap_next": own(value - F.col("__next")),
        f"{prefix}_other_best": own(F.when(F.col(f"{prefix}_rank") == 1, second).otherwise(F.col("__top"))),
        f"{prefix}_share": weight / F.col("__sum"),
        f"{prefix}_entropy": own(F.ln("__sum") - F.col("__moment") / F.col("__sum")),
        f"{prefix}_z": own(F.when(F.col("__std") > 1e-6, (value - F.col("__avg")) / F.col("__std")).otherwise(0.0)),
    }
    return both.withColumns(out).drop("__top", "__avg", "__std", "__sum", "__moment", "__tops", "__below", "__next")


def sorted_context(df: DataFrame, keys: Sequence[str], x: str, ties: Sequence[str], prefix: str) -> DataFrame:
    """The context by windows over each group."""
    group = Window.partitionBy(*keys)
    order = group.orderBy(F.col(x).desc_nulls_last(), *ties)
    there = F.col(x).isNotNull()
    own = lambda c: F.when(there, c)
    weight = f"__{prefix}_w"
    share = f"{prefix}_share"
    df = (
        df.withColumn(f"{prefix}_rank", own(F.row_number().over(order)).cast("bigint"))
        .withColumn(f"{prefix}_top", F.max(x).over(group))
        .withColumn(f"{prefix}_gap_top", own(F.col(f"{prefix}_top") - F.col(x)))
        .withColumn(f"{prefix}_next", F.lead(x).over(order))
        .withColumn(f"{prefix}_gap_next", own(F.col(x) - F.col(f"{prefix}_next")))
        .withColumn(f"{prefix}_second", F.max(F.when(F.col(f"{prefix}_rank") == 2, F.col(x))).over(group))
        .withColumn(f"{prefix}_other_best", own(F.when(F.col(f"{prefix}_rank") == 1, F.col(f"{prefix}_second")).otherwise(F.col(f"{prefix}_top"))))
        .withColumn(weight, F.exp(F.col(x) - F.col(f"{prefix}_top")))
        .withColumn(share, F.col(weight) / F.sum(weight).over(group))
        .withColumn(f"{prefix}_entropy", own(F.sum(-F.col(share) * F.ln(share)).over(group)))
        .withColumn(f"{prefix}_n_valid", F.count(x).over(group))
        .withColumn(f"{prefix}_n_pos", F.count_if(F.col(x) > 0).over(group))
    )
    std = F.stddev_pop(x).over(group)
    return df.withColumn(f"{prefix}_z", own(F.when(std > 1e-6, (F.col(x) - F.avg(x).over(group)) / std).otherwise(0.0))).drop(f"{prefix}_top", f"{prefix}_next", f"{prefix}_second", weight)


def ensemble(df: DataFrame, first: str, second: str) -> DataFrame:
    """ens_logit (mean of what is there) and, where both are, ce_min, ce_absdiff and ce_sign_agree."""
    a, b = F.col(first), F.col(second)
    both = a.isNotNull() & b.isNotNull()
    return (
        df.withColumn("ens_logit", F.coalesce((a + b) / 2, a, b))
        .withColumn("ce_min", F.when(both, F.least(a, b)))
        .withColumn("ce_absdiff", F.abs(a - b))
        .withColumn("ce_sign_agree", F.when(both, ((a > 0) == (b > 0)).cast("bigint")))
    )


def list_scores(df: DataFrame) -> DataFrame:
    """Retrieval score in its list: gaps and ratio to the top and the neighbours, list size, first place."""
    group, order = Window.partitionBy("s1_id"), Window.partitionBy("s1_id").orderBy("rank", "cand_id")
    top = F.max("score").over(group)
    return (
        df.withColumn("score_gap_top1", F.col("score") - top)
        .withColumn("score_ratio_top1", F.when(top > 0, F.col("score") / top))
        .withColumn("score_gap_next", F.col("score") - F.lead("score").over(order))
        .withColumn("score_gap_prev", F.lag("score").over(order) - F.col("score"))
        .withColumn("n_cands", F.count(F.lit(1)).over(group))
        .withColumn("is_rank1", (F.col("rank") == 1).cast("bigint"))
    )


def list_similarity(df: DataFrame, name: str, addr: str) -> DataFrame:
    """Name and address similarities in the list: rank, strong rivals and gaps to the best."""
    group = Window.partitionBy("s1_id")
    sim = F.coalesce(F.col(name), F.lit(-1.0))
    return (
        df.withColumn("name_sim_rank_in_list", F.row_number().over(group.orderBy(sim.desc(), "rank")).cast("bigint"))
        .withColumn("name_sim_n_ge90", F.count_if(F.col(name) >= 0.9).over(group))
        .withColumn("name_sim_gap_best", F.max(sim).over(group) - sim)
        .withColumn("addr_sim_gap_best", F.when(F.col(addr).isNotNull(), F.max(addr).over(group) - F.col(addr)))
        .withColumn("name_addr_n_strong", F.count_if((F.col(name) >= 0.9) & (F.col(addr) >= 0.7)).over(group))
    )


def claimant_scores(df: DataFrame) -> DataFrame:
    """Retrieval score among all queries that list the record: fan-in, whether (nearly) the best, margin.

    Best and second are grouped first and joined back, so that a record listed
    by very many queries is combined before the exchange and never sorted whole.
    """
    best = df.groupBy(*CLAIM).agg(F.count(F.lit(1)).alias("__n"), F.max("score").alias("__best"), F.max_by(F.col("s1_id"), F.struct(F.col("score"), -F.col("s1_id"))).alias("__owner"))
    joined = df.join(best, list(CLAIM))
    second = joined.where("s1_id <> __owner").groupBy(*CLAIM).agg(F.max("score").alias("__second"))
    joined = joined.join(second, list(CLAIM), "left")
    is_best = F.col("score") >= F.col("__best") - 1e-6
    return (
        joined.withColumn("cand_fanin", F.least("__n", F.lit(32767)))
        .withColumn("cand_is_best_s1", is_best.cast("bigint"))
        .withColumn("cand_best_margin", F.when(is_best, F.col("score") - F.col("__second")).otherwise(F.col("score") - F.col("__best")))
        .drop("__n", "__best", "__owner", "__second")
    )


def mutual_best(df: DataFrame) -> DataFrame:
    """First among its record's claimants and among the positives of its list; needs both contexts of ens_logit."""
    limit: Column = F.greatest("ens_n_pos", F.lit(1))
    return df.withColumn("mutual_best", F.when(F.col("ens_logit").isNotNull(), ((F.col("rec_rank") == 1) & (F.col("ens_rank") <= limit)).cast("bigint")))


#: Features of each level by name; those that need a first scorer's logit.
LEVELS = {
    "BASE": ("v2_logit", "v2_rank", "v2_gap_top", "v2_gap_next", "v2_share"),
    "L0": ("ens_logit", "ce_min", "ce_absdiff", "ce_sign_agree"),
    "L1": ("ens_rank", "ens_gap_top", "ens_gap_next", "ens_share", "ens_entropy", "ens_z", "v1_rank", "v1_gap_top", "rank_shift"),
    "L2": ("rec_rank", "rec_n_pos", "rec_share", "rec_gap_best", "mutual_best"),
}
FIRST_SCORER = frozenset(("ce_min", "ce_absdiff", "ce_sign_agree", "v1_rank", "v1_gap_top"))


def levels(first_scorer: bool) -> dict[str, tuple[str, ...]]:
    """The levels' features, without those of the first scorer if there is none."""
    return {k: tuple(f for f in v if first_scorer or f not in FIRST_SCORER) for k, v in LEVELS.items()}


def variant(base: Sequence[str], upto: str, first_scorer: bool = True) -> list[str]:
    """Features of a variant: the base's and those of all levels up to one; each holds the one before."""
    found = levels(first_scorer)
    return [*base, *(f for level in list(found)[: list(found).index(upto) + 1] for f in found[level])]


def has_first_scorer(df: DataFrame, logit: str) -> bool:
    """Whether any row has a logit of the first scorer."""
    return df.where(F.col(logit).isNotNull()).limit(1).count() > 0


def claimants_of_all_roles(df: DataFrame, x: str, ties: Sequence[str], roles: Sequence[str], prefix: str = "rec") -> DataFrame:
    """The claimant context of the rows of some roles, among the claimants of all roles: the filter comes after the windows."""
    df = written(df, "claimants")
    return group_context(df, CLAIM, x, ties, prefix, hot_groups(df, CLAIM)).where(F.col("role").isin(list(roles)))


def logit_coverage(expected: DataFrame, logits: DataFrame, by: Sequence[str], k: int) -> DataFrame:
    """by, rows, logits, missing, extra, ok: whether every row with rank <= k has a logit and no other pair has one."""
    pair = ["s1_id", "source", "cand_id"]
    want = expected.where(F.col("rank") <= k).select(*by, *pair, F.lit(True).alias("__want"))
    have = logits.select(*by, *pair, F.lit(True).alias("__have"))
    both = want.join(have, [*by, *pair], "full")
    counts = both.groupBy(*by).agg(F.count("__want").alias("rows"), F.count("__have").alias("logits"), F.count_if(F.col("__have").isNull()).alias("missing"), F.count_if(F.col("__want").isNull()).alias("extra"))
    return counts.withColumn("ok", (F.col("missing") == 0) & (F.col("extra") == 0))
