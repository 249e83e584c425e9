"""The metric (macro F0.5 over queries with the singleton rule), thresholds, policies and resampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinfold.operators import stats
from kinfold.session import written


def f05(tp: Column, accepted: Column, true: Column) -> Column:
    """F0.5 of one query. Without true matches it is 1 if nothing is accepted, else 0."""
    p, r = tp / accepted, tp / true
    return F.when(true == 0, (accepted == 0).cast("double")).when(tp > 0, 1.25 * p * r / (0.25 * p + r)).otherwise(0.0)


def per_query(universe: DataFrame, pairs: DataFrame, accepted: Column) -> DataFrame:
    """universe (s1_id, n_true, ...) with tp, n_pred and f; queries without pairs count too."""
    counts = pairs.where(accepted).groupBy("s1_id").agg(F.count(F.lit(1)).alias("n_pred"), F.count_if(F.col("label") == 1).alias("tp"))
    joined = universe.join(counts, "s1_id", "left").na.fill(0, ["n_pred", "tp"])
    return joined.withColumn("f", f05(F.col("tp"), F.col("n_pred"), F.col("n_true")))


def slices(scored: DataFrame, group: str) -> DataFrame:
    """Mean F and size overall, by group, by singleton and by both, in one pass."""
    return scored.withColumn("singleton", F.col("n_true") == 0).groupingSets([[F.col(group), F.col("singleton")], [F.col(group)], [F.col("singleton")], []], F.col(group), F.col("singleton")).agg(F.avg("f").alias("s1_macro_f05"), F.count(F.lit(1)).alias("n_s1"), F.avg("n_pred").alias("accepted_per_s1"), F.count_if((F.col("n_true") == 0) & (F.col("n_pred") > 0)).alias("singletons_with_false_accept"))


def threshold_curve(universe: DataFrame, pairs: DataFrame, score: str, grid: list[float]) -> DataFrame:
    """threshold, s1_macro_f05 for every threshold of ``grid``, from one pass over the pairs.

    Down its list a query's F changes only at its own scores. The changes are
    summed by the grid step in which they happen and added up along the grid, so
    the work grows with the pairs, not with pairs times thresholds.
    """
    steps = sorted(set(grid))
    at = pairs.where(F.col(score).isNotNull()).groupBy("s1_id", F.col(score).alias("x")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("label") == 1).alias("pos"))
    down = Window.partitionBy("s1_id").orderBy(F.desc("x")).rowsBetween(Window.unboundedPreceding, 0)
    order = Window.partitionBy("s1_id").orderBy(F.desc("x"))
    moved = at.join(universe.select("s1_id", "n_true"), "s1_id").withColumn("f", f05(F.sum("pos").over(down), F.sum("n").over(down), F.col("n_true")))
    start = F.when(F.col("n_true") == 0, 1.0).otherwise(0.0)
    moved = moved.withColumn("change", F.col("f") - F.coalesce(F.lag("f").over(order), start))
    step = F.size(F.filter(F.array(*map(F.lit, steps)), lambda t: t <= F.col("x")))  # steps at or below the score
    changes = moved.groupBy(step.alias("step")).agg(F.sum("change").alias("change")).where("step > 0")
    base = universe.agg(F.avg(F.when(F.col("n_true") == 0, 1.0).otherwise(0.0)).alias("f0"), F.count(F.lit(1)).alias("n"))
    spark = pairs.sparkSession
    points = spark.createDataFrame([(i + 1, t) for i, t in enumerate(steps)], "step int, threshold double")
    along = Window.orderBy(F.desc("step"))  # one row for each threshold
    return points.join(changes, "step", "left").join(F.broadcast(base)).select("threshold", (F.col("f0") + F.coalesce(F.sum("change").over(along), F.lit(0.0)) / F.col("n")).alias("s1_macro_f05"))


#: The levels of the grid, the fine steps and the offsets of ``fit_policy`` are fixed values.
def quantile_grid(pairs: DataFrame, score: str, coarse: int = 200) -> list[float]:
    """Quantiles of the scores, dense at the top, and a value above all ('accept nothing')."""
    levels = [0.8 * i / 40 for i in range(41)] + [0.8 + 0.1995 * i / (coarse - 1) for i in range(coarse)]
    found = stats.quantiles(pairs, score, levels).first()
    top = pairs.agg(F.max(score)).first()[0]
    return sorted({*found.q, top + 1e-9 * max(1.0, abs(top))}) if found else [0.0]


def best_threshold(universe: DataFrame, pairs: DataFrame, score: str, fine: int = 60) -> tuple[float, float]:
    """Threshold with the best macro F0.5 (the lowest of equals, to nine digits): a grid of quantiles, then a fine one round its best."""
    def best(grid: list[float]) -> tuple[float, float]:
        row = threshold_curve(universe, pairs, score, grid).withColumn("s1_macro_f05", F.round("s1_macro_f05", 9)).orderBy(F.desc("s1_macro_f05"), "threshold").first()
        return row["threshold"], row["s1_macro_f05"]

    pairs = written(pairs.select("s1_id", "label", score), "scored")  # read by each of the passes
    grid = quantile_grid(pairs, score)
    t, f = best(grid)
    i = grid.index(t)
    low, high = grid[max(i - 1, 0)], grid[min(i + 1, len(grid) - 1)]
    if high > low:
        t2, f2 = best([low + (high - low) * k / (fine - 1) for k in range(fine)])
        t, f = (t2, f2) if f2 > f else (t, f)
    return t, f


def policy(kind: str, t: float, t_top: float | None = None, prob: str = "p") -> Column:
    """thr: p >= t. thr_top: also the best of a list (all that tie) with p >= t_top."""
    take = F.col(prob) >= t
    if kind == "thr_top":
        take |= (F.col(prob) == F.max(prob).over(Window.partitionBy("s1_id"))) & (F.col(prob) >= t_top)
    return take


def weak_single_empty(pairs: DataFrame, t: float, prob: str = "p") -> DataFrame:
    """A query whose only accepted pair has p < t loses it (column acc)."""
    group = Window.partitionBy("s1_id")
    only = (F.count_if("acc").over(group) == 1) & (F.max(F.when(F.col("acc"), F.col(prob))).over(group) < t)
    return pairs.withColumn("acc", F.col("acc") & ~only)


def fit_policy(universe: DataFrame, pairs: DataFrame, prob: str = "p") -> dict:
    """The best of a threshold and nine thresholds with a lower bar for the top of a list."""
    t, best = best_threshold(universe, pairs, prob)
    found = {"kind": "thr", "t": t, "t_top": None}
    group = Window.partitionBy("s1_id")
    marked = pairs.withColumn("__top", F.col(prob) == F.max(prob).over(group))
    options = [(t + a, t - b) for a in (0.0, 0.05, 0.1) for b in (0.1, 0.2, 0.3) if t - b > 0.05]
    takes = [(F.col(prob) >= t1) | (F.col("__top") & (F.col(prob) >= t2)) for t1, t2 in options]
    if not options:
        return found
    counts = marked.groupBy("s1_id").agg(*(c for i, take in enumerate(takes) for c in (F.count_if(take).alias(f"n{i}"), F.count_if(take & (F.col("label") == 1)).alias(f"tp{i}"))))
    joined = universe.select("s1_id", "n_true").join(counts, "s1_id", "left").na.fill(0)
    row = joined.agg(*(F.avg(f05(F.col(f"tp{i}"), F.col(f"n{i}"), F.col("n_true"))).alias(f"f{i}") for i in range(len(options)))).first()
    for i, (t1, t2) in enumerate(options):
        if (f := round(row[i], 9)) > best:
            best, found = f, {"kind": "thr_top", "t": t1, "t_top": t2}
    return found


def crossfit(universe: DataFrame, pairs: DataFrame, fold: Column, folds: int = 2, prob: str = "p") -> tuple[DataFrame, dict]:
    """Every query scored with the policy of the other folds, and the policy of all."""
    parts = []
    universe, pairs = written(universe, "universe"), written(pairs, "pairs")  # read by every fold
    u, d = universe.withColumn("__fold", fold), pairs.withColumn("__fold", fold)
    for g in range(folds):
        rule = fit_policy(u.where(F.col("__fold") != g), d.where(F.col("__fold") != g), prob)
        parts.append(per_query(u.where(F.col("__fold") == g), d.where(F.col("__fold") == g).withColumn("__take", policy(**rule, prob=prob)), F.col("__take")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.drop("__fold"), fit_policy(universe, pairs, prob)


def hit_at(pairs: DataFrame, order: Column, name: str) -> DataFrame:
    """One row: share of lists with a positive whose first, or one of the first three, is positive."""
    ranked = pairs.withColumn("__k", F.row_number().over(Window.partitionBy("s1_id").orderBy(order, "rank")))
    lists = ranked.groupBy("s1_id").agg(F.max("label").alias("any"), F.max(F.when(F.col("__k") == 1, F.col("label"))).alias("h1"), F.max(F.when(F.col("__k") <= 3, F.col("label"))).alias("h3")).where("any = 1")
    return lists.agg(F.lit(name).alias("order_by"), F.avg("h1").alias("hit_at_1"), F.avg("h3").alias("hit_at_3"), F.count(F.lit(1)).alias("n_s1"))


def bootstrap(values: DataFrame, x: str, key: str, rounds: int = 200, seed: int = 0) -> DataFrame:
    """round, mean of Poisson(1) resamples of x: weights come from a hash of (key, round), so reruns agree.

    Rows are exploded to rounds and combined before the exchange: ``rounds`` rows are shuffled for each task.
    """
    ident = F.concat_ws("|", F.col(key).cast("string"), F.col("round").cast("string"), F.lit(str(seed)))
    u = (F.pmod(F.conv(F.substring(F.md5(ident.cast("binary")), 1, 8), 16, 10).cast("bigint"), F.lit(1 << 30)) + 0.5) / (1 << 30)
    tail, cut, term = 0.0, F.lit(0), 1.0 / 2.718281828459045
    for k in range(8):  # inverse of the distribution function
        tail += term
        cut = cut + (F.col("u") > tail).cast("int")
        term /= k + 1
    exploded = values.select(key, x, F.explode(F.sequence(F.lit(1), F.lit(rounds))).alias("round")).withColumn("u", u).withColumn("w", cut)
    return exploded.groupBy("round").agg((F.sum(F.col("w") * F.col(x)) / F.sum("w")).alias("mean"))


def paired_bootstrap(base: DataFrame, new: DataFrame, rounds: int = 200, seed: int = 0) -> DataFrame:
    """One row: delta of mean F (new - base), its 95 % interval and a verdict. Both hold (s1_id, f) of one universe."""
    both = base.select("s1_id", F.col("f").alias("a")).join(new.select("s1_id", F.col("f").alias("b")), "s1_id")
    return verdict_of(both, rounds, seed)


def verdict_of(both: DataFrame, rounds: int = 200, seed: int = 0) -> DataFrame:
    """The verdict on two runs' scores (s1_id, a, b)."""
    both = both.withColumn("d", F.col("b") - F.col("a"))
    means = bootstrap(both, "d", "s1_id", rounds, seed).agg(F.percentile("mean", 0.025).alias("low"), F.percentile("mean", 0.975).alias("high"), F.avg((F.col("mean") <= 0).cast("double")).alias("p_not_better"))
    verdict = F.when(F.col("low") > 0, "BETTER").when(F.col("high") < 0, "WORSE").otherwise("WITHIN NOISE")
    return both.agg(F.avg("d").alias("delta")).join(F.broadcast(means)).withColumn("verdict", verdict)


def label_sanity(universe: DataFrame, pairs: DataFrame) -> DataFrame:
    """One row of counts that should be 0: pairs of unknown queries, labels other than 0 and 1, queries with more positives than they have, repeated pairs."""
    per = pairs.groupBy("s1_id").agg(F.count_if(F.col("label") == 1).alias("pos"), F.count_if(~F.coalesce(F.col("label").isin(0, 1), F.lit(False))).alias("odd"), F.count(F.lit(1)).alias("n"))
    joined = per.join(universe.select("s1_id", "n_true"), "s1_id", "left")
    repeated = pairs.groupBy("s1_id", "source", "cand_id").count().agg(F.count_if(F.col("count") > 1).alias("repeated_pairs"))
    one = joined.agg(
        F.coalesce(F.sum(F.when(F.col("n_true").isNull(), F.col("n"))), F.lit(0)).alias("unknown_s1_pairs"),
        F.coalesce(F.sum("odd"), F.lit(0)).alias("odd_labels"),
        F.count_if(F.col("pos") > F.col("n_true")).alias("too_many_positives"),
    )
    return one.join(F.broadcast(repeated))  # single rows


def named_slices(scored: DataFrame, group: str, cross: str) -> DataFrame:
    """slice, mean F, size: singletons, matched, queries with and without a match in another script, each group, and groups with the first and third."""
    single, matched = F.col("n_true") == 0, F.col("n_true") > 0
    kinds = {"singleton": single, "matched": matched, "cross_script": F.col(cross), "same_script": matched & ~F.col(cross)}
    of_group = F.concat(F.lit(f"{group}="), F.col(group).cast("string"))
    parts = [F.when(c, F.lit(n)) for n, c in kinds.items()]
    parts += [of_group, *(F.when(kinds[n], F.concat(of_group, F.lit(f"|{n}"))) for n in ("singleton", "cross_script"))]
    each = scored.select("f", F.explode(F.filter(F.array(*parts), lambda p: p.isNotNull())).alias("slice"))
    return each.groupBy("slice").agg(F.avg("f").alias("s1_macro_f05"), F.count(F.lit(1)).alias("n_s1"))


def pair_slices(pairs: DataFrame, score: str, threshold: float, columns: tuple[str, ...]) -> DataFrame:
    """slice, n, n_pos, precision, recall, f05 of pairs at a threshold, for every value of each column."""
    value = lambda c: F.concat(F.lit(f"{c}="), F.col(c).cast("string"))
    each = pairs.select("label", (F.col(score) >= threshold).alias("__acc"), F.explode(F.array(*map(value, columns))).alias("slice")).where("slice IS NOT NULL")
    sums = each.groupBy("slice").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("label") == 1).alias("n_pos"), F.count_if("__acc").alias("taken"), F.count_if(F.col("__acc") & (F.col("label") == 1)).alias("tp"))
    p, r = F.when(F.col("taken") > 0, F.col("tp") / F.col("taken")), F.when(F.col("n_pos") > 0, F.col("tp") / F.col("n_pos"))
    f = F.when(F.col("tp") > 0, 1.25 * p * r / (0.25 * p + r)).otherwise(0.0)
    return sums.select("slice", "n", "n_pos", p.alias("precision"), r.alias("recall"), f.alias("f05"))
