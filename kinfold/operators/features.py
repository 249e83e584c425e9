"""Token weights and the pair features that compare two records."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinfold.functions.similarity import score_pairs
from kinfold.operators import tiles
from kinfold.operators.joins import hot_keys, hot_left_join
from kinfold.session import written

TOKEN = r"[^\p{L}\p{N}_]+"


def tokens(c: Column) -> Column:
    """Distinct words of a text."""
    return F.array_distinct(F.filter(F.split(F.coalesce(c, F.lit("")), TOKEN), lambda t: t != ""))


def fit_idf(df: DataFrame, text: str) -> DataFrame:
    """token, df, idf = ln((1 + n) / (1 + df)) + 1 over the rows of df; exact, no hashing."""
    n = df.count()
    seen = df.select(F.explode(tokens(F.col(text))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    return seen.withColumn("idf", F.ln(F.lit(1.0 + n) / (1 + F.col("df"))) + 1)


def word_weights(df: DataFrame, text: str, idf: DataFrame, key: Sequence[str], out: str) -> DataFrame:
    """key and ``out``, a map of the words of a text to their weights, for every row of df (one for each key).

    A word outside the fitted table has the weight of a word of no document. A
    word in very many texts keeps them where they lie.
    """
    top, n = idf.agg(F.max(F.col("idf") + F.ln(1 + F.col("df"))), F.sum("df")).first()  # ln(1 + rows) + 1
    each = df.select(*key, F.explode(tokens(F.col(text))).alias("token"))
    weighed = hot_left_join(each, idf.select("token", "idf"), "token", hot_keys(idf, "token", "df", n or 0))
    entry = F.struct("token", F.coalesce("idf", F.lit(top or 1.0)))
    maps = weighed.groupBy(*key).agg(F.map_from_entries(F.collect_list(entry)).alias(out))
    none = F.from_json(F.lit("{}"), "map<string,double>")
    return df.select(*key).join(maps, list(key), "left").withColumn(out, F.coalesce(out, none))


def overlap_of(a: Column, b: Column) -> dict[str, Column]:
    """tok_jaccard, idf_jaccard, idf_cover_min, left and right unmatched shares and rarest shared word of two maps of weights."""
    total = lambda xs: F.aggregate(F.array_sort(xs), F.lit(0.0), lambda s, x: s + x)
    common = F.transform(F.array_intersect(F.map_keys(a), F.map_keys(b)), lambda t: a[t])
    wi, wa, wb = total(common), total(F.map_values(a)), total(F.map_values(b))
    union = F.size(F.array_union(F.map_keys(a), F.map_keys(b)))
    share = lambda x, y: F.when(y > 0, x / y)
    return {
        "tok_jaccard": share(F.size(common), union),
        "idf_jaccard": share(wi, wa + wb - wi),
        "idf_cover_min": share(wi, F.least(wa, wb)),
        "s1_unmatched": 1 - share(wi, wa),
        "cand_unmatched": 1 - share(wi, wb),
        "rarest_shared_idf": F.coalesce(F.array_max(common), F.lit(0.0)),
    }


def overlap(pairs: DataFrame, left: str, right: str, idf: DataFrame, keys: list[str]) -> DataFrame:
    """For each pair of texts: the measures of ``overlap_of`` over the weights of a fitted table."""
    weights = word_weights(pairs, left, idf, keys, "__a").join(word_weights(pairs, right, idf, keys, "__b"), keys)
    return weights.select(*keys, *(c.alias(n) for n, c in overlap_of(F.col("__a"), F.col("__b")).items()))


def state(a: Column, b: Column) -> Column:
    """0 both missing, 1 one missing, 2 equal, 3 different."""
    return F.when((a == "") & (b == ""), 0).when((a == "") | (b == ""), 1).when(a == b, 2).otherwise(3)


def postal_state(a: Column, b: Column) -> Column:
    """As ``state``, but 3 one edit apart and 4 different."""
    return F.when(state(a, b) < 3, state(a, b)).when(F.levenshtein(a, b) == 1, 3).otherwise(4)


def both(name: str) -> Column:
    return F.col(f"a.{name}").cast("int") + F.col(f"b.{name}").cast("int")


def equal_nonempty(a: Column, b: Column) -> Column:
    return ((a == b) & (a != "")).cast("int")


def pair_features(candidates: DataFrame, s1: DataFrame, pool: DataFrame, name_idf: DataFrame, addr_idf: DataFrame) -> DataFrame:
    """All comparison features of candidates (s1_id, source, cand_id, rank) between prepared records.

    s1 and pool hold the prepared columns with id (and source for the pool).
    Words are weighted by record, before records are paired; pairs are joined by
    id alone and compared where they lie.
    """
    weighed = lambda df, key: df.join(word_weights(df, "name_latin", name_idf, key, "name_words"), key).join(word_weights(df, "addr_latin", addr_idf, key, "addr_words"), key)
    s1, pool = weighed(s1, ["id"]), weighed(pool, ["source", "id"])
    keys = ["s1_id", "source", "cand_id"]
    a = s1.select(F.col("id").alias("s1_id"), F.struct(*(c for c in s1.columns if c != "id")).alias("a"))
    b = pool.select("source", F.col("id").alias("cand_id"), F.struct(*(c for c in pool.columns if c not in ("id", "source"))).alias("b"))
    df = candidates.join(a, "s1_id").join(b, ["source", "cand_id"])
    fields = {"latin": "name_latin", "core": "name_core", "skel": "name_skeleton", "aka": "name_aka", "addr": "addr_latin"}
    flat = {f"{side}_{f}": F.col(f"{side}.{c}") for side in "ab" for f, c in fields.items()}
    df = df.withColumns(flat | {f"{side}_bare": F.replace(F.col(f"{side}.name_core"), F.lit(" "), F.lit("")) for side in "ab"})
    four = ("ratio", "tset", "tsort", "jw")
    sides = {"latin": ("a_latin", "b_latin", four), "core": ("a_core", "b_core", (*four, "partial")), "skel": ("a_skel", "b_skel", four), "addr": ("a_addr", "b_addr", ("tset", "ratio")), "bare": ("a_bare", "b_bare", ("ratio",))}
    sides |= {"aka1": ("a_aka", "b_core", ("tset",)), "aka2": ("a_core", "b_aka", ("tset",)), "aka3": ("a_aka", "b_aka", ("tset",))}
    df = score_pairs(df, [(a, b, n) for n, (a, b, _) in sides.items()], [names for _, _, names in sides.values()])
    out: dict[str, Column] = {}
    for f in ("latin", "core", "skel"):
        out |= {f"name_{f}_{s}": F.col(f"{f}.{s}") for s in ("ratio", "tset", "tsort", "jw", "lev")}
        out[f"name_{f}_eq"] = equal_nonempty(F.col(f"a_{f}"), F.col(f"b_{f}"))
    at = lambda side, f, i: F.element_at(F.split(F.col(f"{side}_{f}"), " "), i)
    la, lb = F.length("a_latin"), F.length("b_latin")
    best_alias = F.greatest(F.col("core.tset"), F.col("aka1.tset"), F.col("aka2.tset"), F.col("aka3.tset"))
    out |= {
        "name_core_partial": F.col("core.partial"),
        "name_first_tok_eq": equal_nonempty(at("a", "core", 1), at("b", "core", 1)),
        "name_last_tok_eq": equal_nonempty(at("a", "core", -1), at("b", "core", -1)),
        "skel_first_tok_eq": equal_nonempty(at("a", "skel", 1), at("b", "skel", 1)),
        "name_ntok_absdiff": F.abs(F.col("a.name_n_tokens") - F.col("b.name_n_tokens")),
        "name_len_ratio": F.when(F.greatest(la, lb) > 0, F.least(la, lb) / F.greatest(la, lb)),
        "alias_best_tset": best_alias,
        "alias_gain": best_alias - F.coalesce(F.col("core.tset"), F.lit(0.0)),
        "aka_n": (F.col("a_aka") != "").cast("int") + (F.col("b_aka") != "").cast("int"),
        "suffix_state": state(F.col("a.legal_suffix"), F.col("b.legal_suffix")),
        "addr_tset": F.col("addr.tset"),
        "addr_ratio": F.col("addr.ratio"),
        "postal_state": postal_state(F.col("a.postal_code"), F.col("b.postal_code")),
        "street_state": state(F.col("a.street_number"), F.col("b.street_number")),
        "landmark_n": both("has_landmark"),
        "s1_addr_missing": F.col("a.addr_missing").cast("int"),
        "cand_addr_missing": F.col("b.addr_missing").cast("int"),
        "multi_loc_n": both("addr_is_multi_location"),
        "name_cross_script": ((F.col("a.name_script") != F.col("b.name_script")) & (F.col("a.name_script") != "") & (F.col("b.name_script") != "")).cast("int"),
        "cand_name_script": F.coalesce(F.nullif(F.col("b.name_script"), F.lit("")), F.lit("empty")),
        "cand_name_romanized": F.col("b.name_was_romanized").cast("int"),
        "name_mixed_n": both("name_is_mixed_script"),
        "domain_n": both("is_domain_name"),
        "core_nospace_ratio": F.col("bare.ratio"),
        "name_phone_n": both("name_has_embedded_phone"),
        "addr_phone_n": both("addr_has_embedded_phone"),
        "name_missing_n": both("name_missing"),
        "country": F.col("b.country_norm"),
    }
    for prefix, words in (("name", "name_words"), ("addr", "addr_words")):
        found = overlap_of(F.col(f"a.{words}"), F.col(f"b.{words}"))
        out |= {f"{prefix}_{n}" if n in ("tok_jaccard", "rarest_shared_idf") or n.startswith("idf") else f"{prefix}_idf_{n}": c for n, c in found.items()}
    return df.select(*keys, "rank", *(c.alias(n) for n, c in out.items()))


def char_grams(text: Column, sizes: Sequence[int]) -> Column:
    """Character n-grams within the padded words of a text, one array; a word shorter than n counts whole, once a word."""
    def of_word(word: Column) -> Column:
        padded = F.concat(F.lit(" "), word, F.lit(" "))
        # not lambda i, n=n: transform would pass the index for n
        of_size = lambda n: F.transform(F.sequence(F.lit(1), F.length(padded) - n + 1), lambda i: F.substring(padded, i, F.lit(n)))
        return F.array_distinct(F.flatten(F.array(*(F.when(F.length(padded) >= n, of_size(n)).otherwise(F.array(padded)) for n in sizes))))

    return F.flatten(F.transform(F.filter(F.split(F.lower(text), TOKEN), lambda t: t != ""), of_word))


def gram_products(k: int) -> tiles.Scorer:
    """The k largest sums of products of weights over common n-grams, each query against the postings of a block."""

    def flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        grams, weights = batch.column("grams"), batch.column("weights")
        ends = np.r_[0, np.cumsum(grams.value_lengths().to_numpy())]
        return ends, grams.flatten().to_numpy(), weights.flatten().to_numpy()

    def of_block(block: pa.RecordBatch) -> Callable:
        ends, grams, weights = flat(block)
        owner = np.repeat(np.arange(block.num_rows), np.diff(ends))
        order = np.argsort(grams, kind="stable")
        known, starts = np.unique(grams[order], return_index=True)
        stops, owner, weights = np.r_[starts[1:], len(grams)], owner[order], weights[order]

        def answer(queries: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            q_ends, q_grams, q_weights = flat(queries)
            at = np.minimum(np.searchsorted(known, q_grams), len(known) - 1)
            there = known[at] == q_grams
            out = []
            for q in range(queries.num_rows):
                s, e = q_ends[q], q_ends[q + 1]
                hits = [(starts[g], stops[g], w) for g, w, ok in zip(at[s:e].tolist(), q_weights[s:e].tolist(), there[s:e].tolist(), strict=True) if ok]
                if not hits:
                    continue
                rows = np.concatenate([owner[a:b] for a, b, _ in hits])
                score = np.bincount(rows, np.concatenate([weights[a:b] * w for a, b, w in hits]), minlength=block.num_rows)
                held = np.flatnonzero(np.bincount(rows, minlength=block.num_rows))
                if len(held) > k:
                    bar = np.partition(score[held], len(held) - k)[len(held) - k]
                    held = held[score[held] >= bar - 1e-9]
                out.append((np.full(len(held), q), held, score[held]))
            return tuple(map(np.concatenate, zip(*out, strict=True))) if out else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))

        return answer

    return of_block


def ngram_topk(queries: DataFrame, pool: DataFrame, text: str, k: int, sizes: tuple[int, ...] = (2, 3, 4), digits: int = 9) -> DataFrame:
    """s1_id, cand_id, score, rank: the k pool records nearest by TF-IDF of character n-grams within words (cosine).

    Scores count to ``digits`` digits, ties go to the smaller id; records without a
    common n-gram aren't found; the rows of a repeated id count as one text. Equal
    texts are searched and found once: a list of k texts holds the k best records,
    as each text before a record's own has a smaller id or a better score. Weights
    are joined by n-gram, one that very many texts hold stays where it lies; the
    products are formed block by block, so no pair of texts is shuffled but the
    best of each block.
    """
    def rows_of(df: DataFrame, key: str) -> DataFrame:
        texts = df.groupBy(F.col(key).alias("id")).agg(F.concat_ws("\n", F.sort_array(F.collect_list(F.col(text).cast("string")))).alias("text"))
        return written(texts, "gram-rows")

    def grams(kinds: DataFrame) -> DataFrame:
        each = kinds.select("id", "n", F.explode(char_grams(F.col("text"), sizes)).alias("g"))
        return written(each.groupBy("id", "n", "g").agg(F.count(F.lit(1)).alias("tf")), "grams")

    asks, holds = rows_of(queries, "s1_id"), rows_of(pool, "cand_id")
    kinds, others = (written(r.groupBy("text").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n")), "gram-kinds") for r in (asks, holds))
    q, p = grams(kinds), grams(others)
    n = pool.count()
    idf = written(p.groupBy("g").agg(F.sum("n").alias("df"), F.count(F.lit(1)).alias("rows")), "gram-counts")
    total = idf.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    value = F.ln(F.lit(1.0 + n) / (1 + F.col("df"))) + 1

    def weighted(df: DataFrame) -> DataFrame:
        w = hot_left_join(df, idf.select("g", "df"), "g", hot_keys(idf, "g", "rows", total)).where("df IS NOT NULL").withColumn("w", F.col("tf") * value)
        rows = w.groupBy("id").agg(F.sort_array(F.collect_list(F.struct(F.xxhash64("g").alias("g"), "w"))).alias("e"))
        norm = F.sqrt(F.aggregate("e", F.lit(0.0), lambda s, e: s + e.w * e.w))
        return rows.withColumn("__n", norm).select("id", F.transform("e", lambda e: e.g).alias("grams"), F.transform("e", lambda e: e.w / F.col("__n")).alias("weights"))

    def ranked(df: DataFrame, by: str, *order: Column | str) -> DataFrame:
        return df.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order)).cast("bigint")).where(F.col("rank") <= k)

    found = tiles.best_of(weighted(q), weighted(p), "id", None, lambda: gram_products(k))
    near = ranked(found.withColumn("score", F.round("score", digits)), "asking", F.desc("score"), "found").drop("rank")
    few = ranked(holds, "text", "id").join(others.select("text", F.col("id").alias("found")), "text").select("found", F.col("id").alias("cand_id"))
    best = ranked(near.join(few, "found"), "asking", F.desc("score"), "cand_id")
    lists = best.groupBy("asking").agg(F.collect_list(F.struct("cand_id", "score", "rank")).alias("__best"))
    told = written(kinds.select("text", "id").join(lists, F.col("id") == F.col("asking")).select("text", "__best"), "gram-lists")
    every = hot_left_join(asks, told, "text", hot_keys(kinds, "text", "n", asks.count()))
    return every.select(F.col("id").alias("s1_id"), F.inline("__best"))


def merged_keys(first: DataFrame, second: DataFrame, k: int) -> DataFrame:
    """The union of two keys' lists (s1_id, cand_id, rank): of a pair its better rank, at most 2 k for each query."""
    both = first.select("s1_id", "cand_id", "rank").unionByName(second.select("s1_id", "cand_id", "rank"))
    return both.where(F.col("rank") <= k).groupBy("s1_id", "cand_id").agg(F.min("rank").alias("rank"))


def key_recall(found: DataFrame, positives: DataFrame, by: str) -> DataFrame:
    """by (null: all), recall, n: share of the positives (s1_id, cand_id, by) that a key's lists hold."""
    hit = positives.join(found.select("s1_id", "cand_id").distinct().withColumn("__hit", F.lit(1)), ["s1_id", "cand_id"], "left")
    return hit.groupingSets([[F.col(by)], []], F.col(by)).agg(F.avg(F.coalesce("__hit", F.lit(0)).cast("double")).alias("recall"), F.count(F.lit(1)).alias("n"))
