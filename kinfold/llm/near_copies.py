"""Near copies by word shingles: documents whose sets of five-word shingles have Jaccard similarity 0.8 or more.

Candidates come from operator 8's method first: a fingerprint of the set, its
segment popcounts, the grid join under Manhattan distance and the exact Hamming
distance. Four of sixty-four bits hold only the nearest copies, and no radius of
them separates similarity 0.8 (about 10 bits apart, up to 21) from unrelated
texts (32). The rest are found by MinHash: BANDS bands of ROWS minima, of which
a pair of similarity 0.8 misses all with probability (1 - 0.8**6)**40 = 5e-6.
Documents linked by fingerprint or that share a band, directly or over others,
form a neighbourhood; within it every link is found by the exact similarity.

A large neighbourhood is cut into blocks, and its most central document, which
shares bands with the most others, goes into every block. The links within the
blocks join nearly all copies of one text; only documents that they leave out of
the neighbourhood's largest component are compared with all of it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.llm.common import components, hot_keys, hot_left_join, written
from kinfold.llm.near_dups import first_row, links, majority, shingle_hashes, text_key, with_first

SHINGLE = 5
BANDS, ROWS, SEED = 40, 6, 42
#: A neighbourhood with more rows is split into blocks of half as many rows.
GROUP_ROWS = 1024
_DRAWN = np.random.default_rng(SEED).integers(0, 1 << 63, (2, BANDS * ROWS), np.uint64)
FACTORS, MASKS = _DRAWN[0] | np.uint64(1), _DRAWN[1]


def bands(shingles: np.ndarray) -> np.ndarray:
    """A hash of the minima of each band; none without shingles."""
    if not len(shingles):
        return np.empty(0, np.int64)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 1024):
        np.minimum(least, ((shingles[at : at + 1024, None] ^ MASKS) * FACTORS).min(axis=0), out=least)
    raw = least.reshape(BANDS, ROWS)
    return np.array([xxhash.xxh64_intdigest(row.tobytes(), band) for band, row in enumerate(raw)], np.uint64).view(np.int64)


def lists(rows: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, rows)])
    flat = np.concatenate(rows) if rows else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int64()))


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, key (of the text), at (a number of the row), same (a key of the set), fp (its fingerprint, null if empty), bands and shingles of every row."""

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 33
        for whole in found:
            for start in range(0, whole.num_rows, 1024):
                batch = whole.slice(start, 1024)
                sets = [np.unique(shingle_hashes(t.as_py(), SHINGLE)) for t in batch.column(2)]
                same = pa.array([xxhash.xxh128_digest(s.tobytes()) for s in sets], pa.binary())
                numbers = pa.array(np.arange(at, at + len(sets)), pa.int64())
                prints = pa.array([int(majority(s).view(np.int64)) if len(s) else None for s in sets], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), numbers, same, prints, lists([bands(s) for s in sets]), lists([s.view(np.int64) for s in sets])], ["doc_id", "key", "at", "same", "fp", "bands", "shingles"])
                at += len(sets)

    rows = docs.select(F.col("doc_id").cast("bigint"), text_key().alias("key"), F.col("text").cast("string"))
    return rows.mapInArrow(batches, "doc_id long, key string, at long, same binary, fp long, bands array<long>, shingles array<long>")


def set_links(sets: list[np.ndarray]) -> tuple[list[int], list[int]]:
    """Places of edges that span the links of Jaccard similarity 0.8 or more among the sets."""
    sizes = np.array([len(s) for s in sets], np.int64)
    codes = np.unique(np.concatenate(sets), return_inverse=True)[1].ravel()
    order = np.argsort(codes, kind="stable")
    owner = np.repeat(np.arange(len(sets)), sizes)[order]
    firsts = np.r_[0, np.cumsum(np.bincount(codes))]
    begin = np.r_[0, np.cumsum(sizes)]
    alone = np.ones(len(sets), bool)
    a: list[int] = []
    b: list[int] = []
    for start in range(len(sets)):
        if not alone[start]:
            continue
        alone[start] = False
        queue = [start]
        while queue and alone.any():
            x = queue.pop()
            mine = codes[begin[x] : begin[x + 1]]
            common = np.bincount(np.concatenate([owner[firsts[c] : firsts[c + 1]] for c in mine.tolist()]), minlength=len(sets))
            near = np.flatnonzero(alone & (5 * common >= 4 * (sizes + sizes[x] - common))).tolist()
            alone[near] = False
            a.extend([x] * len(near)), b.extend(near), queue.extend(near)
    return a, b


def verified(dealt: DataFrame) -> DataFrame:
    """a, b: edges that span the links within each piece (root, part) of rows at, shingles."""

    def edges(piece: pa.Table) -> pa.RecordBatch:
        piece = piece.combine_chunks()
        column = piece.column("shingles").combine_chunks()
        column = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
        ends, flat = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
        at = piece.column("at").to_numpy()
        a, b = set_links([flat[s:e] for s, e in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)])
        return pa.RecordBatch.from_arrays([pa.array(at[a], pa.int64()), pa.array(at[b], pa.int64())], ["a", "b"])

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []
        last = None
        for batch in found:
            if not batch.num_rows:
                continue
            root, part = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            starts = np.flatnonzero(np.r_[True, (root[1:] != root[:-1]) | (part[1:] != part[:-1])])
            for s, e in zip(starts.tolist(), [*starts[1:].tolist(), batch.num_rows], strict=True):
                key = (int(root[s]), int(part[s]))
                if key != last and kept:
                    yield edges(pa.Table.from_batches(kept))
                    kept = []
                kept.append(batch.slice(s, e - s))
                last = key
        if kept:
            yield edges(pa.Table.from_batches(kept))

    return dealt.select("root", "part", "at", "shingles").repartition("root", "part").sortWithinPartitions("root", "part").mapInArrow(batches, "a long, b long")


def prints_linked(reps: DataFrame) -> DataFrame:
    """a, b: edges that connect all rows (at, fp) whose fingerprints operator 8's grid links, each fingerprint by its least row."""
    rows = reps.where("fp IS NOT NULL").select("at", "fp")
    prints = written(rows.groupBy("fp").agg(F.min("at").alias("least"), F.count(F.lit(1)).alias("n")), "copies-prints")
    least = prints.select("fp", "least")
    equal = hot_left_join(rows, least, "fp", hot_keys(prints, "fp", "n", rows.count())).where("at <> least").select(F.col("at").alias("a"), F.col("least").alias("b"))
    near = written(links(prints), "copies-near")
    for side in ("a", "b"):  # a fingerprint with very many neighbours keeps them in place
        met = written(near.groupBy(side).agg(F.count(F.lit(1)).alias("n")), "copies-met")
        near = hot_left_join(near, least.withColumnsRenamed({"fp": side, "least": f"{side}_at"}), side, hot_keys(met, side, "n", near.count()))
    return equal.unionByName(near.select(F.col("a_at").alias("a"), F.col("b_at").alias("b")))


def bands_shared(reps: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of rows (at, bands): at, band of each; band, least, n of the bands that several share; the hot ones of these."""
    placed = written(reps.select("at", F.explode("bands").alias("band")), "copies-bands")
    buckets = written(placed.groupBy("band").agg(F.min("at").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1"), "copies-buckets")
    return placed, buckets, hot_keys(buckets, "band", "n", placed.count())


def links_within(sets: DataFrame, near: DataFrame, placed: DataFrame, buckets: DataFrame, hot: DataFrame) -> DataFrame:
    """a, b: edges that connect all rows of ``sets`` (at, shingles) linked within a neighbourhood, which ``near`` (a, b) and shared bands make."""
    stars = hot_left_join(placed, buckets.select("band", "least"), "band", hot).where("least IS NOT NULL AND at <> least")
    stars = stars.select(F.col("at").alias("a"), F.col("least").alias("b"))
    groups = written(components(stars.unionByName(near)).withColumnRenamed("node", "at"), "copies-groups")
    sizes = written(groups.groupBy("root").agg(F.count(F.lit(1)).alias("n")), "copies-sizes")
    sized = written(hot_left_join(groups, sizes, "root", hot_keys(sizes, "root", "n", groups.count())), "copies-sized")
    there = sets.select(F.col("at").alias("__at"), "shingles")
    small = sized.where(F.col("n") <= GROUP_ROWS).join(there, F.col("at") == F.col("__at"))
    edges = written(verified(small.withColumn("part", F.lit(0).cast("bigint"))), "copies-links")
    large = sized.where(F.col("n") > GROUP_ROWS)
    if not large.limit(1).count():
        return edges
    held = written(large.join(there, F.col("at") == F.col("__at")).drop("__at"), "copies-large")
    return edges.unionByName(links_of_large(held, central(large, placed, buckets, hot)))


def central(large: DataFrame, placed: DataFrame, buckets: DataFrame, hot: DataFrame) -> DataFrame:
    """__pivot: of each neighbourhood (at, root) the row that shares bands with the most others, the least of equals."""
    mine = placed.join(large.select(F.col("at").alias("__at"), "root"), F.col("at") == F.col("__at"))
    shared = hot_left_join(mine.select("at", "root", "band"), buckets.select("band", F.col("n").alias("__n")), "band", hot)
    each = shared.groupBy("root", "at").agg(F.sum("__n").alias("shared"))
    return each.groupBy("root").agg(F.max_by("at", F.struct("shared", -F.col("at"))).alias("__pivot")).select("__pivot")


def links_of_large(held: DataFrame, pivots: DataFrame) -> DataFrame:
    """a, b: edges that connect all linked rows of large neighbourhoods (at, root, n, shingles)."""
    half = GROUP_ROWS // 2
    blocks = F.ceil(F.col("n") / half).cast("int")
    block = lambda of: F.pmod(F.xxhash64("at"), of).cast("bigint")
    all_of = lambda of: F.explode(F.sequence(F.lit(0).cast("bigint"), of.cast("bigint") - 1))
    columns = ("root", "part", "at", "shingles")
    dealt = held.withColumn("part", block(blocks)).select(*columns)
    everywhere = held.join(pivots, F.col("at") == F.col("__pivot"), "left_semi").withColumn("part", all_of(blocks)).select(*columns)
    first = written(verified(dealt.unionByName(everywhere)), "copies-first")

    found = components(first).select(F.col("node").alias("__node"), F.col("root").alias("__comp"))
    known = held.select("at", "root", "n").join(found, F.col("at") == F.col("__node"), "left")
    known = written(known.select("at", "root", "n", F.coalesce("__comp", "at").alias("comp")), "copies-known")
    parts = written(known.groupBy("root", "comp").agg(F.count(F.lit(1)).alias("c")), "copies-parts")
    main = parts.groupBy("root").agg(F.max_by("comp", F.struct("c", -F.col("comp"))).alias("main"), (F.sum("c") - F.max("c")).alias("left"), F.sum("c").alias("n"))
    main = written(main, "copies-main")
    hot = hot_keys(main, "root", "n", known.count())
    with_main = hot_left_join(known.drop("n"), main, "root", hot).where(F.col("left") > 0)
    rest = F.ceil(F.col("left") / half).cast("int")
    number = lambda mine, other: mine * F.lit(1 << 30) + other
    asking = with_main.where("comp <> main").withColumn("other", all_of(blocks)).withColumn("part", number(block(rest), F.col("other")))
    asked = with_main.withColumn("other", all_of(rest)).withColumn("part", number(F.col("other"), block(blocks)))
    pairs = asking.unionByName(asked).select(F.col("at").alias("__at"), "part")
    cross = held.select("root", "at", "shingles").join(pairs, F.col("at") == F.col("__at")).select(*columns)
    return first.unionByName(written(verified(cross), "copies-cross"))


def same_texts(docs: DataFrame) -> DataFrame:
    """doc_id, key and ``first`` (the smallest (doc_id, key) reachable) of every row of ``docs``."""
    rows = written(sketches(docs), "copies-sketches")
    classes = written(rows.groupBy("same").agg(first_row().alias("first"), F.min("at").alias("at"), F.count(F.lit(1)).alias("n")), "copies-classes")
    one = classes.select(F.col("at").alias("__at"))
    reps = rows.select("at", "fp", "bands").join(one, F.col("at") == F.col("__at"), "left_semi")
    edges = links_within(rows.select("at", "shingles"), prints_linked(reps), *bands_shared(reps))
    return with_first(rows.select("doc_id", "key", "same"), "same", classes, "at", edges)


def near_copies(docs: DataFrame) -> DataFrame:
    """doc_id, component_id for every row of ``docs`` (doc_id, text); component_id is the smallest doc_id reachable over links.

    Defined cases: null, empty and blank texts have the empty set and are copies
    of each other; a text of under five words is one shingle; a very long text
    is read whole; null ids keep their rows, link others and count in no
    component_id; repeated rows stay; an empty table gives an empty result;
    other columns are left out.
    """
    return same_texts(docs).select("doc_id", F.col("first.doc_id").alias("component_id"))
