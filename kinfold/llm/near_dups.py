"""Operator 8: near-duplicates by SimHash with a segment-popcount grid.

A fingerprint of 64 bits is cut into 32 segments of two bits; the bit counts of
the segments (0, 1 or 2 each) embed it so that the Manhattan distance of two
embeddings never exceeds the Hamming distance of the fingerprints. The segments
form two blocks of 16. If two embeddings lie within 4, they lie within 2 on the
first block or within 1 on the second: else the distance is 3 + 2 at least.

A cell is a point of a block's grid. On the first block every fingerprint enters
its own cell and those one step away, so that two within 2 meet at a point
between them; on the second its own cell and those one step up. Two random
fingerprints share a cell with probability 4e-5, and every pair that does is
verified by the exact Hamming distance.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.llm.common import components, hot_keys, hot_left_join, unused, written

SHINGLE, SEED, RADIUS = 4, 42, 4
#: Two-bit segments of a block.
BLOCK = 16
#: A cell with more rows is split into pairs of blocks of half as many rows.
CELL_ROWS = 8192
#: A cell of at most so many rows is compared all at once with other small cells.
SMALL_CELL, PAIRS_AT_ONCE = 64, 1 << 20
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def shingle_hashes(text: str | None, n: int = SHINGLE) -> np.ndarray:
    """XXH64 of every n-word shingle, repeats included; of all words if fewer; none without words."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= n:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-n] + 1))
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends[n - 1 :].tolist(), strict=True)), np.uint64, len(starts))


def fingerprint(text: str | None, n: int = SHINGLE) -> np.uint64:
    """Bit i is set if it is set in over half the shingle hashes; zero without words."""
    return majority(shingle_hashes(text, n))


def majority(hashes: np.ndarray) -> np.uint64:
    """The bits that over half the hashes have; zero without hashes."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        piece = hashes[at : at + 65536]
        counts += np.unpackbits(piece.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)[0]


def text_key() -> Column:
    """Tells rows with one doc_id but different texts apart."""
    return F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, key (of the text), fp (the 64 bits as a signed long) of every row."""

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            prints = np.fromiter((fingerprint(t.as_py()) for t in batch.column(2)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(prints.view(np.int64))], ["doc_id", "key", "fp"])

    rows = docs.select(F.col("doc_id").cast("bigint"), text_key().alias("key"), F.col("text").cast("string"))
    return rows.mapInArrow(batches, "doc_id long, key string, fp long")


def popcounts(prints: np.ndarray) -> np.ndarray:
    """Bit counts of the 32 segments, one row for each fingerprint."""
    bits = np.unpackbits(prints.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return bits[:, 0::2] + bits[:, 1::2]


def cells(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cell, row of the fingerprint and whether it is compared with all of the cell (else only with those that are)."""
    counts = popcounts(prints).astype(np.int64)
    everyone, powers = np.arange(len(prints)), 3 ** np.arange(BLOCK)
    first, second = counts[:, :BLOCK], counts[:, BLOCK:]
    code, other = first @ powers, second @ powers + 3**BLOCK
    up_row, up = np.nonzero(first < 2)
    down_row, down = np.nonzero(first > 0)
    over_row, over = np.nonzero(second < 2)
    cell = (code, code[up_row] + powers[up], code[down_row] - powers[down], other, other[over_row] + powers[over])
    row = (everyone, up_row, down_row, everyone, over_row)
    own = np.ones(sum(map(len, row)), bool)
    own[len(own) - len(over_row) :] = False
    return np.concatenate(cell), np.concatenate(row), own


def grid(prints: DataFrame) -> DataFrame:
    """cell, own, fp: every fingerprint in the cells it belongs to."""

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            for at in range(0, batch.num_rows, 8192):
                fps = batch.column(0).to_numpy()[at : at + 8192].view(np.uint64)
                cell, row, own = cells(fps)
                yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(own), pa.array(fps[row].view(np.int64))], ["cell", "own", "fp"])

    return prints.select("fp").mapInArrow(batches, "cell long, own boolean, fp long")


def walk(own: np.ndarray, below: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Edges that span the links of ``own`` among themselves and with ``below``: each newly reached one with the one it was reached from."""
    own = np.unique(own)
    below = np.setdiff1d(below, own)
    a, b, queue = [], [], []
    while len(own) or queue:
        if not queue:
            queue.append((own[0], True))
            own = own[1:]
        x, inside = queue.pop()
        near = np.bitwise_count(own ^ x) <= radius
        if near.any():
            a.append(np.full(int(near.sum()), x)), b.append(own[near])
            queue.extend((y, True) for y in own[near])
            own = own[~near]
        if inside:
            near = np.bitwise_count(below ^ x) <= radius
            if near.any():
                a.append(np.full(int(near.sum()), x)), b.append(below[near])
                queue.extend((y, False) for y in below[near])
                below = below[~near]
    empty = np.empty(0, np.uint64)
    return (np.concatenate(a), np.concatenate(b)) if a else (empty, empty)


class Forest:
    """Merges seen by one task: an edge that joins nothing new needn't leave it."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def top(self, x: int) -> int:
        up = self.up
        root = x
        while (p := up.get(root, root)) != root:
            root = p
        while (p := up.get(x, x)) != root:
            up[x], x = root, p
        return root

    def joins(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.zeros(len(a), bool)
        for i, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
            x, y = self.top(x), self.top(y)
            if x != y:
                self.up[max(x, y)] = min(x, y)
                out[i] = True
        return out


def cell_links(starts: np.ndarray, own: np.ndarray, prints: np.ndarray, radius: int = RADIUS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Linked pairs of whole cells, each from one of ``starts`` to the next, the cell's own rows first."""
    ends = np.r_[starts[1:], len(prints)]
    large = ends - starts > SMALL_CELL
    for s, e in zip(starts[large].tolist(), ends[large].tolist(), strict=True):
        yield walk(prints[s:e][own[s:e]], prints[s:e][~own[s:e]], radius)
    last = np.repeat(ends, ends - starts)
    here = np.flatnonzero(own & ~np.repeat(large, ends - starts))
    after = last[here] - here - 1  # of each own row, the rows behind it in its cell
    here, after = here[after > 0], after[after > 0]
    done = np.cumsum(after)
    at = 0
    while at < len(here):
        to = max(at + 1, int(np.searchsorted(done, (done[at - 1] if at else 0) + PAIRS_AT_ONCE, "right")))
        i = np.repeat(here[at:to], after[at:to])
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(after[at:to]) - after[at:to], after[at:to])
        near = np.bitwise_count(prints[i] ^ prints[j]) <= radius
        yield prints[i[near]], prints[j[near]]
        at = to


def links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """a, b: edges that connect all distinct fingerprints (column fp) linked within the radius.

    Cells are dealt out by a hash; a cell of over CELL_ROWS rows is dealt as pairs
    of its blocks, so that a task holds a bounded piece of it and no pair is lost.
    """
    placed = grid(prints)
    many = placed.groupBy("cell").count().where(F.col("count") > CELL_ROWS).select(F.col("cell").alias("__cell"), F.ceil(F.col("count") / (CELL_ROWS // 2)).cast("int").alias("__blocks"))
    many = written(many, "near-cells")
    rows = placed.join(many, F.col("cell") == F.col("__cell"), "left") if many.limit(1).count() else placed.withColumn("__blocks", F.lit(None).cast("int"))
    mine = F.pmod(F.xxhash64("fp"), F.col("__blocks")).cast("int")
    pairs = F.when(F.col("__blocks").isNull(), F.array(F.lit(0).cast("bigint"))).otherwise(F.transform(F.sequence(F.lit(0), F.col("__blocks") - 1), lambda o: F.least(mine, o).cast("bigint") * F.lit(1 << 20) + F.greatest(mine, o)))
    dealt = rows.select("cell", F.explode(pairs).alias("part"), "own", "fp") if many.limit(1).count() else rows.select("cell", F.lit(0).cast("bigint").alias("part"), "own", "fp")

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest()
        kept: list[pa.RecordBatch] = []

        def work(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            cell, part = rows.column("cell").to_numpy(), rows.column("part").to_numpy()
            starts = np.flatnonzero(np.r_[True, (cell[1:] != cell[:-1]) | (part[1:] != part[:-1])])
            for a, b in cell_links(starts, rows.column("own").to_numpy(), rows.column("fp").to_numpy().view(np.uint64), radius):
                new = forest.joins(a, b)
                yield pa.RecordBatch.from_arrays([pa.array(a[new].view(np.int64)), pa.array(b[new].view(np.int64))], ["a", "b"])

        for batch in found:
            if not batch.num_rows:
                continue
            kept.append(batch)
            cell, part = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            same = (cell == cell[-1]) & (part == part[-1])
            if same.all():
                continue  # one cell so far, or the end of one
            cut = batch.num_rows - int(np.argmin(same[::-1]))
            yield from work(pa.Table.from_batches([*kept[:-1], batch.slice(0, cut)]))
            kept = [batch.slice(cut)]
        if kept:
            yield from work(pa.Table.from_batches(kept))

    ordered = dealt.repartition("cell", "part").sortWithinPartitions("cell", "part", F.desc("own"))
    return ordered.mapInArrow(batches, "a long, b long")


def first_row() -> Column:
    """Aggregate: the smallest (doc_id, key) of rows that have an id; null without any."""
    return F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "key")))


def with_first(rows: DataFrame, name: str, classes: DataFrame, node: str, edges: DataFrame) -> DataFrame:
    """rows with ``first``, the smallest (doc_id, key) of their component.

    ``classes`` has one row for each value of ``name``: its ``node`` in the graph
    of ``edges`` (a, b), ``first`` of its rows and their number ``n``. A class
    with very many rows and a component with very many classes keep them where
    they lie.
    """
    total = classes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    linked = components(edges).withColumnRenamed("node", "__node")
    members = written(linked.join(classes.select(node, F.col("first").alias("__first")), F.col("__node") == F.col(node)).select("root", "__node", "__first"), "near-members")
    roots = written(members.groupBy("root").agg(F.min("__first").alias("__least"), F.count(F.lit(1)).alias("n")), "near-roots")
    several = roots.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    joined = hot_left_join(members.select("root", "__node"), roots.select("root", "__least"), "root", hot_keys(roots, "root", "n", several))
    joined = joined.select("__node", "__least", F.lit(True).alias("__linked"))
    least = F.when(F.col("__linked"), F.col("__least")).otherwise(F.col("first"))
    table = classes.join(written(joined, "near-joined"), F.col(node) == F.col("__node"), "left").select(name, least.alias("first"))
    return hot_left_join(rows, written(table, "near-table"), name, hot_keys(classes, name, "n", total))


def same_prints(docs: DataFrame) -> DataFrame:
    """doc_id, key, fp and ``first`` of every row; copies share a fingerprint, only distinct ones are searched."""
    prints = written(fingerprints(docs), "near-prints")
    classes = written(prints.groupBy("fp").agg(first_row().alias("first"), F.count(F.lit(1)).alias("n")), "near-classes")
    return with_first(prints, "fp", classes.withColumn("node_fp", F.col("fp")), "node_fp", links(classes))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for every row of ``docs`` (doc_id, text).

    component_id is the smallest doc_id reachable over links.

    Defined cases: null, empty and blank texts have fingerprint zero and are
    linked like any other; a text of under four words is one shingle; a very
    long text is read whole, its shingles hashed piece by piece; null ids keep
    their rows and count in no component_id (null if a component has no id);
    repeated rows stay; an empty table gives an empty result; other columns are
    left out.
    """
    return same_prints(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("first.doc_id").alias("component_id"))


def deduplicate(docs: DataFrame, find: Callable[[DataFrame], DataFrame] = same_prints) -> DataFrame:
    """The rows of ``docs``, with all their columns, that stand for their component: of each the smallest doc_id.

    ``find`` gives doc_id, key (``text_key``) and ``first`` of every row. Rows are
    told apart by id and text: where an id repeats, a text that copies another
    document goes and a text of its own stays.

    Defined cases: of repeated rows (one id, one text) one stays; rows without an
    id stay, all of them; null and empty texts are copies of each other; columns
    of any name are kept; an empty table gives an empty result. The texts are
    shuffled once, whatever the size.
    """
    mine = F.col("first.doc_id") == F.col("doc_id")
    found = find(docs).where(mine & (F.col("first.key") == F.col("key")))
    kept = written(found.groupBy("doc_id", "key").agg(F.count(F.lit(1)).alias("n")), "near-kept")
    ident, key = unused(docs, "ident"), unused(docs, "key")
    few = kept.select(F.col("doc_id").alias(ident), F.col("key").alias(key), "n")
    match = (F.col("doc_id") == F.col(ident)) & (text_key() == F.col(key))
    once = docs.join(few.where("n = 1").drop("n"), match, "left_semi").unionByName(docs.where("doc_id IS NULL"))
    repeated = few.where("n > 1").drop("n")
    if repeated.limit(1).count():
        copies = docs.join(repeated, match, "left_semi").withColumn(key, text_key())
        once = once.unionByName(copies.dropDuplicates(["doc_id", key]).drop(key))
    return once
