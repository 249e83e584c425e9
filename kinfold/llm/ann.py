"""Operator 1: approximate nearest neighbours by collision counting.

Vectors, scaled to length one, are projected on random lines; each line keeps
its values in a sorted array. A query opens a window round its own value in
every array. Windows grow by virtual rehashing: a wider one walks the same
array on, outward from where the last one ended, and only the rows it newly
takes in are counted. A row that has fallen into enough windows is verified by
exact cosine. A query stops when its k best are nearer than any row its windows
can have missed, or when it has verified its share of ``VERIFIED`` rows; that
number is for the whole table, so the share verified falls as the table grows.

The searched rows are dealt out once into blocks of bounded size, each with its
own arrays; the queries are streamed past every block, and the best of all
blocks are merged by rank.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Lines, and the share of the windows a row must fall into to be verified.
LINES, THRESHOLD = 160, 0.64
#: Half width of the first windows (distances of unit vectors) and the growth of the width.
WIDTH, GROWTH = 0.3, 1.08
#: Rows nearer than half width / SURE fall into enough windows but for a chance below 1 %.
SURE = 1.115
#: Rows a query verifies in all blocks together before it may stop short of certainty.
VERIFIED = 1536
#: Bytes of vectors in a block, and queries compared at once.
BLOCK_BYTES, QUERIES_AT_ONCE = 8 << 20, 256
SEED = 20_011


def lines(dim: int, count: int = LINES) -> np.ndarray:
    return np.random.default_rng([SEED, dim, count]).standard_normal((dim, count)).astype(np.float32)


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Each row times a power of two that brings its largest component to [0.5, 1): squares neither vanish nor overflow."""
    _, exponent = np.frexp(np.abs(vectors).max(axis=1))
    return np.ldexp(vectors, -exponent[:, None])


def lengths(vectors: np.ndarray) -> np.ndarray:
    return np.sqrt((vectors * vectors).sum(axis=1))


class Index:
    """Sorted arrays of one block."""

    def __init__(self, vectors: np.ndarray, count: int = LINES) -> None:
        self.vectors = scaled(vectors)
        self.norms = lengths(self.vectors)
        self.axes = lines(vectors.shape[1], count)
        values = self.project(self.vectors, self.norms).T
        order = np.argsort(values, axis=1, kind="stable")
        self.values = np.ascontiguousarray(np.take_along_axis(values, order, axis=1))
        self.rows = order.astype(np.uint16 if len(vectors) <= 1 << 16 else np.uint32)
        #: Rows counted in windows and rows verified so far, for reports.
        self.counted = self.verified = 0

    def project(self, vectors: np.ndarray, norms: np.ndarray) -> np.ndarray:
        return (vectors / norms[:, None]).astype(np.float32) @ self.axes

    def windows(self, at: np.ndarray, half: float) -> tuple[np.ndarray, np.ndarray]:
        """First place and end of every query's window in every array."""
        low = np.stack([np.searchsorted(v, a, "left") for v, a in zip(self.values, (at - half).T, strict=True)], axis=1)
        high = np.stack([np.searchsorted(v, a, "right") for v, a in zip(self.values, (at + half).T, strict=True)], axis=1)
        return low, high

    def cosines(self, query: np.ndarray, norm: float, rows: np.ndarray) -> np.ndarray:
        """Exact, in double precision; equal vectors get equal values."""
        return (self.vectors[rows] * query).sum(axis=1) / (self.norms[rows] * norm)

    def search(self, queries: np.ndarray, least: int, enough: int, threshold: float = THRESHOLD) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Of each query its place, the rows verified for it and their cosines.

        ``least`` rows must lie within the sure distance, or ``enough`` be verified.
        """
        n = len(self.vectors)
        least, enough = min(n, least), min(n, max(least, enough))
        need = math.ceil(threshold * len(self.values))
        queries = scaled(queries)
        norms = lengths(queries)
        at = self.project(queries, norms)
        count = np.zeros((len(queries), n), np.uint16)
        found: list[list[np.ndarray]] = [[] for _ in queries]
        score: list[list[np.ndarray]] = [[] for _ in queries]
        waiting, half = list(range(len(queries))), WIDTH
        low = self.windows(at, 0.0)[0]
        high = low.copy()  # nothing is counted yet
        while waiting:
            wide_low, wide_high = self.windows(at[waiting], half)
            left = []
            for q, first, end in zip(waiting, wide_low, wide_high, strict=True):
                was_low, was_high = low[q], high[q]
                ring = [self.rows[i, a:b] for i, (a, b) in enumerate(zip(first.tolist(), was_low.tolist(), strict=True)) if a < b]
                ring += [self.rows[i, a:b] for i, (a, b) in enumerate(zip(was_high.tolist(), end.tolist(), strict=True)) if a < b]
                low[q], high[q] = np.minimum(first, was_low), np.maximum(end, was_high)
                if ring:
                    fresh = np.concatenate(ring)
                    self.counted += len(fresh)
                    before = count[q] < need
                    count[q] += np.bincount(fresh, minlength=n).astype(np.uint16)
                    rows = np.flatnonzero(before & (count[q] >= need))
                    self.verified += len(rows)
                    found[q].append(rows)
                    score[q].append(self.cosines(queries[q], norms[q], rows))
                have = sum(map(len, found[q]))
                if have < enough and not self.sure(score[q], least, half):
                    left.append(q)
                    continue
                yield q, np.concatenate(found[q]), np.concatenate(score[q])
                found[q], score[q] = [], []
            waiting, half = left, half * GROWTH

    @staticmethod
    def sure(scores: list[np.ndarray], least: int, half: float) -> bool:
        """Whether the ``least``-th best cosine is that of a distance the windows can hardly have missed."""
        near = 1 - (half / SURE) ** 2 / 2
        return sum(int((s >= near).sum()) for s in scores) >= least


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and vector (doubles) of the rows that take part."""
    cast = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("bigint"), cast.alias("vector"))
    finite = ~F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.where(F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & finite & F.exists("vector", lambda x: x != 0))


def matrix(batch: pa.RecordBatch) -> np.ndarray:
    """The vectors of a batch whose rows have one length."""
    return batch.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


class Best:
    """The k best rows of each query within one block."""

    def __init__(self, k: int, total: int) -> None:
        self.k, self.total = k, total
        self.rows: list[pa.RecordBatch] = []
        self.index: Index | None = None
        self.ids = np.empty(0, np.int64)

    def answer(self, asking: np.ndarray, queries: np.ndarray) -> Iterator[tuple[int, int, float]]:
        if self.index is None:
            table = pa.Table.from_batches(self.rows).combine_chunks().to_batches()[0]
            self.ids, self.index = table.column("vec_id").to_numpy(), Index(matrix(table))
            self.rows = []
        enough = math.ceil(VERIFIED * len(self.ids) / self.total)
        for q, found, score in self.index.search(queries, self.k + 1, enough):
            near, seen = self.ids[found], set()
            for i in np.lexsort((near, -score)).tolist():
                if near[i] != asking[q] and near[i] not in seen:
                    seen.add(near[i])
                    yield int(asking[q]), int(near[i]), float(score[i])
                    if len(seen) == self.k:
                        break


def runs(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of rows of one block and kind, the queries in pieces."""
    key = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("dim", "block", "asks")])
    starts = np.flatnonzero(np.r_[True, (key[:, 1:] != key[:, :-1]).any(axis=0)])
    for a, b in zip(starts.tolist(), [*starts[1:].tolist(), batch.num_rows], strict=True):
        for at in range(a, b, QUERIES_AT_ONCE):
            yield batch.slice(at, min(QUERIES_AT_ONCE, b - at))


def search(queries: DataFrame, vectors: DataFrame, k: int = 5, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found for every query (vec_id, embedding), itself left out.

    Nearness is cosine, in double precision; ties go to the smaller vec_id.

    Defined cases: vectors that are null, zero or hold null or non-finite
    components neither ask nor answer, nor do null ids; very small and very
    large components are scaled by a power of two before squares are formed;
    vectors of different lengths never meet; of query rows with one id the
    largest vector (in array order) asks; a repeated row answers once for each
    id, by its best cosine; a query with fewer than k candidates gets all; empty
    tables give an empty result; other columns are left out.
    """
    mine = usable(queries).groupBy("vec_id").agg(F.max("vector").alias("vector")).withColumn("dim", F.size("vector"))
    rows = usable(vectors).groupBy("vec_id", "vector").agg(F.lit(False).alias("asks")).withColumn("dim", F.size("vector"))
    total, size = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("dim"), F.lit(0))).first()
    blocks = max(1, math.ceil(8 * size / block_bytes))
    columns = ("dim", "block", "asks", "vec_id", "vector")
    # By id and vector, so that rows with one id spread over the blocks.
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("vec_id", "vector"), F.lit(blocks)).cast("int")).select(*columns)
    every: Column = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    asked = mine.withColumn("asks", F.lit(True)).withColumn("block", every).select(*columns)

    def best(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, block = None, Best(k, total)
        for batch in found:
            out: list[tuple[int, int, float]] = []
            for part in runs(batch) if batch.num_rows else ():
                key = (part.column("dim")[0].as_py(), part.column("block")[0].as_py())
                if key != here:
                    here, block = key, Best(k, total)
                if not part.column("asks")[0].as_py():
                    block.rows.append(part)
                elif block.index is not None or block.rows:
                    out += block.answer(part.column("vec_id").to_numpy(), matrix(part))
            ids, near, score = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(near, pa.int64()), pa.array(score, pa.float64())], ["query_id", "vec_id", "score"])

    # A block is a partition: its rows come first, then the queries, a batch at a time.
    ordered = asked.unionByName(dealt).repartitionById(blocks, F.col("block")).sortWithinPartitions("dim", "block", "asks")
    once = ordered.mapInArrow(best, "query_id long, vec_id long, score double").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return once.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def brute(ids: np.ndarray, vectors: np.ndarray, asked: np.ndarray, k: int = 5) -> Iterator[tuple[int, list[int]]]:
    """The k nearest by comparing all, for tests and for measuring recall."""
    unit = vectors / np.sqrt((vectors * vectors).sum(axis=1))[:, None]
    for q in asked:
        score = unit @ unit[q]
        score[q] = -np.inf
        order = np.lexsort((ids, -score))[:k]
        yield int(ids[q]), ids[order].tolist()
