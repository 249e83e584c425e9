"""Queries against blocks of a pool, a batch at a time: for scores that no join key expresses.

Pool rows are dealt out once into blocks of bounded size within their gate.
Every query is sent past the blocks of its gate: a task reads the rows of a
block first and then the queries, in batches, so neither a large gate nor many
queries fill its memory. Only the k best of a query leave a block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Pool rows of a block, and queries answered at once.
BLOCK_ROWS, QUERIES_AT_ONCE = 16_384, 512

#: Given the pool rows of a block, a function that gives for a batch of queries: query row, pool row, score.
Scorer = Callable[[pa.RecordBatch], Callable[[pa.RecordBatch], tuple[np.ndarray, np.ndarray, np.ndarray]]]


def pieces(batch: pa.RecordBatch) -> Iterator[tuple[tuple[int, int, bool], pa.RecordBatch]]:
    """Slices of rows of one gate, block and kind."""
    key = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("__gate", "__block", "__asks")])
    starts = np.flatnonzero(np.r_[True, (key[:, 1:] != key[:, :-1]).any(axis=0)])
    for a, b in zip(starts.tolist(), [*starts[1:].tolist(), batch.num_rows], strict=True):
        for at in range(a, b, QUERIES_AT_ONCE):
            yield (int(key[0, a]), int(key[1, a]), bool(key[2, a])), batch.slice(at, min(QUERIES_AT_ONCE, b - at))


def whole(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.Table.from_batches(rows).combine_chunks().to_batches()[0]


def best_of(queries: DataFrame, pool: DataFrame, ident: str, gate: Column | None, scorer: Callable[[], Scorer], block_rows: int = BLOCK_ROWS) -> DataFrame:
    """asking, found, score: what ``scorer`` keeps of every query against the blocks of its gate.

    queries and pool hold ``ident`` (long) and the columns that the scorer reads,
    of equal names and types; ``gate`` is an expression over both (none: one gate).
    """
    gate = F.lit(0) if gate is None else gate
    key = F.xxhash64(gate).alias("__gate")
    mine, theirs = queries.select(key, "*"), pool.select(key, "*")
    sizes = theirs.groupBy("__gate").agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("__blocks"))
    places = sizes.agg(F.coalesce(F.sum("__blocks"), F.lit(0))).first()[0]
    if not places:
        return queries.sparkSession.createDataFrame([], "asking long, found long, score double")
    names = ["__gate", "__block", "__asks", ident, *(c for c in pool.columns if c != ident)]
    several = sizes.withColumnRenamed("__gate", "__of")
    within = F.col("__gate") == F.col("__of")
    block = F.pmod(F.xxhash64(ident), F.col("__blocks")).cast("int")
    # A gate's number of blocks is known to every row of it; gates are few rows for a join, whatever their size.
    dealt = theirs.join(several, within).withColumns({"__block": block, "__asks": F.lit(False)}).select(*names)
    every = F.explode(F.sequence(F.lit(0), F.col("__blocks") - 1))
    asked = mine.join(several, within).withColumn("__block", every).withColumn("__asks", F.lit(True)).select(*names)

    def answers(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, rows, answer, ids = None, [], None, None
        score = scorer()
        for batch in found:
            for key, part in pieces(batch) if batch.num_rows else ():
                if key[:2] != here:
                    here, rows, answer = key[:2], [], None
                if not key[2]:
                    rows.append(part)
                    continue
                if answer is None and rows:
                    block_of = whole(rows)
                    rows, answer, ids = [], score(block_of), block_of.column(ident).to_numpy()
                if answer is not None:
                    q, r, s = answer(part)
                    yield pa.RecordBatch.from_arrays([pa.array(part.column(ident).to_numpy()[q]), pa.array(ids[r]), pa.array(s, pa.float64())], ["asking", "found", "score"])

    spread = F.pmod(F.xxhash64("__gate", "__block"), F.lit(places)).cast("int")
    ordered = asked.unionByName(dealt).repartitionById(max(1, places), spread).sortWithinPartitions("__gate", "__block", "__asks")
    return ordered.mapInArrow(answers, "asking long, found long, score double")


def largest(scores: np.ndarray, k: int, margin: float) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the entries that reach their row's k-th largest, less a margin for rounding."""
    n = scores.shape[1]
    if n <= k:
        return tuple(np.indices(scores.shape).reshape(2, -1))
    bar = np.partition(scores, n - k, axis=1)[:, n - k]
    return np.nonzero(scores >= (bar - margin)[:, None])
