"""Operator 3: quality classifier, a generalised additive model with pairwise interactions.

Every feature of a text has a table of scores by bin, and so have some pairs of
features. The tables are learned by cyclic boosting: round after round each
feature in turn gets a shallow tree on the residuals, added to its table. A
text's score adds up the entries of its bins.
"""

from __future__ import annotations

import operator
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FEATURES = ("chars", "words", "word_chars", "upper", "digits", "symbols", "marks", "ends", "repeats", "top_word", "kinds", "same_lines", "bars", "sentence_words", "short_words", "non_ascii", "entropy", "longest_word", "line_words", "capitals")
#: The model is fitted on at most this many labelled rows, taken in order of a hash of their ids.
TRAIN_ROWS = 20_000
BINS, PAIR_BINS, PAIRS, ROUNDS, PAIR_ROUNDS, RATE = 48, 8, 6, 120, 100, 0.15
THRESHOLD = 0.7


def features(text: str | None) -> tuple[float, ...]:
    """FEATURES of a whole text; all zero without words but for the number of characters."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    if not n:
        return (float(np.log1p(len(raw))),) + (0.0,) * (len(FEATURES) - 1)
    byte = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    size = len(raw)
    upper, lower, digits, high = int(byte[65:91].sum()), int(byte[97:123].sum()), int(byte[48:58].sum()), int(byte[128:].sum())
    blanks = int(byte[9:14].sum() + byte[32])
    plain = int(byte[[33, 34, 39, 40, 41, 44, 45, 46, 58, 59, 63]].sum())  # ! " ' ( ) , - . : ; ?
    symbols = size - upper - lower - digits - high - blanks - plain
    kinds = Counter(words)
    lines = raw.split(b"\n")
    shares = byte[byte > 0] / size
    return (
        float(np.log1p(size)),
        float(np.log1p(n)),
        (size - blanks) / n,
        upper / max(1, upper + lower),
        digits / size,
        symbols / size,
        int(byte[33]) / n,
        sum(w[-1] in b"#$%&*!|" for w in words) / n,
        sum(map(operator.eq, words, words[1:])) / n,
        max(kinds.values()) / n,
        len(kinds) / n,
        1 - len(set(lines)) / len(lines),
        int(byte[124]) / n,
        n / (1 + int(byte[46] + byte[33] + byte[63])),
        sum(map((4).__gt__, map(len, words))) / n,
        high / size,
        -float((shares * np.log(shares)).sum()),
        float(np.log1p(max(map(len, words)))),
        n / len(lines),
        sum(map(bytes.istitle, words)) / n,
    )


def feature_table(texts: Iterable[str | None]) -> np.ndarray:
    return np.array([features(t) for t in texts], np.float64).reshape(-1, len(FEATURES))


def cut(gain_g: np.ndarray, gain_h: np.ndarray) -> tuple[float, int]:
    """Best split of bins: gain and the number of bins to its left (0: none)."""
    g, h = np.cumsum(gain_g)[:-1], np.cumsum(gain_h)[:-1]
    total_g, total_h = gain_g.sum(), gain_h.sum()
    if not len(g):
        return 0.0, 0
    gain = g * g / (h + 1) + (total_g - g) ** 2 / (total_h - h + 1) - total_g**2 / (total_h + 1)
    best = int(np.argmax(gain))
    return (float(gain[best]), best + 1) if gain[best] > 0 else (0.0, 0)


def shallow_tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Values by bin of a tree of at most four leaves on one feature."""
    edges = {0, len(g)}
    for _ in range(2):
        at = sorted(edges)
        edges |= {a + c for a, b in zip(at, at[1:], strict=False) if (c := cut(g[a:b], h[a:b])[1])}
    at = sorted(edges)
    out = np.empty(len(g))
    for a, b in zip(at, at[1:], strict=False):
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + 1)
    return out


def pair_tree(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and values by cell of a tree that cuts one axis, then each side across the other; the better order of both."""
    found = []
    for turn in (False, True):
        gg, hh = (g.T, h.T) if turn else (g, h)
        _, c = cut(gg.sum(1), hh.sum(1))
        gain, out = 0.0, np.zeros(gg.shape)
        for side in (slice(0, c), slice(c, None)):
            _, d = cut(gg[side].sum(0), hh[side].sum(0))
            for part in (slice(0, d), slice(d, None)):
                sg, sh = gg[side, part].sum(), hh[side, part].sum()
                out[side, part] = sg / (sh + 1)
                gain += sg * sg / (sh + 1)
        found.append((gain, out.T if turn else out))
    return max(found, key=lambda x: x[0])


@dataclass
class Model:
    intercept: float
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)  # of each bin, its bin in the pairs' tables

    @property
    def fitted(self) -> bool:
        return bool(self.tables)

    def bins(self, rows: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x, "right") for e, x in zip(self.edges, rows.T, strict=True)], axis=1)

    def score(self, rows: np.ndarray) -> np.ndarray:
        """Probability of label 1, by adding the entries of each row's bins."""
        total = np.full(len(rows), self.intercept)
        if self.fitted and len(rows):
            at = self.bins(rows)
            for f, t in enumerate(self.tables):
                total += t[at[:, f]]
            for i, j, t in self.pairs:
                total += t[self.coarse[i][at[:, i]], self.coarse[j][at[:, j]]]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def fit(rows: np.ndarray, labels: np.ndarray) -> Model:
    """Cyclic boosting of the tables. Without both labels only the smoothed share of label 1 is known."""
    share = (labels.sum() + 1) / (len(labels) + 2)
    model = Model(float(np.log(share / (1 - share))))
    if len(np.unique(labels)) < 2:
        return model
    edges = [np.unique(np.quantile(x, np.linspace(0, 1, BINS + 1)[1:-1])) for x in rows.T]
    # A value that many rows share would hide rare ones behind one edge; bins of the rest keep them apart.
    model.edges = [np.unique(np.r_[e, np.nextafter(np.median(x), np.inf), np.quantile(y, np.linspace(0, 1, BINS // 2 + 1)[:-1])]) if len(y := x[x > np.median(x)]) else e for e, x in zip(edges, rows.T, strict=True)]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    at = model.bins(rows)
    held = [np.bincount(x, minlength=len(e) + 1) for x, e in zip(at.T, model.edges, strict=True)]
    model.coarse = [np.minimum(PAIR_BINS - 1, (np.cumsum(h) - h / 2) * PAIR_BINS // len(rows)).astype(int) for h in held]
    total = np.full(len(rows), model.intercept)
    residual = lambda: (labels - (p := 1 / (1 + np.exp(-total))), np.maximum(p * (1 - p), 1e-6))
    for _ in range(ROUNDS):
        for f, t in enumerate(model.tables):
            g, h = residual()
            step = RATE * shallow_tree(np.bincount(at[:, f], g, len(t)), np.bincount(at[:, f], h, len(t)))
            t += step
            total += step[at[:, f]]
    flat = {(i, j): model.coarse[i][at[:, i]] * PAIR_BINS + model.coarse[j][at[:, j]] for i, j in combinations(range(rows.shape[1]), 2)}
    tree = lambda pair, g, h: pair_tree(*(np.bincount(flat[pair], x, PAIR_BINS**2).reshape(PAIR_BINS, PAIR_BINS) for x in (g, h)))
    g, h = residual()
    strongest = sorted(flat, key=lambda p: (-tree(p, g, h)[0], p))[:PAIRS]
    model.pairs = [(*p, np.zeros((PAIR_BINS, PAIR_BINS))) for p in strongest]
    for _ in range(PAIR_ROUNDS):
        for i, j, t in model.pairs:
            step = RATE * tree((i, j), *residual())[1]
            t += step
            total += step.ravel()[flat[i, j]]
    return model


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned from; a null id isn't held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """Fit on at most ``rows`` labelled documents that aren't held out: so many rows, and no more, reach the driver."""
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).select(F.col("doc_id").alias("__id"), "quality")

    def batches(found: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in found:
            table = feature_table(t.as_py() for t in batch.column(2))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(list(table), pa.list_(pa.float64()))], ["doc_id", "quality", "row"])

    joined = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(sample), F.col("doc_id") == F.col("__id"))
    scored = joined.select(F.col("doc_id").cast("bigint"), F.col("quality").cast("bigint"), "text").mapInArrow(batches, "doc_id long, quality long, row array<double>")
    got = scored.groupBy("doc_id", "quality").agg(F.min("row").alias("row")).orderBy("doc_id").toPandas()
    return fit(np.array(got["row"].tolist(), np.float64).reshape(-1, len(FEATURES)), got["quality"].to_numpy(np.float64))


def scorer(model: Model) -> object:
    """A column function: text -> score."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(model.score(feature_table(texts)))

    return score


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs`` (doc_id, text), from ``labels`` (doc_id, quality).

    Defined cases: null, empty and blank texts are scored like any other, by
    features that are zero; a very long text is read whole; labels that are null or of null ids are left out, of
    several labels of an id the largest counts; with fewer than both labels all
    scores are the smoothed share of label 1; repeated rows stay; an empty table
    gives an empty result; other columns are left out.
    """
    score = scorer(train(docs, labels))
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score(F.col("text").cast("string")).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, with all their columns, that score the threshold or more; all if no model can be fitted.

    No rows are moved. Defined cases: as for ``quality_scores``; null and empty
    texts are kept or rejected by their score, repeated rows together; columns of
    any name are kept; an empty table gives an empty result.
    """
    model = train(docs, labels)
    return docs.where(scorer(model)(F.col("text").cast("string")) >= threshold) if model.fitted else docs
