"""Operator 4: benchmark decontamination by SimHash of item-sized windows.

For an item of n words every window of n words of a document is a candidate; a
document of fewer words is one window. Windows that share no shingle with an
item have similarity 0 and are passed over; the others get a SimHash of their
shingles. A multi-index over four blocks of 64 bits finds every item of that
size within the radius of a window (a pair within it must agree to radius // 4
bits on one block at least; of random pairs 4 in 1,000 do), and each pair found
is verified by the exact similarity of the weighted shingles.

A shingle that occurs k times counts as k different ones, numbered, so that the
similarity of bags is that of sets and the radius holds for repeats as well.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHINGLE, SIMILARITY = 5, 0.8
#: Similarity 0.8 leaves about 52 of 256 bits different (deviation 6.5); unrelated texts differ in 128 (8).
BITS, RADIUS, BLOCKS = 256, 78, 4
#: Characters of items whose index is sent to the tasks at once; larger benchmarks take several passes.
CHARS_AT_ONCE = 4 << 20
WORDS = re.compile(r"\w+")


def words_of(text: str | None) -> list[str]:
    return WORDS.findall((text or "").lower())


def shingle_bits(words: list[str], n: int, numbers: Iterable[int] | None = None) -> np.ndarray:
    """256 hash bits for each n-word shingle, of its occurrence by number (0: the first)."""
    joined = (" ".join(words[i : i + n]).encode("utf-8", "surrogatepass") for i in range(len(words) - n + 1))
    salted = joined if numbers is None else (j + b" \0%d" % k if k else j for j, k in zip(joined, numbers, strict=True))
    raw = b"".join(hashlib.blake2b(j, digest_size=BITS // 8).digest() for j in salted)
    return np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, BITS // 8), axis=1)


def occurrences(shingles: list[tuple[str, ...]]) -> list[int]:
    """Of each shingle, how many equal ones stand before it."""
    seen: Counter[tuple[str, ...]] = Counter()
    out = []
    for s in shingles:
        out.append(seen[s])
        seen[s] += 1
    return out


def similarity(a: Counter, b: Counter) -> float:
    """Of two bags of shingles weighted by their counts: twice the common weight over the sum of weights."""
    common = sum(min(c, b[s]) for s, c in a.items() if s in b)
    return 2 * common / (a.total() + b.total())


class HammingIndex:
    """Fingerprints of one window size, found by blocks of 64 bits."""

    def __init__(self, prints: np.ndarray, radius: int = RADIUS) -> None:
        self.prints, self.radius = prints.view(np.uint64), radius
        self.blocks = np.ascontiguousarray(self.prints.T)

    def within(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of ``prints`` and of the index that differ in at most ``radius`` bits."""
        mine = prints.view(np.uint64)
        near = np.zeros((len(mine), len(self.prints)), bool)
        for own, items in zip(mine.T, self.blocks, strict=True):
            near |= np.bitwise_count(own[:, None] ^ items[None, :]) <= self.radius // BLOCKS
        row, item = np.nonzero(near)
        exact = np.bitwise_count(mine[row] ^ self.prints[item]).sum(axis=1) <= self.radius
        return row[exact], item[exact]


class Benchmark:
    """Items, their shingles and fingerprints, by window size."""

    def __init__(self, items: Iterable[tuple[int | None, str | None]]) -> None:
        self.word: dict[str, int] = {}
        self.sizes: dict[int, list[tuple[int | None, Counter]]] = defaultdict(list)
        prints: dict[int, list[np.ndarray]] = defaultdict(list)
        self.owners: dict[int, dict[int, set[int]]] = defaultdict(lambda: defaultdict(set))  # shingle length -> key -> sizes of its items
        for item_id, text in items:
            words = words_of(text)
            if not words:
                continue
            n, size = min(SHINGLE, len(words)), len(words)
            ids = np.array([self.word.setdefault(w, len(self.word) + 1) for w in words], np.uint64)
            self.sizes[size].append((item_id, Counter(self.shingles(ids, n))))
            prints[size].append(self.window_print(words, n))
            for k in self.keys(ids, n).tolist():
                self.owners[n][k].add(size)
        self.index = {size: HammingIndex(np.stack(p)) for size, p in prints.items()}
        self.known = {n: np.array(sorted(o), np.uint64) for n, o in self.owners.items()}

    @staticmethod
    def keys(ids: np.ndarray, n: int) -> np.ndarray:
        """A hash for each shingle of word numbers; 0 where a word is in no item. Finds places to look at, decides nothing."""
        out = np.zeros(max(0, len(ids) - n + 1), np.uint64)
        if len(out):
            whole = np.ones(len(out), bool)
            for i in range(n):
                part = ids[i : i + len(out)]
                out = (out ^ part) * np.uint64(0x9E3779B97F4A7C15)
                out ^= out >> np.uint64(29)
                whole &= part > 0
            out[~whole] = 0
        return out

    @staticmethod
    def shingles(ids: np.ndarray, n: int) -> list[bytes]:
        """The shingles of word numbers themselves. A word of no item is 0; what holds one equals no item's shingle."""
        raw = ids.tobytes()
        return [raw[8 * i : 8 * (i + n)] for i in range(len(ids) - n + 1)]

    @staticmethod
    def prints(bits: np.ndarray, count: int) -> np.ndarray:
        """Fingerprint bytes of every run of ``count`` shingles: the majority of each bit."""
        sums = np.zeros((len(bits) + 1, BITS), np.int32)
        np.cumsum(bits, axis=0, out=sums[1:])
        return np.packbits(2 * (sums[count:] - sums[:-count]) > count, axis=1)

    def window_print(self, words: list[str], n: int) -> np.ndarray:
        """Fingerprint of one window, its repeated shingles numbered."""
        bits = shingle_bits(words, n, occurrences([tuple(words[i : i + n]) for i in range(len(words) - n + 1)]))
        return self.prints(bits, len(bits))[0]

    def matches(self, text: str | None) -> list[tuple[int | None, float, int, int]]:
        """item_id, similarity, first word and number of words of the best window (the first, of equals) of each item found."""
        words = words_of(text)
        ids = np.fromiter((self.word.get(w, 0) for w in words), np.uint64, len(words))
        best: dict[tuple[int, int], tuple[float, int]] = {}
        for n, known in self.known.items():
            keys = self.keys(ids, n)
            place = np.searchsorted(known, keys)
            hits = np.flatnonzero((known[np.minimum(place, len(known) - 1)] == keys) & (keys > 0))
            starts: dict[int, list[int]] = defaultdict(list)
            for h in hits.tolist():
                for size in self.owners[n][int(keys[h])]:
                    starts[size].append(h)
            for size, at in starts.items():
                if size > len(words):
                    self.verify(ids, n, size, 0, self.window_print(words, n)[None], best)
                else:
                    self.windows(words, ids, n, size, np.array(at), best)
        return [(self.sizes[size][i][0], sim, start, min(size, len(words))) for (size, i), (sim, start) in sorted(best.items())]

    def verify(self, ids: np.ndarray, n: int, size: int, first: int, prints: np.ndarray, best: dict) -> None:
        """Look up the windows from ``first`` on and compare those found exactly."""
        rows, items = self.index[size].within(prints)
        for r, i in zip(rows.tolist(), items.tolist(), strict=True):
            bag = Counter(self.shingles(ids[first + r : first + r + size], n))
            sim = similarity(self.sizes[size][i][1], bag)
            if sim >= SIMILARITY and sim > best.get((size, i), (0.0, 0))[0]:
                best[size, i] = (sim, first + r)

    def windows(self, words: list[str], ids: np.ndarray, n: int, size: int, hits: np.ndarray, best: dict) -> None:
        """Fingerprint and look up every window of ``size`` words that holds one of ``hits``."""
        count, last = size - n + 1, len(words) - size
        begin, end = np.maximum(hits - count + 1, 0), np.minimum(hits, last) + 1
        runs: list[list[int]] = []
        for a, b in zip(begin.tolist(), end.tolist(), strict=True):
            if runs and a <= runs[-1][1]:
                runs[-1][1] = max(runs[-1][1], b)
            elif a < b:
                runs.append([a, b])
        for a, b in ((x, min(x + 4096, hi)) for lo, hi in runs for x in range(lo, hi, 4096)):
            part = words[a : b + size - 1]
            prints = self.prints(shingle_bits(part, n), count)
            for r in self.repeating([tuple(part[i : i + n]) for i in range(len(part) - n + 1)], count):
                prints[r] = self.window_print(part[r : r + size], n)
            self.verify(ids, n, size, a, prints, best)

    @staticmethod
    def repeating(shingles: list[tuple[str, ...]], count: int) -> list[int]:
        """Starts of the runs of ``count`` shingles that hold one twice."""
        last: dict[tuple[str, ...], int] = {}
        out, latest = [], -1  # of the pairs of equal neighbours that end so far, the latest first one
        for i, s in enumerate(shingles):
            latest = max(latest, last.get(s, -1))
            last[s] = i
            if i >= count - 1 and latest >= i - count + 1:
                out.append(i - count + 1)
        return out


def benchmarks(items: DataFrame, at_once: int = CHARS_AT_ONCE) -> Iterator[Benchmark]:
    """The items in blocks of about ``at_once`` characters, which bounds what a pass sends to the tasks."""
    rows = items.select("item_id", F.col("text").cast("string").alias("text"))
    size = rows.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    parts = max(1, math.ceil(size / at_once))
    for part in range(parts):
        here = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part)
        yield Benchmark((r.item_id, r.text) for r in here.orderBy("item_id", "text").collect())


def contamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id, similarity, word_start, words for each document (doc_id, text) and item (item_id, text) found in it.

    Words are runs of word characters in lower case; an item of fewer than five
    words is one shingle.

    Defined cases: null and empty texts and items match nothing; a document
    shorter than an item is compared whole; a very long text is searched whole,
    4,096 windows at a time; repeated documents and items are each reported; null
    ids are reported as null; of equal windows the first counts; empty tables give
    an empty result; other columns are left out.
    """
    rows = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    out = None
    for bench in benchmarks(items):

        def batches(found: Iterator[pa.RecordBatch], bench: Benchmark = bench) -> Iterator[pa.RecordBatch]:
            for batch in found:
                got = [(d.as_py(), *m) for d, t in zip(*batch.columns, strict=True) for m in bench.matches(t.as_py())]
                doc_id, item_id, sim, start, size = zip(*got, strict=True) if got else ([],) * 5
                yield pa.RecordBatch.from_arrays([pa.array(doc_id, pa.int64()), pa.array(item_id, pa.int64()), pa.array(sim, pa.float64()), pa.array(start, pa.int64()), pa.array(size, pa.int64())], ["doc_id", "item_id", "similarity", "word_start", "words"])

        part = rows.mapInArrow(batches, "doc_id long, item_id long, similarity double, word_start long, words long")
        out = part if out is None else out.unionByName(part)
    return out


def detector(bench: Benchmark) -> object:
    """A column function: text -> whether an item is found in it."""

    @F.pandas_udf("boolean")
    def found(texts: pd.Series) -> pd.Series:
        return pd.Series([bool(bench.matches(t)) for t in texts], dtype=bool)

    return found


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` in which no item is found, with all their columns; no rows are moved.

    Defined cases: as for ``contamination``; rows with null or empty texts and
    repeated rows stay; columns of any name are kept; empty tables give no rows,
    or all.
    """
    for bench in benchmarks(items):
        docs = docs.where(~detector(bench)(F.col("text").cast("string")))
    return docs
