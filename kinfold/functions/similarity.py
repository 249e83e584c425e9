"""String similarity in [0, 1]. Edit distance runs in the JVM; the other scorers share one Arrow UDF.

Scorers are null where a side is empty. Only the scorers asked for are computed.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def lcs_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, a row of bits at a time."""
    if not a or not b:
        return 0
    places: dict[str, int] = {}
    for i, ch in enumerate(a):
        places[ch] = places.get(ch, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for ch in b:
        hit = row & places.get(ch, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    """Twice the longest common subsequence over both lengths."""
    return 2 * lcs_length(a, b) / (len(a) + len(b)) if a or b else 1.0


def token_sort(a: str, b: str) -> float:
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set(a: str, b: str) -> float:
    """1 if one side's words all occur in the other (and there are any); else the best of the common part with the rests."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    common = " ".join(sorted(x & y))
    if common and (x <= y or y <= x):
        return 1.0
    left = " ".join(filter(None, (common, " ".join(sorted(x - y)))))
    right = " ".join(filter(None, (common, " ".join(sorted(y - x)))))
    return max(ratio(left, right), *((ratio(common, left), ratio(common, right)) if common else ()), 0.0)


def jaro_winkler(a: str, b: str) -> float:
    """Jaro with a bonus for up to four common first letters where Jaro exceeds 0.7."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    free = [True] * len(b)
    first: list[str] = []
    for i, ch in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if free[j] and b[j] == ch:
                free[j] = False
                first.append(ch)
                break
    if not first:
        return 0.0
    second = [ch for ch, f in zip(b, free, strict=True) if not f]
    m, t = len(first), sum(x != y for x, y in zip(first, second, strict=True)) // 2
    jaro = (m / len(a) + m / len(b) + (m - t) / m) / 3
    prefix = next((i for i, (x, y) in enumerate(zip(a[:4], b[:4], strict=False)) if x != y), min(4, len(a), len(b)))
    return jaro + prefix * 0.1 * (1 - jaro) if jaro > 0.7 else jaro


def partial(a: str, b: str) -> float:
    """Best ratio of the shorter string with a window of its length in the longer, windows that stick out at the ends included; of equal lengths, either way round."""
    short, long = sorted((a, b), key=len)
    n = len(short)
    sides = [(short, long), (long, short)] if len(a) == len(b) else [(short, long)]
    return max((ratio(x, y[max(0, i) : i + n]) for x, y in sides for i in range(1 - n, len(y))), default=0.0)


#: Scorers of two non-empty strings by name.
SCORERS = {"ratio": ratio, "tset": token_set, "tsort": token_sort, "jw": jaro_winkler, "partial": partial}


def scored(kinds: Sequence[Sequence[str]]) -> object:
    """An Arrow function of pairs of string columns: for each pair a struct of the scores named for it.

    Strings that repeat within a batch are scored once.
    """
    fields = [T.StructType([T.StructField(n, T.DoubleType()) for n in names]) for names in kinds]

    def one(known: dict, names: Sequence[str], a: str | None, b: str | None) -> dict[str, float | None]:
        if not a or not b:
            return dict.fromkeys(names)
        out = {}
        for n in names:
            if (n, a, b) not in known:
                known[n, a, b] = SCORERS[n](a, b)
            out[n] = known[n, a, b]
        return out

    @F.pandas_udf(T.StructType([T.StructField(f"s{i}", f) for i, f in enumerate(fields)]))
    def score(*sides: pd.Series) -> pd.DataFrame:
        known: dict = {}
        out = {}
        for i, names in enumerate(kinds):
            found = [one(known, names, a, b) for a, b in zip(sides[2 * i], sides[2 * i + 1], strict=True)]
            out[f"s{i}"] = pd.Series(found, dtype=object)
        return pd.DataFrame(out)

    return score


def lev(a: Column, b: Column) -> Column:
    """1 - edit distance over the longer length."""
    return F.when((a != "") & (b != ""), 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b)))


def score_pairs(df: DataFrame, pairs: Sequence[tuple[str, str, str]], names: Sequence[str] | Sequence[Sequence[str]] = tuple(SCORERS)) -> DataFrame:
    """df with a struct of scores (``names``, or one list of names for each pair; and lev) for each (left, right, name).

    One Arrow call scores all pairs of a batch where it lies: no row moves, so
    pairs of strings that repeat, or are empty, meet in no task.
    """
    kinds = [tuple(names)] * len(pairs) if isinstance(names[0], str) else [tuple(n) for n in names]
    sides = [F.col(c) for a, b, _ in pairs for c in (a, b)]
    df = df.withColumn("__s", scored(kinds)(*sides))
    out = {name: F.col("__s")[f"s{i}"].withField("lev", lev(F.col(a), F.col(b))) for i, (a, b, name) in enumerate(pairs)}
    return df.withColumns(out).drop("__s")
