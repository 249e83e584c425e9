"""Character n-gram search over many copies of few texts, against plain Python."""

import math
import random
from collections import Counter, defaultdict

from kinfold.operators import features, tiles
from tests.test_scoring_all import grams


def brute(asks, holds, k):
    """Lists of (score, id) of every query; the rows of an id count as one bag."""
    bags, queries = defaultdict(Counter), defaultdict(Counter)
    for i, t in holds:
        bags[i] += grams(t or "")
    for i, t in asks:
        queries[i] += grams(t or "")
    df = Counter(g for bag in bags.values() for g in bag)
    idf = {g: math.log((1 + len(holds)) / (1 + n)) + 1 for g, n in df.items()}

    def weights(bag):
        w = {g: n * idf[g] for g, n in bag.items() if g in idf}
        norm = math.sqrt(sum(x * x for x in w.values()))
        return {g: x / norm for g, x in w.items()}

    rows = {i: weights(bag) for i, bag in bags.items()}
    out = {}
    for i, bag in queries.items():
        w = weights(bag)
        score = {j: round(sum(x * r[g] for g, x in w.items() if g in r), 6) for j, r in rows.items() if w.keys() & r.keys()}
        if score:
            out[i] = sorted((-s, j) for j, s in score.items())[:k]
    return out


def test_copies_are_searched_once(spark, monkeypatch):
    rng = random.Random(4)
    texts = ["red bolt", "bolt red", "cold ring ltd", "old plate", "", None, "a", "ring"]  # the first two score alike
    asks = [(i, rng.choice(texts)) for i in range(90)]
    holds = [(1000 - i, rng.choice(texts)) for i in range(120)] + [(5, "ring"), (5, "plate")]
    seen = []
    best_of = tiles.best_of

    def counted(queries, pool, *more):
        seen.append((queries.count(), pool.count()))
        return best_of(queries, pool, *more)

    monkeypatch.setattr(tiles, "best_of", counted)
    make = lambda rows, key: spark.createDataFrame(rows, f"{key} long, t string")
    for k in (1, 3, 40):
        got = defaultdict(list)
        for r in features.ngram_topk(make(asks, "s1_id"), make(holds, "cand_id"), "t", k, digits=6).collect():
            got[r.s1_id].append((r["rank"], -r.score, r.cand_id))
        want = brute(asks, holds, k)
        assert {i: [(s, j) for _, s, j in sorted(x)] for i, x in got.items()} == want
        assert all(sorted(r for r, _, _ in x) == list(range(1, len(x) + 1)) for x in got.values())
    assert all(q <= len(texts) and p <= len(texts) + 1 for q, p in seen)
