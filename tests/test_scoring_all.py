"""The n-gram and pair-feature queries ask for every part: against plain Python."""

import math
import re
from collections import Counter, defaultdict

import pytest

from kinfold.operators import records
from kinfold.plans import catalogue, keys

SF = "/root/testdata/sf0.001"


def grams(text):
    out = Counter()
    for w in filter(None, re.split(r"[^\w]+", text.lower())):
        w = f" {w} "
        out.update({w[i : i + n] for n in (2, 3, 4) for i in range(len(w) - n + 1)} | {w for n in (2, 3, 4) if len(w) < n})
    return out


def test_every_name_asks(spark):
    names = keys.names(spark, SF).collect()
    pool = {}
    for r in names:
        pool[r.name] = min(pool.get(r.name, r.id), r.id)
    bags = {i: grams(name) for name, i in pool.items()}
    df = Counter(g for bag in bags.values() for g in bag)
    idf = {g: math.log((1 + len(bags)) / (1 + n)) + 1 for g, n in df.items()}

    def weights(bag):
        w = {g: n * idf[g] for g, n in bag.items() if g in idf}
        norm = math.sqrt(sum(x * x for x in w.values()))
        return {g: x / norm for g, x in w.items()}

    rows = {i: weights(bag) for i, bag in bags.items()}
    found = defaultdict(list)
    for r in catalogue.queries()["char_ngram_topk"](spark, SF).collect():
        found[r.s1_id].append(r)
    assert set(found) == {r.id for r in names} and len(names) == 200
    for r in names:
        w = weights(grams(f"{r.name} {r.country}"))
        score = {i: sum(x * row[g] for g, x in w.items() if g in row) for i, row in rows.items()}
        got = sorted(found[r.id], key=lambda x: x.rank)
        assert [x.rank for x in got] == [1, 2, 3, 4, 5] == list(range(1, len({x.cand_id for x in got}) + 1))
        assert [x.score for x in got] == pytest.approx(sorted(score.values(), reverse=True)[:5], abs=2e-6)
        assert all(x.score == pytest.approx(score[x.cand_id], abs=2e-6) for x in got)
        assert all(x.score > y.score or x.cand_id < y.cand_id for x, y in zip(got, got[1:], strict=False))


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_every_record_is_compared(spark):
    ready = {int(r.entity_id[3:]): r for r in records.prepare(keys.raw_records(spark, SF)).collect()}
    got = {(r.s1_id, r.cand_id): r for r in catalogue.queries()["pair_features"](spark, SF).collect()}
    assert set(got) == {(i, i + k) for i in ready for k in (1, 2, 3, 4) if i + k in ready} and len(got) == 4 * 200 - 10
    words = {i: (set(re.findall(r"\w+", r.name_latin)), set(re.findall(r"\w+", r.addr_latin))) for i, r in ready.items()}
    idf = [{t: math.log(201 / (1 + n)) + 1 for t, n in Counter(t for w in words.values() for t in w[k]).items()} for k in (0, 1)]
    for (i, j), r in got.items():
        a, b = ready[i], ready[j]
        assert r.rank == j - i and r.country == b.country_norm
        assert r.name_latin_lev == pytest.approx(1 - edits(a.name_latin, b.name_latin) / max(len(a.name_latin), len(b.name_latin)))
        assert r.name_core_eq == int(a.name_core == b.name_core != "") and r.name_ntok_absdiff == abs(a.name_n_tokens - b.name_n_tokens)
        for k, found in enumerate((r.addr_idf_jaccard, r.name_idf_jaccard)[::-1]):
            x, y = words[i][k], words[j][k]
            assert found == pytest.approx(sum(idf[k][t] for t in x & y) / sum(idf[k][t] for t in x | y))
        p, q = a.postal_code, b.postal_code
        state = (0 if p == q else 1) if "" in (p, q) else 2 if p == q else 3 if edits(p, q) == 1 else 4
        assert r.postal_state == state
