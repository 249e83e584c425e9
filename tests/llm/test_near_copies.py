"""Near copies by five-word shingles against brute force."""

import random

import numpy as np

from kinfold.llm import near_copies, near_dups


def shingles(text):
    words = (text or "").encode().translate(near_dups.LOWER).split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def copy_roots(texts):
    sets = [shingles(t) for t in texts]
    up = list(range(len(sets)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or 5 * len(a & b) >= 4 * len(a | b) > 0:
                up[max(top(i), top(j))] = min(top(i), top(j))
    return [top(i) for i in range(len(sets))]


def changed(rng, text, n):
    words = text.split()
    at = rng.randrange(len(words) - n)
    return " ".join([*words[:at], *(f"n{rng.randrange(10**9)}" for _ in range(n)), *words[at + n :]])


def made(rng):
    base = [" ".join(f"w{rng.randrange(3000)}" for _ in range(rng.choice((8, 60, 300)))) for _ in range(25)]
    near = [changed(rng, t, max(1, len(t.split()) // d)) for t in base for d in (9, 12, 16, 30)]
    chain = [base[2]]
    for _ in range(12):
        chain.append(changed(rng, chain[-1], max(1, len(base[2].split()) // 14)))
    return [*base, *near, *chain, "one two", "ONE  two", "", " \t", base[0].upper()]


def test_near_copies_equal_brute_force(spark, monkeypatch):
    texts = made(random.Random(8))
    want = copy_roots(texts)
    assert len(set(want)) < len({t.lower() for t in texts}) and len(set(want)) > 10
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, at int")
    for size in (near_copies.GROUP_ROWS, 6):  # whole neighbourhoods, and pairs of their blocks
        monkeypatch.setattr(near_copies, "GROUP_ROWS", size)
        assert {r.doc_id: r.component_id for r in near_copies.near_copies(df).collect()} == dict(enumerate(want))


def test_one_large_group(spark, monkeypatch):
    """A third of the rows are near copies of one text, not all of each other; no task gets them all."""
    monkeypatch.setattr(near_copies, "GROUP_ROWS", 40)
    rng = random.Random(6)
    base = " ".join(f"w{rng.randrange(3000)}" for _ in range(220))
    texts = [changed(rng, changed(rng, base, 6), 6) for _ in range(150)]  # about 0.82 to the base, 0.68 to each other
    texts.append(base)
    far = " ".join([*base.split()[:150], *(f"v{i}" for i in range(70))])  # shares bands with some, linked to its own copies alone
    texts += [changed(rng, far, 1) for _ in range(12)]
    texts += [" ".join(f"u{rng.randrange(10**6)}" for _ in range(50)) for _ in range(150)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = copy_roots(texts)
    assert {r.doc_id: r.component_id for r in near_copies.near_copies(df).collect()} == dict(enumerate(want))
    assert max(want.count(r) for r in set(want)) > 100


def test_links_of_sets():
    a = np.arange(90)
    sets = [a, a[:72], a[:71], np.arange(1000, 1010), a[10:]]  # 0.8, just under (linked over the second), apart, 0.89
    got = near_copies.set_links(sets)
    reached = {0} | {y for y in got[1]}
    assert reached == {0, 1, 2, 4} and len(got[0]) == 3


def test_defined_cases(spark):
    rng = random.Random(2)
    text = " ".join(f"w{rng.randrange(5000)}" for _ in range(200))
    df = spark.createDataFrame([(9, text), (4, changed(rng, text, 15)), (None, text), (6, None), (5, ""), (4, changed(rng, text, 1))], "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id) for r in near_copies.near_copies(df).collect()), key=str)
    assert got == sorted([(9, 4), (4, 4), (None, 4), (6, 5), (5, 5), (4, 4)], key=str)
    assert near_copies.near_copies(df.limit(0)).count() == 0


def test_fingerprint_grid_makes_neighbourhoods(spark):
    """Without a shared band, rows within four bits meet over operator 8's grid; the exact similarity decides."""
    sets = [list(range(90)), list(range(85)), list(range(40)), list(range(500, 520)), list(range(500, 521)), list(range(900, 950)), []]
    prints = [0, 0b1111, 0b11, -1, -1, 1 << 40, None]  # two of four bits and one of equal ones are links; 0.44 and far bits are none
    rows = [(10 * i, fp, s) for i, (fp, s) in enumerate(zip(prints, sets, strict=True))]
    reps = spark.createDataFrame(rows, "at long, fp long, shingles array<long>")
    none = spark.createDataFrame([], "at long, band long")
    buckets = spark.createDataFrame([], "band long, least long, n long")
    found = near_copies.links_within(reps.select("at", "shingles"), near_copies.prints_linked(reps), none, buckets, buckets.select("band"))
    assert {(min(r.a, r.b), max(r.a, r.b)) for r in found.collect()} == {(0, 10), (30, 40)}


def test_sketches_hold_the_fingerprint_of_the_set(spark):
    text = "a b c d e f g a b c d e"
    df = spark.createDataFrame([(1, text), (2, ""), (3, None)], "doc_id long, text string")
    got = {r.doc_id: r.fp for r in near_copies.sketches(df).collect()}
    distinct = np.unique(near_dups.shingle_hashes(text, 5))
    bits = sum(1 << i for i in range(64) if 2 * sum(int(h) >> i & 1 for h in distinct) > len(distinct))
    assert got == {1: bits - (1 << 64 if bits >> 63 else 0), 2: None, 3: None}
