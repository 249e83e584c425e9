"""Operator 8 and the components against brute force."""

import random

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from kinfold.llm import near_copies, near_dups
from kinfold.llm.common import components


def plain_print(text):
    """The contract, word for word, without numpy."""
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in "".join("\0" if c in " \t\n\x0b\x0c\r" else c for c in lower).split("\0") if w]
    shingles = [words[i : i + 4] for i in range(len(words) - 3)] if len(words) >= 4 else [words] * bool(words)
    h = [xxhash.xxh64_intdigest(" ".join(s).encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@given(st.text(alphabet="aBé \t\n\x0b\x1c z", max_size=60))
@settings(deadline=None, max_examples=80)
def test_fingerprint(text):
    assert int(near_dups.fingerprint(text)) == plain_print(text)


def test_fingerprint_of_long_and_none():
    words = " ".join(f"w{i % 977}" for i in range(70_000))
    assert int(near_dups.fingerprint(words)) == plain_print(words)
    assert near_dups.fingerprint(None) == near_dups.fingerprint(" \n") == 0


def roots(prints, radius=4):
    up = list(range(len(prints)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                up[max(top(i), top(j))] = min(top(i), top(j))
    return [top(i) for i in range(len(prints))]


def flips(rng, x, n):
    for b in rng.sample(range(64), n):
        x ^= 1 << b
    return x


def test_every_link_shares_a_cell():
    rng = random.Random(5)
    for _ in range(400):
        a = rng.getrandbits(64)
        b = flips(rng, a, rng.randint(0, 4))
        cell, row, own = near_dups.cells(np.array([a, b], np.uint64))
        of = [{(c, o) for c, r, o in zip(cell, row, own, strict=True) if r == k} for k in (0, 1)]
        assert any((c, True) in of[1 - k] for k in (0, 1) for c, _ in of[k])


def test_few_pairs_share_a_cell():
    """A fingerprint is compared with a share of the others that doesn't grow with their number."""
    rng = np.random.default_rng(3)
    shares = []
    for n in (2000, 8000):
        cell, _, own = near_dups.cells(rng.integers(0, 1 << 63, n, np.uint64) * np.uint64(2) + rng.integers(0, 2, n, np.uint64))
        _, at = np.unique(cell, return_inverse=True)
        mine, all_ = np.bincount(at, own), np.bincount(at)
        shares.append((mine * (mine - 1) / 2 + mine * (all_ - mine)).sum() / (n * (n - 1) / 2))
    assert all(s < 1e-4 for s in shares)


def test_links_connect_as_brute_force(spark, monkeypatch):
    rng = random.Random(3)
    prints = [rng.getrandbits(64) for _ in range(150)]
    centre = rng.getrandbits(64)
    prints += [flips(rng, p, rng.randint(1, 5)) for p in prints[:60]] + [flips(rng, centre, rng.randint(0, 3)) for _ in range(300)]
    prints = sorted(set(prints))
    want = roots(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame([(s,) for s in signed], "fp long")
    for size in (near_dups.CELL_ROWS, 64):  # whole cells, and cells split into pairs of blocks
        monkeypatch.setattr(near_dups, "CELL_ROWS", size)
        edges = near_dups.links(df).collect()
        place = {s: i for i, s in enumerate(signed)}
        up = list(range(len(prints)))
        for a, b in edges:
            assert ((a ^ b) & (2**64 - 1)).bit_count() <= 4
        for _ in range(len(prints)):
            moved = False
            for a, b in edges:
                i, j = place[a], place[b]
                low = min(up[i], up[j])
                moved |= up[i] != low or up[j] != low
                up[i] = up[j] = low
            if not moved:
                break
        assert up == want


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 8), (8, 7), (7, 7), (3, 2), (20, 10), (10, 30), (30, 5)] + [(100 + i, 101 + i) for i in range(40)] + [(1000, 1001 + i) for i in range(300)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[x] for x in (1, 2, 3)} == {1} and {got[x] for x in (7, 8, 9)} == {7} and {got[x] for x in (5, 10, 20, 30)} == {5}
    assert {got[100 + i] for i in range(41)} == {100} and {got[1000 + i] for i in range(301)} == {1000}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_duplicates_and_dedup(spark):
    rng = random.Random(1)
    base = [" ".join(f"w{rng.randrange(5000)}" for _ in range(400)) for _ in range(6)]
    rows = [(i * 10, t) for i, t in enumerate(base)] + [(5, base[0].upper()), (7, base[1] + " tail"), (7, base[1] + " tail"), (None, base[2]), (None, "only here"), (61, None), (62, ""), (63, " \t")] + [(70 + i, base[3]) for i in range(40)]
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, fp string, root int")
    got = near_dups.near_duplicates(df).collect()
    assert sorted(r.fingerprint for r in got) == sorted(f"{plain_print(t):016x}" for _, t in rows)
    prints = [plain_print(t) for _, t in rows]
    want = roots(prints)
    least = {}
    for (d, _), r in zip(rows, want, strict=True):
        if d is not None:
            least[r] = min(least.get(r, d), d)
    key = lambda x: tuple(-1 if y is None else y for y in x)
    assert sorted(((r.doc_id, r.component_id) for r in got), key=key) == sorted(((d, least.get(r)) for (d, _), r in zip(rows, want, strict=True)), key=key)
    kept = near_dups.deduplicate(df).collect()
    ids = [r.doc_id for r in kept if r.doc_id is not None]
    assert sorted(ids) == sorted(set(least.values())) and sum(r.doc_id is None for r in kept) == 2
    assert set(kept[0].asDict()) == {"doc_id", "text", "fp", "root"}


def test_dedup_tells_rows_of_one_id_apart(spark):
    rng = random.Random(11)
    a, b, c, d = (" ".join(f"w{rng.randrange(5000)}" for _ in range(60)) for _ in range(4))
    rows = [(3, a), (7, a), (7, b), (8, c), (8, d), (8, d), (9, d)]
    for find in (near_dups.same_prints, near_copies.same_texts):
        df = spark.createDataFrame([(i, t, k, "y", 0) for k, (i, t) in enumerate(rows)], "doc_id long, text string, __ident int, __key string, n int")
        kept = near_dups.deduplicate(df, find)
        assert kept.columns == df.columns
        assert sorted((r.doc_id, r.text) for r in kept.collect()) == sorted([(3, a), (7, b), (8, c), (8, d)])


def test_giant_component(spark):
    """One component with most fingerprints: its members are joined with their root in place."""
    rng = random.Random(12)
    base = " ".join(f"w{rng.randrange(900)}" for _ in range(800)).split()
    rows = []
    for i in range(600):
        words = base.copy()
        words[i] = f"x{i}"
        rows.append((i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = roots([plain_print(t) for _, t in rows])
    assert {r.doc_id: r.component_id for r in near_dups.near_duplicates(df).collect()} == dict(enumerate(want))


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert near_dups.near_duplicates(df).count() == 0 and near_dups.deduplicate(df).count() == 0
