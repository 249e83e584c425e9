"""The ground-truth queries over all order lines against plain Python."""

import hashlib
from collections import defaultdict

import pytest

from kinfold.plans import catalogue
from kinfold.session import table

SF = "/root/testdata/sf0.001"


def name(part):
    return f"S{2 if part % 2 == 0 else 3}-{part}"


@pytest.fixture(scope="module")
def claims(spark):
    return {(r.l_orderkey, name(r.l_partkey)) for r in table(spark, SF, "lineitem").collect()}


@pytest.fixture(scope="module")
def found(spark):
    return lambda query: catalogue.queries()[query](spark, SF).collect()


def test_pairs_and_claims(claims, found):
    assert sorted(map(tuple, found("gt_pairs"))) == sorted(claims)
    owners = defaultdict(set)
    for s1, rec in claims:
        owners[rec].add(s1)
    assert {tuple(r) for r in found("multi_claimed")} == {(rec, len(o)) for rec, o in owners.items() if len(o) > 1}


def test_integrity(claims, found, spark):
    x = [*claims, *(c for c in claims if c[0] % 50 == 0), *((s, "X" + r) for s, r in claims if s % 70 == 1), *((-s, r) for s, r in claims if s % 90 == 2)]
    d, orders = set(x), {r.o_orderkey for r in table(spark, SF, "orders").collect()}
    parts = {name(r.p_partkey) for r in table(spark, SF, "part").collect()}
    want = {"n_pairs": len(x), "bad_prefix": sum(r[0] == "X" for _, r in x), "n_distinct": len(d), "dangling_records": sum(r not in parts for _, r in d), "unknown_s1": sum(s not in orders for s, _ in d), "duplicate_pairs": len(x) - len(d)}
    assert [r.asDict() for r in found("gt_integrity")] == [want]


def test_buckets(claims, found, spark):
    lists = defaultdict(list)
    for s1, rec in claims:
        lists[s1].append(rec)
    want = set()
    for o in table(spark, SF, "orders").collect():
        recs = lists[o.o_orderkey]
        n, s2 = len(recs), sum(r.startswith("S2-") for r in recs)
        bucket = str(n) if n < 3 else "3-5" if n <= 5 else "6+"
        want.add((o.o_orderkey, n, s2, n - s2, int(any(r.endswith("1") for r in recs)), int(n == 0), bucket))
    assert {tuple(r) for r in found("match_buckets")} == want


def test_record_roles_and_sample(claims, found, spark):
    parts = {name(r.p_partkey) for r in table(spark, SF, "part").collect()}
    role = {r.s1_id: r.entity_role for r in found("role_assignment")}
    first = {}
    for s1, rec in claims:
        first[rec] = min(first.get(rec, s1), s1)
    assert {tuple(r) for r in found("record_roles")} == {(r, str(first[r]), role.get(first[r], "POOL")) if r in first else (r, "", "POOL") for r in parts}
    share = {name(r.p_partkey): {"Brand#11": 0.3, "Brand#12": 0.0}.get(r.p_brand, 0.1) for r in table(spark, SF, "part").collect()}
    low = {r for r in parts if int(hashlib.md5(r.encode()).hexdigest()[:8], 16) % 1_000_000 / 1_000_000 < share[r]}
    forced = {rec for s1, rec in claims if s1 % 10 == 0}
    assert sorted(r.rec_id for r in found("stratified_sample")) == sorted(low | (forced & parts))
