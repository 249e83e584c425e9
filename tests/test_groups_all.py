"""Groups of all orders over all pairs against a plain union."""

from kinfold.operators import labels
from kinfold.plans import catalogue
from kinfold.session import table
from tests.test_truth_all import SF, name


def groups(orders, pairs):
    up = {o: o for o in orders}

    def top(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    first = {}
    for s1, rec in sorted(pairs):
        x, y = top(s1), top(first.setdefault(rec, s1))
        up[max(x, y)] = min(x, y)
    return {(o, top(o)) for o in orders}


def test_groups_of_all_orders(spark):
    orders = [r.o_orderkey for r in table(spark, SF, "orders").collect()]
    pairs = {(r.l_orderkey, name(r.l_partkey)) for r in table(spark, SF, "lineitem").collect()}
    want = groups(orders, pairs & {(s, r) for s, r in pairs if s in set(orders)})
    got = [tuple(r) for r in catalogue.queries()["entity_groups_cc"](spark, SF).collect()]
    assert len(got) == len(orders) and set(got) == want
    assert any(o % 4 for o, _ in got) and len({g for _, g in want}) > 1


def test_groups_of_chains_and_stars(spark):
    pairs = [(i, f"c{j}") for i in range(60) for j in (i, i + 1)] + [(100 + i, "hot") for i in range(80)] + [(300, "x")]
    orders = [*range(60), *range(100, 180), 300, 301]
    got = labels.entity_groups(spark.createDataFrame([(o,) for o in orders], "s1_id long"), spark.createDataFrame(pairs, "s1_id long, rec_id string"))
    assert {tuple(r) for r in got.collect()} == groups(orders, pairs)
