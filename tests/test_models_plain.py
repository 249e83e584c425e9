"""Scorers of pairs and strings against plain Python, and the settings of the search."""

import math
from collections import defaultdict

import pytest

from kinfold.operators import models
from kinfold.plans import catalogue, decisions, scoring

SF = "/root/testdata/sf0.001"


def query(spark, name):
    return catalogue.queries()[name](spark, SF).collect()


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def ratio(a, b):
    return 2 * lcs(a, b) / (len(a) + len(b))


def token_set(a, b):
    x, y = set(a.split()), set(b.split())
    common = " ".join(sorted(x & y))
    if common and (x <= y or y <= x):
        return 1.0
    sides = [" ".join([*sorted(x & y), *sorted(s - t)]) for s, t in ((x, y), (y, x))]
    return max(ratio(*sides), *((ratio(common, s) for s in sides) if common else (0.0,)))


def partial(a, b):
    short, long = sorted((a, b), key=len)
    pad = "\0" * len(short)
    tries = [(short, long)] + [(long, short)] * (len(a) == len(b))
    return max(ratio(x, w) for x, y in tries for i in range(len(y) + len(pad)) if (w := (pad + y + pad)[i : i + len(x)].strip("\0")))


def test_string_scores(spark):
    pairs = {(r.id, r.id2): (r.a, r.b) for r in scoring.name_pairs(spark, SF).collect()}
    got = query(spark, "fuzz_ratio_family")
    assert len(got) == len(pairs)
    for r in got:
        a, b = pairs[r.id, r.id2]
        assert r.ratio == pytest.approx(ratio(a, b), abs=1e-6) and r.tset == pytest.approx(token_set(a, b), abs=1e-6)
        assert r.tsort == pytest.approx(ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split()))), abs=1e-6)
        assert r.partial == pytest.approx(partial(a, b), abs=1e-6)


def filled(r, names):
    return [x for n in names for x in (-1.0 if r[n] is None else float(r[n]), float(r[n] is None))]


@pytest.fixture(scope="module")
def data(spark):
    return scoring.training(spark, SF).persist()


def key(r):
    return r.s1_id, r.source, r.cand_id


def test_margins(spark, data):
    model = models.fit_margin(data.where("u < 0.6"), scoring.NUMERIC).stages[-1]
    rows = {key(r): r for r in data.collect()}
    got = query(spark, "scorer_logreg")
    assert {key(r) for r in got} == set(rows)
    for r in got:
        assert r.logit == pytest.approx(model.intercept + sum(c * x for c, x in zip(model.coefficients, filled(rows[key(r)], scoring.NUMERIC), strict=True)), abs=1e-6)
    train = [r for r in rows.values() if r.u < 0.6]
    p = {key(r): 1 / (1 + math.exp(-r.logit)) for r in got}
    assert sum(p[key(r)] - r.label for r in train) / len(train) == pytest.approx(0, abs=1e-3)  # the free intercept is at its best


def walk(node, x):
    while not node.getClass().getSimpleName().startswith("Leaf"):
        split = node.split()
        left = x[split.featureIndex()] in list(split.leftCategories()) if "Categorical" in split.getClass().getSimpleName() else x[split.featureIndex()] <= split.threshold()
        node = node.leftChild() if left else node.rightChild()
    return node.prediction()


def test_trees(spark, data):
    model = models.fit_trees(data.where("u < 0.6"), data.where("u >= 0.6 AND u < 0.8"), scoring.NUMERIC, ("source",))
    place = {v: float(i) for i, v in enumerate(model.stages[0].labels)}
    trees = model.stages[-1]
    roots = [t.rootNode() for t in trees._java_obj.trees()]
    rows = {key(r): r for r in data.collect()}
    got = query(spark, "pair_model_gbt")
    assert {key(r) for r in got} == set(rows)
    for r in got:
        x = [*filled(rows[key(r)], scoring.NUMERIC), place[r.source]]
        margin = sum(w * walk(n, x) for w, n in zip(trees.treeWeights, roots, strict=True))
        assert r.p == pytest.approx(1 / (1 + math.exp(-2 * margin)), abs=1e-6)


def f05(tp, taken, true):
    if not true:
        return float(not taken)
    return 1.25 * (tp / taken) * (tp / true) / (0.25 * tp / taken + tp / true) if tp else 0.0


def test_bakeoff(spark, data):
    truth = {r.s1_id: r.n_true for r in decisions.universe(spark, SF).collect()}

    def mean(columns):
        counts = defaultdict(lambda: [0, 0])
        for r in models.score(models.fit_margin(data.where("u < 0.6"), columns), data, columns).collect():
            if r.p >= 0.5:
                counts[r.s1_id][0] += r.label
                counts[r.s1_id][1] += 1
        return sum(f05(*counts[s], n) for s, n in truth.items()) / len(truth)

    base, names = mean(scoring.NUMERIC), {"without gaps": scoring.NUMERIC[:2], "without rank": (scoring.NUMERIC[0], *scoring.NUMERIC[2:])}
    got = {r.variant: r for r in query(spark, "group_bakeoff")}
    assert set(got) == set(names)
    for name, columns in names.items():
        r = got[name]
        assert r.delta == pytest.approx(mean(columns) - base, abs=1e-9) and r.low <= r.high
        assert r.verdict == ("BETTER" if r.low > 0 else "WORSE" if r.high < 0 else "WITHIN NOISE")


def test_search_and_parameters(spark, data):
    space = {"rounds": (2, 5), "depth": (1, 3)}
    assert len(models.trials(space, 3)) == 3 and models.trials(space, 4, 1) != models.trials(space, 4, 2)
    found = models.search(data.where("u < 0.6"), data.where("u >= 0.6"), scoring.NUMERIC, space, 2)
    assert len(found) == 2 and found[0][1] >= found[1][1] and found[0][0] in models.trials(space, 2)
    assert models.resolved_params({"rounds": 10, "depth": 3}, {"rounds": 8}, {"depth": 5}) == {"rounds": 10, "depth": 5}
    assert models.resolved_params({"rounds": 10}, None, None) == {"rounds": 10}


def test_missing_records_fail(spark):
    r = spark.createDataFrame([(1, "a", "b", "latin")], "id long, name_norm string, addr_norm string, name_script string")
    pairs = spark.createDataFrame([(1, "S2", 2)], "s1_id long, source string, cand_id long")
    with pytest.raises(Exception, match="no record for pair"):
        models.pair_texts(pairs, r, r.selectExpr("*", "'S2' AS source")).collect()
