"""Hand-worked cases of context, metric, resolver, sources; queries against SQL."""

import pathlib

import duckdb
import pytest

import __spark_entry__
from kinfold.operators import context, evaluate, features, labels, resolver, stats
from kinfold.plans import catalogue
from kinfold.sources import tables
from kinfold.streaming.prepare import prepare_new_files

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(x):
    if x is None or x != x:
        return None
    return round(float(x), 5) + 0.0 if isinstance(x, float) else int(x) if isinstance(x, bool) else float(x) if type(x).__name__ in ("Decimal", "int") else str(x)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_equals_sql(spark, duck, name):
    got = catalogue.queries()[name](spark, SF)
    want = duck.execute(catalogue.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(columns)
    key = lambda r: tuple(str(x) for x in r)
    a = sorted((tuple(plain(r[c]) for c in columns) for r in got.collect()), key=key)
    b = sorted((tuple(map(plain, r)) for r in want.fetchall()), key=key)
    assert a == b


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_runs(spark, name):
    assert catalogue.queries()[name](spark, SF).count() > 0


def test_context_of_a_small_group(spark):
    df = spark.createDataFrame([(1, "S2", 1, 1, 2.0), (1, "S2", 2, 2, 1.0), (1, "S2", 3, 3, None)], "s1_id long, source string, cand_id long, rank int, x double")
    rows = context.group_context(df, context.LIST, "x", ("rank",), "c").orderBy("cand_id").collect()
    assert [r.c_rank for r in rows] == [1, 2, None] and [r.c_gap_top for r in rows] == [0, 1, None] and [r.c_other_best for r in rows] == [1, 2, None]
    assert rows[0].c_share == pytest.approx(0.7311, abs=1e-4) and rows[2].c_share is None and (rows[0].c_n_valid, rows[0].c_n_pos) == (2, 2)


def test_context_of_a_group_with_half_the_rows(spark, monkeypatch):
    """Sums and prefix sums give what one sort of the group gives: ties, nulls and two hot groups among small ones."""
    monkeypatch.setattr(stats, "BUCKETS", 8)
    rows = [(i, "S2", 1, None if i % 13 == 0 else (i * 37 % 101) / 10 - 4) for i in range(400)]
    rows += [(i, "S3", 7, 5.0 if i < 3 else 0.5) for i in range(150)] + [(i, "S2", 100 + i % 60, float(i % 7)) for i in range(250)]
    df = spark.createDataFrame(rows, "s1_id long, source string, cand_id long, x double")
    hot = df.where("(source = 'S2' AND cand_id = 1) OR source = 'S3'").select(*context.CLAIM).distinct()
    want = context.group_context(df, context.CLAIM, "x", ("s1_id",), "c")
    got = context.group_context(df, context.CLAIM, "x", ("s1_id",), "c", hot)
    plain_ = lambda r: {k: round(v, 9) if isinstance(v, float) else v for k, v in r.asDict().items()}
    key = lambda r: (r["source"], r["cand_id"], r["s1_id"])
    assert sorted(map(plain_, got.collect()), key=key) == sorted(map(plain_, want.collect()), key=key)
    assert {tuple(r) for r in context.hot_groups(df, context.CLAIM, 100).collect()} == {("S2", 1), ("S3", 7)}
    assert context.hot_groups(df, context.CLAIM) is None


def test_joins_with_one_key_in_half_the_rows(spark):
    """Groups, contexts and word weights where one key holds most rows."""
    pairs = spark.createDataFrame([(i, "r0") for i in range(300)] + [(i, f"r{i}") for i in range(300)] + [(400, "r500")], "s1_id long, rec_id string")
    s1 = spark.range(0, 402).withColumnRenamed("id", "s1_id")
    groups = {r.s1_id: r.group_id for r in labels.entity_groups(s1, pairs).collect()}
    assert {groups[i] for i in range(300)} == {0} and groups[400] == 400 and groups[401] == 401
    keys = spark.createDataFrame([(i, "b" if i % 2 else "", "n" if i % 3 else f"n{i}", "p") for i in range(300)], "id long, building string, name_key string, postal string")
    got = {r.id: (r.bldg_n_names, r.name_n_places) for r in resolver.s1_context(keys).collect()}
    assert got[1] == (51, 2) and got[0] == (1, 1) and got[3] == (51, 1) and len(got) == 300
    texts = spark.createDataFrame([(i, f"ltd w{i}") for i in range(300)], "id long, t string")
    weights = features.word_weights(texts, "t", features.fit_idf(texts, "t"), ["id"], "w").collect()
    assert all(set(r.w) == {"ltd", f"w{r.id}"} and r.w["ltd"] == pytest.approx(1.0) for r in weights)


def test_metric(spark):
    u = spark.createDataFrame([(1, 0), (2, 0), (3, 2), (4, 2), (5, 1)], "s1_id long, n_true long")
    p = spark.createDataFrame([(2, 0, 0.9), (3, 1, 0.9), (4, 0, 0.9)], "s1_id long, label int, p double")
    got = {r.s1_id: r.f for r in evaluate.per_query(u, p, evaluate.F.col("p") >= 0.5).collect()}
    assert got == {1: 1.0, 2: 0.0, 3: pytest.approx(0.8333, abs=1e-4), 4: 0.0, 5: 0.0}
    curve = {r.threshold: r.s1_macro_f05 for r in evaluate.threshold_curve(u, p, "p", [0.5, 0.95]).collect()}
    assert curve == {0.5: pytest.approx(sum(got.values()) / 5), 0.95: pytest.approx(2 / 5)}


def claims(spark, rows):
    return spark.createDataFrame([(s, "S2", 1, p, True, e, 0, 1, 1) for s, p, e in rows], "s1_id long, source string, cand_id long, p double, acc boolean, name_agree int, addr_agree int, bldg_n_names int, name_n_places int")


@pytest.mark.parametrize(("rows", "reasons"), [([(1, 0.9, 1), (2, 0.7, 1)], [0, 3]), ([(1, 0.8, -1), (2, 0.75, 2)], [3, 0]), ([(1, 0.8, 1), (2, 0.75, 1)], [4, 4]), ([(1, 0.9, 0), (2, 0.7, 1)], [4, 4]), ([(1, 0.5, 1)], [0])])
def test_one_owner(spark, rows, reasons):
    got = resolver.resolve(claims(spark, rows), resolver.knobs()).orderBy("s1_id").collect()
    assert [r.reason for r in got] == reasons and sum(r.acc_new for r in got) <= 1


def test_knobs():
    with pytest.raises(ValueError, match="at least 2"):
        resolver.knobs(owner_min_claims=1)


def test_address_agreement(spark):
    side = "postal string, house string, street array<string>, street_strong boolean"
    cases = [
        (("75001", "12", ["rue", "paix"], True), ("75009", "12", ["rue", "paix"], True), 2),
        (("75001", "12", ["rue", "paix"], True), ("75001", "14", ["rue", "paix"], True), 0),
        (("75001", "", ["rue", "paix"], True), ("75001", "14", ["rue", "paix"], True), 1),
        (("75001", "1", ["rue", "a"], False), ("75002", "1", ["quai", "b"], False), 0),
        (("75001", "1", ["rue", "a"], False), ("13002", "1", ["quai", "b"], False), -1),
        (("", "1", ["rue", "a"], True), ("", "1", ["quai", "b"], True), -1),
        (("75001", "", [], False), ("75001", "1", ["quai"], True), 0),
    ]
    df = spark.createDataFrame([(a, b) for a, b, _ in cases], f"a struct<{side.replace(' string', ':string').replace(' array', ':array').replace(' boolean', ':boolean')}>, b struct<{side.replace(' string', ':string').replace(' array', ':array').replace(' boolean', ':boolean')}>")
    assert [r[0] for r in df.select(resolver.addr_agree("a", "b")).collect()] == [c for _, _, c in cases]


def test_roles_keep_groups_together(spark):
    df = spark.range(40).selectExpr("id AS g", "id % 2 AS stratum")
    got = labels.assign_roles(df, "stratum", "g").groupBy("stratum", "entity_role").count().collect()
    assert {(r.stratum, r.entity_role): r["count"] for r in got} == {(s, role): round(20 * share) for s in (0, 1) for role, share in labels.ROLES}


def test_prefix_sums(spark):
    df = spark.range(500).selectExpr("id", "(id * 37) % 500 AS x", "1L AS one")
    got = stats.prefix_sums(df, [stats.F.col("x")], stats.range_buckets(df, "x"), {"n": "one"}).collect()
    assert all(r.before_n == r.x for r in got)


def test_sources_round_trip(spark, tmp_path):
    raw = tmp_path / "in"
    raw.mkdir()
    (raw / "a.tsv").write_text('entity_id\tbusiness_name\tbusiness_address\tcountry\nS2-1\tNA\t\tUS\nS2-2\t"Quoted ""x"" Ltd"\t1 A St\tIndia\n')
    df = tables.read_tsv(spark, str(raw))
    assert [tuple(r) for r in df.orderBy("entity_id").collect()] == [("S2-1", "NA", "", "US"), ("S2-2", 'Quoted "x" Ltd', "1 A St", "India")]
    assert tuple(tables.line_counts(spark, str(raw), df).first()) == (2, 2)
    order = spark.createDataFrame([("q1", 0), ("q2", 1)], "s1_id string, position long")
    pairs = spark.createDataFrame([("q1", "S2-2"), ("q1", "S2-1")], "s1_id string, entity_id string")
    lists = tables.matching_lists(pairs, order)
    tables.write_lists(lists, str(tmp_path / "out"))
    assert sorted((r.s1_id, r.entity_id) for r in tables.read_matching(spark, str(tmp_path / "out")).collect()) == [("q1", "S2-1"), ("q1", "S2-2")]
    row = tables.file_checks(spark, str(tmp_path / "out"), "source1_entity_id\tmatched_entity_ids", order.select("s1_id"), df, pairs).first()
    assert set(row) == {0}
    tables.append_run(spark, str(tmp_path / "log"), "a", {"f": 1})
    tables.append_run(spark, str(tmp_path / "log"), "b", {"f": 2})
    assert tables.load_runs(spark, str(tmp_path / "log")).count() == 2


def test_incremental_preparation(spark, tmp_path):
    raw, out, state = tmp_path / "raw", str(tmp_path / "out"), str(tmp_path / "state")
    raw.mkdir()
    line = "entity_id\tbusiness_name\tbusiness_address\tcountry\nS2-{0}\tAcme {0} Ltd\t1 A St\tUS\n"
    for i in (1, 2):
        (raw / f"{i}.tsv").write_text(line.format(i))
        prepare_new_files(spark, str(raw), out, state, "S2", "train")
        assert spark.read.parquet(out).count() == i


def test_entry_and_registry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_nothing_else_imports_the_corpus_package():
    root = pathlib.Path(catalogue.__file__).parents[1]
    assert not [p for p in root.rglob("*.py") if "llm" not in p.parts and "kinfold.llm" in p.read_text()]
