"""The pipeline against its operators applied one by one in plain Python, and the guard of the entry file."""

import subprocess
import sys
from pathlib import Path

import corpus_pipeline
from kinfold.llm import catalogue, decontamination, quality
from kinfold.session import table
from tests.llm.test_native import brute_mix
from tests.llm.test_near_copies import copy_roots

SF = "/root/testdata/sf0.001"
ROOT = Path(corpus_pipeline.__file__).parent


def test_pipeline_equals_brute_force(spark):
    """Near copies by five words and similarity 0.8, as stages on word shingles take them."""
    docs = {r.doc_id: r for r in table(spark, SF, "documents").collect()}
    model = quality.train(table(spark, SF, "documents"), table(spark, SF, "labels"))
    good = sorted(i for i, r in docs.items() if model.score(quality.feature_table([r.text]))[0] >= 0.7)
    root = copy_roots([docs[i].text for i in good])
    alone = [i for k, i in enumerate(good) if root[k] == k]
    bench = decontamination.Benchmark((r.item_id, r.text) for r in table(spark, SF, "benchmark").collect())
    clean = [i for i in alone if not bench.matches(docs[i].text)]
    want = brute_mix([(i, docs[i].text, docs[i].source) for i in clean])
    got = corpus_pipeline.run(spark, SF).collect()
    assert sorted(((r.doc_id, r["size"], r.source_size, round(r.target, 6), r.taken) for r in got), key=str) == want
    assert all(r.text == docs[r.doc_id].text for r in got)
    assert len(docs) > len(good) > len(alone) > len(clean) > 0
    assert 1 in alone and 177 in good and 177 not in alone  # similarity 0.83, nine bits apart


def test_stages_keep_the_columns(spark):
    docs = table(spark, SF, "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns


def test_stages_of_odd_rows(spark, tmp_path):
    """Nulls, empty and repeated rows, clashing names and an empty table."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, __key string, size int, item_id string, fp long"
    rows = [(1, None, None, None, None, "", 1, "", 0), (None, "", "x", "s", 0, "", 1, "", 0), (2, "A plain text of its own, long enough to be read.", "en", "s", 48, "", 1, "", 0)]
    rows += [rows[2], (None, None, None, None, None, None, None, None, None), (3, "word " * 30_000, "en", None, 1, "", 1, "", 0)]
    docs = spark.createDataFrame(rows, schema)
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        assert stage(spark, docs.limit(0), SF).count() == 0, name
        out = stage(spark, docs, SF)
        if i < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns
        got = sorted(str(r.doc_id) for r in out.collect())
        if name == "near-duplicates":
            assert got == ["1", "2", "3", "None", "None"]
        elif name != "quality classifier":
            assert got == ["1", "2", "2", "3", "None", "None"], name


def test_every_operator_has_a_query():
    names = list(catalogue.queries())
    assert [int(n[2:].split("_")[0]) for n in names] == list(range(1, 11)) and set(catalogue.oracle_sql()) <= set(names)


def test_entry_without_the_corpus_folders():
    code = "import sys; sys.modules['kinfold.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; assert not any(n.startswith('op') and n[2].isdigit() or n == 'pipeline' for n in e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)
