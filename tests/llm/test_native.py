"""Operators 9 and 10 against plain Python, and their defined cases."""

import datetime as dt
import hashlib
import math
import re
from collections import defaultdict

import pytest

from kinfold.llm import mixing, url_filters

DOCS = "doc_id long, text string, source string, size string, target string, __key string"


def water(sizes, weights=(3, 1, 2)):
    """Targets by sharing the excess again and again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    target, left, free = dict.fromkeys(names, 0.0), 1.5 * sum(sizes.values()), set(names)
    while left > 1e-9 and free:
        total = sum(w[s] for s in free)
        for s in free:
            target[s] += left * w[s] / total
        left = 0.0
        for s in list(free):
            if target[s] >= 2 * sizes[s]:
                left += target[s] - 2 * sizes[s]
                target[s] = 2 * sizes[s]
                free.remove(s)
    return target


def brute_mix(rows):
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, _ in rows]
    sizes = defaultdict(int)
    for n, (_, _, s) in zip(size, rows, strict=True):
        sizes[s] += n
    target = water(sizes)
    md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
    key = lambda i: int(md5(f"{'' if rows[i][0] is None else rows[i][0]}|{md5(rows[i][1] or '')}")[:15], 16)
    out = []
    for s in sizes:
        budget = math.floor(target[s] + 0.5)
        epochs, rest = divmod(budget, sizes[s]) if sizes[s] else (0, 0)
        for i in sorted((i for i in range(len(rows)) if rows[i][2] == s), key=lambda i: (key(i), rows[i][0] or 0, size[i])):
            part = max(0, min(size[i], rest))
            rest -= part
            out.append((rows[i][0], size[i], sizes[s], round(target[s], 6), epochs * size[i] + part))
    return sorted(out, key=str)


def test_mix_equals_brute_force(spark):
    rows = [(i, " ".join(["w"] * (i * 7 % 23)) + ("\tx\n" if i % 3 else ""), [None, "b", "a", "é", "z", "z", "z"][i % 7]) for i in range(200)]
    rows += [(None, "a b", "a"), (3, "one two", "b"), (3, "one two", "b"), (500, None, "empty"), (501, "", "b"), (502, "w " * 3000, "z")]
    df = spark.createDataFrame([(*r, "s", "t", "k") for r in rows], DOCS)
    got = sorted(((r.doc_id, r["size"], r.source_size, round(r.target, 6), r.taken) for r in mixing.mix(df).collect()), key=str)
    assert got == brute_mix(rows)
    assert all(r[4] <= 2 * r[1] for r in got)


def test_mix_empty_and_keep(spark):
    empty = spark.createDataFrame([], DOCS)
    assert mixing.mix(empty).columns == ["doc_id", "size", "source_size", "target", "taken"] and mixing.mix(empty).count() == 0
    one = spark.createDataFrame([(1, "a b c", "s", "", "", "x")], DOCS)
    row = mixing.mix(one, keep=("text", "source", "__key")).first()
    # The budget is 4.5 words, rounded up.
    assert (row.taken, row.text, row.source, row["__key"], row.target) == (5, "a b c", "s", "x", 4.5)
    with pytest.raises(ValueError, match="results"):
        mixing.mix(one, keep=("size",))


def test_mix_of_many_rows_without_id(spark, monkeypatch):
    """Half the rows without an id, a third copies of one row: their source is cut among the copies, exactly."""
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 8)
    rows = [(None, "copy of one", "hot")] * 300 + [(None, f"own words {'x ' * (i % 9)}{i}", "hot") for i in range(150)] + [(i, f"w{i}", "cold") for i in range(450)]
    df = spark.createDataFrame([(*r, "s", "t", "k") for r in rows], DOCS)
    got = sorted(((r.doc_id, r["size"], r.source_size, round(r.target, 6), r.taken) for r in mixing.mix(df).collect()), key=str)
    assert got == brute_mix(rows)


def day(text):
    return dt.date.fromisoformat(text)


CAPTURES = "page_id long, url string, fetched_on date, key string, host string"
ENTRIES = "key string, listed_on date, action string, category string, url string"


def test_url_filter_as_of(spark):
    entries = [
        ("bad.org", day("2024-01-10"), "add", "spam", ""),
        ("bad.org", day("2024-02-01"), "remove", "spam", ""),
        ("bad.org", day("2024-03-01"), "add", "malware", ""),
        ("x.bad.org", day("2024-01-20"), "add", "adult", ""),
        ("twice.org", day("2024-01-01"), "add", "spam", ""),
        ("twice.org", day("2024-01-01"), "remove", "spam", ""),
        (None, day("2024-01-01"), "add", "spam", ""),
        ("noday.org", None, "add", "spam", ""),
    ]
    cases = {
        ("https://www.bad.org/a", "2024-01-09"): None,
        ("https://www.BAD.org:80/a", "2024-01-10"): "bad.org",
        ("http://u@x.bad.org/", "2024-01-25"): "x.bad.org",
        ("http://y.x.bad.org?q", "2024-02-10"): "x.bad.org",
        ("http://bad.org", "2024-02-01"): None,
        ("http://bad.org#f", "2024-03-05"): "bad.org",
        ("http://notbad.org/", "2024-03-05"): None,
        ("http://twice.org/", "2024-03-05"): None,
        ("http://noday.org/", "2024-03-05"): None,
        ("/relative", "2024-03-05"): None,
        (None, "2024-03-05"): None,
        ("http://bad.org/", None): None,
        ("http://localhost/", "2024-03-05"): None,
    }
    rows = [(i, u, d and day(d), "k", "h") for i, (u, d) in enumerate(cases)] * 2 + [(99, "http://bad.org/hot", day("2024-03-02"), "", "")] * 300
    got = url_filters.url_filter(spark.createDataFrame(rows, CAPTURES), spark.createDataFrame(entries, ENTRIES)).collect()
    assert len(got) == len(rows)
    for r in got:
        want = "bad.org" if r.page_id == 99 else list(cases.values())[r.page_id]
        assert (r.matched_key, r.blocked) == (want, want is not None), r


def test_url_filter_empty(spark):
    captures, entries = spark.createDataFrame([], CAPTURES), spark.createDataFrame([], ENTRIES)
    assert url_filters.url_filter(captures, entries).count() == 0
    some = spark.createDataFrame([(1, "http://a.org", day("2024-01-01"), "", "")], CAPTURES)
    assert [r.blocked for r in url_filters.url_filter(some, entries).collect()] == [False]


def test_url_filter_by_category_and_odd_hosts(spark):
    entries = [
        ("two.org", day("2024-01-01"), "add", "adult", ""),
        ("two.org", day("2024-01-05"), "add", "spam", ""),
        ("two.org", day("2024-02-01"), "remove", "spam", ""),
        ("two.org", day("2024-03-01"), "remove", "adult", ""),
        ("two.org", day("2024-03-01"), "add", "malware", ""),
        ("[::1]", day("2024-01-01"), "add", "spam", ""),
        ("two.org", day("2024-03-02"), None, "malware", ""),
    ]
    cases = {
        ("http://two.org/", "2024-01-03"): "adult",
        ("http://a.two.org/", "2024-01-20"): "spam",
        ("http://two.org./x", "2024-02-10"): "adult",
        ("http://two.org:8080", "2024-03-05"): None,
        ("http://[::1]:80/", "2024-03-05"): "spam",
        ("http://[::2]/", "2024-03-05"): None,
    }
    rows = [(i, u, day(d), "k", "h") for i, (u, d) in enumerate(cases)]
    got = url_filters.url_filter(spark.createDataFrame(rows, CAPTURES), spark.createDataFrame([e for e in entries if e[2]], ENTRIES)).collect()
    want = list(cases.values())
    want[3] = "malware"
    assert {r.page_id: r.category for r in got} == dict(enumerate(want))
    assert url_filters.url_filter(spark.createDataFrame(rows, CAPTURES), spark.createDataFrame(entries, ENTRIES)).count() == len(rows)


def test_url_filter_under_one_domain(spark):
    """Nearly every host lies under one listed domain."""
    rows = [(i, f"http://h{i}.blogs.org/", day("2024-02-01"), "", "") for i in range(700)] + [(1000, "http://x.org", day("2024-02-01"), "", "")]
    entries = spark.createDataFrame([("blogs.org", day("2024-01-01"), "add", "spam", ""), ("h7.blogs.org", day("2024-01-01"), "add", "adult", "")], ENTRIES)
    got = {r.page_id: r.category for r in url_filters.url_filter(spark.createDataFrame(rows, CAPTURES), entries).collect()}
    assert got == {i: "spam" for i in range(700)} | {7: "adult", 1000: None}


def test_plans_run_no_python(spark):
    captures = spark.createDataFrame([(1, "http://a.org", day("2024-01-01"), "", "")], CAPTURES)
    plan = url_filters.url_filter(captures, spark.createDataFrame([("a.org", day("2024-01-01"), "add", "spam", "")], ENTRIES))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    docs = spark.createDataFrame([(1, "a b", "s", "", "", "")], DOCS)
    plan = mixing.mix(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
