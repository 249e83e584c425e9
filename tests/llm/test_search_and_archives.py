"""Operators 1 and 2: recall and exact round trips."""

import base64
import hashlib
import random
import struct

import numpy as np
import zstandard

from kinfold.llm import ann, warc

VECTORS = "vec_id long, embedding array<double>, dim int, block string, label int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "b", 0) for i, v in rows], VECTORS)


def test_search_is_near_brute_force(spark):
    rng = np.random.default_rng(1)
    v = rng.standard_normal((1500, 32))
    ids = np.arange(1500) * 3
    df = frame(spark, [(int(i), x.tolist()) for i, x in zip(ids, v, strict=True)])
    got = ann.search(df.where("vec_id % 50 = 0"), df).collect()
    asked = np.flatnonzero(ids % 50 == 0)
    truth = dict(ann.brute(ids, v, asked))
    hits = sum(r.vec_id in truth[r.query_id] for r in got)
    assert len(got) == 5 * len(asked) and hits >= 0.9 * len(got)
    unit = v / np.linalg.norm(v, axis=1)[:, None]
    assert all(abs(r.score - unit[r.query_id // 3] @ unit[r.vec_id // 3]) < 1e-12 for r in got)


def test_search_defined_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (7, [2.0, 0.0]), (3, [1.0, 0.0]), (3, [1.0, 0.0]), (9, [0.0, 1.0]), (None, [1.0, 0.0]), (50, None), (100, [0.0, 0.0]), (150, [1.0, nan]), (200, [1.0, inf]), (250, [None, 1.0]), (11, [1.0, 0.0, 0.0])]
    df = frame(spark, rows)
    got = [(r.query_id, r.rank, r.vec_id, r.score) for r in ann.search(df.where("vec_id % 50 = 0"), df).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 3, 1.0), (0, 2, 7, 1.0), (0, 3, 9, 0.0)]
    assert ann.search(df.limit(0), df).count() == 0 and ann.search(df.where("vec_id = 0"), df.limit(0)).count() == 0


def test_search_ties_of_many_copies(spark):
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(400)] + [(1000 + i, [float(i % 7 + 1), float(i % 5), 1.0]) for i in range(100)]
    df = frame(spark, rows)
    got = ann.search(df.where("vec_id = 200"), df).orderBy("rank").collect()
    assert [r.vec_id for r in got] == [0, 1, 2, 3, 4] and len({r.score for r in got}) == 1


def test_tiny_and_huge_vectors(spark):
    """Squares of these vanish or overflow; the cosine of the directions counts."""
    rng = np.random.default_rng(4)
    rows = [(i, rng.standard_normal(16).tolist()) for i in range(1, 50)]
    base = rng.standard_normal(16)
    rows += [(100, (base * 1e-200).tolist()), (150, (base * 1e200).tolist()), (201, (base * 5e-310).tolist()), (202, base.tolist()), (200, [1e308] * 16), (203, [-1e308] * 16)]
    df = frame(spark, rows)
    got = {(r.query_id, r.rank): r for r in ann.search(df.where("vec_id % 50 = 0"), df).collect()}
    assert {q for q, _ in got} == {100, 150, 200}
    assert {got[100, r].vec_id for r in (1, 2, 3)} == {150, 201, 202} == {got[150, r].vec_id for r in (1, 2, 3)} - {100} | {150}
    assert all(0.999 < got[q, r].score <= 1 + 1e-12 for q in (100, 150) for r in (1, 2, 3))
    unit = lambda x: np.array(x) / np.abs(x).max() / np.linalg.norm(np.array(x) / np.abs(x).max())
    by_id = dict(rows)
    assert all(abs(r.score - unit(by_id[r.query_id]) @ unit(by_id[r.vec_id])) < 1e-9 for r in got.values() if 201 not in (r.vec_id, r.query_id))


def test_windows_count_each_row_once():
    """Whatever the steps, a row's count is the number of arrays in which it lies in the last window."""
    rng = np.random.default_rng(7)
    v, queries = rng.standard_normal((300, 12)), rng.standard_normal((5, 12))
    index = ann.Index(v, 40)
    done = {q: (set(rows.tolist()), scores) for q, rows, scores in index.search(queries, 3, 60)}
    values = index.project(index.vectors, index.norms)
    at = index.project(ann.scaled(queries), ann.lengths(ann.scaled(queries)))
    halves = [ann.WIDTH * ann.GROWTH**i for i in range(60)]
    for q, (rows, scores) in done.items():
        sets = [set(np.flatnonzero((np.abs(values - at[q]) <= h).sum(axis=1) >= 26).tolist()) for h in halves]
        assert len(rows) >= 3 and any(len(rows ^ s) <= 1 for s in sets)  # one at a window's edge may round
        assert len(scores) == len(rows)
    assert 0 < index.counted < 40 * 300 * 5


def test_verified_share_falls():
    rng = np.random.default_rng(8)
    shares = []
    for n in (1000, 16_000):
        index = ann.Index(rng.standard_normal((n, 24)))
        list(index.search(rng.standard_normal((8, 24)), 6, ann.VERIFIED))
        shares.append(index.verified / 8 / n)
    assert shares[1] < shares[0] / 2


def test_archive_frames():
    rng = random.Random(2)
    records = [("WARC " + " ".join(rng.choice(("alpha", "beta", "gamma", "delta")) for _ in range(rng.randint(0, 400)))).encode() + rng.randbytes(9) for _ in range(400)]
    frames = list(warc.frames(iter(records)))
    assert frames[0][:4] == warc.DICT_MAGIC and len(frames) == 401
    archive = warc.GAP.encode().join(frames) + warc.GAP.encode()
    assert list(warc.read_records(archive)) == records
    size = struct.unpack("<I", frames[0][4:8])[0]
    built = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(frames[0][8 : 8 + size]))
    assert zstandard.ZstdDecompressor(dict_data=built).decompress(frames[37]) == records[36]  # each by itself
    assert list(warc.read_records(b"".join(warc.frames(iter([b"one"]))))) == [b"one"] and list(warc.read_records(b"")) == []


def test_round_trip(spark, tmp_path):
    pages = [(1, "http://a/", "<p>x</p>"), (4, "http://b/\r\nInjected: 1", "<p>é\0\r\n\r\n</p>"), (3, None, "<p>x</p>"), (2, "u", None), (9, "u", ""), (None, "u", "<p>x</p>"), (None, "n", "lone"), (5, "u", "z" * 300_000), (5, "u", "z" * 300_000)]
    pages += [(100 + i, "http://hot/", "hot page") for i in range(400)] + [(600 + i, f"http://s/{i}", f"<html>page {i} {'words ' * (i % 50)}</html>") for i in range(300)]
    df = spark.createDataFrame([(*p, "r", 1) for p in pages], "page_id long, url string, html string, digest string, refers_to int")
    warc.write_archives(df, str(tmp_path / "w"), archive_bytes=50_000)
    got = warc.read_archives(spark, str(tmp_path / "w")).collect()
    first = {}
    for i, _, h in pages:
        first[h or ""] = min((x for x in (first.get(h or ""), i) if x is not None), default=None)
    digest = lambda h: base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode()
    want = sorted(((i, len((h or "").encode()), digest(h), *(("response", None) if i == first[h or ""] else ("revisit", first[h or ""]))) for i, _, h in pages), key=str)
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == want
    assert {r.page_id: r.payload for r in got}[4] == "<p>é\0\r\n\r\n</p>".encode()
    assert all(r.payload is None for r in got if r.record_type == "revisit")


def test_record_ids_are_unique(spark, tmp_path):
    pages = [(1, "u", "one"), (1, "u", "two"), (1, "u", "one"), (2, "u", "one"), (None, "u", "one"), (None, "u", "three"), (None, "u", "three"), (2, "u", "two")]
    pages += [(10 + i, "u", f"page {i}") for i in range(1500)]
    warc.write_archives(spark.createDataFrame(pages, "page_id long, url string, html string"), str(tmp_path / "w"))
    heads = [warc.parse(one)[0] for f in (tmp_path / "w").glob("part-*") for one in warc.read_records(f.read_bytes())]
    ids = [h["WARC-Record-ID"] for h in heads]
    assert len(ids) == len(set(ids)) == len(pages)
    digest = {h["WARC-Record-ID"]: h["WARC-Payload-Digest"] for h in heads}
    revisits = [h for h in heads if h["WARC-Type"] == "revisit"]
    assert len(revisits) == 3 and all(digest[h["WARC-Refers-To"]] == h["WARC-Payload-Digest"] for h in revisits)


def test_small_payloads_are_all_responses(spark):
    df = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcd"), (4, "u", "abcd")], "page_id long, url string, html string")
    assert sorted((r.page_id, r.record_type) for r in warc.archived(df, min_bytes=3).collect()) == [(1, "response"), (2, "response"), (3, "response"), (4, "revisit")]


def test_empty_archives(spark):
    assert warc.archived(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
