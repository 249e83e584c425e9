"""Operators 3 to 7 against brute force, held-out accuracy or hand-made cases."""

import math
import random
import re
from collections import Counter
from html.parser import HTMLParser

import numpy as np
import pytest

from kinfold.llm import catalogue, html_text, licenses, quality, token_counts
from kinfold.llm import decontamination as dec
from kinfold.session import table

DOCS = "doc_id long, text string, score string, quality string, item_id long"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "s", "q", 1) for r in rows], DOCS)


def prose(rng, n):
    return " ".join("".join(rng.choice("bcdfgh") + rng.choice("aeiou") for _ in range(rng.randint(1, 4))) for _ in range(n))


# --- 3


def test_quality_held_out_accuracy(spark):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(900):
        good = rng.random() < 0.8
        text = prose(rng, rng.randint(3, 300)).capitalize() + "."
        rows.append((i, text if good else rng.choice((text.upper(), " ".join(w + "***" for w in text.split()), " ".join(w for w in text.split() for _ in range(9))))))
        labels.append((i, int(good), 0))
    rows += [(1000, None), (1001, ""), (1002, " \n"), (None, "Plain words."), (1003, "word " * 50_000), (3, rows[3][1])]
    labels += [(None, 1, 0), (2000, None, 0), (5, labels[5][1], 0)]
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = quality.quality_scores(frame(spark, rows), marks).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    import zlib

    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got if r.doc_id is not None)
    kind = {i: q for i, q, _ in labels}
    held = [r for r in got if r.held_out and r.doc_id in kind]
    assert len(held) > 150 and np.mean([r.predicted == kind[r.doc_id] for r in held]) > 0.97


def test_quality_labels_of_held_out_rows_are_never_read(spark):
    rng = random.Random(9)
    rows = [(i, prose(rng, 30) if i % 2 else prose(rng, 30).upper()) for i in range(200)]
    right = spark.createDataFrame([(i, i % 2, 0) for i in range(200)], "doc_id long, quality int, toxic int")
    wrong = right.withColumn("quality", quality.F.when(quality.held_out(quality.F.col("doc_id")), 1 - quality.F.col("quality")).otherwise(quality.F.col("quality")))
    a, b = (sorted((r.doc_id, r.score) for r in quality.quality_scores(frame(spark, rows), x).collect()) for x in (right, wrong))
    assert a == b


def test_quality_without_labels(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = frame(spark, [(1, "a"), (2, None)])
    assert [r.score for r in quality.quality_scores(docs, none).collect()] == [0.5, 0.5]
    assert quality.keep_good(docs, none).count() == 2 and quality.quality_scores(docs.limit(0), none).count() == 0


def plain_score(model, row):
    """Entries of the fitted tables added up one by one."""
    total = model.intercept
    bins = [sum(e <= x for e in edges.tolist()) for edges, x in zip(model.edges, row, strict=True)]
    for table, b in zip(model.tables, bins, strict=True):
        total += float(table[b])
    for i, j, table in model.pairs:
        total += float(table[model.coarse[i][bins[i]]][model.coarse[j][bins[j]]])
    return 1 / (1 + math.exp(-min(30.0, max(-30.0, total))))


def plain_features(text):
    """Most features again, from characters and words of the decoded text."""
    raw = (text or "").encode()
    words = re.findall(rb"[^ \t-\r]+", raw)
    n = len(words)
    if not n:
        return None
    counts = Counter(words)
    lines = raw.split(b"\n")
    letters = sum(65 <= b < 91 or 97 <= b < 123 for b in raw)
    return {
        "chars": math.log1p(len(raw)),
        "words": math.log1p(n),
        "word_chars": sum(map(len, words)) / n,
        "upper": sum(65 <= b < 91 for b in raw) / max(1, letters),
        "repeats": sum(a == b for a, b in zip(words, words[1:], strict=False)) / n,
        "top_word": max(counts.values()) / n,
        "kinds": len(counts) / n,
        "same_lines": 1 - len(set(lines)) / len(lines),
        "short_words": sum(len(w) < 4 for w in words) / n,
        "entropy": -sum(c / len(raw) * math.log(c / len(raw)) for c in Counter(raw).values()),
        "longest_word": math.log1p(max(map(len, words))),
        "line_words": n / len(lines),
    }


def test_quality_equals_brute_force(spark):
    """The registered query: every score is the sum of the model's entries, looked up one by one."""
    sf = "/root/testdata/sf0.001"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    model, texts = quality.train(docs, labels), {r.doc_id: r.text for r in docs.collect()}
    rows = catalogue.queries()["op3_quality"](spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        row = quality.features(texts[r.doc_id])
        want = plain_features(texts[r.doc_id])
        assert want is None or all(abs(row[quality.FEATURES.index(k)] - v) < 1e-9 for k, v in want.items())
        assert abs(r.score - plain_score(model, row)) < 1e-9 and r.predicted == (r.score >= 0.7)


def test_pairs_learn_an_interaction():
    rng = np.random.default_rng(0)
    rows = rng.random((4000, len(quality.FEATURES)))
    labels = ((rows[:, 2] > 0.5) ^ (rows[:, 5] > 0.5)).astype(float)
    model = quality.fit(rows, labels)
    assert (2, 5) in {(i, j) for i, j, _ in model.pairs} and ((model.score(rows) > 0.5) == labels).mean() > 0.95


# --- 4


def brute_contamination(docs, items):
    """Every window of every item's size (the whole text, if shorter), compared exactly."""
    out = {}
    for d, text in docs:
        words = dec.words_of(text)
        for i, item in items:
            have = dec.words_of(item)
            n = min(5, len(have))
            bag = lambda ws, n=n: Counter(tuple(ws[k : k + n]) for k in range(len(ws) - n + 1))
            if not have or len(words) < n:
                continue
            mine, size = bag(have), min(len(have), len(words))
            windows = (bag(words[a : a + size]) for a in range(len(words) - size + 1))
            sim, at = max((2 * (mine & w).total() / (mine.total() + w.total()), -a) for a, w in enumerate(windows))
            if sim >= 0.8:
                out[d, i] = (round(sim, 9), -at)
    return out


def test_contamination_equals_brute_force(spark):
    rng = random.Random(6)
    items = [(i, prose(rng, rng.choice((14, 20, 20, 37, 53)))) for i in range(12)] + [(20, "tiny one"), (21, None), (22, "..."), (23, "a b a b a b a b a b a b a b a b")]
    docs = []
    for i in range(60):
        text = prose(rng, rng.randint(0, 120)).split()
        if i % 3 == 0:
            part = items[i % 12][1].split()
            for _ in range(i % 4):
                part[rng.randrange(len(part))] = "changed"
            text[len(text) // 2 : len(text) // 2] = part
        docs.append((i, " ".join(text)))
    docs += [(80 + i, " ".join(items[i][1].split()[: -(i % 5) or None])) for i in range(12)]  # a little shorter than the item
    docs += [(95, items[5][1].replace(items[5][1].split()[3], "x") + " x x x x x x x"), (96, " ".join([*items[6][1].split()[:-2], *["x"] * 9]))]
    docs += [(70, "It is a TINY\n one, here"), (71, None), (72, ""), (73, items[3][1] + " " + items[4][1] + ". " + items[3][1]), (74, "x a b a b a b a b a b a b a b a b y"), (None, items[0][1].upper())]
    want = brute_contamination(docs, items)
    got = {(r.doc_id, r.item_id): (round(r.similarity, 9), r.word_start) for r in dec.contamination(frame(spark, docs), spark.createDataFrame([(*x, "k") for x in items], "item_id long, text string, doc_id string")).collect()}
    assert got == want and len(want) > 10
    kept = dec.clean(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(d for d, _ in docs if d is not None and not any(k[0] == d for k in want))
    assert kept.columns == ["doc_id", "text", "score", "quality", "item_id"]


def test_repeated_shingles_stay_within_the_radius():
    """A fifth of a bag may be one shingle many times, on either side: numbered, they are as far apart as different ones."""
    rng = random.Random(2)
    for _ in range(20):
        words = prose(rng, 84).split()
        item = [*words, *["same"] * 24]
        bench = dec.Benchmark([(1, " ".join(item)), (2, " ".join(words[:30] * 3))])
        for text in ([*words, *prose(rng, 24).split()], [*words, *["other"] * 24], [*words[:30] * 3][:-4]):
            want = brute_contamination([(0, " ".join(text))], [(1, " ".join(item)), (2, " ".join(words[:30] * 3))])
            assert {(0, m[0]): (round(m[1], 9), m[2]) for m in bench.matches(" ".join(text))} == want


def test_contamination_of_a_long_text():
    rng = random.Random(4)
    item = prose(rng, 40)
    bench = dec.Benchmark([(1, item)])
    text = prose(rng, 60_000) + " " + item + " " + prose(rng, 1000)
    assert bench.matches(text) == [(1, 1.0, 60_000, 40)] and bench.matches(("same " * 100_000)) == []
    assert [m[0] for m in bench.matches(" ".join([item] * 800))] == [1]


def test_items_in_several_passes(spark):
    """Rows of one item_id are told apart by their texts, so that no pass holds them all."""
    rng = random.Random(9)
    items = spark.createDataFrame([(7, prose(rng, 30)) for _ in range(40)], "item_id long, text string")
    sizes = [sum(map(len, b.sizes.values())) for b in dec.benchmarks(items, 1500)]
    assert sum(sizes) == 40 and len(sizes) > 3 and max(sizes) < 30


def test_contamination_empty(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    docs = frame(spark, [(1, "a b c d e f")])
    assert dec.contamination(docs, none).count() == 0 and dec.clean(docs, none).count() == 1
    assert dec.contamination(docs.limit(0), spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")).count() == 0


def test_hamming_index_finds_all_within_radius():
    rng = np.random.default_rng(2)
    prints = rng.integers(0, 256, (300, 32), np.uint8)
    near = prints[:200].copy()
    for row in near:
        for b in rng.choice(256, rng.integers(0, 110), replace=False):
            row[b // 8] ^= 1 << (b % 8)
    got = set(zip(*(x.tolist() for x in dec.HammingIndex(prints).within(near)), strict=True))
    apart = np.bitwise_count(near[:, None, :] ^ prints[None, :, :]).sum(-1)
    assert got == set(zip(*(x.tolist() for x in np.nonzero(apart <= dec.RADIUS)), strict=True)) and len(got) > 50


# --- 5


@pytest.fixture(scope="module")
def encoder():
    return token_counts.Encoder.read(token_counts.VOCABULARY)


def test_tokens_equal_brute_force(encoder):
    rng = random.Random(8)
    crossed = 0
    for _ in range(60):
        text = "".join(rng.choice(("word", " ", "\n", "\n\n", " é", "日本", "\t", "  ", "x.", "\r\n", "🙂")) for _ in range(rng.randint(1, 80)))
        start, end, tokens, crossing = token_counts.section_tokens(text, encoder)
        assert [text[a:b] for a, b in zip(start, end, strict=True)] == re.findall(r"[^\n]*\n|[^\n]+", text)
        assert "".join(text[a:b] for a, b in zip(start, end, strict=True)) == text
        lines = re.findall(r"[^\n]*\n|[^\n]+", text)
        owner = [k for k, line in enumerate(lines) for _ in line.encode()]
        want, across, at = [0] * len(lines), [0] * len(lines), 0
        for t in encoder.encoding.encode_ordinary(text):
            held = Counter(owner[at : at + int(encoder.lengths[t])])
            at += int(encoder.lengths[t])
            k = min(held, key=lambda s: (-held[s], s))
            want[k] += 1
            across[k] += len(held) > 1
        assert tokens.tolist() == want and crossing.tolist() == across
        crossed += sum(across)
    assert crossed > 0


def test_token_rows(spark, encoder):
    docs = frame(spark, [(1, "One two.\n\nThree"), (2, None), (3, ""), (None, "x"), (4, "a" * 100_000), (1, "One two.\n\nThree")])
    got = sorted(((r.doc_id, r.section, r.char_start, r.char_end, r.tokens) for r in token_counts.token_counts(docs).collect()), key=str)
    known = {v: k.decode("utf-8", "replace") for k, v in encoder.ranks.items()}
    assert [known[t] for t in encoder.encoding.encode_ordinary("One two.\n\nThree")] == ["One", " two", ".", "\n", "\n", "Three"]
    # The break after the full stop ends the first line.
    assert [g for g in got if g[0] == 1] == [(1, 0, 0, 9, 4)] * 2 + [(1, 1, 9, 10, 1)] * 2 + [(1, 2, 10, 15, 1)] * 2
    assert (2, 0, 0, 0, 0) in got and (3, 0, 0, 0, 0) in got and any(g[0] is None for g in got)
    assert token_counts.token_counts(docs.limit(0)).count() == 0


def test_long_runs_of_blanks(encoder):
    """The same tokens as in one go where the engine can do it, and an answer where it can't."""
    rng = random.Random(5)
    for _ in range(40):
        text = "".join(rng.choice((" " * 1500, "\n" * 2000, " \n" * 900, "\u3000" * 1200, "\x1c" * 1500, "\t", " ", "word", "x.", "\x85", "7", "'s")) for _ in range(rng.randint(1, 9)))
        assert encoder.tokens(text) == encoder.encoding.encode_ordinary(text)
    tokens = encoder.tokens(" " * 2_000_000 + "a")
    assert b"".join(encoder.encoding.decode_tokens_bytes(tokens)) == b" " * 2_000_000 + b"a"
    start, end, tokens, crossing = token_counts.section_tokens("\n" * 300_000 + " " * 1_000_000 + "end", encoder)
    assert len(tokens) == 300_001 and end[-1] == 1_300_003


# --- 6


@pytest.fixture(scope="module")
def net():
    return html_text.trained()


def test_gradients_by_differences():
    small = html_text.Labeller(1)
    rng = np.random.default_rng(1)
    pages = [rng.standard_normal((n, html_text.DIM)).astype(np.float32) / 4 for n in (3, 5)]
    labels = [np.array([1, 0, 1], np.float32), np.array([0, 0, 1, 1, 0], np.float32)]
    grads = small.gradients(pages, labels)

    def loss():
        p = np.concatenate(small.scores(pages)).astype(np.float64)
        y = np.concatenate(labels)
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()

    for name in ("xf", "hf", "cb", "hb", "o", "q"):
        w = small.p[name]
        i = np.unravel_index(np.argmax(np.abs(grads[name])), w.shape)
        old = w[i]
        w[i] = old + 1e-2
        up = loss()
        w[i] = old - 1e-2
        down = loss()
        w[i] = old
        assert abs((up - down) / 2e-2 - grads[name][i]) < 0.03 * abs(grads[name][i]) + 1e-4, name


def test_held_out_blocks(net):
    right = total = 0
    for page in html_text.training_pages(150, 4242):
        found, want = html_text.labelled(page)
        got = net.scores([html_text.vectors(found)])[0] >= 0.5
        right, total = right + (got == want).sum(), total + len(want)
    assert right / total > 0.98


def test_leaves():
    page = "<html><head><title>T &amp; U</title><script>if (a < b) x = '</p>'</script></head><body><!-- no --><p>One<b>two</b>\n three<br>four<p>Five &eacute;&#33;<ul><li><a href='x>y'>Six</a><li>Seven</ul>tail <div"
    assert [(x.path[-1], x.text) for x in html_text.leaves(page)] == [("title", "T & U"), ("p", "Onetwo three four"), ("p", "Five é!"), ("li", "Six"), ("li", "Seven"), ("body", "tail")]
    assert [x.linked for x in html_text.leaves(page)] == [0, 0, 0, 1, 0, 0]
    assert html_text.leaves(None) == html_text.leaves("") == html_text.leaves("<p> <br></p>") == []


def test_markup_never_leaks():
    text = lambda page: [x.text for x in html_text.leaves(page)]
    assert text("<p title=it's>Hello one</p><p>two</p>") == ["Hello one", "two"]
    assert text("<p title='a>b' x=\"c>d\">one</p>") == ["one"]
    assert text('<p title="never closed>one</p><p>two</p>') == ["one", "two"]
    assert text("<p \"stray\" 'x>one") == ["one"] and text("<p a = b / c=/x/ ><a href=/x/y>one</a>") == ["one"]
    assert text("a<!-->b<!-- x > y -->c<!--->d</ no>e</>f<?php x ?>g") == ["abcdefg"]
    assert text("<script>if (a</b) '</p>'</script x>one<style>p{}</style><textarea><b>no</textarea>") == ["one"]
    assert text("<p>one<noscript>two</noscript> <svg><text>three</text></svg> <object>four</object> <math>x</math>") == ["onetwo three four x"]
    assert text("1 < 2 and <3 <") == ["1 < 2 and <3 <"] and text("one <b") == ["one"]


def test_odd_pages_take_no_longer(net):
    """Deep nesting, closing tags that open nothing, and tags that never end: linear time, no text lost."""
    deep = "".join(f"<div class=c{i % 50}>w{i}" for i in range(20_000))
    found = html_text.leaves(deep)
    assert [x.text for x in found] == [f"w{i}" for i in range(20_000)] and max(len(x.path) for x in found) <= 2 * html_text.PATH_ENDS
    assert [x.text for x in html_text.leaves("<b>" * 20_000 + "x" + "</i>" * 20_000)] == ["x"]
    assert [x.text for x in html_text.leaves("<p>one</p>" + "<a " * 30_000)] == ["one"]


def slow_scores(net, rows):
    """The network leaf by leaf, in plain Python over numpy scalars."""
    n, h = len(rows), html_text.HIDDEN
    sig = lambda x: 1 / (1 + math.exp(-min(30.0, max(-30.0, x))))
    total = [float(net.p["q"][0])] * n
    for k, d in enumerate("fb"):
        x, r, b = (net.p[f"{name}{d}"].astype(float).tolist() for name in "xhc")
        hid, cell = [0.0] * h, [0.0] * h
        for t in range(n) if d == "f" else range(n - 1, -1, -1):
            z = list(b)
            for i, v in enumerate(rows[t].tolist()):
                if v:
                    z = [a + v * w for a, w in zip(z, x[i], strict=True)]
            for i, v in enumerate(hid):
                z = [a + v * w for a, w in zip(z, r[i], strict=True)]
            cell = [sig(z[h + j]) * cell[j] + sig(z[j]) * math.tanh(z[2 * h + j]) for j in range(h)]
            hid = [sig(z[3 * h + j]) * math.tanh(cell[j]) for j in range(h)]
            total[t] += sum(v * float(net.p["o"][k * h + j, 0]) for j, v in enumerate(hid))
    return [sig(v) for v in total]


class Blocks(HTMLParser):
    """Another way to cut a well-formed page into blocks: the library's parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.run, self.off = [], [], 0

    def handle_starttag(self, tag, attrs):
        self.off += tag in ("script", "style")
        if tag in html_text.BLOCK_TAGS:
            self.flush()
        if tag == "br":
            self.run.append(" ")

    def handle_endtag(self, tag):
        self.off -= tag in ("script", "style")
        if tag in html_text.BLOCK_TAGS:
            self.flush()

    def handle_data(self, data):
        if not self.off:
            self.run.append(data)

    def flush(self):
        if text := " ".join("".join(self.run).split()):
            self.out.append(text)
        self.run = []


def test_extraction_equals_plain_python(net):
    pages = list(html_text.training_pages(40, 99))
    texts = html_text.main_texts(pages, net)
    for page, text in zip(pages, texts, strict=True):
        parser = Blocks()
        parser.feed(page)
        parser.flush()
        cut = html_text.leaves(page)
        assert [x.text for x in cut] == parser.out
        scores = slow_scores(net, html_text.vectors(cut))
        assert text == "\n".join(x.text for x, s in zip(cut, scores, strict=True) if s >= 0.5)


def test_long_page_in_pieces(net):
    page = "<article>" + "".join(f"<p>Sentence number {i} of it.</p>" for i in range(700)) + "</article><footer>me</footer>"
    cut = html_text.leaves(page)
    whole, pieces = net.scores([html_text.vectors(cut)])[0], net.long_scores(cut, 64)
    assert np.allclose(whole, pieces, atol=1e-5)
    many = "<nav><a href=/>home</a></nav><article><h1>A day.</h1>" + "<p>It was a <b>long</b> day." * 30_000 + "</article>"
    cut = html_text.leaves(many)
    whole = net.scores([html_text.vectors(cut)])[0]
    text = html_text.main_texts([many, page], net)[0]
    assert len(cut) == 30_002 and text == "\n".join(x.text for x, y in zip(cut, whole, strict=True) if y >= 0.5)
    assert text.count("\n") > 29_900 and "home" not in text


def test_extract(spark, net):
    story = "<article><h1>Head line</h1><p>First   part &amp; more.<p>Second\npart.</p></article>"
    page = f'<html><head><title>t</title></head><body><nav><ul><li><a href="/a">Home</a></li></ul></nav><div class="ad">Buy now.</div>{story}<footer>&copy; me</footer></body></html>'
    rows = [(1, "u", page, "t"), (2, None, None, ""), (3, "u", "", ""), (None, "u", page, ""), (4, "u", page.replace("Second", "w " * 40_000), "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = {r.page_id: r for r in html_text.extract(df).collect()}
    assert got[1].text == got[None].text == "Head line\nFirst part & more.\nSecond part." and got[1].n_chars == len(got[1].text)
    assert got[2].text == got[3].text == "" and got[4].n_chars > 80_000
    assert html_text.extract(df.limit(0)).count() == 0


# --- 7

MIT = """MIT License

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
"""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License."""


def test_licence_rules(spark):
    cases = {
        MIT: ["MIT"],
        "before it\n" + APACHE: ["Apache-2.0"],
        "words words\nAll rights reserved.": ["LicenseRef-all-rights-reserved"],
        "Some text. Licensed under CC BY-NC 4.0. More.\nReleased under the MIT License.": ["CC-BY-NC-4.0", "MIT"],
        "This work is licensed under the GNU General Public License, version 3.": ["GPL-3.0-only"],
        "we mention the MIT License and all rights reserved here": [],
        "": [],
        None: [],
        "\n".join(["* All rights reserved."] * 3): ["LicenseRef-all-rights-reserved"] * 3,
    }
    for text, want in cases.items():
        found = licenses.matches(text)
        assert [m[0] for m in found] == want, text
        assert all(0 <= a < b <= len(text) for _, _, a, b, _ in found)
    assert licenses.matches(MIT)[0][4] == 4 and licenses.matches("a b. " + APACHE)[0][1] == "apache-2-header"
    rows = list(enumerate(cases))
    got = licenses.license_scan(frame(spark, rows + [(None, MIT), (0, MIT)])).collect()
    assert sorted((str(r.doc_id), r.license) for r in got) == sorted([(str(i), x) for i, t in rows for x in cases[t]] + [("None", "MIT"), ("0", "MIT")])
    assert licenses.license_scan(frame(spark, rows).limit(0)).count() == 0


def brute_licences(text):
    """All spans of words against all known sentences, then all rules at all places."""
    words = [(m.start(), m.end(), m[0].lower()) for m in re.finditer(r"[^\W_]+", text)]
    stop = lambda a, b: re.search(r"[.!?](?=\s|\Z)|\n", text[a:b] + ("" if b == len(text) else "x")) is not None

    def opens(i):
        if i == 0 or stop(words[i - 1][1], words[i][0]):
            return True
        gap, before = text[words[i - 1][1] : words[i][0]], words[i - 1][2]
        return gap.startswith(")") and before.isdigit() and len(before) <= 2 and opens(i - 1)

    longest = max(len(k.split()) for k in licenses.KNOWN)
    found, at = [], 0
    while at < len(words):
        ends = [j for j in range(at, min(at + longest, len(words))) if opens(at) and " ".join(w[2] for w in words[at : j + 1]) in licenses.KNOWN and (j + 1 == len(words) or stop(words[j][1], words[j + 1][0]))]
        if ends:
            found.append((words[at][0], words[ends[-1]][1], licenses.KNOWN[" ".join(w[2] for w in words[at : ends[-1] + 1])]))
        at = ends[-1] + 1 if ends else at + 1
    out, at = [], 0
    while at < len(found):
        fit = [(-len(ids), rule) for rule, (_, ids) in licenses.ALL_RULES.items() if [x[2] for x in found[at : at + len(ids)]] == list(ids) and all(found[k + 1][0] - found[k][1] <= licenses.GAP + 1 for k in range(at, at + len(ids) - 1))]
        if fit:
            size, rule = min(fit)
            out.append((rule, found[at][0], -size))
        at -= min(fit, default=(-1, ""))[0]
    return out


def test_licences_equal_brute_force():
    rng = random.Random(3)
    known = [x for several in licenses.SENTENCES.values() for x in several] + [x for _, x in licenses.notices()]
    rules = [ids for _, ids in licenses.ALL_RULES.values()]
    hits = Counter()
    for _ in range(150):
        parts = []
        for _ in range(rng.randint(1, 8)):
            kind = rng.random()
            if kind < 0.4:
                parts += [rng.choice(licenses.SENTENCES[i]) for i in rng.choice(rules) if i in licenses.SENTENCES]
            elif kind < 0.7:
                parts.append(rng.choice(known))
            else:
                parts.append(prose(rng, rng.choice((1, 5, 700))) + rng.choice((".", "", ":")))
        text = "".join(rng.choice((p, p.upper(), p.replace(" ", "  \n "), "* " + p, "1) " + p, "(2) " + p, p[:-1])) + rng.choice((" ", "\n", "\n\n", "\t")) for p in parts)
        got = [(rule, a, n) for _, rule, a, _, n in licenses.matches(text)]
        assert got == brute_licences(text), text
        hits.update(rule for rule, _, _ in got)
    assert len(hits) > 30


def test_common_headers():
    hope = licenses.SENTENCES["gpl-hope"][0]
    gpl2 = "// " + licenses.SENTENCES["gpl2-free"][0].replace("software;", "software;\n//") + "\n//\n// " + hope
    cases = {
        gpl2: ["GPL-2.0-or-later"],
        "/* This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy of the MPL was not distributed with this\n * file, You can obtain one at https://mozilla.org/MPL/2.0/. */": ["MPL-2.0"],
        "# SPDX-License-Identifier: AGPL-3.0-only\nimport os": ["AGPL-3.0-only"],
        "This is free and unencumbered software released into the public domain.": ["Unlicense"],
        "This work is licensed under a Creative Commons Attribution-ShareAlike 3.0 Unported License.": ["CC-BY-SA-3.0"],
        "Distributed under the Boost Software License, Version 1.0.\n": ["BSL-1.0"],
        "Licensed under the MIT License and more words follow here": [],
        licenses.SENTENCES["bsd-grant"][0] + " x" * 1500 + ".\n" + licenses.SENTENCES["bsd-source"][0] + licenses.SENTENCES["bsd-binary"][0]: [],
    }
    for text, want in cases.items():
        assert [m[0] for m in licenses.matches(text)] == want, text


def test_very_long_texts_and_padded_sentences():
    """No sentence is too long to be seen, and no text takes more than linear time."""
    padded = "Licensed   under" + " " * 100_000 + "the\nMIT ---- License" + "\t" * 50_000 + "."
    assert [m[0] for m in licenses.matches("x\n" * 200_000 + padded)] == ["MIT"]
    assert licenses.matches("the " * 300_000 + "\n" * 300_000 + "this. " * 100_000 + ") " * 100_000) == []
