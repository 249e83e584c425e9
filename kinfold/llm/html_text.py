"""Operator 6: main text of web pages by a recurrent block labeller.

A page is cut into leaves, runs of text between block-level tags. Each leaf is
read as a vector of its hashed tag path and of its hashed words; a
bidirectional LSTM in numpy runs over the whole sequence of leaves, so that
every leaf is labelled in the context of the whole page. The network is trained
here, on pages made by ``training_pages`` whose blocks are known.
"""

from __future__ import annotations

import html as entities
import random
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Tags that begin and end blocks, tags without content, and scripts, styles and form fields, whose content is no text.
BLOCK_TAGS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead title tr ul".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW_TAGS = frozenset("script style textarea".split())
#: What an opening tag closes if it is open, up to the nearest of the tags after it.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}), "body": ({"head"}, {"html"})}
#: Quotes count only around a value, as in HTML; one that nothing closes is an ordinary character.
ATTRIBUTE = r"""[^\s"'>/=][^\s>/=]*(?:\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'>][^\s>]*))?"""
COMMENT = r"<!--(?:-?>|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|</(?![a-zA-Z])[^>]*>"
TAG = re.compile(rf"""{COMMENT}|<(/?)([a-zA-Z][^\s/>]*)((?:[\s/]+|{ATTRIBUTE}|["'=])*+)>""", re.S)
#: Elements deeper than this are placed beside their parents, as browsers do; their text stays.
DEPTH = 256
#: Of a longer path so many outer and inner elements are read as features.
PATH_ENDS = 16
NAMES = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
PARTS = re.compile(r"[a-z]+|\d+")


class Leaf(NamedTuple):
    path: tuple[str, ...]
    text: str
    linked: float  # share of the characters that lie in links


def leaves(page: str | None) -> list[Leaf]:
    """The blocks of text of a page, in order, with character references decoded and white space made single."""
    page = page or ""
    last = page.rfind(">") + 1  # no tag ends behind it
    stack: list[tuple[str, str]] = []
    held: Counter[str] = Counter()  # open elements by tag
    paths: dict[tuple[str, ...], tuple[str, ...]] = {}  # equal paths are kept once
    out: list[Leaf] = []
    run: list[str] = []
    links = [0, 0, 0]  # links open, characters in links, characters

    def flush() -> None:
        text = " ".join(entities.unescape("".join(run)).split())
        if text:
            ends = stack if len(stack) <= 2 * PATH_ENDS else stack[:PATH_ENDS] + stack[-PATH_ENDS:]
            path = tuple(e[1] for e in ends)
            out.append(Leaf(paths.setdefault(path, path), text, links[1] / max(1, links[2])))
        run.clear()
        links[1:] = 0, 0

    def say(text: str) -> None:
        if text:
            run.append(text)
            size = len(text.strip())
            links[2] += size
            links[1] += size if links[0] else 0

    def pop(to: int) -> None:
        links[0] -= sum(e[0] == "a" for e in stack[to:])
        held.subtract(e[0] for e in stack[to:])
        del stack[to:]

    at = 0
    while m := TAG.search(page, at, last) if at < last else None:
        say(page[at : m.start()])
        at = m.end()
        if m[0].startswith("<![CDATA["):
            say(entities.escape(m[0][9:].removesuffix("]]>")))
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag in BLOCK_TAGS:
                flush()
            to = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), None) if held[tag] else None
            if to is not None and (tag in BLOCK_TAGS or not any(e[0] in BLOCK_TAGS for e in stack[to + 1 :])):
                pop(to)
            continue
        if tag == "br":
            say(" ")
        if tag in RAW_TAGS and not m[3].rstrip().endswith("/"):
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if tag in BLOCK_TAGS:
            flush()
            shut, stop = CLOSES.get(tag, ({"p"}, {"article", "aside", "body", "div", "main", "section", "td", "th", "li", "blockquote", "form", "header", "footer", "nav"}))
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in stop:
                    break
                if stack[i][0] in shut:
                    pop(i)
                    if tag != "tr":
                        break
        if tag in VOID_TAGS:
            continue
        if len(stack) >= DEPTH:
            pop(DEPTH - 1)
        names = " ".join(x for found in NAMES.findall(m[3]) for x in found).lower()
        stack.append((tag, tag + "".join(f".{p}" for p in PARTS.findall(names))))
        held[tag] += 1
        links[0] += tag == "a"
    cut = re.compile(r"<[a-zA-Z/!?]").search(page, max(at, last))  # a tag that never ends
    say(page[at : cut.start()] if cut else page[at:])
    flush()
    return out


PATH_DIM, WORD_DIM, MORE_DIM, HIDDEN = 256, 32, 6, 24
DIM = PATH_DIM + WORD_DIM + MORE_DIM


@lru_cache(maxsize=1 << 14)
def path_vector(path: tuple[str, ...]) -> np.ndarray:
    """Signed hashes of the tags and names on the path, the innermost element once more by itself."""
    out = np.zeros(PATH_DIM, np.float32)
    tokens = {t for element in path for t in (element, *(f".{n}" for n in element.split(".")[1:]))}
    for token in sorted(tokens | {f"last {path[-1].split('.')[0]}" if path else "none"}):
        h = zlib.crc32(token.encode())
        for part in (h, h >> 16):  # two places each, so that tokens that share one differ in the other
            out[part % PATH_DIM] += 1 if part >> 12 & 1 else -1
    return out


def vectors(page: list[Leaf], first: int = 0, end: int | None = None) -> np.ndarray:
    """One row for each leaf from ``first`` to ``end`` of a page."""
    end = len(page) if end is None else end
    out = np.zeros((end - first, DIM), np.float32)
    for row, i in zip(out, range(first, end), strict=True):
        leaf = page[i]
        words = leaf.text.lower().split()
        bag = np.bincount(np.fromiter((zlib.crc32(w.encode("utf-8", "replace")) % WORD_DIM for w in words), np.int64, len(words)), minlength=WORD_DIM)
        row[:PATH_DIM] = path_vector(leaf.path)
        row[PATH_DIM : PATH_DIM + WORD_DIM] = bag / np.sqrt((bag * bag).sum()) / 4  # light: names of parts say more than words
        row[PATH_DIM + WORD_DIM :] = np.log1p(len(leaf.text)) / 5, leaf.linked, i / len(page), 1 - i / len(page), leaf.text[-1] in ".!?", len(leaf.path) / 10
    return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """Forward and backward LSTM over leaf vectors and a logistic output."""

    def __init__(self, seed: int) -> None:
        rng = np.random.default_rng(seed)
        draw = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        self.p: dict[str, np.ndarray] = {}
        for d in "fb":
            self.p |= {f"x{d}": draw(DIM, 4 * HIDDEN), f"h{d}": draw(HIDDEN, 4 * HIDDEN), f"c{d}": np.zeros(4 * HIDDEN, np.float32)}
            self.p[f"c{d}"][HIDDEN : 2 * HIDDEN] = 1  # remember at first
        self.p |= {"o": draw(2 * HIDDEN, 1), "q": np.zeros(1, np.float32)}

    def run(self, x: np.ndarray, d: str, state: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, tuple]:
        """Hidden states of one direction over x (time, page, DIM), from a state or from none, and what learning needs."""
        steps, pages, _ = x.shape
        gates = (x.reshape(-1, DIM) @ self.p[f"x{d}"] + self.p[f"c{d}"]).reshape(steps, pages, -1)
        h, c = state or (np.zeros((pages, HIDDEN), np.float32),) * 2
        hs, cs = np.zeros((2, steps + 1, pages, HIDDEN), np.float32)
        recur = self.p[f"h{d}"]
        for t in range(steps):
            z = gates[t]
            z += h @ recur
            z[:, : 2 * HIDDEN] = sigmoid(z[:, : 2 * HIDDEN])
            z[:, 2 * HIDDEN : 3 * HIDDEN] = np.tanh(z[:, 2 * HIDDEN : 3 * HIDDEN])
            z[:, 3 * HIDDEN :] = sigmoid(z[:, 3 * HIDDEN :])
            c = z[:, HIDDEN : 2 * HIDDEN] * c + z[:, :HIDDEN] * z[:, 2 * HIDDEN : 3 * HIDDEN]
            h = z[:, 3 * HIDDEN :] * np.tanh(c)
            hs[t + 1], cs[t + 1] = h, c
        return hs[1:], (x, gates, hs, cs)

    def learn(self, kept: tuple, dh_out: np.ndarray, d: str, grads: dict[str, np.ndarray]) -> None:
        x, gates, hs, cs = kept
        steps, pages, _ = x.shape
        dz = np.empty_like(gates)
        dh = dc = np.zeros((pages, HIDDEN), np.float32)
        for t in range(steps - 1, -1, -1):
            i, f, g, o = np.split(gates[t], 4, axis=1)
            dh = dh + dh_out[t]
            th = np.tanh(cs[t + 1])
            dc = dc + dh * o * (1 - th * th)
            dz[t] = np.concatenate((dc * g * i * (1 - i), dc * cs[t] * f * (1 - f), dc * i * (1 - g * g), dh * th * o * (1 - o)), axis=1)
            dh, dc = dz[t] @ self.p[f"h{d}"].T, dc * f
        flat = dz.reshape(-1, 4 * HIDDEN)
        grads[f"x{d}"], grads[f"h{d}"], grads[f"c{d}"] = x.reshape(-1, DIM).T @ flat, hs[:-1].reshape(-1, HIDDEN).T @ flat, flat.sum(0)

    @staticmethod
    def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pages as (time, page, DIM), which places are real, and the order that turns each page round."""
        lengths = np.array([len(p) for p in pages])
        steps = lengths.max()
        x = np.zeros((steps, len(pages), DIM), np.float32)
        for b, p in enumerate(pages):
            x[: len(p), b] = p
        t = np.arange(steps)[:, None]
        return x, t < lengths, np.where(t < lengths, lengths - 1 - t, t)

    def scores(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """Probability of each leaf of each page to be main text."""
        if not pages:
            return []
        x, real, turn = self.padded(pages)
        there = self.run(x, "f")[0]
        back = np.take_along_axis(self.run(np.take_along_axis(x, turn[:, :, None], 0), "b")[0], turn[:, :, None], 0)
        y = sigmoid(np.concatenate((there, back), axis=2) @ self.p["o"] + self.p["q"])[:, :, 0]
        return [y[r, b] for b, r in enumerate(real.T)]

    def long_scores(self, page: list[Leaf], piece: int) -> np.ndarray:
        """As ``scores`` for one page, with the state carried through pieces of it; a leaf keeps one number of each direction."""
        sums = np.full(len(page), self.p["q"][0], np.float32)
        starts = range(0, len(page), piece)
        for d, order in (("f", starts), ("b", reversed(starts))):
            turn = slice(None, None, -1 if d == "b" else 1)
            weights = self.p["o"][:HIDDEN, 0] if d == "f" else self.p["o"][HIDDEN:, 0]
            state = None
            for at in order:
                end = min(at + piece, len(page))
                hidden, (_, _, hs, cs) = self.run(vectors(page, at, end)[turn, None, :], d, state)
                state = hs[-1], cs[-1]
                sums[at:end] += (hidden[:, 0] @ weights)[turn]
        return sigmoid(sums)

    def gradients(self, pages: list[np.ndarray], labels: list[np.ndarray]) -> dict[str, np.ndarray]:
        """Gradients of the mean log loss."""
        x, real, turn = self.padded(pages)
        there, keep_f = self.run(x, "f")
        back, keep_b = self.run(np.take_along_axis(x, turn[:, :, None], 0), "b")
        both = np.concatenate((there, np.take_along_axis(back, turn[:, :, None], 0)), axis=2)
        want = np.zeros(real.shape, np.float32)
        for b, y in enumerate(labels):
            want[: len(y), b] = y
        dy = ((sigmoid(both @ self.p["o"] + self.p["q"])[:, :, 0] - want) * real / real.sum())[:, :, None].astype(np.float32)
        grads = {"o": both.reshape(-1, 2 * HIDDEN).T @ dy.reshape(-1, 1), "q": dy.sum((0, 1))}
        dh = dy * self.p["o"][:, 0]
        self.learn(keep_f, dh[:, :, :HIDDEN], "f", grads)
        self.learn(keep_b, np.take_along_axis(dh[:, :, HIDDEN:], turn[:, :, None], 0), "b", grads)
        return grads


# Training pages. Names that page authors give to parts, and words of boilerplate.
MAIN_NAMES = ("content", "main", "post", "entry-content", "article-body", "story", "text", "body-text", "post-content", "page-content", "")
OTHER_PARTS = {
    "menu": ("menu", "nav", "navbar", "breadcrumb", "breadcrumbs", "toc", "pagination", "tabs", "skip-link"),
    "header": ("header", "masthead", "top", "site-header", "topbar", "logo", "branding"),
    "footer": ("footer", "site-footer", "bottom", "copyright", "legal", "colophon"),
    "side": ("sidebar", "side", "related", "widget", "recommended", "trending", "popular", "tags", "share", "social", "author-box", "most-read"),
    "ad": ("ad", "ads", "advert", "advertisement", "banner", "sponsored", "promo", "sponsor", "ad-slot"),
    "notice": ("cookie", "cookies", "consent", "gdpr", "notice", "alert", "newsletter", "subscribe", "popup", "modal", "cookie-banner", "paywall"),
    "form": ("form", "search", "login", "signup", "contact", "search-form"),
    "comments": ("comments", "comment", "comment-list", "commentlist", "discussion", "disqus", "reply", "responses", "reviews"),
}
OTHER_TAGS = {"menu": ("nav", "div", "ul", "nav"), "header": ("header", "div", "header"), "footer": ("footer", "div", "footer"), "side": ("aside", "div", "section", "aside"), "ad": ("div", "aside", "section", "div"), "notice": ("div", "section", "p", "dialog"), "form": ("form", "div"), "comments": ("section", "div", "ol", "div")}
#: A private character that stands before the sentences of main blocks in training pages.
MARK = "\ue000"
OTHER_WORDS = {"menu": "home about news contact more", "header": "welcome sign in", "footer": "© all rights reserved privacy terms", "side": "related popular read more share", "ad": "buy now offer sponsored free", "notice": "we use cookies accept subscribe to our newsletter", "form": "name email search send", "comments": "reply says wrote ago great"}


def training_pages(count: int, seed: int) -> Iterator[str]:
    """Pages as varied as authors write them, with MARK in every main block."""
    rng = random.Random(seed)
    pick, chance = rng.choice, rng.random
    numbers = iter(range(10**9))
    mark = ""

    def sentence(extra: str = "", least: int = 1, most: int = 30) -> str:
        words = ["".join(pick("bcdfghlmnprstvwz") + pick("aeiouéäó") for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(least, most))]
        if chance() < 0.15:
            words = [w + pick(("***", "###", "&amp;&amp;", "%%%", " |", "!!")) for w in words]
        if chance() < 0.1:
            words = [w.upper() for w in words]
        if chance() < 0.06:
            words = words[:1] * len(words)
        if extra:
            words[: rng.randint(0, 2)] = rng.sample(extra.split(), k=min(2, len(extra.split())))
        return mark + (" ".join(words).capitalize() if chance() < 0.8 else " ".join(words)) + pick((".", ".", "!", "?", "", ","))

    def inline(text: str) -> str:
        return text if chance() < 0.7 else f"{text} <{(t := pick(('b', 'i', 'em', 'strong', 'a', 'span', 'code')))}{' href="/x"' if t == 'a' else ''}>{sentence(most=4)}</{t}> {sentence(most=6)}"

    def named(tag: str, names: tuple[str, ...] | None, inside: str, often: float = 0.5) -> str:
        name = pick(names) if names and (tag == "div" or chance() < often) else ""
        more = f" {pick(('wrap', 'box', 'col', 'x1', 'block'))}" if name and chance() < 0.25 else ""
        attribute = f' {pick(("class", "class", "id"))}="{name}{more}"' if name else ""
        return f"<{tag}{attribute}>{inside}" + ("" if tag == "p" and chance() < 0.3 else f"</{tag}>")

    def other(kind: str) -> str:
        words = OTHER_WORDS[kind]
        text = lambda: " ".join(sentence(words if chance() < 0.4 else "", most=pick((3, 8, 25))) for _ in range(pick((1, 1, 2, 3))))
        link = lambda: f'<a href="/{next(numbers)}">{sentence(most=pick((1, 1, 3)))}</a>'
        items = lambda f: "".join(f"<li>{f()}</li>" for _ in range(rng.randint(1, 7)))
        inside = {
            "menu": lambda: pick((lambda: f"<ul>{items(link)}</ul>", lambda: " ".join(link() for _ in range(rng.randint(1, 6))), lambda: "".join(f"<div>{link()}</div>" for _ in range(3))))(),
            "form": lambda: f"<label>{text()}</label><input name=q><select><option>{sentence(most=1)}<option>{sentence(most=1)}</select><button>{sentence(most=2)}</button>",
            "comments": lambda: "".join(pick((f"<p>{text()}</p>", f"<li>{text()}</li>", f'<div class="comment"><b>{sentence(most=2)}</b><p>{text()}</p></div>')) for _ in range(rng.randint(1, 5))),
        }.get(kind, lambda: pick((text, lambda: f"<p>{text()}</p>", lambda: f"<h3>{sentence(words, most=3)}</h3><ul>{items(link)}</ul>", lambda: f"&copy; {pick((sentence(most=2), "www.site.example"))} &middot; {text()}", lambda: f"<p>{text()}</p><p>{link()}</p>"))())()
        return named(pick(OTHER_TAGS[kind]), OTHER_PARTS[kind], inside)

    def main_block() -> str:
        return pick((
            lambda: f"<p>{inline(sentence(most=60))}" + pick(("</p>", "</p>", "<br>")),
            lambda: f"<p>{' '.join(sentence() for _ in range(rng.randint(1, 6)))}</p>",
            lambda: f"<p>{sentence(most=2)}</p>",
            lambda: f"<p><b>{sentence()}<br>",
            lambda: f"<p><b>{' '.join([sentence(), sentence()] * rng.randint(1, 30))}<br>",
            lambda: f"<p>{' '.join([sentence(), sentence()] * rng.randint(1, 60))}</p>",
            lambda: f"<h{(n := rng.randint(2, 4))}>{sentence(most=8)}</h{n}>",
            lambda: f"<ul>{''.join(f'<li>{inline(sentence())}</li>' for _ in range(rng.randint(1, 5)))}</ul>",
            lambda: f"<blockquote>{sentence()}</blockquote>",
            lambda: f"<pre>{sentence()}\n{sentence()}</pre>",
            lambda: f"<table><tr><th>{sentence(most=2)}</th><td>{sentence(most=4)}</td></tr></table>",
            lambda: f"<figure><img src=x><figcaption>{sentence()}</figcaption></figure>",
            lambda: f"<div>{sentence(most=40)}</div>",
        ))()

    for _ in range(count):
        title = sentence(most=9)
        mark = MARK
        inner = [f"<h1>{mark}{title}</h1>" if chance() < 0.9 else main_block()]
        for _ in range(pick((0, 1, 1, 1, 2, 3, 5, 8, 14))):
            mark = MARK if chance() < 0.92 else ""
            inner.append(main_block() if mark else other(pick(("ad", "notice", "side", "form", "ad"))))
        mark = ""
        if chance() < 0.15:
            inner.append(other("comments"))
        body = "".join(inner)
        style = chance()
        if style < 0.6:
            body = named("article", MAIN_NAMES, body, 0.2)
        elif style < 0.72:
            body = named("main", MAIN_NAMES, body, 0.3)
        elif style < 0.97:
            body = f'<div {pick(("class", "id"))}="{pick(MAIN_NAMES[:-1])}">{body}</div>'
        if chance() < 0.2:
            body = named(pick(("div", "main", "section")), ("wrapper", "container", "page", "row", "content"), body)
        before = [other(k) for k in ("notice", "header", "menu", "ad", "side") if chance() < (0.85 if k == "menu" else 0.4)]
        after = [other(k) for k in ("comments", "side", "ad", "form", "notice", "footer") if chance() < (0.85 if k == "footer" else 0.2)]
        head = f'<head><meta charset="utf-8"><title>{title}</title><style>p{{margin:0}}</style><script>var t="</p>";</script></head>'
        end = "</body></html>" if chance() < 0.9 else ""
        yield f"<!DOCTYPE html><html>{head}<body>{''.join(before)}<!-- c -->{body}{''.join(after)}{end}"


def labelled(page: str) -> tuple[list[Leaf], np.ndarray]:
    """Leaves of a training page without the marks, and whether each was marked."""
    found = [(Leaf(x.path, x.text.replace(MARK, "").strip(), x.linked), MARK in x.text) for x in leaves(page)]
    found = [(leaf, main) for leaf, main in found if leaf.text]
    return [leaf for leaf, _ in found], np.array([main for _, main in found], np.float32)


@lru_cache(maxsize=4)
def trained(pages: int = 1500, epochs: int = 12, seed: int = 7, batch: int = 32, rate: float = 8e-3) -> Labeller:
    """A labeller trained by Adam on generated pages; the same for the same arguments."""
    data = [(vectors(p), y) for p, y in map(labelled, training_pages(pages, seed))]
    net, order = Labeller(seed), np.random.default_rng(seed)
    mean, square, t = {k: np.zeros_like(v) for k, v in net.p.items()}, {k: np.zeros_like(v) for k, v in net.p.items()}, 0
    steps = epochs * -(-len(data) // batch)
    for _ in range(epochs):
        by_length = sorted(order.permutation(len(data)).tolist(), key=lambda i: len(data[i][1]) // 8)
        chunks = [by_length[i : i + batch] for i in range(0, len(by_length), batch)]
        for c in order.permutation(len(chunks)).tolist():
            t += 1
            speed = rate * min(1, 1.02 - t / steps)
            for k, g in net.gradients([data[i][0] for i in chunks[c]], [data[i][1] for i in chunks[c]]).items():
                g = np.clip(g, -1, 1)
                mean[k] += 0.1 * (g - mean[k])
                square[k] += 0.01 * (g * g - square[k])
                net.p[k] -= speed * (mean[k] / (1 - 0.9**t)) / (np.sqrt(square[k] / (1 - 0.99**t)) + 1e-8)
    return net


#: Pages labelled together hold at most so many leaves, padding included; a longer page goes through in pieces of so many.
LEAVES_AT_ONCE, PAGES_AT_ONCE = 8192, 64


def main_texts(pages: list[str | None], net: Labeller, threshold: float = 0.5) -> list[str]:
    """Main text of each page: the blocks labelled so, joined by line breaks."""
    cut = [leaves(p) for p in pages]
    out = [""] * len(pages)
    order = sorted((i for i in range(len(cut)) if cut[i]), key=lambda i: len(cut[i]))
    at = 0
    while at < len(order):
        to = at + 1
        while to < len(order) and to - at < PAGES_AT_ONCE and (to + 1 - at) * len(cut[order[to]]) <= LEAVES_AT_ONCE:
            to += 1
        part = order[at:to]
        long = len(cut[part[0]]) > LEAVES_AT_ONCE
        scores = [net.long_scores(cut[part[0]], LEAVES_AT_ONCE)] if long else net.scores([vectors(cut[i]) for i in part])
        for i, score in zip(part, scores, strict=True):
            out[i] = "\n".join(leaf.text for leaf, s in zip(cut[i], score, strict=True) if s >= threshold)
        at = to
    return out


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row of ``pages`` (page_id, url, html).

    Defined cases: a null or empty html, and one without text, has an empty text;
    markup that ends in the middle of a tag loses that tag; a quote counts only
    round an attribute's value, and one that nothing closes is an ordinary
    character; only the contents of scripts, styles and text fields are dropped
    unread, everything else is for the labeller; a page of very many blocks is
    labelled whole, in pieces that hand on the network's state; null ids and urls
    and repeated rows stay; an empty table gives an empty result; other columns
    are left out.
    """
    net = trained()

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = main_texts(part.column(2).to_pylist(), net)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("bigint"), F.col("url").cast("string"), F.col("html").cast("string"))
    return rows.mapInArrow(batches, "page_id long, url string, text string, n_chars long")
