"""Main text of web pages: a linear-chain conditional random field over the leaf blocks of the page.

A page is cut into leaf blocks: runs of text that no block-level tag interrupts. Each block has features of its open
tags (names, and words of class, id and role), of its text, and of its neighbours through the chain. The field has two
labels, content and rest; it is trained here, by gradient descent on the exact likelihood, on labelled pages made by
``training_pages`` (a bounded number), and decoded by Viterbi.

Defined results: a null or empty page, or one without content, has the empty text; unclosed and stray tags are repaired as
browsers do (a close tag without its open tag is ignored, a new paragraph ends the last, text or a tag that cannot stand
in a head ends it); an unclosed script, style or comment hides the rest of the page; a tag that the end of the page cuts off is dropped, any other "<" is text; null or repeated ids are rows of their own; an empty table gives an empty result.
"""

from __future__ import annotations

import dataclasses
import functools
import html as entities
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import lean
from .hashing import batches, rowwise

# Names of HTML elements by what they do to a run of text.
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = set("script style template iframe noscript svg math canvas audio video object textarea select datalist title head".split())
IN_HEAD = set("html head base basefont bgsound link meta title noscript noframes style script template".split())
RAW = "script|style|textarea|title|iframe|noscript|template|xmp"
ENDS_P = set("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
HOLDS_P = {"article", "div", "section", "td", "li", "body", "blockquote", "main", "aside", "footer", "nav", "header", "table", "button"}
SIBLINGS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table", "tbody", "thead", "tfoot"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
TAGS = "article main section nav header footer aside form button table ul ol dl blockquote pre figure figcaption h1 h2 h3 h4 h5 h6 p li td div dialog menu address fieldset".split()
# Words of class, id and role by what they tell.
CUES = {
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs toc tabs pagination pager skip toolbar",
    "frame": "header masthead topbar banner footer bottom colophon copyright legal",
    "side": "sidebar aside rail widget related recommended popular trending more links tags categories archive archives",
    "advert": "ad ads adv advert advertisement adsense sponsor sponsored promo promotion promoted banner-ad outbrain taboola",
    "notice": "cookie cookies consent gdpr notice alert popup modal overlay dialog newsletter subscribe subscription signup paywall",
    "form": "form search login register contact input",
    "comment": "comment comments comment-list commentlist respond reply replies discussion disqus reviews",
    "share": "share sharing social follow byline meta author",
    "content": "article content post entry main body story text prose markdown",
}
CUE_OF = {w: k for k, ws in CUES.items() for w in ws.split()}
TEXT_FEATURES = ["short", "medium", "long", "stop", "links", "all_links", "copyright", "first", "last", "no_letters"]
NAMES = ["bias", *(f"in:{t}" for t in TAGS), *(f"leaf:{t}" for t in TAGS), *(f"cue:{c}" for c in CUES), *(f"near:{c}" for c in CUES), "article:header", "article:menu", *TEXT_FEATURES]
AT = {n: k for k, n in enumerate(NAMES)}

_START = re.compile(r"<(?:!--|[!?]|(/?)([a-zA-Z][a-zA-Z0-9:-]*+))")
# a quote counts only after "="; one that is never closed counts as any other character
_REST = re.compile(r"((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')|=)*+)>")
_RAW_END = {name: re.compile(rf"(?i)</{name}(?=[\s/>])") for name in RAW.split("|")}
_ZEROS, _DIGITS = re.compile(r"&#0+(?=[0-9])"), re.compile(r"&#[0-9]{8,}")
_CUED = re.compile(r"(?is)\b(?:class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)")
_CLOSED = re.compile(r"(?:\A|[\s\"'])/\Z")
_WORD = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")
_LETTER = re.compile(r"[^\W\d_]")


def decoded(text: str) -> str:
    """Character references decoded; numbers beyond Unicode, however long, are the replacement character."""
    if "&" not in text:
        return text
    return entities.unescape(_DIGITS.sub("&#1114112", _ZEROS.sub("&#", text)))


@dataclass(frozen=True, slots=True)
class Tag:
    """A tag, a comment (no name) or a raw element (script and the like) with all it holds, at start .. end; ``inner`` is where a raw element's content ends, else -1."""

    start: int
    end: int
    close: bool
    name: str
    attributes: str
    inner: int = -1


def tags(page: str) -> Iterator[Tag]:
    """All tags of a page in one scan, whose time is proportional to its length; what lies between them is text.

    Comments and raw elements that are never closed reach to the end. A tag whose end is not found although quotes are skipped is read again
    without regard to quotes, as is all after it. Of tag starts after the last ">" only the last is a tag, cut off by the end of the page; the others are text.
    """
    at, n, quotes = 0, len(page), True
    while m := _START.search(page, at):
        if not m[2]:
            end = page.find("-->", m.start() + 2) + 3 if m[0] == "<!--" else page.find(">", m.end()) + 1
            if m[0] != "<!--" and not end:
                break
            at = end if end > 2 else n
            yield Tag(m.start(), at, False, "", "")
            continue
        name = m[2].lower()
        rest = _REST.match(page, m.end()) if quotes else None
        if rest:
            attributes, end = rest[1], rest.end()
        else:
            quotes, end = False, page.find(">", m.end()) + 1
            if not end:
                break
            attributes = page[m.end() : end - 1]
        if name in _RAW_END and not m[1]:
            last = _RAW_END[name].search(page, end)
            inner, at = (last.start(), page.find(">", last.end()) + 1 or n) if last else (n, n)
            yield Tag(m.start(), at, False, name, attributes, inner)
            continue
        at = end
        yield Tag(m.start(), at, bool(m[1]), name, attributes)
    last = page.rfind("<", at)
    if last >= 0 and re.match(r"</?[a-zA-Z]|<[!?/]|<\Z", page[last : last + 3]):
        yield Tag(last, n, False, "", "")


@functools.lru_cache(20_000)
def _cues(attributes: str) -> frozenset[str]:
    found = set()
    for m in _CUED.finditer(attributes):
        for name in m[1].strip("\"'").lower().split():
            found |= {CUE_OF[w] for w in (name, *_WORD.findall(name)) if w in CUE_OF}
    return frozenset(found)


@dataclass(frozen=True)
class _Open:
    """An open element; ``path``: features that everything inside has."""

    tag: str
    path: frozenset[int]
    hidden: bool
    link: bool
    #: Its name, or that of the nearest element around it that isn't inline.
    leaf: str = ""


@functools.lru_cache(50_000)
def _inside(path: frozenset[int], tag: str, cues: frozenset[str]) -> frozenset[int]:
    new = {AT[f"cue:{c}"] for c in cues}
    if f"in:{tag}" in AT:
        new.add(AT[f"in:{tag}"])
    if tag == "header" and AT["in:article"] in path:
        new = new - {AT["in:header"]} | {AT["article:header"]}
    if tag in ("nav", "aside", "form", "footer") and AT["in:article"] in path:
        new.add(AT["article:menu"])
    return path | new


def blocks(page: str) -> list[tuple[str, frozenset[int]]]:
    """Leaf blocks in page order: text (decoded, white space made one space, trimmed, not empty) and features."""
    root = _Open("", frozenset({0}), False, False)
    stack, out, run, linked = [root], [], [], 0
    places: dict[str, list[int]] = {}  # by tag, where it is open
    seen_leaf: list = [root, ""]

    def end() -> None:
        nonlocal linked
        text = _SPACE.sub(" ", decoded("".join(run))).strip()
        run.clear()
        if text:
            n, letters = len(text), _LETTER.search(text) is not None
            f = ["short" if n < 40 else "medium" if n < 160 else "long"]
            f += ["stop"] * (text[-1] in ".!?:;\"”»…") + ["links"] * (linked * 3 > n) + ["all_links"] * (linked * 10 > n * 8) + ["copyright"] * ("©" in text[:60] or "copyright" in text[:60].lower()) + ["no_letters"] * (not letters)
            near, leaf = seen_leaf
            mine = set(near.path) | {AT[x] for x in f}
            if leaf in TAGS:
                mine.add(AT[f"leaf:{leaf}"])
            out.append((text, mine))
        linked = 0

    def add(text: str) -> None:
        nonlocal linked
        if stack[-1].tag == "head" and text.strip(" \t\n\f\r"):
            cut(len(stack) - 1)
        if text and not stack[-1].hidden:
            if not run:
                seen_leaf[0], seen_leaf[1] = stack[-1], stack[-1].leaf
            run.append(text)
            if stack[-1].link:
                linked += len(text)

    def cut(k: int) -> None:
        for x in stack[k:]:
            places[x.tag].pop()
        del stack[k:]

    def close(tag: str, within: set[str] | None = None) -> None:
        k = places[tag][-1] if places.get(tag) else 0
        if k and not any(places.get(x) and places[x][-1] > k for x in within or ()):
            cut(k)

    at = 0
    for m in tags(page):
        add(page[at : m.start])
        at = m.end
        tag = m.name
        if m.inner >= 0:
            if tag in ("textarea", "noscript", "title"):
                end()
            continue
        if not tag:
            continue
        if tag not in INLINE:
            end()
        if stack[-1].tag == "head" and not m.close and tag not in IN_HEAD:
            cut(len(stack) - 1)
        if m.close:
            close(tag)
        elif tag in VOID:
            continue
        else:
            if tag in ENDS_P:
                close("p", HOLDS_P)
            if tag in SIBLINGS:
                close(tag, SIBLINGS[tag])
            if not _CLOSED.search(m.attributes):
                top = stack[-1]
                places.setdefault(tag, []).append(len(stack))
                stack.append(_Open(tag, _inside(top.path, tag, _cues(m.attributes) if "=" in m.attributes else frozenset()), top.hidden or tag in UNSEEN, tag == "a" or (top.link and tag in INLINE), top.leaf if tag in INLINE else tag))
    add(page[at:])
    end()
    if out:
        out[0][1].add(AT["first"])
        out[-1][1].add(AT["last"])
    return out


@dataclass(frozen=True)
class Field:
    """Weights by feature and label (0 rest, 1 content), and of label pairs."""

    emit: np.ndarray
    move: np.ndarray
    #: Scores of sets of features already met; there are few, as pages repeat their layout.
    met: dict = dataclasses.field(default_factory=dict, compare=False)

    def _score(self, features: frozenset[int]) -> tuple[float, float]:
        got = self.met.get(features)
        if got is None:
            if len(self.met) > 100_000:
                self.met.clear()
            got = self.met[features] = tuple(self.emit[sorted(features)].sum(0).tolist())
        return got

    def labels(self, rows: list) -> list[int]:
        """Viterbi."""
        if not rows:
            return []
        scores = [self._score(frozenset(f)) for f in rows]
        (m00, m01), (m10, m11) = self.move.tolist()
        best0, best1 = scores[0]
        back = []
        for s0, s1 in scores[1:]:
            a0, b0, a1, b1 = best0 + m00, best1 + m10, best0 + m01, best1 + m11
            back.append((b0 > a0, b1 > a1))
            best0, best1 = max(a0, b0) + s0, max(a1, b1) + s1
        path = [int(best1 > best0)]
        for x in reversed(back):
            path.append(int(x[path[-1]]))
        return path[::-1]


def train(pages: list[tuple[list, list[int]]], epochs: int = 60, rate: float = 0.15, decay: float = 1e-3) -> Field:
    """Maximum likelihood by Adam. ``pages``: features of the blocks and their labels. Pages are padded to one array, so a step is a few numpy calls."""
    n, t, k = len(pages), max(len(p[1]) for p in pages), len(NAMES)
    x, y, on = np.zeros((n, t, k)), np.zeros((n, t), int), np.zeros((n, t))
    for i, (rows, ys) in enumerate(pages):
        for j, f in enumerate(rows):
            x[i, j, list(f)] = 1
        y[i, : len(ys)], on[i, : len(ys)] = ys, 1
    w, v = np.zeros((k, 2)), np.zeros((2, 2))
    state = [[np.zeros_like(p), np.zeros_like(p)] for p in (w, v)]
    gold = np.eye(2)[y] * on[..., None]
    pairs = gold[:, :-1, :, None] * gold[:, 1:, None, :]
    for epoch in range(1, epochs + 1):
        e = x @ w
        fw, bw = np.zeros((n, t, 2)), np.zeros((n, t, 2))
        fw[:, 0] = e[:, 0]
        for j in range(1, t):
            step = np.logaddexp.reduce(fw[:, j - 1, :, None] + v, 1) + e[:, j]
            fw[:, j] = np.where(on[:, j, None] > 0, step, fw[:, j - 1])
        for j in range(t - 2, -1, -1):
            step = np.logaddexp.reduce(v[None] + (e[:, j + 1] + bw[:, j + 1])[:, None, :], 2)
            bw[:, j] = np.where(on[:, j + 1, None] > 0, step, 0.0)
        z = np.logaddexp.reduce(fw[:, -1], 1)
        p = np.exp(fw + bw - z[:, None, None]) * on[..., None]
        q = np.exp(fw[:, :-1, :, None] + v + (e + bw)[:, 1:, None, :] - z[:, None, None, None]) * on[:, 1:, None, None]
        grads = [np.einsum("ntk,ntl->kl", x, p - gold) / n + decay * w, (q - pairs).sum((0, 1)) / n + decay * v]
        for par, g, (a, b) in zip((w, v), grads, state, strict=True):
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            par -= rate * (a / (1 - 0.9**epoch)) / (np.sqrt(b / (1 - 0.99**epoch)) + 1e-8)
    return Field(w, v)


def training_pages(n: int = 300, seed: int = 7) -> list[tuple[str, list[tuple[str, int]]]]:
    """Labelled pages: markup and, in page order, (text, 1 if content). Layouts, class names and order vary."""
    rng = random.Random(seed)
    pool = "river stone market window letter garden number winter paper signal morning bridge doctor silver engine island summer question answer harbour".split()
    pages = []

    def words(a: int, b: int) -> str:
        return " ".join(rng.choice(pool) for _ in range(rng.randint(a, b)))

    def sentence(a: int = 4, b: int = 40) -> str:
        return words(a, b).capitalize() + rng.choice([".", ".", ".", "!", "?", ""])

    for _ in range(n):
        page: list[str] = []
        truth: list[tuple[str, int]] = []

        def put(open_: str, text: str, close: str, label: int, page=page, truth=truth) -> None:
            page.append(open_ + text + close)
            truth.append((text, label))

        def menu(cls: str, page=page, put=put) -> None:
            page.append(f"<{cls}><ul>")
            for _ in range(rng.randint(2, 8)):
                put('<li><a href="/x">', words(1, 3), "</a></li>", 0)
            page.append(f"</{cls.split()[0]}>" if rng.random() < 0.5 else f"</ul></{cls.split()[0]}>")

        def rest(kind: str, put=put, page=page, menu=menu) -> None:
            if kind == "menu":
                menu(rng.choice(["nav", "nav class='main-nav'", "div class='menu'", "div id='navigation'", "div role='navigation'"]))
            elif kind == "side":
                tag = rng.choice(["aside", "div class='sidebar'", "div id='sidebar'", "section class='related'", "div class='widget'"])
                page.append(f"<{tag}>")
                for _ in range(rng.randint(1, 4)):
                    put(rng.choice(["<h3>", "<p>", "<div>", "<li><a href='/y'>"]), sentence(2, 25), "", 0)
                    page.append("</div>" if page[-1].startswith("<div>") else "")
                page.append(f"</{tag.split()[0]}>")
            elif kind in ("advert", "notice", "comment", "share"):
                names = {"advert": ["ad", "ads", "advert", "sponsored", "promo"], "notice": ["cookie-notice", "cookie-consent", "notice", "alert", "newsletter", "popup"], "comment": ["comments", "comment", "comment-list", "respond"], "share": ["share", "social"]}[kind]
                tag = rng.choice(["div", "div", "section", "aside", "ol" if kind == "comment" else "div"])
                attr = rng.choice(["class", "class", "id"])
                page.append(f'<{tag} {attr}="{rng.choice(names)}">')
                for _ in range(rng.randint(1, 5 if kind == "comment" else 2)):
                    put(rng.choice(["<p>", "", "<li>", "<div class='comment'>" if kind == "comment" else "<p>"]), sentence(3, 40), "", 0)
                    page.append("</div>" if page[-1].startswith("<div") else "<br>")
                page.append(f"</{tag}>")
            elif kind == "form":
                page.append("<form action='/s'>")
                put(rng.choice(["<label>", "<p>", "<button>"]), sentence(1, 8), "<input name=q>", 0)
                page.append("</form>")
            elif kind == "head":
                page.append(rng.choice(["<header>", "<header class='site-header'>", "<div class='header'>", "<div id='masthead'>"]))
                tag = "header" if page[-1].startswith("<header") else "div"
                put(rng.choice(["<h1>", "<p>", "<a href='/'>", "<div>"]), words(1, 6), "", 0)
                page.append("</h1></a></div>" if page[-1].startswith("<div>") else "")
                page.append(f"</{tag}>")
            elif kind == "foot":
                tag = rng.choice(["footer", "footer", "div class='footer'", "div id='footer'"])
                page.append(f"<{tag}>")
                for _ in range(rng.randint(1, 3)):
                    put(rng.choice(["<p>", "", "<div>"]), rng.choice(["© ", "Copyright ", "", ""]) + sentence(2, 25), "", 0)
                    page.append("</div>" if page[-1].startswith("<div>") else "<br>")
                page.append(f"</{tag.split()[0]}>")

        for kind in rng.sample(["head", "menu", "advert", "notice", "form", "side"], rng.randint(0, 4)):
            rest(kind)
        around = rng.choice(["article", "article", "article", "main", "main", "div class='content'", "div id='main'", "div class='post'", "section class='article-body'"])
        outer = rng.random() < 0.3
        page.append("<main>" * outer + f"<{around}>")
        inner = rng.random() < 0.25 and around == "article"
        page.append("<header>" * inner)
        if rng.random() < 0.85:
            put(rng.choice(["<h1>", "<h2>"]), words(2, 12).capitalize(), "", 1)
            page.append("</h1>" if page[-1].startswith("<h1>") else "</h2>")
        page.append("</header>" * inner)
        for _ in range(rng.randint(1, 9)):
            kind = rng.random()
            if kind < 0.72:
                put(rng.choice(["<p>", "<p>", "<p><b>"]), sentence(), rng.choice(["</p>", "</p>", "<br>", ""]), 1)
            elif kind < 0.80:
                page.append("<ul>")
                for _ in range(rng.randint(1, 4)):
                    put("<li>", sentence(1, 12), "</li>", 1)
                page.append("</ul>")
            elif kind < 0.86:
                put(rng.choice(["<blockquote>", "<pre>"]), sentence(), "", 1)
                page.append("</blockquote>" if page[-1].startswith("<block") else "</pre>")
            elif kind < 0.92:
                put("<h2>", words(1, 8), "</h2>", 1)
            else:
                rest(rng.choice(["advert", "side", "notice", "share", "form"]))
        if rng.random() < 0.2:
            rest(rng.choice(["comment", "foot"]))
        page.append(f"</{around.split()[0]}>" + "</main>" * outer)
        for kind in rng.sample(["comment", "side", "share", "menu", "notice", "advert", "form"], rng.randint(0, 3)):
            rest(kind)
        if rng.random() < 0.85:
            rest("foot")
        title = words(1, 5)
        pages.append((f"<!DOCTYPE html><html><head><title>{title}</title><style>p{{}}</style></head><body>" + "".join(page) + rng.choice(["</body></html>", ""]), truth))
    return pages


def labelled(page: str, truth: list[tuple[str, int]]) -> tuple[list, list[int]] | None:
    """Features and labels of a training page's blocks; None unless its blocks are those of ``truth``."""
    got = blocks(page)
    if [t for t, _ in got] != [_SPACE.sub(" ", t).strip() for t, _ in truth]:
        return None
    return [f for _, f in got], [y for _, y in truth]


@functools.lru_cache(1)
def field() -> Field:
    return train([x for p, t in training_pages() if (x := labelled(p, t))])


def main_text(page: str | None, model: Field) -> str:
    rows = blocks(page or "")
    return " ".join(t for (t, _), y in zip(rows, model.labels([f for _, f in rows]), strict=True) if y)


def extracted(pages: DataFrame, model: Field | None = None) -> DataFrame:
    """(page_id, url, text, n_chars), one row for each row of ``pages`` (page_id, url, html)."""
    shared = pages.sparkSession.sparkContext.broadcast(model or field())

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for rows in batches(rowwise(batch), lambda r: len(r[2] or "")):
                texts = [main_text(r[2], shared.value) for r in rows]
                yield pa.RecordBatch.from_pydict({"page_id": pa.array([r[0] for r in rows], pa.int64()), "url": pa.array([r[1] for r in rows], pa.string()), "text": pa.array(texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64())})

    return lean(pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))).mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op3(spark, sf_dir: str) -> DataFrame:
    """Contract query over the whole of ``pages``."""
    return extracted(spark.read.parquet(f"{sf_dir}/pages.parquet"))
