"""Operator 3: main text of HTML pages by boosted trees over DOM nodes.

Every element gets features: its tag, tokens of its attributes, depth, position
and statistics of its subtree, parent and siblings (text, words, tags, links and
their ratios).  Gradient-boosted trees give the log-odds that it is part of the
article.  Decoding is hierarchical: an element is kept only inside kept
elements, and the choice with the greatest total log-likelihood under that rule
is found from the leaves upwards, so ancestors and descendants never
contradict each other.  The trees are trained on ``training_pages``, a seeded
generator of page layouts with known articles.
"""

from __future__ import annotations

import functools
import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import dom, frames
from .trees import Ensemble, boosted

#: Elements whose text is never shown as text.
SILENT = frozenset("script style noscript template iframe svg math select object textarea title head button option input".split())
# Groups of attribute tokens that name parts of a page.
TOKEN_GROUPS = {
    "advert": "ad ads adv advert advertisement advertising adsense adslot banner sponsor sponsored promo promotion promoted outbrain taboola dfp".split(),
    "menu": "nav navbar navigation menu menubar breadcrumb breadcrumbs crumbs tabs toc pagination pager skip".split(),
    "head": "header masthead topbar branding logo hero banner site-header".split(),
    "foot": "footer copyright colophon legal bottom foot".split(),
    "side": "sidebar aside side rail widget widgets related recommended recommendations trending popular more share sharing social tags author-box".split(),
    "comment": "comment comments commentlist disqus reply replies respond discussion responses reader-comments thread".split(),
    "notice": "cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe subscription signup paywall login toast disclaimer privacy".split(),
    "form": "form search searchbox field input contact".split(),
    "hidden": "hidden invisible sr-only visually-hidden d-none display:none".split(),
    "main": "article main content post entry story body text page-content post-content entry-content article-body articlebody prose".split(),
}
_GROUP_OF: dict[str, list[int]] = {}
for _i, _words in enumerate(TOKEN_GROUPS.values()):
    for _w in _words:
        _GROUP_OF.setdefault(_w, []).append(_i)
TAGS = "article main section div p h1 h2 h3 h4 ul ol li a nav header footer aside form table tr td blockquote pre figure figcaption span b em body html dl dt dd".split()
_TAG_INDEX = {t: i for i, t in enumerate(TAGS)}
_SPLIT = re.compile(r"[^a-z0-9]+")
_PUNCTUATION = re.compile(r"[.,;:!?]")


def _tokens(node: dom.Element) -> np.ndarray:
    out = np.zeros(len(TOKEN_GROUPS))
    if node.attributes:
        a = node.attribute_map()
        text = " ".join([a.get("class", ""), a.get("id", ""), a.get("role", ""), a.get("aria-label", ""), a.get("itemprop", "")]).lower()
        for w in {*text.split(), *_SPLIT.split(text)}:
            for i in _GROUP_OF.get(w, ()):
                out[i] += 1
        role = a.get("role", "").lower()
        for i, roles in enumerate((("none",), ("navigation",), ("banner",), ("contentinfo",), ("complementary",), ("comment",), ("alert", "dialog"), ("search", "form"), (), ("main", "article"))):
            out[i] += role in roles
        style = a.get("style", "").replace(" ", "").lower()
        if "hidden" in a or a.get("aria-hidden") == "true" or "display:none" in style or "visibility:hidden" in style:
            out[8] += 2
    return out


class PageFeatures:
    """Features of the elements of a page, in page order.

    What needs the whole tree is held in narrow arrays, about 200 bytes an
    element; the wide rows that the trees read are made for a slice at a time.
    Counts of names and tokens below an element stop at 100, as no feature
    tells them apart beyond 5.
    """

    def __init__(self, nodes: list[dom.Element]) -> None:
        n, groups = len(nodes), len(TOKEN_GROUPS)
        self.n = n
        self.own = own = np.zeros((n, 5), np.int32)  # characters, words, punctuation, elements, linked characters
        self.tokens = tokens = np.zeros((n, groups), np.int8)
        self.parent = parent = np.zeros(n, np.int32)
        self.place, self.children, self.depth = place, children, depth = tuple(np.zeros(n, np.int32) for _ in range(3))
        self.tag = np.full(n, -1, np.int16)
        for i, node in enumerate(nodes):
            parent[i] = node.parent.index if node.parent else 0
            depth[i] = node.depth
            self.tag[i] = _TAG_INDEX.get(node.tag, -1)
            own[i, 3] = 1
            if node.attributes:
                tokens[i] = np.minimum(_tokens(node), 100)
            if node.tag in SILENT:
                continue
            for part in node.parts:
                if isinstance(part, str):
                    words = part.split()
                    own[i, 0] += sum(map(len, words))
                    own[i, 1] += len(words)
                    own[i, 2] += len(_PUNCTUATION.findall(part))
                else:
                    place[part.index] = children[i]
                    children[i] += 1
        linked = np.zeros(n, bool)
        for i in range(1, n):
            linked[i] = linked[parent[i]] or nodes[i].tag == "a"
        own[:, 4] = own[:, 0] * linked
        # Tags that name a part of a page, on the way from the root and below.
        self.naming = naming = np.column_stack([np.isin(self.tag, [_TAG_INDEX[t] for t in names]) for names in (("article", "main"), ("nav",), ("header",), ("footer",), ("aside",), ("form",))]).astype(np.int8)
        self.sub, self.under, self.named = sub, under, named = own.copy(), np.zeros((n, groups), np.int8), np.zeros_like(naming)
        # Most elements have no token and no naming tag above or below: these have nothing to pass on.
        up, marked = parent.tolist(), (tokens.any(axis=1) | naming.any(axis=1)).tolist()
        some = list(marked)
        for i in range(n - 1, 0, -1):
            p = up[i]
            sub[p] += sub[i]
            if some[i]:
                some[p] = True
                under[p] = np.minimum(under[p].astype(np.int16) + under[i] + tokens[i], 100)
                named[p] = np.minimum(named[p].astype(np.int16) + named[i] + naming[i], 100)
        self.above, self.inside = above, inside = np.zeros((n, groups)), np.zeros_like(naming)
        some = list(marked)
        for i in range(1, n):
            p = up[i]
            if some[p] and p != i:
                some[i] = True
                above[i] = above[p] * 0.999 + tokens[p]
                inside[i] = np.minimum(1, inside[p] + naming[p])
        self.before = np.concatenate(([0], np.cumsum(own[:-1, 0], dtype=np.int64)))

    def rows(self, a: int = 0, b: int | None = None) -> np.ndarray:
        """The feature rows of the elements a..b."""
        at = slice(a, self.n if b is None else b)
        parent, own, sub = self.parent[at], self.own[at].astype(float), self.sub[at].astype(float)
        up, whole = self.sub[parent].astype(float), max(float(self.sub[0, 0]), 1.0)
        onehot = (self.tag[at][:, None] == np.arange(len(TAGS))[None, :]).astype(float)
        depth, place, children, siblings = (x.astype(float) for x in (self.depth[at], self.place[at], self.children[at], self.children[parent]))
        mean_sibling = up[:, 0] / np.maximum(siblings, 1)
        has_article = np.full(len(parent), float(self.naming[1:, 0].sum(dtype=np.int64)) if self.n > 1 else 0.0)
        return np.column_stack(
            [
                onehot, self.tokens[at], np.minimum(self.above[at], 3), np.minimum(self.under[at], 5), self.naming[at], self.inside[at], np.minimum(self.named[at], 3), has_article,
                depth, depth / max(1.0, float(self.depth.max())), place, siblings, place / np.maximum(siblings, 1), children, self.tag[parent],
                np.log1p(own[:, 0]), np.log1p(sub[:, 0]), np.log1p(sub[:, 1]), sub[:, 0] / whole, sub[:, 0] / np.maximum(up[:, 0], 1), np.log1p(sub[:, 0] / sub[:, 3]),
                sub[:, 4] / np.maximum(sub[:, 0], 1), sub[:, 2] / np.maximum(sub[:, 1], 1), sub[:, 0] / np.maximum(sub[:, 1], 1), np.log1p(sub[:, 0]) - np.log1p(mean_sibling), self.before[at] / whole, up[:, 4] / np.maximum(up[:, 0], 1),
            ]
        )


#: Elements whose feature rows are made and scored together, of one page or of several.
SLICE = 4096


def scores(pages: list[PageFeatures], model: Ensemble) -> list[np.ndarray]:
    """Log-odds of each element of some pages."""
    odds = [np.zeros(p.n) for p in pages]
    held: list[tuple[int, int, int]] = []

    def score() -> None:
        if held:
            found = model.raw(np.concatenate([pages[i].rows(a, b) for i, a, b in held]))
            for (i, a, b), part in zip(held, np.split(found, np.cumsum([b - a for _, a, b in held])[:-1]), strict=True):
                odds[i][a:b] = part
            held.clear()

    size = 0
    for i, page in enumerate(pages):
        for a in range(0, page.n, SLICE):
            b = min(a + SLICE, page.n)
            if size + b - a > SLICE:
                score()
                size = 0
            held.append((i, a, b))
            size += b - a
    score()
    return odds


def decode(nodes: list[dom.Element], odds: np.ndarray) -> np.ndarray:
    """Kept elements: the most likely choice in which no kept element lies in a dropped one."""
    yes, no = -np.logaddexp(0, -odds), -np.logaddexp(0, odds)
    n = len(nodes)
    silent = np.array([x.tag in SILENT for x in nodes])
    drop, keep = no.copy(), yes.copy()
    keep[silent] = -1e9
    keep[0] = 0.0
    drop[0] = -1e9
    for i in range(n - 1, 0, -1):
        p = nodes[i].parent.index
        drop[p] += drop[i]
        keep[p] += max(keep[i], drop[i])
    kept = np.zeros(n, bool)
    for i in range(n):
        kept[i] = keep[i] >= drop[i] and (i == 0 or kept[nodes[i].parent.index])
    return kept


def text_of(nodes: list[dom.Element], kept: np.ndarray) -> str:
    """The kept text: one line for each block, white space collapsed, character references decoded."""
    blocks: list[str] = []
    run: list[str] = []

    def flush() -> None:
        line = dom.clean("".join(run))
        if line:
            blocks.append(line)
        run.clear()

    stack: list[tuple[dom.Element, int]] = [(nodes[0], 0)]
    while stack:
        node, i = stack.pop()
        if i >= len(node.parts):
            if node.tag not in dom.INLINE:
                flush()
            continue
        stack.append((node, i + 1))
        part = node.parts[i]
        if isinstance(part, str):
            run.append(part)
        elif part.tag == "br":
            run.append(" ")
        elif kept[part.index]:
            if part.tag not in dom.INLINE:
                flush()
            stack.append((part, 0))
    flush()
    return "\n".join(blocks)


# ---------------------------------------------------------------- training pages


def training_pages(count: int = 700, seed: int = 5) -> Iterator[tuple[str, set[str]]]:
    """Seeded pages with known articles: (html, markers of elements that are not the article).

    Elements outside the article carry the attribute ``data-out``, which no feature reads.
    """
    rng = np.random.default_rng(seed)
    letters = list("etaoinshrdlucmfwyp")
    vocabulary = ["".join(rng.choice(letters, rng.integers(1, 10))) for _ in range(600)]
    pick = lambda *options: options[rng.integers(len(options))]

    def words(low: int, high: int) -> str:
        out = [vocabulary[i] for i in rng.integers(len(vocabulary), size=rng.integers(low, high))]
        if rng.random() < 0.15:
            out = [w + pick("", "", ",", "&eacute;", "&mdash;", "-" + w) for w in out]
        if rng.random() < 0.08:
            out = [w.upper() for w in out]
        return " ".join(out)

    def sentences(low: int, high: int) -> str:
        return " ".join(words(3, 22).capitalize() + pick(".", ".", ".", "?", "!", "") for _ in range(rng.integers(low, high)))

    def links(low: int, high: int) -> str:
        return "".join(f'<li><a href="/{words(1, 2)}">{words(1, 4)}</a></li>' for _ in range(rng.integers(low, high)))

    def menu() -> str:
        inner = f"<ul>{links(3, 9)}</ul>" if rng.random() < 0.8 else pick(" ".join(f'<a href="#">{words(1, 3)}</a>' for _ in range(6)), words(1, 7))
        return pick(f"<nav data-out>{inner}</nav>", f'<div class="{pick("menu", "navbar", "main-navigation", "breadcrumbs")}" data-out>{inner}</div>', f'<nav class="menu" data-out>{inner}</nav>', f'<ul id="nav" data-out>{links(3, 9)}</ul>')

    def advert() -> str:
        inner = pick(sentences(1, 4), f"<p>{sentences(1, 3)}</p>", f'<a href="/buy">{words(3, 9)}</a>', f"<p>{words(2, 5)}</p><p>{sentences(1, 3)}</p>")
        return pick(f'<div class="{pick("ads", "ad-slot", "ad-unit", "advert", "sponsored", "promo", "banner")}" data-out>{inner}</div>', f'<div id="ad-{rng.integers(99)}" data-out>{inner}</div>', f'<aside class="advert-box" data-out>{inner}</aside>', f'<section class="advertisement" data-out>{inner}</section>')

    def head() -> str:
        return pick(f"<header data-out><h1>{words(1, 4)}</h1><p>{words(2, 8)}</p></header>", f'<div class="{pick("header", "masthead", "topbar")}" data-out><a href="/">{words(1, 3)}</a><p>{sentences(1, 2)}</p></div>', f'<header class="site-header" data-out><span>{words(1, 4)}</span>{menu()}</header>', "")

    def foot() -> str:
        inner = pick(f"&copy; {words(1, 3)} &middot; {sentences(1, 4)}", f"<p>{sentences(1, 3)}</p><ul>{links(2, 6)}</ul>", f"<p>&copy; 2024 {words(2, 6)}</p>", sentences(1, 3))
        return pick(f"<footer data-out>{inner}</footer>", f"<footer data-out>{inner}</footer>", f'<div class="{pick("footer", "copyright", "site-footer")}" data-out>{inner}</div>', f'<div id="footer" data-out>{inner}</div>')

    def side() -> str:
        inner = pick(f"<h3>{words(1, 4)}</h3><ul>{links(3, 9)}</ul>", f"<h2>{words(1, 3)}</h2><p>{sentences(1, 4)}</p>", f"<p>{sentences(2, 5)}</p>", "".join(f"<div><a href='#'>{words(3, 9)}</a><p>{sentences(1, 2)}</p></div>" for _ in range(rng.integers(2, 6))))
        return pick(f"<aside data-out>{inner}</aside>", f'<div class="{pick("sidebar", "widget", "related", "share social", "recommended", "trending")}" data-out>{inner}</div>', f'<section id="sidebar" data-out>{inner}</section>', f'<aside class="sidebar" data-out>{inner}</aside>')

    def notice() -> str:
        inner = pick(f"<p>{sentences(1, 3)}</p><button>{words(1, 2)}</button>", sentences(1, 3), f"<span>{sentences(1, 2)}</span> <a href='#'>{words(1, 3)}</a>")
        return pick(f'<div class="{pick("cookie-notice", "cookie", "consent", "notice", "alert", "popup", "newsletter", "modal", "gdpr")}" data-out>{inner}</div>', f'<div id="{pick("cookie-banner", "newsletter", "notice")}" data-out>{inner}</div>', f'<div role="{pick("alert", "dialog")}" data-out>{inner}</div>', f'<section class="notice" data-out>{inner}</section>', f'<p class="notice" data-out>{sentences(1, 3)}</p>')

    def form() -> str:
        inner = f"<label>{words(1, 3)}</label><input type='text' name='q'>" * rng.integers(1, 3) + pick(f"<button>{words(1, 2)}</button>", f"<input type='submit'><p>{sentences(1, 2)}</p>")
        return pick(f"<form data-out>{inner}</form>", f'<form class="{pick("search", "subscribe", "contact")}" action="/s" data-out>{inner}</form>', f'<div class="newsletter" data-out><p>{sentences(1, 2)}</p><form>{inner}</form></div>')

    def comments() -> str:
        one = lambda: pick(f'<div class="comment" data-out><b>{words(1, 3)}</b><p>{sentences(1, 5)}</p></div>', f'<li class="comment" data-out><p>{sentences(1, 5)}</p></li>', f'<article class="comment" data-out><p>{sentences(1, 4)}</p></article>', f"<div data-out><p>{sentences(1, 4)}</p></div>")
        inner = f"<h3>{words(1, 3)}</h3>" * rng.integers(2) + "".join(one() for _ in range(rng.integers(1, 6)))
        return pick(f'<section class="comments" data-out>{inner}</section>', f'<div id="comments" data-out>{inner}</div>', f'<ol class="commentlist" data-out>{inner}</ol>', f'<div class="{pick("discussion", "reader-comments", "responses")}" data-out>{inner}</div>', f'<section id="comments" data-out>{inner}</section>')

    def paragraph() -> str:
        text = sentences(1, 9) if rng.random() < 0.8 else words(1, 5)
        if rng.random() < 0.3:
            text = pick(f"<b>{text}</b>", f"<i>{text}", f"{text}<br/>{words(2, 9)}", f'{text} <a href="/x">{words(1, 4)}</a> {words(1, 9)}.', f"<em>{words(1, 4)}</em> {text}", f"<span>{text}</span>")
        return pick(f"<p>{text}</p>", f"<p>{text}</p>", f"<p>{text}</p>", f"<p>{text}", f"<p>{text}</p>\n")

    def extra() -> str:
        return pick(f"<h2>{words(1, 7)}</h2>", f"<h3>{words(1, 7)}</h3>", f"<ul><li>{sentences(1, 3)}</li><li>{words(2, 9)}</li></ul>", f"<ol><li>{words(2, 9)}</li><li>{sentences(1, 2)}</li></ol>", f"<blockquote><p>{sentences(1, 4)}</p></blockquote>", f"<pre>{words(3, 20)}</pre>", f"<table><tr><td>{words(1, 3)}</td><td>{words(1, 3)}</td></tr><tr><td>{words(1, 3)}</td><td>{words(1, 3)}</td></tr></table>", f"<figure><img src='x.png'><figcaption>{words(2, 9)}</figcaption></figure>", f"<div><p>{sentences(1, 4)}</p></div>", f"<section><h2>{words(1, 5)}</h2>{paragraph()}{paragraph()}</section>", f"<div>{sentences(1, 3)}</div>", f"<dl><dt>{words(1, 3)}</dt><dd>{words(2, 9)}</dd></dl>")

    def article(inside: list[str]) -> str:
        title = f"<h1>{words(2, 12)}</h1>" if rng.random() < 0.85 else ""
        if title and rng.random() < 0.12:
            title = f"<header>{title}</header>"
        size = int(pick(rng.integers(1, 3), rng.integers(2, 8), rng.integers(4, 25)))
        parts = [paragraph() if rng.random() < 0.82 else extra() for _ in range(size)]
        for x in inside:
            parts.insert(rng.integers(len(parts) + 1), x)
        inner = title + "".join(parts)
        if rng.random() < 0.25:
            inner = f'<div class="{pick("content", "entry-content", "body", "text", "wrap", "inner")}">{inner}</div>'
        return pick(f"<article>{inner}</article>", f"<article>{inner}</article>", f"<article>{inner}</article>", f"<main>{inner}</main>", f"<main><article>{inner}</article></main>", f'<div class="{pick("article", "post", "content", "entry-content", "story", "main-content")}">{inner}</div>', f'<div id="{pick("content", "main", "article")}">{inner}</div>', f"<div>{inner}</div>", f'<section class="content">{inner}</section>')

    makers = (menu, advert, head, foot, side, notice, form, comments)
    for _ in range(count):
        inside = [pick(advert, advert, notice, form, comments, side, foot, menu)() for _ in range(pick(0, 0, 0, 1, 1, 2))]
        before = [m() for m in (head, menu, advert, notice, form, side) if rng.random() < 0.45]
        after = [m() for m in (comments, side, advert, form, notice, menu) if rng.random() < 0.35]
        if rng.random() < 0.8:
            after.append(foot())
        if rng.random() < 0.2:
            before.append(makers[rng.integers(len(makers))]())
        whole = article(inside) if rng.random() < 0.93 else ""  # some pages have no article
        if rng.random() < 0.07:  # and some are a single part
            yield pick(makers[rng.integers(len(makers))](), article([]), "".join(paragraph() for _ in range(rng.integers(1, 6))))
            continue
        body = "".join(before) + whole + "".join(after)
        if rng.random() < 0.3:
            body = f'<div class="{pick("wrapper", "container", "page", "row", "site")}">{body}</div>'
        if rng.random() < 0.15:
            body = f"<div><div>{body}</div></div>"
        if rng.random() < 0.1:
            yield body  # a page may lack all that frames it
            continue
        yield f'<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>{words(2, 9)}</title>{pick("", "<style>body {{ color: #222 }} .x > a {{ top: 1px }}</style>")}{pick("", "<script src='/a.js'></script>", "<script>if (1 < 2 && f()) {{ g('<div>'); }}</script>")}</head><body>{body}</body></html>'


def labelled_nodes(page: str) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels (1: part of the article or around it) of a training page."""
    nodes = dom.parse(page)
    out = np.zeros(len(nodes), bool)
    for i, node in enumerate(nodes):
        out[i] = "data-out" in node.attributes or node.tag in SILENT or (node.parent is not None and out[node.parent.index])
        node.attributes = node.attributes.replace("data-out", "")
    return PageFeatures(nodes).rows()[1:], (~out[1:]).astype(float)


@functools.lru_cache(maxsize=1)
def default_model() -> Ensemble:
    pairs = [labelled_nodes(p) for p in training_pages()]
    return boosted(np.concatenate([x for x, _ in pairs]), np.concatenate([y for _, y in pairs]), trees=80)


def main_texts(pages: list[str | None], model: Ensemble) -> list[str]:
    """Main text of each page; a null page has none.

    Small pages are scored together; of large ones, one is held at a time.
    """
    out: list[str] = []
    held: list[list[dom.Element]] = []

    def flush() -> None:
        for nodes, odds in zip(held, scores([PageFeatures(x) for x in held], model), strict=True):
            out.append(text_of(nodes, decode(nodes, odds)))
        held.clear()

    for page in pages:
        nodes = dom.parse(page or "")
        if held and len(nodes) + sum(map(len, held)) > 2 * SLICE:
            flush()
        held.append(nodes)
    flush()
    return out


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", model: Ensemble | None = None) -> DataFrame:
    """(id, url, text, n_chars) of every page; one narrow stage.

    Null and empty pages and pages without an article give an empty text;
    broken markup never fails; repeated rows each get a row; null ids and urls
    are kept.
    """
    trained = model or default_model()
    use = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html"))

    def fn(rows, data, offsets):
        texts = main_texts(rows.column(2).to_pylist(), trained)
        return pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["id", "url", "text", "n_chars"])

    return frames.map_texts(use, "html", fn, "id long, url string, text string, n_chars long")
