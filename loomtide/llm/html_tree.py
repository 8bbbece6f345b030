"""Main text of web pages by a tree-structured graphical model.

Every element of the DOM has a binary variable: part of the article or not. A node's potential comes from its tag, the words of its
class, id and role, and the size, links and sentences of its text; an edge's potential depends on what kind of element the child is.
Sum-product messages go from the leaves to the root and back, which gives each element's exact marginal; text whose element is more
likely content than not is kept. The weights are trained on labelled pages (labelled_pages: a generator of page layouts in which the
article is known) by gradient ascent on the likelihood, with the same messages.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import tidy

#: Kinds of elements (fixed values of HTML).
KINDS = {
    "root": "html body", "article": "article", "main": "main", "section": "section", "div": "div center", "heading": "h1 h2 h3 h4 h5 h6 hgroup", "paragraph": "p", "list": "ul ol dl menu", "item": "li dt dd",
    "table": "table thead tbody tfoot tr td th caption", "quote": "blockquote pre figure figcaption details summary address", "nav": "nav", "header": "header", "footer": "footer", "aside": "aside dialog",
    "form": "form fieldset button select option optgroup label input textarea legend output", "link": "a", "inline": "b i em strong span u s small sub sup mark code q cite abbr time font kbd var samp del ins dfn bdi bdo big tt label",
}
KIND = {tag: i for i, tags in enumerate(KINDS.values()) for tag in tags.split()}
OTHER = len(KINDS)
BLOCK = frozenset(" ".join(v for k, v in KINDS.items() if k not in ("link", "inline")).split() + ["hr"])
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is code.
CODE = frozenset("script style".split())
#: Their content is no text of the page, or text for when they can't be shown.
HIDDEN = CODE | frozenset("noscript template textarea title iframe svg object head select audio video canvas noembed xmp".split())
#: Elements nested deeper are children of the last one that isn't, as in browsers.
DEEPEST = 512
#: A start tag of the key ends an open element of the value.
ENDS = {t: frozenset(["p"]) for t in "address article aside blockquote center details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()}
ENDS |= {"li": frozenset(["li", "p"]), "dt": frozenset(["dt", "dd", "p"]), "dd": frozenset(["dt", "dd", "p"]), "tr": frozenset(["tr", "td", "th", "p"]), "td": frozenset(["td", "th", "p"]), "th": frozenset(["td", "th", "p"])}
FENCE = frozenset("html body ul ol dl table article section main aside nav header footer div form td th blockquote".split())
#: Words of class, id, role and the like that hint at what an element is.
HINTS = {
    "article": "article post entry story content body text main prose markdown articlebody hentry read", "nav": "nav navbar navigation menu breadcrumb breadcrumbs toc pager pagination tabs skip", "header": "header masthead banner topbar logo brand site",
    "footer": "footer copyright legal colophon bottom", "side": "sidebar side aside widget rail related recommended popular trending more links tags tag share social sharing", "advert": "ad ads advert advertisement sponsor sponsored promo promoted banner adsense commercial",
    "notice": "cookie cookies consent gdpr notice alert popup modal overlay banner paywall disclaimer", "form": "newsletter subscribe signup login search form contact register", "comment": "comment comments reply replies discussion disqus respond feedback commentlist",
}
HINT = {}
for _i, _words in enumerate(HINTS.values()):
    for _w in _words.split():
        HINT.setdefault(_w, []).append(_i)
N_FEATURES = 1 + OTHER + 1 + len(HINTS) + 14
EDGES = 4  #: kinds of edges: to inline, text block, container, and boilerplate elements

NAME = re.compile(r"/?[a-zA-Z][^\s/>]*")
STOP = re.compile("[>\"']")
ATTRS = re.compile(r"""\b(?:class|id|role|itemprop|aria-label|data-label)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
LABEL = re.compile(r"""\bdata-label\s*=\s*"(\d)\"""")
WORD = re.compile(r"[a-z]+")


class Page(NamedTuple):
    kind: list[int]
    parent: list[int]
    hints: list[str]
    runs: list[tuple[int, int, str]]  #: element, block, text
    labels: list[int | None]  #: of labelled pages


class Scanner:
    """Tags of a page, each character looked at a bounded number of times."""

    def __init__(self, source: str):
        self.source, self.last, self.absent, self.found = source, source.rfind(">"), set(), {}

    def end(self, at: int) -> int:
        """Where the tag that `at` lies in ends, after its >, which no quoted value holds; -1 if nowhere. A quote that isn't closed is no quote."""
        source = self.source
        while m := STOP.search(source, at):
            at = m.end()
            if m[0] == ">":
                return at
            before = m.start() - 1
            while source[before].isspace():
                before -= 1
            if source[before] == "=" and m[0] not in self.absent:
                if (close := source.find(m[0], at)) < 0:
                    self.absent.add(m[0])
                else:
                    at = close + 1
        return -1

    def next(self, pattern: str, at: int) -> int:
        """Where the pattern begins next, from `at` on; the size of the page if nowhere."""
        known = self.found.get(pattern, -1)
        if known < at:
            m = re.compile(pattern, re.I).search(self.source, at)
            known = self.found[pattern] = m.start() if m else len(self.source)
        return known

    def after(self, tag: str, at: int) -> int:
        """Where the page goes on after a hidden element whose start tag ends at `at`. One without an end tag of its own is empty, but code goes on to the page's end."""
        size, close = len(self.source), self.next(rf"</{tag}(?=[\s/>])", at)
        if close == size or (tag not in CODE and self.next(rf"<{tag}(?=[\s/>])", at) < close):
            return size if tag in CODE else at
        end = self.source.find(">", close)
        return end + 1 if end >= 0 else size


def parse(source: str) -> Page:
    """The elements in page order, element 0 standing for the page, and the runs of text with their element and block."""
    page, scan, size = Page([0], [-1], [""], [], [None]), Scanner(source), len(source)
    runs, labelled = page.runs, "data-label" in source
    stack: list[tuple[int, str]] = [(0, "#page")]
    opened: dict[str, list[int]] = {}  # depths of the open elements by tag
    fences: list[int] = []
    block = begin = at = 0

    def close(depth: int) -> None:
        while len(stack) > depth:
            _, tag = stack.pop()
            opened[tag].pop()
            if tag in FENCE:
                fences.pop()

    while at < size:
        at = source.find("<", at)
        m = NAME.match(source, at + 1) if at >= 0 else None
        if 0 <= at < size - 1 and not m and source[at + 1] not in "!?/":
            at += 1  # a sign
            continue
        text = source[begin : at if at >= 0 else size]
        if text and not text.isspace():
            runs.append((stack[-1][0], block, html.unescape(text) if "&" in text else text))
        elif text and runs:
            runs.append((stack[-1][0], block, " "))
        if at < 0 or at > scan.last:  # no tag ends from here on
            break
        if source.startswith("<!--", at):
            end = source.find("-->", at + 4)
            begin = at = end + 3 if end >= 0 else size
            continue
        if not m:
            begin = at = source.find(">", at) + 1
            continue
        if (end := scan.end(m.end())) < 0:
            break
        given, tag = source[m.end() : end - 1], m[0].lower()
        begin = at = end
        if tag == "br":
            runs.append((stack[-1][0], block, " "))
            continue
        if tag[0] == "/":
            tag = tag[1:]
            if (open_at := opened.get(tag)) and (tag in FENCE or not fences or fences[-1] < open_at[-1]):
                close(open_at[-1])
            block += tag in BLOCK
            continue
        if tag in HIDDEN:
            begin = at = scan.after(tag, at)
            continue
        block += tag in BLOCK
        if tag in VOID:
            continue
        if tag in ENDS and (ended := max((opened[t][-1] for t in ENDS[tag] if opened.get(t)), default=0)) and (not fences or fences[-1] <= ended):
            close(ended)
        page.kind.append(KIND.get(tag, OTHER))
        page.parent.append(stack[min(len(stack), DEEPEST) - 1][0])
        page.hints.append(" ".join(x.strip("\"'") for x in ATTRS.findall(given)).lower() if given else "")
        page.labels.append(int(x[1]) if labelled and (x := LABEL.search(given)) else None)
        opened.setdefault(tag, []).append(len(stack))
        if tag in FENCE:
            fences.append(len(stack))
        stack.append((len(page.kind) - 1, tag))
    return page


class Forest(NamedTuple):
    x: np.ndarray  #: features of each node
    parent: np.ndarray
    edge: np.ndarray  #: kind of edge to the parent
    levels: list[np.ndarray]  #: nodes by depth


EDGE = np.array([2] * (OTHER + 1))
for _k, _e in (("link", 0), ("inline", 0), ("paragraph", 1), ("heading", 1), ("item", 1), ("quote", 1), ("list", 1), ("table", 1), ("nav", 3), ("header", 3), ("footer", 3), ("aside", 3), ("form", 3)):
    EDGE[list(KINDS).index(_k)] = _e


def forest(pages: list[Page]) -> Forest:
    n = sum(len(p.kind) for p in pages)
    x, parent, edge, depth = np.zeros((n, N_FEATURES)), np.full(n, -1), np.zeros(n, int), np.zeros(n, int)
    chars, linked, stops, first = np.zeros(n), np.zeros(n), np.zeros(n), 0
    a, item = list(KINDS).index("link"), 1 + OTHER + 1
    for p in pages:
        k = len(p.kind)
        own, links, ends, level, inside = [0] * k, [0] * k, [0] * k, [0] * k, [False] * k
        for i in range(1, k):
            level[i] = level[p.parent[i]] + 1
            inside[i] = inside[p.parent[i]] or p.kind[i] == a
            if p.hints[i]:
                for w in set(WORD.findall(p.hints[i])):
                    for h in HINT.get(w, ()):
                        x[first + i, item + h] = 1
        for i, _, t in p.runs:
            c = len(t) - t.count(" ")
            own[i] += c
            ends[i] += t.count(".") + t.count("!") + t.count("?")
            links[i] += c if inside[i] else 0
        for i in range(k - 1, 0, -1):
            j = p.parent[i]
            own[j] += own[i]
            links[j] += links[i]
            ends[j] += ends[i]
        at = slice(first, first + k)
        x[np.arange(first, first + k), 1 + np.array(p.kind)] = 1
        parent[at] = [q + first if q >= 0 else -1 for q in p.parent]
        depth[at], chars[at], linked[at], stops[at] = level, own, links, ends
        edge[at] = EDGE[p.kind]
        x[at, item + len(HINTS) + 13] = chars[at] / max(1, own[0])
        first += k
    x[:, 0] = 1
    b, share = item + len(HINTS), linked / np.maximum(1, chars)
    for i, edge_at in enumerate((1, 20, 80, 200, 600)):
        x[:, b + i] = chars >= edge_at
    for i, edge_at in enumerate((0.1, 0.3, 0.6, 0.9)):
        x[:, b + 5 + i] = share > edge_at
    for i, edge_at in enumerate((1, 3, 8)):
        x[:, b + 9 + i] = stops >= edge_at
    x[:, b + 12] = depth <= 1
    order = np.argsort(depth, kind="stable")
    return Forest(x, parent, edge, np.split(order, np.flatnonzero(np.diff(depth[order])) + 1))


def sum_product(f: Forest, weights: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """log marginals of both values of each node, and of both nodes of each edge (parent value, child value)."""
    own = np.zeros((len(f.x), 2))
    own[:, 1] = f.x @ weights
    pot = edges[f.edge]
    up = np.zeros((len(f.x), 2))  # messages to the parent
    for nodes in f.levels[:0:-1]:
        m = np.logaddexp.reduce(pot[nodes] + own[nodes][:, None, :], axis=2)
        up[nodes] = m - m.max(1, keepdims=True)
        np.add.at(own, f.parent[nodes], up[nodes])  # own now holds all that came from below
    belief, pairs = own.copy(), np.full((len(f.x), 2, 2), -np.inf)
    for nodes in f.levels[1:]:
        rest = belief[f.parent[nodes]] - up[nodes]
        joint = pot[nodes] + rest[:, :, None] + own[nodes][:, None, :]
        joint -= np.logaddexp.reduce(np.logaddexp.reduce(joint, 2), 1)[:, None, None]
        pairs[nodes] = joint
        belief[nodes] = np.logaddexp.reduce(joint, 1)
    return belief - np.logaddexp.reduce(belief, 1)[:, None], pairs


def labelled_pages(n: int = 400, seed: int = 7) -> list[tuple[str, None]]:
    """Pages whose elements carry data-label (1: article), by random layouts; an element without one has its parent's label."""
    r, out = random.Random(seed), []
    pick = r.choice

    def words(k: int) -> str:
        return " ".join("".join(pick(["ba", "lo", "mi", "tre", "sun", "ka", "ver", "ol", "ing", "an", "te"]) for _ in range(r.randint(1, 4))) for _ in range(k))

    def sentences(k: int) -> str:
        return " ".join(words(r.randint(1, 16)).capitalize() + pick([".", ".", ".", "!", ""]) for _ in range(k))

    def links(k: int, label: int = 0) -> str:
        return "".join(f'<li><a href="/{i}">{words(r.randint(1, 4))}</a></li>' for i in range(k))

    def cls(names: str) -> str:
        return pick([f'class="{pick(names.split())}"', f'id="{pick(names.split())}"', f'class="{pick(names.split())} c{r.randint(1, 9)}"'])

    def paragraph() -> str:
        inner = pick([sentences(r.randint(1, 6))] * 3 + [f"<b>{sentences(2)}</b> {sentences(2)}", f'{sentences(1)} <a href="/x">{words(2)}</a> {sentences(2)}', words(r.randint(1, 3)) + ".", f"<em>{words(3)}</em>", " | ".join(words(1) for _ in range(12))])
        return pick([f"<p>{inner}</p>"] * 6 + [f"<p><b>{inner}<br>", f"<p>{inner}", f"<div>{inner}</div>", f"<p><span>{inner}</span></p>"])

    def body() -> str:
        parts = [pick([f"<h1>{words(r.randint(2, 9))}</h1>", f"<header data-label=\"1\"><h1>{words(5)}</h1></header>", ""])]
        for _ in range(r.randint(1, 12)):
            parts.append(pick([paragraph()] * 9 + [f"<h2>{words(4)}</h2>", f"<ul>{''.join(f'<li>{sentences(1)}</li>' for _ in range(3))}</ul>", f"<blockquote>{paragraph()}</blockquote>", f"<pre>{words(9)}</pre>", f"<table><tr><td>{words(2)}</td><td>{words(2)}</td></tr></table>", f"<figure><img src=x><figcaption>{words(5)}</figcaption></figure>", f"<section>{paragraph()}{paragraph()}</section>", advert(), f'<aside data-label="0" {cls("related pullquote promo")}><ul>{links(3)}</ul></aside>', f'<div data-label="0" {cls("share social tags")}><a href="#">{words(1)}</a> <a href="#">{words(1)}</a></div>', f'<form data-label="0" {cls("newsletter signup")}><label>{words(3)}</label><input><button>{words(1)}</button></form>']))
        return "".join(parts)

    def advert() -> str:
        return f'<div data-label="0" {cls("ad ads advert sponsored promo banner advertisement ad-slot")}>{pick([sentences(2), f"<p>{sentences(2)}</p>", f"<a href=/b>{words(6)}</a>", sentences(5)])}</div>'

    def article() -> str:
        tag = pick(["article"] * 6 + ["main", f'div {cls("content post entry-content article-body story post-body")}', f'section {cls("article content post")}', f'div {cls("main text")}'])
        end = tag.split()[0]
        inner = body()
        wrapped = f'<div {cls("content post-body text entry")}>{inner}</div>' if r.random() < 0.3 else inner
        return f'<{tag} data-label="1">{wrapped}</{end}>'

    def comments() -> str:
        one = "".join(f'<{pick(["div", "li", "article"])} {cls("comment reply comment-body")}><b>{words(1)}</b><p>{sentences(r.randint(1, 5))}</p>' + pick(["</div>", "</li>", "</article>"]) for _ in range(r.randint(1, 5)))
        return f'<{(t := pick(["section", "div", "ol", "aside"]))} data-label="0" {cls("comments comment-list discussion replies")}><h3>{words(2)}</h3>{one}</{t}>'

    def side() -> str:
        return f'<{(t := pick(["aside", "div", "div", "section"]))} data-label="0" {cls("sidebar related widget side popular rail")}><h3>{words(2)}</h3>{pick([f"<ul>{links(4)}</ul>", f"<p>{sentences(3)}</p>", sentences(2)])}</{t}>'

    def notice() -> str:
        return f'<div data-label="0" {cls("cookie-notice notice consent alert popup disclaimer cookie")}>{pick([f"<p>{sentences(2)}</p>", sentences(2)])}<button>{words(1)}</button></div>'

    def form() -> str:
        return f'<form data-label="0" {pick(["", cls("search login newsletter subscribe")])}><label>{words(2)}</label><p>{sentences(1)}</p><input name=q><button>{words(1)}</button></form>'

    for _ in range(n):
        some = lambda f, p: f() if r.random() < p else ""
        nav = f'<nav data-label="0"><ul>{links(r.randint(3, 8))}</ul></nav>' if r.random() < 0.6 else f'<div data-label="0" {cls("nav menu navbar breadcrumb")}>{pick([f"<ul>{links(5)}</ul>", " ".join(f"<a href=/>{words(1)}</a>" for _ in range(4))])}</div>'
        head = pick(["", f'<header data-label="0"><a href="/">{words(2)}</a>{nav}</header>', f'<div data-label="0" {cls("header masthead topbar")}>{words(3)}</div>'])
        foot = f'<footer data-label="0">{pick(["&copy; ", ""])}{sentences(r.randint(1, 3))}</footer>' if r.random() < 0.7 else f'<div data-label="0" {cls("footer copyright legal")}><p>{sentences(2)}</p></div>'
        core = some(advert, 0.4) + article() + some(advert, 0.2) + some(side, 0.4) + some(comments, 0.5)
        if r.random() < 0.4:
            core = f"<{(t := pick(['main', 'div', 'section']))} data-label=\"0\" {pick(['', cls('page wrapper container layout row site')])}>{core}</{t}>"
        page = f"<html><head><title>x</title></head><body>{head}{nav if nav not in head else ''}{some(notice, 0.35)}{core}{some(form, 0.25)}{some(side, 0.2)}{foot}"
        out.append(page + pick(["</body></html>"] * 4 + [""]))
    return out


def known(page: Page) -> np.ndarray:
    """The labels of a labelled page's elements."""
    out = np.zeros(len(page.kind))
    for i in range(1, len(page.kind)):
        out[i] = out[page.parent[i]] if page.labels[i] is None else page.labels[i]
    return out


class Model(NamedTuple):
    weights: np.ndarray
    edges: np.ndarray


@cache
def train(n: int = 250, seed: int = 7, rounds: int = 80, rate: float = 0.5, decay: float = 1e-3) -> Model:
    """Gradient ascent with momentum from labelled_pages(n, seed): the same model on every run."""
    pages = [parse(s) for s in labelled_pages(n, seed)]
    y = np.concatenate([known(p) for p in pages])
    f = forest(pages)
    child = np.flatnonzero(f.parent >= 0)
    seen = np.zeros((EDGES, 2, 2))
    np.add.at(seen, (f.edge[child], y[f.parent[child]].astype(int), y[child].astype(int)), 1)
    w, e, dw, de = np.zeros(N_FEATURES), np.zeros((EDGES, 2, 2)), 0.0, 0.0
    for _ in range(rounds):
        one, two = sum_product(f, w, e)
        expected = np.zeros((EDGES, 2, 2))
        np.add.at(expected, f.edge[child], np.exp(two[child]))
        dw = 0.9 * dw + f.x.T @ (y - np.exp(one[:, 1])) / len(y) * 5 - decay * w
        de = 0.9 * de + (seen - expected) / len(y) * 5 - decay * e
        w, e = w + rate * dw, e + rate * de
    return Model(w, e)


def texts(sources: list[str | None], model: Model) -> list[str]:
    """The main text of each page: blocks of content joined by line ends."""
    pages = [parse(s or "") for s in sources]
    content = sum_product(forest(pages), *model)[0][:, 1] > np.log(0.5)
    out, first = [], 0
    for p in pages:
        blocks: dict[int, list[str]] = {}
        for i, block, text in p.runs:
            if content[first + i]:
                blocks.setdefault(block, []).append(text)
        out.append("\n".join(t for b in blocks.values() if (t := " ".join("".join(b).split()))))
        first += len(p.kind)
    return out


def extract(pages: DataFrame, model: Model | None = None, html_col: str = "html") -> DataFrame:
    """pages without the html, with text and n_chars (code points), one row for each row.

    Null, empty and text-free pages give the empty text. Elements that a cut-off page leaves open end with the page, a tag that isn't
    closed is dropped with what follows it. Equal rows give equal texts; an empty table gives an empty result. Columns named text or
    n_chars are replaced; html of any size is read whole, in time that grows with its size.
    """
    from pyspark.sql.types import LongType, StringType, StructField, StructType

    learned = model or train()
    keep = [c for c in pages.columns if c not in (html_col, "text", "n_chars")]
    schema = StructType([pages.schema[c] for c in keep] + [StructField("text", StringType()), StructField("n_chars", LongType())])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            for i in range(0, b.num_rows, 64):
                part = b.slice(i, 64)
                got = texts(part.column("#html").to_pylist(), learned)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(got, pa.string()), pa.array(map(len, got), pa.int64())], [*keep, "text", "n_chars"])

    return pages.select(*(F.col(f"`{c}`") for c in keep), F.col(html_col).alias("#html")).mapInArrow(tidy(run), schema)
