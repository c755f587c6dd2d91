"""Main-text extraction from flat text blocks.

A page is read as a flat run of text blocks, cut at block-level tags.  Each
block is described by its word count and link density and those of its two
neighbours, and by facts about the elements around it (inside an article,
a heading, inside a navigation-like element, inside an element named like
one).  A decision tree says which blocks belong to the article.  It is
grown on the labelled blocks of made-up pages of several layouts, with an
article element and without; on the latter word counts and densities decide.

Defined cases: null and empty html give an empty text; html without tags
is one block; unclosed and stray tags are tolerated; an unclosed comment,
script or style runs to the end of the page, any other unclosed element to
the end of what holds it; a ``<`` that opens no tag is text; pages that
repeat an id are handled one by one; very long pages are read whole, in
time proportional to their length; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from html import unescape
from random import Random

import pandas as pd
from pyspark.sql import DataFrame, functions as F

# The element names of HTML and the words sites use for parts of a page.
BREAKS = frozenset("address article aside blockquote body br center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split())
HELD = (BREAKS | frozenset("button noscript span svg template".split())) - {"br", "hr"}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements before which an open paragraph ends.
ENDS_P = BREAKS - frozenset("br body caption head html legend option summary tbody td tfoot th thead title tr li dt dd".split())
#: Elements whose content is not markup; none of it is text of the page.
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
#: Elements that are not shown: no script runs here, templates are not rendered, drawings and choices are no text.
UNSEEN = frozenset("noscript template svg select".split())
LISTS = frozenset("ul ol menu".split())
BOILER = frozenset("nav footer aside form menu dialog fieldset".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form toolbar".split())
#: A class or id names a part of the page that is no article if one of these stands in it alone, first before a word
#: of LAYOUT, or last; names such as side-by-side or social-data hold them otherwise.
PARTS = (
    "ad ads advert adverts advertising advertisement banner promo promos promotion sponsor sponsors sponsored cookie cookies consent gdpr notice notices notification notifications alert alerts popup modal overlay newsletter "
    "subscribe subscription signup login share sharing social sidebar widget widgets related recommended recommendations comment comments commentlist replies respond disqus breadcrumb breadcrumbs menu menus nav navbar navigation "
    "topbar masthead header footer copyright legal pagination pager toolbar searchbox searchform"
)
LAYOUT = "area bar block body box button buttons col column container content form group holder inner item items left links list main nav outer panel placeholder pane right row section slot top bottom unit widget wrap wrapper now us today cta offer offers message messages prompt"
NAMES = re.compile(rf"^(?:[a-z0-9]+[-_]+)*?(?:{'|'.join(PARTS.split())})(?:[-_]+(?:{'|'.join(LAYOUT.split())}|[0-9]+))*$", re.I)

NAME = re.compile(r"/?([a-zA-Z][^\s/>]*)")
STOP = re.compile(r"[>\"']")
ATTRIBUTE = re.compile(r"([^\s=\"'<>/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")


class Tokens:
    """The tags and texts of a page, each character looked at a bounded
    number of times: a search that found nothing is not made again."""

    def __init__(self, html: str):
        self.html = html
        self.at = 0
        self.quotes = True
        self.absent: set[str] = set()

    def find(self, what: str, at: int) -> int:
        if what in self.absent:
            return -1
        k = self.html.find(what, at)
        if k < 0:
            self.absent.add(what)
        return k

    def tag_end(self, at: int) -> int:
        """Where the tag that is open at ``at`` has its ``>``, or -1.  A quoted
        value may hold one.  If a quote is left open to the end of the page,
        quotes are not to be trusted, and are ignored from there on."""
        k = at
        while self.quotes:
            m = STOP.search(self.html, k)
            if not m:
                break
            if m[0] == ">":
                return m.start()
            close = self.find(m[0], m.end())
            if close < 0:
                break
            k = close + 1
        self.quotes = False
        return self.find(">", at)

    def past(self, closing: str, at: int) -> int:
        """The end of the first ``closing``, or of the page."""
        k = self.find(closing, at)
        return len(self.html) if k < 0 else k + len(closing)

    def raw_end(self, tag: str, at: int) -> int:
        """The end of the raw element's closing tag; -1 if there is none."""
        if f"</{tag}" in self.absent:
            return -1
        m = re.compile(rf"</{tag}(?![a-zA-Z0-9-])", re.I).search(self.html, at)
        if not m:
            self.absent.add(f"</{tag}")
            return -1
        k = self.find(">", m.end())
        return len(self.html) if k < 0 else k + 1

    def __iter__(self) -> Iterator[tuple[str, str, str]]:
        """(kind, tag, text): kind is text, open, close or empty."""
        html, n = self.html, len(self.html)
        while self.at < n:
            at = self.at
            if html[at] != "<":
                k = self.find("<", at)
                self.at = n if k < 0 else k
                yield "text", "", html[at : self.at]
                continue
            if html.startswith("<!--", at):
                self.at = self.past("-->", at + 4)
                continue
            if html.startswith("<![CDATA[", at):
                self.at = self.past("]]>", at)
                continue
            if html.startswith(("<!", "<?"), at):
                self.at = self.past(">", at)
                continue
            m = NAME.match(html, at + 1)
            end = self.tag_end(m.end()) if m else -1
            if end < 0:
                self.at = at + 1
                yield "text", "", "<"
                continue
            self.at = end + 1
            kind = "close" if html[at + 1] == "/" else "empty" if html[end - 1] == "/" else "open"
            yield kind, m[1].lower(), html[m.end() : end]


@dataclass
class Block:
    text: str
    words: int
    linked: int
    inside: bool
    boiler: bool
    named: bool
    heading: bool = False

    @property
    def density(self) -> float:
        return self.linked / self.words if self.words else 0.0


@dataclass
class Element:
    tag: str
    inside: bool = False
    boiler: bool = False
    named: bool = False
    hidden: bool = False
    #: Where in the stack the list item is that a new one of the same list ends, or -1.
    item: int = -1


def _element(tag: str, attributes: str, parent: Element) -> Element:
    a = {m[1].lower(): unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(attributes)} if attributes.strip() else {}
    hidden = parent.hidden or tag in UNSEEN or "hidden" in a or a.get("aria-hidden", "").lower() == "true" or "display:none" in a.get("style", "").replace(" ", "").lower()
    own = any(NAMES.match(x) for k in ("class", "id") for x in a.get(k, "").split())
    if tag in ("article", "main") or a.get("role", "").lower() in ("article", "main"):
        return Element(tag, True, parent.boiler and parent.inside, own or parent.named and parent.inside, hidden)
    boiler = tag in BOILER or tag == "header" and not parent.inside or a.get("role", "").lower() in ROLES
    return Element(tag, parent.inside, parent.boiler or boiler, parent.named or own, hidden)


def blocks(html: str) -> list[Block]:
    out: list[Block] = []
    stack = [Element("")]
    held: Counter[str] = Counter()
    pieces: list[str] = []
    linked: list[str] = []
    link, heading = 0, False

    def flush():
        text = " ".join(unescape("".join(pieces)).split())
        top = stack[-1]
        if text and not top.hidden:
            words = len(text.split())
            out.append(Block(text, words, min(words, len(unescape("".join(linked)).split())), top.inside, top.boiler, top.named, heading))
        pieces.clear()
        linked.clear()

    def drop(k: int):
        """Close the elements of the stack from the k-th on."""
        held.subtract(e.tag for e in stack[k:])
        del stack[k:]

    def same(a: Element, b: Element) -> bool:
        return (a.inside, a.named, a.boiler, a.hidden) == (b.inside, b.named, b.boiler, b.hidden)

    tokens = Tokens(html)
    for kind, tag, text in tokens:
        if kind == "text":
            pieces.append(text)
            if link:
                linked.append(text)
            continue
        if tag in RAW:
            if kind == "open":
                end = tokens.raw_end(tag, tokens.at)
                # browsers read an open script or style to the end; any other open one is passed over
                tokens.at = end if end >= 0 else len(html) if tag in ("script", "style") else tokens.at
                pieces.append(" ")
            continue
        if tag == "a":
            link = 0 if kind == "close" else 1
            linked.append(" ")  # the words of two links are apart
        if tag in BREAKS:
            flush()
            link = 0 if tag != "br" else link
        if kind == "open" and tag in ENDS_P and held["p"] > 0:
            k = len(stack) - 1
            while stack[k].tag in ("span", "button"):
                k -= 1
            if stack[k].tag == "p":
                drop(k)
        if tag in HEADINGS:
            heading = kind == "open"
        if tag not in HELD or kind == "empty":
            continue
        if kind == "close":
            if held[tag] > 0:
                k = len(stack) - 1
                while stack[k].tag != tag:
                    k -= 1
                if not same(stack[-1], stack[k - 1]):
                    flush()
                drop(k)
            continue
        if tag == "li" and stack[-1].item >= 0:
            drop(stack[-1].item)
        new = _element(tag, text, stack[-1])
        new.item = len(stack) if tag == "li" else -1 if tag in LISTS else stack[-1].item
        if not same(new, stack[-1]):
            flush()
        stack.append(new)
        held[tag] += 1
    flush()
    return out


FEATURES = ("words", "density", "words_before", "density_before", "words_after", "density_after", "heading", "heading_before", "inside", "boiler", "named", "has_article")


def features(page: list[Block]) -> list[tuple]:
    none, has = Block("", 0, 0, False, False, False), float(any(b.inside for b in page))
    around = [none, *page, none]
    return [
        (b.words, b.density, p.words, p.density, n.words, n.density, float(b.heading), float(p.heading), float(b.inside), float(b.boiler), float(b.named), has)
        for p, b, n in zip(around, around[1:], around[2:])
    ]


#: How many pages are made up for training, and the seed of what is in them.
PAGES, SEED = 480, 6


def made_up(number: int) -> tuple[str, list[int]]:
    """A page and the label of each of its blocks, 1 for article text.

    The layouts differ in what surrounds the article (an article element, a
    main element, a plain division) and in whether menus, adverts, side
    columns and footers say what they are.  Text runs from a one-word
    answer to 200 words, some of it linked.
    """
    rng = Random(SEED * 1_000_003 + number)
    among = lambda low, high: low + int(rng.random() * (high - low + 1))
    words = lambda n: " ".join("w" * among(2, 9) for _ in range(n))
    layout = number % 6
    bare = layout >= 3
    parts: list[tuple[str, int]] = []

    def links(n: int, low: int, high: int) -> str:
        return " ".join(f'<a href="/x">{words(among(low, high))}</a>' for _ in range(n))

    def menu(named: str) -> None:
        if rng.random() < 0.5:
            parts.append((f"<div{named}>{links(among(2, 16), 1, 4)}</div>", 1))
        else:
            items = [f"<li>{links(1, 1, 4)}</li>" for _ in range(among(2, 6))]
            parts.append((f"<ul{named}>{''.join(items)}</ul>", len(items)))

    def note(named: str, low: int = 4, high: int = 14) -> None:
        inner = words(among(low, high))
        parts.append((f"<div{named}>{inner} {links(1, 1, 3)}</div>" if rng.random() < 0.5 else f"<div{named}>{inner}</div>", 1))

    def text() -> None:
        for _ in range(among(1, 9)):
            kind = rng.random()
            if not bare and kind < 0.08:
                parts.append((f"<p>{links(among(1, 3), 1, 6)}</p>", 1))
            if kind < 0.15:
                parts.append((f"<h2>{words(among(1, 8))}</h2>", 1))
            if kind < 0.25:
                parts.append((f"<p>{words(among(1, 8))}</p>", 1))
            elif kind < 0.35:
                parts.append((f"<p>{words(among(15, 60))} {links(among(1, 3), 1, 4)} {words(among(5, 40))}</p>", 1))
            else:
                parts.append((f"<p>{words(among(12, 200))}</p>", 1))

    outside = (' class="nav"', ' class="sidebar"', ' class="ad-box"', ' id="footer"') if number % 12 < 6 else ("", "", "", "")
    labels: list[int] = []

    def counted(make, label: int) -> None:
        before = len(parts)
        make()
        labels.extend([label] * sum(n for _, n in parts[before:]))

    for _ in range(among(1, 2)):
        counted(lambda: menu(outside[0]), 0)
    if rng.random() < 0.4 and (outside[2] or not bare):
        counted(lambda: note(outside[2], 4, 14 if bare else 80), 0)
    open_, close = (("<article>", "</article>"), ("<main>", "</main>"), ("<article>", "</article>"), ("<div>", "</div>"), ("<section>", "</section>"), ("", ""))[layout]
    parts.append((open_, 0))
    if rng.random() < 0.75:
        counted(lambda: parts.append((f"<h1>{words(among(2, 10))}</h1>", 1)), 1)
    counted(text, 1)
    if not bare and rng.random() < 0.4:
        counted(lambda: note(' class="ad"', 3, 20), 0)
        counted(text, 1)
    if not bare and rng.random() < 0.3:
        counted(lambda: parts.append((f"<aside>{words(among(3, 60))}</aside>", 1)), 0)
        counted(text, 1)
    for element, named in (("nav", ""), ("div", ' class="share"'), ("form", "")):
        if rng.random() < 0.25:
            parts.append((f"<{element}{named}>", 0))
            counted(lambda: menu("") if rng.random() < 0.5 else note("", 2, 40), 0)
            parts.append((f"</{element}>", 0))
            counted(text, 1)
    parts.append((close, 0))
    for _ in range(0 if bare else among(0, 3)):
        counted(lambda: note(outside[1], 3, 80), 0)
    if rng.random() < 0.5:
        counted(lambda: menu(outside[1]), 0)
        if rng.random() < 0.5:
            counted(lambda: note(outside[1], 4, 14 if bare else 80), 0)
            counted(lambda: menu(outside[1]), 0)
    element = "footer" if rng.random() < 0.4 else "div"
    parts.append((f"<{element}>", 0))
    if rng.random() < 0.7:
        counted(lambda: menu(outside[3]), 0)
        counted(lambda: note(outside[3], 3, 12), 0)
    parts.append((f"</{element}>", 0))
    return "<html><body>" + "".join(p for p, _ in parts) + "</body></html>", labels


def labelled(pages: int = PAGES) -> list[tuple]:
    """The labelled table: FEATURES of every block and its label."""
    rows = []
    for k in range(pages):
        html, labels = made_up(k)
        rows += [(*x, y) for x, y in zip(features(blocks(html)), labels, strict=True)]
    return rows


def grow(rows: list[tuple], depth: int = 10, least: int = 4):
    """A binary decision tree by Gini impurity: a leaf's label, or
    (feature, threshold, tree below, tree above).  A leaf has ``least``
    blocks at least."""
    ones = sum(r[-1] for r in rows)
    if depth == 0 or ones in (0, len(rows)):
        return int(2 * ones >= len(rows))
    best = None
    for f in range(len(FEATURES)):
        ordered = sorted((r[f], r[-1]) for r in rows)
        below = 0
        for k in range(1, len(ordered)):
            below += ordered[k - 1][1]
            if ordered[k - 1][0] == ordered[k][0] or not least <= k <= len(ordered) - least:
                continue
            p, q = below / k, (ones - below) / (len(ordered) - k)
            gini = k * p * (1 - p) + (len(ordered) - k) * q * (1 - q)
            if best is None or gini < best[0] - 1e-9:
                best = (gini, f, (ordered[k - 1][0] + ordered[k][0]) / 2)
    if best is None or best[0] > ones * (1 - ones / len(rows)) - 1e-9:
        return int(2 * ones >= len(rows))
    _, f, cut = best
    low, high = grow([r for r in rows if r[f] <= cut], depth - 1, least), grow([r for r in rows if r[f] > cut], depth - 1, least)
    return low if low == high and not isinstance(low, tuple) else (f, cut, low, high)


@cache
def tree():
    return grow(labelled())


def classify(x: tuple) -> int:
    node = tree()
    while isinstance(node, tuple):
        node = node[2] if x[node[0]] <= node[1] else node[3]
    return node


def main_text(html: str | None) -> str:
    page = blocks(html or "")
    return " ".join(b.text for b, x in zip(page, features(page)) if classify(x))


def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """``doc`` (the row) and ``text``, its main text."""

    @F.pandas_udf("string")
    def text_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for rows in batches:
            yield rows.map(main_text)

    return pages.select(F.struct("*").alias("doc"), text_of(F.coalesce(F.col(html), F.lit(""))).alias("text"))
