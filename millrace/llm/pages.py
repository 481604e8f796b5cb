"""Main text of web pages from flat text blocks."""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Callable
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.tables import map_rows
from millrace.llm.trees import fit_tree, predict

# Element names by what they do to the text.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike "
    "strong sub sup time tt u var wbr br img".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea title xmp noembed noframes".split())
APART = frozenset("nav header footer aside form dialog menu select button svg canvas object video audio head".split())
# Words of class, id or role names that mark what stands beside an article, and words that say nothing.
BESIDE = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar nav navbar navigation "
    "menu breadcrumb breadcrumbs header footer masthead cookie cookies consent gdpr notice notices alert newsletter "
    "subscribe signup social share sharing related recommended recommendations comment comments disqus reply replies respond "
    "widget popup modal overlay login search pagination pager copyright contentinfo complementary form dialog hidden".split()
)
PLAIN = frozenset(
    "area bar block body bottom box buttons center column container content left links list main module page panel primary right "
    "row secondary section site slot text top unit wrap wrapper".split()
)
CLOSES = {  # an opening tag ends an open element of these names before it
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
    "option": ("option",),
}
SCOPES = frozenset("ul ol dl table select body html article main section div nav footer header aside form".split())

COMMENT = re.compile(r"<!--.*", re.S)
TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>",
    re.S,
)
ATTRIBUTE = re.compile(r"(class|id|role|hidden|style|aria-hidden)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)|(?=[\s/]|\Z))", re.I)
UNSEEN_STYLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class Block(NamedTuple):
    text: str
    words: int
    linked: int  # words inside links
    beside: bool  # in an element that stands beside the article
    article: bool
    heading: bool


def _names_beside(name: str) -> bool:
    """Whether a class, id or role marks what stands beside an article: all its words do or say nothing, and one does.
    A name such as social-history has a meaning of its own."""
    words = [w for w in re.split(r"[^a-z]+", name) if w]
    return any(w in BESIDE for w in words) and all(w in BESIDE or w in PLAIN for w in words)


def _is_beside(tag: str, attributes: str, article: bool) -> bool:
    """Whether an element stands beside the article by its name or attributes."""
    if tag in ("html", "body", "main"):
        return False
    names: list[str] = []
    for name, value in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and UNSEEN_STYLE.search(value)):
            return True
        if name in ("class", "id", "role"):
            names += value.split()
    if tag == "article":
        return any(n in ("comment", "reply") for n in names)
    if tag in APART and not (tag == "header" and article):
        return True
    return any(map(_names_beside, names))


class Stack:
    """The open elements: name, beside, article. Counts of open names save looking through them."""

    def __init__(self):
        self.items: list[tuple[str, bool, bool]] = []
        self.open: Counter[str] = Counter()
        self.shut = 0  # open elements that stand beside by more than their name

    def push(self, name: str, beside: bool, article: bool) -> None:
        self.items.append((name, beside, article))
        self.open[name] += 1
        self.shut += beside and name not in APART

    def pop(self) -> str:
        name, beside, _ = self.items.pop()
        self.open[name] -= 1
        self.shut -= beside and name not in APART
        return name

    @property
    def top(self) -> tuple[str, bool, bool]:
        return self.items[-1] if self.items else ("", False, False)

    def close(self, name: str) -> None:
        if self.open[name]:
            while self.pop() != name:
                pass

    def close_before(self, names: tuple[str, ...]) -> None:
        """Ends the innermost open element of these names, unless it is outside the innermost list, table or section."""
        for name in names:
            if not self.open[name]:
                continue
            for i in range(len(self.items) - 1, -1, -1):
                if self.items[i][0] == name:
                    while len(self.items) > i:
                        self.pop()
                    break
                if self.items[i][0] in SCOPES:
                    break


def blocks(page: str) -> list[Block]:
    """The flat text blocks of a page in order; character references decoded, white space runs one blank."""
    out: list[Block] = []
    stack = Stack()
    parts: list[str] = []
    links = breaks = 0
    linked = 0
    heading = False

    def flush() -> None:
        nonlocal parts, linked
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            _, beside, article = stack.top
            out.append(Block(text, text.count(" ") + 1, linked, beside, article, heading))
        parts, linked = [], 0

    at, last = 0, page.rfind(">") + 1  # no tag ends later, so none is looked for there
    while True:
        m = TAG.search(page, at, last)
        text = page[at : m.start()] if m else COMMENT.sub("", page[at:])
        if text:
            parts.append(text)
            if links:
                linked += len(text.split())
            if not text.isspace():
                breaks = 0
        if not m:
            break
        at = m.end()
        if m[0].startswith("<!--") and not m[0].endswith("-->"):
            break  # a comment left open ends with the page
        closing, tag, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            continue
        tag = tag.lower()
        if tag in RAW and not closing:
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(page, at, last)
            at = end.end() if end else len(page)
            parts.append(" ")
            continue
        if tag == "a":
            links = 0 if closing else 1
        if tag == "br":
            breaks += 1
            if breaks > 1:
                flush()
            parts.append(" ")
            continue
        if tag in INLINE:
            hides = not closing and tag != "img" and bool(attributes) and _is_beside(tag, attributes, False)
            if hides or (closing and stack.top[0] == tag):
                flush()
                if closing:
                    stack.pop()
                else:
                    stack.push(tag, True, stack.top[2])
            continue
        flush()
        links = breaks = 0
        if closing:
            heading = False
            stack.close(tag)
            continue
        heading = len(tag) == 2 and tag[0] == "h" and tag[1].isdigit()
        if stack.top[0] == "p":
            stack.pop()  # a block ends a paragraph
        stack.close_before(CLOSES.get(tag, ()))
        if tag in VOID or attributes.rstrip().endswith("/") and tag in ("hr",):
            continue
        _, beside, article = stack.top
        own = _is_beside(tag, attributes, article)
        if tag in ("article", "main") and not own and not stack.shut:
            beside = False  # an article does not stand in a menu: that was left open
        stack.push(tag, beside or own, article or tag in ("article", "main"))
    flush()
    return out


# Small labelled pages, piece by piece; every block of a piece has its label, 1 for main text. W stands for
# a sentence of twelve words.
W = "the quick brown fox jumps over a lazy dog near the river"
LABELLED = [
    # pages with an article: all its prose counts, whatever its length; lists of links and adverts in it do not
    [(0, "<nav><ul><li><a>Home</a><li><a>News and more</a></ul></nav>"), (1, f"<article><h1>A title</h1><p>{W} {W} {W}</p><p>Short.</p>"),
     (1, f"<p>He left.</p><ul><li>one</li><li>two words</li></ul><p>{W} <a>{W}</a> {W}</p><p>Yes.</p><h2>Part</h2><p>{W}</p>"),
     (0, "<ul><li><a>first link</a></li><li><a>second link here</a></li><li><a>third</a></li><li><a>fourth link</a></li></ul>"),
     (0, "<p><a>Buy now cheap shoes</a></p>"), (1, f"<p>{W}</p><p>{W}</p></article>"), (0, "<footer>About us</footer>")],
    [(0, f"<header><p>{W} {W}</p></header>"), (1, f"<main><p>No, he said.</p><p>Yes!</p><p>Why?</p><p>{W}</p>"),
     (0, "<div><a>More of this</a> <a>And of that</a></div>"), (1, "<p>The end.</p></main>"), (0, f"<aside><p>{W} {W} {W}</p></aside>")],
    [(1, f"<article><p>One</p><p>{W} {W} {W} {W} {W} {W}</p>"), (0, f"<div class=ad>{W} {W}</div>"), (1, "<p>Two</p><h3>Three</h3>"),
     (1, f"<p>see <a>{W}</a> and {W} {W}</p></article>"), (0, f"<div class=comments><p>{W} {W}</p><p>me too</p></div>")],
    [(0, "<nav>Menu</nav>"), (1, "<article><h1>Only a title</h1><p>x</p></article>"), (0, "<footer>Contact</footer>")],
    [(1, f"<article><h1>{W}</h1><p>Note: <a>here</a> it is.</p>"), (0, "<p><a>Subscribe to our letter today</a></p>"),
     (1, f"<p>{W} {W}</p><table><tr><td>3<td>40 kg</table><p>a b c d e</p></article>"), (0, "<form><p>Your name</p></form>")],
    # pages without: prose and what stands between prose, but no menus, notices or lists of links
    [(0, "<div><a>Home</a> <a>News</a> <a>Sport and games</a></div>"), (1, f"<h1>A title</h1><p>{W} {W}</p><p>He left.</p><p>{W} {W} {W}</p>"),
     (1, "<p>He came back.</p>"), (0, "<div><a>Imprint</a> <a>Privacy</a></div>")],
    [(1, "<h1>At the door</h1><p>Who is there?</p><p>Me.</p><p>Come in.</p><p>Thanks.</p>")],
    [(0, f"<div class=cookie-notice>{W} {W}</div>"), (1, f"<p>{W}</p><p>Short one.</p><p>{W} {W}</p><p>He left.</p>"),
     (0, "<ul><li><a>one more story</a><li><a>another</a><li><a>a third story</a></ul>"), (0, "<p><a>Back to the top</a></p>")],
    [(0, "<ul><li><a>A</a><li><a>B</a><li><a>C and D</a></ul>"), (1, f"<h2>Head</h2><p>{W} {W} {W}</p><ul><li>milk</li><li>two eggs</li></ul><p>{W}</p>"),
     (0, f"<div class=sidebar><p>{W}</p></div>")],
    [(1, f"<p>{W} <a>{W}</a> {W}</p><h3>More</h3><p>{W} {W}</p><p>Bye.</p>"), (0, f"<div class=comments><p>{W}</p></div>"),
     (0, "<div><a>Terms of use</a> <a>Help</a></div>")],
    [(1, f"<h1>Plan</h1><p>First.</p><p>{W}</p><p>Second.</p>"), (0, "<p><a>Buy now cheap shoes</a></p>"), (1, f"<p>{W}</p>")],
]


def labelled_table() -> np.ndarray:
    """The labelled blocks the tree learns from: their features, the label in the last column."""
    rows = []
    for pieces in LABELLED:
        found, labels = blocks("".join(x for _, x in pieces)), []
        for number, (label, _) in enumerate(pieces):
            upto = len(blocks("".join(x for _, x in pieces[: number + 1])))
            labels += [label] * (upto - len(labels))
        rows += [(*x, label) for x, label in zip(features(found), labels)]
    return np.array(rows, float)


def features(found: list[Block]) -> list[tuple]:
    """For each block words and link density of it and its neighbours, whether it stands beside, in an article, is a heading."""
    sizes = [(0, 0.0), *((b.words, min(1.0, b.linked / b.words)) for b in found), (0, 0.0)]
    return [
        (*sizes[i], *sizes[i - 1], *sizes[i + 1], b.beside, b.article, b.heading) for i, b in enumerate(found, 1)
    ]


DEPTH = 8


def learned_tree() -> tuple:
    table = labelled_table()
    return fit_tree(table[:, :-1], table[:, -1], DEPTH)


def main_text(page: str, tree: tuple) -> str:
    found = blocks(page)
    return "\n".join(b.text for b, x in zip(found, features(found)) if predict(tree, x) > 0.5)


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row for each input row: page_id, url, text: the blocks of main text joined by line feeds.

    A block ends at every element that is not inline and at two line breaks in a row. Blocks are classified by a decision
    tree on their words and link density, those of their neighbours, and where they stand, learned from the labelled pages
    above. Null and empty pages, and pages without main text, give an empty text; null ids and urls and repeated
    rows pass through. Scripts, styles and comments left open end with
    the page. Time is in proportion to a page's length.
    """
    tree = learned_tree()

    def make() -> Callable:
        return lambda id, url, page: (id, url, main_text(page, tree))

    rows = pages.select(
        F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{url_col}`").cast("string").alias("url"),
        F.coalesce(F.col(f"`{html_col}`").cast("string"), F.lit("")).alias("html"),
    )
    return map_rows(rows, make, "page_id long, url string, text string")
