"""Main text of web pages from flat text blocks and a decision tree.

A page is read once, tag by tag, into blocks of text; no tree of elements is built. A
block knows its number of words, the share of them in links, the same of its two
neighbours, and what is open around it. A small decision tree, trained here on a
labelled table of blocks, says which blocks are main text.
"""

from __future__ import annotations

import functools
import html
import re
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from bytelayout.llm.rows import id_and_text, map_texts

INSIDE = r"""(?:[^>"'/]++|"[^"]*"|'[^']*'|/(?!>))*+"""
# What has no text of the article: to its end tag, where that comes before the article, the body or another one
# of its kind begins or ends; else, and where it is closed at once, only its tag counts. Scripts and styles go on
# to the end of the page.
TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)"""
    r"""|<(script|style)\b[^>]*>.*?(?:</\1\s*>|\Z)"""
    r"""|<(noscript|template|iframe|object|svg|canvas|select|button|textarea|head|title)\b""" + INSIDE
    + r""">(?:[^<]++|<(?!/?(?:article|main|body)\b|\2\b|/\2\s*>))*+</\2\s*>"""
    r"""|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^>"']++|"[^"]*"|'[^']*')*+)/?>|</?[a-zA-Z][^>]*>|<[!?][^>]*>""",
    re.DOTALL | re.IGNORECASE,
)
ATTRIBUTE = re.compile(r"""\b(class|id|role|style|hidden|aria-hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.IGNORECASE)
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")

INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp "
    "small span strike strong sub sup time tt u var wbr br input".split()
)
CONTAINERS = frozenset(
    "html body div section article main nav header footer aside form ul ol dl table figure fieldset details "
    "dialog menu search center".split()
)
BOILER_TAGS = frozenset("nav footer aside form dialog menu search fieldset".split())
# Words of class, id and role that mark what is not the article.
BOILER_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies "
    "consent gdpr notice alert popup modal overlay newsletter subscribe subscription signup menu nav navbar "
    "navigation breadcrumb breadcrumbs sidebar aside widget widgets related recommended recommendations share "
    "sharing social footer masthead comment comments disqus reply replies respond discussion login search form "
    "pagination pager skip contentinfo complementary dialog paywall toolbar copyright legal disclaimer".split()
)
HEAD_WORDS = frozenset(("header", "topbar", "site-header"))


@dataclass
class Block:
    text: str
    words: int
    linked: int
    boiler: bool
    article: bool
    heading: bool


# Of what is around a block: nothing, a name that has a word of those above in it or a form, such a name as a whole.
NONE, MAYBE, SURE = 0, 1, 2


def marked(attributes: str) -> tuple[int, bool]:
    """How surely class, id or role mark something else than the article, and whether they mark a page header."""
    boiler, head = NONE, False
    for name, double, single, bare in ATTRIBUTE.findall(attributes):
        value, name = double or single or bare, name.lower()
        if name in ("class", "id", "role"):
            words = {word.lower() for word in WORD.findall(value)}
            if not BOILER_WORDS.isdisjoint(value.lower().split()):
                boiler = SURE
            elif not words.isdisjoint(BOILER_WORDS):
                boiler = max(boiler, MAYBE)
            head |= not words.isdisjoint(HEAD_WORDS)
        elif name == "style":
            boiler = SURE if "display:none" in value.replace(" ", "").lower() else boiler
        else:
            boiler = SURE if value.lower() != "false" else boiler
    return boiler, head


def blocks(page: str) -> list[Block]:
    """Texts between block-level tags, in page order, empty ones left out."""
    found: list[Block] = []
    parts: list[str] = []
    linked: list[str] = []
    opened: list[tuple[str, int, bool]] = [("", NONE, False)]  # tag, boiler, article
    link, heading, once, at = 0, False, False, 0

    def flush() -> None:
        nonlocal once
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            _, boiler, article = opened[-1]
            inside = len(html.unescape("".join(linked)).split())
            words = text.count(" ") + 1
            found.append(Block(text, words, min(inside, words), boiler > NONE or once, article, heading))
        parts.clear()
        linked.clear()
        once = False

    for match in TAG.finditer(page):
        start, end = match.span()
        if start > at:
            parts.append(page[at:start])
            if link:
                linked.append(page[at:start])
        at = end
        script, other, slash, tag, attributes = match.groups()
        if script or other:
            if other:
                flush()
            continue
        if tag is None:
            continue
        tag = tag.lower()
        if tag in INLINE:
            if tag == "a":
                link = 0 if slash else 1
            elif tag == "br":
                parts.append(" ")
                linked.append(" ")
            continue
        flush()
        link = 0
        heading = not slash and len(tag) == 2 and tag[0] == "h" and tag[1].isdigit()
        if tag in CONTAINERS:
            if slash:
                for depth in range(len(opened) - 1, 0, -1):
                    if opened[depth][0] == tag:
                        del opened[depth:]
                        break
            else:
                _, boiler, article = opened[-1]
                by_name, by_head = marked(attributes) if attributes else (NONE, False)
                outside, article = not article, article or tag in ("article", "main")
                if tag in ("article", "main"):
                    if outside and boiler == MAYBE:  # a wrapper of the article, whatever its name
                        boiler = NONE
                elif tag not in ("body", "html"):
                    head = not article and (tag == "header" or by_head)
                    by_tag = MAYBE if tag == "form" else SURE if tag in BOILER_TAGS or head else NONE
                    boiler = max(boiler, by_name, by_tag)
                opened.append((tag, boiler, article))
        elif not slash and attributes:
            once = marked(attributes)[0] >= (SURE if opened[-1][2] else MAYBE)  # a paragraph of an article may have any name
    if at < len(page):
        parts.append(page[at:])
    flush()
    return found


FEATURES = (
    "words", "link_density", "words_before", "link_density_before", "words_after", "link_density_after",
    "boiler", "in_article", "page_has_article", "heading",
)

# Blocks labelled by hand: the features above and whether the block is main text.
LABELLED = (
    # menus, footers, adverts, notices, forms, comments: something around them says so
    (1, 1.0, 0, 0.0, 1, 1.0, 1, 0, 1, 0, 0), (1, 1.0, 1, 1.0, 1, 1.0, 1, 0, 1, 0, 0),
    (1, 1.0, 1, 1.0, 8, 0.0, 1, 0, 1, 0, 0), (8, 0.0, 1, 1.0, 9, 0.0, 1, 0, 1, 0, 0),
    (14, 0.0, 60, 0.0, 0, 0.0, 1, 0, 1, 0, 0), (3, 0.0, 1, 1.0, 7, 0.0, 1, 0, 1, 1, 0),
    (45, 0.0, 80, 0.0, 30, 0.0, 1, 1, 1, 0, 0), (30, 0.0, 45, 0.0, 12, 0.0, 1, 1, 1, 0, 0),
    (6, 0.0, 120, 0.0, 90, 0.0, 1, 1, 1, 0, 0), (2, 0.5, 90, 0.0, 4, 0.0, 1, 1, 1, 1, 0),
    (1, 1.0, 2, 1.0, 2, 1.0, 1, 0, 0, 0, 0), (25, 0.1, 3, 1.0, 40, 0.0, 1, 0, 0, 0, 0),
    (60, 0.0, 90, 0.0, 20, 0.0, 1, 0, 0, 0, 0), (5, 0.2, 70, 0.0, 0, 0.0, 1, 0, 0, 1, 0),
    (120, 0.0, 60, 0.0, 0, 0.0, 1, 0, 0, 0, 0), (18, 0.9, 6, 0.0, 4, 1.0, 1, 0, 0, 0, 0),
    (200, 0.0, 150, 0.0, 90, 0.0, 1, 1, 1, 0, 0), (350, 0.02, 80, 0.0, 0, 0.0, 1, 0, 1, 0, 0),
    # an article element: what is in it
    (7, 0.0, 8, 0.0, 60, 0.0, 0, 1, 1, 1, 1), (60, 0.0, 7, 0.0, 80, 0.0, 0, 1, 1, 0, 1),
    (1, 0.0, 60, 0.0, 1, 0.0, 0, 1, 1, 0, 1), (1, 0.0, 1, 0.0, 14, 0.0, 0, 1, 1, 0, 1),
    (2, 0.0, 90, 0.0, 0, 0.0, 0, 1, 1, 0, 1), (200, 0.05, 3, 0.0, 12, 0.0, 0, 1, 1, 0, 1),
    (12, 0.4, 40, 0.0, 60, 0.1, 0, 1, 1, 0, 1), (5, 1.0, 30, 0.0, 30, 0.0, 0, 1, 1, 0, 1),
    (3, 0.0, 1, 1.0, 2, 0.0, 0, 1, 1, 1, 1), (30, 0.8, 50, 0.0, 14, 0.0, 0, 1, 1, 0, 1),
    (9, 0.0, 0, 0.0, 0, 0.0, 0, 1, 1, 0, 1), (1, 1.0, 20, 0.0, 14, 0.0, 0, 1, 1, 0, 1),
    # and what is not
    (10, 0.0, 5, 1.0, 6, 0.0, 0, 0, 1, 0, 0), (40, 0.0, 90, 0.0, 12, 0.2, 0, 0, 1, 0, 0),
    (2, 0.0, 0, 0.0, 3, 1.0, 0, 0, 1, 1, 0), (14, 0.1, 70, 0.0, 0, 0.0, 0, 0, 1, 0, 0),
    (90, 0.0, 14, 0.0, 20, 0.0, 0, 0, 1, 0, 0), (1, 1.0, 1, 1.0, 6, 0.0, 0, 0, 1, 0, 0),
    # a page of one text
    (12, 0.0, 0, 0.0, 0, 0.0, 0, 0, 0, 0, 1), (6, 0.0, 0, 0.0, 0, 0.0, 0, 0, 0, 0, 1),
    # no article element: long texts with few links, and short ones between such
    (60, 0.0, 4, 0.0, 80, 0.0, 0, 0, 0, 0, 1), (35, 0.05, 60, 0.0, 3, 1.0, 0, 0, 0, 0, 1),
    (120, 0.1, 2, 1.0, 2, 0.0, 0, 0, 0, 0, 1), (25, 0.0, 90, 0.0, 45, 0.0, 0, 0, 0, 0, 1),
    (18, 0.0, 3, 0.0, 30, 0.0, 0, 0, 0, 0, 1), (6, 0.0, 60, 0.0, 50, 0.0, 0, 0, 0, 0, 1),
    (2, 0.0, 80, 0.0, 70, 0.0, 0, 0, 0, 0, 1), (8, 0.0, 3, 1.0, 60, 0.0, 0, 0, 0, 1, 1),
    (4, 0.0, 2, 1.0, 45, 0.0, 0, 0, 0, 1, 1), (5, 0.0, 90, 0.0, 60, 0.0, 0, 0, 0, 1, 1),
    (22, 0.2, 30, 0.0, 40, 0.1, 0, 0, 0, 0, 1), (300, 0.0, 0, 0.0, 0, 0.0, 0, 0, 0, 0, 1),
    (1, 1.0, 0, 0.0, 1, 1.0, 0, 0, 0, 0, 0), (3, 1.0, 2, 1.0, 4, 1.0, 0, 0, 0, 0, 0),
    (2, 1.0, 1, 1.0, 50, 0.0, 0, 0, 0, 0, 0), (12, 0.9, 40, 0.0, 10, 1.0, 0, 0, 0, 0, 0),
    (20, 0.8, 3, 1.0, 3, 1.0, 0, 0, 0, 0, 0), (4, 0.0, 3, 1.0, 2, 1.0, 0, 0, 0, 0, 0),
    (6, 0.1, 2, 1.0, 1, 0.0, 0, 0, 0, 0, 0), (9, 0.3, 5, 0.8, 0, 0.0, 0, 0, 0, 0, 0),
    (3, 0.0, 1, 0.0, 2, 0.0, 0, 0, 0, 0, 0), (5, 1.0, 60, 0.0, 50, 0.0, 0, 0, 0, 0, 0),
    (40, 0.7, 6, 1.0, 5, 1.0, 0, 0, 0, 0, 0), (2, 0.0, 4, 1.0, 0, 0.0, 0, 0, 0, 1, 0),
    (24, 0.0, 3, 0.0, 2, 0.0, 0, 0, 0, 0, 1), (2, 0.0, 24, 0.0, 24, 0.0, 0, 0, 0, 0, 1),
    (24, 0.0, 2, 0.0, 25, 0.0, 0, 0, 0, 0, 1), (40, 0.0, 24, 0.0, 1, 0.0, 0, 0, 0, 0, 1),
    (16, 0.0, 2, 0.0, 3, 0.0, 0, 0, 0, 0, 1), (15, 0.1, 20, 0.0, 2, 0.5, 0, 0, 0, 0, 1),
    (30, 0.0, 0, 0.0, 2, 1.0, 0, 0, 0, 0, 1), (55, 0.1, 1, 0.0, 1, 0.0, 0, 0, 0, 0, 1),
    (28, 0.0, 1, 1.0, 5, 0.0, 0, 0, 0, 0, 1), (19, 0.0, 22, 0.0, 6, 0.0, 0, 0, 0, 0, 1),
    (11, 0.0, 30, 0.0, 28, 0.0, 0, 0, 0, 0, 1), (3, 0.0, 24, 0.0, 26, 0.0, 0, 0, 0, 0, 1),
    (1, 0.0, 40, 0.0, 35, 0.0, 0, 0, 0, 0, 1), (14, 0.0, 24, 0.0, 2, 0.0, 0, 0, 0, 0, 1),
    (3, 0.0, 1, 1.0, 24, 0.0, 0, 0, 0, 1, 1), (6, 0.0, 5, 0.0, 30, 0.0, 0, 0, 0, 1, 1),
    (2, 0.0, 25, 0.0, 22, 0.0, 0, 0, 0, 1, 1), (17, 0.0, 4, 1.0, 3, 1.0, 0, 0, 0, 0, 1),
    (21, 0.3, 6, 0.0, 4, 0.0, 0, 0, 0, 0, 1), (80, 0.2, 1, 1.0, 1, 1.0, 0, 0, 0, 0, 1),
    (13, 0.0, 18, 0.0, 19, 0.0, 0, 0, 0, 0, 1), (5, 0.0, 18, 0.0, 20, 0.0, 0, 0, 0, 1, 1),
    (24, 0.0, 30, 0.0, 2, 1.0, 0, 0, 0, 0, 1), (22, 0.0, 3, 0.0, 1, 1.0, 0, 0, 0, 0, 1),
    (4, 0.0, 2, 0.0, 3, 0.0, 0, 0, 0, 0, 0), (6, 0.0, 2, 0.0, 2, 0.0, 0, 0, 0, 0, 0),
    (8, 0.0, 1, 1.0, 2, 0.0, 0, 0, 0, 0, 0), (10, 0.6, 24, 0.0, 30, 0.0, 0, 0, 0, 0, 0),
    (7, 0.0, 3, 1.0, 4, 1.0, 0, 0, 0, 0, 0), (12, 0.5, 5, 0.5, 2, 1.0, 0, 0, 0, 0, 0),
    (5, 0.0, 24, 0.0, 3, 1.0, 0, 0, 0, 0, 0), (3, 0.0, 30, 0.0, 1, 1.0, 0, 0, 0, 0, 0),
    (2, 0.0, 3, 1.0, 24, 0.0, 0, 0, 0, 0, 0), (9, 0.0, 2, 0.0, 1, 1.0, 0, 0, 0, 0, 0),
    (1, 0.0, 2, 0.0, 2, 0.0, 0, 0, 0, 0, 0), (4, 1.0, 24, 0.0, 24, 0.0, 0, 0, 0, 0, 0),
    (8, 0.9, 20, 0.0, 20, 0.0, 0, 0, 0, 0, 0), (24, 0.7, 2, 1.0, 2, 1.0, 0, 0, 0, 0, 0),
    (30, 0.9, 9, 0.0, 9, 0.0, 0, 0, 0, 0, 0), (3, 0.0, 2, 1.0, 2, 1.0, 0, 0, 0, 1, 0),
    (4, 0.0, 30, 0.0, 2, 1.0, 0, 0, 0, 1, 0), (10, 0.0, 4, 0.0, 0, 0.0, 0, 0, 0, 0, 0),
    (8, 0.0, 50, 0.0, 0, 0.0, 0, 0, 0, 0, 0), (11, 0.1, 3, 1.0, 3, 1.0, 0, 0, 0, 0, 0),
)

# A leaf is a class; a split is (feature, threshold, at or below, above).
Tree = int | tuple[int, float, "Tree", "Tree"]


def gini(labels: np.ndarray) -> float:
    share = labels.mean() if len(labels) else 0.0
    return len(labels) * 2 * share * (1 - share)


def grow(rows: np.ndarray, labels: np.ndarray, depth: int = 8) -> Tree:
    """A binary tree by the largest fall in Gini impurity; the first feature wins a tie."""
    best: tuple[float, int, float] | None = None
    if depth and 0 < labels.sum() < len(labels):
        for feature in range(rows.shape[1]):
            values = np.unique(rows[:, feature])
            for threshold in (values[1:] + values[:-1]) / 2:
                below = rows[:, feature] <= threshold
                impurity = gini(labels[below]) + gini(labels[~below])
                if best is None or impurity < best[0] - 1e-9:
                    best = impurity, feature, float(threshold)
    if best is None:
        return int(2 * labels.sum() >= len(labels))
    _, feature, threshold = best
    below = rows[:, feature] <= threshold
    return feature, threshold, grow(rows[below], labels[below], depth - 1), grow(rows[~below], labels[~below], depth - 1)


@functools.lru_cache(maxsize=4)
def trained(labelled: tuple[tuple[float, ...], ...] = LABELLED) -> Tree:
    table = np.array(labelled, float)
    return grow(table[:, :-1], table[:, -1].astype(int))


def decide(tree: Tree, row: tuple[float, ...]) -> int:
    while not isinstance(tree, int):
        feature, threshold, below, above = tree
        tree = below if row[feature] <= threshold else above
    return tree


def feature_rows(found: list[Block]) -> list[tuple[float, ...]]:
    shape = [(0.0, 0.0), *((float(b.words), b.linked / b.words) for b in found), (0.0, 0.0)]
    has_article = float(any(b.article for b in found))
    return [
        (*shape[at], *shape[at - 1], *shape[at + 1], float(b.boiler), float(b.article), has_article, float(b.heading))
        for at, b in enumerate(found, start=1)
    ]


def main_text(page: str, tree: Tree) -> str:
    found = blocks(page)
    return "\n".join(b.text for b, row in zip(found, feature_rows(found), strict=True) if decide(tree, row))


def extract(
    pages: DataFrame, id_col: str = "page_id", html_col: str = "html", labelled: tuple[tuple[float, ...], ...] = LABELLED
) -> DataFrame:
    """`doc_id` and `text` of every page: its main blocks, one a line.

    Character references are decoded and white space within a block becomes one blank.
    A null or empty page, and one without main text, gives the empty text. Unclosed and
    crossed tags are taken as they come: an end tag closes the nearest open container of
    its name. Repeated rows are extracted each. Bytes that are no UTF-8 count as U+FFFD.
    """
    tree = trained(labelled)

    def each() -> Callable[[list[bytes]], list[list]]:
        return lambda texts: [[main_text(text.decode(errors="replace"), tree) for text in texts]]

    return map_texts(id_and_text(pages, id_col, html_col), [T.StructField("text", T.StringType())], each)
