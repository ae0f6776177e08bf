"""Main text of web pages from streaming parser events.

The standard library's parser reads a page once, event by event, into lines: one per block, with its text, the number of tags
that made it, its place among the enclosing containers and whether an enclosing element says by its tag or by a whole class, id or
role (not by the id of a heading or section) that it is a menu, header, footer, sidebar, notice, advert, form or comment section. Then

1. each line gets its text-to-tag ratio (characters outside links per tag; 0 for a line that is marked so),
2. the ratios are smoothed with a Gaussian along the page,
3. lines at or above a threshold from the spread of the smoothed ratios make clusters of adjacent content lines,
4. from the root, the content region narrows down to the container that still holds most of the characters in clusters, but never into an
   article or main element, and all its unmarked lines are the text, short ones between clusters included. Outside of such an element, lines that
   are links only are not, and the unmarked lines that stand in the containers around the chosen one themselves are text too.

A map without any shuffle; the page is read whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolefit.llm.common import text_slices

# Elements of HTML by what they are.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CONTAINERS = frozenset("html body main article section div td th blockquote center figure details".split())
BLOCKS = CONTAINERS | frozenset("p li ul ol dl dt dd h1 h2 h3 h4 h5 h6 pre table thead tbody tfoot tr caption hr header footer nav aside form fieldset "
                                "address figcaption summary dialog menu title head option select".split())
UNREAD = frozenset("script style noscript template iframe object svg canvas head title select option button textarea datalist".split())
MARKED = frozenset("nav footer aside form menu dialog".split())
#: Words of class, id or role that mark an element as no part of the article.
MARK_WORDS = frozenset("ad adbox ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice "
                       "notices alert popup modal overlay nav navbar navigation menu menus breadcrumb breadcrumbs footer sidebar aside widget widgets "
                       "comment comments disqus replies reply share sharing social related recommended newsletter subscribe subscription signup "
                       "login search form toolbar pagination pager tags masthead skip".split())
#: Words that make a known compound with mark words, as in related-posts; any other word beside them is part of a name, as in related-work.
COMPOUND_WORDS = frozenset("area articles bar block box button buttons container content count dialog field global google icon icons info inline inner item "
                           "items label large law left link links list main media middle mobile module network outer page panel placeholder post posts "
                           "primary reader readers right row secondary section site slot small sticky stories thread title top bottom trail unit user "
                           "users wrap wrapper".split())
#: Elements whose ids name what they are about.
NAMED = frozenset("section h1 h2 h3 h4 h5 h6".split())
HEADER_WORDS = frozenset("header topbar top masthead".split())
#: Words beside which a header is that of the page; beside any other, as in post-header or top-story, it belongs to what it names.
PAGE_WORDS = frozenset("bar container fixed global inner main page primary site sticky wrap wrapper".split())
_WORD = re.compile(r"[a-z0-9]+")
_CLOSES_P = BLOCKS - frozenset(("title", "head", "option", "select"))

SIGMA, RADIUS, SHARE, ARTICLE_WEIGHT = 1.0, 3, 0.8, 1000.0


def is_mark(name: str) -> bool:
    """Whether a class, id or role as a whole is a mark word or a compound of mark words and known others."""
    words = _WORD.findall(name)
    return any(w in MARK_WORDS for w in words) and all(w in MARK_WORDS or w in COMPOUND_WORDS or w.isdigit() for w in words)


def is_page_header(name: str) -> bool:
    words = _WORD.findall(name)
    return any(w in HEADER_WORDS for w in words) and all(w in HEADER_WORDS or w in PAGE_WORDS for w in words)


class Lines(HTMLParser):
    """Collects the lines of a page."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, int, int, bool]] = []  # text, characters in links, tags, container, marked
        self.parents = [-1]  # of each container; 0 is the page
        self.weight = [1.0]
        self.article = [False]  # whether the container is an article or main element or inside one
        self.stack: list[tuple[str, int, bool, bool, bool]] = [("", 0, False, False, False)]  # tag, container, marked, unread, in article
        self.parts: list[str] = []
        self.tags = self.link_chars = self.in_link = 0

    def flush(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                _, container, marked, *_ = self.stack[-1]
                self.lines.append((text, min(self.link_chars, len(text)), self.tags, container, marked))
            self.parts = []
        self.tags = self.link_chars = 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "br":
            self.parts.append(" ")
        if tag in VOID:
            if tag == "hr":
                self.flush()
            self.tags += 1
            return
        if tag in ("article", "main") and self.stack[-1][2] and not self.stack[-1][4]:
            # whatever menu or advert was left open ends where the article starts
            self.flush()
            while self.stack[-1][2]:
                self.stack.pop()
        if tag in BLOCKS:
            self.flush()
            if tag in _CLOSES_P and self.stack[-1][0] == "p" or tag == "li" and self.stack[-1][0] == "li":
                self.stack.pop()
        self.tags += 1
        if tag == "a":
            self.in_link += 1
            return
        if tag not in BLOCKS and tag not in UNREAD:
            return
        _, container, marked, unread, within = self.stack[-1]
        names = [(name, value.lower()) for name, value in attrs if value and name in ("class", "id", "role")]
        within = within or tag in ("article", "main")
        if tag not in ("html", "body", "article", "main"):
            values = [one for name, value in names if name != "id" or tag not in NAMED for one in value.split()]
            marked = marked or tag in MARKED or any(is_mark(one) for one in values)
            if not within:
                marked = marked or tag == "header" or any(is_page_header(one) for one in values)
        unread = unread or tag in UNREAD
        if tag in CONTAINERS:
            self.parents.append(container)
            self.weight.append(ARTICLE_WEIGHT if within else 1.0)
            self.article.append(within)
            container = len(self.parents) - 1
        self.stack.append((tag, container, marked, unread, within))

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag == "a":
            self.in_link = max(0, self.in_link - 1)
            return
        if tag not in BLOCKS and tag not in UNREAD:
            return
        for depth in range(len(self.stack) - 1, 0, -1):
            if self.stack[depth][0] == tag:
                self.flush()
                del self.stack[depth:]
                return
        if tag in BLOCKS:
            self.flush()

    def handle_data(self, data: str) -> None:
        if not self.stack[-1][3]:
            self.parts.append(data)
            if self.in_link:
                self.link_chars += len(data.strip())


def smoothed_ratios(lines: list[tuple[str, int, int, int, bool]]) -> np.ndarray:
    ratio = np.array([0.0 if marked else (len(text) - links) / max(1, tags) for text, links, tags, _, marked in lines])
    kernel = np.exp(-0.5 * (np.arange(-RADIUS, RADIUS + 1) / SIGMA) ** 2)
    return np.convolve(np.pad(ratio, RADIUS), kernel, "valid") / np.convolve(np.pad(np.ones(len(ratio)), RADIUS), kernel, "valid")


def content_lines(lines: list[tuple[str, int, int, int, bool]]) -> np.ndarray:
    """Which lines belong to clusters: those whose smoothed ratio reaches the spread of all, or half of the largest if that is less."""
    smooth = smoothed_ratios(lines)
    unmarked = np.array([not line[4] for line in lines])
    return (smooth >= min(smooth.std(), smooth.max() / 2)) & (smooth > 0) & unmarked


def extract(html: str) -> str:
    """The main text of a page, its blocks joined by line feeds; empty if there is none."""
    parser = Lines()
    parser.feed(html)
    parser.close()
    parser.flush()
    lines, parents = parser.lines, parser.parents
    if not lines:
        return ""
    chosen = content_lines(lines)
    mass = np.zeros(len(parents))
    for (text, links, _, container, _), taken in zip(lines, chosen):
        if taken:
            mass[container] += (len(text) - links) * parser.weight[container]
    for node in range(len(parents) - 1, 0, -1):  # a container comes after its parent
        mass[parents[node]] += mass[node]
    if not mass[0]:  # no text but links: those of an article are its text
        return "\n".join(text for text, _, _, container, marked in lines if parser.article[container] and not marked)
    children: list[list[int]] = [[] for _ in parents]
    for node in range(1, len(parents)):
        children[parents[node]].append(node)
    region = 0
    around = []
    while children[region] and not parser.article[region]:
        largest = max(children[region], key=lambda c: mass[c])
        if mass[largest] < SHARE * mass[region]:
            break
        around.append(region)
        region = largest
    inside = np.zeros(len(parents), bool)
    inside[region] = True
    for node in range(region + 1, len(parents)):
        inside[node] = inside[parents[node]]
    if not parser.article[region]:
        inside[around] = True
    return "\n".join(text for (text, links, _, container, marked), taken in zip(lines, chosen)
                     if inside[container] and not marked and (taken or links < len(text) or parser.article[container]))


def extract_text(pages: DataFrame, key: str = "page_id", html: str = "html", carry: tuple[str, ...] = ("url",)) -> DataFrame:
    """key, the carried columns, text and n_chars (its code points) for every row.

    A null or empty page has an empty text. Repeated rows stay repeated. Other columns are not read; the two new columns
    take the place of input columns of the same names, which cannot be carried.
    """
    kept = [key, *(c for c in carry if c not in ("text", "n_chars", key))]
    types = ", ".join(f"c{i} {pages.schema[c].dataType.simpleString()}" for i, c in enumerate(kept))

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_slices(batches, "html"):
            found = [extract(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [*(part.column(i) for i in range(len(kept))), pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())],
                [*(f"c{i}" for i in range(len(kept))), "text", "n_chars"])

    out = pages.select(*(F.col(c).alias(f"c{i}") for i, c in enumerate(kept)), F.col(html).alias("html")).mapInArrow(
        step, f"{types}, text string, n_chars long")
    return out.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(kept)), "text", "n_chars")
