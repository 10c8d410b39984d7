"""HTML extraction from flat text blocks, classified by a decision tree.

A page is read as a flat run of text blocks. A block is described by its words and link density, those of its
neighbours, and by what encloses it (an article; navigation, notices and the like, told by element or by the
words of class, id and role; a name or a form around an article doesn't make it none). A decision tree, trained on the small labelled table below, says which blocks
are the main text.

Defined cases: a null or empty html, and a page without main text, give the empty text; markup that is left
open ends with what encloses it or with the page; a null url stays null; repeated rows are separate pages.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession

from .common import texts

# Elements of HTML by what they do to text.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup "
    "hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe object svg math select button canvas audio video noembed noframes xmp head".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: What encloses a block: nothing of note, a form, something that only names itself boilerplate, or something that is.
CLEAR, FORM, WEAK, STRONG = 0, 1, 2, 3
#: A form that holds so many times the words that are outside of it and of boilerplate is the page itself.
WHOLE_PAGE = 10
BOILER = {"nav": STRONG, "footer": STRONG, "aside": STRONG, "menu": STRONG, "dialog": STRONG, "search": STRONG, "form": FORM, "fieldset": FORM}
GOOD = frozenset(("article", "main"))
# Words of class, id or role that name what encloses a block: beside the text without doubt, or likely so.
STRONG_WORDS = frozenset(
    "ad ads adbox advert adverts advertisement advertising adsense sponsor sponsored promo promotion cookie cookies consent gdpr nav navbar navigation menu breadcrumb "
    "breadcrumbs comment comments commentlist commentform respond reply replies disqus pagination pager contentinfo complementary".split()
)
WEAK_WORDS = frozenset(
    "popup modal overlay newsletter subscribe subscription signup login search banner notice notices alert footer header masthead sidebar aside widget widgets related recommended share sharing social toc copyright legal disclaimer toolbar skip hidden".split()
)
#: Words that say what shape something has, not what it is: a comment-list is comments, a legal-basis isn't legal matter.
SHAPES = frozenset(
    "area bar block body bottom box boxes bottomline button buttons card cards center col column container content contents div element first form group holder icon icons id inner item items last "
    "left link links list main middle module news outer page panel placement post posts region right row section side sidebar slot small stories story tags text title top unit wrap wrapper zone articles".split()
)
#: Words before another that turn it into a property of what encloses the text: has-sidebar, no-header.
PROPERTIES = frozenset("has have no not non with without is hide show after before".split())
GOOD_WORDS = frozenset("article articlebody content post entry story main maincontent body text prose".split())
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
LISTS = frozenset(("ul", "ol", "menu"))

# A quote opens a value only right after "="; anywhere else it is a character like others, and ">" ends the tag.
TAG = re.compile(r"<!--.*?(?:--!?>|\Z)|<[!?][^>]*(?:>|\Z)|</([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)|<([a-zA-Z][^\s/>]*)((?:[^>=]++|=\s*(?:\"[^\"]*\"|'[^']*'|[^\s>\"'][^\s>]*)?)*+)>|<[a-zA-Z][^>]*\Z", re.S)
NAMED = re.compile(r"(?:\s|^|[\"'])(class|id|role|itemprop|hidden|aria-hidden)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
SPACE = re.compile(r"\s+")
ENDS = {tag: re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.I) for tag in RAW}
HEAD_ENDS = re.compile(r"<body(?=[\s/>])|</head", re.I)
TO_THE_END = frozenset("script style textarea title xmp".split())

FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "place", "heading")
#: A block's place: outside of the text by what encloses it or beside an article; on a page without article; in one.
OUTSIDE, UNMARKED, INSIDE = 0.0, 1.0, 2.0
# Fixed values, in the order of FEATURES, then 1 for main text: the labelled table that the tree is trained on.
LABELLED = (
    # Inside an article: text of any length, headings, lists of links that belong to the text.
    (60, 0.00, 45, 0.0, 80, 0.0, 2, 0, 1), (120, 0.02, 60, 0.0, 90, 0.0, 2, 0, 1), (5, 0.00, 60, 0.0, 90, 0.0, 2, 0, 1), (1, 0.00, 30, 0.0, 2, 0.0, 2, 0, 1),
    (7, 0.00, 9, 0.0, 70, 0.0, 2, 1, 1), (3, 0.00, 2, 1.0, 40, 0.1, 2, 1, 1), (14, 1.00, 40, 0.0, 33, 0.0, 2, 0, 1), (2, 1.00, 22, 0.0, 3, 1.0, 2, 0, 1),
    (35, 0.30, 50, 0.1, 4, 0.0, 2, 0, 1), (900, 0.00, 3, 0.0, 6, 0.3, 2, 0, 1), (12, 0.00, 0, 0.0, 0, 0.0, 2, 0, 1), (8, 0.10, 4, 1.0, 6, 0.5, 2, 0, 1),
    # The page's first or last block, in an article.
    (4, 0.00, 0, 0.0, 83, 0.0, 2, 1, 1), (7, 0.00, 0, 0.0, 35, 0.1, 2, 1, 1), (2, 0.00, 0, 0.0, 5, 0.0, 2, 1, 1), (9, 0.00, 0, 0.0, 3, 0.0, 2, 0, 1),
    (2, 0.00, 40, 0.0, 0, 0.0, 2, 0, 1), (5, 0.00, 60, 0.0, 0, 0.0, 2, 1, 1), (3, 1.00, 0, 0.0, 70, 0.0, 2, 0, 1), (3, 1.00, 20, 0.0, 0, 0.0, 2, 0, 1),
    (4, 0.00, 0, 0.0, 30, 0.0, 2, 1, 1), (3, 0.00, 0, 0.0, 50, 0.0, 2, 1, 1), (1, 0.00, 0, 0.0, 66, 0.0, 2, 0, 1), (4, 0.00, 0, 0.0, 21, 0.0, 2, 1, 1),
    # Enclosed by something that names itself no part of the text, in an article or out of it.
    (9, 0.00, 60, 0.0, 90, 0.0, 0, 0, 0), (70, 0.00, 45, 0.0, 50, 0.0, 0, 0, 0), (2, 1.00, 2, 1.0, 2, 1.0, 0, 0, 0), (8, 0.00, 1, 1.0, 7, 0.0, 0, 0, 0),
    (11, 0.00, 80, 0.0, 0, 0.0, 0, 0, 0), (45, 0.00, 70, 0.0, 40, 0.0, 0, 0, 0), (160, 0.00, 30, 0.0, 60, 0.0, 0, 0, 0), (4, 0.00, 90, 0.0, 35, 0.0, 0, 1, 0),
    (1, 1.00, 1, 1.0, 1, 1.0, 0, 0, 0), (20, 0.50, 3, 1.0, 9, 0.2, 0, 0, 0), (3, 0.00, 5, 0.0, 120, 0.0, 0, 1, 0), (25, 0.00, 8, 0.0, 2, 0.0, 0, 0, 0),
    (2, 1.00, 60, 0.0, 2, 1.0, 0, 0, 0), (3, 1.00, 2, 1.0, 40, 0.0, 0, 0, 0), (6, 0.80, 30, 0.0, 50, 0.1, 0, 0, 0), (40, 0.60, 20, 0.0, 9, 1.0, 0, 0, 0),
    (12, 0.50, 50, 0.0, 0, 0.0, 0, 0, 0), (5, 1.00, 5, 1.0, 5, 1.0, 0, 0, 0), (1, 1.00, 80, 0.0, 90, 0.0, 0, 0, 0), (9, 1.00, 3, 0.0, 4, 0.0, 0, 1, 0),
    # Beside an article.
    (6, 0.00, 2, 1.0, 8, 0.0, 0, 0, 0), (30, 0.00, 90, 0.0, 5, 0.0, 0, 0, 0), (2, 1.00, 2, 1.0, 2, 1.0, 0, 0, 0), (4, 0.00, 3, 0.0, 70, 0.0, 0, 1, 0),
    (75, 0.00, 40, 0.0, 12, 0.0, 0, 0, 0), (10, 0.90, 5, 1.0, 6, 0.8, 0, 0, 0), (140, 0.10, 3, 0.0, 3, 1.0, 0, 0, 0), (1, 0.00, 1, 0.0, 1, 0.0, 0, 0, 0),
    # Pages that mark no article: length and links of the block and of its neighbours tell.
    (60, 0.00, 45, 0.0, 80, 0.0, 1, 0, 1), (200, 0.05, 3, 0.0, 90, 0.0, 1, 0, 1), (18, 0.00, 50, 0.0, 60, 0.0, 1, 0, 1), (6, 0.00, 45, 0.0, 60, 0.0, 1, 0, 1),
    (4, 0.00, 2, 1.0, 75, 0.0, 1, 1, 1), (9, 0.00, 0, 0.0, 40, 0.1, 1, 1, 1), (28, 0.20, 4, 0.0, 40, 0.0, 1, 0, 1), (33, 0.00, 6, 0.5, 3, 1.0, 1, 0, 1),
    (8, 0.00, 30, 0.0, 20, 0.1, 1, 0, 1), (110, 0.00, 0, 0.0, 0, 0.0, 1, 0, 1), (25, 0.00, 0, 0.0, 0, 0.0, 1, 0, 1), (5, 0.00, 25, 0.0, 33, 0.0, 1, 1, 1),
    (2, 1.00, 2, 1.0, 2, 1.0, 1, 0, 0), (1, 1.00, 0, 0.0, 1, 1.0, 1, 0, 0), (12, 0.90, 2, 1.0, 30, 0.0, 1, 0, 0), (40, 0.85, 50, 0.0, 3, 1.0, 1, 0, 0),
    (5, 0.00, 3, 1.0, 4, 0.0, 1, 0, 0), (7, 0.20, 50, 0.0, 0, 0.0, 1, 0, 0), (3, 0.00, 2, 0.0, 2, 1.0, 1, 0, 0), (6, 0.50, 4, 0.0, 5, 0.5, 1, 0, 0),
    (3, 0.00, 2, 1.0, 1, 1.0, 1, 1, 0), (30, 0.70, 5, 1.0, 6, 1.0, 1, 0, 0), (8, 0.00, 90, 0.0, 2, 1.0, 1, 0, 0), (2, 0.00, 4, 0.3, 3, 0.0, 1, 1, 0),
    (60, 0.00, 3, 0.0, 2, 0.0, 1, 0, 1), (45, 0.00, 2, 1.0, 1, 0.0, 1, 0, 1), (22, 0.00, 3, 0.0, 4, 0.0, 1, 0, 1), (80, 0.10, 1, 1.0, 2, 1.0, 1, 0, 1),
    (17, 0.00, 4, 0.0, 0, 0.0, 1, 0, 1), (30, 0.00, 12, 0.0, 9, 0.0, 1, 0, 1), (250, 0.02, 6, 0.0, 3, 0.5, 1, 0, 1), (20, 0.15, 18, 0.0, 25, 0.1, 1, 0, 1),
    (50, 0.00, 0, 0.0, 3, 0.0, 1, 0, 1), (70, 0.20, 7, 0.0, 5, 0.0, 1, 0, 1), (100, 0.00, 2, 0.5, 1, 1.0, 1, 0, 1), (16, 0.10, 60, 0.0, 2, 1.0, 1, 0, 1),
    (19, 0.00, 2, 1.0, 2, 1.0, 1, 0, 1), (38, 0.25, 3, 0.0, 90, 0.0, 1, 0, 1), (26, 0.00, 5, 0.0, 4, 0.5, 1, 0, 1), (14, 0.00, 24, 0.0, 3, 0.0, 1, 0, 1),
    (2, 1.00, 0, 0.0, 4, 0.0, 1, 0, 0), (3, 1.00, 0, 0.0, 60, 0.0, 1, 0, 0), (2, 1.00, 60, 0.0, 0, 0.0, 1, 0, 0), (5, 1.00, 80, 0.0, 2, 1.0, 1, 0, 0),
    (1, 1.00, 40, 0.0, 30, 0.0, 1, 0, 0), (4, 0.80, 3, 0.0, 50, 0.0, 1, 0, 0), (9, 1.00, 0, 0.0, 7, 0.0, 1, 0, 0), (20, 1.00, 3, 0.0, 3, 0.0, 1, 0, 0),
    (3, 0.00, 0, 0.0, 2, 1.0, 1, 0, 0), (2, 0.00, 1, 1.0, 5, 1.0, 1, 0, 0), (4, 0.00, 2, 0.0, 3, 0.0, 1, 0, 0), (1, 0.00, 0, 0.0, 2, 0.0, 1, 0, 0),
    (6, 0.00, 5, 0.5, 4, 1.0, 1, 0, 0), (5, 0.00, 6, 0.0, 0, 0.0, 1, 0, 0), (3, 0.30, 2, 0.0, 6, 0.0, 1, 0, 0), (8, 0.00, 3, 1.0, 2, 1.0, 1, 0, 0),
    (60, 0.90, 2, 1.0, 3, 1.0, 1, 0, 0), (35, 0.75, 4, 0.0, 60, 0.0, 1, 0, 0), (25, 0.80, 30, 0.0, 40, 0.0, 1, 0, 0), (90, 0.70, 5, 0.0, 6, 0.0, 1, 0, 0),
    (16, 0.60, 3, 0.5, 2, 1.0, 1, 0, 0), (50, 0.60, 20, 0.5, 10, 1.0, 1, 0, 0), (18, 1.00, 40, 0.0, 60, 0.0, 1, 0, 0), (30, 0.95, 0, 0.0, 0, 0.0, 1, 0, 0),
    (5, 0.00, 2, 1.0, 60, 0.0, 1, 1, 1), (4, 0.00, 3, 0.0, 50, 0.0, 1, 1, 1), (2, 0.00, 40, 0.0, 45, 0.0, 1, 1, 1), (8, 0.00, 0, 0.0, 70, 0.0, 1, 1, 1),
    (3, 0.00, 2, 0.0, 2, 1.0, 1, 1, 0), (2, 0.00, 4, 0.0, 1, 1.0, 1, 1, 0), (6, 0.00, 30, 0.0, 3, 1.0, 1, 1, 0), (4, 0.10, 50, 0.0, 28, 0.0, 1, 1, 1),
    (2, 0.00, 60, 0.0, 50, 0.0, 1, 0, 1), (4, 0.00, 33, 0.0, 48, 0.0, 1, 0, 1), (7, 0.10, 40, 0.0, 36, 0.0, 1, 0, 1), (3, 0.00, 22, 0.0, 29, 0.0, 1, 0, 1),
    (9, 0.00, 55, 0.0, 21, 0.0, 1, 0, 1), (1, 0.00, 45, 0.0, 70, 0.0, 1, 0, 1), (10, 0.20, 30, 0.1, 26, 0.0, 1, 0, 1), (6, 0.00, 90, 0.0, 40, 0.1, 1, 0, 1),
)


@dataclass
class Block:
    parts: list[str] = field(default_factory=list)
    linked: list[str] = field(default_factory=list)
    level: int = CLEAR
    article: bool = False
    heading: bool = False
    rescued: int = 0
    text: str = ""
    words: int = 0
    links: float = 0.0

    @property
    def boiler(self) -> bool:
        return self.level > CLEAR

    def close(self) -> bool:
        self.text = SPACE.sub(" ", "".join(self.parts)).strip()
        self.words = len(self.text.split())
        self.links = min(1.0, len(" ".join(self.linked).split()) / self.words) if self.words else 0.0
        return bool(self.text)


@lru_cache(maxsize=4096)
def named(token: str) -> tuple[int, bool, bool]:
    """What one word of a class, id or role says: boilerplate (CLEAR, WEAK or STRONG), text, a header."""
    words = [w.lower() for w in WORDS.findall(token)]
    good = bool(set(words) & GOOD_WORDS)
    if not words or words[0] in PROPERTIES:
        return CLEAR, False, False
    while len(words) > 1 and words[-1] in SHAPES:
        words.pop()
    head = words[-1]
    level = STRONG if head in STRONG_WORDS or len(words) > 1 and words[0] in ("ad", "ads", "nav") else WEAK if head in WEAK_WORDS else CLEAR
    return level, good, head in ("header", "masthead")


def names(attributes: str, inside: bool) -> tuple[int, bool]:
    """How far class, id or role name something beside the text, and whether they name the text. A header inside an
    article is the article's."""
    boiler, good = CLEAR, False
    for m in NAMED.finditer(attributes):
        key, value = m[1].lower(), (m[2] or "").strip("\"'")
        if key == "hidden" or key == "aria-hidden" and value.lower() == "true":
            boiler = STRONG
        else:
            for token in value.split():
                level, fits, header = named(token)
                boiler = max(boiler, CLEAR if header and inside else level)
                good |= fits
    return boiler, good and not boiler


class Open:
    """The open elements of a page, each with what holds from it on: level of boilerplate, article, the place of what
    the article was rescued from (0: nothing), the place where boilerplate begins.

    The places of elements by name, and of blocks, say in one step what a search of the stack would: the work on a page
    grows with its length, however deep it nests."""

    def __init__(self):
        self.tags: list[str] = []
        self.states: list[tuple[int, bool, int, int]] = []
        self.places: dict[str, list[int]] = {}
        self.blocks: list[int] = []
        self.lists: list[int] = []
        self.heads = 0

    def state(self) -> tuple[int, bool, int, int]:
        return self.states[-1] if self.states else (CLEAR, False, 0, 0)

    def has(self, *tags: str) -> bool:
        return any(self.places.get(tag) for tag in tags)

    def push(self, tag: str, state: tuple[int, bool, int, int]) -> None:
        if tag in LISTS:
            self.lists.append(len(self.tags))
        if tag in BLOCKS:
            self.blocks.append(len(self.tags))
        self.heads += tag in HEADINGS
        self.places.setdefault(tag, []).append(len(self.tags))
        self.tags.append(tag)
        self.states.append(state)

    def close(self, tag: str) -> bool | None:
        """Close the last ``tag`` and all inside it: whether text before and after are separate blocks; None without one.
        The end of what is no block, as bold type, leaves the blocks open that began inside it."""
        if not self.has(tag):
            return None
        if tag not in BLOCKS and self.blocks and self.blocks[-1] > self.places[tag][-1]:
            self.forget(tag)
            return False
        before, apart = self.state(), False
        while True:
            last = self.tags.pop()
            self.states.pop()
            if last:
                self.places[last].pop()
            apart |= last in BLOCKS
            self.heads -= last in HEADINGS
            for places in (self.blocks, self.lists):
                if places and places[-1] >= len(self.tags):
                    places.pop()
            if last == tag:
                return apart or before != self.state()

    def forget(self, tag: str) -> None:
        """The last ``tag`` ends, but not what is inside it."""
        if self.has(tag):
            self.tags[self.places[tag].pop()] = ""


def within(outer: tuple[int, bool, int, int], bad: int, good: bool, tag: str, place: int) -> tuple[int, bool, int, int]:
    """What holds inside an element. An article or main that only a form or a name, be it its own, calls boilerplate is
    text again: rescued, which counts if the page has no other article."""
    level, article, rescued, begin = outer
    if tag in GOOD and CLEAR < max(level, bad) < STRONG:
        return CLEAR, True, begin if level else place, 0
    return max(level, bad), article or good or tag in GOOD, rescued, begin if level else place if bad else 0


def blocks(page: str) -> list[Block]:
    """The text blocks of a page in order, with what encloses them."""
    out: list[Block] = []
    stack = Open()
    endless: set[str] = set()
    now = Block()

    def turn() -> None:
        nonlocal now
        if now.parts:
            if now.close():
                out.append(now)
            now = Block()
        now.level, now.article, now.rescued, _ = stack.state()
        now.heading = stack.heads > 0

    at, end = 0, len(page)
    while at < end:
        m = TAG.search(page, at)
        text = page[at : m.start() if m else end]
        if text:
            if "&" in text:
                text = entities.unescape(text)
            now.parts.append(text)
            if stack.has("a"):
                now.linked.append(text)
        if not m:
            break
        at = m.end()
        closed, opened = m[1], m[2]
        if closed:
            tag = closed.lower()
            apart = stack.close(tag)
            if apart or apart is None and tag in BLOCKS:
                turn()
        elif opened:
            tag, attributes = opened.lower(), m[3]
            if tag in RAW:
                # Nothing in them is text of the page. Without an end, scripts and the like last until the page ends;
                # the other elements aren't waited for, and a head ends with the body's begin.
                if not attributes.rstrip().endswith("/") or tag not in ("svg", "math"):
                    if tag == "head":
                        body = HEAD_ENDS.search(page, at)
                        at = body.start() if body else at
                    elif tag not in endless:
                        stop = ENDS[tag].search(page, at)
                        if stop:
                            at = page.find(">", stop.start()) + 1 or end
                        else:
                            endless.add(tag)
                    if tag in endless and tag in TO_THE_END:
                        at = end
                if tag not in ("svg", "math"):
                    now.parts.append(" ")
            elif tag == "br":
                now.parts.append("\n")
            elif tag in VOID:
                if tag in BLOCKS:
                    turn()
            else:
                if tag in BLOCKS:
                    stack.close("p")
                    if tag == "li" and stack.has("li") and (not stack.lists or stack.places["li"][-1] > stack.lists[-1]):
                        stack.close("li")
                elif tag == "a":
                    stack.forget("a")
                before = stack.state()
                article = before[1]
                # Inside of code, classes name what its words are, as comments.
                told = attributes and tag not in ("body", "html") and not stack.has("pre", "code")
                bad, good = names(attributes, article) if told else (CLEAR, False)
                bad = max(bad, BOILER.get(tag, CLEAR), WEAK if tag == "header" and not article else CLEAR)
                state = within(before, bad, good, tag, at)
                stack.push(tag, state)
                if tag in BLOCKS or state != before:
                    turn()
    turn()
    # Articles inside what names itself boilerplate are teasers where the page has an article elsewhere, be it one
    # that was rescued from something that holds more.
    sizes = Counter()
    for b in out:
        sizes[b.rescued] += b.words if b.article and not b.boiler else 0
    kept = 0 if sizes[0] else max(sizes, key=lambda k: (sizes[k], -k), default=0)
    for b in out:
        b.level = STRONG if b.rescued and b.rescued != kept else b.level
    if sum(b.words for b in out if b.level == FORM) > WHOLE_PAGE * sum(b.words for b in out if b.level == CLEAR):
        for b in out:
            b.level = CLEAR if b.level == FORM else b.level
    return out


def describe(found: list[Block]) -> list[tuple[float, ...]]:
    page = any(b.article and not b.boiler for b in found)
    rows = []
    for k, b in enumerate(found):
        before, after = (found[k - 1] if k else Block()), (found[k + 1] if k + 1 < len(found) else Block())
        place = OUTSIDE if b.boiler or page and not b.article else INSIDE if b.article else UNMARKED
        rows.append((b.words, b.links, before.words, before.links, after.words, after.links, place, float(b.heading)))
    return rows


#: A tree as nested tuples (feature, threshold, at most, above), or a label.
Tree = tuple | int


def train(spark: SparkSession, labelled: tuple = LABELLED, depth: int = 8) -> Tree:
    """A decision tree by Spark's learner, from the labelled table."""
    rows = spark.createDataFrame([tuple(float(x) for x in r) for r in labelled], [*FEATURES, "label"]).coalesce(1)
    data = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows)
    model = DecisionTreeClassifier(maxDepth=depth, maxBins=64, seed=1).fit(data)

    def unfold(node) -> Tree:
        if node.numDescendants() == 0:
            return int(node.prediction())
        split = node.split()
        return split.featureIndex(), split.threshold(), unfold(node.leftChild()), unfold(node.rightChild())

    return unfold(model._java_obj.rootNode())


def classify(tree: Tree, row: tuple[float, ...]) -> int:
    while not isinstance(tree, int):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree


def main_text(page: str | None, tree: Tree) -> str:
    found = blocks(page or "")
    return " ".join(b.text for b, row in zip(found, describe(found), strict=True) if classify(tree, row))


def extract(pages: DataFrame) -> DataFrame:
    """One row per row of ``pages``: page_id, url, text, n_chars."""
    tree = train(pages.sparkSession)
    kind = pages.schema["page_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [main_text(t, tree) for t in texts(batch, "html")]
            yield pa.RecordBatch.from_pydict({"page_id": batch.column("page_id"), "url": batch.column("url"), "text": pa.array(out, pa.string()), "n_chars": pa.array([len(t) for t in out], pa.int64())})

    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
