"""The main text of web pages from flat blocks classified by a decision tree.

A page is cut at block tags into flat blocks.  What stands in a container whose tag, class,
id or role names menus, headers, footers, forms, notices, adverts or comments is dropped,
what stands in an article outside of these is kept.  Any other block is described by its
number of words, the share of them in links, and both of the blocks before and after it; a
tree grown on a small labelled table decides whether it is main text.
"""

from __future__ import annotations

import html
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from motorlens.functions.shipping import by_value
from motorlens.llm.tree import grow, share_of

by_value(__name__)

# text inside these is never shown
SILENT = ("script", "style", "noscript", "template", "iframe", "svg", "object", "canvas", "textarea", "title", "head",
          "select", "option", "math", "audio", "video")
# tags that stand inside a line of text; any other tag ends a block
INLINE = ("a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img",
          "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub",
          "sup", "time", "tt", "u", "var", "wbr")
# tags around what is not the article, and the tags of the article itself
AROUND = ("nav", "header", "footer", "aside", "form", "menu", "dialog", "button", "fieldset")
ARTICLE = ("article", "main")
# the last word of a class, id or role that says the same, before words for what merely carries it
AROUND_WORDS = (
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "alert", "banner", "breadcrumb", "breadcrumbs", "comment",
    "commenter", "comments", "complementary", "consent", "contentinfo", "cookie", "cookies", "dialog", "disclaimer", "disqus",
    "footer", "form", "gdpr", "header", "login", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter",
    "notice", "notification", "pagination", "popup", "promo", "promotion", "related", "replies", "reply", "respond", "search",
    "share", "sharing", "sidebar", "signup", "social", "sponsor", "sponsored", "subscribe", "toolbar", "widget", "widgets",
)
CARRIER_WORDS = (
    "area", "articles", "bar", "block", "bottom", "box", "buttons", "column", "container", "content", "entry", "icons", "inner",
    "item", "items", "left", "link", "links", "list", "outer", "overlay", "panel", "policy", "posts", "primary", "right",
    "secondary", "section", "slot", "stories", "thread", "text", "top", "unit", "wrap", "wrapper", "zone",
)
# a class with one of these speaks about a container elsewhere, or of none
OTHERWISE_WORDS = ("free", "has", "hide", "is", "no", "not", "with", "without")

# The labelled table, for blocks in no container that says what it holds: words of a block, share of them in links, words
# and link share of the block before, words and link share of the block after, and whether it is main text.
LABELLED = """
 14 0.05  66 0.05  62 0.00 1
 14 1.00  67 0.05  58 0.00 0
 14 0.00   9 1.00  57 0.00 1
 16 1.00   3 1.00  51 0.00 0
 14 0.05  47 0.10   6 1.00 1
 11 1.00  54 0.10   4 1.00 0
 14 0.10   9 0.90  13 1.00 1
 16 1.00  12 0.90   8 1.00 0
 18 0.10  58 0.05  63 0.00 1
 15 0.55  58 0.05  58 0.00 0
 18 0.00  10 1.00  50 0.00 1
 21 0.90   6 1.00  57 0.00 0
 18 0.10  46 0.10  12 1.00 1
 16 1.00  47 0.10  11 1.00 0
 18 0.00  13 0.90   7 1.00 1
 18 1.00   7 0.90  12 1.00 0
 24 0.10  59 0.05  59 0.00 1
 23 0.70  66 0.05  59 0.00 0
 24 0.00   2 1.00  59 0.00 1
 27 0.55   7 1.00  51 0.00 0
 24 0.30  47 0.10  10 1.00 1
 21 0.55  53 0.10   4 1.00 0
 24 0.00   6 0.90   6 1.00 1
 24 0.90  14 0.90  12 1.00 0
 30 0.05  59 0.05  64 0.00 1
 32 0.70  68 0.05  59 0.00 0
 30 0.02   2 1.00  54 0.00 1
 29 0.55   7 1.00  51 0.00 0
 30 0.00  46 0.10   5 1.00 1
 27 0.55  50 0.10  11 1.00 0
 30 0.00  13 0.90  14 1.00 1
 28 0.90  11 0.90   9 1.00 0
 38 0.20  60 0.05  61 0.00 1
 40 0.90  59 0.05  61 0.00 0
 38 0.05   4 1.00  50 0.00 1
 37 1.00   5 1.00  50 0.00 0
 38 0.00  45 0.10  10 1.00 1
 41 1.00  53 0.10  13 1.00 0
 38 0.00   3 0.90   8 1.00 1
 36 0.90   7 0.90   6 1.00 0
 45 0.30  67 0.05  60 0.00 1
 48 0.80  64 0.05  56 0.00 0
 45 0.00   2 1.00  53 0.00 1
 46 1.00   4 1.00  50 0.00 0
 45 0.10  48 0.10   9 1.00 1
 46 0.90  45 0.10  13 1.00 0
 45 0.05  12 0.90   8 1.00 1
 48 0.90   5 0.90   8 1.00 0
 55 0.02  61 0.05  64 0.00 1
 53 1.00  61 0.05  57 0.00 0
 55 0.20  11 1.00  58 0.00 1
 53 1.00   7 1.00  57 0.00 0
 55 0.10  44 0.10  10 1.00 1
 52 0.55  44 0.10   4 1.00 0
 55 0.10   7 0.90   9 1.00 1
 57 1.00   9 0.90  10 1.00 0
 70 0.05  67 0.05  62 0.00 1
 69 1.00  60 0.05  56 0.00 0
 70 0.00   4 1.00  57 0.00 1
 71 1.00  10 1.00  59 0.00 0
 70 0.00  47 0.10   7 1.00 1
 68 1.00  43 0.10   5 1.00 0
 70 0.02   9 0.90  13 1.00 1
 68 0.55   3 0.90   8 1.00 0
 90 0.02  63 0.05  63 0.00 1
 91 0.70  59 0.05  60 0.00 0
 90 0.00   8 1.00  55 0.00 1
 92 1.00  12 1.00  58 0.00 0
 90 0.10  45 0.10  13 1.00 1
 87 0.55  50 0.10   9 1.00 0
 90 0.20   7 0.90   6 1.00 1
 87 1.00  13 0.90   7 1.00 0
120 0.05  59 0.05  59 0.00 1
119 0.70  59 0.05  56 0.00 0
120 0.05   9 1.00  55 0.00 1
122 0.55  12 1.00  52 0.00 0
120 0.30  48 0.10   9 1.00 1
117 1.00  50 0.10   5 1.00 0
120 0.30   9 0.90   6 1.00 1
123 0.90  12 0.90   6 1.00 0
160 0.10  68 0.05  61 0.00 1
160 1.00  58 0.05  64 0.00 0
160 0.00   2 1.00  51 0.00 1
162 0.55   5 1.00  56 0.00 0
160 0.20  48 0.10  10 1.00 1
162 1.00  52 0.10  11 1.00 0
160 0.05  10 0.90  14 1.00 1
157 1.00  11 0.90   6 1.00 0
220 0.02  67 0.05  56 0.00 1
220 0.55  61 0.05  56 0.00 0
220 0.05  10 1.00  57 0.00 1
219 0.55   6 1.00  54 0.00 0
220 0.00  53 0.10  13 1.00 1
218 1.00  45 0.10   9 1.00 0
220 0.20  10 0.90  13 1.00 1
218 0.80   9 0.90  10 1.00 0
  1 0.00   1 1.00  40 0.00 1
  2 0.00   3 1.00  60 0.00 1
  4 0.00  50 0.00  70 0.00 1
  6 0.00  80 0.00  45 0.00 1
  9 0.00  40 0.10  60 0.00 1
  5 0.00  70 0.00   3 1.00 1
  7 0.00  60 0.00   2 1.00 1
 11 0.00  85 0.00   2 1.00 1
  3 0.00   2 1.00  90 0.00 1
  8 0.00   2 1.00  55 0.05 1
  2 0.00  45 0.00  50 0.00 1
  1 0.00  60 0.00  35 0.00 1
  2 0.00   3 0.00   1 1.00 0
  3 0.00   1 1.00   2 1.00 0
  6 0.00   4 1.00   5 1.00 0
  5 0.00   4 0.00   3 0.00 0
  8 0.00   6 1.00   0 0.00 0
  7 0.00   2 1.00   0 0.00 0
  4 0.00   2 1.00   6 1.00 0
  1 0.00   0 0.00   2 1.00 0
  9 0.00   5 0.90   3 1.00 0
 10 0.00   4 1.00   6 0.80 0
  3 0.00   5 0.00   4 0.00 0
  2 0.00   0 0.00   5 1.00 0
  1 1.00   1 1.00   1 1.00 0
  2 1.00   3 1.00  40 0.00 0
  3 1.00  60 0.00  70 0.00 0
  4 0.75  50 0.00   4 1.00 0
  6 0.80  45 0.00  60 0.00 0
  9 0.90  70 0.10  30 0.00 0
  5 0.60   2 1.00   3 1.00 0
  8 1.00  90 0.00   0 0.00 0
 13 0.10   3 0.00   2 0.00 1
 13 0.00   3 1.00   2 0.00 1
 13 0.03   0 0.00   0 0.00 1
 13 0.80   2 0.00   5 0.00 0
 17 0.00   3 0.00   4 0.00 1
 17 0.25   2 1.00   5 0.00 1
 17 0.00   0 0.00   0 0.00 1
 17 0.80   2 0.00   1 0.00 0
 20 0.00   2 0.00   1 0.00 1
 20 0.00   1 1.00   5 0.00 1
 20 0.25   0 0.00   0 0.00 1
 20 1.00   2 0.00   5 0.00 0
 26 0.25   3 0.00   0 0.00 1
 26 0.00   1 1.00   1 0.00 1
 26 0.00   0 0.00   0 0.00 1
 26 0.80   3 0.00   0 0.00 0
 32 0.25   3 0.00   1 0.00 1
 32 0.00   3 1.00   5 0.00 1
 32 0.00   0 0.00   0 0.00 1
 32 1.00   1 0.00   4 0.00 0
 40 0.10   0 0.00   3 0.00 1
 40 0.10   4 1.00   5 0.00 1
 40 0.25   0 0.00   0 0.00 1
 40 0.80   4 0.00   0 0.00 0
 48 0.03   0 0.00   1 0.00 1
 48 0.10   3 1.00   3 0.00 1
 48 0.03   0 0.00   0 0.00 1
 48 0.60   2 0.00   1 0.00 0
 65 0.25   2 0.00   2 0.00 1
 65 0.25   3 1.00   5 0.00 1
 65 0.00   0 0.00   0 0.00 1
 65 0.60   3 0.00   3 0.00 0
 85 0.10   0 0.00   4 0.00 1
 85 0.00   1 1.00   2 0.00 1
 85 0.10   0 0.00   0 0.00 1
 85 0.60   4 0.00   0 0.00 0
110 0.03   4 0.00   1 0.00 1
110 0.00   2 1.00   1 0.00 1
110 0.10   0 0.00   0 0.00 1
110 0.80   3 0.00   2 0.00 0
150 0.00   4 0.00   0 0.00 1
150 0.03   4 1.00   3 0.00 1
150 0.03   0 0.00   0 0.00 1
150 0.80   3 0.00   5 0.00 0
240 0.25   3 0.00   1 0.00 1
240 0.03   2 1.00   4 0.00 1
240 0.00   0 0.00   0 0.00 1
240 0.60   1 0.00   4 0.00 0
"""

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)"
    r"(?P<rest>(?>[^<>\"']|\"[^\"]*\"|'[^']*')*+)>|<[!?/][^<>]*>|<[a-zA-Z][^<>]*>",
    re.S,
)
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_SILENT, _INLINE, _AROUND, _ARTICLE = map(frozenset, (SILENT, INLINE, AROUND, ARTICLE))
_WORDS, _CARRIERS, _OTHERWISE = map(frozenset, (AROUND_WORDS, CARRIER_WORDS, OTHERWISE_WORDS))
_PARTS = re.compile(r"[^\W_]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
# silent tags whose content is read up to their own end tag only
_RAW = frozenset(("script", "style", "noscript", "iframe", "textarea", "title"))
# tags whose end is often left out or that have none; they are no containers
_LOOSE = frozenset(("p", "li", "br", "hr", "dt", "dd", "tr", "td", "th", "input", "meta", "link", "base", "col", "option", "source",
                    "h1", "h2", "h3", "h4", "h5", "h6"))


def _names_around(token: str) -> bool:
    """Whether a class, id or role names a container around the article: ``post-comments`` does, ``no-comments`` does not."""
    parts = [p for p in _PARTS.findall(_CAMEL.sub("-", token).lower()) if not p.isdigit()]
    if not _OTHERWISE.isdisjoint(parts):
        return False
    while len(parts) > 1 and parts[-1] in _CARRIERS:
        parts.pop()
    return bool(parts) and parts[-1] in _WORDS


# what a container says of its blocks; a later one holds against an earlier one inside it
UNMARKED, IN_ARTICLE, IN_FORM, IN_NAMED, IN_AROUND = range(5)


def _place(name: str, rest: str) -> int:
    """What a tag says of what it holds.  No class overrules the tags of the article and the page."""
    if name in _AROUND:
        return IN_FORM if name == "form" else IN_AROUND
    if name in _ARTICLE:
        return IN_ARTICLE
    if rest and name not in ("html", "body"):
        tokens = [token for value in _NAMES.findall(rest) for token in value.strip("\"'").split()]
        if any(token.lower() in _ARTICLE for token in tokens):
            return IN_ARTICLE
        if any(map(_names_around, tokens)):
            return IN_NAMED
    return UNMARKED


def _inside(outer: int, name: str, rest: str) -> int:
    """Where the blocks of a tag stand that stands somewhere itself.

    Once around the article nothing inside leads back, but for an article in a form, which
    may go around the whole page, and for the tag ``main`` in a named container.
    """
    place = _place(name, rest)
    if place == IN_ARTICLE:
        return place if outer <= IN_FORM or outer == IN_NAMED and name == "main" else outer
    return max(outer, place)


def blocks(page: str) -> list[tuple[str, int, int, int]]:
    """The blocks of a page in order: text with single spaces, words, words in links, place."""
    out: list[tuple[str, int, int, int]] = []
    open_tags: list[tuple[str, int]] = []
    text: list[str] = []
    linked: list[str] = []
    in_link = False
    unended: set[str] = set()

    def end_block(place: int) -> None:
        if text:
            words = html.unescape("".join(text)).split()
            if words:
                links = len(html.unescape(" ".join(linked)).split()) if linked else 0
                out.append((" ".join(words), len(words), min(links, len(words)), place))
            text.clear()
            linked.clear()

    place, at, n = UNMARKED, 0, len(page)
    while at < n:
        tag = _TAG.search(page, at)
        piece = page[at : tag.start() if tag else n]
        if piece:
            text.append(piece)
            if in_link:
                linked.append(piece)
        if not tag:
            break
        at = tag.end()
        name = tag["name"]
        if name is None:
            continue
        name = name.lower()
        if name in _SILENT:
            if not tag["close"] and not tag["rest"].endswith("/"):
                end = None if name in unended else re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
                if end is None:
                    unended.add(name)
                    # an unclosed head ends where the body begins, raw text with the page, anything else with its parent
                    if name == "head":
                        end = re.compile(r"(?=<body\b)", re.I).search(page, at)
                    elif name not in _RAW and (parent := next((t for t, _ in reversed(open_tags) if "@" not in t), None)):
                        end = re.compile(rf"(?=</{re.escape(parent)}\b)", re.I).search(page, at)
                at = end.end() if end else n if name != "option" else at
                if name not in ("svg", "math", "object"):
                    end_block(place)
            continue
        if name in _INLINE:
            if name == "a":
                in_link = not tag["close"]
            continue
        end_block(place)
        in_link = in_link and name not in ("li", "p", "div")
        if name in _LOOSE:
            if not tag["close"] and tag["rest"] and _place(name, tag["rest"]) == IN_NAMED:
                # a marked paragraph or list entry: lasts until its end tag or the next such tag
                end = re.compile(rf"</?{re.escape(name)}\b", re.I).search(page, at)
                open_tags.append((f"{name}@{end.start() if end else n}", max(place, IN_NAMED)))
            while open_tags and "@" in open_tags[-1][0] and at > int(open_tags[-1][0].partition("@")[2]):
                open_tags.pop()
        elif tag["close"]:
            for i in range(len(open_tags) - 1, -1, -1):
                if open_tags[i][0] == name:
                    del open_tags[i:]
                    break
        elif not tag["rest"].endswith("/"):
            open_tags.append((name, _inside(open_tags[-1][1] if open_tags else UNMARKED, name, tag["rest"])))
        place = open_tags[-1][1] if open_tags else UNMARKED
    end_block(place)
    return out


def train(table: str = LABELLED) -> tuple:
    """The tree for the rows of a labelled table."""
    rows = np.array([[float(x) for x in line.split()] for line in table.strip().splitlines()])
    return grow(rows[:, :-1], rows[:, -1])


def main_text(page: str | None, tree: tuple) -> tuple[str, int, int]:
    """The main text of a page, its blocks and how many of them the page has."""
    if not page:
        return "", 0, 0
    found = blocks(page)
    shares = [(words, links / words) for _, words, links, _ in found]
    around = [(0, 0.0), *shares, (0, 0.0)]
    kept = [
        text for i, (text, words, _, place) in enumerate(found)
        if place == IN_ARTICLE or place == UNMARKED and share_of(tree, (words, shares[i][1], *around[i], *around[i + 2])) >= 0.5
    ]
    return " ".join(kept), len(kept), len(found)


SCHEMA = "page_id {}, url string, text string, n_chars bigint, n_main bigint, n_blocks bigint"


def _kernel(tree: tuple) -> Callable:
    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, len(batch), 256):
                part = batch.slice(first, 256)
                results = [main_text(page.as_py(), tree) for page in part.column(2)]
                texts = [text for text, _, _ in results]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64()),
                     pa.array([k for _, k, _ in results], pa.int64()), pa.array([b for _, _, b in results], pa.int64())],
                    names=["page_id", "url", "text", "n_chars", "n_main", "n_blocks"],
                )

    return extract


def extract_pages(pages: DataFrame, table: str = LABELLED) -> DataFrame:
    """``(page_id, url, text, n_chars, n_main, n_blocks)`` of every page.

    Character references are decoded, white space in a block becomes one space, main
    blocks are joined by one space.  A null or empty page, or one without main text, has
    an empty text.  Pages are handled one by one, so repeated rows give repeated rows,
    an empty table none, and further columns are not used.  Unclosed comments and scripts
    end with the page, other unclosed tags with their parent.
    """
    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", "html").mapInArrow(_kernel(train(table)), SCHEMA.format(kind))
