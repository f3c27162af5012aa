"""Main text of web pages from parser events and smoothed text-to-tag ratios.

The standard library's streaming parser turns a page into lines, one for each block
element.  A line's ratio is its characters outside links over its tags; what the markup says
of the line is added in units of the page's mean ratio (an article, a paragraph or heading, a
list item or cell) or takes it away (links, but for an article's paragraphs; outside the article,
where the page marks one).
Lines inside menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles,
hidden elements and reader comments count as empty: they are the valleys.  The ratios are
smoothed along the page with a Gaussian kernel and cut at a threshold of mean and deviation;
neighbouring lines above it form clusters, less the lines at their ends that only the
smoothing has lifted.  The clusters are the content, without valleys and link lists; where no
article is marked, a heading stays only with what follows it.

A class, id or role marks such a region by the first or last word of one of its names, reader
comments by any word; what a name has, or is with or without, marks nothing.  Outside an article, an element that only
its name marks and that holds an article or main element is a part of the layout and counts
as unmarked: then the page is read again without that mark.

Character references are decoded, white space inside a line becomes one space, lines are
trimmed and joined by an empty line.  Defined results: null, empty and text-free pages give
the empty text; unclosed and stray tags are tolerated; repeated rows are taken one by one.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

SIGMA = 1.0
#: What markup adds to a line's ratio, in mean ratios; above 1 a line passes the threshold among its like.
ARTICLE, PARAGRAPH, ITEM = 3.0, 2.0, 1.5

#: Elements by what they do to lines and regions.
BLOCKS = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
BOILERPLATE = frozenset("nav aside footer form dialog button select option textarea menu iframe object svg canvas template noscript head title audio video".split())
RAW = frozenset(("script", "style"))
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
PARAGRAPHS = HEADINGS | {"p", "pre", "blockquote", "figcaption"}
ITEMS = frozenset(("li", "dt", "dd", "td", "th"))
#: Words of class, id and role that mark what is not the article.
MARKS = frozenset(
    "ad ads advert advertisement adverts adsense advertising banner sponsor sponsored promo promotion promoted nav navbar navigation navigationbar menu menubar breadcrumb breadcrumbs pager pagination sidebar aside footer header masthead topbar toolbar cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social comment comments commentlist disqus respond reply replies discussion related recommended recommendations widget search complementary contentinfo dialog skip hidden outbrain taboola paywall".split()
)
#: Of these, the marks of reader comments, which may hold article elements of their own.
COMMENTS = frozenset("comment comments commentlist disqus respond reply replies discussion".split())
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_SPACE = re.compile(r"\s+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_CONTENT_WORDS = frozenset(("article", "content", "post", "entry", "main", "story", "body"))
#: What follows these words of a name says what an element has or lacks.
_TRAITS = frozenset(("has", "have", "with", "without", "no", "not"))
#: Names that begin so are of wrappers, whatever their last word.
_LAYOUT = frozenset(("layout", "grid", "columns", "row", "template", "container", "wrapper", "wrap"))


def marks(value: str) -> set[str]:
    """The words of MARKS by which a class, id or role names its element as boilerplate."""
    found, last = set(), ""
    for name in value.split():
        words = [w.lower() for w in _WORDS.findall(name)]
        words = words[: next((i for i, w in enumerate(words) if w in _TRAITS), len(words))]
        if words:
            last = words[-1]
            if words[0] not in _LAYOUT:
                found.update(MARKS.intersection((words[0], last)), COMMENTS.intersection(words))
    return set() if last in _CONTENT_WORDS else found


@dataclass
class Line:
    """One block of text as the parser met it; boilerplate has no text."""

    text: str
    tags: int
    linked: int
    article: bool
    element: str

    @property
    def ratio(self) -> float:
        return max(0, len(self.text) - self.linked) / max(1, self.tags)

    @property
    def links(self) -> bool:
        return self.linked > 0.6 * len(self.text)


class Lines(HTMLParser):
    """Collects the lines of a page; boilerplate regions leave empty ones."""

    def __init__(self, layout: frozenset[int] = frozenset()):
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.stack: list[tuple[str, int]] = []  # open element and what it opened: 1 boilerplate, 2 article or main, 4 link, 8 boilerplate by name only, 16 article
        self.off = self.inside = self.link = self.articles = 0
        self.layout = layout  # numbers of the elements whose marks do not count
        self.named = 0
        self.open_named: list[tuple[int, bool]] = []  # number of each open element of bit 8, and whether it holds comments
        self.holders: set[int] = set()  # of these, the ones that hold an article or main element
        self.had_article = False
        self._clear()

    def _clear(self) -> None:
        self.parts: list[str] = []
        self.tags = self.linked = 0
        self.element = ""
        self.valley = False

    def flush(self) -> None:
        if self.parts:
            text = _SPACE.sub(" ", "".join(self.parts)).strip()
            if text:
                self.lines.append(Line(text, self.tags, min(self.linked, len(text)), self.inside > 0, self.element))
                self.valley = False
        if self.valley:
            self.lines.append(Line("", self.tags, 0, False, ""))
        self._clear()

    def _kind(self, tag: str, attrs: list[tuple[str, str | None]]) -> int:
        kind = 4 if tag == "a" else 0
        if tag in BOILERPLATE or tag == "header" and not self.inside:
            return kind | 1
        main = tag == "main" or any(n == "role" and v == "main" for n, v in attrs)
        article = tag == "article" or any(n == "itemprop" and v == "articleBody" for n, v in attrs)
        named: set[str] = set()
        for name, value in attrs:
            if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and value and _HIDDEN.search(value):
                return kind | 1
            if value and name in ("class", "id", "role") and tag not in ("body", "html"):
                named |= marks(value)
        if named and not main and not article:
            self.named += 1
            if self.named in self.layout:
                return kind
            if self.articles:
                return kind | 1
            self.open_named.append((self.named, bool(named & COMMENTS)))
            return kind | 9
        if main or article:
            kind |= 2 | article << 4
            self.had_article = True
            if self.off == len(self.open_named) and (main or not named and not any(c for _, c in self.open_named)):
                self.holders.update(i for i, _ in self.open_named)
        return kind

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.tags += 1
        if tag == "br":
            self.parts.append(" ")
            return
        if tag in BLOCKS:
            self.flush()
            self.element = tag
        if tag in VOID:
            return
        if tag in ("p", "li", "td", "tr", "dd", "dt", "option"):  # their end tags may be left out
            self._close_open(tag)
        kind = self._kind(tag, attrs)
        self.stack.append((tag, kind))
        if kind:
            self.off += kind & 1
            self.inside += kind >> 1 & 1
            self.link += kind >> 2 & 1
            self.articles += kind >> 4

    def _close_open(self, tag: str) -> None:
        """Close an element of the same name that is still open in the current container."""
        for i in range(len(self.stack) - 1, -1, -1):
            name = self.stack[i][0]
            if name == tag:
                self._pop_to(i)
                return
            if name in BLOCKS:
                return

    def _pop_to(self, i: int) -> None:
        while len(self.stack) > i:
            kind = self.stack.pop()[1]
            if kind:
                self.off -= kind & 1
                self.inside -= kind >> 1 & 1
                self.link -= kind >> 2 & 1
                self.articles -= kind >> 4
                if kind & 8:
                    self.open_named.pop()

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag in BLOCKS:
            self.flush()
        for i in range(len(self.stack) - 1, -1, -1):
            name = self.stack[i][0]
            if name == tag:
                self._pop_to(i)
                return
            if name in BLOCKS and tag not in BLOCKS:
                return  # a stray end tag of an inline element closes no block

    def handle_data(self, data: str) -> None:
        if self.stack and self.stack[-1][0] in RAW:
            return
        if self.off:
            self.valley = self.valley or not data.isspace()
            return
        self.parts.append(data)
        if self.link:
            self.linked += len(data)


def smooth(values: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian smoothing with the kernel renormalised at the ends."""
    reach = int(np.ceil(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    full = np.convolve(values, kernel)[reach : reach + len(values)]
    return full / np.convolve(np.ones(len(values)), kernel)[reach : reach + len(values)]


def values(lines: list[Line], marked: bool) -> np.ndarray:
    """The ratio of every line with what its markup adds; 0 for valleys and for what is outside a marked article."""
    own = np.array([x.ratio if x.text and (x.article or not marked) else 0.0 for x in lines])
    live = [x.text != "" and (x.article or not marked) and not (x.links and not (x.article and x.element in PARAGRAPHS)) for x in lines]
    mean = own[live].mean() if any(live) else 0.0
    gain = [(ARTICLE if x.article else PARAGRAPH if x.element in PARAGRAPHS else ITEM if x.element in ITEMS else 0.0) if ok else 0.0 for x, ok in zip(lines, live, strict=True)]
    return own + mean * np.array(gain)


def clusters(value: np.ndarray, smoothed: np.ndarray) -> list[tuple[int, int]]:
    """Runs [a, b) of lines whose smoothed value passes the threshold, less low lines at their ends."""
    threshold = 0.5 * min(smoothed.mean(), max(smoothed.max() - smoothed.std(), 0.0))
    edge = np.flatnonzero(np.diff(np.concatenate([[False], smoothed > threshold, [False]]).astype(np.int8)))
    out = []
    for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
        high = np.flatnonzero(value[a:b] > threshold / 2)
        if len(high):
            out.append((a + int(high[0]), a + int(high[-1]) + 1))
    return out


def select(lines: list[Line], marked: bool) -> list[str]:
    """Texts of the content lines, in page order."""
    if not lines:
        return []
    value = values(lines, marked)
    keep = [False] * len(lines)
    for a, b in clusters(value, smooth(value)):
        for i in range(a, b):
            x = lines[i]
            keep[i] = x.text != "" and (x.article or not marked) and not (x.links and (x.element in ITEMS or not marked))
    if not marked:
        for i in range(len(lines) - 2, -1, -1):  # headings lead into what follows
            if lines[i].text and lines[i].element in HEADINGS:
                keep[i] = keep[i + 1]
    return [x.text for x, k in zip(lines, keep, strict=True) if k]


_ATTRIBUTE = re.compile(r"=\s*(?P<quote>[\"'])|>")
_OPENS = re.compile(r"<(?=[A-Za-z/!?])")
_COMMENT_ENDS = re.compile(r"--!?\s*>")


def settle(html: str) -> str:
    """``html`` with the ``<`` of every tag or comment that never ends written as a reference, for such a one is text.

    The parser would look for the end of each of them anew.  Here one pass from the right tells
    for every quote and ``>`` whether a tag that reaches it outside quotes ends.
    """
    marks = [(m.start("quote") if m["quote"] else m.start(), m["quote"]) for m in _ATTRIBUTE.finditer(html)]
    at = [place for place, _ in marks]
    quotes = {q: [m.start() for m in re.finditer(q, html)] for q in ('"', "'")}
    ends = [False] * (len(marks) + 1)
    for i in range(len(marks) - 1, -1, -1):
        place, quote = marks[i]
        if quote is None:
            ends[i] = True
        else:
            j = bisect_right(quotes[quote], place)
            ends[i] = j < len(quotes[quote]) and ends[bisect_right(at, quotes[quote][j])]
    last, comment = html.rfind(">"), html.rfind("<!--")
    last_comment = max((m.start() for m in _COMMENT_ENDS.finditer(html)), default=-1) if comment >= 0 else -1
    if all(ends[:-1]) and html.rfind("<") < last and comment <= last_comment:
        return html
    out, done = [], 0
    for m in _OPENS.finditer(html):
        place = m.start()
        tag = html[place + 1].isalpha() and not ends[bisect_right(at, place)]
        if place > last or tag or place > last_comment and html.startswith("<!--", place):
            out += [html[done:place], "&lt;"]
            done = place + 1
    return "".join([*out, html[done:]])


def main_text(html: str | None) -> str:
    """The main text of one page."""
    if not html:
        return ""
    html = settle(html)
    parser = Lines()
    parser.feed(html)
    parser.close()
    if parser.holders:
        parser = Lines(frozenset(parser.holders))
        parser.feed(html)
        parser.close()
    parser.flush()
    marked = parser.had_article and any(x.article for x in parser.lines)
    return "\n\n".join(select(parser.lines, marked))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id_col, url_col, text, n_chars) for every row of ``pages``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h.as_py()) for h in batch.column("html")]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["id", "url", "text", "n_chars"])

    kinds = dict(pages.dtypes)
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return rows.mapInArrow(run, f"id {kinds[id_col]}, url {kinds[url_col]}, text string, n_chars long").withColumnsRenamed({"id": id_col, "url": url_col})
