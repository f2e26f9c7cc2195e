"""Main text of HTML pages, from the events of the standard library's parser and the text-to-tag ratios of lines.

The events of a page become lines: one for each block element's text, with its white space as single spaces, with the tags it took and
the containers it stands in. The logarithms of the characters for each tag are smoothed with a Gaussian along the page
and multiplied by the weight of the line's markup: what it names as something beside an article (menus, footers, sidebars,
notices, adverts, forms, comments) weighs less, what stands in an article more. Lines at or over a threshold (the values' standard
deviation, but not more than their mean) are content. The container with the most value over the threshold, all its lines
taken together, holds the main text: its lines from the first to the last region of content, with the headings right before, but for inner
containers without any content. Markup alone rules no line in or out; only scripts, styles and the like have no lines.

Nothing is cut from a line. A page is worked on alone.

Defined results: null, empty and text-free pages give the empty text; markup that ends early counts as closed where the
page ends; unknown character references stay as written; repeated pages get equal results; extra columns pass through and
a column named as the output is replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from dagframe.llm.shared import mapped

#: Elements by their part in a page.
HIDDEN = frozenset("head title script style noscript template iframe object svg canvas audio video".split())
ASIDE = frozenset("nav footer aside form button select textarea option menu dialog".split())
CONTAINERS = frozenset("html body div section article main ul ol dl table tbody thead tfoot tr header figure fieldset details blockquote center".split()) | HIDDEN | ASIDE
LINES = frozenset("p li dt dd h1 h2 h3 h4 h5 h6 pre td th caption figcaption address summary legend hr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Words of classes, ids and roles that name what stands beside an article, and those that do so outside one.
BESIDE = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promotion promoted sidebar aside comment comments "
    "disqus respond replies cookie cookies consent gdpr notice notices nav navbar navigation menu menus breadcrumb breadcrumbs share sharing social related "
    "recommended newsletter subscribe subscription signup login popup modal overlay widget footer pagination pager skip toolbar contentinfo "
    "complementary search alert dialog disclaimer".split()
)
BESIDE_OUTSIDE = frozenset("header masthead banner topbar hidden toc tags meta".split())
BESIDE_ARTICLE = frozenset("comment comments ad ads advert sponsored related promo".split())
ARTICLES = frozenset(("article", "main"))
SIGMA = 1.0
#: Weights of lines in articles, and of lines that markup puts beside one.
INSIDE, OUTSIDE = 2.0, 0.25

_words = re.compile("[a-z]+")
_kernel = np.exp(-np.arange(-2, 3) ** 2 / (2 * SIGMA**2))
_kernel /= _kernel.sum()


class Line(NamedTuple):
    text: str
    tags: int
    places: tuple[int, ...]  # containers from the outermost
    heading: bool
    weight: float


class _Lines(HTMLParser):
    """Lines of one page."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.open: list[tuple[str, bool, bool]] = []  # containers, whether they have no text, and whether they stand beside the article
        self.places: list[int] = []
        self.made = 0
        self.text: list[str] = []
        self.tags = 0
        self.hidden = self.beside = self.articles = 0  # open elements of these kinds
        self.heading = self.aside = False  # of the open line

    def _flush(self) -> None:
        line = " ".join("".join(self.text).split())
        if line:
            weight = OUTSIDE if self.beside or self.aside else INSIDE if self.articles else 1.0
            self.lines.append(Line(line, self.tags, tuple(self.places), self.heading, weight))
            self.tags = 0
        self.text = []

    def _close(self, upto: int) -> None:
        while len(self.open) > upto:
            tag, hidden, beside = self.open.pop()
            self.hidden -= hidden
            self.beside -= beside
            self.places.pop()
            self.articles -= tag in ARTICLES

    def _named(self, tag: str, attrs: list[tuple[str, str | None]]) -> bool:
        """Whether markup names the element as something beside the article."""
        if tag in ASIDE or (tag == "header" and not self.articles):
            return True
        if not attrs or tag in ("html", "body", "main"):
            return False
        found: set[str] = set()
        for k, v in attrs:
            if k in ("class", "id", "role") and v:
                found.update(_words.findall(v.lower()))
            elif k == "hidden" or (k == "aria-hidden" and v == "true"):
                return True
        if tag == "article":
            return bool(found & BESIDE_ARTICLE)
        return bool(found & BESIDE) or (not self.articles and bool(found & BESIDE_OUTSIDE))

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.tags += 1
        if tag == "br":
            self.text.append(" ")
            return
        container, line = tag in CONTAINERS, tag in LINES
        if container or line:
            self._flush()
            self.heading = tag in HEADINGS
            self.aside = line and self._named(tag, attrs)
        if container and tag not in VOID:
            beside = self._named(tag, attrs)
            self.open.append((tag, tag in HIDDEN, beside))
            self.hidden += tag in HIDDEN
            self.beside += beside
            self.made += 1
            self.places.append(self.made)
            self.articles += tag in ARTICLES

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag in CONTAINERS and tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag in CONTAINERS or tag in LINES:
            self._flush()
            self.heading = self.aside = False
        if tag in CONTAINERS:
            for k in range(len(self.open) - 1, -1, -1):
                if self.open[k][0] == tag:
                    self._close(k)
                    break

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            self.text.append(data)


def lines_of(html: str) -> list[Line]:
    parser = _Lines()
    parser.feed(html)
    parser.close()
    parser._flush()
    return parser.lines


def values(ratios: np.ndarray, weights: np.ndarray, kernel: np.ndarray = _kernel) -> np.ndarray:
    """Of each line: the logarithm of its characters for each tag, smoothed along the page, times its weight."""
    half = len(kernel) // 2
    return np.convolve(np.pad(np.log1p(ratios), half, mode="edge"), kernel, "valid") * weights


def main_text(html: str, kernel: np.ndarray = _kernel) -> str:
    lines = lines_of(html)
    if not lines:
        return ""
    value = values(np.array([len(x.text) / max(1, x.tags) for x in lines]), np.array([x.weight for x in lines]), kernel)
    over = value - min(value.std(), value.mean())
    content = over >= 0
    # The container that gains most by what its lines are over the threshold; of equal ones the innermost.
    sums: dict[int, float] = {}
    held: set[int] = set()
    for x, gain, good in zip(lines, over.tolist(), content.tolist(), strict=True):
        for place in (0, *x.places):
            sums[place] = sums.get(place, 0.0) + gain
            if good:
                held.add(place)
    best = max(sums, key=lambda place: (round(sums[place], 9), place))
    own = [best == 0 or best in x.places for x in lines]
    # Inner containers without any content go.
    kept = [mine and all(p in held for p in x.places if p > best) for x, mine in zip(lines, own, strict=True)]
    good = [k for k in range(len(lines)) if kept[k] and content[k]]
    first, last = good[0], good[-1]
    while first and kept[first - 1] and lines[first - 1].heading:
        first -= 1
    return "\n".join(lines[k].text for k in range(first, last + 1) if kept[k])


def extract(pages: DataFrame, html_col: str = "html", text_col: str = "text") -> DataFrame:
    """Adds the main text of each whole page."""
    kept = [f for f in pages.schema.fields if f.name != text_col]
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                made = pa.array([main_text(x or "") for x in part.column(part.schema.get_field_index(html_col)).to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(n)) for n in names), made], [*names, text_col])

    return mapped(pages, run, T.StructType([*kept, T.StructField(text_col, T.StringType())]))
