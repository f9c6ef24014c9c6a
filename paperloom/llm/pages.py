"""Main text of web pages by the text-to-tag ratio of lines.

The standard library's streaming parser turns a page into lines, one for each run of text between
block tags, with the number of tags in it and the marked regions around it. The ratio of
characters to tags, zero in regions that are marked as menus, adverts and the like, is smoothed
with a Gaussian, and two-means clustering of the smoothed ratios gives the threshold. Lines at or
above it are content; where the page marks an article, the article that holds them is taken
without its marked regions.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.words import slices

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li "
    "main menu nav noscript ol option p pre script section select style summary table tbody td textarea tfoot th thead title tr ul".split()
)
NOISE_TAG = frozenset("aside button canvas dialog embed fieldset footer form head header iframe input label legend menu nav noscript object option script select style svg template textarea title".split())
NOISE_ROLE = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search status toolbar".split())
NOISE_WORD = frozenset(
    "ad ads advert advertisement advertisements adverts adsense advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright disclaimer discussion disqus footer "
    "form gdpr header login masthead menu modal nav navbar navigation newsletter notice notices pager pagination popup promo promotion recommended related replies reply search share sharing "
    "sidebar signup skip social sponsor sponsored subscribe subscription toolbar topbar widget widgets".split()
)
CONTENT_WORD = frozenset("article body content entry main page post story text wrapper container layout".split())
NOT_BEFORE = frozenset("has no with without".split())
ARTICLE_TAG = frozenset(("article", "main"))
#: A start tag of the first ends an open one of the second, up to a barrier.
P_ENDERS = BLOCK - frozenset(("body", "button", "head", "html", "option", "script", "style", "title", "textarea", "noscript", "select", "li", "td", "th", "tr", "tbody", "thead", "tfoot", "dd", "dt", "caption", "legend", "summary", "figcaption"))
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "p": ("p",)}
#: Any other start tag, and text, ends an open head.
HEAD_TAG = frozenset("base basefont bgsound head html link meta noframes noscript script style template title".split())
BARRIER = frozenset("article aside body div dl form main nav ol section table ul".split())

_SPACE = re.compile(r"\s+")
_NAME = re.compile(r"[a-z0-9]+")
SIGMA, RADIUS = 1.0, 3

SCHEMA = "page_id bigint, url string, text string, n_chars bigint"


def _is_noise(tag: str, attrs: list[tuple[str, str | None]]) -> bool:
    if tag in NOISE_TAG:
        return True
    for name, value in attrs:
        value = (value or "").lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "role" and value in NOISE_ROLE):
            return True
        if name == "style" and "display:none" in value.replace(" ", ""):
            return True
        if name in ("class", "id") and tag not in ("html", "body", "main"):
            for own in value.split():
                words = _NAME.findall(own)
                if not words or words[0] in NOT_BEFORE:
                    continue
                if words[-1] in NOISE_WORD or (words[0] in NOISE_WORD and words[-1] not in CONTENT_WORD):
                    return True
    return False


class Lines(HTMLParser):
    """Collects lines as (text, tags, link characters, noise, article)."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, int, bool, int]] = []
        self.stack: list[tuple[str, bool, bool]] = []
        self.noise = self.links = self.articles = self.seen = self.tags = self.link_chars = 0
        self.parts: list[str] = []

    def flush(self) -> None:
        text = _SPACE.sub(" ", "".join(self.parts)).strip()
        if text:
            self.lines.append((text, self.tags, self.link_chars, self.noise > 0, self.seen if self.articles else 0))
        self.parts, self.tags, self.link_chars = [], 0, 0

    def _pop(self) -> None:
        tag, noise, article = self.stack.pop()
        if tag in BLOCK or noise:
            self.flush()
        self.noise -= noise
        self.articles -= article
        self.links -= tag == "a"

    def _end(self, tags: tuple[str, ...], barrier: frozenset[str]) -> None:
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] in tags:
                while len(self.stack) > i:
                    self._pop()
                return
            if self.stack[i][0] in barrier:
                return

    def _end_head(self) -> None:
        if self.stack and self.stack[-1][0] == "head":
            self._pop()

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "body":
            self._end(("head",), frozenset())
        elif tag not in HEAD_TAG:
            self._end_head()
        if tag in P_ENDERS:
            self._end(("p",), BARRIER)
        if tag in SIBLINGS:
            self._end(SIBLINGS[tag], BARRIER)
        noise = tag not in VOID and _is_noise(tag, attrs)
        if tag in BLOCK or noise:
            self.flush()
        self.tags += 1
        if tag == "br":
            self.parts.append(" ")
        if tag in VOID:
            return
        role = dict(attrs)
        article = not noise and (tag in ARTICLE_TAG or role.get("role") in ("main", "article") or role.get("itemprop") == "articleBody")
        if article and not self.articles:
            self.seen += 1
        self.stack.append((tag, noise, article))
        self.noise += noise
        self.articles += article
        self.links += tag == "a"

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag == "br":
            self.parts.append(" ")
        elif any(open_tag == tag for open_tag, _, _ in self.stack):
            self._end((tag,), frozenset())
        elif tag in BLOCK:
            self.flush()

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag in ("svg", "iframe", "object", "canvas"):
            self.handle_endtag(tag)

    def handle_data(self, data: str) -> None:
        if self.noise and self.stack[-1][0] in ("script", "style"):
            return
        if data.strip():
            self._end_head()
        self.parts.append(data)
        if self.links:
            self.link_chars += len(data)

    def unknown_decl(self, data: str) -> None:
        """Marked sections are markup."""


def smoothed(ratios: np.ndarray, sigma: float = SIGMA, radius: int = RADIUS) -> np.ndarray:
    """Gaussian smoothing; at the ends only the lines there are weigh in."""
    offsets = np.arange(-radius, radius + 1)
    kernel = np.exp(-(offsets**2) / (2 * sigma * sigma))
    sums = np.convolve(ratios, kernel, "full")[radius : radius + len(ratios)]
    return sums / np.convolve(np.ones(len(ratios)), kernel, "full")[radius : radius + len(ratios)]


def threshold(values: np.ndarray) -> float:
    """The middle between the centres of two clusters of numbers."""
    low, high = float(values.min()), float(values.max())
    for _ in range(50):
        cut = (low + high) / 2
        below, above = values[values < cut], values[values >= cut]
        if not len(below) or not len(above):
            break
        if (below.mean(), above.mean()) == (low, high):
            break
        low, high = float(below.mean()), float(above.mean())
    return (low + high) / 2


def main_lines(lines: list[tuple[str, int, int, bool, int]]) -> list[int]:
    """Indices of the lines of the main text."""
    free = [i for i, line in enumerate(lines) if not line[3]]
    if not free:
        return []
    ratios = np.array([0.0 if noise else max(0.0, (len(text) - links)) / max(1, tags) for text, tags, links, noise, _ in lines])
    smooth = smoothed(ratios)
    cut = threshold(smooth)
    chosen = [i for i in free if smooth[i] >= cut] or [max(free, key=lambda i: smooth[i])]
    marked = {lines[i][4] for i in free if lines[i][4]}
    if marked:
        taken = {lines[i][4] for i in chosen if lines[i][4]}
        if not taken:
            taken = {max(marked, key=lambda a: sum(len(lines[i][0]) for i in free if lines[i][4] == a))}
        return [i for i in free if lines[i][4] in taken]
    # no marked article: the chosen lines, and what lies between them unless it is mostly links
    plain = {i for i in free if 2 * lines[i][2] <= len(lines[i][0])}
    return [i for i in free if i in set(chosen) or (chosen[0] < i < chosen[-1] and i in plain)]


def main_text(html: str | None) -> str:
    """The main text of a page, its blocks joined by line feeds."""
    parser = Lines()
    parser.feed(html or "")
    parser.close()
    parser.flush()
    return "\n".join(parser.lines[i][0] for i in main_lines(parser.lines))


def extract(pages: DataFrame) -> DataFrame:
    """Columns page_id, url, text, n_chars for each row of ``pages`` (page_id, url, html; others are
    ignored). A null or empty html, or one without text outside of marked regions, gives an empty
    text; nulls in the other columns are passed on; equal rows give equal rows; no rows give none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "html"):
                texts = [main_text(h) for h in part.column("html").to_pylist()]
                sizes = pa.array([len(t) for t in texts], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), sizes], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("bigint"), "url", "html").mapInArrow(run, SCHEMA)
