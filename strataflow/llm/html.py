"""Main-text extraction from raw pages: streaming parser events, text-to-tag ratios, Gaussian smoothing, clustering.

The standard library's parser streams events; block elements end lines. A line's ratio is its characters outside of
links over the tags that it took. Lines inside menus, footers, forms, adverts, comments and the like, as told by element,
role or a whole class or id, count as boilerplate with ratio zero. Ratios are smoothed with a Gaussian, and compared
with a share of their standard deviation over the page.

A block is what stands directly in one div, section, article, main or body, lists and tables included. It is content,
with all its lines, if smoothing inside the block alone lifts a line to the limit: neighbours outside do not help. A
block that fails stays only if content stands before and after it and smoothing along the page lifts all its lines,
which happens to short lines between long ones; or if it is a heading right before a content block. Clusters of lines
(a block, a list or a table) whose text is mostly links go. If a block in an article or main element is content, only
such elements count.

Null html is empty; a page without content has the empty text. Repeated pages keep a row each; an empty table gives no
rows. Work is linear in a page's length, stray end tags included. A form counts as boilerplate unless it stands around
an article or main element; main closes menus and asides left open before it.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from html.parser import HTMLParser
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataflow.llm.common import slices

#: Elements of the HTML standard by role, and words of class and id attributes that mark boilerplate.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
DROPPED = frozenset("script style noscript template head title nav header footer aside form button select textarea input iframe object svg canvas menu dialog".split())
MARKED = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo banner menu nav navbar navigation breadcrumb breadcrumbs sidebar footer cookie cookies consent notice notices alert newsletter subscribe subscription share sharing social related comment comments respond disqus popup modal widget masthead pagination".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar".split())
MAIN = frozenset(("article", "main"))
BLOCKS = frozenset("div section article main body".split())
CLUSTERS = BLOCKS | frozenset("ul ol dl table".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
SIGMA, SHARE, LINKED = 1.0, 0.5, 0.5


class Line(NamedTuple):
    """region is None in boilerplate, else the number of the article or main element, 0 outside of them; links counts
    the characters inside of links; block and cluster are numbers of elements."""

    text: str
    tags: int
    region: int | None
    links: int
    block: int
    cluster: int
    heading: bool


class _Lines(HTMLParser):
    """The lines of a page."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.stack: list[tuple[str, bool]] = []  # open elements, and whether each is boilerplate by itself
        self.open: dict[str, list[int]] = defaultdict(list)  # places of the open elements of a name
        self.dropped = self.mains = self.regions = self.tags = self.anchors = self.headings = self.links = self.elements = 0
        self.blocks, self.clusters = [0], [0]  # numbers of the open ones
        self.text: list[str] = []

    def _end_line(self) -> None:
        if self.text and (line := " ".join("".join(self.text).split())):
            # A form around an article or main element is the page's frame.
            framed = self.dropped == len(self.open["form"]) and self.mains and self.open["form"] and self.open["form"][-1] < min(self.open[m][0] for m in MAIN if self.open[m])
            region = None if self.dropped and not framed else self.regions if self.mains else 0
            self.lines.append(Line(line, self.tags, region, min(self.links, len(line)), self.blocks[-1], self.clusters[-1], self.headings > 0))
            self.tags = 0
        self.text, self.links = [], 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag not in INLINE:
            self._end_line()
        self.tags += 1
        if tag in VOID:
            return
        if tag == "p" and self.stack and self.stack[-1][0] == "p":
            self._close(len(self.stack) - 1)
        named = dict(attrs)
        marks = f"{named.get('class') or ''} {named.get('id') or ''}".lower().split()
        bad = tag in DROPPED or "hidden" in named or named.get("role") in ROLES or tag not in ("html", "body") and not MARKED.isdisjoint(marks)
        if tag == "main":  # may not stand in these, so they were left open
            for other in ("nav", "header", "footer", "aside"):
                if self.open[other]:
                    self._close(self.open[other][0])
        if bad and not self.dropped:
            self._end_line()
        self.open[tag].append(len(self.stack))
        self.stack.append((tag, bad))
        self.dropped += bad
        self.anchors += tag == "a"
        self.headings += tag in HEADINGS
        self.elements += 1
        if tag in BLOCKS:
            self.blocks.append(self.elements)
        if tag in CLUSTERS:
            self.clusters.append(self.elements)
        if tag in MAIN:
            self.regions += not self.mains
            self.mains += 1

    def handle_endtag(self, tag: str) -> None:
        if tag not in INLINE:
            self._end_line()
        self.tags += 1
        last = lambda names: max((self.open[n][-1] for n in names if self.open[n]), default=-1)
        barrier = last(("body", "html", *MAIN) if tag in INLINE or tag == "p" else ("body", "html"))
        if self.open[tag] and self.open[tag][-1] >= barrier:
            self._close(self.open[tag][-1])

    def _close(self, at: int) -> None:
        while len(self.stack) > at:
            tag, bad = self.stack.pop()
            self.open[tag].pop()
            if bad:
                self._end_line()
            self.dropped -= bad
            self.mains -= tag in MAIN
            self.anchors -= tag == "a"
            self.headings -= tag in HEADINGS
            if tag in BLOCKS:
                self.blocks.pop()
            if tag in CLUSTERS:
                self.clusters.pop()

    def handle_data(self, data: str) -> None:
        self.text.append(data)
        if self.anchors:
            self.links += len(" ".join(data.split()))


def smoothed(values: list[float], sigma: float = SIGMA) -> list[float]:
    reach = math.ceil(2 * sigma)
    kernel = [math.exp(-(k * k) / (2 * sigma * sigma)) for k in range(-reach, reach + 1)]
    n, whole = len(values), sum(kernel)
    return [sum(w * values[i + k - reach] for k, w in enumerate(kernel) if 0 <= i + k - reach < n) / whole for i in range(n)]


def extract(html: str | None) -> str:
    """The main text of a page."""
    parser = _Lines()
    parser.feed(html or "")
    parser.close()
    parser._end_line()
    lines = parser.lines
    ratios = [0.0 if x.region is None else (len(x.text) - x.links) / max(1, x.tags) for x in lines]
    smooth = smoothed(ratios)
    mean = sum(smooth) / max(1, len(smooth))
    limit = SHARE * math.sqrt(sum((x - mean) ** 2 for x in smooth) / max(1, len(smooth)))
    clusters: dict[int, list[int]] = {}
    for x in lines:
        if x.region is not None:
            sums = clusters.setdefault(x.cluster, [0, 0])
            sums[0] += x.links
            sums[1] += len(x.text)
    linked = {c for c, (links, chars) in clusters.items() if links > LINKED * chars}
    blocks: dict[int, list[int]] = {}
    for i, x in enumerate(lines):
        if x.region is not None and x.cluster not in linked:
            blocks.setdefault(x.block, []).append(i)
    content = {b for b, places in blocks.items() if max(smoothed([ratios[i] for i in places])) >= limit}
    if any(lines[blocks[b][0]].region for b in content):  # text outside of articles is content only where there is no article
        blocks = {b: places for b, places in blocks.items() if lines[places[0]].region}
        content &= blocks.keys()
    chosen = {i for b in content for i in blocks[b]}
    first, last = min(chosen, default=0), max(chosen, default=0)
    for b, places in blocks.items():
        between = first < places[0] and places[-1] < last and all(smooth[i] >= limit for i in places)
        if b not in content and (between or all(lines[i].heading for i in places) and places[-1] + 1 in chosen):
            chosen.update(places)
    return " ".join(lines[i].text for i in sorted(chosen))


def main_text(pages: DataFrame, html: str = "html", name: str = "text") -> DataFrame:
    """page_id, url and the extracted text of each row of pages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, html):
                made = pa.array([extract(x) for x in part.column(html).to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), made], names=["page_id", "url", name])

    rows = pages.select("page_id", "url", html)
    return rows.mapInArrow(run, f"page_id {rows.schema['page_id'].dataType.simpleString()}, url string, `{name}` string")


def query(spark: SparkSession, pages: DataFrame) -> DataFrame:
    return main_text(pages).withColumn("n_chars", F.char_length("text").cast("long"))
