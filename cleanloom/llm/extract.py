"""Main text of web pages: text-to-tag ratios of blocks, smoothed, choose the region that holds the article."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cleanloom.llm.common import map_arrow

#: Elements that start a new block of text.
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hr html legend li main menu nav noscript ol option p pre section select summary table tbody td tfoot th thead title tr ul".split()
)
#: Elements whose text never belongs to an article.
NEVER = frozenset(
    "script style noscript template head title nav header footer aside form button select option textarea menu dialog svg iframe object".split()
)
#: Elements without an end tag.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that name the article themselves.
ARTICLE = frozenset(["article", "main"])
#: Elements of one block, too small to be a region.
LINES = frozenset("p li td h1 h2 h3".split())
#: Words in a class, id or role that mark an element as something beside the article.
BESIDE = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|banner|breadcrumbs?|comments?|cookies?|disqus|footer|header|masthead|menu|nav\w*|newsletter|notices?|popup|"
    r"promo\w*|related|share|sharing|sidebar|social|sponsor\w*|subscribe|toolbar|widget|complementary|contentinfo|search)(?:$|[\s_-])",
    re.I,
)
SPACE = re.compile(r"\s+")
DIGITS = re.compile(r"\d+")
#: Ends that are implied: an opening tag of the key closes open elements of the value.
CLOSES = {t: ("p",) for t in BLOCKS - {"br", "body", "html", "option", "caption"}} | {"li": ("p", "li"), "option": ("option",), "tr": ("td", "th", "tr"), "td": ("td", "th"), "dd": ("dd", "dt"), "dt": ("dd", "dt")}
#: An implied end stops at these.
SCOPES = frozenset("article aside blockquote body div footer form header html main nav section table td th ul ol dl".split())


class Blocks(HTMLParser):
    """Blocks of a page as the parser's events come: text, tags in it, links in it, and the containers around it.

    An element of NEVER that starts no block (a script or button inside a paragraph) leaves the block around it as it is.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, int]] = [("", 0)]  # element, its number
        self.parents: list[int] = [0]
        self.names: list[str] = [""]
        self.marks: list[frozenset[str]] = [frozenset()]  # words of its class, id and role that say it is beside the article
        self.blocks: list[tuple[str, int, int, int]] = []
        self.text: list[str] = []
        self.tags = self.linked = self.in_link = 0
        self.hidden = 0  # place in ``open`` of the outermost element of NEVER inside a block, 0 if none

    def end_block(self) -> None:
        text = SPACE.sub(" ", "".join(self.text)).strip()
        if text or self.tags:
            at = (self.hidden or len(self.open)) - 1  # a hidden element left open is not where the block stands
            self.blocks.append((text, self.tags, self.linked, self.open[at][1]))
        self.text, self.tags, self.linked = [], 0, 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        inline = tag in NEVER and tag not in BLOCKS
        if tag in BLOCKS and not self.hidden:
            self.end_block()
            for closed in CLOSES.get(tag, ()):
                self.close_element(closed, implied=True)
        if not self.hidden and not inline:
            self.tags += 1
        if tag in VOID:
            return
        if tag == "a":
            self.in_link += 1
        if tag in BLOCKS or tag in NEVER:
            if inline and not self.hidden:
                self.hidden = len(self.open)
            self.parents.append(self.open[-1][1])
            self.names.append(tag)
            words = [w for k, v in attrs if k in ("class", "id", "role") and v for w in v.split()] if tag not in ("html", "body", "p") else []
            self.marks.append(frozenset(DIGITS.sub("", w.lower()) for w in words if BESIDE.search(w)))
            self.open.append((tag, len(self.names) - 1))

    def close_element(self, tag: str, implied: bool = False) -> None:
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i][0] == tag:
                if not self.hidden or i < self.hidden:
                    self.end_block()
                if i <= self.hidden:
                    self.hidden = 0
                del self.open[i:]
                return
            if implied and self.open[i][0] in SCOPES:
                return

    def handle_endtag(self, tag: str) -> None:
        if not self.hidden and (tag in BLOCKS or tag not in NEVER):
            self.tags += 1
        if tag == "a":
            self.in_link = max(0, self.in_link - 1)
        elif tag in BLOCKS or tag in NEVER:
            self.close_element(tag)

    def handle_data(self, data: str) -> None:
        if self.hidden:
            return
        self.text.append(data)
        if self.in_link:
            self.linked += len(data)


def beside(parser: Blocks) -> list[bool]:
    """Whether each element stands beside the article, by its kind, its marks or an element around it.

    Elements that share a mark are weighed together, numbers in it aside: it hides them only while they hold less than
    half of the text outside links, and an element only if all its marks do and it holds no article or main element
    (but one that is marked itself, as comments may be).
    """
    parents, names, marks = parser.parents, parser.names, parser.marks
    n = len(names)
    holds, never, around = [False] * n, [False] * n, [frozenset()] * n
    for e in range(1, n):  # elements are numbered as they open, parents first
        never[e] = never[parents[e]] or names[e] in NEVER
        around[e] = around[parents[e]] | marks[e]
    for e in range(n - 1, 0, -1):
        holds[e] = holds[e] or (names[e] in ARTICLE and not marks[e] and not never[e])
        holds[parents[e]] = holds[parents[e]] or holds[e]
    total, weight = 0, {}
    for text, _, linked, at in parser.blocks:
        if not never[at]:
            size = max(0, len(text) - linked)
            total += size
            for mark in around[at]:
                weight[mark] = weight.get(mark, 0) + size
    minor = {mark for mark, size in weight.items() if not size or 2 * size < total}
    out = [False] * n
    for e in range(1, n):
        out[e] = out[parents[e]] or names[e] in NEVER or bool(not holds[e] and names[e] not in ARTICLE and marks[e] and marks[e] <= minor)
    return out


def smoothed(x: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian smoothing; at the ends the kernel is what remains of it."""
    reach = max(1, int(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    return np.convolve(x, kernel, "full")[reach : reach + len(x)] / np.convolve(np.ones(len(x)), kernel, "full")[reach : reach + len(x)]


def threshold(x: np.ndarray) -> float:
    """The border between two clusters of the values: two means, from the smallest and largest value, until they stay."""
    low, high = float(x.min()), float(x.max())
    for _ in range(100):
        border = (low + high) / 2
        below, above = x[x <= border], x[x > border]
        if not len(above):
            return low - 1
        new = float(below.mean()), float(above.mean())
        if new == (low, high):
            break
        low, high = new
    return (low + high) / 2


def main_text(html: str, sigma: float = 1.0) -> str:
    """The article of a page: its blocks, joined by line feeds; empty if there is none.

    Each block's text-to-tag ratio (characters outside links, over tags) is smoothed over its neighbours and the two
    clusters of ratios are told apart. The article is the smallest element that holds all content blocks and the page's
    headline (the first h1), or the outermost element around that which names itself an article. All its blocks are
    returned, short ones too, but for elements that stand beside the article.
    """
    cut = html.rfind("<")
    if cut >= 0 and ">" not in html[cut:] and html[cut + 1 : cut + 2].isalpha() | (html[cut + 1 : cut + 2] in ("/", "!", "?")):
        html = html[:cut]  # a tag that the page's end cut off is no text
    parser = Blocks()
    parser.feed(html)
    parser.close()
    parser.end_block()
    aside = beside(parser)
    blocks = [b for b in parser.blocks if b[0] and not aside[b[3]]]
    if not blocks:
        return ""
    ratio = np.array([max(0, len(t) - linked) / max(1, tags) for t, tags, linked, _ in blocks], float)
    ratio = smoothed(ratio, sigma)
    content = ratio > threshold(ratio)
    first = next((i for i, b in enumerate(blocks) if parser.names[b[3]] == "h1"), -1)
    common: list[int] | None = None  # the elements around all content blocks, outermost first
    for i, (_, _, _, at) in enumerate(blocks):
        if content[i] or i == first:
            path = [at]
            while path[-1]:
                path.append(parser.parents[path[-1]])
            path.reverse()
            common = path if common is None else [a for a, b in zip(common, path, strict=False) if a == b]
    common = common or [0]
    region = next((e for e in common if parser.names[e] in ARTICLE), 0)
    while not region and len(common) > 1 and parser.names[common[-1]] in LINES:
        common.pop()
    region = region or common[-1]

    def inside(at: int) -> bool:
        while at and at != region:
            at = parser.parents[at]
        return at == region

    return "\n".join(b[0] for b in blocks if inside(b[3]))


def extract(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """Main text of every page: ``id_column``, ``url_column``, ``text``, ``n_chars`` (its code points).

    A null or empty page, and one without an article, has an empty text. Null ids and urls and repeated rows come
    back as they are.
    """

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [main_text(h) if h else "" for h in batch.column(2).to_pylist()]
        return pa.record_batch(
            [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
            names=["id", "url", "text", "n_chars"],
        )

    kind = pages.schema[id_column].dataType.simpleString()
    rows = pages.select(F.col(id_column).alias("id"), F.col(url_column).cast("string").alias("url"), F.col(html_column).cast("string").alias("html"))
    out = map_arrow(rows, step, f"id {kind}, url string, text string, n_chars bigint")
    return out.withColumnRenamed("id", id_column).withColumnRenamed("url", url_column)
