"""HTML extraction: the main text of pages, from parser events and the text-to-tag ratio of their lines."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Elements whose content is no text of a page, elements that are seldom main text, elements that end a line, and elements without content.
NO_TEXT = frozenset("head script style noscript template svg math canvas object iframe audio video button select textarea option".split())
SELDOM = frozenset("nav aside footer form dialog menu".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that may hold a page's main text, the first kind more likely.
ARTICLES, CONTAINERS = frozenset({"article", "main"}), frozenset("div section td body html blockquote".split())
#: Containers that are parts of a text rather than the whole of it, and characters of a line, or for each tag, that only prose has.
PARTS, PROSE = frozenset({"section", "blockquote"}), 80.0
#: Open elements that are told apart; what lies deeper counts as text of the last one, as browsers have it.
DEEPEST = 512
#: Words in class, id or role that tell of menus, notices, adverts, comments and the like.
ASIDE = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|banner|breadcrumbs?|comments?|complementary|contentinfo|consent|cookies?|disqus|footer|gdpr|masthead|menu|modal|nav|navbar|navigation|newsletter|notice|"
    r"pagination|popup|promo\w*|related|replies|respond|search|share|sharing|sidebar|social|sponsor\w*|subscribe|toolbar|topbar|widget)(?:$|[\s_-])",
    re.I,
)
#: Open elements that an element of the same line closes.
CLOSES = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}


class Lines(HTMLParser):
    """A page's lines: pieces of text with the regions that hold them, the tags in the line, and its own region.

    Regions are elements that may hold the main text and elements that tag or names say are aside; each has its
    name, the region around it and whether it is said to be aside. Region 0 is the page.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, int, bool]] = []  # name, region, whether its content is no text
        self.regions: list[tuple[str, int, bool]] = [("html", 0, False)]
        self.pieces: list[tuple[str, int]] = []
        self.tags = 0
        self.lines: list[tuple[list[tuple[str, int]], int, int]] = []

    def _top(self) -> tuple[int, bool]:
        return self.stack[-1][1:] if self.stack else (0, False)

    def _end_line(self) -> None:
        if any(not x.isspace() for x, _ in self.pieces):
            self.lines.append((self.pieces, self.tags, self._top()[0]))
            self.tags = 0
        self.pieces = []

    def _is_aside(self, tag: str, attrs: list[tuple[str, str | None]]) -> bool:
        if tag in ("html", "body"):
            return False
        if tag in SELDOM or tag == "header" and not any(x[0] in ARTICLES for x in self.stack):
            return True
        return any(
            k == "hidden" or k in ("class", "id", "role") and bool(v and ASIDE.search(v)) or k == "aria-hidden" and v == "true" or k == "style" and bool(v and re.search(r"display\s*:\s*none", v))
            for k, v in attrs
        )

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "br":
            self.pieces.append((" ", self._top()[0]))
        if tag in BLOCKS:
            self._end_line()
        self.tags += 1
        if tag in VOID or len(self.stack) >= DEEPEST:
            return
        if closed := CLOSES.get(tag):
            while self.stack and self.stack[-1][0] in closed:
                self.stack.pop()
            if tag == "p":  # a p that is open around inline elements ends too
                for at in range(len(self.stack) - 1, -1, -1):
                    if self.stack[at][0] == "p":
                        del self.stack[at:]
                        break
                    if self.stack[at][0] in BLOCKS:
                        break
        region, empty = self._top()
        aside = self._is_aside(tag, attrs)
        if aside or tag in ARTICLES or tag in CONTAINERS:
            self.regions.append((tag, region, aside))
            region = len(self.regions) - 1
        self.stack.append((tag, region, empty or tag in NO_TEXT))

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.stack and self.stack[-1][0] == tag and tag in ("svg", "math"):
            self.stack.pop()

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS:
            self._end_line()
        self.tags += 1
        for at in range(len(self.stack) - 1, -1, -1):
            if self.stack[at][0] == tag:
                del self.stack[at:]
                break
            if tag not in BLOCKS and self.stack[at][0] in BLOCKS:  # an inline end tag closes nothing beyond its block
                break

    def handle_data(self, data: str) -> None:
        region, empty = self._top()
        if not empty:
            self.pieces.append((data, region))

    def close(self) -> None:
        super().close()
        self._end_line()


def smoothed(values: np.ndarray, sigma: float = 1.5) -> np.ndarray:
    """The values under a Gaussian of this width, cut at three widths; edges count what is there."""
    reach = int(3 * sigma)
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    weight = np.convolve(np.ones(len(values)), kernel, "full")[reach : reach + len(values)]
    return np.convolve(values, kernel, "full")[reach : reach + len(values)] / weight


def threshold(values: np.ndarray, rounds: int = 20) -> float:
    """Halfway between the means of the low and the high cluster of the values."""
    cut = float(values.mean())
    for _ in range(rounds):
        low, high = values[values < cut], values[values >= cut]
        new = (low.mean() + high.mean()) / 2 if len(low) and len(high) else cut
        if new == cut:
            break
        cut = float(new)
    return cut


def _common(paths: list[list[int]]) -> list[int]:
    """What all paths begin with."""
    low, high = min(paths), max(paths)
    return low[: next((i for i, (a, b) in enumerate(zip(low, high)) if a != b), min(len(low), len(high)))]


def _densest(weights: dict[int, float], around: list[list[int]]) -> list[int]:
    """The path to the innermost region that holds more than half of the weights of regions' own text."""
    total, held = sum(weights.values()), Counter()
    for k, weight in weights.items():
        for region in around[k]:
            held[region] += weight
    return max((around[k] for k, weight in held.items() if 2 * weight > total), key=len, default=[])


def main_text(html: str) -> str:
    """The lines of the page's content region, joined by \\n.

    A line scores its characters for each tag, those in regions that are said to be aside (SELDOM, ASIDE) a
    tenth, and scores are smoothed over neighbours. Lines above the threshold between low and high scores (PROSE
    at most) are dense. The innermost region with more than half of their text, if it has a line of PROSE
    characters, is not aside, nor is what is around it, whatever tags and names say; all others that are said to
    be have no text from here on.

    The content is the block around all dense lines, and if articles hold more than half of their text, all
    articles. A block is a child of the innermost element with all text; a section, a quote or a cell with no more
    than half of the text is a part of what is around it. All lines of the content stay, short ones, tables and
    nested blocks too.
    """
    page = Lines()
    page.feed(html)
    page.close()
    if not page.lines:
        return ""

    around = [[0]]  # the regions around each region, outermost first, and itself
    for k, (_, parent, _) in enumerate(page.regions[1:], 1):
        around.append([*around[parent], k])
    said = [any(page.regions[k][2] for k in path) for path in around]
    weighed = np.array([sum(len(x) * (0.1 if said[k] else 1.0) for x, k in pieces) / max(tags, 1) for pieces, tags, _ in page.lines])
    score, held, core = smoothed(weighed), Counter(), set()
    for (pieces, _, _), dense in zip(page.lines, score >= min(threshold(score), PROSE), strict=True):
        for x, k in pieces if dense else ():
            held[k] += len(x) * (0.1 if said[k] else 1.0)
    if path := _densest(held, around):
        if any(path[-1] in around[where] and sum(len(x) for x, _ in pieces) >= PROSE for pieces, _, where in page.lines):
            core = set(path)
    aside = [any(page.regions[k][2] and k not in core for k in path) for path in around]

    texts, own = [], []
    for pieces, tags, where in page.lines:
        text = " ".join("".join(x for x, k in pieces if not aside[k]).split())
        texts.append((text, around[where]))
        own.append(len(text) / max(tags, 1))
    if not any(text for text, _ in texts):
        return ""
    score = np.minimum(own, smoothed(np.array(own)))
    left = [(text, path, v) for (text, path), v in zip(texts, score, strict=True) if text]
    cut = min(threshold(smoothed(np.array(own))), PROSE, max(v for _, _, v in left))
    high, total = [x for x in left if x[2] >= cut], sum(len(text) for text, _, _ in left)
    in_article = lambda path: any(page.regions[k][0] in ARTICLES for k in path)
    if 2 * sum(len(text) for text, path, _ in high if in_article(path)) > sum(len(text) for text, _, _ in high):
        return "\n".join(text for text, path, _ in left if in_article(path))
    depth = len(_common([path for _, path, _ in left]))
    content = _common([path for _, path, _ in high])[: depth + 1]
    while len(content) > 1 and (
        (kind := page.regions[content[-1]][0]) in PARTS or kind == "td" and 2 * sum(len(text) for text, path, _ in left if content[-1] in path) <= total
    ):
        content.pop()
    return "\n".join(text for text, path, _ in left if content[-1] in path)


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text (main_text() of the whole html) and n_chars (long, its code points).

    A null, empty or markup-only html gives an empty text. White space inside a block, with line breaks, is one
    space; character references are decoded. Rows stay as they are, repeated ones, rows of one page_id and rows
    without one too; an empty table gives no row; columns other than page_id, url and html are not read, whatever
    their names. One pass without a shuffle, a page in memory at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = [main_text(h) if h else "" for h in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.selectExpr("cast(page_id as long) page_id", "cast(url as string) url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
