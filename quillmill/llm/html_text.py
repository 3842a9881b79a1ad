"""Main text of HTML pages: parser events, text-to-tag ratios, Gaussian smoothing, threshold clustering."""

from __future__ import annotations

import re
from collections import defaultdict
from html.parser import HTMLParser
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Fixed lists of element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody tfoot thead title tr ul".split())
NO_TEXT = frozenset("aside audio button canvas datalist dialog fieldset footer form head iframe menu nav noembed noframes noscript object option script select style svg template textarea title video".split())
CLOSES_P = BLOCK - frozenset("body html head title option".split())
CONTAINER = frozenset("article main".split())
SECTION = frozenset("article body center dd div main section td".split())
#: Words in class, id and role that mark what is no part of an article.
FURNITURE = frozenset(
    "ad ads adv advert adverts advertisement advertising alert alerts banner breadcrumb breadcrumbs comment comments commentlist complementary consent contentinfo cookie cookies copyright dialog disclaimer disqus footer form gdpr legal login masthead menu menubar modal nav navbar navigation newsletter notice notices notification notifications outbrain pager pagination popup promo promos promotion recommended related respond search share sharing sidebar sidenav signup skip social sponsor sponsored subscribe subscription taboola toolbar warning widget widgets".split()
)
#: What may stand beside such a word in one name: "site-footer" is a footer, "footer-design" is a subject.
BESIDE = frozenset(
    "site page main top bottom left right first last primary secondary global local inner outer wrapper wrap container holder box block bar list item items link links area section slot unit post posts article articles button buttons panel mobile desktop sticky fixed row col column group zone region header head title label text content body level sub thread form icon icons user reader readers js id the".split()
)
#: Elements that group blocks; only these are judged by name within a container, and only these by their id.
GROUPING = frozenset("center dd details div dl figure li main article ol section span table tbody td tr ul".split())
#: An id within a container tells of its subject, unless it is one of these.
COMMENTS = frozenset("comment comments commentlist disqus respond".split())
HEADS = frozenset("header".split())
UNENDED = re.compile(r"<[a-zA-Z/!?]")
PARTS = re.compile(r"[a-z]+")


def named(value: str, words: frozenset) -> bool:
    """Whether one of the names in an attribute is furniture as a whole: a word of these, beside which only such stand
    as tell of its place. "has-sidebar" tells of something else in the page."""
    for name in value.lower().split():
        parts = PARTS.findall(name)
        if any(x in words for x in parts) and all(x in FURNITURE or x in BESIDE for x in parts):
            return True
    return False


class Line(NamedTuple):
    """A block of text: its characters outside of links and in all, the tags since the line before, where it stands."""

    text: str
    plain: int
    chars: int
    tags: int
    region: int  # number of the container (article or main); 0: none
    section: int  # number of the innermost element that groups blocks


class _Lines(HTMLParser):
    """Turns parser events into lines: one for each block of text, with its tags and the container that it stands in."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, bool]] = []  # (element, whether its text is left out)
        self.places: dict[str, list[int]] = defaultdict(list)  # of each element's open ones the places in the stack
        self.out_divs = self.out_others = 0  # divs, and elements without text, on the stack that are left out
        self.sections = [0]  # numbers of the open sections
        self.made = 0
        self.links = 0  # open links
        self.plain = self.chars = 0  # characters but white space of the line so far, outside of links and in all
        self.out = 0  # elements on the stack whose text is left out
        self.inside = 0  # containers on the stack
        self.region = 0  # number of the container; 0: none
        self.regions = 0
        self.parts: list[str] = []
        self.tags = 0
        self.lines: list[Line] = []

    def flush(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            self.parts = []
            if text:
                self.lines.append(Line(text, self.plain, self.chars, self.tags, self.region, self.sections[-1]))
                self.tags = self.plain = self.chars = 0

    def _left_out(self, tag: str, attrs) -> bool:
        if tag in NO_TEXT:
            return True
        if tag in HEADS and not self.inside:
            return True
        if tag in ("html", "body"):
            return False
        for name, value in attrs:
            if name == "hidden" or name == "aria-hidden" and value == "true":
                return True
            if name == "style" and value and re.search(r"display\s*:\s*none", value.lower()):
                return True
            if name in ("class", "id", "role") and value:
                if name == "id" and tag not in GROUPING or self.inside and tag not in GROUPING:
                    continue  # ids of headings and paragraphs are made of their words
                words = COMMENTS if self.inside and name == "id" or tag in CONTAINER else FURNITURE if self.inside else FURNITURE | HEADS
                if named(value, words):
                    return True
        return False

    def _pop(self) -> None:
        tag, out = self.stack.pop()
        self.places[tag].pop()
        self.out -= out
        self.out_divs -= out and tag == "div"
        self.out_others -= out and tag in NO_TEXT
        self.links -= tag == "a"
        if tag in SECTION:
            self.sections.pop()
        if tag in CONTAINER and not out:
            self.inside -= 1
            if not self.inside:
                self.flush()
                self.region = 0

    def handle_starttag(self, tag: str, attrs) -> None:
        self.tags += 1
        if tag in BLOCK:
            self.flush()
        elif tag == "br" or tag in ("td", "th"):
            self.parts.append(" ")
        if tag in VOID:
            return
        if tag in CONTAINER and self.out_divs and not self.out_others:
            # an article does not stand in an advert: the advert's end is missing
            while self.out:
                self._pop()
        if tag in CLOSES_P and tag not in ("li", "dd", "dt"):
            self._close("p", BLOCK - {"p"})
        elif tag in ("li", "dd", "dt", "tr"):
            self._close(tag, frozenset(("ul", "ol", "dl", "table", "article", "main", "section", "div")))
        out = self._left_out(tag, attrs)
        if tag in CONTAINER and not out:
            self.inside += 1
            if self.inside == 1:
                self.regions += 1
                self.region = self.regions
        if tag in SECTION:
            self.made += 1
            self.sections.append(self.made)
        self.places[tag].append(len(self.stack))
        self.stack.append((tag, out))
        self.out += out
        self.out_divs += out and tag == "div"
        self.out_others += out and tag in NO_TEXT
        self.links += tag == "a"

    def handle_startendtag(self, tag: str, attrs) -> None:
        self.tags += 1
        if tag in BLOCK:
            self.flush()
        elif tag == "br":
            self.parts.append(" ")

    def _close(self, tag: str, walls) -> None:
        """Ends the innermost open tag, if no wall stands before it."""
        if self.places[tag]:
            place = self.places[tag][-1]
            if all(not self.places[w] or self.places[w][-1] < place for w in walls):
                while len(self.stack) > place:
                    self._pop()

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag in BLOCK:
            self.flush()
        self._close(tag, () if tag in BLOCK or tag in NO_TEXT else BLOCK)

    def handle_data(self, data: str) -> None:
        if not self.out:
            self.parts.append(data)
            n = len("".join(data.split()))
            self.chars += n
            self.plain += n if not self.links else 0


def smoothed(ratios: np.ndarray, radius: int = 2, sigma: float = 1.0) -> np.ndarray:
    """The ratios, each a Gaussian mean of its neighbours."""
    kernel = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    padded = np.pad(ratios, radius)
    weight = np.convolve(np.pad(np.ones(len(ratios)), radius), kernel, "valid")
    return np.convolve(padded, kernel, "valid") / weight


def threshold(values: np.ndarray) -> float:
    """The border of two clusters of values: midway between their means, found from the overall mean on."""
    border = float(values.mean())
    for _ in range(20):
        low, high = values[values < border], values[values >= border]
        if not len(low) or not len(high):
            break
        new = float(low.mean() + high.mean()) / 2
        if abs(new - border) < 1e-9:
            break
        border = new
    return min(border, float(values.max()))


def content_lines(lines: list[Line]) -> list[bool]:
    """Which lines are the article's.

    A line's ratio is its characters outside of links by its tags. Ratios are smoothed and split into two clusters. What
    is judged is a run: consecutive lines of one container that are mostly links, or of one section that are not. A run is in the upper cluster if
    the mean of its smoothed ratios is. Such runs are content; so are runs of low ratio, such as a title or a short
    paragraph, that are no links and share a section or a container with one of them. Containers (article, main) with a
    run in the upper cluster leave no content outside of them; those without are judged like the rest of the page.
    """
    if not lines:
        return []
    ratios = smoothed(np.array([x.plain / max(1, x.tags) for x in lines]))
    border = threshold(ratios)
    kinds = [(x.region, -1 if 2 * x.plain < x.chars else x.section, 2 * x.plain < x.chars) for x in lines]
    starts = [k for k in range(len(lines)) if not k or kinds[k] != kinds[k - 1]]
    means = np.add.reduceat(ratios, starts) / np.diff([*starts, len(lines)])
    upper = np.repeat(means >= border, np.diff([*starts, len(lines)]))
    if not upper.any():  # one long run may hold all high ratios, and low ones that outweigh them
        upper = ratios >= border
    regions = {x.region for x, up in zip(lines, upper) if up and x.region}
    if regions:
        return [x.region in regions and (bool(up) or not links) for x, up, (_, _, links) in zip(lines, upper, kinds)]
    sections = {x.section for x, up in zip(lines, upper) if up}
    return [bool(up) or not links and x.section in sections for x, up, (_, _, links) in zip(lines, upper, kinds)]


def main_text(html: str | None) -> str:
    """The article of a page: blocks in page order, one line each; empty if there is none.

    What elements, classes, ids and roles mark as menus, headers, footers, asides, notices, adverts, forms, scripts and
    comments is left out; names count as a whole, and within an article those of groups alone, ids only where they tell
    of reader comments. Which of the other blocks stay, inside and outside of containers, is decided by content_lines.
    Work is linear in the page.
    """
    parser = _Lines()
    parser.feed(html or "")
    if UNENDED.match(parser.rawdata):  # a tag or comment that the page's end cuts off is no text
        parser.rawdata = ""
    parser.close()
    parser.flush()
    return "\n".join(x.text for x, kept in zip(parser.lines, content_lines(parser.lines)) if kept)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of pages (page_id, url, html).

    A null or empty html, and a page without content, give an empty text. Null and repeated ids keep their rows; the
    size of a page is not limited. Further columns are ignored; an empty table gives no rows.
    """

    def parse(parts):
        for batch in parts:
            for k in range(0, batch.num_rows, 200):
                some = batch.slice(k, 200)
                texts = [main_text(x) for x in some.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.selectExpr("cast(page_id as long) page_id", "url", "html").mapInArrow(parse, "page_id long, url string, text string, n_chars long")


def op5_html_text(spark, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
