"""Main-text extraction from HTML by text-to-tag ratio.

The events of the standard library's streaming parser cut a page into lines
(one per block element). A line's ratio is its number of code points over its
number of tags. Lines inside menus, headers, footers, sidebars, notices,
adverts, forms and comments, known by element, role, class or id, get ratio 0.
A class or id is only a hint: it doesn't count for an element that holds an ``article``
or ``main``, unless that stands within another one, nor for one that holds more than half of
the page's text, unless it stands outside of the section elements of a page that has some. Reader comments
are the exception: they count within a section whatever their size, and elsewhere unless nothing else is there.
The ratios are smoothed by a Gaussian and clustered by a threshold (the standard
deviation of the smoothed ratios, at most their mean): runs above it are the
content regions. The regions choose the section elements (``article`` and ``main``; one
within another is part of it): of each that holds a region all lines that are not
boilerplate are kept, so that a short paragraph beside long ones stays. Where no section
element holds a region, or the regions outside of them hold more text than each of them,
the lines from the first to the last region outside are kept too, without lines that are
nothing but links at either end, and with the lines next to them that stand in the same
element (a title, a short last paragraph) and are not links. If no heading ``h1`` is kept, the
nearest one before the text is, with what follows it, where only main lines lie between.

A page is one row, parsed as a stream inside a map; nothing is shuffled.

Defined results: a null, empty or text-free page gives the empty string;
white space inside a line, no-break spaces included, becomes one space; nesting costs linear time; the end
tags that HTML implies (of ``head``, ``p``, list items, table parts and options) count,
any other unclosed element ends with its parent; repeated rows are parsed each for itself;
columns other than those named are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from html.parser import HTMLParser
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paddock.llm.common import per_batch, schema, table

# Element names of HTML.
SKIP = frozenset("script style noscript template head title svg math iframe object canvas textarea select option button".split())
BOILER = frozenset("nav footer aside form menu dialog".split())
SECTION = frozenset("article main".split())
BLOCK = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption
figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody tfoot
thead tr ul""".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
# Words in a class or an id that mark boilerplate.
MARKS = re.compile(r"(?i)(?:^|[\s_-])(?:ads?|advert\w*|banner|sponsor\w*|promo\w*|sidebar|side-?bar|nav|navbar|navigation|menu|"
                   r"breadcrumbs?|footer|cookies?|consent|gdpr|notice|popup|modal|newsletter|subscribe|subscription|comments?|"
                   r"commentlist|disqus|discussion|replies|related|recommend\w*|share|sharing|social|toolbar|masthead|"
                   r"site-?header|page-?header|widget|login|signup|search|pagination|pager)(?:$|[\s_-])")
#: Of these, the ones of reader comments.
COMMENTS = re.compile(r"(?i)(?:^|[\s_-])(?:comments?|commentlist|disqus|discussion|replies)(?:$|[\s_-])")
#: Class names that say that something else is (not) there, as in "has-sidebar" or "post-with-comments".
ABOUT = re.compile(r"(?i)(?:^|[_-])(?:has|no|with|without)[_-]")
# What may stand in a head, and the open elements that a start tag ends, up to an element that it doesn't leave.
IN_HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title".split())
CELL = frozenset("td th".split())
GROUP = frozenset("tbody thead tfoot".split())
_ITEM_STOP = (BLOCK | CELL) - frozenset("address div p li dd dt".split())
_TABLE_STOP = frozenset(["table"])
IMPLIED = {
    "li": (frozenset(["li"]), _ITEM_STOP), **dict.fromkeys(("dd", "dt"), (frozenset(["dd", "dt"]), _ITEM_STOP)),
    **dict.fromkeys(CELL, (CELL, _TABLE_STOP | {"tr"})), "tr": (CELL | {"tr"}, _TABLE_STOP), **dict.fromkeys(GROUP, (CELL | GROUP | {"tr"}, _TABLE_STOP)),
    **dict.fromkeys(("option", "optgroup"), (frozenset(["option"]), frozenset("select datalist".split()))),
}
_P_STOP = (BLOCK | CELL | {"button"}) - {"p"}
ENDS_P = BLOCK - frozenset("body caption html legend tbody tfoot thead tr".split())
SIGMA = 1.5


def marked(name: str, value: str, words: re.Pattern = MARKS) -> bool:
    """Whether a class or id names boilerplate; each of a class's words counts by itself."""
    return any(words.search(x) and not ABOUT.search(x) for x in (value.split() if name == "class" else [value]))


class Line(NamedTuple):
    """The text of a block. A mark is the number of the innermost element with a marking class or id, 0 for none;
    ``block`` and ``parent`` number the block element and the one around it."""

    text: str
    tags: int
    boiler: bool
    section: int
    mark: int
    heading: bool
    links: bool  # nothing but links
    block: int
    parent: int


class _Lines(HTMLParser):
    """Collects the lines of a page."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.text: list[str] = []
        self.tags = self.linked = self.sections = 0
        # name, skipped, boilerplate, section, mark
        self.open: list[tuple[str, bool, bool, int, int]] = [("", False, False, 0, 0)]
        self.at: dict[str, list[int]] = {}  # where the elements of each name are open
        self.blocks = [(0, 0), (0, 0)]  # (place, number) of the open block elements, the page as two of them
        self.numbers = 0
        self.comments = {0: False}  # whether a mark is one of reader comments
        self.around, self.within = [0], [0]  # the mark and the section around each mark
        self.layout = {0}  # marks around a section element

    def flush(self) -> None:
        text = " ".join("".join(self.text).split())
        if text:
            _, _, boiler, section, mark = self.open[-1]
            links = self.linked >= len(text) - text.count(" ")
            self.lines.append(Line(text, max(1, self.tags), boiler, section, mark, "h1" in self.at, links,
                                   self.blocks[-1][1], self.blocks[-2][1]))
            self.tags = 0
        self.text.clear()
        self.linked = 0

    def push(self, element: tuple[str, bool, bool, int, int]) -> None:
        self.at.setdefault(element[0], []).append(len(self.open))
        if element[0] in BLOCK:
            self.numbers += 1
            self.blocks.append((len(self.open), self.numbers))
        self.open.append(element)

    def drop(self, cut: int) -> None:
        for name, *_ in reversed(self.open[cut:]):
            places = self.at[name]
            places.pop()
            if not places:
                del self.at[name]
        del self.open[cut:]
        while self.blocks[-1][0] >= cut:
            self.blocks.pop()

    def end_open(self, ends, stop) -> None:
        """End the outermost element of ``ends`` that is open within the innermost one of ``stop``."""
        if not any(name in self.at for name in ends):
            return
        names = stop if len(stop) < len(self.at) else [name for name in self.at if name in stop]
        inner = max((self.at[name][-1] for name in names if name in self.at and name not in ends), default=0)
        inside = [places[bisect_right(places, inner)] for name in ends if (places := self.at.get(name)) and places[-1] > inner]
        if inside:
            self.leave(min(inside))

    def leave(self, cut: int) -> None:
        """End the open elements from ``cut`` on; text before the end stays with them."""
        if self.open[-1][2:] != self.open[cut - 1][2:] and any(o[0] in CELL or o[0] in BLOCK for o in self.open[cut:]):
            self.flush()
        self.drop(cut)

    def handle_starttag(self, tag, attrs):
        self.tags += 1
        if tag == "body":
            self.end_open(("head",), ())
        elif self.open[-1][0] == "head" and tag not in IN_HEAD:
            self.drop(len(self.open) - 1)
        if tag in VOID:
            if tag == "hr":
                self.flush()
            elif tag in ("br", "wbr"):
                self.text.append(" " if tag == "br" else "")
            return
        if tag in BLOCK:
            self.flush()
        elif tag in ("td", "th"):
            self.text.append(" ")
        if tag in ENDS_P:
            self.end_open(("p",), _P_STOP)
        if tag in IMPLIED:
            self.end_open(*IMPLIED[tag])
        _, skipped, boiler, section, mark = self.open[-1]
        hint = comments = False
        if not skipped and tag in SKIP:
            skipped = True
        if not boiler:
            boiler = tag in BOILER or (tag == "header" and not section)
            for name, value in attrs:
                if name in ("class", "id") and value and tag not in ("html", "body", "article", "main"):
                    hint = hint or marked(name, value)
                    comments = comments or marked(name, value, COMMENTS)
                elif name == "role":
                    boiler = boiler or (value or "").strip().lower() in ROLES
                elif name == "hidden" or name == "aria-hidden" and value == "true":
                    skipped = True
                elif name == "style" and value and re.search(r"(?i)display\s*:\s*none|visibility\s*:\s*hidden", value):
                    skipped = True
        if tag in SECTION and not boiler and not section:
            self.hold(mark)
            self.sections += 1
            section = self.sections
        if hint:
            self.around.append(mark)
            self.within.append(self.open[-1][3])
            mark = len(self.around) - 1
            self.comments[mark] = comments
        if tag in CELL and (boiler, section, mark) != self.open[-1][2:]:
            self.flush()  # a cell of another kind than its row
        self.push((tag, skipped, boiler, section, mark))

    def hold(self, mark: int) -> None:
        """A section element within ``mark``: none of the marks around it names boilerplate."""
        while mark not in self.layout:
            self.layout.add(mark)
            mark = self.around[mark]

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)  # "/>" closes only void elements

    def handle_endtag(self, tag):
        self.tags += 1
        if tag in VOID:
            return
        if tag in BLOCK:
            self.flush()
        if tag not in self.at:
            return
        k = self.at[tag][-1]
        if tag not in BLOCK and tag not in SKIP and tag not in CELL and self.blocks[-1][0] > k:
            return  # an inline element doesn't close blocks
        self.leave(k)

    def handle_data(self, data):
        if self.open[-1][0] == "head" and data.strip():
            self.drop(len(self.open) - 1)
        if not self.open[-1][1]:
            self.text.append(data)
            if "a" in self.at:
                self.linked += len("".join(data.split()))

    def settled(self) -> list[Line]:
        """The lines, those within a mark that counts being boilerplate."""
        held = [0] * len(self.around)
        for line in self.lines:
            held[line.mark] += 0 if line.boiler else len(line.text)
        whole, sections = sum(held), any(x.section and not x.boiler for x in self.lines)
        for m in range(len(held) - 1, 0, -1):  # a mark's number is above that of the mark around it
            held[self.around[m]] += held[m]
        valid = [False] * len(held)
        for m in range(1, len(held)):
            if self.comments[m]:
                most = held[m] == whole
            else:
                most = 2 * held[m] > whole and (self.within[m] or not sections)
            valid[m] = valid[self.around[m]] or not (m in self.layout or most)
        return [line._replace(boiler=line.boiler or valid[line.mark]) for line in self.lines]

    def parse_marked_section(self, i, report=1):
        """Conditional comments such as <![if ...]> end at the next ">"."""
        end = self.rawdata.find(">", i)
        return end + 1 if end >= 0 else -1


def lines_of(html: str) -> list[Line]:
    parser = _Lines()
    parser.feed(html)
    parser.close()
    parser.flush()
    return parser.settled()


def regions(ratios: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Which lines lie in a content region: smoothed by a Gaussian, above the threshold."""
    reach = int(np.ceil(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    smooth = np.convolve(ratios, kernel, "same" if len(ratios) >= len(kernel) else "full")
    if len(smooth) != len(ratios):
        smooth = smooth[reach:reach + len(ratios)]
    smooth /= kernel.sum()
    return smooth >= min(smooth.std(), smooth.mean()) if len(smooth) > 1 else np.ones(len(smooth), bool)


def run_of(lines: list[Line], inside: np.ndarray) -> tuple[int, int]:
    """The first and the last line of the text outside of sections, from the regions there."""
    at = [k for k in np.flatnonzero(inside).tolist() if not lines[k].section]
    plain = [k for k in at if not lines[k].links] or at
    first, last = plain[0], plain[-1]

    def beside(k: int, edge: int) -> bool:
        here, there = lines[k], lines[edge]
        return not (here.boiler or here.links or here.section) and there.parent in (here.parent, here.block)

    while first and beside(first - 1, first):
        first -= 1
    while last + 1 < len(lines) and beside(last + 1, last):
        last += 1
    return first, last


def main_text(html: str | None, sigma: float = SIGMA) -> str:
    """The blocks of the main text in page order, joined by two line feeds."""
    lines = lines_of(html) if html else []
    boiler = np.array([x.boiler for x in lines], bool)
    if not len(lines) or boiler.all():
        return ""
    sizes = np.array([len(x.text) for x in lines], float)
    section = np.array([x.section for x in lines])
    ratios = np.where(boiler, 0.0, sizes / np.array([x.tags for x in lines]))
    inside = regions(ratios, sigma) & ~boiler
    if not inside.any():
        inside = ~boiler
    mass = np.bincount(section[inside], sizes[inside])
    chosen = np.flatnonzero(mass)
    keep = np.isin(section, chosen[chosen > 0]) & ~boiler
    if not mass.argmax():  # no section element holds most of the content
        first, last = run_of(lines, inside)
        keep[first:last + 1] |= ~boiler[first:last + 1]
    kept = np.flatnonzero(keep)
    if not any(lines[k].heading for k in kept):
        start = kept[0]
        while start and not boiler[start - 1] and not lines[start - 1].section and not lines[start].heading:
            start -= 1
        if lines[start].heading:
            keep[start:kept[0]] = True
    return "\n\n".join(lines[k].text for k in np.flatnonzero(keep))


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                      sigma: float = SIGMA) -> DataFrame:
    """One row per page: the id, the address and ``text``."""
    def make():
        def fn(batch):
            return [batch.column(0), batch.column(1), [main_text(h, sigma) for h in batch.column(2).to_pylist()]]
        return fn

    return per_batch(pages.select(id_col, url_col, html_col), make, schema(pages, id_col, f"`{url_col}` string, text string"))


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages")).withColumn("n_chars", F.char_length("text").cast("long"))
