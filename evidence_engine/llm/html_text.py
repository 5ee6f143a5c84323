"""Main text of HTML pages.

The standard library's parser streams its events into lines, one for each block, and into a table of elements with their
parents. A line is made of runs of text, each with the element that it stands in, so that boilerplate within a line goes and what
is around it stays. A line's ratio is its characters outside links over its tags; boilerplate counts as having none. The
ratios are smoothed with a Gaussian along the page. Lines whose smoothed ratio and own ratio reach the threshold, half a
standard deviation of the smoothed ratios, are the dense cluster. The content region is the lowest article or main element with
most of the cluster's text, or else the lowest container that holds every line of the cluster; all its lines outside boilerplate
are the article, short ones too. What names no kind of boilerplate goes by density alone: blocks outside the region, and blocks
of links in it. What a name calls boilerplate though it holds most of the page's text, or dense prose of an article under a name
that says little, stays; where names would leave nothing, none counts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import columns

#: The elements of HTML by how they are treated.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split())
CONTAINERS = frozenset("article body center div form html main section td".split())
ARTICLES = frozenset(("article", "main"))
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
NEVER = frozenset("aside button canvas datalist dialog embed fieldset footer head iframe input map menu nav noscript object script select style svg template textarea title".split())
#: Tags that a tag ends if they are open around it.
ENDS = {"li": ("li", "p"), "dt": ("dt", "dd", "p"), "dd": ("dt", "dd", "p"), "tr": ("td", "th", "tr", "p"), "td": ("td", "th", "p"), "th": ("td", "th", "p"), "option": ("option",), "body": ("head", "p"), "br": ()}
#: Elements within a line that a tag in them does not end, nor anything around them.
SCOPES = frozenset("button canvas datalist iframe map noscript object select svg template textarea".split())
#: Words that name boilerplate where they are a whole class or id, alone or with FILLERS.
MARKS = frozenset("ad ads advert advertisement adverts advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notices notification overlay pager pagination popup promo promoted promotion recommended related replies respond reviews search share sharing sidebar signup skip social sponsor sponsored subscribe toolbar widget".split())
FILLERS = frozenset("area bar big block body bottom box button buttons center col column container content fixed floating form global group head icons in inline inner item items layout left link links list main message middle mobile module notify outer page panel policy post posts primary reader row secondary section site slot small sticky stories sub text thread title to top unit user wrap wrapper".split())
#: Where these words are among a header's, it is that of an article.
OWN_HEADER = frozenset("article entry post story".split())
ROLES = frozenset("alert banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
SIGMA = 2.0
#: Marks of what readers wrote, which may be most of a page, and marks that sections of an article bear too.
READERS = frozenset("comment comments disqus replies respond reviews".split())
VAGUE = frozenset("header login menu navigation notice notices overlay related respond reviews search share sharing social toolbar widget".split())
#: Marks of places, which designs give to any part of a page.
LAYOUT = frozenset("banner footer masthead nav navbar pager sidebar skip".split())
#: A form with so much of the page's text is a wrapper, and so is what has a boilerplate's name with that share.
FORM_SHARE, NAME_SHARE = 0.8, 0.5
#: An article that holds so much of the dense text is the region.
ARTICLE_SHARE = 0.5
#: A block is one of links if so much of its text is in them.
LINK_SHARE = 2 / 3
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


def boilerplate_name(name: str, article: bool = False) -> frozenset[str]:
    """The marks of a class or id that names boilerplate: all its words are MARKS or FILLERS, with one mark. A header within
    an article is the article's own. Empty for other names."""
    words = [w.lower() for w in WORDS.findall(name)]
    marks = MARKS.intersection(words)
    if not marks or marks == {"header"} and (article or OWN_HEADER.intersection(words)):
        return frozenset()
    return marks if all(w in MARKS or w in FILLERS for w in words) else frozenset()


@dataclass
class Line:
    runs: list  # (text, element, whether in a link)
    tags: int
    links: int
    text: str = ""
    plain: int = 0  # characters outside links
    element: int = 0
    junk: bool = False


@dataclass
class Element:
    tag: str
    parent: int
    fixed: bool  # boilerplate by its own tag, role or as hidden
    marks: frozenset  # of its own class or id
    article: bool  # in an article or main element, or one itself
    name: str = ""  # its class
    junk: bool = False  # by all that, or by an element around it


class Page(HTMLParser):
    """Collects the lines and elements of a page; elements come before those in them, the first is the page itself."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.elements = [Element("", -1, False, frozenset(), False)]
        self.open: list[int] = [0]  # elements
        self.blocks: list[int] = []  # places in open of block elements
        self.scopes: list[int] = []  # places in open of SCOPES
        self.places: dict[str, list[int]] = {}  # places in open by tag
        self.runs: list[tuple[str, int, bool]] = []
        self.tags = self.links = 0

    def end_line(self) -> None:
        if any(text.strip() for text, _, _ in self.runs):
            self.lines.append(Line(self.runs, self.tags, self.links))
            self.tags = self.links = 0
        self.runs = []

    def fixed(self, tag: str, attrs: list, article: bool) -> bool:
        if tag in NEVER or tag == "header" and not article:
            return True
        for k, v in attrs:
            v = v or ""
            if tag not in ("html", "body") and (k == "hidden" or k == "style" and re.search(r"display\s*:\s*none", v) or k == "aria-hidden" and v.strip().lower() == "true"):
                return True
            if k == "role" and v.strip().lower() in ROLES and tag != "form":
                return True
        return False

    def marks(self, tag: str, attrs: list, article: bool) -> frozenset:
        if tag in ("html", "body", "main", "header") or tag in HEADINGS:
            return frozenset()
        return frozenset().union(*[boilerplate_name(x, article) for k, v in attrs if k in ("class", "id") for x in (v or "").split()])

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.tags += 1
        if tag in BLOCK:
            self.end_line()
            ends = ENDS.get(tag, ("p",))
            while self.blocks and self.elements[self.open[self.blocks[-1]]].tag in ends and (not self.scopes or self.scopes[-1] < self.blocks[-1]):
                self.cut(self.blocks[-1])
        if tag in VOID:
            return
        around = self.elements[self.open[-1]]
        article = around.article or tag in ARTICLES
        self.links += tag == "a"
        self.places.setdefault(tag, []).append(len(self.open))
        if tag in BLOCK:
            self.blocks.append(len(self.open))
        if tag in SCOPES:
            self.scopes.append(len(self.open))
        self.open.append(len(self.elements))
        self.elements.append(Element(tag, self.open[-2], self.fixed(tag, attrs, article), self.marks(tag, attrs, article), article, next((v or "" for k, v in attrs if k == "class"), "")))

    def cut(self, place: int) -> None:
        """Closes the open elements from a place on. An inline element that never ends by itself has an unknown extent, so its
        name says nothing."""
        for e in self.open[place:]:
            self.places[self.elements[e].tag].pop()
            if e != self.open[place] and self.elements[e].tag not in BLOCK:
                self.elements[e].marks = frozenset()
        del self.open[place:]
        for places in (self.blocks, self.scopes):
            while places and places[-1] >= place:
                places.pop()

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag in ("svg", "iframe", "a", "span"):
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag in BLOCK:
            self.end_line()
        at = self.places.get(tag)
        # an inline element does not end beyond the block that it is in
        if at and (tag in BLOCK or not self.blocks or at[-1] > self.blocks[-1]):
            self.cut(at[-1])

    def handle_data(self, data: str) -> None:
        if self.elements[self.open[-1]].tag in ("script", "style", "template"):
            return
        self.runs.append((data, self.open[-1], bool(self.places.get("a"))))


def closed(html: str) -> str:
    """The page with tags and comments that never end written as text; the parser would look for each one's end anew."""
    last = html.rfind("-->")
    html = html[: last + 1] + html[last + 1 :].replace("<!--", "&lt;!--")
    last = html.rfind(">")
    return html[: last + 1] + html[last + 1 :].replace("<", "&lt;")


def parsed(html: str) -> Page:
    html = closed(html)
    for text in (html, html.replace("<![", "&lt;![")):
        page = Page()
        try:
            page.feed(text)
            page.close()
        except AssertionError:  # a marked section that the parser knows nothing about: read again as text
            continue
        page.end_line()
        return page
    return Page()


def smoothed(ratio: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    reach = int(3 * sigma)
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    return np.convolve(ratio, kernel / kernel.sum(), "full")[reach : reach + len(ratio)]


def dense_lines(plain: np.ndarray, tags: np.ndarray) -> np.ndarray:
    """Whether each line is in the dense cluster, from its characters outside links and boilerplate and its tags."""
    own = plain / np.maximum(1, tags)
    near = smoothed(own)
    least = 0.5 * near.std()
    return (near >= least) & (own >= least) & (plain > 0)


def sums(elements: list[Element], values: dict[int, int]) -> list[int]:
    """For each element, the sum of the values of all elements in it, itself included."""
    out = [0] * len(elements)
    for e, x in values.items():
        out[e] = x
    for e in range(len(elements) - 1, 0, -1):
        out[elements[e].parent] += out[e]
    return out


def per_element(lines: list[Line], value) -> dict[int, int]:
    out: dict[int, int] = {}
    for x in lines:
        out[x.element] = out.get(x.element, 0) + value(x)
    return out


def spread(elements: list[Element], own: list[bool]) -> list[bool]:
    """For each element, whether it or an element around it is one of own."""
    out = list(own)
    for e in range(1, len(elements)):
        out[e] = own[e] or out[elements[e].parent]
    return out


def fill(page: Page, junk: list[bool]) -> None:
    """Puts the lines together from their runs outside junk elements; a line without any is junk itself."""
    for x in page.lines:
        kept = [r for r in x.runs if not junk[r[1]]]
        x.text = " ".join("".join(r[0] for r in kept).split())
        x.plain = max(0, len(x.text) - sum(len(r[0]) for r in kept if r[2]))
        x.junk = not x.text
        x.element = next((r[1] for r in kept if r[0].strip()), x.runs[0][1])


def density(lines: list[Line]) -> np.ndarray:
    return dense_lines(np.array([0 if x.junk else x.plain for x in lines], dtype=np.float64), np.array([x.tags for x in lines]))


def held_against_text(page: Page, fixed: list[bool]) -> list[bool]:
    """For each element, whether its name makes it boilerplate, also in view of what it holds."""
    elements = page.elements
    # first without what readers wrote, then all
    readers = [bool(e.marks & READERS) for e in elements]
    fill(page, spread(elements, [a or b for a, b in zip(fixed, readers)]))
    held = sums(elements, per_element(page.lines, lambda x: x.plain))
    fill(page, spread(elements, fixed))
    dense = density(page.lines)
    chars = sums(elements, per_element(page.lines, lambda x: len(x.text)))
    prose = sums(elements, per_element([x for x, on in zip(page.lines, dense) if on], lambda x: len(x.text)))
    in_articles = sums(elements, {e: held[e] for e, x in enumerate(elements) if x.tag in ARTICLES and not elements[x.parent].article})
    named = []
    for e, element in enumerate(elements):
        most = held[0] > 0 and held[e] >= NAME_SHARE * held[0] and element.marks <= VAGUE | LAYOUT and (element.article or in_articles[0] == in_articles[e])
        own = element.article and element.marks <= VAGUE - READERS and 2 * prose[e] >= chars[e] > 0
        named.append(bool(element.marks) and not (element.tag in BLOCK and (most or own)))
    return named


def settle(page: Page) -> None:
    """Decides which elements and lines of a page are boilerplate."""
    elements = page.elements
    fixed = [e.fixed for e in elements]
    named = held_against_text(page, fixed) if any(e.marks for e in elements) else [False] * len(elements)
    fill(page, spread(elements, fixed))
    # a form goes unless it holds the page's text, that of its labels not counted
    label = spread(elements, [e.tag in ("label", "legend") for e in elements])
    text = per_element([x for x in page.lines if not label[x.element]], lambda x: x.plain)
    of_form, whole = sums(elements, text), sum(text.values())
    forms = [False] * len(elements) if not any(e.tag == "form" for e in elements) else [e.tag == "form" and not (whole > 0 and of_form[i] >= FORM_SHARE * whole) for i, e in enumerate(elements)]
    for own in ([a or b or c for a, b, c in zip(fixed, named, forms)], [a or b for a, b in zip(fixed, forms)]):
        junk = spread(elements, own)
        fill(page, junk)
        if any(not x.junk for x in page.lines):
            break
    for e, on in zip(elements, junk):
        e.junk = on


def inside(elements: list[Element], top: int) -> list[bool]:
    """For each element, whether it is top or in it."""
    out = [False] * len(elements)
    for e in range(top, len(elements)):
        out[e] = e == top or e > top and out[elements[e].parent]
    return out


def region(elements: list[Element], dense: dict[int, int]) -> int:
    """The lowest article or main element with most of the dense text (characters by element), or else the lowest container that
    holds all of it."""
    held = sums(elements, dense)
    total = held[0]
    articles = [e for e, x in enumerate(held) if elements[e].tag in ARTICLES and x >= ARTICLE_SHARE * total]
    if articles:
        return articles[-1]
    e = max(k for k, x in enumerate(held) if x == total)
    while e and elements[e].tag not in CONTAINERS:
        e = elements[e].parent
    return e


def main_text(html: str) -> str:
    page = parsed(html)
    settle(page)
    elements, lines = page.elements, page.lines
    body = [x for x in lines if not x.junk]
    if not body:
        return ""
    dense = density(lines)
    cluster = [x for x, on in zip(lines, dense) if on]
    if not cluster:  # all text is in links
        return " ".join(x.text for x in body)
    top = region(elements, per_element(cluster, lambda x: len(x.text)))
    within = inside(elements, top)
    if not elements[top].article and top:
        # its title before it, and blocks of its kind beside it
        kind, around = elements[top], elements[top].parent
        telling = bool(kind.name) or kind.tag == "section"
        for e, other in enumerate(elements[1:], 1):
            alike = telling and (other.tag, other.name) == (kind.tag, kind.name) or e < top and other.tag in HEADINGS
            within[e] = within[e] or within[other.parent] or other.parent == around and alike
    if not elements[top].article:
        # containers of links alone, and lists of links before the text begins
        chars, plain, solid = (sums(elements, per_element(some, v)) for some, v in ((body, lambda x: len(x.text)), (body, lambda x: x.plain), (cluster, lambda x: 1)))
        begin, listed = cluster[0].element, [False] * len(elements)
        for e in range(1, len(elements)):
            linked = chars[e] > 0 and plain[e] <= (1 - LINK_SHARE) * chars[e] and not solid[e]
            block = elements[e].tag in CONTAINERS or e < begin and elements[e].tag in BLOCK
            listed[e] = listed[elements[e].parent] or linked and block and e != top
        body = [x for x in body if not listed[x.element]]
    return " ".join(x.text for x in body if within[x.element])


def extract(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text, n_chars (code points).

    pages has page_id, url and html; other columns are ignored. A null html counts as empty and gives an empty text, and so
    does a page of boilerplate elements alone; where only names call all of it boilerplate, they do not count. Boilerplate within
    a line (buttons, hidden or marked spans) goes, and the rest of the line stays. White space inside a block is one space, blocks are joined by one space in page order.
    Repeated rows are extracted each. Time and memory are linear in a page's tags, however deep they are nested.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                text = [main_text(x.as_py() or "") for x in part.column(2)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(text, pa.string()), pa.array([len(x) for x in text], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return columns(pages, "page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
