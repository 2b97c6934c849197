"""Main text of web pages: parser events, text-to-tag ratios, Gaussian smoothing and threshold clustering.

The standard library's streaming parser turns a page into lines: the text between two tags that begin or end a
block.  A line's ratio is its text outside links by the tags met since the line before; lines in menus,
footers, forms and the like have none.  The ratios are smoothed, as content comes in runs, and split by
two-means clustering.  Lines above the split select the content region: the article that holds most of their
text, or else the innermost element that does; short lines of that region belong to it, dense lines elsewhere
do not.

A page is a row of its own: nothing is shuffled, and a task holds one batch of pages at a time.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from html.parser import HTMLParser
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import mapped

#: Width of the smoothing, in lines.
SIGMA = 1.0
#: Share of the selected text that an element must hold to be the content region, and that an article or main element must hold.
SHARE, ARTICLE_SHARE = 0.6, 0.25

# Elements without an end, elements that begin or end a line, elements whose content is no text,
# elements that are no main text wherever they stand.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split())
SILENT = frozenset("button canvas datalist head iframe math noframes noscript object optgroup option script select style svg template textarea title".split())
BOILERPLATE = frozenset("aside dialog footer form menu nav".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Words of class, id and role that mark boilerplate anywhere, and those that do so outside articles only.
MARKS = frozenset("ad ads adbox advert advertisement advertising adverts sponsor sponsored promo promotion cookie cookies consent gdpr notice newsletter subscribe subscription popup modal overlay sidebar aside nav navbar navigation menu breadcrumb breadcrumbs pagination pager footer comment comments disqus respond reply replies share sharing social related recommended recommendations".split())
OUTER_MARKS = frozenset("header masthead banner topbar toolbar alert search login signup widget contentinfo complementary".split())
#: Of elements that close an open one of the same kind: what they close, and what bounds them.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"})}


class Node(NamedTuple):
    """An open element: its place in the tree, whether its text is boilerplate and whether an article inside takes that back, whether it lies in an article."""

    tag: str
    number: int
    parent: int
    out: bool
    soft: bool
    article: bool
    silent: bool


class Line(NamedTuple):
    text: str
    plain: int
    tags: int
    out: bool
    node: int


def marked(attrs: list[tuple[str, str | None]], article: bool) -> bool:
    """Whether a word of class, id or role says that the element is boilerplate; words after ``no``, ``has`` or ``with`` say nothing."""
    for name, value in attrs:
        if name == "hidden":
            return True
        if name in ("class", "id", "role") and value:
            for item in value.lower().split():
                for w in item.replace("_", "-").split("-"):
                    if w in ("no", "has", "with", "without"):
                        break
                    if w in MARKS or (not article and w in OUTER_MARKS):
                        return True
    return False


class Lines(HTMLParser):
    """Collects the lines of one page and the tree of the elements that hold them."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open = [Node("", 0, -1, False, False, False, False)]
        self.parents, self.tags_of = [-1], [""]
        self.lines: list[Line] = []
        self.parts: list[str] = []
        self.plain = self.tags = self.links = 0

    def updatepos(self, i: int, j: int) -> int:
        """Positions in lines aren't asked for, so they aren't counted."""
        return j

    def line_ends(self) -> None:
        if not self.parts:
            return
        text = " ".join("".join(self.parts).split())
        if text:
            at = self.open[-1]
            self.lines.append(Line(text, min(self.plain, len(text)), max(1, self.tags), at.out, at.number))
            self.tags = 0
        self.parts, self.plain = [], 0

    def leave(self, k: int) -> None:
        """Closes the open elements from the k-th on."""
        for n in self.open[k:]:
            if n.tag in BLOCK:
                self.line_ends()
            elif n.tag == "a":
                self.links -= 1
        del self.open[k:]

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.tags += 1
        if tag in VOID:
            if tag == "hr":
                self.line_ends()
            elif tag == "br":
                self.parts.append(" ")
            return
        if tag in BLOCK:
            self.line_ends()
            if tag in CLOSES:
                closed, bounds = CLOSES[tag]
                k = next((k for k in range(len(self.open) - 1, 0, -1) if self.open[k].tag in closed or self.open[k].tag in bounds), 0)
                while k and self.open[k].tag in closed:
                    self.leave(k)
                    k -= 1
            k = len(self.open) - 1
            while self.open[k].tag not in BLOCK and k:
                k -= 1
            if self.open[k].tag == "p":  # a block ends an open paragraph
                self.leave(k)
        at = self.open[-1]
        root = tag in ("article", "main")
        nested = tag == "article" and at.article  # an article inside another one is a comment on it
        own = tag in BOILERPLATE or (tag == "header" and not at.article) or nested or (bool(attrs) and tag not in ("html", "body", "main") and marked(attrs, at.article or root))
        # a wrapper's class says less than an article inside it, but nothing in comments is an article
        out = own or (at.out and not (root and at.soft and not nested))
        soft = (at.soft or not at.out) and tag not in ("nav", "footer", "aside", "menu", "article", "dialog") if out else False
        self.parents.append(at.number)
        self.tags_of.append(tag)
        self.open.append(Node(tag, len(self.parents) - 1, at.number, out, soft, at.article or tag == "article", at.silent or tag in SILENT))
        self.links += tag == "a"

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        k, inline = len(self.open) - 1, tag not in BLOCK
        while k and self.open[k].tag != tag:
            if inline and self.open[k].tag in BLOCK:  # an inline end tag reaches no further than its block
                return
            k -= 1
        if k:
            self.leave(k)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def handle_data(self, data: str) -> None:
        if not self.open[-1].silent:
            self.parts.append(data)
            if not self.links:
                self.plain += len(data.strip())


def page_lines(html: str) -> tuple[list[Line], list[int], list[str]]:
    """The lines of a page, and of each element the number of its parent and its tag."""
    p = Lines()
    p.feed(html)
    p.close()
    p.line_ends()
    return p.lines, p.parents, p.tags_of


def smoothed(ratios: list[float], sigma: float = SIGMA) -> list[float]:
    """``ratios`` by a normal kernel of three sigma; beyond the page's ends they are 0."""
    r = max(1, math.ceil(3 * sigma))
    w = [math.exp(-k * k / (2 * sigma * sigma)) for k in range(-r, r + 1)]
    total, padded = sum(w), [0.0] * r + ratios + [0.0] * r
    return [sum(a * b for a, b in zip(w, padded[i : i + 2 * r + 1], strict=True)) / total for i in range(len(ratios))]


def dense(values: list[float]) -> list[bool]:
    """Two-means clustering of numbers, begun at the least and the greatest: which are of the upper cluster; all that are positive where they don't differ."""
    low, high = min(values, default=0.0), max(values, default=0.0)
    if high <= low:
        return [v > 0 for v in values]
    for _ in range(100):
        cut = (low + high) / 2
        up = [v for v in values if v > cut]
        down = [v for v in values if v <= cut]
        at = (sum(down) / len(down), sum(up) / len(up))
        if at == (low, high):
            break
        low, high = at
    return [v > (low + high) / 2 for v in values]


def region(lines: list[Line], selected: list[bool], parents: list[int], tags: list[str]) -> int | None:
    """The element that is the content region, or None without selected text.

    The article, or else the main element, with most of the selected text, if it holds ``ARTICLE_SHARE`` of it;
    where none does, the innermost element that holds ``SHARE``.
    """
    mass = [0] * len(parents)
    for x, s in zip(lines, selected, strict=True):
        if s and not x.out:
            mass[x.node] += x.plain
    for k in range(len(parents) - 1, 0, -1):  # children come after their parents
        mass[parents[k]] += mass[k]
    if not mass[0]:
        return None
    need = SHARE * mass[0]
    for kind in ("article", "main"):
        best = max((k for k in range(len(tags)) if tags[k] == kind), key=lambda k: (mass[k], -k), default=0)
        if best and mass[best] >= ARTICLE_SHARE * mass[0]:
            return best
    return max(k for k in range(len(parents)) if mass[k] >= need and (k == 0 or tags[k] in BLOCK and tags[k] not in ("p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "pre", "td", "th", "dd", "dt", "blockquote")))


def main_text(html: str | None) -> tuple[str, int, int]:
    """(text, lines in it, lines of the page)."""
    if not html:
        return "", 0, 0
    lines, parents, tags = page_lines(html)
    ratios = [0.0 if x.out else x.plain / x.tags for x in lines]
    found = region(lines, dense(smoothed(ratios)), parents, tags)
    root = found or 0  # no line stands out where all text is links: then what isn't boilerplate
    menus = found is not None and tags[root] not in ("article", "main")  # without an article, lines that are mostly links are menus
    inside = [False] * len(parents)
    for k in range(len(parents)):
        inside[k] = k == root or (k > 0 and inside[parents[k]])
    kept = [x.text for x in lines if inside[x.node] and not x.out and (4 * x.plain >= len(x.text) or not menus or tags[x.node] in HEADINGS)]
    return "\n".join(kept), len(kept), len(lines)


#: The columns that ``extract`` adds.
ADDED = ("text", "n_chars", "n_blocks", "n_lines")


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """``pages`` without ``html_col`` and with the main ``text``, its code points ``n_chars``, its blocks and the page's lines.

    White space inside a block is one blank; blocks are joined by line ends in page order.  A null or empty page,
    one without markup's text and one of boilerplate alone have the text "".  A page without any tag is one
    block.  Null ids and repeated pages are rows like others; input columns named like those added (in any
    case of letters) are replaced.  An empty table gives no rows.
    """
    kept = [f for f in pages.schema.fields if f.name != html_col and f.name.lower() not in ADDED]
    schema = StructType([*kept, StructField("text", StringType()), *(StructField(n, LongType()) for n in ADDED[1:])])
    names = [f.name for f in kept]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            found = [main_text(x) for x in b.column(len(names)).to_pylist()]
            n = [pa.array(v, pa.int64()) for v in ([len(t) for t, _, _ in found], [k for _, k, _ in found], [k for _, _, k in found])]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(names))), pa.array([t for t, _, _ in found], pa.string()), *n], names=[*names, *ADDED])

    return mapped(pages.select(*(pages[f"`{c}`"] for c in names), pages[f"`{html_col}`"].alias("_html")), run, schema)
