"""Web pages as trees in intervals: an element's subtree is the range ``ord`` to ``last`` of its page.

The walk is the one step in Python (``mapInArrow``, a page at a time). Each row has its own pieces of
text with their place on the page; what stands below an element is gathered by joins.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .derived import spread
from .pages import SECTIONING, SKIPPED, VOID

# Tags that flow with the text around them; levels below an element that still name it.
INLINE = [
    "a", "abbr", "b", "bdi", "bdo", "cite", "code", "data", "dfn", "em", "i", "kbd", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strong",
    "sub", "sup", "time", "u", "var", "wbr",
]
NAME_DEPTH = 12
# Tags whose start ends an open element, and what keeps that element open.
_ROWS, _CELLS, _ITEMS = ["thead", "tbody", "tfoot"], ["td", "th"], ["dt", "dd"]
_P_ENDS = [
    "address", "article", "aside", "blockquote", "details", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6",
    "header", "hr", "main", "menu", "nav", "ol", "p", "pre", "search", "section", "table", "ul",
]
ENDS = {
    "li": (["li"], ["ul", "ol", "menu"]), "option": (["option"], ["select", "datalist", "optgroup"]), "optgroup": (["option", "optgroup"], ["select"]),
    "tr": (["tr"], ["table", *_ROWS]), **dict.fromkeys(_ITEMS, (_ITEMS, ["dl"])), **dict.fromkeys(_CELLS, (_CELLS, ["tr", "table"])), **dict.fromkeys(_ROWS, (_ROWS, ["table"])),
    **dict.fromkeys(_P_ENDS, (["p"], ["button", "td", "th", "caption", "table", "object"])),
}

SCHEMA = (
    "page_id long, ord int, last int, depth int, tag string, attrs map<string,string>, own_text string, in_section boolean, gone boolean, barred boolean, "
    "up array<int>, pieces array<struct<pos:int,said:boolean,body:string,block:int,veil:int>>"
)
_PIECES = pa.list_(pa.struct([("pos", pa.int32()), ("said", pa.bool_()), ("body", pa.string()), ("block", pa.int32()), ("veil", pa.int32())]))
_KINDS = [
    pa.int64(), *[pa.int32()] * 3, pa.string(), pa.map_(pa.string(), pa.string()), pa.string(), *[pa.bool_()] * 3, pa.list_(pa.int32()), _PIECES,
]
_NAMES = ["page_id", "ord", "last", "depth", "tag", "attrs", "own_text", "in_section", "gone", "barred", "up", "pieces"]


class _Node:
    __slots__ = ("attrs", "barred", "block", "depth", "gone", "in_section", "last", "ord", "pieces", "tag", "up", "veil")


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.nodes: list[_Node] = []
        self.open: list[_Node] = []
        self.skipped: list[str] = []
        self.pos = 0

    def _close(self, depth: int) -> None:
        for n in self.open[depth:]:
            n.last = len(self.nodes) - 1
        del self.open[depth:]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        # a title below body belongs to a drawing and names it
        if self.skipped or (tag in SKIPPED and not (tag == "title" and self.open)):
            if tag not in VOID:
                self.skipped.append(tag)
            return
        ended, kept = ENDS.get(tag, ((), ()))
        if ended:
            at = None
            for k in range(len(self.open) - 1, -1, -1):
                if self.open[k].tag in kept:
                    break
                if self.open[k].tag in ended:
                    at = k
            if at is not None:
                self._close(at)
        up = self.open[-1] if self.open else None
        n = _Node()
        n.ord = n.last = len(self.nodes)
        n.tag, n.depth, n.pieces = tag, len(self.open), []
        n.attrs = {k: v or "" for k, v in reversed(attrs)}
        style = "".join(n.attrs.get("style", "").lower().split())
        n.gone = bool(up and up.gone) or "hidden" in n.attrs or "display:none" in style or "visibility:hidden" in style
        n.in_section = bool(up and (up.in_section or up.tag in SECTIONING))
        n.barred = bool(up and up.barred) or (tag == "fieldset" and "disabled" in n.attrs)
        n.up = [*(up.up[-NAME_DEPTH:] if up else []), n.ord]
        n.block = n.ord if tag not in INLINE else (up.block if up else -1)
        n.veil = n.ord if n.attrs.get("aria-hidden") == "true" else (up.veil if up else -1)
        if up and n.veil != n.ord:
            # what has no text of its own below it but is read in a name
            if tag == "br":
                self._piece(" ", False)
            elif tag == "img" and n.attrs.get("alt"):
                self._piece(f" {n.attrs['alt']} ", False)
            elif tag == "input" and n.attrs.get("type", "text").lower() in ("submit", "button", "reset"):
                self._piece(f" {n.attrs.get('value', '')} ", False)
        self.nodes.append(n)
        if tag not in VOID:
            self.open.append(n)

    def handle_endtag(self, tag: str) -> None:
        if self.skipped:
            if tag in self.skipped:
                while self.skipped.pop() != tag:
                    pass
            return
        at = next((k for k in range(len(self.open) - 1, -1, -1) if self.open[k].tag == tag), None)
        if at is not None:
            self._close(at)

    def _piece(self, body: str, said: bool) -> None:
        own = self.open[-1]
        own.pieces.append((self.pos, said, body, own.block, own.veil))
        self.pos += 1

    def handle_data(self, data: str) -> None:
        if data and self.open and not self.skipped:
            self._piece(data, True)


def _walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for page, html in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            t = _Tree()
            t.feed(html or "")
            t.close()
            t._close(0)
            rows = [
                (page, n.ord, n.last, n.depth, n.tag, list(n.attrs.items()), "".join(p[2] for p in n.pieces if p[1]), n.in_section, n.gone or n.veil >= 0, n.barred, n.up,
                 [dict(zip(("pos", "said", "body", "block", "veil"), p, strict=True)) for p in n.pieces])
                for n in t.nodes
            ]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), _KINDS, strict=True)], names=_NAMES)


def trees(pages: DataFrame) -> DataFrame:
    """One row an element of ``pages`` (page_id, html): its range, attributes, pieces of text, and the
    elements above it that it may name (``up``, itself last). A null or empty page has none."""
    return spread(pages.select("page_id", "html")).mapInArrow(_walked, SCHEMA)


def inside(points: DataFrame, ranges: DataFrame) -> DataFrame:
    """(page_id, at, ord, last): each point (page_id, at) with each range (page_id, ord, last) of its
    page that holds it.

    A range is cut into the aligned blocks of 2^k places that make it up, two a level at most; a point
    lies in one block a level. So it is a join on equal keys: of each true pair one row, of no other pair any,
    and rows grow with n log n however deep or wide a page is.
    """
    lo, hi = "shiftright(ord + shiftleft(1, k) - 1, k)", "shiftright(last + 1, k)"
    level = f"array(if({lo} < {hi} and {lo} % 2 = 1, named_struct('level', k, 'block', {lo}), null), if({lo} < {hi} and {hi} % 2 = 1, named_struct('level', k, 'block', {hi} - 1), null))"
    cut = ranges.where("ord <= last").select("page_id", "ord", "last", F.explode(F.expr(f"array_compact(flatten(transform(sequence(0, length(bin(last + 1)) - 1), k -> {level})))")).alias("b"))
    # a point is filed up to the highest level that a range of its page has, and not at all on a page without ranges
    top = cut.groupBy("page_id").agg(F.max("b.level").alias("top"))
    held = points.join(top, "page_id").select("page_id", "at", F.explode(F.expr("transform(sequence(0, top), k -> named_struct('level', k, 'block', shiftright(at, k)))")).alias("b"))
    return held.join(cut, ["page_id", "b"]).select("page_id", "at", "ord", "last")
