"""Web pages as element tables: one row an element, in document order.

The walk over a page's markup is the one step that needs Python; it runs batch by batch in
``mapInArrow``. Roles, names, visibility and what is worth a row are columns afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .derived import spread

# Subtrees that hold nothing visible, tags that end no subtree, and tags that paint pixels.
SKIPPED = ["script", "style", "noscript", "template", "meta", "link", "title", "head", "base"]
VOID = ["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"]
IMAGE_TAGS = ["img", "canvas", "svg", "video", "picture", "object", "embed", "iframe", "math"]
# Most rows of a page, and characters of a text and of a name.
NODE_CAP, TEXT_CAP, NAME_CAP = 1500, 400, 300
# The role of a tag, and of an input by its type.
TAG_ROLES = {
    "article": "article", "aside": "complementary", "blockquote": "blockquote", "button": "button", "caption": "caption", "dd": "definition", "dfn": "term",
    "dialog": "dialog", "dl": "list", "dt": "term", "fieldset": "group", "figure": "figure", "form": "form", "h1": "heading", "h2": "heading", "h3": "heading",
    "h4": "heading", "h5": "heading", "h6": "heading", "hr": "separator", "li": "listitem", "main": "main", "math": "math", "menu": "list", "meter": "meter",
    "nav": "navigation", "ol": "list", "optgroup": "group", "option": "option", "output": "status", "p": "paragraph", "progress": "progressbar", "search": "search",
    "summary": "button", "table": "table", "tbody": "rowgroup", "td": "cell", "textarea": "textbox", "tfoot": "rowgroup", "th": "columnheader", "thead": "rowgroup",
    "tr": "row", "ul": "list",
}
INPUT_ROLES = {
    "button": "button", "checkbox": "checkbox", "color": "textbox", "date": "textbox", "datetime-local": "textbox", "email": "textbox", "file": "button",
    "image": "button", "month": "textbox", "number": "spinbutton", "password": "textbox", "radio": "radio", "range": "slider", "reset": "button",
    "search": "searchbox", "submit": "button", "tel": "textbox", "text": "textbox", "time": "textbox", "url": "textbox", "week": "textbox",
}
# Roles that can be operated, that take their name from their content, and that are kept for what they say.
INTERACTIVE = [
    "button", "checkbox", "combobox", "link", "listbox", "menuitem", "menuitemcheckbox", "menuitemradio", "option", "radio", "searchbox", "slider",
    "spinbutton", "switch", "tab", "textbox", "treeitem",
]
NAME_FROM_CONTENT = [
    "button", "cell", "checkbox", "columnheader", "gridcell", "heading", "link", "menuitem", "menuitemcheckbox", "menuitemradio", "option", "radio", "row",
    "rowheader", "switch", "tab", "tooltip", "treeitem",
]
INFORMATIVE = [
    "heading", "main", "navigation", "banner", "contentinfo", "complementary", "region", "form", "search", "table", "row", "cell", "columnheader", "rowheader",
    "list", "listitem", "article", "dialog", "alert", "status", "img",
]
TEXT_ENTRY = ["textbox", "searchbox", "combobox"]
SECTIONING = ["article", "aside", "main", "nav", "section"]

_SCHEMA = (
    "page_id long, ord int, parent int, depth int, tag string, attrs map<string,string>, own_text string, all_text string, hidden_above boolean, in_section boolean, label_of string"
)


class _Walker(HTMLParser):
    """Elements in order, with their own text and all text below."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows: list[list] = []
        self.open: list[int] = []
        self.said: list[int] = []  # of each row, characters of all its text but white space
        self.skipped: list[str] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if self.skipped or tag in SKIPPED:
            if tag not in VOID:
                self.skipped.append(tag)
            return
        if tag == "p" or tag in ("li", "option", "tr", "td", "th"):
            self._close_like(tag)
        own = {k: v or "" for k, v in attrs}
        up = self.rows[self.open[-1]] if self.open else None
        hidden = own.get("aria-hidden") == "true" or "hidden" in own
        self.said.append(0)
        row = [len(self.rows), self.open[-1] if self.open else None, len(self.open), tag, own, [], [], bool(up and (up[7] or up[9])), bool(up and (up[8] or up[3] in SECTIONING)), hidden]
        self.rows.append(row)
        if tag not in VOID:
            self.open.append(row[0])
        elif tag == "br":
            self._text(" ")

    def _close_like(self, tag: str) -> None:
        if self.open and self.rows[self.open[-1]][3] == tag:
            self.open.pop()

    def handle_endtag(self, tag: str) -> None:
        if self.skipped:
            if tag in self.skipped:
                while self.skipped.pop() != tag:
                    pass
            return
        at = next((k for k in range(len(self.open) - 1, -1, -1) if self.rows[self.open[k]][3] == tag), None)
        if at is not None:
            del self.open[at:]

    def _text(self, data: str) -> None:
        if self.open:
            self.rows[self.open[-1]][5].append(data)
        more = len("".join(data.split()))
        # ancestors have at least what stands below them, so the first that has enough ends the climb
        for k in reversed(self.open):
            if self.said[k] >= TEXT_CAP:
                break
            self.rows[k][6].append(data)
            self.said[k] += more

    def handle_data(self, data: str) -> None:
        if not self.skipped:
            self._text(data)


def walk(html: str) -> list[tuple]:
    w = _Walker()
    w.feed(html)
    w.close()
    flat = lambda parts: " ".join("".join(parts).split())
    return [(r[0], r[1], r[2], r[3], list(r[4].items()), flat(r[5])[:TEXT_CAP], flat(r[6])[:TEXT_CAP], r[7] or r[9], r[8], r[4].get("for")) for r in w.rows]


def _walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.map_(pa.string(), pa.string()), pa.string(), pa.string(), pa.bool_(), pa.bool_(), pa.string()]
    for b in batches:
        for page, html in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            rows = [(page, *r) for r in walk(html or "")]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[c.split()[0] for c in _SCHEMA.split(", ") if " " in c])


def _map(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for p in values.items() for x in p])


def role() -> Column:
    """The author's role, first of a list, else the tag's."""
    a = lambda n: F.col("attrs")[n]
    has = lambda n: F.map_contains_key("attrs", n)
    kind = F.lower(F.coalesce(a("type"), F.lit("text")))
    implicit = (
        F.when(F.col("tag").isin("a", "area"), F.when(has("href"), "link").otherwise("generic"))
        .when(F.col("tag") == "input", F.when(has("list") & kind.isin("text", "search"), "combobox").otherwise(F.coalesce(F.element_at(_map(INPUT_ROLES), kind), F.lit("textbox"))))
        .when(F.col("tag") == "select", F.when(has("multiple") | (F.coalesce(F.expr("try_cast(attrs['size'] AS INT)"), F.lit(1)) > 1), "listbox").otherwise("combobox"))
        .when(F.col("tag") == "img", F.when(a("alt") == "", "presentation").otherwise("img"))
        .when(F.col("tag").isin("header", "footer"), F.when(F.col("in_section"), "generic").when(F.col("tag") == "header", "banner").otherwise("contentinfo"))
        .when(F.col("tag") == "section", F.when(has("aria-label") | has("aria-labelledby"), "region").otherwise("generic"))
        .otherwise(F.coalesce(F.element_at(_map(TAG_ROLES), F.col("tag")), F.lit("generic")))
    )
    said = F.lower(F.regexp_extract(F.trim(a("role")), r"\A\S+", 0))
    return F.when(F.coalesce(said, F.lit("")) != "", said).otherwise(implicit)


def elements(pages: DataFrame, structural: bool = True) -> DataFrame:
    """Element rows of ``pages`` (page_id, html) that are worth one: interactive, informative,
    painting, or with something to say; at most NODE_CAP a page, in document order."""
    a = lambda n: F.nullif(F.trim(F.col("attrs")[n]), F.lit(""))
    rows = spread(pages.select("page_id", "html")).mapInArrow(_walked, _SCHEMA).withColumn("role", role())
    label = rows.where("tag = 'label' and label_of is not null").groupBy("page_id", F.col("label_of").alias("__id")).agg(F.min_by("all_text", "ord").alias("label"))
    rows = rows.withColumn("__id", F.col("attrs")["id"]).join(label, ["page_id", "__id"], "left")
    content = F.when(F.col("role").isin(NAME_FROM_CONTENT), F.nullif(F.col("all_text"), F.lit("")))
    native = F.when(F.col("tag") == "img", a("alt")).when(F.col("tag") == "input", F.coalesce(F.nullif(F.col("label"), F.lit("")), F.when(F.lower(F.col("attrs")["type"]).isin("submit", "reset", "button"), a("value")), a("placeholder"))).otherwise(F.nullif(F.col("label"), F.lit("")))
    kind = F.lower(F.coalesce(F.col("attrs")["type"], F.lit("text")))
    rows = rows.withColumns({
        "name": F.substring(F.coalesce(a("aria-label"), native, content, a("title"), F.lit("")), 1, NAME_CAP), "interactive": F.col("role").isin(INTERACTIVE),
        "hidden": F.col("hidden_above") | ((F.col("tag") == "input") & (kind == "hidden")) | F.coalesce(F.regexp_like(F.col("attrs")["style"], F.lit(r"(?i)display:\s*none|visibility:\s*hidden")), F.lit(False)),
        "editable": F.col("role").isin(TEXT_ENTRY) & ~F.map_contains_key("attrs", "readonly") & ~F.map_contains_key("attrs", "disabled"), "disabled": F.map_contains_key("attrs", "disabled"),
        "paints": F.col("tag").isin(IMAGE_TAGS) | F.coalesce(F.regexp_like(F.col("attrs")["style"], F.lit(r"(?i)url\(")), F.lit(False)),
        "value": F.when(F.col("tag").isin("input", "textarea") & ~kind.isin("password", "file"), F.when(kind.isin("checkbox", "radio"), F.when(F.map_contains_key("attrs", "checked"), "checked").otherwise("unchecked")).otherwise(F.substring(F.col("attrs")["value"], 1, TEXT_CAP))),
    })
    said = (F.col("name") != "") | (F.col("own_text") != "")
    kept = rows.where(F.col("interactive") | F.col("role").isin(INFORMATIVE) | F.col("paints") | (F.lit(structural) & said))
    nth = F.row_number().over(Window.partitionBy("page_id").orderBy("ord"))
    return kept.withColumn("n", nth).where(F.col("n") <= NODE_CAP).drop("__id", "label", "label_of", "hidden_above")


def is_readable(url: Column) -> Column:
    return F.coalesce(F.lower(F.try_parse_url(url, F.lit("PROTOCOL"))).isin("http", "https"), F.lit(False))


def origin(url: Column) -> Column:
    """scheme://host[:port] of a web address, about:blank of anything else."""
    part = lambda n: F.lower(F.try_parse_url(url, F.lit(n)))
    port = F.regexp_extract(F.try_parse_url(url, F.lit("AUTHORITY")), r":([0-9]+)\z", 1)
    usual = (port == "") | ((part("PROTOCOL") == "http") & (port == "80")) | ((part("PROTOCOL") == "https") & (port == "443"))
    own = F.concat(part("PROTOCOL"), F.lit("://"), part("HOST"), F.when(usual, F.lit("")).otherwise(F.concat(F.lit(":"), port)))
    return F.when(is_readable(url) & part("HOST").isNotNull(), own).otherwise(F.lit("about:blank"))
