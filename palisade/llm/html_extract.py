"""Main text of web pages by nearest-URL differencing, guarded by markup.

A page's blocks are its lines. Pages stand in order of host and URL path; each is
paired with that neighbour of its host whose path shares the longer prefix and that has
other content: where a neighbour has all but a twentieth of the page's text, it is a copy
and the other neighbour is taken. The lines of the two are aligned by a longest common
subsequence (bit-parallel), and lines that both have are deleted.

Differencing alone is wrong at both ends: menus and adverts that change from page to
page differ from the neighbour's, and different articles can quote the same passage. So
markup has a say where it is plain. Lines within navigation, footers, forms and the like,
and outside of articles within blocks whose class or id names such a thing, never stay.
Within an article element names count on sections alone, and its lines aren't deleted for
being shared: articles quote one another, and repeat lines that belong to them. All other
lines stand or fall by the difference, also those within ``main``. A page without a
neighbour is left to markup.

Only hashes of lines travel to the neighbour. The ranks that pair pages come from range
partitions, so a host with a third of all pages is ranked by many tasks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from os.path import commonprefix
from urllib.parse import urlsplit

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, small_batches, written
from .sharding import positions

_TOKEN = re.compile(r"""<!--.*?(?:--!?>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)(?:>|\Z)""", re.S)
_ATTR = re.compile(r"""([^\s=/"'>]+)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
#: Their content is text that isn't parsed and isn't shown.
_RAW = frozenset("script style noscript template textarea title iframe noembed noframes xmp".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol option p pre search section select summary table tbody tfoot thead tr ul".split()
)
_BOILERPLATE = frozenset("nav footer aside form head button select option menu dialog search svg math object audio video canvas map datalist".split())
_ROLES = frozenset("navigation banner contentinfo complementary search menu menubar dialog alert alertdialog form toolbar tablist".split())
#: Parts of class names and ids that mark what isn't the article.
_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notification alert "
    "sidebar widget menu nav navbar navigation breadcrumb breadcrumbs pagination pager footer masthead topbar toolbar comment comments disqus respond reply "
    "share sharing social related recommended newsletter subscribe subscription signup login popup modal overlay paywall skip".split()
)
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that a class or id can mark as no part of an article that they stand in.
_SECTIONS = frozenset("div section ul ol dl table figure article details".split())
#: Flags of a line: it goes, differencing decides, it stands in an article and stays.
DROPPED, OPEN, ARTICLE = 0, 1, 2


def _marks(attrs: str) -> tuple[set[str], str, bool]:
    """Parts of class and id, role, hidden."""
    names: set[str] = set()
    role, hidden = "", False
    for m in _ATTR.finditer(attrs):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name in ("class", "id"):
            names.update(re.split(r"[\s_\-]+", value.lower()))
        elif name == "role":
            role = value.strip().lower()
        elif name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            hidden = True
    return names, role, hidden


def lines_of(html: str) -> list[tuple[str, int]]:
    """(text, flag) of the page's blocks in order, empty ones left out."""
    out: list[tuple[str, int]] = []
    text: list[str] = []
    stack: list[tuple[str, int]] = []  # (tag, flag of what is inside)
    flag, articles = OPEN, 0

    def end() -> None:
        if text:
            if line := " ".join(unescape("".join(text)).split()):
                out.append((line, flag))
            text.clear()

    at, n = 0, len(html)
    while at < n:
        m = _TOKEN.search(html, at)
        if m is None:
            text.append(html[at:])
            break
        if m.start() > at:
            text.append(html[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag, closing = m[2].lower(), m[1] == "/"
        if tag == "br":
            text.append(" ")
            continue
        if tag in ("td", "th"):
            text.append(" ")
        if closing:
            depth = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == tag), -1)
            if tag in _BLOCKS:
                end()
            if depth >= 0:
                # an inline end tag doesn't close the blocks around it
                if tag in _BLOCKS or not any(t in _BLOCKS for t, _ in stack[depth:]):
                    if any(f != flag for _, f in stack[depth:]) or (stack[depth - 1][1] if depth else OPEN) != flag:
                        end()
                    del stack[depth:]
                    flag = stack[-1][1] if stack else OPEN
            continue
        if tag in _RAW:
            if not m[3].rstrip().endswith("/"):
                close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(html, at)
                at = close.end() if close else n
            continue
        names, role, hidden = _marks(m[3]) if m[3] else (set(), "", False)
        if tag in _BLOCKS:
            end()
            if stack and stack[-1][0] == "p":  # a block ends an open paragraph
                stack.pop()
                flag = stack[-1][1] if stack else OPEN
        if tag in _VOID:
            continue
        inside, article = flag, tag == "article" or role == "article"
        if flag != DROPPED:
            # the page's first article is one whatever it is called; later ones can be readers' comments
            named = bool(names & _NAMES) and not (article and not articles) and (flag == OPEN and tag not in ("main", "body", "html") or tag in _SECTIONS)
            if tag in _BOILERPLATE or hidden or role in _ROLES or named or tag == "header" and flag == OPEN:
                inside = DROPPED
            elif article:
                inside, articles = ARTICLE, articles + 1
        elif tag in _HEADINGS and len(stack) > 1 and stack[-1][0] == "header" and stack[-2][1] == ARTICLE and not (names & _NAMES or hidden):
            inside = ARTICLE  # an article's own title within its header
        if inside != flag:
            end()
        stack.append((tag, inside))
        flag = inside
    end()
    return out


def aligned(a: list[int], b: list[int]) -> list[int]:
    """The places in ``a`` of a longest common subsequence of a and b."""
    where: dict[int, int] = {}
    for j, y in enumerate(b):
        where[y] = where.get(y, 0) | 1 << j
    full = (1 << len(b)) - 1
    v, rows = full, []
    for x in a:
        u = v & where.get(x, 0)
        v = ((v + u) | (v - u)) & full
        rows.append(v)
    out, i, j = [], len(a), len(b)
    while i and j:
        if rows[i - 1] >> (j - 1) & 1:
            j -= 1
        else:
            i -= 1
            if i and not rows[i - 1] >> (j - 1) & 1:
                continue
            out.append(i)
            j -= 1
    return out[::-1]


def place_of(url: str | None) -> tuple[str | None, str]:
    """(host, path) of a URL; no host if there is none."""
    try:
        parts = urlsplit(url or "")
        return parts.hostname or None, parts.path
    except ValueError:
        return None, ""


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, host, path and by line: hashes, flags, sizes."""
    for b in batches:
        found = [lines_of(h or "") for h in b.column(2).to_pylist()]
        places = [place_of(u) for u in b.column(1).to_pylist()]
        hashes = [[xxhash.xxh64_intdigest(t.encode("utf-8", "surrogatepass")) - (1 << 63) for t, _ in x] for x in found]
        yield pa.RecordBatch.from_arrays([
            b.column(0), pa.array([h for h, _ in places], pa.string()), pa.array([p for _, p in places], pa.string()), pa.array(hashes, pa.list_(pa.int64())),
            pa.array([[f for _, f in x] for x in found], pa.list_(pa.int32())), pa.array([[len(t) for t, _ in x] for x in found], pa.list_(pa.int32())),
        ], names=["key", "host", "path", "hashes", "flags", "sizes"])


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, id, url, and the lines that markup leaves with their places."""
    for b in batches:
        found = [[(k, t) for k, (t, f) in enumerate(lines_of(h or "")) if f != DROPPED] for h in b.column(2).to_pylist()]
        cols = [b.column(0), b.column(3), b.column(1), pa.array([[k for k, _ in x] for x in found], pa.list_(pa.int32())), pa.array([[t for _, t in x] for x in found], pa.list_(pa.string()))]
        yield pa.RecordBatch.from_arrays(cols, names=["key", "id", "url", "places", "lines"])


def deleted(hashes: list[int], flags: list[int], sizes: list[int], neighbours: list[list[int]]) -> list[int]:
    """The places of the lines that go because the nearest neighbour with other content has them,
    too. neighbours: the hashes of their lines, nearest first."""
    left = [k for k, f in enumerate(flags) if f != DROPPED]
    for other in neighbours:
        both = set(aligned(hashes, other))
        if 20 * sum(sizes[k] for k in left if k not in both) < sum(sizes[k] for k in left):
            continue  # a copy
        return sorted(k for k in both if flags[k] == OPEN)
    return []


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, gone: places of lines to delete, for pages that have any."""
    for b in batches:
        keys, gone = [], []
        for r in b.to_pylist():
            near = [(len(commonprefix([r["path"], r[f"{s}_path"]])), s == "prev", r[f"{s}_hashes"]) for s in ("prev", "next") if r[f"{s}_hashes"] is not None]
            both = deleted(r["hashes"], r["flags"], r["sizes"], [x[2] for x in sorted(near, key=lambda x: x[:2], reverse=True)])
            if both:
                keys.append(r["key"])
                gone.append(both)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(gone, pa.list_(pa.int32()))], names=["key", "gone"])


def deletions(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """key (hash of id, URL and page), gone: the places of the lines that differencing deletes."""
    own = pages.select(F.xxhash64(id_col, url_col, html_col).alias("key"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    # written, or the sampling of ranges would parse all pages once more
    light = written(map_batches(own, _parsed, "key long, host string, path string, hashes array<long>, flags array<int>, sizes array<int>"), "page-lines")
    ranked = written(positions(light.where("host is not null"), ["host", "path", "key"]), "pages")
    there = lambda by, side: ranked.select(
        (F.col("pos") + by).alias("pos"), F.col("host").alias(f"{side}_host"), F.col("path").alias(f"{side}_path"), F.col("hashes").alias(f"{side}_hashes")
    )
    both = ranked.join(there(1, "prev"), "pos", "left").join(there(-1, "next"), "pos", "left")
    same = lambda side, c: F.when(F.col(f"{side}_host") == F.col("host"), F.col(f"{side}_{c}")).alias(f"{side}_{c}")
    both = both.select("key", "path", "hashes", "flags", "sizes", *[same(s, c) for s in ("prev", "next") for c in ("path", "hashes")])
    return written(map_batches(both, _shared, "key long, gone array<int>").dropDuplicates(["key"]), "page-deletions")


def extracted(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of ``pages``: id_col, url_col, text (its lines joined by two
    newlines; empty if none), n_chars.

    A null page is empty. A page without a host in its URL has no neighbour, nor has
    the only page of a host or one between copies of itself; then markup alone decides. Equal
    rows get equal texts. An empty table gives no rows.
    """
    small_batches(pages.sparkSession)
    gone = deletions(pages, id_col, url_col, html_col)
    kind = dict(pages.dtypes)[id_col]
    own = pages.select(F.xxhash64(id_col, url_col, html_col).alias("key"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), F.col(id_col).alias("id"))
    lines = map_batches(own, _texts, f"key long, id {kind}, url string, places array<int>, lines array<string>")
    joined = lines.join(gone, "key", "left")
    kept = F.filter(F.arrays_zip("places", "lines"), lambda x: ~F.array_contains("gone", x["places"]))
    text = F.array_join(F.when(F.col("gone").isNull(), F.col("lines")).otherwise(F.transform(kept, lambda x: x["lines"])), "\n\n")
    return joined.select(F.col("id").alias(id_col), F.col("url").alias(url_col), text.alias("text"), F.length(text).cast("long").alias("n_chars"))
