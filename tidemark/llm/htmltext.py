"""Main text of web pages: each page is differenced against the page with the nearest URL; page structure checks the outcome."""
from __future__ import annotations

import html
import os
import re
from collections.abc import Iterator
from hashlib import blake2b
from math import isqrt

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructField, StructType

from tidemark.llm.common import checkpointed
from tidemark.plans.ranges import in_ranges

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
#: Elements whose text is raw up to their own end tag.
RAW = frozenset("script style textarea title xmp noembed noframes iframe".split())
#: Elements that are no main text wherever they stand.
DROPPED = frozenset("head nav footer aside form script style noscript template button select option textarea title iframe object svg math canvas audio video dialog menu xmp noembed noframes datalist".split())
#: Words of a class, id or role that mark menus, headers, sidebars, notices, adverts, forms and reader comments.
MARKS = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo banner cookie cookies consent notice notices alert popup modal overlay newsletter subscribe subscription "
                  "nav navbar navigation menu breadcrumb breadcrumbs pagination pager footer header masthead topbar sidebar sidebars aside widget widgets related share sharing social toolbar "
                  "comment comments discussion replies respond disqus form login signup search contentinfo complementary".split())
#: Words that may stand beside a mark in one class, id or role ("site-footer", "comment-list"); with any other word
#: ("has-sidebar", "comments-open", "article-header") it marks nothing.
BESIDE = frozenset("site page main top bottom left right primary secondary global list box container wrapper wrap section area block bar item items link links slot unit inner form posts articles stories "
                   "thread reader readers user users button buttons icon icons text title wp".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main "
                   "menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul caption head title".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
MAIN = frozenset(("article", "main"))
#: An opening tag of the first kind ends an open element of the second.
_ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_END_P = BLOCKS - {"body", "html", "head", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "title", "optgroup", "option", "legend", "summary"}


def _marked(attributes: str) -> tuple[bool, bool]:
    """Whether a class, id or role is made of marks, and whether the element is hidden."""
    named = hidden = False
    for m in _ATTRIBUTE.finditer(attributes) if attributes else ():
        name = m[1].lower()
        if name in ("class", "id", "role"):
            for token in (m[2] or m[3] or m[4] or "").lower().split():
                words = {w for w in re.split(r"[-_:0-9]+", token) if w}
                named |= not MARKS.isdisjoint(words) and words <= MARKS | BESIDE
        hidden |= name == "hidden"
    return named, hidden


def page_lines(page: str) -> list[tuple[str, bool]]:
    """(line, sure) in page order, as `_lines` has them; where every article or main element stands in an element that
    its class, id or role marks, that element is a frame of the page and no boilerplate."""
    lines = _lines(page, False)
    return lines if any(sure for _, sure in lines) else _lines(page, True)


def _lines(page: str, frames: bool) -> list[tuple[str, bool]]:
    """(line, sure) in page order: blocks of text outside boilerplate elements; sure inside an article or main element.

    Character references are decoded, white space inside a block becomes one space. Unclosed elements end where their
    parents do; a page without tags is one line. Class words do not drop an article or main element, unless it is inside
    another article; with `frames`, nor any element around one from where it begins.
    """
    out: list[tuple[str, bool]] = []
    text: list[str] = []
    stack: list[tuple[str, bool, bool, bool]] = []  # tag, dropped, main, dropped by its class only
    dropped = main = 0
    at = 0

    def flush() -> None:
        if text:
            line = " ".join(html.unescape("".join(text)).split())
            text.clear()
            if line:
                out.append((line, main > 0))

    def close(index: int) -> None:
        nonlocal dropped, main
        while len(stack) > index:
            _, d, m, _ = stack.pop()
            dropped -= d
            main -= m

    while True:
        m = _TOKEN.search(page, at)
        if not dropped:
            text.append(page[at:m.start() if m else len(page)])
        if not m:
            break
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if tag in BLOCKS:
            flush()
        elif tag == "br" and not dropped:
            text.append(" ")
        if m[1] or m[4]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    close(i)
                    break
                if stack[i][0] in ("td", "th", "table") and tag not in ("table", "tr", "tbody", "thead", "tfoot", "body", "html", "div", "section", "article", "main"):
                    break
            continue
        if tag in VOID:
            continue
        if tag in _END_P and any(s[0] == "p" for s in stack[-3:]):
            close(max(i for i, s in enumerate(stack) if s[0] == "p"))
        if tag in _ENDS and stack and stack[-1][0] in _ENDS[tag]:
            close(len(stack) - 1)
        inside = main > 0
        named, hidden = _marked(m[3] or m[6] or "")
        if tag in ("html", "body", "main") or tag == "article" and not any(s[0] == "article" for s in stack):
            named = False
        if tag in MAIN and frames:
            for i, (t, d, was_main, by_class) in enumerate(stack):
                if by_class:
                    stack[i] = (t, False, was_main, False)
                    dropped -= 1
        plain = tag in DROPPED or tag == "header" and not inside or hidden
        away = plain or named
        stack.append((tag, away, tag in MAIN, named and not plain))
        dropped += away
        main += tag in MAIN
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            at = end.start() if end else len(page)
            if not end:
                break
    flush()
    return out


def common_lines(a: list, b: list) -> list[bool]:
    """For each item of `a`, whether a longest common subsequence of `a` and `b` takes it (equal ends first)."""
    taken = [False] * len(a)
    lo, a1, b1 = 0, len(a), len(b)
    while lo < min(a1, b1) and a[lo] == b[lo]:
        taken[lo] = True
        lo += 1
    while a1 > lo and b1 > lo and a[a1 - 1] == b[b1 - 1]:
        a1, b1 = a1 - 1, b1 - 1
        taken[a1] = True
    both = set(a[lo:a1]) & set(b[lo:b1])
    x, y = [i for i in range(lo, a1) if a[i] in both], [b[j] for j in range(lo, b1) if b[j] in both]
    if not x or not y:
        return taken
    n, m = len(x), len(y)
    full = (1 << m) - 1
    places: dict = {}
    for j, v in enumerate(y):
        places.setdefault(v, []).append(m - 1 - j)
    often = {v: sum(1 << p for p in at) for v, at in places.items() if len(at) > 32}  # few items can be frequent

    def onward(row: int, k: int) -> int:
        v = a[x[n - 1 - k]]
        hit = row & (often[v] if v in often else sum(1 << p for p in places[v]))
        return (row + hit | row & ~hit) & full

    # Row k has a bit per item of y, from its end: 0 where the subsequence of x[n - k:] and y grows with that item. One row
    # in `step` is kept, the rest of a block is made again when the walk comes to it.
    step = isqrt(n) + 1
    kept, row = [], full
    for k in range(n):
        if k % step == 0:
            kept.append(row)
        row = onward(row, k)
    block, first = [], n

    def at(k: int) -> int:
        nonlocal block, first
        if k < first:
            first = k // step * step
            block = [kept[first // step]]
            while first + len(block) <= k:
                block.append(onward(block[-1], first + len(block) - 1))
        return block[k - first]

    i = j = 0
    here, below = row, at(n - 1)
    while i < n and j < m:
        same = a[x[i]] == y[j]
        if same:
            taken[x[i]] = True
        elif here >> (m - 1 - j) & 1:
            rest = (1 << (m - j)) - 1
            if (here & rest).bit_count() != (below & rest).bit_count():  # x[i] is in every longest one
                j += 1
                continue
        i, j = i + 1, j + same
        if i < n:
            here, below = below, at(n - 1 - i)
    return taken


def _key(line: str) -> int:
    return int.from_bytes(blake2b(line.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _keys(at: int, keep: int):
    """The columns before `keep`, whether the page has an article or main element, and a 64-bit hash per line."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                pages = [page_lines(value.as_py() or "") for value in part.column(at)]
                sure = pa.array([any(s for _, s in lines) for lines in pages], pa.bool_())
                keys = pa.array([[_key(t) for t, _ in lines] for lines in pages], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([*part.columns[:keep], sure, keys], names=[*part.schema.names[:keep], "sure", "keys"])

    return run


_PLACED = ["host", "sure", "path", "k1", "k2", "keys"]


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for lo in range(0, batch.num_rows, 512):
            part = batch.slice(lo, 512)
            yield from zip(*[part.column(c).to_pylist() for c in [*_PLACED, "_pid"]])


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first and the last page of a range."""
    first = last = None
    for batch in batches:
        if batch.num_rows:
            first = first or batch.slice(0, 1)
            last = batch.slice(batch.num_rows - 1, 1)
    if first:
        yield from (first, last)


def _aligned(borders: dict[int, tuple]):
    """Sorted pages -> k1, k2, and per line whether the page shares it with its mate; `borders` has by range the page before
    it and the page after it."""
    def alike(row: tuple, other: tuple | None) -> int:
        return -1 if other is None or other[:2] != row[:2] else len(os.path.commonprefix([row[2], other[2]]))

    def met(before: tuple | None, row: tuple, after: tuple | None) -> tuple | None:
        near, far = alike(row, before), alike(row, after)
        if near < 0 and far < 0:
            return None
        return row[3], row[4], common_lines(row[5], (before if near >= far else after)[5])

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple | None]:
        before = row = None
        for after in _rows(batches):
            if row is None:
                before = borders[after[-1]][0]
            else:
                yield met(before, row, after)
                before = row
            row = after
        if row is not None:
            yield met(before, row, borders[row[-1]][1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []

        def batch() -> pa.RecordBatch:
            k1, k2, shared = zip(*out)
            return pa.RecordBatch.from_arrays([pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(shared, pa.list_(pa.bool_()))], names=["k1", "k2", "shared"])

        for row in found(batches):
            if row:
                out.append(row)
            if len(out) == 512:
                yield batch()
                out.clear()
        if out:
            yield batch()

    return run


def shared_lines(pages: DataFrame) -> DataFrame:
    """(k1, k2, shared) for all pages (k1, k2, url, html) that have lines and a mate; `shared` tells it line by line.

    Pages of a host, those with an article or main element and those without apart, stand in the order of their path; each is
    paired with the neighbour whose path begins more like its own (the earlier one on a tie). Pages with the same address
    and content are one. The order comes from a range-partitioned sort, so a hot host is spread over tasks; only hashes
    of lines travel, not pages, and of each range two pages are collected, which meet the ranges beside it.
    """
    host = F.lower(F.coalesce(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1), F.lit("")))
    path = F.coalesce(F.regexp_replace("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*", ""), F.lit(""))
    light = pages.select(host.alias("host"), path.alias("path"), "k1", "k2", "html")
    lines = light.mapInArrow(_keys(4, 4), "host string, path string, k1 long, k2 long, sure boolean, keys array<long>").where(F.size("keys") > 0)
    ranged = in_ranges(checkpointed(lines.distinct()), ["host", "sure"], ["path", "k1", "k2"], _PLACED)
    ends = sorted(map(tuple, ranged.mapInArrow(_ends, ranged.schema).collect()), key=lambda r: r[-1])  # two rows a range, stable
    firsts, lasts = ends[::2], ends[1::2]
    borders = {r[-1]: (lasts[i - 1] if i else None, firsts[i + 1] if i + 1 < len(firsts) else None) for i, r in enumerate(firsts)}
    return ranged.mapInArrow(_aligned(borders), "k1 long, k2 long, shared array<boolean>")


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """page_id, url, text, n_chars, n_shared, n_restored for every row.

    Null and empty pages have no text. Blocks outside navigation, headers, footers, sidebars, notices, adverts, forms,
    scripts and reader comments are the page's lines. Every page is compared with the page of its host whose URL path is
    nearest: a longest common subsequence aligns their lines, and what both share (`n_shared` lines) counts as the
    site's, not the page's. The structure of the page then checks that: a line inside an article or main element is
    text though the neighbour has it too (`n_restored`: copies of an article, repeated sentences), and where there is such
    an element, lines outside it are none though the neighbour lacks them. A page alone on its host keeps its lines.
    Repeated rows are one page; null URLs are a host of their own.
    """
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(page).alias("html"))
    k1 = F.xxhash64(F.coalesce("url", F.lit("")), F.coalesce("html", F.lit("")))
    k2 = F.xxhash64(F.lit(1), F.coalesce("url", F.lit("")), F.coalesce("html", F.lit("")))
    keyed = rows.withColumns({"k1": k1, "k2": k2})
    shared = shared_lines(keyed.select("k1", "k2", "url", "html"))
    schema = StructType([StructField("page_id", rows.schema["page_id"].dataType), *StructType.fromDDL("url string, k1 long, k2 long, lines array<string>, sure array<boolean>").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                found = [page_lines(value.as_py() or "") for value in part.column(4)]
                lines, sure = ([[line[i] for line in page] for page in found] for i in (0, 1))
                yield pa.RecordBatch.from_arrays([*part.columns[:4], pa.array(lines, pa.list_(pa.string())), pa.array(sure, pa.list_(pa.bool_()))], names=schema.names)

    met = keyed.select("page_id", "url", "k1", "k2", "html").mapInArrow(run, schema).join(shared, ["k1", "k2"], "left")
    both = F.coalesce("shared", F.array().cast("array<boolean>"))
    own = F.filter("lines", lambda t, i: ~F.coalesce(F.get(both, i), F.lit(False)))
    inside = F.filter("lines", lambda t, i: F.get("sure", i))
    text = F.concat_ws("\n", F.when(F.array_contains("sure", True), inside).otherwise(own))
    return met.select("page_id", "url", text.alias("text"), F.filter(both, lambda s: s).alias("_s"), F.filter(both, lambda s, i: s & F.get("sure", i)).alias("_r")).select(
        "page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"), F.size("_s").cast("long").alias("n_shared"), F.size("_r").cast("long").alias("n_restored"))
