"""Operator 10, HTML extraction by nearest-URL page differencing.

Each page is parsed once into text lines (one per block element) that are written to the shared folder. Pages are
put in order of host, URL path and id over the whole cluster, and each is aligned with the page before and
after it on its host by longest common subsequence of line hashes. The alignment decides first: shared lines
are template text and are deleted,

* outside a main container (``article``, ``main``, ``role=main``), lines shared with both neighbours, or with
  one that shares at most half of the page's text: closer ones are mirrors or near copies of the
  article and say nothing about the template;
* inside one, lines shared with both that are so shared on most pages of the host (``main_rate``), since
  a passage that some neighbouring articles have in common (a licence line, a quotation) is article text;
* never all that a page has.

Differencing sees only what neighbours share, while menus and adverts may differ from page to page. What is left
is therefore held against the page's own structure: elements that declare themselves boilerplate give no text
(``nav``, ``aside``, ``footer``, ``form``, hidden parts, scripts, styles, and elements with a class or id that as a
whole names an advert, a notice, a comment list and the like: ``ad-slot``, but not ``ad-hoc``), and where a page has
a main container only its lines count.

The counted template lines of the hosts (a row per host) are broadcast within ``broadcast_rows``, and so are
the rows of deleted places; a host with a third of all pages is thus no single task's.

Edge cases: null html is the empty page (text '', n_chars 0); a null or odd URL forms the host '';
repeated rows get equal results; unclosed tags end with their parent; an empty table gives an empty
result; extra columns are not read.
"""

from __future__ import annotations

import html as _html
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, small_side, written
from .neighbours import with_previous

# Element and class names with a declared role.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
DROPPED = frozenset("head nav aside footer form button select textarea label fieldset legend datalist script style noscript template iframe object embed svg canvas audio video map dialog title menu".split())
MAIN = frozenset(("article", "main"))
CLOSES_ITSELF = frozenset("p li dt dd tr td th option".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
DROPPED_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notification popup modal newsletter subscribe paywall sidebar sidenav"
    " widget related recommended recommendations share sharing social breadcrumb breadcrumbs nav navbar navigation menu topbar toolbar footer masthead comment comments disqus reply replies pagination pager tags hidden".split()
)
#: Names that a section of an article may bear as well: they count outside a main container only.
OUTSIDE_NAMES = frozenset("discussion respond login signup search skip follow alert overlay subscription toc header".split())
#: Words of layout that may stand beside a name in one class or id without changing what it names.
LAYOUT_WORDS = frozenset(
    "site page global top bottom left right primary secondary container wrapper wrap box list listing section block slot unit area item items inner outer content bar panel link links post posts article articles story stories"
    " button buttons icon icons form group row col column text body holder zone image label title heading count thread policy message info mobile desktop sticky fixed small large user users reader readers".split()
)

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|</?([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>|</?([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)>", re.S)
_ATTRIBUTE = re.compile(r"(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_HIDDEN_STYLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


def _declared(tag: str, attributes: str, in_main: bool) -> tuple[bool, bool]:
    """(gives no text, is a main container) for an element."""
    if tag in DROPPED or tag == "header" and not in_main:
        return True, False
    main = tag in MAIN
    for m in _ATTRIBUTE.finditer(attributes) if attributes.strip() else ():
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").strip()
        if name == "role":
            if value.lower() == "main":
                main = True
            elif value.lower() in DROPPED_ROLES:
                return True, False
        elif name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and _HIDDEN_STYLE.search(value):
            return True, False
        elif name in ("class", "id") and tag not in ("html", "body") and not main:
            if any(_names_boilerplate(token, in_main) for token in value.split()):
                return True, False
    return False, main


@lru_cache(4096)
def _names_boilerplate(token: str, in_main: bool) -> bool:
    """Whether a class or id as a whole names boilerplate: all its words do, or are words of layout beside one that does."""
    found = [w.lower() for w in _NAME.findall(token)]
    names = DROPPED_NAMES if in_main else DROPPED_NAMES | OUTSIDE_NAMES
    return any(w in names for w in found) and all(w in names or w in LAYOUT_WORDS for w in found)


def lines(page: str) -> list[tuple[str, bool]]:
    """(text, inside a main container) of each block with text that isn't declared boilerplate."""
    out: list[tuple[str, bool]] = []
    parts: list[str] = []
    stack: list[tuple[str, bool, bool]] = []  # tag, dropped, main (both with their ancestors')
    dropped = main = False

    def flush() -> None:
        if parts:
            text = "".join(parts)
            parts.clear()
            text = " ".join((_html.unescape(text) if "&" in text else text).split())
            if text:
                out.append((text, main))

    def pop_to(k: int) -> None:
        nonlocal dropped, main
        flush()
        del stack[k:]
        dropped, main = stack[-1][1:] if stack else (False, False)

    at = 0
    while True:
        m = _TOKEN.search(page, at)
        if not dropped and (m.start() if m else len(page)) > at:
            parts.append(page[at : m.start() if m else len(page)])
        if not m:
            break
        at = m.end()
        tag = (m[1] or m[3] or "").lower()
        if not tag:
            continue
        if m[0][1] == "/":
            if tag in INLINE and not any(t == tag and d for t, d, _ in stack[-3:]):
                for k in range(len(stack) - 1, max(-1, len(stack) - 4), -1):
                    if stack[k][0] == tag:
                        del stack[k]
                        break
                continue
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    pop_to(k)
                    break
            else:
                flush()
            continue
        attributes = m[2] or m[4] or ""
        if tag in VOID:
            if tag not in ("wbr", "img", "input"):
                flush()
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if attributes.endswith("/") and tag in INLINE:
            continue
        if tag in CLOSES_ITSELF and any(t == tag for t, _, _ in stack[-2:]):
            pop_to(max(k for k in range(len(stack)) if stack[k][0] == tag))
        gone, is_main = _declared(tag, attributes, main) if not dropped else (True, False)
        if tag not in INLINE or gone:
            flush()
        stack.append((tag, dropped or gone, main or is_main))
        dropped, main = stack[-1][1:]
    flush()
    return out


def _rows(a: list[int], b: list[int]) -> list[int]:
    """Bit-parallel LCS of all prefixes: after row i, the zero bits of the mask mark where it grows."""
    at: dict[int, int] = {}
    for j, x in enumerate(b):
        at[x] = at.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    v, out = full, [full]
    for x in a:
        u = v & at.get(x, 0)
        v = ((v + u) | (v - u)) & full
        out.append(v)
    return out


def _lengths(a: list[int], b: list[int]) -> np.ndarray:
    """LCS length of a with each prefix of b."""
    v = _rows(a, b)[-1]
    bits = np.unpackbits(np.frombuffer(v.to_bytes(len(b) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(b)]
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def shared(a: list[int], b: list[int], most_bits: int = 1 << 28) -> list[tuple[int, int]]:
    """Index pairs of a longest common subsequence; memory is bounded by halving long inputs."""
    lo = 0
    while lo < min(len(a), len(b)) and a[lo] == b[lo]:
        lo += 1
    hi = 0
    while hi < min(len(a), len(b)) - lo and a[-1 - hi] == b[-1 - hi]:
        hi += 1
    x, y = a[lo : len(a) - hi], b[lo : len(b) - hi]
    inner: list[tuple[int, int]] = []
    if x and y and len(x) * len(y) > most_bits and len(x) > 1:
        half = len(x) // 2
        k = int(np.argmax(_lengths(x[:half], y) + _lengths(x[half:][::-1], y[::-1])[::-1]))
        inner = shared(x[:half], y[:k], most_bits) + [(half + i, k + j) for i, j in shared(x[half:], y[k:], most_bits)]
    elif x and y:
        rows = _rows(x, y)
        i, j = len(x), len(y)
        count = lambda i, j: j - (rows[i] & ((1 << j) - 1)).bit_count()
        while i and j:
            if x[i - 1] == y[j - 1]:
                i, j = i - 1, j - 1
                inner.append((i, j))
            elif count(i - 1, j) >= count(i, j - 1):
                i -= 1
            else:
                j -= 1
        inner.reverse()
    ends = len(a) - hi, len(b) - hi
    return [(k, k) for k in range(lo)] + [(lo + i, lo + j) for i, j in inner] + [(ends[0] + k, ends[1] + k) for k in range(hi)]


_LINE = pa.struct([("t", pa.string()), ("m", pa.bool_())])


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from hashlib import blake2b

    names = ["page_id", "url", "host", "path", "row_key"]
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            part = batch.slice(at, 64)
            pages = [lines(page or "") for page in part.column("html").to_pylist()]
            kept = [[{"t": t, "m": m} for t, m in ls] for ls in pages]
            hashes = [[int.from_bytes(blake2b(t.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True) for t, _ in ls] for ls in pages]
            sizes = [[len(t) for t, _ in ls] for ls in pages]
            yield pa.RecordBatch.from_arrays([*(part.column(k) for k in names), pa.array(kept, pa.list_(_LINE)), pa.array(hashes, pa.list_(pa.int64())), pa.array(sizes, pa.list_(pa.int32()))], [*names, "lines", "hashes", "sizes"])


def _shared_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each row and the one before it on its host: (row_key, host, lines shared with the row before / after)."""
    kind = pa.list_(pa.struct([("i", pa.int32()), ("h", pa.int64())]))
    for batch in batches:
        keys, hosts, before, after, close = [], [], [], [], ([], [])
        for row in batch.to_pylist():
            if row["prev_row_key"] is None or row["prev_host"] != row["host"] or not row["hashes"] or not row["prev_hashes"]:
                continue
            pairs = shared(row["prev_hashes"], row["hashes"])
            for side, of in ((1, ""), (0, "prev_")):
                at, sizes = [p[side] for p in pairs], row[of + "sizes"]
                if at:
                    for c, mine in zip(close, (1, 0), strict=True):
                        c.append(mine == side and 2 * sum(sizes[k] for k in at) > sum(sizes))
                    found = [{"i": k, "h": row[of + "hashes"][k]} for k in at]
                    keys.append(row[of + "row_key"])
                    hosts.append(row["host"])
                    before.append(found if side else [])
                    after.append([] if side else found)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(hosts, pa.string()), pa.array(before, kind), pa.array(after, kind), *(pa.array(c, pa.bool_()) for c in close)], ["row_key", "host", "before", "after", "close_before", "close_after"])


def _host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def parsed_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, host, path, row_key, lines (text, inside a main container), their hashes and sizes."""
    html = F.col(html_col).cast("string")
    slim = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), html.alias("html"))
    url = F.coalesce(F.col("url"), F.lit(""))
    path = F.regexp_extract(url, "^(?:[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)?([^?#]*)", 1)
    keyed = slim.select("page_id", "url", _host(url).alias("host"), path.alias("path"), F.xxhash64("page_id", "url", "html").alias("row_key"), "html")
    return keyed.mapInArrow(_parsed, "page_id long, url string, host string, path string, row_key long, lines array<struct<t: string, m: boolean>>, hashes array<long>, sizes array<int>")


def deleted_places(parsed: DataFrame, main_rate: float = 0.6, least_pages: int = 5, broadcast_rows: int = 100_000) -> DataFrame:
    """(s_key, s_host, outside, inside): of each row that shares lines with a neighbour, the places of the lines to
    delete, for lines outside and inside a main container."""
    pairs = with_previous(parsed.select("host", "path", "page_id", "row_key", "hashes", "sizes"), ["host", "path", "page_id", "row_key"], ["host", "row_key", "hashes", "sizes"])
    kind = "array<struct<i: int, h: long>>"
    found = pairs.mapInArrow(_shared_lines, f"row_key long, host string, before {kind}, after {kind}, close_before boolean, close_after boolean")
    by_row = written(found.groupBy("row_key", "host").agg(F.max("before").alias("before"), F.max("after").alias("after"), F.max("close_before").alias("close_before"), F.max("close_after").alias("close_after")), "shared_lines")
    # template lines of a host: shared with both neighbours on most of its pages
    both = F.array_intersect("before", "after")
    sizes = checkpointed(parsed.groupBy(F.col("host").alias("s_host")).agg(F.count("*").alias("n_pages")).where(F.col("n_pages") >= least_pages))
    lines_of = by_row.where("NOT close_before AND NOT close_after").select("host", F.explode(both).alias("x")).groupBy("host", F.col("x.h").alias("h")).agg(F.count("*").alias("n"))
    most = lines_of.join(small_side(sizes, sizes.count(), broadcast_rows), F.col("host") == F.col("s_host")).where(F.col("n") >= main_rate * F.col("n_pages"))
    template = checkpointed(most.groupBy(F.col("host").alias("t_host")).agg(F.collect_set("h").alias("template")))
    none = F.array().cast(kind)
    either = F.array_union(both, F.array_union(F.when(F.col("close_before"), none).otherwise(F.col("before")), F.when(F.col("close_after"), none).otherwise(F.col("after"))))
    places = lambda c: F.transform(c, lambda x: x["i"])
    inside = F.filter(both, lambda x: F.array_contains("template", x["h"]))
    joined = by_row.join(small_side(template, template.count(), broadcast_rows), F.col("host") == F.col("t_host"), "left")
    return joined.select(F.col("row_key").alias("s_key"), F.col("host").alias("s_host"), places(either).alias("outside"), F.coalesce(places(inside), F.array().cast("array<int>")).alias("inside"))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", main_rate: float = 0.6, least_pages: int = 5, broadcast_rows: int = 100_000) -> DataFrame:
    """A row per page: page_id, url, main text, its code points.

    Rows of line places for broadcast are a few dozen bytes each; above ``broadcast_rows`` of them
    the pages are joined by shuffle.
    """
    parsed = written(parsed_pages(pages, id_col, url_col, html_col), "parsed", "zstd")
    gone = written(deleted_places(parsed, main_rate, least_pages, broadcast_rows), "gone_lines")
    joined = parsed.drop("hashes", "sizes").join(small_side(gone, gone.count(), broadcast_rows), (F.col("row_key") == F.col("s_key")) & (F.col("host") == F.col("s_host")), "left")
    numbered = F.transform("lines", lambda x, i: F.struct(x["t"].alias("t"), x["m"].alias("m"), i.alias("i")))
    shown = F.filter(numbered, lambda x: x["m"] | ~F.exists("lines", lambda y: y["m"]))
    deleted = lambda x: F.when(x["m"], F.array_contains("inside", x["i"])).otherwise(F.array_contains("outside", x["i"]))
    own = F.filter("shown", lambda x: ~F.coalesce(deleted(x), F.lit(False)))
    picked = joined.select("page_id", "url", shown.alias("shown"), "outside", "inside").select("page_id", "url", F.when(F.size(own) > 0, own).otherwise(F.col("shown")).alias("kept"))
    text = F.array_join(F.transform("kept", lambda x: x["t"]), " ")
    return picked.select("page_id", "url", text.alias("text"), F.char_length(text).cast("long").alias("n_chars"))
