"""HTML extraction by nearest-URL page differencing.

A page becomes text lines, one for each block, each marked by where it stands: inside an article, inside page furniture (menus,
headers, footers, asides, forms, adverts, notices, comments), or elsewhere. Within each host, pages stand in order of URL path;
a page is paired with the neighbour whose path shares more with its own and whose lines differ, their lines are aligned by
longest common subsequence, and shared lines are deleted: what two neighbouring pages of a site have in common is its template.

Differencing alone deletes an article's own lines where two pages carry the same one, and keeps template lines that differ from
page to page, such as a footer with the page's address. So marks decide first: furniture never stays, and lines of an article
stay even if shared. The differences decide on every other line, with one exception: where a page has an article at least as long
as its unshared other lines, or no differing neighbour, the other lines are dropped. So a small card does not stand for the page.

Defined results: null or empty html gives an empty text; broken markup is read as far as it goes; a null or unusual URL belongs
to the host "" ; repeated rows get equal texts; a page without a differing neighbour loses no line; an empty table gives an
empty result; further columns are left alone.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from helixloom.llm.common import materialize, table

ARTICLE, OTHER, FURNITURE = 2, 1, 0

#: Element names and name parts by which furniture is known.
DROPPED = {"script", "style", "noscript", "template", "svg", "iframe", "object", "head", "title", "button", "select", "textarea"}
FURNITURE_TAGS = {"nav", "header", "footer", "aside", "form", "menu", "dialog"}
ARTICLE_TAGS = {"article", "main"}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "col", "colgroup", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form",
    "frameset", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "optgroup", "option", "p", "pre", "search", "section", "summary",
    "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"script", "style", "textarea", "title", "noscript", "iframe"}
#: Elements that may stand in a head; any other ends it.
HEAD = {"head", "title", "base", "link", "meta", "style", "script", "noscript", "template"}
#: Elements that a new one of the same family, or the end of what holds them, closes.
SELF_CLOSING = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
NAMES = {
    "ad", "ads", "advert", "advertisement", "banner", "sponsor", "sponsored", "promo", "promotion", "cookie", "cookies", "consent", "gdpr", "notice", "popup", "modal", "newsletter", "subscribe",
    "sidebar", "side", "aside", "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "header", "masthead", "footer", "comment", "comments", "disqus", "reply", "replies", "respond",
    "share", "sharing", "social", "related", "recommended", "widget", "toolbar", "pagination", "pager", "login", "signup", "search", "skip", "copyright", "legal",
}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "menu", "menubar"}

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
_ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|aria-hidden|hidden|style)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
_SPACE = re.compile(r"\s+")


def _furniture(attributes: str) -> bool:
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name in ("class", "id"):
            if any(part in NAMES for part in re.split(r"[^a-z0-9]+", value)):
                return True
        elif (name == "role" and value in ROLES) or name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none", value)):
            return True
    return False


def lines(page: str | None) -> list[tuple[int, str]]:
    """(mark, text) of the page's blocks in order, white space and character references resolved; no empty ones."""
    page, out, parts, stack, at = page or "", [], [], [], 0
    # a stack entry is (tag, mark inside, text dropped)
    mark, dropped = OTHER, False

    def flush() -> None:
        text = _SPACE.sub(" ", html.unescape("".join(parts))).strip()
        parts.clear()
        if text:
            out.append((mark, text))

    while at < len(page):
        start = page.find("<", at)
        if start < 0:
            start = len(page)
        if start > at and not dropped:
            parts.append(page[at:start])
        if start == len(page):
            break
        m = _TAG.match(page, start) or _LOOSE.match(page, start)
        if not m:
            if not dropped and page[start + 1 : start + 2] not in "/!?" and not page[start + 1 : start + 2].isalpha():
                parts.append("<")
                at = start + 1
            else:  # a tag that the page's end cut off
                cut = page.find(">", start)
                at = len(page) if cut < 0 else cut + 1
            continue
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if tag == "br":
            parts.append("\n")
        elif tag in BLOCK:
            flush()
        if m[1]:
            depth = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == tag), None)
            # an inline end tag does not reach out of the block it stands in
            if depth is not None and not (tag not in BLOCK and any(t in BLOCK for t, _, _ in stack[depth:])):
                if stack[depth][0] in DROPPED or mark != (stack[depth - 1][1] if depth else OTHER):
                    flush()
                del stack[depth:]
        elif tag in RAW:
            end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
            at = end.end() if end else len(page)
        elif tag not in VOID and not m[3].endswith("/"):
            if tag not in HEAD and (head := next((k for k, x in enumerate(stack) if x[0] == "head"), None)) is not None:
                del stack[head:]  # its end tag may be left out
            close = SELF_CLOSING.get(tag)
            while close and stack and (stack[-1][0] in close or stack[-1][0] not in BLOCK and any(t in close for t, _, _ in stack)):
                stack.pop()
            mark, dropped = (stack[-1][1], stack[-1][2]) if stack else (OTHER, False)
            inside = FURNITURE if mark == FURNITURE or tag in FURNITURE_TAGS or _furniture(m[3]) else ARTICLE if tag in ARTICLE_TAGS else mark
            if inside != mark:
                flush()
            stack.append((tag, inside, dropped or tag in DROPPED))
        mark, dropped = (stack[-1][1], stack[-1][2]) if stack else (OTHER, False)
    flush()
    return out


#: Bits of rows that an alignment keeps at once; longer pages are aligned half by half.
MOST_BITS = 1 << 30


def _rows(a: list[int], b: list[int]) -> list[int]:
    """Hyyro's bit-parallel rows of a against b: zero bits of row j mark where the common length with b[: j + 1] grows."""
    places: dict[int, int] = {}
    for k, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << k
    full = (1 << len(a)) - 1
    v, rows = full, []
    for x in b:
        u = v & places.get(x, 0)
        v = ((v + u) | (v - u)) & full
        rows.append(v)
    return rows


def _growth(row: int, n: int) -> np.ndarray:
    """Common lengths of the starts of 0 to n lines, from a row's bits."""
    bits = np.unpackbits(np.frombuffer(row.to_bytes(n // 8 + 1, "little"), np.uint8), bitorder="little")[:n]
    return np.r_[0, np.cumsum(1 - bits.astype(np.int64))]


def _align(a: list[int], b: list[int]) -> list[int]:
    """Indices of a in a longest common subsequence with b."""
    if not a or not b:
        return []
    if len(a) * len(b) > MOST_BITS and len(b) > 1:
        half = len(b) // 2
        ahead, back = _last(a, b[:half]), _last(a[::-1], b[:half - 1 : -1])
        cut = int(np.argmax(_growth(ahead, len(a)) + _growth(back, len(a))[::-1]))
        return _align(a[:cut], b[:half]) + [cut + k for k in _align(a[cut:], b[half:])]
    rows, out, k, j = _rows(a, b), [], len(a) - 1, len(b) - 1
    while k >= 0 and j >= 0:
        if rows[j] >> k & 1:
            k -= 1
        elif j and not rows[j - 1] >> k & 1:
            j -= 1
        else:
            out.append(k)
            k, j = k - 1, j - 1
    return out


def _last(a: list[int], b: list[int]) -> int:
    places: dict[int, int] = {}
    for k, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << k
    full = v = (1 << len(a)) - 1
    for x in b:
        u = v & places.get(x, 0)
        v = ((v + u) | (v - u)) & full
    return v


def shared_lines(a: list[int], b: list[int]) -> set[int]:
    """Indices of ``a`` in a longest common subsequence with ``b``: common ends first, then the lines that both have."""
    low = 0
    while low < min(len(a), len(b)) and a[low] == b[low]:
        low += 1
    high = 0
    while high < min(len(a), len(b)) - low and a[-1 - high] == b[-1 - high]:
        high += 1
    a_, b_ = a[low : len(a) - high], b[low : len(b) - high]
    both = set(a_) & set(b_)
    left = [k for k, x in enumerate(a_) if x in both]
    found = _align([a_[k] for k in left], [x for x in b_ if x in both])
    return set(range(low)) | set(range(len(a) - high, len(a))) | {low + left[k] for k in found}


def main_text(marked: list[tuple[int, str]], neighbour: list[int] | None) -> str:
    """The page's main text, given the hashes of the neighbour's lines."""
    gone = shared_lines(line_hashes(marked), neighbour) if neighbour is not None else set()
    article = [t for m, t in marked if m == ARTICLE]
    rest = sum(len(t) for k, (m, t) in enumerate(marked) if m == OTHER and k not in gone)
    # the article is not the main text where the page's own lines outside it are longer
    alone = article and (neighbour is None or rest <= sum(map(len, article)))
    kept = [(m, t) for k, (m, t) in enumerate(marked) if m == ARTICLE or m == OTHER and not alone and k not in gone]
    return " ".join(t for _, t in kept)


def line_hashes(marked: list[tuple[int, str]]) -> list[int]:
    return [xxhash.xxh3_64_intdigest(t) - (1 << 63) for _, t in marked]


# ---- pairing -----------------------------------------------------------------------------------------------------------


def _hash_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(k1, k2, host, path) to the same with the hashes of the page's lines and one hash of them all."""
    for batch in batches:
        hashes = [line_hashes(lines(x.as_py())) for x in batch.column("html")]
        whole = [xxhash.xxh3_64_intdigest(np.array(h, np.int64).tobytes()) - (1 << 63) for h in hashes]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("k1", "k2", "host", "path")), pa.array(hashes, pa.list_(pa.int64())), pa.array(whole, pa.int64())], ["k1", "k2", "host", "path", "hashes", "whole"])


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(lines(p.as_py()), n.as_py()) for p, n in zip(batch.column("html"), batch.column("neighbour"), strict=True)]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("page_id", "url")), pa.array(texts, pa.string())], ["page_id", "url", "text"])


def neighbours(pages: DataFrame) -> DataFrame:
    """(host, whole, neighbour): for each distinct page of a host the line hashes of its nearest differing one in path order.

    A host may hold a third of all pages, so its pages are not one group: paths are dealt out in ranges of (host, path), the
    windows work inside a range, and the first and last page of every range meet the next in a second, far smaller step."""
    # equal pages of a host count once, under their first path, so that no page is paired with a copy of itself
    first = pages.groupBy("host", "whole").agg(F.min("path").alias("path"))
    ranged = first.repartitionByRange("host", "path", "whole").withColumn("part", F.spark_partition_id())
    ranged, _ = materialize(ranged, "html-order")
    w = W.partitionBy("part", "host").orderBy("path", "whole")
    near = ranged.withColumns({side: f(F.struct("path", "whole"), 1).over(w) for side, f in (("before", F.lag), ("after", F.lead))})
    # where a range ends inside a host, the neighbour is the nearest page of an adjoining range
    edges = ranged.groupBy("host", "part").agg(F.min(F.struct("path", "whole")).alias("low"), F.max(F.struct("path", "whole")).alias("high"))
    across = W.partitionBy("host").orderBy("part")
    edges = edges.select("host", "part", F.lag("high").over(across).alias("from_before"), F.lead("low").over(across).alias("from_after"))
    near = near.join(edges, ["host", "part"]).withColumns({"before": F.coalesce("before", "from_before"), "after": F.coalesce("after", "from_after")})

    def shared(side: str):
        """Length of the common start of two whole paths: what stands before their first difference."""
        a, b = F.col("path"), F.col(side)["path"]
        differs = F.array_position(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.coalesce(x == y, F.lit(False))), False)
        return F.when(F.col(side).isNull(), -1).otherwise(F.when(differs == 0, F.length(a)).otherwise(differs - 1))

    chosen = near.select("host", "whole", F.when(shared("before") > shared("after"), F.col("before")).otherwise(F.coalesce("after", "before"))["whole"].alias("other"))
    return chosen


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text) of every row of ``pages`` (page_id, url, html)."""
    url = F.coalesce(F.col("url"), F.lit(""))
    host = F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    path = F.regexp_replace(F.regexp_replace(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*", ""), r"[?#].*$", "")
    # pages are named by two hashes of their html, which are the same whenever and wherever they are computed
    keyed = pages.select("page_id", "url", "html", host.alias("host"), path.alias("path"), F.xxhash64("html").alias("k1"), F.xxhash64("html", F.lit(1)).alias("k2"))
    hashed, _ = materialize(keyed.select("k1", "k2", "host", "path", "html").mapInArrow(_hash_pages, "k1 long, k2 long, host string, path string, hashes array<long>, whole long"), "html-lines")
    pairs = neighbours(hashed)
    content = hashed.groupBy("host", "whole").agg(F.min_by("hashes", F.struct("k1", "k2")).alias("neighbour")).withColumnRenamed("whole", "other")
    paired = pairs.join(content, ["host", "other"], "left").select("host", "whole", "neighbour")
    by_page = hashed.select("k1", "k2", "host", "whole").distinct().join(paired, ["host", "whole"]).select("host", "k1", "k2", "neighbour")
    wide = keyed.join(by_page, ["host", "k1", "k2"], "left").select("page_id", "url", "html", "neighbour")
    return wide.mapInArrow(_extract, f"page_id {dict(pages.dtypes)['page_id']}, url string, text string")


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages", "page_id", "url", "html")).withColumn("n_chars", F.length("text").cast("long"))
