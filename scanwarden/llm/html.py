"""Main text of web pages by markup and by differencing pages of like URL (operator 6)."""

from __future__ import annotations

import html as entities
import math
import re
from collections.abc import Iterator, Sequence
from urllib.parse import urlsplit

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanwarden.llm.shared import encoded, written
from scanwarden.skew import hot_keys, over_sequence

PLAIN, MAIN, AROUND = 0, 1, 2

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?"
    r"|<(script|style|noscript|template|svg|iframe|textarea|select|title|object|canvas|math)\b[^<>]*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][\w:-]*+)((?:\"[^\"]*\"|'[^']*'|[^'\"<>]++)*+)>", re.S | re.I)
#: Elements that end a block of text; all others stand inside one.
_BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th "
    "thead tr ul".split())
#: Elements that are followed from their start to their end tag.
_HELD = frozenset("article aside body center dialog div dl fieldset footer form head header main menu nav ol section table ul".split())
_OUTSIDE = frozenset("nav footer aside form menu head dialog fieldset".split())
_ATTRIBUTE = re.compile(r"(class|id|role|itemprop|hidden|aria-hidden)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
_AROUND_NAME = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|banner|sponsor\w*|promo\w*|cookies?|consent|gdpr|notices?|alerts?|popup|modal|overlay|newsletter|"
    r"subscribe|subscription|social|share|sharing|sidebar|side|menu|nav|navbar|navigation|breadcrumbs?|footer|comments?|commentlist|"
    r"disqus|replies|respond|related|recommend\w*|widgets?|login|signup|search|legal|pagination|pager|complementary|contentinfo|hidden)"
    r"(?:$|[\s_-])", re.I)
_HEAD_NAME = re.compile(r"(?:^|[\s_-])(?:header|masthead|topbar)(?:$|[\s_-])", re.I)
_MAIN_NAME = re.compile(r"(?:^|\s)(?:main|articleBody|article-body|post-content|entry-content|article-content|main-content)(?:$|\s)", re.I)


def lines_of(page: str) -> list[tuple[str, int]]:
    """The text blocks of a page in order, each with its zone: inside the article, around it, or neither.

    Character references are decoded, white space inside a block becomes one space, empty blocks are left out. Missing end
    tags are fine: an end tag closes the nearest open element of its name, a start tag of a block ends the block before.
    """
    out: list[tuple[str, int]] = []
    held: list[str] = []
    open_: list[tuple[str, int]] = []  # element and the zone inside it
    zone = PLAIN

    def close() -> None:
        if held:
            text = " ".join(entities.unescape("".join(held)).split())
            held.clear()
            if text:
                out.append((text, zone))

    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            held.append(page[at : m.start()])
        at = m.end()
        name = m[3]
        if name is None:
            continue
        name = name.lower()
        if name == "br":
            held.append(" ")
            continue
        if name not in _BLOCKS:
            continue
        close()
        if name not in _HELD:
            continue
        if m[2]:
            for k in range(len(open_) - 1, -1, -1):
                if open_[k][0] == name:
                    del open_[k:]
                    break
            zone = open_[-1][1] if open_ else PLAIN
        elif not m[4].endswith("/"):
            zone = _zone(name, m[4], zone)
            open_.append((name, zone))
    if at < len(page):
        held.append(page[at:])
    close()
    return out


def _zone(name: str, attributes: str, now: int) -> int:
    if now == AROUND or name in _OUTSIDE or name == "header" and now != MAIN:
        return AROUND
    told = {k.lower(): (v or "").strip("\"'") for k, v in _ATTRIBUTE.findall(attributes)} if attributes.strip() else {}
    if name in ("article", "main") and "hidden" not in told:
        names = f"{told.get('class', '')} {told.get('id', '')}"
        return AROUND if re.search(r"(?:^|[\s_-])(?:comments?|related|ads?|sponsor\w*|promo\w*)(?:$|[\s_-])", names, re.I) else MAIN
    if not told:
        return now
    names = " ".join(told.get(k, "") for k in ("class", "id", "role"))
    if "hidden" in told or told.get("aria-hidden") == "true" or _AROUND_NAME.search(names) or now != MAIN and _HEAD_NAME.search(names):
        return AROUND if name != "body" else now
    return MAIN if _MAIN_NAME.search(f"{names} {told.get('itemprop', '')}") and name != "body" else now


def common_lines(a: Sequence, b: Sequence) -> list[int]:
    """Positions in ``a`` of a longest common subsequence with ``b``, by bit vectors of ``b``'s length.

    Of the vectors of ``a``'s lines one in about the root of their number is kept; those between are worked out again on the way
    back, so that two pages of n lines need about n * sqrt(n) / 4 bytes."""
    low = 0
    while low < min(len(a), len(b)) and a[low] == b[low]:
        low += 1
    high = 0
    while high < min(len(a), len(b)) - low and a[-1 - high] == b[-1 - high]:
        high += 1
    here, there = set(a[low : len(a) - high]), set(b[low : len(b) - high])
    left = [i for i in range(low, len(a) - high) if a[i] in there]
    right = [x for x in b[low : len(b) - high] if x in here]
    places: dict = {}
    for j, x in enumerate(right):
        places.setdefault(x, []).append(j)
    # a vector for each line that stands often: there are few of those
    often = {x: sum(1 << j for j in js) for x, js in places.items() if len(js) > 64}
    full = (1 << len(right)) - 1
    step = math.isqrt(len(left)) + 1
    kept = [full]  # the vector before each ``step`` lines

    def onward(v: int, some: Sequence[int]) -> Iterator[int]:
        for i in some:
            x = a[i]
            u = v & (often[x] if x in often else sum(1 << j for j in places[x]))
            v = ((v + u) | (v - u)) & full
            yield v

    for k in range(0, len(left), step):
        for v in onward(kept[-1], left[k : k + step]):
            pass
        kept.append(v)
    rows: dict[int, int] = {}
    found, i, j = [], len(left), len(right)
    while i and j:
        if i - 1 not in rows or i > 1 and i - 2 not in rows:
            k = (i - 1) // step
            rows = {k * step + n: v for n, v in enumerate(onward(kept[k], left[k * step : (k + 1) * step]))}
            rows[k * step - 1] = kept[k]
        bit = 1 << (j - 1)
        if rows[i - 1] & bit:
            j -= 1
        elif i > 1 and not rows[i - 2] & bit:
            i -= 1
        else:
            found.append(left[i - 1])
            i, j = i - 1, j - 1
    return [*range(low), *reversed(found), *range(len(a) - high, len(a))]


def place(url: str | None) -> tuple[str, str]:
    """Host and path of a URL, without query and fragment; what cannot be read counts as path."""
    try:
        parts = urlsplit(url or "")
        return (parts.netloc or "").lower(), parts.path.rstrip("/")
    except ValueError:
        return "", url or ""


def _shared_start(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


def shared_lines(pages: DataFrame, hot_rows: int = 20_000) -> DataFrame:
    """``page_id``, ``url``, ``body`` (hash of the html) and ``shared``: the positions of lines that a page has in common, by
    longest common subsequence, with the page of the nearest URL path on its host.

    In the order of paths, the nearest is the page before or after, whichever path begins alike for longer. Only hashes of
    lines take part. A host with more than ``hot_rows`` pages is cut into ranges of paths that see each other's edges.
    """
    kind = pages.schema["page_id"].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            where = [place(x) for x in batch.column("url").to_pylist()]
            lines = [[xxhash.xxh3_64_intdigest(x) >> 1 for x, _ in lines_of(h.decode("utf-8", "replace"))] for h in encoded(batch.column("html"))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), batch.column("body"), pa.array([x[0] for x in where], pa.string()),
                 pa.array([x[1] for x in where], pa.string()), pa.array(lines, pa.list_(pa.int64()))],
                ["page_id", "url", "body", "host", "path", "lines"])

    light = pages.mapInArrow(read, f"page_id {kind}, url string, body long, host string, path string, lines array<long>")
    light = written(light.dropDuplicates(["page_id", "url", "body"]))
    host = F.coalesce(F.regexp_extract("url", r"(?i)^[a-z][a-z0-9+.-]*://([^/?#]*)", 1), F.lit(""))
    hot = hot_keys(pages.select(F.lower(host).alias("host")), ["host"], hot_rows)

    def neighbours(df, steps):
        return df.withColumns({
            "path_before": steps.back("path"), "lines_before": steps.back("lines"),
            "path_after": steps.ahead("path"), "lines_after": steps.ahead("lines")})

    near = over_sequence(light, neighbours, keys=["host"], order=["path", "page_id", "url", "body"], before=1, after=1, hot=hot)

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("path", "lines", "path_before", "lines_before", "path_after", "lines_after")]
            out = []
            for path, lines, p, before, q, after in zip(*columns):
                if q is not None and (p is None or _shared_start(path, q) > _shared_start(path, p)):
                    before = after
                out.append(common_lines(lines, before) if before else [])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(out, pa.list_(pa.int32()))],
                                             ["page_id", "url", "body", "shared"])

    return near.select("page_id", "url", "body", "path", "lines", "path_before", "lines_before", "path_after", "lines_after").mapInArrow(
        align, f"page_id {kind}, url string, body long, shared array<int>")


def kept_text(page: str, shared: Sequence[int]) -> str:
    """The article's lines; on a page without one, the lines that are neither shared nor around it by their markup."""
    lines = lines_of(page)
    if any(zone == MAIN for _, zone in lines):
        return "\n".join(x for x, zone in lines if zone == MAIN)
    gone = set(shared)
    return "\n".join(x for i, (x, zone) in enumerate(lines) if zone == PLAIN and i not in gone)


def main_text(pages: DataFrame, hot_rows: int = 20_000) -> DataFrame:
    """``page_id``, ``url`` and ``text`` of every row of ``pages`` (page_id, url, html).

    A null html counts as empty and gives an empty text; a null url is a host of its own; rows that repeat id, url and
    html get the same text; an empty table gives no rows; other columns are ignored.
    """
    kind = pages.schema["page_id"].dataType.simpleString()
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("body", F.xxhash64("html"))
    shared = shared_lines(rows, hot_rows).select(F.col("page_id").alias("i"), F.col("url").alias("u"), F.col("body").alias("b"), "shared")
    both = rows.join(shared.hint("shuffle_hash"), F.col("page_id").eqNullSafe(F.col("i")) & (F.col("body") == F.col("b")) & F.col("url").eqNullSafe(F.col("u")), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pages_, shared_ = encoded(batch.column("html")), batch.column("shared").to_pylist()
            out = [kept_text(h.decode("utf-8", "replace"), s or ()) for h, s in zip(pages_, shared_)]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(out, pa.string())], ["page_id", "url", "text"])

    return both.select("page_id", "url", "html", "shared").mapInArrow(run, f"page_id {kind}, url string, text string")
