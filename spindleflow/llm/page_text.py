"""Main text of HTML pages: markup where it speaks, differencing against the nearest page where it does not.

Pages are sorted by host and URL path; a page's nearest page is the neighbour on its host that shares the longer start
of the path. The lines of both are aligned by their longest common subsequence, and lines they share are template, not
article. Alone this can't give right results: pages of one site also share sentences and whole articles, and menus
differ from page to page. So containers that name their role (navigation, adverts, forms, comments, an article, ...)
decide first, and the differencing deletes shared lines only where no markup has decided.
"""

from __future__ import annotations

import re
from hashlib import blake2b
from html.parser import HTMLParser
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spindleflow.llm.common import staged

# Elements by their part in a page.
SILENT = frozenset("head title script style template noscript iframe object svg math canvas select datalist audio video textarea button".split())
APART = frozenset("nav footer aside form menu dialog".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol optgroup option p pre section summary table tbody tfoot"
    " thead tr ul".split()
)
# A new one ends an open one of its kind within the same container.
OPEN_ENDED = frozenset("li p dt dd tr td th option".split())
CONTAINERS = frozenset("html body div section article main nav header footer aside form ul ol dl table figure dialog details blockquote menu".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
NAMED = re.compile(
    r"(?:^|[\s_-])(?:ads?|ad(?:slot|box|unit|banner|container|wrapper)s?|adverts?|advertisement|advertising|adsense|sponsor(?:ed|s)?|promo(?:tion|s)?|banner|cookies?|cookie(?:bar|banner|notice|consent)|consent|gdpr|notices?|alerts?|popup|modal|overlay"
    r"|nav|navbar|navigation|menus?|submenu|breadcrumbs?|sidebar|side-?bar|widgets?|footer|masthead|topbar|toolbar|share|sharing|social|related|recommended|recommendations"
    r"|newsletter|subscribe|subscription|signup|login|search|comments?|commentlist|comment-?form|reply|replies|respond|disqus|pagination|pager|copyright|skip-?link)(?:$|[\s_-])"
)
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
HEADER = re.compile(r"(?:^|[\s_-])(?:header|site-?header|page-?header)(?:$|[\s_-])")
BODY = re.compile(r"(?:^|[\s_-])(?:article|post|entry|story|main|page)[_-]?(?:body|content|text)(?:$|[\s_-])|^(?:content|article|story)$")

KEEP, OPEN, DROP = 2, 1, 0


class _Reader(HTMLParser):
    """Collects the text blocks of a page: (text, level of the main container around it, dropped, heading)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, bool, bool, int]] = []  # tag, silent, dropped, level of the main container
        self.lines: list[tuple[str, int, bool, str]] = []
        self.kept: list[str] = []
        self.gone: list[str] = []
        self.block = ""

    def _state(self):
        return self.stack[-1] if self.stack else ("", False, False, 0)

    def flush(self):
        _, _, _, level = self._state()
        for held, dropped in ((self.kept, False), (self.gone, True)):
            text = " ".join("".join(held).split())
            if text:
                self.lines.append((text, level, dropped, self.block))
            held.clear()

    def handle_starttag(self, tag, attrs):
        if tag in BLOCKS:
            self.flush()
            self.block = tag
        elif tag in ("br", "td", "th"):
            self.handle_data(" ")
        if tag in VOID:
            return
        if tag in OPEN_ENDED or tag in BLOCKS:
            wanted = {tag} if tag in OPEN_ENDED else set()
            if tag in BLOCKS:
                wanted.add("p")
            for place in range(len(self.stack) - 1, -1, -1):
                if self.stack[place][0] in wanted:
                    del self.stack[place:]
                    break
                if self.stack[place][0] in CONTAINERS:
                    break
        _, silent, dropped, level = self._state()
        given = dict(attrs)
        names = CAMEL.sub("-", f"{given.get('class') or ''} {given.get('id') or ''}").lower().strip()
        role = (given.get("role") or "").lower()
        if tag == "article" or role == "article":
            level = max(level, 3)
        elif tag == "main" or role == "main":
            level = max(level, 2)
        elif names and any(BODY.search(n) for n in names.split()):
            level = max(level, 1)
        if tag in SILENT:
            silent = True
        elif tag in APART or role in ROLES:
            dropped = True
        elif tag == "header" and level == 0:
            dropped = True
        elif names and tag not in ("html", "body", "main") and (NAMED.search(names) or level == 0 and HEADER.search(names)):
            dropped = True
        self.stack.append((tag, silent, dropped, level))

    def handle_endtag(self, tag):
        if tag in BLOCKS:
            self.flush()
            self.block = ""
        for place in range(len(self.stack) - 1, -1, -1):
            if self.stack[place][0] == tag:
                del self.stack[place:]
                return
            if tag not in CONTAINERS and self.stack[place][0] in CONTAINERS:
                return  # a stray end inside another container

    def handle_data(self, data):
        _, silent, dropped, _ = self._state()
        if not silent:
            (self.gone if dropped else self.kept).append(data)


def read_page(html: str) -> list[tuple[str, int]]:
    """The lines of a page in order, each with what the markup says: keep, drop, or open."""
    reader = _Reader()
    reader.feed(html)
    reader.close()
    reader.flush()
    best = max((level for _, level, dropped, _ in reader.lines if not dropped), default=0)
    out = []
    for text, level, dropped, block in reader.lines:
        if dropped:
            state = DROP
        elif best == 0:
            state = OPEN
        else:
            # The title may stand before the article inside the main part.
            state = KEEP if level == best or level > 0 and block == "h1" else DROP
        out.append((text, state))
    return out


def line_hash(text: str) -> int:
    return int.from_bytes(blake2b(text.encode("utf-8", "surrogatepass"), digest_size=4).digest(), "little", signed=True)


def _rows(a: list, b: list) -> list[int]:
    """Bit i of row j is 0 where a[i] lengthens the common subsequence of a[:i + 1] and b[: j + 1] (bit-parallel)."""
    where: dict = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    v, out = full, []
    for y in b:
        u = v & where.get(y, 0)
        v = ((v + u) | (v - u)) & full
        out.append(v)
    return out


def _reach(row: int, size: int) -> np.ndarray:
    bits = np.unpackbits(np.frombuffer(row.to_bytes(size // 8 + 1, "little"), np.uint8), bitorder="little")[:size]
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def common_places(a: list, b: list, limit: int = 400_000_000) -> list[int]:
    """Places in ``a`` of a longest common subsequence of both. Memory stays below ``limit`` bits and a few rows: longer
    pairs are halved where the halves' lengths add up to the most."""
    begin = 0
    while begin < min(len(a), len(b)) and a[begin] == b[begin]:
        begin += 1
    end = 0
    while end < min(len(a), len(b)) - begin and a[-1 - end] == b[-1 - end]:
        end += 1
    out = list(range(begin))
    tail = list(range(len(a) - end, len(a)))
    left, right = set(a[begin : len(a) - end]), set(b[begin : len(b) - end])
    places = [i for i in range(begin, len(a) - end) if a[i] in right]
    inner, other = [a[i] for i in places], [y for y in b[begin : len(b) - end] if y in left]
    if not inner or not other:
        return out + tail
    if len(inner) * len(other) > limit and len(other) > 1:
        half = len(other) // 2
        front = _reach(_last(inner, other[:half]), len(inner))
        back = _reach(_last(inner[::-1], other[half:][::-1]), len(inner))
        cut = int(np.argmax(front + back[::-1]))
        chosen = common_places(inner[:cut], other[:half], limit)
        chosen += [cut + k for k in common_places(inner[cut:], other[half:], limit)]
        return out + [places[k] for k in chosen] + tail
    rows, i, j, found = _rows(inner, other), len(inner), len(other), []
    while i and j:
        if rows[j - 1] >> (i - 1) & 1:
            i -= 1
        else:
            j -= 1
            if not (j and not rows[j - 1] >> (i - 1) & 1):
                i -= 1
                found.append(places[i])
    return out + found[::-1] + tail


def _last(a: list, b: list) -> int:
    where: dict = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for y in b:
        u = v & where.get(y, 0)
        v = ((v + u) | (v - u)) & full
    return v


def host_and_path(url: str) -> tuple[str, str]:
    try:
        parts = urlsplit(url.strip())
        return (parts.hostname or "", parts.path)
    except ValueError:
        return "", url


def _same_start(a: str, b: str) -> int:
    for k, (x, y) in enumerate(zip(a, b)):
        if x != y:
            return k
    return min(len(a), len(b))


def outlines(pages: DataFrame) -> DataFrame:
    """Host, path and line hashes of every page; ``pages`` has columns key, page_id, url, html."""

    def run(batches):
        for batch in batches:
            keys, numbers, urls, htmls = (batch.column(k).to_pylist() for k in range(4))
            for k in range(0, len(keys), 500):
                places = [host_and_path(u or "") for u in urls[k : k + 500]]
                hashed = [[line_hash(t) for t, _ in read_page(h or "")] for h in htmls[k : k + 500]]
                yield pa.record_batch(
                    [
                        pa.array(keys[k : k + 500], pa.int64()), pa.array(numbers[k : k + 500], pa.int64()),
                        pa.array([p[0] for p in places]), pa.array([p[1] for p in places]), pa.array(hashed, pa.list_(pa.int32())),
                    ],
                    names=["key", "page_id", "host", "path", "lines"],
                )

    return pages.mapInArrow(run, "key long, page_id long, host string, path string, lines array<int>")


def shared_lines(outlined: DataFrame) -> DataFrame:
    """For every page the places of the lines that it shares with its nearest page: key, nearest (page_id), shared.

    The pages are put in one order by (host, path, page_id): sorted by range, numbered within each part, and the parts
    numbered from their sizes. Neighbours meet by an equality join on the number, so a host with a third of all pages
    is dealt like any other.
    """
    dealt = outlined.repartitionByRange("host", "path", "page_id", "key").sortWithinPartitions("host", "path", "page_id", "key")
    dealt = staged(dealt.withColumn("at", F.monotonically_increasing_id()), "outlines")
    part = F.shiftright("at", 33)
    sizes = dealt.groupBy(part.alias("part")).count()
    bases = sizes.select("part", (F.sum("count").over(Window.orderBy("part")) - F.col("count")).alias("base"))
    placed = dealt.withColumn("part", part).join(bases, "part")
    placed = placed.withColumn("number", F.col("base") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))).drop("at", "part", "base")
    beside = F.struct("page_id", "host", "path", "lines")
    before = placed.select((F.col("number") + 1).alias("number"), beside.alias("before"))
    after = placed.select((F.col("number") - 1).alias("number"), beside.alias("after"))
    both = placed.join(before, "number", "left").join(after, "number", "left")

    def run(batches):
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                near = [n for n in (row["before"], row["after"]) if n and n["host"] == row["host"]]
                best = max(near, key=lambda n: _same_start(n["path"], row["path"]), default=None)
                out.append((row["key"], best and best["page_id"], common_places(row["lines"], best["lines"]) if best else []))
            if out:
                keys, nearest, shared = zip(*out)
                yield pa.record_batch([pa.array(keys, pa.int64()), pa.array(nearest, pa.int64()), pa.array(shared, pa.list_(pa.int32()))], names=["key", "nearest", "shared"])

    return both.select("key", "host", "path", "lines", "before", "after").mapInArrow(run, "key long, nearest long, shared array<int>")


def main_text(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """The main text of every page: page_id, url, text, n_chars, nearest (the page it was compared with), n_shared
    (lines they share). NULL html counts as empty and gives an empty text; a page alone on its host has no nearest page;
    rows that are equal throughout are one page to the comparison and get the same text."""
    row = pages.select(F.col(id_column).cast("long").alias("page_id"), F.col(url_column).alias("url"), F.col(html_column).alias("html"))
    keyed = row.select(F.xxhash64("page_id", "url", "html").alias("key"), "page_id", "url", "html")
    outlined = outlines(keyed).groupBy("key").agg(*(F.first(c).alias(c) for c in ("page_id", "host", "path", "lines")))
    joined = keyed.join(shared_lines(outlined), "key")

    def run(batches):
        for batch in batches:
            rows = batch.to_pylist()
            for k in range(0, len(rows), 500):
                out = []
                for r in rows[k : k + 500]:
                    shared = set(r["shared"])
                    lines = read_page(r["html"] or "")
                    text = "\n".join(t for n, (t, state) in enumerate(lines) if state == KEEP or state == OPEN and n not in shared)
                    out.append((r["page_id"], r["url"], text, len(text), r["nearest"], len(shared)))
                kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64())
                names = ["page_id", "url", "text", "n_chars", "nearest", "n_shared"]
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)

    slim = joined.select("page_id", "url", "html", "nearest", "shared")
    return slim.mapInArrow(run, "page_id long, url string, text string, n_chars long, nearest long, n_shared long")
