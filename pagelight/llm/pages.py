"""Main text of HTML pages by structure and by differencing with the page of nearest URL.

A page is read as lines, one per block element.  Structure settles most of them: what stands in
an article or main element is text, what stands in navigation, footers, notices and the like is
not.  The remaining lines are settled by the page whose path is nearest among those of the
host that hold other content: the lines of both are aligned by their longest common subsequence,
and shared lines go.  Copies of one content tell nothing about each other's lines.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections.abc import Iterator
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagelight.llm import words
from pagelight.llm.storage import cut, stored

TEXT, OPEN, CHROME = 2, 1, 0

# Element names of HTML.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section "
    "summary table tbody td tfoot th thead tr ul".split())
NOT_TEXT = set("head nav footer aside form button dialog menu search label fieldset".split())
RAW = "script style noscript iframe textarea title".split()  # without an end tag they run to the end of the page
HIDDEN = "template svg math object select canvas audio video".split()  # without one they are a tag like others
# Words of class and id, and roles, that mark chrome: anywhere, and outside of articles only.
CHROME_NAMES = set(
    "ad ads adv advert advertisement advertising adsbygoogle banner breadcrumb breadcrumbs captcha comment comments commentlist "
    "consent cookie cookies disqus donate gdpr menu modal nav navbar navigation navi newsletter notice notices pagination paywall "
    "popup promo promoted promotion related replies reply respond share sharing sidebar social sponsor sponsored subscribe "
    "subscription teaser toolbar widget".split())
# Words that leave a name of these chrome when it stands in an article, as in "ad-slot" but not "share-price".
PART_NAMES = set(
    "area bar block body box btn button buttons container content count counter field form header icon icons inline inner item items "
    "left link links list panel right row section signup site slot tag title top unit user wrap wrapper".split())
OUTER_NAMES = set("bottom copyright foot footer head header masthead search topbar".split())
CHROME_ROLES = set("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search".split())

_ATTRIBUTES = r"""[^>"']*(?:"[^"]*"[^>"']*|'[^']*'[^>"']*)*"""
_HIDDEN = re.compile(
    rf"(?is)<(?:svg|math)\b{_ATTRIBUTES}(?<=/)>|<({'|'.join(RAW)})\b(?:{_ATTRIBUTES}|[^>]*)>.*?(?:</\1\s*>|\Z)"
    rf"|<({'|'.join(HIDDEN)})\b(?:{_ATTRIBUTES}|[^>]*)>.*?</\2\s*>|<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)")
_TAG = re.compile(rf"(?s)<(/?)([a-zA-Z][^\s/>]*)(?:({_ATTRIBUTES})>|([^>]*)(?:>|\Z))")
_NAMED = re.compile(r"""(?is)\b(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""")


def _is_chrome(name: str, attributes: str, inside: int) -> bool:
    if name in ("html", "body"):
        return False
    if name in NOT_TEXT or (name == "header" and inside != TEXT):
        return True
    if "=" not in attributes:
        return False
    for kind, value in _NAMED.findall(attributes):
        found = set(re.split(r"[^a-z0-9]+", value.lower()))
        if kind.lower() == "role":
            if found & CHROME_ROLES:
                return True
        elif inside == TEXT:
            for token in value.strip("\"'").lower().split():
                found = {part for part in re.split(r"[^a-z]+", token) if part}
                if found & CHROME_NAMES and found <= CHROME_NAMES | PART_NAMES:
                    return True
        elif found & CHROME_NAMES or found & OUTER_NAMES:
            return True
    return False


def page_lines(page: str) -> list[tuple[str, int]]:
    """(text, TEXT | OPEN | CHROME) of each block in page order; empty blocks are left out.

    Character references are decoded and each run of white space is one space.  Script, style and other
    raw elements, comments and markup are no text.  Elements that are not closed end with their parent,
    paragraphs and items with the next one; an article or main element is text wherever it stands.
    """
    source = _HIDDEN.sub("", page)
    stack: list[tuple[str, int]] = [("", OPEN)]
    lines: list[tuple[str, int]] = []
    pieces: list[tuple[str, int]] = []

    def flush() -> None:
        if pieces:
            kind = max(k for _, k in pieces)
            text = " ".join(entities.unescape("".join(t for t, k in pieces if k or not kind)).split())
            if text:
                lines.append((text, kind))
            pieces.clear()

    def close(name: str, stops: set[str]) -> None:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i][0] == name:
                del stack[i:]
                return
            if stack[i][0] in stops:
                return

    at = 0
    for tag in _TAG.finditer(source):
        if tag.start() > at:
            pieces.append((source[at : tag.start()], stack[-1][1]))
        at = tag.end()
        name = tag[2].lower()
        if name == "br":
            pieces.append((" ", stack[-1][1]))
        if name in BLOCK:
            flush()
        if tag[1]:
            close(name, set() if name in BLOCK else BLOCK)
        elif name not in VOID:
            if name in BLOCK:
                close("p", BLOCK - {"p"})
                if name == "li":
                    close("li", {"ul", "ol", "menu", "dir"})
                if name == "body":
                    close("head", set())
            inside = stack[-1][1]
            if _is_chrome(name, tag[3] or tag[4] or "", inside):
                inside = CHROME
            elif name in ("article", "main"):
                inside = TEXT
            stack.append((name, inside))
    if at < len(source):
        pieces.append((source[at:], stack[-1][1]))
    flush()
    return lines


def common_lines(a: list[int], b: list[int]) -> list[int]:
    """Positions in ``a`` of a longest common subsequence, by rows of bits, one of which is kept at a time."""
    found: list[int] = []
    parts = [(0, a, b)]
    while parts:
        at, a, b = parts.pop()
        n, m, head, tail = len(a), len(b), 0, 0
        while head < min(n, m) and a[head] == b[head]:
            head += 1
        while tail < min(n, m) - head and a[n - 1 - tail] == b[m - 1 - tail]:
            tail += 1
        found += [at + i for i in (*range(head), *range(n - tail, n))]
        at, a, b = at + head, a[head : n - tail], b[head : m - tail]
        if len(a) == 1 and a[0] in b:
            found.append(at)
        if len(a) < 2 or not b:
            continue
        # Some subsequence splits b where the halves of a have most in common with what is before and after.
        half = len(a) // 2
        before, after = _common(a[:half], b), _common(a[half:][::-1], b[::-1])[::-1]
        split = int(np.argmax(before + after))
        parts += [(at, a[:half], b[:split]), (at + half, a[half:], b[split:])]
    return sorted(found)


def _common(a: list[int], b: list[int]) -> np.ndarray:
    """Length of the longest common subsequence of ``a`` and each prefix of ``b``."""
    places: dict[int, int] = {}
    for j, x in enumerate(b):
        places[x] = places.get(x, 0) | 1 << j
    # Zeros up to place j count the common lines of what was read of a and b[:j + 1].
    row = everything = (1 << len(b)) - 1
    for x in a:
        hit = row & places.get(x, 0)
        row = ((row + hit) | (row - hit)) & everything
    bits = np.unpackbits(np.frombuffer(row.to_bytes(len(b) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(b)]
    return np.concatenate([[0], np.cumsum(bits == 0)])


def _address(url: str | None) -> tuple[str, str]:
    try:
        parts = urlsplit(url or "")
        return (parts.netloc or "").lower(), parts.path
    except ValueError:
        return "", url or ""


def _line_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        host, path, lists, open_lines, content = [], [], [], [], []
        for url, page in zip(words.column(batch, "url").to_pylist(), words.column(batch, "html").to_pylist()):
            address = _address(url)
            host.append(address[0])
            path.append(address[1])
            lines = page_lines(page or "")
            lists.append(_hashes([text for text, _ in lines]))
            open_lines.append(any(kind == OPEN for _, kind in lines))
            kept = lists[-1][np.array([kind != CHROME for _, kind in lines], bool)]
            content.append(int.from_bytes(hashlib.blake2b(kept.tobytes(), digest_size=8).digest(), "little", signed=True))
        yield pa.RecordBatch.from_arrays(
            [words.column(batch, "doc_id"), words.column(batch, "print"), pa.array(host, pa.string()), pa.array(path, pa.string()),
             pa.array(lists, pa.list_(pa.int64())), pa.array(open_lines, pa.bool_()), pa.array(content, pa.int64())],
            names=["doc_id", "print", "host", "path", "lines", "open", "content"])


def _hashes(lines: list[str]) -> np.ndarray:
    if not lines:
        return np.zeros(0, np.int64)
    texts = next(words.slices(pa.array(lines, pa.string()), 1 << 62))
    return words.hashes(texts.data, texts.offsets[:-1], texts.offsets[1:]).view(np.int64)


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Positions of the lines each page shares with the nearer of its neighbours."""

    def near(path: str, other: str | None) -> int:
        if other is None:
            return -1
        return next((i for i, (x, y) in enumerate(zip(path, other)) if x != y), min(len(path), len(other)))

    for batch in batches:
        rows = batch.to_pydict()
        out = []
        for path, own, before, after in zip(rows["path"], rows["lines"], rows["before"], rows["after"]):
            left, right = before and before["path"], after and after["path"]
            nearest = before if near(path, left) >= near(path, right) else after
            out.append(common_lines(own, nearest["lines"]) if nearest else [])
        yield pa.RecordBatch.from_arrays(
            [words.column(batch, "doc_id"), words.column(batch, "print"), pa.array(out, pa.list_(pa.int32()))],
            names=["doc_id", "print", "shared"])


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, deleted = [], []
        for page, shared in zip(words.column(batch, "html").to_pylist(), words.column(batch, "shared").to_pylist()):
            gone = set(shared or ())
            lines = page_lines(page or "")
            kept = [text for i, (text, kind) in enumerate(lines) if kind == TEXT or (kind == OPEN and i not in gone)]
            texts.append("\n".join(kept))
            deleted.append(len(lines) - len(kept))
        yield pa.RecordBatch.from_arrays(
            [words.column(batch, "doc_id"), words.column(batch, "url"), pa.array(texts, pa.string()), pa.array(deleted, pa.int64())],
            names=["doc_id", "url", "text", "lines_deleted"])


def main_text(html: DataFrame) -> DataFrame:
    """(doc_id, url, text, lines_deleted) of every row of ``html`` (doc_id, url, html).

    ``text`` joins the lines that stay by line feeds.  Null and empty html gives the empty text; a null or
    broken url is a page of the host without a name.  Pages of a host with the same lines, chrome aside, are copies
    (print views, parameters, mirror paths) and never partners.  A page without another content on its host has no
    shared line and keeps its open ones.  An open line that the partner has too is taken for furniture, also where
    the partner quotes it or is a copy with changes.
    Rows that repeat an id, url and html repeat their answer.  An empty frame gives no rows.  Further columns
    are ignored.

    Pages are put in the order of host and path by ranges, so a host of any size is many tasks, and
    only line hashes travel: the neighbours at a range's ends are looked up in the next range.
    """
    pages = html.select("doc_id", "url", "html", F.xxhash64("url", "html").alias("print"))
    lines = pages.mapInArrow(
        _line_hashes,
        "doc_id long, print long, host string, path string, lines array<long>, open boolean, content long").distinct()
    place = ["host", "path", "doc_id", "print"]
    ranged = cut(lines.repartitionByRange(*place).withColumn("range", F.spark_partition_id()))
    row = F.struct("host", "path", "lines", "content")
    up = Window.partitionBy("range").orderBy(*place)
    down = Window.partitionBy("range").orderBy(*[F.desc(name) for name in place])

    def other(neighbour, own):
        """The neighbour where a run of one content ends."""
        return F.when((neighbour["host"] != own["host"]) | (neighbour["content"] != own["content"]), neighbour)

    def last(candidate, order):
        return F.last(candidate, ignorenulls=True).over(order)

    # The neighbours of a run stand at its border: null within the first and last run of a range.
    runs = ranged.withColumn("row", row).withColumn("before", last(other(F.lag("row").over(up), F.col("row")), up))
    runs = runs.withColumn("after", last(other(F.lag("row").over(down), F.col("row")), down))
    ends = runs.groupBy("range").agg(
        F.min_by("row", F.struct(*place)).alias("first"), F.max_by("row", F.struct(*place)).alias("last"),
        F.min_by("after", F.struct(*place)).alias("second"), F.max_by("before", F.struct(*place)).alias("last_but_one"))
    # One row per range.  A run that fills ranges takes its neighbour from beyond them.
    upward, downward = Window.partitionBy().orderBy("range"), Window.partitionBy().orderBy(F.desc("range"))
    ends = ends.select(
        "range",
        last(F.coalesce(other(F.lag("last").over(upward), F.col("first")), F.lag("last_but_one").over(upward)), upward).alias("earlier"),
        last(F.coalesce(other(F.lag("first").over(downward), F.col("last")), F.lag("second").over(downward)), downward).alias("later"))

    def of_host(page):
        return F.when(page["host"] == F.col("host"), page)

    neighbours = runs.filter("open").join(ends, "range").select(
        "doc_id", "print", "path", "lines",
        of_host(F.coalesce("before", "earlier")).alias("before"), of_host(F.coalesce("after", "later")).alias("after"))
    shared = neighbours.mapInArrow(_shared, "doc_id long, print long, shared array<int>").filter("size(shared) > 0")
    # Stored, so that its size is known when the pages are joined: html is only shuffled where many lines are shared.
    shared = stored(shared).withColumnsRenamed({"doc_id": "__doc", "print": "__print"})
    same = F.col("doc_id").eqNullSafe(F.col("__doc")) & (F.col("print") == F.col("__print"))
    return pages.join(shared, same, "left").mapInArrow(
        _texts, "doc_id long, url string, text string, lines_deleted long")
