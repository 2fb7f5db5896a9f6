"""Main text of web pages by nearest-URL page differencing, with the page's markup as guard.

Pages become lines: the texts of their blocks. Of each host's different pages, in order of URL path, every page is paired
with the nearer of its two neighbours by path, and the lines that the longest common subsequence of the two shares are
deleted: what two pages of one place have in common is their template. Markup guards the rest: lines within an article or
main element are kept whatever other pages hold, as an article may repeat a sentence, and elements that are furniture
by tag, role, class or id are left out, as they may differ from page to page.
"""

from __future__ import annotations

import hashlib
import html
import math
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.llm.scratch import Scratch

SEGMENT = 1 << 16  # pages in order of URL that one group holds
HOT = 1000  # a page with more than this share (one in HOT) of all rows as its copies is joined by broadcast
_ROOT, _BAD = 1, 2  # flags of lines

# Quotes count only after an equals sign, as in HTML; elsewhere they are letters like others.
_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]|=\s*+(?:"[^"]*(?:"|\Z)|'[^']*(?:'|\Z)|(?!["'])))*+)(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_RAW = frozenset("script style noscript template textarea title iframe svg noembed noframes".split())
_FURNITURE = frozenset("nav footer aside menu dialog button select option object embed canvas audio video head".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr td th input label "
    "math mi mn mo mrow ms msub msup mfrac mtext semantics".split()
)
_ROOTS = frozenset(("article", "main"))
_FRAMED = frozenset("article main nav header footer".split())  # a form that holds one of these is the page's frame
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 a span".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
#: Words of class names and ids of furniture; a name is furniture's if it has such a word and else only ``_GENERIC`` ones.
_NAMES = frozenset(
    "nav navbar navigation menu menubar breadcrumb breadcrumbs masthead banner footer foot sidebar aside widget widgets ad ads adv advert adverts advertisement advertising adsbygoogle sponsor sponsored "
    "promo promotion promoted cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login social share sharing related recommended "
    "recommendations comment comments reply replies respond disqus discussion search pagination pager copyright legal disclaimer toolbar skip paywall".split()
)
_GENERIC = frozenset(
    "a an the of and our your site page web main global primary secondary top bottom left right center inner outer first last header head body content box slot list section area zone region wrapper wrap "
    "container holder block item items link links bar unit units module panel column col row group text title label heading icon icons button buttons btn form thread count counts author user reader readers "
    "view post posts article story entry stories articles blog google wp js ui id class div sticky fixed mobile desktop large small big wide full new show hide policy accept message messages dialog window tab tabs".split()
)
_HEADERS = frozenset(("header", "topbar"))
#: Words that, as the id of a part of an article, more often name its subject.
_SUBJECTS = frozenset("discussion related notice notices legal disclaimer search alert share sharing subscription social promotion advertising consent comment reply recommendations".split())


def _attributes(raw: str) -> dict[str, str]:
    found = {}
    for m in _ATTRIBUTE.finditer(raw):
        found.setdefault(m[1].lower(), html.unescape(m[2] or m[3] or m[4] or ""))
    return found


def _words(name: str) -> set[str]:
    return set(re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", name).lower()))


def _named(words: set[str], names: frozenset) -> bool:
    return bool(words & names) and words <= names | _GENERIC


def _is_furniture(tag: str, raw: str, in_root: bool) -> bool:
    if tag in _FURNITURE or tag == "header" and not in_root:
        return True
    if not raw.strip() or tag in ("html", "body"):
        return False
    at = _attributes(raw)
    if "hidden" in at or at.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none", at.get("style", "")):
        return True
    if at.get("role", "").lower() in _ROLES:
        return True
    names = _NAMES if in_root else _NAMES | _HEADERS
    if any(_named(_words(c), names) for c in at.get("class", "").split()):
        return True
    return "id" in at and not (in_root and tag in _HEADINGS) and _named(_words(at["id"]), names - _SUBJECTS if in_root else names)


def page_blocks(source: str | None) -> list[tuple[str, bool, bool]]:
    """The page's blocks in order, as (text, in an article or main element, furniture). Broken or cut markup is read as
    far as it goes."""
    source = source or ""
    blocks: list[tuple[str, bool, bool, tuple]] = []
    stack: list[tuple[str, bool, bool, tuple]] = []  # tag, furniture, in root, forms around
    parts: list[str] = []
    frames: set[int] = set()
    bad = in_root = False
    forms: tuple[int, ...] = ()
    at = 0

    def flush() -> None:
        text = " ".join("".join(parts).split())
        parts.clear()
        if text:
            blocks.append((text, in_root, bad, forms))

    while at < len(source):
        m = _TOKEN.search(source, at)
        if not m:
            parts.append(html.unescape(source[at:]))
            break
        if m.start() > at:
            parts.append(html.unescape(source[at : m.start()]))
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if tag not in _INLINE:
            flush()
        elif tag in ("td", "th"):
            parts.append(" ")
        if m[1]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    if tag in _INLINE and any(s[1] for s in stack[k:]):
                        flush()
                    del stack[k:]
                    bad, in_root, forms = stack[-1][1:] if stack else (False, False, ())
                    break
            continue
        if tag in _VOID or tag == "svg" and m[3].endswith("/"):
            continue
        if tag in _RAW or tag == "xmp":
            end = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(source, at)
            if tag == "xmp":  # its content is text as it stands
                parts.append(source[at : end.start() if end else len(source)])
                flush()
            close = source.find(">", end.end() - 1) if end else -1
            at = len(source) if close < 0 else close + 1
            continue
        worse = bad or _is_furniture(tag, m[3], in_root)
        if worse != bad:
            flush()
        bad = worse
        if tag in _FRAMED:
            frames.update(forms)
        if tag == "form":
            forms = (*forms, m.start())
        if tag in _ROOTS:
            in_root = in_root or not bad
        if tag not in ("p", "li", "dt", "dd") or worse:
            stack.append((tag, bad, in_root, forms))
    flush()
    return [(text, root, bad or any(f not in frames for f in forms)) for text, root, bad, forms in blocks]


def _rows_of(mine: list, masks: dict, full: int, start: int) -> list[int]:
    """The vectors of the bit-parallel longest common subsequence after each of ``mine``, from vector ``start``."""
    out = [start]
    for x in mine:
        v = out[-1]
        u = v & masks.get(x, 0)
        out.append(((v + u) | (v - u)) & full)
    return out


def shared_lines(mine: list, other: list) -> set[int]:
    """Places in ``mine`` of a longest common subsequence with ``other``. The vectors have a bit for each of ``other``;
    of n of them, only some 2 * sqrt(n) are held at a time."""
    head = 0
    while head < min(len(mine), len(other)) and mine[head] == other[head]:
        head += 1
    tail = 0
    while tail < min(len(mine), len(other)) - head and mine[-1 - tail] == other[-1 - tail]:
        tail += 1
    found = {*range(head), *range(len(mine) - tail, len(mine))}
    mine, other = mine[head : len(mine) - tail], other[head : len(other) - tail]
    if not mine or not other:
        return found
    full, step, masks, wanted = (1 << len(other)) - 1, math.isqrt(len(mine)) + 1, {}, set(mine)
    for k, x in enumerate(other):
        if x in wanted:
            masks[x] = masks.get(x, 0) | 1 << k
    marks = [full]
    for k in range(0, len(mine), step):
        marks.append(_rows_of(mine[k : k + step], masks, full, marks[-1])[-1])
    column = len(other)
    for block in range((len(mine) - 1) // step, -1, -1):
        start = block * step
        rows = _rows_of(mine[start : start + step], masks, full, marks[block])
        row = len(rows) - 1
        while row and column:
            if rows[row] >> (column - 1) & 1:
                column -= 1
            else:
                row -= 1
                if rows[row] >> (column - 1) & 1:
                    found.add(head + start + row)
                    column -= 1
    return found


def deleted_lines(lines: list, flags: list[int], neighbours: list[list]) -> list[int]:
    """The places of the lines that differencing deletes, given the neighbours' lines, nearest first. Guarded lines never
    are. A neighbour that leaves less than a twentieth of the lines that aren't furniture may be a copy of the page rather
    than another of its kind, so the next one is tried; where all leave as little, the one that leaves most counts, and
    one that leaves nothing doesn't."""
    bodies = [k for k, f in enumerate(flags) if not f & _BAD]
    best, most = set(), 0
    for other in neighbours:
        if not other:  # a page without lines shows no template
            continue
        shared = shared_lines(lines, other)
        left = sum(k not in shared for k in bodies)
        if left > most:
            best, most = shared, left
        if 20 * left >= len(bodies) > 0:
            break
    return [k for k, f in enumerate(flags) if not f & _ROOT and k in best]


def main_text(texts: list[str], flags: list[int], deleted: list[int]) -> str:
    gone = set(deleted)
    return "\n".join(t for k, (t, f) in enumerate(zip(texts, flags)) if not f & _BAD and k not in gone)


def _line_hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


_BLOCKS = "page_id long, url string, host string, path string, texts array<string>, flags array<byte>, hashes array<long>, sig binary"


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, flags, hashes, sigs = [], [], [], []
        for source in batch.column(4).to_pylist():
            blocks = page_blocks(source)
            texts.append([t for t, _, _ in blocks])
            flags.append([_ROOT * root + _BAD * bad for _, root, bad in blocks])
            hashes.append([_line_hash(t) for t, _, _ in blocks])
            sigs.append(hashlib.blake2b(np.array(hashes[-1], np.int64).tobytes() + bytes(flags[-1]), digest_size=16).digest())
        kinds = (pa.list_(pa.string()), pa.list_(pa.int8()), pa.list_(pa.int64()), pa.binary())
        yield pa.RecordBatch.from_arrays([*batch.columns[:4], *(pa.array(c, t) for c, t in zip((texts, flags, hashes, sigs), kinds))], ["page_id", "url", "host", "path", "texts", "flags", "hashes", "sig"])


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    run, at = TaskContext.get().partitionId(), 0
    for batch in batches:
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(batch), run), pa.int32()), pa.array(np.arange(at, at + len(batch)), pa.int64())], [*batch.schema.names, "run", "pos"])
        at += len(batch)


def _ends(table: pa.Table) -> pa.Table:
    """The first and the last page of a segment."""
    table = table.sort_by("pos")
    return pa.concat_tables([table.slice(0, 1), table.slice(table.num_rows - 1, 1)]).select(["run", "segment", "pos", "host", "path", "sig"])


def _common(a: str, b: str) -> int:
    n = min(len(a), len(b))
    return next((k for k in range(n) if a[k] != b[k]), n)


def _pairs(around: dict) -> Callable:
    """Pairs each page of a segment with the neighbours of its host, the nearer by path first, then the one before.
    around: by (run, segment) the page before and the page after the segment."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("pos")
        pages = list(zip(*(table.column(c).to_pylist() for c in ("host", "path", "sig"))))
        before, after = around[table.column("run")[0].as_py(), table.column("segment")[0].as_py()]
        line = [before, *pages, after]
        rows = []
        for k, (host, path, sig) in enumerate(pages, 1):
            near = sorted((-_common(path, n[1]), turn, n[2]) for turn, n in enumerate((line[k - 1], line[k + 1])) if n and n[0] == host)
            rows.append((host, sig, *[n[2] for n in near], *[None] * (2 - len(near))))
        return pa.table([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.binary(), pa.binary(), pa.binary()))], names=["host", "sig", "first", "second"])

    return run


def _differenced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = [deleted_lines(mine, flags, [x or [] for x in near]) for mine, flags, *near in zip(*(c.to_pylist() for c in batch.columns[2:]))]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.int32()))], ["host", "sig", "deleted"])


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = [main_text(t, f, d or ()) for t, f, d in zip(*(c.to_pylist() for c in batch.columns[2:]))]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], ["page_id", "url", "text", "n_chars"])


def page_differences(scratch: Scratch, blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From pages' lines (``_BLOCKS``): the different pages of each host (host, sig, copies), and for each (host, sig) the
    places of the lines that differencing deletes. Pages of no host have no neighbours and aren't there.

    Copies, pages with the same lines, count once, at their least path. Neighbours are told on rows of some hundred
    bytes, sorted by host and path over all tasks; the pages at the ends of a task's run or of ``SEGMENT`` pages pass by
    way of the driver, one row for each end. So the result doesn't depend on how pages are dealt out."""
    place = F.min(F.struct("path", "page_id")).alias("place")
    reps = scratch.table("reps", blocks.where("host != ''").groupBy("host", "sig").agg(place, F.first("hashes").alias("hashes"), F.first("flags").alias("flags"), F.count("*").alias("copies")))
    keys = reps.select("host", "place.path", "place.page_id", "sig")
    order = ("host", "path", "page_id", "sig")
    numbered = keys.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_numbered, "host string, path string, page_id long, sig binary, run int, pos long")
    segments = scratch.table("order", numbered).withColumn("segment", F.floor(F.col("pos") / SEGMENT).cast("int"))
    ends: dict[tuple[int, int], list] = {}
    for r in segments.groupBy("run", "segment").applyInArrow(_ends, "run int, segment int, pos long, host string, path string, sig binary").orderBy("run", "segment", "pos").collect():
        ends.setdefault((r.run, r.segment), []).append((r.host, r.path, bytes(r.sig)))
    line = [ends[k] for k in sorted(ends)]
    around = {k: (line[n - 1][-1] if n else None, line[n + 1][0] if n + 1 < len(line) else None) for n, k in enumerate(sorted(ends))}
    near = segments.groupBy("run", "segment").applyInArrow(_pairs(around), "host string, sig binary, first binary, second binary")
    lines = lambda name: reps.select(F.col("host").alias(f"{name}_host"), F.col("sig").alias(f"{name}_sig"), F.col("hashes").alias(f"{name}_lines"))
    both = near.join(reps.select("host", "sig", "hashes", "flags"), ["host", "sig"])
    for name in ("first", "second"):
        both = both.join(lines(name), (F.col("host") == F.col(f"{name}_host")) & (F.col(name) == F.col(f"{name}_sig")), "left")
    both = both.select("host", "sig", "hashes", "flags", "first_lines", "second_lines")
    return reps, scratch.table("deleted", both.mapInArrow(_differenced, "host string, sig binary, deleted array<int>"))


def extract_main_text(pages: DataFrame, owner: str = "op6") -> DataFrame:
    """The main text of every row of ``pages`` (page_id, url, html; others are ignored).

    Returns page_id, url, text (blocks in page order, joined by newlines; empty if there are none) and n_chars, a row
    for each row. A null html counts as empty. A page whose url is null or names no host has no neighbours, so nothing of
    it is deleted for being shared. Pages with equal lines share neighbours and result; of pages with equal url the one
    with the smaller page_id comes first, null before all. The result depends on the rows alone, not on how they are
    dealt out or ordered. An empty table gives no rows.
    """
    scratch = Scratch(pages.sparkSession, owner)
    parts = r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)(.*)$"
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.lower(F.regexp_extract(url, parts, 1)).alias("host"), F.regexp_extract(url, parts, 2).alias("path"), F.col("html").cast("string").alias("html"))
    blocks = scratch.table("blocks", rows.mapInArrow(_extract, _BLOCKS), dense=True)
    reps, deleted = page_differences(scratch, blocks)
    deleted = deleted.where(F.size("deleted") > 0)
    # Pages of which each line is guarded or furniture are settled by that, whatever their neighbours share.
    settled = F.forall("flags", lambda f: f != 0) | (F.col("host") == "")
    rest = blocks.where(~settled)
    # A page with very many copies meets its deletions by broadcast: there are HOT such pages at most.
    total = blocks.count()
    hot = scratch.table("hot", reps.where(F.col("copies") > max(HOT, total // HOT)).select("host", "sig").join(deleted, ["host", "sig"]))
    held = rest.join(F.broadcast(hot.select("host", "sig", F.col("deleted").alias("of_hot"))), ["host", "sig"], "left")
    cold = held.where("of_hot is null").join(deleted.join(F.broadcast(hot.select("host", "sig")), ["host", "sig"], "left_anti"), ["host", "sig"], "left")
    fields = ["page_id", "url", "texts", "flags", "deleted"]
    every = blocks.where(settled).withColumn("deleted", F.lit(None).cast("array<int>")).select(fields)
    every = every.unionByName(held.where("of_hot is not null").withColumn("deleted", F.col("of_hot")).select(fields)).unionByName(cold.select(fields))
    return every.mapInArrow(_joined, "page_id long, url string, text string, n_chars long")

