"""Main text of web pages by nearest-URL page differencing.

Each page becomes lines (the text between block-level tags and line breaks). Pages of a host are ordered by URL path; each is compared with the page that
shares the longest path prefix, the nearest of equals, by the longest common subsequence of their lines. Shared lines are deleted, for they belong
to the host and not to the page. Pages of a host with the same lines are one page here. A near copy of the page says nothing
about the host, so the search goes on to the next nearest; lines that at least half of the pages around have don't make a copy.

Two things differencing can't know, and mark-up tells. Articles quote passages: a shared line of an article stays if the articles of less than half of the
host's pages have it, for then it isn't the host's. And comments, adverts, menus and the like differ from page to page: what the difference leaves of elements that
are boilerplate by their tag, class, id or role goes too. ``n_shared`` and ``n_marked`` say how many lines each of them took.

Only hashes of lines are compared across pages; the texts are shuffled once, to meet the numbers of their shared lines.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape
from urllib.parse import urlsplit

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.shared import Scratch, text_batches

#: Pages in URL order are compared within blocks of so many; each block also sees the page before and the page after it.
BLOCK = 64
#: A page that shares more than this of the lines that aren't the host's by their frequency is a copy.
COPY = 0.9

_OPEN = re.compile(r"<(?:!--|[!?]|(/?)([a-zA-Z][a-zA-Z0-9:-]*))")
_STOP = re.compile(r"[>\"']")
#: Elements whose content is no text of the page, up to their end tag.
_RAW = {name: re.compile(rf"</{name}\s*>", re.I) for name in "script style textarea title noscript template iframe svg select object".split()}
_MARK = re.compile(r"\b(?:class|id|role|aria-label)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
_OUT = frozenset("head nav footer aside form button dialog menu menuitem fieldset".split())
_OUT_WORDS = frozenset(
    "ad ads adv advert adverts advertisement adsense adslot sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay "
    "nav navbar navigation menu breadcrumb breadcrumbs sidebar footer masthead comment comments respond replies disqus discussion share sharing social related recommended recommendations "
    "newsletter subscribe subscription signup login search form widget pagination pager toolbar skip complementary contentinfo".split()
)

IN_ARTICLE, OUT, LINKS = 1, 2, 4


def _tags(html: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """(begin, end, name, closing, attributes) of each tag, comment or declaration (no name), raw elements with their content. Each character is looked at a
    bounded number of times, whatever is left unclosed: a tag or quote without an end is plain text, a comment or raw element runs to the end."""
    at, lost = 0, {'"': False, "'": False}
    while m := _OPEN.search(html, at):
        begin, name = m.start(), (m[2] or "").lower()
        if m[0] == "<!--":
            end = html.find("-->", m.end())
            at = len(html) if end < 0 else end + 3
            yield begin, at, "", False, ""
            continue
        stop = m.end()
        while found := _STOP.search(html, stop):
            stop, quote = found.end(), found[0]
            if quote == ">":
                break
            if not lost[quote]:
                close = html.find(quote, stop)
                lost[quote] = close < 0  # then no later one has an end either
                stop = stop if close < 0 else close + 1
        if not found:
            return
        attributes, at = html[m.end() : stop - 1], stop
        if name in _RAW and not m[1]:
            close = _RAW[name].search(html, stop)
            at = close.end() if close else len(html)
        yield begin, at, name, bool(m[1]), attributes


def page_lines(html: str) -> list[tuple[str, int]]:
    """(line, flags) in page order; white space within a line is one space, character references are decoded, empty lines left out."""
    lines: list[tuple[str, int]] = []
    stack: list[tuple[str, bool, bool]] = []  # name, out, article
    depth: dict[str, int] = {}  # open elements by name
    parts: list[str] = []
    linked = 0
    out = article = False

    def flush() -> None:
        nonlocal linked
        text = " ".join(unescape("".join(parts)).split()) if parts else ""
        if text:
            lines.append((text, IN_ARTICLE * article | OUT * out | LINKS * (2 * linked > len(text))))
        parts.clear()
        linked = 0

    at = 0
    for begin, end, name, closing, attributes in _tags(html):
        if begin > at:
            parts.append(html[at:begin])
            if depth.get("a"):
                linked += begin - at
        at = end
        if not name:
            continue
        if name not in _INLINE:
            flush()
        if name in _VOID or (name in _RAW and not closing):
            continue
        if closing:
            if depth.get(name):
                while True:
                    last = stack.pop()[0]
                    depth[last] -= 1
                    if last == name:
                        break
            out, article = stack[-1][1:] if stack else (False, False)
            continue
        if not attributes.rstrip().endswith("/"):
            words: set[str] = set()
            if attributes and name not in ("html", "body", "main") and name not in _INLINE:
                for mark in _MARK.findall(attributes):
                    words.update(re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", mark).lower()))
            out = out or name in _OUT or bool(words & _OUT_WORDS) or (not article and (name == "header" or bool(words & {"header", "banner"})))
            article = article or name in ("article", "main")
            stack.append((name, out, article))
            depth[name] = depth.get(name, 0) + 1
    if at < len(html):
        parts.append(html[at:])
    flush()
    return lines


def decide(flags: list[int]) -> list[int]:
    """Of each line: 0 goes by the page's own mark-up if the difference leaves it, 1 stays unless shared, 2 (in an article) stays unless shared and the host's."""
    return [0 if f & OUT else 2 if f & IN_ARTICLE else 0 if f & LINKS else 1 for f in flags]


def _steps(a: list[int], b: list[int]) -> Iterator[int]:
    """After each element of a, the bits of b: bit j is unset where a longest common subsequence with b up to j is one longer than up to j - 1."""
    full, where = (1 << len(b)) - 1, {}
    for j, x in enumerate(b):
        where[x] = where.get(x, 0) | 1 << j
    v = full
    for x in a:
        u = v & where.get(x, 0)
        v = ((v + u) | (v - u)) & full
        yield v


def _prefix_lengths(a: list[int], b: list[int]) -> np.ndarray:
    """Of all of a with each prefix of b, the length of a longest common subsequence."""
    v = (1 << len(b)) - 1
    for v in _steps(a, b):  # noqa: B007
        pass
    bits = np.unpackbits(np.frombuffer(v.to_bytes(len(b) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(b)]
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def common_lines(a: list[int], b: list[int], cells: int = 1 << 28) -> list[int]:
    """Places in a of a longest common subsequence of a and b (bit-parallel, a machine word of b at a time). Beyond ``cells`` bits, a is halved where b is best cut."""
    if len(a) * len(b) > cells and len(a) > 1:
        mid = len(a) // 2
        cut = int(np.argmax(_prefix_lengths(a[:mid], b) + _prefix_lengths(a[:mid - 1:-1], b[::-1])[::-1]))
        return common_lines(a[:mid], b[:cut], cells) + [mid + k for k in common_lines(a[mid:], b[cut:], cells)]
    rows = list(_steps(a, b))
    i, j, out = len(a) - 1, len(b) - 1, []
    while i >= 0 and j >= 0:
        if rows[i] >> j & 1:
            j -= 1
        elif i and not rows[i - 1] >> j & 1:
            i -= 1
        else:
            out.append(i)
            i, j = i - 1, j - 1
    return out[::-1]


def host_and_path(url: str) -> tuple[str, str]:
    try:
        parts = urlsplit(url.strip())
        return (parts.hostname or "").removeprefix("www."), parts.path.rstrip("/")
    except ValueError:
        return "", url


def _lines_of(url: str | None, html: str | None) -> tuple[str, str, bytes, list[str], list[int], list[int]]:
    """Host, path, a name for the page's lines as a whole, the lines, their hashes and kinds."""
    from hashlib import blake2b

    host, path = host_and_path(url or "")
    found = page_lines(html or "")
    texts, kinds = [t for t, _ in found], decide([f for _, f in found])
    digests = [blake2b(t.encode("utf-8", "replace"), digest_size=8).digest() for t in texts]
    return host, path, blake2b(b"".join(digests) + bytes(kinds), digest_size=16).digest(), texts, [int.from_bytes(d, "little", signed=True) for d in digests], kinds


def _line_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in text_batches(batches, "html"):
        host, path, whole, _, hashes, kinds = zip(*(_lines_of(u, h) for u, h in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)), strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(host, pa.string()), pa.array(path, pa.string()), pa.array(whole, pa.binary()), pa.array(hashes, pa.list_(pa.int64())), pa.array(kinds, pa.list_(pa.int32()))], ["host", "path", "whole", "hashes", "kinds"])


def _prefix(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        n += 1
    return n


def frequent_lines(pages: list[dict]) -> dict[str, set[int]]:
    """By host, the lines that at least half of its pages (three at least) have."""
    by: dict[str, list[set[int]]] = {}
    for p in pages:
        by.setdefault(p["host"], []).append(set(p["hashes"]))
    return {host: {h for h, n in Counter(h for x in own for h in x).items() if 2 * n >= len(own) > 2} for host, own in by.items()}


def shared_with_nearest(pages: list[dict], i: int, frequent: set[int]) -> list[int]:
    """Numbers of the lines that pages[i] shares with the nearest page of its host that is no copy of it. pages: host, path, hashes and kinds of each, in URL order."""
    own = pages[i]
    mine = own["hashes"]
    text = {k for k, (h, kind) in enumerate(zip(mine, own["kinds"], strict=True)) if kind and h not in frequent}
    others = [j for j, p in enumerate(pages) if j != i and p["host"] == own["host"]]
    for j in sorted(others, key=lambda j: (-_prefix(pages[j]["path"], own["path"]), abs(j - i), j)):
        shared = common_lines(mine, pages[j]["hashes"])
        if sum(k in text for k in shared) <= COPY * len(text):
            return shared
    return []


def _compare(rows: pd.DataFrame) -> pd.DataFrame:
    pages = [r | {"hashes": list(r["hashes"])} for r in rows.sort_values("g", kind="stable").to_dict("records")]
    out, frequent = [], frequent_lines(pages)
    for i, r in enumerate(pages):
        if r["own"]:
            out += [(r["host"], r["whole"], k, r["hashes"][k], r["kinds"][k] == 2) for k in shared_with_nearest(pages, i, frequent[r["host"]])]
    return pd.DataFrame(out, columns=["host", "whole", "line", "hash", "article"])


def quotations(lines: DataFrame) -> DataFrame:
    """(host, hash) of lines that stand in the articles of less than half of the host's pages. lines: one row a page."""
    own = F.array_distinct(F.transform(F.filter(F.arrays_zip("hashes", "kinds"), lambda x: x["kinds"] == 2), lambda x: x["hashes"]))
    on = lines.select("host", F.explode(own).alias("hash")).groupBy("host", "hash").agg(F.count(F.lit(1)).alias("pages"))
    sizes = lines.groupBy("host").agg(F.count(F.lit(1)).alias("size"))
    return on.join(sizes, "host").filter("2 * pages < size").select("host", "hash")


def shared_lines(pages: DataFrame, scratch: Scratch) -> DataFrame:
    """(host, whole, shared): numbers of the lines that a page (named by its host and all its lines) shares with its nearest page and doesn't quote; only pages with such lines."""
    lines = pages.mapInArrow(_line_hashes, "host string, path string, whole binary, hashes array<long>, kinds array<int>")
    lines = lines.groupBy("host", "whole").agg(F.min("path").alias("path"), F.first("hashes").alias("hashes"), F.first("kinds").alias("kinds"))
    order = ["host", "path", "whole"]
    lines = lines.repartitionByRange(*order).sortWithinPartitions(*order)
    lines = scratch.save(lines.withColumn("at", F.monotonically_increasing_id()), "line-hashes")
    part = F.shiftright("at", 33)
    before, table = 0, []
    for r in sorted(lines.groupBy(part.alias("part")).count().collect()):
        table.append((r["part"], before))
        before += r["count"]
    if not table:
        return lines.select("host", "whole", F.array().cast("array<int>").alias("shared"))
    offsets = F.create_map(*(F.lit(x) for row in table for x in row)) if len(table) <= 1000 else None
    if offsets is not None:
        placed = lines.withColumn("g", F.try_element_at(offsets, part) + F.col("at").bitwiseAND(F.lit((1 << 33) - 1)))
    else:
        starts = pages.sparkSession.createDataFrame(table, "part long, before long")
        placed = lines.withColumn("part", part).join(starts, "part").withColumn("g", F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1)))
    block, place = F.floor(F.col("g") / BLOCK).cast("long"), F.col("g") % BLOCK
    seats = F.array_compact(F.array(F.struct(block.alias("block"), F.lit(True).alias("own")), F.when(place == 0, F.struct((block - 1).alias("block"), F.lit(False).alias("own"))), F.when(place == BLOCK - 1, F.struct((block + 1).alias("block"), F.lit(False).alias("own")))))
    seated = placed.select("host", "path", "whole", "hashes", "kinds", "g", F.explode(seats).alias("s")).select("*", "s.block", "s.own").drop("s")
    found = scratch.save(seated.groupBy("block").applyInPandas(_compare, "host string, whole binary, line int, hash long, article boolean"), "found")
    quoted = quotations(lines).withColumn("article", F.lit(True))
    return found.join(quoted, ["host", "hash", "article"], "left_anti").groupBy("host", "whole").agg(F.collect_list("line").alias("shared"))


def _all_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in text_batches(batches, "html"):
        host, _, whole, texts, _, kinds = zip(*(_lines_of(u, h) for u, h in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)), strict=True)
        texts = [[t if k else "" for t, k in zip(*x, strict=True)] for x in zip(texts, kinds, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(host, pa.string()), pa.array(whole, pa.binary()), pa.array(texts, pa.list_(pa.string())), pa.array(kinds, pa.list_(pa.int32()))], ["page_id", "url", "host", "whole", "lines", "kinds"])


def extract(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per input row: page_id, url, text, n_chars, n_shared (lines that the difference deletes), n_marked (lines that only mark-up deletes).

    Lines that are kept are joined by one space in page order. Null or empty html gives empty text; a null url has an empty host and path and is
    compared with others like it. Of pages at the same distance the earlier in the order (host, path) is taken.
    Pages of a host with the same lines, rows repeated as a whole among them, get the same text. Broken mark-up never fails: an unclosed tag is
    text, an unclosed comment or script runs to the end. Time and memory grow with the longest page. An empty
    table gives an empty result; other columns are ignored."""
    scratch = Scratch(df.sparkSession, "html")
    pages = df.select(df[id_col].cast("long").alias("page_id"), df[url_col].alias("url"), F.coalesce(df[html_col], F.lit("")).alias("html"))
    shared = scratch.save(shared_lines(pages, scratch), "shared").withColumnsRenamed({"host": "h", "whole": "w"})
    lines = pages.mapInArrow(_all_lines, "page_id long, url string, host string, whole binary, lines array<string>, kinds array<int>")
    both = lines.join(shared, (lines["host"] == F.col("h")) & (lines["whole"] == F.col("w")), "left").withColumn("shared", F.coalesce("shared", F.array().cast("array<int>")))
    stays = F.filter(F.transform(F.arrays_zip("lines", "kinds"), lambda x, i: F.when((x["kinds"] > 0) & ~F.array_contains(F.col("shared"), i), x["lines"])), lambda t: t.isNotNull())
    marked = F.size(F.filter("kinds", lambda k, i: (k == 0) & ~F.array_contains(F.col("shared"), i)))
    text = F.array_join(stays, " ")
    return both.select("page_id", "url", text.alias("text"), F.size("shared").cast("long").alias("n_shared"), marked.cast("long").alias("n_marked")).withColumn("n_chars", F.length("text").cast("long"))
