"""Removal of repeated passages with suffix arrays.

Every byte goes that is covered by a string of ``LENGTH`` bytes that starts anywhere else too, in any document.

A suffix array of all texts can't be built in one place, so equal strings are first brought together. Each string of LENGTH bytes has an
anchor: the run of ``GRAM`` bytes in it whose hash is least, the last of equals. It depends on the string alone, so equal strings
have equal anchors at equal offsets. All strings of a text that share an anchor form its context, a stretch of a few hundred bytes.
1. Anchors that occur once in the corpus are done: nothing in their context is repeated.
2. Contexts that occur more than once as a whole are repeated as a whole. Hashes of the anchor and of the context tell where to look; then each is compared byte by byte
   with another one: the first in its part of the table, which is compared with the first of all. Neighbouring contexts that
   have the same offset to the same text are compared as one stretch, so a copy is sent about once, and of equal copies that a task finds one is sent. If two differ, all is done again with other hashes.
3. What is left are different contexts around one anchor: where passages begin and end, or copies differ. They are brought together by
   anchor, one for each distinct context. A suffix array (grouping construction, over the words of all of a task's contexts) puts
   equal strings side by side, and neighbours are compared byte by byte.
   Anchors with very many different contexts would be one task's work. They are made longer: each string has half of its other bytes or more
   before the anchor, or less; so its context is split in two, whose anchors take in those bytes that all strings of the part have.
   Parts are brought together by their longer anchors, one for each distinct part (by its bytes), and split again where they are still too many;
   at the end, an anchor is the whole string.
Texts are shuffled once; both reads of that shuffle, for contexts and for the removal, are one exchange.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.shared import Scratch, text_batches, text_bytes
from folioscope.llm.suffix_array import suffix_array

LENGTH, GRAM = 200, 64
#: Different contexts of an anchor beyond which it is made longer.
CROWD = 4096
#: Longer texts are looked through in stretches of so many starts of strings.
STRETCH = 1 << 20
#: Contexts of crowds are asked for by sending their places to every task, up to so many (some 60 MB).
SENT = 1_000_000
#: Bytes of contexts that one suffix array holds (more only if a single anchor has more).
ARRAY_BYTES = 1 << 20

_P = 0x9E3779B97F4A7C15


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


class Rolling:
    """Hashes of any stretches of a buffer, in a few steps each."""

    def __init__(self, raw: np.ndarray, seed: int = 0):
        n, base = len(raw), (_P + 2 * seed) % (1 << 64)
        power = np.full(n + 1, base, np.uint64)
        power[0] = 1
        np.multiply.accumulate(power, out=power)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * power[:n], out=self.sums[1:])
        self.inverse = np.full(n + 1, pow(base, -1, 1 << 64), np.uint64)
        self.inverse[0] = 1
        np.multiply.accumulate(self.inverse, out=self.inverse)

    def every(self, size: int) -> np.ndarray:
        """Of all stretches of that size."""
        return _mix((self.sums[size:] - self.sums[: len(self.sums) - size]) * self.inverse[: len(self.sums) - size])

    def of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.sums[end] - self.sums[begin]) * self.inverse[begin] + (end - begin).astype(np.uint64))


def least_in_window(keys: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbouring keys."""
    n = len(keys)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = keys
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def contexts(raw: np.ndarray, ends: np.ndarray, length: int = LENGTH, gram: int = GRAM, seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, begin, end, anchor hash, context hash, place of the anchor) of each context, over texts that end at ``ends`` in the buffer."""
    none = np.zeros(0, np.int64)
    if len(raw) < length:
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64), none
    rolling = Rolling(raw, seed)
    grams = rolling.every(gram)
    low = np.uint64((1 << 32) - 1)  # the same for every buffer, so that a string's anchor depends on the string alone
    keys = (grams & ~low) | (low - np.arange(len(grams), dtype=np.uint64))
    anchor = (low - (least_in_window(keys, length - gram + 1) & low)).astype(np.int64)
    starts = np.arange(len(anchor))
    doc = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))[: len(anchor)]
    valid = starts + length <= ends[doc]
    same = (anchor[1:] == anchor[:-1]) & (doc[1:] == doc[:-1]) & valid[:-1]
    opens = np.flatnonzero(valid & ~np.concatenate([[False], same]))
    closes = np.flatnonzero(valid & ~np.concatenate([same & valid[1:], [False]]))
    begin, end = opens, closes + length
    return doc[opens], begin, end, grams[anchor[opens]], rolling.of(begin, end), anchor[opens]


def contexts_of(texts: list[bytes], length: int, gram: int, stretch: int = STRETCH, seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, begin, end, anchor hash, context hash) of all contexts, places counted in their texts. A context is cut where a stretch of a long text ends; each string is in one of the parts."""
    sizes = np.array([len(t) for t in texts], np.int64)
    if all(n <= 2 * stretch for n in sizes.tolist()):
        ends = np.cumsum(sizes)
        doc, begin, end, h, g, _ = contexts(np.frombuffer(b"".join(texts), np.uint8), ends, length, gram, seed)
        base = (ends - sizes)[doc]
        return doc, begin - base, end - base, h, g
    parts = []
    for k, text in enumerate(texts):
        for at in range(0, max(1, len(text) - length + 1), stretch):
            part = text[at : at + stretch + length - 1]
            doc, begin, end, h, g, _ = contexts(np.frombuffer(part, np.uint8), np.array([len(part)]), length, gram, seed)
            parts.append((doc + k, begin + at, end + at, h, g))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _contexts_of(length: int, gram: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches, limit=1 << 20):
            texts = text_bytes(batch.column(2))
            sizes = np.array([len(t) for t in texts], np.int64)
            doc, begin, end, h, g = contexts_of(texts, length, gram, seed=seed)
            cuts = pa.array(np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=len(texts)))]), pa.int32())
            lists = [pa.ListArray.from_arrays(cuts, pa.array(x.view(np.int64), pa.int64())) for x in (h, g, begin << 32 | end)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array([sha256(t).digest() for t in texts], pa.binary()), *lists], ["doc_id", "text_key", "n_bytes", "sha", "hs", "gs", "spans"])

    return run


_CUT = "doc_id long, text_key long, h long, crowded boolean, single boolean, span long, to_doc long, to_key long, bytes binary"


def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns doc_id, text_key, text, wanted list of (h, crowded, single, span, to_doc, to_key) -> a row for each wanted stretch."""
    names = [c.split()[0] for c in _CUT.split(", ")]
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
    rows: list[tuple] = []
    size = 0

    def told() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [()] * len(kinds), kinds, strict=True)], names)

    for batch in batches:
        ids, keys, wanted = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3)
        for k in range(batch.num_rows):
            text = batch.column(2)[k].as_buffer().to_pybytes()
            for w in wanted[k].as_py():
                span = w["span"]
                rows.append((ids[k], keys[k], w["h"], w["crowded"], w["single"], span, w["to_doc"], w["to_key"], text[span >> 32 : span & 0xFFFFFFFF]))
                size += len(rows[-1][-1])
            if size > 1 << 21:
                yield told()
                rows, size = [], 0
    yield told()


def _stretches(copies: DataFrame) -> DataFrame:
    """(rid, trid, delta, b, e): what is to be compared, text[b : e] of row rid with the bytes at the same places less delta of row trid. copies: rid, h, g, span, first (rid and span of the first of all such)."""
    part, own = F.shiftright("rid", 33).alias("part"), F.struct("rid", "span")
    here = copies.groupBy("h", "g", part).agg(F.min(own).alias("here"))
    both = copies.withColumn("part", part).join(here, ["h", "g", "part"])
    other = F.when(F.col("here") != own, F.col("here")).when(F.col("first") != own, F.col("first"))
    begin = lambda c: F.shiftright(c, 32)
    pairs = both.select("rid", "span", other.alias("o")).filter("o IS NOT NULL").select("rid", F.col("o.rid").alias("trid"), (begin(F.col("span")) - begin(F.col("o.span"))).alias("delta"), F.struct(begin(F.col("span")).alias("b"), F.col("span").bitwiseAND(F.lit(0xFFFFFFFF)).alias("e")).alias("s"))
    last = lambda acc: F.try_element_at(acc, F.lit(-1))
    joined = F.aggregate(
        F.array_sort(F.collect_list("s")), F.expr("array()").cast("array<struct<b:bigint,e:bigint>>"),
        lambda acc, x: F.when((F.size(acc) > 0) & (last(acc)["e"] >= x["b"]), F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(last(acc)["b"].alias("b"), F.greatest(last(acc)["e"], x["e"]).alias("e")))))
        .otherwise(F.concat(acc, F.array(F.struct(x["b"].alias("b"), x["e"].alias("e"))))),
    )
    return pairs.groupBy("rid", "trid", "delta").agg(joined.alias("all")).select("rid", "trid", "delta", F.explode("all").alias("x")).select("rid", "trid", "delta", "x.b", "x.e")


def repeated_strings(parts: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """For each part, the starts of its strings of ``length`` bytes that start elsewhere in any of the parts too."""
    words: list[bytes] = []
    sizes = []
    for part in parts:
        own = part.replace(b"\n", b"\n ").split(b" ")  # a word keeps the white space that ends it
        cut = []
        for w in own[:-1]:
            cut.append(w if w.endswith(b"\n") else w + b" ")
        if own[-1]:
            cut.append(own[-1])
        words += cut
        sizes.append(len(cut))
    number = {w: k for k, w in enumerate(sorted(set(words)), len(parts))}
    counts = np.array(sizes)
    ids = np.fromiter((number[w] for w in words), np.int64, len(words))
    where = np.arange(len(words)) + np.repeat(np.arange(len(parts)), counts)
    symbols = np.empty(len(words) + len(parts), np.int64)
    symbols[where] = ids
    symbols[np.cumsum(counts) + np.arange(len(parts))] = np.arange(len(parts))  # an end of its own for each part, lower than any word
    rank = np.empty(len(symbols), np.int64)
    rank[suffix_array(symbols)] = np.arange(len(symbols))

    raw = np.frombuffer(b"".join(parts) + bytes(8), np.uint8)
    total = len(raw) - 8
    part_end = np.cumsum([len(p) for p in parts])
    word_begin = np.append(np.cumsum([len(w) for w in words]) - np.array([len(w) for w in words], np.int64), total)
    at = np.concatenate([np.arange(e - len(p), e - length + 1) for p, e in zip(parts, part_end.tolist(), strict=True)])
    nth = np.searchsorted(word_begin, at, side="right")  # the next word to begin: white space within the string tells where
    owner = np.searchsorted(part_end, at, side="right")
    inner = np.minimum(word_begin[nth], part_end[owner])
    beyond = np.where(inner >= part_end[owner], -1, 0)
    cut = np.minimum(inner, at + length)
    rolling = Rolling(raw[:total])
    head = rolling.of(at, cut)  # what comes before that word
    tail = np.where((beyond < 0) | (cut == at + length), -1, rank[np.minimum(nth, len(words) - 1) + owner])
    order = np.lexsort((tail, head))
    sorted_at = at[order]
    flag = np.zeros(len(at), bool)
    steps = list(range(0, length - 7, 8)) + ([length - 8] if length % 8 else [])
    view = np.ndarray((total + 1,), "<u8", raw.tobytes(), strides=(1,))
    for a in range(0, len(at) - 1, 1 << 16):
        one, two = sorted_at[a : a + (1 << 16)], sorted_at[a + 1 : a + (1 << 16) + 1]
        one = one[: len(two)]
        equal = np.ones(len(two), bool)
        for s in steps:
            live = np.flatnonzero(equal)
            if not len(live):
                break
            equal[live] = view[one[live] + s] == view[two[live] + s]
        flag[order[a : a + len(two)][equal]] = True
        flag[order[a + 1 : a + 1 + len(two)][equal]] = True
    first = part_end - np.array([len(p) for p in parts])
    found = at[flag]
    cuts = np.searchsorted(found, part_end)
    return [x - f for x, f in zip(np.split(found, cuts[:-1]), first.tolist(), strict=True)]


def _runs(starts: np.ndarray, length: int, base: int) -> list[int]:
    """Stretches covered by strings at increasing starts, as begin << 32 | end."""
    if not len(starts):
        return []
    gaps = np.flatnonzero(np.diff(starts) > length)
    begin, end = starts[np.append(0, gaps + 1)] + base, starts[np.append(gaps, len(starts) - 1)] + length + base
    return (begin << 32 | end).tolist()


def _compare(length: int, array_bytes: int):
    def told(rows: list[tuple]) -> pa.RecordBatch:
        found = repeated_strings([r[4] for r in rows], length)
        out = [(r[0], r[1], s) for r, starts in zip(rows, found, strict=True) if r[2] for s in _runs(starts, length, r[3] >> 32)]
        cols = list(zip(*out, strict=True)) or [(), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc_id", "text_key", "span"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size, last = 0, None
        for batch in batches:
            for h, *r in zip(*(batch.column(c).to_pylist() for c in ("h", "doc_id", "text_key", "single", "span", "bytes")), strict=True):
                if size > array_bytes and h != last:
                    yield told(rows)
                    rows, size = [], 0
                rows.append(tuple(r))
                size, last = size + len(r[4]), h
        if rows:
            yield told(rows)

    return run


def halves(text: bytes, at: int, width: int, length: int) -> list[tuple[int, int, int, int]]:
    """(begin, end, anchor's place, anchor's width) of the parts of a context whose strings all have the anchor text[at : at + width]: strings with half of the other bytes or more
    before it, and those with less. Each string is in just one part; the place is counted from the part's begin."""
    before = (length - width + 1) // 2
    last = len(text) - length  # where strings may begin
    out = []
    if 0 <= (to := min(at - before, last)):
        out.append((0, to + length, at - before, width + before))
    if (begin := max(0, at - before + 1)) <= (to := min(at, last)):
        out.append((begin, to + length, at - begin, length - before + 1))
    return out


_PARTS = "h long, doc_id long, text_key long, single boolean, span long, at int, width int, bytes binary"


def _split(length: int, gram: int, seed: int):
    """Rows of one or several contexts -> rows of their halves. A width of 0: the anchor is still to be found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            for k in range(0, batch.num_rows, 4096):
                part, out = batch.slice(k, 4096), []
                for h, doc, key, single, span, at, width, text in zip(*(part.column(c).to_pylist() for c in ("h", "doc_id", "text_key", "single", "span", "at", "width", "bytes")), strict=True):
                    if not width:
                        at, width = int(contexts(np.frombuffer(text, np.uint8), np.array([len(text)]), length, gram, seed)[5][0]), gram
                    for begin, end, where, wide in halves(text, at, width, length):
                        own = text[begin:end]
                        name = xxhash.xxh3_64_intdigest(own[where : where + wide], seed=where - at + begin & 0xFFFF) - (1 << 63)
                        out.append((name, doc, key, single, (span >> 32) + begin << 32 | (span >> 32) + end, where, wide, own))
                cols = list(zip(*out, strict=True)) or [()] * 8
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["h", "doc_id", "text_key", "single", "span", "at", "width", "bytes"])

    return run


def _parted(crowd: DataFrame, scratch: Scratch, length: int, gram: int, most: int, seed: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """(spans, parts): of contexts around crowded anchors, the spans that are found on the way, and the parts that are left to suffix arrays."""
    spans, parts = [], []
    while not crowd.isEmpty():
        halved = scratch.save(crowd.select("h", "doc_id", "text_key", "single", "span", "at", "width", "bytes").mapInArrow(_split(length, gram, seed), _PARTS), "halves")
        kinds = halved.groupBy("h", "bytes").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("single", "doc_id", "text_key", "span", "at", "width")).alias("x"))
        kinds = scratch.save(kinds.select("h", "bytes", "n", "x.*"), "distinct-halves")
        often = kinds.filter("n > 1").select(F.col("h").alias("o"), F.col("bytes").alias("b"))
        spans.append(halved.filter("single").join(often, (F.col("h") == F.col("o")) & (F.col("bytes") == F.col("b"))).select("doc_id", "text_key", "span"))
        one = (F.col("n") == 1) & F.col("single")
        open_ = kinds.groupBy("h").agg(F.count(F.lit(1)).alias("kinds"), F.count_if(one).alias("ones")).filter("kinds > 1 AND ones > 0").select("h", (F.col("kinds") > most).alias("crowded"))
        rows = scratch.save(kinds.withColumn("single", one).join(open_, "h"), "open-halves")
        parts.append(rows.filter("NOT crowded"))
        crowd = rows.filter("crowded")
    return spans, parts


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns doc_id, text_key, text, spans, checks list of (at, bytes) -> what is left of the text, and whether all checks are bytes of the text."""
    for batch in batches:
        removed, runs, shas, kept, right = [], [], [], [], []
        for k, (text, spans) in enumerate(zip(text_bytes(batch.column(2)), batch.column(3).to_pylist(), strict=True)):
            right.append(all(text[c["at"] : c["at"] + len(c["bytes"])] == c["bytes"] for c in batch.column(4)[k].as_py()))
            left, at, n, out = [], 0, 0, 0
            for s in sorted(spans):
                b, e = s >> 32, s & 0xFFFFFFFF
                if b > at or not n:
                    n += 1
                    left.append(text[at:b])
                    at = b
                if e > at:
                    out, at = out + e - at, e
            left.append(text[at:])
            rest = b"".join(left)
            removed.append(out)
            runs.append(n)
            shas.append(sha256(rest).digest())
            kept.append(rest.decode("utf-8", "replace"))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(shas, pa.binary()), pa.array(kept, pa.string()), pa.array(right)], ["doc_id", "text_key", "n_removed", "n_spans", "sha", "kept", "right"])


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, crowd: int = CROWD, array_bytes: int = ARRAY_BYTES, with_text: bool = False, seed: int = 0) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans, kept_sha256; with_text adds ``kept``, the text that is left (bytes that aren't UTF-8 any more replaced).

    Strings are judged on the input: no occurrence stays. A null text is empty; texts shorter than ``length`` never lose anything.
    Very long texts are looked through in stretches, so memory is some ten bytes a byte of the longest text.
    Rows repeated as a whole are occurrences of their own, so all of their strings are repeated. ``gram``, ``crowd``, ``array_bytes`` and ``seed`` steer the
    work, not the result: where two different stretches turn out to have equal hashes, all is done again with the next seed. An empty table gives an empty result; other columns are ignored."""
    spark = df.sparkSession
    scratch = Scratch(spark, "suffix")
    text = F.coalesce(df[text_col], F.lit(""))
    docs = df.select(df[id_col].cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.cast("binary").alias("text"))
    found = docs.mapInArrow(_contexts_of(length, gram, seed), "doc_id long, text_key long, n_bytes long, sha binary, hs array<long>, gs array<long>, spans array<long>")
    rows = scratch.save(found.withColumn("rid", F.monotonically_increasing_id()), "contexts")

    anchors = scratch.save(rows.select(F.explode("hs").alias("h")).groupBy("h").count().filter("count > 1").select("h"), "repeated-anchors")
    flat = rows.select("rid", F.explode(F.arrays_zip("hs", "gs", "spans")).alias("x")).select("rid", F.col("x.hs").alias("h"), F.col("x.gs").alias("g"), F.col("x.spans").alias("span"))
    near = scratch.save(flat.join(anchors, "h"), "near")
    kinds = scratch.save(near.groupBy("h", "g").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("rid", "span")).alias("first")), "distinct-contexts")
    copies = scratch.save(near.join(kinds.filter("n > 1").select("h", "g", "first"), ["h", "g"]), "copies")

    open_ = kinds.groupBy("h").agg(F.count(F.lit(1)).alias("kinds"), F.min("n").alias("least")).filter("kinds > 1 AND least = 1")
    open_ = scratch.save(open_.select("h", (F.col("kinds") > crowd).alias("crowded")), "open-anchors")
    key = rows.select("rid", "doc_id", "text_key")
    none = F.lit(None).cast("long")
    asked = kinds.join(open_, "h").select(F.col("first.rid").alias("rid"), F.struct("h", "crowded", (F.col("n") == 1).alias("single"), F.col("first.span").alias("span"), none.alias("to_doc"), none.alias("to_key")).alias("w"))
    whose = key.withColumnsRenamed({"rid": "r", "doc_id": "to_doc", "text_key": "to_key"})
    compared = scratch.save(_stretches(copies).join(whose, F.col("rid") == F.col("r")), "stretches")
    there = F.shiftleft(F.col("b") - F.col("delta"), 32) + F.col("e") - F.col("delta")
    no = F.lit(False)
    checks = compared.select(F.col("trid").alias("rid"), F.struct(F.col("b").alias("h"), no.alias("crowded"), no.alias("single"), there.alias("span"), "to_doc", "to_key").alias("w"))
    asked = asked.unionByName(checks).groupBy("rid").agg(F.collect_list("w").alias("wanted")).join(key, "rid")
    asked = scratch.save(asked.groupBy("doc_id", "text_key").agg(F.flatten(F.collect_list("wanted")).alias("wanted")), "asked").withColumnsRenamed({"doc_id": "i", "text_key": "k"})

    same = docs["doc_id"].eqNullSafe(F.col("i")) & (docs["text_key"] == F.col("k"))
    cut = docs.join(asked, same).select("doc_id", "text_key", "text", "wanted").mapInArrow(_cut_out, _CUT)
    by_anchor = cut.filter("NOT crowded AND to_key IS NULL").select("h", "doc_id", "text_key", "single", "span", "bytes")
    found = [copies.join(key, "rid").select("doc_id", "text_key", "span")]
    if not open_.filter("crowded").isEmpty():
        few = scratch.save(asked.withColumn("wanted", F.filter("wanted", lambda w: w["crowded"])).filter(F.size("wanted") > 0), "asked-of-crowds")
        if (few.agg(F.sum(F.size("wanted"))).first()[0] or 0) <= SENT:  # then texts aren't shuffled once more
            few = F.broadcast(few)
        many = docs.join(few, same).select("doc_id", "text_key", "text", "wanted").mapInArrow(_cut_out, _CUT)
        more, parts = _parted(scratch.save(many.withColumns({"at": F.lit(0), "width": F.lit(0)}), "crowd"), scratch, length, gram, crowd, seed)
        found += more
        for part in parts:
            by_anchor = by_anchor.unionByName(part.select("h", "doc_id", "text_key", "single", "span", "bytes"))
    spans = by_anchor.repartition("h").sortWithinPartitions("h").mapInArrow(_compare(length, array_bytes), "doc_id long, text_key long, span long")
    for more in found:
        spans = spans.unionByName(more)
    # h is where the stretch begins in the text that it is compared with; copies of one passage ask for the same, so only one of them goes on from where they arise
    wanted = cut.filter("to_key IS NOT NULL").select(F.col("to_doc").alias("doc_id"), F.col("to_key").alias("text_key"), F.col("h").alias("at"), "bytes").distinct()
    wanted = wanted.select("doc_id", "text_key", F.lit(None).cast("long").alias("span"), F.struct("at", "bytes").alias("check"))
    spans = spans.withColumn("check", F.lit(None).cast("struct<at:bigint,bytes:binary>")).unionByName(wanted)
    spans = spans.groupBy("doc_id", "text_key").agg(F.collect_set("span").alias("spans"), F.collect_list("check").alias("checks")).withColumnsRenamed({"doc_id": "i", "text_key": "k"})
    left = docs.join(spans, same).select("doc_id", "text_key", "text", "spans", "checks").mapInArrow(_remove, "doc_id long, text_key long, n_removed long, n_spans long, sha binary, kept string, right boolean")
    if not with_text:
        left = left.drop("kept")
    left = scratch.save(left.dropDuplicates(["doc_id", "text_key"]), "left").withColumnsRenamed({"doc_id": "i", "text_key": "k", "sha": "rest"})
    if not left.filter("NOT right").isEmpty():
        scratch.close()
        return remove_repeats(df, id_col, text_col, length, gram, crowd, array_bytes, with_text, seed + 1)
    out = rows.select("doc_id", "text_key", "n_bytes", "sha").alias("r")
    out = out.join(left, F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("text_key") == F.col("k")), "left")
    out = out.select("doc_id", "text_key", "n_bytes", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_removed", "n_spans")), F.lower(F.hex(F.coalesce("rest", "sha"))).alias("kept_sha256"), *(["kept"] if with_text else []))
    if not with_text:
        return out.drop("text_key")
    whole = docs.select(F.col("doc_id").alias("i"), F.col("text_key").alias("k"), F.col("text").cast("string").alias("whole")).dropDuplicates(["i", "k"])
    return out.join(whole, F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("text_key") == F.col("k"))).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", F.coalesce("kept", "whole").alias("kept"))
