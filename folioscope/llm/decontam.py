"""Benchmark decontamination with a distributed positional inverted index.

Index: one row holds the index of a few thousand documents (a shard): the shard's distinct words and, for
each, the increasing list of positions at which it occurs. Positions run through the shard's
documents with one free position between neighbours, so no phrase can cross documents. The index
is stored; any number of searches read it.

Search: each phrase of a benchmark item is looked up in each shard. A phrase with a word that the shard lacks, or with
two neighbours that it never has side by side, is done; this is told for a whole block of the benchmark at once. For the others the lists are
intersected, offset by the word's place in the phrase, from the rarest word on. A large benchmark is searched block by block: neither
the driver nor a task ever holds more than one.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.shared import Scratch, drop_rows, text_batches, text_bytes, text_key

#: Bytes of benchmark text sent to every task at once; a larger benchmark is searched in several blocks.
BLOCK_BYTES = 8 << 20
#: Bytes of text in a shard of the index.
SHARD_BYTES = 2 << 20
#: Neighbouring words of a shard are marked in a table of so many places (a power of two); a mark by chance costs an intersection.
PAIRS_BITS = 22
WINDOW = 10

#: Words are runs of digits, letters a-z (after lower-casing) and all bytes of non-ASCII characters.
_TABLE = bytes(c if c >= 0x80 or 48 <= c <= 57 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))

_INDEX = "shard long, doc_ids array<long>, text_keys array<long>, n_words array<int>, terms binary, ends binary, postings binary"
_FOUND = "shard long, ord int, doc_id long, text_key long, n_words long, starts array<int>, ends array<int>, items array<string>"


def split_words(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


def _index_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    task, schema = TaskContext.get().partitionId(), None
    for n, batch in enumerate(text_batches(batches, limit=SHARD_BYTES)):
        docs = [split_words(x) for x in text_bytes(batch.column(2))]
        lengths = np.array([len(d) for d in docs], np.int32)
        ids: defaultdict[bytes, int] = defaultdict()
        ids.default_factory = ids.__len__
        total = int(lengths.sum())
        tokens = np.fromiter((ids[w] for d in docs for w in d), np.int32, total)
        ids.default_factory = None  # or the dictionary would hold itself
        places = np.arange(total, dtype=np.int32) + np.repeat(np.arange(len(docs), dtype=np.int32), lengths)
        postings = places[np.argsort(tokens, kind="stable")]
        ends = np.cumsum(np.bincount(tokens, minlength=len(ids)), dtype=np.int64)
        steps = np.diff(postings, prepend=np.int32(0))
        schema = schema or pa.schema([("shard", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("text_keys", pa.list_(pa.int64())), ("n_words", pa.list_(pa.int32())), *((c, pa.binary()) for c in ("terms", "ends", "postings"))])
        one = lambda col, kind: pa.array([col.to_pylist()], pa.list_(kind))
        yield pa.RecordBatch.from_arrays(
            [pa.array([(task << 32) + n], pa.int64()), one(batch.column(0), pa.int64()), one(batch.column(1), pa.int64()), pa.array([lengths], pa.list_(pa.int32())), pa.array([b"\n".join(ids)], pa.binary()), pa.array([ends.tobytes()], pa.binary()), pa.array([steps.tobytes()], pa.binary())], schema=schema,
        )


def build_index(df: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The stored index of all rows. Null texts have no words; ids may be null or repeated: rows are told apart by shard and place."""
    text = F.coalesce(df[text_col], F.lit(""))
    rows = df.select(df[id_col].cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text"))
    return scratch.save(rows.mapInArrow(_index_shards, _INDEX), "index")


class _Shard:
    def __init__(self, row: dict):
        self.terms = {t: i for i, t in enumerate(row["terms"].split(b"\n") if row["terms"] else [])}
        self.ends = np.frombuffer(row["ends"], np.int64)
        self.postings = np.cumsum(np.frombuffer(row["postings"], np.int32), dtype=np.int32)
        self.n_words = np.array(row["n_words"], np.int32)
        self.first = np.cumsum(self.n_words + 1, dtype=np.int64) - self.n_words - 1
        self.pairs: np.ndarray | None = None

    def list_of(self, term: int) -> np.ndarray:
        return self.postings[self.ends[term - 1] if term else 0 : self.ends[term]]

    def doc_of(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, places, side="right") - 1

    def side_by_side(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Whether each pair of terms (-1: none) may be neighbours somewhere. All that are, are told so."""
        if self.pairs is None:
            sequence = np.full(int(self.n_words.sum()) + len(self.n_words) + 1, -1, np.int64)
            sequence[self.postings] = np.repeat(np.arange(len(self.ends)), np.diff(self.ends, prepend=0))
            self.pairs = np.zeros(1 << PAIRS_BITS, bool)
            self.pairs[self._place(sequence[:-1], sequence[1:])] = True
        return (one >= 0) & (two >= 0) & self.pairs[self._place(one, two)]

    @staticmethod
    def _place(one: np.ndarray, two: np.ndarray) -> np.ndarray:
        mixed = (one.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (two.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
        return ((mixed * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - PAIRS_BITS)).astype(np.int64)

    def phrase(self, terms: list[int]) -> np.ndarray:
        """Places at which the phrase begins."""
        lists = sorted(((self.list_of(t), k) for k, t in enumerate(terms)), key=lambda x: len(x[0]))
        at = lists[0][0] - lists[0][1]
        for places, k in lists[1:]:
            if not len(at):
                break
            near = np.searchsorted(places, at + k)
            at = at[places[np.minimum(near, len(places) - 1)] == at + k]
        return at

    def within(self, terms: list[int], span: int) -> tuple[np.ndarray, np.ndarray]:
        """Begin and end (exclusive) of each shortest run of at most span words, begun by one of the terms, that has all of them."""
        lists = [self.list_of(t) for t in set(terms)]
        rare = min(lists, key=len)
        start = np.unique(np.concatenate(lists))
        near = np.searchsorted(rare, start)
        start = start[(near < len(rare)) & (rare[np.minimum(near, len(rare) - 1)] - start < span)]
        end = start.copy()
        for places in lists:
            k = np.searchsorted(places, start)
            end = np.maximum(end, np.where(k < len(places), places[np.minimum(k, len(places) - 1)], np.iinfo(np.int32).max))
        ok = (end - start < span) & (self.doc_of(start) == self.doc_of(end)) if len(start) else np.zeros(0, bool)
        return start[ok], end[ok] + 1


class Phrases:
    """The phrases of one block of the benchmark, as arrays: all runs of ``window`` consecutive words of each item; the whole item, if it is shorter but not empty."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        ids: defaultdict[bytes, int] = defaultdict()
        ids.default_factory = ids.__len__
        self.names = [name for name, words in items if words]
        sizes = np.array([len(words) for _, words in items if words], np.int64)
        self.tokens = np.fromiter((ids[w] for _, words in items for w in words), np.int32, int(sizes.sum()))
        ids.default_factory = None  # or the dictionary would hold itself
        self.words = list(ids)
        count = np.maximum(1, sizes - window + 1)
        self.item = np.repeat(np.arange(len(sizes), dtype=np.int32), count)
        self.start = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + np.repeat(np.cumsum(sizes) - sizes, count)
        self.size = np.repeat(np.minimum(sizes, window), count)

    def possible(self, shard: _Shard) -> tuple[np.ndarray, np.ndarray]:
        """The shard's number of each token (-1: the shard lacks it), and the phrases whose words it has, neighbours side by side."""
        here = np.fromiter((shard.terms.get(w, -1) for w in self.words), np.int64, len(self.words))[self.tokens]
        lacking = np.concatenate([[0], np.cumsum(here < 0)])
        apart = np.concatenate([[0], np.cumsum(~shard.side_by_side(here[:-1], here[1:]))]) if len(here) > 1 else np.zeros(1, np.int64)
        end = self.start + self.size
        whole = lacking[end] == lacking[self.start]
        pairs = apart[np.minimum(end - 1, len(apart) - 1)] == apart[np.minimum(self.start, len(apart) - 1)]
        return here, np.flatnonzero(whole & (pairs | (self.size == 1)))


def _search(items: list[tuple[str, list[bytes]]], window: int, all_rows: bool):
    """Rows of the index -> a row for each document; without all_rows, for documents with a hit only."""
    phrases = Phrases(items, window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                shard, found = _Shard(row), defaultdict(set)
                cover = np.zeros(int(shard.n_words.sum()) + len(shard.n_words) + 1, np.int32)
                here, possible = phrases.possible(shard)
                known: dict[bytes, tuple[np.ndarray, list[int]]] = {}
                for p in possible.tolist():
                    terms = here[phrases.start[p] : phrases.start[p] + phrases.size[p]]
                    if (key := terms.tobytes()) not in known:
                        at = shard.phrase(terms.tolist())
                        np.add.at(cover, at, 1)
                        np.add.at(cover, at + len(terms), -1)
                        known[key] = at, np.unique(shard.doc_of(at)).tolist()
                    for d in known[key][1]:
                        found[d].add(phrases.names[phrases.item[p]])
                hit = np.cumsum(cover) > 0
                edge = np.flatnonzero(np.diff(hit, prepend=False, append=False))
                spans = defaultdict(lambda: ([], []))
                for a, b, d in zip(edge[::2].tolist(), edge[1::2].tolist(), shard.doc_of(edge[::2]).tolist(), strict=True):
                    spans[d][0].append(a - int(shard.first[d]))
                    spans[d][1].append(b - int(shard.first[d]))
                told, none = list(range(len(row["doc_ids"]))) if all_rows else sorted(spans), ([], [])
                pick = lambda c: [row[c][d] for d in told]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row["shard"]] * len(told), pa.int64()), pa.array(told, pa.int32()), pa.array(pick("doc_ids"), pa.int64()), pa.array(pick("text_keys"), pa.int64()), pa.array(pick("n_words"), pa.int64()),
                        *(pa.array([spans.get(d, none)[k] for d in told], pa.list_(pa.int32())) for k in (0, 1)), pa.array([sorted(found.get(d, ())) for d in told], pa.list_(pa.string())),
                    ],
                    ["shard", "ord", "doc_id", "text_key", "n_words", "starts", "ends", "items"],
                )

    return run


def _blocks(bench: DataFrame, id_col: str, text_col: str, limit: int) -> tuple[int, Iterator[list[tuple[str, list[bytes]]]]]:
    """How many blocks of about ``limit`` bytes the benchmark has (one item at least each), and these, one after the other."""
    rows = bench.select(F.coalesce(bench[id_col].cast("string"), F.lit("")).alias("item"), F.coalesce(bench[text_col], F.lit("")).alias("text"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text") + F.octet_length("item")), F.lit(0))).first()[0]
    n = size // limit + 1

    def block(k: int) -> list[tuple[str, list[bytes]]]:
        part = rows if n == 1 else rows.filter(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k)
        return [(r["item"], split_words(r["text"].encode())) for r in part.collect()]

    return n, (block(k) for k in range(n))


def search_phrases(index: DataFrame, bench: DataFrame, scratch: Scratch, item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per indexed document: doc_id, text_key, n_words, the merged runs of words hit [starts, ends), and the items found.

    An item is found where any of its windows (``window`` consecutive words; the whole item if it has fewer) occurs.
    Items without words are never found. Null item ids count as the empty text; items that share an id are one."""
    n, blocks = _blocks(bench, item_col, item_text, block_bytes)
    if n == 1:
        return index.mapInArrow(_search(next(blocks), window, True), _FOUND).drop("shard", "ord")
    hits = None
    for block in blocks:  # each is searched and its hits are stored before the next one is fetched
        own = scratch.save(index.mapInArrow(_search(block, window, False), _FOUND).select("shard", "ord", "starts", "ends", "items"), "hits")
        hits = own if hits is None else hits.unionByName(own)
    runs = F.array_sort(F.flatten(F.collect_list(F.arrays_zip("starts", "ends"))))
    last = lambda acc: F.try_element_at(acc, F.lit(-1))
    merged = F.aggregate(
        runs, F.expr("array()").cast("array<struct<starts:int,ends:int>>"),
        lambda acc, r: F.when((F.size(acc) > 0) & (last(acc)["ends"] >= r["starts"]),
            F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(last(acc)["starts"].alias("starts"), F.greatest(last(acc)["ends"], r["ends"]).alias("ends")))))
        .otherwise(F.concat(acc, F.array(F.struct(r["starts"].alias("starts"), r["ends"].alias("ends"))))),
    )
    hits = hits.groupBy("shard", "ord").agg(merged.alias("r"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    hits = scratch.save(hits.select(F.col("shard").alias("s"), F.col("ord").alias("o"), F.col("r.starts").alias("starts"), F.col("r.ends").alias("ends"), "items"), "all-hits")
    rows = index.select("shard", F.posexplode(F.arrays_zip("doc_ids", "text_keys", "n_words")).alias("ord", "d")).select("shard", "ord", F.col("d.doc_ids").alias("doc_id"), F.col("d.text_keys").alias("text_key"), F.col("d.n_words").cast("long").alias("n_words"))
    none = lambda c, kind: F.coalesce(c, F.array().cast(f"array<{kind}>")).alias(c)
    both = rows.join(hits, (F.col("shard") == F.col("s")) & (F.col("ord") == F.col("o")), "left")
    return both.select("doc_id", "text_key", "n_words", none("starts", "int"), none("ends", "int"), none("items", "string"))


def search_near(index: DataFrame, queries: list[tuple[str, str]], span: int) -> DataFrame:
    """Proximity matches of (query id, text): doc_id, query, start, end of each shortest run of at most span words that has all words of the query."""
    wanted = [(q, split_words(t.encode())) for q, t in queries]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                shard, out = _Shard(row), []
                for q, words in wanted:
                    terms = [shard.terms.get(w) for w in words]
                    if not terms or None in terms:
                        continue
                    a, b = shard.within(terms, span)
                    for s, e, d in zip(a.tolist(), b.tolist(), shard.doc_of(a).tolist(), strict=True):
                        out.append((row["doc_ids"][d], q, s - int(shard.first[d]), e - int(shard.first[d])))
                cols = list(zip(*out, strict=True)) or [(), (), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.string(), pa.int32(), pa.int32()), strict=True)], ["doc_id", "query", "start", "end"])

    return index.mapInArrow(run, "doc_id long, query string, start int, end int")


def contamination(df: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES, scratch: Scratch | None = None) -> DataFrame:
    """One row per input row, as search_phrases gives it. An empty table gives an empty result; an empty benchmark hits nothing."""
    scratch = scratch or Scratch(df.sparkSession, "decontamination")
    return search_phrases(build_index(df, scratch, id_col, text_col), bench, scratch, item_col, item_text, window, block_bytes)


def drop_contaminated(df: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of df without any hit; all columns stay, under whatever names. Rows are found again by doc_id and a hash of the text, so rows repeated
    as a whole stay or go together. Null and empty texts stay; an empty table gives an empty result, an empty benchmark drops nothing."""
    scratch = Scratch(df.sparkSession, "decontamination")
    bad = contamination(df, bench, id_col, text_col, **options, scratch=scratch).filter(F.size("items") > 0)
    rows = bad.select(F.col("doc_id").alias("id"), F.col("text_key").alias("key"), F.lit(False).alias("kept"))
    out = drop_rows(df, id_col, text_key(df[text_col]), rows, Scratch(df.sparkSession, "decontamination-filter"))
    scratch.close()
    return out
