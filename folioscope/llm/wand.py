"""Ranked lexical search: the k documents of the highest BM25 score, in whole numbers, for each item of a query table.

Index: a row holds a shard, the documents of a few megabytes of text in the order of their ids: its distinct terms and, for each, the documents that hold it and how often. The index is
stored, and any number of searches read it.

Search (WAND): what is known of the whole corpus, the number of documents and terms and how many documents hold each query term, is summed over the shards first. Then each shard is searched by itself:
cursors stand on the query terms' lists, in the order of their documents; the pivot is the first document at which the terms' maximum impacts, added up, can reach the least score in the heap of the best k. All
lists before it are moved there at once, so documents that can't beat the heap are never looked at. A task keeps its heaps from one shard to the next, and begins with
a score that k documents of a few shards are known to reach; the heaps are merged by Spark. Large query tables go block by block."""

from __future__ import annotations

import math
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from heapq import heappush, heappushpop

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.llm.decontam import split_words
from folioscope.llm.shared import Scratch, give_back, text_batches, text_bytes

#: Bytes of text in a shard of the index; bytes of queries that are sent to every task at once.
SHARD_BYTES, BLOCK_BYTES = 8 << 20, 4 << 20
#: One in so many shards is searched beforehand for scores to begin with.
FIRST = 32
BEST = 10
#: Rank of a null doc_id among equal scores: the last.
_NULL = np.iinfo(np.int64).max

_INDEX = "shard long, n_docs long, n_terms long, doc_ids array<long>, lengths binary, terms binary, ends binary, docs binary, times binary"


def _index_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    task = TaskContext.get().partitionId()
    for number, batch in enumerate(text_batches(batches, limit=SHARD_BYTES)):
        ids = batch.column(0).to_pylist()
        words = [split_words(x) for x in text_bytes(batch.column(1))]
        order = sorted((i for i in range(len(ids)) if words[i]), key=lambda i: (ids[i] is None, ids[i]))
        terms: defaultdict[bytes, int] = defaultdict()
        terms.default_factory = terms.__len__
        tokens = np.fromiter((terms[w] for i in order for w in words[i]), np.int64)
        terms.default_factory = None  # or the dictionary would hold itself
        lengths = np.array([len(words[i]) for i in order], np.int32)
        # a posting for each term and document of the shard, by term and then document
        postings, times = np.unique(tokens * len(order) + np.repeat(np.arange(len(order)), lengths), return_counts=True)
        of, docs = np.divmod(postings, max(len(order), 1))
        row = [
            (task << 33) + number, len(order), int(lengths.sum()), [ids[i] for i in order], lengths.tobytes(), b" ".join(terms), np.cumsum(np.bincount(of, minlength=len(terms)), dtype=np.int32).tobytes(),
            docs.astype(np.int32).tobytes(), times.astype(np.int32).tobytes(),
        ]
        kinds = [pa.int64()] * 3 + [pa.list_(pa.int64())] + [pa.binary()] * 5
        yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], [c.split()[0] for c in _INDEX.split(", ")])
        del words, tokens, terms, postings, times, of, docs, row
        give_back()


def build_index(df: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The shards. Texts are read whole; those without a term (null and empty ones too) are in no shard. Other columns aren't read."""
    return scratch.save(df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].alias("text")).mapInArrow(_index_shards, _INDEX), "index", rows_a_group=4)


def _frequencies(wanted: dict[bytes, int]):
    """Shards' terms and ends -> how many of their documents hold each wanted term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(wanted), np.int64)
        for batch in batches:
            for terms, ends in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sizes = np.diff(np.frombuffer(ends, np.int32), prepend=0).tolist()
                for term, n in zip(terms.split(), sizes, strict=True):
                    at = wanted.get(term)
                    if at is not None:
                        total[at] += n
        told = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(told), pa.array(total[told])], ["term", "n"])

    return run


def wand(lists: list[tuple[list[int], list[int], int]], heap: list, k: int, floor: int, rank: list[int]) -> None:
    """Puts the documents of one shard into the heap, (score, -rank) of the best k so far; floor: a score that k documents are known to reach.

    lists: for each query term its documents, in order, its score in each, and the highest of these. rank: ids of the documents, that decide between equal scores."""
    at = [0] * len(lists)
    now = sorted((docs[0], i) for i, (docs, _, _) in enumerate(lists))
    least = max(floor, heap[0][0] if len(heap) == k else 1)
    while now:
        reach = 0
        for place, (pivot, i) in enumerate(now):  # noqa: B007
            reach += lists[i][2]
            if reach >= least:  # an equal score may still win by its id
                break
        else:
            return
        while place + 1 < len(now) and now[place + 1][0] == pivot:
            place += 1
        if now[0][0] == pivot:
            score = 0
            moved = []
            for _, i in now[: place + 1]:
                docs, scores, _ = lists[i]
                score += scores[at[i]]
                at[i] += 1
                if at[i] < len(docs):
                    moved.append((docs[at[i]], i))
            if score >= least:
                if len(heap) < k:
                    heappush(heap, (score, -rank[pivot]))
                else:
                    heappushpop(heap, (score, -rank[pivot]))
                if len(heap) == k:  # ids rise within a shard: none that follows wins by its id against a smaller one
                    least = max(least, heap[0][0] + (-heap[0][1] <= rank[pivot]))
            now = sorted(moved + now[place + 1 :])
        else:
            moved = []
            for doc, i in now[: place + 1]:
                if doc < pivot:
                    docs = lists[i][0]
                    at[i] = bisect_left(docs, pivot, at[i])
                    if at[i] == len(docs):
                        continue
                    doc = docs[at[i]]
                moved.append((doc, i))
            now = sorted(moved + now[place + 1 :])


def _search(items: list[list[tuple[int, int]]], wanted: dict[bytes, int], weights: list[int], n_docs: int, n_terms: int, k: int, floors: list[int]):
    """Shards -> the best k documents of all shards of a task for each item. items: (term, times) of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps: list[list[tuple[int, int]]] = [[] for _ in items]
        for batch in batches:
            for x in batch.to_pylist():
                own = {wanted[t]: p for p, t in enumerate(x["terms"].split()) if t in wanted}
                ends, docs, times = (np.frombuffer(x[c], np.int32) for c in ("ends", "docs", "times"))
                average = np.array([25 + 75 * n * n_docs // n_terms for n in np.frombuffer(x["lengths"], np.int32).tolist()], np.int64)
                rank = [_NULL if i is None else i for i in x["doc_ids"]]
                found = {}
                for t, p in own.items():
                    a, b = ends[p - 1] if p else 0, ends[p]
                    tf = times[a:b].astype(np.int64)
                    scores = weights[t] * ((1_000_000_000 * tf) // (1000 * tf + 8 * average[docs[a:b]]))
                    found[t] = (docs[a:b].tolist(), scores)
                lists = {}  # by term and how often the item has it
                for heap, terms, floor in zip(heaps, items, floors, strict=True):
                    mine = []
                    for t, n in terms:
                        if t in found and (t, n) not in lists:
                            scores = n * found[t][1]
                            lists[t, n] = (found[t][0], scores.tolist(), int(scores.max()))
                        if t in found:
                            mine.append(lists[t, n])
                    wand(mine, heap, k, floor, rank)
            give_back()
        rows = [(i, None if d == -_NULL else -d, s) for i, heap in enumerate(heaps) for s, d in heap]
        columns = list(zip(*rows, strict=True)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.int64()), strict=True)], ["item", "doc_id", "score"])

    return run


def _top(found: DataFrame, k: int) -> DataFrame:
    """Spark keeps the first k of each task before it shuffles them."""
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def search(index: DataFrame, queries: DataFrame, scratch: Scratch, id_col: str = "item_id", text_col: str = "text", k: int = BEST, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: the k documents of each row of queries with the highest score above 0 (all, if fewer); of equal scores the smaller doc_id goes first, a
    null one last. Rows that share an id, or have none, are items each; one without terms finds nothing."""
    spark = index.sparkSession
    n_docs, n_terms, n_shards = index.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0)), F.count(F.lit(1))).first()
    rows = queries.select(queries[id_col].alias("item_id"), F.coalesce(queries[text_col], F.lit("")).alias("text"))
    blocks = rows.agg(F.coalesce(F.sum(F.octet_length("text") + 16), F.lit(0))).first()[0] // block_bytes + 1
    parts = []
    for b in range(blocks):  # the driver holds one at a time
        block = (rows if blocks == 1 else rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)).collect()
        counts = [Counter(split_words(r["text"].encode())) for r in block]
        wanted = {t: n for n, t in enumerate(sorted(set().union(*counts)))}
        df = dict(index.select("terms", "ends").mapInArrow(_frequencies(wanted), "term long, n long").groupBy("term").agg(F.sum("n")).collect())
        weights = [math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df.get(n, 0) + 1))) for n in range(len(wanted))]
        items = [sorted((wanted[t], n) for t, n in c.items() if wanted[t] in df) for c in counts]
        run = lambda shards, floors, what=(items, wanted, weights): shards.mapInArrow(_search(*what, n_docs, n_terms, k, floors), "item int, doc_id long, score long")
        floors = [1] * len(items)
        if n_shards >= 2 * FIRST:
            some = _top(run(index.filter(F.pmod(F.xxhash64("shard"), F.lit(FIRST)) == 0), floors), k).filter(F.col("rank") == k)
            for r in some.select("item", "score").collect():
                floors[r["item"]] = max(1, r["score"])
        best = scratch.save(_top(run(index, floors), k), "best", most=k * len(items))
        ids = spark.createDataFrame([(n, r["item_id"]) for n, r in enumerate(block)], rows.select(F.lit(0).alias("n"), "item_id").schema)
        parts.append(best.join(F.broadcast(ids), best["item"] == ids["n"]).select("item_id", "rank", "doc_id", "score"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def rank_documents(df: DataFrame, queries: DataFrame, id_col: str = "doc_id", text_col: str = "text", query_id: str = "item_id", query_text: str = "text", k: int = BEST, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The k best documents of df for each row of queries, as search gives them. Empty tables give an empty result; repeated rows of df are documents each."""
    scratch = Scratch(df.sparkSession, "wand")
    return search(build_index(df, scratch, id_col, text_col), queries, scratch, query_id, query_text, k, block_bytes)
