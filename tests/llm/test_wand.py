"""WAND against scores of all documents."""

from __future__ import annotations

import math
import random
from collections import Counter

import pytest

from folioscope.llm import wand
from folioscope.llm.decontam import split_words
from folioscope.llm.shared import Scratch


def want(docs, items, k=10):
    words = [(i, Counter(split_words((t or "").encode()))) for i, t in docs]
    words = [(i, c, sum(c.values())) for i, c in words if c]
    n_docs, n_terms = len(words), sum(n for _, _, n in words)
    df = Counter(t for _, c, _ in words for t in c)
    out = []
    for item, text in items:
        query, scored = Counter(split_words((text or "").encode())), []
        for i, c, n in words:
            m = 100 - 75 + (75 * n * n_docs) // n_terms
            score = sum(q * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m)) for t, q in query.items() if t in c)
            if score > 0:
                scored.append((-score, i is None, i or 0))
        out += [(item, r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=repr)


def rows(df):
    assert df.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted((tuple(r) for r in df.collect()), key=repr)


def corpus(seed, n, vocabulary=300):
    rng = random.Random(seed)
    word = lambda: f"w{int(vocabulary * rng.random() ** 3)}"
    docs = [(k, " ".join(word() for _ in range(rng.randrange(1, 80)))) for k in range(n)]
    return rng, word, docs


@pytest.mark.parametrize("shard, first", [(8 << 20, 32), (2000, 2)])
def test_all_scores(spark, monkeypatch, shard, first):
    monkeypatch.setattr(wand, "SHARD_BYTES", shard)
    monkeypatch.setattr(wand, "FIRST", first)
    rng, word, docs = corpus(2, 600)
    docs += [(1000 + k, docs[k % 7][1]) for k in range(60)]  # ties
    items = [(k, " ".join(word() for _ in range(rng.randrange(1, 30)))) for k in range(25)]
    df, queries = spark.createDataFrame(docs, "doc_id long, text string").repartition(5), spark.createDataFrame(items, "item_id long, text string")
    assert rows(wand.rank_documents(df, queries)) == want(docs, items)
    assert rows(wand.rank_documents(df, queries, k=3, block_bytes=500)) == want(docs, items, 3)


def test_edges(spark):
    docs = [(4, "Alpha BETA, beta"), (2, "alpha-beta beta"), (2, "alpha-beta beta"), (None, "alpha beta beta"), (7, None), (8, ""), (9, "?!"), (1, "Äpfel äpfel x9"), (3, "gamma " * 200_000)]
    items = [(1, "alpha beta BETA"), (1, "Äpfel"), (None, "gamma x9"), (5, None), (6, "absent"), (7, ""), (8, "alpha")]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, item_id int, score string").repartition(3)
    queries = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, n int")
    assert rows(wand.rank_documents(df, queries)) == want(docs, items)
    none = spark.createDataFrame([], "doc_id long, text string")
    assert rows(wand.rank_documents(none, queries)) == []
    assert rows(wand.rank_documents(df, spark.createDataFrame([], "item_id string, text string"))) == []


def test_documents_that_cannot_win_are_skipped():
    """A frequent term alone can't reach the heap: its list is passed in leaps."""
    looked = []

    class Scores(list):
        def __getitem__(self, k):
            looked.append(k)
            return super().__getitem__(k)

    rare = ([5, 50, 500], [100, 100, 100], 100)
    common = (list(range(1000)), Scores([10] * 1000), 10)
    heap = []
    wand.wand([common, rare], heap, 2, 1, list(range(1000)))
    assert sorted(heap) == [(110, -50), (110, -5)]
    assert len(looked) < 20


def test_index_serves_several_searches(spark):
    _, word, docs = corpus(5, 100)
    scratch = Scratch(spark, "test-wand")
    index = wand.build_index(spark.createDataFrame(docs, "doc_id long, text string"), scratch)
    for seed in (1, 2):
        items = [(seed, " ".join(word() for _ in range(5)))]
        assert rows(wand.search(index, spark.createDataFrame(items, "item_id long, text string"), scratch)) == want(docs, items)
    scratch.close()
