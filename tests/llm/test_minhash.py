"""Tensored banding against a comparison of all pairs."""

from __future__ import annotations

import random

import numpy as np
import pytest

from folioscope.llm import minhash
from folioscope.llm.similar import shingle_set

SCHEMA = "doc_id long, text string, set_id int, key string"


def shingles(text, words=2):
    w = "".join(c.lower() if c.isascii() else c for c in text or "").encode().split()
    return {tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))} if w else set()


def want(rows, words=2):
    sets = [shingles(t, words) for _, t in rows]
    root = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and root[a] != root[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                old, new = root[a], root[b]
                root = [new if r == old else r for r in root]
    ids = {}
    for (i, _), r in zip(rows, root, strict=True):
        ids.setdefault(r, []).append(i)
    least = {r: min((i for i in x if i is not None), default=None) for r, x in ids.items()}
    return sorted(((i, len(s), least[r]) for (i, _), s, r in zip(rows, sets, root, strict=True)), key=repr)


def run(spark, rows, **options):
    out = minhash.similar_groups(spark.createDataFrame([(i, t, 1, "x") for i, t in rows], SCHEMA).repartition(4), **options)
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in out.collect()), key=repr)


def varied(rng, base, changes):
    words = list(base)
    for _ in range(changes):
        words[rng.randrange(len(words))] = f"n{rng.random()}"
    return " ".join(words)


def test_all_groups(spark):
    rng = random.Random(3)
    rows = []
    for base in range(12):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(60, 200))]
        rows += [(len(rows) + k, varied(rng, words, rng.randrange(0, len(words) // 9))) for k in range(rng.randrange(2, 12))]
    rows += [(900 + k, f"single {k} " * 3) for k in range(20)]
    got = run(spark, rows)
    assert got == want(rows)
    assert len({r[2] for r in got}) < len(rows) - 20


def test_edges(spark):
    rows = [(5, None), (3, ""), (9, " \n\t"), (7, "one"), (6, "ONE "), (4, "Äpfel eins"), (2, "äpfel eins"), (8, "a b"), (1, "A\x0bB"), (1, "A\x0bB"), (None, "a  b"), (None, "lonely words here"), (20, "x y " * 300_000), (21, "X Y " * 10), (22, "p q r s t u v w x y"), (23, "p q r s t u v w x")]
    assert run(spark, rows) == want(rows)
    out = minhash.similar_groups(spark.createDataFrame([(1, "a b"), (2, "a b"), (3, "")], "doc_id long, text string"))
    assert {(r.doc_id, r.kept) for r in out.collect()} == {(1, True), (2, False), (3, True)}
    assert minhash.similar_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_other_shingles(spark):
    rows = [(k, " ".join(f"w{j}" for j in range(k % 3, 60))) for k in range(6)]
    assert run(spark, rows, words=5) == want(rows, 5)


def test_crowd_takes_as_many_comparisons_as_members(spark, monkeypatch):
    rng = random.Random(1)
    base = [f"w{k}" for k in range(150)]
    rows = [(k, varied(rng, base, 3)) for k in range(600)]
    seen = []
    own = minhash.verified
    monkeypatch.setattr(minhash, "verified", lambda pairs, *a: (seen.append(pairs.count()), own(pairs, *a))[1])
    assert {r[2] for r in run(spark, rows)} == {0}
    assert sum(seen) < 3 * len(rows)


def test_minhashes_estimate_similarity():
    rng = random.Random(5)
    for share in (0.3, 0.8, 0.95):
        same, n = [], 400
        for _ in range(30):
            common = [f"c{rng.random()}" for _ in range(int(n * share))]
            rest = (n - len(common)) // 2
            a, b = (np.sort(np.concatenate([shingle_set(x.encode(), 1) for x in common + [f"{side}{rng.random()}" for _ in range(rest)]])) for side in "ab")
            x, y = minhash.minhashes(a), minhash.minhashes(b)
            same.append((x == y).mean())
            if share == 0.95:
                of = [minhash.sketch(v)[0] for v in (x, y)]
                assert ((of[0] == of[1]) == (x == y).reshape(-1, minhash.ROWS).all(axis=1)).all()
        assert abs(np.mean(same) - share) < 0.02


@pytest.mark.parametrize("similarity, least", [(0.8, 0.9999), (0.9, 0.9999)])
def test_tables_find_similar_pairs(similarity, least):
    """The chance that two sets share a sketch of each collection, as the tables need."""
    one = 1 - (1 - similarity**minhash.ROWS) ** minhash.SKETCHES
    assert one * one > least


def test_parity_sketches_never_differ_more_than_the_sets():
    rng = random.Random(8)
    for _ in range(50):
        a, b = ({f"s{rng.randrange(400)}" for _ in range(rng.randrange(1, 300))} for _ in range(2))
        x, y = (minhash.parity(np.sort(np.concatenate([shingle_set(w.encode(), 1) for w in s]))) for s in (a, b))
        assert sum(int(k).bit_count() for k in (x ^ y).view(np.uint64)) <= len(a ^ b)
