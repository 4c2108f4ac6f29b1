"""Medians, reduction, clustering and blocks of prototypes, against plain numpy."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscope.operators import classify, kmeans, reduce, select, topics


@pytest.mark.parametrize("few", [2, 10_000])
def test_medians(spark, few):
    rng = random.Random(3)
    groups = {
        "one": [4.5], "two": [1.0, 2.0], "same": [7.0] * 50, "even": [rng.random() for _ in range(400)], "odd": [rng.gauss(0, 1e6) for _ in range(301)],
        "wide": [10.0 ** rng.uniform(-300, 300) for _ in range(200)], "ties": [float(rng.randrange(4)) for _ in range(101)], "split": [0.0] * 50 + [1e308] * 50, "signs": [-1e308, 1e308, -5.0], None: [1.0, 3.0, 2.0],
    }
    rows = [(g, x) for g, xs in groups.items() for x in [*xs, None]] + [("none", None)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, x double").repartition(4)
    got = {r.g: r["median"] for r in select.medians(df, "g", "x", few).collect()}
    assert set(got) == set(groups)
    for g, xs in groups.items():
        s = sorted(xs)
        assert got[g] == pytest.approx(s[(len(s) - 1) // 2] / 2 + s[len(s) // 2] / 2, rel=1e-12), g
    assert select.medians(df.limit(0), "g", "x").count() == 0


def sparse(spark, x):
    rows = [([int(i) for i in np.flatnonzero(r)], [float(v) for v in r[r != 0]]) for r in x]
    return spark.createDataFrame(rows, "indices array<int>, values array<double>").repartition(5)


def test_range_finder_gives_the_exact_space(spark):
    rng = np.random.default_rng(1)
    x = (rng.random((300, 40)) < 0.2) * rng.random((300, 40)) * np.linspace(3, 0.3, 40)
    df = sparse(spark, np.vstack([x, np.zeros((2, 40))]))
    assert np.allclose(reduce.gram_times(df, np.eye(40)), x.T @ x)
    v, values = reduce.right_singular_vectors(df, 40, 6)
    _, s, vt = np.linalg.svd(x, full_matrices=False)
    assert np.allclose(values, s[:6], rtol=1e-6) and np.allclose(v.T @ v, np.eye(6), atol=1e-9)
    assert np.linalg.norm(v - vt[:6].T @ (vt[:6] @ v), 2) < 1e-3
    again = reduce.right_singular_vectors(df, 40, 6)[0]
    assert np.allclose(v, again)
    low = reduce.right_singular_vectors(sparse(spark, np.outer(np.arange(1, 9), [1, 0, 2, 0, 0])), 5, 3)
    assert np.allclose(low[1][1:], 0, atol=1e-6) and np.allclose(abs(low[0][:, 0]), np.array([1, 0, 2, 0, 0]) / 5**0.5)


def test_embedding_of_documents_spans_the_exact_space(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    config = topics.TopicConfig(dims=10, features=500)
    rows, n, width, v = topics._reduced(docs, topics.default_tokens("text", config), config)
    x = np.zeros((n, width))
    for k, r in enumerate(rows.select("__sparse.*").collect()):
        x[k, r.indices] = r["values"]
    assert np.allclose(np.linalg.norm(x, axis=1)[np.abs(x).sum(axis=1) > 0], 1)
    vt = np.linalg.svd(x, full_matrices=False)[2][:10]
    assert np.linalg.norm(v - vt.T @ (vt @ v), 2) < 1e-3
    weights = topics.tfidf(docs, "doc_id", topics.default_tokens("text", config), config.min_df, config.max_df, 500).groupBy("doc_id").agg(F.sum("weight").alias("w")).collect()
    assert np.allclose(sorted(r.w for r in weights), sorted(x.sum(axis=1)[x.sum(axis=1) > 0]))


def points(seed, n, k, dims=5):
    rng = np.random.default_rng(seed)
    centers = rng.normal(0, 4, (k, dims))
    return centers[rng.integers(k, size=n)] + rng.normal(0, 1, (n, dims))


@pytest.mark.parametrize("n, batch", [(500, kmeans.BATCH), (6000, 200)])
def test_mini_batches_cost_little_more_than_full_passes(spark, monkeypatch, n, batch):
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    monkeypatch.setattr(kmeans, "BATCH", batch)
    x = points(2, n, 6)
    df = spark.createDataFrame([(k, r.tolist()) for k, r in enumerate(x)], "id int, x array<double>").repartition(4)
    fit = kmeans.fit(df, "id", "x", 6, starts=4)
    rows = df.select(array_to_vector("x").alias("features"))
    full = min(KMeans(k=6, seed=s).fit(rows).summary.trainingCost for s in range(4))
    assert fit.cost <= 1.02 * full and len(fit.costs) == 4 and fit.cost == min(fit.costs)
    assert fit.cost == pytest.approx((((x[:, None] - fit.centers[None]) ** 2).sum(axis=2)).min(axis=1).sum())
    again = kmeans.fit(df.repartition(3), "id", "x", 6, starts=4)
    assert np.allclose(fit.centers, again.centers)
    near = df.select("id", kmeans.nearest(F.col("x"), fit.centers).alias("c")).collect()
    gaps = np.sqrt(((x[:, None] - fit.centers[None]) ** 2).sum(axis=2))
    assert all(r.c.cluster_id == gaps[r.id].argmin() and r.c.distance == pytest.approx(gaps[r.id].min()) for r in near)


def test_equal_rows_and_few_rows(spark):
    df = spark.createDataFrame([(k, [1.0, 2.0]) for k in range(5)], "id int, x array<double>")
    fit = kmeans.fit(df, "id", "x", 3, starts=2)
    assert fit.cost == 0 and fit.centers.shape == (3, 2)


def test_number_of_clusters_by_silhouette(spark):
    """Three clear groups; the silhouettes are those of plain numpy."""
    x = points(5, 90, 3, 4)
    df = spark.createDataFrame([(k, r.tolist()) for k, r in enumerate(x)], "id int, embedding array<double>")
    config = topics.TopicConfig(k_min=1, k_max=4, starts=3)
    best, told = topics.choose_k(df, config, "id")
    assert sorted(told) == [2, 3, 4] and best == max(told, key=told.get)
    for k, value in told.items():
        of = {r.id: r.cluster_id for r in topics.cluster(df, k, config, "id")[0].collect()}
        c, d = np.array([of[i] for i in range(len(x))]), np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
        s = []
        for i in range(len(x)):
            own = (c == c[i]) & (np.arange(len(x)) != i)
            a, b = d[i, own].mean() if own.any() else 0, min(d[i, c == o].mean() for o in set(c) - {c[i]})
            s.append((b - a) / max(a, b) if own.any() else 0)
        assert value == pytest.approx(np.mean(s), abs=1e-6)
    assert topics.choose_k(df.limit(2), config, "id") == (1, {})


def test_blocks_of_prototypes(spark):
    rng = np.random.default_rng(4)
    df = spark.createDataFrame([(k, r.tolist()) for k, r in enumerate(rng.normal(0, 1, (40, 6)))], "id int, x array<double>")
    protos = rng.normal(0, 1, (11, 6))
    protos[7] = protos[2]  # a tie: the larger id is better
    table = spark.createDataFrame([(k, (r / np.linalg.norm(r)).tolist()) for k, r in enumerate(protos)], "cluster_id long, centroid array<double>")
    key = lambda rows: sorted(tuple(r) for r in rows.collect())
    whole = key(classify.top_prototypes(df, table, "id", "x", 3))
    assert len(whole) == 120
    assert key(classify.top_prototypes(df, table, "id", "x", 3, block=3)) == whole
    assert key(classify.top_prototypes(df, table, "id", "x", 3, block_bytes=6 * 8 * 4)) == whole
    assert key(classify.top_prototypes(df, table.limit(2), "id", "x", 3, block=1)) == key(classify.top_prototypes(df, table.limit(2), "id", "x", 3))
    assert classify.top_prototypes(df, table.limit(0), "id", "x", 3).count() == 0


def test_weights_are_formed_where_rows_lie(spark):
    """No shuffle of (row, term) pairs; rows of one key are one row, as before, and rows without a key go."""
    from pyspark.sql import functions as F

    from folioscope.operators import topics

    rows = [(1, ["a", "b", "a"]), (2, ["b", "c"]), (2, ["c", "x"]), (None, ["a"]), (3, []), (4, None)]
    df = spark.createDataFrame(rows, "id int, tokens array<string>")
    words = spark.createDataFrame([("a", 2.0), ("b", 1.0), ("c", 3.0)], "term string, idf double")
    got = {(r.id, r.term): round(r.weight, 9) for r in topics.weigh(df, "id", F.col("tokens"), words).collect()}
    one, two = (16 + 1) ** 0.5, (1 + 36) ** 0.5
    assert got == {k: round(v, 9) for k, v in {(1, "a"): 4 / one, (1, "b"): 1 / one, (2, "b"): 1 / two, (2, "c"): 6 / two}.items()}
    plan = topics.weigh(df.filter("id <> 2"), "id", F.col("tokens"), words)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan
    told = {r.term: round(r.idf, 9) for r in topics.vocabulary(df, F.col("tokens"), 2, 1.0).collect()}
    assert set(told) == {"a", "b", "c"}


def test_characters_and_tokens_without_a_match_each(spark):
    import re

    from pyspark.sql import functions as F

    from folioscope.functions import text as t

    texts = ["", "ab  12\t\tc3 . é1 1é ÉÉ a_ _1 1_a 汉1 汉 😀x9 \x0b \f q\t", " \n\n\n\n x", "𝟘𝟙 12ab", None]
    df = spark.createDataFrame([(x,) for x in texts], "x string")
    for kind in ("[A-Za-z]", r"\p{Nd}", t.PUNCTUATION, f"[{t.SPACE}]", t.HAN):
        assert all(r[0] == r[1] for r in df.select(t.count(F.col("x"), kind), t.count_chars(F.col("x"), kind)).collect())
    assert "regexp_extract_all" not in df.select(t.latin_ratio(F.col("x")))._jdf.queryExecution().analyzed().toString()
    old = F.filter(F.regexp_extract_all(F.lower("x"), F.lit(r"([\p{L}\p{N}_]{2,})"), F.lit(1)), lambda w: w.rlike(r"[a-z]|" + t.HAN))
    assert all(r[0] == r[1] for r in df.select(old, t.tokens(F.col("x"))).collect())
    for r in df.select("x", t.normalize(F.col("x")).alias("n")).collect():
        assert r.n == re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t\f\x0b]+", " ", r.x or "")).strip()


def test_classifier_has_few_workers_and_small_batches(spark, sf):
    """One Python step for all fields, one for split and one for child rules; fields aren't made a second time for the filter on them."""
    from folioscope.plans import registry

    df = registry.QUERIES["risk_score"](spark, sf)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython [") == 3
    assert not any("regexp_replace" in line for line in plan.splitlines() if line.lstrip(" :+-*()0123456789").startswith(("Filter", "FileScan")))
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == "8m" and int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 2000
