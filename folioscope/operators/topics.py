"""Topic discovery: TF-IDF, reduction, k-means, naming, distances and representatives."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions import text as t
from folioscope.operators import features, kmeans
from folioscope.operators.reduce import _add_rows, right_singular_vectors
from folioscope.operators.select import medians
from folioscope.operators.work import bound_batches, settled

cloudpickle.register_pickle_by_value(sys.modules[__name__])


@dataclass(frozen=True)
class TopicConfig:
    min_text_length: int = 80
    max_text_chars: int = 6000
    min_df: int = 2
    max_df: float = 0.85
    features: int = 4000
    dims: int = 50
    k_min: int = 160
    k_max: int = 160
    starts: int = 8
    silhouette_rows: int = 1000
    seed: int = 42
    stopwords: tuple[str, ...] = field(default=())


def select_texts(df: DataFrame, text: str, config: TopicConfig = TopicConfig()) -> DataFrame:
    """Rows with enough text; the length is tested before the text is cut."""
    return df.filter(F.length(text) >= config.min_text_length).withColumn(text, F.substring(text, 1, config.max_text_chars))


def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of tokens -> of each batch its terms, how often they occur and in how many rows: only these are shuffled."""
    import pyarrow.compute  # noqa: F401

    for batch in batches:
        lists = batch.column(0)
        told = lists.flatten().dictionary_encode()
        codes, size = told.indices.to_numpy(zero_copy_only=False).astype(np.int64), len(told.dictionary)
        if size:
            of = pa.compute.list_parent_indices(lists).to_numpy(zero_copy_only=False).astype(np.int64)
            rows = np.bincount(np.unique(of * size + codes) % size, minlength=size)
            yield pa.RecordBatch.from_arrays([told.dictionary, pa.array(np.bincount(codes, minlength=size).astype(np.int64)), pa.array(rows.astype(np.int64))], ["term", "cf", "df"])


def _one_row_each(rows: DataFrame, key: str) -> DataFrame:
    """Rows (key, tokens) with those of equal keys as one; rows without a key go. Only where keys repeat are rows shuffled."""
    rows = rows.filter(F.col(key).isNotNull())
    again = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(key)
    if again.isEmpty():
        return rows
    merged = rows.join(again, key, "left_semi").groupBy(key).agg(F.flatten(F.collect_list("tokens")).alias("tokens"))
    return rows.join(again, key, "left_anti").unionByName(merged)


def vocabulary(df: DataFrame, tokens: Column, min_df: int = 2, max_df: float = 0.85, features: int = 4000) -> DataFrame:
    """(term, idf): the most frequent terms, of equal ones the first in the alphabet; ln((1 + n) / (1 + df)) + 1. At most ``features`` rows."""
    bound_batches(df.sparkSession)
    n = df.count()
    counted = df.select(tokens.alias("tokens")).mapInArrow(_term_counts, "term string, cf long, df long")
    terms = counted.groupBy("term").agg(F.sum("cf").alias("cf"), F.sum("df").alias("df")).filter((F.col("df") >= min_df) & (F.col("df") <= max_df * n))
    return terms.orderBy(F.desc("cf"), "term").limit(features).select("term", (F.log((n + 1.0) / (F.col("df") + 1.0)) + 1.0).alias("idf"))


def weigh(df: DataFrame, key: str, tokens: Column, words: DataFrame) -> DataFrame:
    """(key, term, weight): counts times idf, rows at unit length. words: (term, idf), bounded, so it is sent to every task. A row's weights are formed where it lies; nothing is shuffled."""
    spark = df.sparkSession
    bound_batches(spark)
    told = words.orderBy("term").collect()
    terms, idf = [r["term"] for r in told], np.array([r["idf"] for r in told], float)
    rows = _one_row_each(df.select(F.col(key), tokens.alias("tokens")), key)
    each = rows.select(key, sparse_rows(F.col("tokens"), terms, idf).alias("x")).select(key, F.explode(F.arrays_zip("x.indices", "x.values")).alias("e"))
    names = F.broadcast(spark.createDataFrame(list(enumerate(terms)), "indices int, term string"))
    return each.select(key, "e.indices", F.col("e.values").alias("weight")).join(names, "indices").select(key, "term", "weight")


def tfidf(df: DataFrame, key: str, tokens: Column, min_df: int = 2, max_df: float = 0.85, features: int = 4000) -> DataFrame:
    """(key, term, weight): counts times smoothed idf, rows at unit length; terms by corpus frequency, then alphabet. Only terms of the vocabulary are counted for each row."""
    rows = df.select(F.col(key), tokens.alias("tokens"))
    return weigh(rows, key, F.col("tokens"), vocabulary(rows, F.col("tokens"), min_df, max_df, features))


def top_terms(weights: DataFrame, cluster: str, sizes: DataFrame, k: int = 10) -> DataFrame:
    """(cluster, term, weight, rank): terms of the highest mean weight over all of the cluster's members. sizes: (cluster, size)."""
    means = weights.groupBy(cluster, "term").agg(F.sum("weight").alias("w")).join(sizes, cluster).select(cluster, "term", F.round(F.col("w") / F.col("size"), 6).alias("weight"))
    rank = F.row_number().over(Window.partitionBy(cluster).orderBy(F.desc("weight"), "term"))
    return means.filter("weight > 0").withColumn("rank", rank).filter(F.col("rank") <= k)


def topic_name(terms: Column) -> Column:
    return F.concat(F.array_join(F.slice(terms, 1, 3), "、"), F.lit("类"))


def distance_confidence(rows: DataFrame, cluster: str, distance: str) -> DataFrame:
    """Adds exp(-distance / median of the cluster); the median is 1e-6 at least."""
    scale = medians(rows, cluster, distance).select(cluster, F.greatest("median", F.lit(1e-6)).alias("scale"))
    return rows.join(scale, cluster).withColumn("confidence", F.exp(-F.col(distance) / F.col("scale"))).drop("scale")


def representatives(rows: DataFrame, cluster: str, distance: str, key: str, n: int = 3) -> DataFrame:
    """The n nearest members of each cluster."""
    rank = F.row_number().over(Window.partitionBy(cluster).orderBy(distance, key))
    return rows.withColumn("rank", rank).filter(F.col("rank") <= n)


def cluster_summary(rows: DataFrame, cluster: str, distance: str) -> DataFrame:
    n = rows.groupBy(cluster).agg(F.count(F.lit(1)).alias("size"), F.round(F.avg("confidence"), 6).alias("mean_confidence"))
    n = n.join(medians(rows, cluster, distance).select(cluster, F.round("median", 6).alias("median_distance")), cluster)
    total = n.agg(F.sum("size").alias("total"))
    return n.join(F.broadcast(total)).withColumn("share", F.round(F.col("size") / F.col("total"), 6)).drop("total")


def sparse_rows(tokens: Column, terms: list[str], idf: np.ndarray) -> Column:
    """struct<indices, values>: the known terms of a list of tokens, counts times idf, at unit length. terms and idf are bounded by the number of features."""

    @F.arrow_udf("struct<indices:array<int>,values:array<double>>")
    def run(column: pa.Array) -> pa.Array:
        import pyarrow.compute  # noqa: F401

        at = pa.compute.index_in(column.flatten(), value_set=pa.array(terms, pa.string()))
        known = at.is_valid().to_numpy(zero_copy_only=False)
        of = pa.compute.list_parent_indices(column).to_numpy(zero_copy_only=False)[known].astype(np.int64)
        entries, times = np.unique(of * len(terms) + at.drop_null().to_numpy(zero_copy_only=False).astype(np.int64), return_counts=True)
        row, i = np.divmod(entries, max(len(terms), 1))
        w = times * idf[i]
        w = w / np.sqrt(np.bincount(row, w * w, minlength=len(column)))[row]
        cuts = pa.array(np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(column)))]), pa.int32())
        return pa.StructArray.from_arrays([pa.ListArray.from_arrays(cuts, pa.array(x)) for x in (i.astype(np.int32), w)], ["indices", "values"])

    return run(tokens)


def projected(sparse: Column, v: np.ndarray) -> Column:
    """Sparse rows times v (features x dims), at unit length; a row without a known term stays zero."""

    @F.arrow_udf("array<double>")
    def run(column: pa.Array) -> pa.Array:
        import pyarrow.compute  # noqa: F401

        ids, values = (column.field(k).flatten().to_numpy(zero_copy_only=False) for k in (0, 1))
        of = pa.compute.list_parent_indices(column.field(0)).to_numpy(zero_copy_only=False)
        y = np.zeros((len(column), v.shape[1]))
        for a in range(0, len(ids), 1 << 16):
            k = slice(a, a + (1 << 16))
            _add_rows(y, of[k], values[k, None] * v[ids[k]])
        size = np.linalg.norm(y, axis=1, keepdims=True)
        y = y / np.where(size > 0, size, 1)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(column) + 1) * v.shape[1], pa.int32()), pa.array(y.ravel()))

    return run(sparse)


def embed(df: DataFrame, tokens: Column, config: TopicConfig = TopicConfig()) -> DataFrame:
    """Adds column ``embedding``: TF-IDF, reduced to config.dims dimensions, at unit length. Where there is too little to reduce, the weights of all terms. An empty table gives an empty result."""
    sparse, n, width, v = _reduced(df, tokens, config)
    if v is None:
        v = np.eye(max(width, 1))
    return sparse.withColumn("embedding", projected(F.col("__sparse"), v)).drop("__sparse")


def _reduced(df: DataFrame, tokens: Column, config: TopicConfig) -> tuple[DataFrame, int, int, np.ndarray | None]:
    """The rows with their sparse weights, written down; how many rows and terms there are; the directions to project on."""
    rows = features.spread(df).withColumn("__tokens", tokens)
    n = rows.count()
    words = vocabulary(rows, F.col("__tokens"), config.min_df, config.max_df, config.features).orderBy("term").collect()
    terms, idf = [r["term"] for r in words], np.array([r["idf"] for r in words])
    sparse = settled(rows.withColumn("__sparse", sparse_rows(F.col("__tokens"), terms, idf)).drop("__tokens"))
    if n <= 2 or len(terms) <= 2:
        return sparse, n, len(terms), None
    dims = max(2, min(config.dims, n - 1, len(terms) - 1))
    return sparse, n, len(terms), right_singular_vectors(sparse.select("__sparse.*"), len(terms), dims, config.seed)[0]


def cluster(df: DataFrame, k: int, config: TopicConfig = TopicConfig(), key: str | None = None) -> tuple[DataFrame, kmeans.Fit, float]:
    """The best of several mini-batch k-means fits by cost: (rows with cluster_id and distance_to_centroid, fit, cost). key: the column that batches are drawn by; without it, they are by the vectors."""
    found = kmeans.fit(df, key, "embedding", k, config.starts, config.seed)
    out = df.withColumn("__near", kmeans.nearest(F.col("embedding"), found.centers))
    return out.withColumns({"cluster_id": F.col("__near.cluster_id"), "distance_to_centroid": F.col("__near.distance")}).drop("__near"), found, found.cost


def choose_k(df: DataFrame, config: TopicConfig = TopicConfig(), key: str | None = None) -> tuple[int, dict[int, float]]:
    """The k of the best mean silhouette (Euclidean, of a sample), the smallest of equal ones, from 2 on; 1 for fewer than three rows. Each k is fitted with all of its starts. key: a column
    that tells rows apart; without it, they are numbered."""
    n = df.count()
    if n < 3:
        return 1, {}
    if key is None:
        df, key = settled(df.withColumn("__row", F.monotonically_increasing_id())), "__row"
    told = {}
    for k in range(max(2, min(config.k_min, n - 1)), max(2, min(config.k_max, n - 1)) + 1):
        told[k] = silhouette(cluster(df, k, config, key)[0], key, "cluster_id", "embedding", config.silhouette_rows).first()["silhouette"]
    return max(told, key=lambda k: (told[k] if told[k] is not None else -1.0, -k)), told


def default_tokens(column: str, config: TopicConfig = TopicConfig()) -> Column:
    return t.tokens(F.col(column), config.stopwords)


def family_rollup(summary: DataFrame, families: int = 8, terms: int = 3) -> DataFrame:
    """(family, size, mean_confidence, terms): the largest families with their terms of the largest summed size. summary: family, size, confidence, top_terms (joined by 、)."""
    sizes = summary.groupBy("family").agg(F.sum("size").alias("size"), F.round(F.avg("confidence"), 6).alias("mean_confidence"))
    top = sizes.orderBy(F.desc("size"), "family").limit(families)
    words = F.filter(F.transform(F.split(F.replace("top_terms", F.lit("，"), F.lit("、")), "、"), t.strip), lambda x: x != "")
    counts = summary.select("family", "size", F.explode(words).alias("term")).groupBy("family", "term").agg(F.sum("size").alias("n"))
    rank = F.row_number().over(Window.partitionBy("family").orderBy(F.desc("n"), "term"))
    best = counts.join(F.broadcast(top.select("family")), "family").withColumn("rank", rank).filter(F.col("rank") <= terms)
    told = best.groupBy("family").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda x: x["term"]), "、").alias("terms"))
    return top.join(told, "family", "left").select("family", "size", "mean_confidence", F.coalesce("terms", F.lit("")).alias("terms"))


def silhouette(df: DataFrame, key: str, cluster: str, vector: str, most: int = 1000, seed: str = "silhouette") -> DataFrame:
    """One row: the mean Euclidean silhouette of a sample of at most ``most`` rows, drawn by a hash of their keys. A member alone in its cluster counts 0. The sample meets itself, so its size is squared."""
    some = df.withColumn("__draw", F.md5(F.concat_ws("|", F.lit(seed), F.col(key).cast("string")).cast("binary"))).orderBy("__draw", key).limit(most)
    some = some.select(F.col(key).alias("k"), F.col(cluster).alias("c"), F.col(vector).cast("array<double>").alias("x"))
    other = F.broadcast(some.select(F.col("k").alias("k2"), F.col("c").alias("c2"), F.col("x").alias("x2")))
    pairs = some.join(other, F.col("k") != F.col("k2"))
    gap = F.sqrt(F.aggregate(F.zip_with("x", "x2", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, d: s + d))
    means = pairs.groupBy("k", "c", "c2").agg(F.avg(gap).alias("d"))
    by = means.groupBy("k", "c").agg(F.max(F.when(F.col("c") == F.col("c2"), F.col("d"))).alias("a"), F.min(F.when(F.col("c") != F.col("c2"), F.col("d"))).alias("b"))
    return by.agg(F.round(F.avg(F.coalesce((F.col("b") - F.col("a")) / F.greatest("a", "b"), F.lit(0.0))), 6).alias("silhouette"), F.count(F.lit(1)).alias("n"))
