"""Bounded samples of labelled texts, for the operators that fit a classifier."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sample_labels(labels: DataFrame, keep: Column, id_col: str, label_col: str, per_class: int) -> tuple[DataFrame, dict[int, int]]:
    """(doc_id, label) of at most per_class rows of each label 0 and 1, and how many there are of each in all.

    Rows with a null id or label are out; several labels for one id count as the largest. The sample goes by a hash of
    the id, so it is the same on every run and doesn't depend on the order of the rows. Its size is bounded, so it may be broadcast."""
    rows = labels.filter(keep & labels[id_col].isNotNull() & labels[label_col].isin(0, 1))
    rows = rows.groupBy(labels[id_col].alias("id")).agg(F.max(labels[label_col]).cast("int").alias("label"))
    sizes = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    parts = [rows.filter(F.col("label") == k).orderBy(F.xxhash64("id"), "id").limit(per_class) for k in (0, 1)]
    return F.broadcast(parts[0].unionByName(parts[1])), {k: sizes.get(k, 0) for k in (0, 1)}


def labelled_texts(df: DataFrame, chosen: DataFrame, id_col: str, text_col: str, *columns: str) -> DataFrame:
    """(id, the named columns of chosen, text) of the chosen ids; null texts are empty. Of several rows with one id the least text is taken, so the sample's bound
    holds; texts are only shuffled if there are such rows."""
    ids = df.select(df[id_col].alias("id")).join(F.broadcast(chosen.select("id")), "id")
    rows = df.select(df[id_col].alias("id"), F.coalesce(df[text_col], F.lit("")).alias("text")).join(F.broadcast(chosen), "id")
    if ids.groupBy("id").count().filter("count > 1").isEmpty():
        return rows.select("id", *columns, "text")
    return rows.groupBy("id").agg(*(F.min(c).alias(c) for c in (*columns, "text")))


def text_scores(text: Column, score: Callable[[list[bytes]], "object"], limit: int) -> Column:
    """A double for each whole text, from a function over a list of UTF-8 texts (null as empty) that sees about ``limit`` bytes at a time."""
    from folioscope.llm.shared import text_batches, text_bytes

    @F.arrow_udf("double")
    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            out: list[float] = []
            for part in text_batches(iter([pa.RecordBatch.from_arrays([column], ["text"])]), limit=limit):
                out += list(map(float, score(text_bytes(part.column(0)))))
            yield pa.array(out, pa.float64())

    return run(text)
