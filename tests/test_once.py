"""Rows that are expensive to form are formed once."""

import numpy as np
from pyspark.sql import functions as F

from folioscope.operators import classify
from folioscope.plans import registry


def test_review_queue_forms_its_rows_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(x):
        seen.add(1)
        return x / 1000

    rows = spark.range(0, 1000, 1, 4).select(F.col("id").alias("doc_id"), F.lit("ok").alias("dataset"), counted("id").alias("risk_score"))
    rows = rows.withColumn("risk_level", classify.level(F.col("risk_score"))).withColumns({"margin": F.col("doc_id") % 7 / 7.0, "confidence": F.lit(0.5), "review_flag": F.when(F.col("doc_id") >= 350, 1).otherwise(0)})
    got = classify.review_queue(rows).collect()
    assert seen.value == 650  # of the flagged rows, each once
    assert [r.doc_id for r in got] == list(range(999, 349, -1))


def test_prototypes_of_labelled_texts(spark, sf, monkeypatch):
    """The prototypes are the same whether labelled ids are sent or joined."""
    sent = registry.model(spark, sf)
    monkeypatch.setattr(registry, "IDS_SENT", 0)
    joined = registry.model(spark, sf)
    assert sent.terms == joined.terms and sent.prototypes == joined.prototypes
    assert np.allclose(sent.centroids, joined.centroids)
