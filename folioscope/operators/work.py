"""Steps that are written down between passes, so that a lost executor never costs more than one of them."""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import DataFrame, SparkSession

#: Bytes and rows of a batch that goes to Python at once, where the session has Spark's own settings.
BATCHES = {"spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "8m"), "spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "2000")}


def bound_batches(spark: SparkSession) -> None:
    """Batches are bounded by bytes, so that a worker's memory doesn't follow the size of a partition. A setting of the session's own stays."""
    for name, (default, ours) in BATCHES.items():
        if spark.conf.get(name, default) == default:
            spark.conf.set(name, ours)


def settled(df: DataFrame) -> DataFrame:
    """The rows, written to the checkpoint folder that driver and executors share (spark.checkpoint.dir). Only in local mode, where there is one machine, a local folder takes its place if that is unset."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        found = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not found:
            if not re.match(r"local(\[|$)", context.master):
                raise ValueError("spark.checkpoint.dir isn't set: work tables need a folder that all executors share")
            found = f"file://{tempfile.gettempdir()}/folioscope-steps-{os.getuid()}"
        context.setCheckpointDir(found)
    return df.checkpoint()
