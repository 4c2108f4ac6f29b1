"""Documents and review actions as they arrive: the same expressions as in batch, on streams."""

from __future__ import annotations

from hashlib import sha256
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from folioscope.operators import features


def feature_stream(documents: DataFrame, **options) -> DataFrame:
    """Feature rows of a stream of parsed documents: a projection, so append mode and no state."""
    return features.feature_rows(documents, **options)


def _newest(rows: DataFrame, doc: str, at: str, tie: str) -> DataFrame:
    return rows.groupBy(doc).agg(F.max_by(F.struct(*(c for c in rows.columns if c != doc)), F.struct(at, tie)).alias("r")).select(doc, "r.*").select(*rows.columns)


def _folder(spark: SparkSession, path: str):
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    return there, there.getFileSystem(spark._jsc.hadoopConfiguration())


def _run_name(spark: SparkSession, path: str, checkpoint: str) -> str:
    """What the batches of this checkpoint begin with, so that another stream into the same table takes other names; it is noted beside the table."""
    runs, fs = _folder(spark, f"{path}/_runs")
    fs.mkdirs(runs)
    own = sha256(checkpoint.encode()).hexdigest()[:16]
    known = sorted(x.getPath().getName() for x in fs.listStatus(runs))
    mine = next((n for n in known if n.endswith(own)), None)
    if mine is None:
        mine = f"{len(known):04d}-{own}"
        fs.mkdirs(_folder(spark, f"{path}/_runs/{mine}")[0])
    n = int(mine.split("-")[0])
    return f"r{n}-" if n else ""


def latest_reviews(log: DataFrame, path: str, checkpoint: str, doc: str = "doc_id", at: str = "updated_at", tie: str = "event_id") -> StreamingQuery:
    """Stores the newest log rows of an append-only stream at path. Each micro-batch adds one folder, with the newest row of each of its documents; a batch that is run again
    replaces its own folder. Nothing that is there already is rewritten: newest_reviews takes the newest row over all folders, merge_reviews makes one of them."""
    name = _run_name(log.sparkSession, path, checkpoint)

    def add(batch: DataFrame, batch_id: int) -> None:
        _newest(batch, doc, at, tie).write.mode("overwrite").parquet(f"{path}/{name}{batch_id}")

    return log.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def newest_reviews(spark: SparkSession, path: str, schema: StructType | str, doc: str = "doc_id", at: str = "updated_at", tie: str = "event_id") -> DataFrame:
    """The newest row of each document over all that latest_reviews has stored."""
    return _newest(spark.read.schema(schema).option("recursiveFileLookup", True).parquet(path), doc, at, tie)


def merge_reviews(spark: SparkSession, path: str, schema: StructType | str, **names: str) -> None:
    """Replaces the folders that are there now by one with the newest rows. A reader in between may see rows twice, never miss one."""
    root, fs = _folder(spark, path)
    old = [x.getPath() for x in fs.listStatus(root) if not x.getPath().getName().startswith("_")]
    newest_reviews(spark, path, schema, **names).write.parquet(f"{path}/merged-{uuid4().hex}")
    for folder in old:
        fs.delete(folder, True)


def windowed_reviews(log: DataFrame, at: str = "updated_at", status: str = "status", late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Review actions by day and status; rows later than ``late`` are left out."""
    return log.withWatermark(at, late).groupBy(F.window(at, width).alias("w"), status).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("day"), status, "n")
