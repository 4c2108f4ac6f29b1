"""What the training-data operators share: work tables, text expressions, byte-bounded batches."""

from __future__ import annotations

import atexit
import os
import re
import tempfile
import uuid
from collections.abc import Iterator
from itertools import count

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: A word, as the contracts define it.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session. Only in local mode, where there is one machine, a local folder takes its place if that is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir isn't set: work tables need a folder that all executors share")
        found = f"file://{tempfile.gettempdir()}/folioscope-{os.getuid()}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Bytes of a batch that goes to Python at once, where the session has Spark's own setting.
BATCH = "8m"


def bound_batches(spark: SparkSession) -> None:
    """Batches of texts are bounded by bytes, not by 10,000 rows alone. A setting of the session's own stays."""
    name, default = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"
    if spark.conf.get(name, default) == default:
        spark.conf.set(name, BATCH)


#: Rows of a file of a work table whose size is bounded beforehand.
ROWS_A_FILE = 500_000


class Scratch:
    """Work tables of one operator call, as Parquet in the shared folder.

    A saved table cuts the lineage: it survives lost executors and is the same for every reader.
    Tables are deleted by ``drop`` once nothing reads them, the rest when the driver ends."""

    def __init__(self, spark: SparkSession, name: str):
        bound_batches(spark)
        self.spark, self.at, self.numbers = spark, f"{shared_dir(spark)}/folioscope/{name}-{uuid.uuid4().hex}", count()
        atexit.register(self.close)

    def _delete(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        if jvm is not None:
            there = jvm.org.apache.hadoop.fs.Path(path)
            there.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(there, True)

    def save(self, df: DataFrame, tag: str, most: int | None = None, rows_a_group: int | None = None) -> DataFrame:
        """most: an upper bound of the rows, if one is known; then no more files are written than that takes. rows_a_group: for tables of large rows,
        how many are written, and read, at once."""
        path = f"{self.at}/{next(self.numbers)}-{tag}"
        if most is not None:
            df = df.coalesce(4 + most // ROWS_A_FILE)
        writer = df.write.option("compression", "zstd")
        (writer.option("parquet.block.row.count.limit", str(rows_a_group)) if rows_a_group else writer).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for table in tables:
            self._delete(table._scratch_path)

    def close(self) -> None:
        try:
            self._delete(self.at)
        except Exception:  # the session may be gone already
            pass


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, nothing else changed. For text of one byte a character lower() does just that, and faster."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def own_columns(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that no other column of the input can clash."""
    return df.select(*(df[f"`{n}`"] for n in names))


def fresh(df: DataFrame, name: str) -> str:
    """The name, with as many underscores before it as it takes to be none of the table's (names don't tell upper from lower case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


#: Keys of dropped rows are sent to every task up to so many; beyond, they are joined.
BROADCAST_KEYS = 1_000_000


def drop_rows(df: DataFrame, id_col: str, key: Column, rows: DataFrame, scratch: Scratch) -> DataFrame:
    """df without some of its rows; all its columns stay, under whatever names.

    key: an expression over df that tells rows of one id apart. rows: (id, key, kept) of all rows of df. Rows that are equal in id and key are
    one: all go if none is kept, else one stays. Only keys of rows that go are joined, so texts aren't shuffled while those are few enough to be sent."""
    told = rows.groupBy("id", "key").agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("n")).filter("NOT kept OR n > 1")
    told = scratch.save(told, "dropped-keys")
    i, k, own = (fresh(df, c) for c in ("dropped_id", "dropped_key", "own_key"))
    out = df.withColumn(own, key)

    def join(left: DataFrame, keys: DataFrame, how: str) -> DataFrame:
        keys = keys.select(F.col("id").alias(i), F.col("key").alias(k))
        keys = F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys
        return left.join(keys, left[f"`{id_col}`"].eqNullSafe(keys[i]) & (left[own] == keys[k]), how)

    repeated = told.filter("kept")
    if not repeated.isEmpty():
        out = join(out, repeated, "left_anti").unionByName(join(out, repeated, "left_semi").dropDuplicates([id_col, own]))
    return join(out, told.filter("NOT kept"), "left_anti").drop(own)


def text_key(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of doc_id as text, modulo n. A null doc_id counts as the empty text."""
    return (F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n).cast("int")


def give_back() -> None:
    """Returns memory that is free to the system, as far as the platform can: Python workers live on between tasks, beside those of the next stage."""
    import ctypes

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def text_batches(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about ``limit`` bytes of text each (one row at least), so that memory follows the slice and not the batch."""
    import numpy as np

    for batch in batches:
        if not batch.num_rows:
            continue
        texts = batch.column(batch.schema.get_field_index(column))
        sizes = pa.compute.fill_null(pa.compute.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        part = (np.cumsum(sizes) - sizes) // limit
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield batch.slice(a, b - a)
        give_back()


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 of each text, null as empty."""
    return [x or b"" for x in column.cast(pa.binary() if pa.types.is_string(column.type) else pa.large_binary()).to_pylist()]
