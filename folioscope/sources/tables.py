"""CSV and JSON-lines tables, and the outputs of a stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from folioscope.functions import text as t
from folioscope.operators.priority import Scenario
from folioscope.sources import files


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """UTF-8 with or without BOM, header, all columns text; quotes double themselves, fields may span lines; blank rows are left out."""
    rows = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"', encoding="UTF-8", inferSchema=False)
    rows = rows.withColumnsRenamed({c: c.lstrip("﻿") for c in rows.columns if c.startswith("﻿")})
    return rows.filter(F.length(F.concat_ws("", *(F.trim(F.coalesce(rows[f"`{c}`"], F.lit(""))) for c in rows.columns))) > 0)


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """One object a line; blank lines and lines that are no object are left out."""
    lines = spark.read.text(path).filter("trim(value) <> ''")
    return lines.select(F.from_json("value", schema).alias("r")).filter("r is not null").select("r.*")


def read_scenarios(df: DataFrame, names: tuple[str, str, str, str] = ("场景编号", "人工工时", "自动归档上限", "人工复核上限")) -> list[Scenario]:
    """Resource scenarios of a small table; missing numbers are 0."""
    value = lambda c: t.safe_double(df[f"`{c}`"]) if c in df.columns else F.lit(0.0)
    rows = df.select(df[f"`{names[0]}`"].cast("string").alias("i"), *(value(c).alias(n) for c, n in zip(names[1:], "hal", strict=True))).collect()
    return [Scenario(r["i"] or "", r["h"], int(r["l"]), int(r["a"])) for r in rows]


def read_scenario_sheet(spark: SparkSession, path: str, **names: tuple[str, str, str, str]) -> list[Scenario]:
    """Resource scenarios of the first sheet of an XLSX file (a small one, read on the driver)."""
    data = spark.read.format("binaryFile").load(path).select("content").first()
    rows = files.read_scenario_rows(bytes(data["content"])) if data else []
    if not rows:
        return []
    columns = list(rows[0])
    return read_scenarios(spark.createDataFrame([tuple(r.get(c, "") for c in columns) for r in rows], ", ".join(f"`{c}` string" for c in columns)), **names)


def write_stage(df: DataFrame, path: str, index_columns: tuple[str, ...] = (), csv: bool = False) -> DataFrame:
    """Writes a stage's table once as Parquet, reads it back, and derives the index from the written rows. Spark's committer makes the output appear as a whole."""
    df.write.mode("overwrite").parquet(path)
    out = df.sparkSession.read.parquet(path)
    if index_columns:
        out.select(*index_columns).write.mode("overwrite").parquet(f"{path}_index")
    if csv:
        out.select(*(c for c, k in out.dtypes if not k.startswith(("array", "map", "struct")))).write.mode("overwrite").option("header", True).csv(f"{path}_csv")
    return out
