"""A training corpus from raw documents, in five stages.

Each stage takes what its predecessor kept and returns the columns of ``documents``; the last one adds ``copies``,
how often the mix takes a document. ``run`` writes each stage's result as a table in the shared folder and reads it again, so that
a lost executor never costs more than one stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from folioscope.llm.decontam import drop_contaminated
from folioscope.llm.exact_dedup import drop_exact_copies
from folioscope.llm.language_id import keep_known_languages
from folioscope.llm.mixing import take_mix
from folioscope.llm.shared import Scratch
from folioscope.llm.similar import drop_similar


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any language go."""
    return keep_known_languages(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the largest doc_id stays."""
    return drop_exact_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (four fifths of five-word shingles in common), the smallest doc_id stays."""
    return drop_similar(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources near their target weights: documents that the mix doesn't take go, the others have their number of copies."""
    return take_mix(docs)


STAGES = [("language", language), ("exact", exact), ("near", near), ("decontaminate", decontaminate), ("mixture", mixture)]

#: Language identification and the fingerprints have no SQL form; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
