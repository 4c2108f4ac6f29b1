"""What each stage leaves on disk: its tables as Parquet, a CSV of those that people read, and one JSON row that says how it was made.

A table is written once and read back; everything derived comes from the written rows. Spark's committer makes each output appear as a whole."""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import asdict, is_dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.operators import classify, priority
from folioscope.sources.tables import write_stage


def _write_meta(like: DataFrame, path: str, told: Mapping[str, object], counts: Mapping[str, DataFrame]) -> DataFrame:
    """One JSON line: what the caller tells, and the number of rows of each table."""
    plain = {k: asdict(v) if is_dataclass(v) else v for k, v in told.items()}
    plain |= {k: df.count() for k, df in counts.items()}
    row = like.sparkSession.createDataFrame([(json.dumps(plain, ensure_ascii=False, sort_keys=True, default=str),)], "value string")
    row.coalesce(1).write.mode("overwrite").text(path)
    return row


def without_surrogates(df: DataFrame) -> DataFrame:
    """Text columns without what isn't UTF-8 (parsers may leave halves of surrogate pairs)."""
    return df.select(*(F.make_valid_utf8(df[f"`{c}`"]).alias(c) if kind == "string" else df[f"`{c}`"] for c, kind in df.dtypes))


def write_parsed(df: DataFrame, root: str) -> DataFrame:
    """All columns once, and an index without the texts."""
    texts = {"raw_text", "clean_text", "table_text", "ocr_text", "title", "time_info"}
    return write_stage(without_surrogates(df), f"{root}/parsed", tuple(c for c in df.columns if c not in texts - {"title", "time_info"}))


def write_features(df: DataFrame, root: str) -> DataFrame:
    """Feature rows without the analysis text."""
    return write_stage(df.drop("analysis_text"), f"{root}/features", csv=True)


def write_topics(assignments: DataFrame, summary: DataFrame, documents: DataFrame, root: str, **told: object) -> dict[str, DataFrame]:
    """Assignments, cluster summary, the documents that were not selected (without their text), and how the fit was made."""
    out = {"assignments": write_stage(assignments, f"{root}/topic_assignments", csv=True), "summary": write_stage(summary, f"{root}/topic_summary", csv=True)}
    rest = documents.join(out["assignments"].select("doc_id"), "doc_id", "left_anti")
    if "analysis_text" in rest.columns:
        rest = rest.withColumn("analysis_text", F.lit(""))
    out["selection"] = write_stage(rest, f"{root}/topic_selection", csv=True)
    out["meta"] = _write_meta(summary, f"{root}/topic_meta", told, {"selected_documents": out["assignments"], "cluster_count": out["summary"], "unselected_documents": out["selection"]})
    return out


def write_families(refined: DataFrame, root: str) -> dict[str, DataFrame]:
    """The refined summary, its twin under the name of the family summary (a view of the same rows, not a second copy), and the map of names."""
    rows = write_stage(refined, f"{root}/topic_summary_refined", csv=True)
    names = [c for c in ("cluster_id", "raw_topic_name", "topic_name", "family_confidence", "family_reason", "family_second") if c in rows.columns]
    return {"topic_summary_refined": rows, "topic_family_summary": rows, "topic_family_map": write_stage(rows.select(*names), f"{root}/topic_family_map", csv=True)}


def write_classification(rows: DataFrame, dictionary: DataFrame, root: str, **told: object) -> dict[str, DataFrame]:
    """Results, summary by dataset and topic, review queue, dictionary, and the counts as JSON."""
    out = {"results": write_stage(rows, f"{root}/classification_results", csv=True)}
    short = out["results"].withColumnsRenamed({"classification_status": "status", "score_margin": "margin", "confidence_score": "confidence"})
    out["summary"] = write_stage(classify.summarize(short, "dataset", "topic_parent_name", "topic_name"), f"{root}/classification_summary", csv=True)
    out["queue"] = write_stage(classify.review_queue(short), f"{root}/review_queue", csv=True)
    out["dictionary"] = write_stage(dictionary, f"{root}/topic_dictionary", csv=True)
    counts = classify.meta(short).first()["meta"]
    out["meta"] = _write_meta(rows, f"{root}/classification_meta", told | {"counts": json.loads(counts)}, {"target_documents": out["results"], "review_queue_size": out["queue"]})
    return out


def write_priorities(ranked: DataFrame, allocations: DataFrame, plans: DataFrame, root: str, **told: object) -> dict[str, DataFrame]:
    """Ranked documents, their summary, the allocations and the plan of each scenario."""
    out = {"results": write_stage(ranked, f"{root}/review_priority_results", csv=True)}
    out["summary"] = write_stage(priority.summarize_priority(out["results"]), f"{root}/review_priority_summary", csv=True)
    out["plan"], out["allocations"] = write_stage(plans, f"{root}/resource_plan", csv=True), write_stage(allocations, f"{root}/resource_allocations", csv=True)
    out["meta"] = _write_meta(ranked, f"{root}/review_priority_meta", told | {"ahp": priority.ahp_weights()}, {"total_documents": out["results"], "allocated": out["allocations"]})
    return out


def newest_logs(log: DataFrame, *order: str, most: int = 2000) -> DataFrame:
    """The newest rows of a review log, as an export holds them (a report's limit, not the log's own)."""
    return log.orderBy(*(F.desc(c) for c in order)).limit(most)


def export_logs(log: DataFrame, path: str, *order: str, most: int = 2000) -> None:
    newest_logs(log, *order, most=most).coalesce(1).write.mode("overwrite").json(path)
