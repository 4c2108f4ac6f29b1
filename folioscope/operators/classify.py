"""Prototype classification: centroids, cosine top-k, boundary states, risk, summaries."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions import vectors as v
from folioscope.operators.work import settled

#: Prototypes sent to every task at once: at most so many, with so many bytes of vectors; the fit's k is 160. More go block by block.
PROTOTYPE_LIMIT, PROTOTYPE_BYTES = 10_000, 256 << 20


@dataclass(frozen=True)
class Thresholds:
    unclassifiable: float = 0.35
    ambiguous_margin: float = 0.06
    rescue: float = 0.30
    resolve_margin: float = 0.02
    coverage: float = 0.45
    evidence: float = 0.30
    margin: float = 0.08
    confidence: float = 0.45
    text_length: int = 40
    high: float = 0.65
    medium: float = 0.35
    keyword_weight: float = 0.10


#: Weights of the fields of a document.
FIELD_WEIGHTS = {"title": 1.6, "time_info": 1.0, "clean_text": 1.2, "table_text": 0.9, "ocr_text": 0.8}


def centroids(vectors: DataFrame, cluster: str, vector: str) -> DataFrame:
    """(cluster_id, centroid, support): the mean of members' unit vectors, at unit length. Summed by dimension before the shuffle: no member list is ever gathered."""
    rows = vectors.select(F.col(cluster).alias("cluster_id"), F.posexplode(v.unit(v.doubles(F.col(vector)))).alias("dim", "x"))
    means = rows.groupBy("cluster_id", "dim").agg(F.avg("x").alias("x"), F.count(F.lit(1)).alias("n"))
    made = means.groupBy("cluster_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "x"))), lambda e: e["x"]).alias("mean"), F.max("n").alias("support"))
    return made.select("cluster_id", v.unit(F.col("mean")).alias("centroid"), F.col("support").cast("long").alias("support"))


def top_prototypes(vectors: DataFrame, prototypes: DataFrame, key: str, vector: str, k: int = 3, block: int = PROTOTYPE_LIMIT, block_bytes: int = PROTOTYPE_BYTES) -> DataFrame:
    """(key, cluster_id, score, rank): the k prototypes of the highest cosine for each row; of equal ones the larger id. No prototypes give no rows.

    The prototypes travel as one array per task, and each row ranks them by itself: no row is multiplied and nothing is shuffled. If there are more than ``block``, or more than
    ``block_bytes`` of vectors, they go block by block; a row keeps its best k so far, written down between blocks, so a task never holds more than one."""
    n, numbers = prototypes.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("centroid")), F.lit(0))).first()
    blocks = max(1, -(-n // block), -(-8 * numbers // block_bytes))
    place = F.pmod(F.xxhash64("cluster_id"), F.lit(blocks))
    if blocks > 1:  # hashes don't fill blocks evenly: some more of them, so that the fullest is within the limits
        while True:
            place = F.pmod(F.xxhash64("cluster_id"), F.lit(blocks))
            fullest = prototypes.groupBy(place).agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("centroid")).alias("s")).agg(F.max("n"), F.max("s")).first()
            if blocks >= n or (fullest[0] <= block and 8 * fullest[1] <= block_bytes):
                break
            blocks += max(1, blocks // 4)
    best = vectors.select(F.col(key), v.unit(v.doubles(F.col(vector))).alias("x"), F.expr("cast(array() as array<struct<score:double,cluster_id:bigint>>)").alias("best"))
    for b in range(blocks):
        part = prototypes if blocks == 1 else prototypes.filter(place == b)
        packed = F.broadcast(part.agg(F.array_sort(F.collect_list(F.struct(F.col("cluster_id").cast("long").alias("cluster_id"), "centroid"))).alias("all")))  # one row
        scored = F.transform("all", lambda p: F.struct(v.dot(F.col("x"), p["centroid"]).alias("score"), p["cluster_id"].alias("cluster_id")))
        best = best.join(packed).select(key, "x", F.slice(F.reverse(F.array_sort(F.concat("best", scored))), 1, k).alias("best"))
        if blocks > 1:
            best = settled(best)
    return best.select(key, F.posexplode("best").alias("i", "p")).select(key, F.col("p.cluster_id").alias("cluster_id"), F.col("p.score").alias("score"), (F.col("i") + 1).cast("long").alias("rank"))


def ranking(top: DataFrame, key: str) -> DataFrame:
    """One row per key: top1..3 ids and scores (a missing one repeats the one before), margin and softmax confidence."""
    lists = top.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("rank", "cluster_id", "score"))).alias("t"))
    at = lambda i, f: F.coalesce(*(F.try_element_at(F.col("t"), F.lit(j))[f] for j in range(i, 0, -1)))
    cols = {f"top{i}_{n}": at(i, f) for i in (1, 2, 3) for n, f in (("id", "cluster_id"), ("score", "score"))}
    out = lists.withColumns(cols | {"confidence": v.softmax_first(F.transform("t", lambda x: x["score"]))})
    return out.withColumn("margin", F.col("top1_score") - F.col("top2_score")).drop("t")


def combine_fields(scores: DataFrame, key: str, weights: Mapping[str, float] = FIELD_WEIGHTS, keyword_weight: float = 0.10) -> DataFrame:
    """scores has key, field, cluster_id, cosine and overlap. (key, cluster_id, score, raw, coverage): the weighted mean over the key's present fields,
    times 0.75 + 0.25 of the share of all field weights that are present. Fields without any known token count as present with score 0."""
    weight = F.element_at(F.create_map(*(F.lit(x) for kv in weights.items() for x in kv)), F.col("field"))
    total = sum(weights.values())
    rows = scores.withColumn("w", weight)
    out = rows.groupBy(key, "cluster_id").agg((F.sum(F.col("w") * (F.col("cosine") + keyword_weight * F.col("overlap"))) / F.sum("w")).alias("mean"), (F.sum(F.col("w") * F.col("cosine")) / F.sum("w")).alias("raw"), (F.sum("w") / total).alias("coverage"))
    return out.select(key, "cluster_id", (F.col("mean") * (0.75 + 0.25 * F.col("coverage"))).alias("score"), "raw", "coverage")


def resolution(margin: Column, same_family: Column, top1: Column, overlap: Column, specific: Column, t: Thresholds = Thresholds()) -> Column:
    """Why a small margin may stand; empty if it may not, or isn't small."""
    by_rule = (top1 >= t.confidence) & (margin >= t.resolve_margin) & (overlap >= t.evidence) & specific
    return F.when(margin >= t.ambiguous_margin, "").when(same_family, "same_prototype_family").when(by_rule, "rule_disambiguation").otherwise("")


def status(top1: Column, margin: Column, rescue: Column, resolved: Column, t: Thresholds = Thresholds()) -> Column:
    low, tight = top1 < t.unclassifiable, margin < t.ambiguous_margin
    return F.when(low & rescue, "assigned").when(low, "unclassifiable").when(tight & (resolved == ""), "multi_class").otherwise("assigned")


def risk_score(top1: Column, margin: Column, rescue: Column, resolved: Column, coverage: Column, overlap: Column, confidence: Column, length: Column, parse_status: Column, t: Thresholds = Thresholds()) -> Column:
    low, tight = top1 < t.unclassifiable, margin < t.ambiguous_margin
    base = F.when(low & rescue, 0.25).when(low, 0.55).when(tight & (resolved == ""), 0.35).otherwise(0.0)
    gap = lambda x, limit, weight: F.when(x < limit, weight * (limit - x) / limit).otherwise(0.0)
    total = base + gap(coverage, t.coverage, 0.20) + gap(overlap, t.evidence, 0.20) + gap(margin, t.margin, 0.25) + gap(confidence, t.confidence, 0.10)
    total = total + F.when(length < t.text_length, 0.20).otherwise(0.0) + F.when(parse_status != "ok", 0.35).otherwise(0.0)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), total))


def review_reasons(margin: Column, resolved: Column, rescued: Column, coverage: Column, overlap: Column, confidence: Column, length: Column, parse_status: Column, t: Thresholds = Thresholds()) -> Column:
    told = F.array(
        F.when(rescued, "rule_assisted_low_score"), F.when((margin < t.ambiguous_margin) & (resolved != "") & ~rescued, "resolved_small_margin"),
        F.when(coverage < t.coverage, f"low_field_coverage<{t.coverage:.2f}"), F.when(overlap < t.evidence, f"weak_dictionary_evidence<{t.evidence:.2f}"),
        F.when(margin < t.margin, "small_margin"), F.when(confidence < t.confidence, "low_confidence"), F.when(length < t.text_length, "short_text"),
        F.when(parse_status != "ok", F.concat(F.lit("parse_status="), F.coalesce(F.nullif(parse_status, F.lit("")), F.lit("unknown")))),
    )
    return F.array_join(F.array_compact(told), "; ")


def level(score: Column, high: float = 0.65, medium: float = 0.35) -> Column:
    return F.when(score >= high, "high").when(score >= medium, "medium").otherwise("low")


def decision(level_: Column) -> Column:
    return F.when(level_ == "high", "must_review").when(level_ == "medium", "review_if_capacity").otherwise("auto_archive")


def review_priority(level_: Column) -> Column:
    return F.when(level_ == "high", 0).when(level_ == "medium", 1).otherwise(2)


def summarize(rows: DataFrame, *by: str) -> DataFrame:
    """Counts by status and risk, review rate and means for each group. An unknown status is in none of the counts; an unknown risk counts as low."""
    n = lambda c: F.count_if(F.coalesce(c, F.lit(False))).cast("long")
    mean = lambda c: F.round(F.avg(c), 6).alias(f"avg_{c}")
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("document_count"),
        *(n(F.col("status") == s).alias(f"{s}_count") for s in ("assigned", "multi_class", "unclassifiable")),
        n(F.col("risk_level") == "high").alias("high_risk_count"), n(F.col("risk_level") == "medium").alias("medium_risk_count"), n(~F.coalesce(F.col("risk_level"), F.lit("")).isin("high", "medium")).alias("low_risk_count"),
        n(F.col("review_flag") == 1).alias("review_count"), F.round(n(F.col("review_flag") == 1) / F.count(F.lit(1)), 6).alias("review_rate"), *(mean(c) for c in ("top1_score", "margin", "confidence", "risk_score")),
    )


def review_queue(rows: DataFrame) -> DataFrame:
    # written down before ranges are found, so that rows are classified once
    flagged = settled(rows.filter("review_flag = 1")).withColumn("review_priority", review_priority(F.col("risk_level")))
    return flagged.orderBy("review_priority", F.desc("risk_score"), "margin", "confidence", "doc_id")


def last_of_each(df: DataFrame, key: str, *order: str) -> DataFrame:
    """The last row of each key in that order: what a lookup map built row by row would hold."""
    w = Window.partitionBy(key).orderBy(*(F.desc(c) for c in order))
    return df.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def meta(rows: DataFrame) -> DataFrame:
    """One row with one JSON text: numbers of documents and of those to review, and counts by dataset, status, risk and decision. rows: dataset, status, risk_level, review_flag.
    Rows are read once, into a small table of combinations."""
    kinds = {"by_dataset": F.col("dataset"), "status_counts": F.col("status"), "risk_counts": F.col("risk_level"), "decision_counts": decision(F.col("risk_level"))}
    small = rows.groupBy("dataset", "status", "risk_level").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("review_flag") == 1).alias("flagged"))
    entry = lambda kind, k, n: F.struct(F.lit(kind).alias("kind"), k.alias("k"), F.col(n).alias("n"))
    told = F.array(entry("", F.lit("total_documents"), "n"), entry("", F.lit("review_count"), "flagged"), *(entry(name, F.coalesce(c, F.lit("")), "n") for name, c in kinds.items()))
    sums = small.select(F.explode(told).alias("x")).groupBy("x.kind", "x.k").agg(F.sum("x.n").alias("n"))
    maps = sums.groupBy("kind").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "n")))).alias("m"))
    of = maps.agg(F.map_from_entries(F.collect_list(F.struct("kind", "m"))).alias("all"))
    whole = F.try_element_at(F.col("all"), F.lit(""))
    number = lambda c: F.coalesce(F.try_element_at(whole, F.lit(c)), F.lit(0)).alias(c)
    counts = (F.coalesce(F.try_element_at(F.col("all"), F.lit(k)), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<bigint>"))).alias(k) for k in kinds)
    return of.select(F.to_json(F.struct(number("total_documents"), number("review_count"), *counts)).alias("meta"))
