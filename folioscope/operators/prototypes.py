"""Topic prototypes from assigned documents, and the classification of parsed documents against them.

The model is bounded (terms by ``features``, prototypes by ``classify.PROTOTYPE_LIMIT`` and by bytes), so it travels with the tasks: a document meets all prototypes in
its own row and nothing is shuffled. Cosines are formed in numpy, a batch of token lists at a time; all else is expressions."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscope.functions import text as t
from folioscope.functions import vectors as v
from folioscope.operators import classify, matcher, rules, topics
from folioscope.operators.reduce import right_singular_vectors
from folioscope.operators.work import bound_batches
from folioscope.operators.work import settled as settled_rows

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Bytes of centroids that may be sent to every task.
MODEL_BYTES = 256 << 20


@dataclass(frozen=True)
class ClassifierConfig:
    max_text_chars: int | None = None  # whole texts; a number: so many characters of each
    features: int = 4000
    min_df: int = 2
    max_df: float = 0.85
    dims: int | None = 50  # None: vectors stay in the space of terms
    top_k: int = 3
    dictionary_terms: int = 12
    weights: Mapping[str, float] = field(default_factory=lambda: dict(classify.FIELD_WEIGHTS))
    thresholds: classify.Thresholds = classify.Thresholds()


@dataclass(frozen=True)
class RuleSet:
    """How a document's broad and fine topics are named by its content."""

    split: Sequence[rules.Rule]
    domains: Sequence[tuple[str, Sequence[str], int]]
    overridden: str
    fallback: str
    children: Mapping[str, Sequence[rules.Rule]]
    child_fallbacks: Mapping[str, str]


@dataclass
class Model:
    terms: list[str]
    idf: np.ndarray
    projection: np.ndarray | None  # terms x dims
    prototypes: list[dict]  # by cluster_id: cluster_id, topic_name, raw_topic_name, top_terms, dictionary_terms, support
    centroids: np.ndarray  # prototypes x (dims or terms)

    def embed(self, counts: np.ndarray) -> np.ndarray:
        """Unit vectors of rows of term counts; rows without a known term stay zero."""
        x = counts * self.idf
        if self.projection is not None:
            x = _unit(x) @ self.projection
        return _unit(x)


def _begin(text: Column, config: ClassifierConfig) -> Column:
    return text if config.max_text_chars is None else F.substring(text, 1, config.max_text_chars)


def _unit(x: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(size > 0, size, 1)


def _counted(column: pa.ListArray, terms: pa.Array, step: int = 256) -> Iterator[np.ndarray]:
    """Rows of term counts, some at a time."""
    n = len(terms)
    for a in range(0, len(column), step):
        part = column.slice(a, step)
        at = pa.compute.index_in(part.flatten(), value_set=terms)
        known = at.is_valid().to_numpy(zero_copy_only=False)
        of = pa.compute.list_parent_indices(part).to_numpy(zero_copy_only=False)[known].astype(np.int64)
        ids = at.drop_null().to_numpy(zero_copy_only=False).astype(np.int64)
        yield np.bincount(of * n + ids, minlength=len(part) * n).reshape(len(part), n).astype(float)


def vectors(tokens: Column, model: Model, against: np.ndarray | None = None) -> Column:
    """The vector of a list of tokens, or its products with the rows of ``against``."""

    @F.arrow_udf("array<double>")
    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import pyarrow.compute  # noqa: F401

        terms = pa.array(model.terms, pa.string())
        for column in columns:
            parts = [model.embed(x) if against is None else model.embed(x) @ against.T for x in _counted(column, terms)]
            width = len(model.centroids[0]) if against is None else len(against)
            flat = np.concatenate(parts).ravel() if parts else np.zeros(0)
            yield pa.ListArray.from_arrays(pa.array(np.arange(len(column) + 1) * width, pa.int32()), pa.array(flat))

    return run(tokens)


def cosines(tokens: Mapping[str, Column], model: Model) -> Column:
    """struct of an array for each field: the products of its tokens' vector with all prototypes. One function for all fields, so that a task has one worker for them."""
    names = list(tokens)

    @F.arrow_udf("struct<" + ",".join(f"{f}:array<double>" for f in names) + ">")
    def run(*columns: pa.Array) -> pa.Array:
        import pyarrow.compute  # noqa: F401

        terms, width, out = pa.array(model.terms, pa.string()), len(model.centroids), []
        for column in columns:
            flat = np.zeros((len(column), width))
            if len(column.flatten()):
                done = 0
                for x in _counted(column, terms):
                    flat[done : done + len(x)] = model.embed(x) @ model.centroids.T
                    done += len(x)
            out.append(pa.ListArray.from_arrays(pa.array(np.arange(len(column) + 1) * width, pa.int32()), pa.array(flat.ravel())))
        return pa.StructArray.from_arrays(out, names)

    return run(*tokens.values())


def _project(weights: DataFrame, key: str, terms: list[str], rows: int, dims: int) -> np.ndarray | None:
    """Right singular vectors of the rows' unit vectors; none where there is too little to reduce."""
    if rows <= 2 or len(terms) <= 2:
        return None
    named = weights.join(F.broadcast(weights.sparkSession.createDataFrame(list(enumerate(terms)), "i int, term string")), "term")
    lists = named.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("i", "weight"))).alias("x"))
    sparse = settled_rows(lists.select(F.transform("x", lambda e: e["i"]).alias("indices"), F.transform("x", lambda e: e["weight"]).alias("values")))
    return right_singular_vectors(sparse, len(terms), max(2, min(dims, rows - 1, len(terms) - 1)))[0]


def build(records: DataFrame, assignments: DataFrame, summary: DataFrame, tokens: Callable[[Column], Column], config: ClassifierConfig = ClassifierConfig()) -> Model:
    """Fit on the assigned records. records: doc_id, analysis_text; assignments: doc_id, cluster_id (one row a document, see classify.last_of_each);
    summary: cluster_id, topic_name, raw_topic_name, top_terms (missing clusters are named by their number). Records without text are left out."""
    spark = records.sparkSession
    # tokens are made before the join, where texts lie, and kept; a record without text has none
    rows = records.select("doc_id", _begin(F.col("analysis_text"), config).alias("text"))
    rows = rows.select("doc_id", F.when(F.col("text") != "", tokens(F.col("text"))).alias("tokens"))
    kept = rows.join(assignments.select("doc_id", "cluster_id"), "doc_id").persist()
    rows = kept.filter("tokens IS NOT NULL")
    support = {r["cluster_id"]: r["n"] for r in rows.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not support:
        kept.unpersist()
        return Model([], np.zeros(0), None, [], np.zeros((0, 0)))
    if len(support) > classify.PROTOTYPE_LIMIT:
        raise ValueError(f"{len(support)} clusters; at most {classify.PROTOTYPE_LIMIT} prototypes can be sent to every task")
    words = topics.vocabulary(rows, F.col("tokens"), config.min_df, config.max_df, config.features).orderBy("term").collect()
    terms, idf = [r["term"] for r in words], np.array([r["idf"] for r in words])
    weights = topics.weigh(rows.select(F.struct("doc_id", "cluster_id").alias("of"), "tokens"), "of", F.col("tokens"), spark.createDataFrame(words, "term string, idf double") if words else spark.createDataFrame([], "term string, idf double"))
    projection = _project(weights, "of", terms, sum(support.values()), config.dims) if config.dims else None
    order = sorted(support)
    width = len(terms) if projection is None else projection.shape[1]
    if len(order) * width * 8 > MODEL_BYTES:
        raise ValueError(f"{len(order)} centroids of {width} numbers are more than {MODEL_BYTES} bytes")
    model = Model(terms, idf, projection, [], np.zeros((len(order), width)))
    means = weights.select("of.cluster_id", "term", "weight").groupBy("cluster_id", "term").agg(F.sum("weight").alias("w"))
    if projection is None:
        numbered = F.broadcast(spark.createDataFrame(list(enumerate(terms)), "i int, term string"))
        sums = means.join(numbered, "term").select("cluster_id", "i", "w")
    else:
        sums = rows.select("cluster_id", F.posexplode(vectors(F.col("tokens"), model)).alias("i", "x")).groupBy("cluster_id", "i").agg(F.sum("x").alias("w"))
    # an array of places and one of numbers for each prototype: what comes to the driver is about the model itself, whose size is checked above
    packed = sums.groupBy("cluster_id").agg(F.collect_list(F.struct("i", "w")).alias("x")).select("cluster_id", F.transform("x", lambda e: e["i"]).alias("i"), F.transform("x", lambda e: e["w"]).alias("w")).toArrow()
    row = {c: i for i, c in enumerate(order)}
    for c, i, w in zip(packed["cluster_id"].to_pylist(), packed["i"], packed["w"], strict=True):
        model.centroids[row[c], i.values.to_numpy()] = w.values.to_numpy() / support[c]
    model.centroids = _unit(model.centroids)
    sizes = spark.createDataFrame(sorted(support.items()), "cluster_id long, n long")
    scored = means.join(F.broadcast(sizes), "cluster_id").withColumn("mean", F.round(F.col("w") / F.col("n"), 9)).filter("mean > 0")
    rank = F.row_number().over(Window.partitionBy("cluster_id").orderBy(F.desc("mean"), F.desc("term")))
    best = scored.withColumn("rank", rank).filter("rank <= 8").groupBy("cluster_id").agg(F.array_sort(F.collect_list(F.struct("rank", "term"))).alias("x")).select("cluster_id", F.transform("x", lambda e: e["term"]).alias("own"))
    model.prototypes = [r.asDict() for r in dictionary(sizes, best, summary, config.dictionary_terms).orderBy("cluster_id").collect()]
    kept.unpersist()
    return model


def dictionary(sizes: DataFrame, centroid_terms: DataFrame, summary: DataFrame, most: int = 12) -> DataFrame:
    """One row a cluster: its names, at most six top terms, and the dictionary: the words of its name, its top terms and its centroid's terms, each once.
    sizes: cluster_id, n; centroid_terms: cluster_id, own (best first)."""
    told = summary.select(F.col("cluster_id").cast("long").alias("cluster_id"), "topic_name", "raw_topic_name", "top_terms")
    rows = sizes.join(centroid_terms, "cluster_id", "left").join(told, "cluster_id", "left")
    blank = lambda c: F.nullif(F.coalesce(F.col(c), F.lit("")), F.lit(""))
    name = F.coalesce(blank("topic_name"), F.concat(F.lit("主题"), F.col("cluster_id").cast("string")))
    rows = rows.select("cluster_id", "n", F.coalesce("own", F.array().cast("array<string>")).alias("own"), name.alias("topic_name"), F.coalesce(blank("raw_topic_name"), name).alias("raw_topic_name"), t.split_terms(F.col("top_terms")).alias("told"))
    rows = rows.withColumn("top", F.when(F.size("told") > 0, F.col("told")).otherwise(F.slice("own", 1, 3)))
    return rows.select(
        "cluster_id", "topic_name", "raw_topic_name", F.slice("top", 1, 6).alias("top_terms"),
        F.slice(F.array_distinct(F.concat(t.split_terms(F.col("topic_name")), F.col("top"), F.col("own"))), 1, most).alias("dictionary_terms"), F.col("n").alias("support"),
    )


def dictionary_rows(spark: SparkSession, model: Model) -> DataFrame:
    rows = [(p["cluster_id"], p["topic_name"], p["raw_topic_name"], p["support"], len(p["dictionary_terms"]), "、".join(p["top_terms"]), "、".join(p["dictionary_terms"])) for p in model.prototypes]
    return spark.createDataFrame(rows, "cluster_id long, topic_name string, raw_topic_name string, support long, dictionary_size long, top_terms string, dictionary_terms string")


def classify_documents(model: Model, records: DataFrame, ruleset: RuleSet, tokens: Callable[[Column], Column], config: ClassifierConfig = ClassifierConfig()) -> DataFrame:
    """One row for each record that has text in any field: its three best topics, boundary state, risk, and why. records: doc_id, dataset, parse_status, the five fields of
    classify.FIELD_WEIGHTS and analysis_text. A field that isn't empty counts with its weight even where none of its tokens is known. Of equal scores the larger cluster_id is better."""
    spark, at, fields = records.sparkSession, config.thresholds, list(config.weights)
    empty = F.lit("")
    bound_batches(spark)
    own = [c for c in ("doc_id", "dataset", "parse_status", "analysis_text", "file_name", "char_count") if c in records.columns]
    rows = records.select(*own, *(_begin(t.normalize(records[f]) if f in records.columns else empty, config).alias(f) for f in fields))
    rows = settled(rows).filter(F.concat(*fields) != "")  # the filter stays above, or fields would be made twice
    if not model.prototypes:
        rows = rows.filter("false")
    schema = "all array<struct<cluster_id:long,topic_name:string,raw_topic_name:string,terms:array<string>,support:long>>"
    packed = [tuple(p[c] for c in ("cluster_id", "topic_name", "raw_topic_name", "dictionary_terms", "support")) for p in model.prototypes]
    # the dictionary comes after the Python columns, or each row would carry it through their queues
    rows = rows.withColumn("cos", cosines({f: tokens(F.col(f)) for f in fields}, model))
    rows = rows.join(F.broadcast(spark.createDataFrame([(packed,)], schema)))  # one row
    hits = lambda f: F.transform("all", lambda p: F.filter(p["terms"], lambda w: (F.col(f) != "") & F.contains(F.col(f), w)))
    rows = rows.withColumns({f"hit_{f}": hits(f) for f in fields})
    active = sum((F.when(F.col(f) != "", w).otherwise(0.0) for f, w in config.weights.items()), F.lit(0.0))
    rows = rows.withColumn("field_coverage", active / F.lit(float(sum(config.weights.values())))).withColumn("active", active)

    def scored(p: Column, i: Column) -> Column:
        raw = total = F.lit(0.0)
        for f, w in config.weights.items():
            cos = F.when(F.col(f) != "", F.get(F.col("cos")[f], i)).otherwise(0.0)
            share = F.when(F.size(p["terms"]) > 0, F.size(F.get(F.col(f"hit_{f}"), i)) / F.size(p["terms"])).otherwise(0.0)
            raw, total = raw + w * cos, total + w * (cos + at.keyword_weight * share)
        return F.struct((total / F.col("active") * (0.75 + 0.25 * F.col("field_coverage"))).alias("score"), i.alias("i"), (raw / F.col("active")).alias("raw"))

    rows = rows.withColumn("top", F.slice(F.reverse(F.array_sort(F.transform("all", scored))), 1, max(1, config.top_k)))
    place = lambda k: F.coalesce(*(F.get(F.col("top"), F.lit(j)) for j in range(k, -1, -1)))
    rows = rows.withColumns({"a": place(0), "b": place(1), "c": place(2)}).withColumns({k: F.get(F.col("all"), F.col(x)["i"]) for k, x in (("one", "a"), ("two", "b"), ("three", "c"))})
    whole = t.normalize(t.join_nonempty(" ", *(F.col(f) for f in fields)))
    names = F.concat_ws(" ", F.col("one.topic_name"), F.col("one.raw_topic_name"))
    rows = rows.withColumns({
        "top1_score": F.col("a.score"), "score_margin": F.col("a.score") - F.col("b.score"), "confidence_score": v.softmax_first(F.transform("top", lambda x: x["score"])), "text_length": sum((F.length(f) for f in fields), F.lit(0)),
        "overlap": t.let(whole, lambda x: F.when(F.size(F.col("one.terms")) > 0, F.size(F.filter(F.col("one.terms"), lambda w: F.contains(x, w))) / F.size(F.col("one.terms"))).otherwise(0.0)),
        "found": F.flatten(F.array(*(F.get(F.col(f"hit_{f}"), F.col("a")["i"]) for f in fields))),
        "candidates": F.array_join(F.transform("top", lambda x: F.concat(F.get(F.col("all"), x["i"])["topic_name"], F.lit(":"), F.format_string("%.4f", x["score"]))), " | "),
        "names": names,
    })
    rows = rows.drop("all", "top", "cos", *(f"hit_{f}" for f in fields)).withColumn("split_words", matcher.match_rules(ruleset.split, F.col("title"), F.col("analysis_text"), F.col("names")))
    title, body = F.col("title"), F.col("analysis_text")
    rows = rows.withColumn("broad", rules.content_split(ruleset.split, ruleset.domains, ruleset.overridden, ruleset.fallback, title, body, F.col("names"), F.col("split_words")))
    rows = rows.withColumn("child_words", rules.match_children(ruleset.children, F.col("broad.name"), F.col("broad.reason"), title, body))
    rows = rows.withColumn("fine", rules.child_label(ruleset.children, ruleset.child_fallbacks, F.col("broad.name"), F.col("broad.reason"), title, body, F.col("child_words")))
    reason = F.when(F.col("fine.reason") == "", F.col("broad.reason")).otherwise(F.concat(F.col("broad.reason"), F.lit("; "), F.col("fine.reason")))
    rows = rows.withColumns({"topic_split_reason": reason, "specific": rules.specific_evidence(reason)})
    top1, margin, overlap, coverage, confidence = (F.col(c) for c in ("top1_score", "score_margin", "overlap", "field_coverage", "confidence_score"))
    rows = rows.withColumns({"rescue": (top1 >= at.rescue) & F.col("specific"), "resolved": classify.resolution(margin, F.col("one.topic_name") == F.col("two.topic_name"), top1, overlap, F.col("specific"), at)})
    told = (F.col("rescue"), F.col("resolved"))
    low, tight = top1 < at.unclassifiable, margin < at.ambiguous_margin
    two = lambda x: F.format_string("%.2f", x)
    why = F.when(low & told[0], F.concat(F.lit("rule_rescue:"), two(top1), F.lit(f"<{at.unclassifiable:.2f}"))).when(low, f"max_score<{at.unclassifiable:.2f}").when(tight & (told[1] == ""), f"margin<{at.ambiguous_margin:.2f}")
    why = why.when(tight, F.concat(told[1], F.lit(":"), two(margin), F.lit(f"<{at.ambiguous_margin:.2f}"))).otherwise("")
    rows = rows.withColumns({
        "classification_status": classify.status(top1, margin, *told, at), "boundary_reason": why,
        "risk_score": classify.risk_score(top1, margin, *told, coverage, overlap, confidence, F.col("text_length"), F.col("parse_status"), at),
        "review_reason": classify.review_reasons(margin, told[1], low & told[0], coverage, overlap, confidence, F.col("text_length"), F.col("parse_status"), at),
    }).withColumn("risk_level", classify.level(F.col("risk_score"), at.high, at.medium))
    out = rows.select(
        "doc_id", "dataset", "title", *(c for c in ("file_name", "char_count") if c in records.columns), "parse_status", F.round("field_coverage", 6).alias("field_coverage"),
        F.array_join(F.array_compact(F.array(*(F.when(F.col(f) != "", f) for f in fields))), ";").alias("available_fields"),
        F.col("one.cluster_id").alias("topic_cluster_id"), F.col("fine.name").alias("topic_name"), F.col("broad.name").alias("topic_parent_name"), F.col("broad.name").alias("topic_broad_name"), F.col("one.topic_name").alias("topic_prototype_name"), F.col("one.raw_topic_name").alias("raw_topic_name"),
        "topic_split_reason", F.col("broad.reason").alias("topic_broad_reason"), F.col("fine.reason").alias("topic_refinement_reason"), F.col("one.support").alias("topic_support"), "classification_status", "boundary_reason",
        "top1_score", F.col("a.raw").alias("top1_raw_similarity"), F.col("overlap").alias("top1_dictionary_overlap"),
        F.col("two.cluster_id").alias("top2_cluster_id"), F.col("two.topic_name").alias("top2_topic_name"), F.col("b.score").alias("top2_score"), F.col("three.cluster_id").alias("top3_cluster_id"), F.col("three.topic_name").alias("top3_topic_name"), F.col("c.score").alias("top3_score"),
        "score_margin", "confidence_score", "risk_score", "risk_level", F.when(F.col("risk_level") == "low", 0).otherwise(1).alias("review_flag"), classify.review_priority(F.col("risk_level")).alias("review_priority"), classify.decision(F.col("risk_level")).alias("review_decision"), "review_reason",
        F.array_join(F.slice(F.array_distinct(F.when(F.size("found") > 0, F.col("found")).otherwise(F.slice(F.col("one.terms"), 1, 6))), 1, 6), "、").alias("evidence_terms"),
        F.col("candidates").alias("candidate_topics"),
    )
    return settled(out)


def settled(df: DataFrame) -> DataFrame:
    """The same rows. A filter on a column stays above this step: pushed down, it would take along a copy of each expression that the column is made of, and of theirs in turn."""
    return df.select(F.inline(F.array(F.struct(*(F.col(f"`{c}`") for c in df.columns)))))
