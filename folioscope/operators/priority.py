"""Review priority: AHP weights, necessity, urgency, hours, ranks, and the allocation of reviewers' hours."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscope.functions import display, lexicons
from folioscope.functions import text as t
from folioscope.operators import views
from folioscope.operators.classify import level
from folioscope.operators.work import settled

#: How much more each criterion weighs than the others: risk, necessity, urgency.
AHP = ((1.0, 2.0, 3.0), (0.5, 1.0, 2.0), (1.0 / 3.0, 0.5, 1.0))
RANDOM_INDEX = 0.58


def ahp_weights(matrix: Sequence[Sequence[float]] = AHP) -> dict[str, float]:
    """Weights of the principal eigenvector (by power iteration), and its consistency."""
    n = len(matrix)
    x, eigen = [1.0 / n] * n, float(n)
    for _ in range(200):
        y = [sum(a * b for a, b in zip(row, x, strict=True)) for row in matrix]
        eigen = sum(y)  # x sums to one
        x = [v / eigen for v in y]
    index = (eigen - n) / (n - 1)
    return {"risk": x[0], "necessity": x[1], "urgency": x[2], "lambda_max": eigen, "consistency_index": index, "consistency_ratio": index / RANDOM_INDEX}


def ahp_struct(first: Column, second: Column, third: Column, rounds: int = 200) -> Column:
    """The same for three criteria in each row, as struct<risk, necessity, urgency, lambda_max, consistency_ratio>: how much more the first weighs than the second, the first than the third, and the second than the third."""

    def step(w: Column, _: Column) -> Column:
        a = w["a"] + first * w["b"] + second * w["c"]
        b = w["a"] / first + w["b"] + third * w["c"]
        c = w["a"] / second + w["b"] / third + w["c"]
        return F.struct((a / (a + b + c)).alias("a"), (b / (a + b + c)).alias("b"), (c / (a + b + c)).alias("c"), (a + b + c).alias("l"))

    equal = F.struct(*(F.lit(1.0 / 3).alias(x) for x in "abc"), F.lit(3.0).alias("l"))
    told = lambda w: F.struct(w["a"].alias("risk"), w["b"].alias("necessity"), w["c"].alias("urgency"), w["l"].alias("lambda_max"), ((w["l"] - 3) / 2 / RANDOM_INDEX).alias("consistency_ratio"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), equal, step, told)


def signal_score(f: DataFrame) -> Column:
    flag = lambda k: t.safe_int(f[f"{k}_signal"])
    score = 0.35 * flag("money") + 0.25 * flag("approval") + 0.20 * flag("review") + 0.10 * flag("business") + 0.10 * flag("policy")
    return F.least(F.lit(1.0), score)


def necessity_score(keyword: Column, money: Column, signal: Column) -> Column:
    strong = (money >= 0.8) | (keyword >= 0.75)
    return F.when(strong, F.greatest(keyword, money, signal)).otherwise(F.least(F.lit(1.0), 0.45 * keyword + 0.35 * money + 0.20 * signal))


def review_hours(length: Column, parse_status: Column, risk_level: Column) -> Column:
    more = F.when(F.coalesce(parse_status, F.lit("")) != "ok", 0.10).otherwise(0.0) + F.when(risk_level == "high", 0.10).otherwise(0.0)
    return F.round(0.12 + F.least(F.lit(0.5), length / 20000.0) + more, 3)


def prioritize(rows: DataFrame, as_of: Column, urgency: Sequence[str] = lexicons.URGENCY, necessity: Sequence[str] = lexicons.NECESSITY) -> DataFrame:
    """rows: feature rows with doc_id, dataset, analysis_text (normalised, as feature_rows gives it), risk_score, risk_level, parse_status. Adds the scores, level, hours and terms; ``as_of`` is the day that counts as today."""
    text, low = F.col("analysis_text"), F.col("lowered")
    ahp = ahp_weights()
    out = rows.withColumn("lowered", F.lower(text)).withColumns({
        "urgency_score": F.greatest(t.keyword_score(low, urgency, True, True), F.least(F.lit(1.0), t.safe_double(F.col("time_keyword_hits")) / 4), t.date_urgency(text, as_of)),
        "keyword_score": t.keyword_score(low, necessity, True, True), "money": t.money_values(text, True), "signal_score": signal_score(rows),
        "urgency_terms": F.array_join(F.slice(t.contained(low, urgency, True, True), 1, 8), "、"), "necessity_terms": F.array_join(F.slice(t.contained(low, necessity, True, True), 1, 8), "、"),
    })
    out = out.withColumns({"money_score": t.money_score(F.col("money")), "max_money_value": F.round(F.coalesce(F.array_max("money"), F.lit(0.0)), 2)}).drop("money")
    out = out.withColumn("review_necessity_score", necessity_score(F.col("keyword_score"), F.col("money_score"), F.col("signal_score")))
    score = F.lit(ahp["risk"]) * F.col("risk_score") + F.lit(ahp["necessity"]) * F.col("review_necessity_score") + F.lit(ahp["urgency"]) * F.col("urgency_score")
    out = out.withColumn("raw_score", F.least(F.lit(1.0), F.greatest(F.lit(0.0), score)))
    six = lambda c: F.round(c, 6)
    return out.select(
        "doc_id", "dataset", six("risk_score").alias("misclassification_risk_score"), six("urgency_score").alias("urgency_score"), six("review_necessity_score").alias("review_necessity_score"),
        six("raw_score").alias("priority_score"), level(F.col("raw_score")).alias("priority_level"),
        review_hours(F.greatest(F.length("analysis_text"), F.col("analysis_len")), F.col("parse_status"), F.col("risk_level")).alias("estimated_review_hours"),
        "max_money_value", six("money_score").alias("money_score"), "urgency_terms", "necessity_terms",
    )


def with_rank(rows: DataFrame, *order: Column, name: str = "priority_rank") -> DataFrame:
    """1-based rank in a total order. Rows are sorted in ranges, and a row's place is its place in the range on top of the sizes of the ranges before: no task sees more
    than a range, however many rows share a score. The sorted rows are kept, since they are read twice."""
    at = views.fresh(rows, "at")
    rows = settled(rows)  # finding the ranges reads all rows, as sorting them does
    sorted_ = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(at, F.monotonically_increasing_id()).persist()
    part, before, starts = F.shiftright(at, 33), 0, []
    for r in sorted(sorted_.groupBy(part.alias("part")).count().collect()):  # a row a range
        starts.append((r["part"], before))
        before += r["count"]
    offsets = sorted_.sparkSession.createDataFrame(starts, "part long, before long")
    out = sorted_.join(F.broadcast(offsets.select(F.col("part").alias(f"{at}_part"), F.col("before").alias(f"{at}_before"))), part == F.col(f"{at}_part"))
    return out.withColumn(name, F.col(f"{at}_before") + F.col(at).bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop(at, f"{at}_part", f"{at}_before")


def priority_rank(rows: DataFrame) -> DataFrame:
    return with_rank(rows, F.desc("priority_score"), F.desc("misclassification_risk_score"), F.desc("review_necessity_score"), F.col("doc_id").cast("string"))


def summarize_priority(rows: DataFrame) -> DataFrame:
    mean = lambda c: F.round(F.avg(c), 6).alias(f"avg_{c}")
    return rows.groupBy("dataset", "priority_level").agg(F.count(F.lit(1)).alias("document_count"), *(mean(c) for c in ("priority_score", "misclassification_risk_score", "review_necessity_score", "urgency_score")), F.round(F.sum("estimated_review_hours"), 3).alias("total_estimated_hours"))


@dataclass(frozen=True)
class Scenario:
    scenario_id: str
    manual_hours: float
    manual_review_limit: int
    auto_archive_limit: int


def candidates(ranked: DataFrame) -> DataFrame:
    """Review candidates in the order in which hours are spent: high before medium, then score per hour, score, rank."""
    rows = ranked.filter(F.col("priority_level").isin("high", "medium"))
    worth = F.round(F.col("priority_score") / F.greatest(F.col("estimated_review_hours"), F.lit(0.25)), 9)
    return with_rank(rows, F.when(F.col("priority_level") == "high", 0).otherwise(1).asc(), worth.desc(), F.desc("priority_score"), F.asc("priority_rank"), name="turn")


def allocate(spark: SparkSession, ranked: DataFrame, scenarios: Sequence[Scenario], step: int = 20_000) -> tuple[DataFrame, DataFrame]:
    """(allocations, plans). Candidates are walked in turn; one that doesn't fit is passed over, not the end of the walk.

    Each choice depends on those before it, so choices are made on the driver, from the next ``step`` candidates that still fit some scenario (two numbers each). Hours left only
    shrink, so what doesn't fit now never will, and the first of each step is taken: what comes to the driver is bounded by the scenarios' own limits, not by the candidates."""
    order = candidates(ranked).select("turn", "doc_id", "priority_rank", "priority_level", "priority_score", "estimated_review_hours")
    low = with_rank(ranked.filter("priority_level = 'low'"), F.desc("priority_score"), F.asc("priority_rank"), name="turn")
    n, n_low = order.count(), low.count()
    state = {s.scenario_id: [0.0, 0, 0] for s in scenarios}  # hours, documents, of these high
    picks: list[tuple[str, int]] = []
    first = 1
    while open_ := [s for s in scenarios if state[s.scenario_id][1] < s.manual_review_limit]:
        fits = F.lit(False)
        for s in open_:
            fits = fits | (F.lit(state[s.scenario_id][0]) + F.col("estimated_review_hours") <= F.lit(s.manual_hours))
        rows = order.filter((F.col("turn") >= first) & fits).select("turn", "estimated_review_hours", "priority_level").orderBy("turn").limit(step).collect()
        for s in open_:
            now = state[s.scenario_id]
            for turn, hours, rank in rows:
                if now[1] < s.manual_review_limit and now[0] + hours <= s.manual_hours:
                    now[0] += hours
                    now[1] += 1
                    now[2] += rank == "high"
                    picks.append((s.scenario_id, turn))
        if len(rows) < step:
            break
        first = rows[-1]["turn"] + 1
    chosen = spark.createDataFrame(picks, "scenario_id string, turn long")
    cols = ["scenario_id", "doc_id", "priority_rank", "priority_level", "priority_score"]
    manual = order.join(chosen, "turn").select(*cols, F.lit("manual_review").alias("allocated_action"), "estimated_review_hours")
    limits = F.broadcast(spark.createDataFrame([(s.scenario_id, s.auto_archive_limit) for s in scenarios], "scenario_id string, most long"))
    auto = low.join(limits, F.col("turn") <= F.col("most")).select(*cols, F.lit("auto_archive").alias("allocated_action"), F.lit(0.0).alias("estimated_review_hours"))
    plans = []
    for s in scenarios:
        hours, docs, high = state[s.scenario_id]
        plans.append((s.scenario_id, float(s.manual_hours), s.manual_review_limit, s.auto_archive_limit, docs, high, docs - high, min(s.auto_archive_limit, n_low), max(0, n - docs), round(hours, 3), round(max(0.0, s.manual_hours - hours), 3), int(docs >= s.manual_review_limit), int(hours >= s.manual_hours)))
    schema = "scenario_id string, manual_hours double, manual_review_limit long, auto_archive_limit long, manual_review_selected long, high_priority_selected long, medium_priority_selected long, auto_archive_selected long, deferred_review_count long, used_manual_hours double, remaining_manual_hours double, manual_limit_binding int, hour_limit_binding int"
    return manual.unionByName(auto), spark.createDataFrame(plans, schema)


def latest_review(log: DataFrame, doc: str, at: str, tie: str) -> DataFrame:
    """The newest log row of each document."""
    kept = log.groupBy(doc).agg(F.max_by(F.struct(*(c for c in log.columns if c != doc)), F.struct(at, tie)).alias("r"))
    return kept.select(doc, "r.*")


def review_effect(status: Column, original: Column, final: Column) -> Column:
    return F.when(status.isin("confirmed", "changed"), F.when(original.eqNullSafe(final), "category_confirmed").otherwise("category_adjusted")).otherwise(status)


def audit_sample(rows: DataFrame, key: str, buckets: dict[str, tuple[Column, int]], seed: str = "audit") -> DataFrame:
    """(key, audit_bucket, primary_audit_bucket): so many rows of each bucket by a hash of key, seed and bucket; a row in several buckets comes once, its buckets joined by ';' in their order."""
    tagged = rows.select(key, F.array_compact(F.array(*(F.when(c, F.struct(F.lit(i).alias("i"), F.lit(b).alias("bucket"), F.lit(q).alias("quota"))) for i, (b, (c, q)) in enumerate(buckets.items())))).alias("b"))
    flat = tagged.select(key, F.explode("b").alias("b")).select(key, "b.*").withColumn("draw", F.md5(F.concat_ws("|", F.lit(seed), F.col("bucket"), F.col(key).cast("string")).cast("binary")))
    drawn = flat.withColumn("n", F.row_number().over(Window.partitionBy("bucket").orderBy("draw", key))).filter("n <= quota")
    found = drawn.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "bucket"))), lambda x: x["bucket"]).alias("all"))
    return found.select(key, F.array_join("all", ";").alias("audit_bucket"), F.element_at("all", 1).alias("primary_audit_bucket"))


# Topics that count as one bucket, and the names that a status gives.
EDUCATION_TOPICS = ("院校概况类", "科研项目类", "校园活动类", "论文期刊类", "招生学位类", "教务培养类", "国际合作类", "科研创新类")
OPEN_TOPIC = "综合待判别类"
STATUS_TOPICS = {"unclassifiable": "无法归类", "noise": "噪声无效", "uncertain": "暂不确定"}
EVALUABLE = ("confirmed", "noise", "uncertain", "unclassifiable")
# End of fixed values.


def original_bucket(topic: Column, own: Sequence[str] = EDUCATION_TOPICS, open_topic: str = OPEN_TOPIC) -> Column:
    return F.when(topic == open_topic, "综合待判别").when(topic.isin(*own), "教育科研原类").otherwise("其他原类")


def final_bucket(topic: Column, original: Column, own: Sequence[str] = EDUCATION_TOPICS) -> Column:
    """Noise, unsure and unclassifiable by their names, then the same topic as before, then one of the own topics, then any other."""
    out = F.when(topic == STATUS_TOPICS["noise"], "噪声无效").when(topic == STATUS_TOPICS["uncertain"], "暂不确定").when(topic == STATUS_TOPICS["unclassifiable"], "无法归类")
    return out.when(topic.eqNullSafe(original), "保持原类").when(topic.isin(*own), "教育科研细类").otherwise("其他业务类")


def transition_matrix(reviews: DataFrame, own: Sequence[str] = EDUCATION_TOPICS, open_topic: str = OPEN_TOPIC) -> DataFrame:
    """Reviewed documents by original bucket (rows) and final bucket (columns). reviews: manual_status, original_topic, final_topic; other statuses than the four that tell a result are left out."""
    columns = ["噪声无效", "暂不确定", "无法归类", "教育科研细类", "其他业务类", "保持原类"]
    rows = reviews.filter(F.col("manual_status").isin(*EVALUABLE))
    rows = rows.select(original_bucket(F.col("original_topic"), own, open_topic).alias("original"), final_bucket(F.col("final_topic"), F.col("original_topic"), own).alias("final"))
    return rows.groupBy("original").pivot("final", columns).agg(F.count(F.lit(1))).fillna(0)


def review_action(rows: DataFrame, status: Column, at: Column, final_topic: Column | None = None, note: Column | None = None, operator: Column | None = None) -> DataFrame:
    """Log rows for review actions. rows: doc_id, topic_name. A quick action has neither topic nor note: it keeps the topic unless its status names one."""
    topic = F.coalesce("topic_name", F.lit(""))
    wanted = topic if final_topic is None else F.coalesce(F.nullif(final_topic, F.lit("")), topic)
    named = {k: v for k, v in STATUS_TOPICS.items() if final_topic is not None or k != "uncertain"}
    for k, v in named.items():
        wanted = F.when(status == k, F.lit(v)).otherwise(wanted)
    told = note if note is not None else F.concat(F.lit("快速处理："), display.label(status))
    return rows.select("doc_id", status.alias("status"), topic.alias("original_topic"), wanted.alias("final_topic"), told.alias("note"), (operator if operator is not None else F.lit("reviewer")).alias("operator"), at.alias("updated_at"))


def review_inputs(classified: DataFrame, parsed: DataFrame, features: DataFrame, key: str = "doc_id") -> DataFrame:
    """Classified documents with their parsed text (column analysis_text) and feature row; without a parsed row the title is the text. The right sides have one row a document."""
    sides = [x.withColumnRenamed(key, fresh_) for x, fresh_ in ((parsed, "__p"), (features, "__f"))]
    both = classified.join(sides[0].select("__p", F.col("analysis_text").alias("__text")), classified[key] == F.col("__p"), "left")
    text = F.when(F.col("__p").isNull(), F.coalesce("title", F.lit(""))).otherwise(F.col("__text")).alias("analysis_text")
    own = [c for c in features.columns if c != key and c not in classified.columns and c != "analysis_text"]
    both = both.join(sides[1].select("__f", *own), both[key] == F.col("__f"), "left")
    return both.select(*(c for c in classified.columns if c != "analysis_text"), text, *own)
