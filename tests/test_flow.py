"""Outputs of the stages, the review flow, and files with pictures, comments and pages."""

import io
import json
import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from folioscope.functions import display
from folioscope.operators import classify, features, priority, rules, views
from folioscope.operators import prototypes as proto
from folioscope.functions import text as t
from folioscope.sources import files, stages, tables
from folioscope.streaming import arrivals
from tests.test_sources import S, W, docx, xlsx


def zipped(data, **more):
    out = io.BytesIO(data)
    with zipfile.ZipFile(out, "a") as z:
        for name, content in more.items():
            z.writestr(name.replace("__", "/"), content)
    return out.getvalue()


PNG = b"\x89PNG\r\n\x1a\n" + b"\0" * 8 + struct.pack(">II", 640, 480)


def test_image_sizes():
    jpeg = b"\xff\xd8\xff\xe0" + struct.pack(">H", 16) + b"\0" * 14 + b"\xff\xc0" + struct.pack(">HBHH", 17, 8, 30, 20) + b"\0" * 10
    assert files.image_size(PNG) == (640, 480) and files.image_size(jpeg) == (20, 30) and files.image_size(b"GIF89a" + struct.pack("<HH", 3, 4)) == (3, 4)
    assert files.image_size(b"BM" + b"\0" * 16 + struct.pack("<ii", 7, -8)) == (7, 8) and files.image_size(b"?") is None and files.image_size(b"\xff\xd8") is None


def test_docx_pictures_and_broken_parts():
    data = zipped(docx(["short"], []), **{"word/media/a.png": PNG, "word/media/b.png": b"bad", "word/header1.xml": "<w:hdr><w:t>kept &amp; head</w:t><v:textbox><p>box</p></v:textbox>"})
    config = files.ReadConfig(docx_images_up_to=100, max_images=2)

    def backend(data, suffix):
        if data == b"bad":
            raise ValueError("no picture")
        return " seen "

    title, text, _, pictures, notes = files.read_docx(data, config, backend)
    assert title == "short" and "kept & head" in text and "box" in text and pictures == "seen"
    assert "docx_image_ocr_error=b.png:no picture" in notes and "docx_image_ocr_used=1" in notes and "word/header1.xml:broken" in notes
    assert files.read_docx(data)[3] == ""


def test_xlsx_comments_title_and_hidden_sheets():
    data = xlsx([["Head", "b"], ["x", "y"]])
    rels = '<Relationships><Relationship Type="http://x/comments" Target="../comments1.xml"/></Relationships>'
    comments = f'<comments {S}><commentList><comment ref="A1"><text><t>a  note</t></text></comment></commentList></comments>'
    core = "<c xmlns:dc='http://purl.org/dc/elements/1.1/'><dc:title>Own title</dc:title></c>"
    data = zipped(data, **{"xl/worksheets/_rels/sheet1.xml.rels": rels, "xl/comments1.xml": comments, "docProps/core.xml": core})
    title, text, n, notes = files.read_xlsx(data, files.ReadConfig())
    assert title == "Own title" and text.endswith("[Comments One]\nA1: a note") and n == 1 and notes == "comments=One:1"
    assert "Comments" not in files.read_xlsx(data, files.ReadConfig(comments=False))[1]
    rows = files.read_scenario_rows(xlsx([["场景编号", "人工工时"], ["S1", "3"], ["S2"]]))
    assert rows == [{"场景编号": "S1", "人工工时": "3"}, {"场景编号": "S2", "人工工时": ""}]


def test_pdf_pages_pictures_and_records(spark, tmp_path):
    for name, data in {"a.pdf": b"%PDF", "b.png": PNG, "c.odd": b"text", "long.txt": b"x" * 50}.items():
        (tmp_path / name).write_bytes(data)

    def backend(data, suffix):
        if suffix == ".pdf":
            return files.Pages(" Told title ", ["one", ValueError("dark"), "  ", "four"])
        raise ValueError("blurred")

    rows = {r.file_name: r for r in files.parse_files(files.manifest(spark, str(tmp_path), content=True), files.ReadConfig(max_pages=2, max_chars=20), backend).collect()}
    pdf, png = rows["a.pdf"], rows["b.png"]
    assert (pdf.title, pdf.clean_text, pdf.page_count, pdf.parse_status) == ("Told title", "one", 4, "ok") and pdf.parse_notes == "page_truncated=4->2; page_2_error=dark"
    assert (png.image_width, png.image_height, png.parse_status, png.parse_notes) == (640, 480, "needs_ocr", "ocr_error=blurred")
    assert rows["c.odd"].parse_notes == "fallback_text" and rows["long.txt"].parse_notes == "truncated_to=20" and rows["long.txt"].content_truncated
    both = files.union_parsed(spark.createDataFrame([(1, "a")], "doc_id int, title string"), spark.createDataFrame([(2,)], "doc_id int"))
    assert [(r.doc_id, r.title) for r in both.orderBy("doc_id").collect()] == [(1, "a"), (2, None)]
    backend_, name = files.ocr_backend()
    assert (backend_ is None) == (name == "unavailable")


def test_scenario_sheet(spark, tmp_path):
    (tmp_path / "s.xlsx").write_bytes(xlsx([["场景编号", "人工工时", "自动归档上限", "人工复核上限"], ["S1", "12.5", "4", "x"]]))
    assert tables.read_scenario_sheet(spark, str(tmp_path / "s.xlsx")) == [priority.Scenario("S1", 12.5, 0, 4)]


TEXTS = ["apple pear plum fruit apple tree", "pear plum apple fruit sweet", "car road wheel engine car", "engine wheel road fast car"] * 6


@pytest.fixture(scope="module")
def parsed(spark):
    rows = [(i, "d1" if i % 2 else "d2", x.split()[0], "", x, "", "", "ok") for i, x in enumerate(TEXTS)] + [(90, "d1", "", "", "", "", "", "empty"), (91, "d1", "zzz", "2024-01-02", "", "", "", "ok")]
    df = spark.createDataFrame(rows, "doc_id long, dataset string, title string, time_info string, clean_text string, table_text string, ocr_text string, parse_status string")
    return df.withColumn("analysis_text", features.analysis_text(df, ())).cache()


@pytest.mark.parametrize("dims", [None, 2])
def test_classifier(spark, parsed, dims):
    config = proto.ClassifierConfig(dims=dims, max_df=0.9)
    assigned = spark.createDataFrame([(i, 0 if i % 4 < 2 else 7) for i in range(24)], "doc_id long, cluster_id long")
    summary = spark.createDataFrame([(0, "fruit、apple类", "", "apple、pear")], "cluster_id long, topic_name string, raw_topic_name string, top_terms string")
    model = proto.build(parsed, assigned, summary, t.tokens, config)
    fruit, cars = model.prototypes
    assert (fruit["topic_name"], fruit["raw_topic_name"], fruit["support"], fruit["top_terms"]) == ("fruit、apple类", "fruit、apple类", 12, ["apple", "pear"]) and cars["topic_name"] == "主题7"
    assert fruit["dictionary_terms"][:4] == ["fruit", "apple类", "apple", "pear"] and len(set(fruit["dictionary_terms"])) == len(fruit["dictionary_terms"]) <= 12
    assert all(abs((c * c).sum() - 1) < 1e-9 for c in model.centroids)
    ruleset = proto.RuleSet([rules.Rule("fruits", ("apple", "pear"), ("apple",), None, 2.4, 1.0, 0.0, needs_content=True)], [], "government", "other", {}, {})
    rows = {r.doc_id: r for r in proto.classify_documents(model, parsed, ruleset, t.tokens, config).collect()}
    assert len(rows[0].asDict()) == 37 and set(rows) == {*range(24), 91}  # without any field there is nothing to classify
    assert all(rows[i].topic_cluster_id == (0 if i % 4 < 2 else 7) for i in range(24))
    assert all(rows[i].classification_status == "assigned" and rows[i].top1_score > 0.5 for i in range(24))
    assert rows[0].topic_parent_name == "fruits" and rows[2].topic_parent_name == "other" and rows[0].available_fields == "title;clean_text"
    # a date counts as a field though none of its tokens is known; a text of unknown words is far from everything
    assert rows[91].available_fields == "title;time_info" and rows[91].top1_score == 0 and rows[91].classification_status == "unclassifiable" and rows[91].risk_level in ("medium", "high")
    assert abs(rows[0].field_coverage - 2.8 / 5.5) < 1e-6 and "apple" in rows[0].evidence_terms and rows[0].candidate_topics.startswith("fruit、apple类:")
    assert proto.build(parsed, assigned.filter("false"), summary, t.tokens, config).prototypes == []


def test_written_stages(spark, parsed, tmp_path):
    root = str(tmp_path)
    model = proto.build(parsed, parsed.filter("clean_text <> ''").select("doc_id", (F.col("doc_id") % 4).alias("cluster_id")), spark.createDataFrame([], "cluster_id long, topic_name string, raw_topic_name string, top_terms string"), t.tokens, proto.ClassifierConfig(dims=None))
    rows = proto.classify_documents(model, parsed, proto.RuleSet([], [], "", "other", {}, {}), t.tokens, proto.ClassifierConfig(dims=None))
    out = stages.write_classification(rows, proto.dictionary_rows(spark, model), root, config=proto.ClassifierConfig(dims=None))
    told = json.loads(spark.read.text(f"{root}/classification_meta").first()[0])
    assert told["target_documents"] == 25 and sum(told["counts"]["status_counts"].values()) == 25 and told["review_queue_size"] == out["queue"].count()
    assert out["dictionary"].count() == 4 and out["summary"].agg(F.sum("document_count")).first()[0] == 25
    assigned = parsed.filter("doc_id < 20").select("doc_id", F.lit(1).alias("cluster_id"))
    topics_ = stages.write_topics(assigned, spark.createDataFrame([(1, 20)], "cluster_id int, size int"), parsed, root, evaluations={"3": 0.5})
    assert topics_["selection"].count() == 6 and topics_["selection"].filter("analysis_text <> ''").count() == 0
    families = stages.write_families(spark.createDataFrame([(1, "raw", "name", 0.5, "why", "")], "cluster_id int, raw_topic_name string, topic_name string, family_confidence double, family_reason string, family_second string"), root)
    assert families["topic_family_summary"] is families["topic_summary_refined"] and len(families["topic_family_map"].columns) == 6
    assert "analysis_text" not in stages.write_features(parsed, root).columns and "clean_text" not in spark.read.parquet((stages.write_parsed(parsed, root), f"{root}/parsed_index")[1]).columns
    ranked = spark.createDataFrame([(1, "d", 0.5, "medium", 0.4, 0.3, 0.2, 0.5, 1)], "doc_id long, dataset string, priority_score double, priority_level string, misclassification_risk_score double, review_necessity_score double, urgency_score double, estimated_review_hours double, priority_rank long")
    allocations, plans = priority.allocate(spark, ranked, [priority.Scenario("S", 1.0, 5, 5)])
    made = stages.write_priorities(ranked, allocations, plans, root)
    assert made["allocations"].count() == 1 and "ahp" in json.loads(spark.read.text(f"{root}/review_priority_meta").first()[0])
    log = spark.createDataFrame([(i, i) for i in range(30)], "doc_id long, updated_at long")
    stages.export_logs(log, f"{root}/logs", "updated_at", most=10)
    assert {r.doc_id for r in spark.read.json(f"{root}/logs").collect()} == set(range(20, 30))


def test_cache_of_read_texts(spark, tmp_path):
    folder, cache = tmp_path / "in", str(tmp_path / "cache")
    folder.mkdir()
    for n in "ab":
        (folder / f"{n}.pdf").write_bytes(b"%PDF" + n.encode())
    reads = tmp_path / "reads"
    reads.mkdir()

    def backend(data, suffix, reads=str(reads)):
        import uuid

        open(f"{reads}/{uuid.uuid4().hex}", "w").close()
        return f"text {data[-1:].decode()}"

    read = lambda: {r.file_name: r.clean_text for r in files.parse_with_cache(files.manifest(spark, str(folder), True, True), cache, backend, "own").collect()}
    assert read() == {"a.pdf": "text a", "b.pdf": "text b"}
    n = len(list(reads.iterdir()))
    assert read() == {"a.pdf": "text a", "b.pdf": "text b"} and len(list(reads.iterdir())) == n
    (folder / "b.pdf").write_bytes(b"%PDF c")
    assert read() == {"a.pdf": "text a", "b.pdf": "text c"}


def test_allocation_is_the_walk(spark):
    import random

    rng = random.Random(3)
    rows = [(i, round(rng.random(), 3), rng.choice(["high", "medium", "low"]), round(rng.uniform(0.1, 0.9), 3), i + 1) for i in range(300)]
    ranked = spark.createDataFrame(rows, "doc_id long, priority_score double, priority_level string, estimated_review_hours double, priority_rank long")
    scenarios = [priority.Scenario("A", 7.3, 9, 20), priority.Scenario("B", 40.0, 1000, 3), priority.Scenario("C", 0.05, 5, 0)]
    order = sorted((r for r in rows if r[2] != "low"), key=lambda r: (r[2] != "high", -round(r[1] / max(r[3], 0.25), 9), -r[1], r[4]))
    want = set()
    for s in scenarios:
        used = n = 0
        for r in order:
            if n < s.manual_review_limit and used + r[3] <= s.manual_hours:
                used, n = used + r[3], n + 1
                want.add((s.scenario_id, r[0]))
    for step in (1, 7, 20_000):
        got, _ = priority.allocate(spark, ranked, scenarios, step)
        assert {(r.scenario_id, r.doc_id) for r in got.filter("allocated_action = 'manual_review'").collect()} == want


def test_review_actions_and_status(spark):
    rows = spark.createDataFrame([(1, "t", "noise"), (2, None, "uncertain"), (3, "t", "changed")], "doc_id long, topic_name string, s string")
    quick = {r.doc_id: r for r in priority.review_action(rows, F.col("s"), F.lit("now")).collect()}
    assert (quick[1].final_topic, quick[1].note, quick[2].final_topic, quick[3].final_topic) == ("噪声无效", "快速处理：噪声无效", "", "t")
    full = {r.doc_id: r.final_topic for r in priority.review_action(rows, F.col("s"), F.lit("now"), F.lit("new"), F.lit("n")).collect()}
    assert full == {1: "噪声无效", 2: "暂不确定", 3: "new"}
    docs = spark.createDataFrame([(1, ""), (2, "kept"), (3, "kept")], "doc_id long, manual string")
    log = spark.createDataFrame([(3, "noise")], "doc_id long, status string")
    assert {r.doc_id: r.review_local_status for r in views.with_review(docs, log, "doc_id", "manual").collect()} == {1: "pending", 2: "kept", 3: "noise"}
    assert [r.v for r in spark.createDataFrame([("b",), ("10",), ("9",), ("",), ("a",)], "v string").orderBy(*views.dynamic_order("v")).collect()] == ["", "9", "10", "a", "b"]
    views.register(spark, {"own_documents": docs})
    assert spark.sql("select count(*) from own_documents").first()[0] == 3
    shown = spark.range(1).select(display.whole(F.lit("1234567.5")), display.score(F.lit("x")), display.percent(F.lit(0.123)), display.escaped(F.lit("<a> & 'b'")), display.label(F.lit("")), display.label(F.lit("high"))).first()
    assert tuple(shown) == ("1,234,568", "0.000", "12.3%", "&lt;a&gt; &amp; &#039;b&#039;", "-", "高")


def test_reviews_of_several_streams(spark, tmp_path):
    schema = "doc_id long, status string, updated_at timestamp, event_id long"
    path = str(tmp_path / "out")
    for k, rows in enumerate([[(1, "a", 1), (2, "c", 5)], [(1, "b", 2), (2, "old", 4)]]):
        made = spark.createDataFrame(rows, "doc_id long, status string, event_id long").select("doc_id", "status", F.timestamp_seconds("event_id").alias("updated_at"), "event_id")
        made.write.parquet(str(tmp_path / f"in{k}"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / f"in{k}"))
        arrivals.latest_reviews(stream, path, str(tmp_path / f"cp{k}")).awaitTermination(120)
    want = {(1, "b"), (2, "c")}
    assert {(r.doc_id, r.status) for r in arrivals.newest_reviews(spark, path, schema).collect()} == want
    arrivals.merge_reviews(spark, path, schema)
    assert {(r.doc_id, r.status) for r in arrivals.newest_reviews(spark, path, schema).collect()} == want
    assert len([p for p in (tmp_path / "out").iterdir() if not p.name.startswith(("_", "."))]) == 1


def test_streams_of_features_and_windows(spark, parsed, tmp_path):
    parsed.withColumns({"raw_text": F.col("clean_text"), "suffix": F.lit(".txt"), "content_truncated": F.lit(False)}).drop("analysis_text").write.parquet(str(tmp_path / "docs"))
    batch = spark.read.parquet(str(tmp_path / "docs"))
    stream = arrivals.feature_stream(spark.readStream.schema(batch.schema).parquet(str(tmp_path / "docs")))
    stream.writeStream.format("memory").queryName("feature_rows_out").trigger(availableNow=True).start().awaitTermination(120)
    own = features.feature_rows(batch)
    assert sorted(map(str, spark.table("feature_rows_out").collect())) == sorted(map(str, own.collect()))
    log = spark.createDataFrame([(1, "a", 0), (2, "a", 3600), (3, "b", 90_000)], "id int, status string, s long").select("status", F.timestamp_seconds("s").alias("updated_at"))
    log.write.parquet(str(tmp_path / "log"))
    counts = arrivals.windowed_reviews(spark.readStream.schema(log.schema).parquet(str(tmp_path / "log")))
    counts.writeStream.outputMode("complete").format("memory").queryName("windows_out").trigger(availableNow=True).start().awaitTermination(120)
    assert sorted((r.status, r.n) for r in spark.table("windows_out").collect()) == [("a", 2), ("b", 1)]


def test_meta_of_nothing(spark):
    none = spark.createDataFrame([], "dataset string, status string, risk_level string, review_flag int")
    assert json.loads(classify.meta(none).first()["meta"])["total_documents"] == 0
    assert W
