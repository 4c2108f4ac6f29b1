"""Files in, tables out, streams."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from folioscope.operators import topics
from folioscope.sources import files, tables
from folioscope.streaming import arrivals

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'


def docx(paragraphs, cells):
    body = "".join(f"<w:p><w:r><w:t>{p}</w:t></w:r></w:p>" for p in paragraphs)
    table = "<w:tbl>" + "".join("<w:tr>" + "".join(f"<w:tc><w:p><w:r><w:t>{c}</w:t></w:r></w:p></w:tc>" for c in row) + "</w:tr>" for row in cells) + "</w:tbl>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {W}><w:body>{body}{table}</w:body></w:document>")
        z.writestr("word/footer1.xml", f"<w:ftr {W}><w:p><w:r><w:t>page foot</w:t></w:r></w:p></w:ftr>")
    return out.getvalue()


def xlsx(rows):
    letters = "ABCDEFGHIJ"
    data = "".join(f'<row r="{i}">' + "".join(f'<c r="{letters[k]}{i}" t="inlineStr"><is><t>{c}</t></is></c>' for k, c in enumerate(row) if c) + "</row>" for i, row in enumerate(rows, 1))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {S}><sheets><sheet name="One" sheetId="1"/></sheets></workbook>')
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {S}><sheetData>{data}</sheetData></worksheet>")
    return out.getvalue()


@pytest.fixture
def root(tmp_path):
    made = {
        "数据集1 a/note.txt": "第一行标题\n正文 2024-03-05".encode("gb18030"), "数据集1 a/doc.docx": docx(["Title line here", "Body"], [["a", "b"], ["c", ""]]), "数据集2/book.xlsx": xlsx([["Head", ""], ["x", "y"]]),
        "数据集3/rows.xlsx": xlsx([["文件编号", "正文片段", "时间信息"], ["F1", "some body", "2023Q1"], ["", "", ""], ["", "no id", ""]]), "数据集4/bad.docx": b"not a zip", "other/p.pdf": b"%PDF", "other/i.png": b"\x89PNG", "other/e.txt": b"", "other/odd.xyz": b"text",
    }
    for name, data in made.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    return str(tmp_path)


def test_parse(spark, root):
    rows = {r.doc_id: r for r in files.parse_files(files.manifest(spark, root, content=True)).collect()}
    note = rows["dataset1:note"]
    assert note.title == "第一行标题" and note.time_info.startswith("2024-03-05") and note.parse_notes == "encoding=gb18030" and note.parse_status == "ok"
    doc = rows["dataset1:doc"]
    assert doc.title == "Title line here" and "page foot" in doc.raw_text and doc.table_text == "[Table 1]\na | b\nc |" and doc.table_text in doc.clean_text
    assert rows["dataset2:book"].title == "Head" and rows["dataset2:book"].table_text.startswith("[Sheet One rows=2 cols=2]")
    assert rows["dataset3:F1"].title == "F1 some body" and rows["dataset3:F1"].time_info == "2023Q1" and rows["dataset3:row00003"].raw_text == "no id"
    assert rows["dataset4:bad"].parse_status == "error"
    assert rows["unknown:p"].parse_status == "needs_ocr" and rows["unknown:i"].parse_status == "needs_ocr" and rows["unknown:e"].parse_status == "empty" and rows["unknown:odd"].parse_status == "unsupported"
    assert len(rows) == 10


def test_backend(spark, root):
    got = files.parse_files(files.manifest(spark, root, content=True).filter("suffix in ('.pdf', '.png')"), backend=lambda data, suffix: f"read {suffix}").collect()
    assert {(r.parse_status, r.clean_text) for r in got} == {("ok", "read .pdf"), ("ok", "read .png")}


def test_tables(spark, tmp_path):
    (tmp_path / "a.csv").write_text('﻿id,text\n1,"say ""hi"",\nthere"\n,\n2,x\n', encoding="utf-8")
    rows = tables.read_csv(spark, str(tmp_path / "a.csv")).collect()
    assert [r.id for r in rows] == ["1", "2"] and rows[0].text == 'say "hi",\nthere'
    (tmp_path / "b.jsonl").write_text('{"a": 1}\n\n{"a": 2}\n')
    assert [r.a for r in tables.read_jsonl(spark, str(tmp_path / "b.jsonl"), "a int").collect()] == [1, 2]
    out = tables.write_stage(spark.range(3).withColumn("x", F.lit("y")), str(tmp_path / "stage"), ("id",), csv=True)
    assert out.count() == 3 and spark.read.parquet(str(tmp_path / "stage_index")).columns == ["id"]
    s = tables.read_scenarios(spark.createDataFrame([("S1", "12.5", None)], "`场景编号` string, `人工工时` string, `自动归档上限` string"))
    assert (s[0].scenario_id, s[0].manual_hours, s[0].auto_archive_limit, s[0].manual_review_limit) == ("S1", 12.5, 0, 0)


def test_latest_reviews_stream(spark, tmp_path):
    schema = "doc_id long, status string, updated_at timestamp, event_id long"
    log = spark.sql("select * from values (1L,'a',timestamp'2024-01-01 00:00:00',1L),(1L,'b',timestamp'2024-01-02 00:00:00',2L),(2L,'c',timestamp'2024-01-01 00:00:00',3L) t(doc_id,status,updated_at,event_id)")
    log.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    q = arrivals.latest_reviews(stream, str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert {(r.doc_id, r.status) for r in spark.read.parquet(str(tmp_path / "out" / "0")).collect()} == {(1, "b"), (2, "c")}


def test_topic_fit(spark):
    texts = ["apple pear plum fruit apple tree", "pear plum apple fruit sweet", "car road wheel engine car", "engine wheel road fast car"] * 6
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "id int, text string")
    config = topics.TopicConfig(dims=2, starts=2, max_df=0.9)
    rows = topics.embed(df, topics.default_tokens("text", config), config)
    found, _, cost = topics.cluster(rows, 2, config)
    got = found.collect()
    assert all(abs(sum(x * x for x in r.embedding) - 1) < 1e-6 for r in got) and cost >= 0
    assert len({r.cluster_id for r in got if r.id % 4 < 2}) == 1 and len({r.cluster_id for r in got}) == 2
    named = topics.distance_confidence(found, "cluster_id", "distance_to_centroid")
    assert all(0 < r.confidence <= 1 for r in named.collect())
    assert abs(topics.cluster_summary(named, "cluster_id", "distance_to_centroid").agg(F.sum("share")).first()[0] - 1) < 1e-6
    k, _ = topics.choose_k(rows, topics.TopicConfig(k_min=2, k_max=3))
    assert k in (2, 3)
