"""File ingestion: manifest, text files with encoding fallback, DOCX and XLSX by their zipped XML, rows of anonymous-record sheets.

Bytes become text in Arrow batches (mapInArrow); all that follows is Column logic. Files that can't be read never stop a job: they
come back with status and notes. PDF and image text need a backend, a function bytes -> text given by the caller (see ocr_backend); without one the status is needs_ocr.
For PDF the backend may return a Pages value, with the file's title and the text (or the error) of each page."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions import text as t

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# The encodings that are tried, in this order.
ENCODINGS = ("utf-8-sig", "utf-8", "gb18030", "gbk")
# End of fixed values.
IMAGES = (".png", ".jpg", ".jpeg", ".bmp", ".gif", ".tif", ".tiff", ".webp")
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_SCHEMA = "dataset string, file_path string, file_name string, suffix string, size_bytes long, row_id string, title string, time_info string, raw_text string, table_text string, ocr_text string, status string, notes string, sheet_count int, page_count int, image_width int, image_height int"


@dataclass(frozen=True)
class ReadConfig:
    max_chars: int = 20_000
    max_rows: int = 40
    max_cols: int = 15
    hidden_sheets: bool = True
    comments: bool = True
    max_pages: int = 25
    max_images: int = 40
    docx_images_up_to: int = -1  # pictures in DOCX files are read if the text has at most so many characters; -1: never
    row_dataset: str = "dataset3"
    row_columns: tuple[str, str, str] = ("文件编号", "正文片段", "时间信息")


def dataset_of(path: Column, prefixes: tuple[str, ...] = ("数据集1", "数据集2", "数据集3", "数据集4")) -> Column:
    """dataset1..n by the first path part that starts with a prefix, else unknown."""
    out = F.lit("unknown")
    for i in range(len(prefixes), 0, -1):
        out = F.when(path.rlike(f"(?:^|/){prefixes[i - 1]}[^/]*(?:/|$)"), F.lit(f"dataset{i}")).otherwise(out)
    return out


def manifest(spark: SparkSession, root: str, content: bool = False, modified: bool = False) -> DataFrame:
    """One row per file under root: dataset, file_path, file_name, suffix, size_bytes (and content, and modified; files of no bytes have no time)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    plain = lambda c: F.regexp_replace(F.url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), "^file:/+", "/")
    read = files.select(plain(F.col("path")).alias("path"), F.col("length"), *(["content"] if content else []), *([F.col("modificationTime").alias("modified")] if modified else []))
    # the reader leaves out files of no bytes, though its listing has them
    listed = spark.createDataFrame([(p,) for p in files.inputFiles()], "path string").select(plain(F.col("path")).alias("path"))
    empty = listed.join(read.select("path"), "path", "left_anti").select("path", F.lit(0).cast("long").alias("length"), *([F.lit(b"").cast("binary").alias("content")] if content else []), *([F.lit(None).cast("timestamp").alias("modified")] if modified else []))
    rows = read.unionByName(empty)
    name = F.element_at(F.split("path", "/"), -1)
    suffix = F.when(name.rlike(r"[^.]\.[^.]+$"), F.lower(F.regexp_extract(name, r"(\.[^.]+)$", 1))).otherwise("")
    return rows.select(dataset_of(F.col("path")).alias("dataset"), F.col("path").alias("file_path"), name.alias("file_name"), suffix.alias("suffix"), F.col("length").alias("size_bytes"), *(["content"] if content else []), *(["modified"] if modified else []))


def decode_text(data: bytes) -> tuple[str, str]:
    for e in ENCODINGS:
        try:
            return data.decode(e), "" if e.startswith("utf-8") else f"encoding={e}"
        except UnicodeDecodeError:
            continue
    return data.decode("utf-8", "replace"), "encoding=lossy"


def _parts(archive, *starts: str) -> list[str]:
    return sorted(n for n in archive.namelist() if n.startswith(starts) and n.endswith(".xml"))


@dataclass(frozen=True)
class Pages:
    """What a backend tells of a PDF: its title and, for each page, the text or an exception."""

    title: str
    pages: list


def image_size(data: bytes) -> tuple[int, int] | None:
    """(width, height) of a PNG, GIF, BMP or JPEG file by its header; none if it is of another kind."""
    import struct

    if data[:8] == b"\x89PNG\r\n\x1a\n" and len(data) >= 24:
        return struct.unpack(">II", data[16:24])
    if data[:4] == b"GIF8" and len(data) >= 10:
        return struct.unpack("<HH", data[6:10])
    if data[:2] == b"BM" and len(data) >= 26:
        w, h = struct.unpack("<ii", data[18:26])
        return w, abs(h)
    at = 2
    while data[:2] == b"\xff\xd8" and at + 9 <= len(data) and data[at] == 0xFF:
        kind, size = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
        if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):  # a frame's header
            h, w = struct.unpack(">HH", data[at + 5 : at + 9])
            return w, h
        at += 2 + size
    return None


def ocr_backend(language: str = "chi_sim+eng") -> tuple[Callable[[bytes, str], str] | None, str]:
    """(backend, its name): the first engine that is installed, tried in this order; the engine's own language where it lacks the wanted one. The backend makes its engine where it runs, once a process."""
    import importlib.util

    found = next((n for n in ("pytesseract", "rapidocr_onnxruntime") if importlib.util.find_spec(n)), None)
    if found is None or importlib.util.find_spec("PIL") is None:
        return None, "unavailable"
    engine: list = []

    def read(data: bytes, suffix: str) -> str:
        import io

        from PIL import Image

        with Image.open(io.BytesIO(data)) as opened:
            picture = opened.convert("RGB")
        if found == "pytesseract":
            import pytesseract

            try:
                return pytesseract.image_to_string(picture, lang=language)
            except pytesseract.TesseractError:
                return pytesseract.image_to_string(picture)
        import numpy as np
        from rapidocr_onnxruntime import RapidOCR

        if not engine:
            engine.append(RapidOCR())
        lines, _ = engine[0](np.asarray(picture))
        return "\n".join(str(x["text"] if isinstance(x, dict) else x[1]) for x in lines or ())

    return read, found


def _broken_xml(raw: str) -> list[str]:
    """Texts of a part that is no XML: what stands in text elements and text boxes, tags and entities taken off."""
    import re
    from html import unescape

    found = re.findall(r"<([wa]):t\b[^>]*>([^<]*)</\1:t>", raw)
    boxes = re.findall(r"<v:textbox\b[^>]*>(.*?)</v:textbox>", raw, re.S)
    lines = [unescape(x).strip() for x in [*(x for _, x in found), *(re.sub(r"<[^>]*>", "", b) for b in boxes)]]
    return [x for x in lines if x]


def read_docx(data: bytes, config: ReadConfig = ReadConfig(), backend: Callable[[bytes, str], str] | None = None) -> tuple[str, str, str, str, str]:
    """(title, text, tables, picture text, notes): paragraphs, headers and footers, and text of notes, comments and shapes that isn't there yet, each once.
    Pictures are read if the text is short enough and there is a backend; one that fails is noted."""
    import io
    import xml.etree.ElementTree as et
    import zipfile

    notes, lines, tables, title, seen = [], [], [], "", []
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        if "docProps/core.xml" in z.namelist():
            for e in et.fromstring(z.read("docProps/core.xml")).iter():
                if e.tag.endswith("}title"):
                    title = (e.text or "").strip()
        for part in ["word/document.xml", *_parts(z, "word/header", "word/footer", "word/footnotes", "word/endnotes", "word/comments")]:
            try:
                root = et.fromstring(z.read(part))
            except KeyError:
                notes.append(f"{part}:missing")
                continue
            except et.ParseError:
                notes.append(f"{part}:broken")
                lines += _broken_xml(z.read(part).decode("utf-8", "ignore"))
                continue
            inside = {id(p) for tbl in root.iter() if tbl.tag.endswith("}tbl") for p in tbl.iter()}
            for n, tbl in enumerate((x for x in root.iter() if x.tag.endswith("}tbl")), 1):
                rows = [" | ".join("".join(w.text or "" for w in cell.iter() if w.tag.endswith("}t")).strip() for cell in row if cell.tag.endswith("}tc")) for row in tbl.iter() if row.tag.endswith("}tr")]
                tables.append("\n".join([f"[Table {n}]", *(r for r in rows if r.strip(" |"))]))
            for p in root.iter():
                if p.tag.endswith("}p") and id(p) not in inside:
                    line = "".join(w.text or "" for w in p.iter() if w.tag.endswith("}t")).strip()
                    if line:
                        lines.append(line)
        lines = list(dict.fromkeys(lines))
        if sum(map(len, lines)) <= config.docx_images_up_to:
            pictures = sorted(n for n in z.namelist() if n.startswith("word/media/") and n.lower().endswith(IMAGES))
            if backend is None:
                notes.append("docx_image_ocr_unavailable")
            elif len(pictures) > config.max_images:
                notes.append(f"docx_image_ocr_truncated={len(pictures)}->{config.max_images}")
            for name in pictures[: config.max_images] if backend else ():
                try:
                    seen.append(backend(z.read(name), "." + name.rsplit(".", 1)[-1].lower()).strip())
                except Exception as e:  # the other pictures still count
                    notes.append(f"docx_image_ocr_error={name.rsplit('/', 1)[-1]}:{e}")
            seen = [x for x in seen if x]
            if seen:
                notes.append(f"docx_image_ocr_used={len(seen)}")
    return title or (lines[0] if lines else ""), "\n".join(lines), "\n".join(tables), "\n\n".join(seen), "; ".join(notes)


def _sheets(data: bytes):
    """(name, hidden, rows, comments) of each sheet; rows are lists of cell texts in column order, comments are (cell, text)."""
    import io
    import re
    import xml.etree.ElementTree as et
    import zipfile

    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = z.namelist()
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(x.text or "" for x in si.iter(f"{_MAIN}t")) for si in et.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_MAIN}si")]
        book = [(s.get("name", ""), s.get("state", "visible") != "visible") for s in et.fromstring(z.read("xl/workbook.xml")).iter(f"{_MAIN}sheet")]
        parts = sorted((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[-1]))
        for (name, hidden), part in zip(book, parts, strict=False):
            rows = []
            for row in et.fromstring(z.read(part)).iter(f"{_MAIN}row"):
                cells: dict[int, str] = {}
                for k, c in enumerate(row.iter(f"{_MAIN}c")):
                    letters = re.match(r"[A-Z]+", c.get("r", ""))
                    at = k
                    if letters:
                        at = 0
                        for ch in letters[0]:
                            at = at * 26 + ord(ch) - 64
                        at -= 1
                    value = c.find(f"{_MAIN}v")
                    if c.get("t") == "s" and value is not None:
                        text = shared[int(value.text)]
                    elif c.get("t") == "inlineStr":
                        text = "".join(x.text or "" for x in c.iter(f"{_MAIN}t"))
                    else:
                        text = value.text or "" if value is not None else ""
                    cells[at] = text.strip()
                rows.append([cells.get(i, "") for i in range(max(cells, default=-1) + 1)])
            yield name, hidden, rows, _comments(z, part)


def _comments(z, part: str) -> list[tuple[str, str]]:
    """(cell, text) of a sheet's comments, found by the sheet's own list of related parts."""
    import posixpath
    import xml.etree.ElementTree as et

    related, out = f"xl/worksheets/_rels/{part.rsplit('/', 1)[-1]}.rels", []
    if related not in z.namelist():
        return out
    for r in et.fromstring(z.read(related)):
        if r.get("Type", "").endswith("/comments"):
            target = posixpath.normpath(posixpath.join("xl/worksheets", r.get("Target", ""))).lstrip("/")
            target = r.get("Target", "").lstrip("/") if r.get("Target", "").startswith("/") else target
            if target in z.namelist():
                out += [(c.get("ref", ""), " ".join("".join(x.text or "" for x in c.iter(f"{_MAIN}t")).split())) for c in et.fromstring(z.read(target)).iter(f"{_MAIN}comment")]
    return out


def _property_title(data: bytes) -> str:
    import io
    import xml.etree.ElementTree as et
    import zipfile

    with zipfile.ZipFile(io.BytesIO(data)) as z:
        if "docProps/core.xml" not in z.namelist():
            return ""
        return next(((e.text or "").strip() for e in et.fromstring(z.read("docProps/core.xml")).iter() if e.tag.endswith("}title")), "")


def read_xlsx(data: bytes, config: ReadConfig) -> tuple[str, str, int, str]:
    """(title, tables, sheets, notes): the first rows and columns of each sheet, cells joined by ' | ', and comments; the title is the workbook's own, else the first cell with text in the first five rows."""
    out, title, n, notes = [], _property_title(data), 0, []
    for name, hidden, rows, comments in _sheets(data):
        n += 1
        if hidden and not config.hidden_sheets:
            notes.append(f"hidden_sheet_skipped={name}")
            continue
        out.append(f"[Sheet {name} rows={len(rows)} cols={max(map(len, rows), default=0)}]")
        for row in rows[: config.max_rows]:
            line = " | ".join(row[: config.max_cols])
            if line.strip(" |"):
                out.append(line)
        if comments and config.comments:
            out += [f"[Comments {name}]", *(f"{cell}: {text}" for cell, text in comments[: config.max_rows])]
            notes.append(f"comments={name}:{len(comments)}")
        title = title or next((c for row in rows[:5] for c in row if c), "")
    return title, "\n".join(out), n, "; ".join(notes)


def read_scenario_rows(data: bytes) -> list[dict[str, str]]:
    """The rows of the first sheet by the names in its first row."""
    for _, _, rows, _ in _sheets(data):
        return [dict(zip(rows[0], [*r, *[""] * len(rows[0])], strict=False)) for r in rows[1:] if any(r)] if rows else []
    return []


def read_record_rows(data: bytes, config: ReadConfig) -> list[tuple[str, str, str]]:
    """(id, body, time) of each row of the first sheet that isn't blank; columns by header, else the first three."""
    for _, _, rows, _ in _sheets(data):
        if not rows:
            return []
        head = rows[0]
        at = [head.index(c) if c in head else i for i, c in enumerate(config.row_columns)]
        body = rows[1:] if any(c in head for c in config.row_columns) else rows
        get = lambda row, i: row[i] if i < len(row) else ""
        return [(get(r, at[0]) or f"row{n:05d}", get(r, at[1]), get(r, at[2])) for n, r in enumerate(body, 1) if any(r)]
    return []


def _pdf(told: str | Pages, there: bool, config: ReadConfig) -> tuple:
    """The columns from title on, of what a backend told of a PDF; only its first pages count."""
    if not isinstance(told, Pages):
        return None, None, told, "", "", "ok" if told else "needs_ocr", "" if there else "no_backend", None, None, None, None
    n = len(told.pages)
    notes = [f"page_truncated={n}->{config.max_pages}"] if n > config.max_pages else []
    texts = []
    for k, page in enumerate(told.pages[: config.max_pages], 1):
        if isinstance(page, Exception):
            notes.append(f"page_{k}_error={page}")
        elif page and page.strip():
            texts.append(page)
    return told.title.strip() or None, None, "\n\n".join(texts), "", "", "ok" if texts else "needs_ocr", "; ".join(notes), None, n, None, None


def _reader(config: ReadConfig, backend: Callable[[bytes, str], str] | None):
    def one(row: dict) -> list[tuple]:
        data, suffix = row["content"], row["suffix"]
        base = tuple(row[c] for c in ("dataset", "file_path", "file_name", "suffix", "size_bytes"))
        none = (None, None, None)
        try:
            if suffix == ".xlsx" and row["dataset"] == config.row_dataset:
                return [(*base, i, None, when, body, "", "", "ok", "", 1, *none) for i, body, when in read_record_rows(data, config)]
            if suffix == ".docx":
                title, text, tables, pictures, notes = read_docx(data, config, backend)
                return [(*base, None, title, None, text, tables, pictures, "ok", notes, None, *none)]
            if suffix in (".xlsx", ".xlsm"):
                title, tables, n, notes = read_xlsx(data, config)
                return [(*base, None, title, None, "", tables, "", "ok", notes, n, *none)]
            if suffix == ".pdf":
                return [(*base, None, *_pdf(backend(data, suffix) if backend else "", backend is not None, config))]
            if suffix in IMAGES:
                size, text, note, status = image_size(data) or (None, None), "", "ocr_unavailable", "needs_ocr"
                if backend:
                    try:
                        text = backend(data, suffix)
                        note, status = ("ocr_used", "ok") if text.strip() else ("ocr_empty", "needs_ocr")
                    except Exception as e:  # the picture is there, its text isn't
                        note = f"ocr_error={e}"[:200]
                return [(*base, None, None, None, "", "", text, status, note, None, None, *size)]
            text, note = decode_text(data)
            known = suffix in (".txt", ".md", ".csv", ".json", ".xml", ".html", ".htm", ".log")
            return [(*base, None, None, None, text, "", "", "ok" if known else "unsupported", note if known else "; ".join(x for x in ("fallback_text", note) if x), None, *none)]
        except Exception as e:  # a broken file is a row with a status, never a failed job
            return [(*base, None, None, None, "", "", "", "error", f"exception={type(e).__name__}: {e}"[:200], None, *none)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string()] * 4 + [pa.int64()] + [pa.string()] * 8 + [pa.int32()] * 4
        names = [c.split()[0] for c in _SCHEMA.split(", ")]
        for batch in batches:
            for i in range(batch.num_rows):  # one file's content at a time
                rows = one({c: batch.column(c)[i].as_py() for c in batch.schema.names})
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[k]) for k in range(len(names))], names)

    return run


def parse_files(files: DataFrame, config: ReadConfig = ReadConfig(), backend: Callable[[bytes, str], str] | None = None) -> DataFrame:
    """Parsed documents of a manifest with content. clean_text holds raw, table and ocr text; only raw and clean text are cut to max_chars."""
    rows = files.select("dataset", "file_path", "file_name", "suffix", "size_bytes", "content").mapInArrow(_reader(config, backend), _SCHEMA)
    raw, table, ocr = (t.normalize(F.col(c)) for c in ("raw_text", "table_text", "ocr_text"))
    rows = rows.withColumns({"raw_text": raw, "table_text": table, "ocr_text": ocr})
    clean = t.normalize(t.join_nonempty("\n\n", F.col("raw_text"), F.col("table_text"), F.col("ocr_text")))
    rows = rows.withColumn("clean_text", clean)
    stem = F.when(F.col("suffix") != "", F.expr("substring(file_name, 1, length(file_name) - length(suffix))")).otherwise(F.col("file_name"))
    is_row = F.col("row_id").isNotNull()
    title = F.when(is_row, t.row_title(F.col("row_id"), F.col("raw_text"))).otherwise(F.coalesce(F.nullif(t.normalize(F.col("title")), F.lit("")), t.title_of(F.col("clean_text"), F.col("file_name"))))
    status = F.when((F.col("clean_text") == "") & F.col("status").isin("ok"), F.when(F.col("suffix") == ".pdf", "needs_ocr").otherwise("empty")).otherwise(F.col("status"))
    cut, truncated = t.truncate(F.col("clean_text"), config.max_chars)
    return rows.select(
        F.concat(F.col("dataset"), F.lit(":"), F.coalesce("row_id", stem)).alias("doc_id"), "dataset", "file_path", "file_name", "suffix", "size_bytes", title.alias("title"),
        t.merge_time_info(F.coalesce("time_info", F.lit("")), t.time_info(F.col("clean_text"))).alias("time_info"),
        F.substring("raw_text", 1, config.max_chars).alias("raw_text"), cut.alias("clean_text"), "table_text", "ocr_text", status.alias("parse_status"), F.concat_ws("; ", F.nullif(F.col("notes"), F.lit("")), F.when(truncated, F.lit(f"truncated_to={config.max_chars}"))).alias("parse_notes"), "page_count", "sheet_count", "image_width", "image_height",
        truncated.alias("content_truncated"), F.length("clean_text").cast("int").alias("char_count"),
    )


def without_cached(files: DataFrame, cache: DataFrame, *key: str) -> DataFrame:
    """Files whose content key isn't in the cache of earlier results: what still needs the backend."""
    return files.join(cache.select(*key).distinct(), list(key), "left_anti")


def parse_with_cache(files: DataFrame, cache: str, backend: Callable[[bytes, str], str], name: str, config: ReadConfig = ReadConfig()) -> DataFrame:
    """Parsed documents, where files that the backend has read before come from the table at ``cache``; what is read now is added to it. files: a manifest with content and modified.
    The key of a file changes with the backend's name, the file's place, size and time."""
    spark = files.sparkSession
    key = F.sha1(F.concat_ws("|", F.lit(name), F.col("file_path"), F.col("size_bytes").cast("string"), F.unix_micros("modified").cast("string")).cast("binary"))
    keyed = files.withColumn("cache_key", key)
    there = spark._jvm.org.apache.hadoop.fs.Path(cache)
    known = spark.read.parquet(cache) if there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there) else None
    todo = keyed if known is None else without_cached(keyed, known, "cache_key")
    fresh = parse_files(todo, config, backend).join(todo.select("file_path", "cache_key"), "file_path")
    fresh.write.mode("append").parquet(cache)
    return spark.read.parquet(cache).join(F.broadcast(keyed.select("cache_key").distinct()) if keyed.count() <= 100_000 else keyed.select("cache_key").distinct(), "cache_key", "left_semi").drop("cache_key")


def union_parsed(*parts: DataFrame) -> DataFrame:
    """Parsed documents of several datasets as one table; columns that a part lacks are null."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out
