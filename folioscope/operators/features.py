"""Line filter, analysis text and the feature row of a document."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions import lexicons
from folioscope.functions import text as t

FIELDS = ("title", "time_info", "clean_text", "table_text", "ocr_text")


def template_pattern(meta: Sequence[str] = lexicons.META_PREFIXES) -> str:
    """Lines that are template by their form alone, as one pattern: empty, an address of the web or of mail, a field of a page's head, too short, or nothing but marks and Latin letters."""
    head = "|".join(meta)
    return rf"^(?:(?:(?i:https?://|www\.)\S+|[^@\s]+@[^@\s]+\.[^@\s]+|[^\x{{4e00}}-\x{{9fff}}A-Za-z]{{0,2}}|{lexicons.MARKS_ONLY}{{0,24}})$|(?:{head})[:：])"


def is_template_line(line: Column, hints: Sequence[str] = lexicons.TEMPLATE_HINTS, meta: Sequence[str] = lexicons.META_PREFIXES) -> Column:
    """Lines of a site or form rather than of the document. Hints that contain each other count each. One pattern and one count of hints a line."""
    n = t.hits(line, hints)
    hinted = F.when(F.length(line) > 20, n >= 2).otherwise((n >= 1) & ((n >= 2) | ~line.rlike(r"[\x{4e00}-\x{9fff}]{4,}")))
    return line.rlike(template_pattern(meta)) | hinted


def first_of_each(lines: Column) -> Column:
    """The first line of each that are equal in lower case, in order. One sort of (key, place) pairs, so linear memory and no nested scan."""
    numbered = F.array_sort(F.transform(lines, lambda x, i: F.struct(F.lower(x).alias("key"), i.alias("at"), x.alias("line"))))
    fresh = t.let(numbered, lambda all_: F.filter(all_, lambda x, i: (i == 0) | (x["key"] != F.get(all_, F.greatest(i - 1, F.lit(0)))["key"])))
    return F.transform(F.array_sort(F.transform(fresh, lambda x: F.struct(x["at"].alias("at"), x["line"].alias("line")))), lambda x: x["line"])


def clean_lines(text: Column, hints: Sequence[str] = lexicons.TEMPLATE_HINTS) -> Column:
    """A normalised text without template and repeated lines."""
    lines = F.transform(F.split(text, t.LINE_END), t.strip)  # the text is normalised: all that is left to do for a line
    kept = F.filter(lines, lambda x: ~is_template_line(x, hints))
    return t.normalize(F.array_join(first_of_each(kept), "\n"))


def analysis_text(df: DataFrame, hints: Sequence[str] = lexicons.TEMPLATE_HINTS, normalized: bool = False) -> Column:
    """All text fields, joined by blank lines, without template and repeated lines; uncleaned if nothing is left. ``normalized``: the fields are already."""
    merged = t.normalize(t.join_nonempty("\n\n", *(df[f] if normalized else t.normalize(df[f]) for f in FIELDS)))
    return t.let(merged, lambda m: t.let(clean_lines(m, hints), lambda c: F.when(c != "", c).otherwise(m)))


def spread(df: DataFrame) -> DataFrame:
    """The same rows, dealt out to all cores where the input has fewer partitions than those (a file of one row group is one task). Large tables stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def as_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", dataset_col: str = "source") -> DataFrame:
    """A table of texts in the shape of parsed documents; all text fields are normalised."""
    rows = df.select(df[id_col].alias("doc_id"), df[dataset_col].alias("dataset"), t.normalize(df[text_col]).alias("text"))  # once: used by several columns below
    text, empty = F.col("text"), F.lit("")
    return rows.select(
        "doc_id", "dataset", t.title_of(text, empty).alias("title"), t.time_info(text).alias("time_info"), text.alias("raw_text"), text.alias("clean_text"),
        empty.alias("table_text"), empty.alias("ocr_text"), F.when(F.length(text) == 0, "empty").otherwise("ok").alias("parse_status"), F.lit(".txt").alias("suffix"), F.lit(False).alias("content_truncated"),
    )


def feature_rows(docs: DataFrame, words: Mapping[str, Sequence[str]] = lexicons.FEATURES, hints: Sequence[str] = lexicons.TEMPLATE_HINTS, normalized: bool = False) -> DataFrame:
    """The feature row of each parsed document: lengths, line and character counts, ratios, flags, lexicon hits and signals, and the analysis text."""
    clean = docs if normalized else docs.withColumns({f: t.normalize(docs[f]) for f in (*FIELDS, "raw_text")})
    clean = clean.withColumn("analysis_text", analysis_text(clean, hints, normalized=True))
    clean = clean.withColumn("combined", t.normalize(t.join_nonempty("\n\n", F.col("title"), F.col("analysis_text"))))
    c, size = F.col("combined"), F.length("combined")
    length = lambda f: F.length(f).cast("long")
    lines = t.count(c, "\n")
    chars = {"chinese": t.HAN, "latin": "[A-Za-z]", "digit": r"\p{Nd}", "punctuation": t.PUNCTUATION, "whitespace": f"[{t.SPACE}]"}
    counted = clean.withColumns({f"{k}_count": t.count_chars(c, p) for k, p in chars.items()} | {f"{k}_keyword_hits": t.hits(c, w) for k, w in words.items()})
    return counted.select(
        "doc_id", "dataset", F.lower("suffix").alias("suffix"), "parse_status", "content_truncated",
        *(length(f).alias(n) for f, n in (("title", "title_len"), ("time_info", "time_info_len"), ("raw_text", "raw_len"), ("clean_text", "clean_len"), ("table_text", "table_len"), ("ocr_text", "ocr_len"), ("analysis_text", "analysis_len"))),
        F.when(size > 0, lines + 1).otherwise(0).alias("line_count"),
        F.when(size > 0, t.count(c, "\n\n") + 1).otherwise(0).alias("paragraph_count"),
        t.count_chars(c, "[。！？!?;；]").alias("sentence_count"),
        *(f"{k}_count" for k in chars),
        *(t.ratio(F.col(f"{k}_count"), size).alias(f"{k}_ratio") for k in ("chinese", "latin", "digit", "punctuation")),
        *(F.when(F.length(f) > 0, 1).otherwise(0).alias(n) for f, n in (("title", "has_title"), ("time_info", "has_time_info"), ("table_text", "has_table"), ("ocr_text", "has_ocr_text"))),
        *(f"{k}_keyword_hits" for k in words),
        *(F.when(F.col(f"{k}_keyword_hits") > 0, 1).otherwise(0).alias(f"{k}_signal") for k in words),
        "analysis_text",
    )
