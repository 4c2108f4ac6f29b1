"""Joins and reports over documents, features, classifications and reviews."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions import text as t


def fresh(df: DataFrame, name: str) -> str:
    """The name, with underscores before it until it is none of the table's."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def merge_left(left: DataFrame, right: DataFrame, key: str, precedence_blank: bool = False) -> DataFrame:
    """Left join in which the right side's columns take the place of the left's of the same name, where the right has a row (precedence_blank) or a value.
    The right side must have one row per key (see classify.last_of_each)."""
    own = right.withColumnsRenamed({c: f"__r_{c}" for c in right.columns}).withColumn("__hit", F.lit(True))
    both = left.join(own, left[key] == own[f"__r_{key}"], "left")
    cols = []
    for c in dict.fromkeys([*left.columns, *right.columns]):
        if c == key or c not in right.columns:
            cols.append(left[c])
        elif c not in left.columns:
            cols.append(F.col(f"__r_{c}").alias(c))
        elif precedence_blank:
            cols.append(F.when(F.col("__hit"), F.col(f"__r_{c}")).otherwise(left[c]).alias(c))
        else:
            cols.append(F.coalesce(F.col(f"__r_{c}"), left[c]).alias(c))
    return both.select(*cols)


def matches(filters: Mapping[str, object], least: Mapping[str, float] | None = None, most: Mapping[str, float] | None = None) -> Column:
    """Equalities (or membership, for a list or set of values), lower and upper bounds together; a blank value filters nothing, text that isn't a number counts as 0."""
    out = F.lit(True)
    for c, v in filters.items():
        if isinstance(v, (list, tuple, set, frozenset)):
            out = out & F.col(c).cast("string").isin(*map(str, v))
        elif v not in (None, ""):
            out = out & (F.col(c).cast("string") == str(v))
    for c, v in (least or {}).items():
        out = out & (t.safe_double(F.col(c)) >= v)
    for c, v in (most or {}).items():
        out = out & (t.safe_double(F.col(c)) <= v)
    return F.coalesce(out, F.lit(False))


def found(columns: Sequence[str], query: str) -> Column:
    """Whether the columns, joined by spaces, contain the query in any case."""
    text = F.concat_ws(" ", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns))
    return F.contains(F.lower(text), F.lit(query.lower()))


def count_by(df: DataFrame, column: str, blank: str = "未标注", name: str = "n") -> DataFrame:
    return df.groupBy(F.coalesce(F.nullif(F.col(column).cast("string"), F.lit("")), F.lit(blank)).alias("value")).agg(F.count(F.lit(1)).alias(name))


def group_count(df: DataFrame, *keys: str, most: int | None = None) -> DataFrame:
    out = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), *keys)
    return out.limit(most) if most else out


def unique_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(t.strip(F.coalesce(F.col(column).cast("string"), F.lit(""))).alias("value")).filter("value <> ''").distinct()


def page(df: DataFrame, number: int, *order: Column | str, size: int = 25) -> DataFrame:
    """One page of a total order; pages beyond either end are the first and the last."""
    n = df.count()
    last = max(1, -(-n // size))
    return df.orderBy(*order).offset((min(max(1, number), last) - 1) * size).limit(size)


def length_bin(length: Column) -> Column:
    return F.when(length <= 0, "0").when(length < 80, "1-79").when(length < 300, "80-299").otherwise("300+")


def top_and_other(df: DataFrame, column: str, by: str, most: int = 8, other: str = "other") -> DataFrame:
    """Counts of the most frequent values and of all others together, by another column."""
    top = df.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), column).limit(most).select(F.col(column).alias("__top"))
    named = df.join(F.broadcast(top), F.col(column) == F.col("__top"), "left").withColumn("bucket", F.coalesce("__top", F.lit(other)))
    return named.groupBy("bucket", by).agg(F.count(F.lit(1)).alias("n"))


def nested_counts(df: DataFrame, parent: str, child: str, most: int = 8) -> DataFrame:
    """Counts of children within the parent that has the most rows."""
    largest = df.groupBy(parent).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), parent).limit(1).select(F.col(parent).alias("__p"))
    return df.join(F.broadcast(largest), F.col(parent) == F.col("__p")).groupBy(parent, child).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), child).limit(most)


def histogram(df: DataFrame, column: str, edges: Sequence[float]) -> DataFrame:
    """Counts by the half-open bin [edge, next edge); the last bin has its upper edge too."""
    edges = sorted(edges)
    bin_ = F.lit(None).cast("int")
    for k in range(len(edges) - 1):
        upper = F.col(column) <= edges[k + 1] if k == len(edges) - 2 else F.col(column) < edges[k + 1]
        bin_ = F.when((F.col(column) >= edges[k]) & upper, k).otherwise(bin_)
    return df.groupBy(bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n")).filter("bin is not null")


def before_after(before: DataFrame, after: DataFrame, metric: str, value: str) -> DataFrame:
    b = before.select(F.col(metric).alias("metric"), F.col(value).alias("before"))
    a = after.select(F.col(metric).alias("metric"), F.col(value).alias("after"))
    both = b.join(a, "metric", "full")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return both.select("metric", zero("before"), zero("after"), (F.coalesce("after", F.lit(0)) - F.coalesce("before", F.lit(0))).alias("delta"))


def review_status(log_status: Column, manual: Column | None = None) -> Column:
    """The newest log's status, else the decision in the audit sheet (if there is one), else pending."""
    parts = [log_status, *([F.nullif(manual, F.lit(""))] if manual is not None else [])]
    return F.coalesce(*parts, F.lit("pending"))


def with_review(rows: DataFrame, log: DataFrame, key: str, manual: str | None = None) -> DataFrame:
    """Adds review_local_status. log: key and status, one row a document (see priority.latest_review)."""
    status, other = fresh(rows, "log_status"), fresh(rows, "log_key")
    newest = log.select(F.col(key).alias(other), F.col("status").alias(status))
    both = rows.join(newest, rows[key] == newest[other], "left")
    return both.withColumn("review_local_status", review_status(F.col(status), F.col(manual) if manual else None)).drop(status, other)


def audit_view(audit: DataFrame, parsed: DataFrame, classification: DataFrame, priority: DataFrame, log: DataFrame, key: str = "doc_id") -> DataFrame:
    """The audit sample with what all stages tell of its documents: parsed, then classification, then priority, then the sample's own columns take precedence where they have a row,
    blank values too. The title falls back to the file's name and the document's id. All sides but the sample have one row a document."""
    rows = audit.select(key)
    for side in (parsed, classification, priority, audit):
        rows = merge_left(rows, side, key, precedence_blank=True)
    blank = lambda c: F.nullif(F.col(c).cast("string"), F.lit("")) if c in rows.columns else F.lit(None).cast("string")
    rows = rows.withColumn("title", F.coalesce(blank("title_snippet"), blank("title"), blank("file_name"), blank(key)))
    return with_review(rows, log, key, "manual_decision" if "manual_decision" in rows.columns else None)


def first_found(key: str, *tables: tuple[str, DataFrame]) -> DataFrame:
    """(key, found_in): for each document, the first of the named tables that has it."""
    sides = [df.select(key).withColumn("at", F.lit(i)) for i, (_, df) in enumerate(tables)]
    union = sides[0]
    for side in sides[1:]:
        union = union.unionByName(side)
    names = F.array(*(F.lit(n) for n, _ in tables))
    return union.groupBy(key).agg(F.min("at").alias("at")).select(key, F.get(names, F.col("at")).alias("found_in"))


def dynamic_order(column: str, descending: bool = False, collation: str = "zh") -> list[Column]:
    """An order for a column of mixed text: numbers by value, before or after all other text by collation. (A pairwise comparison of numbers with other text has no
    consistent order; here they are apart.)"""
    text = F.coalesce(F.col(column).cast("string"), F.lit(""))
    number = F.when(F.trim(text) == "", 0.0).otherwise(text.try_cast("double"))
    finite = number.isNotNull() & ~F.isnan(number) & (F.abs(number) < float("inf"))
    parts = [F.when(finite, 0).otherwise(1), F.when(finite, number), F.when(~finite, F.collate(text, collation))]
    return [p.desc() if descending else p.asc() for p in parts]


def file_type(dataset: Column, file_name: Column, row_dataset: str = "dataset3") -> Column:
    """docx, txt or another format by the name's suffix; records of sheets by their dataset."""
    suffix = F.lower(F.regexp_extract(file_name, r"[^.]\.([^.]+)$", 1))
    return F.when(dataset == row_dataset, "xlsx 行记录").when(suffix.isin("docx", "txt"), suffix).otherwise("其他格式")


def audit_kpis(classification: DataFrame, queue: DataFrame) -> DataFrame:
    """One row: documents, and those to review; where no row is flagged, the length of the queue counts."""
    told = classification.agg(F.count(F.lit(1)).alias("documents"), F.count_if(F.col("review_flag") == 1).alias("flagged"))
    length = queue.agg(F.count(F.lit(1)).alias("queue_length"))
    return told.join(F.broadcast(length)).select("documents", "queue_length", F.when(F.col("flagged") > 0, F.col("flagged")).otherwise(F.col("queue_length")).alias("review_count"))


def register(spark, tables: Mapping[str, DataFrame]) -> None:
    """Each table as a temporary view of its name."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)


def first_rows(df: DataFrame, n: int, *order: Column | str) -> DataFrame:
    """The first n rows in a total order."""
    return df.orderBy(*order).limit(n)
