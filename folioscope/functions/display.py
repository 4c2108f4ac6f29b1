"""Values as a reader sees them: counts, scores, shares, escaped text, labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What states and buckets are called.
LABELS = {
    "assigned": "已归类", "multi_class": "多类待判", "unclassifiable": "无法归类", "auto_archive": "自动归档", "review_if_capacity": "容量允许复核", "must_review": "必须复核",
    "high": "高", "medium": "中", "low": "低", "pending": "待处理", "confirmed": "已确认", "changed": "已改类", "rejected": "已驳回", "noise": "噪声无效", "uncertain": "暂不确定",
}
# End of fixed values.


def number(value: Column) -> Column:
    """As a double; what is no finite number is 0."""
    x = value.cast("string").try_cast("double")
    return F.when(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")), x).otherwise(0.0)


def whole(value: Column) -> Column:
    """Rounded to a whole number, thousands apart; halves go up."""
    return F.format_number(F.floor(number(value) + 0.5), 0)


def score(value: Column) -> Column:
    return F.format_string("%.3f", number(value))


def percent(value: Column) -> Column:
    return F.format_string("%.1f%%", number(value) * 100)


def escaped(value: Column) -> Column:
    x = F.coalesce(value.cast("string"), F.lit(""))
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#039;")):
        x = F.replace(x, F.lit(char), F.lit(entity))
    return x


def label(value: Column) -> Column:
    """The name of a state; other values stay, blank ones are a dash."""
    out = F.coalesce(F.nullif(value, F.lit("")), F.lit("-"))
    for key, name in LABELS.items():
        out = F.when(value == key, F.lit(name)).otherwise(out)
    return out
