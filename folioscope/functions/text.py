"""Text functions as Column expressions: normalising, titles, dates in text, term lists, counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Unicode has it, spelled out: regex engines differ in what \s means.
SPACE = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"
# Han characters, punctuation, and the dates that count, in the order in which they are looked for.
HAN = r"[\x{4e00}-\x{9fff}]"
PUNCTUATION = r"[，。！？；：,.!?;:\-—()（）\[\]{}<>《》“”\"']"
DATE_PATTERNS = (
    r"20\d{2}[年/-]\d{1,2}[月/-]\d{1,2}日?",
    r"20\d{2}[年/-]\d{1,2}[月/-]?",
    r"20\d{2}-\d{2}",
    r"20\d{2}Q[1-4]",
    r"20\d{2}年Q[1-4]",
)
FULL_DATE = r"20\d{2}[年/\-.]\d{1,2}[月/\-.]\d{1,2}日?"
MONEY = r"\d+(?:\.\d+)?\s*(?:亿元|万元|千元|元|人民币|USD|usd|美元)?"
UNITS = {"亿元": 1e8, "万元": 1e4, "千元": 1e3}
# End of fixed values.


#: The same characters one by one.
SPACES = "".join(map(chr, [*range(0x9, 0xE), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACES))


def normalize(text: Column) -> Column:
    """Line ends to LF, runs of blanks to one space, three or more line ends to two, outer white space off; null is empty."""
    x = F.coalesce(text, F.lit(""))
    x = F.replace(F.replace(x, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    x = F.replace(F.replace(x, F.lit("　"), F.lit(" ")), F.lit("\0"), F.lit(""))
    # a space that stands alone is left as it is: most are, and each match costs
    return strip(F.regexp_replace(F.regexp_replace(x, r"[ \t\f\x0b]{2,}|[\t\f\x0b]", " "), r"\n{3,}", "\n\n"))


def truncate(text: Column, most: int) -> tuple[Column, Column]:
    """The first characters, and whether any were cut."""
    return F.substring(text, 1, most), F.length(text) > most


def title_of(text: Column, fallback: Column) -> Column:
    """The first of the first ten non-blank lines with 4 to 120 characters, of which one is a letter; else the fallback."""
    edges = r"^[ \t\-—:：|]+|[ \t\-—:：|]+$"
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), LINE_END), lambda x: strip(x) != "")
    lines = F.slice(F.transform(lines, lambda x: F.regexp_replace(x, edges, "")), 1, 10)
    good = F.filter(lines, lambda x: F.length(x).between(4, 120) & x.rlike(r"[\p{L}\p{N}&&[^0-9]]"))
    return F.coalesce(F.try_element_at(good, F.lit(1)), fallback)


def time_info(text: Column, most: int = 4) -> Column:
    """Distinct dates by pattern, overlapping ones too, joined by '; '."""
    found = F.concat(*(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({p})"), F.lit(1)) for p in DATE_PATTERNS))
    return F.array_join(F.slice(F.array_distinct(found), 1, most), "; ")


def merge_time_info(*values: Column) -> Column:
    parts = F.flatten(F.array(*(F.transform(F.split(F.coalesce(v, F.lit("")), r"[;；]\s*"), strip) for v in values)))
    return F.array_join(F.array_distinct(F.filter(parts, lambda x: x != "")), "; ")


def strip_tags(text: Column) -> Column:
    """Tags off, then the five XML entities in the order lt, gt, amp, quot, apos, then normalised."""
    x = F.regexp_replace(F.coalesce(text, F.lit("")), "<[^>]+>", "")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"), ("&quot;", '"'), ("&apos;", "'")):
        x = F.replace(x, F.lit(entity), F.lit(char))
    return normalize(x)


def split_terms(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), rf"[、,，;；/|\\{SPACE}]+"), lambda x: x != "")


def _distinct(terms: Sequence[str]) -> list[str]:
    return list(dict.fromkeys(t for t in terms if t))


def contained(text: Column, terms: Sequence[str], any_case: bool = False, lowered: bool = False) -> Column:
    """The distinct terms that the text contains, in the lexicon's order. Occurrences don't count. ``lowered``: the text is in lower case already."""
    where = F.lower(text) if any_case and not lowered else text
    found = [F.when(F.contains(where, F.lit(x.lower() if any_case else x)), F.lit(x)) for x in _distinct(terms)]
    return F.array_compact(F.array(*found)) if found else F.array().cast("array<string>")


def hits(text: Column, terms: Sequence[str], any_case: bool = False, lowered: bool = False) -> Column:
    """How many distinct terms the text contains: a sum of conditions, which compiles to straight code."""
    where = F.lower(text) if any_case and not lowered else text
    total = F.lit(0).cast("long")
    for x in _distinct(terms):
        total = total + F.when(F.contains(where, F.lit(x.lower() if any_case else x)), 1).otherwise(0)
    return total


def let(value: Column, body) -> Column:
    """body(value) with the value computed once, however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def keyword_score(text: Column, terms: Sequence[str], normalized: bool = False, lowered: bool = False) -> Column:
    return F.least(F.lit(1.0), hits(text if normalized else normalize(text), terms, True, lowered) / F.lit(4.0))


def count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("long")


def count_chars(text: Column, one: str) -> Column:
    """How many characters are of a kind. one: a pattern of one character. What is left without whole runs of them tells it; a match for each character would be a string for each."""
    return (F.length(text) - F.length(F.regexp_replace(text, f"(?:{one})+", ""))).cast("long")


def latin_ratio(text: Column) -> Column:
    return F.when(F.length(text) > 0, count_chars(text, "[A-Za-z]") / F.length(text)).otherwise(0.0)


def ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, F.round(part / whole, 6)).otherwise(0.0)


def safe_double(value: Column) -> Column:
    return F.coalesce(value.cast("string").try_cast("double"), F.lit(0.0))


def safe_int(value: Column) -> Column:
    return F.coalesce(value.cast("string").try_cast("double").try_cast("long"), F.lit(0).cast("long"))


def money_values(text: Column, normalized: bool = False) -> Column:
    """Each number above 0, times its unit. The unit is optional, so any number is money."""
    found = F.regexp_extract_all(text if normalized else normalize(text), F.lit(f"({MONEY})"), F.lit(1))
    number = lambda x: F.regexp_extract(x, r"^\d+(?:\.\d+)?", 0).cast("double")

    def scaled(x: Column) -> Column:
        out = number(x)
        for unit, times in UNITS.items():
            out = F.when(F.endswith(x, F.lit(unit)), number(x) * times).otherwise(out)
        return out

    return F.filter(F.transform(found, scaled), lambda v: v > 0)


def money_score(values: Column) -> Column:
    return F.coalesce(F.when(F.size(values) > 0, F.least(F.lit(1.0), F.log10(F.array_max(values) + 1) / 8)), F.lit(0.0))


def date_urgency(text: Column, as_of: Column) -> Column:
    """By the nearest full date that isn't past: 1.0 up to a day ahead, 0.8 a week, 0.5 thirty days, else 0.2; none 0."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({FULL_DATE})"), F.lit(1))
    part = lambda x, k: F.regexp_extract(x, r"(20\d{2})[年/\-.](\d{1,2})[月/\-.](\d{1,2})", k)
    dates = F.transform(found, lambda x: F.try_to_timestamp(F.concat_ws("-", part(x, 1), part(x, 2), part(x, 3)), F.lit("yyyy-M-d")).cast("date"))
    days = F.array_min(F.filter(F.transform(dates, lambda d: F.datediff(d, as_of)), lambda n: n >= 0))
    return let(days, lambda d: F.when(d.isNull(), 0.0).when(d <= 1, 1.0).when(d <= 7, 0.8).when(d <= 30, 0.5).otherwise(0.2))


def row_title(file_id: Column, body: Column) -> Column:
    snippet = F.replace(normalize(body), F.lit("\n"), F.lit(" "))
    snippet = F.when(F.length(snippet) > 64, F.concat(F.substring(snippet, 1, 64), F.lit("..."))).otherwise(snippet)
    return strip(F.concat(file_id, F.lit(" "), snippet))


def join_nonempty(separator: str, *parts: Column) -> Column:
    return F.concat_ws(separator, *(F.when(p != "", p) for p in parts))


def tokens(text: Column, stopwords: Sequence[str] = ()) -> Column:
    """Lower-cased runs of letters, digits and underscores of two characters or more that aren't digits only. A segmenter for Han text may take this function's place."""
    # the run must have a Latin or Han letter ahead: tested once at its begin, not in each token again
    found = F.regexp_extract_all(F.lower(text), F.lit(r"(?=[\p{L}\p{N}_]*?[a-z\x{4e00}-\x{9fff}])[\p{L}\p{N}_]{2,}"), F.lit(0))
    if not stopwords:
        return found
    stop = F.array(*(F.lit(s) for s in stopwords))
    return F.filter(found, lambda t: ~F.array_contains(stop, t))
