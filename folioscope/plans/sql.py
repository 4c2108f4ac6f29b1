"""SQL pieces for the checks: the text functions again, in the other engine's dialect."""

from __future__ import annotations

from folioscope.functions import lexicons
from folioscope.functions import text as t


def lit(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^[{t.SPACE}]+|[{t.SPACE}]+$', '', 'g')"


def norm(x: str) -> str:
    x = f"replace(replace(replace(coalesce({x}, ''), chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(12288), ' ')"
    return strip(rf"regexp_replace(regexp_replace({x}, '[ \t\f\x0b]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g')")


def contained(x: str, words, any_case: bool = False) -> str:
    return f"list_filter({lit(dict.fromkeys(words))}, lambda w: contains({f'lower({x})' if any_case else x}, {'lower(w)' if any_case else 'w'}))"


def hits(x: str, words, any_case: bool = False) -> str:
    return f"len({contained(x, words, any_case)})"


def tokens(x: str) -> str:
    return rf"list_filter(regexp_extract_all(lower({x}), '[\p{{L}}\p{{N}}_]{{2,}}'), lambda w: regexp_matches(w, '[a-z]|[\x{{4e00}}-\x{{9fff}}]'))"


def split_terms(x: str) -> str:
    return rf"list_filter(string_split_regex({x}, '[、,，;；/|\\{t.SPACE}]+'), lambda x: x <> '')"


def once(x: str) -> str:
    """Each element of a list at its first place."""
    return f"list_filter({x}, lambda x, i: list_position({x}, x) = i)"


def count(x: str, pattern: str) -> str:
    return f"len(regexp_extract_all({x}, '{pattern.replace(chr(39), chr(39) * 2)}'))"


def lines(x: str) -> str:
    return rf"string_split_regex({x}, '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{{85}}\x{{2028}}\x{{2029}}]')"


def title(x: str) -> str:
    edges = r"'^[ \t\-—:：|]+|[ \t\-—:：|]+$'"
    first = rf"list_slice(list_transform(list_filter({lines(f'coalesce({x}, chr(32))')}, lambda y: {strip('y')} <> ''), lambda y: regexp_replace(y, {edges}, '', 'g')), 1, 10)"
    return rf"coalesce(list_filter({first}, lambda y: len(y) BETWEEN 4 AND 120 AND regexp_matches(y, '\p{{L}}'))[1], '')"


def time_info(x: str) -> str:
    found = ", ".join(f"regexp_extract_all({x}, '{p}')" for p in t.DATE_PATTERNS)
    flat = f"flatten([{found}])"
    return f"array_to_string(list_slice(list_filter({flat}, lambda y, i: list_position({flat}, y) = i), 1, 4), '; ')"


def template(y: str, hints) -> str:
    n = hits(y, hints)
    return (
        rf"({y} = '' OR regexp_matches({y}, '(?i)^(?:https?://|www\.)\S+$') OR regexp_matches({y}, '^[^@\s]+@[^@\s]+\.[^@\s]+$')"
        rf" OR regexp_matches({y}, '^(?:{'|'.join(lexicons.META_PREFIXES)})[:：]') OR (len({y}) <= 2 AND NOT regexp_matches({y}, '[\x{{4e00}}-\x{{9fff}}A-Za-z]'))"
        rf" OR (len({y}) <= 24 AND regexp_matches({y}, '^{lexicons.MARKS_ONLY}*$')) OR {n} >= 2 OR ({n} >= 1 AND len({y}) <= 20 AND NOT regexp_matches({y}, '[\x{{4e00}}-\x{{9fff}}]{{4,}}')))"
    )


def documents(hints) -> str:
    """CTEs d (doc_id, source, lang, text, title, info), a (… and body, the analysis text)."""
    return rf"""
n AS (SELECT doc_id, source, lang, {norm('text')} AS text FROM documents),
d AS (SELECT *, {title('text')} AS title, {time_info('text')} AS info FROM n),
m AS (SELECT *, {norm("concat_ws(chr(10) || chr(10), nullif(title, ''), nullif(info, ''), nullif(text, ''))")} AS merged FROM d),
l AS (SELECT *, list_filter(list_transform({lines('merged')}, lambda y: {norm('y')}), lambda y: NOT {template('y', hints)}) AS kept FROM m),
k AS (SELECT *, list_transform(kept, lambda y: lower(y)) AS keys FROM l),
a AS (SELECT doc_id, source, lang, text, title, info, merged, kept, coalesce(nullif({norm("array_to_string(list_filter(kept, lambda y, i: list_position(keys, lower(y)) = i), chr(10))")}, ''), merged) AS body FROM k)"""


def money(x: str) -> str:
    found = f"regexp_extract_all({norm(x)}, '{t.MONEY}')"
    value = r"CAST(regexp_extract(y, '^\d+(?:\.\d+)?') AS DOUBLE) * (CASE " + " ".join(f"WHEN y LIKE '%{u}' THEN {n:g}" for u, n in t.UNITS.items()) + " ELSE 1 END)"
    return f"list_filter(list_transform({found}, lambda y: {value}), lambda v: v > 0)"


def money_score(values: str) -> str:
    return f"(CASE WHEN len({values}) > 0 THEN least(1.0, log10(list_max({values}) + 1) / 8) ELSE 0.0 END)"


def urgency(x: str, as_of: str) -> str:
    found = f"regexp_extract_all({x}, '{t.FULL_DATE}')"
    part = lambda k: rf"regexp_extract(y, '(20\d{{2}})[年/\-.](\d{{1,2}})[月/\-.](\d{{1,2}})', {k})"
    day = f"try_cast({part(1)} || '-' || lpad({part(2)}, 2, '0') || '-' || lpad({part(3)}, 2, '0') AS DATE)"
    days = f"list_min(list_filter(list_transform({found}, lambda y: date_diff('day', {as_of}, {day})), lambda v: v >= 0))"
    return f"CASE WHEN {days} IS NULL THEN 0.0 WHEN {days} <= 1 THEN 1.0 WHEN {days} <= 7 THEN 0.8 WHEN {days} <= 30 THEN 0.5 ELSE 0.2 END"


def keyword_score(x: str, words) -> str:
    return f"least(1.0, {hits(x, words, True)} / 4.0)"


def rule(r, title_: str, body: str, prior: str, latin: str | None = None) -> str:
    """Score of a rule, 0 where it doesn't apply."""
    words = r.prior_words if r.prior_words is not None else (*r.title_words, *r.body_words)
    a, b, c = hits(title_, r.title_words, True), hits(body, r.body_words, True), hits(prior, words, True)
    score = f"({a} * {r.title_weight} + {b} * {r.body_weight} + {c} * {r.prior_weight}"
    for p in r.patterns:
        score += f" + (CASE WHEN regexp_matches({title_}, '(?i){p}') THEN 2.0 ELSE 0.0 END)"
    bonus = f"{latin} >= {r.latin_bonus}" if r.latin_bonus and latin else "false"
    score += f" + (CASE WHEN {bonus} THEN 2.0 ELSE 0.0 END)) * {r.boost}"
    ok = f"({a} + {b} > 0 OR {bonus})" if r.needs_content else "true"
    if r.generic:
        ok += f" AND len(list_filter(list_concat({contained(title_, r.title_words, True)}, {contained(body, r.body_words, True)}), lambda w: NOT list_contains({lit(r.generic)}, w))) > 0"
    return f"(CASE WHEN {ok} THEN round(CAST({score} AS DOUBLE), 6) ELSE 0.0 END)"


def best_rule(rules, title_: str, body: str, prior: str, latin: str | None = None) -> str:
    """{s, i}: the highest score and the number (from 0) of the first rule that has it; i is -1 if none applies."""
    scores = "[" + ", ".join(rule(r, title_, body, prior, latin) for r in rules) + "]"
    return f"(SELECT CASE WHEN list_max(q) > 0 THEN {{'s': list_max(q), 'i': list_position(q, list_max(q)) - 1}} ELSE {{'s': 0.0, 'i': -1}} END FROM (SELECT {scores} AS q))"
