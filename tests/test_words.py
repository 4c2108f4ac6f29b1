"""One pass for all rule words, the segmenter and the discovery of words, against plain Python."""

import math
import random
import re
from collections import Counter
from itertools import product

import pytest
from pyspark.sql import functions as F

from folioscope.functions import text as t
from folioscope.operators import matcher, prototypes, rules, segment, topics

RULES = [
    rules.Rule("财政", ("预算", "财政", "财政收入", "GDP", "gdp"), ("预算", "收入", "a"), None, 2.4, 0.85, 0.3, 1.2, evidence=(1, 2, 1)),
    rules.Rule("教育", ("大学", "学", "研究生", "research"), ("研究", "Research", "学"), ("教育",), 2.4, 1.0, 0.05, 1.0, ("abstract|大.", "x{2}"), True, 0.5, ("学", "研究")),
    rules.Rule("empty"),
    rules.Rule("通用", ("", "项目", "项目"), ("工作", "项目"), (), 1.0, 1.0, 1.0, 1.0, generic=("项目",), needs_content=True),
    rules.Rule("pattern", patterns=(r"\d{3}",)),
    rules.Rule("inner", ("bc", "abcd", "b", "abcde"), ("cd",), ("e",), 1.0, 0.5, 0.25),
]
TEXTS = ["", None, "财政预算与财政收入 GDP 报告", "大学研究生 RESEARCH abstract", "项目", "项目 工作", "xabcdex", "ABCDE 123", "学学学", "教育研究 Research 12", "gdp a", "İstanbul ẞ GDP"]


def test_one_pass_scores_like_single_searches(spark):
    rows = [(k, *x) for k, x in enumerate(product(TEXTS, TEXTS, ("", None, "教育 预算 e")))]
    df = spark.createDataFrame(rows, "id int, title string, body string, prior string")
    texts = [F.col(c) for c in ("title", "body", "prior")]
    latin = F.coalesce(t.latin_ratio(F.col("title")), F.lit(0.0))
    df = df.withColumn("found", matcher.match_rules(RULES, *texts)).withColumn("latin", latin)
    out = df.select("id", rules.ranked(RULES, *texts, F.col("latin")).alias("each"), rules.ranked(RULES, *texts, F.col("latin"), F.col("found")).alias("once")).collect()
    assert len(out) == len(rows) and all(r.each == r.once for r in out)
    assert sum(len(r.each) > 0 for r in out) > len(out) / 2


def test_children_in_one_pass(spark):
    kinds = {"p": RULES[:3], "q": RULES[3:]}
    rows = [(k, p, x, y) for k, (p, x, y) in enumerate(product("pqr", TEXTS[2:], TEXTS[2:6]))]
    df = spark.createDataFrame(rows, "id int, parent string, title string, body string")
    parent, title, body = (F.col(c) for c in ("parent", "title", "body"))
    df = df.withColumn("found", rules.match_children(kinds, parent, F.lit("预算"), title, body))
    plain, once = (rules.child_label(kinds, {"r": "rest"}, parent, F.lit("预算"), title, body, found) for found in (None, F.col("found")))
    assert all(r[0] == r[1] for r in df.select(plain, once).collect())


def test_many_words(spark):
    rng = random.Random(1)
    words = ["".join(rng.choices("天地人和 ab", k=rng.randrange(1, 5))) for _ in range(3000)]
    own = matcher.Words(words)
    for _ in range(50):
        text = "".join(rng.choices("天地人和 abc", k=200))
        assert own.within(text) == {k for w, k in own.numbers.items() if w in text}
    assert matcher.Words([]).within("x") == set()


def test_rules_file_and_one_pass(spark, tmp_path):
    import json

    (tmp_path / "rules.jsonl").write_text("\n".join(json.dumps({"ord": k, **{f: v for f, v in r.__dict__.items() if v is not None}}) for k, r in reversed(list(enumerate(RULES)))))
    loaded = rules.load_rules(spark, str(tmp_path / "rules.jsonl"))
    assert loaded == RULES
    df = spark.createDataFrame([("财政预算", "大学", "教育")], "a string, b string, c string").withColumn("found", matcher.match_rules(loaded, *map(F.col, "abc")))
    once, each = df.select(rules.ranked(loaded, *map(F.col, "abc"), found=F.col("found")), rules.ranked(RULES, *map(F.col, "abc"))).first()
    assert once == each and [x.name for x in once] == ["财政"]  # a generic word alone doesn't make the second rule apply


def paths(run):
    """All cuts of a short run."""
    if not run:
        yield []
    for k in range(1, len(run) + 1):
        for rest in paths(run[k:]):
            yield [run[:k], *rest]


def test_segmenter_takes_the_best_of_all_cuts():
    rng = random.Random(2)
    for _ in range(60):
        words = {"".join(rng.choices("天地人和", k=rng.randrange(1, 4))): rng.randrange(1, 50) for _ in range(rng.randrange(0, 12))}
        own = segment.Segmenter(words)
        weigh = lambda p: sum(own.weights[w] if w in own.weights else own.least if len(w) == 1 else -math.inf for w in p)  # noqa: B023, E731
        run = "".join(rng.choices("天地人和", k=rng.randrange(1, 9)))
        got = own.han(run)
        assert "".join(got) == run and math.isclose(weigh(got), max(map(weigh, paths(run))), abs_tol=1e-9)


def test_segments_and_tokens(spark):
    words = {"北京": 10, "大学": 10, "北京大学": 8, "研究": 5, "研究生": 4, "生命": 5, "通知": 9}
    assert segment.Segmenter(words).cut("北京大学2024年研究生命 abc_1!通知") == ["北京大学", "2024", "年", "研究", "生命", "abc_1", "通知"]
    rows = [(1, "北京大学 研究生命，通知 ABC 的 12"), (2, None), (3, ""), (4, "无词可查")]
    df = spark.createDataFrame(rows, "id int, text string")
    out = {r[0]: r[1] for r in df.select("id", segment.han_tokens(words)(F.col("text"))).collect()}
    assert out == {1: ["北京大学", "研究", "生命", "abc"], 2: [], 3: [], 4: []}
    assert [r[0] for r in df.filter("id = 1").select(segment.segmented(F.col("text"), {})).collect()] == [[*"北京大学研究生命通知", "ABC", "的", "12"]]
    weights = topics.tfidf(df, "id", segment.han_tokens(words)(F.col("text")), min_df=1, max_df=1.0).collect()
    assert {r.term for r in weights} == {"北京大学", "研究", "生命", "abc"}
    with pytest.raises(ValueError, match="at most"):
        segment.segmented(F.col("text"), dict.fromkeys(range(segment.MOST_WORDS + 1), 1))


def test_classifier_takes_a_segmenter(spark):
    """Han documents without blanks fall to the prototypes whose words they share."""
    tokens = segment.han_tokens({"财政": 5, "预算": 5, "大学": 5, "教师": 5, "收入": 5, "课程": 5})
    rows = [(k, "财政预算收入" * 3 if k % 2 else "大学教师课程" * 3) for k in range(8)]
    records = spark.createDataFrame(rows, "doc_id int, analysis_text string")
    own = spark.createDataFrame([(k, k % 2) for k, _ in rows], "doc_id int, cluster_id long")
    summary = spark.createDataFrame([], "cluster_id long, topic_name string, raw_topic_name string, top_terms string")
    model = prototypes.build(records, own, summary, tokens, prototypes.ClassifierConfig(dims=None, max_df=1.0))
    assert model.terms == sorted({"财政", "预算", "收入", "大学", "教师", "课程"})
    x = records.select(prototypes.vectors(tokens(F.col("analysis_text")), model, model.centroids).alias("x"), "doc_id")
    assert all((r.x[1] > 0.99 > 0.01 > abs(r.x[0])) == bool(r.doc_id % 2) for r in x.collect())


def plain_words(texts, longest, least, cohesion, freedom):
    counts = Counter()
    for text in texts:
        run = ""
        for c in (text or "") + " ":
            if "一" <= c <= "鿿":
                run += c
                continue
            if run:
                run = f"\n{run}\n"
                counts.update(run[i : i + k] for k in range(1, longest + 3) for i in range(len(run) - k + 1))
            run = ""
    total = sum(n for g, n in counts.items() if len(g) == 1 and g != "\n")
    out = {}
    for w, n in counts.items():
        if not 2 <= len(w) <= longest or "\n" in w or n < least:
            continue
        bound = min(math.log(n * total / (counts[w[:k]] * counts[w[k:]])) for k in range(1, len(w)))
        sides = [[m for g, m in counts.items() if len(g) == len(w) + 1 and (g[1:] if side else g[:-1]) == w] for side in (0, 1)]
        free = min(math.log(sum(s)) - sum(m * math.log(m) for m in s) / sum(s) for s in sides)
        if bound >= cohesion and free >= freedom:
            out[w] = (n, round(bound, 9), round(free, 9))
    return out


def test_words_are_found(spark):
    rng = random.Random(7)
    lexicon = ["".join(rng.choices("天地玄黄宇宙洪荒日月盈昃辰宿列张", k=rng.randrange(2, 4))) for _ in range(15)]
    texts = ["".join(rng.choice(lexicon) if rng.random() < 0.8 else rng.choice("，。 一") for _ in range(40)) for _ in range(30)] + [None, "", "abc"]
    df = spark.createDataFrame([(x,) for x in texts], "text string")
    found = segment.discover_words(df, F.col("text"), 4, 4, 1.0, 0.3)
    got = {r.word: (r.n, round(r.cohesion, 9), round(r.freedom, 9)) for r in found.collect()}
    assert got == plain_words(texts, 4, 4, 1.0, 0.3) and len(set(got) & set(lexicon)) > 5
    own = segment.dictionary(found)
    assert own == {w: float(x[0]) for w, x in got.items()}
    assert segment.discover_words(df.limit(0), F.col("text")).count() == 0


def test_grams_in_batches_against_plain_counts(spark, monkeypatch):
    """Whole texts, whatever the alphabet: the numbers of longer grams overflow 64 bits and are made anew."""
    rng = random.Random(11)
    letters = [chr(0x4E00 + rng.randrange(0x5200)) for _ in range(3000)]
    texts = ["".join(rng.choice(letters) if rng.random() < 0.9 else rng.choice(" \n，a😀") for _ in range(rng.randrange(60))) for _ in range(300)] + [None, "", "  ", letters[0]]
    want = Counter()
    for run in (f"\n{r}\n" for x in texts for r in re.findall("[一-鿿]+", x or "")):
        want.update(run[i : i + k] for k in range(1, 8) for i in range(len(run) - k + 1) if run[i : i + k] != "\n")
    df = spark.createDataFrame([(x,) for x in texts], "text string")
    for size in (1 << 22, 500):
        monkeypatch.setattr(segment, "AT_ONCE", size)
        assert {r.gram: r.n for r in segment.grams(df, "text", 7).collect()} == want


def test_texts_are_read_once_for_words(spark, tmp_path):
    """The counts are written down once; the steps after them don't count the texts again."""
    spark.createDataFrame([("天地玄黄" * 9,)], "text string").write.parquet(str(tmp_path / "t"))
    found = segment.discover_words(spark.read.parquet(str(tmp_path / "t")), F.col("text"), 3, 2, 0.0, 0.0)
    assert "FileScan" not in found._jdf.queryExecution().toString() and "parquet" not in found._jdf.queryExecution().toString().lower()
