"""The stages against plain Python where near copies follow the similarity of five-word shingles, and on odd tables."""

import corpus_pipeline
from folioscope.llm import mixing, similar
from tests.llm.test_operators import bench_words, lower


def near_roots(texts):
    """The smallest id of each id's group: links are pairs of shingle sets with a Jaccard similarity of 4/5 or more."""
    sets = {}
    for i, t in texts.items():
        w = lower(t).encode().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
    root = {k: k for k in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and root[a] != root[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                old, new = max(root[a], root[b]), min(root[a], root[b])
                root = {k: new if x == old else x for k, x in root.items()}
    return root


def test_stages_with_similar_texts(spark, sf, tmp_path):
    docs, steps = spark.read.parquet(f"{sf}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        assert [c for c in out.columns if c != "copies"] == docs.columns
        out.write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        steps.append((docs.collect(), out.collect()))
        docs = out
    (a, b), (_, c), (_, d), (_, e), (_, f) = steps
    assert {r.doc_id for r in a if any(x.isalpha() for x in r.text or "")} == {r.doc_id for r in b}
    best = {}
    for r in b:
        best[lower(r.text)] = max(best.get(lower(r.text), -1), r.doc_id)
    assert {r.doc_id for r in c} == set(best.values())
    assert {r.doc_id for r in d} == set(near_roots({r.doc_id: r.text for r in c}).values()) and len(d) < len(c)
    phrases = set()
    for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect():
        w = bench_words(r.text)
        phrases |= {" ".join(w[k : k + 10]) for k in range(max(1, len(w) - 9))}
    clean = {r.doc_id for r in d if not any(f" {p} " in f" {' '.join(bench_words(r.text))} " for p in phrases)}
    assert {r.doc_id for r in e} == clean and len(clean) < len(d)
    want = {r.doc_id: r.copies for r in mixing.mix(spark.createDataFrame(e)).collect() if r.copies}
    assert {r.doc_id: r.copies for r in f} == want


CLASHES = ["copies", "own_key", "dropped_id", "dropped_key", "Language", "s", "base", "threshold", "id", "key", "kept", "text_key", "fp", "h", "__id", "__p"]


def odd_rows():
    long = " ".join(f"word{k % 977}" for k in range(60_000))
    texts = [None, "", "  ", "Avec.", "A.", "a b c d e f", "A b c d e f", long, long + " more", "same text of two", "same text of two", "12 34"]
    rows = [(i, t, "en" if i % 2 else None, None if i % 3 else "src", None) for i, t in enumerate(texts)]
    return [*rows, rows[5], rows[5], rows[7], (None, None, None, None, None), (None, "no id", "de", "", 1), (None, "no id", "de", "", 1)]


def test_odd_rows_and_clashing_columns(spark, sf, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` int" for c in CLASHES)
    docs = spark.createDataFrame([(*r, *range(len(CLASHES))) for r in odd_rows()], schema).repartition(3)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        assert out.columns[: len(docs.columns)] == docs.columns, name
        assert len(out.columns) - len(docs.columns) == (name == "mixture")
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        got = sorted((r.doc_id is None, r.doc_id or 0, len(r.text or "")) for r in docs.collect())
        assert all(r[CLASHES[3]] == 3 and r["__p"] == len(CLASHES) - 1 for r in docs.collect())
        if name == "language":  # without a letter nothing has a language; short texts with letters stay
            assert [i for none, i, _ in got if not none] == [3, 4, 5, 5, 5, 6, 7, 7, 8, 9, 10] and sum(none for none, _, _ in got) == 2
        elif name == "exact":
            assert [i for none, i, _ in got if not none] == [3, 4, 6, 7, 8, 10] and sum(none for none, _, _ in got) == 1
        elif name == "near":
            assert [i for none, i, _ in got if not none] == [3, 4, 6, 7, 10] and sum(none for none, _, _ in got) == 1


def test_stages_on_an_empty_table(spark, sf):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf).count() == 0


def test_near_keeps_one_of_rows_repeated_as_a_whole(spark):
    rows = [(1, "x y z"), (1, "x y z"), (2, "x y z"), (3, None), (3, None), (4, ""), (None, "q"), (None, "q")]
    got = [tuple(r) for r in similar.drop_similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(got, key=repr) == sorted([(1, "x y z"), (3, None), (None, "q")], key=repr)
