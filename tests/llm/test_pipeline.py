"""The pipeline's stages, each on its predecessor's result, against plain Python."""

import zlib

import corpus_pipeline
from folioscope.llm import mixing
from tests.llm.test_operators import bench_words, lower


def least_of_similar(texts):
    """The smallest doc_id of each group of texts that share four fifths of their shingles of five words."""
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
    return set(root.values())


def test_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    odd = spark.createDataFrame([(90001, None, "en", "src0", 0), (90002, "", None, None, 0), (90003, "12 34", "en", "src1", 5), (90004, "12 34!", "en", "src1", 6)], docs.schema)
    docs = docs.unionByName(odd)
    steps = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        out.write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        steps.append((docs.collect(), out.collect()))
        docs = out
    (a, b), (_, c), (_, d), (_, e), (_, f) = steps
    assert {r.doc_id for r in a} - {r.doc_id for r in b} == {90001, 90002, 90003, 90004}
    best = {}
    for r in b:
        best[lower(r.text)] = max(best.get(lower(r.text), -1), r.doc_id)
    assert {r.doc_id for r in c} == set(best.values())
    assert {r.doc_id for r in d} == least_of_similar({r.doc_id: r.text for r in c})
    phrases = set()
    for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect():
        w = bench_words(r.text)
        phrases |= {" ".join(w[k : k + 10]) for k in range(max(1, len(w) - 9))}
    clean = {r.doc_id for r in d if not any(f" {p} " in f" {' '.join(bench_words(r.text))} " for p in phrases)}
    assert {r.doc_id for r in e} == clean
    want = {r.doc_id: r.copies for r in mixing.mix(spark.createDataFrame(e)).collect() if r.copies}
    assert {r.doc_id: r.copies for r in f} == want
    assert all(zlib.crc32(r.text.encode()) >= 0 and 1 <= r.copies <= 3 for r in f)


def test_run_gives_the_last_stage(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "copies"] and out.count() > 50


def test_near_finds_all_similar_texts(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    odd = [(90001, None), (90002, ""), (90003, "a b"), (90004, "A  b"), (90005, " ".join(f"w{k}" for k in range(50))), (90006, " ".join(f"w{k}" for k in range(45))), (90007, " ".join(f"w{k}" for k in range(40)))]
    rows = docs.select("doc_id", "text").unionByName(spark.createDataFrame(odd, "doc_id long, text string"))
    kept = [r.doc_id for r in corpus_pipeline.near(spark, rows, sf).collect()]
    assert sorted(kept) == sorted(least_of_similar({r.doc_id: r.text for r in rows.collect()})) and not {90002, 90004, 90006, 90007, 145, 177} & set(kept)
