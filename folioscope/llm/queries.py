"""The registered queries of the training-data operators, and their SQL where SQL can express them.

Each query applies its operator with production parameters to the whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm import quality, toxicity
from folioscope.llm.decontam import contamination
from folioscope.llm.exact_dedup import exact_groups
from folioscope.llm.hmm_lm import score_texts
from folioscope.llm.html_extract import extract
from folioscope.llm.language_id import identify
from folioscope.llm.minhash import similar_groups
from folioscope.llm.mixing import mix
from folioscope.llm.simhash import as_hex, near_groups
from folioscope.llm.suffix_dedup import remove_repeats
from folioscope.llm.token_align import align_tokens
from folioscope.llm.wand import rank_documents


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(_table(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(_table(spark, sf_dir, "documents")).drop("cosine")


def op3_quality_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_toxicity_pu(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_hmm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(_table(spark, sf_dir, "documents"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(_table(spark, sf_dir, "documents")).select("doc_id", as_hex(F.col("fp")).alias("fingerprint"), "component_id")


def op7_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(_table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    hit = F.aggregate(F.arrays_zip("starts", "ends"), F.lit(0).cast("long"), lambda n, r: n + r["ends"] - r["starts"])
    items = F.size("items").cast("long")
    return found.select("doc_id", "n_words", hit.alias("n_hit"), items.alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(_table(spark, sf_dir, "documents"))


def op11_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_groups(_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


def op12_wand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


#: Where the public vocabularies lie; a parameter of the query.
TOKENIZERS = "/opt/tokenizers"


def op13_token_align(spark: SparkSession, sf_dir: str, tokenizers: str = TOKENIZERS) -> DataFrame:
    found, _ = align_tokens(_table(spark, sf_dir, "documents"), f"{tokenizers}/byte_bpe_50k.json", f"{tokenizers}/piece_bpe_32k.model")
    digest = F.when(F.col("n_a") > 0, F.sha2(F.col("groups").cast("binary"), 256)).otherwise("")
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", digest.alias("groups_sha256"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline  # the other queries don't need it

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_language_id": op2_language_id,
    "op3_quality_mil": op3_quality_mil,
    "op4_toxicity_pu": op4_toxicity_pu,
    "op5_hmm_score": op5_hmm_score,
    "op6_simhash": op6_simhash,
    "op7_html_extract": op7_html_extract,
    "op8_source_mix": op8_source_mix,
    "op9_decontamination": op9_decontamination,
    "op10_suffix_dedup": op10_suffix_dedup,
    "op11_minhash": op11_minhash,
    "op12_wand": op12_wand,
    "op13_token_align": op13_token_align,
    "pipeline": pipeline,
}

ORACLE = {
    "op1_exact_dedup": """
WITH n AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
)
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY t) AS keep_id,
       count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept,
       sha256(t) AS text_sha256
FROM n
""",
    "op8_source_mix": r"""
WITH d AS (
  SELECT doc_id, source,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h
  FROM documents
), per AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS n, CAST(1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS BIGINT) AS w
  FROM d GROUP BY source
), ordered AS (
  SELECT *,
         (SELECT CAST(sum(n) AS BIGINT) FROM per) - 3 * coalesce(CAST(sum(n) OVER before AS BIGINT), 0) AS room,
         (SELECT CAST(sum(w) AS BIGINT) FROM per) - coalesce(CAST(sum(w) OVER before AS BIGINT), 0) AS weight
  FROM per
  WINDOW before AS (ORDER BY n / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), marked AS (
  SELECT *, CAST(room AS HUGEINT) * w > CAST(3 AS HUGEINT) * n * weight AS capped FROM ordered
), rest AS (
  SELECT (SELECT CAST(sum(n) AS BIGINT) FROM per) - coalesce(CAST(sum(3 * n) FILTER (capped) AS BIGINT), 0) AS room,
         CAST(sum(w) FILTER (NOT capped) AS BIGINT) AS weight
  FROM marked
), budget AS (
  SELECT m.source, m.n AS source_size,
         CASE WHEN capped THEN 3 * CAST(m.n AS HUGEINT) ELSE CAST(r.room AS HUGEINT) * m.w END AS num,
         CASE WHEN capped THEN 1 ELSE r.weight END AS den
  FROM marked m, rest r
), repeats AS (
  SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE least(3, num // (den * source_size)) END AS base FROM budget
), by_hash AS (
  SELECT source, h, CAST(sum(size) AS BIGINT) AS s FROM d GROUP BY source, h
), cum AS (
  SELECT *, CAST(sum(s) OVER (PARTITION BY source ORDER BY h) AS BIGINT) - s AS before FROM by_hash
)
SELECT d.doc_id, d.size, r.source_size, CAST(r.num AS DOUBLE) / CAST(r.den AS DOUBLE) AS target,
       CAST(d.size * (r.base + CASE WHEN (2 * c.before + c.s) * CAST(r.den AS HUGEINT) <= 2 * (r.num - r.base * r.source_size * r.den)
                                     AND 2 * (r.num - r.base * r.source_size * r.den) >= r.den THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM d JOIN repeats r ON d.source IS NOT DISTINCT FROM r.source
       JOIN cum c ON c.source IS NOT DISTINCT FROM d.source AND c.h = d.h
""",
    "op9_decontamination": r"""
WITH bench AS (
  SELECT CAST(item_id AS VARCHAR) AS item,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), docs AS (
  SELECT doc_id, row_number() OVER () AS r,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), phrases AS (
  SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS p
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM bench WHERE len(w) > 0)
), places AS (
  SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM docs
), found AS (
  SELECT d.r, d.i, p.n, p.item
  FROM places d JOIN phrases p ON p.n = 10 AND d.i + 9 <= len(d.w) AND array_to_string(d.w[d.i : d.i + 9], ' ') = p.p
  UNION ALL
  SELECT d.r, d.i, p.n, p.item
  FROM places d JOIN (SELECT * FROM phrases WHERE n < 10) p ON d.i + p.n - 1 <= len(d.w) AND array_to_string(d.w[d.i : d.i + p.n - 1], ' ') = p.p
), hits AS (
  SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS k FROM found) GROUP BY r
), items AS (
  SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT r, item FROM found) GROUP BY r
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(h.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(t.n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(t.ids, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM docs d LEFT JOIN hits h ON h.r = d.r LEFT JOIN items t ON t.r = d.r
""",
    "op11_minhash": r"""
WITH RECURSIVE words AS (
  SELECT doc_id, row_number() OVER () AS r,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), shingles AS (
  SELECT DISTINCT r, array_to_string(w[i : i + 1], ' ') AS s FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 1, 1) + 1)) AS i FROM words WHERE len(w) > 0)
), sizes AS (
  SELECT r, CAST(count(*) AS BIGINT) AS n FROM shingles GROUP BY r
), pairs AS (
  SELECT a.r AS u, b.r AS v, count(*) AS common FROM shingles a JOIN shingles b ON a.s = b.s AND a.r < b.r GROUP BY ALL
), links AS (
  SELECT u, v FROM pairs JOIN sizes x ON x.r = u JOIN sizes y ON y.r = v WHERE 100 * common >= 80 * (x.n + y.n - common)
), edges AS (
  SELECT u, v FROM links UNION ALL SELECT v, u FROM links
), reach(r, root) AS (
  SELECT r, r FROM words
  UNION
  SELECT e.v, x.root FROM reach x JOIN edges e ON e.u = x.r
), component AS (
  SELECT x.r, min(d.doc_id) AS component_id FROM reach x JOIN words d ON d.r = x.root GROUP BY x.r
)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM words d JOIN component c ON c.r = d.r LEFT JOIN sizes s ON s.r = d.r
""",
    "op12_wand": r"""
WITH words AS (
  SELECT doc_id, row_number() OVER () AS r,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents
), items AS (
  SELECT item_id, row_number() OVER () AS i,
         unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t
  FROM benchmark
), wanted AS (
  SELECT item_id, i, t, count(*) AS q FROM items GROUP BY ALL
), corpus AS (
  SELECT CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS n_terms FROM words WHERE len(w) > 0
), postings AS (
  SELECT r, t, CAST(count(*) AS BIGINT) AS tf FROM (SELECT r, unnest(w) AS t FROM words) WHERE t IN (SELECT t FROM wanted) GROUP BY r, t
), weights AS (
  SELECT t, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS weight FROM postings, corpus GROUP BY t, n_docs
), scored AS (
  SELECT x.item_id, x.i, d.r, d.doc_id,
         CAST(sum(x.q * g.weight * ((1000000000 * p.tf) // (1000 * p.tf + 8 * (100 - 75 + (75 * CAST(len(d.w) AS BIGINT) * c.n_docs) // c.n_terms)))) AS BIGINT) AS score
  FROM wanted x JOIN postings p ON p.t = x.t JOIN weights g ON g.t = x.t JOIN words d ON d.r = p.r, corpus c
  GROUP BY x.item_id, x.i, d.r, d.doc_id
), ranked AS (
  SELECT item_id, CAST(row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS INT) AS rank, doc_id, score FROM scored WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
""",
}
