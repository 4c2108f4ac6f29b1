"""Registered queries against their SQL, and what must hold for the registry."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from folioscope.plans import registry

#: A query of each kind; the others are checked at larger scale by the driver.
CHECKED = "title_guess analysis_text line_filter feature_row money_score urgency_date review_priority priority_rank greedy_allocation resource_plan view_merge top_n_other page_offset family_rule_score content_split child_label cosine_top3 risk_score classification_summary tfidf_top_terms cluster_median_confidence latest_review review_transition_matrix audit_buckets classify_documents review_queue dictionary_rows audit_view review_correction_matrix last_wins_join family_rollup".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{sf}/{f}'")
    return con


def rounded(rows):
    plain = lambda x: round(x, 6) + 0.0 if isinstance(x, float) and math.isfinite(x) else x
    return sorted(repr([plain(x) for x in r]) for r in rows)


@pytest.mark.parametrize("name", CHECKED)
def test_query_matches_sql(spark, sf, duck, name):
    got = registry.QUERIES[name](spark, sf)
    want = duck.execute(registry.ORACLE[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(got.columns)
    assert rounded(tuple(r) for r in got.select(*columns).collect()) == rounded(want.fetchall())


def test_registry_is_whole():
    assert set(registry.QUERIES) == set(registry.ORACLE) and len(registry.QUERIES) >= 60
    assert set(registry.QUERIES) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_nothing_else_imports_llm():
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for folder, _, names in os.walk(os.path.join(root, "folioscope")):
        for n in names:
            if n.endswith(".py") and "/llm" not in folder:
                with open(os.path.join(folder, n)) as f:
                    assert "folioscope.llm" not in f.read(), n
