"""Registered queries against their SQL and their contracts."""

from __future__ import annotations

import pytest
from compare import compare, connect
from conftest import DATA

from tillbook.llm.oracle import all_sql
from tillbook.llm.queries import all_queries

COLUMNS = {
    "op1_mix_sources": ["doc_id", "size", "source_size", "target", "taken"],
    "op3_secret_scan": ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
    "op4_near_vectors": ["vec_id", "n_links", "component_id", "kept"],
    "op5_url_filter": ["page_id", "host", "path", "rule", "verdict"],
    "op6_toxicity": ["doc_id", "held_out", "score", "predicted"],
    "op7_shard": ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"],
    "op8_jaccard_join": ["doc_id", "n_shingles", "component_id"],
    "op9_quality": ["doc_id", "held_out", "score", "predicted"],
}


@pytest.mark.parametrize("name", sorted(all_sql()))
def test_query_equals_sql(spark, data, name):
    assert compare(all_queries()[name](spark, data), connect(DATA), all_sql()[name]) == []


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns_and_rows(spark, data, name):
    out = all_queries()[name](spark, data)
    assert set(COLUMNS[name]) <= set(out.columns)
    table = {"op4": "embeddings", "op5": "pages"}.get(name.split("_")[0], "documents")
    assert out.count() == spark.read.parquet(f"{data}/{table}.parquet").count()
