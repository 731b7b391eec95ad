"""The registered queries of the subpackage on the smallest tables."""

import pytest

from seamline.llm import registry
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"
CONTRACTS = {
    "op1": {"doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"},
    "op2": {"doc_id", "size", "source_size", "target", "taken"},
    "op4": {"doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"},
    "op5": {"doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"},
    "op6": {"doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"},
    "op9": {"doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"},
    "op10": {"doc_id", "n_shingles", "component_id"},
    "op11": {"conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"},
    "op12": {"doc_id", "n_bytes", "n_tokens", "over_limit"},
    "op13": {"vec_id", "code", "error", "label_error", "codebooks_sha256"},
}
TABLES = {"op7": "conversations", "op11": "conversations", "op13": "embeddings"}


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_covers_its_table(spark, name):
    df = registry.QUERIES[name](spark, SF)
    table = TABLES.get(name.split("_")[0], "documents")
    rows = spark.read.parquet(f"{SF}/{table}.parquet")
    assert df.count() == (rows.select("conv_id").distinct() if name.startswith("op11_") else rows).count()
    assert CONTRACTS.get(name.split("_")[0], set()) <= set(df.columns)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    compare(registry.QUERIES[name], registry.ORACLE_SQL[name], spark, SF, connect(SF))
