"""The registered queries: their columns, and their SQL where there is some."""

import os

import duckdb
import pytest

from stratabar.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_url_filter": {"page_id": "bigint", "host": "string", "path": "string", "rule": "string", "verdict": "string"},
    "op2_bpe": {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"},
    "op3_token_files": {"doc_id": "bigint", "start": "bigint", "n_tokens": "bigint", "ids_crc32": "bigint"},
    "op4_decontamination": {"doc_id": "bigint"},
    "op5_language_id": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    "op6_jaccard_join": {"doc_id": "bigint", "class_id": "bigint", "n_links": "bigint"},
    "op7_chat_format": {"conv_id": "bigint"},
    "op8_sharding": {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int"},
    "op9_toxicity": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op10_quality_rules": {"doc_id": "bigint", "n_words": "bigint", "word_chars": "bigint", "n_symbols": "bigint", "n_dup_lines": "bigint", "n_repeat_words": "bigint", "base_failed": "boolean", "kept": "boolean"},
}


@pytest.mark.parametrize("name", QUERIES)
def test_columns(spark, name):
    got = dict(QUERIES[name](spark, SF).dtypes)
    assert {k: got.get(k) for k in COLUMNS[name]} == COLUMNS[name]


@pytest.mark.parametrize("name", ORACLE_SQL)
def test_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    rows = con.execute(ORACLE_SQL[name])
    names = [d[0] for d in rows.description]
    assert sorted(map(str, rows.fetchall())) == sorted(str(tuple(r)) for r in QUERIES[name](spark, SF).select(*names).collect())


def test_predictions_are_where_they_are_defined(spark):
    rows = QUERIES["op10_quality_rules"](spark, SF).collect()
    assert all(r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"]) for r in rows)
    assert not any(r["kept"] and r["base_failed"] for r in rows)
    assert all(r["predicted"] == (r["score"] >= 0.7) and 0 <= r["score"] <= 1 for r in QUERIES["op9_toxicity"](spark, SF).collect())
    assert all(0 <= r["score"] <= 1 for r in QUERIES["op5_language_id"](spark, SF).collect())
