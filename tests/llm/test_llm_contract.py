"""The registered queries: names, columns and types, and what the contracts say of single rows."""

import re

import pytest

from __spark_entry__ import oracle_sql, queries

FOLDER = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_sharding": {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int"},
    "op2_license_scan": {"doc_id": "bigint", "n_words": "bigint", "n_base": "bigint", "first_word": "bigint", "last_word": "bigint",
                         "base_labels": "string", "labels": "string", "score": "double"},
    "op4_warc": {"page_id": "bigint", "payload_bytes": "bigint", "payload_digest": "string", "record_type": "string", "refers_to": "bigint"},
    "op5_simhash": {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"},
    "op8_chat_format": {"conv_id": "bigint", "n_turns": "bigint", "turns_sha256": "string", "loss_chars": "bigint", "loss_sha256": "string",
                        "formatted_chars": "bigint"},
    "op9_quality_rules": {"doc_id": "bigint", "n_words": "bigint", "word_chars": "bigint", "n_symbols": "bigint", "n_dup_lines": "bigint",
                          "n_repeat_words": "bigint", "base_failed": "boolean", "kept": "boolean"},
    "op11_quality_classifier": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op12_source_divergence": {"lang": "string", "source": "string", "part": "string", "item": "string", "value": "bigint", "rank": "int"},
    "op13_tokenizer_alignment": {"doc_id": "bigint", "n_a": "bigint", "n_b": "bigint", "n_groups": "bigint", "n_links": "bigint", "n_best": "bigint",
                                 "count_sum": "bigint", "groups_sha256": "string"},
}
ROWS = {"op1_sharding": "documents", "op2_license_scan": "documents", "op3_line_dedup": "pages", "op4_warc": "pages", "op5_simhash": "documents",
        "op7_mixing": "documents", "op9_quality_rules": "documents", "op10_token_counts": "documents", "op11_quality_classifier": "documents", "op13_tokenizer_alignment": "documents"}


def test_names():
    names = [n for n in queries() if n.startswith("op") or n == "pipeline"]
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in names if n != "pipeline") == list(range(1, 14)) and "pipeline" in names
    assert {n for n in oracle_sql() if n in names} == {"op3_line_dedup", "op4_warc", "op8_chat_format", "op12_source_divergence"}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns(spark, name):
    types = dict(queries()[name](spark, FOLDER).dtypes)
    assert {c: types[c] for c in COLUMNS[name]} == COLUMNS[name]


@pytest.mark.parametrize("name", sorted(ROWS))
def test_every_row_has_a_result(spark, name):
    assert queries()[name](spark, FOLDER).count() == spark.read.parquet(f"{FOLDER}/{ROWS[name]}.parquet").count()


def test_values(spark):
    (law,) = queries()["op1_sharding"](spark, FOLDER).select("law", "grown_shard").distinct().collect()
    assert tuple(law) == ("bytes", None)
    assert all(re.fullmatch("[0-9a-f]{16}", r.fingerprint) and r.component_id <= r.doc_id for r in queries()["op5_simhash"](spark, FOLDER).collect())
    judged = queries()["op9_quality_rules"](spark, FOLDER).collect()
    assert all(r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.kept and r.base_failed) for r in judged)
    added = [r for r in queries()["op8_chat_format"](spark, FOLDER).collect() if r.conv_id == -1]
    assert [(r.n_turns, r.loss_chars) for r in added] == [(2, 21)]
