"""The registered queries: contract columns, whole tables, SQL where there is one."""

import pytest

from tessera.llm import queries
from tessera.llm.oracles import ORACLES
from tools.compare import compare

COLUMNS = {
    "op1_token_output": [("doc_id", "bigint"), ("start", "bigint"), ("n_tokens", "bigint"), ("ids_crc32", "bigint")],
    "op2_ngram_join": [("doc_id", "bigint"), ("class_id", "bigint"), ("n_links", "bigint")],
    "op3_private_data": [("doc_id", "bigint"), ("text", "string"), ("n_entities", "bigint")],
    "op4_mixing": [("doc_id", "bigint"), ("n_words", "bigint"), ("topic", "string"), ("probability", "double"), ("kept", "boolean")],
    "op5_toxicity": [("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")],
    "op6_decontamination": [("doc_id", "bigint"), ("n_words", "bigint"), ("n_hit", "bigint"), ("n_items", "bigint"), ("items_sha256", "string"), ("contaminated", "boolean")],
    "op7_substring_dedup": [("doc_id", "bigint"), ("n_words", "bigint"), ("n_removed", "bigint"), ("kept_sha256", "string")],
    "op8_html_extraction": [("page_id", "bigint"), ("url", "string"), ("text", "string"), ("n_chars", "bigint")],
    "op9_warc_derivatives": [("page_id", "bigint"), ("warc_type", "string"), ("record_id", "string"), ("refers_to", "string")],
    "op10_quality_rules": [("doc_id", "bigint"), ("n_words", "bigint"), ("word_chars", "bigint"), ("n_symbols", "bigint"), ("n_dup_lines", "bigint"), ("n_repeat_words", "bigint"), ("base_failed", "boolean"), ("kept", "boolean")],
}


def test_all_are_registered():
    assert set(queries.queries()) == set(COLUMNS) and set(ORACLES) <= set(COLUMNS)


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns_and_rows(spark, sf_dir, name):
    df = queries.queries()[name](spark, sf_dir)
    assert df.dtypes[: len(COLUMNS[name])] == COLUMNS[name]
    table = "pages" if "page_id" in df.columns else "documents"
    whole = spark.read.parquet(f"{sf_dir}/{table}.parquet").count()
    assert df.count() == whole * (2 if name.startswith("op9_") else 1)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, sf_dir, name):
    assert compare(spark, name, queries.queries()[name], ORACLES[name], sf_dir) == ""


def test_native_operators_run_no_python(spark, sf_dir):
    for name in ("op3_private_data", "op4_mixing", "op10_quality_rules"):
        plan = queries.queries()[name](spark, sf_dir)._jdf.queryExecution().toString()
        assert not any(x in plan for x in ("Python", "Pandas", "MapInArrow"))
