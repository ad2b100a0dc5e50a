"""The queries' columns and types, as they are asked for, on the smallest tables."""

import os

import pytest

from vellum.llm import queries

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_licence_scan": "doc_id bigint, n_sentences bigint, sentence_ids string, licences string",
    "op2_host_quality": "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean",
    "op3_sstable": "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint",
    "op4_secret_scan": "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string",
    "op5_simhash": "doc_id bigint, fingerprint string, component_id bigint",
    "op6_html_extract": "page_id bigint, url string, text string, n_chars bigint",
    "op7_lm_score": "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double",
    "op8_packing": "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint",
    "op9_decontaminate": "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean",
    "op10_chat_format": "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint",
}


def test_names():
    assert set(queries.queries()) == {*COLUMNS, "pipeline"}


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", COLUMNS)
def test_columns_and_rows(spark, name):
    df = queries.queries()[name](spark, SF)
    kinds = dict(df.dtypes)
    want = dict(x.split() for x in COLUMNS[name].split(", "))
    assert {c: kinds.get(c) for c in want} == want
    source = {"op6_html_extract": "pages", "op10_chat_format": "conversations"}.get(name, "documents")
    key = df.columns[0]
    rows = spark.read.parquet(f"{SF}/{source}.parquet")
    assert df.select(key).distinct().count() == rows.select(key).distinct().count() + (name == "op10_chat_format")
