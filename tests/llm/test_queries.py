"""The registered queries: one per operator, over whole tables, with the contract's columns."""

import pytest

import __spark_entry__ as E
from lexframe.llm.queries import QUERIES
from llm_data import docs  # noqa: F401 - fixtures

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_byte_bpe": "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
    "op2_crf_langid": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op3_lcp_fingerprint": "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double",
    "op4_curriculum_mix": "doc_id bigint, size bigint, source_size bigint, target double, taken bigint",
    "op5_ctw_score": "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double",
    "op6_site_line_dedup": "doc_id bigint, n_lines bigint, n_removed bigint, kept_sha256 string",
    "op7_debruijn_dedup": "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string",
    "op8_simhash_vp_tree": "doc_id bigint, fingerprint string, component_id bigint",
    "op9_bootstrapped_pii": "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string",
    "op10_rule_ledger": "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean",
}


@pytest.mark.parametrize("name", COLUMNS)
def test_columns_and_one_row_per_document(spark, docs, name):
    out = QUERIES[name][0](spark, SF)
    kinds = dict(out.dtypes)
    for column in COLUMNS[name].split(", "):
        c, kind = column.split()
        assert kinds[c] == kind
    assert sorted(r.doc_id for r in out.select("doc_id").collect()) == sorted(r.doc_id for r in docs.select("doc_id").collect())


OTHERS = {
    "op11_warc_chain": ("pages", "page_id", "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"),
    "op12_conversation_repair": ("conversations", "conv_id", "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, "
                                                             "cost bigint, audit string, repaired_sha256 string"),
    "op13_prefix_trie": ("conversations", None, "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, "
                                                "saved_tokens bigint, ends_sha256 string"),
}


@pytest.mark.parametrize("name", OTHERS)
def test_columns_of_pages_and_conversations(spark, name):
    source, key, columns = OTHERS[name]
    out = QUERIES[name][0](spark, SF)
    assert [f"{c} {kind}" for c, kind in out.dtypes] == columns.split(", ")
    if key:  # one row a page, one a conversation
        ids = [r[0] for r in spark.read.parquet(f"{SF}/{source}.parquet").select(key).collect()]
        assert sorted(r[0] for r in out.select(key).collect()) == sorted(ids if source == "pages" else set(ids))


def test_what_sql_cannot_express():
    without = {k for k in (*QUERIES, "pipeline") if k not in E.oracle_sql()}
    assert without == {"op1_byte_bpe", "op2_crf_langid", "op3_lcp_fingerprint", "op5_ctw_score", "op7_debruijn_dedup", "op8_simhash_vp_tree",
                       "op9_bootstrapped_pii", "pipeline"}
