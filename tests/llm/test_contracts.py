"""Every query over odd and empty tables: columns, one row per input row, defined results."""
import pytest

import __spark_entry__ as E
from helpers import odd_documents, odd_turns

DOC_QUERIES = {
    "op2_toxicity_svm": {"doc_id", "held_out", "score", "predicted"},
    "op4_simhash_cover": {"doc_id", "fingerprint", "component_id"},
    "op5_bpe_reuse": {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"},
    "op6_exact_dedup": {"doc_id", "keep_id", "group_size", "kept", "text_sha256"},
    "op7_language_id": {"doc_id", "held_out", "lang_pred", "score"},
    "op8_token_counts": {"doc_id", "n_bytes", "n_tokens", "over_limit"},
    "op9_mix_sources": {"doc_id", "size", "source_size", "target", "taken"},
    "op11_importance_resample": {"doc_id", "n_features", "weight", "score", "rank"},
    "op12_suffix_tree": {"doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"},
}
OTHER = {"op1_role_repair": {"conv_id", "turn", "role", "repaired_role", "action", "total_cost", "rendered"},
         "op13_hard_negatives": {"anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"}, "op3_multiprobe_lsh": {"query_id", "rank", "vec_id", "score"}, "op10_wrapper_html": {"page_id", "url", "text", "n_chars"}}


def test_all_are_registered():
    assert {*DOC_QUERIES, *OTHER, "pipeline"} <= set(E.queries()) and len(DOC_QUERIES) + len(OTHER) == 13


def test_turns_with_odd_rows(spark, odd):
    rows = E.queries()["op1_role_repair"](spark, odd).collect()
    assert OTHER["op1_role_repair"] == set(rows[0].asDict()) and None not in {r["rendered"] for r in rows}
    assert sorted(str((r["conv_id"], r["turn"], r["role"])) for r in rows) == sorted(str((t["conv_id"], t["turn"], t["role"])) for t in odd_turns())


@pytest.mark.parametrize("name", sorted(DOC_QUERIES))
def test_documents_with_odd_rows(spark, odd, name):
    rows = E.queries()[name](spark, odd).collect()
    assert DOC_QUERIES[name] <= set(rows[0].asDict())
    want = sorted((str(d["doc_id"]) for d in odd_documents()))
    assert sorted(str(r["doc_id"]) for r in rows) == want


@pytest.mark.parametrize("name", sorted({**DOC_QUERIES, **OTHER, "pipeline": {}}))
def test_empty_tables(spark, empty, name):
    df = E.queries()[name](spark, empty)
    assert df.collect() == []
    assert {**DOC_QUERIES, **OTHER, "pipeline": {"doc_id", "n_tokens"}}[name] <= set(df.columns)


def test_pipeline_over_odd_rows(spark, odd):
    rows = E.queries()["pipeline"](spark, odd).collect()
    assert {r["doc_id"] for r in rows} <= {d["doc_id"] for d in odd_documents()}
