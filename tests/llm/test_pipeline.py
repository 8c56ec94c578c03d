"""The pipeline's stages on the smallest tables, and the registered queries' columns."""

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
from veilstone.llm import queries  # noqa: E402
from veilstone.llm.store import written  # noqa: E402

COLUMNS = {
    "op1_line_dedup": {"doc_id", "n_lines", "n_dropped", "kept_sha256"}, "op2_mixing": {"doc_id", "size", "source_size", "target", "taken"},
    "op3_token_counts": {"doc_id", "n_bytes", "n_tokens", "over_limit"}, "op4_bpe": {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"},
    "op5_toxicity": {"doc_id", "held_out", "score", "predicted"}, "op6_simhash": {"doc_id", "fingerprint", "component_id"},
    "op7_nearest": {"query_id", "rank", "vec_id", "score"}, "op8_exact_dedup": {"doc_id", "keep_id", "group_size", "kept", "text_sha256"},
    "op9_warc": {"page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"}, "op10_quality": {"doc_id", "kept"},
    "op11_sharding": {"doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"},
    "op12_filter_audit": {"part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"},
    "op13_prefix_trie": {"conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"},
}


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "stage")
        assert docs.columns == columns, name
        counts.append(docs.count())
    assert counts[0] >= counts[1] >= counts[2] >= counts[3] > 0
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
    assert len(last) == counts[4] and all(r.round_trip and len(r.ids) == r.n_tokens for r in last)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_columns(spark, sf_dir, name):
    assert COLUMNS[name] <= set(queries.QUERIES[name](spark, sf_dir).columns)
