"""Every registered query of the training-data operators over a whole table: columns, types, rows, folds and cuts."""

import zlib

import pytest
from compare import DATA, of_duckdb, of_spark

from kilnwork.llm import queries

DOCS = "doc_id bigint"
COLUMNS = {
    "op1_mix": "doc_id bigint, size bigint, source_size bigint, target double, taken bigint",
    "op2_language": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op3_quality": "doc_id bigint, held_out boolean, score double, predicted int",
    "op4_lines": "doc_id bigint, n_lines bigint, n_dropped bigint, kept_sha256 string",
    "op5_simhash": "doc_id bigint, fingerprint string, component_id bigint",
    "op6_media": "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string",
    "op7_topk": "query_id bigint, rank int, vec_id bigint, score bigint",
    "op8_toxicity": "doc_id bigint, held_out boolean, score double, predicted int",
    "op9_chat": "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint",
    "op10_bpe": "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
    "op11_manifest": "doc_id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean",
    "op12_packing": "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint",
    "op13_divergence": "lang string, source string, part string, item string, value bigint, rank int",
}
#: The remainder of crc32 that a query holds out, of how many.
HELD_OUT = {"op2_language": (4, 2), "op3_quality": (4, 2), "op8_toxicity": (3, 1)}


@pytest.mark.parametrize("name", sorted(COLUMNS, key=lambda n: int(n[2:].split("_")[0])))
def test_contract(spark, name):
    df = queries.QUERIES[name](spark, DATA)
    assert df.dtypes == [tuple(c.split(" ")) for c in COLUMNS[name].split(", ")]
    rows = df.collect()
    if name not in ("op7_topk", "op9_chat", "op12_packing", "op13_divergence"):
        ids = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id").collect()
        assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in ids)
    if name in HELD_OUT:
        parts, part = HELD_OUT[name]
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % parts == part) and 0 <= r.score <= 1 for r in rows)
        assert all(r.predicted == int(r.score >= 0.7) for r in rows if "predicted" in r)
    if name in queries.ORACLE_SQL:
        assert sorted(of_spark(df)) == of_duckdb(queries.ORACLE_SQL[name], DATA)


def test_every_query_has_its_contract():
    assert set(queries.QUERIES) == {*COLUMNS, "pipeline"}
