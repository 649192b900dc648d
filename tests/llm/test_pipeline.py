import hashlib

import public_tokenizers
import pytest
from plain import dedup, mix, similar_classes
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from kilnwork.llm import language
from kilnwork.llm.sampling import held_out

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """The smallest documents with a few odd ones."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame(
        [(9001, None, "en", "src1", 0), (9002, "", "en", None, 0), (9003, "12 34 !?", None, "src2", 8)], docs.schema
    )
    path = str(tmp_path_factory.mktemp("sf"))
    docs.union(odd).coalesce(2).write.parquet(f"{path}/documents.parquet")
    return path


def test_stages_and_columns(spark, folder):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language", "lines", "near_duplicates", "mix", "tokens"]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == list(corpus_pipeline.COLUMNS)


def test_run_matches_plain_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    model = language.fit_language(docs.filter(~held_out(F.col("doc_id"), 4, 2)))
    langs, _ = language.score_texts(model, [t or "" for _, t, _ in rows])
    rows = [r for r, lang in zip(rows, langs, strict=True) if lang != "und"]
    assert {9001, 9002, 9003}.isdisjoint(d for d, _, _ in rows)
    texts = dedup([(d, t) for d, t, _ in rows])
    least = similar_classes(texts)
    rows = [(d, texts[d], s) for d, _, s in rows if least[d] == d]
    copies = [(d, n) for d, _, _, _, n in mix(rows)]
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = []
    for d, n in copies:
        ids = tokenizer.encode(texts[d], add_special_tokens=False).ids
        want += [(d, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())] * n
    got = corpus_pipeline.run(spark, folder).select("doc_id", "n_tokens", "ids_sha256").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_empty_table(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
    assert docs.count() == 0
