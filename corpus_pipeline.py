"""A training corpus from ``documents``: language, lines, near duplicates, mix, tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kilnwork.llm import bpe, language, lines, mixing, similar
from kilnwork.llm.queries import token_digests, word_vocabulary
from kilnwork.plans.stored import spread, stored

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; ``und`` goes."""
    return language.identify_documents(docs, carry=docs.columns).filter(F.col("lang_pred") != language.UNDETERMINED).select(*COLUMNS)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines stay in the smallest document that holds them; ``n_chars`` is counted anew."""
    return lines.dedup_lines(docs).withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest document of each class of near duplicates: five-word shingles, Jaccard similarity of 0.8 or more."""
    return similar.drop_near_duplicates(docs).select(*COLUMNS)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mix_sources(docs).select(*COLUMNS)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with their digests."""
    encoded = bpe.encode_documents(docs, word_vocabulary())
    return token_digests(encoded.select("doc_id", "ids", "decoded"))


STAGES = [
    ("language", language_stage),
    ("lines", line_stage),
    ("near_duplicates", near_duplicate_stage),
    ("mix", mix_stage),
    ("tokens", token_stage),
]

#: Character models, near duplicates and tokenizers have no SQL; the stages are tested against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each but the last stored and read again."""
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs)
    return docs
