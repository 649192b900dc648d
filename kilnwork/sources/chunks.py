"""Chunk store on files: one row a hash, in folders by hash prefix, with filters of the hashes beside it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kilnwork.plans.membership import WORDS, build_filter, merge_filters, possible

#: Blocks of a prefix's filter: 131,072 hashes at 16 bits each, 33 million in all prefixes; a store of more names a larger number.
BLOCKS = 4096


def prefix(key: str = "chunk_hash"):
    return F.substring(F.col(key).cast("string"), 1, 2)


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("chunk_hash string, bytes binary, prefix string").parquet(path)


def read_filters(spark: SparkSession, path: str, blocks: int = BLOCKS) -> DataFrame:
    """``prefix, block, w0 .. w7`` of the filters that writes of one number of blocks have left."""
    rows = spark.read.schema(f"block long, {', '.join(f'{w} long' for w in WORDS)}, blocks int, prefix string").parquet(path)
    return merge_filters(rows.filter(F.col("blocks") == blocks), ["prefix"])


def write_filters(hashes: DataFrame, path: str, key: str = "chunk_hash", blocks: int = BLOCKS) -> None:
    """Append a filter of ``hashes``; filters of all writes are merged when they are read."""
    rows = build_filter(hashes.select(key, prefix(key).alias("prefix")), key, blocks, ["prefix"])
    rows.withColumn("blocks", F.lit(blocks)).hint("rebalance", "blocks", "prefix").write.mode("append").partitionBy("blocks", "prefix").parquet(path)


def held_hashes(hashes: DataFrame, store: DataFrame, key: str, filters: DataFrame | None, blocks: int) -> DataFrame:
    """The distinct ``key`` of ``hashes`` that the store holds; with filters only hashes that pass them meet the store."""
    asked = hashes.select(key).distinct()
    if filters is not None:
        asked = possible(asked.withColumn("__prefix", prefix(key)), key, filters.withColumnRenamed("prefix", "__prefix"), blocks, ["__prefix"]).select(key)
    return asked.join(store.select(key), key, "left_semi")


def write_chunks(df: DataFrame, path: str, store: DataFrame | None = None, filter_path: str | None = None, blocks: int = BLOCKS) -> None:
    """Append chunks (chunk_hash, bytes) that the store does not hold, each hash once; rows without a hash are not chunks.

    Rows are gathered by prefix for the sake of few files; a prefix with more
    than a partition's bytes is written by several tasks. With ``filter_path``
    hashes are held against the filters there before the store, and filters of
    the new ones are added first: a write that fails then leaves a bit too many
    and never one too few.
    """
    fresh = df.filter("chunk_hash is not null").select("chunk_hash", "bytes").dropDuplicates(["chunk_hash"])
    if store is not None:
        filters = read_filters(df.sparkSession, filter_path, blocks) if filter_path else None
        hashes = df.filter("chunk_hash is not null").select("chunk_hash")
        fresh = fresh.join(held_hashes(hashes, store, "chunk_hash", filters, blocks), "chunk_hash", "left_anti")
    if filter_path:
        write_filters(fresh, filter_path, blocks=blocks)
    fresh.withColumn("prefix", prefix()).hint("rebalance", "prefix").write.mode("append").partitionBy("prefix").parquet(path)


def exists_batch(hashes: DataFrame, store: DataFrame, key: str = "chunk_hash", filters: DataFrame | None = None, blocks: int = BLOCKS) -> DataFrame:
    """Every row of ``hashes``, repeats included, with ``present``; ``filters`` as ``read_filters`` gives them keep strange hashes from the store."""
    held = held_hashes(hashes, store, key, filters, blocks).withColumn("__held", F.lit(True))
    return hashes.join(held, key, "left").withColumn("present", F.coalesce("__held", F.lit(False))).drop("__held")
