"""Binary chunk lists: a version byte, then 36-byte entries of a 32-byte hash and a little-endian size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VERSION = "01"
ENTRY_BYTES = 36
MAX_ENTRIES = 200_000


def _reversed_bytes(hex8: Column) -> Column:
    """Eight hex digits with their four bytes in reverse order."""
    return F.concat(*[F.substring(hex8, p, 2) for p in (7, 5, 3, 1)])


def encode_manifest(entries: DataFrame, key: str = "blob_id", max_entries: int = MAX_ENTRIES) -> DataFrame:
    """``key, manifest`` from ``key, idx, chunk_hash (binary of 32 bytes), size``, in the order of idx.

    A list of more than ``max_entries`` fails the job, as no reader takes it.
    """
    entry = F.concat(F.hex("chunk_hash"), _reversed_bytes(F.lpad(F.hex(F.col("size").cast("long")), 8, "0")))
    lists = entries.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("idx", entry.alias("hex")))).alias("list"))
    short = F.when(F.size("list") > max_entries, F.raise_error(F.lit("a manifest has too many entries")).cast("binary"))
    return lists.select(key, short.otherwise(F.unhex(F.concat(F.lit(VERSION), F.array_join(F.col("list.hex"), "")))).alias("manifest"))


def decode_manifest(df: DataFrame, key: str, bin_col: str, max_entries: int = MAX_ENTRIES) -> tuple[DataFrame, DataFrame]:
    """(entries, bad): ``key, idx, chunk_hash, size`` of valid lists, and ``key, fault`` of the others.

    Faults: null, empty, version, length (not whole entries), too many.
    """
    size = F.length(bin_col)
    count = (size - 1) / ENTRY_BYTES
    fault = (
        F.when(F.col(bin_col).isNull(), "null")
        .when(size == 0, "empty")
        .when(F.hex(F.substring(bin_col, 1, 1)) != VERSION, "version")
        .when((size - 1) % ENTRY_BYTES != 0, "length")
        .when(count > max_entries, "too many")
    )
    judged = df.select(key, F.col(bin_col).alias("__bin"), fault.alias("fault"), count.cast("int").alias("__n"))
    good = judged.filter("fault is null and __n > 0").select(key, "__bin", F.posexplode(F.sequence(F.lit(0), F.col("__n") - 1)).alias("idx", "__i"))
    start = F.col("idx") * ENTRY_BYTES + 2
    entries = good.select(
        key, "idx", F.substr("__bin", start, F.lit(32)).alias("chunk_hash"),
        F.conv(_reversed_bytes(F.hex(F.substr("__bin", start + 32, F.lit(4)))), 16, 10).cast("long").alias("size"),
    )
    return entries, judged.filter("fault is not null").select(key, "fault")
