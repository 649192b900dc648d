"""Pages, listings and work batches."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kilnwork.operators.filters import opt_filter, with_status_class

MAX_PAGE = 1000


def page_offset(builds: DataFrame, limit: int, offset: int, filters: Mapping[str, object | None] | None = None) -> DataFrame:
    """One page, newest first, with the ``total`` of all pages; beyond the last page one row of nulls but for the ``total``."""
    found = opt_filter(builds, filters or {})
    page = found.orderBy(F.col("submitted_at").desc(), F.col("build_id").desc()).offset(offset).limit(limit)
    total = found.agg(F.count("*").alias("total"))
    return total.join(page, F.lit(True), "left").select(*builds.columns, "total")


def page_keyset(builds: DataFrame, limit: int, cursor: tuple[str, int] | None = None, filters: Mapping[str, object | None] | None = None) -> DataFrame:
    """The page after ``cursor`` (time, id), newest first; the limit is clamped to 1..1000.

    Every row of a full page has ``next_cursor``, that of the page's last row.
    The plain comparison of times beside the pair's reaches the Parquet scan.
    """
    limit = max(1, min(MAX_PAGE, limit))
    found = opt_filter(builds, filters or {})
    if cursor is not None:
        at = F.expr(f"timestamp_ntz'{cursor[0]}'")
        found = found.filter((F.col("submitted_at") <= at) & ((F.col("submitted_at") < at) | (F.col("build_id") < cursor[1])))
    page = found.orderBy(F.col("submitted_at").desc(), F.col("build_id").desc()).limit(limit)
    last = page.agg(F.count("*").alias("__n"), F.min(F.struct("submitted_at", "build_id")).alias("__last"))
    next_cursor = F.when(F.col("__n") == limit, encode_cursor(F.col("__last.submitted_at"), F.col("__last.build_id")))
    return page.crossJoin(F.broadcast(last)).withColumn("next_cursor", next_cursor).drop("__n", "__last")


def encode_cursor(ts: Column, ident: Column) -> Column:
    """URL-safe base64 of a version byte, big-endian microseconds and a big-endian id."""
    micros = F.unix_micros(ts.cast("timestamp"))
    raw = F.unhex(F.concat(F.lit("01"), F.lpad(F.hex(micros), 16, "0"), F.lpad(F.hex(ident.cast("long")), 16, "0")))
    return F.rtrim(F.translate(F.base64(raw), "+/=", "-_ "))


def decode_cursor(cursor: Column) -> Column:
    """Struct (micros, id) of a cursor; null for a text that is none."""
    plain = F.translate(cursor, "-_", "+/")
    raw = F.hex(F.try_to_binary(F.concat(plain, F.repeat(F.lit("="), F.pmod(-F.length(plain), F.lit(4)))), F.lit("base64")))
    part = lambda at: F.conv(F.substring(raw, at, 16), 16, -10).cast("long")
    ok = (F.length(raw) == 34) & (F.substring(raw, 1, 2) == "01")
    return F.when(ok, F.struct(part(3).alias("micros"), part(19).alias("id")))


def estimator_listing(history: DataFrame, name_filter: str | None = None) -> DataFrame:
    from kilnwork.operators.filters import name_contains

    return name_contains(history, name_filter).orderBy(F.col("sample_count").desc(), "pname", "system")


def graph_page(build_id, nodes: DataFrame, build_nodes: DataFrame, limit: int) -> DataFrame:
    """The first nodes of a build by hash, with the ``total`` of its nodes."""
    own = nodes.join(build_nodes.filter(F.col("build_id") == build_id), "node_id", "left_semi")
    return own.orderBy("drv_hash").limit(limit).crossJoin(F.broadcast(own.agg(F.count("*").alias("total"))))


def order_by_rank(nodes: DataFrame) -> DataFrame:
    return with_status_class(nodes).orderBy("rank", "pname", "node_id")


def work_batch(pending: DataFrame, n: int, max_attempts: int = 10) -> DataFrame:
    """The oldest n rows that were not tried too often."""
    return pending.filter(F.col("attempts") < max_attempts).orderBy("enqueued_at", "item_id").limit(n)


def scan_progress(chunks: DataFrame, key: str = "chunk_id", buckets: int = 256) -> DataFrame:
    """``bucket, rows, bytes`` by the first byte of the key's hash: one scan in place of batches by key."""
    first = F.conv(F.substring(F.sha2(F.col(key).cast("string"), 256), 1, 2), 16, 10).cast("int")
    return chunks.groupBy(F.pmod(first, F.lit(buckets)).alias("bucket")).agg(F.count("*").alias("rows"), F.sum("size").alias("bytes"))
