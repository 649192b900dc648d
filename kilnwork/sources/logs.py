"""Log archive: gzip members of many logs in few files, and reading them back in groups."""

from __future__ import annotations

import gzip
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

GROUP_LINES = 256
NAMES = ["log_id", "first_line", "n_lines", "member"]


def log_pointers(lines: DataFrame, build_nodes: DataFrame) -> DataFrame:
    """``build_id, log_id, owner``: a pointer for each build that wants a log; the least build owns the text."""
    wanted = build_nodes.select("build_id", F.col("node_id").alias("log_id")).join(lines.select("log_id").distinct(), "log_id", "left_semi")
    owner = wanted.groupBy("log_id").agg(F.min("build_id").alias("owner"))
    return wanted.join(owner, "log_id").select("build_id", "log_id", "owner")


def archive_logs(lines: DataFrame, path: str) -> None:
    """Write ``log_id, line_no, line`` as gzip members of 256 line numbers, many to a file, in the order of log and line.

    A row of the archive is a member with its log, first line and number of
    lines. Members are dealt by ranges, so files number the partitions however
    many logs there are, a long log spans several, and the scan finds a log's
    members by the least and greatest values of row groups. Without ``member``
    the scan is the index. Null lines are empty.
    """
    kind = lines.schema["log_id"].dataType.simpleString()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, numbers, texts = None, [], []

        def member() -> tuple:
            text = "\n".join(f"{n}\t{t or ''}" for n, t in zip(numbers, texts, strict=True))
            return (key[0], numbers[0], len(numbers), gzip.compress(text.encode(), mtime=0))

        for batch in batches:
            found, kinds = [], [batch.schema.field("log_id").type, pa.int64(), pa.int64(), pa.binary()]
            for log, group, number, text in zip(*(batch.column(c).to_pylist() for c in ("log_id", "group_no", "line_no", "line")), strict=True):
                if (log, group) != key:
                    if numbers:
                        found.append(member())
                    key, numbers, texts = (log, group), [], []
                numbers.append(number), texts.append(text)
            yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], k) for i, k in enumerate(kinds)], NAMES)
        if numbers:
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(member(), kinds, strict=True)], NAMES)

    grouped = lines.select("log_id", F.floor(F.col("line_no") / GROUP_LINES).alias("group_no"), F.col("line_no").cast("long").alias("line_no"), "line")
    ordered = grouped.repartitionByRange("log_id", "group_no").sortWithinPartitions("log_id", "group_no", "line_no")
    ordered.mapInArrow(pack, f"log_id {kind}, first_line long, n_lines long, member binary").write.option("compression", "uncompressed").parquet(path)


def read_logs(spark: SparkSession, path: str, since: int = 0, logs: Sequence | None = None) -> DataFrame:
    """Archived lines from ``since`` on, of some logs only if these are named, in groups; see ``group_lines``."""
    members = spark.read.parquet(path).filter(F.col("first_line") + GROUP_LINES > since)
    if logs is not None:
        members = members.filter(F.col("log_id").isin(*logs))
    kind = members.schema["log_id"].dataType.simpleString()

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for log, data in zip(batch.column("log_id"), batch.column("member").to_pylist(), strict=True):
                found = [line.split("\t", 1) for line in gzip.decompress(data).decode().split("\n")]
                columns = [pa.array([log.as_py()] * len(found), log.type), pa.array([int(n) for n, _ in found], pa.int64()), pa.array([t for _, t in found], pa.string())]
                yield pa.RecordBatch.from_arrays(columns, ["log_id", "line_no", "line"])

    return group_lines(members.select("log_id", "member").mapInArrow(unpack, f"log_id {kind}, line_no long, line string"), since)


def group_lines(lines: DataFrame, since: int = 0, size: int = GROUP_LINES) -> DataFrame:
    """``log_id, group_no, first_line, n_lines, body, complete``: ``size`` lines a group, the last one complete."""
    used = lines.filter(F.col("line_no") >= since).withColumn("group_no", F.floor((F.col("line_no") - since) / size))
    grouped = used.groupBy("log_id", "group_no").agg(
        F.min("line_no").alias("first_line"), F.count("*").alias("n_lines"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("body"),
    )
    last = grouped.groupBy("log_id").agg(F.max("group_no").alias("__last"))
    return grouped.join(last, "log_id").withColumn("complete", F.col("group_no") == F.col("__last")).drop("__last")
