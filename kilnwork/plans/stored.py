"""Intermediate tables in the folder that every executor can read."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Rows that one task holds in hash tables, about, where ``in_tasks`` deals them.
TASK_ROWS = 1_000_000

#: Used only where the session names no folder and runs on one machine, as in tests.
LOCAL_FOLDER = "/tmp/checkpoints"


def shared_folder(spark: SparkSession) -> str:
    """The application's own folder below ``spark.checkpoint.dir``.

    Without such a setting a folder of this machine does for a local master
    only; on a cluster that is an error.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or LOCAL_FOLDER)
    return context.getCheckpointDir()


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and return a scan of what was written.

    The scan has no lineage beyond its files, so a lost executor costs no
    recomputation of ``df``, and using the result twice computes ``df`` once.
    The files go when the session ends. Such a scan itself is not written again.
    """
    return df if getattr(df, "_kept", False) else Rounds(df).add(df)


def read_rounds(tables: list[Rounds]) -> DataFrame:
    """The rows of several stored tables of one schema as one scan, however many they are."""
    first = tables[0]
    return first.spark.read.schema(first.schema).parquet(*[t.path for t in tables])


class Rounds:
    """One stored table that grows by a round's rows at a time, so that a scan of all rounds is a single scan of one folder."""

    def __init__(self, like: DataFrame):
        self.spark, self.schema = like.sparkSession, like.schema
        self.path = f"{shared_folder(self.spark)}/{uuid.uuid4().hex}"
        context = self.spark.sparkContext
        place = context._jvm.org.apache.hadoop.fs.Path(self.path)
        place.getFileSystem(context._jsc.hadoopConfiguration()).deleteOnExit(place)

    def add(self, rows: DataFrame) -> DataFrame:
        """All rows so far, ``rows`` among them; earlier results keep the rows they had."""
        rows.write.mode("append").parquet(self.path)
        kept = self.spark.read.schema(self.schema).parquet(self.path)
        kept._kept = True
        return kept


def spread(scan: DataFrame) -> DataFrame:
    """A table scan, dealt evenly where it has fewer partitions than the session has cores.

    For scans before work in Python: a small file can't be split further, and
    would keep one core busy. A scan of many files is left as it is, so
    nothing is shuffled there.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= cores else scan.repartition(cores)


def tasks_for(rows: DataFrame) -> int:
    """The number of tasks that hold about ``TASK_ROWS`` of ``rows`` each."""
    return rows.count() // TASK_ROWS + 1


def in_tasks(rows: DataFrame, *keys: str) -> DataFrame:
    """``rows`` dealt by ``keys`` to tasks of about ``TASK_ROWS`` each; the driver sees their number.

    For groups nearly as many as rows, which gain nothing by being combined
    before the shuffle: a task then holds as many as ever, whatever the size of
    the input's splits.
    """
    return rows.repartition(tasks_for(rows), *keys)
