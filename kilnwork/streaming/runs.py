"""Streams over stored tables, run until everything that is there has been read."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

from kilnwork.plans.stored import shared_folder

#: What keyed state with timers and lists needs.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def fresh_folder(spark: SparkSession) -> str:
    """A path in the shared folder that nothing uses yet."""
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


def as_stream(table: DataFrame) -> DataFrame:
    """The rows of a table as a stream of files."""
    spark = table.sparkSession
    path = fresh_folder(spark)
    table.write.parquet(path)
    return spark.readStream.schema(table.schema).parquet(path)


def _drain(stream: DataFrame, path: str, checkpoint: str, mode: str) -> DataFrame:
    """Run a stream to the end of its source; each batch overwrites a folder of its own number, so one that is repeated adds nothing."""
    spark = stream.sparkSession
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, STATE_STORE)
    try:
        sink = stream.writeStream.outputMode(mode).foreachBatch(lambda batch, n: batch.write.mode("overwrite").parquet(f"{path}/run_batch={n}"))
        sink.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(key, before)
    return spark.read.schema(stream.schema).parquet(path).select(*stream.columns)


def run_stream(stream: DataFrame, mode: str = "append") -> DataFrame:
    """What a stream puts out until its source is read to the end, kept in the shared folder."""
    return _drain(stream, fresh_folder(stream.sparkSession), fresh_folder(stream.sparkSession), mode)


def run_arrivals(parts: Sequence[DataFrame], operator: Callable[[DataFrame], DataFrame], mode: str = "append") -> DataFrame:
    """What ``operator`` puts out over a stream to which the parts come one after another, its state kept from run to run."""
    spark = parts[0].sparkSession
    source, path, checkpoint = (fresh_folder(spark) for _ in range(3))
    for part in parts:
        part.write.mode("append").parquet(source)
        out = _drain(operator(spark.readStream.schema(parts[0].schema).parquet(source)), path, checkpoint, mode)
    return out
