"""Event streams: ingest, windows, pairing, late rows, sinks and alerts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from kilnwork.sources.versions import Snapshots, day_of

WATERMARK = "1 hour"


def ingest_events(stream: DataFrame, watermark: str = WATERMARK) -> DataFrame:
    """The log without repeated (build_id, sequence) rows; state is kept as long as the watermark allows repeats."""
    if not stream.isStreaming:
        return stream.dropDuplicates(["build_id", "sequence"])
    return stream.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(["build_id", "sequence"])


def event_log(spark: SparkSession, path: str, schema: StructType) -> Snapshots:
    """The table that ``event_log_sink`` writes, in parts by the day of ``ts``."""
    return Snapshots(spark, path, schema, day_of("ts"))


def event_log_sink(stream: DataFrame, path: str, checkpoint: str, name: str = "events"):
    """Add each event once, by (build_id, sequence), however often batches or streams deliver it.

    A batch's rows and its number are one commit, so a batch that was killed
    shows nothing and one that is repeated adds nothing. Another stream, or the
    same with another checkpoint under another ``name``, is held against the
    keys of the days that its batch touches, so a batch costs the same however
    long the log is. Nulls in a key are values like any other.
    """
    log = event_log(stream.sparkSession, path, stream.schema)
    return stream.writeStream.foreachBatch(lambda batch, number: log.append_batch(batch, ["build_id", "sequence"], name, number)).option("checkpointLocation", checkpoint)


def replay(log: DataFrame, build_id, since: int, until: int) -> DataFrame:
    """Events of a build with since < sequence <= until, in order."""
    return log.filter((F.col("build_id") == build_id) & (F.col("sequence") > since) & (F.col("sequence") <= until)).orderBy("sequence")


def _timed(stream: DataFrame, watermark: str) -> DataFrame:
    return stream.withWatermark("ts", watermark) if stream.isStreaming else stream


def outcome_counts(stream: DataFrame, width: str = "1 minute", watermark: str = WATERMARK) -> DataFrame:
    """``window_start, kind, n`` in tumbling windows."""
    counted = _timed(stream, watermark).groupBy(F.window("ts", width), "kind").agg(F.count("*").alias("n"))
    return counted.select(F.col("window.start").alias("window_start"), "kind", "n")


def outcome_rate(stream: DataFrame, width: str = "5 minutes", slide: str = "1 minute", watermark: str = WATERMARK) -> DataFrame:
    """``window_start, kind, rate`` a second in sliding windows."""
    counted = _timed(stream, watermark).groupBy(F.window("ts", width, slide), "kind").agg(F.count("*").alias("n"))
    secs = F.unix_seconds(F.col("window.end").cast("timestamp")) - F.unix_seconds(F.col("window.start").cast("timestamp"))
    return counted.select(F.col("window.start").alias("window_start"), "kind", (F.col("n") / secs).alias("rate"))


def watch_sessions(stream: DataFrame, gap: str = "300 seconds", watermark: str = WATERMARK) -> DataFrame:
    """``build_id, session_start, session_end, n``: a session ends after ``gap`` of silence."""
    counted = _timed(stream, watermark).groupBy(F.session_window("ts", gap), "build_id").agg(F.count("*").alias("n"))
    return counted.select("build_id", F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "n")


def quota_gate(stream: DataFrame, usage: DataFrame) -> DataFrame:
    """Add ``admitted``: false for tenants over their quota; an unknown tenant passes."""
    verdicts = usage.select("tenant_id", F.col("verdict").alias("__verdict"))
    return stream.join(verdicts, "tenant_id", "left").withColumn("admitted", F.coalesce(F.col("__verdict") != "over", F.lit(True))).drop("__verdict")


def pair_start_finish(starts: DataFrame, finishes: DataFrame, timeout: str = "1 hour", watermark: str = WATERMARK) -> DataFrame:
    """Each start with its finish of the same (build_id, node) within ``timeout``, or ``timed_out``."""
    s = _timed(starts, watermark).alias("s")
    f = _timed(finishes, watermark).select(F.col("build_id").alias("f_build"), F.col("node").alias("f_node"), F.col("ts").alias("f_ts"))
    on = (F.col("s.build_id") == F.col("f_build")) & (F.col("s.node") == F.col("f_node")) & (F.col("f_ts") >= F.col("s.ts")) & (F.col("f_ts") <= F.col("s.ts") + F.expr(f"interval {timeout}"))
    return s.join(f, on, "leftOuter").select("build_id", "node", F.col("s.ts").alias("ts"), "f_ts", F.col("f_ts").isNull().alias("timed_out"))


def count_late(marked: DataFrame, key: str, width: str) -> DataFrame:
    """``key, window_start, n, late`` of rows that ``mark_late`` marked: what a window counts, and what came for it when it was closed."""
    counted = marked.groupBy(key, F.window("ts", width).alias("window")).agg(F.count_if(~F.col("late")).alias("n"), F.count_if("late").alias("late"))
    return counted.select(key, F.col("window.start").alias("window_start"), "n", "late")


def alerts(stream: DataFrame, rules: Sequence[tuple[str, str, float]], width: str = "1 minute", watermark: str = WATERMARK) -> DataFrame:
    """``window_start, rule, value`` where the number of a kind's events in a window exceeds the rule's limit.

    A rule is (name, kind, limit).
    """
    counted = outcome_counts(stream, width, watermark)
    named = F.array(*[F.struct(F.lit(n).alias("rule"), F.lit(k).alias("rule_kind"), F.lit(float(v)).alias("limit")) for n, k, v in rules])
    joined = counted.select("window_start", "kind", "n", F.inline(named))
    return joined.filter((F.col("kind") == F.col("rule_kind")) & (F.col("n") > F.col("limit"))).select("window_start", "rule", F.col("n").alias("value"))
