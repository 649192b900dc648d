"""Streams end in what their batch twins compute."""

import os
import subprocess
import sys

import pytest
from compare import DATA
from pyspark.sql import functions as F

from kilnwork.streaming import events as e
from kilnwork.streaming import stateful as st


@pytest.fixture(scope="module")
def log(spark, tmp_path_factory):
    """The event log as four files in time order, with a repeated one."""
    from kilnwork.queries.registry import Inputs

    path = str(tmp_path_factory.mktemp("log"))
    rows = Inputs(spark, DATA).fx_event_log.withColumn("ts", F.col("ts").cast("timestamp"))
    cuts = ["2024-01-01", "2024-01-10", "2024-01-20", "2024-01-25", "2025-01-01"]
    for a, b in zip(cuts, cuts[1:], strict=False):
        rows.filter(f"ts >= '{a}' and ts < '{b}'").coalesce(1).write.mode("append").parquet(path)
    return path, rows


def stream(spark, log):
    path, rows = log
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)


def drain(df, tmp_path, name, mode="append"):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination(180)
    return {tuple(r) for r in df.sparkSession.table(name).collect()}


def test_windows_match_batch(spark, log, tmp_path):
    _, rows = log
    for name, f in (("counts", e.outcome_counts), ("sessions", lambda d: e.watch_sessions(d, "3 hours"))):
        want = {tuple(r) for r in f(rows).collect()}
        got = drain(f(stream(spark, log)), tmp_path, name)
        assert got <= want and len(got) > 0.9 * len(want)  # windows after the last watermark are still open


def test_ingest_drops_repeats(spark, log, tmp_path):
    _, rows = log
    twice = stream(spark, log).union(stream(spark, log))
    got = drain(e.ingest_events(twice).select("build_id", "sequence"), tmp_path, "ingested")
    assert got == {tuple(r) for r in rows.select("build_id", "sequence").collect()}


def test_sink_takes_a_batch_once(spark, log, tmp_path):
    path, rows = log
    out = str(tmp_path / "table")
    for run in ("a", "b"):  # another stream: everything is delivered again
        e.event_log_sink(stream(spark, log), out, str(tmp_path / run), run).trigger(availableNow=True).start().awaitTermination(180)
    held = e.event_log(spark, out, rows.schema).read()
    assert held.count() == rows.count() == held.dropDuplicates(["build_id", "sequence"]).count()
    assert [r.sequence for r in e.replay(held, 8, 2, 5).collect()] == [3, 4, 5]


@pytest.mark.parametrize("name", ["ema", "bucket", "builds"])
def test_folds_match_batch(spark, log, tmp_path, name):
    _, rows = log
    f = {
        "ema": lambda d: st.live_ema(d.select("build_id", "sequence", "value"), "build_id"),
        "bucket": lambda d: st.rate_limit(d.select("build_id", "sequence", F.unix_seconds("ts").cast("double").alias("at_secs")), "build_id", 0.01, 2),
        "builds": lambda d: st.build_states(d.select("build_id", "sequence", F.when(F.col("kind") == "queued", "pending").when(F.col("kind") == "started", "active").otherwise("failed").alias("status"))),
    }[name]
    want = {tuple(r) for r in f(rows).collect()}
    assert drain(f(stream(spark, log)), tmp_path, f"fold_{name}") == want


def test_average_by_event_time(spark, tmp_path):
    """Rows out of order within the watermark count in order; one beyond it is dropped; the last wait."""
    files = [[("a", 3, 30, 3.0), ("a", 1, 10, 1.0), ("b", 1, 5, 7.0)], [("a", 2, 25, None), ("a", 4, 50, 8.0)], [("a", 9, 20, 99.0), ("b", 2, 90, 1.0)], [("a", 5, 60, 2.0), ("b", 3, 200, 5.0)]]
    schema, path = "k string, sequence long, s long, value double", str(tmp_path / "in")
    for rows in files:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    timed = lambda d: d.withColumn("ts", F.timestamp_seconds("s"))
    on_time = spark.createDataFrame([r for rows in files for r in rows if r[1:3] not in ((9, 20), (3, 200), (5, 60))], schema)
    want = {tuple(r) for r in st.live_ema(timed(on_time), "k", ts="ts").collect()}
    assert {(k, n) for k, _, _, n in want} == {("a", 1), ("a", 2), ("a", 3), ("b", 1), ("b", 2)}
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    assert drain(st.live_ema(timed(source), "k", ts="ts", watermark="20 seconds"), tmp_path, "timed_ema") == want


def test_heartbeat_timers(spark, log, tmp_path):
    _, rows = log
    beats = stream(spark, log).select(F.col("build_id").alias("executor_id"), "ts")
    got = drain(st.heartbeat_timeouts(beats, secs=86400), tmp_path, "silent")
    assert got and {k for k, _ in got} <= {r.build_id for r in rows.select("build_id").distinct().collect()}


def test_heartbeats_at_small_scale_match_sql(spark):
    """Microseconds, and beats without a time, on the larger tables."""
    import __spark_entry__
    from compare import of_duckdb, of_spark

    folder = "/root/testdata/sf0.01"
    got = __spark_entry__.queries()["t8_heartbeat_timeouts"](spark, folder)
    assert of_spark(got) == of_duckdb(__spark_entry__.oracle_sql()["t8_heartbeat_timeouts"], folder)


def test_silence_of_keys_with_null_times(spark, tmp_path):
    path = str(tmp_path / "in")
    rows = spark.createDataFrame([(1, 10.000001), (1, None), (2, None), (3, 500.0)], "executor_id long, s double")
    rows.write.parquet(path)
    beats = spark.readStream.schema(rows.schema).parquet(path).select("executor_id", F.timestamp_seconds("s").alias("ts"))
    assert drain(st.heartbeat_timeouts(beats, secs=30), tmp_path, "null_beats") == {(1, 10_000_001)}


def test_late_rows_are_kept_apart(spark):
    """Marks are by key and by what earlier arrivals brought; a closed window's count doesn't change, and none is lost."""
    from kilnwork.streaming.runs import run_arrivals

    schema = "k string, i long, s long"
    arrivals = [[("a", 1, 100), ("a", 2, 10), ("b", 3, 50), (None, 4, 70)], [("a", 5, 89), ("a", 6, 90), ("b", 7, 5), ("c", 8, 1), ("a", 9, None), (None, 10, 1)], [("a", 11, 300), ("b", 12, 41)], [("a", 13, 289), ("c", 14, 2)]]
    parts = [spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_seconds("s")).drop("s") for rows in arrivals]
    marked = run_arrivals(parts, lambda stream: st.mark_late(stream, "k", "ts", 10))
    assert marked.columns == ["k", "i", "ts", "late"]
    assert {r.i for r in marked.filter("late").collect()} == {5, 7, 10, 13} and marked.count() == 14
    counts = {(r.k, int(r.window_start.timestamp())): (r.n, r.late) for r in e.count_late(marked.filter("ts is not null"), "k", "100 seconds").collect()}
    assert counts["a", 0] == (2, 1) and counts["a", 200] == (0, 1) and counts["b", 0] == (2, 1)


def test_repeated_lines_without_text(spark, tmp_path):
    path = str(tmp_path / "in")
    lines = spark.createDataFrame([(1, 5, None), (1, 5, "x"), (1, 6, "y")], "log_id long, line_no long, line string").coalesce(1)
    lines.write.parquet(path)
    got = drain(st.live_tail(spark.readStream.schema(lines.schema).parquet(path), 2), tmp_path, "null_lines", "update")
    assert {(a, b) for a, b, _ in got} == {(1, 5), (1, 6)}


def test_tail_keeps_the_last(spark, log, tmp_path):
    _, rows = log
    lines = stream(spark, log).select(F.col("build_id").alias("log_id"), F.col("sequence").cast("long").alias("line_no"), "kind").withColumnRenamed("kind", "line")
    got = drain(st.live_tail(lines, 2), tmp_path, "tail", "update")
    last = {r.build_id: r.n for r in rows.groupBy("build_id").agg(F.max("sequence").alias("n")).collect()}
    assert all((k, n) in {(a, b) for a, b, _ in got} for k, n in last.items())


def test_pairs(spark, log, tmp_path):
    _, rows = log
    on = lambda d, kind: d.filter(F.col("kind") == kind).withColumn("node", F.lit(0))
    want = {tuple(r) for r in e.pair_start_finish(on(rows, "started"), on(rows, "completed"), "6 hours").collect()}
    got = drain(e.pair_start_finish(on(stream(spark, log), "started"), on(stream(spark, log), "completed"), "6 hours"), tmp_path, "pairs")
    assert got <= want and len(got) > 0.8 * len(want)


def test_every_pair_of_node_statuses():
    """All (from, to) pairs: the steps that are allowed, and no others."""
    from kilnwork.queries.state import BUILD_STEPS, NODE_STEPS

    for moves, steps in ((st.NODE_MOVES, NODE_STEPS), (st.BUILD_MOVES, BUILD_STEPS)):
        allowed = {tuple(x.split(">")) for x in steps.split()}
        names = {x for pair in allowed for x in pair if x != "none"}
        for a in [None, *names]:
            for b in names:
                after, fault = st.move(moves, a, b)
                assert (after, fault) == ((b, None) if (a or "none", b) in allowed else (a, f"{a or 'none'} -> {b}"))
    assert sum(map(len, st.NODE_MOVES.values())) == 1 + 36


def test_null_and_anonymous_keys(spark):
    from kilnwork.plans.folds import fold_sorted

    def count(state, row):
        n = (state or {"n": 0})["n"] + 1
        return {"n": n}, {"n": n}

    rows = spark.createDataFrame([(None, 1), ("null", 2), (None, 3), ("null", 4), ("a", 5)], "k string, i long").coalesce(1)
    got = {(r.k, r.i, r.n) for r in fold_sorted(rows, ["k"], ["i"], count, "k string, i long, n long").collect()}
    assert got == {(None, 1, 1), (None, 3, 2), ("null", 2, 1), ("null", 4, 2), ("a", 5, 1)}
    calls = spark.createDataFrame([("", 1, 0.0), (None, 2, 0.0), ("x", 1, 0.0), ("", 3, 0.0)], "k string, sequence long, at_secs double")
    limited = {(r.k, r.sequence, r.admitted) for r in st.rate_limit(calls, "k", 1, 2).collect()}
    assert limited == {(None, 1, True), (None, 2, True), (None, 3, False), ("x", 1, True)}


def test_token_bucket():
    step, state, got = st.fold_bucket(per_minute=60, burst=2), None, []
    for at in (0.0, 0.0, 0.0, 0.5, 1.0):
        state, out = step(state, {"at_secs": at})
        got.append((out["admitted"], round(out["wait_secs"], 3)))
    assert got == [(True, 0.0), (True, 0.0), (False, 1.0), (False, 0.5), (True, 0.0)]


ELSEWHERE = """
import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
import __spark_entry__
print("rows", __spark_entry__.queries()["t7_build_states_stream"](spark, {data!r}).count())
"""


def test_streams_run_from_any_folder(tmp_path):
    """Workers find the package where neither the working folder nor PYTHONPATH leads to it."""
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    known = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", ELSEWHERE.format(repo=repo, data=DATA)], cwd=tmp_path, env=known, capture_output=True, text=True, timeout=180)
    assert int(done.stdout.split("rows ")[1]) > 0, done.stderr[-2000:]


class Cells:
    """State of one key in memory, as a processor's handle gives it, that counts what passes."""

    def __init__(self):
        self.values, self.lists, self.timers, self.passed = {}, {}, set(), 0

    def getValueState(self, name, schema):
        return Cell(self, self.values, name)

    def getListState(self, name, schema):
        return Cell(self, self.lists, name)

    def registerTimer(self, millis):
        self.timers.add(millis)

    def deleteTimer(self, millis):
        self.timers.remove(millis)


class Cell:
    def __init__(self, cells, held, name):
        self.cells, self.held, self.name = cells, held, name

    def exists(self):
        return self.name in self.held

    def get(self):
        found = self.held.get(self.name)
        return iter(found or []) if self.held is self.cells.lists else found

    def update(self, value):
        self.held[self.name] = value
        self.cells.passed += 1

    def put(self, values):
        self.held[self.name] = list(values)
        self.cells.passed += len(values)

    def appendValue(self, value):
        self.appendList([value])

    def appendList(self, values):
        self.held.setdefault(self.name, []).extend(values)
        self.cells.passed += len(values)

    def clear(self):
        self.held.pop(self.name, None)


class Clock:
    def __init__(self, millis):
        self.millis = millis

    def getCurrentWatermarkInMs(self):
        return self.millis


def test_rows_of_a_batch_wait_as_one_element():
    """The state store is asked as often for a hundred rows of a key as for one; late rows are dropped, others come in order."""
    import pandas as pd
    from pyspark.sql.types import StructType

    from kilnwork.streaming.stateful import TimedFoldProcessor, fold_ema

    waiting = StructType.fromDDL("at_micros long, sequence long, value double")
    p, cells = TimedFoldProcessor(fold_ema(0.5), "build_id", waiting, StructType.fromDDL("ema double, n long"), ["build_id", "sequence", "ema", "n"]), Cells()
    p.init(cells)
    values = [0.1 * i for i in range(100)]
    frame = pd.DataFrame({"build_id": 7, "at_micros": [1_000_000 + 1000 * i for i in range(100)], "sequence": range(100), "value": values})
    assert list(p.handleInputRows((7,), iter([frame[::-1]]), Clock(0))) == []
    assert cells.passed <= 3 and cells.timers == {1000}
    early = pd.DataFrame({"build_id": [7, 7], "at_micros": [400_000, 900_000], "sequence": [None, -1.0], "value": [9.0, None]})
    p.handleInputRows((7,), iter([early]), Clock(500))
    assert cells.timers == {900}
    cells.timers.clear()
    out = pd.concat(p.handleExpiredTimer((7,), Clock(1049), None))
    assert out["sequence"].tolist() == [-1, *range(50)] and set(out["build_id"]) == {7} and cells.timers == {1050}
    rest = pd.concat(p.handleExpiredTimer((7,), Clock(2000), None))
    assert rest["sequence"].tolist() == [*range(50, 100)] and not cells.lists
    want = values[0]
    for x in values[1:]:
        want = 0.5 * x + 0.5 * want
    assert rest["ema"].iloc[-1] == want and rest["n"].iloc[-1] == 100
