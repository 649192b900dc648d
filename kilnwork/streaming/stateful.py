"""Keyed stateful operators, as ``transformWithStateInPandas`` processors with batch twins.

Each processor keeps its fold in a plain function over the rows of one key in
order; the batch twin runs the same fold over sorted rows.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType

from kilnwork.plans.folds import fold_sorted
from kilnwork.plans.transitions import fold_transitions

#: Statuses that may follow each status of a node, and of a build: fixed values. A node that has come to an end may be told so again.
NODE_MOVES = {
    None: ("created",),
    "created": ("completed", "queued", "dependency_failed", "substituting"),
    "queued": ("completed", "ready", "dependency_failed", "skipped", "substituting"),
    "ready": ("completed", "assigned", "poisoned", "dependency_failed", "skipped", "substituting"),
    "substituting": ("completed", "ready", "queued", "cancelled"),
    "assigned": ("running", "ready", "cancelled"),
    "running": ("completed", "failed", "poisoned", "cancelled"),
    "failed": ("ready",),
    "completed": ("completed", "ready"),
    "poisoned": ("poisoned", "completed", "created"),
    "dependency_failed": ("dependency_failed", "completed"),
    "cancelled": ("cancelled",),
    "skipped": ("skipped",),
}
BUILD_MOVES = {None: ("pending",), "pending": ("active", "cancelled"), "active": ("succeeded", "failed", "cancelled")}


def move(moves: dict, state: str | None, to: str) -> tuple[str | None, str | None]:
    """(new state, fault): a step that ``moves`` does not list changes nothing and is a fault."""
    if to in moves.get(state, ()):
        return to, None
    return state, f"{state or 'none'} -> {to}"


def fold_states(moves: dict) -> Callable[[dict | None, dict], tuple[dict, dict]]:
    def step(state: dict | None, row: dict) -> tuple[dict, dict]:
        before = state["status"] or None if state else None
        after, fault = move(moves, before, row["status"])
        return {"status": after or ""}, {"status": after, "fault": fault}

    return step


def fold_ema(alpha: float) -> Callable[[dict | None, dict], tuple[dict, dict]]:
    def step(state: dict | None, row: dict) -> tuple[dict, dict]:
        x = row["value"]
        if x is None or x != x:
            now = state["ema"] if state else None
            return (state or {"ema": float("nan"), "n": 0}), {"ema": now, "n": state["n"] if state else 0}
        fresh = state is None or not state["n"]
        ema = x if fresh else alpha * x + (1 - alpha) * state["ema"]
        n = 1 if fresh else state["n"] + 1
        return {"ema": ema, "n": n}, {"ema": ema, "n": n}

    return step


def fold_bucket(per_minute: float, burst: float) -> Callable[[dict | None, dict], tuple[dict, dict]]:
    """Token bucket: ``burst`` tokens at most, refilled at ``per_minute``; a rejected row has its wait in seconds."""

    def step(state: dict | None, row: dict) -> tuple[dict, dict]:
        at = row["at_secs"]
        tokens = burst if state is None else min(burst, state["tokens"] + max(0.0, at - state["at"]) * per_minute / 60.0)
        if tokens >= 1.0:
            return {"tokens": tokens - 1.0, "at": at}, {"admitted": True, "wait_secs": 0.0}
        return {"tokens": tokens, "at": at}, {"admitted": False, "wait_secs": (1.0 - tokens) * 60.0 / per_minute}

    return step


class FoldProcessor(StatefulProcessor):
    """Runs a fold over each key's rows in the order of ``order``; one output row an input row."""

    def __init__(self, step, order: list[str], state_schema: StructType, out_columns: list[str]):
        self.step, self.order, self.state_schema, self.out_columns = step, order, state_schema, out_columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("fold", self.state_schema)
        self.fields = self.state_schema.fieldNames()

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        """A key begins with the state that a table has for it."""
        row = initialState.iloc[0]
        self.state.update(tuple(None if pd.isna(row[f]) else row[f] for f in self.fields))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).sort_values(self.order)
        state = dict(zip(self.fields, self.state.get(), strict=True)) if self.state.exists() else None
        out = []
        for row in frame.to_dict("records"):
            state, found = self.step(state, row)
            out.append({**row, **found})
        if state is not None:
            self.state.update(tuple(state[f] for f in self.fields))
        yield pd.DataFrame(out)[self.out_columns]

    def close(self) -> None:
        pass


class TimedFoldProcessor(FoldProcessor):
    """Runs a fold in order of event time and sequence: rows wait in list state until the watermark has passed them, later ones are dropped.

    A key holds the rows of one batch and of the watermark's delay, and one
    timer, for the earliest of them. The rows that a batch brings for a key are
    one element of the list, their columns as JSON, since each element and each
    call costs a way to the state store and back.
    """

    def __init__(self, step, key: str, waiting: StructType, state_schema: StructType, out_columns: list[str]):
        super().__init__(step, [], state_schema, out_columns)
        self.key, self.names = key, waiting.fieldNames()
        self.whole = {f.name for f in waiting.fields if isinstance(f.dataType, LongType)}

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.handle = handle
        self.held = handle.getListState("held", StructType([StructField("columns", StringType())]))
        self.next = handle.getValueState("next", StructType([StructField("millis", LongType())]))

    def _packed(self, frame: pd.DataFrame) -> tuple[str]:
        columns = [frame[n].tolist() for n in self.names]
        # a batch with nulls brings whole numbers as floats
        return (json.dumps([[None if pd.isna(x) else int(x) for x in c] if n in self.whole else c for n, c in zip(self.names, columns, strict=True)]),)

    def _wake_at(self, micros: int, before: int | None) -> None:
        millis = -(-micros // 1000)
        if before is not None and before <= millis:
            return
        if before is not None:
            self.handle.deleteTimer(before)
        self.handle.registerTimer(millis)
        self.next.update((millis,))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        passed, least = timerValues.getCurrentWatermarkInMs() * 1000, None
        for frame in rows:
            late = frame["at_micros"].to_numpy() <= passed
            if late.any():
                frame = frame[~late]
            if len(frame):
                self.held.appendValue(self._packed(frame))
                first = int(frame["at_micros"].min())
                least = first if least is None else min(least, first)
        if least is not None:
            before = self.next.get()
            self._wake_at(least, before[0] if before else None)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        held = sorted((r for (text,) in self.held.get() for r in zip(*json.loads(text), strict=True)), key=lambda r: (r[0], r[1] is not None, r[1] or 0))
        ready, later = [r for r in held if r[0] <= passed], [r for r in held if r[0] > passed]
        self.next.clear()  # its timer has just gone
        if later:
            self.held.put([(json.dumps(list(zip(*later, strict=True))),)])
            self._wake_at(later[0][0], None)
        else:
            self.held.clear()
        begun = self.state.get()
        state = dict(zip(self.fields, begun, strict=True)) if begun else None
        out = []
        for values in ready:
            row = dict(zip(self.names, values, strict=True))
            state, found = self.step(state, row)
            row.update(found)
            out.append([row[c] for c in self.out_columns[1:]])
        if state is not None:
            self.state.update(tuple(state[f] for f in self.fields))
        columns = zip(*out, strict=True) if out else [()] * (len(self.out_columns) - 1)
        yield pd.DataFrame({self.key: [key[0]] * len(out), **dict(zip(self.out_columns[1:], map(list, columns), strict=True))})


class HeartbeatProcessor(StatefulProcessor):
    """Emits a key's last beat when an event-time timer finds no beat for ``secs`` after it."""

    def __init__(self, secs: float):
        self.micros = int(secs * 1_000_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", StructType([StructField("at_micros", LongType())]))

    def _due(self, micros: int) -> int:
        """Timers are whole milliseconds: the first at which the silence is as long."""
        return -(-(micros + self.micros) // 1000)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        latest = max(int(f["at_micros"].max()) for f in rows)
        before = self.last.get()[0] if self.last.exists() else None
        if before is None or latest > before:
            if before is not None:
                self.handle.deleteTimer(self._due(before))
            self.last.update((latest,))
            self.handle.registerTimer(self._due(latest))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at = self.last.get()[0]
        self.last.clear()
        yield pd.DataFrame({"executor_id": [key[0]], "last_micros": [at]})

    def close(self) -> None:
        pass


class LatenessProcessor(StatefulProcessor):
    """Marks rows that lie more than a delay below the highest time that earlier batches brought for the key."""

    def __init__(self, delay_micros: int, out_columns: list[str]):
        self.delay, self.out_columns = delay_micros, out_columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.high = handle.getValueState("high", StructType([StructField("at_micros", LongType())]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        before = self.high.get()[0] if self.high.exists() else None
        now = before
        for frame in rows:
            at = frame["at_micros"]
            known = at.dropna()
            if len(known):
                now = int(known.max()) if now is None else max(now, int(known.max()))
            yield frame.assign(late=False if before is None else (at < before - self.delay).fillna(False).astype(bool))[self.out_columns]
        if now != before:
            self.high.update((now,))

    def close(self) -> None:
        pass


class TailProcessor(StatefulProcessor):
    """Keeps the last n lines of each key in list state and emits them after each batch."""

    def __init__(self, n: int):
        self.n = n

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.lines = handle.getListState("lines", StructType([StructField("line_no", LongType()), StructField("line", StringType())]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = [tuple(x) for x in self.lines.get()] if self.lines.exists() else []
        for frame in rows:
            held += list(zip(frame["line_no"].tolist(), frame["line"].tolist(), strict=True))
            held = sorted(held, key=lambda x: x[0])[-self.n :]
        self.lines.put(held)
        yield pd.DataFrame({"log_id": [key[0]] * len(held), "line_no": [a for a, _ in held], "line": [b for _, b in held]})

    def close(self) -> None:
        pass


def run_fold(df: DataFrame, key: str, values: dict[str, str], step, state_schema: str, out: str, ts: str | None = None, watermark: str = "0 seconds", order: str = "sequence", begun: DataFrame | None = None) -> DataFrame:
    """A fold over each key of (key, order, values): stateful on a stream, over sorted rows on a table.

    ``values`` are columns and their types, ``out`` what the fold adds to key
    and order. With an event time ``ts`` rows go by (ts, order), and those
    without a time are left out. On a stream they wait until the watermark
    passes them, so rows that arrive out of order within it change nothing, and
    rows beyond it are dropped. Without ``ts`` a stream folds rows as they come.
    ``begun``, for streams, has the state that some keys begin with, one row a
    key: the columns of ``state_schema``, as a fold over earlier rows left them.
    """
    first = None if begun is None else begun.select(key, *StructType.fromDDL(state_schema).fieldNames()).groupBy(key)
    out_schema = StructType.fromDDL(f"{key} {df.schema[key].dataType.simpleString()}, {order} long, {out}")
    slim = [key, F.col(order).cast("long"), *[F.col(c).cast(kind) for c, kind in values.items()]]
    if ts is None:
        rows = df.select(*slim)
        if not df.isStreaming:
            return fold_sorted(rows, [key], [order], step, out_schema)
        processor = FoldProcessor(step, [order], StructType.fromDDL(state_schema), out_schema.fieldNames())
        return rows.groupBy(key).transformWithStateInPandas(statefulProcessor=processor, outputStructType=out_schema, outputMode="append", timeMode="None", initialState=first)
    timed = df.filter(F.col(ts).isNotNull())
    at = F.unix_micros(F.col(ts).cast("timestamp")).alias("at_micros")
    if not df.isStreaming:
        return fold_sorted(timed.select(*slim, at), [key], ["at_micros", order], step, out_schema)
    waiting = StructType.fromDDL(", ".join(["at_micros long", f"{order} long", *[f"{c} {kind}" for c, kind in values.items()]]))
    processor = TimedFoldProcessor(step, key, waiting, StructType.fromDDL(state_schema), out_schema.fieldNames())
    watched = timed.select(*slim, at, F.col(ts).alias("__ts")).withWatermark("__ts", watermark)
    return watched.groupBy(key).transformWithStateInPandas(statefulProcessor=processor, outputStructType=out_schema, outputMode="append", timeMode="EventTime", initialState=first)


def _machine(df: DataFrame, key: str, moves: dict, ts: str | None, watermark: str, begun: DataFrame | None) -> DataFrame:
    out = "status string, fault string"
    if df.isStreaming:
        return run_fold(df, key, {"status": "string"}, fold_states(moves), "status string", out, ts, watermark, begun=begun)
    if begun is not None:
        raise ValueError("a table has all rows of a key; a state to begin with is for streams")
    schema = StructType.fromDDL(f"{key} {df.schema[key].dataType.simpleString()}, sequence long, {out}")
    timed = df if ts is None else df.filter(F.col(ts).isNotNull()).withColumn("at_micros", F.unix_micros(F.col(ts).cast("timestamp")))
    order = ["sequence"] if ts is None else ["at_micros", "sequence"]
    rows = timed.select(key, F.col("sequence").cast("long"), F.col("status").cast("string"), *order[:-1])
    return fold_transitions(rows, key, order, "status", moves, fold_states(moves), schema)


def node_states(df: DataFrame, ts: str | None = None, watermark: str = "0 seconds", begun: DataFrame | None = None) -> DataFrame:
    """``node_id, sequence, status, fault``: the state after each change; invalid ones are kept out and named.

    On a table a key may span many ranges (``fold_transitions``); with ``ts`` a
    stream goes by event time as in ``run_fold``, and ``begun`` (node_id,
    status) has the states that earlier rows led to.
    """
    return _machine(df, "node_id", NODE_MOVES, ts, watermark, begun)


def build_states(df: DataFrame, ts: str | None = None, watermark: str = "0 seconds", begun: DataFrame | None = None) -> DataFrame:
    """``build_id, sequence, status, fault``, as ``node_states``."""
    return _machine(df, "build_id", BUILD_MOVES, ts, watermark, begun)


def last_states(states: DataFrame, key: str) -> DataFrame:
    """``key, status``: where each key stands after the rows of ``node_states`` or ``build_states``, for a stream to begin with."""
    return states.groupBy(key).agg(F.max_by(F.coalesce("status", F.lit("")), "sequence").alias("status"))


def live_ema(df: DataFrame, key: str, alpha: float = 0.3, ts: str | None = None, watermark: str = "0 seconds") -> DataFrame:
    """``key, sequence, ema, n`` after each row of (key, sequence, value); by event time as in ``run_fold``."""
    return run_fold(df, key, {"value": "double"}, fold_ema(alpha), "ema double, n long", "ema double, n long", ts, watermark)


def rate_limit(df: DataFrame, key: str, per_minute: float, burst: float, ts: str | None = None, watermark: str = "0 seconds") -> DataFrame:
    """``key, sequence, admitted, wait_secs`` of each row of (key, sequence, at_secs); null and empty keys are one shared key, null."""
    if df.schema[key].dataType.simpleString() == "string":
        df = df.withColumn(key, F.nullif(F.col(key), F.lit("")))
    return run_fold(df, key, {"at_secs": "double"}, fold_bucket(per_minute, burst), "tokens double, at double", "admitted boolean, wait_secs double", ts, watermark)


def mark_late(stream: DataFrame, key: str, ts: str, delay_secs: float) -> DataFrame:
    """The stream's rows with ``late``: whether ``ts`` lies more than the delay below the highest that earlier batches brought for the key.

    Windows that end below a key's high-water mark less the delay are closed:
    counted over rows that are not late they don't change any more, and late
    rows can be kept apart and counted. The mark is keyed state and outlives a
    restart. Null keys are one key; a row without a time is on time.
    """
    out = StructType(list(stream.schema.fields)).add("late", "boolean")
    marked = stream.withColumn("at_micros", F.unix_micros(F.col(ts).cast("timestamp")))
    processor = LatenessProcessor(int(delay_secs * 1_000_000), out.fieldNames())
    return marked.groupBy(key).transformWithStateInPandas(statefulProcessor=processor, outputStructType=out, outputMode="append", timeMode="None")


def heartbeat_timeouts(stream: DataFrame, secs: float = 30, watermark: str = "0 seconds") -> DataFrame:
    """``executor_id, last_micros`` of executors that fell silent for ``secs`` of event time; beats without a time are left out."""
    timed = stream.filter("ts is not null").withColumn("at_micros", F.unix_micros("ts")).withWatermark("ts", watermark)
    return timed.groupBy("executor_id").transformWithStateInPandas(
        statefulProcessor=HeartbeatProcessor(secs), outputStructType=StructType.fromDDL("executor_id long, last_micros long"), outputMode="append", timeMode="EventTime"
    )


def live_tail(stream: DataFrame, n: int) -> DataFrame:
    """``log_id, line_no, line``: the last n lines of each log that a batch touched."""
    return stream.groupBy("log_id").transformWithStateInPandas(
        statefulProcessor=TailProcessor(n), outputStructType=StructType.fromDDL("log_id long, line_no long, line string"), outputMode="update", timeMode="None"
    )
