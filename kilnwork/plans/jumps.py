"""Windows that begin where the one before ends, over keyed rows, a long key by ranges at once."""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kilnwork.plans.folds import fold_sorted
from kilnwork.plans.running import PART, ranges
from kilnwork.plans.stored import stored

#: Position of the window that a key's first row begins.
NONE_YET = -1
#: In place of a position: the window that was open before stays open.
THROUGH = -2
#: Rows looked at first for the end of a window.
LOOK = 64


def window_end(at: np.ndarray, begin: int, start: float, width: float, stop: int) -> int:
    """The first row from ``begin`` on, before ``stop``, that lies ``width`` or more after ``start``; ``stop`` if there is none."""
    look = LOOK
    while begin < stop:
        beyond = np.flatnonzero(at[begin : min(begin + look, stop)] - start >= width)
        if len(beyond):
            return begin + int(beyond[0])
        begin, look = begin + look, look * 2
    return stop


def exits(at: np.ndarray, base: int, entries: list[tuple[int, float]], most: int, width: float) -> list[tuple[int, int, int]]:
    """For each window that may be open before these rows, the position of the one open after them and of the first row too many.

    Rows have positions from ``base`` on. A window is known by the position
    of its first row. -1 stands for no row too many; beyond such a row nothing
    is followed.
    """
    n, known = len(at), {}

    def follow(begin: int, position: int, start: float) -> tuple[int, int, int]:
        """(beginning of the next window or n, position of this one, row too many) of a window of which rows from ``begin`` on are left."""
        limit = position + most - base
        stop = min(limit + 1, n)
        end = window_end(at, begin, start, width, stop)
        if end < stop:
            return end, position, -1
        return n, position, base + limit if limit < n else -1

    found = []
    for position, start in entries:
        end, last, over = (0, position, -1) if position == NONE_YET else follow(0, position, start)
        path = []
        while end < n and over < 0 and end not in known:
            path.append(end)
            end, last, over = follow(end + 1, base + end, at[end])
        if over < 0 and end < n:
            last, over = known[end]
        known.update(dict.fromkeys(path, (last, over)))
        found.append((position, last, over))
    return found


def stretches(found: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int]]:
    """(low, high, last, over): neighbouring entries of one outcome as one; ``last`` is THROUGH where entries stay open."""
    out: list[tuple[int, int, int, int]] = []
    for position, last, over in sorted(found):
        last = THROUGH if last == position or over >= 0 else last
        if out and out[-1][1] + 1 == position and out[-1][2:] == (last, over):
            out[-1] = (out[-1][0], position, last, over)
        else:
            out.append((position, position, last, over))
    return out


def first_overfull(df: DataFrame, key: str, order: str, at: str, most: int, width: float = 1.0) -> DataFrame:
    """``key, order`` of the first row of each key at which a window holds more than ``most`` rows.

    A key's first row begins a window. It ends before the first row that lies
    ``width`` or more after its beginning, which begins the next one. Times
    need not rise with ``order``; a null time is never beyond a window, and a
    window that begins with one never ends. Null keys are one key. An empty
    table gives an empty result. ``order`` is a whole number without nulls,
    rows that tie in it go by time.

    Rows are range-partitioned by key and order and stored, unless ``df`` is
    such a table of ``running.ranges``. Keys within one
    range are streamed, a batch at a time. Other keys, fewer than there are
    ranges, run in all their ranges at once: a range follows every window that
    may be open before its first row. Those begin in the ``most`` rows before
    it, as an older one would be overfull. Windows that meet in a row are one
    from there on, so the outcomes of a range are few stretches of entries,
    and a key is then followed from stretch to stretch.
    """
    kind = df.schema[key].dataType.simpleString()
    ranged = ranges(df, [key, order]).select(PART, F.col(key).alias("of"), F.col(order).cast("long").alias("place"), F.col(at).cast("double").alias("at"))
    parts = stored(ranged.groupBy(PART, "of").agg(F.count("*").alias("n")))
    several = parts.groupBy(F.col("of").alias("again")).agg(F.count("*").alias("parts")).filter("parts > 1").select("again")
    same = F.col("of").eqNullSafe(F.col("again"))

    within = ranged.join(F.broadcast(several), same, "left_anti")
    short = fold_sorted(within.select("of", "place", "at"), ["of"], ["place", "at"], _step(most, width), f"of {kind}, place long")

    before = Window.partitionBy("of").orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    pieces = stored(parts.join(F.broadcast(several), same, "left_semi").withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))))
    numbered = Window.partitionBy(PART, "of").orderBy("place", "at")
    placed = ranged.join(F.broadcast(pieces.select(F.col(PART).alias("__at"), F.col("of").alias("again"), "base")), (F.col(PART) == F.col("__at")) & same)
    placed = stored(placed.select(PART, "of", "place", "at", "base", (F.col("base") + F.row_number().over(numbered) - 1).alias("position")))

    # which pieces a piece may have open windows of: those with one of the most rows before it
    def reached(held: pd.DataFrame) -> pd.DataFrame:
        held, out = held.sort_values(PART, ignore_index=True), []
        for i in range(1, len(held)):
            j = i - 1
            while j >= 0 and held["base"][j] + held["n"][j] > held["base"][i] - most:
                out.append((held[PART][j], held["of"][j], held[PART][i], held["base"][i]))
                j -= 1
        return pd.DataFrame(out, columns=["from", "again", "to", "later"])

    opened = pieces.groupBy("of").applyInPandas(reached, f"from int, again {kind}, to int, later long")
    entries = placed.join(F.broadcast(opened), (F.col(PART) == F.col("from")) & same).filter(F.col("position") >= F.col("later") - most)
    entries = entries.select(F.col("to").alias(PART), "of", F.lit(None).cast("long").alias("place"), "at", F.col("later").alias("base"), "position")

    def cross(held: pd.DataFrame) -> pd.DataFrame:
        base, of, part = int(held["base"].iloc[0]), held["of"].iloc[0], held[PART].iloc[0]
        held = held.sort_values("position", ignore_index=True)
        old = held["position"] < base
        opened = list(zip(held["position"][old].tolist(), held["at"][old].tolist(), strict=True)) if base else [(NONE_YET, 0.0)]
        own = held[~old]
        places = own["place"].tolist()
        out = [(of, part, low, high, last, over, 0 if over < 0 else places[over - base]) for low, high, last, over in stretches(exits(own["at"].to_numpy(dtype=float), base, opened, most, width))]
        return pd.DataFrame(out, columns=["of", "part", "low", "high", "last", "over", "place"])

    crossed = placed.unionByName(entries).groupBy(PART, "of").applyInPandas(cross, f"of {kind}, part int, low long, high long, last long, over long, place long")

    def hop(state: dict | None, row: dict) -> tuple[dict, dict | None]:
        state = state or {"open": NONE_YET, "part": None, "over": False}
        if state["over"] or state["part"] == row["part"] or not row["low"] <= state["open"] <= row["high"]:
            return state, None
        over = row["over"] >= 0
        return {"open": state["open"] if row["last"] == THROUGH else row["last"], "part": row["part"], "over": over}, {} if over else None

    long = fold_sorted(crossed, ["of"], ["part", "low"], hop, f"of {kind}, place long")
    return short.unionByName(long).select(F.col("of").alias(key), F.col("place").alias(order))


def _step(most: int, width: float):
    """The same by one row after another."""

    def step(state: dict | None, row: dict) -> tuple[dict, dict | None]:
        if state is None or row["at"] - state["start"] >= width:
            state = {"start": row["at"], "held": 0, "over": bool(state and state["over"])}
        held = state["held"] + 1
        found = {} if held > most and not state["over"] else None
        return {**state, "held": held, "over": state["over"] or found is not None}, found

    return step
