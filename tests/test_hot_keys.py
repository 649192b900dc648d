"""Keys that span many ranges, against plain Python."""

import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from kilnwork.operators.aggregates import merge_signatures, quantiles
from kilnwork.operators.joins import asof_join
from kilnwork.operators.windows import dispatch_wait, ema, ema_with_reset, log_tail, missed_heartbeats, phantoms, sequence_gaps, surplus_oldest, trailing_rate
from kilnwork.plans.jumps import NONE_YET, THROUGH, exits, first_overfull, stretches
from kilnwork.plans.running import PART, carry_forward, ranges, running_totals


@pytest.fixture
def uncoalesced(spark):
    """Small ranges stay apart."""
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(name, "false")
    yield spark
    spark.conf.unset(name)


def rows(n=600, seed=3):
    """(key, place, value): 'hot' has most rows, a null key some, 'none' no values."""
    rng = random.Random(seed)
    keys = ["hot"] * 8 + ["b", "c", None]
    found = [(rng.choice(keys), i, rng.choice([None, *range(1, 9)])) for i in range(n)]
    found += [("none", n + i, None) for i in range(5)]
    rng.shuffle(found)
    return [(k, p, None if v is None else float(v)) for k, p, v in found]


def by_key(data):
    out = {}
    for k, p, v in sorted(data, key=lambda r: r[1]):
        out.setdefault(k, []).append((p, v))
    return out


SHAPE = "k string, p long, v double"


def average(values):
    now = None
    for v in values:
        now = now if v is None else v if now is None else 0.3 * v + 0.7 * now
    return now


def test_totals_and_carried_values_over_ranges(uncoalesced):
    df = uncoalesced.createDataFrame(rows(), SHAPE)
    assert ranges(df, ["k", "p"]).select(PART).distinct().count() > 2
    got = [(r.k, r.p, r.n) for r in running_totals(df, [F.col("k"), F.col("p")], {"n": F.lit(1)}).collect()]
    assert sorted(n for _, _, n in got) == list(range(1, len(got) + 1))
    assert [r[:2] for r in sorted(got, key=lambda r: r[2])] == sorted(((k, p) for k, p, _ in rows()), key=lambda r: (r[0] is not None, r[0] or "", r[1]))
    own = {r.p: r.n for r in running_totals(df, [F.col("p")], {"n": F.lit(1)}, ["k"]).collect()}
    for held in by_key(rows()).values():
        assert [own[p] for p, _ in held] == list(range(1, len(held) + 1))
    carried = {r.p: r.last for r in carry_forward(df, ["k"], ["p"], "v", "last").collect()}
    for own in by_key(rows()).values():
        now = None
        for p, v in own:
            now = now if v is None else v
            assert carried[p] == now
    assert carry_forward(df.limit(0), ["k"], ["p"], "v", "last").count() == 0


def test_ema_of_a_hot_key(uncoalesced):
    df = uncoalesced.createDataFrame(rows(), SHAPE)
    got = {r.k: (r.ema_v, r.sample_count) for r in ema(df, ["k"], [F.col("p")], ["v"]).collect()}
    for k, own in by_key(rows()).items():
        want = average([v for _, v in own])
        assert got[k] == (want if want is None else pytest.approx(want), len(own))
    got = {r.k: r.ema_v for r in ema_with_reset(df, ["k"], [F.col("p")], "v", F.col("v") == 8).collect()}
    for k, own in by_key(rows()).items():
        values = [v for _, v in own]
        start = max((i for i, v in enumerate(values) if v == 8), default=0)
        want = average(values[start:])
        assert got[k] == (want if want is None else pytest.approx(want))


def test_asof_of_a_hot_key(uncoalesced):
    versions = [("hot", 10, 1.0), ("hot", 300, 2.0), ("b", 200, 3.0), (None, 5, 4.0)]
    joined = asof_join(uncoalesced.createDataFrame(rows(), SHAPE), uncoalesced.createDataFrame(versions, "k string, p long, c double"), "k", "p", "c")
    got = {r.p: r.c for r in joined.collect()}
    assert len(got) == len(rows())
    for k, p, _ in rows():
        assert got[p] == max(((at, c) for key, at, c in versions if key == k and at <= p), default=(0, None))[1]


def test_quantiles_of_a_hot_key(uncoalesced):
    df = uncoalesced.createDataFrame(rows(), SHAPE)
    got = {r.k: (r.p0, r.p50, r.p99, r.p100) for r in quantiles(df, "v", [0.0, 0.5, 0.99, 1.0], ["k"]).collect()}
    known = {k: sorted(v for _, v in own if v is not None) for k, own in by_key(rows()).items()}
    assert set(got) == set(known) and got["none"] == (None,) * 4
    for k, values in known.items():
        if values:
            assert (got[k][0], got[k][1], got[k][3]) == (values[0], statistics.median(values), values[-1])
            place = 0.99 * (len(values) - 1)
            low = values[int(place)]
            assert got[k][2] == pytest.approx(low + (values[min(int(place) + 1, len(values) - 1)] - low) * (place - int(place)))
    every = sorted(v for _, _, v in rows() if v is not None)
    assert quantiles(df, "v", [0.5]).first().p50 == statistics.median(every)
    assert quantiles(df.limit(0), "v", [0.5]).first().p50 is None


def test_signatures_beyond_the_cap(spark):
    paths = spark.createDataFrame([(1, ["a"]), (2, ["a"]), (3, ["a"])], "path_id long, signatures array<string>")
    more = spark.createDataFrame([(1, [f"s{i}" for i in range(50)]), (2, ["c", "b", "a"]), (2, ["b", None])], "path_id long, signatures array<string>")
    got = {r.path_id: (r.signatures, r.fault) for r in merge_signatures(paths, more.withColumn("signatures", F.array_compact("signatures")), cap=4).collect()}
    assert got == {1: (["a"], "too many"), 2: (["a", "b", "c"], None), 3: (["a"], None)}


def test_rows_before_over_stretches(spark):
    log = [("hot", i + (i > 200) + (i > 500)) for i in range(1, 700)] + [("hot", 50), ("hot", 64), (None, 1), (None, 3), ("b", 2)]
    got = sorted((r.build_id or "", r.sequence, r.fault) for r in sequence_gaps(spark.createDataFrame(log, "build_id string, sequence long"), width=32).collect())
    assert got == sorted([("hot", 50, "repeated"), ("hot", 64, "repeated"), ("hot", 202, "gap"), ("hot", 503, "gap"), ("", 3, "gap"), ("b", 2, "gap")])
    beats = spark.createDataFrame([("hot", i, i, "x" if i % 7 < 2 else None if i % 7 == 2 else "y") for i in range(400)] + [(None, 1, 1, "x"), (None, 2, 2, "x")], "executor_id string, s long, beat_id long, suspect string")
    beats = beats.withColumn("ts", F.timestamp_seconds("s").cast("timestamp_ntz"))
    want = {("hot", i) for i in range(1, 400) if i % 7 in (1, 4, 5, 6)} | {(None, 2)}
    for part in (None, F.date_trunc("minute", "ts")):
        assert {(r.executor_id, r.beat_id) for r in phantoms(beats, part).collect()} == want
    apart = beats.filter("beat_id < 100 or beat_id >= 350").unionByName(beats.filter("beat_id = 5").withColumn("ts", F.lit(None).cast("timestamp_ntz")))
    for part in (None, F.date_trunc("minute", "ts")):
        gaps = missed_heartbeats(apart, "1970-01-01 00:08:00", part=part)
        assert sorted((r.executor_id or "", r.gap_secs) for r in gaps.collect()) == [("", 478.0), ("hot", 81.0), ("hot", 251.0)]
    kinds = ["started", "other", "completed", "completed", "started", "started", "completed"]
    changes = spark.createDataFrame([("hot", i, kinds[i % 7], 10 * i) for i in range(210)] + [(None, 1, "completed", 1)], "build_id string, sequence long, kind string, s long")
    changes = changes.withColumn("ts", F.timestamp_seconds("s"))
    for part in (None, F.floor(F.col("sequence") / 16)):
        got = {(r.sequence, r.wait_secs) for r in dispatch_wait(changes, part=part).collect()}
        assert got == {(i, 20.0 if i % 7 == 2 else 10.0) for i in range(210) if i % 7 in (2, 6)}


def test_tails_and_surplus_of_a_hot_key(uncoalesced):
    lines = [("hot", i, f"l{i}") for i in range(1000)] + [("few", i, "f") for i in range(3)] + [(None, 7, "n")]
    for width in (1, 16, 4096):
        got = {(r.log_id, r.line_no) for r in log_tail(uncoalesced.createDataFrame(lines, "log_id string, line_no long, line string"), 40, since=1, width=width).collect()}
        assert got == {("hot", i) for i in range(960, 1000)} | {("few", 1), ("few", 2), (None, 7)}
    jobs = uncoalesced.createDataFrame([("hot", i, float(i)) for i in range(500)] + [(None, 900, 5.0), ("b", 901, 2.0)], "pool string, job_id long, age_secs double")
    queued = uncoalesced.createDataFrame([("hot", 480), ("b", 3)], "pool string, queued long")
    assert {(r.pool, r.job_id) for r in surplus_oldest(jobs, queued, 485.0).collect()} == {("hot", i) for i in range(485, 500)}
    assert {r.job_id for r in surplus_oldest(jobs, queued, 0.0).collect()} == {*range(480, 500), 900}


def test_trailing_rate_over_spans(spark):
    at = [("hot", t) for i in range(300) for t in [i * 7 % 1000] * (1 + i % 3)] + [(None, 5), (None, 9), ("b", None), ("b", None)]
    df = spark.createDataFrame([(k, t, n) for n, (k, t) in enumerate(at)], "k string, s long, n long").withColumn("ts", F.timestamp_seconds("s"))
    for span in (1, 100, 10**6):
        got = {r.n: r.rate for r in trailing_rate(df, 60, ["k"], span=span).collect()}
        assert got == {n: sum(1 for k2, t2 in at if k2 == k and (t2 is None if t is None else t2 is not None and t - 60 <= t2 <= t)) / 60 for n, (k, t) in enumerate(at)}


def test_state_machines_over_ranges(uncoalesced):
    """A hot key and a null key in many ranges give what one fold in order gives, faults included."""
    from kilnwork.plans.transitions import step_table
    from kilnwork.streaming import stateful as st

    rng = random.Random(5)
    states = [s for s in st.NODE_MOVES if s] + ["unknown", None]
    data = [(k, i, rng.choice(states)) for i in range(900) for k in ([8, 8, None, 3] if i % 3 else [8])]
    data = [(k, 4 * i + j, s) for j, (k, i, s) in enumerate(data)]
    df = uncoalesced.createDataFrame(data, "node_id long, sequence long, status string").repartition(7)
    assert ranges(df, ["node_id", "sequence"]).filter("node_id = 8").select(PART).distinct().count() > 2
    got = {(r.node_id, r.sequence): (r.status, r.fault) for r in st.node_states(df).collect()}
    want, now = {}, {}
    for k, i, s in sorted(data, key=lambda r: r[1]):
        now[k], fault = st.move(st.NODE_MOVES, now.get(k), s)
        want[k, i] = (now[k], fault)
    assert got == want
    names, steps = step_table(st.BUILD_MOVES)
    assert names[0] is None and all(len(t) == len(names) for t in steps.values()) and st.node_states(df.limit(0)).count() == 0


def overfull(held, most):
    """The first row of (place, at) at which a window holds too many, by one row after another."""
    start, count = None, 0
    for place, at in sorted(held, key=lambda r: r[0]):
        at = float("nan") if at is None else at
        if start is None or at - start >= 1.0:
            start, count = at, 0
        count += 1
        if count > most:
            return place
    return None


@pytest.mark.parametrize("most, step, back", [(3, 0.4, 0.0), (4, 0.3, 0.0), (6, 0.2, 0.9), (40, 0.05, 0.0), (90, 0.013, 0.3), (700, 0.0001, 0.0), (0, 1.0, 0.0), (5, 0.25, 0.0)])
def test_windows_of_lines_over_ranges(uncoalesced, most, step, back):
    rng = random.Random(most)
    now, data = {}, []
    for place in range(900):
        key = rng.choice(["hot"] * 9 + ["b", None])
        now[key] = now.get(key, 0.0) + rng.random() * 2 * step - (back if rng.random() < 0.02 else 0)
        data.append((key, place, None if rng.random() < 0.003 else round(now[key], 3)))
    rng.shuffle(data)
    df = uncoalesced.createDataFrame(data, "k string, place long, at double").repartition(12)
    held = {}
    for k, place, at in data:
        held.setdefault(k, []).append((place, at))
    expected = {(k, overfull(v, most)) for k, v in held.items() if overfull(v, most) is not None}
    assert {(r.k, r.place) for r in first_overfull(df, "k", "place", "at", most).collect()} == expected


def test_windows_that_meet_in_a_row_are_one():
    at = np.array([0.0, 0.4, 0.9, 1.3, 1.4, 2.4, 2.5])
    entries = [(p, -0.5 + p / 10) for p in range(-7, -1)]
    found = exits(at, 0, [(p, a) for p, a in entries], 7, 1.0)
    assert len(stretches(found)) < len(found)
    assert exits(at, 0, [(NONE_YET, 0.0)], 2, 1.0) == [(NONE_YET, 0, 2)]
    assert exits(at, 0, [(NONE_YET, 0.0)], 4, 1.0) == [(NONE_YET, 5, -1)]
    assert stretches(exits(np.array([]), 3, [(1, 0.0), (2, 0.1)], 5, 1.0)) == [(1, 2, THROUGH, -1)]


def test_windows_of_no_lines(spark):
    assert first_overfull(spark.createDataFrame([], "k long, place long, at double"), "k", "place", "at", 3).count() == 0
