"""Queries over snapshots and events; streaming operators run here on the whole table at once."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import functions as F

from kilnwork.operators import snapshots as m
from kilnwork.operators.aggregates import tenant_usage
from kilnwork.queries.aggregates import USAGE_SQL
from kilnwork.queries.registry import query
from kilnwork.sources.versions import Snapshots
from kilnwork.streaming import events as e
from kilnwork.streaming import stateful as st
from kilnwork.streaming.runs import as_stream, fresh_folder, run_arrivals, run_stream

ORDER = ["small", "medium", "large"]


@query("m1_insert_if_absent", """
SELECT node_id, pname, false AS inserted FROM fx_nodes WHERE layer < 4 UNION ALL SELECT node_id, pname, true FROM fx_nodes WHERE layer >= 4 AND layer <> 6""")
def _(t):
    return m.insert_if_absent(t.fx_nodes.filter("layer < 4").select("node_id", "pname"), t.fx_nodes.filter("layer <> 6").select("node_id", "pname"), ["node_id"])


@query("m2_upsert", """
SELECT coalesce(o.node_id, n.node_id) AS node_id, CASE WHEN o.node_id IS NULL THEN n.retry_count WHEN n.node_id IS NULL THEN o.retry_count ELSE greatest(o.retry_count, n.retry_count) END AS retry_count,
  coalesce(n.pname, o.pname) AS pname FROM (SELECT * FROM fx_nodes WHERE layer < 5) AS o
FULL JOIN (SELECT node_id, 25 AS retry_count, CASE WHEN is_floating THEN NULL ELSE 'new' END AS pname FROM fx_nodes WHERE layer > 2) AS n ON o.node_id = n.node_id""")
def _(t):
    cols = ["node_id", "retry_count", "pname"]
    new = t.fx_nodes.filter("layer > 2").select("node_id", F.lit(25).alias("retry_count"), F.when(~F.col("is_floating"), F.lit("new")).alias("pname"))
    return m.upsert(t.fx_nodes.filter("layer < 5").select(*cols), new, ["node_id"], {"retry_count": F.greatest})


@query("m3_close_assignments", """
SELECT a.node_id, a.generation, a.line_no, a.builder_id, CASE WHEN a.status = 'acknowledged' AND n.status IN ('completed', 'skipped') THEN 'completed' WHEN a.status = 'acknowledged' AND n.status = 'cancelled' THEN 'cancelled'
  WHEN a.status = 'acknowledged' AND n.status IN ('poisoned', 'dependency_failed') THEN 'failed' ELSE a.status END AS status FROM fx_assignments AS a JOIN fx_nodes AS n ON a.node_id = n.node_id""")
def _(t):
    return m.close_assignments(t.fx_assignments, t.fx_nodes).select("node_id", "generation", "line_no", "builder_id", "status")


@query("m4_append_failed_builder", """
SELECT n.node_id, coalesce(string_agg(DISTINCT CAST(builder_id AS VARCHAR), ',' ORDER BY CAST(builder_id AS VARCHAR)), '') AS builders
FROM fx_nodes AS n LEFT JOIN (SELECT node_id, builder_id FROM fx_assignments WHERE status = 'failed' UNION ALL SELECT node_id, 1000 FROM fx_nodes) AS a ON a.node_id = n.node_id GROUP BY n.node_id""")
def _(t):
    nodes = t.fx_nodes.select("node_id", F.array(F.lit(1000).cast("long")).alias("failed_builders"))
    out = m.append_failed_builder(nodes, t.fx_assignments.filter("status = 'failed'"))
    return out.select("node_id", F.array_join(F.array_sort(F.col("failed_builders").cast("array<string>")), ",").alias("builders"))


@query("m5_clear_poison", "SELECT node_id, CASE WHEN status = 'poisoned' AND arrival % 48 > 24 THEN 'created' ELSE status END AS status FROM fx_nodes")
def _(t):
    kept, left = m.clear_poison(t.fx_nodes, F.col("arrival") % 48)
    return kept.unionByName(left).select("node_id", "status")


@query("m6_expire", "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 24 HOUR")
def _(t):
    return m.expire(t.events, "ts", "24 hours", "2024-01-20 00:00:00").select("event_id")


def _assignment_months(t):
    """Assignments in parts by month: the first version of a table that writers change."""
    rows = t.fx_assignments.withColumn("month", F.date_format("assigned_at", "yyyy-MM"))
    table = Snapshots(t.spark, fresh_folder(t.spark), rows.schema, F.col("month"))
    table.change(table.parts_of(rows), lambda _: rows)
    return table


@query("m2_snapshot_upsert", """
SELECT DISTINCT node_id, builder_id, generation, line_no, CASE WHEN status = 'acknowledged' AND generation % 3 = 1 THEN 'completed' WHEN generation % 3 = 2 THEN 'cancelled' ELSE status END AS status FROM fx_assignments""")
def _(t):
    table, keys = _assignment_months(t), ["node_id", "builder_id", "generation", "line_no", "assigned_at"]
    first = table.read()
    closed = first.filter("generation % 3 = 1 and status = 'acknowledged'").withColumn("status", F.lit("completed"))
    stopped = first.filter("generation % 3 = 2").withColumn("status", F.lit("cancelled"))
    with ThreadPoolExecutor(2) as writers:  # both change nearly every month, so one must do its change again
        list(writers.map(lambda rows: table.upsert(rows, lambda old, new: m.upsert(old, new, keys)), (closed, stopped)))
    return table.read().select(*keys[:-1], "status").distinct()


@query("m6_snapshot_expire", """
SELECT strftime(assigned_at, '%Y-%m') AS month, count(*) AS n, strftime(assigned_at, '%Y-%m') = '1996-03' AS written FROM fx_assignments
WHERE assigned_at >= DATE '1996-03-10' GROUP BY ALL""")
def _(t):
    table = _assignment_months(t)
    before = table.latest()
    after = table.expire("1996-03", F.col("assigned_at") >= F.lit("1996-03-10"))
    written = [p for p, folders in after.parts.items() if before.parts.get(p) != folders]
    return table.read(after).groupBy("month").agg(F.count("*").alias("n")).withColumn("written", F.col("month").isin(written))


@query("m7_promote_floor", """
WITH f AS (SELECT node_id, max(CASE assigned_class WHEN 'small' THEN 1 WHEN 'medium' THEN 2 END) AS r FROM fx_samples WHERE duration_secs > 300 GROUP BY node_id)
SELECT n.node_id, CASE WHEN r IS NULL THEN 'medium' WHEN is_fixed_output AND r = 1 THEN 'big' WHEN is_fixed_output THEN 'medium' WHEN r = 1 THEN 'medium' ELSE 'large' END AS floor FROM fx_nodes AS n LEFT JOIN f ON f.node_id = n.node_id""")
def _(t):
    failures = t.fx_samples.filter("duration_secs > 300").select("node_id", F.lit("resource").alias("reason"), F.col("assigned_class").alias("failed_class"))
    return m.promote_floor(t.fx_nodes.select("node_id", "is_fixed_output", F.lit("medium").alias("floor")), failures, ORDER, ["small", "big"]).select("node_id", "floor")


@query("m8_strip_features", "SELECT node_id, CASE WHEN is_floating THEN 'large' ELSE 'small' END AS floor, 'kvm' AS features FROM fx_nodes")
def _(t):
    features = F.when(F.col("is_floating"), F.array(F.lit("big"), F.lit("kvm"))).otherwise(F.array(F.lit("kvm")))
    out = m.strip_features(t.fx_nodes.select("node_id", F.lit("small").alias("floor"), features.alias("features")), {"big": "large"}, ORDER)
    return out.withColumn("features", F.array_join("features", ","))


@query("m9_violations", """
SELECT 'one active' AS rule, node_id AS id, count(*) AS n FROM fx_assignments WHERE status = 'acknowledged' GROUP BY node_id HAVING count(*) > 1
UNION ALL SELECT 'edge end', id, count(*) FROM (SELECT parent_id AS id FROM fx_edges UNION ALL SELECT child_id FROM fx_edges) WHERE id NOT IN (SELECT node_id FROM fx_nodes WHERE layer <> 3) GROUP BY id
UNION ALL SELECT 'status', node_id, 1 FROM fx_nodes WHERE layer <> 3 AND status = 'created'""")
def _(t):
    from kilnwork.operators.filters import DISPLAY

    return m.constraint_violations(t.fx_nodes.filter("layer <> 3"), t.fx_edges, t.fx_assignments, [s for s in DISPLAY if s != "created"])


@query("t1_ingest_events", "SELECT build_id, sequence, event_id FROM fx_event_log")
def _(t):
    twice = t.fx_event_log.union(t.fx_event_log)
    return e.ingest_events(twice).select("build_id", "sequence", "event_id")


@query("t2_replay", "SELECT sequence, kind FROM fx_event_log WHERE build_id = 8 AND sequence > 5 AND sequence <= 40")
def _(t):
    return e.replay(t.fx_event_log, 8, 5, 40).select("sequence", "kind")


@query("t3_outcome_counts", "SELECT date_trunc('minute', ts) AS window_start, kind, count(*) AS n FROM fx_event_log GROUP BY ALL")
def _(t):
    return e.outcome_counts(t.fx_event_log)


@query("t4_outcome_rate", """
SELECT date_trunc('minute', ts) - to_minutes(CAST(i AS INTEGER)) AS window_start, kind, round(count(*) / 300.0, 6) AS rate FROM fx_event_log, range(0, 5) AS r(i) GROUP BY ALL""")
def _(t):
    return e.outcome_rate(t.fx_event_log).withColumn("rate", F.round("rate", 6))


@query("t5_watch_sessions", """
WITH g AS (SELECT build_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 3 HOUR THEN 0 ELSE 1 END AS fresh FROM fx_event_log WINDOW w AS (PARTITION BY build_id ORDER BY ts)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY build_id ORDER BY ts) AS k FROM g)
SELECT build_id, min(ts) AS session_start, max(ts) + INTERVAL 3 HOUR AS session_end, count(*) AS n FROM s GROUP BY build_id, k""")
def _(t):
    return e.watch_sessions(t.fx_event_log, "3 hours")


#: What a stream's watermark has passed when its source ends: whole milliseconds, an hour behind.
CLOSED = "(SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 1 HOUR FROM fx_event_log)"


@query("t1_ingest_events_stream", "SELECT build_id, sequence, event_id FROM fx_event_log")
def _(t):
    log = _live_log(t)
    return run_stream(e.ingest_events(log.union(log)).select("build_id", "sequence", "event_id"))


@query("t3_outcome_counts_stream", f"""
SELECT date_trunc('minute', ts) AS window_start, kind, count(*) AS n FROM fx_event_log WHERE date_trunc('minute', ts) + INTERVAL 1 MINUTE <= {CLOSED} GROUP BY ALL""")
def _(t):
    return run_stream(e.outcome_counts(_live_log(t)))


@query("t4_outcome_rate_stream", f"""
SELECT date_trunc('minute', ts) - to_minutes(CAST(i AS INTEGER)) AS window_start, kind, round(count(*) / 300.0, 6) AS rate FROM fx_event_log, range(0, 5) AS r(i)
WHERE date_trunc('minute', ts) - to_minutes(CAST(i AS INTEGER)) + INTERVAL 5 MINUTE <= {CLOSED} GROUP BY ALL""")
def _(t):
    return run_stream(e.outcome_rate(_live_log(t))).withColumn("rate", F.round("rate", 6))


@query("t5_watch_sessions_stream", f"""
WITH g AS (SELECT build_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 3 HOUR THEN 0 ELSE 1 END AS fresh FROM fx_event_log WINDOW w AS (PARTITION BY build_id ORDER BY ts)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY build_id ORDER BY ts) AS k FROM g)
SELECT build_id, min(ts) AS session_start, max(ts) + INTERVAL 3 HOUR AS session_end, count(*) AS n FROM s GROUP BY build_id, k HAVING max(ts) + INTERVAL 3 HOUR <= {CLOSED}""")
def _(t):
    return run_stream(e.watch_sessions(_live_log(t), "3 hours"))


STATUS_OF = {"queued": "created", "started": "queued", "completed": "completed", "cached": "ready", "failed": "substituting"}
BUILD_OF = {"queued": "pending", "started": "active", "failed": "failed", "completed": "succeeded", "cached": "cancelled"}
#: Every step that is allowed, as the system described states them; none is the state before the first.
NODE_STEPS = """none>created created>completed ready>completed queued>completed poisoned>completed dependency_failed>completed created>queued queued>ready ready>assigned
 assigned>running assigned>ready running>completed running>failed running>poisoned ready>poisoned failed>ready created>dependency_failed queued>dependency_failed
 ready>dependency_failed poisoned>created completed>ready assigned>cancelled running>cancelled queued>skipped ready>skipped created>substituting queued>substituting
 ready>substituting substituting>completed substituting>ready substituting>queued substituting>cancelled completed>completed poisoned>poisoned
 dependency_failed>dependency_failed cancelled>cancelled skipped>skipped"""
BUILD_STEPS = "none>pending pending>active pending>cancelled active>succeeded active>failed active>cancelled"


def _states_sql(key: str, names: dict[str, str], steps: str) -> str:
    """A state machine row by row: a step that is not allowed leaves the state and is named."""
    to = "CASE kind " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in names.items()) + " END"
    allowed = "(" + ", ".join(f"'{x}'" for x in steps.split()) + ")"
    ok = f"coalesce(s.status, 'none') || '>' || c.wanted IN {allowed}"
    return f"""
WITH RECURSIVE c AS (SELECT build_id AS {key}, sequence, {to} AS wanted FROM fx_event_log),
s AS (SELECT DISTINCT {key}, CAST(0 AS BIGINT) AS sequence, CAST(NULL AS VARCHAR) AS status, CAST(NULL AS VARCHAR) AS fault FROM c
  UNION ALL SELECT c.{key}, c.sequence, CASE WHEN {ok} THEN c.wanted ELSE s.status END, CASE WHEN {ok} THEN NULL ELSE coalesce(s.status, 'none') || ' -> ' || c.wanted END
  FROM s JOIN c ON c.{key} = s.{key} AND c.sequence = s.sequence + 1)
SELECT {key}, sequence, status, fault FROM s WHERE sequence > 0"""


def _named(names: dict[str, str]):
    return F.element_at(F.create_map(*[x for k, v in names.items() for x in (F.lit(k), F.lit(v))]), F.col("kind"))


def _millis():
    """Watermarks are whole milliseconds, so with times as such the last row of a stream is passed, too."""
    return F.date_trunc("millisecond", F.col("ts").cast("timestamp")).alias("ts")


def _node_changes(log):
    return log.select(F.col("build_id").alias("node_id"), "sequence", _named(STATUS_OF).alias("status"), _millis())


def _build_changes(log):
    return log.select("build_id", "sequence", _named(BUILD_OF).alias("status"), _millis())


def _timed_requests(log):
    return log.select("build_id", "sequence", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at_secs"), _millis())


def _live_log(t):
    return as_stream(t.fx_event_log.withColumn("ts", F.col("ts").cast("timestamp")))


@query("t6_node_states", _states_sql("node_id", STATUS_OF, NODE_STEPS))
def _(t):
    return st.node_states(_node_changes(t.fx_event_log))


@query("t6_node_states_stream", _states_sql("node_id", STATUS_OF, NODE_STEPS))
def _(t):
    return run_stream(st.node_states(_node_changes(_live_log(t)), ts="ts"))


@query("t6_node_states_resumed", _states_sql("node_id", STATUS_OF, NODE_STEPS))
def _(t):
    earlier = st.node_states(_node_changes(t.fx_event_log.filter("ts < timestamp_ntz'2024-01-15 00:00:00'")))
    later = _live_log(t).filter("ts >= timestamp'2024-01-15 00:00:00'")
    return earlier.union(run_stream(st.node_states(_node_changes(later), ts="ts", begun=st.last_states(earlier, "node_id"))))


@query("t7_build_states", _states_sql("build_id", BUILD_OF, BUILD_STEPS))
def _(t):
    return st.build_states(_build_changes(t.fx_event_log))


@query("t7_build_states_stream", _states_sql("build_id", BUILD_OF, BUILD_STEPS))
def _(t):
    return run_stream(st.build_states(_build_changes(_live_log(t)), ts="ts"))


@query("s9_event_log_sink", "SELECT build_id, sequence, event_id FROM fx_event_log")
def _(t):
    path, log = fresh_folder(t.spark), as_stream(t.fx_event_log)
    for name in ("first", "second"):  # the second stream delivers every row again
        e.event_log_sink(log, path, fresh_folder(t.spark), name).trigger(availableNow=True).start().awaitTermination()
    return e.event_log(t.spark, path, log.schema).read().select("build_id", "sequence", "event_id")


@query("t8_heartbeat_timeouts", """
SELECT user_id AS executor_id, epoch_us(max(ts)) AS last_micros FROM events GROUP BY user_id HAVING max(ts) + INTERVAL 24 HOUR <= (SELECT max(ts) FROM events)""")
def _(t):
    beats = t.events.select(F.col("user_id").alias("executor_id"), F.col("ts").cast("timestamp").alias("ts"))
    return run_stream(st.heartbeat_timeouts(as_stream(beats), secs=86400))


@query("t13_live_tail", "SELECT build_id AS log_id, sequence AS line_no, kind AS line FROM fx_event_log QUALIFY row_number() OVER (PARTITION BY build_id ORDER BY sequence DESC) <= 3")
def _(t):
    lines = t.fx_event_log.select(F.col("build_id").alias("log_id"), F.col("sequence").cast("long").alias("line_no"), F.col("kind").alias("line"))
    return run_stream(st.live_tail(as_stream(lines), 3), "update")


@query("t8_silences", """
SELECT user_id AS executor_id, ts FROM (SELECT user_id, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events) WHERE n - ts >= INTERVAL 4 HOUR""")
def _(t):
    from kilnwork.operators.windows import missed_heartbeats

    beats = t.events.select(F.col("user_id").alias("executor_id"), "ts", F.col("event_id").alias("beat_id"))
    last = beats.groupBy("executor_id").agg(F.max("ts").alias("last"))
    return missed_heartbeats(beats, "2024-02-01 00:00:00", interval=4800, part=F.date_trunc("day", "ts")).join(last, "executor_id").filter("ts < last").select("executor_id", "ts")


EMA_SQL = """
WITH o AS (SELECT build_id, sequence, value FROM fx_event_log)
SELECT a.build_id, a.sequence, round(sum(b.value * CASE WHEN b.sequence = 1 THEN 1.0 ELSE 0.3 END * pow(0.7, a.sequence - b.sequence)) + 1e-9, 4) AS ema, count(*) AS n
FROM o AS a JOIN o AS b ON a.build_id = b.build_id AND b.sequence <= a.sequence GROUP BY a.build_id, a.sequence"""


@query("t9_live_ema", EMA_SQL)
def _(t):
    return st.live_ema(t.fx_event_log.select("build_id", "sequence", "value"), "build_id").withColumn("ema", F.round(F.col("ema") + 1e-9, 4))


BUCKET_SQL = """
WITH RECURSIVE c AS (SELECT build_id, sequence, epoch_us(ts) / CAST(1e6 AS DOUBLE) AS at_secs FROM fx_event_log),
s AS (SELECT build_id, CAST(0 AS BIGINT) AS sequence, CAST(3 AS DOUBLE) AS tokens, min(at_secs) AS at_secs, CAST(NULL AS BOOLEAN) AS admitted, CAST(0 AS DOUBLE) AS held FROM c GROUP BY build_id
  UNION ALL SELECT build_id, sequence, CASE WHEN held >= 1 THEN held - 1 ELSE held END, at_secs, held >= 1, held FROM (
    SELECT c.build_id, c.sequence, c.at_secs, least(CAST(3 AS DOUBLE), s.tokens + greatest(CAST(0 AS DOUBLE), c.at_secs - s.at_secs) * CAST(0.01 AS DOUBLE) / CAST(60 AS DOUBLE)) AS held
    FROM s JOIN c ON c.build_id = s.build_id AND c.sequence = s.sequence + 1))
SELECT build_id, sequence, admitted, round(CASE WHEN admitted THEN 0 ELSE (1 - held) * 60 / CAST(0.01 AS DOUBLE) END, 3) AS wait_secs FROM s WHERE sequence > 0"""


@query("t9_live_ema_stream", EMA_SQL)
def _(t):
    return run_stream(st.live_ema(_live_log(t).select("build_id", "sequence", "value", _millis()), "build_id", ts="ts")).withColumn("ema", F.round(F.col("ema") + 1e-9, 4))


@query("t10_rate_limit", BUCKET_SQL)
def _(t):
    return st.rate_limit(_timed_requests(t.fx_event_log), "build_id", per_minute=0.01, burst=3).withColumn("wait_secs", F.round("wait_secs", 3))


@query("t10_rate_limit_stream", BUCKET_SQL)
def _(t):
    return run_stream(st.rate_limit(_timed_requests(_live_log(t)), "build_id", per_minute=0.01, burst=3, ts="ts")).withColumn("wait_secs", F.round("wait_secs", 3))


@query("t11_quota_gate", f"""
SELECT event_id, coalesce(verdict <> 'over', true) AS admitted FROM events LEFT JOIN ({USAGE_SQL}) AS u ON u.tenant_id = user_id""")
def _(t):
    usage = tenant_usage(t.fx_paths, t.fx_path_tenants, t.fx_tenants)
    return e.quota_gate(t.events.withColumn("tenant_id", F.col("user_id")), usage).select("event_id", "admitted")


@query("t12_pair_start_finish", """
SELECT s.build_id, s.ts, f.ts AS f_ts, f.ts IS NULL AS timed_out FROM (SELECT * FROM fx_event_log WHERE kind = 'started') AS s
LEFT JOIN (SELECT * FROM fx_event_log WHERE kind = 'completed') AS f ON s.build_id = f.build_id AND f.ts >= s.ts AND f.ts <= s.ts + INTERVAL 6 HOUR""")
def _(t):
    log = t.fx_event_log.withColumn("node", F.lit(0))
    return e.pair_start_finish(log.filter("kind = 'started'"), log.filter("kind = 'completed'"), "6 hours").select("build_id", "ts", "f_ts", "timed_out")


@query("t12_pair_start_finish_stream", """
WITH s AS (SELECT * FROM fx_event_log WHERE kind = 'started'), f AS (SELECT * FROM fx_event_log WHERE kind = 'completed'),
w AS (SELECT least((SELECT date_trunc('milliseconds', max(ts)) FROM s), (SELECT date_trunc('milliseconds', max(ts)) FROM f)) - INTERVAL 1 HOUR AS passed)
SELECT s.build_id, s.ts, f.ts AS f_ts, f.ts IS NULL AS timed_out FROM s LEFT JOIN f ON s.build_id = f.build_id AND f.ts >= s.ts AND f.ts <= s.ts + INTERVAL 6 HOUR
WHERE f.ts IS NOT NULL OR s.ts + INTERVAL 6 HOUR < (SELECT passed FROM w)""")
def _(t):
    log = _live_log(t).withColumn("node", F.lit(0))
    return run_stream(e.pair_start_finish(log.filter("kind = 'started'"), log.filter("kind = 'completed'"), "6 hours").select("build_id", "ts", "f_ts", "timed_out"))


@query("t13_tail", "SELECT build_id AS log_id, sequence AS line_no FROM fx_event_log QUALIFY row_number() OVER (PARTITION BY build_id ORDER BY sequence DESC) <= 3")
def _(t):
    from kilnwork.operators.windows import log_tail

    return log_tail(t.fx_event_log.select(F.col("build_id").alias("log_id"), F.col("sequence").alias("line_no")), 3)


@query("t14_late_rows", """
WITH r AS (SELECT event_id, event_type, ts, event_id % 5 = 0 AS second FROM events),
h AS (SELECT event_type, max(ts) AS high FROM r WHERE NOT second GROUP BY event_type)
SELECT event_id, second AND coalesce(ts < high - INTERVAL 240 HOUR, false) AS late FROM r LEFT JOIN h ON h.event_type = r.event_type""")
def _(t):
    rows = t.events.withColumn("ts", F.col("ts").cast("timestamp"))
    arrivals = [rows.filter("event_id % 5 <> 0"), rows.filter("event_id % 5 = 0")]
    return run_arrivals(arrivals, lambda stream: st.mark_late(stream, "event_type", "ts", 240 * 3600)).select("event_id", "late")


@query("t14_late_counts", """
WITH r AS (SELECT event_type, ts, event_id % 5 = 0 AS second FROM events),
h AS (SELECT event_type, max(ts) AS high FROM r WHERE NOT second GROUP BY event_type),
m AS (SELECT r.event_type, date_trunc('day', ts) AS window_start, second AND coalesce(ts < high - INTERVAL 240 HOUR, false) AS late FROM r LEFT JOIN h ON h.event_type = r.event_type)
SELECT event_type, window_start, count(*) FILTER (WHERE NOT late) AS n, count(*) FILTER (WHERE late) AS late FROM m GROUP BY ALL""")
def _(t):
    rows = t.events.withColumn("ts", F.col("ts").cast("timestamp"))
    arrivals = [rows.filter("event_id % 5 <> 0"), rows.filter("event_id % 5 = 0")]
    return e.count_late(run_arrivals(arrivals, lambda stream: st.mark_late(stream, "event_type", "ts", 240 * 3600)), "event_type", "1 day")


@query("t15_alerts", """
SELECT date_trunc('hour', ts) AS window_start, CASE kind WHEN 'failed' THEN 'failures' ELSE 'cached' END AS rule, count(*) AS value FROM fx_event_log WHERE kind IN ('failed', 'cached')
GROUP BY date_trunc('hour', ts), kind HAVING count(*) > CASE kind WHEN 'failed' THEN 4 ELSE 5 END""")
def _(t):
    return e.alerts(t.fx_event_log, [("failures", "failed", 4), ("cached", "cached", 5)], "1 hour")


@query("t15_alerts_stream", f"""
SELECT date_trunc('hour', ts) AS window_start, CASE kind WHEN 'failed' THEN 'failures' ELSE 'cached' END AS rule, count(*) AS value FROM fx_event_log WHERE kind IN ('failed', 'cached')
GROUP BY date_trunc('hour', ts), kind HAVING count(*) > CASE kind WHEN 'failed' THEN 4 ELSE 5 END AND date_trunc('hour', ts) + INTERVAL 1 HOUR <= {CLOSED}""")
def _(t):
    return run_stream(e.alerts(_live_log(t), [("failures", "failed", 4), ("cached", "cached", 5)], "1 hour"))
