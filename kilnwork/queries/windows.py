"""Queries over ordered folds and rankings."""

from __future__ import annotations

from pyspark.sql import functions as F

from kilnwork.operators import windows as w
from kilnwork.queries.registry import query
from kilnwork.queries.views import AS_OF

ORDER = ["completed_at", "l_orderkey", "line_no", "node_id", "builder_id"]
ORDER_SQL = ", ".join(ORDER)
BACK_SQL = ", ".join(f"{c} DESC" for c in ORDER)


def _ema_sql(col: str, source: str = "fx_samples") -> str:
    return f"""SELECT pname, system, sum({col} * CASE WHEN up = 1 THEN 1.0 ELSE 0.3 END * pow(0.7, down - 1)) AS ema FROM (
  SELECT pname, system, {col}, row_number() OVER (PARTITION BY pname, system ORDER BY {ORDER_SQL}) AS up,
    row_number() OVER (PARTITION BY pname, system ORDER BY {BACK_SQL}) AS down FROM {source} WHERE {col} IS NOT NULL) GROUP BY pname, system"""


@query("w1_ema", f"""
SELECT d.pname, d.system, round(d.ema + 1e-9, 4) AS ema_duration_secs, round(m.ema, 2) AS ema_peak_memory_bytes, n.n AS sample_count
FROM ({_ema_sql('duration_secs')}) AS d LEFT JOIN ({_ema_sql('peak_memory_bytes')}) AS m ON d.pname = m.pname AND d.system = m.system
JOIN (SELECT pname, system, count(*) AS n FROM fx_samples GROUP BY pname, system) AS n ON d.pname = n.pname AND d.system = n.system""")
def _(t):
    out = w.ema(t.fx_samples, ["pname", "system"], [F.col(c) for c in ORDER], ["duration_secs", "peak_memory_bytes"], part=F.date_trunc("month", "completed_at"))
    return out.select("pname", "system", F.round(F.col("ema_duration_secs") + 1e-9, 4).alias("ema_duration_secs"), F.round("ema_peak_memory_bytes", 2).alias("ema_peak_memory_bytes"), "sample_count")


RESET_SQL = f"""(SELECT *, coalesce(sum(CASE WHEN duration_secs > 360 THEN 1 ELSE 0 END) OVER (PARTITION BY pname, system ORDER BY {BACK_SQL} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS later FROM fx_samples)"""


@query("w2_ema_with_reset", f"SELECT pname, system, round(ema + 1e-9, 4) AS ema_duration_secs FROM ({_ema_sql('duration_secs', f'(SELECT * FROM {RESET_SQL} WHERE later = 0)')})")
def _(t):
    out = w.ema_with_reset(t.fx_samples, ["pname", "system"], [F.col(c) for c in ORDER], "duration_secs", F.col("duration_secs") > 360, part=F.date_trunc("month", "completed_at"))
    return out.select("pname", "system", F.round(F.col("ema_duration_secs") + 1e-9, 4).alias("ema_duration_secs"))


@query("w3_ratchet_peak", """
SELECT h.pname, h.system, round(greatest(ema_peak_memory_bytes, peak), 2) AS ema_peak_memory_bytes FROM fx_history AS h LEFT JOIN (
  SELECT s.pname, s.system, max(peak_memory_bytes) AS peak FROM fx_samples AS s JOIN fx_nodes AS n ON s.node_id = n.node_id
  WHERE n.status NOT IN ('completed', 'skipped', 'poisoned', 'dependency_failed', 'cancelled') GROUP BY s.pname, s.system) AS o ON h.pname = o.pname AND h.system = o.system""")
def _(t):
    return w.ratchet_peak(t.fx_history, t.fx_samples, t.fx_nodes).select("pname", "system", F.round("ema_peak_memory_bytes", 2).alias("ema_peak_memory_bytes"))


@query("w4_equal_load_cutoffs", """
WITH g AS (SELECT duration_secs, sum(CAST(duration_secs AS DECIMAL(18, 6))) AS load FROM fx_samples GROUP BY duration_secs),
p AS (SELECT duration_secs, sum(load) OVER (ORDER BY duration_secs) AS upto, sum(load) OVER () AS total FROM g)
SELECT CAST(i AS INTEGER) AS number, round(0.3 * min(duration_secs) + 0.7 * i * 50, 6) AS cutoff FROM p, range(1, 4) AS r(i) WHERE upto * 4 >= total * i GROUP BY i""")
def _(t):
    return w.equal_load_cutoffs(t.fx_samples, 4, prev=[50.0, 100.0, 150.0]).withColumn("cutoff", F.round("cutoff", 6))


@query("w5_dispatch_rank", """
SELECT node_id, score, row_number() OVER (ORDER BY score DESC, arrival) AS place FROM (
  SELECT node_id, arrival, estimate + CASE WHEN node_id IN (SELECT node_id FROM fx_build_nodes AS m JOIN fx_builds AS b ON m.build_id = b.build_id
    WHERE priority_class = 'interactive' AND b.status = 'active') THEN 1e9 ELSE 0 END AS score FROM fx_nodes WHERE status = 'ready')""")
def _(t):
    return w.dispatch_rank(t.fx_nodes.withColumnRenamed("estimate", "priority"), t.fx_build_nodes, t.fx_builds.filter("status = 'active'"))


@query("w6_prefetch_paths", """
WITH r AS (SELECT n.node_id FROM fx_nodes AS n JOIN fx_build_nodes AS m ON n.node_id = m.node_id WHERE status = 'ready' GROUP BY n.node_id ORDER BY count(*) DESC, n.node_id LIMIT 32)
SELECT path_id, count(*) AS wanted FROM fx_edges AS e JOIN r ON e.parent_id = r.node_id JOIN fx_outputs AS o ON o.node_id = e.child_id GROUP BY path_id ORDER BY 2 DESC, 1 LIMIT 100""")
def _(t):
    return w.prefetch_paths(t.fx_nodes, t.fx_edges, t.fx_build_nodes, t.fx_outputs)


@query("w7_latest_per_key", """
SELECT node_id, generation, builder_id, status FROM fx_assignments
QUALIFY row_number() OVER (PARTITION BY node_id ORDER BY generation DESC, assigned_at DESC, line_no DESC, builder_id DESC, status DESC) = 1""")
def _(t):
    return w.latest_per_key(t.fx_assignments, ["node_id"], ["generation", "assigned_at", "line_no", "builder_id", "status"]).select("node_id", "generation", "builder_id", "status")


LINES_SQL = """
SELECT log_id, row_number() OVER (PARTITION BY log_id ORDER BY batch_no, i) - 1 AS line_no, line FROM (
  SELECT log_id, batch_no, unnest(string_split(batch_text, chr(10))) AS line, generate_subscripts(string_split(batch_text, chr(10)), 1) AS i FROM fx_lines)"""


@query("w8_log_tail", f"SELECT log_id, line_no, md5(line) AS line_md5 FROM ({LINES_SQL}) WHERE line_no >= 1 QUALIFY row_number() OVER (PARTITION BY log_id ORDER BY line_no DESC) <= 5")
def _(t):
    return w.log_tail(w.number_lines(t.fx_lines), 5, since=1).select("log_id", "line_no", F.md5("line").alias("line_md5"))


@query("w9_number_lines", f"SELECT log_id, line_no, md5(line) AS line_md5 FROM ({LINES_SQL})")
def _(t):
    return w.number_lines(t.fx_lines).select("log_id", "line_no", F.md5("line").alias("line_md5"))


@query("w10_log_violations", f"""
WITH l AS (SELECT log_id, line_no, sum(strlen(line)) OVER (PARTITION BY log_id ORDER BY line_no) AS upto FROM ({LINES_SQL})),
v AS (SELECT log_id, min(line_no) AS line_no, 0 AS rank FROM l WHERE upto > 1500 GROUP BY log_id
  UNION ALL SELECT log_id, min(line_no), 1 FROM l WHERE line_no % 10 = 8 GROUP BY log_id)
SELECT log_id, line_no, CASE rank WHEN 0 THEN 'size' ELSE 'rate' END AS fault FROM v QUALIFY row_number() OVER (PARTITION BY log_id ORDER BY line_no, rank) = 1""")
def _(t):
    timed = w.number_lines(t.fx_lines).withColumn("at_secs", F.col("line_no") / 10.0)
    return w.log_violations(timed, 1500, 8)


def _beats(t):
    return t.events.select(F.col("user_id").alias("executor_id"), "ts", F.col("event_id").alias("beat_id"), F.when(F.col("event_type") != "view", F.col("event_type")).alias("suspect"))


@query("w11_phantoms", """
SELECT executor_id, beat_id, suspect FROM (SELECT user_id AS executor_id, event_id AS beat_id, CASE WHEN event_type <> 'view' THEN event_type END AS suspect,
  lag(CASE WHEN event_type <> 'view' THEN event_type END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events) WHERE suspect = b""")
def _(t):
    return w.phantoms(_beats(t), F.date_trunc("day", "ts")).select("executor_id", "beat_id", "suspect")


@query("w12_missed_heartbeats", f"""
SELECT executor_id, ts, round(gap, 3) AS gap_secs FROM (SELECT user_id AS executor_id, ts,
  (epoch_us(coalesce(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id), TIMESTAMP '{AS_OF}')) - epoch_us(ts)) / 1e6 AS gap FROM events) WHERE gap >= 14400""")
def _(t):
    return w.missed_heartbeats(_beats(t), AS_OF, interval=4800, part=F.date_trunc("day", "ts")).withColumn("gap_secs", F.round("gap_secs", 3))


@query("w13_backoff", "SELECT p_partkey AS node_id, least(5.0 * pow(2.0, p_size), 300.0) AS wait_secs FROM part")
def _(t):
    return w.backoff_schedule(t.part.select(F.col("p_partkey").alias("node_id"), F.col("p_size").alias("attempt"))).select("node_id", "wait_secs")


@query("w14_overdue", f"""
SELECT l_orderkey, line_no, node_id, builder_id, greatest(duration_secs * 3, 7800.0) AS limit_secs FROM fx_samples WHERE epoch_us(TIMESTAMP '{AS_OF}') / 1e6 - epoch_us(completed_at) / 1e6 > greatest(duration_secs * 3, 7800.0)""")
def _(t):
    rows = t.fx_samples.withColumnsRenamed({"completed_at": "started_at", "duration_secs": "estimate"})
    return w.overdue_nodes(rows, AS_OF).select("l_orderkey", "line_no", "node_id", "builder_id", "limit_secs")


@query("w15_dispatch_wait", """
SELECT build_id, sequence, round((epoch_us(ts) - epoch_us(began)) / 1e6, 3) AS wait_secs FROM (SELECT *,
  max(CASE WHEN kind = 'started' THEN ts END) OVER b AS began, max(CASE WHEN kind = 'completed' THEN ts END) OVER b AS done
  FROM fx_event_log WINDOW b AS (PARTITION BY build_id ORDER BY sequence ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
WHERE kind = 'completed' AND began IS NOT NULL AND (done IS NULL OR began > done)""")
def _(t):
    return w.dispatch_wait(t.fx_event_log, part=F.floor(F.col("sequence") / 65536)).withColumn("wait_secs", F.round("wait_secs", 3))


@query("w16_sequence_gaps", """
WITH l AS (SELECT build_id, CASE WHEN kind = 'queued' THEN sequence - 1 ELSE sequence END AS sequence FROM fx_event_log)
SELECT build_id, sequence, CASE WHEN sequence = b THEN 'repeated' ELSE 'gap' END AS fault FROM (
  SELECT *, lag(sequence, 1, 0) OVER (PARTITION BY build_id ORDER BY sequence) AS b FROM l) WHERE sequence = b OR sequence > b + 1""")
def _(t):
    shifted = t.fx_event_log.withColumn("sequence", F.when(F.col("kind") == "queued", F.col("sequence") - 1).otherwise(F.col("sequence")))
    return w.sequence_gaps(shifted)


@query("w17_surplus_oldest", """
WITH j AS (SELECT o_orderkey AS job_id, o_orderpriority AS pool, o_totalprice AS age_secs FROM orders WHERE o_orderstatus = 'P'),
q AS (SELECT o_orderpriority AS pool, count(*) AS queued FROM orders WHERE o_orderstatus = 'O' AND o_totalprice > 20000 GROUP BY o_orderpriority)
SELECT job_id, pool FROM (SELECT *, row_number() OVER (PARTITION BY pool ORDER BY age_secs DESC, job_id) AS i, count(*) OVER (PARTITION BY pool) AS n FROM j) AS j JOIN q USING (pool)
WHERE i <= n - queued AND age_secs >= 1000""")
def _(t):
    jobs = t.orders.filter("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("job_id"), F.col("o_orderpriority").alias("pool"), F.col("o_totalprice").alias("age_secs"))
    queued = t.orders.filter("o_orderstatus = 'O' and o_totalprice > 20000").groupBy(F.col("o_orderpriority").alias("pool")).agg(F.count("*").alias("queued"))
    return w.surplus_oldest(jobs, queued, 1000).select("job_id", "pool")


@query("w18_trailing_rate", """
SELECT event_id, round(count(*) OVER (PARTITION BY kind ORDER BY CAST(floor(epoch(ts)) AS BIGINT) RANGE BETWEEN 300 PRECEDING AND CURRENT ROW) / 300.0, 6) AS rate FROM fx_event_log""")
def _(t):
    return w.trailing_rate(t.fx_event_log, 300, ["kind"]).select("event_id", F.round("rate", 6).alias("rate"))
