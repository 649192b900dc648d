"""Queries over summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from kilnwork.operators import aggregates as a
from kilnwork.operators.joins import classify
from kilnwork.plans.stored import stored
from kilnwork.queries.registry import query
from kilnwork.queries.relational import CLASS_NAMES, CLASSES, CLASSIFIED_SQL, TERMINAL_SQL, classified

BAD_SQL, RUN_SQL, QUEUE_SQL = "('failed', 'poisoned', 'dependency_failed')", "('assigned', 'running')", "('created', 'queued', 'ready')"
SUMMARY_SQL = f"""
SELECT build_id, count(*) AS total, count(*) FILTER (WHERE status IN ('completed', 'skipped')) AS completed,
  count(*) FILTER (WHERE status IN {RUN_SQL}) AS running, count(*) FILTER (WHERE status IN {BAD_SQL}) AS failed,
  count(*) FILTER (WHERE status IN {QUEUE_SQL}) AS queued,
  coalesce(max(estimate) FILTER (WHERE status NOT IN {TERMINAL_SQL}), 0.0) AS critical_secs,
  coalesce(array_to_string(list_sort(list_distinct(list(executor_id) FILTER (WHERE status IN {RUN_SQL}))), ','), '') AS executors
FROM fx_build_nodes AS b JOIN fx_nodes AS n ON b.node_id = n.node_id GROUP BY build_id"""


def _summary(t):
    return a.build_summary(t.fx_build_nodes, t.fx_nodes.withColumnRenamed("estimate", "priority"))


@query("a1_build_counts", """
SELECT b.build_id, count(*) AS total, count(*) FILTER (WHERE status = 'completed') AS completed,
  count(*) FILTER (WHERE status = 'completed' AND b.node_id NOT IN (SELECT node_id FROM fx_assignments)) AS cached
FROM fx_build_nodes AS b JOIN fx_nodes AS n ON b.node_id = n.node_id GROUP BY b.build_id""")
def _(t):
    return a.build_counts(t.fx_build_nodes, t.fx_nodes, t.fx_assignments)


@query("a2_build_summary", SUMMARY_SQL)
def _(t):
    return _summary(t).withColumn("executors", F.array_join("executors", ","))


@query("a3_build_outcome", f"""
SELECT s.build_id, CASE WHEN completed >= total AND failed = 0 THEN 'succeeded' WHEN failed > 0 AND (completed + failed >= total OR NOT keep_going) THEN 'failed' ELSE 'active' END AS outcome
FROM ({SUMMARY_SQL}) AS s JOIN fx_builds AS b ON s.build_id = b.build_id""")
def _(t):
    return a.build_outcome(_summary(t), t.fx_builds)


@query("a4_cluster_snapshot", """
SELECT * FROM (SELECT count(*) AS executors, count(*) FILTER (WHERE busy) AS busy, count(*) FILTER (WHERE draining) AS draining,
    count(*) FILTER (WHERE registered AND NOT draining AND NOT busy) AS idle FROM fx_executors),
  (SELECT count(*) FILTER (WHERE status = 'active') AS active_builds, count(*) FILTER (WHERE status = 'pending') AS pending_builds FROM fx_builds),
  (SELECT count(*) FILTER (WHERE status IN ('assigned', 'running')) AS running, count(*) FILTER (WHERE status = 'ready') AS queued FROM fx_nodes),
  (SELECT string_agg(system || '=' || q, ',' ORDER BY system) AS queued_by_system FROM (SELECT system, count(*) AS q FROM fx_nodes WHERE status = 'ready' GROUP BY system))""")
def _(t):
    text = F.array_join(F.transform(F.map_entries("queued_by_system"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",")
    return a.cluster_snapshot(t.fx_executors, t.fx_builds, t.fx_nodes).withColumn("queued_by_system", text)


def _sized(t):
    h = t.fx_history.select("pname", "system", "ema_duration_secs", "ema_peak_memory_bytes", "ema_peak_cpu_cores")
    return classify(t.fx_nodes.join(h, ["pname", "system"], "left"), CLASSES, F.coalesce("ema_duration_secs", F.lit(30.0)), F.col("ema_peak_memory_bytes"), F.col("ema_peak_cpu_cores"))


SIZED_SQL = """
SELECT *, CASE least(slot + CASE WHEN coalesce(m > CASE slot WHEN 0 THEN 3.0e8 WHEN 1 THEN 6.0e8 ELSE 1.0e9 END, false)
    OR coalesce(c > CASE slot WHEN 0 THEN 4.0 WHEN 1 THEN 6.0 ELSE 8.0 END, false) THEN 1 ELSE 0 END, 2) WHEN 0 THEN 'small' WHEN 1 THEN 'medium' ELSE 'large' END AS size_class
FROM (SELECT n.*, CASE WHEN coalesce(ema_duration_secs, 30.0) <= 60 THEN 0 WHEN coalesce(ema_duration_secs, 30.0) <= 180 THEN 1 ELSE 2 END AS slot,
    ema_peak_memory_bytes AS m, ema_peak_cpu_cores AS c
  FROM fx_nodes AS n LEFT JOIN fx_history AS h ON n.pname = h.pname AND n.system = h.system)"""


@query("a5_class_snapshot", f"""
WITH c AS (SELECT size_class, system, count(*) FILTER (WHERE status = 'ready') AS queued, count(*) FILTER (WHERE status IN {RUN_SQL}) AS running
  FROM ({SIZED_SQL}) WHERE status IN ('ready', 'assigned', 'running') AND is_floating GROUP BY ALL)
SELECT k.name AS size_class, coalesce(system, '') AS system, coalesce(queued, 0) AS queued, coalesce(running, 0) AS running FROM fx_classes AS k LEFT JOIN c ON k.name = c.size_class""")
def _(t):
    return a.class_snapshot(_sized(t), CLASS_NAMES, F.col("is_floating"))


@query("a6_fixed_snapshot", f"""
WITH c AS (SELECT size_class, count(*) AS queued, count(*) FILTER (WHERE status IN {RUN_SQL}) AS running
  FROM ({SIZED_SQL}) WHERE status IN ('ready', 'assigned', 'running') AND is_fixed_output GROUP BY ALL)
SELECT k.name AS size_class, coalesce(queued, 0) AS queued, coalesce(running, 0) AS running FROM fx_classes AS k LEFT JOIN c ON k.name = c.size_class""")
def _(t):
    return a.fixed_output_snapshot(_sized(t), CLASS_NAMES)


@query("a7_class_system_rollup", f"""
SELECT size_class, system, count(*) AS n, round(sum(estimate), 6) AS secs, CAST(grouping(size_class, system) AS BIGINT) AS level FROM ({SIZED_SQL}) GROUP BY ROLLUP (size_class, system)""")
def _(t):
    return a.class_system_rollup(_sized(t)).withColumns({"secs": F.round("secs", 6), "level": F.col("level").cast("long")})


@query("a7_class_system_cube", f"""
SELECT size_class, system, count(*) AS n, CAST(grouping(size_class, system) AS BIGINT) AS level FROM ({SIZED_SQL}) GROUP BY CUBE (size_class, system)""")
def _(t):
    return a.class_system_rollup(_sized(t), "cube").drop("secs").withColumn("level", F.col("level").cast("long"))


@query("a8_pool_demand", f"""
WITH s AS (SELECT size_class, system, count(*) AS queued FROM ({SIZED_SQL}) WHERE status = 'ready' GROUP BY ALL),
p AS (SELECT n_nationkey AS pool, CASE n_nationkey % 3 WHEN 0 THEN 'small' WHEN 1 THEN 'medium' ELSE 'large' END AS size_class, n_nationkey % 4 = 0 AS gated,
  CASE WHEN n_nationkey % 2 = 0 THEN 'x86_64' ELSE 'aarch64' END AS system FROM nation)
SELECT pool, CAST(coalesce(sum(queued), 0) AS BIGINT) AS demand FROM p LEFT JOIN s ON s.system IN (p.system, 'builtin') AND (gated OR s.size_class = p.size_class) GROUP BY pool""")
def _(t):
    pools = t.nation.select(
        F.col("n_nationkey").alias("pool"), F.get(F.array(*[F.lit(c) for c in CLASS_NAMES]), F.col("n_nationkey") % 3).alias("size_class"), (F.col("n_nationkey") % 4 == 0).alias("gated"),
        F.array(F.when(F.col("n_nationkey") % 2 == 0, "x86_64").otherwise("aarch64")).alias("systems"),
    )
    return a.pool_demand(pools, a.class_snapshot(_sized(t).filter("status = 'ready'"), CLASS_NAMES))


@query("a9_samples_per_class", f"SELECT size_class, count(*) AS samples FROM ({CLASSIFIED_SQL}) GROUP BY size_class")
def _(t):
    return a.samples_per_class(classified(t))


@query("a10_name_means", "SELECT pname, round(avg(ema_duration_secs) + 1e-8, 6) AS mean_secs, count(*) AS systems FROM fx_history GROUP BY pname")
def _(t):
    return a.name_means(t.fx_history).withColumn("mean_secs", F.round(F.col("mean_secs") + 1e-8, 6))


USAGE_SQL = """
SELECT x.tenant_id, CAST(coalesce(u.used, 0) AS BIGINT) AS used,
  CASE WHEN gc_max_store_bytes IS NULL THEN 'unlimited' WHEN coalesce(u.used, 0) > gc_max_store_bytes THEN 'over' ELSE 'under' END AS verdict
FROM fx_tenants AS x LEFT JOIN (SELECT tenant_id, sum(nar_size) AS used FROM fx_path_tenants AS o JOIN fx_paths AS p ON o.path_id = p.path_id GROUP BY tenant_id) AS u ON x.tenant_id = u.tenant_id"""


@query("a11_tenant_usage", USAGE_SQL)
def _(t):
    return a.tenant_usage(t.fx_paths, t.fx_path_tenants, t.fx_tenants)


@query("a12_max_sequence", "SELECT build_id, max(sequence) AS last_sequence FROM fx_event_log GROUP BY build_id")
def _(t):
    return a.max_sequence(t.fx_event_log)


@query("a12_max_generation", "SELECT max(generation) AS generation FROM fx_assignments")
def _(t):
    return a.max_generation(t.fx_assignments)


@query("a13_queue_health", "SELECT count(*) FILTER (WHERE p_size < 10) AS pending, count(*) FILTER (WHERE p_size >= 10) AS stuck FROM part")
def _(t):
    return a.queue_health(t.part.withColumnRenamed("p_size", "attempts"))


@query("a14_trusted_keys", "SELECT DISTINCT s_nationkey AS tenant_id, unnest(['k' || s_suppkey % 7, 'k' || s_suppkey % 5]) AS key FROM supplier")
def _(t):
    key = lambda n: F.concat(F.lit("k"), (F.col("s_suppkey") % n).cast("string"))
    return a.trusted_keys(t.supplier.select(F.col("s_nationkey").alias("tenant_id"), F.array(key(7), key(5)).alias("keys")))


@query("a15_merge_signatures", """
WITH s AS (SELECT p.path_id, count(DISTINCT o.tenant_id) AS more FROM fx_paths AS p LEFT JOIN fx_path_tenants AS o ON o.path_id % 50 = p.path_id GROUP BY p.path_id)
SELECT path_id, CASE WHEN more + 1 > 4 THEN 1 ELSE more + 1 END AS n, CASE WHEN more + 1 > 4 THEN 'too many' END AS fault FROM s""")
def _(t):
    more = t.fx_path_tenants.select((F.col("path_id") % 50).alias("path_id"), F.array(F.concat(F.lit("t"), F.col("tenant_id").cast("string"))).alias("signatures"))
    paths = t.fx_paths.select("path_id", F.array(F.lit("own")).alias("signatures"))
    return a.merge_signatures(paths, more, cap=4).select("path_id", F.size("signatures").alias("n"), "fault")


@query("a16_dedup_ratio", """
SELECT blob_id, count(*) AS chunks, round(count(c.chunk_id) / count(*), 6) AS ratio FROM fx_chunk_entries AS e
LEFT JOIN (SELECT chunk_id FROM fx_chunks WHERE refcount > 1) AS c ON e.chunk_id = c.chunk_id GROUP BY blob_id""")
def _(t):
    return a.dedup_ratio(t.fx_chunk_entries, t.fx_chunks.filter("refcount > 1").select("chunk_id")).withColumn("ratio", F.round("ratio", 6))


@query("a17_load_fractions", f"SELECT size_class, round(sum(duration_secs) / (SELECT sum(duration_secs) FROM fx_samples), 6) AS fraction FROM ({CLASSIFIED_SQL}) GROUP BY size_class")
def _(t):
    return a.load_fractions(classified(t), CLASS_NAMES).withColumn("fraction", F.round("fraction", 6))


@query("a18_input_bytes", """
SELECT node_id, CAST(sum(coalesce(nar_size, 0)) AS BIGINT) AS input_bytes FROM (SELECT DISTINCT l_orderkey AS node_id, l_partkey AS path_id FROM lineitem) AS i
LEFT JOIN fx_paths AS p ON i.path_id = p.path_id GROUP BY node_id""")
def _(t):
    return a.input_bytes(t.lineitem.select(F.col("l_orderkey").alias("node_id"), F.col("l_partkey").alias("path_id")), t.fx_paths)


@query("a19_merged_options", """
SELECT node_id, coalesce(min(nullif(timeout_secs, 0)), 0) AS timeout_secs, max(cores) AS cores FROM fx_build_nodes AS m JOIN fx_builds AS b ON m.build_id = b.build_id GROUP BY node_id""")
def _(t):
    return a.merged_options(t.fx_build_nodes, t.fx_builds)


BUCKETS = (10, 50, 100, 200)


@query("a20_histogram", """
SELECT system, CAST(le AS DOUBLE) AS le, count(*) FILTER (WHERE duration_secs <= le) AS n FROM fx_samples, (SELECT unnest([10.0, 50.0, 100.0, 200.0, 1e300]) AS b)
CROSS JOIN LATERAL (SELECT CASE WHEN b > 1e200 THEN CAST('inf' AS DOUBLE) ELSE b END AS le) GROUP BY ALL""")
def _(t):
    return a.histogram(t.fx_samples, "duration_secs", BUCKETS, ["system"])


@query("a21_quantiles", """
SELECT pname, round(quantile_cont(duration_secs, 0.5), 6) AS p50, round(quantile_cont(duration_secs, 0.99), 6) AS p99 FROM fx_samples GROUP BY pname""")
def _(t):
    q = a.quantiles(t.fx_samples, "duration_secs", [0.5, 0.99], ["pname"])
    return q.select("pname", F.round("p50", 6).alias("p50"), F.round("p99", 6).alias("p99"))


@query("a22_distinct_counts", "SELECT pname, count(DISTINCT builder_id) AS distinct_builder_id, count(DISTINCT node_id) AS distinct_node_id FROM fx_samples GROUP BY pname")
def _(t):
    return a.distinct_counts(t.fx_samples, ["builder_id", "node_id"], ["pname"])


@query("a22_distinct_counts_approx")
def _(t):
    return a.distinct_counts(t.fx_samples, ["builder_id", "node_id"], ["pname"], approx=True)


def _daily(t):
    """Sketches of each class and month, stored as they would be day by day."""
    months = t.fx_samples.withColumn("month", F.date_trunc("month", "completed_at"))
    return stored(a.sketches(months, ["assigned_class", "month"], ["node_id", "l_orderkey"], ["duration_secs"]))


@query("a22_merged_sketches", """
SELECT assigned_class, count(DISTINCT node_id) AS nodes, count(DISTINCT l_orderkey) AS orders, true AS within FROM fx_samples GROUP BY assigned_class""")
def _(t):
    exact = a.distinct_counts(t.fx_samples, ["node_id", "l_orderkey"], ["assigned_class"])
    near = lambda c: F.abs(F.hll_sketch_estimate(f"{c}_sketch") - F.col(c)) <= F.col(c) * a.distinct_error()
    merged = a.merged_sketches(_daily(t), ["assigned_class"]).select("assigned_class", *[F.col(f"distinct_{c}").alias(f"distinct_{c}_sketch") for c in ("node_id", "l_orderkey")])
    both = exact.join(merged, "assigned_class")
    return both.select("assigned_class", F.col("distinct_node_id").alias("nodes"), F.col("distinct_l_orderkey").alias("orders"), (near("distinct_node_id") & near("distinct_l_orderkey")).alias("within"))


@query("a21_merged_sketches", """
SELECT assigned_class, p, count(*) AS n, true AS within FROM fx_samples, (VALUES (CAST(0.5 AS DOUBLE)), (CAST(0.9 AS DOUBLE)), (CAST(0.99 AS DOUBLE))) AS q(p) GROUP BY assigned_class, p""")
def _(t):
    merged = a.merged_sketches(_daily(t), ["assigned_class"])
    at = [F.struct(F.lit(p).alias("p"), F.kll_sketch_get_quantile_double("quantiles_duration_secs", F.lit(p)).alias("value")) for p in (0.5, 0.9, 0.99)]
    found = merged.select("assigned_class", F.inline(F.array(*at)))
    ranks = t.fx_samples.join(found, "assigned_class").groupBy("assigned_class", "p").agg(
        F.count("*").alias("n"), F.count_if(F.col("duration_secs") < F.col("value")).alias("below"), F.count_if(F.col("duration_secs") <= F.col("value")).alias("upto")
    )
    within = (F.col("below") / F.col("n") <= F.col("p") + a.RANK_ERROR) & (F.col("upto") / F.col("n") >= F.col("p") - a.RANK_ERROR)
    return ranks.select("assigned_class", "p", "n", within.alias("within"))


@query("a23_accuracy", """
SELECT s.system, count(*) AS samples, round(count(*) FILTER (WHERE duration_secs / ema_duration_secs BETWEEN 0.5 AND 2) / count(*), 6) AS within
FROM fx_samples AS s JOIN fx_history AS h ON s.pname = h.pname AND s.system = h.system WHERE ema_duration_secs > 0 GROUP BY s.system""")
def _(t):
    return a.accuracy(t.fx_samples, t.fx_history).withColumn("within", F.round("within", 6))


@query("a24_class_drift", f"""
SELECT assigned_class, count(*) FILTER (WHERE size_class = 'small') AS to_small, count(*) FILTER (WHERE size_class = 'medium') AS to_medium,
  count(*) FILTER (WHERE size_class = 'large') AS to_large FROM ({CLASSIFIED_SQL}) GROUP BY assigned_class""")
def _(t):
    return a.class_drift(classified(t), CLASS_NAMES)


@query("a25_misclassified", """
SELECT assigned_class, count(*) AS n FROM fx_samples WHERE duration_secs > 2 * CASE assigned_class WHEN 'small' THEN 60 WHEN 'medium' THEN 180 ELSE 400 END GROUP BY assigned_class""")
def _(t):
    return a.misclassified(t.fx_samples, {c[0]: c[1] for c in CLASSES})


@query("a26_unroutable", """
SELECT n.system, count(*) AS n FROM fx_nodes AS n WHERE status = 'ready' AND system <> 'builtin' AND NOT EXISTS (
  SELECT 1 FROM fx_executors AS e WHERE registered AND NOT busy AND e.system = n.system AND e.kind = CASE WHEN n.is_fixed_output THEN 'fetcher' ELSE 'builder' END AND executor_rank = 2 AND draining)
GROUP BY n.system""")
def _(t):
    return a.unroutable(t.fx_nodes, t.fx_executors.filter("not busy and executor_rank = 2 and draining"))


@query("a26_utilisation", "SELECT kind, round(count(*) FILTER (WHERE busy) / count(*), 6) AS utilisation, count(*) AS executors FROM fx_executors WHERE registered GROUP BY kind")
def _(t):
    return a.utilisation(t.fx_executors).withColumn("utilisation", F.round("utilisation", 6))


@query("a27_fleet_exhausted", """
WITH fleet AS (SELECT kind, executor_id FROM fx_executors WHERE registered AND draining),
hit AS (SELECT n.node_id, f.kind, count(DISTINCT f.executor_id) AS k FROM fx_samples AS s JOIN fx_nodes AS n ON s.node_id = n.node_id
  JOIN fleet AS f ON f.executor_id = s.builder_id AND f.kind = CASE WHEN n.is_fixed_output THEN 'fetcher' ELSE 'builder' END GROUP BY ALL)
SELECT node_id FROM hit JOIN (SELECT kind, count(*) AS n FROM fleet GROUP BY kind) AS z ON hit.kind = z.kind AND k = n""")
def _(t):
    return a.fleet_exhausted(t.fx_nodes, t.fx_samples, t.fx_executors.filter("draining"))
