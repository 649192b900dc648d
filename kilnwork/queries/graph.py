"""Queries over the dependency graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from kilnwork.operators import graph as g
from kilnwork.plans.stored import stored
from kilnwork.queries.registry import query
from kilnwork.queries.relational import TERMINAL_SQL, complete, seeds

LAYERS = 8


def _by_layer(value: str, edges: str, start: str) -> str:
    """Chained definitions v0, v1, ... with (node_id, value): layer by layer, children first."""
    parts = [f"e AS MATERIALIZED ({edges})", f"v0 AS MATERIALIZED (SELECT node_id, {start} AS value FROM fx_nodes WHERE layer = 0)"]
    below = "SELECT * FROM v0"
    for k in range(1, LAYERS):
        parts.append(f"v{k} AS MATERIALIZED (SELECT n.node_id, {value} AS value FROM fx_nodes AS n LEFT JOIN e ON e.parent_id = n.node_id LEFT JOIN ({below}) AS c ON c.node_id = e.child_id WHERE n.layer = {k} GROUP BY n.node_id, n.estimate, n.is_floating, n.layer)")
        below += f" UNION ALL SELECT * FROM v{k}"
    return "WITH " + ",\n".join(parts) + f"\nSELECT node_id, value FROM ({below})"


def _paths_sql(terminal: bool, estimate: str = "n.estimate") -> str:
    edges = "SELECT * FROM fx_edges" if terminal else f"SELECT e.* FROM fx_edges AS e JOIN fx_nodes AS c ON c.node_id = e.child_id WHERE c.status NOT IN {TERMINAL_SQL}"
    return _by_layer(f"{estimate} + coalesce(max(c.value), 0)", edges, estimate.replace("n.", ""))


def _rounded(sql: str) -> str:
    return sql.replace("SELECT node_id, value FROM (SELECT * FROM v0", "SELECT node_id, round(value, 4) AS value FROM (SELECT * FROM v0")


@query("g1_critical_path", _rounded(_paths_sql(False)))
def _(t):
    return g.critical_path(t.fx_nodes, t.fx_edges).withColumn("value", F.round("value", 4))


@query("g1_critical_path_all", _rounded(_paths_sql(True)))
def _(t):
    return g.critical_path(t.fx_nodes, t.fx_edges, exclude_terminal=False).withColumn("value", F.round("value", 4))


@query("g2_update_ancestors", _rounded(_paths_sql(False, "CASE WHEN n.is_floating AND n.layer = 1 THEN n.estimate * 9 ELSE n.estimate END")))
def _(t):
    live = stored(g.live_edges(t.fx_nodes, t.fx_edges))
    old = g.critical_path(t.fx_nodes, live, exclude_terminal=False)
    changed = t.fx_nodes.filter("is_floating and layer = 1").select("node_id", (F.col("estimate") * 9).alias("estimate"))
    return g.update_ancestors(t.fx_nodes, live, old, changed, exclude_terminal=False).withColumn("value", F.round("value", 4))


SEEDS_SQL = """SELECT path_id FROM fx_paths WHERE manifest_status = 'uploading' OR age_hours <= 2 UNION SELECT path_id FROM fx_pins UNION SELECT path_id FROM fx_paths WHERE source = 'src9'
UNION SELECT o.path_id FROM fx_path_tenants AS o JOIN fx_tenants AS x ON o.tenant_id = x.tenant_id WHERE ref_age_hours <= gc_retention_hours"""


@query("g3_mark_unreachable", f"""
WITH RECURSIVE reached(id) AS (SELECT path_id FROM ({SEEDS_SQL}) UNION SELECT r.ref_id FROM fx_path_refs AS r JOIN reached ON r.path_id = reached.id)
SELECT path_id FROM fx_paths WHERE manifest_status = 'complete' AND path_id NOT IN (SELECT id FROM reached)""")
def _(t):
    return g.mark_unreachable(t.fx_paths, t.fx_path_refs, seeds(t)).select("path_id")


@query("g4_closure", """
WITH RECURSIVE reached(id, level) AS (SELECT path_id, 0 FROM fx_pins UNION SELECT r.ref_id, level + 1 FROM fx_path_refs AS r JOIN reached ON r.path_id = reached.id)
SELECT path_id, nar_size, min(level) AS level FROM reached JOIN fx_paths ON path_id = id GROUP BY ALL""")
def _(t):
    return g.closure(t.fx_pins, t.fx_path_refs, t.fx_paths).select("path_id", "nar_size", "level")


STATES_SQL = """SELECT n.node_id, CASE WHEN bool_or(c.status IN ('poisoned', 'dependency_failed', 'cancelled')) THEN 'dependency_failed'
  WHEN count(e.child_id) = count(c.node_id) FILTER (WHERE c.status IN ('completed', 'skipped')) THEN 'ready' ELSE 'queued' END AS state
FROM fx_nodes AS n LEFT JOIN {edges} AS e ON e.parent_id = n.node_id LEFT JOIN {nodes} AS c ON c.node_id = e.child_id GROUP BY n.node_id"""


@query("g7_cascade_failure", """
WITH RECURSIVE fallen(id) AS (SELECT node_id FROM fx_nodes WHERE status = 'poisoned' UNION SELECT e.parent_id FROM fx_edges AS e JOIN fallen ON e.child_id = fallen.id
  JOIN fx_nodes AS n ON n.node_id = e.parent_id WHERE n.status IN ('created', 'queued', 'ready'))
SELECT id AS node_id FROM fallen WHERE id NOT IN (SELECT node_id FROM fx_nodes WHERE status = 'poisoned')""")
def _(t):
    return g.cascade_failure(t.fx_nodes.filter("status = 'poisoned'"), t.fx_edges, t.fx_nodes).select("node_id")


@query("g5_initial_states", STATES_SQL.format(edges="fx_edges", nodes="(SELECT * FROM fx_nodes WHERE status <> 'created')"))
def _(t):
    return g.initial_states(t.fx_nodes, t.fx_edges, t.fx_nodes.filter("status <> 'created'"))


@query("g6_newly_ready", f"""
WITH now AS (SELECT node_id, CASE WHEN status = 'running' THEN 'completed' ELSE status END AS status FROM fx_nodes),
p AS (SELECT DISTINCT parent_id FROM fx_edges AS e JOIN fx_nodes AS c ON c.node_id = e.child_id WHERE c.status = 'running')
SELECT node_id FROM ({STATES_SQL.format(edges='fx_edges', nodes='now')}) WHERE state = 'ready' AND node_id IN (SELECT parent_id FROM p) AND node_id IN (SELECT node_id FROM fx_nodes WHERE status = 'queued')""")
def _(t):
    return g.newly_ready(t.fx_nodes.filter("status = 'running'"), t.fx_edges, t.fx_nodes)


def _cut(t):
    return g.cascade_cutoff(t.fx_nodes.filter("status = 'completed'"), t.fx_edges, t.fx_nodes, t.fx_nodes.select("node_id"), max_nodes=10**9)[0]


#: By layer: 3 skipped, 2 completed, 1 otherwise terminal, 0 open.
CUT_SQL = _by_layer(
    f"CASE WHEN n.status = 'completed' THEN 2 WHEN n.status IN {TERMINAL_SQL} THEN 1 WHEN n.status = 'queued' AND count(e.child_id) = count(c.value) AND min(c.value) >= 1 AND max(c.value) >= 2 THEN 3 ELSE 0 END",
    "SELECT * FROM fx_edges",
    f"CASE WHEN status = 'completed' THEN 2 WHEN status IN {TERMINAL_SQL} THEN 1 ELSE 0 END",
).replace("n.estimate, n.is_floating, n.layer", "n.status")


@query("g8_cascade_cutoff", CUT_SQL.replace("SELECT node_id, value FROM (SELECT * FROM v0", "SELECT node_id FROM (SELECT * FROM v0") + " WHERE value = 3")
def _(t):
    return _cut(t).select("node_id")


@query("g9_seconds_saved", CUT_SQL.replace("SELECT node_id, value FROM (SELECT * FROM v0", "SELECT count(*) AS skipped, coalesce(round(sum(estimate), 4), 0) AS saved_secs FROM fx_nodes WHERE node_id IN (SELECT node_id FROM (SELECT * FROM v0") + " WHERE value = 3)")
def _(t):
    return g.seconds_saved(_cut(t), t.fx_nodes).withColumn("saved_secs", F.round("saved_secs", 4))


@query("g10_cycle_nodes", """
WITH RECURSIVE e AS (SELECT path_id AS a, ref_id AS b FROM fx_path_refs WHERE ref_id > 0 UNION SELECT 1, 40 UNION SELECT 3, 25),
r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT x.a AS id, min(x.b) AS component FROM r AS x JOIN r AS y ON x.a = y.b AND x.b = y.a GROUP BY x.a""")
def _(t):
    back = t.spark.createDataFrame([(1, 40), (3, 25)], "parent_id long, child_id long")
    refs = t.fx_path_refs.filter("ref_id > 0").select(F.col("path_id").alias("parent_id"), F.col("ref_id").alias("child_id"))
    return g.cycle_nodes(refs.union(back).distinct())


@query("g11_build_roots", """
SELECT b.build_id, b.node_id FROM fx_build_nodes AS b WHERE NOT EXISTS (
  SELECT 1 FROM fx_edges AS e JOIN fx_build_nodes AS p ON p.node_id = e.parent_id WHERE e.child_id = b.node_id AND p.build_id = b.build_id)""")
def _(t):
    return g.build_roots(t.fx_build_nodes, t.fx_edges)


@query("g12_dependents", """
WITH RECURSIVE above(id) AS (SELECT path_id FROM fx_pins UNION SELECT r.path_id FROM fx_path_refs AS r JOIN above ON r.ref_id = above.id) SELECT id FROM above""")
def _(t):
    deps = t.fx_path_refs.select(F.col("path_id").alias("id"), F.col("ref_id").alias("needs"))
    return g.dependents(t.fx_pins.select(F.col("path_id").alias("id")), deps, max_nodes=10**9).select("id")


@query("g13_merkle", _by_layer(
    "sha256(n.drv_hash || '|' || n.system || '#' || coalesce(string_agg(c.value, ',' ORDER BY c.value), ''))",
    "SELECT e.* FROM fx_edges AS e JOIN fx_nodes AS p ON p.node_id = e.parent_id WHERE NOT p.is_fixed_output",
    "sha256(drv_hash || '|' || system || '#')",
).replace("n.estimate, n.is_floating, n.layer", "n.drv_hash, n.system"))
def _(t):
    return g.merkle_fingerprint(t.fx_nodes, t.fx_edges, ["drv_hash", "system"])


@query("g14_needs_resolve", """
SELECT n.node_id, n.node_id IN (SELECT parent_id FROM fx_edges AS e JOIN fx_nodes AS c ON c.node_id = e.child_id WHERE c.is_floating) AS needs_resolve FROM fx_nodes AS n""")
def _(t):
    return g.needs_resolve(t.fx_nodes, t.fx_edges)


HITS_SQL = """SELECT node_id, bool_and(p.path_id IS NOT NULL) AS hit, bool_and(p.path_id IS NOT NULL OR s.path_id IS NOT NULL) AS fetchable FROM fx_outputs AS o
LEFT JOIN (SELECT path_id FROM fx_paths WHERE manifest_status = 'complete') AS p ON o.path_id = p.path_id
LEFT JOIN (SELECT DISTINCT path_id FROM fx_path_tenants) AS s ON s.path_id = o.path_id GROUP BY node_id"""


@query("g15_prune_to_roots", f"""
WITH h AS ({HITS_SQL}), r AS (SELECT b.build_id, b.node_id FROM fx_build_nodes AS b WHERE NOT EXISTS (
    SELECT 1 FROM fx_edges AS e JOIN fx_build_nodes AS p ON p.node_id = e.parent_id WHERE e.child_id = b.node_id AND p.build_id = b.build_id)),
short AS (SELECT build_id FROM r JOIN fx_nodes AS n ON n.node_id = r.node_id LEFT JOIN h ON h.node_id = r.node_id GROUP BY build_id HAVING bool_and(NOT is_floating AND coalesce(hit, false)))
SELECT build_id, node_id FROM r WHERE build_id IN (SELECT build_id FROM short)
UNION ALL SELECT build_id, node_id FROM fx_build_nodes WHERE build_id NOT IN (SELECT build_id FROM short)""")
def _(t):
    return g.prune_to_roots(t.fx_build_nodes, t.fx_edges, t.fx_nodes, t.fx_outputs, complete(t))


@query("g16_resurrect", """
WITH RECURSIVE dead AS (SELECT path_id FROM fx_paths WHERE age_hours > 300),
back(id) AS (
  SELECT r.ref_id FROM fx_path_refs AS r WHERE r.ref_id IN (SELECT path_id FROM dead) AND r.path_id NOT IN (SELECT path_id FROM dead)
  UNION SELECT path_id FROM dead WHERE path_id IN (SELECT path_id FROM fx_pins)
  UNION SELECT r.ref_id FROM fx_path_refs AS r JOIN back ON r.path_id = back.id WHERE r.ref_id IN (SELECT path_id FROM dead))
SELECT path_id FROM dead WHERE path_id NOT IN (SELECT id FROM back)""")
def _(t):
    return g.resurrect(t.fx_paths.filter("age_hours > 300"), t.fx_path_refs, t.fx_pins)


@query("g17_cache_probe", f"SELECT n.node_id, CASE WHEN hit THEN 'hit' WHEN fetchable THEN 'pending' ELSE 'miss' END AS verdict FROM fx_nodes AS n LEFT JOIN ({HITS_SQL}) AS h ON n.node_id = h.node_id")
def _(t):
    return g.cache_probe(t.fx_nodes, t.fx_outputs, complete(t), t.fx_path_tenants)


@query("g18_realised_hits", """
WITH w AS (SELECT o_orderkey AS key_id, 'out1' AS output_name FROM orders UNION ALL SELECT o_orderkey, 'out2' FROM orders WHERE o_orderstatus = 'F')
SELECT w.key_id FROM w LEFT JOIN fx_realisations AS r ON w.key_id = r.key_id AND w.output_name = r.output_name
LEFT JOIN (SELECT path_id FROM fx_paths WHERE manifest_status = 'complete') AS p ON p.path_id = r.path_id GROUP BY w.key_id HAVING bool_and(p.path_id IS NOT NULL)""")
def _(t):
    w = t.orders.select(F.col("o_orderkey").alias("key_id"), F.lit("out1").alias("output_name"))
    w = w.union(t.orders.filter("o_orderstatus = 'F'").select("o_orderkey", F.lit("out2")))
    return g.realised_hits(w, t.fx_realisations, complete(t))


@query("g19_merge_dag", """
WITH old AS (SELECT node_id, status, retry_count, pname FROM fx_nodes WHERE layer < 5), new AS (SELECT node_id, 'created' AS status, 0 AS retry_count, 'new' AS pname FROM fx_nodes WHERE layer > 2)
SELECT coalesce(old.node_id, new.node_id) AS node_id, CASE WHEN c = 'kept' THEN old.status ELSE new.status END AS status,
  CASE WHEN c IN ('kept', 'reset') THEN old.retry_count ELSE new.retry_count END AS retry_count, CASE WHEN c = 'kept' THEN old.pname ELSE new.pname END AS pname, c AS change
FROM old FULL JOIN new ON old.node_id = new.node_id CROSS JOIN LATERAL (SELECT CASE WHEN old.node_id IS NULL THEN 'inserted'
  WHEN new.node_id IS NOT NULL AND old.status IN ('failed', 'dependency_failed', 'cancelled') THEN 'reset' ELSE 'kept' END AS c)""")
def _(t):
    old = t.fx_nodes.filter("layer < 5").select("node_id", "status", "retry_count", "pname")
    new = t.fx_nodes.filter("layer > 2").select("node_id", F.lit("created").alias("status"), F.lit(0).alias("retry_count"), F.lit("new").alias("pname"))
    return g.merge_dag(old, t.fx_edges, new, t.fx_edges)[0]
