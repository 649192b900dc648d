"""Views that give the tables the shape of build and store data; the SQL runs on Spark and DuckDB alike.

A part is a node of a build graph, an order a build, a line item an assignment
and a sample, a supplier an executor, an event a logged build event, a
document a stored path. Edges point from a node to one it needs, and always
from a higher to a lower ``node_id % 8``, so the graph has no cycle. The lowest
layer is done but for a few nodes that run, so that some of the next are ready.
"""

from __future__ import annotations

#: What replaces the present time.
AS_OF = "2024-02-01 00:00:00"

VIEWS: dict[str, str] = {
    "fx_nodes": """
SELECT p_partkey AS node_id, concat('n', CAST(p_partkey AS VARCHAR(20))) AS drv_hash, p_name AS pname, p_partkey % 8 AS layer,
  CASE p_partkey % 3 WHEN 0 THEN 'x86_64' WHEN 1 THEN 'aarch64' ELSE 'builtin' END AS system,
  p_brand = 'Brand#7' AS is_fixed_output, p_type = 'PROMO' AS is_floating,
  CASE CASE WHEN p_partkey % 8 > 0 THEN (p_partkey * 7) % 20 WHEN p_partkey % 160 = 0 THEN 5 ELSE 19 END
    WHEN 0 THEN 'poisoned' WHEN 1 THEN 'failed' WHEN 2 THEN 'dependency_failed' WHEN 3 THEN 'cancelled'
    WHEN 4 THEN 'skipped' WHEN 5 THEN 'running' WHEN 6 THEN 'assigned' WHEN 7 THEN 'ready'
    WHEN 8 THEN 'substituting' WHEN 9 THEN 'created' WHEN 10 THEN 'queued' WHEN 11 THEN 'queued'
    WHEN 12 THEN 'queued' WHEN 13 THEN 'ready' ELSE 'completed' END AS status,
  p_size AS retry_count, p_retailprice AS estimate, p_partkey % 100 AS executor_id, p_partkey AS arrival
FROM part""",
    "fx_edges": """
SELECT DISTINCT a.l_partkey AS parent_id, b.l_partkey AS child_id
FROM lineitem AS a JOIN lineitem AS b ON a.l_orderkey = b.l_orderkey
WHERE a.l_partkey % 8 > b.l_partkey % 8""",
    "fx_builds": """
SELECT o_orderkey AS build_id, c_nationkey AS tenant_id,
  CASE o_orderstatus WHEN 'F' THEN 'succeeded' WHEN 'O' THEN 'active' ELSE 'pending' END AS status,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'interactive' WHEN '2-HIGH' THEN 'ci' ELSE 'scheduled' END AS priority_class,
  o_orderkey % 2 = 0 AS keep_going, o_orderdate AS submitted_at, CAST(floor(o_totalprice) AS BIGINT) % 5 * 60 AS timeout_secs, o_orderkey % 9 AS cores
FROM orders JOIN customer ON o_custkey = c_custkey""",
    "fx_build_nodes": """
SELECT DISTINCT l_orderkey AS build_id, l_partkey AS node_id FROM lineitem""",
    "fx_assignments": """
SELECT l_partkey AS node_id, l_suppkey AS builder_id, l_orderkey AS generation,
  CASE l_returnflag WHEN 'A' THEN 'completed' WHEN 'R' THEN 'failed' ELSE 'acknowledged' END AS status,
  l_shipdate AS assigned_at, l_linenumber AS line_no
FROM lineitem WHERE l_linestatus = 'F'""",
    "fx_executors": """
SELECT s_suppkey AS executor_id, CASE s_suppkey % 3 WHEN 0 THEN 'x86_64' WHEN 1 THEN 'aarch64' ELSE 'builtin' END AS system,
  CASE WHEN s_nationkey % 10 = 0 THEN 'fetcher' ELSE 'builder' END AS kind,
  s_nationkey % 7 = 0 AS draining, s_nationkey % 13 = 0 AS degraded, s_nationkey <> 3 AS registered, s_nationkey = 4 AS closed, s_suppkey % 4 = 0 AS busy,
  s_nationkey % 3 AS executor_rank, s_nationkey % 2 = 0 AS has_kvm,
  CASE WHEN s_suppkey % 4 = 0 THEN s_suppkey ELSE NULL END AS running_node, CAST(floor(s_acctbal) AS BIGINT) AS memory_total
FROM supplier""",
    "fx_samples": """
SELECT p_name AS pname, CASE l_suppkey % 2 WHEN 0 THEN 'x86_64' ELSE 'aarch64' END AS system,
  l_quantity * (1 + l_partkey % 9) AS duration_secs,
  CASE WHEN l_partkey % 10 = 0 THEN NULL ELSE l_extendedprice * 10000 END AS peak_memory_bytes,
  CASE WHEN l_partkey % 6 = 0 THEN NULL ELSE l_tax * 100 END AS peak_cpu_cores,
  CASE WHEN l_quantity < 20 THEN 'small' WHEN l_quantity < 40 THEN 'medium' ELSE 'large' END AS assigned_class,
  l_shipdate AS completed_at, l_orderkey, l_linenumber AS line_no, l_partkey AS node_id, l_suppkey AS builder_id
FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "fx_classes": """
SELECT 'small' AS name, CAST(60 AS DOUBLE) AS cutoff_secs, CAST(300000000 AS DOUBLE) AS mem_limit_bytes, CAST(4 AS DOUBLE) AS cpu_limit_cores, 0 AS place
UNION ALL SELECT 'medium', CAST(180 AS DOUBLE), CAST(600000000 AS DOUBLE), CAST(6 AS DOUBLE), 1
UNION ALL SELECT 'large', CAST(400 AS DOUBLE), CAST(1000000000 AS DOUBLE), CAST(8 AS DOUBLE), 2""",
    "fx_history": """
SELECT pname, system, round(avg(duration_secs), 6) AS ema_duration_secs, round(avg(peak_memory_bytes), 2) AS ema_peak_memory_bytes,
  round(avg(peak_cpu_cores), 6) AS ema_peak_cpu_cores, count(*) AS sample_count
FROM fx_samples WHERE assigned_class <> 'large' GROUP BY pname, system""",
    "fx_event_log": """
SELECT user_id AS build_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sequence,
  CASE event_type WHEN 'signup' THEN 'queued' WHEN 'view' THEN 'started' WHEN 'click' THEN 'completed'
    WHEN 'purchase' THEN 'cached' ELSE 'failed' END AS kind,
  ts, value, event_id
FROM events""",
    "fx_paths": """
SELECT doc_id AS path_id,
  concat('/store/', translate(md5(CAST(doc_id AS VARCHAR(20))), 'e', 'z'), '-doc', CAST(doc_id AS VARCHAR(20))) AS store_path,
  translate(md5(CAST(doc_id AS VARCHAR(20))), 'e', 'z') AS hash_part, n_chars AS nar_size, md5(text) AS nar_hash,
  CASE WHEN source = 'src3' THEN 'uploading' ELSE 'complete' END AS manifest_status,
  (doc_id * 37) % 1000 AS age_hours, lang, source
FROM documents""",
    "fx_path_refs": """
SELECT doc_id AS path_id, CAST(floor(doc_id / 2.0) AS BIGINT) AS ref_id FROM documents WHERE doc_id > 0 AND source <> 'src1'
UNION SELECT doc_id AS path_id, CAST(floor(doc_id / 3.0) AS BIGINT) AS ref_id FROM documents WHERE doc_id > 0 AND lang = 'fr'""",
    "fx_tenants": """
SELECT n_nationkey AS tenant_id, n_name AS tenant_name, 24 * (1 + n_nationkey % 10) AS gc_retention_hours,
  CASE WHEN n_nationkey % 5 = 0 THEN NULL ELSE 4000 * n_nationkey END AS gc_max_store_bytes
FROM nation""",
    "fx_path_tenants": """
SELECT doc_id AS path_id, doc_id % 25 AS tenant_id, (doc_id * 13) % 700 AS ref_age_hours FROM documents WHERE lang <> 'de'""",
    "fx_pins": """
SELECT doc_id AS path_id, concat('n', CAST(doc_id * 3 AS VARCHAR(20))) AS drv_hash FROM documents WHERE source = 'src5'""",
    "fx_outputs": """
SELECT p_partkey AS node_id, concat('out', CAST(p_size % 3 AS VARCHAR(20))) AS output_name, p_partkey % 700 AS path_id FROM part
UNION SELECT p_partkey AS node_id, 'dev' AS output_name, p_partkey % 900 AS path_id FROM part WHERE p_type = 'ECONOMY'""",
    "fx_realisations": """
SELECT l_orderkey AS key_id, concat('out', CAST(l_linenumber AS VARCHAR(20))) AS output_name, min(l_partkey) AS path_id, min(l_shipdate) AS created_at
FROM lineitem GROUP BY l_orderkey, concat('out', CAST(l_linenumber AS VARCHAR(20)))""",
    "fx_lines": """
SELECT conv_id AS log_id, turn AS batch_no, role, text AS batch_text FROM conversations""",
    "fx_kv_text": """
SELECT path_id, concat('StorePath: ', store_path, chr(10), 'URL: file/', nar_hash, chr(10),
    CASE WHEN lang = 'es' THEN '' ELSE concat('Compression: none', chr(10)) END,
    CASE WHEN source = 'src4' THEN concat('URL: again', chr(10)) ELSE '' END,
    'NarHash: md5:', nar_hash, chr(10), 'NarSize: ', CAST(nar_size AS VARCHAR(20)), chr(10),
    'References: a b  c', chr(10), 'Sig: k1:aa', chr(10), 'Sig: k2:bb', chr(10), 'Extra: x') AS body
FROM fx_paths""",
    "fx_chunk_entries": """
SELECT o_orderkey AS blob_id, l_linenumber AS idx, l_partkey AS chunk_id, CAST(l_quantity AS BIGINT) * 100 AS size
FROM orders JOIN lineitem ON o_orderkey = l_orderkey""",
    "fx_chunks": """
SELECT p_partkey AS chunk_id, CAST(floor(p_retailprice) AS BIGINT) AS size, p_size % 4 AS refcount, p_size % 4 = 0 AND p_type = 'PROMO' AS deleted,
  p_size * 10 AS age_secs, p_brand <> 'Brand#3' AS uploaded
FROM part""",
    "fx_removed": """
SELECT o_orderkey AS blob_id FROM orders WHERE o_orderstatus = 'F'""",
}
