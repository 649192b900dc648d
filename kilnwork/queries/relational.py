"""Queries over filters, joins, set operations, pages and sources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kilnwork.operators import filters, joins, pages, sets
from kilnwork.plans import membership
from kilnwork.plans.stored import in_tasks
from kilnwork.queries.registry import Inputs, query
from kilnwork.queries.views import AS_OF
from kilnwork.sources import chunks, closures, logs, manifests, tables, text
from kilnwork.streaming.runs import fresh_folder

CLASSES = [("small", 60.0, 3.0e8, 4.0), ("medium", 180.0, 6.0e8, 6.0), ("large", 400.0, 1.0e9, 8.0)]
CLASS_NAMES = [c[0] for c in CLASSES]
TERMINAL_SQL = "('completed', 'skipped', 'poisoned', 'dependency_failed', 'cancelled')"

#: Size class of a sample in SQL, as joins.classify assigns it.
CLASSIFIED_SQL = """
SELECT *, CASE least(slot + CASE WHEN coalesce(peak_memory_bytes > CASE slot WHEN 0 THEN 3.0e8 WHEN 1 THEN 6.0e8 ELSE 1.0e9 END, false)
    OR coalesce(peak_cpu_cores > CASE slot WHEN 0 THEN 4.0 WHEN 1 THEN 6.0 ELSE 8.0 END, false) THEN 1 ELSE 0 END, 2)
  WHEN 0 THEN 'small' WHEN 1 THEN 'medium' ELSE 'large' END AS size_class
FROM (SELECT *, CASE WHEN duration_secs <= 60 THEN 0 WHEN duration_secs <= 180 THEN 1 ELSE 2 END AS slot FROM fx_samples)"""


def classified(t: Inputs) -> DataFrame:
    return joins.classify(t.fx_samples, CLASSES, F.col("duration_secs"), F.col("peak_memory_bytes"), F.col("peak_cpu_cores"))


def complete(t: Inputs) -> DataFrame:
    return t.fx_paths.filter("manifest_status = 'complete'")


@query("s1_read_table", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def _(t):
    return tables.read_table(t.spark, t.sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")


@query("s2_kv_text", """
SELECT path_id, store_path AS "StorePath", 'file/' || nar_hash AS "URL", 'md5:' || nar_hash AS "NarHash", CAST(nar_size AS VARCHAR) AS "NarSize",
  CASE WHEN lang = 'es' THEN NULL ELSE 'none' END AS "Compression", 3 AS n_refs, 'k1:aa,k2:bb' AS sigs
FROM fx_paths WHERE source <> 'src4'""")
def _(t):
    good, _ = text.ingest_kv_text(t.fx_kv_text, "body")
    return good.select("path_id", "StorePath", "URL", "NarHash", "NarSize", "Compression", F.size("References").alias("n_refs"), F.array_join("Sig", ",").alias("sigs"))


@query("s2_kv_text_bad", "SELECT path_id, 'repeated URL' AS fault FROM fx_paths WHERE source = 'src4'")
def _(t):
    _, bad = text.ingest_kv_text(t.fx_kv_text, "body")
    return bad.select("path_id", "fault")


def _entries(t: Inputs) -> DataFrame:
    e = in_tasks(t.fx_chunk_entries, "blob_id").groupBy("blob_id", "idx").agg(F.min("chunk_id").alias("chunk_id"), F.max("size").alias("size"))
    return e.withColumn("chunk_hash", F.unhex(F.sha2(F.col("chunk_id").cast("string"), 256)))


@query("s3_decode_manifest", """
SELECT blob_id, CAST(row_number() OVER (PARTITION BY blob_id ORDER BY idx) - 1 AS INTEGER) AS idx,
  upper(sha256(CAST(chunk_id AS VARCHAR))) AS chunk_hex, size
FROM (SELECT blob_id, idx, min(chunk_id) AS chunk_id, max(size) AS size FROM fx_chunk_entries GROUP BY blob_id, idx)""")
def _(t):
    good, _ = manifests.decode_manifest(manifests.encode_manifest(_entries(t)), "blob_id", "manifest")
    return good.select("blob_id", "idx", F.hex("chunk_hash").alias("chunk_hex"), "size")


@query("s4_encode_manifest", """
SELECT blob_id, '01' || string_agg(upper(sha256(CAST(chunk_id AS VARCHAR))) || lpad(to_hex(size % 256), 2, '0') || lpad(to_hex(size // 256), 2, '0') || '0000', '' ORDER BY idx) AS manifest_hex
FROM (SELECT blob_id, idx, min(chunk_id) AS chunk_id, max(size) AS size FROM fx_chunk_entries GROUP BY blob_id, idx) GROUP BY blob_id""")
def _(t):
    return manifests.encode_manifest(_entries(t)).select("blob_id", F.hex("manifest").alias("manifest_hex"))


@query("s5_chunk_store", """
SELECT md5(coalesce(text, '')) AS chunk_hash, strlen(min(coalesce(text, ''))) AS size, substr(md5(coalesce(text, '')), 1, 2) AS prefix FROM documents GROUP BY md5(coalesce(text, ''))""")
def _(t):
    found = t.documents.select(F.md5(F.coalesce("text", F.lit(""))).alias("chunk_hash"), F.coalesce("text", F.lit("")).cast("binary").alias("bytes"), "source")
    path = fresh_folder(t.spark)
    chunks.write_chunks(found.filter("source = 'src1'"), path)
    chunks.write_chunks(found, path, chunks.read_chunks(t.spark, path))
    return chunks.read_chunks(t.spark, path).select("chunk_hash", F.length("bytes").cast("long").alias("size"), "prefix")


@query("s6_exists_batch", """
SELECT e.blob_id, e.idx, e.chunk_id, c.chunk_id IS NOT NULL AS present FROM fx_chunk_entries AS e
LEFT JOIN (SELECT chunk_id FROM fx_chunks WHERE uploaded) AS c ON e.chunk_id = c.chunk_id""")
def _(t):
    return chunks.exists_batch(t.fx_chunk_entries, t.fx_chunks.filter("uploaded"), "chunk_id").select("blob_id", "idx", "chunk_id", "present")


@query("s5_chunk_store_filtered", """
SELECT md5(coalesce(text, '')) AS chunk_hash, strlen(min(coalesce(text, ''))) AS size FROM documents GROUP BY md5(coalesce(text, ''))""")
def _(t):
    found = t.documents.select(F.md5(F.coalesce("text", F.lit(""))).alias("chunk_hash"), F.coalesce("text", F.lit("")).cast("binary").alias("bytes"), "source")
    path, beside = fresh_folder(t.spark), fresh_folder(t.spark)
    chunks.write_chunks(found.filter("source = 'src1'"), path, filter_path=beside)
    chunks.write_chunks(found, path, chunks.read_chunks(t.spark, path), filter_path=beside)
    return chunks.read_chunks(t.spark, path).select("chunk_hash", F.length("bytes").cast("long").alias("size"))


@query("s6_exists_filtered", """
SELECT d.doc_id, e.chunk_hash IS NOT NULL AS present FROM documents AS d
LEFT JOIN (SELECT DISTINCT md5(text) AS chunk_hash FROM documents WHERE source = 'src1' AND text IS NOT NULL) AS e ON e.chunk_hash = md5(d.text)""")
def _(t):
    hashes = t.documents.select("doc_id", F.md5("text").alias("chunk_hash"), "source")
    store, beside = hashes.filter("source = 'src1'").select("chunk_hash"), fresh_folder(t.spark)
    chunks.write_filters(store, beside)
    return chunks.exists_batch(hashes.drop("source"), store, filters=chunks.read_filters(t.spark, beside)).select("doc_id", "present")


@query("s6_filter_bound", """
WITH h AS (SELECT DISTINCT source, md5(text) AS chunk_hash FROM documents WHERE text IS NOT NULL)
SELECT source, count(*) AS hashes, count(*) FILTER (WHERE chunk_hash IN (SELECT chunk_hash FROM h WHERE source = 'src1')) AS held, true AS all_pass, true AS within FROM h GROUP BY source""")
def _(t):
    """A filter merged from two halves, against the hashes of each source: none that it holds is lost, and few others pass."""
    hashes = t.documents.filter("text is not null").select("source", F.md5("text").alias("chunk_hash")).distinct()
    own = hashes.filter("source = 'src1'")
    blocks = membership.blocks_for(own.count())
    halves = [membership.build_filter(own.filter(F.crc32("chunk_hash") % 2 == i), "chunk_hash", blocks) for i in (0, 1)]
    passed = membership.possible(hashes.select("chunk_hash").distinct(), "chunk_hash", membership.merge_filters(halves[0].unionAll(halves[1])), blocks).withColumn("passed", F.lit(1))
    marked = hashes.join(own.select("chunk_hash", F.lit(1).alias("in_set")), "chunk_hash", "left").join(passed, "chunk_hash", "left")
    counts = marked.groupBy("source").agg(F.count("*").alias("hashes"), F.count("in_set").alias("held"), F.count("passed").alias("passed"), F.count_if(F.expr("in_set = 1 and passed is null")).alias("lost"))
    return counts.select("source", "hashes", "held", (F.col("lost") == 0).alias("all_pass"), (F.col("passed") - F.col("held") <= 0.01 * (F.col("hashes") - F.col("held")) + 3).alias("within"))


@query("s7_log_pointers", """
SELECT build_id, node_id AS log_id, min(build_id) OVER (PARTITION BY node_id) AS owner
FROM fx_build_nodes WHERE node_id IN (SELECT log_id FROM fx_lines)""")
def _(t):
    return logs.log_pointers(t.fx_lines, t.fx_build_nodes)


GROUPS_SQL = """
WITH l AS (
  SELECT log_id, batch_no, unnest(string_split(batch_text, chr(10))) AS line, generate_subscripts(string_split(batch_text, chr(10)), 1) AS i FROM fx_lines
), n AS (
  SELECT log_id, row_number() OVER (PARTITION BY log_id ORDER BY batch_no, i) - 1 AS line_no, line FROM l
), g AS (
  SELECT log_id, (line_no - 2) // 4 AS group_no, min(line_no) AS first_line, count(*) AS n_lines, string_agg(line, chr(10) ORDER BY line_no) AS body
  FROM n WHERE line_no >= 2 GROUP BY ALL
)
SELECT log_id, group_no, first_line, n_lines, md5(body) AS body_md5, group_no = max(group_no) OVER (PARTITION BY log_id) AS complete FROM g"""


@query("s7_archive_logs", GROUPS_SQL.replace("(line_no - 2) // 4", "line_no // 256").replace("line_no >= 2", "line_no >= 0"))
def _(t):
    from kilnwork.operators.windows import number_lines

    path = fresh_folder(t.spark)
    logs.archive_logs(number_lines(t.fx_lines), path)
    return logs.read_logs(t.spark, path).withColumn("body_md5", F.md5("body")).drop("body")


@query("s8_group_lines", GROUPS_SQL)
def _(t):
    from kilnwork.operators.windows import number_lines

    return logs.group_lines(number_lines(t.fx_lines), since=2, size=4).withColumn("body_md5", F.md5("body")).drop("body")


@query("s10_export_closure", """
WITH i AS (SELECT path_id, row_number() OVER (ORDER BY path_id) AS id FROM (SELECT DISTINCT path_id FROM fx_paths WHERE lang <> 'en'))
SELECT DISTINCT a.id AS referrer, b.id AS reference FROM fx_path_refs AS r JOIN i AS a ON r.path_id = a.path_id JOIN i AS b ON r.ref_id = b.path_id""")
def _(t):
    _, refs, _ = closures.export_closure(t.fx_paths.filter("lang <> 'en'"), t.fx_path_refs, t.fx_outputs)
    return refs


@query("p1_opt_filter", "SELECT build_id, tenant_id FROM fx_builds WHERE status = 'active'")
def _(t):
    return filters.opt_filter(t.fx_builds, {"status": "active", "tenant_id": None}).select("build_id", "tenant_id")


@query("p2_status_class", f"""
SELECT node_id, status IN {TERMINAL_SQL} AS terminal, status IN ('failed', 'dependency_failed', 'cancelled') AS retriable,
  CASE WHEN status IN ('failed', 'poisoned', 'dependency_failed', 'cancelled') THEN 'bad' WHEN status IN ('running', 'assigned', 'substituting') THEN 'active'
    WHEN status IN ('completed', 'skipped') THEN 'good' ELSE 'waiting' END AS display,
  CASE WHEN status IN ('failed', 'poisoned', 'dependency_failed', 'cancelled') THEN 0 WHEN status IN ('running', 'assigned', 'substituting') THEN 1
    WHEN status IN ('completed', 'skipped') THEN 3 ELSE 2 END AS rank
FROM fx_nodes""")
def _(t):
    return filters.with_status_class(t.fx_nodes).select("node_id", "terminal", "retriable", "display", "rank")


@query("p3_retriable", "SELECT node_id FROM fx_nodes WHERE status IN ('failed', 'dependency_failed', 'cancelled') OR (status = 'poisoned' AND retry_count < 6)")
def _(t):
    return filters.retriable(t.fx_nodes).select("node_id")


@query("p4_poisoned", """
SELECT node_id, count(DISTINCT builder_id) >= 3 AS poisoned FROM fx_assignments WHERE status = 'failed' GROUP BY node_id""")
def _(t):
    failed = t.fx_assignments.filter("status = 'failed'").groupBy("node_id").agg(F.collect_set("builder_id").alias("failed_builders"))
    return filters.is_poisoned(failed).select("node_id", "poisoned")


@query("p5_parse_path", """
SELECT path_id, hash_part, 'doc' || path_id AS name, CAST(NULL AS VARCHAR) AS fault FROM fx_paths WHERE lang <> 'fr'
UNION ALL SELECT path_id, NULL, NULL, 'dash' FROM fx_paths WHERE lang = 'fr'""")
def _(t):
    odd = t.fx_paths.withColumn("store_path", F.when(F.col("lang") == "fr", F.translate("store_path", "-", "_")).otherwise(F.col("store_path")))
    return filters.parse_path(odd, "store_path").select("path_id", "hash_part", "name", "fault")


@query("p6_by_hash_part", "SELECT path_id, store_path FROM fx_paths WHERE store_path LIKE '/store/' || translate(md5('7'), 'e', 'z') || '-%' AND manifest_status = 'complete'")
def _(t):
    import hashlib

    part = hashlib.md5(b"7").hexdigest().replace("e", "z")
    return filters.by_hash_part(t.fx_paths, part).select("path_id", "store_path")


@query("p7_lookback", "SELECT event_id, kind FROM fx_event_log WHERE ts > TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 7 DAY")
def _(t):
    return filters.lookback(t.fx_event_log, "ts", 7, "2024-01-20 00:00:00").select("event_id", "kind")


@query("p8_name_contains", "SELECT node_id, pname FROM fx_nodes WHERE contains(pname, 'ring')")
def _(t):
    return filters.name_contains(t.fx_nodes, "ring").select("node_id", "pname")


@query("p9_name_ok", r"SELECT node_id, pname <> '' AND NOT regexp_matches(pname, '\s') AS ok FROM fx_nodes")
def _(t):
    return t.fx_nodes.select("node_id", filters.name_ok(F.col("pname")).alias("ok"))


def _path_rows(t: Inputs) -> DataFrame:
    return t.fx_paths.select(
        "path_id", F.unhex(F.when(F.col("lang") == "es", F.col("nar_hash")).otherwise(F.sha2("nar_hash", 256))).alias("digest"),
        F.array(F.lit("a")).alias("references"), F.array_repeat(F.lit("s"), (F.col("path_id") % 150).cast("int")).alias("signatures"), "nar_size",
    )


@query("p10_validate", """
SELECT path_id, concat_ws(',', CASE WHEN lang = 'es' THEN 'digest' END, CASE WHEN path_id % 150 > 100 THEN 'signatures' END) AS reasons
FROM fx_paths WHERE lang = 'es' OR path_id % 150 > 100""")
def _(t):
    _, bad = filters.validate_paths(_path_rows(t))
    return bad.select("path_id", F.array_join("reasons", ",").alias("reasons"))


@query("p11_admit_samples", """
SELECT s.node_id, s.l_orderkey, s.duration_secs, nullif(s.peak_cpu_cores, 0) AS peak_cpu_cores
FROM fx_samples AS s JOIN fx_nodes AS n ON s.node_id = n.node_id WHERE duration_secs > 0 AND duration_secs < 2592000 AND NOT is_fixed_output""")
def _(t):
    rows = t.fx_samples.join(t.fx_nodes.select("node_id", "is_fixed_output"), "node_id")
    return filters.admit_samples(rows).select("node_id", "l_orderkey", "duration_secs", "peak_cpu_cores")


@query("p12_route_blob", "SELECT path_id, CASE WHEN nar_size >= 2048 THEN 'chunked' ELSE 'inline' END AS route FROM fx_paths")
def _(t):
    return filters.route_blob(t.fx_paths, inline=2048).select("path_id", "route")


def _demands(t: Inputs) -> DataFrame:
    return t.fx_nodes.filter("status = 'ready'").select(
        "is_fixed_output", F.col("system").alias("node_system"),
        F.when(F.col("is_floating"), F.array(F.lit("kvm"))).otherwise(F.expr("cast(array() as array<string>)")).alias("needs"),
        F.when(F.pmod("node_id", F.lit(4)) == 0, F.array(F.pmod("node_id", F.lit(7)), F.pmod("node_id", F.lit(5)))).otherwise(F.expr("cast(array() as array<bigint>)")).alias("failed_on"), F.pmod("node_id", F.lit(3)).alias("class_rank"), F.lit(500).alias("memory_needed"),
    )


def _offers(t: Inputs) -> DataFrame:
    systems = F.when(F.col("executor_rank") == 1, F.array("system", F.lit("builtin"))).otherwise(F.array("system"))
    return t.fx_executors.withColumn("systems", systems).withColumn("offers", F.when(F.col("has_kvm"), F.array(F.lit("kvm"))).otherwise(F.expr("cast(array() as array<string>)")))


REASON_SQL = """
CASE WHEN is_fixed_output <> (kind = 'fetcher') THEN 'kind' WHEN draining THEN 'draining' WHEN degraded THEN 'degraded'
  WHEN NOT registered THEN 'unregistered' WHEN closed THEN 'closed' WHEN busy THEN 'capacity'
  WHEN e.system <> n.system AND NOT (executor_rank = 1 AND n.system = 'builtin') THEN 'system' WHEN is_floating AND NOT has_kvm THEN 'feature'
  WHEN node_id % 4 = 0 AND e.executor_id IN (node_id % 7, node_id % 5) THEN 'failed-on'
  WHEN node_id % 3 IS NOT NULL AND executor_rank IS NULL THEN 'class undeclared' WHEN executor_rank <> node_id % 3 THEN 'class'
  WHEN memory_total <> 0 AND memory_total < 500 THEN 'memory' END"""


@query("j9_candidate_matrix", f"""
SELECT is_fixed_output, n.system AS node_system, CASE WHEN is_floating THEN 1 ELSE 0 END AS n_needs, node_id % 3 AS class_rank, e.executor_id,
  {REASON_SQL} AS reason, count(*) AS nodes
FROM fx_nodes AS n JOIN fx_executors AS e ON true WHERE n.status = 'ready' GROUP BY ALL""")
def _(t):
    pairs = joins.candidate_matrix(_demands(t), _offers(t))
    return pairs.select("is_fixed_output", "node_system", F.size("needs").alias("n_needs"), "class_rank", "executor_id", "reason", "nodes")


@query("p13_rejections", f"""
SELECT coalesce(reason, 'none') AS reason, CAST(sum(n) AS BIGINT) AS pairs FROM (
  SELECT {REASON_SQL} AS reason, count(*) AS n FROM fx_nodes AS n JOIN fx_executors AS e ON true WHERE n.status = 'ready' GROUP BY 1) GROUP BY 1""")
def _(t):
    pairs = joins.candidate_matrix(_demands(t), _offers(t))
    return pairs.groupBy(F.coalesce("reason", F.lit("none")).alias("reason")).agg(F.sum("nodes").alias("pairs"))


@query("j1_build_nodes", "SELECT b.build_id, n.node_id, coalesce(n.pname, '') AS pname FROM fx_build_nodes AS b JOIN fx_nodes AS n ON b.node_id = n.node_id JOIN fx_builds AS x ON x.build_id = b.build_id")
def _(t):
    return joins.build_nodes_of(t.fx_builds, t.fx_build_nodes, t.fx_nodes).select("build_id", "node_id", "pname")


@query("j2_complete_paths", "SELECT path_id, nar_size FROM fx_paths WHERE manifest_status = 'complete'")
def _(t):
    return joins.complete_paths(t.fx_paths.drop("manifest_status"), t.fx_paths.select("path_id", "manifest_status")).select("path_id", "nar_size")


@query("j3_missing_paths", "SELECT l_orderkey, l_linenumber, l_partkey AS path_id FROM lineitem WHERE l_partkey NOT IN (SELECT path_id FROM fx_paths WHERE manifest_status = 'complete')")
def _(t):
    wanted = t.lineitem.select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("path_id"))
    return joins.missing_paths(wanted, complete(t)).select("l_orderkey", "l_linenumber", "path_id")


@query("j4_lookup_paths", """
SELECT l_orderkey, l_linenumber, l_partkey AS path_id, nar_size FROM lineitem
LEFT JOIN (SELECT * FROM fx_paths WHERE manifest_status = 'complete') AS p ON l_partkey = p.path_id""")
def _(t):
    wanted = t.lineitem.select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("path_id"))
    return joins.lookup_paths(wanted, complete(t).select("path_id", "nar_size")).select("l_orderkey", "l_linenumber", "path_id", "nar_size")


@query("j5_lookup_outputs", """
SELECT k.key_id, k.output_name, r.path_id FROM (SELECT o_orderkey AS key_id, 'out2' AS output_name FROM orders) AS k
JOIN fx_realisations AS r ON k.key_id = r.key_id AND k.output_name = r.output_name""")
def _(t):
    keys = t.orders.select(F.col("o_orderkey").alias("key_id"), F.lit("out2").alias("output_name"))
    return joins.lookup_outputs(keys, t.fx_realisations).select("key_id", "output_name", "path_id")


@query("j6_manifest_batch", """
WITH c AS (SELECT blob_id, count(*) AS chunks FROM fx_chunk_entries GROUP BY blob_id)
SELECT o_orderkey AS path_id, c.chunks, CASE WHEN o_orderstatus = 'P' THEN 'inline' WHEN c.chunks > 0 THEN 'chunked' ELSE 'no list' END AS storage
FROM orders LEFT JOIN c ON o_orderkey = c.blob_id""")
def _(t):
    asked = t.orders.select(F.col("o_orderkey").alias("path_id"))
    inline = t.orders.filter("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("path_id"))
    return joins.manifest_batch(asked, inline, t.fx_chunk_entries.withColumnRenamed("blob_id", "path_id")).select("path_id", "chunks", "storage")


@query("j7_induced_edges", """
SELECT parent_id, child_id FROM fx_edges JOIN fx_nodes AS a ON parent_id = a.node_id JOIN fx_nodes AS b ON child_id = b.node_id
WHERE a.status = 'completed' AND b.status = 'completed'""")
def _(t):
    return joins.induced_edges(t.fx_nodes.filter("status = 'completed'"), t.fx_edges).select("parent_id", "child_id")


@query("j8_estimate", """
WITH m AS (SELECT pname, avg(ema_duration_secs) AS mean FROM fx_history GROUP BY pname),
i AS (SELECT node_id, sum(nar_size) AS input_bytes FROM fx_outputs JOIN fx_paths ON fx_outputs.path_id = fx_paths.path_id GROUP BY node_id)
SELECT n.node_id, round(coalesce(h.ema_duration_secs, m.mean, CASE WHEN input_bytes > 0 THEN greatest(input_bytes / 1e7, 5.0) END, 30.0) + 1e-8, 6) AS duration,
  CASE WHEN h.ema_duration_secs IS NOT NULL THEN 'exact' WHEN m.mean IS NOT NULL THEN 'name' WHEN input_bytes > 0 THEN 'size' ELSE 'default' END AS rule
FROM fx_nodes AS n LEFT JOIN fx_history AS h ON n.pname = h.pname AND n.system = h.system LEFT JOIN m ON n.pname = m.pname LEFT JOIN i ON n.node_id = i.node_id""")
def _(t):
    from kilnwork.operators.aggregates import input_bytes

    nodes = t.fx_nodes.join(input_bytes(t.fx_outputs.join(t.fx_paths.select("path_id"), "path_id"), t.fx_paths), "node_id", "left")
    return joins.estimate(nodes, t.fx_history).select("node_id", F.round(F.col("duration") + 1e-8, 6).alias("duration"), "rule")


@query("j10_classify", f"SELECT l_orderkey, line_no, node_id, builder_id, size_class FROM ({CLASSIFIED_SQL})")
def _(t):
    return classified(t).select("l_orderkey", "line_no", "node_id", "builder_id", "size_class")


@query("j11_referrers", "SELECT DISTINCT path_id FROM fx_path_refs WHERE ref_id IN (SELECT path_id FROM fx_pins)")
def _(t):
    return joins.referrers(t.fx_path_refs, t.fx_pins)


@query("j12_diff_sources", """
SELECT coalesce(a.id, b.id) AS id, CASE WHEN a.id IS NULL THEN 'right' WHEN b.id IS NULL THEN 'left' ELSE 'both' END AS side, a.id IS NULL OR b.id IS NULL AS diverges
FROM (SELECT DISTINCT node_id AS id FROM fx_assignments) AS a FULL JOIN (SELECT node_id AS id FROM fx_nodes WHERE status <> 'created') AS b ON a.id = b.id""")
def _(t):
    return joins.diff_sources(t.fx_assignments.select(F.col("node_id").alias("id")), t.fx_nodes.filter("status <> 'created'").select(F.col("node_id").alias("id")), "id")


def _upstreams(t: Inputs):
    ups = t.supplier.select(F.col("s_nationkey").cast("long").alias("tenant_id"), F.col("s_suppkey").alias("upstream_id"), (F.col("s_suppkey") % 4).alias("priority"))
    available = t.lineitem.select(F.col("l_suppkey").alias("upstream_id"), F.col("l_partkey").alias("path_id")).distinct()
    return ups, available


@query("j13_first_upstream", """
WITH o AS (
  SELECT DISTINCT r.tenant_id, r.path_id, s_suppkey % 4 AS priority, s_suppkey AS upstream_id FROM fx_path_tenants AS r
  JOIN supplier ON s_nationkey = r.tenant_id JOIN lineitem ON l_suppkey = s_suppkey AND l_partkey = r.path_id)
SELECT tenant_id, path_id, upstream_id FROM o QUALIFY row_number() OVER (PARTITION BY tenant_id, path_id ORDER BY priority, upstream_id) = 1""")
def _(t):
    return joins.first_upstream(t.fx_path_tenants.select("tenant_id", "path_id"), *_upstreams(t))


@query("j14_prior_outputs", """
SELECT a.key_id, a.path_id, min(b.key_id) AS prior_key FROM (SELECT DISTINCT key_id, path_id FROM fx_realisations) AS a
JOIN (SELECT DISTINCT key_id, path_id FROM fx_realisations) AS b ON a.path_id = b.path_id AND a.key_id <> b.key_id GROUP BY a.key_id, a.path_id""")
def _(t):
    return joins.prior_outputs(t.fx_realisations)


@query("j15_orphan_nodes", f"""
SELECT node_id FROM fx_nodes WHERE status IN {TERMINAL_SQL}
AND node_id NOT IN (SELECT node_id FROM fx_build_nodes WHERE build_id IN (SELECT build_id FROM fx_builds WHERE status = 'active' AND priority_class = 'ci'))
AND node_id NOT IN (SELECT node_id FROM fx_assignments WHERE status = 'acknowledged')""")
def _(t):
    wanted = t.fx_build_nodes.join(t.fx_builds.filter("status = 'active' and priority_class = 'ci'"), "build_id", "left_semi")
    return joins.orphan_nodes(t.fx_nodes, wanted, t.fx_assignments).select("node_id")


@query("j16_stale_pins", f"SELECT path_id, drv_hash FROM fx_pins WHERE NOT EXISTS (SELECT 1 FROM fx_nodes AS n WHERE n.drv_hash = fx_pins.drv_hash AND n.status NOT IN {TERMINAL_SQL})")
def _(t):
    return joins.stale_pins(t.fx_pins, t.fx_nodes).select("path_id", "drv_hash")


@query("j17_visible", """
SELECT path_id FROM fx_paths AS p WHERE EXISTS (SELECT 1 FROM fx_path_tenants AS o WHERE o.path_id = p.path_id AND o.tenant_id = 3) OR source = 'src2'""")
def _(t):
    trust = t.fx_paths.select("path_id", (F.col("source") == "src2").alias("trusted"))
    return joins.visible(t.fx_paths, t.fx_path_tenants, trust, 3).select("path_id")


@query("j18_partition_requests", """
SELECT r.node_id, 'dev' AS output_name, CASE WHEN o.path_id IS NULL THEN 'unknown' WHEN c.path_id IS NOT NULL THEN 'present'
  WHEN s.path_id IS NOT NULL THEN 'substitute' ELSE 'build' END AS verdict
FROM fx_nodes AS r LEFT JOIN fx_outputs AS o ON r.node_id = o.node_id AND o.output_name = 'dev'
LEFT JOIN (SELECT path_id FROM fx_paths WHERE manifest_status = 'complete' AND lang <> 'en') AS c ON c.path_id = o.path_id
LEFT JOIN (SELECT path_id FROM fx_paths WHERE source = 'src6') AS s ON s.path_id = o.path_id""")
def _(t):
    asked = t.fx_nodes.select("node_id", F.lit("dev").alias("output_name"))
    return joins.partition_requests(asked, t.fx_outputs, complete(t).filter("lang <> 'en'"), t.fx_paths.filter("source = 'src6'"))


@query("j19_stranded", """
SELECT node_id, n.executor_id FROM fx_nodes AS n LEFT JOIN fx_executors AS e ON n.executor_id = e.executor_id
WHERE status IN ('assigned', 'running') AND e.running_node IS DISTINCT FROM n.node_id""")
def _(t):
    return joins.stranded_assignments(t.fx_nodes, t.fx_executors.select("executor_id", "running_node")).select("node_id", "executor_id")


@query("j20_ownership", """
SELECT DISTINCT o.path_id, b.tenant_id FROM fx_outputs AS o JOIN fx_build_nodes AS m ON o.node_id = m.node_id JOIN fx_builds AS b ON b.build_id = m.build_id""")
def _(t):
    return joins.ownership_rows(t.fx_outputs, t.fx_build_nodes, t.fx_builds)


@query("j21_asof", """
WITH v AS (SELECT assigned_class, completed_at AS ts, max(duration_secs) AS cutoff FROM fx_samples WHERE line_no = 1 GROUP BY ALL)
SELECT s.l_orderkey, s.line_no, s.node_id, s.builder_id, v.cutoff FROM fx_samples AS s ASOF LEFT JOIN v ON s.assigned_class = v.assigned_class AND s.completed_at >= v.ts""")
def _(t):
    samples = t.fx_samples.withColumnRenamed("completed_at", "ts")
    versions = samples.filter("line_no = 1").groupBy("assigned_class", "ts").agg(F.max("duration_secs").alias("cutoff"))
    return joins.asof_join(samples, versions, "assigned_class", "ts", "cutoff", part="month").select("l_orderkey", "line_no", "node_id", "builder_id", "cutoff")


@query("u1_mark_seeds", """
SELECT path_id FROM fx_paths WHERE manifest_status = 'uploading' OR age_hours <= 2 UNION SELECT path_id FROM fx_pins
UNION SELECT path_id FROM fx_paths WHERE source = 'src9'
UNION SELECT o.path_id FROM fx_path_tenants AS o JOIN fx_tenants AS x ON o.tenant_id = x.tenant_id WHERE ref_age_hours <= gc_retention_hours""")
def _(t):
    return seeds(t)


def seeds(t: Inputs) -> DataFrame:
    return sets.mark_seeds(t.fx_paths, t.fx_pins, t.fx_path_tenants, t.fx_tenants, t.fx_paths.filter("source = 'src9'"))


@query("u2_all_ids", "SELECT node_id AS id FROM fx_assignments UNION SELECT s_suppkey FROM supplier")
def _(t):
    return sets.all_ids(t.fx_assignments.select(F.col("node_id").alias("id")), t.supplier.select(F.col("s_suppkey").alias("id")), "id")


@query("u3_difference", "SELECT node_id FROM fx_build_nodes EXCEPT SELECT node_id FROM fx_assignments")
def _(t):
    return sets.difference(t.fx_build_nodes.select("node_id"), t.fx_assignments.select("node_id"))


@query("u3_intersection", "SELECT builder_id AS id FROM fx_samples INTERSECT SELECT node_id AS id FROM fx_nodes")
def _(t):
    return sets.intersection(t.fx_samples.select(F.col("builder_id").alias("id")), t.fx_nodes.select(F.col("node_id").alias("id")))


@query("u3_difference_all", "SELECT node_id FROM fx_samples EXCEPT ALL SELECT node_id FROM fx_assignments")
def _(t):
    return sets.difference(t.fx_samples.select("node_id"), t.fx_assignments.select("node_id"), keep_duplicates=True)


@query("u4_live_outputs", f"""
SELECT DISTINCT path_id FROM (SELECT node_id, path_id FROM fx_outputs UNION ALL SELECT key_id, path_id FROM fx_realisations) AS o
WHERE node_id IN (SELECT node_id FROM fx_nodes WHERE status NOT IN {TERMINAL_SQL})""")
def _(t):
    return sets.live_outputs(t.fx_nodes, t.fx_outputs, t.fx_realisations.select(F.col("key_id").alias("node_id"), "path_id"))


@query("l1_page_offset", """
SELECT build_id, (SELECT count(*) FROM fx_builds WHERE status = 'active') AS total FROM fx_builds WHERE status = 'active'
ORDER BY submitted_at DESC, build_id DESC LIMIT 50 OFFSET 100""")
def _(t):
    return pages.page_offset(t.fx_builds, 50, 100, {"status": "active"}).select("build_id", "total")


@query("l2_page_keyset", """
SELECT build_id, submitted_at FROM fx_builds WHERE submitted_at <= TIMESTAMP '1997-01-01 00:00:00' AND (submitted_at < TIMESTAMP '1997-01-01 00:00:00' OR build_id < 5000)
ORDER BY submitted_at DESC, build_id DESC LIMIT 100""")
def _(t):
    return pages.page_keyset(t.fx_builds, 100, ("1997-01-01 00:00:00", 5000)).select("build_id", "submitted_at")


@query("l3_cursor", "SELECT build_id, epoch_us(submitted_at) AS micros, build_id AS id, 23 AS chars FROM fx_builds")
def _(t):
    coded = t.fx_builds.withColumn("cursor", pages.encode_cursor(F.col("submitted_at"), F.col("build_id")))
    read = pages.decode_cursor(F.col("cursor"))
    return coded.select("build_id", read["micros"].alias("micros"), read["id"].alias("id"), F.length("cursor").alias("chars"))


@query("l4_estimator_listing", "SELECT pname, system, sample_count FROM fx_history WHERE contains(pname, 'ring')")
def _(t):
    return pages.estimator_listing(t.fx_history, "ring").select("pname", "system", "sample_count")


@query("l5_graph_page", """
SELECT node_id, (SELECT count(*) FROM fx_build_nodes WHERE build_id = 7) AS total FROM fx_nodes
WHERE node_id IN (SELECT node_id FROM fx_build_nodes WHERE build_id = 7) ORDER BY drv_hash LIMIT 3""")
def _(t):
    return pages.graph_page(7, t.fx_nodes, t.fx_build_nodes, 3).select("node_id", "total")


@query("l6_order_by_rank", """
SELECT node_id, CASE WHEN status IN ('failed', 'poisoned', 'dependency_failed', 'cancelled') THEN 0 WHEN status IN ('running', 'assigned', 'substituting') THEN 1
    WHEN status IN ('completed', 'skipped') THEN 3 ELSE 2 END AS rank FROM fx_nodes ORDER BY 2, pname, node_id""")
def _(t):
    return pages.order_by_rank(t.fx_nodes).select("node_id", "rank")


@query("l7_work_batch", "SELECT p_partkey AS item_id FROM part WHERE p_size < 10 ORDER BY p_retailprice, p_partkey LIMIT 100")
def _(t):
    pending = t.part.select(F.col("p_partkey").alias("item_id"), F.col("p_size").alias("attempts"), F.col("p_retailprice").alias("enqueued_at"))
    return pages.work_batch(pending, 100).select("item_id")


@query("l8_scan_progress", """
SELECT CAST('0x' || substr(sha256(CAST(chunk_id AS VARCHAR)), 1, 2) AS INTEGER) AS bucket, count(*) AS rows, CAST(sum(size) AS BIGINT) AS bytes FROM fx_chunks GROUP BY 1""")
def _(t):
    return pages.scan_progress(t.fx_chunks)
