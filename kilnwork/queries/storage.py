"""Queries over content-addressed storage."""

from __future__ import annotations

from pyspark.sql import functions as F

from kilnwork.operators import storage as s
from kilnwork.plans.stored import spread
from kilnwork.queries.registry import query

#: Chunk sizes for documents of a few kilobytes.
SIZES = (256, 1024, 4096)
ENTRIES_SQL = "SELECT DISTINCT blob_id, chunk_id FROM fx_chunk_entries"


def _blobs(t):
    return spread(t.documents).select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("content"))


@query("c1_chunk")
def _(t):
    cut = s.chunk(_blobs(t), "doc_id", "content", *SIZES)
    return cut.select("id", "idx", "offset", "size", s.chunk_hash(F.col("bytes")).alias("chunk_hash"))


@query("c1_chunk_totals", "SELECT doc_id AS id, strlen(text) AS bytes, 0 AS bad_sizes FROM documents WHERE strlen(text) > 0")
def _(t):
    cut = s.chunk(_blobs(t), "doc_id", "content", *SIZES)
    last = cut.groupBy("id").agg(F.max("idx").alias("last"))
    bad = F.count_if((F.col("size") > SIZES[2]) | ((F.col("size") < SIZES[0]) & (F.col("idx") < F.col("last"))))
    return cut.join(last, "id").groupBy("id").agg(F.sum("size").alias("bytes"), bad.cast("int").alias("bad_sizes"))


@query("c2_chunk_hash", "SELECT doc_id, sha256(text) AS chunk_hash FROM documents")
def _(t):
    return t.documents.select("doc_id", s.chunk_hash(F.col("text")).alias("chunk_hash"))


@query("c3_apply_manifests", """
WITH a AS (SELECT chunk_id, count(DISTINCT blob_id) AS n, max(size) AS size FROM fx_chunk_entries GROUP BY chunk_id)
SELECT coalesce(c.chunk_id, a.chunk_id) AS chunk_id, coalesce(c.size, a.size) AS size, coalesce(refcount, 0) + coalesce(n, 0) AS refcount,
  coalesce(deleted, false) AND n IS NULL AS deleted, n IS NOT NULL AND NOT coalesce(uploaded, false) AS needs_upload FROM fx_chunks AS c FULL JOIN a ON c.chunk_id = a.chunk_id""")
def _(t):
    return s.apply_manifests(t.fx_chunks, t.fx_chunk_entries)


@query("c4_audit_refcounts", f"""
SELECT coalesce(c.chunk_id, e.chunk_id) AS chunk_id, coalesce(refcount, 0) AS stored, coalesce(n, 0) AS counted FROM fx_chunks AS c
FULL JOIN (SELECT chunk_id, count(*) AS n FROM ({ENTRIES_SQL}) GROUP BY chunk_id) AS e ON c.chunk_id = e.chunk_id WHERE coalesce(refcount, 0) <> coalesce(n, 0)""")
def _(t):
    return s.audit_refcounts(t.fx_chunks, t.fx_chunk_entries)


SWEPT_SQL = f"""
WITH l AS (SELECT chunk_id, count(*) AS n FROM ({ENTRIES_SQL}) WHERE blob_id IN (SELECT blob_id FROM fx_removed) GROUP BY chunk_id),
c AS (SELECT chunk_id, count(*) AS refcount FROM ({ENTRIES_SQL}) GROUP BY chunk_id),
w AS (SELECT c.chunk_id, x.size, c.refcount - coalesce(n, 0) AS refcount, n IS NOT NULL AND c.refcount = n AS zeroed FROM c JOIN fx_chunks AS x ON x.chunk_id = c.chunk_id LEFT JOIN l ON l.chunk_id = c.chunk_id)"""


def _counted(t):
    counts = s.references(t.fx_chunk_entries).groupBy("chunk_id").agg(F.count("*").alias("refcount"))
    return t.fx_chunks.select("chunk_id", "size").join(counts, "chunk_id").withColumn("deleted", F.lit(False))


@query("c5_sweep", SWEPT_SQL + "SELECT chunk_id, size, refcount, zeroed AS deleted, zeroed FROM w")
def _(t):
    return s.sweep(_counted(t), t.fx_chunk_entries, t.fx_removed)


@query("c5_sweep_stats", SWEPT_SQL + "SELECT (SELECT count(*) FROM fx_removed) AS blobs, count(*) AS chunks, CAST(coalesce(sum(size), 0) AS BIGINT) AS bytes FROM w WHERE zeroed")
def _(t):
    return s.sweep_stats(s.sweep(_counted(t), t.fx_chunk_entries, t.fx_removed), t.fx_removed)


@query("c6_delete_paths", """
SELECT 'path' AS kind, path_id FROM fx_paths WHERE lang <> 'es' UNION ALL SELECT 'owner', path_id FROM fx_path_tenants WHERE path_id NOT IN (SELECT path_id FROM fx_paths WHERE lang = 'es')
UNION ALL SELECT 'realisation', path_id FROM fx_realisations WHERE path_id NOT IN (SELECT path_id FROM fx_paths WHERE lang = 'es')""")
def _(t):
    kept = s.delete_paths(t.fx_paths, t.fx_path_tenants, t.fx_realisations, t.fx_paths.filter("lang = 'es'"))
    parts = [df.select(F.lit(kind).alias("kind"), "path_id") for kind, df in zip(("path", "owner", "realisation"), kept, strict=True)]
    return parts[0].unionAll(parts[1]).unionAll(parts[2])


@query("c7_enqueue_deletes", "SELECT chunk_id, refcount AS attempts FROM fx_chunks WHERE uploaded UNION ALL SELECT chunk_id, 0 FROM fx_chunks WHERE NOT uploaded AND refcount = 0")
def _(t):
    pending = t.fx_chunks.filter("uploaded").select("chunk_id", F.col("refcount").alias("attempts"))
    return s.enqueue_deletes(t.fx_chunks.filter("refcount = 0"), pending)


@query("c7_drain", "SELECT chunk_id FROM fx_chunks WHERE uploaded AND NOT (refcount > 0 AND NOT deleted)")
def _(t):
    return s.drain(t.fx_chunks.filter("uploaded").select("chunk_id"), t.fx_chunks)


@query("c8_orphan_chunks", "SELECT chunk_id, size FROM fx_chunks WHERE refcount = 0 AND NOT deleted AND age_secs > 300")
def _(t):
    return s.orphan_chunks(t.fx_chunks).select("chunk_id", "size")


@query("c9_reap_stale", "SELECT path_id, manifest_status = 'uploading' AND age_hours > 500 AS stale FROM fx_paths")
def _(t):
    left, stale = s.reap_stale(t.fx_paths, F.col("age_hours"), hours=500)
    return left.select("path_id", F.lit(False).alias("stale")).unionAll(stale.select("path_id", F.lit(True)))


@query("c10_verify_chunks", "SELECT count(*) AS scanned, count(*) FILTER (WHERE NOT uploaded) AS missing FROM fx_chunks WHERE refcount > 0 AND NOT deleted")
def _(t):
    return s.verify_chunks(t.fx_chunks, t.fx_chunks.filter("uploaded"))


@query("c11_verify_bytes", "SELECT doc_id FROM documents WHERE lang = 'de'")
def _(t):
    declared = F.when(F.col("lang") == "de", F.lit("00")).otherwise(F.sha2("text", 256))
    return s.verify_bytes(t.documents.select("doc_id", F.col("text").cast("binary").alias("bytes"), declared.alias("chunk_hash"))).select("doc_id")


@query("c12_reassemble", """
SELECT doc_id AS blob_id, strlen(text) AS size, md5(text) AS content_hash, CASE WHEN lang = 'fr' THEN 'size' WHEN lang = 'de' THEN 'hash' END AS fault FROM documents""")
def _(t):
    cut = s.chunk(_blobs(t), "doc_id", "content", *SIZES).withColumn("chunk_hash", s.chunk_hash(F.col("bytes")))
    stored = cut.groupBy("chunk_hash").agg(F.first("bytes").alias("bytes"))
    off = F.when(F.col("lang") == "fr", 1).otherwise(0)
    declared = t.documents.select(
        F.col("doc_id").alias("blob_id"), (F.octet_length("text") + off).alias("declared_size"), F.when(F.col("lang") == "de", F.lit("?")).otherwise(F.md5("text")).alias("declared_hash")
    )
    return s.reassemble(cut.select(F.col("id").alias("blob_id"), "idx", "chunk_hash"), stored, declared)


@query("c13_verify_blobs", "SELECT doc_id AS path_id, CASE lang WHEN 'fr' THEN 'size' ELSE 'hash' END AS fault FROM documents WHERE lang IN ('fr', 'de')")
def _(t):
    blobs = t.documents.select(F.col("doc_id").alias("path_id"), F.col("text").cast("binary").alias("content"))
    declared = t.documents.select(
        F.col("doc_id").alias("path_id"), (F.octet_length("text") + F.when(F.col("lang") == "fr", 1).otherwise(0)).alias("declared_size"),
        F.when(F.col("lang") == "de", F.lit("?")).otherwise(F.md5("text")).alias("declared_hash"),
    )
    return s.verify_blobs(blobs, declared)


@query("c14_scan_refs", "SELECT DISTINCT r.path_id, p.hash_part FROM fx_path_refs AS r JOIN fx_paths AS p ON p.path_id = r.ref_id")
def _(t):
    refs = t.fx_path_refs.join(t.fx_paths.select(F.col("path_id").alias("ref_id"), "store_path"), "ref_id").groupBy("path_id").agg(F.array_join(F.array_sort(F.collect_list("store_path")), "\n").alias("refs"))
    blobs = t.documents.select(F.col("doc_id").alias("path_id"), "text").join(refs, "path_id", "left")
    content = F.concat_ws("\n", F.col("text"), F.col("refs"))
    return s.scan_refs(blobs.select("path_id", content.alias("content")), t.fx_paths)


@query("c15_dedup_report", """
SELECT chunk_id, count(*) AS blobs, CAST(sum(size) - max(size) AS BIGINT) AS saved_bytes FROM (SELECT blob_id, chunk_id, max(size) AS size FROM fx_chunk_entries GROUP BY ALL) GROUP BY chunk_id HAVING count(*) > 1""")
def _(t):
    return s.dedup_report(t.fx_chunk_entries)


MEMBERS_SQL = """
e AS (SELECT DISTINCT blob_id, chunk_id FROM fx_chunk_entries), s AS (SELECT blob_id, list_sort(list(chunk_id)) AS held FROM e GROUP BY blob_id),
c AS (SELECT blob_id, min(blob_id) OVER (PARTITION BY held) AS class_id FROM s),
h AS (SELECT chunk_id, blob_id AS class_id, min(blob_id) OVER w AS head, count(*) OVER w AS n FROM e WHERE blob_id IN (SELECT class_id FROM c) WINDOW w AS (PARTITION BY chunk_id)),
l AS (SELECT class_id, head, count(*) AS shared FROM h WHERE class_id <> head GROUP BY class_id, head)"""


@query("c15_shared_chunks", f"""
WITH {MEMBERS_SQL}
SELECT 'class' AS part, blob_id AS x, class_id AS y, CAST(NULL AS BIGINT) AS shared FROM c UNION ALL SELECT 'member', chunk_id, class_id, NULL FROM h WHERE n > 1
UNION ALL SELECT 'link', class_id, head, shared FROM l""")
def _(t):
    classes, members, links = s.shared_chunks(t.fx_chunk_entries)
    none = F.lit(None).cast("long").alias("shared")
    shown = lambda part, df, x, y, n: df.select(F.lit(part).alias("part"), F.col(x).alias("x"), F.col(y).alias("y"), n)
    return shown("class", classes, "blob_id", "class_id", none).unionAll(shown("member", members, "chunk_id", "class_id", none)).unionAll(shown("link", links, "class_id", "head", F.col("shared")))


@query("c15_shared_pairs", f"""
WITH {MEMBERS_SQL}
SELECT 'class' AS part, blob_id AS x, class_id AS y, CAST(NULL AS BIGINT) AS shared FROM c
UNION ALL SELECT 'pair', a.class_id, b.class_id, count(*) FROM h AS a JOIN h AS b ON a.chunk_id = b.chunk_id AND a.class_id < b.class_id GROUP BY a.class_id, b.class_id""")
def _(t):
    classes, pairs = s.shared_pairs(t.fx_chunk_entries)
    shown = lambda part, df, x, y, n: df.select(F.lit(part).alias("part"), F.col(x).alias("x"), F.col(y).alias("y"), n)
    return shown("class", classes, "blob_id", "class_id", F.lit(None).cast("long").alias("shared")).unionAll(shown("pair", pairs, "a", "b", F.col("shared")))


@query("c16_upload_plan", """
SELECT d.doc_id AS path_id, CASE WHEN p.nar_hash = md5(d.text) AND d.lang <> 'fr' THEN 'skip' ELSE 'upload' END AS action FROM documents AS d
LEFT JOIN (SELECT * FROM fx_paths WHERE manifest_status = 'complete') AS p ON p.path_id = d.doc_id""")
def _(t):
    outputs = t.documents.select(F.col("doc_id").alias("path_id"), F.when(F.col("lang") == "fr", F.lit("?")).otherwise(F.md5("text")).alias("nar_hash"))
    return s.upload_plan(outputs, t.fx_paths.filter("manifest_status = 'complete'"))


@query("c17_claim", """
WITH r AS (SELECT DISTINCT l_partkey AS path_id, l_suppkey AS worker FROM lineitem)
SELECT r.path_id, worker, CASE WHEN manifest_status = 'complete' THEN 'complete' WHEN (manifest_status = 'uploading' AND age_hours <= 500) OR worker <> min(worker) OVER (PARTITION BY r.path_id) THEN 'concurrent' ELSE 'owned' END AS verdict
FROM r LEFT JOIN fx_paths AS p ON p.path_id = r.path_id""")
def _(t):
    requests = t.lineitem.select(F.col("l_partkey").alias("path_id"), F.col("l_suppkey").alias("worker")).distinct()
    return s.claim(requests, t.fx_paths.withColumnRenamed("age_hours", "idle_hours"), stale_hours=500)


@query("c18_verify_fixed", "SELECT doc_id, lang <> 'de' AS matches FROM documents")
def _(t):
    algo = F.when(F.col("lang") == "en", "sha256").when(F.col("lang") == "fr", "sha1").otherwise("md5")
    declared = F.when(F.col("lang") == "en", F.sha2("text", 256)).when(F.col("lang") == "fr", F.sha1("text")).when(F.col("lang") == "de", F.lit("?")).otherwise(F.md5("text"))
    return s.verify_fixed(t.documents.select("doc_id", F.col("text").alias("content"), algo.alias("algo"), declared.alias("declared"))).select("doc_id", "matches")
