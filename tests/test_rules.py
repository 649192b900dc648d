"""Rules whose values come from the system described: odd inputs that the tables don't hold."""

import pytest
from pyspark.sql import functions as F

from kilnwork.functions.columns import parse_cpu_millis
from kilnwork.operators.filters import rejection_reason
from kilnwork.operators.pages import page_offset
from kilnwork.operators.snapshots import promote_floor
from kilnwork.operators.windows import overdue_nodes
from kilnwork.sources.manifests import encode_manifest


def test_cpu_quantities(spark):
    want = {"64": 64000, "136000m": 136000, "1.5": 1500, "0.0015": 2, "1e3": 10**6, "1.5m": 0, " 64": 0, "64 ": 0, "m": 0, "": 0, "x": 0, "-1": 0, ".5": 500, "5.": 5000, "+7m": 7, "0m": 0}
    rows = spark.createDataFrame([(k,) for k in want], "q string").withColumn("n", parse_cpu_millis(F.col("q")))
    assert {r.q: r.n for r in rows.collect()} == want


def test_rejections(spark):
    shape = "id int, is_fixed_output boolean, node_system string, needs array<string>, failed_on array<long>, class_rank int, memory_needed long, kind string, system string, offers array<string>, executor_id long, executor_rank int, memory_total long"
    base = (False, "x", [], [], 1, 50, "builder", "x", [], 7, 1, 100)
    odd = {1: {}, 2: {9: 0 + 1, 10: 2}, 3: {10: None}, 4: {4: None, 10: None}, 5: {11: 0}, 6: {11: 40}, 7: {5: None, 11: 1}, 8: {1: "builtin"}, 9: {3: [7]}, 10: {0: True}, 11: {11: None}}
    rows = [(i, *[change.get(k, v) for k, v in enumerate(base)]) for i, change in odd.items()]
    rows[1] = (2, *[2 if k == 10 else v for k, v in enumerate(base)])
    pairs = spark.createDataFrame(rows, shape)
    for flag in ("draining", "degraded", "closed", "busy"):
        pairs = pairs.withColumn(flag, F.lit(False))
    got = {r.id: r.reason for r in rejection_reason(pairs.withColumn("registered", F.lit(True))).collect()}
    assert got == {1: None, 2: "class", 3: "class undeclared", 4: None, 5: None, 6: "memory", 7: None, 8: "system", 9: "failed-on", 10: "kind", 11: None}


def test_overdue_without_a_finite_estimate(spark):
    rows = spark.createDataFrame([(1, float("nan")), (2, float("inf")), (3, None), (4, 1e9), (5, -1.0)], "node_id long, estimate double")
    rows = rows.withColumn("started_at", F.expr("timestamp_ntz'2024-01-01 00:00:00'"))
    got = {r.node_id: r.limit_secs for r in overdue_nodes(rows, "2024-02-01 00:00:00").collect()}
    assert got == {1: 7800.0, 2: 7800.0, 3: 7800.0, 5: 7800.0}


def test_floor_follows_the_failed_class(spark):
    nodes = spark.createDataFrame([(i, "large" if i == 4 else None, i == 5) for i in range(1, 8)], "node_id long, floor string, is_fixed_output boolean")
    failed = [(1, "small"), (2, "large"), (3, "small"), (3, "medium"), (4, "small"), (5, "f1"), (6, "odd"), (2, "small")]
    failures = spark.createDataFrame([(i, "resource", c) for i, c in failed] + [(7, "other", "small")], "node_id long, reason string, failed_class string")
    got = {r.node_id: r.floor for r in promote_floor(nodes, failures, ["small", "medium", "large"], ["f1", "f2"]).collect()}
    assert got == {1: "medium", 2: "medium", 3: "large", 4: "medium", 5: "f2", 6: None, 7: None}


def test_page_beyond_the_end_has_the_total(spark):
    builds = spark.range(5).select(F.col("id").alias("build_id"), F.current_timestamp().alias("submitted_at"))
    assert [(r.build_id, r.total) for r in page_offset(builds, 2, 4).collect()] == [(0, 5)]
    assert [(r.build_id, r.total) for r in page_offset(builds, 2, 40).collect()] == [(None, 5)]


def test_manifest_of_too_many_entries(spark):
    entries = spark.range(3).select(F.lit(1).alias("blob_id"), F.col("id").alias("idx"), F.unhex(F.sha2(F.col("id").cast("string"), 256)).alias("chunk_hash"), F.lit(5).alias("size"))
    assert encode_manifest(entries, max_entries=3).count() == 1
    with pytest.raises(Exception, match="too many entries"):
        encode_manifest(entries, max_entries=2).collect()


def test_a_centre_with_very_many_neighbours_is_split(spark):
    """The join of a star's edges with the stored minima has shuffles alone below it, so it is split."""
    from kilnwork.plans.components import _large_star, connected_components

    edges = spark.range(200_000).select(F.when(F.col("id") % 50 == 0, F.col("id")).otherwise(F.lit(0)).alias("u"), (F.col("id") + 1).alias("v"))
    thresholds = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "50KB", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "50KB", "spark.sql.shuffle.partitions": "16"}
    before = {k: spark.conf.get(k) for k in thresholds}
    try:
        for k, v in thresholds.items():
            spark.conf.set(k, v)
        moved = _large_star(edges, many=True)
        moved.collect()
        assert "skew=true" in moved._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    found = connected_components(edges, "u", "v")
    assert found.agg(F.countDistinct("label")).first()[0] == 1 and found.filter("label = 0").count() == 200_001


def test_candidate_matrix_counts_failures_apart(spark):
    """The matrix of profiles equals the reasons of every node with every executor; executors may serve several systems."""
    from kilnwork.operators.joins import PROFILE, candidate_matrix

    nodes = spark.range(40).select(
        "id", (F.col("id") % 5 == 0).alias("is_fixed_output"), F.element_at(F.array(F.lit("x"), F.lit("y"), F.lit("any")), (F.col("id") % 3 + 1).cast("int")).alias("node_system"),
        F.array().cast("array<string>").alias("needs"), F.when(F.col("id") % 2 == 0, F.array(F.col("id") % 4, F.col("id") % 6, F.col("id") % 4)).otherwise(F.array().cast("array<bigint>")).alias("failed_on"),
        F.when(F.col("id") % 7 > 0, F.col("id") % 2).alias("class_rank"), F.lit(5).alias("memory_needed"),
    )
    executors = spark.range(6).select(
        F.col("id").alias("executor_id"), F.when(F.col("id") == 5, "fetcher").otherwise("builder").alias("kind"), *[F.lit(False).alias(c) for c in ("draining", "degraded", "closed", "busy")],
        F.lit(True).alias("registered"), F.when(F.col("id") % 2 == 0, F.array(F.lit("x"), F.lit("any"))).otherwise(F.array(F.lit("y"))).alias("systems"),
        F.array().cast("array<string>").alias("offers"), F.when(F.col("id") < 4, F.col("id") % 2).alias("executor_rank"), F.lit(0).alias("memory_total"),
    )
    want = rejection_reason(nodes.crossJoin(executors)).groupBy(*PROFILE, "executor_id", "reason").agg(F.count("*").alias("nodes"))
    got = candidate_matrix(nodes, executors).select(*want.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert {r.reason for r in got.select("reason").distinct().collect()} >= {None, "failed-on", "system", "class"}


def test_sizes_beyond_the_last_unit(spark):
    """Order keys of larger tables pass a TiB, which the SQL of f6_human_bytes shows in GiB; halves are rounded as printf does."""
    from kilnwork.functions.columns import human_bytes

    sizes = [0, 1023, 1024, 1280, 1792, 1 << 20, (1 << 30) + (1 << 28), (1 << 40) - 1, 1 << 40, 17 * 899_999**2 + 3]
    df = spark.createDataFrame([(n,) for n in sizes], "n long")
    for units in (("KiB", "MiB", "GiB"), ("KiB", "MiB", "GiB", "TiB")):
        got = {r.n: r.shown for r in df.select("n", human_bytes(F.col("n"), units).alias("shown")).collect()}
        place = {n: min(max(i for i in range(5) if i == 0 or n >= 1024**i), len(units)) for n in sizes}
        assert got == {n: f"{n / 1024**i:.1f} {units[i - 1]}" if i else f"{n} B" for n, i in place.items()}


def test_upstreams_of_a_tenant_do_not_meet_all_its_requests(spark):
    """Joins give no more rows than the requests have holders; the least (priority, id) that has the path wins."""
    from test_graph import most_joined

    from kilnwork.operators.joins import first_upstream

    requested = spark.range(2000).select(F.lit(1).cast("long").alias("tenant_id"), F.col("id").alias("path_id"))
    upstreams = spark.range(500).select(F.lit(1).cast("long").alias("tenant_id"), F.col("id").alias("upstream_id"), (F.col("id") % 4).alias("priority"))
    available = spark.range(2000).select(F.explode(F.array(F.col("id") % 500, (F.col("id") + 1) % 500, F.lit(900).cast("long"))).alias("upstream_id"), F.col("id").alias("path_id"))
    found = first_upstream(requested, upstreams, available)
    want = {i: min(((u % 4, u) for u in (i % 500, (i + 1) % 500)))[1] for i in range(2000)}
    assert {r.path_id: r.upstream_id for r in found.collect()} == want
    assert most_joined(found) <= 6000


def test_realisations_are_dealt_by_their_number(spark, inputs, monkeypatch):
    """A task holds a bounded number of outputs, whatever the session's number of shuffle partitions."""
    from kilnwork.operators import graph as g
    from kilnwork.plans import stored as s

    monkeypatch.setattr(s, "TASK_ROWS", 500)
    monkeypatch.setattr(g, "TASK_ROWS", 500)
    made = inputs.fx_realisations
    assert made.rdd.getNumPartitions() == inputs.lineitem.count() // 500 + 1
    assert made.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] < 1000
    wanted = made.select("key_id", "output_name")
    hits = g.realised_hits(wanted, made, made.select("path_id"))
    assert hits.rdd.getNumPartitions() == wanted.count() // 500 + 1
    assert hits.count() == made.select("key_id").distinct().count()


def test_edges_are_dealt_by_their_number(spark, inputs, monkeypatch):
    """Pairs are made distinct in tasks of a bounded number, and equal the view's SQL."""
    from kilnwork.plans.stored import stored
    from kilnwork.queries import built
    from kilnwork.queries.views import VIEWS

    monkeypatch.setattr(built, "TASK_ROWS", 500)
    made = inputs.fx_edges
    plain = spark.sql(VIEWS["fx_edges"].replace("lineitem", "{rows}"), rows=inputs.lineitem)
    assert made.exceptAll(plain).isEmpty() and plain.exceptAll(made).isEmpty()
    assert made.rdd.getNumPartitions() > made.count() // 500
    kept = stored(made)
    assert stored(kept) is kept


def test_paths_over_repeated_edges(spark):
    from kilnwork.operators.graph import critical_path

    nodes = spark.createDataFrame([(1, "queued", 2.0), (2, "queued", 3.0), (3, "queued", 4.0)], "node_id long, status string, estimate double")
    edges = spark.createDataFrame([(1, 2), (1, 2), (2, 3), (1, 3), (2, 3)], "parent_id long, child_id long")
    assert {tuple(r) for r in critical_path(nodes, edges).collect()} == {(1, 9.0), (2, 7.0), (3, 4.0)}
