"""Lookups and matches between build and store tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kilnwork.operators.filters import reason_after_failures, reason_before_failures
from kilnwork.plans.stored import stored
from kilnwork.plans.running import carry_forward


def build_nodes_of(builds: DataFrame, build_nodes: DataFrame, nodes: DataFrame, build_id=None) -> DataFrame:
    """Nodes of each build, or of one, a null name as ''."""
    members = build_nodes if build_id is None else build_nodes.filter(F.col("build_id") == build_id)
    members = members.join(builds.select("build_id"), "build_id", "left_semi")
    return members.join(nodes, "node_id").withColumn("pname", F.coalesce("pname", F.lit("")))


def complete_paths(paths: DataFrame, manifests: DataFrame, key: str = "path_id") -> DataFrame:
    return paths.join(manifests.filter("manifest_status = 'complete'").select(key), key)


def missing_paths(requested: DataFrame, complete: DataFrame, key: str = "path_id") -> DataFrame:
    """Requested rows without a complete path; order column and repeats are kept."""
    return requested.join(complete.select(key), key, "left_anti")


def lookup_paths(requested: DataFrame, complete: DataFrame, key: str = "path_id") -> DataFrame:
    """Every requested row, with nulls for a miss."""
    return requested.join(complete, key, "left")


def lookup_outputs(keys: DataFrame, realisations: DataFrame) -> DataFrame:
    return keys.join(realisations, ["key_id", "output_name"])


def manifest_batch(requested: DataFrame, inline: DataFrame, lists: DataFrame, key: str = "path_id") -> DataFrame:
    """``storage`` of each requested path: inline, chunked with its list, or an error for neither."""
    counted = lists.groupBy(key).agg(F.count("*").alias("chunks"))
    found = requested.join(inline.select(key, F.lit(True).alias("__inline")), key, "left").join(counted, key, "left")
    return found.withColumn("storage", F.when(F.col("__inline"), "inline").when(F.col("chunks") > 0, "chunked").otherwise("no list")).drop("__inline")


def induced_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with both ends among ``nodes``."""
    ids = nodes.select("node_id")
    kept = edges.join(ids, F.col("parent_id") == F.col("node_id"), "left_semi")
    return kept.join(ids, F.col("child_id") == F.col("node_id"), "left_semi")


def estimate(nodes: DataFrame, history: DataFrame, default_secs: float = 30.0, bytes_per_sec: float = 1e7, least_secs: float = 5.0) -> DataFrame:
    """Add ``duration, rule``: by name and system, mean of the name, input bytes, or the default."""
    exact = history.select("pname", "system", F.col("ema_duration_secs").alias("__exact"))
    means = history.groupBy("pname").agg(F.avg("ema_duration_secs").alias("__mean"))
    found = nodes.join(exact, ["pname", "system"], "left").join(means, "pname", "left")
    by_size = F.when(F.col("input_bytes") > 0, F.greatest(F.col("input_bytes") / bytes_per_sec, F.lit(least_secs)))
    rule = F.when(F.col("__exact").isNotNull(), "exact").when(F.col("__mean").isNotNull(), "name").when(by_size.isNotNull(), "size").otherwise("default")
    return found.withColumns({"rule": rule, "duration": F.coalesce("__exact", "__mean", by_size, F.lit(default_secs))}).drop("__exact", "__mean")


PROFILE = ("is_fixed_output", "node_system", "needs", "class_rank", "memory_needed")


def candidate_matrix(nodes: DataFrame, executors: DataFrame) -> DataFrame:
    """``profile columns, executor_id, reason, nodes``: why an executor can't run so many nodes of a profile.

    Nodes with equal demands are one profile, whatever they failed on, so pairs
    number demands by executors. Nodes that failed on an executor (``failed_on``)
    are counted by a join on the executor and taken off the profile's number
    there, where no earlier clause keeps all of its nodes off.
    """
    counted = stored(nodes.groupBy(*PROFILE).agg(F.count("*").alias("all_nodes")).withColumn("profile", F.to_json(F.struct(*PROFILE))))
    hashed = nodes.withColumn("profile", F.to_json(F.struct(*PROFILE)))
    failed = hashed.select("profile", F.explode(F.array_distinct("failed_on")).alias("executor_id")).groupBy("profile", "executor_id").agg(F.count("*").alias("failed"))
    pairs = counted.crossJoin(executors)
    judged = pairs.select("profile", *PROFILE, "all_nodes", "executor_id", reason_before_failures(pairs.columns).alias("__before"), reason_after_failures().alias("__after"))
    left = judged.join(failed, ["profile", "executor_id"], "left").withColumn("failed", F.coalesce("failed", F.lit(0)))
    every = F.array(F.struct(F.col("__before").alias("reason"), F.col("all_nodes").alias("nodes")))
    apart = F.array(
        F.struct(F.lit("failed-on").alias("reason"), F.col("failed").alias("nodes")), F.struct(F.col("__after").alias("reason"), (F.col("all_nodes") - F.col("failed")).alias("nodes"))
    )
    return left.select(*PROFILE, "executor_id", F.inline(F.when(F.col("__before").isNotNull(), every).otherwise(apart))).filter("nodes > 0")


def classify(df: DataFrame, classes: list[tuple[str, float, float, float]], dur: Column, mem: Column, cpu: Column, floor: Column | None = None) -> DataFrame:
    """Add ``size_class``: smallest cutoff at or above the duration, else the last; over a limit one up; at least the floor.

    ``classes`` are (name, cutoff, memory limit, cpu limit) by rising cutoff.
    """
    last = len(classes) - 1
    at = F.coalesce(*[F.when(dur <= cut, F.lit(i)) for i, (_, cut, _, _) in enumerate(classes)], F.lit(last))
    limits = F.array(*[F.struct(F.lit(c[0]).alias("name"), F.lit(float(c[2])).alias("mem"), F.lit(float(c[3])).alias("cpu")) for c in classes])
    own = F.get(limits, at)
    over = F.coalesce((mem > own["mem"]) | (cpu > own["cpu"]), F.coalesce(mem > own["mem"], F.lit(False)) | F.coalesce(cpu > own["cpu"], F.lit(False)))
    bumped = F.least(at + over.cast("int"), F.lit(last))
    if floor is not None:
        rank = F.array_position(F.array(*[F.lit(c[0]) for c in classes]), floor).cast("int") - 1
        bumped = F.greatest(bumped, F.coalesce(rank, F.lit(0)))
    return df.withColumn("size_class", F.get(limits, bumped)["name"])


def referrers(path_refs: DataFrame, targets: DataFrame) -> DataFrame:
    """Paths that refer to a target, each once; ``path_refs`` has one row a reference or an array ``refs``."""
    refs = path_refs.select("path_id", F.explode("refs").alias("ref_id")) if "refs" in path_refs.columns else path_refs
    return refs.join(targets.select(F.col("path_id").alias("ref_id")), "ref_id", "left_semi").select("path_id").distinct()


def diff_sources(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """``key, side`` of each id: both, left or right."""
    a, b = left.select(key, F.lit(True).alias("__l")).distinct(), right.select(key, F.lit(True).alias("__r")).distinct()
    side = F.when(F.col("__l").isNull(), "right").when(F.col("__r").isNull(), "left").otherwise("both")
    return a.join(b, key, "full_outer").select(key, side.alias("side"), (side != "both").alias("diverges"))


def first_upstream(requested: DataFrame, upstreams: DataFrame, available: DataFrame) -> DataFrame:
    """For each (tenant_id, path_id), the tenant's upstream of the least (priority, id) that has the path.

    Requests meet the holders of their path first: tenants are few, and all of
    a tenant's upstreams beside each of its requests would be far more rows.
    """
    offered = requested.join(available, "path_id").join(upstreams, ["tenant_id", "upstream_id"])
    return offered.groupBy("tenant_id", "path_id").agg(F.min(F.struct("priority", "upstream_id")).alias("best")).select("tenant_id", "path_id", F.col("best.upstream_id").alias("upstream_id"))


def prior_outputs(realisations: DataFrame) -> DataFrame:
    """For each key, the least other key that made the same path.

    The two least keys of a path answer for all, so no pairs are formed.
    """
    least = realisations.select("key_id", "path_id").distinct().groupBy("path_id").agg(F.min("key_id").alias("first"))
    rest = realisations.select("key_id", "path_id").distinct().join(least, "path_id")
    second = rest.filter("key_id <> first").groupBy("path_id").agg(F.min("key_id").alias("second"))
    both = rest.join(second, "path_id")
    return both.select("key_id", "path_id", F.when(F.col("key_id") == F.col("first"), F.col("second")).otherwise(F.col("first")).alias("prior_key"))


def orphan_nodes(nodes: DataFrame, build_nodes: DataFrame, assignments: DataFrame, limit: int | None = None) -> DataFrame:
    """Terminal nodes in no build and without an active assignment, the least ids if limited."""
    from kilnwork.operators.filters import TERMINAL

    active = assignments.filter(~F.col("status").isin("completed", "failed", "cancelled"))
    left = nodes.filter(F.col("status").isin(*TERMINAL)).join(build_nodes, "node_id", "left_anti").join(active, "node_id", "left_anti")
    return left if limit is None else left.orderBy("node_id").limit(limit)


def stale_pins(pins: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pins whose node is absent or terminal; a null owner is stale."""
    from kilnwork.operators.filters import TERMINAL

    return pins.join(nodes.filter(~F.col("status").isin(*TERMINAL)).select("drv_hash"), "drv_hash", "left_anti")


def visible(paths: DataFrame, owners: DataFrame, trust: DataFrame, tenant_id=None) -> DataFrame:
    """Paths the tenant may see: its own, others' only if trusted, unowned only if trusted; None sees all."""
    if tenant_id is None:
        return paths
    own = owners.groupBy("path_id").agg(F.bool_or(F.col("tenant_id") == tenant_id).alias("__mine"))
    seen = paths.join(own, "path_id", "left").join(trust.select("path_id", F.col("trusted").alias("__trusted")), "path_id", "left")
    return seen.filter(F.coalesce("__mine", F.lit(False)) | F.coalesce("__trusted", F.lit(False))).drop("__mine", "__trusted")


def partition_requests(requested: DataFrame, outputs: DataFrame, complete: DataFrame, substitutable: DataFrame) -> DataFrame:
    """``node_id, output_name, verdict``: present, substitute, build, or unknown for an output nobody declares."""
    found = (
        requested.join(outputs, ["node_id", "output_name"], "left")
        .join(complete.select("path_id", F.lit(True).alias("__there")), "path_id", "left")
        .join(substitutable.select("path_id", F.lit(True).alias("__sub")), "path_id", "left")
    )
    verdict = F.when(F.col("path_id").isNull(), "unknown").when(F.col("__there"), "present").when(F.col("__sub"), "substitute").otherwise("build")
    return found.select("node_id", "output_name", verdict.alias("verdict"))


def stranded_assignments(nodes: DataFrame, executors: DataFrame) -> DataFrame:
    """Assigned or running nodes whose executor is null, absent, or running something else."""
    held = executors.select(F.col("executor_id").alias("__id"), "running_node")
    joined = nodes.filter(F.col("status").isin("assigned", "running")).join(held, F.col("executor_id") == F.col("__id"), "left")
    return joined.filter(~F.col("running_node").eqNullSafe(F.col("node_id"))).drop("__id", "running_node")


def ownership_rows(outputs: DataFrame, build_nodes: DataFrame, builds: DataFrame) -> DataFrame:
    """Output paths by the tenants of all builds that want the node."""
    wanted = build_nodes.join(builds.select("build_id", "tenant_id"), "build_id").select("node_id", "tenant_id").distinct()
    return outputs.select("node_id", "path_id").join(wanted, "node_id").select("path_id", "tenant_id").distinct()


def asof_join(events: DataFrame, versions: DataFrame, by: str, ts: str, value: str, part: str | None = None) -> DataFrame:
    """``events`` with the ``value`` of the last version at or before their time, null before the first.

    Both sides are one stream by key and time; versions come first at a tie. A
    key with very many rows is split over ranges of time: of a unit such as
    'day' if ``part`` names one, which saves finding them by a sample.
    """
    left = events.withColumns({"__ours": F.lit(1), f"__{value}": F.lit(None).cast(versions.schema[value].dataType)})
    right = versions.select(by, ts, F.lit(0).alias("__ours"), F.col(value).alias(f"__{value}"))
    both = carry_forward(left.unionByName(right, allowMissingColumns=True), [by], [ts, "__ours"], f"__{value}", value, F.date_trunc(part, ts) if part else None)
    return both.filter("__ours = 1").drop("__ours", f"__{value}")
