"""Summaries of builds, queues, classes and stores."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kilnwork.operators.filters import DONE, TERMINAL
from kilnwork.plans.running import running_totals

QUEUED = ("created", "queued", "ready")
RUNNING = ("assigned", "running")
BAD = ("failed", "poisoned", "dependency_failed")


def build_counts(build_nodes: DataFrame, nodes: DataFrame, assignments: DataFrame) -> DataFrame:
    """``build_id, total, completed, cached``; cached nodes completed without any assignment."""
    ran = assignments.select("node_id").distinct().withColumn("__ran", F.lit(True))
    joined = build_nodes.join(nodes.select("node_id", "status"), "node_id").join(ran, "node_id", "left")
    done = F.col("status") == "completed"
    return joined.groupBy("build_id").agg(
        F.count("*").alias("total"), F.count_if(done).alias("completed"), F.count_if(done & F.col("__ran").isNull()).alias("cached")
    )


def build_summary(build_nodes: DataFrame, nodes: DataFrame) -> DataFrame:
    """Counts by state, the highest priority left and the executors at work, for each build."""
    s = F.col("status")
    return build_nodes.join(nodes, "node_id").groupBy("build_id").agg(
        F.count("*").alias("total"),
        F.count_if(s.isin(*DONE)).alias("completed"),
        F.count_if(s.isin(*RUNNING)).alias("running"),
        F.count_if(s.isin(*BAD)).alias("failed"),
        F.count_if(s.isin(*QUEUED)).alias("queued"),
        F.coalesce(F.max(F.when(~s.isin(*TERMINAL), F.col("priority"))), F.lit(0.0)).alias("critical_secs"),
        F.array_sort(F.collect_set(F.when(s.isin(*RUNNING), F.col("executor_id")))).alias("executors"),
    )


def build_outcome(summary: DataFrame, builds: DataFrame) -> DataFrame:
    """``build_id, outcome``: succeeded, failed (at once, or once all is resolved if the build keeps going), active."""
    joined = summary.join(builds.select("build_id", "keep_going"), "build_id")
    resolved = F.col("completed") + F.col("failed") >= F.col("total")
    return joined.select(
        "build_id",
        F.when((F.col("completed") >= F.col("total")) & (F.col("failed") == 0), "succeeded")
        .when((F.col("failed") > 0) & (resolved | ~F.col("keep_going")), "failed")
        .otherwise("active")
        .alias("outcome"),
    )


def cluster_snapshot(executors: DataFrame, builds: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row: executors and builds by state, running nodes, and queued nodes by system as a map."""
    ex = executors.agg(
        F.count("*").alias("executors"), F.count_if("busy").alias("busy"), F.count_if("draining").alias("draining"),
        F.count_if(F.col("registered") & ~F.col("draining") & ~F.col("busy")).alias("idle"),
    )
    b = builds.agg(F.count_if(F.col("status") == "active").alias("active_builds"), F.count_if(F.col("status") == "pending").alias("pending_builds"))
    by_system = nodes.groupBy("system").agg(F.count_if(F.col("status").isin(*RUNNING)).alias("r"), F.count_if(F.col("status") == "ready").alias("q"))
    n = by_system.agg(
        F.coalesce(F.sum("r"), F.lit(0)).alias("running"), F.coalesce(F.sum("q"), F.lit(0)).alias("queued"),
        F.map_from_entries(F.sort_array(F.collect_list(F.when(F.col("q") > 0, F.struct("system", "q"))))).alias("queued_by_system"),
    )
    return ex.crossJoin(b).crossJoin(n)


def class_snapshot(nodes: DataFrame, classes: Sequence[str], features: Column | None = None) -> DataFrame:
    """``size_class, system, queued, running`` of nodes that have a ``size_class``; empty classes have a zero row of system ''."""
    used = nodes if features is None else nodes.filter(features)
    counted = used.filter(F.col("status").isin("ready", *RUNNING)).groupBy("size_class", "system").agg(
        F.count_if(F.col("status") == "ready").alias("queued"), F.count_if(F.col("status").isin(*RUNNING)).alias("running")
    )
    every = nodes.sparkSession.createDataFrame([(c,) for c in classes], "size_class string")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return every.join(counted, "size_class", "left").select("size_class", F.coalesce("system", F.lit("")).alias("system"), zero("queued"), zero("running"))


def fixed_output_snapshot(nodes: DataFrame, classes: Sequence[str]) -> DataFrame:
    """As class_snapshot for fixed outputs: queued counts whatever is wanted or at work, the default class is the first."""
    wanted = nodes.filter(F.col("is_fixed_output") & F.col("status").isin("ready", *RUNNING))
    counted = wanted.groupBy(F.coalesce("size_class", F.lit(classes[0])).alias("size_class")).agg(
        F.count("*").alias("queued"), F.count_if(F.col("status").isin(*RUNNING)).alias("running")
    )
    every = nodes.sparkSession.createDataFrame([(c,) for c in classes], "size_class string")
    return every.join(counted, "size_class", "left").fillna(0, ["queued", "running"])


def class_system_rollup(nodes: DataFrame, mode: str = "rollup") -> DataFrame:
    """Counts by class and system with subtotals; ``level`` is the grouping id."""
    grouped = {"rollup": nodes.rollup, "cube": nodes.cube}[mode]("size_class", "system")
    return grouped.agg(F.count("*").alias("n"), F.sum("estimate").alias("secs"), F.grouping_id().alias("level"))


def pool_demand(pools: DataFrame, snapshot: DataFrame) -> DataFrame:
    """``pool, demand``: queued nodes of the pool's systems and of builtin; all classes if gated, else its class."""
    systems = pools.select("pool", "size_class", "gated", F.explode(F.array_distinct(F.concat("systems", F.array(F.lit("builtin"))))).alias("system"))
    own = snapshot.select(F.col("size_class").alias("__class"), "system", "queued")
    joined = systems.join(own, "system", "left").filter(F.col("gated") | (F.col("size_class") == F.col("__class")) | F.col("__class").isNull())
    sums = joined.groupBy("pool").agg(F.sum("queued").alias("demand"))
    return pools.select("pool").join(sums, "pool", "left").fillna(0, ["demand"])


def samples_per_class(classified: DataFrame) -> DataFrame:
    return classified.groupBy("size_class").agg(F.count("*").alias("samples"))


def name_means(history: DataFrame) -> DataFrame:
    """Mean estimate of each name over its systems."""
    return history.groupBy("pname").agg(F.avg("ema_duration_secs").alias("mean_secs"), F.count("*").alias("systems"))


def tenant_usage(paths: DataFrame, owners: DataFrame, tenants: DataFrame) -> DataFrame:
    """``tenant_id, used, verdict``: over only if used is above the limit; a null limit is unlimited."""
    used = owners.select("tenant_id", "path_id").distinct().join(paths.select("path_id", "nar_size"), "path_id").groupBy("tenant_id").agg(F.sum("nar_size").alias("used"))
    limit = F.col("gc_max_store_bytes")
    at = tenants.join(used, "tenant_id", "left").withColumn("used", F.coalesce("used", F.lit(0)))
    return at.select("tenant_id", "used", F.when(limit.isNull(), "unlimited").when(F.col("used") > limit, "over").otherwise("under").alias("verdict"))


def max_sequence(event_log: DataFrame) -> DataFrame:
    return event_log.groupBy("build_id").agg(F.max("sequence").alias("last_sequence"))


def max_generation(assignments: DataFrame) -> DataFrame:
    return assignments.agg(F.coalesce(F.max("generation"), F.lit(0)).alias("generation"))


def queue_health(pending: DataFrame, max_attempts: int = 10) -> DataFrame:
    return pending.agg(F.count_if(F.col("attempts") < max_attempts).alias("pending"), F.count_if(F.col("attempts") >= max_attempts).alias("stuck"))


def trusted_keys(upstreams: DataFrame) -> DataFrame:
    """``tenant_id, key`` of all keys in the arrays ``keys``, each once."""
    return upstreams.select("tenant_id", F.explode("keys").alias("key")).distinct()


def merge_signatures(paths: DataFrame, additions: DataFrame, cap: int = 100) -> DataFrame:
    """``path_id, signatures, fault``: the union of both arrays; above the cap the old ones stay and ``fault`` says so."""
    each = additions.select("path_id", F.explode("signatures").alias("__s")).distinct()
    first = each.withColumn("__place", F.row_number().over(Window.partitionBy("path_id").orderBy("__s"))).filter(F.col("__place") <= cap + 1)  # one above the cap tells all
    more = first.groupBy("path_id").agg(F.sort_array(F.collect_list("__s")).alias("__more"))
    joined = paths.join(more, "path_id", "left")
    union = F.array_union("signatures", F.coalesce("__more", F.array().cast("array<string>")))
    return joined.select(
        "path_id", F.when(F.size(union) > cap, F.col("signatures")).otherwise(union).alias("signatures"), F.when(F.size(union) > cap, "too many").alias("fault")
    )


def dedup_ratio(entries: DataFrame, known: DataFrame) -> DataFrame:
    """``blob_id, chunks, ratio``: the share of a blob's chunks that were known before, 0 for none."""
    there = known.select("chunk_id", F.lit(1).alias("__known"))
    joined = entries.join(there, "chunk_id", "left").groupBy("blob_id").agg(F.count("*").alias("chunks"), F.count("__known").alias("k"))
    return joined.select("blob_id", "chunks", (F.col("k") / F.col("chunks")).alias("ratio"))


def load_fractions(classified: DataFrame, classes: Sequence[str]) -> DataFrame:
    """``size_class, fraction`` of the total duration, alike for all classes when the total is 0."""
    every = classified.sparkSession.createDataFrame([(c,) for c in classes], "size_class string")
    sums = classified.groupBy("size_class").agg(F.sum("duration_secs").alias("s"))
    total = sums.agg(F.coalesce(F.sum("s"), F.lit(0.0)).alias("t"))
    joined = every.join(sums, "size_class", "left").crossJoin(F.broadcast(total))
    return joined.select("size_class", F.when(F.col("t") == 0, 1.0 / len(classes)).otherwise(F.coalesce("s", F.lit(0.0)) / F.col("t")).alias("fraction"))


def input_bytes(node_inputs: DataFrame, paths: DataFrame) -> DataFrame:
    """``node_id, input_bytes``: sizes of a node's distinct inputs, a missing one 0."""
    joined = node_inputs.select("node_id", "path_id").distinct().join(paths.select("path_id", "nar_size"), "path_id", "left")
    return joined.groupBy("node_id").agg(F.sum(F.coalesce("nar_size", F.lit(0))).alias("input_bytes"))


def merged_options(build_nodes: DataFrame, builds: DataFrame) -> DataFrame:
    """For each node the least timeout that is not 0 (0 if none) and the most cores of its builds."""
    joined = build_nodes.join(builds.select("build_id", "timeout_secs", "cores"), "build_id")
    return joined.groupBy("node_id").agg(
        F.coalesce(F.min(F.nullif(F.col("timeout_secs"), F.lit(0))), F.lit(0)).alias("timeout_secs"), F.max("cores").alias("cores")
    )


def histogram(df: DataFrame, col: str, buckets: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """``by, le, n``: how many values are at most each bound, and in all for bound infinity."""
    counts = df.groupBy(*by).agg(*[F.count_if(F.col(col) <= b).alias(f"b{i}") for i, b in enumerate(buckets)], F.count(col).alias("b_all"))
    bounds = [F.struct(F.lit(float(b)).alias("le"), F.col(f"b{i}").alias("n")) for i, b in enumerate(buckets)]
    bounds.append(F.struct(F.lit(float("inf")).alias("le"), F.col("b_all").alias("n")))
    return counts.select(*by, F.inline(F.array(*bounds)))


def quantiles(df: DataFrame, col: str, probs: Sequence[float], by: Sequence[str] = (), exact: bool = True) -> DataFrame:
    """One column ``p<percent>`` a probability; interpolated if exact, else approximate and with bounded state.

    Exact ones count equal values first and number them over ranges of group
    and value, so that no group is held by one task. Null values don't count;
    a group without others has nulls.
    """
    names = [f"p{p * 100:g}".replace(".", "_") for p in probs]
    if not exact:
        return df.groupBy(*by).agg(*[F.percentile_approx(col, F.lit(p)).alias(n) for p, n in zip(probs, names, strict=True)])
    keys = [f"__k{i}" for i in range(len(by))]
    slim = df.select(*[F.col(b).alias(k) for b, k in zip(by, keys, strict=True)], F.col(col).cast("double").alias("__v"))
    groups = slim.groupBy(*keys).agg(F.count("__v").alias("__all"))
    if by:
        groups = running_totals(groups, [F.col(k) for k in keys], {"__upto": F.col("__all")})
    starts = groups.select(*[F.col(k).alias(f"_{k}") for k in keys], "__all", ((F.col("__upto") if by else F.col("__all")) - F.col("__all")).alias("__start"))
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], F.lit(True))
    counted = slim.filter("__v is not null").groupBy(*keys, "__v").agg(F.count("*").alias("__n"))
    placed = running_totals(counted, [*map(F.col, keys), F.col("__v")], {"__to": F.col("__n")}).join(starts, same)
    upto = F.col("__to") - F.col("__start")
    at = lambda place: F.max(F.when((upto - F.col("__n") <= place) & (place < upto), F.col("__v")))
    found = []
    for p, n in zip(probs, names, strict=True):
        place = (F.col("__all") - 1) * F.lit(float(p))
        low, high = at(F.floor(place)), at(F.ceil(place))
        found.append((low + (high - low) * F.max(place - F.floor(place))).alias(n))
    values = placed.groupBy(*keys).agg(*found)
    return starts.join(values, same, "left").select(*[F.col(f"_{k}").alias(b) for b, k in zip(by, keys, strict=True)], *names)


def distinct_counts(df: DataFrame, cols: Sequence[str], by: Sequence[str] = (), approx: bool = False) -> DataFrame:
    f = F.approx_count_distinct if approx else F.count_distinct
    return df.groupBy(*by).agg(*[f(c).alias(f"distinct_{c}") for c in cols])


def sketches(df: DataFrame, by: Sequence[str], distinct: Sequence[str] = (), quantiles_of: Sequence[str] = (), precision: int = 12, k: int = 200) -> DataFrame:
    """``by`` and a sketch a column: ``distinct_x`` of the distinct values of x, ``quantiles_x`` of its distribution.

    Sketches are of bounded size, whatever a group holds, so those of each day
    can be stored and ``merged_sketches`` of any days be made later.
    """
    seen = [F.hll_sketch_agg(F.col(c).cast("string"), F.lit(precision)).alias(f"distinct_{c}") for c in distinct]
    spread = [F.kll_sketch_agg_double(F.col(c).cast("double"), F.lit(k)).alias(f"quantiles_{c}") for c in quantiles_of]
    return df.groupBy(*by).agg(*seen, *spread)


def merged_sketches(parts: DataFrame, by: Sequence[str]) -> DataFrame:
    """Sketches of ``by``, made of those of finer groups."""
    merged = [F.hll_union_agg(c).alias(c) if c.startswith("distinct_") else F.kll_merge_agg_double(c).alias(c) for c in parts.columns if c.startswith(("distinct_", "quantiles_"))]
    return parts.groupBy(*by).agg(*merged)


def distinct_error(precision: int = 12) -> float:
    """Bound of the relative error of a distinct count, three standard errors of the sketch."""
    return 3 * 1.04 / 2 ** (precision / 2)


#: Bound of the error of a quantile's rank, at 200 items a level: twice the 1.65 percent that 99 of 100 sketches keep.
RANK_ERROR = 0.033


def accuracy(samples: DataFrame, history: DataFrame, factor: float = 2.0) -> DataFrame:
    """For each system: samples with an estimate and the share of them within ``factor`` of it."""
    ratio = F.col("duration_secs") / F.col("ema_duration_secs")
    joined = samples.join(history.select("pname", "system", "ema_duration_secs"), ["pname", "system"]).filter("ema_duration_secs > 0")
    within = F.count_if((ratio <= factor) & (ratio >= 1 / factor))
    return joined.groupBy("system").agg(F.count("*").alias("samples"), (within / F.count("*")).alias("within"))


def class_drift(classified: DataFrame, classes: Sequence[str]) -> DataFrame:
    """Assigned class by actual class: a column ``to_<class>`` each."""
    pivoted = classified.groupBy("assigned_class").pivot("size_class", list(classes)).count().fillna(0)
    return pivoted.select("assigned_class", *[F.col(c).alias(f"to_{c}") for c in classes])


def misclassified(samples: DataFrame, cutoffs: dict[str, float], factor: float = 2.0) -> DataFrame:
    """``assigned_class, n`` of samples that took over ``factor`` times their class's cutoff."""
    cut = F.element_at(F.create_map(*[x for k, v in cutoffs.items() for x in (F.lit(k), F.lit(float(v)))]), F.col("assigned_class"))
    return samples.filter(F.col("duration_secs") > factor * cut).groupBy("assigned_class").agg(F.count("*").alias("n"))


def unroutable(nodes: DataFrame, executors: DataFrame) -> DataFrame:
    """``system, n`` of ready nodes whose system no registered executor of their kind offers."""
    kind = F.when(F.col("is_fixed_output"), "fetcher").otherwise("builder")
    offered = executors.filter("registered").select("kind", "system").distinct()
    ready = nodes.filter("status = 'ready' and system <> 'builtin'").withColumn("kind", kind)
    return ready.join(offered, ["kind", "system"], "left_anti").groupBy("system").agg(F.count("*").alias("n"))


def utilisation(executors: DataFrame) -> DataFrame:
    """Share of busy executors by kind, 0 without any."""
    return executors.filter("registered").groupBy("kind").agg((F.count_if("busy") / F.count("*")).alias("utilisation"), F.count("*").alias("executors"))


def fleet_exhausted(nodes: DataFrame, failures: DataFrame, executors: DataFrame) -> DataFrame:
    """Nodes whose failed builders cover every registered executor of their kind; an empty fleet covers nothing."""
    kind = F.when(F.col("is_fixed_output"), "fetcher").otherwise("builder").alias("kind")
    fleet = executors.filter("registered").select("kind", "executor_id")
    sizes = fleet.groupBy("kind").agg(F.count("*").alias("fleet"))
    failed = failures.select("node_id", F.col("builder_id").alias("executor_id")).distinct()
    hit = failed.join(nodes.select("node_id", kind), "node_id").join(fleet, ["kind", "executor_id"])
    covered = hit.groupBy("node_id", "kind").agg(F.count("*").alias("failed"))
    return covered.join(F.broadcast(sizes), "kind").filter("failed = fleet").select("node_id")
