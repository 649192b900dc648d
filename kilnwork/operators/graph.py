"""Operators over the dependency graph: ``edges(parent_id, child_id)``, a parent needs its child."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kilnwork.operators.filters import DONE, RETRIABLE, TERMINAL
from kilnwork.plans.stored import TASK_ROWS, Rounds, stored
from kilnwork.plans.walk import fold_up, strong_components, walk


def critical_path(nodes: DataFrame, edges: DataFrame, exclude_terminal: bool = True, max_rounds: int = 512) -> DataFrame:
    """``node_id, value``: a node's estimate plus the greatest value of its children, 0 for none.

    With ``exclude_terminal`` a terminal child's value does not count.
    """
    ends = nodes.select("node_id", F.col("status").isin(*TERMINAL).alias("__over"))
    counted = edges
    if exclude_terminal:
        counted = edges.join(ends.filter("__over").select(F.col("node_id").alias("child_id")), "child_id", "left_anti")
    return fold_up(
        nodes, counted, {"estimate": F.col("estimate").cast("double")},
        gather=F.max("value"),
        merge=F.greatest,
        finish=F.col("estimate") + F.coalesce("folded", F.lit(0.0)),
        kind="double",
        max_rounds=max_rounds,
    )


def live_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges whose child is not terminal."""
    return edges.join(nodes.filter(F.col("status").isin(*TERMINAL)).select(F.col("node_id").alias("child_id")), "child_id", "left_anti")


def update_ancestors(nodes: DataFrame, edges: DataFrame, values: DataFrame, changed: DataFrame, max_rounds: int = 512, exclude_terminal: bool = True) -> DataFrame:
    """``node_id, value`` of all nodes after ``changed`` (node_id, estimate) replaced estimates, from the old ``values``.

    Only ancestors of changed nodes are computed anew, and a branch ends where
    a node's value stays as it was. With ``exclude_terminal`` terminal children
    count as 0. A round stores the values that it changed, never all of them.
    """
    estimates = nodes.select("node_id", "estimate").join(changed.withColumnRenamed("estimate", "__new"), "node_id", "left")
    estimates = stored(estimates.select("node_id", F.coalesce("__new", "estimate").alias("estimate")))
    old, frontier, news = stored(values.select("node_id", "value")), stored(changed.select("node_id").distinct()), None
    now = old
    live = stored(live_edges(nodes, edges) if exclude_terminal else edges)
    for level in range(max_rounds):
        below = live.join(frontier.select(F.col("node_id").alias("parent_id")), "parent_id", "left_semi")
        best = below.join(now.withColumnRenamed("node_id", "child_id"), "child_id").groupBy(F.col("parent_id").alias("node_id")).agg(F.max("value").alias("best"))
        again = frontier.join(estimates, "node_id").join(best, "node_id", "left").select("node_id", (F.col("estimate") + F.coalesce("best", F.lit(0.0))).alias("__value"))
        moved = again.join(now, "node_id").filter("__value <> value").select("node_id", "__value", F.lit(level).alias("level"))
        news = news or Rounds(moved)
        every = news.add(moved)
        moved = every.filter(F.col("level") == level)
        if moved.isEmpty():
            return now
        latest = every.groupBy("node_id").agg(F.max_by("__value", "level").alias("__value"))
        now = old.join(latest, "node_id", "left").select("node_id", F.coalesce("__value", "value").alias("value"))
        frontier = stored(live.join(moved.select(F.col("node_id").alias("child_id")), "child_id", "left_semi").select(F.col("parent_id").alias("node_id")).distinct())
        if frontier.isEmpty():
            return now
    raise RuntimeError(f"the update did not end within {max_rounds} rounds")


def mark_unreachable(paths: DataFrame, refs: DataFrame, seeds: DataFrame, max_rounds: int = 512) -> DataFrame:
    """Complete paths that no seed reaches; seeds outside the table still lead to their references."""
    reached = walk(refs, seeds.select(F.col("path_id").alias("id")), "path_id", "ref_id", max_rounds=max_rounds)
    return paths.filter("manifest_status = 'complete'").join(reached.select(F.col("id").alias("path_id")), "path_id", "left_anti")


def closure(seeds: DataFrame, refs: DataFrame, paths: DataFrame, max_nodes: int | None = None) -> DataFrame:
    """Rows of ``paths`` reachable from the seeds, with their ``level``; ValueError beyond ``max_nodes``."""
    reached = walk(refs, seeds.select(F.col("path_id").alias("id")), "path_id", "ref_id")
    found = paths.join(reached.withColumnRenamed("id", "path_id"), "path_id")
    if max_nodes is not None and found.limit(max_nodes + 1).count() > max_nodes:
        raise ValueError(f"the closure has more than {max_nodes} paths")
    return found


def initial_states(new_nodes: DataFrame, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``node_id, state``: ready if all children are done (or there are none), dependency_failed if one failed, else queued.

    A child that is not in the graph keeps the node queued.
    """
    state = nodes.select(F.col("node_id").alias("child_id"), "status")
    below = edges.join(state, "child_id", "left").groupBy(F.col("parent_id").alias("node_id")).agg(
        F.bool_and(F.coalesce(F.col("status").isin(*DONE), F.lit(False))).alias("done"),
        F.bool_or(F.coalesce(F.col("status").isin("poisoned", "dependency_failed", "cancelled"), F.lit(False))).alias("bad"),
    )
    joined = new_nodes.select("node_id").join(below, "node_id", "left")
    state_of = F.when(F.col("bad"), "dependency_failed").when(F.coalesce("done", F.lit(True)), "ready").otherwise("queued")
    return joined.select("node_id", state_of.alias("state"))


def newly_ready(completed: DataFrame, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Queued parents of the completed nodes whose children are all done by now."""
    parents = edges.join(completed.select(F.col("node_id").alias("child_id")), "child_id", "left_semi").select(F.col("parent_id").alias("node_id")).distinct()
    waiting = nodes.filter("status = 'queued'").join(parents, "node_id", "left_semi")
    now = nodes.join(completed.select("node_id", F.lit("completed").alias("__now")), "node_id", "left").withColumn("status", F.coalesce("__now", "status"))
    return initial_states(waiting, edges.join(waiting.select(F.col("node_id").alias("parent_id")), "parent_id", "left_semi"), now).filter("state = 'ready'").select("node_id")


def cascade_failure(poisoned: DataFrame, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Ancestors of poisoned nodes that fail with them, through created, queued and ready nodes only."""
    open_ = nodes.filter(F.col("status").isin("created", "queued", "ready")).select(F.col("node_id").alias("parent_id"))
    reached = walk(edges.join(open_, "parent_id", "left_semi"), poisoned.select(F.col("node_id").alias("id")), "child_id", "parent_id")
    return reached.filter("level > 0").select(F.col("id").alias("node_id"), "level")


def cascade_cutoff(triggers: DataFrame, edges: DataFrame, nodes: DataFrame, present: DataFrame, max_nodes: int = 1000, max_rounds: int = 512) -> tuple[DataFrame, bool]:
    """(``node_id, level`` of nodes to skip, whether the cap was met).

    A queued parent is skipped if its outputs are present (``present``:
    node_id) and all its children are terminal or skipped already. At most
    ``max_nodes`` nodes are expanded, in the order of node_id in a round.
    """
    over = stored(nodes.filter(F.col("status").isin(*TERMINAL)).select("node_id"))
    may = stored(nodes.filter("status = 'queued'").join(present, "node_id", "left_semi").select("node_id"))
    frontier = stored(triggers.select("node_id").distinct())
    skipped = Rounds(frontier.withColumn("level", F.lit(0)))
    every, level, used, capped = skipped.add(frontier.withColumn("level", F.lit(0)).limit(0)), 0, 0, False
    while True:
        size = frontier.count()
        if used + size > max_nodes:
            capped, size = True, max_nodes - used
            frontier = stored(frontier.orderBy("node_id").limit(size))
        if not size:
            return every, capped
        used, level = used + size, level + 1
        if level > max_rounds:
            raise RuntimeError(f"the cascade did not end within {max_rounds} rounds")
        touched = edges.join(frontier.select(F.col("node_id").alias("child_id")), "child_id", "left_semi").select(F.col("parent_id").alias("node_id")).distinct()
        wanted = touched.join(may, "node_id", "left_semi").join(every, "node_id", "left_anti")
        gone = over.union(every.select("node_id")).select(F.col("node_id").alias("child_id"))
        open_ = edges.join(gone, "child_id", "left_anti").select(F.col("parent_id").alias("node_id"))
        every = skipped.add(wanted.join(open_, "node_id", "left_anti").withColumn("level", F.lit(level)))
        frontier = every.filter(F.col("level") == level).select("node_id")


def seconds_saved(skipped: DataFrame, nodes: DataFrame) -> DataFrame:
    joined = nodes.join(skipped.select("node_id"), "node_id", "left_semi")
    return joined.agg(F.count("*").alias("skipped"), F.coalesce(F.sum("estimate"), F.lit(0.0)).alias("saved_secs"))


def cycle_nodes(edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """``id, component`` of the nodes on a cycle: the component is the least node that lies on a cycle with it."""
    return strong_components(edges, max_rounds).select(F.col("node").alias("id"), "component")


#: Nodes of a build whose pairs are looked up among the edges without asking how many parents each node has.
SMALL_BUILD = 64


def build_roots(build_nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``build_id, node_id`` of nodes without a parent in the same build."""
    return build_nodes.select("build_id", "node_id").join(_with_parents(build_nodes, edges), ["build_id", "node_id"], "left_anti")


def _with_parents(build_nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``build_id, node_id`` of nodes with a parent in the same build.

    A node's possible parents are the nodes of its build or its parents in
    any build, whichever are fewer, so a node of very many builds costs no more
    than those builds are large, and a build of very many nodes no more than
    its nodes have edges.
    """
    members = build_nodes.select("build_id", "node_id")
    sizes = members.groupBy("build_id").agg(F.count("*").alias("__size"))
    large = stored(sizes.filter(F.col("__size") > SMALL_BUILD))
    if large.isEmpty():
        return _by_members(members, members, edges)
    edges = stored(edges.select("parent_id", "child_id"))
    degrees = edges.groupBy(F.col("child_id").alias("node_id")).agg(F.count("*").alias("__parents"))
    rest = members.join(large, "build_id").join(degrees, "node_id")
    few = members.join(large, "build_id", "left_anti").unionByName(rest.filter(F.col("__size") <= F.col("__parents")).select("build_id", "node_id"))
    above = rest.filter(F.col("__size") > F.col("__parents")).select("build_id", "node_id").join(edges.withColumnRenamed("child_id", "node_id"), "node_id")
    by_edges = above.join(members.withColumnRenamed("node_id", "parent_id"), ["build_id", "parent_id"], "left_semi").select("build_id", "node_id")
    return _by_members(few, members, edges).unionByName(by_edges)


def _by_members(rows: DataFrame, members: DataFrame, edges: DataFrame) -> DataFrame:
    """``rows`` (build_id, node_id) to which an edge leads from a member of their build."""
    pairs = rows.join(members.withColumnRenamed("node_id", "parent_id"), "build_id").withColumnRenamed("node_id", "child_id")
    return pairs.join(edges.select("parent_id", "child_id"), ["parent_id", "child_id"], "left_semi").select("build_id", F.col("child_id").alias("node_id"))


def dependents(seeds: DataFrame, deps: DataFrame, max_nodes: int = 10_000) -> DataFrame:
    """``id, level`` of what depends on the seeds over ``deps(id, needs)``; ValueError beyond ``max_nodes``."""
    reached = walk(deps, seeds, "needs", "id")
    if reached.limit(max_nodes + 1).count() > max_nodes:
        raise ValueError(f"more than {max_nodes} dependents")
    return reached


def merkle_fingerprint(nodes: DataFrame, edges: DataFrame, fields: Sequence[str]) -> DataFrame:
    """``node_id, value``: sha256 of a node's fields and its children's values, sorted.

    Fixed outputs depend on their own fields only. Values travel as bytes, half
    as long as their hex text and in the same order.
    """
    free = edges.join(nodes.filter("is_fixed_output").select(F.col("node_id").alias("parent_id")), "parent_id", "left_anti")
    own = F.concat_ws("|", *[F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields])
    below = F.array_join(F.transform(F.array_sort(F.col("folded")), lambda v: F.lower(F.hex(v))), ",")
    folded = fold_up(
        nodes, free.select("parent_id", "child_id").distinct(), {"own": own},
        gather=F.collect_list("value"),
        merge=lambda before, more: F.concat(F.coalesce(before, F.array().cast("array<binary>")), more),
        finish=F.unhex(F.sha2(F.concat_ws("#", "own", F.coalesce(below, F.lit(""))), 256)),
        kind="array<binary>",
    )
    return folded.select("node_id", F.lower(F.hex("value")).alias("value"))


def needs_resolve(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``node_id, needs_resolve``: whether a child has a floating output."""
    floating = nodes.filter("is_floating").select(F.col("node_id").alias("child_id"))
    above = edges.join(floating, "child_id", "left_semi").select(F.col("parent_id").alias("node_id")).distinct().withColumn("__hit", F.lit(True))
    return nodes.select("node_id").join(above, "node_id", "left").select("node_id", F.coalesce("__hit", F.lit(False)).alias("needs_resolve"))


def prune_to_roots(build_nodes: DataFrame, edges: DataFrame, nodes: DataFrame, outputs: DataFrame, present: DataFrame) -> DataFrame:
    """``build_id, node_id``: only the roots of builds whose roots have all outputs and none floating, else all nodes."""
    roots = stored(build_roots(build_nodes, edges))
    hits = cache_probe(nodes, outputs, present, present.limit(0)).filter("verdict = 'hit'").select("node_id", F.lit(True).alias("__hit"))
    fixed = nodes.select("node_id", ~F.col("is_floating")).toDF("node_id", "__known")
    judged = roots.join(fixed, "node_id").join(hits, "node_id", "left").groupBy("build_id").agg(F.bool_and(F.col("__known") & F.coalesce("__hit", F.lit(False))).alias("__all"))
    short = stored(judged.filter("__all").select("build_id"))
    return roots.join(short, "build_id", "left_semi").unionByName(build_nodes.select("build_id", "node_id").join(short, "build_id", "left_anti"))


def resurrect(candidates: DataFrame, refs: DataFrame, pins: DataFrame) -> DataFrame:
    """Candidates that stay dead: without a live referrer or pin, and not below one that came back."""
    ids = candidates.select("path_id")
    alive = refs.join(ids, "path_id", "left_anti").join(ids.select(F.col("path_id").alias("ref_id")), "ref_id", "left_semi").select(F.col("ref_id").alias("id"))
    back = alive.union(ids.join(pins, "path_id", "left_semi"))
    inside = refs.join(ids, "path_id", "left_semi").join(ids.select(F.col("path_id").alias("ref_id")), "ref_id", "left_semi")
    return ids.join(walk(inside, back, "path_id", "ref_id").select(F.col("id").alias("path_id")), "path_id", "left_anti")


def cache_probe(nodes: DataFrame, outputs: DataFrame, present: DataFrame, substitutable: DataFrame) -> DataFrame:
    """``node_id, verdict``: hit if all outputs are there, pending if the rest can be fetched, else miss; no outputs: miss."""
    there, sub = present.select("path_id", F.lit(True).alias("__there")).distinct(), substitutable.select("path_id", F.lit(True).alias("__sub")).distinct()
    judged = outputs.filter("path_id is not null").join(there, "path_id", "left").join(sub, "path_id", "left")
    per = judged.groupBy("node_id").agg(
        F.bool_and(F.coalesce("__there", F.lit(False))).alias("hit"), F.bool_and(F.coalesce("__there", "__sub", F.lit(False))).alias("fetch")
    )
    verdict = F.when(F.col("hit"), "hit").when(F.col("fetch"), "pending").otherwise("miss")
    return nodes.select("node_id").join(per, "node_id", "left").select("node_id", verdict.alias("verdict"))


def realised_hits(wanted: DataFrame, realisations: DataFrame, present: DataFrame) -> DataFrame:
    """``key_id`` whose wanted outputs are all realised, in paths that are all still there."""
    there = present.select("path_id", F.lit(True).alias("__there")).distinct()
    found = wanted.join(realisations, ["key_id", "output_name"], "left").join(there, "path_id", "left")
    return found.repartition(wanted.count() // TASK_ROWS + 1, "key_id").groupBy("key_id").agg(F.bool_and(F.coalesce("__there", F.lit(False))).alias("all")).filter("all").select("key_id")


def merge_dag(nodes: DataFrame, edges: DataFrame, new_nodes: DataFrame, new_edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes with ``change``, edges) after a request's graph is added.

    New nodes are deduplicated by id. A known node stays as it was ('kept'),
    unless it can be retried: then the new row replaces it and its retry count
    stays ('reset'). Unknown nodes are 'inserted'. Edges are distinct.
    """
    fresh = new_nodes.dropDuplicates(["node_id"])
    rest = [c for c in nodes.columns if c != "node_id"]
    old = nodes.select("node_id", F.struct(*rest).alias("__old"))
    new = fresh.select("node_id", F.struct(*rest).alias("__new"))
    both = old.join(new, "node_id", "full_outer")
    change = (
        F.when(F.col("__old").isNull(), "inserted")
        .when(F.col("__new").isNotNull() & F.col("__old.status").isin(*RETRIABLE), "reset")
        .otherwise("kept")
    )
    take = lambda c: F.when(F.col("change") == "kept", F.col(f"__old.{c}")).when((F.col("change") == "reset") & F.lit(c == "retry_count"), F.col(f"__old.{c}")).otherwise(F.col(f"__new.{c}"))
    merged = both.withColumn("change", change).select("node_id", *[take(c).alias(c) for c in rest], "change")
    return merged, edges.select("parent_id", "child_id").union(new_edges.select("parent_id", "child_id")).distinct()
