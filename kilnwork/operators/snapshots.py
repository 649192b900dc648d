"""New snapshots from old ones and changes; writers swap directories."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kilnwork.functions.columns import max_class
from kilnwork.operators.filters import TERMINAL


def insert_if_absent(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``old`` and the rows of unknown keys, one each, with an ``inserted`` flag."""
    fresh = new.dropDuplicates(list(keys)).join(old, list(keys), "left_anti")
    return old.withColumn("inserted", F.lit(False)).unionByName(fresh.select(*old.columns).withColumn("inserted", F.lit(True)))


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], rules: Mapping[str, Callable[[Column, Column], Column]] | None = None) -> DataFrame:
    """Full outer merge; a column is its rule of (old, new) where both exist, by default the new value if not null."""
    rest = [c for c in old.columns if c not in keys]
    a, b = old.select(*keys, F.struct(*rest).alias("__o")), new.select(*keys, F.struct(*rest).alias("__n"))
    default = lambda o, n: F.coalesce(n, o)
    rule = lambda c: (rules or {}).get(c, default)(F.col(f"__o.{c}"), F.col(f"__n.{c}"))
    merged = lambda c: F.when(F.col("__o").isNull(), F.col(f"__n.{c}")).when(F.col("__n").isNull(), F.col(f"__o.{c}")).otherwise(rule(c))
    return a.join(b, list(keys), "full_outer").select(*keys, *[merged(c).alias(c) for c in rest]).select(*old.columns)


def close_assignments(assignments: DataFrame, nodes: DataFrame) -> DataFrame:
    """Active assignments of terminal nodes closed: completed, cancelled, else failed."""
    over = nodes.filter(F.col("status").isin(*TERMINAL)).select("node_id", F.col("status").alias("__node"))
    closed = F.when(F.col("__node").isin("completed", "skipped"), "completed").when(F.col("__node") == "cancelled", "cancelled").otherwise("failed")
    active = ~F.col("status").isin("completed", "failed", "cancelled") & F.col("__node").isNotNull()
    joined = assignments.join(over, "node_id", "left")
    return joined.withColumn("status", F.when(active, closed).otherwise(F.col("status"))).select(*assignments.columns)


def append_failed_builder(nodes: DataFrame, failures: DataFrame) -> DataFrame:
    """``nodes`` with the failed builders added to the sorted array ``failed_builders``, each once."""
    more = failures.groupBy("node_id").agg(F.collect_set("builder_id").alias("__more"))
    joined = nodes.join(more, "node_id", "left")
    return joined.withColumn("failed_builders", F.array_sort(F.array_union("failed_builders", F.coalesce("__more", F.expr("array()"))))).drop("__more")


def clear_poison(nodes: DataFrame, age_hours: Column, ttl_hours: int = 24) -> tuple[DataFrame, DataFrame]:
    """(nodes without expired poison, the nodes that left); those that left start anew when asked for again."""
    expired = (F.col("status") == "poisoned") & (age_hours > ttl_hours)
    left = nodes.filter(expired).withColumns({"status": F.lit("created"), "retry_count": F.lit(0)})
    return nodes.filter(~F.coalesce(expired, F.lit(False))), left


def expire(df: DataFrame, ts: str, ttl: str, as_of: str) -> DataFrame:
    """Rows not older than an interval such as '24 hours' before ``as_of``."""
    return df.filter(F.col(ts) >= F.expr(f"timestamp_ntz'{as_of}' - interval {ttl}"))


def promote_floor(nodes: DataFrame, failures: DataFrame, classes: Sequence[str], fetcher_classes: Sequence[str] = ()) -> DataFrame:
    """Nodes with a resource failure get the class after the failed one as floor.

    Nodes of ``is_fixed_output`` go by ``fetcher_classes``, others by
    ``classes``. A failure in the largest class, or in one that is not of the
    node's classes, changes nothing; of several failures the one in the largest
    class that has a next counts.
    """
    fixed = F.col("is_fixed_output") if "is_fixed_output" in nodes.columns else F.lit(False)
    failed = failures.filter("reason = 'resource'").groupBy("node_id").agg(F.collect_set("failed_class").alias("__failed"))
    after = lambda order: F.coalesce(*[F.when(F.array_contains("__failed", a), b) for a, b in reversed(list(zip(order, order[1:], strict=False)))], F.lit(None))
    raised = F.when(fixed, after(fetcher_classes)).otherwise(after(classes))
    return nodes.join(failed, "node_id", "left").withColumn("floor", F.coalesce(raised, "floor")).select(*nodes.columns)


def strip_features(nodes: DataFrame, soft: Mapping[str, str], classes: Sequence[str]) -> DataFrame:
    """Soft features leave ``features``; the largest class that one of them stands for becomes the least floor."""
    names = F.array(*[F.lit(s) for s in soft])
    floor = F.col("floor")
    for feature, hint in soft.items():
        floor = F.when(F.array_contains("features", feature), max_class(floor, F.lit(hint), classes)).otherwise(floor)
    return nodes.withColumns({"floor": floor, "features": F.array_except("features", names)})


def constraint_violations(nodes: DataFrame, edges: DataFrame, assignments: DataFrame, statuses: Sequence[str]) -> DataFrame:
    """``rule, id, n``: nodes with several active assignments, edge ends that don't exist, unknown statuses."""
    active = assignments.filter(~F.col("status").isin("completed", "failed", "cancelled"))
    several = active.groupBy(F.col("node_id").alias("id")).agg(F.count("*").alias("n")).filter("n > 1").select(F.lit("one active").alias("rule"), "id", "n")
    ends = edges.select(F.col("parent_id").alias("node_id")).union(edges.select("child_id"))
    absent = ends.join(nodes, "node_id", "left_anti").groupBy(F.col("node_id").alias("id")).agg(F.count("*").alias("n")).select(F.lit("edge end").alias("rule"), "id", "n")
    odd = nodes.filter(~F.col("status").isin(*statuses)).select(F.lit("status").alias("rule"), F.col("node_id").alias("id"), F.lit(1).cast("long").alias("n"))
    return several.union(absent).union(odd)
