"""Unions, differences and root sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kilnwork.operators.filters import TERMINAL


def mark_seeds(paths: DataFrame, pins: DataFrame, owners: DataFrame, tenants: DataFrame, extra: DataFrame, grace_hours: int = 2) -> DataFrame:
    """``path_id`` of every root, each once.

    Roots are uploads in flight, paths younger than the grace, pins, extra
    roots, and paths that a tenant referred to within its retention.
    """
    kept = owners.join(tenants.select("tenant_id", "gc_retention_hours"), "tenant_id").filter("ref_age_hours <= gc_retention_hours")
    parts = [
        paths.filter("manifest_status = 'uploading'"),
        paths.filter(F.col("age_hours") <= grace_hours),
        pins,
        extra,
        kept,
    ]
    out = parts[0].select("path_id")
    for part in parts[1:]:
        out = out.union(part.select("path_id"))
    return out.distinct()


def all_ids(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    return left.select(key).union(right.select(key)).distinct()


def difference(a: DataFrame, b: DataFrame, keep_duplicates: bool = False) -> DataFrame:
    return a.exceptAll(b) if keep_duplicates else a.subtract(b)


def intersection(a: DataFrame, b: DataFrame, keep_duplicates: bool = False) -> DataFrame:
    return a.intersectAll(b) if keep_duplicates else a.intersect(b)


def live_outputs(nodes: DataFrame, expected: DataFrame, realised: DataFrame) -> DataFrame:
    """Paths that nodes which are not terminal expect or have realised."""
    live = nodes.filter(~F.col("status").isin(*TERMINAL)).select("node_id")
    return expected.select("node_id", "path_id").union(realised.select("node_id", "path_id")).join(live, "node_id", "left_semi").select("path_id").distinct()
