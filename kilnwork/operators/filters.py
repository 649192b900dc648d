"""Predicates and projections over build and store tables."""

from __future__ import annotations

from collections.abc import Mapping

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Statuses from which a node does not move on by itself, those a new request retries, and what a display shows.
TERMINAL = ("completed", "skipped", "poisoned", "dependency_failed", "cancelled")
RETRIABLE = ("failed", "dependency_failed", "cancelled")
DONE = ("completed", "skipped")
#: Status, display class and sort rank: fixed values.
DISPLAY = {
    "failed": ("bad", 0), "poisoned": ("bad", 0), "dependency_failed": ("bad", 0), "cancelled": ("bad", 0),
    "running": ("active", 1), "assigned": ("active", 1), "substituting": ("active", 1),
    "ready": ("waiting", 2), "queued": ("waiting", 2), "created": ("waiting", 2),
    "completed": ("good", 3), "skipped": ("good", 3),
}
POISON_RETRIES = 6
INLINE_BYTES = 262_144
DAY_SECS = 86_400


def opt_filter(df: DataFrame, wanted: Mapping[str, object | None]) -> DataFrame:
    """Rows that equal every value that is not None."""
    for name, value in wanted.items():
        if value is not None:
            df = df.filter(F.col(name) == value)
    return df


def with_status_class(df: DataFrame, status: str = "status") -> DataFrame:
    """Add ``terminal, retriable, display, rank``; an unknown status has no display and ranks last."""
    shown = F.create_map(*[x for k, (d, _) in DISPLAY.items() for x in (F.lit(k), F.lit(d))])
    rank = F.create_map(*[x for k, (_, r) in DISPLAY.items() for x in (F.lit(k), F.lit(r))])
    return df.withColumns(
        {
            "terminal": F.col(status).isin(*TERMINAL),
            "retriable": F.col(status).isin(*RETRIABLE),
            "display": F.try_element_at(shown, F.col(status)),
            "rank": F.coalesce(F.try_element_at(rank, F.col(status)), F.lit(4)),
        }
    )


def retriable(df: DataFrame) -> DataFrame:
    """Nodes that a new request starts again: retriable, or poisoned with retries left."""
    return df.filter(F.col("status").isin(*RETRIABLE) | ((F.col("status") == "poisoned") & (F.col("retry_count") < POISON_RETRIES)))


def is_poisoned(df: DataFrame, threshold: int = 3, distinct: bool = True) -> DataFrame:
    """Add ``poisoned``: enough failed builders in the array ``failed_builders``, each counted once if distinct."""
    n = F.size(F.array_distinct("failed_builders")) if distinct else F.size("failed_builders")
    return df.withColumn("poisoned", n >= threshold)


BASE32 = "[0-9a-df-np-sv-z]"


def parse_path(df: DataFrame, col: str, prefix: str = "/store/") -> DataFrame:
    """Add ``hash_part, name, fault`` of a store path: prefix, 32 characters, a dash, a name."""
    rest = F.substr(F.col(col), F.lit(len(prefix) + 1))
    name = F.substr(rest, F.lit(34))
    fault = (
        F.when(~F.startswith(F.col(col), F.lit(prefix)), "prefix")
        .when(F.length(rest) < 33, "too short")
        .when(F.substring(rest, 33, 1) != "-", "dash")
        .when(~F.substring(rest, 1, 32).rlike(f"^{BASE32}{{32}}$"), "bad hash")
        .when(name == "", "empty name")
        .when(name.rlike(r"^\.\.?(-|$)"), "bad dot name")
        .when(~name.rlike(r"^[0-9A-Za-z+\-._?=]+$"), "bad char")
        .when(F.length(name) > 211, "too long")
    )
    ok = fault.isNull() & F.col(col).isNotNull()
    return df.withColumns({"hash_part": F.when(ok, F.substring(rest, 1, 32)), "name": F.when(ok, name), "fault": fault})


def by_hash_part(paths: DataFrame, hash_part: str, prefix: str = "/store/") -> DataFrame:
    """Complete paths with this hash part; the prefix test reaches the Parquet scan."""
    return paths.filter(F.col("store_path").startswith(f"{prefix}{hash_part}-") & (F.col("manifest_status") == "complete"))


def lookback(df: DataFrame, col: str, days: int, as_of: str) -> DataFrame:
    """Rows later than ``days`` before ``as_of``."""
    return df.filter(F.col(col) > F.expr(f"timestamp_ntz'{as_of}' - interval {int(days)} days"))


def name_contains(df: DataFrame, part: str | None, col: str = "pname") -> DataFrame:
    return df if part is None else df.filter(F.col(col).contains(part))


def name_ok(col: Column) -> Column:
    """Trimmed, not empty, no white space within."""
    return F.coalesce((col != "") & ~col.rlike(r"\s"), F.lit(False))


def validate_paths(df: DataFrame, max_refs: int = 10_000, max_sigs: int = 100, max_bytes: int = 4 << 30) -> tuple[DataFrame, DataFrame]:
    """(good, bad) by digest length, counts and size; bad rows have all their ``reasons``."""
    tests = {
        "digest": F.length("digest") != 32,
        "references": F.size("references") > max_refs,
        "signatures": F.size("signatures") > max_sigs,
        "size": F.col("nar_size") > max_bytes,
    }
    reasons = F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(True)), name) for name, bad in tests.items()]))
    judged = df.withColumn("reasons", reasons)
    return judged.filter(F.size("reasons") == 0).drop("reasons"), judged.filter(F.size("reasons") > 0)


def admit_samples(df: DataFrame) -> DataFrame:
    """Samples of 0 to 30 days, not of fixed outputs; zero memory and cpu become null."""
    return df.filter((F.col("duration_secs") > 0) & (F.col("duration_secs") < 30 * DAY_SECS) & ~F.col("is_fixed_output")).withColumns(
        {c: F.nullif(F.col(c), F.lit(0.0)) for c in ("peak_memory_bytes", "peak_cpu_cores")}
    )


def route_blob(df: DataFrame, size: str = "nar_size", inline: int = INLINE_BYTES) -> DataFrame:
    return df.withColumn("route", F.when(F.col(size) >= inline, "chunked").otherwise("inline"))


def _first_of(clauses: list[tuple[str, Column]]) -> Column:
    return F.coalesce(*[F.when(bad, name) for name, bad in clauses])


def reason_before_failures(columns: Sequence[str]) -> Column:
    """The first clause ahead of earlier failures that keeps a node off an executor; ``columns`` are those of the pairs."""
    served = F.array_contains("systems", F.col("node_system")) if "systems" in columns else F.col("system") == F.col("node_system")
    return _first_of([
        ("kind", F.col("is_fixed_output") != (F.col("kind") == "fetcher")),
        ("draining", F.col("draining")),
        ("degraded", F.col("degraded")),
        ("unregistered", ~F.col("registered")),
        ("closed", F.col("closed")),
        ("capacity", F.col("busy")),
        ("system", ~served),
        ("feature", F.size(F.array_except("needs", "offers")) > 0),
    ])


def reason_after_failures() -> Column:
    """The first clause behind earlier failures that keeps a node off an executor."""
    return _first_of([
        ("class undeclared", F.col("class_rank").isNotNull() & F.col("executor_rank").isNull()),
        ("class", F.col("executor_rank") != F.col("class_rank")),
        ("memory", (F.col("memory_total") != 0) & (F.col("memory_total") < F.col("memory_needed"))),
    ])


def rejection_reason(pairs: DataFrame) -> DataFrame:
    """Add ``reason``: the first clause that keeps a node off an executor, null if none does.

    ``pairs`` has the node's ``is_fixed_output, node_system, needs (array),
    failed_on (array), class_rank, memory_needed`` and the executor's ``kind,
    draining, degraded, registered, closed, busy, offers (array), executor_id,
    executor_rank, memory_total``, and ``system``, or ``systems`` (array) where
    an executor serves several. A node without a class or without an estimate
    of its memory passes there, and so does an executor of memory 0 or null,
    which is unknown; an executor without a class is undeclared, and another
    class than the node's is none that fits.
    """
    failed = F.when(F.array_contains("failed_on", F.col("executor_id")), "failed-on")
    return pairs.withColumn("reason", F.coalesce(reason_before_failures(pairs.columns), failed, reason_after_failures()))
