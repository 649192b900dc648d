"""Running totals and values carried forward, without a single-task window over a table or over a hot key."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kilnwork.plans.stored import stored

PART = "__part"


def ranges(df: DataFrame, order: Sequence[Column | str]) -> DataFrame:
    """``df`` range-partitioned by ``order`` and stored, with the number of each row's range in ``PART``; a table that has one already is left as it is."""
    if PART in df.columns:
        return df
    return stored(df.repartitionByRange(*order).withColumn(PART, F.spark_partition_id()))


def running_totals(df: DataFrame, order: Sequence[Column], totals: Mapping[str, Column], keys: Sequence[str] = ()) -> DataFrame:
    """Add inclusive running sums over the whole table, or over each key, in ``order``.

    The table is range-partitioned by keys and ``order`` and stored with the
    number of each row's range. Sums run within a range, and what the ranges
    before it hold is added from a table that has a row for each range at most
    (of keys, only the one that a range begins in the midst of), so it is
    broadcast. Rows that tie in ``order`` lie in one range, and get their
    numbers in any order. Null keys are one key. An empty table gives an empty
    result.
    """
    ranged = ranges(df, [*keys, *order])
    parts = ranged.groupBy(PART, *keys).agg(*[F.sum(v).alias(name) for name, v in totals.items()])
    before = (Window.partitionBy(*keys).orderBy(PART) if keys else Window.orderBy(PART)).rowsBetween(Window.unboundedPreceding, -1)
    sums = {f"__before_{name}": F.sum(name).over(before) for name in totals}
    seen = F.count(F.lit(1)).over(before)
    offsets = parts.select(F.col(PART).alias("__at"), *_aliased(keys), seen.alias("__seen"), *[v.alias(n) for n, v in sums.items()]).filter("__seen > 0").drop("__seen")
    within = Window.partitionBy(PART, *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = ranged.select("*", *[F.sum(v).over(within).alias(name) for name, v in totals.items()])
    joined = local.join(F.broadcast(offsets), _same_range(keys), "left")
    return joined.select(
        *df.columns, *[(F.col(name) + F.coalesce(F.col(f"__before_{name}"), F.lit(0))).alias(name) for name in totals]
    )


def _aliased(keys: Sequence[str]) -> list[Column]:
    return [F.col(k).alias(f"__key{i}") for i, k in enumerate(keys)]


def _same_range(keys: Sequence[str]) -> Column:
    on = F.col(PART) == F.col("__at")
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"__key{i}"))
    return on


def carry_forward(df: DataFrame, keys: Sequence[str], order: Sequence[str], source: str, target: str, part: Column | None = None, own: bool = True) -> DataFrame:
    """Add ``target``: the last ``source`` of the row's key, up to the row in ``order``, that is not null.

    Without ``own`` the row's own ``source`` does not count, only those before it.

    A key may span many ranges, each of which is filled by itself. What a range
    gets from the key's ranges before it comes from a table with a row for each
    range that does not begin with the key, so it has fewer rows than there are
    partitions and is broadcast. Null keys are one key.

    ``part``, such as the day of the first column of ``order``, cuts the rows
    into ranges that rise with ``order``, so that nothing is sampled or stored.
    The table then has a row for each key and part, and is joined as its size
    demands.
    """
    ranged = ranges(df, [*keys, *order]) if part is None else df.withColumn(PART, part)
    known = F.col(source).isNotNull()
    last = F.max_by(F.when(known, F.col(source)), F.when(known, F.struct(*order)))
    parts = ranged.groupBy(PART, *keys).agg(last.alias("__last"))
    before = Window.partitionBy(*keys).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    carried = parts.select(
        F.col(PART).alias("__at"), *_aliased(keys), F.last("__last", ignorenulls=True).over(before).alias("__carried")
    ).filter("__carried is not null")
    within = Window.partitionBy(PART, *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if own else -1)
    local = ranged.withColumn(target, F.last(source, ignorenulls=True).over(within))
    filled = local.join(F.broadcast(carried) if part is None else carried, _same_range(keys), "left").withColumn(target, F.coalesce(target, "__carried"))
    return filled.select(*[c for c in df.columns if c != target], target)


def row_before(df: DataFrame, keys: Sequence[str], order: Sequence[str], source: Column, target: str, part: Column | None = None) -> DataFrame:
    """Add ``target``: a struct with ``source``, null or not, as ``value`` of the row before in ``order``; null for a key's first row."""
    held = df.withColumn("__held", F.struct(source.alias("value")))
    return carry_forward(held, keys, order, "__held", target, part, own=False).drop("__held")
