"""Folds and bounded samples of labelled rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kilnwork.plans.stored import stored


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; null for a null id."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(parts))


def held_out(doc_id: Column, parts: int, part: int) -> Column:
    return F.coalesce(fold(doc_id, parts) == part, F.lit(False))


def bounded_sample(rows: DataFrame, label: str, key: Sequence[str], bound: int) -> DataFrame:
    """About ``bound`` rows at most, the labels evenly, by a hash of the columns ``key``.

    Every label has the same quota, and labels below it are taken whole. Of
    rows that agree in label and ``key`` one is taken, so repeats can't exceed
    the bound. Labels may be any number: their counts stay in a table, and with
    more labels than ``bound`` a label has one row or none. Rows with a null
    label or a null in ``key`` are left out.
    """
    rows = rows.filter(F.col(label).isNotNull())
    for k in key:
        rows = rows.filter(F.col(k).isNotNull())
    counts = stored(rows.groupBy(F.col(label).alias("__label")).agg(F.count("*").alias("__rows")))
    quota = bound / max(1, counts.count())
    share = F.least(F.lit(1.0), F.lit(quota) / F.col("__rows")) * 2**30
    drawn = F.pmod(F.xxhash64(F.lit("sample"), *key), F.lit(2**30))
    joined = rows.join(counts, F.col(label) == F.col("__label")).filter(drawn < share.cast("long"))
    return joined.select(*rows.columns).dropDuplicates([label, *key])
