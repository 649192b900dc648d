"""Text manifests of ``Key: value`` lines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ONCE = ("StorePath", "URL", "Compression", "NarHash", "NarSize", "References", "Deriver")
REQUIRED = ("StorePath", "URL", "NarHash", "NarSize")


def ingest_kv_text(df: DataFrame, text_col: str, required: Sequence[str] = REQUIRED, once: Sequence[str] = ONCE) -> tuple[DataFrame, DataFrame]:
    """(good, bad) rows: one column a known key, ``Sig`` as an array, ``References`` split on white space.

    Unknown keys are ignored. A row that repeats a known key, or lacks a
    required one, is bad and has the first such key in ``fault``; a line
    without ': ' is ignored like an unknown key.
    """
    pairs = F.transform(
        F.filter(F.split(text_col, "\n"), lambda x: F.contains(x, F.lit(": "))),
        lambda x: F.struct(F.substring_index(x, ": ", 1).alias("k"), F.substr(x, F.locate(": ", x) + 2).alias("v")),
    )
    at = df.withColumn("__kv", pairs)
    values = lambda key: F.transform(F.filter("__kv", lambda p: p["k"] == key), lambda p: p["v"])
    faults = [F.when(F.size(values(k)) > 1, F.concat(F.lit("repeated "), F.lit(k))) for k in once]
    faults += [F.when(F.size(values(k)) == 0, F.concat(F.lit("missing "), F.lit(k))) for k in required]
    keyed = at.select(
        *df.columns,
        *[F.get(values(k), F.lit(0)).alias(k) for k in once if k != "References"],
        F.filter(F.split(F.coalesce(F.get(values("References"), F.lit(0)), F.lit("")), r"\s+"), lambda x: x != "").alias("References"),
        values("Sig").alias("Sig"),
        F.coalesce(*faults).alias("fault"),
    )
    return keyed.filter("fault is null").drop("fault"), keyed.filter("fault is not null").select(*df.columns, "fault")
