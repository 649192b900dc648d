"""Export of a closure with dense ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kilnwork.plans.running import running_totals


def export_closure(paths: DataFrame, refs: DataFrame, outputs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(paths with ``id``, refs of ids, outputs): ids run from 1 in the order of path_id.

    References stay where both ends are inside, outputs where their producer
    is and their path is not null.
    """
    ids = running_totals(paths.select("path_id").distinct(), [F.col("path_id")], {"id": F.lit(1)}).select("path_id", "id")
    numbered = paths.join(ids, "path_id")
    a = ids.select(F.col("path_id"), F.col("id").alias("referrer"))
    b = ids.select(F.col("path_id").alias("ref_id"), F.col("id").alias("reference"))
    inside = refs.join(a, "path_id").join(b, "ref_id").select("referrer", "reference").distinct()
    kept = outputs.filter("path_id is not null").join(ids.select(F.col("path_id").alias("node_id"), F.col("id").alias("producer")), "node_id").dropDuplicates(["node_id", "output_name"])
    return numbered, inside, kept.select("producer", "output_name", "path_id")
