"""Views that Spark builds by tasks of bounded size, with the rows of their SQL in ``views.py``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kilnwork.plans.stored import TASK_ROWS, in_tasks, tasks_for


def edges(lineitem: DataFrame) -> DataFrame:
    """``parent_id, child_id``: pairs of nodes of one build, from a higher layer to a lower one, each once.

    Pairs are many times the rows of a build and hardly repeat, so they are
    not combined before the shuffle but dealt to tasks by their number, which
    follows from the sizes of builds.
    """
    rows = in_tasks(lineitem.select("l_orderkey", F.col("l_partkey").alias("parent_id")), "l_orderkey")
    sizes = rows.groupBy("l_orderkey").agg(F.count("*").alias("n"))
    number = sizes.agg(F.sum(F.expr("n * (n - 1) div 2"))).first()[0] or 0
    pairs = rows.join(rows.withColumnRenamed("parent_id", "child_id"), "l_orderkey").filter("parent_id % 8 > child_id % 8")
    return pairs.select("parent_id", "child_id").repartition(number // TASK_ROWS + 1, "parent_id", "child_id").distinct()


def realisations(lineitem: DataFrame) -> DataFrame:
    """``key_id, output_name, path_id, created_at``: the least path and time of each output."""
    rows = lineitem.select(F.col("l_orderkey").alias("key_id"), F.concat(F.lit("out"), F.col("l_linenumber").cast("string")).alias("output_name"), "l_partkey", "l_shipdate")
    return in_tasks(rows, "key_id", "output_name").groupBy("key_id", "output_name").agg(F.min("l_partkey").alias("path_id"), F.min("l_shipdate").alias("created_at"))


def chunk_entries(orders: DataFrame, lineitem: DataFrame) -> DataFrame:
    """``blob_id, idx, chunk_id, size``: the lines of known orders; a task hashes its orders and streams their lines."""
    tasks = tasks_for(lineitem)
    blobs = orders.select(F.col("o_orderkey").alias("blob_id")).repartition(tasks, "blob_id")
    size = (F.col("l_quantity").cast("long") * 100).alias("size")
    lines = lineitem.select(F.col("l_orderkey").alias("blob_id"), F.col("l_linenumber").alias("idx"), F.col("l_partkey").alias("chunk_id"), size).repartition(tasks, "blob_id")
    return lines.join(blobs.hint("shuffle_hash"), "blob_id")


BUILT = {"fx_edges": lambda t: edges(t.lineitem), "fx_chunk_entries": lambda t: chunk_entries(t.orders, t.lineitem), "fx_realisations": lambda t: realisations(t.lineitem)}
