"""Connected components of an edge list, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kilnwork.plans.stored import stored


#: Edges beyond which the least neighbours are stored before they are joined.
MANY_EDGES = 100_000


def _least(edges: DataFrame, many: bool) -> DataFrame:
    """``c, m``: the least neighbour ``m`` of each ``c`` on the left end.

    Where edges are many the table is stored: a join with it then has shuffles
    alone below it, so Spark can split the edges of a centre that has very many.
    """
    least = edges.groupBy(F.col("u").alias("c")).agg(F.min("v").alias("m"))
    return stored(least) if many else least


def _large_star(edges: DataFrame, many: bool = False) -> DataFrame:
    both = edges.union(edges.select("v", "u"))
    least = _least(both, many).select("c", F.least("c", "m").alias("m"))
    moved = both.filter("v > u").join(least, F.col("u") == F.col("c"))
    return moved.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def _small_star(edges: DataFrame, many: bool = False) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = _least(down, many)
    moved = down.join(least, F.col("u") == F.col("c")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select(F.col("c").alias("u"), F.col("m").alias("v"))).filter("u <> v").distinct()


def connected_components(edges: DataFrame, src: str, dst: str, max_rounds: int = 64) -> DataFrame:
    """``(node, label)`` for every node on an edge; the label is the least node reachable.

    Each round hangs every neighbour of a node on the node's least neighbour
    (large star, then small star), which ends in stars after a number of rounds
    that is logarithmic in practice. Rounds are stored in the shared folder and
    the driver sees a count and a checksum a round. Loops and repeated edges
    are allowed, edges with a null end are left out. Raises RuntimeError after
    ``max_rounds``.
    """
    ends = edges.select(F.col(src).alias("u"), F.col(dst).alias("v"))
    now = stored(ends.filter("u is not null and v is not null and u <> v").distinct())
    state, many = None, now.count() > MANY_EDGES
    for _ in range(max_rounds):
        now = stored(_small_star(stored(_large_star(now, many)) if many else _large_star(now), many))
        seen = now.agg(
            F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")
        ).first()
        if (seen.n, seen.h) == state:
            roots = now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
            return now.select(F.col("u").alias("node"), F.col("v").alias("label")).union(roots)
        state = (seen.n, seen.h)
    raise RuntimeError(f"components not found within {max_rounds} rounds")
