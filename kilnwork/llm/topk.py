"""Exact top-k search by inner product: MaxScore within shards, shards merged."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Vectors of a shard, and queries that are sent to a shard together.
SHARD_ROWS, BLOCK_ROWS = 16_384, 512
#: Terms that are probed together.
PROBED = 8
PACKED = "n int, ids binary, cells binary"


def integer_vector(vector: Column, scale: int = 64) -> Column:
    """floor(scale * x) of each component x as double."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale))


def usable(vector: Column) -> Column:
    """Not null, and without null or non-finite components."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf"))
    return vector.isNotNull() & ~F.exists(vector, bad)


class Shard:
    """Rows by term (vector component), with the postings of each term's positive and negative values as bitmaps."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        self.ids = ids
        self.most, self.least = rows.max(axis=0, initial=0), rows.min(axis=0, initial=0)
        self.largest = int(max(self.most.max(initial=0), -self.least.min(initial=0)))
        self.rows = np.ascontiguousarray(rows.T)
        self.above, self.below = self.rows > 0, self.rows < 0
        self.as_kind: dict[str, np.ndarray] = {}

    def terms(self, query: np.ndarray) -> np.ndarray:
        """The values in the narrowest kind of number in which sums of products with ``query`` are exact."""
        bound = int(np.abs(query).sum()) * self.largest
        kind = "f4" if bound < 2**24 else "f8" if bound < 2**53 else "i8"
        if kind not in self.as_kind:
            self.as_kind[kind] = self.rows.astype(kind)
        return self.as_kind[kind]

    def search(self, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of all rows that may be among the k best; ``own`` is not a candidate.

        The k-th exact score of the rows that gain most from the strongest
        terms is the threshold. The weakest terms whose bounds together stay
        below it are non-essential: a row with a gain from no essential term
        can't reach it. The rows in the essential postings are then probed,
        some terms at a time from the largest bound, while what is known plus
        the bounds to come reaches the threshold.
        """
        terms = self.terms(query)
        q = query.astype(terms.dtype)
        bound = np.maximum(query * self.most, query * self.least)  # at least 0, as 0 lies between the two
        order = np.argsort(-bound, kind="stable")
        rows = np.flatnonzero(self.ids != own)
        if len(rows) <= k:
            return self.ids[rows], (q @ terms[:, rows]).astype(np.int64)
        first = order[:PROBED]
        gain = (q[first] @ terms[first])[rows]
        tried = rows[np.argpartition(-gain, min(len(rows) - 1, 4 * k))[: 4 * k]]
        threshold = int(np.partition(q @ terms[:, tried], -k)[-k])
        if threshold > 0:
            left = np.cumsum(bound[order][::-1])[::-1]  # bounds of a term and all weaker ones
            held = np.zeros(len(self.ids), dtype=bool)
            for term in order[left >= threshold]:
                held |= self.above[term] if query[term] > 0 else self.below[term]
                if held.all():
                    break
            rows = rows[held[rows]]
        known, to_come = np.zeros(len(rows), dtype=terms.dtype), int(bound.sum())
        for i in range(0, len(order), PROBED):
            some = order[i : i + PROBED]
            known += q[some] @ (terms[some] if len(rows) == len(self.ids) else terms[some[:, None], rows])
            to_come -= int(bound[some].sum())
            alive = known + to_come >= threshold
            if alive.sum() < 0.8 * len(rows):
                rows, known = rows[alive], known[alive]
        return self.ids[rows], known.astype(np.int64)


def _pack(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("vec_id", kind="stable")
    cells = np.zeros((len(rows), max(map(len, rows["cells"]), default=0)), dtype=np.int64)
    for i, v in enumerate(rows["cells"]):
        cells[i, : len(v)] = v
    return pd.DataFrame({"part": [int(key[0])], "n": [len(rows)], "ids": [rows["vec_id"].to_numpy(dtype=np.int64).tobytes()], "cells": [cells.tobytes()]})


def _unpack(n: int, ids: bytes, cells: bytes, width: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    rows = np.frombuffer(cells, dtype=np.int64).reshape(n, -1)
    if width is not None and rows.shape[1] != width:
        rows = np.pad(rows, ((0, 0), (0, max(0, width - rows.shape[1]))))[:, :width]
    return np.frombuffer(ids, dtype=np.int64), rows


def search_top_k(vectors: DataFrame, queries: Column, k: int = 20, scale: int = 64, shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each query row the k best other rows by integer inner product.

    ``vectors`` has (vec_id, embedding); ``queries`` marks the query rows. Rows
    are dealt to shards of about ``shard_rows`` by a hash, packed as arrays. A
    task holds one shard and streams query blocks, all of them, or a group of
    them where there are fewer shards than would keep the cores busy; so a
    shard is sent once, or as often as there are groups. Each query is searched
    with MaxScore, and the best k of all shards are kept. Ties go to the
    smaller vec_id.

    Vectors that are null or hold a null or non-finite component, and rows of
    a null vec_id, take no part. Shorter vectors count as zero beyond their
    end. Rows that share the query's vec_id are the query's own; other repeated
    rows are separate candidates. Fewer than k candidates are all returned, an
    empty table gives an empty result.
    """
    used = vectors.filter(usable(F.col("embedding")) & F.col("vec_id").isNotNull()).select(
        F.col("vec_id").cast("long").alias("vec_id"), integer_vector(F.col("embedding"), scale).alias("cells"), F.coalesce(queries, F.lit(False)).alias("asks")
    )
    sizes = used.agg(F.count("*").alias("rows"), F.count_if("asks").alias("asking")).first()
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    n_shards, n_blocks = max(1, -(-sizes.rows // shard_rows)), max(1, -(-sizes.asking // block_rows))
    n_groups = min(n_blocks, max(1, -(-2 * cores // n_shards)))
    part = lambda n: F.pmod(F.xxhash64("vec_id", "cells"), F.lit(n)).cast("int").alias("part")
    shape = f"part int, {PACKED}"
    shards = used.select("vec_id", "cells", part(n_shards)).groupBy("part").applyInPandas(_pack, shape)
    blocks = used.filter("asks").select("vec_id", "cells", part(n_blocks)).groupBy("part").applyInPandas(_pack, shape)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    task = lambda shard, group: (shard * n_groups + group).cast("int").alias("task")
    held = shards.select("*", every(n_groups).alias("group")).select(task(F.col("part"), F.col("group")), F.lit(0).alias("kind"), "n", "ids", "cells")
    sent = blocks.select("*", every(n_shards).alias("shard")).select(task(F.col("shard"), F.col("part") % n_groups), F.lit(1).alias("kind"), "n", "ids", "cells")
    dealt = held.union(sent).repartitionById(n_shards * n_groups, F.col("task")).sortWithinPartitions("task", "kind")

    def search(batches):
        shard = None
        for batch in batches:
            for i in range(batch.num_rows):
                kind, n, ids, cells = (batch.column(c)[i].as_py() for c in ("kind", "n", "ids", "cells"))
                if kind == 0:
                    shard = Shard(*_unpack(n, ids, cells))
                    continue
                q_ids, q_rows = _unpack(n, ids, cells, len(shard.rows))
                out = [[], [], []]
                for q, v in zip(q_ids.tolist(), q_rows, strict=True):
                    found, scores = shard.search(v, q, k)
                    best = np.lexsort((found, -scores))[:k]
                    out[0].append(np.full(len(best), q)), out[1].append(found[best]), out[2].append(scores[best])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], ["query_id", "vec_id", "score"])

    found = dealt.mapInArrow(search, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
