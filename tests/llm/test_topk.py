import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kilnwork.llm import topk

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows, every, k):
    used = [(i, [math.floor(64 * float(np.float32(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for q, v in used:
        if q % every == 0:
            scores = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in used if i != q)
            out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:k])}
    return out


def search(spark, rows, every, k, **options):
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA).withColumn("score", F.lit("clash")).withColumn("part", F.lit(1))
    return {tuple(r) for r in topk.search_top_k(df, F.col("vec_id") % every == 0, k, **options).collect()}


@pytest.mark.parametrize("kind", ["dense", "sparse", "negative", "ties"])
def test_matches_brute_force(spark, kind):
    r = random.Random(kind)
    make = {
        "dense": lambda: [r.gauss(0, 1) for _ in range(12)],
        "sparse": lambda: [r.gauss(0, 2) if r.random() < 0.2 else 0.0 for _ in range(12)],
        "negative": lambda: [-abs(r.gauss(0, 1)) for _ in range(12)],
        "ties": lambda: [r.choice([0.0, 0.5]) for _ in range(4)],
    }[kind]
    rows = [(i, make()) for i in range(300)]
    assert search(spark, rows, 20, 7, shard_rows=64, block_rows=4) == plain(rows, 20, 7)


def test_odd_rows(spark):
    bad = [(20, None), (21, [1.0, None]), (22, [float("nan"), 1.0]), (23, [float("inf"), 1.0]), (None, [1.0, 1.0])]
    rows = [(0, [1.0, 2.0]), (1, [3.0, 1.0]), (2, [3.0, 1.0]), (40, [-1.0, 0.0]), *bad]
    assert search(spark, rows, 20, 20) == plain(rows, 20, 20)
    assert search(spark, rows[:1], 20, 20) == set()
    assert search(spark, [], 20, 20) == set()


def test_maxscore_prunes():
    r = np.random.default_rng(1)
    rows = np.where(r.random((4000, 24)) < 0.15, r.integers(0, 90, (4000, 24)), 0)
    shard = topk.Shard(np.arange(4000), rows)
    query = np.zeros(24, dtype=np.int64)
    query[:3] = 1
    query[3] = 60
    ids, scores = shard.search(query, -1, 10)
    assert len(ids) < 1000
    want = np.lexsort((np.arange(4000), -(rows @ query)))[:10]
    best = np.lexsort((ids, -scores))[:10]
    assert ids[best].tolist() == want.tolist()
