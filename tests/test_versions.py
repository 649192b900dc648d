"""Versions of a table under writers that compete, fail and come again."""

from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from kilnwork.operators import snapshots as m
from kilnwork.sources.versions import MAX_FOLDERS, Conflict, Snapshots, day_of

SCHEMA = "id long, day string, v long"


def rows(spark, found):
    return spark.createDataFrame(found, SCHEMA)


def held(table, at=None):
    return sorted((tuple(r) for r in table.read(at).collect()), key=str)


@pytest.fixture
def table(spark, tmp_path):
    return Snapshots(spark, str(tmp_path / "a table"), rows(spark, [(1, "d", 1)]).schema, F.col("day"))


def merged(old, new):
    return m.upsert(old, new, ["id", "day"], {"v": lambda o, n: o + n})


def test_versions_stay_as_they_were(spark, table):
    assert held(table) == [] and table.latest().number == 0
    first = table.upsert(rows(spark, [(1, "a", 1), (2, "b", 2), (3, None, 3), (4, "x=y/z", 4)]), merged)
    second = table.upsert(rows(spark, [(2, "b", 5), (9, "c", 9)]), merged)
    assert (first.number, second.number) == (1, 2)
    assert held(table, first) == [(1, "a", 1), (2, "b", 2), (3, None, 3), (4, "x=y/z", 4)]
    assert held(table) == [(1, "a", 1), (2, "b", 7), (3, None, 3), (4, "x=y/z", 4), (9, "c", 9)]
    assert {p for p in second.parts if second.parts[p] != first.parts.get(p)} == {"b", "c"}
    assert [tuple(r) for r in table.read(parts=["c", "none"]).collect()] == [(9, "c", 9)]


def test_competing_writers_lose_nothing(spark, table):
    table.upsert(rows(spark, [(i, "a", 0) for i in range(5)]), merged)
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda w: table.upsert(rows(spark, [(i, "a", 10**w) for i in range(5)] + [(100 + w, f"own{w}", w)]), merged), range(4)))
    assert held(table) == sorted([(i, "a", 1111) for i in range(5)] + [(100 + w, f"own{w}", w) for w in range(4)], key=str)
    assert table.latest().number == 5


def test_a_loser_keeps_what_the_winner_left_alone(spark, table):
    table.upsert(rows(spark, [(1, "a", 1), (2, "b", 2)]), merged)
    calls = []

    def slow(old):
        calls.append(1)
        if len(calls) == 1:
            table.upsert(rows(spark, [(3, "c", 3)]), merged)  # takes the next number, in another part
        return old.withColumn("v", F.col("v") * 10)

    table.change(["a"], slow)
    assert len(calls) == 1 and held(table) == [(1, "a", 10), (2, "b", 2), (3, "c", 3)]
    with pytest.raises(Conflict):
        table.change(["a"], lambda old: table.change(["a"], lambda o: o) and old, retries=0)
    with pytest.raises(ValueError, match="other parts"):
        table.change(["a"], lambda old: old.withColumn("day", F.lit("b")))


def test_expiry_reads_one_part(spark, table):
    first = table.upsert(rows(spark, [(i, f"2024-01-0{i}", i) for i in range(1, 6)] + [(9, None, 9), (10, "2024-01-03", 10)]), merged)
    after = table.expire("2024-01-03", F.col("v") > 5)
    assert held(table) == [(10, "2024-01-03", 10), (4, "2024-01-04", 4), (5, "2024-01-05", 5), (9, None, 9)]
    assert {p for p in after.parts if after.parts[p] != first.parts[p]} == {"2024-01-03"}


def test_a_batch_counts_once(spark, tmp_path):
    schema = "k long, n long, ts timestamp"
    batch = lambda *found: spark.createDataFrame(found, "k long, n long, s long").select("k", "n", F.timestamp_seconds("s").alias("ts"))
    table = Snapshots(spark, str(tmp_path / "log"), batch((1, 1, 1)).schema, day_of("ts"))
    assert table.schema.simpleString() == f"struct<{schema.replace(', ', ',').replace(' ', ':').replace('long', 'bigint')}>"
    first = batch((1, 1, 10), (None, 1, 10), (None, 1, 10), (None, None, None), (1, 2, 90_000))
    for _ in range(2):
        table.append_batch(first, ["k", "n"], "s", 0)
    table.append_batch(first, ["k", "n"], "s", 1)
    table.append_batch(first, ["k", "n"], "other", 0)
    assert table.read().count() == 4 and table.latest().batches == {"s": 1, "other": 0}
    before = table.latest()

    def killed(*_):
        raise KeyboardInterrupt

    commit, table._commit = table._commit, killed
    with pytest.raises(KeyboardInterrupt):
        table.append_batch(batch((7, 7, 20)), ["k", "n"], "s", 2)
    table._commit = commit
    assert table.read().count() == 4 and table.latest() == before
    table.append_batch(batch((7, 7, 20)), ["k", "n"], "s", 2)
    assert table.read().count() == 5 and table.vacuum(keep=1) > 0 and table.read().count() == 5


def test_a_part_has_few_folders(spark, table):
    for i in range(MAX_FOLDERS + 3):
        table.append_batch(rows(spark, [(i, "a", i)]), ["id"], "s", i)
    assert len(table.latest().parts["a"]) <= MAX_FOLDERS and table.read().count() == MAX_FOLDERS + 3
