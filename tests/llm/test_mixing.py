import pytest
from plain import documents, mix, words
from pyspark.sql import functions as F

from kilnwork.llm import mixing


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def rows():
    out = [(i, "w " * (i % 17), "en", f"s{min(i % 5, 2)}") for i in range(120)]
    return out + [(900, None, "en", "s0"), (901, "", "en", None), (902, "a b", "en", None), (903, "x " * 3000, "en", "big")]


def test_plan_matches_plain(spark, rows):
    plan = mixing.mix_plan(documents(spark, rows))
    want = sorted(mix([(d, t, s) for d, t, _, s in rows]), key=str)
    assert rows_of(plan.select("doc_id", "source", "size", "target", "copies")) == want


def test_targets_are_met_and_limited(spark, rows):
    got = mixing.mix_plan(documents(spark, rows)).collect()
    assert all(r.taken <= 3 * r.size for r in got)
    total = sum(r.size for r in got)
    target = {r.source: r.target for r in got}
    assert sum(target.values()) == pytest.approx(total)
    for source, want in target.items():
        own = [r for r in got if r.source == source]
        assert abs(sum(r.taken for r in own) - want) <= 2 * max(r.size for r in own)


def test_mixed_rows_follow_the_plan(spark, rows):
    docs = documents(spark, rows).withColumnRenamed("n_chars", "copies")  # a clashing name
    copies = {r.doc_id: r.copies for r in mixing.mix_plan(docs).collect()}
    mixed = mixing.mix_sources(docs)
    assert mixed.columns == docs.columns
    got = [r.doc_id for r in mixed.collect()]
    assert {d: got.count(d) for d in copies} == copies


def test_repeated_rows_are_taken_alike(spark):
    docs = documents(spark, [(1, "a b c", "en", "x")] * 3 + [(2, "d e", "en", "x"), (3, "f", "en", "y")])
    taken = [r.copies for r in mixing.mix_plan(docs).collect() if r.doc_id == 1]
    assert len(taken) == 3 and len(set(taken)) == 1
    assert mixing.mix_sources(docs).filter("doc_id = 1").count() == 3 * taken[0]


def test_a_very_large_group_of_repeated_rows(spark):
    """Three million rows of null ids and texts in one source, and what they share evenly."""
    docs = spark.range(3_000_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("a b").alias("text"), F.lit("x").alias("source"))
    other = spark.createDataFrame([(1, "c " * 9_000_000, "y")], "doc_id long, text string, source string")
    plan = mixing.mix_plan(docs.union(other)).groupBy("source").agg(F.count("*").alias("n"), F.sum("taken").alias("taken"), F.min("copies").alias("least"), F.max("copies").alias("most"), F.first("target").alias("target"))
    got = {r.source: r for r in plan.collect()}
    assert got["x"].n == 3_000_000 and got["x"].most - got["x"].least <= 1 and abs(got["x"].taken - got["x"].target) <= 2


def test_null_ids_and_empty_tables(spark):
    docs = documents(spark, [(None, "a b", "en", "x"), (None, None, None, None), (1, "c", "en", "x")])
    assert mixing.mix_plan(docs).count() == 3
    empty = documents(spark, [(1, "a", "en", "x")]).limit(0)
    assert mixing.mix_plan(empty).count() == 0 and mixing.mix_sources(empty).count() == 0
    blank = documents(spark, [(1, "", "en", "x"), (2, None, "en", "y")])
    assert {(r.target, r.copies) for r in mixing.mix_plan(blank).collect()} == {(0.0, 0)}


def test_words():
    assert words("a\tb c\nd") == ["a", "b c", "d"]
