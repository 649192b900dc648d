"""Invariants of chunking, manifests, sinks and sources."""

import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kilnwork.operators import storage as s
from kilnwork.plans import membership as m
from kilnwork.sources import chunks, logs, manifests


def pieces(data, sizes=(64, 256, 1024)):
    ends = s.cut_points(data, *sizes)
    return [data[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)] if ends else []


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 2**32), st.integers(0, 9000))
def test_chunks_hold_their_bounds(seed, n):
    data = random.Random(seed).randbytes(n)
    got = pieces(data)
    assert b"".join(got) == data
    assert all(64 <= len(p) <= 1024 for p in got[:-1]) and (not got or 0 < len(got[-1]) <= 1024)


def test_chunks_survive_an_insertion():
    data = random.Random(1).randbytes(200_000)
    moved = data[:500] + b"inserted" + data[500:]
    a, b = set(pieces(data)), set(pieces(moved))
    assert len(a & b) > 0.9 * len(a)
    sizes = [len(p) for p in pieces(data)]
    assert 150 < sum(sizes) / len(sizes) < 450
    assert pieces(b"\0" * 5000) and b"".join(pieces(b"\0" * 5000)) == b"\0" * 5000


def test_chunk_operator(spark):
    rows = [(1, random.Random(2).randbytes(5000)), (2, None), (3, b""), (4, b"tiny")]
    got = s.chunk(spark.createDataFrame(rows, "k long, data binary"), "k", "data", 64, 256, 1024).orderBy("id", "idx").collect()
    for k, data in rows:
        own = [r for r in got if r.id == k]
        assert b"".join(r.bytes for r in own) == (data or b"") and [r.idx for r in own] == list(range(len(own)))
        assert all(r.size == len(r.bytes) for r in own)
    with pytest.raises(ValueError):
        s.chunk(spark.createDataFrame(rows, "k long, data binary"), "k", "data", 10, 5, 20)


def test_manifest_faults(spark):
    entry = bytes(range(32)) + (70000).to_bytes(4, "little")
    rows = [(1, b"\x01" + entry * 2), (2, b"\x02" + entry), (3, b"\x01" + entry[:-1]), (4, b""), (5, None), (6, b"\x01"), (7, b"\x01" + entry * 3)]
    good, bad = manifests.decode_manifest(spark.createDataFrame(rows, "k long, m binary"), "k", "m", max_entries=2)
    assert [(r.k, r.idx, bytes(r.chunk_hash), r["size"]) for r in good.orderBy("k", "idx").collect()] == [(1, i, bytes(range(32)), 70000) for i in (0, 1)]
    assert {r.k: r.fault for r in bad.collect()} == {2: "version", 3: "length", 4: "empty", 5: "null", 7: "too many"}


def test_chunk_store_is_write_once(spark, tmp_path):
    path = str(tmp_path / "store")
    rows = [(hashlib.sha256(bytes([i % 5])).hexdigest(), bytes([i % 5])) for i in range(12)]
    df = spark.createDataFrame(rows, "chunk_hash string, bytes binary")
    chunks.write_chunks(df, path)
    chunks.write_chunks(df, path, chunks.read_chunks(spark, path))
    store = chunks.read_chunks(spark, path)
    assert store.count() == 5 and s.verify_bytes(store).count() == 0
    asked = spark.createDataFrame([(rows[0][0],), (rows[0][0],), ("none",)], "chunk_hash string")
    assert sorted(r.present for r in chunks.exists_batch(asked, store).collect()) == [False, True, True]


def test_chunk_store_with_filters(spark, tmp_path):
    path, beside = str(tmp_path / "store"), str(tmp_path / "filters")
    rows = [(hashlib.sha256(bytes([i % 50])).hexdigest(), bytes([i % 50])) for i in range(90)] + [(None, b"x"), (None, b"x")]
    df = spark.createDataFrame(rows, "chunk_hash string, bytes binary")
    chunks.write_chunks(df.limit(20), path, filter_path=beside, blocks=4)
    for _ in range(2):
        chunks.write_chunks(df, path, chunks.read_chunks(spark, path), filter_path=beside, blocks=4)
    store, held = chunks.read_chunks(spark, path), chunks.read_filters(spark, beside, 4)
    assert store.count() == 50 and store.select("chunk_hash").distinct().count() == 50
    asked = spark.createDataFrame([(r[0],) for r in rows[:60]] + [(None,)] + [(hashlib.md5(bytes([i])).hexdigest(),) for i in range(40)], "chunk_hash string")
    got = [r.present for r in chunks.exists_batch(asked, store, filters=held, blocks=4).collect()]
    assert sorted(got) == [False] * 41 + [True] * 60
    assert chunks.exists_batch(asked, store.limit(0), filters=held.limit(0), blocks=4).filter("present").count() == 0


@pytest.mark.parametrize("keys, blocks", [(0, 1), (1, 1), (33, 2), (20_000, 1024)])
def test_filters_lose_no_key_and_pass_few_others(spark, keys, blocks):
    assert m.blocks_for(keys) == blocks
    held = spark.range(keys).select(F.sha2(F.col("id").cast("string"), 256).alias("k"), F.crc32(F.col("id").cast("string")).alias("day"))
    parts = [m.build_filter(held.filter(f"day % 3 = {i}"), "k", blocks) for i in range(3)]
    rows = parts[0].unionAll(parts[1]).unionAll(parts[2])
    whole = m.merge_filters(rows)
    key = lambda df: sorted(tuple(r) for r in df.collect())
    assert key(whole) == key(m.build_filter(held, "k", blocks).unionAll(parts[0]).groupBy("block").agg(*[F.bit_or(w).alias(w) for w in m.WORDS]))
    assert m.possible(held, "k", whole, blocks).count() == keys
    strange = spark.range(40_000).select(F.md5(F.col("id").cast("string")).alias("k"))
    passed = m.possible(strange.unionAll(spark.createDataFrame([(None,)], "k string")), "k", whole, blocks).count()
    rate = m.fill(whole, blocks).first().rate or 0.0
    assert rate < 0.02 and abs(passed / 40_000 - rate) < 0.004


def test_a_large_filter_is_not_broadcast(spark):
    keys = spark.range(100).select(F.md5(F.col("id").cast("string")).alias("k"))
    blocks = m.blocks_for(10**9)
    assert not m.fits_broadcast(blocks)
    assert m.possible(keys, "k", m.build_filter(keys, "k", blocks), blocks).count() == 100


def test_log_archive(spark, tmp_path):
    lines = spark.createDataFrame([(k, i, f"line\t{i}") for k in (1, 2) for i in range(600)], "log_id long, line_no long, line string")
    path = str(tmp_path / "logs")
    logs.archive_logs(lines, path)
    got = logs.read_logs(spark, path, since=10).filter("log_id = 2").orderBy("group_no").collect()
    assert [(r.first_line, r.n_lines, r.complete) for r in got] == [(10, 256, False), (266, 256, False), (522, 78, True)]
    assert got[0].body.split("\n")[0] == "line\t10"
    assert [r.log_id for r in logs.read_logs(spark, path, since=500, logs=[1]).collect()] == [1]


def test_many_logs_in_few_files(spark, tmp_path):
    """A file for each partition at most, the index without the text, odd lines kept."""
    lines = spark.range(100_000).select("id", F.explode(F.array(F.lit(0), F.lit(1), F.lit(700))).alias("line_no")).select(
        F.col("id").alias("log_id"), "line_no", F.when(F.col("line_no") == 1, None).otherwise(F.concat(F.lit("tab\t\r é"), "id")).alias("line")
    )
    path = str(tmp_path / "logs")
    logs.archive_logs(lines, path)
    assert len(list((tmp_path / "logs").glob("*.parquet"))) <= 8
    index = spark.read.parquet(path).drop("member")
    assert index.count() == 200_000 and index.agg(F.sum("n_lines").alias("n")).first().n == 300_000
    got = {(r.first_line, r.body) for r in logs.read_logs(spark, path, logs=[77]).collect()}
    assert got == {(0, "tab\t\r é77\n"), (700, "tab\t\r é77")}


def test_reassembly_faults(spark):
    cut = s.chunk(spark.createDataFrame([(i, bytes([i]) * 500) for i in range(4)], "k long, d binary"), "k", "d", 64, 128, 256).withColumn("chunk_hash", s.chunk_hash(F.col("bytes")))
    stored = cut.filter("id <> 1").select("chunk_hash", "bytes").dropDuplicates(["chunk_hash"])
    declared = spark.createDataFrame([(i, 500 if i != 2 else 501, hashlib.md5(bytes([i]) * 500).hexdigest() if i != 3 else "x") for i in range(4)], "blob_id long, declared_size long, declared_hash string")
    got = {r.blob_id: r.fault for r in s.reassemble(cut.select(F.col("id").alias("blob_id"), "idx", "chunk_hash"), stored, declared).collect()}
    assert got == {0: None, 1: "missing chunk", 2: "size", 3: "hash"}


def test_shared_chunks_without_pairs(spark):
    held = {1: {1, 2, 3}, 2: {2, 3, 9}, 3: {1, 2, 3}, **{b: {9, b} for b in range(10, 40)}, 50: {77}}
    entries = spark.createDataFrame([(b, c) for b, chunks in held.items() for c in chunks] * 2, "blob_id long, chunk_id long")
    classes, members, links = s.shared_chunks(entries)
    of = {r.blob_id: r.class_id for r in classes.collect()}
    assert of == {b: 1 if b == 3 else b for b in held}
    assert {(r.chunk_id, r.class_id) for r in members.collect()} == {(2, 1), (3, 1), (2, 2), (3, 2), (9, 2), *((9, b) for b in range(10, 40))}
    assert {(r.class_id, r.head, r.shared) for r in links.collect()} == {(2, 1, 2), *((b, 2, 1) for b in range(10, 40))}
    asked = [(a, b) for a in held for b in held if of[a] < of[b]]
    counts = s.shared_counts(members, spark.createDataFrame(asked, "a long, b long").distinct())
    assert all(r.shared == len(held[r.a] & held[r.b]) for r in counts.collect() if of[r.a] == r.a)


def test_no_pair_of_a_frequent_chunk_is_lost(spark, monkeypatch):
    """Every two classes that share a chunk are a pair, also beside its least class, with all chunks they share."""
    monkeypatch.setattr(s, "BLOCK", 8)
    held = {1: {1, 2, 3}, 2: {2, 3, 9}, 3: {1, 2, 3}, **{b: {9, b, b // 2 + 100} for b in range(10, 60)}, 70: {77}}
    entries = spark.createDataFrame([(b, c) for b, chunks in held.items() for c in chunks] * 2, "blob_id long, chunk_id long")
    classes, pairs = s.shared_pairs(entries)
    assert {r.blob_id: r.class_id for r in classes.collect()} == {b: 1 if b == 3 else b for b in held}
    want = {(a, b): len(held[a] & held[b]) for a in held for b in held if a < b and 3 not in (a, b) and held[a] & held[b]}
    assert sorted((r.a, r.b, r.shared) for r in pairs.collect()) == sorted((*k, n) for k, n in want.items())
    assert len(want) > 50 * 49 // 2


def test_distinct_entries_are_dealt_by_their_number(spark, monkeypatch):
    """The rows that a task holds don't follow the size of splits; the greatest size of a repeated entry counts."""
    from kilnwork.plans import stored

    monkeypatch.setattr(stored, "TASK_ROWS", 50)
    entries = spark.createDataFrame([(b, c, 10 + c + k) for b in range(40) for c in range(b % 7) for k in range(2)], "blob_id long, chunk_id long, size long").coalesce(1)
    assert s.references(entries).rdd.getNumPartitions() == entries.count() // 50 + 1 > 4
    got = {r.chunk_id: (r.blobs, r.saved_bytes) for r in s.dedup_report(entries).collect()}
    holders = {c: sum(1 for b in range(40) if c < b % 7) for c in range(6)}
    assert got == {c: (n, (n - 1) * (11 + c)) for c, n in holders.items()}
    none = spark.createDataFrame([], "chunk_id long, size long, refcount long, deleted boolean, uploaded boolean")
    assert {r.chunk_id: (r.refcount, r.size) for r in s.apply_manifests(none, entries).collect()} == {c: (n, 11 + c) for c, n in holders.items()}
    assert {r.chunk_id: r.counted for r in s.audit_refcounts(none, entries).collect()} == holders


def test_entries_of_manifests_are_dealt_by_their_number(spark, inputs, monkeypatch):
    """Lists are made in tasks of a bounded number of entries, and hashes are not shuffled."""
    from kilnwork.plans import stored
    from kilnwork.queries.registry import QUERIES

    monkeypatch.setattr(stored, "TASK_ROWS", 500)
    made = QUERIES["s4_encode_manifest"](spark, inputs.sf_dir)
    assert made.rdd.getNumPartitions() == inputs.fx_chunk_entries.count() // 500 + 1 > 4


def test_no_shuffle_of_shared_chunks_follows_the_session(spark, inputs, monkeypatch):
    """Tasks are as many as entries or pairs need, also for a class that shares chunks with all others."""
    from kilnwork.plans import stored

    for module, name, value in ((stored, "TASK_ROWS", 100), (s, "BLOCK", 8), (s, "TASK_PAIRS", 150), (s, "SENT_PAIRS", 500)):
        monkeypatch.setattr(module, name, value, raising=False)
    held = {0: set(range(1, 61)), **{b: {c for c in range(1, 61) if (b + c) % 3 == 0} | {b + 1000} for b in range(1, 90)}}
    entries = spark.createDataFrame([(b, c) for b, chunks in held.items() for c in chunks], "blob_id long, chunk_id long")
    classes, pairs = s.shared_pairs(entries)
    _, members, links = s.shared_chunks(entries)
    for made in (classes, pairs, members, links, inputs.fx_chunk_entries):
        assert "ENSURE_REQUIREMENTS" not in made._jdf.queryExecution().executedPlan().toString()
    found = pairs.withColumn("task", F.spark_partition_id()).collect()
    want = {(a, b): len(held[a] & held[b]) for a in held for b in held if a < b and held[a] & held[b]}
    assert sorted((r.a, r.b, r.shared) for r in found) == sorted((*k, n) for k, n in want.items())
    assert len({r.task for r in found if r.a == 0}) > 5


def test_chunk_entries_are_those_of_their_sql(spark, inputs):
    from kilnwork.queries.built import chunk_entries
    from kilnwork.queries.views import VIEWS

    plain = spark.sql(VIEWS["fx_chunk_entries"].replace("orders", "{o}").replace("lineitem", "{l}"), o=inputs.orders, l=inputs.lineitem)
    assert inputs.fx_chunk_entries.schema.simpleString() == plain.schema.simpleString()
    assert sorted(inputs.fx_chunk_entries.collect()) == sorted(plain.collect())
    known = inputs.orders.filter("o_orderkey % 2 = 0")
    assert chunk_entries(known, inputs.lineitem).filter("blob_id % 2 = 1").isEmpty()
