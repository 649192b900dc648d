"""Small graphs with known answers."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from kilnwork.operators import graph as g
from kilnwork.plans.components import connected_components
from kilnwork.plans.running import running_totals
from kilnwork.plans.walk import fold_up, waiting_nodes, walk

CHAIN = [(4, 3), (3, 2), (2, 1)]
DIAMOND = [(4, 2), (4, 3), (2, 1), (3, 1)]


def edges(spark, pairs):
    return spark.createDataFrame(pairs, "parent_id long, child_id long")


def nodes(spark, status=None, estimate=None, ids=(1, 2, 3, 4)):
    rows = [(i, (status or {}).get(i, "queued"), float((estimate or {}).get(i, 10 * i)), False, False, 0, f"n{i}") for i in ids]
    return spark.createDataFrame(rows, "node_id long, status string, estimate double, is_fixed_output boolean, is_floating boolean, retry_count int, drv_hash string")


def values(df, key="node_id", value="value"):
    return {r[key]: r[value] for r in df.collect()}


def test_critical_path(spark):
    assert values(g.critical_path(nodes(spark), edges(spark, CHAIN))) == {1: 10, 2: 30, 3: 60, 4: 100}
    assert values(g.critical_path(nodes(spark), edges(spark, DIAMOND))) == {1: 10, 2: 30, 3: 40, 4: 80}
    done = nodes(spark, {1: "completed", 3: "completed"})
    assert values(g.critical_path(done, edges(spark, DIAMOND)))[4] == 60
    assert values(g.critical_path(done, edges(spark, DIAMOND), exclude_terminal=False))[4] == 80
    assert values(g.critical_path(nodes(spark), edges(spark, []))) == {1: 10, 2: 20, 3: 30, 4: 40}
    assert values(g.critical_path(nodes(spark), edges(spark, [*CHAIN, (4, 1), (4, 99), (2, 98)]))) == {1: 10, 2: 30, 3: 60, 4: 100}


def test_update_stops_where_nothing_changes(spark):
    n, e = nodes(spark), edges(spark, DIAMOND)
    old = g.critical_path(n, e)
    lower = spark.createDataFrame([(2, 5.0)], "node_id long, estimate double")
    assert values(g.update_ancestors(n, e, old, lower)) == {1: 10, 2: 15, 3: 40, 4: 80}
    higher = spark.createDataFrame([(1, 100.0)], "node_id long, estimate double")
    assert values(g.update_ancestors(n, e, old, higher)) == {1: 100, 2: 120, 3: 130, 4: 170}


def test_cycles(spark):
    ring = edges(spark, [(1, 2), (2, 3), (3, 1), (4, 1), (3, 5)])
    assert {r.id for r in g.cycle_nodes(ring).collect()} == {1, 2, 3}
    assert g.cycle_nodes(edges(spark, DIAMOND)).count() == 0
    with pytest.raises(ValueError):
        g.critical_path(nodes(spark), edges(spark, [(1, 2), (2, 1)]))
    with pytest.raises(RuntimeError):
        waiting_nodes(edges(spark, CHAIN), max_rounds=2)


def test_readiness(spark):
    n = nodes(spark, {1: "completed", 2: "skipped", 3: "poisoned"}, ids=(1, 2, 3, 4, 5, 6, 7))
    e = edges(spark, [(4, 1), (4, 2), (5, 3), (5, 1), (6, 99), (7, 4)])
    states = values(g.initial_states(n.filter("node_id > 3"), e, n), value="state")
    assert states == {4: "ready", 5: "dependency_failed", 6: "queued", 7: "queued"}
    done = spark.createDataFrame([(4,)], "node_id long")
    assert [r.node_id for r in g.newly_ready(done, e, n).collect()] == [7]


def test_cascades(spark):
    n = nodes(spark, {1: "poisoned", 3: "running"})
    fallen = g.cascade_failure(n.filter("status = 'poisoned'"), edges(spark, DIAMOND), n)
    assert {r.node_id for r in fallen.collect()} == {2, 4}
    done = nodes(spark, {1: "completed"})
    every = done.select("node_id")
    skipped, capped = g.cascade_cutoff(done.filter("node_id = 1"), edges(spark, DIAMOND), done, every)
    assert values(skipped, value="level") == {2: 1, 3: 1, 4: 2} and not capped
    assert g.seconds_saved(skipped, done).first().saved_secs == 90
    skipped, capped = g.cascade_cutoff(done.filter("node_id = 1"), edges(spark, DIAMOND), done, every, max_nodes=1)
    assert {r.node_id for r in skipped.collect()} == {2, 3} and capped
    some = spark.createDataFrame([(2,)], "node_id long")
    assert {r.node_id for r in g.cascade_cutoff(done.filter("node_id = 1"), edges(spark, DIAMOND), done, some)[0].collect()} == {2}


def test_merkle_sees_changes_below_but_not_below_fixed_outputs(spark):
    e = edges(spark, CHAIN)
    a = values(g.merkle_fingerprint(nodes(spark), e, ["estimate"]))
    b = values(g.merkle_fingerprint(nodes(spark, estimate={1: 11}), e, ["estimate"]))
    assert all(a[i] != b[i] for i in (1, 2, 3, 4))
    far = values(g.merkle_fingerprint(nodes(spark), edges(spark, [*CHAIN, (4, 1), (4, 99)]), ["estimate"]))
    digest = lambda own, *below: hashlib.sha256(f"{own}#{','.join(sorted(below))}".encode()).hexdigest()
    assert far == {**{i: a[i] for i in (1, 2, 3)}, 4: digest("40.0", far[1], far[3])}
    fixed = lambda est: nodes(spark, estimate=est).withColumn("is_fixed_output", F.col("node_id") == 3)
    a, b = (values(g.merkle_fingerprint(fixed(x), e, ["estimate"])) for x in ({}, {1: 11}))
    assert a[2] != b[2] and a[3] == b[3] and a[4] == b[4]


def test_merge_keeps_resets_and_inserts(spark):
    old = nodes(spark, {1: "completed", 2: "failed"}, ids=(1, 2)).withColumn("retry_count", F.lit(4))
    new = nodes(spark, ids=(1, 2, 3)).union(nodes(spark, ids=(3,)))
    merged, both = g.merge_dag(old, edges(spark, CHAIN), new, edges(spark, CHAIN + DIAMOND))
    got = {r.node_id: (r.change, r.status, r.retry_count) for r in merged.collect()}
    assert got == {1: ("kept", "completed", 4), 2: ("reset", "queued", 4), 3: ("inserted", "queued", 0)}
    assert both.count() == len({*CHAIN, *DIAMOND})


def test_walk_and_mark(spark):
    refs = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 5)], "path_id long, ref_id long")
    seeds = spark.createDataFrame([(1,), (99,)], "id long")
    assert {(r.id, r.level) for r in walk(refs, seeds, "path_id", "ref_id").collect()} == {(1, 0), (99, 0), (2, 1), (3, 2)}
    paths = spark.createDataFrame([(i, "complete" if i != 5 else "uploading") for i in range(1, 7)], "path_id long, manifest_status string")
    dead = g.mark_unreachable(paths, refs, seeds.withColumnRenamed("id", "path_id"))
    assert {r.path_id for r in dead.collect()} == {4, 6}
    with pytest.raises(ValueError):
        g.closure(seeds.withColumnRenamed("id", "path_id"), refs, paths, max_nodes=2)


def test_components(spark):
    pairs = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (200, 150), (200, 120), (None, 3)]
    got = {r.node: r.label for r in connected_components(spark.createDataFrame(pairs, "a long, b long"), "a", "b").collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 120: 120, 150: 120, 200: 120}
    assert connected_components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_running_totals(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("k"), F.lit(2).alias("v"))
    got = {r.k: (r.place, r.upto) for r in running_totals(df, [F.col("k")], {"place": F.lit(1), "upto": F.col("v")}).collect()}
    assert got == {k: (k + 1, 2 * k + 2) for k in range(1000)}
    assert running_totals(df.limit(0), [F.col("k")], {"n": F.lit(1)}).count() == 0


def test_states_are_decided_over_all_children(inputs):
    """Over all edges some nodes differ from what their greatest child alone says, and no query is empty."""
    import kilnwork.queries.graph  # noqa: F401
    from kilnwork.queries.registry import QUERIES

    one = inputs.fx_edges.groupBy("parent_id").agg(F.max("child_id").alias("child_id"))
    few = g.initial_states(inputs.fx_nodes, one, inputs.fx_nodes.filter("status <> 'created'"))
    states = QUERIES["g5_initial_states"](inputs.spark, inputs.sf_dir)
    assert {r.state for r in states.select("state").distinct().collect()} == {"dependency_failed", "queued", "ready"}
    assert sorted(map(tuple, states.select("node_id", "state").collect())) != sorted(map(tuple, few.select("node_id", "state").collect()))
    for name in ("g6_newly_ready", "g8_cascade_cutoff"):
        assert QUERIES[name](inputs.spark, inputs.sf_dir).count() > 0, name
    assert inputs.fx_edges.groupBy("parent_id").count().agg(F.max("count")).first()[0] > 1


def plain_reach(pairs):
    """For each node, what it reaches over one edge or more."""
    ahead = {}
    for a, b in pairs:
        ahead.setdefault(a, set()).add(b)
    out = {}
    for n in {x for p in pairs for x in p}:
        seen, todo = set(), [n]
        while todo:
            for m in ahead.get(todo.pop(), ()):
                if m not in seen:
                    seen.add(m)
                    todo.append(m)
        out[n] = seen
    return out


@pytest.mark.parametrize("pairs", [
    [(1, 2), (2, 1), (2, 3), (3, 4), (4, 5), (5, 4)],
    [(i, (i * 7 + 3) % 60) for i in range(60)] + [(i, (i * 5 + 1) % 60) for i in range(0, 60, 4)] + [(70, 70), (71, 1), (2, 72)],
    [(i, i + 1) for i in range(40)] + [(40, 20), (19, 3), (41, 41), (41, 0)],
])
def test_strong_components(spark, pairs):
    """A node between two cycles is on none; each cycle node has the least node of its component."""
    reach = plain_reach(pairs)
    want = {n: min(m for m in seen if n in reach[m]) for n, seen in reach.items() if n in seen}
    got = {r.id: r.component for r in g.cycle_nodes(edges(spark, pairs)).collect()}
    assert got == want


def test_a_chain_of_ten_thousand_in_few_rounds(spark):
    chain = spark.range(10_000).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    more = spark.createDataFrame([(3000, 20_000), (20_000, 20_001), (20_001, 9000), (30_000, 30_001), (30_001, 30_000), (None, 5)], "a long, b long")
    reached = walk(chain.union(more), spark.createDataFrame([(0,), (7000,)], "id long"), "a", "b", max_rounds=20, plain_rounds=3)
    got = {r.id: r.level for r in reached.collect()}
    want = {i: i if i < 7000 else i - 7000 for i in range(10_001)} | {20_000: 3001, 20_001: 3002}
    assert got == want


@pytest.mark.parametrize("seed", [1, 2])
def test_drawn_together_chains_give_the_same_levels(spark, seed):
    rng = random.Random(seed)
    pairs = [(i, i + 1) for i in range(60) if i % 13] + [(rng.randrange(61), rng.randrange(61)) for _ in range(15)]
    got = {r.id: r.level for r in walk(edges(spark, pairs), spark.createDataFrame([(1,), (30,)], "id long"), "parent_id", "child_id", plain_rounds=1).collect()}
    want, frontier = {1: 0, 30: 0}, [1, 30]
    while frontier:
        frontier = [b for a in frontier for x, b in pairs if x == a and b not in want and not want.update({b: want[a] + 1})]
    assert got == want


@pytest.mark.parametrize("small", [0, 3, 64])
def test_build_roots_by_members_and_by_edges(spark, monkeypatch, small):
    """Builds of any size, hubs with parents in other builds, edges to oneself, nodes in no edge, repeated rows."""
    monkeypatch.setattr(g, "SMALL_BUILD", small)
    rng = random.Random(7)
    held = [(b, rng.randrange(40)) for b in range(12) for _ in range(b * 2 + 1)] + [(20, n) for n in range(40)] + [(20, 50), (21, 50), (3, 3), (3, 3)]
    pairs = [(rng.randrange(40), rng.randrange(40)) for _ in range(60)] + [(100 + i, 5) for i in range(30)] + [(3, 3)]
    rows = spark.createDataFrame(held, "build_id long, node_id long")
    want = sorted((b, n) for b, n in held if not any((b, p) in held for p, c in pairs if c == n))
    assert sorted(map(tuple, g.build_roots(rows, edges(spark, pairs)).collect())) == want


def test_build_roots_join_no_build_by_edges(spark):
    """A node of very many builds with very many parents outside them: the rows of a join stay near those that come in."""
    rows = spark.range(3000).select(F.col("id").alias("build_id"), F.lit(0).cast("long").alias("node_id"))
    hub = spark.range(1, 3001).select(F.col("id").alias("parent_id"), F.lit(0).cast("long").alias("child_id"))
    found = g.build_roots(rows.union(hub.select("parent_id", F.col("parent_id") + 10_000)).union(spark.createDataFrame([(1, 1)], "b long, n long")), hub)
    assert found.count() == 6000
    assert most_joined(found) < 100_000


def most_joined(df):
    """The most rows that a join of a finished plan gave."""
    def walk_plan(p):
        name = p.nodeName()
        if name.startswith("AdaptiveSparkPlan"):
            yield from walk_plan(p.executedPlan())
            return
        if name.endswith("QueryStage"):
            yield from walk_plan(p.plan())
            return
        if "Join" in name and p.metrics().contains("numOutputRows"):
            yield p.metrics().apply("numOutputRows").value()
        for i in range(p.children().size()):
            yield from walk_plan(p.children().apply(i))

    df.collect()
    return max(walk_plan(df._jdf.queryExecution().executedPlan()))


def test_fingerprints_travel_as_bytes(spark, monkeypatch):
    """What the rounds store and send is 32 bytes a child, not 64 hex digits."""
    sent = []
    monkeypatch.setattr(g, "fold_up", lambda *a, **k: sent.append(fold_up(*a, **k)) or sent[0])
    shown = g.merkle_fingerprint(nodes(spark), edges(spark, [(1, 0), (2, 0), (2, 1)]), ["estimate"])
    assert dict(sent[0].dtypes)["value"] == "binary" and sent[0].filter("length(value) <> 32").isEmpty()
    assert dict(shown.dtypes)["value"] == "string" and shown.filter("length(value) <> 64").isEmpty()
