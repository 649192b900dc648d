"""Graph loops: frontier walks and bottom-up folds, each round a distributed join over stored tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kilnwork.plans.stored import Rounds, read_rounds, stored


def walk(edges: DataFrame, seeds: DataFrame, src: str, dst: str, max_rounds: int = 512, plain_rounds: int = 24) -> DataFrame:
    """``id, level`` of everything reachable from ``seeds`` (a column ``id``) along src -> dst, seeds at level 0; the level is the least number of edges.

    A round adds its frontier to one stored table, so plans don't grow with the
    depth; the driver sees one number a round. What is left after
    ``plain_rounds`` is walked with chains drawn together (``_walk_chains``),
    whose rounds grow with the logarithm of a chain's length. Raises
    RuntimeError beyond ``max_rounds``.
    """
    edges = stored(edges.select(src, dst).distinct())
    frontier = seeds.select("id").distinct().withColumn("level", F.lit(0))
    reached = Rounds(frontier)
    seen = reached.add(frontier)
    for level in range(1, min(max_rounds, plain_rounds) + 1):
        last = seen.filter(F.col("level") == level - 1).select(F.col("id").alias(src))
        step = edges.join(last, src, "left_semi").select(F.col(dst).alias("id")).distinct()
        seen = reached.add(step.join(seen.select("id"), "id", "left_anti").withColumn("level", F.lit(level)))
        if seen.filter(F.col("level") == level).isEmpty():
            return seen
    rest = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).join(seen.select(F.col("id").alias("b")), "b", "left_anti").filter("a is not null and b is not null")
    return reached.add(_walk_chains(stored(rest), seen.filter(F.col("level") == level), max_rounds))


def _walk_chains(edges: DataFrame, frontier: DataFrame, max_rounds: int) -> DataFrame:
    """``id, level`` of what ``frontier`` (id, level) reaches over ``edges`` (a, b), which don't lead back to what is known.

    A node with one edge in, from a node with one edge out, follows that one.
    By pointer doubling each follower learns the first node of its chain and
    how far behind it lies; edges then join first nodes, with the length of the
    chain between, and are relaxed until no level falls. Followers in a ring
    have no first node, so nothing leads there.
    """
    single = edges.groupBy("b").agg(F.count("*").alias("n"), F.min("a").alias("a")).filter("n = 1").select("a", "b")
    narrow = edges.groupBy("a").agg(F.count("*").alias("n")).filter("n = 1").select("a")
    follow = stored(single.join(narrow, "a", "left_semi").select(F.col("b").alias("node"), F.col("a").alias("at"), F.lit(1).cast("long").alias("behind")))
    for _ in range(max(1, follow.count()).bit_length()):
        further = follow.select(F.col("node").alias("at"), F.col("at").alias("__at"), F.col("behind").alias("__behind"))
        follow = stored(follow.join(further, "at", "left").select("node", F.coalesce("__at", "at").alias("at"), (F.col("behind") + F.coalesce("__behind", F.lit(0))).alias("behind")))
    followers = follow.select(F.col("node").alias("b"))
    chains = follow.join(follow.select(F.col("node").alias("at")), "at", "left_anti")
    of = chains.select(F.col("node").alias("a"), "at", "behind")
    joined = edges.join(followers, "b", "left_anti").join(of, "a", "left")
    hops = stored(joined.select(F.coalesce("at", "a").alias("a"), "b", (F.coalesce("behind", F.lit(0)) + 1).alias("length")).groupBy("a", "b").agg(F.min("length").alias("length")))
    now = stored(frontier.select("id", F.col("level").cast("long").alias("level"), F.lit(0).alias("round")))
    levels = Rounds(now)
    every = levels.add(now)
    for number in range(1, max_rounds + 1):
        last = every.filter(F.col("round") == number - 1).select(F.col("id").alias("a"), "level")
        found = hops.join(last, "a").groupBy(F.col("b").alias("id")).agg(F.min(F.col("level") + F.col("length")).alias("level"))
        known = every.groupBy("id").agg(F.min("level").alias("known"))
        better = found.join(known, "id", "left").filter("known is null or level < known").select("id", "level", F.lit(number).alias("round"))
        every = levels.add(better)
        if every.filter(F.col("round") == number).isEmpty():
            best = stored(every.groupBy("id").agg(F.min("level").alias("level")))
            behind = chains.join(best.select(F.col("id").alias("at"), "level"), "at").select(F.col("node").alias("id"), (F.col("level") + F.col("behind")).alias("level"))
            fresh = best.join(frontier.select("id"), "id", "left_anti").union(behind)
            return fresh.select("id", F.col("level").cast("int").alias("level"))
    raise RuntimeError(f"the walk did not end within {max_rounds} rounds")


def least_reaching(nodes: DataFrame, edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """``node, label`` of each node: the least node from which it can be reached over ``edges`` (a, b), itself included.

    A round takes the least label over incoming edges and then the label of
    that label, which reaches the node, too, so labels travel in doubling steps.
    """
    now = stored(nodes.select("node", F.col("node").alias("label")))
    for _ in range(max_rounds):
        over = edges.join(now.select(F.col("node").alias("a"), F.col("label").alias("__in")), "a").groupBy(F.col("b").alias("node")).agg(F.min("__in").alias("__in"))
        lower = stored(now.join(over, "node", "left").select("node", F.least("label", "__in").alias("label"), (F.col("__in") < F.col("label")).alias("__moved")))
        if lower.filter("__moved").isEmpty():
            return now
        jumps = lower.select(F.col("node").alias("label"), F.col("label").alias("__next"))
        now = stored(lower.join(jumps, "label").select("node", F.col("__next").alias("label")))
    raise RuntimeError(f"labels did not settle within {max_rounds} rounds")


def strong_components(edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """``node, component`` of every node on a cycle over ``edges`` (parent_id, child_id): the least node of its strongly connected component.

    Nodes that peeling takes off from either end lie on no cycle. Of the rest,
    nodes that the same least node reaches are of one colour, and within a
    colour those that reach it are its component; the others go on with the
    edges within their colours. All colours are worked on at once. A node with
    an edge to itself is a component.
    """
    all_edges = stored(edges.select(F.col("parent_id").alias("a"), F.col("child_id").alias("b")).filter("a is not null and b is not null").distinct())
    plain = all_edges.filter("a <> b").select(F.col("a").alias("parent_id"), F.col("b").alias("child_id"))
    above = waiting_nodes(plain)
    inner = plain.join(above.select(F.col("node_id").alias("parent_id")), "parent_id", "left_semi").join(above.select(F.col("node_id").alias("child_id")), "child_id", "left_semi")
    core = stored(waiting_nodes(inner.select(F.col("child_id").alias("parent_id"), F.col("parent_id").alias("child_id"))).select(F.col("node_id").alias("node")))
    both_in = lambda e, n: e.join(n.select(F.col("node").alias("a")), "a", "left_semi").join(n.select(F.col("node").alias("b")), "b", "left_semi")
    left = stored(both_in(all_edges.filter("a <> b"), core))
    found = None
    for _ in range(max_rounds):
        nodes = stored(left.select(F.col("a").alias("node")).union(left.select("b")).distinct())
        if nodes.isEmpty():
            break
        coloured = _within(left, least_reaching(nodes, left, max_rounds))
        back = least_reaching(nodes, coloured.select(F.col("b").alias("a"), F.col("a").alias("b")), max_rounds)
        ahead = coloured.select(F.col("a").alias("node"), F.col("colour")).union(coloured.select("b", "colour")).distinct()
        done = stored(ahead.join(back, "node").filter("colour = label").select("node", F.col("colour").alias("component")))
        found = found or Rounds(done)
        every = found.add(done)
        rest = coloured.select("a", "b").join(done.select(F.col("node").alias("a")), "a", "left_anti").join(done.select(F.col("node").alias("b")), "b", "left_anti")
        left = stored(_within(rest, back).select("a", "b"))
    else:
        raise RuntimeError(f"components were not found within {max_rounds} rounds")
    own = all_edges.filter("a = b").select(F.col("a").alias("node"), F.col("a").alias("component"))
    if found is None:
        return own
    sizes = every.groupBy("component").agg(F.count("*").alias("n")).filter("n > 1").select("component")
    cycles = every.join(sizes, "component", "left_semi").select("node", "component")
    return cycles.union(own.join(cycles.select("node"), "node", "left_anti"))


def _within(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """``a, b, colour`` of edges whose ends have one label."""
    ends = edges.join(labels.select(F.col("node").alias("a"), F.col("label").alias("colour")), "a").join(labels.select(F.col("node").alias("b"), F.col("label").alias("__other")), "b")
    return stored(ends.filter("colour = __other").select("a", "b", "colour"))


def peel(edges: DataFrame, max_rounds: int) -> Iterator[tuple[DataFrame | None, DataFrame]]:
    """(``node_id`` of the parents whose last child went the round before, parents still waiting) for each round.

    ``edges`` are distinct. Leaves go first and are not returned. The table of
    waiting parents, with the number of children each waits for, shrinks from
    round to round; edges are only read. When no parent is left to go, the
    first part is None, and the second is empty unless there is a cycle.
    """
    pending = edges.groupBy(F.col("parent_id").alias("node_id")).agg(F.count("*").alias("left"))
    fresh = edges.select(F.col("child_id").alias("node_id")).distinct().join(pending, "node_id", "left_anti")
    for _ in range(max_rounds):
        gone = edges.join(fresh.select(F.col("node_id").alias("child_id")), "child_id", "left_semi")
        counts = gone.groupBy(F.col("parent_id").alias("node_id")).agg(F.count("*").alias("gone"))
        now = stored(pending.join(counts, "node_id", "left").select("node_id", (F.col("left") - F.coalesce("gone", F.lit(0))).alias("left")))
        fresh, pending = now.filter("left = 0").select("node_id"), now.filter("left > 0")
        if fresh.isEmpty():
            yield None, pending
            return
        yield fresh, pending
    raise RuntimeError(f"the graph is deeper than {max_rounds} levels")


def waiting_nodes(edges: DataFrame, max_rounds: int = 512) -> DataFrame:
    """``node_id`` of parents on or above a cycle: those that peeling from the leaves never reaches."""
    edges = stored(edges.select("parent_id", "child_id").distinct())
    for _, pending in peel(edges, max_rounds):
        left = pending
    return left.select("node_id")


def fold_up(nodes: DataFrame, edges: DataFrame, own: dict[str, Column], gather: Column, merge: Callable[[Column, Column], Column], finish: Column, kind: str, max_rounds: int = 512) -> DataFrame:
    """``node_id, value`` bottom-up: ``finish`` over a node's own columns and ``folded``, what was gathered from its children.

    ``nodes`` has a unique ``node_id``; an edge that repeats sends its value as
    often, so for a ``gather`` that counts they must be distinct. ``gather`` aggregates the ``value`` of
    the children that were folded in one round, ``merge`` adds that to what
    earlier rounds gathered (null before the first; ``kind`` is its type), so a value is sent over
    each edge once, in the round after it is known. A round stores one table:
    the nodes whose last child was folded in the round before, with their
    values, and the nodes that still wait, which become fewer. The driver sees
    two counts a round. A child without a node counts as folded but has no
    value. Raises ValueError on a cycle, RuntimeError beyond ``max_rounds``.
    """
    edges = stored(edges)
    named = nodes.select("node_id", *[c.alias(n) for n, c in own.items()], F.lit(True).alias("known"), F.lit(0).cast("long").alias("left"))
    parents = edges.select(F.col("parent_id").alias("node_id"), F.lit(1).cast("long").alias("left"))
    children = edges.select(F.col("child_id").alias("node_id"), F.lit(0).cast("long").alias("left"))
    every = named.unionByName(parents.unionByName(children), allowMissingColumns=True)
    first = every.groupBy("node_id").agg(*[F.max(n).alias(n) for n in own], F.coalesce(F.max("known"), F.lit(False)).alias("known"), F.sum("left").alias("left"))
    value = F.when((F.col("left") == 0) & F.col("known"), finish).alias("value")
    columns = first.withColumn("folded", F.lit(None).cast(kind)).select("*", value)
    rounds = [Rounds(columns)]
    now = rounds[0].add(columns)
    for _ in range(max_rounds):
        done = now.filter("left = 0")
        size = now.agg(F.count_if(F.col("left") == 0).alias("done"), F.count_if(F.col("left") > 0).alias("waiting")).first()
        if not size.waiting:
            return read_rounds(rounds).filter("left = 0 and known").select("node_id", "value")
        if not size.done:
            raise ValueError("the graph has a cycle")
        sent = edges.join(done.select(F.col("node_id").alias("child_id"), "value"), "child_id").groupBy(F.col("parent_id").alias("node_id"))
        sums = sent.agg(F.count("*").alias("__gone"), gather.alias("__more"))
        merged = now.filter("left > 0").drop("value").join(sums, "node_id", "left").withColumns(
            {"left": F.col("left") - F.coalesce("__gone", F.lit(0)), "folded": F.when(F.col("__gone").isNull(), F.col("folded")).otherwise(merge(F.col("folded"), F.col("__more")))}
        )
        columns = merged.drop("__gone", "__more").select("*", value)
        rounds.append(Rounds(columns))
        now = rounds[-1].add(columns)
    raise RuntimeError(f"the graph is deeper than {max_rounds} levels")
