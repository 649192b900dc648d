"""Merkle manifests of documents: digests, a proof of each row, and what a presented row folds to."""

from __future__ import annotations

from collections.abc import Sequence
from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kilnwork.plans.running import running_totals
from kilnwork.plans.stored import stored

#: Nodes that become one, and how many levels of that a superblock spans.
FAN, LEVELS = 8, 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def leaf_digest(values: Sequence[Column]) -> Column:
    """sha256 as hex of all values: ``-`` for a null, else the number of UTF-8 bytes, a colon and the value."""
    text = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.when(v.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v)) for v in text]), 256)


def fold_proof(leaf: Column, proof: Column, lefts: Column, rights: Column) -> Column:
    """The root that ``leaf`` folds to with the siblings of ``proof``, of which each level has some on the left and some on the right."""
    start = F.struct(leaf.alias("node"), F.lit(1).alias("at"))

    def up(state: Column, step: Column) -> Column:
        left, right = step["lefts"] * 64, step["rights"] * 64
        before, after = F.substr(proof, state["at"], left), F.substr(proof, state["at"] + left, right)
        return F.struct(F.sha2(F.concat(before, state["node"], after), 256).alias("node"), (state["at"] + left + right).alias("at"))

    steps = F.arrays_zip(lefts.alias("lefts"), rights.alias("rights"))
    return F.aggregate(steps, start, up, lambda s: s["node"])


def _digest(nodes: str) -> str:
    return sha256(nodes.encode()).hexdigest()


def _reduce(nodes: list[str], block: int, depth: int) -> list[list[str]]:
    """Nodes of a superblock level by level, up to the one node that stands for it.

    A superblock has all its levels, even where a run is one node, unless it is
    the first and not full: then the tree has no other and ends with one node.
    """
    levels = [nodes]
    alone = block == 0 and len(nodes) < FAN**depth
    while len(levels[-1]) > 1 if alone else len(levels) <= depth:
        last = levels[-1]
        levels.append([_digest("".join(last[i : i + FAN])) for i in range(0, len(last), FAN)])
    return levels


def _siblings(levels: list[list[str]], i: int) -> list[tuple[str, str]]:
    """The run's other nodes to the left and to the right of the ``i``-th node and of those it becomes."""
    found = []
    for nodes in levels[:-1]:
        run = i - i % FAN
        found.append(("".join(nodes[run:i]), "".join(nodes[i + 1 : run + FAN])))
        i //= FAN
    return found


def _superblocks(rows: DataFrame, depth: int) -> DataFrame:
    return rows.withColumn("block", F.expr(f"place div {FAN**depth}"))


def _climb(nodes: DataFrame, depth: int) -> list[DataFrame]:
    """``tree, place, node`` tables: ``nodes``, their superblocks, the superblocks of these, until each tree has one node."""

    def top(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        tree, block = key
        ordered = rows.sort_values("place")["node"].tolist()
        return pd.DataFrame({"tree": [tree], "place": [block], "node": _reduce(ordered, int(block), depth)[-1]})

    tables = [nodes]
    while (tables[-1].agg(F.max("place").alias("last")).first().last or 0) > 0:
        grouped = _superblocks(tables[-1], depth).groupBy("tree", "block")
        tables.append(stored(grouped.applyInPandas(top, "tree string, place long, node string")))
    return tables


OUTER = "tree string, place long, node string, lefts array<string>, rights array<string>, subroot string, root string"


def _descend(tables: list[DataFrame], outer: DataFrame, depth: int) -> DataFrame:
    """``outer`` of the last table's nodes, what lies beside their paths to the root, carried down to the first table's nodes."""

    def down(members: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        members = members.sort_values("place", ignore_index=True)
        levels = _reduce(members["node"].tolist(), int(members["block"].iloc[0]), depth)
        over = above.iloc[0]
        found = [_siblings(levels, i) for i in range(len(members))]
        return pd.DataFrame({
            "tree": members["tree"], "place": members["place"], "node": members["node"],
            "lefts": [[s[0] for s in steps] + list(over["lefts"]) for steps in found],
            "rights": [[s[1] for s in steps] + list(over["rights"]) for steps in found],
            "subroot": over["subroot"], "root": over["root"],
        })

    for table in tables[-2::-1]:
        blocks = _superblocks(table, depth).groupBy("tree", "block")
        outer = stored(blocks.cogroup(outer.withColumnRenamed("place", "block").groupBy("tree", "block")).applyInPandas(down, OUTER))
    return outer


def prove_documents(docs: DataFrame, presented: Column | None = None, fields: Sequence[str] = FIELDS, key: str = "lang", order: str = "doc_id", depth: int = LEVELS) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof, lefts, rights, folded_root`` for each row of ``docs``.

    A row is a leaf, the digest of ``fields``. Leaves of a ``key`` ascend by
    ``order`` (nulls first) and every 8 consecutive nodes become one until one
    is left, the subroot; subroots by key, null first and in byte order, become
    the root in the same way. ``proof`` has the hex digests of the siblings
    from the leaf to the root, of which each level has some to the left and
    some to the right (``lefts``, ``rights``). ``folded_root`` is what the
    digest ``presented``, an expression over ``docs``, folds to with them, or
    the leaf itself where that is null.

    Leaves are numbered through ranges, so a key may hold any share of the
    rows. Superblocks of ``depth`` levels, 512 nodes, are reduced, then their nodes,
    so rounds are logarithmic. What lies outside a superblock on its path to the root is
    sent down to it and meets its leaves in one group, which reduces them
    again, joins the proofs and folds. A group holds 512 digests; texts are
    read once and never shuffled.

    Rows that agree in all fields are leaves each, repeated rows included, and
    of rows with one id the smaller digest comes first. A null key is a key of
    its own, apart from ''. An empty table gives an empty result. Other columns
    are ignored, whatever they are called.
    """
    leaf = leaf_digest([F.col(c) for c in fields])
    slim = docs.select(F.col(order).alias("doc_id"), F.col(key).cast("string").alias("tree"), leaf.alias("node"), (F.lit(None).cast("string") if presented is None else presented).alias("shown"))
    ranked = running_totals(stored(slim), [F.col("doc_id").asc_nulls_first(), F.col("node")], {"number": F.lit(1)}, keys=["tree"])
    leaves = stored(ranked.select("doc_id", "tree", "node", "shown", (F.col("number") - 1).cast("long").alias("place")))
    trees = _climb(leaves.select("tree", "place", "node"), depth)
    tops = trees[-1].select("tree", "node")
    ordered = running_totals(tops, [F.col("tree").asc_nulls_first()], {"number": F.lit(1)})
    subroots = stored(ordered.select("tree", "node", (F.col("number") - 1).cast("long").alias("place")))
    roots = _climb(subroots.select(F.lit("").alias("tree"), "place", "node"), depth)
    nothing = F.array().cast("array<string>")
    outer = roots[-1].select("tree", "place", "node", nothing.alias("lefts"), nothing.alias("rights"), F.lit("").alias("subroot"), F.col("node").alias("root"))
    outer = _descend(roots, outer, depth)
    of_tree = subroots.select(F.col("tree").alias("key"), F.col("place").alias("number"))
    named = outer.join(of_tree, F.col("place") == F.col("number")).select(
        F.col("key").alias("tree"), F.lit(0).cast("long").alias("place"), "node", "lefts", "rights", F.col("node").alias("subroot"), "root"
    )
    above = _descend(trees[1:], named, depth)

    def finish(members: pd.DataFrame, outside: pd.DataFrame) -> pd.DataFrame:
        members = members.sort_values("place", ignore_index=True)
        levels = _reduce(members["node"].tolist(), int(members["block"].iloc[0]), depth)
        over = outside.iloc[0]
        outer_steps = list(zip(over["lefts"], over["rights"], strict=True))
        proofs, lefts, rights, folded = [], [], [], []
        for i, (node, shown) in enumerate(zip(members["node"], members["shown"], strict=True)):
            steps = _siblings(levels, i) + outer_steps
            now = shown if isinstance(shown, str) else node
            for left, right in steps:
                now = _digest(left + now + right)
            proofs.append("".join(left + right for left, right in steps))
            lefts.append([len(left) // 64 for left, _ in steps])
            rights.append([len(right) // 64 for _, right in steps])
            folded.append(now)
        return pd.DataFrame({
            "doc_id": members["doc_id"], "leaf": members["node"], "subroot": over["subroot"], "root": over["root"],
            "proof": proofs, "lefts": lefts, "rights": rights, "folded_root": folded,
        })

    kind = docs.schema[order].dataType.simpleString()
    schema = f"doc_id {kind}, leaf string, subroot string, root string, proof string, lefts array<int>, rights array<int>, folded_root string"
    inner = _superblocks(leaves, depth).groupBy("tree", "block")
    return inner.cogroup(above.withColumnRenamed("place", "block").groupBy("tree", "block")).applyInPandas(finish, schema)


def lowered_leaf(fields: Sequence[str] = FIELDS, text_col: str = "text") -> Column:
    """The digest of a row whose text has its A-Z in lower case."""
    return leaf_digest([F.translate(c, CAPITALS, SMALL) if c == text_col else F.col(c) for c in fields])
