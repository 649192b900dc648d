"""Near duplicates by the Jaccard similarity of word shingles: SimHash links, verified, and what they miss from prefixes of rare shingles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kilnwork.llm.batches import text_blocks
from kilnwork.llm.simhash import fingerprint, fingerprint_links
from kilnwork.plans.components import connected_components
from kilnwork.plans.stored import stored

SHINGLE = 5
#: Least similarity that links, as a fraction.
OVER, UNDER = 4, 5
SEED = 42
#: Counters of shingles by the top bits of their hashes, and how many of them make a row of the sum.
COUNTER_BITS, SEGMENT_BITS = 21, 15
#: Bits of a set's marks.
MARK_BITS = 1024
#: Sets that a task remembers having sent on.
MET_SETS = 200_000


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct word shingles; words are lowered and split as for SimHash.

    Fewer words than a shingle make one shingle, no words none.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(w, SEED) for w in words), dtype=np.uint64, count=len(words))
    width = min(size, len(words))
    n = len(words) - width + 1
    mixed = np.full(n, width, dtype=np.uint64)
    for i in range(width):
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + hashes[i : i + n]
    mixed ^= mixed >> np.uint64(32)
    mixed *= np.uint64(0xD6E8FEB86659FD93)
    return np.unique(mixed ^ (mixed >> np.uint64(32)))


def set_key(found: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(found.tobytes(), SEED)


def marks(found: np.ndarray) -> np.ndarray:
    """MARK_BITS bits of a set, each the parity of how many elements fall on it: two sets differ in as many elements at least as their marks in bits."""
    parity = np.bincount((found & np.uint64(MARK_BITS - 1)).astype(np.int64), minlength=MARK_BITS) & 1
    return np.packbits(parity.astype(np.uint8)).view(np.int64)


def counter(found: np.ndarray) -> np.ndarray:
    return (found >> np.uint64(64 - COUNTER_BITS)).astype(np.int64)


def prefix_size(n: int) -> int:
    """Of two sets as similar as required, the first so many elements of each share one, in any order common to all sets."""
    return n - -(-n * OVER // UNDER) + 1 if n else 0


def similar(shared: Column, a: Column, b: Column) -> Column:
    """Whether sets of ``a`` and ``b`` elements with ``shared`` common ones are as similar as required; whole numbers."""
    return shared * (OVER + UNDER) >= (a + b) * OVER


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text")


def shingle_counts(docs: DataFrame, size: int = SHINGLE) -> np.ndarray:
    """How many shingles fall on each counter, over all documents; the tables summed are of fixed size."""

    def count(batches: Iterator[pa.RecordBatch]):
        counts = np.zeros(1 << COUNTER_BITS, dtype=np.int32)
        for _, texts in text_blocks(batches):
            found = np.concatenate([shingles(t, size) for t in texts])
            np.add.at(counts, counter(found), 1)
        rows = counts.reshape(-1, 1 << SEGMENT_BITS)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(rows), dtype=np.int32)), pa.array([r.tobytes() for r in rows], pa.binary())], ["segment", "counts"])

    def total(key: tuple, parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = np.zeros(1 << SEGMENT_BITS, dtype=np.int64)
        for part in parts:
            for row in part["counts"]:
                out += np.frombuffer(row, dtype=np.int32)
        yield pd.DataFrame({"segment": [key[0]], "counts": [np.minimum(out, 2**31 - 1).astype(np.int32).tobytes()]})

    parts = _texts(docs).mapInArrow(count, "segment int, counts binary")
    rows = parts.groupBy("segment").applyInPandas(total, "segment int, counts binary").collect()
    out = np.zeros((1 << (COUNTER_BITS - SEGMENT_BITS), 1 << SEGMENT_BITS), dtype=np.int32)
    for r in rows:
        out[r.segment] = np.frombuffer(r.counts, dtype=np.int32)
    return out.ravel()


def keys(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """``doc_id, node, fp, n, marks``: documents of equal shingle sets have one node; ``fp`` is the SimHash fingerprint, ``n`` the size of the set."""

    def compute(batches):
        for batch, texts in text_blocks(batches):
            found = [shingles(t, size) for t in texts]
            nodes = np.fromiter(map(set_key, found), dtype=np.uint64, count=len(texts))
            fps = np.fromiter((fingerprint(t, size) for t in texts), dtype=np.uint64, count=len(texts))
            bits = pa.array([marks(f) for f in found], pa.list_(pa.int64()))
            columns = [batch.column("doc_id"), pa.array(nodes.view(np.int64)), pa.array(fps.view(np.int64)), pa.array([len(f) for f in found], pa.int32()), bits]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "node", "fp", "n", "marks"])

    return _texts(docs).mapInArrow(compute, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, node long, fp long, n int, marks array<long>")


def simhash_pairs(nodes: DataFrame) -> DataFrame:
    """``a, b``: nodes that SimHash links, as pairs to verify; nodes of one fingerprint are paired with one of them."""
    sets_of = nodes.select("node", "fp").distinct()
    distinct = stored(sets_of.groupBy("fp").agg(F.min("node").alias("least")))
    same = sets_of.join(distinct, "fp").select(F.col("node").alias("x"), F.col("least").alias("y"))
    links = fingerprint_links(distinct)
    ends = links.join(distinct.select(F.col("fp").alias("a"), F.col("least").alias("x")), "a").join(distinct.select(F.col("fp").alias("b"), F.col("least").alias("y")), "b")
    return same.union(ends.select("x", "y")).filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def prefixes(docs: DataFrame, counts: np.ndarray, size: int = SHINGLE) -> DataFrame:
    """``token, node, n, place``: the rarest shingles of each set of ``n``, by counter and hash, with their place in that order.

    A task leaves out sets that it has met lately, so copies are not sent on one by one.
    """
    counters = docs.sparkSession.sparkContext.broadcast(counts)

    def compute(batches):
        met: set[int] = set()
        for _, texts in text_blocks(batches):
            parts = [(np.zeros(0, dtype=np.uint64), 0, 0)]
            if len(met) > MET_SETS:
                met.clear()
            for t in texts:
                found = shingles(t, size)
                key = set_key(found)
                if key in met:
                    continue
                met.add(key)
                rare = np.lexsort((found, counters.value[counter(found)]))[: prefix_size(len(found))]
                parts.append((found[rare], key, len(found)))
            sizes = [len(p[0]) for p in parts]
            columns = [
                pa.array(np.concatenate([p[0] for p in parts]).view(np.int64)),
                pa.array(np.repeat(np.array([p[1] for p in parts], dtype=np.uint64), sizes).view(np.int64)),
                pa.array(np.repeat(np.array([p[2] for p in parts], dtype=np.int32), sizes)),
                pa.array(np.concatenate([np.arange(s, dtype=np.int32) for s in sizes])),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["token", "node", "n", "place"])

    return _texts(docs).mapInArrow(compute, "token long, node long, n int, place int")


def sets(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """``node, found``: the hashes of each document's shingles."""

    def compute(batches):
        for _, texts in text_blocks(batches):
            found = [shingles(t, size) for t in texts]
            nodes = np.array([set_key(f) for f in found], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(nodes.view(np.int64)), pa.array([f.view(np.int64) for f in found], pa.list_(pa.int64()))], ["node", "found"])

    return _texts(docs).mapInArrow(compute, "node long, found array<long>")


def _candidates(pairs: DataFrame) -> DataFrame:
    """Pairs of rows of one token that may be as similar as required, if the token is the first they share."""
    most = F.least(F.col("a.n") - F.col("a.place"), F.col("b.n") - F.col("b.place"))
    return pairs.filter(similar(most, F.col("a.n"), F.col("b.n"))).select(
        F.least("a.node", "b.node").alias("a"), F.greatest("a.node", "b.node").alias("b")
    ).distinct()


def _possible(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """Pairs that sizes and marks (``known``: node, n, marks) don't show to differ too much; no similar pair is left out."""
    left = known.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("marks").alias("x"))
    right = known.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("marks").alias("y"))
    apart = F.aggregate(F.zip_with("x", "y", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda total, bits: total + bits)
    sizes, shared = F.col("n_a") + F.col("n_b"), F.least("n_a", "n_b")
    both = pairs.join(left, "a").join(right, "b").filter(similar(shared, F.col("n_a"), F.col("n_b")))
    return both.filter(apart * (OVER + UNDER) <= sizes * (UNDER - OVER)).select("a", "b")


def _verified(pairs: DataFrame, known: DataFrame, docs: DataFrame, size: int) -> DataFrame:
    """Pairs whose sets are as similar as required; sets are made and moved for the pairs that are possible."""
    pairs = stored(_possible(pairs, known))
    used = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    ids = known.join(used, "node", "left_semi").select("one").distinct()
    found = stored(sets(docs.join(ids, F.col("doc_id").eqNullSafe(F.col("one")), "left_semi"), size).join(used, "node", "left_semi").dropDuplicates(["node"]))
    left = found.select(F.col("node").alias("a"), F.col("found").alias("x"))
    right = found.select(F.col("node").alias("b"), F.col("found").alias("y"))
    both = pairs.join(left, "a").join(right, "b")
    return both.filter(similar(F.size(F.array_intersect("x", "y")), F.size("x"), F.size("y"))).select("a", "b")


def similar_links(docs: DataFrame, nodes: DataFrame, size: int = SHINGLE) -> DataFrame:
    """``a, b``: links that connect exactly the sets connected by pairs of a Jaccard similarity of 0.8 or more.

    ``nodes`` are the ``keys`` of ``docs``. Pairs that SimHash finds are
    verified first. At this similarity it misses many, so sets meet in the
    shingles of their prefixes too, which leaves out no pair; the order, rarest
    first, only keeps common passages out of them. Members of a shingle are
    compared at first with the one that has the fewest rarer shingles: in a
    group of near copies that is a text without changes of its own. So a large
    group is one class before those still apart are compared pair by pair.
    Pairs are held against sizes and marks of 1,024 bits first, and whole sets
    are made and moved only for those that these leave.
    """
    of_token = Window.partitionBy("token")
    tokens = prefixes(docs, shingle_counts(docs, size), size)
    several = tokens.withColumns({"least": F.min("node").over(of_token), "most": F.max("node").over(of_token)}).filter("least <> most")
    now = stored(several.select("token", "node", "n", "place", F.col("node").alias("label")).distinct())
    known = stored(nodes.groupBy("node").agg(F.min("doc_id").alias("one"), F.first("n").alias("n"), F.first("marks").alias("marks")))
    heads = now.groupBy("token").agg(F.min(F.struct("place", "n", "node", "label")).alias("head")).select("token", "head.*")
    near = _candidates(now.alias("a").join(heads.alias("b"), "token").filter("a.node <> b.node"))
    links = stored(_verified(near.union(simhash_pairs(nodes)).distinct(), known, docs, size))
    classes = connected_components(links, "a", "b").select("node", F.col("label").alias("__label"))
    now = now.join(classes, "node", "left").withColumn("label", F.coalesce("__label", "node")).drop("__label")
    mixed = now.groupBy("token").agg(F.min("label").alias("least"), F.max("label").alias("most")).filter("least <> most").select("token")
    now = stored(now.join(mixed, "token", "left_semi"))
    apart = now.alias("a").join(now.alias("b"), "token").filter("a.label <> b.label")
    return stored(links.union(_verified(_candidates(apart), known, docs, size)))


def near_duplicates(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """``doc_id, component_id`` for each row of ``docs``; ``component_id`` is the smallest doc_id reachable over links.

    Texts without words are one class. A null doc_id bridges others; a class
    of null ids only has a null component_id. Repeated rows are kept, other
    columns ignored. Empty tables give empty results.
    """
    nodes = stored(keys(docs, size))
    classes = connected_components(similar_links(docs, nodes, size), "a", "b")
    labelled = nodes.groupBy("node").agg(F.min("doc_id").alias("least")).join(classes, "node", "left").withColumn("label", F.coalesce("label", "node"))
    least = labelled.groupBy("label").agg(F.min("least").alias("component_id"))
    return nodes.join(labelled.join(least, "label").select("node", "component_id"), "node").select("doc_id", "component_id")


def drop_near_duplicates(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """The rows of ``docs`` that have the smallest doc_id of their class.

    Rows of a null doc_id stay only where their class has no other id.
    """
    kept = F.max(F.col("doc_id").eqNullSafe(F.col("component_id"))).alias("kept")
    dropped = stored(near_duplicates(docs, size).groupBy("doc_id").agg(kept).filter("not kept").select(F.col("doc_id").alias("__dropped")))
    return docs.join(dropped, F.col("doc_id").eqNullSafe(F.col("__dropped")), "left_anti")
