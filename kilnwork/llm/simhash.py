"""SimHash near-duplicates: exact pairs from vantage-point trees, classes from their links."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kilnwork.llm.batches import text_blocks
from kilnwork.plans.components import connected_components
from kilnwork.plans.stored import stored

SHINGLE = 4
RADIUS = 4
SEED = 42
#: Fingerprints a shard should hold, how many fingerprints the shards are laid out with at most, and the fewest of these that make a shard.
SHARD_SIZE = 4_000
SAMPLE_SIZE = 65_536
SAMPLE_PER_SHARD = 16
#: Odd numbers that make vantage points of shard numbers.
MIX, STIR = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9
LEAF = 48
ALL_BITS = 0xFFFFFFFFFFFFFFFF


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """SimHash of the word shingles; bits set in over half of the hashes, 0 without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII white space, A-Z
    if not words:
        return 0
    line = b" ".join(words)
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(sizes + 1) - 1
    n = max(1, len(words) - shingle + 1)
    starts = (ends - sizes)[:n].tolist()
    stops = ends[min(shingle, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(line[a:b], SEED) for a, b in zip(starts, stops, strict=True)), dtype="<u8", count=n)
    counts = np.zeros(64, dtype=np.int64)
    for lo in range(0, n, 65536):
        part = hashes[lo : lo + 65536]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << i for i in np.flatnonzero(counts * 2 > n).tolist())


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``doc_id, fp`` of whole texts; ``fp`` is the 64-bit fingerprint as a signed long."""

    def compute(batches):
        for batch, texts in text_blocks(batches):
            fps = np.fromiter((fingerprint(t, shingle) for t in texts), dtype=np.uint64, count=len(texts)).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps)], ["doc_id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return slim.mapInArrow(compute, f"doc_id {kind}, fp long")


@dataclass
class Node:
    """Inner node: points within ``cut`` of ``point`` under ``mask`` lie left. Leaf: ``leaf`` is its number."""

    point: int = 0
    mask: int = ALL_BITS
    radius: int = 0
    cut: int = 0
    left: Node | None = None
    right: Node | None = None
    leaf: int = -1


def distances(fps: np.ndarray, point: int, mask: int = ALL_BITS) -> np.ndarray:
    return np.bitwise_count((fps ^ np.uint64(point)) & np.uint64(mask)).astype(np.int16)


def band_masks(radius: int) -> list[tuple[int, int]]:
    """(mask, 0): sets of bits, in one of which at least a pair within ``radius`` agrees.

    Of radius + 2 bands of bits a pair differs in ``radius`` at most, so it
    agrees in two, and each two bands make a mask: 15 of about 21 bits for four
    bits. Where a pair has distance 0 no cut comes between it, so trees under a
    mask have no overlaps, however many levels they have.
    """
    bands = radius + 2
    edges = [64 * i // bands for i in range(bands + 1)]
    single = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:], strict=False)]
    return [(x | y, 0) for x, y in combinations(single, 2)]


def vantage(points: np.ndarray, measures: list[tuple[int, int]], tries: int = 4) -> Node | None:
    """A vantage point and the cut that halves ``points`` best, by the first measure that parts them at all."""
    for mask, radius in measures:
        best, found = 0, None
        for k in range(tries):
            point = int(points[(len(points) * (2 * k + 1)) // (2 * tries)])
            sizes = np.cumsum(np.bincount(distances(points, point, mask), minlength=65))
            cut = int(np.abs(sizes - len(points) / 2).argmin())
            even = min(int(sizes[cut]), len(points) - int(sizes[cut]))
            if even > best:
                best, found = even, Node(point, mask, radius, cut)
        if found:
            return found
    return None


def lay_out(sample: np.ndarray, measures: list[tuple[int, int]], most: float) -> Node:
    """A tree whose leaves are the shards, each with ``most`` of the sample's points unless these can't be parted."""
    leaves = 0

    def grow(points: np.ndarray) -> Node:
        nonlocal leaves
        node = vantage(points, measures) if len(points) > most else None
        near = node and distances(points, node.point, node.mask) <= node.cut
        if node is None or (node.radius and not _parts_well(points, node)):
            leaves += 1
            return Node(leaf=leaves - 1)
        node.left, node.right = grow(points[near]), grow(points[~near])
        return node

    return grow(sample)


def _parts_well(points: np.ndarray, node: Node) -> bool:
    """Whether both sides of a cut, with what overlaps it, are well below the whole."""
    d = distances(points, node.point, node.mask)
    return max(np.mean(d - node.radius <= node.cut), np.mean(d + node.radius > node.cut)) <= 0.8


def divided(fps: np.ndarray, leaves: np.ndarray, mask: int, levels: int) -> np.ndarray:
    """Shard numbers after ``levels`` more cuts by distance under some bits of ``mask`` from vantage points, both of which follow from a shard's number.

    For numbers of shards that a sample of bounded size can't lay out; under a
    mask that near pairs agree in, cuts part none.
    """
    out, one = leaves.astype(np.uint64), np.uint64(1)
    for _ in range(levels):
        point = (out + one) * np.uint64(MIX)
        point = (point ^ point >> np.uint64(29)) * np.uint64(STIR)
        point ^= point >> np.uint64(32)
        few = point * np.uint64(MIX)
        few = np.uint64(mask) & few & (few >> np.uint64(31) ^ point * np.uint64(STIR))
        few = np.where(np.bitwise_count(few) % 2 == 0, few & (few - one), few)  # an odd number of bits has no tie
        far = 2 * np.bitwise_count((fps ^ point) & few) > np.bitwise_count(few)
        out = out << one | far.astype(np.uint64)
    return out.astype(np.int64)


def shards(root: Node, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, shard and whether the shard is the row's home, for every shard that may hold a neighbour of the row."""
    rows, leaves, homes = [], [], []

    def down(node: Node, at: np.ndarray, home: np.ndarray) -> None:
        if not len(at):
            return
        if node.leaf >= 0:
            rows.append(at), leaves.append(np.full(len(at), node.leaf)), homes.append(home)
            return
        d = distances(fps[at], node.point, node.mask)
        near, far = d - node.radius <= node.cut, d + node.radius > node.cut
        down(node.left, at[near], home[near] & (d[near] <= node.cut))
        down(node.right, at[far], home[far] & (d[far] > node.cut))

    down(root, np.arange(len(fps)), np.ones(len(fps), dtype=bool))
    join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, dtype=kind)
    return join(rows, np.int64), join(leaves, np.int64), join(homes, bool)


class Links:
    """Classes of row numbers; ``join`` takes arrays of linked rows."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def roots(self, rows: np.ndarray) -> np.ndarray:
        found = self.up[rows]
        while True:
            above = self.up[found]
            if np.array_equal(above, found):
                return found
            found = above

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            a, b = self.roots(a), self.roots(b)
            apart = a != b
            a, b = a[apart], b[apart]
            np.minimum.at(self.up, np.maximum(a, b), np.minimum(a, b))


def link_shard(fps: np.ndarray, home: np.ndarray, mask: int, band_radius: int, radius: int = RADIUS) -> Links:
    """Link each row of a shard with all home rows within ``radius``, through a tree of its own.

    Branches are pruned by the triangle bound of the band, and of all bits
    where the band's bits are alike. Every pair of a home row and another row
    within both bounds is compared; pairs already in one class are skipped.
    """
    links = Links(len(fps))
    measures = [(mask, band_radius), (ALL_BITS, radius)]

    def compare(points: np.ndarray, queries: np.ndarray) -> None:
        step = max(1, (1 << 20) // len(queries))
        for lo in range(0, len(points), step):
            part = points[lo : lo + step]
            i, j = np.nonzero(np.bitwise_count(fps[part][:, None] ^ fps[queries][None, :]) <= radius)
            links.join(part[i], queries[j])

    def down(points: np.ndarray, queries: np.ndarray) -> None:
        if not len(points) or not len(queries):
            return
        node = vantage(fps[points], measures, tries=2) if len(points) > LEAF else None
        if node is None:
            compare(points, queries)
            return
        d, e = distances(fps[points], node.point, node.mask), distances(fps[queries], node.point, node.mask)
        down(points[d <= node.cut], queries[e - node.radius <= node.cut])
        down(points[d > node.cut], queries[e + node.radius > node.cut])

    down(np.flatnonzero(home), np.arange(len(fps)))
    return links


def fingerprint_links(distinct: DataFrame, radius: int = RADIUS, shard_size: int = SHARD_SIZE, sample_size: int = SAMPLE_SIZE) -> DataFrame:
    """``a, b``: links that connect exactly the fingerprints connected by pairs within ``radius`` bits.

    ``distinct`` has each fingerprint once, as ``fp``. For each mask a tree is
    laid out on the driver from ``sample_size`` fingerprints at most, whatever
    the number of all; shards beyond what such a tree can have come from
    ``divided``. Every fingerprint goes to one shard of each mask, so a number
    of copies that doesn't grow; only where fingerprints agree under a mask in
    greater number than a shard holds, trees go on with all bits, and what
    overlaps a cut goes to both sides. A shard returns a spanning forest of its
    pairs, not the pairs.
    """
    spark = distinct.sparkSession
    count = distinct.count()
    if not count:
        return spark.createDataFrame([], "a long, b long")
    rate = min(2**30, int(sample_size / count * 2**30) + 1)
    drawn = distinct.filter(F.pmod(F.xxhash64(F.lit("layout"), "fp"), F.lit(2**30)) < rate)
    sample = np.sort(drawn.toArrow().column("fp").to_numpy().view(np.uint64))
    sample = sample[np.argsort((sample * np.uint64(MIX)), kind="stable")]
    masks, share = band_masks(radius), len(sample) * shard_size / count
    levels = max(0, int(np.ceil(np.log2(SAMPLE_PER_SHARD / max(share, 1e-9))))) if share < SAMPLE_PER_SHARD and count > sample_size else 0
    trees = spark.sparkContext.broadcast([lay_out(sample, [m, (ALL_BITS, radius)], max(share, SAMPLE_PER_SHARD if levels else 1)) for m in masks])

    def deal(batches):
        for batch in batches:
            fps = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            for band, tree in enumerate(trees.value):
                row, leaf, home = shards(tree, fps)
                shard = divided(fps[row], leaf, masks[band][0], levels)
                columns = [pa.array(np.full(len(row), band, dtype=np.int32)), pa.array(shard), pa.array(fps[row].view(np.int64)), pa.array(home)]
                yield pa.RecordBatch.from_arrays(columns, ["band", "shard", "fp", "home"])

    def link(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("fp", ignore_index=True)
        fps = rows["fp"].to_numpy(dtype=np.int64)
        links = link_shard(fps.view(np.uint64), rows["home"].to_numpy(), *masks[int(key[0])], radius)
        root = links.roots(np.arange(len(fps)))
        moved = root != np.arange(len(fps))
        return pd.DataFrame({"a": fps[moved], "b": fps[root[moved]]})

    dealt = distinct.select("fp").mapInArrow(deal, "band int, shard long, fp long, home boolean")
    return dealt.groupBy("band", "shard").applyInPandas(link, "a long, b long")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE, shard_size: int = SHARD_SIZE) -> DataFrame:
    """``doc_id, fp, component_id`` for each row of ``docs``.

    Documents whose fingerprints differ in at most ``radius`` bits are linked,
    and ``component_id`` is the smallest doc_id reachable over links. Equal
    fingerprints are one point, so copies cost a row each and no pairs.

    A null or empty text, or one without words, has fingerprint 0, linked like
    any other. Fewer words than a shingle make one shingle. A null doc_id has
    a fingerprint and bridges others; a class of null ids only has a null
    component_id. Repeated rows are kept. Empty tables give empty results.
    """
    prints = stored(fingerprints(docs, shingle=shingle))
    distinct = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    links = fingerprint_links(distinct, radius, shard_size)
    classes = connected_components(links, "a", "b")
    labelled = distinct.join(classes.select(F.col("node").alias("fp"), "label"), "fp", "left").withColumn(
        "label", F.coalesce("label", "fp")
    )
    least = labelled.groupBy("label").agg(F.min("least").alias("component_id"))
    of_print = labelled.join(least, "label").select("fp", "component_id")
    return prints.join(of_print, "fp").select("doc_id", "fp", "component_id")


def drop_near_duplicates(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """The rows of ``docs`` that have the smallest doc_id of their class.

    Rows of a null doc_id stay only where their class has no other id.
    """
    classes = near_duplicates(docs.select("doc_id", "text"), radius, shingle)
    kept = classes.filter("doc_id <=> component_id").select(F.col("doc_id").alias("__kept")).distinct()
    return docs.join(kept, F.col("doc_id").eqNullSafe(F.col("__kept")), "left_semi")
