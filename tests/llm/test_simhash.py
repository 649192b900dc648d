import random

import numpy as np
import pytest
from plain import classes, documents, fingerprint

from kilnwork.llm import simhash


def texts(n=150, seed=3):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    out = []
    for _ in range(n):
        base = [r.choice(vocab) for _ in range(r.randint(1, 120))]
        out.append(" ".join(base))
        if r.random() < 0.4:
            near = base[:]
            near[r.randrange(len(near))] = "CHANGED"
            out += [" ".join(near), "  ".join(base).upper()]
    return out + [None, "", " \n", "one", "one two", "x " * 20000]


def test_fingerprints_match_plain():
    for t in texts():
        assert simhash.fingerprint(t) == fingerprint(t)


def test_classes_match_plain(spark):
    rows = list(enumerate(texts()))
    want = classes({d: fingerprint(t) for d, t in rows})
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(documents(spark, rows), shard_size=16).collect()}
    assert got == want


@pytest.mark.parametrize("size", [1, 40, 600])
def test_links_connect_all_pairs(size):
    r = np.random.default_rng(size)
    centres = r.integers(0, 2**64, size, dtype=np.uint64)
    fps = [int(c) for c in centres]
    for c in centres[: size // 2]:
        x = int(c)
        for _ in range(4):  # chains of near ones
            for b in r.choice(64, 3, replace=False):
                x ^= 1 << int(b)
            fps.append(x)
    fps = np.array(sorted(set(fps)), dtype=np.uint64)
    label = np.arange(len(fps))
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4
    while True:
        low = np.where(near, label[None, :], len(fps)).min(axis=1)
        if (low == label).all():
            break
        label = low
    masks = simhash.band_masks(4)
    links = simhash.Links(len(fps))
    for mask, radius in masks:
        tree = simhash.lay_out(fps, [(mask, radius), (simhash.ALL_BITS, 4)], len(fps) / 16)
        rows, leaves, homes = simhash.shards(tree, fps)
        assert homes.sum() == len(fps)
        leaves = simhash.divided(fps[rows], leaves, mask, 2)
        for leaf in set(leaves.tolist()):
            at = rows[leaves == leaf]
            part = simhash.link_shard(fps[at], homes[leaves == leaf], mask, radius)
            links.join(at, at[part.roots(np.arange(len(at)))])
    assert (links.roots(np.arange(len(fps))) == label).all()


def test_bands_cover_every_pair():
    r = random.Random(1)
    for _ in range(500):
        flipped = sum(1 << b for b in r.sample(range(64), r.randint(0, 4)))
        assert any((flipped & mask).bit_count() <= radius for mask, radius in simhash.band_masks(4))


@pytest.mark.parametrize("n", [100_000, 3_000_000])
def test_copies_and_shards_stay_flat(n):
    """One shard a mask for every fingerprint, and no shard above twice its size, however many there are."""
    r = np.random.default_rng(n)
    fps = r.integers(0, 2**64, n, dtype=np.uint64)
    sample = fps[: simhash.SAMPLE_SIZE]
    share = len(sample) * simhash.SHARD_SIZE / n
    for mask, radius in simhash.band_masks(4)[::7]:
        rows, leaves, homes = simhash.shards(simhash.lay_out(sample, [(mask, radius), (simhash.ALL_BITS, 4)], share), fps)
        sizes = np.bincount(leaves)
        assert len(rows) == n and homes.all() and sizes.max() <= 2 * simhash.SHARD_SIZE
        further = np.bincount(np.unique(simhash.divided(fps[rows], leaves, mask, 3), return_inverse=True)[1])
        assert further.max() <= simhash.SHARD_SIZE and np.percentile(further, 95) <= simhash.SHARD_SIZE / 3 and len(further) > 6 * len(sizes)


def test_dense_band_is_still_exact():
    base = 0x0123456789ABCDEF
    fps = np.array(sorted({base ^ (1 << a) ^ (1 << b) for a in range(22, 60) for b in range(22, 60)}), dtype=np.uint64)
    links = simhash.link_shard(fps, np.ones(len(fps), dtype=bool), *simhash.band_masks(4)[0])
    assert len(set(links.roots(np.arange(len(fps))).tolist())) == 1


def test_keeps_one_of_each_class(spark):
    rows = [(5, "a b c d e"), (3, "A b c d e"), (9, "something else over here entirely"), (9, "something else over here entirely"), (None, "a b c d e"), (7, None), (8, "")]
    kept = simhash.drop_near_duplicates(documents(spark, rows).withColumnRenamed("n_chars", "fp"))
    assert sorted(r.doc_id for r in kept.collect()) == [3, 7, 9, 9]
    empty = documents(spark, rows).limit(0)
    assert simhash.near_duplicates(empty).count() == 0 and simhash.drop_near_duplicates(empty).count() == 0
