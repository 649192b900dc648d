"""Filters that tell which keys a set can't hold, as small tables that aggregates make and merge.

A filter has rows of a block number and eight words of 64 bits. A key sets one
bit in each word of one block. Rows of filters of one number of blocks merge by
or, whichever writer or day they come from. A key of the set always passes; at
16 bits a key about one in 500 others does. A fuller filter passes more and is
never wrong.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORDS = [f"w{i}" for i in range(8)]
BITS_A_KEY = 16
#: Bytes of a block as a broadcast row, and what a broadcast filter may take.
ROW_BYTES, BROADCAST_BYTES = 128, 64 << 20


def blocks_for(keys: int) -> int:
    """The number of blocks, a power of two, that gives ``keys`` keys their bits."""
    return 1 << max(0, -(-keys * BITS_A_KEY // (64 * len(WORDS))) - 1).bit_length()


def fits_broadcast(blocks: int) -> bool:
    """A filter has a row for each block at most, so its number of blocks bounds its size."""
    return blocks * ROW_BYTES <= BROADCAST_BYTES


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks).cast("long"))


def _masks(key: Column) -> list[Column]:
    bits = F.xxhash64(key, F.lit(1))
    return [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(bits, 6 * i).bitwiseAND(F.lit(63).cast("long")).cast("int")) for i in range(len(WORDS))]


def build_filter(df: DataFrame, key: str, blocks: int, by: Sequence[str] = ()) -> DataFrame:
    """``*by, block, w0 .. w7``: a filter of the keys of ``df`` for each value of ``by``; null keys are left out."""
    held = df.filter(F.col(key).isNotNull())
    masks = held.select(*by, _block(F.col(key), blocks).alias("block"), *[m.alias(w) for m, w in zip(_masks(F.col(key)), WORDS, strict=True)])
    return merge_filters(masks, by)


def merge_filters(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Rows of several filters of one number of blocks as one filter."""
    return rows.groupBy(*by, "block").agg(*[F.bit_or(w).alias(w) for w in WORDS])


def possible(df: DataFrame, key: str, filters: DataFrame, blocks: int, by: Sequence[str] = ()) -> DataFrame:
    """The rows of ``df`` whose key the set may hold; no row that it holds is left out, unless its key is null.

    Without ``by`` a filter within the bound is broadcast, so nothing is
    shuffled; others are joined as Spark's size check decides.
    """
    named = filters.select(*[F.col(b).alias(f"__by{i}") for i, b in enumerate(by)], F.col("block").alias("__block"), *[F.col(w).alias(f"__{w}") for w in WORDS])
    on = _block(F.col(key), blocks) == F.col("__block")
    for i, b in enumerate(by):
        on = on & (F.col(b) == F.col(f"__by{i}"))
    joined = df.filter(F.col(key).isNotNull()).join(F.broadcast(named) if not by and fits_broadcast(blocks) else named, on)
    for mask, w in zip(_masks(F.col(key)), WORDS, strict=True):
        joined = joined.filter(F.col(f"__{w}").bitwiseAND(mask) != 0)
    return joined.select(*df.columns)


def fill(filters: DataFrame, blocks: int, by: Sequence[str] = ()) -> DataFrame:
    """``*by, filled, rate``: the share of bits that are set, and of strange keys that it lets expect to pass."""
    bits = sum((F.bit_count(w) for w in WORDS[1:]), F.bit_count(WORDS[0]))
    passed = F.lit(1.0)
    for w in WORDS:
        passed = passed * F.bit_count(w) / 64
    return filters.groupBy(*by).agg((F.sum(bits) / (blocks * 64.0 * len(WORDS))).alias("filled"), (F.sum(passed) / float(blocks)).alias("rate"))
