"""Texts of Arrow batches as flat numpy arrays, in blocks of bounded size."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa

#: Characters that are worked on at once; a longer text makes a block of its own.
BLOCK_CHARS = 1 << 20

SPACE, WORD, OTHER = 0, 1, 2


def text_blocks(batches, column: str = "text", chars: int = BLOCK_CHARS) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Slices of the batches with the texts in them, null as None."""
    for batch in batches:
        texts = batch.column(column).to_pylist()
        start = size = 0
        for i, text in enumerate(texts):
            n = len(text or "") + 1
            if i > start and size + n > chars:
                yield batch.slice(start, i - start), texts[start:i]
                start, size = i, 0
            size += n
        if start < len(texts):
            yield batch.slice(start), texts[start:]


def codepoints(texts: list[str], pad: int) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, each followed by ``pad`` zeros, and where each text starts."""
    gap = "\0" * pad
    flat = np.frombuffer((gap.join(texts) + gap).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)) + pad
    return flat, np.cumsum(sizes) - sizes


@cache
def letters() -> np.ndarray:
    """For each code point, whether it is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)


@cache
def kinds() -> np.ndarray:
    """For each code point SPACE, WORD (letters, digits, marks) or OTHER; zero, the padding, is SPACE."""
    import regex

    every = "".join(map(chr, (*range(0xD800), *[0x20] * 0x800, *range(0xE000, 0x110000))))
    out = np.full(0x110000, OTHER, dtype=np.uint8)
    for kind, pattern in ((SPACE, r"[\s\x00]+"), (WORD, r"[\p{L}\p{N}\p{M}]+")):
        for m in regex.finditer(pattern, every):
            out[m.start() : m.end()] = kind
    return out


def segment_sums(rows: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of rows between starts; starts rise strictly and end before the last row."""
    return np.add.reduceat(rows, starts, axis=0)


def tokens(flat: np.ndarray, classes: np.ndarray, prefixes: tuple[int, ...] = ()) -> tuple[np.ndarray, ...]:
    """Runs of one kind other than SPACE: their starts, kinds, 32-bit hashes, and hashes of their first n characters."""
    kind = classes[flat]
    change = np.flatnonzero(np.diff(kind, prepend=np.uint8(255)))
    run_kind = kind[change]
    sizes = np.diff(change, append=len(flat))
    place = np.arange(len(flat), dtype=np.int64) - np.repeat(change, sizes)
    power = np.empty(64, dtype=np.uint32)
    power[0] = 1
    with np.errstate(over="ignore"):
        for i in range(1, 64):
            power[i] = power[i - 1] * np.uint32(0x01000193)
        mixed = (flat + np.uint32(0x9E37)) * np.uint32(0x85EBCA6B)
        mixed ^= mixed >> np.uint32(13)
        mixed *= power[place & 63]
        keep = run_kind != SPACE
        full = np.add.reduceat(mixed, change, dtype=np.uint32)[keep] if len(change) else mixed
        heads = [np.add.reduceat(np.where(place < n, mixed, np.uint32(0)), change, dtype=np.uint32)[keep] for n in prefixes]
    return (change[keep], run_kind[keep], full, *heads)


def bucket(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Numbers below 2**bits from 32-bit hashes."""
    with np.errstate(over="ignore"):
        mixed = hashes * np.uint32(2654435761)
        mixed ^= mixed >> np.uint32(15)
        mixed *= np.uint32(0x2C1B3C6D)
    return (mixed >> np.uint32(32 - bits)).astype(np.int64)
