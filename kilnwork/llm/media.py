"""Media columns: payload bytes in PNG, read back with checksums, with cosine-transform hashes."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kilnwork.llm.batches import text_blocks

SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Payloads are stored as rows of 64 pixels of three 8-bit samples.
ROW_BYTES, PIXEL_BYTES, WIDTH = 192, 3, 64
SIDE, LOW = 32, 8
#: Payload bytes that are worked on at once, rows that are filtered at once, and inflated bytes of an image at most.
BLOCK_BYTES = 1 << 20
STRIP = 4096
MAX_BYTES = 1 << 31


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def padded(data: bytes) -> bytes:
    """Spaces appended up to a positive multiple of a row."""
    rows = max(1, -(-len(data) // ROW_BYTES))
    return data + b" " * (rows * ROW_BYTES - len(data))


def _guesses(rows: np.ndarray, above: np.ndarray, step: int) -> np.ndarray:
    """What filters 0 to 4 guess each byte to be, from rows and the rows above them."""
    b = above.astype(np.int16)
    a, c = np.zeros_like(b), np.zeros_like(b)
    a[:, step:], c[:, step:] = rows[:, :-step], above[:, :-step]
    return np.stack([np.zeros_like(b), a, b, (a + b) >> 1, paeth(a, b, c)])


def paeth(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Of the left, upper and upper-left bytes the one next to left + upper - upper-left; ties in that order."""
    by_a, by_b, by_c = np.abs(b - c), np.abs(a - c), np.abs(a + b - 2 * c)
    return np.where((by_a <= by_b) & (by_a <= by_c), a, np.where(by_b <= by_c, b, c))


def filter_rows(rows: np.ndarray, above: np.ndarray, step: int = PIXEL_BYTES) -> np.ndarray:
    """Filtered rows, each after the number of its filter: that of the least sum of absolute differences, ties to the smaller."""
    left = (rows.astype(np.int16) - _guesses(rows, above, step)).astype(np.uint8)
    kinds = np.minimum(left, 0 - left).sum(axis=2, dtype=np.int64).argmin(axis=0)
    return np.concatenate([kinds[:, None].astype(np.uint8), left[kinds, np.arange(len(rows))]], axis=1)


def encode_pngs(payloads: list[bytes], level: int = 1) -> list[bytes]:
    """RGB images of 64 pixels a row, the filters chosen row by row."""
    rows = np.frombuffer(b"".join(payloads), dtype=np.uint8).reshape(-1, ROW_BYTES)
    heights = [len(p) // ROW_BYTES for p in payloads]
    above = np.zeros_like(rows)
    above[1:] = rows[:-1]
    above[np.cumsum([0, *heights[:-1]])] = 0
    lines = np.concatenate([filter_rows(rows[i : i + STRIP], above[i : i + STRIP]) for i in range(0, len(rows), STRIP)])
    out, at = [], 0
    for height in heights:
        head = struct.pack(">IIBBBBB", WIDTH, height, 8, 2, 0, 0, 0)
        body = zlib.compress(lines[at : at + height].tobytes(), level)
        out.append(SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", body) + _chunk(b"IEND", b""))
        at += height
    return out


def unfilter(filters: list[np.ndarray], lines: list[np.ndarray], step: int) -> list[np.ndarray]:
    """Undo PNG row filters 0 to 4 on images of one width, each (height, width * step) bytes.

    All images are undone together along their anti-diagonals, as a pixel needs
    only its left, upper and upper-left neighbours.
    """
    heights = np.array([len(x) for x in lines])
    width = lines[0].shape[1] // step
    total = int(heights.sum())
    raw = np.concatenate(lines).reshape(total, width, step)
    kinds = np.concatenate(filters)
    image = np.repeat(np.arange(len(lines)), heights)
    y = np.arange(total) - np.repeat(np.cumsum(heights) - heights, heights)
    out = np.zeros((total + len(lines), width + 1, step), dtype=np.int16)  # a row of zeros above each image, a column at its left
    place = np.arange(total) + image + 1
    order = np.argsort(y, kind="stable")
    y, place, kinds = y[order], place[order], kinds[order]
    first = np.searchsorted(y, np.arange(heights.max() + width + 1))  # where rows of each number begin
    for t in range(int(heights.max()) + width - 1):
        now = slice(first[max(0, t - width + 1)], first[min(t, heights.max() - 1) + 1])
        at, x, kind = place[now], t - y[now], kinds[now][:, None]
        a, b, c = out[at, x], out[at - 1, x + 1], out[at - 1, x]
        guess = np.where(kind == 4, paeth(a, b, c), np.where(kind == 3, (a + b) >> 1, np.where(kind == 2, b, np.where(kind == 1, a, 0))))
        out[at, x + 1] = (raw[order[now], x] + guess) & 255
    ends = np.cumsum(heights + 1)
    return [out[e - h : e, 1:].reshape(h, -1).astype(np.uint8) for h, e in zip(heights, ends, strict=True)]


def read_png(data: bytes, max_bytes: int = MAX_BYTES) -> tuple[np.ndarray, int]:
    """(height, 1 + width * samples) bytes, still filtered, and the samples of a pixel, of an 8-bit grey, grey-alpha, RGB or RGBA image.

    Raises ValueError on a bad signature, checksum, chunk order, kind or size;
    no more is inflated than the header's size, which is ``max_bytes`` at most.
    """
    if data[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, head, body, ended = 8, None, [], False
    while at < len(data) and not ended:
        if at + 12 > len(data):
            raise ValueError("PNG chunk is cut off")
        (size,) = struct.unpack_from(">I", data, at)
        kind, part = data[at + 4 : at + 8], data[at + 8 : at + 8 + size]
        if len(part) != size or data[at + 8 + size : at + 12 + size] != struct.pack(">I", zlib.crc32(kind + part)):
            raise ValueError(f"PNG checksum of {kind!r} is wrong")
        if (kind == b"IHDR") != (head is None):
            raise ValueError("PNG header is not the first chunk, or not the only one")
        if kind == b"IHDR":
            if size != 13:
                raise ValueError("PNG header has a wrong size")
            head = struct.unpack(">IIBBBBB", part)
        elif kind == b"IDAT":
            body.append(part)
        ended = kind == b"IEND"
        at += 12 + size
    if head is None or not ended:
        raise ValueError("PNG without IHDR or IEND")
    width, height, depth, colour, packing, filtering, interlaced = head
    step = {0: 1, 4: 2, 2: 3, 6: 4}.get(colour)
    if depth != 8 or step is None or packing or filtering or interlaced:
        raise ValueError("PNG kind is not read here")
    size = height * (width * step + 1)
    if not width or not height or size > max_bytes:
        raise ValueError("PNG is empty or too large")
    inflater = zlib.decompressobj()
    try:
        flat = inflater.decompress(b"".join(body), size + 1)
    except zlib.error as e:
        raise ValueError("PNG data can't be inflated") from e
    if len(flat) != size or not inflater.eof:
        raise ValueError("PNG data has a wrong size")
    lines = np.frombuffer(flat, dtype=np.uint8).reshape(height, -1)
    if lines[:, 0].max() > 4:
        raise ValueError("unknown PNG filter")
    return lines, step


def decode_pngs(images: list[bytes | None]) -> list[tuple[np.ndarray, int] | str]:
    """For each image its (height, width * samples) bytes and the samples of a pixel, or what is wrong with it."""
    found: list = []
    alike: dict[tuple[int, int], list[int]] = {}
    for i, data in enumerate(images):
        try:
            found.append(("null" if data is None else read_png(data)))
        except ValueError as e:
            found.append(str(e))
        if not isinstance(found[-1], str):
            lines, step = found[-1]
            alike.setdefault((lines.shape[1], step), []).append(i)
    for (_, step), group in alike.items():
        undone = unfilter([found[i][0][:, 0] for i in group], [found[i][0][:, 1:] for i in group], step)
        for i, rows in zip(group, undone, strict=True):
            found[i] = (rows, step)
    return found


@cache
def _cosines() -> np.ndarray:
    """The LOW lowest frequencies of a cosine transform over SIDE samples."""
    k, x = np.arange(LOW)[:, None], np.arange(SIDE)[None, :]
    return np.cos(np.pi * k * (2 * x + 1) / (2 * SIDE))


def cosine_hash(rows: np.ndarray, step: int) -> bytes:
    """Eight bytes: which low frequencies of the image, 32 by 32 block means, lie above their median."""
    grey = rows.reshape(len(rows), -1, step).mean(axis=2, dtype=np.float64)
    for axis in (0, 1):
        n = grey.shape[axis]
        if n >= SIDE:
            cuts = np.arange(SIDE) * n // SIDE
            sizes = np.diff(cuts, append=n)
            grey = np.add.reduceat(grey, cuts, axis=axis) / (sizes[:, None] if axis == 0 else sizes)
        else:
            grey = grey.take(np.arange(SIDE) * n // SIDE, axis=axis)
    low = np.rint((_cosines() @ grey @ _cosines().T).ravel() * 1e6)
    low[0] = 0  # the mean says nothing about shape
    return np.packbits(low > np.median(low)).tobytes()


def encode_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", level: int = 1) -> DataFrame:
    """``doc_id, n_bytes, media``: each whole text as a PNG in a binary column.

    Null texts are empty; an empty text is one row of spaces. Every row gets an
    image, rows of a null id and repeated rows each by themselves; equal texts
    have equal images. Other columns are ignored, whatever they are called.
    """

    def encode(batches):
        for batch, texts in text_blocks(batches, chars=BLOCK_BYTES):
            raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
            media = pa.array(encode_pngs([padded(b) for b in raw], level), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(list(map(len, raw)), pa.int64()), media], ["doc_id", "n_bytes", "media"])

    kind = docs.schema[id_col].dataType.simpleString()
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return slim.mapInArrow(encode, f"doc_id {kind}, n_bytes long, media binary")


def image_blocks(batch: pa.RecordBatch, column: str) -> Iterator[tuple[pa.RecordBatch, list[bytes | None]]]:
    """Slices of a batch with their images, of about BLOCK_BYTES; a larger image is a block of its own."""
    images = batch.column(column).to_pylist()
    start = size = 0
    for i, data in enumerate(images):
        if i > start and size + len(data or b"") > BLOCK_BYTES // 2:
            yield batch.slice(start, i - start), images[start:i]
            start, size = i, 0
        size += len(data or b"")
    if start < len(images):
        yield batch.slice(start), images[start:]


def media_features(media: DataFrame, media_col: str = "media") -> DataFrame:
    """Features of each image, read from its stored bytes.

    ``payload_bytes, payload_sha256, tail_crc32, hash, fault``, with the row's
    other columns; columns of these names are replaced. A null image or one
    that fails a test has its reason in ``fault`` and null features; no row is
    lost.
    """
    names = ["payload_bytes", "payload_sha256", "tail_crc32", "hash", "fault"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.string()]

    def features(found: tuple[np.ndarray, int] | str) -> tuple:
        if isinstance(found, str):
            return None, None, None, None, found
        rows, step = found
        payload = rows.tobytes()
        return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), cosine_hash(rows, step), None

    def read(batches):
        for whole in batches:
            for batch, images in image_blocks(whole, media_col):
                found = [features(f) for f in decode_pngs(images)]
                columns = [pa.array([f[i] for f in found], k) for i, k in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, *names])

    own = [c for c in media.columns if c not in names]
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in media.schema if f.name in own)
    return media.select(*own).mapInArrow(read, f"{kept}, payload_bytes long, payload_sha256 string, tail_crc32 long, hash binary, fault string")
