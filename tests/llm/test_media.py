import hashlib
import struct
import zlib

import numpy as np
import pytest
from plain import documents
from pyspark.sql import functions as F

from kilnwork.llm import media


def test_round_trip_and_digests(spark):
    rows = [(1, None), (2, ""), (3, "x"), (4, "é" * 500), (5, "long text " * 200000), (6, "x" * 192), (7, "x")]
    encoded = media.encode_media(documents(spark, rows).withColumn("media", F.lit(1)))
    got = {r.doc_id: r for r in media.media_features(encoded).collect()}
    for d, t in rows:
        raw = (t or "").encode()
        payload = raw + b" " * (-len(raw) % 192 if raw else 192)
        r = got[d]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert r.tail_crc32 == zlib.crc32(payload[-16:]) and r.fault is None and len(r.hash) == 8
    assert got[3].media == got[7].media and got[3].hash == got[7].hash
    assert got[1].media == got[2].media
    assert media.media_features(encoded.limit(0)).count() == 0


def filtered(rows, filters, step):
    """PNG filters applied byte by byte."""
    out = []
    height, width = rows.shape
    at = lambda y, x: int(rows[y, x]) if y >= 0 and x >= 0 else 0
    for y in range(height):
        line = [filters[y]]
        for x in range(width):
            a, b, c = at(y, x - step), at(y - 1, x), at(y - 1, x - step)
            p = a + b - c
            pa, pb, pc = abs(p - a), abs(p - b), abs(p - c)
            paeth = a if pa <= pb and pa <= pc else b if pb <= pc else c
            line.append((int(rows[y, x]) - [0, a, b, (a + b) // 2, paeth][filters[y]]) % 256)
        out.append(line)
    return np.array(out, dtype=np.uint8)


def png(lines, width, height, colour):
    head = struct.pack(">IIBBBBB", width, height, 8, colour, 0, 0, 0)
    half = zlib.compress(lines.tobytes())
    return media.SIGNATURE + media._chunk(b"IHDR", head) + media._chunk(b"IDAT", half[:7]) + media._chunk(b"IDAT", half[7:]) + media._chunk(b"IEND", b"")


@pytest.mark.parametrize("colour,step", [(0, 1), (2, 3), (4, 2), (6, 4)])
@pytest.mark.parametrize("kinds", [[0], [1, 2], [3], [4], [0, 1, 2, 3, 4]])
def test_all_filters(colour, step, kinds):
    r = np.random.default_rng(step)
    rows = r.integers(0, 256, (9, 7 * step), dtype=np.uint8)
    filters = [kinds[y % len(kinds)] for y in range(9)]
    flat = rows[:4].copy()
    images = [png(filtered(rows, filters, step), 7, 9, colour), png(filtered(flat, filters[:4], step), 7, 4, colour)]
    (got, samples), (second, _) = media.decode_pngs(images)
    assert samples == step and (got == rows).all() and (second == flat).all()


def test_damage_is_found(spark):
    (good,) = media.encode_pngs([media.padded(b"hello")])
    cut, flipped = good[:-5], good[:45] + bytes([good[45] ^ 1]) + good[46:]
    df = spark.createDataFrame([(1, good), (2, cut), (3, flipped), (4, b"GIF89a"), (5, None)], "doc_id long, media binary")
    got = {r.doc_id: r.fault for r in media.media_features(df).collect()}
    assert got[1] is None and all(got[i] for i in (2, 3, 4, 5)) and "checksum" in got[3]


def test_hash_matches_a_plain_transform():
    rows = np.random.default_rng(4).integers(0, 256, (64, 192), dtype=np.uint8)
    grey = rows.reshape(64, 64, 3).mean(axis=2)
    small = grey.reshape(32, 2, 32, 2).mean(axis=(1, 3))
    low = np.array([[sum(small[y, x] * np.cos(np.pi * u * (2 * y + 1) / 64) * np.cos(np.pi * v * (2 * x + 1) / 64) for y in range(32) for x in range(32)) for v in range(8)] for u in range(8)]).ravel()
    low[0] = 0
    assert media.cosine_hash(rows, 3) == np.packbits(low > np.median(low)).tobytes()


def test_near_images_have_near_hashes():
    base = np.random.default_rng(5).integers(0, 256, (60, 192), dtype=np.uint8)
    near = base.copy()
    near[3, 5] ^= 8
    a, b = (int.from_bytes(media.cosine_hash(x, 3)) for x in (base, near))
    assert (a ^ b).bit_count() <= 4


def test_stored_rows_are_filtered():
    text = media.padded(("The quick brown fox, " * 40 + "ABAB" * 300).encode())
    (stored,) = media.encode_pngs([text])
    lines, _ = media.read_png(stored)
    assert set(lines[:, 0].tolist()) - {0}
    assert media.decode_pngs([stored])[0][0].tobytes() == text
    together = media.encode_pngs([text, media.padded(b""), text[:192]])
    assert together == [stored, *media.encode_pngs([media.padded(b"")]), *media.encode_pngs([text[:192]])]
    noise = np.random.default_rng(1).integers(0, 256, 192 * 60, dtype=np.uint8).tobytes()
    smooth = np.cumsum(np.ones((60, 192)), axis=0).astype(np.uint8).tobytes()
    for payload in (noise, smooth, b"x" * 192):
        assert media.decode_pngs(media.encode_pngs([payload]))[0][0].tobytes() == payload


def odd_image(head=None, body=None, order=(b"IHDR", b"IDAT", b"IEND")):
    parts = {b"IHDR": struct.pack(">IIBBBBB", 2, 1, 8, 0, 0, 0, 0) if head is None else head, b"IDAT": zlib.compress(b"\0ab") if body is None else body, b"IEND": b""}
    return media.SIGNATURE + b"".join(media._chunk(k, parts[k]) for k in order)


def test_odd_images_have_a_fault():
    head = lambda *x: struct.pack(">IIBBBBB", *x)
    assert not isinstance(media.decode_pngs([odd_image()])[0], str)
    odd = [
        odd_image(head=b"abc"), odd_image(head=b""), odd_image(head=head(0, 1, 8, 0, 0, 0, 0), body=zlib.compress(b"\0")), odd_image(head=head(2, 0, 8, 0, 0, 0, 0), body=zlib.compress(b"")),
        odd_image(head=head(2**31, 2**31, 8, 0, 0, 0, 0)), odd_image(head=head(2, 1, 16, 0, 0, 0, 0)), odd_image(head=head(2, 1, 8, 3, 0, 0, 0)), odd_image(head=head(2, 1, 8, 0, 1, 0, 0)),
        odd_image(body=b""), odd_image(body=b"junk"), odd_image(body=zlib.compress(b"\0" * 10**7)), odd_image(body=zlib.compress(b"\0a")), odd_image(body=zlib.compress(b"\x05ab")),
        odd_image(body=zlib.compress(b"\0ab")[:-3]), odd_image(order=(b"IDAT", b"IHDR", b"IEND")), odd_image(order=(b"IHDR", b"IHDR", b"IDAT", b"IEND")), odd_image(order=(b"IHDR", b"IDAT")),
        odd_image(order=(b"IEND",)), b"", media.SIGNATURE, media.SIGNATURE + b"\xff" * 20,
    ]
    assert all(isinstance(x, str) for x in media.decode_pngs(odd))


def test_fuzzed_images_never_raise():
    r = np.random.default_rng(8)
    (good,) = media.encode_pngs([media.padded(b"some text " * 60)])
    images = []
    for _ in range(400):
        data = bytearray(good)
        for _ in range(int(r.integers(1, 4))):
            data[int(r.integers(0, len(data)))] = int(r.integers(0, 256))
        images.append(bytes(data[: int(r.integers(0, len(data) + 1))]) if r.random() < 0.3 else bytes(data))
    for _ in range(200):  # damage under right checksums
        head = bytearray(struct.pack(">IIBBBBB", 2, 1, 8, 0, 0, 0, 0))
        head[int(r.integers(0, 13))] = int(r.integers(0, 256))
        images.append(odd_image(head=bytes(head[: int(r.integers(8, 14))]), body=zlib.compress(r.bytes(int(r.integers(0, 12))))))
    for found in media.decode_pngs(images):
        assert isinstance(found, str) or media.cosine_hash(*found)


def test_repeated_rows_and_clashing_names(spark):
    docs = documents(spark, [(1, "same"), (1, "same"), (None, None)]).withColumn("hash", F.lit(1)).withColumn("n_bytes", F.lit("x"))
    got = media.media_features(media.encode_media(docs).withColumn("fault", F.lit("old"))).collect()
    assert len(got) == 3 and {r.fault for r in got} == {None} and len({r.payload_sha256 for r in got if r.doc_id == 1}) == 1
