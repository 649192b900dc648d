"""Packed sequences against pieces cut one document at a time, and the ids against the tokenizers library."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from plain import documents
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from kilnwork.llm import packing
from kilnwork.llm.queries import op12_packing, word_vocabulary


def cut(n, context):
    """Start and length of each piece of ``n`` ids."""
    out, start = [], 0
    while n - start >= context:
        out.append((start, context))
        start += context
    for bit in reversed(range(context.bit_length() - 1)):
        if (n - start) >> bit & 1:
            out.append((start, 1 << bit))
            start += 1 << bit
    return out


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(word_vocabulary())
    t.no_truncation(), t.no_padding()
    return lambda text: t.encode(text or "", add_special_tokens=False).ids + [2]


def pieces(packed):
    return [(r.doc_id, r.start, r.length, np.frombuffer(r.ids, dtype="<u4").tolist(), r.doc_tokens) for r in packed.collect()]


@pytest.mark.parametrize("context", [1, 2, 8, 4096])
def test_pieces_are_binary(context):
    sizes = np.array([1, 2, 3, 4095, 4096, 4097, 8191, 8192, 100_000, 1, *range(1, 40)])
    document, start, length = packing.binary_pieces(sizes, context)
    want = [(i, *p) for i, n in enumerate(sizes.tolist()) for p in cut(n, context)]
    assert list(zip(document.tolist(), start.tolist(), length.tolist(), strict=True)) == want
    assert all(len(x) == 0 for x in packing.binary_pieces(np.zeros(0, dtype=np.int64), context))


@pytest.mark.parametrize("context", [16, 4096])
def test_matches_plain(spark, library, context):
    r = random.Random(5)
    words = ["Hello,", "WORLD", "naïve", "x1y2", "don't", "…", "日本語", "<|endoftext|>", "\x1c", "á"]
    rows = [(i, " ".join(r.choice(words) for _ in range(r.randint(0, 60)))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "word " * 30_000), (None, "a b"), (103, "x" * 20_000), (7, "again"), (7, "again")]
    docs = documents(spark, rows).withColumn("length", F.lit("clash")).withColumn("ids", F.lit(1))
    got = packing.pack_documents(docs, word_vocabulary(), context=context)
    known = [(i, library(t)) for i, t in rows]
    want = [(i, s, n, ids[s : s + n], len(ids)) for i, ids in known for s, n in cut(len(ids), context)]
    assert sorted(pieces(got), key=str) == sorted(want, key=str)
    sequences = [x.sequence_id for x in got.collect()]
    assert len(set(sequences)) == len(sequences) and min(sequences) >= 0
    assert {(x.sequence_id >> (packing.LOCAL_BITS + packing.TASK_BITS), x.bucket, x.offset, 1 << x.bucket == x.length) for x in got.collect()} == {(b, b, 0, True) for b in {x.bucket for x in got.collect()}}


def test_the_query(spark, library):
    folder = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    parts = defaultdict(list)
    for r in op12_packing(spark, folder).collect():
        parts[r.doc_id].append(r)
    assert parts.keys() == texts.keys()
    for doc_id, found in parts.items():
        ids, at = library(texts[doc_id]), 0
        for r in sorted(found, key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids)) and r.length <= 4096
            at += r.length
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : at], dtype="<u4").tobytes())
        assert at == len(ids)


def test_buckets_on_disk(spark, tmp_path):
    packed = packing.pack_documents(documents(spark, [(1, "a b c"), (2, "d"), (3, None)]), word_vocabulary())
    packing.write_buckets(packed, str(tmp_path / "out"))
    assert sorted(p.name for p in (tmp_path / "out").glob("bucket=*")) == ["bucket=0", "bucket=1", "bucket=2"]
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3


def test_empty_and_wrong_context(spark):
    docs = documents(spark, [(1, "a")])
    assert packing.pack_documents(docs.limit(0), word_vocabulary()).count() == 0
    with pytest.raises(ValueError, match="power"):
        packing.pack_documents(docs, word_vocabulary(), context=48)
