"""Packing token ids into sequences by power-of-two decomposition: no sequence crosses documents, and none is padded."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kilnwork.llm.batches import text_blocks
from kilnwork.llm.bpe import BLOCK_CHARS, Encoder, load_vocabulary

#: Longest sequence, a power of two, and the id that ends a document.
CONTEXT, END = 4096, 2
#: Bits of a sequence number that count within a task and bucket, and that count tasks; the bucket stands above.
LOCAL_BITS, TASK_BITS = 34, 25


def binary_pieces(sizes: np.ndarray, context: int = CONTEXT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``document, start, length`` of the pieces of documents with so many ids, in order: whole contexts, then falling powers of two."""
    powers = context >> np.arange(1, int(context).bit_length())
    rest = (sizes[:, None] % context & powers[None, :]) > 0
    whole = sizes // context
    counts = whole + rest.sum(axis=1)
    document = np.repeat(np.arange(len(sizes)), counts)
    first = np.cumsum(counts) - counts
    at = np.arange(len(document)) - first[document]
    length = np.full(len(document), context, dtype=np.int64)
    length[at >= whole[document]] = np.broadcast_to(powers, rest.shape)[rest]
    total = np.cumsum(length) - length
    return document, total - total[first][document] if len(document) else total, length


def ended(flat: np.ndarray, sizes: np.ndarray, end: int) -> np.ndarray:
    """All ids with ``end`` after each document."""
    return np.insert(flat, np.cumsum(sizes), end)


def pack_documents(docs: DataFrame, vocabulary: str, context: int = CONTEXT, end: int = END, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, start, length, ids, doc_tokens, sequence_id, offset, bucket``, a row for each piece.

    A document's ids are those of its whole text and ``end``. They are cut into
    as many pieces of ``context`` ids as there are, and the rest into one piece
    for each binary digit of its length, longest first. Each piece is a
    sequence of its own (``offset`` 0) whose length is a power of two, so
    sequences need no padding and never cross documents. ``bucket`` is the
    logarithm of the length; sequences of a bucket are of one shape and follow
    each other in ``sequence_id``: batches are drawn bucket by bucket. ``ids``
    has the ids as little-endian unsigned 32-bit numbers.

    A sequence's number is made of its bucket, its task and its place among the
    task's sequences of that bucket, so nothing is shuffled or counted before.
    Numbers are unique, not dense, and depend on how the table is split.

    A null or empty text is ``end`` alone. Every row is packed, rows of a null
    id and repeated rows each by themselves. An empty table gives an empty
    result. Other columns are ignored, whatever they are called. Raises
    ValueError where ``context`` is no power of two.
    """
    if context < 1 or context & (context - 1):
        raise ValueError("context is no power of two")
    with open(vocabulary, encoding="utf-8") as f:
        shared = docs.sparkSession.sparkContext.broadcast(load_vocabulary(f.read()))

    def pack(batches):
        encoder = Encoder(shared.value)
        task = TaskContext.get().partitionId()
        used = np.zeros(context.bit_length(), dtype=np.int64)
        for batch, texts in text_blocks(batches, chars=BLOCK_CHARS):
            flat, sizes = encoder.encode([t or "" for t in texts])
            document, start, length = binary_pieces(sizes + 1, context)
            bucket = np.log2(length).astype(np.int64)
            number = np.empty(len(length), dtype=np.int64)
            for b in np.unique(bucket):
                mine = np.flatnonzero(bucket == b)
                number[mine] = used[b] + np.arange(len(mine))
                used[b] += len(mine)
            data = ended(flat, sizes, end).astype("<u4").tobytes()
            cuts = np.concatenate([[0], np.cumsum(length) * 4])
            ids = pa.Array.from_buffers(pa.large_binary(), len(length), [None, pa.py_buffer(cuts.astype(np.int64).tobytes()), pa.py_buffer(data)])
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id").take(pa.array(document)), pa.array(start), pa.array(length), ids.cast(pa.binary()), pa.array((sizes + 1)[document]),
                pa.array(bucket << (LOCAL_BITS + TASK_BITS) | task << LOCAL_BITS | number), pa.array(np.zeros(len(length), dtype=np.int64)), pa.array(bucket.astype(np.int32)),
            ], ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "bucket"])

    kind = docs.schema[id_col].dataType.simpleString()
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return slim.mapInArrow(pack, f"doc_id {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, bucket int")


def write_buckets(packed: DataFrame, path: str) -> None:
    """The sequences as Parquet, a folder for each bucket, so that a reader of one length scans that folder alone."""
    packed.write.partitionBy("bucket").parquet(path)
