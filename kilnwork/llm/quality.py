"""Quality classifier: random-indexing word vectors pooled per document, then a two-layer network."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kilnwork.llm.batches import bucket, codepoints, kinds, text_blocks, tokens
from kilnwork.llm.network import Network, fit_network
from kilnwork.llm.sampling import bounded_sample, held_out

#: Hashed words, the length of their vectors, and the ones in an index vector.
BITS, DIM, ONES = 14, 24, 3
#: Labelled rows that the network is fitted on.
SAMPLE_ROWS = 6_000


@dataclass
class QualityModel:
    vectors: np.ndarray
    network: Network


def drawn_ones() -> tuple[np.ndarray, np.ndarray]:
    """Place and sign of the ONES ones of each hashed word's index vector, from the word's number alone."""
    rows = np.arange(1 << BITS, dtype=np.uint32)
    drawn = np.stack([bucket(rows * np.uint32(ONES) + np.uint32(k + 1), 16) for k in range(ONES)], axis=1)
    return drawn % DIM, np.where(drawn & 0x8000, 1.0, -1.0)


def index_vectors() -> np.ndarray:
    """A sparse random vector of ones and minus ones for each hashed word."""
    out = np.zeros((1 << BITS, DIM), dtype=np.float32)
    places, signs = drawn_ones()
    for k in range(ONES):
        np.add.at(out, (np.arange(1 << BITS), places[:, k]), signs[:, k])
    return out


def words_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed words (runs of letters and digits, or of other signs) of all texts, and how many each text has."""
    flat, starts = codepoints(texts, pad=1)
    at, _, hashes = tokens(flat, kinds())
    return bucket(hashes, BITS), np.diff(np.searchsorted(at, starts), append=len(at))


def pool(vectors: np.ndarray, texts: list[str]) -> np.ndarray:
    """Features of each text: mean and spread of its word vectors, mean product of adjacent ones, log length."""
    ids, counts = words_of(texts)
    out = np.zeros((len(texts), 3 * DIM + 1))
    full = np.flatnonzero(counts)
    if len(full):
        starts = (np.cumsum(counts) - counts)[full]
        own = vectors[ids]
        after = np.zeros_like(own)
        after[:-1] = own[:-1] * own[1:]
        after[starts[1:] - 1] = 0
        n = counts[full][:, None]
        mean = np.add.reduceat(own, starts, axis=0) / n
        square = np.add.reduceat(own * own, starts, axis=0) / n
        out[full, :DIM] = mean
        out[full, DIM : 2 * DIM] = np.sqrt(np.maximum(square - mean * mean, 0))
        out[full, 2 * DIM : 3 * DIM] = np.add.reduceat(after, starts, axis=0) / n
    out[:, -1] = np.log1p(counts)
    return out


def _contexts(batches):
    """Each word's sum of the index vectors of its neighbours."""
    places, signs = drawn_ones()
    total = np.zeros((1 << BITS) * DIM)
    for _, texts in text_blocks(batches):
        ids, counts = words_of([t or "" for t in texts])
        inner = np.ones(len(ids), dtype=bool)
        inner[np.cumsum(counts)[counts > 0] - 1] = False
        left = np.flatnonzero(inner)
        a, b = ids[left], ids[left + 1]
        for word, near in ((a, b), (b, a)):
            for k in range(ONES):
                total += np.bincount(word * DIM + places[near, k], weights=signs[near, k], minlength=len(total))
    sums = total.astype(np.int64).reshape(-1, DIM)
    seen = np.flatnonzero(np.abs(sums).sum(axis=1))
    columns = [pa.array(seen), *[pa.array(sums[seen, d]) for d in range(DIM)]]
    yield pa.RecordBatch.from_arrays(columns, ["word", *[f"v{d}" for d in range(DIM)]])


def fit_vectors(docs: DataFrame) -> np.ndarray:
    """Word vectors from the contexts in all texts: 2**BITS sums, which Spark adds up."""
    shape = "word long, " + ", ".join(f"v{d} long" for d in range(DIM))
    summed = docs.select("text").mapInArrow(_contexts, shape).groupBy("word").agg(*[F.sum(f"v{d}").alias(f"v{d}") for d in range(DIM)]).toArrow()
    context = np.zeros((1 << BITS, DIM))
    if summed.num_rows:
        context[summed.column("word").to_numpy()] = np.stack([summed.column(f"v{d}").to_numpy() for d in range(DIM)], axis=1)
    context /= np.maximum(np.linalg.norm(context, axis=1, keepdims=True), 1e-6)
    return context.astype(np.float32) + 0.5 * index_vectors() / np.float32(ONES**0.5)


def fit_quality(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> QualityModel:
    """Word vectors of all ``docs``, and a network fitted on about ``sample_rows`` labelled documents outside the held-out quarter.

    Of rows that share a doc_id the least text counts, so that the sample stays
    bounded whatever is repeated; rows of a null doc_id teach contexts only. The
    sample of label rows is broadcast to the scan of docs. The driver gets
    2**BITS vectors and one row of features a sampled document. Without labels
    every score is 0.5.
    """
    vectors = fit_vectors(docs)
    outside = labels.filter(~held_out(F.col("doc_id"), 4, 2)).groupBy("doc_id").agg(F.max("quality").alias("label"))
    drawn = bounded_sample(outside.filter("label in (0, 1)"), "label", ["doc_id"], sample_rows)
    rows = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("label").cast("double").alias("label"))
    shared = docs.sparkSession.sparkContext.broadcast(vectors)

    def features(batches):
        for batch, texts in text_blocks(batches):
            x = pool(shared.value, [t or "" for t in texts])
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(list(x), pa.list_(pa.float64()))], ["label", "x"])

    found = rows.select("text", "label").mapInArrow(features, "label double, x array<double>").toArrow()
    y = found.column("label").to_numpy()
    x = np.array(found.column("x").to_pylist()).reshape(len(y), 3 * DIM + 1)
    order = np.lexsort([*x.T[::-1], y])  # rows come in any order
    if len(set(y.tolist())) < 2:
        flat = np.zeros(3 * DIM + 1)
        return QualityModel(vectors, Network(flat, flat + 1, np.zeros((3 * DIM + 1, 1)), np.zeros(1), np.zeros(1), 0.0))
    return QualityModel(vectors, fit_network(x[order], y[order]))


def score_quality(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score`` of whole texts: the probability of label 1.

    A null text counts as empty, and an empty text is scored from its length
    0. Every row is scored, rows of a null id and repeated rows each by
    themselves; other columns are ignored, whatever they are called. The model, a fixed number of vectors and weights, is broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches):
        for batch, texts in text_blocks(batches):
            scores = shared.value.network.predict(pool(shared.value.vectors, [t or "" for t in texts]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores)], ["doc_id", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return slim.mapInArrow(score, f"doc_id {kind}, score double")
