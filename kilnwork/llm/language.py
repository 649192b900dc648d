"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kilnwork.llm.batches import BLOCK_CHARS, codepoints, letters, text_blocks
from kilnwork.llm.sampling import bounded_sample, held_out
from kilnwork.plans.stored import stored

#: Lengths of the n-grams; all share one table of 2**BITS hashed cells.
GRAMS = (1, 2, 3)
BITS = 16
#: Log probabilities are kept as integers of this fraction, so that sums don't depend on their order.
FRACTION = 4096
#: Labelled rows that a model is fitted on, in all languages together.
SAMPLE_ROWS = 8_000
UNDETERMINED = "und"
#: Numbers of a table at most: with more than 1,024 languages the cells get coarser, by powers of two.
TABLE_SIZE = 1 << 26


@dataclass
class LanguageModel:
    """``table``: int32 log probabilities, a row for each cell and a column for each language.

    ``shift`` is how many of a cell's low bits the table leaves out.
    """

    languages: list[str]
    table: np.ndarray
    shift: int = 0


def _grams(texts: list[str]):
    """Cells of all n-grams by length, where each text's start, and its number of letters.

    What lies after a text is spaces, whatever text comes next.
    """
    flat, starts = codepoints([t.lower() for t in texts], pad=max(GRAMS))
    after = np.concatenate([starts[1:], [len(flat)]])[:, None] - 1 - np.arange(max(GRAMS))
    letter = letters()[flat]
    counts = np.add.reduceat(letter.astype(np.int64), starts)
    char = np.where(letter, flat, np.uint32(32)).astype(np.uint32)
    cells, mixed, blank = [], np.zeros(len(char), dtype=np.uint32), 0
    with np.errstate(over="ignore"):
        for n in range(1, max(GRAMS) + 1):
            mixed = mixed * np.uint32(0x01000193)
            mixed[: len(char) - n + 1] += char[n - 1 :] * np.uint32(0x9E3779B1)
            if n in GRAMS:
                mixed_in = mixed.copy()
                mixed_in[after] = blank = np.uint32((int(blank) * 0x01000193 + 32 * 0x9E3779B1) % 2**32)
                salted = (mixed_in ^ np.uint32(n * 0x3C6EF372)) * np.uint32(0x85EBCA6B)
                cells.append((salted ^ (salted >> np.uint32(15))) * np.uint32(0xC2B2AE35) >> np.uint32(32 - BITS))
    return cells, starts, counts


def _count_cells(label: str):
    def count(batches):
        found: dict[str, np.ndarray] = {}
        for batch, texts in text_blocks(batches):
            labels = batch.column(label).to_pylist()
            for lang in set(labels):
                own = found.setdefault(lang, np.zeros(1 << BITS, dtype=np.int64))
                cells, _, _ = _grams([t for t, x in zip(texts, labels, strict=True) if x == lang])
                for c in cells:
                    own += np.bincount(c, minlength=1 << BITS)
        for lang, counts in found.items():
            cell = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(cell), pa.string()), pa.array(cell), pa.array(counts[cell])], ["lang", "cell", "n"])

    return count


def fit_language(rows: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", sample_rows: int = SAMPLE_ROWS) -> LanguageModel:
    """Fit on about ``sample_rows`` labelled rows, the languages evenly.

    Rows that agree in id, language and text count once. Cell counts are summed
    by Spark; the driver gets TABLE_SIZE numbers at most, 2**BITS a language
    unless there are more than 1,024 languages. Rows with a null text, language or id teach nothing; without any
    row left, the model knows no language and every text is undetermined.
    """
    named = rows.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.col(id_col).alias("key"))
    sample = stored(bounded_sample(named, "lang", ["key", "text"], sample_rows).select("text", "lang"))
    languages = sorted(r.lang for r in sample.select("lang").distinct().collect())
    shift = max(0, int(np.ceil(np.log2(max(1, len(languages)) * (1 << BITS) / TABLE_SIZE))))
    counted = sample.mapInArrow(_count_cells("lang"), "lang string, cell long, n long")
    found = counted.groupBy("lang", F.shiftright("cell", shift).alias("cell")).agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros((1 << (BITS - shift), len(languages)))
    if languages:
        at = np.searchsorted(np.array(languages, dtype=object), np.array(found.column("lang").to_pylist(), dtype=object))
        counts[found.column("cell").to_numpy(), at] = found.column("n").to_numpy()
    smooth = counts + 0.5
    return LanguageModel(languages, np.rint(np.log(smooth / smooth.sum(axis=0)) * FRACTION).astype(np.int32), shift)


def score_texts(model: LanguageModel, texts: list[str]) -> tuple[list[str], np.ndarray]:
    """Best language of each text and its posterior probability, languages alike beforehand."""
    if not model.languages or not texts:
        return [UNDETERMINED] * len(texts), np.zeros(len(texts))
    cells, starts, counts = _grams(texts)
    total = np.zeros((len(texts), len(model.languages)), dtype=np.int64)
    for c in cells:
        for lo in range(0, len(c), BLOCK_CHARS):
            hi = min(len(c), lo + BLOCK_CHARS)
            first = int(np.searchsorted(starts, lo, side="right")) - 1
            last = int(np.searchsorted(starts, hi, side="left"))
            cuts = np.maximum(starts[first:last], lo) - lo
            total[first:last] += np.add.reduceat(model.table[c[lo:hi] >> model.shift], cuts, axis=0, dtype=np.int64)
    best = total.argmax(axis=1)
    gap = (total - total.max(axis=1, keepdims=True)) / FRACTION
    score = 1.0 / np.exp(gap).sum(axis=1)
    known = counts > 0
    return [model.languages[b] if k else UNDETERMINED for b, k in zip(best, known, strict=True)], np.where(known, score, 0.0)


def identify(docs: DataFrame, model: LanguageModel, text_col: str = "text", carry: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The columns ``carry`` of each row with ``lang_pred`` and ``score``, from the text alone.

    ``lang_pred`` is a language of the model, or ``und`` with score 0 where the
    text is null or has no letter. Whole texts are read, in blocks of bounded
    size. The model is broadcast: 2**BITS numbers a language. Columns that are
    not carried are ignored; carried ones named like a result are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    carried = [c for c in carry if c not in ("lang_pred", "score")]

    def score(batches):
        for batch, texts in text_blocks(batches, "__text"):
            langs, scores = score_texts(shared.value, [t or "" for t in texts])
            columns = [*[batch.column(c) for c in carried], pa.array(langs, pa.string()), pa.array(scores)]
            yield pa.RecordBatch.from_arrays(columns, [*carried, "lang_pred", "score"])

    kinds = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in carried)
    slim = docs.select(*[F.col(c) for c in carried], F.col(text_col).alias("__text"))
    return slim.mapInArrow(score, f"{kinds}lang_pred string, score double")


def identify_documents(docs: DataFrame, sample_rows: int = SAMPLE_ROWS, carry: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Fit on the rows outside the held-out quarter and predict every row of ``docs``."""
    model = fit_language(docs.filter(~held_out(F.col("doc_id"), 4, 2)), sample_rows=sample_rows)
    return identify(docs, model, carry=carry).withColumn("held_out", held_out(F.col("doc_id"), 4, 2))
