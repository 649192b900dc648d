"""Toxicity: noisy-channel deobfuscation under a character language model, then scoring of the restored text."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kilnwork.llm.batches import WORD, codepoints, kinds, letters, text_blocks, tokens
from kilnwork.llm.network import sigmoid
from kilnwork.llm.sampling import bounded_sample, held_out
from kilnwork.plans.stored import stored

#: Characters of the language model; 0 stands for a word boundary and the last code for any other letter.
ALPHABET = "abcdefghijklmnopqrstuvwxyzàâäáãåæçéèêëíìîïñóòôöõøœúùûüýÿß"
SIZE = 64
OTHER_LETTER = SIZE - 1
#: Letters that a sign may stand for.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e",
}
SIGNS = "".join(map(re.escape, LEET))
#: What the channel charges, in nats: a sign for a letter, a sign for itself, a repeat dropped; one of a stretch's
#: narrowest gaps dropped or kept, and the other way round for its wider gaps. An exclamation mark at the end stands for itself cheaply.
SIGN_COST, KEEP_COST, REPEAT_COST, GAP_COST, GAP_KEPT_COST, SHOUT_COST = 1.0, 7.0, 0.7, 0.3, 3.0, 2.0
#: Characters after which the decoder writes out what all readings that are still possible agree on.
AGREED = 512
#: Longest stretch whose reading is kept for the next time.
KEPT_CHARS = 200
#: Characters that are worked on at once.
BLOCK_CHARS = 1 << 18
#: Decoded stretches that a task keeps.
KEPT = 200_000

TOKEN = rf"(?:[^\W_]|[{SIGNS}])"
GAP_SIGN = rf"(?:(?![{SIGNS}])[\W_])"
#: Single characters with gaps between them, runs of letters, digits and signs, and letters with repeats.
SPACED = re.compile(rf"(?<![^\W_])(?<![{SIGNS}]){TOKEN}(?:{GAP_SIGN}++{TOKEN}(?!{TOKEN})){{2,}}+")
RUN = re.compile(rf"{TOKEN}++")
GAP = re.compile(rf"{GAP_SIGN}++")
REPEATED = re.compile(r"[^\W\d_]++")
TRIPLE = re.compile(r"(.)\1\1|(.)\2(.)\3(.)\4")

#: Labelled rows that the word scores and the last step are fitted on.
SAMPLE_ROWS = 8_000
#: Lengths of the word heads that are scored besides the word.
HEADS = (4, 5)
STEPS = (1.0, 2.5, 4.0)
#: Parts of the sample, each of which is scored by the words of the others when the last step is fitted.
FOLDS = 3


@cache
def codes() -> np.ndarray:
    """The language model's code of each code point."""
    out = np.where(letters(), OTHER_LETTER, 0).astype(np.int32)
    for i, c in enumerate(ALPHABET):
        out[ord(c)] = i + 1
    return out


@cache
def _marks() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each code point, whether it is one of SIGNS, a TOKEN, and a letter as REPEATED sees it."""
    sign = np.zeros(0x110000, dtype=bool)
    sign[[ord(c) for c in LEET]] = True
    digit = np.fromiter((chr(i).isdecimal() for i in range(0x110000)), dtype=bool, count=0x110000)
    word = np.fromiter((chr(i).isalnum() for i in range(0x110000)), dtype=bool, count=0x110000)
    return sign, word | sign, word & ~digit


def _mixed(stretch: str) -> bool:
    """Whether letters and signs meet in a stretch."""
    return any(c in LEET for c in stretch) and any(c.isalpha() for c in stretch)


def count_trigrams(batches):
    """Counts of character trigrams; what lies between two words, or around a text, is two boundaries."""
    total = np.zeros(SIZE**3, dtype=np.int64)
    for _, texts in text_blocks(batches, chars=BLOCK_CHARS):
        flat, _ = codepoints([(t or "").lower() for t in texts], pad=1)
        code = codes()[flat]
        code = code[(code > 0) | (np.roll(code, 1) > 0)]
        code = np.concatenate([[0, 0], np.repeat(code, np.where(code > 0, 1, 2))])
        total += np.bincount(code[:-2] << 12 | code[1:-1] << 6 | code[2:], minlength=SIZE**3)
    seen = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["cell", "n"])


def fit_characters(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Log probability of a character after two others, from the texts of all rows.

    Counts are summed by Spark; the driver gets at most 64**3 of them.
    """
    slim = docs.select(F.col(text_col).alias("text")).filter("text is not null")
    found = slim.mapInArrow(count_trigrams, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    three = np.zeros(SIZE**3)
    three[found.column("cell").to_numpy()] = found.column("n").to_numpy()
    three = three.reshape(SIZE, SIZE, SIZE)
    two = three.sum(axis=0)
    after_two = (three + 1e-9) / (three.sum(axis=2, keepdims=True) + SIZE * 1e-9)
    after_one = (two + 0.1) / (two.sum(axis=1, keepdims=True) + 0.1 * SIZE)
    return np.log(0.75 * after_two + 0.24 * after_one[None, :, :] + 0.01 / SIZE)


@dataclass
class Decoder:
    """Restores obfuscated stretches of a text under a character model."""

    model: np.ndarray
    kept: dict[str, str] = field(default_factory=dict)

    def lattice(self, stretch: str) -> Iterator[list[tuple[str, int, float]]]:
        """For each character its readings: what is written, its code (-1: nothing), and the channel's charge."""
        narrow = min((m.end() - m.start() for m in GAP.finditer(stretch)), default=1)
        shout = len(stretch.rstrip("!"))
        run, last, gap_end = 0, "", 0
        for i, c in enumerate(stretch):
            run = run + 1 if c == last else 1
            if c.isalpha():
                readings = [(c, int(codes()[ord(c)]), 0.0)]
                if run > 1:
                    readings.append(("", -1, REPEAT_COST if run == 2 else 0.0))
            elif c in LEET:
                kept = SHOUT_COST if i >= shout else KEEP_COST
                readings = [(x, int(codes()[ord(x)]), SIGN_COST) for x in LEET[c]] + [(c, 0, kept)]
                if run > 1:
                    readings.append(("", -1, REPEAT_COST))
            elif i < gap_end:
                readings = [("", -1, 0.0)]
            elif gap := GAP.match(stretch, i):
                gap_end = gap.end()
                drop, keep = (GAP_KEPT_COST, GAP_COST) if gap_end - i > narrow else (GAP_COST, GAP_KEPT_COST)
                readings = [("", -1, drop), (" ", 0, keep)]
            else:
                readings = [(c, 0, 0.0)]
            last = c
            yield readings

    def viterbi(self, stretch: str) -> str:
        """The likeliest reading of the whole stretch; the states are the last two characters read.

        Every AGREED characters, what all surviving readings have in common is
        written out and its back pointers go.
        """
        model = self.model
        best: dict[tuple[int, int], tuple[float, list | None]] = {(0, 0): (0.0, None)}
        out: list[str] = []
        for place, readings in enumerate(self.lattice(stretch), start=1):
            following: dict[tuple[int, int], tuple[float, list | None]] = {}
            for (a, b), (score, path) in best.items():
                for written, code, cost in readings:
                    if code < 0:
                        state, value = (a, b), score - cost
                    elif code == 0 and b == 0:
                        state, value = (a, b), score - cost
                    else:
                        state, value = (b, code) if code else (0, 0), score - cost + model[a, b, code]
                    if state not in following or value > following[state][0]:
                        following[state] = (value, [written, path])
            best = following
            if place % AGREED == 0:
                self._write_agreed([p for _, p in best.values()], out)
        _, path = max(((s + (model[a, b, 0] if b else 0.0), p) for (a, b), (s, p) in best.items()), key=lambda x: x[0])
        return "".join([*out, *self._written(path)])

    @staticmethod
    def _written(path: list | None) -> list[str]:
        found = []
        while path is not None:
            found.append(path[0])
            path = path[1]
        return found[::-1]

    def _write_agreed(self, paths: list[list | None], out: list[str]) -> None:
        """Move the common beginning of ``paths``, which are of one length, to ``out``."""
        while paths[0] is not None and any(p is not paths[0] for p in paths):
            paths = list({id(p[1]): p[1] for p in paths}.values())
        if paths[0] is not None:
            out += self._written(paths[0])
            paths[0][:] = ["", None]

    def read(self, stretch: str) -> str:
        found = self.kept.get(stretch)
        if found is None:
            found = self.viterbi(stretch)
            if len(stretch) <= KEPT_CHARS:
                if len(self.kept) > KEPT:
                    self.kept.clear()
                self.kept[stretch] = found
        return found

    def restore(self, text: str) -> str:
        """A lower-cased text with spacing, signs and repeats undone where the model likes the outcome better."""
        text = SPACED.sub(lambda m: self.read(m.group()) if any(c.isalpha() for c in m.group()) else m.group(), text)
        text = RUN.sub(lambda m: self.read(m.group()) if _mixed(m.group()) else m.group(), text)
        if TRIPLE.search(text):
            text = REPEATED.sub(lambda m: self.read(m.group()) if TRIPLE.search(m.group()) else m.group(), text)
        return text

    def restore_all(self, texts: list[str | None]) -> list[str]:
        """Lower-cased and restored texts. Only texts with a place that ``restore`` may change are gone through."""
        low = [(t or "").lower() for t in texts]
        flat, starts = codepoints(low, pad=6)
        sign, token, letter = (m[flat] for m in _marks())
        odd = np.zeros(len(flat), dtype=bool)
        twice = letter[:-1] & (flat[:-1] == flat[1:])
        odd[:-2] |= twice[:-1] & twice[1:]
        odd[:-5] |= twice[:-4] & twice[2:-2] & twice[4:]
        edges = np.flatnonzero(np.diff(token, prepend=False, append=False))
        begin, end = edges[::2], edges[1::2]
        if len(begin):
            signs = np.concatenate([[0], np.cumsum(sign)])
            alphas = np.concatenate([[0], np.cumsum(letters()[flat])])
            odd[begin] |= (signs[end] > signs[begin]) & (alphas[end] > alphas[begin])
            single = (end - begin) == 1
            of = np.searchsorted(starts, begin, side="right")
            three = single[:-2] & single[1:-1] & single[2:] & (of[:-2] == of[2:])
            odd[begin[:-2]] |= three
        for i in np.flatnonzero(np.add.reduceat(odd.astype(np.int64), starts) if len(starts) else []).tolist():
            low[i] = self.restore(low[i])
        return low


@dataclass
class ToxicityModel:
    """``keys``: sorted word and head hashes; ``values``: their scores; ``weights``: of the last step."""

    characters: np.ndarray
    keys: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.uint32))
    values: np.ndarray = field(default_factory=lambda: np.zeros(0))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(len(STEPS) + 3))

    def word_scores(self, hashes: np.ndarray) -> np.ndarray:
        out = np.zeros(len(hashes))
        if len(self.keys):
            marked = np.zeros(1 << 16, dtype=bool)
            marked[self.keys >> np.uint32(16)] = True
            may = np.flatnonzero(marked[hashes >> np.uint32(16)])
            at = np.minimum(np.searchsorted(self.keys, hashes[may]), len(self.keys) - 1)
            out[may] = np.where(self.keys[at] == hashes[may], self.values[at], 0.0)
        return out

    def features(self, texts: list[str]) -> np.ndarray:
        """Of each restored text the highest word score, the logarithm of how many words pass each step, and the mean of scores beyond the first step over all words."""
        out = np.zeros((len(texts), len(STEPS) + 2))
        hashes, counts = word_hashes(texts)
        full = np.flatnonzero(counts)
        if len(full):
            starts = (np.cumsum(counts) - counts)[full]
            score = np.max([self.word_scores(h) for h in hashes], axis=0)
            out[full, 0] = np.maximum.reduceat(score, starts)
            for k, step in enumerate(STEPS):
                out[full, k + 1] = np.log1p(np.add.reduceat((score > step).astype(np.int64), starts))
            out[full, -1] = np.add.reduceat(np.where(score > STEPS[0], score, 0.0), starts) / counts[full]
        return out

    def predict(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(np.einsum("ij,j->i", x, self.weights[1:]) + self.weights[0])


def word_hashes(texts: list[str]) -> tuple[list[np.ndarray], np.ndarray]:
    """Hashes of the words and of their heads, and how many words each text has."""
    flat, starts = codepoints(texts, pad=1)
    at, kind, *hashes = tokens(flat, kinds(), HEADS)
    words = kind == WORD
    counts = np.diff(np.searchsorted(at[words], starts), append=int(words.sum()))
    with np.errstate(over="ignore"):
        salted = [h[words] * np.uint32(2 * k + 3) ^ np.uint32(k * 0x5BD1E995 & 0xFFFFFFFF) for k, h in enumerate(hashes)]
    return salted, counts


def fit_logistic(x: np.ndarray, y: np.ndarray, rounds: int = 100, ridge: float = 0.1) -> np.ndarray:
    """Weights, the bias first and the others not negative, by Newton steps."""
    full = np.concatenate([np.ones((len(x), 1)), x], axis=1)
    w = np.zeros(full.shape[1])
    for _ in range(rounds):
        p = sigmoid(full @ w)
        hessian = (full * (p * (1 - p))[:, None]).T @ full + ridge * np.eye(len(w))
        step = np.linalg.solve(hessian, full.T @ (y - p) - ridge * w)
        w += np.clip(step, -2, 2)
        w[1:] = np.maximum(w[1:], 0)  # more evidence never lowers a score
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit_toxicity(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, min_docs: int = 3) -> ToxicityModel:
    """Fit on about ``sample_rows`` labelled documents outside the held-out third.

    Of rows that share a doc_id the least text counts, so that the sample stays
    bounded whatever is repeated; rows of a null doc_id teach nothing but
    characters. The character model takes all of ``docs``. Words and heads are
    counted by document; those in at least ``min_docs`` toxic documents score
    the lower bound of their log odds. The last step, logistic over the
    features of a document, is fitted on all of the sample: each third of it
    by the words of the other two. The driver gets the counts of such words by
    third, which the sample bounds, and a row of features a sampled document.
    Without both labels every score is 0.5.
    """
    characters = fit_characters(docs)
    outside = labels.filter(~held_out(F.col("doc_id"), 3, 1)).groupBy("doc_id").agg(F.max("toxic").alias("label"))
    drawn = bounded_sample(outside.filter("label in (0, 1)"), "label", ["doc_id"], sample_rows)
    part = F.pmod(F.xxhash64(F.lit("part"), "doc_id"), F.lit(FOLDS)).cast("int").alias("fold")
    shared = docs.sparkSession.sparkContext.broadcast(characters)
    rows = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("label").cast("double").alias("label")).select("text", "label", part)
    rows = rows.repartition(docs.sparkSession.sparkContext.defaultParallelism)  # a bounded sample: few tasks in Python, however many scan docs

    def restore(batches):
        decoder = Decoder(shared.value)
        for batch, texts in text_blocks(batches, chars=BLOCK_CHARS):
            restored = pa.array(decoder.restore_all(texts), pa.string())
            yield pa.RecordBatch.from_arrays([restored, batch.column("label"), batch.column("fold")], ["text", "label", "fold"])

    def count(batches):
        for batch, texts in text_blocks(batches, chars=BLOCK_CHARS):
            hashes, counts = word_hashes(texts)
            doc = np.repeat(np.arange(len(texts)), counts)
            toxic, fold = batch.column("label").to_numpy(), batch.column("fold").to_numpy()
            found = []
            for h in hashes:
                pairs = np.unique(doc.astype(np.int64) << 32 | h)
                found.append(pairs)
            pairs = np.concatenate(found)
            cell, own = pairs & 0xFFFFFFFF | fold[pairs >> 32].astype(np.int64) << 32, toxic[pairs >> 32].astype(np.int64)
            cells, at = np.unique(cell, return_inverse=True)
            n = np.bincount(at, minlength=len(cells))
            t = np.bincount(at, weights=own, minlength=len(cells)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(cells & 0xFFFFFFFF), pa.array(cells >> 32), pa.array(t), pa.array(n - t)], ["cell", "fold", "t", "c"])

    rows = stored(rows.mapInArrow(restore, "text string, label double, fold int"))  # so that a task runs one Python worker at a time
    sizes = np.zeros((FOLDS, 2), dtype=np.int64)
    for r in rows.groupBy("fold", "label").agg(F.count("*").alias("n")).collect():
        sizes[r.fold, int(r.label)] = r.n
    if not sizes.sum(axis=0).all():
        return ToxicityModel(characters)
    by_fold = lambda c: [F.sum(F.when(F.col("fold") == k, F.col(c)).otherwise(0)).alias(f"{c}{k}") for k in range(FOLDS)]
    counted = rows.mapInArrow(count, "cell long, fold long, t long, c long").groupBy("cell").agg(F.sum("t").alias("t"), *by_fold("t"), *by_fold("c"))
    found = counted.filter(f"t >= {int(min_docs)}").orderBy("cell").toArrow()
    cell = found.column("cell").to_numpy().astype(np.uint32)
    t, c = (np.stack([found.column(f"{x}{k}").to_numpy() for k in range(FOLDS)]) for x in "tc")

    def word_model(parts: list[int]) -> ToxicityModel:
        toxic, clean = t[parts].sum(axis=0), c[parts].sum(axis=0)
        n_clean, n_toxic = sizes[parts].sum(axis=0)
        odds = np.log((toxic + 0.5) / (n_toxic + 1)) - np.log((clean + 0.5) / (n_clean + 1)) - 1.5 * np.sqrt(1 / (toxic + 0.5) + 1 / (clean + 0.5))
        used = (odds > 0.5) & (toxic >= min_docs)
        return ToxicityModel(characters, cell[used], odds[used])

    model = word_model(list(range(FOLDS)))
    others = docs.sparkSession.sparkContext.broadcast([word_model([j for j in range(FOLDS) if j != k]) for k in range(FOLDS)])

    def features(batches):
        for batch, texts in text_blocks(batches, chars=BLOCK_CHARS):
            fold = batch.column("fold").to_numpy()
            x = np.zeros((len(texts), len(STEPS) + 2))
            for k in np.unique(fold):
                own = np.flatnonzero(fold == k)
                x[own] = others.value[k].features([texts[i] for i in own])
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(list(x), pa.list_(pa.float64()))], ["label", "x"])

    rest = rows.mapInArrow(features, "label double, x array<double>").toArrow()
    y = rest.column("label").to_numpy()
    x = np.array(rest.column("x").to_pylist()).reshape(len(y), len(STEPS) + 2)
    order = np.lexsort([*x.T[::-1], y])
    model.weights = fit_logistic(x[order], y[order])
    return model


def score_toxicity(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, restored, score`` of whole texts: the restored text and its probability of label 1.

    Null and empty texts are restored to '' and scored without words. Every row
    is scored, rows of a null id and repeated rows each by themselves; other
    columns are ignored, whatever they are called. The model is broadcast; its size is bounded by the sample it was fitted on.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches):
        decoder = Decoder(shared.value.characters)
        for batch, texts in text_blocks(batches, chars=BLOCK_CHARS):
            restored = decoder.restore_all(texts)
            scores = shared.value.predict(shared.value.features(restored))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(restored, pa.string()), pa.array(scores)], ["doc_id", "restored", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return slim.mapInArrow(score, f"doc_id {kind}, restored string, score double")
