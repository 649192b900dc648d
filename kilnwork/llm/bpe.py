"""Byte-pair encoding and decoding in batched numpy merge rounds."""

from __future__ import annotations

import json
import re
import unicodedata
from collections import defaultdict
from dataclasses import dataclass
from functools import cached_property
from itertools import chain, count, islice
from string import punctuation

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kilnwork.llm.batches import text_blocks
from kilnwork.llm.unicode_versions import LATER_CAPITALS, LATER_LETTERS, LATER_MARKS, as_class, lower_map

#: Distinct words whose ids a task keeps, and how many ids these may have; beyond either it starts anew.
KEPT_WORDS, KEPT_IDS = 400_000, 4_000_000
#: Characters that are encoded at once: the more, the fewer stretches are looked up again.
BLOCK_CHARS = 1 << 21
#: Characters that Python splits at and the tokenizer file's patterns don't.
NO_SPACE = "\x1c\x1d\x1e\x1f"
#: White space as the tokenizer file's patterns see it: fixed values.
WHITE = r"\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Letters and numbers that are none to the vocabulary's own library.
LATER = as_class(LATER_LETTERS)
#: How the vocabulary's own file cuts lower-cased text into words: fixed values.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^" + WHITE + r"\p{L}\p{N}]+"
#: The same where later letters and numbers occur.
LATER_PIECES = r"(?V1)'s|'t|'re|'ve|'m|'ll|'d|[\p{L}--[" + LATER + r"]]+|[\p{N}--[" + LATER + r"]]|[^" + WHITE + r"[[\p{L}\p{N}]--[" + LATER + "]]]+"


#: Rank of a pair that nothing merges.
NONE = np.int32(2**31 - 1)


def byte_letters() -> list[str]:
    """The printable character that stands for each byte: itself if printable, else one from 256 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    out, more = [], 0
    for b in range(256):
        out.append(chr(b) if b in shown else chr(256 + more))
        more += b not in shown
    return out


@dataclass
class Vocabulary:
    """Merges as pair keys in the order of their ranks, with the symbols they make.

    A symbol is a token id. ``first`` has the id of each byte inside a word and
    ``last`` of each byte at a word's end.
    """

    tokens: list[str]
    specials: dict[str, int]
    first: np.ndarray
    last: np.ndarray
    keys: np.ndarray
    made: np.ndarray
    suffix: str

    @cached_property
    def special_pattern(self):
        return regex.compile("(" + "|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True))) + ")") if self.specials else None

    def slot(self, keys: np.ndarray) -> np.ndarray:
        """Where the hash table has a key, or the first that it tries."""
        bits = (8 * len(self.keys)).bit_length()
        return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - bits)).astype(np.int64)

    @cached_property
    def slots(self) -> np.ndarray:
        """Ranks by the hash of their key, or the next free place after it; -1 where free."""
        slots = np.full(1 << (8 * len(self.keys)).bit_length(), -1, dtype=np.int32)
        rank, at = np.arange(len(self.keys)), self.slot(self.keys)
        while len(rank):
            free = slots[at] < 0
            slots[at[free]] = rank[free]
            left = slots[at] != rank
            rank, at = rank[left], (at[left] + 1) % len(slots)
        return slots

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of symbols, NONE where nothing merges it."""
        if not len(self.keys):
            return np.full(len(left), NONE)
        # a free place names the last key, which stands elsewhere
        keys = left.astype(np.int64) << 32 | right
        at = self.slot(keys)
        rank = self.slots[at]
        out = np.where(self.keys[rank] == keys, rank, NONE)
        other = np.flatnonzero((out == NONE) & (rank >= 0))
        while len(other):
            at[other] = (at[other] + 1) % len(self.slots)
            rank = self.slots[at[other]]
            same = self.keys[rank] == keys[other]
            out[other[same]] = rank[same]
            other = other[~same & (rank >= 0)]
        return out


def load_vocabulary(text: str) -> Vocabulary:
    """Read a tokenizer file's text: BPE over byte letters with a suffix on a word's last symbol."""
    spec = json.loads(text)
    model = spec["model"]
    suffix = model["end_of_word_suffix"]
    ids = dict(model["vocab"])
    specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
    tokens = [""] * (max(*ids.values(), *specials.values()) + 1)
    for token, i in [*ids.items(), *specials.items()]:
        tokens[i] = token
    pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    left = np.array([ids[a] for a, _ in pairs], dtype=np.int64)
    right = np.array([ids[b] for _, b in pairs], dtype=np.int64)
    made = np.array([ids[a + b] for a, b in pairs], dtype=np.int32)
    letters = byte_letters()
    return Vocabulary(
        tokens, specials, np.array([ids[c] for c in letters], dtype=np.int32), np.array([ids[c + suffix] for c in letters], dtype=np.int32),
        left << 32 | right, made, suffix,
    )


def merge_words(vocab: Vocabulary, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words in one flat array, and how many each word has. Words are not empty.

    In a round every word merges its pair of the lowest rank, wherever it
    occurs in the word, left to right; words without a known pair leave the
    round's array. Only pairs beside a merge are looked up again.
    """
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    flat = np.frombuffer(b"".join(words), dtype=np.uint8)
    ends = np.cumsum(sizes) - 1
    symbols = vocab.first[flat]
    symbols[ends] = vocab.last[flat[ends]]
    word = np.repeat(np.arange(len(words), dtype=np.int32), sizes)
    rank = np.full(len(symbols), NONE)
    again = np.arange(len(symbols))
    done_symbols, done_words = [], []
    while len(symbols):
        # rank is that of a symbol and the next one in its word
        after = np.minimum(again + 1, len(symbols) - 1)
        inside = (word[again] == word[after]) & (again < after)
        rank[again] = NONE
        again, after = again[inside], after[inside]
        rank[again] = vocab.rank(symbols[again], symbols[after])
        begin = np.flatnonzero(np.diff(word, prepend=np.int32(-1)))
        lowest = np.minimum.reduceat(rank, begin)
        best = np.repeat(lowest, np.diff(begin, append=len(word)))
        active = best < NONE
        if not active.all():
            done_symbols.append(symbols[~active])
            done_words.append(word[~active])
        hit = (rank == best) & active
        # in a run of overlapping hits (a a a) every second one counts
        run = np.flatnonzero(hit)
        fresh = np.diff(run, prepend=-2) != 1
        place = np.arange(len(run))
        run = run[(place - np.maximum.accumulate(np.where(fresh, place, 0))) % 2 == 0]
        symbols[run] = vocab.made[best[run]]
        active[run + 1] = False
        changed = np.zeros(len(symbols), dtype=bool)
        changed[run] = True
        symbols, word, rank, changed = symbols[active], word[active], rank[active], changed[active]
        again = np.flatnonzero(changed | np.append(changed[1:], False))
    ids, owner = np.concatenate([*done_symbols, symbols]), np.concatenate([*done_words, word])
    order = np.argsort(owner, kind="stable")
    return ids[order], np.bincount(owner, minlength=len(words))


def joined(flat: np.ndarray, sizes: np.ndarray, at: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the entries of these numbers in order, and how many each run of ``lengths`` entries has; ``flat`` has an entry's ids after those of the one before."""
    each, starts = sizes[at], (np.cumsum(sizes) - sizes)[at]
    total = np.cumsum(each)
    out = flat[np.arange(int(each.sum())) + np.repeat(starts - (total - each), each)]
    ends = np.concatenate([[0], total])[np.cumsum(lengths)]
    return out, np.diff(ends, prepend=0)


class Encoder:
    """Encodes texts of one task; ids of words are kept.

    No word reaches over white space, so a stretch without any has the same ids
    wherever it stands, and those of some texts are cut into words once.
    """

    def __init__(self, vocab: Vocabulary):
        self.vocab = vocab
        self.pieces, self.later_pieces = regex.compile(PIECES), regex.compile(LATER_PIECES)
        capitals = as_class(tuple((a, b) for a, b, _ in LATER_CAPITALS))
        self.later = re.compile(f"[{as_class(LATER_MARKS)}{LATER}{capitals}]")
        least = min(LATER_MARKS[0][0], LATER_LETTERS[0][0], LATER_CAPITALS[0][0])
        self.may_be_later = re.compile(f"[{chr(least)}-{chr(0x10FFFF)}]")
        self.later_marks = re.compile(f"([{as_class(LATER_MARKS)}])")
        self.lower = lower_map()
        self.forget()

    def forget(self) -> None:
        self.number = defaultdict(count().__next__)
        self.flat = np.array(list(self.vocab.specials.values()), dtype=np.int32)
        self.sizes = np.ones(len(self.flat), dtype=np.int64)
        for s in self.vocab.specials:
            self.number[s]

    def split(self, text: str) -> str | list:
        """A text to be split at white space, or the words of one that is not, special tokens among them."""
        special = self.vocab.special_pattern
        if special is None or "<|" not in text:
            return self.plain(text)
        out = []
        for i, part in enumerate(special.split(text)):
            if i % 2:
                out.append(part)
            else:
                found = self.plain(part)
                out += self.cut(found.split())[0] if isinstance(found, str) else found
        return out

    def plain(self, text: str) -> str | list:
        if not text.isascii():
            later = self.may_be_later.search(text) and self.later.search(text)
            if later:
                text = "".join(unicodedata.normalize("NFC", part) for part in self.later_marks.split(text)).translate(self.lower)
            else:
                text = unicodedata.normalize("NFC", text)
            text = text.replace("Σ", "σ")  # a final sigma gets no form of its own
            if later:
                return self.later_pieces.findall(text.lower())
        text = text.lower()
        if any(c in text for c in NO_SPACE):
            return self.pieces.findall(text)
        return text

    def cut(self, stretches: list[str]) -> tuple[list[str], list[int]]:
        """The words of all stretches, and how many each has."""
        words, lengths = [], []
        for s in stretches:
            if s.isalpha():
                words.append(s)
                lengths.append(1)
                continue
            head = s.rstrip(punctuation)
            found = (head, s[len(head) :]) if head.isalpha() else self.pieces.findall(s)
            words += found
            lengths.append(len(found))
        return words, lengths

    def ids(self, words: list[str], lengths: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in order, and how many each run of ``lengths`` words has. New words are numbered as they are met."""
        at = np.fromiter(map(self.number.__getitem__, words), dtype=np.int64, count=len(words))
        new = list(islice(reversed(self.number), len(self.number) - len(self.sizes)))[::-1]
        if new:
            flat, sizes = merge_words(self.vocab, [w.encode("utf-8", "surrogatepass") for w in new])
            self.flat, self.sizes = np.concatenate([self.flat, flat]), np.concatenate([self.sizes, sizes])
        return joined(self.flat, self.sizes, at, np.array(lengths, dtype=np.int64))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one flat array, and how many each text has."""
        if len(self.number) > KEPT_WORDS or len(self.flat) > KEPT_IDS:
            self.forget()
        found = [self.split(t) for t in texts]
        # Arrow's white space is Python's; at a text's ends it leaves empty stretches, which have no words
        spaced = pc.utf8_split_whitespace(pa.array([f for f in found if isinstance(f, str)], pa.large_string()))
        stretches = spaced.flatten().dictionary_encode()
        known = self.ids(*self.cut(stretches.dictionary.to_numpy(zero_copy_only=False).tolist()))
        flat, sizes = joined(*known, stretches.indices.to_numpy(), spaced.value_lengths().to_numpy())
        odd = np.fromiter((isinstance(f, list) for f in found), dtype=bool, count=len(found))
        if not odd.any():
            return flat, sizes
        listed = [f for f in found if isinstance(f, list)]
        odd_flat, odd_sizes = self.ids(list(chain.from_iterable(listed)), list(map(len, listed)))
        every = np.empty(len(found), dtype=np.int64)
        every[odd], every[~odd] = odd_sizes, sizes
        out, of_odd = np.empty(len(flat) + len(odd_flat), dtype=np.int32), np.repeat(odd, every)
        out[of_odd], out[~of_odd] = odd_flat, flat
        return out, every


def decode_ids(vocab: Vocabulary, ids: list[int]) -> str:
    """Tokens joined by spaces, as the file, which names no decoder, prescribes."""
    return " ".join(map(vocab.tokens.__getitem__, ids))


def encode_documents(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids, decoded`` for each row: the ids of the whole text, and the text decoded from these ids.

    ``vocabulary`` is the path of a tokenizer file, read on the driver and
    broadcast (about 50,000 tokens). A null or empty text has no ids and
    decodes to ''. Texts are taken in blocks of bounded size, a longer text by
    itself. Every row is encoded, rows of a null id and repeated rows each by
    themselves. Other columns of ``docs`` are ignored.
    """
    with open(vocabulary, encoding="utf-8") as f:
        shared = docs.sparkSession.sparkContext.broadcast(load_vocabulary(f.read()))

    def encode(batches):
        encoder = Encoder(shared.value)
        for batch, texts in text_blocks(batches, chars=BLOCK_CHARS):
            flat, sizes = encoder.encode([t or "" for t in texts])
            cuts = np.concatenate([[0], np.cumsum(sizes)])
            each = flat.tolist()
            decoded = pa.array([decode_ids(shared.value, each[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.string())
            ids = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), ids, decoded], ["doc_id", "ids", "decoded"])

    kind = docs.schema[id_col].dataType.simpleString()
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return slim.mapInArrow(encode, f"doc_id {kind}, ids array<int>, decoded string")
