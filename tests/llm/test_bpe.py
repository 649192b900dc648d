import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from plain import documents
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from kilnwork.llm import bpe
from kilnwork.llm.unicode_versions import LATER_CAPITALS, LATER_LETTERS, LATER_MARKS

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def ours():
    with open(PATH, encoding="utf-8") as f:
        return bpe.Encoder(bpe.load_vocabulary(f.read()))


@pytest.fixture(scope="module")
def theirs():
    return Tokenizer.from_file(PATH)


ODD = [
    "", " ", "<|endoftext|> a<|startoftext|>b<|endoftext", "ΑΣ ΣΑΣ Σ", "İstanbul ß ﬁ", "a" * 50 + "!" * 20, "it's I'LL we'Ve 'S's", "日本語 123 ٣٤",
    "a\x1cb\x85c​d　e", "é ñ ẛ̣", "😀👨‍👩‍👧", "x" * 3000, "\0a\x01", "ab" * 4000, "qz" * 100000, "aaa aaaa aaaaa", None,
]


def check(ours, theirs, text):
    ids, _ = ours.encode([text or ""])
    want = theirs.encode(text or "", add_special_tokens=False).ids
    assert ids.tolist() == want
    assert bpe.decode_ids(ours.vocab, want) == theirs.decode(want, skip_special_tokens=False)


@pytest.mark.parametrize("text", ODD)
def test_odd_texts(ours, theirs, text):
    check(ours, theirs, text)


@settings(max_examples=1500, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.characters(max_codepoint=0x2FF)), max_size=60))
def test_any_text(ours, theirs, text):
    check(ours, theirs, text)


def test_every_code_point(ours, theirs):
    """Alone in words, between marks of two classes, and in pairs that may compose."""
    every = [chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000]
    for lo in range(0, len(every), 4000):
        part = every[lo : lo + 4000]
        text = " ".join(f"a{c}b !{c}! a{c}\u0316\u0301 a\u0301{c}" for c in part)
        assert ours.encode([text])[0].tolist() == theirs.encode(text, add_special_tokens=False).ids, hex(ord(part[0]))


def test_texts_of_later_characters(ours, theirs):
    r = random.Random(4)
    later = [c for a, b in (*LATER_MARKS, *LATER_LETTERS, *((x, y) for x, y, _ in LATER_CAPITALS)) for c in range(a, b + 1)]
    marks = [0x300, 0x301, 0x316, 0x323, 0x345, 0x11935, 0x1100, 0x1161]
    for _ in range(3000):
        text = "".join(chr(r.choice(r.choice((later, marks, [0x41, 0x20, 0xE9, 0x65, 0x21, 0x31])))) for _ in range(r.randint(1, 20)))
        assert ours.encode([text])[0].tolist() == theirs.encode(text, add_special_tokens=False).ids, text.encode("unicode_escape")


def test_batches_and_forgetting(theirs, monkeypatch):
    monkeypatch.setattr(bpe, "KEPT_WORDS", 50)
    with open(PATH, encoding="utf-8") as f:
        encoder = bpe.Encoder(bpe.load_vocabulary(f.read()))
    r = random.Random(1)
    texts = ["".join(r.choice("abcdefgh  '.") for _ in range(r.randint(0, 200))) for _ in range(120)]
    for lo in range(0, 120, 30):
        flat, sizes = encoder.encode(texts[lo : lo + 30])
        want = [theirs.encode(t, add_special_tokens=False).ids for t in texts[lo : lo + 30]]
        assert flat.tolist() == [i for w in want for i in w] and sizes.tolist() == list(map(len, want))


def test_documents(spark, theirs):
    docs = documents(spark, list(enumerate(ODD))).withColumn("ids", F.lit("clash"))
    got = {r.doc_id: r for r in bpe.encode_documents(docs, PATH).collect()}
    for d, t in enumerate(ODD):
        want = theirs.encode(t or "", add_special_tokens=False).ids
        assert got[d].ids == want and got[d].decoded == theirs.decode(want, skip_special_tokens=False)
    assert bpe.encode_documents(docs.limit(0), PATH).count() == 0


def test_ranks_of_pairs():
    """Against a dict, on keys that collide in the hash table."""
    r = random.Random(8)
    pairs = list({(r.randrange(300), r.randrange(300)) for _ in range(20_000)})
    keys = np.array([a << 32 | b for a, b in pairs], dtype=np.int64)
    some = np.zeros(1, dtype=np.int32)
    vocab = bpe.Vocabulary([], {}, some, some, keys, np.arange(len(keys), dtype=np.int32), "")
    assert len(np.unique(vocab.slot(keys))) < len(keys)
    left, right = (x.ravel().astype(np.int32) for x in np.meshgrid(np.arange(300), np.arange(300)))
    known = {p: i for i, p in enumerate(pairs)}
    assert vocab.rank(left, right).tolist() == [known.get(p, bpe.NONE) for p in zip(left.tolist(), right.tolist(), strict=True)]
    none = bpe.Vocabulary([], {}, some, some, keys[:0], some[:0], "")
    assert none.rank(left, right).tolist() == [bpe.NONE] * len(left)


def test_work_follows_distinct_words(theirs, monkeypatch):
    """Repeated stretches are cut once a block, words merged once, pairs looked up again only beside a merge."""
    with open(PATH, encoding="utf-8") as f:
        encoder = bpe.Encoder(bpe.load_vocabulary(f.read()))
    seen = {"pairs": 0, "cut": 0, "words": []}
    rank, cut, merge = bpe.Vocabulary.rank, bpe.Encoder.cut, bpe.merge_words
    monkeypatch.setattr(bpe.Vocabulary, "rank", lambda self, a, b: (seen.update(pairs=seen["pairs"] + len(a)), rank(self, a, b))[1])
    monkeypatch.setattr(bpe.Encoder, "cut", lambda self, s: (seen.update(cut=seen["cut"] + len(s)), cut(self, s))[1])
    monkeypatch.setattr(bpe, "merge_words", lambda v, words: (seen["words"].extend(words), merge(v, words))[1])
    r = random.Random(3)
    words = list({"".join(r.choice("abcdefghij") for _ in range(30)) for _ in range(500)})
    texts = [" ".join(r.choice(words) + r.choice(("", ",", "...")) for _ in range(400)) for _ in range(40)]
    for _ in range(3):
        flat, _ = encoder.encode(texts)
    assert flat.tolist() == [i for t in texts for i in theirs.encode(t, add_special_tokens=False).ids]
    assert len(seen["words"]) == len(set(seen["words"])) == len(words) + 2
    assert seen["cut"] <= 3 * (3 * len(words) + 1)
    assert seen["pairs"] < 3 * sum(map(len, seen["words"]))


def test_kept_ids_are_bounded(ours, theirs, monkeypatch):
    """Few but long words fill the store too."""
    monkeypatch.setattr(bpe, "KEPT_IDS", 1000)
    for c in "abcdef":
        check(ours, theirs, f"{c}9!" * 2000 + " " + "".join(map(chr, range(0x4E00, 0x5000))) + c)
    ours.encode(["a"])
    assert len(ours.flat) < 1000


def test_odd_texts_among_plain_ones(ours, theirs):
    texts = [*(t or "" for t in ODD), "  spaces at ends\t\n", "plain, text. here", "a\x1fb", "x <|endoftext|>y, z", "", "　", "it's 'tis rock'n'roll' a'S"]
    for part in (texts, texts[::-1], ["a\x1cb"], ["", " "], []):
        flat, sizes = ours.encode(part)
        want = [theirs.encode(t, add_special_tokens=False).ids for t in part]
        assert flat.tolist() == [i for w in want for i in w] and sizes.tolist() == list(map(len, want))


def test_white_space_is_pythons():
    """Stretches are split by Arrow, and the texts it may not split are those that hold NO_SPACE."""
    every = [f"a{chr(i)}b" for i in range(0x110000) if not 0xD800 <= i < 0xE000]
    got = pc.utf8_split_whitespace(pa.array(every, pa.large_string())).to_pylist()
    assert got == [t.split() for t in every]
