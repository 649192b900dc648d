import random

import numpy as np
import pytest
from plain import documents
from pyspark.sql import functions as F

from kilnwork.llm import language

WORDS = {"xx": ["kata", "mora", "kimo", "tako"], "yy": ["strumpf", "gerust", "drang", "pflug"], "zz": ["öäü", "éèê", "çñ", "ßæ"]}


@pytest.fixture(scope="module")
def rows():
    r = random.Random(5)
    return [(i, " ".join(r.choice(WORDS[k]) for _ in range(r.randint(3, 30))), k, "s") for i, k in enumerate(sorted(WORDS) * 60)]


def test_predicts_held_out(spark, rows):
    got = language.identify_documents(documents(spark, rows), carry=("doc_id", "lang")).collect()
    held = [r for r in got if r.held_out]
    assert held and all(r.lang_pred == r.lang and 0 < r.score <= 1 for r in held)


def test_undetermined_and_odd_rows(spark, rows):
    odd = [(900, None, "xx", "s"), (901, "", "yy", "s"), (902, "123 !? 45", "xx", "s"), (903, "kata mora " * 60000, None, "s"), (None, "drang pflug", "yy", None)]
    docs = documents(spark, rows + odd).withColumn("score", F.lit("clash"))
    got = {r.doc_id: r for r in language.identify_documents(docs, carry=docs.columns).collect()}
    for i in (900, 901, 902):
        assert got[i].lang_pred == "und" and got[i].score == 0
    assert got[903].lang_pred == "xx" and got[None].lang_pred == "yy" and not got[None].held_out


def test_same_text_same_score_whatever_the_batch(spark, rows):
    model = language.fit_language(documents(spark, rows))
    texts = [r[1] for r in rows] + ["ka", "st", "k", "ö ka", ""]
    _, together = language.score_texts(model, texts)
    alone = np.concatenate([language.score_texts(model, [t])[1] for t in texts])
    assert (together == alone).all()


def cells_of(text):
    """Cells of a text's n-grams, one after another: 32-bit hashes of code points, anything but letters read as a space."""
    char = [ord(c) if c.isalpha() else 32 for c in text.lower()] + [32] * 5
    out = []
    for n in (1, 2, 3):
        for i in range(len(char) - 2):
            mixed = 0
            for c in char[i : i + n]:
                mixed = (mixed * 0x01000193 + c * 0x9E3779B1) % 2**32
            mixed = (mixed ^ (n * 0x3C6EF372) % 2**32) * 0x85EBCA6B % 2**32
            out.append(((mixed ^ mixed >> 15) * 0xC2B2AE35 % 2**32) >> (32 - language.BITS))
    return out


def test_matches_plain_naive_bayes(spark, rows):
    """Counts of hashed n-grams, smoothed log probabilities, their sums and posteriors, one text after another."""
    docs = documents(spark, rows)
    model = language.fit_language(docs)
    counts = {k: np.full(1 << language.BITS, 0.5) for k in sorted(WORDS)}
    for _, text, lang, _ in rows:
        for c in cells_of(text):
            counts[lang][c] += 1
    logs = {k: np.rint(np.log(v / v.sum()) * language.FRACTION) for k, v in counts.items()}
    assert model.languages == list(logs) and all((model.table[:, i] == logs[k]).all() for i, k in enumerate(logs))
    got = {r.doc_id: r for r in language.identify(docs, model).collect()}
    for d, text, *_ in rows:
        total = {k: sum(v[c] for c in cells_of(text)) / language.FRACTION for k, v in logs.items()}
        best = max(total, key=total.get)
        assert got[d].lang_pred == best
        assert abs(got[d].score - 1 / sum(np.exp(t - total[best]) for t in total.values())) < 1e-9


def test_more_labels_than_a_table_of_full_width_holds(spark, monkeypatch):
    monkeypatch.setattr(language, "TABLE_SIZE", 1 << 18)
    letters = "abcdefghijklmnopqrstuvwxyz"
    made = [(i, f"{letters[i % 26] * 3} {letters[i // 26] * 4}", f"l{i:04}", "s") for i in range(40)]
    model = language.fit_language(documents(spark, made))
    assert len(model.languages) == 40 and model.shift == 4 and model.table.shape == (1 << 12, 40)
    got = language.identify(documents(spark, made), model).collect()
    assert np.mean([r.lang_pred == made[r.doc_id][2] for r in got]) > 0.9
    many = documents(spark, [(i, f"text {i}", f"l{i}", "s") for i in range(1100)])
    assert len(language.fit_language(many).languages) == 1100


def test_repeated_rows(spark, rows):
    docs = documents(spark, rows)
    got = language.identify_documents(docs.union(docs.filter("doc_id = 0")), carry=("doc_id",)).filter("doc_id = 0").collect()
    assert len(got) == 2 and got[0] == got[1]


def test_without_rows_to_learn_from(spark, rows):
    empty = documents(spark, rows).limit(0)
    assert language.identify_documents(empty).count() == 0
    blank = documents(spark, [(1, "kata", None, "s")])
    assert [r.lang_pred for r in language.identify_documents(blank).collect()] == ["und"]
