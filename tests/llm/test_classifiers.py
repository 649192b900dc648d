import random

import numpy as np
import pytest
from plain import documents
from pyspark.sql import functions as F

from hypothesis import given, settings
from hypothesis import strategies as st

from kilnwork.llm import quality, toxicity
from kilnwork.llm.network import fit_network
from kilnwork.llm.sampling import bounded_sample, fold

VOCAB = ["brave", "river", "stone", "letter", "window", "garden", "silver", "market", "people", "thing", "other", "would"]
BAD = ["grubnik", "snorvel"]


@pytest.fixture(scope="module")
def corpus():
    r = random.Random(2)
    rows, labels = [], []
    for i in range(700):
        w = [r.choice(VOCAB) for _ in range(r.randint(5, 60))]
        q, t = int(i % 4 > 0), int(i % 5 == 0)
        if not q:
            w = [x.upper() + "!!" for x in w]
        if t:
            for _ in range(2):
                w.insert(r.randrange(len(w)), r.choice(BAD))
        rows.append((i, " ".join(w), "en", "s"))
        labels.append((i, q, t))
    return rows, labels


def tables(spark, corpus):
    rows, labels = corpus
    return documents(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_quality_held_out(spark, corpus):
    docs, labels = tables(spark, corpus)
    model = quality.fit_quality(docs, labels)
    got = quality.score_quality(docs, model).join(labels, "doc_id").filter(fold(F.col("doc_id"), 4) == 2).collect()
    assert np.mean([(r.score >= 0.7) == r.quality for r in got]) > 0.97


def test_quality_odd_rows(spark, corpus):
    docs, labels = tables(spark, corpus)
    model = quality.fit_quality(docs, labels.union(labels))
    odd = documents(spark, [(1, None), (2, ""), (3, "river " * 200000), (None, "x")]).withColumn("score", F.lit("clash"))
    got = {r.doc_id: r.score for r in quality.score_quality(odd, model).collect()}
    assert got[1] == got[2] and all(0 <= s <= 1 for s in got.values())
    assert quality.score_quality(docs.limit(0), model).count() == 0


def test_without_labels_scores_are_even(spark, corpus):
    docs, labels = tables(spark, corpus)
    none = labels.limit(0)
    assert {r.score for r in quality.score_quality(docs, quality.fit_quality(docs, none)).collect()} == {0.5}
    assert {r.score for r in toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, none)).collect()} == {0.5}


def test_vectors_and_pooling_match_plain(spark, corpus):
    """Contexts over all texts, pooled features and the network's pass, one word after another."""
    import re

    docs, _ = tables(spark, corpus)
    number = lambda w: int(quality.words_of([w])[0][0])
    split = lambda t: re.findall(r"[^\W_]+|[^\w\s]+", t)
    index = quality.index_vectors()
    assert (np.abs(index).sum(axis=1) <= quality.ONES).all() and (np.abs(index).sum(axis=1) > 0).any()
    context = np.zeros_like(index, dtype=float)
    known = {}
    for _, text, *_ in corpus[0]:
        ids = [known.setdefault(w, number(w)) for w in split(text)]
        for a, b in zip(ids, ids[1:], strict=False):
            context[a] += index[b]
            context[b] += index[a]
    want = context / np.maximum(np.linalg.norm(context, axis=1, keepdims=True), 1e-6) + 0.5 * index / 3**0.5
    got = quality.fit_vectors(docs)
    assert np.abs(got - want).max() < 1e-5
    for text in (corpus[0][0][1], "river", ""):
        v = np.array([got[known[w]] for w in split(text)]).reshape(-1, quality.DIM)
        row = np.zeros(3 * quality.DIM + 1)
        if len(v):
            row[: quality.DIM], row[quality.DIM : 2 * quality.DIM] = v.mean(axis=0), v.std(axis=0)
            row[2 * quality.DIM : -1] = (v[:-1] * v[1:]).sum(axis=0) / len(v)
        row[-1] = np.log1p(len(v))
        assert np.abs(quality.pool(got, [text])[0] - row).max() < 1e-3  # single precision


def test_temperature_calibrates():
    """The mean score of a group with equal features is near its share of ones."""
    r = np.random.default_rng(1)
    x = r.integers(0, 4, (8000, 1)).astype(float)
    share = np.array([0.1, 0.35, 0.6, 0.9])
    y = (r.random(8000) < share[x[:, 0].astype(int)]).astype(float)
    p = fit_network(x, y).predict(np.arange(4.0)[:, None])
    assert np.abs(p - share).max() < 0.08


def test_pooled_features_do_not_depend_on_the_batch(corpus):
    vectors = quality.index_vectors()
    texts = [r[1] for r in corpus[0]] + ["", "x"]
    together = quality.pool(vectors, texts)
    assert (together == np.concatenate([quality.pool(vectors, [t]) for t in texts])).all()


@pytest.fixture(scope="module")
def toxic_model(spark, corpus):
    return toxicity.fit_toxicity(*tables(spark, corpus))


def test_toxicity_held_out(spark, corpus, toxic_model):
    docs, labels = tables(spark, corpus)
    got = toxicity.score_toxicity(docs, toxic_model).join(labels, "doc_id").filter(fold(F.col("doc_id"), 3) == 1).collect()
    assert np.mean([(r.score >= 0.7) == r.toxic for r in got]) > 0.97


@pytest.mark.parametrize("shown", ["gru8nik", "g r u b n i k", "g.r.u.b.n.i.k", "gruuubniiik", "9ru6nik".replace("6", "8"), "sn0rvel", "$norvel", "s n o r v e l", "s-n-o-r-v-e-l", "SSNNOORRVVEELL", "s  n  o  r  v  e  l"])
def test_obfuscation_is_undone(toxic_model, shown):
    decoder = toxicity.Decoder(toxic_model.characters)
    text = f"brave river stone {shown} letter window {shown} people"
    restored = decoder.restore_all([text])[0]
    assert any(b in restored for b in BAD), restored
    assert toxic_model.predict(toxic_model.features([restored]))[0] >= 0.7


def test_clean_text_is_left_alone(toxic_model):
    decoder = toxicity.Decoder(toxic_model.characters)
    for text in ("brave river stone.", "", "call 555-1234 now", "letter & window"):
        assert decoder.restore_all([text]) == [text]
    assert decoder.restore_all([None]) == [""]
    assert toxic_model.predict(toxic_model.features(["brave river stone"]))[0] < 0.3


def best_reading(decoder, stretch):
    """The likeliest reading by dynamic programming over full back pointers, without cuts."""
    m = decoder.model
    table = {(0, 0): (0.0, "")}
    for readings in decoder.lattice(stretch):
        following = {}
        for (a, b), (score, text) in table.items():
            for written, code, cost in readings:
                same = code < 0 or (code == 0 and b == 0)
                state = (a, b) if same else (b, code) if code else (0, 0)
                value = score - cost + (0.0 if same else m[a, b, code])
                if state not in following or value > following[state][0]:
                    following[state] = (value, text + written)
        table = following
    return max(((s + (m[a, b, 0] if b else 0.0), t) for (a, b), (s, t) in table.items()), key=lambda x: x[0])[1]


def test_viterbi_matches_all_readings(toxic_model):
    import itertools

    decoder = toxicity.Decoder(toxic_model.characters)
    m = toxic_model.characters
    for stretch in ("gr8b", "s.n.o", "aab", "1t", "a$$", "hi!!", "b, 0"):
        best = (-np.inf, None)
        for path in itertools.product(*decoder.lattice(stretch)):
            a = b = 0
            score, out = 0.0, ""
            for written, code, cost in path:
                score -= cost
                out += written
                if code >= 0 and not (code == 0 and b == 0):
                    score += m[a, b, code]
                    a, b = (b, code) if code else (0, 0)
            best = max(best, (score + (m[a, b, 0] if b else 0.0), out))
        assert decoder.viterbi(stretch) == best[1] == best_reading(decoder, stretch)


@pytest.mark.parametrize("agreed", [1, 7, 512])
def test_long_stretches_are_decoded_whole(toxic_model, monkeypatch, agreed):
    monkeypatch.setattr(toxicity, "AGREED", agreed)
    decoder = toxicity.Decoder(toxic_model.characters)
    r = random.Random(3)
    leet = {"o": "0", "i": "1", "e": "3", "a": "4", "s": "$", "t": "7", "g": "9"}
    for n in (90, 97, 200, 1000):
        text = " ".join(r.choice(VOCAB + BAD) for _ in range(n // 6))
        shown = "  ".join(" ".join(leet.get(c, c) if r.random() < 0.3 else c for c in w) for w in text.split())
        packed = "".join(leet.get(c, c) if r.random() < 0.3 else c for c in text.replace(" ", ""))
        for stretch in (shown, packed):
            assert decoder.viterbi(stretch) == best_reading(decoder, stretch)


NASTY = "ab1!$ 0é.-_\n,²\u0301\0o"


@settings(max_examples=1000, deadline=None)
@given(st.lists(st.text(alphabet=NASTY, max_size=12), min_size=1, max_size=4))
def test_prefilter_misses_nothing(toxic_model, texts):
    decoder = toxicity.Decoder(toxic_model.characters)
    assert decoder.restore_all(texts) == [decoder.restore(t.lower()) for t in texts]


def test_trigrams_words_and_features_match_plain(spark, corpus, toxic_model):
    """Counts, odds and features one character or word after another."""
    import re
    from collections import Counter

    three = Counter()
    for _, text, *_ in corpus[0]:
        code = [0, 0]
        for c in text.lower() + "\0":
            x = toxicity.ALPHABET.find(c) + 1 if c in toxicity.ALPHABET else toxicity.OTHER_LETTER if c.isalpha() else 0
            if x:
                code.append(x)
            elif code[-1]:
                code += [0, 0]
        three.update(zip(code, code[1:], code[2:], strict=False))
    counts = np.zeros((toxicity.SIZE,) * 3)
    for k, n in three.items():
        counts[k] = n
    two = counts.sum(axis=0)
    smooth = lambda c, d: (c + d) / (c.sum(axis=-1, keepdims=True) + toxicity.SIZE * d)
    want = np.log(0.75 * smooth(counts, 1e-9) + 0.24 * smooth(two, 0.1)[None] + 0.01 / toxicity.SIZE)
    inner = counts.sum(axis=2) > 0
    assert np.abs(np.where(inner[:, :, None], toxic_model.characters - want, 0)).max() < 1e-6

    docs, labels = tables(spark, corpus)
    toxic = {d: t for d, _, t in corpus[1]}
    fold_of = {r.doc_id: r.f for r in docs.select("doc_id", fold(F.col("doc_id"), 3).alias("f")).collect()}
    decoder = toxicity.Decoder(toxic_model.characters)
    t, c, sizes = Counter(), Counter(), Counter()
    for d, text, *_ in corpus[0]:
        if fold_of[d] == 1:
            continue
        sizes[toxic[d]] += 1
        (t if toxic[d] else c).update(set(re.findall(r"[a-z]+", decoder.restore_all([text])[0])))
    odds = {}
    for w, n in t.items():
        if n >= 3:
            a, b = n + 0.5, c[w] + 0.5
            value = np.log(a / (sizes[1] + 1)) - np.log(b / (sizes[0] + 1)) - 1.5 * np.sqrt(1 / a + 1 / b)
            if value > 0.5:
                odds[w] = value
    assert set(odds) >= set(BAD)
    for w, value in odds.items():
        hashes, n = toxicity.word_hashes([w])
        assert n.tolist() == [1] and abs(toxic_model.word_scores(hashes[0])[0] - value) < 1e-9
    assert toxic_model.word_scores(toxicity.word_hashes(["river"])[0][0])[0] == 0
    text = "river grubnik stone snorvel"
    best = max(max(toxic_model.word_scores(h)[i] for h in toxicity.word_hashes([text])[0]) for i in range(4))
    row = toxic_model.features([text])[0]
    scores = np.max([toxic_model.word_scores(h) for h in toxicity.word_hashes([text])[0]], axis=0)
    assert row[0] == best and (toxic_model.features([""]) == 0).all()
    assert np.allclose(row[1:4], [np.log1p((scores > step).sum()) for step in toxicity.STEPS]) and np.isclose(row[4], scores[scores > toxicity.STEPS[0]].sum() / 4)
    assert toxic_model.predict(toxic_model.features([text]))[0] >= 0.7


@pytest.mark.parametrize("shown,meant", [("hell0", "hello"), ("cl4$$", "class")])
def test_signs_at_a_words_end(shown, meant):
    model = toxicity.Decoder(np.log(np.full((64, 64, 64), 1e-4)))
    codes = toxicity.codes()
    path = [0, 0, *[int(codes[ord(c)]) for c in meant], 0]
    for a, b, c in zip(path, path[1:], path[2:], strict=False):
        model.model[a, b, c] = -0.1
    assert model.restore_all([shown]) == [meant]


def test_toxicity_odd_rows(spark, toxic_model):
    odd = documents(spark, [(1, None), (2, ""), (3, "river g r u b n i k " * 20000), (4, "a " * 30000), (None, "x")])
    got = {r.doc_id: r for r in toxicity.score_toxicity(odd.withColumn("restored", F.lit(1)), toxic_model).collect()}
    assert got[1].score == got[2].score and got[1].restored == ""
    assert got[3].score >= 0.7 and got[4].score < 0.5
    assert toxicity.score_toxicity(odd.limit(0), toxic_model).count() == 0
    twice = odd.union(odd).filter("doc_id = 2")
    assert toxicity.score_toxicity(twice, toxic_model).count() == 2


def test_sample_is_bounded_and_even(spark):
    rows = spark.range(20000).selectExpr("id", "cast(id % 10 = 0 as int) as label")
    drawn = {r.label: r["count"] for r in bounded_sample(rows, "label", ["id"], 2000).groupBy("label").count().collect()}
    assert all(800 < n < 1200 for n in drawn.values()) and len(drawn) == 2


def test_sample_with_many_labels_and_repeats(spark):
    rows = spark.range(20000).selectExpr("id", "id as label")
    assert 800 < bounded_sample(rows, "label", ["id"], 1000).count() < 1200
    same = spark.range(5000).selectExpr("1L as id", "id % 2 as label", "'x' as text").union(spark.createDataFrame([(2, 0, None), (None, 1, "y"), (3, None, "z")], "id long, label long, text string"))
    assert bounded_sample(same, "label", ["id", "text"], 100000).count() == 2
    assert bounded_sample(rows.limit(0), "label", ["id"], 10).count() == 0


def test_network_separates_rings():
    r = np.random.default_rng(0)
    x = r.normal(size=(1500, 2))
    y = ((x**2).sum(axis=1) < 1.2).astype(float)
    assert ((fit_network(x, y).predict(x) > 0.5) == y).mean() > 0.95
