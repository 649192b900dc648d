import random

import numpy as np
from plain import documents, words

import corpus_pipeline
from kilnwork.llm import simhash, similar


def shingles(text, n=5):
    w = words((text or "").translate({i: i + 32 for i in range(65, 91)}))
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def classes(rows):
    """Least id of each id's class, by comparing all pairs."""
    found = {d: shingles(t) for d, t in rows}
    label, changed = {d: d for d in found}, True
    while changed:
        changed = False
        for a in found:
            for b in found:
                if label[b] < label[a] and 9 * len(found[a] & found[b]) >= 4 * (len(found[a]) + len(found[b])):
                    label[a], changed = label[b], True
    return label


def texts(seed=3):
    """Texts with copies of 1 to 6 changed words, chains of them, a passage many share, and texts without words."""
    r = random.Random(seed)
    word = lambda: f"w{r.randrange(400)}"
    passage = [word() for _ in range(30)]
    out = [None, "", " \n", "one", "one two", "One  TWO", " ".join(passage)]
    for _ in range(60):
        base = [word() for _ in range(r.randint(1, 200))]
        out.append(" ".join(base))
        for _ in range(r.randrange(4)):
            for _ in range(r.randint(1, 6)):
                base[r.randrange(len(base))] = word()
            out.append(" ".join(base))
    out += [" ".join(passage + [word() for _ in range(r.randint(1, 12))]) for _ in range(40)]
    near = [word() for _ in range(300)]
    return out + [" ".join(near[:k] + ["changed"] + near[k + 1 :]) for k in range(0, 300, 5)]


def test_classes_match_all_pairs(spark):
    rows = list(enumerate(texts()))
    got = {r.doc_id: r.component_id for r in similar.near_duplicates(documents(spark, rows)).collect()}
    assert got == classes(rows)


def test_stage_links_what_bits_miss(spark):
    rows = list(enumerate(texts(seed=5)))
    docs = documents(spark, rows)
    want = {d for d, least in classes(rows).items() if d == least}
    got = {r.doc_id for r in corpus_pipeline.near_duplicate_stage(spark, docs, "").collect()}
    assert got == want
    assert got != {r.doc_id for r in simhash.drop_near_duplicates(docs).collect()}


def test_marks_never_exceed_the_difference():
    """Sets differ in at least as many elements as their marks in bits, and marks of unlike sets tell them apart."""
    r = np.random.default_rng(2)
    for size in (0, 1, 40, 700, 5000):
        base = np.unique(r.integers(0, 2**63, size, dtype=np.uint64))
        for kept in (0.0, 0.5, 0.9, 1.0):
            other = np.unique(np.concatenate([base[r.random(len(base)) < kept], r.integers(0, 2**63, int(size * (1 - kept)), dtype=np.uint64)]))
            bits = int(np.bitwise_count((similar.marks(base) ^ similar.marks(other)).view(np.uint64)).sum())
            assert bits <= len(np.setxor1d(base, other)) and (kept < 1 or bits == 0)
            if size == 700 and not kept:
                assert 9 * bits > len(base) + len(other)


def test_null_and_repeated_ids(spark):
    rows = [(5, "a b c d e f"), (3, "A b c d e f"), (9, "something else over here entirely"), (9, "something else over here entirely"), (None, "a b c d e f"), (7, None), (8, "")]
    assert sorted(r.doc_id for r in similar.drop_near_duplicates(documents(spark, rows)).collect()) == [3, 7, 9, 9]
    assert similar.drop_near_duplicates(documents(spark, rows[4:5])).count() == 1
    assert similar.drop_near_duplicates(documents(spark, rows).limit(0)).count() == 0
