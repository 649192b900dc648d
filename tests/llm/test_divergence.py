"""The audit of sources against sums over every term of every pair."""

import random
import re
from collections import Counter

import pytest
from plain import documents
from pyspark.sql import functions as F

from kilnwork.llm import divergence


def terms(text):
    low = "".join(c.lower() if c.isascii() else c for c in text or "")
    return re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low)


def distance(p, q):
    return (p - q) ** 2 // (p + q)


def plain(rows, min_docs=10, top=10):
    out = []
    for lang in {r[2] or "" for r in rows}:
        own = [r for r in rows if (r[2] or "") == lang]
        held = Counter(t for r in own for t in set(terms(r[1])))
        kept = {t for t, n in held.items() if n >= min_docs}
        counts = {s: Counter() for s in {r[3] or "" for r in own}}
        for r in own:
            counts[r[3] or ""].update(t for t in terms(r[1]) if t in kept)
        whole = sum(counts.values(), Counter())

        def share(c, t):
            return 1 + 10**9 * (c[t] + 2) // (c.total() + 2 * len(kept))

        for s, c in counts.items():
            pairs = [(-sum(distance(share(c, t), share(d, t)) for t in kept), o) for o, d in counts.items() if o != s]
            found = [(-distance(share(c, t), share(whole, t)), t) for t in kept if c[t] and share(c, t) > share(whole, t)]
            for part, ranked in (("pair", sorted(pairs, key=lambda x: (x[0], x[1].encode()))), ("term", sorted(found, key=lambda x: (x[0], x[1].encode()))[:top])):
                out += [(lang, s, part, item, -v, i + 1) for i, (v, item) in enumerate(ranked)]
    return sorted(out)


def audited(spark, rows, **options):
    docs = documents(spark, rows).withColumn("term", F.lit("clash")).withColumn("p", F.lit(1)).withColumn("n", F.lit(1))
    return sorted(tuple(r) for r in divergence.audit_sources(docs, **options).collect())


def random_rows(seed, n, langs, sources, vocabulary):
    r = random.Random(seed)
    return [(i, " ".join(r.choice(vocabulary) for _ in range(r.randint(0, 40))), r.choice(langs), r.choice(sources)) for i in range(n)]


@pytest.mark.parametrize("min_docs", [1, 10])
def test_matches_plain(spark, min_docs):
    words = ["The", "the", "cat", "Ünder", "ünder", "É", "dog's", "a1b", "x", "y", "naïve", "日本", "z-z"] + [f"w{chr(97 + i)}" for i in range(20)]
    rows = random_rows(1, 300, ["en", "de", None, ""], ["s1", "s2", "S", "é", None, ""], words)
    rows += [(900, None, "en", "empty"), (901, "123 ...", "fr", "a"), (902, "", "fr", "b"), (903, "solo", "it", "a")]
    assert audited(spark, rows, min_docs=min_docs) == plain(rows, min_docs)


def test_no_kept_terms_and_empty_tables(spark):
    rows = [(1, "one", "en", "a"), (2, "two", "en", "b"), (2, "two", "en", "b"), (None, None, None, None)]
    assert audited(spark, rows) == plain(rows) == [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]
    assert divergence.audit_sources(documents(spark, rows).limit(0)).count() == 0


def test_a_hot_source_and_long_texts(spark):
    rows = random_rows(2, 60, ["en"], ["hot", "hot", "b"], [f"t{chr(97 + i)}" for i in range(26)])
    rows += [(i, "long tail " * 30_000, "en", "hot") for i in range(100, 112)] + [(i, "same words", "en", f"s{i % 3}") for i in range(200, 260)]
    assert audited(spark, rows) == plain(rows)


@pytest.mark.parametrize("cut", [1, 7, 10_000])
def test_trees_cut_anywhere_give_the_same_sums(spark, cut):
    r = random.Random(3)
    paths = [[(f"s{i}", r.randint(1, 3), 1) for i in range(6) if r.random() < 0.6] for _ in range(200)]
    df = spark.createDataFrame([("en", p, 2) for p in paths if p], "lang string, path array<struct<source string, p long, none long>>, terms long")
    got = {(x.a, x.b): x.value for x in divergence.pair_corrections(df, cut).collect()}
    want = Counter()
    for p in paths:
        for i, (a, x, _) in enumerate(p):
            for b, y, _ in p[i + 1 :]:
                want[a, b] += 2 * (distance(x, y) - distance(x, 1) - distance(1, y))
    assert {k: v for k, v in got.items() if v} == {k: v for k, v in want.items() if v}


def test_equal_paths_share_nodes():
    tree = divergence.Tree()
    tree.insert([("a", 5, 1), ("b", 9, 1), ("c", 4, 1)], 3)
    tree.insert([("a", 5, 1), ("b", 9, 1)], 2)
    tree.insert([("a", 6, 1), ("b", 9, 1)], 1)
    assert len(tree.parent) == 6 and tree.terms[1:] == [5, 5, 3, 1, 1]


def test_counts_of_tasks_add_up(spark):
    rows = random_rows(4, 80, ["en"], ["a", "b"], ["x", "y", "z", "w"])
    counted = divergence.count_terms(documents(spark, rows)).filter("term is not null").groupBy("source", "term").agg(F.sum("n").alias("n"))
    want = Counter((s, t) for _, text, _, s in rows for t in terms(text))
    assert {(r.source, r.term): r.n for r in counted.collect()} == dict(want)
