"""Manifests against a plain tree that reduces all leaves of a key at once."""

from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from kilnwork.llm import manifest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, place int, block string"


def digest(text):
    return sha256(text.encode()).hexdigest()


def leaf(row):
    doc_id, text, lang, source, n_chars, *_ = row
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def paths(nodes):
    """The top of a tree, and for each node the siblings to the left and right by level."""
    found, now, at = [[] for _ in nodes], list(nodes), list(range(len(nodes)))
    while len(now) > 1:
        for i, steps in enumerate(found):
            run = at[i] // 8 * 8
            steps.append((now[run : at[i]], now[at[i] + 1 : run + 8]))
            at[i] //= 8
        now = [digest("".join(now[i : i + 8])) for i in range(0, len(now), 8)]
    return now[0], found


def plain(rows, changed):
    trees = {}
    for row in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))):
        trees.setdefault(row[2], []).append(row)
    langs = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    inner = {lang: paths([leaf(r) for r in trees[lang]]) for lang in langs}
    root, outer = paths([inner[lang][0] for lang in langs])
    out = []
    for lang, above in zip(langs, outer, strict=True):
        for row, steps in zip(trees[lang], inner[lang][1], strict=True):
            now = leaf((row[0], row[1] and "".join(c.lower() if c.isascii() else c for c in row[1]), *row[2:])) if changed(row[0]) else leaf(row)
            for left, right in steps + above:
                now = digest("".join(left) + now + "".join(right))
            proof = "".join(d for left, right in steps + above for d in left + right)
            out.append((row[0], leaf(row), inner[lang][0], root, proof, now))
    return sorted(out, key=str)


def proven(spark, rows, **options):
    docs = spark.createDataFrame(rows, SCHEMA)
    return manifest.prove_documents(docs, F.when(F.col("doc_id") % 3 == 0, manifest.lowered_leaf()), **options)


def check(spark, rows, **options):
    got = proven(spark, rows, **options)
    out = [tuple(r)[:5] + (r.folded_root,) for r in got.select("doc_id", "leaf", "subroot", "root", "proof", "folded_root").collect()]
    assert sorted(out, key=str) == plain(rows, lambda i: i is not None and i % 3 == 0)


def row(i, text, lang, source="s", n=1):
    return (i, text, lang, source, n, 7, "clash")


@pytest.mark.parametrize("langs", [1, 40])
def test_matches_plain(spark, langs):
    check(spark, [row(i, f"Text {i} É" if i % 5 else None, f"l{i % langs}é" if i % langs else None, None if i % 7 == 0 else "s") for i in range(600)])


def test_whole_last_and_single_runs(spark):
    sizes = {"a": 1, "b": 2, "c": 8, "d": 9, "e": 512, "f": 513, "g": 65}
    check(spark, [row(i, f"T{i}", lang) for lang, n in sizes.items() for i in range(n)])


def test_trees_of_several_rounds(spark):
    check(spark, [row(i, f"T{i}", "en" if i % 9 else f"x{i}") for i in range(700)], depth=1)


def test_odd_rows(spark):
    check(spark, [row(None, None, None, None, None), row(1, "", "", "", 0), row(1, "", "", "", 0), row(1, "B", ""), row(3, "same", "en"), row(3, "same", "en"), row(6, "É" * 300_000, "en")])
    check(spark, [row(3, "ABC", "en")])
    assert proven(spark, [row(1, "a", "en")]).limit(0).count() == 0
    assert manifest.prove_documents(spark.createDataFrame([], SCHEMA)).count() == 0


def test_proofs_fold_by_themselves(spark):
    rows = [row(i, f"Text {i}" if i % 2 else f"text {i}", f"l{i % 11}") for i in range(300)]
    got = proven(spark, rows)
    folded = got.withColumn("again", manifest.fold_proof(F.col("leaf"), F.col("proof"), F.col("lefts"), F.col("rights")))
    assert folded.filter("again <> root").isEmpty()
    verified = {r.doc_id: r.folded_root == r.root for r in got.collect()}
    assert all(v == (i % 3 != 0 or i % 2 == 0) for i, v in verified.items())
