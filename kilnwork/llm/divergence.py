"""How far the term frequencies of sources lie apart, by frequent-pattern trees of term rows."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kilnwork.llm.batches import BLOCK_CHARS
from kilnwork.plans.stored import stored

#: Documents of a language that must hold a term, parts that a frequency is counted in, and what is added to each count.
MIN_DOCS, UNIT, PRIOR = 10, 1_000_000_000, 2
#: Term rows of a tree, and counts that a task holds before it hands them on.
TREE_ENTRIES, HELD_COUNTS = 500_000, 400_000
#: Bytes of UTF-8 as they count for terms: A-Z lowered, every other letter kept, all else white space.
BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def count_terms(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """``lang, source, term, n, docs``: occurrences of each term, and documents that hold it; a null term counts the documents.

    A term is a run of ASCII letters, lowered, and of characters beyond ASCII.
    Null columns are ''. Tasks count whole texts, in blocks of bounded size,
    and hand on partial counts.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        held = 0
        for batch in batches:
            langs, sources = batch.column("lang").to_pylist(), batch.column("source").to_pylist()
            pending = 0
            for group, text in zip(zip(langs, sources, strict=True), batch.column("text"), strict=True):
                data = text.as_py()
                terms = data.translate(BYTES).split()
                if group not in found:
                    found[group] = (Counter(), Counter())
                n, docs = found[group]
                held -= len(n)
                n.update(terms)
                docs.update(set(terms))
                docs[None] += 1
                held += len(n)
                pending += len(data)
                if held > HELD_COUNTS and pending > BLOCK_CHARS:
                    yield handed_on(found)
                    found, held, pending = {}, 0, 0
            if held > HELD_COUNTS:
                yield handed_on(found)
                found, held = {}, 0
        yield handed_on(found)

    slim = docs.select(*[F.coalesce(F.col(c), F.lit("")).cast("string").alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"))], F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    parts = slim.mapInArrow(count, "lang string, source string, term string, n long, docs long")
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def handed_on(found: dict[tuple[str, str], tuple[Counter, Counter]]) -> pa.RecordBatch:
    groups, sizes = list(found), [len(docs) for _, docs in found.values()]
    terms = [t for _, docs in found.values() for t in docs]
    return pa.RecordBatch.from_arrays([
        pa.array(np.repeat(np.array([g[0] for g in groups], dtype=object), sizes), pa.string()),
        pa.array(np.repeat(np.array([g[1] for g in groups], dtype=object), sizes), pa.string()),
        pa.array(terms, pa.binary()).cast(pa.string()),
        pa.array([n[t] for n, docs in found.values() for t in docs], pa.int64()),
        pa.array([d for _, docs in found.values() for d in docs.values()], pa.int64()),
    ], ["lang", "source", "term", "n", "docs"])


def share(count: Column, total: Column, terms: Column) -> Column:
    """The frequency in billionths, from 1: ``1 + floor(UNIT * (count + 2) / (total + 2 * terms))``, in whole numbers; null without terms."""
    over = F.lit(UNIT).cast("decimal(10,0)") * (count + PRIOR).cast("decimal(20,0)")
    under = (total + PRIOR * terms).cast("decimal(20,0)")
    return F.when(terms > 0, F.call_function("div", over, under) + 1)


def distance(p: Column, q: Column) -> Column:
    """``floor((p - q)^2 / (p + q))``, in whole numbers."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def _distances(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


class Tree:
    """A frequent-pattern tree: nodes of a source's frequency below the nodes of the sources before it, with the number of terms through each."""

    def __init__(self):
        self.at: dict[tuple[int, int, int], int] = {}
        self.parent, self.source, self.p, self.none, self.terms = [0], [-1], [1], [1], [0]
        self.numbers: dict[str, int] = {}
        self.entries = 0

    def insert(self, path: list[tuple[str, int, int]], times: int) -> None:
        """Add ``times`` terms whose sources, in order, have these frequencies; the last number is a source's frequency of a term it lacks."""
        node = 0
        for source, p, none in path:
            number = self.numbers.setdefault(source, len(self.numbers))
            key = (node, number, p)
            node = self.at.get(key)
            if node is None:
                node = self.at[key] = len(self.parent)
                self.parent.append(key[0]), self.source.append(number), self.p.append(p), self.none.append(none), self.terms.append(0)
            self.terms[node] += times
        self.entries += len(path)

    def corrections(self) -> Iterator[tuple[str, str, int]]:
        """For two sources that share terms: by how much the distances differ from what each source's terms give against a lacking one.

        A node meets each of its ancestors once, for all terms through it.
        """
        parent, source = np.array(self.parent), np.array(self.source)
        p, none, terms = (np.array(x, dtype=np.int64) for x in (self.p, self.none, self.terms))
        size = len(self.numbers)
        sums: dict[int, int] = {}
        node, above = np.arange(1, len(parent)), parent[1:]
        while True:
            node, above = node[above > 0], above[above > 0]
            if not len(node):
                break
            a, b, x, y = p[above], p[node], none[above], none[node]
            value = (_distances(a, b) - _distances(a, y) - _distances(x, b) + _distances(x, y)) * terms[node]
            pairs, where = np.unique(source[above] * size + source[node], return_inverse=True)
            total = np.zeros(len(pairs), dtype=np.int64)
            np.add.at(total, where, value)
            for pair, v in zip(pairs.tolist(), total.tolist(), strict=True):
                sums[pair] = sums.get(pair, 0) + v
            above = parent[above]
        names = list(self.numbers)
        for pair, v in sums.items():
            yield names[pair // size], names[pair % size], v


def pair_corrections(rows: DataFrame, tree_entries: int = TREE_ENTRIES) -> DataFrame:
    """``lang, a, b, value`` with a before b, from ``lang, path, terms``: rows of equal paths, with the number of terms that have it.

    Rows lie in the order of their paths, so paths that begin alike meet in a
    task's trees. A tree takes about ``tree_entries`` entries and then hands on
    its sums; corrections of terms add up, so results don't depend on the cut.
    """

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees: dict[str, Tree] = {}
        for batch in batches:
            for lang, path, times in zip(*(batch.column(c).to_pylist() for c in ("lang", "path", "terms")), strict=True):
                tree = trees.setdefault(lang, Tree())
                tree.insert([(e["source"], e["p"], e["none"]) for e in path], times)
                if tree.entries > tree_entries:
                    yield summed({lang: trees.pop(lang)})
        yield summed(trees)

    def summed(trees: dict[str, Tree]) -> pa.RecordBatch:
        found = [(lang, *c) for lang, tree in trees.items() for c in tree.corrections()]
        kinds = [pa.string(), pa.string(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], k) for i, k in enumerate(kinds)], ["lang", "a", "b", "value"])

    ordered = rows.repartitionByRange("lang", "path")
    return ordered.mapInArrow(grow, "lang string, a string, b string, value long").groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def audit_sources(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = 10, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """``lang, source, part, item, value, rank``: how a source's term frequencies differ from other sources and from its language.

    A language keeps the terms that at least ``min_docs`` of its documents
    hold. A source and a language give each kept term a frequency p in
    billionths (``share``). ``pair`` rows: the sum over all kept terms of
    ``distance`` between a source and each other one of its language, all of
    them. ``term`` rows: the ``top`` terms that a source uses more than its
    language does, by distance. Ranks follow value, largest first, then item
    in byte order.

    A term row lists the sources that have the term, in order, with their
    frequencies. Were every count 0, a pair would have the same distance at
    each term. A source's own terms change that by an amount that depends on
    the other source's share of an absent term alone, so rows of equal counts
    are summed first; what is left are terms that both have, and these go
    through the trees. The output has a row for each ordered pair of a
    language's sources; no other step forms pairs but those of a tree's paths.

    Nulls in text, language and source are ''. A source without terms has
    pairs like any other, and where a language keeps no term all values are 0.
    Repeated rows count as often as they occur. An empty table gives an empty
    result. Other columns are ignored, whatever they are called.
    """
    counts = stored(count_terms(docs, text_col, lang_col, source_col))
    found = F.struct("source", "n")
    kept = stored(counts.filter("term is not null").groupBy("lang", "term").agg(F.sum("docs").alias("in_docs"), F.sum("n").alias("of_lang"), F.sort_array(F.collect_list(found)).alias("entries")).filter(F.col("in_docs") >= min_docs))
    by_lang = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("of_lang").alias("lang_total"))
    entries = kept.select("lang", "term", "of_lang", F.inline("entries"))
    by_source = entries.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = stored(
        counts.filter("term is null").select("lang", "source").join(by_source, ["lang", "source"], "left").join(by_lang, "lang", "left")
        .select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("terms", F.lit(0)).alias("terms"), F.coalesce("lang_total", F.lit(0)).alias("lang_total"))
        .withColumn("none", share(F.lit(0), F.col("total"), F.col("terms")))
    )
    shares = stored(entries.join(groups, ["lang", "source"]).withColumns({
        "p": share(F.col("n"), F.col("total"), F.col("terms")), "q": share(F.col("of_lang"), F.col("lang_total"), F.col("terms")),
    }).select("lang", "source", "term", "p", "q", "none"))

    rows = shares.groupBy("lang", "term").agg(F.sort_array(F.collect_list(F.struct("source", "p", "none"))).alias("path"))
    both = stored(pair_corrections(rows.groupBy("lang", "path").agg(F.count("*").alias("terms"))))
    levels = shares.groupBy("lang", "source", "none", "p").agg(F.count("*").alias("times"))
    others = groups.select("lang", F.col("none").alias("other")).distinct()
    own = (distance(F.col("p"), F.col("other")) - distance(F.col("none"), F.col("other"))) * F.col("times")
    single = stored(levels.join(others, "lang").groupBy("lang", "source", "other").agg(F.sum(own).alias("own")))

    a, b = (groups.select("lang", F.col("source").alias(s), F.col("none").alias(f"none_{s}"), "terms") for s in ("x", "y"))
    pairs = a.join(b.drop("terms"), "lang").filter("x <> y").withColumns({"a": F.least("x", "y"), "b": F.greatest("x", "y")})
    of_x = single.select("lang", F.col("source").alias("x"), F.col("other").alias("none_y"), F.col("own").alias("own_x"))
    of_y = single.select("lang", F.col("source").alias("y"), F.col("other").alias("none_x"), F.col("own").alias("own_y"))
    met = pairs.join(of_x, ["lang", "x", "none_y"], "left").join(of_y, ["lang", "y", "none_x"], "left").join(both, ["lang", "a", "b"], "left")
    base = F.col("terms") * distance(F.col("none_x"), F.col("none_y"))
    value = base + F.coalesce("own_x", F.lit(0)) + F.coalesce("own_y", F.lit(0)) + F.coalesce("value", F.lit(0))
    pair = met.select("lang", F.col("x").alias("source"), F.lit("pair").alias("part"), F.col("y").alias("item"), F.coalesce(value, F.lit(0)).cast("long").alias("value"))
    above = shares.filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), distance(F.col("p"), F.col("q")).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    rank = F.row_number().over(order).alias("rank")
    return pair.select("*", rank).union(above.select("*", rank).filter(F.col("rank") <= top))
