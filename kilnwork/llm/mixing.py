"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kilnwork.plans.running import running_totals
from kilnwork.plans.stored import stored

#: Rows of a unit that are numbered together.
STRETCH = 1 << 16
#: A word is a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of words, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[int], max_copies: int) -> DataFrame:
    """Target of each source, from ``(source, source_size)``.

    Sources in code-point order, null last, take the weights in turn and share
    the sum of all sizes. A target stops at ``max_copies`` times its source's
    size, and the rest is shared again by weight. That is solved at once: in
    the order of size by weight, a source is held at its limit when its share
    of what the sources before it leave would exceed the limit.
    """
    ranked = running_totals(sizes, [F.col("source").asc_nulls_last()], {"number": F.lit(1)})
    turns = F.array(*[F.lit(w) for w in weights])
    wide = ranked.select(
        "source",
        F.col("source_size").cast("decimal(38,0)").alias("s"),
        F.element_at(turns, (F.pmod(F.col("number") - 1, F.lit(len(weights))) + 1).cast("int")).alias("w"),
    )
    ratio = (F.col("s").cast("double") / F.col("w"), F.col("source").asc_nulls_last())
    filled = running_totals(wide, ratio, {"s_to": F.col("s"), "w_to": F.col("w")})
    total = filled.agg(F.sum("s").alias("s_all"), F.sum("w").alias("w_all"))
    judged = filled.join(F.broadcast(total)).withColumn(
        "held",
        max_copies * F.col("s") * (F.col("w_all") - F.col("w_to") + F.col("w"))
        < F.col("w") * (F.col("s_all") - max_copies * (F.col("s_to") - F.col("s"))),
    )
    rest = judged.agg(
        F.sum(F.when(F.col("held"), F.col("s")).otherwise(0)).alias("s_held"),
        F.sum(F.when(F.col("held"), 0).otherwise(F.col("w"))).alias("w_free"),
    )
    share = ((F.col("s_all") - max_copies * F.col("s_held")) * F.col("w")).cast("double") / F.col("w_free")
    return judged.join(F.broadcast(rest)).select(
        "source",
        F.col("s").cast("long").alias("source_size"),
        F.when(F.col("held"), (max_copies * F.col("s")).cast("double")).otherwise(share).alias("target"),
    )


def mix_plan(
    docs: DataFrame,
    size: Column | None = None,
    weights: Sequence[int] = (1, 2, 3),
    max_copies: int = 3,
    seed: str = "mix",
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
) -> DataFrame:
    """How often the mix takes each document.

    Returns ``doc_id, source, size, source_size, target, copies, taken`` with
    one row per input row. Within a source every document expects
    target / source_size copies; the sums of these run over the documents in
    the order of size and id, one offset per source (drawn from ``seed``) is
    added, and a document is taken once for each integer passed. In that order
    the words taken differ from the target by about one document's size.

    Nulls: a null text has size 0, a null source is a source of its own, a
    null id is an id like any other. Rows that agree in id, source and size
    follow each other in that order; the integers passed over all of them are
    dealt to them evenly, so they differ by one copy at most. A source without
    words takes nothing. An empty table gives an empty plan. Other columns of
    ``docs`` are ignored, whatever they are called.
    """
    units = unit_plan(docs, size, weights, max_copies, seed, id_col, source_col, text_col)
    each = numbered_rows(units).withColumn("copies", unit_copies(F.col("one")))
    return each.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def numbered_rows(units: DataFrame) -> DataFrame:
    """Each unit as often as it has ``rows``, numbered from 1 as ``one``.

    A unit of more than STRETCH rows is first cut into stretches, which are
    dealt anew, so no array and no task grows with a unit.
    """
    few, many = units.filter(F.col("rows") <= STRETCH), units.filter(F.col("rows") > STRETCH)
    stretches = many.withColumn("at", F.explode(F.sequence(F.lit(0), F.expr(f"(rows - 1) div {STRETCH}")))).repartition("doc_id", "source", "size", "at")
    last = F.least(F.col("rows"), (F.col("at") + 1) * STRETCH)
    cut = stretches.withColumn("one", F.explode(F.sequence(F.col("at") * STRETCH + 1, last))).drop("at")
    return few.withColumn("one", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows")))).union(cut)


def unit_copies(number: Column) -> Column:
    """Copies of the row of this number, from 1, among the ``rows`` of a unit that share ``total`` copies."""
    return (F.floor(F.col("total") / F.col("rows")) + (number <= F.col("total") % F.col("rows")).cast("int")).cast("int")


def unit_plan(docs: DataFrame, size: Column | None, weights: Sequence[int], max_copies: int, seed: str, id_col: str, source_col: str, text_col: str) -> DataFrame:
    """``doc_id, source, size, rows, source_size, target, total``: the copies that all ``rows`` of an id, source and size take."""
    slim = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).alias("source"),
        (word_count(F.col(text_col)) if size is None else size.cast("long")).alias("size"),
    )
    units = stored(slim.groupBy("doc_id", "source", "size").agg(F.count("*").alias("rows")))
    sizes = units.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("source_size"))
    targets = source_targets(sizes, weights, max_copies)
    order = [F.col("source").asc_nulls_last(), F.col("size"), F.col("doc_id").asc_nulls_last()]
    ranked = running_totals(units, order, {"place": F.col("rows")})
    first = units.groupBy("source").agg(F.sum("rows").alias("units"))
    starts = running_totals(first, [F.col("source").asc_nulls_last()], {"units_to": F.col("units")}).select(
        F.col("source").alias("source_key"), (F.col("units_to") - F.col("units")).alias("start")
    )
    known = targets.join(starts, F.col("source").eqNullSafe(F.col("source_key"))).drop("source")
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce("source", F.lit("")))), 1, 8), 16, 10)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    place = F.col("place") - F.col("start")
    passed = lambda n: F.floor(n.cast("double") * F.col("rate") + F.col("offset"))
    return (
        ranked.join(known, F.col("source").eqNullSafe(F.col("source_key")))
        .withColumns({"rate": rate, "offset": offset.cast("double") / F.lit(4294967296.0)})
        .withColumn("total", passed(place) - passed(place - F.col("rows")))
        .select("doc_id", "source", "size", "rows", "source_size", "target", "total")
    )


def mix_sources(docs: DataFrame, size: Column | None = None, weights: Sequence[int] = (1, 2, 3), max_copies: int = 3, seed: str = "mix", id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """The mixed documents: each row of ``docs`` as often as ``mix_plan`` takes it.

    The columns are those of ``docs``. The plan is joined on id, source and
    size; texts move once. Rows that share these are numbered by a hash of
    their text, through ranges, as they may be many.
    """
    plan = stored(unit_plan(docs, size, weights, max_copies, seed, id_col, source_col, text_col).filter("total > 0"))
    plan = plan.select(*[F.col(c).alias(f"__{c}") for c in ("doc_id", "source", "size")], "rows", "total")
    keyed = docs.withColumn("__words", word_count(F.col(text_col)) if size is None else size.cast("long"))

    def on(rows: DataFrame, some: DataFrame) -> Column:
        return rows[id_col].eqNullSafe(some["__doc_id"]) & rows[source_col].eqNullSafe(some["__source"]) & (rows["__words"] == some["__size"])

    single, several = plan.filter("rows = 1"), plan.filter("rows > 1")
    taken = keyed.join(single, on(keyed, single)).select(*[keyed[c] for c in docs.columns], F.col("total").cast("int").alias("__copies"))
    if not several.isEmpty():
        shared = keyed.join(several, on(keyed, several), "left_semi")
        numbered = running_totals(shared, [F.xxhash64(text_col)], {"__number": F.lit(1)}, keys=[id_col, source_col, "__words"])
        dealt = numbered.join(several, on(numbered, several)).select(*[numbered[c] for c in docs.columns], unit_copies(F.col("__number")).alias("__copies"))
        taken = taken.union(dealt.filter("__copies > 0"))
    return taken.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select(*docs.columns)
