"""Finite state machines over keyed rows, a long key by ranges at once."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from kilnwork.plans.folds import fold_sorted
from kilnwork.plans.running import PART, ranges
from kilnwork.plans.stored import stored


def step_table(moves: Mapping[str | None, Sequence[str]]) -> tuple[list[str | None], dict[str, list[int]]]:
    """All states, the first being the one before any row, and for each name of a step the state that follows each; a step not listed changes nothing."""
    states = [None, *dict.fromkeys(x for a, to in moves.items() for x in (a, *to) if x is not None)]
    at = {s: i for i, s in enumerate(states)}
    return states, {to: [at[to] if to in moves.get(s, ()) else i for i, s in enumerate(states)] for to in states if to is not None}


def fold_transitions(df: DataFrame, key: str, order: Sequence[str], column: str, moves: Mapping[str | None, Sequence[str]], step: Callable, schema: StructType) -> DataFrame:
    """Rows that ``step`` returns over each key in order, as ``fold_sorted`` does, for a machine whose steps ``moves`` lists.

    Rows are range-partitioned by key and order and stored, so a key may span
    many ranges. A range of a key is first reduced to a table: the state that
    it ends in for each that it may begin with. The tables of a key, one a
    range, are composed in order, which gives the state that each range begins
    with, and from there all ranges run at once. Null keys are one key.
    """
    states, steps = step_table(moves)
    ranged = ranges(df, [key, *order])

    def reduced(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, table = None, []
        for batch in batches:
            out = []
            for part, of, name in zip(batch[PART], batch[key], batch[column], strict=True):
                if now is None or part != now[0] or not (of == now[1] or (pd.isna(of) and pd.isna(now[1]))):
                    if now is not None:
                        out.append((*now, table))
                    now, table = (part, of), list(range(len(states)))
                then = steps.get(name)
                if then is not None:
                    table = [then[s] for s in table]
            yield pd.DataFrame(out, columns=["part", "of", "table"])
        if now is not None:
            yield pd.DataFrame([(*now, table)], columns=["part", "of", "table"])

    def composed(tables: pd.DataFrame) -> pd.DataFrame:
        ordered, state, entries = tables.sort_values("part", ignore_index=True), 0, []
        for table in ordered["table"]:
            entries.append(states[state])
            state = int(table[state])
        return ordered[["part", "of"]].assign(entry=entries)

    kind = df.schema[key].dataType.simpleString()
    sorted_rows = ranged.repartition(PART, key).sortWithinPartitions(PART, key, *order)
    tables = stored(sorted_rows.select(PART, key, column).mapInPandas(reduced, f"part int, of {kind}, table array<int>"))
    several = tables.groupBy(F.col("of").alias("again")).agg(F.count("*").alias("n")).filter("n > 1").drop("n")
    spanning = tables.join(several, F.col("of").eqNullSafe(F.col("again")), "left_semi")
    entries = spanning.groupBy("of").applyInPandas(composed, f"part int, of {kind}, entry string").filter("entry is not null")
    begun = ranged.join(entries, (F.col(PART) == F.col("part")) & F.col(key).eqNullSafe(F.col("of")), "left").select(PART, *df.columns, F.col("entry").alias("__entry"))

    def from_entry(state: dict | None, row: dict) -> tuple[dict, dict | None]:
        if state is None and isinstance(row["__entry"], str):
            state = {"status": row["__entry"]}
        return step(state, row)

    return fold_sorted(begun, [PART, key], list(order), from_entry, schema)
