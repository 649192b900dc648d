"""Ordered folds over keyed rows, one batch at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType


def fold_sorted(df: DataFrame, keys: Sequence[str], order: Sequence[str], step: Callable[[dict | None, dict], tuple[dict, dict | None]], schema: str | StructType) -> DataFrame:
    """Rows that ``step`` returns for (state, row) over the rows of each key in order; None returns no row.

    Rows are dealt by key and sorted within partitions, so a task streams its
    keys one after another and holds one state and one batch, however long a
    key is. The state of a key starts as None.
    """
    columns = (StructType.fromDDL(schema) if isinstance(schema, str) else schema).fieldNames()
    keys = list(keys)

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = (), None  # keys are not empty, so no key equals ()
        for batch in batches:
            out = []
            for row in batch.to_dict("records"):
                key = tuple(None if row[k] is None or row[k] != row[k] else row[k] for k in keys)
                if key != now:
                    now, state = key, None
                state, found = step(state, row)
                if found is not None:
                    out.append({**row, **found})
            yield pd.DataFrame(out, columns=columns)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(fold, schema)
