"""Names of queries, what runs them, and the SQL to compare with."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from kilnwork.queries.built import BUILT
from kilnwork.queries.views import VIEWS

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "conversations")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


class Inputs:
    """The tables of one folder and the views derived from them, as DataFrames by name."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._found: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name not in self._found:
            if name in BUILT:
                self._found[name] = BUILT[name](self)
            elif name in VIEWS:
                body = VIEWS[name]
                frames = {n: getattr(self, n) for n in names_in(body)}
                for n in frames:
                    body = re.sub(rf"\b{n}\b(?=\s|$|\))(?<!\.)", f"{{{n}}}", body)
                self._found[name] = self.spark.sql(body, **frames)
            elif name in TABLES:
                self._found[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
            else:
                raise AttributeError(name)
        return self._found[name]


def names_in(sql: str) -> list[str]:
    """Tables and views that follow FROM or JOIN."""
    found = re.findall(r"\b(?:FROM|JOIN)\s+(\w+)", sql)
    return [n for n in dict.fromkeys(found) if n in VIEWS or n in TABLES]


def with_views(sql: str) -> str:
    """``sql`` after the definitions of the views it uses, directly or through others."""
    order: list[str] = []

    def need(body: str) -> None:
        for name in re.findall(r"\bfx_\w+", body):
            if name in VIEWS and name not in order:
                need(VIEWS[name])
                if name not in order:
                    order.append(name)

    need(sql)
    if not order:
        return sql
    recursive = "RECURSIVE " if re.match(r"\s*WITH RECURSIVE", sql) else ""
    own = re.sub(r"^\s*WITH (RECURSIVE )?", "", sql) if re.match(r"\s*WITH\b", sql) else None
    views = ",\n".join(f"{n} AS ({VIEWS[n]})" for n in order)
    return f"WITH {recursive}{views}{',' if own else ''}\n{own or sql}"


def query(name: str, sql: str | None = None):
    """Register a function of Inputs under ``name``."""

    def register(f: Callable[[Inputs], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(Inputs(spark, sf_dir))
        if sql is not None:
            ORACLE_SQL[name] = with_views(sql)
        return f

    return register
