"""Registry of runnable queries, each with the SQL text that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.sources.stand_ins import SQL_NEEDS, SQL_TABLES, Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def with_tables(*parts: str) -> str:
    """``WITH`` clause from names of input tables and further ``name AS (...)`` texts, in order."""
    texts: list[str] = []

    def add(part: str) -> None:
        if part in SQL_TABLES:
            for need in SQL_NEEDS.get(part, []):
                add(need)
            text = SQL_TABLES[part]
        else:
            text = part
        if text not in texts:
            texts.append(text)

    for p in parts:
        add(p)
    return "WITH RECURSIVE " + ",\n".join(texts) + "\n"


def tidy(df: DataFrame) -> DataFrame:
    """Integers as bigint, decimals as double, dates and timestamps as text, so results compare across engines."""
    columns = []
    for name, kind in df.dtypes:
        col = F.col(f"`{name}`")
        if kind in ("int", "smallint", "tinyint"):
            col = col.cast("bigint")
        elif kind == "float" or kind.startswith("decimal"):
            col = col.cast("double")
        elif kind in ("date", "timestamp", "timestamp_ntz"):
            col = col.cast("string")
        columns.append(col.alias(name))
    return df.select(*columns)


def query(name: str, check: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under ``name`` with its checking SQL."""

    def register(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = lambda spark, directory: tidy(fn(Tables(spark, directory)))
        if check is not None:
            CHECKS[name] = check
        return fn

    return register
