"""Reading Parquet tables and small dimension tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """One Parquet table (a file or a directory of files) of a data directory."""
    return spark.read.parquet(f"{directory.rstrip('/')}/{name}.parquet")


def _sql_literal(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "TRUE" if value else "FALSE"
    if isinstance(value, (int, float)):
        return str(value)
    return "'" + str(value).replace("'", "''") + "'"


def values_sql(rows: list[tuple], schema: str) -> str:
    """A fixed-size table as ``SELECT ... FROM (VALUES ...)``; ``schema`` is ``"name type, name type"``."""
    fields = [part.split() for part in schema.split(",")]
    names = ", ".join(f[0] for f in fields)
    casts = ", ".join(f"CAST({n} AS {t}) AS {n}" for n, t in fields)
    body = ", ".join("(" + ", ".join(_sql_literal(v) for v in row) + ")" for row in rows)
    return f"SELECT {casts} FROM (VALUES {body}) AS fixed_rows({names})"


def dimension(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A dimension table written in code. Its size is fixed, so it is safe to broadcast."""
    return F.broadcast(spark.sql(values_sql(rows, schema)))


def lookup(key: Column, rows: list[tuple], default: Column | None = None) -> Column:
    """Map a key through a short fixed table inside the projection, without a join."""
    table = F.create_map(*[F.lit(v) for row in rows for v in row[:2]])
    found = F.try_element_at(table, F.coalesce(key.cast("string"), F.lit("")))
    return found if default is None else F.coalesce(found, default)
