"""Ranks and limits per group that survive a group holding a third of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def top_k(df: DataFrame, group: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """First k rows per group. The limit on the row number lets Spark cut every partition to k rows before the shuffle."""
    w = W.partitionBy(*group).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def full_rank(df: DataFrame, group: list[str], coarse: list[tuple[str, Column]], fine: list[Column], rank: str) -> DataFrame:
    """Row number within each group, for all rows, without sorting a whole group in one task.

    ``coarse`` names leading sort keys that cut a group into buckets. Rows are numbered inside their bucket, and the
    number of rows in earlier buckets, known from one combined count, is added.
    """
    names = [n for n, _ in coarse]
    keyed = df.select("*", *[c.alias(n) for n, c in coarse])
    sizes = keyed.groupBy(*group, *names).agg(F.count("*").alias("bucket_rows"))
    earlier = W.partitionBy(*group).orderBy(*names).rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.withColumn("before", F.coalesce(F.sum("bucket_rows").over(earlier), F.lit(0))).drop("bucket_rows")
    inside = F.row_number().over(W.partitionBy(*group, *names).orderBy(*fine))
    return (keyed.withColumn("inside", inside).join(offsets, [*group, *names])
            .withColumn(rank, F.col("inside") + F.col("before")).drop("inside", "before", *names))


def last_before(df: DataFrame, group: list[str], order: str, values: dict[str, Column], block_rows: int = 100_000) -> DataFrame:
    """Adds, per name, the last non-null value of an expression among the earlier rows of the group (by an integer order).

    The group's log is cut into blocks of the order column: rows look back inside their block, and what earlier blocks
    end with is known from one combined aggregation, so a long log of one key is not read by a single task.
    """
    keyed = df.select("*", F.floor(F.col(order) / block_rows).alias("_block"), *[v.alias(f"_v_{n}") for n, v in values.items()])
    ends = keyed.groupBy(*group, "_block").agg(*[
        F.max(F.when(F.col(f"_v_{n}").isNotNull(), F.struct(order, f"_v_{n}"))).alias(f"_e_{n}") for n in values])
    earlier = W.partitionBy(*group).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    carried = ends.select(*group, "_block", *[F.last(f"_e_{n}", ignorenulls=True).over(earlier)[f"_v_{n}"].alias(f"_c_{n}") for n in values])
    inside = W.partitionBy(*group, "_block").orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    looked = keyed.select("*", *[F.last(f"_v_{n}", ignorenulls=True).over(inside).alias(f"_i_{n}") for n in values])
    out = looked.join(carried, [*group, "_block"], "left").withColumns({n: F.coalesce(f"_i_{n}", f"_c_{n}") for n in values})
    return out.select(*df.columns, *values)
