"""Tables and folders that all executors see.

A lineage is cut by writing a table into the folder the cluster names in ``spark.checkpoint.dir``: the table survives a
lost executor and its size is known to the planner, so it is broadcast only when it is really small.
"""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.session import shared_base


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder name under ``spark.checkpoint.dir``. Only a local session may go without that setting."""
    return f"{shared_base(spark)}/{name}-{uuid.uuid4().hex}"


def shared_table(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """The rows of ``df``, written as Parquet into the shared folder and read back."""
    path = shared_folder(df.sparkSession, name)
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def source_rank(sources: DataFrame) -> DataFrame:
    """Adds ``source_rank`` (0, 1, ...) to one row per source, by code point, null last."""
    from pyspark.sql import Window as W

    # one row per source, so a single sorted task stays small
    order = W.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    return sources.withColumn("source_rank", F.row_number().over(order) - 1)


BITMAP_BITS = 26


def bitmap_place(value: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(value), 64 - BITMAP_BITS)


def bitmap_of(values: DataFrame, value: Column) -> np.ndarray:
    """A bitmap of hashed values, 8 MB whatever their number, put together word by word before it comes to the driver.

    It only spares work: rows it lets through still meet an exact join. When very many values fill it, it spares nothing.
    """
    places = values.select(bitmap_place(value).alias("place"))
    words = places.select(F.floor(F.col("place") / 32).alias("word"), F.expr("shiftleft(1L, cast(place % 32 as int))").alias("bit"))
    table = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toPandas()
    out = np.zeros(1 << (BITMAP_BITS - 5), np.uint32)
    out[table["word"].to_numpy(np.int64)] = table["bits"].to_numpy(np.int64).astype(np.uint32)
    return out


def in_bitmap(bitmap: np.ndarray, place: np.ndarray) -> np.ndarray:
    return ((bitmap[place >> 5] >> (place & 31).astype(np.uint32)) & np.uint32(1)).astype(bool)
