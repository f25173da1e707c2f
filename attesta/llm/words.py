"""Word counts of whole texts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from attesta.llm.batches import Words, chunks


def count_words(rows: DataFrame) -> DataFrame:
    """Replaces ``text`` by ``size``: the number of words ``[^\\x20\\x09-\\x0D]+`` in it (null: 0). Other columns stay."""
    others = [f for f in rows.schema.fields if f.name != "text"]

    def count(batches):
        for batch in batches:
            text = batch.column(batch.schema.get_field_index("text"))
            size = np.zeros(batch.num_rows, np.int64)
            for first, last, data, at in chunks(text):
                size[first:last] = Words(data, at).count
            keep = [batch.column(batch.schema.get_field_index(f.name)) for f in others]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(size)], names=[*[f.name for f in others], "size"])

    return rows.mapInArrow(count, T.StructType([*others, T.StructField("size", T.LongType())]))
