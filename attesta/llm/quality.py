"""Quality rules per document and verdicts per host.

A document fails by itself when it is too short or mostly repeats its own word triples. Failures are then summed per host;
a host's failure rate is shrunk towards the rate of the whole corpus by a beta prior that is fitted to the spread of the
host rates (method of moments), so a host with few documents is judged mildly. Documents of a host whose shrunk rate is
above the limit fail with it. Only one short row per host is joined back.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attesta.llm.batches import SPACE, Words, chunks, mix, run_sums, window_hashes
from attesta.llm.shared import shared_table

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_FIRST_OF_POINT = (np.arange(256) & 0xC0) != 0x80  # bytes that begin a code point

MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _repeated_words(words: Words) -> np.ndarray:
    """Per row: words that lie in a three-word window found at least twice in the row."""
    window = window_hashes(words.hashes(), 3)
    rows = words.row
    inside = rows[: len(window)] == rows[2: 2 + len(window)]
    key = mix(window ^ mix(rows[: len(window)].astype(np.uint64)))  # the same window in another row is another one
    place = np.flatnonzero(inside)
    order = place[np.argsort(key[place], kind="stable")]
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(order), bool)
    twice[1:] |= same
    twice[:-1] |= same
    covered = np.zeros(len(rows), bool)
    for step in range(3):
        covered[order[twice] + step] = True
    return run_sums(covered.astype(np.int64), words.first)


def _repeated_lines(data: np.ndarray, at: np.ndarray) -> list[int]:
    """Per row: lines with a word that equal an earlier line."""
    out, raw = [], data.tobytes()
    for s, e in zip(at[:-1].tolist(), at[1:].tolist()):
        lines = [x for x in raw[s:e].split(b"\n") if x.strip(b" \t\r\x0b\x0c")]
        out.append(len(lines) - len(set(lines)))
    return out


def measure(documents: DataFrame, *others: str) -> DataFrame:
    """The five measures of every whole text (null: none of anything), beside doc_id and the named columns."""
    rows = documents.select("doc_id", *others, "text")
    kept = [f for f in rows.schema.fields if f.name != "text"]

    def read(batches):
        for batch in batches:
            found = np.zeros((5, batch.num_rows), np.int64)
            for first, last, data, at in chunks(batch.column(batch.num_columns - 1)):
                words = Words(data, at, lower=False)
                part = found[:, first:last]
                part[0] = words.count
                part[1] = run_sums((~SPACE[data] & _FIRST_OF_POINT[data]).astype(np.int64), at)
                part[2] = run_sums(_SYMBOL[data].astype(np.int64), at)
                part[3] = _repeated_lines(data, at)
                part[4] = _repeated_words(words)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *[pa.array(x) for x in found]], names=[*[f.name for f in kept], *MEASURES])

    return rows.mapInArrow(read, T.StructType([*kept, *[T.StructField(m, T.LongType()) for m in MEASURES]]))


def base_failed(min_words: int, max_repeat_percent: int) -> Column:
    return (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))


def host_verdicts(documents: DataFrame, host: str, max_rate: float) -> DataFrame:
    """One row per host: documents, failures, rate (shrunk) and ``host_failed``.

    The prior is beta(m * s, (1 - m) * s) with m the failure rate of all documents and s from the variance of the host
    rates, each host weighted by its documents, above the binomial variance. Hosts that do not differ more than chance
    allows get a very strong prior.
    """
    hosts = documents.groupBy(host).agg(F.count("*").alias("host_documents"), F.sum(F.col("base_failed").cast("long")).alias("host_failures"))
    n, k = F.col("host_documents"), F.col("host_failures")
    totals = hosts.agg(F.sum(n).alias("n_all"), F.sum(k).alias("k_all"), F.count("*").alias("n_hosts"),
                       F.sum(k * k / n).alias("square_rates"))  # sum of n * rate^2
    m = F.col("k_all") / F.col("n_all")
    between = F.col("square_rates") / F.col("n_all") - m * m  # weighted variance of host rates
    within = m * (1 - m) * F.col("n_hosts") / F.col("n_all")  # what chance alone gives
    spread = F.greatest(between - within, m * (1 - m) * 1e-4)
    prior = totals.select(m.alias("mean"), F.greatest(m * (1 - m) / F.when(spread > 0, spread).otherwise(1.0) - 1, F.lit(1.0)).alias("strength"))
    mean, strength = (float(x) if x is not None else 1.0 for x in prior.agg(F.first("mean"), F.first("strength")).first())
    shrunk = (k + F.lit(mean) * F.lit(strength)) / (n + F.lit(strength))
    return hosts.select(host, "host_documents", "host_failures", shrunk.alias("host_rate"), (shrunk > max_rate).alias("host_failed"))


def quality_rules(documents: DataFrame, host: str = "source", min_words: int = 50, max_repeat_percent: int = 50, max_host_rate: float = 0.6) -> DataFrame:
    """One row per document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, host_rate, kept.

    Texts are read whole; null counts as an empty text, which fails. A null host is a host of its own. Repeated rows are
    measured one by one; a table without rows gives none. ``kept`` is false when the document fails by itself or its
    host's shrunk failure rate is above ``max_host_rate``.
    """
    measured = shared_table(measure(documents, host).withColumn("base_failed", base_failed(min_words, max_repeat_percent)), "measured")
    verdicts = shared_table(host_verdicts(measured, host, max_host_rate), "hosts").withColumnRenamed(host, "_host")
    return measured.join(verdicts, measured[host].eqNullSafe(F.col("_host"))).select(
        "doc_id", *MEASURES, "base_failed", "host_rate", (~F.col("base_failed") & ~F.col("host_failed")).alias("kept"))
