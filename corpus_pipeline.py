"""A pipeline over ``documents``: toxic texts go, copies and near copies go, sources are mixed, texts become pieces.

Every stage is ``(name, function)``; a function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next stage's docs. All but the last return the columns of docs. Verdicts travel as narrow
tables and go by row: where doc_ids are null or occur twice, such rows get numbers of their own for the time of a stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.llm import toxicity as toxic
from attesta.llm.exact_dedup import exact_dedup as find_exact
from attesta.llm.mixing import mix
from attesta.llm.ngram_join import ngram_join
from attesta.llm.pieces import encode
from attesta.llm.shared import shared_table
from attesta.sources.tables import read_table


def _rows(docs: DataFrame) -> DataFrame:
    """(doc, number): every row of docs as a struct with a number of its own, its doc_id where that names it alone.

    Other rows (null doc_ids, all but one row of a doc_id that occurs again) are written with their row numbers first, so
    that a number stays with its row, and are numbered behind the largest doc_id, before the smallest one if there is no
    room behind. Docs without such rows are read as they are.
    """
    doc = F.struct(*docs.columns).alias("doc")
    if docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 OR doc_id IS NULL").isEmpty():
        return docs.select(doc, F.col("doc_id").alias("number"))
    rows = shared_table(docs.select(doc, F.monotonically_increasing_id().alias("row")), "rows")
    ids = rows.select(F.col("doc.doc_id").alias("doc_id"), "row")
    first = ids.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("row").alias("row"))
    low, high, last = ids.agg(F.coalesce(F.min("doc_id"), F.lit(0)), F.coalesce(F.max("doc_id"), F.lit(0)), F.max("row")).first()
    start = high + 1 if high + 1 + last < 1 << 63 else low - 1 - last
    more = shared_table(ids.join(first, "row", "left_anti").select("row", (F.col("row") + start).alias("more")), "more")
    return rows.join(more, "row", "left").select("doc", F.coalesce("more", "doc.doc_id").alias("number"))


def _named(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """The documents of rows, with their numbers as doc_ids."""
    return rows.select(*[F.col("number").alias(c) if c == "doc_id" else F.col("doc")[c].alias(c) for c in docs.columns])


def _without(rows: DataFrame, verdicts: DataFrame, stays) -> DataFrame:
    """The documents of rows whose verdict says that they stay."""
    dropped = verdicts.where(~stays).select(F.col("doc_id").alias("number"))
    return rows.join(shared_table(dropped, "dropped"), "number", "left_anti").select("doc.*")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is below 0.3; learns from the labels of documents that are there."""
    model, rows = toxic.fit(docs, read_table(spark, sf_dir, "labels")), _rows(docs)
    scored = toxic.score(_named(docs, rows).select("doc_id", "text"), model).select("doc_id", "predicted")
    return _without(rows, scored, F.col("predicted") == 0)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that are equal but for white space."""
    rows = _rows(docs)
    return _without(rows, find_exact(_named(docs, rows)), F.col("kept"))


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group linked by five-word shingles at a similarity of 0.75."""
    rows = _rows(docs)
    return _without(rows, ngram_join(_named(docs, rows)), F.col("doc_id") == F.col("component_id"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as many times as the mix takes it (0, 1 or 2); documents without words are not taken."""
    rows = _rows(docs)
    taken = mix(_named(docs, rows)).where("taken > 0").select(F.col("doc_id").alias("number"), (F.col("taken") / F.col("size")).cast("int").alias("times"))
    turns = F.explode(F.sequence(F.lit(1), F.col("times"))).alias("turn")
    return rows.join(shared_table(taken, "taken"), "number").select("doc", turns).select("doc.*")


def piece_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every text and whether decoding them gives the text back."""
    return encode(docs.select("doc_id", "source", "text")).drop("text")


STAGES = [
    ("toxicity", toxicity),
    ("exact_dedup", exact_dedup),
    ("ngram_jaccard", ngram_jaccard),
    ("source_mixing", source_mixing),
    ("piece_encoding", piece_encoding),
]

# toxicity and pieces are beyond SQL; tests hold the stages against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = shared_table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
