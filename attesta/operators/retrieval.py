"""Passage retrieval per case: lexical scores, vector similarity, rank fusion, evidence gaps and call batches."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from functools import partial, reduce
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from attesta.functions import fixed_values as fixed
from attesta.functions import text as X
from attesta.session import cut_lineage, dropped, scratch_folder, written
from attesta.operators import latent
from attesta.operators.latent import start_vectors  # noqa: F401  for those who knew it here
from attesta.operators.ranking import full_rank, top_k


# ------------------------------------------------------------------------------------------------ lexical
def corpus_stats(passages: DataFrame) -> DataFrame:
    """Per case and term: passages holding it and total uses, with the case's passage count and mean length.

    One combined aggregation over exploded tokens; a token counts for the passage frequency only at its first position.
    """
    tokens = passages.select("case_id", X.tokenize(F.col("text")).alias("tk"))
    sizes = passages.select("case_id", _length(F.col("text")).alias("dl")).groupBy("case_id").agg(
        F.count("*").alias("n_passages"), F.avg("dl").alias("avg_len"))
    terms = (
        tokens.select("case_id", "tk", F.posexplode("tk").alias("pos", "term"))
        .select("case_id", "term", (F.array_position("tk", F.col("term")) == F.col("pos") + 1).alias("is_first"))
        .groupBy("case_id", "term").agg(F.count_if("is_first").alias("df"), F.count("*").alias("uses"))
    )
    return terms.join(sizes, "case_id")


def _length(text: Column) -> Column:
    return F.size(F.filter(X.raw_tokens(text), X.is_index_word))


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, case_id, query) -> stemmed terms with their repeat count."""
    return queries.select("query_id", "case_id", F.explode(X.tokenize(F.col("query"))).alias("term")).groupBy(
        "query_id", "case_id", "term").agg(F.count("*").alias("qn"))


def token_index(passages: DataFrame) -> DataFrame:
    """Passages as stem lists (``tk``), written once into the shared folder: every statistic and score reads from it."""
    return cut_lineage(passages.select("case_id", "passage_id", "source_id", "seq", X.tokenize(F.col("text")).alias("tk")))


def bm25_scores(passages: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, case_id, passage_id, source_id, seq, bm25) of every passage of the query's case that shares a term.

    ``passages`` is a ``token_index``, or passages with text, which are indexed first, so texts are read and stemmed once.
    Only terms some query of the case asks for are shuffled.
    """
    terms = query_terms(queries)
    tokens = passages if "tk" in passages.columns else token_index(passages)
    sizes = tokens.select("case_id", F.size("tk").alias("dl")).groupBy("case_id").agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    wanted = terms.select("case_id", "term").distinct()
    tf = (
        tokens.select("case_id", "passage_id", "source_id", "seq", F.size("tk").alias("dl"), F.explode("tk").alias("term"))
        .join(wanted, ["case_id", "term"], "left_semi")
        .groupBy("case_id", "term", "passage_id", "source_id", "seq", "dl").agg(F.count("*").alias("f"))
    )
    df = tf.groupBy("case_id", "term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighted = terms.join(df, ["case_id", "term"]).join(sizes, "case_id").select(
        "case_id", "term", "query_id", "avgdl", (idf * (1 + fixed.REPEAT_BOOST * (F.col("qn") - 1))).alias("weight"))
    k1, b = fixed.BM25_K1, fixed.BM25_B
    share = F.col("f") * (k1 + 1) / (F.col("f") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    return (
        tf.join(weighted, ["case_id", "term"])
        .groupBy("query_id", "case_id", "passage_id", "source_id", "seq")
        .agg(F.sum(F.col("weight") * share).alias("bm25"))
    )


def bm25_topk(passages: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    scores = bm25_scores(passages, queries).withColumn("bm25", F.round("bm25", 6))
    return top_k(scores, ["query_id"], [F.desc("bm25"), F.asc("source_id"), F.asc("seq")], k)


def variable_query(fields: DataFrame, most_options: int | None = fixed.QUERY_OPTIONS, note_chars: int | None = fixed.QUERY_NOTE_CHARS) -> DataFrame:
    """(field_id, name, definition, labels, options, notes) -> search text of each codebook variable.

    Options and notes enter up to the given numbers; ``None`` takes all of them.
    """
    options = F.col("options") if most_options is None else F.slice("options", 1, most_options)
    notes = F.coalesce(F.col("notes"), F.lit(""))
    notes = notes if note_chars is None else F.substring(notes, 1, note_chars)
    words = F.array_join(F.filter(F.split(F.lower("name"), r"[^\p{L}\p{N}]+"), lambda w: w != ""), " ")
    parts = F.concat_ws(" ", words, words, F.coalesce("definition", F.lit("")), F.array_join("labels", " "),
                        F.array_join(options, " "), notes)
    built = fields.select("field_id", "name", F.regexp_replace(parts, " +", " ").alias("base")).withColumn("blob", F.lower("base"))
    # most texts hold few of the keys, which a plain search tells before a pattern looks for the start of a word
    extra = [F.when(F.col("blob").contains(key) & F.col("blob").rlike(rf"\b{key}"), words) for key, words in fixed.QUERY_EXPANSIONS]
    return built.select("field_id", "name", F.concat_ws(" ", "base", *extra).alias("query"))


# ------------------------------------------------------------------------------------------------ vectors
def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def with_norm(vectors: DataFrame) -> DataFrame:
    """Doubles and their norm, computed once per vector and not once per comparison."""
    v = vectors.withColumn("embedding", F.col("embedding").cast("array<double>"))
    return v.withColumn("norm", F.sqrt(_dot(F.col("embedding"), F.col("embedding"))))


def semantic_scores(vectors: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, case_id, vector columns, semantic): cosine of each query with the vectors of its case, above the floor.

    Queries are codebook variables, so a case has a bounded number of them.
    """
    q = with_norm(queries).select("query_id", "case_id", F.col("embedding").alias("q"), F.col("norm").alias("q_norm"))
    joined = with_norm(vectors).join(q, "case_id")
    cosine = _dot(F.col("embedding"), F.col("q")) / ((F.col("norm") + 1e-9) * (F.col("q_norm") + 1e-9))
    return joined.withColumn("semantic", F.round(cosine, 6)).drop("embedding", "norm", "q", "q_norm").where(
        F.col("semantic") > fixed.MIN_COSINE)


def mean_vectors(vectors: DataFrame, *keys: str) -> DataFrame:
    """Mean vector per key, averaged per dimension with combined aggregation."""
    dims = vectors.select(*keys, F.posexplode(F.col("embedding").cast("array<double>")).alias("dim", "x"))
    means = dims.groupBy(*keys, "dim").agg(F.avg("x").alias("x"))
    return means.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("dim", "x"))).alias("d")).select(
        *keys, F.transform("d", lambda e: e["x"]).alias("embedding"))


def semantic_cells(vectors: DataFrame, centres: int = 16) -> tuple[DataFrame, DataFrame]:
    """(vectors with ``cell`` and ``angle``, one row per case and cell with its centre, size and angles).

    A case's cells form around the ``centres`` vectors with the smallest hashes; a vector belongs to the nearest centre and
    keeps its angle to it. Any choice of centres gives the same results; near ones make tighter bounds.
    """
    unit = with_norm(vectors).where("norm > 0").withColumn("unit", F.transform("embedding", lambda x: x / F.col("norm")))
    chosen = top_k(unit.select("case_id", "unit", F.xxhash64("unit").alias("h")), ["case_id"], [F.asc("h")], centres, "cell")
    around = chosen.groupBy("case_id").agg(F.collect_list(F.struct("cell", F.col("unit").alias("v"))).alias("around"))
    near = F.array_max(F.transform("around", lambda c: F.struct(_dot(F.col("unit"), c["v"]).alias("cosine"), (-c["cell"]).alias("minus"))))
    held = unit.join(around, "case_id").withColumn("near", near).drop("around", "unit")
    held = cut_lineage(held.select("*", (-F.col("near.minus")).alias("cell"), _angle(F.col("near.cosine")).alias("angle")).drop("near"))
    cells = held.groupBy("case_id", "cell").agg(F.count("*").alias("members"), F.min("angle").alias("inner"), F.max("angle").alias("outer"))
    return held, cells.join(chosen.select("case_id", "cell", F.col("unit").alias("centre")), ["case_id", "cell"])


def _angle(cosine: Column) -> Column:
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine)))


def semantic_topk(vectors: DataFrame, queries: DataFrame, tie: list[str], k: int, centres: int = 16) -> tuple[DataFrame, DataFrame]:
    """(the k vectors of highest cosine per query with their rank, the number of vectors each query was compared with).

    The same as ranking ``semantic_scores``, but most vectors are never compared: by the triangle inequality the angle between
    query and vector is at least the difference of their angles to the centre of the vector's cell. A first round compares
    each query with the members of its nearest cells, until these hold k; the k-th best cosine found is a bound, and a second
    round compares only vectors that may reach it. ``tie`` names the columns that order equal cosines.
    """
    held, cells = semantic_cells(vectors, centres)
    q = with_norm(queries).where("norm > 0").select("query_id", "case_id", "embedding", F.transform("embedding", lambda x: x / F.col("norm")).alias("unit"))
    # one row per query and cell: both are few per case
    met = q.join(cells, "case_id").withColumn("to_centre", _angle(_dot(F.col("unit"), F.col("centre")))).drop("unit", "centre")
    order = W.partitionBy("query_id").orderBy("to_centre", "cell").rowsBetween(W.unboundedPreceding, -1)
    met = cut_lineage(met.withColumn("nearer", F.coalesce(F.sum("members").over(order), F.lit(0))))
    keep = [c for c in vectors.columns if c not in ("case_id", "embedding")]

    def compared(pairs: DataFrame, may: Column | None) -> DataFrame:
        q_norm = F.sqrt(_dot(F.col("q"), F.col("q")))
        both = held.join(pairs.select("query_id", "case_id", "cell", "to_centre", F.col("embedding").alias("q"), *(["least"] if may is not None else [])), ["case_id", "cell"])
        both = both if may is None else both.where(may)
        cosine = _dot(F.col("embedding"), F.col("q")) / ((F.col("norm") + 1e-9) * (q_norm + 1e-9))
        return both.select("query_id", "case_id", *keep, F.round(cosine, 6).alias("semantic"))

    first = cut_lineage(compared(met.where(F.col("nearer") < k), None))
    enough = top_k(first, ["query_id"], [F.desc("semantic")], k, "place").where(F.col("place") == k).select("query_id", F.col("semantic").alias("kth"))
    # cosines are compared after rounding, so the bound leaves room for it
    least = F.greatest(F.coalesce("kth", F.lit(fixed.MIN_COSINE)), F.lit(fixed.MIN_COSINE)) - 2e-6
    further = met.where(F.col("nearer") >= k).join(enough, "query_id", "left").withColumn("least", least)
    gap = F.greatest(F.lit(0.0), F.col("to_centre") - F.col("outer"), F.col("inner") - F.col("to_centre"))
    second = cut_lineage(compared(further.where(F.cos(gap) >= F.col("least")), F.cos(F.col("to_centre") - F.col("angle")) >= F.col("least")))
    scored = first.unionByName(second)
    ranked = top_k(scored.where(F.col("semantic") > fixed.MIN_COSINE), ["query_id"], [F.desc("semantic"), *[F.asc(c) for c in tie]], k)
    return ranked, scored.groupBy("query_id").agg(F.count("*").alias("compared"))


# ------------------------------------------------------------------------------------------------ latent semantics
BLOCK_TOKENS = 11 << 20
RANK_RANGE = 100_000


class LatentModel(NamedTuple):
    """Per case: ``basis`` (case_id, term, idf, vector), the terms' places in the latent space, and ``passages`` (the passage's
    columns and its unit ``embedding``)."""

    basis: DataFrame
    passages: DataFrame


def _vector_sums(rows: DataFrame, *keys: str) -> DataFrame:
    """Sum of ``w * vector`` per key, combined before the shuffle."""
    total = Summarizer.metrics("sum").summary(array_to_vector("vector"), F.col("w"))
    return rows.groupBy(*keys).agg(total.alias("s")).select(*keys, vector_to_array("s.sum").alias("vector"))


def _unit(vector: Column) -> Column:
    norm = F.sqrt(_dot(vector, vector)) + 1e-9
    return F.transform(vector, lambda x: x / norm)


def _by_group(rows: DataFrame, second: str, work: Callable[..., Iterator[pa.RecordBatch]], schema: StructType | str, *more: str) -> DataFrame:
    """``work`` on all rows of a case and block (or segment), batch by batch; it gets the values of the keys first."""

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return work(*[k.as_py() for k in key], batches)

    return rows.groupBy("case_id", second, *more).applyInArrow(run, schema)


def _large_cases(dealt: DataFrame, made: StructType, columns: list[str], asks: latent.Asks, sizes: dict[int, int]) -> DataFrame:
    """The rounds of cases of several blocks, each of which is one task's work.

    Blocks are kept as counts of terms. In a round only vectors of terms that several blocks hold travel: to the task that sums
    a segment of them, and back. A matrix of (dimensions + oversample) squared per case is turned on the driver, and such a case has
    ``BLOCK_TOKENS`` words or more. What a round has written goes as soon as nothing reads it any more.
    """
    spark = dealt.sparkSession
    folders: list[str] = []
    options = {"compression": "zstd", "parquet.block.size": str(1 << 24)}
    settings = {"spark.sql.execution.arrow.maxBytesPerBatch": "16m", "spark.sql.maxConcurrentOutputFileWriters": "8"}  # no sort by kind

    def held(df: DataFrame) -> DataFrame:
        folders.append(scratch_folder(spark))
        return written(df, folders[-1], options, settings, ["_kind"])

    def grams(*tables: DataFrame) -> dict[int, np.ndarray]:
        found: dict[int, np.ndarray] = {}
        for row in [r for t in tables for r in t.where("_kind = 'gram'").select("case_id", "_data").toLocalIterator()]:
            found[row.case_id] = found.get(row.case_id, 0) + pickle.loads(row._data)
        return found

    of = lambda table, *kinds: table.where(F.col("_kind").isin(*kinds))
    parts = held(_by_group(dealt, "_block", partial(latent.first_parts, columns, asks), latent.PART_ROW))
    known = held(_by_group(of(parts, "terms"), "_segment", latent.known_terms, latent.PART_ROW))
    terms: dict[int, int] = {}
    for row in of(known, "size").select("case_id", "_data").toLocalIterator():
        terms[row.case_id] = terms.get(row.case_id, 0) + pickle.loads(row._data)
    spaces = {c: latent.space(n, terms.get(c, 0), asks.dimensions, asks.oversample) for c, n in sizes.items()}
    matrices, state = None, None
    for turn in range(asks.iterations + 1):
        last = turn == asks.iterations
        kinds = ["counts", *(["terms"] if last or not turn else []), *(["names", "blank"] if last else [])]
        rows = of(parts, *kinds).unionByName(of(known, "known"))
        rows = reduce(DataFrame.unionByName, [rows, *([of(state[0], "state"), of(state[1], "down")] if state else [])])
        step = held(_by_group(rows, "_block", partial(latent.block_round, spaces, matrices, last), latent.PART_ROW))
        for folder in folders[2:-1]:
            dropped(spark, folder)
        del folders[2:-1]
        if not last:
            summed = held(_by_group(of(step, "up"), "_segment", latent.summed_terms, latent.PART_ROW))
            dropped(spark, f"{folders[-2]}/_kind=up")
            state = step, summed
            matrices = {c: latent.orthonormal(g) for c, g in grams(*state).items()}
    turns = {c: latent.leading(g, spaces[c].k) for c, g in grams(step).items()}
    for folder in folders[:2]:
        dropped(spark, folder)
    return of(step, "made", "blank", "basis").mapInArrow(partial(latent.last_rows, to_arrow_schema(made), spaces, turns), made)


def lsa_model(passages: DataFrame, dimensions: int = 120, iterations: int = 3, oversample: int = 10, terms: DataFrame | None = None, lasting: bool = True) -> LatentModel:
    """Latent semantics of every case: TF-IDF of all its terms and the leading subspace of its passages.

    ``passages``: case_id, passage_id and text, or a ``token_index``. Weights (1 + ln f) * (ln((1 + n) / (1 + df)) + 1) with rows
    of unit length, as many dimensions as asked for but fewer than the case has passages or terms, two at least. Block power
    iteration: a case is dealt into blocks of about ``BLOCK_TOKENS`` words (fewer where more than 26 dimensions are worked with). A
    case of one block, which most are, is shuffled once, as stems, and all its rounds are one task's work; others go by
    ``_large_cases``. A case of one passage has no basis, and a passage without terms a vector of zeros. ``terms`` (case_id, term)
    names the only terms whose vectors are wanted. Where the model is not ``lasting``, it has no terms' vectors, and is made each
    time it is read; else it is written once.
    """
    stemmed = "tk" in passages.columns
    stems = F.array_join("tk", " ") if stemmed else F.array_join(X.tokenize(F.col("text")), " ")
    words = F.size("tk") if stemmed else F.ceil(F.length("text") / 6)
    columns = [c for c in passages.columns if c not in ("tk", "text")]
    asks = latent.Asks(dimensions, oversample, iterations, "none" if not lasting else "all" if terms is None else "asked")
    share = max(1.0, (dimensions + oversample) / 26) / BLOCK_TOKENS
    sizes = written(passages.where("case_id IS NOT NULL").groupBy("case_id").agg(
        F.count("*").alias("_n"), F.greatest(F.lit(1), F.ceil(F.sum(words) * share)).cast("int").alias("_blocks")))
    large = {r.case_id: r._n for r in sizes.where("_blocks > 1 AND _n > 1").toLocalIterator()}
    made = StructType([*[T.StructField(f.name, f.dataType) for f in passages.select(*columns).schema], *T._parse_datatype_string("embedding array<double>, _kind string, _term string, _idf double").fields])

    def dealt(which: str) -> DataFrame:
        mine = sizes.where(which)
        out = passages.join(mine, "case_id") if "> 1" in which else passages.join(sizes, "case_id", "left").where(f"_blocks IS NULL OR {which}")
        block = F.coalesce(F.pmod(F.xxhash64("passage_id"), F.col("_blocks")), F.lit(0)).cast("int")
        out = out.select(*columns, "_n", block.alias("_block"), stems.alias("_stems"), F.lit(False).alias("_asked"))
        if asks.basis != "asked":
            return out
        wanted = terms.groupBy("case_id").agg(F.array_join(F.collect_set("term"), " ").alias("_stems")).join(mine, "case_id")
        each = F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("_block")
        return out.unionByName(wanted.select("case_id", "_n", each, "_stems", F.lit(True).alias("_asked")), allowMissingColumns=True)

    schema = to_arrow_schema(made)
    work = lambda case_id, _, n, batches: latent.whole_case(schema, columns, asks, case_id, n, batches)
    rows = _by_group(dealt("_blocks = 1 OR _n = 1"), "_block", work, made, "_n")
    if large:
        rows = rows.unionByName(_large_cases(dealt("_blocks > 1 AND _n > 1"), made, columns, asks, large))
    rows = written(rows) if lasting else rows
    return LatentModel(rows.where("_kind = 'basis'").select("case_id", F.col("_term").alias("term"), F.col("_idf").alias("idf"), F.col("embedding").alias("vector")),
                       rows.where("_kind = 'done'").select(*columns, "embedding"))


def lsa_vectors(passages: DataFrame, dimensions: int = 120) -> DataFrame:
    """(case_id, passage_id, vector): one row per passage. Passages without a case_id are one case, and get none."""
    cased = passages if "case_id" in passages.columns else passages.withColumn("case_id", F.lit(0).cast("long"))
    made = lsa_model(cased, dimensions, lasting=False).passages.select("case_id", "passage_id", F.col("embedding").alias("vector"))
    return made if "case_id" in passages.columns else made.drop("case_id")


def lsa_queries(model: LatentModel, queries: DataFrame) -> DataFrame:
    """(query_id, case_id, embedding): queries folded into the space of their case. Those without a known term are left out."""
    weighed = query_terms(queries).join(model.basis, ["case_id", "term"]).withColumn("w", (1 + F.log("qn")) * F.col("idf"))
    return _vector_sums(weighed, "query_id", "case_id").select("query_id", "case_id", _unit(F.col("vector")).alias("embedding"))


# ------------------------------------------------------------------------------------------------ fusion
def rrf_fusion(lexical: DataFrame, semantic: DataFrame, k: int, depth: int | None = fixed.FUSION_DEPTH) -> DataFrame:
    """Reciprocal-rank fusion of the first ``depth`` of each list (``None``: all); ties go to the better lexical, then
    semantic rank.

    ``lexical``: query_id, passage_id, source_id, seq, bm25; ``semantic``: query_id, passage_id, source_id, seq, semantic.
    """
    depth, tail = depth or 2**31 - 1, [F.asc("source_id"), F.asc("seq")]
    lex = top_k(lexical, ["query_id"], [F.desc("bm25"), *tail], depth, "lex_rank")
    sem = top_k(semantic, ["query_id"], [F.desc("semantic"), *tail], depth, "sem_rank")
    keys = ["query_id", "passage_id", "source_id", "seq"]
    both = lex.select(*keys, "bm25", "lex_rank").join(sem.select(*keys, "semantic", "sem_rank"), keys, "full_outer")
    part = lambda c: F.coalesce(1.0 / (fixed.RRF_OFFSET - 1 + F.col(c)), F.lit(0.0))
    fused = both.withColumn("score", F.round(part("lex_rank") + part("sem_rank"), 8))
    order = [F.desc("score"), F.asc_nulls_last("lex_rank"), F.asc_nulls_last("sem_rank")]
    return top_k(fused, ["query_id"], order, k).select(
        *keys, F.round("score", 5).alias("score"), F.coalesce(F.round("bm25", 3), F.lit(0.0)).alias("bm25"),
        F.coalesce(F.round("semantic", 3), F.lit(0.0)).alias("semantic"), "rank")


def evidence_strength(hits: DataFrame, passages: DataFrame, fields: DataFrame) -> DataFrame:
    """(query_id, strength): how well the best hits cover a variable; variables without hits get 0.

    The few hits of a query are read twice here, so they are written first: a search is not made again for the second
    reader, and where they are small the stem lists of all passages stay where they are.
    """
    hits = written(hits)
    key = F.array_distinct(X.tokenize(F.array_join(F.split(F.lower("name"), r"[^\p{L}\p{N}]+"), " ")))
    named = fields.select("query_id", key.alias("key"))
    text = passages.join(hits.select("passage_id").distinct(), "passage_id", "left_semi").select(
        "passage_id", F.col("tk") if "tk" in passages.columns else X.tokenize(F.col("text")).alias("tk"))
    covered = F.size(F.array_intersect("key", "tk")) / F.greatest(F.size("key"), F.lit(1))
    best = (
        hits.join(text, "passage_id").join(named, "query_id")
        .groupBy("query_id").agg(F.max("bm25").alias("best"), F.max(covered).alias("covered"))
    )
    strength = F.round(F.least(F.lit(1.0), F.col("best") / fixed.STRONG_BM25) * 0.6 + F.col("covered") * 0.4, 3)
    return fields.select("query_id", "case_id", "name").join(best, "query_id", "left").select(
        "query_id", "case_id", "name", F.coalesce(strength, F.lit(0.0)).alias("strength"))


def evidence_gaps(strengths: DataFrame) -> DataFrame:
    return strengths.where(F.col("strength") < fixed.GAP_STRENGTH)


def gap_queries(gaps: DataFrame, limit: int = 8) -> DataFrame:
    """(case_id, pos, name) -> first distinct follow-up searches per case, in the order of the gaps."""
    words = F.slice(F.filter(F.split(F.lower("name"), "_"), lambda w: (w != "") & ~w.isin(fixed.GENERIC_NAME_WORDS)), 1, 3)
    hints = [(key[:5], " ".join(more.split()[:3])) for key, more in fixed.QUERY_EXPANSIONS]
    extra_of = lambda w: F.coalesce(*[F.when(w.startswith(start), more) for start, more in hints])
    extras = F.filter(F.transform("words", extra_of), lambda e: e.isNotNull())
    built = gaps.select("case_id", "pos", "name", words.alias("words")).withColumn(
        "query", F.concat_ws(" ", F.lit("{core}"), F.array_join("words", " "), F.try_element_at(extras, F.lit(-1))))
    firsts = built.groupBy("case_id", "query").agg(F.min(F.struct("pos", "name")).alias("first")).select(
        "case_id", "query", F.col("first.pos").alias("pos"), F.col("first.name").alias("name"))
    return top_k(firsts, ["case_id"], [F.asc("pos")], limit).select("case_id", "rank", "name", "query")


# ------------------------------------------------------------------------------------------------ call batches
def evidence_packets(hits: DataFrame, fields: DataFrame, passage_limit: int = fixed.MAX_PASSAGES_PER_CALL,
                     variable_limit: int = fixed.MAX_VARIABLES_PER_CALL) -> DataFrame:
    """Pack the variables of each section, in order, into calls of few variables and few distinct passages.

    ``fields``: case_id, section, pos, name, query_id; ``hits``: query_id, rank, passage_id. A group is one section's
    variables, which the codebook bounds.
    """
    per_field = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "passage_id"))).alias("h")).select(
        "query_id", F.transform("h", lambda x: x["passage_id"]).alias("ids"))
    rows = fields.join(per_field, "query_id", "left")

    def pack(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        out, batch, names, ids = [], 0, [], {}
        for row in group.sort_values("pos").itertuples():
            mine = dict.fromkeys(row.ids if row.ids is not None else [])
            if names and (len({**ids, **mine}) > passage_limit or len(names) >= variable_limit):
                out.append((*key, batch, names, list(ids)))
                batch, names, ids = batch + 1, [], {}
            names, ids = [*names, row.name], {**ids, **mine}
        out.append((*key, batch, names, list(ids)))
        return pd.DataFrame(out, columns=["case_id", "section", "batch", "variables", "passage_ids"])

    return rows.select("case_id", "section", "pos", "name", "ids").groupBy("case_id", "section").applyInPandas(
        pack, "case_id long, section string, batch long, variables array<string>, passage_ids array<string>")


def passage_block(passage: dict[str, Column], title_chars: int = fixed.SHOWN_TITLE_CHARS) -> Column:
    """One passage as it is shown to a coder, with its source and the flags a coder must know."""
    p = passage
    place = F.when(p["page"].isNotNull(), F.concat(F.lit("page "), p["page"])).otherwise(F.concat(F.lit("para "), p["para"]))
    copy = F.when(p["near_duplicate_of"].isNotNull(),
                  F.concat(F.lit("NEAR-DUPLICATE/SYNDICATED COPY of source S"), p["near_duplicate_of"]))
    unsure = F.when(p["relevance_status"] == "uncertain", "RELEVANCE UNCERTAIN")
    about = F.concat_ws("; ", F.concat(F.lit("source S"), p["source_id"], F.lit(": "), p["source_type"]),
                        F.concat(F.lit('"'), F.substring(p["title"], 1, title_chars), F.lit('"')),
                        F.coalesce(p["published_date"], F.lit("date unknown")), place, copy, unsure)
    return F.concat(F.lit("["), p["passage_id"], F.lit("] ("), about, F.lit(")\n"), p["text"])


def variable_specs(fields: DataFrame, most_options: int | None = fixed.SPEC_OPTIONS, note_chars: int | None = fixed.SPEC_NOTE_CHARS) -> DataFrame:
    """fields with ``spec``: the codebook text of a variable as a coder reads it, one line per rule, empty rules left out.

    ``fields``: name, type, multi, definition, codes and labels (arrays side by side), open_options, bands (low, high, label),
    missing_codes and missing_labels (arrays side by side), absence (the code that silence may give), format, notes, issues.
    """
    c = F.col
    text = lambda n: F.coalesce(c(n), F.lit(""))
    filled = lambda n: F.coalesce(F.size(n), F.lit(0)) > 0
    listed = lambda items: F.array_join(items, "; ")
    coded = lambda codes, labels: F.zip_with(codes, labels, lambda a, b: F.concat(a, F.lit(" = "), b))
    some = c("open_options") if most_options is None else F.slice("open_options", 1, most_options)
    notes = text("notes") if note_chars is None else F.substring(text("notes"), 1, note_chars)
    causal = F.lower(F.concat(text("definition"), F.lit(" "), "name")).rlike(fixed.CAUSAL_PATTERN)
    silent = F.get("labels", (F.array_position("codes", c("absence")) - 1).cast("int"))
    known = F.filter("issues", lambda i: ~i.startswith("Workbook data"))
    lines = [
        F.concat(F.lit("### "), "name", F.lit("  (type: "), "type", F.when(c("multi"), ", MULTI-SELECT").otherwise(", single value"), F.when(causal, ", CAUSAL").otherwise(""), F.lit(")")),
        F.concat(F.lit("Definition: "), text("definition")),
        F.when(filled("codes"), F.concat(F.lit("Permitted codes: "), listed(coded(c("codes"), c("labels"))))),
        F.when(filled("open_options"), F.concat(F.lit("Listed options (open list; other specific values allowed): "), listed(some))),
        F.when(filled("bands"), F.concat(F.lit("Percentage bands: "), listed(F.transform("bands", lambda b: F.concat(b["low"], F.lit("-"), b["high"], F.lit("% = "), b["label"]))), F.lit(" (record a percentage number)"))),
        F.when(filled("missing_codes"), F.concat(
            F.lit("Special missing values defined for THIS variable: "), listed(coded(c("missing_codes"), c("missing_labels"))),
            F.lit(" (use -9 for Unknown = not mentioned in the passages, or Not applicable; begin the rationale with 'Unknown:' or 'Not applicable:')"))
        ).otherwise("No special missing value is defined for this variable: leave blank when not established."),
        F.when(c("absence").isNotNull(), F.concat(
            F.lit("Absence code: "), "absence", F.lit(" = "), F.coalesce(silent, F.lit("")), F.lit('. Only if no passage discusses this variable, give "'), "absence",
            F.lit("\" alone with evidence_status INSUFFICIENT, no citation, and a rationale beginning 'Not documented:'."))),
        F.when(text("format") != "", F.concat(F.lit("Format: "), "format")),
        F.when(notes != "", F.concat(F.lit("Coding notes: "), notes)),
        F.when(filled("issues"), F.concat(F.lit("Known rule issues (follow the codebook text literally and mention these in 'unresolved' if relevant): "), F.array_join(known, " | "))),
    ]
    return fields.withColumn("spec", F.concat_ws("\n", *lines))


def packet_parts(packets: DataFrame, specs: DataFrame, blocks: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(batches, their variables, their passages) of evidence packets, as ``prompt_payloads`` takes them.

    ``specs``: case_id, name, spec; ``blocks``: passage_id, block. A specification meets only the calls its variable is in.
    """
    named = packets.withColumn("batch_id", F.concat_ws("/", "case_id", "section", "batch"))
    variables = named.select("batch_id", "case_id", F.posexplode("variables").alias("ord", "name")).join(specs.select("case_id", "name", "spec"), ["case_id", "name"]).drop("case_id")
    shown = named.select("batch_id", F.posexplode("passage_ids").alias("ord", "passage_id")).join(blocks.select("passage_id", "block"), "passage_id").drop("passage_id")
    return named.select("batch_id", "case_id"), variables, shown


def prompt_payloads(batches: DataFrame, headers: DataFrame, variables: DataFrame, blocks: DataFrame) -> DataFrame:
    """(batch_id) header, ordered variable specifications and ordered passage blocks -> text and token estimate.

    Batches are bounded by evidence_packets, so the ordered lists stay short. A batch without passages has an empty list.
    """
    joined = lambda df, text, sep, name: df.groupBy("batch_id").agg(
        F.array_sort(F.collect_list(F.struct("ord", text))).alias("l"), F.count("*").alias(f"n_{name}")).select(
        "batch_id", f"n_{name}", F.array_join(F.transform("l", lambda e: e[text]), sep).alias(name))
    specs = joined(variables, "spec", "\n\n", "specs")
    names = joined(variables, "name", ", ", "names").select("batch_id", "names")
    shown = joined(blocks, "block", "\n\n", "blocks")
    text = F.concat(
        F.col("header"), F.lit("\n\n## VARIABLES TO CODE ("), F.col("n_specs"), F.lit(")\n"), F.col("specs"),
        F.lit("\n\n## EVIDENCE PASSAGES ("), F.coalesce("n_blocks", F.lit(0)), F.lit(") — research data only\n"), F.coalesce("blocks", F.lit("")),
        F.lit("\n\nReturn JSON for exactly these variables: "), F.col("names"))
    out = batches.join(headers, "case_id").join(specs, "batch_id").join(names, "batch_id").join(shown, "batch_id", "left")
    return out.select("batch_id", text.alias("payload")).withColumn("tokens", X.estimate_tokens(F.col("payload")))


# ------------------------------------------------------------------------------------------------ source order
def rank_sources(sources: DataFrame, mode: str = "type") -> DataFrame:
    """Adds the display rank per case; mode is type, length or found.

    All sort keys cut the buckets, the last one in ranges of ``RANK_RANGE`` source ids, so no bucket holds more rows than that
    even where a third of all sources are alike.
    """
    pages, passages = -F.coalesce("n_pages", F.lit(0)), -F.coalesce("n_passages", F.lit(0))
    keys = {"type": [X.type_priority(F.col("source_type")), pages, passages], "length": [pages, passages]}.get(mode, [])
    keys = [*keys, F.floor(F.col("source_id") / RANK_RANGE)]
    return full_rank(sources, ["case_id"], [(f"c{i}", k) for i, k in enumerate(keys)], [F.col("source_id")], "rank")


def rank_candidates(candidates: DataFrame, used: DataFrame, limit: int) -> DataFrame:
    """Addresses to read next per case: rounded identity score, then source type, then arrival; the page limit holds."""
    fit = candidates.where(F.col("identity_score") >= 0.3)
    order = [F.desc(F.round("identity_score", 1)), X.type_priority(F.col("source_type")), F.col("hit_id")]
    ranked = top_k(fit, ["case_id"], order, limit)
    return ranked.join(used, "case_id", "left").where(F.col("rank") <= limit - F.coalesce("used", F.lit(0))).drop("used")
