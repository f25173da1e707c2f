"""Registered queries of this package: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from attesta.llm import checks, lm_scoring, toxicity
from attesta.llm.exact_dedup import exact_dedup
from attesta.llm.fill_middle import fill_in_middle, restored
from attesta.llm.mixing import mix
from attesta.llm.ngram_join import ngram_join
from attesta.llm.packing import pack
from attesta.llm.pieces import encode
from attesta.llm.quality import quality_rules
from attesta.llm.ranked_search import ranked_search
from attesta.llm.substring_dedup import substring_dedup
from attesta.llm.url_filters import filter_captures, host_of, path_of
from attesta.llm.warc import archive_round_trip
from attesta.sources.tables import read_table
from pyspark.sql import functions as F

YEAR_START, YEAR_SECONDS = 1_704_067_200, 366 * 86_400  # 2024 in UTC


def _number(*parts):
    """A number below 2**28 that depends on the parts only."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 7), 16, 10).cast("long")


def op1_ngram_join(spark, directory):
    return ngram_join(read_table(spark, directory, "documents")).select("doc_id", "n_shingles", "component_id")


def op2_quality_rules(spark, directory):
    return quality_rules(read_table(spark, directory, "documents")).drop("host_rate")


def op3_warc_transactions(spark, directory):
    return archive_round_trip(read_table(spark, directory, "pages")).drop("target")


def dated_entries(pages):
    """The dated block list that goes with the pages: three entries each for the hosts, the last two labels of the hosts
    and the first path parts that occur, at times and with actions that follow from the pattern."""
    host, part = host_of(F.col("url")), F.regexp_extract(path_of(F.col("url")), "^/([^/]+)", 1)
    labels = F.split(host, r"\.")
    listed = pages.where(host != "").select(F.explode(F.array(
        host, F.concat_ws(".", F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), F.lit(2))), F.when(part != "", F.concat(host, F.lit("/"), part)))).alias("pattern"))
    turns = listed.where("pattern IS NOT NULL").distinct().select("pattern", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("turn"))
    return turns.select(
        "pattern", (F.lit(YEAR_START) + _number("pattern", "turn") % YEAR_SECONDS).alias("listed_at"),
        F.when(_number("pattern", "turn", F.lit("action")) % 3 == 0, "block").otherwise("allow").alias("action"),
        F.concat(F.lit("list"), (_number("pattern", F.lit("category")) % 5).cast("string")).alias("category"))


def op6_lm_scoring(spark, directory):
    documents = read_table(spark, directory, "documents").select("doc_id", "text")
    model, counts = lm_scoring.fit(documents)
    return lm_scoring.score(documents, model, counts).withColumn("held_out", lm_scoring.held_out(2, 7))


def op7_url_filters(spark, directory):
    pages = read_table(spark, directory, "pages")
    captures = pages.select("page_id", "url", (F.lit(YEAR_START) + _number(F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit("fetch")) % YEAR_SECONDS).alias("fetched_at"))
    return filter_captures(captures, dated_entries(pages))


def op8_piece_encoding(spark, directory):
    return encode(read_table(spark, directory, "documents").select("doc_id", "text")).select("doc_id", "n_ids", "round_trip", "ids")


def op4_substring_dedup(spark, directory):
    return substring_dedup(read_table(spark, directory, "documents"))


def op5_exact_dedup(spark, directory):
    return exact_dedup(read_table(spark, directory, "documents"))


def op9_source_mixing(spark, directory):
    return mix(read_table(spark, directory, "documents"))


def op10_toxicity(spark, directory):
    documents = read_table(spark, directory, "documents").select("doc_id", "text")
    model = toxicity.fit(documents, read_table(spark, directory, "labels"))
    return toxicity.score(documents, model).select("doc_id", toxicity.held_out(2, 4).alias("held_out"), "score", "predicted", "neighbours", "cosines")


def op11_best_fit_packing(spark, directory):
    return pack(read_table(spark, directory, "documents"), with_ids=False)


def op12_fill_in_middle(spark, directory):
    made = fill_in_middle(read_table(spark, directory, "documents"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
                       F.sha2(restored(F.col("output"), F.col("form")).cast("binary"), 256).alias("restored_sha256"))


def op13_ranked_search(spark, directory):
    return ranked_search(read_table(spark, directory, "documents"), read_table(spark, directory, "benchmark"))


QUERIES = {f.__name__: f for f in (
    op1_ngram_join, op2_quality_rules, op3_warc_transactions, op4_substring_dedup, op5_exact_dedup, op6_lm_scoring, op7_url_filters, op8_piece_encoding, op9_source_mixing, op10_toxicity,
    op11_best_fit_packing, op12_fill_in_middle, op13_ranked_search,
)}


def queries():
    return dict(QUERIES)


def oracle_sql():
    return {name: sql for name, sql in checks.SQL.items() if name in QUERIES}
