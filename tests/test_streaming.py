"""Streams fed file by file must end where their batch twins end."""

import datetime as dt

from pyspark.sql import functions as F

from attesta.session import scratch_folder
from attesta.streaming import jobs as S


def _files(spark, parts, schema, name):
    """A folder with one Parquet file per part, and a stream over it that reads one file per micro-batch."""
    folder = scratch_folder(spark)
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/{i:03d}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(folder)


T0 = dt.datetime(2024, 1, 1)


def test_dedup_across_micro_batches(spark):
    schema = "source_id long, case_id long, text string, arrived timestamp"
    parts = [[(1, 1, "Same text!", T0), (2, 1, "other", T0)], [(3, 1, "same  TEXT", T0 + dt.timedelta(hours=1)), (4, 2, "same text", T0)]]
    rows = S.collect_appends(S.exact_dedup(_files(spark, parts, schema, "docs")).select("source_id", "case_id", "content_hash")).collect()
    assert sorted((r.case_id, r.content_hash[:4]) for r in rows) == sorted({(r.case_id, r.content_hash[:4]) for r in rows}) and len(rows) == 3


USAGE = "case_id long, cost_usd double, at timestamp"


def test_spend_leaves_out_rows_behind_the_watermark(spark):
    # rows are compared with the watermark that the batch before the previous one left, so the late row comes last
    later = T0 + dt.timedelta(days=10)
    parts = [[(1, 1.0, T0)], [(1, 2.0, later)], [(1, None, later)], [(1, 4.0, T0 + dt.timedelta(hours=1))]]
    rows = S.collect_updates(S.spend_by_case(_files(spark, parts, USAGE, "u")), "case_id", "day").collect()
    assert sorted((r.day.day, r.spent, r.requests) for r in rows) == [(1, 1.0, 1), (11, 2.0, 2)]


def test_budget_alert_has_the_last_total(spark):
    parts = [[(1, 2.0, T0), (2, 1.0, T0)], [(1, 2.0, T0)], [(1, 5.0, T0), (2, None, T0)]]
    rows = S.collect_updates(S.budget_alert(_files(spark, parts, USAGE, "u"), 3.0), "case_id").collect()
    assert [(r.case_id, r.total) for r in rows] == [(1, 9.0)]


def test_current_reviews_keep_the_newest_and_survive_a_repeated_batch(spark):
    schema = "id long, case_id long, variable string, action string, value string"
    parts = [[(1, 1, "A", "edit", "x"), (2, 1, "B", "edit", "y")], [(3, 1, "A", "edit", "z")], [(4, 2, "A", "clear", "")]]
    path = scratch_folder(spark)
    S.run_to_end(_files(spark, parts, schema, "r"), S.write_batch(path), "append")
    again = S.write_batch(path)  # as after a restart
    again(spark.createDataFrame([(9, 3, "A", "edit", "q")], schema), 7)
    again(spark.createDataFrame(parts[1], schema), 1)  # a batch is run again
    now = sorted(map(tuple, S.current_reviews(spark, path).collect()))
    assert now == [(1, "A", 3, "edit", "z"), (1, "B", 2, "edit", "y"), (2, "A", 4, "clear", ""), (3, "A", 9, "edit", "q")]


def test_citations_against_stored_passages(spark):
    schema = "item_id long, case_id long, part string, code string, ord int, passage_id string, quote string, stance string"
    parts = [[(1, 1, "value", "", 0, "S1-P1", "the river rose", "supports")], [(2, 1, "value", "", 0, "S1-P1", "the lake rose", "supports"), (3, 1, "value", "", 0, "S2-P1", "the river rose", "supports")]]
    passages = spark.createDataFrame([(1, "S1-P1", "At night the river  rose fast.")], "case_id long, passage_id string, text string")
    rows = S.collect_appends(S.citation_check(_files(spark, parts, schema, "c"), passages).select("item_id", "reason")).collect()
    assert {r.item_id: r.reason for r in rows} == {1: None, 2: "quote_not_found", 3: "evidence_id_not_supplied"}


def test_a_table_may_be_a_folder_of_files(spark):
    folder, schema = scratch_folder(spark), "source_id long, case_id long, text string, arrived timestamp"
    rows = [(i, 1, f"text {i % 3}", T0) for i in range(12)]
    spark.createDataFrame(rows, schema).repartition(4).write.parquet(f"{folder}/docs.parquet")
    spark.createDataFrame([(9, 2, "text 0", T0)], schema).coalesce(1).write.parquet(f"{folder}/docs-2.parquet")
    spark.createDataFrame([(9, 3, "text 0", T0)], schema).coalesce(1).write.parquet(f"{folder}/other.parquet")
    stream = S.file_stream(spark, folder, "docs")
    kept = S.collect_appends(S.exact_dedup(stream).select("case_id", "content_hash")).collect()
    assert sorted(r.case_id for r in kept) == [1, 1, 1, 2]
