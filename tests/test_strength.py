"""Strength of the evidence for a variable."""

from pyspark.sql import functions as F

from attesta.operators import retrieval as R


def test_the_search_behind_the_hits_is_made_once(spark):
    hits = spark.range(4).select((F.col("id") % 2).alias("query_id"), F.concat(F.lit("S"), "id").alias("passage_id"), (F.col("id") * 5.0).alias("bm25"))
    passages = spark.createDataFrame([("S0", "siren"), ("S1", "flood warning"), ("S3", "warning")], "passage_id string, text string")
    fields = spark.createDataFrame([(0, 1, "SIREN"), (1, 1, "FLOOD_WARNING"), (2, 1, "NONE")], "query_id bigint, case_id bigint, name string")
    got = R.evidence_strength(hits, passages, fields)
    assert {r.query_id: r.strength for r in got.collect()} == {0: 0.4, 1: 1.0, 2: 0.0}
    assert "Range" not in got._jdf.queryExecution().optimizedPlan().toString()
    plan = R.evidence_strength(hits, passages, fields)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [passage_id" not in plan
