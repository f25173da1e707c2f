"""Agreement is assessed once, on narrow rows."""

from attesta.operators import compare as C
from attesta.plans import compare_queries as Q
from attesta.sources.stand_ins import Tables

ROWS = "case_id bigint, variable string, status string, label string, eligible boolean, problems string, value string"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_quotations_do_not_travel_to_the_assessment(spark, small):
    assert "quote" not in plan(Q.assessed(Tables(spark, small)))


def test_summary_reads_the_assessment_once_and_keeps_equal_rows(spark):
    rows = [(1, "A", "eligible", "ok", True, "", "1"), (1, "A", "eligible", "ok", True, "", "1"), (1, "B", "eligible", "ok", True, "", "2"),
            (1, "C", "pending", "open", False, "", "1"), (1, "D", "pending", "open", False, "", None), (2, "C", "pending", None, False, "", "1")]
    got = C.eligible_summary(spark.createDataFrame(rows, ROWS), {"A": [("1", "short")]})
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, [
        (1, "A", "ok", "1", "short", 1), (1, "A", "ok", "1", "short", 1), (1, "B", "ok", "2", "", 1), (1, None, "open", None, None, 2), (2, None, None, None, None, 1)]))
    assert "Union" not in plan(got)


def test_confirming_reads_the_assessment_once_and_halts_whole_cases(spark):
    assessed = spark.createDataFrame([
        (1, "A", "eligible", "ok", True, "", "1"), (1, "B", "eligible_cross_version", "x", True, "", "2"), (2, "A", "eligible", "ok", True, "", "3")], ROWS)
    selected = spark.createDataFrame([(1, "A"), (1, "B"), (2, "A"), (2, "Z"), (None, "A")], "case_id bigint, variable string")
    reviews = spark.createDataFrame([], "case_id bigint, variable string")
    got = C.bulk_confirm(selected, assessed, reviews, acknowledged=False)
    warned = "version warning not acknowledged"
    assert {(r.case_id, r.variable): (r.outcome, r.value, r.reason) for r in got.collect()} == {
        (1, "A"): ("skipped", None, warned), (1, "B"): ("skipped", None, warned), (2, "A"): ("confirmed", "3", None),
        (2, "Z"): ("skipped", None, "not eligible"), (None, "A"): ("skipped", None, "not eligible")}
    assert plan(got).count("LogicalRDD") == 3
