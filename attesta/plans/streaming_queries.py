"""Streaming jobs run to the end of what has arrived, next to the SQL of their batch twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from attesta.operators.ordered import Limits
from attesta.plans.registry import query, with_tables
from attesta.plans.rollup_queries import ADMISSION, SQL_ADMISSION
from attesta.plans.text_queries import SQL_NORM
from attesta.plans.validation_queries import case_passages, sql_checked
from attesta.session import scratch_folder
from attesta.sources.stand_ins import ACTION_COLUMNS, CALL_COLUMNS, USAGE_COLUMNS
from attesta.streaming import jobs as S


def _stream(t, name, columns):
    return S.file_stream(t.spark, t.directory, name).select(*[F.expr(e).alias(n) for n, e in columns])


@query("stream_exact_dedup", f"SELECT case_id, content_hash FROM (SELECT DISTINCT CAST(substr(source, 4) AS BIGINT) AS case_id, sha256({SQL_NORM.format(c='text')}) AS content_hash FROM documents)")
def _(t):
    docs = _stream(t, "documents", [("case_id", "CAST(substr(source, 4) AS BIGINT)"), ("source_id", "doc_id"), ("text", "text"), ("arrived", "timestamp_seconds(1700000000 + doc_id)")])
    return S.collect_appends(S.exact_dedup(docs).select("case_id", "source_id", "content_hash")).select("case_id", "content_hash")


@query("stream_spend_by_case", with_tables("usg") + """SELECT case_id, strftime(date_trunc('day', usg.at), '%Y-%m-%d') AS day, round(sum(coalesce(cost_usd, 0)), 5) AS spent, count(*) AS requests FROM usg GROUP BY ALL""")
def _(t):
    out = S.collect_updates(S.spend_by_case(_stream(t, "events", USAGE_COLUMNS)), "case_id", "day")
    return out.select("case_id", F.date_format("day", "yyyy-MM-dd").alias("day"), F.round("spent", 5).alias("spent"), "requests")


@query("stream_budget_alert", with_tables("usg") + "SELECT case_id, round(sum(cost_usd), 5) AS total FROM usg GROUP BY case_id HAVING sum(cost_usd) > 3.0")
def _(t):
    return S.collect_updates(S.budget_alert(_stream(t, "events", USAGE_COLUMNS), 3.0), "case_id").withColumn("total", F.round("total", 5))


@query("stream_budget_admission", SQL_ADMISSION)
def _(t):
    """The same decisions as the batch query, call by call as calls arrive."""
    return S.collect_appends(S.budget_admission(_stream(t, "events", CALL_COLUMNS), Limits(**ADMISSION)))


CITE = [("item_id", "doc_id"), ("case_id", "doc_id"), ("part", "'value'"), ("code", "''"), ("ord", "0"), ("passage_id", "CASE WHEN doc_id % 7 = 0 THEN 'S0-P0' ELSE 'S' || CAST(doc_id AS STRING) || '-P' || CAST(1 + doc_id % 3 AS STRING) END"),
        ("quote", "CASE WHEN doc_id % 5 = 0 THEN 'words nobody wrote' ELSE split_part(text, chr(10), CAST(1 + doc_id % 3 AS INT)) END"), ("stance", "'supports'")]


@query("stream_citation_check", with_tables("psg", "cites AS (SELECT " + ", ".join(f"{e} AS {n}" for n, e in CITE) + " FROM documents)") .rstrip() + ", " + sql_checked("cites").replace("c LEFT JOIN", "c LEFT JOIN") + " SELECT item_id, reason FROM checked")
def _(t):
    return S.collect_appends(S.citation_check(_stream(t, "documents", CITE), case_passages(t)).select("item_id", "reason"))


@query("stream_review_current", with_tables("act") + "SELECT case_id, variable, max(id) AS id, arg_max(action, id) AS action, arg_max(value, id) AS value FROM act GROUP BY case_id, variable")
def _(t):
    path = scratch_folder(t.spark)
    S.run_to_end(_stream(t, "events", ACTION_COLUMNS), S.write_batch(path), "append")
    return S.current_reviews(t.spark, path)
