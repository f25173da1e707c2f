"""Queries over ledgers, coverage, audits, ordered logic and table changes."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from attesta.functions import fixed_values as fixed
from attesta.operators import changes as H
from attesta.operators import ordered as O
from attesta.operators import rollups as R
from attesta.plans.compare_queries import results as coder_results
from attesta.plans.evidence_queries import HASHED, MARKED, SQL_HITS, SQL_USABLE, marked_sources, page_hits
from attesta.plans.registry import query, with_tables
from attesta.plans.text_queries import SQL_COST, SQL_PRICES, quoted
from attesta.sources.tables import dimension, values_sql

I = "CAST({} AS BIGINT)"


@query("spend_ledger", with_tables("usg") + "SELECT case_id, CASE WHEN kind = 'search' THEN 'search' ELSE coalesce(provider, 'unknown') END AS key, round(sum(coalesce(cost_usd, 0)), 5) AS spent FROM usg GROUP BY ALL")
def _(t):
    return R.spend_ledger(t.usage()).withColumn("spent", F.round("spent", 5))


SQL_ATTEMPTS = """att AS (SELECT case_id, provider, CAST(sum(n) AS BIGINT) AS attempts FROM (SELECT case_id, provider, http_attempts AS n FROM cal UNION ALL SELECT case_id, provider, 1 FROM usg WHERE kind = 'model' AND call_id IS NULL) GROUP BY ALL)"""


@query("attempts_ledger", with_tables("usg", "cal", SQL_ATTEMPTS) + "SELECT * FROM att")
def _(t):
    return R.attempts_ledger(t.calls(), t.usage())


@query("usage_totals", with_tables("usg") + f"""SELECT case_id, round(coalesce(sum(cost_usd) FILTER (kind = 'model'), 0), 5) AS model_usd, round(coalesce(sum(cost_usd) FILTER (kind = 'model' AND provider = 'anthropic'), 0), 5) AS provider_a_usd,
 round(coalesce(sum(cost_usd) FILTER (kind = 'model' AND provider = 'openai'), 0), 5) AS provider_b_usd, round(coalesce(sum(cost_usd), 0), 5) AS combined_usd, round(coalesce(sum(cost_usd) FILTER (kind = 'search'), 0), 5) AS search_usd,
 {I.format('sum(coalesce(reasoning_tokens, 0))')} AS reasoning_tokens, count(*) FILTER (kind = 'search') AS search_queries_billed, coalesce(bool_or(kind = 'search' AND cost_usd IS NULL), FALSE) AS search_price_unknown,
 {I.format('sum(input_tokens)')} AS input_tokens, {I.format('sum(output_tokens)')} AS output_tokens FROM usg GROUP BY case_id""")
def _(t):
    df = R.usage_totals(t.usage())
    return df.select(*[F.round(c, 5).alias(c) if c.endswith("_usd") else F.col(c) for c in df.columns])


SQL_ACT = lambda kind, label: f"""SELECT c.case_id, '{label}' AS activity, coalesce(n, 0) AS requests, CASE WHEN n IS NULL THEN 0 WHEN n > u THEN round(cost, 4)::DOUBLE END AS cost, CASE WHEN n IS NULL THEN 'none used' WHEN n = u THEN 'unknown (no price configured)'
  WHEN u > 0 THEN 'partly unknown: ' || u || ' request(s) without a price; known part shown' WHEN e THEN 'estimated (worst-case or list price)' ELSE 'measured (provider-reported usage)' END AS basis
 FROM (SELECT DISTINCT case_id FROM usg) c LEFT JOIN (SELECT case_id, count(*) AS n, count(*) FILTER (cost_usd IS NULL) AS u, sum(CAST(cost_usd AS DECIMAL(18, 5))) AS cost, bool_or(estimated) AS e FROM usg WHERE kind = '{kind}' GROUP BY case_id) k USING (case_id)"""


@query("usage_summary", with_tables("usg") + SQL_ACT("search", "Web search (source discovery)") + " UNION ALL " + SQL_ACT("model", "Coding analysis (model requests)")
       + " UNION ALL SELECT DISTINCT case_id, 'Page retrieval, de-duplication, relevance check', NULL, 0, 'no paid service' FROM usg")
def _(t):
    return R.usage_summary(t.usage())


NEAR = "CASE WHEN source_id % 19 = 4 THEN source_id - 1 END"
SOURCES = f"so AS (SELECT *, {NEAR} AS near_duplicate_of, text_chars // 900 AS n_passages FROM marked)"
QUERY_LOG = ("page_id % 20 AS case_id, CASE page_id % 6 WHEN 0 THEN 'error' WHEN 1 THEN 'running' ELSE 'ok' END AS status, page_id % 4 AS round")


def full_sources(t):
    return marked_sources(t).withColumn("near_duplicate_of", F.expr(NEAR)).withColumn("n_passages", F.floor(F.col("text_chars") / 900))


def query_log(t):
    return t.raw("pages").selectExpr(*[p.strip() for p in QUERY_LOG.split(",")])


@query("coverage_report", with_tables("src", HASHED, MARKED, SOURCES, f"ql AS (SELECT {QUERY_LOG} FROM pages)") + """
SELECT coalesce(s.case_id, q.case_id) AS case_id, sources_ok, sources_failed, exact_duplicates, near_duplicates, irrelevant, uncertain, ocr_gaps, coalesce(queries_ok, 0) AS queries_ok, coalesce(queries_failed, 0) AS queries_failed, coalesce(rounds, 0) AS rounds FROM
 (SELECT case_id, count(*) FILTER (fetch_status = 'ok') AS sources_ok, count(*) FILTER (fetch_status = 'failed') AS sources_failed, count(duplicate_of) AS exact_duplicates, count(near_duplicate_of) AS near_duplicates,
  count(*) FILTER (relevance_status = 'irrelevant') AS irrelevant, count(*) FILTER (relevance_status = 'uncertain') AS uncertain, count(*) FILTER (ocr_status LIKE 'ocr_unavailable%') AS ocr_gaps FROM so GROUP BY case_id) s
 FULL JOIN (SELECT case_id, count(*) FILTER (status = 'ok') AS queries_ok, count(*) FILTER (status = 'error') AS queries_failed, max(round) AS rounds FROM ql GROUP BY case_id) q ON q.case_id = s.case_id""")
def _(t):
    return R.coverage_report(full_sources(t), query_log(t))


@query("source_counts", with_tables("src", HASHED, MARKED, SOURCES, SQL_HITS) + f"""
SELECT so.case_id, count(*) AS stored, count(*) FILTER (fetch_status = 'ok') AS retrieved, count(*) FILTER (fetch_status <> 'ok') AS failed, count(*) FILTER (fetch_status = 'ok' AND relevance_status = 'relevant') AS relevant,
 count(*) FILTER (fetch_status = 'ok' AND relevance_status = 'uncertain') AS uncertain, count(*) FILTER (fetch_status = 'ok' AND relevance_status = 'irrelevant') AS irrelevant, count(*) FILTER (fetch_status = 'ok' AND duplicate_of IS NOT NULL) AS duplicates,
 count(*) FILTER (NOT excluded) AS selected, count(*) FILTER ({SQL_USABLE} AND n_passages > 0) AS usable_for_analysis, {I.format(f'coalesce(sum(n_passages) FILTER ({SQL_USABLE}), 0)')} AS usable_passages,
 coalesce(any_value(d), 0) AS discovered FROM so LEFT JOIN (SELECT case_id, count(DISTINCT url) AS d FROM hits GROUP BY case_id) h ON h.case_id = so.case_id GROUP BY so.case_id""")
def _(t):
    return R.source_counts(full_sources(t), page_hits(t))


@query("usable_passage_count", with_tables("psg", HASHED, MARKED) + f"SELECT marked.case_id, count(*) AS usable_passages FROM psg JOIN marked USING (source_id) WHERE {SQL_USABLE} GROUP BY marked.case_id")
def _(t):
    return R.usable_passage_count(t.passages().select("source_id"), marked_sources(t))


INDEPENDENT = f"ind AS (SELECT * FROM so WHERE {SQL_USABLE} AND near_duplicate_of IS NULL)"


@query("primary_secondary_counts", with_tables("src", HASHED, MARKED, SOURCES, INDEPENDENT) + f"""
SELECT case_id, count(*) FILTER (source_type IN ({quoted(fixed.PRIMARY_TYPES)})) AS primary_sources, count(*) FILTER (source_type NOT IN ({quoted(fixed.PRIMARY_TYPES)})) AS secondary_sources FROM ind GROUP BY case_id""")
def _(t):
    return R.primary_secondary_counts(full_sources(t))


@query("source_url_list", with_tables("src", HASHED, MARKED, SOURCES, INDEPENDENT) + """
SELECT case_id, part, string_agg(u, '; ' ORDER BY place) AS urls FROM (SELECT case_id, u, place, (place - 1) // 500 AS part FROM (SELECT case_id, coalesce(final_url, url) AS u, row_number() OVER (PARTITION BY case_id ORDER BY source_id) AS place FROM ind)) GROUP BY case_id, part""")
def _(t):
    return R.source_url_list(full_sources(t))


TYPE_CODES = [("1", 1, "Government document"), ("2", 2, "News media"), ("3", 3, "Peer-reviewed study"), ("10", 4, "NGO or technical report"), ("4", 5, "Other")]


@query("source_type_codes", with_tables("src", HASHED, MARKED, SOURCES, INDEPENDENT, "tc AS (" + values_sql(TYPE_CODES, "code string, ord bigint, label string") + ")") + """
SELECT case_id, string_agg(code, ', ' ORDER BY length(code), code) AS codes FROM (SELECT DISTINCT case_id, (SELECT arg_min(code, ord) FROM tc WHERE contains(lower(label), w)) AS code FROM (
 SELECT case_id, CASE source_type WHEN 'government' THEN 'government' WHEN 'aar' THEN 'government' WHEN 'regulatory' THEN 'government' WHEN 'legislative' THEN 'government' WHEN 'media' THEN 'media' WHEN 'academic' THEN 'peer-reviewed' WHEN 'ngo_technical' THEN 'ngo' ELSE 'other' END AS w FROM ind)) WHERE code IS NOT NULL GROUP BY case_id""")
def _(t):
    return R.source_type_codes(full_sources(t), dimension(t.spark, TYPE_CODES, "code string, ord bigint, label string"))


# coded rows made from the orders table
WIDE = [
    ("STATUS", "CASE WHEN o_orderkey % 40 = 0 THEN o_orderstatus || ', F' WHEN o_orderkey % 50 = 1 THEN '' ELSE o_orderstatus END"),
    ("PRIORITY", "CASE WHEN o_orderkey % 60 = 0 THEN '1998-01-03 00:00:00' ELSE substr(o_orderpriority, 1, 1) || CASE WHEN o_orderkey % 3 = 0 THEN '.0' ELSE '' END END"),
    ("BANDS", "CASE o_orderkey % 9 WHEN 0 THEN '1, 2' WHEN 1 THEN 'x9' WHEN 2 THEN '-9' WHEN 3 THEN 'X7; 1' WHEN 4 THEN '0' ELSE '2' END"),
    ("AMOUNT", "CASE o_orderkey % 11 WHEN 0 THEN '-9' WHEN 1 THEN '-9.0' WHEN 2 THEN 'n/a' WHEN 3 THEN '' WHEN 4 THEN '-' ELSE CAST(o_custkey AS STRING) END"),
    ("REMARK", "CASE o_orderkey % 13 WHEN 0 THEN 'None' WHEN 1 THEN '-9' WHEN 2 THEN '' ELSE o_orderpriority END"),
]
AUDIT_FIELDS = [
    ("STATUS", "categorical", False, "sourced", "F|O", "filled|open", ""), ("PRIORITY", "categorical", False, "judgment", "1|2|3|4", "urgent|high|medium|Not discussed", ""),
    ("BANDS", "categorical", True, "sourced", "0|1|2", "none documented|low|high", "-9"), ("AMOUNT", "numeric", False, "sourced", "", "", ""), ("REMARK", "text", False, "analyst_note", "", "", ""),
]
NOTED = ("BANDS", "PI-M7")  # a variable with a note, and the decision the note asks for
AUDIT_SCHEMA = "variable string, type string, multi boolean, field_class string, codes string, labels string, missing string"


def audit_book(t):
    df = dimension(t.spark, AUDIT_FIELDS, AUDIT_SCHEMA)
    split = lambda c: F.when(F.col(c) == "", F.array().cast("array<string>")).otherwise(F.split(c, r"\|")).alias(c)
    return df.select(*[split(c) if c in ("codes", "labels", "missing") else F.col(c) for c in df.columns])


def wide_rows(t):
    return t.raw("orders").select("o_orderkey", *[F.expr(e).alias(n) for n, e in WIDE])


def cells(t):
    return R.unpivot_cells(wide_rows(t), "o_orderkey", [n for n, _ in WIDE])


SQL_CELLS = ("cells AS (" + " UNION ALL ".join(f"SELECT o_orderkey, '{n}' AS variable, trim({e}) AS value FROM orders" for n, e in WIDE) + "), book AS (SELECT variable, type, multi, field_class, "
             + ", ".join(f"CASE WHEN {c} = '' THEN []::VARCHAR[] ELSE string_split({c}, '|') END AS {c}" for c in ("codes", "labels", "missing")) + f" FROM ({values_sql(AUDIT_FIELDS, AUDIT_SCHEMA)}))")


@query("codebook_conflicts", rf"""WITH {SQL_CELLS}, c AS (SELECT * FROM cells JOIN book USING (variable) WHERE value <> ''),
pt AS (SELECT variable, multi, codes, missing, list_filter(list_transform(regexp_split_to_array(regexp_replace(value, '^(-?\d+)\.0$', '\1'), '[;,]'), lambda x: trim(x)), lambda x: x <> '') AS ps FROM c WHERE type = 'categorical'),
bad AS (SELECT variable, part, count(*) AS n FROM (SELECT variable, codes, missing, regexp_replace(unnest(ps), '^(-?\d+)\.0$', '\1') AS part FROM pt) WHERE NOT list_contains(list_transform(list_concat(codes, missing), lambda x: upper(x)), upper(part)) GROUP BY ALL)
SELECT variable, 'several codes' AS kind, '' AS value, count(*) AS n FROM pt WHERE NOT multi AND len(ps) > 1 GROUP BY variable
UNION ALL SELECT variable, 'undefined value', part, n FROM (SELECT *, row_number() OVER (PARTITION BY variable ORDER BY n DESC, part) AS r FROM bad WHERE part NOT LIKE '% 00:00:00') WHERE r <= 4
UNION ALL SELECT variable, 'dates', '', {I.format('sum(n)')} FROM bad WHERE part LIKE '% 00:00:00' GROUP BY variable
UNION ALL SELECT variable, kind, '', count(*) FROM (SELECT variable, CASE WHEN regexp_full_match(value, '-9(\.0+)?') AND NOT list_contains(missing, '-9') THEN 'undefined -9' WHEN upper(value) IN ('N/A', 'NA', '-', '–', '—') THEN 'placeholder' END AS kind FROM c WHERE type <> 'categorical') WHERE kind IS NOT NULL GROUP BY ALL""")
def _(t):
    return R.codebook_conflicts(cells(t), audit_book(t))


def audit(t):
    noted = F.when(F.col("variable") == NOTED[0], F.array(F.lit(NOTED[1])))
    return R.missingness_audit(cells(t), audit_book(t).withColumn("noted", noted))


MINUS9_PARTS = I.format(r"sum(len(list_filter(ps, lambda p: regexp_full_match(p, '\s*-9(\.0+)?\s*'))))")
ABSENCE_PARTS = I.format(r"sum(len(list_filter(ps, lambda p: list_contains(ab, regexp_replace(trim(p), '\.0$', '')))))")
SQL_AUDIT = rf"""au AS (SELECT *, CASE variable WHEN '{NOTED[0]}' THEN concat_ws(', ', '{NOTED[1]}', CASE WHEN NOT minus9_allowed AND minus9_parts > 0 THEN 'PI-M3' END)
  ELSE concat_ws(', ', CASE WHEN NOT minus9_allowed AND (minus9_parts > 0 OR placeholder_rows > 0) THEN 'PI-M3' END, CASE WHEN n_absence_codes > 0 AND field_class IN ('sourced', 'judgment') THEN 'PI-M4' END) END AS decisions FROM (
 SELECT variable, any_value(type) AS type, any_value(field_class) AS field_class, bool_or(list_contains(missing, '-9')) AS minus9_allowed, any_value(len(ab)) AS n_absence_codes, count(*) AS rows, count(*) FILTER (value = '') AS blank_rows,
  {MINUS9_PARTS} AS minus9_parts, count(*) FILTER (upper(value) IN ({quoted(fixed.PLACEHOLDERS)})) AS placeholder_rows,
  {ABSENCE_PARTS} AS absence_parts
 FROM (SELECT *, regexp_split_to_array(value, '[;,]') AS ps, list_filter(codes, lambda c: regexp_matches(labels[list_position(codes, c)], '(?i){fixed.ABSENCE_LABEL_PATTERN}')) AS ab FROM cells JOIN book USING (variable)) GROUP BY variable))"""


@query("missingness_audit", f"WITH {SQL_CELLS}, {SQL_AUDIT} SELECT * FROM au")
def _(t):
    return audit(t)


@query("missingness_summary", f"""WITH {SQL_CELLS}, {SQL_AUDIT} SELECT 'variables' AS measure, '' AS name, count(*) AS n FROM au UNION ALL SELECT 'decision required', '', count(*) FROM au WHERE decisions <> ''
UNION ALL SELECT '-9 defined', variable, 1 FROM au WHERE minus9_allowed UNION ALL SELECT '-9 not defined', variable, minus9_parts FROM au WHERE NOT minus9_allowed AND minus9_parts > 0
UNION ALL SELECT 'decision', d, count(*) FROM (SELECT unnest(string_split(decisions, ', ')) AS d FROM au WHERE decisions <> '') GROUP BY d""")
def _(t):
    return R.missingness_summary(audit(t))


CB_NAME = ("replace(upper(p_name), ' ', '_') || '_KEY' || CAST(p_partkey % 1500 AS STRING) || CASE p_partkey % 5 WHEN 0 THEN ' (Primary)' WHEN 1 THEN ' (Char. No Space)' ELSE '' END")
HEADER = ("CASE p_partkey % 7 WHEN 0 THEN lower(replace(p_name, ' ', '-')) || ' key' || CAST(p_partkey % 1500 AS STRING) WHEN 1 THEN " + CB_NAME + " "
          "WHEN 2 THEN replace(upper(p_name), ' ', '_') || '_KEY' || CAST(p_partkey % 1500 AS STRING) || ' (Notes)' WHEN 3 THEN upper(substr(p_name, 1, 3)) || '_' || upper(split_part(p_name, ' ', 2)) || '_KEY' || CAST(p_partkey % 1500 AS STRING) "
          "WHEN 4 THEN 'Unknown ' || CAST(p_partkey AS STRING) ELSE replace(upper(p_name), ' ', '_') || '_KEY' || CAST(p_partkey % 1500 AS STRING) END")
NORM = lambda c: f"regexp_replace(upper({c}), '[^A-Z0-9]', '', 'g')"
TOKS = lambda c: f"list_filter(regexp_split_to_array(upper({c}), '[^A-Z0-9]+'), lambda t: t <> '')"
NO_PRIMARY = r"regexp_replace(codebook_name, '(?i)\s*\((Primary)\)\s*$', '')"
NO_BRACKETS = r"regexp_replace({}, '\s*\(.*?\)\s*', '', 'g')"
SQL_HEADERS = rf"""hd AS (SELECT p_partkey AS position, {HEADER} AS header FROM part), cb AS (SELECT p_partkey AS cb_id, {CB_NAME} AS codebook_name FROM part),
ex AS (SELECT {NORM('codebook_name')} AS k, count(*) AS n, min(codebook_name) AS f FROM cb GROUP BY 1),
va AS (SELECT k, count(*) AS n, min(codebook_name) AS f FROM (SELECT DISTINCT cb_id, codebook_name, unnest([{NORM(NO_PRIMARY)}, {NORM(NO_BRACKETS.format('codebook_name'))}]) AS k FROM cb) GROUP BY 1),
h1 AS (SELECT hd.*, CASE WHEN ex.n = 1 THEN 'exact' WHEN va.n = 1 THEN 'variant' WHEN va.n IS NOT NULL THEN 'ambiguous' WHEN q.n = 1 THEN 'qualified' END AS mapping, CASE WHEN ex.n = 1 THEN ex.f WHEN va.n = 1 THEN va.f WHEN va.n IS NULL AND q.n = 1 THEN q.f END AS found
 FROM hd LEFT JOIN ex ON ex.k = {NORM('header')} LEFT JOIN va ON va.k = {NORM('header')} LEFT JOIN ex q ON q.k = {NORM(NO_BRACKETS.format('header'))}),
nr AS (SELECT position, count(*) AS n, min(codebook_name) AS near FROM (SELECT position, {TOKS('header')} AS ht FROM h1 WHERE mapping IS NULL) a JOIN (SELECT codebook_name, {TOKS('codebook_name')} AS vt FROM cb) b ON len(ht) = len(vt) AND ht <> vt
  AND len(list_filter(range(1, len(ht) + 1), lambda i: NOT starts_with(vt[i], ht[i]) OR length(ht[i]) < 3)) = 0 GROUP BY position),
hm AS (SELECT h1.position, header, coalesce(mapping, CASE WHEN nr.n = 1 THEN 'approximate' END, 'none') AS mapping, coalesce(found, CASE WHEN nr.n = 1 THEN near END) AS codebook_name FROM h1 LEFT JOIN nr USING (position))"""


def matched_headers(t):
    part = t.raw("part")
    return R.header_match(part.select(F.col("p_partkey").alias("position"), F.expr(HEADER).alias("header")), part.select(F.col("p_partkey").alias("cb_id"), F.expr(CB_NAME).alias("codebook_name")))


@query("header_match", f"WITH {SQL_HEADERS} SELECT position, header, mapping, codebook_name FROM hm")
def _(t):
    return matched_headers(t)


@query("schema_stats", f"WITH {SQL_HEADERS} SELECT count(*) AS n_fields, count(codebook_name) AS n_mapped, count(*) - count(codebook_name) AS n_rule_missing, count(*) FILTER (mapping NOT IN ('exact', 'variant')) AS n_with_issues FROM hm")
def _(t):
    return R.schema_stats(matched_headers(t))


# ------------------------------------------------------------------------------------------------ cases and jobs
JOB_COLUMNS = [("id", "event_id"), ("case_id", "user_id"), ("kind", "CASE WHEN event_type IN ('click', 'view', 'error') THEN 'research' ELSE 'recode' END"),
               ("status", "CASE event_id % 6 WHEN 0 THEN 'queued' WHEN 1 THEN 'running' WHEN 2 THEN 'needs_input' WHEN 3 THEN 'failed' WHEN 4 THEN 'cancelled' ELSE 'done' END"),
               ("stage", "CASE event_id % 5 WHEN 0 THEN 'identify' WHEN 1 THEN 'search' WHEN 2 THEN 'fetch' WHEN 3 THEN 'coding' ELSE 'review' END"),
               ("params", "CASE WHEN event_id % 4 = 0 THEN '{\"search_only\": true}' ELSE '{}' END"),
               ("state", "'{\"done\": ' || CASE WHEN event_id % 7 < 3 THEN '[\"identify\",\"search\",\"fetch\"]' ELSE '[\"identify\"]' END || CASE WHEN event_id % 8 = 2 THEN ', \"awaiting\": \"identity\"' ELSE '' END || ', \"limits_hit\": ' || CASE WHEN event_id % 9 = 0 THEN '[\"time\"]' ELSE '[]' END || '}'")]
SQL_JOBS = "jobs AS (SELECT " + ", ".join(f"{e} AS {n}" for n, e in JOB_COLUMNS) + " FROM events)"


def jobs(t):
    return t.raw("events").select(*[F.expr(e).alias(n) for n, e in JOB_COLUMNS])


def cases(t):
    return t.raw("customer").select(F.col("c_custkey").alias("case_id"), F.col("c_name").alias("name"))


@query("case_listing", with_tables("src", "rev", SQL_JOBS) + """
SELECT c_custkey AS case_id, c_name AS name, job_id, job_status, job_stage, coalesce(n_sources, 0) AS n_sources, coalesce(n_confirmed, 0) AS n_confirmed FROM customer
LEFT JOIN (SELECT case_id, max(id) AS job_id, arg_max(status, id) AS job_status, arg_max(stage, id) AS job_stage FROM jobs GROUP BY case_id) j ON j.case_id = c_custkey
LEFT JOIN (SELECT case_id, count(*) AS n_sources FROM src WHERE fetch_status = 'ok' GROUP BY case_id) s ON s.case_id = c_custkey LEFT JOIN (SELECT case_id, count(*) AS n_confirmed FROM rev WHERE action IN ('accepted', 'edited', 'cleared') GROUP BY case_id) r ON r.case_id = c_custkey""")
def _(t):
    return R.case_listing(cases(t), jobs(t), t.sources(), t.reviews())


EARLY = lambda j: f"({j}.stage IN ('queued', 'identify', 'search', 'fetch') AND NOT contains({j}.state, '\"fetch\"]'))"
WAITS = lambda j: f"contains({j}.state, 'awaiting')"


@query("case_statuses", with_tables("src", SQL_JOBS) + f"""
, lr AS (SELECT * FROM jobs WHERE kind = 'research' QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY id DESC) = 1),
la AS (SELECT * FROM jobs WHERE kind = 'recode' OR NOT contains(params, 'search_only') QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY id DESC) = 1),
sc AS (SELECT case_id, count(*) FILTER (fetch_status = 'ok') AS ok, count(*) FILTER (fetch_status <> 'ok') AS bad FROM src GROUP BY case_id)
SELECT c_custkey AS case_id, CASE WHEN r.id IS NULL THEN CASE WHEN coalesce(ok, 0) > 0 THEN 'complete' ELSE 'not_started' END WHEN r.status IN ('queued', 'running') AND {EARLY('r')} THEN 'running' WHEN r.status = 'needs_input' AND {EARLY('r')} AND {WAITS('r')} THEN 'waiting'
  WHEN r.status = 'failed' AND {EARLY('r')} THEN 'failed' WHEN r.status = 'cancelled' AND {EARLY('r')} THEN 'stopped' WHEN coalesce(ok, 0) = 0 THEN 'no_usable_content' WHEN coalesce(bad, 0) > 0 OR contains(r.state, '"time"') THEN 'partial' ELSE 'complete' END AS search_status,
 CASE WHEN a.id IS NULL THEN 'not_requested' WHEN a.status IN ('queued', 'running') THEN CASE WHEN a.kind = 'research' AND {EARLY('a')} THEN 'waiting_for_search' ELSE 'running' END
  WHEN a.status = 'needs_input' THEN CASE WHEN a.stage = 'fetch' AND NOT {WAITS('a')} THEN 'not_run_no_content' WHEN a.kind = 'research' AND {EARLY('a')} THEN 'waiting_for_search' ELSE 'waiting' END
  WHEN a.status = 'failed' THEN 'failed' WHEN a.status = 'cancelled' THEN 'stopped' WHEN a.id % 3 = 0 THEN 'complete' ELSE 'stopped' END AS analysis_status
FROM customer LEFT JOIN lr r ON r.case_id = c_custkey LEFT JOIN la a ON a.case_id = c_custkey LEFT JOIN sc ON sc.case_id = c_custkey""".replace("\n, lr AS", ", lr AS", 1))
def _(t):
    runs = t.raw("events").where("event_id % 3 = 0").select(F.col("event_id").alias("job_id"))
    return R.case_statuses(cases(t), jobs(t), t.sources(), runs)


BATCH_COLUMNS = [("case_id", "case_id"), ("provider", "provider"), ("model", "model"), ("batch_key", "'k' || CAST(id AS STRING)"), ("tokens", "input_tokens"), ("n_vars", "1 + id % 12")]
SQL_BATCHES = "bt AS (SELECT " + ", ".join(f"{e} AS {n}" for n, e in BATCH_COLUMNS) + ", id FROM cal)"
ONE_COST = SQL_COST.format(i="CAST(floor(tokens * 1.25) AS BIGINT)", o="out_max")
SQL_ESTIMATE = f"""pr2 AS ({SQL_PRICES}), b2 AS (SELECT bt.*, least(16000, 1500 + 1200 * n_vars) AS out_max, id % 3 <> 0 AS fresh FROM bt),
pm AS (SELECT case_id, provider, model, count(*) AS calls, count(*) FILTER (fresh) AS calls_uncached, sum(tokens)::BIGINT AS tin, sum(n_vars * 320)::BIGINT AS te, sum(out_max)::BIGINT AS tm, sum(CASE WHEN fresh THEN coalesce({ONE_COST}, 0) ELSE 0 END) AS nw FROM b2 LEFT JOIN pr2 USING (model) GROUP BY case_id, provider, model),
pc AS (SELECT pm.*, {SQL_COST.format(i='tin', o='CAST(floor(te * 0.6) AS BIGINT)')} AS lo, {SQL_COST.format(i='CAST(floor(tin * 1.25) AS BIGINT)', o='tm')} AS hi FROM pm LEFT JOIN pr2 USING (model)),
est AS (SELECT case_id, provider, sum(calls)::BIGINT AS calls, sum(calls_uncached)::BIGINT AS calls_uncached, sum(tin)::BIGINT AS input_tokens, sum(tm)::BIGINT AS output_tokens_max, CASE WHEN count(*) FILTER (lo IS NULL) = 0 THEN round(sum(lo), 5) END AS cost_low,
 CASE WHEN count(*) FILTER (hi IS NULL) = 0 THEN round(sum(hi), 5) END AS cost_high, CASE WHEN count(*) FILTER (hi IS NULL) = 0 THEN round(sum(round(nw, 4)), 5) END AS cost_high_new FROM pc GROUP BY case_id, provider)"""


def estimates(t):
    calls = t.calls()
    batches = calls.select(*[F.expr(e).alias(n) for n, e in BATCH_COLUMNS])
    return R.cost_estimate(batches, calls.where("id % 3 = 0").select(F.expr(BATCH_COLUMNS[3][1]).alias("batch_key")))


@query("cost_estimate", with_tables("cal", SQL_BATCHES, SQL_ESTIMATE) + "SELECT * FROM est")
def _(t):
    return estimates(t)


@query("limit_needs", with_tables("usg", "cal", SQL_BATCHES, SQL_ESTIMATE, SQL_ATTEMPTS) + """
, sp AS (SELECT case_id, sum(coalesce(cost_usd, 0)) AS s, sum(coalesce(cost_usd, 0)) FILTER (kind = 'model' AND provider = 'openai') AS sb FROM usg GROUP BY case_id),
at2 AS (SELECT case_id, sum(attempts)::BIGINT AS n, sum(attempts) FILTER (provider = 'openai')::BIGINT AS nb FROM att GROUP BY case_id),
ee AS (SELECT case_id, CASE WHEN count(*) FILTER (cost_high IS NULL) = 0 THEN sum(cost_high) END AS hi, sum(coalesce(cost_high, 0)) FILTER (provider = 'openai') AS hib, sum(calls_uncached)::BIGINT AS fr, sum(calls_uncached) FILTER (provider = 'openai')::BIGINT AS frb FROM est GROUP BY case_id),
j AS (SELECT ee.*, coalesce(s, 0) AS s, coalesce(sb, 0) AS sb, coalesce(n, 0) AS n, coalesce(nb, 0) AS nb FROM ee LEFT JOIN sp USING (case_id) LEFT JOIN at2 USING (case_id))
SELECT case_id, 'budget_usd' AS setting, 5.0::DOUBLE AS current, ceil(round((s + hi) * 100, 6)) / 100 AS needed FROM j WHERE s + hi > 5 + 1e-9
UNION ALL SELECT case_id, 'provider_b_budget_usd', 3.0, ceil(round((sb + hib) * 100, 6)) / 100 FROM j WHERE sb + hib > 3 + 1e-9
UNION ALL SELECT case_id, 'max_provider_b_attempts', 50.0, (nb + frb)::DOUBLE FROM j WHERE nb + frb > 50 UNION ALL SELECT case_id, 'max_attempts', 100.0, (n + fr)::DOUBLE FROM j WHERE n + fr > 100""".replace("\n, sp AS", ", sp AS", 1))
def _(t):
    return R.limit_needs(R.spend_ledger(t.usage()), R.attempts_ledger(t.calls(), t.usage()), estimates(t))


# ------------------------------------------------------------------------------------------------ ordered logic
SQL_ADMISSION = with_tables("cal") + """
SELECT case_id, id, reason FROM (SELECT case_id, unnest(ids) AS id, unnest(f.why[2:]) AS reason FROM (SELECT case_id, list(id ORDER BY id) AS ids,
 list_reduce(list_prepend({'c': 0.0::DOUBLE, 'isb': FALSE, 's': 0.0::DOUBLE, 'sb': 0.0::DOUBLE, 'n': 0::BIGINT, 'nb': 0::BIGINT, 'why': [NULL]::VARCHAR[]}, list({'c': worst_cost, 'isb': provider = 'openai', 's': 0.0::DOUBLE, 'sb': 0.0::DOUBLE, 'n': 0::BIGINT, 'nb': 0::BIGINT, 'why': []::VARCHAR[]} ORDER BY id)),
  lambda a, x: CASE WHEN a.s + x.c > 0.6 + 1e-9 THEN {'c': 0.0, 'isb': FALSE, 's': a.s, 'sb': a.sb, 'n': a.n, 'nb': a.nb, 'why': list_append(a.why, 'case budget')}
   WHEN x.isb AND a.sb + x.c > 0.3 + 1e-9 THEN {'c': 0.0, 'isb': FALSE, 's': a.s, 'sb': a.sb, 'n': a.n, 'nb': a.nb, 'why': list_append(a.why, 'provider budget')}
   WHEN x.isb AND a.nb >= 20 THEN {'c': 0.0, 'isb': FALSE, 's': a.s, 'sb': a.sb, 'n': a.n, 'nb': a.nb, 'why': list_append(a.why, 'provider attempt limit')}
   WHEN a.n >= 40 THEN {'c': 0.0, 'isb': FALSE, 's': a.s, 'sb': a.sb, 'n': a.n, 'nb': a.nb, 'why': list_append(a.why, 'attempt limit')}
   ELSE {'c': 0.0, 'isb': FALSE, 's': a.s + x.c, 'sb': a.sb + CASE WHEN x.isb THEN x.c ELSE 0 END, 'n': a.n + 1, 'nb': a.nb + CASE WHEN x.isb THEN 1 ELSE 0 END, 'why': list_append(a.why, NULL)} END) AS f FROM cal GROUP BY case_id))"""
ADMISSION = {"cap": 0.6, "cap_b": 0.3, "max_attempts": 40, "max_attempts_b": 20}


@query("budget_admission", SQL_ADMISSION)
def _(t):
    return O.budget_admission(t.calls(), **ADMISSION)


@query("repeat_error_abort", with_tables("cal") + """
SELECT run_id, id, CASE WHEN coalesce(max(twice) OVER (PARTITION BY run_id ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 THEN 'not sent' WHEN error_signature IS NOT NULL THEN 'failed' ELSE 'sent' END AS outcome
FROM (SELECT *, CASE WHEN error_signature LIKE 'HTTP 4%' AND error_signature = last_value(error_signature IGNORE NULLS) OVER (PARTITION BY run_id ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS twice FROM cal)""")
def _(t):
    return O.repeat_error_abort(t.calls())


PREFIX = "replace(substr(CAST(CAST(o_orderdate AS DATE) AS STRING), 1, 10), '-', '') || '-' || CASE o_custkey % 3 WHEN 0 THEN 'TX' WHEN 1 THEN 'CA' ELSE 'HI' END"


@query("sequence_ids", f"""WITH o AS (SELECT o_orderkey AS key, {PREFIX} AS prefix FROM orders), ex AS (SELECT prefix, max(key % 20) AS used FROM o WHERE key % 7 = 0 GROUP BY prefix)
SELECT key, prefix || CASE WHEN n < 10 THEN '0' || n ELSE n || '' END AS case_code FROM (SELECT key, o.prefix, row_number() OVER (PARTITION BY o.prefix ORDER BY key) + coalesce(used, 0) AS n FROM o LEFT JOIN ex ON ex.prefix = o.prefix WHERE key % 7 <> 0)""")
def _(t):
    rows = t.raw("orders").select(F.col("o_orderkey").alias("key"), F.expr(PREFIX).alias("prefix"))
    existing = rows.where("key % 7 = 0").select(F.concat("prefix", F.lpad((F.col("key") % 20).cast("string"), 2, "0")).alias("case_code"))
    return O.sequence_ids(rows.where("key % 7 <> 0"), existing)


@query("resume_todo", with_tables("res") + "SELECT case_id % 50 AS group_id, provider, variable FROM res GROUP BY ALL HAVING arg_max(status, id) = 'stopped'")
def _(t):
    return O.resume_todo(t.results().withColumn("group_id", F.col("case_id") % 50))


SQL_HISTORY = """hist AS (SELECT *, lag(new_value) OVER (PARTITION BY case_id, variable ORDER BY id) AS old_value FROM (SELECT id, case_id, variable, action, reason, reviewer,
 CASE WHEN action = 'reset' THEN NULL ELSE coalesce((last_value(aft IGNORE NULLS) OVER (PARTITION BY case_id, variable ORDER BY id ROWS UNBOUNDED PRECEDING)).v, '') END AS new_value FROM (SELECT *, CASE action WHEN 'reset' THEN {'v': NULL::VARCHAR} WHEN 'clear' THEN {'v': ''} WHEN 'defer' THEN NULL ELSE {'v': value} END AS aft FROM act)))"""


@query("variable_history", with_tables("res", "act", SQL_HISTORY) + """
SELECT case_id, variable, event, id, value, what, row_number() OVER (PARTITION BY case_id, variable ORDER BY event DESC, id) AS step FROM (SELECT case_id, variable, 'suggestion' AS event, id, value, status AS what FROM res
 UNION ALL SELECT case_id, variable, 'review', id, new_value, action FROM hist)""")
def _(t):
    history = H.review_history(t.review_actions()).withColumnRenamed("new_value", "value")
    return O.variable_history(t.results(), history)


# ------------------------------------------------------------------------------------------------ changes
@query("review_upsert", with_tables("act", SQL_HISTORY) + """
SELECT 'history' AS target, id, case_id, variable, action, old_value, new_value FROM hist
UNION ALL SELECT 'current', id, case_id, variable, CASE action WHEN 'accept' THEN 'accepted' WHEN 'edit' THEN 'edited' WHEN 'clear' THEN 'cleared' ELSE 'deferred' END, NULL, new_value FROM (SELECT * FROM hist QUALIFY row_number() OVER (PARTITION BY case_id, variable ORDER BY id DESC) = 1) WHERE action <> 'reset'""")
def _(t):
    history = H.review_history(t.review_actions())
    current = H.review_current(history)
    blank = F.lit(None).cast("string")
    return history.select(F.lit("history").alias("target"), "id", "case_id", "variable", "action", "old_value", "new_value").unionByName(
        current.select(F.lit("current").alias("target"), "id", "case_id", "variable", "action", blank.alias("old_value"), F.col("value").alias("new_value")))


@query("stale_propagation", with_tables("res", "src") + """
SELECT id, res.case_id, variable, 'cites excluded source S' || ev_source AS stale_reason FROM res JOIN src ON source_id = ev_source WHERE NOT stale AND (excluded OR relevance_status = 'irrelevant')""")
def _(t):
    return H.stale_propagation(coder_results(t), t.sources())


CACHE_KEYS = ["'n' || CAST(id % 400 AS STRING)", "'i' || CAST(id % 300 AS STRING)", "'p' || CAST(id % 200 AS STRING)", "'l' || CAST(id % 100 AS STRING)"]
STORED_KEY = "CASE event_id % 4 WHEN 0 THEN 'n' ELSE CASE event_id % 4 WHEN 1 THEN 'i' WHEN 2 THEN 'p' ELSE 'l' END END || CAST(event_id % 97 AS STRING)"


@query("cache_lookup", with_tables("cal", f"st AS (SELECT {STORED_KEY} AS k, min(event_id) AS reply_id FROM events GROUP BY 1)") + f"""
SELECT id AS request_id, CASE WHEN a.k IS NOT NULL THEN 'hit' WHEN b.k IS NOT NULL OR c.k IS NOT NULL THEN 'legacy_v2_hit' WHEN d.k IS NOT NULL THEN 'legacy_hit' ELSE 'new' END AS cache_status, coalesce(a.reply_id, b.reply_id, c.reply_id, d.reply_id) AS reply_id
FROM cal LEFT JOIN st a ON a.k = {CACHE_KEYS[0]} LEFT JOIN st b ON b.k = {CACHE_KEYS[1]} LEFT JOIN st c ON c.k = {CACHE_KEYS[2]} LEFT JOIN st d ON d.k = {CACHE_KEYS[3]}""")
def _(t):
    cache = t.raw("events").groupBy(F.expr(STORED_KEY).alias("cache_key")).agg(F.min("event_id").alias("reply_id"))
    return H.cache_lookup(t.calls().select(F.col("id").alias("request_id"), F.array(*[F.expr(k) for k in CACHE_KEYS]).alias("keys")), cache)


@query("in_flight_recovery", with_tables("cal") + """
SELECT 'call' AS target, id, case_id, CASE WHEN status = 'sending' THEN 'interrupted_possibly_billed' ELSE status END AS status, NULL::DOUBLE AS cost_usd FROM cal UNION ALL SELECT 'usage', id, case_id, 'estimated', worst_cost FROM cal WHERE status = 'sending'""")
def _(t):
    calls, usage = H.in_flight_recovery(t.calls())
    return calls.select(F.lit("call").alias("target"), "id", "case_id", "status", F.lit(None).cast("double").alias("cost_usd")).unionByName(
        usage.select(F.lit("usage").alias("target"), F.col("call_id").alias("id"), "case_id", F.lit("estimated").alias("status"), "cost_usd"))


@query("schema_evolve", with_tables("cal") + """
SELECT id, status, NULL::BIGINT AS batch_no, NULL::VARCHAR AS note FROM cal WHERE id % 2 = 0 UNION ALL SELECT id, status, batch_no, NULL FROM cal WHERE id % 2 = 1""")
def _(t):
    old = t.calls().where("id % 2 = 0").select("id", "status")
    wanted = T.StructType([T.StructField("id", T.LongType()), T.StructField("status", T.StringType()), T.StructField("batch_no", T.LongType()), T.StructField("note", T.StringType())])
    return H.merge_versions(H.schema_evolve(H.schema_evolve(old, wanted), wanted), t.calls().where("id % 2 = 1").select("id", "status", "batch_no"))


@query("archive_restore", with_tables("res") + "SELECT id, case_id, variable, value, stale, (provider = 'openai' OR interpretation = 'cross_model_review') AS was_archived FROM res")
def _(t):
    rows = t.results().select("id", "case_id", "variable", "value", "stale", "provider", "interpretation")
    kept, packed = H.archive(rows, (F.col("provider") == "openai") | (F.col("interpretation") == "cross_model_review"))
    back = H.restore(kept, packed)
    return back.join(packed.select("id", F.lit(True).alias("a")), "id", "left").select("id", "case_id", "variable", "value", "stale", F.coalesce("a", F.lit(False)).alias("was_archived"))
