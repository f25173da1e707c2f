"""Queries over latest results, comparison and agreement."""

from __future__ import annotations

from pyspark.sql import functions as F

from attesta.functions import fixed_values as fixed
from attesta.operators import compare as C
from attesta.operators import validation as V
from attesta.plans.registry import query, with_tables
from attesta.plans.text_queries import SQL_SPLIT, quoted
from attesta.sources.tables import values_sql

LISTED = {"LANGS": ["EN (English)", "FR (French)", "DE (German)", "ES (Spanish)"]}
CODE_LABELS = {"LENGTH_BAND": [("1", "short"), ("2", "medium"), ("3", "long")]}


def citation(source, seq, stance):
    """A citation of the passage with this number; documents whose number is divisible by four have pages."""
    source, seq = F.col(source), seq.cast("long")
    page = F.when(source % 4 == 0, F.floor((seq - 1) / 5) + 1)
    return F.struct(F.concat(F.lit("S"), source, F.lit("-P"), seq).alias("id"), source.alias("source_id"), F.col("quote"), F.lit(stance).alias("stance"), page.alias("page"), seq.alias("para"))


SQL_CITATION = ("{{'id': 'S' || {src} || '-P' || ({seq}), 'source_id': {src}, 'quote': quote, 'stance': '{stance}', "
                "'page': CASE WHEN {src} % 4 = 0 THEN (({seq}) - 1) // 5 + 1 END, 'para': ({seq})}}").format
SQL_CITED = (f"CASE WHEN ev_source IS NULL THEN [] WHEN id % 6 = 0 THEN [{SQL_CITATION(src='ev_source', seq='ev_seq', stance='supports')}, {SQL_CITATION(src='ev_source', seq='ev_seq + 1', stance='supports')}] "
             f"WHEN id % 6 = 1 THEN [{SQL_CITATION(src='ev_source', seq='ev_seq', stance='supports')}, {SQL_CITATION(src='ev_source', seq='ev_seq + 2', stance='alternative')}] ELSE [{SQL_CITATION(src='ev_source', seq='ev_seq', stance='supports')}] END AS evs, "
             f"CASE WHEN ctr_source IS NULL THEN [] ELSE [{SQL_CITATION(src='ctr_source', seq='ctr_seq', stance='contradicts')}] END AS ctrs")


def results(t):
    """Coder results with their citations, cited sources, number of counter-citations and the review reason."""
    first = citation("ev_source", F.col("ev_seq"), "supports")
    cites = (F.when(F.col("id") % 6 == 0, F.array(first, citation("ev_source", F.col("ev_seq") + 1, "supports")))
             .when(F.col("id") % 6 == 1, F.array(first, citation("ev_source", F.col("ev_seq") + 2, "alternative"))).otherwise(F.array(first)))
    none = F.array().cast(C.CITATIONS)
    return t.results().select(
        "*", F.when(F.col("ev_source").isNull(), none).otherwise(cites).alias("evidence"),
        F.when(F.col("ctr_source").isNull(), none).otherwise(F.array(citation("ctr_source", F.col("ctr_seq"), "contradicts"))).alias("counter"), F.array_compact(F.array("ev_source")).alias("evidence_sources"), F.when(F.col("ctr_source").isNull(), 0).otherwise(1).alias("n_counter"),
        V.review_reason().alias("review_reason")).drop("first_line")


def latest(t):
    return C.latest_results(results(t))


def pair(t):
    return C.pairs(latest(t), t.runs())


SQL_STATE = "CASE status " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in fixed.CELL_STATES) + " ELSE status END"
SQL_REASON = ("CASE WHEN coalesce(validation_status, '') = '' OR evidence_status = 'SUPPORTED' THEN '' WHEN evidence_status = 'INSUFFICIENT' AND trim(value) <> '' THEN 'not documented from silence' "
              "ELSE 'evidence status ' || coalesce(evidence_status, 'missing') END")
SQL_LATEST = f"""lat AS MATERIALIZED (SELECT r.*, {SQL_STATE} AS state, id <> newest AND newest_status = 'stopped' AS stopped_latest, {SQL_REASON} AS review_reason, CASE WHEN ev_source IS NULL THEN [] ELSE [ev_source] END AS src_list, {SQL_CITED}, CASE WHEN ctr_source IS NULL THEN 0 ELSE 1 END AS n_counter
 FROM (SELECT *, row_number() OVER (PARTITION BY case_id, variable, provider ORDER BY status <> 'stopped' DESC, id DESC) AS rn, max(id) OVER (PARTITION BY case_id, variable, provider) AS newest,
  arg_max(status, id) OVER (PARTITION BY case_id, variable, provider) AS newest_status FROM res) r WHERE rn = 1)"""
SET = lambda r: f"CASE WHEN {r}.status IN ({quoted(fixed.COMPARABLE_STATUSES)}) THEN list_sort(list_distinct(list_transform({SQL_SPLIT.format(c=r + '.value')}, lambda x: upper(x)))) ELSE [] END"
SQL_PAIR = f"""pr AS MATERIALIZED (SELECT a.case_id, a.variable, a.type, a, b, ra.model AS amodel, rb.model AS bmodel, ra.schema_version_id AS asv, rb.schema_version_id AS bsv, ra.prompt_version AS apv, rb.prompt_version AS bpv, {SET('a')} AS va, {SET('b')} AS vb,
 CASE WHEN a.interpretation = 'cross_model_review' OR b.interpretation = 'cross_model_review' THEN 'cross_model_review' WHEN a.snapshot_id = b.snapshot_id AND a.spec_id = b.spec_id THEN 'matched_version' ELSE 'cross_version' END AS kind,
 list_filter([CASE WHEN a.snapshot_id IS NULL OR b.snapshot_id IS NULL OR a.spec_id IS NULL OR b.spec_id IS NULL THEN 'version not recorded' END, CASE WHEN a.snapshot_id <> b.snapshot_id THEN 'evidence version' END,
  CASE WHEN ra.schema_version_id <> rb.schema_version_id THEN 'codebook version' END, CASE WHEN a.spec_id <> b.spec_id THEN 'analysis version' END, CASE WHEN ra.prompt_version <> rb.prompt_version THEN 'prompt version' END], lambda x: x IS NOT NULL) AS diffs
 FROM lat a JOIN lat b ON a.case_id = b.case_id AND a.variable = b.variable AND a.provider = 'anthropic' AND b.provider = 'openai' JOIN runs ra ON ra.run_id = a.run_id JOIN runs rb ON rb.run_id = b.run_id),
cmp AS MATERIALIZED (SELECT *, CASE WHEN a.status IN ('model_error', 'validation_failed') OR b.status IN ('model_error', 'validation_failed') THEN 'invalid_provider_output' WHEN a.status = 'not_coded_budget' OR b.status = 'not_coded_budget' THEN 'needs_human_review'
  WHEN (a.status = 'partially_valid' OR b.status = 'partially_valid') AND va = vb THEN 'needs_human_review'
  WHEN a.status = 'disputed' OR b.status = 'disputed' OR a.n_counter > 0 OR b.n_counter > 0 THEN CASE WHEN va <> vb THEN 'value_disagreement' ELSE 'needs_human_review' END
  WHEN len(va) = 0 AND len(vb) = 0 THEN 'both_insufficient' WHEN len(va) = 0 OR len(vb) = 0 THEN 'one_provider_blank' WHEN va <> vb THEN 'value_disagreement'
  WHEN len(a.src_list) > 0 AND len(b.src_list) > 0 AND NOT list_has_any(a.src_list, b.src_list) THEN 'evidence_disagreement' ELSE 'model_agreement' END AS comparison FROM pr WHERE a.state <> 'stopped' AND b.state <> 'stopped')"""
LAT = with_tables("res", "runs", SQL_LATEST)
PAIR = with_tables("res", "runs", SQL_LATEST, SQL_PAIR)


@query("latest_results", LAT + "SELECT case_id, variable, provider, id, value, status, state, stopped_latest FROM lat")
def _(t):
    return latest(t).select("case_id", "variable", "provider", "id", "value", "status", "state", "stopped_latest")


@query("changed_since_previous", with_tables("res") + """
SELECT case_id, variable, provider, id, value, status, old_value, old_status FROM (SELECT *, lag(value) OVER w AS old_value, lag(status) OVER w AS old_status, lead(id) OVER w AS nx FROM res WHERE status <> 'stopped'
 WINDOW w AS (PARTITION BY case_id, variable, provider ORDER BY id)) WHERE nx IS NULL AND (value <> old_value OR status <> old_status)""")
def _(t):
    return C.changed_since_previous(t.results())


SQL_CELL = lambda p: (f"coalesce(max(state) FILTER (provider = '{p}'), 'not_run')")
SQL_LABEL = lambda e: "CASE " + e + " " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in fixed.CELL_LABELS) + " END"


@query("provider_pivot", LAT + "SELECT case_id, variable, " + ", ".join(
    f"{SQL_CELL(p)} AS {p}_state, {SQL_LABEL(SQL_CELL(p))} AS {p}_label, coalesce(max(value) FILTER (provider = '{p}'), '') AS {p}_value, max(id) FILTER (provider = '{p}') AS {p}_id" for p in ("anthropic", "openai"))
    + " FROM lat WHERE NOT (provider = 'openai' AND case_id % 16 = 0) GROUP BY case_id, variable")
def _(t):
    return C.provider_pivot(C.latest_results(results(t).where("NOT (provider = 'openai' AND case_id % 16 = 0)")))


@query("compare_pair", PAIR + "SELECT case_id, variable, comparison, va = vb AND len(va) > 0 AS same_value FROM cmp")
def _(t):
    return C.compare_pair(pair(t)).select("case_id", "variable", "comparison", "same_value")


@query("comparison_kind", PAIR + "SELECT case_id, variable, kind FROM pr")
def _(t):
    return pair(t).select("case_id", "variable", C.comparison_kind(F.col("a"), F.col("b")).alias("kind"))


@query("version_differences", PAIR + "SELECT case_id, variable, array_to_string(diffs, ', ') AS differences FROM pr")
def _(t):
    return pair(t).select("case_id", "variable", F.array_join(C.version_differences(F.col("a"), F.col("b")), ", ").alias("differences"))


UNITED = "list_filter(list_concat(a.{n}, b.{n}), lambda e, i: list_position(list_transform(list_concat(a.{n}, b.{n}), lambda x: x.id), e.id) = i)".format
SQL_COMBINED = f"""comb AS (SELECT *, va = vb AND len(va) > 0 AS agreed, {UNITED(n='evs')} AS evs, {UNITED(n='ctrs')} AS ctrs FROM cmp)"""
SHOWN = "array_to_string(list_transform({n}, lambda e: concat_ws(' ', e.id, e.page, e.para, e.stance, e.quote)), '; ')".format


@query("combined_view", PAIR.rstrip() + f""", {SQL_COMBINED} SELECT case_id, variable, CASE WHEN agreed THEN CASE WHEN a.id < b.id THEN a.value ELSE b.value END ELSE '' END AS value,
 CASE WHEN agreed THEN CASE WHEN a.status = 'partially_valid' OR b.status = 'partially_valid' THEN 'partially_valid' ELSE 'suggested' END ELSE 'providers_differ' END AS status,
 array_to_string(list_sort(list_distinct(list_concat(a.src_list, b.src_list))), ',') AS sources, len(ctrs) AS n_counter, {SHOWN(n='evs')} AS evidence, {SHOWN(n='ctrs')} AS counter,
 'anthropic=' || a.value || '; openai=' || b.value AS provider_values, 'anthropic=' || coalesce(a.evidence_status, '-') || '; openai=' || coalesce(b.evidence_status, '-') AS provider_statuses,
 CASE WHEN a.evidence_status IS NOT DISTINCT FROM b.evidence_status THEN a.evidence_status ELSE 'MIXED' END AS evidence_status, a.stale OR b.stale AS stale FROM comb""")
def _(t):
    shown = lambda n: F.array_join(F.transform(n, lambda e: F.concat_ws(" ", e["id"], e["page"], e["para"], e["stance"], e["quote"])), "; ")
    said = lambda n: F.concat_ws("; ", *[F.concat(F.lit(f"{p}="), F.coalesce(F.col(n)[p], F.lit("-"))) for p in (C.A, C.B)])
    return C.combined_view(pair(t)).select(
        "case_id", "variable", "value", "status", F.array_join("evidence_sources", ",").alias("sources"), "n_counter", shown("evidence").alias("evidence"),
        shown("counter").alias("counter"), said("values_by_provider").alias("provider_values"), said("evidence_statuses").alias("provider_statuses"), "evidence_status", "stale")


N1 = r"regexp_full_match({c}, '-?\d+(\.\d+)?')"
UPS = "list_transform(" + SQL_SPLIT + ", lambda x: upper(x))"


def sql_normal(kind, v):
    clean = f"trim(replace(replace({v}, ',', ''), '%', ''))"
    ups = UPS.format(c=v)
    return (f"CASE WHEN trim(coalesce({v}, '')) = '' THEN NULL WHEN {kind} IN ('categorical', 'open_list') THEN CASE WHEN len({ups}) > 0 AND len(list_distinct({ups})) = len({ups}) THEN 'set:' || array_to_string(list_sort({ups}), '|') END "
            f"WHEN {kind} = 'numeric' THEN CASE WHEN {N1.format(c=clean)} THEN 'num:' || CAST(try_cast({clean} AS DOUBLE) AS VARCHAR) END "
            f"WHEN {kind} = 'date' AND regexp_full_match(trim({v}), '\\d{{4}}-\\d{{2}}-\\d{{2}}') THEN 'date:' || CAST(try_cast(trim({v}) AS DATE) AS VARCHAR) END")


@query("normalize_value", with_tables("res") + f"SELECT id, {sql_normal('type', 'value')} AS normal FROM res")
def _(t):
    return t.results().select("id", C.normalize_value(F.col("type"), F.col("value")).alias("normal"))


CALL_ROWS = [(0, "LENGTH_BAND|LANGS|N_LINES"), (1, "SEEN_ON|NOTE"), (2, "LANGS|NOTE")]
CALL_HASH = "'h' || CAST(case_id % 7 + CASE WHEN case_id % 21 = 0 AND provider = 'openai' AND i = 2 THEN 50 ELSE 0 END + i AS STRING)"


def run_calls(t):
    rows = F.inline(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(v).alias("vs")) for i, v in CALL_ROWS]))
    df = t.runs().select("run_id", "case_id", "provider", rows)
    return df.select((F.col("run_id") * 3 + F.col("i")).alias("id"), "run_id", F.expr(CALL_HASH).alias("evidence_hash"), F.split("vs", r"\|").alias("variables"))


SQL_HASHES = ("bh AS MATERIALIZED (SELECT run_id, variable, arg_max(evidence_hash, id) AS evidence_hash FROM (SELECT run_id, run_id * 3 + i AS id, " + CALL_HASH +
              " AS evidence_hash, unnest(string_split(vs, '|')) AS variable FROM runs, (VALUES " + ", ".join(f"({i}, '{v}')" for i, v in CALL_ROWS) + ") AS c(i, vs)) GROUP BY run_id, variable)")


@query("batch_evidence_hash", with_tables("runs", SQL_HASHES) + "SELECT run_id, variable, evidence_hash FROM bh")
def _(t):
    return C.batch_evidence_hash(run_calls(t))


DONE = lambda r: f"{r}.status IN ({quoted(fixed.COMPLETED_STATUSES)})"
VS = "('suggested', 'rule_unclear', 'disputed', 'partially_valid')"
UNSUP = lambda r, who: (f"CASE WHEN coalesce({r}.validation_status, '') <> '' AND {r}.evidence_status IS NULL THEN '{who} gave no evidence status' "
                        f"WHEN coalesce({r}.validation_status, '') <> '' AND {r}.evidence_status <> 'SUPPORTED' THEN '{who} marked the evidence ' || {r}.evidence_status END")
SQL_AG_LABELS = "CASE status " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in fixed.AGREEMENT_LABELS) + " END"
SQL_ASSESS = f"""as1 AS (SELECT pr.*, ha.evidence_hash AS hash_a, hb.evidence_hash AS hash_b, rv.action AS ract, rv.value AS rval, rv.method AS rmeth, kind = 'cross_version' AS crossv, coalesce(rv.action IN ('accepted', 'edited', 'cleared'), FALSE) AS final,
 CASE WHEN a.status IN {VS} THEN {sql_normal('pr.type', 'a.value')} END AS na, CASE WHEN b.status IN {VS} THEN {sql_normal('pr.type', 'b.value')} END AS nb
 FROM pr LEFT JOIN bh ha ON ha.run_id = a.run_id AND ha.variable = pr.variable LEFT JOIN bh hb ON hb.run_id = b.run_id AND hb.variable = pr.variable LEFT JOIN rev rv ON rv.case_id = pr.case_id AND rv.variable = pr.variable),
as2 AS (SELECT *, list_filter([CASE WHEN a.status = 'partially_valid' OR b.status = 'partially_valid' THEN 'partially valid output' WHEN a.status <> 'suggested' OR b.status <> 'suggested' THEN 'disputed or rule unclear' END,
  CASE WHEN a.n_counter > 0 OR b.n_counter > 0 THEN 'counter-evidence reported' END, {UNSUP('a', 'A')}, {UNSUP('b', 'B')}, CASE WHEN a.stale OR b.stale THEN 'cites an excluded source' END,
  CASE WHEN len(a.src_list) = 0 OR len(b.src_list) = 0 THEN 'missing supporting evidence' END, CASE WHEN type = 'open_list' AND len(list_filter({UPS.format(c='a.value')}, lambda p: p NOT IN ('EN', 'FR', 'DE', 'ES'))) > 0 THEN 'open-list value not listed' END,
  CASE WHEN asv <> bsv THEN 'codebook versions differ' END, CASE WHEN NOT crossv AND hash_a IS DISTINCT FROM hash_b THEN 'batch evidence differs' END, CASE WHEN ract = 'deferred' THEN 'deferred by a reviewer' END], lambda x: x IS NOT NULL) AS probs FROM as1),
ass AS MATERIALIZED (SELECT case_id, variable, kind, na, nb, final, status, {SQL_AG_LABELS} AS label, starts_with(status, 'eligible') AS eligible, CASE WHEN na = nb AND NOT final AND status = 'pending' THEN array_to_string(probs, '; ') ELSE '' END AS problems,
 value, array_to_string(diffs, ', ') AS differences, reused FROM (SELECT *, a.value AS value, a.cache_status IN ('hit', 'legacy_v2_hit', 'legacy_hit') OR b.cache_status IN ('hit', 'legacy_v2_hit', 'legacy_hit') AS reused,
 CASE WHEN NOT {DONE('a')} AND NOT {DONE('b')} THEN 'pending' WHEN {DONE('a')} AND NOT {DONE('b')} THEN 'claude_only' WHEN {DONE('b')} AND NOT {DONE('a')} THEN 'openai_only' WHEN kind = 'cross_model_review' THEN 'cross_model_review'
  WHEN a.status = 'validation_failed' OR b.status = 'validation_failed' THEN 'validation_failed' WHEN trim(a.value) = '' AND trim(b.value) = '' THEN 'both_insufficient' WHEN trim(a.value) = '' OR trim(b.value) = '' THEN 'pending'
  WHEN type NOT IN ('categorical', 'numeric', 'date', 'open_list') OR na IS NULL OR nb IS NULL THEN 'pending' WHEN na <> nb THEN CASE WHEN crossv THEN 'cross_version_disagreement' ELSE 'value_disagreement' END
  WHEN final THEN CASE WHEN coalesce(rmeth LIKE 'bulk%', FALSE) OR coalesce({sql_normal('type', 'rval')} = na, FALSE) THEN 'confirmed' ELSE 'pending' END
  WHEN len(probs) > 0 THEN 'pending' WHEN crossv THEN 'eligible_cross_version' WHEN NOT list_has_any(a.src_list, b.src_list) THEN 'eligible_evidence_difference' ELSE 'eligible' END AS status FROM as2))"""
ASSESS = with_tables("res", "runs", "rev", SQL_LATEST, SQL_PAIR, SQL_HASHES, SQL_ASSESS)


def assessed(t):
    narrow = C.pairs(C.latest_results(results(t).select(C.AGREEMENT_COLUMNS)), t.runs())
    return C.assess_agreement(narrow, t.reviews(), C.batch_evidence_hash(run_calls(t)), LISTED)


@query("assess_agreement", ASSESS + "SELECT case_id, variable, status, label, eligible, problems, value, kind, differences, reused FROM ass")
def _(t):
    return assessed(t)


@query("eligible_summary", ASSESS.rstrip() + ", cl AS (" + values_sql([(v, c, lb) for v, cs in CODE_LABELS.items() for c, lb in cs], "variable string, code string, code_label string") + f""")
SELECT case_id, variable, label, value, coalesce((SELECT string_agg(code_label, '; ' ORDER BY i) FROM (SELECT unnest({SQL_SPLIT.format(c='ass.value')}) AS part, generate_subscripts({SQL_SPLIT.format(c='ass.value')}, 1) AS i) JOIN cl ON cl.variable = ass.variable AND cl.code = upper(part)), '') AS value_label, 1 AS n FROM ass WHERE eligible
UNION ALL SELECT case_id, NULL, label, NULL, NULL, count(*) FROM ass WHERE NOT eligible GROUP BY case_id, label""")
def _(t):
    return C.eligible_summary(assessed(t), CODE_LABELS)


@query("bulk_confirm", ASSESS.rstrip() + """, sel AS (SELECT doc_id AS case_id, unnest(['LENGTH_BAND', 'N_LINES', 'SEEN_ON', 'NO_SUCH']) AS variable FROM documents),
halt AS (SELECT DISTINCT case_id FROM sel JOIN ass USING (case_id, variable) WHERE status = 'eligible_cross_version'),
o AS (SELECT sel.case_id, sel.variable, ass.value, ass.status, CASE WHEN halt.case_id IS NOT NULL THEN 'version warning not acknowledged' WHEN NOT coalesce(eligible, FALSE) THEN coalesce(CASE WHEN problems <> '' THEN problems END, label, 'not eligible') WHEN rev.case_id IS NOT NULL THEN 'a review already exists' END AS reason
 FROM sel LEFT JOIN ass USING (case_id, variable) LEFT JOIN rev ON rev.case_id = sel.case_id AND rev.variable = sel.variable LEFT JOIN halt ON halt.case_id = sel.case_id)
SELECT case_id, variable, CASE WHEN reason IS NULL THEN 'confirmed' ELSE 'skipped' END AS outcome, CASE WHEN reason IS NULL THEN value END AS value, CASE WHEN reason IS NULL THEN 'bulk_independent_agreement' END AS method, reason FROM o""")
def _(t):
    selected = t.raw("documents").select(F.col("doc_id").alias("case_id"), F.explode(F.array(*[F.lit(v) for v in ("LENGTH_BAND", "N_LINES", "SEEN_ON", "NO_SUCH")])).alias("variable"))
    return C.bulk_confirm(selected, assessed(t), t.reviews(), acknowledged=False)


@query("coder_vs_human", with_tables("res", "runs", "rev", SQL_LATEST) + f"""
SELECT variable, provider, count(*) FILTER (v = 'agree') AS agree, count(*) FILTER (v = 'disagree') AS disagree, count(*) FILTER (v = 'blank') AS blank, count(*) FILTER (v = 'disputed') AS disputed FROM (
 SELECT lat.variable, provider, CASE WHEN status = 'disputed' THEN 'disputed' WHEN trim(lat.value) = '' THEN 'blank' WHEN coalesce({sql_normal('type', 'lat.value')} = {sql_normal('type', 'rev.value')}, lat.value = rev.value) THEN 'agree' ELSE 'disagree' END AS v
 FROM lat JOIN rev ON rev.case_id = lat.case_id AND rev.variable = lat.variable AND action IN ('accepted', 'edited') AND rev.value <> '') GROUP BY variable, provider""")
def _(t):
    return C.coder_vs_human(latest(t), t.reviews())


SQL_DISPLAY = """disp AS MATERIALIZED (SELECT case_id, variable, CASE WHEN va = vb AND len(va) > 0 THEN CASE WHEN a.id < b.id THEN a.value ELSE b.value END ELSE '' END AS value,
  CASE WHEN va = vb AND len(va) > 0 THEN CASE WHEN a.status = 'partially_valid' OR b.status = 'partially_valid' THEN 'partially_valid' ELSE 'suggested' END ELSE 'providers_differ' END AS status, a.n_counter + b.n_counter AS n_counter,
  CASE WHEN a.review_reason <> '' AND b.review_reason <> '' THEN a.review_reason || '; ' || b.review_reason ELSE a.review_reason || b.review_reason END AS why, comparison, kind, va = vb AND len(va) > 0 AS same_value FROM cmp
 UNION ALL SELECT case_id, variable, s.value, s.status, s.n_counter, s.review_reason, NULL, NULL, NULL FROM (SELECT case_id, variable, CASE WHEN a.state <> 'stopped' THEN a WHEN b.state <> 'stopped' THEN b WHEN a.id > b.id THEN a ELSE b END AS s
  FROM pr WHERE a.state = 'stopped' OR b.state = 'stopped'))"""
DISPLAY = with_tables("res", "runs", "rev", SQL_LATEST, SQL_PAIR, SQL_DISPLAY)
FINAL = "coalesce(rev.action IN ('accepted', 'edited', 'cleared'), FALSE)"


def display(t):
    return C.display_rows(pair(t))


@query("current_value", DISPLAY + f"""
SELECT coalesce(disp.case_id, rev.case_id) AS case_id, coalesce(disp.variable, rev.variable) AS variable, CASE WHEN {FINAL} THEN rev.value WHEN coalesce(comparison <> 'model_agreement', FALSE) OR coalesce(why, '') <> '' OR status NOT IN ('suggested', 'derived', 'admin_generated') OR status IS NULL THEN '' ELSE disp.value END AS value,
 CASE WHEN {FINAL} THEN 'reviewed' WHEN coalesce(comparison <> 'model_agreement', FALSE) THEN 'providers disagree' WHEN coalesce(why, '') <> '' THEN why ELSE 'suggestion' END AS origin
FROM disp FULL JOIN rev ON rev.case_id = disp.case_id AND rev.variable = disp.variable""")
def _(t):
    return C.current_value(display(t), t.reviews())


SQL_EXPORT = f"""exv AS MATERIALIZED (SELECT coalesce(disp.case_id, rev.case_id) AS case_id, coalesce(disp.variable, rev.variable) AS variable, comparison, kind, same_value, status, why, rev.action AS r_action, rev.reason AS r_reason, rev.method AS r_method,
 CASE WHEN {FINAL} THEN 'reviewed' WHEN coalesce(comparison <> 'model_agreement', FALSE) OR NOT coalesce(status IN ('suggested', 'derived', 'admin_generated', 'rule_unclear') AND disp.value <> '' AND coalesce(why, '') = '', FALSE) THEN 'blank' ELSE 'UNREVIEWED' END AS origin,
 CASE WHEN {FINAL} THEN rev.value WHEN coalesce(comparison <> 'model_agreement', FALSE) OR NOT coalesce(status IN ('suggested', 'derived', 'admin_generated', 'rule_unclear') AND disp.value <> '' AND coalesce(why, '') = '', FALSE) THEN '' ELSE disp.value END AS export_value
 FROM disp FULL JOIN rev ON rev.case_id = disp.case_id AND rev.variable = disp.variable)"""


@query("export_value", DISPLAY.rstrip() + f", {SQL_EXPORT} SELECT case_id, variable, export_value, origin FROM exv")
def _(t):
    return C.export_value(display(t), t.reviews(), True).select("case_id", "variable", "export_value", "origin")


GRID = ["LENGTH_BAND", "LANGS", "N_LINES", "SEEN_ON", "NOTE", "UNMAPPED_FIELD"]
SQL_CATEGORY = f"""cat AS (SELECT case_id, variable, CASE WHEN base = 'insufficient' AND status IS NULL AND NOT analyzed THEN 'not_analyzed' WHEN base NOT IN ('confirmed', 'rule_missing') AND comparison NOT IN ('model_agreement', 'both_insufficient', 'evidence_disagreement') THEN 'disputed'
  WHEN base NOT IN ('confirmed', 'rule_missing') AND comparison = 'evidence_disagreement' THEN 'pending' ELSE base END AS category FROM (
 SELECT g.case_id, g.variable, d.status, d.comparison, g.case_id % 97 <> 0 AS analyzed, CASE WHEN rev.action IN ('accepted', 'edited', 'cleared') THEN 'confirmed' WHEN g.variable = 'UNMAPPED_FIELD' THEN 'rule_missing'
  WHEN d.status = 'disputed' OR (d.status IN ('suggested', 'derived', 'admin_generated', 'rule_unclear') AND d.n_counter > 0) THEN 'disputed'
  WHEN d.status = 'partially_valid' OR (d.status IN ('suggested', 'derived', 'admin_generated', 'rule_unclear') AND d.value <> '') OR rev.action = 'deferred' THEN 'pending' ELSE 'insufficient' END AS base
 FROM (SELECT doc_id AS case_id, unnest([{quoted(GRID)}]) AS variable FROM documents) g LEFT JOIN (SELECT * FROM disp WHERE case_id % 97 <> 0) d USING (case_id, variable) LEFT JOIN rev USING (case_id, variable)))"""


def categories(t):
    grid = t.raw("documents").select(F.col("doc_id").alias("case_id"), F.explode(F.array(*[F.lit(v) for v in GRID])).alias("variable")).withColumn(
        "rule_missing", F.col("variable") == "UNMAPPED_FIELD")
    shown = C.display_rows(C.pairs(C.latest_results(results(t).where("case_id % 97 <> 0")), t.runs()))
    return C.review_category(grid, shown, t.reviews(), t.runs().where("case_id % 97 <> 0"))


@query("review_category", DISPLAY.rstrip() + f", {SQL_CATEGORY} SELECT * FROM cat")
def _(t):
    return categories(t)


@query("review_category_counts", DISPLAY.rstrip() + f", {SQL_CATEGORY} SELECT coalesce(category, 'all') AS category, count(*) AS n FROM cat GROUP BY ROLLUP (category)")
def _(t):
    return categories(t).rollup("category").agg(F.count("*").alias("n")).withColumn("category", F.coalesce("category", F.lit("all")))


@query("comparison_counts", PAIR + "SELECT comparison, count(*) AS n FROM cmp GROUP BY comparison")
def _(t):
    return C.compare_pair(pair(t)).groupBy("comparison").agg(F.count("*").alias("n"))
