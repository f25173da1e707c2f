"""Queries over the export tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from attesta.functions import fixed_values as fixed
from attesta.operators import compare as C
from attesta.operators import exports as E
from attesta.plans.compare_queries import DISPLAY, SQL_EXPORT, UNITED, display, latest, pair
from attesta.plans.evidence_queries import HASHED, MARKED, SQL_USABLE
from attesta.plans.registry import query, with_tables
from attesta.plans.retrieval_queries import SQL_PRIORITY
from attesta.plans.rollup_queries import SOURCES, full_sources
from attesta.plans.text_queries import SQL_HOST
from attesta.sources.stand_ins import SQL_TABLES

case = lambda col, rows, other: f"CASE {col} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in rows) + f" ELSE {other} END"
DISPLAY_SRC = DISPLAY.replace("comparison, kind, va = vb AND len(va) > 0 AS same_value FROM cmp", f"""comparison, kind, va = vb AND len(va) > 0 AS same_value, {UNITED(n='evs')} AS evs, {UNITED(n='ctrs')} AS ctrs,
  'Claude=' || CASE WHEN a.value = '' THEN '(blank)' ELSE a.value END || '; GPT=' || CASE WHEN b.value = '' THEN '(blank)' ELSE b.value END AS said, NULL AS provider, NULL AS model, NULL AS rationale FROM cmp""").replace(
    "s.review_reason, NULL, NULL, NULL FROM", "s.review_reason, NULL, NULL, NULL, s.evs, s.ctrs, NULL, s.provider, CASE s.provider WHEN 'anthropic' THEN amodel ELSE bmodel END, s.rationale FROM").replace(
    "FROM (SELECT case_id, variable, CASE WHEN a.state", "FROM (SELECT case_id, variable, amodel, bmodel, CASE WHEN a.state")
EXPORT_SRC = SQL_EXPORT.replace("SELECT coalesce(disp.case_id", "SELECT evs, ctrs, said, provider, model, rationale, rev.reviewer AS r_reviewer, rev.source_provider AS r_source, coalesce(disp.case_id", 1)
EXPORTED = DISPLAY_SRC.rstrip() + ", " + with_tables("src").split("RECURSIVE ", 1)[1].rstrip() + ", " + EXPORT_SRC
API_ALL = "array_to_string(list_transform(string_split({c}, '+'), lambda p: " + case("p", fixed.PROVIDER_API_NAMES, "p") + "), ' + ')"


def values(t):
    return C.export_value(display(t), t.reviews(), True)


@query("export_long", EXPORTED + f""", ci AS (SELECT case_id, variable, e, i FROM (SELECT case_id, variable, unnest(evs) AS e, generate_subscripts(evs, 1) AS i FROM exv WHERE export_value <> '') WHERE e.stance = 'supports'),
cells AS (SELECT case_id, variable, string_agg(cell, '; ' ORDER BY i) AS source FROM (SELECT ci.case_id, ci.variable, min(i) AS i,
  e.id || CASE WHEN e.page IS NOT NULL THEN ' p.' || e.page ELSE ' para ' || e.para END || coalesce(' ' || coalesce(final_url, url), '') AS cell FROM ci LEFT JOIN (SELECT source_id, final_url, url FROM src) s ON s.source_id = e.source_id GROUP BY ALL) GROUP BY case_id, variable)
SELECT exv.case_id, exv.variable, export_value AS value, coalesce(source, '') AS source, origin, concat_ws(' ', CASE WHEN origin = 'UNREVIEWED' THEN '[UNREVIEWED SUGGESTION — not confirmed by a human coder]' END,
 CASE WHEN provider IS NOT NULL AND origin <> 'reviewed' THEN '[model: ' || provider || ' ' || model || ']' END, CASE WHEN said IS NOT NULL AND origin <> 'reviewed' THEN '[independent providers: ' || said || ']' END,
 CASE WHEN r_method = 'bulk_independent_agreement' THEN '[human-confirmed independent model agreement (bulk confirmation) by ' || r_reviewer || ']'
  WHEN r_method = 'bulk_separate_run_agreement' THEN '[human-confirmed CROSS-VERSION model agreement (bulk confirmation, version warning acknowledged) by ' || r_reviewer || ']'
  WHEN r_source IS NOT NULL THEN '[accepted from ' || {API_ALL.format(c='r_source')} || ' suggestion]' END,
 CASE WHEN comparison <> 'model_agreement' THEN '[providers: ' || {case('comparison', fixed.COMPARISON_LABELS, 'comparison')} || '; human decision needed]' END,
 CASE WHEN kind = 'cross_version' THEN CASE WHEN same_value THEN '[cross-version: same suggested value, different analysis versions]' ELSE '[cross-version: results differ, but the models also used different analysis inputs]' END END,
 CASE WHEN r_action IN ('edited', 'cleared') AND r_reason <> '' THEN 'Reviewer: ' || r_reason END, nullif(rationale, ''), CASE WHEN origin = 'blank' AND status NOT IN ('suggested', 'derived', 'admin_generated', 'rule_unclear') THEN '(status: ' || status || ')' END,
 CASE WHEN origin = 'blank' AND coalesce(why, '') <> '' THEN '(' || why || ')' END) AS explanation FROM exv LEFT JOIN cells ON cells.case_id = exv.case_id AND cells.variable = exv.variable""")
def _(t):
    return E.export_long(values(t), t.sources())


COLUMNS = [("LENGTH_BAND", "categorical"), ("LANGS", "open_list"), ("N_LINES", "numeric"), ("SEEN_ON", "date"), ("NOTE", "text")]


@query("export_case_row", EXPORTED + """
SELECT case_id, max(CASE WHEN export_value <> '' THEN export_value END) FILTER (variable = 'LENGTH_BAND') AS "LENGTH_BAND", max(CASE WHEN export_value <> '' THEN export_value END) FILTER (variable = 'LANGS') AS "LANGS",
 max(CASE WHEN regexp_full_match(export_value, '-?\\d+(\\.\\d+)?') THEN try_cast(export_value AS DOUBLE) END) FILTER (variable = 'N_LINES') AS "N_LINES",
 max(CASE WHEN regexp_full_match(export_value, '\\d{4}-\\d{2}-\\d{2}') THEN CAST(try_cast(export_value AS DATE) AS VARCHAR) END) FILTER (variable = 'SEEN_ON') AS "SEEN_ON", max(CASE WHEN export_value <> '' THEN export_value END) FILTER (variable = 'NOTE') AS "NOTE" FROM exv GROUP BY case_id""")
def _(t):
    return E.export_case_row(values(t), COLUMNS)


API = lambda c: case(c, fixed.PROVIDER_API_NAMES, c)


@query("export_evidence", DISPLAY.rstrip() + ", " + with_tables("src").split("RECURSIVE ", 1)[1].rstrip() + f""", cit AS (SELECT case_id, variable, provider, interpretation, unnest(list_concat(evs, ctrs)) AS e FROM lat)
SELECT c.case_id, variable, e.stance AS stance, e.id AS passage, 'S' || e.source_id AS source, e.page AS page, e.para AS para, e.quote AS quote, coalesce(final_url, url) AS url, source_type, {API('provider')} AS provider, interpretation FROM cit c LEFT JOIN src ON src.source_id = e.source_id""")
def _(t):
    return E.export_evidence(latest(t), t.sources())


@query("export_provider_suggestions", DISPLAY.rstrip() + f"""
SELECT lat.case_id, lat.variable, {API('lat.provider')} AS provider, model, lat.value, lat.status, lat.cache_status, coalesce(CAST(lat.snapshot_id AS VARCHAR), 'not recorded') AS snapshot_id, coalesce(CAST(lat.spec_id AS VARCHAR), 'not recorded') AS spec_id, lat.run_id,
 strftime(make_timestamp(lat.generated_at * 1000000), '%Y-%m-%d %H:%M:%S') AS generated_at, coalesce({case("CASE WHEN rev.action IN ('accepted', 'edited', 'cleared') AND comparison IS NOT NULL THEN 'human_approved' ELSE comparison END", fixed.COMPARISON_LABELS, 'NULL')}, '') AS comparison,
 CASE WHEN rev.action IN ('accepted', 'edited', 'cleared') THEN rev.value ELSE '' END AS approved, coalesce(lat.evidence_status, 'not recorded') AS evidence_status
FROM lat LEFT JOIN runs ON runs.run_id = lat.run_id LEFT JOIN cmp ON cmp.case_id = lat.case_id AND cmp.variable = lat.variable LEFT JOIN rev ON rev.case_id = lat.case_id AND rev.variable = lat.variable""")
def _(t):
    return E.export_provider_suggestions(latest(t), t.runs(), C.compare_pair(pair(t)), t.reviews())


@query("export_sources", with_tables("src", HASHED, MARKED, SOURCES) + f"""
SELECT case_id, row_number() OVER (PARTITION BY case_id ORDER BY {SQL_PRIORITY}, -coalesce(n_pages, 0), -n_passages, source_id) AS rank, 'S' || source_id AS source, title, {case('source_type', fixed.SOURCE_TYPE_LABELS, 'source_type')} AS type,
 regexp_replace({SQL_HOST.format(c='url')}, '^www\\.', '') AS domain, lang, url, CASE WHEN final_url IS NOT NULL AND final_url <> url THEN final_url ELSE '' END AS final_url, CASE WHEN fetch_status = 'ok' THEN 'retrieved' ELSE 'not retrieved (' || fetch_status || ')' END AS retrieval,
 coalesce('S' || duplicate_of, '') AS duplicate_of, CASE WHEN {SQL_USABLE} AND n_passages > 0 THEN 'yes' ELSE 'no' END AS usable, CASE WHEN job_id IS NOT NULL THEN 'run ' || job_id WHEN origin IN ('manual_url', 'upload', 'text') THEN 'added by user' ELSE '' END AS search_run
FROM so WHERE NOT excluded""")
def _(t):
    return E.export_sources(full_sources(t))


# further tables of a bundle: section, its item, its columns and its table in the checking SQL
SECTIONS = {
    "review": ("variable", ["variable", "action", "value", "reason", "reviewer", "source_provider"], "rev"),
    "bulk": ("variable", ["variable", "value", "reviewer", "method"], "(SELECT * FROM rev WHERE method IS NOT NULL)"),
    "source": ("source_id", ["source_id", "title", "url", "final_url", "source_type", "excluded"], "src"),
    "search": ("id", ["id", "provider"], "(SELECT * FROM usg WHERE kind = 'search')"),
    "usage": ("id", ["id", "kind", "provider", "input_tokens", "output_tokens", "estimated"], "usg"),
    "run": ("run_id", ["run_id", "provider", "schema_version_id", "prompt_version", "model"], "runs"),
}
object_of = lambda columns: "CAST(to_json({" + ", ".join(f"'{c}': {c}" for c in columns) + "}) AS VARCHAR)"


@query("export_json_bundle", EXPORTED + ", " + SQL_TABLES["psg"] + ", " + SQL_TABLES["usg"] + f"""
SELECT case_id, 'result' AS section, variable AS item, CAST(to_json({{'variable': variable, 'export_value': export_value, 'origin': origin, 'evidence': coalesce(evs, []), 'counter': coalesce(ctrs, [])}}) AS VARCHAR) AS json FROM exv
UNION ALL SELECT case_id, 'passage', passage_id, {object_of(['passage_id', 'seq', 'text'])} FROM psg WHERE passage_id IN (SELECT e.id FROM (SELECT unnest(list_concat(evs, ctrs)) AS e FROM exv))
""" + "".join(f"UNION ALL SELECT case_id, '{name}', CAST({item} AS VARCHAR), {object_of(columns)} FROM {table}\n" for name, (item, columns, table) in SECTIONS.items()))
def _(t):
    usage = t.usage()
    tables = {"review": t.reviews(), "bulk": t.reviews().where("method IS NOT NULL"), "source": t.sources(), "search": usage.where("kind = 'search'"), "usage": usage, "run": t.runs()}
    return E.export_json_bundle(values(t), t.passages(), {name: (item, tables[name].select("case_id", *columns)) for name, (item, columns, _) in SECTIONS.items()})
