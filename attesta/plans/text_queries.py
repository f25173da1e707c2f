"""Queries over text, value and address columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from attesta.functions import fixed_values as fixed
from attesta.functions import text as X
from attesta.operators import text_jobs as J
from attesta.plans.registry import query, with_tables
from attesta.sources.tables import values_sql


def quoted(words) -> str:
    return ", ".join("'" + str(w).replace("'", "''") + "'" for w in words)


WS = r"[\s\p{Z}]"
SQL_NORM = (r"trim(regexp_replace(regexp_replace(lower({c}), '[^\p{{L}}\p{{N}}_\s\p{{Z}}]', ' ', 'g'), '[\s\p{{Z}}]+', ' ', 'g'))")
SQL_STEM = "CASE " + " ".join(
    f"WHEN length(w) > {len(s) + 3} AND w LIKE '%{s}' THEN substr(w, 1, length(w) - {len(s)})" + (" || 'y'" if s == "ies" else "")
    for s in fixed.STEM_SUFFIXES) + " ELSE w END"
SQL_RAW_TOKENS = r"regexp_extract_all(lower({c}), '[a-z0-9][a-z0-9''\-]*')"
SQL_INDEX_WORD = f"length(w) > 1 AND w NOT IN ({quoted(fixed.RETRIEVAL_STOP_WORDS)})"
SQL_SIG = (r"list_filter(regexp_extract_all(lower({c}), '[\p{{L}}\p{{N}}]+'), lambda w: length(w) > 1 AND w NOT IN ("
           + quoted(fixed.NAME_STOP_WORDS) + "))")
SQL_SPLIT = "list_filter(list_transform(regexp_split_to_array(coalesce({c}, ''), '[;,]'), lambda x: trim(x)), lambda x: x <> '')"
SQL_HOST = r"regexp_extract({c}, '^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)', 1)"
SQL_QUOTE = (r"lower(trim(regexp_replace(regexp_replace(replace(translate({c}, '’‘“”–—' || chr(160), '''''""-- '), chr(173), ''), "
             r"'-[\s\p{{Z}}]+', '-', 'g'), '[\s\p{{Z}}]+', ' ', 'g')))")


@query("normalize_text", with_tables("src") + f"SELECT source_id, {SQL_NORM.format(c='text')} AS normalized FROM src")
def _(t):
    return t.sources().select("source_id", "text").select("source_id", X.normalize_text(F.col("text")).alias("normalized"))


@query("content_hash", with_tables("src") + f"SELECT source_id, sha256({SQL_NORM.format(c='text')}) AS content_hash FROM src")
def _(t):
    return t.sources().select("source_id", "text").select("source_id", X.content_hash(F.col("text")).alias("content_hash"))


@query("tokenize_stem", with_tables("psg") + f"""
SELECT passage_id, len(tk) AS n_tokens, array_to_string(tk, ' ') AS tokens FROM (SELECT passage_id, list_transform(
  list_filter({SQL_RAW_TOKENS.format(c='text')}, lambda w: {SQL_INDEX_WORD}), lambda w: {SQL_STEM}) AS tk FROM psg)""")
def _(t):
    tokens = t.passages().select("passage_id", "text").select("passage_id", X.tokenize(F.col("text")).alias("tk"))
    return tokens.select("passage_id", F.size("tk").alias("n_tokens"), F.array_join("tk", " ").alias("tokens"))


@query("sig_tokens", with_tables("src") + f"""
SELECT source_id, len(tk) AS n, array_to_string(tk, ' ') AS tokens FROM (SELECT source_id, {SQL_SIG.format(c='title')} AS tk FROM src)""")
def _(t):
    df = t.sources().select("source_id", X.sig_tokens(F.col("title")).alias("tk"))
    return df.select("source_id", F.size("tk").alias("n"), F.array_join("tk", " ").alias("tokens"))


@query("years_mentioned", with_tables("src") + rf"""
SELECT source_id, array_to_string(regexp_extract_all(title || ' ' || text, '{fixed.YEAR_PATTERN}'), ' ') AS years FROM src""")
def _(t):
    return t.sources().select("source_id", F.array_join(X.years_in(F.concat_ws(" ", "title", "text")), " ").alias("years"))


@query("split_values", with_tables("res") + f"""
SELECT id, len(ps) AS n, array_to_string(ps, '|') AS parts FROM (SELECT id, {SQL_SPLIT.format(c='value')} AS ps FROM res)""")
def _(t):
    df = t.results().select("id", X.split_values(F.col("value")).alias("ps"))
    return df.select("id", F.size("ps").alias("n"), F.array_join("ps", "|").alias("parts"))


NUMBER_TEXT = ("CASE o_orderkey % 6 WHEN 0 THEN CAST(o_custkey AS STRING) || '%' WHEN 1 THEN '1,' || lpad(CAST(o_custkey % 1000 AS STRING), 3, '0') "
               "WHEN 2 THEN CAST(o_custkey AS STRING) || ' – ' || CAST(o_custkey + 5 AS STRING) "
               "WHEN 3 THEN '-' || CAST(o_custkey AS STRING) || '.25' WHEN 4 THEN '10-12.5' ELSE o_orderpriority END")


@query("parse_number_or_range", rf"""
SELECT o_orderkey, CAST(CASE WHEN one <> '' THEN one WHEN a <> '' THEN a END AS DOUBLE) AS lo,
  CAST(CASE WHEN one <> '' THEN one WHEN a <> '' THEN b END AS DOUBLE) AS hi
FROM (SELECT o_orderkey, regexp_extract(s, '^(-?\d+(\.\d+)?)$', 1) AS one,
  regexp_extract(s, '^(\d+(?:\.\d+)?)\s*[–-]\s*(\d+(?:\.\d+)?)$', 1) AS a,
  regexp_extract(s, '^(\d+(?:\.\d+)?)\s*[–-]\s*(\d+(?:\.\d+)?)$', 2) AS b
  FROM (SELECT o_orderkey, trim(replace(replace({NUMBER_TEXT}, ',', ''), '%', '')) AS s FROM orders))""")
def _(t):
    df = t.raw("orders").select("o_orderkey", X.parse_number(F.expr(NUMBER_TEXT)).alias("n"))
    return df.select("o_orderkey", F.col("n.lo").alias("lo"), F.col("n.hi").alias("hi"))


@query("normalize_quote", with_tables("psg") + f"SELECT passage_id, {SQL_QUOTE.format(c='text')} AS quote_form FROM psg")
def _(t):
    return t.passages().select("passage_id", "text").select("passage_id", X.normalize_quote(F.col("text")).alias("quote_form"))


MISSING_TEXT = ("CASE o_orderkey % 7 WHEN 0 THEN '-9' WHEN 1 THEN '-9.0' WHEN 2 THEN ' -9 ' WHEN 3 THEN '-8' WHEN 4 THEN '-9.5' "
                "ELSE CAST(o_custkey AS STRING) END")


@query("special_missing_form", rf"""
SELECT form, count(*) AS n FROM (SELECT CASE WHEN regexp_full_match(trim({MISSING_TEXT}), '-9(\.0+)?') THEN '-9' END AS form FROM orders) GROUP BY form""")
def _(t):
    return t.raw("orders").select(X.special_missing_form(F.expr(MISSING_TEXT)).alias("form")).groupBy("form").agg(F.count("*").alias("n"))


RATIONALE_TEXT = ("CASE o_orderkey % 9 WHEN 0 THEN 'Unknown: not mentioned' WHEN 1 THEN '[unknown] ' || o_orderpriority WHEN 2 THEN 'Not applicable — no alert' "
                  "WHEN 3 THEN 'not-applicable.' WHEN 4 THEN 'N/A' WHEN 5 THEN 'Inapplicable: x' WHEN 6 THEN 'Unknown cause of delay' "
                  "WHEN 7 THEN '' ELSE o_orderpriority END")


@query("missing_reason", rf"""
SELECT o_orderkey, CASE WHEN word = 'unknown' THEN 'unknown' WHEN word <> '' THEN 'not_applicable' END AS reason
FROM (SELECT o_orderkey, lower(regexp_extract({RATIONALE_TEXT}, '{fixed.MISSING_REASON_PATTERN}', 1)) AS word FROM orders)""")
def _(t):
    return t.raw("orders").select("o_orderkey", X.missing_reason(F.expr(RATIONALE_TEXT)).alias("reason"))


SQL_BOILER = r"len(regexp_extract_all({c}, '" + X.BOILERPLATE + "'))"
SQL_IS_BOILER = f"({SQL_BOILER} >= 2 OR ({SQL_BOILER} >= 1 AND length({{c}}) < 160))"
BOILER_TEXT = "CASE WHEN seq % 9 = 0 THEN text || ' Read more' WHEN seq % 9 = 4 THEN 'Subscribe to our newsletter. ' || text ELSE text END"


@query("boilerplate_flag", with_tables("psg") + f"""
SELECT source_id, CAST(sum(CASE WHEN {SQL_IS_BOILER.format(c='txt')} THEN 1 ELSE 0 END) AS BIGINT) AS boilerplate, count(*) AS passages
FROM (SELECT source_id, {BOILER_TEXT} AS txt FROM psg) GROUP BY source_id""")
def _(t):
    df = t.passages().select("source_id", F.expr(BOILER_TEXT).alias("txt"))
    return df.groupBy("source_id").agg(F.count_if(X.is_boilerplate(F.col("txt"))).alias("boilerplate"), F.count("*").alias("passages"))


SQL_CLASSIFY = rf"""CASE WHEN regexp_matches(t, '{fixed.AAR_PATTERN}') THEN 'aar'
 WHEN regexp_matches(t, '{fixed.LEGISLATIVE_PATTERN}') AND regexp_matches(host, '{fixed.LEGISLATIVE_HOST_PATTERN}') THEN 'legislative'
 WHEN ends_with(host, 'fcc.gov') OR (regexp_matches(t, '{fixed.REGULATORY_PATTERN}') AND ends_with(host, '.gov')) THEN 'regulatory'
 WHEN ends_with(host, '.gov') OR ends_with(host, '.mil') OR regexp_matches(host, '{fixed.LOCAL_GOVERNMENT_HOST_PATTERN}')
   OR (ends_with(host, '.us') AND (contains(host, 'county') OR contains(host, 'city'))) THEN 'government'
 WHEN ends_with(host, '.edu') OR contains(host, 'doi.org') OR regexp_matches(host, '{fixed.ACADEMIC_HOST_PATTERN}') THEN 'academic'
 WHEN ends_with(host, '.org') AND regexp_matches(t, '{fixed.REPORT_PATTERN}') THEN 'ngo_technical'
 WHEN host = '' THEN 'unknown' ELSE 'media' END"""
TYPED_TITLE = ("CASE source_id % 10 WHEN 0 THEN 'After-action review ' || title WHEN 1 THEN 'Bill history SB 12 ' || title "
               "WHEN 2 THEN 'Docket 7 ' || title WHEN 3 THEN 'Analysis: ' || title ELSE title END")


@query("classify_source", with_tables("src") + f"""
SELECT source_id, {SQL_CLASSIFY} AS source_type FROM (SELECT source_id, {SQL_HOST.format(c='lower(url)')} AS host,
  lower({TYPED_TITLE} || ' ' || lower(url) || ' ' || substr(text, 1, 1500)) AS t FROM src)""")
def _(t):
    df = t.sources().select("source_id", "url", F.expr(TYPED_TITLE).alias("title"), F.substring("text", 1, 1500).alias("head"))
    return df.select("source_id", X.classify_source(F.col("url"), F.col("title"), F.col("head")).alias("source_type"))


@query("url_domain", rf"""
SELECT page_id, regexp_replace({SQL_HOST.format(c='url')}, '^www\.', '') AS domain, regexp_replace(url, '#.*$', '') AS plain_url FROM pages""")
def _(t):
    return t.raw("pages").select("page_id", X.url_domain(F.col("url")).alias("domain"), X.strip_fragment(F.col("url")).alias("plain_url"))


LOCATION_TEXT = ("CASE c_custkey % 14 WHEN 0 THEN 'Ahrweiler, Deutschland' WHEN 1 THEN 'Kerr County, Texas, USA' WHEN 2 THEN 'Minsk, Belarus' "
                 "WHEN 3 THEN 'Osaka 日本' WHEN 4 THEN 'Leeds (England)' WHEN 5 THEN 'Valencia; España' WHEN 6 THEN 'Seoul, South Korea' "
                 "WHEN 7 THEN 'Lytton/Canada' WHEN 8 THEN 'Wien Österreich' WHEN 9 THEN 'Indiana' WHEN 10 THEN 'Paris, France' "
                 "WHEN 11 THEN 'Lagos, Portugal' WHEN 12 THEN 'Lahaina, Hawaii, United States' ELSE 'Roma, italia' END || ' ' || lower(c_mktsegment)")
HAZARD_TEXT = ("CASE c_custkey % 9 WHEN 0 THEN 'Ahr Valley Flood' WHEN 1 THEN 'Marshall Fire' WHEN 2 THEN 'Hurricane Ida' WHEN 3 THEN 'Heatwave 2003' "
               "WHEN 4 THEN 'Mudslide' WHEN 5 THEN 'Misfire' WHEN 6 THEN 'Quake swarm' WHEN 7 THEN 'Tsunami alarm' ELSE 'Siren test' END || ' ' || c_name")
_NAMES = [(code, i, n) for i, (code, names, *_r) in enumerate(fixed.COUNTRIES) for n in names]
SQL_COUNTRY_NAMES = "country_names AS (" + values_sql([(c, i, n, (f" {n} " if n.isascii() else n)) for c, i, n in _NAMES],
                                                       "code string, ord bigint, name string, probe string") + ")"
SQL_US = " OR ".join(f"contains(low, ' {h} ')" for h in fixed.US_HINTS)


def sql_country(source: str, key: str, location: str) -> str:
    """CTE ``countries(key, code)`` for the rows of ``source``."""
    return (f"lows AS (SELECT {key}, {location} AS location, ' ' || regexp_replace(lower({location}), '[,;/()]', ' ', 'g') || ' ' AS low FROM {source}),\n"
            f"countries AS (SELECT {key}, location, CASE WHEN {SQL_US} THEN NULL ELSE "
            "(SELECT arg_min(code, ord) FROM country_names WHERE contains(low, probe)) END AS country FROM lows)")


@query("detect_country", with_tables(SQL_COUNTRY_NAMES, sql_country("customer", "c_custkey", LOCATION_TEXT)) + "SELECT c_custkey, country FROM countries")
def _(t):
    return t.raw("customer").select("c_custkey", X.detect_country(F.expr(LOCATION_TEXT)).alias("country"))


SQL_HAZARDS = values_sql([(k, i, w) for i, (k, ws) in enumerate(fixed.HAZARD_WORDS) for w in ws], "hazard string, ord bigint, word string")


@query("hazard_of", rf"""
SELECT c_custkey, (SELECT arg_min(hazard, ord) FROM ({SQL_HAZARDS}) WHERE regexp_matches(low, '\b' || word)) AS hazard
FROM (SELECT c_custkey, lower({HAZARD_TEXT}) AS low FROM customer)""")
def _(t):
    return t.raw("customer").select("c_custkey", X.hazard_of(F.expr(HAZARD_TEXT)).alias("hazard"))


SQL_PLACE = (r"trim(regexp_replace(regexp_replace(coalesce(regexp_replace(location, (SELECT '(?i)' || string_agg("
             r"CASE WHEN probe LIKE ' %' THEN '\b' || name || '\b' ELSE name END, '|' ORDER BY length(name) DESC) FROM country_names WHERE code = country), "
             r"' ', 'g'), location), '[,;]', ' ', 'g'), '\s+', ' ', 'g'))")


@query("place_words", with_tables(SQL_COUNTRY_NAMES, sql_country("customer", "c_custkey", LOCATION_TEXT)) + f"""
SELECT c_custkey, {SQL_PLACE} AS place FROM countries""")
def _(t):
    df = t.raw("customer").select("c_custkey", F.expr(LOCATION_TEXT).alias("location"))
    return df.select("c_custkey", X.place_words(F.col("location"), X.detect_country(F.col("location"))).alias("place"))


@query("estimate_tokens", with_tables("psg") + """
SELECT case_id, CAST(sum(CAST(floor(length(text) / 3.6) AS BIGINT) + 1) AS BIGINT) AS tokens FROM psg GROUP BY case_id""")
def _(t):
    return t.passages().groupBy("case_id").agg(F.sum(X.estimate_tokens(F.col("text"))).alias("tokens"))


SQL_PRICES = values_sql(fixed.MODEL_PRICES, "model string, price_provider string, in_rate double, out_rate double, threshold bigint, in_factor double, out_factor double")
SQL_COST = ("round({i} / 1e6 * in_rate * CASE WHEN {i} > threshold THEN in_factor ELSE 1.0 END + {o} / 1e6 * out_rate * "
            "CASE WHEN {i} > threshold THEN out_factor ELSE 1.0 END, 5)")


@query("cost_usd", with_tables("cal", f"prices AS ({SQL_PRICES})") + f"""
SELECT id, {SQL_COST.format(i='input_tokens', o='output_tokens')} AS cost_usd FROM cal LEFT JOIN prices USING (model)""")
def _(t):
    return J.model_cost(t.calls(), F.col("input_tokens"), F.col("output_tokens")).select("id", "cost_usd")


@query("duration_days", """
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN b >= a THEN b - a + 1 END AS days FROM (
  SELECT l_orderkey, l_linenumber, l_partkey, CAST(o_orderdate AS DATE) AS a, CASE WHEN l_linenumber <> 7 THEN CAST(l_shipdate AS DATE) END AS b
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)""")
def _(t):
    items = t.raw("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.when(F.col("l_linenumber") != 7, F.to_date("l_shipdate")).alias("b"))
    orders = t.raw("orders").select(F.col("o_orderkey").alias("l_orderkey"), F.to_date("o_orderdate").alias("a"))
    return items.join(orders, "l_orderkey").select("l_orderkey", "l_linenumber", "l_partkey", X.duration_days(F.col("a"), F.col("b")).alias("days"))


@query("page_ranges", with_tables("psg") + """
SELECT source_id, string_agg(CASE WHEN lo = hi THEN lo || '' ELSE lo || '-' || hi END, ', ' ORDER BY lo) AS ranges FROM (
  SELECT source_id, min(seq) AS lo, max(seq) AS hi FROM (
    SELECT source_id, seq, seq - row_number() OVER (PARTITION BY source_id ORDER BY seq) AS g FROM psg WHERE regexp_matches(text, '[0-9]'))
  GROUP BY source_id, g) GROUP BY source_id""")
def _(t):
    return J.page_ranges(t.passages().where(F.col("text").rlike("[0-9]")).select("source_id", "seq"), "source_id", "seq")


PROVIDER_TEXT = "CASE WHEN id % 3 = 0 THEN provider || '+openai' WHEN id % 7 = 0 THEN 'other' ELSE provider END"


@query("display_labels", with_tables("usg", "names AS (" + values_sql(fixed.PROVIDER_API_NAMES, "code string, label string") + ")") + f"""
SELECT id, string_agg(coalesce(label, part), ' + ' ORDER BY pos) AS shown FROM (
  SELECT id, unnest(ps) AS part, generate_subscripts(ps, 1) AS pos FROM (SELECT id, string_split({PROVIDER_TEXT}, '+') AS ps FROM usg))
LEFT JOIN names ON code = part GROUP BY id""")
def _(t):
    return t.usage().select("id", J.display_label(F.expr(PROVIDER_TEXT), fixed.PROVIDER_API_NAMES).alias("shown"))


def _reply_text() -> str:
    """A reply per document, with some of the shape errors the parser must name."""
    item = lambda var, body: f"'\"{var}\": {{\"variable\": \"{var}\", ' || {body} || '}}'"
    ev = "'\"evidence\": [{\"id\": \"S' || CAST(doc_id AS STRING) || '-P1\", \"quote\": \"' || lang || '\", \"stance\": \"' || CASE doc_id % 8 WHEN 3 THEN 'maybe' ELSE 'supports' END || '\"}]'"
    first = item("LENGTH_BAND", f"'\"value\": ' || CASE doc_id % 5 WHEN 0 THEN '3' WHEN 1 THEN '[\"1\", \"2\"]' ELSE '\"2\"' END || ', \"evidence_status\": \"' || "
                                f"CASE doc_id % 6 WHEN 2 THEN 'SURE' ELSE 'SUPPORTED' END || '\", ' || {ev}")
    second = ("CASE doc_id % 4 WHEN 0 THEN '\"LANGS\": {\"variable\": \"OTHER\", \"value\": \"EN\", \"status\": \"suggested\"}' "
              "WHEN 1 THEN '\"LANGS\": {\"variable\": \"LANGS\", \"value\": null, \"status\": \"suggested\"}' "
              "WHEN 2 THEN '\"LANGS\": {\"variable\": \"LANGS\", \"value\": \"' || lang || '\"}' ELSE '\"SKIPPED\": {}' END")
    return f"CASE WHEN doc_id % 13 = 0 THEN '{{\"results\": [' || '1]}}' ELSE '{{\"results\": {{' || {first} || ', ' || {second} || '}}}}' END"


REPLY_TEXT = _reply_text()
REPLY_FIELDS = [("LENGTH_BAND",), ("LANGS",)]


@query("parse_reply_json", f"""
SELECT reply_id, variable, violation, CASE WHEN violation IS NULL THEN CASE WHEN vt = 'ARRAY' THEN array_to_string(CAST(json_extract(item, '$.value') AS VARCHAR[]), ', ')
    ELSE coalesce(json_extract_string(item, '$.value'), '') END END AS value,
  CASE WHEN violation IS NULL THEN es END AS evidence_status, CASE WHEN violation IS NULL THEN coalesce(json_array_length(item, '$.evidence'), 0)::BIGINT END AS n_evidence
FROM (SELECT *, CASE WHEN bt IS DISTINCT FROM 'OBJECT' THEN 'missing results' WHEN json_type(item) IS DISTINCT FROM 'OBJECT' THEN 'no entry'
  WHEN json_extract_string(item, '$.variable') IS DISTINCT FROM variable THEN 'names a different variable'
  WHEN es IS NOT NULL AND es NOT IN ({quoted(fixed.EVIDENCE_STATUSES)}) THEN 'invalid evidence_status'
  WHEN es IS NULL AND (st IS NULL OR st NOT IN ({quoted(fixed.REPLY_STATUSES)})) THEN 'invalid status'
  WHEN coalesce(vt, 'NULL') NOT IN ('ARRAY', 'NULL', 'VARCHAR') THEN 'invalid value type'
  WHEN len(list_filter(coalesce(json_extract_string(item, '$.evidence[*].stance'), []), lambda s: s NOT IN ({quoted(fixed.STANCES)}))) > 0 THEN 'invalid evidence entry' END AS violation
 FROM (SELECT reply_id, variable, bt, item, json_extract_string(item, '$.evidence_status') AS es, json_extract_string(item, '$.status') AS st, json_type(item, '$.value') AS vt
  FROM (SELECT doc_id AS reply_id, variable, json_type(j, '$.results') AS bt, json_extract(j, '$.results.' || variable) AS item
   FROM (SELECT doc_id, {REPLY_TEXT} AS j FROM documents), ({values_sql(REPLY_FIELDS, 'variable string')}))))""")
def _(t):
    replies = t.raw("documents").select(F.col("doc_id").alias("reply_id"), F.expr(REPLY_TEXT).alias("reply"))
    return J.parse_reply_json(replies, [v for v, in REPLY_FIELDS])


# ------------------------------------------------------------------------------------------------ lines, paragraphs
PARAGRAPH_TEXT = "CASE WHEN source_id % 2 = 0 THEN title || chr(10) || ' ' || chr(10) || text ELSE text END"


@query("text_paragraphs", with_tables("src") + rf"""
SELECT source_id, unnest(ps) AS paragraph, generate_subscripts(ps, 1) AS para FROM (SELECT source_id, CASE WHEN len(bs) <= 1 THEN
   list_filter(list_transform(string_split(txt, chr(10)), lambda x: trim(x)), lambda x: x <> '') ELSE bs END AS ps FROM (SELECT source_id, txt,
   list_filter(list_transform(regexp_split_to_array(txt, '\n\s*\n'), lambda x: trim(regexp_replace(x, '[\s\p{{Z}}]+', ' ', 'g'))), lambda x: x <> '') AS bs
   FROM (SELECT source_id, {PARAGRAPH_TEXT} AS txt FROM src)))""")
def _(t):
    return J.text_paragraphs(t.sources().select("source_id", F.expr(PARAGRAPH_TEXT).alias("text")))


@query("reflow_lines", with_tables("src") + r"""
SELECT source_id, unnest(ps) AS paragraph, generate_subscripts(ps, 1) AS para FROM (SELECT source_id, list_filter(list_transform(
  CASE WHEN f.cur = '' THEN f.done ELSE list_append(f.done, f.cur) END, lambda p: trim(regexp_replace(p, '[\s\p{Z}]+', ' ', 'g'))), lambda p: length(p) >= 3) AS ps FROM (
 SELECT source_id, list_reduce(list_prepend({'done': []::VARCHAR[], 'cur': ''}, list_transform(string_split(text, chr(10)), lambda l: {'done': []::VARCHAR[], 'cur': trim(l)})),
  lambda a, x: CASE WHEN x.cur = '' AND a.cur = '' THEN a WHEN x.cur = '' THEN {'done': list_append(a.done, a.cur), 'cur': ''}
    WHEN regexp_matches(x.cur, '[.!?:"”]$') AND length(CASE WHEN a.cur = '' THEN x.cur ELSE a.cur || ' ' || x.cur END) > 350
      THEN {'done': list_append(a.done, CASE WHEN a.cur = '' THEN x.cur ELSE a.cur || ' ' || x.cur END), 'cur': ''}
    ELSE {'done': a.done, 'cur': CASE WHEN a.cur = '' THEN x.cur ELSE a.cur || ' ' || x.cur END} END) AS f FROM src))""")
def _(t):
    return J.reflow_lines(t.sources().select("source_id", "text"))


LINE_TEXT = ("CASE seq % 8 WHEN 1 THEN 'II. MESSAGE DATA' WHEN 2 THEN 'Variable: FIELD_' || CAST(source_id AS STRING) || '_' || CAST(seq AS STRING) "
             "WHEN 4 THEN '- 3 = ' || substr(text, 1, 20) WHEN 5 THEN 'B2=' || substr(text, 1, 9) "
             "WHEN 7 THEN CASE WHEN source_id % 2 = 0 THEN 'Summary Notes' ELSE 'APPENDICES' END ELSE text END")


@query("sectionize_lines", with_tables("psg") + rf"""
SELECT source_id, line_no, section, variable, CASE WHEN code <> '' THEN code END AS code, CASE WHEN code <> '' THEN label END AS label FROM (
 SELECT source_id, line_no, mark, coalesce(last_value(sec IGNORE NULLS) OVER w, '') AS section, last_value(mark IGNORE NULLS) OVER w AS variable,
   regexp_extract(line, '^\s*(?:[-•*]\s+)?(-?[A-Za-z0-9][A-Za-z0-9\-]*)\s*=\s*(.+)$', 1) AS code, regexp_extract(line, '^\s*(?:[-•*]\s+)?(-?[A-Za-z0-9][A-Za-z0-9\-]*)\s*=\s*(.+)$', 2) AS label
 FROM (SELECT source_id, seq AS line_no, line, CASE WHEN line LIKE 'II. %' THEN 'II. Message Data' END AS sec,
   CASE WHEN line LIKE 'Variable: %' THEN substr(line, 11) WHEN line LIKE 'II. %' OR line LIKE 'APPENDICES%' OR line LIKE 'Summary Notes%' THEN '' END AS mark
   FROM (SELECT source_id, seq, {LINE_TEXT} AS line FROM psg)) WINDOW w AS (PARTITION BY source_id ORDER BY line_no ROWS UNBOUNDED PRECEDING))
WHERE variable <> '' AND mark IS NULL""")
def _(t):
    return J.sectionize_lines(t.passages().select("source_id", F.col("seq").alias("line_no"), F.expr(LINE_TEXT).alias("line")))
