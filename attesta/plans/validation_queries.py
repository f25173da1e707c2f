"""Queries over citation checks, validation and status resolution."""

from __future__ import annotations

from pyspark.sql import functions as F

from attesta.functions import fixed_values as fixed
from attesta.functions import text as X
from attesta.operators import validation as V
from attesta.plans.registry import query, with_tables
from attesta.plans.text_queries import SQL_QUOTE, SQL_SPLIT, quoted
from attesta.session import cut_lineage
from attesta.sources.tables import dimension, values_sql

# variable, number, type, multi, rule missing, banded, codes, labels, missing codes, options
FIELDS = [
    ("LENGTH_BAND", 1, "categorical", False, False, False, "1|2|3", "short|medium|long", "-9", ""),
    ("TOPICS", 2, "categorical", True, False, False, "WEA|LOCAL|SIREN|0", "wireless alert|local alert|siren|none", "", ""),
    ("LANGS", 3, "open_list", False, False, False, "", "", "", "EN (English)|FR (French)|DE (German)"),
    ("SHARE_PCT", 4, "numeric", False, False, True, "", "", "", ""),
    ("SEEN_ON", 5, "date", False, False, False, "", "", "", ""),
    ("NOTE", 6, "text", False, False, False, "", "", "", ""),
    ("PERCEIVED_TIMELINESS", 7, "categorical", False, False, False, "1|2|3", "timely|late|Indeterminate", "", ""),
    ("UNMAPPED_FIELD", 8, "text", False, True, False, "", "", "", ""),
    ("TRANSMISSION_LATENCY", 9, "numeric", False, False, False, "", "", "-9", ""),
    ("COMMUNITY_FEEDBACK_MECHANISM", 10, "categorical", True, False, False, "0|1|2", "None documented|survey|hearing", "", ""),
    ("N_LINES", 11, "numeric", False, False, False, "", "", "", ""),
]
FIELD_SCHEMA = "variable string, v bigint, type string, multi boolean, rule_missing boolean, banded boolean, codes string, labels string, missing string, options string"
LISTS = ("codes", "labels", "missing", "options")


def codebook(t):
    df = dimension(t.spark, FIELDS, FIELD_SCHEMA)
    split = lambda c: F.when(F.col(c) == "", F.array().cast("array<string>")).otherwise(F.split(c, r"\|")).alias(c)
    return df.select(*[split(c) if c in LISTS else F.col(c) for c in df.columns if c != "v"])


SQL_FIELDS = ("fields AS (SELECT variable, v, type, multi, rule_missing, banded, " + ", ".join(
    f"CASE WHEN {c} = '' THEN []::VARCHAR[] ELSE string_split({c}, '|') END AS {c}" for c in LISTS) + f" FROM ({values_sql(FIELDS, FIELD_SCHEMA)}))")

VALUE = ("CASE v WHEN 1 THEN CASE m WHEN 0 THEN '-9' WHEN 1 THEN '-9.0' WHEN 2 THEN '3, 2' WHEN 3 THEN '7' WHEN 4 THEN 'n/a' WHEN 5 THEN '' WHEN 6 THEN '2, -9' ELSE CAST(1 + doc_id % 3 AS STRING) END "
         "WHEN 2 THEN CASE m WHEN 0 THEN 'WEA, XYZ' WHEN 1 THEN 'wea; local' WHEN 2 THEN '' WHEN 3 THEN 'WEA, WEA' WHEN 4 THEN 'WEA, -9' WHEN 5 THEN 'SIREN' ELSE 'WEA, LOCAL' END "
         "WHEN 3 THEN CASE m WHEN 0 THEN 'EN' WHEN 1 THEN 'EN, FR' WHEN 2 THEN 'ES (Spanish)' WHEN 3 THEN '-9' ELSE upper(lang) || ', EN (main)' END "
         "WHEN 4 THEN CASE m WHEN 0 THEN '130%' WHEN 1 THEN '10-20' WHEN 2 THEN 'many' WHEN 3 THEN '-9' ELSE CAST(doc_id % 101 AS STRING) || '%' END "
         "WHEN 5 THEN CASE m WHEN 0 THEN '14 July 2021' WHEN 1 THEN '2021-02-30' ELSE '2021-07-' || lpad(CAST(1 + doc_id % 28 AS STRING), 2, '0') END "
         "WHEN 6 THEN CASE m WHEN 0 THEN '-9' WHEN 1 THEN 'None' ELSE first_line END "
         "WHEN 7 THEN CASE WHEN m < 5 THEN '3' ELSE CAST(1 + doc_id % 4 AS STRING) END "
         "WHEN 8 THEN CASE WHEN m < 4 THEN 'something' ELSE '' END "
         "WHEN 9 THEN CASE WHEN m < 6 THEN '-9' ELSE CAST(doc_id % 90 AS STRING) END "
         "ELSE CASE WHEN m < 5 THEN '0' WHEN m < 8 THEN '1, 2' ELSE '0, 5' END END")
STATUS = ("CASE WHEN m2 = 0 THEN 'INSUFFICIENT' WHEN m2 = 1 THEN 'ambiguous' WHEN m2 = 2 THEN 'CONFLICTING' WHEN m2 = 3 THEN 'INFERRED' WHEN m2 = 4 THEN 'SURE' "
          "WHEN m2 = 5 THEN '' WHEN v IN (7, 9, 10) AND m2 < 12 THEN 'INSUFFICIENT' ELSE 'SUPPORTED' END")
ITEM_STAGES = [
    [("item_id", "doc_id * 16 + v"), ("case_id", "doc_id"), ("variable", "variable"), ("v", "v"), ("doc_id", "doc_id"), ("lang", "lang"), ("first_line", "first_line"),
     ("m", "(doc_id * 7 + v * 5) % 12"), ("m2", "(doc_id * 3 + v * 11) % 17")],
    [("item_id", "item_id"), ("case_id", "case_id"), ("variable", "variable"), ("v", "v"), ("m", "m"), ("m2", "m2"), ("first_line", "first_line"), ("value", VALUE),
     ("evidence_status", STATUS), ("status", "CASE WHEN m2 = 5 THEN CASE m % 3 WHEN 0 THEN 'disputed' WHEN 1 THEN 'rule_unclear' ELSE 'suggested' END END"),
     ("rule_unclear", "m2 = 7 AND m > 6"),
     ("rationale", "CASE WHEN m % 4 = 0 THEN 'Unknown: not mentioned' WHEN m % 4 = 1 THEN 'Not applicable: no alert' WHEN v IN (7, 10) THEN 'Not documented: silence' ELSE 'The passage says so.' END")],
]
# citations: kind 0 = for the value, 1 and 2 = for the first two codes; two variants each
CITE_COLUMNS = [
    ("item_id", "item_id"), ("case_id", "case_id"), ("part", "CASE kind WHEN 0 THEN 'value' ELSE 'option' END"),
    ("code", "CASE kind WHEN 0 THEN '' ELSE trim(split_part(replace(value, ';', ','), ',', CAST(greatest(kind, 1) AS INT))) END"), ("ord", "kind * 2 + variant"),
    ("passage_id", "CASE WHEN m2 = 8 AND variant = 1 THEN 'S9-P999' ELSE 'S' || CAST(case_id AS STRING) || '-P1' END"),
    ("quote", "CASE WHEN m2 = 9 AND variant = 0 THEN 'a made-up quotation' WHEN m2 = 10 THEN 'ab' WHEN m2 = 11 AND kind = 2 THEN 'another invention here' "
              "WHEN m2 = 12 THEN substr(first_line, 1, 10) || ' ... ' || substr(first_line, 12, 9) ELSE substr(first_line, 1, 30) END"),
    ("stance", "CASE WHEN m2 = 13 THEN 'contradicts' WHEN variant = 1 AND m2 = 2 THEN 'alternative' ELSE 'supports' END"),
]
CITE_FILTER = ("(m2 NOT IN (0, 14) AND NOT (v IN (7, 9, 10) AND m2 < 12 AND m < 5)) AND (kind = 0 OR (v IN (1, 2, 7, 10) AND split_part(replace(value, ';', ','), ',', CAST(greatest(kind, 1) AS INT)) <> '' AND m2 <> 15)) "
               "AND (variant = 0 OR m2 IN (2, 8, 9)) AND (kind < 2 OR v IN (2, 10))")
OPTION_FILTER = "kind > 0 AND variant = 0 AND v IN (1, 2, 7, 10) AND m2 <> 15 AND (kind < 2 OR v IN (2, 10)) AND (split_part(replace(value, ';', ','), ',', CAST(greatest(kind, 1) AS INT)) <> '' OR (v = 2 AND m = 2))"
OPTION_COLUMNS = [("item_id", "item_id"), ("ord", "kind"), ("code", "CASE WHEN value = '' THEN 'WEA' ELSE trim(split_part(replace(value, ';', ','), ',', CAST(greatest(kind, 1) AS INT))) END")]


def _proj(df, cols):
    return df.select(*[F.expr(e).alias(n) for n, e in cols])


def items(t):
    rows = F.inline(F.array(*[F.struct(F.lit(f[1]).cast("long").alias("v"), F.lit(f[0]).alias("variable")) for f in FIELDS if f[1] <= 10]))
    df = t.document_facts().select("doc_id", "lang", "first_line", rows)
    for stage in ITEM_STAGES:
        df = _proj(df, stage)
    return df


def _six(t):
    rows = F.inline(F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(n).alias("variant")) for k in range(3) for n in range(2)]))
    return items(t).select("*", rows)


def citations(t):
    return _proj(_six(t).where(CITE_FILTER), CITE_COLUMNS)


def options(t):
    return _proj(_six(t).where(OPTION_FILTER), OPTION_COLUMNS)


def case_passages(t):
    """Passages as supplied to the coder: the document's own."""
    return t.passages().select(F.col("source_id").alias("case_id"), "passage_id", "text")


def _sel(cols):
    return ", ".join(f"{e} AS {n}" for n, e in cols)


ITEMS = with_tables(
    "psg", "facts", SQL_FIELDS,
    f"items AS (SELECT {_sel(ITEM_STAGES[1])} FROM (SELECT {_sel(ITEM_STAGES[0])} FROM facts, (SELECT v, variable FROM fields WHERE v <= 10)))",
    "six AS (SELECT * FROM items, (VALUES (0, 0), (0, 1), (1, 0), (1, 1), (2, 0), (2, 1)) AS k(kind, variant))",
    f"cites AS (SELECT {_sel(CITE_COLUMNS)} FROM six WHERE {CITE_FILTER})", f"opts AS (SELECT {_sel(OPTION_COLUMNS)} FROM six WHERE {OPTION_FILTER})")
SQL_TRIMQ = r"regexp_replace({c}, '^[ .\"'']+|[ .\"'']+$', '', 'g')"
SQL_INSIDE = f"""(q <> '' AND (contains(tx, q) OR (len(frag) > 1 AND len(list_filter(frag, lambda f: length(f) < 6 OR NOT contains(tx, f))) = 0)))"""


def sql_checked(source):
    return f"""checked AS (SELECT item_id, case_id, part, code, ord, passage_id, quote, stance, CASE WHEN text IS NULL THEN 'evidence_id_not_supplied' WHEN length(quote) < 8 OR length(quote) > 500 THEN 'quote_invalid_length'
 WHEN NOT {SQL_INSIDE} THEN 'quote_not_found' END AS reason FROM (SELECT *, list_filter(list_transform(regexp_split_to_array(q, '\\s*(?:\\.\\.\\.|…)\\s*'), lambda f: {SQL_TRIMQ.format(c='f')}), lambda f: f <> '') AS frag FROM (
 SELECT c.*, p.text, {SQL_TRIMQ.format(c=SQL_QUOTE.format(c='quote'))} AS q, {SQL_QUOTE.format(c='p.text')} AS tx FROM {source} c LEFT JOIN psg p ON p.source_id = c.case_id AND p.passage_id = c.passage_id)))"""


SQL_FACTS = """cfacts AS (SELECT item_id, part, code, bool_or(reason IS NULL AND cnt AND stance = 'supports') AS supported, bool_or(reason IS NULL AND cnt) AS any_good,
 count(*) FILTER (reason IS NULL AND part = 'value' AND stance <> 'supports') AS counter, list_sort(coalesce(list(DISTINCT reason) FILTER (cnt AND reason IS NOT NULL), [])) AS bad, count(*) AS n
 FROM (SELECT *, part <> 'value' OR stance = 'supports' AS cnt FROM checked) GROUP BY item_id, part, code)"""
SQL_WHY = "CASE WHEN NOT coalesce({s}, FALSE) THEN CASE WHEN coalesce({g}, FALSE) THEN 'evidence_does_not_support_selection' ELSE 'no_supporting_evidence' END END"

NUM1 = r"regexp_full_match({c}, '-?\d+(\.\d+)?')"
NUM2 = r"regexp_full_match({c}, '\d+(\.\d+)?\s*[–-]\s*\d+(\.\d+)?')"
NCLEAN = "trim(replace(replace(parts[1], ',', ''), '%', ''))"


def sql_ladder(items_table="items", options_table="opts"):
    """CTEs from checked citations to ``verdicts`` for any items table."""
    absence = values_sql(fixed.ABSENCE_RULES, "variable string, absence string, label_start string")
    special = r"regexp_full_match(trim({p}), '-9(\.0+)?')"
    canon = "codes[list_position(list_transform(codes, lambda z: upper(z)), upper({p}))]"
    opt = "list_filter(ops, lambda o: o.up = upper({p}))[1]"
    own = "list_concat(({o}).bad, CASE WHEN ({o}).why IS NOT NULL THEN [({o}).why] ELSE [] END)"
    o_p, c_p = opt.format(p="p"), canon.format(p="p")
    by_value = "(sr IS NULL AND (len(parts) = 1 OR type = 'open_list'))"
    return f"""bookab AS (SELECT f.*, CASE WHEN type = 'categorical' AND starts_with(lower(trim(labels[list_position(codes, absence)])), label_start) THEN absence END AS absence FROM fields f LEFT JOIN ({absence}) USING (variable)),
oplist AS (SELECT o.item_id, list({{'up': up, 'supported': coalesce(supported, FALSE), 'why': {SQL_WHY.format(s='supported', g='any_good')}, 'bad': coalesce(bad, []), 'n': coalesce(n, 0)}}) AS ops
 FROM (SELECT DISTINCT item_id, upper(trim(code)) AS up FROM {options_table}) o LEFT JOIN (SELECT *, upper(trim(code)) AS up FROM cfacts WHERE part = 'option') USING (item_id, up) GROUP BY o.item_id),
prep AS (SELECT i.*, b.* EXCLUDE (variable, v), coalesce(c.bad, []) AS bad_top, {SQL_WHY.format(s='supported', g='any_good')} AS sr, coalesce(counter, 0) AS counter, coalesce(ops, []) AS ops,
 upper(trim(coalesce(evidence_status, ''))) AS es, CASE WHEN lower(trim(coalesce(value, ''))) IN ({quoted(fixed.BLANK_WORDS)}) THEN '' ELSE trim(coalesce(value, '')) END AS val
 FROM {items_table} i JOIN bookab b USING (variable) LEFT JOIN (SELECT * FROM cfacts WHERE part = 'value') c USING (item_id) LEFT JOIN oplist USING (item_id)),
p2 AS (SELECT *, list_transform(CASE WHEN type IN ('categorical', 'open_list') THEN {SQL_SPLIT.format(c='val')} ELSE [val] END, lambda p: CASE WHEN {special.format(p='p')} THEN '-9' ELSE p END) AS parts,
 CASE WHEN lower(regexp_extract(rationale, '{fixed.MISSING_REASON_PATTERN}', 1)) = 'unknown' THEN 'unknown' WHEN regexp_matches(rationale, '{fixed.MISSING_REASON_PATTERN}') THEN 'not_applicable' END AS why FROM prep),
p3 AS (SELECT *, list_transform(parts, lambda p: {{'code': CASE WHEN type = 'categorical' THEN coalesce({c_p}, p) ELSE p END,
  'kept': NOT (type = 'categorical' AND {c_p} IS NULL) AND CASE WHEN {o_p} IS NOT NULL THEN ({o_p}).supported ELSE {by_value} END,
  'reasons': CASE WHEN type = 'categorical' AND {c_p} IS NULL THEN CASE WHEN {special.format(p='p')} THEN ['invalid_code', 'missing_code_not_defined'] ELSE ['invalid_code'] END
    WHEN {o_p} IS NOT NULL THEN {own.format(o=o_p)} WHEN {by_value} THEN [] ELSE ['no_supporting_evidence'] END}}) AS sel,
 len(list_filter(parts, lambda p: {special.format(p='p')} AND NOT list_contains(missing, p))) > 0 AS undefined, len(list_filter(parts, lambda p: list_contains(missing, p))) > 0 AS special, len(parts) AS np FROM p2),
p4 AS (SELECT *, list_transform(list_filter(sel, lambda s: s.kept), lambda s: s.code) AS kept, list_concat(flatten(list_transform(sel, lambda s: s.reasons)), bad_top) AS selr,
 CASE WHEN (why = 'unknown' AND sr IS NOT NULL AND es = 'INSUFFICIENT') OR sr IS NULL THEN bad_top ELSE list_append(bad_top, sr) END AS spbad,
 flatten([bad_top, CASE WHEN sr IS NOT NULL THEN [sr] ELSE [] END, CASE WHEN type = 'categorical' AND {canon.format(p='parts[1]')} IS NULL THEN ['invalid_code'] ELSE [] END,
   CASE WHEN type = 'categorical' AND {opt.format(p='parts[1]')} IS NOT NULL THEN {own.format(o=opt.format(p='parts[1]'))} ELSE [] END,
   CASE WHEN type = 'numeric' AND NOT ({NUM1.format(c=NCLEAN)} OR {NUM2.format(c=NCLEAN)}) THEN ['not_a_number'] WHEN type = 'numeric' AND banded AND {NUM1.format(c=NCLEAN)} AND NOT try_cast({NCLEAN} AS DOUBLE) BETWEEN 0 AND 100 THEN ['percentage_out_of_range']
     WHEN type = 'date' AND (NOT regexp_full_match(parts[1], '\\d{{4}}-\\d{{2}}-\\d{{2}}') OR try_cast(parts[1] AS DATE) IS NULL) THEN ['not_iso_date'] ELSE [] END]) AS sgbad FROM p3),
verdicts AS (SELECT *, CASE rule WHEN 1 THEN FALSE WHEN 2 THEN TRUE WHEN 3 THEN FALSE WHEN 4 THEN TRUE WHEN 5 THEN FALSE WHEN 6 THEN FALSE WHEN 7 THEN FALSE WHEN 8 THEN len(spbad) = 0 WHEN 9 THEN TRUE WHEN 10 THEN FALSE WHEN 11 THEN FALSE
   WHEN 12 THEN len(kept) > 0 ELSE len(sgbad) = 0 END AS ok,
 CASE rule WHEN 12 THEN CASE WHEN len(kept) = 0 THEN '' ELSE array_to_string(kept, ', ') END WHEN 8 THEN CASE WHEN len(spbad) = 0 THEN parts[1] ELSE '' END WHEN 9 THEN absence WHEN 13 THEN CASE WHEN type = 'categorical' THEN coalesce({canon.format(p='parts[1]')}, parts[1]) WHEN np = 1 THEN parts[1] ELSE val END ELSE '' END AS vvalue,
 list_sort(list_distinct(CASE rule WHEN 1 THEN ['rule_missing'] WHEN 3 THEN ['malformed_output'] WHEN 5 THEN ['missing_code_not_defined'] WHEN 6 THEN ['special_missing_mixed'] WHEN 7 THEN list_append(bad_top, 'missing_reason_not_stated') WHEN 8 THEN spbad
   WHEN 10 THEN ['single_select_multiple_codes'] WHEN 11 THEN ['duplicate_codes'] WHEN 12 THEN CASE WHEN len(kept) = 0 AND len(selr) = 0 THEN ['no_supporting_evidence'] ELSE selr END WHEN 13 THEN sgbad ELSE [] END)) AS reasons,
 CASE rule WHEN 8 THEN why WHEN 9 THEN 'not_documented' ELSE '' END AS missing_reason, CASE rule WHEN 9 THEN 1 WHEN 12 THEN len(kept) WHEN 13 THEN CASE WHEN type = 'categorical' THEN 1 ELSE 0 END ELSE 0 END AS n_options,
 CASE rule WHEN 12 THEN CASE WHEN len(kept) = 0 THEN 'invalid' WHEN len(kept) < np OR len(selr) > 0 THEN 'partially_valid' ELSE 'valid' END END AS multi_outcome
 FROM (SELECT *, CASE WHEN rule_missing THEN CASE WHEN val <> '' THEN 1 ELSE 2 END
  WHEN val = '' THEN CASE WHEN type IN ('categorical', 'open_list') AND len(list_filter(ops, lambda o: o.up <> '')) > 0 THEN 3 ELSE 4 END
  WHEN undefined AND NOT (type = 'categorical' AND multi AND np > 1) THEN 5
  WHEN special THEN CASE WHEN np > 1 THEN 6 WHEN why IS NULL THEN 7 ELSE 8 END
  WHEN absence IS NOT NULL AND np = 1 AND upper(parts[1]) = upper(absence) AND sr IS NOT NULL AND NOT coalesce(({opt.format(p='parts[1]')}).n > 0, FALSE) AND es = 'INSUFFICIENT' AND regexp_matches(rationale, '{fixed.NOT_DOCUMENTED_PATTERN}') AND len(bad_top) = 0 THEN 9
  WHEN type = 'categorical' AND NOT multi AND np > 1 THEN 10
  WHEN type IN ('categorical', 'open_list') AND len(list_distinct(list_transform(parts, lambda p: upper(p)))) <> np THEN 11
  WHEN (type = 'categorical' AND multi) OR (type = 'open_list' AND np > 1) THEN 12 ELSE 13 END AS rule FROM p4)),
vv AS (SELECT * EXCLUDE (multi_outcome), coalesce(multi_outcome, CASE WHEN ok THEN 'valid' ELSE 'invalid' END) AS outcome FROM verdicts)"""


CHECKED = ITEMS.rstrip() + ", " + sql_checked("cites")
LADDER = CHECKED + f", {SQL_FACTS}, {sql_ladder()} "


def prepared(t):
    return V.prepare_items(items(t), citations(t), options(t), case_passages(t), codebook(t))


@query("quote_in_passage", with_tables("psg") + f"""
, bq AS (SELECT item_id, substr(text, 1, 60) AS quote FROM benchmark),
nq AS (SELECT source_id, tx, q, quote_no, list_filter(list_transform(regexp_split_to_array(q, '\\s*(?:\\.\\.\\.|…)\\s*'), lambda f: {SQL_TRIMQ.format(c='f')}), lambda f: f <> '') AS frag FROM
 (SELECT source_id, quote_no, {SQL_QUOTE.format(c='text')} AS tx, {SQL_TRIMQ.format(c=SQL_QUOTE.format(c='quote'))} AS q FROM (SELECT passage_id AS source_id, text, i AS quote_no,
  CASE i WHEN 0 THEN ' ' || substr(text, 3, 25) || '.' WHEN 1 THEN substr(text, 1, 12) || ' … ' || substr(text, 20, 12) || '.' WHEN 2 THEN substr(text, 1, 8) || '...' || 'zzzzzzz' ELSE ' .' END AS quote FROM psg, (VALUES (0), (1), (2), (3)) AS v(i))))
SELECT source_id AS passage_id, quote_no, {SQL_INSIDE} AS found FROM nq""".replace("\n, bq AS (SELECT item_id, substr(text, 1, 60) AS quote FROM benchmark),\nnq", ", nq", 1))
def _(t):
    quote = ("CASE i WHEN 0 THEN ' ' || substr(text, 3, 25) || '.' WHEN 1 THEN substr(text, 1, 12) || ' … ' || substr(text, 20, 12) || '.' "
             "WHEN 2 THEN substr(text, 1, 8) || '...' || 'zzzzzzz' ELSE ' .' END")
    # a passage is normalised once, and only the beginning that quotations are cut from goes with each of them
    passages = t.passages().select("passage_id", F.substring("text", 1, 31).alias("text"), X.normalize_quote(F.col("text")).alias("prepared"))
    df = passages.select("*", F.explode(F.array(*[F.lit(i) for i in range(4)])).alias("i"))
    return df.select("passage_id", F.col("i").alias("quote_no"), X.quote_in_prepared(F.expr(quote), F.col("prepared")).alias("found"))


@query("check_citations", CHECKED + " SELECT item_id, ord, code, reason FROM checked")
def _(t):
    return V.check_citations(citations(t), case_passages(t)).select("item_id", "ord", "code", "reason")


@query("support_reason", CHECKED + f", {SQL_FACTS} SELECT item_id, part, code, {SQL_WHY.format(s='supported', g='any_good')} AS why FROM cfacts")
def _(t):
    facts = V.citation_facts(V.check_citations(citations(t), case_passages(t)))
    return facts.select("item_id", "part", "code", V.support_reason(F.col("supported"), F.col("any_good")).alias("why"))


SQL_UPPARTS = "list_transform(parts, lambda p: upper(p))"


@query("validate_categorical", LADDER + f"""
SELECT item_id, array_to_string(list_filter([CASE WHEN NOT multi AND np > 1 THEN 'single_select_multiple_codes' END, CASE WHEN len(list_distinct({SQL_UPPARTS})) <> np THEN 'duplicate_codes' END,
 CASE WHEN len(list_filter(parts, lambda p: NOT list_contains(list_transform(codes, lambda z: upper(z)), upper(p)))) > 0 THEN 'invalid_code' END], lambda r: r IS NOT NULL), ',') AS reasons FROM p4 WHERE type = 'categorical' AND val <> ''""")
def _(t):
    df = prepared(t).where("type = 'categorical' AND val <> ''")
    return df.select("item_id", F.array_join(V.validate_categorical(df), ",").alias("reasons"))


@query("validate_multiselect", LADDER + """
SELECT item_id, pos - 1 AS pos, outcome, s.code AS code, s.kept AS kept, array_to_string(list_sort(list_distinct(s.reasons)), ',') AS reasons FROM (
 SELECT item_id, outcome, unnest(sel) AS s, generate_subscripts(sel, 1) AS pos FROM vv WHERE ((type = 'categorical' AND multi) OR (type = 'open_list' AND np > 1)) AND val <> '')""")
def _(t):
    return V.selection_verdicts(V.validate_items(prepared(t)))


@query("validate_numeric_date", LADDER + f"""
SELECT item_id, val AS value, array_to_string(CASE WHEN type = 'numeric' AND NOT ({NUM1.format(c=NCLEAN)} OR {NUM2.format(c=NCLEAN)}) THEN ['not_a_number'] WHEN type = 'numeric' AND banded AND {NUM1.format(c=NCLEAN)} AND NOT try_cast({NCLEAN} AS DOUBLE) BETWEEN 0 AND 100 THEN ['percentage_out_of_range']
 WHEN type = 'date' AND (NOT regexp_full_match(parts[1], '\\d{{4}}-\\d{{2}}-\\d{{2}}') OR try_cast(parts[1] AS DATE) IS NULL) THEN ['not_iso_date'] ELSE [] END, ',') AS reasons, type = 'text' AND length(val) > 4000 AS long_text FROM p4 WHERE type IN ('numeric', 'date', 'text')""")
def _(t):
    df = prepared(t).where("type IN ('numeric', 'date', 'text')")
    return df.select("item_id", F.col("val").alias("value"), F.array_join(V.number_or_date_reasons(), ",").alias("reasons"),
                     ((F.col("type") == "text") & (F.length("val") > 4000)).alias("long_text"))


@query("validate_open_list", LADDER + """
SELECT item_id, array_to_string(list_filter(parts, lambda p: NOT list_contains(list_transform(options, lambda o: upper(trim(split_part(o, '(', 1)))), upper(trim(split_part(p, '(', 1))))), ',') AS unlisted FROM p4 WHERE type = 'open_list'""")
def _(t):
    return prepared(t).where("type = 'open_list'").select("item_id", F.array_join(V.unlisted_options(), ",").alias("unlisted"))


@query("validate_special_missing", LADDER + """
SELECT item_id, vvalue AS value, ok, array_to_string(reasons, ',') AS reason_codes, missing_reason FROM vv WHERE rule IN (5, 6, 7, 8)""")
def _(t):
    special = (F.exists("parts", lambda p: X.special_missing_form(p).isNotNull()))
    df = V.validate_items(prepared(t)).where(special & ~F.col("rule_missing") & (F.col("val") != ""))
    keep = ~((F.col("type") == "categorical") & F.col("multi") & (F.size("parts") > 1))
    return df.where(keep).select("item_id", "verdict.value", "verdict.ok", F.array_join("verdict.reason_codes", ",").alias("reason_codes"), "verdict.missing_reason")


@query("absence_code_rule", LADDER + """
SELECT item_id, variable, absence, rule = 9 AS from_silence FROM vv WHERE absence IS NOT NULL AND np = 1 AND upper(parts[1]) = upper(absence)""")
def _(t):
    df = V.validate_items(prepared(t)).where(F.col("absence").isNotNull() & (F.size("parts") == 1) & (F.upper(F.get("parts", 0)) == F.upper("absence")))
    return df.select("item_id", "variable", "absence", (F.col("verdict.missing_reason") == "not_documented").alias("from_silence"))


@query("validate_items", LADDER + "SELECT item_id, case_id, variable, ok, outcome, vvalue AS value, array_to_string(reasons, ',') AS reason_codes, missing_reason FROM vv")
def _(t):
    return V.item_verdicts(V.validate_items(prepared(t)))


# alternatives: two per item of LENGTH_BAND and PERCEIVED_TIMELINESS
ALT_COLUMNS = [("alt_id", "item_id * 2 + variant"), ("item_id", "item_id"), ("case_id", "case_id"), ("variable", "variable"), ("ord", "variant"),
               ("value", "CASE variant WHEN 0 THEN '2' ELSE CASE WHEN m % 3 = 0 THEN '99' WHEN m % 3 = 1 THEN '2' ELSE '3' END END")]
ALT_FILTER = "v IN (1, 7) AND kind = 0 AND m2 <> 6"
ALT_CITES = [("item_id", "item_id * 2 + variant"), ("case_id", "case_id"), ("part", "'value'"), ("code", "''"), ("ord", "0"), ("passage_id", "'S' || CAST(case_id AS STRING) || '-P1'"),
             ("quote", "CASE WHEN m2 = 9 THEN 'something never written' ELSE substr(first_line, 2, 30) END"), ("stance", "'supports'")]


def alternatives(t):
    rows = _six(t).where(ALT_FILTER)
    return _proj(rows, ALT_COLUMNS), _proj(rows, ALT_CITES)


VERDICT_COLUMNS = ["item_id", "es", "value", "status", "rule_unclear", "counter", "verdict"]


def stored_verdicts(t):
    """Validated items as they would be stored: the columns later steps need."""
    return cut_lineage(V.validate_items(prepared(t)).select(*VERDICT_COLUMNS))


SQL_ALT = (f"alts AS (SELECT {_sel(ALT_COLUMNS)} FROM six WHERE {ALT_FILTER}), acites AS (SELECT {_sel(ALT_CITES)} FROM six WHERE {ALT_FILTER}), "
           + sql_checked("acites").replace("checked AS", "achecked AS", 1)
           + """, aok AS (SELECT a.*, f.codes[list_position(f.codes, a.value)] AS kept, vv.vvalue AS chosen FROM alts a JOIN fields f USING (variable) JOIN achecked c ON c.item_id = a.alt_id JOIN vv ON vv.item_id = a.item_id WHERE c.reason IS NULL AND list_contains(f.codes, a.value)),
akept AS (SELECT item_id, kept AS value, min(ord) AS ord FROM aok WHERE upper(kept) <> upper(chosen) GROUP BY item_id, kept)""")


@query("validate_alternatives", LADDER.rstrip() + f", {SQL_ALT} SELECT item_id, ord, value FROM akept")
def _(t):
    alts, cites = alternatives(t)
    chosen = V.validate_items(prepared(t)).select("item_id", "verdict.value")
    return V.validate_alternatives(V.alternative_verdicts(alts, cites, case_passages(t), codebook(t)), chosen)


@query("resolve_status", LADDER.rstrip() + f""", {SQL_ALT},
ac AS (SELECT item_id, count(*) AS total, (SELECT count(*) FROM akept k WHERE k.item_id = a.item_id) AS n_kept, count(*) - (SELECT count(*) FROM aok k WHERE k.item_id = a.item_id) AS n_rejected FROM alts a GROUP BY item_id),
r1 AS (SELECT vv.*, coalesce(n_kept, 0) AS nk, coalesce(n_rejected, 0) AS nr, es <> '' AND es NOT IN ({quoted(fixed.EVIDENCE_STATUSES)}) AS bades, es = 'INSUFFICIENT' AND ok AND missing_reason IN ('unknown', 'not_documented') AS silent FROM vv LEFT JOIN ac USING (item_id)),
r2 AS (SELECT *, es = 'INSUFFICIENT' AND coalesce(value, '') <> '' AND NOT silent AS forced FROM r1),
r3 AS (SELECT *, (forced OR ok) AND NOT bades AS rok, CASE WHEN forced THEN '' ELSE vvalue END AS rv, NOT forced AND outcome = 'partially_valid' AS part FROM r2)
SELECT item_id, CASE WHEN NOT rok THEN 'validation_failed' WHEN silent THEN 'suggested' WHEN es = 'INSUFFICIENT' THEN 'insufficient_evidence' WHEN es IN ('AMBIGUOUS', 'CONFLICTING') THEN CASE WHEN part THEN 'partially_valid' ELSE 'disputed' END
  WHEN es IN ('SUPPORTED', 'INFERRED') THEN CASE WHEN rv = '' THEN 'insufficient_evidence' WHEN part THEN 'partially_valid' WHEN rule_unclear OR coalesce(status = 'rule_unclear', FALSE) THEN 'rule_unclear' ELSE 'suggested' END
  WHEN part THEN 'partially_valid' WHEN rv = '' THEN CASE WHEN status = 'disputed' THEN 'disputed' ELSE 'insufficient_evidence' END
  ELSE CASE WHEN status = 'disputed' THEN 'disputed' WHEN rule_unclear OR coalesce(status = 'rule_unclear', FALSE) THEN 'rule_unclear' ELSE 'suggested' END END AS status,
 CASE WHEN NOT rok OR (es = 'INSUFFICIENT' AND NOT silent) THEN '' ELSE rv END AS value, CASE WHEN NOT bades AND es <> '' THEN es END AS evidence_status,
 CASE WHEN NOT rok THEN 'invalid' WHEN part THEN 'partially_valid' ELSE 'valid' END AS validation_status,
 array_to_string(list_filter([CASE WHEN bades THEN 'invalid_evidence_status' END, CASE WHEN forced THEN 'value_with_insufficient' END, CASE WHEN es = '' THEN 'evidence_status_missing' END, CASE WHEN rok AND nr > 0 THEN 'alternative_rejected' END,
  CASE WHEN rok AND silent AND missing_reason = 'unknown' THEN 'missing_unknown_from_silence' END, CASE WHEN rok AND silent AND missing_reason = 'not_documented' THEN 'absence_code_from_silence' END,
  CASE WHEN rok AND es = 'AMBIGUOUS' AND nk = 0 AND n_options < 2 THEN 'ambiguous_without_alternatives' END, CASE WHEN rok AND es = 'CONFLICTING' AND nk = 0 AND counter = 0 THEN 'conflicting_without_counter_evidence' END,
  CASE WHEN rok AND es IN ('SUPPORTED', 'INFERRED') AND rv = '' THEN 'status_without_value' END], lambda c: c IS NOT NULL), ',') AS codes, rok AND es <> '' AS complete FROM r3""")
def _(t):
    validated = stored_verdicts(t)
    alts, cites = alternatives(t)
    verdicts = V.alternative_verdicts(alts, cites, case_passages(t), codebook(t))
    kept = V.validate_alternatives(verdicts, validated.select("item_id", "verdict.value"))
    return V.resolve_status(validated, V.alternative_counts(verdicts, kept))


@query("derived_validation_status", with_tables("res") + f"""
SELECT id, CASE WHEN coalesce(validation_status, '') <> '' THEN validation_status WHEN status NOT IN ({quoted(fixed.MODEL_ROW_STATUSES)}) THEN 'not_applicable' WHEN status = 'validation_failed' THEN 'invalid' WHEN status = 'partially_valid' THEN 'partially_valid' ELSE 'valid' END AS validation_state,
 CASE WHEN coalesce(validation_status, '') = '' OR evidence_status = 'SUPPORTED' THEN '' WHEN evidence_status = 'INSUFFICIENT' AND trim(value) <> '' THEN 'not documented from silence' ELSE 'evidence status ' || coalesce(evidence_status, 'missing') END AS review_reason FROM res""")
def _(t):
    return V.derived_validation_status(t.results()).select("id", "validation_state", "review_reason")


@query("validate_review_edit", with_tables("act", SQL_FIELDS) + f"""
, e AS (SELECT id, type, multi, reason, value, {SQL_SPLIT.format(c='value')} AS parts, list_concat(codes, missing) AS al FROM act JOIN fields USING (variable) WHERE action = 'edit'),
b AS (SELECT *, list_filter(parts, lambda p: NOT list_contains(list_transform(al, lambda a: upper(a)), upper(p))) AS bad FROM e),
p AS (SELECT *, CASE WHEN reason = '' THEN 'a reason is required' WHEN type = 'categorical' AND len(bad) > 0 THEN 'not a codebook code: ' || array_to_string(bad, ', ') WHEN type = 'categorical' AND NOT multi AND len(parts) > 1 THEN 'single-select' END AS problem FROM b)
SELECT id, problem, CASE WHEN problem IS NULL THEN CASE WHEN type = 'categorical' THEN array_to_string(list_transform(parts, lambda p: al[list_position(list_transform(al, lambda a: upper(a)), upper(p))]), ', ') ELSE value END END AS value FROM p""".replace("\n, e AS", ", e AS", 1))
def _(t):
    return V.validate_review_edit(t.review_actions().where("action = 'edit'"), codebook(t))


FINAL_VALUE = ("CASE i WHEN 0 THEN CASE WHEN o_orderkey % 3 = 0 THEN '1' ELSE '0' END WHEN 1 THEN CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE 'cause' END WHEN 2 THEN CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE '50.1, 7.2' END "
               "WHEN 3 THEN CAST(o_orderkey % 4 AS STRING) || CASE WHEN o_orderkey % 8 < 4 THEN '.0' ELSE '' END WHEN 4 THEN substr(CAST(CAST(o_orderdate AS DATE) AS STRING), 1, 10) "
               "WHEN 5 THEN CASE o_orderkey % 6 WHEN 0 THEN '1995-03-01' WHEN 1 THEN 'later' ELSE substr(CAST(CAST(o_orderdate AS DATE) AS STRING), 1, 8) || '28' END WHEN 6 THEN CAST(o_orderkey % 30 AS STRING) "
               "WHEN 7 THEN CASE WHEN o_orderkey % 9 = 0 THEN '-9.0' ELSE '12' END ELSE CASE WHEN o_orderkey % 9 = 0 THEN '2; -9' ELSE '1' END END")
FINAL_NAMES = ["UNCERTAINTY_FLAG", "UNCERTAINTY_TYPE", "LAT/LONG", "GEOCODE_SPECIFICITY", "EVENT_DATE", "END_DATE", "INCIDENT_DURATION", "SHARE_PCT", "LENGTH_BAND"]
FINAL_FILTER = "NOT (i = 3 AND o_orderkey % 7 = 0)"


@query("consistency_flags", rf"""
WITH {SQL_FIELDS}, fin AS (SELECT o_orderkey AS case_id, i, name AS variable, regexp_replace(trim({FINAL_VALUE}), '^(-?\d+)\.0$', '\1') AS value FROM orders, (VALUES {", ".join(f"({i}, '{n}')" for i, n in enumerate(FINAL_NAMES))}) AS v(i, name) WHERE {FINAL_FILTER}),
w AS (SELECT case_id, max(value) FILTER (i = 0) AS uf, max(value) FILTER (i = 1) AS ut, max(value) FILTER (i = 2) AS ll, max(value) FILTER (i = 3) AS gs, try_cast(max(value) FILTER (i = 4) AS DATE) AS a, try_cast(max(value) FILTER (i = 5) AS DATE) AS b, max(value) FILTER (i = 6) AS du FROM fin GROUP BY case_id)
SELECT case_id, variable, 'missing code not defined' AS flag FROM fin JOIN fields USING (variable) WHERE i = 7 AND value = '-9' AND NOT list_contains(missing, '-9')
UNION ALL SELECT case_id, 'UNCERTAINTY_TYPE', 'type required when flagged' FROM w WHERE uf = '1' AND ut = ''
UNION ALL SELECT case_id, 'GEOCODE_SPECIFICITY', 'must be 0 without coordinates' FROM w WHERE ll = '' AND gs <> '0'
UNION ALL SELECT case_id, 'END_DATE', 'dates reversed' FROM w WHERE b < a UNION ALL SELECT case_id, 'EVENT_DATE', 'dates reversed' FROM w WHERE b < a
UNION ALL SELECT case_id, 'INCIDENT_DURATION', 'differs from the dates' FROM w WHERE b >= a AND du <> '' AND du <> CAST(b - a + 1 AS VARCHAR)""")
def _(t):
    rows = F.inline(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(n).alias("variable")) for i, n in enumerate(FINAL_NAMES)]))
    finals = t.raw("orders").select("o_orderkey", "o_orderdate", rows).where(FINAL_FILTER).select(
        F.col("o_orderkey").alias("case_id"), "variable", F.expr(FINAL_VALUE).alias("value"))
    return V.consistency_flags(finals, codebook(t))
