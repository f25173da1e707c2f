"""Queries over passage retrieval and ranking."""

from __future__ import annotations

from pyspark.sql import functions as F

from attesta.functions import fixed_values as fixed
from attesta.functions import text as X
from attesta.operators import passages as P
from attesta.operators import retrieval as R
from attesta.operators import validation as V
from attesta.plans.evidence_queries import HASHED, MARKED, SQL_HITS, SQL_USABLE, marked_sources, page_hits
from attesta.plans.registry import query, with_tables
from attesta.plans.text_queries import SQL_CLASSIFY, SQL_HOST, SQL_INDEX_WORD, SQL_RAW_TOKENS, SQL_STEM, quoted
from attesta.sources.tables import values_sql


def sql_tokens(c):
    return f"list_transform(list_filter({SQL_RAW_TOKENS.format(c=c)}, lambda w: {SQL_INDEX_WORD}), lambda w: {SQL_STEM})"


CORPUS = f"corpus AS (SELECT psg.* FROM psg JOIN (SELECT source_id FROM marked WHERE {SQL_USABLE}) USING (source_id))"


def corpus(t):
    return P.scan_usable_passages(t.passages(), marked_sources(t)).select("case_id", "passage_id", "source_id", "seq", "text")


def index(t):
    """The corpus as stem lists, made once per query."""
    if t.index is None:
        t.index = R.token_index(corpus(t))
    return t.index


def benchmark_queries(t):
    return t.raw("benchmark").select(F.col("item_id").alias("query_id"), (F.col("item_id") % 20).alias("case_id"), F.col("text").alias("query"))


@query("corpus_stats", with_tables("psg") + f"""
, tk AS (SELECT case_id, passage_id, {sql_tokens('text')} AS tk FROM psg),
sz AS (SELECT case_id, count(*) AS n_passages, round(avg(len(tk)), 6) AS avg_len FROM tk GROUP BY case_id)
SELECT case_id, term, count(DISTINCT passage_id) AS df, count(*) AS uses, any_value(n_passages) AS n_passages, any_value(avg_len) AS avg_len
FROM (SELECT case_id, passage_id, unnest(tk) AS term FROM tk) JOIN sz USING (case_id) GROUP BY case_id, term""".replace("\n, tk", ", tk", 1))
def _(t):
    return R.corpus_stats(t.passages().select("case_id", "text")).withColumn("avg_len", F.round("avg_len", 6))


SQL_BM25 = f"""tk AS (SELECT case_id, passage_id, source_id, seq, {sql_tokens('text')} AS tk FROM corpus),
sz AS (SELECT case_id, count(*) AS n, avg(len(tk)) AS avgdl FROM tk GROUP BY case_id),
tf AS (SELECT case_id, passage_id, source_id, seq, dl, term, count(*) AS f FROM (SELECT *, len(tk) AS dl, unnest(tk) AS term FROM tk) GROUP BY ALL),
df AS (SELECT case_id, term, count(*) AS df FROM tf GROUP BY ALL),
qt AS (SELECT query_id, case_id, term, count(*) AS qn FROM (SELECT item_id AS query_id, item_id % 20 AS case_id, unnest({sql_tokens('text')}) AS term FROM benchmark) GROUP BY ALL),
bm AS MATERIALIZED (SELECT query_id, case_id, passage_id, source_id, seq, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * (f * 2.4) / (f + 1.4 * (0.25 + 0.75 * dl / avgdl)) * (1 + 0.2 * (qn - 1))), 6) AS bm25
 FROM qt JOIN tf USING (case_id, term) JOIN df USING (case_id, term) JOIN sz USING (case_id) GROUP BY ALL)"""
TOP = lambda k: f"QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY bm25 DESC, source_id, seq) <= {k}"
LEX = with_tables("psg", HASHED, MARKED, CORPUS, SQL_BM25)


@query("bm25_topk", LEX + f"SELECT query_id, passage_id, bm25, row_number() OVER (PARTITION BY query_id ORDER BY bm25 DESC, source_id, seq) AS rank FROM bm {TOP(15)}")
def _(t):
    return R.bm25_topk(index(t), benchmark_queries(t), 15).select("query_id", "passage_id", "bm25", "rank")


# codebook variables made from the parts list
FIELD_NAME = ("replace(upper(p_name), ' ', '_') || '_' || CASE p_partkey % 7 WHEN 0 THEN 'LATENCY' WHEN 1 THEN 'LANGUAGE_FLAG' WHEN 2 THEN 'SIREN_STATUS' "
              "WHEN 3 THEN 'MEDIA' WHEN 4 THEN 'TRAINING_NOTES' WHEN 5 THEN 'SUMMARY' ELSE 'TYPE' END")
FIELD_DEFINITION = "'Whether the ' || p_name || ' ' || lower(p_type) || CASE p_partkey % 3 WHEN 0 THEN ' policy' WHEN 1 THEN ' seas' ELSE ' harmony' END"
FIELD_NOTES = "repeat('See ' || p_brand || '. ', 40)"
SQL_EXPANSIONS = values_sql([(i, k, v) for i, (k, v) in enumerate(fixed.QUERY_EXPANSIONS)], "ord bigint, k string, v string")


@query("variable_query", rf"""
WITH f AS (SELECT p_partkey AS field_id, {FIELD_NAME} AS name, {FIELD_DEFINITION} AS definition, {FIELD_NOTES} AS notes, lower(p_type) || ' alert' AS label FROM part),
b AS (SELECT field_id, name, regexp_replace(w || ' ' || w || ' ' || definition || ' ' || label || ' none documented ' || o || ' ' || substr(notes, 1, 300), ' +', ' ', 'g') AS base FROM
 (SELECT *, trim(regexp_replace(lower(name), '_+', ' ', 'g')) AS w, array_to_string(list_transform(range(12), lambda i: 'option' || i), ' ') AS o FROM f))
SELECT field_id, name, base || coalesce((SELECT string_agg(' ' || v, '' ORDER BY ord) FROM ({SQL_EXPANSIONS}) WHERE regexp_matches(lower(base), '\b' || k)), '') AS query FROM b""")
def _(t):
    # the narrow rows of a small file are dealt out before their texts are made
    parts = t.raw("part").select("p_partkey", "p_name", "p_type", "p_brand").repartition("p_partkey")
    fields = parts.select(
        F.col("p_partkey").alias("field_id"), F.expr(FIELD_NAME).alias("name"), F.expr(FIELD_DEFINITION).alias("definition"),
        F.expr(FIELD_NOTES).alias("notes"), F.array(F.concat(F.lower("p_type"), F.lit(" alert")), F.lit("none documented")).alias("labels"),
        F.transform(F.sequence(F.lit(0), F.lit(13)), lambda i: F.concat(F.lit("option"), i)).alias("options"))
    return R.variable_query(fields)


@query("semantic_topk", """
WITH v AS (SELECT vec_id, vec_id % 20 AS case_id, label, embedding::DOUBLE[] AS e FROM embeddings),
m AS (SELECT case_id, label, list(x ORDER BY dim) AS q FROM (SELECT case_id, label, dim, avg(x) AS x FROM (SELECT case_id, label, unnest(e) AS x, generate_subscripts(e, 1) AS dim FROM v) GROUP BY ALL) GROUP BY case_id, label),
s AS (SELECT v.case_id || '/' || m.label AS query_id, vec_id, round(list_inner_product(e, q) / ((sqrt(list_inner_product(e, e)) + 1e-9) * (sqrt(list_inner_product(q, q)) + 1e-9)), 6) AS semantic FROM v JOIN m ON v.case_id = m.case_id)
SELECT query_id, vec_id, semantic, row_number() OVER (PARTITION BY query_id ORDER BY semantic DESC, vec_id) AS rank FROM s WHERE semantic > 0.05 QUALIFY rank <= 8""")
def _(t):
    vectors = t.raw("embeddings").withColumn("case_id", F.col("vec_id") % 20)
    queries = R.mean_vectors(vectors, "case_id", "label").withColumn("query_id", F.concat_ws("/", "case_id", "label"))
    found, _ = R.semantic_topk(vectors.drop("label"), queries, ["vec_id"], 8)
    return found.select("query_id", "vec_id", "semantic", "rank")


@query("lsa_vectors")
def _(t):
    """Unit vectors of all passages in the space of their case, 16 dimensions."""
    return R.lsa_vectors(t.passages().select("case_id", "passage_id", "text"), dimensions=16)


@query("lsa_topk")
def _(t):
    """The passages closest to each query in the latent space of its case."""
    asked = benchmark_queries(t)
    model = R.lsa_model(corpus(t), dimensions=16, terms=R.query_terms(asked).select("case_id", "term"))
    found, _ = R.semantic_topk(model.passages, R.lsa_queries(model, asked), ["source_id", "seq"], 8)
    return found.select("query_id", "passage_id", "semantic", "rank")


def vectors_of_passages(t):
    """The first passage of a source carries the vector with the source's number, where there is one."""
    v = t.raw("embeddings").select(F.col("vec_id").alias("source_id"), "embedding")
    return index(t).where("seq = 1").drop("tk").join(v, "source_id")


def semantic_lists(t):
    q = t.raw("embeddings").join(benchmark_queries(t), F.col("vec_id") == F.col("query_id")).select("query_id", "case_id", "embedding")
    return R.semantic_scores(vectors_of_passages(t), q)


SQL_SEM = """sem AS (SELECT query_id, passage_id, source_id, seq, semantic FROM (SELECT b.item_id AS query_id, c.passage_id, c.source_id, c.seq,
 round(list_inner_product(e, q) / ((sqrt(list_inner_product(e, e)) + 1e-9) * (sqrt(list_inner_product(q, q)) + 1e-9)), 6) AS semantic
 FROM benchmark b JOIN (SELECT vec_id, embedding::DOUBLE[] AS q FROM embeddings) qv ON qv.vec_id = b.item_id
 JOIN corpus c ON c.case_id = b.item_id % 20 AND c.seq = 1 JOIN (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings) dv ON dv.vec_id = c.source_id) WHERE semantic > 0.05),
lr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY bm25 DESC, source_id, seq) AS lx FROM bm QUALIFY lx <= 200),
sr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY semantic DESC, source_id, seq) AS sx FROM sem QUALIFY sx <= 200),
fused AS (SELECT coalesce(lr.query_id, sr.query_id) AS query_id, coalesce(lr.passage_id, sr.passage_id) AS passage_id, coalesce(lr.source_id, sr.source_id) AS source_id,
 coalesce(lr.seq, sr.seq) AS seq, bm25, semantic, lx, sx, round(coalesce(1.0 / (59 + lx), 0) + coalesce(1.0 / (59 + sx), 0), 8) AS score
 FROM lr FULL JOIN sr ON lr.query_id = sr.query_id AND lr.passage_id = sr.passage_id)"""
FUSED = lambda k: (f"SELECT query_id, passage_id, source_id, seq, round(score, 5) AS score, coalesce(round(bm25, 3), 0) AS bm25, coalesce(round(semantic, 3), 0) AS semantic, "
                   f"row_number() OVER (PARTITION BY query_id ORDER BY score DESC, lx NULLS LAST, sx NULLS LAST) AS rank FROM fused QUALIFY rank <= {k}")
HYBRID = with_tables("psg", HASHED, MARKED, CORPUS, SQL_BM25, SQL_SEM)


def hybrid(t, k):
    lexical = R.bm25_scores(index(t), benchmark_queries(t)).withColumn("bm25", F.round("bm25", 6))
    return R.rrf_fusion(lexical, semantic_lists(t), k)


@query("rrf_fusion", HYBRID + FUSED(8))
def _(t):
    return hybrid(t, 8)


@query("evidence_search", HYBRID + f"SELECT query_id, rank, passage_id, title, psg.text, score FROM ({FUSED(15)}) h JOIN psg USING (passage_id) JOIN src ON src.source_id = h.source_id")
def _(t):
    hits = hybrid(t, 15)
    text = t.passages().select("passage_id", "text")
    titles = t.sources().select("source_id", "title")
    return hits.join(text, "passage_id").join(titles, "source_id").select("query_id", "rank", "passage_id", "title", "text", "score")


NAME = "split_part(text, ' ', 1) || '_' || split_part(text, ' ', 2) || '_' || split_part(text, ' ', 4)"
SQL_STRENGTH = f"""hits AS ({FUSED(5)}), names AS (SELECT item_id AS query_id, item_id % 20 AS case_id, {NAME} AS name,
 list_distinct({sql_tokens("regexp_replace(" + NAME + r", '[^\p{L}\p{N}]+', ' ', 'g')")}) AS key FROM benchmark),
str AS (SELECT names.query_id, case_id, name, coalesce(round(least(1.0, max(bm25) / 12) * 0.6 + max(len(list_intersect(key, tk)) / greatest(len(key), 1)) * 0.4, 3), 0) AS strength
 FROM names LEFT JOIN (SELECT query_id, bm25, {sql_tokens('psg.text')} AS tk FROM hits JOIN psg USING (passage_id)) h ON h.query_id = names.query_id GROUP BY ALL)"""


def strengths(t):
    fields = t.raw("benchmark").select(F.col("item_id").alias("query_id"), (F.col("item_id") % 20).alias("case_id"), F.expr(NAME).alias("name"))
    return R.evidence_strength(hybrid(t, 5), index(t), fields)


@query("evidence_strength", HYBRID.rstrip() + f", {SQL_STRENGTH} SELECT query_id, case_id, name, strength FROM str")
def _(t):
    return strengths(t)


@query("evidence_gaps", HYBRID.rstrip() + f", {SQL_STRENGTH} SELECT query_id, case_id, name, strength FROM str WHERE strength < 0.35")
def _(t):
    return R.evidence_gaps(strengths(t))


SQL_HINTS = values_sql([(i, k[:5], " ".join(v.split()[:3])) for i, (k, v) in enumerate(fixed.QUERY_EXPANSIONS)], "ord bigint, start string, more string")


@query("gap_queries", rf"""
WITH g AS (SELECT p_partkey % 20 AS case_id, p_partkey AS pos, {FIELD_NAME} AS name FROM part),
w AS (SELECT *, list_filter(string_split(lower(name), '_'), lambda x: x <> '' AND x NOT IN ({quoted(fixed.GENERIC_NAME_WORDS)}))[1:3] AS ws FROM g),
e AS (SELECT case_id, pos, name, ws, (SELECT arg_max(more, i) FROM (SELECT i, arg_min(more, ord) AS more FROM (SELECT unnest(range(1, len(ws) + 1)) AS i) JOIN ({SQL_HINTS}) ON starts_with(ws[i], start) GROUP BY i)) AS extra FROM w),
q AS (SELECT case_id, min(pos) AS pos, arg_min(name, pos) AS name, query FROM (SELECT *, '{{core}} ' || array_to_string(ws, ' ') || coalesce(' ' || extra, '') AS query FROM e) GROUP BY case_id, query)
SELECT case_id, row_number() OVER (PARTITION BY case_id ORDER BY pos) AS rank, name, query FROM q QUALIFY rank <= 8""")
def _(t):
    return R.gap_queries(t.raw("part").select((F.col("p_partkey") % 20).alias("case_id"), F.col("p_partkey").alias("pos"), F.expr(FIELD_NAME).alias("name")))


# the packing order written as a fold over the variables of a section
SQL_PACKETS = f"""hits AS ({FUSED(fixed.PASSAGES_PER_VARIABLE)}),
fl AS (SELECT item_id, item_id % 20 AS case_id, CAST(item_id % 40 AS VARCHAR) AS section, {{name}} AS name, coalesce(ids, []) AS ids FROM benchmark LEFT JOIN (SELECT query_id, list(passage_id ORDER BY rank) AS ids FROM hits GROUP BY query_id) h ON query_id = item_id),
fold AS (SELECT case_id, section, list_reduce(list_prepend({{{{'done': []::STRUCT(n VARCHAR[], p VARCHAR[])[], 'n': []::VARCHAR[], 'p': []::VARCHAR[]}}}}, list({{{{'done': []::STRUCT(n VARCHAR[], p VARCHAR[])[], 'n': [name], 'p': ids}}}} ORDER BY item_id)),
  lambda a, x: CASE WHEN len(a.n) > 0 AND (len(list_distinct(list_concat(a.p, x.p))) > {fixed.MAX_PASSAGES_PER_CALL} OR len(a.n) >= {fixed.MAX_VARIABLES_PER_CALL})
   THEN {{{{'done': list_append(a.done, {{{{'n': a.n, 'p': a.p}}}}), 'n': x.n, 'p': x.p}}}}
   ELSE {{{{'done': a.done, 'n': list_concat(a.n, x.n), 'p': list_concat(a.p, list_filter(x.p, lambda i: NOT list_contains(a.p, i)))}}}} END) AS f FROM fl GROUP BY case_id, section),
pk AS (SELECT case_id, section, i - 1 AS batch, d[i].n AS variables, d[i].p AS passage_ids FROM (SELECT case_id, section, d, unnest(range(1, len(d) + 1)) AS i FROM (SELECT case_id, section, list_append(f.done, {{{{'n': f.n, 'p': f.p}}}}) AS d FROM fold)))"""


def packets(t, name):
    fields = t.raw("benchmark").select(
        F.col("item_id").alias("query_id"), (F.col("item_id") % 20).alias("case_id"), (F.col("item_id") % 40).cast("string").alias("section"),
        F.col("item_id").alias("pos"), F.expr(name).alias("name"))
    return R.evidence_packets(hybrid(t, fixed.PASSAGES_PER_VARIABLE), fields)


@query("evidence_packets", HYBRID.rstrip() + ", " + SQL_PACKETS.format(name=NAME) + " SELECT case_id, section, batch, array_to_string(variables, ',') AS variables, array_to_string(passage_ids, ',') AS passage_ids FROM pk")
def _(t):
    return packets(t, NAME).select("case_id", "section", "batch", *[F.array_join(c, ",").alias(c) for c in ("variables", "passage_ids")])


# codebook rules of the benchmark's items, as columns that both engines understand
FIELD = f"CASE WHEN item_id = 8 THEN 'TRAINING_AND_PROCEDURAL_CONTEXT' ELSE {NAME} || '_' || CAST(item_id AS STRING) END"
SPEC_COLUMNS = [
    ("type", "CASE item_id % 4 WHEN 0 THEN 'categorical' WHEN 1 THEN 'numeric' WHEN 2 THEN 'open_list' ELSE 'text' END"), ("multi", "item_id % 5 = 0"), ("definition", "text"),
    ("code_list", "CASE WHEN item_id % 4 = 0 THEN '0|1|2' END"), ("label_list", "CASE WHEN item_id % 4 = 0 THEN 'Not discussed|' || split_part(text, ' ', 1) || '|other' END"),
    ("option_list", "CASE WHEN item_id % 4 = 2 THEN 'a|b|c|d|e|f|g|h|i|j|k|l|m|n|o|p|q' END"), ("has_bands", "item_id % 8 = 1"),
    ("missing_list", "CASE WHEN item_id % 3 = 0 THEN '-9' END"), ("absence", "CASE WHEN item_id = 8 THEN '0' END"),
    ("format", "CASE WHEN item_id % 4 = 1 THEN 'a number' END"), ("notes", "CASE WHEN item_id % 2 = 0 THEN repeat(text, 4) END"), ("has_issues", "item_id % 6 = 0"),
]
SQL_SPECS = ("sc AS (SELECT item_id, item_id % 20 AS case_id, " + FIELD + " AS name, " + ", ".join(f"{e} AS {n}" for n, e in SPEC_COLUMNS) + """ FROM benchmark),
sp AS (SELECT case_id, name, concat_ws(chr(10), '### ' || name || '  (type: ' || type || CASE WHEN multi THEN ', MULTI-SELECT' ELSE ', single value' END || CASE WHEN regexp_matches(lower(definition || ' ' || name), '""" + fixed.CAUSAL_PATTERN + """') THEN ', CAUSAL' ELSE '' END || ')',
 'Definition: ' || definition, 'Permitted codes: ' || array_to_string(list_transform(range(1, 4), lambda i: string_split(code_list, '|')[i] || ' = ' || string_split(label_list, '|')[i]), '; '),
 'Listed options (open list; other specific values allowed): ' || array_to_string(string_split(option_list, '|')[1:15], '; '), CASE WHEN has_bands THEN 'Percentage bands: 0-50% = low; 51-100% = high (record a percentage number)' END,
 CASE WHEN missing_list IS NULL THEN 'No special missing value is defined for this variable: leave blank when not established.' ELSE 'Special missing values defined for THIS variable: -9 = Unknown (use -9 for Unknown = not mentioned in the passages, or Not applicable; begin the rationale with ''Unknown:'' or ''Not applicable:'')' END,
 CASE WHEN absence IS NOT NULL THEN 'Absence code: 0 = Not discussed. Only if no passage discusses this variable, give "0" alone with evidence_status INSUFFICIENT, no citation, and a rationale beginning ''Not documented:''.' END,
 'Format: ' || format, 'Coding notes: ' || substr(notes, 1, 600), CASE WHEN has_issues THEN 'Known rule issues (follow the codebook text literally and mention these in ''unresolved'' if relevant): Rule unclear | Two rules' END) AS spec FROM sc)""")


def benchmark_specs(t):
    rows = t.raw("benchmark").select("item_id", (F.col("item_id") % 20).alias("case_id"), F.expr(FIELD).alias("name"), *[F.expr(e).alias(n) for n, e in SPEC_COLUMNS])
    split = lambda n: F.split(n, r"\|")
    band = lambda low, high, label: F.struct(F.lit(low).alias("low"), F.lit(high).alias("high"), F.lit(label).alias("label"))
    fields = rows.select(
        "case_id", "name", "type", "multi", "definition", split("code_list").alias("codes"), split("label_list").alias("labels"), split("option_list").alias("open_options"),
        F.when(F.col("has_bands"), F.array(band(0, 50, "low"), band(51, 100, "high"))).alias("bands"), split("missing_list").alias("missing_codes"),
        F.transform(split("missing_list"), lambda m: F.lit("Unknown")).alias("missing_labels"), "format", "notes",
        F.when(F.col("has_issues"), F.array(F.lit("Rule unclear"), F.lit("Workbook data: odd"), F.lit("Two rules"))).alias("issues"))
    absence = V.absence_codes(fields.withColumnRenamed("name", "variable")).withColumnRenamed("variable", "name")
    return R.variable_specs(fields.join(absence, "name", "left"))


@query("variable_spec", f"WITH {SQL_SPECS} SELECT case_id, name, spec FROM sp")
def _(t):
    return benchmark_specs(t).select("case_id", "name", "spec")


SQL_BLOCK = """'[' || passage_id || '] (source S' || source_id || ': ' || source_type || '; "' || substr(title, 1, 90) || '"; ' || coalesce(published_date, 'date unknown') || '; '
 || CASE WHEN page IS NOT NULL THEN 'page ' || page ELSE 'para ' || para END || CASE WHEN near_duplicate_of IS NOT NULL THEN '; NEAR-DUPLICATE/SYNDICATED COPY of source S' || near_duplicate_of ELSE '' END
 || CASE WHEN relevance_status = 'uncertain' THEN '; RELEVANCE UNCERTAIN' ELSE '' END || ')' || chr(10) || text"""
NEAR_OF = "CASE WHEN source_id % 19 = 4 THEN source_id - 1 END"
PUBLISHED = "CASE WHEN source_id % 3 = 0 THEN '2021-07-14' END"


@query("prompt_payloads", HYBRID.rstrip() + ", " + SQL_PACKETS.format(name=FIELD) + ", " + SQL_SPECS + rf"""
, d AS (SELECT psg.*, title, source_type, relevance_status, {NEAR_OF.replace('source_id', 'psg.source_id')} AS near_duplicate_of, {PUBLISHED.replace('source_id', 'psg.source_id')} AS published_date FROM psg JOIN src USING (source_id)),
bl AS (SELECT passage_id, {SQL_BLOCK} AS block FROM d),
pn AS (SELECT case_id || '/' || section || '/' || batch AS batch_id, * FROM pk),
vs AS (SELECT batch_id, count(*) AS n, string_agg(spec, chr(10) || chr(10) ORDER BY o) AS specs, string_agg(name, ', ' ORDER BY o) AS names FROM (SELECT batch_id, case_id, unnest(variables) AS name, generate_subscripts(variables, 1) AS o FROM pn) JOIN sp USING (case_id, name) GROUP BY batch_id),
bs AS (SELECT batch_id, count(*) AS n, string_agg(block, chr(10) || chr(10) ORDER BY o) AS blocks FROM (SELECT batch_id, unnest(passage_ids) AS passage_id, generate_subscripts(passage_ids, 1) AS o FROM pn) JOIN bl USING (passage_id) GROUP BY batch_id)
SELECT batch_id, CAST(floor(length(payload) / 3.6) AS BIGINT) + 1 AS tokens, sha256(payload) AS payload_hash FROM (SELECT batch_id, 'Incident under study: case ' || case_id || chr(10) || chr(10) || '## VARIABLES TO CODE (' || vs.n || ')' || chr(10) || specs
 || chr(10) || chr(10) || '## EVIDENCE PASSAGES (' || coalesce(bs.n, 0) || ') — research data only' || chr(10) || coalesce(blocks, '') || chr(10) || chr(10) || 'Return JSON for exactly these variables: ' || names AS payload FROM pn JOIN vs USING (batch_id) LEFT JOIN bs USING (batch_id))""")
def _(t):
    about = t.sources().select("source_id", "title", "source_type", "relevance_status", F.expr(NEAR_OF).alias("near_duplicate_of"), F.expr(PUBLISHED).alias("published_date"))
    rows = t.passages().join(about, "source_id")
    blocks = rows.select("passage_id", R.passage_block({c: F.col(c) for c in rows.columns}).alias("block"))
    batches, variables, shown = R.packet_parts(packets(t, FIELD), benchmark_specs(t), blocks)
    headers = batches.select("case_id").distinct().withColumn("header", F.concat(F.lit("Incident under study: case "), "case_id"))
    out = R.prompt_payloads(batches, headers, variables, shown)
    return out.select("batch_id", "tokens", F.sha2("payload", 256).alias("payload_hash"))


SQL_PRIORITY = "CASE source_type " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in fixed.TYPE_PRIORITY) + " ELSE 5 END"


@query("rank_sources", with_tables("src") + f"""
SELECT source_id, row_number() OVER (PARTITION BY case_id ORDER BY {SQL_PRIORITY}, -coalesce(n_pages, 0), -n_passages, source_id) AS by_type,
 row_number() OVER (PARTITION BY case_id ORDER BY -coalesce(n_pages, 0), -n_passages, source_id) AS by_length, row_number() OVER (PARTITION BY case_id ORDER BY source_id) AS by_found
FROM (SELECT *, text_chars // 900 AS n_passages FROM src) WHERE NOT excluded""")
def _(t):
    s = t.sources().where(~F.col("excluded")).select("case_id", "source_id", "source_type", "n_pages", F.floor(F.col("text_chars") / 900).alias("n_passages"))
    ranked = [R.rank_sources(s, m).select("source_id", F.col("rank").alias(f"by_{m}")) for m in ("type", "length", "found")]
    return ranked[0].join(ranked[1], "source_id").join(ranked[2], "source_id")


@query("rank_candidates", f"""WITH {SQL_HITS}, used AS (SELECT page_id % 20 AS case_id, count(*) AS used FROM pages WHERE page_id % 9 = 1 GROUP BY ALL),
typed AS (SELECT *, {SQL_CLASSIFY} AS source_type FROM (SELECT *, {SQL_HOST.format(c='lower(url)')} AS host, ' ' || lower(url) || ' ' AS t FROM hits))
SELECT case_id, hit_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY -round(identity_score, 1), {SQL_PRIORITY}, hit_id) AS rank FROM typed WHERE identity_score >= 0.3)
LEFT JOIN used USING (case_id) WHERE rank <= 12 - coalesce(used, 0)""")
def _(t):
    hits = page_hits(t).withColumn("source_type", X.classify_source(F.col("url"), F.lit(""), F.lit("")))
    used = t.raw("pages").where("page_id % 9 = 1").groupBy((F.col("page_id") % 20).alias("case_id")).agg(F.count("*").alias("used"))
    return R.rank_candidates(hits, used, 12).select("case_id", "hit_id", "rank")
