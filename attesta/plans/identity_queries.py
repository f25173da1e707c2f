"""Queries over incident identity, relevance and search expansion."""

from __future__ import annotations

from pyspark.sql import functions as F

from attesta.functions import fixed_values as fixed
from attesta.operators import identity as I
from attesta.operators import passages as P
from attesta.plans.evidence_queries import SQL_LINKS
from attesta.plans.registry import query, with_tables
from attesta.plans.text_queries import HAZARD_TEXT, LOCATION_TEXT, SQL_COUNTRY_NAMES, SQL_HAZARDS, SQL_HOST, SQL_PLACE, SQL_SIG, SQL_US, quoted
from attesta.sources.tables import values_sql

CASE_NAME = "replace(" + HAZARD_TEXT + ", ' ' || c_name, '')"
CASE_COLUMNS = [
    ("case_id", "c_custkey"), ("name", CASE_NAME), ("location", LOCATION_TEXT),
    ("aliases", "CASE c_custkey % 3 WHEN 0 THEN 'Ahr flood; Siren test' WHEN 1 THEN '' ELSE 'the ' || lower(c_mktsegment) || ' alert' END"),
    ("date_text", "CASE c_custkey % 5 WHEN 0 THEN '' WHEN 1 THEN 'July 2021' WHEN 2 THEN '2019' WHEN 3 THEN 'January 2022 to May 2023' ELSE 'May 2018' END"),
]
HIT_TITLE = ("CASE source_id % 5 WHEN 0 THEN name || ' ' || location || ': ' || title WHEN 1 THEN upper(name) || ' ' || title "
             "WHEN 2 THEN 'Ahrtal und Ahrweiler, Bad Neuenahr: ' || title WHEN 3 THEN location || ' Report ' || lower(title) ELSE title END")
PUBLISHED = "CASE WHEN source_id % 7 = 0 THEN '2021-07-15' ELSE '' END"


def cases(t):
    return t.raw("customer").select(*[F.expr(e).alias(n) for n, e in CASE_COLUMNS])


def hits(t):
    """Search hits: every document as a hit of its case; the title may name the incident."""
    df = t.sources().join(cases(t), "case_id").select(
        F.col("source_id").alias("hit_id"), "case_id", "url", F.expr(HIT_TITLE).alias("title"), F.col("text").alias("snippet"), F.expr(PUBLISHED).alias("published"))
    return df


SQL_CASES = "cases AS (SELECT " + ", ".join(f"{e} AS {n}" for n, e in CASE_COLUMNS) + " FROM customer)"
SQL_TERMS = f"""lows AS (SELECT *, ' ' || regexp_replace(lower(location), '[,;/()]', ' ', 'g') || ' ' AS low FROM cases),
ctry AS (SELECT *, CASE WHEN {SQL_US} THEN NULL ELSE (SELECT arg_min(code, ord) FROM country_names WHERE contains(low, probe)) END AS country FROM lows),
terms AS (SELECT case_id, name, location, country, {SQL_SIG.format(c='name')} AS name_t,
 list_transform(list_filter(string_split(aliases, ';'), lambda a: trim(a) <> ''), lambda a: {SQL_SIG.format(c='a')}) AS alias_t,
 list_filter({SQL_SIG.format(c='location')}, lambda w: length(w) > 2) AS loc_t, list_sort(list_distinct(regexp_extract_all(date_text, '{fixed.YEAR_PATTERN}'))) AS years,
 list_filter([{quoted(fixed.MONTHS)}], lambda m: contains(lower(date_text), m)) AS months, country IS NOT NULL AS cp,
 coalesce((SELECT list(name) FROM country_names WHERE code = country), []) AS cnames FROM ctry)"""
SQL_HITLIST = (f"hits AS (SELECT source_id AS hit_id, case_id, url, {HIT_TITLE} AS title, text AS snippet, {PUBLISHED} AS published FROM src JOIN cases USING (case_id))")
BASE = with_tables("src", SQL_COUNTRY_NAMES, SQL_CASES, SQL_TERMS, SQL_HITLIST)


def sql_hit(t):
    return (f"(list_contains(toks, {t}) OR (cp AND CASE WHEN regexp_full_match({t}, '[\\x00-\\x7F]*') THEN length({t}) >= 3 AND len(list_filter(toks, lambda x: starts_with(x, {t}) AND length(x) <= length({t}) + 10)) > 0 "
            f"ELSE contains(low, {t}) END))")


def sql_share(words, test, empty):
    return f"CASE WHEN len({words}) > 0 THEN len(list_filter({words}, lambda q: {test})) / len({words}) ELSE {empty} END"


def sql_score(name, source, text, published="''", location=True, years=True):
    """CTE ``name``: the rows of ``source`` with score and why."""
    loc = sql_share("loc_t", f"{sql_hit('q')} OR (list_contains(cnames, q) AND len(list_filter(cnames, lambda z: NOT list_contains(loc_t, z) AND {sql_hit('z')})) > 0)", 0.5) if location else "0.5"
    target = "years" if years else "[]::VARCHAR[]"
    return f"""{name} AS (SELECT * EXCLUDE (low, toks, ys, target, nm, lc, early), round(0.5 * nm + 0.3 * lc + 0.2 * CASE WHEN len(target) = 0 THEN 0.5 WHEN list_has_any(ys, target) THEN 1 WHEN len(ys) = 0 THEN 0.5
   WHEN len(early) > 0 AND len(list_filter(ys, lambda y: y > list_max(target))) = 0 THEN 0 ELSE 0.35 END, 3) AS score,
 'name ' || CAST(round_even(nm * 100, 0) AS INT) || '%, location ' || CAST(round_even(lc * 100, 0) AS INT) || '%, ' || CASE WHEN len(target) = 0 OR (len(ys) = 0) THEN 'no year stated' WHEN list_has_any(ys, target) THEN 'target year mentioned'
   WHEN len(early) > 0 AND len(list_filter(ys, lambda y: y > list_max(target))) = 0 THEN 'only earlier years mentioned (' || array_to_string(list_sort(list_distinct(early))[1:3], ', ') || ')'
   ELSE 'other years mentioned (' || array_to_string(list_sort(list_distinct(ys))[1:3], ', ') || ')' END AS why
 FROM (SELECT *, list_filter(ys, lambda y: y < list_min(target)) AS early, greatest({sql_share('name_t', sql_hit('q'), 0)}, coalesce(list_max(list_transform(alias_t, lambda al: {sql_share('al', sql_hit('q'), 0)})), 0)) AS nm, {loc} AS lc
 FROM (SELECT *, {target} AS target, list_distinct(regexp_extract_all(low, '[\\p{{L}}\\p{{N}}]+')) AS toks, regexp_extract_all(low || ' ' || {published}, '{fixed.YEAR_PATTERN}') AS ys
 FROM (SELECT s.*, tm.* EXCLUDE (case_id, name, location), lower({text}) AS low FROM {source} s JOIN terms tm USING (case_id)))))"""


@query("case_terms", with_tables(SQL_COUNTRY_NAMES, SQL_CASES, SQL_TERMS) + """
SELECT case_id, array_to_string(name_t, ' ') AS name_t, array_to_string(list_transform(alias_t, lambda a: array_to_string(a, ' ')), '|') AS alias_t, array_to_string(loc_t, ' ') AS loc_t,
 array_to_string(years, ' ') AS years, array_to_string(months, ' ') AS months, cp AS compound, array_to_string(list_filter(cnames, lambda n: NOT list_contains(loc_t, n)), '|') AS native FROM terms""")
def _(t):
    j = lambda c, s=" ": F.array_join(c, s).alias(c)
    return I.case_terms(cases(t)).select("case_id", j("name_t"), F.array_join(F.transform("alias_t", lambda a: F.array_join(a, " ")), "|").alias("alias_t"),
                                         j("loc_t"), j("years"), j("months"), "compound", j("native", "|"))


@query("identity_score", BASE.rstrip() + f", {sql_score('sc', 'hits', 'title || chr(32) || snippet || chr(32) || url', 'published')} SELECT hit_id, score AS identity_score, why AS identity_why FROM sc")
def _(t):
    return I.score_hits(hits(t), I.case_terms(cases(t))).select("hit_id", "identity_score", "identity_why")


SQL_TEXTS = f"texts AS (SELECT source_id, case_id, {HIT_TITLE} || ' ' || text AS body FROM src JOIN cases USING (case_id))"


@query("relevance_status", BASE.rstrip() + f", {SQL_TEXTS}, {sql_score('hd', 'texts', 'substr(body, 1, 6000)')}, {sql_score('fl', 'texts', 'body')}" + """
SELECT case_id, source_id, greatest(hd.score, fl.score) AS relevance_score, CASE WHEN greatest(hd.score, fl.score) >= 0.6 THEN 'relevant' WHEN greatest(hd.score, fl.score) >= 0.4 THEN 'uncertain' ELSE 'irrelevant' END AS relevance_status,
 CASE WHEN hd.score >= fl.score THEN hd.why ELSE fl.why END AS relevance_reason FROM hd JOIN fl USING (case_id, source_id)""")
def _(t):
    texts = t.sources().join(cases(t), "case_id").select("case_id", "source_id", F.concat_ws(" ", F.expr(HIT_TITLE), "text").alias("text"))
    return I.relevance_status(texts, I.case_terms(cases(t)))


@query("identity_candidates", BASE.rstrip() + f", {sql_score('nm', 'hits', 'title || chr(32) || snippet', location=False, years=False)}" + rf""",
y AS (SELECT case_id, hit_id, title, unnest(CASE WHEN len(ys) > 0 THEN ys[1:2] ELSE ['(no year)'] END) AS year FROM (SELECT *, list_sort(list_distinct(regexp_extract_all(title || ' ' || snippet || ' ' || published, '{fixed.YEAR_PATTERN}'))) AS ys FROM nm WHERE score >= 0.45)),
c AS (SELECT case_id, year, count(*) AS n, array_to_string(list(title ORDER BY hit_id)[1:3], ' | ') AS examples, min(hit_id) AS fh FROM y GROUP BY case_id, year),
r AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY n DESC, fh) AS rank FROM c QUALIFY rank <= 6),
k AS (SELECT r.*, years, list_contains(years, year) AS tgt FROM r JOIN terms USING (case_id) WHERE n >= 2)
SELECT case_id, rank, year, n, examples, (len(years) = 0 AND count(*) FILTER (year <> '(no year)') OVER (PARTITION BY case_id) >= 2) OR (len(years) > 0
  AND coalesce(max(CASE WHEN NOT tgt AND year <> '(no year)' THEN n END) OVER (PARTITION BY case_id) > 1.5 * coalesce(max(CASE WHEN tgt THEN n END) OVER (PARTITION BY case_id), 0), FALSE)) AS ambiguous FROM k""")
def _(t):
    return I.identity_candidates(hits(t), I.case_terms(cases(t)))


WORD = r"\p{L}[\p{L}\p{N}]+(?:-\p{L}[\p{L}\p{N}]+)*"
UP = lambda c: rf"regexp_matches({c}, '^\p{{Lu}}')"
KSTOP = quoted(fixed.KEYWORD_STOP_WORDS)


def sql_runs(n):
    return (f"list_transform(list_filter(list_transform(range(1, len(w) - {n - 2}), lambda i: w[i:i+{n - 1}]), lambda r: len(list_filter(r, lambda x: NOT {UP('x')})) = 0 "
            f"AND lower(r[1]) NOT IN ({KSTOP}) AND lower(r[{n}]) NOT IN ({KSTOP})), lambda r: array_to_string(r, ' '))")


SQL_KEYWORDS = rf"""kt AS (SELECT case_id, hit_id, host, tok, lower(tok) AS lw FROM (SELECT case_id, hit_id, host, unnest(list_distinct(list_concat(list_concat(list_filter(w, lambda x: length(x) >= 3), {sql_runs(2)}), {sql_runs(3)}))) AS tok
  FROM (SELECT case_id, hit_id, lower(regexp_replace({SQL_HOST.format(c='url')}, '^www\.', '')) AS host, regexp_extract_all(title || ' ' || snippet, '{WORD}') AS w FROM sc WHERE score >= 0.5)) WHERE lower(tok) NOT IN ({KSTOP})),
kc AS (SELECT case_id, lw, count(DISTINCT host) AS sites, arg_max(tok, ({UP('tok')}, -hit_id, encode(tok))) AS term FROM kt GROUP BY case_id, lw HAVING count(DISTINCT host) >= 2),
kr AS (SELECT case_id, lw, sites, term, len(list_filter(list_concat(name_t, loc_t), lambda a: length(a) >= 3 AND starts_with(lw, a) AND length(lw) > length(a))) > 0 AS anchored FROM kc JOIN terms USING (case_id)
  WHERE NOT list_contains(list_concat(list_concat(name_t, loc_t), flatten(alias_t)), lw)),
kl AS (SELECT case_id, list_reduce(list_prepend([]::VARCHAR[], list([lw] ORDER BY anchored DESC, sites DESC, len(string_split(term, ' ')) DESC, encode(lw))), lambda a, x: CASE WHEN len(list_filter(a, lambda k: contains(k, ' ') AND list_contains(string_split(k, ' '), x[1]))) > 0
   OR (contains(x[1], ' ') AND list_has_all(a, string_split(x[1], ' '))) THEN a ELSE list_append(a, x[1]) END)[1:8] AS kept FROM kr WHERE anchored OR {UP('term')} OR NOT regexp_full_match(term, '[\x00-\x7F]*') GROUP BY case_id),
kw AS (SELECT kl2.case_id, kl2.rank, term, sites, anchored FROM (SELECT case_id, unnest(kept) AS lw, generate_subscripts(kept, 1) AS rank FROM kl) kl2 JOIN kr ON kr.case_id = kl2.case_id AND kr.lw = kl2.lw)"""
KEYWORDS = BASE.rstrip() + f", {sql_score('sc', 'hits', 'title || chr(32) || snippet || chr(32) || url', 'published')}, {SQL_KEYWORDS} "


def keywords(t):
    terms = I.case_terms(cases(t))
    return I.keyword_discovery(I.score_hits(hits(t), terms), terms)


@query("keyword_discovery", KEYWORDS + "SELECT * FROM kw")
def _(t):
    return keywords(t)


@query("query_templates", with_tables(SQL_COUNTRY_NAMES, SQL_CASES, SQL_TERMS, "tpl AS (" + values_sql(fixed.QUERY_TEMPLATES, "purpose string, template string") + ")") + """
SELECT case_id, purpose, replace(template, '{core}', trim(CASE WHEN len(name_t) <= 3 THEN '"' || name || '"' ELSE name END || ' ' || location || coalesce(' ' || years[1], ''))) AS query, page FROM terms, tpl, (VALUES (1), (2)) AS p(page)""")
def _(t):
    return I.query_templates(I.case_terms(cases(t)))


SQL_PLACES = with_tables(
    SQL_COUNTRY_NAMES, SQL_CASES, SQL_TERMS,
    "cty AS (" + values_sql([(c, lang, site, " OR ".join(f'"{s}"' if " " in s else s for s in sy[:3])) for c, _, lang, site, sy in fixed.COUNTRIES], "country string, lang string, site string, systems string") + ")",
    "lw AS (" + values_sql(fixed.LANGUAGE_WORDS, "lang string, disaster string, warning string, report string, inquiry string") + ")",
    "lh AS (" + values_sql(fixed.LANGUAGE_HAZARDS, "lang string, hazard string, word string") + ")",
    rf"""hz AS (SELECT *, {SQL_PLACE} AS pl, (SELECT arg_min(hazard, ord) FROM ({SQL_HAZARDS}) WHERE regexp_matches(lower(name), '\b' || word)) AS h1, (SELECT arg_min(hazard, ord) FROM ({SQL_HAZARDS}) WHERE regexp_matches(lower(location), '\b' || word)) AS h2 FROM terms),
facts AS (SELECT hz.*, coalesce(h1, h2) AS hazard, CASE WHEN pl = '' THEN name ELSE pl END || coalesce(' ' || years[1], '') AS place, coalesce(' ' || years[1], '') AS yr, cty.lang, site, systems, disaster, warning, report, inquiry,
 coalesce(lh.word, disaster) AS lhz FROM hz LEFT JOIN cty USING (country) LEFT JOIN lw ON lw.lang = cty.lang LEFT JOIN lh ON lh.lang = cty.lang AND lh.hazard = coalesce(h1, h2))""")


@query("localized_queries", SQL_PLACES + """
SELECT case_id, 1 AS ord, 'local: official reports' AS purpose, place || ' ' || coalesce(hazard, 'disaster') || ' report site:' || site AS query FROM facts WHERE country IS NOT NULL
UNION ALL SELECT case_id, 2, 'local: warning systems', place || ' ' || CASE WHEN systems <> '' THEN systems ELSE 'public warning' END FROM facts WHERE country IS NOT NULL
UNION ALL SELECT case_id, 3, 'local language: warning', lhz || ' ' || place || ' ' || warning FROM facts WHERE warning IS NOT NULL
UNION ALL SELECT case_id, 4, 'local language: inquiry / report', lhz || ' ' || place || ' ' || inquiry || ' ' || report FROM facts WHERE warning IS NOT NULL
UNION ALL SELECT case_id, 5, 'local language: official', lhz || ' ' || place || ' ' || warning || ' site:' || site FROM facts WHERE warning IS NOT NULL
UNION ALL SELECT case_id, 6, 'local language: report (PDF)', lhz || ' ' || place || ' ' || report || ' filetype:pdf' FROM facts WHERE warning IS NOT NULL""")
def _(t):
    return I.localized_queries(I.case_terms(cases(t)))


@query("discovery_queries", KEYWORDS.rstrip() + ", " + SQL_PLACES.split("country_names AS", 1)[1].split("\n", 1)[1].split("terms AS", 1)[1].split(" FROM ctry),\n", 1)[1] + """
SELECT case_id, rank AS ord, 'discovered keyword: ' || term AS purpose, term || yr || ' ' || coalesce(warning, 'warning') AS query FROM kw JOIN facts USING (case_id) WHERE rank <= 6
UNION ALL SELECT case_id, 7, 'discovered keyword: ' || term || ' (report)', term || yr || ' ' || coalesce(report, 'after-action report') FROM (SELECT case_id, arg_min(term, rank) AS term FROM kw WHERE anchored GROUP BY case_id) JOIN facts USING (case_id)""")
def _(t):
    return I.discovery_queries(keywords(t), I.case_terms(cases(t)))


@query("expand_aliases")
def _(t):
    return I.expand_aliases(hits(t), I.case_terms(cases(t)))


LINK_URL = ("CASE i WHEN 0 THEN regexp_replace(url, '[?#].*$', '') || '/findings' WHEN 1 THEN 'https://www.fema.gov/' || CAST(page_id AS STRING) || '/review' WHEN 2 THEN 'https://files.example.net/a.PDF' "
            "WHEN 3 THEN 'https://county.tx.us/minutes' WHEN 4 THEN 'https://blog.example.net/timeline' ELSE regexp_replace(url, '[?#].*$', '') || '/about' END")
LINK_TEXT = "CASE i WHEN 0 THEN 'Ahr Valley report' WHEN 1 THEN 'Marshall Fire assessment' WHEN 3 THEN 'testimony' WHEN 5 THEN 'Investigation' ELSE 'more' END"
LINK_PAGE = "CASE page_id % 4 WHEN 3 THEN 'irrelevant' ELSE 'relevant' END"


@query("follow_links", with_tables(SQL_COUNTRY_NAMES, SQL_CASES, SQL_TERMS, SQL_LINKS, f"""links AS (SELECT page_id, page_id % 20 AS case_id, pages.url AS final_url, ord, anchors.url AS link, link_text FROM anchors JOIN pages USING (page_id) WHERE {LINK_PAGE} = 'relevant'
 UNION ALL SELECT page_id, page_id % 20, url, 1000 + i, {LINK_URL}, {LINK_TEXT} FROM pages, (VALUES (0), (1), (2), (3), (4), (5)) AS v(i) WHERE {LINK_PAGE} = 'relevant'),
fit AS (SELECT *, {SQL_HOST.format(c='link')} AS host FROM links WHERE regexp_matches(link || ' ' || link_text, '(?i){fixed.LINK_HINT_PATTERN}')),
ok AS (SELECT * FROM fit WHERE ends_with(host, '.gov') OR ends_with(host, '.us') OR ends_with(host, '.mil') OR host = {SQL_HOST.format(c='final_url')} OR ends_with(lower(link), '.pdf'))""", sql_score('sc', 'ok', "link_text || ' ' || link", years=False)) + """
SELECT page_id, rank, link AS url, sc2 AS score FROM (SELECT *, greatest(score, 0.35) AS sc2, row_number() OVER (PARTITION BY page_id ORDER BY greatest(score, 0.35) DESC, ord) AS rank FROM sc) WHERE rank <= 4""")
def _(t):
    pages = t.raw("pages").select("page_id", (F.col("page_id") % 20).alias("case_id"), F.col("url").alias("final_url"), F.expr(LINK_PAGE).alias("relevance_status"))
    links = t.raw("pages").select("page_id", "url", F.explode(F.array(*[F.lit(i) for i in range(6)])).alias("i")).select(
        "page_id", (F.col("i") + 1000).alias("ord"), F.expr(LINK_URL).alias("url"), F.expr(LINK_TEXT).alias("link_text"))
    links = P.html_links(t.raw("pages")).unionByName(links)  # the pages' own links come first
    return I.follow_links(links, pages, I.case_terms(cases(t)))
