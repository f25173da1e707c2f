"""Queries over pages, duplicates, passages and evidence versions."""

from __future__ import annotations

from pyspark.sql import functions as F

from attesta.functions import fixed_values as fixed
from attesta.functions import text as X
from attesta.operators import dedup as D
from attesta.operators import passages as P
from attesta.session import cut_lineage
from attesta.plans.registry import query, with_tables
from attesta.plans.text_queries import SQL_IS_BOILER, SQL_NORM

HASHED = f"hashed AS (SELECT *, sha256({SQL_NORM.format(c='text')}) AS content_hash FROM src)"
READABLE = "(fetch_status = 'ok' AND trim(text) <> '')"
MARKED = (f"marked AS (SELECT *, CASE WHEN {READABLE} AND first_id < source_id THEN first_id END AS duplicate_of FROM (SELECT *, "
          f"min(source_id) FILTER (WHERE {READABLE}) OVER (PARTITION BY case_id, content_hash) AS first_id FROM hashed))")
SQL_USABLE = "fetch_status = 'ok' AND duplicate_of IS NULL AND NOT excluded AND relevance_status <> 'irrelevant'"


def marked_sources(t):
    """Sources without their text, with content hash and duplicate_of. Texts are read once, for hashes on narrow rows."""
    if t.marked is None:
        narrow = t.sources().select("*", X.content_hash(F.col("text")).alias("content_hash"), (F.trim("text") != "").alias("has_text")).drop("text")
        t.marked = cut_lineage(D.exact_duplicates(cut_lineage(narrow)).drop("has_text"))
    return t.marked


@query("exact_duplicates", with_tables("src", HASHED, MARKED) + "SELECT source_id, duplicate_of FROM marked")
def _(t):
    return marked_sources(t).select("source_id", "duplicate_of")


@query("scan_usable_passages", with_tables("psg", HASHED, MARKED) + f"""
SELECT passage_id, psg.source_id, seq, page, para, psg.text, title, url, source_type FROM psg JOIN marked ON psg.source_id = marked.source_id WHERE {SQL_USABLE}""")
def _(t):
    return P.scan_usable_passages(t.passages(), marked_sources(t)).select(
        "passage_id", "source_id", "seq", "page", "para", "text", "title", "url", "source_type")


@query("included_sources", with_tables("src", HASHED, MARKED) + f"SELECT case_id, source_id, title, url, source_type FROM marked WHERE {SQL_USABLE}")
def _(t):
    return P.usable_sources(marked_sources(t)).select("case_id", "source_id", "title", "url", "source_type")


@query("html_extract")
def _(t):
    return P.html_extract(t.raw("pages"))


# the anchors of the test pages are plain: an absolute path in double quotes and a text without tags
SQL_LINKS = """anchors AS (SELECT page_id, i AS ord, regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]+') || regexp_extract(a, 'href="([^"]*)"', 1), '#.*$', '') AS url, trim(regexp_extract(a, '>([^<]*)<', 1)) AS link_text
 FROM (SELECT page_id, url, unnest(l) AS a, generate_subscripts(l, 1) AS i FROM (SELECT page_id, url, regexp_extract_all(html, '<a href="[^"]*">[^<]*</a>') AS l FROM pages)))"""


@query("html_links", f"WITH {SQL_LINKS} SELECT page_id, ord, url, link_text FROM anchors")
def _(t):
    return P.html_links(t.raw("pages"))


SQL_HITS = ("hits AS (SELECT page_id * 2 + variant AS hit_id, page_id % 20 AS case_id, url || CASE variant WHEN 1 THEN '#part' ELSE '' END AS url, "
            "CAST((page_id * 13 + variant * 7) % 11 AS DOUBLE) / 10 AS identity_score FROM pages, (VALUES (0), (1)) AS v(variant))")


def page_hits(t):
    """Search hits: every page found twice, once with a fragment."""
    two = F.explode(F.array(F.lit(0), F.lit(1))).alias("variant")
    return t.raw("pages").select("page_id", "url", two).select(
        (F.col("page_id") * 2 + F.col("variant")).alias("hit_id"), (F.col("page_id") % 20).alias("case_id"),
        F.concat("url", F.when(F.col("variant") == 1, "#part").otherwise("")).alias("url"),
        (((F.col("page_id") * 13 + F.col("variant") * 7) % 11).cast("double") / 10).alias("identity_score"))


@query("candidate_url_dedup", f"""WITH {SQL_HITS}, known AS (SELECT page_id % 20 AS case_id, regexp_replace(url, '#.*$', '') AS plain_url FROM pages WHERE page_id % 10 = 3)
SELECT case_id, plain_url, arg_min(hit_id, (-identity_score, hit_id)) AS hit_id, max(identity_score) AS identity_score
FROM (SELECT *, regexp_replace(url, '#.*$', '') AS plain_url FROM hits) WHERE (case_id, plain_url) NOT IN (SELECT (case_id, plain_url) FROM known) GROUP BY case_id, plain_url""")
def _(t):
    stored = t.raw("pages").where("page_id % 10 = 3").select(
        (F.col("page_id") % 20).alias("case_id"), "url", X.strip_fragment(F.col("url")).alias("final_url"))
    return D.candidate_url_dedup(page_hits(t), stored)


@query("paragraph_dedup", with_tables("psg") + "SELECT source_id, text, min(seq) AS seq FROM psg GROUP BY source_id, text")
def _(t):
    return D.paragraph_dedup(t.passages().select("source_id", "text", "seq"))


PAGED_TEXT = "CASE WHEN seq % 5 = 1 THEN ' Printed 2021 page ' || CAST(seq AS STRING) ELSE text END"


@query("repeated_line_filter", with_tables("psg") + rf"""
, lines AS (SELECT source_id, seq, (seq - 1) // 5 + 1 AS page, {PAGED_TEXT} AS text FROM psg),
keyed AS (SELECT *, regexp_replace(lower(trim(text)), '\d+', '#', 'g') AS k, FROM lines),
pages_of AS (SELECT source_id, count(DISTINCT page) AS pages FROM keyed GROUP BY source_id),
rep AS (SELECT source_id, k FROM (SELECT source_id, k, count(DISTINCT page) AS n FROM keyed GROUP BY source_id, k) JOIN pages_of USING (source_id)
  WHERE pages >= 3 AND n >= greatest(3, 0.5 * pages) AND length(k) < 200)
SELECT source_id, seq, page, text FROM keyed WHERE NOT EXISTS (SELECT 1 FROM rep WHERE rep.source_id = keyed.source_id AND rep.k = keyed.k)""".replace("\n, lines", ", lines", 1))
def _(t):
    return D.repeated_line_filter(t.passages().select(
        "source_id", "seq", (F.floor((F.col("seq") - 1) / 5) + 1).alias("page"), F.expr(PAGED_TEXT).alias("text")))


# shingles: the checking database has no CRC-32, so it is spelled out from its polynomial
SQL_CRC_TABLE = ("crc_table AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), "
                 "lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crc)")
SQL_SHINGLES = (f"words AS (SELECT case_id, source_id, source_type, content_type, string_split({SQL_NORM.format(c='text')}, ' ') AS w FROM marked "
                "WHERE fetch_status = 'ok' AND duplicate_of IS NULL), "
                "grams AS (SELECT case_id, source_id, source_type, content_type, unnest(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')))) AS g FROM words), "
                "sums AS (SELECT case_id, source_id, source_type, content_type, xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(g)), '..'), "
                "lambda x: ('0x' || x)::BIGINT)), lambda c, x: xor(c >> 8, crc[(xor(c, x) & 255) + 1])), 4294967295) AS h FROM grams, crc_table), "
                "sh AS MATERIALIZED (SELECT DISTINCT case_id, source_id, (CASE source_type WHEN 'aar' THEN 0 WHEN 'government' THEN 1 WHEN 'regulatory' THEN 1 WHEN 'legislative' THEN 2 "
                "WHEN 'academic' THEN 3 WHEN 'ngo_technical' THEN 3 WHEN 'media' THEN 4 ELSE 5 END, CASE WHEN content_type = 'application/pdf' THEN 0 ELSE 1 END, source_id) AS rnk, h "
                "FROM sums WHERE h % 3 = 0), "
                "sizes AS (SELECT source_id, any_value(rnk) AS rnk, count(*) AS n FROM sh GROUP BY source_id)")
SQL_PAIRS = ("pairs AS MATERIALIZED (SELECT x.case_id, x.source_id, y.source_id AS other_id, x.rnk AS ra, y.rnk AS rb, count(*) AS common, any_value(a.n) AS na, any_value(b.n) AS nb "
             "FROM sh x JOIN sh y ON x.case_id = y.case_id AND x.h = y.h AND x.source_id < y.source_id JOIN sizes a ON a.source_id = x.source_id JOIN sizes b ON b.source_id = y.source_id "
             "GROUP BY x.case_id, x.source_id, y.source_id, x.rnk, y.rnk)")
SH = with_tables("src", HASHED, MARKED, SQL_CRC_TABLE, SQL_SHINGLES)


def source_shingles(t):
    first = marked_sources(t).where("fetch_status = 'ok' AND duplicate_of IS NULL")
    return D.shingle_sets(first.join(t.sources().select("source_id", "text"), "source_id"))


@query("shingles", SH + "SELECT source_id, count(*) AS n, CAST(sum(h) AS BIGINT) AS checksum FROM sh GROUP BY source_id")
def _(t):
    return source_shingles(t).where("n > 0").select(
        "source_id", "n", F.aggregate("sh", F.lit(0).cast("long"), lambda a, h: a + h).alias("checksum"))


# classes of sources of a case with equal shingle sets; pairs are told between the smallest ids of two classes
SQL_CLASSES = ("sets AS (SELECT case_id, source_id, list(h ORDER BY h) AS hs FROM sh WHERE case_id IS NOT NULL GROUP BY case_id, source_id), "
               "classes AS MATERIALIZED (SELECT case_id, min(source_id) AS class_id, count(*) AS class_size, list(source_id) AS ids FROM sets GROUP BY case_id, hs)")
SQL_CLASS_PAIRS = ("SELECT source_id, other_id, round({share}, 6) AS {name}, x.class_size * y.class_size AS links, 'classes' AS kind FROM pairs "
                   "JOIN classes x ON x.class_id = source_id JOIN classes y ON y.class_id = other_id WHERE {share} >= {limit} "
                   "UNION ALL SELECT * FROM (SELECT class_id AS source_id, unnest(ids) AS other_id, 1.0::DOUBLE AS {name}, 1::BIGINT AS links, 'member' AS kind FROM classes) WHERE source_id <> other_id")


@query("shingle_classes", SH.rstrip() + f", {SQL_CLASSES} SELECT case_id, unnest(ids) AS source_id, class_id, class_size FROM classes")
def _(t):
    return D.shingle_classes(source_shingles(t))[1].select("case_id", "source_id", F.col("first_id").alias("class_id"), "class_size")


PAIR_LIMIT = 0.2


@query("jaccard_pairs", SH.rstrip() + f", {SQL_PAIRS}, {SQL_CLASSES} " + SQL_CLASS_PAIRS.format(share="common / (na + nb - common)", name="jaccard", limit=PAIR_LIMIT))
def _(t):
    return D.similar_classes(source_shingles(t), PAIR_LIMIT, "jaccard").select("source_id", "other_id", F.round("jaccard", 6).alias("jaccard"), "links", "kind")


@query("containment_pairs", SH.rstrip() + f", {SQL_PAIRS}, {SQL_CLASSES} " + SQL_CLASS_PAIRS.format(share="common / least(na, nb)", name="containment", limit=PAIR_LIMIT))
def _(t):
    return D.similar_classes(source_shingles(t), PAIR_LIMIT).select("source_id", "other_id", F.round("containment", 6).alias("containment"), "links", "kind")


# sources of a case in the order of authority: one is a copy if a better-ranked close source is no copy
@query("near_duplicates", SH.rstrip() + f""", {SQL_PAIRS},
close AS (SELECT case_id, CASE WHEN rb < ra THEN source_id ELSE other_id END AS source_id, CASE WHEN rb < ra THEN other_id ELSE source_id END AS other_id,
  least(ra, rb) AS rb, greatest(ra, rb) AS ra, common / least(na, nb) AS c FROM pairs WHERE common / least(na, nb) >= 0.6),
near AS (SELECT case_id, source_id, ra, list(other_id) AS others FROM close GROUP BY ALL),
folded AS (SELECT case_id, list_reduce(list_prepend({{'s': -1::BIGINT, 'o': []::BIGINT[], 'm': []::BIGINT[]}}, list({{'s': source_id, 'o': others, 'm': []::BIGINT[]}} ORDER BY ra)),
  lambda acc, x: {{'s': -1::BIGINT, 'o': []::BIGINT[], 'm': CASE WHEN len(list_filter(x.o, lambda o: NOT list_contains(acc.m, o))) > 0 THEN list_append(acc.m, x.s) ELSE acc.m END}}).m AS copies FROM near GROUP BY case_id),
copies AS (SELECT case_id, unnest(copies) AS id FROM folded)
SELECT case_id, source_id, arg_min(other_id, (-c, rb)) AS near_duplicate_of, round(max(c), 3) AS similarity FROM close
WHERE source_id IN (SELECT id FROM copies) AND other_id NOT IN (SELECT id FROM copies) GROUP BY case_id, source_id""")
def _(t):
    return D.near_duplicates(source_shingles(t))


CITED = [("ord", 0), ("ord", 1), ("ord", 2)]


@query("citation_dedup", with_tables("res", """cites AS (SELECT id, o AS ord, 'S' || ev_source || CASE WHEN o = 2 AND id % 3 = 0 THEN '-P2' ELSE '-P1' END AS passage_id, quote,
  CASE o WHEN 0 THEN 'supports' ELSE 'alternative' END AS stance FROM res, (VALUES (0), (1), (2)) AS v(o) WHERE ev_source IS NOT NULL)""") + """
SELECT id, passage_id, quote, min(ord) AS ord, arg_min(stance, ord) AS stance FROM cites GROUP BY id, passage_id, quote""")
def _(t):
    three = F.explode(F.array(*[F.lit(i).cast("long") for i in range(3)])).alias("ord")
    cites = t.results().where("ev_source IS NOT NULL").select("id", "ev_source", "quote", three).select(
        "id", "ord", F.concat(F.lit("S"), "ev_source", F.when((F.col("ord") == 2) & (F.col("id") % 3 == 0), "-P2").otherwise("-P1")).alias("passage_id"),
        "quote", F.when(F.col("ord") == 0, "supports").otherwise("alternative").alias("stance"))
    return D.citation_dedup(cites, "id")


@query("make_passages")
def _(t):
    """Documents of several pages: every ten paragraphs start a new page."""
    paragraphs = X.split_paragraphs(F.col("text"))
    page_list = F.transform(
        F.sequence(F.lit(0), F.greatest(F.ceil(F.size("ps") / 10).cast("int") - 1, F.lit(0))),
        lambda i: F.struct((i + 1).cast("long").alias("page"), F.slice("ps", i * 10 + 1, F.lit(10)).alias("paragraphs")))
    docs = t.sources().select("source_id", "text").select("source_id", paragraphs.alias("ps"))
    return P.make_passages(docs.select("source_id", page_list.alias("page_list")))


BOILER_TEXT = "CASE WHEN seq % 9 = 0 THEN text || ' Read more' ELSE text END"


@query("passage_boilerplate_drop", with_tables("psg") + f"""
SELECT passage_id, dropped FROM (SELECT *, CAST(sum(CASE WHEN b THEN 1 ELSE 0 END) OVER (PARTITION BY source_id) AS BIGINT) AS dropped
 FROM (SELECT passage_id, source_id, {SQL_IS_BOILER.format(c='txt')} AS b FROM (SELECT *, {BOILER_TEXT} AS txt FROM psg))) WHERE NOT b""")
def _(t):
    df = t.passages().select("passage_id", "source_id", F.expr(BOILER_TEXT).alias("text"))
    return P.passage_boilerplate_drop(df).select("passage_id", "dropped")


CONFIGURATION = "passages_per_variable=8;max_passages_per_call=40;max_vars_per_call=12;codebook=1"
SQL_SLICES = " || ':' || ".join(f"CAST(sum(('0x' || substr(d, {1 + 12 * i}, 12))::BIGINT) AS VARCHAR)" for i in range(4))
SQL_SNAPSHOT = f"""usable AS (SELECT * FROM marked WHERE {SQL_USABLE}),
items AS (SELECT case_id, 'p' AS kind, sha256(sha256(passage_id) || sha256(text)) AS d FROM psg WHERE source_id IN (SELECT source_id FROM usable)
 UNION ALL SELECT case_id, 's', sha256(source_id || ':' || content_hash || ':' || CAST(excluded AS VARCHAR)) FROM usable),
snap AS (SELECT case_id, substr(sha256({SQL_SLICES} || '|{CONFIGURATION}'), 1, 32) AS fingerprint, count(*) FILTER (kind = 's') AS n_sources, count(*) FILTER (kind = 'p') AS n_passages FROM items GROUP BY case_id)"""


@query("evidence_snapshot", with_tables("psg", HASHED, MARKED, SQL_SNAPSHOT) + "SELECT * FROM snap")
def _(t):
    sources = P.usable_sources(marked_sources(t))
    passages = P.scan_usable_passages(t.passages(), marked_sources(t))
    return P.evidence_snapshot(passages, sources, CONFIGURATION)


@query("analysis_spec", with_tables("runs") + """
SELECT substr(sha256(prompt_version || chr(10) || schema_version_id || chr(10) || model), 1, 32) AS spec_hash, prompt_version, schema_version_id, model, count(*) AS runs
FROM runs GROUP BY prompt_version, schema_version_id, model""")
def _(t):
    return P.analysis_spec(t.runs(), "prompt_version", "schema_version_id", "model")


@query("evidence_hash", with_tables("psg") + """
SELECT source_id, batch, substr(sha256(string_agg(sha256(passage_id) || sha256(text), '' ORDER BY seq)), 1, 24) AS evidence_hash, count(*) AS n
FROM (SELECT *, (seq - 1) // 40 AS batch FROM psg) GROUP BY source_id, batch""")
def _(t):
    df = t.passages().select("source_id", F.floor((F.col("seq") - 1) / 40).alias("batch"), F.col("seq").alias("ord"), "passage_id", "text")
    return P.evidence_hash(df, "source_id", "batch")


VERSION_B_TEXT = "CASE WHEN source_id % 15 = 0 AND seq = 2 THEN text || ' (corrected)' ELSE text END"


@query("snapshot_diff", with_tables("psg", """a AS (SELECT passage_id, sha256(text) AS d FROM psg WHERE source_id % 10 <> 1)""",
                                    f"b AS (SELECT passage_id, sha256({VERSION_B_TEXT}) AS d FROM psg WHERE source_id % 14 <> 2)") + """
SELECT 'passage' AS kind, coalesce(a.passage_id, b.passage_id) AS id, CASE WHEN b.d IS NULL THEN 'only_in_a' WHEN a.d IS NULL THEN 'only_in_b' ELSE 'changed' END AS change
FROM a FULL JOIN b ON a.passage_id = b.passage_id WHERE a.d IS DISTINCT FROM b.d
UNION ALL SELECT 'source', 'S' || doc_id, CASE WHEN doc_id % 10 <> 1 THEN 'only_in_a' ELSE 'only_in_b' END FROM documents WHERE (doc_id % 10 <> 1) <> (doc_id % 14 <> 2)""")
def _(t):
    passages, sources = t.passages(), t.sources().select(F.concat(F.lit("S"), "source_id").alias("id"), "source_id", F.lit("x").alias("d"))
    a = passages.where("source_id % 10 <> 1").select(F.col("passage_id").alias("id"), F.sha2("text", 256).alias("d"))
    b = passages.where("source_id % 14 <> 2").select(F.col("passage_id").alias("id"), F.sha2(F.expr(VERSION_B_TEXT), 256).alias("d"))
    by_passage = P.snapshot_diff(a, b, "id", "d").select(F.lit("passage").alias("kind"), "id", "change")
    by_source = P.snapshot_diff(sources.where("source_id % 10 <> 1"), sources.where("source_id % 14 <> 2"), "id", "d")
    return by_passage.unionByName(by_source.select(F.lit("source").alias("kind"), "id", "change"))
