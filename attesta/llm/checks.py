"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

# words [^\x20\x09-\x0D]+ of the text, as a list
_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

EXACT = r"""
WITH plain AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS plain FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY plain) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept, sha256(plain) AS text_sha256
FROM plain WINDOW w AS (PARTITION BY plain ORDER BY n DESC, doc_id)
"""

MIXING = rf"""
WITH sized AS (
  SELECT doc_id, source, CAST(len({_WORDS}) AS BIGINT) AS size FROM documents),
keyed AS (SELECT *, md5(concat_ws('-', 2024, doc_id, size)) AS shuffle_key FROM sized),
sources AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
ranked AS (
  SELECT *, row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1 AS source_rank FROM sources),
weighed AS (SELECT *, ([5, 2, 1])[CAST(source_rank % 3 AS INTEGER) + 1] AS weight, 2 * source_size AS cap FROM ranked),
filled AS (
  SELECT *, sum(source_size) OVER () * 150 / 100.0 AS budget,
         (sum(source_size) OVER () * 150 / 100.0 - coalesce(sum(cap) OVER before, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level
  FROM weighed WINDOW before AS (ORDER BY cap / weight, source_rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
open_level AS (SELECT level FROM filled WHERE cap / weight > level ORDER BY cap / weight, source_rank LIMIT 1),
plan AS (
  SELECT source, source_rank, source_size, weight, budget,
         CASE WHEN cap / weight <= level THEN CAST(cap AS DOUBLE) ELSE weight * (SELECT level FROM open_level) END AS target FROM filled),
queued AS (
  SELECT k.doc_id, k.size, p.source_rank, p.source_size, p.weight, p.budget,
         sum(k.size) OVER (PARTITION BY p.source_rank ORDER BY k.shuffle_key, k.doc_id ROWS UNBOUNDED PRECEDING) AS served
  FROM keyed k JOIN plan p ON k.source IS NOT DISTINCT FROM p.source WHERE k.size > 0),
turns AS (
  SELECT *, (served + epoch * source_size) / weight AS finish FROM queued, (VALUES (0), (1)) AS e(epoch)),
merged AS (
  SELECT *, sum(size) OVER (ORDER BY finish, source_rank, epoch, doc_id ROWS UNBOUNDED PRECEDING) AS position FROM turns),
used AS (SELECT doc_id, sum(size) AS taken FROM merged WHERE position - size / 2.0 <= budget GROUP BY doc_id)
SELECT s.doc_id, s.size, p.source_size, p.target, CAST(coalesce(u.taken, 0) AS BIGINT) AS taken
FROM sized s JOIN plan p ON s.source IS NOT DISTINCT FROM p.source LEFT JOIN used u ON u.doc_id = s.doc_id
"""

QUALITY = rf"""
WITH texts AS (SELECT doc_id, source, coalesce(text, '') AS text, {_WORDS} AS words FROM documents),
triples AS (
  SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS triple
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM texts)),
twice AS (SELECT doc_id, i FROM triples QUALIFY count(*) OVER (PARTITION BY doc_id, triple) > 1),
repeated AS (SELECT doc_id, count(DISTINCT i + step) AS n FROM twice, (VALUES (0), (1), (2)) AS s(step) GROUP BY doc_id),
base AS (
  SELECT t.doc_id, t.source, CAST(len(words) AS BIGINT) AS n_words,
         CAST(coalesce(list_sum(list_transform(words, lambda w: length(w))), 0) AS BIGINT) AS word_chars,
         CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
         CAST(len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))
              - len(list_distinct(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))) AS BIGINT) AS n_dup_lines,
         coalesce(r.n, 0) AS n_repeat_words
  FROM texts t LEFT JOIN repeated r ON r.doc_id = t.doc_id),
judged AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM base),
hosts AS (SELECT source, count(*) AS n, count(*) FILTER (base_failed) AS k FROM judged GROUP BY source),
corpus AS (SELECT sum(k) / sum(n) AS m, sum(k * k / n) / sum(n) AS squares, count(*) / sum(n) AS hosts_per_row FROM hosts),
prior AS (
  SELECT m, greatest(m * (1 - m) / CASE WHEN v > 0 THEN v ELSE 1 END - 1, 1) AS s
  FROM (SELECT m, greatest(squares - m * m - m * (1 - m) * hosts_per_row, m * (1 - m) * 1e-4) AS v FROM corpus)),
verdicts AS (SELECT source, (k + m * s) / (n + s) > 0.6 AS host_failed FROM hosts, prior)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT host_failed AS kept
FROM judged j JOIN verdicts v ON j.source IS NOT DISTINCT FROM v.source
"""

_BASE32 = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'"
WARC = rf"""
WITH digests AS (
  SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages),
named AS (
  SELECT *, array_to_string(list_transform(range(0, 32), lambda i: substr({_BASE32},
    CAST((CAST('0x' || substr(hex, CAST(i // 4 * 5 + 1 AS BIGINT), 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31 AS BIGINT) + 1, 1)), '') AS payload_digest FROM digests)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = max(page_id) OVER w THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id < max(page_id) OVER w THEN max(page_id) OVER w END AS refers_to
FROM named WINDOW w AS (PARTITION BY payload_digest)
"""

_NUMBER = "CAST('0x' || substr(md5({}), 1, 7) AS BIGINT)"
_HOST = r"lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*?)\.?(?::\d*)?(?:[/?#]|$)', 1))"
_PATH = r"regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*(/[^?#]*)', 1)"
URLS = rf"""
WITH seen AS (
  SELECT page_id, {_HOST} AS host, {_PATH} AS path, 1704067200 + {_NUMBER.format("page_id || '|fetch'")} % 31622400 AS fetched_at FROM pages),
labelled AS (
  SELECT *, string_split(host, '.') AS labels, list_filter(string_split(path, '/'), lambda x: x <> '') AS parts,
         regexp_extract(path, '^/([^/]+)', 1) AS part FROM seen),
listed AS (
  SELECT DISTINCT pattern FROM (
    SELECT unnest([host, array_to_string(labels[greatest(len(labels) - 1, 1):], '.'), CASE WHEN part <> '' THEN host || '/' || part END]) AS pattern
    FROM labelled WHERE host <> '') WHERE pattern IS NOT NULL),
entries AS (
  SELECT lower(split_part(pattern, '/', 1)) || substr(pattern, length(split_part(pattern, '/', 1)) + 1) AS pattern, 1704067200 + {_NUMBER.format("pattern || '|' || turn")} % 31622400 AS listed_at,
         CASE WHEN {_NUMBER.format("pattern || '|' || turn || '|action'")} % 3 = 0 THEN 'block' ELSE 'allow' END AS action,
         'list' || {_NUMBER.format("pattern || '|category'")} % 5 AS category
  FROM listed, (VALUES (1), (2), (3)) AS t(turn)),
newest AS (SELECT * FROM entries QUALIFY row_number() OVER (PARTITION BY pattern, listed_at ORDER BY action DESC, category DESC) = 1),
asked AS (
  SELECT page_id, host, fetched_at, 1000 - len(parts[1:i]) AS rank, host || '/' || array_to_string(parts[1:i], '/') AS pattern
  FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS i FROM labelled WHERE host <> '')
  UNION ALL
  SELECT page_id, host, fetched_at, 1000 + i, array_to_string(labels[i:], '.')
  FROM (SELECT *, unnest(range(1, len(labels) + 1)) AS i FROM labelled WHERE host <> '')),
met AS (
  SELECT a.page_id, a.rank, a.pattern, e.action, e.category
  FROM asked a ASOF JOIN newest e ON a.pattern = e.pattern AND a.fetched_at >= e.listed_at),
chosen AS (SELECT * FROM met QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY rank) = 1)
SELECT s.page_id, s.host, s.fetched_at, c.pattern, c.action, c.category, coalesce(c.action = 'block', false) AS blocked
FROM seen s LEFT JOIN chosen c ON s.page_id = c.page_id
"""

NGRAMS = rf"""
WITH RECURSIVE texts AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
grams AS (
  SELECT DISTINCT doc_id, g FROM (SELECT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM texts)),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
in_both AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS o FROM grams x JOIN grams y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM in_both JOIN sizes s ON s.doc_id = a JOIN sizes t ON t.doc_id = b WHERE 100 * o >= 75 * (s.n + t.n - o)),
ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS root, doc_id FROM documents UNION SELECT r.root, w.b FROM reach r JOIN ways w ON w.a = r.doc_id)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, min(r.root) AS component_id
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id JOIN reach r ON r.doc_id = d.doc_id GROUP BY ALL
"""

FILL_MIDDLE = r"""
WITH rows AS (
  SELECT doc_id, coalesce(text, '') AS text, CAST(length(coalesce(text, '')) AS BIGINT) AS n, sha256(concat('1:', doc_id)) AS hex FROM documents),
hashed AS (
  SELECT *, CAST('0x' || substr(hex, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(hex, 9, 8) AS BIGINT) AS h2,
         CAST('0x' || substr(hex, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(hex, 25, 8) AS BIGINT) AS h4 FROM rows),
cuts AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain'
              WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM hashed),
parts AS (SELECT *, substring(text, 1, a) AS pre, substring(text, a + 1, b - a) AS mid, substring(text, b + 1) AS suf FROM cuts)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
                        ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM parts
"""

SEARCH = r"""
WITH docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
whole AS (SELECT CAST(count(*) AS BIGINT) AS big_n, CAST(sum(len(terms)) AS BIGINT) AS big_l FROM docs WHERE len(terms) > 0),
asked AS (
  SELECT item_id, unnest(list_distinct(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                       '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))) AS term FROM benchmark),
held AS (
  SELECT doc_id, term, CAST(any_value(n) AS BIGINT) AS n, CAST(count(*) AS BIGINT) AS tf
  FROM (SELECT doc_id, len(terms) AS n, unnest(terms) AS term FROM docs) GROUP BY doc_id, term),
rated AS (
  SELECT term, CAST(floor(1000 * ln((2 * any_value(big_n) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM held, whole GROUP BY term),
scored AS (
  SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * big_n) // big_l)))) AS BIGINT) AS score
  FROM asked JOIN held USING (term) JOIN rated USING (term), whole GROUP BY item_id, doc_id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM scored WHERE score > 0 QUALIFY rank <= 50
"""

SQL = {
    "op1_ngram_join": NGRAMS,
    "op2_quality_rules": QUALITY, "op3_warc_transactions": WARC, "op5_exact_dedup": EXACT, "op7_url_filters": URLS,
    "op9_source_mixing": MIXING, "op12_fill_in_middle": FILL_MIDDLE, "op13_ranked_search": SEARCH,
}
