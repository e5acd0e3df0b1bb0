"""DuckDB SQL for the queries that SQL can express, over whole tables."""

from .url_filter import LISTED, RULES

_VALUES = lambda rows: ", ".join(str(r) for r in rows)

URL_FILTER = f"""
WITH rules(verdict, host, path) AS (VALUES {_VALUES(RULES)}), listed(verdict, host, path) AS (VALUES {_VALUES(LISTED)}),
rests AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
parts AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw_host FROM rests),
urls AS (SELECT page_id, coalesce(translate(raw_host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host, coalesce(regexp_extract(substr(rest, length(raw_host) + 1), '^[^?#]*'), '') AS path FROM parts),
distinct_urls AS (SELECT DISTINCT host, path FROM urls),
ruled AS (SELECT u.host, u.path, arg_max(r.host || r.path, (length(r.host || r.path), length(r.host))) AS rule, arg_max(r.verdict, (length(r.host || r.path), length(r.host))) AS verdict
  FROM distinct_urls u JOIN rules r ON (u.host = r.host OR ends_with(u.host, '.' || r.host)) AND starts_with(u.path, r.path) GROUP BY ALL),
hit AS (SELECT u.host, u.path, arg_max(r.host || r.path, (length(r.host || r.path), length(r.host))) AS entry, arg_max(r.verdict, (length(r.host || r.path), length(r.host))) AS verdict
  FROM distinct_urls u JOIN listed r ON (u.host = r.host OR ends_with(u.host, '.' || r.host)) AND starts_with(CASE WHEN u.path = '' THEN '/' ELSE u.path END, r.path) GROUP BY ALL)
SELECT u.page_id, u.host, u.path, ruled.rule, coalesce(ruled.verdict, hit.verdict, 'allow') AS verdict, hit.entry AS listed
FROM urls u LEFT JOIN ruled USING (host, path) LEFT JOIN hit USING (host, path)
"""

LINE_DEDUP = r"""
WITH occurrences AS (
  SELECT doc_id, i AS pos, string_split(text, chr(10))[i] AS line FROM (SELECT doc_id, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)),
worded AS (SELECT doc_id, pos, lower(line) AS line, row_number() OVER (PARTITION BY lower(line) ORDER BY doc_id, pos) AS nth FROM occurrences WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
lines AS (SELECT doc_id, pos, list_distinct(list_filter(regexp_split_to_array(line, '[\x20\x09-\x0D]+'), lambda w: w <> '')) AS words FROM worded WHERE nth = 1),
tokens AS (SELECT doc_id, pos, len(words) AS n, unnest(words) AS word FROM lines),
counted AS (SELECT word, count(*) AS df FROM tokens GROUP BY word),
ranked AS (SELECT doc_id, pos, n, word, row_number() OVER (PARTITION BY doc_id, pos ORDER BY df, word) AS nth FROM tokens JOIN counted USING (word)),
prefixes AS (SELECT * FROM ranked WHERE nth <= n - (n * 80 + 99) // 100 + 1),
pairs AS (SELECT DISTINCT a.doc_id, a.pos, b.doc_id AS b_doc, b.pos AS b_pos FROM prefixes a JOIN prefixes b ON a.word = b.word AND (b.doc_id, b.pos) < (a.doc_id, a.pos) AND b.n * 100 >= a.n * 80 AND a.n * 100 >= b.n * 80),
shared AS (SELECT p.doc_id, p.pos, len(list_intersect(x.words, y.words)) AS common, len(x.words) AS n, len(y.words) AS m FROM pairs p JOIN lines x ON p.doc_id = x.doc_id AND p.pos = x.pos JOIN lines y ON p.b_doc = y.doc_id AND p.b_pos = y.pos),
gone AS (SELECT doc_id, pos FROM shared WHERE common * 100 >= (n + m - common) * 80 UNION SELECT doc_id, pos FROM worded WHERE nth > 1)
SELECT o.doc_id, count(*) AS n_lines, count(g.doc_id) AS n_removed, coalesce(string_agg(o.line, chr(10) ORDER BY o.pos) FILTER (g.doc_id IS NULL), '') AS text
FROM occurrences o LEFT JOIN gone g ON o.doc_id = g.doc_id AND o.pos = g.pos GROUP BY o.doc_id
"""

DECONTAMINATE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark),
phrases AS (SELECT DISTINCT item_id, least(10, len(words)) AS size, array_to_string(words[i:i + least(10, len(words)) - 1], ' ') AS phrase FROM (SELECT item_id, words, unnest(range(1, len(words) - least(10, len(words)) + 2)) AS i FROM b WHERE len(words) > 0)),
sizes AS (SELECT DISTINCT size FROM phrases),
windows AS (SELECT doc_id, size, i, array_to_string(words[i:i + size - 1], ' ') AS phrase FROM (SELECT doc_id, words, size, unnest(range(1, len(words) - size + 2)) AS i FROM d, sizes WHERE len(words) >= size)),
hits AS (SELECT w.doc_id, w.i, w.size, p.item_id FROM windows w JOIN phrases p ON w.phrase = p.phrase AND w.size = p.size),
covered AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS k FROM hits) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(d.words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
"""

WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
firsts AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest, CASE WHEN page_id <> first THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM p LEFT JOIN firsts USING (payload_digest)
"""

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

DIVERGENCE = rf"""
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, {_LOWER.format("coalesce(text, '')")} AS text, row_number() OVER () AS r FROM documents),
t AS (SELECT lang, source, r, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 10),
v AS (SELECT lang, count(*) AS v, sum(n) AS n FROM kept GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term),
s AS (SELECT lang, source, sum(n) AS n FROM c GROUP BY lang, source),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 2) // (coalesce(s.n, 0) + 2 * v.v) AS p, 1 + 1000000000::HUGEINT * (k.n + 2) // (v.n + 2 * v.v) AS q
  FROM g JOIN kept k ON g.lang = k.lang JOIN v ON g.lang = v.lang LEFT JOIN s ON s.lang = g.lang AND s.source = g.source LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
listed AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(pairs.value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source
  UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q) // (p + q))::BIGINT FROM p WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM listed)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""

RULES_LEDGER = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, doc_id, text, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
windows AS (SELECT r, i, array_to_string(words[i:i + 4], ' ') AS gram FROM (SELECT r, words, unnest(range(1, len(words) - 3)) AS i FROM w)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, gram) AS n FROM windows) WHERE n > 1),
repeated AS (SELECT r, count(DISTINCT i + k) AS n FROM (SELECT r, i, unnest(range(0, 5)) AS k FROM twice) GROUP BY r),
m AS (SELECT doc_id, len(words) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
    coalesce(n, 0) AS n_repeat_words, length(regexp_replace(text, '[^A-Za-z\x{80}-\x{10FFFF}]', '', 'g')) AS n_letters, length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_capitals, length(regexp_replace(text, '[^a-z]', '', 'g')) AS n_small, length(regexp_replace(text, '[^0-9]', '', 'g')) AS n_digits, length(regexp_replace(text, '[^!]', '', 'g')) AS n_exclamations,
    len(list_filter(words, lambda x: regexp_matches(x, '[A-Za-z\x{80}-\x{10FFFF}]'))) AS n_lettered, len(list_filter(lines, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[-*•]'))) AS n_bullets, len(list_filter(lines, lambda x: regexp_matches(x, '([.][.][.]|…)[\x20\x09-\x0D]*$'))) AS n_ellipses
  FROM w LEFT JOIN repeated USING (r)),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT (base_failed OR n_symbols * 10 > n_words OR n_dup_lines * 10 > n_lines * 3 OR word_chars < n_words * 2 OR word_chars > n_words * 12 OR n_letters * 10 < word_chars * 6 OR n_capitals > n_small
  OR n_digits * 4 > word_chars OR n_exclamations * 2 > n_words OR n_lettered * 10 < n_words * 8 OR n_bullets * 10 > n_lines * 9 OR n_ellipses * 10 > n_lines * 3) AS kept FROM f
"""

ORACLE_SQL = {"op12_divergence": DIVERGENCE, "op13_rules": RULES_LEDGER, "op2_url_filter": URL_FILTER, "op6_line_dedup": LINE_DEDUP, "op7_decontaminate": DECONTAMINATE, "op10_warc": WARC}
