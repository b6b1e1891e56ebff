"""DuckDB SQL for the operator queries that SQL can express.

Hashes of the operators stand for texts, lines and windows; the SQL compares the
strings themselves.
"""

from __future__ import annotations

_BLANK = r"[\x20\x09-\x0D]+"
_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1 = rf"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(source, '') AS host, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
 win AS (SELECT doc_id, i, w[i:i + 4] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)),
 twice AS (SELECT doc_id, g FROM win GROUP BY ALL HAVING count(*) > 1),
 rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM win JOIN twice USING (doc_id, g)) GROUP BY 1),
 ln AS (SELECT doc_id, x FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x FROM d) WHERE regexp_matches(x, '[^\x20\x09-\x0D]')),
 dup AS (SELECT doc_id, count(*) - count(DISTINCT x) AS n FROM ln GROUP BY 1),
 base AS (SELECT doc_id, host, text, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
  CAST(length(text) - length(translate(text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols, coalesce(dup.n, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words
  FROM d LEFT JOIN dup USING (doc_id) LEFT JOIN rep USING (doc_id)),
 line AS (SELECT DISTINCT host, text, z FROM (SELECT host, text, trim(regexp_replace(unnest(string_split(lower(text), chr(10))), '[ \t\x0b\f\r]+', ' ', 'g')) AS z FROM d) WHERE z <> ''),
 wide AS (SELECT host, count(DISTINCT text) AS texts FROM d GROUP BY 1),
 above AS (SELECT host, z FROM (SELECT host, z, count(*) AS n FROM line GROUP BY ALL) JOIN wide USING (host) WHERE n > 20 AND (n * 1000 > texts * 5 OR length(z) - length(replace(z, ' ', '')) + 1 >= 10)),
 sized AS (SELECT line.*, length(z) - length(replace(z, ' ', '')) + 1 AS words, above.z IS NOT NULL AS bad FROM line LEFT JOIN above USING (host, z)),
 cut AS (SELECT host, text, CAST(sum(words) AS BIGINT) AS line_words, CAST(coalesce(sum(words) FILTER (bad), 0) AS BIGINT) AS removed FROM sized GROUP BY ALL)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
 NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND NOT (coalesce(removed, 0) > 0 AND (line_words - removed < 10 OR (line_words - removed) * 3 < line_words)) AS kept,
 coalesce(removed, 0) AS removed_words FROM base LEFT JOIN cut USING (host, text)"""

OP2 = """WITH p AS (SELECT page_id, coalesce(html, '') AS h, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
 f AS (SELECT h, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY 1)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, sha256(h) AS payload_digest, CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
 CASE WHEN first <> page_id THEN first END AS refers_to FROM p LEFT JOIN f USING (h)"""

OP7 = rf"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_ALNUM}') AS w FROM documents),
 s AS (SELECT DISTINCT doc_id, w[i:i + 4] AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)),
 n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
 hit AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
 link AS (SELECT a, b, k = x.n AND k = y.n AS equal FROM hit JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 5 * k >= 4 * (x.n + y.n - k)),
 reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN link l ON l.a = r.b),
 cls AS (SELECT a AS doc_id, min(b) AS class_id FROM reach GROUP BY 1),
 cpy AS (SELECT c.doc_id, least(c.doc_id, coalesce(min(b) FILTER (equal), c.doc_id)) AS copy_id, count(b) AS n_links FROM documents c LEFT JOIN link ON a = c.doc_id GROUP BY 1),
 oth AS (SELECT a AS doc_id, count(DISTINCT copy_id) AS n FROM link JOIN cpy ON cpy.doc_id = b WHERE NOT equal GROUP BY 1)
SELECT doc_id, class_id, copy_id, n_links, coalesce(oth.n, 0) AS n_text_links FROM cls JOIN cpy USING (doc_id) LEFT JOIN oth USING (doc_id)"""

OP9 = rf"""WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_ALNUM}') AS w FROM documents),
 b AS (SELECT item_id, regexp_extract_all({_LOWER}, '{_ALNUM}') AS w FROM benchmark),
 iw AS (SELECT DISTINCT item_id, w[i:i + m - 1] AS g, m FROM (SELECT item_id, w, least(len(w), 13) AS m, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS i FROM b WHERE len(w) > 0)),
 ms AS (SELECT DISTINCT m FROM iw),
 dw AS (SELECT doc_id, i, m, w[i:i + m - 1] AS g FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, ms WHERE len(w) >= m)),
 hit AS (SELECT doc_id, i, m, item_id FROM dw JOIN iw USING (g, m)),
 cov AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM (SELECT DISTINCT doc_id, i, m FROM hit)) GROUP BY 1),
 its AS (SELECT doc_id, count(*) AS n, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM hit) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(cov.n, 0) AS n_hit, coalesce(its.n, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
 coalesce(cov.n, 0) > 0 AND 20 * coalesce(cov.n, 0) >= len(w) AS contaminated FROM d LEFT JOIN cov USING (doc_id) LEFT JOIN its USING (doc_id)"""

ORACLES: dict[str, str] = {"op1_quality_rules": OP1, "op2_warc_normaliser": OP2, "op7_chosen_path_join": OP7, "op9_winnowing": OP9}
