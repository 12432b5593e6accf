"""DuckDB statements of the training-text queries that SQL can express."""

from __future__ import annotations

ORACLE_SQL: dict[str, str] = {}

ORACLE_SQL["op5_ngram_jaccard"] = r"""
WITH RECURSIVE words AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[^\x20\x09-\x0D]+') AS w
    FROM documents
), shingles AS (
    SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s
    FROM words, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS r(i) WHERE len(w) > 0
), sizes AS (
    SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), common AS (
    SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c
    FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2
), links AS (
    SELECT x, y FROM common JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y
    WHERE 100 * c >= 80 * (p.n + q.n - c)
), edges AS (
    SELECT x AS u, y AS v FROM links UNION ALL SELECT y, x FROM links
), reach AS (
    SELECT doc_id AS u, doc_id AS v FROM documents
    UNION
    SELECT r.u, e.v FROM reach r JOIN edges e ON r.v = e.u
)
SELECT d.doc_id, CAST(coalesce(s.n, 0) AS BIGINT) AS n_shingles, m.c AS component_id
FROM documents d LEFT JOIN sizes s USING (doc_id) JOIN (SELECT u, min(v) AS c FROM reach GROUP BY u) m ON m.u = d.doc_id
"""

ORACLE_SQL["op6_url_filters"] = r"""
WITH parsed AS (
    SELECT page_id,
           coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
           coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
    FROM pages
), rules(verdict, rhost, rpath) AS (
    VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'),
           ('block', 'net', '/es/'), ('block', 'net', '/fr/')
), fits AS (
    SELECT page_id, rhost || rpath AS rule, verdict
    FROM parsed JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
), best AS (
    SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict FROM fits GROUP BY page_id
)
SELECT p.page_id, p.host, p.path, b.rule, coalesce(b.verdict, 'allow') AS verdict FROM parsed p LEFT JOIN best b USING (page_id)
"""

ORACLE_SQL["op10_warc"] = """
WITH facts AS (
    SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), owned AS (
    SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS owner FROM facts
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND owner <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND owner <> page_id THEN owner END AS refers_to
FROM owned
"""

ORACLE_SQL["op13_filter_audit"] = r"""
WITH RECURSIVE texts AS (
    SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
           regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
    FROM documents
), firsts AS (
    SELECT text, min(doc_id) AS least FROM texts GROUP BY text
), known AS (
    SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS bad
    FROM labels GROUP BY doc_id
), judged AS (
    SELECT t.part, coalesce(k.good, 0) AS good, coalesce(k.bad, 0) AS bad,
           len(w) < 50 AS a, 100 * len(list_distinct(w)) < 65 * len(w) AS b,
           100 * len(regexp_replace(t.text, '[^A-Z]', '', 'g')) > 5 * len(t.text) AS c,
           regexp_matches(t.text, '[#$%&*|]') AS d, coalesce(t.doc_id > f.least, false) AS e
    FROM texts t JOIN firsts f USING (text) LEFT JOIN known k USING (doc_id)
), masks AS (
    SELECT part, good, bad, a::INT + 2 * b::INT + 4 * c::INT + 8 * d::INT + 16 * e::INT AS mask FROM judged
), cells AS (
    SELECT part, mask, count(*) AS n, sum(good) AS good, sum(bad) AS bad FROM masks GROUP BY part, mask
), letters(letter, bit) AS (
    VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)
), orders AS (
    SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
    FROM letters a, letters b, letters c, letters d, letters e
    WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND a.bit <> b.bit AND a.bit | b.bit | c.bit | d.bit | e.bit = 31
), steps AS (
    SELECT filter_order, s AS step, bits[s] AS bit, coalesce(list_sum(bits[1:s - 1]), 0)::INT AS before
    FROM orders, range(1, 6) AS r(s)
), counted AS (
    SELECT part, filter_order, step, bit,
           coalesce(sum(n) FILTER (mask & (before | bit) = 0), 0) AS kept,
           coalesce(sum(n) FILTER (mask & before = 0 AND mask & bit <> 0), 0) AS removed,
           coalesce(sum(n) FILTER (mask & before <> 0 AND mask & bit <> 0), 0) AS redundant,
           coalesce(sum(n) FILTER (mask = bit), 0) AS unique_fails,
           coalesce(sum(good) FILTER (mask & before = 0 AND mask & bit <> 0), 0) AS good_lost,
           coalesce(sum(bad) FILTER (mask & before = 0 AND mask & bit <> 0), 0) AS toxic_lost
    FROM cells, steps GROUP BY ALL
)
SELECT part, filter_order, CAST(step AS INT) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
       CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
       CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
FROM counted
"""

ORACLE_SQL["op12_quality_rules"] = r"""
WITH texts AS (
    SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text,
           regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
           list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
    FROM documents
), windows AS (
    SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS three FROM texts, unnest(range(1, len(w) - 1)) AS p(i)
), twice AS (
    SELECT r, i FROM windows QUALIFY count(*) OVER (PARTITION BY r, three) > 1
), covered AS (
    SELECT r, count(DISTINCT i + k) AS n FROM twice, range(3) AS s(k) GROUP BY r
), measured AS (
    SELECT t.*, len(w) AS n_words, list_sum(list_transform(w, lambda x: len(x))) AS chars,
           len(regexp_extract_all(text, '[#*$%&|<>]')) AS symbols, len(lines) - len(list_distinct(lines)) AS dups, coalesce(c.n, 0) AS repeats
    FROM texts t LEFT JOIN covered c USING (r)
), held AS (
    SELECT r, source, text, len(w) AS n,
           array_to_string(regexp_extract_all(translate(l, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), ' ') AS line
    FROM texts, unnest(lines) AS u(l)
), hosts AS (
    SELECT source, count(DISTINCT text) AS n FROM texts GROUP BY source
), frequent AS (
    SELECT h.source, line FROM held h JOIN hosts s ON h.source IS NOT DISTINCT FROM s.source
    GROUP BY h.source, line, s.n HAVING count(DISTINCT text) > 10 AND 1000 * count(DISTINCT text) > s.n
), lost AS (
    SELECT r, sum(len(string_split(h.line, ' '))) AS n
    FROM held h JOIN frequent f ON h.line = f.line AND h.source IS NOT DISTINCT FROM f.source GROUP BY r
)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(coalesce(chars, 0) AS BIGINT) AS word_chars, CAST(symbols AS BIGINT) AS n_symbols,
       CAST(dups AS BIGINT) AS n_dup_lines, CAST(repeats AS BIGINT) AS n_repeat_words,
       n_words < 50 OR 100 * repeats > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * repeats > 50 * n_words) AND 2 * (n_words - coalesce(l.n, 0)) >= n_words AS kept,
       CASE WHEN NOT (n_words < 50 OR 100 * repeats > 50 * n_words) THEN CAST(coalesce(l.n, 0) AS BIGINT) END AS n_removed_words
FROM measured LEFT JOIN lost l USING (r)
"""

ORACLE_SQL["op11_merkle_manifest"] = r"""
WITH RECURSIVE texts AS (
    SELECT row_number() OVER () AS r, doc_id, source,
           coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id::VARCHAR, '-') || coalesce(strlen(source) || ':' || source, '-')
           || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars::VARCHAR, '-') AS head,
           text, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS small,
           coalesce(xor(list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::UBIGINT),
               lambda c, b: list_reduce(range(8)::UBIGINT[], lambda y, k: CASE WHEN y & 1 = 1 THEN xor(y >> 1, 3988292384::UBIGINT) ELSE y >> 1 END,
                                 xor(c, b)), 4294967295::UBIGINT), 4294967295::UBIGINT) % 5 = 0, false) AS tampered
    FROM documents
), leaves AS (
    SELECT r, doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
           CASE WHEN tampered THEN sha256(head || coalesce(strlen(small) || ':' || small, '-')) END AS other
    FROM texts
), placed AS (
    SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf, r) - 1 AS place, count(*) OVER (PARTITION BY source) AS n
    FROM leaves
), tree(source, level, i, h, n) AS (
    SELECT source, 0, place, leaf, n FROM placed
    UNION ALL
    SELECT source, level + 1, i // 16, sha256(string_agg(h, '' ORDER BY i)), (n + 15) // 16
    FROM tree WHERE n > 1 GROUP BY source, level, i // 16, n
), roots AS (
    SELECT source, level AS depth, h AS subroot, row_number() OVER (ORDER BY encode(source) NULLS FIRST) - 1 AS place, count(*) OVER () AS n
    FROM tree WHERE n = 1
), top(level, i, h, n) AS (
    SELECT 0, place, subroot, n FROM roots
    UNION ALL
    SELECT level + 1, i // 16, sha256(string_agg(h, '' ORDER BY i)), (n + 15) // 16 FROM top WHERE n > 1 GROUP BY level, i // 16, n
), around AS (
    SELECT a.source, a.level, a.i, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i < a.i), '') AS before,
           coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i > a.i), '') AS behind
    FROM tree a JOIN tree b ON a.source IS NOT DISTINCT FROM b.source AND a.level = b.level AND a.i // 16 = b.i // 16
    WHERE a.n > 1 GROUP BY a.source, a.level, a.i
), around_top AS (
    SELECT a.level, a.i, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i < a.i), '') AS before,
           coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i > a.i), '') AS behind
    FROM top a JOIN top b ON a.level = b.level AND a.i // 16 = b.i // 16 WHERE a.n > 1 GROUP BY a.level, a.i
), steps AS (
    SELECT p.r, a.level AS step, a.before, a.behind
    FROM placed p JOIN around a ON a.source IS NOT DISTINCT FROM p.source AND a.i = p.place // (16 ** a.level)::BIGINT
    UNION ALL
    SELECT p.r, s.depth + t.level, t.before, t.behind
    FROM placed p JOIN roots s ON s.source IS NOT DISTINCT FROM p.source JOIN around_top t ON t.i = s.place // (16 ** t.level)::BIGINT
), fold(r, step, h) AS (
    SELECT r, 0, coalesce(other, leaf) FROM placed
    UNION ALL
    SELECT f.r, f.step + 1, sha256(s.before || f.h || s.behind) FROM fold f JOIN steps s ON s.r = f.r AND s.step = f.step
), folded AS (
    SELECT r, arg_max(h, step) AS h FROM fold GROUP BY r
), proofs AS (
    SELECT r, string_agg(before || behind, '' ORDER BY step) AS p FROM steps GROUP BY r
)
SELECT p.doc_id, p.leaf, s.subroot, t.h AS root, sha256(coalesce(q.p, '')) AS proof_sha256, f.h AS folded_root, f.h = t.h AS verified
FROM placed p JOIN roots s ON s.source IS NOT DISTINCT FROM p.source JOIN folded f ON f.r = p.r LEFT JOIN proofs q ON q.r = p.r
JOIN top t ON t.n = 1
"""
