"""DuckDB SQL of the queries whose method SQL can state plainly: all windows, without fingerprints or anchors."""

OP3 = r"""WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
 b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
 i AS (SELECT item_id, w, least(len(w), 8) AS n FROM b WHERE len(w) > 0),
 iw AS (SELECT DISTINCT item_id, n, array_to_string(w[k:k + n - 1], ' ') AS x FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM i)),
 sizes AS (SELECT DISTINCT n FROM iw),
 dw AS (SELECT doc_id, n, k, array_to_string(w[k:k + n - 1], ' ') AS x FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, sizes WHERE len(w) >= n)),
 hit AS (SELECT doc_id, dw.n, k, item_id FROM dw JOIN iw ON dw.n = iw.n AND dw.x = iw.x),
 words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM (SELECT DISTINCT doc_id, n, k FROM hit)) GROUP BY doc_id),
 ids AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS joined FROM hit GROUP BY doc_id)
 SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(joined, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
 FROM d LEFT JOIN words USING (doc_id) LEFT JOIN ids USING (doc_id)"""
OP5 = r"""WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
 x AS (SELECT doc_id, k, md5(array_to_string(w[k:k + 34], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS k FROM d WHERE len(w) >= 35)),
 twice AS (SELECT h FROM x GROUP BY h HAVING count(*) > 1),
 gone AS (SELECT DISTINCT doc_id, k + j AS p FROM (SELECT doc_id, k, unnest(range(0, 35)) AS j FROM x SEMI JOIN twice USING (h))),
 kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS rest, count(*) AS n FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d) ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
 SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(rest, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)"""
OP6 = r"""WITH d AS (SELECT doc_id, hex(coalesce(text, '')) AS h FROM documents),
 x AS (SELECT doc_id, k, substr(h, 2 * k - 1, 100) AS w FROM (SELECT doc_id, h, unnest(range(1, len(h) // 2 - 48)) AS k FROM d WHERE len(h) >= 100)),
 late AS (SELECT doc_id, k FROM (SELECT doc_id, k, min(doc_id) OVER (PARTITION BY w) AS first FROM x) WHERE doc_id > first),
 parts AS (SELECT doc_id, k, sum(new) OVER (PARTITION BY doc_id ORDER BY k) AS part FROM (SELECT doc_id, k, CASE WHEN k <= lag(k) OVER (PARTITION BY doc_id ORDER BY k) + 50 THEN 0 ELSE 1 END AS new FROM late)),
 spans AS (SELECT doc_id, min(k) AS a, max(k) + 50 AS z FROM parts GROUP BY doc_id, part),
 pieces AS (SELECT doc_id, a, z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 1) AS done FROM spans),
 sums AS (SELECT doc_id, string_agg(substr(h, CAST(2 * done - 1 AS BIGINT), CAST(2 * (a - done) AS BIGINT)), '' ORDER BY a) AS rest, max(z) AS done, sum(z - a) AS gone, count(*) AS n FROM pieces JOIN d USING (doc_id) GROUP BY doc_id)
 SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, CAST(coalesce(n, 0) AS BIGINT) AS n_spans, sha256(unhex(CASE WHEN n IS NULL THEN h ELSE rest || substr(h, CAST(2 * done - 1 AS BIGINT)) END)) AS kept_sha256
 FROM d LEFT JOIN sums USING (doc_id)"""
#: The limits of quality_rules.COVERAGE and LINE_CHARS, in SQL.
OP10 = r"""WITH w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)),
 sizes AS (SELECT unnest([5, 6, 7, 8, 9, 10]) AS n, unnest([0.15, 0.14, 0.13, 0.12, 0.11, 0.10]::DOUBLE[]) AS most),
 g AS (SELECT doc_id, n, k, array_to_string(w[k:k + n - 1], ' ') AS x FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM w, sizes WHERE len(w) >= n)),
 twice AS (SELECT doc_id, n, k FROM (SELECT doc_id, n, k, count(*) OVER (PARTITION BY doc_id, n, x) AS c FROM g) WHERE c > 1),
 words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM w),
 cover AS (SELECT doc_id, n, sum(length(word)) AS chars, count(*) AS words FROM (SELECT DISTINCT doc_id, n, k + j AS p FROM (SELECT doc_id, n, k, unnest(range(0, n)) AS j FROM twice)) JOIN words USING (doc_id, p) GROUP BY doc_id, n),
 m AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols FROM w),
 lines AS (SELECT doc_id, line, i, length(regexp_replace(line, '[\x20\x09-\x0D]+', '', 'g')) AS chars FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line, unnest(range(1, len(string_split(t, chr(10))) + 1)) AS i FROM w) WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
 l AS (SELECT doc_id, count(*) AS n_lines, sum(CASE WHEN again > 1 THEN 1 ELSE 0 END) AS n_dup_lines, sum(CASE WHEN again > 1 THEN chars ELSE 0 END) AS dup_line_chars FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, line ORDER BY i) AS again FROM lines) GROUP BY doc_id),
 c AS (SELECT doc_id, max(CASE WHEN n = 5 THEN words END) AS n_repeat_words, max(chars / CAST(word_chars AS DOUBLE)) AS worst, bool_or(chars / CAST(word_chars AS DOUBLE) > most) AS failed FROM cover JOIN sizes USING (n) JOIN m USING (doc_id) GROUP BY doc_id),
 x AS (SELECT m.*, coalesce(n_repeat_words, 0) AS r, coalesce(worst, 0) AS worst, coalesce(failed, false) AS failed, coalesce(n_lines, 0) AS n_lines, coalesce(n_dup_lines, 0) AS dup, coalesce(dup_line_chars, 0) AS dup_chars FROM m LEFT JOIN c USING (doc_id) LEFT JOIN l USING (doc_id))
 SELECT doc_id, n_words, word_chars, n_symbols, CAST(dup AS BIGINT) AS n_dup_lines, CAST(r AS BIGINT) AS n_repeat_words, n_words < 10 OR 100 * r > 20 * n_words AS base_failed,
 NOT (n_words < 10 OR 100 * r > 20 * n_words OR failed OR dup_chars > 0.2::DOUBLE * word_chars) AS kept, CAST(worst AS DOUBLE) AS worst_coverage, CAST(dup_chars AS BIGINT) AS dup_line_chars, CAST(n_lines AS BIGINT) AS n_lines FROM x"""
