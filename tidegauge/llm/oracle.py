"""DuckDB statements for the operators that SQL can express."""

from __future__ import annotations

LINE_QUALITY = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, source, t, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM d),
win AS (SELECT doc_id, unnest(range(1, len(ws) - 6)) AS i, ws FROM w WHERE len(ws) >= 8),
keyed AS (SELECT doc_id, i, array_to_string(ws[i:i + 7], ' ') AS k FROM win),
again AS (SELECT doc_id, i FROM keyed QUALIFY count(*) OVER (PARTITION BY doc_id, k) > 1),
repeated AS (SELECT doc_id, count(*) AS n FROM
  (SELECT DISTINCT doc_id, i + j AS p FROM again, unnest(range(0, 8)) AS r(j)) GROUP BY doc_id),
plain AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
tidy AS (SELECT doc_id, source, substr(md5(t), 1, 16) AS th,
  list_filter(list_transform(string_split(regexp_replace(lower(t), '[\x20\x09\x0B-\x0D]+', ' ', 'g'), chr(10)), lambda x: trim(x, ' ')),
              lambda x: x <> '') AS ls FROM d),
lines AS (SELECT doc_id, source, th, unnest(ls) AS line FROM tidy),
freq AS (SELECT source, line, count(DISTINCT th) AS n, min(th) AS first FROM lines GROUP BY source, line HAVING count(DISTINCT th) > 10),
hosts AS (SELECT source, count(DISTINCT th) AS n FROM tidy GROUP BY source),
often AS (SELECT f.source, f.line, f.first FROM freq f JOIN hosts h ON f.source IS NOT DISTINCT FROM h.source 
  WHERE f.n > least(100, greatest(10, 0.01 * h.n))),
removed AS (SELECT l.doc_id, sum(len(string_split(l.line, ' '))) AS n FROM lines l JOIN often o
  ON l.source IS NOT DISTINCT FROM o.source AND l.line = o.line AND l.th <> o.first GROUP BY l.doc_id),
m AS (SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words,
  CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
  CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(p.ls) - len(list_distinct(p.ls)) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(x.n, 0) AS BIGINT) AS n_removed_words
  FROM w JOIN plain p USING (doc_id) LEFT JOIN repeated r USING (doc_id) LEFT JOIN removed x USING (doc_id))
SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND n_words - n_removed_words >= 0.3 * n_words AS kept FROM m
"""

EXACT_GROUPS = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
  doc_id = min(doc_id) OVER g AS kept, sha256(t) AS text_sha256 FROM n WINDOW g AS (PARTITION BY t)
"""

# Base-32 letters of a SHA-1, eight from each ten hexadecimal digits.
WARC = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h) AS n, sha1(h) AS s, h FROM p),
k AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(
    (CAST('0x' || substr(s, CAST(i // 8 * 10 + 1 AS BIGINT), 10) AS BIGINT) >> CAST(35 - i % 8 * 5 AS BIGINT)) & 31 AS BIGINT) + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to FROM k
"""

LINE_DEDUP = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT r, doc_id, i, ls[i] AS line FROM d, unnest(range(1, len(ls) + 1)) AS x(i)),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key, count(DISTINCT doc_id) AS n, max(doc_id) AS keeper FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT k.*, f.n, coalesce(f.keeper <> doc_id, false) AS gone FROM k LEFT JOIN f USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, coalesce(max(n), 0) AS most_docs,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM m GROUP BY r, doc_id
"""

FILL_IN_MIDDLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS s FROM documents),
h AS (SELECT *, length(t) AS n, CAST('0x' || substr(s, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(s, 9, 8) AS BIGINT) AS h2,
  CAST('0x' || substr(s, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(s, 25, 8) AS BIGINT) AS h4 FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
       WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, substr(t, 1, a) AS x, substr(t, a + 1, b - a) AS y, substr(t, b + 1) AS z FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || x || '<S>' || z || '<M>' || y ELSE '<S>' || z || '<P>' || x || '<M>' || y END) AS output_sha256,
  sha256(CASE form WHEN 'plain' THEN t ELSE x || y || z END) AS restored_sha256 FROM p
"""


def vector_codes(rounds: int = 4) -> str:
    """The rounds as one common table expression after another; sums and products are whole numbers below 2^53."""
    steps = [r"""WITH v AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label,
      list_transform(embedding, lambda x: floor(CAST(x AS DOUBLE) * 1024)) AS x FROM embeddings
      WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    p AS MATERIALIZED (SELECT r, part, x[part * (len(x) // 4) + 1 : (part + 1) * (len(x) // 4)] AS x FROM v, range(0, 4) AS g(part)),
    b0 AS MATERIALIZED (SELECT part, r - 1 AS entry, x FROM p WHERE r <= 256)"""]
    for k in range(rounds + 1):
        steps.append(f"""a{k} AS MATERIALIZED (SELECT r, p.part, any_value(p.x) AS x,
      min(CAST(list_dot_product(p.x, p.x) + list_dot_product(b.x, b.x) - 2 * list_dot_product(p.x, b.x) AS BIGINT) * 256 + entry) AS best
      FROM p JOIN b{k} b ON p.part = b.part GROUP BY r, p.part)""")
        if k < rounds:
            steps.append(f"""s{k} AS (SELECT part, best % 256 AS entry, i, floor(sum(CAST(x[i] AS HUGEINT)) / count(*)) AS m
      FROM a{k}, unnest(range(1, len(x) + 1)) AS g(i) GROUP BY ALL),
    b{k + 1} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(any_value(n.x), any_value(b.x)) AS x FROM b{k} b
      LEFT JOIN (SELECT part, entry, list(m ORDER BY i) AS x FROM s{k} GROUP BY part, entry) n USING (part, entry) GROUP BY b.part, b.entry)""")
    steps.append(f"""e AS (SELECT r, string_agg(printf('%02x', best % 256), '' ORDER BY part) AS code, CAST(sum(best // 256) AS BIGINT) AS error FROM a{rounds} GROUP BY r),
    h AS (SELECT sha256(string_agg(array_to_string(list_transform(x, lambda y: CAST(CAST(y AS BIGINT) AS VARCHAR)), ','), ',' ORDER BY part, entry)) AS s FROM b{rounds})
    SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, s AS codebooks_sha256 FROM v JOIN e USING (r), h""")
    return ",\n".join(steps[:-1]) + ",\n" + steps[-1]
