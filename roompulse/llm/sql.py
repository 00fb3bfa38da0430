"""The queries that SQL can express, for DuckDB."""

SQL = {}

SQL["op4_exact_dedup"] = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))"""

SQL["op6_quality_rules"] = r"""
WITH lines AS (
  SELECT doc_id, coalesce(text, '') AS body,
         list_filter(string_split_regex(coalesce(text, ''), '[ \t-\r]+'), lambda w: w <> '') AS ws,
         string_split(coalesce(text, ''), chr(10)) AS ls
  FROM documents),
marked AS (
  SELECT *, list_filter(ls, lambda l: regexp_matches(l, '[^ \t-\r]')) AS full_lines,
    list_filter(ls, lambda l:
      NOT regexp_matches(lower(regexp_replace(l, '^[ \t-\r]+|[ \t-\r]+$', '', 'g')),
        '(all rights reserved|copyright|\(c\) [12][0-9]{3}|terms of (use|service)|privacy policy|cookie|javascript|licensed under|public license|subscribe|sign up|log ?in|click here|read more|back to top|share this)')
      AND NOT regexp_matches(l, '( [|»›·] [^|»›·]*){3}')
      AND NOT regexp_matches(l, '([!?]{2,}[^!?]*){3}')
      AND NOT regexp_matches(l, '([#*$%&|<>]{3,}[^#*$%&|<>]*){3}')
      AND NOT (len(regexp_extract_all(l, '[^ \t-\r]+')) >= 12 AND
               NOT regexp_matches(regexp_replace(l, '[ \t-\r]+$', ''), '[.!?…:;,)"''”»]$'))
    ) AS clean,
    [ws[i] || chr(10) || ws[i + 1] || chr(10) || ws[i + 2] FOR i IN range(1, greatest(len(ws) - 1, 1))] AS wins
  FROM lines),
wins AS (SELECT doc_id, unnest(wins) AS win, generate_subscripts(wins, 1) AS p FROM marked),
again AS (SELECT doc_id, p FROM wins QUALIFY count(*) OVER (PARTITION BY doc_id, win) > 1),
cover AS (SELECT doc_id, count(DISTINCT p + d) AS n FROM again, (VALUES (0), (1), (2)) AS t(d) GROUP BY doc_id),
counted AS (
  SELECT m.doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
    length(regexp_replace(body, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
    (len(full_lines) - len(list_distinct(full_lines)))::BIGINT AS n_dup_lines,
    coalesce(c.n, 0)::BIGINT AS n_repeat_words,
    length(regexp_replace(array_to_string(clean, ' '), '[ \t-\r]+', '', 'g'))::BIGINT AS clean_chars
  FROM marked m LEFT JOIN cover c USING (doc_id)),
judged AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counted)
SELECT *, NOT base_failed AND clean_chars * 100 >= word_chars * 50 AS kept FROM judged"""


SQL["op2_minhash_dedup"] = r"""
WITH RECURSIVE ws AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ''), '[ \t-\r]+'), lambda w: w <> '') AS w
  FROM documents),
sh AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, chr(10))]
    ELSE [w[i] || chr(10) || w[i + 1] || chr(10) || w[i + 2] FOR i IN range(1, len(w) - 1)] END) AS s
  FROM ws),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
shared AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM sh x JOIN sh y ON x.s = y.s AND x.doc_id <> y.doc_id
  GROUP BY ALL),
links AS (
  SELECT a, b FROM shared JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b
  WHERE 100 * c >= 85 * (p.n + q.n - c)),
reach AS (
  SELECT a AS doc_id, a AS r FROM links
  UNION
  SELECT reach.doc_id, links.b FROM reach JOIN links ON links.a = reach.r),
least_of AS (SELECT doc_id, min(r) AS c FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(c, d.doc_id) AS component_id,
       d.doc_id = coalesce(c, d.doc_id) AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN least_of USING (doc_id)"""


SQL["op13_fill_in_middle"] = r"""
WITH drawn AS (
  SELECT doc_id, coalesce(text, '') AS body, length(coalesce(text, ''))::BIGINT AS n,
         sha256('1:' || doc_id) AS h
  FROM documents),
numbers AS (
  SELECT doc_id, body, n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2,
         ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4
  FROM drawn),
formed AS (
  SELECT doc_id, body, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN n = 0 OR contains(body, '<P>') OR contains(body, '<S>') OR contains(body, '<M>') OR h3 % 100 >= 90
         THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM numbers),
cut AS (
  SELECT *, substring(body, 1, a) AS p, substring(body, a + 1, b - a) AS m, substring(body, b + 1) AS s FROM formed)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN body WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
         ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(body) AS restored_sha256
FROM cut"""


SQL["op11_ranked_search"] = r"""
WITH folded AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts
  FROM documents),
sized AS (SELECT doc_id, len(ts)::BIGINT AS n, ts FROM folded WHERE len(ts) > 0),
total AS (SELECT count(*)::BIGINT AS nn, sum(n)::BIGINT AS ll FROM sized),
tfs AS (SELECT doc_id, n, term, count(*)::BIGINT AS tf FROM (SELECT doc_id, n, unnest(ts) AS term FROM sized) GROUP BY ALL),
dfs AS (SELECT term, count(*)::BIGINT AS df FROM tfs GROUP BY term),
asked AS (
  SELECT item_id, term, count(*)::BIGINT AS times FROM (
    SELECT item_id, unnest(regexp_extract_all(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY ALL),
scored AS (
  SELECT item_id, doc_id, sum(times * floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT
    * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * nn) // ll))))::BIGINT AS score
  FROM asked JOIN tfs USING (term) JOIN dfs USING (term), total GROUP BY item_id, doc_id)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
FROM scored WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 10"""


SQL["op12_warc"] = r"""
WITH sums AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS h FROM pages),
firsts AS (SELECT *, max(page_id) OVER (PARTITION BY body) AS first_id FROM sums)
SELECT page_id, strlen(body)::BIGINT AS payload_bytes,
  array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    ((('0x' || substr(h, 5 * (i // 4) + 1, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::INTEGER + 1, 1)
    FOR i IN range(32)], '') AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM firsts"""
