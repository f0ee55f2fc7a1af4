"""DuckDB SQL for the queries that SQL can express."""

from reqsift.llm import licences

OP5_LINES = r"""
WITH split AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS all_lines FROM documents
), line AS (
  SELECT doc_id, unnest(all_lines) AS line, generate_subscripts(all_lines, 1) - 1 AS pos FROM split
), win AS (
  SELECT doc_id, pos, line || chr(10) || lead(line) OVER w || chr(10) || lead(line, 2) OVER w AS body
  FROM line WINDOW w AS (PARTITION BY doc_id ORDER BY pos)
), nth AS (
  SELECT doc_id, pos, row_number() OVER (PARTITION BY body ORDER BY doc_id, pos) AS n
  FROM win WHERE body IS NOT NULL AND regexp_matches(body, '[^\x20\x09-\x0D]')
), gone AS (
  SELECT DISTINCT doc_id, pos + d AS pos FROM nth, (VALUES (0), (1), (2)) AS t(d) WHERE n > 1
), runs AS (
  SELECT doc_id, min(pos) AS a, max(pos) AS b
  FROM (SELECT doc_id, pos, pos - row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS grp FROM gone)
  GROUP BY doc_id, grp
), listed AS (
  SELECT doc_id, string_agg(a || '-' || b, ',' ORDER BY a) AS removed, sum(b - a + 1) AS n
  FROM runs GROUP BY doc_id
), kept AS (
  SELECT l.doc_id, string_agg(line, chr(10) ORDER BY l.pos) AS text
  FROM line l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.pos = g.pos
  WHERE g.pos IS NULL GROUP BY l.doc_id
)
SELECT s.doc_id, CAST(len(all_lines) AS BIGINT) AS n_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_removed,
  coalesce(removed, '') AS removed, sha256(coalesce(k.text, '')) AS text_sha256
FROM split s LEFT JOIN listed r ON s.doc_id = r.doc_id LEFT JOIN kept k ON s.doc_id = k.doc_id
"""

OP4_NEAR = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents
), sh AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN CAST([] AS VARCHAR[])
    WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) END) AS s
  FROM w
), size AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id
), common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n
  FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id
), link AS (
  SELECT x, y FROM common JOIN size sx ON sx.doc_id = x JOIN size sy ON sy.doc_id = y
  WHERE 100 * common.n >= 85 * (sx.n + sy.n - common.n)
), near AS (SELECT x, y FROM link UNION ALL SELECT y, x FROM link
), reach AS (
  SELECT doc_id, doc_id AS other FROM documents
  UNION SELECT reach.doc_id, near.y FROM reach JOIN near ON near.x = reach.other
), least AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d JOIN least ON least.doc_id = d.doc_id LEFT JOIN size ON size.doc_id = d.doc_id
"""

OP10_QUALITY = r"""
WITH t AS (SELECT doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT doc_id, stratum, text,
    list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM t
), win AS (
  SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS body
  FROM w, unnest(range(1, len(ws) - 1)) AS u(i)
), again AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, body) AS times FROM win
), covered AS (
  SELECT doc_id, count(DISTINCT i + d) AS n FROM again, (VALUES (0), (1), (2)) AS v(d)
  WHERE times > 1 GROUP BY doc_id
), c AS (
  SELECT w.doc_id, stratum, CAST(len(ws) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(translate(text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
    CAST(len(ls) AS BIGINT) AS n_lines,
    CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN covered ON covered.doc_id = w.doc_id
), f AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c
), score AS (
  SELECT doc_id, stratum, base_failed, 0 AS rule, 1000 * n_symbols // n_words AS score FROM f WHERE n_words > 0
  UNION ALL SELECT doc_id, stratum, base_failed, 1, 1000 * n_dup_lines // n_lines FROM f WHERE n_words > 0
  UNION ALL SELECT doc_id, stratum, base_failed, 2, 1000 * n_repeat_words // n_words FROM f WHERE n_words > 0
  UNION ALL SELECT doc_id, stratum, base_failed, 3, 100 * word_chars // n_words FROM f WHERE n_words > 0
  UNION ALL SELECT doc_id, stratum, base_failed, 4, greatest(0, 1000 - 100 * word_chars // n_words)
    FROM f WHERE n_words > 0
), grid AS (
  SELECT rule, unnest(cutoffs) AS cutoff FROM (VALUES
    (0, [10, 20, 50, 100, 150, 200, 300, 400, 500, 700]),
    (1, [50, 100, 150, 200, 250, 300, 400, 500, 600, 800]),
    (2, [20, 50, 100, 150, 200, 250, 300, 400]),
    (3, [700, 800, 900, 1000, 1200, 1500, 2000]),
    (4, [600, 650, 700, 750, 800])) AS g(rule, cutoffs)
), good AS (
  SELECT s.* FROM score s JOIN (
    SELECT doc_id FROM labels WHERE quality IS NOT NULL GROUP BY doc_id HAVING min(quality) = 1
  ) l ON l.doc_id = s.doc_id WHERE NOT base_failed
), tried AS (
  SELECT stratum, g.rule, cutoff, count(*) AS n, count(*) FILTER (WHERE score > cutoff) AS k,
    (SELECT count(DISTINCT stratum) FROM good) * (SELECT count(*) FROM grid) AS tests
  FROM good JOIN grid g ON g.rule = good.rule GROUP BY stratum, g.rule, cutoff
), tail AS (
  SELECT stratum, rule, cutoff, n, k, tests, sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1)
    + i * ln(0.02) + (n - i) * ln(0.98))) AS p
  FROM tried, unnest(range(0, k + 1)) AS u(i) WHERE k < n * 0.02
  GROUP BY stratum, rule, cutoff, n, k, tests
), proposed AS (
  SELECT stratum, rule, min(cutoff) AS cutoff FROM tail WHERE p * tests <= 0.05 GROUP BY stratum, rule
), firsts AS (
  SELECT good.stratum, good.doc_id, min(good.rule) FILTER (WHERE score > cutoff) AS first
  FROM good LEFT JOIN proposed q ON q.stratum = good.stratum AND q.rule = good.rule GROUP BY good.stratum, good.doc_id
), joint AS (
  SELECT q.stratum, q.rule, q.cutoff, count(*) AS n, count(*) FILTER (WHERE first <= q.rule) AS k,
    (SELECT count(DISTINCT stratum) FROM good) * (
      SELECT CAST(product(m + 1) AS BIGINT) FROM (SELECT count(*) AS m FROM grid GROUP BY rule)
    ) AS tests
  FROM proposed q JOIN firsts ON firsts.stratum = q.stratum GROUP BY q.stratum, q.rule, q.cutoff
), joint_tail AS (
  SELECT stratum, rule, cutoff, tests, sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1)
    + i * ln(0.02) + (n - i) * ln(0.98))) AS p
  FROM joint, unnest(range(0, k + 1)) AS u(i) WHERE k < n * 0.02
  GROUP BY stratum, rule, cutoff, tests
), chosen AS (
  SELECT stratum, rule, cutoff FROM joint_tail WHERE p * tests <= 0.05
), rejected AS (
  SELECT DISTINCT s.doc_id FROM score s JOIN chosen h ON h.stratum = s.stratum AND h.rule = s.rule
  WHERE score > cutoff
)
SELECT f.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND r.doc_id IS NULL AS kept
FROM f LEFT JOIN rejected r ON r.doc_id = f.doc_id
"""

_TEMPLATES = ",\n".join(
    "  ({}, '{}', '{}')".format(n, licence, body.replace("'", "''")) for n, (licence, body) in enumerate(licences.TEMPLATES)
)
OP1_LICENCES = r"""
WITH template(no, licence, body) AS (VALUES
{templates}
), tt AS (
  SELECT no, licence, term, count(*) AS tf
  FROM (SELECT no, licence, unnest(regexp_extract_all(lower(body), '[a-z0-9]+')) AS term FROM template) GROUP BY ALL
), d AS (
  SELECT doc_id, concat_ws('/', source, lang, doc_id // 1000, doc_id) AS path,
    concat_ws('/', source, lang, doc_id // 1000) AS folder, coalesce(text, '') AS text
  FROM documents
), unit AS (
  SELECT doc_id, sort, unnest(us) AS body, generate_subscripts(us, 1) AS pos FROM (
    SELECT doc_id, 0 AS sort, string_split(text, chr(10)) AS us FROM d
    UNION ALL SELECT doc_id, 1, list_filter(
      regexp_split_to_array(text, '\n[^A-Za-z0-9]*\n'), lambda x: contains(x, chr(10))) FROM d
    UNION ALL SELECT doc_id, 2, [text] FROM d WHERE regexp_matches(text, '\n[^A-Za-z0-9]*\n')
  )
), lt AS (
  SELECT doc_id, sort, pos, term, count(*) AS tf
  FROM (SELECT doc_id, sort, pos, unnest(regexp_extract_all(
    translate(body, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9]+')) AS term FROM unit)
  GROUP BY ALL
), total AS (SELECT count(*) AS n FROM d
), df AS (SELECT term, count(DISTINCT doc_id) AS df FROM lt WHERE sort = 0 GROUP BY term
), idf AS (
  SELECT term, ln((n + 1) / (coalesce(df, 0) + 1)) + 1 AS idf
  FROM (SELECT DISTINCT term FROM tt) LEFT JOIN df USING (term), total
), tv AS (
  SELECT no, licence, term, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY no)) AS w
  FROM tt JOIN idf USING (term)
), lv AS (
  SELECT doc_id, sort, pos, lt.term, tf, tf * coalesce(idf, ln(n + 1) + 1) AS w
  FROM lt LEFT JOIN idf ON idf.term = lt.term, total
), size AS (
  SELECT doc_id, sort, pos, sqrt(sum(w * w)) AS norm, sum(tf) AS words FROM lv GROUP BY doc_id, sort, pos
), hit AS (
  SELECT lv.doc_id, lv.sort, lv.pos, licence,
    round(sum(lv.w * tv.w) / any_value(norm), 6) AS score, any_value(words) AS words
  FROM lv JOIN tv ON tv.term = lv.term JOIN size s ON s.doc_id = lv.doc_id AND s.sort = lv.sort AND s.pos = lv.pos
  GROUP BY lv.doc_id, lv.sort, lv.pos, no, licence
), best AS (
  SELECT doc_id, sort, licence, score, words FROM hit WHERE score >= 0.75
  QUALIFY row_number() OVER (PARTITION BY doc_id, sort, pos ORDER BY score DESC, licence DESC) = 1
), tag AS (
  SELECT doc_id, unnest(regexp_extract_all(text,
    'SPDX-License-Identifier:[ \t]*\(?([A-Za-z0-9.+-]+(?: (?:AND|OR|WITH) [A-Za-z0-9.+-]+)*)', 1)) AS licence FROM d
), found AS (
  SELECT doc_id, sort, licence, score, words FROM best
  UNION ALL SELECT doc_id, 3, licence, 1.0, len(regexp_extract_all(lower(licence), '[a-z0-9]+')) + 3 FROM tag
), own AS (
  SELECT doc_id, arg_max(licence, {'s': score, 'l': licence}) AS licence, max(score) AS score FROM found GROUP BY doc_id
), covered AS (
  SELECT doc_id, max(words) AS words FROM (SELECT doc_id, sort, sum(words) AS words FROM found GROUP BY doc_id, sort)
  GROUP BY doc_id
), share AS (
  SELECT own.doc_id, own.licence, own.score, path, folder,
    c.words / (SELECT sum(words) FROM size WHERE size.doc_id = own.doc_id AND sort = 0) AS share
  FROM own JOIN d ON d.doc_id = own.doc_id JOIN covered c ON c.doc_id = own.doc_id
), governing AS (
  SELECT folder AS up, licence, score FROM share WHERE share >= 0.2
  QUALIFY row_number() OVER (PARTITION BY folder ORDER BY score DESC, share DESC, path) = 1
), above AS (
  SELECT folder, array_to_string(list_slice(string_split(folder, '/'), 1, k), '/') AS up
  FROM (SELECT DISTINCT folder FROM d), unnest([0, 1, 2, 3]) AS u(k)
), inherited AS (
  SELECT a.folder, a.up, licence, score FROM above a JOIN governing g ON g.up = a.up
  QUALIFY row_number() OVER (PARTITION BY a.folder ORDER BY length(a.up) DESC) = 1
)
SELECT d.doc_id, d.path, coalesce(own.licence, i.licence) AS licence,
  CASE WHEN own.doc_id IS NOT NULL THEN 'own' WHEN i.up IS NOT NULL THEN 'inherited' ELSE 'none' END AS origin,
  coalesce(own.score, i.score) AS score, CASE WHEN own.doc_id IS NULL THEN i.up END AS governed_by
FROM d LEFT JOIN own ON own.doc_id = d.doc_id LEFT JOIN inherited i ON i.folder = d.folder
""".replace("{templates}", _TEMPLATES)

OP12_SUFFIXES = r"""
WITH t AS (SELECT doc_id, lower(hex(encode(coalesce(text, '')))) AS h FROM documents
), win AS (
  SELECT doc_id, i, md5_number(substr(h, 2 * i + 1, 400)) AS body
  FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 199)) AS i FROM t)
), often AS (SELECT body FROM win GROUP BY body HAVING count(*) > 1
), hit AS (
  SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM win SEMI JOIN often USING (body)
), run AS (
  SELECT doc_id, i, sum(CASE WHEN before IS NULL OR i > before + 200 THEN 1 ELSE 0 END)
    OVER (PARTITION BY doc_id ORDER BY i) AS grp FROM hit
), span AS (
  SELECT doc_id, min(i) AS a, max(i) + 200 AS b FROM run GROUP BY doc_id, grp
), piece AS (
  SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS since FROM span
), head AS (
  SELECT p.doc_id, string_agg(substr(h, 2 * since + 1, 2 * (a - since)), '' ORDER BY a) AS kept,
    max(b) AS tail, sum(b - a) AS n_removed, count(*) AS n_spans
  FROM piece p JOIN t ON p.doc_id = t.doc_id GROUP BY p.doc_id
)
SELECT t.doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
  CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(tail, 0) + 1))) AS kept_sha256
FROM t LEFT JOIN head ON t.doc_id = head.doc_id
"""

OP13_NEGATIVES = r"""
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda c: floor(256 * CAST(c AS DOUBLE))) AS x
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same,
    CAST(list_inner_product(a.x, b.x) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0
), p AS (
  SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5
)
SELECT p.anchor_id, positive_id,
  CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other) AS INTEGER) AS rank,
  other AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT same
WHERE 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY rank <= 3
"""
