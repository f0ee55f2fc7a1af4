"""The catalog's queries as SQL that DuckDB runs on the same tables, to check results against."""

from __future__ import annotations

# White space as in reqsift.functions.text.BLANK, in RE2 notation.
BLANK = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _words(text: str) -> str:
    return f"list_filter(string_split_regex({text}, '{BLANK}+'), lambda w: w <> '')"


def _strip(text: str) -> str:
    return f"regexp_replace(regexp_replace({text}, '^{BLANK}+', ''), '{BLANK}+$', '')"


def _title(text: str) -> str:
    return f"array_to_string(({_words(text)})[1:5], ' ')"


def _rest(text: str) -> str:
    return f"array_to_string(({_words(text)})[6:], ' ')"


def _noise(text: str) -> str:
    phrases = [
        "executive summary",
        "problem statement",
        "impacted system",
        "high level flow",
        "this document provides",
        "conceptual solution",
        "document overview",
        "license",
        "all rights reserved",
    ]
    return "(" + " OR ".join(f"contains(lower({text}), '{p}')" for p in phrases) + ")"


RECORDS = f"""
recs AS MATERIALIZED (
  SELECT doc_id, source, lang, {_title('text')} AS title, {_rest('text')} AS description,
         CASE WHEN doc_id % 3 = 0 THEN 'UI' ELSE 'Functional' END AS type
  FROM documents
)"""

CHUNKS = f"""
walk AS (
  SELECT doc_id, string_split(text, chr(10)) AS ls, 0 AS i, '' AS cur, 0::BIGINT AS n,
         NULL::VARCHAR AS done
  FROM documents WHERE length(text) > 6000
  UNION ALL
  SELECT doc_id, ls, i + 1,
         CASE WHEN length(cur) + length(ls[i + 1]) < 6000 THEN cur ELSE '' END || ls[i + 1] || chr(10),
         n + CASE WHEN done IS NULL THEN 0 ELSE 1 END,
         CASE WHEN length(cur) + length(ls[i + 1]) < 6000 OR cur = '' THEN NULL ELSE cur END
  FROM walk WHERE i < len(ls)
),
chunks AS MATERIALIZED (
  SELECT doc_id, chunk_no, text, length({_strip('text')}) < 50 AS too_short
  FROM (
    SELECT doc_id, 0::BIGINT AS chunk_no, text FROM documents WHERE length(text) <= 6000
    UNION ALL SELECT doc_id, n, done FROM walk WHERE done IS NOT NULL
    UNION ALL
    SELECT doc_id, n + CASE WHEN done IS NULL THEN 0 ELSE 1 END, cur
    FROM walk WHERE i = len(ls) AND cur <> ''
  )
)"""

# Pairs of records above the duplicate threshold.
NEAR = RECORDS + f""",
tok AS MATERIALIZED (
  SELECT doc_id, unnest(list_distinct({_words("lower(title || ' ' || description)")})) AS t FROM recs
),
size_of AS (SELECT doc_id, count(*) AS n FROM tok GROUP BY 1),
near AS MATERIALIZED (
  SELECT a, b, inter / (x.n + y.n - inter) AS similarity
  FROM (SELECT l.doc_id AS a, r.doc_id AS b, count(*)::DOUBLE AS inter
        FROM tok l JOIN tok r ON l.t = r.t AND l.doc_id < r.doc_id GROUP BY 1, 2)
  JOIN size_of x ON x.doc_id = a JOIN size_of y ON y.doc_id = b
  WHERE inter / (x.n + y.n - inter) > 0.45
)"""

SURVIVORS = NEAR + """,
steps AS MATERIALIZED (
  SELECT r.doc_id, length(r.description) AS chars, row_number() OVER (ORDER BY r.doc_id) AS i,
         coalesce((SELECT list(a ORDER BY a) FROM near WHERE b = r.doc_id), []) AS before
  FROM recs r
),
scan(i, alive) AS (
  SELECT 0::BIGINT, []::BIGINT[]
  UNION ALL
  SELECT s.i,
         CASE WHEN h.doc_id IS NULL THEN list_append(alive, s.doc_id)
              WHEN s.chars > h.chars
              THEN list_append(list_filter(alive, lambda x: x <> h.doc_id), s.doc_id)
              ELSE alive END
  FROM scan JOIN steps s ON s.i = scan.i + 1
  LEFT JOIN steps h ON h.doc_id = list_filter(s.before, lambda x: list_contains(alive, x))[1]
),
kept AS MATERIALIZED (
  SELECT unnest(alive) AS doc_id FROM scan WHERE i = (SELECT max(i) FROM scan)
)"""


def _field_tokens(side: str, fields: dict[str, str]) -> str:
    """Distinct words of the fields of one side, one row per record, field and word."""
    parts = [
        f"SELECT project, ord, '{name}' AS f, unnest(list_distinct({_words(f'lower({text})')})) AS t FROM {side}"
        for name, text in fields.items()
    ]
    return " UNION ALL ".join(parts)


def _scores(floor: float) -> str:
    """Best of five Jaccard indexes of every pair from ``floor`` on, given tables ext and gt."""
    ext = _field_tokens("ext", {"t": "title", "d": "description", "a": "title || ' ' || description"})
    gt = _field_tokens("gt", {"t": "name", "d": "description", "a": "name || ' ' || description"})
    return f"""
etok AS MATERIALIZED ({ext}),
gtok AS MATERIALIZED ({gt}),
esize AS (SELECT project, ord, f, count(*) AS n FROM etok GROUP BY ALL),
gsize AS (SELECT project, ord, f, count(*) AS n FROM gtok GROUP BY ALL),
compared(ef, gf) AS (VALUES ('t', 't'), ('t', 'd'), ('d', 't'), ('d', 'd'), ('a', 'a')),
scores AS MATERIALIZED (
  SELECT project, eo, go, max(inter / (es.n + gs.n - inter)) AS score
  FROM (
    SELECT e.project, e.ord AS eo, g.ord AS go, ef, gf, count(*)::DOUBLE AS inter
    FROM etok e JOIN compared ON ef = e.f
    JOIN gtok g ON g.project = e.project AND g.f = gf AND g.t = e.t
    GROUP BY ALL
  ) JOIN esize es USING (project) JOIN gsize gs USING (project)
  WHERE es.ord = eo AND es.f = ef AND gs.ord = go AND gs.f = gf
  GROUP BY ALL
  HAVING max(inter / (es.n + gs.n - inter)) >= {floor}
)"""


BENCHMARK = RECORDS + f""",
ext AS (SELECT 'all' AS project, doc_id AS ord, title, description, type FROM recs),
gt AS MATERIALIZED (
  SELECT 'all' AS project, item_id AS ord, {_title('text')} AS name, {_rest('text')} AS description
  FROM benchmark
),""" + _scores(0.10)

SIDES = RECORDS + """,
ext AS MATERIALIZED (
  SELECT lang AS project, doc_id AS ord, 'E' || doc_id AS extracted_id, title, description, type
  FROM recs WHERE doc_id % 2 = 1
),
gt AS MATERIALIZED (
  SELECT lang AS project, doc_id AS ord, 'G' || doc_id AS gt_id, title AS name, description
  FROM recs WHERE doc_id % 2 = 0
),"""


def _residue(text: str) -> str:
    return f"(('0x' || substr(md5({text}), 1, 7))::BIGINT % 251)"


def _matching(judged: bool) -> str:
    yes = f"""
    SELECT e.project, e.ord AS eo, g.ord AS go FROM ext e JOIN gt g
    ON e.project = g.project AND {_residue('e.title')} = {_residue('g.name')}"""
    if not judged:
        yes = "SELECT project, ord AS eo, ord AS go FROM ext WHERE false"
    return SIDES + _scores(0.10 if judged else 0.30) + f""",
yes AS MATERIALIZED ({yes}),
options AS MATERIALIZED (
  SELECT project, eo,
         list(struct_pack(go := go, score := score) ORDER BY score DESC, go)
           FILTER (kind = 0 AND score >= 0.30) AS strong,
         max(score) FILTER (kind = 0 AND score < 0.30) IS NOT NULL AS has_weak,
         list(struct_pack(go := go, score := score) ORDER BY score DESC, go)
           FILTER (kind = 0 AND score < 0.30) AS weak,
         list(go ORDER BY go) FILTER (kind = 1) AS judged
  FROM (SELECT 0 AS kind, project, eo, go, score FROM scores
        UNION ALL SELECT 1, project, eo, go, 0.0 FROM yes)
  GROUP BY 1, 2
),
turns AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY project ORDER BY eo) AS i FROM options
),
choice(project, i, taken, eo, go, similarity, match_method) AS (
  SELECT DISTINCT project, 0::BIGINT, []::BIGINT[], NULL::BIGINT, NULL::BIGINT, NULL::DOUBLE, NULL::VARCHAR
  FROM ext
  UNION ALL
  SELECT project, i,
         CASE WHEN go IS NULL THEN taken ELSE list_append(taken, go) END,
         eo, go,
         CASE WHEN s IS NOT NULL THEN s.score ELSE w.score END,
         CASE WHEN s IS NOT NULL THEN 'jaccard' ELSE 'llm' END
  FROM (
    SELECT *, CASE WHEN s IS NOT NULL THEN s.go WHEN w IS NOT NULL THEN y END AS go
    FROM (
      SELECT c.project, t.i, c.taken, t.eo,
             list_filter(coalesce(t.strong, []), lambda x: NOT list_contains(c.taken, x.go))[1] AS s,
             list_filter(coalesce(t.weak, []), lambda x: NOT list_contains(c.taken, x.go))[1] AS w,
             list_filter(coalesce(t.judged, []), lambda x: NOT list_contains(c.taken, x))[1] AS y
      FROM choice c JOIN turns t ON t.project = c.project AND t.i = c.i + 1
    )
  )
),
matched AS MATERIALIZED (
  SELECT c.project, c.eo, c.go, e.extracted_id, e.title AS extracted_title, g.gt_id,
         g.name AS gt_name, c.similarity, c.match_method
  FROM choice c JOIN ext e ON e.ord = c.eo JOIN gt g ON g.ord = c.go
  WHERE c.go IS NOT NULL
),
missed AS MATERIALIZED (
  SELECT project, ord, gt_id, name AS gt_name, description FROM gt
  WHERE NOT EXISTS (SELECT 1 FROM matched m WHERE m.project = gt.project AND m.gt_id = gt.gt_id)
),
over AS MATERIALIZED (
  SELECT project, ord, extracted_id, title, type, description FROM ext
  WHERE NOT EXISTS (SELECT 1 FROM matched m WHERE m.eo = ext.ord)
),
counts AS MATERIALIZED (
  SELECT project,
         (SELECT count(*) FROM gt WHERE gt.project = p.project) AS gt,
         (SELECT count(*) FROM ext WHERE ext.project = p.project) AS extracted,
         (SELECT count(*) FROM matched m WHERE m.project = p.project) AS true_positives,
         (SELECT count(*) FROM missed m WHERE m.project = p.project) AS false_negatives,
         (SELECT count(*) FROM over o WHERE o.project = p.project) AS false_positives
  FROM (SELECT project FROM ext UNION SELECT project FROM gt) p
),
quality AS MATERIALIZED (
  SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall)
            ELSE 0.0 END::DOUBLE AS f1_score
  FROM (
    SELECT *,
      CASE WHEN extracted > 0 THEN true_positives::DOUBLE / extracted ELSE 0.0 END::DOUBLE AS precision,
      CASE WHEN true_positives + false_negatives > 0
           THEN true_positives::DOUBLE / (true_positives + false_negatives) ELSE 0.0 END::DOUBLE AS recall
    FROM counts
  )
)"""


REPORT = """,
parts AS (
  SELECT 'm' AS kind, project, extracted_id AS id,
         row_number() OVER (PARTITION BY project ORDER BY eo) - 1 AS n FROM matched
  UNION ALL
  SELECT 'g', project, gt_id, row_number() OVER (PARTITION BY project ORDER BY ord) - 1 FROM missed
  UNION ALL
  SELECT 'o', project, extracted_id, row_number() OVER (PARTITION BY project ORDER BY ord) - 1 FROM over
),
lists AS (
  SELECT project, n // 20 AS part,
         string_agg(id, ',' ORDER BY n) FILTER (kind = 'm') AS matched,
         string_agg(id, ',' ORDER BY n) FILTER (kind = 'g') AS missed,
         string_agg(id, ',' ORDER BY n) FILTER (kind = 'o') AS over_created
  FROM (SELECT * FROM parts UNION ALL SELECT NULL, project, NULL, 0 FROM counts)
  GROUP BY 1, 2
)
SELECT project, part, (max(part) OVER (PARTITION BY project)) + 1 AS parts, precision, recall, f1_score,
       gt, extracted, true_positives, false_negatives, false_positives,
       coalesce(matched, '') AS matched, coalesce(missed, '') AS missed,
       coalesce(over_created, '') AS over_created
FROM lists JOIN quality USING (project)"""

EVENT_RESPONSES = """
one AS (
  SELECT *, format('{{"title": "{} {}", "description": "user {}", "type": "UI"}}',
                   event_type, event_id, user_id) AS o,
         format('{{"title": "second {}", "type": null}}', event_id) AS s
  FROM events
),
responses AS (
  SELECT event_id, CASE event_id % 8
    WHEN 0 THEN '[' || o || ', ' || s || ']'
    WHEN 1 THEN 'Here:' || chr(10) || '```json' || chr(10) || '[' || o || ', ' || s || ']' || chr(10)
                || '```' || chr(10) || 'Done.'
    WHEN 2 THEN '```[' || o || ', ' || s || ']```'
    WHEN 3 THEN o
    WHEN 4 THEN '[' || o || ', ' || s || '] and more'
    WHEN 5 THEN translate('[' || o || ', ' || s || ']', '"', '''')
    WHEN 6 THEN '[' || o
    ELSE '  ' END AS raw
  FROM one
)"""


def _unfence(raw: str) -> str:
    return (
        f"CASE WHEN contains({raw}, '```') "
        f"THEN regexp_replace(string_split({raw}, '```')[2], '^json', '') ELSE {raw} END"
    )


LABELLED = """
scored AS (
  SELECT doc_id, CASE WHEN quality = 1 THEN 'yes' ELSE 'no' END AS label,
         CASE WHEN n_chars > 1000 THEN 'yes' ELSE 'no' END AS predicted
  FROM documents JOIN labels USING (doc_id)
)"""

CONTEXT = """
SELECT conv_id AS doc_id,
       substr(string_agg(text, chr(10) || chr(10) ORDER BY turn), 1, 4000) AS source_text
FROM conversations GROUP BY 1"""


DELIVERED = """
WITH placed AS (
  SELECT source AS project, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 20 AS part
  FROM documents WHERE source <> 'src7'
),
sent AS (
  SELECT project, part, substr(project, 4)::BIGINT AS project_id, count(*) AS n,
         substr(project, 4)::BIGINT % 5 AS kind
  FROM placed GROUP BY 1, 2
)
"""


# Candidates of the extraction from first and last lines, those kept (recs) and the survivors.
EXTRACTED = f"""WITH RECURSIVE {CHUNKS},
ends AS (
  SELECT doc_id AS source_id, chunk_no, ls, n FROM (
    SELECT doc_id, chunk_no, string_split(regexp_replace(regexp_replace(text, '^\n+', ''), '\n+$', ''), chr(10)) AS ls
    FROM chunks WHERE NOT too_short
  ), LATERAL (SELECT len(ls) AS n)
),
found AS (
  SELECT source_id, chunk_no, 0 AS pos, ls[1] AS line FROM ends
  UNION ALL SELECT source_id, chunk_no, 1, ls[n] FROM ends WHERE n > 1
),
numbered AS MATERIALIZED (
  SELECT source_id, row_number() OVER (ORDER BY source_id, chunk_no, pos) AS doc_id,
    {_title('line')} AS title, {_rest('line')} AS description
  FROM found
),
recs AS MATERIALIZED (
  SELECT * FROM numbered
  WHERE NOT {_noise("title || ' ' || description")} AND length(description) % 3 <> 0
)""" + SURVIVORS.removeprefix(RECORDS) + """,
"""


# Candidates of the extraction from whole chunks.
FIRST_LINES = f"""
WITH RECURSIVE {CHUNKS},
found AS (
  SELECT doc_id, chunk_no, {_title('text')} AS title, {_rest('text')} AS description
  FROM chunks WHERE NOT too_short
)"""

EXTRACT_FLOW = FIRST_LINES + f"""
SELECT doc_id, chunk_no, row_number() OVER (ORDER BY doc_id, chunk_no) AS cand_order, title,
  CASE WHEN {_noise("title || ' ' || description")} THEN 'noise'
       WHEN length(description) % 3 <> 0 THEN 'accepted' ELSE 'rejected' END AS status
FROM found"""


def all_oracles() -> dict[str, str]:
    greedy, hybrid = "WITH RECURSIVE " + _matching(False), "WITH RECURSIVE " + _matching(True)
    match = """
SELECT project, extracted_id, extracted_title, gt_id, gt_name, similarity, match_method FROM matched"""
    return {
        "chunk_documents": f"WITH RECURSIVE {CHUNKS} SELECT doc_id, chunk_no, text, too_short FROM chunks",
        "page_fallback": f"""
WITH good AS (SELECT doc_id, text FROM documents WHERE length({_strip('text')}) > 100),
pages AS (
  SELECT doc_id, 1::BIGINT AS page_no, text FROM good
  UNION ALL
  SELECT conv_id, turn, text FROM conversations
  WHERE {_strip('text')} <> '' AND NOT EXISTS (SELECT 1 FROM good WHERE good.doc_id = conv_id)
)
SELECT * FROM pages
UNION ALL
SELECT doc_id, NULL, NULL FROM
  (SELECT doc_id FROM documents UNION SELECT conv_id FROM conversations)
WHERE doc_id NOT IN (SELECT doc_id FROM pages)""",
        "noise_filter": f"""
WITH {RECORDS} SELECT doc_id, {_noise("title || ' ' || description")} AS noise FROM recs""",
        "verdict_split": f"""
WITH {RECORDS} SELECT doc_id,
  CASE WHEN {_noise("title || ' ' || description")} THEN 'noise'
       WHEN quality IS NULL THEN 'failed'
       WHEN toxic = 1 OR quality = 1 THEN 'accepted'
       ELSE 'rejected' END AS status
FROM recs LEFT JOIN labels USING (doc_id)""",
        "fence_json_candidates": f"""
WITH {EVENT_RESPONSES},
bodies AS (SELECT event_id, {_strip(_unfence('raw'))} AS body FROM responses),
valid AS (
  SELECT event_id, CASE WHEN json_valid(body) AND starts_with(body, '[') THEN body ELSE '[]' END AS body
  FROM bodies
),
opened AS (
  SELECT event_id, body, unnest(range(json_array_length(body)::BIGINT)) AS pos FROM valid
)
SELECT event_id, pos, json_extract_string(body, '$[' || pos || '].title') AS title,
       json_extract_string(body, '$[' || pos || '].description') AS description,
       json_extract_string(body, '$[' || pos || '].type') AS type
FROM opened""",
        "json_list_lenient": f"""
WITH raws AS (
  SELECT event_id, CASE event_id % 6
    WHEN 0 THEN '["' || event_type || '", "user ' || user_id || '"]'
    WHEN 1 THEN '```json' || chr(10) || '["fenced ' || event_id || '"]' || chr(10) || '```'
    WHEN 2 THEN '"only ' || user_id || '"'
    WHEN 3 THEN '  plain ' || event_type || ' text '
    WHEN 4 THEN '["a"] tail ' || event_id
    ELSE ' ' || chr(10) END AS raw
  FROM events
),
bodies AS (SELECT event_id, {_strip(_unfence('raw'))} AS body FROM raws),
listed AS (
  SELECT event_id, CASE
    WHEN body = '' THEN []
    WHEN NOT json_valid(body) THEN [body]
    WHEN starts_with(body, '[') THEN json_extract_string(body, '$[*]')
    ELSE [json_extract_string(body, '$')] END AS vs
  FROM bodies
)
SELECT event_id, unnest(range(len(vs))) AS pos, unnest(vs) AS value FROM listed""",
        "jaccard_pairs": f"""
WITH {NEAR},
sets AS (
  SELECT md5(string_agg(t, ' ' ORDER BY t)) AS s, doc_id FROM tok GROUP BY doc_id
),
firsts AS (SELECT s, min(doc_id) AS id, count(*) AS copies FROM sets GROUP BY 1)
SELECT x.id AS left_id, y.id AS right_id, x.copies AS left_copies, y.copies AS right_copies, similarity
FROM near JOIN firsts x ON x.id = a JOIN firsts y ON y.id = b""",
        "greedy_dedup": f"""
WITH RECURSIVE {SURVIVORS} SELECT doc_id, title FROM kept JOIN recs USING (doc_id)""",
        "requirement_ids": """
SELECT project, doc_id, upper(project) || '-' || lpad(n::VARCHAR, greatest(3, length(n::VARCHAR))::INTEGER, '0')
  AS requirement_id
FROM (
  SELECT *, row_number() OVER (PARTITION BY project ORDER BY doc_id) AS n
  FROM (SELECT CASE WHEN doc_id % 3 = 0 THEN 'big' ELSE source END AS project, doc_id FROM documents)
)""",
        "cross_field_scores": f"""
WITH {BENCHMARK} SELECT eo AS doc_id, go AS item_id, score FROM scores""",
        "best_match": f"""
WITH {BENCHMARK} SELECT doc_id, item_id, score FROM (
  SELECT eo AS doc_id, go AS item_id, score,
         row_number() OVER (PARTITION BY eo ORDER BY score DESC, go) AS n FROM scores
) WHERE n = 1""",
        "match_tiers": f"""
WITH {BENCHMARK} SELECT CASE WHEN score >= 0.30 THEN 'match' ELSE 'borderline' END AS tier,
  count(*) AS pairs FROM scores GROUP BY 1""",
        "greedy_match": greedy + match,
        "hybrid_match": hybrid + match,
        "judge_match": hybrid + match,
        "first_asked": f"""
WITH {BENCHMARK} SELECT ext_title, gt_name, ext_description, gt_description FROM (
  SELECT e.type AS ext_title, g.name AS gt_name, e.description AS ext_description,
         g.description AS gt_description,
         row_number() OVER (PARTITION BY e.type, g.name ORDER BY eo, go) AS n
  FROM scores JOIN ext e ON e.ord = eo JOIN gt g ON g.ord = go
) WHERE n = 1""",
        "missed": greedy + " SELECT project, gt_id, gt_name, description FROM missed",
        "over_created": greedy + " SELECT project, extracted_id, title, type, description FROM over",
        "eval_metrics": greedy + """
SELECT project, gt, extracted, true_positives, false_negatives, false_positives,
       precision, recall, f1_score FROM quality""",
        "match_methods": hybrid + """
SELECT project, match_method, count(*) AS matches FROM matched GROUP BY 1, 2""",
        "eval_report": greedy + REPORT,
        "report_lookup": greedy + REPORT + " WHERE project = 'en'",
        "label_agreement": f"""
WITH {LABELLED} SELECT count(*) AS examples,
  avg(CASE WHEN label = predicted THEN 1.0::DOUBLE ELSE 0.0 END) AS agreement FROM scored""",
        "demo_select": f"""
WITH {LABELLED} SELECT doc_id, label FROM (
  SELECT doc_id, label, row_number() OVER (PARTITION BY label ORDER BY doc_id) AS n
  FROM scored WHERE label = predicted
) WHERE n <= 8""",
        "enrich_success_failure": f"""
WITH {RECORDS}, flagged AS (
  SELECT *, doc_id % 11 <> 0 AND doc_id % 10 <> 0 AS ok FROM recs
)
SELECT doc_id, title AS short_title,
  CASE WHEN ok THEN 'As a user, I want ' || title ELSE '' END AS user_story,
  CASE WHEN ok THEN title || '|shown' ELSE '' END AS acceptance_criteria,
  CASE WHEN ok THEN 'open|look' ELSE '' END AS step_actions,
  CASE WHEN ok THEN doc_id END AS first_step,
  0::BIGINT AS scenarios,
  CASE WHEN ok THEN 'none known' ELSE '' END AS assumptions,
  0::BIGINT AS ambiguities,
  CASE WHEN NOT ok OR doc_id % 3 <> 0 THEN 'low' ELSE 'high' END AS confidence,
  'recorded' AS extraction_model,
  ok AS validation_confirmed,
  description,
  true AS is_requirement,
  '2024-05-06T07:08:09.123456' AS extraction_timestamp,
  'documents' AS source_file,
  '2024-05-06T07:08:09.123456' AS metadata_timestamp,
  ok AS metadata_confirmed
FROM flagged""",
        "training_quality": "SELECT doc_id, true AS answered, true AS as_good_as_majority FROM documents",
        "saved_enriched": f"""
WITH {RECORDS}, flagged AS (
  SELECT *, doc_id % 11 <> 0 AND doc_id % 10 <> 0 AS ok FROM recs
)
SELECT source AS project, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS position,
  title AS short_title, CASE WHEN ok THEN title || '|shown' ELSE '' END AS acceptance_criteria,
  '2024-05-06T07:08:09.123456' AS extraction_timestamp, 'documents' AS source_file,
  ok AS validation_confirmed
FROM flagged""",
        "save_two_projects": f"""
WITH {RECORDS} SELECT source AS project, n - 1 AS position,
  upper(source) || '-' || lpad(n::VARCHAR, greatest(3, length(n::VARCHAR))::INTEGER, '0') AS requirement_id,
  title, type
FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM recs)""",
        "candidate_defaults": """
SELECT event_id, 0::BIGINT AS pos, CASE event_id % 4 WHEN 0 THEN event_type WHEN 1 THEN '' WHEN 2 THEN 't' ELSE 'p' END
    AS title,
  CASE event_id % 4 WHEN 1 THEN 'user ' || user_id WHEN 3 THEN 'kept' ELSE '' END AS description,
  CASE event_id % 4 WHEN 3 THEN 'UI' ELSE 'Unknown' END AS type
FROM events
UNION ALL SELECT event_id, 1, '', '', 'Unknown' FROM events WHERE event_id % 4 = 2""",
        "evaluate_flow": hybrid + """,
items AS (
  SELECT 'matched' AS section, project, extracted_id AS item_id,
         row_number() OVER (PARTITION BY project ORDER BY eo) - 1 AS position FROM matched
  UNION ALL
  SELECT 'missed', project, gt_id, row_number() OVER (PARTITION BY project ORDER BY ord) - 1 FROM missed
  UNION ALL
  SELECT 'over_created', project, extracted_id, row_number() OVER (PARTITION BY project ORDER BY ord) - 1
  FROM over
)
SELECT project, 'summary' AS section, 0::BIGINT AS position, precision, recall, f1_score, gt, extracted,
  true_positives, false_negatives, false_positives, NULL::VARCHAR AS item_id
FROM quality WHERE project IN ('en', 'fr')
UNION ALL
SELECT project, section, position, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, item_id
FROM items WHERE project IN ('en', 'fr')""",
        "extract_deliver_flow": EXTRACTED + """
final AS (
  SELECT source_id, r.doc_id, title, row_number() OVER (ORDER BY r.doc_id) AS n FROM kept JOIN recs r USING (doc_id)
)
SELECT source_id AS doc_id, doc_id AS cand_order,
  'ALL-' || lpad(n::VARCHAR, greatest(3, length(n::VARCHAR))::INTEGER, '0') AS requirement_id,
  title AS short_title, 'doc/' || source_id AS source_file, true AS success,
  (SELECT count(*) FROM final) AS stored
FROM final""",
        "source_context": CONTEXT,
        "text_volume": """
SELECT conv_id AS doc_id, count(*) AS pages, sum(length(text))::BIGINT AS chars
FROM conversations GROUP BY 1""",
        "stage_counts": f"""
WITH RECURSIVE {CHUNKS}
SELECT 'pages' AS stage, 'all' AS status, count(*) AS rows FROM documents
UNION ALL
SELECT 'chunks', CASE WHEN too_short THEN 'skipped' ELSE 'kept' END, count(*) FROM chunks GROUP BY 2
UNION ALL
SELECT 'candidates', CASE WHEN {_noise('text')} THEN 'noise' ELSE 'accepted' END, count(*)
FROM documents GROUP BY 2""",
        "delivery_outcomes": DELIVERED + """
SELECT project, part, project_id, kind IN (0, 1) AS success,
  CASE kind WHEN 0 THEN 200 WHEN 1 THEN 201 WHEN 2 THEN 404 WHEN 3 THEN 500 END::INTEGER AS status_code,
  CASE kind WHEN 2 THEN substr(repeat(n || ' records refused ', 40), 1, 500)
            WHEN 3 THEN 'not now' WHEN 4 THEN 'connection refused' END AS error,
  CASE kind WHEN 0 THEN '{"stored": ' || n || '}' WHEN 1 THEN '{}' END AS response
FROM sent""",
        "delivery_by_project": DELIVERED + """
SELECT project, any_value(project_id) AS project_id, any_value(kind) IN (0, 1) AS success, count(*) AS parts,
  count(*) FILTER (WHERE kind IN (0, 1)) AS parts_stored,
  any_value(CASE kind WHEN 0 THEN 200 WHEN 1 THEN 201 WHEN 2 THEN 404 WHEN 3 THEN 500 END::INTEGER) AS status_code,
  any_value(CASE kind WHEN 2 THEN substr(repeat(n || ' records refused ', 40), 1, 500)
                      WHEN 3 THEN 'not now' WHEN 4 THEN 'connection refused' END) FILTER (WHERE part = 0) AS error,
  any_value(CASE kind WHEN 0 THEN '{"stored": ' || n || '}' WHEN 1 THEN '{}' END) FILTER (WHERE part = 0) AS response
FROM sent GROUP BY project""",
        "ground_truth_load": f"""
SELECT item_id + 1 AS gt_order, (item_id % 5)::VARCHAR AS id, {_title('text')} AS name,
       CASE WHEN item_id % 4 <> 0 THEN {_rest('text')} ELSE '' END AS description
FROM benchmark
WHERE item_id + 1 > 2 AND item_id % 7 <> 0 AND item_id % 5 <> 0 AND item_id % 6 <> 0
  AND {_title('text')} <> ''""",
        "saved_requirements": f"""
WITH {RECORDS} SELECT source AS project, upper(source) || '-' || lpad(n::VARCHAR, greatest(3, length(n::VARCHAR))::INTEGER, '0') AS requirement_id,
  title, type
FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM recs)""",
        "extract_flow": EXTRACT_FLOW,
        "extract_resumed": EXTRACT_FLOW,
        "extract_trained": FIRST_LINES + f""",
{LABELLED.strip()},
examples AS MATERIALIZED (
  SELECT doc_id, label, unnest({_words('lower(text)')}) AS word FROM scored JOIN documents USING (doc_id)
),
counted AS (
  SELECT word, count(*) FILTER (WHERE label = 'yes') AS yes, count(*) FILTER (WHERE label = 'no') AS no
  FROM examples GROUP BY 1
),
totals AS (SELECT sum(yes) AS yes, sum(no) AS no, count(*) AS words FROM counted),
weights AS MATERIALIZED (
  SELECT word, ln((c.yes + 1) / (t.yes + t.words)) - ln((c.no + 1) / (t.no + t.words)) AS weight
  FROM counted c, totals t
),
base AS (
  SELECT ln(count(*) FILTER (WHERE label = 'yes') + 1) - ln(count(*) FILTER (WHERE label = 'no') + 1) AS start
  FROM scored
),
said AS (
  SELECT doc_id, chunk_no, unnest({_words("lower(title || ' - ' || description)")}) AS word FROM found
),
summed AS (SELECT doc_id, chunk_no, sum(weight) AS weight FROM said JOIN weights USING (word) GROUP BY 1, 2)
SELECT doc_id, chunk_no, row_number() OVER (ORDER BY doc_id, chunk_no) AS cand_order, title,
  CASE WHEN {_noise("title || ' ' || description")} THEN 'noise'
       WHEN start + coalesce(weight, 0) > 0 THEN 'accepted' ELSE 'rejected' END AS status,
  CASE WHEN NOT {_noise("title || ' ' || description")} THEN 'trained classifier' END AS reason
FROM found LEFT JOIN summed USING (doc_id, chunk_no), base""",
        "flow_stage_counts": EXTRACTED + """
counts AS (
  SELECT (SELECT count(*) FROM documents) AS pages, (SELECT count(*) FROM chunks) AS chunks,
    (SELECT count(*) FROM chunks WHERE too_short) AS skipped, (SELECT count(*) FROM recs) AS accepted,
    (SELECT count(*) FROM numbered) - (SELECT count(*) FROM recs) AS filtered,
    (SELECT count(*) FROM kept) AS "unique",
    (SELECT count(*) FROM kept JOIN recs USING (doc_id) WHERE length(title) % 9 <> 0) AS enriched,
    (SELECT count(*) FROM kept JOIN recs USING (doc_id) WHERE length(title) % 9 = 0) AS failed
)
UNPIVOT counts ON COLUMNS(*) INTO NAME stage VALUE rows""",
        "documents_from_files": """
SELECT coalesce(lang, '__HIVE_DEFAULT_PARTITION__') AS lang, line AS text, count(*) AS pages, 0::BIGINT AS errors
FROM (SELECT lang, unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL)
GROUP BY 1, 2""",
        "rendered_prompts": f"""
WITH {RECORDS}
SELECT doc_id, 'Title: ' || title || chr(10) || 'Text: ' || description || chr(10) || 'Kind: ['
    || CASE WHEN doc_id % 4 <> 0 THEN type ELSE '' END || '], ' || title || ' again; {{other}} stays' AS prompt,
  title || ' - ' || description AS shown
FROM recs""",
        "parts_by_bytes": f"""
WITH {RECORDS},
named AS (
  SELECT source AS project, doc_id, title, description, type,
    upper(source) || '-' || lpad(n::VARCHAR, greatest(3, length(n::VARCHAR))::INTEGER, '0') AS requirement_id
  FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM recs)
),
sized AS (
  SELECT *, strlen(to_json(struct_pack(title, description, type, requirement_id))::VARCHAR) + 1 AS size FROM named
),
placed AS (
  SELECT *, ((sum(size) OVER (PARTITION BY project ORDER BY doc_id) - size) // 4095)::BIGINT AS bin, size > 4095 AS long
  FROM sized
),
parts AS (
  SELECT project, bin, long, (sum(size) + 1)::BIGINT AS bytes, count(*) AS records,
    arg_min(requirement_id, doc_id) AS first_id
  FROM placed GROUP BY ALL
)
SELECT project, row_number() OVER (PARTITION BY project ORDER BY bin, long) - 1 AS part, bytes, records, first_id
FROM parts""",
        "finalise_flow": f"""
WITH RECURSIVE {SURVIVORS},
numbered AS (
  SELECT doc_id, title, length(title) % 9 <> 0 AS ok, row_number() OVER (ORDER BY doc_id) AS n,
         least(4000, length(text)) AS chars
  FROM kept JOIN recs USING (doc_id) JOIN documents USING (doc_id)
)
SELECT doc_id, 'ALL-' || lpad(n::VARCHAR, greatest(3, length(n::VARCHAR))::INTEGER, '0') AS requirement_id,
  title AS short_title, CASE WHEN ok THEN chars::VARCHAR ELSE '' END AS context_chars,
  CASE WHEN ok THEN 'medium' ELSE 'low' END AS confidence, ok AS validation_confirmed
FROM numbered""",
    }
