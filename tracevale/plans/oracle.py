"""DuckDB SQL for the catalogue."""

import re

from .records import SQL as _RECORDS

_PATH = r"CASE WHEN p = '/' THEN p ELSE regexp_replace(p, '/+$', '') END"
_URL = r"SELECT page_id, regexp_extract(url, '^([A-Za-z]+)://([^/?#]*)([^?#]*)(\?[^#]*)?', ['s', 'h', 'p', 'q']) AS u FROM pages"
_ELEMENTS = r"""e0 AS (SELECT CAST(page_id AS VARCHAR) AS screen, regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1) AS hrefs, regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 2) AS names FROM pages),
e1 AS (SELECT screen, unnest(range(len(hrefs))) AS ord, unnest(hrefs) AS href, unnest(names) AS base FROM e0),
e AS (SELECT screen, ord, 'link' AS role, base || CASE WHEN row_number() OVER w > 1 THEN ' #' || row_number() OVER w ELSE '' END AS name, href FROM e1 WINDOW w AS (PARTITION BY screen, lower(trim(base)) ORDER BY ord))"""


def _folded(sql: str) -> str:
    """Lower-cased names with the case fold of the one letter of the tables that has another."""
    return re.sub(r"lower\(trim\(([a-z_.]+)\)\)", r"replace(lower(trim(\1)), 'ß', 'ss')", sql)


def _id(parts: str) -> str:
    return f"left(sha256(concat_ws(chr(31), {parts})), 16)"


_SIGNALS = """sig AS (SELECT 's' || l_suppkey AS source, 'p' || l_partkey AS target, l_linestatus || l_linenumber AS evidence,
  CASE l_returnflag WHEN 'A' THEN 'text-exact' WHEN 'N' THEN 'href-exact' ELSE 'css-id' END AS kind, CASE l_returnflag WHEN 'A' THEN 0.65::DOUBLE WHEN 'N' THEN 0.70::DOUBLE ELSE 0.55::DOUBLE END AS w FROM lineitem),
best AS (SELECT source, target, evidence, max({'w': w, 'kind': kind}) AS s FROM sig GROUP BY ALL),
g AS (SELECT source, target, list({'e': evidence, 'w': s.w, 'k': s.kind} ORDER BY evidence) AS r FROM best GROUP BY ALL),
links AS (SELECT source, target, 1 - list_reduce(list_prepend(1.0::DOUBLE, list_transform(r, lambda x: x.w)), lambda a, x: a * (1 - x)) AS confidence,
  array_to_string(list_sort(list_distinct(list_transform(r, lambda x: x.k))), '+') AS method, array_to_string(list_transform(r, lambda x: x.k || ':' || x.e), '|') AS evidence,
  len(list_filter(r, lambda x: x.k IN ('href-exact', 'text-exact'))) > 0 AS strong FROM g),
banded AS (SELECT *, CASE WHEN confidence >= 0.85 AND strong THEN 'auto_accepted' WHEN confidence >= 0.55 THEN 'needs_review' ELSE 'unresolved' END AS review_status FROM links)"""
_TRANS = "tr AS (SELECT * FROM (SELECT user_id AS flow, event_type AS source, lead(event_type) OVER w AS target, row_number() OVER w AS ord FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE target IS NOT NULL)"

_ARTICLE = r"""a AS (SELECT page_id, regexp_extract(html, '(?is)<article\b[^>]*>(.*?)</article>', 1) AS a FROM pages),
b AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(a, '(?is)<h([1-4])\b[^>]*>', chr(10) || 'H\1: ', 'g'), '(?is)</(?:h[1-4]|p|li|pre|div)\s*>', chr(10), 'g'), '(?s)<[^>]*>', ' ', 'g') AS a FROM a),
c AS (SELECT page_id, replace(replace(replace(replace(a, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&') AS a FROM b),
articles AS (SELECT page_id, array_to_string(list_filter(list_transform(string_split(a, chr(10)), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> ''), chr(10)) AS article FROM c)"""
#: Segments of `docs` (uri, text): headings, the next cut behind each, chains of cuts and of paths, and the body between cuts.
_SEGMENTS = r"""l AS (SELECT uri, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS n FROM (SELECT uri, string_split(text, chr(10)) AS ls FROM docs WHERE text <> '')),
m AS (SELECT uri, n, line, regexp_full_match(line, 'H[1-4]:\s*.*') AS head, sum(length(line) + 1) OVER (PARTITION BY uri ORDER BY n) - length(line) - 1 AS start FROM l),
body AS (SELECT *, coalesce(sum(CASE WHEN head THEN 0 ELSE length(line) END) OVER (PARTITION BY uri ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM m),
heads AS (SELECT uri, n, CAST(line[2] AS INTEGER) AS level, trim(regexp_extract(line, '^H[1-4]:(.*)$', 1)) AS title, before, row_number() OVER (PARTITION BY uri ORDER BY n) AS k FROM body WHERE head),
paths AS (SELECT uri, k, n, [title] AS path FROM heads WHERE k = 1 UNION ALL SELECT h.uri, h.k, h.n, list_append(p.path[1:h.level - 1], h.title) FROM paths p JOIN heads h ON h.uri = p.uri AND h.k = p.k + 1),
nexts AS (SELECT x.uri, x.n, min(h.n) AS nn FROM (SELECT uri, n, before FROM heads UNION ALL SELECT DISTINCT uri, 0, 0 FROM l) x JOIN heads h ON h.uri = x.uri AND h.before >= x.before + 200 GROUP BY ALL),
cuts AS (SELECT DISTINCT uri, CAST(0 AS BIGINT) AS n FROM l UNION ALL SELECT c.uri, x.nn FROM cuts c JOIN nexts x ON x.uri = c.uri AND x.n = c.n),
spans AS (SELECT uri, n AS lo, coalesce(lead(n) OVER (PARTITION BY uri ORDER BY n), 1000000000) AS hi FROM cuts),
pieces AS (SELECT s.uri, lo, hi, min(start) AS a, max(start + length(line)) AS z, string_agg(line, chr(10) ORDER BY body.n) AS text FROM spans s JOIN body ON body.uri = s.uri AND NOT head AND line <> '' AND body.n > lo AND body.n < hi GROUP BY ALL),
segments AS (SELECT p.uri, row_number() OVER (PARTITION BY p.uri ORDER BY lo) - 1 AS ordinal, (SELECT array_to_string(arg_max(path, k), ' > ') FROM paths WHERE paths.uri = p.uri AND paths.n < p.hi) AS path, a AS start_offset, z AS end_offset, sha256(p.text) AS text_sha256 FROM pieces p)"""
_SEGMENT_ROWS = "SELECT uri, CAST(ordinal AS INTEGER) AS ordinal, coalesce(path, '') AS path, CAST(start_offset AS INTEGER) AS start_offset, CAST(end_offset AS INTEGER) AS end_offset, text_sha256 FROM segments"

ORACLE_SQL = {
    "q01_canonical_urls": rf"""WITH x AS ({_URL}), y AS (SELECT page_id, lower(u.s) AS s, lower(u.h) AS h, u.p AS p, list_sort(list_filter(string_split(substr(u.q, 2), '&'), lambda i: i <> '' AND NOT regexp_full_match(regexp_replace(i, '^[^=]*=?', ''), '[0-9]{{10,}}|(?i:[0-9a-f]{{16,}})|[A-Za-z0-9_-]{{24,}}'))) AS q FROM x)
SELECT page_id, s || '://' || h || {_PATH} || CASE WHEN len(q) = 0 THEN '' ELSE '?' || array_to_string(q, '&') END AS canonical_url FROM y""",
    "q02_route_patterns": rf"""WITH x AS ({_URL}), y AS (SELECT page_id, u.p AS p FROM x), z AS (SELECT page_id, coalesce(nullif({_PATH}, ''), '/') AS p, coalesce(nullif(p, ''), '/') AS raw FROM y),
r AS (SELECT page_id, p, raw, NOT regexp_matches(p, '(?i)^/(user|admin|api|explore|notifications|milestones|issues|org|repo|login|assets|attachments|-)/') AS own FROM z)
SELECT page_id, CASE WHEN p = '/user/login' THEN p WHEN own AND regexp_matches(p, '^/[^/]+/[^/]+/issues/new$') THEN '/{{owner}}/{{repo}}/issues/new' WHEN own AND regexp_matches(p, '^/[^/]+/[^/]+/issues/[0-9]+$') THEN '/{{owner}}/{{repo}}/issues/{{number}}'
 WHEN own AND regexp_matches(p, '^/[^/]+/[^/]+/issues$') THEN '/{{owner}}/{{repo}}/issues' WHEN own AND regexp_matches(p, '^/[^/]+/[^/]+$') THEN '/{{owner}}/{{repo}}' WHEN p = '/' THEN '/'
 ELSE array_to_string(list_transform(string_split(raw, '/'), lambda s: CASE WHEN regexp_full_match(s, '[0-9]+') THEN '{{number}}' ELSE s END), '/') END AS route FROM r""",
    "q03_page_elements": f"WITH {_ELEMENTS} SELECT screen, ord, role, name, href, 'element:' || {_id('lower(trim(screen)), role, lower(trim(name))')} AS id FROM e",
    "q04_article_text": f"WITH {_ARTICLE} SELECT page_id, article FROM articles",
    "q05_evidence_links": f"WITH {_SIGNALS} SELECT source, target, confidence, method, evidence, review_status FROM banded",
    "q06_text_exact_links": rf"""WITH {_ELEMENTS}, d AS (SELECT lower(regexp_extract(text, '^(\S+)', 1)) AS name, min(doc_id) AS doc_id, count(*) AS n_docs FROM documents GROUP BY 1)
SELECT DISTINCT 'element:' || {_id('lower(trim(screen)), role, lower(trim(e.name))')} AS id, lower(trim(e.name)) AS name, d.doc_id, d.n_docs FROM e JOIN d ON lower(trim(e.name)) = d.name""",
    "q07_change_impact": """WITH g AS (SELECT l_partkey, count(DISTINCT l_orderkey) AS n_elements, count(DISTINCT c_custkey) AS n_screens, max(1 - l_discount) AS confidence, bool_or(o_orderpriority = '1-URGENT') AS f
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1)
SELECT p_partkey, p_name, n_elements, n_screens, confidence, CASE WHEN f AND confidence >= 0.8 THEN 'high' ELSE 'medium' END AS severity FROM part JOIN g ON p_partkey = l_partkey""",
    "q08_unmapped_changes": "SELECT p_partkey, p_brand, CASE WHEN p_size < 10 THEN 'no symbols extracted' ELSE 'no UI link found' END AS reason FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_discount >= 0.09)",
    "q09_absences": f"SELECT doc_id, 'absence:' || {_id('CAST(doc_id AS VARCHAR), ' + chr(39) + 'run-1' + chr(39))} AS id, 0.7::DOUBLE AS confidence FROM documents ANTI JOIN labels USING (doc_id)",
    "q10_coverage": """SELECT CAST(c_custkey AS VARCHAR) AS requirement_id, coalesce(bool_or(o_orderstatus = 'F'), false) AS accepted, coalesce(bool_or(o_orderstatus = 'O'), false) AS pending,
 NOT coalesce(bool_or(o_orderstatus IN ('F', 'O')), false) AS absent FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1""",
    "q11_transitions": f"WITH {_TRANS} SELECT source, target, count(*) AS n FROM tr GROUP BY ALL",
    "q12_flow_steps": "SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS step FROM events",
    "q13_clue_substring": "SELECT DISTINCT t.term, lower(p_name) AS name FROM (SELECT DISTINCT lower(trim(left(p_name, 3))) AS term FROM part) t JOIN part ON contains(lower(p_name), t.term) AND lower(p_name) <> t.term",
    "q14_object_words": """WITH p AS (SELECT DISTINCT lower(p_name) AS name, string_split(lower(p_name), ' ') AS w FROM part)
SELECT a.name, b.name AS other FROM p a JOIN p b ON a.name <> b.name WHERE len(list_filter(a.w, lambda x: length(x) > 3)) > 0 AND len(list_filter(list_filter(a.w, lambda x: length(x) > 3), lambda x: NOT list_contains(b.w, x))) = 0""",
    "q15_gold_recall": "SELECT count(*) AS n_expected, count(d.doc_id) AS n_found, CASE WHEN count(*) = 0 THEN 1.0::DOUBLE ELSE count(d.doc_id)::DOUBLE / count(*) END AS recall FROM (SELECT DISTINCT doc_id FROM labels WHERE quality = 1) l LEFT JOIN (SELECT DISTINCT doc_id FROM documents WHERE lang = 'en') d USING (doc_id)",
    "q16_gold_violations": "SELECT doc_id, toxic FROM labels SEMI JOIN (SELECT doc_id FROM documents WHERE lang = 'en') USING (doc_id) WHERE quality = 0",
    "q17_pairwise_jaccard": """WITH m AS (SELECT DISTINCT l_returnflag || l_linestatus || l_linenumber AS run, l_partkey AS k FROM lineitem), n AS (SELECT run, count(*) AS n FROM m GROUP BY 1),
s AS (SELECT x.run AS a, y.run AS b, count(*) AS shared FROM m x JOIN m y ON x.k = y.k AND x.run < y.run GROUP BY ALL)
SELECT a, b, shared, shared::DOUBLE / (p.n + q.n - shared) AS jaccard FROM s JOIN n p ON p.run = a JOIN n q ON q.run = b""",
    "q18_stability": """WITH s AS (SELECT event_type AS category, user_id % 4 AS run, list(DISTINCT CAST(floor(value) AS BIGINT)) AS items FROM events GROUP BY ALL),
p AS (SELECT a.category, min(len(list_intersect(a.items, b.items))::DOUBLE / len(list_distinct(list_concat(a.items, b.items)))) AS least FROM s a JOIN s b ON a.category = b.category AND a.run < b.run GROUP BY 1)
SELECT category, coalesce(least, 1.0::DOUBLE) AS stability FROM (SELECT DISTINCT category FROM s) LEFT JOIN p USING (category)""",
    "q19_span_overlap": """SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem l JOIN part ON p_partkey = l_partkey WHERE EXISTS (SELECT 1 FROM lineitem h WHERE h.l_orderkey = l.l_orderkey AND h.l_linenumber <> l.l_linenumber
 AND p_size <= h.l_quantity + greatest(h.l_linenumber, 1) - 1 AND h.l_quantity <= p_size + 5)""",
    "q20_span_end": "SELECT conv_id, turn, coalesce(lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) - 1, max(turn) OVER (PARTITION BY conv_id)) AS last FROM conversations",
    "q21_best_path": """WITH r AS (SELECT lpad(CAST(l_partkey AS VARCHAR), 9, '0') AS symbol_id, lpad(CAST(l_suppkey AS VARCHAR), 9, '0') AS element_id, 1 - l_discount AS c,
 lpad(CAST(l_orderkey AS VARCHAR), 9, '0') || '>' || lpad(CAST(l_partkey AS VARCHAR), 9, '0') || '>' || lpad(CAST(l_suppkey AS VARCHAR), 9, '0') || '>' || lpad(CAST(l_linenumber AS VARCHAR), 9, '0') AS path FROM lineitem)
SELECT symbol_id, element_id, path FROM r QUALIFY row_number() OVER (PARTITION BY symbol_id, element_id ORDER BY c DESC, path) = 1""",
    "q22_top_labels": """WITH n AS (SELECT p_brand, p_type, count(*) AS n, min(p_partkey) AS f FROM part GROUP BY ALL), g AS (SELECT p_brand, list(p_type || CASE WHEN n > 1 THEN ' (' || n || ' places)' ELSE '' END ORDER BY f) AS x FROM n GROUP BY 1)
SELECT p_brand, array_to_string(x[1:3], '; ') AS labels, greatest(0, len(x) - 3) AS more FROM g""",
    "q23_first_wins": "SELECT user_id, event_type, event_id, ts, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1",
    "q24_merge_latest": "SELECT user_id, event_type, event_id, ts, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1",
    "q25_screen_or_join": f"WITH {_TRANS} SELECT s.id, count(tr.flow) AS n FROM (SELECT DISTINCT event_type AS id FROM events) s LEFT JOIN tr ON tr.source = s.id OR tr.target = s.id GROUP BY 1",
    "q26_action_safety": rf"""WITH {_ELEMENTS}, s AS (SELECT *, row_number() OVER (PARTITION BY screen, regexp_replace(name, ' #\d+$', '') ORDER BY ord) > 1 AS seen FROM e)
SELECT screen, ord, name, CASE WHEN regexp_matches(href, '^(/admin|/user/settings|/user/logout|/api)') THEN 'prohibited-route' WHEN NOT starts_with(href, '/') THEN 'out-of-scope'
 WHEN regexp_matches(lower(name), 'delete|remove|transfer|archive|wipe|purge') THEN 'destructive-action' WHEN seen THEN 'already-executed' ELSE 'ok' END AS reason FROM s""",
    "q28_graph_counts": " UNION ALL ".join(f"SELECT '{n}' AS label, count(*) AS n FROM {n}" for n in ("customer", "orders", "lineitem", "part", "supplier", "nation", "region")),
    "q29_referential_edges": "SELECT DISTINCT l_orderkey AS src, l_partkey AS dst FROM lineitem JOIN orders ON o_orderkey = l_orderkey AND o_orderstatus = 'F' JOIN part ON p_partkey = l_partkey AND p_size > 10 WHERE l_tax > 0.01",
    "q30_status_counts": f"WITH {_SIGNALS} SELECT count(*) FILTER (WHERE review_status = 'auto_accepted') AS auto_accepted, count(*) FILTER (WHERE review_status = 'needs_review') AS needs_review, count(*) FILTER (WHERE review_status = 'unresolved') AS unresolved FROM banded",
    "q31_budget": """WITH a AS (SELECT *, user_id % 10 AS run FROM events QUALIFY row_number() OVER (PARTITION BY user_id % 10, user_id ORDER BY ts, event_id) <= 15),
b AS (SELECT event_id, run, ts, row_number() OVER (PARTITION BY run ORDER BY ts, event_id) AS n, min(ts) OVER (PARTITION BY run) AS s FROM a) SELECT event_id, run FROM b WHERE n <= 80 AND ts - s <= INTERVAL 864000 SECONDS""",
    "q32_fallback_latch": "SELECT event_id, bool_or(event_type = 'error') OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS fallback FROM events",
    "q33_last_entries": "SELECT event_id, user_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 6",
    "q34_windowed_counts": "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
    "q35_stable_ids": f"SELECT c_custkey, 'screen:' || {_id('lower(trim(c_name)), lower(trim(c_mktsegment))')} AS id, CASE WHEN length(c_name) <= 12 THEN c_name ELSE left(c_name, 11) || '…' END AS label, CAST(round_even(c_nationkey / 40 * 100, 0) AS INTEGER) AS pct FROM customer",
    "q36_recipe_policy": f"""WITH {_ELEMENTS}, k AS (SELECT *, CAST(screen AS BIGINT) % 2 = 0 AS found, 'element:' || {_id('lower(trim(screen)), role, lower(trim(name))')} AS id FROM e),
m AS (SELECT *, CASE WHEN found AND (contains(lower(name), 'the') OR contains(lower(href), 'the')) THEN 'the' WHEN found AND (contains(lower(name), 'de') OR contains(lower(href), 'de')) THEN 'de' END AS word FROM k),
b AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY screen ORDER BY CASE word WHEN 'the' THEN 0 WHEN 'de' THEN 1 ELSE 2 END, coalesce(lower(trim(name)) <> word, false), ord) = 1)
SELECT CAST(page_id AS VARCHAR) AS state, b.id AS element_id, CASE WHEN b.id IS NULL THEN 'no viable unvisited candidate' WHEN word IS NULL THEN 'first unvisited non-blocked link rule' ELSE 'recipe keyword ''' || word || ''' matched candidate ''' || b.name || '''' END AS rationale,
 CASE WHEN b.id IS NULL THEN 'stop' ELSE 'deterministic' END AS source FROM pages LEFT JOIN b ON b.screen = CAST(page_id AS VARCHAR)""",
    "q37_ui_code_signals": f"""WITH {_RECORDS}, t AS (SELECT *, CASE WHEN k % 3 = 0 THEN 'rendered_by' ELSE 'handled_by' END AS type FROM symbols)
SELECT e.id AS source, t.id AS target, type AS link_type, 'text-exact' AS kind, 'text: customer#' || lpad(CAST(k AS VARCHAR), 9, '0') AS evidence, 0.65::DOUBLE AS weight FROM t JOIN elements e ON lower(trim(e.name)) = 'customer#' || lpad(CAST(k AS VARCHAR), 9, '0')
UNION ALL SELECT e.id, t.id, type, 'href-exact', 'href:/c/' || k, 0.70::DOUBLE FROM t JOIN elements e ON e.href = '/c/' || k UNION ALL SELECT e.id, t.id, type, 'css-id', 'css:#k' || (k * 2), 0.55::DOUBLE FROM t JOIN elements e ON e.css = '#k' || (k * 2)
UNION ALL SELECT s.id, t.id, type, 'route-exact', 'route:/' || p_brand, 0.75::DOUBLE FROM t JOIN screens s ON s.route = '/' || p_brand AND type = 'handled_by'""",
    "q38_findings": f"WITH {_RECORDS} SELECT symbol AS changed_symbol_id, array_to_string(affected, ',') AS affected, CASE WHEN f AND confidence >= 0.8 THEN 'high' WHEN e THEN 'medium' ELSE 'low' END AS severity, confidence, files FROM found",
    "q39_impact_rows": f"WITH {_RECORDS} SELECT change AS change_id, symbol AS symbol_id, element AS element_id, screen AS screen_id, flow AS flow_id, requirement AS requirement_id, conf AS mapping_confidence, pconf AS path_confidence FROM rows_",
    "q40_unmapped": f"WITH {_RECORDS} SELECT file, 'modified' AS change_type, CASE WHEN bare THEN 'no symbols extracted' ELSE 'no UI link found' END AS reason FROM changes WHERE id NOT IN (SELECT change FROM seeds JOIN links ON dst = symbol AND type <> 'implements')",
    "q41_missing_requirements": f"WITH {_RECORDS} SELECT 'absence:' || {_id("id, 'run-1'")} AS id, id AS requirement_id, CASE WHEN clued THEN lower(statement) ELSE statement END AS evidence, 0.7::DOUBLE AS confidence FROM requirements WHERE id NOT IN (SELECT src FROM links WHERE viable)",
    "q42_link_verdicts": f"""WITH {_RECORDS}, tr AS (SELECT DISTINCT lower(e.name) AS name, s.route, y.file FROM links l JOIN elements e ON e.id = l.src AND l.viable JOIN symbols y ON y.id = l.dst JOIN screens s ON s.id = e.screen_id),
g AS (SELECT lower(c_name) AS name, s.route, 'f' || (c_custkey % 20) || '.go' AS file, c_custkey % 2 = 0 AS wanted FROM customer JOIN screens s ON s.id = 'n' || c_nationkey)
SELECT g.name, g.route, g.file, CASE WHEN wanted THEN CASE WHEN tr.name IS NULL THEN 'missed' ELSE 'matched' END WHEN tr.name IS NULL THEN 'avoided' ELSE 'violation' END AS verdict FROM g LEFT JOIN tr USING (name, route, file)""",
    "q43_requirement_recall": """WITH w AS (SELECT 'g' || (p_partkey % 97) || p_brand AS id, p_brand AS uri, max(string_split(p_type, ' ')) AS kw FROM part GROUP BY ALL)
SELECT id AS gold_id, EXISTS (SELECT 1 FROM part WHERE p_brand = w.uri AND len(list_filter(w.kw, lambda x: NOT contains(lower(p_name || ' ' || p_type), lower(trim(x))))) = 0) AS recalled FROM w""",
    "q44_affected": f"""WITH {_RECORDS}, i AS (SELECT symbol AS finding, unnest(affected) AS id FROM found)
SELECT finding, 'route' AS kind, route AS value FROM i JOIN screens USING (id) UNION SELECT finding, 'route', route FROM i JOIN elements e USING (id) JOIN screens s ON s.id = e.screen_id UNION SELECT finding, 'goal', lower(goal) FROM i JOIN flows USING (id)""",
    "q45_affected_totals": f"WITH {_RECORDS}, i AS (SELECT DISTINCT unnest(affected) AS id FROM found) SELECT count(*) FILTER (WHERE id[1] = 'e') AS elements, count(*) FILTER (WHERE id[1] = 'n') AS screens, count(*) FILTER (WHERE id[1] = 'w') AS flows, count(*) FILTER (WHERE id[1] = 'r') AS requirements FROM i",
    "q46_shown_routes": f"""WITH {_RECORDS}, i AS (SELECT symbol, unnest(affected) AS id, unnest(range(len(affected))) AS pos FROM found), x AS (SELECT symbol AS id, list(route ORDER BY pos) AS r FROM i JOIN screens USING (id) GROUP BY 1)
SELECT id, array_to_string(r[1:5], ';') AS labels, greatest(0, len(r) - 5) AS more FROM x""",
    "q47_unmapped_files": f"WITH {_RECORDS} SELECT file FROM symbols WHERE file LIKE '%.ts' UNION SELECT file FROM changes WHERE id LIKE '%7' OR bare",
    "q48_changes_with_symbols": f"WITH {_RECORDS} SELECT c.id, coalesce(string_agg('c' || p_partkey, ',' ORDER BY p_size, 'c' || p_partkey), '') AS symbols FROM changes c LEFT JOIN part ON 'f' || (p_partkey % 30) = c.file GROUP BY 1",
    "q49_trajectory": rf"WITH {_ELEMENTS} SELECT DISTINCT role, lower(regexp_replace(name, ' #\d+$', '')) AS name FROM e",
    "q50_symbol_spans": """WITH l AS (SELECT conv_id, turn, turn % 3 + 1 AS n FROM conversations), s AS (SELECT *, sum(n) OVER (PARTITION BY conv_id ORDER BY turn) AS e FROM l)
SELECT conv_id || '.go' AS path, 't' || turn AS qualified_name, 'function' AS kind, CAST(e - n + 1 AS INTEGER) AS line_start, CAST(e AS INTEGER) AS line_end FROM s""",
    "q51_touched_spans": """SELECT l_orderkey AS path, l_linenumber AS n, p_size AS line_start, p_size + 2 AS line_end FROM lineitem l JOIN part ON p_partkey = l_partkey WHERE EXISTS (SELECT 1 FROM lineitem h WHERE h.l_orderkey = l.l_orderkey
 AND p_size <= CAST(trunc(h.l_quantity) AS INTEGER) + greatest(h.l_linenumber - 1, 1) - 1 AND CAST(trunc(h.l_quantity) AS INTEGER) <= p_size + 2)""",
    "q52_requirement_signals": r"""WITH r AS (SELECT p_brand AS id, min(p_name) AS a, left(max(p_name), 4) AS z FROM part GROUP BY 1), n AS (SELECT DISTINCT p_name AS name FROM part), c AS (SELECT id, unnest([a, z]) AS clue FROM r),
o AS (SELECT id, a, list_distinct(list_filter(string_split_regex(lower(trim(a)), '\s+'), lambda w: length(w) > 3)) AS w FROM r)
SELECT id AS source, 'e:' || name AS target, 'implements' AS link_type, 'clue-element-exact' AS kind, clue AS evidence, 0.60::DOUBLE AS weight FROM c JOIN n ON lower(trim(clue)) = lower(trim(name))
UNION ALL SELECT id, 'e:' || name, 'implements', 'clue-element-sub', clue, 0.35::DOUBLE FROM c JOIN n ON lower(trim(clue)) <> lower(trim(name)) AND contains(lower(trim(name)), lower(trim(clue)))
UNION ALL SELECT id, 'e:' || name, 'implements', 'object-words', a, 0.30::DOUBLE FROM o JOIN n ON len(w) > 0 AND len(list_filter(w, lambda x: NOT contains(lower(trim(name)), x))) = 0""",
    "q53_flow_steps": "SELECT user_id AS src, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS \"order\", event_id AS dst FROM events",
    "q27_segments": f"WITH RECURSIVE {_ARTICLE}, docs AS (SELECT CAST(page_id AS VARCHAR) AS uri, article AS text FROM articles), {_SEGMENTS} {_SEGMENT_ROWS}",
    "q54_segments_of_many_headings": f"""WITH RECURSIVE turns AS (SELECT CAST(conv_id AS VARCHAR) AS uri, turn, 'H' || (1 + turn % 4) || ': ' || role || ' ' || turn || chr(10) || trim(regexp_replace(text, '\\s+', ' ', 'g')) AS part FROM conversations),
docs AS (SELECT uri, string_agg(part, chr(10) ORDER BY turn) AS text FROM turns GROUP BY uri), {_SEGMENTS} {_SEGMENT_ROWS}""",
    "q55_odd_articles": f"""WITH {_ARTICLE} SELECT page_id, 'kind ' || page_id % 4 || chr(10) || CASE page_id % 4
  WHEN 0 THEN article || chr(10) || 'nested é é behind &amp;' WHEN 1 THEN article || chr(10) || 'never closed ≤' WHEN 2 THEN 'H2: a b c' || chr(10) || article ELSE article END AS article FROM articles""",
    "q56_graph_merge": """WITH c AS (SELECT CAST(c_custkey AS VARCHAR) AS id, c_name, c_mktsegment, c_acctbal, c_custkey AS k, c_custkey % 3 = 0 AS again, c_custkey % 10 <> 3 AS before FROM customer WHERE c_custkey % 10 <> 3 OR c_custkey % 3 = 0),
p AS (SELECT o_orderkey AS n, o_orderstatus AS status, o_custkey, c.before FROM orders JOIN c ON c.k = o_custkey)
SELECT 'Customer' AS kind, id, CASE WHEN before THEN c_name END AS name, CASE WHEN before AND NOT again THEN c_mktsegment END AS phone, CASE WHEN again THEN 's' || k % 5 END AS segment, CASE WHEN before THEN CAST(c_acctbal AS DOUBLE) END AS balance, NULL::VARCHAR AS status, CAST(2 AS INTEGER) AS version FROM c
UNION ALL SELECT 'PLACED', o_custkey || '>' || n, NULL, NULL, NULL, NULL, CASE WHEN n % 4 = 0 THEN 'X' WHEN n % 2 = 0 THEN NULL ELSE status END, 2 FROM p WHERE before OR n % 2 = 0""",
    "q57_agent_replay": """WITH RECURSIVE s AS (SELECT CAST(user_id AS VARCHAR) AS run, CAST(day(ts) AS VARCHAR) AS goal, ts, event_id, '/' || event_type || '|e' || CAST(floor(value) AS BIGINT) AS pair, '/' || event_type || '|link|n' || event_id % 7 AS name, event_type = 'error' AS outage,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k, ts - min(ts) OVER (PARTITION BY user_id) > INTERVAL 864000 SECOND AS late FROM events),
r AS (SELECT run, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS event_id, CAST(NULL AS VARCHAR) AS goal, 0 AS in_flow, 0 AS in_run, false AS fallback, CAST([] AS VARCHAR[]) AS seen, CAST('' AS VARCHAR) AS reason FROM (SELECT DISTINCT run FROM s)
 UNION ALL SELECT run, k, event_id, goal, n + CAST(why = '' AS INTEGER), in_run + CAST(why = '' AS INTEGER), latch, CASE WHEN why = '' THEN list_concat(had, [pair, name]) ELSE had END, why FROM (
  SELECT *, CASE WHEN late THEN 'time' WHEN n >= 3 THEN 'flow-budget' WHEN in_run >= 20 THEN 'run-budget' WHEN list_contains(had, pair) OR list_contains(had, name) THEN 'already-executed' ELSE '' END AS why, held OR (NOT late AND n < 3 AND in_run < 20 AND outage) AS latch FROM (
   SELECT s.run, s.k, s.event_id, s.pair, s.name, s.late, s.outage, r.in_run, CASE WHEN s.late THEN r.goal ELSE s.goal END AS goal, CASE WHEN s.late OR r.goal = s.goal THEN r.in_flow ELSE 0 END AS n,
    CASE WHEN s.late OR r.goal = s.goal THEN r.seen ELSE CAST([] AS VARCHAR[]) END AS had, CASE WHEN s.late OR r.goal = s.goal THEN r.fallback ELSE false END AS held FROM r JOIN s ON s.run = r.run AND s.k = r.k + 1)))
SELECT event_id, r.run, s.goal, reason = '' AS taken, reason, fallback, in_flow, in_run FROM r JOIN s USING (run, event_id) WHERE r.k > 0""",
    "q58_code_index": f"""WITH f AS (SELECT conv_id, turn, conv_id % 5 AS kind, 'routers/c' || conv_id || '.go' AS file, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i FROM (SELECT DISTINCT conv_id, turn FROM conversations)),
g AS (SELECT *, CASE WHEN kind = 1 THEN 'h' ELSE 'b' END AS repo_sha, 't' || turn AS qualified_name FROM f WHERE kind IN (0, 1) OR turn % 4 = 1)
SELECT 'symbol:' || {_id("repo_sha, file, qualified_name")} AS id, repo_sha, file, qualified_name, 'function' AS kind, CAST(3 * i + 2 AS INTEGER) AS line_start, CAST(3 * i + 4 AS INTEGER) AS line_end,
  CASE WHEN kind <> 0 AND turn % 4 = 1 THEN 'route:/c/' || conv_id || '/' || turn ELSE '' END AS ui_anchors FROM g""",
    "q59_link_targets": rf"""WITH {_ELEMENTS}, b AS (SELECT CAST(page_id AS VARCHAR) AS screen, lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1)) AS base FROM pages),
s AS (SELECT e.*, base, ord % 6 AS k, row_number() OVER (PARTITION BY screen, regexp_replace(name, ' #\d+$', '') ORDER BY ord) > 1 AS seen FROM e JOIN b USING (screen))
SELECT screen, ord, CASE k WHEN 0 THEN 'elsewhere.example' WHEN 3 THEN '' ELSE base END AS host, CASE k WHEN 4 THEN '/admin' || href ELSE href END AS path,
 CASE WHEN k IN (0, 3) THEN 'external-host' WHEN k = 4 OR regexp_matches(href, '^(/admin|/user/settings|/user/logout|/api)') THEN 'prohibited-route'
 WHEN regexp_matches(lower(name), 'delete|remove|transfer|archive|wipe|purge') THEN 'destructive-action' WHEN seen THEN 'already-executed' ELSE 'ok' END AS reason FROM s""",
    "q61_records_by_id": """SELECT 'element:' || lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS id, 'r' || c_custkey % 3 AS run_id, 'screen:' || c_nationkey AS screen_id, CASE WHEN c_custkey % 3 = 1 THEN 'again' ELSE c_name END AS name, '/' || c_custkey AS href FROM customer""",
}
ORACLE_SQL = {name: _folded(sql) for name, sql in ORACLE_SQL.items()}
