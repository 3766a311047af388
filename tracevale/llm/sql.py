"""DuckDB SQL for the operators' queries, where SQL can say it."""

from .license_scan import EQUAL, NOTICES, TEXTS, digests

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WS = r"[\x20\x09-\x0D]"

DECONTAMINATION = rf"""
WITH dw AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
iw AS (SELECT item_id, w, least(len(w), 10) AS n FROM (SELECT item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark) WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, n, array_to_string(w[o:o + n - 1], ' ') AS k FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS o FROM iw)),
sizes AS (SELECT DISTINCT n FROM win),
grams AS (SELECT doc_id, n, s, array_to_string(w[s:s + n - 1], ' ') AS k FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM dw, sizes WHERE len(w) >= n)),
hits AS (SELECT doc_id, item_id, n, s FROM grams JOIN win USING (n, k)),
hit_words AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(s, s + n)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN hit_words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

LINE_DEDUP = rf"""
WITH docs AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, pos, lines[pos] AS line, translate(regexp_replace(lines[pos], '^{_WS}+|{_WS}+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
      FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS pos FROM docs)),
bad AS (SELECT k, max(doc_id) AS keeper FROM l WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
judged AS (SELECT doc_id, pos, line, keeper IS NOT NULL AND keeper <> doc_id AS gone FROM l LEFT JOIN bad USING (k))
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""

TOP_K = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM r WHERE n <= 20
"""

def near_duplicates(shingle: int, percent: int, kept: bool = False, counts: bool = False) -> str:
    more = ", w.doc_id = min(r.reached) AS kept" if kept else ""
    if counts:
        more += """, coalesce((SELECT count(DISTINCT y.s) FROM e JOIN s x ON x.doc_id = e.u JOIN s y ON y.doc_id = e.v WHERE e.u = w.doc_id AND x.s <> y.s), 0) AS n_links,
       coalesce((SELECT count(*) - 1 FROM s x JOIN s y ON x.s = y.s WHERE x.doc_id = w.doc_id HAVING count(*) > 0), 0) AS n_copies"""
    return rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < {shingle} THEN array_to_string(w, ' ') ELSE array_to_string(w[o:o + {shingle - 1}], ' ') END AS k
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {shingle - 1}, 1) + 1)) AS o FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
s AS (SELECT doc_id, md5(string_agg(k, chr(31) ORDER BY k)) AS s FROM g GROUP BY doc_id),
rare AS (SELECT k FROM g GROUP BY k HAVING count(*) >= 2),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM g a JOIN rare USING (k) JOIN g b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= {percent} * (x.n + y.n - shared)),
e AS (SELECT a AS u, b AS v FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS node, doc_id AS reached FROM w UNION SELECT e.v, r.reached FROM r JOIN e ON e.u = r.node)
SELECT w.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.reached) AS component_id{more}
FROM w LEFT JOIN n USING (doc_id) JOIN r ON r.node = w.doc_id GROUP BY w.doc_id
"""


SUBSTRING_DEDUP = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, o, sha256(array_to_string(w[o:o + 19], ' ')) AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS o FROM w WHERE len(w) >= 20)),
late AS (SELECT doc_id, o FROM (SELECT doc_id, o, row_number() OVER (PARTITION BY k ORDER BY doc_id, o) AS n FROM g) WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(o, o + 20)) AS p FROM late),
kept AS (SELECT doc_id, list(x.w[x.p] ORDER BY x.p) AS kept, count(*) AS n FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM w) x ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(array_to_string(kept, ' '), '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""

COLLOCATIONS = rf"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_LOWER}, '[.,;:!?\x0A-\x0D]')) AS p FROM documents),
x AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM p),
n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM x GROUP BY lang),
g AS (SELECT lang, w[o] AS a, w[o + 1] AS b, w[o + 2] AS c FROM (SELECT lang, w, unnest(range(1, len(w) + 1)) AS o FROM x)),
f1 AS MATERIALIZED (SELECT lang, a, count(*) AS f FROM g GROUP BY ALL),
f2 AS MATERIALIZED (SELECT lang, a, b, count(*) AS f FROM g WHERE b IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
f3 AS MATERIALIZED (SELECT lang, a, b, c, count(*) AS f FROM g WHERE c IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
cuts AS (
  SELECT f2.lang, f2.a || ' ' || f2.b AS phrase, 1 AS j, f2.f AS a, x.f AS l, y.f AS r FROM f2 JOIN f1 x ON x.lang = f2.lang AND x.a = f2.a JOIN f1 y ON y.lang = f2.lang AND y.a = f2.b
  UNION ALL SELECT f3.lang, f3.a || ' ' || f3.b || ' ' || f3.c, 1, f3.f, x.f, y.f FROM f3 JOIN f1 x ON x.lang = f3.lang AND x.a = f3.a JOIN f2 y ON y.lang = f3.lang AND y.a = f3.b AND y.b = f3.c
  UNION ALL SELECT f3.lang, f3.a || ' ' || f3.b || ' ' || f3.c, 2, f3.f, x.f, y.f FROM f3 JOIN f2 x ON x.lang = f3.lang AND x.a = f3.a AND x.b = f3.b JOIN f1 y ON y.lang = f3.lang AND y.a = f3.c),
s AS (SELECT *, (1000000::HUGEINT * a * a) // (l::HUGEINT * r) AS score FROM cuts),
one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) AS nth FROM s) WHERE nth = 1),
inside AS (SELECT lang, phrase, max(f) AS longer FROM (SELECT lang, a || ' ' || b AS phrase, f FROM f3 UNION ALL SELECT lang, b || ' ' || c, f FROM f3) GROUP BY lang, phrase),
kept AS (SELECT one.* FROM one LEFT JOIN inside USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 50 * a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM ranked JOIN n USING (lang) WHERE rank <= 2000
"""

# the pages' articles hold headings and paragraphs of plain text only
HTML_EXTRACTION = r"""
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)(</article>|$)', 1) AS h FROM pages),
b AS (SELECT page_id, url, list_transform(string_split_regex(h, '</?(p|h1)>'), lambda x: regexp_replace(x, '</?b>', '', 'g')) AS b FROM a),
t AS (SELECT page_id, url, list_transform(b, lambda x: trim(regexp_replace(html_unescape_plain(x), '\s+', ' ', 'g'))) AS b FROM b)
SELECT page_id, url, array_to_string(list_filter(b, lambda x: x <> ''), chr(10) || chr(10)) AS text, length(array_to_string(list_filter(b, lambda x: x <> ''), chr(10) || chr(10))) AS n_chars FROM t
""".replace("html_unescape_plain(x)", "replace(replace(replace(replace(replace(x, '<br>', ' '), '&quot;', chr(34)), '&lt;', '<'), '&gt;', '>'), '&amp;', '&')")


def _values(pairs: list[tuple[str, str]]) -> str:
    return ", ".join(f"('{d}', '{name}')" for d, name in pairs)


def license_scan() -> str:
    def form(x: str) -> str:
        x = f"regexp_replace(translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '(?m)^[ \\t]*(?:copyright|\\(c\\)|©)[^\\n]*$', ' ', 'g')"
        x = f"regexp_replace({x}, '[^a-z0-9\\x{{80}}-\\x{{10FFFF}}]+', ' ', 'g')"
        for a, b in EQUAL.items():
            x = f"regexp_replace({x}, '\\b{a}\\b', '{b}', 'g')" if a != b else x
        return f"trim({x})"

    notices = [(d, NOTICES[t]) for d, t in digests({t: t for t in NOTICES})]
    return f"""
WITH known(digest, license_id) AS (VALUES {_values(digests(TEXTS) + notices)}),
notice(digest, license_id) AS (VALUES {_values(notices)}),
d AS (SELECT doc_id, sha256({form("coalesce(text, '')")}) AS digest FROM documents),
l AS (SELECT doc_id, sha256({form("line")}) AS digest FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents)),
n AS (SELECT doc_id, string_agg(DISTINCT license_id, ',' ORDER BY license_id) AS ids, count(*) AS n FROM l JOIN (SELECT DISTINCT * FROM notice) USING (digest) GROUP BY doc_id)
SELECT doc_id, d.digest AS canonical_sha256, license_id, coalesce(ids, '') AS notice_ids, coalesce(n, 0) AS n_notices
FROM d LEFT JOIN (SELECT DISTINCT * FROM known) USING (digest) LEFT JOIN n USING (doc_id)
"""
