"""DuckDB statements of the queries that SQL can express."""

from __future__ import annotations

from linesight.llm import collocations as C
from linesight.llm import license_scan as L
from linesight.llm import url_filter as U

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_filter(rules: list[tuple[str, str, str]], words: str) -> str:
    values = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in rules)
    return rf"""
WITH h AS (
  SELECT page_id, url, html,
         CASE WHEN instr(url, '://') > 0 THEN translate(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 1, 's'), '{UPPER}', '{LOWER}') ELSE '' END AS host,
         CASE WHEN instr(url, '://') > 0 THEN regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 2, 's') ELSE '' END AS path,
         regexp_extract(url, '^[^?#]*\?([^#]*)', 1, 's') AS query
  FROM pages),
c AS (
  SELECT *, regexp_replace(regexp_replace(regexp_replace(host, '^.*@', ''), ':(80|443)?$', ''), '^www\.', '') AS bare,
         list_sort(list_filter(string_split(query, '&'), lambda p: p <> '' AND NOT regexp_matches(p, '^(?:{U.TRACKING})(?:=|$)'))) AS kept
  FROM h),
k AS (
  SELECT *, CASE WHEN bare <> '' THEN bare || regexp_replace(path, '/+$', '') || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END END AS canon
  FROM c),
listed AS (SELECT DISTINCT canon FROM k WHERE canon IS NOT NULL AND regexp_matches(html, '\b({words})\b')),
rules(rule_host, rule_path, rule_verdict) AS (VALUES {values}),
best AS (
  SELECT k.page_id, max_by(rule_host || rule_path, length(rule_host || rule_path)) AS rule, max_by(rule_verdict, length(rule_host || rule_path)) AS verdict
  FROM k JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  GROUP BY k.page_id)
SELECT k.page_id, host, path, k.canon, best.rule AS rule,
       coalesce(best.verdict, CASE WHEN listed.canon IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM k LEFT JOIN best ON best.page_id = k.page_id LEFT JOIN listed ON listed.canon = k.canon"""


LINE_DEDUP = """
WITH l AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents),
n AS (SELECT doc_id, list_transform(l, lambda x: CASE WHEN trim(x) = '' THEN '' ELSE x END) AS l FROM l WHERE text IS NOT NULL),
p AS (SELECT doc_id, l, unnest(range(0, greatest(len(l) - 2, 1))) AS place FROM n),
w AS (SELECT doc_id, place, l[place + 1:place + 3] AS w FROM p),
v AS (SELECT * FROM w WHERE len(list_filter(w, lambda x: x <> '')) > 0),
r AS (SELECT w, min({'d': doc_id, 'p': place}) AS f FROM v GROUP BY w HAVING count(*) > 1),
s AS (SELECT v.doc_id, unnest(range(place, place + len(v.w))) AS line, v.doc_id = r.f.d AND v.place = r.f.p AS own
      FROM v JOIN r ON v.w = r.w),
g AS (SELECT doc_id, line FROM s GROUP BY doc_id, line HAVING NOT bool_or(own)),
gone AS (SELECT doc_id, list(line) AS gone FROM g GROUP BY doc_id)
SELECT l.doc_id,
       CASE WHEN gone IS NULL THEN text
            ELSE array_to_string(list_transform(list_filter(range(0, len(l)), lambda i: NOT list_contains(gone, i)), lambda i: l[i + 1]), chr(10)) END AS text,
       CAST(CASE WHEN text IS NULL THEN 0 ELSE len(l) END AS BIGINT) AS n_lines,
       CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed
FROM l LEFT JOIN gone ON gone.doc_id = l.doc_id"""


def license_scan() -> str:
    k = L.K
    lists = [L.word_list(text) for _, text in L.TEMPLATES]
    gram_values = ", ".join(f"('{' '.join(ws[p:p + k])}', {t}, {p})" for t, ws in enumerate(lists) for p in range(len(ws) - k + 1))
    names = ", ".join(f"({t}, '{L.TEMPLATES[t][0]}', {len(ws)})" for t, ws in enumerate(lists))
    phrases = ", ".join(f"('{p}', '{label}', {len(p.split())})" for p, label in L.PHRASES.items())
    return rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
pos AS (SELECT doc_id, w, unnest(range(0, len(w))) AS place FROM d),
phrases(phrase, label, n) AS (VALUES {phrases}),
b AS (SELECT doc_id, place, label FROM pos JOIN phrases ON array_to_string(w[place + 1:place + n], ' ') = phrase),
base AS (SELECT doc_id, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, list_sort(list_distinct(list(label))) AS labels FROM b GROUP BY doc_id),
grams(gram, template, t) AS (VALUES {gram_values}),
names(template, label, length) AS (VALUES {names}),
hits AS (SELECT doc_id, template, place, t, place - t AS diagonal FROM (SELECT doc_id, place, array_to_string(w[place + 1:place + {k}], ' ') AS gram FROM pos WHERE place + {k} <= len(w)) AS g JOIN grams USING (gram)),
diagonals AS (SELECT DISTINCT doc_id, template, diagonal FROM hits),
leaps AS (SELECT *, CASE WHEN diagonal - lag(diagonal) OVER o <= {L.MERGE} THEN 0 ELSE 1 END AS leap FROM diagonals WINDOW o AS (PARTITION BY doc_id, template ORDER BY diagonal)),
spans AS (SELECT *, sum(leap) OVER (PARTITION BY doc_id, template ORDER BY diagonal ROWS UNBOUNDED PRECEDING) AS span FROM leaps),
merged AS (SELECT doc_id, template, span, min(place) AS first, max(place) AS last, len(list_distinct(flatten(list(range(t, t + {k}))))) AS words FROM hits JOIN spans USING (doc_id, template, diagonal) GROUP BY doc_id, template, span),
enough AS (SELECT doc_id, template, span, label, length, words / length AS covered, last + {k} - first <= {L.STRETCH} * length + {L.MERGE} AS fits FROM merged JOIN names USING (template) WHERE words / length >= {L.COVERED}),
placed AS (SELECT doc_id, template, span, label, length, place, t FROM hits JOIN spans USING (doc_id, template, diagonal) JOIN enough USING (doc_id, template, span) WHERE NOT fits),
windows AS (SELECT h.doc_id, h.label, len(list_distinct(flatten(list(range(h.t, h.t + {k}))))) / any_value(h.length) AS covered
            FROM (SELECT DISTINCT doc_id, template, span, place FROM placed) AS s JOIN placed AS h ON h.doc_id = s.doc_id AND h.template = s.template AND h.span = s.span
             AND h.place >= s.place AND h.place + {k} - s.place <= {L.STRETCH} * h.length + {L.MERGE}
            GROUP BY h.doc_id, h.label, h.template, h.span, s.place),
checked AS (SELECT doc_id, label, covered FROM enough WHERE fits UNION ALL SELECT doc_id, label, covered FROM windows WHERE covered >= {L.COVERED}),
found AS (SELECT doc_id, list(label) AS labels, max(covered) AS score FROM checked GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
       coalesce(array_to_string(base.labels, ','), '') AS base_labels,
       coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(found.labels, [])))), ','), '') AS labels,
       coalesce(score, 0.0) AS score
FROM d LEFT JOIN base USING (doc_id) LEFT JOIN found USING (doc_id)"""


TOP_K = """
WITH v AS (
  SELECT vec_id, row_number() OVER () AS row_, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS x
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, q.row_ AS query_row, c.vec_id, CAST(list_dot_product(q.x, c.x) AS BIGINT) AS score
  FROM v AS q JOIN v AS c ON q.row_ <> c.row_ WHERE q.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_row ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5"""


NEAR_DEDUP = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[p + 1:p + 5], ' ') AS g FROM (SELECT doc_id, w, unnest(range(0, greatest(len(w) - 4, 1))) AS p FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s AS a JOIN s AS b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM i JOIN n AS x ON x.doc_id = a JOIN n AS y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
both_ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, both_ways.b FROM reach JOIN both_ways ON reach.b = both_ways.a),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM d JOIN c ON c.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id"""


def collocations() -> str:
    ks = ", ".join(f"({k})" for k in range(1, C.LONGEST + 1))
    return rf"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS t FROM documents),
p AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS p FROM d),
w AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM p),
total AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
g AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase
      FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, (VALUES {ks}) AS ks(k) WHERE len(w) >= k)),
f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= {C.SUPPORT}),
cand AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
cuts AS (SELECT lang, k, phrase, a, w, unnest(range(1, k)) AS cut FROM cand),
scored AS (
  SELECT c.lang, c.phrase, c.a, cut, x.f AS l, y.f AS r, CAST((CAST({C.SCALE} AS HUGEINT) * c.a) // (CAST(x.f AS HUGEINT) + y.f) AS BIGINT) AS score
  FROM cuts AS c
  JOIN f AS x ON x.lang = c.lang AND x.phrase = array_to_string(w[1:cut], ' ')
  JOIN f AS y ON y.lang = c.lang AND y.phrase = array_to_string(w[cut + 1:c.k], ' ')),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
inside AS (
  SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, max(a) AS longer
  FROM (SELECT lang, w, a, m, unnest(range(1, k - m + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS m FROM cand WHERE k > 2)) GROUP BY ALL),
kept AS (SELECT b.* FROM best AS b LEFT JOIN inside AS i ON i.lang = b.lang AND i.phrase = b.phrase
         WHERE i.longer IS NULL OR CAST(100 AS HUGEINT) * i.longer < CAST({C.COVERED} AS HUGEINT) * b.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN total USING (lang) WHERE rank <= {C.TOP}"""


EMBEDDING_DEDUP = """
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v AS a JOIN v AS b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.x, b.x) >= 0.95),
n AS (SELECT a AS vec_id, count(*) AS n FROM e GROUP BY a),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT embeddings.vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, embeddings.vec_id = component_id AS kept
FROM embeddings JOIN c ON c.vec_id = embeddings.vec_id LEFT JOIN n ON n.vec_id = embeddings.vec_id"""
