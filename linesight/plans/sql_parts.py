"""Reusable DuckDB CTE fragments for the oracles (same bindings as bindings.py)."""

LINES = """
WITH lines AS (
  SELECT doc_id,
         CAST(unnest(generate_series(0, len(parts) - 1)) AS BIGINT) AS line_idx,
         unnest(parts) AS line
  FROM (SELECT doc_id, string_split(text, chr(10)) AS parts
        FROM documents WHERE text IS NOT NULL) d
)"""

SCORED = LINES + """,
scored AS (
  SELECT doc_id, line_idx, line, CAST(length(line) AS DOUBLE) AS score,
         CAST(regexp_matches(line, '[0-9@]') AS INTEGER) AS hit
  FROM lines
),
nlab AS (SELECT doc_id, CAST(sum(hit) AS BIGINT) AS n_labels, CAST(count(*) AS BIGINT) AS n_loc
         FROM scored GROUP BY doc_id),
ranked AS (
  SELECT s.*, n.n_labels,
         row_number() OVER (PARTITION BY s.doc_id ORDER BY s.score DESC, s.line_idx) AS rnk
  FROM scored s JOIN nlab n USING (doc_id)
)"""

# per-document metrics of the index variant, X = 10
METRICS = SCORED + """,
cum AS (
  SELECT *, sum(hit) OVER (PARTITION BY doc_id ORDER BY rnk ROWS UNBOUNDED PRECEDING) AS cum_hits
  FROM ranked
),
metrics AS (
  SELECT doc_id,
    CAST(max(CASE WHEN hit = 1 AND rnk <= 10 THEN 1 ELSE 0 END) AS BIGINT) AS top_x_accuracy,
    round(sum(CASE WHEN hit = 1 AND rnk <= 10 THEN 1 ELSE 0 END) / 10.0, 6) AS top_x_precision,
    round(CASE WHEN max(n_labels) > 0
          THEN sum(CASE WHEN hit = 1 AND rnk <= 10 THEN 1 ELSE 0 END) / CAST(max(n_labels) AS DOUBLE)
          ELSE 0.0 END, 6) AS top_x_recall,
    round(coalesce(max(CASE WHEN hit = 1 AND rnk <= 10 THEN 1.0 / rnk END), 0.0), 6) AS rr,
    round(coalesce(avg(CASE WHEN hit = 1 AND rnk <= 10 THEN cum_hits / CAST(rnk AS DOUBLE) END), 0.0), 6) AS ap,
    round(coalesce(avg(CASE WHEN hit = 1 AND rnk <= 10 AND n_labels > 0
                       THEN cum_hits / CAST(n_labels AS DOUBLE) END), 0.0), 6) AS ar,
    CAST(coalesce(min(CASE WHEN hit = 1 THEN rnk END) - 1, count(*)) AS BIGINT) AS ifa
  FROM cum GROUP BY doc_id
)"""

DOCS = """
docs AS (
  SELECT doc_id, source AS project, text, n_chars / (n_chars + 1000.0) AS proba,
         len(string_split(text, chr(10))) AS n_loc
  FROM documents WHERE text IS NOT NULL
)"""

TEST = """
WITH testset AS (
  SELECT d.doc_id, d.text, l.quality AS pred, l.toxic AS target,
         CAST(d.n_chars AS DOUBLE) / (CAST(d.n_chars AS DOUBLE) + 1000.0) AS proba
  FROM documents d JOIN labels l USING (doc_id) WHERE d.text IS NOT NULL
),
tlines AS (
  SELECT doc_id, pred, target, proba,
         CAST(unnest(generate_series(0, len(parts) - 1)) AS BIGINT) AS line_idx,
         unnest(parts) AS line
  FROM (SELECT *, string_split(text, chr(10)) AS parts FROM testset) t
),
tscored AS (
  SELECT *, CAST(length(line) AS DOUBLE) AS score,
         CASE WHEN target = 1 AND regexp_matches(line, '[0-9@]') THEN 1 ELSE 0 END AS hit
  FROM tlines
),
tranked AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, line_idx) AS rnk
  FROM tscored WHERE pred = 1
),
totals AS (
  SELECT (SELECT count(*) FROM tlines) AS total_loc,
         (SELECT coalesce(sum(hit), 0) FROM tscored WHERE target = 1) AS total_flaws
),
lorder AS (
  SELECT doc_id, line_idx, hit,
         row_number() OVER (ORDER BY score DESC, doc_id, rnk) AS pos,
         sum(hit) OVER (ORDER BY score DESC, doc_id, rnk ROWS UNBOUNDED PRECEDING) AS cum_hits
  FROM tranked
),
forder AS (
  SELECT doc_id, line_idx, hit,
         row_number() OVER (ORDER BY proba DESC, doc_id, rnk) AS pos,
         sum(hit) OVER (ORDER BY proba DESC, doc_id, rnk ROWS UNBOUNDED PRECEDING) AS cum_hits
  FROM tranked
)"""

PREDS = """
WITH preds AS (
  SELECT l.doc_id, l.toxic AS target, l.quality AS pred,
         CAST(d.n_chars AS DOUBLE) / (CAST(d.n_chars AS DOUBLE) + 1000.0) AS proba
  FROM labels l JOIN documents d USING (doc_id)
),
cm AS (
  SELECT count_if(target = 0 AND pred = 0) AS tn, count_if(target = 0 AND pred = 1) AS fp,
         count_if(target = 1 AND pred = 0) AS fn, count_if(target = 1 AND pred = 1) AS tp
  FROM preds
),
pr AS (
  SELECT *, CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp / CAST(tp + fp AS DOUBLE) END AS p,
            CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp / CAST(tp + fn AS DOUBLE) END AS r,
            CASE WHEN tn + fp = 0 THEN 0.0 ELSE tn / CAST(tn + fp AS DOUBLE) END AS tnr
  FROM cm
),
cells AS (SELECT target AS a, pred AS p, count(*) AS c FROM preds GROUP BY ALL),
labels_all AS (SELECT a AS label FROM cells UNION SELECT p FROM cells),
perclass AS (
  SELECT l.label,
         coalesce((SELECT sum(c) FROM cells WHERE a = l.label), 0) AS support,
         coalesce((SELECT sum(c) FROM cells WHERE p = l.label), 0) AS predicted,
         coalesce((SELECT sum(c) FROM cells WHERE a = l.label AND p = l.label), 0) AS correct
  FROM labels_all l
),
pc AS (
  SELECT label, support, correct,
         CASE WHEN predicted = 0 THEN 0.0 ELSE correct / CAST(predicted AS DOUBLE) END AS precision,
         CASE WHEN support = 0 THEN 0.0 ELSE correct / CAST(support AS DOUBLE) END AS recall
  FROM perclass
),
pcf AS (
  SELECT *, CASE WHEN precision + recall = 0 THEN 0.0
                 ELSE 2 * precision * recall / (precision + recall) END AS f1 FROM pc
)"""

WORDS = """
WITH toks AS (
  SELECT doc_id, source, lang, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS t
  FROM documents WHERE text IS NOT NULL
)"""


def metric_exprs(rounded: bool) -> str:
    """Per-group metric expressions over ``cum`` (index variant, X = 10)."""
    r = (lambda e: f"round({e}, 6)") if rounded else (lambda e: e)
    return f"""
    CAST(max(CASE WHEN hit = 1 AND rnk <= 10 THEN 1 ELSE 0 END) AS BIGINT) AS top_x_accuracy,
    {r("sum(CASE WHEN hit = 1 AND rnk <= 10 THEN 1 ELSE 0 END) / 10.0")} AS top_x_precision,
    {r('''CASE WHEN max(n_labels) > 0
          THEN sum(CASE WHEN hit = 1 AND rnk <= 10 THEN 1 ELSE 0 END) / CAST(max(n_labels) AS DOUBLE)
          ELSE 0.0 END''')} AS top_x_recall,
    {r("coalesce(max(CASE WHEN hit = 1 AND rnk <= 10 THEN 1.0 / rnk END), 0.0)")} AS rr,
    {r("coalesce(avg(CASE WHEN hit = 1 AND rnk <= 10 THEN cum_hits / CAST(rnk AS DOUBLE) END), 0.0)")} AS ap,
    {r('''coalesce(avg(CASE WHEN hit = 1 AND rnk <= 10 AND n_labels > 0
                       THEN cum_hits / CAST(n_labels AS DOUBLE) END), 0.0)''')} AS ar,
    CAST(coalesce(min(CASE WHEN hit = 1 THEN rnk END) - 1, count(*)) AS BIGINT) AS ifa"""


RUNS = LINES + """,
scored AS (
  SELECT l.doc_id, d.source AS run, l.line_idx, CAST(length(l.line) AS DOUBLE) AS score,
         CAST(regexp_matches(l.line, '[0-9@]') AS INTEGER) AS hit
  FROM lines l JOIN documents d USING (doc_id)
),
nlab AS (SELECT doc_id, sum(hit) AS n_labels FROM scored GROUP BY doc_id),
ranked AS (
  SELECT 'score' AS method, s.*, n.n_labels,
         row_number() OVER (PARTITION BY s.doc_id ORDER BY s.score DESC, s.line_idx) AS rnk
  FROM scored s JOIN nlab n USING (doc_id)
  UNION ALL
  SELECT 'position' AS method, s.*, n.n_labels, s.line_idx + 1 AS rnk
  FROM scored s JOIN nlab n USING (doc_id)
),
cum AS (
  SELECT *, sum(hit) OVER (PARTITION BY method, doc_id ORDER BY rnk ROWS UNBOUNDED PRECEDING) AS cum_hits
  FROM ranked
),
metrics AS (SELECT method, run, doc_id, """ + metric_exprs(False) + """
  FROM cum GROUP BY method, run, doc_id),
runs AS (
  SELECT method, run,
         round(avg(top_x_accuracy), 9) AS accuracy, round(avg(top_x_precision), 9) AS precision,
         round(avg(top_x_recall), 9) AS recall, round(avg(rr), 9) AS mrr, round(avg(ap), 9) AS map,
         round(avg(ar), 9) AS mar, round(quantile_cont(ifa, 0.5), 9) AS median_ifa
  FROM metrics GROUP BY method, run
),
long AS (
  UNPIVOT runs ON accuracy, precision, recall, mrr, map, mar, median_ifa
  INTO NAME metric VALUE value
)"""

# generated-line variant over the predicted-positive test documents
GEN = TEST.replace("WITH testset AS", "WITH lines AS (\n  SELECT doc_id,\n"
                   "         CAST(unnest(generate_series(0, len(parts) - 1)) AS BIGINT) AS line_idx,\n"
                   "         unnest(parts) AS line\n"
                   "  FROM (SELECT doc_id, string_split(text, chr(10)) AS parts\n"
                   "        FROM documents WHERE text IS NOT NULL) d\n),\ntestset AS") + """,
pos AS (SELECT doc_id, proba, target FROM testset WHERE pred = 1),
plines AS (SELECT doc_id, line_idx, line, hit, target FROM tscored WHERE pred = 1),
top3 AS (
  SELECT doc_id, line,
         row_number() OVER (PARTITION BY doc_id ORDER BY length(line) DESC, line_idx) - 1 AS pred_pos
  FROM lines QUALIFY pred_pos < 3
),
nxt AS (SELECT doc_id - 1 AS doc_id, line FROM lines WHERE line_idx = 0),
preds_all AS (
  SELECT t.doc_id, CASE WHEN t.pred_pos = 0 OR n.doc_id IS NULL THEN t.pred_pos
                        ELSE t.pred_pos + 1 END AS pred_pos, t.line
  FROM top3 t LEFT JOIN nxt n USING (doc_id)
  UNION ALL SELECT n.doc_id, 1, n.line FROM nxt n WHERE n.doc_id IN (SELECT doc_id FROM top3)
),
preds AS (SELECT * FROM preds_all WHERE doc_id IN (SELECT doc_id FROM pos)),
seen AS (SELECT DISTINCT doc_id, line FROM plines),
pneed AS (
  SELECT p.doc_id, p.pred_pos, p.line,
         (s.line IS NULL AND p.pred_pos < max(p.pred_pos) OVER (PARTITION BY p.doc_id)) AS need
  FROM preds p LEFT JOIN seen s ON s.doc_id = p.doc_id AND s.line = p.line
),
ptok AS (
  SELECT doc_id, pred_pos, tok, count(*) AS c FROM (
    SELECT doc_id, pred_pos,
           unnest(list_filter(regexp_split_to_array(lower(line), '\\s+'), lambda x: x <> '')) AS tok
    FROM pneed WHERE need) GROUP BY ALL
),
ltok AS (
  SELECT doc_id, line_idx, tok, count(*) AS c FROM (
    SELECT doc_id, line_idx,
           unnest(list_filter(regexp_split_to_array(lower(line), '\\s+'), lambda x: x <> '')) AS tok
    FROM plines WHERE doc_id IN (SELECT doc_id FROM pneed WHERE need)) GROUP BY ALL
),
pnorm AS (SELECT doc_id, pred_pos, sqrt(sum(c * c)) AS pn FROM ptok GROUP BY ALL),
lnorm AS (SELECT doc_id, line_idx, sqrt(sum(c * c)) AS ln FROM ltok GROUP BY ALL),
dots AS (
  SELECT a.doc_id, a.pred_pos, b.line_idx, sum(a.c * b.c) AS dot
  FROM ptok a JOIN ltok b ON a.doc_id = b.doc_id AND a.tok = b.tok GROUP BY ALL
),
best AS (
  SELECT d.doc_id, d.pred_pos, d.line_idx AS best_idx
  FROM dots d JOIN pnorm USING (doc_id, pred_pos) JOIN lnorm USING (doc_id, line_idx)
  QUALIFY row_number() OVER (PARTITION BY d.doc_id, d.pred_pos
                             ORDER BY d.dot / (pn * ln) DESC, d.line_idx) = 1
),
repl AS (
  SELECT n.doc_id, n.pred_pos, CASE WHEN n.need THEN l.line ELSE n.line END AS line,
         CAST(n.need AS INTEGER) AS replaced
  FROM pneed n LEFT JOIN best b USING (doc_id, pred_pos)
  LEFT JOIN plines l ON l.doc_id = n.doc_id AND l.line_idx = coalesce(b.best_idx, 0)
),
flawinfo AS (
  SELECT doc_id, max(target) AS target, sum(hit) AS nflaw FROM plines GROUP BY doc_id
),
granked AS (
  SELECT doc_id, line, 1 AS is_predicted, pred_pos AS p FROM repl
  UNION ALL
  SELECT l.doc_id, l.line, 0, l.line_idx FROM plines l
  WHERE NOT EXISTS (SELECT 1 FROM repl r WHERE r.doc_id = l.doc_id AND r.line = l.line)
),
gr AS (
  SELECT g.doc_id, g.line, g.is_predicted, p.proba,
         row_number() OVER (PARTITION BY g.doc_id ORDER BY g.is_predicted DESC, g.p) AS rnk,
         CASE WHEN f.target = 1 AND f.nflaw > 0 THEN CAST(regexp_matches(g.line, '[0-9@]') AS INTEGER)
              ELSE CAST(g.line = '' AS INTEGER) END AS hit,
         CASE WHEN f.target = 1 AND f.nflaw > 0 THEN f.nflaw ELSE 1 END AS n_labels
  FROM granked g JOIN flawinfo f USING (doc_id) JOIN pos p USING (doc_id)
),
cum AS (
  SELECT *, sum(hit) OVER (PARTITION BY doc_id ORDER BY rnk ROWS UNBOUNDED PRECEDING) AS cum_hits
  FROM gr
),
gorder AS (
  SELECT doc_id, rnk, hit,
         row_number() OVER (ORDER BY is_predicted DESC, proba DESC, doc_id, rnk) AS pos,
         sum(hit) OVER (ORDER BY is_predicted DESC, proba DESC, doc_id, rnk ROWS UNBOUNDED PRECEDING)
           AS cum_hits
  FROM gr
)"""

# token budgets: per-line tokens of the two families and running sums
BUDGET = LINES + """,
bl AS (
  SELECT doc_id, line_idx, count(*) OVER (PARTITION BY doc_id) AS n,
         len(list_filter(regexp_split_to_array(line, '\\s+'), lambda x: x <> '')) AS w,
         CAST(ceil(length(line) / 4.0) AS INTEGER) AS c
  FROM lines
),
bt AS (
  SELECT doc_id, line_idx,
         w + CASE WHEN line_idx < n - 1 THEN 1 ELSE 0 END AS tw,
         c + CASE WHEN line_idx < n - 1 THEN 1 ELSE 0 END AS tc
  FROM bl
),
bc AS (
  SELECT doc_id, line_idx,
         sum(tw) OVER (PARTITION BY doc_id ORDER BY line_idx ROWS UNBOUNDED PRECEDING) AS cw,
         sum(tc) OVER (PARTITION BY doc_id ORDER BY line_idx ROWS UNBOUNDED PRECEDING) AS cc
  FROM bt
),
budget AS (
  SELECT doc_id, count_if(cw <= 126) AS index_words, count_if(cc <= 126) AS index_chars,
         max(cw) + 2 AS total_words, max(cc) + 2 AS total_chars
  FROM bc GROUP BY doc_id
),
evalset AS (
  SELECT d.doc_id, d.lang, l.quality AS pred_g1
  FROM documents d JOIN labels l USING (doc_id) WHERE d.text IS NOT NULL AND l.toxic = 1
),
flaws AS (
  SELECT doc_id, max(line_idx) + 1 AS max_no, count(*) AS nflaw
  FROM lines WHERE regexp_matches(line, '[0-9@]') GROUP BY doc_id
),
meta AS (
  SELECT e.doc_id, e.lang, e.pred_g1,
         CASE WHEN f.nflaw > 0 THEN {'bert': {'under_128_tokens': b.total_words <= 128,
                                           'vul_line_within_128': f.max_no <= b.index_words,
                                           'index_128': b.index_words, 'total_tokens': b.total_words},
                                   'codet5': {'under_128_tokens': b.total_chars <= 128,
                                           'vul_line_within_128': f.max_no <= b.index_chars,
                                           'index_128': b.index_chars, 'total_tokens': b.total_chars}}
         END AS metadata
  FROM evalset e JOIN budget b USING (doc_id) LEFT JOIN flaws f USING (doc_id)
)"""


def replacement_ctes(p: str, docs: str, lines: str, skip_last: bool, drop_blank: bool) -> str:
    """CTE chain ``{p}repl(doc_id, pred_pos, line, replaced)``: predictions of
    the documents in ``docs`` replaced by their most similar document line.
    Needs ``lines`` (doc_id, line_idx, line) and the all-document CTE ``lines``."""
    last = "AND p.pred_pos < max(p.pred_pos) OVER (PARTITION BY p.doc_id)" if skip_last else ""
    blank = "AND regexp_replace(line, '\\s+', '', 'g') <> ''" if drop_blank else ""
    toks = "unnest(list_filter(regexp_split_to_array(lower(line), '\\s+'), lambda x: x <> ''))"
    return f""",
{p}top3 AS (
  SELECT doc_id, line,
         row_number() OVER (PARTITION BY doc_id ORDER BY length(line) DESC, line_idx) - 1 AS pred_pos
  FROM lines QUALIFY pred_pos < 3
),
{p}nxt AS (SELECT doc_id - 1 AS doc_id, line FROM lines WHERE line_idx = 0),
{p}preds_all AS (
  SELECT t.doc_id, CASE WHEN t.pred_pos = 0 OR n.doc_id IS NULL THEN t.pred_pos
                        ELSE t.pred_pos + 1 END AS pred_pos, t.line
  FROM {p}top3 t LEFT JOIN {p}nxt n USING (doc_id)
  UNION ALL SELECT n.doc_id, 1, n.line FROM {p}nxt n WHERE n.doc_id IN (SELECT doc_id FROM {p}top3)
),
{p}preds AS (
  SELECT * FROM {p}preds_all WHERE doc_id IN (SELECT doc_id FROM {docs}) {blank}
),
{p}seen AS (SELECT DISTINCT doc_id, line FROM {lines}),
{p}need AS (
  SELECT p.doc_id, p.pred_pos, p.line, (s.line IS NULL {last}) AS need
  FROM {p}preds p LEFT JOIN {p}seen s ON s.doc_id = p.doc_id AND s.line = p.line
),
{p}ptok AS (
  SELECT doc_id, pred_pos, tok, count(*) AS c FROM (
    SELECT doc_id, pred_pos, {toks} AS tok FROM {p}need WHERE need) GROUP BY ALL
),
{p}ltok AS (
  SELECT doc_id, line_idx, tok, count(*) AS c FROM (
    SELECT doc_id, line_idx, {toks} AS tok
    FROM {lines} WHERE doc_id IN (SELECT doc_id FROM {p}need WHERE need)) GROUP BY ALL
),
{p}pnorm AS (SELECT doc_id, pred_pos, sqrt(sum(c * c)) AS pn FROM {p}ptok GROUP BY ALL),
{p}lnorm AS (SELECT doc_id, line_idx, sqrt(sum(c * c)) AS ln FROM {p}ltok GROUP BY ALL),
{p}dots AS (
  SELECT a.doc_id, a.pred_pos, b.line_idx, sum(a.c * b.c) AS dot
  FROM {p}ptok a JOIN {p}ltok b ON a.doc_id = b.doc_id AND a.tok = b.tok GROUP BY ALL
),
{p}best AS (
  SELECT d.doc_id, d.pred_pos, d.line_idx AS best_idx
  FROM {p}dots d JOIN {p}pnorm USING (doc_id, pred_pos) JOIN {p}lnorm USING (doc_id, line_idx)
  QUALIFY row_number() OVER (PARTITION BY d.doc_id, d.pred_pos
                             ORDER BY d.dot / (pn * ln) DESC, d.line_idx) = 1
),
{p}repl AS (
  SELECT n.doc_id, n.pred_pos, CASE WHEN n.need THEN l.line ELSE n.line END AS line,
         CAST(n.need AS INTEGER) AS replaced
  FROM {p}need n LEFT JOIN {p}best b USING (doc_id, pred_pos)
  LEFT JOIN {lines} l ON l.doc_id = n.doc_id AND l.line_idx = coalesce(b.best_idx, 0)
)"""


STRIP = "regexp_replace(line, '^\\s+|\\s+$', '', 'g')"

EVAL = BUDGET + """,
elines AS (SELECT doc_id, line_idx, line FROM lines WHERE doc_id IN (SELECT doc_id FROM evalset))""" \
    + replacement_ctes("e", "evalset", "elines", skip_last=False, drop_blank=True) + f""",
gt AS (
  SELECT doc_id, {STRIP} AS line FROM elines
  WHERE regexp_matches(line, '[0-9@]') AND {STRIP} <> ''
),
pr AS (SELECT doc_id, {STRIP} AS line FROM erepl WHERE {STRIP} <> ''),
gc AS (SELECT doc_id, line, count(*) AS g FROM gt GROUP BY ALL),
pc AS (SELECT doc_id, line, count(*) AS p FROM pr GROUP BY ALL),
ov AS (
  SELECT coalesce(gc.doc_id, pc.doc_id) AS doc_id,
         sum(least(coalesce(g, 0), coalesce(p, 0))) AS inter,
         sum(greatest(coalesce(g, 0), coalesce(p, 0))) AS uni,
         sum(coalesce(g, 0)) AS gt_len, sum(coalesce(p, 0)) AS sim_len
  FROM gc FULL OUTER JOIN pc ON gc.doc_id = pc.doc_id AND gc.line = pc.line GROUP BY 1
),
rec AS (
  SELECT e.doc_id, e.pred_g1, coalesce(o.gt_len, 0) AS gt_len, coalesce(o.sim_len, 0) AS sim_len,
         CASE WHEN o.sim_len > 0 THEN o.inter / CAST(o.sim_len AS DOUBLE) ELSE 0.0 END AS msp,
         CASE WHEN o.gt_len > 0 THEN o.inter / CAST(o.gt_len AS DOUBLE) ELSE 0.0 END AS msr,
         CASE WHEN o.uni > 0 THEN o.inter / CAST(o.uni AS DOUBLE) ELSE 0.0 END AS miou,
         coalesce(m.metadata.codet5.vul_line_within_128, false) AS is_within_128
  FROM evalset e LEFT JOIN ov o USING (doc_id) JOIN meta m USING (doc_id)
)"""

MATCH = """
WITH gt AS (
  SELECT d.doc_id AS gt_idx, regexp_replace(coalesce(d.text, ''), '\\s+', '', 'g') AS norm,
         coalesce(l.toxic, 0) AS gt_target, d.source AS project, d.text
  FROM documents d LEFT JOIN labels l USING (doc_id)
),
lft AS (
  SELECT d.doc_id AS row_id, coalesce(l.quality, 0) AS t,
         CASE WHEN len(string_split(d.text, chr(10))) >= 2
              THEN array_to_string(string_split(d.text, chr(10))[1:len(string_split(d.text, chr(10))) - 1], chr(10))
              ELSE d.text END AS func
  FROM documents d LEFT JOIN labels l USING (doc_id)
),
lnorm AS (SELECT row_id, t, func, regexp_replace(coalesce(func, ''), '\\s+', '', 'g') AS norm FROM lft),
ex AS (
  SELECT r.row_id, coalesce(min(g.gt_idx) FILTER (WHERE g.gt_target = r.t), min(g.gt_idx)) AS gt_idx
  FROM lnorm r JOIN gt g ON g.norm = r.norm GROUP BY r.row_id
),
rest AS (SELECT * FROM lnorm WHERE row_id NOT IN (SELECT row_id FROM ex)),
cand AS (
  SELECT r.row_id, r.t, g.gt_idx, g.gt_target,
         (starts_with(g.norm, r.norm) OR starts_with(r.norm, g.norm)) AS sw
  FROM rest r JOIN gt g ON substr(g.norm, 1, 150) = substr(r.norm, 1, 150)
),
px AS (
  SELECT row_id,
         CASE WHEN count(*) = 1 THEN min(gt_idx)
              ELSE coalesce(min(gt_idx) FILTER (WHERE sw AND gt_target = t),
                            min(gt_idx) FILTER (WHERE sw), min(gt_idx)) END AS gt_idx
  FROM cand GROUP BY row_id
),
resolved AS (SELECT * FROM ex UNION ALL SELECT * FROM px),
gtlines AS (
  SELECT doc_id,
         string_agg(line, '/~/' ORDER BY line_idx) FILTER (WHERE regexp_matches(line, '[0-9@]')) AS code,
         string_agg(CAST(line_idx + 1 AS VARCHAR), ',' ORDER BY line_idx)
           FILTER (WHERE regexp_matches(line, '[0-9@]')) AS nos
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
               unnest(generate_series(0, len(string_split(text, chr(10))) - 1)) AS line_idx
        FROM documents WHERE text IS NOT NULL) GROUP BY doc_id
)"""
