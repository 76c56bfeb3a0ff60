"""The queries as SQL for DuckDB, over views named like the tables."""

from __future__ import annotations

SQL: dict[str, str] = {}

_W = r"\p{L}\p{N}_"
_S = r"\s\x1c-\x1f\x85\p{Z}"


def _tok(c: str) -> str:
    bare = rf"regexp_replace(lower({c}), '[^{_W}{_S}]', '', 'g')"
    return rf"list_filter(string_split_regex({bare}, '[{_S}]+'), lambda w: w <> '')"


def _entities(c: str) -> str:
    for name, char in (("quot", '"'), ("copy", "©"), ("middot", "·"), ("lt", "<"), ("gt", ">"), ("amp", "&")):
        c = f"replace({c}, '&{name};', '{char}')"
    return c


_TOPIC = "lang"
_LANG = r"regexp_extract(url, '//[^/]+/([a-z]{2})/', 1)"
_PID = r"try_cast(nullif(regexp_extract(url, '/[a-z]{2}/([0-9]+)', 1), '') AS BIGINT)"
_ART = _entities(
    r"regexp_replace(regexp_extract(html, '(?s)<article>(.*)</article>', 1), '<[^>]*>', '', 'g')"
)
_H1 = _entities(
    r"replace(regexp_replace(regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1), '<[^>]*>', '', 'g'), '''', '')"
)
_HUBLIST = (
    r"list_transform(regexp_extract_all(html, '<a href=\"[^\"]*\">([^<]*)</a>', 1), lambda h: "
    + _entities("h")
    + ")"
)
_HREFS = (
    r"list_transform(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1), lambda h: "
    + _entities("h")
    + ")"
)
_LABELS = (
    f"list_filter(list_transform(list_transform({_HUBLIST}, lambda h: ' *' || h || '* '), "
    "lambda h: trim(trim(trim(h), '*'))), "
    "lambda h: h <> '' AND NOT starts_with(lower(h), '%s'))"
)
_FIXED = rf"list_transform({_LABELS % 'the'}, lambda h: regexp_replace(h, 'th.+ble', 'Thable', 'g'))"

_DOC_TOKENS = f"""
  SELECT doc_id, lang, i - 1 AS pos, t[i] AS token
  FROM (SELECT doc_id, lang, t, unnest(range(1, len(t) + 1)) AS i
        FROM (SELECT doc_id, lang, {_tok('text')} AS t FROM documents))"""
_TALK_TOKENS = f"""
  SELECT conv_id, turn, i - 1 AS pos, t[i] AS token
  FROM (SELECT conv_id, turn, t, unnest(range(1, len(t) + 1)) AS i
        FROM (SELECT conv_id, turn, {_tok('text')} AS t FROM conversations))"""
_VOCAB = f"""
  SELECT '<unk>' AS token, 0::BIGINT AS idx, 0::BIGINT AS n
  UNION ALL
  SELECT token, row_number() OVER (ORDER BY f.doc_id, f.pos) AS idx, n
  FROM (SELECT token, min({{'doc_id': doc_id, 'pos': pos}}) AS f, count(*) AS n
        FROM ({_DOC_TOKENS}) GROUP BY token)"""
_LINKS = rf"""
  SELECT page_id, hub, i - 1 AS pos, 'https://site.example' || h[i] AS url
  FROM (SELECT page_id, hub, h, unnest(range(1, len(h) + 1)) AS i
        FROM (SELECT page_id, {_LANG} AS hub, {_HREFS} AS h FROM pages))"""
_STORED = f"SELECT DISTINCT url FROM ({_LINKS}) WHERE hub = 'en'"
_FIRST_LINK = f"""
  SELECT * FROM ({_LINKS}) QUALIFY row_number() OVER (PARTITION BY url ORDER BY page_id, pos) = 1"""
_LAST = rf"""
  SELECT {_LANG} AS hub,
         greatest(coalesce(max(list_max(list_transform(list_append(coalesce({_HREFS}, []), url),
           lambda h: try_cast(nullif(regexp_extract(h, '[?&]page=([0-9]+)', 1), '') AS BIGINT)))), 1), 1) AS last_page
  FROM pages GROUP BY 1"""
_HUBS = f"""
  SELECT hub, row_number() OVER (ORDER BY hub) - 1 AS ord
  FROM (SELECT DISTINCT {_LANG} AS hub FROM pages)"""
_SCORED = """
  SELECT vec_id, l, cluster, label, list_position(l, list_max(l)) - 1 AS pred
  FROM (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS l, label AS cluster,
               label % len(embedding) AS label FROM embeddings)"""


def _where_split(part: str, n: str = "documents") -> str:
    return f"""
  SELECT *, CASE WHEN row_number() OVER (PARTITION BY lang ORDER BY md5('42|' || doc_id), doc_id)
                      <= floor({part} * count(*) OVER (PARTITION BY lang))
            THEN 'test' ELSE 'train' END AS part FROM {n}"""


SQL["csv_roundtrip"] = "SELECT doc_id, lang, source, text FROM documents"
SQL["pages_scan"] = f"SELECT page_id, url, {_LANG} AS hub, length(html) AS n_chars FROM pages"
SQL["docs_by_category"] = (
    f"SELECT page_id, {_LANG} AS category, url, {_H1} AS title FROM pages"
)
SQL["extract_errors"] = """
SELECT url, unnest(['no tags', 'no date']) AS error FROM pages
UNION ALL SELECT url, 'no hubs' FROM pages WHERE NOT contains(html, '<a ')
UNION ALL SELECT url, 'no text' FROM pages WHERE NOT contains(html, '<article>')
UNION ALL SELECT url, 'no title' FROM pages WHERE NOT contains(html, '<h1>')"""
SQL["vocab_json"] = f"SELECT token, idx FROM ({_VOCAB})"

SQL["last_page"] = _LAST
SQL["hub_frontier"] = f"""
SELECT hub, page, 'https://site.example/hubs/' || hub || '/articles/page' || page || '/' AS url
FROM (SELECT hub, unnest(range(1, least(last_page, 20) + 1)) AS page FROM ({_LAST}))"""
SQL["page_links"] = f"SELECT page_id, pos, url FROM ({_LINKS})"
SQL["new_links_anti"] = f"""
SELECT url, hub, page_id FROM ({_FIRST_LINK}) WHERE url NOT IN ({_STORED})"""
SQL["dedupe_url"] = f"SELECT url, hub, page_id, pos FROM ({_FIRST_LINK})"
SQL["hub_resume"] = f"""
SELECT hub, ord FROM ({_HUBS})
WHERE ord >= coalesce((SELECT max(ord) FROM ({_HUBS}) WHERE hub = 'es'), 0)"""
SQL["hubs_without_links"] = f"""
SELECT hub FROM ({_HUBS}) WHERE hub NOT IN (SELECT hub FROM ({_FIRST_LINK}) WHERE url NOT IN ({_STORED}))"""
SQL["link_report"] = f"""
SELECT h.hub, count(l.hub) AS found, coalesce(max(f.new), 0) AS new
FROM ({_HUBS}) h LEFT JOIN ({_LINKS}) l ON h.hub = l.hub
LEFT JOIN (SELECT hub, count(*) AS new FROM ({_FIRST_LINK}) WHERE url NOT IN ({_STORED}) GROUP BY hub) f
  ON h.hub = f.hub
GROUP BY h.hub"""
SQL["ingest_counts"] = r"""
SELECT count(*) AS loaded, count(*) FILTER (NOT contains(html, '<article>')) AS without_text,
       count(*) FILTER (contains(html, '<article>') AND NOT regexp_matches(url, '/(?:en|fr)/[0-9]+')) AS without_id,
       count(*) FILTER (contains(html, '<article>') AND regexp_matches(url, '/(?:en|fr)/[0-9]+')) AS kept
FROM pages"""

SQL["article_text"] = f"SELECT page_id, {_ART} AS text FROM pages"
SQL["article_title"] = f"SELECT page_id, {_H1} AS title FROM pages"
SQL["article_hubs"] = f"SELECT page_id, array_to_string({_HUBLIST}, '|') AS hubs FROM pages"
SQL["article_paragraphs"] = f"""
SELECT page_id, i - 2 AS pos, {_entities("regexp_replace(p[i], '<[^>]*>', '', 'g')")} AS text
FROM (SELECT page_id, p, unnest(range(2, len(p) + 1)) AS i
      FROM (SELECT page_id, string_split(regexp_extract(html, '(?s)<article>(.*)</article>', 1), '<p>') AS p
            FROM pages))"""
SQL["article_tags"] = "SELECT page_id, 'utf-8' AS tags, 'Без тегов' AS tags_missing FROM pages"
SQL["article_date"] = """
SELECT page_id, regexp_extract(html, '<html lang="([^"]*)"', 1) AS date, 'Без даты' AS date_missing FROM pages"""
SQL["articles"] = f"""
SELECT {_LANG} AS category, url, {_H1} AS title, {_ART} AS text, 'Без саммари' AS summary,
       array_to_string({_HUBLIST}, '|') AS hubs, 'Без тегов' AS tags, 'Без даты' AS date FROM pages"""

SQL["drop_no_text"] = """
SELECT doc_id, lang, CASE WHEN lang <> 'fr' THEN text END AS text FROM documents WHERE lang <> 'es'"""
SQL["clean_hubs"] = f"SELECT page_id, array_to_string({_LABELS % 'the'}, '|') AS hubs FROM pages"
SQL["clean_tags"] = f"SELECT page_id, array_to_string({_LABELS % 'блог'}, '|') AS tags FROM pages"
SQL["article_id"] = f"SELECT page_id, {_PID} AS doc_id FROM pages WHERE {_PID} IS NOT NULL"
SQL["fix_hub_names"] = f"SELECT page_id, array_to_string({_FIXED}, '|') AS hubs FROM pages"
_CLEAN = f"""
SELECT {_PID} AS doc_id, {_LANG} AS category, url, {_H1} AS title, {_ART} AS text,
       array_to_string(list_transform(
         list_filter({_HUBLIST}, lambda h: trim(trim(trim(h), '*')) <> ''
           AND NOT starts_with(lower(trim(trim(trim(h), '*'))), 'the')),
         lambda h: regexp_replace(trim(trim(trim(h), '*')), 'th.+ble', 'Thable', 'g')), '|') AS hubs,
       'Без тегов' AS tags
FROM pages WHERE {_PID} IS NOT NULL"""
SQL["clean_documents"] = _CLEAN
SQL["stream_clean"] = _CLEAN

SQL["normalize_text"] = f"SELECT doc_id, array_to_string({_tok('text')}, ' ') AS text FROM documents"
SQL["tokenize"] = (
    f"SELECT conv_id, turn, array_to_string({_tok('text')}, '|') AS tokens FROM conversations"
)
SQL["tokenize_punct"] = rf"""
SELECT doc_id, array_to_string(regexp_extract_all(lower(text), '([{_W}]+|[^{_W}{_S}])', 1), ' ') AS tokens
FROM documents"""
SQL["token_rows"] = f"SELECT doc_id, pos, token FROM ({_DOC_TOKENS})"
SQL["text_preview"] = """
SELECT doc_id, CASE WHEN length(text) > 200 THEN left(text, 200) || '...' ELSE text END AS preview FROM documents"""
SQL["doc_lengths"] = f"""
SELECT doc_id, length(text) AS n_chars, len({_tok('text')}) AS n_tokens FROM documents"""

SQL["token_counts"] = f"SELECT token, count(*) AS n FROM ({_DOC_TOKENS}) GROUP BY token"
SQL["vocab_index"] = _VOCAB
SQL["encode_tokens"] = f"""
WITH v AS ({_VOCAB}), t AS ({_DOC_TOKENS}),
e AS (SELECT doc_id, count(*) AS n_tokens,
             avg(CASE WHEN v.idx IS NULL THEN 1.0 ELSE 0.0 END)::DOUBLE AS unk_rate,
             string_agg(coalesce(v.idx, 0)::VARCHAR, ' ' ORDER BY pos) AS seq
      FROM t LEFT JOIN v ON t.token = v.token GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_tokens, 0) AS n_tokens, unk_rate, coalesce(seq, '') AS seq
FROM documents d LEFT JOIN e ON d.doc_id = e.doc_id"""
SQL["unk_rate"] = f"""
WITH v AS ({_VOCAB}), t AS ({_TALK_TOKENS}),
e AS (SELECT conv_id, turn, count(*) AS n_tokens, count(*) FILTER (v.idx IS NULL) AS n_unk
      FROM t LEFT JOIN v ON t.token = v.token GROUP BY conv_id, turn)
SELECT c.conv_id, c.turn, coalesce(n_tokens, 0) AS n_tokens, coalesce(n_unk, 0) AS n_unk,
       round(n_unk::DOUBLE / n_tokens, 9) AS unk_rate
FROM conversations c LEFT JOIN e ON c.conv_id = e.conv_id AND c.turn = e.turn"""
SQL["pad_sequences"] = f"""
WITH v AS ({_VOCAB}), t AS ({_TALK_TOKENS}),
e AS (SELECT conv_id, turn, list(coalesce(v.idx, 0) ORDER BY pos) AS s
      FROM t LEFT JOIN v ON t.token = v.token GROUP BY conv_id, turn)
SELECT c.conv_id, c.turn, 90::BIGINT AS n,
       array_to_string(list_resize(coalesce(s, []), 90, 0), ' ') AS seq
FROM conversations c LEFT JOIN e ON c.conv_id = e.conv_id AND c.turn = e.turn"""
SQL["vocab_ensure_unk"] = f"""
WITH v AS ({_VOCAB})
SELECT token, idx FROM v WHERE token <> '<unk>'
UNION ALL SELECT '<unk>', max(idx) + 1 FROM v"""
SQL["vocab_size"] = f"SELECT count(*) + 1 AS vocab_size FROM ({_VOCAB})"
SQL["label_index"] = """
SELECT doc_id, lang, (dense_rank() OVER (ORDER BY lang) - 1)::INTEGER AS target FROM documents"""
SQL["label_remap"] = """
SELECT vec_id, CASE WHEN label + 1 = (SELECT max(label + 1) FROM embeddings) THEN 0 ELSE label + 1 END AS label
FROM embeddings"""
SQL["multi_hot"] = f"""
WITH r AS (SELECT DISTINCT page_id, unnest({_HUBLIST}) AS hub FROM pages),
i AS (SELECT hub, row_number() OVER (ORDER BY encode(hub)) - 1 AS target
      FROM (SELECT DISTINCT hub FROM r WHERE hub <> ''))
SELECT page_id, string_agg(target::VARCHAR, ' ' ORDER BY target) AS targets
FROM r JOIN i USING (hub) GROUP BY page_id"""
SQL["multi_hot_dense"] = "SELECT doc_id, quality::VARCHAR || toxic::VARCHAR AS hot FROM labels"
SQL["class_balance"] = """
SELECT lang, count(*) AS n, round(count(*)::DOUBLE / sum(count(*)) OVER (), 9) AS share
FROM documents GROUP BY lang"""

SQL["stratified_split"] = f"SELECT doc_id, lang, part FROM ({_where_split('0.2')})"
_VAL = """
SELECT doc_id, lang, text, CASE WHEN row_number() OVER (ORDER BY md5('42|' || doc_id), doc_id)
                        <= floor(0.05 * count(*) OVER ()) THEN 'val' ELSE 'train' END AS part
FROM documents"""
SQL["val_split"] = f"SELECT doc_id, lang, part FROM ({_VAL})"
SQL["prepared_dataset"] = f"""
WITH s AS ({_VAL}), t AS ({_DOC_TOKENS}),
f AS (SELECT token, min({{'doc_id': doc_id, 'pos': pos}}) AS f
      FROM t WHERE doc_id IN (SELECT doc_id FROM s WHERE part = 'train') GROUP BY token),
v AS (SELECT token, row_number() OVER (ORDER BY f.doc_id, f.pos) AS idx FROM f),
e AS (SELECT doc_id, list(coalesce(v.idx, 0) ORDER BY pos) AS q
      FROM t LEFT JOIN v ON t.token = v.token GROUP BY doc_id)
SELECT s.doc_id, (dense_rank() OVER (ORDER BY lang) - 1)::INTEGER AS target, part,
       array_to_string(list_resize(coalesce(q, []), 4096, 0), ' ') AS seq
FROM s LEFT JOIN e ON s.doc_id = e.doc_id"""

SQL["softmax"] = f"""
WITH e AS (SELECT vec_id, list_transform(l, lambda x: exp(x - list_max(l))) AS e FROM ({_SCORED}))
SELECT vec_id, i - 1 AS pos, round(e[i] / list_sum(e), 6) AS p
FROM (SELECT *, unnest(range(1, len(e) + 1)) AS i FROM e)"""
SQL["argmax_class"] = f"SELECT vec_id, pred FROM ({_SCORED})"


def _bayes(docs: str) -> str:
    """Model tables: ``w`` (token, label, weight) and ``p`` (label, prior)."""
    return f"""
docs AS ({docs}),
dt AS (SELECT lang, unnest({_tok('text')}) AS token FROM docs),
cls AS (SELECT lang, count(*) AS n FROM docs GROUP BY lang),
tot AS (SELECT lang, count(*) AS m FROM dt GROUP BY lang),
tok AS (SELECT DISTINCT token FROM dt),
cnt AS (SELECT token, lang, count(*) AS c FROM dt GROUP BY token, lang),
w AS (SELECT tok.token, cls.lang, ln(coalesce(c, 0) + 1.0) - ln(coalesce(m, 0) + (SELECT count(*) FROM tok)) AS w
      FROM tok CROSS JOIN cls LEFT JOIN tot ON cls.lang = tot.lang
      LEFT JOIN cnt ON cnt.token = tok.token AND cnt.lang = cls.lang),
p AS (SELECT lang, ln(n + 1.0) - ln((SELECT sum(n) FROM cls) + (SELECT count(*) FROM cls)) AS prior FROM cls)"""


_SCORE = f"""
WITH {_bayes('SELECT * FROM documents')},
t AS ({_TALK_TOKENS}),
s AS (SELECT conv_id, turn, w.lang, sum(w) AS x FROM t JOIN w ON t.token = w.token GROUP BY ALL),
l AS (SELECT c.conv_id, c.turn, p.lang, prior + coalesce(x, 0) AS logit
      FROM conversations c CROSS JOIN p
      LEFT JOIN s ON c.conv_id = s.conv_id AND c.turn = s.turn AND s.lang = p.lang),
m AS (SELECT *, max(logit) OVER (PARTITION BY conv_id, turn) AS top FROM l),
e AS (SELECT *, exp(logit - top) / sum(exp(logit - top)) OVER (PARTITION BY conv_id, turn) AS prob FROM m),
i AS (SELECT lang, row_number() OVER (ORDER BY lang) - 1 AS idx FROM cls),
b AS (SELECT conv_id, turn, min(lang) FILTER (logit = top) AS best FROM e GROUP BY conv_id, turn)
SELECT c.conv_id, c.turn,
       CASE WHEN length(text) > 200 THEN left(text, 200) || '...' ELSE coalesce(text, '') END AS text,
       coalesce(array_to_string({_tok('text')}, ' '), '') AS preprocessed_text,
       CASE WHEN ok THEN idx ELSE -1 END AS predicted_class,
       e.lang AS class, round(e.prob, 6) AS p, round(e.logit, 4) AS logit,
       CASE WHEN text IS NULL THEN 'text is missing' WHEN NOT ok THEN 'text has no tokens' END AS error
FROM (SELECT *, coalesce(len({_tok('text')}), 0) > 0 AS ok FROM conversations) c
JOIN b ON c.conv_id = b.conv_id AND c.turn = b.turn JOIN i ON i.lang = b.best
LEFT JOIN e ON ok AND c.conv_id = e.conv_id AND c.turn = e.turn"""
SQL["score_documents"] = _SCORE
SQL["stream_score"] = _SCORE
SQL["train_topic_model"] = f"""
WITH {_bayes('SELECT * FROM documents')}
SELECT token, lang AS class, round(w, 6) AS w FROM w"""
SQL["evaluate_model"] = f"""
WITH sp AS ({_where_split('0.2')}),
{_bayes("SELECT * FROM sp WHERE part = 'train'")},
t AS (SELECT doc_id, unnest({_tok('text')}) AS token FROM sp WHERE part = 'test'),
s AS (SELECT doc_id, w.lang, sum(w) AS x FROM t JOIN w ON t.token = w.token GROUP BY ALL),
l AS (SELECT d.doc_id, d.lang AS truth, p.lang, prior + coalesce(x, 0) AS logit
      FROM (SELECT * FROM sp WHERE part = 'test') d CROSS JOIN p
      LEFT JOIN s ON d.doc_id = s.doc_id AND s.lang = p.lang),
m AS (SELECT *, max(logit) OVER (PARTITION BY doc_id) AS top FROM l),
r AS (SELECT doc_id, truth, arg_min(lang, lang) FILTER (logit = top) AS pred,
             ln(sum(exp(logit - top))) + any_value(top) - max(logit) FILTER (lang = truth) AS loss
      FROM m GROUP BY doc_id, truth),
f AS (SELECT cls, 2.0 * sum(tp) / (2.0 * sum(tp) + sum(fp) + sum(fn)) AS f1
      FROM (SELECT truth AS cls, (truth = pred)::INT AS tp, 0 AS fp, (truth <> pred)::INT AS fn FROM r
            UNION ALL SELECT pred, 0, (truth <> pred)::INT, 0 FROM r) GROUP BY cls)
SELECT count(*) AS n, round(avg((truth = pred)::INT), 6) AS accuracy,
       round((SELECT avg(f1) FROM f), 6) AS macro_f1, round(avg(loss), 6) AS loss FROM r"""
SQL["model_choice_folds"] = f"""
WITH d AS (SELECT doc_id, lang, ('0x' || left(md5('42|' || doc_id), 8))::BIGINT % 5 AS fold, {_tok('text')} AS t FROM documents),
x AS (SELECT doc_id, lang, fold, unnest(t) AS token FROM d),
cnt AS (SELECT token, lang, fold, count(*) AS n FROM x GROUP BY ALL),
g AS (SELECT unnest([0.1, 0.5, 1.0, 2.0])::DOUBLE AS s), f AS (SELECT unnest(range(0, 5)) AS fold),
cls AS (SELECT DISTINCT lang FROM d),
m AS (SELECT f.fold, token, sum(n) AS n FROM cnt JOIN f ON cnt.fold <> f.fold GROUP BY ALL),
v AS (SELECT fold, count(*) AS v FROM m GROUP BY fold),
tc AS (SELECT f.fold, lang, sum(n) AS n FROM cnt JOIN f ON cnt.fold <> f.fold GROUP BY ALL),
mc AS (SELECT f.fold, token, lang, sum(n) AS n FROM cnt JOIN f ON cnt.fold <> f.fold GROUP BY ALL),
pr AS (SELECT f.fold, lang, count(*) AS n, sum(count(*)) OVER (PARTITION BY f.fold) AS every
       FROM d JOIN f ON d.fold <> f.fold GROUP BY f.fold, lang),
tf AS (SELECT doc_id, fold, token, count(*) AS k FROM x GROUP BY ALL),
k AS (SELECT tf.* FROM tf JOIN m ON m.fold = tf.fold AND m.token = tf.token),
s1 AS (SELECT k.doc_id, cls.lang, g.s,
              sum(k.k * (ln(coalesce(mc.n, 0) + g.s) - ln(coalesce(tc.n, 0) + g.s * v.v))) AS x
       FROM k JOIN cls ON TRUE JOIN g ON TRUE JOIN v ON v.fold = k.fold
       LEFT JOIN tc ON tc.fold = k.fold AND tc.lang = cls.lang
       LEFT JOIN mc ON mc.fold = k.fold AND mc.token = k.token AND mc.lang = cls.lang GROUP BY ALL),
l AS (SELECT d.doc_id, d.lang AS truth, cls.lang, g.s,
             ln(coalesce(pr.n, 0) + g.s) - ln((SELECT max(every) FROM pr p2 WHERE p2.fold = d.fold)
               + g.s * (SELECT count(*) FROM cls)) + coalesce(s1.x, 0) AS logit
      FROM d JOIN cls ON TRUE JOIN g ON TRUE LEFT JOIN pr ON pr.fold = d.fold AND pr.lang = cls.lang
      LEFT JOIN s1 ON s1.doc_id = d.doc_id AND s1.lang = cls.lang AND s1.s = g.s),
t AS (SELECT *, max(logit) OVER (PARTITION BY doc_id, s) AS top FROM l),
r AS (SELECT s, doc_id, truth, min(lang) FILTER (logit = top) AS pred,
             ln(sum(exp(logit - top))) + any_value(top) - max(logit) FILTER (lang = truth) AS loss
      FROM t GROUP BY s, doc_id, truth),
c AS (SELECT s, cls, 2.0 * sum(tp) / (2.0 * sum(tp) + sum(fp) + sum(fn)) AS f1
      FROM (SELECT s, truth AS cls, (truth = pred)::INT AS tp, 0 AS fp, (truth <> pred)::INT AS fn FROM r
            UNION ALL SELECT s, pred, 0, (truth <> pred)::INT, 0 FROM r) GROUP BY ALL)
SELECT s AS smoothing, count(*) AS n, round(avg((truth = pred)::INT), 6) AS accuracy,
       round((SELECT avg(f1) FROM c WHERE c.s = r.s), 6) AS macro_f1, round(avg(loss), 6) AS loss
FROM r GROUP BY s"""
SQL["multilabel_bayes"] = f"""
WITH d AS (SELECT d.doc_id, {_tok('text')} AS t, ('0x' || left(md5('42|' || d.doc_id), 8))::BIGINT % 5 AS fold, quality, toxic
           FROM documents d JOIN labels l ON d.doc_id = l.doc_id),
y AS (SELECT doc_id, fold, t, 'quality' AS label, quality = 1 AS y FROM d
      UNION ALL SELECT doc_id, fold, t, 'toxic', toxic = 1 FROM d),
x AS (SELECT label, y, unnest(t) AS token FROM y WHERE fold <> 0),
w AS (SELECT label, token, ln(count(*) FILTER (y) + 1.0) - ln(count(*) FILTER (NOT y) + 1.0) AS w FROM x GROUP BY ALL),
z AS (SELECT label, ln(count(*) FILTER (y) + s.v) - ln(count(*) FILTER (NOT y) + s.v) AS base
      FROM x, (SELECT count(DISTINCT token) AS v FROM x) s GROUP BY label, s.v),
p AS (SELECT label, ln(count(*) FILTER (y) + 1.0) - ln(count(*) FILTER (NOT y) + 1.0) AS prior FROM y WHERE fold <> 0 GROUP BY label),
q AS (SELECT doc_id, label, sum(w.w - z.base) AS x
      FROM (SELECT doc_id, label, unnest(t) AS token FROM y WHERE fold = 0) u JOIN w USING (label, token) JOIN z USING (label)
      GROUP BY ALL),
r AS (SELECT y.label, y.y, p.prior + coalesce(q.x, 0) > 0 AS hit FROM y JOIN p USING (label)
      LEFT JOIN q ON q.doc_id = y.doc_id AND q.label = y.label WHERE y.fold = 0),
s AS (SELECT label, count(*) FILTER (y AND hit) AS tp, count(*) FILTER (hit AND NOT y) AS fp,
             count(*) FILTER (y AND NOT hit) AS fn FROM r GROUP BY label)
SELECT label, tp, fp, fn, round(coalesce(tp / nullif(tp + fp, 0), 0), 9) AS precision,
       round(coalesce(tp / nullif(tp + fn, 0), 0), 9) AS recall, round(2 * tp / (2 * tp + fp + fn), 9) AS f1
FROM s WHERE tp + fp + fn > 0"""
SQL["last_seen_value"] = """
SELECT e.event_id, e.user_id, e.ts, v.event_id AS view_id, v.value AS view_value
FROM events e ASOF LEFT JOIN (
  SELECT user_id, ts, max(event_id) AS event_id, arg_max(value, event_id) AS value
  FROM events WHERE event_type = 'view' GROUP BY user_id, ts) v
ON e.user_id = v.user_id AND e.ts >= v.ts"""
SQL["best_runs_topk"] = """
SELECT event_id AS run_id, value AS val_loss FROM events ORDER BY value, event_id LIMIT 5"""

SQL["accuracy"] = f"SELECT round(avg((label = pred)::INT), 9) AS accuracy FROM ({_SCORED})"
SQL["macro_f1"] = f"""
WITH r AS ({_SCORED}),
f AS (SELECT cls, 2.0 * sum(tp) / (2.0 * sum(tp) + sum(fp) + sum(fn)) AS f1
      FROM (SELECT label AS cls, (label = pred)::INT AS tp, 0 AS fp, (label <> pred)::INT AS fn FROM r
            UNION ALL SELECT pred, 0, (label <> pred)::INT, 0 FROM r) GROUP BY cls)
SELECT round(avg(f1), 9) AS macro_f1 FROM f"""
SQL["cross_entropy"] = f"""
SELECT round(avg(ln(list_sum(list_transform(l, lambda x: exp(x)))) - l[label + 1]), 9) AS loss
FROM ({_SCORED})"""
SQL["confusion_matrix"] = f"""
SELECT label, pred::INTEGER AS pred, count(*) AS n FROM ({_SCORED}) GROUP BY label, pred"""
_TURNS = f"""
  SELECT a.conv_id, a.turn, {_tok('a.text')} AS cand, {_tok('b.text')} AS ref
  FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn = b.turn + 1"""
_RATES = """
       round(coalesce(o / nullif(nc, 0), 0), 9) AS precision, round(coalesce(o / nullif(nr, 0), 0), 9) AS recall,
       round(coalesce(2 * o / nullif(nc + nr, 0), 0), 9) AS f1"""


def _rouge(n: int) -> str:
    def grams(c):
        return (
            f"CASE WHEN len({c}) >= {n} THEN list_transform(range(1, len({c}) - {n - 2}), "
            f"lambda i: array_to_string({c}[i:i + {n - 1}], ' ')) ELSE [] END"
        )

    return f"""
WITH t AS ({_TURNS}),
c AS (SELECT conv_id, turn, g, count(*) AS n FROM (SELECT conv_id, turn, unnest({grams('cand')}) AS g FROM t) GROUP BY ALL),
r AS (SELECT conv_id, turn, g, count(*) AS n FROM (SELECT conv_id, turn, unnest({grams('ref')}) AS g FROM t) GROUP BY ALL),
o AS (SELECT conv_id, turn, sum(least(c.n, r.n)) AS o FROM c JOIN r USING (conv_id, turn, g) GROUP BY ALL),
a AS (SELECT t.conv_id, t.turn, coalesce(o.o, 0)::DOUBLE AS o,
             greatest(len(cand) - {n - 1}, 0)::DOUBLE AS nc, greatest(len(ref) - {n - 1}, 0)::DOUBLE AS nr
      FROM t LEFT JOIN o USING (conv_id, turn))
SELECT conv_id, turn, o::BIGINT AS overlap, {_RATES} FROM a"""


SQL["rouge_1"] = _rouge(1)
SQL["rouge_2"] = _rouge(2)
# One row of the subsequence table per candidate token: the running maximum is
# the step along the reference.
SQL["rouge_l"] = f"""
WITH RECURSIVE t AS ({_TURNS}),
c AS (SELECT conv_id, turn, i, cand[i] AS w FROM (SELECT *, unnest(range(1, len(cand) + 1)) AS i FROM t)),
r AS (SELECT conv_id, turn, j, ref[j] AS w FROM (SELECT *, unnest(range(1, len(ref) + 1)) AS j FROM t)),
s AS (
  SELECT conv_id, turn, 0::BIGINT AS i, j, w, 0::BIGINT AS v FROM r
  UNION ALL
  SELECT conv_id, turn, i, j, w, max(x) OVER (PARTITION BY conv_id, turn ORDER BY j) AS v
  FROM (SELECT s.conv_id, s.turn, c.i, s.j, s.w,
               greatest(s.v, CASE WHEN s.w = c.w THEN 1 + coalesce(
                 lag(s.v) OVER (PARTITION BY s.conv_id, s.turn ORDER BY s.j), 0) ELSE 0 END) AS x
        FROM s JOIN c ON c.conv_id = s.conv_id AND c.turn = s.turn AND c.i = s.i + 1)),
o AS (SELECT conv_id, turn, max(v) AS o FROM s GROUP BY conv_id, turn),
a AS (SELECT t.conv_id, t.turn, coalesce(o.o, 0)::DOUBLE AS o, len(cand)::DOUBLE AS nc, len(ref)::DOUBLE AS nr
      FROM t LEFT JOIN o USING (conv_id, turn))
SELECT conv_id, turn, o::BIGINT AS overlap, {_RATES} FROM a"""
SQL["v_measure"] = f"""
WITH r AS ({_SCORED}),
ck AS (SELECT cluster AS c, pred AS k, count(*)::DOUBLE AS n FROM r GROUP BY ALL),
c AS (SELECT c, sum(n) AS n FROM ck GROUP BY c), k AS (SELECT k, sum(n) AS n FROM ck GROUP BY k),
t AS (SELECT sum(n) AS n FROM ck),
h AS (SELECT (SELECT -sum(c.n / t.n * ln(c.n / t.n)) FROM c, t) AS hc,
             (SELECT -sum(k.n / t.n * ln(k.n / t.n)) FROM k, t) AS hk,
             (SELECT -sum(ck.n / t.n * ln(ck.n / k.n)) FROM ck JOIN k USING (k), t) AS hck,
             (SELECT -sum(ck.n / t.n * ln(ck.n / c.n)) FROM ck JOIN c USING (c), t) AS hkc),
s AS (SELECT 1 - hck / hc AS h, 1 - hkc / hk AS c FROM h)
SELECT round(h, 9) AS homogeneity, round(c, 9) AS completeness, round(2 * h * c / (h + c), 9) AS v_measure FROM s"""
_SIMILAR = """
  WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
  u AS (SELECT vec_id, label, v, sqrt(list_dot_product(v, v)) AS norm FROM e)
  SELECT query_id, item_id, cosine, rank, same FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, item_id) AS rank
    FROM (SELECT a.vec_id AS query_id, b.vec_id AS item_id, a.label = b.label AS same,
                 round(list_dot_product(a.v, b.v) / (a.norm * b.norm), 6) AS cosine
          FROM u a JOIN u b ON a.vec_id <> b.vec_id)) WHERE rank <= 5"""
SQL["similar_docs_topk"] = f"SELECT query_id, item_id, cosine, rank FROM ({_SIMILAR})"
SQL["similar_docs_recall"] = f"""
SELECT count(*) AS n_neighbours, TRUE AS recall_reached, 0::BIGINT AS n_wrong FROM ({_SIMILAR})"""
SQL["precision_recall_at_k"] = f"""
WITH s AS ({_SIMILAR}),
h AS (SELECT query_id, count(*) FILTER (same) AS hits FROM s GROUP BY query_id),
q AS (SELECT vec_id, count(*) OVER (PARTITION BY label) - 1 AS n FROM embeddings)
SELECT count(*) AS n_queries, round(avg(hits / 5.0), 9) AS precision_at_k,
       round(avg(hits::DOUBLE / nullif(n, 0)), 9) AS recall_at_k
FROM q JOIN h ON q.vec_id = h.query_id"""
SQL["multilabel_f1"] = """
WITH t AS (SELECT doc_id, 'quality' AS label FROM labels WHERE quality = 1
           UNION ALL SELECT doc_id, 'toxic' FROM labels WHERE toxic = 1),
d AS (SELECT * FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)),
p AS (SELECT doc_id, 'quality' AS label FROM d WHERE n_chars > 500
      UNION ALL SELECT doc_id, 'toxic' FROM d WHERE regexp_matches(text, '[0-9]')),
x AS (SELECT coalesce(t.label, p.label) AS label, (t.label IS NOT NULL AND p.label IS NOT NULL)::INT AS tp,
             (t.label IS NULL)::INT AS fp, (p.label IS NULL)::INT AS fn
      FROM t FULL JOIN p ON t.doc_id = p.doc_id AND t.label = p.label),
s AS (SELECT label, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn FROM x GROUP BY label)
SELECT label, tp, fp, fn, round(tp / nullif(tp + fp, 0), 9) AS precision,
       round(tp / nullif(tp + fn, 0), 9) AS recall, round(2 * tp / (2 * tp + fp + fn), 9) AS f1 FROM s"""
SQL["epoch_metrics"] = """
SELECT hour(ts) AS epoch, count(*) AS steps, round(avg(value) FILTER (event_type = 'view'), 6) AS train_loss,
       round(avg(value) FILTER (event_type = 'click'), 6) AS val_loss
FROM events GROUP BY hour(ts)"""

_IDF = f"""
dn AS (SELECT count(*) AS n FROM documents),
idf AS (SELECT token, ln(((SELECT n FROM dn) + 1)::DOUBLE / (count(DISTINCT doc_id) + 1)) AS idf
        FROM ({_DOC_TOKENS}) GROUP BY token)"""
SQL["doc_embedding"] = f"""
WITH {_IDF},
h AS (SELECT token, ('0x' || left(md5(token), 6))::BIGINT % 64 AS dim,
             CASE WHEN substr(md5(token), 7, 1) < '8' THEN idf ELSE -idf END AS w FROM idf),
c AS (SELECT doc_id, dim, sum(w) AS v FROM ({_DOC_TOKENS}) JOIN h USING (token) GROUP BY ALL),
n AS (SELECT doc_id, sqrt(sum(v * v)) AS norm FROM c GROUP BY doc_id),
g AS (SELECT doc_id, unnest(range(0, 64)) AS dim FROM documents)
SELECT g.doc_id, g.dim, round(coalesce(v / nullif(norm, 0), 0), 6) AS v
FROM g LEFT JOIN c ON g.doc_id = c.doc_id AND g.dim = c.dim LEFT JOIN n ON g.doc_id = n.doc_id"""
_SENTS = r"list_filter(list_transform(regexp_extract_all(text, '([^.!?\n]+[.!?]*)', 1), lambda s: trim(s)), lambda s: s <> '')"
SQL["extractive_summary"] = f"""
WITH {_IDF},
s AS (SELECT doc_id, i AS sent, parts[i] AS sentence
      FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i
            FROM (SELECT doc_id, {_SENTS} AS parts FROM documents))),
t AS (SELECT doc_id, sent, unnest({_tok('sentence')}) AS token FROM s),
x AS (SELECT doc_id, sent, round(avg(idf), 6) AS score FROM t JOIN idf USING (token) GROUP BY ALL),
b AS (SELECT doc_id, sent FROM x QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, sent) <= 2)
SELECT d.doc_id, coalesce(string_agg(s.sentence, ' ' ORDER BY s.sent), '') AS summary
FROM documents d LEFT JOIN b ON d.doc_id = b.doc_id
LEFT JOIN s ON s.doc_id = b.doc_id AND s.sent = b.sent GROUP BY d.doc_id"""

SQL["stream_ingest"] = f"SELECT {_LANG} AS category, url, {_H1} AS title FROM pages"
