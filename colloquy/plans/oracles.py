"""The same queries in plain SQL, written independently of the DataFrame code.

Threads come from window functions over the lines of a conversation, metrics from
conditional sums, and nearest neighbours from joins over all pairs.
"""

from __future__ import annotations

from string import ascii_lowercase

from colloquy.functions.rules import ESCALATED_REASON, NOT_ESCALATED_REASON
from colloquy.operators.plane_buckets import SKETCH_BITS, sketch_limit
from colloquy.operators.predictors import CANNED_REPLY, CONSTANT_REASON
from colloquy.plans.catalog import APPROXIMATE


def _clean(c: str) -> str:
    bare = f"regexp_replace(coalesce({c}, ''), '@\\S+|https?://\\S+', ' ', 'g')"
    return f"trim(regexp_replace(lower({bare}), '[^a-z0-9]+', ' ', 'g'))"


def _language(c: str) -> str:
    x = _clean(c)
    return f"""CASE
      WHEN regexp_matches({x}, '\\bque\\b|\\bles\\b|\\bdes\\b') THEN 'fr'
      WHEN regexp_matches({x}, '\\bund\\b|\\bder\\b|\\bdie\\b') THEN 'de'
      WHEN regexp_matches({x}, '\\bel\\b|\\blos\\b|\\bpor\\b') THEN 'es'
      WHEN regexp_matches({x}, '\\bthe\\b|\\band\\b') THEN 'en' END"""


def _flag(c: str) -> str:
    return f"regexp_matches({_clean(c)}, '\\b(the|tion|que|license|token)\\b')"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def _part(c: str) -> str:
    redacted = f"regexp_replace(coalesce({c}, ''), '@\\d+', '@USER', 'g')"
    return _strip(f"regexp_replace({redacted}, '\\s+\\d+\\s+\\^[A-Z]{{2,3}}\\s*$', '')")


def _redact(c: str) -> str:
    return f"regexp_replace(coalesce({c}, ''), '@\\d+', '@USER', 'g')"


_PIECES = """
lined AS (
  SELECT conv_id, turn, role, text,
         list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS ls
  FROM conversations),
cut AS (
  SELECT conv_id, turn, role,
         CASE WHEN role = 'assistant' AND len(ls) > 0 THEN ls ELSE [coalesce(text, '')] END AS ps
  FROM lined),
pieces AS (
  SELECT conv_id, turn, role, unnest(ps) AS text, generate_subscripts(ps, 1) - 1 AS part FROM cut),
placed AS (
  SELECT *, CAST((CAST(conv_id AS HUGEINT) * 1000000 + turn) * 1000000 + part AS VARCHAR) AS id,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn, part) AS pos,
         sum(CASE WHEN role <> 'assistant' THEN 1 ELSE 0 END)
           OVER (PARTITION BY conv_id ORDER BY turn, part) AS run
  FROM pieces)"""

_THREADS = f"""{_PIECES},
replies AS (
  SELECT conv_id, run, string_agg(p, ' ' ORDER BY pos) FILTER (p <> '') AS brand_reply
  FROM (SELECT conv_id, run, pos, {_part('text')} AS p FROM placed WHERE role = 'assistant')
  GROUP BY conv_id, run),
before AS (
  SELECT id, list({{'author': CASE WHEN role = 'assistant' THEN 'brand' ELSE role END,
                   'text': {_redact('text')}, 'inbound': role = 'user'}})
    OVER (PARTITION BY conv_id ORDER BY pos ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) AS ctx
  FROM placed),
threads AS (
  SELECT p.id AS thread_id, {_redact('p.text')} AS customer_text,
         coalesce(r.brand_reply, '') AS brand_reply, coalesce(b.ctx, []) AS ctx,
         regexp_matches(lower(coalesce(r.brand_reply, '')), 'tion |que\\s+le|ung ') AS escalated
  FROM placed p JOIN replies r USING (conv_id, run) JOIN before b ON p.id = b.id
  WHERE p.role = 'user')"""

_LINES = """array_to_string(list_transform(ctx,
  lambda t: t.author || ':' || CAST(t.inbound AS VARCHAR) || ':' || t.text), chr(10))"""

_BLOCK = """coalesce(array_to_string(list_transform(ctx[greatest(len(ctx) - 3, 1):],
  lambda t: '  ' || CASE WHEN t.inbound THEN 'Customer' ELSE 'Support' END || ': '
            || coalesce(t.text, '')), chr(10)), '')"""

_TRIED = """coalesce(array_to_string(list_transform(
  list_filter(ctx, lambda t: NOT t.inbound AND length(t.text) > 20),
  lambda t: '  - ' || coalesce(t.text, '')), chr(10)), '')"""

_BLOCKS = f"""{_THREADS},
blocks AS (SELECT *, {_BLOCK} AS last4, {_TRIED} AS tried FROM threads),
prompts AS (
  SELECT *, CASE WHEN last4 <> '' THEN 'Earlier turns:' || chr(10) || last4 || chr(10)
            ELSE '' END AS earlier,
         CASE WHEN tried <> '' THEN 'Already suggested:' || chr(10) || tried || chr(10)
            ELSE '' END AS suggested
  FROM blocks)"""


def _intent_of(prompt: str) -> str:
    return (f"CASE WHEN contains({prompt}, 'que ') THEN 'fr' WHEN contains({prompt}, 'und ') "
            f"THEN 'de' WHEN contains({prompt}, 'los ') THEN 'es' ELSE 'en' END")


_DOCS = f"""docs AS (
  SELECT doc_id, lang, source, n_chars, text, coalesce({_language('text')}, 'other') AS pred
  FROM documents)"""

_FLAGGED = f"""flagged AS (
  SELECT d.doc_id, d.lang, CASE WHEN {_flag('d.text')} THEN 'escalate' ELSE 'auto' END AS decision,
         CASE WHEN l.doc_id IS NULL THEN NULL WHEN l.toxic = 1 THEN 'yes' ELSE 'no' END AS truth
  FROM documents d LEFT JOIN labels l USING (doc_id))"""


def _per_class(source: str, truth: str, pred: str, by: str = "") -> str:
    """Scores per label from one row for each truth and each prediction; ``by`` ends with a comma."""
    group = f"GROUP BY {by} label"
    return f"""per_class AS (
  SELECT {by} label, sum(tp) AS tp, sum(predicted) AS predicted, sum(support) AS support,
         coalesce(sum(tp) / nullif(sum(predicted), 0), 0) AS p,
         coalesce(sum(tp) / nullif(sum(support), 0), 0) AS r,
         coalesce(2 * sum(tp) / nullif(sum(predicted) + sum(support), 0), 0) AS f
  FROM (SELECT {by} {truth} AS label, CAST({truth} = {pred} AS DOUBLE) AS tp, 0 AS predicted,
               1 AS support FROM {source}
        UNION ALL
        SELECT {by} {pred}, 0, 1, 0 FROM {source})
  {group})"""


_RATINGS = """ratings AS (
  SELECT lang, CAST(n_chars % 5 + 1 AS INTEGER) AS judge,
         CAST(len(string_split(text, ' ')) % 5 + 1 AS INTEGER) AS human
  FROM documents)"""


def _kappa(source: str, a: str, b: str, group: str = "") -> str:
    by = f"{group}," if group else ""
    keyed = f"GROUP BY {group}" if group else ""
    join = f"USING ({group})" if group else "ON true"
    return f"""observed AS (
  SELECT {by} count(*) AS n, avg(CAST({a} = {b} AS DOUBLE)) AS po FROM {source} {keyed}),
expected AS (
  SELECT {('x.' + group + ',') if group else ''} sum(x.c * y.c) AS chance
  FROM (SELECT {by} {a} AS v, CAST(count(*) AS DOUBLE) AS c FROM {source} GROUP BY {by} {a}) x
  JOIN (SELECT {by} {b} AS v, CAST(count(*) AS DOUBLE) AS c FROM {source} GROUP BY {by} {b}) y
    ON x.v = y.v {f'AND x.{group} = y.{group}' if group else ''}
  {f'GROUP BY x.{group}' if group else ''}),
agreement AS (
  SELECT {by} n, (po - chance / (n * n)) / nullif(1 - chance / (n * n), 0) AS kappa
  FROM observed JOIN expected {join})"""


def _split(source: str, label: str, key: str) -> str:
    return f"""sizes AS (SELECT {label} AS c, count(*) AS n FROM {source} WHERE {label} IS NOT NULL
  GROUP BY 1),
total AS (SELECT sum(n) AS n, CAST(ceil(round(sum(n) * 0.2, 9)) AS HUGEINT) AS test FROM sizes),
shares AS (
  SELECT c, (s.n * t.test) // t.n AS base, (s.n * t.test) % t.n AS rest, t.test
  FROM sizes s, total t),
quotas AS (
  SELECT c, base + CASE WHEN row_number() OVER (ORDER BY rest DESC, c)
                         <= test - (SELECT sum(base) FROM shares) THEN 1 ELSE 0 END AS quota
  FROM shares),
split AS (
  SELECT s.*, CASE WHEN row_number() OVER (PARTITION BY {label}
                     ORDER BY md5('7|' || CAST({key} AS VARCHAR)), {key}) <= quota
              THEN 'test' ELSE 'train' END AS split
  FROM {source} s JOIN quotas ON {label} = c)"""


def _words(c: str) -> str:
    return f"list_filter(string_split({c}, ' '), lambda w: length(w) >= 2)"


def _terms(source: str, key: str, name: str) -> str:
    return f"""{name}_words AS (SELECT {key}, {_words(_clean('text'))} AS ws FROM {source}),
{name} AS (
  SELECT {key}, term, count(*) AS tf
  FROM (SELECT {key}, unnest(list_concat(ws, list_transform(range(1, len(ws)),
          lambda i: ws[i] || ' ' || ws[i + 1]))) AS term FROM {name}_words)
  GROUP BY {key}, term)"""


_VOCAB = f"""{_terms('documents', 'doc_id', 'counts')},
vocab AS (
  SELECT term, sum(tf) AS tf, count(*) AS df,
         ln((1.0 + (SELECT count(*) FROM documents)) / (1.0 + count(*))) + 1.0 AS idf
  FROM counts GROUP BY term)"""


def _weights(counts: str, key: str, name: str) -> str:
    return f"""{name} AS (
  SELECT {key}, term, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY {key})) AS w
  FROM {counts} JOIN vocab USING (term))""".replace("tf * idf", f"{counts}.tf * vocab.idf")


_DOC_WEIGHTS = f"{_VOCAB}, {_weights('counts', 'doc_id', 'dw')}"



def _letters(source: str, key: str, text: str, name: str) -> str:
    """Letter counts of the cleaned text, and their length."""
    return f"""{name}_clean AS (SELECT {key}, {_clean(text)} AS c FROM {source}),
{name}_counts AS (SELECT {key}, list_transform(string_split('{','.join(ascii_lowercase)}', ','),
    lambda x: CAST(length(c) - length(replace(c, x, '')) AS DOUBLE)) AS e FROM {name}_clean),
{name} AS (SELECT {key}, e, sqrt(list_dot_product(e, e)) AS l FROM {name}_counts)"""


_COSINE = "coalesce(round(list_dot_product(a.e, b.e) / nullif(a.l * b.l, 0), 9), 0)"

_EXACT = """v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e
  FROM embeddings),
u AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS l FROM v),
scored AS (SELECT a.vec_id, b.vec_id AS neighbour_id,
    round(list_dot_product(a.e, b.e) / (a.l * b.l), 9) AS s
  FROM u a JOIN u b ON a.vec_id <> b.vec_id),
best AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, neighbour_id) AS rank
  FROM scored)"""

_BITS, _TABLES = APPROXIMATE["bits"], APPROXIMATE["tables"]
_LIMIT = sketch_limit(APPROXIMATE["similarity"], APPROXIMATE["recall"])
_NEAR = f"""{_EXACT},
planes AS (SELECT p, list(CASE WHEN substr(md5(p || ':' || i), 1, 1) < '8' THEN 1.0 ELSE -1.0 END
                          ORDER BY i)::DOUBLE[] AS signs
  FROM range({_BITS * _TABLES + SKETCH_BITS}) x(p), range((SELECT max(len(e)) FROM v)) y(i) GROUP BY p),
sides AS (SELECT vec_id, string_agg(CASE WHEN list_dot_product(e, signs) > 0 THEN '1' ELSE '0' END, ''
                                    ORDER BY p) AS side
  FROM v, planes GROUP BY vec_id),
codes AS (SELECT vec_id, t, substr(side, t * {_BITS} + 1, {_BITS}) AS code FROM sides, range({_TABLES}) z(t)),
met AS (SELECT DISTINCT a.vec_id, b.vec_id AS neighbour_id FROM codes a JOIN codes b
  ON a.t = b.t AND a.code = b.code AND a.vec_id <> b.vec_id),
alike AS (SELECT m.* FROM met m JOIN sides a ON a.vec_id = m.vec_id JOIN sides b ON b.vec_id = m.neighbour_id
  WHERE bit_count(xor(CAST(substr(a.side, {_BITS * _TABLES + 1}) AS BIT),
                      CAST(substr(b.side, {_BITS * _TABLES + 1}) AS BIT))) <= {_LIMIT}),
near AS (SELECT vec_id, neighbour_id, s, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, neighbour_id) AS rank
  FROM scored JOIN alike USING (vec_id, neighbour_id))"""

_ANSWERS = """kinds AS (
  SELECT conv_id, turn, (conv_id + turn + length(text)) % 7 AS kind,
         regexp_replace(text, '["\\\\\\n]', ' ', 'g') AS head
  FROM conversations)"""

_GOLDEN = f"""{_BLOCKS},
golden AS (
  SELECT *, coalesce({_language('brand_reply')}, 'other') AS truth,
         length(brand_reply) % 5 + 1 AS human,
         CAST(greatest(1, least(5, length('Message:' || chr(10) || customer_text || chr(10)
           || 'Reply:' || chr(10) || brand_reply) % 7)) AS INTEGER) AS judge
  FROM prompts)"""


def _mode(prompt: str, name: str) -> str:
    return f"""{name}_rows AS (SELECT truth, {_intent_of(prompt)} AS pred FROM golden
  WHERE len(ctx) > 0),
{_per_class(f'{name}_rows', 'truth', 'pred').replace('per_class', f'{name}_class')},
{name} AS (SELECT (SELECT count(*) FROM {name}_rows) AS n,
  (SELECT avg(CAST(truth = pred AS DOUBLE)) FROM {name}_rows) AS acc, avg(f) AS f1
  FROM {name}_class)"""


_SYSTEMS = f"""{_DOCS}, {_FLAGGED},
top AS (SELECT lang FROM documents GROUP BY lang ORDER BY count(*) DESC, lang LIMIT 1),
preds AS (
  SELECT 'trivial' AS system, f.truth, f.lang, (SELECT lang FROM top) AS pred, 'auto' AS decision
  FROM flagged f
  UNION ALL
  SELECT 'rules', f.truth, f.lang, d.pred, f.decision FROM flagged f JOIN docs d USING (doc_id)),
{_per_class('preds', 'lang', 'pred', 'system, ')},
intent AS (SELECT system, sum(tp) / sum(support) AS intent_accuracy, avg(f) AS intent_macro_f1
  FROM per_class GROUP BY system),
esc AS (
  SELECT system, count(*) AS n, count(*) FILTER ((truth = 'yes') = (decision = 'escalate')) AS ok,
         count(*) FILTER (truth = 'yes' AND decision = 'escalate') AS tp,
         count(*) FILTER (decision = 'escalate') AS pp, count(*) FILTER (truth = 'yes') AS pos
  FROM preds WHERE truth IN ('yes', 'no') GROUP BY system),
scores AS (
  SELECT system, round(intent_accuracy, 6) AS intent_accuracy,
         round(intent_macro_f1, 6) AS intent_macro_f1, round(ok / n, 6) AS escalation_accuracy,
         round(coalesce(tp / nullif(pp, 0), 0), 6) AS escalation_precision,
         round(coalesce(tp / nullif(pos, 0), 0), 6) AS escalation_recall,
         round(coalesce(2 * tp / nullif(pp + pos, 0), 0), 6) AS escalation_f1
  FROM intent LEFT JOIN esc USING (system))"""

_METRICS = ("intent_accuracy", "intent_macro_f1", "escalation_accuracy", "escalation_precision",
            "escalation_recall", "escalation_f1")

ORACLES: dict[str, str] = {
    "thread_table": f"""WITH {_THREADS}
SELECT thread_id, customer_text, brand_reply, len(ctx) AS n_context,
       coalesce({_LINES}, '') AS context, escalated FROM threads""",
    "threads_stitch": f"WITH {_THREADS} SELECT thread_id, brand_reply FROM threads",
    "first_reply": f"""WITH {_PIECES}
SELECT u.id AS thread_id, b.id AS reply_id, b.text AS reply_text
FROM placed u JOIN placed b ON u.conv_id = b.conv_id AND b.turn = u.turn + 1
WHERE u.role = 'user' AND b.role = 'assistant' AND b.part = 0""",
    "threads_context": f"""WITH {_THREADS}
SELECT thread_id, len(ctx) AS n_context, coalesce({_LINES}, '') AS context FROM threads""",
    "escalation_totals": f"""WITH {_THREADS}
SELECT count(*) AS threads, count(*) FILTER (escalated) AS escalated,
       round(avg(CAST(escalated AS DOUBLE)), 6) AS escalation_rate FROM threads""",
    "context_share": f"""WITH {_THREADS}
SELECT count(*) AS threads, count(*) FILTER (len(ctx) > 0) AS with_context,
       round(count(*) FILTER (len(ctx) > 0) / count(*), 6) AS context_share FROM threads""",
    "pool_sizes": f"""WITH {_THREADS}
SELECT len(ctx) > 0 AS has_context, count(*) AS n FROM threads GROUP BY 1""",
    "context_blocks": f"WITH {_BLOCKS} SELECT thread_id, last4, tried FROM blocks",
    "rolling6": """SELECT conv_id, turn, coalesce(array_to_string(list(role || ':' || text) OVER (
  PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING), chr(10)), '')
  AS buffer FROM conversations""",
    "thread_preview": f"""WITH {_THREADS} SELECT thread_id, substring(customer_text, 1, 100)
  AS customer_text, substring(brand_reply, 1, 100) AS brand_reply
FROM threads ORDER BY thread_id LIMIT 3""",
    "tweet_csv": f"""WITH {_PIECES}
SELECT id AS tweet_id, CASE WHEN role = 'assistant' THEN 'brand' ELSE role END AS author_id,
  role = 'user' AS inbound, text, lead(id) OVER w AS response_tweet_id,
  lag(id) OVER w AS in_response_to_tweet_id
FROM placed WINDOW w AS (PARTITION BY conv_id ORDER BY pos)""",
    "thread_csv": f"""WITH {_THREADS}
SELECT thread_id, customer_text, brand_reply, coalesce({_LINES}, '') AS context, escalated
FROM threads WHERE customer_text <> '' AND brand_reply <> ''""",
    "prediction_table": f"""WITH {_DOCS}
SELECT 'rules' AS system, pred, count(*) AS n FROM docs GROUP BY pred
UNION ALL SELECT 'trivial', 'en', count(*) FROM docs""",
    "vector_table": """SELECT vec_id AS thread_id, CAST(1.0 AS DOUBLE) AS length
FROM embeddings""",
    "live_labels": f"""SELECT conv_id, turn, {_redact('text')} AS redacted,
  CASE WHEN contains(lower(text), 'que ') THEN 'fr' WHEN contains(lower(text), 'und ') THEN 'de'
       WHEN contains(lower(text), 'los ') THEN 'es' ELSE 'other' END AS intent,
  CASE WHEN regexp_matches(lower(text),
    '(^|[^\\p{{L}}\\p{{N}}_])(the|tion|que|license|token)($|[^\\p{{L}}\\p{{N}}_])')
    THEN 'escalate' ELSE 'auto' END AS decision
FROM conversations""",
    "redact_clean": f"""SELECT doc_id, {_redact('text')} AS redacted,
  {_strip("regexp_replace(text, '\\s+\\d+\\s+\\^[A-Z]{2,3}\\s*$', '')")} AS stripped,
  {_clean('text')} AS cleaned FROM documents""",
    "rule_label": f"SELECT doc_id, {_language('text')} AS label FROM documents",
    "rule_histogram": f"WITH {_DOCS} SELECT pred, count(*) AS n FROM docs GROUP BY pred",
    "keyword_decision": f"""SELECT doc_id,
  CASE WHEN {_flag('text')} THEN 'escalate' ELSE 'auto' END AS decision,
  CASE WHEN {_flag('text')} THEN '{ESCALATED_REASON}' ELSE '{NOT_ESCALATED_REASON}' END AS reason
FROM documents""",
    "resolve_labels": """SELECT doc_id, raw, CASE raw WHEN '1' THEN 'en' WHEN '2' THEN 'fr'
    WHEN '3' THEN 'de' WHEN '4' THEN 'es' WHEN 'n' THEN 'en' WHEN 'e' THEN 'en' WHEN 'f' THEN 'fr'
    WHEN 'r' THEN 'fr' WHEN 'd' THEN 'de' WHEN 's' THEN 'es' END AS label
FROM (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN CAST(n_chars % 7 AS VARCHAR)
        WHEN 1 THEN substring(lang, 2, 1) ELSE substring(lang, 1, 1) END AS raw FROM documents)""",
    "rating_parse": """SELECT doc_id, CAST(n_chars % 5 + 1 AS INTEGER) AS rating
FROM documents WHERE doc_id % 4 <> 1""",
    "stratified_sample": """SELECT doc_id, lang FROM (
  SELECT doc_id, lang, row_number() OVER (PARTITION BY lang
    ORDER BY md5('7|' || CAST(doc_id AS VARCHAR)), doc_id) AS place FROM documents)
WHERE place <= 22""",
    "random_slice": """SELECT doc_id FROM documents
ORDER BY md5('7|' || CAST(doc_id AS VARCHAR)), doc_id LIMIT 24""",
    "golden_sample": f"""WITH ruled AS (SELECT doc_id, {_language('text')} AS label FROM documents),
picked AS (SELECT doc_id, label FROM (
  SELECT *, row_number() OVER (PARTITION BY label
    ORDER BY md5('7|' || CAST(doc_id AS VARCHAR)), doc_id) AS place
  FROM ruled WHERE label IS NOT NULL) WHERE place <= 22),
slice AS (SELECT doc_id, label FROM ruled WHERE doc_id NOT IN (SELECT doc_id FROM picked)
  ORDER BY md5('8|' || CAST(doc_id AS VARCHAR)), doc_id LIMIT 24)
SELECT doc_id, coalesce(label, 'other') AS suggested_intent
FROM (SELECT * FROM picked UNION ALL SELECT * FROM slice)""",
    "stratified_split": f"""WITH {_split('labels', 'quality', 'doc_id')}
SELECT doc_id, quality, split FROM split""",
    "batch_cap": "SELECT doc_id, lang FROM documents ORDER BY doc_id LIMIT 100",
    "unlabelled": """SELECT doc_id, lang FROM documents
WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = documents.doc_id)""",
    "label_progress": """WITH c AS (SELECT count(*) AS total, count(*) FILTER (
    doc_id IN (SELECT doc_id FROM labels)) AS labelled FROM documents)
SELECT total, labelled, total - labelled AS remaining,
  CAST(floor(labelled * 100 / total) AS BIGINT) AS percent,
  CASE WHEN labelled < 150 THEN 'need_more' WHEN labelled < 200 THEN 'good' ELSE 'complete' END
  AS status FROM c""",
    "append_labels": """SELECT d.doc_id, d.lang AS label FROM documents d
WHERE d.doc_id NOT IN (SELECT doc_id FROM labels)
UNION ALL SELECT doc_id, CAST(quality AS VARCHAR) FROM labels""",
    "confusion": f"""WITH {_DOCS} SELECT lang AS truth, pred, count(*) AS n
FROM docs GROUP BY lang, pred""",
    "class_report": f"""WITH {_DOCS}, {_per_class('docs', 'lang', 'pred')},
t AS (SELECT sum(support) AS n, sum(tp) AS tp FROM per_class)
SELECT label, round(p, 6) AS precision, round(r, 6) AS recall, round(f, 6) AS f1,
       CAST(support AS BIGINT) AS support FROM per_class
UNION ALL SELECT 'accuracy', round(tp / n, 6), round(tp / n, 6), round(tp / n, 6),
       CAST(n AS BIGINT) FROM t
UNION ALL SELECT 'macro avg', round(avg(p), 6), round(avg(r), 6), round(avg(f), 6),
       CAST(sum(support) AS BIGINT) FROM per_class
UNION ALL SELECT 'weighted avg', round(sum(p * support) / sum(support), 6),
       round(sum(r * support) / sum(support), 6), round(sum(f * support) / sum(support), 6),
       CAST(sum(support) AS BIGINT) FROM per_class""",
    "intent_metrics": f"""WITH {_DOCS}, {_per_class('docs', 'lang', 'pred', 'source, ')}
SELECT source, CAST(sum(support) AS BIGINT) AS n, round(sum(tp) / sum(support), 6) AS accuracy,
       round(avg(f), 6) AS macro_f1 FROM per_class GROUP BY source""",
    "error_listing": f"""WITH {_DOCS}, wrong AS (
  SELECT lang, pred, doc_id, text, row_number() OVER (PARTITION BY lang, pred ORDER BY doc_id)
  AS place FROM docs WHERE lang <> pred)
SELECT lang AS truth, pred, count(*) AS n,
       string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) FILTER (place <= 3) AS ids,
       string_agg(text, ',' ORDER BY doc_id) FILTER (place <= 3) AS texts
FROM wrong GROUP BY lang, pred""",
    "binary_metrics": f"""WITH {_FLAGGED}, s AS (
  SELECT count(*) AS n, count(*) FILTER ((truth = 'yes') = (decision = 'escalate')) AS ok,
         count(*) FILTER (truth = 'yes' AND decision = 'escalate') AS tp,
         count(*) FILTER (decision = 'escalate') AS pp, count(*) FILTER (truth = 'yes') AS pos
  FROM flagged WHERE truth IN ('yes', 'no'))
SELECT n, round(ok / n, 6) AS accuracy, round(coalesce(tp / nullif(pp, 0), 0), 6) AS precision,
       round(coalesce(tp / nullif(pos, 0), 0), 6) AS recall,
       round(coalesce(2 * tp / nullif(pp + pos, 0), 0), 6) AS f1 FROM s WHERE n > 0""",
    "rate_by_class": f"""WITH {_FLAGGED}, s AS (
  SELECT lang, count(*) AS n, avg(CAST(decision = 'escalate' AS DOUBLE)) AS r
  FROM flagged GROUP BY lang)
SELECT lang, n, round(r, 6) AS rate, round(1.96 * sqrt(r * (1 - r) / n), 6) AS half_width FROM s""",
    "kappa": f"""WITH {_RATINGS}, {_kappa('ratings', 'judge', 'human', 'lang')}
SELECT lang, n, round(kappa, 6) AS kappa FROM agreement""",
    "pearson": f"""WITH {_RATINGS}
SELECT lang, count(*) AS n, round(corr(judge, human), 6) AS pearson_r
FROM ratings GROUP BY lang""",
    "rater_offset": f"""WITH {_RATINGS}
SELECT lang, count(*) AS n, round(avg(CAST(abs(judge - human) <= 1 AS DOUBLE)), 6) AS within_one,
       round(avg(judge - human), 6) AS mean_offset FROM ratings GROUP BY lang""",
    "systems_scores": f"WITH {_SYSTEMS} SELECT * FROM scores",
    "systems_summary": f"WITH {_SYSTEMS} " + " UNION ALL ".join(
        f"SELECT '{m}' AS metric, max({m}) FILTER (system = 'rules') AS rules, "
        f"max({m}) FILTER (system = 'trivial') AS trivial FROM scores" for m in _METRICS),
    "tfidf_stats": f"WITH {_VOCAB} SELECT term, df, round(idf, 6) AS idf FROM vocab",
    "tfidf_vectors": f"WITH {_DOC_WEIGHTS} SELECT doc_id, term, round(w, 6) AS w FROM dw",
    "tfidf_nn": f"""WITH {_DOC_WEIGHTS}, {_terms('benchmark', 'item_id', 'asked')},
{_weights('asked', 'item_id', 'qw')},
scored AS (SELECT item_id, doc_id, round(sum(qw.w * dw.w), 9) AS s
  FROM qw JOIN dw USING (term) GROUP BY item_id, doc_id),
best AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY s DESC, doc_id) AS place
  FROM scored)
SELECT b.item_id, coalesce(doc_id, (SELECT min(doc_id) FROM documents)) AS doc_id,
       round(coalesce(s, 0), 6) AS score
FROM benchmark b LEFT JOIN (SELECT * FROM best WHERE place = 1) x ON b.item_id = x.item_id""",
    "tfidf_nn_other": f"""WITH {_DOC_WEIGHTS},
scored AS (SELECT a.doc_id, b.doc_id AS other, round(sum(a.w * b.w), 9) AS s
  FROM dw a JOIN dw b ON a.term = b.term AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
best AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY s DESC, other) AS place
  FROM scored),
lowest AS (SELECT min(doc_id) AS a FROM documents),
next AS (SELECT min(doc_id) AS b FROM documents, lowest WHERE doc_id <> a)
SELECT d.doc_id, coalesce(other, CASE WHEN d.doc_id = a THEN b ELSE a END) AS neighbour_id,
       round(coalesce(s, 0), 6) AS score
FROM documents d CROSS JOIN lowest CROSS JOIN next
LEFT JOIN (SELECT * FROM best WHERE place = 1) x ON d.doc_id = x.doc_id""",
    "vector_neighbours": f"""WITH {_EXACT}
SELECT vec_id, rank, neighbour_id, round(s, 6) AS score FROM best WHERE rank <= 3""",
    "stored_neighbours": f"""WITH {_EXACT}
SELECT vec_id, rank, neighbour_id, round(s, 6) AS score FROM best WHERE rank <= 3 AND vec_id % 20 = 0""",
    "approx_neighbours": f"""WITH {_NEAR}
SELECT vec_id, rank, neighbour_id, round(s, 6) AS score FROM near WHERE rank <= 3""",
    "approx_recall": f"""WITH {_NEAR},
wanted AS (SELECT b.vec_id, n.vec_id IS NOT NULL AS hit FROM best b LEFT JOIN
  (SELECT * FROM near WHERE rank <= 3) n ON n.vec_id = b.vec_id AND n.neighbour_id = b.neighbour_id
  WHERE b.rank <= 3)
SELECT count(*) AS n_wanted, count(*) FILTER (hit) AS n_found,
       round(count(*) FILTER (hit) / count(*), 6) AS recall,
       (SELECT count(*) FROM alike) AS n_scored,
       round((SELECT count(*) FROM alike) / (SELECT count(*) FROM scored), 6) AS scored_share FROM wanted""",
    "embed_search": f"""WITH {_letters('benchmark', 'item_id', 'text', 'asked')},
{_letters('documents', 'doc_id', 'text', 'held')},
near AS (SELECT a.item_id, b.doc_id, {_COSINE} AS s FROM asked a, held b),
best AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY s DESC, doc_id) AS rank FROM near)
SELECT item_id, rank, doc_id, round(s, 6) AS score FROM best WHERE rank <= 3""",
    "agent_batch": f"""WITH {_BLOCKS},
{_letters('threads', 'thread_id', 'customer_text', 'u')},
near AS (SELECT a.thread_id, b.thread_id AS other, {_COSINE} AS s
  FROM u a JOIN u b ON a.thread_id <> b.thread_id),
best AS (SELECT *, row_number() OVER (PARTITION BY thread_id ORDER BY s DESC, other) AS rank FROM near),
hits AS (SELECT b.thread_id, string_agg(other, ',' ORDER BY rank) AS sources,
    string_agg('Case ' || rank || ':' || chr(10) || '  Customer: ' || t.customer_text || chr(10)
               || '  Support: ' || t.brand_reply, chr(10) || chr(10) ORDER BY rank) AS examples
  FROM best b JOIN threads t ON t.thread_id = b.other WHERE rank <= 3 GROUP BY b.thread_id),
classified AS (SELECT *, {_intent_of("(earlier || 'Message:' || chr(10) || customer_text)")} AS intent FROM prompts),
asked AS (SELECT c.*, coalesce(h.sources, '') AS sources,
    'Intent: ' || intent || chr(10) || earlier || suggested || 'Similar cases:' || chr(10)
    || coalesce(examples, '') || chr(10) || chr(10) || 'Message:' || chr(10) || customer_text AS draft
  FROM classified c LEFT JOIN hits h USING (thread_id)),
told AS (SELECT *, {_intent_of('draft')} AS said FROM asked),
drafted AS (SELECT *, 'Intent: ' || intent || chr(10) || earlier || 'Message:' || chr(10) || customer_text
    || chr(10) || 'Draft:' || chr(10) || '{{"intent": "' || said || '", "confidence": "high", "decision": "'
    || CASE WHEN said = 'fr' THEN 'escalate' ELSE 'auto' END || '", "reason": "' || said || '", "score": '
    || length(draft) % 7 || '}}' AS asking FROM told),
decided AS (SELECT *, {_intent_of('asking')} AS verdict FROM drafted)
SELECT thread_id, last4 <> '' AS had_context, intent, 'high' AS confidence, sources,
  CASE WHEN verdict = 'fr' THEN 'escalate' ELSE 'auto' END AS decision, verdict AS reason FROM decided""",
    "grounding": """WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e
  FROM embeddings),
s AS (SELECT vec_id, e, unnest([vec_id + 1, vec_id * 2, CAST(label AS BIGINT), -1]) AS src FROM v),
j AS (SELECT s.vec_id, count(*) AS n, avg(list_dot_product(s.e, v.e)
    / (sqrt(list_dot_product(s.e, s.e)) * sqrt(list_dot_product(v.e, v.e)))) AS g
  FROM s JOIN v ON s.src = v.vec_id GROUP BY s.vec_id)
SELECT v.vec_id AS draft_id, coalesce(n, 0) AS n_sources, round(coalesce(g, 0), 6) AS grounding
FROM v LEFT JOIN j USING (vec_id)""",
    "prompt_build": f"""WITH {_BLOCKS}
SELECT thread_id, earlier || 'Message:' || chr(10) || customer_text AS classify,
  'Intent: other' || chr(10) || earlier || suggested || 'Similar cases:' || chr(10) || brand_reply
    || chr(10) || chr(10) || 'Message:' || chr(10) || customer_text AS draft,
  'Intent: other' || chr(10) || earlier || 'Message:' || chr(10) || customer_text || chr(10)
    || 'Draft:' || chr(10) || brand_reply AS decide
FROM prompts""",
    "parse_classify": f"""WITH {_ANSWERS}, said AS (
  SELECT *, lower('I think escalate or es: ' || head) AS t FROM kinds)
SELECT conv_id, turn, CASE kind WHEN 0 THEN 'de' WHEN 4 THEN 'fr' WHEN 2 THEN
    CASE WHEN contains(t, 'en') THEN 'en' WHEN contains(t, 'fr') THEN 'fr'
         WHEN contains(t, 'de') THEN 'de' ELSE 'es' END
  ELSE 'other' END AS intent,
  CASE WHEN kind IN (0, 1, 6) THEN 'high' WHEN kind = 3 THEN NULL ELSE 'low' END AS confidence
FROM said""",
    "parse_decision": f"""WITH {_ANSWERS}
SELECT conv_id, turn, CASE WHEN kind IN (0, 2, 4) THEN 'escalate' ELSE 'auto' END AS decision,
  CASE kind WHEN 2 THEN 'I think escalate or es: ' || head WHEN 3 THEN NULL
    WHEN 4 THEN '["fr", "escalate"]' WHEN 5 THEN '' ELSE head END AS reason FROM kinds""",
    "parse_judge": f"""WITH {_ANSWERS}
SELECT conv_id, turn,
  CAST(CASE kind WHEN 0 THEN 4 WHEN 1 THEN 5 WHEN 6 THEN 5 ELSE 3 END AS INTEGER) AS score,
  CASE WHEN kind IN (0, 1, 6) THEN head WHEN kind = 3 THEN '' ELSE 'parse error' END AS reason
FROM kinds""",
    "cache_keys": """SELECT conv_id, turn,
  sha256(CAST(to_json(['local', 'rules', 'system', text]) AS VARCHAR)) AS key FROM conversations""",
    "cache_lookup": """WITH cached AS (SELECT DISTINCT text FROM conversations WHERE role = 'user')
SELECT 'hit' AS kind, count(*) AS n FROM conversations WHERE text IN (SELECT text FROM cached)
UNION ALL SELECT 'miss', count(DISTINCT text) FROM conversations
WHERE text NOT IN (SELECT text FROM cached)""",
    "model_cache_stats": """SELECT count(*) AS entries,
  round(sum(strlen(r)) / 1024, 1) AS size_kb FROM (
  SELECT text, lower(text) AS r FROM (SELECT DISTINCT text FROM conversations))""",
    "model_answers": f"""SELECT conv_id, turn, {_intent_of('text')} AS intent, 'high' AS confidence,
  CAST(greatest(1, least(5, length(text) % 7)) AS INTEGER) AS score FROM conversations""",
    "cached_run": f"""WITH r AS (SELECT conv_id, turn, {_intent_of('text')} AS intent,
  text IN (SELECT text FROM conversations WHERE role = 'user') AS stored FROM conversations)
SELECT conv_id, turn, intent, CASE WHEN stored THEN intent ELSE 'new ' || intent END AS reason, stored FROM r""",
    "ablation": f"""WITH {_GOLDEN},
{_mode("(earlier || 'Message:' || chr(10) || customer_text)", 'w')},
{_mode("('Message:' || chr(10) || customer_text)", 'o')}
SELECT w.n AS n_with_context, round(w.acc, 4) AS accuracy_with_context,
  round(o.acc, 4) AS accuracy_no_context, round(w.acc - o.acc, 4) AS accuracy_delta,
  round(w.f1, 4) AS macro_f1_with_context, round(o.f1, 4) AS macro_f1_no_context,
  round(w.f1 - o.f1, 4) AS macro_f1_delta,
  (SELECT count(*) FROM golden WHERE len(ctx) = 0) AS n_without_context
FROM w, o""",
    "judge_scores": f"WITH {_GOLDEN} SELECT thread_id, judge AS judge_score FROM golden",
    "judge_calibration": f"""WITH {_GOLDEN}, {_kappa('golden', 'judge', 'human')}
SELECT n AS judge_calibration_n, round(kappa, 6) AS judge_human_kappa,
  (SELECT round(corr(judge, human), 6) FROM golden) AS judge_human_pearson_r,
  (SELECT round(avg(CAST(abs(judge - human) <= 1 AS DOUBLE)), 6) FROM golden) AS within_one,
  (SELECT round(avg(judge - human), 6) FROM golden) AS mean_offset
FROM agreement""",
    "judge_mean": f"""WITH {_GOLDEN}
SELECT round(avg(judge), 6) AS judge_mean_score FROM golden""",
    "trivial_predict": f"""WITH {_split('documents', 'lang', 'doc_id')},
top AS (SELECT lang FROM split WHERE split = 'train' GROUP BY lang ORDER BY count(*) DESC, lang
  LIMIT 1)
SELECT doc_id AS thread_id, (SELECT lang FROM top) AS intent, 'high' AS confidence,
  '{CANNED_REPLY}' AS reply, 'auto' AS decision, '{CONSTANT_REASON}' AS reason FROM documents""",
}
ORACLES["live_rolling6"] = ORACLES["rolling6"]
ORACLES["evaluation_run"] = ORACLES["systems_scores"]
ORACLES["context_scan"] = f"SELECT thread_id, n_context FROM ({ORACLES['thread_table']})"
ORACLES["labelled_scan"] = """SELECT CAST(doc_id AS VARCHAR) AS doc_id, lang AS intent,
  CASE WHEN n_chars % 2 = 0 THEN coalesce(source, '') ELSE '' END AS source, length(text) AS n_text
FROM documents WHERE doc_id % 3 = 2 AND trim(lang) <> ''"""
ORACLES["golden_table"] = f"""WITH usable AS (
  SELECT *, {_clean('text')} AS cleaned, {_language('text')} AS label FROM documents
  WHERE text IS NOT NULL AND source IS NOT NULL),
picked AS (SELECT doc_id, label FROM (
  SELECT *, row_number() OVER (PARTITION BY label
    ORDER BY md5('7|' || CAST(doc_id AS VARCHAR)), doc_id) AS place
  FROM usable WHERE label IS NOT NULL) WHERE place <= 22),
slice AS (SELECT doc_id, label FROM usable WHERE doc_id NOT IN (SELECT doc_id FROM picked)
  ORDER BY md5('8|' || CAST(doc_id AS VARCHAR)), doc_id LIMIT 24),
golden AS (SELECT doc_id, coalesce(label, 'other') AS suggested_intent
  FROM (SELECT * FROM picked UNION ALL SELECT * FROM slice)),
{_split('golden', 'suggested_intent', 'doc_id')}
SELECT doc_id AS thread_id, cleaned AS customer_text, source AS brand_reply, split.suggested_intent,
  n_chars % 2 = 0 AS escalated, CAST(NULL AS VARCHAR) AS intent, CAST(NULL AS VARCHAR) AS should_escalate,
  CAST(NULL AS VARCHAR) AS reply_quality, split.split AS split
FROM split JOIN usable USING (doc_id)"""
ORACLES["batch_predict"] = f"""SELECT doc_id AS thread_id, coalesce({_language('text')}, 'other') AS intent,
  'medium' AS confidence, CAST(NULL AS VARCHAR) AS reply,
  CASE WHEN {_flag('text')} THEN 'escalate' ELSE 'auto' END AS decision
FROM documents WHERE text <> ''"""
ORACLES["evaluation_predictions"] = f"""WITH {_DOCS}, {_FLAGGED},
top AS (SELECT lang FROM documents GROUP BY lang ORDER BY count(*) DESC, lang LIMIT 1)
SELECT 'rules' AS system, f.doc_id AS thread_id, f.lang AS true_intent, f.truth AS true_escalate,
  d.pred AS pred_intent, f.decision AS pred_decision, '' AS pred_reply
FROM flagged f JOIN docs d USING (doc_id)
UNION ALL
SELECT 'trivial', doc_id, lang, truth, (SELECT lang FROM top), 'auto', '{CANNED_REPLY}' FROM flagged"""
ORACLES["saved_model"] = "SELECT count(*) AS n, count(*) AS n_alike FROM documents"
