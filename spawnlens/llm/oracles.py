"""DuckDB SQL for queries of this subpackage, where SQL can express them."""

from __future__ import annotations

from .chat import AFTER_ROLE, CLOSE, OPEN
from .licences import CUT_RULES, CUT_SENTENCES, LINES, RULES, SENTENCES, VERSION, WRAPPED

TOP_K = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= 10
"""

NEAR = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN []::VARCHAR[] WHEN len(ws) = 1 THEN [ws[1]]
    ELSE list_sort(list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]))) END AS s FROM w),
classes AS (SELECT s, min(doc_id) AS id FROM sets WHERE len(s) > 0 GROUP BY s),
elements AS (SELECT id, len(s) AS n, unnest(s) AS e FROM classes),
links AS (
  SELECT a.id AS a, b.id AS b FROM elements a JOIN elements b ON a.e = b.e AND a.id < b.id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY a.id, b.id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT a AS id, a AS other FROM both_ways UNION SELECT r.id, l.b FROM reach r JOIN both_ways l ON l.a = r.other),
comps AS (SELECT id, min(other) AS comp FROM reach GROUP BY id)
SELECT d.doc_id, CAST(len(d.s) AS BIGINT) AS n_shingles, coalesce(m.comp, c.id, d.doc_id) AS component_id, coalesce(m.comp, c.id, d.doc_id) = d.doc_id AS kept
FROM sets d LEFT JOIN classes c ON c.s = d.s LEFT JOIN comps m ON m.id = c.id
"""


def _escaped(x: str) -> str:
    return f"replace(replace(replace({x}, '\\', '\\\\'), '<', '\\l'), '|', '\\p')"


CHAT = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '\\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\\### Assistant: </turn> ok')) x(conv_id, turn, role, text)),
g AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
    coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss,
    CAST(sum(length({_escaped("role")}) + length({_escaped("text")}) + {len(OPEN + AFTER_ROLE + CLOSE)}) AS BIGINT) AS formatted_chars FROM t GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM g
"""


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _ids(cut: str) -> str:
    known = "MAP {" + ", ".join(f"{_quoted(k)}: {_quoted(v)}" for k, v in (SENTENCES | CUT_SENTENCES).items()) + "}"
    clean = "regexp_replace(regexp_replace(s, '[^a-z0-9.]+', ' ', 'g'), '^[ .]+|[ .]+$', '', 'g')"
    return f"list_filter(list_transform(regexp_split_to_array(t, {_quoted(cut)}), lambda s: ({known})[{clean}]), lambda x: x IS NOT NULL)"


def _licences(col: str) -> str:
    rules = "[" + ", ".join(f"{{'licence': {_quoted(n)}, 'seq': {_quoted('% ' + ' % '.join(s) + ' %')}}}" for n, s in RULES + CUT_RULES) + "]"
    return f"list_transform(list_filter({rules}, lambda r: (' ' || array_to_string({col}, '  ') || ' ') LIKE r.seq), lambda r: r.licence)"


LICENCES = f"""
WITH d AS (SELECT doc_id, regexp_replace(lower(coalesce(text, '')), {_quoted(VERSION)}, 'v.\\1', 'g') AS t FROM documents),
i AS (SELECT doc_id, {_ids(LINES)} AS by_line, {_ids(WRAPPED)} AS wrapped FROM d),
l AS (SELECT doc_id, CASE WHEN len(wrapped) > len(by_line) THEN wrapped ELSE by_line END AS ids,
  list_sort(list_distinct(list_concat(CASE WHEN len(by_line) > 0 THEN {_licences("by_line")} ELSE []::VARCHAR[] END, CASE WHEN len(wrapped) > 0 THEN {_licences("wrapped")} ELSE []::VARCHAR[] END))) AS found FROM i)
SELECT doc_id, array_to_string(ids, ',') AS sentence_ids, array_to_string(found, ',') AS licences, CAST(len(found) AS BIGINT) AS n_licences FROM l
"""

REPEATS = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
p AS (SELECT doc_id, h, unnest(range(0, CAST(length(h) / 2 AS BIGINT))) AS i FROM d),
w AS (SELECT doc_id, i, md5_number(substr(h, 2 * i + 1, 100)) AS k FROM p WHERE 2 * i + 100 <= length(h)),
m AS (SELECT k, min(doc_id) AS least FROM w GROUP BY k),
hit AS (SELECT w.doc_id, w.i FROM w JOIN m USING (k) WHERE m.least < w.doc_id),
edges AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM hit),
islands AS (SELECT doc_id, i, sum(CASE WHEN before IS NULL OR i > before + 50 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM edges),
spans AS (SELECT doc_id, g, min(i) AS a, max(i) + 50 AS b FROM islands GROUP BY doc_id, g),
gaps AS (SELECT s.doc_id, s.a, s.b, substr(d.h, 2 * coalesce(lag(s.b) OVER (PARTITION BY s.doc_id ORDER BY s.a), 0) + 1, 2 * (s.a - coalesce(lag(s.b) OVER (PARTITION BY s.doc_id ORDER BY s.a), 0))) AS kept FROM spans s JOIN d USING (doc_id)),
sums AS (SELECT doc_id, count(*) AS n_spans, sum(b - a) AS n_removed, max(b) AS last, string_agg(kept, '' ORDER BY a) AS kept FROM gaps GROUP BY doc_id)
SELECT d.doc_id, CAST(length(d.h) / 2 AS BIGINT) AS n_bytes, CAST(coalesce(s.n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(s.n_spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(s.kept, '') || substr(d.h, 2 * coalesce(s.last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN sums s USING (doc_id)
"""

_STEPS = " UNION ALL ".join(f"SELECT filter_order, {k + 1} AS step, f{k + 1} AS f, [{', '.join(f'f{j + 1}' for j in range(k))}]::VARCHAR[] AS earlier FROM p" for k in range(5))

AUDIT = rf"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
firsts AS (SELECT t, min(doc_id) AS least FROM d GROUP BY t),
l AS (SELECT doc_id, max(coalesce(CAST(quality = 1 AS INTEGER), 0)) AS good, max(coalesce(CAST(toxic = 1 AS INTEGER), 0)) AS toxic FROM labels GROUP BY doc_id),
m AS (
  SELECT d.part, coalesce(l.good, 0) AS good, coalesce(l.toxic, 0) AS toxic, list_concat(
    CASE WHEN len(ws) < 200 THEN ['A'] ELSE [] END,
    CASE WHEN 100 * len(list_distinct(ws)) < 50 * len(ws) THEN ['B'] ELSE [] END,
    CASE WHEN 100 * (length(d.t) - length(regexp_replace(d.t, '[A-Z]', '', 'g'))) > 3 * length(d.t) THEN ['C'] ELSE [] END,
    CASE WHEN regexp_matches(d.t, '[#$%&*|]') THEN ['D'] ELSE [] END,
    CASE WHEN d.doc_id > f.least THEN ['E'] ELSE [] END) AS fails
  FROM d JOIN firsts f ON d.t = f.t LEFT JOIN l ON d.doc_id = l.doc_id),
c AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY part, fails),
x(f) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
p AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS filter_order, a.f AS f1, b.f AS f2, c.f AS f3, d.f AS f4, e.f AS f5 FROM x a, x b, x c, x d, x e
  WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
s AS ({_STEPS}),
r AS (
  SELECT part, filter_order, step, f, list_contains(fails, f) AS fails_it, list_has_any(fails, earlier) AS gone, fails = [f] AS alone, n, good, toxic FROM c CROSS JOIN s),
g AS (
  SELECT part, filter_order, step, f, coalesce(sum(n) FILTER (NOT fails_it AND NOT gone), 0) AS kept, coalesce(sum(n) FILTER (fails_it AND NOT gone), 0) AS removed,
    coalesce(sum(n) FILTER (fails_it AND gone), 0) AS redundant, coalesce(sum(n) FILTER (alone), 0) AS unique_fails,
    coalesce(sum(good) FILTER (fails_it AND NOT gone), 0) AS good_lost, coalesce(sum(toxic) FILTER (fails_it AND NOT gone), 0) AS toxic_lost
  FROM r GROUP BY part, filter_order, step, f)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley FROM g
"""

ORACLE_SQL = {"op1_topk": TOP_K, "op6_neardup": NEAR, "op7_chat": CHAT, "op8_licences": LICENCES, "op9_suffix": REPEATS, "op12_filters": AUDIT}
