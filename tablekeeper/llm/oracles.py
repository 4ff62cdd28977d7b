"""DuckDB SQL for the queries of the subpackage that SQL can express at the size of the correctness check."""

from __future__ import annotations

SPACED = r"'[^\x20\x09-\x0D]+'"
ALNUM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"


def _low(c: str) -> str:
    return f"translate({c}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _words(c: str, pattern: str) -> str:
    return f"regexp_extract_all(coalesce({c}, ''), {pattern})"


SUBSTRING = f"""
WITH w AS (SELECT doc_id, {_words('text', SPACED)} AS ws FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS k FROM w, unnest(range(1, len(ws) - 11)) t(i) WHERE len(ws) >= 13),
first AS (SELECT k, min(doc_id) AS d FROM win GROUP BY k),
gone AS (SELECT DISTINCT win.doc_id, i + o AS p FROM win JOIN first USING (k), range(13) r(o) WHERE first.d < win.doc_id),
words AS (SELECT doc_id, unnest(ws) AS x, generate_subscripts(ws, 1) AS p FROM w),
left_ AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS kept, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT w.doc_id, len(ws) AS n_words, len(ws) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN left_ USING (doc_id)"""

NEAR_DUPLICATES = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_words(_low('text'), SPACED)} AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 3], ' ') AS k FROM w, unnest(range(1, greatest(len(ws) - 2, 2))) t(i) WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.k = b.k AND a.doc_id <> b.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
reach AS (SELECT a, b FROM link UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a),
least_ AS (SELECT a AS doc_id, min(b) AS m FROM reach GROUP BY a)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, least(w.doc_id, coalesce(m, w.doc_id)) AS component_id,
  least(w.doc_id, coalesce(m, w.doc_id)) = w.doc_id AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN least_ USING (doc_id)"""

LINES = f"""
WITH t AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS k FROM t),
n AS (SELECT *, {_words(_low('line'), SPACED)} AS ws, row_number() OVER (ORDER BY doc_id, k) AS pos FROM l),
v AS (SELECT pos, len(ws) AS n, 0 AS j, ws AS key FROM n WHERE len(ws) >= 4
      UNION ALL SELECT pos, len(ws), j, list_concat(ws[1:j - 1], ws[j + 1:]) FROM n, unnest(range(1, len(ws) + 1)) r(j) WHERE len(ws) >= 8),
own AS (SELECT key, j, min(pos) AS m FROM v GROUP BY key, j),
edit AS (SELECT key, min(pos) FILTER (WHERE j = 0 AND n >= 8) AS whole, min(pos) FILTER (WHERE j > 0) AS cut FROM v GROUP BY key),
gone AS (SELECT DISTINCT v.pos FROM v JOIN own USING (key, j) JOIN edit USING (key)
         WHERE own.m < v.pos OR (v.j > 0 AND whole < v.pos) OR (v.j = 0 AND v.n >= 8 AND cut < v.pos))
SELECT doc_id, count(*) FILTER (WHERE len(ws) > 0) AS n_lines, count(gone.pos) AS n_removed,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (WHERE gone.pos IS NULL), '')) AS kept_sha256,
  count(*) FILTER (WHERE len(ws) > 0) > 0 AND count(*) FILTER (WHERE len(ws) > 0) = count(gone.pos) AS emptied
FROM n LEFT JOIN gone USING (pos) GROUP BY doc_id"""

CONTAMINATION = f"""
WITH d AS (SELECT doc_id, {_words(_low('text'), ALNUM)} AS ws FROM documents),
b AS (SELECT item_id, {_words(_low('text'), ALNUM)} AS ws FROM benchmark WHERE item_id IS NOT NULL),
bw AS (SELECT DISTINCT item_id, least(13, len(ws)) AS n, array_to_string(ws[i:i + least(13, len(ws)) - 1], ' ') AS k
       FROM b, unnest(range(1, len(ws) - least(13, len(ws)) + 2)) t(i) WHERE len(ws) > 0),
dw AS (SELECT doc_id, n, i, array_to_string(ws[i:i + n - 1], ' ') AS k
       FROM d, (SELECT DISTINCT n FROM bw) s, unnest(range(1, len(ws) - n + 2)) t(i) WHERE len(ws) >= n),
m AS (SELECT doc_id, n, i, item_id FROM dw JOIN bw USING (n, k)),
hit AS (SELECT doc_id, count(DISTINCT i + o) AS n_hit FROM (SELECT DISTINCT doc_id, n, i FROM m) x, unnest(range(n)) r(o) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids
       FROM (SELECT DISTINCT doc_id, item_id FROM m) y GROUP BY doc_id)
SELECT d.doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)"""


def _escaped(c: str) -> str:
    """Length of an escaped text: one more for each backslash and control string."""
    return (f"length({c}) + length({c}) - length(replace({c}, chr(92), '')) + "
            f"len(regexp_extract_all({c}, '</?s>|\\[/?INST\\]'))")


CHATS = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS told,
        coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '') AS loss,
        sum({_escaped('role')} + {_escaped('text')} + length('<s>[INST][/INST]</s>')) AS size FROM c GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(told) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256,
  CAST(size AS BIGINT) AS formatted_chars FROM g"""

FILTER_AUDIT = f"""
WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS x, {_words('text', SPACED)} AS ws FROM documents),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS bad FROM labels GROUP BY doc_id),
d AS (SELECT part, coalesce(good, false) AS good, coalesce(bad, false) AS bad,
        [len(ws) < 200, 100 * len(list_distinct(ws)) < 50 * len(ws), 100 * len(regexp_extract_all(x, '[A-Z]')) > 2 * length(x),
         regexp_matches(x, '[#$%&*|]'), coalesce(min(t.doc_id) OVER (PARTITION BY x) < t.doc_id, false)] AS f
      FROM t LEFT JOIN l ON t.doc_id = l.doc_id),
c AS (SELECT part, f, count(*) AS n, count(*) FILTER (WHERE good) AS g, count(*) FILTER (WHERE bad) AS b FROM d GROUP BY part, f),
i AS (SELECT unnest(range(1, 6)) AS i),
orders AS (SELECT [a.i, b.i, c.i, d.i, e.i] AS o FROM i a, i b, i c, i d, i e
           WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
steps AS (SELECT o, array_to_string(list_transform(o, lambda k: chr(CAST(64 + k AS INTEGER))), '') AS filter_order, s.i AS step FROM orders, i s),
r AS (SELECT part, filter_order, step, o[step] AS k, n, g, b, f[o[step]] AS fails,
        len(list_filter(o[1:step - 1], lambda k: f[k])) > 0 AS gone, len(list_filter(f, lambda v: v)) AS n_fails FROM c, steps),
q AS (SELECT part, filter_order, step, k, sum(CASE WHEN NOT gone AND NOT fails THEN n ELSE 0 END) AS kept,
        sum(CASE WHEN NOT gone AND fails THEN n ELSE 0 END) AS removed, sum(CASE WHEN gone AND fails THEN n ELSE 0 END) AS redundant,
        sum(CASE WHEN fails AND n_fails = 1 THEN n ELSE 0 END) AS unique_fails, sum(CASE WHEN NOT gone AND fails THEN g ELSE 0 END) AS good_lost,
        sum(CASE WHEN NOT gone AND fails THEN b ELSE 0 END) AS toxic_lost FROM r GROUP BY part, filter_order, step, k)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
  CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
  CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, k) AS BIGINT) AS shapley FROM q"""


def _edit(state: str, cost: str, initial: str, said: str | None = None) -> str:
    """A state after one more edit: its cost, its initials and its messages."""
    out = f"list_append({state}.r, {said})" if said else f"{state}.r"
    return f"{{'c': {state}.c + {cost}, 'a': {state}.a || '{initial}', 'r': {out}}}"


def _least(*states: str) -> str:
    return f"list_min([{', '.join(states)}])"


def _inserted(rows: str) -> str:
    """e0 to e3: the states v0 to v3 after up to two inserts."""
    one = f"SELECT *, {_edit(_least('v0', 'v1', 'v3'), '5', 'I', quote('user:'))} AS w2, {_edit('v2', '5', 'I', quote('assistant:'))} AS w3 FROM {rows}"
    return (f"SELECT *, v0 AS e0, v1 AS e1, {_least('v2', 'w2', _edit('w3', '5', 'I', quote('user:')))} AS e2, "
            f"{_least('v3', 'w3', _edit('w2', '5', 'I', quote('assistant:')))} AS e3 FROM ({one})")


def quote(s: str) -> str:
    return f"'{s}'"


_NEVER = "{'c': CAST(1000000000000 AS BIGINT), 'a': '', 'r': CAST([] AS VARCHAR[])}"
_USERS = _least("e0", "e1", "e3")
_CRC = ("xor(list_reduce(list_concat([4294967295], list_transform(string_split({s}, ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda a, b: "
        "list_reduce(list_concat([xor(a, b)], [0, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) "
        "ELSE x >> 1 END)), 4294967295)")

STRUCTURE = f"""
WITH RECURSIVE base AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    {_CRC.format(s="coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS way FROM conversations),
hurt AS (SELECT conv_id, turn, CASE WHEN way = 4 THEN 'user' ELSE role END AS role,
    CASE way WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM (SELECT * FROM base WHERE way <> 0 UNION ALL SELECT * FROM base WHERE way = 3)),
numbered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, left(role, 1) AS x,
    rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body FROM hurt),
judged AS (SELECT *, CASE WHEN body = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
    WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
    lag(x) OVER (PARTITION BY conv_id ORDER BY i) AS px FROM numbered),
counts AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
    count(*) FILTER (WHERE fault = 'truncated') AS truncated, count(*) FILTER (WHERE i > 1 AND px || x NOT IN ('su', 'ua', 'au')) AS illegal
  FROM judged GROUP BY conv_id),
s AS (SELECT conv_id, CAST(0 AS BIGINT) AS i, {{'c': CAST(0 AS BIGINT), 'a': '', 'r': CAST([] AS VARCHAR[])}} AS v0, {_NEVER} AS v1, {_NEVER} AS v2,
    {_NEVER} AS v3 FROM counts
  UNION ALL
  SELECT conv_id, i, {_edit('e0', '2', 'D')} AS v0,
    {_least(_edit('e1', '2', 'D'), "CASE WHEN x = 's' AND stays THEN " + _edit('e0', 'more', 'K', 'whole') + f" ELSE {_NEVER} END")} AS v1,
    {_least(_edit('e2', '2', 'D'), "CASE WHEN x = 'u' AND stays THEN " + _edit(_USERS, 'more', 'K', 'whole') + f" ELSE {_NEVER} END",
            "CASE WHEN stays THEN " + _edit(_USERS, '1 + more', 'R', "'user:' || text") + f" ELSE {_NEVER} END")} AS v2,
    {_least(_edit('e3', '2', 'D'), "CASE WHEN x = 'a' AND stays THEN " + _edit('e2', 'more', 'K', 'whole') + f" ELSE {_NEVER} END",
            "CASE WHEN stays THEN " + _edit('e2', '1 + more', 'R', "'assistant:' || text") + f" ELSE {_NEVER} END")} AS v3
  FROM ({_inserted('''(SELECT s.conv_id, j.i, v0, v1, v2, v3, x, text, role || ':' || text AS whole, fault NOT IN ('blank', 'duplicate') AS stays,
      CAST(CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END AS BIGINT) AS more
      FROM s JOIN judged j ON s.conv_id IS NOT DISTINCT FROM j.conv_id AND j.i = s.i + 1)''')})),
ended AS (SELECT conv_id, {_least('e0', 'e3')} AS best
  FROM ({_inserted('(SELECT s.* FROM s JOIN counts c ON s.conv_id IS NOT DISTINCT FROM c.conv_id AND s.i = c.n)')}))
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, coalesce(best.c, 0) AS cost, coalesce(best.a, '') AS audit,
  sha256(coalesce(array_to_string(best.r, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counts c ON o.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN ended e ON o.conv_id IS NOT DISTINCT FROM e.conv_id"""
