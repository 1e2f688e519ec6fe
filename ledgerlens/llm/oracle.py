"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

ORACLE: dict[str, str] = {}

ORACLE["op4_line_dedup"] = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (
  SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM d
),
k AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l
),
hot AS (
  SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT doc_id) >= 5
),
j AS (
  SELECT k.doc_id, k.pos, k.line, hot.key IS NOT NULL AND k.doc_id <> hot.keeper AS gone
  FROM k LEFT JOIN hot ON k.key = hot.key
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM j GROUP BY doc_id
"""

ORACLE["op2_mih_topk"] = """
WITH v AS (SELECT vec_id, embedding FROM embeddings WHERE embedding IS NOT NULL AND vec_id IS NOT NULL),
q AS (SELECT vec_id AS query_id, embedding AS e FROM v WHERE vec_id % 100 = 0),
p AS (
  SELECT query_id, vec_id,
         list_sum([CASE WHEN (e[i] >= 0) <> (embedding[i] >= 0) THEN 1 ELSE 0 END FOR i IN range(1, 65)])::INT AS hamming
  FROM q, v
),
r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY hamming, vec_id)::INT AS rank FROM p
)
SELECT query_id, rank, vec_id, hamming FROM r WHERE rank <= 10
"""

ORACLE["op12_prefix_targets"] = r"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS pos,
         count(*) OVER (PARTITION BY conv_id) AS n,
         length('<|im_start|>' || role || chr(10) || '<|im_end|>' || chr(10))
         + length(regexp_replace(text, '([<\[])(\\*)(\|im_start\|>|\|im_end\|>|s>|/s>|INST\]|/INST\])', '\1\\\2\3', 'g')) AS chars
  FROM said
),
upto AS (
  SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY pos) AS prefix FROM numbered
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY pos) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       coalesce(sum(prefix) FILTER (WHERE role = 'assistant' OR pos = n), 0)::BIGINT AS formatted_chars
FROM upto GROUP BY conv_id
"""

# A round: nearest entry of each part, then floored means.
_ROUND = """
d{r} AS (
  SELECT vec_id, x.part, b.entry,
         list_sum([(x.v[i] - b.v[i]) * (x.v[i] - b.v[i]) FOR i IN range(1, len(x.v) + 1)])::BIGINT AS sq
  FROM x JOIN b{r} b ON x.part = b.part
),
a{r} AS MATERIALIZED (
  SELECT vec_id, part, min(struct_pack(sq := sq, entry := entry)) AS best FROM d{r} GROUP BY vec_id, part
)"""
_MOVE = """
m{r} AS (
  SELECT part, entry, i, floor(sum(v[i])::DOUBLE / count(*))::BIGINT AS mean
  FROM (SELECT a.part, a.best.entry AS entry, x.v, unnest(range(1, len(x.v) + 1)) AS i
        FROM a{r} a JOIN x ON a.vec_id = x.vec_id AND a.part = x.part)
  GROUP BY part, entry, i
),
n{r} AS (SELECT part, entry, list(mean ORDER BY i) AS v FROM m{r} GROUP BY part, entry),
b{s} AS MATERIALIZED (
  SELECT b.part, b.entry, coalesce(n.v, b.v) AS v
  FROM b{r} b LEFT JOIN n{r} n ON b.part = n.part AND b.entry = n.entry
)"""

ORACLE["op13_bounded_codes"] = (
    """
WITH kept AS (
  SELECT vec_id, label, [floor(c::DOUBLE * 256)::BIGINT FOR c IN embedding] AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len([c FOR c IN embedding IF c IS NULL OR NOT isfinite(c)]) = 0
),
x AS MATERIALIZED (
  SELECT vec_id, p AS part, v[p * (len(v) // 16) + 1 : (p + 1) * (len(v) // 16)] AS v
  FROM (SELECT vec_id, v, unnest(range(16)) AS p FROM kept)
),
seeds AS (
  SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept WHERE vec_id IS NOT NULL ORDER BY vec_id LIMIT 64
),
b0 AS MATERIALIZED (SELECT x.part, s.entry, x.v FROM x JOIN seeds s ON x.vec_id = s.vec_id),"""
    + ",".join(
        [
            _ROUND.format(r=0),
            _MOVE.format(r=0, s=1),
            _ROUND.format(r=1),
            _MOVE.format(r=1, s=2),
            _ROUND.format(r=2),
        ]
    )
    + """,
coded AS (
  SELECT k.vec_id, k.label, string_agg(printf('%02x', a.best.entry), '' ORDER BY a.part) AS code,
         sum(a.best.sq)::BIGINT AS error
  FROM kept k JOIN a2 a ON k.vec_id = a.vec_id GROUP BY k.vec_id, k.label
),
book AS (
  SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b2
)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
FROM coded, book
"""
)


def _add(v: str, cost: str | int, edit: str) -> str:
    """Cost (eight digits) and edits stand in one string, so that the least string is the cheapest
    and, among those, the ASCII-least."""
    return f"lpad((left({v}, 8)::INT + {cost})::VARCHAR, 8, '0') || {v}[9:] || '{edit}'"


# One row per conversation moves forward over its rows; v0 to v3 are the states nothing, s, u, a.
ORACLE["op11_conversation_repair"] = rf"""
WITH RECURSIVE said AS (
  SELECT coalesce(conv_id::VARCHAR, ' ') AS conv, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key
  FROM conversations
),
crc AS (
  SELECT key, xor(list_reduce(
           list_concat([4294967295], [ord(c)::BIGINT FOR c IN string_split(key, '')]),
           lambda h, c: list_reduce(
             list_concat([xor(h, c)], range(8)),
             lambda y, i: CASE WHEN y % 2 = 1 THEN xor(y // 2, 3988292384) ELSE y // 2 END)), 4294967295) % 20 AS kind
  FROM (SELECT DISTINCT key FROM said)
),
rows0 AS (
  SELECT conv, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
         unnest(range(CASE kind WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM said JOIN crc USING (key) WHERE kind <> 0
),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, role, text, copy) AS pos,
         count(*) OVER (PARTITION BY conv) AS n,
         trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare,
         row_number() OVER (PARTITION BY conv, role, text ORDER BY turn NULLS FIRST, copy) AS seen
  FROM rows0
),
rows1 AS MATERIALIZED (
  SELECT *, CASE WHEN bare = '' THEN 'b' WHEN seen > 1 THEN 'd' WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault,
         left(role, 1) AS ini
  FROM placed
),
walk AS (
  SELECT conv, 1::BIGINT AS pos, n, '00000000' AS v0, NULL::VARCHAR AS v1, NULL::VARCHAR AS v2, NULL::VARCHAR AS v3 FROM rows1 WHERE pos = 1
  UNION ALL
  SELECT conv, pos + 1, n, {_add("v0", 3, "D")},
         least({_add("v1", 3, "D")}, CASE WHEN stay AND ini = 's' THEN {_add("v0", "t", "K")} END),
         least({_add("u", 3, "D")}, CASE WHEN stay AND ini = 'u' THEN {_add("x", "t", "K")} END, CASE WHEN stay THEN {_add("x", "t + 2", "R")} END),
         least({_add("a", 3, "D")}, CASE WHEN stay AND ini = 'a' THEN {_add("u", "t", "K")} END, CASE WHEN stay THEN {_add("u", "t + 2", "R")} END)
  FROM (
    SELECT *, least(v0, v1, a) AS x FROM (
      SELECT *, least(v3, {_add("u", 2, "I")}) AS a FROM (
        SELECT *, least(v2, i0, i1, i3) AS u FROM (
          SELECT w.*, r.ini, fault NOT IN ('b', 'd') AS stay, CASE fault WHEN 't' THEN 1 ELSE 0 END AS t,
                 {_add("v0", 2, "I")} AS i0, {_add("v1", 2, "I")} AS i1, {_add("v3", 2, "I")} AS i3
          FROM walk w JOIN rows1 r ON w.conv = r.conv AND w.pos = r.pos))))
),
best AS (
  SELECT conv, least(v0, v3, i2, {_add("i1", 2, "I")}, {_add("i0", 2, "I")}) AS found
  FROM (SELECT *, {_add("v0", 2, "I")} AS i0, {_add("v1", 2, "I")} AS i1, {_add("v2", 2, "I")} AS i2 FROM walk WHERE pos = n + 1)
),
edits AS (
  SELECT conv, e, i, sum(CASE WHEN e = 'I' THEN 0 ELSE 1 END) OVER w - CASE WHEN e = 'I' THEN 0 ELSE 1 END + 1 AS pos,
         sum(CASE WHEN e = 'D' THEN 0 ELSE 1 END) OVER w AS kept
  FROM (SELECT conv, unnest(string_split(found[9:], '')) AS e, unnest(range(length(found) - 8)) AS i FROM best)
  WINDOW w AS (PARTITION BY conv ORDER BY i)
),
system AS (
  SELECT DISTINCT e.conv FROM edits e JOIN rows1 r ON e.conv = r.conv AND e.pos = r.pos
  WHERE e.kept = 1 AND e.e = 'K' AND r.ini = 's'
),
lines AS (
  SELECT e.conv, e.i,
         CASE WHEN e.e = 'K' THEN r.role
              WHEN (e.kept + CASE WHEN s.conv IS NULL THEN 0 ELSE 1 END) % 2 = 1 THEN 'user' ELSE 'assistant' END
         || ':' || CASE WHEN e.e = 'I' THEN '' ELSE r.text END AS line
  FROM edits e LEFT JOIN rows1 r ON e.conv = r.conv AND e.pos = r.pos LEFT JOIN system s ON e.conv = s.conv
  WHERE e.e <> 'D'
),
hashed AS (SELECT conv, sha256(string_agg(line, chr(10) ORDER BY i)) AS h FROM lines GROUP BY conv),
steps AS (
  SELECT conv, coalesce(ini || lead(ini) OVER (PARTITION BY conv ORDER BY pos) NOT IN ('su', 'ua', 'au'), false) AS bad FROM rows1
),
shape AS (SELECT conv, count(*) FILTER (WHERE bad) AS illegal FROM steps GROUP BY conv),
faults AS (
  SELECT conv, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (WHERE fault = 'b') AS blank, count(*) FILTER (WHERE fault = 'd') AS duplicate,
         count(*) FILTER (WHERE fault = 't') AS truncated
  FROM rows1 GROUP BY conv
),
every AS (SELECT DISTINCT conv_id, coalesce(conv_id::VARCHAR, ' ') AS conv FROM conversations)
SELECT e.conv_id, coalesce(f.gaps, 0)::BIGINT AS gaps, coalesce(f.blank, 0)::BIGINT AS blank,
       coalesce(f.duplicate, 0)::BIGINT AS duplicate, coalesce(f.truncated, 0)::BIGINT AS truncated,
       coalesce(s.illegal, 0)::BIGINT AS illegal, coalesce(left(b.found, 8)::BIGINT, 0) AS cost,
       coalesce(b.found[9:], '') AS audit, coalesce(h.h, sha256('')) AS repaired_sha256
FROM every e LEFT JOIN faults f ON e.conv = f.conv LEFT JOIN shape s ON e.conv = s.conv
LEFT JOIN best b ON e.conv = b.conv LEFT JOIN hashed h ON e.conv = h.conv
"""
