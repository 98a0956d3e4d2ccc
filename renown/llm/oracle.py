"""DuckDB SQL of the training-data operators that SQL can express: each
contract by its plain definition, over the whole table, without the
operators' hashing, pivots or prefixes."""

from __future__ import annotations

from renown.llm import chat_format, collocations, decontaminate, embedding_join, jaccard_join, suffix_dedup

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

ORACLE: dict[str, str] = {}

# windows of LENGTH bytes as hex digits, counted over all documents; covered
# bytes are the merged runs of repeated windows
_HEX = 2 * suffix_dedup.LENGTH
_PIECE = 256  # window starts cut from one piece of a text
ORACLE["op2_suffix_dedup"] = f"""
WITH d AS MATERIALIZED (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
pieces AS MATERIALIZED (
  SELECT doc_id, lo, substr(h, CAST(2 * lo + 1 AS BIGINT), {2 * _PIECE + _HEX - 2}) AS h
  FROM d, unnest(range(0, CAST(length(h) // 2 - {suffix_dedup.LENGTH} + 1 AS BIGINT), {_PIECE})) AS t(lo)),
starts AS MATERIALIZED (
  SELECT doc_id, lo + i AS p, md5_number(substr(h, CAST(2 * i + 1 AS BIGINT), {_HEX})) AS k
  FROM pieces, unnest(range(0, CAST(length(h) // 2 - {suffix_dedup.LENGTH} + 1 AS BIGINT))) AS t(i)),
repeated AS (
  SELECT doc_id, p FROM starts WHERE k IN (SELECT k FROM starts GROUP BY k HAVING count(*) > 1)),
marked AS (
  SELECT doc_id, p, CASE WHEN p > lag(p) OVER w + {suffix_dedup.LENGTH} THEN 1 ELSE 0 END AS fresh
  FROM repeated WINDOW w AS (PARTITION BY doc_id ORDER BY p)),
runs AS (
  SELECT doc_id, min(p) AS lo, max(p) + {suffix_dedup.LENGTH} AS hi
  FROM (SELECT doc_id, p, sum(fresh) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM marked) GROUP BY doc_id, run),
edges AS (
  SELECT doc_id, hi AS lo FROM runs UNION ALL SELECT doc_id, 0 FROM d),
gaps AS (
  SELECT e.doc_id, e.lo, min(r.lo) AS hi FROM edges e LEFT JOIN runs r ON r.doc_id = e.doc_id AND r.lo >= e.lo GROUP BY e.doc_id, e.lo),
kept AS (
  SELECT g.doc_id, string_agg(substr(d.h, CAST(2 * g.lo + 1 AS BIGINT), CAST(2 * (coalesce(g.hi, length(d.h) // 2) - g.lo) AS BIGINT)), '' ORDER BY g.lo) AS h
  FROM gaps g JOIN d USING (doc_id) GROUP BY g.doc_id),
sums AS (SELECT doc_id, sum(hi - lo) AS n_removed, count(*) AS n_spans FROM runs GROUP BY doc_id)
SELECT d.doc_id, CAST(length(d.h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(kept.h)) AS kept_sha256
FROM d JOIN kept USING (doc_id) LEFT JOIN sums USING (doc_id)
"""

_COMPONENTS = """
reach(node, root) AS (
  SELECT {id}, {id} FROM {nodes}
  UNION
  SELECT links.b, reach.root FROM reach JOIN links ON links.a = reach.node WHERE reach.root < links.b)"""

ORACLE["op7_jaccard"] = f"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
shingles AS MATERIALIZED (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + {jaccard_join.SHINGLE - 1}], ' ') AS s
  FROM words, unnest(range(1, greatest(len(w) - {jaccard_join.SHINGLE - 1}, 1) + 1)) AS t(i) WHERE len(w) > 0),
sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id <> y.doc_id
  GROUP BY x.doc_id, y.doc_id),
links AS MATERIALIZED (
  SELECT a, b FROM shared JOIN sizes sa ON sa.doc_id = a JOIN sizes sb ON sb.doc_id = b
  WHERE 100 * shared.n >= {jaccard_join.PERCENT} * (sa.n + sb.n - shared.n)),
{_COMPONENTS.format(id="doc_id", nodes="documents")}
SELECT d.doc_id, coalesce(sizes.n, 0) AS n_shingles, c.component_id
FROM documents d LEFT JOIN sizes USING (doc_id)
JOIN (SELECT node, min(root) AS component_id FROM reach GROUP BY node) c ON c.node = d.doc_id
"""

# every diagonal on which enough words are equal is tried, without the operator's masks
_LISTS = """
lists_{side} AS (SELECT {key} AS id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}]+') AS w FROM {table}),
words_{side} AS MATERIALIZED (SELECT id, len(w) AS n, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM lists_{side})"""

ORACLE["op9_decontaminate"] = f"""
WITH {_LISTS.format(side="d", table="documents", key="doc_id")}, {_LISTS.format(side="i", table="benchmark", key="item_id")},
diagonals AS MATERIALIZED (
  SELECT d.id AS doc_id, i.id AS item_id, d.p - i.p AS diagonal, least(any_value(i.n), {decontaminate.WINDOW}) AS compared
  FROM words_d d JOIN words_i i ON d.word = i.word GROUP BY ALL HAVING count(*) * 100 >= least(any_value(i.n), {decontaminate.WINDOW}) * {decontaminate.PERCENT}),
laid AS (
  SELECT h.doc_id, h.item_id, h.diagonal, i.p AS q, compared, CAST(i.word = d.word AS INT) AS same
  FROM diagonals h JOIN words_i i ON i.id = h.item_id JOIN words_d d ON d.id = h.doc_id AND d.p = i.p + h.diagonal),
summed AS (
  SELECT doc_id, item_id, compared, sum(same) OVER w AS matched, count(*) OVER w AS n
  FROM laid WINDOW w AS (PARTITION BY doc_id, item_id, diagonal ORDER BY q ROWS BETWEEN CURRENT ROW AND {decontaminate.WINDOW - 1} FOLLOWING))
SELECT doc_id, item_id, CAST(max(matched) AS BIGINT) AS matched, CAST(max(compared) AS BIGINT) AS compared
FROM summed WHERE n >= compared AND matched * 100 >= compared * {decontaminate.PERCENT} GROUP BY doc_id, item_id
"""

ORACLE["op10_embedding_join"] = f"""
WITH RECURSIVE vectors AS MATERIALIZED (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS MATERIALIZED (
  SELECT x.vec_id AS a, y.vec_id AS b FROM vectors x JOIN vectors y ON len(x.v) = len(y.v) AND x.vec_id <> y.vec_id
  WHERE list_cosine_similarity(x.v, y.v) >= {embedding_join.COSINE}),
{_COMPONENTS.format(id="vec_id", nodes="embeddings")}
SELECT e.vec_id, coalesce(l.n, 0) AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e JOIN (SELECT node, min(root) AS component_id FROM reach GROUP BY node) c ON c.node = e.vec_id
LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) l ON l.a = e.vec_id
"""

ORACLE["op12_collocations"] = f"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
words AS MATERIALIZED (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
totals AS (SELECT lang, sum(len(w)) AS n FROM words GROUP BY lang),
counts AS MATERIALIZED (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS f
  FROM words, unnest(range(1, {collocations.LONGEST} + 1)) AS s(k), unnest(range(1, len(w) - k + 2)) AS t(i)
  GROUP BY ALL HAVING count(*) >= {collocations.SUPPORT}),
candidates AS MATERIALIZED (SELECT lang, k AS size, phrase, string_split(phrase, ' ') AS w, f AS a FROM counts WHERE k > 1),
cuts AS (
  SELECT c.lang, c.phrase, c.a, c.k, x.f AS l, y.f AS r, CAST(c.a AS HUGEINT) * {collocations.SCALE} // (CAST(x.f AS HUGEINT) + y.f) AS score
  FROM (SELECT *, unnest(range(1, size)) AS k FROM candidates) c
  JOIN counts x ON x.lang = c.lang AND x.phrase = array_to_string(w[1:c.k], ' ')
  JOIN counts y ON y.lang = c.lang AND y.phrase = array_to_string(w[c.k + 1:size], ' ')),
lowest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inside AS (
  SELECT c.lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, max(c.a) AS longer
  FROM candidates c, unnest(range(2, size)) AS s(m), unnest(range(1, size - m + 2)) AS t(i) GROUP BY ALL),
ranked AS (
  SELECT l.*, row_number() OVER (PARTITION BY l.lang ORDER BY l.score DESC, l.a DESC, l.phrase) AS rank
  FROM lowest l LEFT JOIN inside i ON i.lang = l.lang AND i.phrase = l.phrase
  WHERE i.longer IS NULL OR 100 * CAST(i.longer AS HUGEINT) < {collocations.ABSORB_PERCENT} * CAST(l.a AS HUGEINT))
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r,
       CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM ranked JOIN totals USING (lang) WHERE rank <= {collocations.TOP}
"""


def _escaped(text: str) -> str:
    """Length of an escaped text: an escape character is doubled, a control
    string (none overlaps another) gets one."""
    parts = [f"length({text})", f"length({text}) - length(replace({text}, '{chat_format.CHAT.escape}', ''))"]
    return " + ".join(parts + [f"(length({text}) - length(replace({text}, '{c}', ''))) // {len(c)}" for c in chat_format.CHAT.controls])


def _chat_sql() -> str:
    chat = chat_format.CHAT
    marks = " ".join(f"WHEN '{role}' THEN {sum(map(len, pair))}" for role, pair in chat.turns.items())
    moves = ", ".join(f"('{state}', '{role}')" for state, to in chat.transitions.items() for role in to)
    loss = " OR ".join(f"role = '{role}'" for role in sorted(chat.loss))
    return f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
s AS (
  SELECT *, (coalesce(lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role), '{chat.start}'), role) IN ({moves}) AS moved,
         (CASE role {marks} ELSE {sum(map(len, chat.other))} + {_escaped('role')} END) + {_escaped('text')} AS chars
  FROM t)
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER ({loss}), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role) FILTER ({loss}), '')) AS loss_sha256,
       CAST(sum(chars) AS BIGINT) AS formatted_chars, bool_and(moved) AS valid,
       bool_and(moved) AND last(role ORDER BY turn, role) IN ({', '.join(repr(a) for a in sorted(chat.accept))}) AS complete
FROM s GROUP BY conv_id
"""


# states are named by the role of the last turn, so the machine is a look at the previous row
ORACLE["op13_chat_format"] = _chat_sql()
