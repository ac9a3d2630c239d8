"""DuckDB SQL for the queries of this subpackage that SQL can express: the mix, the chat digests and the secret spans."""

from __future__ import annotations

#: Words of operator 2: sizes, targets by filling up to a level, positions in order of size, copies by prefix sums.
OP2_MIX = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents
), per AS (
  SELECT source, sum(size)::BIGINT AS source_size, 2.0::DOUBLE * sum(size) AS cap,
    [3.0, 1.0, 2.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS w
  FROM sized GROUP BY source
), levels AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER ()
      - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM per
), told AS (
  SELECT source, source_size,
    least(cap, coalesce((SELECT l.level FROM levels l WHERE l.cap >= l.level * l.w ORDER BY l.cap / l.w, l.level LIMIT 1) * w, cap))::DOUBLE AS target,
    ('0x' || substr(md5('17:' || coalesce('=' || source, 'null')), 1, 7))::BIGINT / 268435456.0::DOUBLE AS start
  FROM levels
), placed AS (
  SELECT doc_id, size, source_size, target, start,
    CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate,
    row_number() OVER (PARTITION BY s.source ORDER BY size, doc_id) - 1 AS pos
  FROM sized s JOIN told t ON s.source IS NOT DISTINCT FROM t.source
), copied AS (
  SELECT *, least(floor(rate * (pos + 1) + start)::BIGINT - floor(rate * pos + start)::BIGINT, 2) AS copies FROM placed
)
SELECT doc_id, size::BIGINT AS size, source_size, target, (copies * size)::BIGINT AS taken, copies::BIGINT AS copies FROM copied
"""

#: Digests of operator 4. The length of an escaped text follows from its backslashes and control strings.
OP4_CHAT = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), escaped AS (
  SELECT *,
    length(text) + len(regexp_extract_all(text, '\\|</?s>|\[/?(?:INST|SYS|ROLE)\]|\[/TURN\]')) AS text_chars,
    length(role) + len(regexp_extract_all(role, '\\|</?s>|\[/?(?:INST|SYS|ROLE)\]|\[/TURN\]')) AS role_chars,
    CASE lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
      WHEN 'system' THEN role = 'user' WHEN 'user' THEN role = 'assistant' WHEN 'assistant' THEN role = 'user'
      ELSE role IN ('system', 'user') AND row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) = 1 END AS good
  FROM turns
)
SELECT conv_id::BIGINT AS conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(text_chars + CASE role WHEN 'system' THEN length('[SYS]  [/SYS]') WHEN 'user' THEN length('[INST]  [/INST]')
    WHEN 'assistant' THEN length('<s> </s>') ELSE length('[ROLE][/ROLE][/TURN]') + role_chars END)::BIGINT AS formatted_chars,
  bool_and(good) AS in_order
FROM escaped GROUP BY conv_id
"""


def _either(word: str) -> str:
    """``word`` with its ASCII letters in either case, and in no other case pair of Unicode."""
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


_NAMES = "|".join(map(_either, ("password", "passwd", "secret", "token", "api_?key")))
_ASSIGN = rf"""({_NAMES})["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""

#: Spans of operator 6: matches set between marks, parts counted through, short ones dropped.
OP6_SECRETS = rf"""
WITH rules(rank, kind, pattern, least) AS (VALUES (0, 'assign', '{_ASSIGN}', 12), (1, 'access', 'AKIA[A-Z0-9]+', 18), (2, 'hex', '[0-9a-f]+', 16)),
docs AS (SELECT row_number() OVER () AS pos, doc_id, translate(coalesce(text, ''), chr(57344), chr(57345)) AS text FROM documents),
cut AS (
  SELECT pos, rank, kind, least, string_split(CASE rank
    WHEN 0 THEN regexp_replace(text, '{_ASSIGN}', chr(57344) || '\0' || chr(57344), 'g')
    WHEN 1 THEN regexp_replace(text, 'AKIA[A-Z0-9]+', chr(57344) || '\0' || chr(57344), 'g')
    ELSE regexp_replace(text, '[0-9a-f]+', chr(57344) || '\0' || chr(57344), 'g') END, chr(57344)) AS parts
  FROM docs CROSS JOIN rules
),
parts AS (SELECT pos, rank, kind, least, generate_subscripts(parts, 1) AS i, unnest(parts) AS part FROM cut),
placed AS (SELECT *, sum(length(part)) OVER (PARTITION BY pos, rank ORDER BY i)::BIGINT AS stop FROM parts),
spans AS (
  SELECT pos, rank, kind, stop - length(part) AS start, stop FROM placed
  WHERE i % 2 = 0 AND least <= CASE rank WHEN 0 THEN length(regexp_extract(part, '{_ASSIGN}', 2)) ELSE length(part) END
),
told AS (
  SELECT pos, count(*) FILTER (rank = 0) AS n_assign, count(*) FILTER (rank = 1) AS n_access, count(*) FILTER (rank = 2) AS n_hex,
    string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) AS spans
  FROM spans GROUP BY pos
)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
  sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs LEFT JOIN told USING (pos)
"""

ORACLE: dict[str, str] = {"op2_mix": OP2_MIX, "op4_chat": OP4_CHAT, "op6_secrets": OP6_SECRETS}
