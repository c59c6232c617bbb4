"""SQL that checks conversation repair: one row at a time from the end, with costs and edits of each state as strings."""

#: CRC-32 of an ASCII string, byte by byte.
_CRC = """
crc_table AS (
  SELECT list(list_reduce(list_prepend(b, range(8)), lambda c, s: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY b) AS t
  FROM (SELECT unnest(range(256)) AS b))"""


def _then(letter: str, cost: str, key: str) -> str:
    """A key (cost in eight digits, then edits) with one more edit in front."""
    return f"printf('%08d', CAST(left({key}, 8) AS INTEGER) + {cost}) || '{letter}' || substr({key}, 9)"


def _own(state: str, given: str, legal: dict[str, str]) -> str:
    keeps = " ".join(f"WHEN kind = '{initial}' THEN {_then('K', 'late', to)}" for initial, to in legal.items())
    return f"""least({_then('D', '3', state)}, CASE WHEN gone THEN 'z' ELSE {_then('R', '2 + late', given)} END,
      CASE WHEN gone THEN 'z' {keeps} ELSE 'z' END)"""


REPAIR_SQL = f"""
WITH RECURSIVE {_CRC},
ids AS (SELECT DISTINCT conv_id FROM conversations),
said AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS id FROM conversations),
harmed AS (
  SELECT *, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(id) + 1), lambda i: ascii(substr(id, i, 1))::BIGINT)),
                            lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])), 4294967295) % 20 AS harm
  FROM said, crc_table),
damaged AS (
  SELECT conv_id, turn, CASE WHEN harm = 4 THEN 'user' ELSE role END AS role,
         CASE WHEN harm = 1 THEN '' WHEN harm = 2 THEN translate(text, '.!?', '') ELSE text END AS text, copy
  FROM harmed, (VALUES (1), (2)) AS copies(copy) WHERE harm <> 0 AND (copy = 1 OR harm = 3)),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS pos,
         row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS seen,
         rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS core FROM damaged),
judged AS (
  SELECT *, CASE WHEN core = '' THEN 1 WHEN seen > 1 THEN 2 WHEN right(core, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault,
         left(role, 1) || lead(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY pos) AS steps FROM placed),
costed AS (SELECT conv_id, pos, left(role, 1) AS kind, fault IN (1, 2) AS gone, CASE WHEN fault = 3 THEN 1 ELSE 0 END AS late FROM judged),
walk(conv_id, pos, kb, ks, ku, ka) AS (
  SELECT conv_id, max(pos) + 1, '00000000', '00000004II', '00000002I', '00000000' FROM costed GROUP BY conv_id
  UNION ALL
  SELECT conv_id, pos, least(ob, {_then('I', '2', 'u')}), least(os, {_then('I', '2', 'u')}), u, a
  FROM (SELECT *, least(ou, {_then('I', '2', 'oa')}) AS u, least(oa, {_then('I', '2', 'ou')}) AS a FROM (
    SELECT c.conv_id, c.pos,
      {_own('kb', 'ku', {'s': 'ks', 'u': 'ku'})} AS ob,
      {_own('ks', 'ku', {'u': 'ku'})} AS os,
      {_own('ku', 'ka', {'a': 'ka'})} AS ou,
      {_own('ka', 'ku', {'u': 'ku'})} AS oa
    FROM walk w JOIN costed c ON c.conv_id IS NOT DISTINCT FROM w.conv_id AND c.pos = w.pos - 1))),
best AS (SELECT conv_id, CAST(left(kb, 8) AS BIGINT) AS cost, substr(kb, 9) AS audit FROM walk WHERE pos = 1),
letters AS (SELECT conv_id, k, audit[k] AS letter FROM (SELECT conv_id, audit, unnest(range(1, length(audit) + 1)) AS k FROM best)),
edits AS (
  SELECT *, count(*) FILTER (letter <> 'I') OVER w AS pos, count(*) FILTER (letter <> 'D') OVER w AS n
  FROM letters WINDOW w AS (PARTITION BY conv_id ORDER BY k)),
told AS (
  SELECT e.*, j.role, j.text, max(CASE WHEN n = 1 AND letter = 'K' AND left(j.role, 1) = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY e.conv_id) AS shift
  FROM edits e LEFT JOIN judged j ON j.conv_id IS NOT DISTINCT FROM e.conv_id AND j.pos = e.pos WHERE letter <> 'D'),
repaired AS (
  SELECT conv_id, sha256(string_agg(CASE WHEN letter = 'K' THEN role WHEN (n - shift) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' ||
                                    CASE WHEN letter = 'I' THEN '' ELSE text END, chr(10) ORDER BY n)) AS digest FROM told GROUP BY conv_id),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate,
         count(*) FILTER (fault = 3) AS truncated, count(*) FILTER (steps NOT IN ('su', 'ua', 'au')) AS illegal
  FROM judged GROUP BY conv_id)
SELECT i.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
       coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit,
       coalesce(digest, sha256('')) AS repaired_sha256
FROM ids i LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM i.conv_id LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM i.conv_id
LEFT JOIN repaired r ON r.conv_id IS NOT DISTINCT FROM i.conv_id
"""
