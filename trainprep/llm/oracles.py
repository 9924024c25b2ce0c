"""DuckDB SQL for the Merkle manifest and the conversation repair."""

from __future__ import annotations


def _crc32(text: str) -> str:
    """crc32 of an ASCII string, bit by bit. Fixed value: the reversed polynomial."""
    step = "list_reduce([c0, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)"
    byte = step.replace("c0", "xor(a, b)")
    return (f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split({text}, ''), "
            f"lambda x: CAST(ascii(x) AS BIGINT))), lambda a, b: {byte}), 4294967295)")


def _field(value: str) -> str:
    return f"CASE WHEN {value} IS NULL THEN '-' ELSE strlen(CAST({value} AS VARCHAR)) || ':' || CAST({value} AS VARCHAR) END"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(_field(f) for f in ("doc_id", "source", "lang", "n_chars", text)) + ")"


_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _tree(name: str, start: str) -> str:
    """Levels of nodes (tree, lvl, pos, h, n) and, per node, its siblings left and right."""
    return f"""
{name}(tree, lvl, pos, h, n) AS (
  {start}
  UNION ALL
  SELECT tree, lvl + 1, pos // 16, sha256(string_agg(h, '' ORDER BY pos)), (any_value(n) + 15) // 16
  FROM {name} WHERE n > 1 GROUP BY tree, lvl, pos // 16),
{name}_at AS (
  SELECT *, coalesce(string_agg(h, '') OVER (PARTITION BY tree, lvl, pos // 16 ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
         coalesce(string_agg(h, '') OVER (PARTITION BY tree, lvl, pos // 16 ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
  FROM {name})"""


MERKLE = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, {_leaf("text")} AS leaf,
         CASE WHEN {_crc32("CAST(doc_id AS VARCHAR)")} % 5 = 0 THEN {_leaf(_LOWER)} END AS changed
  FROM documents),
s AS (SELECT source, count(*) AS n, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS tree FROM d GROUP BY source),
leaves AS (
  SELECT d.doc_id, d.leaf, d.changed, s.tree, s.n, row_number() OVER (PARTITION BY s.tree ORDER BY d.doc_id NULLS FIRST, d.leaf) - 1 AS pos
  FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source),
{_tree("up", "SELECT tree, 0, pos, leaf, n FROM leaves")},
sub AS (SELECT tree, h FROM up WHERE n = 1),
{_tree("top", "SELECT CAST(0 AS BIGINT), 0, tree, h, (SELECT count(*) FROM sub) FROM sub")},
f(doc_id, leaf, tree, lvl, pos, h, proof) AS (
  SELECT doc_id, leaf, tree, 0, pos, coalesce(changed, leaf), '' FROM leaves
  UNION ALL
  SELECT f.doc_id, f.leaf, f.tree, f.lvl + 1, f.pos // 16, sha256(a.l || f.h || a.r), f.proof || a.l || a.r
  FROM f JOIN up_at a ON a.tree = f.tree AND a.lvl = f.lvl AND a.pos = f.pos WHERE a.n > 1),
g(doc_id, leaf, tree, lvl, pos, h, proof) AS (
  SELECT f.doc_id, f.leaf, f.tree, 0, f.tree, f.h, f.proof FROM f JOIN up a ON a.tree = f.tree AND a.lvl = f.lvl AND a.pos = f.pos WHERE a.n = 1
  UNION ALL
  SELECT g.doc_id, g.leaf, g.tree, g.lvl + 1, g.pos // 16, sha256(a.l || g.h || a.r), g.proof || a.l || a.r
  FROM g JOIN top_at a ON a.lvl = g.lvl AND a.pos = g.pos WHERE a.n > 1)
SELECT g.doc_id, g.leaf, sub.h AS subroot, t.h AS root, sha256(g.proof) AS proof_sha256, g.h AS folded_root, g.h = t.h AS verified
FROM g JOIN top t ON t.lvl = g.lvl AND t.pos = g.pos AND t.n = 1 JOIN sub ON sub.tree = g.tree
"""

CONVERSATIONS = f"""
WITH RECURSIVE k AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         {_crc32("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS kind
  FROM conversations),
m AS (
  SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
         unnest(CASE kind WHEN 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM k WHERE kind <> 0),
p AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i,
         rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare, substr(role, 1, 1) AS ini
  FROM m),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS again FROM p),
r AS (
  SELECT *, CASE WHEN bare = '' THEN 'blank' WHEN again > 1 THEN 'duplicate' WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
         lag(ini) OVER (PARTITION BY conv_id ORDER BY i) AS prior
  FROM o),
ins(p, q, edits, cost, lines) AS (
  VALUES (0, 0, '', 0, []::VARCHAR[]), (1, 1, '', 0, []), (2, 2, '', 0, []), (3, 3, '', 0, []), (0, 2, 'I', 3, ['user:']), (1, 2, 'I', 3, ['user:']),
         (3, 2, 'I', 3, ['user:']), (2, 3, 'I', 3, ['assistant:']), (0, 3, 'II', 6, ['user:', 'assistant:']), (1, 3, 'II', 6, ['user:', 'assistant:'])),
e(conv_id, i, p, q, edit, cost, lines) AS (
  SELECT conv_id, i, p, p, 'D', 4, []::VARCHAR[] FROM r, range(4) t(p)
  UNION ALL
  SELECT conv_id, i, p, q, 'K', CASE fault WHEN 'truncated' THEN 3 ELSE 0 END, [role || ':' || text] FROM r
  JOIN (VALUES (0, 1, 's'), (0, 2, 'u'), (1, 2, 'u'), (2, 3, 'a'), (3, 2, 'u')) t(p, q, c) ON r.ini = t.c WHERE fault IN ('', 'truncated')
  UNION ALL
  SELECT conv_id, i, p, q, 'R', CASE fault WHEN 'truncated' THEN 6 ELSE 3 END, [t.w || ':' || text] FROM r,
         (VALUES (0, 2, 'user'), (1, 2, 'user'), (2, 3, 'assistant'), (3, 2, 'user')) t(p, q, w) WHERE fault IN ('', 'truncated')),
c AS (SELECT conv_id, max(i) AS n FROM r GROUP BY conv_id),
dp(conv_id, i, q, best) AS (
  SELECT conv_id, CAST(0 AS BIGINT), 0, {{'cost': 0, 'audit': '', 'lines': []::VARCHAR[]}} FROM c
  UNION ALL
  SELECT dp.conv_id, dp.i + 1, e.q,
         min({{'cost': best.cost + ins.cost + e.cost, 'audit': best.audit || ins.edits || e.edit, 'lines': best.lines || ins.lines || e.lines}})
  FROM dp JOIN ins ON ins.p = dp.q JOIN e ON e.conv_id IS NOT DISTINCT FROM dp.conv_id AND e.i = dp.i + 1 AND e.p = ins.q
  GROUP BY dp.conv_id, dp.i, e.q),
done AS (
  SELECT dp.conv_id, min({{'cost': best.cost + ins.cost, 'audit': best.audit || ins.edits, 'lines': best.lines || ins.lines}}) AS best
  FROM dp JOIN c ON c.conv_id IS NOT DISTINCT FROM dp.conv_id AND c.n = dp.i JOIN ins ON ins.p = dp.q WHERE ins.q IN (0, 3) GROUP BY dp.conv_id),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
         count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
         count(*) FILTER (prior IS NOT NULL AND prior || ini NOT IN ('su', 'ua', 'au')) AS illegal
  FROM r GROUP BY conv_id),
ids AS (SELECT DISTINCT conv_id FROM conversations)
SELECT ids.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(coalesce(best.cost, 0) AS BIGINT) AS cost,
       coalesce(best.audit, '') AS audit, sha256(coalesce(array_to_string(best.lines, chr(10)), '')) AS repaired_sha256
FROM ids LEFT JOIN counts ON counts.conv_id IS NOT DISTINCT FROM ids.conv_id LEFT JOIN done ON done.conv_id IS NOT DISTINCT FROM ids.conv_id
"""
