"""Queries on snapshots and on drifting schemas."""

from __future__ import annotations

from foliomill.operators import drift, snapshots
from foliomill.session import table

QUERIES = {
    "p3_found": lambda s, d: snapshots.snapshot_changes(table(s, d, "file_snapshots")),
    "p4_found": lambda s, d: drift.schema_changes(table(s, d, "raw_points")),
    "p4_unified": lambda s, d: drift.unified_points(table(s, d, "raw_points")),
    "p4_fingerprints": lambda s, d: drift.fingerprints(table(s, d, "raw_points")),
}

_LAYOUT = r"""
WITH RECURSIVE trimmed AS (
  SELECT feed, file_no, regexp_replace(raw, '^[\s\x0b\x1c-\x1f\x85\pZ\x{feff}]+|[\s\x0b\x1c-\x1f\x85\pZ\x{feff}]+$', '', 'g') AS raw FROM raw_points WHERE feed IS NOT NULL AND file_no IS NOT NULL),
lines AS (SELECT DISTINCT feed, file_no, raw FROM trimmed WHERE starts_with(raw, '{') AND ends_with(raw, '}') AND json_valid(raw)),
parsed AS (SELECT feed, file_no, row_number() OVER () AS id, CAST(raw AS JSON) AS j FROM lines),
files AS (SELECT feed, file_no, count(*) AS records, row_number() OVER (PARTITION BY feed ORDER BY file_no) AS ord FROM parsed GROUP BY feed, file_no),
items AS (SELECT feed, file_no, id, k AS field, json_extract(j, '$."' || k || '"') AS v FROM (SELECT *, unnest(json_keys(j)) AS k FROM parsed)),
typed AS (SELECT feed, file_no, id, field, v, CASE json_type(v) WHEN 'BIGINT' THEN 'integer' WHEN 'UBIGINT' THEN 'integer' WHEN 'DOUBLE' THEN 'number' WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'OBJECT' THEN 'object'
  WHEN 'ARRAY' THEN CASE json_type(v, '$[0]') WHEN 'BIGINT' THEN 'array<integer>' WHEN 'UBIGINT' THEN 'array<integer>' WHEN 'VARCHAR' THEN 'array<string>' END END AS kind FROM items),
held AS (SELECT feed, file_no, field, count(*) AS held FROM typed GROUP BY ALL),
kinds AS (SELECT feed, file_no, field, kind, row_number() OVER (PARTITION BY feed, file_no, field ORDER BY count(*) DESC, kind) AS n FROM typed WHERE kind IS NOT NULL GROUP BY feed, file_no, field, kind),
layout AS (SELECT h.feed, h.file_no, f.ord, h.field, k.kind FROM held h JOIN files f USING (feed, file_no) LEFT JOIN kinds k ON k.feed = h.feed AND k.file_no = h.file_no AND k.field = h.field AND k.n = 1 WHERE h.held >= 0.2 * f.records)
"""

SQL = {
    "p4_fingerprints": _LAYOUT + """SELECT feed, file_no, count(*) AS fields, sha256(string_agg(field || ':' || coalesce(kind, 'null'), ',' ORDER BY field || ':' || coalesce(kind, 'null'))) AS fingerprint
FROM layout GROUP BY feed, file_no""",
    "p4_found": _LAYOUT + """,
gone AS (SELECT n.feed, n.file_no, n.ord, p.field FROM files n JOIN layout p ON p.feed = n.feed AND p.ord = n.ord - 1
  WHERE NOT EXISTS (SELECT 1 FROM layout x WHERE x.feed = n.feed AND x.ord = n.ord AND x.field = p.field)),
come AS (SELECT feed, file_no, ord, field FROM layout n WHERE ord > 1 AND NOT EXISTS (SELECT 1 FROM layout x WHERE x.feed = n.feed AND x.ord = n.ord - 1 AND x.field = n.field)),
vals AS (SELECT t.feed, f.ord, t.field, json_extract_string(p.j, '$.file_path') AS fp, json_extract_string(p.j, '$.chunk_index') AS ci, CASE WHEN json_type(t.v) = 'VARCHAR' THEN json_extract_string(t.v, '$') ELSE CAST(t.v AS VARCHAR) END AS val
  FROM typed t JOIN parsed p USING (id) JOIN files f ON f.feed = t.feed AND f.file_no = t.file_no WHERE json_type(t.v) <> 'NULL'),
met AS (SELECT g.feed, g.file_no, g.ord, g.field AS old, c.field AS new, a.fp, a.ci, max(CASE WHEN a.val = b.val THEN 1 ELSE 0 END) AS eq
  FROM gone g JOIN come c ON c.feed = g.feed AND c.ord = g.ord AND g.field NOT IN ('file_path', 'chunk_index') AND c.field NOT IN ('file_path', 'chunk_index')
  JOIN vals a ON a.feed = g.feed AND a.ord = g.ord - 1 AND a.field = g.field AND a.fp <> '' AND a.ci IS NOT NULL
  JOIN vals b ON b.feed = g.feed AND b.ord = g.ord AND b.field = c.field AND b.fp = a.fp AND b.ci = a.ci GROUP BY ALL),
evidence AS (SELECT feed, file_no, ord, old, new, sum(eq) AS same, count(*) AS met FROM met GROUP BY ALL HAVING 2 * sum(eq) > count(*)),
placed AS (SELECT *, row_number() OVER (PARTITION BY feed, ord, old ORDER BY same / met DESC, same DESC, old, new) AS a, row_number() OVER (PARTITION BY feed, ord, new ORDER BY same / met DESC, same DESC, old, new) AS b FROM evidence),
renamed AS (SELECT * FROM placed WHERE a = 1 AND b = 1),
line AS (
  SELECT feed, ord, field, feed || '|' || ord || '|' || field AS root FROM layout l WHERE ord = 1 OR (EXISTS (SELECT 1 FROM come c WHERE c.feed = l.feed AND c.ord = l.ord AND c.field = l.field)
    AND NOT EXISTS (SELECT 1 FROM renamed r WHERE r.feed = l.feed AND r.ord = l.ord AND r.new = l.field))
  UNION ALL
  SELECT l.feed, l.ord + 1, x.field, l.root FROM line l JOIN layout x ON x.feed = l.feed AND x.ord = l.ord + 1
    AND (x.field = l.field OR EXISTS (SELECT 1 FROM renamed r WHERE r.feed = l.feed AND r.ord = l.ord + 1 AND r.old = l.field AND r.new = x.field))),
known AS (SELECT l.feed, l.ord, l.field, x.kind, last_value(x.kind IGNORE NULLS) OVER (PARTITION BY l.root ORDER BY l.ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS was FROM line l JOIN layout x USING (feed, ord, field))
SELECT feed, file_no, 'renamed' AS change, old AS field, new AS detail FROM renamed
UNION ALL SELECT feed, file_no, 'removed', field, '' FROM gone g WHERE NOT EXISTS (SELECT 1 FROM renamed r WHERE r.feed = g.feed AND r.ord = g.ord AND r.old = g.field)
UNION ALL SELECT feed, file_no, 'added', field, '' FROM come c WHERE NOT EXISTS (SELECT 1 FROM renamed r WHERE r.feed = c.feed AND r.ord = c.ord AND r.new = c.field)
UNION ALL SELECT k.feed, f.file_no, 'retyped', k.field, k.kind FROM known k JOIN files f USING (feed, ord)
  WHERE k.kind <> k.was AND EXISTS (SELECT 1 FROM layout x WHERE x.feed = k.feed AND x.ord = k.ord - 1 AND x.field = k.field)""",
    "p3_found": """
WITH ranked AS (
  SELECT profile, snapshot_no, file_path, size, mtime, diff,
         row_number() OVER (PARTITION BY profile, snapshot_no, file_path
                            ORDER BY delivered_at DESC NULLS LAST, size DESC NULLS LAST, mtime DESC NULLS LAST,
                                     (coalesce(diff, '') = 'removed')) AS rn
  FROM file_snapshots WHERE profile IS NOT NULL AND snapshot_no IS NOT NULL AND file_path IS NOT NULL),
calendar AS (
  SELECT profile, snapshot_no, lag(snapshot_no) OVER (PARTITION BY profile ORDER BY snapshot_no) AS before_no
  FROM (SELECT DISTINCT profile, snapshot_no FROM ranked)),
present AS (SELECT * FROM ranked WHERE rn = 1 AND coalesce(diff, '') <> 'removed'),
steps AS (SELECT * FROM calendar WHERE before_no IS NOT NULL),
cur AS (SELECT s.profile, s.snapshot_no, p.file_path, p.size, p.mtime FROM steps s JOIN present p ON p.profile = s.profile AND p.snapshot_no = s.snapshot_no),
prev AS (SELECT s.profile, s.snapshot_no, p.file_path, p.size, p.mtime FROM steps s JOIN present p ON p.profile = s.profile AND p.snapshot_no = s.before_no)
SELECT coalesce(c.profile, b.profile) AS profile, coalesce(c.snapshot_no, b.snapshot_no) AS snapshot_no,
       coalesce(c.file_path, b.file_path) AS file_path,
       CASE WHEN b.file_path IS NULL THEN 'added' WHEN c.file_path IS NULL THEN 'removed' ELSE 'changed' END AS diff
FROM cur c FULL OUTER JOIN prev b ON b.profile = c.profile AND b.snapshot_no = c.snapshot_no AND b.file_path = c.file_path
WHERE c.file_path IS NULL OR b.file_path IS NULL OR c.size IS DISTINCT FROM b.size OR c.mtime IS DISTINCT FROM b.mtime
""",
}
