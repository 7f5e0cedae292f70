"""Queries of the general data problems (snapshots, history, nested records)."""

from __future__ import annotations

from loomspan.operators.history import skill_history
from loomspan.operators.nested import nested_children
from loomspan.operators.snapshot_diff import logged_changes, snapshot_changes
from loomspan.session import table


def p4_found(spark, sf):
    snaps = table(spark, sf, "version_snapshots", "snapshot_no", "sync_id", "skill_id", "source_path", "source_commit_sha", "source_content_hash", "loaded_at")
    return logged_changes(snapshot_changes(snaps), table(spark, sf, "sync_changelog", "sync_id", "entity_id", "change_type", "old_value"))


def p6_found(spark, sf):
    versions = table(spark, sf, "versions", "id", "skill_id", "version_id", "imported_at", "last_checked_at", "name", "summary", "domain_primary")
    return skill_history(versions, table(spark, sf, "skills", "id", "is_current", "last_updated_at"))


def p7_found(spark, sf):
    return nested_children(table(spark, sf, "versions", "id", "runtime_requirements", "compatibility", "security"))


QUERIES = {"p4_found": p4_found, "p6_found": p6_found, "p7_found": p7_found}


def _plain(c: str) -> str:
    bare = rf"regexp_replace(regexp_replace(regexp_replace(lower({c}), '^\s+|\s+$', '', 'g'), '^[a-z][a-z0-9_/-]*[:=]\s*', ''), '\s+', '', 'g')"
    return f"nullif({bare}, '')"


SQL = {
    "p4_found": rf"""
WITH rec AS (
  SELECT snapshot_no, skill_id, {_plain('source_content_hash')} AS h,
         nullif(regexp_replace(lower(source_commit_sha), '\s+', '', 'g'), '') AS c, source_path AS p
  FROM version_snapshots WHERE snapshot_no IS NOT NULL AND skill_id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY snapshot_no, skill_id
    ORDER BY loaded_at DESC NULLS LAST, h DESC NULLS LAST, c DESC NULLS LAST, p DESC NULLS LAST) = 1),
no AS (SELECT DISTINCT snapshot_no AS n FROM version_snapshots),
pairs AS (SELECT b.n AS later FROM no a JOIN no b ON b.n = a.n + 1),
old AS (SELECT snapshot_no + 1 AS later, skill_id, h, c, p FROM rec),
cmp AS (
  SELECT coalesce(a.later, b.snapshot_no) AS later, coalesce(a.skill_id, b.skill_id) AS skill_id,
         a.skill_id AS ida, b.skill_id AS idb, a.h AS ha, b.h AS hb, a.c AS ca, b.c AS cb, a.p AS pa, b.p AS pb
  FROM old a FULL JOIN rec b ON a.later = b.snapshot_no AND a.skill_id = b.skill_id),
ch AS (
  SELECT later, skill_id, 'ADDED' AS t, ha, pa FROM cmp WHERE ida IS NULL
  UNION ALL SELECT later, skill_id, 'REMOVED', ha, pa FROM cmp WHERE idb IS NULL
  UNION ALL SELECT later, skill_id, 'MODIFIED', ha, pa FROM cmp WHERE ida IS NOT NULL AND idb IS NOT NULL AND
    CASE WHEN ha IS NULL OR hb IS NULL THEN NOT coalesce(starts_with(ca, cb) OR starts_with(cb, ca), false) ELSE ha <> hb END
  UNION ALL SELECT later, skill_id, 'MOVED', ha, pa FROM cmp WHERE ida IS NOT NULL AND idb IS NOT NULL AND pa IS DISTINCT FROM pb),
s AS (SELECT snapshot_no AS later, max(sync_id) AS sync_id FROM version_snapshots GROUP BY 1),
lg AS (SELECT DISTINCT sync_id, entity_id, upper(regexp_replace(change_type, '^\s+|\s+$', '', 'g')) AS t, old_value FROM sync_changelog)
SELECT ch.later AS snapshot_no, ch.skill_id, ch.t AS change_type,
  CAST(EXISTS (SELECT 1 FROM lg WHERE lg.sync_id = s.sync_id AND lg.entity_id = ch.skill_id AND lg.t = ch.t
    AND (ch.t IN ('ADDED', 'REMOVED') OR (ch.t = 'MODIFIED' AND {_plain('lg.old_value')} IS NOT DISTINCT FROM ch.ha)
      OR (ch.t = 'MOVED' AND lg.old_value IS NOT DISTINCT FROM ch.pa))) AS INT) AS logged
FROM ch JOIN pairs USING (later) JOIN s USING (later)""",
    "p6_found": """
WITH one AS (
  SELECT * FROM versions
  QUALIFY row_number() OVER (PARTITION BY coalesce('v' || version_id, 'i' || id) ORDER BY last_checked_at DESC NULLS LAST, id DESC) = 1),
eff AS (
  SELECT *, coalesce(imported_at, last_checked_at) AS ts FROM one WHERE skill_id IS NOT NULL AND coalesce(imported_at, last_checked_at) IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY skill_id, coalesce(imported_at, last_checked_at) ORDER BY id DESC) = 1),
lagged AS (
  SELECT *, lag(id) OVER w AS pid, lag(name) OVER w AS pn, lag(summary) OVER w AS ps, lag(domain_primary) OVER w AS pd
  FROM eff WINDOW w AS (PARTITION BY skill_id ORDER BY ts)),
st AS (
  SELECT * FROM lagged WHERE pid IS NULL OR name IS DISTINCT FROM pn OR summary IS DISTINCT FROM ps OR domain_primary IS DISTINCT FROM pd),
seen AS (SELECT skill_id, max(last_checked_at) AS seen FROM versions GROUP BY 1),
cur AS (SELECT id AS skill_id, coalesce(is_current, false) AS c FROM skills
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY last_updated_at DESC NULLS LAST, coalesce(is_current, false) DESC) = 1)
SELECT st.skill_id, st.id AS version_row, strftime(st.ts, '%Y-%m-%d %H:%M:%S') AS valid_from,
  coalesce(strftime(lead(st.ts) OVER (PARTITION BY st.skill_id ORDER BY st.ts), '%Y-%m-%d %H:%M:%S'),
    CASE WHEN coalesce(cur.c, false) THEN 'open' ELSE strftime(greatest(st.ts, coalesce(seen.seen, st.ts)), '%Y-%m-%d %H:%M:%S') END) AS valid_to
FROM st LEFT JOIN seen USING (skill_id) LEFT JOIN cur USING (skill_id)""",
}
