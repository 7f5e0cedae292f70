"""DuckDB SQL of the queries in catalogue.py, by name."""

from __future__ import annotations

from loomspan.operators.recommend import SIGNALS, task_keywords
from loomspan.plans.common import CV, RISK, SK, json_sql
from loomspan.plans.scoring_sql import SCORED
from loomspan.plans.similarity import PAIRS

TASK = "review the data"


def _kids(t: str, alias: str) -> str:
    return f"{alias} AS (SELECT version_id_fk AS v, list_sort(list_distinct(list(name))) AS x FROM {t} WHERE version_id_fk IS NOT NULL AND name IS NOT NULL GROUP BY 1)"


def _present(c: str) -> str:
    return f"({c} IS NOT NULL AND regexp_replace({c}, '\\s+', '', 'g') NOT IN ('', '{{}}', '[]', 'null'))"


_CAT = "regexp_extract({0}, '^([^./]*)', 1)"
_PLAIN = "nullif(regexp_replace(regexp_replace(regexp_replace(lower(source_content_hash), '^\\s+|\\s+$', '', 'g'), '^[a-z][a-z0-9_/-]*[:=]\\s*', ''), '\\s+', '', 'g'), '')"
_COMMIT = "nullif(regexp_replace(lower(source_commit_sha), '\\s+', '', 'g'), '')"
_SNAP = f"""rec AS (SELECT snapshot_no AS no, skill_id, {_PLAIN} AS hash, {_COMMIT} AS sha, source_path AS path FROM version_snapshots WHERE skill_id IS NOT NULL AND snapshot_no IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY snapshot_no, skill_id ORDER BY loaded_at DESC NULLS LAST, hash DESC NULLS LAST, sha DESC NULLS LAST, path DESC NULLS LAST) = 1),
nos AS (SELECT DISTINCT no FROM rec), a AS (SELECT no + 1 AS no, skill_id, hash, path FROM rec WHERE no + 1 IN (SELECT no FROM nos)), b AS (SELECT no, skill_id, hash, path FROM rec WHERE no - 1 IN (SELECT no FROM nos)),
j AS (SELECT coalesce(a.no, b.no)::INT AS no, coalesce(a.skill_id, b.skill_id) AS skill_id, a.skill_id AS ka, b.skill_id AS kb, a.hash AS ha, b.hash AS hb, a.path AS pa, b.path AS pb FROM a FULL JOIN b ON a.skill_id = b.skill_id AND a.no = b.no),
ch AS (SELECT no, skill_id, 'ADDED' AS change, NULL::VARCHAR AS field, NULL::VARCHAR AS old_value, NULL::VARCHAR AS new_value FROM j WHERE ka IS NULL
  UNION ALL SELECT no, skill_id, 'REMOVED', NULL, NULL, NULL FROM j WHERE kb IS NULL
  UNION ALL SELECT no, skill_id, 'MODIFIED', 'hash', ha, hb FROM j WHERE ka IS NOT NULL AND kb IS NOT NULL AND ha IS DISTINCT FROM hb
  UNION ALL SELECT no, skill_id, 'MOVED', 'path', pa, pb FROM j WHERE ka IS NOT NULL AND kb IS NOT NULL AND pa IS DISTINCT FROM pb)"""
_QUAL = f"WITH {CV}, {SCORED}, ql AS (SELECT cv.id, cv.skill_id, cv.repo, sc.overall AS s FROM cv JOIN sc ON sc.id = cv.id)"
_COV = ["summary", "domain", "security", "license", "compatibility", "runtime_requirements", "raw_content", "input_format"]
_BANDS = "CASE WHEN s >= 0.8 THEN 'excellent' WHEN s >= 0.6 THEN 'good' WHEN s >= 0.4 THEN 'fair' ELSE 'poor' END"
_TOK = "regexp_extract_all(lower(concat_ws(' ', name, summary, domain, repo)), '[\\p{L}\\p{N}]+')"
_CHECKS = f"""{_QUAL}, {SK}, o_ AS (SELECT count(*) AS orphans FROM versions WHERE skill_id IS NOT NULL AND skill_id NOT IN (SELECT id FROM sk)),
v_ AS (SELECT count(*) AS versions, count(*) FILTER ({RISK} IN ('HIGH', 'CRITICAL')) AS risky, count(*) FILTER ({_present('security')}) AS assessed, (max(imported_at)::DATE - DATE '1970-01-01')::BIGINT AS newest FROM versions),
c_ AS (SELECT count(*) AS caps, count(*) FILTER (coalesce({_CAT.format('taxonomy_path')}, 'uncategorized') = 'uncategorized') AS loose FROM capabilities),
r_ AS (SELECT count(*) FILTER (coalesce(skill_count, 0) = 0) AS empty_repos FROM repositories), s_ AS (SELECT count(*) AS skills FROM sk),
i_ AS (SELECT count(*) FILTER (len({_TOK}) > 0) AS indexed FROM cv), x_ AS (SELECT coalesce(sum(n - 1), 0)::BIGINT AS copies FROM (SELECT count(*) AS n FROM versions WHERE raw_content IS NOT NULL GROUP BY raw_content)),
k AS (SELECT 'accessible' AS "check", CASE WHEN skills = 0 THEN 'warn' ELSE 'ok' END AS status, skills AS value FROM s_
 UNION ALL SELECT 'orphans', CASE WHEN orphans > 0 THEN 'fail' ELSE 'ok' END, orphans FROM o_
 UNION ALL SELECT 'search_index', CASE WHEN indexed = 0 THEN 'fail' WHEN indexed < skills THEN 'warn' ELSE 'ok' END, indexed FROM i_, s_
 UNION ALL SELECT 'taxonomy', CASE WHEN loose * 2 > caps THEN 'warn' ELSE 'ok' END, loose FROM c_
 UNION ALL SELECT 'quality', CASE WHEN (SELECT count(*) FROM ql) < skills THEN 'warn' ELSE 'ok' END, (SELECT count(*) FROM ql) FROM s_
 UNION ALL SELECT 'security', CASE WHEN assessed < versions THEN 'warn' ELSE 'ok' END, risky FROM v_
 UNION ALL SELECT 'repositories', CASE WHEN empty_repos > 0 THEN 'warn' ELSE 'ok' END, empty_repos FROM r_
 UNION ALL SELECT 'freshness', CASE WHEN newest IS NULL THEN 'warn' ELSE 'ok' END, newest FROM v_
 UNION ALL SELECT 'copies', 'ok', copies FROM x_)"""
_RD = f"""{CV}, {SK}, {SCORED.replace("d AS (SELECT *", "d0 AS (SELECT *").replace("FROM d)", "FROM d0)")}, {_kids('capabilities', 'kc')}, {_kids('tags', 'kt')},
d AS (SELECT cv.skill_id AS id, coalesce(kc.x, []) AS caps, coalesce(kt.x, []) AS tags, lower(coalesce(cv.summary, '')) AS s, cv.domain, cv.repo, sk.version_count, sc.overall AS quality
  FROM cv JOIN sk ON sk.id = cv.skill_id AND sk.lifecycle <> 'archived' LEFT JOIN kc ON kc.v = cv.id LEFT JOIN kt ON kt.v = cv.id LEFT JOIN sc ON sc.id = cv.id),
inst AS (SELECT id FROM d WHERE starts_with(repo, 'b'))"""
_KEYS = task_keywords(TASK)
_LK = "regexp_replace(lower(trim(coalesce(z, ''))), '[-_\\s]+', '', 'g')"
_MATCH = f"""kw(pos, k, n) AS (VALUES {', '.join(f"({i}, '{k}', '{k.replace('-', '').replace('_', '')}')" for i, k in enumerate(_KEYS))}),
hit AS (SELECT d.id, kw.pos, kw.k, CASE WHEN list_bool_or(list_transform(caps, lambda z: contains({_LK}, kw.n))) THEN 2.0 WHEN list_bool_or(list_transform(tags, lambda z: contains({_LK}, kw.n))) THEN 1.5 WHEN contains(s, kw.k) THEN 1.0 WHEN contains(lower(coalesce(domain, '')), kw.k) THEN 0.5 ELSE 0.0 END AS w FROM d, kw),
tm AS (SELECT id, least(sum(w) / {2.0 * len(_KEYS)}, 1.0)::DOUBLE AS score, array_to_string(list_slice(list(k ORDER BY pos), 1, 5), ', ') AS detail FROM hit WHERE w > 0 GROUP BY id)"""
_PEER = "(SELECT of, id FROM (SELECT i.id AS of, p.id AS id, row_number() OVER (PARTITION BY i.id ORDER BY p.id) AS n FROM inst i JOIN d x ON x.id = i.id JOIN d p ON p.{0} = x.{0} AND p.id <> i.id) WHERE n <= {1})"


def _rec(parts: list[str], limit: int) -> str:
    order = "CASE reason " + " ".join(f"WHEN '{s}' THEN {i}" for i, s in enumerate(SIGNALS)) + " END"
    return f"u AS ({' UNION ALL '.join(parts)}), best AS (SELECT * FROM u WHERE id NOT IN (SELECT id FROM inst) QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, {order}) = 1), rec AS (SELECT id, score, reason FROM best ORDER BY score DESC, id LIMIT {limit * 3})"


_SIM = "SELECT other AS id, overall * 0.25::DOUBLE AS score, 'similar' AS reason FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY overall DESC, other) AS n FROM ends WHERE id IN (SELECT id FROM inst)) WHERE n <= 5"
_ENDS = f"{PAIRS}, ends AS (SELECT a AS id, b AS other, x AS overall FROM (SELECT a, b, overall AS x FROM o WHERE overall >= 0.40) UNION ALL SELECT b, a, x FROM (SELECT a, b, overall AS x FROM o WHERE overall >= 0.40))"
_TASKED = f"WITH {_RD}, {_MATCH}, {_ENDS}, " + _rec([_SIM, "SELECT id, score * 0.85::DOUBLE AS score, 'task_match' AS reason FROM tm WHERE score > 0.1", f"SELECT id, 0.15::DOUBLE, 'same_category' FROM {_PEER.format('domain', 5)}", f"SELECT id, 0.10::DOUBLE, 'same_ecosystem' FROM {_PEER.format('repo', 3)}"], 40)
_POP = f"WITH {_RD}, {_ENDS}, " + _rec([_SIM, f"SELECT id, 0.15::DOUBLE AS score, 'same_category' AS reason FROM {_PEER.format('domain', 5)}", f"SELECT id, 0.10::DOUBLE, 'same_ecosystem' FROM {_PEER.format('repo', 3)}", "SELECT * FROM (SELECT id, least(coalesce(version_count, 0) / 10.0::DOUBLE, 1.0::DOUBLE) * 0.15::DOUBLE, 'popular' FROM d WHERE id NOT IN (SELECT id FROM inst) ORDER BY version_count DESC NULLS LAST, id LIMIT 10)", "SELECT * FROM (SELECT id, quality * 0.20::DOUBLE, 'high_quality' FROM d WHERE quality IS NOT NULL AND id NOT IN (SELECT id FROM inst) ORDER BY quality DESC, id LIMIT 10)"], 20)
_CHOSEN = f"WITH {_RD}, ch AS (SELECT *, row_number() OVER (ORDER BY id) AS pos FROM (SELECT * FROM d WHERE len(caps) > 0 ORDER BY len(caps) DESC, id LIMIT 12))"
_EXP = f"""WITH {CV}, {SK}, {_kids('capabilities', 'kc')}, {_kids('tags', 'kt')},
ex AS (SELECT cv.skill_id, coalesce(cv.name, '') AS name, coalesce(domain, 'uncategorized') AS domain, coalesce(repo, '') AS repo, coalesce(array_to_string(kc.x, '|'), '') AS capabilities, coalesce(array_to_string(kt.x, '|'), '') AS tags,
  coalesce(json_extract_string({json_sql('license')}, '$.type'), json_extract_string({json_sql('license')}, '$.license_type'), '') AS license_type, {RISK} AS security_risk
  FROM cv JOIN sk ON sk.id = cv.skill_id AND sk.lifecycle <> 'archived' LEFT JOIN kc ON kc.v = cv.id LEFT JOIN kt ON kt.v = cv.id)"""
_FMT = "CASE WHEN coalesce(trim({0}), '') = '' THEN 'unknown' ELSE lower(trim({0})) END"

SQL = {
    "scan_project_filter": "SELECT p_partkey, p_name, p_size FROM part WHERE p_size >= 25 AND p_retailprice < 1500",
    "json_range_filter": "SELECT event_id, k FROM (SELECT event_id, try_cast(json_extract_string(props, '$.k') AS INT) AS k FROM events) WHERE k >= 50",
    "risk_ordinal_filter": f"WITH {CV} SELECT * FROM (SELECT skill_id, {RISK} AS risk FROM cv) WHERE risk IN ('LOW', 'MEDIUM')",
    "semi_join_exists": "SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')",
    "anti_join_orphans": "SELECT 'capabilities' AS child, id FROM capabilities c WHERE NOT EXISTS (SELECT 1 FROM versions v WHERE v.id = c.version_id_fk) UNION ALL SELECT 'tags', id FROM tags t WHERE NOT EXISTS (SELECT 1 FROM versions v WHERE v.id = t.version_id_fk)",
    "left_join_coalesce": f"WITH {CV}, {SK} SELECT sk.id, coalesce(cv.name, sk.name, '') AS name, length(coalesce(cv.summary, ''))::INT AS chars FROM sk LEFT JOIN cv ON cv.skill_id = sk.id",
    "self_join_theta_pairs": "SELECT a.id AS a, b.id AS b FROM repositories a JOIN repositories b ON a.owner = b.owner AND a.id < b.id",
    "latest_version": f"WITH {CV} SELECT skill_id, id AS version_row, name FROM cv",
    "version_numbering": "SELECT id, skill_id, (row_number() OVER (PARTITION BY skill_id ORDER BY imported_at NULLS FIRST, id))::INT AS n FROM versions WHERE skill_id IS NOT NULL",
    "point_lookup": f"WITH {CV}, {_kids('capabilities', 'kc')}, {_kids('tags', 'kt')} SELECT skill_id, name, coalesce(array_to_string(kc.x, '|'), '') AS caps, coalesce(array_to_string(kt.x, '|'), '') AS tags FROM (SELECT * FROM cv ORDER BY skill_id LIMIT 1) p LEFT JOIN kc ON kc.v = p.id LEFT JOIN kt ON kt.v = p.id",
    "list_page": f"WITH {CV}, d AS (SELECT skill_id, name FROM cv WHERE domain = 'data') SELECT skill_id, name, (SELECT count(*) FROM d) AS total FROM d ORDER BY skill_id LIMIT 25 OFFSET 5",
    "records_filtered": f"{_QUAL}, {SK} SELECT cv.skill_id, cv.domain FROM cv JOIN ql ON ql.id = cv.id JOIN sk ON sk.id = cv.skill_id WHERE ql.s >= 0.5 AND coalesce(sk.is_current, false) AND sk.lifecycle <> 'archived' AND (input_format = 'markdown' OR output_format = 'markdown')",
    "repos_list": "SELECT r.id, skill_count, (SELECT count(DISTINCT skill_id) FROM versions v WHERE v.source_repo = r.id) AS found, coalesce(ecosystem, 'unknown') AS ecosystem FROM repositories r",
    "registry_stats": " UNION ALL ".join(f"SELECT '{t}' AS what, count(*) AS n FROM {t}" for t in ("skills", "versions", "capabilities", "tags", "repositories")),
    "eager_children": f"WITH {CV} SELECT repo, count(*) AS n, array_to_string(list_slice(list(coalesce(name, '') ORDER BY name NULLS FIRST, skill_id), 1, 3), '|') AS first_names FROM cv WHERE repo IS NOT NULL GROUP BY 1",
    "version_as_of": "WITH s AS (SELECT snapshot_no, max(snapshot_at) AS ts FROM version_snapshots WHERE snapshot_no IS NOT NULL GROUP BY 1) SELECT snapshot_no, skill_id, id AS version_row FROM versions JOIN s ON imported_at <= ts WHERE skill_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY snapshot_no, skill_id ORDER BY imported_at DESC, id DESC) = 1",
    "dup_names": f"WITH {CV} SELECT repo, name, count(*) AS n FROM cv WHERE name IS NOT NULL AND repo IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1",
    "repo_backfill": "SELECT DISTINCT source_repo FROM versions WHERE source_repo IS NOT NULL AND source_repo NOT IN (SELECT id FROM repositories)",
    "io_shape": f"SELECT {_FMT.format('input_format')} AS input, {_FMT.format('output_format')} AS output, count(*) AS n FROM versions GROUP BY 1, 2",
    "snapshot_diff_fields": f"WITH {_SNAP} SELECT * FROM ch",
    "snapshot_diff": f"WITH {_SNAP} SELECT no, change, count(DISTINCT skill_id) AS n FROM ch GROUP BY 1, 2 UNION ALL SELECT no, 'UNCHANGED', count(*) FROM j WHERE ka IS NOT NULL AND kb IS NOT NULL AND (no, skill_id) NOT IN (SELECT (no, skill_id) FROM ch) GROUP BY 1, 2",
    "apply_sync_state": f"WITH {_SNAP} SELECT no, skill_id, CASE WHEN kb IS NULL THEN ha ELSE hb END AS hash, CASE WHEN kb IS NULL THEN pa ELSE pb END AS path, (CASE WHEN ka IS NULL THEN 0 ELSE 1 END + CASE WHEN ka IS NULL OR (kb IS NOT NULL AND (ha IS DISTINCT FROM hb OR pa IS DISTINCT FROM pb)) THEN 1 ELSE 0 END)::INT AS n, CASE WHEN kb IS NULL THEN 'archived' ELSE 'active' END AS lifecycle FROM j",
    "sync_history_pivot": "SELECT sync_id, min(created_at) AS started, count(*) AS total, " + ", ".join(f"count(*) FILTER (upper(trim(change_type)) = '{k}') AS {k.lower()}" for k in ("ADDED", "MODIFIED", "REMOVED", "MOVED")) + " FROM sync_changelog WHERE sync_id IS NOT NULL GROUP BY 1",
    "entity_history": "SELECT id, entity_id, upper(trim(change_type)) AS change FROM sync_changelog WHERE entity_id = (SELECT entity_id FROM sync_changelog WHERE entity_id IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, entity_id LIMIT 1)",
    "roundtrip_diff": "SELECT id, name FROM skills WHERE false",
    "coverage_report": f"WITH {CV}, {SK}, m AS (SELECT *, id IN (SELECT version_id_fk FROM capabilities) AS hc, id IN (SELECT version_id_fk FROM tags) AS ht FROM cv), r AS ("
    + " UNION ALL ".join([f"SELECT '{c}' AS measure, count(*) FILTER ({_present(c)}) AS n FROM m" for c in _COV] + ["SELECT 'capabilities', count(*) FILTER (hc) FROM m", "SELECT 'tags', count(*) FILTER (ht) FROM m"])
    + ") SELECT measure, n, round(n * 100.0::DOUBLE / (SELECT count(*) FROM sk), 1) AS pct FROM r",
    "health_checks": f"{_CHECKS} SELECT * FROM k",
    "overall_health": f"{_CHECKS} SELECT CASE WHEN count(*) FILTER (status = 'fail') > 0 THEN 'unhealthy' WHEN count(*) FILTER (status = 'warn') > 2 THEN 'degraded' ELSE 'healthy' END AS health, count(*) FILTER (status = 'fail') AS fails, count(*) FILTER (status = 'warn') AS warns FROM k",
    "gap_lists": f"WITH {CV}, g AS (" + " UNION ALL ".join(f"SELECT '{k}' AS gap, skill_id FROM cv WHERE NOT {_present(k)}" for k in ("summary", "domain", "license", "security", "compatibility")) + " UNION ALL SELECT 'capabilities', skill_id FROM cv WHERE NOT EXISTS (SELECT 1 FROM capabilities c WHERE c.version_id_fk = cv.id) UNION ALL SELECT 'tags', skill_id FROM cv WHERE NOT EXISTS (SELECT 1 FROM tags c WHERE c.version_id_fk = cv.id)) SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY gap ORDER BY skill_id) <= 50",
    "quality_order_stats": f"{_QUAL}, rk AS (SELECT s, row_number() OVER (ORDER BY s) - 1 AS i, count(*) OVER () AS n FROM ql) SELECT min(s) AS min, max(s) FILTER (i = n // 4) AS p25, max(s) FILTER (i = n // 2) AS median, max(s) FILTER (i = 3 * n // 4) AS p75, max(s) AS max, round(avg(s), 6) AS mean, max(n) AS n FROM rk",
    "quality_histogram": f"{_QUAL} SELECT b::INT AS bucket, count(s) AS n FROM range(10) r(b) LEFT JOIN ql ON least(floor(s * 10), 9) = b GROUP BY 1",
    "quality_bands": f"{_QUAL} SELECT {_BANDS} AS band, count(*) AS n FROM ql GROUP BY 1",
    "top_bottom": f"{_QUAL} SELECT 'top' AS \"end\", rank::INT AS rank, skill_id, s AS score FROM (SELECT *, row_number() OVER (ORDER BY s DESC, skill_id) AS rank FROM ql) WHERE rank <= 5 UNION ALL SELECT 'bottom', rank::INT, skill_id, s FROM (SELECT *, row_number() OVER (ORDER BY s, skill_id) AS rank FROM ql) WHERE rank <= 5",
    "ecosystem_health": f"{_QUAL}, qr AS (SELECT repo, (sum(round(s * 1000)::BIGINT) // count(*))::BIGINT AS quality FROM ql GROUP BY 1), n AS (SELECT repo, count(*) AS records, count(*) FILTER ({_present('summary')}) AS described FROM cv GROUP BY 1) SELECT id, coalesce(records, 0) AS records, coalesce(described, 0) AS described, quality, array_to_string(list_filter([CASE WHEN coalesce(records, 0) = 0 THEN 'no_records' END, CASE WHEN NOT {_present('license')} THEN 'no_license' END, CASE WHEN last_successful_sync IS NULL THEN 'never_synced' END, CASE WHEN len(coalesce(sync_errors, [])) > 0 THEN 'sync_errors' END, CASE WHEN quality < 400 THEN 'low_quality' END], lambda x: x IS NOT NULL), '|') AS issues FROM repositories LEFT JOIN n ON n.repo = id LEFT JOIN qr ON qr.repo = id",
    "domain_distribution": f"WITH {CV} SELECT coalesce(domain, 'unknown') AS domain, count(*) AS n FROM cv GROUP BY 1",
    "category_distribution": f"SELECT {_CAT.format('taxonomy_path')} AS category, count(*) AS n FROM capabilities WHERE taxonomy_path IS NOT NULL GROUP BY 1",
    "risk_distribution": f"WITH {CV} SELECT {RISK} AS risk, count(*) AS n FROM cv GROUP BY 1",
    "nested_map_counts": f"WITH j AS (SELECT json_extract({json_sql('compatibility')}, '$.agents') AS a FROM versions), k AS (SELECT a, unnest(json_keys(a)) AS agent FROM j WHERE json_type(a) = 'OBJECT') SELECT agent, json_extract_string(a, '$.\"' || agent || '\".level') AS level, count(*) AS n FROM k GROUP BY 1, 2",
    "dependency_summary": f"WITH j AS (SELECT unnest(json_extract({json_sql('runtime_requirements')}, '$.tools[*]')) AS t FROM versions), n AS (SELECT CASE json_type(t) WHEN 'OBJECT' THEN json_extract_string(t, '$.name') WHEN 'VARCHAR' THEN json_extract_string(t, '$') END AS tool FROM j) SELECT tool, count(*) AS n FROM n WHERE tool IS NOT NULL GROUP BY 1 ORDER BY n DESC, tool LIMIT 10",
    "dependency_risks": f"WITH j AS (SELECT id, {json_sql('runtime_requirements')} AS j FROM versions), c AS (SELECT id, " + ", ".join(f"CASE WHEN json_type(j, '$.{k}') = 'ARRAY' THEN json_array_length(j, '$.{k}') ELSE 0 END AS {k}" for k in ("tools", "packages", "apis", "env_vars", "runtimes")) + " FROM j), n AS (SELECT id, (coalesce(tools, 0) + coalesce(packages, 0) + coalesce(apis, 0) + coalesce(env_vars, 0) + coalesce(runtimes, 0))::INT AS n, coalesce(apis, 0) AS apis FROM c) SELECT id, 'high_coupling' AS risk, n FROM n WHERE n > 10 UNION ALL SELECT id, 'service_required', n FROM n WHERE apis > 0",
    "rate_limit_window": "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 60 MINUTE PRECEDING AND CURRENT ROW) AS calls FROM events",
    "ttl_cache_hits": "WITH p AS (SELECT event_type, ts, lag(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS prev FROM events) SELECT event_type, count(*) AS calls, count(*) FILTER (ts - prev <= INTERVAL 1 HOUR) AS hits FROM p GROUP BY 1",
    "rec_task_match": f"WITH {_RD}, {_MATCH} SELECT id, round(score, 6) AS score, detail FROM tm",
    "rec_union_max": f"{_TASKED} SELECT id, round(score, 6) AS score, reason FROM rec",
    "rec_facets": f"{_TASKED} SELECT reason, count(*) AS n FROM rec GROUP BY 1",
    "rec_popular": f"{_POP} SELECT id, round(score, 6) AS score, reason FROM rec",
    "peer_same_domain": f"WITH {_RD} SELECT of, id FROM {_PEER.format('domain', 5)}",
    "compose_overlap": f"{_CHOSEN}, e AS (SELECT pos, id, unnest(caps) AS c FROM ch) SELECT x.id AS a, y.id AS b, string_agg(x.c, ', ' ORDER BY x.c) AS shared, count(*) AS n FROM e x JOIN e y ON x.c = y.c AND x.pos < y.pos GROUP BY 1, 2",
    "compose_conflicts": f"{_CHOSEN}, e AS (SELECT pos, id, unnest(caps) AS c FROM ch), p AS (SELECT x.id AS a, y.id AS b, list(x.c ORDER BY x.c) AS s FROM e x JOIN e y ON x.c = y.c AND x.pos < y.pos GROUP BY 1, 2) SELECT 'capability_overlap' AS kind, a, b, 'error' AS severity, '' AS resolution, array_to_string(s[1:5], ', ') AS detail FROM p UNION ALL SELECT 'missing_skill', 'no such record', '', 'error', '', 'not found'",
    "rec_for_record": f"WITH {_RD}, {_ENDS}, one AS (SELECT id AS rid FROM ends GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1), nr AS (SELECT other AS id, overall AS score FROM ends, one WHERE ends.id = rid ORDER BY overall DESC, other LIMIT 10), dm AS (SELECT p.id FROM d p JOIN d x ON p.domain = x.domain JOIN one ON x.id = rid WHERE p.id <> rid ORDER BY p.id LIMIT 10), u AS (SELECT id, score, 'similar' AS reason FROM nr UNION ALL SELECT id, 0.15::DOUBLE, 'same_category' FROM dm WHERE id NOT IN (SELECT id FROM nr)) SELECT id, round(score, 6) AS score, reason FROM u ORDER BY u.score DESC, id LIMIT 10",
    "compose_merge": f"{_CHOSEN} SELECT array_to_string(list_sort(list_distinct(flatten(list(caps)))), '|') AS caps, count(*) AS components, count(DISTINCT repo) AS sources FROM ch",
    "suggest_pairs": f"WITH {_RD}, {_MATCH}, t AS (SELECT id FROM (SELECT id, round(score, 6) AS score FROM tm) ORDER BY score DESC, id LIMIT 5), p AS (SELECT d.id, caps FROM d JOIN t USING (id)) SELECT x.id AS a, y.id AS b, len(list_intersect(x.caps, y.caps))::INT AS shared, len(list_distinct(list_concat(x.caps, y.caps)))::INT AS total FROM p x JOIN p y ON x.id < y.id ORDER BY shared, total DESC, a, b LIMIT 5",
    "export_rows_csv": f"{_EXP} SELECT * FROM ex",
    "export_stats": f"{_EXP} SELECT domain, count(*) AS records, count(*) FILTER (capabilities <> '') AS with_capabilities FROM ex GROUP BY 1",
    "export_markdown_lines": f"""{_EXP}, l AS (SELECT domain, name, skill_id, '- **' || name || '** (' || repo || ')' || CASE WHEN capabilities <> '' THEN ': ' || array_to_string(list_slice(string_split(capabilities, '|'), 1, 10), ', ') ELSE '' END AS line FROM ex)
SELECT domain, '## ' || array_to_string(list_transform(string_split(replace(domain, '_', ' '), ' '), lambda x: upper(x[1]) || lower(x[2:])), ' ') || chr(10) || string_agg(line, chr(10) ORDER BY name, skill_id, line) AS block FROM l GROUP BY domain""",
}
