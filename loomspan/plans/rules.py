"""Queries of rule classifiers, taxonomy, parsers, dependencies and graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomspan.functions import rules as R
from loomspan.functions import text as T
from loomspan.operators import graph as G
from loomspan.operators import parsing as P
from loomspan.operators import scoring as Q
from loomspan.operators import taxonomy as X
from loomspan.operators.nested import nested_children
from loomspan.operators.records import category_of
from loomspan.functions.text import json_value
from loomspan.plans import scoring_sql as S
from loomspan.plans.common import CV, json_sql
from loomspan.session import table


def _v(spark, sf, *c):
    return table(spark, sf, "versions", "id", *c)


def license_detect(spark, sf):
    return Q.with_scan(_v(spark, sf, "raw_content"), "raw_content").select("id", Q.license_name().alias("license"))


def scored(spark, sf, of=None):
    """All scores of every version, or of those in of(id); no table tells stars, so
    they are 0."""
    v = _v(spark, sf, "source_repo", "name", "summary", "raw_content", "domain_primary", "input_format", "output_format", "runtime_requirements", "license", "imported_at").withColumn("stars", F.lit(0))
    if of is not None:
        v = v.join(of.select("id"), "id", "left_semi")
    return Q.score_versions(v, table(spark, sf, "capabilities", "version_id_fk"), table(spark, sf, "tags", "version_id_fk"), table(spark, sf, "repositories", "id", "license"))


def license_of(spark, sf):
    s = scored(spark, sf)
    return s.select("id", F.col("license_type").alias("type"), F.col("license_confidence").alias("confidence"), F.col("permissions.redistributable").alias("redistributable"), F.col("permissions.requires_attribution").alias("attribution"))


def security_flags(spark, sf):
    v = Q.with_scan(_v(spark, sf, "summary", "raw_content"), "summary", "raw_content").withColumn("flags", Q.security_flags())
    return v.select("id", F.array_join("flags", "|").alias("flags"), Q.risk_level(F.col("flags")).alias("risk"))


def risk_level(spark, sf):
    return security_flags(spark, sf).groupBy("risk").agg(F.count("*").alias("n"))


def quality_score(spark, sf):
    return scored(spark, sf).select("id", "documentation", "metadata", "freshness", "adoption", "dependency", "posture", "overall")


def scoring_summary(spark, sf):
    return Q.scoring_summary(scored(spark, sf))


def _signals(spark, sf):
    """What texts and names of requirements tell about platforms."""
    v = json_value("runtime_requirements")
    names = lambda k: F.transform(F.coalesce(F.try_variant_get(v, f"$.{k}", "array<variant>"), F.array().cast("array<variant>")), lambda x: F.try_variant_get(x, "$.name", "string"))
    d = _v(spark, sf, "source_path", "summary", "raw_content", "runtime_requirements")
    d = d.withColumn("needs", F.array_join(F.concat(names("packages"), names("tools")), " "))
    return Q.platform_signals(d, "id", "source_path", "summary", "raw_content", "needs")


def _text_signals(spark, sf):
    return Q.platform_signals(_v(spark, sf, "source_path", "summary", "raw_content"), "id", "source_path", "summary", "raw_content")


def compat_matrix(spark, sf):
    return Q.agent_fit(_text_signals(spark, sf)).select("id", "agent", "score", "level", F.array_join("blockers", "|").alias("blockers"))


def compat_levels(spark, sf):
    return compat_matrix(spark, sf).groupBy("agent", "level").agg(F.count("*").alias("n"))


def compat_notes(spark, sf):
    """Notes and enablers, with the names of requirements read as text."""
    return Q.agent_fit(_signals(spark, sf)).select("id", "agent", F.array_join("notes", "|").alias("notes"), F.array_join("enablers", "|").alias("enablers"))


def compat_incremental(spark, sf):
    """Profiles of the versions that have none yet."""
    r = Q.compatibility_records(_text_signals(spark, sf), _v(spark, sf, "compatibility"))
    return r.select("id", "profile.invocation_type", "profile.mcp_compatible", F.size("profile.agents").alias("agents"), F.col("profile.agents")["codex"]["level"].alias("codex"))


def compat_summary(spark, sf):
    return Q.compatibility_summary(_text_signals(spark, sf))


def runtime_os_detect(spark, sf):
    return _text_signals(spark, sf).select("id", F.array_join("runtimes", "|").alias("runtimes"), F.array_join("systems", "|").alias("systems"), "invocation")


def _classified(spark, sf):
    return X.classify(table(spark, sf, "capabilities", "name"), table(spark, sf, "taxonomy_ref", "ref_id", "canonical", "taxonomy_path", "aliases"))


def taxonomy_classify(spark, sf):
    return _classified(spark, sf)


def taxonomy_distribution(spark, sf):
    return _classified(spark, sf).groupBy(category_of("taxonomy_path").alias("category"), "how").agg(F.count("*").alias("n"))


def taxonomy_changes(spark, sf):
    """How many capability rows a re-classification would change."""
    c = table(spark, sf, "capabilities", "name", "canonical", "taxonomy_path")
    j = c.alias("c").join(_classified(spark, sf).alias("k"), "name")
    return j.agg(F.count_if(F.col("c.canonical").eqNullSafe(F.col("k.canonical"))).alias("kept"), F.count_if(~F.col("c.canonical").eqNullSafe(F.col("k.canonical"))).alias("changed"))


def taxonomy_stats(spark, sf):
    r = table(spark, sf, "taxonomy_ref", "category", "canonical", "aliases")
    return r.groupBy("category").agg(F.count("*").alias("names"), F.sum(F.size("aliases")).alias("aliases"))


def ordered_distinct(spark, sf):
    c = table(spark, sf, "capabilities", "id", "version_id_fk", "canonical")
    return X.ordered_distinct(c, "version_id_fk", "canonical", "id").select("version_id_fk", "canonical", "id", "n")


def parse_title_sections(spark, sf):
    d = P.parse_files(_v(spark, sf, "source_path", "raw_content"), "id", "source_path", "raw_content")
    return d.select("id", "format", "name", F.array_join("headings", "|").alias("headings"), F.size("capabilities").alias("bullets"), "confidence")


def parse_summary(spark, sf):
    return P.parse_files(_v(spark, sf, "source_path", "raw_content"), "id", "source_path", "raw_content").select("id", "summary", F.array_join("capabilities", "|").alias("capabilities"))


def parse_names(spark, sf):
    """Names and summaries of files of one format, told from the path alone."""
    d = _v(spark, sf, "source_path", "raw_content").withColumn("given", F.lit("skill"))
    return P.parse_files(d, "id", "source_path", "raw_content", given="given").select("id", "name", "summary")


def parse_needs(spark, sf):
    d = P.parse_files(_v(spark, sf, "source_path", "raw_content"), "id", "source_path", "raw_content")
    return d.select("id", "format", F.array_join("dependencies", "|").alias("dependencies"), F.array_join("compatibility", "|").alias("compatibility"), F.array_join("tags", "|").alias("tags"))


def infer_domain(spark, sf):
    return _v(spark, sf, "raw_content").select("id", P.infer_domain(F.col("raw_content")).alias("domain"))


def parse_tags(spark, sf):
    return _v(spark, sf, "raw_content").select("id", F.array_join(P.technology_tags(F.col("raw_content")), "|").alias("tags")).where("tags <> ''")


def _all_deps(spark, sf):
    v = _v(spark, sf, "summary", "raw_content", "runtime_requirements").withColumn("t", F.concat_ws("\n", "summary", "raw_content"))
    return P.version_dependencies(v, "id", "t", "runtime_requirements")


def dep_union(spark, sf):
    """Every dependency of every version, told from its text or declared."""
    return _all_deps(spark, sf).select("id", "type", "name", "ecosystem", "confidence", "source")


def dep_records(spark, sf):
    r = P.dependency_record(_all_deps(spark, sf))
    return r.select("id", *[F.size(c).alias(c) for c in ("tools", "apis", "packages", "env_vars", "runtimes")])


def dep_api_keys(spark, sf):
    d = table(spark, sf, "documents", "doc_id", "text")
    return d.select("doc_id", F.explode(P.api_keys(F.col("text"))).alias("service"))


def dep_packages(spark, sf):
    """Packages that requirements name, by how many versions."""
    return _deps(spark, sf).groupBy("name", "ecosystem").agg(F.count_distinct("id").alias("n"))


def dep_text_packages(spark, sf):
    return P.packages(table(spark, sf, "documents", "doc_id", "text"), "doc_id", "text").groupBy("ecosystem", "package").agg(F.count("*").alias("n"))


def dep_env_vars(spark, sf):
    d = table(spark, sf, "documents", "doc_id", "text")
    return d.select("doc_id", F.explode(P.env_vars(F.col("text"))).alias("name"))


def dep_tools(spark, sf):
    d = table(spark, sf, "documents", "doc_id", "text")
    return d.select(F.explode(P.tools(F.col("text"))).alias("tool")).groupBy("tool").agg(F.count("*").alias("n"))


def secret_scan(spark, sf):
    return P.secrets(table(spark, sf, "documents", "doc_id", "text"), "doc_id", "text")


def _edges(spark, sf):
    """Who needs what: a skill its requirements, a package its extras, a service
    the variables of its credentials."""
    v = _v(spark, sf, "skill_id", "runtime_requirements").where("skill_id IS NOT NULL")
    c = nested_children(v, columns=("runtime_requirements",))
    names = F.concat_ws(":", F.when(F.col("child") == "extra", "package").when((F.col("child") == "env_var") & (F.col("parent") != ""), "api"), F.when(F.col("parent") != "", F.col("parent")))
    own = c.where("parent = ''").join(v.select("id", "skill_id"), "id").select(F.concat(F.lit("skill:"), "skill_id").alias("src"), F.concat_ws(":", "child", "item").alias("dst"))
    return own.unionByName(c.where("parent <> ''").select(names.alias("src"), F.concat_ws(":", "child", "item").alias("dst"))).distinct()


def graph_direct(spark, sf):
    e = _edges(spark, sf)
    return e.groupBy("dst").agg(F.count("*").alias("dependents"))


def graph_closure(spark, sf):
    return G.closure(_edges(spark, sf)).select("src", "dst", "depth")


def graph_cycles(spark, sf):
    return G.cycles(G.closure(_edges(spark, sf)))


def _deps(spark, sf):
    """(id, src, name, ecosystem) of the packages in the requirements; elements
    that are no objects have no ecosystem and do not count here."""
    each = F.explode(F.try_variant_get(T.json_value("runtime_requirements"), "$.packages", "array<variant>"))
    d = _v(spark, sf, "skill_id", "runtime_requirements").select("id", F.col("skill_id").alias("src"), each.alias("p"))
    return d.select("id", "src", F.try_variant_get("p", "$.name", "string").alias("name"), F.try_variant_get("p", "$.ecosystem", "string").alias("ecosystem")).where("name IS NOT NULL")


def graph_conflicts(spark, sf):
    return G.conflicts(_deps(spark, sf).where("src IS NOT NULL"), "name", "ecosystem").select("name", F.array_join("wanted", "|").alias("wanted"))


def graph_external(spark, sf):
    s = table(spark, sf, "skills", "id", "name")
    _, ext = G.resolve(_deps(spark, sf).where("src IS NOT NULL").select("src", "name"), s)
    return ext.groupBy("name").agg(F.count("*").alias("n"))


def graph_stats(spark, sf):
    e = _edges(spark, sf)
    return G.graph_stats(e, e.select(F.explode(F.array("src", "dst")).alias("id")))


def content_hash(spark, sf):
    return _v(spark, sf, "raw_content").select("id", T.content_hash("raw_content").alias("h"))


def record_hash(spark, sf):
    return _v(spark, sf, "name", "summary", "source_path", "raw_content").select("id", T.record_hash(F.col("name"), F.col("summary"), F.col("source_path"), F.col("raw_content")).alias("h"))


def record_uuid(spark, sf):
    return _v(spark, sf, "source_repo", "source_path").select("id", T.uuid5_url(F.concat(F.lit("https://code.example/"), "source_repo", F.lit("/"), "source_path")).alias("uuid"))


def validate_ids(spark, sf):
    t = table(spark, sf, "tags", "id", "name")
    return t.select("id", T.identifier_check("name").alias("c"), T.dangerous_query("name").alias("dangerous")).select("id", "c.valid", F.array_join("c.errors", "|").alias("errors"), "dangerous")


def html_escape(spark, sf):
    return _v(spark, sf, "summary").select("id", T.escape_html("summary").alias("escaped"), T.sanitize_query("summary").alias("query"))


def broken_summary(spark, sf):
    return _v(spark, sf, "summary").select("id", T.broken_summary("summary").alias("broken"))


NAMES = "license_detect license_of security_flags risk_level quality_score scoring_summary compat_matrix compat_levels compat_notes compat_incremental compat_summary runtime_os_detect taxonomy_classify taxonomy_distribution taxonomy_changes taxonomy_stats ordered_distinct parse_title_sections parse_summary parse_names parse_needs infer_domain parse_tags dep_union dep_records dep_api_keys dep_packages dep_text_packages dep_env_vars dep_tools secret_scan graph_direct graph_closure graph_cycles graph_conflicts graph_external graph_stats content_hash record_hash record_uuid validate_ids html_escape broken_summary".split()
QUERIES = {n: globals()[n] for n in NAMES}


_KEY = "regexp_replace(lower(trim({0})), '[-_\\s]+', '', 'g')"
_TAX = f"""WITH al0 AS (SELECT ref_id * 1000 + generate_subscripts(list_concat([canonical], aliases), 1) - 1 AS rank, canonical, taxonomy_path, unnest(list_concat([canonical], aliases)) AS alias FROM taxonomy_ref),
al AS (SELECT rank, {_KEY.format('alias')} AS key, canonical, taxonomy_path FROM al0 QUALIFY row_number() OVER (PARTITION BY {_KEY.format('alias')} ORDER BY rank) = 1),
n AS (SELECT DISTINCT name, {_KEY.format('name')} AS key FROM capabilities WHERE name IS NOT NULL),
ex AS (SELECT n.name, al.canonical, al.taxonomy_path, 'exact' AS how FROM n JOIN al ON al.key = n.key),
fz AS (SELECT n.name, al.canonical, al.taxonomy_path, 'fuzzy' AS how FROM n JOIN al ON length(al.key) >= 4 AND n.key <> '' AND (contains(n.key, al.key) OR contains(al.key, n.key))
  WHERE n.key NOT IN (SELECT key FROM al) QUALIFY row_number() OVER (PARTITION BY n.name ORDER BY al.rank) = 1),
dn AS (SELECT * FROM ex UNION ALL SELECT * FROM fz),
cl AS (SELECT name, CASE WHEN c = '' THEN 'unknown' ELSE c END AS c FROM (SELECT name, regexp_replace(regexp_replace(lower(trim(name)), '[^a-z0-9_]', '_', 'g'), '^_+|_+$', '', 'g') AS c FROM n WHERE name NOT IN (SELECT name FROM dn))),
tx AS (SELECT * FROM dn UNION ALL SELECT name, c, 'uncategorized/' || c, 'none' FROM cl)"""
_BODY = "regexp_replace(replace(coalesce(raw_content, ''), chr(13) || chr(10), chr(10)), '(?s)^---[ \\t]*\\n.*?\\n---[ \\t]*\\n', '')"
_DOM = "[" + ", ".join("(" + " + ".join(f"contains(t, '{w}')::INT" for w in ws) + ")" for ws in R.DOMAINS.values()) + "]"
_DEPS = "dp AS (SELECT id, skill_id AS src, json_extract_string(p, '$.name') AS name, json_extract_string(p, '$.ecosystem') AS ecosystem FROM (SELECT id, skill_id, unnest(json_extract(j, '$.packages[*]')) AS p FROM (SELECT *, " + json_sql("runtime_requirements") + " AS j FROM versions) WHERE j IS NOT NULL) WHERE json_type(p) = 'OBJECT' AND json_extract_string(p, '$.name') IS NOT NULL)"
_KINDS = {"tools": "tool", "apis": "api", "packages": "package", "env_vars": "env_var", "runtimes": "runtime"}
_NAME = "CASE json_type({0}) WHEN 'VARCHAR' THEN json_extract_string({0}, '$') WHEN 'OBJECT' THEN CASE WHEN json_type({0}, '$.name') = 'VARCHAR' THEN json_extract_string({0}, '$.name') END END"
_EDGES = f"""rq AS (SELECT id, skill_id, {json_sql('runtime_requirements')} AS j FROM versions WHERE skill_id IS NOT NULL),
el AS ({' UNION ALL '.join(f"SELECT skill_id, '{t}' AS kind, unnest(json_extract(j, '$.{k}[*]')) AS x FROM rq WHERE json_type(j) = 'OBJECT' AND json_type(j, '$.{k}') = 'ARRAY'" for k, t in _KINDS.items())}),
na AS (SELECT skill_id, kind, x, {_NAME.format('x')} AS name FROM el),
ch AS (SELECT 'package:' || name AS src, 'extra' AS kind, unnest(json_extract(x, '$.extras[*]')) AS y FROM na WHERE kind = 'package' AND json_type(x) = 'OBJECT' AND coalesce(name, '') <> ''
  UNION ALL SELECT 'api:' || name, 'env_var', unnest(json_extract(x, '$.credentials.env_vars[*]')) FROM na WHERE kind = 'api' AND json_type(x) = 'OBJECT' AND coalesce(name, '') <> ''),
e AS (SELECT 'skill:' || skill_id AS src, kind || ':' || name AS dst FROM na WHERE coalesce(name, '') <> '' UNION SELECT src, kind || ':' || ({_NAME.format('y')}) FROM ch WHERE coalesce({_NAME.format('y')}, '') <> '')"""
_REACH = f"WITH RECURSIVE {_EDGES}, r AS (SELECT src, dst, 1 AS depth FROM e UNION SELECT r.src, e.dst, r.depth + 1 FROM r JOIN e ON r.dst = e.src WHERE r.depth < 20), c AS (SELECT src, dst, min(depth)::INT AS depth FROM r GROUP BY 1, 2)"

_SECRETS = [r"(?i)(?:api[_-]?key|secret|token|password|credential)\s*[:=]\s*[''\"]?[a-z0-9_-]{20,}", "(?i)gh[oprsu]_[a-z0-9]{36,}", "(?i)[ps]k_(?:live|test)_[a-z0-9]{20,}", "(?i)akia[0-9a-z]{16}"]
_FREE = "('MIT', 'Apache-2.0', 'BSD', 'BSD-2-Clause', 'BSD-3-Clause', 'ISC', 'Unlicense', 'GPL', 'GPL-2.0', 'GPL-3.0', 'LGPL', 'AGPL', 'AGPL-3.0', 'MPL-2.0')"
_RT = ", ".join(f"CASE WHEN {S.word('t', *p)} THEN '{n}' END" for n, p in S.RUNTIMES.items())

SQL = {
    "license_detect": f"SELECT id, {S.license_case('t')} AS license FROM (SELECT id, lower(coalesce(raw_content, '')) AS t FROM versions)",
    "license_of": f"WITH {S.LICENSED} SELECT id, license_type AS type, license_confidence AS confidence, CASE WHEN license_type IN {_FREE} THEN true END AS redistributable, CASE WHEN license_type IN {_FREE} THEN license_type <> 'Unlicense' END AS attribution FROM lic",
    "security_flags": f"WITH {S.FLAGGED} SELECT id, array_to_string(flags, '|') AS flags, risk FROM r",
    "risk_level": f"WITH {S.FLAGGED} SELECT risk, count(*) AS n FROM r GROUP BY 1",
    "quality_score": f"WITH {S.SCORED} SELECT id, documentation, metadata, freshness, adoption, dependency, posture, overall FROM sc",
    "scoring_summary": f"WITH {S.SCORED} SELECT 'quality' AS kind, CASE WHEN overall >= 0.8 THEN 'excellent' WHEN overall >= 0.6 THEN 'good' WHEN overall >= 0.4 THEN 'fair' ELSE 'poor' END AS key, count(*) AS n FROM sc GROUP BY 1, 2 UNION ALL SELECT 'license', license_type, count(*) FROM sc GROUP BY 1, 2 UNION ALL SELECT 'risk', risk, count(*) FROM sc GROUP BY 1, 2 UNION ALL SELECT 'average', 'quality', coalesce(floor(avg(round(overall * 1000)::BIGINT)), 0)::BIGINT FROM sc",
    "compat_matrix": f"WITH {S.fit()} SELECT id, agent, score, level, array_to_string(blockers, '|') AS blockers FROM fit",
    "compat_levels": f"WITH {S.fit()} SELECT agent, level, count(*) AS n FROM fit GROUP BY 1, 2",
    "compat_incremental": f"WITH {S.fit()} SELECT s.id, invocation AS invocation_type, m AS mcp_compatible, (SELECT count(*) FROM a)::INT AS agents, fit.level AS codex FROM s JOIN fit ON fit.id = s.id AND agent = 'codex' JOIN versions v ON v.id = s.id WHERE v.compatibility IS NULL OR regexp_replace(v.compatibility, '\\s+', '', 'g') IN ('', '{{}}', '[]', 'null')",
    "compat_summary": f"WITH {S.fit()} SELECT 'invocation' AS kind, invocation AS key, count(*) AS n FROM s GROUP BY 1, 2 UNION ALL SELECT 'runtime', unnest(list_filter([{_RT}], lambda x: x IS NOT NULL)) AS k, count(*) FROM s GROUP BY 1, 2 UNION ALL SELECT 'format', 'mcp', count(*) FROM s WHERE m HAVING count(*) > 0 UNION ALL SELECT 'format', 'skill_md', count(*) FROM s WHERE sf HAVING count(*) > 0 UNION ALL SELECT 'level', agent || ' ' || level, count(*) FROM fit GROUP BY 1, 2",
    "runtime_os_detect": f"WITH d AS (SELECT id, source_path, {S.BOTH} AS t FROM versions) SELECT id, {S.bank(S.RUNTIMES)} AS runtimes, {S.bank(S.SYSTEMS)} AS systems, {S.INVOCATION} AS invocation FROM d",
    "taxonomy_classify": f"{_TAX} SELECT name, canonical, taxonomy_path, how FROM tx",
    "taxonomy_distribution": f"{_TAX} SELECT regexp_extract(taxonomy_path, '^([^./]*)', 1) AS category, how, count(*) AS n FROM tx GROUP BY 1, 2",
    "taxonomy_changes": f"{_TAX} SELECT count(*) FILTER (c.canonical IS NOT DISTINCT FROM tx.canonical) AS kept, count(*) FILTER (c.canonical IS DISTINCT FROM tx.canonical) AS changed FROM capabilities c JOIN tx USING (name)",
    "taxonomy_stats": "SELECT category, count(*) AS names, sum(len(aliases))::BIGINT AS aliases FROM taxonomy_ref GROUP BY 1",
    "ordered_distinct": "SELECT version_id_fk, canonical, min(id) AS id, (row_number() OVER (PARTITION BY version_id_fk ORDER BY min(id)))::INT AS n FROM capabilities WHERE canonical IS NOT NULL GROUP BY 1, 2",
    "parse_names": f"WITH b AS (SELECT id, {_BODY} AS t FROM versions), h AS (SELECT id, t, regexp_extract(t, '(?s)\\A(?:#\\s+[^\\n]+|.*?\\n#\\s+[^\\n]+)') AS head FROM b) SELECT id, trim(regexp_extract(t, '(?m)^#\\s+(.+)', 1)) AS name, trim(regexp_extract(substr(t, length(head) + 1), '\\n\\n([^#\\n][^\\n]+)', 1)) AS summary FROM h",
    "infer_domain": f"SELECT id, CASE WHEN list_max(n) = 0 THEN 'general' ELSE list_extract({list(R.DOMAINS)}, list_position(n, list_max(n))) END AS domain FROM (SELECT id, {_DOM} AS n FROM (SELECT id, lower(coalesce(raw_content, '')) AS t FROM versions))",
    "parse_tags": f"SELECT * FROM (SELECT id, array_to_string(list_slice(list_sort(list_intersect(list_distinct(regexp_extract_all(lower(coalesce(raw_content, '')), '[\\p{{L}}\\p{{N}}_]+')), {R.TECHNOLOGIES})), 1, 15), '|') AS tags FROM versions) WHERE tags <> ''",
    "dep_packages": f"WITH {_DEPS} SELECT name, ecosystem, count(DISTINCT id) AS n FROM dp GROUP BY 1, 2",
    "dep_env_vars": "SELECT doc_id, unnest(list_sort(list_distinct(regexp_extract_all(coalesce(text, ''), '[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)+')))) AS name FROM documents",
    "dep_tools": "SELECT tool, count(*) AS n FROM (SELECT unnest(list_filter([" + ", ".join(f"CASE WHEN {S.word('t', x)} THEN '{x}' END" for x in sorted(S.TOOLS)) + "], lambda x: x IS NOT NULL)) AS tool FROM (SELECT lower(coalesce(text, '')) AS t FROM documents)) GROUP BY 1",
    "secret_scan": "WITH h AS (" + " UNION ALL ".join(f"SELECT doc_id, {i} AS kind, regexp_extract_all(text, '{p}') AS hits, string_split_regex(text, '{p}') AS parts FROM documents WHERE text IS NOT NULL" for i, p in enumerate(_SECRETS)) + "), e AS (SELECT doc_id, kind, hits, parts, unnest(range(1, len(hits) + 1)) AS k FROM h WHERE len(hits) > 0) SELECT doc_id AS id, kind, left(hits[k], 40) || '...' AS preview, (list_sum(list_transform(parts[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:k-1], lambda x: length(x))), 0))::INT AS position FROM e",
    "graph_direct": f"WITH {_EDGES} SELECT dst, count(*) AS dependents FROM e GROUP BY 1",
    "graph_closure": f"{_REACH} SELECT src, dst, depth FROM c",
    "graph_cycles": f"{_REACH} SELECT min(least(a.src, a.dst)) AS cycle, a.src AS node FROM c a JOIN c b ON a.src = b.dst AND a.dst = b.src GROUP BY a.src",
    "graph_conflicts": f"WITH {_DEPS} SELECT name, array_to_string(list_sort(list_distinct(list(ecosystem))), '|') AS wanted FROM dp WHERE ecosystem IS NOT NULL AND src IS NOT NULL GROUP BY 1 HAVING count(DISTINCT ecosystem) > 1",
    "graph_external": f"WITH {_DEPS} SELECT name, count(DISTINCT src) AS n FROM dp WHERE src IS NOT NULL AND lower(name) NOT IN (SELECT lower(name) FROM skills WHERE name IS NOT NULL) GROUP BY 1",
    "graph_stats": f"WITH {_EDGES} SELECT (SELECT count(DISTINCT n) FROM (SELECT src AS n FROM e UNION ALL SELECT dst FROM e)) AS nodes, count(*) AS edges, count(DISTINCT src) AS with_dependencies, count(DISTINCT dst) AS depended_on FROM e",
    "content_hash": "SELECT id, sha256(coalesce(raw_content, '')) AS h FROM versions",
    "record_hash": "SELECT id, sha256(coalesce(name, '') || '|' || coalesce(summary, '') || '|' || coalesce(source_path, '') || CASE WHEN coalesce(raw_content, '') <> '' THEN '|' || raw_content ELSE '' END) AS h FROM versions",
    "validate_ids": """SELECT id, n <> '' AND length(n) <= 256 AND regexp_matches(n, '^[a-zA-Z0-9_.-]+$') AS valid,
  array_to_string(list_filter([CASE WHEN n = '' THEN 'empty' END, CASE WHEN length(n) > 256 THEN 'too long' END, CASE WHEN n <> '' AND NOT regexp_matches(n, '^[a-zA-Z0-9_.-]+$') THEN 'bad character' END], lambda x: x IS NOT NULL), '|') AS errors,
  length(name) > 500 OR regexp_matches(name, '(?i)(^|[^a-z0-9_])(drop|delete|insert|update|alter|create|exec|execute|union|truncate)([^a-z0-9_]|$)|--|;|/\\*|\\*/') AS dangerous FROM (SELECT id, name, coalesce(name, '') AS n FROM tags)""",
    "html_escape": """SELECT id, replace(replace(replace(replace(replace(summary, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') AS escaped, trim(replace(regexp_replace(summary, '[{}()\\[\\]^~]', '', 'g'), '"', '""')) AS query FROM versions""",
    "broken_summary": "SELECT id, regexp_matches(t, '^(\\||---|```|>\\s*\\[!|\\*\\*One-Time)') OR length(t) < 10 AS broken FROM (SELECT id, trim(coalesce(summary, '')) AS t FROM versions)",
}
