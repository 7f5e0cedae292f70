"""Queries of full-text search, filters, facets and joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomspan.functions.text import label_key
from loomspan.operators import search as S
from loomspan.operators.records import category_of, children, live, risk_of
from loomspan.plans.common import CV, RISK, SK, docs, rounded, skills, tokens_sql
from loomspan.session import table

FIELDS = ["name", "summary", "domain", "repo"]


def _index(spark, sf, stem=False):
    return S.build_index(docs(spark, sf), "skill_id", FIELDS, stem)


def _scored(hits):
    return hits.select("id", rounded(F.col("score")).alias("score"))


def _bm25(query, mode, stem=False):
    return lambda spark, sf: _scored(S.bm25(_index(spark, sf, stem), query, mode))


def fts_postings(spark, sf):
    return _index(spark, sf).postings.select("term", "id", "field", "tf")


def fts_build_stats(spark, sf):
    i = _index(spark, sf)
    return i.lengths.agg(F.count("*").alias("docs"), F.sum("dl").alias("tokens"), F.max("dl").alias("longest")).crossJoin(
        i.postings.agg(F.count_distinct("term").alias("terms"), F.count("*").alias("postings"))
    )


def bm25_filtered_page(spark, sf):
    """Search with filters: live skills, lowest risk, a domain, and a page."""
    i = _index(spark, sf)
    d = docs(spark, sf, "security")
    keep = d.where((F.col("domain") == "data") & risk_of("security").isin("LOW", "MEDIUM", "UNKNOWN")).select(F.col("skill_id").alias("id"))
    keep = keep.join(live(skills(spark, sf)).select("id"), "id", "left_semi")
    return _scored(S.page(S.bm25(i, "agent table").join(keep, "id", "left_semi"), 20, 5))


def search_details(spark, sf):
    """Hits with the first ten capabilities and tags and the fields that match."""
    q = "ledger export"
    hits = S.page(S.bm25(_index(spark, sf), q, "all"), 30)
    d = docs(spark, sf).withColumnRenamed("skill_id", "sid")
    caps = children(table(spark, sf, "capabilities", "version_id_fk", "name"), "name", "caps", 10)
    tags = children(table(spark, sf, "tags", "version_id_fk", "name"), "name", "tags", 10)
    has = lambda f: F.arrays_overlap(S.search_tokens(F.coalesce(f, F.lit(""))), F.array(*[F.lit(w) for w in q.split()]))
    matched = F.array_join(F.array_compact(F.array(*[F.when(has(f), F.lit(f)) for f in FIELDS])), ",")
    out = hits.join(d, F.col("sid") == hits["id"]).select(hits["id"].alias("skill_id"), d["id"].alias("version"), "score", matched.alias("matched_fields"))
    out = out.join(caps, "version", "left").join(tags, "version", "left")
    return out.select("skill_id", rounded(F.col("score")).alias("score"), "matched_fields", F.coalesce(F.array_join("caps", "|"), F.lit("")).alias("capabilities"), F.coalesce(F.array_join("tags", "|"), F.lit("")).alias("tags"))


def phrase_search(spark, sf):
    return S.phrase(_index(spark, sf), "deployment manifest").select("id", "field", "hits")


def boolean_not(spark, sf):
    i = _index(spark, sf)
    return S.without(S.bm25(i, "ledger"), i, "agent machine").select("id")


def prefix_autocomplete(spark, sf):
    return S.autocomplete(docs(spark, sf), "skill_id", "name", "re", 15)


def _page_facets(spark, sf, query, limit):
    hits = S.bm25(_index(spark, sf), query)
    if limit:
        hits = S.page(hits, limit)
    d = docs(spark, sf)
    rows = d.join(hits.select(F.col("id").alias("skill_id")), "skill_id", "left_semi")
    caps = table(spark, sf, "capabilities", "version_id_fk", "taxonomy_path").select(F.col("version_id_fk").alias("version"), category_of("taxonomy_path").alias("category"))
    rows = rows.withColumnRenamed("id", "version").join(caps, "version", "left")
    return S.facets(rows, ["domain", "repo", "category"], "skill_id")


def facets_page(spark, sf):
    return _page_facets(spark, sf, "manifest machine", 50)


def facets_all(spark, sf):
    return _page_facets(spark, sf, "manifest machine", None)


def capability_search(spark, sf):
    c = table(spark, sf, "capabilities", "version_id_fk", "name", "canonical")
    hit = c.where(F.contains(label_key("name"), F.lit("review")) | F.contains(label_key("canonical"), F.lit("review"))).select(F.col("version_id_fk").alias("id")).distinct()
    return docs(spark, sf).join(hit, "id", "left_semi").select("skill_id", "name")


def tag_search(spark, sf):
    t = table(spark, sf, "tags", "version_id_fk", "name").where(label_key("name") == "onboarding").select(F.col("version_id_fk").alias("id")).distinct()
    return docs(spark, sf).join(t, "id", "left_semi").select("skill_id", "name")


def index_stats(spark, sf):
    c = table(spark, sf, "capabilities", "id").agg(F.count("*").alias("capabilities"))
    t = table(spark, sf, "tags", "id").agg(F.count("*").alias("tags"))
    return docs(spark, sf).agg(F.count("*").alias("skills")).crossJoin(c).crossJoin(t)


QUERIES = {
    "fts_postings": fts_postings,
    "fts_build_stats": fts_build_stats,
    "bm25_single": _bm25("ledger", "any"),
    "bm25_multi_any": _bm25("ledger export machine", "any"),
    "bm25_multi_all": _bm25("ledger export", "all"),
    "bm25_multi_ref": _bm25("ledger export", "ref"),
    "bm25_stemmed": _bm25("reviewing exports", "any", True),
    "bm25_filtered_page": bm25_filtered_page,
    "search_details": search_details,
    "phrase_search": phrase_search,
    "boolean_not": boolean_not,
    "prefix_autocomplete": prefix_autocomplete,
    "facets_page": facets_page,
    "facets_all": facets_all,
    "capability_search": capability_search,
    "tag_search": tag_search,
    "index_stats": index_stats,
}

_TOK = f"""tok AS (
  SELECT skill_id AS id, f.field AS field, unnest(f.toks) AS term, generate_subscripts(f.toks, 1) - 1 AS pos
  FROM (SELECT skill_id, unnest([{', '.join(f"{{'field': '{f}', 'toks': {tokens_sql(f)}}}" for f in FIELDS)}]) AS f FROM cv))"""
_BASE = f"""WITH {CV}, {_TOK},
dl AS (SELECT cv.skill_id AS id, {' + '.join(f'len({tokens_sql(f)})' for f in FIELDS)} AS dl FROM cv),
st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl),
w AS (SELECT id, term, CASE field WHEN 'name' THEN 5.0 WHEN 'summary' THEN 2.0 ELSE 1.0 END AS w FROM tok)"""


def _parts_sql(parts: list[tuple[str, str]]) -> str:
    """Per document and part the weighted frequency and the score."""
    out = []
    for i, (kind, word) in enumerate(parts):
        cond = f"term = '{word}'" if kind == "e" else f"starts_with(term, '{word}')"
        out.append(f"""f{i} AS (SELECT id, sum(w) AS f FROM w WHERE {cond} GROUP BY id),
s{i} AS (SELECT f{i}.id, CASE WHEN x.idf <= 0 THEN 1e-6 ELSE x.idf END * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * dl.dl / st.avgdl)) AS s
  FROM f{i} JOIN dl ON dl.id = f{i}.id, st, (SELECT ln(((SELECT n FROM st) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM f{i}) x)""")
    return ",\n".join(out)


def _bm25_sql(words: list[str], mode: str) -> str:
    parts = [("e", w) for w in words] + ([("p", w) for w in words] if mode == "ref" else [])
    k = len(words)
    joins = " ".join(f"LEFT JOIN s{i} ON s{i}.id = dl.id" for i in range(len(parts)))
    if mode == "ref":
        terms = ["coalesce(s0.s, 0)"] + [f"CASE WHEN s{k + i}.s IS NOT NULL AND s{i + 1}.s IS NOT NULL THEN s{k + i}.s + s{i + 1}.s ELSE 0 END" for i in range(k - 1)] + [f"coalesce(s{2 * k - 1}.s, 0)"]
        ok = " OR ".join(["s0.s IS NOT NULL"] + [f"(s{k + i}.s IS NOT NULL AND s{i + 1}.s IS NOT NULL)" for i in range(k - 1)] + [f"s{2 * k - 1}.s IS NOT NULL"])
    else:
        terms = [f"coalesce(s{i}.s, 0)" for i in range(k)]
        ok = (" AND " if mode == "all" else " OR ").join(f"s{i}.s IS NOT NULL" for i in range(k))
    return f"{_BASE},\n{_parts_sql(parts)},\nhits AS (SELECT dl.id, {' + '.join(terms)} AS score FROM dl {joins} WHERE {ok})"


_FACETS = """, rows AS (SELECT cv.skill_id, cv.domain, cv.repo, regexp_extract(c.taxonomy_path, '^([^./]*)', 1) AS category
  FROM cv JOIN pg ON pg.id = cv.skill_id LEFT JOIN capabilities c ON c.version_id_fk = cv.id),
fc AS (SELECT 'domain' AS facet, domain AS value, skill_id FROM rows UNION ALL SELECT 'repo', repo, skill_id FROM rows UNION ALL SELECT 'category', category, skill_id FROM rows),
g AS (SELECT facet, value, count(DISTINCT skill_id) AS n FROM fc WHERE value IS NOT NULL AND value <> '' GROUP BY 1, 2)
SELECT facet, value, n FROM g QUALIFY row_number() OVER (PARTITION BY facet ORDER BY n DESC, value) <= 20"""
_LABEL = "regexp_replace(lower(trim({0})), '[-_\\s]+', '', 'g')"

SQL = {
    "fts_postings": f"WITH {CV}, {_TOK} SELECT term, id, field, count(*) AS tf FROM tok GROUP BY 1, 2, 3",
    "fts_build_stats": f"{_BASE} SELECT (SELECT count(*) FROM dl) AS docs, (SELECT sum(dl)::BIGINT FROM dl) AS tokens, (SELECT max(dl) FROM dl) AS longest, (SELECT count(DISTINCT term) FROM tok) AS terms, (SELECT count(*) FROM (SELECT DISTINCT term, id, field FROM tok)) AS postings",
    "bm25_single": _bm25_sql(["ledger"], "any") + " SELECT id, round(score, 6) AS score FROM hits",
    "bm25_multi_any": _bm25_sql(["ledger", "export", "machine"], "any") + " SELECT id, round(score, 6) AS score FROM hits",
    "bm25_multi_all": _bm25_sql(["ledger", "export"], "all") + " SELECT id, round(score, 6) AS score FROM hits",
    "bm25_multi_ref": _bm25_sql(["ledger", "export"], "ref") + " SELECT id, round(score, 6) AS score FROM hits",
    "bm25_filtered_page": _bm25_sql(["agent", "table"], "any") + f", {SK} SELECT hits.id, round(score, 6) AS score FROM hits JOIN cv ON cv.skill_id = hits.id JOIN sk ON sk.id = hits.id WHERE cv.domain = 'data' AND {RISK} IN ('LOW', 'MEDIUM', 'UNKNOWN') AND sk.lifecycle <> 'archived' ORDER BY score DESC, hits.id LIMIT 20 OFFSET 5",
    "search_details": _bm25_sql(["ledger", "export"], "all") + """, pg AS (SELECT * FROM hits ORDER BY score DESC, id LIMIT 30),
c AS (SELECT version_id_fk AS v, array_to_string(list_slice(list_sort(list_distinct(list(name))), 1, 10), '|') AS x FROM capabilities WHERE name IS NOT NULL GROUP BY 1),
t AS (SELECT version_id_fk AS v, array_to_string(list_slice(list_sort(list_distinct(list(name))), 1, 10), '|') AS x FROM tags WHERE name IS NOT NULL GROUP BY 1)
SELECT pg.id AS skill_id, round(pg.score, 6) AS score, (SELECT string_agg(f, ',' ORDER BY o) FROM (SELECT DISTINCT field AS f, CASE field WHEN 'name' THEN 1 WHEN 'summary' THEN 2 WHEN 'domain' THEN 3 ELSE 4 END AS o FROM tok WHERE tok.id = pg.id AND term IN ('ledger', 'export'))) AS matched_fields,
  coalesce(c.x, '') AS capabilities, coalesce(t.x, '') AS tags FROM pg JOIN cv ON cv.skill_id = pg.id LEFT JOIN c ON c.v = cv.id LEFT JOIN t ON t.v = cv.id""",
    "phrase_search": f"WITH {CV}, {_TOK} SELECT a.id, a.field, count(*)::INT AS hits FROM tok a JOIN tok b ON a.id = b.id AND a.field = b.field AND b.pos = a.pos + 1 WHERE a.term = 'deployment' AND b.term = 'manifest' GROUP BY 1, 2",
    "boolean_not": f"WITH {CV}, {_TOK} SELECT DISTINCT id FROM tok WHERE term = 'ledger' AND id NOT IN (SELECT id FROM tok WHERE term IN ('agent', 'machine'))",
    "prefix_autocomplete": f"WITH {CV} SELECT skill_id AS id, name FROM cv WHERE len(list_filter({tokens_sql('name')}, lambda x: starts_with(x, 're'))) > 0 ORDER BY length(name), name, skill_id LIMIT 15",
    "facets_page": _bm25_sql(["manifest", "machine"], "any") + ", pg AS (SELECT * FROM hits ORDER BY score DESC, id LIMIT 50)" + _FACETS,
    "facets_all": _bm25_sql(["manifest", "machine"], "any") + ", pg AS (SELECT * FROM hits)" + _FACETS,
    "capability_search": f"WITH {CV} SELECT skill_id, name FROM cv WHERE id IN (SELECT version_id_fk FROM capabilities WHERE contains({_LABEL.format('name')}, 'review') OR contains({_LABEL.format('canonical')}, 'review'))",
    "tag_search": f"WITH {CV} SELECT skill_id, name FROM cv WHERE id IN (SELECT version_id_fk FROM tags WHERE {_LABEL.format('name')} = 'onboarding')",
    "index_stats": f"WITH {CV} SELECT (SELECT count(*) FROM cv) AS skills, (SELECT count(*) FROM capabilities) AS capabilities, (SELECT count(*) FROM tags) AS tags",
}
