"""Queries of similarity and duplicate detection."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomspan.operators import similarity as D
from loomspan.operators.allpairs import similar_sets
from loomspan.operators.records import current_versions
from loomspan.plans.common import CV, rounded
from loomspan.session import broadcast_if_small, table

COLUMNS = ("id", "skill_id", "imported_at", "name", "summary", "source_repo", "source_path", "source_content_hash")


def _prints(spark, sf):
    v = current_versions(table(spark, sf, "versions", *COLUMNS))
    return D.fingerprints(v, table(spark, sf, "capabilities", "version_id_fk", "name", "canonical"))


def fingerprints(spark, sf):
    return _prints(spark, sf).select("id", "name_n", F.size("words").alias("words"), F.array_join("caps", "|").alias("caps"), "source")


def dedup_exact(spark, sf):
    return D.exact_copies(table(spark, sf, "versions", "id", "raw_content"))


def dedup_jaccard(spark, sf):
    """Pairs of current versions whose summaries share half of their words."""
    return similar_sets(_prints(spark, sf), "words", 0.5, 6)


def similar(spark, sf, name_score=D.edit_ratio, of=None, most=None):
    """Similar pairs of current versions in all dimensions; with of(id), all pairs
    that hold one of these records; with `most` too, the `most` best of each."""
    f = _prints(spark, sf)
    if of is not None:
        of = broadcast_if_small(of.select("id").distinct().withColumn("end", F.lit(True)))
        f = f.join(of, "id", "left")
    pairs = D.detect_duplicates(f, 0.40, name_score=name_score, most=most)
    return pairs if most is None else D.nearest(pairs, of, most)


def dedup_full_edit(spark, sf):
    return similar(spark, sf).select("a", "b", rounded(F.col("overall")).alias("overall"), "class")


def dedup_full(spark, sf):
    return similar(spark, sf, D.ratio).select("a", "b", rounded(F.col("overall")).alias("overall"), "class")


def dedup_classes(spark, sf):
    return similar(spark, sf).groupBy("class").agg(F.count("*").alias("n"))


def edges_bidirectional(spark, sf):
    """The most similar other record of each record."""
    e = D.both_ways(similar(spark, sf).withColumn("overall", rounded(F.col("overall"))))
    best = e.groupBy("id").agg(F.max(F.struct("overall", "other")).alias("m"), F.count("*").alias("n"))
    return best.select("id", F.col("m.other").alias("other"), F.col("m.overall").alias("overall"), "n")


QUERIES = {
    "fingerprints": fingerprints,
    "dedup_exact": dedup_exact,
    "dedup_jaccard": dedup_jaccard,
    "dedup_full_edit": dedup_full_edit,
    "dedup_full": dedup_full,
    "dedup_classes": dedup_classes,
    "edges_bidirectional": edges_bidirectional,
}

_FP = f"""WITH {CV},
cp AS (SELECT version_id_fk AS v, list_sort(list_distinct(list(coalesce(canonical, lower(trim(name)))))) AS caps FROM capabilities WHERE version_id_fk IS NOT NULL AND coalesce(canonical, lower(trim(name))) IS NOT NULL GROUP BY 1),
fp AS (SELECT skill_id AS id, trim(regexp_replace(lower(coalesce(name, '')), '[^a-z0-9\\s]', '', 'g')) AS name_n,
  list_distinct(regexp_extract_all(lower(coalesce(summary, '')), '[\\p{{L}}\\p{{N}}_]+')) AS words, coalesce(caps, []) AS caps,
  source_content_hash AS hash, lower(coalesce(source_repo, '') || '/' || coalesce(source_path, '')) AS source FROM cv LEFT JOIN cp ON cp.v = cv.id)"""
_JAC = "CASE WHEN len(a.{0}) = 0 OR len(b.{0}) = 0 THEN 0.0 ELSE len(list_intersect(a.{0}, b.{0})) / (len(a.{0}) + len(b.{0}) - len(list_intersect(a.{0}, b.{0})))::DOUBLE END"
_PAIR_STEPS = f"""
pd AS (SELECT a.id AS a, b.id AS b,
  CASE WHEN a.name_n = '' OR b.name_n = '' THEN 0.0 ELSE 1 - levenshtein(a.name_n, b.name_n) / greatest(length(a.name_n), length(b.name_n))::DOUBLE END AS nm,
  {_JAC.format('words')} AS sm, {_JAC.format('caps')} AS cp, CASE WHEN a.hash = b.hash AND a.hash <> '' THEN 1.0 ELSE 0.0 END AS ct,
  CASE WHEN a.source = b.source AND a.source NOT IN ('', '/') THEN 1.0 ELSE 0.0 END AS sr FROM fp a JOIN fp b ON a.id < b.id),
pt AS (SELECT *, 0.30::DOUBLE * nm + 0.20::DOUBLE * sm + 0.35::DOUBLE * cp + 0.10::DOUBLE * ct + 0.05::DOUBLE * sr AS x FROM pd),
o AS (SELECT a, b, greatest(x, CASE WHEN ct = 1 THEN 0.99::DOUBLE ELSE 0 END, CASE WHEN sr = 1 AND nm > 0.7 THEN 0.90::DOUBLE ELSE 0 END) AS overall FROM pt)"""
_ALL = f"""{_FP}, {_PAIR_STEPS},
r AS (SELECT a, b, round(overall, 6) AS overall, CASE WHEN overall >= 0.95 THEN 'EXACT_DUPLICATE' WHEN overall >= 0.80 THEN 'NEAR_DUPLICATE' WHEN overall >= 0.60 THEN 'FUNCTIONAL_OVERLAP' ELSE 'RELATED' END AS class FROM o WHERE overall >= 0.40)"""

#: CTEs up to o(a, b, overall) for a statement that has cv already.
PAIRS = _FP[len(f"WITH {CV},\n") :] + "," + _PAIR_STEPS

SQL = {
    "fingerprints": f"{_FP} SELECT id, name_n, len(words)::INT AS words, array_to_string(caps, '|') AS caps, source FROM fp",
    "dedup_exact": "SELECT min(id) AS first_id, count(*) AS n FROM versions WHERE raw_content IS NOT NULL GROUP BY raw_content HAVING count(*) > 1",
    "dedup_jaccard": f"{_FP} SELECT * FROM (SELECT a.id AS a, b.id AS b, round({_JAC.format('words')}, 6) AS jaccard FROM fp a JOIN fp b ON a.id < b.id) WHERE jaccard >= 0.5",
    "dedup_full_edit": f"{_ALL} SELECT a, b, overall, class FROM r",
    "dedup_classes": f"{_ALL} SELECT class, count(*) AS n FROM r GROUP BY 1",
    "edges_bidirectional": f"{_ALL}, e AS (SELECT a AS id, b AS other, overall FROM r UNION ALL SELECT b, a, overall FROM r) SELECT id, (max({{'overall': overall, 'other': other}})).other AS other, max(overall) AS overall, count(*) AS n FROM e GROUP BY id",
}
