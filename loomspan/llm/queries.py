"""Queries of the text-corpus problems and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomspan.llm.bpe import token_ids
from loomspan.llm.licences import licences
from loomspan.llm.markup import markup
from loomspan.llm.matching import map_to_reference
from loomspan.llm.packing import pack_documents
from loomspan.llm.pii import personal_data, redact
from loomspan.llm.setjoin import record_sets, similar_classes, similar_pairs
from loomspan.session import table


def _version_sets(spark, sf):
    sets = record_sets([(table(spark, sf, "capabilities", "version_id_fk", "canonical"), "version_id_fk", "canonical"), (table(spark, sf, "tags", "version_id_fk", "name"), "version_id_fk", "name")], 4)
    return sets.join(table(spark, sf, "versions", "id").where("id IS NOT NULL").distinct(), "id", "left_semi")


def _pages(spark, sf):
    return table(spark, sf, "versions", "id", "source_repo", "source_path", "raw_content")


def p1_found(spark, sf):
    return markup(_pages(spark, sf))[0]


def p1_clean(spark, sf):
    return markup(_pages(spark, sf))[1]


def p2_found(spark, sf):
    return similar_pairs(_version_sets(spark, sf)).select(F.col("a").alias("version_a"), F.col("b").alias("version_b"))


def p2_classes(spark, sf):
    """Every version's class of equal sets and the class's number of links."""
    members, links = similar_classes(_version_sets(spark, sf))
    deg = links.select(F.explode(F.array("cls_a", "cls_b")).alias("cls")).groupBy("cls").agg(F.count("*").alias("links"))
    return members.join(deg, "cls", "left").select("id", F.col("cls").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"))


def p3_found(spark, sf):
    return licences(table(spark, sf, "versions", "id", "source_repo", "license", "raw_content"), table(spark, sf, "repositories", "id", "license"), table(spark, sf, "license_ref", "license_id"))


def p5_found(spark, sf):
    return map_to_reference(table(spark, sf, "capabilities", "id", "name", "canonical"), table(spark, sf, "taxonomy_ref", "canonical", "aliases"))


def p8_ids(spark, sf):
    return token_ids(table(spark, sf, "documents", "doc_id", "text"))


def p9_packing(spark, sf):
    return pack_documents(table(spark, sf, "documents", "doc_id", "text"), table(spark, sf, "pack_targets"))


def p10_found(spark, sf):
    return personal_data(table(spark, sf, "documents", "doc_id", "text"), table(spark, sf, "name_hints", "name", "role"))


def p10_redacted(spark, sf):
    return redact(table(spark, sf, "documents", "doc_id", "text"), table(spark, sf, "name_hints", "name", "role"))


QUERIES = {"p1_found": p1_found, "p1_clean": p1_clean, "p2_found": p2_found, "p2_classes": p2_classes, "p3_found": p3_found, "p5_found": p5_found, "p8_ids": p8_ids, "p9_packing": p9_packing, "p10_found": p10_found, "p10_redacted": p10_redacted}

_SETS = r"""
v AS (
  SELECT version_id_fk AS id, '0:' || nullif(regexp_replace(lower(regexp_replace(canonical, '^\s+|\s+$', '', 'g')), '[\s_-]+', '-', 'g'), '') AS v FROM capabilities
  UNION SELECT version_id_fk, '1:' || nullif(regexp_replace(lower(regexp_replace(name, '^\s+|\s+$', '', 'g')), '[\s_-]+', '-', 'g'), '') FROM tags),
t AS (SELECT DISTINCT id, v FROM v WHERE v IS NOT NULL AND id IN (SELECT id FROM versions)),
s AS (SELECT id, count(*) AS n FROM t GROUP BY id HAVING count(*) >= 4)"""

SQL = {
    "p2_found": f"""WITH {_SETS},
o AS (SELECT a.id AS a, b.id AS b, count(*) AS o FROM t a JOIN t b ON a.v = b.v AND a.id < b.id GROUP BY 1, 2)
SELECT o.a AS version_a, o.b AS version_b FROM o JOIN s x ON x.id = o.a JOIN s y ON y.id = o.b
WHERE o.o >= 0.7 * (x.n + y.n - o.o) - 1e-9""",
}
