"""Frames and SQL fragments that several query modules share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.functions.text import ACCENTED, BARE
from loomspan.operators.records import current_skills, current_versions
from loomspan.session import table

DOC_COLUMNS = ("id", "skill_id", "imported_at", "name", "summary", "domain_primary", "source_repo")


def docs(spark, sf: str, *more: str) -> DataFrame:
    """Current version of each skill as a searchable document."""
    v = current_versions(table(spark, sf, "versions", *DOC_COLUMNS, *more))
    return v.withColumnRenamed("domain_primary", "domain").withColumnRenamed("source_repo", "repo")


def skills(spark, sf: str) -> DataFrame:
    return current_skills(table(spark, sf, "skills", "id", "name", "canonical_key", "display_name", "lifecycle", "is_current", "primary_source", "last_updated_at", "version_count", "metadata_quality"))


CV = """cv AS (SELECT *, domain_primary AS domain, source_repo AS repo FROM versions WHERE skill_id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY skill_id ORDER BY imported_at DESC NULLS LAST, id DESC) = 1)"""
SK = """sk AS (SELECT * FROM skills WHERE id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY last_updated_at DESC NULLS LAST, is_current DESC NULLS LAST, canonical_key DESC NULLS LAST) = 1)"""
TOKENS = f"regexp_extract_all(translate(lower(coalesce({{0}}, '')), '{ACCENTED}', '{BARE}'), '[\\p{{{{L}}}}\\p{{{{N}}}}]+')"


def tokens_sql(c: str) -> str:
    return f"regexp_extract_all(translate(lower(coalesce({c}, '')), '{ACCENTED}', '{BARE}'), '[\\p{{L}}\\p{{N}}]+')"


def json_sql(c: str) -> str:
    """JSON text with strings unwrapped, null if it is broken."""
    once = f"CASE WHEN json_valid({c}) THEN CASE WHEN json_type({c}::JSON) = 'VARCHAR' THEN json_extract_string({c}, '$') ELSE {c} END END"
    return f"(SELECT CASE WHEN json_valid(j) THEN j END FROM (SELECT {once} AS j))"


RISK = f"coalesce(upper(json_extract_string({json_sql('security')}, '$.risk_level')), 'UNKNOWN')"


def rounded(c, n: int = 6):
    return F.round(c, n)
