"""Schemas of the registry tables, and checks of their keys (T1-T9)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TABLES = {
    "skills": "id string, canonical_key string, name string, display_name string, aliases array<string>, lifecycle string, is_current boolean, primary_source string, primary_source_confidence double, primary_path string, first_seen_at timestamp_ntz, last_updated_at timestamp_ntz, metadata_quality string, version_count int, current_version_id string",
    "versions": "id bigint, skill_id string, version_id string, source_repo string, source_path string, source_commit_sha string, source_branch string, source_content_hash string, source_type string, imported_at timestamp_ntz, last_checked_at timestamp_ntz, name string, display_name string, summary string, domain_primary string, input_format string, output_format string, runtime_requirements string, compatibility string, security string, license string, raw_content string",
    "capabilities": "id bigint, version_id_fk bigint, name string, canonical string, taxonomy_path string",
    "tags": "id bigint, version_id_fk bigint, name string, source string",
    "repositories": "id string, url string, owner string, name string, source_type string, license string, default_branch string, description string, ecosystem string, parser_compatibility string, last_successful_sync timestamp_ntz, sync_errors array<string>, skill_count int",
    "sync_changelog": "id bigint, sync_id string, change_type string, entity_type string, entity_id string, field_name string, old_value string, new_value string, details string, created_at timestamp_ntz",
}
#: Version of the table layout; readers add columns that an older one lacks.
LAYOUT = 3


def conform(df: DataFrame, name: str) -> DataFrame:
    """A table in its layout: missing columns null, others dropped, types cast."""
    want = df.sparkSession.createDataFrame([], TABLES[name])
    return want.unionByName(df.select(*[F.col(c).try_cast(t).alias(c) for c, t in want.dtypes if c in df.columns]), allowMissingColumns=True)


def duplicate_keys(df: DataFrame, *keys: str) -> DataFrame:
    """Keys that stand for more than one row (a unique constraint as a check)."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def orphans(child: DataFrame, fk: str, parent: DataFrame, pk: str) -> DataFrame:
    """Child rows without a parent (a foreign key as a check)."""
    return child.where(F.col(fk).isNotNull()).join(parent.select(F.col(pk).alias(fk)), fk, "left_anti")


def schema_json(name: str) -> str:
    from pyspark.sql import SparkSession

    return SparkSession.active().createDataFrame([], TABLES[name]).schema.json()
