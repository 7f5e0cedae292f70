"""Sources: registry documents (nested JSON, two layouts), files, tables (SRC-*)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.functions.text import broken_summary, uuid5_url
from loomspan.operators.records import latest_by
from loomspan.schema import TABLES


def parse_time(c: Column | str) -> Column:
    """ISO time or null."""
    return F.try_to_timestamp(F.regexp_replace(c if isinstance(c, Column) else F.col(c), r"Z$", "")).cast("timestamp_ntz")


def either(v: Column, key: str = "value", kind: str = "string") -> Column:
    """A scalar, or the `key` of an object, of a variant."""
    return F.coalesce(F.try_variant_get(v, f"$.{key}", kind), F.when(~F.schema_of_variant(v).startswith("OBJECT"), F.try_variant_get(v, "$", kind)))


def _documents(spark: SparkSession, path: str) -> DataFrame:
    """One variant per document; a broken document is null and gives no rows."""
    return spark.read.text(path, wholetext=True).select(F.try_parse_json("value").alias("d")).where("d IS NOT NULL")


def _each(docs: DataFrame, name: str) -> DataFrame:
    return docs.select(F.explode(F.try_variant_get("d", f"$.{name}", "array<variant>")).alias("r"))


def _get(path: str, kind: str = "string") -> Column:
    return F.try_variant_get("r", f"$.{path}", kind)


def read_registry(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of nested registry documents: skills, versions, capabilities,
    tags, repositories.  Fields may be scalars or objects with provenance;
    elements of lists may be strings or objects; of records with one id the last
    updated counts.  All lazy; nothing is collected."""
    docs = _documents(spark, path)
    sub = lambda p: either(F.try_variant_get("r", f"$.{p}", "variant"))
    skills = _each(docs, "skills").select(
        _get("id").alias("id"),
        sub("canonical_key").alias("canonical_key"),
        sub("name").alias("name"),
        sub("display_name").alias("display_name"),
        _get("aliases", "array<string>").alias("aliases"),
        _get("lifecycle").alias("lifecycle"),
        _get("is_current", "boolean").alias("is_current"),
        sub("primary_source").alias("primary_source"),
        _get("primary_source.confidence", "double").alias("primary_source_confidence"),
        parse_time(_get("first_seen_at")).alias("first_seen_at"),
        parse_time(_get("last_updated_at")).alias("last_updated_at"),
        _get("current_version_id").alias("current_version_id"),
    )
    text = lambda p: F.to_json(F.try_variant_get("r", f"$.{p}", "variant"))
    raw = _each(docs, "versions").select(
        F.xxhash64(_get("skill_id"), _get("version_id")).alias("id"),
        _get("skill_id").alias("skill_id"),
        _get("version_id").alias("version_id"),
        *[F.coalesce(_get(f"source.{c}"), _get(f"source_{c}")).alias(f"source_{c}") for c in ("repo", "path", "commit_sha", "branch", "content_hash", "type")],
        parse_time(_get("imported_at")).alias("imported_at"),
        parse_time(_get("last_checked_at")).alias("last_checked_at"),
        _get("name").alias("name"),
        _get("summary").alias("summary"),
        F.coalesce(_get("domain.primary"), _get("domain_primary")).alias("domain_primary"),
        *[text(c).alias(c) for c in ("runtime_requirements", "compatibility", "security", "license")],
        _get("raw_content").alias("raw_content"),
        _get("capabilities", "array<variant>").alias("caps"),
        _get("tags", "array<variant>").alias("tgs"),
    )
    versions = raw.drop("caps", "tgs")
    caps = raw.select(F.col("id").alias("version_id_fk"), F.explode("caps").alias("e")).select("version_id_fk", either(F.col("e"), "name").alias("name"), F.try_variant_get("e", "$.canonical", "string").alias("canonical"), F.try_variant_get("e", "$.taxonomy_path", "string").alias("taxonomy_path"))
    tags = raw.select(F.col("id").alias("version_id_fk"), F.explode("tgs").alias("e")).select("version_id_fk", either(F.col("e"), "name").alias("name"), F.coalesce(F.try_variant_get("e", "$.source", "string"), F.lit("imported")).alias("source"))
    repos = _each(docs, "repositories").select(_get("id").alias("id"), _get("url").alias("url"), _get("owner").alias("owner"), _get("name").alias("name"), text("license").alias("license"), _get("default_branch").alias("default_branch"), _get("skill_count", "int").alias("skill_count"))
    return {"skills": latest_by(skills, ["id"], ["last_updated_at"]), "versions": versions, "capabilities": caps.where("name IS NOT NULL").distinct(), "tags": tags.where("name IS NOT NULL").distinct(), "repositories": repos}


def read_flat_registry(spark: SparkSession, path: str, host: str = "https://code.example") -> dict[str, DataFrame]:
    """The older flat layout: {sources: {repo: n}, skills: [...]}.

    Ids are name-based; input and output shapes may be null, text or objects;
    broken summaries become null; repositories that only records name are added
    to the declared ones."""
    docs = _documents(spark, path)
    r = _each(docs, "skills").select(
        _get("id").alias("old_id"), _get("name").alias("name"), _get("repo").alias("repo"), _get("skill_path").alias("path"), _get("summary").alias("summary"), _get("domain").alias("domain"),
        F.try_variant_get("r", "$.input_shape", "variant").alias("i"), F.try_variant_get("r", "$.output_shape", "variant").alias("o"), _get("capabilities", "array<string>").alias("caps"), _get("tags", "array<string>").alias("tags"),
    )
    shape = lambda v: F.coalesce(F.try_variant_get(v, "$.format", "string"), F.when(F.schema_of_variant(v) == "STRING", F.nullif(F.try_variant_get(v, "$", "string"), F.lit(""))), F.lit("unknown"))
    r = r.withColumn("id", uuid5_url(F.concat(F.lit(host + "/"), "repo", F.lit("/"), F.coalesce("path", "name"))))
    skills = r.select("id", "name", F.concat("repo", F.lit("#"), "name").alias("canonical_key"), F.lit("current").alias("lifecycle"), F.lit(True).alias("is_current"), F.col("repo").alias("primary_source"))
    versions = r.select(F.xxhash64("id").alias("id"), F.col("id").alias("skill_id"), F.col("repo").alias("source_repo"), F.col("path").alias("source_path"), "name", F.when(~broken_summary("summary"), F.col("summary")).alias("summary"), F.col("domain").alias("domain_primary"), shape(F.col("i")).alias("input_format"), shape(F.col("o")).alias("output_format"))
    caps = r.select(F.xxhash64("id").alias("version_id_fk"), F.explode("caps").alias("name")).distinct()
    tags = r.select(F.xxhash64("id").alias("version_id_fk"), F.explode("tags").alias("name")).withColumn("source", F.lit("imported")).distinct()
    said = docs.select(F.explode(F.try_variant_get("d", "$.sources", "map<string, int>")).alias("id", "declared"))
    seen = r.groupBy(F.col("repo").alias("id")).agg(F.count_distinct("path").alias("skill_count"))
    repos = said.join(seen, "id", "full_outer").select("id", F.substring_index("id", "/", 1).alias("owner"), F.coalesce("skill_count", F.lit(0)).cast("int").alias("skill_count"), F.col("declared").isNull().alias("backfilled"))
    return {"skills": skills, "versions": versions, "capabilities": caps, "tags": tags, "repositories": repos}


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of whole files, for the parsers."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def upsert(existing: DataFrame, incoming: DataFrame, *keys: str) -> DataFrame:
    """Incoming rows replace existing ones of the same key."""
    return existing.join(incoming.select(*keys), list(keys), "left_anti").unionByName(incoming, allowMissingColumns=True)


def read_tables(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    return {t: spark.read.parquet(f"{path}/{t}.parquet") for t in TABLES}
