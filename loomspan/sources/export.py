"""Sinks: the flat catalogue as rows, CSV, JSON and Markdown (SNK-*)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.functions.text import json_text
from loomspan.operators.records import children, risk_of

SCHEMA_VERSION = "3.0"


def catalogue_rows(docs: DataFrame, capabilities: DataFrame, tags: DataFrame, keep: DataFrame | None = None) -> DataFrame:
    """One flat row per record: lists joined by `|`, JSON fields reduced to what
    a reader of the file needs.  docs(id, skill_id, name, summary, domain, repo,
    license, security)."""
    caps, tg = children(capabilities, "name", "caps"), children(tags, "name", "tags")
    d = docs if keep is None else docs.join(keep.withColumnRenamed("id", "skill_id"), "skill_id", "left_semi")
    j = d.join(caps, d["id"] == caps["version"], "left").drop("version").join(tg, d["id"] == tg["version"], "left")
    empty = lambda c: F.coalesce(c, F.lit(""))
    return j.select(
        "skill_id",
        empty(F.col("name")).alias("name"),
        F.coalesce("domain", F.lit("uncategorized")).alias("domain"),
        empty(F.col("repo")).alias("repo"),
        empty(F.array_join("caps", "|")).alias("capabilities"),
        empty(F.array_join("tags", "|")).alias("tags"),
        empty(F.coalesce(json_text("license", "$.type"), json_text("license", "$.license_type"))).alias("license_type"),
        risk_of("security").alias("security_risk"),
    )


def markdown_lines(rows: DataFrame) -> DataFrame:
    """(domain, block): one Markdown block per domain, its records by name."""
    line = F.concat(F.lit("- **"), "name", F.lit("** ("), "repo", F.lit(")"), F.when(F.col("capabilities") != "", F.concat(F.lit(": "), F.array_join(F.slice(F.split("capabilities", r"\|"), 1, 10), ", "))).otherwise(F.lit("")))
    g = rows.select("domain", F.struct("name", "skill_id", line.alias("line")).alias("r")).groupBy("domain").agg(F.array_sort(F.collect_list("r")).alias("r"))
    head = F.concat(F.lit("## "), F.initcap(F.replace("domain", F.lit("_"), F.lit(" "))))
    return g.select("domain", F.concat(head, F.lit("\n"), F.array_join(F.transform("r", lambda x: x["line"]), "\n")).alias("block"))


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_json(rows: DataFrame, path: str, options: dict[str, str] | None = None) -> None:
    """JSON lines; each row carries the schema version, and nulls are kept."""
    out = rows.select(F.lit(SCHEMA_VERSION).alias("schema_version"), *rows.columns)
    if options:
        out = out.withColumn("export_options", F.create_map(*[F.lit(x) for kv in sorted(options.items()) for x in kv]))
    out.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_markdown(rows: DataFrame, path: str) -> None:
    markdown_lines(rows).select("block").write.mode("overwrite").text(path)


def write_tables(tables: dict[str, DataFrame], path: str) -> None:
    """Each table as parquet under its name."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}.parquet")
