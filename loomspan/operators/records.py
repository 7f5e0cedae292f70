"""Registry records: latest rows, child rows, the flat catalogue (JN-*, WN-*)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspan.functions.text import json_text


def latest_by(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The greatest row of each key by `order` (nulls least), as one aggregate
    that is combined before the shuffle instead of a window sort."""
    rest = [c for c in df.columns if c not in order and c not in keys]
    g = df.where(" AND ".join(f"`{k}` IS NOT NULL" for k in keys)).groupBy(*keys).agg(F.max(F.struct(*order, *rest)).alias("r"))
    return g.select(*keys, *[F.col(f"r.{c}").alias(c) for c in df.columns if c not in keys])


def current_skills(skills: DataFrame) -> DataFrame:
    """One row per skill: the one updated last."""
    return latest_by(skills, ["id"], ["last_updated_at", "is_current"])


def current_versions(versions: DataFrame) -> DataFrame:
    """One row per skill: the version imported last, then the greatest id."""
    return latest_by(versions, ["skill_id"], ["imported_at", "id"])


def live(skills: DataFrame) -> DataFrame:
    """Not archived; a null lifecycle is left out."""
    return skills.where("lifecycle <> 'archived'")


def children(df: DataFrame, value: str, out: str, most: int | None = None) -> DataFrame:
    """(version, out[]): sorted distinct values of each version, the first `most`."""
    a = F.array_sort(F.collect_set(value))
    g = df.where(f"version_id_fk IS NOT NULL AND {value} IS NOT NULL").groupBy(F.col("version_id_fk").alias("version")).agg(a.alias(out))
    return g if most is None else g.withColumn(out, F.slice(out, 1, most))


def numbered(df: DataFrame, key: str, order: list[Column], out: str = "n", block: Column | None = None) -> DataFrame:
    """Rows of each key numbered from 1 in the given order.

    With `block`, a whole number that does not fall along the order (such as the
    quarter of a time; null is least), rows are numbered inside (key, block) and
    shifted by the rows of the earlier blocks, so one key is spread over as many
    tasks as it has blocks."""
    if block is None:
        return df.withColumn(out, F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    b = df.withColumn("__block", F.coalesce(block.cast("long"), F.lit(-(2**62))))
    before = Window.partitionBy("__key").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = b.groupBy(F.col(key).alias("__key"), "__block").agg(F.count("*").alias("__n"))
    sizes = sizes.select("__key", F.col("__block").alias("__b"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    inside = F.row_number().over(Window.partitionBy(key, "__block").orderBy(*order))
    j = b.withColumn("__i", inside).join(sizes, F.col(key).eqNullSafe(F.col("__key")) & (F.col("__block") == F.col("__b")))
    return j.withColumn(out, (F.col("__i") + F.col("__before")).cast("int")).drop("__block", "__key", "__b", "__before", "__i")


def category_of(path: Column | str) -> Column:
    """The part of a taxonomy path before its first `.` or `/`."""
    return F.regexp_extract(path if isinstance(path, Column) else F.col(path), r"^([^./]*)", 1)


def risk_of(security: Column | str) -> Column:
    """The risk level of the security JSON, UNKNOWN if there is none."""
    return F.coalesce(F.upper(json_text(security, "$.risk_level")), F.lit("UNKNOWN"))
