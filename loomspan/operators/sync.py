"""Incremental sync: changes by field, the state after them, histories (SY-*)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def detect_changes(existing: DataFrame, incoming: DataFrame, key: str, fields: dict[str, str]) -> DataFrame:
    """(key, change, field, old_value, new_value) of one full outer join.

    fields maps a column to the change that a difference in it means, such as
    {"hash": "MODIFIED", "path": "MOVED"}; ADDED and REMOVED have no field.
    Values are compared null-safe; both sides have one row per key."""
    e = existing.select(F.col(key).alias("k"), F.lit(True).alias("old"), *[F.col(c).cast("string").alias(f"o_{c}") for c in fields])
    i = incoming.select(F.col(key).alias("k"), F.lit(True).alias("new"), *[F.col(c).cast("string").alias(f"n_{c}") for c in fields])
    j = e.join(i, "k", "full_outer")
    none = F.lit(None).cast("string")

    def rec(change: Column, field: Column, a: Column, b: Column) -> Column:
        return F.struct(change.alias("change"), field.alias("field"), a.alias("old_value"), b.alias("new_value"))

    both = F.col("old").isNotNull() & F.col("new").isNotNull()
    each = [
        F.when(F.col("old").isNull(), rec(F.lit("ADDED"), none, none, none)),
        F.when(F.col("new").isNull(), rec(F.lit("REMOVED"), none, none, none)),
        *[F.when(both & ~F.col(f"o_{c}").eqNullSafe(F.col(f"n_{c}")), rec(F.lit(kind), F.lit(c), F.col(f"o_{c}"), F.col(f"n_{c}"))) for c, kind in fields.items()],
    ]
    return j.select(F.col("k").alias(key), F.explode(F.array_compact(F.array(*each))).alias("r")).select(key, "r.*")


def change_counts(changes: DataFrame, existing: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """(change, n) with UNCHANGED: keys on both sides without a change."""
    n = changes.groupBy("change").agg(F.count_distinct(key).alias("n"))
    same = existing.select(key).join(incoming.select(key), key, "left_semi").join(changes.select(key), key, "left_anti")
    return n.unionByName(same.agg(F.count("*").alias("n")).select(F.lit("UNCHANGED").alias("change"), "n"))


def apply_changes(existing: DataFrame, incoming: DataFrame, changes: DataFrame, key: str, version: str) -> DataFrame:
    """The table after a sync: new and changed rows from `incoming` (a changed one
    with its version number raised), removed ones kept and archived."""
    per = changes.groupBy(key).agg(F.bool_or(F.col("change") == "REMOVED").alias("gone"), F.bool_or(F.col("change") == "ADDED").alias("fresh"))
    cols = [c for c in incoming.columns if c != key]
    e = existing.select(key, version, *[F.col(c).alias(f"o_{c}") for c in cols])
    j = e.join(incoming, key, "full_outer").join(per, key, "left")
    touched = F.col("gone").isNotNull() & ~F.col("gone")
    return j.select(
        key,
        *[F.when(touched, F.col(c)).otherwise(F.col(f"o_{c}")).alias(c) for c in cols],
        (F.coalesce(version, F.lit(0)) + touched.cast("int")).alias(version),
        F.when(F.coalesce("gone", F.lit(False)), "archived").otherwise("active").alias("lifecycle"),
    )


def sync_history(log: DataFrame, most: int | None = None) -> DataFrame:
    """(sync_id, started, total, counts map) of each sync, the newest first."""
    kind = F.upper(F.trim(F.col("change_type")))
    per = log.where("sync_id IS NOT NULL").groupBy("sync_id", kind.alias("kind")).agg(F.count("*").alias("n"), F.min("created_at").alias("at"))
    h = per.groupBy("sync_id").agg(F.min("at").alias("started"), F.sum("n").alias("total"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", "n")))).alias("counts"))
    return h if most is None else h.orderBy(F.desc("started"), "sync_id").limit(most)


def entity_history(log: DataFrame, entity: str) -> DataFrame:
    return log.where(F.col("entity_id") == entity).orderBy(F.desc("created_at"), F.desc("id"))
