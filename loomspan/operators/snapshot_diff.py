"""What changed between consecutive full snapshots (problem 4).

Compact arrays first, values second.  Every record is reduced to a 64-bit key
and two 64-bit row hashes (content, path); the records are spread over hash
buckets of the key, and inside a bucket each delivery is one sorted numpy array,
so that two deliveries are compared by ``searchsorted`` set differences.  Only
keys that may differ leave the buckets; the full values are fetched for those
alone and decide exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspan.session import shuffle_width


#: Rows of a bucket whose arrays one task holds (25 bytes each), and deliveries that
#: the driver may list.
BUCKET_ROWS, MOST_DELIVERIES = 4_000_000, 10_000


def plain_hash(c: Column | str) -> Column:
    """A content hash without letter case, blanks around it and the name of the
    hash function in front; an empty one is null."""
    c = F.col(c) if isinstance(c, str) else c
    bare = F.regexp_replace(F.lower(c), r"^\s+|\s+$", "")
    bare = F.regexp_replace(F.regexp_replace(bare, r"^[a-z][a-z0-9_/-]*[:=]\s*", ""), r"\s+", "")
    return F.when(bare != "", bare)


def plain_commit(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    bare = F.regexp_replace(F.lower(c), r"\s+", "")
    return F.when(bare != "", bare)


def latest_records(snapshots: DataFrame) -> DataFrame:
    """One record per (snapshot_no, skill_id): the one loaded last.

    A null loaded_at is the earliest.  Of rows loaded at the same instant the
    greatest (hash, commit, path) counts, so the result does not depend on the
    order of rows.  Rows without snapshot_no or skill_id name no record and are
    left out.  A max over a struct is combined before the shuffle, so a key that
    holds a third of all rows costs no more than any other."""
    return (
        snapshots.where(F.col("snapshot_no").isNotNull() & F.col("skill_id").isNotNull())
        .groupBy("snapshot_no", "skill_id")
        .agg(
            F.max(
                F.struct(
                    "loaded_at",
                    plain_hash("source_content_hash").alias("hash"),
                    plain_commit("source_commit_sha").alias("sha"),
                    F.col("source_path").alias("path"),
                )
            ).alias("r")
        )
        .select("snapshot_no", "skill_id", "r.hash", "r.sha", "r.path")
    )


def _suspects(delivered: list[int]):
    """Per partition: the (later snapshot, key) pairs whose records may differ."""
    pairs = [(n, n + 1) for n in delivered if n + 1 in set(delivered)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts: dict[int, list[pd.DataFrame]] = {}
        for b in batches:
            for no, g in b.groupby("snapshot_no"):
                parts.setdefault(int(no), []).append(g[["key", "content", "place", "sure"]])
        arrays = {}
        for no, gs in parts.items():
            g = pd.concat(gs) if len(gs) > 1 else gs[0]
            order = np.argsort(g["key"].to_numpy(), kind="stable")
            key = g["key"].to_numpy()[order]
            twice = np.zeros(len(key), bool)
            if len(key) > 1:
                same = key[1:] == key[:-1]
                twice[1:] |= same
                twice[:-1] |= same
            arrays[no] = (key, g["content"].to_numpy()[order], g["place"].to_numpy()[order], g["sure"].to_numpy()[order] & ~twice)
        none = np.zeros(0, np.int64)
        empty = (none, none, none, np.zeros(0, bool))
        for a, b in pairs:
            k0, c0, p0, s0 = arrays.get(a, empty)
            k1, c1, p1, s1 = arrays.get(b, empty)
            at = np.searchsorted(k0, k1)
            hit = at < len(k0)
            hit[hit] = k0[at[hit]] == k1[hit]
            back = np.searchsorted(k1, k0)
            gone = back >= len(k1)
            gone[~gone] = k1[back[~gone]] != k0[~gone]
            i, j = at[hit], np.flatnonzero(hit)
            differs = (c0[i] != c1[j]) | (p0[i] != p1[j]) | ~s0[i] | ~s1[j]
            keys = np.concatenate([k1[~hit], k0[gone], k1[j[differs]]])
            if len(keys):
                yield pd.DataFrame({"later": np.full(len(keys), b, np.int32), "key": np.unique(keys) if len(np.unique(keys)) == len(keys) else keys})

    return run


def snapshot_changes(snapshots: DataFrame) -> DataFrame:
    """(snapshot_no, skill_id, change_type, sync_id, old_hash, old_path): ADDED,
    REMOVED, MODIFIED and MOVED between snapshot_no - 1 and snapshot_no.

    Deliveries are compared where both numbers were delivered at all; an empty
    table gives no rows.  If a hash is missing on either side the content counts
    as changed unless one commit is a leading part of the other."""
    spark = snapshots.sparkSession
    # used twice with the same columns, so Spark shuffles and combines the rows once
    rec = latest_records(snapshots).withColumn("key", F.xxhash64("skill_id"))
    # one number per delivery, not per row
    delivered = sorted(r[0] for r in snapshots.select("snapshot_no").where("snapshot_no IS NOT NULL").distinct().limit(MOST_DELIVERIES + 1).collect())
    if len(delivered) > MOST_DELIVERIES:
        raise ValueError(f"more than {MOST_DELIVERIES} deliveries")
    buckets = max(shuffle_width(spark), -(-snapshots.count() // BUCKET_ROWS))
    compact = rec.select(
        "snapshot_no",
        "key",
        F.xxhash64(F.coalesce("hash", F.lit(""))).alias("content"),
        F.xxhash64(F.coalesce("path", F.lit("")), F.col("path").isNull()).alias("place"),
        F.col("hash").isNotNull().alias("sure"),
    ).repartition(buckets, "key")
    suspects = compact.mapInPandas(_suspects(delivered), "later int, key long").distinct()
    # full values of the suspects only, once as the earlier and once as the later record
    both = suspects.select("later", "key", F.explode(F.array(F.col("later") - 1, F.col("later"))).alias("snapshot_no"))
    side = rec.join(both, ["snapshot_no", "key"])
    new = F.col("snapshot_no") == F.col("later")
    pair = side.groupBy("later", "skill_id").agg(
        F.max(F.when(new, F.struct("hash", "sha", "path"))).alias("b"),
        F.max(F.when(~new, F.struct("hash", "sha", "path"))).alias("a"),
    )
    kin = F.coalesce(F.startswith(F.col("a.sha"), F.col("b.sha")) | F.startswith(F.col("b.sha"), F.col("a.sha")), F.lit(False))
    unknown = F.col("a.hash").isNull() | F.col("b.hash").isNull()
    here, there = F.col("b").isNotNull(), F.col("a").isNotNull()
    kinds = F.array_compact(
        F.array(
            F.when(here & ~there, F.lit("ADDED")),
            F.when(~here & there, F.lit("REMOVED")),
            F.when(here & there & F.when(unknown, ~kin).otherwise(F.col("a.hash") != F.col("b.hash")), F.lit("MODIFIED")),
            F.when(here & there & ~F.col("a.path").eqNullSafe(F.col("b.path")), F.lit("MOVED")),
        )
    )
    # sync_id belongs to the delivery; a removed record has none of its own
    syncs = snapshots.where(F.col("snapshot_no").isNotNull()).groupBy(F.col("snapshot_no").alias("later")).agg(F.max("sync_id").alias("sync_id"))
    return (
        pair.select("later", "skill_id", F.explode(kinds).alias("change_type"), F.col("a.hash").alias("old_hash"), F.col("a.path").alias("old_path"))
        .join(syncs, "later", "left")
        .withColumnRenamed("later", "snapshot_no")
    )


def logged_changes(changes: DataFrame, changelog: DataFrame) -> DataFrame:
    """Adds `logged`: 1 if the change log has the change with its earlier value."""
    log = (
        changelog.select(
            "sync_id",
            F.col("entity_id").alias("skill_id"),
            F.upper(F.regexp_replace("change_type", r"^\s+|\s+$", "")).alias("change_type"),
            "old_value",
        )
        .where(F.col("change_type").isin("ADDED", "REMOVED", "MODIFIED", "MOVED"))
        .withColumn(
            "was",
            F.when(F.col("change_type") == "MODIFIED", plain_hash("old_value")).when(F.col("change_type") == "MOVED", F.col("old_value")),
        )
        .select("sync_id", "skill_id", "change_type", "was")
        .distinct()
        .withColumn("in_log", F.lit(1))
    )
    was = F.when(F.col("change_type") == "MODIFIED", F.col("old_hash")).when(F.col("change_type") == "MOVED", F.col("old_path"))
    c = changes.withColumn("was", was).alias("c")
    log = log.alias("l")
    on = [F.col(f"c.{k}") == F.col(f"l.{k}") for k in ("sync_id", "skill_id", "change_type")] + [F.col("c.was").eqNullSafe(F.col("l.was"))]
    return c.join(log, on, "left").select("c.snapshot_no", "c.skill_id", "c.change_type", F.coalesce("l.in_log", F.lit(0)).cast("int").alias("logged"))
