"""History of changing attributes (problem 6): periods by tree reduction.

Every version row is a unit interval.  Neighbouring runs of one entity with
equal payload are merged pairwise over logarithmic rounds: first inside blocks,
then the blocks of an entity are merged by their outer payloads in the same way.
Blocks are ranges of (entity, time) of about equal numbers of rows, so an entity
that holds a third of all rows is spread over a third of the tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.session import broadcast_if_small, cut_lineage, shuffle_width

_BLOCK = "entity string, block long, kind string, at long, row long, payload string, next_at long, second_at long, last_payload string"


def merge_runs(entity: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Which of the given runs start a merged one.

    A run has an entity, the payload it begins with and the one it ends with.  In
    each round every other run is merged with its right neighbour if that is of
    the same entity and goes on with the same payload; the next round pairs them
    the other way.  A stretch of equal runs halves with each round; it ends when
    neither pairing merges any."""
    lo = np.arange(len(entity))
    hi = lo.copy()
    side, idle = 0, 0
    while len(lo) > 1 and idle < 2:
        left = np.arange(side, len(lo) - 1, 2)
        right = left + 1
        same = (entity[hi[left]] == entity[lo[right]]) & (last[hi[left]] == first[lo[right]])
        if same.any():
            hi[left[same]] = hi[right[same]]
            keep = np.ones(len(lo), bool)
            keep[right[same]] = False
            lo, hi = lo[keep], hi[keep]
            idle = 0
        else:
            idle += 1
        side = 1 - side
    starts = np.zeros(len(entity), bool)
    starts[lo] = True
    return starts


def _reduce_blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by (entity, block, at): run rows and one edge row per block.

    Holds one batch and the open run of the block that reaches over its end."""
    now: dict | None = None  # the block not yet ended
    for b in batches:
        if not len(b):
            continue
        ent = (b["entity"] + "\x00" + b["block"].astype(str)).to_numpy(object)
        pay = b["payload"].to_numpy(object)
        at, row = b["at"].to_numpy(np.int64), b["row"].to_numpy(np.int64)
        starts = merge_runs(ent, pay, pay)
        if now is not None and now["ent"] == ent[0] and now["last"] == pay[0]:
            starts[0] = False
        head = np.ones(len(ent), bool)
        head[1:] = ent[1:] != ent[:-1]
        if now is not None and now["ent"] == ent[0]:
            head[0] = False
        out: list[tuple] = []

        def close(now: dict) -> None:
            e, k = now["entity"], now["block"]
            out.append((e, k, "first" if now["first"] else "run", now["at"], now["row"], now["payload"], None, None, None))
            out.append((e, k, "edge", now["first_at"], None, now["first_payload"], None, now["second"], now["last"]))

        marks = np.flatnonzero(starts | head)
        ends = np.append(marks[1:], len(ent)) - 1
        if len(marks) == 0 or marks[0] > 0:
            now["last"] = pay[(marks[0] if len(marks) else len(ent)) - 1]
        entity, block = b["entity"].to_numpy(object), b["block"].to_numpy(np.int64)
        for i, e in zip(marks, ends):
            if head[i]:
                if now is not None:
                    close(now)
                now = {"ent": ent[i], "entity": entity[i], "block": int(block[i]), "first": True, "first_at": int(at[i]), "first_payload": pay[i], "second": None}
            else:
                out.append((now["entity"], now["block"], "first" if now["first"] else "run", now["at"], now["row"], now["payload"], int(at[i]), None, None))
                if now["first"]:
                    now["second"] = int(at[i])
                now["first"] = False
            now |= {"at": int(at[i]), "row": int(row[i]), "payload": pay[i], "last": pay[e]}
        if out:
            yield _frame(out)
    if now is not None:
        out = []
        close_last = now
        out.append((now["entity"], now["block"], "first" if now["first"] else "run", now["at"], now["row"], now["payload"], None, None, None))
        out.append((now["entity"], now["block"], "edge", close_last["first_at"], None, now["first_payload"], None, now["second"], now["last"]))
        yield _frame(out)


def _frame(out: list[tuple]) -> pd.DataFrame:
    d = pd.DataFrame(out, columns=["entity", "block", "kind", "at", "row", "payload", "next_at", "second_at", "last_payload"])
    return d.astype({"row": "Int64", "next_at": "Int64", "second_at": "Int64"})


def _merge_blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(entity, blocks[]) -> (entity, block, goes_on, after): whether a block's
    first run belongs to the one before it, and the next start after the block."""
    for b in batches:
        out: list[tuple] = []
        for entity, blocks in zip(b["entity"], b["blocks"]):
            blocks = sorted(blocks, key=lambda x: x["block"])
            text = lambda k: np.array([x[k] for x in blocks], object)
            starts = merge_runs(np.zeros(len(blocks), np.int64), text("payload"), text("last_payload"))
            after = None
            for x, begins in zip(reversed(blocks), reversed(starts)):
                out.append((entity, x["block"], not begins, after))
                after = x["at"] if begins else x["second_at"] if x["second_at"] is not None else after
        yield pd.DataFrame(out, columns=["entity", "block", "goes_on", "after"]).astype({"after": "Int64"})


def periods(units: DataFrame) -> DataFrame:
    """(entity, row, at, next_at) of every period.

    units(entity, at, row, payload): one row per entity and instant `at`
    (microseconds); equal payload strings are equal attributes.  next_at is the
    start of the next period, null for the last one.  Only entities that reach
    over the border of two ranges have more than one block, so there are at most
    as many of these as ranges, and their blocks fit a small table."""
    blocks = (
        units.repartitionByRange(shuffle_width(units.sparkSession), "entity", "at")
        .withColumn("block", F.spark_partition_id().cast("long"))
        .sortWithinPartitions("entity", "block", "at")
        .select("entity", "block", "at", "row", "payload")
        .mapInPandas(_reduce_blocks, _BLOCK)
    )
    blocks = cut_lineage(blocks)
    edges = blocks.where("kind = 'edge'").groupBy("entity").agg(F.count("*").alias("n"), F.collect_list(F.struct("block", "at", "payload", "second_at", "last_payload")).alias("blocks"))
    over = edges.where("n > 1").select("entity", "blocks").mapInPandas(_merge_blocks, "entity string, block long, goes_on boolean, after long")
    runs = blocks.where("kind <> 'edge'").join(broadcast_if_small(over), ["entity", "block"], "left")
    runs = runs.where(~((F.col("kind") == "first") & F.coalesce("goes_on", F.lit(False))))
    return runs.select("entity", "row", "at", F.coalesce("next_at", "after").alias("next_at"))


def version_units(versions: DataFrame, attributes: tuple[str, ...]) -> DataFrame:
    """Unit intervals of versions: of rows with one version_id the last checked
    (null first, then the greater id), of rows of a skill at one instant the
    greatest id.  Rows without skill_id, or without any time, never take effect.
    Rows with a null version_id are versions of their own."""
    flat = F.concat(*[F.concat(F.when(F.col(a).isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), F.length(a).cast("string"), F.lit(":"), F.col(a))), F.lit("|")) for a in attributes])
    v = versions.select(
        "id",
        "skill_id",
        "imported_at",
        "last_checked_at",
        F.coalesce(F.concat(F.lit("v"), "version_id"), F.concat(F.lit("i"), F.col("id").cast("string"))).alias("vkey"),
        F.md5(flat).alias("payload"),
    )
    one = v.groupBy("vkey").agg(F.max(F.struct("last_checked_at", "id", "skill_id", "imported_at", "payload")).alias("r")).select("r.*")
    us = F.unix_micros(F.coalesce("imported_at", "last_checked_at").cast("timestamp"))
    one = one.select(F.col("skill_id").alias("entity"), us.alias("at"), F.struct("id", "payload").alias("p")).where(F.col("entity").isNotNull() & F.col("at").isNotNull())
    return one.groupBy("entity", "at").agg(F.max("p").alias("p")).select("entity", "at", F.col("p.id").alias("row"), "p.payload")


def skill_history(versions: DataFrame, skills: DataFrame, attributes: tuple[str, ...] = ("name", "summary", "domain_primary")) -> DataFrame:
    """(skill_id, version_row, valid_from, valid_to), times as text.

    The last period of a skill is `open` if the skill's latest row (by
    last_updated_at; null first, then the true one) is current, else it ends at
    the later of its start and the skill's greatest last_checked_at."""
    p = periods(version_units(versions, attributes))
    seen = versions.where(F.col("skill_id").isNotNull()).groupBy(F.col("skill_id").alias("entity")).agg(F.max(F.unix_micros(F.col("last_checked_at").cast("timestamp"))).alias("seen"))
    cur = skills.where(F.col("id").isNotNull()).groupBy(F.col("id").alias("entity")).agg(F.max(F.struct("last_updated_at", F.coalesce("is_current", F.lit(False)).alias("c"))).alias("r")).select("entity", F.col("r.c").alias("current"))
    text = lambda us: F.date_format(F.timestamp_micros(us), "yyyy-MM-dd HH:mm:ss")
    last = F.when(F.coalesce("current", F.lit(False)), F.lit("open")).otherwise(text(F.greatest("at", "seen")))
    return (
        p.join(seen, "entity", "left")
        .join(cur, "entity", "left")
        .select(F.col("entity").alias("skill_id"), F.col("row").alias("version_row"), text(F.col("at")).alias("valid_from"), F.coalesce(text(F.col("next_at")), last).alias("valid_to"))
    )
