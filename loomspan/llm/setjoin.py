"""All similar pairs of set-valued records (problem 2): size-aware overlap join.

A Jaccard threshold fixes, for each pair of sizes (n, m), the overlap t that is
needed.  Where the t-subsets of both sizes are few, two sets are similar exactly
if they share one, so the subsets are enumerated as hash keys and joined.  Where
they are many, the larger set is a candidate by the inverted lists of its rarest
tokens.  Candidates of both ways are united and checked by their true overlap.
Records with equal sets are joined as one class.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspan.session import broadcast_if_small, cut_lineage


#: A set with more copies than this is split over so many tasks.
HOT, SALTS = 10_000, 64


def plain_value(c: str | Column) -> Column:
    """Trimmed, lower case, runs of blanks, `_` and `-` as one `-`; null if empty."""
    c = F.col(c) if isinstance(c, str) else c
    v = F.regexp_replace(F.lower(F.regexp_replace(c, r"^\s+|\s+$", "")), r"[\s_-]+", "-")
    return F.when(v != "", v)


def record_sets(parts: list[tuple[DataFrame, str, str]], least: int) -> DataFrame:
    """(id, tokens): the distinct values of each record over several tables
    (table, id column, value column); values of different tables never meet.
    Null ids and values do not count; sets of fewer than `least` are left out."""
    rows = None
    for no, (df, key, value) in enumerate(parts):
        r = df.select(df[key].cast("long").alias("id"), plain_value(df[value]).alias("v")).where("id IS NOT NULL AND v IS NOT NULL")
        r = r.select("id", F.concat(F.lit(f"{no}:"), "v").alias("v"))
        rows = r if rows is None else rows.unionByName(r)
    sets = rows.distinct().groupBy("id").agg(F.array_sort(F.collect_list("v")).alias("tokens"))
    return sets.where(F.size("tokens") >= least)


def need(n: int, m: int, threshold: float) -> int:
    """Overlap from which sets of n and m values reach the Jaccard threshold."""
    return max(1, math.ceil(threshold * (n + m) / (1 + threshold) - 1e-9))


def partners(n: int, threshold: float, least: int) -> range:
    return range(max(least, math.ceil(threshold * n - 1e-9)), math.floor(n / threshold + 1e-9) + 1)


def enumerates(n: int, m: int, threshold: float, budget: int) -> bool:
    t = need(n, m, threshold)
    return math.comb(n, t) <= budget and math.comb(m, t) <= budget


def _mix(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _subset_keys(threshold: float, least: int, budget: int):
    """Keys of all threshold-sized subsets, a size pair at a time, vectorised
    over the sets of equal size."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            size = b["hashes"].map(len).to_numpy()
            for n in np.unique(size):
                n = int(n)
                at = np.flatnonzero(size == n)
                cls = b["cls"].to_numpy(np.int64)[at]
                tok = _mix(np.array([b["hashes"].iat[i] for i in at], np.int64))
                for m in partners(n, threshold, least):
                    if not enumerates(n, m, threshold, budget):
                        continue
                    t = need(n, m, threshold)
                    pick = np.array(list(combinations(range(n), t)))
                    seed = np.uint64((min(n, m) * 1_000_003 + max(n, m)) & 0xFFFFFFFF)
                    for lo in range(0, len(at), max(1, 2_000_000 // (len(pick) * t))):
                        part = slice(lo, lo + max(1, 2_000_000 // (len(pick) * t)))
                        key = _mix(tok[part][:, pick].sum(axis=2, dtype=np.uint64) + _mix(np.array([seed]))).astype(np.int64)
                        yield pd.DataFrame({"key": key.ravel(), "cls": np.repeat(cls[part], len(pick)), "n": np.int32(n), "m": np.int32(m)})

    return run


def similar_classes(sets: DataFrame, threshold: float = 0.7, least: int = 4, budget: int = 300) -> tuple[DataFrame, DataFrame]:
    """(members(id, cls), links(cls_a, cls_b)): records by equal set, and the
    pairs of different sets that reach the threshold (cls_a < cls_b)."""
    members = cut_lineage(_classes(sets))
    reps = members.where("id = cls").select("cls", "tokens", F.size("tokens").alias("n"), F.transform("tokens", lambda v: F.xxhash64(v)).alias("hashes"))
    # small sets: shared threshold-sized subsets
    keys = reps.select("cls", "hashes").mapInPandas(_subset_keys(threshold, least, budget), "key long, cls long, n int, m int")
    small = keys.where("n <= m").alias("a").join(
        keys.where("m <= n").alias("b"),
        (F.col("a.key") == F.col("b.key")) & (F.col("a.n") == F.col("b.m")) & (F.col("a.m") == F.col("b.n")) & ((F.col("a.n") < F.col("a.m")) | (F.col("a.cls") < F.col("b.cls"))),
    ).select(F.least("a.cls", "b.cls").alias("x"), F.greatest("a.cls", "b.cls").alias("y"))
    found = small.union(_large(reps, threshold, least, budget)).distinct()
    a = reps.select(F.col("cls").alias("x"), F.col("tokens").alias("ta"))
    b = reps.select(F.col("cls").alias("y"), F.col("tokens").alias("tb"))
    over = F.size(F.array_intersect("ta", "tb"))
    links = found.join(a, "x").join(b, "y").where(over >= F.lit(threshold) * (F.size("ta") + F.size("tb") - over) - F.lit(1e-9))
    return members.select("id", "cls"), links.select(F.col("x").alias("cls_a"), F.col("y").alias("cls_b"))


def _classes(sets: DataFrame) -> DataFrame:
    """Each set's class: the least id with the same set.

    The least id is combined before the shuffle.  It is joined back with one row
    for each set, so the rows of a set that a third of the records share are
    spread by a salt over many tasks, and its one row goes to each of them."""
    keyed = cut_lineage(sets.withColumn("same", F.md5(F.to_json("tokens"))))
    first = keyed.groupBy("same").agg(F.min("id").alias("cls"), F.count("*").alias("copies"))
    salts = F.when(F.col("copies") > HOT, F.lit(SALTS)).otherwise(F.lit(1))
    hot = first.where(F.col("copies") > HOT).select("same", F.lit(SALTS).alias("salts"))  # few: each has many rows
    spread = keyed.join(broadcast_if_small(hot), "same", "left").withColumn("salt", F.pmod(F.xxhash64("id"), F.coalesce("salts", F.lit(1))).cast("int"))
    first = first.withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).select("same", "salt", "cls")
    return spread.join(first, ["same", "salt"]).select("id", "cls", "tokens")


def _large(reps: DataFrame, threshold: float, least: int, budget: int) -> DataFrame:
    """Candidates for the size pairs with too many subsets: inverted lists of the
    rarest tokens.  Two sets of n and m values that share t have one of the
    n - t + 1 rarest of the one among the m - t + 1 rarest of the other."""
    # the sizes that have a partner with too many subsets; beyond the first few
    # every size has, unless only equal sets are similar
    many = next((n for n in range(least, least + 1000) if any(not enumerates(n, m, threshold, budget) for m in partners(n, threshold, least))), None)
    if many is None:
        return reps.where("false").select(F.col("cls").alias("x"), F.col("cls").alias("y"))
    big = reps.where(F.col("n") >= many)
    tok = big.select("cls", "n", F.explode("hashes").alias("h"))
    freq = tok.groupBy("h").agg(F.count("*").alias("f"))
    ranked = tok.join(freq, "h").groupBy("cls", "n").agg(F.array_sort(F.collect_list(F.struct("f", "h"))).alias("r"))
    # prefix for the smallest possible overlap with any partner
    least_need = F.ceil(F.lit(threshold) * F.col("n") - F.lit(1e-9)).cast("int")
    pre = ranked.select("cls", "n", F.explode(F.transform(F.slice("r", F.lit(1), F.col("n") - least_need + 1), lambda s: s["h"])).alias("h"))
    a, b = pre.alias("a"), pre.alias("b")
    near = (F.col("b.n") >= F.lit(threshold) * F.col("a.n") - F.lit(1e-9)) & (F.col("a.n") >= F.lit(threshold) * F.col("b.n") - F.lit(1e-9))
    return a.join(b, (F.col("a.h") == F.col("b.h")) & (F.col("a.cls") < F.col("b.cls")) & near).select(F.col("a.cls").alias("x"), F.col("b.cls").alias("y"))


def similar_pairs(sets: DataFrame, threshold: float = 0.7, least: int = 4) -> DataFrame:
    """(a, b), a < b: all pairs of records, copies expanded."""
    members, links = similar_classes(sets, threshold, least)
    m = members
    same = m.alias("p").join(m.alias("q"), (F.col("p.cls") == F.col("q.cls")) & (F.col("p.id") < F.col("q.id"))).select(F.col("p.id").alias("a"), F.col("q.id").alias("b"))
    across = (
        links.join(m.select(F.col("cls").alias("cls_a"), F.col("id").alias("i")), "cls_a")
        .join(m.select(F.col("cls").alias("cls_b"), F.col("id").alias("j")), "cls_b")
        .select(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b"))
    )
    return same.union(across)
