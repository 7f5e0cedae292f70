"""Dependency graphs: edges, closure, cycles, conflicts (DP-9..13)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.session import cut_lineage


def resolve(deps: DataFrame, records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges(src, dst), external(src, name)) of deps(src, name): an edge where
    the name is a record's name (lower case), else the dependency is external."""
    r = records.select(F.col("id").alias("dst"), F.lower("name").alias("key")).where("key IS NOT NULL").distinct()
    d = deps.select("src", "name", F.lower("name").alias("key")).distinct()
    edges = d.join(r, "key").where("src <> dst").select("src", "dst").distinct()
    external = d.join(r, "key", "left_anti").select("src", "name").where("name IS NOT NULL")
    return edges, external


def closure(edges: DataFrame) -> DataFrame:
    """(src, dst, depth): all pairs with a path, by its least length.

    Rounds of doubling: pairs with paths of up to n steps are joined with one
    another, which gives those of up to 2n, so a path of any length takes its
    logarithm in rounds and there is no limit.  Each round is checkpointed to the
    shared folder, so the plan does not grow and a lost executor costs a round at
    most.  It ends when a round finds no new pair; lengths are least lengths
    already, as every path of up to 2n steps has a middle within n of its ends."""
    known = cut_lineage(edges.where("src IS NOT NULL AND dst IS NOT NULL").select("src", "dst").distinct().withColumn("depth", F.lit(1)))
    size = known.count()
    while size:
        a, b = known.alias("a"), known.alias("b")
        longer = a.join(b, F.col("a.dst") == F.col("b.src")).select(F.col("a.src").alias("src"), F.col("b.dst").alias("dst"), (F.col("a.depth") + F.col("b.depth")).alias("depth"))
        known = cut_lineage(known.unionByName(longer).groupBy("src", "dst").agg(F.min("depth").alias("depth")))
        before, size = size, known.count()
        if size == before:
            break
    return known


def cycles(reach: DataFrame) -> DataFrame:
    """(cycle, node): nodes that reach one another, by the cycle's least node."""
    a, b = reach.alias("a"), reach.alias("b")
    both = a.join(b, (F.col("a.src") == F.col("b.dst")) & (F.col("a.dst") == F.col("b.src")))
    return both.groupBy(F.col("a.src").alias("node")).agg(F.min(F.least("a.src", "a.dst")).alias("cycle")).select("cycle", "node")


def conflicts(deps: DataFrame, key: str, value: str) -> DataFrame:
    """Names that are wanted with different values."""
    g = deps.where(F.col(value).isNotNull()).groupBy(key).agg(F.array_sort(F.collect_set(value)).alias("wanted"))
    return g.where(F.size("wanted") > 1)


def graph_stats(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    e = edges.agg(F.count("*").alias("edges"), F.count_distinct("src").alias("with_dependencies"), F.count_distinct("dst").alias("depended_on"))
    return nodes.agg(F.count_distinct("id").alias("nodes")).crossJoin(e)
