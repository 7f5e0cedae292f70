"""Canonical names by a reference list given as a table (TX-*, JN-12, JN-13)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomspan.functions.text import label_key
from loomspan.session import broadcast_if_small


def aliases(reference: DataFrame) -> DataFrame:
    """(rank, key, canonical, taxonomy_path): spellings in order; of equal keys
    the first counts.  The canonical name is a spelling of its entry too."""
    every = F.concat(F.array(F.col("canonical")), F.coalesce(F.col("aliases"), F.array().cast("array<string>")))
    a = reference.where("canonical IS NOT NULL").select("ref_id", "canonical", "taxonomy_path", F.posexplode(every).alias("pos", "alias"))
    a = a.select((F.col("ref_id") * 1000 + F.col("pos")).cast("long").alias("rank"), label_key("alias").alias("key"), "canonical", "taxonomy_path").where("key <> ''")
    return a.groupBy("key").agg(F.min(F.struct("rank", "canonical", "taxonomy_path")).alias("m")).select("m.rank", "key", "m.canonical", "m.taxonomy_path")


def classify(names: DataFrame, reference: DataFrame) -> DataFrame:
    """(name, canonical, taxonomy_path, how) of each distinct name: `exact` on the
    key, else `fuzzy` where one contains the other (spellings of four letters or
    more, least rank), else `none` with path uncategorized/<clean>.

    Only distinct names without an exact hit are compared with the spellings; the
    nested loop has the reference, of checked size, on its broadcast side."""
    a = broadcast_if_small(aliases(reference))
    n = names.select("name").where("name IS NOT NULL").distinct().withColumn("key", label_key("name"))
    exact = n.join(a, "key").select("name", "canonical", "taxonomy_path", F.lit("exact").alias("how"))
    rest = n.join(a.select("key"), "key", "left_anti").where("key <> ''")
    near = a.where(F.length("key") >= 4).select("rank", F.col("key").alias("alias"), "canonical", "taxonomy_path")
    hit = rest.join(near, F.contains(F.col("key"), F.col("alias")) | F.contains(F.col("alias"), F.col("key")))
    fuzzy = hit.groupBy("name").agg(F.min(F.struct("rank", "canonical", "taxonomy_path")).alias("m")).select("name", "m.canonical", "m.taxonomy_path", F.lit("fuzzy").alias("how"))
    done = exact.unionByName(fuzzy)
    clean = F.regexp_replace(F.regexp_replace(F.lower(F.trim("name")), r"[^a-z0-9_]", "_"), r"^_+|_+$", "")
    clean = F.when(clean == "", "unknown").otherwise(clean)
    none = n.join(done.select("name"), "name", "left_anti").select("name", clean.alias("canonical"), F.concat(F.lit("uncategorized/"), clean).alias("taxonomy_path"), F.lit("none").alias("how"))
    return done.unionByName(none)


def ordered_distinct(rows: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """The first row of each (key, value), numbered in the order of `order`."""
    first = rows.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.min(order).alias(order))
    return first.withColumn("n", F.row_number().over(Window.partitionBy(key).orderBy(order)))
