"""Data quality and coverage (AN-*, AG-*): one scan for each table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def coverage(df: DataFrame, measures: dict[str, Column], total: DataFrame) -> DataFrame:
    """(measure, n, pct) of all measures from one aggregate; pct of total's one
    value `total`."""
    one = df.agg(*[F.count_if(c).alias(m) for m, c in measures.items()])
    rows = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).alias("n")) for m in measures]))
    r = one.select(rows.alias("r")).select("r.*").crossJoin(total)
    return r.select("measure", "n", F.round(F.when(F.col("total") > 0, F.col("n") * 100.0 / F.col("total")).otherwise(0.0), 1).alias("pct"))


def order_stats(df: DataFrame, score: str) -> DataFrame:
    """min, p25, median, p75, max as the values at places 0, n//4, n//2, 3n//4 and
    n-1 of the ascending scores (not interpolated), and the mean.

    Places are found over the distinct scores with their counts, so the sort is
    over scores that differ, not over rows."""
    by = df.where(F.col(score).isNotNull()).groupBy(F.col(score).alias("s")).agg(F.count("*").alias("c"))
    w = Window.orderBy("s").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = by.withColumn("hi", F.sum("c").over(w)).withColumn("lo", F.col("hi") - F.col("c"))
    n = by.agg(F.sum("c").alias("n"), F.sum(F.col("s") * F.col("c")).alias("sum"))
    at = lambda place: F.max(F.when((place >= F.col("lo")) & (place < F.col("hi")), F.col("s")))
    q = lambda k: F.floor(F.col("n") * k / 4)
    return run.crossJoin(n).agg(
        F.min("s").alias("min"), at(q(1)).alias("p25"), at(F.floor(F.col("n") / 2)).alias("median"), at(q(3)).alias("p75"), F.max("s").alias("max"), F.round(F.max(F.col("sum") / F.col("n")), 6).alias("mean"), F.max("n").alias("n")
    )


def histogram(df: DataFrame, score: str, buckets: int = 10) -> DataFrame:
    """(bucket, n) of scores in [0, 1], the last bucket closed, empty ones 0."""
    b = F.least(F.floor(F.col(score) * buckets), F.lit(buckets - 1)).cast("int")
    n = df.where(F.col(score).isNotNull()).groupBy(b.alias("bucket")).agg(F.count("*").alias("n"))
    spine = df.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    return spine.join(n, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n"))


def bands(score: Column) -> Column:
    return F.when(score >= 0.8, "excellent").when(score >= 0.6, "good").when(score >= 0.4, "fair").otherwise("poor")


def extremes(df: DataFrame, key: str, score: str, k: int = 5) -> DataFrame:
    """(end, rank, key, score): the k best and the k worst; two top-k, no sort."""
    d = df.where(F.col(score).isNotNull()).select(key, score)
    top = d.orderBy(F.desc(score), key).limit(k).withColumn("end", F.lit("top")).withColumn("rank", F.row_number().over(Window.orderBy(F.desc(score), key)))
    low = d.orderBy(score, key).limit(k).withColumn("end", F.lit("bottom")).withColumn("rank", F.row_number().over(Window.orderBy(score, key)))
    return top.unionByName(low)


def check(name: str, status: Column, value: Column) -> Column:
    return F.struct(F.lit(name).alias("check"), status.alias("status"), value.cast("long").alias("value"))


def overall_health(checks: DataFrame) -> DataFrame:
    """unhealthy with any failure, degraded with more than two warnings."""
    g = checks.agg(F.count_if(F.col("status") == "fail").alias("fails"), F.count_if(F.col("status") == "warn").alias("warns"))
    return g.select(F.when(F.col("fails") > 0, "unhealthy").when(F.col("warns") > 2, "degraded").otherwise("healthy").alias("health"), "fails", "warns")


def group_counts(df: DataFrame, c: Column, name: str) -> DataFrame:
    return df.groupBy(c.alias(name)).agg(F.count("*").alias("n"))
