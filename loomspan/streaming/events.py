"""Structured Streaming: windowed counts with watermarks, deduplication, and a
change log applied batch by batch (ST-X1..3).  Each takes a frame that may be a
stream or a table, so the same plan is checked in batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loomspan.operators.sync import apply_changes, detect_changes


def _timed(events: DataFrame, ts: str, late: str) -> DataFrame:
    e = events.withColumn(ts, F.col(ts).cast("timestamp"))
    return e.withWatermark(ts, late) if events.isStreaming else e


def _counts(events: DataFrame, ts: str, window: Column, by: list[str], late: str) -> DataFrame:
    g = _timed(events, ts, late).groupBy(window.alias("w"), *by).agg(F.count("*").alias("n"))
    return g.select(F.col("w.start").alias("start"), F.col("w.end").alias("stop"), *by, "n")


def tumbling(events: DataFrame, ts: str, size: str, by: list[str], late: str = "1 hour") -> DataFrame:
    """(start, stop, *by, n) of windows that follow one another."""
    return _counts(events, ts, F.window(ts, size), by, late)


def sliding(events: DataFrame, ts: str, size: str, step: str, by: list[str], late: str = "1 hour") -> DataFrame:
    return _counts(events, ts, F.window(ts, size, step), by, late)


def sessions(events: DataFrame, ts: str, gap: str, by: list[str], late: str = "1 hour") -> DataFrame:
    """Windows that end after `gap` without an event of the same key."""
    return _counts(events, ts, F.session_window(ts, gap), by, late)


def once(events: DataFrame, ts: str, keys: list[str], late: str = "1 hour") -> DataFrame:
    """The first event of each key; a stream forgets keys after the watermark."""
    e = _timed(events, ts, late)
    return e.dropDuplicatesWithinWatermark(keys) if events.isStreaming else e.dropDuplicates(keys)


def apply_stream(deliveries: DataFrame, state_path: str, key: str, fields: dict[str, str], checkpoint: str, order: tuple[str, ...] = ()) -> StreamingQuery:
    """Applies each micro-batch of records to the table at `state_path`.

    The state is written beside the old one under the batch's number, so a batch
    that is repeated after a failure starts from the same state; a state that is
    missing or cannot be read is an error, never an empty table.  `order` names
    the columns by which the latest row of a key is told."""

    def one(batch: DataFrame, no: int) -> None:
        spark = batch.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{state_path}/{no - 1}")
        if no > 0 and path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            old = spark.read.parquet(str(path))  # any failure to read ends the batch
        elif no > 0:
            raise FileNotFoundError(f"no state of batch {no - 1} in {state_path}")
        else:
            old = spark.createDataFrame([], batch.select(key, *fields).schema).withColumn("n", F.lit(0)).withColumn("lifecycle", F.lit(""))
        # of rows with one key in a batch the greatest counts, by `order` first
        new = batch.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.struct(*[F.col(c) for c in [*order, *fields]])).alias("r")).select(key, *[F.col(f"r.{c}").alias(c) for c in fields])
        kept = old.select(key, *fields).join(new.select(key), key, "left_anti")  # a batch is no full delivery
        both = new.unionByName(kept)
        changes = detect_changes(old.select(key, *fields), both, key, fields)
        apply_changes(old.select(key, *fields, "n"), both, changes, key, "n").write.mode("overwrite").parquet(f"{state_path}/{no}")

    return deliveries.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
