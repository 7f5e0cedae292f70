"""Session helpers: building a session, reading tables, cutting lineage."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "loomspan", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the engine is written for (UTC, AQE on)."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.sql.execution.arrow.maxRecordsPerBatch": "4000",
    }
    return b.config(map={**base, **conf}).getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """One parquet table; with `columns`, only those (so that the scan is narrow)."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the folder of `spark.checkpoint.dir`.

    The setting is read from the session.  Where it is unset, a local master may
    use a temporary folder of its machine; on a cluster other machines could not
    read that, so it is an error."""
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        shared = sc.getConf().get("spark.checkpoint.dir")
        if not shared and not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="loomspan-ck-", dir=os.environ.get("TMPDIR")))
    return df.checkpoint(eager=True)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def broadcast_if_small(df: DataFrame, rows: int = 100_000, written: bool = False) -> DataFrame:
    """The frame, written to the checkpoint folder (unless it is `written`
    already) so that counting does not compute it twice; with a broadcast hint
    only if it has at most `rows` rows.  Beyond that the join shuffles."""
    from pyspark.sql import functions as F

    df = df if written else cut_lineage(df)
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
