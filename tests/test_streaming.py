from conftest import rows
from pyspark.sql import functions as F

from loomspan.streaming import events as E


def test_stream_equals_batch(spark, small_dir, tmp_path):
    batch = spark.read.parquet(f"{small_dir}/events.parquet").select("event_id", "ts", "user_id", "event_type")
    batch.repartition(3).write.parquet(str(tmp_path / "in"))
    for name, f in (("t", lambda d: E.tumbling(d, "ts", "1 day", ["event_type"], "100 days")), ("s", lambda d: E.sliding(d, "ts", "2 days", "1 day", ["event_type"], "100 days")), ("x", lambda d: E.sessions(d, "ts", "12 hours", ["user_id"], "100 days"))):
        stream = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        q = f(stream).writeStream.format("memory").queryName(f"q_{name}").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / f"ck{name}")).start()
        q.awaitTermination(120)
        assert rows(spark.table(f"q_{name}")) == rows(f(batch))


def test_apply_stream(spark, tmp_path):
    s = "k string, hash string"
    for i, data in enumerate([[("a", "1"), ("b", "1")], [("a", "2"), ("c", "1")]]):
        spark.createDataFrame(data, s).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        d = spark.readStream.schema(s).parquet(str(tmp_path / "in"))
        E.apply_stream(d, str(tmp_path / "state"), "k", {"hash": "MODIFIED"}, str(tmp_path / "ck")).awaitTermination(120)
    got = rows(spark.read.parquet(str(tmp_path / "state/1")).select("k", "hash", "n"))
    assert got == [("a", "2", 2), ("b", "1", 1), ("c", "1", 1)]


def test_once(spark):
    d = spark.createDataFrame([(1, "2025-01-01"), (1, "2025-01-02"), (2, None)], "u int, ts string").withColumn("ts", F.to_timestamp("ts"))
    assert E.once(d, "ts", ["u"]).count() == 2
