"""Batch forms of the streaming queries, checked against SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomspan.session import table
from loomspan.streaming import events as E


def _e(spark, sf):
    return table(spark, sf, "events", "event_id", "ts", "user_id", "event_type")


def _plain(df):
    t = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return df.withColumn("start", t("start")).withColumn("stop", t("stop"))


def stream_tumbling(spark, sf):
    return _plain(E.tumbling(_e(spark, sf), "ts", "1 day", ["event_type"]))


def stream_sliding(spark, sf):
    return _plain(E.sliding(_e(spark, sf), "ts", "2 days", "1 day", ["event_type"]))


def stream_session(spark, sf):
    return _plain(E.sessions(_e(spark, sf), "ts", "12 hours", ["user_id"]))


def stream_dedupe(spark, sf):
    return E.once(_e(spark, sf), "ts", ["user_id", "event_type"]).groupBy("event_type").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (stream_tumbling, stream_sliding, stream_session, stream_dedupe)}

_F = "strftime({0}, '%Y-%m-%d %H:%M:%S')"
SQL = {
    "stream_tumbling": f"SELECT {_F.format('d')} AS start, {_F.format('d + INTERVAL 1 DAY')} AS stop, event_type, count(*) AS n FROM (SELECT date_trunc('day', ts) AS d, event_type FROM events) GROUP BY d, event_type",
    "stream_sliding": f"SELECT {_F.format('d')} AS start, {_F.format('d + INTERVAL 2 DAY')} AS stop, event_type, count(*) AS n FROM (SELECT unnest([date_trunc('day', ts)::TIMESTAMP, date_trunc('day', ts)::TIMESTAMP - INTERVAL 1 DAY]) AS d, event_type FROM events) GROUP BY d, event_type",
    "stream_session": f"""WITH l AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 12 HOUR THEN 0 ELSE 1 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM l)
SELECT {_F.format('min(ts)')} AS start, {_F.format('max(ts) + INTERVAL 12 HOUR')} AS stop, user_id, count(*) AS n FROM s GROUP BY user_id, k""",
    "stream_dedupe": "SELECT event_type, count(DISTINCT user_id) AS n FROM events GROUP BY 1",
}
