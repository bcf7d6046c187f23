"""Time-series queries over events."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import timeseries as TS
from tessera.sources import load

QUERIES, ORACLES = {}, {}


def latest_by(spark, sf_dir):
    return TS.latest_by(load(spark, sf_dir, "events").select("event_id", "ts", "user_id", "value"), ["user_id"], "ts", "event_id")


def time_bucket_agg(spark, sf_dir):
    return TS.bucketed(load(spark, sf_dir, "events"), "5m", "ts", F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


def ts_range(spark, sf_dir):
    t = lambda s: F.lit(s).cast("timestamp_ntz")
    return TS.ts_range(load(spark, sf_dir, "events"), "ts", t("2024-01-02"), t("2024-01-10 12:00:00")).select("event_id", "ts")


def ttl_filter(spark, sf_dir):
    return TS.ttl_filter(load(spark, sf_dir, "events"), "ts", F.lit("2024-01-15").cast("timestamp_ntz"), 7 * 86400).select("event_id", "ts")


QUERIES = {f.__name__: f for f in (latest_by, time_bucket_agg, ts_range, ttl_filter)}
ORACLES = {
    "latest_by": "SELECT event_id, ts, user_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1",
    "time_bucket_agg": "SELECT time_bucket(INTERVAL 5 MINUTE, ts, TIMESTAMP '1970-01-01') AS bucket, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1",
    "ts_range": "SELECT event_id, ts FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-02' AND TIMESTAMP '2024-01-10 12:00:00'",
    "ttl_filter": "SELECT event_id, ts FROM events WHERE ts >= TIMESTAMP '2024-01-15' - INTERVAL 7 DAY",
}
