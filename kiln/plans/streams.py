"""Streaming plans over the events table: ST1-ST3."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from kiln.session import scratch_path
from kiln.sources.tables import load
from kiln.streaming import events as ST

FREQ, LATENCY = "Daily", 6


def _stream(spark, sf):
    schema = load(spark, sf, "events").schema
    return ST.read_events(spark, sf, schema, glob="events.parquet")


def stream_events(spark, sf):
    base = scratch_path(spark, f"stream-events-{uuid.uuid4().hex}")
    out = f"{base}/rows"
    s = ST.event_stream(_stream(spark, sf)).withColumn("ts", F.col("__et").cast("timestamp_ntz")).drop("__et")
    ST.run_to_files(s, out, f"{base}/progress")
    return spark.read.parquet(out)


def stream_daily_windows(spark, sf):
    base = scratch_path(spark, f"stream-windows-{uuid.uuid4().hex}")
    out = f"{base}/rows"
    w = ST.windowed(_stream(spark, sf), FREQ, LATENCY)
    w = w.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"),
                 F.col("w.end").cast("timestamp_ntz").alias("window_end"), "event_type", "n_events", "total_value")
    ST.run_to_files(w, out, f"{base}/progress")
    return spark.read.parquet(out)


def stream_latest_per_user(spark, sf):
    base = scratch_path(spark, f"stream-store-{uuid.uuid4().hex}")
    ST.upsert_stream(_stream(spark, sf), f"{base}/store", "user_id", "ts", f"{base}/progress")
    return ST.read_upserted(spark, f"{base}/store")


ORACLES = {
    "stream_events": "SELECT event_id, ts, user_id, event_type, value, props, CAST(ts AS DATE) AS event_date FROM events",
    "stream_daily_windows": f"""
WITH w AS (SELECT date_trunc('day', ts) AS window_start, date_trunc('day', ts) + INTERVAL 1 DAY AS window_end,
                  event_type, count(*) AS n_events,
                  CAST(sum(CAST(value AS DECIMAL(18,2))) AS DECIMAL(38,2)) AS total_value
           FROM events GROUP BY 1, 2, 3)
SELECT * FROM w WHERE window_end <= (SELECT max(ts) FROM events) - INTERVAL {LATENCY} HOUR""",
    "stream_latest_per_user": """
SELECT event_id, ts, user_id, event_type, value, props FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC, event_type DESC, value DESC,
                               props DESC) AS rn FROM events) WHERE rn = 1""",
}

QUERIES = {
    "stream_events": stream_events,
    "stream_daily_windows": stream_daily_windows,
    "stream_latest_per_user": stream_latest_per_user,
}
