"""Streams of snapshots and events; each gives what its batch twin gives over the same rows.

Watermarks need timestamps with a zone: times without one are read as those of the session's."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _timed(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn(column, F.col(column).cast("timestamp"))


def first_of_day(snapshots: DataFrame, late: str = "2 days") -> DataFrame:
    """The first snapshot (sc_id, recorded_at, ...) of each id and day to arrive, as a stream."""
    marked = _timed(snapshots, "recorded_at").withWatermark("recorded_at", late).withColumn("day", F.to_date("recorded_at"))
    return marked.dropDuplicatesWithinWatermark(["sc_id", "day"])


def daily_counts(events: DataFrame, late: str = "1 day") -> DataFrame:
    """day, user_id, n: events (ts, user_id) of each user and day."""
    return _timed(events, "ts").withWatermark("ts", late).groupBy(F.window("ts", "1 day").alias("w"), "user_id").agg(F.count("*").alias("n")).select(F.to_date("w.start").alias("day"), "user_id", "n")


def sessions(events: DataFrame, gap: str = "6 hours", least: int = 3, late: str = "1 day") -> DataFrame:
    """user_id, start_ts, end_ts, n of runs of events that follow each other within ``gap``."""
    own = _timed(events, "ts").withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"), F.count("*").alias("n"))
    return own.where(F.col("n") >= least).select("user_id", F.col("start_ts").cast("timestamp_ntz").alias("start_ts"), F.col("end_ts").cast("timestamp_ntz").alias("end_ts"), "n")


def stale_jobs(heartbeats: DataFrame, late: str = "10 minutes") -> DataFrame:
    """id, job_type, last_at of jobs' heartbeats (id, job_type, at) in sessions of two hours without any,
    which end when nothing more is heard: such jobs go back to the queue."""
    own = _timed(heartbeats, "at").withWatermark("at", late).groupBy(F.session_window("at", F.when(F.col("job_type") == "embedding", "120 minutes").otherwise("30 minutes")).alias("w"), "id", "job_type")
    return own.agg(F.max("at").alias("last_at")).select("id", "job_type", "last_at")
