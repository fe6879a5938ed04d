"""Jobs run inside tasks: claimed, run, and reported as rows that ``merges.finish_jobs`` takes in."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crateflow.sinks import tables

from . import merges

Handler = Callable[[dict], object]
REPORT = "id long, status string, result string, error string, started_at timestamp, at timestamp"
JOBS = "id long, job_type string, status string, payload string, result string, error string, updated_at timestamp"
#: Most characters of a reported error.
MOST_ERROR = 300


def next_pending(jobs: DataFrame, most: int, job_type: str | None = None) -> DataFrame:
    """The first ``most`` pending jobs by id, of one type or of all."""
    pending = jobs.where("status = 'pending' and id is not null")
    return (pending.where(F.col("job_type") == job_type) if job_type else pending).orderBy("id").limit(most)


def claimed(jobs: DataFrame, chosen: DataFrame, at: Column) -> DataFrame:
    """``jobs`` with the ``chosen`` ones running since ``at``."""
    rows = jobs.join(chosen.select("id", F.lit(True).alias("mine_")), "id", "left")
    mine = F.coalesce("mine_", F.lit(False)) & (F.col("status") == "pending")
    return rows.withColumns({"status": F.when(mine, "running").otherwise(F.col("status")), "updated_at": F.when(mine, at).otherwise(F.col("updated_at"))}).select(*jobs.columns)


def outcome(job: dict, handlers: dict[str, Handler]) -> tuple[str, str | None, str | None]:
    """(status, result as JSON, error) of one job. Its payload carries the job's id unless it names one;
    a payload that is no object counts as an empty one."""
    try:
        payload = json.loads(job["payload"] or "{}")
    except ValueError:
        payload = {}
    payload = payload if isinstance(payload, dict) else {}
    if payload.get("job_id") is None:
        payload["job_id"] = job["id"]
    run = handlers.get(job["job_type"])
    if run is None:
        return "failed", None, f"no handler for {job['job_type']!r}"
    try:
        return "completed", json.dumps(run(payload), ensure_ascii=False, sort_keys=True), None
    except Exception as e:  # a job's failure is its result
        return "failed", None, (str(e) or type(e).__name__)[:MOST_ERROR]


def run(jobs: DataFrame, handlers: dict[str, Handler]) -> DataFrame:
    """A report for each of ``jobs``, run by its type's handler: when it began (a sign of life), how it
    ended and when. A failing job fails alone. A lost task runs its jobs again."""

    def work(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            reports = []
            for job in part.to_dict("records"):
                began = datetime.now(timezone.utc)
                status, result, error = outcome(job, handlers)
                reports.append((job["id"], status, result, error, began, datetime.now(timezone.utc)))
            # One frame for all: a frame for each job costs far more than a short job.
            yield pd.DataFrame(reports, columns=["id", "status", "result", "error", "started_at", "at"])

    return jobs.select("id", "job_type", "payload").mapInPandas(work, REPORT)


def work_round(spark: SparkSession, path: str, batch: int, handlers: dict[str, Handler], most: int = 100, job_type: str | None = None, minutes: dict[str, int] | None = None, parts: int = 8) -> int:
    """One round over a stored table of ``JOBS``, two batches of it from ``batch`` on: stale jobs go back, the
    next ones are claimed and run in ``parts`` tasks, and their reports merged. Gives how many were claimed.

    A round that dies leaves its jobs running; the stale rule of a later round takes them up again."""
    now = F.lit(datetime.now(timezone.utc))
    jobs = tables.read(spark, path, JOBS)
    fresh = merges.requeue_stale(jobs, now, minutes or {})
    ids = [(r.id,) for r in next_pending(fresh, most, job_type).select("id").collect()]  # ``most`` numbers at most
    chosen = spark.createDataFrame(ids, "id long")
    changed = claimed(fresh, chosen, now).join(jobs.select("id", F.col("status").alias("was_"), F.col("updated_at").alias("heard_")), "id")
    changed = changed.where((F.col("status") != F.col("was_")) | (F.col("updated_at") != F.col("heard_"))).drop("was_", "heard_")
    tables.merge(changed, batch, path, JOBS, ["id"], tables.upserts(["id"]))
    mine = tables.read(spark, path, JOBS).where("status = 'running'").join(chosen, "id", "left_semi")
    reports = run(mine.repartition(parts, "id"), handlers)
    tables.merge(reports.select("id", "status", "result", "error", F.col("at").alias("updated_at")), batch + 1, path, JOBS, ["id"], tables.upserts(["id"]))
    return len(ids)
