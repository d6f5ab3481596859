"""Queries on jobs and event streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..streaming import jobs
from .base import read

#: Event types stand for job states.
_STATES = {"signup": "DISCOVERED", "view": "OCR_RUNNING", "click": "RETRY_PENDING", "purchase": "COMMITTED", "error": "FAILED"}
_SQL_STATES = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _STATES.items()) + " END"


def _jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    states = F.create_map(*[F.lit(x) for kv in _STATES.items() for x in kv])
    rows = e.select("user_id", "event_id", "ts", F.try_element_at(states, F.col("event_type")).alias("status"), F.get_json_object("props", "$.k").cast("long").alias("attempt"))
    return jobs.latest(rows, "user_id", ["ts", "event_id"], ["status", "attempt", "ts", "event_id"])


_LATEST = f"WITH l AS (SELECT user_id, count(*) AS events, arg_max({_SQL_STATES}, (ts, event_id)) AS status, arg_max((props->>'k')::BIGINT, (ts, event_id)) AS attempt, max(ts) AS ts, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY user_id) "


def job_state_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _jobs(spark, sf_dir).select("user_id", "events", "status", "attempt", "event_id")


def job_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.progress(_jobs(spark, sf_dir), "status")


def _leases(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = _jobs(spark, sf_dir)
    epoch = F.unix_timestamp("ts")
    return j.select(F.col("user_id").alias("job_id"), "status", F.when(F.col("user_id") % 2 == 0, epoch + 600).alias("lock_expires_at"), F.when(F.col("user_id") % 3 == 0, epoch + jobs.backoff(F.col("attempt") % 10)).alias("next_retry_at"), epoch.alias("created_at"))


_LEASES = _LATEST + ", j AS (SELECT user_id AS job_id, status, CASE WHEN user_id % 2 = 0 THEN floor(epoch(ts))::BIGINT + 600 END AS lock_expires_at, CASE WHEN user_id % 3 = 0 THEN floor(epoch(ts))::BIGINT + CASE WHEN attempt % 10 <= 0 THEN 30 ELSE least(30 * pow(2, attempt % 10 - 1), 1800) END END AS next_retry_at, floor(epoch(ts))::BIGINT AS created_at FROM l)"
_MID = "(SELECT (max(created_at) + min(created_at)) // 2 FROM j)"


def claimable_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 20 claimable jobs at the middle of the time that the events span."""
    j = _leases(spark, sf_dir)
    mid = j.agg(F.floor((F.max("created_at") + F.min("created_at")) / 2)).first()[0]  # one number
    return jobs.claimable(j, F.lit(mid), 20).select("job_id", "status", "created_at")


def expired_leases(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = _leases(spark, sf_dir)
    mid = j.agg(F.floor((F.max("created_at") + F.min("created_at")) / 2)).first()[0]
    return jobs.expired(j, F.lit(mid)).select("job_id", "status")


def retry_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select("event_id", jobs.backoff(F.get_json_object("props", "$.k").cast("long") % 12).alias("seconds"))


def job_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events as one job's: claims, completions, failures, sweeps, folded in order."""
    e = read(spark, sf_dir, "events")
    kinds = F.create_map(*[F.lit(x) for kv in {"signup": "claim", "view": "claim", "click": "fail", "purchase": "complete", "error": "sweep"}.items() for x in kv])
    rows = e.select(F.col("user_id").cast("string").alias("job_id"), "event_id", F.unix_timestamp("ts").cast("double").alias("at"), F.try_element_at(kinds, F.col("event_type")).alias("kind"), F.lit("w").alias("worker"), F.lit("OCR_RUNNING").alias("target"), F.struct("ts", "event_id").alias("seq"))
    return jobs.fold(rows).select("job_id", "status", "attempts", "rejected")


def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.windowed_counts(read(spark, sf_dir, "events").select("ts", "event_type"), "ts", "event_type", "1 day")


QUERIES = {f.__name__: f for f in (job_state_latest, job_progress, claimable_jobs, expired_leases, retry_backoff, job_fold, event_windows)}

SQL = {
    "job_state_latest": _LATEST + "SELECT user_id, events, status, attempt, event_id FROM l",
    "job_progress": _LATEST + "SELECT count(*) AS total, count(*) FILTER (status = 'COMMITTED') AS completed, count(*) FILTER (status LIKE '%\\_RUNNING' ESCAPE '\\') AS running, count(*) FILTER (status = 'RETRY_PENDING') AS retry, count(*) FILTER (status = 'REVIEW_REQUIRED') AS review, count(*) FILTER (status = 'FAILED') AS failed, count(*) FILTER (status NOT IN ('COMMITTED', 'REVIEW_REQUIRED', 'FAILED')) AS remaining FROM l",
    "claimable_jobs": _LEASES + f" SELECT job_id, status, created_at FROM j WHERE status IN ('DISCOVERED', 'RETRY_PENDING') AND (lock_expires_at IS NULL OR lock_expires_at < {_MID}) AND (next_retry_at IS NULL OR next_retry_at <= {_MID}) ORDER BY created_at, job_id LIMIT 20",
    "expired_leases": _LEASES + f" SELECT job_id, status FROM j WHERE lock_expires_at < {_MID} AND status NOT IN ('COMMITTED', 'REVIEW_REQUIRED', 'FAILED')",
    "retry_backoff": "SELECT event_id, CASE WHEN (props->>'k')::BIGINT % 12 <= 0 THEN 30::DOUBLE ELSE least(30 * pow(2, (props->>'k')::BIGINT % 12 - 1), 1800)::DOUBLE END AS seconds FROM events",
    "event_windows": "SELECT date_trunc('day', ts)::TIMESTAMP AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL",
}
