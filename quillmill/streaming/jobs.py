"""The job state machine: transitions, leases and retries as a fold over ordered events, in batch and as a stream."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: States, checkpoints to fall back to, limits.
CHAIN = ("DISCOVERED", "OCR_RUNNING", "OCR_COMPLETE", "ANALYSIS_RUNNING", "ANALYSIS_COMPLETE", "RAG_RUNNING", "COMMITTED")
SAFE = {"OCR_RUNNING": "DISCOVERED", "ANALYSIS_RUNNING": "OCR_COMPLETE", "RAG_RUNNING": "ANALYSIS_COMPLETE"}
FINAL = ("COMMITTED", "REVIEW_REQUIRED", "FAILED")
CLAIMABLE = ("DISCOVERED", "OCR_COMPLETE", "ANALYSIS_COMPLETE", "RETRY_PENDING")
LEASE_SECONDS, MAX_ATTEMPTS = 600, 5


def backoff(attempt: Column) -> Column:
    """Seconds before the next try: 30, doubled each time, at most 1800."""
    return F.when(attempt <= 0, 30.0).otherwise(F.least(F.lit(30.0) * F.pow(F.lit(2.0), attempt - 1), F.lit(1800.0)))


def latest(events: DataFrame, job: str, order: list[str], columns: list[str]) -> DataFrame:
    """The last event of each job, by one aggregation without a window."""
    last = F.max_by(F.struct(*columns), F.struct(*order)).alias("_l")
    return events.groupBy(job).agg(last, F.count("*").alias("events")).select(job, "events", "_l.*")


def claimable(jobs: DataFrame, now: Column, limit: int) -> DataFrame:
    """Jobs that a worker may take: claimable state, no live lease, retry due; the oldest first."""
    free = F.col("lock_expires_at").isNull() | (F.col("lock_expires_at") < now)
    due = F.col("next_retry_at").isNull() | (F.col("next_retry_at") <= now)
    return jobs.where(F.col("status").isin(*CLAIMABLE) & free & due).orderBy("created_at", "job_id").limit(limit)


def expired(jobs: DataFrame, now: Column) -> DataFrame:
    return jobs.where(F.col("lock_expires_at").isNotNull() & (F.col("lock_expires_at") < now) & ~F.col("status").isin(*FINAL))


def progress(jobs: DataFrame, status: str) -> DataFrame:
    """One row of counts over all jobs."""
    s = F.col(status)
    n = lambda c: F.count_if(c)
    return jobs.agg(F.count("*").alias("total"), n(s == "COMMITTED").alias("completed"), n(s.like("%\\_RUNNING")).alias("running"), n(s == "RETRY_PENDING").alias("retry"), n(s == "REVIEW_REQUIRED").alias("review"), n(s == "FAILED").alias("failed"), n(~s.isin(*FINAL)).alias("remaining"))


def allowed(before: str, after: str) -> bool:
    if before in FINAL:
        return False
    if after == "REVIEW_REQUIRED" or before == "RETRY_PENDING" and after in SAFE:
        return True
    return before in CHAIN and after in CHAIN and CHAIN.index(after) == CHAIN.index(before) + 1


def fresh() -> dict:
    return {"status": "DISCOVERED", "attempts": 0, "owner": None, "lease": None, "retry_at": None, "stage": None, "rejected": 0}


def apply(state: dict, kind: str, at: float, worker: str | None, target: str | None = None, max_attempts: int = MAX_ATTEMPTS) -> dict:
    """The state after one event: claim, renew, complete (to target), fail, sweep, retry.  What is not allowed is counted and changes nothing."""
    s = dict(state)
    live = s["lease"] is not None and s["lease"] > at
    mine = live and s["owner"] == worker
    if kind == "claim" and not live and s["status"] not in FINAL:
        if s["status"] == "RETRY_PENDING":
            s["status"] = SAFE.get(s["stage"], "DISCOVERED")
        s |= {"owner": worker, "lease": at + LEASE_SECONDS, "retry_at": None}
    elif kind == "renew" and mine:
        s["lease"] = at + LEASE_SECONDS
    elif kind == "complete" and mine and target and allowed(s["status"], target):
        s["status"] = target
        if target in FINAL:
            s |= {"owner": None, "lease": None}
    elif kind == "fail" and mine or kind == "sweep" and s["lease"] is not None and not live and s["status"] not in FINAL:
        n = s["attempts"] + 1
        s |= {"attempts": n, "stage": s["status"], "owner": None, "lease": None, "status": "FAILED" if n >= max_attempts else "RETRY_PENDING"}
        s["retry_at"] = None if n >= max_attempts else at + min(30.0 * 2 ** (n - 1), 1800.0)
    elif kind == "retry" and s["status"] in ("FAILED", "RETRY_PENDING"):
        s |= {"attempts": 0, "status": "RETRY_PENDING", "retry_at": at}
    else:
        s["rejected"] += 1
    return s


STATE = "status string, attempts int, owner string, lease double, retry_at double, stage string, rejected int"


def fold(events: DataFrame) -> DataFrame:
    """The state of each job after its events (job_id, seq, kind, at, worker, target), in order of seq.

    Events are sorted within partitions and streamed; a job's events need not fit in memory.
    """

    def run(batches):
        import pandas as pd

        now, state, out = None, fresh(), []
        for pdf in batches:
            for r in pdf.itertuples():
                if r.job_id != now:
                    if now is not None:
                        out.append((now, *state.values()))
                    now, state = r.job_id, fresh()
                state = apply(state, r.kind, r.at, r.worker, r.target)
            yield pd.DataFrame(out, columns=["job_id", *fresh()])
            out = []
        yield pd.DataFrame([(now, *state.values())] if now is not None else [], columns=["job_id", *fresh()])

    ordered = events.select("job_id", "seq", "kind", "at", "worker", "target").where("job_id is not null").repartition("job_id").sortWithinPartitions("job_id", "seq")
    return ordered.mapInPandas(run, "job_id string, " + STATE)


def stream_fold(events: DataFrame) -> DataFrame:
    """The same fold over a stream: the state of a job lives in the state store; each batch returns the states it changed."""

    def run(key, parts: Iterator, store):
        import pandas as pd

        state = dict(zip(fresh(), store.get)) if store.exists else fresh()
        for r in pd.concat(list(parts)).sort_values("seq").itertuples():
            state = apply(state, r.kind, r.at, r.worker, r.target)
        store.update(tuple(state.values()))
        yield pd.DataFrame([(key[0], *state.values())], columns=["job_id", *fresh()])

    return events.groupBy("job_id").applyInPandasWithState(run, "job_id string, " + STATE, STATE, "update", "NoTimeout")


def unique_jobs(jobs: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first creation of each (source hash, page range); later ones are the same job."""
    return jobs.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")


def windowed_counts(events: DataFrame, ts: str, key: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts by time window and key; on a stream, rows later than the watermark are dropped and windows closed."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width), key).agg(F.count("*").alias("n")).select(F.col("window.start").alias("window_start"), key, "n")


def checkpoints(jobs: DataFrame, saves: DataFrame) -> DataFrame:
    """jobs (job_id, owner, lease) with the last checkpoint that its live owner saved (saves: job_id, worker, at, data).

    A save by another worker or after the lease is refused, as an UPDATE guarded by owner and lease does.
    """
    j = saves.join(jobs.select("job_id", "owner", "lease"), "job_id")
    good = j.where((F.col("worker") == F.col("owner")) & (F.col("lease") >= F.col("at")))
    last = good.groupBy("job_id").agg(F.max_by("data", F.struct("at", "data")).alias("checkpoint"))
    return jobs.join(last, "job_id", "left")


def lookup(jobs: DataFrame, ids: DataFrame, key: str = "job_id") -> DataFrame:
    """The rows of the asked keys; keys that nobody has give none."""
    return jobs.join(ids.select(key).distinct(), key, "left_semi")


def first_by_hash(docs: DataFrame, verified: Column) -> DataFrame:
    """For each hash the document saved first, if it is wholly persisted; what a resumed run takes instead of working again."""
    first = docs.where(F.coalesce("md5", F.lit("")) != "").groupBy("md5").agg(F.min_by(F.struct("doc_id", verified.alias("ok")), F.struct("updated_at", "doc_id")).alias("_f"))
    return first.where("_f.ok").select("md5", "_f.doc_id")


#: The stages that a document's job passes and the events that move it: adapter of a pipeline to ``fold``.
STAGES = {"acquire": ("claim", None), "ocr_start": ("complete", "OCR_RUNNING"), "ocr_done": ("complete", "OCR_COMPLETE"), "analyse": ("complete", "ANALYSIS_RUNNING"), "analysed": ("complete", "ANALYSIS_COMPLETE"), "persist": ("complete", "RAG_RUNNING"), "commit": ("complete", "COMMITTED"), "fail": ("fail", None)}


def stage_events(steps: DataFrame) -> DataFrame:
    """Events for ``fold`` from a pipeline's steps (job_id, seq, step, at, worker)."""
    part = lambda k: F.create_map(*[F.lit(x) for name, v in STAGES.items() for x in (name, v[k])])
    return steps.select("job_id", "seq", F.try_element_at(part(0), F.col("step")).alias("kind"), "at", "worker", F.try_element_at(part(1), F.col("step")).alias("target")).where("kind is not null")
