"""Jobs' leases on a stream: a lease that runs out moves its job without an event.

The state of a job lives in the state store, in a bucket of jobs.  A bucket has a timer at the first end of its leases; when
the watermark passes it, a sweep takes the jobs back, each at its lease's end, as a worker's sweep would.  An event behind the end that comes in the same micro-batch
meets the job swept already, so the states do not depend on where micro-batches are cut: they are those of
``fold_swept`` over the same events, up to the time that the watermark has reached.

Cases: events of a job come in order of seq; events at or behind the watermark of an earlier micro-batch are late and
dropped, so ``delay`` has to cover how late they come (times are seconds after the epoch, above 0); a null job_id has none; a final state has no lease and no timer; an event
that is not allowed is counted and changes nothing.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .jobs import FINAL, STATE, apply, fresh

OUT = "job_id string, " + STATE
EVENT = ["job_id", "seq", "kind", "at", "worker", "target"]
#: Buckets of jobs where the caller names no number, and the jobs that a bucket should hold.
BUCKETS, BUCKET_JOBS = 1024, 256


def swept(state: dict, at: float) -> dict:
    """The state at a time: a lease that has run out by then is taken back at its end."""
    if state["lease"] is not None and state["lease"] <= at and state["status"] not in FINAL:
        return apply(state, "sweep", state["lease"], None)
    return state


def fold_swept(events: DataFrame, until: float) -> DataFrame:
    """The states of jobs after their events (EVENT) and the leases that run out up to ``until``; events are sorted and streamed."""

    def run(batches):
        import pandas as pd

        now, state = None, fresh()
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                if r.job_id != now:
                    if now is not None:
                        out.append((now, *swept(state, until).values()))
                    now, state = r.job_id, fresh()
                state = apply(swept(state, r.at), r.kind, r.at, r.worker, r.target)
            yield pd.DataFrame(out, columns=["job_id", *fresh()])
        yield pd.DataFrame([(now, *swept(state, until).values())] if now is not None else [], columns=["job_id", *fresh()])

    ordered = events.select(*EVENT).where("job_id is not null").repartition("job_id").sortWithinPartitions("job_id", "seq")
    return ordered.mapInPandas(run, OUT)


class Leases(StatefulProcessor):
    """State of a bucket's jobs, and one timer at the first end of their leases.

    A call from Spark to Python and the round trips to the state store are paid for each key, and cost far more than the
    fold of a job's events; so a key is a bucket of jobs, whose states are read and written together.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._state = handle.getValueState("jobs", "jobs string")

    def _jobs(self) -> dict[str, dict]:
        """The states by job, as they were kept."""
        return {k: dict(zip(fresh(), v)) for k, v in json.loads(self._state.get()[0]).items()} if self._state.exists() else {}

    def _keep(self, timer: int | None, jobs: dict[str, dict], changed: set[str]) -> Iterator:
        """Keeps the states, moves the timer, and gives the states that changed."""
        import pandas as pd

        first = _first_end(jobs)
        if first != timer:
            if timer is not None:
                self._handle.deleteTimer(timer)
            if first is not None:
                self._handle.registerTimer(first)
        self._state.update((json.dumps({k: list(v.values()) for k, v in jobs.items()}),))
        yield pd.DataFrame([(k, *jobs[k].values()) for k in changed], columns=["job_id", *fresh()])

    def handleInputRows(self, key: tuple, rows: Iterator, timerValues) -> Iterator:  # noqa: N802, N803
        import pandas as pd

        jobs, changed = self._jobs(), set()
        timer = _first_end(jobs)
        for r in pd.concat(list(rows)).sort_values("seq").itertuples():
            jobs[r.job_id] = apply(swept(jobs.get(r.job_id) or fresh(), r.at), r.kind, r.at, r.worker, r.target)
            changed.add(r.job_id)
        yield from self._keep(timer, jobs, changed)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator:  # noqa: N802, N803
        """Takes back every lease of the bucket that has run out by the watermark; the timer that fired is gone."""
        jobs, now = self._jobs(), timerValues.getCurrentWatermarkInMs() / 1000
        after = {k: swept(s, now) for k, s in jobs.items()}
        changed = {k for k, s in after.items() if s is not jobs[k]}
        yield from self._keep(None, after, changed)

    def close(self) -> None:
        pass


def _first_end(jobs: dict[str, dict]) -> int | None:
    """The millisecond by which the first of the jobs' leases has run out."""
    return min((math.ceil(s["lease"] * 1000) for s in jobs.values() if s["lease"] is not None), default=None)


def stream_leases(events: DataFrame, delay: str = "0 seconds", buckets: int = BUCKETS) -> DataFrame:
    """The states that each micro-batch of events (EVENT) and the timers that it fires change.

    Jobs are kept in ``buckets`` by a hash of their ids: some hundred jobs a bucket are a good measure, since a bucket's jobs,
    and its events of a micro-batch, are in memory together.  The number belongs to the checkpoint and must not change with it.
    The session's state store has to be the RocksDB one (spark.sql.streaming.stateStore.providerClass).
    """
    rows = events.where("job_id is not null").withColumn("_at", F.timestamp_millis((F.col("at") * 1000).cast("long"))).withWatermark("_at", delay)
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("job_id"), F.lit(buckets)))
    return rows.groupBy("bucket").transformWithStateInPandas(Leases(), OUT, "Update", "EventTime")
