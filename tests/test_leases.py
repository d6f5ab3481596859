"""Leases on a stream: expiry without an event, and the same states as the batch fold wherever batches are cut."""

import random

import pytest

from quillmill.streaming import jobs
from quillmill.streaming.leases import EVENT, fold_swept, stream_leases, swept

KINDS = "job_id string, seq long, kind string, at double, worker string, target string"


@pytest.fixture
def rocksdb(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    was = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.set(key, was)


def run_stream(spark, tmp_path, batches, buckets=3, kept=None):
    """The last state that each job was given, with micro-batches as given."""
    source, seen = f"{tmp_path}/in", {}
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, KINDS).coalesce(1).write.mode("append").parquet(source)

        def keep(df, _):
            for r in df.collect():
                seen[r.job_id] = tuple(r)[1:]

        stream = spark.readStream.schema(KINDS).parquet(source)
        query = stream_leases(stream, buckets=buckets).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
        if kept is not None:
            kept += [o.numRowsTotal for p in query.recentProgress for o in p.stateOperators]
    return seen


def batch(spark, rows, until):
    return {r.job_id: tuple(r)[1:] for r in fold_swept(spark.createDataFrame(rows, KINDS), until).collect()}


def test_swept():
    s = jobs.apply(jobs.fresh(), "claim", 10.0, "w")
    assert swept(s, 609.9) is s
    late = swept(s, 700.0)
    assert (late["status"], late["attempts"], late["lease"], late["retry_at"]) == ("RETRY_PENDING", 1, None, 640.0)


def test_a_lease_runs_out_without_an_event(spark, tmp_path, rocksdb):
    first = [("a", 1, "claim", 0.5, "w", None), ("a", 2, "complete", 5.0, "w", "OCR_RUNNING"), ("b", 1, "claim", 1.0, "w", None), ("b", 2, "renew", 500.0, "w", None)]
    second = [("c", 1, "claim", 900.0, "w", None)]
    seen = run_stream(spark, tmp_path, [first, second])
    assert seen["a"][:2] == ("RETRY_PENDING", 1) and seen["a"][5] == "OCR_RUNNING" and seen["a"][4] == 630.5
    assert seen["b"][0] == "DISCOVERED" and seen["b"][3] == 1100.0
    assert seen == batch(spark, first + second, 900.0)


def test_stream_equals_batch(spark, tmp_path, rocksdb):
    rng = random.Random(3)
    rows, seq = [], {}
    at = 0.0
    for _ in range(220):
        at += rng.choice([1.0, 20.0, 150.0])
        job = f"j{rng.randint(0, 11)}"
        seq[job] = seq.get(job, 0) + 1
        kind = rng.choice(["claim", "claim", "renew", "complete", "complete", "fail", "retry"])
        rows.append((job, seq[job], kind, at, rng.choice(["w1", "w1", "w2"]), rng.choice(jobs.CHAIN) if kind == "complete" else None))
    cuts = [0, 40, 47, 130, 220]
    seen = run_stream(spark, tmp_path, [rows[a:b] for a, b in zip(cuts, cuts[1:])])
    want = batch(spark, rows, at)
    assert seen == want and any(v[1] for v in want.values()) and len(EVENT) == 6


def test_a_bucket_holds_many_jobs(spark, tmp_path, rocksdb):
    """a call to Python for each job cost 8 ms; a key of the state store is a bucket of jobs, with one timer for all."""
    rows = [(f"j{k}", 1, "claim", 1.0 + k + k / 8192, "w", None) for k in range(300)] + [(f"j{k}", 2, "renew", 302.0 + k, "w", None) for k in range(0, 300, 3)]
    later = [("z", 1, "claim", 1050.0, "w", None)]
    kept = []
    seen = run_stream(spark, tmp_path, [rows, later], 4, kept)
    assert seen == batch(spark, rows + later, 1050.0) and len({v[0] for v in seen.values()}) == 2
    assert 0 < max(kept) <= 20  # rows of the state store: 300 before, and timers
