"""Exactly once: replays, crashes before a commit, restarts, two intakes of one store."""

import pytest

from quillmill.operators import retrieve
from quillmill.sources.store import Store
from quillmill.streaming.intake import Intake

ROWS = [(1, "alpha beta"), (2, "beta"), (3, "alpha beta"), (3, "alpha beta"), (4, None), (5, "")]


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, f"file://{tmp_path}/store")


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def ledger(store):
    return sorted((r.ledger_id, r.doc_id, r.status) for r in store.read("ledger").collect())


def test_a_batch_and_its_replay(spark, store):
    intake = Intake(store)
    first = intake.batch(table(spark, [*ROWS, (None, "x")]), 0)
    want = [("VG-0001", 1, "NEW"), ("VG-0002", 2, "NEW"), ("VG-0003", 3, "DUPLICATE"), ("VG-0004", 3, "DUPLICATE"), ("VG-0005", 4, "NEW"), ("VG-0006", 5, "DUPLICATE")]
    assert ledger(store) == want
    assert intake.batch(table(spark, ROWS), 0) == first and store.state() == first
    intake.batch(table(spark, [(6, "beta"), (7, "gamma alpha")]), 1)
    intake.batch(table(spark, []), 2)
    assert ledger(store) == [*want, ("VG-0007", 6, "DUPLICATE"), ("VG-0008", 7, "NEW")]
    kept = store.read("documents").collect()
    assert sorted((r.doc_id, r.text) for r in kept) == [(1, "alpha beta"), (2, "beta"), (4, ""), (7, "gamma alpha")]
    assert sorted((r.batch, r.received, r.kept) for r in store.read("intake_log").collect()) == [(0, 6, 3), (1, 2, 1), (2, 0, 0)]
    queries = spark.createDataFrame([(1, ["alpha"]), (2, ["bet", "gam"])], "query_id long, words array<string>")
    told = lambda df: sorted((r.query_id, r.doc_id, r["rank"], round(r.score, 8)) for r in df.collect())
    assert told(intake.index.search(queries)) == told(retrieve.bm25(store.read("documents"), "doc_id", "text", queries))


def test_a_stream_that_dies_before_its_commit(spark, store, tmp_path, monkeypatch):
    source, checkpoint = f"{tmp_path}/in", f"{tmp_path}/checkpoint"
    table(spark, ROWS[:3]).coalesce(1).write.parquet(source)
    read = lambda: spark.readStream.schema("doc_id long, text string").parquet(source)
    commit, tries = Store.commit, []

    def dies(self, new):
        tries.append(new.version)
        if len(tries) == 1:
            raise RuntimeError("lost before the commit")
        return commit(self, new)

    monkeypatch.setattr(Store, "commit", dies)
    with pytest.raises(Exception, match="lost before the commit"):
        Intake(store).start(read(), checkpoint).awaitTermination()
    assert store.state().version == 0
    Intake(store).start(read(), checkpoint).awaitTermination()
    want = [("VG-0001", 1, "NEW"), ("VG-0002", 2, "NEW"), ("VG-0003", 3, "DUPLICATE")]
    assert ledger(store) == want
    # dies after the commit, before the stream knows: the batch comes again
    table(spark, ROWS[3:]).coalesce(1).write.mode("append").parquet(source)

    def late(self, new):
        commit(self, new)
        raise RuntimeError("lost after the commit")

    monkeypatch.setattr(Store, "commit", late)
    with pytest.raises(Exception, match="lost after the commit"):
        Intake(store).start(read(), checkpoint).awaitTermination()
    monkeypatch.setattr(Store, "commit", commit)
    version = store.state().version
    Intake(store).start(read(), checkpoint).awaitTermination()
    assert store.state().version == version and store.state().batches == {"intake": 1}
    assert ledger(store) == [*want, ("VG-0004", 3, "DUPLICATE"), ("VG-0005", 4, "NEW"), ("VG-0006", 5, "DUPLICATE")]


def test_two_intakes_of_one_store(spark, store, monkeypatch):
    change, seen = Intake._change, []

    def interrupted(self, state, taken, batch_id):
        seen.append((self.query, state.version))
        if len(seen) == 1:
            Intake(store, "other").batch(table(spark, [(2, "beta"), (9, "delta")]), 0)
        return change(self, state, taken, batch_id)

    monkeypatch.setattr(Intake, "_change", interrupted)
    Intake(store, "one").batch(table(spark, ROWS[:2]), 0)
    assert seen == [("one", 0), ("other", 0), ("one", 1)]
    assert ledger(store) == [("VG-0001", 2, "NEW"), ("VG-0002", 9, "NEW"), ("VG-0003", 1, "NEW"), ("VG-0004", 2, "DUPLICATE")]
