"""A content is read once: unchanged, copied and renamed files are hits, changed ones are not, failures come again."""

import os

import pytest

from quillmill.sources.page_cache import PageCache
from quillmill.sources.store import Store


@pytest.fixture
def cache(spark, tmp_path):
    return PageCache(Store(spark, f"file://{tmp_path}/store"))


def test_runs(spark, cache, tmp_path):
    folder, calls = tmp_path / "in", tmp_path / "calls"
    folder.mkdir()
    calls.mkdir()

    def recognize(data, suffix):
        import uuid

        (calls / uuid.uuid4().hex).write_bytes(data)
        if b"bad" in data:
            raise ValueError("unreadable")
        return [(f"a page of text that was read: {data[5:].decode()}", 0.9)]

    def run():
        before = len(os.listdir(calls))
        rows = cache.read(f"file://{folder}", recognize).collect()
        told = sorted((r.source_path.rsplit("/", 1)[-1], r.ocr_status, r.full_text.split(": ")[-1]) for r in rows)
        return told, len(os.listdir(calls)) - before

    assert run() == ([], 0)
    (folder / "a.pdf").write_bytes(b"%PDF-one")
    (folder / "b.pdf").write_bytes(b"%PDF-two")
    (folder / "copy.pdf").write_bytes(b"%PDF-one")
    (folder / "c.txt").write_text("plain")
    (folder / "x.pdf").write_bytes(b"%PDF-bad")
    first = [("a.pdf", "OCR_OK", "one"), ("b.pdf", "OCR_OK", "two"), ("c.txt", "TEXT_LAYER", "plain"), ("copy.pdf", "OCR_OK", "one"), ("x.pdf", "ERROR", "unreadable")]
    assert run() == (first, 3)
    assert run() == (first, 1)  # only what failed is tried again
    os.rename(folder / "b.pdf", folder / "moved.pdf")
    (folder / "a.pdf").write_bytes(b"%PDF-three")
    os.remove(folder / "x.pdf")
    assert run() == ([("a.pdf", "OCR_OK", "three"), ("c.txt", "TEXT_LAYER", "plain"), ("copy.pdf", "OCR_OK", "one"), ("moved.pdf", "OCR_OK", "two")], 1)
    runs = sorted(tuple(r)[:4] for r in cache.store.read("runs").drop("_commit").collect())
    assert runs == [(1, 0, 0, 0), (2, 5, 0, 5), (3, 5, 4, 1), (4, 4, 3, 1)]


def test_a_run_that_dies_leaves_the_cache(spark, cache, tmp_path, monkeypatch):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "c.txt").write_text("plain")
    monkeypatch.setattr(Store, "commit", lambda self, new: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        cache.read(f"file://{folder}")
    monkeypatch.undo()
    assert cache.store.state().version == 0 and cache.store.read("pages") is None
    assert [r.full_text for r in cache.read(f"file://{folder}").collect()] == ["plain"]
