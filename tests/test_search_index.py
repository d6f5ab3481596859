"""The kept index gives the rows of BM25 from scratch, after upserts too, and reads less."""

import random

import pytest

from quillmill.operators import retrieve
from quillmill.operators.search_index import SearchIndex
from quillmill.sources.store import Store


@pytest.fixture
def index(spark, tmp_path):
    return SearchIndex(Store(spark, f"file://{tmp_path}/index"), slice_docs=4)


def texts(seed, n):
    rng = random.Random(seed)
    words = [f"w{k}x" for k in range(60)] + ["müller", "strasse", "straßen", "a", "ab", "abc"]
    return [" ".join(rng.choices(words, weights=[60 / (k + 1) for k in range(len(words))], k=rng.randint(0, 40))) for _ in range(n)]


def asked(spark):
    rng = random.Random(4)
    rows = [(k, [rng.choice(["w1", "w2", "w33x", "w40", "mü", "STRAS", "a", "ab", "w5x", "zz", ""]) for _ in range(rng.randint(0, 5))]) for k in range(25)]
    return spark.createDataFrame(rows, "query_id long, words array<string>")


def listed(df):
    return sorted((r.query_id, r["rank"], r.doc_id, round(r.score, 8)) for r in df.collect())


def test_same_rows_as_from_scratch(spark, index):
    docs = dict(enumerate(texts(1, 90)))
    table = lambda d: spark.createDataFrame([(k, v, "x") for k, v in d.items()], "doc_id long, text string, term string")
    queries = asked(spark)
    want = lambda: listed(retrieve.bm25(table(docs), "doc_id", "text", queries, 5))
    index.refresh(table(docs), "doc_id", "text")
    assert listed(index.search(queries, 5)) == want()
    changed = {k: v for k, v in zip(range(70, 110), texts(2, 40))} | {3: None, 4: ""}
    index.refresh(table(changed), "doc_id", "text")
    old = index.store.state(1)
    was, docs = docs, docs | changed
    counts = {}
    assert listed(index.search(queries, 5, counts=counts)) == want()
    assert 0 < counts["read"] < counts["all"]
    assert listed(index.search(queries, 5, old)) == listed(retrieve.bm25(table(was), "doc_id", "text", queries, 5))
    index.refresh(table({5: docs[5] + " w40x", 71: "abc"}), "doc_id", "text")
    docs |= {5: docs[5] + " w40x", 71: "abc"}
    assert listed(index.search(queries, 3)) == listed(retrieve.bm25(table(docs), "doc_id", "text", queries, 3))
    index.compact()
    assert len(index.store.folders("search_postings")) == 1 and listed(index.search(queries, 5)) == want()


def test_most_postings_are_skipped(spark, tmp_path):
    """Long questions over many documents: frequent words alone reach no threshold."""
    rng = random.Random(6)
    docs = [(k, " ".join([f"id{k}", *rng.choices([f"common{j}" for j in range(30)], k=30)])) for k in range(3000)]
    index = SearchIndex(Store(spark, f"file://{tmp_path}/many"), slice_docs=8)
    rows = spark.createDataFrame(docs, "doc_id long, text string")
    index.refresh(rows, "doc_id", "text")
    queries = spark.createDataFrame([(k, [f"id{k * 7}", f"id{k * 7 + 1}", f"id{k * 5}", "common1", "common2", "common3"]) for k in range(1, 15)], "query_id long, words array<string>")
    counts = {}
    assert listed(index.search(queries, 2, counts=counts)) == listed(retrieve.bm25(rows, "doc_id", "text", queries, 2))
    assert counts["read"] < counts["all"] / 4


def test_empty(spark, index):
    assert index.search(asked(spark)).collect() == []
    index.refresh(spark.createDataFrame([(1, None), (None, "abc")], "doc_id long, text string"), "doc_id", "text")
    assert index.search(asked(spark)).collect() == []
    assert index.search(asked(spark).limit(0)).collect() == []


def test_many_words_are_joined_without_a_push(spark, index, monkeypatch):
    from quillmill.operators import search_index

    docs = spark.createDataFrame(list(enumerate(texts(1, 60))), "doc_id long, text string")
    index.refresh(docs, "doc_id", "text")
    few = listed(index.search(asked(spark)))
    monkeypatch.setattr(search_index, "PUSHED", 2)
    assert listed(index.search(asked(spark))) == few


def test_words_are_dealt_once(spark):
    """a segment's texts are shuffled once, by slice; each (document, term) was shuffled three times before."""
    from quillmill.operators.search_index import postings

    docs = spark.createDataFrame([(k, f"word{k % 3} and word{k % 5}") for k in range(300)], "doc_id long, text string")
    blocks = postings(docs, "doc_id", "text")[0]
    assert blocks._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1
    rows = blocks.selectExpr("term", "slice", "inline(docs)").collect()
    assert len({(r.term, r.slice) for r in rows}) == blocks.count() and sum(r.tf for r in rows) == 900


def test_many_pairs_are_not_shuffled(spark, index, monkeypatch):
    """beyond FEW pairs, slices are dealt once and scored where they lie; the rows are the same."""
    from quillmill.operators import search_index

    docs = spark.createDataFrame(list(enumerate(texts(1, 90))), "doc_id long, text string")
    index.refresh(docs, "doc_id", "text")
    index.refresh(docs.where("doc_id % 3 = 1").selectExpr("doc_id", "text || ' w40x' as text"), "doc_id", "text")
    few, counts = listed(index.search(asked(spark), 2)), {}
    monkeypatch.setattr(search_index, "FEW", -1)
    monkeypatch.setattr(search_index, "ASKED", 20)
    many = index.search(asked(spark), 2, counts=counts)
    plan = many._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and "SortMergeJoin [query_id" not in plan
    assert listed(many) == few and 0 < counts["read"] <= counts["all"]
