"""Token counts against the library, the filter audit against the filters themselves."""

import random
from collections import Counter
from itertools import permutations

import pytest

pytest.importorskip("quillmill.llm")

from quillmill.llm import common, filter_audit, token_counts  # noqa: E402
from quillmill.llm.units import UNIT_CASES, parts, pieces_respect, units  # noqa: E402

SF = "/root/testdata/sf0.001"
BYTE, PIECE, WORD = "byte_bpe_50k.json", "piece_bpe_32k.model", "word_bpe_49k.json"


def odd_texts():
    rng = random.Random(5)
    signs = ["a", "Zoë", "é", "ß", "don't", "I'LL", "x1", "42", "½", "²", ".", "'", "''s", "_", "(", "…", "—", "漢字", "ไทย", "कि", "🙂", "👩‍👩‍👧", " ", "  ", "\n", "\t", "\r\n", "\xa0", "　", "\x1c", " ", "\x0b", "\x85", "\x00", "<|endoftext|>", "<s>", "<0x41>", "é"]
    made = ["".join(rng.choice(signs) for _ in range(rng.randint(1, 30))) for _ in range(1500)]
    return [*UNIT_CASES, *made, "ab " * 3000, "x" * 5000, "a1" * 2000, " " * 300, "\n" * 300, "<|endoftext|>" * 50]


def library(name):
    path = common.vocabulary_path(name)
    if name.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda t: len(model.encode(t))
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    return lambda t: len(tokenizer.encode(t, add_special_tokens=False).ids)


def test_units_are_the_text():
    for t in odd_texts():
        assert "".join(units(t)) == t and all(units(t))
        assert "".join(parts(t, 7)) == t
        assert [u for p in parts(t, 7) for u in units(p)] == units(t)
    assert pieces_respect(["▁a", "b", ";\r", "▁▁", "é."[:1]]) and not pieces_respect(["a."]) and not pieces_respect(["a▁"])


@pytest.mark.parametrize("name", [BYTE, PIECE, WORD])
def test_counts_equal_the_library(name):
    by, whole = token_counts.Counter(common.vocabulary_path(name)), library(name)
    for t in odd_texts():
        assert by.count([t]) == [whole(t)], t[:80]
        assert by.long(t) == whole(t)
    texts = odd_texts()
    assert by.count(texts) == [whole(t) for t in texts]


def test_parts_and_forgetting_change_nothing(monkeypatch):
    monkeypatch.setattr(token_counts, "CACHE", 3)
    monkeypatch.setattr(token_counts, "CACHE_CHARS", 2)
    by, whole = token_counts.Counter(common.vocabulary_path(BYTE)), library(BYTE)
    for t in odd_texts()[:200]:
        assert sum(by.count([p])[0] for p in parts(t, 5)) == whole(t)


def test_groups_by_bytes():
    import numpy as np

    assert list(token_counts.groups(np.array([5, 5, 1, 30, 2, 2]), 10)) == [(0, 2), (2, 3), (3, 4), (4, 6)]
    assert list(token_counts.groups(np.array([], np.int64), 10)) == []


def test_op13(spark):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    whole = library(BYTE)
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.op13_token_counts(spark, SF).collect()}
    assert got == {d: (len(t.encode()), n := whole(t), n > 512) for d, t in docs.items()}


def test_op13_on_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(token_counts, "GROUP_BYTES", 64)
    long = "word, " * 50_000
    rows = [(None, None, 1), (None, "a b", 1), (1, "", 2), (2, "a b", 3), (2, "a b", 3), (3, long, 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    whole = library(BYTE)
    want = Counter((d, len((t or "").encode()), whole(t or ""), whole(t or "") > 512) for d, t, _ in rows)
    assert Counter(map(tuple, token_counts.count_tokens(docs, common.vocabulary_path(BYTE)).collect())) == want
    assert token_counts.count_tokens(docs.limit(0), common.vocabulary_path(BYTE)).collect() == []


def plain_audit(rows, labels):
    """The filters run one after another over the documents, order by order."""
    words = lambda t: [w for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", t)]
    good, toxic = {d for d, q, _ in labels if q == 1}, {d for d, _, x in labels if x == 1}
    fails = []
    for d, t, _ in rows:
        t = t or ""
        w = words(t)
        f = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t), "D": any(c in "#$%&*|" for c in t)}
        f["E"] = d is not None and any(e is not None and e < d and (u or "") == t for e, u, _ in rows)
        fails.append({k for k, v in f.items() if v})
    out, shapley = {}, Counter()
    for part in {s or "" for *_, s in rows}:
        own = [(d, f) for (d, _, s), f in zip(rows, fails) if (s or "") == part]
        for order in permutations("ABCDE"):
            left = own
            for k, x in enumerate(order):
                gone = [d for d, f in left if x in f]
                left = [(d, f) for d, f in left if x not in f]
                early = sum(x in f and bool(f & set(order[:k])) for _, f in own)
                out[part, "".join(order), k + 1] = (len(left), len(gone), early, sum(f == {x} for _, f in own), sum(d in good for d in gone), sum(d in toxic for d in gone))
                shapley[part, x] += len(gone)
    return {key: (*v, shapley[key[0], key[1][key[2] - 1]]) for key, v in out.items()}


def told(df):
    rows = df.collect()
    found = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in rows}
    assert len(found) == len(rows)
    return found


def test_audit_of_made_documents(spark):
    rng = random.Random(9)
    texts = [" ".join(rng.choice(["Word", "other", "third", f"w{k}", "A|B", "ÀÉ"]) for k in range(rng.choice([0, 3, 190, 210, 400]))) for _ in range(25)]
    rows = [(rng.choice([None, *range(40)]), rng.choice([None, "", *texts]), rng.choice([None, "", "web", "book"])) for _ in range(150)]
    labels = [(rng.choice([None, *range(40)]), rng.choice([None, 0, 1]), rng.choice([None, 0, 1])) for _ in range(40)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, source string, part string")
    got = told(filter_audit.audit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")))
    assert got == plain_audit(rows, labels)
    assert {k[0] for k in got} == {"", "web", "book"} and len(got) == 3 * 600


def test_audit_of_empty_tables(spark):
    docs = spark.createDataFrame([(1, None, None)], "doc_id long, text string, source string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert told(filter_audit.audit(docs, labels)) == plain_audit([(1, None, None)], [])
    assert filter_audit.audit(docs.limit(0), labels).collect() == []
