"""The queries themselves on the smallest tables, against brute force."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest

pytest.importorskip("quillmill.llm")

from quillmill.llm import common, decontam, licenses, packing, registry, secrets, simhash, tokens_io  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


@pytest.fixture(scope="module")
def ids(docs):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(common.vocabulary_path())
    return {d: tokenizer.encode(t, add_special_tokens=False).ids for d, t in docs.items()}


def crc(values):
    return zlib.crc32(np.array(values, "<u4").tobytes())


def test_names():
    assert [n.split("_")[0] for n in registry.queries()] == [f"op{k}" for k in range(1, 14)]


def test_op1(spark):
    sf = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{sf}/documents.parquet")
    docs = {r.doc_id: r.text or "" for r in rows.select("doc_id", "text").collect()}
    got = {r.doc_id: r for r in secrets.op1_secret_scans(spark, sf).collect()}
    assert set(got) == set(docs)
    crf, any_base = secrets.model(), 0
    for d, t in docs.items():
        assign = [("assign", *m.span()) for m in re.finditer(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t) if len(m[2]) >= 8]
        access = [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
        hexes = [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
        base = sorted(assign + access + hexes, key=lambda s: (s[1], ("assign", "access", "hex").index(s[0])))
        more = [("crf", a, b) for a, b in crf.spans(t) if not any(a < y and x < b for _, x, y in base)]
        every = sorted(base + more, key=lambda s: (s[1], ("assign", "access", "hex", "crf").index(s[0])))
        text = lambda spans: ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        r = got[d]
        assert (r.n_assign, r.n_access, r.n_hex, r.spans) == (len(assign), len(access), len(hexes), text(every))
        assert r.base_sha256 == hashlib.sha256(text(base).encode()).hexdigest()
        any_base += len(base)
    assert any_base
    # the general operator says the same
    assert all(secrets.joined([(s.start, s.end, s.kind) for s in r.spans]) == got[r.doc_id].spans for r in secrets.scan_secrets(rows).collect())


def test_op1_on_odd_rows(spark):
    rows = spark.createDataFrame([(None, None, 1), (1, "", 2), (2, "token=abcdefgh1", 3), (2, "token=abcdefgh1", 3)], "doc_id long, text string, spans int")
    got = Counter((r.doc_id, secrets.joined([(s.start, s.end, s.kind) for s in r.spans])) for r in secrets.scan_secrets(rows).collect())
    assert got == Counter([(None, ""), (1, ""), (2, "assign:0:15"), (2, "assign:0:15")])
    assert secrets.scan_secrets(rows.limit(0)).count() == 0


def test_op2(spark, ids):
    got = packing.op2_best_fit_packing(spark, SF).collect()
    want = Counter()
    for d, own in ids.items():
        own = [*own, 0]
        for k in range(0, len(own), 2048):
            want[(d, k // 2048, k, len(own[k : k + 2048]), crc(own[k : k + 2048]))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    hist = Counter(r.length for r in got)
    assert len(bins) == packing.plan(dict(hist)).bins >= packing.lower_bound(dict(hist), 2048)


def test_op3(spark, docs):
    got = {(r.doc_id, r.license): (r.at_word, round(r.containment, 9)) for r in licenses.op3_license_scans(spark, SF).collect()}
    scanner, want = licenses.Scanner(), {}
    for d, t in docs.items():
        s = licenses.shingles(t)
        for name, own in scanner.templates:
            parts = set(own.tolist())
            at = [i for i in range(len(s)) if int(s[i]) in parts]
            best = max(((len(parts & set(s[i : i + len(own)].tolist())) / len(parts), -i) for i in at), default=(0, 0))
            if best[0] >= 0.8:
                want[(d, name)] = (-best[1], round(best[0], 9))
    assert got == want and want


def test_op3_on_odd_rows(spark):
    mit = licenses.templates()["MIT"]
    rows = spark.createDataFrame([(None, None, "x"), (1, "", "x"), (2, "so " * 40 + mit, "x"), (2, "so " * 40 + mit, "x"), (3, "word " * 50_000 + mit, "x")], "doc_id long, text string, license string")
    got = Counter((r.doc_id, r.license, r.at_word) for r in licenses.scan_licenses(rows).collect())
    assert got == Counter([(2, "MIT", 40), (2, "MIT", 40), (3, "MIT", 50_000)])
    assert licenses.scan_licenses(rows.limit(0)).count() == 0


def test_op4(spark, ids):
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in tokens_io.op4_token_binary_output(spark, SF).collect()}
    start, want = 0, {}
    for d in sorted(ids):
        own = [*ids[d], 2]
        want[d] = (start, len(own), crc(own))
        start += len(own)
    assert got == want


def test_one_doc_id_fills_many_shards(spark, tmp_path):
    rows = spark.range(4000).selectExpr("7L as doc_id", "concat('text ', id) as text")
    segments = tokens_io.write_tokens(rows, f"{tmp_path}/tokens", common.vocabulary_path(), partitions=8)
    sizes = [r.n_docs for r in segments.collect()]
    assert len(sizes) >= 6 and max(sizes) < 1500 and sum(sizes) == 4000
    starts = sorted((r.start, r.n_tokens) for r in tokens_io.read_tokens(segments).collect())
    assert all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:]))


def test_a_long_text_is_cut_at_spaces_only():
    import pyarrow as pa
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(common.vocabulary_path())
    text = "Don't stop é 12 中文 now.\n" * 120_000
    assert [*common.chunks("ab cd ef", 3)] == ["ab cd", " ef"] and "".join(common.chunks(text)) == text
    for some in (text, text.replace("中文", "")):
        (_, ids, edge), *rest = common.encoder(common.vocabulary_path()).encode_column(pa.array([some]))
        assert not rest and edge.tolist() == [0, len(ids)] and ids.tolist() == tokenizer.encode(some, add_special_tokens=False).ids


def test_op5(spark, docs):
    from tests.llm.test_operators import brute_components, brute_fingerprint

    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.op5_simhash_near_dedup(spark, SF).collect()}
    pairs = [(d, brute_fingerprint(t)) for d, t in docs.items()]
    component = dict(brute_components(pairs))
    assert got == {d: (f"{f:016x}", component[d]) for d, f in pairs}


def test_op9(spark, docs):
    got = {(r.doc_id, r.item_id): r.distance for r in decontam.op9_benchmark_decontamination(spark, SF).collect()}
    items = [(b.item_id, b.text) for b in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = {}
    for d, t in docs.items():
        words = decontam.words_of(t)
        for item, text in items:
            own = decontam.words_of(text)
            if sum(w in set(words) for w in own) >= 0.8 * len(own):
                prev = [0] * (len(words) + 1)
                for i, x in enumerate(own, 1):
                    now = [i]
                    for j, y in enumerate(words, 1):
                        now.append(min(prev[j] + 1, now[-1] + 1, prev[j - 1] + (x != y)))
                    prev = now
                if min(prev) <= int(0.2 * len(own)):
                    want[(d, item)] = min(prev)
    assert got == want and want


def test_odd_items(spark):
    text = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi"
    bench = spark.createDataFrame([(None, text, 1), (4, None, 1), (5, "", 1), (6, text, 1), (6, text, 1), (7, " ".join(f"w{k}" for k in range(5000)), 1)], "item_id long, text string, doc_id int")
    rows = spark.createDataFrame([(1, "so it is " + text, 0), (2, None, 0), (3, " ".join(f"w{k}" for k in range(20, 5000)), 0)], "doc_id long, text string, distance int")
    got = Counter((r.doc_id, r.item_id, r.distance) for r in decontam.find_leaks(rows, bench).collect())
    assert got == Counter([(1, None, 0), (1, 6, 0), (1, 6, 0), (3, 7, 20)])
    assert [r.doc_id for r in decontam.drop_leaks(rows, bench).collect()] == [2]


def test_full_memory_keeps_what_is_still_asked(monkeypatch):
    """A word memory that is full is not emptied at once: what it held is made once more only if it stays unasked."""
    monkeypatch.setattr(common, "CACHE_WORDS", 4)
    made = []
    held = common._Recent(lambda key: made.append(key) or key.encode())
    for key in ["a", "b", "c", "d", "e", "a", "f", "g", "a"]:
        assert held[key] == key.encode()
    assert made.count("a") == 1
    assert len(held) <= 4 and len(held._older) <= 4
