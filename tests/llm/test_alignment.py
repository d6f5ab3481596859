"""Alignment of two tokenizers against whole texts encoded by the libraries and compared byte by byte."""

import hashlib
import random
from collections import Counter

import pytest

pytest.importorskip("quillmill.llm")

from quillmill.llm import alignment, common  # noqa: E402
from quillmill.llm.units import UNIT_CASES  # noqa: E402

SF = "/root/testdata/sf0.001"
A, B = common.vocabulary_path("byte_bpe_50k.json"), common.vocabulary_path("piece_bpe_32k.model")


def byte_level():
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(rest)}


def whole_tokens():
    """text -> (A's ids and bytes, B's ids and bytes), by the libraries, from the whole text."""
    import sentencepiece
    from tokenizers import Tokenizer

    a, b, back = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B), byte_level()
    a.encode_special_tokens = True

    def run(text):
        left = [(i, bytes(back[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
        right = [(i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()) for i in b.encode(text) for p in [b.id_to_piece(i)]]
        return left, right

    return run


def plain(rows):
    """The contract over (doc_id, text) rows, one token after another."""
    tokens, told, counts = whole_tokens(), [], Counter()
    for d, text in rows:
        left, right = tokens(text) if text else ([], [])
        want = (" " + (text or "")).encode()
        if not text or b"".join(x for _, x in left) != want or b"".join(x for _, x in right) != want:
            told.append((d, 0, 0, 0, [], ""))
            continue
        spans = []
        for side in (left, right):
            at, own = 0, []
            for i, x in side:
                own.append((at, at + len(x), i))
                at += len(x)
            spans.append(own)
        links, k = [], 0
        for s, e, i in spans[0]:
            while spans[1][k][1] <= s:
                k += 1
            m = k
            while m < len(spans[1]) and spans[1][m][0] < e:
                links.append((i, spans[1][m][2]))
                m += 1
        counts.update(links)
        cuts = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
        groups, ends = [], [0, *cuts]
        x = y = 0
        for stop in ends[1:]:
            own = [[], []]
            while x < len(spans[0]) and spans[0][x][1] <= stop:
                own[0].append(spans[0][x][2])
                x += 1
            while y < len(spans[1]) and spans[1][y][1] <= stop:
                own[1].append(spans[1][y][2])
                y += 1
            groups.append("|".join(",".join(map(str, z)) for z in own))
        told.append((d, len(left), len(right), len(cuts), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    most = {}
    for (_, b), n in counts.items():
        most[b] = max(most.get(b, 0), n)
    return Counter((d, na, nb, ng, len(ln), sum(counts[p] == most[p[1]] for p in ln), sum(counts[p] for p in ln), sha) for d, na, nb, ng, ln, sha in told)


def got(df):
    return Counter((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in df.collect())


def odd_rows():
    rng = random.Random(8)
    signs = ["a", "Zoë", "é", "ß", "don't", "I'LL", "x1", "42", "½", "²", ".", "'", "_", "(", "…", "—", "漢字", "ไทย", "कि", "🙂", " ", "  ", "\n", "\t", "\r\n", ");\r", "\xa0", "　", "\x1c", "\x85", "\x00", "<|endoftext|>", "<s>", "<0x41>", "▁", "ﬁ"]
    made = ["".join(rng.choice(signs) for _ in range(rng.randint(1, 25))) for _ in range(600)]
    return list(enumerate([None, *UNIT_CASES, *made, "ab, " * 2000, "x" * 3000, "漢" * 3000, " " * 100])) + [(None, "same text."), (None, "same text."), (7, "same text."), (7, "other")]


def test_units_alone_are_units_in_texts():
    from quillmill.llm.units import units

    a, b, whole = alignment.ByteLevel(A), alignment.Pieces(B), whole_tokens()
    for _, text in odd_rows():
        if text and b.exact(text):
            found = units(" " + text)
            left, right = whole(text)
            assert [i for x in a.ids(found) for i in x] == [i for i, _ in left], text
            assert [i for x in b.ids(found) for i in x] == [i for i, _ in right], text


@pytest.mark.parametrize("chunk_bytes,broadcast_pairs", [(300, 10_000), (alignment.CHUNK, 0)])
def test_odd_rows(spark, chunk_bytes, broadcast_pairs):
    rows = odd_rows()
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, words string")
    assert got(alignment.align(docs, A, B, chunk_bytes, broadcast_pairs)) == plain(rows)


def test_no_row_is_a_chunk(spark):
    """at the end a row is one text or one unit; a chunk's units were one array before, some 40 MB each, many in a task."""
    docs = spark.createDataFrame([(d, f"some text {d} of a chunk") for d in range(50)], "doc_id long, text string")
    plan = alignment.align(docs, A, B)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and "array_sort" not in plan
    sizes = alignment.chunked(docs.coalesce(1), B).selectExpr("count(doc_id) texts", "count(word) units", "max(size(units)) longest").first()
    assert sizes.texts == 50 and sizes.units > 50 and sizes.longest <= 7


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.align(docs, A, B).collect() == []


def test_op11(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert got(alignment.op11_cross_tokenizer_alignment(spark, SF)) == plain(rows)
