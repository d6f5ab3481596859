"""Cases of the third round's findings."""

from pyspark.sql import functions as F

from quillmill.operators import retrieve, search, segment
from quillmill.plans import catalog
from tests.compare import connect, same


def _tables(spark, folder, **tables):
    """A folder of sample tables, some of them replaced."""
    for name in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        rows = tables.get(name)
        if rows is None:
            (folder / f"{name}.parquet").symlink_to(f"/root/testdata/sf0.001/{name}.parquet")
        else:
            rows.write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_page_of_in_either_case(spark, tmp_path):
    """A last page is marked in either case, as its pattern is."""
    long = " or " + "word " * 80
    rows = [(1, 0, "user", "Er er" + long), (1, 1, "assistant", "plain" + long), (2, 0, "user", "er er" + long), (2, 1, "assistant", "plain" + long)]
    sf = _tables(spark, tmp_path, conversations=spark.createDataFrame(rows, "conv_id long, turn int, role string, text string"))
    for name in ("boundary_transitions", "boundary_documents", "boundary_compare", "useful_documents"):
        same(catalog.queries()[name](spark, sf), connect(sf), catalog.oracle_sql()[name])
    t = segment.transitions(spark.read.parquet(f"{sf}/conversations.parquet"), "conv_id", "turn", "text", segment.Signals(page_of=r"(?i)(er)\s+(er)"))
    assert {r.conv_id for r in t.where("is_boundary").collect()} == {1, 2}


def test_equal_similarities_go_to_the_smaller_id(spark):
    """similarities that differ by the order of a sum are ties."""
    rows = [(k, [0.6 + k * 1e-15, 0.8]) for k in range(9)]
    index = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    queries = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, q array<double>")
    for parts in (1, 4):
        got = retrieve.vector_search(index.repartition(parts), queries, 0.3, 5).collect()
        assert [(r["rank"], r.vec_id) for r in sorted(got, key=lambda r: r["rank"])] == [(k + 1, k) for k in range(5)]


def test_copies_of_a_text_rank_by_id(spark):
    """copies of a text, whatever their place in a batch."""
    text = " ".join(f"w{k % 37}x{k}" for k in range(120))
    docs = spark.createDataFrame([(k, text) for k in range(1500)], "doc_id long, text string")
    found = search.vector_hits(spark.createDataFrame([(1, text)], "query_id long, query string"), docs.orderBy(F.xxhash64("doc_id")), 5)
    assert sorted((r["rank"], r.doc_id) for r in found.collect()) == [(k + 1, k) for k in range(5)]


def test_small_files_are_dealt_to_all_cores(spark):
    """the orders are one small file, but their texts cost much."""
    from quillmill.plans import reports

    for rows in (reports._german(spark, "/root/testdata/sf0.001"), reports._invoices(spark, "/root/testdata/sf0.001")):
        assert rows.rdd.getNumPartitions() >= 4


def test_patterns_and_the_letters_they_need():
    """every match of a rule's pattern holds the letters that are looked for first."""
    from quillmill.operators.classify import needed

    cases = {r"\brechnungs-?nr\.?\b": "rechnungs", r"\bf[aä]llig bis\b": "llig bis", r"\bsuper( e10| e5)?\b": "super", "(kraftstoff|super)": "", "ab|cd": "", "abc?d": "ab", "(?i)abc": "", r"\p{Lu}": "", "abc{0}d": "ab", "a.*bc": "bc", "x[(]abc[)]?": "abc", r"mahn(?!ung)": "mahn"}
    assert {p: needed(p) for p in cases} == cases


def test_amounts_are_found_once_for_an_analysis(spark, monkeypatch):
    """one search for amounts feeds their sums and their currencies."""
    from quillmill.operators import amounts, stack

    calls, real = [], amounts.candidates
    monkeypatch.setattr(amounts, "candidates", lambda *a, **k: calls.append(1) or real(*a, **k))
    docs = spark.createDataFrame([(1, "Metro\nRechnungsnummer: RE-1\nRechnungsdatum 01.02.2024\nNetto 100,00 USD\nMwSt 19,00 EUR\nGesamtbetrag 119,00 EUR")], "id long, t string")
    assert stack.analyse(docs, "id", "t").first()["blocking_reasons"] == ["currency_conflict"] and len(calls) == 1


def test_suppliers_by_whole_names_and_shares_of_words(spark):
    """the suppliers of texts as a plain search finds them; a word that all names have makes no pairs of all."""
    import random
    import re

    from quillmill.operators import assign

    r, pool = random.Random(4), ["gruppe", "nord", "handel", "ostsee", "fisch", "markt", "gmbh", "west"]
    names = [(k, " ".join(r.choice(pool) for _ in range(r.randint(1, 5)))) for k in range(80)]
    texts = [(k, " ".join(r.choice(pool) for _ in range(r.randint(0, 6)))) for k in range(120)]
    want = {}
    for d, t in texts:
        fit = []
        for k, n in names:
            words = [w for w in re.findall(r"\w{4,}", n) if w not in assign.LEGAL_FORMS]
            held = sum(w in t for w in words)
            if len(n) >= 4 and (n in t or words and held >= min(2, len(words)) and held / len(words) >= assign.SHARE):
                fit.append((-len(n), k))
        if fit:
            want[d] = min(fit)[1]
    found = assign.supplier_of(spark.createDataFrame(texts, "d long, t string"), "d", "t", spark.createDataFrame(names, "id long, name string"), "id", "name")
    assert {x.doc_id: x.supplier_id for x in found.collect()} == want and len(want) > 60


def test_median_without_all_values_in_one_task(spark):
    """the median by ranges is the exact one, and the report has no percentile over all values."""
    import random
    import statistics

    from quillmill.operators import measures
    from quillmill.plans import reports

    r = random.Random(1)
    for n in (0, 1, 2, 3, 50, 301):
        for values in ([r.random() for _ in range(n)], [float(r.randint(0, 2)) for _ in range(n)]):
            got = measures.median(spark.createDataFrame([(v,) for v in [*values, None]], "e double"), "e", "m").collect()
            assert len(got) == 1 and (got[0].m is None if n == 0 else abs(got[0].m - statistics.median(values)) < 1e-12)
    assert "percentile(" not in reports.extraction_metrics(spark, "/root/testdata/sf0.001")._jdf.queryExecution().analyzed().toString()


def test_a_report_is_computed_once_for_its_files(spark, monkeypatch):
    """the files of a report are written from its stored row."""
    from quillmill.plans import reports
    from quillmill.sources import sinks

    plans, real = [], sinks.write_report
    monkeypatch.setattr(sinks, "write_report", lambda report, *rest: plans.append(report._jdf.queryExecution().optimizedPlan().toString()) or real(report, *rest))
    reports.extraction_markdown(spark, "/root/testdata/sf0.001")
    assert len(plans) == 1 and "Join" not in plans[0]


def test_pairs_of_questions_and_documents_are_not_shuffled(spark, monkeypatch):
    """what is shuffled grows with postings; blocks of questions give the same rows."""
    import re

    docs = spark.range(400).select(F.col("id").alias("d"), F.concat(F.lit("alpha w"), F.col("id") % 7, F.lit(" x"), F.col("id") % 11).alias("t"))
    asked = spark.range(60).select(F.col("id").alias("query_id"), F.array(F.lit("alpha"), F.concat(F.lit("w"), F.col("id") % 7), F.concat(F.lit("x"), F.col("id") % 11)).alias("words"))
    found = retrieve.bm25(docs, "d", "t", asked, 3)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"hashpartitioning\(query_id#\d+L?, doc_id", plan) and "WindowGroupLimit" in plan
    want = sorted(map(tuple, found.select("query_id", "doc_id", "rank").collect()))
    assert len(want) == 180
    monkeypatch.setattr(retrieve, "ASKED", 40)
    monkeypatch.setattr(retrieve, "PAIRS", 1000)
    assert sorted(map(tuple, retrieve.bm25(docs, "d", "t", asked, 3).select("query_id", "doc_id", "rank").collect())) == want


def test_rounds_of_entities_broadcast_nothing(spark, monkeypatch):
    """each round's joins sent one side, as long as the input, through the driver."""
    from pyspark.sql.classic.dataframe import DataFrame

    from quillmill.operators import entities

    plans, was = [], DataFrame.checkpoint

    def seen(df, *a, **k):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return was(df, *a, **k)

    monkeypatch.setattr(DataFrame, "checkpoint", seen)
    rows = spark.createDataFrame([(k, "a", str(k // 2)) for k in range(20)] + [(k, "b", str((k + 1) // 2)) for k in range(10)], "row_id long, key_type string, key_value string")
    found = {r.row_id: r.entity for r in entities.resolve_entities(rows).collect()}
    assert found == {k: 0 if k < 10 else k // 2 * 2 for k in range(20)} | ({10: 10, 11: 10})
    assert len(plans) > 1 and not any("Broadcast" in p for p in plans)


def test_vectors_of_any_kind_meet_as_arrow(spark):
    """rows of the index were lists of Python numbers; nulls and vectors of another length still have no similarity."""
    from quillmill.operators import retrieve

    index = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 1.0]), (3, None), (4, [1.0]), (5, [0.0, 0.0]), (6, [2.0, 0.0])], "vec_id long, embedding array<float>").coalesce(1)
    asked = spark.createDataFrame([(7, [3.0, 0.0]), (8, [0.0, 1.0])], "query_id long, q array<float>")
    found = retrieve.vector_search(index, asked, 0.3, 2)
    assert "MapInArrow" in found._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.query_id, r["rank"], r.vec_id, round(r.sim, 6)) for r in found.collect()) == [(7, 1, 1, 1.0), (7, 2, 6, 1.0), (8, 1, 2, 0.707107)]


def test_texts_are_searched_once_for_contacts(spark):
    """identifiers were looked for once for the contacts and again for their roles."""
    from quillmill.operators import reconciliation

    docs = spark.createDataFrame([(1, "Rechnung", "f", "s", "an a@x.de", "K 1", None, True), (2, "Einnahme", "f", "s", "an a@x.de", None, "e2", True)], "doc_id long, kind string, file_name string, supplier string, text string, ext_id string, current string, readable boolean")
    ents = spark.createDataFrame([("e1", "supplier", "k1", None, None, None), ("e2", "customer", None, None, None, "a@x.de")], "entity_id string, role string, ext_id string, iban string, tax_id string, email string")
    done = reconciliation.reconcile_documents(docs, ents, spark.createDataFrame([("e1", "Metro AG")], "entity_id string, alias string"))
    assert done._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") <= 3
    got = {r.doc_id: (r.strong, r.reasons, r.status) for r in done.collect()}
    assert got == {1: (["e1", "e2"], ["several_strong", "role_mismatch"][:1], "REVIEW_CONFLICT"), 2: (["e2"], [], "UNCHANGED")}


def test_identifiers_without_their_marks(spark):
    """patterns are asked only of texts that can hold them; what they find is the same."""
    from quillmill.functions import text as tx

    rows = spark.createDataFrame([("de 12 3456789 01234567 x",), ("ATU-12345678",), ("a@b.de c@d.e, A@b.de",), ("nothing 1 here",), ("",), (None,)], "text string")
    ids = tx.strong_ids(rows.text)
    got = [tuple(r) for r in rows.select(*[ids[k] for k in ("ibans", "vat_ids", "emails")]).collect()]
    assert got[:2] == [(["DE12345678901234567X"], [], []), ([], ["ATU12345678"], [])]
    assert got[2:] == [([], [], ["A@b.de", "a@b.de", "c@d.e"]), ([], [], []), ([], [], []), (None, None, None)]
    assert rows.select(ids["emails"])._jdf.queryExecution().optimizedPlan().toString().lower().count("contains(text#") >= 1


def _odd_texts(spark):
    """Texts with accents, marks of their own, letters of two, signs, repeated and null ids, and none."""
    texts = ["Crème brûlée, Straße æsir æon œuvre", "crème BRULEE strasse aesir", "alpha x2y 12 crema_brulee", "", None, "  crème  brulee ", "Ünder ünter under, ÆSIR", "日本 crème 日本語", "alpha beta\u0085gamma"]
    rows = [(k, texts[k % len(texts)]) for k in range(40)] + [(3, "creme brulee under"), (3, "creme alpha"), (5, "aesir aesir")]
    return spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "'de' AS lang", "'web' AS source", "cast(length(text) AS long) AS n_chars")


def test_words_of_texts_are_counted_where_they_lie(spark, tmp_path, monkeypatch):
    """a row for each word of each text was made, joined and shuffled; texts of any kind are counted as the SQL has it."""
    asked = spark.createDataFrame([(1, "Creme brulée strass"), (2, "unter ünd alp"), (3, "aesir æon oeuv"), (4, "日本 gamma x2y"), (5, "und")], "item_id long, text string")
    sf = _tables(spark, tmp_path, documents=_odd_texts(spark).where("text IS NOT NULL"), benchmark=asked)  # the SQL leaves nulls out of the mean length
    plans, real = [], retrieve.materialize
    monkeypatch.setattr(retrieve, "materialize", lambda df, name: plans.append((name, df._jdf.queryExecution().executedPlan().toString())) or real(df, name))
    docs, words = spark.read.parquet(f"{sf}/documents.parquet"), asked.selectExpr("item_id AS query_id", "split(lower(text), ' ') AS words")
    once = docs.dropDuplicates(["doc_id"])
    assert retrieve.bm25(once, "doc_id", "text", words, 5).count() > 10
    assert not any("Generate" in p for name, p in plans if name != "asked") and not any(name in ("terms", "hits") for name, _ in plans)
    want = sorted(map(tuple, retrieve.bm25(docs, "doc_id", "text", words, 5).select("query_id", "doc_id", "rank").collect()))
    monkeypatch.setattr(retrieve, "CELLS", 7)
    monkeypatch.setattr(retrieve, "ASKED", 5)
    assert sorted(map(tuple, retrieve.bm25(docs, "doc_id", "text", words, 5).select("query_id", "doc_id", "rank").collect())) == want
    same(catalog.queries()["bm25_search"](spark, sf), connect(sf), catalog.oracle_sql()["bm25_search"])


def test_words_are_spelt_as_in_columns(spark):
    """the table of letters says what strip_accents says, for all signs that both Unicode versions know."""
    import unicodedata

    from quillmill.functions import text as tx

    signs = [x for x in map(chr, range(32, 0x2C00)) if unicodedata.ucd_3_2_0.category(x) != "Cn"]
    rows = spark.createDataFrame([(f"a{x}b",) for x in signs] + [(f"a{x}bЖ",) for x in signs], "t string").select(tx.casefold(F.col("t")).alias("t"), retrieve.terms(F.col("t")).alias("w")).collect()
    assert [r.t for r in rows if tx.spelt_words(r.t).split() != r.w] == []


def test_fallback_asks_texts_as_the_sql_does(spark, tmp_path, monkeypatch):
    """both of its searches shuffled a row for each word of each text."""
    asked = spark.createDataFrame([(1, "Creme brulée strass"), (2, "unter ünder alpha"), (3, "aesir æon oeuvre")], "item_id long, text string")
    sf = _tables(spark, tmp_path, documents=_odd_texts(spark).dropDuplicates(["doc_id"]), benchmark=asked)
    names, real = [], retrieve.materialize
    monkeypatch.setattr(retrieve, "materialize", lambda df, name: names.append(name) or real(df, name))
    same(catalog.queries()["fts_fallback"](spark, sf), connect(sf), catalog.oracle_sql()["fts_fallback"])
    assert names == ["asked", "counts"] * 2


def test_vectors_of_texts_are_made_where_they_lie(spark, tmp_path):
    """F16: a row for each word of each text was shuffled twice for its vector; repeated ids still add up."""
    docs = _odd_texts(spark)
    words = F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), r"\s+"), lambda w: w != "")
    assert "Exchange" not in retrieve.hash_vectors(docs.dropDuplicates(["doc_id"]).localCheckpoint(), "doc_id", F.lower("text"))._jdf.queryExecution().executedPlan().toString()
    want = {(r.doc_id, r.bucket): r.weight for r in retrieve.hash_embedding(docs, "doc_id", words).collect()}
    got = {}
    for r in retrieve.hash_vectors(docs, "doc_id", F.lower("text")).collect():
        norm = sum(x * x for x in r.embedding) ** 0.5
        got |= {(r.vec_id, k): x / norm for k, x in enumerate(r.embedding) if x}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in got)
    asked = spark.createDataFrame([(1, "Creme brulée strass"), (2, "unter ünder alpha"), (3, "aesir æon oeuvre")], "item_id long, text string")
    sf = _tables(spark, tmp_path, documents=docs, benchmark=asked)
    same(catalog.queries()["hash_vectors"](spark, sf), connect(sf), catalog.oracle_sql()["hash_vectors"])
