"""Rules on literal cases."""

import random

import pytest
from pyspark.sql import functions as F

from quillmill.functions import text as tx
from quillmill.operators import amounts, classify, decide, entities, graph, prices, retrieve, segment
from quillmill.streaming import jobs


def one(spark, text):
    return spark.createDataFrame([(1, text)], "id int, t string")


@pytest.mark.parametrize(
    ("text", "kind", "status"),
    [
        ("Rechnung Rechnungsnummer 4711 Rechnungsbetrag 119,00 EUR zahlbar sofort", "Rechnung", "CLASSIFIED"),
        ("Gutschrift Nummer 12, Gutschriftsbetrag wird erstattet", "Gutschrift", "CLASSIFIED"),
        ("Lieferschein Nr 12 Lieferdatum heute, Wareneingang geprüft", "Lieferschein", "CLASSIFIED"),
        ("Kontoauszvg mit Buchungsdatum, alter Kontostand und neuer Kontostand", "Kontoauszug", "CLASSIFIED"),
        ("Unser Newsletter: zum Abmelden bitte hier klicken, Rabatt sichern", "Werbung / Newsletter", "CLASSIFIED"),
        ("Stornorechnung zur Stornierung der Bestellung vom Montag", "Stornorechnung", "CLASSIFIED"),
        ("Tankstelle Nord: 40 Liter Diesel an Zapfsäule 4, Preis je Liter 1,50", "Tankbeleg", "CLASSIFIED"),
        ("ganz gewöhnlicher Text über das schöne Wetter im Norden", "Sonstiges", "CLASSIFIED"),
        ("abc", "Unlesbar", "INSUFFICIENT_TEXT"), ("", "Unlesbar", "INSUFFICIENT_TEXT"), (None, "Unlesbar", "INSUFFICIENT_TEXT"),
        ("Der Vertrag und die Versicherung liegen diesem Schreiben bei", "Vertrag", "AMBIGUOUS"),
    ],
)
def test_types(spark, text, kind, status):
    r = classify.classify(one(spark, text), "t").first()
    assert (r.document_type, r.status) == (kind, status)


def test_booking(spark):
    text = "Rechnung Rechnungsnummer 4711 Rechnungsbetrag 119,00 EUR Rechnungsdatum heute"
    assert classify.classify(one(spark, text), "t").first().automatic_booking_allowed
    assert not classify.classify(one(spark, text + " IBAN"), "t").first().automatic_booking_allowed


@pytest.mark.parametrize(
    ("text", "guard"),
    [
        ("Sparkasse Kontoauszug Auszug-Nr 3 Kontonummer 1 Buchungsdatum", "bank_statement_guard"), ("Hinweis zum Einlagensicherungsfonds", "bank_terms_guard"), ("Please verify your email", "system_notification_guard"),
        ("Our privacy policy has changed", "contract_terms_guard"), ("Ihre QUITTUNG", "digital_receipt_guard"), ("Sparkasse Kontoauszug", None), (None, None),
    ],
)
def test_guards(spark, text, guard):
    assert one(spark, text).select(classify.guard(F.col("t"))).first()[0] == guard


@pytest.mark.parametrize(("subject", "intent"), [("Ihre Rechnung", "RECHNUNG_INVOICE"), ("Preisanpassung zum Juli", "PREIS_ERHOEHUNG"), ("Fehlmenge", "LIEFERSCHEIN_DISCREPANCY"), ("Mahnung", "MAHNUNG_ZAHLUNGSERINNERUNG"), ("Hallo", "ALLGEMEINE_ANFRAGE"), (None, "ALLGEMEINE_ANFRAGE")])
def test_intents(spark, subject, intent):
    assert one(spark, subject).select(classify.email_intent(F.col("t"), F.lit(None).cast("string"))).first()[0] == intent


@pytest.mark.parametrize(("sender", "name"), [('"Metro AG" <a@metro.de>', "Metro AG"), ("info@metro.de", "Metro"), ("", "Unbekannter Lieferant"), ("Metro", "Metro")])
def test_senders(spark, sender, name):
    assert one(spark, sender).select(classify.sender_name(F.col("t"))).first()[0] == name


@pytest.mark.parametrize(("raw", "value"), [("1.234,56", 1234.56), ("1,234.56", 1234.56), ("12,5", 12.5), ("1OO,00", 100.0), ("12,50-", -12.5), ("-3.10", -3.1), ("1 234,56", 1234.56), ("abc", None)])
def test_amount_formats(spark, raw, value):
    assert one(spark, raw).select(amounts.parse_amount(F.col("t"))).first()[0] == value


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Netto 100,00\nMwSt 19% 19,00\nGesamtbetrag 119,00", (100.0, 19.0, 119.0, [19.0], True, False)),
        ("Nettobetrag 100,00\nUmsatzsteuer 7,00\nBrutto 107,00 EUR", (100.0, 7.0, 107.0, [7.0], True, False)),
        ("Netto 7% 100,00\nNetto 19% 200,00\nMwSt 7% 7,00\nMwSt 19% 38,00\nGesamtbetrag 345,00", (100.0, 7.0, 345.0, [7.0, 19.0], True, False)),
        ("Netto 100,00\nGesamtbetrag 100,00", (100.0, None, 100.0, [0.0], True, False)),
        ("Netto 100,00\nMwSt 19,00\nGesamtbetrag 119,00\nGesamtbetrag 130,00", (100.0, 19.0, 119.0, [19.0], True, True)),
        ("Netto 100,00\nGesamtbetrag 150,00", (None, None, None, [], False, True)),
    ],
)
def test_amount_solver(spark, text, want):
    found = amounts.candidates(one(spark, text), "id", "t")
    r = amounts.solve(found.withColumn("doc_id", F.col("doc_id").cast("long"))).first()
    assert (r.net, r.tax, r.gross, sorted(r.rates), r.math_valid, r.conflict) == want


def test_page_markers_and_currency(spark):
    rows = amounts.candidates(one(spark, "--- SEITE 1 ---\nNetto 1,00 EUR\n--- SEITE 2 ---\nBrutto 2,00"), "id", "t").orderBy("line_number").collect()
    assert [(r.page_no, r.line_number, r.currency, r.field_type) for r in rows] == [(1, 2, "EUR", "net"), (2, 4, "EUR", "gross")]


INVOICE = "Rechnung Rechnungsnummer: {} Seite {} von {} mit einigen weiteren Worten auf der Seite"


@pytest.mark.parametrize(
    ("pages", "ranges"),
    [
        ([INVOICE.format("A1", 1, 2), INVOICE.format("A1", 2, 2), INVOICE.format("B1", 1, 1)], [(1, 2), (3, 3)]),
        ([INVOICE.format("A1", 1, 2), "Übertrag Seite 2 von 2 Rechnungsnummer: A1 Gesamtbetrag: 10,00 EUR"], [(1, 2)]),
        ([INVOICE.format("A1", 1, 1), "", INVOICE.format("A2", 1, 1)], [(1, 1), (3, 3)]),
        ([INVOICE.format("A1", 1, 1)], [(1, 1)]), ([""], []),
    ],
)
def test_boundaries(spark, pages, ranges):
    df = spark.createDataFrame([("s", k, p) for k, p in enumerate(pages, 1)], "src string, page int, t string").repartition(4)
    t = segment.transitions(df, "src", "page", "t")
    assert sorted((r.start_page, r.end_page) for r in segment.documents(t, "src", "page").collect()) == ranges
    content = {r.page for r in t.collect()}
    blank = {r.page for r in segment.page_classes(df, "src", "page", "t").where("page_class <> 'CONTENT'").collect()}
    assert content | blank == set(range(1, len(pages) + 1)) and not content & blank


def test_gaps_and_repeated_pages(spark):
    rows = segment.page_classes(spark.createDataFrame([("a", 1, "x"), ("a", 3, "x"), ("b", 1, "x"), ("b", 1, "x")], "s string, p int, t string"), "s", "p", "t")
    assert {(r.s, r.has_gap, r.has_duplicate) for r in rows.collect()} == {("a", True, False), ("b", False, True)}


GOOD = dict(input_valid=True, chars=400, has_text=True, ocr=0.95, boundary=0.95, duplicate=False, boundary_conflict=False, kind="Rechnung", kind_status="CLASSIFIED", kind_conf=0.95, net=100.0, tax=19.0, gross=119.0, math_valid=True, math_diff=0.0, amount_conf=0.95, amount_conflict=False, currency_conflict=False, supplier_value="M", supplier_conf=0.95, supplier_conflict=False, number_value="1", number_conf=0.92, number_conflict=False)


@pytest.mark.parametrize(
    ("change", "route", "why"),
    [
        ({}, "FAST_LANE", []), ({"input_valid": False}, "REJECTED", ["invalid_input"]), ({"chars": 0, "has_text": False}, "REJECTED", ["no_pages"]), ({"ocr": 0.6, "duplicate": True}, "MANUAL_REVIEW", ["low_ocr_score", "duplicate_warning"]),
        ({"kind": " MAHNUNG "}, "MANUAL_REVIEW", ["protected_document_type"]), ({"supplier_value": "unknown"}, "TARGETED_LLM", ["supplier"]), ({"net": None, "tax": None, "gross": None}, "FULL_LLM", ["net", "tax", "gross"]), ({"math_diff": 0.03}, "TARGETED_LLM", ["amount_details"]), ({"ocr": 0.72}, "FULL_LLM", []),
    ],
)
def test_routes(spark, change, route, why):
    row = GOOD | change
    types = {"input_valid": "boolean", "chars": "int"} | {k: "double" for k in ("ocr", "boundary", "kind_conf", "net", "tax", "gross", "math_diff", "amount_conf", "supplier_conf", "number_conf")} | {k: "string" for k in ("kind", "kind_status", "supplier_value", "number_value")}
    df = spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} {types.get(k, 'boolean')}" for k in row))
    r = decide.route(df).first()
    assert r.route == route and (r.blocking_reasons or r.missing_fields) == why
    if route == "FAST_LANE":
        assert r.route_confidence == 0.92 and r.saved_llm_call is True
    if route == "TARGETED_LLM":
        assert r.estimated_tokens == 100 + 250 + 80 * len(why)
    assert decide.route_summary(decide.route(df)).first()[route.lower()] == 1
    assert decide.route_summary(decide.route(df.limit(0))).first().fast_lane_share == 0


def test_names_and_folders(spark):
    row = one(spark, "Brief an Anna Muster")
    day = F.lit("2026-05-14").cast("date")
    assert row.select(decide.destination(F.col("t"), F.lit("Metro"), day, F.lit("Rechnung"), ("acme",), "muster")).first()[0] == "05_Privat_Familie/Anna_Muster/2026"
    assert row.select(decide.destination(F.col("t"), F.lit("ACME"), day, F.lit("Rechnung"), ("acme",), "muster")).first()[0] == "01_Eingangsarchiv/2026/05_Mai/Rechnungen"
    assert row.select(decide.file_name(F.lit("2026-05-14"), F.lit("Metro AG"), F.lit(142.5), F.lit("PASSED"), F.lit("2026-01-01"))).first()[0] == "2026-05-14_Metro_AG_142.50.pdf"
    assert row.select(decide.file_name(F.lit("2026-07-01"), F.lit("Metro"), F.lit(1.0), F.lit("PASSED"), F.lit("2026-01-01"))).first()[0] == "2026-01-01_UNKNOWN_Metro.pdf"


def test_text_functions(spark):
    get = lambda c, t: one(spark, t).select(c).first()[0]
    c = F.col("t")
    assert get(tx.match_key(c), "Straße 12 Müller") == "strasse12muller"
    assert get(tx.normalize_text(c), "  Hämmer  &  Söhne GmbH") == "hämmer söhne gmbh"
    assert get(tx.slug(c), "Käse & Co.") == "k-se-co" and get(tx.slug(c), "***").startswith("unbekannt-")
    assert get(tx.mask(c), "DE123456") == "****3456" and get(tx.mask(c), "abc") == "***"
    assert get(tx.redact(c), "token=abc a@b.de DE12345678901234567890") == "token=[REDACTED] [EMAIL-REDACTED] [IBAN-REDACTED]"
    assert get(tx.german_decimal(c), "1.234,50") == 1234.5 and get(tx.german_decimal(c), "x") is None
    assert get(tx.iso_date(c), "14.05.2026") == "2026-05-14" and get(tx.iso_date(c), "14.5.26") is None
    assert get(tx.query_words(c), "Die Rechnung der Metro, Metro 12345") == ["metro", "12345"]
    assert get(tx.formula_guard(c), "=1+1") == "'=1+1"
    assert get(prices.normalize_unit(c), "Kilo") == "kg" and get(prices.normalize_unit(c), " Stück ") == "Stück"


def test_unicode_forms(spark):
    import unicodedata

    get = lambda c, t: one(spark, t).select(c).first()[0]
    for t in ("Ｍｅｔｒｏ ①②", "ﬁnanz Ł", "Cafe\u0301 Ñandú", "Ångström ĳs", "Müller-Lüdenscheidt Nr. ５"):
        assert get(tx.normalize_text(F.col("t")), t).replace("e\u0301", "é") in (" ".join(__import__("re").findall(r"\w+", unicodedata.normalize("NFKC", t).casefold())), " ".join(__import__("re").findall(r"\w+", unicodedata.normalize("NFKC", t).casefold())).replace("é", "e"))
        want = "".join(x for x in unicodedata.normalize("NFKD", t.casefold()) if not unicodedata.combining(x) and x.isalnum()).replace("ł", "l")
        assert get(tx.match_key(F.col("t")), t) == want
    assert get(tx.expected_decimal(F.col("t")), "1.234,50") == 1234.5 and get(tx.expected_decimal(F.col("t")), "12.50") == 12.5 and get(tx.page_digits(F.col("t")), "x1") is None
    assert get(tx.safe_id(F.col("t")), "/a b/1!") == "a_b_1" and get(tx.question_slug(F.col("t")), "Wie viel? 10 Äpfel!") == "wie_viel__10_äpfel"


def test_chunks_pack_paragraphs(spark):
    parts = ["a" * 150, "b" * 200, "c" * 100, "", "d" * 500]
    got = [r.chunk for r in retrieve.chunks(one(spark, "\n\n".join(parts)), "id", "t").orderBy("chunk_no").collect()]
    assert got == [f"{parts[0]}\n\n{parts[1]}", parts[2], parts[4]]
    got = [r.chunk for r in retrieve.chunks(one(spark, " a0 . b1 . c2"), "id", "t", 3, ".").orderBy("chunk_no").collect()]
    assert got == ["a0", "b1", "c2"]  # the separator is no pattern, and digits stay


def test_containment_against_python(spark):
    from quillmill.operators.containment import contained

    r = random.Random(4)
    texts = [(k, "".join(r.choice("abcä ") for _ in range(r.randint(0, 60)))) for k in range(40)] + [(99, None)]
    keys = sorted({"".join(r.choice("abcä ") for _ in range(r.randint(1, 4))) for _ in range(60)})
    df, names = spark.createDataFrame(texts, "id long, t string"), spark.createDataFrame([(k,) for k in keys], "key string")
    want = {(i, k) for i, t in texts for k in keys if k in (t or "")}
    for block in (1 << 20, 20):  # one block, and many
        assert {tuple(x) for x in contained(df, "id", F.col("t"), names, block).collect()} == want
    assert contained(df, "id", F.col("t"), names.limit(0)).count() == 0


def test_suppliers_by_words(spark):
    from quillmill.operators import assign

    docs = spark.createDataFrame([(1, "Lieferung der Müller\n  Feinkost GmbH"), (2, "feinkostladen müllerstraße"), (3, "nur feinkost"), (4, "ABC"), (5, None)], "doc_id long, t string")
    names = spark.createDataFrame([(1, "Müller Feinkost GmbH"), (2, "Feinkost"), (3, "ABC")], "id long, name string")
    assert {r.doc_id: r.supplier_id for r in assign.supplier_of(docs, "doc_id", "t", names, "id", "name").collect()} == {1: 1, 2: 1, 3: 2}


def test_plain_boundaries(spark):
    from quillmill.operators import stack

    pages = ["Rechnung 1 Seite 1 von 2", "Seite 2 Rechnung Übertrag", "Rechnung 2 Seite 1 von 1", "ohne Marke", "weiter"]
    df = spark.createDataFrame([("s", k, t) for k, t in enumerate(pages, 1)], "s string, p int, t string")
    got = sorted((r.start_page, r.end_page) for r in stack.plain_boundaries(df, "s", "p", "t").collect())
    assert got == [(1, 2), (3, 3), (4, 5)]


def test_wiki_paths_and_health(spark):
    from quillmill.operators import wiki

    rows = spark.createDataFrame([("a/b", "./../c.md"), ("", "x.md"), ("a", "../../c.md")], "f string, t string")
    assert [r[0] for r in rows.select(wiki.joined_path(F.col("f"), F.col("t"))).collect()] == ["a/c.md", "x.md", None]
    front = '---\nentity_id: "{}"\nentity_type: nation\ncanonical_name: x\nsource_count: 0\nupdated: x\n---\n'
    pages = spark.createDataFrame([("a.md", front.format("a") + "# A\n[[b]]"), ("b.md", front.format("b") + "# B\n[x](./a.md)"), ("index.md", "x")], "path string, text string")
    assert wiki.lint_status(wiki.lint(pages)) == "HEALTHY" and wiki.lint_status(wiki.lint(pages.where("path <> 'b.md'"))) == "ISSUES_FOUND"
    assert wiki.lint(pages.limit(0)).count() == 0


def test_vectors_replace_and_append(spark):
    from quillmill.operators import records

    old = spark.createDataFrame([("d1_chunk_0", "d1"), ("d1_chunk_1", None), ("d2_chunk_0", "d2")], "id string, doc_id string")
    new = spark.createDataFrame([("d1_chunk_0", "d1")], "id string, doc_id string")
    assert sorted(r.id for r in records.replace_vectors(old, new).collect()) == ["d1_chunk_0", "d2_chunk_0"]
    assert records.append_vectors(old, new).count() == 4 and records.append_vectors(old, new, once=True).count() == 3


def test_entities_against_union_find(spark):
    r = random.Random(2)
    rows = [(i, f"a{r.randint(0, 40)}", f"b{r.randint(0, 40)}") for i in range(60)] + [(99, None, "")]
    df = spark.createDataFrame(rows, "id long, a string, b string")
    got = {x.row_id: x.entity for x in entities.resolve_entities(entities.identity_keys(df, "id", {"a": F.col("a"), "b": F.col("b")})).collect()}
    label = {i: i for i, _, _ in rows[:-1]}
    changed = True
    while changed:
        changed = False
        for i, a, b in rows[:-1]:
            for j, p, q in rows[:-1]:
                if (a == p or b == q) and label[j] < label[i]:
                    label[i], changed = label[j], True
    assert got == label


def test_graph(spark):
    pages = spark.createDataFrame([(1, "[[b]] [[c|x]] [[b]]", "a"), (2, "[[a]]", "b"), (3, "", "d")], "id int, body string, slug string")
    e = graph.links(pages, "id", "body", graph.WIKILINK)
    assert {tuple(r) for r in e.collect()} == {(1, "b"), (1, "c"), (2, "a")}
    assert [r.target for r in graph.broken(e, pages.select(F.col("slug").alias("target"))).collect()] == ["c"]
    assert [r.slug for r in graph.orphans(pages, "slug", e).collect()] == ["d"]


def test_price_upsert(spark):
    ddl = "supplier string, item string, unit string, document_id string, price double, recorded_at int"
    old = spark.createDataFrame([("s", "i", "kg", "d1", 1.0, 1), ("s", "i", "kg", "", 2.0, 2)], ddl)
    new = spark.createDataFrame([("s", "i", "kg", "d1", 3.0, 9), ("s", "i", "kg", "", 4.0, 9)], ddl)
    got = sorted((r.document_id, r.price, r.recorded_at) for r in prices.upsert_prices(old, new, ["supplier", "item", "unit", "document_id"]).collect())
    assert got == [("", 2.0, 2), ("", 4.0, 9), ("d1", 3.0, 1)]


def test_reconcile(spark):
    rows = [(1, True, ["A"], [], None, True), (2, True, ["A"], [], "A", True), (3, True, [], [], None, True), (4, False, [], [], None, True), (5, True, ["A", "B"], [], None, True), (6, True, ["A"], ["B"], None, True), (7, True, [], ["A", "B"], None, True)]
    df = spark.createDataFrame(rows, "id int, readable boolean, strong array<string>, weak array<string>, current string, role_ok boolean")
    assert [r.status for r in entities.reconcile(df).orderBy("id").collect()] == ["UPDATED", "UNCHANGED", "UNCHANGED", "SOURCE_UNREADABLE", "REVIEW_CONFLICT", "REVIEW_CONFLICT", "REVIEW_CONFLICT"]
    assert [r.status for r in entities.reconcile(df, known=False).orderBy("id").collect()][1:4] == ["NO_CANDIDATE_ENTITIES", "NO_CANDIDATE_ENTITIES", "SOURCE_UNREADABLE"]


def test_job_life():
    s = jobs.fresh()
    for kind, at, worker, target in (("claim", 0, "w", None), ("claim", 1, "x", None), ("complete", 2, "w", "OCR_RUNNING"), ("complete", 3, "w", "COMMITTED"), ("fail", 4, "w", None)):
        s = jobs.apply(s, kind, at, worker, target)
    assert (s["status"], s["attempts"], s["retry_at"], s["rejected"]) == ("RETRY_PENDING", 1, 34.0, 2)
    s = jobs.apply(s, "claim", 40, "x")
    assert (s["status"], s["owner"], s["lease"]) == ("DISCOVERED", "x", 640)
    assert jobs.apply(s, "complete", 700, "x", "OCR_RUNNING")["rejected"] == 3  # the lease is over
    assert jobs.apply(s, "sweep", 700, None)["status"] == "RETRY_PENDING"
    for n in range(5):
        s = jobs.apply(jobs.apply(s, "claim", 10_000 * n + 1000, "y"), "fail", 10_000 * n + 1001, "y")
    assert s["status"] == "FAILED"
    assert jobs.apply(s, "retry", 99_999, None)["attempts"] == 0
