"""Field extraction, answers, contacts in order, hub pages."""

import random

from pyspark.sql import functions as F

from quillmill.operators import contacts, extract, records, wiki

TEXT = "Metr0 Großhandel\nRechnungsnummer: RE-4711\nDatum 14.05.2026\nNetto 100,00\nMwSt 19,00\nGesamtbetrag 119,00 EUR"


def fields(spark, text):
    return extract.extract_fields(spark.createDataFrame([(1, text)], "id int, t string"), "t").first()


def test_fields(spark):
    # the net line names a supplier too; the dictionary is tried by length, then in its order
    r = fields(spark, TEXT)
    assert (r.supplier, r.day, r.net, r.tax, r.gross, r.number, r.kind, r.tax_rate, r.field_confidence) == ("Metro", "2026-05-14", 100.0, 19.0, 119.0, "RE-4711", "Rechnung", 19.0, 1.0)
    est = fields(spark, "Lidl Angebot 2026-01-02 Summe 107,00 inkl. 7%")
    assert (est.net, est.tax, est.kind, est.amounts_estimated, est.number) == (100.0, 7.0, "Angebot", True, "UNBEKANNT")
    assert fields(spark, TEXT.replace("19,00\n", "18,00\n")).gross is None
    assert fields(spark, None).supplier is None and fields(spark, "Lidl 1,00 EUR").gross is None


def test_answers(spark):
    get = lambda t: spark.createDataFrame([(t,)], "t string").select(extract.parse_answer(F.col("t")).alias("a")).first().a
    assert get('{"lieferant": "Metro", "brutto": 3.5}').belegtyp == "Rechnung"
    assert get('Hier: {"lieferant": "Metro", "belegtyp": "Angebot"} fertig').belegtyp == "Angebot"
    for bad in ("nichts", "", None, "{broken"):
        assert get(bad).extraction_status == "EXTRACTION_FAILED" and get(bad).belegtyp == "Sonstiges"


def test_context_and_query(spark):
    t = "\n".join(["Kopf  Zeile", *["x" * 50] * 100, "Rechnung 12", *["y" * 50] * 100, "Ende"])
    got = spark.createDataFrame([(t,)], "t string").select(extract.context(F.col("t")), extract.search_query(F.lit(TEXT))).first()
    assert got[0].split("\n") == ["Kopf Zeile", "x" * 50, "x" * 19, "Rechnung 12", "y" * 20, "y" * 50, "Ende"] or "Rechnung 12" in got[0].split("\n")
    assert "RE-4711" in got[1] and len(got[1]) <= 1000


DDL = "seq long, role string, document_id string, confidence double, name string, tax_id string, iban string, email string, ext_id string, postal_code string, city string"


def test_contacts_in_order(spark):
    rows = [
        (1, "supplier", "d1", 0.95, "Metro AG", "DE1", None, None, None, None, None), (2, "supplier", "d2", 0.95, "Metro Großhandel", "DE 1", None, "A@b.de", None, None, None), (3, "customer", "d3", 0.95, "Metro", "DE1", None, None, None, None, None),
        (4, "supplier", "d4", 0.95, "Metro AG", "DE2", None, None, None, None, None), (5, "supplier", "d5", 0.5, "Lidl", None, None, None, None, None, None), (6, "supplier", "d6", 0.95, "Unbekannt", None, None, None, None, None, None), (7, "supplier", "d7", 0.95, "Rewe", None, None, None, None, "1", "Köln"),
    ]
    got = {r.seq: r for r in contacts.learn(spark.createDataFrame(rows, DDL).repartition(5)).collect()}
    assert [got[k].status for k in range(1, 8)] == ["CREATED", "MATCHED", "MATCHED", "REVIEW_CONFLICT", "SKIPPED_UNSAFE", "SKIPPED_UNSAFE", "CREATED"]
    assert got[1].entity_id == got[2].entity_id == got[3].entity_id != got[7].entity_id


def test_contacts_equal_one_long_fold(spark):
    r = random.Random(6)
    pick = lambda p, n: f"{p}{r.randint(1, n)}" if r.random() < 0.4 else None
    rows = [(k, r.choice(["supplier", "customer"]), f"d{r.randint(1, 30)}", r.choice([0.8, 0.95, 0.99]), f"Name {r.randint(1, 25)}", pick("DE", 20), pick("IB", 20), pick("m", 20), pick("x", 20), None, None) for k in range(120)]
    df = spark.createDataFrame(rows, DDL)
    whole, want = contacts.Group(), {}
    for c in contacts.candidates(df).orderBy("seq").collect():
        want[c.seq] = whole.upsert(c.asDict())
    assert {x.seq: (x.status, x.entity_id) for x in contacts.learn(df.repartition(4)).collect()} == want


def test_pages_and_drafts(spark):
    rows = [("d2", "Metro", "e1", "Fleisch", "3400", None, 1.0, "f/2"), ("d1", "Metro", "e1", "Unbekannt", None, "2024-01-01", None, None), ("d3", "unbekannt", None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id string, supplier string, entity_id string, goods string, skr03 string, day string, gross double, link string")
    p = {r.path: r.text for r in wiki.entity_pages(df, "2026-01-01").collect()}
    text = p["entities/suppliers/metro.md"]
    assert set(p) == {"entities/suppliers/metro.md", "review/unresolved-documents.md"} and "source_count: 2" in text and 'article_categories: ["Fleisch"]' in text and text.index("`d1`") < text.index("`d2`") and "[Quelle](<f/2>)" in text
    mails = spark.createDataFrame([("a", "s", "Metro", "PREIS_ERHOEHUNG", 1), ("a", "s", "Lidl", "PREIS_ERHOEHUNG", 2), ("a", "s", None, None, 3)], "sender string, subject string, supplier string, intent string, at int")
    d = {r.intent: r for r in records.keep_last(records.mail_drafts(mails), ["draft_id"], ["at"]).collect()}
    assert len(d) == 2 and "Gegenangebot" in d["PREIS_ERHOEHUNG"].draft and d["PREIS_ERHOEHUNG"].supplier == "Lidl" and d["ALLGEMEINE_ANFRAGE"].draft.startswith("Guten Tag Lieferant,")


def test_evidence_of_repeats_and_currencies(spark):
    from quillmill.operators import stack

    rows = [(1, "x"), (2, "x"), (3, "Netto 1,00 EUR\nBrutto 1,19 USD"), (4, "Netto 1,00 EUR\nBrutto 1,19 EUR"), (5, ""), (6, " ")]
    base = spark.createDataFrame(rows, "doc_id long, _text string")
    known = spark.sql("select md5('Netto 1,00 EUR\nBrutto 1,19 EUR') as md5")
    assert sorted(r.doc_id for r in stack.repeated(base).collect()) == [2]
    assert sorted({r.doc_id for r in stack.repeated(base, known).collect()}) == [2, 4]
    assert [r.doc_id for r in stack.mixed_currencies(base).collect()] == [3]
