"""Readers, writers and streams."""

import zipfile

import pytest
from pyspark.sql import functions as F

from quillmill.operators import prices, reconciliation, wiki
from quillmill.sources import config, files, sinks
from quillmill.streaming import jobs


def test_formats(spark, tmp_path):
    d = tmp_path / "in"
    d.mkdir()
    (d / "a.txt").write_text("plain text")
    (d / "b.csv").write_text("﻿name;n\nx;1\n")
    (d / "c.eml").write_text("From: a@b.de\nTo: c@d.de\nSubject: Hallo\nDate: Mon, 1 Jan 2024 00:00:00 +0000\nContent-Type: text/plain\n\nInhalt")
    (d / "d.pdf").write_bytes(b"no pdf")
    (d / "e.pdf").write_bytes(b"%PDF-1.4 x")
    (d / "f.xyz").write_text("?")
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    with zipfile.ZipFile(d / "g.docx", "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body><w:p><w:r><w:t>Absatz</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>x</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>')
    s = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    with zipfile.ZipFile(d / "h.xlsx", "w") as z:
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{s}"><si><t>kopf</t></si></sst>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{s}"><sheetData><row><c t="s"><v>0</v></c><c><v>5</v></c></row><row><c/></row></sheetData></worksheet>')
    got = {r.source_path.rsplit("/", 1)[-1]: r for r in files.read_pages(spark, str(d)).collect()}
    assert got["a.txt"].full_text == "plain text" and got["a.txt"].ocr_status == "TEXT_LAYER"
    assert got["b.csv"].full_text == "| name | n |\n| --- | --- |\n| x | 1 |"
    assert got["c.eml"].full_text.split("\n")[2] == "Subject: Hallo" and "Inhalt" in got["c.eml"].full_text
    assert got["d.pdf"].ocr_status == got["f.xyz"].ocr_status == "ERROR" and got["e.pdf"].ocr_status == "OCR_UNAVAILABLE"
    assert got["g.docx"].full_text.startswith("Absatz\n| x |") and got["h.xlsx"].full_text.startswith("| kopf | 5 |")
    seen = files.read_pages(spark, str(d), lambda data, suffix: [("recognised text of a page", 0.9), ("x", 0.5)], "e.pdf").orderBy("page_num").collect()
    assert [r.ocr_status for r in seen] == ["OCR_OK", "OCR_WEAK"]


def test_master_data_and_truth(spark, tmp_path):
    (tmp_path / "m.csv").write_text('﻿"Nr";Name\n1;"a;b"\n')
    assert [r.asDict() for r in files.master_data(spark, str(tmp_path / "m.csv")).collect()] == [{"nr": "1", "name": "a;b"}]
    (tmp_path / "n.csv").write_text("Nr;Preis\n1;1.234,50\n")
    assert [r.asDict() for r in files.master_data(spark, str(tmp_path / "n.csv"), decimals=("preis",)).collect()] == [{"nr": "1", "preis": 1234.5}]
    (tmp_path / "e.csv").write_text("\ufeffdateiname;startseite;endseite;netto\na.pdf; 1;x;1.000,50\n")
    assert [r.asDict() for r in files.expected_extraction(spark, str(tmp_path / "e.csv")).collect()] == [{"dateiname": "a.pdf", "startseite": 1, "endseite": None, "netto": 1000.5}]
    (tmp_path / "t.jsonl").write_text('{"query_id": "q", "query": "x"}\n\n')
    assert files.ground_truth(spark, str(tmp_path / "t.jsonl")).first().expected_doc_ids == []


def test_small_inputs(spark, tmp_path):
    (tmp_path / "i.json").write_text('[{"id": "a_chunk_0", "doc_id": "a", "embedding": [0.5]}]')
    assert [r.doc_id for r in config.vector_index(spark, str(tmp_path / "i.json")).collect()] == ["a"]
    (tmp_path / "bad.json").write_text("{[")
    assert config.vector_index(spark, str(tmp_path / "bad.json")).count() == 0 and config.account_map(spark, str(tmp_path / "bad.json")).count() == 0
    (tmp_path / "m.json").write_text('{"SKR03": {"x": {"kontonummer": "3400", "bezeichnung": "W", "steuersatz": 7.0}}}')
    assert [tuple(r) for r in config.account_map(spark, str(tmp_path / "m.json")).collect()] == [("SKR03", "x", "3400", "W", 7.0)]
    (tmp_path / "c.json").write_text('{"processed_files": ["a.pdf"], "last_page": 4}')
    assert tuple(config.checkpoint(spark, str(tmp_path / "c.json")).first()) == (["a.pdf"], 4) and tuple(config.checkpoint(spark, str(tmp_path / "bad.json")).first()) == ([], 0)
    d = tmp_path / "wiki" / "archive"
    d.mkdir(parents=True)
    (d / "old.md").write_text("x")
    for name in ("a_b.md", "index.md", "t.txt", "u.json", "n.pdf"):
        (tmp_path / "wiki" / name).write_text("# A")
    pages = config.wiki_pages(spark, str(tmp_path / "wiki"))
    assert sorted(r.path for r in pages.collect()) == ["a_b.md", "archive/old.md", "index.md"] and [r.path for r in wiki.knowledge(pages).collect()] == ["a_b.md"]
    assert {(r.doc_id, r.title) for r in config.text_files(spark, str(tmp_path / "wiki")).collect()} >= {("a_b.md", "A B"), ("t.txt", "T"), ("u.json", "U")}
    assert config.allowed_path("/data/in/../in/x", ["/data/in"]) and config.allowed_path("s3://b/in", ["s3://b/in"])
    for bad in ("/data/other", "/data/in/../other", "s3://c/in"):
        with pytest.raises(ValueError):
            config.allowed_path(bad, ["/data/in", "s3://b/in"])


def test_pending_files_and_logs(spark, tmp_path):
    for name, data in (("a.pdf", b"%PDF-1.4 /Type /Page "), ("b.pdf", b"no"), ("c.pdf", b""), ("Done_d.pdf", b"%PDF-"), ("e.pdf", b"%PDF-" + b"/Type/Page " * 2001)):
        (tmp_path / name).write_bytes(data)
    assert {r.name: r.error for r in config.pending_pdfs(spark, str(tmp_path)).collect()} == {"a.pdf": None, "b.pdf": "no PDF", "e.pdf": "too many pages"}
    lines = spark.createDataFrame([(k, f"token={k} ") for k in range(5)], "n int, line string")
    assert [tuple(r) for r in config.redacted_log(lines, 2).collect()] == [(3, "token=[REDACTED]"), (4, "token=[REDACTED]")] and config.redacted_log(lines, -3).count() == 1


def test_pages_and_reports_are_written(spark, tmp_path):
    pages = spark.createDataFrame([("x/a.md", "eins"), ("b.md", "zwei")], "path string, text string")
    assert sinks.write_pages(pages, str(tmp_path / "w")) == 2 and (tmp_path / "w" / "x" / "a.md").read_text() == "eins"
    with pytest.raises(ValueError):
        sinks.write_pages(spark.createDataFrame([("../c.md", "")], "path string, text string"), str(tmp_path / "w"))
    docs = spark.createDataFrame([(1, [], [], ["x"], None, "c", "REVIEW_CONFLICT", "M", "f"), (2, ["e"], [], [], "e", None, "UPDATED", "M", "f")], "doc_id long, strong array<string>, weak array<string>, reasons array<string>, proposed string, current string, status string, supplier string, file_name string")
    reconciliation.write_reports(spark, docs, str(tmp_path / "r"))
    assert spark.read.json(f"{tmp_path}/r/summary").first().conflicts == 1 and spark.read.csv(f"{tmp_path}/r/conflicts", header=True).first().reason == "x" and spark.read.json(f"{tmp_path}/r/audit").count() == 2
    rows = spark.createDataFrame([("a", "x", 1)], "dest string, kind string, n int").withColumns({"year": F.lit(2024), "month": F.lit(1)})
    sinks.write_archive(rows, f"{tmp_path}/archive")
    assert spark.read.parquet(f"{tmp_path}/archive").where("year = 2024 and kind = 'x'").count() == 1
    cache = spark.createDataFrame([("m",)], "md5 string")
    assert [r.md5 for r in files.uncached(spark.createDataFrame([("m",), ("n",)], "md5 string"), cache).collect()] == ["n"]


def test_upsert_and_ledger(spark, tmp_path):
    base = f"{tmp_path}/table"
    sinks.upsert_version(spark, base, spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string"), ["id"], 0)
    got = sinks.upsert_version(spark, base, spark.createDataFrame([(2, "c"), (3, "d")], "id int, v string"), ["id"], 1)
    assert sorted(map(tuple, got.collect())) == [(1, "a"), (2, "c"), (3, "d")]
    ids = [r.ledger_id for r in sinks.ledger_ids(spark.range(50).repartition(5), ["id"], 7, parts=4).orderBy("id").collect()]
    assert ids == [f"VG-{n:04d}" for n in range(8, 58)]
    sinks.write_guarded_csv(spark.createDataFrame([("=1",)], "a string"), f"{tmp_path}/csv")
    assert spark.read.csv(f"{tmp_path}/csv", sep=";", header=True).first().a == "'=1"


EVENTS = "job_id string, seq long, kind string, at double, worker string, target string"


def test_stream_of_jobs_ends_as_the_batch(spark, tmp_path):
    rows = [("a", 1, "claim", 0.0, "w", None), ("a", 2, "complete", 1.0, "w", "OCR_RUNNING"), ("b", 1, "claim", 0.0, "w", None), ("a", 3, "fail", 2.0, "w", None), ("b", 2, "complete", 1.0, "x", "OCR_RUNNING")]
    df = spark.createDataFrame(rows, EVENTS)
    for k, part in enumerate((df.where("seq < 3"), df.where("seq >= 3"))):
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/events/p={k}")
    out = []
    stream = jobs.stream_fold(spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/events/*"))
    q = stream.writeStream.outputMode("update").option("checkpointLocation", f"{tmp_path}/cp").foreachBatch(lambda b, _: out.extend(b.collect())).trigger(availableNow=True).start()
    q.awaitTermination(120)
    last = {r.job_id: r for r in out}
    want = {r.job_id: r for r in jobs.fold(df).collect()}
    assert {k: tuple(v) for k, v in last.items()} == {k: tuple(v) for k, v in want.items()}


def test_price_stream(spark, tmp_path):
    ddl = "supplier string, item string, price double, at long"
    spark.createDataFrame([("s", "i", 10.0, 1), ("s", "i", 11.0, 2), ("s", "j", 5.0, 1)], ddl).write.parquet(f"{tmp_path}/prices")
    got = []
    q = (
        spark.readStream.schema(ddl).parquet(f"{tmp_path}/prices").writeStream.option("checkpointLocation", f"{tmp_path}/cp")
        .foreachBatch(lambda b, _: got.extend(prices.price_trends(b, ["supplier", "item"], "price", ["at"]).collect())).trigger(availableNow=True).start()
    )
    q.awaitTermination(120)
    assert {(r["item"], round(r.change_percent, 6), r.warning) for r in got} == {("i", 10.0, True), ("j", 0.0, False)}


def test_windows(spark):
    df = spark.createDataFrame([("2024-01-01 00:10:00", "a"), ("2024-01-01 00:50:00", "a"), ("2024-01-01 01:10:00", "a")], "ts string, k string").withColumn("ts", F.col("ts").cast("timestamp"))
    assert sorted(r.n for r in jobs.windowed_counts(df, "ts", "k").collect()) == [1, 2]
