"""Files to pages.  Every format is read as ``binaryFile`` and split by extension inside one Arrow map.

A file that fails, is too large or unpacks too far becomes one ERROR page; it never ends the job.  Recognition of text
in images and PDFs is a callable that the caller passes in; without one those pages are marked as such.
"""

from __future__ import annotations

import csv
import email
import email.policy
import io
import re
import zipfile
from collections.abc import Callable
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import expected_decimal, german_decimal, page_digits

#: Formats, limits of a file, of what it unpacks to, and of its rows.
SUFFIXES = (".pdf", ".png", ".jpg", ".jpeg", ".txt", ".md", ".docx", ".csv", ".xlsx", ".eml")
MAX_FILE, MAX_UNPACKED, MAX_ROWS, SNIPPET = 50 << 20, 200 << 20, 100_000, 500
PAGE = "source_path string, page_num int, text_snippet string, full_text string, ocr_confidence double, ocr_status string"
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"

Recognizer = Callable[[bytes, str], list[tuple[str, float]]]


def table_rows(rows: list[list[str]]) -> str:
    """Rows as a Markdown table."""
    if not rows:
        return ""
    lines = ["| " + " | ".join(r) + " |" for r in rows]
    return "\n".join([lines[0], "| " + " | ".join("---" for _ in rows[0]) + " |", *lines[1:]])


def _unpack(data: bytes) -> zipfile.ZipFile:
    z = zipfile.ZipFile(io.BytesIO(data))
    if sum(i.file_size for i in z.infolist()) > MAX_UNPACKED:
        raise ValueError("unpacks too far")
    return z


def docx_text(data: bytes) -> str:
    body = ElementTree.fromstring(_unpack(data).read("word/document.xml")).find(f"{_W}body")
    text = lambda e: "".join(t.text or "" for t in e.iter(f"{_W}t"))
    parts = []
    for e in body if body is not None else []:
        if e.tag == f"{_W}p" and text(e).strip():
            parts.append(text(e))
        elif e.tag == f"{_W}tbl":
            parts.append(table_rows([[text(c).strip() for c in r.iter(f"{_W}tc")] for r in e.iter(f"{_W}tr")]))
    return "\n".join(parts)


def xlsx_pages(data: bytes) -> list[str]:
    """One page for each sheet; rows without any value are left out."""
    z = _unpack(data)
    names = z.namelist()
    shared = ["".join(t.text or "" for t in si.iter(f"{_S}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in names else []
    pages = []
    for name in sorted((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[-1])):
        rows = []
        for row in ElementTree.fromstring(z.read(name)).iter(f"{_S}row"):
            cells = []
            for c in row.iter(f"{_S}c"):
                v = c.find(f"{_S}v")
                inline = "".join(t.text or "" for t in c.iter(f"{_S}t"))
                cells.append(shared[int(v.text)] if c.get("t") == "s" and v is not None else inline or (v.text if v is not None else "") or "")
            if any(cells):
                rows.append(cells)
            if len(rows) > MAX_ROWS:
                raise ValueError("too many rows")
        pages.append(table_rows(rows))
    return pages


def csv_text(data: bytes) -> str:
    text = data.decode("utf-8-sig", "replace")
    try:
        dialect = csv.Sniffer().sniff(text[:4096], ",;\t|")
    except csv.Error:
        dialect = csv.excel
    rows = []
    for row in csv.reader(io.StringIO(text), dialect):
        rows.append(row)
        if len(rows) > MAX_ROWS:
            raise ValueError("too many rows")
    return table_rows(rows)


def eml_text(data: bytes, recognize: Recognizer | None = None) -> str:
    mail = email.message_from_bytes(data, policy=email.policy.default)
    parts = [f"{k}: {mail.get(k, '')}" for k in ("From", "To", "Subject", "Date")]
    for part in mail.walk():
        if part.get_content_type() == "text/plain" and not part.is_multipart():
            parts.append(part.get_content())
        elif recognize and part.get_content_maintype() == "image" and len(image := part.get_payload(decode=True) or b"") <= 20 << 20:
            parts += [t for t, _ in recognize(image, "image")]
    return "\n".join(parts)


def split_file(path: str, data: bytes, recognize: Recognizer | None = None) -> list[tuple]:
    """Rows of PAGE for one file."""
    suffix = "." + path.rsplit(".", 1)[-1].lower() if "." in path else ""
    ok = lambda pages: [(path, k, t[:SNIPPET], t, 1.0, "TEXT_LAYER") for k, t in enumerate(pages, 1)]
    try:
        if len(data) > MAX_FILE:
            raise ValueError("file too large")
        if suffix in (".txt", ".md"):
            return ok([data.decode("utf-8", "ignore")])
        if suffix == ".csv":
            return ok([csv_text(data)])
        if suffix == ".docx":
            return ok([docx_text(data)])
        if suffix == ".xlsx":
            return ok(xlsx_pages(data))
        if suffix == ".eml":
            return ok([eml_text(data, recognize)])
        if suffix not in SUFFIXES:
            raise ValueError(f"no such format: {suffix}")
        if suffix == ".pdf" and data[:5] != b"%PDF-":
            raise ValueError("not a PDF")
        if not recognize:
            return [(path, 1, "", "", 0.0, "OCR_UNAVAILABLE")]
        return [(path, k, t[:SNIPPET], t, conf, "OCR_OK" if conf >= 0.70 and len(t.strip()) >= 20 else "OCR_WEAK") for k, (t, conf) in enumerate(recognize(data, suffix), 1)]
    except Exception as e:  # one bad file must not stop the others
        return [(path, 1, "", f"{type(e).__name__}: {e}"[:SNIPPET], 0.0, "ERROR")]


def read_pages(spark: SparkSession, path: str | list[str], recognize: Recognizer | None = None, glob: str | None = None) -> DataFrame:
    """Pages (PAGE) of all files below a path, by as many tasks as Spark makes of them."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    # files over the limit are never loaded: their content is not read
    files = reader.load(path)
    small = files.where(F.col("length") <= MAX_FILE).select("path", "content")
    large = files.where(F.col("length") > MAX_FILE).select("path")

    def run(batches):
        import pandas as pd

        for pdf in batches:
            rows = [row for p, data in zip(pdf["path"], pdf["content"]) for row in split_file(p, data, recognize)]
            yield pd.DataFrame(rows, columns=["source_path", "page_num", "text_snippet", "full_text", "ocr_confidence", "ocr_status"])

    error = large.select(F.col("path").alias("source_path"), F.lit(1).alias("page_num"), F.lit("").alias("text_snippet"), F.lit("file too large").alias("full_text"), F.lit(0.0).alias("ocr_confidence"), F.lit("ERROR").alias("ocr_status"))
    return small.mapInPandas(run, PAGE).unionByName(error)


def uncached(files: DataFrame, cache: DataFrame, key: str = "md5") -> DataFrame:
    """Files whose content hash the page cache does not have."""
    return files.join(cache.select(key).distinct(), key, "left_anti")


def master_data(spark: SparkSession, path: str, sep: str = ";", decimals: tuple[str, ...] = ()) -> DataFrame:
    """A master-data CSV with trimmed headers and values, without a byte-order mark; the named columns are German decimals, the rest text."""
    df = spark.read.csv(path, sep=sep, header=True, encoding="UTF-8", multiLine=True)
    df = df.toDF(*[c.replace("\ufeff", "").strip().strip('"').lower() for c in df.columns])
    return df.select(*[(german_decimal(F.col(f"`{c}`")) if c in decimals else F.trim(F.coalesce(F.col(f"`{c}`"), F.lit("")))).alias(c) for c in df.columns])


def expected_extraction(spark: SparkSession, path: str) -> DataFrame:
    """Expected documents of an extraction from a CSV with semicolons: page numbers of digits alone, amounts with either separator."""
    df = spark.read.csv(path, sep=";", header=True, encoding="UTF-8")
    df = df.toDF(*[c.replace("\ufeff", "").strip().lower() for c in df.columns])
    kinds = {c: expected_decimal for c in ("netto", "steuer", "brutto")} | {c: page_digits for c in ("startseite", "endseite")}
    plain = lambda c: F.trim(F.coalesce(c, F.lit("")))
    return df.select(*[kinds.get(c, plain)(F.col(f"`{c}`")).alias(c) for c in df.columns])


def ground_truth(spark: SparkSession, path: str) -> DataFrame:
    """Retrieval ground truth from JSON lines; missing lists are empty."""
    schema = "query_id string, query string, query_type string, expected_entity_id string, expected_doc_ids array<string>, allowed_categories array<string>, expected_sources array<string>"
    df = spark.read.schema(schema).json(path).where("query_id is not null")
    return df.withColumns({c: F.coalesce(c, F.array().cast("array<string>")) for c in ("expected_doc_ids", "allowed_categories", "expected_sources")})
