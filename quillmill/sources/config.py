"""Small inputs: indexes and settings in JSON, wiki pages, logs, pending files, and which paths may be read at all."""

from __future__ import annotations

from pathlib import PurePosixPath
from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx

VECTOR = "id string, doc_id string, title string, content string, source string, category string, embedding array<double>"
#: Pages that a PDF may have, lines of a log that may be shown.
MOST_PAGES, MOST_LINES = 2000, 1000


def allowed_path(path: str, roots: list[str]) -> str:
    """The path without its . and .. parts, if it is a root or below one; else an error.  Symbolic links are for the store to refuse."""
    def plain(p: str) -> tuple[str, PurePosixPath]:
        url = urlparse(p)
        parts: list[str] = []
        for part in PurePosixPath(unquote(url.path)).parts:
            if part == "..":
                if len(parts) > 1:
                    parts.pop()
            else:
                parts.append(part)
        return url.netloc, PurePosixPath(*parts)

    store, own = plain(path)
    if not any(store == s and (own == r or r in own.parents) for s, r in map(plain, roots)):
        raise ValueError("the path is outside of the allowed roots")
    return path


def vector_index(spark: SparkSession, path: str) -> DataFrame:
    """A vector index from a JSON file; a corrupt one is empty."""
    rows = spark.read.schema(VECTOR).option("multiLine", "true").option("mode", "DROPMALFORMED").json(path)
    return rows.where("doc_id is not null and embedding is not null")


def account_map(spark: SparkSession, path: str) -> DataFrame:
    """(chart, key, account, label, rate) from a nested JSON file of charts, keys and accounts; without a readable one no rows."""
    text = spark.read.text(path, wholetext=True)
    nested = F.from_json("value", "map<string,map<string,struct<kontonummer:string,bezeichnung:string,steuersatz:double>>>")
    charts = text.select(F.explode(nested).alias("chart", "_k"))
    return charts.select("chart", F.explode("_k").alias("key", "_a")).select("chart", "key", F.col("_a.kontonummer").alias("account"), F.col("_a.bezeichnung").alias("label"), F.col("_a.steuersatz").alias("rate"))


def checkpoint(spark: SparkSession, path: str) -> DataFrame:
    """(processed_files, last_page) of a run; of an unreadable file the start."""
    text = spark.read.text(path, wholetext=True)
    got = F.from_json("value", "processed_files array<string>, last_page int")
    return text.select(F.coalesce(got["processed_files"], F.array().cast("array<string>")).alias("processed_files"), F.coalesce(got["last_page"], F.lit(0)).alias("last_page"))


def wiki_pages(spark: SparkSession, folder: str) -> DataFrame:
    """(path, text) of the Markdown pages below a folder, paths relative to it; ``wiki.knowledge`` leaves out index, log and archive."""
    rows = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").text(folder, wholetext=True)
    root = urlparse(folder).path.rstrip("/") + "/"
    return rows.select(F.substring_index(F.col("_metadata.file_path"), root, -1).alias("path"), F.col("value").alias("text"))


def text_files(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, title, content, source) of .txt, .md and .json files below a folder: what an index ingests."""
    rows = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{txt,md,json}").text(folder, wholetext=True)
    path = F.col("_metadata.file_path")
    name = F.element_at(F.split(path, "/"), -1)
    return rows.select(name.alias("doc_id"), F.initcap(F.replace(F.regexp_replace(name, r"\.[^.]*$", ""), F.lit("_"), F.lit(" "))).alias("title"), F.col("value").alias("content"), path.alias("source"))


def pending_pdfs(spark: SparkSession, folder: str) -> DataFrame:
    """path, name, size_mb, md5 and error of the PDFs of a folder that are not done; error says why one can't be processed.

    Page objects are counted in the file; pages inside compressed object streams can't be seen that way, so a file
    without any counts as unknown and passes.  Spark's reader leaves out files of no length.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    raw = F.decode(F.col("content"), "ISO-8859-1")
    pages = F.size(F.regexp_extract_all(raw, F.lit(r"/Type\s*/Page(?![s\w])"), F.lit(0)))
    error = F.when(~raw.startswith("%PDF-"), "no PDF").when(pages > MOST_PAGES, "too many pages")
    return files.where(~name.startswith("Done_")).select("path", name.alias("name"), F.round(F.col("length") / (1 << 20), 2).alias("size_mb"), F.md5("content").alias("md5"), error.alias("error"))


def redacted_log(lines: DataFrame, limit: int = 200) -> DataFrame:
    """The last lines (n, line) of a log, redacted, in their order; the limit lies between 1 and MOST_LINES."""
    most = max(1, min(int(limit), MOST_LINES))
    return lines.orderBy(F.desc("n")).limit(most).select("n", tx.redact(F.rtrim("line")).alias("line")).orderBy("n")


def real_documents(rows: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """Stored documents but for those of tests."""
    return rows.where(~F.coalesce(F.col(doc_id).cast("string").startswith("TEST-"), F.lit(False)))
