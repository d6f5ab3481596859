"""Pages of files read once: a folder's files are known by path, size and time, their pages by the hash of their content.

A run lists the folder.  A file that is listed as it was has its hash already and is not opened; any other is read, and only a
content that no run has read yet is split into pages or recognised, once, however many files hold it.  Pages, files and
the run's counts are named by one commit of the ``Store``, so a run that dies leaves the cache as it was.  The paths of changed
files pass through the driver, as Spark's own listing of them does; contents and pages do not.

Tables: ``files`` (path, length, modified, md5), ``pages`` (md5 and the columns of a page), ``runs`` (run, files, hits, misses).

Cases: pages that could not be read (ERROR) or recognised for want of a recogniser (OCR_UNAVAILABLE) are returned and not
cached, so a later run tries again; equal contents are cached once; a file that is gone keeps its pages in the cache; an
empty folder gives no pages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .files import MAX_FILE, Recognizer, split_file
from .scratch import materialize
from .store import State, Store

PAGES = "md5 string, page_num int, text_snippet string, full_text string, ocr_confidence double, ocr_status string"
FILES = "path string, length long, modified timestamp, md5 string"
#: Statuses that are not kept.
AGAIN = ("ERROR", "OCR_UNAVAILABLE")


class PageCache:
    def __init__(self, store: Store):
        self.store = store

    def _table(self, name: str, schema: str, state: State) -> DataFrame:
        found = self.store.latest(name, ["path"], state) if name == "files" else self.store.read(name, state)
        return self.store.spark.createDataFrame([], schema) if found is None else found.select(*[x.split()[0] for x in schema.split(", ")])

    def read(self, path: str, recognize: Recognizer | None = None, glob: str | None = None) -> DataFrame:
        """source_path and the columns of a page, for all files below a path; what is new is put into the cache."""
        spark, state = self.store.spark, self.store.state()
        reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
        if glob:
            reader = reader.option("pathGlobFilter", glob)
        listed = materialize(reader.load(path).select("path", "length", F.col("modificationTime").alias("modified")), "listed")
        known = listed.join(self._table("files", FILES, state), ["path", "length", "modified"])
        changed = listed.join(known.select("path"), "path", "left_anti").where(F.col("length") <= MAX_FILE)
        paths = [r.path for r in changed.select("path").toLocalIterator()]
        cached = self._table("pages", PAGES, state)
        fresh, files = None, known.select(*[x.split()[0] for x in FILES.split(", ")])
        if paths:
            found = spark.read.format("binaryFile").load(paths).select("path", "length", F.col("modificationTime").alias("modified"), F.md5("content").alias("md5"), "content")
            found = materialize(found, "contents")
            files = materialize(files.unionByName(found.drop("content")), "files")
            first = found.groupBy("md5").agg(F.min("path").alias("path")).join(cached.select("md5").distinct(), "md5", "left_anti")
            fresh = materialize(self._split(found.select("path", "content").join(first, "path"), recognize), "pages")
        hits = listed.join(files.join(cached.select("md5").distinct(), "md5", "left_semi").select("path"), "path", "left_semi").count()
        n = listed.count()
        self._commit(state, found.drop("content") if paths else None, fresh, n, hits)
        pages = cached if fresh is None else cached.unionByName(fresh)
        large = listed.where(F.col("length") > MAX_FILE).select(F.col("path").alias("source_path"), F.lit(1).alias("page_num"), F.lit("").alias("text_snippet"), F.lit("file too large").alias("full_text"), F.lit(0.0).alias("ocr_confidence"), F.lit("ERROR").alias("ocr_status"))
        return files.select(F.col("path").alias("source_path"), "md5").join(pages, "md5").drop("md5").unionByName(large)

    @staticmethod
    def _split(rows: DataFrame, recognize: Recognizer | None) -> DataFrame:
        def run(batches):
            import pandas as pd

            for pdf in batches:
                out = [(h, *row[1:]) for p, data, h in zip(pdf["path"], pdf["content"], pdf["md5"]) for row in split_file(p, data, recognize)]
                yield pd.DataFrame(out, columns=["md5", "page_num", "text_snippet", "full_text", "ocr_confidence", "ocr_status"])

        return rows.select("path", "content", "md5").mapInPandas(run, PAGES)

    def _commit(self, state: State, files: DataFrame | None, pages: DataFrame | None, n: int, hits: int) -> None:
        kept = pages and pages.join(pages.where(F.col("ocr_status").isin(*AGAIN)).select("md5").distinct(), "md5", "left_anti")
        folders = {"files": files and self.store.write(files.join(kept.select("md5").unionByName(self._table("pages", PAGES, state).select("md5")).distinct(), "md5", "left_semi")), "pages": kept and self.store.write(kept)}
        number = state.counters.get("page_runs", 0) + 1
        folders["runs"] = self.store.write(self.store.spark.range(1).select(F.lit(number).alias("run"), F.lit(n).cast("long").alias("files"), F.lit(hits).cast("long").alias("hits"), F.lit(n - hits).cast("long").alias("misses")))

        def change(s: State) -> State:
            for name, folder in folders.items():
                if folder:
                    s = s.adding(name, folder)
            return s.counting("page_runs", 1)

        self.store.update(change)
