"""Writers: versioned upserts, ledgers, guarded CSV, partitioned archives."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import formula_guard
from .scratch import materialize


def keyed_upsert(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of new replace those of existing with the same keys."""
    return existing.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def upsert_version(spark: SparkSession, base: str, new: DataFrame, keys: list[str], version: int) -> DataFrame:
    """Writes version N of a table: version N - 1 with the rows of new in place of those with equal keys.

    The old version stays until it is dropped, so a failed write changes nothing and a rollback is a path.
    """
    rows = keyed_upsert(spark.read.parquet(f"{base}/v={version - 1}"), new, keys) if version > 0 else new
    rows.write.mode("overwrite").parquet(f"{base}/v={version}")
    return spark.read.parquet(f"{base}/v={version}")


def ledger_ids(rows: DataFrame, order: list[str], used: int = 0, prefix: str = "VG-", parts: int | None = None) -> DataFrame:
    """Sequential ids behind those in use, in two passes: ranges by order, counts of the ranges, places within them.

    The ranges are written first: their bounds come from a sample, and must be the same for the counts and the places.
    Without ``parts`` there are as many as a shuffle has, and small neighbours are joined.
    """
    ranged = materialize((rows.repartitionByRange(parts, *order) if parts else rows.repartitionByRange(*order)).withColumn("_part", F.spark_partition_id()), "ranges")
    counts = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return ranged.withColumn("_place", place).join(before, "_part").withColumn("ledger_id", F.format_string(f"{prefix}%04d", F.col("_before") + F.col("_place") + used)).drop("_part", "_place", "_before")


def write_guarded_csv(rows: DataFrame, path: str, sep: str = ";") -> None:
    """CSV whose text cells no spreadsheet takes for formulas."""
    safe = rows.select(*[formula_guard(F.col(n)).alias(n) if t == "string" else F.col(n) for n, t in rows.dtypes])
    safe.write.mode("overwrite").csv(path, sep=sep, header=True)


def write_archive(rows: DataFrame, path: str) -> None:
    """Documents by folder (dest, year, month, kind): the layout that readers prune by."""
    rows.repartition("dest", "year", "month", "kind").write.mode("overwrite").partitionBy("dest", "year", "month", "kind").parquet(path)


def append_ledger(spark: SparkSession, path: str, rows: DataFrame, order: list[str]) -> DataFrame:
    """Appends rows to a CSV ledger with ids behind those it has, and returns the ledger.  One writer at a time."""
    from py4j.protocol import Py4JError
    from pyspark.errors import AnalysisException

    try:
        used = spark.read.csv(path, header=True).count()
    except (AnalysisException, Py4JError):  # there is none yet
        used = 0
    ledger_ids(rows, order, used).write.mode("append").csv(path, header=True)
    return spark.read.csv(path, header=True)


def write_pages(pages: DataFrame, folder: str) -> int:
    """Writes each page (path, text) as a file below a folder that the driver reaches, one at a time; a file appears whole."""
    import os
    from pathlib import Path

    n = 0
    for row in pages.select("path", "text").toLocalIterator():
        target = Path(folder, row.path)
        if Path(folder).resolve() not in target.resolve().parents:
            raise ValueError(f"outside of the folder: {row.path}")
        target.parent.mkdir(parents=True, exist_ok=True)
        part = target.with_name(target.name + ".tmp")
        part.write_text(row.text, encoding="utf-8")
        os.replace(part, target)
        n += 1
    return n


def write_report(report: DataFrame, lines: DataFrame, folder: str) -> None:
    """A report as JSON, as CSV and as Markdown lines below a folder; each is written whole or not at all by Spark's commit."""
    report.write.mode("overwrite").json(f"{folder}/json")
    report.select(*[F.to_json(c).alias(c) if t.startswith(("array", "struct", "map")) else F.col(c) for c, t in report.dtypes]).write.mode("overwrite").csv(f"{folder}/csv", header=True)
    lines.write.mode("overwrite").text(f"{folder}/markdown")
