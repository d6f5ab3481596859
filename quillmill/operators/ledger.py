"""Saving documents: duplicates, destinations, ledger rows, and what becomes of a source file.

Documents are saved in order (seq), so a document is a duplicate of an earlier one of its batch as well as of the ledger.
That needs only the first seq of each key: one partial aggregation and an equality join, without a window over a hot key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.sinks import ledger_ids
from .entities import metadata_key

#: Folders, statuses and columns of the ledger.
REVIEW, SUSPECTS, NOT_SAVED = "04_Pruefung_Erforderlich", "04_Pruefung_Erforderlich/DUBLITTEN", "DUBLITTE_MD5_NO_SAVE"
SAME_FILE, SAME_DATA = "DUBLITTE_MD5", "DUBLITTE_VERDACHT"


def save_plan(docs: DataFrame, ledger: DataFrame) -> DataFrame:
    """docs (seq, md5, supplier, gross, day, validation_status, passed, folder) with save_status and destination.

    The hash of an earlier document: SAME_FILE, nothing is saved.  Else supplier, gross and day of an earlier one:
    SAME_DATA, to the suspects' folder.  Else what passed goes to its folder and the rest to review.  ledger: md5,
    supplier, gross, day of what was saved before.
    """
    has_data = (F.coalesce("supplier", F.lit("")) != "") & (F.coalesce("gross", F.lit(0.0)) != 0) & F.col("day").isNotNull()
    keyed = docs.withColumns({"_h": F.nullif("md5", F.lit("")), "_m": F.when(has_data, F.to_json(metadata_key(F.col("supplier"), F.col("gross"), F.col("day"))))})
    old = ledger.select(F.nullif("md5", F.lit("")).alias("_h"), F.when(has_data, F.to_json(metadata_key(F.col("supplier"), F.col("gross"), F.col("day")))).alias("_m"), F.lit(None).cast("long").alias("seq"))
    every = keyed.select("_h", "_m", F.col("seq").cast("long").alias("seq")).unionByName(old)

    def first(key: str, name: str) -> DataFrame:
        """The least seq of each key; one below all for what the ledger has."""
        return every.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.coalesce("seq", F.lit(-(1 << 62)))).alias(name))

    j = keyed.join(first("_h", "_first_h"), "_h", "left").join(first("_m", "_first_m"), "_m", "left")
    same_file, same_data = F.coalesce(F.col("_first_h") < F.col("seq"), F.lit(False)), F.coalesce(F.col("_first_m") < F.col("seq"), F.lit(False))
    ok = F.coalesce("passed", F.lit(False))
    status = F.when(same_file, SAME_FILE).when(same_data, SAME_DATA).otherwise(F.coalesce(F.nullif("validation_status", F.lit("")), F.when(ok, "PASSED").otherwise("MANUAL_REVIEW_NEEDED")))
    place = F.when(same_file, NOT_SAVED).when(same_data, SUSPECTS).when(ok, F.col("folder")).otherwise(REVIEW)
    return j.withColumns({"save_status": status, "destination": place}).drop("_h", "_m", "_first_h", "_first_m")


def booking_status(save_status: Column) -> Column:
    return F.when(save_status.isin(SAME_FILE, SAME_DATA), save_status).when(save_status == "PASSED", "OFFEN").otherwise("PRUEFUNG_ERFORDERLICH")


def category_label(kind: Column, goods: Column) -> Column:
    kind, goods = F.coalesce(kind, F.lit("Sonstiges")), F.coalesce(goods, F.lit("Unbekannt"))
    return F.when(goods != "Unbekannt", F.concat(kind, F.lit(" ("), goods, F.lit(")"))).otherwise(kind)


def ledger_rows(saved: DataFrame, used: int = 0, prefix: str = "VG-") -> DataFrame:
    """The ledger's rows of saved documents (seq, day, supplier, kind, goods, net, tax, gross, rate, skr03, save_status, link,
    md5), numbered behind those in use; no cell holds a comma."""
    c = F.col
    money = lambda k: F.format_string("%.2f", F.coalesce(c(k), F.lit(0.0)))
    rate = F.coalesce("rate", F.when(F.coalesce("tax", F.lit(0.0)) > 0, 7.0).otherwise(0.0))
    rows = ledger_ids(saved, ["seq"], used, prefix).select(
        "ledger_id", F.date_format("day", "yyyy-MM-dd").alias("day"), "supplier", category_label(c("kind"), c("goods")).alias("category"), money("gross").alias("gross"), money("net").alias("net"), F.format_string("%.1f", rate).alias("rate"), money("tax").alias("tax"),
        F.coalesce("skr03", F.lit("3400")).alias("skr03"), booking_status(c("save_status")).alias("booking_status"), "link", "md5",
    )
    return rows.select(*[F.replace(F.coalesce(c(n), F.lit("")), F.lit(","), F.lit(";")).alias(n) for n in rows.columns])


def source_manifest(docs: DataFrame, source: str, expected: DataFrame, action: str = "done") -> DataFrame:
    """For each source file (expected: source, documents) whether all its documents are verified, and what becomes of it."""
    if action not in ("done", "archive", "keep"):
        raise ValueError(f"no such action: {action}")
    got = docs.groupBy(source).agg(F.count("*").alias("saved"), F.coalesce(F.bool_and("verified"), F.lit(False)).alias("_all"))
    j = expected.join(got, source, "left").withColumns({"saved": F.coalesce("saved", F.lit(0))})
    whole = (F.col("documents") > 0) & (F.col("saved") == F.col("documents")) & F.coalesce("_all", F.lit(False))
    name = F.element_at(F.split(F.col(source), "/"), -1)
    done = {"done": F.concat(F.lit("Done_"), name), "archive": F.concat(F.lit("archived/"), name), "keep": name}[action]
    return j.withColumn("complete", whole).withColumn("target", F.when(F.col("complete"), done).otherwise(name)).drop("_all")


def inventory(rows: DataFrame, new: DataFrame, done_files: DataFrame) -> DataFrame:
    """The inventory after a run: new rows replace those of their source, and done files that no row names are added.

    rows, new: source, path, status.  done_files: path of files named Done_*.
    """
    kept = rows.join(new.select("source").distinct(), "source", "left_anti").unionByName(new)
    name = F.regexp_replace(F.element_at(F.split("path", "/"), -1), "^Done_", "")
    found = done_files.select("path").join(kept.select("path").distinct(), "path", "left_anti").select(name.alias("source"), "path", F.lit("BEREITS_DONE").alias("status"))
    return kept.unionByName(found)
