"""Documents against known contacts: strong identifiers, weak evidence, a status for each, and what would be updated."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from .containment import contained
from .entities import reconcile

#: Document types by the role of the contact that they name.
SUPPLIER_DOCS, CUSTOMER_DOCS = ("rechnung", "ausgabe", "bon", "quittung"), ("einnahme", "ausgangsrechnung")


def strong_hits(docs: DataFrame, entities: DataFrame) -> DataFrame:
    """Distinct (doc_id, entity_id): an external id, or an IBAN, VAT number or mail address in the text, is an entity's.

    docs: doc_id, ext_id, text.  entities: entity_id, ext_id, iban, tax_id, email.  One equality join on (kind, key).
    """
    ids = tx.strong_ids(F.coalesce("text", F.lit("")))
    pairs = lambda kind, values: F.transform(values, lambda v: F.struct(F.lit(kind).alias("kind"), tx.match_key(v).alias("key")))
    of_doc = F.concat(pairs("ext_id", F.array_compact(F.array("ext_id"))), pairs("iban", ids["ibans"]), pairs("tax_id", ids["vat_ids"]), pairs("email", ids["emails"]))
    asked = docs.select("doc_id", F.explode(of_doc).alias("_k")).select("doc_id", "_k.*").where("key <> ''").distinct()
    own = F.array(*[F.struct(F.lit(k).alias("kind"), tx.match_key(F.coalesce(F.col(k), F.lit(""))).alias("key")) for k in ("ext_id", "iban", "tax_id", "email")])
    held = entities.select("entity_id", F.explode(own).alias("_k")).select("entity_id", "_k.*").where("key <> ''")
    return asked.join(held, ["kind", "key"]).select("doc_id", "entity_id").distinct()


def weak_hits(docs: DataFrame, aliases: DataFrame) -> DataFrame:
    """Distinct (doc_id, entity_id): an alias of more than three letters occurs in the file name, the supplier or the text."""
    body = F.concat_ws("\n", *[tx.match_key(F.coalesce(F.col(c), F.lit(""))) for c in ("file_name", "supplier", "text")])
    keys = aliases.select("entity_id", tx.match_key(F.coalesce("alias", F.lit(""))).alias("key")).where(F.length("key") > 3)
    return contained(docs, "doc_id", body, keys).join(keys, "key").select("doc_id", "entity_id").distinct()


def reconcile_documents(docs: DataFrame, entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """docs (doc_id, kind, file_name, supplier, text, ext_id, current, readable) with strong, weak, reasons, proposed, status.

    A document contradicts its one strong contact if it is a supplier's and the contact a customer, or the other way round.
    """
    listed = lambda name: F.array_sort(F.collect_set("entity_id")).alias(name)
    # texts are searched once for identifiers: contacts and their roles come from one grouping
    strong = strong_hits(docs, entities).join(entities.select("entity_id", "role"), "entity_id").groupBy("doc_id").agg(listed("strong"), F.min("role").alias("_role"))
    j = docs.join(strong, "doc_id", "left").join(weak_hits(docs, aliases).groupBy("doc_id").agg(listed("weak")), "doc_id", "left")
    kind = F.lower(F.coalesce("kind", F.lit("")))
    wrong = (kind.isin(*SUPPLIER_DOCS) & (F.col("_role") == "customer")) | (kind.isin(*CUSTOMER_DOCS) & (F.col("_role") == "supplier"))
    none = F.array().cast(entities.select(F.array("entity_id").alias("a")).schema["a"].dataType)
    ready = j.withColumns({"strong": F.coalesce("strong", none), "weak": F.coalesce("weak", none), "role_ok": ~F.coalesce(wrong, F.lit(False))})
    return reconcile(ready, not entities.isEmpty()).drop("_role")


def summary(reconciled: DataFrame) -> DataFrame:
    """One row of counts over a reconciliation."""
    n = lambda c: F.count_if(c)
    clash = F.size("reasons") > 0
    return reconciled.agg(F.count("*").alias("processed"), n(clash).alias("conflicts"), n(F.col("status") == "UPDATED").alias("updated"), n(F.col("status") == "UNCHANGED").alias("unchanged"), n(F.col("status") == "NO_CANDIDATE_ENTITIES").alias("no_candidate_entities"))


def write_reports(spark: SparkSession, reconciled: DataFrame, folder: str) -> None:
    """summary (JSON), conflicts (CSV) and audit (JSON lines) below a folder; each is written whole or not at all by Spark's commit."""
    summary(reconciled).write.mode("overwrite").json(f"{folder}/summary")
    reconciled.where(F.size("reasons") > 0).select("doc_id", F.array_join("reasons", " | ").alias("reason"), "supplier", "file_name").write.mode("overwrite").csv(f"{folder}/conflicts", header=True)
    reconciled.select("doc_id", "status", F.col("current").alias("current_entity"), F.col("proposed").alias("proposed_entity"), F.when(F.size("reasons") > 0, F.array_join("reasons", " | ")).alias("conflict_reason")).write.mode("overwrite").json(f"{folder}/audit")


def updates(reconciled: DataFrame) -> DataFrame:
    """(doc_id, current) of the documents whose contact changes; what a keyed upsert takes."""
    return reconciled.where("status = 'UPDATED'").select("doc_id", F.col("proposed").alias("current"))
