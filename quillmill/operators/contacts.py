"""Contacts learnt from documents, in order: a record creates an entity, matches one, or is refused.

The outcome depends on the order, so records that can touch each other, by a strong id or a name in a role, are folded
one after the other; records that cannot are folded in parallel.  Groups come from ``resolve_entities``.  Each group
streams through sorted partitions, and only its entities are held, never its records.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from .entities import best_names, contained_names, identity_keys, resolve_entities

STRONG = ("tax_id", "iban", "email", "ext_id")
#: Names that stand for none.
UNKNOWN = ("", "unknown", "unbekannt", "unbekannter lieferant", "fehler")
MIN_CONFIDENCE = 0.90


class Group:
    """The entities of one group of records that can touch each other."""

    def __init__(self) -> None:
        self.entities: dict[str, dict] = {}
        self.alias: dict[tuple[str, str], str] = {}
        self.evidence: set[tuple[str, str]] = set()

    def upsert(self, r: dict) -> tuple[str, str | None]:
        """(status, entity id) of one record: role, name, norm, strong ids, postal_code, city, document_id, confidence."""
        if r["norm"] in UNKNOWN or (r["confidence"] or 0.0) < MIN_CONFIDENCE:
            return "SKIPPED_UNSAFE", None
        met = {e for e, x in self.entities.items() if any(r[k] and x[k] == r[k] for k in STRONG) or (x["role"], x["norm"], x["postal_code"], x["city"]) == (r["role"], r["norm"], r["postal_code"], r["city"])}
        named = self.alias.get((r["role"], r["norm"]))
        met |= {named} if named else set()
        if len(met) > 1:
            return "REVIEW_CONFLICT", None
        if met:
            e = met.pop()
            x = self.entities[e]
            if any(x[k] and r[k] and x[k] != r[k] for k in STRONG):
                return "REVIEW_CONFLICT", e
            x |= {k: x[k] or r[k] for k in (*STRONG, "postal_code", "city")}
            x["role"] = x["role"] if x["role"] == r["role"] else "both"
            x["name"] = r["name"] if len(r["name"]) > len(x["name"]) else x["name"]
            x["confidence"] = max(x["confidence"], r["confidence"])
            x["evidence"] += (e, r["document_id"]) not in self.evidence
            status = "MATCHED"
        else:
            e = hashlib.sha256("|".join((r["role"], r["norm"], r["postal_code"], r["city"])).encode()).hexdigest()[:24]
            if e in self.entities:
                return "REVIEW_CONFLICT", None
            self.entities[e] = {k: r[k] for k in ("role", "name", "norm", *STRONG, "postal_code", "city", "confidence")} | {"evidence": 1}
            status = "CREATED"
        self.alias.setdefault((r["role"], r["norm"]), e)
        self.evidence.add((e, r["document_id"]))
        return status, e


def candidates(docs: DataFrame) -> DataFrame:
    """seq, role, document_id, confidence, name and normalised keys, from rows (seq, role, document_id, confidence, name, tax_id, iban, email, ext_id, postal_code, city)."""
    compact = lambda c: F.nullif(tx.normalize_compact(F.col(c)), F.lit(""))
    return docs.select(
        "seq", "role", "document_id", "confidence", F.trim(F.coalesce("name", F.lit(""))).alias("name"), tx.normalize_text(F.coalesce("name", F.lit(""))).alias("norm"), compact("tax_id").alias("tax_id"), compact("iban").alias("iban"),
        F.nullif(tx.casefold(F.trim("email")), F.lit("")).alias("email"), F.nullif(F.trim("ext_id"), F.lit("")).alias("ext_id"), F.coalesce(tx.normalize_compact(F.col("postal_code")), F.lit("")).alias("postal_code"), F.coalesce(tx.normalize_text(F.col("city")), F.lit("")).alias("city"),
    )


def learn(docs: DataFrame) -> DataFrame:
    """seq, status and entity_id of each record, folded in order of seq (unique)."""
    rows = candidates(docs)
    keys = {k: F.col(k) for k in STRONG} | {"name": F.concat_ws("|", "role", "norm")}
    group = resolve_entities(identity_keys(rows, "seq", keys)).withColumnRenamed("entity", "_group").withColumnRenamed("row_id", "seq")

    def run(batches):
        import pandas as pd

        now, state = None, Group()
        for pdf in batches:
            out = []
            for r in pdf.astype(object).where(pdf.notna(), None).to_dict("records"):
                if r["_group"] != now:
                    now, state = r["_group"], Group()
                out.append((r["seq"], *state.upsert(r)))
            yield pd.DataFrame(out, columns=["seq", "status", "entity_id"])

    return rows.join(group, "seq").repartition("_group").sortWithinPartitions("_group", "seq").mapInPandas(run, "seq long, status string, entity_id string")


#: Where a role's fields stand in a document, the first that is filled.
FIELDS = {
    "supplier": {"name": ("supplier",), "tax_id": ("supplier_tax_id", "tax_id"), "iban": ("supplier_iban",), "email": ("supplier_email",), "ext_id": ("supplier_ext_id",), "postal_code": ("supplier_postal_code",), "city": ("supplier_city",)},
    "customer": {"name": ("customer", "recipient"), "tax_id": ("customer_tax_id", "tax_id"), "iban": ("customer_iban",), "email": ("customer_email",), "ext_id": ("customer_ext_id",), "postal_code": ("customer_postal_code",), "city": ("customer_city",)},
}


def from_documents(docs: DataFrame) -> DataFrame:
    """Records for ``learn`` from documents (seq, document_id, validation_status, confidence, and fields of FIELDS that they have).

    Only what passed validation with confidence enough is learnt from; each document gives a supplier, then a customer.
    """
    safe = docs.where((F.col("validation_status") == "PASSED") & (F.coalesce("confidence", F.lit(0.0)) >= MIN_CONFIDENCE))
    out = None
    for k, (role, fields) in enumerate(FIELDS.items()):
        first = lambda names: F.coalesce(*[F.nullif(F.col(n).cast("string"), F.lit("")) for n in names if n in docs.columns], F.lit(None).cast("string"))
        part = safe.select((F.col("seq") * 2 + k).alias("seq"), F.lit(role).alias("role"), "document_id", "confidence", *[first(names).alias(n) for n, names in fields.items()])
        out = part if out is None else out.unionByName(part)
    return out.where(~tx.normalize_text(F.coalesce("name", F.lit(""))).isin(*UNKNOWN))


def known_names(docs: DataFrame, doc_id: str, text: str, aliases: DataFrame, entities: DataFrame, role: str) -> DataFrame:
    """(doc_id, candidates, entity_id, name) by the longest alias of a role that a text holds as whole words; entity_id is null
    where the longest belongs to several."""
    names = aliases.where(F.col("role") == role).select("entity_id", "alias")
    best = best_names(contained_names(docs, doc_id, text, names, "entity_id", "alias"))
    return best.join(entities.select("entity_id", F.col("canonical_name").alias("name")), "entity_id", "left").select("doc_id", "candidates", "entity_id", "name")
