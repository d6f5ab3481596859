"""Records that the engine keeps or shows: safe projections, drafts, vouchers, messages, checkpoints, profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..sources.sinks import ledger_ids
from .pages import OPENINGS


def _masked(c: Column, shown: int = 4) -> Column:
    return tx.mask(F.trim(F.coalesce(c.cast("string"), F.lit(""))), shown)


def safe_contacts(entities: DataFrame) -> DataFrame:
    """Contacts as a viewer may see them: identifiers masked but for their last four characters."""
    return entities.select("entity_id", "canonical_name", "role", "alias_count", "evidence_count", *[_masked(F.col(c)).alias(c) for c in ("tax_id", "iban", "email")])


def safe_jobs(jobs: DataFrame) -> DataFrame:
    """Jobs as a viewer may see them: whether they are leased, not by whom, and the last eight digits of the hash."""
    return jobs.select("job_id", "status", "page_start", "page_end", "attempt_count", "updated_at", (F.coalesce("locked_by", F.lit("")) != "").alias("leased"), _masked(F.col("source_md5"), 8).alias("source_hash"))


def entity_list(entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """Entities with the number of their aliases, by name."""
    n = aliases.groupBy("entity_id").agg(F.count("alias").alias("alias_count"))
    return entities.join(n, "entity_id", "left").withColumn("alias_count", F.coalesce("alias_count", F.lit(0))).orderBy("canonical_name", "entity_id")


def mail_drafts(mails: DataFrame) -> DataFrame:
    """draft_id, subject, sender, supplier, intent, draft, status of each mail; the same subject, sender and intent are one draft."""
    intent, subject, sender = F.coalesce("intent", F.lit("ALLGEMEINE_ANFRAGE")), F.coalesce("subject", F.lit("Anfrage")), F.coalesce("sender", F.lit(""))
    key = F.concat(F.lit("draft_"), F.substring(F.sha2(F.concat_ws("\x1f", subject, sender, intent), 256), 1, 24))
    text = F.element_at(F.create_map(*[F.lit(x) for kv in OPENINGS.items() for x in kv]), intent)
    body = F.concat(F.lit("Guten Tag "), F.coalesce("supplier", F.lit("Lieferant")), F.lit(",\n\n"), text, F.lit("\n\nMit freundlichen Grüßen"))
    return mails.select(key.alias("draft_id"), subject.alias("subject"), sender.alias("sender"), F.coalesce("supplier", F.lit("Lieferant")).alias("supplier"), intent.alias("intent"), body.alias("draft"), F.lit("PENDING_APPROVAL").alias("status"), "at")


def keep_last(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by order, by one aggregation: what INSERT OR REPLACE leaves."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*keys, "_r.*")


def latest(rows: DataFrame, at: str, tie: str, limit: int) -> DataFrame:
    """The newest rows; a report of so many."""
    return rows.orderBy(F.desc(at), tie).limit(limit)


def vouchers(docs: DataFrame, used: int = 0) -> DataFrame:
    """Numbered vouchers of the documents that may be booked, in order of seq."""
    ready = docs.where(F.coalesce("passed", F.lit(False)) & (F.col("validation_status") == "PASSED") & F.coalesce("persisted", F.lit(False)))
    return ledger_ids(ready, ["seq"], used, "SEV-MOCK-").select(F.col("ledger_id").alias("id"), "seq", "supplier", "day", "gross", "net", "tax", "skr03", F.lit("offen").alias("status"))


def approval_message(c: dict[str, Column]) -> Column:
    """What a person is asked to approve: supplier, day, amounts, account, status and its reason."""
    money = lambda k: F.format_string("%.2f", F.coalesce(c[k], F.lit(0.0)))
    return F.concat(
        F.lit("Neuer Beleg erfasst:\n- Lieferant: "), F.coalesce(c["supplier"], F.lit("Unbekannt")), F.lit("\n- Datum: "), F.coalesce(c["day"].cast("string"), F.lit("Unbekannt")), F.lit("\n- Brutto: "), money("gross"), F.lit(" EUR (Netto: "), money("net"), F.lit(" EUR, USt: "), money("tax"),
        F.lit(" EUR)\n- Soll-Konto: "), F.coalesce(c["skr03"], F.lit("3400")), F.lit("\n- Status: "), F.coalesce(c["status"], F.lit("UNKNOWN")), F.lit(" ("), F.coalesce(c["reason"], F.lit("")), F.lit(")\n\n[ 1 ] Bestätigen und buchen\n[ 2 ] Zur manuellen Prüfung verschieben\n"),
    )


def mock_path(day: Column, supplier: Column, gross: Column, passed: Column, today: Column) -> Column:
    """Folder and file of a saved document without the ledger: year and month of its day, or the review folder."""
    iso = F.coalesce(day, F.date_format(today, "yyyy-MM-dd"))
    d = F.coalesce(F.try_to_timestamp(iso, F.lit("yyyy-MM-dd")), today.cast("timestamp"))
    name = F.concat(iso, F.lit("_"), F.regexp_replace(F.coalesce(supplier, F.lit("Unbekannt")), "[ /]", "_"), F.lit("_"), F.format_string("%.2f", F.coalesce(gross, F.lit(0.0))), F.lit("EUR.pdf"))
    return F.concat(F.when(passed, F.date_format(d, "yyyy/MM/")).otherwise("00_Manuelle_Prüfung_Nötig/"), name)


def audit_events(events: DataFrame) -> DataFrame:
    """Events (at, identity, action, target, outcome) as they are logged: identity and target redacted."""
    return events.select(F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"), tx.redact(F.col("identity")).alias("identity"), "action", tx.redact(F.coalesce("target", F.lit(""))).alias("target"), F.coalesce("outcome", F.lit("ok")).alias("outcome"))


def synthesised(docs: DataFrame) -> DataFrame:
    """docs with text and summary filled in where they are missing, from what is known of them."""
    s = lambda k: F.coalesce(F.col(k).cast("string"), F.lit(""))
    doc = F.col("doc_id").cast("string")
    text = F.concat(F.lit("Lieferant: "), s("supplier"), F.lit(", Datum: "), s("day"), F.lit(", Betrag: "), s("gross"), F.lit(" EUR, Beleg-ID: "), doc)
    summary = F.concat(F.lit("Beleg "), doc, F.lit(" von "), s("supplier"), F.lit(", Datum "), s("day"), F.lit(", Brutto "), s("gross"), F.lit(" EUR, Rechnungsnummer "), s("number"), F.lit(", Warengruppe "), s("goods"), F.lit(", Status "), s("status"), F.lit("."))
    return docs.withColumns({"text": F.when(F.trim(s("text")) != "", F.col("text")).otherwise(text), "summary": F.coalesce(F.nullif("summary", F.lit("")), summary)})


def file_document_id(md5: Column, page: Column) -> Column:
    """The id of a document from a file that is no PDF: its hash's first 16 digits and its first page."""
    return F.concat(F.lit("MF-"), F.substring(md5, 1, 16), F.lit("-"), F.coalesce(page, F.lit(1)).cast("string"))


def mock_embedding(text: Column, dim: int = 384) -> Column:
    """A vector of the bytes of a text's MD5 over 255, filled up with zeros."""
    byte = lambda k: F.conv(F.substring(F.md5(text), 2 * k + 1, 2), 16, 10).cast("int") / F.lit(255.0)
    return F.concat(F.array(*[byte(k) for k in range(16)]), F.array_repeat(F.lit(0.0), dim - 16))


def updated_profile(profile: DataFrame, note: str | None, rules: list[str] | None = None) -> DataFrame:
    """A profile (notes, rules: arrays) with a note and rules appended."""
    more = lambda c, v: F.concat(F.col(c), F.array(*[F.lit(x) for x in v])) if v else F.col(c)
    return profile.withColumns({"notes": more("notes", [note] if note else []), "rules": more("rules", rules or [])})


def system_prompt(profile: DataFrame, context: Column) -> Column:
    """What a model is told of the person it writes for."""
    bullet = lambda c: F.array_join(F.transform(c, lambda x: F.concat(F.lit("- "), x)), "\n")
    return F.concat(F.lit("Du schreibst für "), profile["name"], F.lit(" ("), profile["company"], F.lit(").\nTonalität: "), profile["tone"], F.lit("\nStil: "), F.array_join(profile["rules"], ", "), F.lit("\n"), bullet(profile["notes"]), F.lit("\n"), context)


def replace_vectors(index: DataFrame, new: DataFrame) -> DataFrame:
    """A vector index (id, doc_id, ...) with the chunks of new documents in place of their old ones, by doc_id and by the ids of chunks."""
    ids = new.select("doc_id").distinct()
    of_chunk = F.regexp_replace("id", "_chunk_.*$", "")
    kept = index.join(ids, "doc_id", "left_anti").withColumn("_of", of_chunk).join(ids.select(F.col("doc_id").alias("_of")), "_of", "left_anti").drop("_of")
    return kept.unionByName(new)


def append_vectors(index: DataFrame, new: DataFrame, once: bool = False) -> DataFrame:
    """A vector index with more chunks; what is there twice stays twice unless ``once``."""
    out = index.unionByName(new)
    return out.dropDuplicates(["id"]) if once else out


def chunk_rows(chunks: DataFrame) -> DataFrame:
    """Chunks (doc_id, chunk_no, chunk) with the ids that an index knows them by."""
    return chunks.withColumn("id", F.concat(F.col("doc_id").cast("string"), F.lit("_chunk_"), F.col("chunk_no").cast("string")))


def without_prefix(rows: DataFrame, column: str, drop: str, keep: str | None = None) -> DataFrame:
    """Rows whose id doesn't begin with ``drop``, or begins with ``keep``."""
    gone = F.col(column).startswith(drop)
    return rows.where(~F.coalesce(gone & ~F.col(column).startswith(keep) if keep else gone, F.lit(False)))


def stats(tables: dict[str, DataFrame]) -> DataFrame:
    """name, n of each table."""
    out = None
    for name, rows in tables.items():
        one = rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = one if out is None else out.unionByName(one)
    return out
