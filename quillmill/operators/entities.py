"""Duplicates, keyed merges, entity matching and containment joins.

Containment is never a join of all pairs: the texts are read once for a block of names, see ``containment``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as tx
from ..sources.scratch import materialize, shared_dir
from .containment import contained


def exact_duplicates(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Groups of equal text: hash, copies, the least key.  Counts are partial before the shuffle, so a hot text is no skew."""
    return docs.groupBy(F.md5(F.col(text)).alias("md5")).agg(F.count("*").alias("copies"), F.min(key).alias("keep_id")).where("copies > 1")


def keep_first(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")


def metadata_key(supplier: Column, gross: Column, day: Column) -> Column:
    return F.struct(F.lower(F.trim(supplier)).alias("supplier"), F.format_string("%.2f", gross).alias("gross"), day.cast("date").alias("day"))


def match_invoices(invoices: DataFrame, notes: DataFrame) -> DataFrame:
    """Each invoice with the state of its delivery note (pairing is the caller's: column pair_id).

    Both sides: pair_id, contact, name, day, gross.  No note: OFFEN_KEIN_LIEFERSCHEIN 0.50; else MATCHED 0.95 or
    DISCREPANCY 0.70 with its reasons.
    """
    n = notes.select(F.col("pair_id").alias("_pair"), *[F.col(c).alias(f"n_{c}") for c in ("contact", "name", "day", "gross")])
    j = invoices.join(n, F.col("pair_id") == F.col("_pair"), "left")
    c = F.col
    ids = c("contact").isNotNull() & c("n_contact").isNotNull()
    names = (F.trim(F.coalesce(c("name"), F.lit(""))) != "") & (F.trim(F.coalesce(c("n_name"), F.lit(""))) != "")
    reasons = F.array_compact(F.array(
        F.when(ids & (c("contact") != c("n_contact")), "contact").when(~ids & names & (F.lower(F.trim(c("name"))) != F.lower(F.trim(c("n_name")))), "name"),
        F.when(F.abs(F.datediff(c("day"), c("n_day"))) > 30, "date"),
        F.when((c("gross") > 0) & (c("n_gross") > 0) & (F.abs(c("gross") - c("n_gross")) > 0.05), "amount"),
    ))
    status = F.when(c("_pair").isNull(), "OFFEN_KEIN_LIEFERSCHEIN").when(F.size("discrepancies") == 0, "MATCHED").otherwise("DISCREPANCY")
    out = j.withColumn("discrepancies", F.when(c("_pair").isNull(), F.array().cast("array<string>")).otherwise(reasons)).withColumn("match_status", status)
    score = F.when(c("match_status") == "MATCHED", 0.95).when(c("match_status") == "DISCREPANCY", 0.70).otherwise(0.50)
    return out.withColumn("confidence_score", score).drop("_pair", "n_contact", "n_name", "n_day", "n_gross")


def contained_names(docs: DataFrame, doc_id: str, text: str, names: DataFrame, name_id: str, name: str, least: int = 5) -> DataFrame:
    """(doc_id, name_id, name, _norm) where the words of a name occur, together, in the text; names of ``least`` letters or more."""
    n = names.select(F.col(name_id).alias("name_id"), F.col(name).alias("name"), tx.normalize_text(F.col(name)).alias("_norm")).where(F.length("_norm") >= least)
    spaced = lambda c: F.concat(F.lit(" "), c, F.lit(" "))
    n = n.withColumn("key", spaced(F.col("_norm")))
    return contained(docs, doc_id, spaced(tx.normalize_text(F.col(text))), n).join(n, "key").select("doc_id", "name_id", "name", "_norm")


def best_names(contained: DataFrame) -> DataFrame:
    """The longest contained name of each document; null where the longest belongs to several entities."""
    ranked = contained.withColumn("_len", F.length("_norm")).withColumn("_top", F.max("_len").over(Window.partitionBy("doc_id"))).where("_len = _top")
    return ranked.groupBy("doc_id").agg(F.count_distinct("name_id").alias("candidates"), F.min("name_id").alias("_one")).select("doc_id", "candidates", F.when(F.col("candidates") == 1, F.col("_one")).alias("entity_id"))


def identity_keys(rows: DataFrame, row_id: str, keys: dict[str, Column]) -> DataFrame:
    """(row_id, key_type, key_value) for each key that a row has."""
    pairs = F.array(*[F.struct(F.lit(k).alias("key_type"), v.cast("string").alias("key_value")) for k, v in keys.items()])
    return rows.select(F.col(row_id).alias("row_id"), F.explode(pairs).alias("_k")).select("row_id", "_k.*").where("key_value is not null and key_value <> ''")


def resolve_entities(keys: DataFrame, rounds: int = 40) -> DataFrame:
    """(row_id, entity): rows that share a key, directly or by others, have the least row_id of them all.

    Rows and keys take turns in passing on the least id known, and rows jump to what their entity has learnt.  Each
    round is checkpointed; the last must change nothing.
    """
    shared_dir(keys.sparkSession)  # checkpoints go there
    edges = materialize(keys.distinct(), "edges")  # each round reads them twice
    # both sides of a round's joins have as many rows as the input: a broadcast would pass one whole through the driver
    label = edges.select("row_id", F.col("row_id").alias("entity")).distinct()
    for _ in range(rounds):
        of_key = edges.join(label.hint("merge"), "row_id").groupBy("key_type", "key_value").agg(F.min("entity").alias("entity"))
        of_row = edges.join(of_key.hint("merge"), ["key_type", "key_value"]).groupBy("row_id").agg(F.min("entity").alias("next"))
        both = label.join(of_row.hint("merge"), "row_id").select("row_id", "entity", "next").checkpoint()
        changed = both.where("next <> entity").limit(1).count()
        # the entity of my entity is mine too: paths shrink by half
        hop = both.select(F.col("row_id").alias("_r"), F.col("next").alias("_n"))
        label = both.join(hop.hint("merge"), F.col("next") == F.col("_r"), "left").select("row_id", F.least("next", F.coalesce("_n", "next")).alias("entity"))
        if not changed:
            return both.select("row_id", F.col("next").alias("entity"))
    raise RuntimeError("entities did not settle")


def reconcile(docs: DataFrame, known: bool = True) -> DataFrame:
    """docs (readable, strong, weak arrays of entity ids, current, role_ok) with reasons, status and proposed entity.

    ``known`` says whether there are entities at all; without any, documents that raise no conflict have no candidates.
    """
    c = F.col
    one = F.size("strong") == 1
    reasons = F.array_compact(F.array(
        F.when(~c("readable"), "source_unreadable"), F.when(F.size("strong") > 1, "several_strong"), F.when(one & ~c("role_ok"), "role_mismatch"),
        F.when(one & (F.size(F.array_except("weak", "strong")) > 0), "weak_disagrees"), F.when(c("current").isNotNull() & (F.size("strong") > 0) & ~F.array_contains("strong", c("current")), "current_disagrees"),
        F.when((F.size("strong") == 0) & (F.size("weak") > 1), "several_weak"),
    ))
    single = F.when(one & (F.size("reasons") == 0), F.try_element_at("strong", F.lit(1)))
    status = (
        F.when(~c("readable"), "SOURCE_UNREADABLE").when(F.size("reasons") > 0, "REVIEW_CONFLICT").when(F.lit(not known), "NO_CANDIDATE_ENTITIES")
        .when(c("proposed").isNotNull() & ~F.coalesce(c("proposed") == c("current"), F.lit(False)), "UPDATED").otherwise("UNCHANGED")
    )
    return docs.withColumn("reasons", reasons).withColumn("proposed", single).withColumn("status", status)
