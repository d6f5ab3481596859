"""Queries on prices, amounts, validation, routes and matches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import amounts, decide, entities, graph, prices
from .base import read, spread


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", (F.col("l_extendedprice") / F.col("l_quantity")).alias("unit_price"))
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))


def price_trends(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = prices.price_trends(observations(spark, sf_dir), ["l_suppkey", "l_partkey"], "unit_price", ["o_orderdate", "l_orderkey", "l_linenumber", "unit_price"])
    return out.orderBy(F.desc("change_percent"), "l_suppkey", "l_partkey")


def price_trends_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return price_trends(spark, sf_dir).where("data_points >= 2")


def _bill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as documents to validate: amounts, with faults put in by key."""
    c = F.col
    line = read(spark, sf_dir, "lineitem")
    kinds = F.array(*[F.lit(k) for k in ("Rechnung", "Kontoauszug", "Vertrag", "Rechnung", "Quittung", "Sonstiges", "Werbung / Newsletter")])
    return line.select(
        "l_orderkey", "l_linenumber", (c("l_orderkey") % 97 == 0).alias("failed"), F.element_at(kinds, (c("l_partkey") % 7 + 1).cast("int")).alias("kind"), c("l_extendedprice").alias("net"), (c("l_extendedprice") * c("l_tax")).alias("tax"),
        (c("l_extendedprice") + c("l_extendedprice") * c("l_tax") + F.when(c("l_orderkey") % 10 == 0, F.lit(0.05)).otherwise(F.lit(0.0))).alias("gross"), F.when(c("l_suppkey") % 11 == 0, F.lit(0.5)).otherwise(F.lit(0.9)).alias("quality"),
        F.when(c("l_partkey") % 5 == 0, F.lit(0.9)).otherwise(F.lit(0.97)).alias("confidence"), (c("l_suppkey") % 13 == 0).alias("estimated"), F.when(c("l_partkey") % 3 == 0, "Fleisch").otherwise("Reinigung").alias("goods"), F.lit(19.0).alias("rate"), F.lit("none").alias("rate_source"),
    )


def validation_shield(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decide.validate(_bill(spark, sf_dir)).select("l_orderkey", "l_linenumber", "validation_status", "skr03", "skr04", "tax_rate")


_VALIDATION = """
WITH b AS (SELECT l_orderkey, l_linenumber, l_orderkey % 97 = 0 AS failed, (['Rechnung','Kontoauszug','Vertrag','Rechnung','Quittung','Sonstiges','Werbung / Newsletter'])[l_partkey % 7 + 1] AS kind,
  l_extendedprice AS net, l_extendedprice * l_tax AS tax, l_extendedprice + l_extendedprice * l_tax + CASE WHEN l_orderkey % 10 = 0 THEN 0.05::DOUBLE ELSE 0::DOUBLE END AS gross,
  CASE WHEN l_suppkey % 11 = 0 THEN 0.5 ELSE 0.9 END AS quality, CASE WHEN l_partkey % 5 = 0 THEN 0.9 ELSE 0.97 END AS confidence, l_suppkey % 13 = 0 AS estimated, l_partkey % 3 = 0 AS meat FROM lineitem),
v AS (SELECT *, CASE WHEN failed THEN 'EXTRACTION_FAILED' WHEN kind = 'Vertrag' THEN 'VERTRAGS_INFO' WHEN kind = 'Werbung / Newsletter' THEN 'SPAM_FILTERED' WHEN kind = 'Quittung' AND gross <= 0 THEN 'MANUAL_REVIEW_NEEDED'
  WHEN kind = 'Sonstiges' AND gross = 0 THEN 'EMAIL_INFO' WHEN quality < 0.7 THEN 'MANUAL_REVIEW_NEEDED' WHEN kind = 'Kontoauszug' THEN 'CLASSIFIED_NON_BOOKABLE' WHEN estimated THEN 'MANUAL_REVIEW_NEEDED'
  WHEN abs((net + tax) - gross) > 0.01::DOUBLE THEN 'MANUAL_REVIEW_NEEDED' WHEN confidence < 0.95 THEN 'MANUAL_REVIEW_NEEDED' ELSE 'PASSED' END AS validation_status FROM b)
SELECT l_orderkey, l_linenumber, validation_status, CASE WHEN validation_status = 'PASSED' THEN CASE WHEN meat THEN '3400' ELSE '4900' END END AS skr03, CASE WHEN validation_status = 'PASSED' THEN CASE WHEN meat THEN '5400' ELSE '6300' END END AS skr04,
  CASE WHEN validation_status = 'PASSED' THEN CASE WHEN meat THEN 7::DOUBLE ELSE 19::DOUBLE END END AS tax_rate FROM v"""


def _routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as router input, features from their keys and lengths."""
    d, c = read(spark, sf_dir, "documents").select("doc_id", "n_chars"), F.col
    unit = lambda m: (F.pmod(c("doc_id"), F.lit(m)) / F.lit(float(m - 1)))
    rows = d.select(
        "doc_id", F.lit(True).alias("input_valid"), F.when(c("doc_id") % 53 == 0, F.lit(0)).otherwise(c("n_chars")).alias("chars"), F.lit(False).alias("has_text"), (F.lit(0.6) + unit(9) * 0.4).alias("ocr"), (F.lit(0.65) + unit(5) * 0.35).alias("boundary"),
        (c("doc_id") % 31 == 0).alias("duplicate"), (c("doc_id") % 37 == 0).alias("boundary_conflict"), F.when(c("doc_id") % 17 == 0, "Mahnung").when(c("doc_id") % 2 == 0, "Rechnung").otherwise("Gutschrift").alias("kind"), F.when(c("doc_id") % 19 == 0, "AMBIGUOUS").otherwise("CLASSIFIED").alias("kind_status"),
        F.lit(0.95).alias("kind_conf"), F.when(c("doc_id") % 7 != 0, F.lit(100.0)).alias("net"), F.when(c("doc_id") % 7 != 0, F.lit(19.0)).alias("tax"), F.lit(119.0).alias("gross"), (c("doc_id") % 11 != 0).alias("math_valid"), F.lit(0.0).alias("math_diff"), F.lit(0.95).alias("amount_conf"),
        F.lit(False).alias("amount_conflict"), F.lit(False).alias("currency_conflict"), F.when(c("doc_id") % 3 == 0, "UNKNOWN").otherwise("Metro").alias("supplier_value"), F.lit(0.95).alias("supplier_conf"), F.lit(False).alias("supplier_conflict"),
        F.when(c("doc_id") % 13 != 0, "R-1").alias("number_value"), F.lit(0.92).alias("number_conf"), F.lit(False).alias("number_conflict"),
    )
    return decide.route(rows)


def route_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _routed(spark, sf_dir)
    return r.select("doc_id", "route", F.array_join("blocking_reasons", ",").alias("reasons"), F.array_join("missing_fields", ",").alias("missing"), F.round("route_confidence", 6).alias("confidence"), "estimated_tokens", "saved_llm_call")


_ROUTE = """
WITH f AS (SELECT doc_id, CASE WHEN doc_id % 53 = 0 THEN 0 ELSE n_chars END AS chars, 0.6::DOUBLE + (doc_id % 9) / 8.0::DOUBLE * 0.4::DOUBLE AS ocr, 0.65::DOUBLE + (doc_id % 5) / 4.0::DOUBLE * 0.35::DOUBLE AS boundary FROM documents),
g AS (SELECT *, list_filter([CASE WHEN doc_id % 17 = 0 THEN 'protected_document_type' END, CASE WHEN ocr < 0.7::DOUBLE THEN 'low_ocr_score' END, CASE WHEN boundary < 0.7::DOUBLE THEN 'low_boundary_confidence' END, CASE WHEN doc_id % 31 = 0 THEN 'duplicate_warning' END, CASE WHEN doc_id % 37 = 0 THEN 'boundary_conflict' END, CASE WHEN doc_id % 19 = 0 THEN 'ambiguous_document_type' END], lambda x: x IS NOT NULL) AS r,
  list_filter([CASE WHEN doc_id % 3 = 0 THEN 'supplier' END, CASE WHEN doc_id % 13 = 0 THEN 'invoice_number' END, CASE WHEN doc_id % 7 = 0 THEN 'net' END, CASE WHEN doc_id % 7 = 0 THEN 'tax' END, CASE WHEN doc_id % 7 <> 0 AND doc_id % 11 = 0 THEN 'amount_details' END], lambda x: x IS NOT NULL) AS m FROM f),
h AS (SELECT *, CASE WHEN chars <= 0 THEN 'REJECTED' WHEN len(r) > 0 THEN 'MANUAL_REVIEW' WHEN ocr >= 0.85::DOUBLE AND boundary >= 0.9::DOUBLE AND len(m) = 0 THEN 'FAST_LANE' WHEN ocr >= 0.75::DOUBLE AND boundary >= 0.8::DOUBLE AND len(m) <= 2 THEN 'TARGETED_LLM' ELSE 'FULL_LLM' END AS route FROM g)"""


def route_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decide.route_summary(_routed(spark, sf_dir)).select("documents", "fast_lane", "targeted_llm", "full_llm", "manual_review", "rejected", "tokens", "calls_saved")


def _notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Invoices are orders; delivery notes are the same orders with faults by key, of those that have line items."""
    o, c = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate"), F.col
    inv = o.select(c("o_orderkey").alias("pair_id"), F.when(c("o_orderkey") % 3 == 0, c("o_custkey").cast("string")).alias("contact"), F.concat(F.lit("Customer "), c("o_custkey")).alias("name"), c("o_orderdate").cast("date").alias("day"), c("o_totalprice").alias("gross"))
    there = read(spark, sf_dir, "lineitem").select(c("l_orderkey").alias("pair_id")).distinct()
    note = o.select(
        c("o_orderkey").alias("pair_id"), F.when(c("o_orderkey") % 3 == 0, (c("o_custkey") + F.when(c("o_orderkey") % 11 == 0, 1).otherwise(0)).cast("string")).alias("contact"), F.concat(F.lit("CUSTOMER "), c("o_custkey") + F.when(c("o_orderkey") % 13 == 0, 1).otherwise(0)).alias("name"),
        F.date_add(c("o_orderdate").cast("date"), (c("o_orderkey") % 50).cast("int")).alias("day"), (c("o_totalprice") + F.when(c("o_orderkey") % 7 == 0, 1.0).otherwise(0.0)).alias("gross"),
    ).join(there, "pair_id", "left_semi")
    return entities.match_invoices(inv, note)


def invoice_match_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _notes(spark, sf_dir).select("pair_id", "match_status", "confidence_score", F.array_join("discrepancies", ",").alias("discrepancies"))


_MATCH = """
WITH n AS (SELECT DISTINCT l_orderkey AS pair_id FROM lineitem),
j AS (SELECT o_orderkey AS pair_id, n.pair_id IS NOT NULL AS has_note, list_filter([CASE WHEN o_orderkey % 3 = 0 AND o_orderkey % 11 = 0 THEN 'contact' WHEN o_orderkey % 3 <> 0 AND o_orderkey % 13 = 0 THEN 'name' END, CASE WHEN o_orderkey % 50 > 30 THEN 'date' END, CASE WHEN o_totalprice > 0 AND o_orderkey % 7 = 0 THEN 'amount' END], lambda x: x IS NOT NULL) AS d FROM orders LEFT JOIN n ON o_orderkey = n.pair_id)
SELECT pair_id, CASE WHEN NOT has_note THEN 'OFFEN_KEIN_LIEFERSCHEIN' WHEN len(d) = 0 THEN 'MATCHED' ELSE 'DISCREPANCY' END AS match_status, CASE WHEN NOT has_note THEN 0.5::DOUBLE WHEN len(d) = 0 THEN 0.95::DOUBLE ELSE 0.7::DOUBLE END AS confidence_score,
  CASE WHEN has_note THEN array_to_string(d, ',') ELSE '' END AS discrepancies FROM j"""


def match_discrepancies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _notes(spark, sf_dir).select(F.explode("discrepancies").alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


def partition_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders").join(read(spark, sf_dir, "customer").select("c_custkey", "c_name"), F.col("o_custkey") == F.col("c_custkey"))
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    status = F.when(F.col("o_orderstatus") == "F", "PASSED").otherwise("MANUAL_REVIEW_NEEDED")
    kind = F.when(F.col("o_orderstatus") == "O", "Lieferschein").otherwise("Rechnung")
    return o.select("o_orderkey", decide.destination(F.lit(""), F.col("c_name"), F.col("o_orderdate"), kind, ("customer",)).alias("folder"), decide.file_name(day, F.col("c_name"), F.col("o_totalprice"), status, F.lit("2000-01-01")).alias("file_name"))


_FILES = """
SELECT o_orderkey, '01_Eingangsarchiv/' || year(o_orderdate) || '/' || (['01_Januar','02_Februar','03_Maerz','04_April','05_Mai','06_Juni','07_Juli','08_August','09_September','10_Oktober','11_November','12_Dezember'])[month(o_orderdate)] || '/' || CASE WHEN o_orderstatus = 'O' THEN 'Lieferscheine' ELSE 'Rechnungen' END AS folder,
  strftime(o_orderdate, '%Y-%m-%d') || CASE WHEN o_orderstatus = 'F' AND o_totalprice > 0 THEN '_' || c_name || '_' || printf('%.2f', o_totalprice) ELSE '_UNKNOWN_' || c_name END || '.pdf' AS file_name
FROM (SELECT o.*, trim(regexp_replace(regexp_replace(c_name, '[^\\w\\-]', '_', 'g'), '_+', '_', 'g'), '_') AS c_name FROM orders o JOIN customer ON o_custkey = c_custkey)"""


def metadata_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    return o.groupBy("o_custkey", F.date_format("o_orderdate", "yyyy-MM").alias("month"), "o_orderpriority").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("keep_id")).where("n > 1")


def dominant_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.dominant(read(spark, sf_dir, "lineitem").select("l_suppkey", "l_tax"), "l_suppkey", "l_tax")


def amount_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = amounts.candidates(read(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text")
    return found.select("doc_id", "line_number", "place", "value", "currency", "field_type")


def amount_solutions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Net, tax and gross of each order and line number, from a text with three labelled amounts for each of its rows."""
    # dealt by document once: pages and candidates of a document are gathered where it lies
    line = spread(read(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("doc_id"), "l_extendedprice"), "doc_id")
    doc = F.concat_ws("\n", F.concat(F.lit("Netto "), F.format_string("%.2f", "l_extendedprice")), F.concat(F.lit("MwSt 19% "), F.format_string("%.2f", F.col("l_extendedprice") * 0.19)), F.concat(F.lit("Gesamtbetrag EUR "), F.format_string("%.2f", F.col("l_extendedprice") * 1.19)))
    found = amounts.candidates(line.select("doc_id", doc.alias("text")), "doc_id", "text")
    return amounts.solve(found)


QUERIES = {f.__name__: f for f in (price_trends, price_trends_multi, validation_shield, route_documents, route_summary, invoice_match_status, match_discrepancies, partition_routing, metadata_duplicates, dominant_rate, amount_candidates, amount_solutions)}

_TRENDS = """
WITH obs AS (SELECT l_suppkey, l_partkey, l_extendedprice / l_quantity AS p, o_orderdate AS d, l_orderkey AS k, l_linenumber AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
t AS (SELECT l_suppkey, l_partkey, arg_min(p, (d, k, n, p)) AS oldest_price, arg_max(p, (d, k, n, p)) AS latest_price, count(*) AS data_points FROM obs GROUP BY ALL),
c AS (SELECT *, CASE WHEN oldest_price <> 0 THEN (latest_price - oldest_price) / oldest_price * 100 ELSE 0.0 END AS change_percent FROM t)
SELECT *, round(change_percent, 2) > 2.0 AS warning FROM c"""

SQL = {
    "price_trends": _TRENDS,
    "price_trends_multi": _TRENDS + " WHERE data_points >= 2",
    "validation_shield": _VALIDATION,
    "route_documents": _ROUTE + """
SELECT doc_id, route, CASE route WHEN 'REJECTED' THEN 'no_pages' WHEN 'MANUAL_REVIEW' THEN array_to_string(r, ',') ELSE '' END AS reasons, CASE WHEN route LIKE '%LLM' THEN array_to_string(m, ',') ELSE '' END AS missing,
  round(CASE WHEN route = 'FAST_LANE' THEN least(ocr, boundary, 0.95::DOUBLE, 0.92::DOUBLE) WHEN route LIKE '%LLM' THEN greatest(0::DOUBLE, least(1::DOUBLE, least(ocr, boundary, 0.95::DOUBLE, CASE WHEN doc_id % 13 = 0 THEN 1 ELSE 0.92::DOUBLE END) - len(m) * 0.1::DOUBLE)) ELSE 1 END, 6) AS confidence,
  CASE WHEN route LIKE '%LLM' THEN (ceil(chars / 4.0) + 250 + len(m) * 80)::BIGINT ELSE 0 END AS estimated_tokens, CASE WHEN route = 'FAST_LANE' THEN true WHEN route LIKE '%LLM' THEN false END AS saved_llm_call FROM h""",
    "route_summary": _ROUTE + """
SELECT count(*) AS documents, count(*) FILTER (route = 'FAST_LANE') AS fast_lane, count(*) FILTER (route = 'TARGETED_LLM') AS targeted_llm, count(*) FILTER (route = 'FULL_LLM') AS full_llm, count(*) FILTER (route = 'MANUAL_REVIEW') AS manual_review, count(*) FILTER (route = 'REJECTED') AS rejected,
  coalesce(sum(CASE WHEN route LIKE '%LLM' THEN (ceil(chars / 4.0) + 250 + len(m) * 80)::BIGINT ELSE 0 END), 0)::BIGINT AS tokens, count(*) FILTER (route = 'FAST_LANE') AS calls_saved FROM h""",
    "invoice_match_status": _MATCH,
    "match_discrepancies": f"SELECT reason, count(*) AS n FROM (SELECT unnest(string_split(discrepancies, ',')) AS reason FROM ({_MATCH}) WHERE discrepancies <> '') GROUP BY reason",
    "partition_routing": _FILES,
    "metadata_duplicates": "SELECT o_custkey, strftime(o_orderdate, '%Y-%m') AS month, o_orderpriority, count(*) AS n, min(o_orderkey) AS keep_id FROM orders GROUP BY ALL HAVING count(*) > 1",
    "dominant_rate": "SELECT l_suppkey, arg_max(l_tax, (n, -l_tax)) AS dominant, max(n) AS n FROM (SELECT l_suppkey, l_tax, count(*) AS n FROM lineitem GROUP BY ALL) GROUP BY l_suppkey",
}
