"""Page stacks to documents: blank pages, transition scores, segment numbers, and comparison of segmentations.

A stack's pages meet once, sorted, in one window partition by source; all signals come from lag and running counts.
Signals are data (patterns and weights), so other languages or layouts need no other plan.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as tx


@dataclass(frozen=True)
class Signals:
    """Patterns of page signals (German and English)."""

    first_page: str = r"(?iU)(?:seite|page|blatt)\s*1\s*(?:von|of|/)\s*\d+"
    header: str = r"(?iU)\b(?:rechnung|invoice|gutschrift|lieferschein|mahnung)\b"
    number: str = r"(?iU)(?:rechnungs-?nr\.?|rechnungsnummer|invoice\s*no\.?|beleg-?nr\.?)\s*[:]?\s*([\w\-\/]+)"
    customer: str = r"(?iU)(?:kunden-?nr\.?|kundennummer|customer\s*no\.?)\s*[:]?\s*([\w\-\/]+)"
    date: str = r"(?iU)(?:datum|date|rechnungsdatum)\s*[:]?\s*\d{1,2}[\./\-]\d{1,2}[\./\-]\d{2,4}"
    total: str = r"(?iU)(?:gesamtbetrag|rechnungsbetrag|zahlbetrag|total\s*amount)\s*[:]?\s*[\d\.\,]+\s*(?:€|eur|usd|\$)?"
    later_page: str = r"(?iU)(?:seite|page|blatt)\s*([2-9]|\d{2,})\s*(?:von|of|/)\s*\d+"
    continued: str = r"(?iU)\b(?:übertrag|fortsetzung|continued)\b"
    page_of: str = r"(?iU)(?:seite|page|blatt)\s*(\d+)\s*(?:von|of|/)\s*(\d+)"


#: Base score, thresholds, and the weights of the signals in the order in which they are added.
BASE, BOUNDARY, AMBIGUOUS = 0.2, 0.6, 0.4
FOR = {"first_page": 0.6, "new_number": 0.8, "new_header": 0.5, "new_date": 0.3, "after_last": 0.7, "after_total": 0.4, "separator": 0.5}
AGAINST = {"later_page": 0.6, "continued": 0.5, "same_number": 0.7, "same_customer": 0.4}


def page_classes(pages: DataFrame, source: str, page: str, text: str, insufficient: Column | None = None) -> DataFrame:
    """pages with page_class: CONTENT, SEPARATOR_PAGE or BLANK_BACKSIDE, and the stack's has_gap and has_duplicate."""
    w = Window.partitionBy(source).orderBy(page)
    empty = insufficient if insufficient is not None else tx.insufficient_page(F.col(text))
    out = pages.withColumns({"_blank": empty, "_alnum": tx.alnum_count(F.col(text))}).withColumns({"_prev_blank": F.lag("_blank").over(w), "_step": F.col(page) - F.lag(page).over(w)})
    kind = F.when(~F.col("_blank"), "CONTENT").when(F.col("_alnum") == 0, "SEPARATOR_PAGE").when(~F.coalesce(F.col("_prev_blank"), F.lit(True)), "BLANK_BACKSIDE").otherwise("SEPARATOR_PAGE")
    stack = Window.partitionBy(source)
    return out.withColumn("page_class", kind).withColumns({"has_gap": F.coalesce(F.max(F.col("_step") > 1).over(stack), F.lit(False)), "has_duplicate": F.coalesce(F.max(F.col("_step") == 0).over(stack), F.lit(False))}).drop("_blank", "_alnum", "_prev_blank", "_step")


def transitions(pages: DataFrame, source: str, page: str, text: str, signals: Signals = Signals(), insufficient: Column | None = None) -> DataFrame:
    """One row for each content page: score against the previous content page, is_boundary, is_ambiguous, doc_seq."""
    t = F.trim(F.coalesce(F.col(text), F.lit("")))
    classed = page_classes(pages, source, page, text, insufficient)
    w = Window.partitionBy(source).orderBy(page)
    marked = classed.withColumn("_seps", F.sum((F.col("page_class") == "SEPARATOR_PAGE").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))).where("page_class = 'CONTENT'")
    number = F.lower(F.regexp_extract(t, signals.number, 1))
    # what a pattern matched in either case is compared in either case
    page_of = F.struct(F.lower(F.regexp_extract(t, signals.page_of, 1)).alias("page"), F.lower(F.regexp_extract(t, signals.page_of, 2)).alias("of"))
    flags = F.struct(
        t.rlike(signals.first_page).alias("first"), number.alias("number"), F.lower(F.regexp_extract(t, signals.customer, 1)).alias("customer"), t.rlike(signals.header).alias("header"), t.rlike(signals.date).alias("date"), t.rlike(signals.total).alias("total"),
        t.rlike(signals.later_page).alias("later"), t.rlike(signals.continued).alias("continued"), ((page_of["page"] != "") & (page_of["page"] == page_of["of"])).alias("last"), F.col("_seps").alias("seps"),
    )
    rows = marked.withColumn("_f", flags).withColumn("_p", F.lag("_f").over(w))
    f, p = F.col("_f"), F.col("_p")
    both = lambda k: (f[k] != "") & (p[k] != "")
    plus = {"first_page": f["first"], "new_number": both("number") & (f["number"] != p["number"]), "new_header": f["header"] & ~p["header"], "new_date": f["date"] & ~p["date"], "after_last": p["last"], "after_total": p["total"], "separator": f["seps"] > p["seps"]}
    minus = {"later_page": f["later"], "continued": f["continued"], "same_number": both("number") & (f["number"] == p["number"]), "same_customer": both("customer") & (f["customer"] == p["customer"])}
    total = lambda flags, weights: sum((F.when(flags[k], F.lit(v)).otherwise(F.lit(0.0)) for k, v in weights.items()), F.lit(0.0))
    score = F.when(p.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(BASE) + total(plus, FOR) - total(minus, AGAINST))))
    out = rows.withColumn("score", score).withColumns({"is_boundary": F.coalesce(F.col("score") > BOUNDARY, F.lit(False)), "is_ambiguous": F.coalesce((F.col("score") >= AMBIGUOUS) & (F.col("score") <= BOUNDARY), F.lit(False))})
    return out.withColumn("doc_seq", F.sum(F.col("is_boundary").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)) + 1).drop("_seps", "_f", "_p")


def documents(transition: DataFrame, source: str, page: str) -> DataFrame:
    """One row for each document of a stack: start_page, end_page, confidence, ambiguous transitions.

    confidence = 0.4 * start + 0.4 * end + 0.2 * mean of (1 - score) inside; 0.8 where there is no such transition.
    """
    inside = transition.groupBy(source, "doc_seq").agg(
        F.min(page).alias("start_page"), F.max(page).alias("end_page"), F.max(F.when(F.col("is_boundary"), F.col("score"))).alias("_start"),
        F.avg(F.when(~F.col("is_boundary"), F.lit(1.0) - F.col("score"))).alias("_inner"), F.count_if("is_ambiguous").alias("ambiguous"), F.first("has_gap").alias("has_gap"),
    )
    nxt = F.lead("_start").over(Window.partitionBy(source).orderBy("doc_seq"))
    conf = F.least(F.lit(1.0), F.coalesce("_start", F.lit(0.8)) * 0.4 + F.coalesce(F.col("_end"), F.lit(0.8)) * 0.4 + F.coalesce("_inner", F.lit(0.8)) * 0.2)
    return inside.withColumn("_end", nxt).withColumn("confidence", conf).drop("_start", "_end", "_inner")
