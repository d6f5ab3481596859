"""Quality rules whose cutoffs adapt to each language and source by mergeable quantile sketches.

Each text is measured once.  The measures of texts that pass the base rule go, as whole numbers, into log-linear
histogram sketches (buckets with at most 1/32 relative width; two sketches merge by adding counts, so the result
does not depend on order or partitioning).  One sketch stands for each (lang, source), and its counts also add up
to one for each lang and one for all.  A group with under ``min_docs`` texts takes its language's cutoffs, and a
language with too few those of all texts.  Each measure names a tail in percent and a spread.  Its upper cutoff is
``q_tail + spread * (q_tail - q50)``, far outside of what the group's own texts do, so a group's ordinary texts stay;
word length has a lower one likewise, from the other end.  Where the last percent is
asked, a group's distance is at least its language's, since few of a group's texts, or none, tell it; every distance
is at least the width of the sketch's bucket.  No further constant enters.  The texts' measures join the cutoffs on (lang, source).

Cases: a null or empty text has no words and fails the base rule; null lang or source is a group of its own; equal
rows get equal verdicts; an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

#: Fixed by the contract: word pattern, symbols, base rule.
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOLS = "#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: Measures in whole numbers, each with a tail in percent and a spread.  Word length and symbols take quartiles, which
#: hold while three quarters of a group's texts are ordinary; lines and words that recur are rare in ordinary texts
#: too, so their quartiles say nothing and the last percent is asked.
MEASURES = {
    "m_length": ("word_chars * 100", "n_words", 75, 10),
    "m_symbols": ("n_symbols * 1000", "n_words", 75, 8),
    "m_dup": ("n_dup_lines * 1000", "n_lines", 99, 2),
    "m_repeat": ("n_repeat_words * 1000", "n_words", 99, 2),
}
#: Measures that are odd at both ends.
BOTH = ("m_length",)
MIN_DOCS = 30
#: Tails from which on a group's distance is at least its language's.
RARE = 99
#: Columns of cutoffs: each measure's upper one, then the lower ones.
CUTS = (*MEASURES, *[f"{k}_low" for k in BOTH])
#: Sub-buckets of a power of two.
SUB = 32

_symbols = re.compile("[" + re.escape(SYMBOLS) + "]")


def measure(text: str | None) -> tuple[int, int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_lines with a word, n_dup_lines, n_repeat_words."""
    words = WORD.findall(text or "")
    if not words:
        return 0, 0, len(_symbols.findall(text or "")), 0, 0, 0
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(_symbols.findall(text)), len(lines), len(lines) - len(set(lines)), repeated(words)


def repeated(words: list[str]) -> int:
    """Words that lie in a 3-word window which the text has twice or more."""
    n = len(words)
    if n < 4:
        return 0
    place: dict[str, int] = {}
    ids = np.fromiter((place.setdefault(w, len(place)) for w in words), np.int64, n)
    if len(place) == n:
        return 0
    _, pair = np.unique(ids[:-1] * len(place) + ids[1:], return_inverse=True)
    _, at, count = np.unique(pair[:-1].astype(np.int64) * len(place) + ids[2:], return_inverse=True, return_counts=True)
    twice = count[at] > 1
    hit = np.zeros(n, bool)
    for k in range(3):
        hit[k : n - 2 + k] |= twice
    return int(hit.sum())


def base_failed(n_words: int, n_repeat_words: int) -> bool:
    return n_words < MIN_WORDS or 100 * n_repeat_words > MAX_REPEAT_PERCENT * n_words


NAMES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def measured(rows: DataFrame) -> DataFrame:
    """rows (boxed, see common) with the measures of each row's text beside it."""

    def run(row):
        return dict(zip(NAMES, list(zip(*map(measure, row.field("text").to_pylist()))) or [()] * 6))

    out = common.map_boxed(rows, ", ".join(f"{n} long" for n in NAMES), run)
    return out.withColumn("base_failed", F.expr(f"n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words"))


def bucket(v: Column) -> Column:
    """The sketch's bucket of a whole number v >= 0: v itself below 2 * SUB, then SUB buckets for each power of two."""
    power = F.greatest(F.length(F.bin(v)) - F.lit(6), F.lit(0))
    return (power * F.lit(SUB) + F.call_function("shiftright", v, power)).cast("long")


def least_of(bucket_col: Column) -> Column:
    """The least number in a bucket; the inverse of ``bucket``."""
    power = F.greatest(F.floor((bucket_col - F.lit(SUB)) / F.lit(SUB)).cast("int"), F.lit(0))
    return F.call_function("shiftleft", bucket_col - power * F.lit(SUB), power).cast("long")


def sketches(stats: DataFrame) -> DataFrame:
    """lang, source, level, measure, bucket, n: level 0 for (lang, source), 1 for lang, 2 for all."""
    good = stats.where(~F.col("base_failed")).select("lang", "source", *[F.expr(f"({a}) div greatest({b}, 1)").alias(k) for k, (a, b, *_) in MEASURES.items()])
    long = good.unpivot(["lang", "source"], list(MEASURES), "measure", "v").groupBy("lang", "source", "measure", bucket(F.col("v")).alias("bucket")).agg(F.count("*").alias("n"))
    by_lang = long.groupBy("lang", "measure", "bucket").agg(F.sum("n").alias("n"))
    overall = by_lang.groupBy("measure", "bucket").agg(F.sum("n").alias("n"))
    null = F.lit(None).cast("string")
    return (
        long.select("lang", "source", F.lit(0).alias("level"), "measure", "bucket", "n")
        .unionByName(by_lang.select("lang", null.alias("source"), F.lit(1).alias("level"), "measure", "bucket", "n"))
        .unionByName(overall.select(null.alias("lang"), null.alias("source"), F.lit(2).alias("level"), "measure", "bucket", "n"))
    )


def width(v: Column) -> Column:
    """The width of the bucket that begins at v."""
    return F.call_function("shiftleft", F.lit(1), F.greatest(F.length(F.bin(v)) - F.lit(6), F.lit(0))).cast("long")


def cutoffs(sketch: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """lang, source and the cutoffs; one row for each group that the sketches know at level 0."""
    key = Window.partitionBy("level", "lang", "source", "measure")
    ranked = sketch.withColumn("upto", F.sum("n").over(key.orderBy("bucket"))).withColumn("total", F.sum("n").over(key))
    of = lambda i: F.element_at(F.create_map(*[F.lit(x) for k, m in MEASURES.items() for x in (k, m[i])]), F.col("measure"))
    ranked = ranked.withColumn("tail", of(2))
    at = lambda q: least_of(F.min(F.when(F.col("upto") * 100 >= F.col("total") * q, F.col("bucket"))))
    quant = ranked.groupBy("level", "lang", "source", "measure", "tail").agg(
        at(F.lit(100) - F.col("tail")).alias("q_low"), at(F.lit(50)).alias("q_mid"), at(F.col("tail")).alias("q_high"), F.max("total").alias("total")
    )
    quant = quant.withColumns({"up": F.col("q_high") - F.col("q_mid"), "down": F.col("q_mid") - F.col("q_low")})
    whole = quant.where((F.col("level") == 1) & (F.col("total") >= min_docs)).select(F.col("lang").alias("w_lang"), F.col("measure").alias("w_measure"), F.col("up").alias("w_up"), F.col("down").alias("w_down"))
    widened = quant.join(whole, F.expr(f"level = 0 and tail >= {RARE} and lang <=> w_lang and measure = w_measure"), "left")
    least = lambda own, lang: of(3) * F.greatest(F.col(own), F.col(lang), width(F.col("q_high")))
    cut = widened.withColumns({"high": F.col("q_high") + least("up", "w_up"), "low": F.col("q_low") - least("down", "w_down")})
    pivot = [F.max(F.when(F.col("measure") == k, F.col("high"))).alias(k) for k in MEASURES] + [F.max(F.when(F.col("measure") == k, F.col("low"))).alias(f"{k}_low") for k in BOTH]
    wide = cut.groupBy("level", "lang", "source").agg(F.max("total").alias("docs"), *pivot)
    level = lambda n, p: wide.where(F.col("level") == n).select(*[F.col(c).alias(p + c) for c in ("lang", "source", "docs", *CUTS)])
    every = wide.where("level = 2").first()  # one row, whatever the input
    joined = level(0, "a_").join(level(1, "b_"), F.expr("a_lang <=> b_lang"), "left")
    last = lambda k: F.lit(every[k] if every else None).cast("long")
    pick = lambda k: F.when(F.col("a_docs") >= min_docs, F.col(f"a_{k}")).when(F.col("b_docs") >= min_docs, F.col(f"b_{k}")).otherwise(last(k))
    return joined.select(F.col("a_lang").alias("cut_lang"), F.col("a_source").alias("cut_source"), *[pick(k).alias(f"cut_{k}") for k in CUTS])


def judge(stats: DataFrame, cut: DataFrame) -> DataFrame:
    """stats with kept: false for base_failed, else whether all measures are within the group's cutoffs.

    The cutoffs come from a written table, so Spark broadcasts them only while its files are under its own
    threshold; beyond it both sides are shuffled, and AQE splits a hot (lang, source).
    """
    within = F.lit(True)
    for k, (a, b, *_) in MEASURES.items():
        within = within & F.coalesce(F.expr(f"({a}) div greatest({b}, 1)") <= F.col(f"cut_{k}"), F.lit(True))
        if k in BOTH:
            within = within & F.coalesce(F.expr(f"({a}) div greatest({b}, 1)") >= F.col(f"cut_{k}_low"), F.lit(True))
    joined = stats.join(cut, F.expr("lang <=> cut_lang and source <=> cut_source"), "left")
    return joined.withColumn("kept", ~F.col("base_failed") & within).drop(*[f"cut_{k}" for k in ("lang", "source", *CUTS)])


def _judged(rows: DataFrame, carried: list[str]) -> DataFrame:
    stats = measured(rows).select(*carried, F.col("_row.lang").cast("string").alias("lang"), F.col("_row.source").cast("string").alias("source"), *NAMES, "base_failed")
    stats = common.materialize(stats, "quality")
    sketch = common.materialize(sketches(stats), "sketches")
    return judge(stats, common.materialize(cutoffs(sketch), "cutoffs"))


def quality_rules(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, the measures, base_failed and kept of each row of docs."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "source", "text")
    return _judged(common.boxed(docs), [F.col("_row.doc_id").alias("doc_id")])


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of docs that the rules keep, with all their columns.  Texts are measured once and written beside their measures."""
    return _judged(common.boxed(docs), ["_row"]).where("kept").select("_row.*")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(common.table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
