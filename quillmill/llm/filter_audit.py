"""How filters interact: joint failures of all sets of filters, and what follows from them by inclusion and exclusion.

Each document's failures are five flags.  For each part the flags' products are summed over all 32 sets of filters,
J(S) = the sum of the products of the flags in S: how many documents fail every filter of S.  All else is arithmetic on
these 32 numbers:

* survivors of a set of filters, whatever their order, by Möbius inversion: kept(S) = sum over T within S of (-1)^|T| J(T);
* what a filter removes after others P: kept(P) - kept(P + f); what it finds already removed: J(f) less that;
* failures of f alone: sum over T without f of (-1)^|T| J(T + f);
* Shapley value: the game v(S) = J(0) - kept(S) has the Harsanyi dividends (-1)^(|T|+1) J(T), each shared evenly within T.

A text is read once, where it is stored; flags and a digest of the text go on.  Filter E (an equal text under a smaller
doc_id) needs the least doc_id of each digest: counts and least ids are aggregated by digest and part before they
meet, so a text with many copies is a few rows by then.  Digests are SHA-256.

Cases: null texts are empty; an empty text fails A (no words), not B (0 of 0), C or D; a null doc_id is neither smaller
nor larger than any, so E fails nothing by it and not its rows; rows of one doc_id and text fail E only for a smaller
doc_id; a label counts once, however often it is repeated; a null source is the part '';
an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

FILTERS = "ABCDE"
N = len(FILTERS)
SETS = range(1 << N)
#: Orders of the filters that a Shapley value averages over; here it is their sum.
ORDERS = list(permutations(range(N)))
#: What is counted of the documents of a set: all, those of quality 1, toxic ones.
WEIGHTS = ("docs", "good", "toxic")


def text_failures(text: Column) -> dict[str, Column]:
    """Failures that a text shows by itself."""
    bare = F.btrim(text, F.lit(" \t\n\x0b\f\r"))
    words, none = F.split(bare, r"[\x20\x09-\x0D]+"), (bare == "").cast("int")  # split makes one word of ''
    n = F.size(words) - none
    return {
        "A": n < 200,
        "B": 100 * (F.size(F.array_distinct(words)) - none) < 50 * n,
        "C": 100 * (F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))) > 2 * F.length(text),
        "D": F.rlike(text, F.lit("[#$%&*|]")),
    }


def failure_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, the five flags (0 or 1) and docs, good, toxic: numbers of documents with just these failures."""
    marks = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max(F.coalesce((F.col("quality") == 1).cast("int"), F.lit(0))).alias("good"), F.max(F.coalesce((F.col("toxic") == 1).cast("int"), F.lit(0))).alias("toxic")
    )
    text = F.coalesce(F.col("text"), F.lit(""))
    own = [c.cast("int").alias(k) for k, c in text_failures(text).items()]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), F.sha2(text, 256).alias("digest"), *own)
    zero = lambda k: F.coalesce(F.col(k), F.lit(0)).alias(k)
    rows = rows.join(marks, "doc_id", "left").select("doc_id", "part", "digest", *"ABCD", zero("good"), zero("toxic"))
    alike = ["part", *"ABCD", "good", "toxic"]
    # rows of a doc_id first: the least of the structs then says how many rows have the least doc_id
    same = rows.groupBy("digest", "doc_id", *alike).agg(F.count("*").alias("n"))
    least = F.min(F.when(F.col("doc_id").isNotNull(), F.struct(F.col("doc_id").alias("id"), F.col("n")))).alias("least")
    groups = same.groupBy("digest", F.col("doc_id").isNull().alias("none"), *alike).agg(F.sum("n").alias("n"), least)
    first = groups.groupBy("digest").agg(F.min("least.id").alias("first"))
    spared = F.when(F.col("none"), F.col("n")).when(F.col("least.id") == F.col("first"), F.col("least.n")).otherwise(0)
    both = F.array(F.struct(F.lit(0).alias("E"), spared.alias("n")), F.struct(F.lit(1).alias("E"), (F.col("n") - spared).alias("n")))
    told = groups.join(first, "digest").select(*alike, F.inline(both))
    weight = {"docs": F.col("n"), "good": F.col("n") * F.col("good"), "toxic": F.col("n") * F.col("toxic")}
    return told.where("n > 0").groupBy("part", *FILTERS).agg(*[F.sum(c).alias(k) for k, c in weight.items()])


def joint_failures(counts: DataFrame) -> DataFrame:
    """part, set (bit k stands for filter k), docs, good, toxic: the sums of the products of a set's flags; sets of none are left out."""
    product = F.lit(1)
    for k, f in enumerate(FILTERS):
        product = product * F.when(F.getbit("set", F.lit(k)) == 1, F.col(f)).otherwise(1)
    rows = counts.withColumn("set", F.explode(F.lit(list(SETS)))).withColumn("product", product).where("product = 1")
    return rows.groupBy("part", "set").agg(*[F.sum(F.col("product") * F.col(w)).alias(w) for w in WEIGHTS])


def survivors(joint: DataFrame) -> DataFrame:
    """part, set, docs, good, toxic: what is left after the filters of each set, a signed sum over its subsets."""
    within = joint.withColumnRenamed("set", "sub").withColumn("set", F.explode(F.lit(list(SETS)))).where(F.col("set").bitwiseAND(F.col("sub")) == F.col("sub"))
    sign = F.when(F.bit_count("sub") % 2 == 1, -1).otherwise(1)
    return within.groupBy("part", "set").agg(*[F.sum(sign * F.col(w)).alias(w) for w in WEIGHTS])


def shares(joint: DataFrame) -> DataFrame:
    """part, f, failing, unique, shapley of each filter that some document fails: signed sums over the sets that hold it."""
    size = F.bit_count("set")
    sign = F.when(size % 2 == 1, 1).otherwise(-1)
    own = joint.withColumn("f", F.explode(F.lit(list(range(N))))).where(F.getbit("set", F.col("f")) == 1)
    dividend = (sign * F.lit(len(ORDERS)) / size * F.col("docs")).cast("long")  # whole: 1 to 5 divide 120
    return own.groupBy("part", "f").agg(F.sum(F.when(size == 1, F.col("docs"))).alias("failing"), F.sum(sign * F.col("docs")).alias("unique"), F.sum(dividend).alias("shapley"))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley for all orders and steps.

    docs: doc_id, text, source.  labels: doc_id, quality, toxic.
    """
    joint = common.materialize(joint_failures(failure_counts(docs, labels)), "joint")  # at most 32 rows for each part
    left = survivors(joint).groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("set", F.struct(*WEIGHTS)))).alias("left"))
    of = shares(joint).groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("f", F.struct("failing", "unique", "shapley")))).alias("of"))
    steps = [F.struct(F.lit("".join(FILTERS[f] for f in order)).alias("filter_order"), F.lit(k + 1).alias("step"), F.lit(order[k]).alias("f"), F.lit(sum(1 << x for x in order[:k])).alias("before")) for order in ORDERS for k in range(N)]
    rows = left.join(of, "part", "left").select("*", F.inline(F.array(*steps))).withColumn("after", F.col("before").bitwiseOR(F.call_function("shiftleft", F.lit(1), F.col("f"))))
    rows = rows.select("part", "filter_order", "step", F.col("left")[F.col("before")].alias("b"), F.col("left")[F.col("after")].alias("a"), F.try_element_at("of", F.col("f")).alias("own"))
    own = lambda k: F.coalesce(F.col(f"own.{k}"), F.lit(0).cast("long"))
    lost = lambda w: F.col(f"b.{w}") - F.col(f"a.{w}")
    return rows.select(
        "part", "filter_order", "step", F.col("a.docs").alias("kept"), lost("docs").alias("removed"), (own("failing") - lost("docs")).alias("redundant"),
        own("unique").alias("unique_fails"), lost("good").alias("good_lost"), lost("toxic").alias("toxic_lost"), own("shapley").alias("shapley"),
    )


def op12_filter_interaction_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))
