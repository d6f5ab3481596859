"""A search index that is kept: postings in blocks with maxima, delta segments for upserts, and a top-k that skips blocks.

The index lives in a ``Store`` as two tables, written in one commit:

* ``<name>_postings`` – term, slice, docs (array of doc_id, len, tf), most (the largest tf) and least (the smallest len): one
  row for a term and a slice, and a slice is some SLICE documents, so a row is bounded however frequent the term; files hold
  whole slices;
* ``<name>_lengths`` – doc_id, len: what a segment holds, also documents without a word.

``refresh`` adds the postings of new and changed documents as a segment; a document counts in its latest segment alone.
``compact`` makes one segment of all.  A file's rows are ordered by term, so a reader of few words skips row groups.

``search`` gives the rows of ``retrieve.bm25`` over the same documents.  Postings of each asked word (a prefix of terms) are
gathered once, however many questions ask it, and their blocks keep bounds: a block's largest tf and smallest length bound
the word's part of any score in it.  For a question the bounds of its words add up to a bound of each slice.  The
slices with the best bounds are scored first; the k-th best score found is a threshold, and a slice whose bound is below it
holds no document of the first k, so it is never joined.  Nothing is left out that could enter the result.  Where many pairs
of question and posting are left, the slices that any question needs are dealt to tasks and all questions are scored there:
a slice holds its documents whole, so only the first k of each task are shuffled.

Cases: null texts are empty; a document without words has no postings and counts for the number and mean length of
documents; questions without words have no rows; an empty index gives none; a null doc_id is not indexed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as tx
from ..sources.scratch import materialize
from ..sources.store import Conflict, State, Store
from .retrieve import ASKED, K1, PAIRS, B, terms, top_of

#: Documents of a slice, slices that a question looks at first, and words that a reader pushes down to the files.
SLICE, PROBES, PUSHED = 64, 8, 256
#: Pairs of question and posting that may be shuffled; more are summed where their slices lie.
FEW = 1 << 22
#: What a sum of parts may be off by, in another order.
MARGIN = 1e-6


def postings(docs: DataFrame, doc_id: str, text: str, slice_docs: int = SLICE) -> tuple[DataFrame, DataFrame]:
    """(postings, lengths) of one segment."""
    words = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("long").alias("doc_id"), terms(F.coalesce(F.col(text), F.lit(""))).alias("_t"))
    split = materialize(words.select("doc_id", F.size("_t").alias("len"), "_t"), "split")
    slices = max(1, -(-split.count() // slice_docs))
    # texts are dealt by slice once; both groupings and the order are met by that, so words are not dealt again
    dealt = split.withColumn("slice", F.pmod(F.xxhash64("doc_id"), F.lit(slices))).repartition("slice")
    counted = dealt.select("slice", "doc_id", "len", F.explode("_t").alias("term")).groupBy("slice", "doc_id", "len", "term").agg(F.count("*").cast("int").alias("tf"))
    return _blocks(counted).sortWithinPartitions("term", "slice"), split.select("doc_id", "len")


def _blocks(rows: DataFrame) -> DataFrame:
    """Posting blocks of rows (term, slice, doc_id, len, tf)."""
    return rows.groupBy("term", "slice").agg(F.collect_list(F.struct("doc_id", "len", "tf")).alias("docs"), F.max("tf").alias("most"), F.min("len").alias("least"))


def part(tf: Column, length: Column, idf: Column, mean: Column) -> Column:
    """A word's part of a document's score: it grows with tf and falls with the length."""
    return idf * tf * (K1 + 1) / (tf + K1 * (F.lit(1 - B) + F.lit(B) * length / mean))


class SearchIndex:
    """An index over one text column of documents in a store."""

    def __init__(self, store: Store, name: str = "search", slice_docs: int = SLICE):
        self.store, self.slice_docs = store, slice_docs
        self.postings, self.lengths = f"{name}_postings", f"{name}_lengths"

    def segment(self, docs: DataFrame, doc_id: str, text: str) -> tuple[str, str]:
        """Writes a segment's folders, which no version names yet; ``adding`` names them, beside whatever else is committed."""
        blocks, lengths = postings(docs, doc_id, text, self.slice_docs)
        return self.store.write(blocks), self.store.write(lengths)

    def adding(self, state: State, segment: tuple[str, str]) -> State:
        return state.adding(self.postings, segment[0]).adding(self.lengths, segment[1])

    def refresh(self, docs: DataFrame, doc_id: str, text: str) -> State:
        """Puts documents in place of those of equal ids, or beside the others."""
        made = self.segment(docs, doc_id, text)
        return self.store.update(lambda s: self.adding(s, made))

    def compact(self) -> State:
        """One segment in place of those there are; segments that others add meanwhile stay behind it."""
        old = self.store.state()
        was = {t: old.tables.get(t, []) for t in (self.postings, self.lengths)}
        if len(was[self.lengths]) < 2:
            return old
        live, dead = self._live(old)
        rows = self._alive(self.store.read(self.postings, old).select("term", "_commit", F.inline("docs")), dead)
        slices = max(1, -(-live.count() // self.slice_docs))
        blocks = _blocks(rows.withColumn("slice", F.pmod(F.xxhash64("doc_id"), F.lit(slices))).repartition("slice"))
        made = {self.postings: self.store.write(blocks.sortWithinPartitions("term", "slice")), self.lengths: self.store.write(live.select("doc_id", "len"))}

        def change(s: State) -> State:
            if any(s.tables.get(t, [])[: len(was[t])] != was[t] for t in made):
                raise Conflict("the index was compacted meanwhile")
            for t, folder in made.items():
                s = s.with_table(t, [folder, *s.tables[t][len(was[t]) :]])
            return s

        return self.store.update(change)

    def _live(self, state: State) -> tuple[DataFrame, DataFrame | None]:
        """(doc_id, len, _commit) of the documents as they are now, and (doc_id, _last) of those that some segment replaced."""
        every = self.store.read(self.lengths, state)
        if len(state.tables[self.lengths]) == 1:
            return every, None
        last = every.groupBy("doc_id").agg(F.max_by("len", "_commit").alias("len"), F.max("_commit").alias("_commit"), F.min("_commit").alias("_first"))
        last = materialize(last, "live")
        return last.drop("_first"), last.where("_first < _commit").select("doc_id", F.col("_commit").alias("_last"))

    @staticmethod
    def _alive(rows: DataFrame, dead: DataFrame | None) -> DataFrame:
        """rows (doc_id, _commit) without those of a document that a later segment holds."""
        return rows if dead is None else rows.join(dead.withColumnRenamed("doc_id", "_d"), (F.col("doc_id") == F.col("_d")) & (F.col("_commit") < F.col("_last")), "left_anti")

    def _matched(self, words: DataFrame, state: State) -> DataFrame:
        """word, _commit, slice, docs of the blocks whose term begins like an asked word."""
        few = [r[0] for r in words.limit(PUSHED + 1).collect()]
        rows = self.store.read(self.postings, state)
        if len(few) <= PUSHED:  # the files skip what no word begins; Parquet compares beginnings
            rows = rows.where(reduce(lambda a, b: a | b, [F.col("term").startswith(w) for w in few], F.lit(False)))
        stemmed = words.withColumn("_stem", F.substring("word", 1, 3))
        sizes = [r[0] for r in stemmed.select(F.length("_stem").alias("n")).distinct().collect()]  # 1, 2, 3 at most: words shorter than a stem are their own
        stems = F.explode(F.array_distinct(F.array(*[F.substring("term", 1, n) for n in sizes] or [F.lit("")])))
        return rows.withColumn("_stem", stems).join(stemmed, "_stem").where(F.col("term").startswith(F.col("word"))).drop("_stem")

    def search(self, queries: DataFrame, top: int = 5, state: State | None = None, counts: dict | None = None) -> DataFrame:
        """query_id, doc_id, score, rank for queries (query_id, words); ties go to the smaller doc_id.

        ``counts``, if given, is filled: ``all`` is how many (question, posting) rows a join of everything would make,
        ``read`` how many were made.
        """
        state = state or self.store.state()
        none = queries.sparkSession.createDataFrame([], "query_id long, doc_id long, score double, rank int")
        if not state.tables.get(self.lengths):
            return none
        asked = materialize(queries.select("query_id", F.explode("words").alias("word")).withColumn("word", tx.strip_accents(F.col("word"))).where("word <> ''"), "asked")
        live, dead = self._live(state)
        one = live.agg(F.count("*").alias("n"), F.avg("len").alias("mean")).first()  # two numbers
        n, mean = F.lit(float(one["n"])), F.lit(float(one["mean"] or 1.0) or 1.0)
        spot = ["_commit", "slice"]
        met = self._matched(asked.select("word").distinct(), state).select("word", *spot, "docs")
        if dead is None:  # blocks are dealt by slice as they are, else their documents have to meet the dead first
            met = met.repartition(*spot).select("word", *spot, F.inline("docs"))
        else:
            met = self._alive(met.select("word", *spot, F.inline("docs")), dead).repartition(*spot)
        # all that follows a slice's deal is done where the slice lies
        each = met.groupBy("word", *spot, "doc_id", "len").agg(F.sum("tf").alias("tf"))
        hits = materialize(each.groupBy("word", *spot).agg(F.collect_list(F.struct("doc_id", "len", "tf")).alias("docs"), F.max("tf").alias("most"), F.min("len").alias("least"), F.count("*").alias("held")), "hits")
        df = hits.groupBy("word").agg(F.sum("held").alias("df"))
        words = df.withColumn("idf", F.log((n - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1.0))
        asked = materialize(asked.join(words, "word"), "words")
        blocks = max(1, -(-asked.count() // ASKED))
        of = lambda k: F.broadcast(asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == k) if blocks > 1 else asked)
        every = lambda make: reduce(DataFrame.unionByName, [make(of(k)) for k in range(blocks)])

        limit = part(F.col("most"), F.col("least"), F.col("idf"), mean).alias("bound")
        slices = every(lambda some: hits.select("word", *spot, "most", "least", "held").join(some, "word").select("query_id", *spot, "held", limit).groupBy("query_id", *spot).agg(F.sum("bound").alias("bound"), F.sum("held").alias("held")))
        slices = materialize(slices, "slices")
        order = Window.partitionBy("query_id").orderBy(F.desc("bound"), *spot)
        first = slices.withColumn("_place", F.row_number().over(order)).where(F.col("_place") <= PROBES).drop("_place")
        first = materialize(first, "first")
        total = lambda rows: rows.agg(F.coalesce(F.sum("held"), F.lit(0))).first()[0]

        def summed(pairs: DataFrame) -> DataFrame:
            rows = pairs.select("query_id", *spot, "idf", F.inline("docs"))
            return rows.groupBy("query_id", *spot, "doc_id").agg(F.sum(part(F.col("tf"), F.col("len"), F.col("idf"), mean)).alias("score")).select("query_id", "doc_id", "score")

        def scored(some: DataFrame) -> DataFrame:
            """Scores of the documents of some slices, each with the question that looks at it."""
            return summed(some.select("query_id", *spot).join(asked, "query_id").join(hits, ["word", *spot]))

        def dealt(some: DataFrame, pairs: int) -> DataFrame:
            """Scores of all questions in those slices that any looks at, summed where a slice lies: pairs are not shuffled."""
            deals = max(int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-pairs // PAIRS))
            lying = hits.join(some.select(*spot).distinct(), spot, "left_semi").select("word", *spot, "docs").repartition(deals, *spot)
            return every(lambda part_of: summed(lying.join(part_of, "word")))

        best = materialize(top_of(scored(first), "query_id", [F.desc(F.round("score", 9)), F.col("doc_id")], top), "best")
        enough = best.where(F.col("rank") == top).select("query_id", F.col("score").alias("_least"))
        known = first.select("query_id", *spot, F.lit(True).alias("_known"))
        rest = slices.join(known, ["query_id", *spot], "left_anti").join(enough, "query_id", "left").where(F.col("_least").isNull() | (F.col("bound") >= F.col("_least") - MARGIN))
        rest = materialize(rest, "rest")
        more = total(rest)
        if more <= FEW:
            made, found = total(first) + more, best.drop("rank").unionByName(scored(rest))
        else:
            looked = first.select(*spot).unionByName(rest.select(*spot)).distinct()
            made = total(slices.join(looked, spot, "left_semi"))
            found = dealt(looked, made)
        if counts is not None:
            counts |= {"all": total(slices), "read": made}
        return top_of(found, "query_id", [F.desc(F.round("score", 9)), F.col("doc_id")], top)
