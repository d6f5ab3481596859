"""Documents taken in exactly once: a micro-batch's documents, search postings, ledger lines and log lines in one commit.

``foreachBatch`` may hand over a batch again after a failure.  Here everything that a batch adds is written first, as folders
that no version names, and then named by one commit of the ``Store``, which also remembers the batch's number: a
batch that comes again after its commit does nothing, one that died before its commit leaves nothing behind.  Several
intakes may share a store; one that was not first does its batch anew on what the other left, so a text that both bring is
kept once and no number is given twice.

Tables of the store: ``documents`` (doc_id, text, md5), ``ledger`` (ledger_id, doc_id, md5, status), ``intake_log``
(query, batch, received, kept), and those of the search index over the kept texts.

Cases: a text whose MD5 is known, in the store or earlier in the batch's order (doc_id, then text), gets a ledger line
DUPLICATE and nothing else; null texts are empty; null doc_ids are not taken (they get no ledger line); an empty batch
commits its number alone; further columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.window import Window

from ..operators.search_index import SearchIndex
from ..sources.scratch import materialize
from ..sources.sinks import ledger_ids
from ..sources.store import State, Store


class Intake:
    """One query's intake into a store.  ``query`` names it across restarts."""

    def __init__(self, store: Store, query: str = "intake", prefix: str = "VG-"):
        self.store, self.query, self.prefix = store, query, prefix
        self.index = SearchIndex(store, "texts")

    def batch(self, rows: DataFrame, batch_id: int) -> State:
        """Takes rows (doc_id, text) as batch ``batch_id``; what ``foreachBatch`` calls."""
        text = F.coalesce(F.col("text"), F.lit(""))
        taken = rows.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.md5(text).alias("md5"))
        return self.store.update(lambda s: self._change(s, taken, batch_id), self.query, batch_id)

    def _change(self, state: State, taken: DataFrame, batch_id: int) -> State:
        known = self.store.read("documents", state)
        earlier = taken.groupBy("md5").agg(F.min(F.struct("doc_id")).alias("_first"))  # a hot text is one row here
        rows = taken.join(earlier, "md5").withColumn("_new", F.col("doc_id") == F.col("_first.doc_id")).drop("_first")
        # rows of one doc_id and text in a batch: one of them is the document
        alike = Window.partitionBy("md5", "doc_id").orderBy("text")
        rows = rows.withColumn("_new", F.col("_new") & (F.row_number().over(alike) == 1))
        if known is not None:
            rows = rows.join(known.select("md5", F.lit(True).alias("_known")).distinct(), "md5", "left").withColumn("_new", F.col("_new") & F.col("_known").isNull()).drop("_known")
        judged = materialize(rows, "judged")
        new = judged.where("_new").select("doc_id", "text", "md5")
        one = judged.agg(F.count("*").alias("received"), F.count_if("_new").alias("kept")).first()  # two numbers
        log = self.store.spark.range(1).select(F.lit(self.query).alias("query"), F.lit(batch_id).cast("long").alias("batch"), F.lit(one["received"]).cast("long").alias("received"), F.lit(one["kept"]).cast("long").alias("kept"))
        state = state.adding("intake_log", self.store.write(log))
        if one["received"]:
            lines = ledger_ids(judged, ["doc_id", "md5", "_new"], state.counters.get("ledger", 0), self.prefix)
            lines = lines.select("ledger_id", "doc_id", "md5", F.when(F.col("_new"), "NEW").otherwise("DUPLICATE").alias("status"))
            state = state.adding("ledger", self.store.write(lines)).counting("ledger", one["received"])
        if one["kept"]:
            state = state.adding("documents", self.store.write(new))
            state = self.index.adding(state, self.index.segment(new, "doc_id", "text"))
        return state

    def start(self, stream: DataFrame, checkpoint: str) -> StreamingQuery:
        """Runs over what a stream has now, in its batches, and ends; started again it goes on behind it."""
        return stream.writeStream.foreachBatch(lambda rows, k: self.batch(rows, k) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
