"""Tokens of two tokenizers aligned by the bytes that they cover, with relational operators.

A: a byte-level BPE file, given a space and the text.  B: a sentencepiece model, which puts the space before by itself.
Neither joins bytes across the end of a unit (see ``units``), so both cut a text there: tokens, groups and links of a text are
those of its units, one after another.  Each distinct unit of the corpus is tokenised and aligned once:

* its tokens come by ``posexplode``, their ends by a windowed sum of lengths;
* A's and B's ends meet by equality on (unit, end) - as a grouping of both sides' rows, so that what is dealt by unit is not
  dealt again; a running count of the ends that both have numbers the groups;
* the stretches between neighbouring ends of either side are the links: each lies in just one token of A and one of B,
  and two tokens overlap in just one stretch.  So the range join is a fill of each stretch with the next end's token.

Links of id pairs are counted over all texts: a unit's pairs times the unit's occurrences.  The texts themselves are kept as
numbers of units, in chunks of some CHUNK bytes with the chunk's distinct units beside them, so what is shuffled
are the distinct units of chunks and the numbers, never all tokens.  A row is one text or one unit, never a chunk: at the
end the units' results and the texts of a chunk follow each other in one sorted stream, and a worker holds one chunk's results.

Cases: texts that are null or empty, or whose tokens do not give the bytes back (B writes U+2581 for a space, so a text
that holds it is one; so is any text that B's normaliser would change), have zeros and '' and count for no pair; rows of
one doc_id, and equal rows, are aligned and counted each; a null doc_id stays null; an empty table gives an empty result;
further columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.scratch import discard
from . import common
from .units import parts, pieces_respect, units

#: Bytes of text in a chunk.
CHUNK = 16 << 20
#: Id pairs up to which their counts are broadcast (some 50 MB); beyond it both sides are shuffled.
BROADCAST_PAIRS = 1_000_000

TOKENS = "array<struct<id: int, len: int>>"
SUMS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")


class Pieces:
    """B: ids of units, and whether a text is B's to give back."""

    def __init__(self, path: str):
        import sentencepiece

        self.b = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.b.get_piece_size()
        pieces = [self.b.id_to_piece(i) for i in range(n)]
        kinds = [self.b.is_byte(i) for i in range(n)]
        own = [p for i, p in enumerate(pieces) if not (kinds[i] or self.b.is_control(i) or self.b.is_unknown(i))]
        if not any(kinds) or not pieces_respect(own) or any("\n" in p for p in own) or self.b.normalize("\n") != "▁\n":
            raise ValueError(f"no pieces with byte fallback that end with units: {path}")
        self.length = np.array([1 if k else len(p.replace("▁", " ").encode()) for p, k in zip(pieces, kinds)], np.int32)
        self._space = self.b.piece_to_id("▁")

    def exact(self, text: str) -> bool:
        """Whether B's pieces give the text's bytes back."""
        return "▁" not in text and self.b.normalize(text) == "▁" + text.replace(" ", "▁")

    def ids(self, found: list[str]) -> list[list[int]]:
        """A unit's own space is the one that B adds; another beginning is kept apart from B's space by a line feed."""
        ids = self.b.encode([u[1:] if u[0] == " " else "\n" + u for u in found], num_threads=1)
        # a unit that is one space is the empty string to B
        return [[self._space] if u == " " else x if u[0] == " " else x[2:] for u, x in zip(found, ids)]


class ByteLevel:
    """A: ids of units."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path)
        self.a.encode_special_tokens = True  # their strings in a text are plain text
        self.a.no_truncation()
        self.a.no_padding()
        spec = json.loads(self.a.to_str())
        split = spec["pre_tokenizer"] or {}
        if spec["normalizer"] or split.get("type") != "ByteLevel" or not split.get("use_regex") or split.get("add_prefix_space"):
            raise ValueError(f"not a plain byte-level BPE: {path}")
        entries = self.a.get_vocab()
        self.length = np.zeros(max(entries.values()) + 1, np.int32)
        for s, i in entries.items():
            self.length[i] = len(s)  # an entry has a character for each byte

    def ids(self, found: list[str]) -> list[list[int]]:
        return [e.ids for e in self.a.encode_batch_fast(found, add_special_tokens=False)]


_held: dict[str, ByteLevel | Pieces] = {}


def held(kind: type, path: str) -> ByteLevel | Pieces:
    """One of a kind for each worker process and vocabulary."""
    if path not in _held:
        _held[path] = kind(path)
    return _held[path]


def stored(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """df written to the shared folder and read back, and its path.  Shuffle files of the writing go with it."""
    spark, path, key = df.sparkSession, common.scratch_path(df.sparkSession, name), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(key, was)
    return spark.read.schema(df.schema).parquet(path), path


#: A row for each text (word is null) and for each distinct unit of a chunk (units is null).
CHUNKS = "chunk long, doc_id long, units array<int>, pos int, word string, times long"


class _Chunk:
    """Texts as numbers of their units, until there are enough of them for a row."""

    def __init__(self):
        self.place: dict[str, int] = defaultdict()
        self.place.default_factory = self.place.__len__
        self.ids: list[int | None] = []
        self.rows: list[np.ndarray] = []
        self.size = 0

    def add(self, doc_id: int | None, text: str) -> None:
        number = self.place.__getitem__
        own = [np.fromiter(map(number, u), np.int32, len(u)) for u in map(units, parts(" " + text))] if text else []
        self.ids.append(doc_id)
        self.rows.append(np.concatenate(own) if own else np.zeros(0, np.int32))
        self.size += len(text.encode())

    def batches(self, chunk: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        flat = np.concatenate(self.rows)
        edge = np.cumsum([0, *map(len, self.rows)]).astype(np.int32)
        words = pa.array(list(self.place), pa.string())
        times = pa.array(np.bincount(flat, minlength=len(words)).astype(np.int64))
        texts = {"doc_id": pa.array(self.ids, pa.int64()), "units": pa.ListArray.from_arrays(pa.array(edge), pa.array(flat)).cast(schema.field("units").type)}
        for n, own in ((len(self.ids), texts), (len(words), {"pos": pa.array(np.arange(len(words), dtype=np.int32)), "word": words, "times": times})):
            own["chunk"] = pa.array(np.full(n, chunk, np.int64))
            yield pa.RecordBatch.from_arrays([own[f.name] if f.name in own else pa.nulls(n, f.type) for f in schema], schema=schema)


def chunked(docs: DataFrame, b_path: str, chunk_bytes: int = CHUNK) -> DataFrame:
    """CHUNKS of docs (doc_id, text)."""
    schema = common._arrow_schema(common.T.StructType.fromDDL(CHUNKS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        exact, number, now = held(Pieces, b_path).exact, TaskContext.get().partitionId() << 32, _Chunk()
        for batch in batches:
            ids = batch.column(0)
            for k in range(batch.num_rows):
                text = batch.column(1)[k].as_py()
                now.add(ids[k].as_py(), text if exact(text) else "")
                if now.size >= chunk_bytes:
                    yield from now.batches(number, schema)
                    number, now = number + 1, _Chunk()
        if now.ids:
            yield from now.batches(number, schema)

    return common.id_text(docs).mapInArrow(run, CHUNKS)


def tokenised(words: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """w, word, total with a and b: ids and byte lengths of the tokens of each unit."""

    ddl = f"w long, word string, total long, a {TOKENS}, b {TOKENS}"
    schema = common._arrow_schema(common.T.StructType.fromDDL(ddl))

    def told(by: ByteLevel | Pieces, found: list[str], kind: pa.DataType) -> pa.Array:
        ids = by.ids(found)
        edge = np.cumsum([0, *map(len, ids)]).astype(np.int32)
        flat = np.fromiter(chain.from_iterable(ids), np.int32, int(edge[-1]))
        tokens = pa.StructArray.from_arrays([pa.array(flat), pa.array(by.length[flat])], names=["id", "len"])
        return pa.ListArray.from_arrays(pa.array(edge), tokens).cast(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = held(ByteLevel, a_path), held(Pieces, b_path)
        for batch in batches:
            for at in range(0, batch.num_rows, common.SLICE_ROWS):
                part = batch.slice(at, common.SLICE_ROWS)
                found = part.column(1).to_pylist()
                yield pa.RecordBatch.from_arrays([*part.columns, told(a, found, schema.field("a").type), told(b, found, schema.field("b").type)], schema=schema)

    return words.select("w", "word", "total").mapInArrow(run, ddl)


def stretches(words: DataFrame) -> DataFrame:
    """w, word, total, end, a, b, g, link_a, link_b: a row for each end of a token of either side of a unit.

    a and b are the tokens that end there, if one does; g numbers the groups; link_a and link_b are the tokens that hold
    the bytes before the end.
    """
    key = ["w", "word", "total"]
    sides = words.repartition("w").select(*key, F.inline(F.array(F.struct(F.lit(0).alias("side"), F.col("a").alias("t")), F.struct(F.lit(1).alias("side"), F.col("b").alias("t")))))
    tokens = sides.select(*key, "side", F.posexplode("t").alias("pos", "t")).select(*key, "side", "pos", "t.id", "t.len")
    ends = tokens.withColumn("end", F.sum("len").over(Window.partitionBy("w", "side").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)))
    of = lambda side: F.max(F.when(F.col("side") == side, F.col("id")))
    met = ends.groupBy(*key, "end").agg(of(0).alias("a"), of(1).alias("b"))
    cut = F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), 1).otherwise(0)
    g = F.coalesce(F.sum(cut).over(Window.partitionBy("w").orderBy("end").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    back = Window.partitionBy("w").orderBy(F.desc("end")).rowsBetween(Window.unboundedPreceding, 0)
    return met.withColumn("g", g).withColumns({f"link_{s}": F.last(s, ignorenulls=True).over(back) for s in "ab"})


def listed(ids: Column) -> Column:
    return F.concat_ws(",", F.transform(ids, lambda x: x["id"].cast("string")))


def aligned_units(words: DataFrame) -> DataFrame:
    """w, word, total, n_a, n_b, n_groups, n_links, groups (text) and links (id pairs) of each unit."""
    key = ["w", "word", "total"]
    tokens = lambda s: F.array_sort(F.collect_list(F.when(F.col(s).isNotNull(), F.struct("end", F.col(s).alias("id")))))
    groups = stretches(words).groupBy(*key, "g").agg(tokens("a").alias("as"), tokens("b").alias("bs"), F.collect_list(F.struct("link_a", "link_b")).alias("links"))
    told = F.concat(listed(F.col("as")), F.lit("|"), listed(F.col("bs")))
    return groups.groupBy(*key).agg(
        F.sum(F.size("as").cast("long")).alias("n_a"), F.sum(F.size("bs").cast("long")).alias("n_b"), F.count("*").alias("n_groups"), F.sum(F.size("links").cast("long")).alias("n_links"),
        F.concat_ws(";", F.transform(F.array_sort(F.collect_list(F.struct("g", told.alias("s")))), lambda x: x["s"])).alias("groups"), F.flatten(F.collect_list("links")).alias("links"),
    )


def pair_counts(units_: DataFrame) -> DataFrame:
    """link_a, link_b, n, best: links of each id pair in the corpus, and whether no pair of its B id has more."""
    pairs = units_.select("total", F.inline("links")).groupBy("link_a", "link_b").agg(F.sum("total").alias("n"))
    return pairs.withColumn("best", (F.col("n") == F.max("n").over(Window.partitionBy("link_b"))).cast("long"))


def assembled(texts: DataFrame, results: DataFrame) -> DataFrame:
    """doc_id, SUMS and groups_sha256 of texts (chunk, doc_id, units) from the results of their chunks' units (chunk, pos, groups, SUMS).

    Both are dealt by chunk and sorted, a chunk's results before its texts, so no row and no group is held but one chunk's results.
    """
    ddl = "doc_id long, " + ", ".join(f"{k} long" for k in SUMS) + ", groups_sha256 string"
    schema = common._arrow_schema(common.T.StructType.fromDDL(ddl))
    both = results.select("chunk", F.lit(0).alias("kind"), "pos", "groups", *SUMS).unionByName(texts.select("chunk", F.lit(1).alias("kind"), "doc_id", "units"), allowMissingColumns=True)
    # one number to sort by: rows of a chunk are many, and equal beginnings of two keys would be compared row by row
    both = both.withColumn("place", F.col("chunk") * 2 + F.col("kind"))
    ordered = both.repartition("chunk").sortWithinPartitions("place").select("chunk", "kind", "pos", "groups", *SUMS, "doc_id", "units")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, pos, told, sums, table = None, [], [], [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1)])
            cuts = [0, *(np.nonzero((key[:, 1:] != key[:, :-1]).any(axis=0))[0] + 1).tolist(), batch.num_rows]
            for at, stop in zip(cuts, cuts[1:]):
                chunk, kind = key[:, at].tolist()
                if chunk != now:
                    now, pos, told, sums, table = chunk, [], [], [], None
                if not kind:
                    part = batch.slice(at, stop - at)
                    pos.append(part.column(2).to_numpy(zero_copy_only=False))
                    told += part.column(3).to_pylist()
                    sums.append(np.stack([part.column(4 + k).to_numpy(zero_copy_only=False) for k in range(len(SUMS))]))
                    continue
                if table is None:  # the chunk's results are complete: by their places
                    order = np.argsort(np.concatenate(pos)) if pos else np.zeros(0, np.int64)
                    table = [told[k] for k in order.tolist()], np.concatenate(sums, axis=1)[:, order] if sums else np.zeros((len(SUMS), 0), np.int64)
                    pos, told, sums = [], [], []
                groups, values = table
                for first in range(at, stop, common.SLICE_ROWS):
                    part = batch.slice(first, min(common.SLICE_ROWS, stop - first))
                    lists = part.column(5 + len(SUMS))
                    edge = lists.offsets.to_numpy()
                    flat, edge = lists.flatten().to_numpy(zero_copy_only=False), edge - edge[0]
                    total = [np.concatenate([[0], np.cumsum(v[flat])]) for v in values]
                    own, ends = [groups[u] for u in flat.tolist()], edge.tolist()
                    sha = [hashlib.sha256(";".join(own[a:b]).encode()).hexdigest() if b > a else "" for a, b in zip(ends, ends[1:])]
                    yield pa.RecordBatch.from_arrays([part.column(4 + len(SUMS)), *[pa.array(t[edge[1:]] - t[edge[:-1]], pa.int64()) for t in total], pa.array(sha, pa.string())], schema=schema)

    return ordered.mapInArrow(run, ddl)


def align(docs: DataFrame, a_path: str, b_path: str, chunk_bytes: int = CHUNK, broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of each row of docs (doc_id, text)."""
    spark = docs.sparkSession
    chunks, _ = stored(chunked(docs, b_path, chunk_bytes), "chunks")
    of_chunk = chunks.where("word is not null")
    words = of_chunk.groupBy("word").agg(F.sum("times").alias("total"))
    words, words_path = stored(tokenised(words.withColumn("w", F.monotonically_increasing_id()), a_path, b_path), "words")
    found, found_path = stored(aligned_units(words), "units")
    discard(spark, words_path)
    pairs, _ = stored(pair_counts(found), "pairs")
    small = pairs.count() <= broadcast_pairs
    scored = found.select("w", F.inline("links")).join(F.broadcast(pairs) if small else pairs, ["link_a", "link_b"])
    scores = scored.groupBy("w").agg(F.sum("best").alias("n_best"), F.sum("n").alias("count_sum"))
    results, results_path = stored(found.drop("links", "total").join(scores, "w").select("word", "groups", *SUMS), "results")
    discard(spark, found_path)
    spread, _ = stored(of_chunk.select("chunk", "pos", "word").join(results, "word").drop("word"), "spread")
    discard(spark, results_path)
    return assembled(chunks.where("word is null"), spread)


def op11_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return align(docs, common.vocabulary_path("byte_bpe_50k.json"), common.vocabulary_path("piece_bpe_32k.model"))
