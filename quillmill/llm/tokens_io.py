"""Token ids in binary segments: Simple-8b words, block offsets, and a reader that decodes whole blocks at once.

A segment (all numbers little-endian)::

    magic 'QS8B', version u32, n_docs u64, n_ids u64, n_blocks u64, n_words u64, n_escapes u64
    doc_ids   i64[n_docs]        doc_null u8[n_docs]       doc_tokens u64[n_docs]
    word_at   u64[n_blocks + 1]  escape_at u64[n_blocks + 1]
    words     u64[n_words]       escapes  u64[n_escapes]

Each block holds BLOCK ids (the last one fewer) and starts at its own word, so blocks decode alone.  A word's low 4
bits select how many ids of how many bits its other 60 bits hold (SELECTORS).  Selector 0 is the escape: one id of
over 60 bits, taken in order from the block's escapes.  Padding in a block's last word is cut off by the id count.

Segments are rows of a Parquet table in the shared folder (shard, segment, n_docs, n_ids, payload): Spark's commit
protocol covers lost executors, and any store that Spark writes to will do.  ``export`` writes them as plain files.

Rows are dealt to shards by ranges of (doc_id, hash of the text), so that a doc_id with many rows fills many shards; a
sort that spills puts them in order.

Cases: a null or empty text has only the end id; null doc_ids come first; rows of one doc_id are ordered by their texts'
hashes, then texts; an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

#: Values and bits of each selector, 1 to 14; 0 is the escape.
SELECTORS = [(1, 0), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60)]
BLOCK = 16384
#: Ids after which a segment is closed; it bounds the writer's memory beside one text.
SEGMENT_IDS = 1 << 20
_HEAD = struct.Struct("<4sIQQQQQ")


def encode_block(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, escapes) of one block of unsigned 64-bit ids."""
    n = len(ids)
    ids = ids.astype(np.uint64)
    step, pick = np.ones(n, np.int64), np.zeros(n, np.uint64)  # selector 0 unless one below fits
    for k in range(14, 0, -1):
        count, bits = SELECTORS[k]
        if count > n:
            continue
        bad = ids >= np.uint64(1 << bits)
        reach = 1  # bad[i]: some id of the ``reach`` from i on is too wide
        while reach < count and not bad.all():
            more = min(reach, count - reach)
            bad = bad[: len(bad) - more] | bad[more:]
            reach += more
        if reach < count:  # no such run, so none of a longer one of narrower ids
            break
        fits = np.nonzero(~bad)[0]
        step[fits], pick[fits] = count, k
    for k in range(14, 0, -1):  # a block's last ids may fill a word in part
        count, bits = SELECTORS[k]
        tail = ids[max(0, n - count + 1) :]
        wide = np.nonzero(tail >> np.uint64(bits))[0]
        first = n - len(tail) + (int(wide[-1]) + 1 if len(wide) else 0)
        step[first:], pick[first:] = count, k
    starts, i, steps = [], 0, step.tolist()
    while i < n:
        starts.append(i)
        i += steps[i]
    s = np.array(starts, np.int64)
    sel = pick[s]
    words = sel.copy()
    padded = np.concatenate([ids, np.zeros(64, np.uint64)])
    for k in np.unique(sel):
        if k:
            count, bits = SELECTORS[int(k)]
            rows = np.nonzero(sel == k)[0]
            held = padded[s[rows][:, None] + np.arange(count)]
            words[rows] |= np.bitwise_or.reduce(held << (np.uint64(4) + np.arange(count, dtype=np.uint64) * np.uint64(bits)), axis=1)
    return words, ids[s[sel == 0]]


def decode_words(words: np.ndarray, escapes: np.ndarray, n: int) -> np.ndarray:
    """The n ids of a block."""
    sel = (words & np.uint64(15)).astype(np.int64)
    counts = np.array([c for c, _ in SELECTORS])[sel]
    ends = np.cumsum(counts)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint64)
    at = ends - counts
    for k in np.unique(sel):
        rows = np.nonzero(sel == k)[0]
        if not k:
            out[at[rows]] = escapes
            continue
        count, bits = SELECTORS[k]
        shifts = np.uint64(4) + np.arange(count, dtype=np.uint64) * np.uint64(bits)
        out[at[rows][:, None] + np.arange(count)] = (words[rows][:, None] >> shifts) & np.uint64((1 << bits) - 1)
    return out[:n]


def encode_segment(doc_ids: list[int | None], docs: list[np.ndarray]) -> bytes:
    ids = np.concatenate(docs) if docs else np.zeros(0, np.uint64)
    blocks = [encode_block(ids[i : i + BLOCK]) for i in range(0, len(ids), BLOCK)]
    ends = lambda k: np.cumsum([0, *(len(b[k]) for b in blocks)]).astype("<u8")
    join = lambda k: np.concatenate([b[k] for b in blocks]).astype("<u8") if blocks else np.zeros(0, "<u8")
    words, escapes = join(0), join(1)
    head = _HEAD.pack(b"QS8B", 1, len(docs), len(ids), len(blocks), len(words), len(escapes))
    parts = [np.array([d or 0 for d in doc_ids], "<i8"), np.array([d is None for d in doc_ids], np.uint8), np.array([len(d) for d in docs], "<u8"), ends(0), ends(1), words, escapes]
    return head + b"".join(p.tobytes() for p in parts)


def decode_segment(payload: bytes | pa.Buffer) -> tuple[list[int | None], list[np.ndarray]]:
    magic, version, n_docs, n_ids, n_blocks, n_words, n_escapes = _HEAD.unpack_from(payload)
    if magic != b"QS8B" or version != 1:
        raise ValueError("not a token segment")
    at = _HEAD.size

    def take(kind: str, n: int) -> np.ndarray:
        nonlocal at
        got = np.frombuffer(payload, kind, n, at)
        at += got.nbytes
        return got

    doc_ids, null, sizes = take("<i8", n_docs), take("u1", n_docs), take("<u8", n_docs)
    word_at, escape_at, words, escapes = take("<u8", n_blocks + 1), take("<u8", n_blocks + 1), take("<u8", n_words), take("<u8", n_escapes)
    ids = np.concatenate([decode_words(words[word_at[b] : word_at[b + 1]], escapes[escape_at[b] : escape_at[b + 1]], min(BLOCK, n_ids - b * BLOCK)) for b in range(n_blocks)] or [np.zeros(0, np.uint64)])
    return [None if x else int(d) for d, x in zip(doc_ids, null)], np.split(ids, np.cumsum(sizes[:-1].astype(np.int64))) if n_docs else []


def write_tokens(docs: DataFrame, path: str, vocabulary: str, end_id: int = 2, partitions: int | None = None) -> DataFrame:
    """Writes the ids of docs (doc_id, text) under ``path`` in ascending doc_id order and returns the segments' table."""
    spark = docs.sparkSession
    n = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    order = [F.col("doc_id").asc_nulls_first(), F.col("h")]
    ordered = common.id_text(docs).withColumn("h", F.xxhash64("text")).repartitionByRange(n, *order).sortWithinPartitions(*order, "text").select("doc_id", "text")
    end = np.uint32(end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        columns, shard, segment = common.encoder(vocabulary).encode_column, TaskContext.get().partitionId(), 0
        ids, arrays, size = [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal ids, arrays, size, segment
            cols = {"shard": [shard], "segment": [segment], "n_docs": [len(ids)], "n_ids": [size], "payload": [encode_segment(ids, arrays)]}
            ids, arrays, size, segment = [], [], 0, segment + 1
            return pa.RecordBatch.from_pydict(cols, schema=schema)

        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            for row, flat, edge in columns(batch.column(1)):
                edge = edge.tolist()
                for k in range(len(edge) - 1):
                    ids.append(doc_ids[row + k])
                    arrays.append(np.append(flat[edge[k] : edge[k + 1]], end))
                    size += edge[k + 1] - edge[k] + 1
                    if size >= SEGMENT_IDS:
                        yield flush()
        if ids:
            yield flush()

    schema = pa.schema([("shard", pa.int32()), ("segment", pa.int32()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("payload", pa.binary())])
    ordered.mapInArrow(run, "shard int, segment int, n_docs long, n_ids long, payload binary").write.parquet(path)
    return spark.read.schema("shard int, segment int, n_docs long, n_ids long, payload binary").parquet(path)


def read_tokens(segments: DataFrame, ids: bool = False) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32 of each document in the segments; ids on demand."""

    kinds = [("shard", pa.int32()), ("segment", pa.int32()), ("doc_id", pa.int64()), ("local", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), *([("ids", pa.list_(pa.int64()))] if ids else [])]
    schema = pa.schema(kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):  # a segment at a time
                shard, segment, payload = (batch.column(c)[k] for c in range(3))
                doc_ids, held = decode_segment(payload.as_buffer())
                sizes = np.array([len(x) for x in held], np.int64)
                n = len(held)
                cols = [[shard.as_py()] * n, [segment.as_py()] * n, doc_ids, np.cumsum(sizes) - sizes, sizes, [common.crc32(x.astype("<u4").tobytes()) for x in held], *([[x.astype(np.int64) for x in held]] if ids else [])]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)

    rows = segments.select("shard", "segment", "payload").mapInArrow(run, "shard int, segment int, doc_id long, local long, n_tokens long, ids_crc32 long" + ", ids array<long>" * ids)
    # offsets: shards by one running sum over a row each, segments within their shard
    sizes = segments.select("shard", "segment", "n_ids")
    shard = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.groupBy("shard").agg(F.sum("n_ids").alias("n")).select("shard", F.coalesce(F.sum("n").over(shard), F.lit(0)).alias("first"))
    within = Window.partitionBy("shard").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("inner", F.coalesce(F.sum("n_ids").over(within), F.lit(0))).join(before, "shard").select("shard", "segment", (F.col("first") + F.col("inner")).alias("offset"))
    return rows.join(offsets, ["shard", "segment"]).withColumn("start", F.col("local") + F.col("offset")).drop("shard", "segment", "local", "offset")


def export(segments: DataFrame, folder: str) -> int:
    """Writes each segment as ``shard-segment.qs8b`` into a folder that the driver reaches, one at a time."""
    n = 0
    for row in segments.orderBy("shard", "segment").toLocalIterator():
        Path(folder, f"{row.shard:05d}-{row.segment:05d}.qs8b").write_bytes(bytes(row.payload))
        n += 1
    return n


def op4_token_binary_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments = write_tokens(common.table(spark, sf_dir, "documents"), common.scratch_path(spark, "tokens"), common.vocabulary_path())
    return read_tokens(segments).select("doc_id", "start", "n_tokens", "ids_crc32")
