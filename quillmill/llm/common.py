"""What the training-data operators share: tables, shared storage, Arrow maps and the word encoder."""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.scratch import materialize, scratch_path, shared_dir  # noqa: F401 (for the operators)

#: Rows that one step inside an Arrow map works on at a time; bounds the worker's memory.
SLICE_ROWS = 512
#: Entries and length of an entry that a worker's word cache holds, and the older one as many.
CACHE_WORDS, CACHE_CHARS = 200_000, 64
#: Bytes of text that the encoder works on at a time; longer texts are cut at white space.
GROUP_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_rows(df: DataFrame, schema: T.StructType | str, fn: Callable[[dict[str, list]], dict[str, list]]) -> DataFrame:
    """mapInArrow over slices of at most SLICE_ROWS rows.  fn takes and returns columns by name."""
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    arrow = _arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                out = fn({n: part.column(k).to_pylist() for k, n in enumerate(part.schema.names)})
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, schema)


def boxed(df: DataFrame) -> DataFrame:
    """All of df's columns in one struct ``_row``: what an operator adds beside it can't clash with them."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"))


def map_boxed(df: DataFrame, extra: str, fn: Callable[[pa.StructArray], dict[str, list]], edit: bool = False) -> DataFrame:
    """Adds the columns of the DDL ``extra`` beside ``_row``; fn gets the struct's Arrow array, SLICE_ROWS rows at most.

    With ``edit`` fn returns (struct array, columns), and the struct array takes the place of ``_row``.
    A boolean column named ``_keep`` filters the rows and is dropped.
    """
    schema = T.StructType([*df.schema.fields, *T.StructType.fromDDL(extra).fields])
    out = T.StructType([f for f in schema.fields if f.name != "_keep"])
    arrow, added = _arrow_schema(out), _arrow_schema(T.StructType.fromDDL(extra))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                row = part.column(0)
                got = fn(row)
                if edit:
                    row, got = got
                cols = {f.name: pa.array(got[f.name], f.type) for f in added}
                rb = pa.RecordBatch.from_arrays([row.cast(arrow.field(0).type), *[cols[f.name] for f in arrow if f.name != "_row"]], schema=arrow)
                yield rb.filter(cols["_keep"]) if "_keep" in cols else rb

    return df.mapInArrow(run, out)


def _arrow_schema(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) with null texts empty; other columns can't clash after this."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


class _Recent(dict):
    """A memory of what short keys make; when it is full, it becomes the older one of two, which gives what is still asked."""

    def __init__(self, make: Callable[[str], bytes]):
        super().__init__()
        self._make, self._older = make, {}

    def __missing__(self, key: str) -> bytes:
        got = self._older.get(key)
        if got is None:
            got = self._make(key)
        if len(key) <= CACHE_CHARS:
            if len(self) >= CACHE_WORDS:
                self._older = dict(self)
                self.clear()
            self[key] = got
        return got


_gap = re.compile(r"[ \n]")


def chunks(text: str, size: int = GROUP_BYTES) -> Iterator[str]:
    """The text in order, cut before white space where it is longer than size code points."""
    at = 0
    while len(text) - at > size and (gap := _gap.search(text, at + size)):
        yield text[at : gap.start()]
        at = gap.start()
    yield text[at:]


#: Fixed value: the vocabulary's splitting pattern.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: The same for texts without PLAIN's exceptions: what stands apart from the letters around it.
APART = r"('s|'t|'re|'ve|'m|'ll|'d|\p{N}|[^\s\p{L}\p{N}]+)"
#: Characters that a text must not have for the short way: beyond Latin, of odd white space or lower case, or special.
PLAIN = r"[^\t\n\r\x20-\x7e\x{a1}-\x{12f}\x{131}-\x{24f}]|<\|"


class WordEncoder:
    """Token ids of whole texts as little-endian unsigned 32-bit numbers, by the tokenizers library.

    The vocabulary's splitting pattern never joins characters over white space.  A text of Latin letters is
    lower-cased and split by that pattern here, a column at a time, and the library's model turns each distinct part
    to ids; any other text goes through the library's whole encoder, a piece between spaces at a time.  Ids of short
    parts and pieces are remembered; the memory is bounded.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        # only where the file asks for just this may the parts go to the model by themselves
        spec = self._tokenizer.to_str()
        self._simple = SPLIT.replace("\\", "\\\\") in spec and '"use_regex":false' in spec.replace(" ", "")
        # the byte-level alphabet: printable bytes stand for themselves, the others follow from 256 on
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in shown]
        self._bytes = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(rest)}
        self._model = self._tokenizer.model
        self._parts, self._pieces = _Recent(self._part), _Recent(self._piece)

    def _part(self, part: str) -> bytes:
        if not part.isascii():
            part = part.encode().decode("latin-1").translate(self._bytes)
        return b"".join([t.id.to_bytes(4, "little") for t in self._model.tokenize(part)]) if part else b""

    def _piece(self, piece: str) -> bytes:
        return b"".join([i.to_bytes(4, "little") for i in self._tokenizer.encode(piece, add_special_tokens=False).ids]) if piece else b""

    def encode(self, text: str | None) -> bytes:
        """The ids of one text, by the long way."""
        return b"".join(map(self._pieces.__getitem__, text.replace("\n", " ").split(" "))) if text else b""

    def encode_column(self, texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first row, ids, offsets of its rows in ids) of groups of rows of some GROUP_BYTES; each distinct part of a group is looked up once."""
        sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
        ends, at = np.cumsum(sizes), 0
        while at < len(texts):
            stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + GROUP_BYTES, "right")))
            if sizes[at] > GROUP_BYTES:
                ids = np.concatenate([self._group(pa.array([c], pa.large_string()))[0] for c in chunks(texts[at].as_py())])
                edge = np.array([0, len(ids)])
            else:
                ids, edge = self._group(pc.fill_null(texts.slice(at, stop - at), "").cast(pa.large_string()))
            yield at, ids, edge
            at = stop
        pa.default_memory_pool().release_unused()

    def _group(self, part: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets of the rows in ids)."""
        odd = pc.match_substring_regex(part, PLAIN).to_numpy(zero_copy_only=False) if self._simple else np.ones(len(part), bool)
        ids, edge = self._short_way(pc.if_else(pa.array(odd), "", part) if odd.any() else part)
        if odd.any():
            rows = [ids[a:b] for a, b in zip(edge[:-1], edge[1:])]
            for k in np.nonzero(odd)[0].tolist():
                rows[k] = np.frombuffer(self.encode(part[k].as_py()), "<u4")
            edge = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
            ids = np.concatenate(rows)
        return ids, edge

    def _short_way(self, part: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        lists = pc.ascii_split_whitespace(pc.utf8_lower(part))
        words = lists.flatten().dictionary_encode()
        # no match lies across white space, so each distinct word of the group is split once
        split = pc.ascii_split_whitespace(pc.replace_substring_regex(words.dictionary, APART, r" \1 "))
        coded = split.flatten().dictionary_encode()
        held = list(map(self._parts.__getitem__, coded.dictionary.to_pylist()))
        length = np.fromiter(map(len, held), np.int32, len(held)) // 4  # a group has far fewer than 2^31 ids
        ids, total = _gathered(np.frombuffer(b"".join(held), "<u4"), np.cumsum(length, dtype=np.int32) - length, length, coded.indices.to_numpy(zero_copy_only=False))
        edge = split.offsets.to_numpy()
        ends = total[edge - edge[0]]
        ids, total = _gathered(ids, ends[:-1], np.diff(ends), words.indices.to_numpy(zero_copy_only=False))
        edge = lists.offsets.to_numpy()
        return ids, total[edge - edge[0]]


def _gathered(ids: np.ndarray, start: np.ndarray, length: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids, offsets) of the runs u, one after another: run k is ``length[k]`` ids from ``start[k]`` on."""
    n = length[u]
    total = np.zeros(len(n) + 1, np.int32)
    np.cumsum(n, out=total[1:])
    at = np.repeat(start[u] - total[:-1], n)
    at += np.arange(total[-1], dtype=np.int32)
    return ids[at], total


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One encoder for each worker process and vocabulary."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


crc32 = zlib.crc32
