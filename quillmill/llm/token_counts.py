"""Tokens of each text, counted: batches go to the library's encoder inside Arrow maps, and lengths alone come back.

A task's texts are taken in groups of some GROUP_BYTES, whatever their number, so that batches cost alike.  A text is cut
into units (see ``units``) where the vocabulary allows; the distinct units that the worker does not remember make one batch
for the library.  What is remembered is a unit's number of tokens, for short units, up to CACHE entries.  A long text is
counted a part at a time, cut at the ends of units, so a task holds the tokens of one part; only a text without any
such place (a megabyte of one alphabet without a space) goes to the library whole.

Vocabularies: ``.json`` by tokenizers, ``.model`` by sentencepiece, both without begin, end or added special tokens,
truncation or padding.  Strings of special tokens inside a text count as the library counts them: one token for
tokenizers, plain text for sentencepiece.  Units are only for byte-level BPE without a normaliser; any other
vocabulary is given whole texts.

Cases: a null or empty text has 0 bytes and 0 tokens; rows of one doc_id, and equal rows, are counted each; a null
doc_id stays null; an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .units import parts, units

#: Bytes of the texts of a batch, and the units and their length that a worker remembers.
GROUP_BYTES, CACHE, CACHE_CHARS = 2 << 20, 200_000, 64
LIMIT = 512


class Counter:
    """Numbers of tokens by one vocabulary file."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self._known: dict[str, int] = {}
        self._special: re.Pattern | None = None
        self._cuts = False
        if path.endswith(".model"):
            import sentencepiece

            pieces = sentencepiece.SentencePieceProcessor(model_file=path)
            self._encode = lambda texts: pieces.encode(texts, num_threads=1)
        else:
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_file(path)
            tokenizer.no_truncation()
            tokenizer.no_padding()
            self._encode = lambda texts: tokenizer.encode_batch_fast(texts, add_special_tokens=False)
            self._look_at(json.loads(tokenizer.to_str()))

    def _look_at(self, spec: dict) -> None:
        split, added = spec["pre_tokenizer"] or {}, spec["added_tokens"]
        plain = split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space") and not spec["normalizer"]
        self._cuts = bool(plain) and not any(a["lstrip"] or a["rstrip"] or a["single_word"] or re.search(r"\s", a["content"]) for a in added)
        if added:  # the library takes these out of a text first, the leftmost and longest
            self._special = re.compile("|".join(re.escape(a["content"]) for a in sorted(added, key=lambda a: -len(a["content"]))))

    def lengths(self, texts: list[str]) -> list[int]:
        return list(map(len, self._encode(texts)))

    def count(self, texts: list[str]) -> list[int]:
        """Tokens of each of some texts, of GROUP_BYTES or so together."""
        if not self._cuts:
            return self.lengths(texts)
        lists, special = [], [0] * len(texts)
        for k, text in enumerate(texts):
            if self._special and self._special.search(text):
                between = self._special.split(text)
                special[k] = len(between) - 1
                lists.append([u for x in between for u in units(x)])
            else:
                lists.append(units(text))
        if len(self._known) > CACHE:
            self._known.clear()
        new = list(set(chain.from_iterable(lists)).difference(self._known))
        self._known.update(zip(new, self.lengths(new)))
        out = [n + sum(map(self._known.__getitem__, own)) for n, own in zip(special, lists)]
        for u in new:
            if len(u) > CACHE_CHARS:
                del self._known[u]
        return out

    def long(self, text: str) -> int:
        """Tokens of one long text, a part at a time."""
        return sum(self.count([p])[0] for p in parts(text)) if self._cuts else self.lengths([text])[0]


_counters: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    """One counter for each worker process and vocabulary."""
    if path not in _counters:
        _counters[path] = Counter(path)
    return _counters[path]


def groups(sizes: np.ndarray, most: int = GROUP_BYTES) -> Iterator[tuple[int, int]]:
    """(first, end) of runs of rows of at most ``most`` bytes together; a longer row is a run of its own."""
    ends, at = np.cumsum(sizes), 0
    while at < len(sizes):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield at, stop
        at = stop


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (more than ``limit`` tokens) of each row of docs (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = counter(vocabulary)
        for batch in batches:
            sizes = pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False)
            for at, stop in groups(sizes):
                texts = batch.column(1).slice(at, stop - at).to_pylist()
                n = [by.long(texts[0])] if stop == at + 1 and sizes[at] > GROUP_BYTES else by.count(texts)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, stop - at), pa.array(sizes[at:stop], pa.int64()), pa.array(n, pa.int64())], schema=schema)

    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])
    counted = common.id_text(docs).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(common.table(spark, sf_dir, "documents"), common.vocabulary_path("byte_bpe_50k.json"))
