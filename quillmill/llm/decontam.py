"""Benchmark decontamination: CGK embedding, bit-sampling LSH, exact edit verification.

Texts and benchmark items are words (lower case, ASCII punctuation dropped).  A document holds an item if some run of
its words is within ``floor(max_edit * words of the item)`` word edits of the whole item.

The CGK walk reads a word at its position, writes it to the embedding, and moves on by a random bit that depends on
the step and the word; equal stretches, also shifted ones, soon walk in step, so that edit distance becomes Hamming
distance.  A document's windows are as long as the item and lie at every ``stride``-th word.

One walk over a whole window seldom agrees at the full bound, where every fifth word is edited, and would take dozens of
repetitions of up to 120 steps (README has figures).  So a window's embedding is made of short walks, one from each of
its words, and a sample takes coordinates of one of them: such walks are shared by all windows that they lie in and are
computed once for a text.  Each repetition has walks and samples of its own.  A walk that agrees with an item's at some word
places the item's window; that window, with room for the edits on both sides, is the candidate.  The shorter an item, the
fewer walks it has and the shorter are its unedited runs; so each class of lengths in ``CLASSES`` has steps, samples,
repetitions and a stride of its own, set from the recall that the tests measure at the full edit bound: 0.97 or more
for every length, and 1 for copies.

Myers' bit-vector algorithm over words then decides exactly, in blocks of MASK words of the item, so that its memory
grows with the item's words and not with their square.

The benchmark is read in blocks of at most ``block_chars`` characters (or of one item); each block is one pass over the
documents and one broadcast of bounded size.

Items with under ``MIN_WORDS`` words are too short to sample.  They are cut into one segment more than the edits that
the bound allows; an edit spoils one segment at most, so any run within the bound holds some segment unchanged, near
its place.  Looking up all segments therefore finds every candidate, and Myers' algorithm decides as for long items.

Cases: null and empty texts hold nothing; items without a word are held by nothing; items of null or repeated item_id
are items of their own and give hits of their own; repeated rows give repeated hits; empty tables give none; further
columns are not read, and stay as they are in ``drop_leaks``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

MAX_EDIT = 0.2
MIN_WORDS = 14
#: By the least words of an item: steps of a walk, samples of them, repetitions, words from window to window of a text.
CLASSES = {MIN_WORDS: (8, 6, 6, 1), 24: (12, 7, 5, 2), 100: (10, 7, 2, 4)}
PAD = max(MIN_WORDS, *(steps for steps, *_ in CLASSES.values()))
BLOCK_CHARS = 4 << 20
#: Words of a block of Myers' algorithm, and words whose masks a worker remembers.
MASK, MASKED = 1024, 1 << 18

_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return text.lower().encode("utf-8", "surrogatepass").translate(_FOLD).split() if text else []


class _Hashes(dict):
    """64-bit hash of a word; emptied when it grows large."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > common.CACHE_WORDS:
            self.clear()
        h = xxhash.xxh64_intdigest(word, 11)
        self[word] = h
        return h


_hashes = _Hashes()


def hashed(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))


class Walks:
    """The fixed random choices of a class: for each repetition a mixing constant and the sampled steps."""

    def __init__(self, steps: int, samples: int, repeats: int, stride: int, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.steps, self.repeats, self.stride = steps, repeats, stride
        self.mix = rng.integers(1, 1 << 63, repeats, np.uint64) * np.uint64(2) + np.uint64(1)
        self.taken = [set(rng.choice(steps, samples, replace=False).tolist()) for _ in range(repeats)]

    def signatures(self, h: np.ndarray, starts: np.ndarray, r: int) -> np.ndarray:
        """Samples of the embedding of the windows at starts, folded into one number; h is padded by PAD words."""
        bits = h * self.mix[r]
        bits ^= bits >> np.uint64(31)
        pos, sig = starts.copy(), np.full(len(starts), r + 1, np.uint64)
        last = max(self.taken[r])
        for step in range(last + 1):
            if step in self.taken[r]:
                sig = (sig ^ h[pos]) * np.uint64(0x9E3779B97F4A7C15)
                sig ^= sig >> np.uint64(29)
            if step < last:
                pos += ((bits[pos] >> np.uint64(step)) & np.uint64(1)).astype(np.int64)
        return sig


def run_signatures(h: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """The runs of n words at starts, folded into one number; h is padded by PAD words."""
    sig = np.full(len(starts), n, np.uint64)
    for k in range(n):
        sig = (sig ^ h[starts + k]) * np.uint64(0x9E3779B97F4A7C15)
        sig ^= sig >> np.uint64(29)
    return sig


class Lookup:
    """Signatures of one kind, sorted, with the item and the word where each starts."""

    def __init__(self, sigs: list[np.ndarray], owners: list[np.ndarray]):
        s, o = np.concatenate(sigs), np.concatenate(owners)
        order = np.argsort(s, kind="stable")
        self.sigs, self.owners = s[order], o[order]
        self.shift = np.uint64(64 - max(16, min(26, len(s).bit_length() + 6)))
        self.there = np.zeros(1 << (64 - int(self.shift)), bool)
        self.there[s >> self.shift] = True

    def met(self, sig: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(item, place where it would start, start of the window) of each agreeing pair."""
        maybe = np.nonzero(self.there[sig >> self.shift])[0]
        lo, hi = np.searchsorted(self.sigs, sig[maybe], "left"), np.searchsorted(self.sigs, sig[maybe], "right")
        met = hi > lo
        lo, n, at = lo[met], (hi - lo)[met], np.repeat(starts[maybe][met], (hi - lo)[met])
        owner = self.owners[np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())]
        return owner >> 32, at - (owner & 0xFFFFFFFF), at


class Index:
    """A block of benchmark items, ready to be looked up."""

    def __init__(self, items: list[tuple[int, str]], max_edit: float = MAX_EDIT):
        self.items, self.max_edit = [], max_edit
        self.walks = {least: Walks(*chosen) for least, chosen in CLASSES.items()}
        # what is looked up: (least words of the class, repetition) of walks and (0, words) of segments
        held: dict[tuple[int, int], tuple[list[np.ndarray], list[np.ndarray]]] = {}
        same: dict[bytes, bytes] = {}  # one object for each distinct word
        for item_id, text in items:
            words = [same.setdefault(w, w) for w in words_of(text)]
            if not words:
                continue
            k, m = len(self.items), len(words)
            self.items.append((item_id, words, int(max_edit * m)))
            h = np.concatenate([hashed(words), np.zeros(PAD, np.uint64)])
            if m < MIN_WORDS:
                parts = min(m, int(max_edit * m) + 1)
                edges = [m * i // parts for i in range(parts + 1)]
                kinds = [((0, b - a), np.array([a])) for a, b in zip(edges, edges[1:])]
            else:
                least = max(x for x in CLASSES if x <= m)
                starts = np.arange(m - self.walks[least].steps + 1)
                kinds = [((least, r), starts) for r in range(self.walks[least].repeats)]
            for kind, starts in kinds:
                sigs, owners = held.setdefault(kind, ([], []))
                sigs.append(self.signatures(kind, h, starts))
                owners.append((k << 32) + starts)
        self.lookups = {kind: Lookup(*held[kind]) for kind in sorted(held)}
        self.masks, self.masked = {}, 0

    def masks_of(self, k: int) -> list[tuple[dict[bytes, int], int]]:
        if k not in self.masks:
            if self.masked > MASKED:
                self.masks, self.masked = {}, 0
            self.masks[k] = masks(self.items[k][1])
            self.masked += len(self.items[k][1])
        return self.masks[k]

    def signatures(self, kind: tuple[int, int], h: np.ndarray, starts: np.ndarray) -> np.ndarray:
        return self.walks[kind[0]].signatures(h, starts, kind[1]) if kind[0] else run_signatures(h, starts, kind[1])

    def candidates(self, h: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Distinct columns of item, place in its text where it would start, and text; texts start at first in h."""
        found, starts = [np.zeros((3, 0), np.int64)], {}
        for kind, lookup in self.lookups.items():
            step = self.walks[kind[0]].stride if kind[0] else 1
            if step not in starts:
                starts[step] = np.concatenate([np.arange(a, a + n, step) for a, n in zip(first, sizes)])
            items, places, at = lookup.met(self.signatures(kind, h, starts[step]), starts[step])
            owner = np.searchsorted(first, at, "right") - 1  # a place may lie before its text, the window doesn't
            found.append(np.stack([items, places - first[owner], owner]))
        return np.unique(np.concatenate(found, axis=1), axis=1)

    def hits_of(self, texts: list[str | None]) -> list[list[tuple[int, int, int, int]]]:
        """For each text (item_id, distance, first word, words) of the best place of each item that it holds."""
        out, at = [], 0
        while at < len(texts):  # texts of some 2^18 words at a time share the numpy calls
            words, n = [], 0
            while at < len(texts) and n < 1 << 18:
                words.append(words_of(texts[at]))
                n, at = n + len(words[-1]), at + 1
            out += self._hits(words)
        return out

    def hits(self, text: str | None) -> list[tuple[int, int, int, int]]:
        return self.hits_of([text])[0]

    def _hits(self, texts: list[list[bytes]]) -> list[list[tuple[int, int, int, int]]]:
        sizes = np.array([len(w) for w in texts])
        first = np.concatenate([[0], np.cumsum(sizes + PAD)])
        h = np.zeros(first[-1], np.uint64)
        for k, w in enumerate(texts):
            h[first[k] : first[k] + len(w)] = hashed(w)
        found: list[set[tuple[int, int]]] = [set() for _ in texts]
        if sizes.any():
            items, places, owner = self.candidates(h, first[:-1], sizes)
            for k, at, d in zip(items.tolist(), places.tolist(), owner.tolist()):
                found[d].add((k, at))
        return [self.verified(w, f) for w, f in zip(texts, found)]

    def verified(self, words: list[bytes], candidates: set[tuple[int, int]]) -> list[tuple[int, int, int, int]]:
        best: dict[int, tuple[int, int, int]] = {}
        seen: set[tuple[int, int]] = set()
        n = len(words)
        for k, at in sorted(candidates):
            own, most = self.items[k][1:]
            # places within the bound of one another are settled by one wide look
            cell = (k, at // (most + 1))
            if cell in seen:
                continue
            seen.add(cell)
            lo, hi = max(0, at - 2 * most - 1), min(n, at + len(own) + 2 * most + 1)
            near, blocks = words[lo:hi], self.masks_of(k)
            if len(blocks) == 1 and sum(map(blocks[0][0].__contains__, near)) < len(own) - most:
                continue  # too few of the item's words for the bound
            d, end = closest(blocks, near)
            if d <= most:
                got = (d, lo + max(0, end - len(own)), min(len(own), end))
                best[k] = min(best.get(k, got), got)
        return [(self.items[k][0], *v) for k, v in sorted(best.items())]


def masks(words: list[bytes], size: int = MASK) -> list[tuple[dict[bytes, int], int]]:
    """For each block of an item's words the places of each word as bits, and the number of places."""
    out = []
    for at in range(0, len(words), size):
        held: dict[bytes, int] = {}
        for i, w in enumerate(words[at : at + size]):
            held[w] = held.get(w, 0) | 1 << i
        out.append((held, min(size, len(words) - at)))
    return out


def closest(blocks: list[tuple[dict[bytes, int], int]], words: list[bytes]) -> tuple[int, int]:
    """(least edit distance of the whole item to any run of words, where that run ends), by Myers' bit vectors."""
    carry = [0] * len(words)  # how the row above a block differs from column to column; a run may start anywhere
    for held, m in blocks:
        full, high = (1 << m) - 1, 1 << (m - 1)
        pv, mv = full, 0
        for j, w in enumerate(words):
            eq, above = held.get(w, 0), carry[j]
            xv = eq | mv
            if above < 0:
                eq |= 1
            xh = (((eq & pv) + pv) ^ pv) | eq
            ph, mh = mv | (~(xh | pv) & full), pv & xh
            carry[j] = 1 if ph & high else -1 if mh & high else 0
            ph, mh = ph << 1 | (above > 0), mh << 1 | (above < 0)
            pv, mv = (mh | (~(xv | ph) & full)) & full, ph & xv & full
    score = best = sum(m for _, m in blocks)
    end = 0
    for j, step in enumerate(carry, 1):
        score += step
        if score < best:
            best, end = score, j
    return best, end


def blocks(benchmark: DataFrame, max_edit: float = MAX_EDIT, block_chars: int = BLOCK_CHARS) -> Iterator[Index]:
    """Indexes over blocks of the benchmark, each of bounded size, streamed through the driver."""
    held, size = [], 0
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text")).toLocalIterator()
    for row in rows:
        if held and size + len(row.text) > block_chars:
            yield Index(held, max_edit)
            held, size = [], 0
        held.append((row.item_id, row.text))
        size += len(row.text)
    if held:
        yield Index(held, max_edit)


def find_leaks(docs: DataFrame, benchmark: DataFrame, max_edit: float = MAX_EDIT, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, item_id, distance, at and n_words (the place in the document's words) of each item in each document."""
    texts = common.id_text(docs)
    ddl, out = "doc_id long, item_id long, distance int, at int, n_words int", None
    for index in blocks(benchmark, max_edit, block_chars):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(x, shared=shared):
            rows = [(d, *hit) for d, hits in zip(x["doc_id"], shared.value.hits_of(x["text"])) for hit in hits]
            return dict(zip(("doc_id", "item_id", "distance", "at", "n_words"), zip(*rows) if rows else [()] * 5))

        part = common.map_rows(texts, ddl, run)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else docs.sparkSession.createDataFrame([], ddl)


def drop_leaks(docs: DataFrame, benchmark: DataFrame, max_edit: float = MAX_EDIT, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of docs that hold no item, with all their columns."""
    rows = common.boxed(docs)
    for index in blocks(benchmark, max_edit, block_chars):
        shared = docs.sparkSession.sparkContext.broadcast(index)
        rows = common.map_boxed(rows, "_keep boolean", lambda row, shared=shared: {"_keep": [not hits for hits in shared.value.hits_of(row.field("text").to_pylist())]})
    return rows.select("_row.*")


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
