"""License scans: MinHash bands over overlapping text windows retrieve templates, exact containment verifies them.

The templates are the files of ``license_texts`` beside this module, one for each name: whole licences, the headers that
they ask to be put into files, and the short notices that people write instead of either.  They are the words of the
licences' stewards but for the notices, which are common usage.  Other templates can be given as a parameter.

Words are runs of letters, digits and ``.+-`` in lower case; shingles are five words (a template of fewer words is its
one shingle).  A text holds a template if some window of the template's length in words has at least ``share`` of the
template's distinct shingles.

Templates are sorted into length classes whose members differ by a fifth at most.  A class's windows start at every
quarter of its length and are long enough that each possible place of its templates lies whole in one of them.  With a
share k of w shingles in common, a window and a template have a chance of k / w of sharing a band's minimum (one
permutation for each band); the bands are as many as bring the chance of a miss under MISS.  All classes share the
permutations.  A template of one shingle is looked up itself.  Texts of a slice are laid end to end for the search and
verified each by itself.

Cases: null and empty texts hold nothing; each template is reported once for a text, at its best and then first place;
repeated rows are scanned alike; an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SHINGLE, SHARE, MISS = 5, 0.8, 1e-3
WORD = re.compile(r"[\w.+\-]*\w")

FOLDER = Path(__file__).parent / "license_texts"


def templates() -> dict[str, str]:
    """Name and text of each licence, header and notice that the scan knows."""
    return {p.stem: p.read_text("utf-8") for p in sorted(FOLDER.glob("*.txt"))}


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) > common.CACHE_WORDS:
            self.clear()
        h = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"), 3)
        self[word] = h
        return h


_hashes = _Hashes()


def shingles(text: str | None) -> np.ndarray:
    """Hashes of the 5-word shingles in order; of a shorter text the one shingle of all its words."""
    words = WORD.findall(text.lower()) if text else []
    h = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    if not len(h):
        return h
    n = min(SHINGLE, len(h))
    out = np.zeros(len(h) - n + 1, np.uint64)
    for k in range(n):
        out = (out ^ h[k : len(h) - n + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(32)
    return out


class Scanner:
    """Templates by length class, with their signatures."""

    def __init__(self, texts: dict[str, str] | None = None, share: float = SHARE, miss: float = MISS):
        self.share = share
        self.templates = [(name, shingles(text)) for name, text in (templates() if texts is None else texts).items()]
        self.least = [math.ceil(share * len(np.unique(s))) for _, s in self.templates]  # shingles to be found
        order = sorted((len(s), t) for t, (_, s) in enumerate(self.templates) if len(s))
        groups: list[list[int]] = []
        for n, t in reversed(order):  # the longest of a class leads it
            if not groups or n < 0.8 * len(self.templates[groups[-1][0]][1]):
                groups.append([])
            groups[-1].append(t)
        rng = np.random.default_rng(17)
        self.mixes: list[np.uint64] = []
        self.classes = []
        for own in groups:
            size = len(self.templates[own[0]][1])
            step = max(1, size // 4)
            over = -(-(size + step - 1) // step)  # steps in a window
            chance = min(self.least[t] / (over * step + len(self.templates[t][1]) - self.least[t]) for t in own)
            bands = 1 if chance >= 1 else math.ceil(math.log(miss) / math.log(1 - chance))
            while len(self.mixes) < bands:
                self.mixes.append(rng.integers(0, 1 << 62, 1, np.uint64)[0] * np.uint64(2) + np.uint64(1))
            self.classes.append((step, over, [self._table(own, m) for m in self.mixes[:bands]]))

    def _table(self, own: list[int], mix: np.uint64) -> tuple[np.ndarray, np.ndarray]:
        least = np.array([_mixed(self.templates[t][1], mix).min() for t in own], np.uint64)
        order = np.argsort(least, kind="stable")
        return least[order], np.array(own)[order]

    def scan(self, text: str | None) -> list[tuple[str, int, float]]:
        return self.scan_all([text])[0]

    def scan_all(self, texts: list[str | None]) -> list[list[tuple[str, int, float]]]:
        """For each text (template, first shingle's word, containment) of each template that it holds."""
        parts = [shingles(t) for t in texts]
        first = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
        s = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
        asked: set[tuple[int, int, int, int]] = set()  # text, template, from, to
        for band, mix in enumerate(self.mixes if len(s) else ()):
            mixed = _mixed(s, mix)
            for step, over, tables in self.classes:
                if band >= len(tables):
                    continue
                least, own = tables[band]
                win = low = np.minimum.reduceat(mixed, np.arange(0, len(s), step)) if step > 1 else mixed
                if over > 1:
                    win = low.copy()
                    for k in range(1, min(over, len(low))):
                        np.minimum(win[:-k], low[k:], out=win[:-k])
                at = np.searchsorted(least, win)
                hit = np.nonzero(least[np.minimum(at, len(least) - 1)] == win)[0]
                for w in hit.tolist():
                    a, b = w * step, min((w + over) * step, len(s))
                    inside = range(int(np.searchsorted(first, a, "right")) - 1, int(np.searchsorted(first, b, "left")))
                    for j in range(int(at[w]), int(np.searchsorted(least, win[w], "right"))):
                        for d in inside:
                            lo, hi = max(a, int(first[d])), min(b, int(first[d + 1]))
                            if hi - lo >= self.least[own[j]]:
                                asked.add((d, int(own[j]), lo, hi))
        found: list[dict[int, tuple[float, int]]] = [{} for _ in texts]
        for d, t, a, b in sorted(asked):
            got = self._contained(s[a:b], self.templates[t][1])
            if got and got[0] >= self.share:
                best = (-got[0], a - int(first[d]) + got[1])
                found[d][t] = min(found[d].get(t, best), best)
        return [[(self.templates[t][0], at, -neg) for t, (neg, at) in sorted(f.items())] for f in found]

    @staticmethod
    def _contained(window: np.ndarray, own: np.ndarray) -> tuple[float, int] | None:
        """(largest share of own's distinct shingles in a run of len(own) shingles, first such run that starts at one of them)."""
        want = np.unique(own)
        at = np.nonzero(np.isin(window, want))[0].tolist()
        if not at:
            return None
        which = np.searchsorted(want, window[at]).tolist()
        held: Counter = Counter()
        most, best, end = 0, 0, 0
        for i, start in enumerate(at):
            while end < len(at) and at[end] < start + len(own):
                held[which[end]] += 1
                end += 1
            if len(held) > most:
                most, best = len(held), start
            held[which[i]] -= 1
            if not held[which[i]]:
                del held[which[i]]
        return most / len(want), best


def _mixed(s: np.ndarray, mix: np.uint64) -> np.ndarray:
    m = s * mix
    return m ^ (m >> np.uint64(29))


def scan_licenses(docs: DataFrame, texts: dict[str, str] | None = None, share: float = SHARE) -> DataFrame:
    """doc_id, license, at_word, containment of each template in each document.

    The templates are a parameter of fixed size; their signatures go to the workers with the task.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Scanner(texts, share))

    def run(x):
        rows = [(d, *hit) for d, hits in zip(x["doc_id"], shared.value.scan_all(x["text"])) for hit in hits]
        return dict(zip(("doc_id", "license", "at_word", "containment"), zip(*rows) if rows else [()] * 4))

    return common.map_rows(common.id_text(docs), "doc_id long, license string, at_word long, containment double", run)


def op3_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(common.table(spark, sf_dir, "documents"))
