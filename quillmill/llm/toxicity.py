"""Toxicity by compression distance: how much shorter a window gets with a dictionary of toxic text.

Two zstandard dictionaries are trained, one on windows of ordinary text and one on windows of toxic text.  The windows
of a text (WINDOW words, half overlapping) are compressed with the ordinary dictionary, and with the toxic one placed
before it; what both know costs the same, so the gain (bytes saved) is near zero but where toxic strings occur.  A
text's gains give five figures (largest, mean of the three largest, mean, share and count of large ones), which a
logistic model turns into a score; its offset is calibrated so that the threshold of best F1 on the training rows is a
score of THRESHOLD.

Most windows of a toxic text are ordinary text.  The toxic dictionary is trained on those of NEAR words which hold a
word that occurs in at least SUPPORT of the toxic training texts, and no more than a twentieth as often in ordinary
ones; the trainer takes short segments (SEGMENT bytes), so what these windows share is what the dictionary keeps.

Settings were chosen by cross-validation on training rows alone; the README has the figures.

Training rows are a bounded sample: the labelled rows of lowest hash, at most MAX_TOXIC and MAX_ORDINARY texts, of at
most TEXT_BYTES each and TRAIN_BYTES together, none from the held-out fold.  Everything else covers all rows.

Cases: a null or empty text has no gains and is scored like any text of gain zero; conflicting labels of a doc_id
count as toxic, and of several texts of a doc_id the least is trained on; without toxic or without ordinary training
texts every score is 0; repeated rows are scored alike; an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

MAX_TOXIC, MAX_ORDINARY = 2000, 4000
TEXT_BYTES, TRAIN_BYTES = 1 << 20, 64 << 20
WINDOW, STRIDE, LEVEL = 8, 4, 9
ORDINARY_BYTES, TOXIC_BYTES, SUPPORT, NEAR, SEGMENT = 65536, 2048, 0.01, 3, 16
THRESHOLD, LARGE, FOLDS = 0.7, 3, 5
_TRIM = b".,;:!?#%&*$|\"'()"


def _words(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8", "surrogatepass").split()


def windows(text: str | None, size: int = WINDOW, stride: int = STRIDE) -> list[bytes]:
    """Runs of ``size`` words that start every ``stride`` words and together hold the whole text."""
    words = _words(text)
    return [b" " + b" ".join(words[i : i + size]) + b" " for i in range(0, max(1, len(words) - size + stride), stride)] if words else []


def toxic_windows(texts: list[str], others: list[str], size: int = NEAR) -> list[bytes]:
    """Runs of ``size`` words of the texts that hold a word which the texts share and the others lack."""
    count = lambda docs: Counter(w for t in docs for w in {x.strip(_TRIM) for x in _words(t)})
    own, other = count(texts), count(others)
    shared = {w for w, c in own.items() if len(w) > 3 and c >= max(3, SUPPORT * len(texts)) and other[w] / max(len(others), 1) < 0.05 * c / len(texts)}
    out = []
    for text in texts:
        words = _words(text)
        marked = [x.strip(_TRIM) in shared for x in words]
        out += [b" " + b" ".join(words[i : i + size]) + b" " for i in range(max(1, len(words) - size + 1)) if any(marked[i : i + size])]
    return out


def _dictionary(samples: list[bytes], size: int, segment: int) -> bytes:
    """Content of a trained dictionary; of too few samples for training, the samples themselves, the last most valued."""
    try:
        return zstandard.train_dictionary(size, samples, k=segment, d=8 if segment < 64 else 6).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


class Scorer:
    def __init__(self, ordinary: bytes, toxic: bytes, weights: np.ndarray, mean: np.ndarray, scale: np.ndarray):
        self.parts = (ordinary, toxic, weights, mean, scale)
        self.weights, self.mean, self.scale = weights, mean, scale
        self.plain, self.rude = self._compressor(ordinary), self._compressor(toxic + ordinary)

    def __reduce__(self):
        return Scorer, self.parts

    @staticmethod
    def _compressor(content: bytes):
        params = zstandard.ZstdCompressionParameters.from_level(LEVEL, source_size=64, dict_size=len(content), write_content_size=False, write_checksum=False, write_dict_id=False)
        d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(compression_params=params)
        return zstandard.ZstdCompressor(dict_data=d, compression_params=params).compress

    def figures(self, text: str | None) -> np.ndarray:
        plain, rude = self.plain, self.rude
        gain = np.sort(np.array([len(plain(w)) - len(rude(w)) for w in windows(text)] or [0], np.float64))
        large = gain >= LARGE
        return np.array([gain[-1], gain[-3:].mean(), gain.mean(), large.mean(), math.log1p(large.sum())])

    def score(self, text: str | None) -> float:
        z = float(((self.figures(text) - self.mean) / self.scale) @ self.weights[:-1] + self.weights[-1])
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, z))))


def _logistic(x: np.ndarray, y: np.ndarray, l2: float = 1e-3) -> np.ndarray:
    """Newton's method; the last weight is the offset."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    weight = np.where(y == 1, len(y) / (2 * max(y.sum(), 1)), len(y) / (2 * max((y == 0).sum(), 1)))
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (weight * (p - y)) / len(y) + l2 * w
        h = (x * (weight * p * (1 - p))[:, None]).T @ x / len(y) + l2 * np.eye(len(w))
        w -= np.linalg.solve(h, g)
    return w


def _dictionaries(toxic: list[str], ordinary: list[str]) -> tuple[bytes, bytes] | None:
    samples = toxic_windows(toxic, ordinary) if toxic and ordinary else []
    if not samples:
        return None
    return _dictionary([w for t in ordinary for w in windows(t, 40, 40)], ORDINARY_BYTES, 64), _dictionary(samples, TOXIC_BYTES, SEGMENT)


def _figures(texts: list[str], made: tuple[bytes, bytes]) -> list[np.ndarray]:
    bare = Scorer(*made, np.zeros(6), np.zeros(5), np.ones(5))
    return [bare.figures(t) for t in texts]


def fit(toxic: list[str], ordinary: list[str], folds: int = FOLDS) -> Scorer | None:
    """The scorer of the given texts; None where there is nothing to tell apart.

    The logistic model and its threshold are fitted on figures that each text gets from dictionaries made without it
    (cross-fitting), since a text's own words would make it look easier than a new text is.
    """
    toxic, ordinary = list(dict.fromkeys(toxic)), list(dict.fromkeys(ordinary))
    made = _dictionaries(toxic, ordinary)
    if not made:
        return None
    x, y = [], []
    for k in range(folds):
        rest = lambda texts: [t for i, t in enumerate(texts) if i % folds != k]  # noqa: B023, E731
        own = _dictionaries(rest(toxic), rest(ordinary)) or made
        for label, texts in ((1, toxic[k::folds]), (0, ordinary[k::folds])):
            x += _figures(texts, own)
            y += [label] * len(texts)
    x, y = np.array(x), np.array(y)
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    w = _logistic((x - mean) / scale, y)
    z = ((x - mean) / scale) @ w[:-1] + w[-1]
    order = np.argsort(-z, kind="stable")
    hit = np.cumsum(y[order])
    best = int(np.argmax(2 * hit / (np.arange(1, len(y) + 1) + y.sum())))
    cut = (z[order[best]] + z[order[min(best + 1, len(y) - 1)]]) / 2
    w[-1] += math.log(THRESHOLD / (1 - THRESHOLD)) - cut
    return Scorer(*made, w, mean, scale)


def held_out() -> F.Column:
    return (F.crc32(F.col("doc_id").cast("string")) % 3) == 1


def training_texts(docs: DataFrame, labels: DataFrame, most_bytes: int = TRAIN_BYTES) -> tuple[list[str], list[str]]:
    """(toxic, ordinary) texts of the bounded training sample."""
    known = labels.where("toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic")).where(~held_out())
    pick = lambda y, n: known.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    sample = pick(1, MAX_TOXIC).unionByName(pick(0, MAX_ORDINARY))  # MAX_TOXIC + MAX_ORDINARY rows of two numbers
    fit = common.id_text(docs).where(F.octet_length("text") <= TEXT_BYTES)
    rows = common.materialize(fit.join(F.broadcast(sample), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).withColumn("order", F.xxhash64("doc_id")), "labelled")
    sizes = rows.select("doc_id", "order", F.octet_length("text").alias("size")).orderBy("order", "doc_id").collect()
    total, last = 0, None
    for r in sizes:
        total += r["size"]
        if total > most_bytes:
            break
        last = r["order"]
    taken = rows.where(F.col("order") <= last) if last is not None else rows.limit(0)
    found = taken.orderBy("order", "doc_id").select("toxic", "text").collect()
    return [r.text for r in found if r.toxic == 1], [r.text for r in found if r.toxic == 0]


def score_toxicity(docs: DataFrame, scorer: Scorer | None) -> DataFrame:
    """doc_id, held_out, score and predicted of each row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(scorer)

    def run(x):
        s = shared.value
        return {"doc_id": x["doc_id"], "score": [s.score(t) if s else 0.0 for t in x["text"]]}

    out = common.map_rows(common.id_text(docs), "doc_id long, score double", run)
    return out.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return score_toxicity(docs, fit(*training_texts(docs, common.table(spark, sf_dir, "labels"))))
