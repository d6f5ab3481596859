"""SimHash near-duplicates: 64-bit fingerprints linked at a small Hamming distance, found with vantage-point trees.

1. Each text's fingerprint comes from the XXH64 hashes of its 3-word shingles.  Equal fingerprints become one point.
2. The top of a vantage-point tree, fitted on a sample of the points (those of lowest hash, some SAMPLE of them),
   cuts the space into shards: a node sends what lies within ``mu`` of its vantage point left and the rest right.
   Where more shards are wanted than the sample can fit, each shard of the top tree gets a tree of its own, fitted by
   a task on a sample of its own points.  Every point goes to its one home shard as data, and as a query to each shard
   that the triangle bound cannot exclude (``d - r <= mu`` left, ``d + r > mu`` right), so pairs across a boundary are
   met exactly.
3. Each shard answers its queries with a vantage-point tree of its own and returns, instead of pairs, a spanning
   star of what it has linked.  A shard's memory is bounded: queries come in chunks, links are merged as they come.
4. Large-star and small-star rounds turn the stars into connected components; nothing is gathered on the driver but
   the samples of the top tree and the trees' nodes, one for each SHARD points.

Cases: a null or empty text has fingerprint 0 and is linked like any other; a row of null doc_id has a fingerprint
but no component; each of the rows that repeat a doc_id is linked by its own text, and so may have a component of its
own; an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Fixed by the contract.
SHINGLE, SEED, RADIUS = 3, 42, 3
#: Points that fit a tree, and of these for each leaf at least; points a shard is meant to hold, data of a leaf inside a shard, links kept before they are merged.
SAMPLE, PER_LEAF, SHARD, LEAF, LINKS = 32768, 16, 32768, 192, 1 << 20


def fingerprint(text: str | None) -> int:
    """Bit b is 1 if over half of the shingles' hashes have it; 0 without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if not n:
        return 0
    if n <= SHINGLE:
        return _majority(xxhash.xxh64_digest(b" ".join(words), SEED))
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = [0, *(ends[: n - SHINGLE] + 1).tolist()]
    view, digest = memoryview(joined), xxhash.xxh64_digest
    return _majority(b"".join([digest(view[a:b], SEED) for a, b in zip(starts, ends[SHINGLE - 1 :].tolist())]))


def _majority(digests: bytes) -> int:
    h = np.frombuffer(digests, np.uint8).reshape(-1, 8)
    total = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):
        total += np.unpackbits(h[at : at + (1 << 16)], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(total * 2 > len(h)).tobytes(), "big")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long) and h (a hash of the text) of each row."""

    def run(x):
        return {"doc_id": x["doc_id"], "h": x["h"], "fp": [v - (1 << 64) if (v := fingerprint(t)) >> 63 else v for t in x["text"]]}

    return common.map_rows(common.id_text(docs).withColumn("h", F.xxhash64("text")), "doc_id long, h long, fp long", run)


def vantage_tree(points: np.ndarray, leaves: int) -> list[tuple]:
    """Nodes (vantage, mu, left, right), children as node numbers or ~shard; the root is node 0.  One shard: no nodes."""
    nodes: list[tuple] = []
    shards = 0

    def build(part: np.ndarray, want: int) -> int:
        nonlocal shards
        best = None
        if want > 1 and len(part) >= 4:
            for v in part[:: max(1, len(part) // 8)][:8]:  # the candidate with the fewest sample points near its boundary
                d = np.bitwise_count(part ^ v).astype(np.int64)
                for mu in {int(np.quantile(d, q)) for q in (0.4, 0.5, 0.6)}:
                    left = int((d <= mu).sum())
                    if min(left, len(part) - left) >= len(part) * 0.25:
                        near = int(((d > mu - RADIUS) & (d <= mu + RADIUS)).sum())
                        best = min(best or (near, int(v), mu), (near, int(v), mu))
        if not best:
            shards += 1
            return ~(shards - 1)
        at = len(nodes)
        nodes.append(())
        d = np.bitwise_count(part ^ np.uint64(best[1]))
        nodes[at] = (best[1], best[2], build(part[d <= best[2]], (want + 1) // 2), build(part[d > best[2]], want // 2))
        return at

    build(points, leaves)
    return nodes


def route(nodes: list[tuple], fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(index into fps, shard) for each shard that may hold a point within radius."""
    if not nodes:
        return np.arange(len(fps)), np.zeros(len(fps), np.int64)
    out, todo = [], [(0, np.arange(len(fps)))]
    while todo:
        at, idx = todo.pop()
        if not len(idx):
            continue
        if at < 0:
            out.append((idx, np.full(len(idx), ~at, np.int64)))
            continue
        v, mu, left, right = nodes[at]
        d = np.bitwise_count(fps[idx] ^ np.uint64(v)).astype(np.int64)
        todo += [(left, idx[d - radius <= mu]), (right, idx[d + radius > mu])]
    return np.concatenate([o[0] for o in out] or [np.zeros(0, np.int64)]), np.concatenate([o[1] for o in out] or [np.zeros(0, np.int64)])


class Forest:
    """A top tree and, for shards of it that are still too large, trees of their own."""

    def __init__(self, top: list[tuple], below: dict[int, list[tuple]], wide: int):
        self.top, self.below, self.wide = top, below, wide

    def route(self, fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        idx, shard = route(self.top, fps, radius)
        if not self.below:
            return idx, shard
        out_i, out_s = [], []
        for k in np.unique(shard).tolist():
            own = idx[shard == k]
            i, sub = route(self.below.get(k, []), fps[own], radius)
            out_i.append(own[i])
            out_s.append(k * self.wide + sub)
        return (np.concatenate(out_i), np.concatenate(out_s)) if out_i else (idx, shard)


def _sample(points: DataFrame, count: int, wanted: int) -> DataFrame:
    """Some ``wanted`` of the points: those whose hash is under a threshold."""
    share = min(1.0, wanted / max(count, 1))
    return points.select("fp").where(F.expr(f"(xxhash64(fp) & 9223372036854775807) <= {int(share * ((1 << 63) - 1))}"))


def fit_forest(points: DataFrame, count: int, shard: int = SHARD, sample: int = SAMPLE) -> tuple[Forest, int]:
    """(forest, shards wanted) for points of which there are ``count``."""
    leaves = -(-count // shard)
    if leaves < 2:
        return Forest([], {}, 1), 1
    most = max(2, sample // PER_LEAF)
    picked = np.array([r.fp for r in _sample(points, count, sample).toLocalIterator()], np.int64).view(np.uint64)
    picked.sort()
    np.random.default_rng(1).shuffle(picked)
    top = vantage_tree(picked, min(leaves, most))
    if leaves <= most:
        return Forest(top, {}, 1), leaves
    wide = -(-leaves // most)
    shared = Forest(top, {}, 1)

    def home(batches):
        for batch in batches:
            fps = batch.column(0).to_numpy().view(np.uint64)
            at, to = shared.route(fps, 0)
            yield pa.RecordBatch.from_pydict({"top": to.astype(np.int32), "fp": fps[at].view(np.int64)})

    def fit(t: pa.Table) -> pa.Table:
        own = np.sort(t.column("fp").to_numpy().view(np.uint64))
        np.random.default_rng(2).shuffle(own)
        nodes = vantage_tree(own, wide)
        return pa.table({"top": pa.array([t.column("top")[0].as_py()], pa.int32()), "nodes": pa.array([[[_signed(v) for v in n] for n in nodes]], pa.list_(pa.list_(pa.int64())))})

    found = _sample(points, count, leaves * PER_LEAF * 2).mapInArrow(home, "top int, fp long").groupBy("top").applyInArrow(fit, "top int, nodes array<array<long>>").collect()
    return Forest(top, {r.top: [(n[0] % (1 << 64), *n[1:]) for n in r.nodes] for r in found}, wide + 1), leaves


def _signed(v: int) -> int:
    return v - (1 << 64) if v >> 63 > 0 else v


class Links:
    """Connected components over n points under links that arrive in arrays; bounded memory."""

    def __init__(self, n: int):
        self.label, self.held, self.size = np.arange(n), [], 0

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        differ = self.label[a] != self.label[b]
        if differ.any():
            self.held.append((a[differ], b[differ]))
            self.size += int(differ.sum())
            if self.size >= LINKS:
                self.merge()

    def merge(self) -> np.ndarray:
        if self.held:
            a, b = (np.concatenate(x) for x in zip(*self.held))
            self.held, self.size = [], 0
            while True:
                la, lb = self.label[a], self.label[b]
                differ = la != lb
                if not differ.any():
                    break
                a, b, la, lb = a[differ], b[differ], la[differ], lb[differ]
                np.minimum.at(self.label, np.maximum(la, lb), np.minimum(la, lb))
                while True:
                    up = self.label[self.label]
                    if np.array_equal(up, self.label):
                        break
                    self.label = up
        return self.label


def link_shard(data: np.ndarray, query: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(point, root) for each point that a link joins to a smaller-numbered root, over all links of a query and a datum."""
    points, inverse = np.unique(np.concatenate([data, query]), return_inverse=True)
    own, asked = np.unique(inverse[: len(data)]), np.unique(inverse[len(data) :])
    links = Links(len(points))
    todo = [(own, asked, 0)]
    while todo:
        d_idx, q_idx, depth = todo.pop()
        if not len(d_idx) or not len(q_idx):
            continue
        if len(d_idx) > LEAF and depth < 40:
            v = points[d_idx[(depth * 7919) % len(d_idx)]]
            dd = np.bitwise_count(points[d_idx] ^ v)
            mu = int(np.median(dd))
            left = dd <= mu
            if not left.all():
                dq = np.bitwise_count(points[q_idx] ^ v).astype(np.int64)
                todo.append((d_idx[left], q_idx[dq - RADIUS <= mu], depth + 1))
                todo.append((d_idx[~left], q_idx[dq + RADIUS > mu], depth + 1))
                continue
        step = max(1, (1 << 19) // min(len(d_idx), 1 << 13))
        for i in range(0, len(d_idx), 1 << 13):
            dp = d_idx[i : i + (1 << 13)]
            for j in range(0, len(q_idx), step):
                qp = q_idx[j : j + step]
                x, y = np.nonzero(np.bitwise_count(points[dp][:, None] ^ points[qp][None, :]) <= RADIUS)
                links.add(dp[x], qp[y])
    label = links.merge()
    moved = np.nonzero(label != np.arange(len(points)))[0]
    return points[moved], points[label[moved]]


def near_links(points: DataFrame, count: int, shard: int = SHARD, sample: int = SAMPLE) -> DataFrame:
    """Edges (u, v) that join exactly the points (column fp, distinct) which links of at most RADIUS bits connect."""
    forest, leaves = fit_forest(points, count, shard, sample)
    chunks = max(1, round(1.55 ** math.log2(leaves) / 8))

    def send(batches):
        for batch in batches:
            fps = batch.column(0).to_numpy().view(np.uint64)
            home, at = forest.route(fps, 0)
            asked, to = forest.route(fps, RADIUS)
            part = ((fps[asked] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)) % np.uint64(chunks)
            yield pa.RecordBatch.from_pydict({
                "shard": np.concatenate([np.repeat(at, chunks), to]).astype(np.int32),
                "chunk": np.concatenate([np.tile(np.arange(chunks), len(home)), part.astype(np.int64)]).astype(np.int32),
                "asks": np.concatenate([np.zeros(len(home) * chunks, bool), np.ones(len(asked), bool)]),
                "fp": np.concatenate([np.repeat(fps[home], chunks), fps[asked]]).view(np.int64),
            })

    def solve(t: pa.Table) -> pa.Table:
        fps, asks = t.column("fp").to_numpy().view(np.uint64), t.column("asks").to_numpy()
        u, v = link_shard(fps[~asks], fps[asks])
        return pa.table({"u": u.view(np.int64), "v": v.view(np.int64)})

    sent = points.select("fp").mapInArrow(send, "shard int, chunk int, asks boolean, fp long")
    return sent.groupBy("shard", "chunk").applyInArrow(solve, "u long, v long")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) with root the least node of its component, for each node of an edge but the roots themselves.

    Alternates large-star and small-star steps until neither changes anything.  Each round's edges are written to the
    shared folder, so a lost executor costs a part of one round.
    """
    now = common.materialize(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    for _ in range(rounds):
        before = _digest(now)
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        now = common.materialize(small, "edges")
        if _digest(now) == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    raise RuntimeError(f"no fixed point after {rounds} rounds")


def _digest(edges: DataFrame):
    return tuple(edges.agg(F.count("*"), F.expr("sum(xxhash64(u, v) % 1000000007)"), F.expr("bit_xor(xxhash64(v, u))")).first())


def _classes(docs: DataFrame, shard: int) -> DataFrame:
    """doc_id, h, fp, component_id and root (a fingerprint that names the component) of each row of docs."""
    rows = common.materialize(fingerprints(docs), "fingerprints")
    points = common.materialize(rows.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("least")), "points")
    star = components(near_links(points.select("fp"), points.count(), shard))
    named = points.join(star, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = common.materialize(named, "named")
    # only roots that have other members need the second join
    wide = named.groupBy("root").agg(F.min("least").alias("component_id"))
    of_point = named.join(wide, "root").select(F.col("fp").alias("_fp"), "component_id", "root")
    joined = rows.join(common.materialize(of_point, "classes"), F.col("fp") == F.col("_fp"), "left")
    known = F.col("doc_id").isNotNull()
    return joined.select("doc_id", "h", "fp", F.when(known, F.col("component_id")).alias("component_id"), F.when(known, F.col("root")).alias("root"))


def near_duplicates(docs: DataFrame, shard: int = SHARD) -> DataFrame:
    """doc_id, fp and component_id (the least doc_id reachable; null where doc_id is null) of each row of docs."""
    return _classes(docs, shard).select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each group, one of the least doc_id, with all its columns; rows of null doc_id all stay.

    The row that stays is known by its doc_id and its text's hash, so rows of the same doc_id with other texts are not
    taken for it; of rows equal in both one stays.
    """
    kept = _classes(docs, SHARD).where("doc_id = component_id").groupBy("root").agg(F.first("doc_id").alias("_keep_id"), F.min("h").alias("_keep_h"))
    rows = common.boxed(docs).withColumn("_id", F.col("_row.doc_id").cast("long")).withColumn("_h", F.xxhash64(F.coalesce(F.col("_row.text"), F.lit(""))))
    first = rows.where("_id is not null").join(kept, F.expr("_id = _keep_id and _h = _keep_h"), "left_semi").dropDuplicates(["_id", "_h"])
    return first.unionByName(rows.where("_id is null")).select("_row.*")


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(common.table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
