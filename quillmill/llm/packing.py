"""Best-fit packing by bin completion.

Every document's ids (with an end id) become pieces of at most ``capacity``; only longer documents are cut.  All that
a packing needs to know of millions of pieces is how many there are of each length, a histogram of at most
``capacity`` rows.  The driver packs the histogram:

* best-fit decreasing gives the incumbent;
* branch and bound completes bins around the largest remaining piece.  A node's children are the undominated fillings,
  fullest first and made only when they are asked for, each with every number of copies that the pieces left allow.
  A node is pruned by waste: its bins and the bound of what is left must beat the incumbent, and a filling may waste
  no more than the incumbent allows.  What is left at a node, packed by best fit, is tried as an incumbent.
* The search goes by discrepancies: first along first children, then along all paths with one step aside, with two,
  and so on (a node's k-th child is k steps aside).  States met before with as few bins and as many steps to go are not searched again.

The search ends when the incumbent meets the bound, when nothing is left to try (the plan is then optimal), or when it
has looked at ``node_limit`` fillings and children; ``Plan`` says which, and how far from the bound it is.  It is the
same search at every size.  Only the deepest LIVE nodes of a path are held; what lies above is made anew when the
search comes back to it, so the driver's memory doesn't grow with the path.

The plan is a list of fillings with copies: best-fit decreasing adds two of them for each length at most, a branch one
for each child, and a filling holds no more than sqrt(2 * capacity) lengths.  So the table of slots that goes to the
workers is bounded by capacity and node_limit, whatever the number of pieces.  Pieces take their places in parallel:
the r-th piece of a length owns the r-th slot of that length.  Ranks come from counts by (partition, length), so no
length meets in one task.

Cases: a null or empty text is its end id alone; null doc_ids and repeated rows are packed like any others; an empty
table gives an empty result; further columns are not read.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections import Counter, defaultdict, deque
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

CAPACITY, END_ID = 2048, 0
#: Fillings and children that the search looks at before it keeps its incumbent; open nodes whose state is held and not made anew.
NODE_LIMIT, LIVE = 50_000, 32

Filling = tuple[tuple[int, int], ...]


def best_fit_decreasing(hist: dict[int, int], capacity: int) -> list[tuple[Filling, int]]:
    """(filling, copies): pieces by falling length, each into the fullest bin that still takes it."""
    room: dict[int, Counter] = defaultdict(Counter)  # room left -> {filling: bins}
    open_rooms: list[int] = []

    def put(left: int, filling: Filling, bins: int) -> None:
        if bins:
            if not room[left]:
                insort(open_rooms, left)
            room[left][filling] += bins

    def add(filling: Filling, length: int, n: int) -> Filling:
        return (*filling, (length, n)) if n else filling

    for length in sorted((x for x in hist if hist[x] > 0), reverse=True):
        left = hist[length]
        while left:
            at = bisect_left(open_rooms, length)
            if at == len(open_rooms):
                each = capacity // length
                put(capacity - each * length, add((), length, each), left // each)
                put(capacity - left % each * length, add((), length, left % each), 1 if left % each else 0)
                break
            fits = open_rooms[at]
            filling, bins = next(iter(room[fits].items()))
            each = fits // length
            full = min(bins, left // each)
            extra = 1 if full < bins and left - full * each else 0
            part = min(each, left - full * each) if extra else 0
            room[fits][filling] -= full + extra
            if not room[fits][filling]:
                del room[fits][filling]
            if not room[fits]:
                del open_rooms[at]
            put(fits - each * length, add(filling, length, each), full)
            put(fits - part * length, add(filling, length, part), extra)
            left -= full * each + part
    return [(f, n) for fillings in room.values() for f, n in fillings.items()]


def best_fit_bins(hist: dict[int, int], capacity: int) -> int:
    """How many bins best-fit decreasing takes; the same steps without the fillings."""
    room: dict[int, int] = {}  # room left: bins
    open_rooms: list[int] = []
    total = 0
    for length in sorted(hist, reverse=True):
        left = hist[length]
        while left:
            at = bisect_left(open_rooms, length)
            new = at == len(open_rooms)
            fits = capacity if new else open_rooms[at]
            each = fits // length
            full, part = divmod(left, each)
            if new:
                total += full + (part > 0)
            elif full < room[fits]:
                room[fits] -= full + (part > 0)
            else:
                full, part = room[fits], 0
                room[fits] = 0
            if not new and not room[fits]:
                del open_rooms[at], room[fits]
            for less, bins in ((each, full), (part, 1 if part else 0)):
                if bins:
                    if fits - less * length not in room:
                        insort(open_rooms, fits - less * length)
                        room[fits - less * length] = 0
                    room[fits - less * length] += bins
            left -= full * each + part
    return total


def lower_bound(hist: dict[int, int], capacity: int) -> int:
    """The larger of the volume bound and the bounds of Martello and Toth over all thresholds up to half a bin."""
    count = np.zeros(capacity + 1, np.int64)
    for k, n in hist.items():
        count[k] = n
    volume = count * np.arange(capacity + 1)
    number, total, half = np.cumsum(count), np.cumsum(volume), capacity // 2
    best = -(-int(total[-1]) // capacity)
    alpha = np.arange(half + 1)
    big = number[-1] - number[capacity - alpha]
    mid, mid_volume = number[capacity - alpha] - number[half], total[capacity - alpha] - total[half]
    small = total[half] - np.where(alpha > 0, total[np.maximum(alpha - 1, 0)], 0)
    more = np.maximum(0, -(-(small - (mid * capacity - mid_volume)) // capacity))
    return max(best, int((big + mid + more).max()))


def fillings(hist: dict[int, int], capacity: int, waste: int) -> Iterator[Filling | None]:
    """Undominated fillings of a bin around the largest piece that waste at most ``waste``, the fullest first; None for each dominated one."""
    sizes = sorted(k for k, n in hist.items() if n)
    largest = sizes[-1]
    free = {k: hist[k] - (k == largest) for k in sizes}
    below = [k for k in reversed(sizes) if free[k] and k <= capacity - largest]
    # reach[i]: bit s is set if pieces of below[i:] can fill s
    full, reach = (1 << capacity - largest + 1) - 1, [1]
    for k in reversed(below):
        r, left, step = reach[-1], min(free[k], (capacity - largest) // k), 1
        while left:
            step = min(step, left)
            r |= r << k * step & full
            left -= step
            step *= 2
        reach.append(r)
    reach.reverse()

    def fill(i: int, s: int, chosen: tuple[tuple[int, int], ...]) -> Iterator[Filling]:
        if not s:
            yield chosen
            return
        for j in range(i, len(below)):
            if not reach[j] >> s & 1:
                return
            k = below[j]
            for n in range(min(s // k, free[k]), 0, -1):
                if reach[j + 1] >> s - n * k & 1:
                    yield from fill(j + 1, s - n * k, (*chosen, (k, n)))

    def spare(low: int, high: int, used: dict[int, int]) -> bool:
        """A piece over low and up to high is left out."""
        return any(free[k] > used.get(k, 0) for k in sizes[bisect_right(sizes, low) : bisect_right(sizes, high)])

    def dominated(chosen: Filling, left: int) -> bool:
        """A piece left out fits beside the chosen, in place of a smaller one, or of two that are no longer than it."""
        used = dict(chosen)
        if spare(0, left, used):
            return True
        for i, (a, n) in enumerate(chosen):
            if left and spare(a, a + left, used):
                return True
            if any(spare(a + b - 1, a + b + left, used) for b, _ in chosen[i + (n < 2) :]):
                return True
        return False

    for left in range(min(waste, capacity - largest) + 1):
        if reach[0] >> capacity - largest - left & 1:
            for chosen in fill(0, capacity - largest - left, ()):
                if dominated(chosen, left):
                    yield None
                    continue
                merged = Counter(dict(chosen))
                merged[largest] += 1
                yield tuple(sorted(merged.items(), reverse=True))


def copies(most: int) -> Iterator[int]:
    """Every number from 1 to most: most first, then the middles of what lies between, so that the range is soon covered."""
    yield most
    todo = deque([(0, most)])  # open ranges
    while todo:
        low, high = todo.popleft()
        if high - low > 1:
            mid = (low + high) // 2
            yield mid
            todo += [(low, mid), (mid, high)]


@dataclass
class Plan:
    """Fillings with copies; bins of them, the bound on any packing's bins, what the search looked at, and whether it is proven to be optimal."""

    fillings: list[tuple[Filling, int]]
    bins: int
    bound: int
    nodes: int = 0
    complete: bool = True


def plan(hist: dict[int, int], capacity: int = CAPACITY, node_limit: int = NODE_LIMIT) -> Plan:
    """The packing of all pieces of hist: {length: pieces}."""
    if any(k > capacity or k <= 0 for k in hist):
        raise ValueError("a piece is longer than a bin")
    hist = {k: n for k, n in hist.items() if n}
    found = best_fit_decreasing(hist, capacity)
    best = Plan(found, sum(n for _, n in found), lower_bound(hist, capacity))
    if not hist or best.bins == best.bound:
        return best
    met: dict[int, tuple[int, int]] = {}  # hash of what is left: bins that led there, steps to go

    def children(left: dict[int, int], bins: int) -> Iterator[tuple[Filling, int] | None]:
        waste = (best.bins - 1 - bins) * capacity - sum(k * n for k, n in left.items())
        for filling in fillings(left, capacity, waste):
            if filling is None:
                yield None
            else:
                for c in copies(min(left[k] // n for k, n in filling)):
                    yield filling, c

    def left_of(chain: tuple | None) -> dict[int, int]:
        left = Counter(hist)
        while chain:
            chain, filling, c = chain
            for k, n in filling:
                left[k] -= n * c
        return {k: n for k, n in left.items() if n}

    steps, more = 0, True
    while more and best.bins > best.bound and best.nodes < node_limit:
        more = False  # whether some path was cut off for its steps
        # each entry: bins so far, the chain of (chain, filling, copies) that led here, steps to go, children taken, what is left with its children or None
        stack = [[0, None, steps, 0, None]]
        while stack and best.bins > best.bound and best.nodes < node_limit:
            bins, chain, to_go, taken, live = node = stack[-1]
            if to_go < 0:
                more = True
                stack.pop()
                continue
            if live is None:
                rest = left_of(chain)
                live = node[4] = rest, islice(children(rest, bins), taken, None)
            rest, todo = live
            child = next(todo, False)
            if child is False:
                stack.pop()
                continue
            best.nodes += 1
            node[3] += 1
            if child is None:
                continue
            node[2] -= 1
            filling, c = child
            left = dict(rest)
            for k, n in filling:
                left[k] -= n * c
                if not left[k]:
                    del left[k]
            bins, chain = bins + c, (chain, filling, c)
            if bins + lower_bound(left, capacity) >= best.bins:
                continue
            state = hash(frozenset(left.items()))
            if state in met and met[state][0] <= bins and met[state][1] >= to_go:
                continue
            met[state] = bins, to_go
            more_bins = best_fit_bins(left, capacity)
            if bins + more_bins < best.bins:
                best.fillings, best.bins = best_fit_decreasing(left, capacity), bins + more_bins
                while chain:
                    chain, filling, c = chain
                    best.fillings.append((filling, c))
                chain = node[1], *child
            if left:
                if len(stack) >= LIVE:
                    stack[-LIVE][4] = None
                stack.append([bins, chain, to_go, 0, (left, children(left, bins))])
        steps += 1
    best.complete = best.bins == best.bound or not more and best.nodes < node_limit
    return best


def slots(planned: list[tuple[Filling, int]]) -> dict[int, np.ndarray]:
    """For each length, rows (first rank, pieces in a bin, first bin, offset in the bin) in rank order."""
    out: dict[int, list] = defaultdict(list)
    ranks: Counter = Counter()
    bins = 0
    for filling, copies in planned:
        at = 0
        for k, n in filling:
            out[k].append((ranks[k], n, bins, at))
            ranks[k] += n * copies
            at += k * n
        bins += copies
    return {k: np.array(v, np.int64) for k, v in out.items()}


def pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = END_ID, ids: bool = False) -> DataFrame:
    """One row for each piece, with its partition and its rank among the partition's pieces of the same length."""
    end = np.uint32(end_id)
    kinds = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("part", pa.int32()), ("rank", pa.int64()), *([("ids", pa.list_(pa.int32()))] if ids else [])]
    schema = pa.schema(kinds)

    def run(batches):
        from pyspark import TaskContext

        columns, part, seen = common.encoder(vocabulary).encode_column, TaskContext.get().partitionId(), Counter()
        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            for row, flat, edge in columns(batch.column(1)):
                out = [[] for _ in kinds]
                edge = edge.tolist()
                for k in range(len(edge) - 1):
                    data = np.append(flat[edge[k] : edge[k + 1]], end)
                    for at in range(0, len(data), capacity):
                        own = data[at : at + capacity]
                        n = len(own)
                        values = [doc_ids[row + k], at // capacity, at, n, common.crc32(own), part, seen[n], *([own.astype(np.int32)] if ids else [])]
                        seen[n] += 1
                        for column, v in zip(out, values):
                            column.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema)], schema=schema)

    ddl = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, rank long" + ", ids array<int>" * ids
    return common.id_text(docs).mapInArrow(run, ddl)


def pack(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = END_ID, ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids), sequence_id, offset of every piece."""
    cut = common.materialize(pieces(docs, vocabulary, capacity, end_id, ids), "pieces")
    counts = common.materialize(cut.groupBy("part", "length").agg(F.count("*").alias("n")), "counts")
    hist = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    table = slots(plan(hist, capacity).fillings)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = cut.join(base, ["part", "length"]).withColumn("rank", F.col("rank") + F.col("base")).drop("part", "base")

    def place(batches):
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            seq, off = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for k in np.unique(length):
                rows = np.nonzero(length == k)[0]
                t = table[int(k)]
                s = t[np.searchsorted(t[:, 0], rank[rows], "right") - 1]
                local = rank[rows] - s[:, 0]
                seq[rows], off[rows] = s[:, 2] + local // s[:, 1], s[:, 3] + local % s[:, 1] * k
            keep = [n for n in batch.schema.names if n != "rank"]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in keep], pa.array(seq), pa.array(off)], names=[*keep, "sequence_id", "offset"])

    cols = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if ids else [])]
    ddl = "doc_id long, piece int, start long, length long, ids_crc32 long, " + "ids array<int>, " * ids + "sequence_id long, offset long"
    return ranked.select(*cols, "rank").mapInArrow(place, ddl)


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(common.table(spark, sf_dir, "documents"), common.vocabulary_path())
