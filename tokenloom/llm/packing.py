"""Problem 7: fill containers of fixed capacity with items, with little space left.

Only the histogram of the sizes, one number for each size up to the capacity, is planned
with. Shallow combinations of sizes that fill a window exactly or nearly (the capacity,
its half, quarter and so on; windows are joined to containers) are the columns of a
non-negative least squares problem, whose solution says how often to repeat each of them.
Rounded, as far as there are items, they use up most; the rest is packed best fit, largest first, again on
the histogram. The items then find their places by their rank among those of one size,
which is counted in salted groups, so that no size has to fit into one task.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tokenloom.llm.bpe import VOCAB, token_counts
from tokenloom.llm.common import cut, parts

CAPACITY = 2048
#: Combinations have up to so many sizes, and leave at most this part of a window free.
DEPTH, SLACK = 3, 1 / 256
#: Windows are the capacity halved up to so many times.
HALVINGS = 3
SWEEPS = 60
#: A combination to be repeated less often than this is not used.
NEARLY_NONE = 0.05


class Group(NamedTuple):
    """``count`` containers that hold items of the same sizes."""

    sizes: tuple[int, ...]
    count: int


def combinations(sizes: list[int], window: int) -> Iterator[tuple[int, ...]]:
    """Up to ``DEPTH`` sizes, largest first, that fill the window but for the slack."""
    have = sorted(s for s in sizes if 0 < s <= window)
    known = np.zeros(window + 1, bool)
    known[have] = True
    free = int(window * SLACK)
    near = lambda rest: next((k for k in range(rest, max(rest - free, 0) - 1, -1) if k and known[k]), 0)
    for a in have:
        if a >= window - free:
            yield (a,)
        b = near(window - a)
        if b and b <= a:
            yield (a, b)
    if DEPTH < 3:
        return
    step = max(1, len(have) // 96)
    for a in have[::step]:
        for b in have[:: max(1, step // 2)]:
            c = near(window - a - b) if b <= a and a + b < window else 0
            if c and c <= b:
                yield (a, b, c)


def solve(columns: list[Counter], histogram: np.ndarray) -> np.ndarray:
    """Repeat counts x >= 0 that make the sum of x times the columns nearest to the
    histogram, by coordinate descent; long sizes weigh more, for they are harder to place."""
    weight = 1 + np.arange(len(histogram)) / len(histogram)
    rest = (histogram * weight).astype(float).tolist()
    w = weight.tolist()
    x = [0.0] * len(columns)
    sides = [[(s, n * w[s]) for s, n in c.items()] for c in columns]
    norms = [sum(v * v for _, v in side) for side in sides]
    for _ in range(SWEEPS):
        moved = 0.0
        for k, side in enumerate(sides):
            step = sum(v * rest[s] for s, v in side) / norms[k]
            step = max(step, -x[k])
            if step:
                x[k] += step
                moved += abs(step)
                for s, v in side:
                    rest[s] -= step * v
        if moved < 1e-6 * (1 + sum(x)):
            break
    return np.array(x)


def plan(histogram: np.ndarray, capacity: int = CAPACITY) -> list[Group]:
    """Containers for all items of a histogram of sizes 0 to ``capacity``.

    Sizes of 0 and of the whole capacity are not planned here. Its cost depends on the
    capacity alone.
    """
    left = histogram.astype(np.int64).copy()
    left[0] = left[capacity] = 0
    filled: list[tuple[tuple[int, ...], int, int]] = []
    sizes = np.flatnonzero(left).tolist()
    columns, windows = [], []
    for halving in range(HALVINGS + 1):
        window = capacity >> halving
        if window:
            for c in dict.fromkeys(combinations(sizes, window)):
                columns.append(Counter(c))
                windows.append(window)
    if columns:
        repeats = np.ceil(solve(columns, left) - NEARLY_NONE).astype(np.int64)
        for k in np.lexsort((-repeats, [-w for w in windows])).tolist():
            most = min(int(left[s]) // n for s, n in columns[k].items())
            n = min(int(repeats[k]), most)
            if n > 0:
                for s, m in columns[k].items():
                    left[s] -= n * m
                filled.append((tuple(sorted(columns[k].elements(), reverse=True)), n, windows[k]))
    return _greedy(_joined(filled, capacity), left, capacity)


def _joined(filled: list[tuple[tuple[int, ...], int, int]], capacity: int) -> list[Group]:
    """Filled windows side by side in containers, wide ones first."""
    whole: list[Group] = []
    single: list[tuple[tuple[int, ...], int]] = []
    for sizes, count, window in sorted(filled, key=lambda f: -f[2]):
        each = capacity // window
        if count // each:
            whole.append(Group(sizes * each, count // each))
        single += [(sizes, window)] * (count % each)
    mine, room = (), capacity
    for sizes, window in single:
        if window > room:
            whole.append(Group(mine, 1))
            mine, room = (), capacity
        mine, room = mine + sizes, room - window
    return whole + [Group(mine, 1)] * bool(mine)


def _greedy(groups: list[Group], left: np.ndarray, capacity: int) -> list[Group]:
    """Best fit, largest first, for many equal items and containers at a time."""
    free: dict[int, list[Group]] = defaultdict(list)
    for g in groups:
        free[capacity - sum(g.sizes)].append(g)
    for size in range(capacity, 0, -1):
        n = int(left[size])
        while n:
            room = next((r for r in range(size, capacity) if free.get(r)), None)
            if room is None:
                each = min(n, capacity // size)
                count = n // each
                free[capacity - each * size].append(Group((size,) * each, count))
                n -= each * count
                continue
            g = free[room].pop()
            each = min(room // size, n)
            count = min(g.count, n // each)
            if count < g.count:
                free[room].append(Group(g.sizes, g.count - count))
            free[room - each * size].append(Group(g.sizes + (size,) * each, count))
            n -= each * count
    return [g for held in free.values() for g in held]


class Places:
    """For an item's size and its rank among the items of that size, its container."""

    def __init__(self, groups: list[Group], capacity: int) -> None:
        size, count, each, base = [], [], [], []
        self.containers = 0
        for g in groups:
            for s, m in Counter(g.sizes).items():
                size.append(s)
                count.append(g.count * m)
                each.append(m)
                base.append(self.containers)
            self.containers += g.count
        by = np.argsort(size, kind="stable")
        size, count, each, base = (np.array(v, np.int64)[by] for v in (size, count, each, base))
        start = np.cumsum(count) - count
        first = np.searchsorted(size, np.arange(capacity + 2))
        self.of_size = np.r_[start, count.sum()][first]
        self.start, self.each, self.base = start, each, base

    def container(self, size: np.ndarray, rank: np.ndarray) -> np.ndarray:
        at = self.of_size[size] + rank
        k = np.searchsorted(self.start, at, side="right") - 1
        return self.base[k] + (at - self.start[k]) // self.each[k]


def pack(sizes: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``container, doc_id, piece, start, n_tokens`` for items ``doc_id, n_tokens``.

    An item above the capacity is split: its full pieces fill a container each, and what is
    left is packed like a small item. Items of size 0 take no space and are spread over all
    containers; if there are no others, they share container 0. Null sizes count as 0.
    Repeated rows are items of their own. An empty table gives no rows.
    """
    groups = parts(sizes.sparkSession)
    n = F.greatest(F.coalesce(F.col("n_tokens"), F.lit(0)), F.lit(0)).cast("long")
    last = F.greatest(F.ceil(F.col("n") / capacity) - 1, F.lit(0))
    salt = F.pmod(F.xxhash64("doc_id", "row"), F.lit(groups))
    items = cut(
        sizes.select("doc_id", n.alias("n"), F.monotonically_increasing_id().alias("row"))
        .select("doc_id", "row", "n", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("piece"))
        .withColumn("start", F.col("piece") * capacity)
        .withColumn("size", F.least(F.col("n") - F.col("start"), F.lit(capacity)))
        .withColumn("salt", salt)
    )
    counts = items.groupBy("size", "salt").agg(F.count("*").alias("many"))
    before = F.coalesce(
        F.sum("many").over(
            W.partitionBy("size").orderBy("salt").rowsBetween(W.unboundedPreceding, -1)
        ),
        F.lit(0),
    )
    offsets = counts.select("size", "salt", before.alias("before"))
    histogram = np.zeros(capacity + 1, np.int64)
    for size, many in counts.groupBy("size").agg(F.sum("many")).collect():
        histogram[size] = many
    places = Places(plan(histogram, capacity), capacity)
    full, planned = int(histogram[capacity]), places.containers
    rank = F.row_number().over(W.partitionBy("size", "salt").orderBy("row", "piece")) - 1
    ranked = items.withColumn("rank", rank).join(offsets, ["size", "salt"])
    ranked = ranked.select(
        "doc_id", "piece", "start", "size", (F.col("rank") + F.col("before")).alias("rank")
    )
    shared = sizes.sparkSession.sparkContext.broadcast(places)

    def place(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in it:
            size, r = batch.column(3).to_numpy(), batch.column(4).to_numpy()
            out = np.where(size == capacity, planned + r, r % max(1, planned + full))
            some = (size > 0) & (size < capacity)
            out[some] = known.container(size[some], r[some])
            yield pa.RecordBatch.from_arrays(
                [pa.array(out), batch.column(0), batch.column(1), batch.column(2), batch.column(3)],
                ["container", "doc_id", "piece", "start", "n_tokens"],
            )

    return ranked.mapInArrow(
        place, "container bigint, doc_id bigint, piece bigint, start bigint, n_tokens bigint"
    )


def pack_documents(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = CAPACITY,
    path: str = VOCAB,
) -> DataFrame:
    """The containers of the texts of ``df``, sized in tokens of the vocabulary at ``path``."""
    return pack(token_counts(df, id_col, text_col, path), capacity)


def placed(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``doc_id, placed``: whether the pieces of an item follow each other without a gap, all
    but the last full, and lie in containers that hold no more than their capacity. Items of
    one id count together."""
    loads = packed.groupBy("container").agg((F.sum("n_tokens") <= capacity).alias("fits"))
    ordered = packed.join(loads, "container").groupBy("doc_id").agg(
        F.min("fits").alias("fits"),
        F.countDistinct("piece").alias("n"),
        F.max("piece").alias("last"),
        F.min((F.col("start") == F.col("piece") * capacity) & (F.col("n_tokens") <= capacity)).alias("at"),
        F.sum(F.when(F.col("n_tokens") == capacity, 1).otherwise(0)).alias("full"),
    )
    whole = F.col("fits") & F.col("at") & (F.col("n") == F.col("last") + 1) & (F.col("full") >= F.col("last"))
    return ordered.select("doc_id", whole.alias("placed"))
