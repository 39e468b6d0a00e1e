"""Counts of hashed keys in a table of bounded size, summed over a whole collection."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Counters, as a power of two: at least and at most. A table has one byte for each, so
#: 128 MB at most.
LEAST_BITS, MOST_BITS = 20, 27
SLICE_BITS = 16
#: Keys that a task gathers before it counts them, and different counters that it holds
#: before it sends them.
GATHERED, HELD = 1_000_000, 4_000_000
#: So many partial tables are summed by one task at once.
FAN_IN = 256
_PART = "part int, slot int, place binary, n binary"


def bits_for(keys: int) -> int:
    """Bits of a table for about so many different keys."""
    return min(max(int(keys).bit_length(), LEAST_BITS), MOST_BITS)


def level(count: np.ndarray) -> np.ndarray:
    """A count as one byte: exact up to 8, then eight steps for each doubling, to 10^10."""
    c = np.maximum(count.astype(np.float64), 1)
    up = np.floor(8 * np.log2(c / 8)) + 8
    return np.where(count <= 8, count, np.minimum(up, 255)).astype(np.uint8)


def from_level(b: np.ndarray) -> np.ndarray:
    """The least count of a level."""
    return np.where(b <= 8, b, np.ceil(8 * 2 ** ((b.astype(np.float64) - 8) / 8)))


def places(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> np.uint64(64 - bits)).astype(np.int64)


def count_keys(df: DataFrame, keys: Callable[[pa.RecordBatch], Iterator[np.ndarray]], bits: int) -> bytes:
    """One level byte for each of 2**bits counters of the keys' upper bits.

    ``keys`` gives 64-bit hashes of a batch. Each task sends only the counters it used;
    sums are made slice by slice, in rounds of at most ``FAN_IN`` tables. Sums have 64
    bits, so a count is never below the true one but for the step of its level.
    """

    def partial(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        task = context.partitionId() if context else 0
        counted = _Counted()
        for batch in it:
            for h in keys(batch):
                counted.add(places(h, bits))
                if len(counted.place) >= HELD:
                    yield _slices(counted, task)
                    counted = _Counted()
        counted.settle()
        if len(counted.place):
            yield _slices(counted, task)

    rounds = max(1, df.rdd.getNumPartitions())
    parts = df.mapInArrow(partial, _PART)
    while rounds > 1:
        rounds = -(-rounds // FAN_IN)
        parts = parts.withColumn("part", F.floor(F.col("part") / FAN_IN).cast("int"))
        parts = parts.groupBy("slot", "part").applyInArrow(_sum, _PART)
    whole = np.zeros(1 << bits, np.uint8)
    leveled = parts.groupBy("slot").applyInArrow(_leveled, "slot int, bytes binary")
    for slot, data in leveled.collect():
        whole[slot << SLICE_BITS : (slot + 1) << SLICE_BITS] = np.frombuffer(zstandard.decompress(data), np.uint8)
    return whole.tobytes()


class _Counted:
    """Sorted counters of one task, and keys that are not yet counted."""

    def __init__(self) -> None:
        self.place, self.n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.waiting: list[np.ndarray] = []
        self.size = 0

    def add(self, place: np.ndarray) -> None:
        self.waiting.append(place)
        self.size += len(place)
        if self.size >= GATHERED:
            self.settle()

    def settle(self) -> None:
        place, n = np.unique(np.concatenate([*self.waiting, self.place[:0]]), return_counts=True)
        both = np.concatenate([self.place, place])
        by = np.argsort(both, kind="stable")
        both, n = both[by], np.concatenate([self.n, n])[by]
        head = np.flatnonzero(np.diff(both, prepend=-1))
        self.place = both[head]
        self.n = np.add.reduceat(n, head) if len(head) else n
        self.waiting, self.size = [], 0


def _slices(counted: _Counted, task: int) -> pa.RecordBatch:
    slot = counted.place >> SLICE_BITS
    head = np.flatnonzero(np.diff(slot, prepend=-1))
    rows = [
        (task, int(slot[a]), *_packed(counted.place[a:b], counted.n[a:b]))
        for a, b in zip(head, np.r_[head[1:], len(slot)])
    ]
    return _rows(rows)


def _packed(place: np.ndarray, n: np.ndarray) -> tuple[bytes, bytes]:
    """Places in a slice with two bytes each, and their counts with as few as the largest needs."""
    width = next(w for w in (1, 2, 4, 8) if int(n.max(initial=0)) >> (8 * w) == 0)
    kind = np.dtype(f"u{width}")
    return (place & ((1 << SLICE_BITS) - 1)).astype(np.uint16).tobytes(), bytes([width]) + n.astype(kind).tobytes()


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    part, slot, place, n = zip(*rows) if rows else ((),) * 4
    columns = [
        pa.array(part, pa.int32()),
        pa.array(slot, pa.int32()),
        pa.array(place, pa.binary()),
        pa.array(n, pa.binary()),
    ]
    return pa.RecordBatch.from_arrays(columns, ["part", "slot", "place", "n"])


def _add(parts: pa.Table) -> np.ndarray:
    total = np.zeros(1 << SLICE_BITS, np.int64)
    for place, n in zip(parts["place"].to_pylist(), parts["n"].to_pylist()):
        # Places of one partial table differ, so this adds each of them.
        total[np.frombuffer(place, np.uint16)] += np.frombuffer(n, np.dtype(f"u{n[0]}"), offset=1).astype(np.int64)
    return total


def _sum(key: tuple, parts: pa.Table) -> pa.Table:
    total = _add(parts)
    place = np.flatnonzero(total)
    row = (key[1].as_py(), key[0].as_py(), *_packed(place, total[place]))
    return pa.Table.from_batches([_rows([row])])


def _leveled(key: tuple, parts: pa.Table) -> pa.Table:
    data = zstandard.compress(level(_add(parts)).tobytes(), 1)
    return pa.table(
        {"slot": pa.array([key[0].as_py()], pa.int32()), "bytes": pa.array([data], pa.binary())}
    )
