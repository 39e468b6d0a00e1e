"""Problem 5: records that share most of their runs of words.

The records and their distinct runs of words form a sparse 0/1 matrix M, and the overlap
of two records is an entry of M times its transpose. Records of equal runs form one class
and one row. The product is made in blocks of columns, over the rare columns only: with
columns in one order from rare to common, two rows that are similar enough must meet in
the first columns of both, the number of which follows from their sizes. Each block adds
up overlaps and places; a pair goes when its sizes, or the overlap that is still possible
behind the last common column, rule it out. Parity bitmaps of the rows rule out most of
the rest, without losing a pair, and the pairs left are compared exactly on their texts.
Short bitmaps travel with the entries and are compared inside a block, as the rows that
meet in a column grow as the square of its length: only what passes is shuffled.

The order comes from counts of all runs in all records, in a table whose size follows
the input up to a bound (``sketch``); it decides only how many pairs are looked at, never
which are found.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenloom.llm import sketch
from tokenloom.llm.common import cut, id_text, parts
from tokenloom.llm.words import chunks, mix, runs, words
from tokenloom.sources.shared import Steps, release

WORDS, SHARE, LEAST_WORDS = 3, 60, 20
#: Entries of one block of columns, and of one task's blobs before they are sent.
BLOCK_ENTRIES = 2_000_000
#: Up to so many blocks have a task each; more share tasks and come one after the other.
MOST_TASKS = 20_000
#: A column in more records than this is cut into groups whose pairs are separate blocks.
HOT = 8_192
#: More blocks than this are made in ``ROUNDS`` rounds of a scan of the texts each, so that the
#: entries of one round only are on disk at once.
ROUND_BLOCKS, ROUNDS = 50, 2
#: Different runs that a record adds, for the size of the table of counts.
NEW_RUNS = 64
#: Up to this many records of one text, byte by byte, are written out in pairs; of more
#: copies each is paired with the first one only, which stands for the text elsewhere.
EXPAND = 64
#: Records of a class in one list; a larger class is paired list by list, in many tasks.
LIST = 512
#: Least bits of a row's parity bitmap.
SIG_BITS = 128
#: Rows up to these sizes have 128 and 256 bits beside their entries. For longer rows so few
#: bits would tell nothing.
NARROW, WIDE = 85, 256
_BLOB = "block bigint, blob binary"
#: ``sizes`` and ``last`` (places of the last common column) hold two numbers of 32 bits.
_SHORT = "a bigint, b bigint, sizes bigint, hits bigint, last bigint"
_LOW = 0xFFFFFFFF
_U = np.uint64


class Rows:
    """The matrix rows of some texts: for each text its distinct runs, in order."""

    def __init__(self, texts: list[str], n: int, least: int) -> None:
        w = words(texts)
        total = np.bincount(w.doc, minlength=len(texts))
        at, h = runs(w, n)
        doc = w.doc[at]
        ok = total[doc] >= least
        doc, h = doc[ok], h[ok]
        order = by_document(doc, h, len(texts))
        doc, h = doc[order], h[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
        self.doc, self.h = doc[new], h[new]
        self.first = np.flatnonzero(np.diff(self.doc, prepend=-1))
        self.docs = self.doc[self.first]
        self.size = np.diff(np.r_[self.first, len(self.h)])

    def classes(self) -> np.ndarray:
        """One number for each text, equal for equal sets of runs."""
        if not len(self.docs):
            return np.zeros(0, np.int64)
        total = np.add.reduceat(mix(self.h), self.first)
        return mix(total + self.size.astype(np.uint64)).view(np.int64)

    def signatures(self) -> list[bytes]:
        """Parity of the runs that fall on each bit of a bitmap: ``SIG_BITS`` bits or the
        power of two from 1.5 times the size. A longer one folds to a shorter one."""
        bits = np.maximum(SIG_BITS, 1 << np.ceil(np.log2(1.5 * self.size)).astype(np.int64))
        row = np.repeat(np.arange(len(self.docs)), self.size)
        bit = (mix(self.h ^ _U(0x5851F42D4C957F2D)) & (bits - 1).astype(np.uint64)[row]).astype(np.int64)
        start = np.cumsum(bits) - bits
        flat = np.bincount(start[row] + bit, minlength=int(bits.sum()))
        packed = np.packbits((flat & 1).astype(np.uint8), bitorder="little")
        return [packed[a : a + n].tobytes() for a, n in zip(start // 8, bits // 8)]

    def short_bits(self) -> np.ndarray:
        """Four words of 64 bits for each text: the parity of the runs on 128 bits up to
        ``NARROW`` runs, on 256 up to ``WIDE``, and zeros beyond."""
        docs = len(self.docs)
        row = np.repeat(np.arange(docs), self.size)
        few = (self.size <= WIDE)[row]
        row = row[few]
        mask = np.where(self.size <= NARROW, 127, 255).astype(np.uint64)[row]
        bit = (mix(self.h[few] ^ _U(0x5851F42D4C957F2D)) & mask).astype(np.int64)
        odd = (np.bincount(row * 256 + bit, minlength=docs * 256) & 1).astype(np.uint8)
        return np.packbits(odd, bitorder="little").view(np.uint64).reshape(docs, 4)


def by_document(doc: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    """An order by document and hash. One number holds both, the document in the upper bits,
    which sorts many times as fast as two; where it is too short for two hashes of one
    document, both are sorted."""
    bits = _U(max(int(n).bit_length(), 1))
    key = (doc.astype(np.uint64) << (_U(64) - bits)) | (h >> bits)
    order = np.argsort(key)
    same = np.flatnonzero(key[order[1:]] == key[order[:-1]])
    if (h[order[same]] != h[order[same + 1]]).any():
        return np.lexsort((h, doc))
    return order


def differing(x: list[bytes], y: list[bytes]) -> np.ndarray:
    """Bits in which the two signatures of each pair differ: the sizes of the two sets less
    twice their overlap are at least that many."""
    out = np.zeros(len(x), np.int64)
    size = np.array([[len(s), len(t)] for s, t in zip(x, y)]).reshape(-1, 2)
    kinds, kind = np.unique(size, axis=0, return_inverse=True)
    for k, (a, b) in enumerate(kinds.tolist()):
        at = np.flatnonzero(kind.ravel() == k)
        s, t = (
            np.bitwise_xor.reduce(
                np.frombuffer(b"".join([z[j] for j in at]), np.uint8).reshape(len(at), -1, min(a, b)),
                axis=1,
            )
            for z in (x, y)
        )
        out[at] = np.bitwise_count(s ^ t).sum(axis=1)
    return out


def need(size: np.ndarray, share: int, half: bool = False) -> np.ndarray:
    """Least overlap with any row (``half``: with a row at least as large)."""
    if half:
        return -(-2 * share * size // (100 + share))
    return -(-share * size // 100)


def near_duplicates(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    n: int = WORDS,
    share: int = SHARE,
    least: int = LEAST_WORDS,
) -> tuple[DataFrame, DataFrame]:
    """Pairs of similar classes ``a, b`` and the members ``class, copy, doc_id`` of all classes.

    Two records belong together if of the distinct runs of ``n`` words found in either at
    least ``share`` percent are found in both, and both have ``least`` words or more. A
    class holds the records of equal runs, a copy those of equal texts. Every record with
    enough words is a member of one class, also without a partner. Null and shorter texts
    and rows without an id have none; deliveries of one record count once.
    """
    rows = id_text(df, id_col, text_col).filter("id is not null and text is not null")
    rows = rows.filter(F.length("text") >= 2 * least - 1)

    def keys(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        texts = batch.column(1).to_pylist()
        for a, b in chunks(texts):
            r = Rows(texts[a:b], n, least)
            known = r.classes()
            once = np.zeros(len(r.docs), bool)
            once[np.unique(known, return_index=True)[1]] = True
            yield r.h[np.repeat(once, r.size)]

    counts = sketch.count_keys(rows, keys, sketch.bits_for(NEW_RUNS * df.count()))
    packed = zstandard.compress(counts, 1)
    table = rows.sparkSession.sparkContext.broadcast((hashlib.sha1(packed).hexdigest(), packed))
    levels = np.frombuffer(counts, np.uint8)
    counted = np.bincount(levels, minlength=256) @ sketch.from_level(np.arange(256))
    entries = float(counted) * (100 - share) / 100
    blocks = max(parts(df.sparkSession), int(entries / BLOCK_ENTRIES))
    rounds = ROUNDS if blocks > ROUND_BLOCKS else 1
    release(df.sparkSession)

    def scatter(now: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def of(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            order = _unpacked(table.value)
            held = _Held(blocks, rounds, now)
            for batch in it:
                texts = batch.column(1).to_pylist()
                for a, b in chunks(texts):
                    held.add(Rows(texts[a:b], n, least), order, share)
                    if held.size >= BLOCK_ENTRIES:
                        yield from held.blobs()
            yield from held.blobs()

        return of

    def multiply(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The blobs of a block follow each other, so one block at a time is in memory.
        now, mine = None, []
        for batch in it:
            for block, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if block != now and mine:
                    yield from product(mine, share)
                    mine = []
                now = block
                mine.append(blob)
        if mine:
            yield from product(mine, share)

    def met(now: int) -> DataFrame:
        """The pairs of the blocks of one round."""
        blobs = rows.mapInArrow(scatter(now), _BLOB)
        own = -(-(blocks - now) // rounds)
        tasks = min(own, MOST_TASKS)
        at = F.floor(F.col("block") / rounds)
        placed = blobs.repartitionById(tasks, F.pmod(at, F.lit(tasks)).cast("int"))
        if own > tasks:
            placed = placed.sortWithinPartitions("block")
        return added(placed.mapInArrow(multiply, _SHORT))

    def added(partial: DataFrame) -> DataFrame:
        # Two blocks hardly ever share a task, so sums before the shuffle would save nothing; by
        # the first row alone, the pairs are already where the next join wants them.
        return partial.repartition(parts(df.sparkSession), "a").groupBy("a", "b", "sizes").agg(
            F.sum("hits").alias("hits"), F.max("last").alias("last")
        )

    steps = Steps(df.sparkSession, "neardup") if rounds > 1 else None
    if steps:
        pieces = []
        for now in range(rounds):
            pieces.append(steps.keep(f"pairs-{now}", met(now)))
            release(df.sparkSession)
        summed = added(reduce(DataFrame.unionAll, pieces))
    else:
        summed = met(0)
    behind = [F.col("sizes") - F.col("last"), F.col("sizes").bitwiseAND(_LOW) - F.col("last").bitwiseAND(_LOW)]
    both = F.shiftright("sizes", 32) + F.col("sizes").bitwiseAND(_LOW)
    possible = F.col("hits") - 1 + F.least(F.shiftright(behind[0] - behind[1], 32), behind[1])
    summed = summed.filter(possible * (100 + share) >= both * share).select("a", "b", both.alias("both"))

    def sign(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            ids, texts, copies = batch.column(0).to_numpy(), batch.column(1).to_pylist(), batch.column(2)
            for a, b in chunks(texts):
                r = Rows(texts[a:b], n, least)
                if len(r.docs):
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(r.classes()),
                            pa.array(ids[a:b][r.docs]),
                            pa.array(r.signatures(), pa.binary()),
                            copies[a:b].take(pa.array(r.docs)),
                        ],
                        ["class", "id", "bits", "copy"],
                    )

    hashed = rows.withColumn("copy", F.xxhash64("text"))
    signed = cut(hashed.mapInArrow(sign, "class bigint, id bigint, bits binary, copy bigint"))
    one = signed.groupBy("class").agg(F.first("bits").alias("bits"))
    kept = summed
    for side in "ab":
        mine = one.select(F.col("class").alias(side), F.col("bits").alias(f"bits_{side}"))
        kept = kept.join(mine, side)

    def sift(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            both = batch.column(2).to_numpy()
            overlap = both - differing(batch.column(3).to_pylist(), batch.column(4).to_pylist())
            ok = overlap * (100 + share) >= 2 * share * both
            yield batch.select(["a", "b"]).filter(pa.array(ok))

    fields = ["a", "b", "both", "bits_a", "bits_b"]
    kept = kept.select(*fields).mapInArrow(sift, "a bigint, b bigint")
    heads = signed.groupBy("class").agg(F.min("id").alias("id"))
    for side in "ab":
        kept = kept.join(heads.select(F.col("class").alias(side), F.col("id").alias(f"id_{side}")), side)
    kept = cut(kept.select("a", "b", "id_a", "id_b"))
    if steps:
        steps.close()
    release(df.sparkSession)
    return _compared(kept, rows, n, share, least), signed.select("class", "copy", F.col("id").alias("doc_id"))


_TABLES: dict[str, np.ndarray] = {}


def _unpacked(named: tuple[str, bytes]) -> np.ndarray:
    """The table of counts in a worker, which unpacks it once."""
    name, packed = named
    if name not in _TABLES:
        _TABLES.clear()
        _TABLES[name] = np.frombuffer(zstandard.decompress(packed), np.uint8)
    return _TABLES[name]


class _Held:
    """Entries of the blocks of one task, of one round: of those whose number leaves ``now``."""

    def __init__(self, blocks: int, rounds: int = 1, now: int = 0) -> None:
        self.blocks, self.rounds, self.now = blocks, rounds, now
        self.size, self.parts, self.seen = 0, [], 0
        self.known: list[np.ndarray] = []
        self.sizes: list[np.ndarray] = []
        self.bits: list[np.ndarray] = []

    def add(self, r: Rows, order: np.ndarray, share: int) -> None:
        if not len(r.docs):
            return
        low = order[sketch.places(r.h, len(order).bit_length() - 1)]
        column = (low.astype(np.uint64) << _U(56)) | (r.h & _U((1 << 56) - 1))
        row = np.repeat(np.arange(len(r.docs)), r.size)
        by = by_document(row, column, len(r.docs))
        column, low = column[by], low[by]
        place = np.arange(len(by)) - np.repeat(r.first, r.size)
        reach = (r.size - need(r.size, share) + 1)[row]
        ok = (place < reach) & (low > 1)
        column, low, row, place = column[ok], low[ok], row[ok], place[ok]
        groups = np.maximum(1, np.ceil(sketch.from_level(low) / HOT)).astype(np.int64)
        side = np.zeros(len(column), np.uint8)
        hot = groups > 1
        if hot.any():
            column, row, place, side = _grouped(column, row, place, groups, hot, r.classes())
        spread = mix(column)
        if self.rounds > 1:
            own = spread % _U(self.blocks) % _U(self.rounds) == _U(self.now)
            spread, row, place, side = spread[own], row[own], place[own], side[own]
        self.parts.append((spread, row + self.seen, place, side))
        self.known.append(r.classes())
        self.sizes.append(r.size)
        self.bits.append(r.short_bits())
        self.seen += len(r.docs)
        self.size += len(spread)

    def blobs(self) -> Iterator[pa.RecordBatch]:
        if not self.size:
            return
        spread, row, place, side = (np.concatenate(x) for x in zip(*self.parts))
        known, sizes, bits = (np.concatenate(x) for x in (self.known, self.sizes, self.bits))
        block = (spread % _U(self.blocks)).astype(np.int64)
        name = ((spread // _U(self.blocks)) & _U(0xFFFFFFFF)).astype(np.uint32)
        by = np.argsort((block.astype(np.uint64) << _U(32)) | name)
        edge = np.flatnonzero(np.diff(block[by], prepend=-1, append=-2))
        compress = zstandard.ZstdCompressor(level=1)
        for a, b in zip(edge, edge[1:]):
            mine = by[a:b]
            rows, local = np.unique(row[mine], return_inverse=True)
            narrow, wide = rows[sizes[rows] <= WIDE], rows[_is_wide(sizes[rows])]
            blob = pack(
                [
                    known[rows],
                    sizes[rows].astype(np.uint32),
                    name[mine],
                    local.astype(np.uint32),
                    place[mine].astype(np.uint32),
                    side[mine],
                    bits[narrow, :2].ravel(),
                    bits[wide, 2:].ravel(),
                ],
                compress,
            )
            yield pa.RecordBatch.from_arrays(
                [pa.array([block[mine[0]]], pa.int64()), pa.array([blob], pa.binary())],
                ["block", "blob"],
            )
        self.__init__(self.blocks, self.rounds, self.now)


def _is_wide(size: np.ndarray) -> np.ndarray:
    return (size > NARROW) & (size <= WIDE)


def _grouped(
    column: np.ndarray,
    row: np.ndarray,
    place: np.ndarray,
    groups: np.ndarray,
    hot: np.ndarray,
    known: np.ndarray,
) -> tuple[np.ndarray, ...]:
    """Hot columns as one column for each pair of groups of rows; a row goes to all pairs
    that hold its group. Side 1 and 2 are the two groups of a pair, 0 is one with itself."""
    out = [(column[~hot], row[~hot], place[~hot], np.zeros((~hot).sum(), np.uint8))]
    for g in np.unique(groups[hot]):
        of = np.flatnonzero(groups == g)
        mine = (mix(known[row[of]].view(np.uint64)) % _U(g)).astype(np.int64)
        for other in range(g):
            low, high = np.minimum(mine, other), np.maximum(mine, other)
            pair = (low * g + high + 1).astype(np.uint64)
            side = np.where(mine == other, 0, np.where(mine < other, 1, 2)).astype(np.uint8)
            out.append((mix(column[of] + mix(pair)), row[of], place[of], side))
    return tuple(np.concatenate(x) for x in zip(*out))


def pack(arrays: list[np.ndarray], compress: zstandard.ZstdCompressor) -> bytes:
    """Arrays as bytes, plane by plane, so that their zero bytes cost nothing."""
    body = b"".join(x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes() for x in arrays)
    return np.array([len(x) for x in arrays], np.int64).tobytes() + compress.compress(body)


_TYPES = (np.int64, np.uint32, np.uint32, np.uint32, np.uint32, np.uint8, np.uint64, np.uint64)


def unpack(blob: bytes) -> list[np.ndarray]:
    lengths = np.frombuffer(blob[: 8 * len(_TYPES)], np.int64)
    body = np.frombuffer(zstandard.decompress(blob[8 * len(_TYPES) :]), np.uint8)
    out, at = [], 0
    for size, kind in zip(lengths, _TYPES):
        width = np.dtype(kind).itemsize
        planes = body[at : at + size * width].reshape(width, size)
        out.append(np.ascontiguousarray(planes.T).view(kind).ravel())
        at += size * width
    return out


def product(blobs: list[bytes], share: int) -> Iterator[pa.RecordBatch]:
    """Pairs of rows that meet in a block of columns, with overlap and last place there.

    Common columns have the same order in both rows, so the last one is last in both. The
    bits of a row are the same in all blocks, so a pair that they rule out is in none.
    """
    known, size, name, local, place, side, bits, seen = [], [], [], [], [], [], [], 0
    for k, s, c, r, p, d, low, high in map(unpack, blobs):
        known.append(k)
        size.append(s.astype(np.int64))
        name.append(c)
        local.append(r.astype(np.int64) + seen)
        place.append(p.astype(np.int64))
        side.append(d)
        bits.append(np.zeros((len(k), 4), np.uint64))
        bits[-1][s <= WIDE, :2] = low.reshape(-1, 2)
        bits[-1][_is_wide(s), 2:] = high.reshape(-1, 2)
        seen += len(k)
    known, size, bits = np.concatenate(known), np.concatenate(size), np.concatenate(bits)
    name, local, place, side = (np.concatenate(x) for x in (name, local, place, side))
    _, same = np.unique(known, return_inverse=True)
    first = np.zeros(same.max() + 1, np.int64)
    first[same] = np.arange(len(same))
    local = first[same][local]
    n = size[local]
    # One order of two rows in all blocks, also where their sizes are equal; places among
    # the sorted classes stand for the classes.
    by = np.lexsort(((same[local] << 2) | side, (name.astype(np.uint64) << _U(32)) | n.astype(np.uint64)))
    name, local, place, side, n = name[by], local[by], place[by], side[by], n[by]
    new = np.ones(len(name), bool)
    new[1:] = (name[1:] != name[:-1]) | (local[1:] != local[:-1]) | (side[1:] != side[:-1])
    name, local, place, side, n = name[new], local[new], place[new], side[new], n[new]
    reach = n - need(n, share, half=True) + 1
    end = np.searchsorted(name, name, side="right")
    starts = np.flatnonzero((place < reach) & (np.arange(len(name)) + 1 < end))
    # Rows come by size within a column, so those small enough end at one place.
    top = _ends(name, n, n * 100 // share, end)
    width = np.maximum(top[starts] - starts - 1, 0)
    starts, width = starts[width > 0], width[width > 0]
    # All bits folded to 128. A row without bits is never ruled out: it is the larger one of
    # its pair, or both have none, and counts as so large that any difference is allowed.
    folded = [(bits[:, k] ^ bits[:, k + 2])[local] for k in range(2)]
    allowed = np.where(n <= WIDE, n, 1 << 20).astype(np.int32)
    done = 0
    while done < len(starts):
        total = np.cumsum(width[done:])
        step = max(1, int(np.searchsorted(total, BLOCK_ENTRIES, side="right")))
        own, times = starts[done : done + step], width[done : done + step]
        j = np.arange(int(times.sum())) + np.repeat(own + 1 - (total[:step] - times), times)
        done += step
        far = sum(np.bitwise_count(np.repeat(f[own], times) ^ f[j]) for f in folded)
        both = np.repeat(allowed[own], times) + allowed[j]
        near = np.flatnonzero(far.astype(np.int32) * (100 + share) <= both * (100 - share))
        i, j = np.repeat(own, times)[near], j[near]
        wide = _is_wide(n[i]) & _is_wide(n[j])
        far = np.bitwise_count(bits[local[i]] ^ bits[local[j]]).sum(axis=1, dtype=np.int64)
        ok = ~wide | (far * (100 + share) <= (n[i] + n[j]) * (100 - share))
        i, j = i[ok], j[ok]
        ok = (side[i] == 0) & (side[j] == 0) | (side[i] != side[j])
        ok &= local[i] != local[j]
        left = np.minimum(n[i] - place[i], n[j] - place[j]) + np.minimum(place[i], place[j])
        ok &= left * (100 + share) >= share * (n[i] + n[j])
        i, j = i[ok], j[ok]
        if len(i):
            yield _pairs(known, local, n, place, i, j)


def _ends(name: np.ndarray, n: np.ndarray, most: np.ndarray, end: np.ndarray) -> np.ndarray:
    """For each entry the first one of its column whose row is larger than ``most``."""
    column = np.cumsum(np.diff(name.astype(np.int64), prepend=-1) != 0)
    width = int(max(n.max(), most.max())) + 2
    return np.minimum(np.searchsorted(column * width + n, column * width + most, side="right"), end)


def _pairs(
    known: np.ndarray, local: np.ndarray, n: np.ndarray, place: np.ndarray, i: np.ndarray, j: np.ndarray
) -> pa.RecordBatch:
    swap = known[local[i]] > known[local[j]]
    i, j = np.where(swap, j, i), np.where(swap, i, j)
    by = np.lexsort((local[j], local[i]))
    i, j = i[by], j[by]
    new = np.r_[True, (local[i][1:] != local[i][:-1]) | (local[j][1:] != local[j][:-1])]
    head = np.flatnonzero(new)
    hits = np.diff(np.r_[head, len(i)])
    last = np.maximum.reduceat((place[i] << 32) | place[j], head)
    columns = [
        known[local[i[head]]],
        known[local[j[head]]],
        (n[i[head]] << 32) | n[j[head]],
        hits.astype(np.int64),
        last,
    ]
    return pa.RecordBatch.from_arrays(list(map(pa.array, columns)), ["a", "b", "sizes", "hits", "last"])


def _compared(kept: DataFrame, rows: DataFrame, n: int, share: int, least: int) -> DataFrame:
    """The pairs whose texts really are similar.

    Only texts of some pair are moved. They are picked through a bit table over their ids,
    of 16 bits for each pair and 16 MB at most, which may let others pass but none of them
    be lost.
    """
    ids = kept.select(F.explode(F.array("id_a", "id_b")).alias("id"))
    bits = sketch.bits_for(16 * kept.count())
    wanted = kept.sparkSession.sparkContext.broadcast(_bit_table(ids, bits))

    def pick(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(wanted.value, np.uint8)
        for batch in it:
            h = _place(batch.column(0).to_numpy(), bits)
            yield batch.filter(pa.array((table[h >> 3] >> (h & 7) & 1).astype(bool)))

    texts = rows.mapInArrow(pick, "id bigint, text string")
    both = kept
    for side in "ab":
        mine = texts.select(F.col("id").alias(f"id_{side}"), F.col("text").alias(f"text_{side}"))
        both = both.join(mine, f"id_{side}")

    def compare(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            x, y = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            ok = np.zeros(len(x), bool)
            for a, b in chunks([s + t for s, t in zip(x, y)]):
                ok[a:b] = similar(x[a:b], y[a:b], n, share, least)
            yield batch.select(["a", "b"]).filter(pa.array(ok))

    pairs = both.select("a", "b", "text_a", "text_b").mapInArrow(compare, "a bigint, b bigint")
    return pairs.distinct()


def similar(x: list[str], y: list[str], n: int, share: int, least: int) -> np.ndarray:
    """For each pair of texts whether it reaches the share, exactly."""
    r, s = Rows(x, n, least), Rows(y, n, least)
    doc, h = np.r_[r.doc, s.doc], np.r_[r.h, s.h]
    by = by_document(doc, h, len(x))
    doc, h = doc[by], h[by]
    twice = doc[1:][(h[1:] == h[:-1]) & (doc[1:] == doc[:-1])]
    both = np.bincount(twice, minlength=len(x))
    size = np.bincount(doc, minlength=len(x))
    return (both > 0) & (100 * both >= share * (size - both))


def _place(ids: np.ndarray, bits: int) -> np.ndarray:
    return sketch.places(mix(ids.astype(np.int64).view(np.uint64)), bits)


def _bit_table(ids: DataFrame, size: int) -> bytes:
    """2**size bits, set at the hashes of the ids."""

    def places(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << size, bool)
        for batch in it:
            bits[_place(batch.column(0).to_numpy(), size)] = True
        for slot, part in enumerate(bits.reshape(-1, 1 << sketch.SLICE_BITS)):
            if part.any():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([slot], pa.int32()), pa.array([np.packbits(part, bitorder="little").tobytes()])],
                    ["slot", "bits"],
                )

    def union(key: tuple, of: pa.Table) -> pa.Table:
        bits = of["bits"].to_pylist()
        total = np.frombuffer(bits[0], np.uint8).copy()
        for more in bits[1:]:
            total |= np.frombuffer(more, np.uint8)
        return pa.table({"slot": pa.array([key[0].as_py()], pa.int32()), "bits": pa.array([total.tobytes()])})

    kind = "slot int, bits binary"
    whole = np.zeros((1 << size) // 8, np.uint8)
    width = (1 << sketch.SLICE_BITS) // 8
    for slot, bits in ids.mapInArrow(places, kind).groupBy("slot").applyInArrow(union, kind).collect():
        whole[slot * width : (slot + 1) * width] = np.frombuffer(bits, np.uint8)
    return whole.tobytes()


def near_duplicate_pairs(df: DataFrame, expand: int | None = EXPAND, **options: object) -> DataFrame:
    """``doc_id_a, doc_id_b``, a < b, of similar records.

    All pairs between different texts come out, also where their runs are equal. Only of
    more than ``expand`` records with the very same text each is paired with the first one
    alone, which stands for them in all other pairs, so the rows do not grow as the square
    of the copies. With ``None`` all pairs of copies come out too.
    """
    pairs, members = near_duplicates(df, **options)
    members = members.distinct()
    copies = members.groupBy("class", "copy").agg(F.count("*").alias("n"), F.min("doc_id").alias("head"))
    starred = F.lit(False) if expand is None else F.col("n") > expand
    inside = members.join(copies, ["class", "copy"])
    stars = inside.filter(starred & (F.col("doc_id") != F.col("head"))).select(
        F.col("head").alias("x"), F.col("doc_id").alias("y")
    )
    shown = inside.filter(~starred | (F.col("doc_id") == F.col("head"))).select("class", "doc_id")
    wide = copies.groupBy("class").agg(F.sum(F.when(starred, 1).otherwise(F.col("n"))).alias("n"))
    wide = wide.filter(F.col("n") > LIST).select("class", F.ceil(F.col("n") / LIST).alias("k"))
    shown = shown.join(wide, "class", "left").withColumn("k", F.coalesce("k", F.lit(1)))
    shown = shown.withColumn("list", F.pmod(F.xxhash64("doc_id"), "k"))
    lists = shown.groupBy("class", "list", "k").agg(F.collect_list("doc_id").alias("d"))

    # Each list of a class meets itself and every other list of it in a row of its own.
    several = lists.filter("k > 1 or size(d) > 1").withColumn("other", F.explode(_numbers("k")))
    met = several.groupBy(
        "class", F.least("list", "other").alias("low"), F.greatest("list", "other").alias("high")
    ).agg(F.collect_list("d").alias("d"))
    alone = F.col("low") == F.col("high")
    equal = (
        met.select(
            F.explode(F.get("d", 0)).alias("x"),
            F.get("d", F.when(alone, 0).otherwise(1)).alias("d"),
            alone.alias("alone"),
        )
        .select("x", F.explode("d").alias("y"), "alone")
        .filter("not alone or x < y")
        .select("x", "y")
    )
    linked = pairs
    for side in "ab":
        mine = wide.select(F.col("class").alias(side), F.col("k").alias(f"k{side}"))
        linked = linked.join(mine, side, "left")
        linked = linked.withColumn(f"list_{side}", F.explode(_numbers(F.coalesce(f"k{side}", F.lit(1)))))
    linked = linked.select("a", "list_a", "b", "list_b")
    for side in "ab":
        names = {"class": side, "list": f"list_{side}", "d": f"d{side}"}
        mine = lists.select(*(F.col(k).alias(v) for k, v in names.items()))
        linked = linked.join(mine, [side, f"list_{side}"])
    linked = linked.select(F.explode("da").alias("x"), "db").select("x", F.explode("db").alias("y"))
    every = stars.unionByName(equal).unionByName(linked)
    return every.select(
        F.least("x", "y").alias("doc_id_a"), F.greatest("x", "y").alias("doc_id_b")
    ).distinct()


def _numbers(k: Column | str) -> Column:
    return F.sequence(F.lit(0).cast("long"), (F.col(k) if isinstance(k, str) else k) - 1)


def near_duplicate_classes(df: DataFrame, **options: object) -> DataFrame:
    """``doc_id, class_id, links`` of every record with enough words: the least id among the
    records of equal runs, and the number of other classes that are similar."""
    pairs, members = near_duplicates(df, **options)
    members = members.select("class", "doc_id").distinct()
    heads = members.groupBy("class").agg(F.min("doc_id").alias("class_id"))
    ends = pairs.select(F.explode(F.array("a", "b")).alias("class"))
    links = ends.groupBy("class").agg(F.count("*").alias("links"))
    out = members.join(heads, "class").join(links, "class", "left")
    return out.select("doc_id", "class_id", F.coalesce("links", F.lit(0)).alias("links"))
