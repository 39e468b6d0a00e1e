"""Exact byte-pair training on a histogram of words.

A histogram that fits into the driver is trained there with a heap and postings, where a
merge costs only the words it touches. A larger one stays distributed: the words are
rewritten with built-ins, merge by merge, and the pair counts follow by the exact changes.
The counts are cached for each merge, and words and counts are written to the shared
folder every few merges, so no merge is ever computed twice.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tokenloom.functions.bytes_table import byte_order
from tokenloom.functions.cells import symbols
from tokenloom.operators import pairs as P
from tokenloom.operators.pretokenize import word_histogram
from tokenloom.sources.shared import Steps
from tokenloom.sources.storage import latest_step, load_state, save_step

#: Bytes of driver memory that local training may take, and what a word and each of its
#: tokens were measured to take: lists, counts of pairs, postings, and the collected rows.
LOCAL_BYTES, WORD_BYTES, TOKEN_BYTES = 1 << 30, 500, 160
#: Merges between two tables of the distributed words.
CUT_EVERY = 25
MERGES = T.StructType(
    [T.StructField("rank", T.IntegerType()), T.StructField("l", T.StringType()),
     T.StructField("r", T.StringType()), T.StructField("n", T.LongType())]
)
Merge = tuple[int, str, str, int]


def number_of_merges(vocab_size: int, specials: list[str] | None) -> int:
    return max(0, vocab_size - len(specials or []) - 256)


def train_merges(
    words: DataFrame,
    merges: int,
    mode: str = "auto",
    min_freq: int = 1,
    resume: list[Merge] | None = None,
    on_merge: Callable[[dict], None] | None = None,
    cut_every: int = CUT_EVERY,
) -> list[Merge]:
    """Up to ``merges`` merges ``(rank, left hex, right hex, count)``.

    Each takes the most frequent pair, the greatest bytes among equals, and stops when no
    pair is left that is ``min_freq`` frequent. ``mode`` is ``local``, ``distributed`` or
    ``auto``, by the memory that the words would take on the driver; all give the same.
    ``resume`` continues earlier merges.
    """
    if mode not in ("auto", "local", "distributed"):
        raise ValueError(f"mode must be auto, local or distributed, not {mode!r}")
    done = list(resume or [])[:merges]
    words = words.filter(F.col("cells").contains("><")).select("cells", "n")
    if mode == "distributed":
        return _distributed(words, merges, min_freq, done, on_merge, cut_every)
    # A frame of its own: the caller's may be cached and stays so.
    held = words.select("cells", F.col("n").cast("long").alias("n")).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        if mode == "auto" and driver_bytes(held) > LOCAL_BYTES:
            return _distributed(held, merges, min_freq, done, on_merge, cut_every)
        return _local(held, merges, min_freq, done, on_merge)
    finally:
        held.unpersist()


def driver_bytes(words: DataFrame) -> int:
    """What the words would take in local training."""
    row = words.agg(F.count("*").alias("n"), F.sum(F.size(symbols(F.col("cells")))).alias("t")).first()
    return row["n"] * WORD_BYTES + (row["t"] or 0) * TOKEN_BYTES


def _told(found: list[Merge], rank: int, left: str, right: str, n: int, on_merge: Callable | None) -> None:
    found.append((rank, left, right, n))
    if on_merge:
        on_merge({"merge": rank, "left": left, "right": right, "count": n})


class LocalTrainer:
    """Words as lists of hex tokens, counts of pairs, and for each pair its words."""

    def __init__(self, words: list[tuple[str, int]]) -> None:
        self.words = [cells[1:-1].split("><") for cells, _ in words]
        self.n = [n for _, n in words]
        self.counts: dict[tuple[str, str], int] = defaultdict(int)
        self.places: dict[tuple[str, str], set[int]] = defaultdict(set)
        for k, w in enumerate(self.words):
            for pair in zip(w, w[1:]):
                self.counts[pair] += self.n[k]
                self.places[pair].add(k)
        self.heap = [_Entry(n, p) for p, n in self.counts.items()]
        heapq.heapify(self.heap)

    def best(self) -> tuple[tuple[str, str], int] | None:
        while self.heap:
            e = heapq.heappop(self.heap)
            if self.counts.get(e.pair) == e.n:
                return e.pair, e.n
        return None

    def merge(self, left: str, right: str) -> dict[tuple[str, str], int]:
        """Make one merge; gives the changes of the counts that are not 0."""
        before: dict[tuple[str, str], int] = {}
        for k in self.places.pop((left, right), ()):
            w, n = self.words[k], self.n[k]
            for pair in zip(w, w[1:]):
                before.setdefault(pair, self.counts[pair])
                self.counts[pair] -= n
            new, i = [], 0
            while i < len(w):
                if i + 1 < len(w) and w[i] == left and w[i + 1] == right:
                    new.append(left + right)
                    i += 2
                else:
                    new.append(w[i])
                    i += 1
            self.words[k] = new
            for pair in zip(new, new[1:]):
                before.setdefault(pair, self.counts.get(pair, 0))
                self.counts[pair] += n
                self.places[pair].add(k)
        changes = {p: self.counts[p] - n for p, n in before.items() if self.counts[p] != n}
        for pair in before:
            if self.counts[pair] <= 0:
                del self.counts[pair]
            elif pair in changes:
                heapq.heappush(self.heap, _Entry(self.counts[pair], pair))
        return changes


class _Entry:
    """A pair in the heap: the most frequent first, then the greatest bytes."""

    __slots__ = ("n", "pair")

    def __init__(self, n: int, pair: tuple[str, str]) -> None:
        self.n, self.pair = n, pair

    def __lt__(self, other: _Entry) -> bool:
        return (self.n, self.pair) > (other.n, other.pair)


def _local(words: DataFrame, merges: int, min_freq: int, done: list[Merge], on_merge: Callable | None) -> list[Merge]:
    trainer = LocalTrainer([(r[0], r[1]) for r in words.select("cells", "n").collect()])
    for _, left, right, _ in done:
        trainer.merge(left, right)
    while len(done) < merges:
        best = trainer.best()
        if best is None or best[1] < min_freq:
            break
        (left, right), n = best
        _told(done, len(done), left, right, n, on_merge)
        trainer.merge(left, right)
    return done


def _distributed(
    words: DataFrame, merges: int, min_freq: int, done: list[Merge], on_merge: Callable | None, cut_every: int
) -> list[Merge]:
    steps = Steps(words.sparkSession, "train")
    counts = None
    try:
        for _, left, right, _ in done:
            words = P.merge(words, left, right)
        words = steps.keep("words", words.select("cells", "n"))
        counts = P.pair_counts(words).persist(StorageLevel.MEMORY_AND_DISK)
        since = 0
        while len(done) < merges:
            best = P.top_pairs(counts).first()
            if best is None or best["n"] < min_freq:
                break
            left, right = best["l"], best["r"]
            _told(done, len(done), left, right, best["n"], on_merge)
            if len(done) == merges:
                break
            after = P.apply_delta(counts, P.merge_delta(words, left, right))
            words = P.merge(words, left, right)
            since += 1
            if since == cut_every:
                words, after, since = steps.keep("words", words), steps.keep("counts", after), 0
            else:
                # Computed by the count, from the counts before, which then can go.
                after = after.persist(StorageLevel.MEMORY_AND_DISK)
                after.count()
            counts.unpersist()
            counts = after
        return done
    finally:
        if counts is not None:
            counts.unpersist()
        steps.close()


def train_bpe(
    df: DataFrame,
    vocab_size: int,
    specials: list[str] | None = None,
    text: str = "text",
    pattern: str = "gpt2",
    workdir: str | None = None,
    every: int = 0,
    on_merge: Callable[[dict], None] | None = None,
    **options: object,
) -> tuple[DataFrame, DataFrame]:
    """``vocab (id, token)`` and ``merges (rank, l, r, n)`` trained on the texts of ``df``.

    Ids count the specials in their order, the 256 bytes, then the merges. Null and empty
    texts add nothing; without any pair there are no merges. With ``workdir`` the state is
    saved there every ``every`` merges, and a later call continues from what it finds.
    """
    spark = df.sparkSession
    words = word_histogram(df, text, specials, pattern)
    if workdir:
        options["resume"] = load_merges(spark, workdir)
        seen = list(options["resume"])

        def saved(m: dict) -> None:
            seen.append((m["merge"], m["left"], m["right"], m["count"]))
            if every and len(seen) % every == 0:
                save_merges(spark, workdir, seen, specials)
            if on_merge:
                on_merge(m)

    found = train_merges(words, number_of_merges(vocab_size, specials), on_merge=saved if workdir else on_merge, **options)
    if workdir:
        save_merges(spark, workdir, found, specials)
    return vocab(spark, found, specials), merges_frame(spark, found)


def save_merges(spark: SparkSession, folder: str, merges: list[Merge], specials: list[str] | None = None) -> None:
    """The state after ``merges`` as a step in a folder."""
    pairs = [(bytes.fromhex(left), bytes.fromhex(right)) for _, left, right, _ in merges]
    save_step(spark, folder, dict(enumerate(tokens(merges, specials))), pairs, [n for *_, n in merges])


def load_merges(spark: SparkSession, folder: str) -> list[Merge]:
    """The merges of the last whole step in a folder, or none."""
    step = latest_step(spark, folder)
    _, merges, counts = load_state(spark, step) if step else (None, [], [])
    counts = counts or [0] * len(merges or [])
    return [(k, bytes(a).hex().upper(), bytes(b).hex().upper(), n) for k, ((a, b), n) in enumerate(zip(merges or [], counts))]


def merges_frame(spark: SparkSession, merges: list[Merge]) -> DataFrame:
    return spark.createDataFrame(merges, MERGES)


def tokens(merges: list[Merge], specials: list[str] | None = None) -> list[bytes]:
    """The tokens of a vocabulary in the order of their ids."""
    first = [s.encode() for s in specials or []] + [bytes([b]) for b in byte_order()]
    return first + [bytes.fromhex(left + right) for _, left, right, _ in merges]


def vocab(spark: SparkSession, merges: list[Merge], specials: list[str] | None = None) -> DataFrame:
    """``id INT, token BINARY``."""
    schema = T.StructType([T.StructField("id", T.IntegerType()), T.StructField("token", T.BinaryType())])
    return spark.createDataFrame([(k, bytearray(t)) for k, t in enumerate(tokens(merges, specials))], schema)
