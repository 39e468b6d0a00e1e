"""Problem 2: cut oversized texts at natural boundaries, with overlap.

Prefix sums of the bytes of the characters give the place of every cut, and sorted
arrays hold the boundaries of each kind. A piece ends at the last boundary of the best
kind under the limit, found by binary search; the next one starts the overlap earlier.
Without any boundary the cut is hard, between two characters.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenloom.functions.patterns import python_specials

PIECES = (
    "run_id bigint, doc_id bigint, piece int, start_byte bigint, end_byte bigint, "
    "cut string, piece_text string"
)
DEFAULT_LIMIT = 1_000_000
#: A table of runs up to this many bytes is sent to all executors. A larger one is joined by
#: path, where the texts of one path are spread over so many parts.
RUNS_BYTES, SALTS = 8 << 20, 64

PARAGRAPH = re.compile(r"(?:\r\n|\n|\r)[ \t]*(?:\r\n|\n|\r)\s*")
SENTENCE = re.compile(r"[.!?…]+[\"'”’»)\]]*\s+|[。！？]+[」』”]*|(?:\r\n|\n|\r)")
WORD = re.compile(r"\s+")


def boundaries(text: str, specials: list[str] | None) -> list[tuple[str, np.ndarray]]:
    """Sorted character offsets where a piece may end, best kind first."""
    kinds = []
    if found := python_specials([s for s in specials or [] if s]):
        kinds.append(("special", found))
    kinds += [("paragraph", PARAGRAPH), ("sentence", SENTENCE), ("word", WORD)]
    return [(k, np.array([m.end() for m in p.finditer(text)], np.int64)) for k, p in kinds]


def split(
    text: str, limit: int, overlap: int = 0, specials: list[str] | None = None
) -> list[tuple[int, int, str]]:
    """Character ranges of the pieces and how each one ends.

    A piece has at most ``limit`` bytes. Each after the first starts with the last
    ``overlap`` bytes of the one before, or up to 3 fewer where these would begin inside
    a character, or as many as leave room for one more character. A text within the limit
    is one piece, an empty one none. A single character above the limit is a piece.
    """
    if limit <= 0:
        raise ValueError("the limit must be positive")
    if not text:
        return []
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    size = 1 + (code >= 0x80).astype(np.int64) + (code >= 0x800) + (code >= 0x10000)
    at = np.concatenate(([0], np.cumsum(size)))
    kinds = boundaries(text, specials) if at[-1] > limit else []
    out, start, done, n = [], 0, 0, len(text)
    while True:
        most = int(np.searchsorted(at, at[start] + limit, side="right")) - 1
        if most >= n:
            out.append((start, n, "end"))
            return out
        end, kind = max(most, done + 1), "hard"
        for name, marks in kinds:
            k = int(np.searchsorted(marks, most, side="right")) - 1
            if k >= 0 and marks[k] > done:
                end, kind = int(marks[k]), name
                break
        out.append((start, end, kind))
        back = min(overlap, limit - int(size[end])) if overlap > 0 else 0
        start = min(end, int(np.searchsorted(at, at[end] - max(back, 0), side="left")))
        done = end


def runs_of(train: DataFrame) -> DataFrame:
    """One row for each run: limits with their defaults. Runs listed twice count once."""
    return (
        train.filter("run_id is not null and input_path is not null")
        .select(
            "run_id",
            F.col("input_path").alias("path"),
            F.coalesce("stream_chunk_chars", F.lit(DEFAULT_LIMIT)).alias("most"),
            F.greatest(F.coalesce("overlap_chars", F.lit(0)), F.lit(0)).alias("overlap"),
            F.coalesce("special_tokens", F.array().cast("array<string>")).alias("specials"),
        )
        .filter("most > 0")
        .distinct()
    )


def oversized_pieces(stories: DataFrame, train: DataFrame) -> DataFrame:
    """The pieces of every record above the limit of a run on its path.

    Deliveries of one record, and runs listed twice, count once. A null text, path, id or
    run has no pieces; a limit that is not positive is none. Pieces count from 0.
    """
    runs = runs_of(train)
    each = F.octet_length("path") + F.octet_length(F.array_join("specials", "")) + 64
    least, size = runs.agg(F.min("most"), F.sum(each)).first()
    large = stories.select("doc_id", "text", F.col("input_path").alias("path")).filter(
        (F.octet_length("text") > F.lit(DEFAULT_LIMIT if least is None else least)) & F.col("doc_id").isNotNull()
    )
    if (size or 0) <= RUNS_BYTES:
        due = large.join(F.broadcast(runs), "path")
    else:
        spread = large.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
        every = runs.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        due = spread.join(every, ["path", "salt"]).drop("salt")
    due = due.filter(F.octet_length("text") > F.col("most"))
    once = due.dropDuplicates(["run_id", "doc_id", "most", "overlap", "specials"])
    return once.select("run_id", "doc_id", "text", "most", "overlap", "specials").mapInArrow(
        _cut, PIECES
    )


def _cut(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["run_id", "doc_id", "piece", "start_byte", "end_byte", "cut", "piece_text"]
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    for batch in it:
        rows = []
        for run, doc, text, most, overlap, specials in zip(*(c.to_pylist() for c in batch.columns)):
            done, byte = 0, 0
            for k, (a, b, kind) in enumerate(split(text, most, overlap, specials)):
                byte += len(text[done:a].encode()) if a >= done else -len(text[a:done].encode())
                piece = text[a:b]
                length = len(piece.encode())
                rows.append((run, doc, k, byte, byte + length, kind, piece))
                done, byte = b, byte + length
                if len(rows) >= 1000:
                    yield _batch(rows, names, types)
                    rows = []
        if rows:
            yield _batch(rows, names, types)


def _batch(rows: list[tuple], names: list[str], types: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)


def joined_pieces(pieces: DataFrame) -> DataFrame:
    """``run_id, doc_id, text, longest``: the pieces put together again without their
    overlaps, and the bytes of the longest one. The text of one record is one row, as it
    was before it was cut."""
    every = F.array_sort(F.collect_list(F.struct("piece", "start_byte", "end_byte", "piece_text")))
    rows = pieces.groupBy("run_id", "doc_id").agg(every.alias("p"))

    def new(piece: Column, k: Column) -> Column:
        before = F.when(k > 0, F.get("p", k - 1)["end_byte"]).otherwise(F.lit(0).cast("long"))
        raw = F.encode(piece["piece_text"], "UTF-8")
        return F.substring(raw, (before - piece["start_byte"] + 1).cast("int"), F.octet_length(raw))

    whole = F.aggregate(F.transform("p", new), F.lit(b""), lambda text, part: F.concat(text, part))
    longest = F.array_max(F.transform("p", lambda x: x["end_byte"] - x["start_byte"]))
    return rows.select("run_id", "doc_id", F.decode(whole, "UTF-8").alias("text"), longest.alias("longest"))
