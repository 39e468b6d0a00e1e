"""Problem 1: how much of a text repeats what it already said.

The words of every text are compressed, whole and in fixed chunks, and once more in a
random order. What zstandard saves by the order of the words is what the text repeats:
with 30 % of the words in runs said before, the ordered text is at least a tenth shorter.
How far that holds depends on the length, so each band of lengths has its own limits. A
text above them is plain, and the compressor alone decides that; one above the upper limit
is incompressible. Only texts below the limits are counted word by word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenloom.llm.common import id_text
from tokenloom.llm.words import Words, chunks, runs, spelled, words

MEASURES = (
    "doc_id bigint, n_words bigint, ratio double, order_ratio double, worst_chunk double, "
    "band int, verdict string, repeated_share double"
)
RUN, LEAST = 6, 0.3
CHUNK_BYTES = 4096
LEVEL = 3
#: Upper end of each band, in bytes of the words of a text; then the ratio to the same words
#: in random order, and the plain ratio, at or below which a text may repeat ``LEAST`` of
#: its words; and the ratio above which it is incompressible. Of texts with just that
#: share, made for the purpose, nearly all lie far below: see README.
BANDS = (
    (192, 9.0, 9.0, 9.0),
    (384, 0.98, 0.6, 0.9),
    (768, 0.97, 0.42, 0.85),
    (1536, 0.95, 0.4, 0.8),
    (3072, 0.94, 0.36, 0.75),
    (6144, 0.92, 0.36, 0.7),
    (12288, 0.92, 0.36, 0.7),
    (1 << 62, 0.92, 0.36, 0.7),
)
ENDS, ORDERED, LOW, HIGH = (np.array(c) for c in zip(*BANDS))


def repeated(w: Words, n_texts: int, run: int = RUN) -> tuple[np.ndarray, np.ndarray]:
    """Words and repeated words of each text of a chunk.

    A word is repeated if it lies in a run of ``run`` words that also occurs, starting
    earlier, in the same text.
    """
    total = np.bincount(w.doc, minlength=n_texts)
    at, h = runs(w, run)
    again = np.zeros(len(w.hash) + 1, np.int64)
    if len(at):
        order = np.lexsort((h, w.doc[at]))
        same = (h[order][1:] == h[order][:-1]) & (w.doc[at[order]][1:] == w.doc[at[order]][:-1])
        later = at[order[1:][same]]
        again[later] += 1
        np.subtract.at(again, later + run, 1)
    covered = np.cumsum(again)[:-1] > 0
    return total, np.bincount(w.doc[covered], minlength=n_texts)


class Compressor:
    """Compressed sizes, with a window as long as the text."""

    def __init__(self) -> None:
        self.usual = zstandard.ZstdCompressor(level=LEVEL, write_content_size=False)
        self.window = 1 << 20

    def size(self, data: bytes) -> int:
        if len(data) <= self.window:
            return len(self.usual.compress(data))
        log = min(len(data).bit_length(), zstandard.WINDOWLOG_MAX)
        kind = zstandard.ZstdCompressionParameters.from_level(LEVEL, window_log=log, enable_ldm=True, write_content_size=False)
        return len(zstandard.ZstdCompressor(compression_params=kind).compress(data))


def ratios(own: bytes, mixed: bytes, compress: Compressor) -> tuple[float, float, float, bool]:
    """Compressed size of the words of a text per byte, and against the same words in another
    order; per byte of the most compressible chunk; and whether any of these is at or below
    the limit of its length."""
    size = compress.size(own)
    whole, ordered = size / len(own), size / compress.size(mixed)
    k = int(np.searchsorted(ENDS, len(own)))
    low, worst = bool(ordered <= ORDERED[k] or whole <= LOW[k]), whole
    if len(own) > CHUNK_BYTES:
        for at in range(0, len(own), CHUNK_BYTES):
            part = own[at : at + CHUNK_BYTES]
            one = compress.size(part) / len(part)
            worst = min(worst, one)
            low = low or bool(one <= LOW[np.searchsorted(ENDS, len(part))])
    return whole, ordered, worst, low


def repetition(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", count_all: bool = True) -> DataFrame:
    """One row for each row of ``df``: ratios, band, verdict and repeated share.

    ``verdict`` is ``repetitive`` for texts at or below a limit of their band, which may be
    cases, else ``incompressible`` or ``plain``. The share of the last two is null unless
    ``count_all`` is set. A null text has null measures and the verdict ``missing``; a text
    without words has the share 0. Other columns are not carried. Rows that come twice come
    out twice.
    """

    def measure(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compress = Compressor()
        for batch in it:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in chunks([t or "" for t in texts]):
                yield _measured(ids[a:b], texts[a:b], compress, count_all)

    return id_text(df, id_col, text_col).mapInArrow(measure, MEASURES)


def _measured(ids: list, texts: list[str | None], compress: Compressor, count_all: bool) -> pa.RecordBatch:
    n = len(texts)
    w = words([t or "" for t in texts])
    total = np.bincount(w.doc, minlength=n)
    first = np.searchsorted(w.doc, np.arange(n + 1))
    # The order is random but the same whenever a text is measured.
    order = np.lexsort((w.hash * np.uint64(0x9E3779B97F4A7C15) + _again(w), w.doc))
    own, at = spelled(w, np.arange(len(w.hash)))
    mixed, there = spelled(w, order)
    whole, ordered, worst, low = np.ones(n), np.ones(n), np.ones(n), np.ones(n, bool)
    length = np.zeros(n, np.int64)
    for k in np.flatnonzero(total).tolist():
        i, j = first[k], first[k + 1]
        mine = own[at[i] : at[j]].encode("utf-8", "surrogatepass")
        length[k] = len(mine)
        whole[k], ordered[k], worst[k], low[k] = ratios(mine, mixed[there[i] : there[j]].encode("utf-8", "surrogatepass"), compress)
    band = np.searchsorted(ENDS, length)
    verdict = np.where(low, "repetitive", np.where(whole > HIGH[band], "incompressible", "plain"))
    missing = np.array([t is None for t in texts], bool)
    verdict = np.where(missing, "missing", verdict)
    counted = np.ones(n, bool) if count_all else low
    picked = counted[w.doc]
    some = Words(w.joined, w.start[picked], w.end[picked], w.doc[picked], w.hash[picked])
    share = repeated(some, n)[1] / np.maximum(total, 1)
    columns = [
        pa.array(ids, pa.int64()),
        pa.array(total, pa.int64(), mask=missing),
        pa.array(whole, mask=missing),
        pa.array(ordered, mask=missing),
        pa.array(worst, mask=missing),
        pa.array(band.astype(np.int32), mask=missing),
        pa.array(verdict.tolist(), pa.string()),
        pa.array(share, mask=missing | ~counted),
    ]
    return pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in MEASURES.split(", ")])


def _again(w: Words) -> np.ndarray:
    """A number for each word that depends on its place in its text, to tell equal words apart."""
    first = np.searchsorted(w.doc, w.doc)
    place = (np.arange(len(w.hash)) - first).astype(np.uint64)
    return place * np.uint64(0xBF58476D1CE4E5B9)


def repetitive_records(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST
) -> DataFrame:
    """Distinct ids of texts whose share is ``least`` or more. Only texts that the compressor
    does not call plain or incompressible are counted; its limits hold from ``LEAST`` on, so
    for a smaller share all are. Rows without an id are no records."""
    found = repetition(df, id_col, text_col, count_all=least < LEAST).filter(
        (F.col("n_words") > 0)
        & (F.col("repeated_share") >= least)
        & F.col("doc_id").isNotNull()
    )
    return found.select("doc_id").distinct()
