"""Problem 6: exact token ids by a public byte-level BPE vocabulary.

A text falls into pieces by the vocabulary's pattern. Within a piece the tokens are found
by dynamic programming over its prefixes: each prefix of an encodable string has exactly
one last token, so it is enough to store that token. A suffix automaton of the vocabulary
follows the text and holds the longest suffix read that lies in some token; the tokens
that end at a place are found up its links. The right one is the first whose left
neighbour, the last token of the prefix before it, is compatible, that is, the two side by
side encode to themselves. Following the last tokens back from the end gives the ids.

The driver reads the vocabulary and builds the automaton, once; tasks get both as a
broadcast of some megabytes, whatever the input.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import pickle
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark import Broadcast
from pyspark.sql import DataFrame

from tokenloom.functions.patterns import python_pattern
from tokenloom.llm.automaton import build
from tokenloom.llm.common import id_text

#: Where the vocabulary files are on the driver; a parameter of every operator.
VOCAB = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Pieces whose ids a worker remembers, and the longest such piece in characters.
REMEMBERED, LONGEST = 400_000, 40


class Encoder:
    """The vocabulary of one file of base64 tokens and ranks; ranks are ids."""

    def __init__(self, data: bytes, pattern: str = "gpt2") -> None:
        self.ids = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, data.splitlines())}
        self.pattern = pattern
        self.automaton = build(self.ids)
        self.parts = self._parts()
        self._ready()

    def _ready(self) -> None:
        self.pieces = regex.compile(python_pattern(self.pattern)).findall
        self.token = {k: t for t, k in self.ids.items()}
        self.length = {k: len(t) for t, k in self.ids.items()}
        self.fits: dict[tuple[int, int], bool] = {}
        self.known = _Known(self)

    def __getstate__(self) -> dict:
        return {k: self.__dict__[k] for k in ("ids", "pattern", "automaton", "parts")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._ready()

    def _parts(self) -> dict[int, tuple[int, int]]:
        """The two tokens each token was merged from: those whose union has its rank,
        found by running the merges below that rank on its bytes."""
        return {k: self._last_two(t, k) for t, k in self.ids.items() if len(t) > 1}

    def _last_two(self, token: bytes, rank: int) -> tuple[int, int]:
        ids, parts = self.ids, [token[k : k + 1] for k in range(len(token))]
        while len(parts) > 2:
            at = [(ids.get(a + b, rank), k) for k, (a, b) in enumerate(zip(parts, parts[1:]))]
            low, k = min(at)
            if low >= rank:
                break
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        if len(parts) != 2:
            raise ValueError(f"token {rank} can't be made by merges of lower rank")
        return ids[parts[0]], ids[parts[1]]

    def compatible(self, left: int, right: int) -> bool:
        """Whether the two tokens, side by side, encode to themselves.

        They do unless some merge across their border comes before the merges that closed
        it: the later made of the two is taken apart at the border, again and again, and no
        pair met on the way may have been merged first.
        """
        key = (left, right)
        known = self.fits.get(key)
        if known is None:
            if len(self.fits) > 2_000_000:
                self.fits.clear()
            known = self.fits[key] = self._compatible(left, right)
        return known

    def _compatible(self, left: int, right: int) -> bool:
        token, ids, parts = self.token, self.ids, self.parts
        limit = len(token) + 1
        while True:
            joined = ids.get(token[left] + token[right])
            if joined is not None and joined < limit and parts[joined] == (left, right):
                return False
            if left > right:
                if left not in parts:
                    return True
                limit, left = left, parts[left][1]
            else:
                if right not in parts:
                    return True
                limit, right = right + 1, parts[right][0]

    def piece(self, text: str) -> list[int]:
        """Ids of one piece."""
        raw = text.encode("utf-8", "surrogatepass")
        whole = self.ids.get(raw)
        if whole is not None:
            return [whole]
        size = len(raw)
        last: list[int] = [-1] * (size + 1)
        start, labels, to, link, length, value, upper = self.automaton
        fits, find = self.compatible, labels.find
        state = matched = 0
        for end, c in enumerate(raw, 1):
            k = find(c, start[state], start[state + 1])
            while k < 0 and state:
                state = link[state]
                matched = length[state]
                k = find(c, start[state], start[state + 1])
            if k < 0:
                continue
            state, matched = to[k], matched + 1
            at = state if value[state] >= 0 and length[state] <= matched else upper[state]
            while at:
                before = end - length[at]
                if not before or last[before] >= 0 and fits(last[before], value[at]):
                    last[end] = value[at]
                    break
                at = upper[at]
        out, at, sizes = [], size, self.length
        while at:
            k = last[at]
            if k < 0:
                raise ValueError("the vocabulary lacks a byte of the text")
            out.append(k)
            at -= sizes[k]
        out.reverse()
        return out

    def encode(self, text: str) -> list[int]:
        known = self.known
        out: list[int] = []
        for p in map(known.__getitem__, self.pieces(text)):
            out += p
        return out

    def count(self, text: str) -> int:
        return sum(map(len, map(self.known.__getitem__, self.pieces(text))))


class _Known(dict):
    """Ids of pieces already met; long ones are not kept."""

    def __init__(self, encoder: Encoder) -> None:
        super().__init__()
        self.encoder = encoder

    def __missing__(self, piece: str) -> list[int]:
        found = self.encoder.piece(piece)
        if len(piece) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.clear()
            self[piece] = found
        return found


@functools.lru_cache(maxsize=2)
def encoder(path: str = VOCAB, pattern: str = "gpt2") -> Encoder:
    """The encoder of a vocabulary file, on the driver."""
    return Encoder(Path(path).read_bytes(), pattern)


def shared(df: DataFrame, path: str, pattern: str) -> Broadcast[tuple[str, bytes]]:
    """The encoder for all tasks, packed, and its name."""
    data = pickle.dumps(encoder(path, pattern))
    packed = zstandard.compress(data, 3)
    return df.sparkSession.sparkContext.broadcast((hashlib.sha1(packed).hexdigest(), packed))


_HELD: dict[str, Encoder] = {}


def held(named: tuple[str, bytes]) -> Encoder:
    """The encoder in a worker, which unpacks it once."""
    name, packed = named
    if name not in _HELD:
        _HELD.clear()
        _HELD[name] = pickle.loads(zstandard.decompress(packed))
    return _HELD[name]


def token_ids(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    path: str = VOCAB,
    pattern: str = "gpt2",
) -> DataFrame:
    """``doc_id, ids`` for each row: the ids of its text, special tokens as ordinary text.

    An empty text gives an empty list, a null one null. Null ids and repeated rows are
    kept, other columns are not carried.
    """

    every = shared(df, path, pattern)

    def encode(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = held(every.value)
        for batch in it:
            texts = batch.column(1).to_pylist()
            flat: list[int] = []
            ends = [0]
            for text in texts:
                if text:
                    flat += one.encode(text)
                ends.append(len(flat))
            missing = np.array([t is None for t in texts] + [False])
            ids = pa.ListArray.from_arrays(
                pa.array(ends, pa.int32(), mask=missing), pa.array(flat, pa.int32())
            )
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], ["doc_id", "ids"])

    return id_text(df, id_col, text_col).mapInArrow(encode, "doc_id bigint, ids array<int>")


def token_counts(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    path: str = VOCAB,
    pattern: str = "gpt2",
) -> DataFrame:
    """``doc_id, n_tokens`` for each row; null and empty texts have 0."""

    every = shared(df, path, pattern)

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = held(every.value)
        for batch in it:
            n = [one.count(t) if t else 0 for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64())], ["doc_id", "n_tokens"]
            )

    return id_text(df, id_col, text_col).mapInArrow(count, "doc_id bigint, n_tokens bigint")
