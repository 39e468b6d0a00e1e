"""Words of many texts at once, as arrays.

A word is a maximal run of Unicode letters (general category L) in lower case;
everything else separates. Lower case is taken character by character, with one
letter for both small sigmas. Words are known by 64-bit hashes, computed for
millions of characters together from prefix sums of a polynomial.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np

CHUNK = 1_000_000
_BASE = 0x9E3779B97F4A7C15
_U = np.uint64


class Words(NamedTuple):
    """Arrays over the words of a chunk; ``doc`` counts the chunk's texts from 0."""

    joined: str
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    hash: np.ndarray

    def spell(self, k: int) -> str:
        return self.joined[self.start[k] : self.end[k]].lower()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads their bits."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


@functools.cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    letter = np.zeros(0x110000, np.int8)
    lower = np.arange(0x110000, dtype=np.uint64)
    for c in range(0x110000):
        ch = chr(c)
        if unicodedata.category(ch)[0] == "L":
            letter[c] = 1
            if len(low := ch.lower()) == 1:
                lower[c] = ord(low)
    lower[ord("ς")] = ord("σ")
    return letter, mix(lower + _U(1)), lower.astype(np.uint32)


class _Powers:
    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)

    @classmethod
    def to(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = max(n, CHUNK + CHUNK // 4)
            for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
                powers = np.full(size, base, np.uint64)
                powers[0] = 1
                setattr(cls, name, np.multiply.accumulate(powers))
        return cls.up[:n], cls.down[:n]


def chunks(texts: list[str], limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``limit`` characters together, one text at least."""
    first, size = 0, 0
    for k, text in enumerate(texts):
        if size and size + len(text) > limit:
            yield first, k
            first, size = k, 0
        size += len(text) + 1
    if first < len(texts):
        yield first, len(texts)


def words(texts: list[str]) -> Words:
    joined = "\n".join(texts) + "\n"
    letter, value, _ = _tables()
    code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    edge = np.flatnonzero(np.diff(letter[code], prepend=np.int8(0)))
    start, end = edge[::2], edge[1::2]
    up, down = _Powers.to(len(code) + 1)
    total = np.zeros(len(code) + 1, np.uint64)
    np.cumsum(value[code] * up[:-1], out=total[1:])
    hashed = mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))
    first = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=first[1:])
    doc = np.searchsorted(first, start, side="right") - 1
    return Words(joined, start, end, doc, hashed)


def spelled(w: Words, order: np.ndarray) -> tuple[str, np.ndarray]:
    """The words in an order, in lower case and with a blank behind each, and where the word
    of each place of the order begins, with the whole length last."""
    code = np.frombuffer(w.joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    size = (w.end - w.start + 1)[order]
    at = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=at[1:])
    from_ = np.repeat(w.start[order] - at[:-1], size) + np.arange(at[-1])
    out = _tables()[2][code[from_]]
    out[at[1:] - 1] = ord(" ")
    return out.tobytes().decode("utf-32-le", "surrogatepass"), at


def runs(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Start word and hash of every run of ``n`` words within one text."""
    size = len(w.hash) - n + 1
    if size <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = np.flatnonzero(w.doc[:size] == w.doc[n - 1 :])
    h = np.zeros(len(at), np.uint64)
    for k in range(n):
        h = mix(h + w.hash[at + k] + _U(k))
    return at, h
