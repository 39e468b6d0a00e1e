"""A suffix automaton over many byte strings, built once and kept in flat arrays.

Each state stands for the substrings that end at the same places of the strings. A string
of the set is always the longest one of its state, for the place where it ends itself is
shared by no longer one; so a state belongs to one string at most.
"""

from __future__ import annotations

from array import array
from typing import NamedTuple


class Automaton(NamedTuple):
    """``labels[start[v] : start[v + 1]]`` are the bytes that lead on from state ``v``, and
    ``to`` the states they lead to. ``link`` is the state of the longest suffix with other
    ends, ``length`` the longest substring of a state, ``value`` what the string of the state
    stands for, or -1, and ``upper`` the nearest state with a value up the links, or 0."""

    start: array
    labels: bytes
    to: array
    link: array
    length: array
    value: array
    upper: array


def build(strings: dict[bytes, int]) -> Automaton:
    """The automaton of all substrings of ``strings``, which map to values from 0 on. The
    empty string is left out."""
    after: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    ends: list[tuple[int, int]] = []
    for text, value in strings.items():
        last = 0
        for c in text:
            last = _extended(after, link, length, last, c)
        if text:
            ends.append((last, value))
    n = len(after)
    values = [-1] * n
    for state, value in ends:
        values[state] = value
    upper = [0] * n
    for v in sorted(range(1, n), key=length.__getitem__):
        up = link[v]
        upper[v] = up if values[up] >= 0 else upper[up]
    start, labels, to = array("i", [0]), bytearray(), array("i")
    for edges in after:
        labels.extend(edges)
        to.extend(edges.values())
        start.append(len(to))
    return Automaton(start, bytes(labels), to, array("i", link), array("i", length), array("i", values), array("i", upper))


def _extended(after: list[dict[int, int]], link: list[int], length: list[int], last: int, c: int) -> int:
    """The state of the string of ``last`` and one more byte."""
    known = after[last].get(c)
    if known is not None:
        return known if length[known] == length[last] + 1 else _split(after, link, length, last, c, known)
    new = len(after)
    after.append({})
    link.append(0)
    length.append(length[last] + 1)
    p = last
    while p >= 0 and c not in after[p]:
        after[p][c] = new
        p = link[p]
    if p >= 0:
        q = after[p][c]
        link[new] = q if length[q] == length[p] + 1 else _split(after, link, length, p, c, q)
    return new


def _split(after: list[dict[int, int]], link: list[int], length: list[int], p: int, c: int, q: int) -> int:
    """A state for the shorter substrings of ``q``, those that end a step behind ``p``."""
    new = len(after)
    after.append(dict(after[q]))
    link.append(link[q])
    length.append(length[p] + 1)
    link[q] = new
    while p >= 0 and after[p].get(c) == q:
        after[p][c] = new
        p = link[p]
    return new
