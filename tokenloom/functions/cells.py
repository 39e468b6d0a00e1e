"""Cell strings: a word as ``<68><65><6C6C>``, one hex cell for each token.

Hex order is byte order, so ties break on plain strings, and one merge is the
built-in ``replace``, which stays inside whole-stage code generation.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_cells(word: Column) -> Column:
    """Cells of single UTF-8 bytes; null gives null, the empty string gives ''."""
    return F.regexp_replace(F.hex(F.encode(word, "UTF-8")), "(..)", "<$1>")


def atom(word: Column) -> Column:
    """The word as one cell, as special tokens are held."""
    return F.concat(F.lit("<"), F.hex(F.encode(word, "UTF-8")), F.lit(">"))


def symbols(cells: Column) -> Column:
    """Array of the hex tokens; an empty cell string gives an empty array."""
    inner = F.substring(cells, F.lit(2), F.greatest(F.length(cells) - 2, F.lit(0)))
    return F.when(F.length(cells) > 2, F.split(inner, "><")).when(
        cells.isNotNull(), F.array().cast("array<string>")
    )


def pairs(cells: Column) -> Column:
    """Array of adjacent pairs ``struct(l, r)``, overlapping ones included."""
    a = symbols(cells)
    n = F.greatest(F.size(a) - 1, F.lit(0))
    return F.when(
        F.size(a) > 1,
        F.zip_with(
            F.slice(a, F.lit(1), n),
            F.slice(a, F.lit(2), n),
            lambda x, y: F.struct(x.alias("l"), y.alias("r")),
        ),
    ).otherwise(F.array().cast("array<struct<l:string,r:string>>"))


def merge_cells(cells: Column, left: str | Column, right: str | Column) -> Column:
    """One merge, left to right and without overlaps: ``aaa`` gives ``aa a``."""
    left = F.lit(left) if isinstance(left, str) else left
    right = F.lit(right) if isinstance(right, str) else right
    found = F.concat(F.lit("<"), left, F.lit("><"), right, F.lit(">"))
    return F.replace(cells, found, F.concat(F.lit("<"), left, right, F.lit(">")))


def cells_to_text(cells: Column) -> Column:
    """The text of a cell string; broken UTF-8 becomes U+FFFD."""
    raw = F.unhex(F.regexp_replace(cells, "[<>]", ""))
    return F.make_valid_utf8(raw.cast("string"))
