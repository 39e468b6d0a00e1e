"""The 256 byte tokens: their order in a new vocabulary and their printable form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The byte ranges that print as themselves.
PRINTABLE = ((33, 126), (161, 172), (174, 255))


def byte_order() -> list[int]:
    """Bytes in the order of their ids: the printable ones, then the others ascending."""
    first = [b for low, high in PRINTABLE for b in range(low, high + 1)]
    return first + sorted(set(range(256)) - set(first))


def byte_to_char() -> dict[int, str]:
    """Printable bytes stand for themselves, the others for the characters from 256 on."""
    order = byte_order()
    shown = sum(high - low + 1 for low, high in PRINTABLE)
    return {b: chr(b) if k < shown else chr(256 + k - shown) for k, b in enumerate(order)}


def char_to_byte() -> dict[str, int]:
    return {c: b for b, c in byte_to_char().items()}


def render(token: bytes) -> str:
    table = byte_to_char()
    return "".join(table[b] for b in token)


def parse(shown: str) -> bytes:
    table = char_to_byte()
    return bytes(table[c] for c in shown)


def byte_table(spark: SparkSession) -> DataFrame:
    """256 rows ``byte INT, pos INT, shown STRING``, computed with built-ins."""
    b = F.col("id").cast("int")
    printable = F.lit(False)
    for low, high in PRINTABLE:
        printable = printable | b.between(low, high)
    low = [high - start + 1 for start, high in PRINTABLE]
    before = F.lit(0)
    for k, (start, high) in enumerate(PRINTABLE):
        before = F.when(b.between(start, high), b - start + sum(low[:k])).otherwise(before)
    hidden = (
        F.when(b < 33, b).when(b.between(127, 160), b - 127 + 33).when(b == 173, F.lit(67))
    )
    pos = F.when(printable, before).otherwise(hidden + sum(low)).cast("int")
    shown = F.when(printable, F.char(b)).otherwise(F.decode(_utf16(hidden + 256), "UTF-16BE"))
    return spark.range(256).select(b.alias("byte"), pos.alias("pos"), shown.alias("shown"))


def _utf16(code: Column) -> Column:
    return F.unhex(F.lpad(F.hex(code.cast("long")), 4, "0"))
