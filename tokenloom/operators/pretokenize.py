"""From texts to words: segments, pretokens, chunks and word counts, all with built-ins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenloom.functions.cells import atom, to_cells
from tokenloom.functions.patterns import check_specials, java_pattern, segment_pattern


def segments_of(text: Column, specials: list[str] | None = None) -> Column:
    """Array of the special tokens and the plain runs between them, in order.

    The longest special wins where several begin. Null gives null, '' an empty array.
    """
    return F.regexp_extract_all(text, F.lit(segment_pattern(specials)), F.lit(0))


def words_of(segment: Column, pattern: str = "gpt2") -> Column:
    """Array of the pretokens of a plain segment."""
    found = F.regexp_extract_all(segment, F.lit(java_pattern(pattern)), F.lit(0))
    return F.filter(found, lambda w: w != "")


def segment(df: DataFrame, text: str = "text", specials: list[str] | None = None) -> DataFrame:
    """One row for each segment, with ``sp``, ``seg`` and ``is_special`` behind the other
    columns. Null and empty texts give no rows."""
    kept = [c for c in df.columns if c != text]
    out = df.select(*kept, F.posexplode(segments_of(F.col(text), specials)).alias("sp", "seg"))
    is_special = F.col("seg").isin(check_specials(specials)) if specials else F.lit(False)
    return out.withColumn("is_special", is_special)


def pretokenize(
    df: DataFrame,
    text: str = "text",
    specials: list[str] | None = None,
    pattern: str = "gpt2",
) -> DataFrame:
    """One row for each word: ``sp, wp, w, is_special`` behind the other columns.

    Special tokens are words of their own, also where a pretoken equals one.
    """
    seg = segment(df, text, specials)
    kept = [c for c in df.columns if c != text]
    words = F.when(F.col("is_special"), F.array("seg")).otherwise(words_of(F.col("seg"), pattern))
    out = seg.select(*kept, "sp", "is_special", F.posexplode(words).alias("wp", "w"))
    if specials:
        out = out.withColumn("is_special", F.col("w").isin(check_specials(specials)))
    return out.select(*kept, "sp", "wp", "w", "is_special")


def word_histogram(
    df: DataFrame,
    text: str = "text",
    specials: list[str] | None = None,
    pattern: str = "gpt2",
) -> DataFrame:
    """``w, cells, n`` of every distinct word; the only shuffle is on the word."""
    words = pretokenize(df.select(text), text, specials, pattern)
    counted = words.groupBy("w", "is_special").agg(F.count("*").alias("n"))
    cells = F.when(F.col("is_special"), atom(F.col("w"))).otherwise(to_cells(F.col("w")))
    return counted.select("w", cells.alias("cells"), "n")


def lines_of(text: Column) -> Column:
    """Array of the lines with their ends."""
    return F.regexp_extract_all(text, F.lit("[^\n]*\n|[^\n]+"), F.lit(0))


def chunks_of(text: Column, size: int) -> Column:
    """Array of pieces of ``size`` characters, the last one shorter."""
    if size <= 0:
        raise ValueError("the chunk size must be positive")
    starts = F.sequence(F.lit(1), F.length(text), F.lit(size))
    pieces = F.transform(starts, lambda i: F.substring(text, i, F.lit(size)))
    return F.when(F.length(text) > 0, pieces).when(text.isNotNull(), F.array().cast("array<string>"))
