"""Adjacent pairs of tokens: counts, the best pair, an index, one merge and its changes.

All take words as ``cells, n`` (see ``functions.cells``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenloom.functions.cells import merge_cells, pairs


def pair_counts(words: DataFrame, min_freq: int = 1) -> DataFrame:
    """``l, r, n`` of all adjacent pairs, overlapping ones too, at least ``min_freq`` often."""
    each = words.select("n", F.explode(pairs(F.col("cells"))).alias("p"))
    out = each.groupBy(F.col("p.l").alias("l"), F.col("p.r").alias("r")).agg(F.sum("n").alias("n"))
    return out.filter(F.col("n") >= min_freq) if min_freq > 1 else out


def top_pairs(counts: DataFrame, k: int = 1) -> DataFrame:
    """The ``k`` most frequent pairs; ties go to the greatest bytes."""
    return counts.orderBy(F.desc("n"), F.desc("l"), F.desc("r")).limit(k)


def pair_postings(words: DataFrame, word_id: str = "w") -> DataFrame:
    """``l, r, word``: one row for each pair and distinct word that holds it."""
    each = words.select(F.col(word_id).alias("word"), F.explode(F.array_distinct(pairs(F.col("cells")))).alias("p"))
    return each.select(F.col("p.l").alias("l"), F.col("p.r").alias("r"), "word").distinct()


def pair_index(words: DataFrame, word_id: str = "w") -> DataFrame:
    """``l, r, words``: the sorted distinct words that hold each pair, as lists. For
    vocabularies whose longest list fits into a task; ``pair_postings`` has no such limit."""
    return pair_postings(words, word_id).groupBy("l", "r").agg(
        F.array_sort(F.collect_list("word")).alias("words")
    )


def merge(words: DataFrame, left: str, right: str) -> DataFrame:
    """The words after one merge."""
    return words.withColumn("cells", merge_cells(F.col("cells"), left, right))


def merge_delta(words: DataFrame, left: str, right: str) -> DataFrame:
    """``l, r, d``: by how much each pair count changes with one merge, 0 left out.

    Exact: the pairs of the changed words after the merge less those before it.
    """
    touched = words.filter(F.col("cells").contains(f"<{left}><{right}>"))
    before = touched.select((-F.col("n")).alias("d"), F.explode(pairs(F.col("cells"))).alias("p"))
    after = merge(touched, left, right).select(
        F.col("n").alias("d"), F.explode(pairs(F.col("cells"))).alias("p")
    )
    out = before.unionByName(after).groupBy(F.col("p.l").alias("l"), F.col("p.r").alias("r"))
    return out.agg(F.sum("d").alias("d")).filter("d <> 0")


def apply_delta(counts: DataFrame, delta: DataFrame) -> DataFrame:
    """Counts after a change; pairs that are gone are left out."""
    both = counts.select("l", "r", "n").unionByName(delta.select("l", "r", F.col("d").alias("n")))
    return both.groupBy("l", "r").agg(F.sum("n").alias("n")).filter("n > 0")


def changed_pairs(words: DataFrame, left: str, right: str) -> DataFrame:
    """``cells, gone, come``: the pairs each touched word loses and gains as sets."""
    touched = words.filter(F.col("cells").contains(f"<{left}><{right}>")).select(
        "cells", merge_cells(F.col("cells"), left, right).alias("after")
    )
    was, now = pairs(F.col("cells")), pairs(F.col("after"))
    return touched.select(
        "cells", F.array_except(was, now).alias("gone"), F.array_except(now, was).alias("come")
    )
