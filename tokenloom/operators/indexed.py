"""Words with an index of their pairs: a merge touches only the words that the index names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.functions.cells import merge_cells
from tokenloom.operators import pairs as P
from tokenloom.sources.shared import Steps
from tokenloom.sources.storage import load_words, save_words


class IndexedWords:
    """The words ``w, cells, n`` and, once built, the postings ``l, r, word`` of their pairs.

    Frames do not change, so a merge replaces both by new ones, which are written to the
    shared folder every ``every`` merges. ``close`` removes these files.
    """

    def __init__(self, words: DataFrame, every: int = 10) -> None:
        self.words = words.select("w", "cells", "n")
        self.postings: DataFrame | None = None
        self.every, self.merges = every, 0
        self.steps = Steps(words.sparkSession, "indexed")

    @classmethod
    def load(cls, spark: SparkSession, *paths: str) -> IndexedWords:
        """Saved words, with the index built anew."""
        held = cls(load_words(spark, *paths))
        held.build_index()
        return held

    def save(self, path: str) -> None:
        save_words(self.words, path)

    def build_index(self) -> None:
        """Does nothing if the index is there."""
        if self.postings is None:
            self.postings = P.pair_postings(self.words)

    def merge(self, left: str, right: str) -> DataFrame:
        """Make one merge; gives the changes ``l, r, d`` of the pair counts."""
        self.build_index()
        found = self.postings.filter((F.col("l") == left) & (F.col("r") == right)).select(F.col("word").alias("w"))
        touched = self.words.join(found, "w", "left_semi")
        delta = P.merge_delta(touched, left, right)
        after = touched.withColumn("cells", merge_cells(F.col("cells"), left, right))
        others = self.postings.join(found.withColumnRenamed("w", "word"), "word", "left_anti").select("l", "r", "word")
        self.postings = others.unionByName(P.pair_postings(after))
        self.words = self.words.withColumn("cells", merge_cells(F.col("cells"), left, right))
        self.merges += 1
        if self.merges % self.every == 0:
            self.words = self.steps.keep("words", self.words)
            self.postings = self.steps.keep("postings", self.postings)
        return delta

    def close(self) -> None:
        self.steps.close()
