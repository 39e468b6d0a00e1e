"""Problem 4: how often every term occurs, in how many records, and which are useless.

Records fall into blocks, no record into two. Each block gets one suffix array over its
terms as numbers, down to the ends of the records, and one array of the common prefixes
of neighbours. The suffixes that share their first n terms form an interval of it, so the
counts of the n-grams of every length are read from the same two arrays: the size of an
interval is the number of occurrences. Two suffixes of one record that follow each other
among the suffixes of that record and lie in one interval are a duplicate; taking these
off gives the number of records. Blocks send one row for each of their n-grams, which are
then summed.

Texts are counted where they lie. Only the ids are shuffled, to find those delivered more
than once, and only the texts of these are brought together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenloom.llm.common import cut, id_text
from tokenloom.llm.words import words

COUNTS = "term string, n_terms int, occurrences bigint, records bigint"
#: Characters, and terms of lists, of one block.
BLOCK_CHARS, BLOCK_TERMS = 2_000_000, 500_000
#: Ids delivered more than once are broadcast up to this many (about 64 MB); beyond that all
#: rows are shuffled.
BROADCAST_IDS = 2_000_000


class Suffixes:
    """The suffix array of a block and what is needed to walk its intervals.

    ``symbol`` holds the terms of all records in order, ``doc`` their records in ascending
    order. A suffix ends with its record. Equal suffixes keep the order of their places.
    ``lcp`` is the common prefix of each suffix with the one before, up to ``max_n`` terms.
    """

    def __init__(self, symbol: np.ndarray, doc: np.ndarray, max_n: int) -> None:
        size = len(symbol)
        self.doc, self.max_n = doc, max_n
        self.left = np.searchsorted(doc, doc, side="right") - np.arange(size)
        number = np.unique(symbol, return_inverse=True)[1].ravel().astype(np.int64)
        self.order = _sorted_suffixes(number, self.left)
        self.lcp = np.zeros(size, np.int64)
        a, b = self.order[:-1], self.order[1:]
        alike = np.arange(size - 1) if size else np.zeros(0, np.int64)
        for k in range(max_n):
            alike = alike[np.minimum(self.left[a[alike]], self.left[b[alike]]) > k]
            alike = alike[number[a[alike] + k] == number[b[alike] + k]]
            self.lcp[alike + 1] = k + 1
        by_record = np.argsort(doc[self.order], kind="stable")
        same = doc[self.order[by_record]][1:] == doc[self.order[by_record]][:-1]
        #: Places in the suffix array of neighbouring suffixes of one record.
        self.before, self.after = by_record[:-1][same], by_record[1:][same]

    def intervals(self, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First position, occurrences and records of every distinct n-gram. No shorter
        suffix can lie inside the interval of an n-gram."""
        if not 1 <= n <= self.max_n:
            raise ValueError(f"n must be from 1 to {self.max_n}, not {n}")
        if not len(self.order):
            return (np.zeros(0, np.int64),) * 3
        new = self.lcp < n
        new[0] = True
        interval = np.cumsum(new) - 1
        head = np.flatnonzero(new)
        occurrences = np.diff(np.r_[head, len(new)])
        twice = interval[self.before] == interval[self.after]
        again = np.bincount(interval[self.after[twice]], minlength=len(head))
        whole = self.left[self.order[head]] >= n
        return self.order[head[whole]], occurrences[whole], (occurrences - again)[whole]


def _sorted_suffixes(number: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Suffixes in order, by doubling: a group of suffixes that are equal so far is sorted
    by the groups of what follows, until it is split or its suffixes have ended."""
    size = len(number)
    order = np.argsort(number, kind="stable")
    first = np.flatnonzero(np.r_[True, np.diff(number[order]) != 0][:size])
    rank = np.empty(size, np.int64)
    rank[order] = np.repeat(first, np.diff(np.r_[first, size]))
    open_ = _several(rank, order, np.arange(size))
    step = 1
    while len(open_):
        mine = order[open_]
        goes_on = left[mine] > step
        then = np.zeros(len(mine), np.int64)
        then[goes_on] = rank[mine[goes_on] + step] + 1
        by = np.lexsort((then, rank[mine]))
        mine, then = mine[by], then[by]
        order[open_] = mine
        old = rank[mine]
        new = np.r_[True, (old[1:] != old[:-1]) | (then[1:] != then[:-1])]
        rank[mine] = open_[np.flatnonzero(new)][np.cumsum(new) - 1]
        open_ = _several(rank, order, open_[then > 0])
        step *= 2
    return order


def _several(rank: np.ndarray, order: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Those places of the suffix array whose rank is not theirs alone."""
    if not len(at):
        return at
    r = rank[order[at]]
    same = r[1:] == r[:-1]
    return at[np.r_[False, same] | np.r_[same, False]]


def _text_block(texts: list[str], lengths: list[int]) -> Iterator[pa.RecordBatch]:
    w = words(texts)
    if not len(w.hash):
        return
    found = Suffixes(w.hash, w.doc, max(lengths))
    start, end = w.start, w.end
    for n in lengths:
        first, occurrences, records = found.intervals(n)
        if n == 1:
            shown = [w.joined[s:e].lower() for s, e in zip(start[first], end[first])]
        else:
            spelled = np.array([w.joined[s:e].lower() for s, e in zip(start, end)], object)
            shown = [" ".join(x) for x in spelled[first[:, None] + np.arange(n)].tolist()]
        if shown:
            yield _rows(shown, n, occurrences, records)


def _rows(shown: list[str], n: int, occurrences: np.ndarray, records: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [
            pa.array(shown, pa.string()),
            pa.array(np.full(len(shown), n, np.int32)),
            pa.array(occurrences.astype(np.int64)),
            pa.array(records.astype(np.int64)),
        ],
        ["term", "n_terms", "occurrences", "records"],
    )


def _lengths(n: int | list[int]) -> list[int]:
    lengths = [n] if isinstance(n, int) else sorted(set(n))
    if not lengths or lengths[0] < 1:
        raise ValueError("the lengths of n-grams count from 1")
    return lengths


def once(rows: DataFrame) -> DataFrame:
    """One row for each ``id``. Rows whose id comes once stay where they are; only the rows
    of the other ids are shuffled, unless these are too many to be sent to all tasks."""
    twice = cut(rows.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").select("id"))
    if twice.count() > BROADCAST_IDS:
        return rows.dropDuplicates(["id"])
    again = rows.join(F.broadcast(twice), "id", "left_semi").dropDuplicates(["id"])
    return rows.join(F.broadcast(twice), "id", "left_anti").unionByName(again)


def word_counts(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int | list[int] = 1
) -> DataFrame:
    """``term, n_terms, occurrences, records`` of every n-gram of words, of one or several ``n``.

    Rows of one id are deliveries of one record and count once; rows without an id name
    no record and are left out. Null, empty and wordless texts add nothing. An empty
    table gives no rows.
    """
    lengths = _lengths(n)

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts: list[str] = []
        size = 0
        for batch in it:
            for text in batch.column(1).to_pylist():
                texts.append(text)
                size += len(text)
                if size >= BLOCK_CHARS:
                    yield from _text_block(texts, lengths)
                    texts, size = [], 0
        if texts:
            yield from _text_block(texts, lengths)

    rows = once(id_text(df, id_col, text_col).filter("id is not null")).filter("text <> ''")
    return _summed(rows.mapInArrow(count, COUNTS))


def list_counts(df: DataFrame, id_col: str, terms: Column, n: int | list[int] = 1) -> DataFrame:
    """The same for records that are lists of terms already; null terms are skipped."""
    lengths = _lengths(n)

    def block(flat: list[str], doc: list[int]) -> Iterator[pa.RecordBatch]:
        number: dict[str, int] = {}
        symbol = np.array([number.setdefault(t, len(number)) for t in flat], np.int64)
        found = Suffixes(symbol, np.array(doc, np.int64), max(lengths))
        for k in lengths:
            first, occurrences, records = found.intervals(k)
            if len(first):
                shown = [" ".join(flat[p : p + k]) for p in first.tolist()]
                yield _rows(shown, k, occurrences, records)

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc: list[int] = []
        flat: list[str] = []
        for batch in it:
            for terms in batch.column(1).to_pylist():
                terms = [t for t in terms if t is not None]
                doc += [(doc[-1] if doc else 0) + 1] * len(terms)
                flat += terms
                if len(flat) >= BLOCK_TERMS:
                    yield from block(flat, doc)
                    doc, flat = [], []
        if flat:
            yield from block(flat, doc)

    rows = df.select(F.col(id_col).cast("long").alias("id"), terms.alias("terms"))
    rows = once(rows.filter("id is not null")).filter("terms is not null")
    return _summed(rows.mapInArrow(count, COUNTS))


def _summed(counts: DataFrame) -> DataFrame:
    return counts.groupBy("term", "n_terms").agg(
        F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records")
    )


def n_records(df: DataFrame, id_col: str) -> int:
    """Distinct ids, those with null fields too; one number."""
    return df.select(id_col).distinct().filter(F.col(id_col).isNotNull()).count()


def marked(counts: DataFrame, records: int, rare_below: int = 3, common_part: int = 4) -> DataFrame:
    """``mark``: ``rare`` in fewer than ``rare_below`` records, ``common`` in more than
    one ``common_part``-th of all, else null. A term that is both is ``rare``."""
    mark = F.when(F.col("records") < rare_below, "rare").when(
        F.col("records") * common_part > records, "common"
    )
    return counts.withColumn("mark", mark)


def vocab_terms(vocab: str = "vocab") -> Column:
    """Upper-case hex of the bytes of every token of a vocabulary map."""
    return F.transform(F.map_values(F.col(vocab)), _hex)


def merge_terms(merges: str = "merges") -> Column:
    """Left and right bytes in upper-case hex with a space between, for every merge."""
    return F.transform(
        F.col(merges), lambda m: F.concat(_hex(m.getItem(0)), F.lit(" "), _hex(m.getItem(1)))
    )


def _hex(token: Column) -> Column:
    return F.array_join(F.transform(token, lambda b: F.lpad(F.hex(b.cast("long")), 2, "0")), "")


def term_frequencies(stories: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """``field_name, term, occurrences, records, mark`` of words, tokens and merges."""
    n_docs, n_saved = n_records(stories, "doc_id"), n_records(checkpoints, "checkpoint_id")
    fields = {
        "text": marked(word_counts(stories), n_docs),
        "vocab": marked(list_counts(checkpoints, "checkpoint_id", vocab_terms()), n_saved),
        "merges": marked(list_counts(checkpoints, "checkpoint_id", merge_terms()), n_saved),
    }
    out = None
    for name, counts in fields.items():
        rows = counts.select(
            F.lit(name).alias("field_name"), "term", "occurrences", "records", "mark"
        )
        out = rows if out is None else out.unionByName(rows)
    return out


def frequent_ngrams(stories: DataFrame, lengths: list[int], least: int = 3) -> DataFrame:
    """``term, n_terms, occurrences, records, mark`` of the n-grams of words of these lengths
    that are in ``least`` records or more, all read from one suffix array for each block."""
    counts = word_counts(stories, n=lengths).filter(F.col("records") >= least)
    return marked(counts, n_records(stories, "doc_id"))
