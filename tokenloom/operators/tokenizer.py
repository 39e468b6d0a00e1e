"""A trained tokenizer: encode and decode columns of a DataFrame, or single strings.

Texts are encoded where they are, without a shuffle, by an Arrow function that remembers
the pieces it has met. Where no two merges give the same bytes, running the merges once in
rank order equals always merging the pair of least rank, and a fold over built-ins does it.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterable, Iterator

import pandas as pd
import regex
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.functions.cells import symbols, to_cells
from tokenloom.functions.patterns import check_specials, python_pattern, python_specials
from tokenloom.operators.pretokenize import pretokenize, segments_of, words_of

#: Pieces that one worker remembers, and the longest such piece in characters.
REMEMBERED, LONGEST = 300_000, 40
#: Ids up to so many times the size of the vocabulary are looked up in an array.
SPARSE = 8


class Tokenizer:
    """``vocab`` maps ids to bytes, ``merges`` lists pairs of bytes in rank order.

    Of two ids with the same bytes the one that comes last counts. Specials that the
    vocabulary lacks get the next free ids if ``add_missing`` is set.
    """

    def __init__(
        self,
        vocab: dict[int, bytes],
        merges: list[tuple[bytes, bytes]],
        specials: list[str] | None = None,
        pattern: str = "gpt2",
        add_missing: bool = False,
    ) -> None:
        self.vocab = dict(vocab)
        self.merges = [(bytes(a), bytes(b)) for a, b in merges]
        self.specials = check_specials(specials)
        self.pattern = pattern
        if add_missing:
            have = set(self.vocab.values())
            for s in self.specials:
                if s.encode() not in have:
                    self.vocab[max(self.vocab, default=-1) + 1] = s.encode()
        self.ids = {t: k for k, t in self.vocab.items()}
        self.ranks = {p: k for k, p in enumerate(self.merges)}
        self._find = regex.compile(python_pattern(pattern)).findall
        self._split = python_specials(self.specials)
        self._known: dict[str, list[int]] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_known": {}}

    @classmethod
    def from_frames(cls, vocab: DataFrame, merges: DataFrame, specials: list[str] | None = None, **options: object) -> Tokenizer:
        """From the frames of ``train_bpe``; both are as small as the vocabulary."""
        tokens = {r["id"]: bytes(r["token"]) for r in vocab.orderBy("id").collect()}
        pairs = [(bytes.fromhex(r["l"]), bytes.fromhex(r["r"])) for r in merges.orderBy("rank").collect()]
        return cls(tokens, pairs, specials, **options)

    # One string at a time.

    def segments(self, text: str) -> Iterator[tuple[bool, str]]:
        at = 0
        for m in self._split.finditer(text) if self._split else ():
            if m.start() > at:
                yield False, text[at : m.start()]
            yield True, m.group()
            at = m.end()
        if at < len(text):
            yield False, text[at:]

    def pieces(self, text: str) -> list[tuple[bool, str]]:
        return [
            (special, p)
            for special, seg in self.segments(text)
            for p in ([seg] if special else self._find(seg))
            if p
        ]

    def encode_piece(self, piece: str) -> list[int]:
        """Ids of a plain piece, remembered for its next occurrence."""
        known = self._known.get(piece)
        if known is None:
            known = self._merged(piece)
            if len(piece) <= LONGEST:
                if len(self._known) >= REMEMBERED:
                    self._known.clear()
                self._known[piece] = known
        return known

    def _merged(self, piece: str) -> list[int]:
        """Always merges the leftmost pair of least rank, until there is none.

        The parts are a linked list and the pairs wait in a heap, so a piece of n bytes
        takes n log n steps. An entry counts only while its two parts are as they were.
        """
        parts: list[bytes | None] = [bytes([b]) for b in piece.encode("utf-8", "surrogatepass")]
        n, ranks = len(parts), self.ranks
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(ranks[p], k, *p) for k, p in enumerate(zip(parts, parts[1:])) if p in ranks]
        heapq.heapify(heap)
        while heap:
            _, k, left, right = heapq.heappop(heap)
            other = after[k]
            if parts[k] != left or other >= n or parts[other] != right:
                continue
            parts[k], parts[other] = left + right, None
            after[k] = after[other]
            if after[k] < n:
                before[after[k]] = k
            for low, high in ((before[k], k), (k, after[k])):
                if low >= 0 and high < n and (pair := (parts[low], parts[high])) in ranks:
                    heapq.heappush(heap, (ranks[pair], low, *pair))
        return [self.ids[p] for p in parts if p is not None]

    def encode(self, text: str) -> list[int]:
        return [
            i
            for special, p in self.pieces(text)
            for i in ([self.ids[p.encode()]] if special else self.encode_piece(p))
        ]

    def decode(self, ids: Iterable[int]) -> str:
        return b"".join(self.vocab[i] for i in ids).decode("utf-8", "replace")

    def encode_iterable(self, chunks: Iterable[str], strict: bool = True) -> Iterator[int]:
        """Ids of the joined chunks, given as soon as they are certain.

        Two pieces and whatever may begin a special token are held back, so the result is
        that of ``encode``. With ``strict=False`` each chunk's pieces are given at once,
        as far as no special token may have begun.
        """
        held = ""
        for chunk in chunks:
            held += chunk
            ids, held = self.advance(held, strict)
            yield from ids
        yield from self.encode(held)

    def advance(self, held: str, strict: bool = True) -> tuple[list[int], str]:
        """Ids that are certain, and the text that must wait."""
        safe = self._safe(held)
        ready, at = [], 0
        for special, p in self.pieces(held):
            if at + len(p) > safe:
                break
            ready.append((special, p))
            at += len(p)
        if strict:
            ready = ready[:-2]
        done = sum(len(p) for _, p in ready)
        ids = [
            i
            for special, p in ready
            for i in ([self.ids[p.encode()]] if special else self.encode_piece(p))
        ]
        return ids, held[done:]

    def _safe(self, text: str) -> int:
        longest = max(map(len, self.specials), default=0)
        for k in range(max(0, len(text) - longest), len(text)):
            if any(s.startswith(text[k:]) and s != text[k:] for s in self.specials):
                return k
        return len(text)

    # Columns.

    @property
    def rank_safe(self) -> bool:
        """Whether the merges may be run once each, in order."""
        made = {bytes([b]) for b in range(256)}
        for a, b in self.merges:
            if a not in made or b not in made or a + b in made:
                return False
            made.add(a + b)
        return True

    def merge_column(self, cells: Column) -> Column:
        """Cells after all merges, as a fold over built-ins."""
        if not self.merges:
            return cells
        hexed = ((a.hex().upper(), b.hex().upper()) for a, b in self.merges)
        rows = constant([{"f": f"<{a}><{b}>", "t": f"<{a}{b}>"} for a, b in hexed], "array<struct<f:string,t:string>>")
        return F.aggregate(rows, cells, lambda acc, m: F.replace(acc, m["f"], m["t"]))

    def ids_column(self, cells: Column) -> Column:
        """Ids of merged cells; a token that the vocabulary lacks is an error.

        The tokens lie in buckets by their hash, one for each token on average, so a token
        is found in a step or two and not by a search through the vocabulary.
        """
        n = max(1, len(self.ids))
        buckets: list[list[dict]] = [[] for _ in range(n)]
        for t, i in self.ids.items():
            shown = t.hex().upper()
            h = xxhash.xxh64_intdigest(shown.encode(), seed=42)
            buckets[(h - (1 << 64) if h >> 63 else h) % n].append({"t": shown, "i": i})
        table = constant(buckets, "array<array<struct<t:string,i:int>>>")
        missing = lambda t: F.raise_error(F.concat(F.lit("no id for token "), t)).cast("int")

        def id_of(t: Column) -> Column:
            held = F.get(table, F.pmod(F.xxhash64(t), F.lit(n)).cast("int"))
            found = F.get(F.filter(held, lambda e: e["t"] == t), F.lit(0))
            return F.coalesce(found["i"], missing(t))

        return F.transform(symbols(cells), id_of)

    def text_column(self, text: Column) -> Column:
        """Ids of whole texts, as one expression of built-ins; needs ``rank_safe``."""

        def of(seg: Column) -> Column:
            words = words_of(seg, self.pattern)
            plain = F.flatten(F.transform(words, lambda w: self.ids_column(self.merge_column(to_cells(w)))))
            for s in self.specials:
                plain = F.when(seg == s, F.array(F.lit(self.ids[s.encode()]))).otherwise(plain)
            return plain

        return F.flatten(F.transform(segments_of(text, self.specials), of))

    def encode_words(self, words: DataFrame) -> DataFrame:
        """``w, ids`` of the distinct words of ``words (w, is_special)``."""
        one = self

        @F.pandas_udf("array<int>")
        def encode(w: pd.Series, special: pd.Series) -> pd.Series:
            return pd.Series([
                [one.ids[p.encode()]] if s else one.encode_piece(p) for p, s in zip(w, special)
            ])

        distinct = words.select("w", "is_special").distinct()
        return distinct.select("w", encode("w", "is_special").alias("ids"))

    def encode_frame(
        self, df: DataFrame, id_col: str = "doc_id", text: str = "text", how: str = "arrow", keep: Iterable[str] = ()
    ) -> DataFrame:
        """``id_col, ids`` of every row, and the columns to ``keep`` between them. An empty text
        gives an empty array, null gives null.

        ``how`` is ``arrow``, ``column`` (built-ins only, slower, needs ``rank_safe``) or
        ``words`` (distinct words are encoded once and joined back, for slow tokenizers and
        few distinct words); all give the same. Repeated rows stay.
        """
        keep = list(keep)
        if how == "column":
            return df.select(F.col(id_col), *keep, self.text_column(F.col(text)).alias("ids"))
        if how == "arrow":
            one = self

            @F.pandas_udf("array<int>")
            def encode(t: pd.Series) -> pd.Series:
                return pd.Series([None if x is None else one.encode(x) for x in t], dtype=object)

            return df.select(F.col(id_col), *keep, encode(F.col(text)).alias("ids"))
        if how != "words":
            raise ValueError(f"how must be column, arrow or words, not {how!r}")
        held = F.struct(F.col(id_col).alias("id"), *(F.col(c).alias(f"k{k}") for k, c in enumerate(keep)))
        rows = df.select(held.alias("id"), F.col(text).alias("text"))
        # The number of a row is made and used in one branch only, so it can't differ between two.
        some = rows.filter("text <> ''").withColumn("row", F.monotonically_increasing_id())
        words = pretokenize(some, "text", self.specials, self.pattern)
        coded = words.join(self.encode_words(words), "w")
        parts = F.array_sort(F.collect_list(F.struct("sp", "wp", "ids")))
        whole = coded.groupBy("row", "id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))
        empty = F.when(F.col("text") == "", F.array().cast("array<int>"))
        none = rows.filter("text is null or text = ''").select("id", empty.alias("ids"))
        every = whole.select("id", "ids").unionByName(none)
        kept = (F.col(f"id.k{k}").alias(c) for k, c in enumerate(keep))
        return every.select(F.col("id.id").alias(id_col), *kept, "ids")

    def decode_frame(self, df: DataFrame, id_col: str = "doc_id", ids: str = "ids", keep: Iterable[str] = ()) -> DataFrame:
        """``id_col, text``: the texts of arrays of ids, and the columns to ``keep`` between
        them; broken UTF-8 becomes U+FFFD and an unknown id is an error.

        The tokens are an array by id, so one is found in one step. Ids far above the size
        of the vocabulary are decoded by an Arrow function instead.
        """
        most = max(self.vocab, default=-1)
        if min(self.vocab, default=0) < 0 or most >= SPARSE * (len(self.vocab) + 1000):
            one = self

            @F.pandas_udf("string")
            def decode(lists: pd.Series) -> pd.Series:
                return pd.Series([None if x is None else one.decode(x) for x in lists], dtype=object)

            return df.select(F.col(id_col), *keep, decode(F.col(ids)).alias("text"))
        shown = [t.hex().upper() if (t := self.vocab.get(i)) is not None else None for i in range(most + 1)]
        held = constant(shown, "array<string>")
        missing = lambda i: F.raise_error(F.concat(F.lit("no token for id "), i.cast("string"))).cast("string")
        tokens = F.transform(F.col(ids), lambda i: F.coalesce(F.get(held, i), missing(i)))
        raw = F.unhex(F.array_join(tokens, ""))
        return df.select(F.col(id_col), *keep, F.make_valid_utf8(raw.cast("string")).alias("text"))


def constant(value: object, kind: str) -> Column:
    """A constant of any size as one literal, which the optimizer reads once."""
    return F.from_json(F.lit(json.dumps(value)), kind)


def make_tokenizer(
    vocab: dict[int, bytes], merges: list[tuple[bytes, bytes]], specials: list[str] | None = None
) -> Tokenizer:
    return Tokenizer(vocab, merges, specials)


def register(spark: SparkSession, tokenizer: Tokenizer, prefix: str = "bpe") -> None:
    """SQL functions ``bpe_encode(text)`` and ``bpe_decode(ids)``."""

    @F.pandas_udf("array<int>")
    def encode(text: pd.Series) -> pd.Series:
        return text.map(lambda t: None if t is None else tokenizer.encode(t))

    @F.pandas_udf("string")
    def decode(ids: pd.Series) -> pd.Series:
        return ids.map(lambda x: None if x is None else tokenizer.decode(x.tolist() if hasattr(x, "tolist") else x))

    spark.udf.register(f"{prefix}_encode", encode)
    spark.udf.register(f"{prefix}_decode", decode)
