"""Texts that come in pieces: word counts and ids of streams."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tokenloom.operators.pretokenize import word_histogram
from tokenloom.operators.tokenizer import Tokenizer
from tokenloom.sources.shared import shared_dir

EMITTED = "stream_id string, part bigint, story bigint, ids array<int>, ended boolean"
STATE = "buf string, next bigint, part bigint, story bigint, waiting array<struct<seq:bigint,chunk:string,is_last:boolean>>"
#: The state store that processors with state need.
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Chunks of a stream whose story ends are counted by one task at once.
BLOCK = 10_000


def streaming_words(stream: DataFrame, specials: list[str] | None = None, pattern: str = "gpt2") -> DataFrame:
    """The word histogram of a stream of texts, for output mode ``complete``."""
    return word_histogram(stream, "text", specials, pattern)


def streaming_encode(stream: DataFrame, tokenizer: Tokenizer, text: str = "text") -> DataFrame:
    """Ids of every text of a stream, one row each, without state."""

    @F.pandas_udf("array<int>")
    def encode(t: pd.Series) -> pd.Series:
        return t.map(lambda x: None if x is None else tokenizer.encode(x))

    return stream.withColumn("ids", encode(text))


class ChunkEncoder(StatefulProcessor):
    """Encodes the chunks of each stream in the order of ``seq``.

    A chunk that comes early waits for those before it, one that comes twice is dropped. A
    null chunk is empty. ``is_last`` ends the text, so that the rest is given out; the next
    chunk begins another one. With ``patience``, in seconds, a stream that has waited so
    long for a missing chunk goes on without it, so that what waits does not grow for ever.
    """

    def __init__(self, tokenizer: Tokenizer, strict: bool = True, patience: float | None = None) -> None:
        self.tokenizer, self.strict, self.patience = tokenizer, strict, patience

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", STATE)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timer_values: object) -> Iterator[pd.DataFrame]:
        at, held = self._read()
        for frame in rows:
            for seq, chunk, last in zip(frame["seq"], frame["chunk"], frame["is_last"]):
                if seq >= at["next"] and seq not in held:
                    held[int(seq)] = (chunk if isinstance(chunk, str) else "", last is True or last == True)  # noqa: E712
        if self.patience is not None and held and at["next"] not in held and not list(self.handle.listTimers()):
            now = timer_values.getCurrentProcessingTimeInMs()
            self.handle.registerTimer(now + int(1000 * self.patience))
        yield from self._advanced(key, at, held)

    def handleExpiredTimer(self, key: tuple, timer_values: object, expired: object) -> Iterator[pd.DataFrame]:
        at, held = self._read()
        if held:
            at["next"] = at["next"] if at["next"] in held else min(held)
            yield from self._advanced(key, at, held)

    def _read(self) -> tuple[dict, dict[int, tuple[str, bool]]]:
        buf, after, part, story, waiting = self.state.get() if self.state.exists() else ("", 0, 0, 0, [])
        return {"buf": buf, "next": after, "part": part, "story": story}, {w[0]: (w[1], w[2]) for w in waiting or []}

    def _advanced(self, key: tuple, at: dict, held: dict[int, tuple[str, bool]]) -> Iterator[pd.DataFrame]:
        out: list[tuple[int, list[int], bool]] = []
        ids: list[int] = []
        while at["next"] in held:
            chunk, last = held.pop(at["next"])
            at["next"] += 1
            buf = at["buf"] + chunk
            if last:
                out.append((at["story"], ids + self.tokenizer.encode(buf), True))
                ids, at["buf"] = [], ""
                at["story"] += 1
            else:
                more, at["buf"] = self.tokenizer.advance(buf, self.strict)
                ids += more
        if ids:
            out.append((at["story"], ids, False))
        first = at["part"]
        at["part"] += len(out)
        self.state.update((*at.values(), [(s, c, e) for s, (c, e) in sorted(held.items())]))
        if out:
            story, lists, ended = zip(*out)
            yield pd.DataFrame(
                {"stream_id": key[0], "part": range(first, at["part"]), "story": story, "ids": list(lists), "ended": ended}
            )

    def close(self) -> None:
        pass


def encode_chunks(
    stream: DataFrame, tokenizer: Tokenizer, strict: bool = True, patience: float | None = None
) -> DataFrame:
    """``stream_id, part, story, ids, ended`` of a stream of ``stream_id, seq, chunk, is_last``;
    ``seq`` counts from 0. The parts of a stream, in order, are the ids of its texts, the
    stories, and ``ended`` tells the last part of one."""
    rows = stream.select("stream_id", "seq", "chunk", "is_last").filter("stream_id is not null and seq is not null")
    return rows.groupBy("stream_id").transformWithStateInPandas(
        ChunkEncoder(tokenizer, strict, patience), EMITTED, "append", "none" if patience is None else "ProcessingTime"
    )


def file_stream(spark: SparkSession, path: str) -> DataFrame:
    """A stream of a Parquet table: a folder, into which files may still come, or one file."""
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path}*")


def run_available(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Runs a stream over all that is there now and gives its result as a table in the shared
    folder: what was appended, or the last complete result."""
    spark = stream.sparkSession
    base = f"{shared_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    out = f"{base}/out"
    kept = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    try:
        writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").trigger(availableNow=True)
        if mode == "complete":
            run = writer.foreachBatch(lambda rows, _: rows.write.mode("overwrite").parquet(out)).start()
        else:
            run = writer.format("parquet").option("path", out).start()
        run.awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", kept)
    return spark.read.schema(stream.schema).parquet(out)


def stories(chunks: DataFrame) -> DataFrame:
    """``stream_id, story, seq, chunk``: every chunk once, with the number of the text of its
    stream that it belongs to. ``is_last`` ends a text. Of chunks delivered twice the greatest
    text counts, and a null one is empty.

    Ends are counted in blocks of chunks and then over the blocks, so that no stream has
    to fit into one task.
    """
    once = chunks.filter("stream_id is not null and seq is not null").groupBy("stream_id", "seq").agg(
        F.max(F.coalesce("chunk", F.lit(""))).alias("chunk"), F.max(F.coalesce("is_last", F.lit(False)).cast("int")).alias("ends")
    )
    once = once.withColumn("block", F.floor(F.col("seq") / BLOCK))
    blocks = once.groupBy("stream_id", "block").agg(F.sum("ends").alias("ends"))
    earlier = W.partitionBy("stream_id").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    blocks = blocks.select("stream_id", "block", F.coalesce(F.sum("ends").over(earlier), F.lit(0)).alias("before"))
    inside = W.partitionBy("stream_id", "block").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    counted = once.withColumn("here", F.coalesce(F.sum("ends").over(inside), F.lit(0))).join(blocks, ["stream_id", "block"])
    return counted.select("stream_id", (F.col("before") + F.col("here")).alias("story"), "seq", "chunk")


def joined_streams(chunks: DataFrame) -> DataFrame:
    """``stream_id, story, text``: the texts of every stream of a table of chunks.

    A chunk delivered twice counts once, a null one is empty.
    """
    parts = F.array_sort(F.collect_list(F.struct("seq", "chunk")))
    return stories(chunks).groupBy("stream_id", "story").agg(
        F.array_join(F.transform(parts, lambda p: p["chunk"]), "").alias("text")
    )
