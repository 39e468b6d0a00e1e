"""Queries over the test tables, one for each operator, and their SQL for DuckDB."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tokenloom.functions import arrays as A
from tokenloom.functions.bytes_table import byte_order, byte_table
from tokenloom.functions.cells import symbols
from tokenloom.operators import pairs as P
from tokenloom.operators.indexed import IndexedWords
from tokenloom.operators.neural import adamw, attended, load_state, save_state, transformed
from tokenloom.operators.pretokenize import (
    chunks_of,
    lines_of,
    pretokenize,
    segment,
    word_histogram,
)
from tokenloom.operators.tokenizer import Tokenizer, make_tokenizer, register
from tokenloom.operators.train import train_bpe, train_merges, vocab
from tokenloom.sources.shared import cut, shared_dir
from tokenloom.sources.storage import (
    corpus_bytes,
    from_checkpoint,
    ids_as_json,
    ids_as_text,
    load_checkpoint,
    load_printed,
    load_words,
    read_corpus,
    save_checkpoint,
    save_printed,
    save_words,
)
from tokenloom.streaming.encode import (
    encode_chunks,
    file_stream,
    joined_streams,
    run_available,
    streaming_encode,
    streaming_words,
)

Query = Callable[[SparkSession, str], DataFrame]
SPECIALS = ["<|endoftext|>"]
MERGES = 12
VOCAB = 1 + 256 + MERGES
CHUNK = 400

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_histogram(documents(spark, sf_dir), "text", SPECIALS)


# DuckDB's expressions have neither lookahead nor possessive quantifiers: a mark before the
# last character of a run of white space that ends before something else does their work.
_W = r"\t\n\x0b\f\r\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_WORDS = rf"""regexp_extract_all(regexp_replace(seg, '([{_W}])([{_W}][^{_W}])', '\1' || chr(57344) || '\2', 'g'),
  '''(?:[sdmt]|ll|ve|re)| ?\p{{L}}+| ?\p{{N}}+| ?[^{_W}\p{{L}}\p{{N}}\x{{e000}}]+|[{_W}]+')"""
def _segments(source: str = "documents", p: str = "") -> str:
    return f"""{p}parts AS (
  SELECT doc_id, unnest(string_split(text, '<|endoftext|>')) AS seg,
         unnest(range(len(string_split(text, '<|endoftext|>')))) AS k
  FROM {source} WHERE text IS NOT NULL
), {p}segs AS (
  SELECT doc_id, 2 * k AS o, seg, false AS special FROM {p}parts WHERE seg <> ''
  UNION ALL SELECT doc_id, 2 * k - 1, '<|endoftext|>', true FROM {p}parts WHERE k > 0
), {p}segments AS (
  SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY o) - 1 AS INT) AS sp, seg, special
  FROM {p}segs
)"""


def _tokens(source: str = "documents", p: str = "", words: str = _WORDS) -> str:
    return f"""{_segments(source, p)}, {p}lists AS (
  SELECT doc_id, sp, special, CASE WHEN special THEN [seg] ELSE {words} END AS ws FROM {p}segments
), {p}words AS (
  SELECT doc_id, sp, special, unnest(ws) AS w, CAST(unnest(range(len(ws))) AS INT) AS wp FROM {p}lists
)"""


# The mark goes before the last character of white space only where that is no line end, for
# a line end closes a match of its own and is never left for the next word.
_CS336 = rf"""regexp_extract_all(regexp_replace(seg, '([{_W}])([{_W.replace(chr(92) + 'n', '').replace(chr(92) + 'r', '')}][^{_W}])', '\1' || chr(57344) || '\2', 'g'),
  '''(?:[sdmt]|ll|ve|re)|[^\r\n\p{{L}}\p{{N}}\x{{e000}}]?\p{{L}}+|\p{{N}}{{1,3}}| ?[^{_W}\p{{L}}\p{{N}}\x{{e000}}]+[\r\n]*|[{_W}]*[\r\n]|[{_W}]+')"""
_SEGMENTS, _TOKENS = _segments(), _tokens()
_CELLS = r"""CASE WHEN special THEN '<' || hex(encode(w)) || '>'
  ELSE regexp_replace(hex(encode(w)), '(..)', '<\1>', 'g') END"""
_HIST = f"""{_TOKENS}, hist AS (
  SELECT w, {_CELLS} AS cells, CAST(count(*) AS BIGINT) AS n FROM words GROUP BY ALL
)"""


def _pairs(cells: str, of: str) -> str:
    return f"""SELECT n, a[i] AS l, a[i + 1] AS r FROM (
  SELECT n, a, unnest(range(1, len(a))) AS i FROM (
    SELECT n, string_split({cells}[2:len({cells}) - 1], '><') AS a FROM {of} WHERE {cells} LIKE '%><%'))"""


_COUNTED = f"{_HIST}, pairs AS ({_pairs('cells', 'hist')}), counts AS (SELECT l, r, CAST(sum(n) AS BIGINT) AS n FROM pairs GROUP BY ALL)"
_BEST = "SELECT l, r, n FROM counts ORDER BY n DESC, l DESC, r DESC LIMIT"


def _merged_sql(merges: int) -> str:
    """Words and merges as a chain of views, one for each merge."""
    out = [_HIST, "h0 AS MATERIALIZED (SELECT w, cells, n FROM hist)"]
    for k in range(merges):
        out.append(
            f"b{k} AS MATERIALIZED (SELECT {k} AS rank, l, r, CAST(sum(n) AS BIGINT) AS n FROM ({_pairs('cells', f'h{k}')}) "
            "GROUP BY l, r ORDER BY n DESC, l DESC, r DESC LIMIT 1)"
        )
        out.append(
            f"h{k + 1} AS MATERIALIZED (SELECT w, replace(cells, '<' || l || '><' || r || '>', '<' || l || r || '>') AS cells, "
            f"h{k}.n AS n FROM h{k}, b{k})"
        )
    return ",\n".join(out)


def _ids_sql(merges: int) -> str:
    """After ``_merged_sql``: the ids of every word."""
    order = ", ".join(f"'{b:02X}'" for b in byte_order())
    made = " UNION ALL ".join(f"SELECT l || r, {257 + k} FROM b{k}" for k in range(merges))
    return f"""vocab AS (SELECT '3C7C656E646F66746578747C3E' AS t, 0 AS id
  UNION ALL SELECT unnest([{order}]), unnest(range(1, 257)) UNION ALL {made}),
tokens AS (SELECT w, unnest(string_split(cells[2:len(cells) - 1], '><')) AS t,
  unnest(range(len(string_split(cells[2:len(cells) - 1], '><')))) AS k FROM h{merges}),
word_ids AS (SELECT w, list(CAST(id AS INT) ORDER BY k) AS ids FROM tokens JOIN vocab USING (t) GROUP BY w),
coded AS (SELECT doc_id, flatten(list(ids ORDER BY sp, wp)) AS ids FROM words JOIN word_ids USING (w) GROUP BY doc_id),
encoded AS (SELECT d.doc_id, CASE WHEN text IS NULL THEN NULL ELSE coalesce(ids, CAST([] AS INT[])) END AS ids
  FROM documents d LEFT JOIN coded USING (doc_id))"""


_TRAINED = _merged_sql(MERGES)
_ENCODED = f"{_TRAINED}, {_ids_sql(MERGES)}"


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["top_k_pairs"](spark, sf_dir)


@query(f"WITH {_SEGMENTS} SELECT doc_id, sp, seg, special AS is_special FROM segments")
def special_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment(documents(spark, sf_dir), "text", SPECIALS)


@query(f"WITH {_TOKENS} SELECT doc_id, sp, wp, w, special AS is_special FROM words")
def pretokenize_gpt2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pretokenize(documents(spark, sf_dir), "text", SPECIALS)


@query(f"WITH {_tokens(words=_CS336)} SELECT doc_id, sp, wp, w, special AS is_special FROM words")
def pretokenize_cs336(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pretokenize(documents(spark, sf_dir), "text", SPECIALS, "cs336")


@query(f"WITH {_HIST} SELECT w, cells, n FROM hist")
def words_counted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histogram(spark, sf_dir)


@query(f"""WITH {_TOKENS} SELECT lang, CAST(count(DISTINCT w) AS BIGINT) AS n_words, CAST(count(*) AS BIGINT) AS n
FROM words JOIN documents USING (doc_id) GROUP BY lang""")
def distinct_words_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    each = pretokenize(rows, "text", SPECIALS).groupBy("lang", "w").agg(F.count("*").alias("n"))
    return each.groupBy("lang").agg(F.count("*").alias("n_words"), F.sum("n").alias("n"))


@query(f"""WITH {_HIST} SELECT b, CAST(sum(n) AS BIGINT) AS n FROM (
  SELECT n, unnest(string_split(cells[2:len(cells) - 1], '><')) AS b FROM hist) GROUP BY b""")
def byte_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = histogram(spark, sf_dir).select("n", F.explode(symbols(F.col("cells"))).alias("b"))
    return each.groupBy("b").agg(F.sum("n").alias("n"))


@query("""WITH b AS (SELECT CAST(i AS INT) AS byte, i BETWEEN 33 AND 126 OR i BETWEEN 161 AND 172 OR i BETWEEN 174 AND 255 AS own
  FROM range(256) t(i)), p AS (SELECT byte, own, CAST(row_number() OVER (ORDER BY NOT own, byte) - 1 AS INT) AS pos FROM b)
SELECT byte, pos, chr(CASE WHEN own THEN byte ELSE 256 + pos - 188 END) AS shown FROM p""")
def byte_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_table(spark)


@query("""WITH b AS (SELECT i, NOT (i BETWEEN 33 AND 126 OR i BETWEEN 161 AND 172 OR i BETWEEN 174 AND 255) AS hidden FROM range(256) t(i))
SELECT 0 AS id, '3C7C656E646F66746578747C3E' AS token UNION ALL
SELECT CAST(row_number() OVER (ORDER BY hidden, i) AS INT), upper(format('{:02x}', i)) FROM b""")
def initial_vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocab(spark, [], SPECIALS).select("id", F.hex("token").alias("token"))


@query(f"WITH {_COUNTED} SELECT l, r, n FROM counts")
def pair_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.pair_counts(histogram(spark, sf_dir))


@query(f"WITH {_COUNTED} SELECT l, r, n FROM counts WHERE n >= 50")
def pair_counts_min_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.pair_counts(histogram(spark, sf_dir), 50)


@query(f"WITH {_COUNTED} {_BEST} 1")
def top_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.top_pairs(P.pair_counts(histogram(spark, sf_dir)))


@query(f"WITH {_COUNTED} {_BEST} 50")
def top_k_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.top_pairs(P.pair_counts(histogram(spark, sf_dir)), 50)


_POSTINGS = f"""{_HIST}, postings AS (SELECT DISTINCT l, r, w FROM (
  SELECT w, a[i] AS l, a[i + 1] AS r FROM (SELECT w, a, unnest(range(1, len(a))) AS i FROM (
    SELECT w, string_split(cells[2:len(cells) - 1], '><') AS a FROM hist WHERE cells LIKE '%><%'))))"""


@query(f"WITH {_POSTINGS} SELECT l, r, list(w ORDER BY w) AS words FROM postings GROUP BY l, r")
def pair_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.pair_index(histogram(spark, sf_dir))


@query(f"WITH {_POSTINGS} SELECT l, r, w AS word FROM postings")
def pair_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.pair_postings(histogram(spark, sf_dir))


@query(f"WITH {_HIST} SELECT w, replace(cells, '<20><74>', '<2074>') AS cells, n FROM hist")
def merge_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.merge(histogram(spark, sf_dir), "20", "74")


_TOUCHED = f"{_HIST}, touched AS (SELECT cells, replace(cells, '<20><74>', '<2074>') AS after, n FROM hist WHERE cells LIKE '%<20><74>%')"


@query(f"""WITH {_TOUCHED} SELECT l, r, CAST(sum(d) AS BIGINT) AS d FROM (
  SELECT l, r, -n AS d FROM ({_pairs('cells', 'touched')}) UNION ALL SELECT l, r, n FROM ({_pairs('after', 'touched')}))
GROUP BY l, r HAVING sum(d) <> 0""")
def merge_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.merge_delta(histogram(spark, sf_dir), "20", "74")


@query(f"""WITH {_TOUCHED}, was AS (SELECT DISTINCT cells, l, r FROM (
  SELECT cells, a[i] AS l, a[i + 1] AS r FROM (SELECT cells, a, unnest(range(1, len(a))) AS i FROM (
    SELECT cells, string_split(cells[2:len(cells) - 1], '><') AS a FROM touched)))
), now AS (SELECT DISTINCT cells, l, r FROM (
  SELECT cells, a[i] AS l, a[i + 1] AS r FROM (SELECT cells, a, unnest(range(1, len(a))) AS i FROM (
    SELECT cells, string_split(after[2:len(after) - 1], '><') AS a FROM touched)))
) SELECT 'gone' AS side, * FROM (SELECT * FROM was EXCEPT SELECT * FROM now)
UNION ALL SELECT 'come', * FROM (SELECT * FROM now EXCEPT SELECT * FROM was)""")
def changed_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs that each touched word loses or gains."""
    # Cut, as the optimizer would else work out both lists again to see which are empty.
    rows = cut(P.changed_pairs(histogram(spark, sf_dir), "20", "74"))
    sides = [rows.select(F.lit(c).alias("side"), "cells", F.explode(c).alias("p")) for c in ("gone", "come")]
    return sides[0].unionByName(sides[1]).select("side", "cells", "p.l", "p.r")


@query(f"""WITH {_HIST}, a AS (SELECT w, replace(cells, '<20><74>', '<2074>') AS cells, n FROM hist),
after AS (SELECT w, replace(cells, '<68><65>', '<6865>') AS cells, n FROM a)
SELECT l, r, CAST(sum(d) AS BIGINT) AS d FROM (
  SELECT l, r, -n AS d FROM ({_pairs('cells', 'a')}) UNION ALL SELECT l, r, n FROM ({_pairs('cells', 'after')}))
GROUP BY l, r HAVING sum(d) <> 0""")
def indexed_merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes by the second of two merges of words with an index, which finds the words."""
    held = IndexedWords(histogram(spark, sf_dir))
    held.merge("20", "74")
    return held.merge("68", "65")


@query(f"""WITH {_HIST}, after AS (SELECT replace(cells, '<20><74>', '<2074>') AS cells, n FROM hist)
SELECT l, r, CAST(sum(n) AS BIGINT) AS n FROM ({_pairs('cells', 'after')}) GROUP BY l, r""")
def counts_after_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = histogram(spark, sf_dir)
    return P.apply_delta(P.pair_counts(words), P.merge_delta(words, "20", "74"))


@query(f"WITH {_TRAINED} " + " UNION ALL ".join(f"SELECT rank, l, r, n FROM b{k}" for k in range(MERGES)))
def train_bpe_local(spark: SparkSession, sf_dir: str) -> DataFrame:
    return train_bpe(documents(spark, sf_dir), VOCAB, SPECIALS, mode="local")[1]


@query(f"WITH {_TRAINED} " + " UNION ALL ".join(f"SELECT rank, l, r, n FROM b{k}" for k in range(MERGES)))
def train_bpe_distributed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same without the driver, with tables of the words and counts on the way."""
    return train_bpe(documents(spark, sf_dir), VOCAB, SPECIALS, mode="distributed", cut_every=5)[1]


@query(f"WITH {_TRAINED} " + " UNION ALL ".join(f"SELECT rank, l, r, n FROM b{k}" for k in range(MERGES)))
def train_bpe_resumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the merges, saved every three, then the rest by a call that finds them."""
    folder = scratch(spark)
    train_bpe(documents(spark, sf_dir), 257 + MERGES // 2, SPECIALS, workdir=folder, every=3)
    return train_bpe(documents(spark, sf_dir), VOCAB, SPECIALS, workdir=folder)[1]


@query(f"""WITH {_TRAINED} SELECT rank, l, r, n FROM b0 WHERE n >= 12000 """ + "".join(
    f"UNION ALL SELECT rank, l, r, n FROM b{k} WHERE n >= 12000 " for k in range(1, MERGES)))
def train_bpe_min_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training that ends at the first pair that is less than 12,000 frequent."""
    return train_bpe(documents(spark, sf_dir), VOCAB, SPECIALS, min_freq=12000)[1]


@query(f"WITH {_TRAINED} " + " UNION ALL ".join(
    f'SELECT rank AS "merge", l AS "left", r AS "right", n AS "count" FROM b{k}' for k in range(MERGES)))
def training_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a callback is told about each merge."""
    told: list[dict] = []
    train_bpe(documents(spark, sf_dir), VOCAB, SPECIALS, on_merge=told.append)
    return spark.createDataFrame([tuple(m.values()) for m in told], "merge int, left string, right string, count bigint")


@query()
def train_bpe_1000(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vocabulary of 1,000 tokens, too many merges to unroll in SQL."""
    return train_bpe(documents(spark, sf_dir), 1000, SPECIALS)[1]


@query()
def encode_ids_1000(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocab, merges = train_bpe(documents(spark, sf_dir), 1000, SPECIALS)
    return Tokenizer.from_frames(vocab, merges, SPECIALS).encode_frame(documents(spark, sf_dir))


def trained(spark: SparkSession, sf_dir: str) -> Tokenizer:
    words = histogram(spark, sf_dir)
    found = train_merges(words, MERGES)
    tokens = [s.encode() for s in SPECIALS] + [bytes([b]) for b in byte_order()]
    tokens += [bytes.fromhex(l + r) for _, l, r, _ in found]
    return Tokenizer(dict(enumerate(tokens)), [(bytes.fromhex(l), bytes.fromhex(r)) for _, l, r, _ in found], SPECIALS)


def encoded(spark: SparkSession, sf_dir: str, how: str = "arrow", *keep: str) -> tuple[Tokenizer, DataFrame]:
    t = trained(spark, sf_dir)
    return t, t.encode_frame(table(spark, sf_dir, "documents"), how=how, keep=keep)


_IDS = f"WITH {_ENCODED} SELECT doc_id, ids FROM encoded"


@query(_IDS)
def encode_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(spark, sf_dir)[1]


@query(_IDS)
def encode_ids_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by built-in expressions alone."""
    return encoded(spark, sf_dir, "column")[1]


@query(_IDS)
def encode_ids_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by a dictionary of the distinct words."""
    return encoded(spark, sf_dir, "words")[1]


@query(_IDS)
def encode_ids_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by a function of SQL."""
    register(spark, trained(spark, sf_dir), "query_bpe")
    documents(spark, sf_dir).createOrReplaceTempView("query_documents")
    return spark.sql("SELECT doc_id, query_bpe_encode(text) AS ids FROM query_documents")


@query(f"WITH {_ENCODED} SELECT w, ids FROM word_ids")
def word_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = pretokenize(documents(spark, sf_dir), "text", SPECIALS)
    return trained(spark, sf_dir).encode_words(words)


@query(f"WITH {_ENCODED} SELECT doc_id, '[' || array_to_string(ids, ',') || ']' AS ids FROM encoded")
def ids_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ids_as_json(encoded(spark, sf_dir)[1])


@query(f"WITH {_ENCODED} SELECT doc_id, array_to_string(ids, ' ') AS ids FROM encoded")
def ids_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ids_as_text(encoded(spark, sf_dir)[1])


@query(_IDS)
def saved_tokenizer_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids by a tokenizer that was saved as JSON and read again."""
    t, folder = trained(spark, sf_dir), scratch(spark)
    save_checkpoint(spark, folder, t.vocab, t.merges)
    return make_tokenizer(*load_checkpoint(spark, folder), SPECIALS).encode_frame(documents(spark, sf_dir))


@query(_IDS)
def printed_tokenizer_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids by a tokenizer saved in printable form, without the special token, which is added again."""
    t, folder = trained(spark, sf_dir), scratch(spark)
    plain = {k: x for k, x in t.vocab.items() if x != SPECIALS[0].encode()}
    save_printed(spark, f"{folder}/vocab", f"{folder}/merges", plain, t.merges)
    vocab, merges = load_printed(spark, f"{folder}/vocab", f"{folder}/merges", SPECIALS)
    # The added one has the last id, where the trained one has 0.
    first = {0 if x == SPECIALS[0].encode() else k: x for k, x in vocab.items()}
    return Tokenizer(first, merges, SPECIALS).encode_frame(documents(spark, sf_dir))


@query(f"WITH {_ENCODED} SELECT source, CAST(sum(len(ids)) AS BIGINT) AS n_tokens, CAST(count(*) AS BIGINT) AS n_docs FROM encoded JOIN documents USING (doc_id) GROUP BY source")
def token_counts_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.when(F.col("ids").isNotNull(), F.size("ids"))
    each = encoded(spark, sf_dir, "arrow", "source")[1].select("source", n.alias("n"))
    return each.groupBy("source").agg(F.sum("n").alias("n_tokens"), F.count("*").alias("n_docs"))


@query(f"""WITH {_ENCODED} SELECT lang, round(sum(strlen(text)) / sum(len(ids)), 6) AS bytes_per_token
FROM encoded JOIN documents USING (doc_id) WHERE ids IS NOT NULL GROUP BY lang HAVING sum(len(ids)) > 0""")
def compression_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = encoded(spark, sf_dir, "arrow", "lang", "text")[1].filter("ids is not null")
    out = each.groupBy("lang").agg(F.sum(F.octet_length("text")).alias("b"), F.sum(F.size("ids")).alias("t")).filter("t > 0")
    return out.select("lang", F.round(F.col("b") / F.col("t"), 6).alias("bytes_per_token"))


@query("SELECT doc_id, text FROM documents")
def decode_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encoded and decoded again, which gives the texts as they were."""
    t, ids = encoded(spark, sf_dir)
    return t.decode_frame(ids)


def scratch(spark: SparkSession) -> str:
    """A new folder in the shared one."""
    return f"{shared_dir(spark).rstrip('/')}/query-{uuid.uuid4().hex}"


@query("""SELECT part AS text, count(*) AS n FROM (
  SELECT unnest(string_split(text, '<|endoftext|>')) AS part FROM documents WHERE text IS NOT NULL) GROUP BY part""")
def corpus_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts written to files with the special token between them, and read again."""
    folder = scratch(spark)
    texts = documents(spark, sf_dir).filter("text is not null").select("text")
    texts.write.option("lineSep", SPECIALS[0]).text(folder)
    return read_corpus(spark, folder).groupBy("text").agg(F.count("*").alias("n"))


@query("SELECT CAST(sum(strlen(text) + 13) AS BIGINT) AS bytes FROM documents WHERE text IS NOT NULL")
def corpus_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of the files of ``corpus_files``."""
    folder = scratch(spark)
    documents(spark, sf_dir).filter("text is not null").select("text").write.option("lineSep", SPECIALS[0]).text(folder)
    return corpus_bytes(spark, folder)


@query(f"WITH {_HIST} SELECT w, cells, n FROM hist")
def words_saved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counted words saved in two parts and loaded together."""
    words, folder = histogram(spark, sf_dir).cache(), scratch(spark)
    odd = F.pmod(F.xxhash64("w"), F.lit(2))
    for k in range(2):
        save_words(words.filter(odd == k), f"{folder}/{k}")
    words.unpersist()
    return load_words(spark, f"{folder}/0", f"{folder}/1")


@query("SELECT doc_id, regexp_extract_all(text, '[^\n]*\n|[^\n]+') AS lines FROM documents")
def lines_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", lines_of(F.col("text")).alias("lines"))


@query(f"""SELECT doc_id, CAST(k AS INT) AS k, substring(text, {CHUNK} * k + 1, {CHUNK}) AS piece FROM (
  SELECT doc_id, text, unnest(range((length(text) + {CHUNK - 1}) // {CHUNK})) AS k FROM documents WHERE text IS NOT NULL)""")
def fixed_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of a fixed number of characters."""
    pieces = chunks_of(F.col("text"), CHUNK)
    return documents(spark, sf_dir).select("doc_id", F.posexplode(pieces).alias("k", "piece"))


_STREAMS = """once AS (
  SELECT stream_id, seq, max(coalesce(chunk, '')) AS chunk, max(CAST(coalesce(is_last, false) AS INT)) AS ends FROM stream_chunks
  WHERE stream_id IS NOT NULL AND seq IS NOT NULL GROUP BY ALL
), numbered AS (
  SELECT *, CAST(coalesce(sum(ends) OVER (PARTITION BY stream_id ORDER BY seq
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS story FROM once
), stories AS (
  SELECT stream_id, story, string_agg(chunk, '' ORDER BY seq) AS text, max(ends) AS ended FROM numbered GROUP BY ALL
)"""


@query(f"WITH {_STREAMS} SELECT stream_id, story, text FROM stories")
def stream_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joined_streams(table(spark, sf_dir, "stream_chunks"))


@query(f"WITH {_HIST} SELECT w, cells, n FROM hist")
def stream_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words counted by a stream over the documents."""
    texts = file_stream(spark, f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return run_available(streaming_words(texts, SPECIALS), "complete")


@query(_IDS)
def stream_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents encoded by a stream without state."""
    texts = file_stream(spark, f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return run_available(streaming_encode(texts, trained(spark, sf_dir)).select("doc_id", "ids"))


@query(f"""WITH {_TRAINED}, {_ids_sql(MERGES)}, {_STREAMS}, told AS (
  SELECT stream_id || ' ' || story AS doc_id, text FROM stories WHERE ended = 1
), {_tokens("told", "s_")}, s0 AS MATERIALIZED (
  SELECT w, any_value({_CELLS}) AS cells FROM s_words GROUP BY w
), """ + ", ".join(f"""s{k + 1} AS MATERIALIZED (
  SELECT w, replace(cells, '<' || l || '><' || r || '>', '<' || l || r || '>') AS cells FROM s{k}, b{k})""" for k in range(MERGES)) + f""",
s_tokens AS (SELECT w, unnest(string_split(cells[2:len(cells) - 1], '><')) AS t,
  unnest(range(len(string_split(cells[2:len(cells) - 1], '><')))) AS k FROM s{MERGES}),
s_ids AS (SELECT w, list(CAST(id AS INT) ORDER BY k) AS ids FROM s_tokens JOIN vocab USING (t) GROUP BY w),
s_coded AS (SELECT doc_id, flatten(list(ids ORDER BY sp, wp)) AS ids FROM s_words JOIN s_ids USING (w) GROUP BY doc_id)
SELECT stream_id, story, coalesce(ids, CAST([] AS INT[])) AS ids FROM stories
LEFT JOIN s_coded ON doc_id = stream_id || ' ' || story WHERE ended = 1""")
def stream_chunk_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stories that have ended, encoded by a stream of their chunks with state."""
    chunks = file_stream(spark, f"{sf_dir}/stream_chunks.parquet")
    parts = run_available(encode_chunks(chunks, trained(spark, sf_dir)))
    every = F.array_sort(F.collect_list(F.struct("part", "ids")))
    whole = parts.groupBy("stream_id", "story").agg(F.flatten(F.transform(every, lambda p: p["ids"])).alias("ids"), F.max("ended").alias("ended"))
    return whole.filter("ended").select("stream_id", "story", "ids")


@query("""SELECT checkpoint_id, merge_step, CAST(len(map_keys(vocab)) AS INT) AS n_tokens, CAST(len(merges) AS INT) AS n_merges
FROM (SELECT DISTINCT ON (checkpoint_id) * FROM checkpoint)""")
def checkpoint_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "checkpoint").dropDuplicates(["checkpoint_id"])
    size = lambda c: F.when(F.col(c).isNotNull(), F.size(c))
    return rows.select("checkpoint_id", "merge_step", size("vocab").alias("n_tokens"), size("merges").alias("n_merges"))


_HEX = "array_to_string(list_transform({t}, lambda b: upper(format('{{:02x}}', b))), '')".format
# The saved merges run once each, in rank order, as a fold over strings.
_SAVED = f"""chosen AS (
  SELECT vocab, list_transform(merges, lambda m: {_HEX(t='m[1]')} || ' ' || {_HEX(t='m[2]')}) AS ms FROM checkpoint
  WHERE vocab IS NOT NULL AND merges IS NOT NULL
  AND coalesce(list_bool_and(list_transform(merges, lambda m: list_contains(map_values(vocab), list_concat(m[1], m[2])))), true)
  AND len(list_distinct(list_filter(map_values(vocab), lambda t: len(t) = 1))) = 256
  ORDER BY len(merges) DESC, checkpoint_id LIMIT 1
), ids AS (
  SELECT t, max(id) AS id FROM (SELECT unnest(list_transform(map_values(vocab), lambda t: {_HEX(t='t')})) AS t,
    unnest(list_transform(map_keys(vocab), lambda k: CAST(k AS INT))) AS id FROM chosen) GROUP BY t
), lists AS (
  SELECT doc_id, {_WORDS.replace("seg,", "text,", 1)} AS ws FROM documents WHERE text IS NOT NULL
), words AS (SELECT doc_id, unnest(ws) AS w, unnest(range(len(ws))) AS wp FROM lists
), cells AS (
  SELECT w, list_reduce(list_concat([regexp_replace(hex(encode(w)), '(..)', '<\\1>', 'g')], ms), lambda a, m:
    replace(a, '<' || replace(m, ' ', '><') || '>', '<' || replace(m, ' ', '') || '>')) AS cells
  FROM (SELECT DISTINCT w FROM words), chosen
), tokens AS (
  SELECT w, unnest(string_split(cells[2:len(cells) - 1], '><')) AS t,
    unnest(range(len(string_split(cells[2:len(cells) - 1], '><')))) AS k FROM cells
), word_ids AS (SELECT w, list(id ORDER BY k) AS ids FROM tokens JOIN ids USING (t) GROUP BY w
), coded AS (SELECT doc_id, flatten(list(ids ORDER BY wp)) AS ids FROM words JOIN word_ids USING (w) GROUP BY doc_id
) SELECT doc_id, CASE WHEN text IS NULL THEN NULL ELSE coalesce(ids, CAST([] AS INT[])) END AS ids
FROM documents LEFT JOIN coded USING (doc_id)"""


@query(f"WITH {_SAVED}")
def checkpoint_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents by the tokenizer of the saved state with the most merges, of those that
    have all bytes and whatever their merges make. There is at least one in every table; without
    any the call fails."""
    made = F.expr("forall(merges, m -> array_contains(map_values(vocab), concat(m[0], m[1])))")
    single = F.size(F.array_distinct(F.filter(F.map_values("vocab"), lambda t: F.size(t) == 1))) == 256
    rows = table(spark, sf_dir, "checkpoint").filter("vocab is not null and merges is not null")
    row = rows.filter(made & single).orderBy(F.desc(F.size("merges")), "checkpoint_id").select("vocab", "merges").first()
    if row is None:
        raise ValueError("no saved state is whole")
    return Tokenizer(*from_checkpoint(row["vocab"], row["merges"])).encode_frame(documents(spark, sf_dir))


# Arithmetic on arrays, over the vectors.

_V = "list_transform(embedding, lambda x: CAST(x AS DOUBLE))"
_ROUND = "lambda x: round(x, 6)"


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")


def rounded(a: object) -> object:
    return F.transform(a, lambda x: F.round(x, 6))


@query(f"SELECT vec_id, list_transform({_V}, lambda x: round(x / (1 + exp(-x)), 6)) AS y FROM embeddings")
def silu(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir).select("vec_id", rounded(A.silu(F.col("embedding"))).alias("y"))


@query(f"""SELECT vec_id, list_transform(v, lambda x: round(x / sqrt(list_sum(list_transform(v, lambda y: y * y)) / len(v) + 1e-5), 6)) AS y
FROM (SELECT vec_id, {_V} AS v FROM embeddings)""")
def rmsnorm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir).select("vec_id", rounded(A.rmsnorm(F.col("embedding"))).alias("y"))


@query(f"""SELECT vec_id, list_transform(e, lambda x: round(x / list_sum(e), 6)) AS y FROM (
  SELECT vec_id, list_transform(v, lambda x: exp(x - list_max(v))) AS e FROM (SELECT vec_id, {_V} AS v FROM embeddings))""")
def softmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir).select("vec_id", rounded(A.softmax(F.col("embedding"))).alias("y"))


@query(f"""SELECT round(avg(list_max(v) + ln(list_sum(list_transform(v, lambda x: exp(x - list_max(v))))) - v[label % len(v) + 1]), 6) AS loss
FROM (SELECT label, {_V} AS v FROM embeddings)""")
def cross_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = F.col("label") % F.size("embedding")
    rows = vectors(spark, sf_dir).select(A.cross_entropy(F.col("embedding"), target).alias("x"))
    return rows.agg(F.round(F.avg("x"), 6).alias("loss"))


@query(f"""WITH s AS (SELECT sum(list_sum(list_transform({_V}, lambda x: x * x))) AS q FROM embeddings)
SELECT vec_id, list_transform({_V}, lambda x: round(x * CASE WHEN sqrt(q) > 1 THEN 1 / (sqrt(q) + 1e-6) ELSE 1 END, 6)) AS y
FROM embeddings, s""")
def gradient_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir)
    square = A.dot(F.col("embedding"), F.col("embedding"))
    total = v.agg(F.sum(square).alias("q")).first()["q"]
    factor = A.clip_factor(F.lit(total), 1.0)
    return v.select("vec_id", rounded(F.transform(A.doubles(F.col("embedding")), lambda x: x * factor)).alias("y"))


@query("""SELECT CAST(it AS INT) AS it, round(CASE WHEN it < 7 THEN it / 7.0 WHEN it <= 21
  THEN 0.1 + 0.5 * (1 + cos(pi() * (it - 7) / 14.0)) * 0.9 ELSE 0.1 END, 9) AS rate FROM range(25) t(it)""")
def lr_cosine_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    it = F.col("id").cast("int")
    return spark.range(25).select(it.alias("it"), F.round(A.cosine_rate(it, 1.0, 0.1, 7, 21), 9).alias("rate"))


@query(f"""SELECT o_orderkey, vec_id, list_transform({_V}, {_ROUND}) AS y FROM orders
JOIN embeddings ON vec_id = o_orderkey % (SELECT count(*) FROM embeddings)""")
def embedding_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with the vector of their number, which runs through the whole table of vectors."""
    n = table(spark, sf_dir, "embeddings").count()
    ids = table(spark, sf_dir, "orders").select("o_orderkey", F.pmod("o_orderkey", F.lit(max(n, 1))).alias("vec_id"))
    return ids.join(vectors(spark, sf_dir), "vec_id").select(
        "o_orderkey", "vec_id", rounded(A.doubles(F.col("embedding"))).alias("y")
    )


@query(f"""SELECT vec_id, list_transform(range(1, 5), lambda k: round(list_sum(list_transform(range(1, len(v) + 1),
  lambda j: v[j] * ((j * k) % 7 - 3))), 6)) AS y FROM (SELECT vec_id, {_V} AS v FROM embeddings)""")
def linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = F.transform(
        F.sequence(F.lit(1), F.lit(4)),
        lambda k: F.transform(F.sequence(F.lit(1), F.size("embedding")), lambda j: ((j * k) % 7 - 3).cast("double")),
    )
    return vectors(spark, sf_dir).select("vec_id", rounded(A.linear(rows, F.col("embedding"))).alias("y"))


def weights(rows: int, factor: int, of: int) -> Column:
    """A small matrix by a rule, ``rows`` times the length of the vectors."""
    return F.transform(
        F.sequence(F.lit(1), F.lit(rows)),
        lambda k: F.transform(F.sequence(F.lit(1), F.size("embedding")), lambda j: ((j * k * factor) % of - 3).cast("double") / 10),
    )


def _weights(rows: int, factor: int, of: int, x: str = "v") -> str:
    """The product of that matrix and a vector, in SQL."""
    return (
        f"list_transform(range(1, {rows + 1}), lambda k: list_sum(list_transform(range(1, len({x}) + 1), "
        f"lambda j: {x}[j] * ((j * k * {factor}) % {of} - 3) / 10.0)))"
    )


@query(f"""SELECT vec_id, list_transform([1, 2, 3], lambda k: round(list_sum(list_transform(range(1, 5), lambda j:
  g[j] / (1 + exp(-g[j])) * h[j] * ((j * k) % 5 - 2))), 6)) AS y
FROM (SELECT vec_id, {_weights(4, 1, 7)} AS g, {_weights(4, 3, 11)} AS h FROM (SELECT vec_id, {_V} AS v FROM embeddings))""")
def swiglu(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = F.transform(
        F.sequence(F.lit(1), F.lit(3)),
        lambda k: F.transform(F.sequence(F.lit(1), F.lit(4)), lambda j: ((j * k) % 5 - 2).cast("double")),
    )
    y = A.swiglu(weights(4, 1, 7), last, weights(4, 3, 11), F.col("embedding"))
    return vectors(spark, sf_dir).select("vec_id", rounded(y).alias("y"))


@query(f"""SELECT vec_id, list_transform(range(1, len(v) + 1), lambda i: round(
  v[i] * cos(label / pow(10000.0, (i - 1 - (i - 1) % 2) / len(v))) +
  CASE WHEN i % 2 = 1 THEN -v[i + 1] ELSE v[i - 1] END * sin(label / pow(10000.0, (i - 1 - (i - 1) % 2) / len(v))), 6)) AS y
FROM (SELECT vec_id, label, {_V} AS v FROM embeddings)""")
def rope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir).select("vec_id", rounded(A.rope(F.col("embedding"), F.col("label"))).alias("y"))


@query(f"""WITH s AS (SELECT vec_id, v, list_transform(range(1, 6), lambda k: list_sum(list_transform(range(1, len(v) + 1),
  lambda j: v[j] * ((j * k * 5) % 13 - 3) / 10.0)) / sqrt(len(v))) AS s FROM (SELECT vec_id, {_V} AS v FROM embeddings)
), e AS (SELECT vec_id, list_transform(range(1, 6), lambda k: CASE WHEN k % 3 <> 0 THEN exp(s[k] - list_max(s)) ELSE 0 END) AS e FROM s)
SELECT vec_id, list_transform([1, 2], lambda j: round(list_sum(list_transform(range(1, 6), lambda k:
  e[k] * ((j * k * 7) % 11))) / list_sum(e), 6)) AS y FROM e""")
def attention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector as a query against five keys and values, the third of which is masked."""
    five = F.sequence(F.lit(1), F.lit(5))
    values = F.transform(five, lambda k: F.array(*(((k * j * 7) % 11).cast("double") for j in (1, 2))))
    y = A.attention(F.col("embedding"), weights(5, 5, 13), values, F.transform(five, lambda k: k % 3 != 0))
    return vectors(spark, sf_dir).select("vec_id", rounded(y).alias("y"))


_SCORE = """exp(list_sum(list_transform(range(1, 5), lambda d:
  v[8 * (p // 8) + 4 * ((p % 8) // 4) + d] * v[8 * j + 4 * ((p % 8) // 4) + d])) / 2)"""


@query(f"""SELECT vec_id, list_transform(range(0, 64), lambda p: round(
  list_sum(list_transform(range(0, p // 8 + 1), lambda j: {_SCORE} * v[8 * j + p % 8 + 1])) /
  list_sum(list_transform(range(0, p // 8 + 1), lambda j: {_SCORE})), 6)) AS y FROM (SELECT vec_id, {_V} AS v FROM embeddings)""")
def multihead(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Causal attention with two heads over the eight eighths of each vector, each weight one."""
    out = attended(eighths(spark, sf_dir), dict.fromkeys("qkvo", ONE), 2)
    return out.select("vec_id", rounded(F.flatten("attended")).alias("y"))


ONE = [[float(i == j) for j in range(8)] for i in range(8)]


def eighths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors as sequences of eight vectors."""
    eighth = lambda i: F.slice(A.doubles(F.col("embedding")), i * 8 + 1, F.lit(8))
    return vectors(spark, sf_dir).withColumn("x", F.transform(F.sequence(F.lit(0), F.lit(7)), eighth))


def _normed(x: str) -> str:
    return f"""list_transform(range(0, 64), lambda p: {x}[p + 1] / sqrt(list_sum(list_transform(range(1, 9),
  lambda d: {x}[8 * (p // 8) + d] * {x}[8 * (p // 8) + d])) / 8 + 1e-5))"""


# Two turned pairs in each head; what counts is how far they are turned against each other.
_TURNED = "exp((" + " + ".join(
    f"""cos((j - p // 8) / {far}) * (n[8 * (p // 8) + {at} + 1] * n[8 * j + {at} + 1] + n[8 * (p // 8) + {at} + 2] * n[8 * j + {at} + 2]) +
  sin((j - p // 8) / {far}) * (n[8 * (p // 8) + {at} + 2] * n[8 * j + {at} + 1] - n[8 * (p // 8) + {at} + 1] * n[8 * j + {at} + 2])"""
    for far, at in (("1.0", "4 * ((p % 8) // 4)"), ("10.0", "4 * ((p % 8) // 4) + 2"))
) + ") / 2)"


@query(f"""WITH v AS (SELECT vec_id, {_V} AS v FROM embeddings), n AS (SELECT vec_id, v, {_normed('v')} AS n FROM v
), u AS (SELECT vec_id, list_transform(range(0, 64), lambda p: v[p + 1] +
  list_sum(list_transform(range(0, p // 8 + 1), lambda j: {_TURNED} * n[8 * j + p % 8 + 1])) /
  list_sum(list_transform(range(0, p // 8 + 1), lambda j: {_TURNED}))) AS u FROM n
), z AS (SELECT vec_id, u, {_normed('u')} AS z FROM u)
SELECT vec_id, list_transform(range(1, 65), lambda p: round(u[p] + z[p] * z[p] / (1 + exp(-z[p])), 6)) AS y FROM z""")
def transformer_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole block over the eight eighths of each vector, each weight one."""
    names = [*(f"attn.{n}_proj" for n in ("q", "k", "v", "output")), "ffn.w1", "ffn.w2", "ffn.w3"]
    w = {f"{n}.weight": ONE for n in names} | {f"{n}.weight": [1.0] * 8 for n in ("ln1", "ln2")}
    out = transformed(eighths(spark, sf_dir), w, 2, 100.0)
    return out.select("vec_id", rounded(F.flatten("transformed")).alias("y"))


_DRAWN = """((((CAST(doc_id AS BIGINT) * 1000003 + 7) % 2147483646 + 1) * (k + 1) % 2147483647) * 48271 % 2147483647) * 48271 % 2147483647"""


@query(f"""WITH s AS (SELECT doc_id, string_split(text, ' ') AS w FROM documents WHERE text IS NOT NULL)
SELECT doc_id, CAST(k AS INT) AS k, w[i + 1:i + 8] AS x, w[i + 2:i + 9] AS y FROM (
  SELECT doc_id, w, k, {_DRAWN} % (len(w) - 8) AS i FROM s, range(4) t(k) WHERE len(w) > 8)""")
def get_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four windows of eight words drawn from each document, and the same shifted by one."""
    rows = documents(spark, sf_dir).filter("text is not null").select("doc_id", F.split("text", " ").alias("w"))
    drawn = A.sample_batch(F.col("w"), F.col("doc_id"), 4, 8, 7)
    return rows.select("doc_id", F.posexplode(drawn).alias("k", "p")).select("doc_id", "k", "p.x", "p.y")


@query(f"""SELECT vec_id, list_transform(range(1, len(v) + 1), lambda j: round(v[j] * (1 - 0.001 * 0.01) -
  0.001 * sqrt(1 - 0.999) / (1 - 0.9) * (0.1 * v[j] * label) / (sqrt(0.001 * v[j] * label * v[j] * label) + 1e-8), 6)) AS y
FROM (SELECT vec_id, label, {_V} AS v FROM embeddings)""")
def adamw_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first step of AdamW for each vector, whose gradient is the vector times its label."""
    v = A.doubles(F.col("embedding"))
    zero, gradient = F.transform(v, lambda x: x * 0), F.transform(v, lambda x: x * F.col("label"))
    return vectors(spark, sf_dir).select("vec_id", rounded(adamw(v, gradient, zero, zero, F.lit(1))["p"]).alias("y"))


@query(f"""WITH s AS (SELECT doc_id, string_split(text, ' ') AS w FROM documents WHERE text IS NOT NULL)
SELECT doc_id, CAST(i AS INT) AS at, w[i:i + 7] AS x, w[i + 1:i + 8] AS y FROM (
  SELECT doc_id, w, unnest(range(1, len(w) - 7)) AS i FROM s WHERE len(w) > 8)""")
def get_batch_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All windows of eight tokens and the same shifted by one."""
    rows = documents(spark, sf_dir).filter("text is not null").select("doc_id", F.split("text", " ").alias("w"))
    each = rows.select("doc_id", F.posexplode(A.windows(F.col("w"), 8)).alias("at", "p"))
    return each.select("doc_id", (F.col("at") + 1).alias("at"), "p.x", "p.y")


@query(f"""WITH {_COUNTED} SELECT l, r, n, CAST(rank() OVER (PARTITION BY l ORDER BY n DESC) AS INT) AS place FROM counts""")
def pair_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = P.pair_counts(histogram(spark, sf_dir))
    return counts.withColumn("place", F.rank().over(W.partitionBy("l").orderBy(F.desc("n"))))


@query(f"SELECT vec_id, list_transform({_V}, {_ROUND}) AS p, 7 AS iteration FROM embeddings")
def optimizer_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parameters and their iteration, saved and read again."""
    folder = scratch(spark)
    save_state(vectors(spark, sf_dir).select("vec_id", A.doubles(F.col("embedding")).alias("p")), folder, 7)
    state, iteration = load_state(spark, folder)
    return state.select("vec_id", rounded(F.col("p")).alias("p"), F.lit(iteration).alias("iteration"))
