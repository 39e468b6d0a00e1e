"""Queries of the training-data operators, each over its whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.llm import bpe, encoding, neardup, packing, pieces, repetition, subjects, terms
from tokenloom.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.repetitive_records(table(spark, sf_dir, "tinystories_sample"))


def p1_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and repeated share of every record, also of those that the bands call plain."""
    measured = repetition.repetition(table(spark, sf_dir, "tinystories_sample"))
    words = F.coalesce("n_words", F.lit(0)).alias("n_words")
    return measured.filter("doc_id is not null").select("doc_id", words, F.round("repeated_share", 6).alias("repeated_share")).distinct()


def p1_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratios, band and verdict of every record, and the share where it had to be counted."""
    measured = repetition.repetition(table(spark, sf_dir, "tinystories_sample"), count_all=False)
    return measured.filter("doc_id is not null").distinct()


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p2_pieces(spark, sf_dir).filter("piece > 0").select("run_id", "doc_id").distinct()


def p2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.oversized_pieces(
        table(spark, sf_dir, "tinystories_sample"), table(spark, sf_dir, "train_bpe")
    )


def p2_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces put together again, and whether all are within the limit of the run."""
    train = table(spark, sf_dir, "train_bpe").select("run_id", F.coalesce("stream_chunk_chars", F.lit(pieces.DEFAULT_LIMIT)).alias("most")).distinct()
    rows = pieces.joined_pieces(p2_pieces(spark, sf_dir)).join(train, "run_id")
    return rows.select("run_id", "doc_id", "text", (F.col("longest") <= F.col("most")).alias("within"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding.restored(table(spark, sf_dir, "tinystories_sample")).select("doc_id").distinct()


def p3_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding.restored(table(spark, sf_dir, "tinystories_sample")).distinct()


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p4_counts(spark, sf_dir).filter("mark is not null").select("field_name", "term", "mark")


def p4_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return terms.term_frequencies(
        table(spark, sf_dir, "tinystories_sample"), table(spark, sf_dir, "checkpoint")
    )


def p4_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The n-grams of one to five words that are not rare."""
    return terms.frequent_ngrams(table(spark, sf_dir, "tinystories_sample"), [1, 2, 3, 4, 5])


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicate_pairs(table(spark, sf_dir, "tinystories_sample"))


def p5_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicate_classes(table(spark, sf_dir, "tinystories_sample"))


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.token_ids(table(spark, sf_dir, "documents"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that the packing had to split."""
    return p7_containers(spark, sf_dir).filter("piece > 0").select("doc_id").distinct()


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def p7_placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each document lies whole in containers that are not overfull."""
    return packing.placed(p7_containers(spark, sf_dir))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p8_subjects(spark, sf_dir).select("doc_id", "subject").distinct()


def p8_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subjects.subjects_of(
        table(spark, sf_dir, "documents"),
        table(spark, sf_dir, "subject_labels"),
        table(spark, sf_dir, "subjects"),
    )


QUERIES: dict[str, Query] = {
    "p1_found": p1_found,
    "p1_shares": p1_shares,
    "p1_bands": p1_bands,
    "p2_found": p2_found,
    "p2_pieces": p2_pieces,
    "p2_joined": p2_joined,
    "p3_found": p3_found,
    "p3_restored": p3_restored,
    "p4_found": p4_found,
    "p4_counts": p4_counts,
    "p4_ngrams": p4_ngrams,
    "p5_found": p5_found,
    "p5_classes": p5_classes,
    "p6_ids": p6_ids,
    "p7_found": p7_found,
    "p7_containers": p7_containers,
    "p7_placed": p7_placed,
    "p8_found": p8_found,
    "p8_subjects": p8_subjects,
}

_RECORDS = """r AS (
  SELECT doc_id, any_value(text) AS text FROM tinystories_sample
  WHERE doc_id IS NOT NULL GROUP BY doc_id
), w AS (
  SELECT doc_id, list_transform(regexp_extract_all(text, '\\p{L}+'), lambda x: lower(x)) AS w
  FROM r WHERE text IS NOT NULL
)"""

_REPEATED = f"""WITH {_RECORDS}, t AS (
  SELECT doc_id, unnest(w) AS t, unnest(range(1, len(w) + 1)) AS i FROM w
), g AS (
  SELECT doc_id, i, t || ' ' || lead(t, 1) OVER o || ' ' || lead(t, 2) OVER o || ' ' ||
    lead(t, 3) OVER o || ' ' || lead(t, 4) OVER o || ' ' || lead(t, 5) OVER o AS g
  FROM t WINDOW o AS (PARTITION BY doc_id ORDER BY i)
), m AS (
  SELECT doc_id, i, row_number() OVER (PARTITION BY doc_id, g ORDER BY i) AS k
  FROM g WHERE g IS NOT NULL
), c AS (
  SELECT doc_id, count(DISTINCT i + d) AS again FROM m, range(0, 6) AS t(d)
  WHERE k > 1 GROUP BY doc_id
)"""

_COUNTS = f"""WITH {_RECORDS}, terms AS (
  SELECT 'text' AS field_name, doc_id AS id, unnest(w) AS term FROM w
  UNION ALL
  SELECT 'vocab', checkpoint_id, unnest(list_transform(map_values(vocab), lambda t:
    array_to_string(list_transform(t, lambda b: upper(format('{{:02x}}', b))), '')))
  FROM (SELECT checkpoint_id, any_value(vocab) AS vocab FROM checkpoint GROUP BY ALL)
  UNION ALL
  SELECT 'merges', checkpoint_id, unnest(list_transform(merges, lambda m:
    array_to_string(list_transform(m, lambda t:
      array_to_string(list_transform(t, lambda b: upper(format('{{:02x}}', b))), '')), ' ')))
  FROM (SELECT checkpoint_id, any_value(merges) AS merges FROM checkpoint GROUP BY ALL)
), n AS (
  SELECT (SELECT count(DISTINCT doc_id) FROM tinystories_sample) AS docs,
         (SELECT count(DISTINCT checkpoint_id) FROM checkpoint) AS saved
), counted AS (
  SELECT field_name, term, count(*) AS occurrences, count(DISTINCT id) AS records
  FROM terms GROUP BY ALL
), marked AS (
  SELECT field_name, term, occurrences, records, CASE WHEN records < 3 THEN 'rare'
    WHEN records * 4 > CASE field_name WHEN 'text' THEN docs ELSE saved END THEN 'common' END AS mark
  FROM counted, n
)"""

SQL: dict[str, str] = {
    "p1_found": f"""{_REPEATED} SELECT doc_id FROM c JOIN w USING (doc_id)
WHERE again * 10 >= len(w) * 3""",
    "p1_shares": f"""{_REPEATED} SELECT doc_id, CAST(coalesce(len(w), 0) AS BIGINT) AS n_words,
  CASE WHEN text IS NOT NULL THEN round(coalesce(again, 0) / greatest(len(w), 1), 6) END AS repeated_share
FROM r LEFT JOIN w USING (doc_id) LEFT JOIN c USING (doc_id)""",
    "p2_found": """SELECT DISTINCT run_id, doc_id FROM tinystories_sample
JOIN train_bpe USING (input_path)
WHERE strlen(text) > coalesce(stream_chunk_chars, 1000000)""",
    "p2_joined": """SELECT DISTINCT run_id, doc_id, text, true AS within FROM tinystories_sample
JOIN train_bpe USING (input_path)
WHERE strlen(text) > coalesce(stream_chunk_chars, 1000000)""",
    "p7_placed": "SELECT doc_id, true AS placed FROM documents",
    "p4_found": f"{_COUNTS} SELECT field_name, term, mark FROM marked WHERE mark IS NOT NULL",
    "p4_counts": f"{_COUNTS} SELECT field_name, term, occurrences, records, mark FROM marked",
    "p4_ngrams": f"""WITH {_RECORDS}, n AS (SELECT unnest(range(1, 6)) AS n), g AS (
  SELECT doc_id, n, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))) AS term
  FROM w, n WHERE len(w) >= n
), counted AS (
  SELECT term, CAST(n AS INT) AS n_terms, count(*) AS occurrences, count(DISTINCT doc_id) AS records FROM g GROUP BY term, n
)
SELECT term, n_terms, occurrences, records,
  CASE WHEN records * 4 > (SELECT count(DISTINCT doc_id) FROM tinystories_sample) THEN 'common' END AS mark
FROM counted WHERE records >= 3""",
    "p5_classes": f"""WITH {_RECORDS}, s AS (
  SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - 1), lambda i:
    array_to_string(w[i:i + 2], ' '))) AS s FROM w WHERE len(w) >= 20
), c AS (
  SELECT doc_id, min(doc_id) OVER (PARTITION BY list_sort(list(s))) AS class_id, count(*) AS n FROM s GROUP BY doc_id
), m AS (SELECT class_id AS doc_id, s FROM c JOIN s USING (doc_id) WHERE doc_id = class_id
), o AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM m a JOIN m b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL
), l AS (
  SELECT a AS class_id, count(*) AS links FROM o JOIN c x ON a = x.doc_id JOIN c y ON b = y.doc_id
  WHERE 100 * o >= 60 * (x.n + y.n - o) GROUP BY a
)
SELECT doc_id, class_id, coalesce(links, 0) AS links FROM c LEFT JOIN l USING (class_id)""",
    "p5_found": f"""WITH {_RECORDS}, s AS (
  SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - 1), lambda i:
    array_to_string(w[i:i + 2], ' '))) AS s FROM w WHERE len(w) >= 20
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id)
, o AS (
  SELECT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b, count(*) AS o
  FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL
)
SELECT doc_id_a, doc_id_b FROM o JOIN n x ON doc_id_a = x.doc_id JOIN n y ON doc_id_b = y.doc_id
WHERE 100 * o >= 60 * (x.n + y.n - o)""",
}
