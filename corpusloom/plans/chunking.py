"""Queries that cut documents into chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import chunk
from corpusloom.plans.base import query
from corpusloom.sources.tables import spread, table

FIXED = """chunks AS (SELECT doc_id, i AS chunk_index, substr(text, i * 3000 + 1, 3000) AS text, doc_id || '-' || i AS chunk_id
  FROM documents, unnest(range(0, ceil(length(text) / 3000)::BIGINT)) AS t(i))"""


def fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = chunk.chunk_fixed(spread(table(spark, sf_dir, "documents")))
    return cut.select("doc_id", "chunk_index", F.col("chunk_text").alias("text"), F.concat_ws("-", "doc_id", "chunk_index").alias("chunk_id"))


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query()
def chunk_recursive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk.chunk_recursive(_docs(spark, sf_dir))


@query(f"WITH {FIXED} SELECT doc_id, chunk_index, text FROM chunks")
def chunk_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixed(spark, sf_dir).select("doc_id", "chunk_index", "text")


@query(
    r"""WITH p AS (SELECT doc_id, list_filter(list_transform(string_split(replace(text, '. ', '.' || chr(10) || chr(10)), chr(10) || chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: length(x) > 0) AS l FROM documents)
SELECT doc_id, (i - 1)::INT AS paragraph_number, l[i] AS text FROM p, unnest(range(1, len(l) + 1)) AS t(i)"""
)
def split_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each sentence made a paragraph: the corpus has no empty lines."""
    return chunk.split_paragraphs(_docs(spark, sf_dir).withColumn("text", F.replace("text", F.lit(". "), F.lit(".\n\n"))))


@query()
def chunk_semantic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk.chunk_semantic(_docs(spark, sf_dir))


@query(
    r"""WITH s AS (SELECT doc_id, list_filter(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: length(x) > 0) AS l FROM documents)
SELECT doc_id, (i - 1)::INT AS sentence, l[i] AS text FROM s, unnest(range(1, len(l) + 1)) AS t(i)"""
)
def split_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk.split_sentences(_docs(spark, sf_dir))


@query(f"WITH {FIXED} SELECT sha256(text) AS hash, count(*) AS copies, min(chunk_id) AS first_chunk FROM chunks GROUP BY text HAVING count(*) > 1")
def chunk_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk.duplicate_chunks(fixed(spark, sf_dir))


@query(f"WITH {FIXED} SELECT chunk_id, lag(chunk_id) OVER w AS previous_chunk, lead(chunk_id) OVER w AS next_chunk FROM chunks WINDOW w AS (PARTITION BY doc_id ORDER BY chunk_index)")
def link_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk.link_neighbors(fixed(spark, sf_dir)).select("chunk_id", "previous_chunk", "next_chunk")


@query(
    f"""WITH RECURSIVE {FIXED}, c AS (SELECT doc_id, chunk_id, c.text AS t, d.text AS d, row_number() OVER (PARTITION BY doc_id ORDER BY chunk_index) AS i FROM chunks c JOIN documents d USING (doc_id)),
w AS (SELECT doc_id, ''::VARCHAR AS chunk_id, 0::BIGINT AS i, 0::BIGINT AS upto, -1::BIGINT AS start, 0::BIGINT AS n FROM (SELECT DISTINCT doc_id FROM c)
UNION ALL SELECT doc_id, chunk_id, i, CASE WHEN pos > 0 THEN upto + pos ELSE upto END, CASE WHEN pos > 0 THEN upto + pos - 1 ELSE -1 END, n
FROM (SELECT c.doc_id, c.chunk_id, c.i, w.upto, instr(substr(d, w.upto + 1), t) AS pos, length(t) AS n FROM w JOIN c ON c.doc_id = w.doc_id AND c.i = w.i + 1))
SELECT chunk_id, greatest(start, 0)::INT AS "start", (CASE WHEN start >= 0 THEN start + n ELSE 0 END)::INT AS "end" FROM w WHERE i > 0"""
)
def chunk_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk.chunk_offsets(fixed(spark, sf_dir), _docs(spark, sf_dir)).select("chunk_id", "start", "end")


@query(
    rf"""WITH {FIXED} SELECT doc_id, count(*) AS chunks, sum(len(regexp_extract_all(text, '[^\s]+')))::BIGINT AS words, min(length(text))::INT AS min_chars,
round(avg(length(text)), 6) AS avg_chars, max(length(text))::INT AS max_chars FROM chunks GROUP BY doc_id"""
)
def chunk_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk.chunk_profile(fixed(spark, sf_dir), F.col("text"))
