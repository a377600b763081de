"""Cleaning and understanding of documents given as pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.functions import text as T


def repeated_edge_lines(pages: DataFrame, min_share: float = 0.5) -> DataFrame:
    """(doc, line): lines among the first two (headers) or last two (footers) non-blank ones on at least
    max(2, share of pages) pages; documents with three pages or more only."""
    lines = F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(x)), lambda x: F.length(x) > 0)
    edges = pages.select("doc", "page", lines.alias("lines"))
    zone = lambda name, part: F.transform(F.array_distinct(part), lambda x: F.struct(F.lit(name).alias("zone"), x.alias("line")))
    both = F.concat(zone("header", F.slice("lines", 1, 2)), zone("footer", F.slice("lines", F.greatest(F.size("lines") - 1, F.lit(1)), F.lit(2))))
    # A page gives four lines at most to the count; its text stays where it is.
    marked = edges.select("doc", F.explode(both).alias("e"))
    counted = marked.groupBy("doc", "e.zone", "e.line").agg(F.count("*").alias("n"))
    sizes = pages.groupBy("doc").agg(F.count("*").alias("pages"))
    bound = F.greatest(F.lit(2), F.floor(F.col("pages") * min_share))
    return counted.join(sizes, "doc").filter((F.col("pages") >= 3) & (F.col("n") >= bound)).select("doc", "line").distinct()


def strip_headers_footers(pages: DataFrame, min_share: float = 0.5) -> DataFrame:
    """pages (doc, page, text) without the repeated edge lines of their document."""
    drop = repeated_edge_lines(pages, min_share).groupBy("doc").agg(F.collect_set("line").alias("drop__"))
    joined = pages.join(drop, "doc", "left")
    kept = F.array_join(F.filter(F.split("text", "\n"), lambda x: ~F.array_contains("drop__", F.trim(x))), "\n")
    return joined.withColumn("text", F.when(F.col("drop__").isNull(), F.col("text")).otherwise(kept)).drop("drop__")


def clean_corpus(pages: DataFrame, min_share: float = 0.5) -> DataFrame:
    return strip_headers_footers(pages, min_share).withColumn("text", T.clean_page(F.col("text")))


def top_keywords(documents: DataFrame, k: int = 10) -> DataFrame:
    """(doc_id, rank, word, n): most frequent words of four letters or more, ties by first appearance."""
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"(?U)\b[a-z]{4,}\b"), F.lit(0))
    places = documents.select("doc_id", F.posexplode_outer(words).alias("at", "word")).filter(~F.col("word").isin(*T.STOP_WORDS))
    counts = places.groupBy("doc_id", "word").agg(F.count("*").alias("n"), F.min("at").alias("at"))
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("n"), "at"))
    return counts.withColumn("rank", rank).filter(F.col("rank") <= k).select("doc_id", "rank", "word", "n")


def document_stats(documents: DataFrame, page_chars: int = 3000) -> DataFrame:
    text = F.col("text")
    return documents.select(
        "doc_id",
        F.greatest(F.lit(1), F.ceil(F.length(text) / page_chars)).alias("pages"),
        F.size(T.paragraphs(text)).alias("paragraphs"),
        F.length(text).alias("characters"),
        F.size(F.regexp_extract_all(text, F.lit(r"[^\s]+"), F.lit(0))).alias("words"),
    )


def document_metadata(documents: DataFrame) -> DataFrame:
    """doc_id and one struct of all that the text tells about its document."""
    words = top_keywords(documents).groupBy("doc_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "word"))), lambda x: x["word"]).alias("keywords"))
    text = F.col("text")
    own = documents.select(
        "doc_id",
        T.doc_type(text, F.col("source")).alias("document_type"),
        F.lit("en").alias("language"),
        T.topics(text).alias("topics"),
        T.tech_entities(text).alias("technologies"),
        *T.content_flags(text),
    )
    joined = own.join(words, "doc_id", "left").withColumn("keywords", F.coalesce("keywords", F.array().cast("array<string>")))
    return joined.select("doc_id", F.struct("document_type", "language", "keywords", "topics", "technologies", *T.FLAGS).alias("metadata"))
