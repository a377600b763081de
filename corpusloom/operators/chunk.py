"""Chunking: documents in, one row a chunk out."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.functions import text as T

SIZE, OVERLAP = 800, 150
SEPARATORS = ("\n\n", "\n", ".", " ", "")
SEMANTIC_TOKENS, REINDEX_TOKENS = 350, 200


def chunk_fixed(documents: DataFrame, size: int = 3000) -> DataFrame:
    """chunk_index, chunk_text: pieces of `size` characters; the other columns are kept."""
    at = F.sequence(F.lit(0).cast("bigint"), F.ceil(F.length("text") / size) - 1)
    pieces = F.transform(at, lambda i: F.substring(F.col("text"), (i * size + 1).cast("int"), F.lit(size)))
    # The pieces are exploded, not the text with a number for each: a long text isn't copied once a chunk.
    cut = F.when(F.length("text") > 0, pieces).otherwise(F.array().cast("array<string>"))
    others = [c for c in documents.columns if c != "text"]
    rows = documents.select(*others, F.posexplode(cut).alias("chunk_index", "chunk_text"))
    return rows.withColumn("chunk_index", F.col("chunk_index").cast("bigint"))


def split_recursive(text: str, size: int = SIZE, overlap: int = OVERLAP, separators: tuple[str, ...] = SEPARATORS) -> list[tuple[int, str]]:
    """(offset, piece): pieces of `size` characters at most, cut at the coarsest separator that does it; a piece takes up
    to `overlap` characters from the one before."""
    units = [(0, len(text))]
    for separator in separators:
        finer = []
        for a, b in units:
            if b - a <= size:
                finer.append((a, b))
                continue
            # Separators stay with what they close.
            at, cuts = a, []
            if separator:
                while (end := text.find(separator, at, b)) >= 0:
                    cuts.append((at, end + len(separator)))
                    at = end + len(separator)
                cuts += [(at, b)] if at < b else []
            else:
                cuts = [(i, min(i + size, b)) for i in range(a, b, size)]
            finer += cuts
        units = finer
    out, first = [], 0
    for i, (_, b) in enumerate(units):
        if b - units[first][0] > size:
            out.append((units[first][0], units[i - 1][1]))
            # What is carried over must leave room for the next unit.
            first = i
            while first > 0 and units[i - 1][1] - units[first - 1][0] <= overlap and b - units[first - 1][0] <= size:
                first -= 1
    if units and units[-1][1] > units[first][0]:
        out.append((units[first][0], units[-1][1]))
    return [(a, text[a:b]) for a, b in out if text[a:b].strip()]


def chunk_recursive(documents: DataFrame, id_col: str = "doc_id", size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """(id, chunk_index, text, start, end, n_words, hash) for each document, in Arrow batches."""

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [id_col, "chunk_index", "text", "start", "end", "n_words", "hash"]
        for batch in batches:
            rows = [
                (doc, i, piece, at, at + len(piece), len(piece.split()), hashlib.sha256(piece.encode()).hexdigest())
                for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
                for i, (at, piece) in enumerate(split_recursive(text or "", size, overlap))
            ]
            kinds = [batch.schema.field(0).type, pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string()]
            columns = list(zip(*rows, strict=True)) or [()] * 7
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    kind = documents.schema[id_col].dataType.simpleString()
    schema = f"{id_col} {kind}, chunk_index int, text string, start int, end int, n_words int, hash string"
    return documents.select(id_col, "text").mapInArrow(cut, schema)


def split_paragraphs(documents: DataFrame) -> DataFrame:
    return documents.select("doc_id", F.posexplode(T.paragraphs(F.col("text"))).alias("paragraph_number", "text"))


def split_sentences(documents: DataFrame) -> DataFrame:
    return documents.select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("sentence", "text"))


def markdown_blocks(text: str) -> list[tuple[str, str]]:
    """(kind, text) of consecutive lines: heading, table, list, code, text."""
    blocks: list[tuple[str, list[str]]] = []
    code = False
    for line in text.split("\n"):
        bare = line.strip()
        if code or bare.startswith("```"):
            kind, code = "code", code ^ bare.startswith("```")
        elif re.match(r"#{1,6}\s", bare):
            kind = "heading"
        elif bare.startswith("|"):
            kind = "table"
        elif re.match(r"([-*+•]|\d+[.)])\s", bare) or (line.startswith((" ", "\t")) and bare and blocks and blocks[-1][0] == "list"):
            kind = "list"
        else:
            kind = "text" if bare else ""
        if blocks and kind and kind == blocks[-1][0] != "heading":
            blocks[-1][1].append(line)
        else:
            blocks.append((kind, [line]))
    return [(k, "\n".join(lines)) for k, lines in blocks if k]


def split_semantic(text: str, most: int = SEMANTIC_TOKENS) -> list[dict]:
    """Chunks of about `most` words; tables, code and lists stay whole, a heading starts a new chunk, long texts are parted
    at sentences. Each carries the headings above it."""
    levels: dict[int, str] = {}
    out, held, count, kind = [], [], 0, "text"

    def flush():
        nonlocal held, count, kind
        if held:
            out.append({"text": "\n".join(held), "chunk_type": kind, "n_tokens": count, "oversized": count > most, "section": levels.get(1), "subsection": levels.get(2), "heading": levels[max(levels)] if levels else None})
        held, count, kind = [], 0, "text"

    for block, body in markdown_blocks(text):
        if block == "heading":
            flush()
            mark, _, title = body.strip().partition(" ")
            levels = {k: v for k, v in levels.items() if k < len(mark)} | {len(mark): title.strip()}
            continue
        parts = re.split(r"(?<=[.!?])\s+", body) if block == "text" and len(body.split()) > most else [body]
        for part in parts:
            n = len(part.split())
            if held and (count + n > most or (block != "text") != (kind != "text")):
                flush()
            held.append(part)
            count += n
            kind = "code_block" if block == "code" else block
    flush()
    return out


def chunk_semantic(documents: DataFrame, id_col: str = "doc_id", most: int = SEMANTIC_TOKENS) -> DataFrame:
    """Markdown-aware chunks; a document is cut whole in its row, so no grouping is needed."""
    fields = [("text", pa.string()), ("chunk_type", pa.string()), ("n_tokens", pa.int32()), ("oversized", pa.bool_()), ("section", pa.string()), ("subsection", pa.string()), ("heading", pa.string())]

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(doc, i, c) for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for i, c in enumerate(split_semantic(text or "", most))]
            ids, numbers = pa.array([r[0] for r in rows], batch.schema.field(0).type), pa.array([r[1] for r in rows], pa.int32())
            yield pa.record_batch([ids, numbers, *[pa.array([r[2][k] for r in rows], t) for k, t in fields]], [id_col, "chunk_index", *[k for k, _ in fields]])

    kind = documents.schema[id_col].dataType.simpleString()
    schema = f"{id_col} {kind}, chunk_index int, text string, chunk_type string, n_tokens int, oversized boolean, section string, subsection string, heading string"
    return documents.select(id_col, "text").mapInArrow(cut, schema)


def reindex(documents: DataFrame) -> DataFrame:
    """Cleaned and cut as for a reindexed version."""
    clean = documents.withColumn("text", T.clean_page(F.col("text")))
    return chunk_semantic(clean, "version_id", REINDEX_TOKENS)


def duplicate_chunks(chunks: DataFrame) -> DataFrame:
    """hash -> copies and the first chunk id, for texts that occur more than once."""
    return chunks.groupBy(F.sha2("text", 256).alias("hash")).agg(F.count("*").alias("copies"), F.min("chunk_id").alias("first_chunk")).filter("copies > 1")


def link_neighbors(chunks: DataFrame) -> DataFrame:
    by = Window.partitionBy("doc_id").orderBy("chunk_index")
    return chunks.withColumns({"previous_chunk": F.lag("chunk_id").over(by), "next_chunk": F.lead("chunk_id").over(by)})


def _walk(document: str | None, texts: list[str | None]) -> list[int]:
    """Where each text begins, or -1: the first place behind the start of the one found before."""
    out, at = [], 0
    for t in texts:
        start = document.find(t, at) if document and t else -1
        out.append(start)
        at = start + 1 if start >= 0 else at
    return out


def chunk_offsets(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """start and end of a chunk in its document, 0 where it isn't found. The chunks of a document, which together are about as
    long as it is, meet it once and are found in one walk by chunk_index, so equal texts get ascending places."""
    rows = F.sort_array(F.collect_list(F.struct("chunk_index", "chunk_id", F.struct(*[F.col(c) for c in chunks.columns if c not in ("chunk_index", "chunk_id", "doc_id")]).alias("r"))))
    grouped = chunks.groupBy("doc_id").agg(rows.alias("rows")).join(documents.select("doc_id", F.col("text").alias("document")), "doc_id")

    @F.arrow_udf("array<int>")
    def starts(document: pa.Array, texts: pa.Array) -> pa.Array:
        return pa.array([_walk(d, t) for d, t in zip(document.to_pylist(), texts.to_pylist(), strict=True)], pa.list_(pa.int32()))

    placed = grouped.select("doc_id", F.explode(F.arrays_zip("rows", starts("document", "rows.r.text").alias("at"))).alias("x"))
    found = F.col("x.at") >= 0
    start = F.when(found, F.col("x.at")).otherwise(0)
    flat = placed.select("doc_id", "x.rows.chunk_index", "x.rows.chunk_id", "x.rows.r.*", start.alias("start"), F.when(found, F.col("x.at") + F.length("x.rows.r.text")).otherwise(0).alias("end"))
    return flat.select(*chunks.columns, "start", "end")


def chunk_profile(chunks: DataFrame, text: Column) -> DataFrame:
    words = F.size(F.regexp_extract_all(text, F.lit(r"[^\s]+"), F.lit(0)))
    sized = chunks.select("doc_id", words.alias("words"), F.length(text).alias("chars"))
    return sized.groupBy("doc_id").agg(
        F.count("*").alias("chunks"), F.sum("words").alias("words"), F.min("chars").alias("min_chars"), F.round(F.avg("chars"), 6).alias("avg_chars"), F.max("chars").alias("max_chars")
    )
