"""Corpus registry: admission, de-duplication, versions, lifecycle and their reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.operators.metrics import percentiles
from corpusloom.sources.tables import written

#: File types and sizes that are admitted.
EXTENSIONS = ("pdf", "docx", "txt", "md", "markdown")
MIME_TYPES = (
    "application/pdf",
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "text/plain",
    "text/markdown",
    "application/octet-stream",
)
MAX_BYTES = 10 * 1024 * 1024
READY = "ready_for_search"
#: Stage of a job -> percent done.
PROGRESS = (("uploaded", 5), ("extracting", 20), ("cleaning", 40), ("understanding", 50), ("chunking", 60), ("embedding", 80), ("storing", 95), ("completed", 100))


def admit(files: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    """files (filename, mime, size) with `accepted` and the first `reason` against."""
    extension = F.lower(F.regexp_extract("filename", r"\.([^.]+)$", 1))
    reason = (
        F.when(~extension.isin(*EXTENSIONS), "extension")
        .when(~F.coalesce(F.col("mime").isin(*MIME_TYPES), F.lit(False)), "mime")
        .when(F.col("size") > max_bytes, "size")
    )
    return files.withColumn("reason", reason).withColumn("accepted", F.col("reason").isNull())


def checksum(text: Column) -> Column:
    return F.sha2(text, 256)


def dedupe(batch: DataFrame, registry: DataFrame, arrival: str = "arrival") -> DataFrame:
    """batch with `duplicate`: its checksum is registered already, or came earlier in the batch."""
    # Minimum and a join instead of a window: a checksum that many rows share is no single task's work.
    first = batch.groupBy("checksum").agg(F.min(arrival).alias("first__"))
    known = registry.select("checksum").distinct().withColumn("known__", F.lit(True))
    marked = batch.join(first.join(known, "checksum", "left"), "checksum")
    return marked.withColumn("duplicate", F.col("known__").isNotNull() | (F.col(arrival) > F.col("first__"))).drop("first__", "known__")


def numbered(df: DataFrame, key: str, *order: Column | str, name: str = "number") -> DataFrame:
    """df with each row's number (from 1) within its key. Rows are dealt by ranges of key and order and numbered within a
    range, so a key of many rows is no one task's work; ranges of a key go on from the counts of those before. Written, as
    ranges must not move in between."""
    ranged = written(df.repartitionByRange(key, *order).withColumn("part__", F.spark_partition_id()), "ranges")
    row = F.row_number().over(Window.partitionBy(key, "part__").orderBy(*order))
    sizes = ranged.groupBy(key, "part__").agg(F.count("*").alias("n__"))
    before = F.sum("n__").over(Window.partitionBy(key).orderBy("part__")) - F.col("n__")
    starts = sizes.select(F.col(key).alias("k__"), F.col("part__").alias("p__"), before.alias("before__"))
    both = ranged.withColumn("row__", row).join(starts, F.col(key).eqNullSafe(F.col("k__")) & (F.col("part__") == F.col("p__")))
    return both.withColumn(name, F.col("row__") + F.col("before__")).drop("row__", "part__", "k__", "p__", "before__")


def assign_versions(batch: DataFrame, latest: DataFrame, arrival: str = "arrival") -> DataFrame:
    """batch with version_number: on from the latest one of its filename (filename, latest_version), in arrival order."""
    each = numbered(batch, "filename", arrival, name="version_number").join(latest, "filename", "left")
    return each.withColumn("version_number", F.col("version_number") + F.coalesce("latest_version", F.lit(0))).drop("latest_version")


def latest_versions(documents: DataFrame, versions: DataFrame) -> DataFrame:
    """One row for each document with its newest version's fields; "unknown" and 0 without one."""
    newest = versions.groupBy("document_id").agg(
        F.max("version_number").alias("latest_version"), *[F.max_by(c, "version_number").alias(c) for c in ("status", "chunk_count", "total_ms")]
    )
    joined = documents.join(newest, "document_id", "left")
    return joined.select(
        *documents.columns, *[F.coalesce(c, F.lit(0)).alias(c) for c in ("latest_version", "chunk_count", "total_ms")], F.coalesce("status", F.lit("unknown")).alias("status")
    )


#: Chunks of a page of document_details().
PAGE_ROWS = 1000


def document_details(versions: DataFrame, chunks: DataFrame, jobs: DataFrame, page_rows: int = PAGE_ROWS) -> DataFrame:
    """(document_id, page, n_versions, n_chunks, rows): page 0 heads a document with its counts; the pages from 1 on hold its
    chunks in up to page_rows rows (version_number, status, job_status, chunk_index, chunk_hash), newest version first, with its
    latest job's status; a version without chunks has one row. So no row holds all of a large document."""
    job = jobs.groupBy("version_id").agg(F.max_by("job_status", F.struct("start_time", "job_id")).alias("job_status"))
    full = versions.join(job, "version_id", "left").join(chunks, "version_id", "left")
    rows = full.select("document_id", "version_number", "status", "job_status", "chunk_index", "chunk_hash")
    placed = numbered(rows, "document_id", F.desc("version_number"), F.asc_nulls_first("chunk_index"), name="place")
    item = F.struct("place", "version_number", "status", "job_status", "chunk_index", "chunk_hash")
    paged = placed.groupBy("document_id", (F.floor((F.col("place") - 1) / page_rows) + 1).alias("page")).agg(F.sort_array(F.collect_list(item)).alias("rows"))
    none = F.lit(None).cast("bigint")
    pages = paged.select("document_id", "page", none.alias("n_versions"), none.alias("n_chunks"), F.transform("rows", lambda r: r.dropFields("place")).alias("rows"))
    heads = versions.groupBy("document_id").agg(F.count("*").alias("n_versions")).join(rows.groupBy("document_id").agg(F.count("chunk_index").alias("n_chunks")), "document_id")
    return pages.unionByName(heads.withColumns({"page": F.lit(0).cast("bigint"), "rows": F.lit(None)}).withColumn("rows", F.col("rows").cast(pages.schema["rows"].dataType)))


def delete_documents(ids: DataFrame, documents: DataFrame, versions: DataFrame, *children: DataFrame) -> list[DataFrame]:
    """What is left of each table when the documents of `ids` go with their versions and the versions' children."""
    gone = versions.join(ids, "document_id", "left_semi").select("version_id")
    kept = [documents.join(ids, "document_id", "left_anti"), versions.join(ids, "document_id", "left_anti")]
    return [*kept, *[c.join(gone, "version_id", "left_anti") for c in children]]


def ready_chunks(chunks: DataFrame, versions: DataFrame) -> DataFrame:
    return chunks.join(versions.filter(F.col("status") == READY), "version_id", "left_semi")


def stale_versions(versions: DataFrame, model: str) -> DataFrame:
    return versions.filter((F.col("status") == READY) & (F.col("embedding_model") != model))


def reindex_report(versions: DataFrame, chunks: DataFrame) -> DataFrame:
    """versions (version_id, text), chunks (version_id) -> version_id, chunks, error: what came of each version; one without
    text or without chunks is reported, not raised."""
    stored = chunks.groupBy("version_id").agg(F.count("*").alias("chunks"))
    joined = versions.join(stored, "version_id", "left").withColumn("chunks", F.coalesce("chunks", F.lit(0)))
    return joined.select("version_id", "chunks", failure(F.col("text"), F.col("chunks")).alias("error"))


def failure(text: Column, chunks: Column) -> Column:
    """Why a version can't be searched; null if it can."""
    return F.when(~F.coalesce(text, F.lit("")).rlike(r"\S"), "no text").when(chunks == 0, "no chunks")


def reindex_status(versions: DataFrame, model: str) -> DataFrame:
    ready = F.col("status") == READY
    outdated = F.count_if(ready & (F.col("embedding_model") != model))
    return versions.agg(F.count_if(ready).alias("total_ready"), outdated.alias("outdated"), (outdated > 0).alias("reindex_needed"))


def ingest_verify(expected: DataFrame, chunks: DataFrame) -> DataFrame:
    """version_id, expected, stored, mismatch."""
    stored = chunks.groupBy("version_id").agg(F.count("*").alias("stored"))
    both = expected.join(stored, "version_id", "full_outer")
    both = both.select("version_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("expected", "stored")])
    return both.withColumn("mismatch", F.col("expected") != F.col("stored"))


def job_progress(stages: DataFrame, now: Column) -> DataFrame:
    """stages (job_id, stage, ts) -> job_id, stage (latest), progress, duration_ms (open jobs are measured against now)."""
    progress = F.create_map(*[F.lit(x) for pair in PROGRESS for x in pair])
    last = stages.groupBy("job_id").agg(F.max_by("stage", F.struct("ts", "event_id")).alias("stage"), F.min("ts").alias("begun"), F.max("ts").alias("ended"))
    end = F.when(F.col("stage") == "completed", F.col("ended").cast("timestamp")).otherwise(now)
    return last.select("job_id", "stage", progress[F.col("stage")].alias("progress"), F.floor((F.unix_micros(end) - F.unix_micros(F.col("begun").cast("timestamp"))) / 1000).alias("duration_ms"))


def stage_timings(versions: DataFrame, stages: list[str]) -> DataFrame:
    """stage -> runs, total, mean, largest milliseconds over all versions, and the median, 95th and 99th percentile."""
    pairs = versions.unpivot(["version_id"], stages, "stage", "ms")
    return pairs.groupBy("stage").agg(F.count("ms").alias("runs"), F.sum("ms").alias("total_ms"), F.round(F.avg("ms"), 6).alias("avg_ms"), F.max("ms").alias("max_ms"), *percentiles("ms"))


def indexed_vocabulary(chunks: DataFrame) -> DataFrame:
    """Distinct lower-cased filenames, headings and sections of ready chunks, as (kind, term)."""
    kinds = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.lower(k).alias("term")) for k in ("filename", "heading", "section")]))
    return chunks.select(kinds.alias("t")).select("t.kind", "t.term").filter("term is not null and term <> ''").distinct()


def corpus_words(text: Column) -> Column:
    """The distinct words of one text (null if it has none); distinct() over them gives the corpus's. Outer, as from an
    inner explode Spark infers a filter that matches the words once more."""
    return F.explode_outer(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"\w+"), F.lit(0))))


def upload_audit(log: DataFrame) -> DataFrame:
    return log.groupBy(F.date_trunc("day", "ts").alias("day"), "status").agg(F.count("*").alias("uploads"), F.sum("size").alias("bytes"))
