"""Queries over the corpus registry. Documents stand for uploads: the source is the filename, the text the content, the id
the order of arrival; a document's version is its place within its source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import chunk, embed
from corpusloom.operators import registry as R
from corpusloom.plans.base import query
from corpusloom.sources.snapshots import read_chunks, write_chunks
from corpusloom.sources.tables import append_upload_log, scan_expectations, scan_files, scratch, table, written

MODEL = "hash-2"
STAGES = ("extract_ms", "chunk_ms", "embed_ms")


def uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(arrival, filename, mime, size, checksum): one row for each document."""
    ext = F.expr("CASE lang WHEN 'en' THEN 'txt' WHEN 'fr' THEN 'md' WHEN 'de' THEN 'PDF' ELSE 'exe' END")
    mime = F.expr("CASE lang WHEN 'fr' THEN 'text/markdown' WHEN 'en' THEN IF(source = 'src1', 'image/png', 'text/plain') ELSE 'application/pdf' END")
    docs = table(spark, sf_dir, "documents")
    return docs.select(
        F.col("doc_id").alias("arrival"),
        F.concat_ws(".", "source", ext).alias("filename"),
        mime.alias("mime"),
        F.octet_length("text").cast("bigint").alias("size"),
        R.checksum(F.col("text")).alias("checksum"),
    )


UPLOADS = """
uploads AS (SELECT doc_id AS arrival,
  source || '.' || CASE lang WHEN 'en' THEN 'txt' WHEN 'fr' THEN 'md' WHEN 'de' THEN 'PDF' ELSE 'exe' END AS filename,
  CASE lang WHEN 'fr' THEN 'text/markdown' WHEN 'en' THEN CASE WHEN source = 'src1' THEN 'image/png' ELSE 'text/plain' END ELSE 'application/pdf' END AS mime,
  strlen(text) AS size, sha256(text) AS checksum, source FROM documents)"""


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(version_id, document_id, version_number, status, embedding_model, chunk_count, stage times)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", F.length("text").alias("n"))
    arrived = docs.select(F.col("doc_id").alias("arrival"), F.col("source").alias("filename"), "lang", "n")
    numbered = R.assign_versions(arrived, docs.limit(0).select(F.col("source").alias("filename"), F.lit(0).alias("latest_version")))
    return numbered.select(
        F.col("arrival").alias("version_id"),
        F.col("filename").alias("document_id"),
        F.col("version_number").cast("bigint").alias("version_number"),
        F.when(F.col("n") >= 200, R.READY).otherwise("failed").alias("status"),
        F.when(F.col("lang") == "en", MODEL).otherwise("hash-1").alias("embedding_model"),
        F.ceil(F.col("n") / 3000).alias("chunk_count"),
        (F.col("n") % 97).cast("bigint").alias("extract_ms"),
        (F.col("n") % 53).cast("bigint").alias("chunk_ms"),
        (F.col("n") % 211).cast("bigint").alias("embed_ms"),
    )


VERSIONS = f"""
versions AS (SELECT doc_id AS version_id, source AS document_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS version_number,
  CASE WHEN length(text) >= 200 THEN '{R.READY}' ELSE 'failed' END AS status, CASE WHEN lang = 'en' THEN '{MODEL}' ELSE 'hash-1' END AS embedding_model,
  ceil(length(text) / 3000)::BIGINT AS chunk_count, length(text) % 97 AS extract_ms, length(text) % 53 AS chunk_ms, length(text) % 211 AS embed_ms FROM documents)"""


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixed-size chunks of the documents, the version being the document's id."""
    cut = chunk.chunk_fixed(table(spark, sf_dir, "documents"))
    return cut.select(F.col("doc_id").alias("version_id"), "source", "chunk_index", F.col("chunk_text").alias("text"))


CHUNKS = """
chunks AS (SELECT doc_id AS version_id, source, i AS chunk_index, substr(text, i * 3000 + 1, 3000) AS text
  FROM documents, unnest(range(0, ceil(length(text) / 3000)::BIGINT)) AS t(i))"""


@query("SELECT doc_id, lang, source, n_chars FROM documents")
def scan_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")


@query(
    f"WITH {UPLOADS}, r AS (SELECT arrival, filename, CASE WHEN lower(regexp_extract(filename, '\\.([^.]+)$', 1)) NOT IN {R.EXTENSIONS} THEN 'extension' "
    f"WHEN mime NOT IN {R.MIME_TYPES} THEN 'mime' WHEN size > 20000 THEN 'size' END AS reason FROM uploads) SELECT *, reason IS NULL AS accepted FROM r"
)
def admit_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.admit(uploads(spark, sf_dir), 20_000).select("arrival", "filename", "reason", "accepted")


def _batch(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """What has come with one source is registered; everything else arrives."""
    docs = table(spark, sf_dir, "documents")
    rows = docs.select(F.col("doc_id").alias("arrival"), F.col("source").alias("filename"), R.checksum(F.col("text")).alias("checksum"))
    return rows.filter("filename <> 'src0'"), rows.filter("filename = 'src0'")


BATCH = """r AS (SELECT doc_id AS arrival, source AS filename, sha256(text) AS checksum FROM documents),
batch AS (SELECT * FROM r WHERE filename <> 'src0'), known AS (SELECT DISTINCT checksum FROM r WHERE filename = 'src0')"""


@query(
    f"WITH {BATCH} SELECT arrival, filename, checksum, checksum IN (SELECT checksum FROM known) OR "
    "arrival > min(arrival) OVER (PARTITION BY checksum) AS duplicate FROM batch"
)
def dedupe_by_checksum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.dedupe(*_batch(spark, sf_dir)).select("arrival", "filename", "checksum", "duplicate")


@query(
    """WITH latest AS (SELECT source AS filename, count(*) AS latest_version FROM documents WHERE lang = 'en' GROUP BY source)
SELECT doc_id AS arrival, source AS filename, row_number() OVER (PARTITION BY source ORDER BY doc_id) + coalesce(latest_version, 0) AS version_number
FROM documents LEFT JOIN latest ON filename = source WHERE lang <> 'en'"""
)
def assign_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    latest = docs.filter("lang = 'en'").groupBy(F.col("source").alias("filename")).agg(F.count("*").alias("latest_version"))
    batch = docs.filter("lang <> 'en'").select(F.col("doc_id").alias("arrival"), F.col("source").alias("filename"))
    return R.assign_versions(batch, latest)


@query(
    f"""WITH {VERSIONS}, d AS (SELECT source AS document_id, min(doc_id) AS created FROM documents GROUP BY source UNION ALL SELECT 'empty', -1),
v AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY version_number DESC) AS rn FROM versions)
SELECT d.document_id, created, coalesce(version_number, 0) AS latest_version, coalesce(chunk_count, 0) AS chunk_count,
  coalesce(extract_ms + chunk_ms + embed_ms, 0) AS total_ms, coalesce(status, 'unknown') AS status FROM d LEFT JOIN v ON v.document_id = d.document_id AND rn = 1"""
)
def latest_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").groupBy(F.col("source").alias("document_id")).agg(F.min("doc_id").alias("created"))
    docs = docs.unionByName(spark.sql("SELECT 'empty' AS document_id, -1L AS created"))
    total = F.col("extract_ms") + F.col("chunk_ms") + F.col("embed_ms")
    return R.latest_versions(docs, versions(spark, sf_dir).withColumn("total_ms", total)).orderBy(F.desc("created"))


@query(
    f"""WITH {VERSIONS}, {CHUNKS}, r AS (SELECT document_id, version_number, status, chunk_index, sha256(text) AS chunk_hash,
  row_number() OVER (PARTITION BY document_id ORDER BY version_number DESC, chunk_index NULLS FIRST) AS place FROM versions LEFT JOIN chunks USING (version_id)),
p AS (SELECT document_id, (place - 1) // 50 + 1 AS page, count(*) AS n, sha256(string_agg(concat_ws(':', version_number, status, status, chunk_index, chunk_hash), ',' ORDER BY place)) AS digest FROM r GROUP BY ALL)
SELECT document_id, page, NULL::BIGINT AS n_versions, NULL::BIGINT AS n_chunks, n, digest FROM p
UNION ALL SELECT document_id, 0, count(DISTINCT version_number), count(chunk_index), NULL, NULL FROM r GROUP BY document_id"""
)
def document_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of fifty chunks."""
    parts = chunks(spark, sf_dir).select("version_id", "chunk_index", R.checksum(F.col("text")).alias("chunk_hash"))
    v = versions(spark, sf_dir)
    jobs = v.select("version_id", F.col("version_id").alias("job_id"), F.lit(0).alias("start_time"), F.col("status").alias("job_status"))
    full = R.document_details(v, parts, jobs, 50)
    lines = F.transform("rows", lambda r: F.concat_ws(":", *[r[c].cast("string") for c in ("version_number", "status", "job_status", "chunk_index", "chunk_hash")]))
    n = F.when(F.col("rows").isNotNull(), F.size("rows")).cast("bigint")
    return full.select("document_id", "page", "n_versions", "n_chunks", n.alias("n"), F.sha2(F.array_join(lines, ","), 256).alias("digest"))


@query(
    f"""WITH {VERSIONS}, {CHUNKS}, gone AS (SELECT DISTINCT source AS document_id FROM documents WHERE lang = 'es' AND n_chars > 10000),
v AS (SELECT * FROM versions WHERE document_id NOT IN (SELECT document_id FROM gone))
SELECT 'versions' AS kind, document_id, count(*) AS n FROM v GROUP BY ALL UNION ALL
SELECT 'chunks', source, count(*) FROM chunks WHERE version_id IN (SELECT version_id FROM v) GROUP BY ALL UNION ALL
SELECT 'jobs ' || status, document_id, count(*) FROM v GROUP BY ALL"""
)
def delete_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    ids = docs.filter("lang = 'es' AND n_chars > 10000").select(F.col("source").alias("document_id")).distinct()
    every = docs.select(F.col("source").alias("document_id")).distinct()
    jobs = versions(spark, sf_dir).select("version_id", "document_id", F.concat(F.lit("jobs "), "status").alias("kind"))
    _, v, c, j = R.delete_documents(ids, every, versions(spark, sf_dir), chunks(spark, sf_dir), jobs)
    of = lambda df, kind, key: df.groupBy(F.lit(kind).alias("kind"), F.col(key).alias("document_id")).agg(F.count("*").alias("n"))
    left = of(v, "versions", "document_id").unionByName(of(c, "chunks", "source"))
    return left.unionByName(j.groupBy("kind", "document_id").agg(F.count("*").alias("n")))


@query(f"WITH {VERSIONS}, {CHUNKS} SELECT version_id, chunk_index FROM chunks WHERE version_id IN (SELECT version_id FROM versions WHERE status = '{R.READY}')")
def ready_for_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.ready_chunks(chunks(spark, sf_dir), versions(spark, sf_dir)).select("version_id", "chunk_index")


@query(f"WITH {VERSIONS} SELECT version_id, embedding_model FROM versions WHERE status = '{R.READY}' AND embedding_model <> '{MODEL}'")
def stale_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.stale_versions(versions(spark, sf_dir), MODEL).select("version_id", "embedding_model")


@query(
    f"WITH {VERSIONS}, r AS (SELECT count(*) AS total_ready, count(*) FILTER (embedding_model <> '{MODEL}') AS outdated FROM versions WHERE status = '{R.READY}') "
    "SELECT *, outdated > 0 AS reindex_needed FROM r"
)
def reindex_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.reindex_status(versions(spark, sf_dir), MODEL)


@query(
    f"""WITH {VERSIONS}, {CHUNKS}, s AS (SELECT version_id, count(*) AS stored FROM chunks WHERE chunk_index < 3 GROUP BY version_id)
SELECT version_id, coalesce(chunk_count, 0) AS expected, coalesce(stored, 0) AS stored, coalesce(chunk_count, 0) <> coalesce(stored, 0) AS mismatch
FROM versions FULL JOIN s USING (version_id)"""
)
def ingest_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The store holds the first three chunks of each version."""
    expected = versions(spark, sf_dir).select("version_id", F.col("chunk_count").alias("expected"))
    return R.ingest_verify(expected, chunks(spark, sf_dir).filter("chunk_index < 3"))


STAGE_OF = {"signup": "uploaded", "view": "extracting", "click": "chunking", "purchase": "completed", "error": "embedding"}
NOW = "2030-01-01 00:00:00"
_STAGE_SQL = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in STAGE_OF.items()) + " END"
_PROGRESS_SQL = "CASE stage " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in R.PROGRESS) + " END"


def job_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as the stages that jobs (users) pass."""
    stage = F.create_map(*[F.lit(x) for pair in STAGE_OF.items() for x in pair])[F.col("event_type")]
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("job_id"), "event_id", "ts", stage.alias("stage"))


@query(
    f"""WITH s AS (SELECT user_id AS job_id, event_id, ts, {_STAGE_SQL} AS stage FROM events),
j AS (SELECT job_id, arg_max(stage, (ts, event_id)) AS stage, min(ts) AS begun, max(ts) AS ended FROM s GROUP BY job_id)
SELECT job_id, stage, {_PROGRESS_SQL}::INT AS progress, (epoch_us(CASE WHEN stage = 'completed' THEN ended ELSE TIMESTAMP '{NOW}' END) - epoch_us(begun)) // 1000 AS duration_ms FROM j"""
)
def job_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.job_progress(job_stages(spark, sf_dir), F.lit(NOW).cast("timestamp"))


@query(
    f"WITH {VERSIONS}, u AS (UNPIVOT (SELECT version_id, {', '.join(STAGES)} FROM versions) ON {', '.join(STAGES)} INTO NAME stage VALUE ms) "
    "SELECT stage, count(ms) AS runs, sum(ms)::BIGINT AS total_ms, round(avg(ms), 6) AS avg_ms, max(ms) AS max_ms, "
    "quantile_disc(ms, 0.5) AS p50, quantile_disc(ms, 0.95) AS p95, quantile_disc(ms, 0.99) AS p99 FROM u GROUP BY stage"
)
def stage_timings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.stage_timings(versions(spark, sf_dir), list(STAGES))


_HEAD = r"regexp_extract(text, '^[^.\n]*', 0)"


@query(
    f"""WITH {CHUNKS}, c AS (SELECT lower(source || '.txt') AS filename, lower({_HEAD}) AS heading, lower(source) AS section FROM chunks)
SELECT DISTINCT kind, term FROM (SELECT 'filename' AS kind, filename AS term FROM c UNION ALL SELECT 'heading', heading FROM c UNION ALL SELECT 'section', section FROM c)
WHERE term IS NOT NULL AND term <> ''"""
)
def indexed_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    heading = F.regexp_extract("text", r"^[^.\n]*", 0)
    named = chunks(spark, sf_dir).select(F.concat("source", F.lit(".txt")).alias("filename"), heading.alias("heading"), F.col("source").alias("section"))
    return R.indexed_vocabulary(named)


@query("SELECT DISTINCT unnest(regexp_extract_all(lower(text), '\\w+')) AS word FROM documents")
def corpus_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(R.corpus_words(F.col("text")).alias("word")).filter("word is not null").distinct()


@query(
    "SELECT date_trunc('day', ts)::TIMESTAMP AS day, CASE event_type WHEN 'error' THEN 'storage_failed' WHEN 'click' THEN 'duplicate' ELSE 'processing' END AS status, "
    "count(*) AS uploads, sum(user_id)::BIGINT AS bytes FROM events GROUP BY ALL"
)
def upload_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.expr("CASE event_type WHEN 'error' THEN 'storage_failed' WHEN 'click' THEN 'duplicate' ELSE 'processing' END")
    return R.upload_audit(table(spark, sf_dir, "events").select("ts", status.alias("status"), F.col("user_id").alias("size")))


@query(f"WITH {VERSIONS}, {CHUNKS} SELECT version_id, count(*) AS chunks FROM chunks GROUP BY version_id")
def sink_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everything is written, then the versions of one source are written again; the table holds each chunk once."""
    path, rows = scratch(spark, "chunk-table"), chunks(spark, sf_dir)
    write_chunks(rows, path)
    write_chunks(rows.filter("source = 'src1'"), path)
    return read_chunks(spark, path).groupBy("version_id").agg(F.count("*").alias("chunks"))


@query(f"WITH {UPLOADS} SELECT filename, status, count(*) AS uploads FROM uploads, (SELECT unnest(['processing', 'duplicate']) AS status) GROUP BY ALL")
def sink_upload_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "upload-log")
    for status in ("processing", "duplicate"):
        append_upload_log(uploads(spark, sf_dir).withColumn("status", F.lit(status)), path)
    return spark.read.parquet(path).groupBy("filename", "status").agg(F.count("*").alias("uploads"))


@query("SELECT regexp_replace(text, '[\\n\\r]', ' ', 'g') AS text, count(*) AS files FROM benchmark GROUP BY 1")
def scan_text_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark's passages as a folder of text files, scanned."""
    path = scratch(spark, "files")
    flat = table(spark, sf_dir, "benchmark").select("item_id", F.regexp_replace("text", "[\n\r]", " ").alias("text"))
    flat.withColumn("part", F.col("item_id")).repartition("part").select("text").write.text(path)
    lines = scan_files(spark, path).select(F.explode(F.split("text", "\n")).alias("text")).filter("text <> ''")
    return lines.groupBy("text").agg(F.count("*").alias("files"))


@query("SELECT item_id::VARCHAR AS id, text AS query, len(regexp_extract_all(text, '[^ ]+')) > 40 AS is_long FROM benchmark")
def scan_json_expectations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark's passages as golden queries in JSON files, scanned."""
    path = scratch(spark, "golden")
    items = table(spark, sf_dir, "benchmark").withColumn("file", F.expr("item_id div 20"))
    files = items.groupBy("file").agg(F.to_json(F.collect_list(F.struct(F.col("item_id").cast("string").alias("id"), F.col("text").alias("query")))).alias("value"))
    files.select("value").write.option("maxRecordsPerFile", 1).text(path)
    golden = scan_expectations(spark, path)
    return golden.select("id", "query", (F.size(F.regexp_extract_all("query", F.lit("[^ ]+"), F.lit(0))) > 40).alias("is_long"))


@query()
def reindex_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stale versions are cleaned, cut and embedded anew, and replace their chunks in a table of all."""
    path, every = scratch(spark, "chunk-table"), chunks(spark, sf_dir)
    write_chunks(every.select("version_id", "chunk_index", "text", F.array().cast("array<float>").alias("embedding")), path)
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("version_id"), "text")
    stale = docs.join(R.stale_versions(versions(spark, sf_dir), MODEL).select("version_id"), "version_id", "left_semi")
    fresh = written(embed.embed(chunk.reindex(stale), "text").select("version_id", "chunk_index", "text", "embedding"), "fresh")
    write_chunks(fresh, path)
    done = read_chunks(spark, path).join(stale.select("version_id"), "version_id").filter(F.size("embedding") == embed.DIMENSION)
    return R.reindex_report(stale, done)
