"""Queries that drain a table as a stream and return what the sink holds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.plans.base import ladder_sql, query
from corpusloom.plans.conversations import TOPICS
from corpusloom.functions import dictionaries as D
from corpusloom.sources.snapshots import read_chunks
from corpusloom.sources.tables import scratch
from corpusloom.streaming import jobs

#: Some user turns introduce themselves.
NAMED = "CASE WHEN role = 'user' AND turn % 3 = 0 THEN 'Hello my name is ann ' || text ELSE text END"


@query("WITH f AS (SELECT source, text, min(doc_id) AS doc_id FROM documents GROUP BY ALL), u AS (SELECT text, min(doc_id) AS doc_id FROM documents GROUP BY text) SELECT source AS filename, count(*) AS versions FROM u JOIN documents USING (doc_id) GROUP BY source")
def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents arrive as files named by their source; every distinct text becomes one version of the source of its smallest
    id, with chunks or an error. The files of the table may come in any order."""
    entries, store = scratch(spark, "registry"), scratch(spark, "chunk-store")
    files = jobs.table_stream(spark, sf_dir, "documents").select(F.col("doc_id").alias("arrival"), F.col("source").alias("filename"), "text")
    jobs.ingest(files, entries, store)
    stored = read_chunks(spark, store).select("version_id").distinct()
    versions = jobs.registered(spark, entries)
    whole = versions.filter("error is null").join(stored, "version_id", "left_semi").unionByName(versions.filter("error is not null"))
    return whole.groupBy("filename").agg(F.count("*").alias("versions"))


@query(f"SELECT conv_id, turn, {ladder_sql('lower(text)', D.INTENTS, 'Unknown')} AS intent FROM conversations WHERE role = 'user'")
def stream_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "routed")
    jobs.route(jobs.table_stream(spark, sf_dir, "conversations").filter("role = 'user'"), path)
    return spark.read.parquet(path).select("conv_id", "turn", "intent")


_TOPIC = "CASE " + " ".join(f"WHEN regexp_matches(lower(text), '{p}') THEN '{n}'" for n, p in TOPICS) + " END"


@query(
    rf"""WITH t AS (SELECT conv_id, turn, role, {NAMED} AS text FROM conversations),
l AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM t),
a AS (SELECT conv_id, count(*) AS turns, min(turn) AS first_turn, max(turn) AS last_turn, count(*) FILTER (role = 'user' AND regexp_matches(lower(text), '^(hi|hello|hey|good (morning|afternoon|evening))\b')) AS greetings,
  arg_max(nullif(regexp_extract(lower(text), '\bmy name is ([a-z]+)', 1), ''), turn) AS name, arg_max({ladder_sql("lower(text)", D.INTENTS, "Unknown")}, turn) FILTER (role = 'user') AS last_intent,
  arg_max(text, turn) FILTER (role = 'assistant') AS answer, arg_max({_TOPIC}, turn) FILTER (role = 'user') AS topic, string_agg(role || ': ' || text, chr(10) ORDER BY turn) FILTER (back <= 3) AS history FROM l GROUP BY conv_id)
SELECT * EXCLUDE (answer), CASE WHEN length(answer) > 200 THEN substr(answer, 1, 200) || '...' ELSE answer END AS preview FROM a"""
)
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A turn comes a minute after the one before; the last state of each session is its profile, with the last three
    messages."""
    path = scratch(spark, "sessions")
    ts = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("turn") * 60)
    turns = jobs.table_stream(spark, sf_dir, "conversations").withColumns({"ts": ts, "text": F.expr(NAMED)})
    jobs.drain(jobs.sessions(turns, keep=3, topics=TOPICS), lambda batch, number: batch.write.mode("overwrite").parquet(f"{path}/batch={number}"), "update")
    last = spark.read.parquet(path).groupBy("conv_id").agg(F.max_by(F.struct("*"), "batch").alias("s")).select("s.*")
    return last.drop("batch").withColumn("history", F.array_join("history", "\n"))


@query(
    """WITH RECURSIVE m AS (SELECT user_id, event_type, min(ts) AS ts FROM events WHERE ts IS NOT NULL GROUP BY ALL
UNION ALL SELECT e.user_id, e.event_type, min(e.ts) FROM m JOIN events e ON e.user_id IS NOT DISTINCT FROM m.user_id AND e.event_type IS NOT DISTINCT FROM m.event_type AND e.ts > m.ts + INTERVAL 1 HOUR GROUP BY e.user_id, e.event_type)
SELECT user_id, event_type, count(*) AS misses FROM m GROUP BY ALL"""
)
def stream_dedupe_ttl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An answer serves its user and type for an hour from its request, across the clock's hours; the files of the table may
    come in any order of time."""
    path = scratch(spark, "misses")
    events = jobs.table_stream(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    misses = jobs.answered_anew(events, keys=["user_id", "event_type"], late=None)
    jobs.drain(misses, lambda batch, number: batch.write.mode("overwrite").parquet(f"{path}/batch={number}"), "update")
    return spark.read.parquet(path).groupBy("user_id", "event_type").agg(F.sum("change").alias("misses"))


@query("SELECT date_trunc('hour', ts)::TIMESTAMP AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "metrics")
    events = jobs.table_stream(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    jobs.drain(jobs.metrics(events), lambda batch, number: batch.write.mode("overwrite").parquet(f"{path}/batch={number}"), "update")
    last = spark.read.parquet(path).groupBy("window", "event_type").agg(F.max_by(F.struct("n", "total"), "batch").alias("s"))
    return last.select("window", "event_type", "s.*").select(F.col("window.start").alias("hour"), "event_type", "n", F.round("total", 4).alias("total"))
