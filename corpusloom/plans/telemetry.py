"""Queries over telemetry (the events stand for requests) and over retrieval results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import evidence as E
from corpusloom.operators import metrics as M
from corpusloom.operators import querylog as Q
from corpusloom.operators import quantiles
from corpusloom.operators import retrieve as R
from corpusloom.plans.base import ladder_sql, query
from corpusloom.plans.evidence import FORMATS
from corpusloom.plans.querylog import TURNS, turns
from corpusloom.plans.retrieval import CHUNKS, HITS, K, chunks, hits, keyword_sql, passages, q_sql
from corpusloom.functions import dictionaries as D
from corpusloom.sources.tables import table, written

_OUTCOME = "CASE event_type WHEN 'purchase' THEN 'rag' WHEN 'view' THEN 'rag' WHEN 'click' THEN 'cache_hit' WHEN 'error' THEN 'fallback' ELSE 'fast' END"


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return events.select(
        "event_id", "ts", "user_id", "event_type", "value", F.expr(_OUTCOME).alias("outcome"), F.col("value").alias("retrieval_ms"), (F.col("value") * 2).alias("generation_ms"),
        (F.col("event_id") % 7).alias("chunks"), ((F.col("event_id") % 100) / 100).alias("confidence"),
    )


_MEAN = "round(coalesce(sum({}) FILTER (outcome = 'rag'), 0) / greatest(1, count(*) FILTER (outcome = 'rag')), 6)::DOUBLE AS mean_{}"
_COLS = {"retrieval_ms": "value", "generation_ms": "value * 2", "chunks": "event_id % 7", "confidence": "(event_id % 100) / 100"}


@query(
    f"""WITH r AS (SELECT *, {_OUTCOME} AS outcome FROM events) SELECT count(*) AS total, count(*) FILTER (outcome = 'rag') AS rag_total,
round(count(*) FILTER (outcome = 'cache_hit') / greatest(1, count(*)), 6) AS cache_hit_rate, round(count(*) FILTER (outcome = 'fallback') / greatest(1, count(*)), 6) AS fallback_rate, {", ".join(_MEAN.format(v, k) for k, v in _COLS.items())} FROM r"""
)
def pipeline_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.pipeline_metrics(requests(spark, sf_dir))


@query(
    """WITH t AS (SELECT event_type AS engine, value IS NOT NULL AS handled, value AS ms FROM events UNION ALL SELECT 'total', TRUE, value + 1 FROM events)
SELECT engine, count(*) AS calls, count(*) FILTER (handled) AS handled, round(avg(ms), 6) AS mean_ms, max(ms) AS max_ms, round(count(*) FILTER (ms > 25) / count(*), 6) AS over_budget,
quantile_disc(ms, 0.5) AS p50, quantile_disc(ms, 0.95) AS p95, quantile_disc(ms, 0.99) AS p99 FROM t GROUP BY engine"""
)
def stage_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    step = lambda e, h, ms: F.struct(e.alias("engine"), h.alias("handled"), ms.alias("ms"))
    trace = F.array(step(F.col("event_type"), F.col("value").isNotNull(), F.col("value")), step(F.lit("total"), F.lit(True), F.col("value") + 1))
    return M.stage_latency(table(spark, sf_dir, "events").select(trace.alias("trace")))


@query("SELECT event_type AS engine, date_trunc('day', ts)::TIMESTAMP AS period, count(value) AS n, TRUE AS within FROM events WHERE value IS NOT NULL GROUP BY ALL")
def latency_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketches by hour, merged to days; whether the day's 50th, 95th and 99th percentiles stand at their rank."""
    events = table(spark, sf_dir, "events").select(F.col("event_type").alias("engine"), "ts", "value")
    hours = written(quantiles.sketched(events, ["engine"], F.col("value"), F.date_trunc("hour", "ts")), "hours")
    days = quantiles.quantiles(quantiles.merged(hours, ["engine"], F.date_trunc("day", "period")), ["engine"])
    each = events.select("engine", F.date_trunc("day", "ts").alias("period"), F.col("value").cast("double").alias("value")).filter("value is not null")
    met = each.join(F.broadcast(days), ["engine", "period"])
    ranks = met.groupBy("engine", "period", "n").agg(*[F.count_if(F.col("value") < F.col(f"p{p}")).alias(f"below{p}") for p in (50, 95, 99)], *[F.count_if(F.col("value") <= F.col(f"p{p}")).alias(f"upto{p}") for p in (50, 95, 99)])
    error = quantiles.RANK_ERROR * F.col("n") + 1
    fits = [(F.col(f"below{p}") <= p / 100 * F.col("n") + error) & (F.col(f"upto{p}") >= p / 100 * F.col("n") - error) for p in (50, 95, 99)]
    return ranks.select("engine", "period", "n", (fits[0] & fits[1] & fits[2]).alias("within"))


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("provider"), F.struct("ts", "event_id").alias("at"), (F.col("event_type") != "error").alias("ok"))


@query(
    """WITH c AS (SELECT user_id AS provider, event_type <> 'error' AS ok, sum((event_type <> 'error')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM events),
r AS (SELECT provider, island, count(*) AS n FROM c WHERE NOT ok GROUP BY ALL) SELECT provider, sum(n)::BIGINT AS failures, max(n) AS longest_run FROM r GROUP BY provider"""
)
def failure_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.failure_runs(calls(spark, sf_dir))


@query(
    """WITH RECURSIVE c AS (SELECT user_id AS provider, event_type <> 'error' AS ok, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
w AS (SELECT DISTINCT user_id AS provider, 0::BIGINT AS i, 100::DOUBLE AS health, 0 AS run, TRUE AS active FROM events
UNION ALL SELECT provider, i, health, run, active AND (ok OR (run < 5 AND health >= 30)) FROM (
  SELECT provider, c.i, CASE WHEN ok THEN least(100, health + 2) ELSE greatest(0, health - 15) END::DOUBLE AS health, CASE WHEN ok THEN 0 ELSE run + 1 END AS run, active, ok
  FROM w JOIN c USING (provider) WHERE c.i = w.i + 1))
SELECT provider, arg_max(health, i) AS health, arg_max(active, i) AS active FROM w GROUP BY provider"""
)
def provider_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.provider_health(calls(spark, sf_dir))


@query(
    f"""WITH {q_sql(False)}, {CHUNKS}, {keyword_sql(K)}, e AS (SELECT b.item_id AS query_id, CASE WHEN b.item_id % 2 = 0 THEN 'even' ELSE 'odd' END AS category, d.doc_id AS item FROM benchmark b JOIN documents d ON contains(d.text, b.text)),
h AS (SELECT query_id, split_part(chunk_id, '-', 1)::BIGINT AS item, min(rank) AS rank FROM keyword GROUP BY ALL), m AS (SELECT category, query_id, count(rank) / count(*) AS recall, min(rank) AS first FROM e LEFT JOIN h USING (query_id, item) GROUP BY ALL)
SELECT category, count(*) AS queries, round(avg(recall), 6) AS recall, round(avg((first IS NOT NULL)::INT), 6) AS hit_rate, round(avg(coalesce(1 / first, 0)), 6) AS mrr FROM m GROUP BY category"""
)
def retrieval_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyword search with whole passages against the documents that hold them."""
    asked = passages(spark, sf_dir, False)
    found = R.keyword_topk(asked, chunks(spark, sf_dir), K)
    documents = found.groupBy("query_id", F.split_part("chunk_id", F.lit("-"), F.lit(1)).cast("bigint").alias("item")).agg(F.min("rank").alias("rank"))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item"), "text")
    truth = R.held_passages(asked.select(F.col("text").alias("needle")), docs).join(asked.withColumnRenamed("text", "needle"), "needle")
    expected = truth.select("query_id", F.when(F.col("query_id") % 2 == 0, "even").otherwise("odd").alias("category"), "item")
    return M.retrieval_eval(expected, documents, K)


_INTENT = ladder_sql("lower(text)", D.INTENTS, "Unknown")
_CITED = "cited AS (SELECT query_id, count(DISTINCT version_id || '-' || chunk_index) AS citations FROM hits GROUP BY query_id)"


@query(
    f"""WITH {HITS}, {_CITED}, a AS (SELECT query_id, {_INTENT} AS intent, {FORMATS} AS format FROM q),
e AS (SELECT *, 'c' || query_id % 3 AS category, ['Unknown', 'Policy'][query_id % 2 + 1] AS want_intent, ['Paragraph', 'Bullet list'][query_id % 2 + 1] AS want_format, query_id % 4 AS want FROM a LEFT JOIN cited USING (query_id))
SELECT category, count(*) AS queries, round(count(*) FILTER (intent = want_intent) / count(*), 6) AS intent_agreement, round(count(*) FILTER (format = want_format) / count(*), 6) AS format_agreement,
round(count(*) FILTER (coalesce(citations, 0) >= want) / count(*), 6) AS citation_agreement FROM e GROUP BY category"""
)
def expectation_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expectations that alternate over the queries against what the rules and the keyword search give."""
    asked, n = passages(spark, sf_dir), F.col("query_id")
    cited = E.citation_index(hits(spark, sf_dir).select("query_id", "rank", F.col("version_id").alias("filename"), F.col("chunk_index").alias("page")))
    answered = asked.select("query_id", Q.classify_intent(F.col("text")).alias("intent"), E.plan_format(F.col("text")).alias("format"))
    answered = answered.join(cited.groupBy("query_id").agg(F.count("*").alias("citations")), "query_id", "left")
    odd = n % 2 == 1
    expected = asked.select(
        "query_id", F.concat(F.lit("c"), n % 3).alias("category"), F.when(odd, "Policy").otherwise("Unknown").alias("intent"),
        F.when(odd, "Bullet list").otherwise("Paragraph").alias("format"), (n % 4).alias("citations"),
    )
    return M.expectation_agreement(expected, answered)


_DECISIONS = [*D.INTENTS, "Unknown"]


@query(
    f"WITH {TURNS}, r AS (SELECT 'q' || turn % 3 AS expected, {ladder_sql('lower(text)', D.INTENTS, 'Unknown')} AS predicted FROM turns) SELECT expected, "
    + ", ".join(f"count(*) FILTER (predicted = '{n}') AS \"{n}\"" for n in _DECISIONS)
    + " FROM r GROUP BY expected"
)
def route_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = turns(spark, sf_dir).select(F.concat(F.lit("q"), F.col("turn") % 3).alias("expected"), Q.classify_intent(F.col("text")).alias("predicted"))
    return M.route_confusion(rows, _DECISIONS)


def cache_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's events as requests for one answer."""
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), at.alias("at"), (F.col("event_type") == "error").alias("failed"))


@query(
    """WITH RECURSIVE c AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY "at", failed) AS i FROM (SELECT user_id AS key, epoch_us(ts) / 1e6 AS "at", event_type = 'error' AS failed FROM events)),
w AS (SELECT DISTINCT key, 0::BIGINT AS i, NULL::DOUBLE AS stored, FALSE AS hit FROM c
UNION ALL SELECT key, i, CASE WHEN hit THEN stored WHEN NOT failed THEN "at" END, hit FROM (
  SELECT key, c.i, c."at", c.failed, stored, coalesce(c."at" - stored <= 86400, FALSE) AS hit FROM w JOIN c USING (key) WHERE c.i = w.i + 1))
SELECT key, max(i) AS requests, count(*) FILTER (hit) AS hits FROM w GROUP BY key"""
)
def cache_simulate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.cache_simulate(cache_log(spark, sf_dir), 86_400)


@query(
    """WITH g AS (SELECT user_id AS key, epoch_us(ts) / 1e6 - lag(epoch_us(ts) / 1e6) OVER (PARTITION BY user_id ORDER BY ts) AS gap FROM events)
SELECT key, count(*) AS requests, count(*) FILTER (gap <= 86400) AS hits_at_most FROM g GROUP BY key"""
)
def cache_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.cache_bound(cache_log(spark, sf_dir), 86_400)


@query(f"WITH {HITS} SELECT query_id, sha256(string_agg(chunk_id, '' ORDER BY chunk_id)) AS evidence_hash FROM hits GROUP BY query_id")
def evidence_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.evidence_hash(hits(spark, sf_dir))
