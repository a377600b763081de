"""Telemetry and evaluation."""

from __future__ import annotations

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BUDGET_MS = 25
TTL = 3600
#: Marks of an answer that failed.
FAILURES = ("unknown query", "information unavailable", "couldn't find enough information", "fallback", "timeout", "clarification", "database", "failure", "error")


def pipeline_metrics(log: DataFrame) -> DataFrame:
    """log (outcome in rag, cache_hit, fallback, …; retrieval_ms, generation_ms, chunks, confidence) -> one row of totals and
    means; means are over the rag rows."""
    of = lambda o: F.count_if(F.col("outcome") == o)
    share = lambda o: F.round(of(o) / F.greatest(F.lit(1), F.count("*")), 6)
    mean = lambda c: F.round(F.coalesce(F.sum(F.when(F.col("outcome") == "rag", F.col(c))), F.lit(0)) / F.greatest(F.lit(1), of("rag")), 6)
    return log.agg(
        F.count("*").alias("total"), of("rag").alias("rag_total"), share("cache_hit").alias("cache_hit_rate"), share("fallback").alias("fallback_rate"),
        *[mean(c).alias(f"mean_{c}") for c in ("retrieval_ms", "generation_ms", "chunks", "confidence")],
    )


def stage_latency(traces: DataFrame, budget: float = BUDGET_MS) -> DataFrame:
    """traces (trace: array of (engine, handled, ms)) -> per engine: calls, handled, mean, largest, share over the budget, and
    the median, 95th and 99th percentile. (quantiles.sketched keeps them by hour, to be merged.)"""
    each = traces.select(F.explode("trace").alias("t")).select("t.*")
    return each.groupBy("engine").agg(
        F.count("*").alias("calls"), F.count_if("handled").alias("handled"), F.round(F.avg("ms"), 6).alias("mean_ms"), F.max("ms").alias("max_ms"),
        F.round(F.count_if(F.col("ms") > budget) / F.count("*"), 6).alias("over_budget"), *percentiles("ms"),
    )


#: Inverse of the relative rank error of percentiles.
ACCURACY = 100_000


def percentiles(column: str) -> list[Column]:
    return [F.percentile_approx(column, p / 100, ACCURACY).alias(f"p{p}") for p in (50, 95, 99)]


def _stretches(calls: DataFrame) -> DataFrame:
    """calls (provider, at, ok), dealt by ranges of provider and time, so that a busy provider is walked in several tasks.
    Each leaves a stretch: its failures, the runs of them at its head and tail and the longest one, the health it gives as
    clamp(x + d, low, high) of the health x before it, and the least x at which no failure in it falls under 30. What maps
    one stretch to the next composes, so fold() gives what a walk from end to end would."""

    def walk(it):
        part, out, now = TaskContext.get().partitionId(), [], None
        for pdf in it:
            for provider, ok in zip(pdf["provider"].tolist(), pdf["ok"].tolist(), strict=True):
                if now is None or provider != out[-1][0]:
                    out += [[*out.pop(), *now]] if now else []
                    out.append([provider, part])
                    n = failures = head = run = longest = 0
                    d, low, high, least = 0.0, 0.0, 100.0, 0.0
                step = 2 if ok else -15
                d, low, high = d + step, min(100.0, max(0.0, low + step)), min(100.0, max(0.0, high + step))
                n, failures, run = n + 1, failures + (not ok), 0 if ok else run + 1
                longest, head = max(longest, run), run if run == n else head
                if not ok and low < 30:
                    least = max(least, 30 - d if high >= 30 else 101.0)
                now = (n, failures, head, run, longest, d, low, high, least)
        if now:
            yield pd.DataFrame([*out[:-1], [*out[-1], *now]], columns=names)

    kind = calls.schema["provider"].dataType.simpleString()
    fields = [("provider", kind), ("part", "int"), *[(c, "bigint") for c in ("n", "failures", "head", "tail", "longest")], *[(c, "double") for c in ("d", "low", "high", "least")]]
    names = [c for c, _ in fields]
    ordered = calls.select("provider", "at", "ok").filter("provider is not null").repartitionByRange("provider", "at").sortWithinPartitions("provider", "at")
    return ordered.mapInPandas(walk, ", ".join(f"{c} {t}" for c, t in fields))


def _fold(stretches: DataFrame) -> DataFrame:
    """(provider, failures, s: health, run, longest, active): one stretch a task at most is in a provider's list."""
    parts = stretches.groupBy("provider").agg(F.sum("failures").alias("failures"), F.array_sort(F.collect_list(F.struct(*stretches.columns[1:]))).alias("parts"))
    start = F.struct(F.lit(100.0).alias("health"), F.lit(0).cast("bigint").alias("run"), F.lit(0).cast("bigint").alias("longest"), F.lit(True).alias("active"))

    def step(s: Column, p: Column) -> Column:
        longest = F.greatest(s["longest"], p["longest"], s["run"] + p["head"])
        return F.struct(
            F.least(p["high"], F.greatest(p["low"], s["health"] + p["d"])).alias("health"), F.when(p["failures"] == p["n"], s["run"] + p["n"]).otherwise(p["tail"]).alias("run"),
            longest.alias("longest"), (s["active"] & (longest < 5) & (s["health"] >= p["least"])).alias("active"),
        )

    return parts.select("provider", "failures", F.aggregate("parts", start, step).alias("s"))


def failure_runs(calls: DataFrame) -> DataFrame:
    """calls (provider, at, ok) -> per provider that failed: failures and the longest run of them."""
    return _fold(_stretches(calls)).filter("failures > 0").select("provider", "failures", F.col("s.longest").alias("longest_run"))


def provider_health(calls: DataFrame) -> DataFrame:
    """(provider, health, active): a walk from 100, +2 a success and -15 a failure between 0 and 100; five failures in a row or
    less than 30 disable."""
    return _fold(_stretches(calls)).select("provider", "s.health", "s.active")


def retrieval_eval(expected: DataFrame, hits: DataFrame, k: int) -> DataFrame:
    """expected (query_id, category, item), hits (query_id, item, rank) -> per category: queries, recall@k, hit rate, MRR."""
    met = expected.join(hits.filter(F.col("rank") <= k), ["query_id", "item"], "left")
    by_query = met.groupBy("category", "query_id").agg((F.count("rank") / F.count("*")).alias("recall"), F.min("rank").alias("first"))
    return by_query.groupBy("category").agg(
        F.count("*").alias("queries"), F.round(F.avg("recall"), 6).alias("recall"), F.round(F.avg(F.col("first").isNotNull().cast("int")), 6).alias("hit_rate"),
        F.round(F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))), 6).alias("mrr"),
    )


def expectation_agreement(expected: DataFrame, answered: DataFrame) -> DataFrame:
    """expected (query_id, category, intent, format, citations), answered (query_id, the same) -> per category: queries and
    the shares whose intent and format are the expected ones and that cite as many sources or more."""
    got = answered.select("query_id", *[F.col(c).alias(f"{c}__") for c in ("intent", "format", "citations")])
    both = expected.join(got, "query_id", "left")
    share = lambda ok: F.round(F.count_if(ok) / F.count("*"), 6)
    return both.groupBy("category").agg(
        F.count("*").alias("queries"), share(F.col("intent") == F.col("intent__")).alias("intent_agreement"), share(F.col("format") == F.col("format__")).alias("format_agreement"),
        share(F.coalesce("citations__", F.lit(0)) >= F.col("citations")).alias("citation_agreement"),
    )


def route_confusion(rows: DataFrame, decisions: list[str]) -> DataFrame:
    return rows.groupBy("expected").pivot("predicted", decisions).count().na.fill(0)


def is_failure(answer: Column) -> Column:
    return F.lower(answer).rlike("|".join(FAILURES))


def cache_simulate(log: DataFrame, ttl: float = TTL) -> DataFrame:
    """log (key, at: seconds, failed) -> per key: requests and hits. A hit needs an answer stored at most ttl ago; the clock
    restarts on a miss only, and failed answers aren't stored. Keys are walked in time order, in one pass of batches."""

    def steps(it):
        state: dict = {}
        for pdf in it:
            for key, at, failed in zip(pdf["key"], pdf["at"], pdf["failed"], strict=True):
                n, hits, stored = state.get(key, (0, 0, None))
                if stored is not None and at - stored <= ttl:
                    hits += 1
                else:
                    stored = None if failed else at
                state[key] = (n + 1, hits, stored)
            last = pdf["key"].iloc[-1] if len(pdf) else None
            done = [(k, n, h) for k, (n, h, _) in state.items() if k != last]
            if done:
                yield pd.DataFrame(done, columns=["key", "requests", "hits"])
                state = {last: state[last]}
        if state:
            yield pd.DataFrame([(k, n, h) for k, (n, h, _) in state.items()], columns=["key", "requests", "hits"])

    ordered = log.select("key", "at", "failed").repartition("key").sortWithinPartitions("key", "at", "failed")
    kind = log.schema["key"].dataType.simpleString()
    return ordered.mapInPandas(steps, f"key {kind}, requests bigint, hits bigint")


def cache_bound(log: DataFrame, ttl: float = TTL) -> DataFrame:
    """At most so many hits: requests that come within ttl of the one before with the same key."""
    gap = F.col("at") - F.lag("at").over(Window.partitionBy("key").orderBy("at"))
    return log.withColumn("near", gap <= ttl).groupBy("key").agg(F.count("*").alias("requests"), F.count_if("near").alias("hits_at_most"))


def evidence_hash(hits: DataFrame) -> DataFrame:
    """The same for any order of a query's chunks."""
    return hits.groupBy("query_id").agg(F.sha2(F.array_join(F.sort_array(F.collect_list("chunk_id")), ""), 256).alias("evidence_hash"))
