"""Structured Streaming forms of ingestion, routing, session state, caching and metrics. Each drains what is there
(availableNow) by default; every state and sink is in the shared folder."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from corpusloom.functions import text as T
from corpusloom.operators import chunk, embed, querylog, registry
from corpusloom.operators import sessions as S
from corpusloom.sources.snapshots import delete_versions, write_chunks
from corpusloom.sources.tables import scratch


STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def table_stream(spark: SparkSession, sf_dir: str, name: str, files_per_batch: int = 100) -> DataFrame:
    """A Parquet table, file by file; a table of one file is picked from its folder."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
    schema = spark.read.parquet(str(path)).schema
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory():
        return reader.parquet(str(path))
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def drain(stream: DataFrame, each: Callable[[DataFrame, int], None], mode: str = "append") -> StreamingQuery:
    """Runs `each` on every micro-batch of what is there. State is kept in RocksDB, beyond what memory holds."""
    conf = stream.sparkSession.conf
    before = conf.get(STORE, None)
    conf.set(STORE, ROCKSDB)
    try:
        query = stream.writeStream.outputMode(mode).option("checkpointLocation", scratch(stream.sparkSession, "stream")).trigger(availableNow=True).foreachBatch(each).start()
    finally:
        # A query has its own copy of the settings.
        conf.unset(STORE) if before is None else conf.set(STORE, before)
    query.awaitTermination()
    return query


#: Pattern of a character that a chunk may hold alone: none of those that Python strips.
INK = r"[^\s\p{Z}\x1c-\x1f\x85]"
#: Parts of the registry, by checksum and by filename; a batch reads those that it may meet.
PARTS = 64


def part_of(key: str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(PARTS)).cast("int")


def _known(batch: DataFrame, path: str, key: str, schema: str, number: int) -> DataFrame:
    """What earlier batches have registered in the parts of the batch's keys."""
    spark = batch.sparkSession
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there):
        return spark.createDataFrame([], schema)
    parts = [r.part for r in batch.select(part_of(key).alias("part")).distinct().collect()]
    return spark.read.schema(f"{schema}, part int, batch bigint").parquet(path).filter(F.col("part").isin(parts) & (F.col("batch") != number)).drop("part", "batch")


#: An entry of the registry; its text arrived first as `arrival`, a number or time of the caller's type.
ENTRY = "checksum string, filename string, arrival {}, version_number bigint, version_id string, error string"


def _earliest(entries: DataFrame) -> DataFrame:
    """The entry of each checksum that counts: a text belongs to the file that it arrived in first."""
    return entries.groupBy("checksum").agg(F.min_by(F.struct("*"), F.struct("arrival", "filename")).alias("e")).select("e.*")


def registered(spark: SparkSession, registry_path: str, arrival: str = "bigint") -> DataFrame:
    """The registry that ingest() keeps: (checksum, filename, arrival, version_number, version_id, error), one row a text."""
    return _earliest(spark.read.schema(f"{ENTRY.format(arrival)}, part int, batch bigint").parquet(f"{registry_path}/checksums").drop("part", "batch"))


def ingest(files: DataFrame, registry_path: str, chunk_path: str) -> None:
    """files (arrival, filename, text): new texts are registered with a version, cleaned, cut, embedded and stored; one
    without text (null and an empty one are two) is registered with its error and gets no chunks. The registry lies in parts
    of checksums, and the latest versions in parts of filenames, so a batch reads the parts that it may meet, not all.

    A text belongs to the file of its smallest arrival, in whatever batches and order its copies come: if a later batch brings
    an earlier copy from another file, the text becomes a version of that one and the version it was goes with its chunks.
    A batch that is run again leaves out what it has registered itself and changes nothing."""
    schema = ENTRY.format(files.schema["arrival"].dataType.simpleString())

    def each(batch: DataFrame, number: int) -> None:
        batch = batch.withColumn("checksum", F.coalesce(registry.checksum(F.col("text")), F.lit(""))).persist()
        known = _earliest(_known(batch, f"{registry_path}/checksums", "checksum", schema, number))
        first = batch.groupBy("checksum").agg(F.min("arrival").alias("first"))
        served = known.join(first, "checksum").filter("arrival <= first")
        fresh = registry.dedupe(batch, served).filter("not duplicate").drop("duplicate")
        fresh = fresh.withColumn("version_id", F.sha2(F.concat_ws("|", "filename", "checksum"), 256))
        fresh = fresh.join(known.select("checksum", F.col("version_id").alias("was"), F.col("version_number").alias("was_number")), "checksum", "left")
        same = F.col("was").eqNullSafe(F.col("version_id"))
        latest = _known(batch, f"{registry_path}/names", "filename", "filename string, version_number bigint", number)
        latest = latest.groupBy("filename").agg(F.max("version_number").alias("latest_version"))
        new = registry.assign_versions(fresh.filter(~same), latest)
        fresh = new.unionByName(fresh.filter(same).withColumn("version_number", F.col("was_number")))
        fresh = fresh.withColumn("clean", T.clean_page(F.col("text")))
        fresh = fresh.withColumn("error", registry.failure(F.col("text"), F.when(F.col("clean").rlike(INK), 1).otherwise(0))).persist()
        stored = fresh.filter("error is null").filter(~same)
        pieces = chunk.chunk_recursive(stored.select("version_id", F.col("clean").alias("text")), "version_id")
        write_chunks(embed.embed(pieces, "text").select("version_id", "chunk_index", "text", "hash", "embedding"), chunk_path)
        moved = stored.filter("was is not null").select(F.col("was").alias("version_id"))
        if not moved.isEmpty():
            delete_versions(moved, chunk_path)
        entry = fresh.select("checksum", "filename", "arrival", F.col("version_number").cast("bigint").alias("version_number"), "version_id", "error")
        names = entry.groupBy("filename").agg(F.max("version_number").alias("version_number"))
        for name, key, rows in (("names", "filename", names), ("checksums", "checksum", entry)):
            # One folder a part and batch: written again, it is replaced.
            placed = rows.withColumns({"part": part_of(key), "batch": F.lit(number).cast("bigint")}).hint("rebalance", "part")
            placed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part", "batch").parquet(f"{registry_path}/{name}")
        fresh.unpersist()
        batch.unpersist()

    drain(files, each)


def route(turns: DataFrame, path: str) -> None:
    """Each arriving turn with its intent."""
    classified = turns.withColumn("intent", querylog.classify_intent(F.col("text")))
    drain(classified, lambda batch, number: batch.write.mode("overwrite").parquet(f"{path}/batch={number}"))


#: What a session's state holds: totals, and of the last name, intent, answer and topic the turn they come from.
_LAST = ("name", "last_intent", "preview", "topic")
_PROFILE = f"turns bigint, first_turn bigint, last_turn bigint, greetings bigint, {', '.join(f'{c} string, {c}_turn bigint' for c in _LAST)}"
SESSION = f"conv_id bigint, turns bigint, first_turn bigint, last_turn bigint, greetings bigint, {', '.join(f'{c} string' for c in _LAST)}, history array<string>"


class _Session(StatefulProcessor):
    """Merges a session's turns into its profile; what a turn says has been worked out before. A timer `patience` behind the
    session's last turn drops its state."""

    def __init__(self, patience: int, keep: int):
        self.patience, self.keep = patience, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.profile = handle.getValueState("profile", _PROFILE)
        self.lines = handle.getListState("lines", "turn bigint, line string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        fresh = pd.concat(list(rows)).sort_values("turn", kind="stable")
        n, first, last, greetings, *lasts = self.profile.get() if self.profile.exists() else (0, 2**62, -(2**62), 0, *[None] * 8)
        n, greetings = n + len(fresh), greetings + int(fresh["greeting"].sum())
        first, last = min(first, int(fresh["turn"].min())), max(last, int(fresh["turn"].max()))
        for i, c in enumerate(_LAST):
            some = fresh[fresh[c].notna()]
            if len(some) and (lasts[2 * i + 1] is None or some["turn"].iloc[-1] >= lasts[2 * i + 1]):
                lasts[2 * i : 2 * i + 2] = some[c].iloc[-1], int(some["turn"].iloc[-1])
        lines = [*(self.lines.get() if self.lines.exists() else []), *zip(fresh["turn"].astype(int).tolist(), fresh["line"], strict=True)]
        lines = sorted(lines, key=lambda x: x[0])[-self.keep :]
        self.profile.update((n, first, last, greetings, *lasts))
        self.lines.put([(int(t), x) for t, x in lines])
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(max(int(fresh["ts"].max().timestamp() * 1000), timerValues.getCurrentWatermarkInMs()) + self.patience)
        values = {"turns": n, "first_turn": first, "last_turn": last, "greetings": greetings, **dict(zip(_LAST, lasts[::2], strict=True)), "history": [x for _, x in lines]}
        yield pd.DataFrame({"conv_id": [key[0]], **{k: [v] for k, v in values.items()}})

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.profile.clear()
        self.lines.clear()
        return iter([])

    def close(self) -> None:
        pass


def sessions(turns: DataFrame, idle: str = "1 hour", keep: int = 20, topics: tuple = S.TOPICS) -> DataFrame:
    """turns (conv_id, turn, role, text, ts) -> the running profile of each session, as session_profile() gives it, with its
    last topic and last `keep` messages. An idle session's state is dropped by an event-time timer."""
    role, text = F.col("role"), F.col("text")
    said = turns.withWatermark("ts", idle).select(
        "conv_id", "turn", "ts", F.concat_ws(": ", "role", "text").alias("line"), F.coalesce(S.greets(role, text), F.lit(False)).alias("greeting"), S.name_in(text).alias("name"),
        F.when(role == "user", querylog.classify_intent(text)).alias("last_intent"), F.when(role == "assistant", S.preview_of(text)).alias("preview"),
        F.when(role == "user", S.topic_of(text, topics)).alias("topic"),
    )
    patience = int(pd.Timedelta(idle).total_seconds() * 1000)
    return said.groupBy("conv_id").transformWithStateInPandas(_Session(patience, keep), SESSION, "Update", "EventTime")


def dedupe_ttl(requests: DataFrame, ttl: str = "1 hour", keys: list[str] | None = None, fixed: bool = False) -> DataFrame:
    """The first of the requests (ts) of a key within `ttl`, at least: a key's answer serves until the watermark, `ttl` behind the
    latest request, has passed it by `ttl`, and then its state goes. With `fixed`, it serves until its period of this
    length ends (by the clock), so the result doesn't depend on how requests come in batches."""
    keyed, by = requests.filter("ts is not null").withWatermark("ts", ttl), list(keys or ["key"])
    if not fixed:
        return keyed.dropDuplicatesWithinWatermark(by)
    period = F.floor(F.unix_micros("ts") / F.lit(pd.Timedelta(ttl).value // 1000))
    return keyed.withColumn("period__", period).dropDuplicatesWithinWatermark([*by, "period__"]).drop("period__")


class _Answers(StatefulProcessor):
    """Walks a key's requests in time order, those of earlier batches too. Its state is the times that a later batch may
    still come before, and the last answer before them; with a watermark, both go once no request can meet them."""

    def __init__(self, keys: list[str], ttl: int, bounded: bool):
        self.change, self.ttl, self.bounded = Row(*keys, "at", "change"), ttl, bounded

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.asked = handle.getValueState("asked", "answered bigint, times array<bigint>")

    def walk(self, times: list[int], answered: int | None) -> list[int]:
        """The times that are answered anew: the clock restarts there only."""
        out, i = [], 0 if answered is None else bisect_right(times, answered + self.ttl)
        while i < len(times):
            out.append(times[i])
            i = bisect_right(times, times[i] + self.ttl, i)
        return out

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        answered, times = self.asked.get() or (None, [])
        before = self.walk(times, answered)
        times = sorted({*times, *(r["at"] for r in rows)})
        after = self.walk(times, answered)
        if self.bounded:
            passed = timerValues.getCurrentWatermarkInMs() * 1000
            keep = bisect_right(times, passed)
            done = bisect_right(after, passed)
            self.asked.update((after[done - 1] if done else answered, times[keep:]))
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(max(-(-(times[-1] + self.ttl) // 1000), passed // 1000 + 1))
        else:
            self.asked.update((answered, times))
        for change, changed in ((1, set(after).difference(before)), (-1, set(before).difference(after))):
            for at in changed:
                yield self.change(*key, at, change)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.asked.clear()
        return iter([])

    def close(self) -> None:
        pass


def answered_anew(requests: DataFrame, ttl: str = "1 hour", keys: list[str] | None = None, late: str | None = "1 hour") -> DataFrame:
    """The requests (ts) that an answer of their key, given at most `ttl` before, doesn't serve: (keys, at: microseconds, change).
    An answer's time isn't extended by those that it serves. Requests may come in any order: one that comes behind later
    ones changes what was said of them, so a change is 1 for a request to answer anew and -1 where that no longer holds;
    their sum is right after every batch. Requests more than `late` behind the latest are dropped, and state that none
    can meet goes; without `late`, as for a table whose files are in no order of time, all requests count and are kept."""
    by = list(keys or ["key"])
    timed = requests.filter("ts is not null")
    timed = (timed.withWatermark("ts", late) if late else timed).withColumn("at", F.unix_micros("ts"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in timed.select(*by, "at").schema)
    processor = _Answers(by, pd.Timedelta(ttl).value // 1000, late is not None)
    return timed.select(*by, "at", *(["ts"] if late else [])).groupBy(*by).transformWithState(processor, f"{fields}, change int", "Update", "EventTime" if late else "None")


def metrics(events: DataFrame, late: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """Requests and values per hour and type; rows later than `late` are dropped, and so is the state of windows before
    that. In update mode a batch gives the windows that it changed."""
    by = F.window("ts", size)
    return events.withWatermark("ts", late).groupBy(by, "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
