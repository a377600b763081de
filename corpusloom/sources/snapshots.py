"""Chunk tables as snapshots: files are only ever added, and a log says which of them are live.

    <path>/data/commit__=<name>/…   the chunks that one commit wrote
    <path>/log/<number>/…           (version_id, commit__, gone): the versions that it replaced, and where they are since;
                                    commit__ is null where a version was deleted

A commit writes its chunks, then its part of the log under another name, and renames that to the next free number: the one
step that makes it visible, which fails if another writer took the number, and is then tried with the next. Writing a version
reads and rewrites nothing of the others. A reader takes the log as it is listed and the files that it names, none of which
changes any more, so a write in between doesn't touch it; a write that is killed leaves files that no log names. Of
several commits of a version the last one counts.

After LOG_COMMITS commits the log is written anew as one (`log/<number>/_BASE` marks it; its rows with `gone` are superseded
chunks in files that hold others still); then, or when it is called, `compact`
writes the live chunks anew if they are due (MOST_DEAD, MOST_COMMITS). `vacuum` deletes what no reader needs. The
rename must be atomic and must not overwrite: so it is on HDFS and on local file systems; an object store needs a
committer that offers it.
"""

from __future__ import annotations

import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.sources.tables import counted

#: Commits after which the log is written as one.
LOG_COMMITS = 64
#: The share of superseded versions, and the number of commits with live files, beyond which a compaction is due.
MOST_DEAD, MOST_COMMITS = 0.3, 256
_DIGITS = 12


class _Folder:
    """A table's folder through Hadoop's file system."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.hadoop = spark._jvm.org.apache.hadoop.fs
        self.conf = spark._jsc.hadoopConfiguration()
        self.fs = self.at("").getFileSystem(self.conf)

    def at(self, name: str):
        return self.hadoop.Path(f"{self.path}/{name}" if name else self.path)

    def exists(self, name: str) -> bool:
        return self.fs.exists(self.at(name))

    def listed(self, name: str) -> list[tuple[str, int]]:
        """(name, time of change) of what a folder holds."""
        if not self.exists(name):
            return []
        return sorted((s.getPath().getName(), s.getModificationTime()) for s in self.fs.listStatus(self.at(name)))

    def rename(self, old: str, new: str) -> bool:
        """False if the new name is taken."""
        whole = [p.makeQualified(self.fs.getUri(), self.fs.getWorkingDirectory()) for p in (self.at(old), self.at(new))]
        rule = getattr(self.hadoop, "Options$Rename")
        none = self.spark.sparkContext._gateway.new_array(rule, 0)
        try:
            self.hadoop.FileContext.getFileContext(whole[0].toUri(), self.conf).rename(*whole, none)
        except Py4JJavaError as e:
            if "FileAlreadyExistsException" in str(e.java_exception) or self.exists(new):
                return False
            raise
        return True

    def numbers(self) -> list[int]:
        return [int(name) for name, _ in self.listed("log") if name.isdigit()]


def _log(folder: _Folder, upto: int | None = None) -> tuple[list[int], DataFrame | None]:
    """The commits since the last base, and their log (number, version_id, commit__, gone)."""
    numbers = [n for n in folder.numbers() if upto is None or n <= upto]
    base = next((n for n in reversed(numbers) if folder.exists(f"log/{n:0{_DIGITS}}/_BASE")), None)
    numbers = [n for n in numbers if base is None or n >= base]
    if not numbers:
        return [], None
    paths = [f"{folder.path}/log/{n:0{_DIGITS}}" for n in numbers]
    rows = folder.spark.read.parquet(*paths)
    number = F.regexp_extract(F.input_file_name(), r"/log/(\d+)/", 1).cast("bigint")
    return numbers, rows.select("version_id", "commit__", "gone", number.alias("number"))


def _live(log: DataFrame) -> DataFrame:
    """(version_id, commit__): where each version is."""
    last = log.filter("not gone").groupBy("version_id").agg(F.max_by("commit__", "number").alias("commit__"))
    return last.filter("commit__ is not null")


def _gone(log: DataFrame) -> DataFrame:
    """(version_id, commit__) of superseded chunks."""
    return log.filter("commit__ is not null").select("version_id", "commit__").distinct().join(_live(log), ["version_id", "commit__"], "left_anti")


def _commit(folder: _Folder, entries: DataFrame, base: bool = False, number: int | None = None) -> int | None:
    """Makes entries (version_id, commit__, gone) visible; with a number given, only under that one."""
    name = f"log/.{uuid.uuid4().hex}"
    entries.write.parquet(f"{folder.path}/{name}")
    if base:
        folder.fs.create(folder.at(f"{name}/_BASE")).close()
    at = number or max(folder.numbers(), default=0) + 1
    while not folder.rename(name, f"log/{at:0{_DIGITS}}"):
        if number:
            return None
        at += 1
    return at


def _add(folder: _Folder, chunks: DataFrame) -> tuple[str, DataFrame]:
    """Writes chunks; (the commit's name, its entries of the log)."""
    name = f"c-{uuid.uuid4().hex}"
    place = f"{folder.path}/data/commit__={name}"
    # Rebalancing splits a large version over several tasks and files, and joins small ones.
    chunks.hint("rebalance", "version_id").write.parquet(place)
    stored = folder.spark.read.schema(chunks.schema).parquet(place)
    return name, stored.select("version_id").distinct().withColumns({"commit__": F.lit(name), "gone": F.lit(False)})


def write_chunks(chunks: DataFrame, path: str, log_commits: int = LOG_COMMITS) -> int:
    """Replaces the versions that `chunks` (version_id, ...) holds by them; the number of the commit."""
    folder = _Folder(chunks.sparkSession, path)
    number = _commit(folder, _add(folder, chunks)[1])
    return _shortened(folder, number, log_commits)


def delete_versions(versions: DataFrame, path: str, log_commits: int = LOG_COMMITS) -> int:
    """Takes the versions (version_id) out of the table; the number of the commit."""
    folder = _Folder(versions.sparkSession, path)
    entries = versions.select("version_id", F.lit(None).cast("string").alias("commit__"), F.lit(False).alias("gone")).distinct()
    return _shortened(folder, _commit(folder, entries), log_commits)


def _shortened(folder: _Folder, number: int, log_commits: int) -> int:
    numbers, log = _log(folder)
    if len(numbers) > log_commits:
        # Another writer's commit in between takes the number; then the log stays as it is until the next one.
        live = _live(log).withColumn("gone", F.lit(False))
        held = _gone(log).join(live.select("commit__").distinct(), "commit__", "left_semi").withColumn("gone", F.lit(True))
        _commit(folder, live.unionByName(held), True, numbers[-1] + 1)
        compact(folder.spark, folder.path)
    return number


def read_chunks(spark: SparkSession, path: str, upto: int | None = None) -> DataFrame:
    """The live chunks, as of now or as of a commit. Few versions are superseded between two compactions, so these are what
    the files are held against, not the live ones."""
    folder = _Folder(spark, path)
    _, log = _log(folder, upto)
    if log is None:
        raise ValueError(f"no chunk table at {path}")
    commits = [r.commit__ for r in log.select("commit__").distinct().collect() if r.commit__]
    if not commits:
        raise ValueError(f"no chunks at {path}")
    data = spark.read.option("basePath", f"{folder.path}/data").parquet(*[f"{folder.path}/data/commit__={c}" for c in sorted(commits)])
    return data.join(counted(_gone(log)), ["version_id", "commit__"], "left_anti").drop("commit__")


def dead_share(spark: SparkSession, path: str) -> float:
    """The share of the log's stored versions that are superseded."""
    _, log = _log(_Folder(spark, path))
    gone = _gone(log).count()
    return gone / max(1, gone + _live(log).count())


def compact(spark: SparkSession, path: str, most_dead: float = MOST_DEAD, most_commits: int = MOST_COMMITS) -> bool:
    """Writes the live chunks anew if over `most_dead` of the stored versions are superseded or they come from more than
    `most_commits` commits. A commit of another writer in between wins, and the table stays as it was."""
    folder = _Folder(spark, path)
    numbers, log = _log(folder)
    if log is None or dead_share(spark, path) <= most_dead and log.select("commit__").distinct().count() <= most_commits:
        return False
    _, entries = _add(folder, read_chunks(spark, path, numbers[-1]))
    return _commit(folder, entries, True, numbers[-1] + 1) is not None


def vacuum(spark: SparkSession, path: str, keep_seconds: int = 7 * 86400) -> list[str]:
    """Deletes data and log folders that the table's present state doesn't need and that are older than any reader or writer
    that may still use them."""
    folder = _Folder(spark, path)
    numbers, log = _log(folder)
    live = {f"commit__={r.commit__}" for r in log.select("commit__").distinct().collect()} if log is not None else set()
    needed = {f"{n:0{_DIGITS}}" for n in numbers}
    before, gone = (time.time() - keep_seconds) * 1000, []
    for place, kept in (("data", live), ("log", needed)):
        for name, changed in folder.listed(place):
            if name not in kept and changed <= before:
                folder.fs.delete(folder.at(f"{place}/{name}"), True)
                gone.append(f"{place}/{name}")
    return gone
