"""Sources and sinks: the corpus tables, raw files, expectation files, and the audit table."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EXPECTATION = (
    "id string, category string, query string, expected_chunks array<string>, expected_intent string, "
    "expected_confidence string, expected_citations int, expected_format string, required_intent string"
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df over as many partitions as there are cores, if its files give fewer: worth a shuffle before costly expressions on
    small inputs. A large table has more splits than cores and is left alone."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


#: Rows of a side that is broadcast.
BROADCAST_ROWS = 100_000


def counted(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has no more than `most` rows; else the join is left to adaptive execution."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that all executors share, deleted when the driver ends."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors see")
        folder = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    folder = folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"
    path = f"{folder}/{name}-{uuid.uuid4().hex}"
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(there)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scan_files(spark: SparkSession, path: str, glob: str = "*.{txt,md,markdown}") -> DataFrame:
    """Raw text files as (path, length, modified, text); bytes that aren't UTF-8 are left out."""

    def decode(batches):
        for b in batches:
            text = pa.array([raw.decode("utf-8", "ignore") for raw in b.column("content").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([b.column("path"), b.column("length"), b.column("modified"), text], ["path", "length", "modified", "text"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    files = files.select("path", "length", F.col("modificationTime").alias("modified"), "content")
    return files.mapInArrow(decode, "path string, length bigint, modified timestamp, text string")


def scan_expectations(spark: SparkSession, path: str) -> DataFrame:
    """Golden queries and benchmark expectations, either form; fields that a file lacks are null."""
    return spark.read.option("multiLine", True).schema(EXPECTATION).json(path)


def append_upload_log(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)
