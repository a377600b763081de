"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Regular expression of a word in the ASCII-folded texts: digits, letters and everything beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Regular expression of a word between ASCII white space.
TOKEN = r"[^\x20\x09-\x0D]+"

#: Maps the UTF-8 bytes of a text to lower-cased words (as WORD defines them) between blanks.
WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def words(raw: bytes | None) -> list[bytes]:
    """The WORD words of a text, from its UTF-8 bytes."""
    return raw.translate(WORD_BYTES).split() if raw else []


def tokens(raw: bytes | None) -> list[bytes]:
    """The TOKEN words of a text with A-Z lower-cased; bytes.split and bytes.lower know ASCII only."""
    return raw.lower().split() if raw else []


def utf8(column: Column) -> Column:
    return column.cast("string").cast("binary")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see, spark.checkpoint.dir. Only a session on one machine may leave it unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors see")
        folder = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, deleted when the driver ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(there)
    return path


#: Share of the driver's heap beyond which what finished steps have left there goes before the next one.
MOST_HEAP = 0.5


def release(spark: SparkSession, most: float | None = None) -> bool:
    """Collects the driver's garbage if its heap has grown beyond the share `most` (MOST_HEAP) of what it may take. Operators of a hundred
    exchanges leave plans, broadcasts and the records of their tasks behind; a heap that grows with them stays that large,
    and the shuffle files and broadcasts on the executors go only when the driver has dropped what stood for them."""
    heap = spark._jvm.java.lang.Runtime.getRuntime()
    if heap.totalMemory() <= (MOST_HEAP if most is None else most) * heap.maxMemory():
        return False
    spark._jvm.java.lang.System.gc()
    return True


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read again: lost executors don't bring its lineage back."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    release(spark)
    return spark.read.schema(df.schema).parquet(path)


def md5_long(*columns: Column | str) -> Column:
    """A 60-bit hash of the columns' text that other SQL engines can compute too."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *columns)), 1, 15), 16, 10).cast("bigint")


#: Rows of a small table that are broadcast; beyond it the join is salted.
BROADCAST_ROWS = 100_000
SALTS = 64


def join_small(big: DataFrame, small: DataFrame, keys: list[str], salt: Column, limit: int = BROADCAST_ROWS) -> DataFrame:
    """big left join small, where one key may hold a large share of big's rows: small (a written table) is broadcast if it
    has no more than `limit` rows, else it is repeated for each salt. `salt` hashes big's row to a number."""
    if small.count() <= limit:
        return big.join(F.broadcast(small), keys, "left")
    salted = small.withColumn("salt__", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    at = F.pmod(salt, F.lit(SALTS)).cast("int")
    return big.withColumn("salt__", at).join(salted, [*keys, "salt__"], "left").drop("salt__")


def free_name(name: str, df: DataFrame) -> str:
    """The name, with as many underscores behind it as it takes to clash with no column of df."""
    while name in df.columns:
        name += "_"
    return name


def null_key(column: Column) -> Column:
    """A text that holds null apart from every value."""
    return F.coalesce(F.concat(F.lit("="), column.cast("string")), F.lit(""))
