"""Sharding by a permutation-filled lookup table.

Each shard has its own order of preference over the slots of a table of prime size (an offset and a step from the hash of
its name). The shards take turns; in its turn a shard claims the first slot of its order that is still free. A row's key
hashes to a slot, and a broadcast join with the table (bounded by its size) gives the shard. When a shard joins or
leaves, few of the other slots change hands.

Defined cases: a null key hashes like an empty text, and keys of several columns are told apart by the column that is null;
repeated rows land on the same shard; an empty table stays empty; texts aren't read; where columns named ``slot`` or
``shard`` exist, they stay, and the new ones get an underscore behind their names. More than ``MAX_SLOTS`` slots (20,000
shards) raise ValueError, as the table is a literal of the plan.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import free_name, md5_long

#: Slots to a shard at least; shares of the shards then differ by about a hundredth.
SLOTS_PER_SHARD = 100
#: The largest lookup table that is built and broadcast.
MAX_SLOTS = 2_000_003


def next_prime(n: int) -> int:
    while n < 2 or any(n % k == 0 for k in range(2, int(n**0.5) + 1)):
        n += 1
    return n


def table_size(shards: int, per_shard: int = SLOTS_PER_SHARD) -> int:
    size = next_prime(max(2, shards * per_shard))
    if size > MAX_SLOTS:
        raise ValueError(f"{shards} shards need {size} slots; at most {MAX_SLOTS} are broadcast")
    return size


def lookup_table(names: list[str], size: int) -> list[int]:
    """Slot -> index of its shard."""
    if not names or len(set(names)) < len(names):
        raise ValueError("shards need distinct names")
    state = []
    for name in names:
        h = hashlib.md5(name.encode()).digest()
        state.append([int.from_bytes(h[:8], "big") % size, int.from_bytes(h[8:], "big") % (size - 1) + 1])
    slots, free = [-1] * size, size
    while free:
        for shard, turn in enumerate(state):
            while slots[turn[0]] >= 0:
                turn[0] = (turn[0] + turn[1]) % size
            slots[turn[0]] = shard
            free -= 1
            if not free:
                break
    return slots


def slot_of(size: int, *keys: Column | str) -> Column:
    return F.pmod(md5_long(*[F.coalesce(F.col(k) if isinstance(k, str) else k, F.lit("")) for k in keys]), F.lit(size))


def assign(
    df: DataFrame,
    names: list[str],
    keys: list[str],
    slot: str = "slot",
    shard: str = "shard",
    per_shard: int = SLOTS_PER_SHARD,
) -> DataFrame:
    """df with the columns `slot` and `shard` (the shard's name). No shuffle."""
    slot, shard = free_name(slot, df), free_name(shard, df)
    size = table_size(len(names), per_shard)
    owners = F.from_json(F.lit(json.dumps(lookup_table(names, size))), "array<int>")
    named = F.from_json(F.lit(json.dumps(names)), "array<string>")
    spread = df.sparkSession.range(1).select(F.posexplode(owners).alias("slot__", "owner__"))
    spread = spread.select(F.col("slot__").cast("bigint").alias("slot__"), F.get(named, F.col("owner__")).alias(shard))
    spread = spread.withColumnRenamed("slot__", slot)
    placed = df.withColumn(slot, slot_of(size, *[F.col(k).cast("string") for k in keys]))
    return placed.join(F.broadcast(spread), slot).select(*[f"`{c}`" for c in df.columns], slot, shard)


def write_shards(df: DataFrame, path: str, shard: str = "shard", files_per_shard: int = 1, key: str = "doc_id") -> None:
    """One folder for each shard; a shard's rows are dealt over files_per_shard tasks."""
    part = F.pmod(md5_long(F.col(key).cast("string"), F.lit("file")), F.lit(files_per_shard))
    df.withColumn("file__", part).repartition(F.col(shard), F.col("file__")).drop("file__").write.partitionBy(shard).parquet(path)
