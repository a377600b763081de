"""Mixing sources to target weights, in DataFrame functions only.

Targets: the mix takes ``share`` (1.5) times the words of the corpus. Sources in code point order (null last) have the
weights 3, 1, 2, repeating; a target stops at ``most`` (2) times its source's words and the excess goes to the others by
weight. Each source is cut into blocks by a keyed hash of its documents' ids. As many whole passes over a source are taken
as its target allows, and of one more pass the documents that come first in hash order, as long as their words fit, and the
next one if that ends nearer to the target: the place where they end is found by descending through ever finer hash bins,
so no group of rows has to be sorted.

A draw is a block of one pass, and a source's draws are its quota. A splitting tree deals the quotas to the output shards,
by counts only: a node's left half of draws is taken from an urn with the quotas of all sources, so each source's share of
it is a draw from the multivariate hypergeometric distribution, and the quotas of both halves add up exactly. Then the
source's draws, in a keyed permutation of their own, go to the shards in runs as long as its quotas there, so they are
disjoint. Within a shard, rows stand in the order of another keyed hash (position).

Defined cases: a null or empty text has size 0, and its document goes with every whole pass; texts are counted whole,
however long; repeated rows of an id share one hash and are taken or left together; a null source is a source; ties in the
hash share one fate; an empty table gives no rows. Reruns give the same result. Only the named columns are read; where
`documents` has columns that repeated() adds, its own stay and the new ones go by another name (a parameter).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.llm.common import join_small, null_key, written

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
SEED = "mix-1"
#: log2 of the blocks of a source, and of the bins of each further step of the descent.
BITS = (6, 9, 9, 8)
#: log2 of the output shards.
LEVELS = 3
HASH_BITS = sum(BITS)


def keyed(seed: str, *columns: Column) -> Column:
    """A hash of HASH_BITS bits."""
    text = F.concat_ws("|", F.lit(seed), *[F.coalesce(c.cast("string"), F.lit("")) for c in columns])
    return F.conv(F.substring(F.md5(text), 1, HASH_BITS // 4), 16, 10).cast("bigint")


def n_words(text: Column) -> Column:
    flat = F.translate(F.coalesce(text.cast("string"), F.lit("")), "\t\n\x0b\f\r", " " * 5)
    return F.size(F.array_remove(F.split(flat, " "), "")).cast("bigint")


def targets(measured: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """source_key, source_size, target: one row for each source."""
    sums = measured.groupBy("source_key").agg(F.first("source__").alias("source__"), F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source__").asc_nulls_last()))
    weight = F.get(F.array(*[F.lit(w) for w in weights]), ((rank - 1) % len(weights)).cast("int"))
    ranked = sums.withColumn("weight", weight).withColumn("ratio", F.col("source_size") * most / F.col("weight"))
    whole, before = Window.partitionBy(), Window.orderBy("ratio", "source_key").rowsBetween(Window.unboundedPreceding, -1)
    level = (F.sum("source_size").over(whole) * share - F.coalesce(F.sum("source_size").over(before), F.lit(0)) * most) / (
        F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    )
    # Sources stop at their bound in the order of bound to weight; the first that doesn't gives the level of all others.
    water = ranked.withColumn("level", level)
    free = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "source_key", "level"))).over(whole)["level"]
    target = F.least(F.col("source_size") * F.lit(float(most)), F.col("weight") * free)
    return water.select("source_key", "source_size", F.coalesce(target, F.lit(0.0)).alias("target"))


def passes(sources: DataFrame) -> DataFrame:
    """With `full` (whole passes) and `need` (words of one more)."""
    full = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(1).cast("int")
    return sources.withColumn("full", full).withColumn("need", F.col("target") - F.col("full") * F.col("source_size"))


def cut(measured: DataFrame, sources: DataFrame) -> DataFrame:
    """sources with `cut`: documents whose hash is below it are taken once more."""
    state = sources.withColumn("cut", F.lit(0).cast("bigint")).withColumn("left", F.col("need")).withColumn("open", F.lit(True))
    done = 0
    for bits in BITS:
        done += bits
        shift = HASH_BITS - done
        inside = join_small(measured, state, ["source_key"], F.col("hash"))
        inside = inside.filter(F.col("open") & (F.shiftright("hash", shift + bits) == F.shiftright("cut", shift + bits)))
        bins = inside.groupBy("source_key", F.shiftright("hash", shift).alias("bin")).agg(F.sum("size").alias("words"))
        # A source has 2 ** bits bins at most.
        by = Window.partitionBy("source_key").orderBy("bin")
        bins = bins.withColumn("upto", F.sum("words").over(by)).join(state, "source_key")
        over = F.min(F.when(F.col("upto") > F.col("left"), F.struct("bin", (F.col("upto") - F.col("words")).alias("before"), "words")))
        ends = bins.groupBy("source_key").agg(over.alias("end"))
        # Where every bin fits, the whole parent is taken and the descent ends.
        beyond = F.shiftleft(F.shiftright("cut", shift + bits) + 1, shift + bits)
        rest = F.col("left") - F.col("end.before")
        nearer = (F.col("end.words") < 2 * rest).cast("int") if shift == 0 else F.lit(0)
        state = (
            state.join(ends, "source_key", "left")
            .withColumn("stays", F.col("open") & F.col("end").isNotNull())
            .withColumn("cut", F.when(F.col("stays"), F.shiftleft("end.bin", shift) + nearer).when(F.col("open"), beyond).otherwise(F.col("cut")))
            .withColumn("left", F.when(F.col("stays"), rest).otherwise(F.col("left")))
            .withColumn("open", F.col("stays"))
            .drop("end", "stays")
        )
        state = written(state, "cut")
    return state.drop("left", "open")


def splitting_tree(quotas: DataFrame, levels: int = LEVELS, seed: str = SEED) -> DataFrame:
    """quotas (source_key, quota) -> (source_key, shard, quota): each quota dealt to 2 ** levels shards. Counts only: a row
    of a node holds one number for each source, and its urn is emptied draw by draw."""
    out = quotas.select(F.lit(0).alias("shard"), "source_key", F.col("quota").cast("bigint").alias("quota"))
    for level in range(levels):
        nodes = out.filter("quota > 0").groupBy("shard").agg(
            F.sort_array(F.collect_list(F.struct("source_key", "quota"))).alias("q"), F.sum("quota").alias("n")
        )

        def drawn(level=level):
            def one(state: Column, source: Column) -> Column:
                goes = lambda b, j: F.pmod(keyed(f"{seed}|{level}", F.col("shard"), source["source_key"], j), b["n"]) < b["l"]
                urn = F.aggregate(
                    F.sequence(F.lit(1).cast("bigint"), source["quota"]),
                    F.struct(state["n"].alias("n"), state["l"].alias("l")),
                    lambda b, j: F.struct((b["n"] - 1).alias("n"), (b["l"] - goes(b, j).cast("bigint")).alias("l")),
                )
                taken = F.concat(state["out"], F.array(F.struct(source["source_key"].alias("source_key"), source["quota"].alias("quota"), (state["l"] - urn["l"]).alias("left"))))
                return F.struct(urn["n"].alias("n"), urn["l"].alias("l"), taken.alias("out"))

            none = F.array().cast("array<struct<source_key:string,quota:bigint,left:bigint>>")
            start = F.struct(F.col("n").alias("n"), F.ceil(F.col("n") / 2).cast("bigint").alias("l"), none.alias("out"))
            return F.aggregate("q", start, one, lambda state: state["out"])

        split = written(nodes.select("shard", F.explode(drawn()).alias("s")), "quotas")
        halves = F.array(F.struct(F.lit(0).alias("side"), F.col("s.left").alias("quota")), F.struct(F.lit(1).alias("side"), (F.col("s.quota") - F.col("s.left")).alias("quota")))
        out = split.select("shard", "s.source_key", F.explode(halves).alias("h")).select((F.col("shard") * 2 + F.col("h.side")).alias("shard"), "source_key", "h.quota")
    return out.filter("quota > 0").select("source_key", "shard", "quota")


def dealt(draws: DataFrame, levels: int = LEVELS, seed: str = SEED) -> DataFrame:
    """draws (source_key, block, copy) with `shard`: a source's draws in keyed order, in runs of its quotas."""
    quotas = draws.groupBy("source_key").agg(F.count("*").alias("quota"))
    shares = splitting_tree(quotas, levels, seed)
    # As many rows a source as there are shards, and as it has draws.
    upto = F.sum("quota").over(Window.partitionBy("source_key").orderBy("shard"))
    ends = shares.withColumn("upto", upto).groupBy("source_key").agg(F.sort_array(F.collect_list(F.struct("upto", "shard"))).alias("ends"))
    order = keyed(f"{seed}|blocks", F.col("source_key"), F.col("block"), F.col("copy"))
    place = F.row_number().over(Window.partitionBy("source_key").orderBy(order, "block", "copy"))
    placed = draws.withColumn("place", place).join(ends, "source_key")
    return placed.select("source_key", "block", "copy", F.get(F.filter("ends", lambda e: e["upto"] >= F.col("place")), F.lit(0))["shard"].alias("shard"))


def mix(
    documents: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple = WEIGHTS,
    share: float = SHARE,
    most: int = MOST,
    seed: str = SEED,
    levels: int = LEVELS,
) -> DataFrame:
    """Per row: the id, source_key, size, source_size, target, copies, taken (words), and of each copy its shard and its
    position there (shard_1, position_1, …)."""
    source = null_key(F.col(source_col))
    measured = written(
        documents.select(
            F.col(id_col),
            F.col(source_col).alias("source__"),
            source.alias("source_key"),
            n_words(F.col(text_col)).alias("size"),
            keyed(seed, source, F.col(id_col)).alias("hash"),
        ),
        "sizes",
    )
    sources = written(cut(measured, written(passes(targets(measured, weights, share, most)), "targets")), "sources")
    placed = join_small(measured, sources, ["source_key"], F.col("hash"))
    copies = F.col("full") + (F.col("hash") < F.col("cut")).cast("int")
    placed = placed.withColumns({"block": F.shiftright("hash", HASH_BITS - BITS[0]), "copies": copies})
    drawn = placed.groupBy("source_key", "block").agg(F.max("copies").alias("copies"))
    draws = drawn.select("source_key", "block", F.explode(F.sequence(F.lit(0), "copies")).alias("copy")).filter("copy > 0")
    shards = dealt(written(draws, "draws"), levels, seed).groupBy("source_key", "block").agg(
        *[F.max(F.when(F.col("copy") == c, F.col("shard"))).alias(f"shard_{c}") for c in range(1, most + 1)]
    )
    rows = placed.join(shards, ["source_key", "block"], "left")
    return rows.select(
        id_col,
        "source_key",
        "size",
        "source_size",
        "target",
        "copies",
        (F.col("copies") * F.col("size")).alias("taken"),
        *[F.when(F.col("copies") >= c, F.col(f"shard_{c}")).alias(f"shard_{c}") for c in range(1, most + 1)],
        *[F.when(F.col("copies") >= c, keyed(f"{seed}|local", F.col(id_col), F.lit(c))).alias(f"position_{c}") for c in range(1, most + 1)],
    )


def repeated(documents: DataFrame, most: int = MOST, seed: str = SEED, id_col: str = "doc_id", shard: str = "shard", position: str = "position", **options) -> DataFrame:
    """The rows of the mix: a document's row once for each copy, with its shard and its keyed position there. Where
    `documents` has columns of these names, pass others; its own aren't touched (of two columns of one name both stay)."""
    copies = mix(documents, id_col=id_col, most=most, seed=seed, **options)
    each = F.array(*[F.struct(F.col(f"shard_{c}").alias("s"), F.col(f"position_{c}").alias("p")) for c in range(1, most + 1)])
    # Rows that repeat an id share its copies.
    plan = copies.select(F.col(id_col).alias("id"), F.filter(each, lambda x: x["s"].isNotNull()).alias("copies")).dropDuplicates(["id"])
    rows = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row"), F.col(id_col).alias("own"))
    joined = rows.join(plan, rows["own"].eqNullSafe(plan["id"])).select("row", F.explode("copies").alias("copy"))
    return joined.select("row.*", F.col("copy.s").alias(shard), F.col("copy.p").alias(position))


def write_mix(rows: DataFrame, path: str, parts: int = 16) -> None:
    """Output shards of repeated(): a shard's rows are dealt by ranges of their position and sorted within."""
    part = F.shiftright(F.col("position"), HASH_BITS - 16) % parts
    at = rows.withColumn("part__", part)
    at.repartition("shard", "part__").drop("part__").sortWithinPartitions("shard", "position").write.partitionBy("shard").parquet(path)
