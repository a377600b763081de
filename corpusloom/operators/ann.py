"""Approximate vector search over cells of two levels, by cosine.

Coarse centres come from a bounded sample; within each coarse cell, fine centres come from a bounded sample of that cell. Every
row is placed in a fine cell and lies there in blocks of vectors; a cell of any size is many blocks, in as many tasks. Cells
grow with the rows: a fine cell has about the root of all rows (``CELL_ROWS`` at most), and there are as many coarse cells as
fine ones in each. A query finds its nearest coarse cells, among their fine cells its nearest ones, and meets the blocks
of these; a block of queries and a block of rows are one matrix product that leaves k rows a query.

How many fine cells are probed is measured once, when the index is built, on a sample of rows that are answered exactly; the
search itself looks at probed cells only.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.operators.retrieve import BLOCK_BYTES, block_product, dense_topk, top_k
from corpusloom.sources.tables import written

#: Rows of a fine cell, at most on average.
CELL_ROWS = 1024
#: Coarse cells, whose centres every task holds, and fine cells of one coarse cell, at most.
MOST_COARSE, MOST_FINE = 4096, 1024
#: Rows that the coarse centres are fitted on; rows for each fine centre; rows that are answered exactly to measure recall.
SAMPLE, SAMPLE_FINE, SAMPLE_RECALL = 50_000, 64, 500
#: Rows of a block of the index or of queries.
BLOCK_ROWS = 2048


@dataclass(frozen=True)
class Index:
    coarse: np.ndarray
    #: (coarse, centres): the fine centres of each coarse cell.
    fine: DataFrame
    #: (cell, ids, x): blocks of rows.
    blocks: DataFrame
    near: int
    probes: int


def _unit(x: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(size == 0, 1, size)


def _matrix(column: pa.Array) -> np.ndarray:
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return _unit(x.reshape(len(column), -1)) if len(column) else np.empty((0, 0))


def _nearest(x: np.ndarray, centres: np.ndarray, n: int) -> np.ndarray:
    """The n nearest centres of each row, nearest first."""
    d = (centres**2).sum(1) / 2 - x @ centres.T
    n = min(n, len(centres))
    some = np.argpartition(d, n - 1, axis=1)[:, :n]
    return np.take_along_axis(some, np.argsort(np.take_along_axis(d, some, 1), axis=1, kind="stable"), 1)


def _near_coarse(vector: Column, centres: np.ndarray, n: int) -> Column:
    @F.arrow_udf("array<int>")
    def nearest(v: pa.Array) -> pa.Array:
        return pa.array(list(_nearest(_matrix(v), centres, n).astype("int32")) if len(v) else [], pa.list_(pa.int32()))

    return nearest(vector)


def lloyd(x: np.ndarray, k: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Centres of k-means; a centre that loses all its rows stays where it was."""
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        at = _nearest(x, centres, 1)[:, 0]
        sums, n = np.zeros_like(centres), np.bincount(at, minlength=len(centres))
        np.add.at(sums, at, x)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


def _coarse_centres(rows: DataFrame, k: int) -> np.ndarray:
    some = rows.orderBy(F.xxhash64("id")).limit(SAMPLE)
    x = F.transform("v", lambda e: e.cast("double"))
    size = F.sqrt(F.aggregate("x", F.lit(0.0), lambda a, e: a + e * e))
    unit = some.select(x.alias("x")).select(F.transform("x", lambda e: e / F.when(size == 0, 1.0).otherwise(size)).alias("x"))
    return np.array(KMeans(k=k, seed=7, maxIter=20).fit(unit.select(array_to_vector("x").alias("features"))).clusterCenters())


def _fine_centres(rows: DataFrame, cell_rows: int) -> DataFrame:
    """(coarse, centres) from a bounded sample of each coarse cell of rows (id, v, coarse)."""
    wanted = F.least(F.greatest(F.ceil(F.col("rows") / cell_rows), F.lit(1)), F.lit(MOST_FINE)).cast("int")
    sizes = rows.groupBy("coarse").agg(F.count("*").alias("rows")).select("coarse", wanted.alias("k"))
    place = F.row_number().over(Window.partitionBy("coarse").orderBy(F.xxhash64("id"), "id"))
    some = rows.withColumn("place", place).filter(F.col("place") <= MOST_FINE * SAMPLE_FINE).join(F.broadcast(sizes), "coarse").filter(F.col("place") <= F.col("k") * SAMPLE_FINE)

    def fit(sample: pd.DataFrame) -> pd.DataFrame:
        x = _unit(np.array(sample["v"].tolist(), np.float64).reshape(len(sample), -1))
        return pd.DataFrame({"coarse": [sample["coarse"].iloc[0]], "centres": [lloyd(x, int(sample["k"].iloc[0])).tobytes()]})

    return written(some.select("coarse", "k", "v").groupBy("coarse").applyInPandas(fit, "coarse int, centres binary"), "fine-centres")


def _values(column: pa.Array) -> np.ndarray:
    """Unit vectors of a column of arrays, or of bytes that are unit vectors already."""
    if not pa.types.is_binary(column.type) and not pa.types.is_large_binary(column.type):
        return _matrix(column)
    parts = column.to_pylist()
    return np.frombuffer(b"".join(parts)).reshape(len(parts), -1) if parts else np.empty((0, 0))


def _packed(rows: DataFrame, key: str) -> DataFrame:
    """(key, ids, x): unit vectors of rows (key, id, v), which are sorted by key, in blocks of up to BLOCK_ROWS rows."""
    most = BLOCK_ROWS

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ids, xs, size = None, [], [], 0

        def block() -> pa.RecordBatch:
            columns = [pa.array([at], pa.int64()), pa.array([np.concatenate(ids).tobytes()]), pa.array([np.concatenate(xs).tobytes()])]
            return pa.record_batch(columns, [key, "ids", "x"])

        for batch in batches:
            k, i, x = batch.column(0).to_numpy(), batch.column(1).to_numpy(), _values(batch.column(2))
            edges = np.r_[0, np.flatnonzero(k[1:] != k[:-1]) + 1, len(k)] if len(k) else [0]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                while a < b:
                    if size and (k[a] != at or size == most):
                        yield block()
                        ids, xs, size = [], [], 0
                    c = min(b, a + most - size)
                    ids.append(i[a:c])
                    xs.append(x[a:c])
                    at, size, a = k[a], size + c - a, c
        if size:
            yield block()

    return rows.select(F.col(key).cast("bigint").alias(key), F.col("id").cast("bigint").alias("id"), "v").mapInArrow(pack, f"{key} bigint, ids binary, x binary")


def _light(df: DataFrame, column: str) -> DataFrame:
    """df with a broadcast hint if its blocks have no more than BLOCK_BYTES."""
    return F.broadcast(df) if (df.agg(F.sum(F.octet_length(column))).first()[0] or 0) <= BLOCK_BYTES else df


def _by_fine(fine: DataFrame, rows: DataFrame, of_row, schema: str) -> DataFrame:
    """`of_row` of each block of rows (coarse, id, v): it takes coarse, ids, x and the coarse cell's fine centres."""

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for coarse, ids, x, centres in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                ids, x = np.frombuffer(ids, np.int64), np.frombuffer(x)
                dim = len(x) // len(ids)
                yield of_row(coarse, ids, x.reshape(-1, dim), np.frombuffer(centres).reshape(-1, dim))

    packed = _packed(rows.hint("rebalance", "coarse").sortWithinPartitions("coarse"), "coarse")
    return packed.join(_light(fine, "centres"), "coarse").select("coarse", "ids", "x", "centres").mapInArrow(each, schema)


def _cell(coarse: int, fine: np.ndarray) -> np.ndarray:
    return (np.int64(coarse) << 32) + fine.astype(np.int64)


def _probing(coarse: np.ndarray, fine: DataFrame, queries: DataFrame, near: int, probes: int) -> DataFrame:
    """(id, cell, place): the nearest fine cells of queries (id, v)."""

    def nearest(at: int, ids: np.ndarray, x: np.ndarray, centres: np.ndarray) -> pa.RecordBatch:
        best = _nearest(x, centres, probes)
        d = np.take_along_axis((centres**2).sum(1) / 2 - x @ centres.T, best, 1)
        return pa.record_batch([np.repeat(ids, best.shape[1]), _cell(at, best.ravel()), d.ravel()], ["id", "cell", "d"])

    spread = queries.withColumn("coarse", F.explode(_near_coarse(F.col("v"), coarse, near)))
    return top_k(_by_fine(fine, spread, nearest, "id bigint, cell bigint, d double"), probes, -F.col("d"), "cell", "id", "place").select("id", "cell", "place")


def index(corpus: DataFrame, k: int = 10, recall: float = 0.95, tune_on: DataFrame | None = None) -> Index | None:
    """An index of corpus (chunk_id, embedding); None if it has no vectors. `probes` is the least number of fine cells with
    which a sample of `tune_on` (by default, of the corpus) finds this share of its k nearest other rows."""
    rows = corpus.filter("embedding is not null").select(F.col("chunk_id").cast("bigint").alias("id"), F.col("embedding").alias("v"))
    n = rows.count()
    if not n:
        return None
    cell_rows = min(CELL_ROWS, max(16, round(n**0.5)))
    coarse = _coarse_centres(rows, max(2, min(MOST_COARSE, round((n / cell_rows) ** 0.5))))
    placed = written(rows.withColumn("coarse", F.get(_near_coarse(F.col("v"), coarse, 1), F.lit(0))), "coarse-cells")
    fine = _fine_centres(placed, cell_rows)

    def place(at: int, ids: np.ndarray, x: np.ndarray, centres: np.ndarray) -> pa.RecordBatch:
        vectors = pa.array([row.tobytes() for row in x], pa.binary())
        return pa.record_batch([pa.array(_cell(at, _nearest(x, centres, 1)[:, 0])), pa.array(ids), vectors], ["cell", "id", "v"])

    cells = written(_by_fine(fine, placed, place, "cell bigint, id bigint, v binary"), "cells")
    blocks = written(_packed(cells.hint("rebalance", "cell").sortWithinPartitions("cell"), "cell"), "cell-blocks")

    # Rows that are no queries are answered exactly, once; of these the search that is built here is tuned.
    some = (tune_on or corpus).filter("embedding is not null").orderBy(F.xxhash64("chunk_id"), "chunk_id").limit(SAMPLE_RECALL)
    some = written(some.select(F.col("chunk_id").cast("bigint").alias("query_id"), "embedding"), "tuned-on")
    true = written(dense_topk(some, corpus, k, self_match=False).select("query_id", F.col("chunk_id").alias("id")).join(cells.select("id", "cell"), "id"), "nearest")
    near, most = min(len(coarse), max(8, round(len(coarse) ** 0.5))), min(cells.select("cell").distinct().count(), 4 * MOST_FINE)
    while True:
        order = _probing(coarse, fine, some.select(F.col("query_id").alias("id"), F.col("embedding").alias("v")), near, most)
        met = true.join(order.withColumnRenamed("id", "query_id"), ["query_id", "cell"], "left").groupBy("place").count().collect()
        wanted, probes = recall * sum(r["count"] for r in met), 0
        for place_, found in sorted((r.place, r["count"]) for r in met if r.place):
            if wanted <= 0:
                break
            probes, wanted = place_, wanted - found
        if wanted <= 0 or near == len(coarse):
            return Index(coarse, fine, blocks, near, max(1, probes if wanted <= 0 else most))
        near = min(len(coarse), 2 * near)


def search(found: Index, queries: DataFrame, k: int, self_match: bool = True) -> DataFrame:
    """(query_id, chunk_id, score, rank): the k best of the cells that each query (query_id, embedding) probes."""
    asked = queries.filter("embedding is not null").select(F.col("query_id").cast("bigint").alias("id"), F.col("embedding").alias("v"))
    probing = written(_probing(found.coarse, found.fine, asked, found.near, found.probes), "probing")
    spread = probing.select("id", "cell").join(asked, "id").repartition("cell").sortWithinPartitions("cell")
    q = _light(written(_packed(spread, "cell").select("cell", F.col("ids").alias("qi"), F.col("x").alias("qx")), "query-blocks"), "qx")
    dim = (F.octet_length("qx") / F.octet_length("qi")).cast("int")
    pairs = found.blocks.join(q, "cell").select("qi", "qx", dim.alias("qd"), F.col("ids").alias("ci"), F.col("x").alias("cx"), dim.alias("cd"))
    return top_k(pairs.mapInArrow(block_product(k, self_match), "query_id bigint, chunk_id bigint, score double"), k)


def dense_topk_ann(queries: DataFrame, corpus: DataFrame, k: int, self_match: bool = True, recall: float = 0.95, tune_on: DataFrame | None = None) -> DataFrame:
    """Builds an index and searches it."""
    found = index(corpus, k, recall, tune_on)
    if found is None:
        none = queries.limit(0).crossJoin(corpus.limit(0).select("chunk_id"))
        return none.select(F.col("query_id").cast("bigint"), F.col("chunk_id").cast("bigint"), F.lit(0.0).alias("score"), F.lit(0).alias("rank"))
    return search(found, queries, k, self_match)
