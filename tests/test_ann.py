"""Approximate search: recall on queries that it wasn't tuned on, whole placement, hot cells, odd tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import ann as A
from corpusloom.operators import retrieve as R

SCHEMA = "chunk_id long, embedding array<float>"


def frame(spark, x):
    return spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], SCHEMA).repartition(4)


def pairs(df):
    return {(r.query_id, r.chunk_id) for r in df.collect()}


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall_on_unseen_queries(spark, data, sf):
    every = spark.read.parquet(f"{data.replace('sf0.001', sf)}/embeddings.parquet").select(F.col("vec_id").alias("chunk_id"), "embedding")
    unseen, corpus = every.filter("chunk_id % 7 = 0"), every
    found = A.index(corpus, 10, tune_on=every.filter("chunk_id % 7 <> 0"))
    asked = unseen.select(F.col("chunk_id").alias("query_id"), "embedding")
    exact, near = pairs(R.dense_topk(asked, corpus, 10, self_match=False)), pairs(A.search(found, asked, 10, self_match=False))
    assert len(near) == len(exact) and len(exact & near) >= 0.9 * len(exact)


def test_clusters_and_a_hot_cell(spark, monkeypatch):
    monkeypatch.setattr(A, "BLOCK_ROWS", 50)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(30, 16))
    x = centres[rng.integers(30, size=3000)] + 0.2 * rng.normal(size=(3000, 16))
    x[:1000] = centres[0] + 1e-3 * rng.normal(size=(1000, 16))
    corpus, asked = frame(spark, x), frame(spark, x[::37] + 0.01).withColumnRenamed("chunk_id", "query_id")
    found = A.index(corpus, 5)
    placed = [np.frombuffer(r.ids, np.int64) for r in found.blocks.collect()]
    assert sorted(np.concatenate(placed)) == list(range(3000)) and max(map(len, placed)) <= A.BLOCK_ROWS
    assert found.probes < found.blocks.select("cell").distinct().count() / 2
    exact, near = R.dense_topk(asked, corpus, 5).collect(), A.search(found, asked, 5).collect()
    score = lambda rows: {(r.query_id, r["rank"]): r.score for r in rows}
    best, got = score(exact), score(near)
    assert best.keys() == got.keys() and np.mean([got[k] >= best[k] - 1e-6 for k in best]) >= 0.9


def test_cells_grow_with_rows(spark):
    rng = np.random.default_rng(4)
    cells = []
    for n in (200, 2000):
        found = A.index(frame(spark, rng.normal(size=(n, 8))), 3)
        cells.append(found.blocks.select("cell").distinct().count())
    assert cells[1] > 2 * cells[0]


def test_odd_tables(spark):
    d = frame(spark, np.ones((30, 4)))
    odd = d.unionByName(spark.createDataFrame([(99, None), (98, [0.0] * 4)], SCHEMA))
    got = A.dense_topk_ann(odd.withColumnRenamed("chunk_id", "query_id"), odd, 3, recall=1.0).collect()
    assert {r.query_id for r in got} == {*range(30), 98} and all(r["rank"] <= 3 for r in got)
    assert A.dense_topk_ann(d.withColumnRenamed("chunk_id", "query_id"), d.limit(0), 3).count() == 0
    assert A.dense_topk_ann(d.limit(0).withColumnRenamed("chunk_id", "query_id"), d, 3).count() == 0
