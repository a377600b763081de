"""The registered queries against their SQL, and the pipeline against what each stage must do."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from corpusloom.llm import oracles, queries
from tests.compare import check
from tests.llm.test_operators import brute_components, brute_contamination

SQL = oracles.oracle_sql()


@pytest.mark.parametrize("name", list(queries.queries()))
def test_query(spark, data, name):
    assert check(spark, data, queries.queries()[name], SQL.get(name))


def test_pipeline(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    stage = dict(corpus_pipeline.STAGES)
    good = stage["quality classifier"](spark, docs, data)
    assert good.columns == docs.columns and 0.5 * docs.count() < good.count() < docs.count()
    rows = sorted((r.doc_id, r.text) for r in good.collect())
    kept = {rows[c][0] for _, c in brute_components([t for _, t in rows])}
    single = stage["n-gram Jaccard join"](spark, good, data)
    assert sorted(r.doc_id for r in single.collect()) == sorted(kept)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    texts = [(i, t) for i, t in rows if i in kept]
    clean = [i for (i, _), r in zip(texts, brute_contamination([t for _, t in texts], items), strict=True) if not r[1]]
    left = stage["benchmark decontamination"](spark, single, data)
    assert sorted(r.doc_id for r in left.collect()) == sorted(clean)
    mixed = stage["mixing to target weights"](spark, left, data)
    assert mixed.columns == docs.columns and mixed.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 2
    sharded = stage["sharding"](spark, mixed, data)
    assert sharded.count() == mixed.count() and {"slot", "shard"} <= set(sharded.columns)
    assert sharded.groupBy("doc_id").agg(F.count_distinct("shard").alias("n")).filter("n > 1").count() == 0


def test_pipeline_with_clashing_names(spark, data, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        d = spark.read.parquet(f"{data}/{name}.parquet")
        d = d.limit(60).withColumns({c: F.lit(7) for c in ("slot", "shard", "position", "contamination", "id__", "n", "size", "key")}) if name == "documents" else d
        d.write.parquet(f"file://{tmp_path}/{name}.parquet")
    got = corpus_pipeline.run(spark, f"file://{tmp_path}")
    assert {"slot_", "shard_"} <= set(got.columns) and {(r.slot, r.shard, r.position, r.size) for r in got.collect()} == {(7, 7, 7, 7)}


def test_pipeline_on_empty_documents(spark, data, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{data}/{name}.parquet").limit(0).write.parquet(f"file://{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}").count() == 0
