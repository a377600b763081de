"""Merged sketches against exact percentiles."""

import random

from pyspark.sql import functions as F

from corpusloom.operators import quantiles as K


def test_merged_sketches_stand_at_their_rank(spark):
    rng = random.Random(9)
    rows = [(e, h, rng.lognormvariate(3, 1.5)) for e in "ab" for h in range(24) for _ in range(500)] + [("a", 3, None), ("c", 0, None)]
    d = spark.createDataFrame(rows, "engine string, hour int, ms double").repartition(8)
    hours = K.sketched(d, ["engine"], F.col("ms"), F.timestamp_seconds(F.col("hour") * 3600))
    assert hours.count() == 48
    got = {r.engine: r for r in K.quantiles(K.merged(hours, ["engine"]), ["engine"]).collect()}
    assert got.keys() == {"a", "b"}
    for e, r in got.items():
        values = sorted(v for x, _, v in rows if x == e and v is not None)
        assert r.n == len(values)
        for q, estimate in ((0.5, r.p50), (0.95, r.p95), (0.99, r.p99)):
            rank = sum(v <= estimate for v in values) / len(values)
            assert abs(rank - q) <= K.RANK_ERROR
    one = K.quantiles(K.sketched(d.filter("hour = 0"), ["engine"], F.col("ms")), ["engine"], (0.25,))
    assert one.columns == ["engine", "period", "n", "p25"] and one.count() == 2
    assert K.quantiles(K.merged(hours.limit(0), ["engine"]), ["engine"]).count() == 0
