"""All registered queries with their SQL, from the modules of this folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusloom.plans import base, chunking, conversations, evidence, querylog, registry, retrieval, streams, telemetry, texts  # noqa: F401


def queries() -> dict[str, base.Query]:
    return dict(base.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(base.SQL)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base.QUERIES["hybrid_search"](spark, sf_dir)
