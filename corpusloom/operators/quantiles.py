"""Mergeable quantile sketches (KLL) kept by period: hours add up to days, days to months, without the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Values that a sketch keeps per level; the rank of a quantile is off by about 2.3 / ACCURACY ** 0.9 of all rows.
ACCURACY = 400
RANK_ERROR = 0.02
QUANTILES = (0.5, 0.95, 0.99)


def sketched(rows: DataFrame, keys: list[str], value: Column, period: Column | None = None, accuracy: int = ACCURACY) -> DataFrame:
    """keys, period, n and sketch of the values; null values don't count, and a group of nulls has no row. Partial sketches are
    merged after the shuffle, so a group of any size costs each task one sketch."""
    named = rows.select(*keys, value.cast("double").alias("value__"), (F.lit(None) if period is None else period).alias("period")).filter("value__ is not null")
    return named.groupBy(*keys, "period").agg(F.count("*").alias("n"), F.kll_sketch_agg_double("value__", accuracy).alias("sketch"))


def merged(sketches: DataFrame, keys: list[str], period: Column | None = None) -> DataFrame:
    """Sketches of longer periods, or of all time, from those of shorter ones."""
    coarse = sketches.withColumn("period", F.lit(None).cast("timestamp") if period is None else period)
    return coarse.groupBy(*keys, "period").agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch").alias("sketch"))


def quantiles(sketches: DataFrame, keys: list[str], of: tuple[float, ...] = QUANTILES) -> DataFrame:
    """keys, period, n and p50, p95, p99 (or others) from sketches."""
    values = [F.kll_sketch_get_quantile_double("sketch", F.lit(q)).alias(f"p{q * 100:g}") for q in of]
    return sketches.select(*keys, "period", "n", *values)
