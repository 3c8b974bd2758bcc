"""Exact statistics of repeated timings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanewise.functions.benchmark import gflops, gflops_published


def median(x: str) -> Column:
    """Exact; the mean of the middle two of an even number."""
    return F.percentile(x, F.lit(0.5))


def percentile(x: str, p: float) -> Column:
    """Exact, interpolated linearly at p * (n - 1)."""
    return F.percentile(x, F.lit(p))


def statistics(x: str) -> list[Column]:
    """median, mean, population deviation, min, max and 99th percentile, named as the columns of result files."""
    return [median(x).alias("median_ms"), F.avg(x).alias("mean_ms"), F.stddev_pop(x).alias("stddev_ms"), F.min(x).alias("min_ms"), F.max(x).alias("max_ms"), percentile(x, 0.99).alias("p99_ms")]


def trial_statistics(trials: DataFrame, by: list[str], value: str = "time_ms") -> DataFrame:
    """One row for each group: a single shuffle of partial states (percentiles hold counts of distinct values). Null values are left out."""
    return trials.groupBy(*by).agg(*statistics(value))


def result_rows(trials: DataFrame) -> DataFrame:
    """Rows of a result file from trials(array_size, simd_level, trial, time_ms), with both kinds of throughput."""
    out = trial_statistics(trials, ["array_size", "simd_level"])
    return out.select("array_size", "median_ms", "mean_ms", "stddev_ms", "min_ms", "max_ms", "p99_ms", gflops_published("array_size", "median_ms").alias("gflops"), "simd_level", gflops("array_size", "median_ms").alias("gflops_true"))
