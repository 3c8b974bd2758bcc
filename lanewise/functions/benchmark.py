"""Arithmetic of benchmark rows: repetitions by size, throughput, error bands."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Sizes below each bound are repeated so often; larger ones REPEATS_ELSE times.
REPEATS, REPEATS_ELSE = ((100_000, 5000), (2_000_000, 2000), (5_000_000, 1000)), 500


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def iterations(size: Column | str) -> Column:
    out = F.when(_c(size) < REPEATS[0][0], REPEATS[0][1])
    for bound, n in REPEATS[1:]:
        out = out.when(_c(size) < bound, n)
    return out.otherwise(REPEATS_ELSE)


def gflops_published(size: Column | str, median_ms: Column | str) -> Column:
    """Throughput as published: the time of one call stands for that of all repetitions, so that it is too large by their number."""
    return iterations(size) * _c(size) / (_c(median_ms) / F.lit(1000.0)) / F.lit(1e9)


def gflops(size: Column | str, median_ms: Column | str) -> Column:
    """Element operations in a nanosecond."""
    return _c(size) / (_c(median_ms) * F.lit(1e6))


def gflops_error(min_ms: Column | str, max_ms: Column | str) -> Column:
    """The half-height of an error bar that charts of throughput use: a quarter of the range of times, unit and all."""
    return (_c(max_ms) - _c(min_ms)) / F.lit(4.0)


def band(y: Column | str, error: Column | str) -> tuple[Column, Column]:
    return _c(y) - _c(error), _c(y) + _c(error)


def second_axis(y: Column | str) -> Column:
    """The secondary axis shows the primary one times 1000."""
    return _c(y) * F.lit(1000.0)
