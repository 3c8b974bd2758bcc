"""Checks of computed vectors against expected ones. NaN never counts as right, on either side."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanewise.functions.vectors import row_op


def _wrong(name: str, exact: bool, tolerance: float):
    out, want = F.col("out").cast("float"), row_op(name, "a", "b")
    if exact:
        return F.coalesce(F.isnan(out) | F.isnan(want) | (out != want), F.lit(True))
    return F.coalesce(F.isnan(out) | F.isnan(want) | (F.abs(out - want) > F.lit(tolerance).cast("float")), F.lit(True))


def exact_mismatches(df: DataFrame, name: str, first: int = 16) -> DataFrame:
    """Rows of df(idx, a, b, out) among the first so many indices whose out isn't exactly the kernel's; a null is a mismatch."""
    return df.where((F.col("idx") < first) & _wrong(name, True, 0))


def tolerance_failures(df: DataFrame, name: str, tolerance: float = 1e-6) -> DataFrame:
    """failures: how many rows of df(a, b, out) miss the kernel by more than the tolerance; a NaN or null is a failure."""
    return df.agg(F.count_if(_wrong(name, False, tolerance)).alias("failures"))


def agreement(observations: DataFrame, value: str = "level") -> DataFrame:
    """observations, levels, agreed: whether all rows hold one and the same value, null being a value of its own. An empty table agrees."""
    distinct = F.count_distinct(value) + F.max(F.when(F.col(value).isNull(), 1).otherwise(0))
    out = observations.agg(F.count(F.lit(1)).alias("observations"), F.coalesce(distinct, F.lit(0)).alias("levels"))
    return out.withColumn("agreed", F.col("levels") <= 1)


def missing(expected: DataFrame, found: DataFrame, on: str) -> DataFrame:
    """Rows of expected without a partner in found."""
    return expected.join(found.select(on), on, "left_anti")
