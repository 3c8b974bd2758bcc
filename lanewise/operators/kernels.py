"""The kernels over DataFrames: one element a row, one vector a row, and vectors of neighbouring keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanewise.functions.vectors import OPERATIONS, elementwise, row_op


def over_rows(df: DataFrame, name: str, a: str = "a", b: str = "b", out: str = "out") -> DataFrame:
    """One element of either vector in each row."""
    return df.withColumn(out, row_op(name, a, b))


def over_arrays(df: DataFrame, name: str, a: str = "a", b: str = "b", out: str = "out", n: int | None = None) -> DataFrame:
    return df.withColumn(out, elementwise(OPERATIONS[name], a, b, n))


def paired(left: DataFrame, right: DataFrame, on: list[str], name: str, a: str = "a", b: str = "b", out: str = "out") -> DataFrame:
    """Two tables of vectors, or of elements keyed by vector and position, paired by key: an equi-join and the kernel. Null keys pair with nothing."""
    joined = left.select(*on, F.col(a).alias("__a")).join(right.select(*on, F.col(b).alias("__b")), on)
    array = dict(left.dtypes)[a].startswith("array")
    value = elementwise(OPERATIONS[name], "__a", "__b") if array else row_op(name, "__a", "__b")
    return joined.select(*on, value.alias(out))


def neighbours(df: DataFrame, key: str, vector: str, name: str, n: int | None = None) -> DataFrame:
    """The kernel of each vector and that of the next whole-number key: (key, out), the last key has none."""
    here = df.select(F.col(key), F.col(vector).alias("__a"))
    there = df.select((F.col(key) - 1).alias(key), F.col(vector).alias("__b"))
    return here.join(there, key).select(key, elementwise(OPERATIONS[name], "__a", "__b", n).alias("out"))


def exploded(df: DataFrame, key: str, a: str = "a", b: str = "b") -> DataFrame:
    """(key, idx, a, b) of two arrays of each row, without a shuffle."""
    return df.select(key, F.posexplode(F.arrays_zip(F.col(a).alias("a"), F.col(b).alias("b"))).alias("idx", "p")).select(key, "idx", F.col("p.a").cast("float").alias("a"), F.col("p.b").cast("float").alias("b"))
