"""Deterministic inputs from ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanewise.functions.vectors import f32

# The sizes that the benchmark measures.
SIZES = (
    512, 1024, 2048, 4096, 8192, 12288, 16384, 20480, 24576, 28672, 32768, 40960, 49152, 57344, 65536, 81920, 98304, 114688, 131072, 163840, 196608, 229376, 262144, 327680,
    393216, 458752, 524288, 655360, 786432, 917504, 1048576, 1310720, 1572864, 1835008, 2097152, 2621440, 3145728, 3670016, 4194304,
)


def benchmark_input(spark: SparkSession, n: int) -> DataFrame:
    """(idx, a, b): a is half the index, b a quarter of it plus one, in single precision."""
    i = F.col("id").cast("float")
    return spark.range(n).select(F.col("id").alias("idx"), (i * f32(0.5)).alias("a"), (i * f32(0.25) + f32(1.0)).alias("b"))


def unit_input(spark: SparkSession, n: int = 16) -> DataFrame:
    """(idx, a, b): the index and the next one."""
    return spark.range(n).select(F.col("id").alias("idx"), F.col("id").cast("float").alias("a"), (F.col("id") + 1).cast("float").alias("b"))


def size_axis(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(n,) for n in SIZES], "array_size long")
