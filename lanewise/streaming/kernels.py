"""The kernels are stateless column expressions, so a streaming DataFrame takes them unchanged."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from lanewise.operators.kernels import over_arrays, over_rows


def read_vectors(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """New parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).parquet(folder)


def applied(stream: DataFrame, name: str, a: str = "a", b: str = "b", out: str = "out") -> DataFrame:
    array = dict(stream.dtypes)[a].startswith("array")
    return (over_arrays if array else over_rows)(stream, name, a, b, out)


def write_vectors(stream: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Everything that is there now, appended as parquet; the checkpoint makes a second run go on from the first."""
    return stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(folder)
