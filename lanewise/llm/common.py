"""Shared plumbing: the shared work folder, written intermediate tables, Arrow batches, ASCII words."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of an Arrow batch handed to Python; long texts make small batches.
BATCH_ROWS, BATCH_BYTES = 1024, 16 << 20

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_unset_folder: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, through Spark's own reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a temporary folder where that is unset and all tasks run in this machine, else an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _unset_folder:
        _unset_folder.append("file://" + tempfile.mkdtemp(prefix="lanewise-"))
    return _unset_folder[0]


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_folder(spark)}/lanewise/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """``df`` as a table in the shared folder: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_path = path
    return out


def drop(*frames: DataFrame) -> None:
    """Delete tables made by ``written`` that nothing reads any more."""
    for df in frames:
        if path := getattr(df, "_written_path", None):
            jvm = df.sparkSession._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


#: Keys that spread_join takes for hot, at most, and parts over which it spreads the rows of each.
HOT_KEYS, HOT_PARTS = 4096, 64


def spread_join(big: DataFrame, small: DataFrame, key: str, count: str, total: int, by: str, how: str = "inner") -> DataFrame:
    """Inner or left join of big with small, which has one row for each key and in column ``count`` the key's rows in big.

    ``total`` is the number of big's rows, so that at most HOT_KEYS keys have
    more than one in HOT_KEYS of them. Only these keys are broadcast, to part
    their rows HOT_PARTS ways by column ``by``; their rows of small are
    repeated for each part. Rows with a null key join with nothing.
    """
    hot = F.col(count) * HOT_KEYS > max(total, HOT_KEYS)
    keys = F.broadcast(small.where(hot).select(F.col(key).alias("__key"), F.lit(True).alias("__hot")))
    part = F.when(F.col("__hot"), F.pmod(F.xxhash64(by), F.lit(HOT_PARTS))).otherwise(F.lit(0)).cast("int")
    left = big.join(keys, F.col(key) == F.col("__key"), "left").withColumn("__part", part).drop("__key", "__hot")
    parts = F.when(hot, F.sequence(F.lit(0), F.lit(HOT_PARTS - 1))).otherwise(F.array(F.lit(0)))
    return left.join(small.withColumn("__part", F.explode(parts)), [key, "__part"], how).drop("__part")


#: Bits of a filter that goes to the executors, whatever the number of keys: 8 MB.
FILTER_BITS = 1 << 26


def slot(*columns: str) -> Column:
    """The bit of a filter that stands for these columns' values."""
    return F.pmod(F.xxhash64(*columns), F.lit(FILTER_BITS))


def bit_filter(slots: DataFrame) -> Broadcast:
    """A broadcast filter of slots(s): bits at ``slot`` of all keys. It lets through every key and, by accident, some others."""
    words = slots.groupBy((F.col("s") / 64).cast("int").alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(s % 64 as int)))").alias("b")).toPandas()
    bits = np.zeros(FILTER_BITS // 64, np.uint64)
    bits[words["w"].to_numpy(np.int64)] = words["b"].to_numpy(np.int64).view(np.uint64)
    return slots.sparkSession.sparkContext.broadcast(bits)


def held(bits: np.ndarray, slots: pa.Array) -> np.ndarray:
    """Which slots a filter's bits hold; a null slot is in none."""
    s = pc.fill_null(slots, 0).to_numpy(zero_copy_only=False).astype(np.uint64)
    found = (bits[(s >> np.uint64(6)).astype(np.int64)] >> (s & np.uint64(63)) & np.uint64(1)).astype(bool)
    return found & pc.is_valid(slots).to_numpy(zero_copy_only=False)


def may_hold(sent: Broadcast, slots: Column) -> Column:
    """``held`` as a column."""

    @F.arrow_udf("boolean")
    def of(s: pa.Array) -> pa.Array:
        return pa.array(held(sent.value, s))

    return of(slots)


def small_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by rows and bytes, so that very long texts don't fill a Python worker.

    The bounds are settings of the session and stay: a plan reads them when it is run, after the operator has returned.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def utf8(name: str = "text") -> Column:
    """The column's UTF-8 bytes, null as empty: spares Python a decoding where bytes do."""
    return F.encode(text_or_empty(name), "UTF-8")
