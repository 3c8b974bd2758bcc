"""A shared folder for tables and files that a query writes and reads back."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

_unset_folder: list[str] = []


def new_folder(spark: SparkSession, tag: str) -> str:
    """A fresh path under ``spark.checkpoint.dir``; under a temporary folder where that is unset and all tasks run in this machine, else an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _unset_folder:
            _unset_folder.append("file://" + tempfile.mkdtemp(prefix="lanewise-"))
        found = _unset_folder[0]
    return f"{found.rstrip('/')}/lanewise/{tag}-{uuid.uuid4().hex}"


def _store(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def put_text(spark: SparkSession, path: str, text: str) -> str:
    """A small file, written by the driver through Spark's own file systems; returns its path."""
    store, where = _store(spark, path)
    out = store.create(where, True)
    out.write(bytearray(text.encode()))
    out.close()
    return path


def move(spark: SparkSession, path: str, to: str) -> None:
    store, where = _store(spark, path)
    target = _store(spark, to)[1]
    store.delete(target, False)
    if not store.rename(where, target):
        raise OSError(f"{path} could not be moved to {to}")


def children(spark: SparkSession, path: str) -> list[str]:
    """Paths of the files and folders in a folder, by name."""
    store, where = _store(spark, path)
    return sorted(x.getPath().toString() for x in store.listStatus(where))


def remove(spark: SparkSession, path: str) -> None:
    store, where = _store(spark, path)
    store.delete(where, True)
