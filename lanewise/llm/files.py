"""Files in the shared folder, written by tasks and read back by Spark."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from typing import BinaryIO

from pyspark.sql import DataFrame, SparkSession


def put(uri: str, data: bytes) -> None:
    """Write a whole file under another name and move it in place, so that attempts at one task don't meet."""
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    folder, _, name = path.rpartition("/")
    store.create_dir(folder, recursive=True)
    part = f"{folder}/_{name}-{uuid.uuid4().hex}"
    with store.open_output_stream(part) as out:
        out.write(data)
    store.move(part, path)


@contextmanager
def opened(uri: str) -> Iterator[BinaryIO]:
    """A file of the shared folder, read from its beginning as a stream."""
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    with store.open_input_stream(path, compression=None) as source:
        yield source


def contents(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """path, content of the files of a folder; names that begin with _ are attempts that never ended."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path", "content")
