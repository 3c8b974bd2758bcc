"""Result files: CSV with a fixed schema, read strictly and written in a fixed format."""

from __future__ import annotations

import csv
import re
import uuid
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lanewise.functions.names import result_file, result_label
from lanewise.sources.work import children, move, remove

COLUMNS = ("array_size", "median_ms", "mean_ms", "stddev_ms", "min_ms", "max_ms", "p99_ms", "gflops", "simd_level")


def read_results(spark: SparkSession, *inputs: str) -> DataFrame:
    """Rows of result files with label and input_pos.

    An input is a path, a glob, or PATH:LABEL cut at the first colon that no
    "//" follows. The files of a glob are inputs of their own, by name; each
    file's columns are bound by its own header's names in any order, others
    ignored. A missing file, a missing column, or a cell that is no number is
    an error. Every file speaks with one level, that of its first row. A
    repeated row stays repeated, and so does a file that is given twice.
    Headers alone come to the driver, one for each file.
    """
    given: list[tuple[str, str, str | None, int]] = []
    headers: dict[str, str] = {}
    for spec in inputs:
        path, label = _split(spec)
        head = F.regexp_extract("value", "^\ufeff?([^\r\n]*)", 1)
        texts = spark.read.text(path, wholetext=True)
        found = {r.file: r.head for r in texts.select(F.col("_metadata.file_path").alias("file"), head.alias("head")).collect()}
        if empty := {_plain(x) for x in texts.inputFiles()} - {_plain(x) for x in found}:  # files without a byte have no row
            raise ValueError(f"{', '.join(sorted(empty))}: no header")
        for file in sorted(found):
            headers[file] = found[file]
            given.append((file, unquote(file), label, len(given)))
    if not given:
        raise ValueError("no input")
    alike: dict[str, list[str]] = {}
    for file, head in headers.items():
        if lacking := [c for c in COLUMNS if c not in next(csv.reader([head]), [])]:
            raise ValueError(f"{file}: missing column {', '.join(lacking)}")
        alike.setdefault(head, []).append(file)
    rows = reduce(DataFrame.union, (_rows_of(spark, files) for files in alike.values()))
    first = rows.groupBy("file").agg(F.min_by("simd_level", "at").alias("simd_level"))
    # one row for each input file, as many as there are headers
    named = F.broadcast(spark.createDataFrame(given, "file string, name string, label string, input_pos int").join(first, "file"))
    out = rows.drop("simd_level", "at").join(named, "file")
    return out.select(*COLUMNS, F.coalesce("label", result_label("name")).alias("label"), "input_pos")


def _rows_of(spark: SparkSession, files: list[str]) -> DataFrame:
    """Typed rows of files with one header, the file and the place of each."""
    raw = spark.read.option("header", True).csv([unquote(x) for x in files])
    present = lambda c: F.when(F.col(c).isNull(), F.raise_error(F.lit(f"missing cell in column {c}")).cast("string")).otherwise(F.col(c))
    place = F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    return raw.select(present("array_size").cast("long").alias("array_size"), *(present(c).cast("double").alias(c) for c in COLUMNS[1:-1]), F.coalesce("simd_level", F.lit("")).alias("simd_level"), F.col("_metadata.file_path").alias("file"), place.alias("at"))


def _plain(uri: str) -> str:
    """A path without the slashes that its scheme may or may not have, and without escapes."""
    return unquote(re.sub(r"^(\w+):/+", r"\1:/", uri))


def _split(spec: str) -> tuple[str, str | None]:
    at = next((i for i, c in enumerate(spec) if c == ":" and spec[i + 1 : i + 3] != "//"), None)
    return (spec, None) if at is None else (spec[:at], spec[at + 1 :])


def as_text(df: DataFrame, *more: str) -> DataFrame:
    """The columns of a result file as strings, times with six decimals and throughput with four, after any further columns."""
    times = [_fixed(c, 6).alias(c) for c in COLUMNS[1:7]]
    return df.select(*more, F.col("array_size").cast("string").alias("array_size"), *times, _fixed("gflops", 4).alias("gflops"), "simd_level")


def _fixed(column: str, digits: int) -> Column:
    """With so many decimals; a half goes to the even digit."""
    return F.format_string(f"%.{digits}f", F.bround(column, digits))


def write_results(df: DataFrame, path: str) -> DataFrame:
    """Files with a header, one for each processor (column cpu, if there is one; else unknown) and level, named by them; their paths (path).

    Rows of a file are shuffled to one task, sorted by array_size: a file has
    as many rows as the size axis. Files of the same names are replaced, others
    in the folder stay.
    """
    spark = df.sparkSession
    name = result_file("cpu" if "cpu" in df.columns else F.lit(None).cast("string"), "simd_level")
    staged = f"{path.rstrip('/')}/_staged-{uuid.uuid4().hex}"
    named = df.withColumn("__file", name).withColumn("__n", F.col("array_size")).repartition("__file").sortWithinPartitions("__file", "__n")
    as_text(named, "__file").write.option("header", True).partitionBy("__file").csv(staged)
    made = []
    for folder in children(spark, staged):
        if "/__file=" in folder:
            (part,) = (x for x in children(spark, folder) if x.endswith(".csv"))
            made.append(f"{path.rstrip('/')}/{folder.rpartition('/__file=')[2]}")
            move(spark, part, made[-1])
    remove(spark, staged)
    return spark.createDataFrame([(x,) for x in made], "path string")


def cpu_model(spark: SparkSession, path: str) -> DataFrame:
    """model: what follows the colon of the first line that begins with "model name" in a hardware description; unknown_cpu without one."""
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("i"), "value").where(F.startswith("value", F.lit("model name")))
    first = lines.agg(F.min_by("value", "i").alias("v"))
    return first.select(F.coalesce(F.nullif(F.regexp_replace("v", r"^[^:]*:\s*", ""), F.lit("")), F.lit("unknown_cpu")).alias("model"))


def report(df: DataFrame) -> DataFrame:
    """line: a readable line for each result row."""
    times = (_fixed(c, 6) for c in ("median_ms", "mean_ms", "stddev_ms"))
    return df.select(F.format_string("%10d elements: %s ms (mean %s, sd %s), %s GFLOP/s, %s", "array_size", *times, _fixed("gflops", 4), "simd_level").alias("line"))
