"""Capability registers as a table: read from files, or derived from a hardware description."""

from __future__ import annotations

import threading

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lanewise.functions.levels import BITS, YMM_MASK, ZMM_MASK, detected_level

REGISTERS = ("max_leaf", "l1_ecx", "l1_edx", "l7_ebx", "xcr0")
# Names of the features in a hardware description.
FLAGS = {"sse2": "sse2", "sse42": "sse4_2", "osxsave": "xsave", "avx": "avx", "avx2": "avx2", "avx512f": "avx512f"}


def read_snapshots(df: DataFrame) -> DataFrame:
    """snap_id and the registers as LONG from a table of snapshots; an error for a missing column or a negative register. Other columns are left out."""
    if lacking := [c for c in ("snap_id", *REGISTERS) if c not in df.columns]:
        raise ValueError(f"missing column {', '.join(lacking)}")
    unsigned = lambda c: F.when(F.col(c).cast("long") < 0, F.raise_error(F.lit(f"{c} is negative")).cast("long")).otherwise(F.col(c).cast("long"))
    return df.select(F.col("snap_id").cast("long").alias("snap_id"), *(unsigned(c).alias(c) for c in REGISTERS))


def registers_of(flags: Column) -> list[Column]:
    """The registers of a description's feature names, an array; state bits follow from the names, which a kernel shows only where it keeps the state."""
    has = {f: F.array_contains(flags, name) for f, name in FLAGS.items()}
    register = lambda r: sum((F.when(has[f], F.lit(1 << bit)).otherwise(F.lit(0)) for f, (of, bit) in BITS.items() if of == r), F.lit(0))
    state = F.when(has["avx"], F.lit(YMM_MASK)).otherwise(F.lit(0)) + F.when(has["avx512f"], F.lit(ZMM_MASK)).otherwise(F.lit(0))
    return [F.lit(7).cast("long").alias("max_leaf"), *(register(r).cast("long").alias(r) for r in REGISTERS[1:-1]), state.cast("long").alias("xcr0")]


def described(lines: DataFrame) -> DataFrame:
    """The registers of the machine whose description is lines(value): one row, by the first line of flags; all bits 0 without one."""
    words = F.split(F.regexp_replace("value", r"^flags\s*:\s*", ""), r"\s+")
    first = lines.where(F.col("value").rlike(r"^flags\s*:")).select(F.monotonically_increasing_id().alias("i"), words.alias("w")).agg(F.min_by("w", "i").alias("w"))
    return first.select(*registers_of(F.coalesce("w", F.array().cast("array<string>"))))


_levels: dict[str, int] = {}
_lock = threading.Lock()


def detected(spark: SparkSession, path: str = "/proc/cpuinfo") -> int:
    """The level of the machine that the driver runs on, detected once for each path, however many threads ask; 0 where nothing describes it."""
    if path not in _levels:
        with _lock:
            if path not in _levels:
                try:
                    with open(path, encoding="utf-8", errors="replace") as file:
                        lines = [(x.rstrip("\n"),) for x in file]
                except OSError:
                    lines = []
                _levels[path] = described(spark.createDataFrame(lines, "value string")).select(detected_level().alias("level")).first().level
    return _levels[path]
