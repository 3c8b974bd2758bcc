"""Result sets: last-wins merging, ranking and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def last_wins(df: DataFrame, label: str = "label", position: str = "input_pos") -> DataFrame:
    """Of rows that share a label those of the latest input; rows with a null label count as sharing one. Without a window over whole groups."""
    last = df.groupBy(label).agg(F.max(position).alias("__last"))
    same = df[label].eqNullSafe(last[label])
    return df.join(last, same & (df[position] == last["__last"]), "left_semi")


def last_row(df: DataFrame, by: str, order: str, *values: str) -> DataFrame:
    """The values of each group's row of the largest order, as one aggregate."""
    got = df.groupBy(by).agg(F.max(F.struct(order, *values)).alias("__r"))
    return got.select(by, *(F.col(f"__r.{v}").alias(v) for v in values))


def ranked(df: DataFrame, metric: str = "time") -> DataFrame:
    """rank, label, value: data sets by their last row, fastest first for "time", highest throughput first for "gflops"; ties by label.

    The order is over one row for each data set, after its aggregate.
    """
    value = "median_ms" if metric == "time" else "gflops"
    last = last_row(df, "label", "array_size", value)
    order = Window.orderBy(F.asc(value) if metric == "time" else F.desc(value), F.asc("label"))
    return last.select(F.row_number().over(order).alias("rank"), "label", F.col(value).alias("value"))


def axis_limit(df: DataFrame) -> DataFrame:
    return df.agg(F.max("array_size").alias("max_size"))
