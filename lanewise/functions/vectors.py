"""Element-wise float32 arithmetic on columns and on arrays.

Results are FLOAT throughout: one IEEE-754 rounding for each element, no
widening. Overflow gives an infinity, NaN propagates, -0.0 and subnormal
numbers are kept. Everything is a built-in expression, so filters and column
selection reach the scan beneath it.
"""

from __future__ import annotations

from collections.abc import Callable
from operator import add, mul, sub

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

OPERATIONS: dict[str, Callable[[Column, Column], Column]] = {"vector_add_f32": add, "vector_sub_f32": sub, "vector_mul_f32": mul}
SYMBOLS = {"vector_add_f32": "+", "vector_sub_f32": "-", "vector_mul_f32": "*"}
UNEQUAL = "vectors of unequal length"


def f32(x: Column | str | float) -> Column:
    """A column, a column's name or a number as FLOAT; a bare Python number would widen to DOUBLE."""
    return (F.lit(x) if isinstance(x, (int, float)) else F.col(x) if isinstance(x, str) else x).cast("float")


def elementwise(op: Callable[[Column, Column], Column], a: Column | str, b: Column | str, n: Column | int | None = None) -> Column:
    """op of two ARRAY<FLOAT> columns by position.

    A null vector gives null, a null element a null element. Unequal lengths
    raise an error. ``n`` takes the first n elements of each instead, and
    raises where either has fewer.
    """
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    a, b = a.cast("array<float>"), b.cast("array<float>")
    fits = F.size(a) == F.size(b)
    if n is not None:
        n = F.lit(n) if isinstance(n, int) else n
        fits = F.least(F.size(a), F.size(b)) >= n
        short = lambda x: F.slice(x, F.lit(1), n)
    else:
        short = lambda x: x
    wrong = F.raise_error(F.lit(UNEQUAL)).cast("array<float>")
    return F.when(a.isNull() | b.isNull(), F.lit(None).cast("array<float>")).when(fits, F.zip_with(short(a), short(b), lambda x, y: op(x, y))).otherwise(wrong)


def vector_add_f32(a: Column | str, b: Column | str, n: Column | int | None = None) -> Column:
    return elementwise(add, a, b, n)


def vector_sub_f32(a: Column | str, b: Column | str, n: Column | int | None = None) -> Column:
    """a minus b."""
    return elementwise(sub, a, b, n)


def vector_mul_f32(a: Column | str, b: Column | str, n: Column | int | None = None) -> Column:
    """The element-wise product, not the dot product."""
    return elementwise(mul, a, b, n)


def row_op(name: str, a: Column | str, b: Column | str) -> Column:
    """The same operations where each row holds one element of either vector; stays in whole-stage codegen."""
    return OPERATIONS[name](f32(a), f32(b))


def create_sql_functions(spark: SparkSession) -> list[str]:
    """The three operations as temporary SQL functions, which the analyzer inlines; returns their names."""
    for name, symbol in SYMBOLS.items():
        spark.sql(f"""CREATE OR REPLACE TEMPORARY FUNCTION {name}(a ARRAY<FLOAT>, b ARRAY<FLOAT>) RETURNS ARRAY<FLOAT>
            RETURN CASE WHEN a IS NULL OR b IS NULL THEN NULL WHEN size(a) = size(b) THEN zip_with(a, b, (x, y) -> x {symbol} y) ELSE raise_error('{UNEQUAL}') END""")
    return list(SYMBOLS)
