"""Capability levels: register bits, the classification ladder, names and dispatch."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Level names by code, and the variant and command-line name of each.
LEVEL_NAMES = ("Scalar", "SSE2", "SSE4.2", "AVX", "AVX2", "AVX-512F")
VARIANTS = ("scalar", "sse2", "sse42", "avx", "avx2", "avx512f")
FORCED_NAMES = ("scalar", "sse2", "sse4.2", "avx", "avx2", "avx512f")
# Feature -> register and bit, and masks of the XCR0 register.
BITS = {"sse2": ("l1_edx", 26), "sse42": ("l1_ecx", 20), "osxsave": ("l1_ecx", 27), "avx": ("l1_ecx", 28), "avx2": ("l7_ebx", 5), "avx512f": ("l7_ebx", 16)}
YMM_MASK, ZMM_MASK = 0x6, 0xE0


def _by_code(code: Column | str, names: tuple[str, ...], other: Column) -> Column:
    code = F.col(code) if isinstance(code, str) else code
    out = F.when(code == 0, names[0])
    for i, name in enumerate(names[1:], 1):
        out = out.when(code == i, name)
    return out.otherwise(other)


def level_name(code: Column | str) -> Column:
    """The display name; anything that is no level, null included, is Unknown."""
    return _by_code(code, LEVEL_NAMES, F.lit("Unknown"))


def dispatch_variant(code: Column | str) -> Column:
    """The kernel variant that a level runs; scalar for what is no level."""
    return _by_code(code, VARIANTS, F.lit("scalar"))


def forced_level(name: Column | str) -> Column:
    """The code of a level given by its command-line name; an error for any other string, null for null."""
    name = F.col(name) if isinstance(name, str) else name
    out = F.when(name.isNull(), F.lit(None).cast("int"))
    for i, known in enumerate(FORCED_NAMES):
        out = out.when(name == known, F.lit(i))
    return out.otherwise(F.raise_error(F.concat(F.lit("unknown level '"), name, F.lit(f"'; valid levels: {', '.join(FORCED_NAMES)}"))).cast("int"))


def is_level(code: Column | str) -> Column:
    return (F.col(code) if isinstance(code, str) else code).between(0, len(LEVEL_NAMES) - 1)


def feature_bit(feature: str) -> Column:
    register, bit = BITS[feature]
    return F.shiftright(F.col(register).cast("long"), bit).bitwiseAND(F.lit(1)) == 1


def detected_level() -> Column:
    """The level of a row of registers (max_leaf, l1_ecx, l1_edx, l7_ebx, xcr0; unsigned values as LONG).

    XCR0 counts only with OSXSAVE; the 512-bit level asks for its own state
    bits alone, and SSE4.2 doesn't ask for SSE2. Null registers count as 0.
    """
    bit = {f: F.coalesce(feature_bit(f), F.lit(False)) for f in BITS}
    state = F.when(bit["osxsave"], F.coalesce(F.col("xcr0").cast("long"), F.lit(0))).otherwise(F.lit(0))
    ymm, zmm = (state.bitwiseAND(F.lit(m)) == m for m in (YMM_MASK, ZMM_MASK))
    ladder = ((F.coalesce(F.col("max_leaf"), F.lit(0)) == 0, 0), (bit["avx"] & bit["avx512f"] & zmm, 5), (bit["avx"] & bit["avx2"] & ymm, 4), (bit["avx"] & ymm, 3), (bit["sse42"], 2), (bit["sse2"], 1))
    out = F.when(*ladder[0])
    for rung in ladder[1:]:
        out = out.when(*rung)
    return out.otherwise(0)


def leveled_sum(a: Column, b: Column, level: Column, constants: dict[int, float], other: float = 0.0) -> Column:
    """a + b + a constant chosen by level, in single precision: an expression whose variant the level picks."""
    k = F.lit(other)
    for code, value in constants.items():
        k = F.when(level == code, F.lit(value)).otherwise(k)
    return a.cast("float") + b.cast("float") + k.cast("float")
