"""Names of processors and result files as slugs, labels, axis ticks and titles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words dropped from processor names in this order, first hit each; level prefixes of file names and how a level is shown.
NOISE = ("-core", " core", "processor")
LEVEL_PREFIXES = ("avx_512f", "avx512f", "avx2", "avx", "sse4_2", "sse42", "sse2", "scalar")
LEVEL_SHOWN = {"avx_512f": "AVX-512F", "avx512f": "AVX-512F", "avx2": "AVX2", "avx": "AVX", "sse4_2": "SSE4.2", "sse42": "SSE4.2", "sse2": "SSE2", "scalar": "Scalar"}
LONGEST_SLUG = 80


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def without_noise(name: Column | str) -> Column:
    """Without the first hit of each noise word, the digits, spaces and hyphens before it and the spaces after it."""
    out = _c(name)
    for word in NOISE:
        out = F.regexp_replace(out, rf"(?is)^(.*?)[0-9 \-]*{word} *", "$1")
    return out


def cpu_slug(name: Column | str) -> Column:
    """Lower-case letters and digits; runs of space, hyphen, bracket and @ between them as one underscore; nothing else."""
    kept = F.regexp_replace(F.lower(without_noise(name)), r"[^a-z0-9 \-()@]", "")
    return F.btrim(F.regexp_replace(kept, r"[ \-()@]+", "_"), F.lit("_"))


def shell_slug(name: Column | str) -> Column:
    """The other slug, of result files by level: every core count and "Processor" goes, all else that is no letter or digit becomes one underscore."""
    out = F.regexp_replace(F.regexp_replace(_c(name), r"(?i)[0-9]+-core", ""), "(?i)processor", "")
    out = F.regexp_replace(F.regexp_replace(F.lower(out), r"[^a-z0-9_]", "_"), "_+", "_")
    return F.regexp_replace(out, "^_|_$", "")


def level_slug(name: Column | str) -> Column:
    return F.regexp_replace(F.lower(_c(name)), "[-.]", "_")


def level_display(slug: Column | str) -> Column:
    return F.translate(_c(slug), "_", ".")


def result_file(name: Column | str, level: Column | str) -> Column:
    """File name of a processor's results at a level (by its display name); an empty or null processor name is unknown."""
    slug = F.substring(cpu_slug(name), 1, LONGEST_SLUG)
    return F.concat(F.lit("results_"), F.when(F.coalesce(slug, F.lit("")) == "", F.lit("unknown_cpu")).otherwise(slug), F.lit("_"), level_slug(level), F.lit(".csv"))


def title_case(x: Column) -> Column:
    """Each run of letters capitalised, whatever stands before it."""
    return F.array_join(F.transform(F.regexp_extract_all(x, F.lit(r"\p{L}+|\P{L}+"), F.lit(0)), F.initcap), "")


def result_label(path: Column | str) -> Column:
    """"PROCESSOR (Level)" of a result file's name; the name in title case where it holds no level."""
    stem = F.regexp_replace(F.regexp_replace(_c(path), "^.*/", ""), r"(?<=.)\.[^.]*$", "")
    stem = F.regexp_replace(stem, "^results_", "")
    # the first part at which what follows begins like a level
    found = rf"^(?:(.*?)_)??((?:{'|'.join(LEVEL_PREFIXES)}).*)$"
    cpu, level = (F.regexp_extract(stem, found, i) for i in (1, 2))
    shown = F.coalesce(F.create_map(*(F.lit(x) for kv in LEVEL_SHOWN.items() for x in kv))[level], F.upper(level))
    return F.when(level == "", title_case(F.translate(stem, "_", " "))).otherwise(F.concat(F.upper(F.translate(cpu, "_", " ")), F.lit(" ("), shown, F.lit(")")))


def _one_decimal(v: Column, by: int) -> Column:
    """v / by with one decimal, v a whole number: the quotient in double precision, as it is to its last bit, rounded to the nearest.

    Halves of a tenth have no exact double but for multiples of a quarter, which
    go to the even tenth; of others the quotient's error decides: it is the sign
    of q * by - v, exact in two parts of q.
    """
    q = v / F.lit(float(by))
    high = q * F.lit(134217729.0) - (q * F.lit(134217729.0) - q)
    error = (high * by - v) + (q - high) * by
    tenths = F.floor(v * 10 / F.lit(by)).cast("long")
    twice = v * 20 - tenths * (2 * by)  # over the lower tenth, in units of a twentieth of by
    up = (twice > by) | ((twice == by) & ((error > 0) | ((error == 0) & (tenths % 2 == 1))))
    rounded = tenths + up.cast("long")
    return F.concat(F.floor(rounded / F.lit(10)).cast("long").cast("string"), F.lit("."), (rounded % 10).cast("string"))


def axis_label(value: Column | str) -> Column:
    """A whole number of at least 0 as 0, 512, 4K, 1.5K or 2M."""
    v = _c(value)
    scaled = lambda by, unit: F.when(v % by == 0, F.concat((v / by).cast("long").cast("string"), F.lit(unit))).otherwise(F.concat(_one_decimal(v, by), F.lit(unit)))
    return F.when(v >= 1_000_000, scaled(1_000_000, "M")).when(v >= 1_000, scaled(1_000, "K")).otherwise(v.cast("long").cast("string"))


def chart_title(labels: Column | str) -> Column:
    """A title for an array of labels: one, two against each other, or their number."""
    x = _c(labels)
    head = F.lit("Vector Multiply Performance - ")
    return F.when(F.size(x) == 1, F.concat(head, x[0])).when(F.size(x) == 2, F.concat(head, x[0], F.lit(" vs "), x[1])).otherwise(F.concat(head, F.size(x).cast("string"), F.lit(" CPU Comparison")))
