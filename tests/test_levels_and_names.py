import re

import pytest
from pyspark.sql import functions as F

from lanewise.functions import benchmark, levels, names
from lanewise.operators.registry import Registry, standard
from lanewise.plans import fixtures


def ladder(leaf, ecx, edx, ebx, xcr0):
    osx = ecx >> 27 & 1
    state = xcr0 if osx else 0
    avx = ecx >> 28 & 1
    if not leaf:
        return 0
    if avx and ebx >> 16 & 1 and state & 0xE0 == 0xE0:
        return 5
    if avx and ebx >> 5 & 1 and state & 6 == 6:
        return 4
    if avx and state & 6 == 6:
        return 3
    return 2 if ecx >> 20 & 1 else 1 if edx >> 26 & 1 else 0


def test_truth_table(spark):
    rows = fixtures.snapshots()
    assert len(rows) == 512
    df = spark.createDataFrame(rows, "i long, max_leaf long, l1_ecx long, l1_edx long, l7_ebx long, xcr0 long")
    got = {r.i: r.level for r in df.select("i", levels.detected_level().alias("level")).collect()}
    assert got == {i: ladder(*r) for i, *r in rows}


def test_named_cases(spark):
    def row(sse2, sse42, osx, avx, avx2, avx512, xcr0, leaf):
        return leaf, sse42 << 20 | osx << 27 | avx << 28, sse2 << 26, avx2 << 5 | avx512 << 16, xcr0

    cases = [((1, 1, 1, 1, 1, 1, 0xE6, 7), 5), ((1, 1, 1, 1, 1, 1, 0xE0, 7), 5), ((1, 1, 1, 1, 1, 1, 6, 7), 4), ((1, 1, 0, 1, 1, 1, 0xE6, 7), 2), ((1, 1, 1, 0, 1, 0, 6, 7), 2), ((1, 1, 1, 1, 0, 0, 6, 7), 3), ((0, 1, 0, 0, 0, 0, 0, 7), 2), ((1, 0, 0, 0, 0, 0, 0, 7), 1), ((0,) * 7 + (7,), 0), ((1, 1, 1, 1, 1, 1, 0xE6, 0), 0)]
    df = spark.createDataFrame([row(*c) for c, _ in cases] + [(None,) * 5], "max_leaf long, l1_ecx long, l1_edx long, l7_ebx long, xcr0 long")
    assert [r[0] for r in df.select(levels.detected_level()).collect()] == [x for _, x in cases] + [0]


def test_level_maps(spark):
    df = spark.createDataFrame([(i,) for i in (-1, 0, 1, 2, 3, 4, 5, 6, None)], "level int")
    got = [tuple(r) for r in df.select(levels.level_name("level"), levels.dispatch_variant("level"), levels.is_level("level")).collect()]
    assert [g[0] for g in got] == ["Unknown", *levels.LEVEL_NAMES, "Unknown", "Unknown"]
    assert [g[1] for g in got] == ["scalar", *levels.VARIANTS, "scalar", "scalar"]
    assert [g[2] for g in got] == [False, *[True] * 6, False, None]
    forced = spark.createDataFrame([("avx2",), (None,)], "n string")
    assert [r[0] for r in forced.select(levels.forced_level("n")).collect()] == [4, None]
    with pytest.raises(Exception, match="valid levels"):
        spark.createDataFrame([("AVX2",)], "n string").select(levels.forced_level("n")).collect()


def test_registry(spark):
    r = standard()
    assert [x[1] for x in r.features()] == ["core", "vector_add", "vector_mul", "vector_sub"]
    assert r.features("core") == [(0, "core", "Capability detection and level names")]
    assert r["vector_mul"] is r["vector_mul"]
    with pytest.raises(ValueError):
        r.register("vector_add", lambda: 1)
    own = Registry()
    own.register("none", lambda: None)
    with pytest.raises(RuntimeError):
        own["none"]
    assert own.catalog(spark).columns == ["idx", "name", "description"]


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_processor_names(spark):
    want = {"AMD Ryzen 9 9950X3D 16-Core Processor": "amd_ryzen_9_9950x3d", "AMD EPYC 7452 32-Core Processor": "amd_epyc", "Intel(R) Core(TM) i9-13900K": "intel_r_tm_i9_13900k", "Intel(R) Xeon(R) CPU E5-2690 0 @ 2.90GHz": "intel_r_xeon_r_cpu_e5_2690_0_290ghz", "": "", "  --  ": "", "é": ""}
    assert {k: one(spark, names.cpu_slug(F.lit(k))) for k in want} == want
    assert one(spark, names.result_file(F.lit("x" * 100), F.lit("AVX-512F"))) == f"results_{'x' * 80}_avx_512f.csv"
    assert one(spark, names.result_file(F.lit(None).cast("string"), F.lit("SSE4.2"))) == "results_unknown_cpu_sse4_2.csv"
    shell = re.sub("^_|_$", "", re.sub("_+", "_", re.sub("[^a-z0-9_]", "_", re.sub("(?i)processor", "", re.sub("(?i)[0-9]+-core", "", "AMD EPYC 7452 32-Core Processor")).lower())))
    assert one(spark, names.shell_slug(F.lit("AMD EPYC 7452 32-Core Processor"))) == shell == "amd_epyc_7452"


def label(path):
    stem = path.rpartition("/")[2].removesuffix(".csv").removeprefix("results_")
    parts = stem.split("_")
    for i in range(len(parts)):
        rest = "_".join(parts[i:])
        if rest.startswith(names.LEVEL_PREFIXES):
            return f"{' '.join(parts[:i]).upper()} ({names.LEVEL_SHOWN.get(rest, rest.upper())})"
    return stem.replace("_", " ").title()


def test_labels(spark):
    files = [*fixtures.RESULT_FILES, "/a/b/results_x_avx_scalar.csv", "results_9950x3d.csv", "scalar.csv", "a__avx2.csv", "_sse42.csv"]
    df = spark.createDataFrame([(f,) for f in files], "f string")
    assert {r.f: r.x for r in df.select("f", names.result_label("f").alias("x")).collect()} == {f: label(f) for f in files}


def test_axis_and_titles(spark):
    want = {0: "0", 512: "512", 999: "999", 1000: "1K", 1024: "1.0K", 1500: "1.5K", 1_000_000: "1M", 2_621_440: "2.6M", 4_000_000: "4M"}
    assert {k: one(spark, names.axis_label(F.lit(k))) for k in want} == want
    assert one(spark, names.chart_title(F.array(F.lit("p"), F.lit("q")))).endswith("p vs q")


def test_repetitions(spark):
    want = {99_999: 5000, 100_000: 2000, 1_999_999: 2000, 2_000_000: 1000, 4_999_999: 1000, 5_000_000: 500}
    assert {k: one(spark, benchmark.iterations(F.lit(k))) for k in want} == want
    assert one(spark, benchmark.gflops_published(F.lit(512), F.lit(1e-5))) == pytest.approx(5000 * one(spark, benchmark.gflops(F.lit(512), F.lit(1e-5))))
