"""QUERIES: name -> (spark, sf_dir) -> DataFrame; ORACLE_SQL: the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanewise.functions import benchmark, levels, names, vectors
from lanewise.operators import kernels, results, stats, verify
from lanewise.operators.registry import Registry, standard
from lanewise.plans import fixtures
from lanewise.sources import generated, hardware
from lanewise.sources import results as files
from lanewise.sources.work import new_folder, put_text

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
#: Elements of generated inputs, and lanes of the prefix query.
GENERATED, PREFIX = 4_194_304, 10
DIGITS = 6


def query(sql: str, name: str | None = None) -> Callable:
    def keep(f: Callable) -> Callable:
        QUERIES[name or f.__name__] = f
        ORACLE_SQL[name or f.__name__] = sql
        return f

    return keep


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _rows(op: str) -> Callable:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", vectors.row_op(op, "l_extendedprice", "l_discount").alias("out"))

    return run


def _arrays(op: str) -> Callable:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return kernels.neighbours(_read(spark, sf_dir, "embeddings"), "vec_id", "embedding", op)

    return run


def _sql_function(op: str) -> Callable:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        vectors.create_sql_functions(spark)
        return _read(spark, sf_dir, "embeddings").select("vec_id", F.call_function(op, "embedding", "embedding").alias("out"))

    return run


_PAIRS = "FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1"
for _op, _symbol in vectors.SYMBOLS.items():
    query(f"SELECT l_orderkey, l_linenumber, CAST(l_extendedprice AS FLOAT) {_symbol} CAST(l_discount AS FLOAT) AS out FROM lineitem", f"{_op}_rows")(_rows(_op))
    query(f"SELECT a.vec_id AS vec_id, list_transform(list_zip(a.embedding, b.embedding), lambda p: p[1] {_symbol} p[2]) AS out {_PAIRS}", f"{_op}_arrays")(_arrays(_op))
    query(f"SELECT vec_id, list_transform(embedding, lambda x: x {_symbol} x) AS out FROM embeddings", f"{_op}_sql")(_sql_function(_op))


@query(f"SELECT a.vec_id AS vec_id, list_transform(list_zip(a.embedding[1:{PREFIX}], b.embedding[1:{PREFIX}]), lambda p: p[1] * p[2]) AS out {_PAIRS}")
def vector_mul_f32_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kernels.neighbours(_read(spark, sf_dir, "embeddings"), "vec_id", "embedding", "vector_mul_f32", PREFIX)


@query("SELECT a.vec_id AS vec_id, a.i - 1 AS idx, a.x * b.x AS out FROM (SELECT vec_id, unnest(range(1, len(embedding) + 1)) AS i, unnest(embedding) AS x FROM embeddings) a JOIN (SELECT vec_id, unnest(range(1, len(embedding) + 1)) AS i, unnest(embedding) AS x FROM embeddings) b ON b.vec_id = a.vec_id + 1 AND b.i = a.i")
def vector_mul_f32_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs of neighbouring vectors as one element a row, joined by vector and position."""
    e = _read(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("idx", "x"))
    left, right = e.select("vec_id", "idx", F.col("x").alias("a")), e.select((F.col("vec_id") - 1).alias("vec_id"), "idx", F.col("x").alias("b"))
    return kernels.paired(left, right, ["vec_id", "idx"], "vector_mul_f32").withColumn("idx", F.col("idx").cast("long"))


_INPUT = "SELECT i AS idx, CAST(i AS FLOAT) * CAST(0.5 AS FLOAT) AS a, CAST(i AS FLOAT) * CAST(0.25 AS FLOAT) + CAST(1.0 AS FLOAT) AS b FROM range({n}) t(i)"


@query(_INPUT.format(n=4096))
def bench_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generated.benchmark_input(spark, 4096)


@query(f"SELECT idx, a * b AS out FROM ({_INPUT.format(n=4096)})")
def bench_mul(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kernels.over_rows(generated.benchmark_input(spark, 4096), "vector_mul_f32").select("idx", "out")


@query("SELECT i AS idx, CAST(i AS FLOAT) AS a, CAST(i + 1 AS FLOAT) AS b, CAST(i AS FLOAT) + CAST(i + 1 AS FLOAT) AS added, CAST(i AS FLOAT) - CAST(i + 1 AS FLOAT) AS subtracted, CAST(i AS FLOAT) * CAST(i + 1 AS FLOAT) AS multiplied FROM range(16) t(i)")
def unit_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = generated.unit_input(spark)
    for op, name in (("vector_add_f32", "added"), ("vector_sub_f32", "subtracted"), ("vector_mul_f32", "multiplied")):
        out = kernels.over_rows(out, op, out=name)
    return out


_SPOILT = f"SELECT idx, a, b, CASE idx % 1000 WHEN 3 THEN a * b + 1 WHEN 5 THEN NULL WHEN 7 THEN 'nan'::FLOAT WHEN 11 THEN CAST(a * b + 5e-7 AS FLOAT) ELSE a * b END AS out FROM ({_INPUT.format(n=GENERATED)})"


def _spoilt(spark: SparkSession) -> DataFrame:
    """Products, some of them wrong, null, NaN or off by less than the tolerance."""
    out, n = F.col("a") * F.col("b"), F.col("idx") % 1000
    spoilt = F.when(n == 3, out + F.lit(1).cast("float")).when(n == 5, F.lit(None)).when(n == 7, F.lit(float("nan"))).when(n == 11, (out + F.lit(5e-7)).cast("float")).otherwise(out)
    return generated.benchmark_input(spark, GENERATED).withColumn("out", spoilt.cast("float"))


@query(f"SELECT idx, a, b FROM ({_SPOILT}) WHERE idx < 16 AND (out IS NULL OR isnan(out) OR out <> a * b)")
def verify_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify.exact_mismatches(_spoilt(spark), "vector_mul_f32").drop("out")


@query(f"SELECT count(*) FILTER (WHERE out IS NULL OR isnan(out) OR abs(out - a * b) > CAST(1e-6 AS FLOAT)) AS failures FROM ({_SPOILT})")
def verify_tolerance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify.tolerance_failures(_spoilt(spark), "vector_mul_f32")


@query("SELECT count(*) AS observations, count(DISTINCT label) AS levels, count(DISTINCT label) <= 1 AS agreed FROM embeddings")
def observations_agree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify.agreement(_read(spark, sf_dir, "embeddings"), "label")


@query("SELECT name FROM (VALUES ('scalar'), ('sse2'), ('sse4_2'), ('avx'), ('avx2'), ('avx512f')) e(name) WHERE name NOT IN ('avx', 'scalar')")
def missing_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    expected = spark.createDataFrame([("scalar",), ("sse2",), ("sse4_2",), ("avx",), ("avx2",), ("avx512f",)], "name string")
    return verify.missing(expected, spark.createDataFrame([("avx",), ("scalar",)], "name string"), "name")


_SIZES = f"(VALUES {fixtures.values((n,) for n in (*generated.SIZES, 99_999, 100_000, 1_999_999, 2_000_000, 4_999_999, 5_000_000))}) s(array_size)"
_REPEATS = "CASE WHEN array_size < 100000 THEN 5000 WHEN array_size < 2000000 THEN 2000 WHEN array_size < 5000000 THEN 1000 ELSE 500 END"


def _sizes(spark: SparkSession) -> DataFrame:
    more = spark.createDataFrame([(n,) for n in (99_999, 100_000, 1_999_999, 2_000_000, 4_999_999, 5_000_000)], "array_size long")
    return generated.size_axis(spark).union(more)


@query(f"SELECT array_size::BIGINT AS array_size, {_REPEATS} AS iterations FROM {_SIZES}")
def iters_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sizes(spark).select("array_size", benchmark.iterations("array_size").alias("iterations"))


@query(f"SELECT array_size::BIGINT AS array_size, round(({_REPEATS}) * array_size::BIGINT / (m / 1000.0::DOUBLE) / 1e9::DOUBLE, 6) AS gflops_published, round(array_size / (m * 1e6::DOUBLE), {DIGITS}) AS gflops_true FROM (SELECT array_size, array_size * 2e-7::DOUBLE + 1e-5::DOUBLE AS m FROM {_SIZES})")
def gflops_published_vs_true(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _sizes(spark).withColumn("m", F.col("array_size") * F.lit(2e-7) + F.lit(1e-5))
    return df.select("array_size", F.round(benchmark.gflops_published("array_size", "m"), 6).alias("gflops_published"), F.round(benchmark.gflops("array_size", "m"), DIGITS).alias("gflops_true"))


def _statistics_sql(value: str) -> str:
    return f"round(quantile_cont({value}, 0.5), {DIGITS}) AS median_ms, round(avg({value}), {DIGITS}) AS mean_ms, round(stddev_pop({value}), {DIGITS}) AS stddev_ms, min({value}) AS min_ms, max({value}) AS max_ms, round(quantile_cont({value}, 0.99), {DIGITS}) AS p99_ms"


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*(F.round(c, DIGITS).alias(c) if c in ("median_ms", "mean_ms", "stddev_ms", "p99_ms") else F.col(c) for c in df.columns))


@query(f"SELECT l_returnflag, {_statistics_sql('l_quantity')} FROM lineitem GROUP BY l_returnflag")
def trial_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(stats.trial_statistics(_read(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_quantity"))


@query(f"SELECT array_size::BIGINT AS array_size, {_statistics_sql('time_ms')} FROM (VALUES {fixtures.values(fixtures.TRIALS)}) t(array_size, trial, time_ms) GROUP BY array_size")
def trial_stats_small(spark: SparkSession, sf_dir: str) -> DataFrame:
    trials = spark.createDataFrame(list(fixtures.TRIALS), "array_size long, trial int, time_ms double")
    return _rounded(stats.trial_statistics(trials, ["array_size"]))


def _case(of: str, cases: tuple[str, ...], other: str) -> str:
    return f"CASE {of} " + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(cases)) + f" ELSE '{other}' END"


@query(f"SELECT i AS level, {_case('i', levels.LEVEL_NAMES, 'Unknown')} AS name, i BETWEEN 0 AND 5 AS known FROM range(-1, 7) t(i)")
def simd_level_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.range(-1, 7).select(F.col("id").alias("level"), levels.level_name("id").alias("name"), levels.is_level("id").alias("known"))


@query(f"SELECT i AS level, {_case('i', levels.VARIANTS, 'scalar')} AS variant FROM range(-1, 7) t(i)")
def dispatch_variant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.range(-1, 7).select(F.col("id").alias("level"), levels.dispatch_variant("id").alias("variant"))


@query("SELECT name, level FROM (VALUES ('scalar', 0), ('sse2', 1), ('sse4.2', 2), ('avx', 3), ('avx2', 4), ('avx512f', 5)) f(name, level)")
def forced_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(n,) for n in levels.FORCED_NAMES], "name string").select("name", levels.forced_level("name").alias("level"))


_SNAPSHOTS = f"(VALUES {fixtures.values(fixtures.snapshots())}) s(snap_id, max_leaf, l1_ecx, l1_edx, l7_ebx, xcr0)"


@query(f"""SELECT snap_id::BIGINT AS snap_id, level, {_case('level', levels.LEVEL_NAMES, 'Unknown')} AS name FROM (SELECT snap_id, CASE
    WHEN max_leaf = 0 THEN 0
    WHEN (l1_ecx >> 28) & 1 = 1 AND (l7_ebx >> 16) & 1 = 1 AND (l1_ecx >> 27) & 1 = 1 AND xcr0 & 224 = 224 THEN 5
    WHEN (l1_ecx >> 28) & 1 = 1 AND (l7_ebx >> 5) & 1 = 1 AND (l1_ecx >> 27) & 1 = 1 AND xcr0 & 6 = 6 THEN 4
    WHEN (l1_ecx >> 28) & 1 = 1 AND (l1_ecx >> 27) & 1 = 1 AND xcr0 & 6 = 6 THEN 3
    WHEN (l1_ecx >> 20) & 1 = 1 THEN 2 WHEN (l1_edx >> 26) & 1 = 1 THEN 1 ELSE 0 END AS level FROM {_SNAPSHOTS})""")
def simd_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "snapshots")
    spark.createDataFrame(fixtures.snapshots(), "snap_id long, max_leaf long, l1_ecx long, l1_edx long, l7_ebx long, xcr0 long").write.parquet(folder)
    df = hardware.read_snapshots(spark.read.parquet(folder))
    df = df.select("snap_id", levels.detected_level().alias("level"))
    return df.select("snap_id", "level", levels.level_name("level").alias("name"))


@query("SELECT i AS level, CAST(10 AS FLOAT) + CAST(2 AS FLOAT) + CAST(CASE i WHEN 1 THEN 2 WHEN 2 THEN 3 WHEN 3 THEN 4 WHEN 5 THEN 5 ELSE 1 END AS FLOAT) AS out FROM range(0, 6) t(i)")
def leveled_expression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.range(6).select(F.col("id").alias("level"), levels.leveled_sum(F.lit(10), F.lit(2), F.col("id"), {1: 2.0, 2: 3.0, 3: 4.0, 5: 5.0}, 1.0).alias("out"))


@query("SELECT idx, name FROM (VALUES (0, 'core'), (1, 'vector_add'), (2, 'vector_mul'), (3, 'vector_sub')) f(idx, name)")
def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return standard().catalog(spark).select("idx", "name")


@query("SELECT idx, name, description FROM (VALUES (0, 'core', 'Capability detection and level names'), (1, 'vector_add', 'Element-wise addition'), (2, 'vector_mul', 'Element-wise multiplication'), (3, 'vector_sub', 'Element-wise subtraction')) f(idx, name, description)")
def features_described(spark: SparkSession, sf_dir: str) -> DataFrame:
    return standard().catalog(spark)


@query("SELECT 0 AS idx, 'core' AS name")
def features_core(spark: SparkSession, sf_dir: str) -> DataFrame:
    return standard().catalog(spark, "core").select("idx", "name")


def _names(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(n,) for n in fixtures.CPU_NAMES], "name string")


_NAMES = f"(VALUES {fixtures.values((n,) for n in fixtures.CPU_NAMES)}) c(name)"
_QUIET = "regexp_replace(regexp_replace(regexp_replace(name, '(?is)^(.*?)[0-9 \\-]*-core *', '\\1'), '(?is)^(.*?)[0-9 \\-]* core *', '\\1'), '(?is)^(.*?)[0-9 \\-]*processor *', '\\1')"
_SLUG = f"trim(regexp_replace(regexp_replace(lower({_QUIET}), '[^a-z0-9 ()@-]', '', 'g'), '[ ()@-]+', '_', 'g'), '_')"


@query(f"SELECT name, {_SLUG} AS slug FROM {_NAMES}")
def cpu_slug(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _names(spark).select("name", names.cpu_slug("name").alias("slug"))


@query(f"SELECT name, regexp_replace(regexp_replace(regexp_replace(lower(regexp_replace(regexp_replace(name, '[0-9]+-core', '', 'gi'), 'processor', '', 'gi')), '[^a-z0-9_]', '_', 'g'), '_+', '_', 'g'), '^_|_$', '', 'g') AS slug FROM {_NAMES}")
def shell_slug(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _names(spark).select("name", names.shell_slug("name").alias("slug"))


@query(f"SELECT 'results_' || substr({_SLUG}, 1, 80) || '_' || replace(replace(lower(level), '-', '_'), '.', '_') || '.csv' AS file, replace(replace(replace(lower(level), '-', '_'), '.', '_'), '_', '.') AS shown FROM {_NAMES}, (VALUES ('AVX-512F'), ('SSE4.2'), ('Scalar')) l(level)")
def result_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _names(spark).select("name", F.explode(F.array(F.lit("AVX-512F"), F.lit("SSE4.2"), F.lit("Scalar"))).alias("level"))
    return df.select(names.result_file("name", "level").alias("file"), names.level_display(names.level_slug("level")).alias("shown"))


_LABELS = {"results_amd_ryzen_9_9950x3d_avx_512f.csv": "AMD RYZEN 9 9950X3D (AVX-512F)", "simd_levels_amd_ryzen_9_9950x3d_avx2.csv": "SIMD LEVELS AMD RYZEN 9 9950X3D (AVX2)", "results_intel_xeon_x5560_sse4_2.csv": "INTEL XEON X5560 (SSE4.2)", "results_intel_xeon_gold_6426y_avx_512f.csv": "INTEL XEON GOLD 6426Y (AVX-512F)", "foo_bar.csv": "Foo Bar", "results_avx2.csv": " (AVX2)", "results_amd_x_avx2_old.csv": "AMD X (AVX2_OLD)"}


@query(f"SELECT file, label FROM (VALUES {fixtures.values(_LABELS.items())}) l(file, label)")
def result_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(f,) for f in fixtures.RESULT_FILES], "file string").select("file", names.result_label("file").alias("label"))


_RESULTS = f"(VALUES {fixtures.values(fixtures.RESULTS)}) r(label, input_pos, array_size, median_ms, gflops)"
_MERGED = f"(SELECT * FROM (SELECT *, max(input_pos) OVER (PARTITION BY label) AS last FROM {_RESULTS}) WHERE input_pos = last)"


def _results(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(fixtures.RESULTS), "label string, input_pos int, array_size long, median_ms double, gflops double")


@query(f"SELECT label, input_pos, array_size::BIGINT AS array_size, median_ms, gflops FROM {_MERGED}")
def dedup_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results.last_wins(_results(spark))


for _metric, _by, _way in (("time", "median_ms", "ASC"), ("gflops", "gflops", "DESC")):
    query(f"SELECT CAST(row_number() OVER (ORDER BY v {_way}, label) AS INT) AS rank, label, v AS value FROM (SELECT label, arg_max({_by}, array_size) AS v FROM {_MERGED} GROUP BY label)", f"rank_datasets_{_metric}")(
        lambda spark, sf_dir, metric=_metric: results.ranked(results.last_wins(_results(spark)), metric)
    )


@query(f"SELECT label, arg_max(median_ms, array_size) AS median_ms, arg_max(gflops, array_size) AS gflops FROM {_MERGED} GROUP BY label")
def last_row_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results.last_row(results.last_wins(_results(spark)), "label", "array_size", "median_ms", "gflops")


@query(f"SELECT max(array_size)::BIGINT AS max_size FROM {_RESULTS}")
def axis_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results.axis_limit(_results(spark))


_HALVES = (0, 999, 1050, 1150, 1250, 1350, 2250, 9950, 999_950, 1_050_000, 1_150_000, 1_250_000, 2_350_000, 12_750_000)
_TICKS = f"(SELECT * FROM {_SIZES} UNION ALL SELECT * FROM (VALUES {fixtures.values((n,) for n in _HALVES)}) h(array_size))"


@query(f"SELECT array_size::BIGINT AS array_size, CASE WHEN array_size >= 1000000 THEN CASE WHEN array_size % 1000000 = 0 THEN (array_size // 1000000)::VARCHAR ELSE printf('%.1f', array_size / 1e6::DOUBLE) END || 'M' WHEN array_size >= 1000 THEN CASE WHEN array_size % 1000 = 0 THEN (array_size // 1000)::VARCHAR ELSE printf('%.1f', array_size / 1e3::DOUBLE) END || 'K' ELSE array_size::VARCHAR END AS label FROM {_TICKS}")
def axis_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _sizes(spark).union(spark.createDataFrame([(n,) for n in _HALVES], "array_size long"))
    return df.select("array_size", names.axis_label("array_size").alias("label"))


@query("SELECT n, CASE n WHEN 1 THEN 'Vector Multiply Performance - a' WHEN 2 THEN 'Vector Multiply Performance - a vs b' ELSE 'Vector Multiply Performance - ' || n || ' CPU Comparison' END AS title FROM (VALUES (1), (2), (3)) t(n)")
def chart_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.createDataFrame([(1, ["a"]), (2, ["a", "b"]), (3, ["a", "b", "c"])], "n int, labels array<string>")
    return df.select("n", names.chart_title("labels").alias("title"))


@query("SELECT l_orderkey, l_linenumber, l_quantity - (l_extendedprice - l_quantity) / 4.0::DOUBLE AS low, l_quantity + (l_extendedprice - l_quantity) / 4.0::DOUBLE AS high, l_quantity * 1000.0::DOUBLE AS second_axis FROM lineitem")
def chart_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    low, high = benchmark.band("l_quantity", benchmark.gflops_error("l_quantity", "l_extendedprice"))
    return _read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", low.alias("low"), high.alias("high"), benchmark.second_axis("l_quantity").alias("second_axis"))


_READ = "x(array_size, median_ms, mean_ms, stddev_ms, min_ms, max_ms, p99_ms, gflops, simd_level, label, input_pos)"
_FILES_READ = f"(SELECT * REPLACE (array_size::BIGINT AS array_size) FROM (VALUES {fixtures.values(fixtures.FILES_READ)}) {_READ})"


def _files(spark: SparkSession) -> DataFrame:
    """Three files of a glob, and the last of them again under the first one's label."""
    folder = new_folder(spark, "files")
    for name, header, rows in fixtures.FILES:
        put_text(spark, f"{folder}/{name}", "\n".join((header, *rows)) + "\n")
    return files.read_results(spark, f"{folder}/results_*.csv", f"{folder}/{fixtures.FILES[2][0]}:{fixtures.FILES_READ[0][9]}")


@query(f"SELECT * FROM {_FILES_READ}")
def read_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _files(spark)


@query(f"SELECT label, array_size, median_ms, simd_level, input_pos FROM (SELECT *, max(input_pos) OVER (PARTITION BY label) AS last FROM {_FILES_READ}) WHERE input_pos = last")
def merged_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results.last_wins(_files(spark)).select("label", "array_size", "median_ms", "simd_level", "input_pos")


_MEASURED = f"(VALUES {fixtures.values(fixtures.MEASURED)}) m(name, simd_level, array_size, median_ms, mean_ms, stddev_ms, min_ms, max_ms, p99_ms, gflops)"
_TIMES = ("median_ms", "mean_ms", "stddev_ms", "min_ms", "max_ms", "p99_ms")
_AS_TEXT = {c: f"printf('%.6f', {c})" for c in _TIMES}


def _measured(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(fixtures.MEASURED), "cpu string, simd_level string, array_size long, median_ms double, mean_ms double, stddev_ms double, min_ms double, max_ms double, p99_ms double, gflops double")


@query(f"SELECT array_size::VARCHAR AS array_size, {', '.join(f'{x} AS {c}' for c, x in _AS_TEXT.items())}, printf('%.4f', gflops) AS gflops, simd_level FROM {_MEASURED}")
def results_as_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.as_text(_measured(spark))


_FILE = f"'results_' || CASE WHEN name IS NULL THEN 'unknown_cpu' ELSE substr({_SLUG}, 1, 80) END || '_' || replace(replace(lower(simd_level), '-', '_'), '.', '_') || '.csv'"


@query(f"SELECT DISTINCT {_FILE} AS file FROM {_MEASURED}")
def results_named(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = files.write_results(_measured(spark), new_folder(spark, "results"))
    return made.select(F.regexp_replace("path", "^.*/", "").alias("file"))


@query(f"SELECT array_size::BIGINT AS array_size, {', '.join(f'{x}::DOUBLE AS {c}' for c, x in _AS_TEXT.items())}, gflops, simd_level, CAST(dense_rank() OVER (ORDER BY {_FILE}) - 1 AS INT) AS input_pos FROM {_MEASURED}")
def results_written_and_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "results")
    files.write_results(_measured(spark), folder)
    return files.read_results(spark, f"{folder}/*.csv").drop("label")


@query(f"SELECT printf('%10d elements: %.6f ms (mean %.6f, sd %.6f), %.4f GFLOP/s, %s', array_size::BIGINT, median_ms, mean_ms, stddev_ms, gflops, simd_level) AS line FROM {_MEASURED}")
def report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.report(_measured(spark))


@query("SELECT 'AMD EPYC 7452 32-Core Processor' AS model")
def hardware_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.cpu_model(spark, put_text(spark, new_folder(spark, "hardware") + "/info", fixtures.DESCRIPTION))


@query("SELECT 7::BIGINT AS max_leaf, ((1 << 20) + (1 << 27) + (1 << 28))::BIGINT AS l1_ecx, (1 << 26)::BIGINT AS l1_edx, (1 << 5)::BIGINT AS l7_ebx, 6::BIGINT AS xcr0, 'AVX2' AS name")
def hardware_registers(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = spark.read.text(put_text(spark, new_folder(spark, "hardware") + "/info", fixtures.DESCRIPTION))
    return hardware.described(lines).select("*", levels.level_name(levels.detected_level()).alias("name"))


#: Threads and how often each asks for the level.
THREADS, ASKED = 8, 10_000


@query(f"SELECT {THREADS * ASKED}::BIGINT AS observations, 1::BIGINT AS levels, true AS agreed")
def detected_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    with ThreadPoolExecutor(THREADS) as pool:
        seen = list(pool.map(lambda thread: [(thread, i, hardware.detected(spark)) for i in range(ASKED)], range(THREADS)))
    return verify.agreement(spark.createDataFrame([x for rows in seen for x in rows], "thread_id int, iteration int, level int"))


@query("SELECT name, built, error FROM (VALUES ('good', true, NULL), ('missing', false, 'KeyError'), ('nothing', false, 'RuntimeError')) t(name, built, error)")
def registry_trap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A builder that returns nothing is an error when its operator is asked for, not a silent gap."""
    registry, rows = Registry(), []
    registry.register("good", lambda: vectors.vector_add_f32)
    registry.register("nothing", lambda: None)
    for name in ("good", "missing", "nothing"):
        try:
            rows.append((name, registry[name] is not None, None))
        except (KeyError, RuntimeError) as wrong:
            rows.append((name, False, type(wrong).__name__))
    return spark.createDataFrame(rows, "name string, built boolean, error string")
