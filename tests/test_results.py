import statistics

import pytest
from pyspark.sql import functions as F

from lanewise.operators import results, stats
from lanewise.sources import hardware
from lanewise.sources import results as files

HEADER = "array_size,median_ms,mean_ms,stddev_ms,min_ms,max_ms,p99_ms,gflops,simd_level"


def test_statistics(spark):
    rows = [(1, v) for v in (1.0, 2.0, 3.0, 10.0)] + [(2, 7.0), (3, 1.0), (3, 4.0), (3, 9.0), (4, None)]
    got = {r.g: r for r in stats.trial_statistics(spark.createDataFrame(rows, "g int, time_ms double"), ["g"]).collect()}
    assert got[1].median_ms == 2.5 and got[1].p99_ms == pytest.approx(9.79) and got[1].stddev_ms == pytest.approx(3.5355339059327378)
    assert (got[2].stddev_ms, got[2].median_ms, got[2].p99_ms, got[2].min_ms, got[2].max_ms) == (0, 7, 7, 7, 7)
    assert got[3].median_ms == 4 and got[3].stddev_ms == pytest.approx(statistics.pstdev([1, 4, 9]))
    assert got[4].median_ms is None


def test_result_rows_and_files(spark, tmp_path):
    trials = spark.createDataFrame([(n, "AVX2", t, n / 1e6 + t / 1e7) for n in (512, 1024) for t in range(10)], "array_size long, simd_level string, trial int, time_ms double")
    rows = stats.result_rows(trials)
    files.write_results(rows.withColumn("cpu", F.lit("some_cpu")), f"{tmp_path}/out")
    back = files.read_results(spark, f"{tmp_path}/out/*.csv:Mine").collect()
    assert sorted(r.array_size for r in back) == [512, 1024] and {r.label for r in back} == {"Mine"}
    for r in back:
        assert r.median_ms == pytest.approx(r.array_size / 1e6 + 4.5e-7, abs=1e-6)
    assert "512 elements" in "".join(r.line for r in files.report(rows).collect())


def test_strict_reading(spark, tmp_path):
    good = tmp_path / "results_a_b_avx2.csv"
    good.write_text("simd_level,extra,array_size,median_ms,mean_ms,stddev_ms,min_ms,max_ms,p99_ms,gflops\nAVX2,x,512,1,2,3,4,5,6,7\n")
    r = files.read_results(spark, str(good)).first()
    assert (r.array_size, r.median_ms, r.gflops, r.simd_level, r.label, r.input_pos) == (512, 1, 7, "AVX2", "A B (AVX2)", 0)
    (tmp_path / "less.csv").write_text(HEADER.replace("p99_ms,", "") + "\n512,1,2,3,4,5,7,AVX2\n")
    with pytest.raises(ValueError, match="p99_ms"):
        files.read_results(spark, str(tmp_path / "less.csv"))
    for bad in ("x", ""):
        (tmp_path / "bad.csv").write_text(HEADER + f"\n512,{bad},2,3,4,5,6,7,AVX2\n")
        with pytest.raises(Exception):
            files.read_results(spark, str(tmp_path / "bad.csv")).collect()
    with pytest.raises(Exception):
        files.read_results(spark, str(tmp_path / "none.csv")).collect()
    two = files.read_results(spark, str(good), f"{good}:A B (AVX2)")
    assert {x.input_pos for x in results.last_wins(two).collect()} == {1}


def test_each_file_by_its_own_header_and_level(spark, tmp_path):
    (tmp_path / "results_a_avx.csv").write_text("array_size,median_ms,mean_ms,stddev_ms,min_ms,max_ms,p99_ms,gflops,simd_level\n1,1,2,3,4,5,6,7,AVX\n2,1,2,3,4,5,6,7,SSE2\n")
    (tmp_path / "results_b d_sse2.csv").write_text("array_size,mean_ms,median_ms,stddev_ms,min_ms,max_ms,p99_ms,gflops,simd_level\r\n1,2,1,3,4,5,6,7,SSE2\r\n")
    got = files.read_results(spark, str(tmp_path / "*.csv")).orderBy("input_pos", "array_size").collect()
    assert [(r.median_ms, r.mean_ms, r.simd_level, r.label, r.input_pos) for r in got] == [(1, 2, "AVX", "A (AVX)", 0), (1, 2, "AVX", "A (AVX)", 0), (1, 2, "SSE2", "B D (SSE2)", 1)]
    (tmp_path / "results_c_avx.csv").write_text("")
    with pytest.raises(ValueError, match="results_c_avx"):
        files.read_results(spark, str(tmp_path / "*.csv"))


def test_snapshots_are_read_strictly(spark):
    df = spark.createDataFrame([(1, 7, 0, 0, 0, 0, "x")], "snap_id long, max_leaf long, l1_ecx long, l1_edx long, l7_ebx long, xcr0 long, level string")
    assert hardware.read_snapshots(df).columns == ["snap_id", *hardware.REGISTERS]
    with pytest.raises(ValueError, match="xcr0"):
        hardware.read_snapshots(df.drop("xcr0"))
    with pytest.raises(Exception):
        hardware.read_snapshots(df.withColumn("xcr0", F.lit(-1))).collect()


def test_detection_happens_once(spark, tmp_path):
    info = tmp_path / "info"
    info.write_text("flags : sse2 sse4_2\n")
    assert hardware.detected(spark, str(info)) == 2
    info.write_text("flags : sse2 xsave avx avx2 avx512f\n")
    assert hardware.detected(spark, str(info)) == 2 and hardware.detected(spark, str(tmp_path / "none")) == 0


def test_ranking(spark):
    df = spark.createDataFrame([("a", 1, 9.0, 1.0), ("a", 2, 3.0, 5.0), ("b", 2, 3.0, 5.0), ("c", 2, 1.0, 2.0)], "label string, array_size long, median_ms double, gflops double")
    assert [tuple(r) for r in results.ranked(df).orderBy("rank").collect()] == [(1, "c", 1.0), (2, "a", 3.0), (3, "b", 3.0)]
    assert [r.label for r in results.ranked(df, "gflops").orderBy("rank").collect()] == ["a", "b", "c"]
    assert results.axis_limit(df).first().max_size == 2
    assert results.ranked(df.limit(0)).count() == 0


def test_processor_model(spark, tmp_path):
    (tmp_path / "info").write_text("processor : 0\nmodel name\t: AMD EPYC 7452 32-Core Processor\nmodel name\t: other\n")
    assert files.cpu_model(spark, str(tmp_path / "info")).first().model == "AMD EPYC 7452 32-Core Processor"
    (tmp_path / "info2").write_text("processor : 0\n")
    assert files.cpu_model(spark, str(tmp_path / "info2")).first().model == "unknown_cpu"
