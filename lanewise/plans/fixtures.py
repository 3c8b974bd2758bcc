"""Small literal inputs of the registered queries."""

from __future__ import annotations

import itertools

# Processor names and result files whose slugs and labels are known.
CPU_NAMES = ("AMD Ryzen 9 9950X3D 16-Core Processor", "AMD EPYC 7452 32-Core Processor", "Intel(R) Core(TM) i9-13900K", "Intel(R) Xeon(R) CPU E5-2690 0 @ 2.90GHz")
RESULT_FILES = (
    "results_amd_ryzen_9_9950x3d_avx_512f.csv", "simd_levels_amd_ryzen_9_9950x3d_avx2.csv", "results_intel_xeon_x5560_sse4_2.csv", "results_intel_xeon_gold_6426y_avx_512f.csv", "foo_bar.csv", "results_avx2.csv", "results_amd_x_avx2_old.csv",
)
#: label, input_pos, array_size, median_ms, gflops: two data sets share a label.
RESULTS = (
    ("a", 0, 512, 0.00002, 25.6), ("a", 0, 4096, 0.0003, 13.65), ("b", 1, 512, 0.00001, 51.2), ("b", 1, 4096, 0.0002, 20.48), ("a", 2, 512, 0.00003, 17.06), ("a", 2, 4096, 0.0004, 10.24), ("c", 3, 512, 0.00002, 25.6), ("c", 3, 4096, 0.0002, 20.48),
)
#: cpu, simd_level, array_size, median_ms, mean_ms, stddev_ms, min_ms, max_ms, p99_ms, gflops
MEASURED = tuple(
    (cpu, level, size, size * k / 2**20, size * k / 2**19, k / 8, size * k / 2**21, size * k / 2**18, size * k / 2**18, round(k * 12.34567, 4))
    for cpu, level, k in ((CPU_NAMES[0], "AVX-512F", 1), (CPU_NAMES[0], "AVX2", 2), (CPU_NAMES[1], "SSE4.2", 3), (None, "Scalar", 5)) for size in (512, 4096, 1048576)
)
#: Result files: name, header in its own order, rows; the second file swaps columns, has one more, and changes its level after its first row.
FILES = (
    ("results_a_x_avx2.csv", "array_size,median_ms,mean_ms,stddev_ms,min_ms,max_ms,p99_ms,gflops,simd_level", ("512,1,2,0.5,0.25,4,3.5,7.25,AVX2", "1024,2,3,0.5,1.25,5,4.5,8.25,AVX2")),
    ("results_b_x_sse2.csv", "simd_level,note,mean_ms,median_ms,array_size,gflops,p99_ms,max_ms,min_ms,stddev_ms", ('SSE2,"a, b",20,10,512,1.5,35,40,2.5,5', "Scalar,x,30,20,1024,2.5,45,50,12.5,5")),
    ("results_c_x_avx.csv", "array_size,median_ms,mean_ms,stddev_ms,min_ms,max_ms,p99_ms,gflops,simd_level", ("512,100,200,50,25,400,350,0.75,AVX",)),
)
#: What read_results makes of them as a glob and then the third again under another label: array_size, times, gflops, simd_level, label, input_pos.
FILES_READ = (
    (512, 1.0, 2.0, 0.5, 0.25, 4.0, 3.5, 7.25, "AVX2", "A X (AVX2)", 0), (1024, 2.0, 3.0, 0.5, 1.25, 5.0, 4.5, 8.25, "AVX2", "A X (AVX2)", 0),
    (512, 10.0, 20.0, 5.0, 2.5, 40.0, 35.0, 1.5, "SSE2", "B X (SSE2)", 1), (1024, 20.0, 30.0, 5.0, 12.5, 50.0, 45.0, 2.5, "SSE2", "B X (SSE2)", 1),
    (512, 100.0, 200.0, 50.0, 25.0, 400.0, 350.0, 0.75, "AVX", "C X (AVX)", 2), (512, 100.0, 200.0, 50.0, 25.0, 400.0, 350.0, 0.75, "AVX", "A X (AVX2)", 3),
)
#: A hardware description.
DESCRIPTION = "processor\t: 0\nmodel name\t: AMD EPYC 7452 32-Core Processor\nflags\t\t: fpu sse sse2 ssse3 sse4_1 sse4_2 xsave avx avx2\n\nprocessor\t: 1\nmodel name\t: other\nflags\t\t: fpu\n"
#: array_size, trial, time_ms
TRIALS = ((4, 0, 1.0), (4, 1, 2.0), (4, 2, 3.0), (4, 3, 10.0), (1, 0, 7.5), (3, 0, 2.0), (3, 1, 8.0), (3, 2, 5.0))

_SSE2, _SSE42, _OSXSAVE, _AVX, _AVX2, _AVX512F = 1 << 26, 1 << 20, 1 << 27, 1 << 28, 1 << 5, 1 << 16


def snapshots() -> list[tuple[int, ...]]:
    """(snap_id, max_leaf, l1_ecx, l1_edx, l7_ebx, xcr0): the whole truth table of the classification."""
    rows = []
    for i, (sse2, sse42, osx, avx, avx2, avx512, xcr0, leaf) in enumerate(itertools.product((0, 1), (0, 1), (0, 1), (0, 1), (0, 1), (0, 1), (0, 0x6, 0xE0, 0xE6), (0, 7))):
        rows.append((i, leaf, sse42 * _SSE42 | osx * _OSXSAVE | avx * _AVX, sse2 * _SSE2, avx2 * _AVX2 | avx512 * _AVX512F, xcr0))
    return rows


def values(rows: object) -> str:
    """Rows as the list of a SQL VALUES clause."""
    cell = lambda x: "NULL" if x is None else "'" + x.replace("'", "''") + "'" if isinstance(x, str) else f"{x!r}::DOUBLE" if isinstance(x, float) else str(x)
    return ", ".join("(" + ", ".join(map(cell, r)) + ")" for r in rows)
