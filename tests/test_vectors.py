import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lanewise.functions.vectors import OPERATIONS, create_sql_functions, elementwise, row_op, vector_mul_f32
from lanewise.operators import kernels, verify
from lanewise.sources import generated
from lanewise.streaming import kernels as streams

LENGTHS = (0, 1, 3, 4, 5, 7, 8, 9, 15, 16, 17, 31, 32, 33)
NUMPY = {"vector_add_f32": np.add, "vector_sub_f32": np.subtract, "vector_mul_f32": np.multiply}
SPECIAL = [float("nan"), float("inf"), float("-inf"), -0.0, 0.0, 1.4e-45, 3.4e38, 16777217.0, 0.1, 1 / 3, -5.5]
PAIR = "a array<float>, b array<float>"


def bits(values):
    return np.array(values, np.float32).view(np.uint32)


def same(got, want):
    got, want = np.array(got, np.float32), np.array(want, np.float32)
    assert got.shape == want.shape
    nan = np.isnan(want)
    assert (np.isnan(got) == nan).all()
    assert (got.view(np.uint32)[~nan] == want.view(np.uint32)[~nan]).all()


@pytest.mark.parametrize("name", OPERATIONS)
def test_lengths_and_special_values(spark, name):
    rng = np.random.default_rng(3)
    rows = [(rng.standard_normal(n).astype(np.float32), rng.standard_normal(n).astype(np.float32)) for n in LENGTHS]
    rows.append((np.repeat(SPECIAL, len(SPECIAL)).astype(np.float32), np.tile(SPECIAL, len(SPECIAL)).astype(np.float32)))
    df = spark.createDataFrame([(i, a.tolist(), b.tolist()) for i, (a, b) in enumerate(rows)], "i int, " + PAIR)
    out = kernels.over_arrays(df, name)
    assert dict(out.dtypes)["out"] == "array<float>"
    with np.errstate(all="ignore"):
        for r in out.collect():
            same(r.out, NUMPY[name](*rows[r.i]))
        back = {}
        for r in kernels.over_rows(kernels.exploded(df, "i"), name).collect():
            back.setdefault(r.i, {})[r.idx] = r.out
        for i, (a, b) in enumerate(rows):
            same([v for _, v in sorted(back.get(i, {}).items())], NUMPY[name](a, b))


def test_nulls_prefixes_and_unequal_lengths(spark):
    df = spark.createDataFrame([(None, [1.0]), ([1.0, None], [2.0, 3.0]), ([], [])], PAIR)
    assert [r[0] for r in df.select(vector_mul_f32("a", "b")).collect()] == [None, [2.0, None], []]
    unequal = spark.createDataFrame([([1.0, 2.0, 3.0], [4.0, 5.0])], PAIR)
    assert unequal.select(vector_mul_f32("a", "b", 2)).first()[0] == [4.0, 10.0]
    assert unequal.select(vector_mul_f32("a", "b", 0)).first()[0] == []
    for bad in (vector_mul_f32("a", "b"), vector_mul_f32("a", "b", 3)):
        with pytest.raises(Exception, match="unequal length"):
            unequal.select(bad).collect()


def test_single_precision_of_rows(spark):
    df = spark.createDataFrame([(16777217.0, 0.1)], "a double, b double")
    out = df.select(row_op("vector_mul_f32", "a", "b").alias("x"))
    assert out.dtypes == [("x", "float")]
    assert bits([out.first().x])[0] == bits([np.float32(16777217.0) * np.float32(0.1)])[0]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.floats(width=32), st.floats(width=32)), max_size=40))
def test_properties(spark, pairs):
    a, b = [x for x, _ in pairs], [y for _, y in pairs]
    df = spark.createDataFrame([(a, b)], PAIR)
    op = {n: lambda x, y, f=f: elementwise(f, x, y) for n, f in OPERATIONS.items()}
    one, zero = (F.array_repeat(F.lit(v).cast("float"), F.size("a")) for v in (1.0, -0.0))
    r = df.select(op["vector_add_f32"]("a", "b"), op["vector_add_f32"]("b", "a"), op["vector_mul_f32"]("a", "b"), op["vector_mul_f32"]("b", "a"), op["vector_mul_f32"](F.col("a"), one), op["vector_add_f32"](F.col("a"), zero)).first()
    same(r[0], r[1])
    same(r[2], r[3])
    same(r[4], a)
    same(r[5], a)


def test_sql_functions_inline(spark):
    create_sql_functions(spark)
    spark.createDataFrame([([1.0, 2.0], [3.0, 4.0])], PAIR).createOrReplaceTempView("pairs")
    df = spark.sql("SELECT vector_sub_f32(a, b) AS d, vector_mul_f32(a, b) AS m FROM pairs")
    assert tuple(df.first()) == ([-2.0, -2.0], [3.0, 8.0])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "zip_with" in plan and "Python" not in plan


def test_generated_and_verified(spark):
    out = kernels.over_rows(generated.benchmark_input(spark, 100_000), "vector_mul_f32")
    assert verify.exact_mismatches(out, "vector_mul_f32").count() == 0
    assert verify.tolerance_failures(out, "vector_mul_f32").first().failures == 0
    wrong = out.withColumn("out", F.when(F.col("idx") == 3, float("nan")).when(F.col("idx") == 5, None).when(F.col("idx") == 7, 0.0).otherwise(F.col("out")).cast("float"))
    assert sorted(r.idx for r in verify.exact_mismatches(wrong, "vector_mul_f32").collect()) == [3, 5, 7]
    assert verify.tolerance_failures(wrong, "vector_mul_f32").first().failures == 3
    unit = kernels.over_rows(generated.unit_input(spark), "vector_add_f32").collect()
    assert [r.out for r in unit] == [2 * i + 1 for i in range(16)]


def test_pairing_by_key(spark):
    left = spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0]), (None, [1.0])], "k int, a array<float>")
    right = spark.createDataFrame([(1, [5.0, 6.0]), (3, [3.0]), (None, [1.0])], "k int, b array<float>")
    assert [tuple(r) for r in kernels.paired(left, right, ["k"], "vector_add_f32").collect()] == [(1, [6.0, 8.0])]
    assert kernels.paired(left.limit(0), right, ["k"], "vector_add_f32").count() == 0


def test_stream(spark, tmp_path):
    rows = [(i, [float(i)] * 3, [2.0] * 3) for i in range(10)]
    schema = "id int, a array<float>, b array<float>"
    spark.createDataFrame(rows[:6], schema).write.parquet(f"{tmp_path}/in", mode="append")
    for more in ([], rows[6:]):
        if more:
            spark.createDataFrame(more, schema).write.parquet(f"{tmp_path}/in", mode="append")
        stream = streams.applied(streams.read_vectors(spark, f"{tmp_path}/in", schema), "vector_mul_f32")
        streams.write_vectors(stream, f"{tmp_path}/out", f"{tmp_path}/at").awaitTermination(60)
    got = {r.id: r.out for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {i: [2.0 * i] * 3 for i in range(10)}


def test_agreement_and_missing(spark):
    df = spark.createDataFrame([(t, i, 4) for t in range(8) for i in range(100)], "thread_id int, iteration int, level int")
    assert tuple(verify.agreement(df).first()) == (800, 1, True)
    assert tuple(verify.agreement(df.union(spark.createDataFrame([(9, 0, None)], df.schema))).first()) == (801, 2, False)
    assert tuple(verify.agreement(df.limit(0)).first()) == (0, 0, True)
    assert [r.level for r in verify.missing(spark.createDataFrame([(1,), (2,)], "level int"), df.select(F.lit(2).alias("level")), "level").collect()] == [1]
