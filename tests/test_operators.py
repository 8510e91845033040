import math

import pytest
from pyspark.sql import functions as F

from axisframe.frame import TensorFrame, concat, stack
from axisframe.functions import elementwise as E
from axisframe.operators import boundary as B
from axisframe.operators import linalg as L
from axisframe.operators import lookup as K
from axisframe.operators import neighbors as N
from axisframe.operators import reduce as R
from axisframe.operators import window as W
from axisframe.plans.iterate import conjugate_gradient
from axisframe.shape import batch, merge_shapes, spatial
from axisframe.sources import io as IO

NAN, INF = float("nan"), float("inf")


def column(spark, values, f):
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "i long, value double")
    return [r[0] for r in df.select(f(F.col("value")).alias("r"), "i").orderBy("i").collect()]


def same(a, b):
    return len(a) == len(b) and all((math.isnan(x) and math.isnan(y)) or x == pytest.approx(y) for x, y in zip(a, b, strict=True))


def series(spark, values, key=0):
    return spark.createDataFrame([(key, i, float(v)) for i, v in enumerate(values)], "b long, i long, value double")


def along(df, c):
    return [r[0] for r in df.select(c.alias("r"), "i").orderBy("i").collect()]


def test_finite_reductions(spark):
    df = spark.createDataFrame([(v,) for v in (0.0, 1.0, -1.0, -INF, INF, NAN)], "v double")
    r = df.agg(R.finite_min(F.col("v")), R.finite_max(F.col("v")), R.finite_sum(F.col("v"))).first()
    assert tuple(r) == (-1.0, 1.0, 0.0)
    none = df.where("v > 5").agg(R.finite_min(F.col("v"), 0.0), R.finite_mean(F.col("v"))).first()
    assert none[0] == 0.0 and math.isnan(none[1])


def test_ieee_edges(spark):
    assert same(column(spark, [1, -1, 0], lambda x: E.divide(x, F.lit(0.0))), [INF, -INF, NAN])
    assert same(column(spark, [0, -1, 1, NAN], E.log), [-INF, NAN, 0, NAN])
    assert same(column(spark, [0.5, 1.5, 2.5, -0.5], E.round_even), [0, 2, 2, 0])
    assert same(column(spark, [NAN, 1], lambda x: E.minimum(x, F.lit(2.0))), [NAN, 1])
    assert same(column(spark, [-1, 0.5, 3, NAN], E.clip), [0, 0.5, 1, NAN])
    assert same(column(spark, [2, 1], lambda x: E.safe_div(x, x - 1)), [2, 0])
    assert column(spark, [NAN], lambda x: E.equal(x, x)) == [False]
    assert same(column(spark, [0.5], E.erf), [math.erf(0.5)]) and same(column(spark, [5], E.log_gamma), [math.log(24)])


def test_min_takes_nan(spark):
    t = TensorFrame(spark.createDataFrame([(0, 1.0), (0, NAN), (1, 2.0)], "b long, value double"), batch("b"))
    assert same([r.value for r in t.min().df.orderBy("b").collect()], [NAN, 2.0])


def test_scans(spark):
    df = series(spark, [1, 2, 3])
    assert along(df, W.cumulative_sum("value", ["b"], ["i"])) == [1, 3, 6]
    assert along(df, W.cumulative_sum("value", ["b"], ["i"], include_0=True)) == [0, 1, 3]
    assert along(df, W.gradient(F.col("value"), ["b"], ["i"])) == [0.5, 1, 0.5]
    assert along(df, W.shift(F.col("value"), ["b"], ["i"], 2)) == [3, 3, 3]
    assert along(df, W.shift(F.col("value"), ["b"], ["i"], -2, "zero")) == [0, 0, 1]
    assert along(df, W.convolve(F.col("value"), ["b"], ["i"], [1, 0, -1])) == [-2, -2, 2]


def test_finite_fill(spark):
    df = series(spark, [1, NAN, NAN, NAN, 5])
    assert same(along(df, W.finite_fill(F.col("value"), ["b"], ["i"])), [1, 1, NAN, 5, 5])


@pytest.mark.parametrize(("rule", "want"), [(B.symmetric, [2, 1, 0, 0, 1, 2, 3, 3, 2, 1, 0]), (B.reflect, [3, 2, 1, 0, 1, 2, 3, 2, 1, 0, 1]), (B.periodic, [1, 2, 3, 0, 1, 2, 3, 0, 1, 2, 3]), (B.boundary, [0, 0, 0, 0, 1, 2, 3, 3, 3, 3, 3])])
def test_extrapolations(spark, rule, want):
    df = spark.createDataFrame([(i, float(i)) for i in range(4)], "x long, value double")
    assert [int(r.value) for r in B.pad(df, "x", 4, 3, 4, rule).orderBy("x").collect()] == want


@pytest.mark.parametrize(("mode", "want"), [("max", [-INF, 3, 2]), ("min", [INF, 1, 2]), ("add", [0, 4, 2])])
def test_scatter_defaults(spark, mode, want):
    grid = spark.range(3).withColumnRenamed("id", "x")
    entries = spark.createDataFrame([(1, 1.0), (2, 2.0), (1, 3.0)], "x long, v double")
    assert [r.value for r in K.scatter(grid, entries, ["x"], "v", mode).orderBy("x").collect()] == want


def test_scatter_base_and_update(spark):
    grid = spark.createDataFrame([(i, 1.0) for i in range(4)], "x long, base double")
    entries = spark.createDataFrame([(1, 11.0, 0), (2, 12.0, 1), (2, 13.0, 2)], "x long, v double, o int")
    get = lambda **o: [r.value for r in K.scatter(grid, entries, ["x"], "v", base=F.col("base"), **o).orderBy("x").collect()]
    assert get(mode="update", order=["o"]) == [1, 11, 13, 1]
    assert get(mode="add") == [1, 12, 26, 1]


def test_histogram_counts(spark):
    df = spark.createDataFrame([(v,) for v in (0.0, 0.11, 0.11, 0.21, 0.11, 0.21, 0.31, 0.51)], "v double")
    assert [r.n for r in R.histogram(df, "v", 0.0, 0.51, 10).orderBy("bin").collect()] == [1, 0, 3, 0, 2, 0, 1, 0, 0, 1]


def test_range_join_keeps_the_border(spark):
    p = spark.createDataFrame([(0, 0.0, 0.0), (1, 1.0, 0.0), (2, 900.0, 1.0)], "id long, x double, y double")
    for d in (1.1, 1.0):
        assert {(r.l_id, r.r_id) for r in N.range_join(p, p, ["x", "y"], d).collect()} == {(0, 0), (0, 1), (1, 0), (1, 1), (2, 2)}


def test_nearest_1d_ties_and_ends(spark):
    points = spark.createDataFrame([(1, 0.0), (2, 10.0), (0, 10.0)], "p long, x double")
    queries = spark.createDataFrame([(7, -5.0), (8, 5.0), (9, 99.0), (10, 10.0)], "q long, x double")
    got = {r.q: (r.p, r.distance) for r in N.nearest_1d(points, queries, "x", "p", "q").collect()}
    assert got == {7: (1, 5.0), 8: (0, 5.0), 9: (0, 89.0), 10: (0, 0.0)}


def test_sparse_product_and_csr(spark):
    a = spark.createDataFrame([(0, 0, 1.0), (0, 1, 2.0), (1, 0, 3.0)], "r long, k long, a double")
    b = spark.createDataFrame([(0, 0, -1.0), (0, 1, 1.0), (1, 0, 5.0)], "k long, c long, b double")
    assert {(r.r, r.c): r.value for r in L.matmul(a, b, "r", "k", "c").collect()} == {(0, 0): 9, (0, 1): 1, (1, 0): -3, (1, 1): 3}
    back = L.from_csr(L.to_csr(a, "r", "k", "a"), "r", "k", "a")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, a.collect()))


def test_conjugate_gradient_laplace(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    a = spark.createDataFrame([(i, j, -2.0 if i == j else 1.0) for i in range(3) for j in range(3) if abs(i - j) < 2], "row long, col long, value double")
    y = spark.createDataFrame([(i, 1.0) for i in range(3)], "row long, y double")
    assert same([r.x for r in conjugate_gradient(a, y, "row", "col").orderBy("row").collect()], [-1.5, -2.0, -1.5])


def test_stack_concat_slice(spark):
    t = TensorFrame(spark.createDataFrame([(i, float(i)) for i in range(3)], "x long, value double"), spatial(x=3))
    assert stack({"a": t, "b": t}, "s").df.count() == 6
    c = concat([t, t], "x")
    assert c.dims["x"].size == 6 and [r.value for r in c[{"x": slice(1, None, 2)}].df.orderBy("x").collect()] == [1, 0, 2]
    assert c[{"nothing": 0}].df.count() == 6 and c[{"x": -1}].df.first().value == 2


def test_alignment_rejects_other_components(spark):
    df = spark.createDataFrame([(0, 1.0, 2.0)], "x long, a double, b double")
    with pytest.raises(ValueError):
        TensorFrame(df, spatial("x"), ("a", "b")) + TensorFrame(df.withColumnRenamed("b", "c"), spatial("x"), ("a", "c"))


def test_save_and_load_keep_the_shape(spark, tmp_path):
    t = TensorFrame(spark.createDataFrame([(0, 1, 2.0)], "b long, x long, value double"), merge_shapes(batch(b=1), spatial(x=4)))
    IO.save(t, str(tmp_path / "f"))
    back = IO.load(spark, str(tmp_path / "f"))
    assert back.dims == t.dims and back.df.collect() == t.df.collect()


def test_paths(spark):
    df = spark.createDataFrame([("/a/b/c.txt",), ("c",)], "p string")
    rows = df.select(IO.basename(F.col("p")), IO.dirname(F.col("p")), *IO.splitext(F.col("p")), IO.join_path(F.lit("x"), F.col("p"))).collect()
    assert tuple(rows[0]) == ("c.txt", "/a/b", "/a/b/c", ".txt", "x/a/b/c.txt")
    assert tuple(rows[1]) == ("c", "", "c", "", "x/c")


def test_masks(spark):
    df = series(spark, [1, 0, 2, 3, 0])
    assert [(r.i, r.value) for r in K.boolean_mask(df, "i", F.col("value") > 0, ["b"]).orderBy("i").collect()] == [(0, 1), (1, 2), (2, 3)]
    assert {(r.start, r.stop) for r in K.nonzero_slices(df, ["b"], "i", F.col("value") > 0).collect()} == {(0, 1), (2, 4)}
