"""Grids of two dimensions, extrapolations, frames' operators and shapes, against small worked examples."""

import math

import pytest
from pyspark.sql import functions as F

from axisframe.frame import TYPED, TensorFrame, close, equal, ncat, tcat
from axisframe.functions import elementwise as E
from axisframe.functions import vector as V
from axisframe.operators import boundary as B
from axisframe.operators import generators as G
from axisframe.operators import grid as GR
from axisframe.operators import linalg as L
from axisframe.operators import lookup as K
from axisframe.operators import neighbors as N
from axisframe.operators import scan as SC
from axisframe.operators import sparse as SP
from axisframe.operators.reduce import select_quantile
from axisframe.shape import InvalidShapeSpec, Shape, after_gather, auto, batch, channel, dual, first_index, instance, mask, merge_shapes, pure_merge, shape_spec, shape_stack, spatial, to_spec, transposed, unstack_shape
from axisframe.sources import io as IO

NAN = float("nan")


def plane(spark, rows, **more):
    out = [(x, y, float(v), *[c[x][y] for c in more.values()]) for x, row in enumerate(rows) for y, v in enumerate(row)]
    return spark.createDataFrame(out, ["x", "y", "value", *more])


def square(df, value="value"):
    got = {(r.x, r.y): r[value] for r in df.collect()}
    return [[got[x, y] for y in range(3)] for x in range(3)]


def same(a, b):
    return all(p == q or (math.isnan(p) and math.isnan(q)) for r, s in zip(a, b, strict=True) for p, q in zip(r, s, strict=True))


def test_fills(spark):
    rows = [[NAN, NAN, NAN], [NAN, NAN, 4], [NAN, 2, NAN]]
    size = {"x": 3, "y": 3}
    assert same(square(GR.finite_fill(plane(spark, rows), size, [])), [[NAN, 4, 4], [2, 3, 4], [2, 2, 3]])
    assert same(square(GR.finite_fill(plane(spark, rows), size, [], distance=2, diagonal=False)), [[NAN, 3.5, 4], [2.5, 3, 4], [2, 2, 3]])
    valid = [[False] * 3, [False, False, True], [True, False, False]]
    got = GR.masked_fill(plane(spark, [[1, 0, 2], [0, 0, 4], [2, 0, 0]], valid=valid), size, [])
    assert square(got) == [[1, 4, 4], [2, 3, 4], [2, 3, 4]] and square(got, "valid") == [[False, True, True], [True] * 3, [True] * 3]


def test_paddings(spark):
    line = spark.createDataFrame([(i, v) for i, v in enumerate([1.0, 2.0, 4.0])], ["x", "value"])
    pad = lambda rule, low=2, high=2: [r.value for r in B.pad(line, "x", 3, low, high, rule).orderBy("x").collect()]
    assert pad(B.antisymmetric) == [-2, -1, 1, 2, 4, -4, -2] and pad(B.antireflect) == [-4, -2, 1, 2, 4, -2, -1]
    assert pad(B.symmetric_gradient) == [-2, 0, 1, 2, 4, 6, 7] and pad((B.periodic, 9.0)) == [2, 4, 1, 2, 4, 9, 9]
    assert pad(B.NONE) == [1, 2, 4] and pad(B.boundary, -1, 1) == [2, 4, 4] and pad(B.ONE, 1, 0) == [1, 1, 2, 4]
    both = spark.createDataFrame([(0, 1.0, 10.0), (1, 2.0, 20.0)], ["x", "u", "v"])
    got = [(r.u, r.v) for r in B.pad_directed(both, "x", 2, 1, 1, "u", (0.0, B.boundary), ["u", "v"]).orderBy("x").collect()]
    assert got == [(0, 10), (1, 10), (2, 20), (0, 20)]
    keyed = spark.createDataFrame([(k, i, float(10 * k + i)) for k in (1, 2) for i in (0, 1)], ["k", "x", "value"])
    holds = spark.createDataFrame([(1, True), (2, False)], ["k", "holds"])
    got = [(r.k, r.value) for r in B.pad_where(keyed, "x", 2, 1, 0, holds, B.boundary, 7.0, keys=["k"]).orderBy("k", "x").collect()]
    assert got == [(1, 10), (1, 10), (1, 11), (2, 7), (2, 20), (2, 21)]


def test_scatter_outside(spark):
    grid = G.ones(spark, x=3, y=2)
    put = lambda rows, how: {(r.x, r.y): r.value for r in K.scatter(grid.drop("value"), K.placed(spark.createDataFrame(rows, "x long, y long, v double, n int"), {"x": 3, "y": 2}, how), ["x", "y"], "v", "update", base=F.lit(1.0), order=["n"]).collect()}
    got = put([(-1, 0, 11.0, 0), (0, 2, 12.0, 1), (4, 3, 13.0, 2)], "clamp")
    assert [[got[x, y] for x in range(3)] for y in range(2)] == [[11, 1, 1], [12, 1, 13]]
    got = put([(-1, 0, 11.0, 0), (0, 1, 12.0, 1), (3, 1, 13.0, 2)], "discard")
    assert [[got[x, y] for x in range(3)] for y in range(2)] == [[1, 1, 1], [12, 1, 1]]


def test_frame_operators(spark):
    df = spark.createDataFrame([(0, 0, 7.0), (0, 1, -7.0), (1, 0, NAN), (1, 1, 2.5)], ["b", "i", "value"])
    t = TensorFrame(df, merge_shapes(batch(b=2), instance(i=2)))
    cells = lambda f: {(r.b, r.i): r.value for r in f.df.collect()}
    assert cells(t // 2)[0, 1] == -4 and cells(t % 4)[0, 1] == 1 and cells(round(t))[1, 1] == 2
    assert cells(t > 0) == {(0, 0): True, (0, 1): False, (1, 0): False, (1, 1): True} and cells(t != t)[1, 0] and not cells(t == t)[1, 0]
    assert cells((t > 0) ^ (t > 5)) == {(0, 0): False, (0, 1): False, (1, 0): False, (1, 1): True}
    arg = {r.b: r.i for r in t.argmin().df.collect()}
    assert arg[0] == 1 and {r.b: r.value for r in TYPED["isum"](t).df.collect()}[0] == 0.0
    assert [r.value for r in t[{"b": 0}].unstack("i")[1].df.collect()] == [-7.0]
    assert not equal(t, t) and equal(t, t, equal_nan=True) and close(t[{"b": 0}], t[{"b": 0}] + 1e-9) and not close(t[{"b": 0}], t[{"b": 0, "i": slice(0, 1)}])
    assert t.with_kind("i", "spatial").dims["i"].kind == "spatial" and t.expand(c=3).df.count() == 12 and t.slice_off(i=0).dims["i"].size == 1
    left, right = (TensorFrame(df.withColumnRenamed("value", n), t.dims, (n,)) for n in "uv")
    assert ncat([left, right], "vector").values == ("u", "v") and tcat([t, t], "instance").dims["tcat"].size == 4
    assert (t > 0).bool_to_int().dtype == "int" and t.components_to_rows("c").df.count() == 4
    with pytest.raises(ValueError):
        TensorFrame(df.withColumnRenamed("b", "p"), batch("p")) + TensorFrame(df.withColumnRenamed("b", "q"), batch("q"))  # an outer product of unknown sizes


def test_quantiles_and_scans(spark):
    df = spark.createDataFrame([(k, float(v)) for k, vs in {1: [1, 2, 3, 4], 2: [6, 7, 8, 9], 3: [5] * 9, 4: [1, 1e9, 1, 2, NAN]}.items() for v in vs], ["k", "value"])
    got = {r.k: round(r.value, 6) for r in select_quantile(df, ["k"], "value", 0.6).collect()}
    assert got == {1: 2.8, 2: 7.8, 3: 5, 4: 1.8}
    assert select_quantile(df, [], "value", 0.5, bins=3).first().value == 5
    assert select_quantile(df.limit(0), ["k"], "value", 0.5).count() == 0
    series = spark.range(50).select((F.col("id") % 2).alias("k"), F.floor(F.col("id") / 2).alias("i"), F.lit(1.0).alias("value"))
    got = SC.blocked_sum(series, ["k"], "i", ["value"], block=4).collect()
    assert len(got) == 50 and all(r.value == r.i + 1 for r in got)
    assert all(r.value == r.i for r in SC.blocked_sum(series, ["k"], "i", ["value"], include_0=True, block=4).collect())


def test_scalar_functions(spark):
    xs = [-30.0, -6.0, -3.5, -3.0, -2.9, -1.0, -1e-9, 0.0, 0.3, 2.0, 3.0, 5.0, 26.0, 800.0]
    df = spark.createDataFrame([(x,) for x in xs], ["x"])
    x = F.col("x")
    for r in df.select("x", E.erf(x).alias("e"), E.soft_plus(x).alias("s"), E.log_gamma(F.abs(x) + 0.5).alias("g")).collect():
        assert abs(r.e - math.erf(r.x)) < 1e-14
        assert abs(r.s - (max(r.x, 0) + math.log1p(math.exp(-abs(r.x))))) < 1e-12 * max(1, abs(r.x))
        assert abs(r.g - math.lgamma(abs(r.x) + 0.5)) < 1e-10 * max(1.0, abs(math.lgamma(abs(r.x) + 0.5)))
    n = spark.range(21).select("id", E.factorial(F.col("id")).alias("f"))
    assert all(r.f == float(math.factorial(r.id)) for r in n.collect())


def test_vectors_and_planes(spark):
    one = spark.range(1)
    lit = lambda *v: [F.lit(float(x)) for x in v]
    read = lambda cols: [round(v, 9) for v in one.select(*cols).first()]
    assert read(V.cross(lit(1, 0, 0), lit(0, 1, 0))) == [0, 0, 1] and read(V.cross(lit(1, 2), lit(3, 4))) == [-2]
    assert read(V.rotate(lit(1, 0), F.lit(math.pi / 2))) == [0, 1] and read(V.clip_length(lit(3, 4))) == [0.6, 0.8] and read(V.clip_length(lit(0, 0), 1.0)) == [0, 0]
    a = [F.lit(v) for v in (0.3, -0.8, 1.1)]
    back = V.rotate(V.rotate(lit(1, 2, 3), *a), *a, invert=True)
    assert read(back) == [1, 2, 3]
    df = spark.range(50).select((F.col("id") % 2).alias("k"), (F.col("id") % 7).cast("double").alias("a"), (F.col("id") % 5).cast("double").alias("b")).withColumn("y", 2 * F.col("a") - 3 * F.col("b") + 4 + F.col("k"))
    for r in L.fit_hyperplane(df, ["k"], ["a", "b"], "y").collect():
        assert [round(w, 9) for w in r.weights] == [2, -3] and round(r.intercept, 9) == 4 + r.k


def test_sparse(spark):
    coo = spark.createDataFrame([(0, 1, 2.0), (2, 0, 3.0), (2, 1, 4.0)], ["row", "col", "value"])
    assert SP.dense(coo, {"row": 3, "col": 2}).count() == 6 and SP.sparsity(coo, 6) == 0.5
    assert SP.same_pattern(coo, coo.withColumn("value", F.lit(1.0)), ["row", "col"]) and not SP.same_pattern(coo, SP.transpose(coo, "row", "col"), ["row", "col"])
    assert sorted(map(tuple, SP.from_compact(SP.to_compact(coo, "row", "col"), "row", "col").collect())) == sorted(map(tuple, coo.collect()))
    assert SP.tensor_like(coo, ["row", "col"], F.col("row") * 1.0).agg(F.sum("value")).first()[0] == 4
    wide = spark.createDataFrame([(1, 5.0, 6.0)], ["i", "a", "b"])
    assert sorted(map(tuple, SP.sparsified(wide, ["i"], ["a", "b"], "c").collect())) == [(1, 0, 5.0), (1, 1, 6.0)]


def test_periodic_join(spark):
    p = spark.createDataFrame([(0, 0.0), (1, 0.99)], ["id", "x"])
    got = sorted((r.l_id, r.r_id, round(r.distance, 6)) for r in N.range_join_periodic(p, p, "x", 0.1, 0.0, 1.0).collect())
    assert got == [(0, 0, 0), (0, 1, 0.01), (1, 0, 0.01), (1, 1, 0)]


def test_shapes():
    s = shape_spec("b:b=2,x:s=4,vector:c=(u,v)")
    assert shape_spec(to_spec(s)) == s and s["vector"].labels == ("u", "v")
    with pytest.raises(InvalidShapeSpec):
        shape_spec("x=4 garbage;;")
    assert auto("x,~y").kinds == ("channel", "dual") and mask(s, "x") == (False, True, False) and first_index(s) == {"b": 0, "x": 0, "vector": 0}
    assert after_gather(s, {"x": slice(1, None, 2), "b": 0, "none": 1}).sizes == (2, 2) and [u.names for u in unstack_shape(s, "b")] == [("x", "vector")] * 2
    assert shape_stack("n", "batch", s, s.with_size("x", 5))["x"].size is None and transposed(dual(a=3)).kinds == ("channel",)
    assert pure_merge(spatial(x=1), spatial(y=2)).names == ("x", "y") and Shape().volume == 1
    with pytest.raises(ValueError):
        pure_merge(spatial(x=1), channel(y=2))


def test_paths(spark):
    import posixpath

    paths = ["/a/b/../c", "a//b/./c", "../x/../y", "", "/", "/../a", "a/..", "a/b/"]
    df = spark.createDataFrame([(p,) for p in paths], ["p"])
    assert [r.n for r in df.select(IO.normalize_path(F.col("p")).alias("n")).collect()] == [posixpath.normpath(p) for p in paths]
    pairs = [("/a/b/c", "/a/d"), ("/a", "/a"), ("/a/b", "/"), ("/", "/a/b")]
    df = spark.createDataFrame(pairs, ["p", "s"])
    assert [r.n for r in df.select(IO.relative_path(F.col("p"), F.col("s")).alias("n")).collect()] == [posixpath.relpath(p, s) for p, s in pairs]
    df = spark.createDataFrame([("/usr/lib/x",), ("/usr/local/y",), ("/usr/lib64",)], ["p"])
    assert IO.common_prefix(df, "p").first()[0] == "/usr/l" and IO.common_path(df, "p").first()[0] == "/usr"


def test_dense_cells_and_odd_places(spark):
    a = spark.range(60).select("id", (F.col("id") % 4).cast("double").alias("x"))
    pairs = lambda **o: sorted((r.l_id, r.r_id) for r in N.range_join(a, a, ["x"], 1.0, **o).collect())
    assert pairs(cell_rows=3) == pairs() == sorted((i, j) for i in range(60) for j in range(60) if abs(i % 4 - j % 4) <= 1)
    points = spark.createDataFrame([(i, float(v)) for i, v in enumerate([0, 0, 0, 5, 5, 1000])] + [(9, None), (10, NAN)], ["p", "x"])
    queries = spark.createDataFrame([(0, -3.0), (1, 2.5), (2, 700.0), (3, None), (4, NAN)], ["q", "x"])
    assert {r.q: r.p for r in N.nearest_1d(points, queries, "x", "p", "q", buckets=4).collect()} == {0: 0, 1: 0, 2: 5, 3: None, 4: None}
