"""Selection of quantiles, tiled stencils, nearest points, radii, histograms, solvers and decompositions against brute force; null keys everywhere."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from axisframe.frame import TensorFrame
from axisframe.functions import elementwise as E
from axisframe.operators import boundary as B
from axisframe.operators import decompose as D
from axisframe.operators import grid as GR
from axisframe.operators import linalg as L
from axisframe.operators import lookup as K
from axisframe.operators import neighbors as N
from axisframe.operators import reduce as R
from axisframe.operators import sampling as S
from axisframe.operators import scan as SC
from axisframe.plans.iterate import Diverged, NotConverged, bicgstab
from axisframe.shape import batch, instance, merge_shapes

np = pytest.importorskip("numpy")
NAN, INF = float("nan"), float("inf")


def close(a, b):
    return (a is None and b is None) or (a is not None and b is not None and ((math.isnan(a) and math.isnan(b)) or a == pytest.approx(b, rel=1e-9, abs=1e-9)))


# --- null keys -------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def keyed(spark):
    """Series of the keys null and "a", and one under two nulls."""
    rows = [(k, j, i, float(10 * (k is None) + i)) for k, j in ((None, 1), ("a", 1), (None, None)) for i in range(6)]
    return spark.createDataFrame(rows, "k string, j int, i long, value double").repartition(3)


def test_null_keys_are_keys(keyed):
    keys = ["k", "j"]
    of = lambda df, *c: {(r.k, r.j, *(r[x] for x in c)) for r in df.collect()}
    every = {(None, 1), ("a", 1), (None, None)}
    got = of(S.random_permutation(keyed, keys, "i"), "permuted")
    assert got == {(*k, p) for k in every for p in range(6)}
    base = {k: 10 * (k[0] is None) for k in every}
    for options in ({"block": 2}, {"longest": 6}):
        got = of(SC.blocked_sum(keyed, keys, "i", ["value"], **options), "i", "value")
        assert got == {(*k, i, float(base[k] * (i + 1) + i * (i + 1) // 2)) for k in every for i in range(6)}
    assert of(R.select_quantile(keyed, keys, "value", 0.5), "value") == {(*k, base[k] + 2.5) for k in every}
    assert of(K.boolean_mask(keyed, "i", F.col("i") > 2, keys), "i") == {(*k, i) for k in every for i in range(3)}
    assert of(K.nonzero_slices(keyed, keys, "i", F.col("i").isin(0, 1, 4)), "start", "stop") == {(*k, a, b) for k in every for a, b in ((0, 2), (4, 5))}
    fit = L.fit_hyperplane(keyed.withColumn("x", F.col("i").cast("double")), keys, ["x"], "value").collect()
    assert {(r.k, r.j) for r in fit} == every and all(close(r.weights[0], 1.0) and close(r.intercept, base[r.k, r.j]) for r in fit)
    assert of(GR.neighbor_reduce(keyed, {"i": 6}, keys, F.max), "i", "value") == {(*k, i, float(base[k] + min(i + 1, 5))) for k in every for i in range(6)}
    counted = R.histogram_nd(keyed, keys, {"i": [0, 3, 5]}, fill=True)
    assert of(counted, "bin_i", "value") == {(*k, b, 3) for k in every for b in (0, 1)}
    for rule, low in ((7.0, 7.0), (B.boundary, None), (B.symmetric_gradient, None), ((B.periodic, 7.0), None)):
        padded = {(r.k, r.j, r.i): r.value for r in B.pad(keyed, "i", 6, 1, 1, rule, keys=keys).collect()}
        assert len(padded) == 24 and all(padded[*k, i + 1] == base[k] + i for k in every for i in range(6))
        assert low is None or all(padded[*k, 0] == low for k in every)
    holds = keyed.select(*keys).distinct().withColumn("holds", F.col("k").isNull())
    padded = {(r.k, r.j): r.value for r in B.pad_where(keyed, "i", 6, 1, 0, holds, B.boundary, 7.0, keys=keys).where("i = 0").collect()}
    assert padded == {k: (base[k] if k[0] is None else 7.0) for k in every}
    both = B.pad_directed(keyed.withColumn("w", F.col("value")), "i", 6, 1, 0, "w", (0.0, B.boundary), ["value", "w"], keys=keys)
    assert {(r.k, r.j, r.value, r.w) for r in both.where("i = 0").collect()} == {(*k, float(base[k]), 0.0) for k in every}
    t = TensorFrame(keyed, merge_shapes(batch("k,j"), instance(i=6)))
    shares = t / t.sum("i")
    assert shares.df.count() == 18 and close(shares.df.agg(F.sum("value")).first()[0], 3.0)


def test_series_without_keys_is_scanned_in_two_levels(spark):
    df = spark.range(500).select(F.col("id").alias("i"), F.lit(1).cast("long").alias("value"))
    assert all(r.value == r.i + 1 for r in SC.blocked_sum(df, [], "i", ["value"], block=4).collect())


# --- quantiles -------------------------------------------------------------------------------------


def test_quantiles_together_with_an_outlier(spark, monkeypatch):
    """10^5 values and one of 1e18: after a round, an interval holds no more than a thousandth or so of the values."""
    seen = []
    cut = R.cut

    def spy(df, name="cut"):
        out = cut(df, name)
        if name == "quantile-intervals":
            seen.append(out.where("__lo < __hi").agg(F.max("__c")).first()[0])
        return out

    monkeypatch.setattr(R, "cut", spy)
    values = np.random.default_rng(1).normal(0, 1, 100_000)
    df = spark.createDataFrame([(None, float(v)) for v in [*values, 1e18]], "k string, value double").repartition(4)
    qs = {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.999, "e": 1.0}
    got = R.select_quantiles(df, ["k"], "value", qs, small=500).collect()
    assert len(got) == 1 and got[0].k is None
    for name, q in qs.items():
        assert close(got[0][name], float(np.quantile([*values, 1e18], q))), name
    assert len(seen) >= 2 and max(seen[1:]) < 3000 and seen[-1] <= 500


def test_quantiles_of_odd_values(spark):
    groups = {1: [1.0, 2.0, 2.0, 2.0, 3.0], 2: [NAN, 5.0], 3: [NAN], 4: [-INF, 0.0, 1.0, INF], 5: [-1.7e308, 1.7e308, 0.0], 6: [5e-324, 1e-323, 0.0], None: [7.0]}
    df = spark.createDataFrame([(k, v) for k, vs in groups.items() for v in vs] + [(3, None)], "k int, value double")
    for small in (1 << 16, 1):
        got = {r.k: (r.a, r.b) for r in R.select_quantiles(df, ["k"], "value", {"a": 0.5, "b": 0.0}, bins=3, small=small).collect()}
        assert got[1] == (2, 1) and got[2] == (5, 5) and math.isnan(got[3][0]) and got[4] == (0.5, -INF) and got[5] == (0, -1.7e308) and got[6][1] == 0 and got[None] == (7, 7)
    with pytest.raises(ValueError):
        R.select_quantile(df, ["k"], "value", 1.5)


# --- stencils --------------------------------------------------------------------------------------


def grid_of(spark, shape, missing=(), seed=0):
    r = random.Random(seed)
    cells = {at: round(r.uniform(-9, 9), 2) for at in itertools.product(*map(range, shape)) if at not in missing}
    names = "xyz"[: len(shape)]
    return spark.createDataFrame([(None, *at, v) for at, v in cells.items()], "k string, " + ", ".join(f"{c} long" for c in names) + ", value double").repartition(3), cells, dict(zip(names, shape, strict=True))


RULES = {"boundary": (B.boundary, lambda i, n: min(max(i, 0), n - 1)), "periodic": (B.periodic, lambda i, n: i % n), "reflect": (B.reflect, lambda i, n: min(i % (2 * n - 2), 2 * n - 2 - i % (2 * n - 2))), "symmetric": (B.symmetric, lambda i, n: min(i % (2 * n), 2 * n - 1 - i % (2 * n)))}


@pytest.mark.parametrize("shape,tile", [((23,), 8), ((9, 7), 1 << 14), ((5, 4, 6), 16)])
def test_stencils_against_plain_python(spark, monkeypatch, shape, tile):
    monkeypatch.setattr(GR, "TILE_CELLS", tile)
    missing = {tuple(n // 2 for n in shape)}
    df, cells, sizes = grid_of(spark, shape, missing)
    near = lambda at, off: tuple(a + o for a, o in zip(at, off, strict=True))
    read = lambda out: {tuple(r[d] for d in sizes): r.value for r in out.collect()}
    got = read(GR.neighbor_sum(df, sizes, ["k"]))
    assert got.keys() == cells.keys() and all(close(got[at], sum(cells[p] for o in GR.box(len(shape)) if (p := near(at, o)) in cells)) for at in cells)
    offset = (2,) + (-1,) * (len(shape) - 1)
    for rule, index in RULES.values():
        got = {tuple(r[d] for d in sizes): r.value_0 for r in GR.index_shift(df, sizes, ["k"], [offset], rule=rule).collect()}
        want = {at: cells.get(tuple(index(i, n) for i, n in zip(near(at, offset), shape, strict=True))) for at in cells}
        assert got == want
    kernel = {o: float(sum(o) + 2) for o in GR.box(len(shape))}
    got = read(GR.convolve(df, sizes, ["k"], kernel, rule=1.5))
    assert all(close(got[at], sum(w * cells.get(near(at, o), 1.5) for o, w in kernel.items())) for at in cells)
    flipped = {tuple(r[d] for d in sizes): r.value_0 for r in GR.index_shift(df, sizes, ["k"], [(-1,) + (0,) * (len(shape) - 1)], rule=B.antisymmetric).collect()}
    assert all(flipped[at] == (-cells[at] if at[0] == 0 else cells.get((at[0] - 1, *at[1:]))) for at in cells)


def test_neighbor_by_any_predicate(spark):
    df, cells, sizes = grid_of(spark, (6, 5), seed=4)
    got = {(r.x, r.y): r.value for r in GR.at_neighbor_where(df.withColumn("by", -F.col("value")), sizes, ["k"], "value", "by", lambda own, other: other > own + 1).collect()}
    for (x, y), v in cells.items():
        picked = [cells[p] for dx, dy in GR.box(2) if (p := (x + dx, y + dy)) in cells and -cells[p] > -v + 1]
        assert got[x, y] == (picked[0] if picked else None)


def test_only_border_cells_are_copied(spark):
    """A million cells: rows dealt into tiles for a stencil of nine cells."""
    sizes = {"x": 1000, "y": 1000}
    df = spark.range(1_000_000).select(F.floor(F.col("id") / 1000).alias("x"), (F.col("id") % 1000).alias("y"), F.lit(1.0).alias("value"))
    assert GR.dealt(df, sizes, 1, [], ["value"], None, GR.tile_side(sizes, 1)).count() < 1.1 * 1_000_000
    sums = GR.neighbor_sum(df, sizes, []).groupBy("value").count().collect()
    assert {r.value: r["count"] for r in sums} == {9.0: 998 * 998, 6.0: 4 * 998, 4.0: 4}


# --- nearest points and radii ----------------------------------------------------------------------


@pytest.mark.parametrize("dims", [1, 2, 4])
def test_nearest_against_all_pairs(spark, dims):
    """Clusters, a far point, empty cells, repeated places, ties by the smaller id, queries outside and without a place."""
    r = random.Random(dims)
    names = list("abcd"[:dims])
    points = [(i, *[round(r.gauss(0, 0.01), 3) for _ in names]) for i in range(150)] + [(500 + i, *[r.uniform(-3, 3) for _ in names]) for i in range(80)]
    points += [(900, *[40.0] * dims), (901, *[-1.0] * dims), (902, *[1.0] * dims), (7, *[40.0] * dims), (903, None, *[0.0] * (dims - 1)), (904, NAN, *[0.0] * (dims - 1))]
    asked = [(i, *[r.uniform(-4, 4) for _ in names]) for i in range(120)] + [(200, *[0.0] * dims), (201, *[39.0] * dims), (202, *[1e6] * dims), (203, *[-1e6] * dims), (204, *[20.0] * dims)]
    schema = lambda n: f"{n} long, " + ", ".join(f"{c} double" for c in names)
    p, q = spark.createDataFrame(points, schema("p")), spark.createDataFrame([*asked, (205, None, *[0.0] * (dims - 1)), (206, INF, *[0.0] * (dims - 1))], schema("q"))
    got = {x.q: (x.p, x.distance) for x in N.nearest(p, q, names, "p", "q", leaf_points=8).collect()}
    assert len(got) == 127 and got[205] == got[206] == (None, None)
    real = [x for x in points if x[1] is not None and not math.isnan(x[1])]
    for i, *at in asked:
        d, best = min((math.sqrt(sum((u - v) ** 2 for u, v in zip(at, x[1:], strict=True))), x[0]) for x in real)
        assert close(got[i][1], d) and (got[i][0] == best or close(d, math.dist(at, next(x[1:] for x in real if x[0] == got[i][0])))), i
    assert got[201][0] == 7  # of equal places the smaller id


def test_nearest_without_points_and_plan(spark):
    p, q = spark.createDataFrame([], "p long, x double, y double"), spark.createDataFrame([(1, 0.0, 0.0)], "q long, x double, y double")
    assert [tuple(r) for r in N.nearest(p, q, ["x", "y"], "p", "q").collect()] == [(1, None, None)]
    one = spark.createDataFrame([(5, 1.0, 1.0)], "p long, x double, y double")
    out = N.nearest(one, q, ["x", "y"], "p", "q")
    assert [(r.p, round(r.distance, 6)) for r in out.collect()] == [(5, 1.414214)]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_radii_against_all_pairs(spark):
    r = random.Random(9)
    rows = [(i, r.uniform(-50, 50), r.uniform(0, 10), r.choice([0.0, 0.3, 1.0, 2.5, 30.0])) for i in range(150)] + [(150, 0.0, 0.0, 0.0), (151, 0.0, 10.0, 1e-9), (152, 1.0, 1.0, None), (153, 1.0, 1.0, NAN), (154, None, 1.0, 5.0), (155, 1.0, 1.0, -1.0)]
    df = spark.createDataFrame(rows, "id long, x double, y double, radius double")
    got = {(t.l_id, t.r_id): t.distance for t in N.range_join_radii(df, df, ["x", "y"], "radius", {"y": (0.0, 10.0)}).collect()}
    want = {}
    for a, b in itertools.product((x for x in rows if x[1] is not None), repeat=2):
        if a[3] is not None and a[3] >= 0:
            dy = abs(a[2] - b[2]) % 10
            d = math.hypot(a[1] - b[1], min(dy, 10 - dy))
            if d <= a[3]:
                want[a[0], b[0]] = d
    assert got.keys() == want.keys() and all(close(got[k], want[k]) for k in want) and len(want) > 200
    flat = {(t.l_id, t.r_id) for t in N.range_join_radii(df, df, ["x"], "radius").collect()}
    assert flat == {(a[0], b[0]) for a, b in itertools.product((x for x in rows if x[1] is not None), repeat=2) if a[3] is not None and a[3] >= 0 and abs(a[1] - b[1]) <= a[3]}


# --- histograms ------------------------------------------------------------------------------------


def test_histogram_against_numpy(spark):
    r = random.Random(3)
    rows = [(r.uniform(-2, 12), r.choice([0.0, 1.0, 2.5, 4.0, 7.0]), r.uniform(0, 1)) for _ in range(400)] + [(NAN, 1.0, 1.0), (1.0, None, 1.0), (10.0, 4.0, 0.25), (0.0, 0.0, None)]
    df = spark.createDataFrame(rows, "x double, y double, w double")
    edges = {"x": [0, 1, 1.5, 4, 10], "y": [0, 1, 2.5, 4]}
    whole = np.array([t for t in rows if None not in t and not math.isnan(t[0])])
    want = np.histogramdd(whole[:, :2], bins=[np.array(e, float) for e in edges.values()], weights=whole[:, 2])[0]
    got = R.histogram_nd(df, [], edges, "w", fill=True).collect()
    assert len(got) == 12 and all(close(t.value, want[t.bin_x, t.bin_y]) for t in got)
    one = {t.bin_x: t.value for t in R.histogram_nd(df, [], {"x": [0, 5, 10]}).collect()}
    assert one == {0: sum(0 <= t[0] < 5 for t in rows), 1: sum(5 <= t[0] <= 10 for t in rows)}
    with pytest.raises(ValueError):
        R.bin_of(F.col("x"), [1, 1])


# --- solvers and decompositions --------------------------------------------------------------------


def test_bicgstab_nonsymmetric_batches(spark):
    rng = np.random.default_rng(5)
    n = 6
    systems = {None: rng.normal(0, 1, (n, n)) + 6 * np.eye(n), "b": rng.normal(0, 1, (n, n)) + 8 * np.eye(n), "zero": np.eye(n)}
    y = {k: rng.normal(0, 10, n) * (k != "zero") for k in systems}
    a = spark.createDataFrame([(k, i, j, float(m[i, j])) for k, m in systems.items() for i in range(n) for j in range(n)], "k string, row long, col long, value double")
    b = spark.createDataFrame([(k, i, float(v[i])) for k, v in y.items() for i in range(n)], "k string, row long, y double")
    got = {(r.k, r.row): r.x for r in bicgstab(a, b, "row", "col", batch=["k"], tolerance=1e-11).collect()}
    for k, m in systems.items():
        assert np.allclose([got[k, i] for i in range(n)], np.linalg.solve(m, y[k]), atol=1e-7)
    shared = {(r.k, r.row): r.x for r in bicgstab(a.where("k = 'b'").drop("k"), b, "row", "col", batch=["k"], tolerance=1e-11).collect()}
    assert np.allclose([shared[None, i] for i in range(n)], np.linalg.solve(systems["b"], y[None]), atol=1e-7)


def test_bicgstab_says_when_it_fails(spark):
    hard = spark.createDataFrame([(0, 1, 1.0), (1, 2, 1.0), (2, 0, 1.0)], "row long, col long, value double")
    y = spark.createDataFrame([(0, 1.0), (1, 2.0), (2, -3.0)], "row long, y double")
    with pytest.raises(NotConverged):
        bicgstab(hard, y, "row", "col", max_steps=1)
    singular = spark.createDataFrame([(0, 0, 1.0), (0, 1, 1.0), (1, 0, 1.0), (1, 1, 1.0)], "row long, col long, value double")
    with pytest.raises(NotConverged):  # no solution: broken down, diverged or out of steps
        bicgstab(singular, y.where("row < 2"), "row", "col", max_steps=6)
    assert issubclass(Diverged, NotConverged)


@pytest.mark.parametrize("rows,columns", [(60, 5), (3, 7), (40, 1)])
def test_svd_against_numpy(spark, rows, columns):
    a = np.random.default_rng(rows).normal(0, 1, (rows, columns))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(a)] + [(None, None)], "id long, x array<double>").repartition(20)
    out = D.svd(df, "id", "x")
    s = np.linalg.svd(a, compute_uv=False)
    assert np.allclose(out.values, s)
    left = {r.id: r.left for r in out.left.collect()}
    u = np.array([left[i] for i in range(rows)])
    assert len(left) == rows and np.allclose(u * out.values @ out.right.T, a) and np.allclose(u.T @ u, np.eye(len(s)))


def test_svd_of_odd_matrices(spark):
    make = lambda rows: spark.createDataFrame(rows, "id long, x array<double>")
    low = D.svd(make([(i, [float(i), 2.0 * i, 0.0]) for i in range(9)]), "id", "x")
    assert low.values[0] == pytest.approx(math.sqrt(5 * sum(i * i for i in range(9)))) and np.allclose(low.values[1:], 0)
    assert len(D.svd(make([]), "id", "x").values) == 0
    for bad in ([(1, [1.0]), (2, [1.0, 2.0])], [(1, [NAN])], [(1, [None])]):
        with pytest.raises(ValueError):
            D.svd(make(bad), "id", "x")


# --- frames and scalars ----------------------------------------------------------------------------


def test_reflected_and_whole_operators(spark):
    df = spark.createDataFrame([(0, 4.0), (1, 0.0), (2, -3.0)], "i long, value double")
    t = TensorFrame(df, instance(i=3))
    values = lambda f: [r.value for r in f.df.orderBy("i").collect()]
    assert values(1.0 - t) == [-3, 1, 4] and values(2 * t) == [8, 0, -6] and values(1 + t) == [5, 1, -2] and values(8 / t) == [2, INF, -8 / 3]
    assert values(2**t) == [16, 1, 0.125] and values(7 // t)[::2] == [1, -3] and values(7 % t)[::2] == [3, -2] and math.isnan(values(7 % t)[1])
    assert values(t // 0.0)[0] == INF and math.isnan(values(t // 0.0)[1]) and math.isnan(values(t % 0.0)[0]) and values(t // 2) == [2, 0, -2] and values(t % -2) == [0, 0, -1]
    whole = t.cast("bigint")
    assert values(whole // 2) == [2, 0, -2] and values(whole % -2) == [0, 0, -1] and values(whole // 0) == [None] * 3 and values(1 << whole)[:2] == [16, 1]
    big = TensorFrame(spark.createDataFrame([(0, 2**60 + 9)], "i long, value long"), instance(i=1))
    assert values(big // 8) == [2**57 + 1] and values(big % 8) == [1]
    nan = TensorFrame(spark.createDataFrame([(0, 1.0), (1, NAN), (2, 3.0)], "i long, value double"), instance(i=3))
    assert nan.argmax().df.first().i == 1 and nan.argmin().df.first().i == 1 and t.argmax().df.first().i == 0 and t.argmin().df.first().i == 2
    assert {"a": 0.0, "b": -3.0} == t.quantile({"a": 0.5, "b": 0.0}).df.first().asDict()


def test_indices_beyond_doubles(spark):
    at = K.unravel(F.col("i"), ["a", "b"], [1 << 58, 8])
    assert tuple(spark.createDataFrame([(2**60 + 9,)], "i long").select(at["a"], at["b"]).first()) == (2**57 + 1, 1)


def test_log_gamma_everywhere(spark):
    xs = [-0.5, -1.5, -2.25, -10.75, 0.25, 0.5, 3.0, 100.0]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in xs], "x double").select(E.log_gamma(F.col("x"))).collect()]
    assert all(close(g, math.lgamma(x)) for g, x in zip(got, xs, strict=True))
    odd = [r[0] for r in spark.createDataFrame([(0.0,), (-3.0,), (INF,), (-INF,), (NAN,)], "x double").select(E.log_gamma(F.col("x"))).collect()]
    assert odd[:4] == [INF] * 4 and math.isnan(odd[4])


def test_ranks_and_softmax_of_groups_over_all_tasks(spark, keyed):
    from axisframe.operators import window as W

    got = {(r.k, r.j, r.i): r.rank for r in SC.sorted_rank(keyed, ["k", "j"], [F.desc("value")]).collect()}
    assert got == {(k, j, i): 5 - i for k, j in ((None, 1), ("a", 1), (None, None)) for i in range(6)}
    many = spark.range(5000).select(F.lit(None).cast("string").alias("k"), ((F.col("id") * 7919) % 5000).alias("v"))
    assert all(r.rank == r.v for r in SC.sorted_rank(many, ["k"], [F.col("v")]).collect())
    soft = W.softmax(keyed, ["k", "j"], "value", "share").collect()
    total = sum(math.exp(i) for i in range(6))
    assert len(soft) == 18 and all(close(r.share, math.exp(r.i) / total) for r in soft)


def test_full_rows_are_several_arrays(spark):
    coo = spark.createDataFrame([(0, c, float(c)) for c in range(50)] + [(1, 3, 1.0)], "row long, col long, value double")
    csr = L.to_csr(coo, "row", "col", "value", width=16)
    assert {(r.row, r.block, len(r.entries)) for r in csr.collect()} == {(0, 0, 16), (0, 1, 16), (0, 2, 16), (0, 3, 2), (1, 0, 1)}
    assert sorted(map(tuple, L.from_csr(csr, "row", "col", "value").collect())) == sorted(map(tuple, coo.collect()))
    a, b = coo.withColumnsRenamed({"value": "a", "col": "m"}), coo.withColumnsRenamed({"value": "b", "row": "m"})
    assert L.products(a, b, "m") == 51  # index 0: one entry by the 50 of row 0; index 1: one by one; index 3 meets nothing below row 2
    with pytest.raises(ValueError):
        L.matmul(a, b, "row", "m", "col", most_products=10)


def test_components_are_read_alone(spark, tmp_path):
    from axisframe.sources import io as IO

    t = TensorFrame(spark.createDataFrame([(0, 1.0, 2.0)], "i long, u double, v double"), instance(i=1), ("u", "v"))
    IO.save(t, str(tmp_path / "f"))
    back = IO.load(spark, str(tmp_path / "f"), ["v"])
    assert back.values == ("v",) and back.df.columns == ["i", "v"] and back.dims == t.dims
    with pytest.raises(ValueError):
        IO.load(spark, str(tmp_path / "f"), ["w"])



@pytest.mark.parametrize("kind", ["frequent", "both", "rare"])
def test_shared_elements_by_bits_and_joins(spark, kind):
    """Frequent elements as bits, in words, and the others joined; repeated rows and nulls."""
    from axisframe.operators import sampling as S

    r = random.Random(3)
    common = [(i, e) for i in range(40) for e in range(-70, 0) if r.random() < 0.7] if kind != "rare" else []
    rare = [(r.randrange(40), r.randrange(1, 200)) for _ in range(150)] if kind != "frequent" else []
    rows = [*common, *rare, *common[:9], *rare[:9], (None, 1), (3, None), (77, 999)]
    held = {}
    for i, e in rows:
        if i is not None and e is not None:
            held.setdefault(i, set()).add(e)
    want = {(a, b): n for a in held for b in held if a != b and (n := len(held[a] & held[b]))}
    out = S.count_intersections(spark.createDataFrame(rows, "i long, e long"), "i", "e")
    got = out.collect()
    assert len(got) == len(want) and {(x.a, x.b): x.n for x in got} == want
    if kind == "frequent":  # a pair is counted where it is made
        assert "bit_count" in out._jdf.queryExecution().analyzed().toString()



def test_probed_cells_are_not_broadcast(spark):
    """The copies of a small table in the cells that are probed outgrow the driver, whatever Spark estimates."""
    p = spark.range(50).select("id", F.col("id").cast("double").alias("x"), F.lit(1.0).alias("y"), F.lit(2.0).alias("radius"))
    for out in (N.range_join(p, p, ["x", "y"], 5.0), N.range_join_radii(p, p, ["x", "y"], "radius"), N.range_join_periodic(p, p, "x", 5.0, 0.0, 50.0)):
        assert "BroadcastHashJoin" not in out._jdf.queryExecution().executedPlan().toString()



def test_nearest_on_a_line_with_rounded_ties(spark):
    """0.30000000000000004 and 0.3 apart are as near to six decimals, so the smaller id wins; many points may tie."""
    p = spark.createDataFrame([(3, 1.1), (1, 1.7), (5, 1.1000001), (0, 1.7000002), (8, 50.0), (9, -50.0)], "p long, x double")
    q = spark.createDataFrame([(0, 1.4), (1, 0.0), (2, 60.0), (3, None), (4, 1.7)], "q long, x double")
    got = {r.q: (r.p, r.distance) for r in N.nearest_1d(p, q, "x", "p", "q", digits=6).collect()}
    assert {k: v[0] for k, v in got.items()} == {0: 0, 1: 3, 2: 8, 3: None, 4: 0} and close(got[0][1], 0.3000002) and got[2][1] == 10.0



def test_null_is_not_known_to_be_nan(spark):
    from axisframe.functions import elementwise as E

    df = spark.createDataFrame([(0, None), (1, NAN), (2, 1.0)], "i long, v double")
    assert [r.n for r in df.orderBy("i").select(E.is_nan(F.col("v")).alias("n")).collect()] == [None, True, False]


@pytest.mark.parametrize("region_points", [8, 10**6])
def test_nearest_far_outside_on_a_lattice(spark, region_points):
    """Places far outside see many boxes at about one distance: none is written but the places and their answers; ties go by id over regions."""
    r = random.Random(5)
    points = [(i, 900.0 + i % 10, 20.0 * r.randrange(20), 5.0 * r.randrange(40)) for i in range(600)]
    asked = [(i, r.choice([-2000.0, 100.0, 4000.0, 905.5]), 10.0 * r.randrange(50), 2.5 * r.randrange(90)) for i in range(300)]
    p, q = spark.createDataFrame(points, "p long, x double, y double, z double"), spark.createDataFrame(asked, "q long, x double, y double, z double")
    out = N.nearest(p, q, ["x", "y", "z"], "p", "q", region_points=region_points)
    want = {i: min((math.sqrt((u[0] - v[1]) ** 2 + (u[1] - v[2]) ** 2 + (u[2] - v[3]) ** 2), v[0]) for v in points) for i, *u in asked}
    assert {x.q: (x.distance, x.p) for x in out.collect()} == want


def test_most_boxes_are_not_searched():
    from axisframe.operators._boxes import Tree

    at = np.random.default_rng(2).uniform(0, 100, (4000, 3))
    far = np.array([[-900.0, 50.0, 50.0], [50.0, 2000.0, 40.0], [50.0, 50.0, 50.0]])
    tree, seen = Tree(at, 16), []
    own, tree._closer = tree._closer, lambda here, who, leaf, *more: (seen.append(len(leaf)), own(here, who, leaf, *more))[1]
    d, i = tree.nearest(far, np.full(3, np.inf))
    all_pairs = np.sqrt(((far[:, None] - at) ** 2).sum(2))
    assert i.tolist() == all_pairs.argmin(1).tolist() and np.allclose(d, all_pairs.min(1)) and sum(seen) < 100


@pytest.mark.parametrize("part", [3, 1024])
def test_products_are_dealt_in_ranges(spark, monkeypatch, part):
    """Frequent inner indices as several arrays, null ones without products, null rows as rows; products are made after ranges are dealt."""
    from axisframe.operators import linalg as L

    monkeypatch.setattr(L, "PART_ENTRIES", part)
    r = random.Random(4)
    left = [(r.randrange(9), r.choice([0, 0, 0, 1, 2, 3]), float(r.randrange(5))) for _ in range(60)] + [(5, None, 1.0), (None, 1, 2.0)]
    right = [(r.choice([0, 0, 1, 3, 8]), r.randrange(7), float(r.randrange(5))) for _ in range(50)] + [(None, 5, 1.0)]
    want = {}
    for (i, k, u), (m, j, v) in itertools.product(left, right):
        if k is not None and k == m:
            want[i, j] = want.get((i, j), 0.0) + u * v
    out = L.matmul(spark.createDataFrame(left, "r long, k long, a double"), spark.createDataFrame(right, "k long, c long, b double"), "r", "k", "c")
    assert {(x.r, x.c): x.value for x in out.collect()} == want
    assert "rangepartitioning" in out._jdf.queryExecution().executedPlan().toString()


def test_products_are_summed_where_they_are_made(spark):
    """Products of two matrices are never shuffled; text, null and NaN are indices like others, and far ones meet."""
    r = random.Random(8)
    left = [(i, r.randrange(40), float(r.randint(-3, 3))) for i in (*range(60), None, 10**12) for _ in range(9)] + [(5, None, 1.0)]
    right = [(r.randrange(40), c, float(r.randint(-3, 3))) for c in ("a", "b", "", None, *map(str, range(30))) for _ in range(9)] + [(None, "a", 1.0)]
    want = {}
    for i, k, v in left:
        for m, j, w in right:
            if k is not None and k == m:
                want[i, j] = want.get((i, j), 0.0) + v * w
    out = L.matmul(spark.createDataFrame(left, "r long, k long, a double"), spark.createDataFrame(right, "k long, c string, b double"), "r", "k", "c")
    assert {(x.r, x.c): x.value for x in out.collect()} == want and out.count() == len(want)
    above = out._jdf.queryExecution().executedPlan().toString().split("Exchange")[0]
    assert above.count("Generate posexplode") == 2


def test_items_with_equal_elements_go_as_lists(spark):
    """Few kinds of items, some very frequent: each pair once, in as many tasks as there are partitions."""
    from axisframe.operators import sampling as S

    kinds = [{69}, set(range(0, 70, 2)), {1, 3}, set(range(70))]
    held = {i: kinds[min(i % 97, 3)] for i in range(700)}
    out = S.count_intersections(spark.createDataFrame([(i, e) for i, es in held.items() for e in es], "i long, e long"), "i", "e")
    got = out.collect()
    assert len(got) == len(want := {(a, b): n for a in held for b in held if a != b and (n := len(held[a] & held[b]))})
    assert {(x.a, x.b): x.n for x in got} == want
    assert out.rdd.getNumPartitions() >= int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_cells_without_rows_are_not_probed(spark):
    """Rows on far lines are copied along their lines only; no pair is lost, also where sides have different types."""
    r = random.Random(9)
    rows = [(i, r.randrange(-400, 400) / 4, 10.0 * r.randrange(-3, 4)) for i in range(300)] + [(300, None, 1.0)]
    left = spark.createDataFrame(rows, "id long, x double, y double")
    right = left.select("id", F.col("x").cast("decimal(10,2)").alias("x"), F.col("y").cast("long").alias("y"))
    want = {(i, j) for i, x, y in rows[:-1] for j, u, v in rows[:-1] if math.hypot(x - u, y - v) <= 5}
    assert {(p.l_id, p.r_id) for p in N.range_join(left, right, ["x", "y"], 5).collect()} == want
    assert N._probing(N._cells(left, ["x", "y"], 5.0), N._cells(left, ["x", "y"], 5.0), ["__c0", "__c1"]).where("x is not null").count() <= 3 * 300 + 9


def test_small_products_are_summed_before_their_shuffle(spark):
    left = spark.range(4000).selectExpr("id % 3 AS r", "id AS k", "1.0D AS a")
    out = L.matmul(left, left.selectExpr("k", "r AS c", "2.0D AS b"), "r", "k", "c")
    assert sorted((x.r, x.c, x.value) for x in out.collect()) == [(0, 0, 2668.0), (1, 1, 2666.0), (2, 2, 2666.0)]
    assert "Generate" not in out._jdf.queryExecution().executedPlan().toString().split("Exchange")[0]
