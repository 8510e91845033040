"""Queries over the driver's tables for families of small functions: scalars, types, structure, generators, patterns, paths, stored frames."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from axisframe.frame import TensorFrame, align, close, concat, equal, tcat
from axisframe.functions import elementwise as E
from axisframe.functions import vector as V
from axisframe.operators import boundary as B
from axisframe.operators import generators as G
from axisframe.operators import grid as GR
from axisframe.operators import linalg as L
from axisframe.operators import losses as LO
from axisframe.operators import sparse as SP
from axisframe.plans.lineage import shared_folder
from axisframe.queries import _BAL, _MATRIX, _PLANE, _SIZES, _balances, _customers, _line_matrix, _lineitem, _nations, _plane, _r, _rounded, _t, query
from axisframe.shape import Dim, Shape, after_gather, auto, batch, channel, concat_shapes, concat_shapes_, dual, first_index, instance, kind_size, mask, merge_shapes, non_batch, non_channel, non_dual, non_instance, non_primal, non_spatial, primal, pure_merge, shape_spec, shape_stack, spatial, split_top_level_comma, to_spec, transposed, unstack_shape
from axisframe.sources import io as IO

# --- scalar functions ------------------------------------------------------------------------------


@query(
    "WITH c AS (SELECT c_custkey, c_acctbal / 10001 AS u FROM customer) SELECT c_custkey, round(asin(u), 6) AS arcsin, round(acos(u), 6) AS arccos, round(tan(u), 6) AS tan, round(sinh(u), 6) AS sinh, round(cosh(u), 6) AS cosh, "
    "round(acosh(1 + abs(u)), 6) AS arccosh, round(atanh(u), 6) AS arctanh, round(log10(1 + abs(u)), 6) AS log10, round(degrees(u), 5) AS degrees, round(radians(u), 6) AS radians, round(ln(1 + exp(u)), 6) AS soft_plus, round(ln(1 + abs(u)), 6) AS log1p FROM c"
)
def inverse_and_hyperbolic(s, d):
    u = F.col("c_acctbal") / 10001
    p = E.PLAIN
    cols = {
        "arcsin": p["arcsin"](u), "arccos": p["arccos"](u), "tan": p["tan"](u), "sinh": p["sinh"](u), "cosh": p["cosh"](u), "arccosh": p["arccosh"](1 + F.abs(u)), "arctanh": p["arctanh"](u), "log10": E.log10(1 + F.abs(u)),
        "radians": E.radians(u), "soft_plus": E.soft_plus(u), "log1p": E.log1p(F.abs(u)),
    }
    return _t(s, d, "customer").select("c_custkey", *[_r(c, 6).alias(n) for n, c in cols.items()], _r(E.degrees(u), 5).alias("degrees"))


@query(
    "WITH e AS (SELECT event_id, value, CASE event_id % 5 WHEN 0 THEN 'nan'::DOUBLE WHEN 1 THEN 'inf'::DOUBLE ELSE value END AS v, CASE WHEN event_id % 5 <> 2 THEN value END AS w FROM events) "
    "SELECT event_id, isnan(v) AS nan, isinf(v) AS inf, isfinite(v) AS finite, w IS NULL AS none, CASE WHEN isnan(v) THEN 0 ELSE v END AS zeroed, CASE WHEN isnan(v) THEN v ELSE least(v, 20) END AS low, CASE WHEN isnan(v) THEN v ELSE greatest(v, 20) END AS high, "
    "v = value AND NOT isnan(v) AS same, abs(v - value) <= 0.001 * abs(value) AND NOT isnan(v) AS near, value * 2 AS twice, value AS itself FROM e"
)
def tests_of_numbers(s, d):
    value, k = F.col("value"), F.col("event_id") % 5
    v = F.when(k == 0, F.lit(float("nan"))).when(k == 1, F.lit(float("inf"))).otherwise(value)
    e = _t(s, d, "events").select("event_id", F.col("value").cast("double").alias("value"), v.alias("v"), F.when(k != 2, value).alias("w"))
    v, x = F.col("v"), F.lit(20.0)
    out = {"nan": E.is_nan(v), "inf": E.is_inf(v), "finite": E.is_finite(v), "none": E.is_none(F.col("w")), "zeroed": E.nan_to_0(v), "low": E.minimum(v, x), "high": E.maximum(v, x), "same": E.equal(v, value), "near": E.close(v, value, 0.001), "twice": E.safe_mul(value, F.lit(2.0)), "itself": E.identity(value)}
    return e.select("event_id", *[c.alias(n) for n, c in out.items()])


@query(
    "SELECT o_orderkey, CAST(o_custkey AS DOUBLE) AS as_float, CAST(trunc(o_totalprice) AS INTEGER) AS as_int32, CAST(trunc(o_totalprice) AS BIGINT) AS as_int64, CAST(o_custkey AS DOUBLE) AS same_a, o_totalprice AS same_b, CASE WHEN o_totalprice > 100000 THEN 1 ELSE 0 END AS from_bool, 'double' AS kind FROM orders"
)
def casts_and_types(s, d):
    o = _t(s, d, "orders")
    t = TensorFrame(o.select("o_orderkey", F.col("o_totalprice").alias("value")), instance("o_orderkey"))
    a, b = E.cast_same(F.col("o_custkey"), F.col("o_totalprice"))
    flags = (t > 100000).bool_to_int(32).df.withColumnRenamed("value", "from_bool")
    whole = t.cast("bigint").df.withColumnRenamed("value", "as_int64")
    out = o.select("o_orderkey", E.to_float(F.col("o_custkey")).alias("as_float"), E.to_int32(F.col("o_totalprice")).alias("as_int32"), a.alias("same_a"), b.alias("same_b"), F.lit(t.dtype).alias("kind"))
    return out.join(flags, "o_orderkey").join(whole, "o_orderkey")


@query("SELECT l_orderkey, l_linenumber, CAST(factorial(l_linenumber) AS DOUBLE) AS factorial, CAST(l_linenumber AS BIGINT) AS whole, l_quantity * 2 AS twice FROM lineitem")
def factorials_and_maps(s, d):
    """Factorials, int64 casts, and a function mapped over a frame's components."""
    n = F.col("l_linenumber")
    li = _t(s, d, "lineitem").select("l_orderkey", "l_linenumber", E.factorial(n).alias("factorial"), E.to_int64(n).alias("whole"), F.col("l_quantity").alias("twice"))
    return TensorFrame(li, instance("l_orderkey,l_linenumber"), ("twice",)).map(lambda c: E.safe_mul(E.identity(c), F.lit(2.0))).df


@query(
    "WITH v AS (SELECT vec_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z, sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS n, embedding[4]::DOUBLE AS last FROM embeddings) "
    "SELECT vec_id, round(x + y + 5, 5) + 0.0 AS total, round(x / n, 6) + 0.0 AS unit, round(last / n, 6) + 0.0 AS unit_4, round(x * x, 6) AS square, round(sqrt(x * x + y * y), 6) AS length, round(cos(z) * cos(y), 6) AS m00, round(-sin(y), 6) + 0.0 AS m20, round(cos(y) * sin(x), 6) + 0.0 AS m21 FROM v"
)
def vectors_and_matrices(s, d):
    x, y, z = (F.get("embedding", i).cast("double") for i in range(3))
    v, five, unit, m = V.vec(x=x, y=y), V.const_vec(5.0, "x"), L.normalize(F.col("embedding")), V.rotation_matrix(x, y, z)
    out = _t(s, d, "embeddings").select("vec_id", (v["x"] + v["y"] + five["x"]).alias("total"), F.get(unit, 0).alias("unit"), F.get(unit, 3).alias("unit_4"), E.PLAIN["square"](x).alias("square"), V.length([x, y]).alias("length"), m[0][0].alias("m00"), m[2][0].alias("m20"), m[2][1].alias("m21"))
    return _rounded(_rounded(out, "total", n=5), "unit", "unit_4", "square", "length", "m00", "m20", "m21", n=6)


@query(
    "SELECT CAST(c_nationkey AS BIGINT) AS nation, round(sum(abs(c_acctbal)), 2) AS l1, round(0.5 * sum(c_acctbal * c_acctbal), 0) AS l2, round(sum(c_acctbal * 100 / s), 4) + 0.0 AS scaled FROM customer JOIN (SELECT c_nationkey AS k, sum(c_acctbal) AS s FROM customer GROUP BY 1) ON k = c_nationkey GROUP BY 1"
)
def losses(s, d):
    """Losses of each nation's balances, and the balances brought to a sum of 100."""
    t = _customers(s, d)
    parts = [_rounded(LO.l1_loss(t).df, "value", n=2).withColumnRenamed("value", "l1"), _rounded(LO.l2_loss(t).df, "value", n=0).withColumnRenamed("value", "l2"), _rounded(LO.normalize_to(t, 100.0).sum().df, "value").withColumnRenamed("value", "scaled")]
    return reduce(lambda a, b: a.join(b, "nation"), parts)


# --- generators ------------------------------------------------------------------------------------


@query(
    "WITH n AS (SELECT count(*) AS n FROM customer) SELECT range AS x, 0.0::DOUBLE AS zero, 1.0::DOUBLE AS one, 3 * range + 2 AS index, range + 5 AS batch_range, range AS spatial_range FROM range((SELECT n FROM n))"
)
def zeros_ones_ranges(s, d):
    """Grids of as many cells as there are customers."""
    n = _t(s, d, "customer").count()
    named = lambda df, name: df.select("x", F.col("value").alias(name))
    parts = [named(G.zeros(s, x=n), "zero"), named(G.ones(s, x=n), "one"), named(G.range_tensor(s, x=n, y=3).where("y = 2"), "index"), named(G.kind_range(s, "batch", 5, x=n + 5).df, "batch_range"), named(G.kind_range(s, "spatial", x=n).df, "spatial_range")]
    return reduce(lambda a, b: a.join(b, "x"), parts)


@query(
    "WITH n AS (SELECT count(*) AS n FROM supplier) SELECT range AS x, range + 1 AS instances, range + 2 AS channels, range + 3 AS duals, 'instance,channel,dual' AS kinds FROM range((SELECT n FROM n))"
)
def ranges_by_kind(s, d):
    n = _t(s, d, "supplier").count()
    frames = [G.kind_range(s, kind, k, **{"x": n + k}) for k, kind in ((1, "instance"), (2, "channel"), (3, "dual"))]
    out = [t.df.toDF("x", name) for t, name in zip(frames, ("instances", "channels", "duals"), strict=True)]
    return reduce(lambda a, b: a.join(b, "x"), out).withColumn("kinds", F.lit(",".join(t.dims.kinds[0] for t in frames)))


@query("SELECT l_returnflag, true AS inside, true AS centred, true AS spread, 0.0::DOUBLE AS zero, 1.0::DOUBLE AS one, count(*) AS n FROM lineitem GROUP BY 1")
def random_draws(s, d):
    """Draws beside each line item: bounds and moments; zeros and ones like the table's columns."""
    df = G.random_normal(G.random_uniform(_t(s, d, "lineitem").select("l_returnflag", "l_quantity", "l_discount"), "u", 2.0, 5.0, seed=1), "z", seed=2)
    df = G.ones_like(G.zeros_like(df, ["l_quantity"]), ["l_discount"])
    n, u, z = F.count("*"), F.col("u"), F.col("z")
    wide = 6 / F.sqrt(n)  # six standard errors
    return df.groupBy("l_returnflag").agg(
        F.bool_and((u >= 2) & (u < 5)).alias("inside"), ((F.abs(F.avg(u) - 3.5) < wide) & (F.abs(F.avg(z)) < wide)).alias("centred"), (F.abs(F.stddev_pop(z) - 1) < wide).alias("spread"), F.max("l_quantity").alias("zero"), F.min("l_discount").alias("one"), n.alias("n")
    )


# --- structure of frames ---------------------------------------------------------------------------


@query(
    "SELECT l_orderkey * 8 + l_linenumber AS packed, l_quantity AS value, 'spatial' AS kind FROM lineitem UNION ALL SELECT l_orderkey * 8 + l_linenumber, l_quantity, 'instance' FROM lineitem UNION ALL "
    "SELECT l_orderkey * 8 + l_linenumber, l_quantity, 'channel' FROM lineitem UNION ALL SELECT l_orderkey * 8 + l_linenumber, l_quantity, 'dual' FROM lineitem"
)
def packs_by_kind(s, d):
    df = _t(s, d, "lineitem").select(F.col("l_orderkey").cast("long").alias("order"), F.col("l_linenumber").cast("long").alias("line"), F.col("l_quantity").alias("value"))
    t = TensorFrame(df, merge_shapes(instance("order"), instance(line=8)))
    packed = [t.pack(["order", "line"], "packed", kind) for kind in ("spatial", "instance", "channel")] + [t.pack(["order", "line"], "packed").with_kind("packed", "dual")]
    return reduce(DataFrame.unionByName, [x.df.toDF("packed", "value").withColumn("kind", F.lit(x.dims.kinds[0])) for x in packed])


@query(
    "SELECT CAST(c_nationkey AS BIGINT) AS land, round(sum(c_acctbal), 2) AS value, 'renamed' AS what FROM customer GROUP BY 1 UNION ALL SELECT -1, round(sum(c_acctbal), 2), 'squeezed' FROM customer WHERE c_nationkey = 3 UNION ALL SELECT 7, round(sum(c_acctbal), 2), 'unstacked' FROM customer WHERE c_nationkey = 7 "
    "UNION ALL SELECT CAST(c_nationkey AS BIGINT) + 25 * (r.range), round(sum(c_acctbal), 2), 'behind' FROM customer, range(2) r GROUP BY c_nationkey, r.range UNION ALL SELECT CAST(c_nationkey AS BIGINT), round(sum(c_acctbal), 2), 'swapped' FROM customer GROUP BY 1"
)
def frames_restructured(s, d):
    """Renamed, squeezed, unstacked, behind each other by kind, and with axes swapped."""
    t = _nations(s, d, "customer", "c_nationkey", "c_acctbal")
    say = lambda f, what, at: f.map(lambda c: _r(c, 2)).df.select(at.cast("long").alias("land"), "value", F.lit(what).alias("what"))
    square = t.expand(copy=1).swap_axes("nation", "copy").squeeze("copy")
    parts = [say(t.rename({"nation": "land"}), "renamed", F.col("land")), say(t[{"nation": slice(3, 4)}].squeeze("nation"), "squeezed", F.lit(-1)), say(t.unstack("nation")[7], "unstacked", F.lit(7)), say(tcat([t, t], "batch"), "behind", F.col("tcat")), say(square, "swapped", F.col("nation"))]
    return reduce(DataFrame.unionByName, parts)


@query(
    "SELECT CAST(n_nationkey AS BIGINT) AS nation, true AS close, false AS far, true AS equal, false AS unequal, true AS nan_equal, false AS other_shape FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer)"
)
def closeness_of_frames(s, d):
    """Frames compared as wholes; the answers beside the nations of the customers."""
    t = _nations(s, d, "customer", "c_nationkey", "c_acctbal")
    nan = t.map(lambda c: c * float("nan"))
    got = {"close": close(t, t * (1 + 1e-9)), "far": close(t, t * 1.01), "equal": equal(t, t), "unequal": equal(t, t * 2), "nan_equal": equal(nan, nan, equal_nan=True), "other_shape": close(t, t[{"nation": slice(0, 5)}])}
    return t.df.select("nation", *[F.lit(v).alias(n) for n, v in got.items()])


@query(
    "WITH n AS (SELECT count(*) AS n, (SELECT count(*) FROM region) AS r FROM nation), k AS (SELECT n, r, n * r * 2 AS v FROM n) "
    "SELECT n_nationkey, 'b:b=' || n || ',region:i=' || r || ',vector:c=(u,v)' AS spec, v AS volume, 'region,vector' AS non_batch, 'b' AS non_primal, 'b,region' AS non_channel, 'b,vector' AS non_instance, n AS batches, r AS instances, 2 AS channels, '~vector' AS turned, 'true,false,false' AS mask, '0,0,0' AS first, r // 2 AS left_over, 'region' AS unstacked, n * 2 AS stacked, 'x(a,b)|y' AS split, r + 1 AS grown FROM nation, k"
)
def shapes_of_tables(s, d):
    """Shapes made of the tables' sizes; each nation's row has what the operations on them give."""
    n, r = _t(s, d, "nation").count(), _t(s, d, "region").count()
    shape = shape_spec(to_spec(merge_shapes(batch(b=n), instance(region=r), channel(vector="u,v"))))
    names = lambda x: ",".join(x.names)
    assert non_dual(shape) == non_spatial(shape) == shape == concat_shapes(batch(b=n), instance(region=r), channel(vector="u,v")) == concat_shapes_(shape, shape) == auto(to_spec(shape)) and pure_merge(batch(b=n), batch("b")) == batch(b=n)
    values = {
        "spec": to_spec(shape), "volume": shape.volume, "non_batch": names(non_batch(shape)), "non_primal": names(non_primal(shape)), "non_channel": names(non_channel(shape)), "non_instance": names(non_instance(shape)),
        "batches": kind_size(shape, "batch"), "instances": kind_size(shape, "instance"), "channels": kind_size(shape, "channel"), "turned": names(Shape((dual("vector")[0],))) if transposed(primal(shape))["vector" if "vector" in transposed(primal(shape)) else "~vector"].kind == "dual" else "",
        "mask": ",".join(str(m).lower() for m in mask(shape, "b")), "first": ",".join(map(str, first_index(shape).values())), "left_over": after_gather(shape, {"region": slice(1, None, 2)})["region"].size, "unstacked": names(unstack_shape(shape.without("vector"), "b")[0]),
        "stacked": shape_stack("s", "batch", batch(b=n), batch(b=n)).volume, "split": "|".join(split_top_level_comma("x(a,b),y")), "grown": shape.with_size("region", r + 1)["region"].size,
    }
    return _t(s, d, "nation").select("n_nationkey", *[F.lit(v).cast("long").alias(k) if isinstance(v, int) else F.lit(v).alias(k) for k, v in values.items()])


# --- grids and extrapolations ----------------------------------------------------------------------


@query(_PLANE + "SELECT event_type, x, y, round(sum(value), 3) AS total, min(value) AS least, round(avg(value), 4) AS mean, arg_min(value, dx * 3 + dy) FILTER (value > own + 10) AS above FROM i GROUP BY ALL")
def neighbors_by_sum_and_predicate(s, d):
    """Sums, minima and means around cells, and the first neighbour that is more than 10 larger."""
    g, keys = _plane(s, d), ["event_type"]
    out = _rounded(GR.neighbor_sum(g, _SIZES, keys), "value", n=3).withColumnRenamed("value", "total")
    parts = [GR.neighbor_min(g, _SIZES, keys).withColumnRenamed("value", "least"), _rounded(GR.neighbor_mean(g, _SIZES, keys), "value").withColumnRenamed("value", "mean")]
    parts.append(GR.at_neighbor_where(g.withColumn("by", F.col("value")), _SIZES, keys, "value", "by", lambda own, other: other > own + 10).withColumnRenamed("value", "above"))
    return reduce(lambda a, b: a.join(b, ["event_type", "x", "y"]), [out, *parts])


@query(
    _BAL + "SELECT g.x, 'directed' AS rule, CASE WHEN g.i BETWEEN 0 AND 24 THEN b.value ELSE 0 END AS u, b.value AS v FROM g JOIN b ON b.x = least(greatest(g.i, 0), 24) UNION ALL "
    "SELECT b.x, 'none', b.value, b.value FROM b UNION ALL SELECT g.x, 'zero', coalesce(b.value, 0), coalesce(b.value, 1) FROM g LEFT JOIN b ON b.x = g.i"
)
def pad_by_component_and_not(s, d):
    """Components padded by rules of their own, padding that adds nothing, and the constants 0 and 1."""
    b = _balances(s, d)
    both = b.select("x", F.col("value").alias("u"), F.col("value").alias("v"))
    directed = B.pad_directed(both, "x", 25, 3, 5, "u", (0.0, B.BOUNDARY), ["u", "v"]).select("x", F.lit("directed").alias("rule"), "u", "v")
    none = B.pad(b, "x", 25, 3, 5, B.NONE).select("x", F.lit("none").alias("rule"), F.col("value").alias("u"), F.col("value").alias("v"))
    zero = B.pad(b, "x", 25, 3, 5, B.ZERO).withColumnRenamed("value", "u").join(B.pad(b, "x", 25, 3, 5, B.ONE).withColumnRenamed("value", "v"), "x").select("x", F.lit("zero").alias("rule"), "u", "v")
    return directed.unionByName(none).unionByName(zero)


@query(
    "WITH b AS (SELECT c_mktsegment AS segment, CAST(c_nationkey AS BIGINT) AS x, round(sum(c_acctbal), 2) AS value FROM customer GROUP BY ALL), w AS (SELECT segment, segment < 'C' AS holds FROM (SELECT DISTINCT segment FROM b)), g AS (SELECT range AS x, range - 2 AS i FROM range(29)) "
    "SELECT w.segment, g.x, b.value FROM w CROSS JOIN g JOIN b ON b.segment = w.segment AND b.x = CASE WHEN w.holds THEN ((g.i % 25) + 25) % 25 ELSE least(greatest(g.i, 0), 24) END"
)
def pad_where_segment(s, d):
    """Periodic for some market segments, and the border's value for the others."""
    b = _t(s, d, "customer").groupBy(F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").cast("long").alias("x")).agg(_r(F.sum("c_acctbal"), 2).alias("value"))
    holds = b.select("segment").distinct().withColumn("holds", F.col("segment") < "C")
    return B.pad_where(b, "x", 25, 2, 2, holds, B.PERIODIC, B.BOUNDARY, keys=["segment"])


# --- sparse patterns -------------------------------------------------------------------------------


@query(
    _MATRIX + ", n AS (SELECT count(*) AS n, round(sum(value), 1) AS total FROM a) SELECT row, col, row * 10.0::DOUBLE + col AS formula, round(value, 1) AS other, round(n / 175.0, 6) AS sparsity, n AS stored, total, true AS same, n > 1 AND false AS turned FROM a, n"
)
def sparse_patterns(s, d):
    """New values on a pattern, what is stored, and whether patterns are the same; through the compact form and back."""
    a = L.sum_duplicates(_line_matrix(s, d), "row", "col")
    dims = ["row", "col"]
    formula = SP.tensor_like(a, dims, F.col("row") * 10.0 + F.col("col")).withColumnRenamed("value", "formula")
    other = SP.tensor_like(SP.stored_indices(a, dims), dims, SP.from_compact(SP.compressed_to_compact(L.to_csr(a, "row", "col", "value"), "row"), "row", "col")).withColumnRenamed("value", "other")
    total = SP.stored_values(a).agg(F.count("*").alias("stored"), _r(F.sum("value"), 1).alias("total"))
    numbers = {"sparsity": round(SP.sparsity(a, 175), 6), "same": SP.same_pattern(a, formula.withColumnRenamed("formula", "value"), dims), "turned": SP.same_pattern(a, SP.transpose(a, "row", "col"), dims)}
    return formula.join(other, dims).crossJoin(F.broadcast(total)).select("row", "col", "formula", _r(F.col("other"), 1).alias("other"), "stored", "total", *[F.lit(v).alias(n) for n, v in numbers.items()])


@query("SELECT l_orderkey, l_linenumber, CAST(r.range AS BIGINT) AS component, CASE r.range WHEN 0 THEN l_quantity ELSE l_extendedprice END AS value FROM lineitem, range(2) r")
def sparsified_components(s, d):
    return SP.sparsified(_t(s, d, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_quantity", "l_extendedprice"], "component")


# --- paths and stored frames -----------------------------------------------------------------------


@query(
    "SELECT page_id, regexp_replace(regexp_extract(url, '^(.*/)?[^/]*$', 1), '([^/])/+$', '\\1') AS folder, regexp_extract(url, '[^/.][^/]*?(\\.[^./]*)$', 1) AS extension, length(url) - length(regexp_extract(url, '[^/.][^/]*?(\\.[^./]*)$', 1)) AS stem_length, '/root/' || ltrim(url, '/') AS joined, '' AS drive FROM pages WHERE url NOT LIKE '%//%' AND url IS NOT NULL "
    "UNION ALL SELECT page_id, regexp_replace(regexp_extract(url, '^(.*/)?[^/]*$', 1), '([^/])/+$', '\\1'), regexp_extract(url, '[^/.][^/]*?(\\.[^./]*)$', 1), length(url) - length(regexp_extract(url, '[^/.][^/]*?(\\.[^./]*)$', 1)), '/root/' || url, '' FROM pages WHERE url LIKE '%://%'"
)
def paths_of_pages(s, d):
    """Folders, extensions and joined paths of the pages' addresses."""
    u = F.col("url")
    stem, extension = IO.splitext(u)
    return _t(s, d, "pages").where("url is not null").select("page_id", IO.dirname(u).alias("folder"), extension.alias("extension"), F.length(stem).cast("long").alias("stem_length"), IO.join_path(F.lit("/root"), u).alias("joined"), IO.split_drive(IO.normalize_case(u))[0].alias("drive"))


@query("SELECT l_returnflag, round(sum(l_quantity), 2) AS quantity, round(sum(l_discount), 2) AS discount, 'l_returnflag=' || l_returnflag AS folder, true AS listed FROM lineitem GROUP BY 1")
def stored_frames(s, d):
    """The line items' frame written by flags, listed, and two of its components read back."""
    path = f"{shared_folder(s)}/stored-{uuid.uuid4().hex}"
    IO.save(_lineitem(s, d), path, ["l_returnflag"])
    t = IO.load(s, path, ["quantity", "discount"])
    folders = IO.list_directories(s, path).select(IO.basename(F.col("path")).alias("folder"))
    sums = t.sum(["l_linestatus"]).map(lambda c: _r(c, 2)).df.withColumn("folder", F.concat(F.lit("l_returnflag="), "l_returnflag"))
    return sums.join(folders.withColumn("listed", F.lit(True)), "folder")


@query("SELECT CAST(c_nationkey AS BIGINT) AS nation, round(sum(c_acctbal), 2) AS minus, round(2 * sum(c_acctbal), 2) AS double, round(1000 / sum(c_acctbal), 8) AS under, CAST(floor(1e9 / sum(c_acctbal)) AS BIGINT) AS floor, 2.0::DOUBLE ** 3 AS power FROM customer GROUP BY 1")
def reflected_operators(s, d):
    """Numbers on the left of frames."""
    t = _nations(s, d, "customer", "c_nationkey", "c_acctbal")
    parts = {"minus": (0.0 - (0.0 - t), 2), "double": (2 * t, 2), "under": (1000 / t, 8)}
    out = [_rounded(f.df, "value", n=n).withColumnRenamed("value", name) for name, (f, n) in parts.items()]
    out += [(1e9 // t).cast("bigint").df.withColumnRenamed("value", "floor"), (2.0 ** (t * 0 + 3)).df.withColumnRenamed("value", "power")]
    return reduce(lambda a, b: a.join(b, "nation"), out)
