"""Registered queries of the named-dimension engine over the driver's tables, each with its DuckDB oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from axisframe.frame import TYPED, TensorFrame, align, concat, ncat, stack
from axisframe.functions import elementwise as E
from axisframe.functions import vector as V
from axisframe.operators import boundary as B
from axisframe.operators import decompose as D
from axisframe.operators import generators as G
from axisframe.operators import grid as GR
from axisframe.operators import linalg as L
from axisframe.operators import lookup as K
from axisframe.operators import neighbors as N
from axisframe.operators import reduce as R
from axisframe.operators import sampling as S
from axisframe.operators import scan as SC
from axisframe.operators import sparse as SP
from axisframe.operators import window as W
from axisframe.plans.iterate import bicgstab, conjugate_gradient, iterate
from axisframe.shape import Dim, Shape, batch, channel, instance, merge_shapes, spatial
from axisframe.sources import io as IO

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _lineitem(s: SparkSession, d: str) -> TensorFrame:
    """Batch dimensions are the flags; components are quantity, price and discount."""
    df = _t(s, d, "lineitem").select("l_returnflag", "l_linestatus", F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price"), F.col("l_discount").alias("discount"))
    return TensorFrame(df, batch("l_returnflag,l_linestatus"), ("quantity", "price", "discount"))


def _events(s: SparkSession, d: str) -> DataFrame:
    """Each user's values in order: dims (user_id, i)."""
    e = _t(s, d, "events").select("user_id", "event_id", F.col("value").cast("double").alias("value"), "ts", "event_type")
    return R.rank_of(e, ["user_id"], [F.col("ts"), F.col("event_id")], "i")


def _longest(s: SparkSession, d: str) -> int:
    """Events of the user that has most."""
    return _t(s, d, "events").groupBy("user_id").count().agg(F.max("count")).first()[0] or 0


_SERIES = "WITH e AS (SELECT user_id, event_id, CAST(value AS DOUBLE) AS value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i FROM events), "
_KEYS, _ORDER = ["user_id"], ["i"]


def _r(c, n: int = 4):
    return F.round(c, n)


# --- reductions ------------------------------------------------------------------------------------


@query("SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS quantity, round(sum(l_extendedprice), 2) AS price, round(sum(l_discount), 2) AS discount FROM lineitem GROUP BY ALL")
def sum_by_flags(s, d):
    return _lineitem(s, d).sum().map(lambda c: _r(c, 2)).df


@query("SELECT l_returnflag, l_linestatus, round(avg(l_quantity), 4) AS quantity, round(avg(l_extendedprice), 4) AS price, round(avg(l_discount), 4) AS discount FROM lineitem GROUP BY ALL")
def mean_by_flags(s, d):
    return _lineitem(s, d).mean().map(_r).df


@query("SELECT l_returnflag, l_linestatus, round(stddev_pop(l_quantity), 4) AS quantity, round(stddev_pop(l_extendedprice), 3) AS price, round(stddev_pop(l_discount), 4) AS discount FROM lineitem GROUP BY ALL")
def std_by_flags(s, d):
    t = _lineitem(s, d).std()
    return t.df.select("l_returnflag", "l_linestatus", _r(F.col("quantity")).alias("quantity"), _r(F.col("price"), 3).alias("price"), _r(F.col("discount")).alias("discount"))


@query("SELECT l_returnflag, l_linestatus, min(l_quantity) AS quantity, min(l_extendedprice) AS price, min(l_discount) AS discount FROM lineitem GROUP BY ALL")
def min_by_flags(s, d):
    return _lineitem(s, d).min().df


@query("SELECT max(l_quantity) AS quantity, max(l_extendedprice) AS price, max(l_discount) AS discount FROM lineitem")
def max_over_everything(s, d):
    return _lineitem(s, d).max("l_returnflag,l_linestatus").df


@query("SELECT l_orderkey, round(product(1 + l_tax), 6) AS value FROM lineitem GROUP BY ALL")
def prod_tax(s, d):
    t = TensorFrame(_t(s, d, "lineitem").select("l_orderkey", (1 + F.col("l_tax")).alias("value")), batch("l_orderkey"))
    return t.reduce(F.product).map(lambda c: _r(c, 6)).df


@query("SELECT c_mktsegment, bool_or(c_acctbal < -900) AS any_low, bool_and(c_acctbal > -999) AS all_above FROM customer GROUP BY ALL")
def any_all(s, d):
    c = _t(s, d, "customer").select("c_mktsegment", (F.col("c_acctbal") < -900).alias("any_low"), (F.col("c_acctbal") > -999).alias("all_above"))
    return c.groupBy("c_mktsegment").agg(F.bool_or("any_low").alias("any_low"), F.bool_and("all_above").alias("all_above"))


@query("SELECT l_returnflag, l_linestatus, round(sum(l_extendedprice * l_quantity) / sum(l_quantity), 3) AS price, round(sum(l_discount * l_quantity) / sum(l_quantity), 4) AS discount FROM lineitem GROUP BY ALL")
def weighted_mean(s, d):
    t = R.weighted_mean(_lineitem(s, d), "quantity")
    return t.df.select("l_returnflag", "l_linestatus", _r(F.col("price"), 3).alias("price"), _r(F.col("discount")).alias("discount"))


@query(
    "WITH e AS (SELECT event_type, CASE WHEN value < 10 THEN NULL ELSE value END AS v FROM events) "
    "SELECT event_type, round(sum(v), 3) AS finite_sum, round(avg(v), 4) AS finite_mean, min(v) AS finite_min, max(v) AS finite_max, round(stddev_pop(v), 3) AS finite_std FROM e GROUP BY ALL"
)
def finite_stats(s, d):
    v = F.col("v")
    e = _t(s, d, "events").select("event_type", F.when(F.col("value") < 5, F.lit(float("nan"))).when(F.col("value") < 10, F.lit(float("inf"))).otherwise(F.col("value")).alias("v"))
    return e.groupBy("event_type").agg(_r(R.finite_sum(v), 3).alias("finite_sum"), _r(R.finite_mean(v)).alias("finite_mean"), R.finite_min(v).alias("finite_min"), R.finite_max(v).alias("finite_max"), _r(R.finite_std(v), 3).alias("finite_std"))


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r = 1")
def at_max_order(s, d):
    return R.at_extreme(_t(s, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], "o_totalprice", ["o_orderkey"])


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) AS r FROM orders) WHERE r = 1")
def at_min_order(s, d):
    return R.at_extreme(_t(s, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], "o_totalprice", ["o_orderkey"], largest=False)


@query("SELECT o_orderpriority, round(quantile_cont(o_totalprice, 0.25), 3) AS q25, round(quantile_cont(o_totalprice, 0.5), 3) AS q50, round(quantile_cont(o_totalprice, 0.9), 3) AS q90 FROM orders GROUP BY ALL")
def quantiles(s, d):
    t = TensorFrame(_t(s, d, "orders").select("o_orderpriority", F.col("o_totalprice").alias("value")), batch("o_orderpriority"))
    return t.quantile({"q25": 0.25, "q50": 0.5, "q90": 0.9}).map(lambda c: _r(c, 3)).df


@query("SELECT c_mktsegment, round(median(c_acctbal), 3) AS value FROM customer GROUP BY ALL")
def median(s, d):
    return R.quantile(TensorFrame(_t(s, d, "customer").select("c_mktsegment", F.col("c_acctbal").alias("value")), batch("c_mktsegment")), 0.5).map(lambda c: _r(c, 3)).df


@query("WITH b AS (SELECT CAST(least(floor((c_acctbal + 1000) / 1100.0), 9) AS BIGINT) AS bin, count(*) AS n FROM customer WHERE c_acctbal BETWEEN -1000 AND 10000 GROUP BY 1) SELECT r.range AS bin, coalesce(n, 0) AS n FROM range(10) r LEFT JOIN b ON b.bin = r.range")
def histogram(s, d):
    return R.histogram(_t(s, d, "customer"), "c_acctbal", -1000.0, 10000.0, 10)


@query("SELECT c_nationkey, round(sqrt(sum(c_acctbal * c_acctbal)), 3) AS norm, round(sum(abs(c_acctbal)), 3) AS l1, round(0.5 * sum(c_acctbal * c_acctbal), 2) AS l2 FROM customer GROUP BY ALL")
def norms_and_losses(s, d):
    x = F.col("c_acctbal")
    return _t(s, d, "customer").groupBy("c_nationkey").agg(_r(F.sqrt(F.sum(x * x)), 3).alias("norm"), _r(F.sum(F.abs(x)), 3).alias("l1"), _r(0.5 * F.sum(x * x), 2).alias("l2"))


# --- element-wise ----------------------------------------------------------------------------------


@query("SELECT c_custkey, round(sin(c_acctbal), 6) AS sin, round(cos(c_acctbal), 6) AS cos, round(tanh(c_acctbal / 1000), 6) AS tanh, round(atan(c_acctbal), 6) AS arctan, round(asinh(c_acctbal), 6) AS arcsinh, round(atan2(c_acctbal, c_custkey), 6) AS arctan2 FROM customer")
def trig_suite(s, d):
    x = F.col("c_acctbal")
    cols = {"sin": E.PLAIN["sin"](x), "cos": E.PLAIN["cos"](x), "tanh": E.PLAIN["tanh"](x / 1000), "arctan": E.PLAIN["arctan"](x), "arcsinh": E.PLAIN["arcsinh"](x), "arctan2": E.PLAIN["arctan2"](x, F.col("c_custkey"))}
    return _t(s, d, "customer").select("c_custkey", *[_r(c, 6).alias(n) for n, c in cols.items()])


@query("SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN round(ln(c_acctbal), 6) WHEN c_acctbal = 0 THEN '-inf'::DOUBLE ELSE 'nan'::DOUBLE END AS log, CASE WHEN c_acctbal > 0 THEN round(log2(c_acctbal), 6) WHEN c_acctbal = 0 THEN '-inf'::DOUBLE ELSE 'nan'::DOUBLE END AS log2, round(exp(c_acctbal / 1000), 6) AS exp FROM customer")
def log_suite(s, d):
    x = F.col("c_acctbal")
    finite = lambda c: F.when(E.is_finite(c), _r(c, 6)).otherwise(c)
    return _t(s, d, "customer").select("c_custkey", finite(E.log(x)).alias("log"), finite(E.log2(x)).alias("log2"), _r(F.exp(x / 1000), 6).alias("exp"))


@query("SELECT o_orderkey, round_even(o_totalprice / 100 * 2, 0) / 2 AS halves, floor(o_totalprice) AS down, ceil(o_totalprice) AS up, ((o_custkey - 700) % 7 + 7) % 7 AS wrapped FROM orders")
def round_floor_mod(s, d):
    p = F.col("o_totalprice")
    return _t(s, d, "orders").select("o_orderkey", (E.round_even(p / 100 * 2) / 2).alias("halves"), F.floor(p).cast("double").alias("down"), F.ceil(p).cast("double").alias("up"), E.floor_mod(F.col("o_custkey") - 700, F.lit(7)).alias("wrapped"))


@query("SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 0.0 ELSE c_acctbal END AS positive, least(greatest(c_acctbal, 100), 5000) AS clipped, CASE WHEN c_nationkey = 0 THEN 0.0 ELSE round(c_acctbal / c_nationkey, 5) END AS safe FROM customer")
def where_clip_safe_div(s, d):
    x = F.col("c_acctbal")
    return _t(s, d, "customer").select("c_custkey", E.where(x < 0, F.lit(0.0), x).alias("positive"), E.clip(x, 100.0, 5000.0).alias("clipped"), _r(E.safe_div(x, F.col("c_nationkey")), 5).alias("safe"))


@query("SELECT c_custkey, CASE WHEN c_nationkey = 0 THEN CASE WHEN c_acctbal > 0 THEN 'inf'::DOUBLE WHEN c_acctbal < 0 THEN '-inf'::DOUBLE ELSE 'nan'::DOUBLE END ELSE round(c_acctbal / c_nationkey, 5) END AS ratio, round(1 / (1 + exp(-c_acctbal / 1000)), 6) AS sigmoid, sign(c_acctbal)::DOUBLE AS sign FROM customer")
def ieee_division(s, d):
    x = F.col("c_acctbal")
    ratio = E.divide(x, F.col("c_nationkey").cast("double"))
    return _t(s, d, "customer").select("c_custkey", F.when(E.is_finite(ratio), _r(ratio, 5)).otherwise(ratio).alias("ratio"), _r(E.sigmoid(x / 1000), 6).alias("sigmoid"), F.signum(x).alias("sign"))


@query("SELECT c_custkey, round(lgamma(1 + abs(c_acctbal) / 100), 5) AS log_gamma FROM customer")
def log_gamma(s, d):
    return _t(s, d, "customer").select("c_custkey", _r(E.log_gamma(1 + F.abs("c_acctbal") / 100), 5).alias("log_gamma"))


@query("WITH RECURSIVE k AS (SELECT c_custkey, c_acctbal / 5000 AS x, 0 AS n, c_acctbal / 5000 AS t, c_acctbal / 5000 AS s FROM customer UNION ALL SELECT c_custkey, x, n + 1, t * 2 * x * x / (2 * n + 3), s + t * 2 * x * x / (2 * n + 3) FROM k WHERE n < 60) SELECT c_custkey, round(2 / sqrt(pi()) * exp(-x * x) * s, 8) + 0.0 AS erf FROM k WHERE n = 60")
def erf(s, d):
    return _t(s, d, "customer").select("c_custkey", (_r(E.erf(F.col("c_acctbal") / 5000), 8) + 0.0).alias("erf"))


# --- scans and neighbourhoods ----------------------------------------------------------------------


@query(_SERIES + "x AS (SELECT user_id, i, round(sum(value) OVER (PARTITION BY user_id ORDER BY i), 3) AS value FROM e) SELECT user_id, i, value FROM x")
def cumsum_user(s, d):
    return SC.blocked_sum(_events(s, d).select("user_id", "i", "value"), _KEYS, "i", ["value"], longest=_longest(s, d)).withColumn("value", _r(F.col("value"), 3))


@query(_SERIES + "x AS (SELECT user_id, i, round(coalesce(sum(value) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 3) AS value FROM e) SELECT user_id, i, value FROM x")
def exclusive_cumsum(s, d):
    return SC.blocked_sum(_events(s, d).select("user_id", "i", "value"), _KEYS, "i", ["value"], include_0=True).withColumn("value", _r(F.col("value"), 3))


@query("SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY value, event_id) - 1 AS rank FROM events")
def sort_rank(s, d):
    return SC.sorted_rank(_t(s, d, "events").select("user_id", "event_id", "value"), ["user_id"], [F.col("value"), F.col("event_id")]).select("user_id", "event_id", "rank")


@query(_SERIES + "x AS (SELECT user_id, i, coalesce(lag(value) OVER w, value) AS low, coalesce(lead(value) OVER w, value) AS up, coalesce(lead(value, 2) OVER w, 0) AS two FROM e WINDOW w AS (PARTITION BY user_id ORDER BY i)) SELECT * FROM x")
def shift_lag(s, d):
    v = F.col("value")
    return _events(s, d).select("user_id", "i", W.shift(v, _KEYS, _ORDER, -1).alias("low"), W.shift(v, _KEYS, _ORDER, 1).alias("up"), W.shift(v, _KEYS, _ORDER, 2, "zero").alias("two"))


@query(_SERIES + "x AS (SELECT user_id, i, value AS v, coalesce(lag(value) OVER w, value) AS a, coalesce(lead(value) OVER w, value) AS b FROM e WINDOW w AS (PARTITION BY user_id ORDER BY i)) SELECT user_id, i, round((b - a) / 2, 4) AS central, round(b - v, 4) AS forward, round(v - a, 4) AS backward, round(a + b - 2 * v, 4) AS laplace FROM x")
def gradient_laplace(s, d):
    v = F.col("value")
    g = {k: W.gradient(v, _KEYS, _ORDER, 1.0, k) for k in ("central", "forward", "backward")}
    return _events(s, d).select("user_id", "i", *[_r(c).alias(k) for k, c in g.items()], _r(W.laplace(v, _KEYS, _ORDER)).alias("laplace"))


@query(_SERIES + "x AS (SELECT user_id, i, round(avg(value) OVER w, 4) AS mean, max(value) OVER w AS most FROM e WINDOW w AS (PARTITION BY user_id ORDER BY i ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)) SELECT * FROM x")
def neighbor_reduce(s, d):
    return _events(s, d).select("user_id", "i", _r(W.neighbor_reduce(F.avg, "value", _KEYS, _ORDER)).alias("mean"), W.neighbor_reduce(F.max, "value", _KEYS, _ORDER).alias("most"))


@query(_SERIES + "f AS (SELECT user_id, i, CASE WHEN event_id % 3 = 0 THEN NULL ELSE value END AS v FROM e), x AS (SELECT user_id, i, round(coalesce(v, avg(v) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 'nan'::DOUBLE), 4) AS value FROM f) SELECT * FROM x")
def finite_fill(s, d):
    e = _events(s, d).withColumn("v", F.when(F.col("event_id") % 3 == 0, F.lit(float("nan"))).otherwise(F.col("value")))
    return e.select("user_id", "i", _r(W.finite_fill(F.col("v"), _KEYS, _ORDER, 2)).alias("value"))


@query(_SERIES + "x AS (SELECT user_id, i, round(0.25 * coalesce(lag(value) OVER w, 0) + 0.5 * value + 0.25 * coalesce(lead(value) OVER w, 0), 4) AS value FROM e WINDOW w AS (PARTITION BY user_id ORDER BY i)) SELECT * FROM x")
def convolve_1d(s, d):
    return _events(s, d).select("user_id", "i", _r(W.convolve(F.col("value"), _KEYS, _ORDER, [0.25, 0.5, 0.25])).alias("value"))


@query("SELECT o_orderkey, round(exp(x - m) / sum(exp(x - m)) OVER (PARTITION BY o_custkey), 6) AS value FROM (SELECT o_orderkey, o_custkey, o_totalprice / 100000 AS x, max(o_totalprice / 100000) OVER (PARTITION BY o_custkey) AS m FROM orders)")
def softmax_group(s, d):
    o = _t(s, d, "orders").select("o_orderkey", "o_custkey", (F.col("o_totalprice") / 100000).alias("x"))
    return W.softmax(o, ["o_custkey"], "x").select("o_orderkey", _r(F.col("x"), 6).alias("value"))


@query(_SERIES + "x AS (SELECT user_id, i // 2 AS i, round(avg(value), 4) AS value FROM e GROUP BY ALL) SELECT * FROM x")
def downsample2x(s, d):
    return _events(s, d).groupBy("user_id", F.floor(F.col("i") / 2).alias("i")).agg(_r(F.avg("value")).alias("value"))


@query(_SERIES + "n AS (SELECT *, coalesce(lag(value) OVER w, value) AS a, coalesce(lead(value) OVER w, value) AS b FROM e WINDOW w AS (PARTITION BY user_id ORDER BY i)), x AS (SELECT user_id, 2 * i AS i, round(0.75 * value + 0.25 * a, 4) AS value FROM n UNION ALL SELECT user_id, 2 * i + 1, round(0.75 * value + 0.25 * b, 4) FROM n) SELECT * FROM x")
def upsample2x(s, d):
    v = F.col("value")
    n = _events(s, d).select("user_id", "i", v, W.shift(v, _KEYS, _ORDER, -1).alias("a"), W.shift(v, _KEYS, _ORDER, 1).alias("b"))
    pair = F.array(F.struct((2 * F.col("i")).alias("i"), (0.75 * v + 0.25 * F.col("a")).alias("value")), F.struct((2 * F.col("i") + 1).alias("i"), (0.75 * v + 0.25 * F.col("b")).alias("value")))
    return n.select("user_id", F.explode(pair).alias("c")).select("user_id", F.col("c.i").alias("i"), _r(F.col("c.value")).alias("value"))


def _balances(s, d) -> DataFrame:
    return _t(s, d, "nation").join(_t(s, d, "customer"), F.col("n_nationkey") == F.col("c_nationkey"), "left").groupBy(F.col("n_nationkey").cast("long").alias("x")).agg(_r(F.coalesce(F.sum("c_acctbal"), F.lit(0.0)), 2).alias("value"))


_BAL = "WITH b AS (SELECT CAST(n_nationkey AS BIGINT) AS x, round(coalesce(sum(c_acctbal), 0), 2) AS value FROM nation LEFT JOIN customer ON n_nationkey = c_nationkey GROUP BY 1), g AS (SELECT range AS x, range - 3 AS i FROM range(33)) "


@query(_BAL + "SELECT g.x, b.value FROM g JOIN b ON b.x = ((g.i % 25) + 25) % 25")
def pad_periodic(s, d):
    return B.pad(_balances(s, d), "x", 25, 3, 5, B.periodic)


@query(_BAL + "SELECT g.x, b.value FROM g JOIN b ON b.x = least(((g.i % 50) + 50) % 50, 49 - ((g.i % 50) + 50) % 50)")
def pad_symmetric(s, d):
    return B.pad(_balances(s, d), "x", 25, 3, 5, B.symmetric)


@query(_BAL + "SELECT g.x, b.value FROM g JOIN b ON b.x = least(((g.i % 48) + 48) % 48, 48 - ((g.i % 48) + 48) % 48)")
def pad_reflect(s, d):
    return B.pad(_balances(s, d), "x", 25, 3, 5, B.reflect)


@query(_BAL + "SELECT g.x, b.value FROM g JOIN b ON b.x = least(greatest(g.i, 0), 24)")
def pad_boundary(s, d):
    return B.pad(_balances(s, d), "x", 25, 3, 5, B.boundary)


@query(_BAL + "SELECT g.x, coalesce(b.value, 1.0) AS value FROM g LEFT JOIN b ON b.x = g.i")
def pad_constant(s, d):
    return B.pad(_balances(s, d), "x", 25, 3, 5, 1.0)


# --- joins, gather, scatter ------------------------------------------------------------------------


@query("SELECT c_custkey, n_name FROM customer JOIN nation ON n_nationkey = c_nationkey")
def gather_nation(s, d):
    values = _t(s, d, "nation").select(F.col("n_nationkey").alias("k"), "n_name")
    return K.gather(values, _t(s, d, "customer").select("c_custkey", F.col("c_nationkey").alias("k")), ["k"]).select("c_custkey", "n_name")


@query("SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, event_id FROM events WHERE value > 50")
def boolean_mask(s, d):
    return K.boolean_mask(_events(s, d), "i", F.col("value") > 50, ["user_id"]).select("user_id", "i", "event_id")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_discount <> 0")
def nonzero(s, d):
    return K.nonzero(_t(s, d, "lineitem"), ["l_orderkey", "l_linenumber"], "l_discount")


@query(_SERIES + "r AS (SELECT user_id, i, i - row_number() OVER (PARTITION BY user_id ORDER BY i) AS g FROM e WHERE value > 50) SELECT user_id, min(i) AS start, max(i) + 1 AS stop FROM r GROUP BY user_id, g")
def nonzero_slices(s, d):
    return K.nonzero_slices(_events(s, d), ["user_id"], "i", F.col("value") > 50)


def _scatter(s, d, mode: str, places: int = 2, **options) -> DataFrame:
    grid = _t(s, d, "nation").select(F.col("n_nationkey").alias("x"))
    entries = _t(s, d, "supplier").where("s_acctbal > 6000").select(F.col("s_nationkey").alias("x"), F.col("s_acctbal").alias("v"), "s_suppkey")
    out = K.scatter(grid, entries, ["x"], "v", mode, **options)
    return out.select("x", F.when(E.is_finite(F.col("value")), _r(F.col("value"), places)).otherwise(F.col("value")).alias("value"))


def _scatter_sql(agg: str) -> str:
    return f"SELECT n_nationkey AS x, {agg} AS value FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey AND s_acctbal > 6000 GROUP BY 1"


@query(_scatter_sql("round(coalesce(sum(s_acctbal), 0), 2)"))
def scatter_add(s, d):
    return _scatter(s, d, "add")


@query(_scatter_sql("round(coalesce(avg(s_acctbal), 'nan'::DOUBLE), 4)"))
def scatter_mean(s, d):
    return _scatter(s, d, "mean", 4)


@query(_scatter_sql("coalesce(max(s_acctbal), '-inf'::DOUBLE)"))
def scatter_max(s, d):
    return _scatter(s, d, "max")


@query(_scatter_sql("coalesce(min(s_acctbal), 'inf'::DOUBLE)"))
def scatter_min(s, d):
    return _scatter(s, d, "min")


@query(_scatter_sql("coalesce(arg_max(s_acctbal, s_suppkey), 1.0)"))
def scatter_update(s, d):
    return _scatter(s, d, "update", base=F.lit(1.0), order=["s_suppkey"])


@query("WITH a AS (SELECT c_nationkey AS nation, c_mktsegment AS segment, sum(c_acctbal) AS v FROM customer GROUP BY ALL), b AS (SELECT s_nationkey AS nation, sum(s_acctbal) AS v FROM supplier GROUP BY ALL) SELECT nation, segment, round(a.v - b.v, 2) AS value FROM a JOIN b USING (nation)")
def align_by_name(s, d):
    a = TensorFrame(_t(s, d, "customer").select(F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("value")), batch("nation,segment")).sum()
    b = TensorFrame(_t(s, d, "supplier").select(F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("value")), batch("nation")).sum()
    return (a - b).map(lambda c: _r(c, 2)).df


@query("WITH t AS (SELECT l_returnflag, l_linestatus, sum(l_quantity) AS q, sum(l_extendedprice) AS p, sum(l_discount) AS c FROM lineitem GROUP BY ALL), w AS (SELECT sum(q) AS q, sum(p) AS p, sum(c) AS c FROM t) SELECT l_returnflag, l_linestatus, round(t.q / w.q, 6) AS quantity, round(t.p / w.p, 6) AS price, round(t.c / w.c, 6) AS discount FROM t, w")
def broadcast_scalar(s, d):
    t = _lineitem(s, d).sum()
    return align(t, t.sum("l_returnflag,l_linestatus"), E.divide).map(lambda c: _r(c, 6)).df


@query("SELECT p_partkey, p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49) AS found FROM part")
def contains(s, d):
    values = _t(s, d, "lineitem").where("l_quantity > 49").select(F.col("l_partkey").alias("p_partkey"))
    return K.contains(values, _t(s, d, "part").select("p_partkey"), ["p_partkey"])


@query("SELECT p_partkey, coalesce(n, 0) AS n FROM part LEFT JOIN (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_partkey = p_partkey")
def count_occurrences(s, d):
    return R.count_occurrences(_t(s, d, "lineitem").select(F.col("l_partkey").alias("p_partkey")), _t(s, d, "part").select("p_partkey"), ["p_partkey"])


@query("SELECT a.s_suppkey AS l_s_suppkey, b.s_suppkey AS r_s_suppkey, round(abs(a.s_acctbal - b.s_acctbal), 2) AS distance FROM supplier a JOIN supplier b ON abs(a.s_acctbal - b.s_acctbal) <= 40")
def range_join_1d(s, d):
    p = _t(s, d, "supplier").select("s_suppkey", "s_acctbal")
    return N.range_join(p, p, ["s_acctbal"], 40.0).select("l_s_suppkey", "r_s_suppkey", _r(F.col("distance"), 2).alias("distance"))


@query("WITH p AS (SELECT p_partkey AS id, p_retailprice AS x, p_size * 10.0 AS y FROM part) SELECT a.id AS l_id, b.id AS r_id, round(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2), 3) AS distance FROM p a JOIN p b ON sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) <= 5")
def range_join_2d(s, d):
    p = _t(s, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("x"), (F.col("p_size") * 10.0).alias("y"))
    return N.range_join(p, p, ["x", "y"], 5.0).select("l_id", "r_id", _r(F.col("distance"), 3).alias("distance"))


@query("SELECT c_custkey, s_suppkey, round(dist, 2) AS distance FROM (SELECT c_custkey, s_suppkey, abs(c_acctbal - s_acctbal) AS dist, row_number() OVER (PARTITION BY c_custkey ORDER BY round(abs(c_acctbal - s_acctbal), 6), s_suppkey) AS r FROM customer, supplier) WHERE r = 1")
def find_closest(s, d):
    points = _t(s, d, "supplier").select("s_suppkey", F.col("s_acctbal").alias("x"))
    queries = _t(s, d, "customer").select("c_custkey", F.col("c_acctbal").alias("x"))
    return N.nearest_1d(points, queries, "x", "s_suppkey", "c_custkey", digits=6).select("c_custkey", "s_suppkey", _r(F.col("distance"), 2).alias("distance"))


# --- structure -------------------------------------------------------------------------------------


def _nations(s, d, table: str, key: str, value: str) -> TensorFrame:
    df = _t(s, d, table).select(F.col(key).cast("long").alias("nation"), F.col(value).alias("value"))
    return TensorFrame(df, merge_shapes(batch(nation=25))).sum()


@query("SELECT 0 AS side, CAST(c_nationkey AS BIGINT) AS nation, round(sum(c_acctbal), 2) AS value FROM customer GROUP BY 2 UNION ALL SELECT 1, CAST(s_nationkey AS BIGINT), round(sum(s_acctbal), 2) FROM supplier GROUP BY 2")
def stack_union(s, d):
    a, b = _nations(s, d, "customer", "c_nationkey", "c_acctbal"), _nations(s, d, "supplier", "s_nationkey", "s_acctbal")
    return stack({"customer": a, "supplier": b}, "side").map(lambda c: _r(c, 2)).df


@query("SELECT CAST(c_nationkey AS BIGINT) AS nation, round(sum(c_acctbal), 2) AS value FROM customer GROUP BY 1 UNION ALL SELECT CAST(s_nationkey + 25 AS BIGINT), round(sum(s_acctbal), 2) FROM supplier GROUP BY 1")
def concat_union(s, d):
    a, b = _nations(s, d, "customer", "c_nationkey", "c_acctbal"), _nations(s, d, "supplier", "s_nationkey", "s_acctbal")
    return concat([a, b], "nation").map(lambda c: _r(c, 2)).df


@query("SELECT CAST((c_nationkey - 3) // 4 AS BIGINT) AS nation, round(sum(c_acctbal), 2) AS value FROM customer WHERE c_nationkey >= 3 AND c_nationkey < 20 AND (c_nationkey - 3) % 4 = 0 GROUP BY 1")
def slice_by_name(s, d):
    return _nations(s, d, "customer", "c_nationkey", "c_acctbal")[{"nation": slice(3, 20, 4)}].map(lambda c: _r(c, 2)).df


@query("SELECT l_orderkey * 8 + l_linenumber AS packed, l_orderkey AS l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber FROM lineitem")
def pack_unpack(s, d):
    p = _t(s, d, "lineitem").select(K.ravel(["l_orderkey", "l_linenumber"], [1, 8]).alias("packed"))
    dims = K.unravel(F.col("packed"), ["l_orderkey", "l_linenumber"], [1 << 40, 8])
    return p.select("packed", *[c.cast("long").alias(n) for n, c in dims.items()])


@query("SELECT s_suppkey, round(s_acctbal / max(abs(s_acctbal)) OVER (PARTITION BY s_nationkey), 6) AS value FROM supplier")
def normalize_by_max(s, d):
    t = TensorFrame(_t(s, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("value")), merge_shapes(batch("nation"), instance("s_suppkey")))
    return (t / abs(t).max("s_suppkey")).map(lambda c: _r(c, 6)).df.select("s_suppkey", "value")


# --- contractions and sparse matrices --------------------------------------------------------------


@query("SELECT vec_id, round(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])), 4) AS squared, round(sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 4) AS norm FROM embeddings")
def embedding_norms(s, d):
    e = F.col("embedding")
    return _t(s, d, "embeddings").select("vec_id", _r(L.dot_arrays(e, e)).alias("squared"), _r(L.norm(e)).alias("norm"))


@query("WITH v AS (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS c FROM embeddings) SELECT label, CAST(c AS BIGINT) AS c, round(avg(x), 4) + 0.0 AS value FROM v GROUP BY ALL")
def embedding_means(s, d):
    v = _t(s, d, "embeddings").select("label", F.posexplode("embedding").alias("c", "value"))
    t = TensorFrame(v.select("label", F.col("c").cast("long").alias("c"), F.col("value").cast("double").alias("value")), merge_shapes(batch("label"), channel("c")))
    return t.reduce(F.avg, []).map(lambda c: _r(c) + 0.0).df


def _gram(s, d) -> DataFrame:
    v = _t(s, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("c", "x")).select("vec_id", F.col("c").cast("long").alias("c"), F.col("x").cast("double").alias("x"))
    return L.matmul(v.select(F.col("c").alias("i"), "vec_id", F.col("x").alias("a")), v.select("vec_id", F.col("c").alias("j"), F.col("x").alias("b")), "i", "vec_id", "j").select("i", "j", (_r(F.col("value"), 2) + 0.0).alias("value"))


@query("WITH v AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS c FROM embeddings) SELECT CAST(a.c AS BIGINT) AS i, CAST(b.c AS BIGINT) AS j, round(sum(a.x * b.x), 2) + 0.0 AS value FROM v a JOIN v b USING (vec_id) GROUP BY 1, 2")
def gram_matrix(s, d):
    return _gram(s, d)


@query("WITH v AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS c FROM embeddings) SELECT CAST(a.c AS BIGINT) AS i, CAST(b.c AS BIGINT) AS j, round(sum(a.x * b.x), 2) + 0.0 AS value FROM v a JOIN v b USING (vec_id) GROUP BY 1, 2")
def gram_matrix_whole(s, d):
    """Of all components."""
    return _gram(s, d)


@query("SELECT l_partkey, l_suppkey, round(sum(l_quantity), 2) AS value FROM lineitem GROUP BY ALL")
def coo_sum_duplicates(s, d):
    return L.sum_duplicates(_t(s, d, "lineitem").select("l_partkey", "l_suppkey", F.col("l_quantity").alias("value")), "l_partkey", "l_suppkey").withColumn("value", _r(F.col("value"), 2))


@query("WITH a AS (SELECT l_suppkey AS supp, l_partkey AS part, sum(l_quantity) AS v FROM lineitem GROUP BY ALL) SELECT x.supp AS row, y.supp AS col, round(sum(x.v * y.v), 1) AS value FROM a x JOIN a y USING (part) GROUP BY ALL")
def coo_matmul(s, d):
    """Suppliers by suppliers over the parts they share."""
    a = L.sum_duplicates(_t(s, d, "lineitem").select("l_suppkey", "l_partkey", F.col("l_quantity").alias("value")), "l_suppkey", "l_partkey")
    left, right = a.select(F.col("l_suppkey").alias("row"), "l_partkey", F.col("value").alias("a")), a.select("l_partkey", F.col("l_suppkey").alias("col"), F.col("value").alias("b"))
    return L.matmul(left, right, "row", "l_partkey", "col").withColumn("value", _r(F.col("value"), 1))


@query("SELECT l_suppkey, min(v) AS least, max(v) AS most FROM (SELECT l_partkey, l_suppkey, round(sum(l_quantity), 2) AS v FROM lineitem GROUP BY ALL) GROUP BY 1")
def sparse_min_stored(s, d):
    coo = L.sum_duplicates(_t(s, d, "lineitem").select("l_partkey", "l_suppkey", F.col("l_quantity").alias("value")), "l_partkey", "l_suppkey").withColumn("value", _r(F.col("value"), 2))
    back = L.from_csr(L.to_csr(coo, "l_suppkey", "l_partkey", "value"), "l_suppkey", "l_partkey", "value")
    return back.groupBy("l_suppkey").agg(F.min("value").alias("least"), F.max("value").alias("most"))


@query("SELECT l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 2) AS intercept FROM lineitem GROUP BY ALL")
def fit_line(s, d):
    f = L.fit_line(_t(s, d, "lineitem"), ["l_returnflag"], "l_quantity", "l_extendedprice")
    return f.select("l_returnflag", _r(F.col("slope")).alias("slope"), _r(F.col("intercept"), 2).alias("intercept"))


# --- loops and solvers -----------------------------------------------------------------------------


def _smooth_sql(steps: int) -> str:
    out = _SERIES + "s0 AS (SELECT user_id, i, value FROM e)"
    for k in range(1, steps + 1):
        out += f", s{k} AS (SELECT user_id, i, (coalesce(lag(value) OVER (PARTITION BY user_id ORDER BY i), value) + 2 * value + coalesce(lead(value) OVER (PARTITION BY user_id ORDER BY i), value)) / 4 AS value FROM s{k - 1})"
    return out + f" SELECT user_id, i, round(value, 4) AS value FROM s{steps}"


@query(_smooth_sql(5))
def iterate_smoothing(s, d):
    v = F.col("value")
    step = lambda df: df.select("user_id", "i", ((W.shift(v, _KEYS, _ORDER, -1) + 2 * v + W.shift(v, _KEYS, _ORDER, 1)) / 4).alias("value"))
    return iterate(step, _events(s, d).select("user_id", "i", "value"), 5).withColumn("value", _r(v))


@query(
    "WITH RECURSIVE " + _BAL.rsplit(", g AS", 1)[0].removeprefix("WITH ") + ", f AS (SELECT 0 AS i, -1 / 3.0::DOUBLE AS c, value / 3.0::DOUBLE AS d FROM b WHERE x = 0 UNION ALL SELECT f.i + 1, -1 / (3 + f.c), (b.value + f.d) / (3 + f.c) FROM f JOIN b ON b.x = f.i + 1), "
    "r AS (SELECT CAST(24 AS BIGINT) AS i, d AS x FROM f WHERE i = 24 UNION ALL SELECT r.i - 1, f.d - f.c * r.x FROM r JOIN f ON f.i = r.i - 1) SELECT i AS row, round(x, 2) AS x FROM r"
)
def solve_poisson(s, d):
    """(I - laplace) x = balances over the nations, by conjugate gradients."""
    b = _balances(s, d)
    n = b.select(F.col("x").alias("row"))
    entries = F.array(F.struct(F.lit(0).alias("o"), F.lit(3.0).alias("value")), F.struct(F.lit(-1).alias("o"), F.lit(-1.0).alias("value")), F.struct(F.lit(1).alias("o"), F.lit(-1.0).alias("value")))
    matrix = n.select("row", F.explode(entries).alias("e")).select("row", (F.col("row") + F.col("e.o")).alias("col"), F.col("e.value").alias("value"))
    return conjugate_gradient(matrix, b.select(F.col("x").alias("row"), F.col("value").alias("y")), "row", "col", tolerance=1e-11).select("row", _r(F.col("x"), 2).alias("x"))


# --- sources and strings ---------------------------------------------------------------------------


@query("SELECT page_id, regexp_replace(url, '^.*/', '') AS base, starts_with(url, '/') AS absolute FROM pages")
def path_functions(s, d):
    return _t(s, d, "pages").select("page_id", IO.basename(F.col("url")).alias("base"), IO.is_absolute(F.col("url")).alias("absolute"))


@query("SELECT doc_id, lang || ':' || source || ':' || lpad(CAST(n_chars AS VARCHAR), 6, '0') AS value FROM documents")
def string_format(s, d):
    return _t(s, d, "documents").select("doc_id", F.format_string("%s:%s:%06d", "lang", "source", "n_chars").alias("value"))


@query("SELECT conv_id, max(n) AS most, count(*) AS turns FROM (SELECT conv_id, turn, length(text) AS n FROM conversations) GROUP BY 1")
def ragged_stack(s, d):
    t = TensorFrame(_t(s, d, "conversations").select("conv_id", "turn", F.length("text").alias("value")), merge_shapes(batch("conv_id"), spatial("turn")))
    return t.df.groupBy(*t.dims.without("turn").names).agg(F.max("value").alias("most"), F.count("*").alias("turns"))


# --- generators and sampling -----------------------------------------------------------------------


@query("SELECT p_partkey, unnest(range(CAST(p_size AS BIGINT))) AS i FROM part")
def arange_ragged(s, d):
    return G.arange_each(_t(s, d, "part").select("p_partkey", "p_size"), "i", F.col("p_size")).select("p_partkey", "i")


@query("WITH b AS (SELECT c_mktsegment, min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM customer GROUP BY 1) SELECT c_mktsegment, i, round(lo + (hi - lo) * i / 4, 4) AS value FROM (SELECT *, unnest(range(5)) AS i FROM b)")
def linspace_levels(s, d):
    b = _t(s, d, "customer").groupBy("c_mktsegment").agg(F.min("c_acctbal").alias("lo"), F.max("c_acctbal").alias("hi"))
    return G.linspace_each(b, "i", F.col("lo"), F.col("hi"), 5).select("c_mktsegment", "i", _r(F.col("value")).alias("value"))


@query("WITH g AS (SELECT a.range AS nation, b.range AS line FROM range(25) a, range(1, 8) b), c AS (SELECT s_nationkey AS nation, CAST(l_linenumber AS BIGINT) AS line, count(*) AS n FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY ALL) SELECT g.nation, g.line, coalesce(n, 0) AS n FROM g LEFT JOIN c USING (nation, line)")
def meshgrid_counts(s, d):
    grid = G.meshgrid(s, nation=25, line=7).withColumn("line", F.col("line") + 1)
    hit = _t(s, d, "lineitem").join(_t(s, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).groupBy(F.col("s_nationkey").cast("long").alias("nation"), F.col("l_linenumber").cast("long").alias("line")).agg(F.count("*").alias("n"))
    return grid.join(hit, ["nation", "line"], "left").select("nation", "line", F.coalesce("n", F.lit(0)).alias("n"))


@query("SELECT CAST(n_nationkey AS BIGINT) AS x, round(CASE WHEN n_nationkey < 13 THEN n_nationkey ELSE n_nationkey - 25 END / 25.0, 6) AS frequency FROM nation")
def fft_frequencies(s, d):
    x = F.col("n_nationkey").cast("long")
    return _t(s, d, "nation").select(x.alias("x"), _r(G.fftfreq(x, 25), 6).alias("frequency"))


@query("WITH n AS (SELECT max(event_id) + 1 AS n FROM events) SELECT event_id, round(CASE WHEN event_id < (n + 1) // 2 THEN event_id ELSE event_id - n END / CAST(n AS DOUBLE), 6) + 0.0 AS frequency FROM events, n")
def fft_frequencies_events(s, d):
    """Over the events' ids: the size is that of the table's index."""
    x = F.col("event_id").cast("long")
    events = _t(s, d, "events")
    size = (events.agg(F.max(x).alias("n")).first().n or 0) + 1
    return events.select("event_id", (_r(G.fftfreq(x, size), 6) + 0.0).alias("frequency"))


@query("SELECT o_orderpriority, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY md5('7:' || o_orderkey), o_orderkey) AS r FROM orders) WHERE r <= 10")
def pick_random(s, d):
    return S.pick_random(_t(s, d, "orders").select("o_orderpriority", "o_orderkey"), ["o_orderpriority"], "o_orderkey", 10, seed=7)


@query("SELECT c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY md5('3:' || c_custkey), c_custkey) - 1 AS permuted FROM customer")
def random_permutation(s, d):
    return S.random_permutation(_t(s, d, "customer").select("c_custkey", "c_nationkey"), ["c_nationkey"], "c_custkey", seed=3).select("c_custkey", "permuted")


@query(_BAL.rsplit(", g AS", 1)[0] + ", p AS (SELECT event_id, least(greatest(value / 7, 0), 24) AS p FROM events), q AS (SELECT event_id, p, CAST(least(floor(p), 23) AS BIGINT) AS i FROM p) SELECT event_id, round(l.value * (1 - (p - i)) + u.value * (p - i), 4) AS value FROM q JOIN b l ON l.x = i JOIN b u ON u.x = i + 1")
def grid_sample(s, d):
    points = _t(s, d, "events").select("event_id", (F.col("value") / 7).alias("p"))
    return S.grid_sample(_balances(s, d), points, "x", "p", 25).select("event_id", _r(F.col("value"), 4).alias("value"))


@query("WITH s AS (SELECT DISTINCT l_suppkey AS i, date_trunc('month', l_shipdate) AS e FROM lineitem) SELECT a.i AS a, b.i AS b, count(*) AS n FROM s a JOIN s b ON a.e = b.e AND a.i <> b.i GROUP BY ALL")
def count_intersections(s, d):
    sets = _t(s, d, "lineitem").select(F.col("l_suppkey").alias("i"), F.date_trunc("month", "l_shipdate").alias("e"))
    return S.count_intersections(sets, "i", "e")


@query("WITH s AS (SELECT DISTINCT l_suppkey AS i, date_trunc('month', l_shipdate) AS e FROM lineitem) SELECT a.i AS a, b.i AS b, count(*) AS n FROM s a JOIN s b ON a.e = b.e AND a.i <> b.i GROUP BY ALL")
def count_intersections_whole(s, d):
    """Of all suppliers' months."""
    sets = _t(s, d, "lineitem").select(F.col("l_suppkey").alias("i"), F.date_trunc("month", "l_shipdate").alias("e"))
    return S.count_intersections(sets, "i", "e")


@query(_BAL.rsplit(", g AS", 1)[0] + " SELECT a.x AS x, b.x AS y, round(b.value - a.value, 2) AS value FROM b a, b b")
def pairwise_differences(s, d):
    """Of the nations' balances: a grid of fixed size."""
    b = _balances(s, d)
    t = TensorFrame(b, merge_shapes(instance(x=25)))
    u = TensorFrame(b.select(F.col("x").alias("y"), "value"), merge_shapes(instance(y=25)))
    return (u - t).map(lambda c: _r(c, 2)).df.select("x", "y", "value")


# --- grids of two dimensions -----------------------------------------------------------------------

_SIZES = {"x": 8, "y": 6}


def _plane(s, d) -> DataFrame:
    """Sums of the events' values over an 8 x 6 grid of each type."""
    e = _t(s, d, "events").select("event_type", (F.col("event_id") % 8).cast("long").alias("x"), (F.floor(F.col("event_id") / 8) % 6).cast("long").alias("y"), F.col("value").cast("double").alias("value"))
    sums = e.groupBy("event_type", "x", "y").agg(_r(F.sum("value"), 3).alias("value"))
    grid = e.select("event_type").distinct().join(F.broadcast(G.meshgrid(s, **_SIZES)))  # a type's cells are 48
    return grid.join(sums, ["event_type", "x", "y"], "left").withColumn("value", F.coalesce("value", F.lit(0.0)))


_PLANE = (
    "WITH m AS (SELECT event_type, event_id % 8 AS x, (event_id // 8) % 6 AS y, round(sum(value), 3) AS value FROM events GROUP BY ALL), "
    "g AS (SELECT t.event_type, a.range AS x, b.range AS y, coalesce(m.value, 0) AS value FROM (SELECT DISTINCT event_type FROM events) t CROSS JOIN range(8) a CROSS JOIN range(6) b "
    "LEFT JOIN m ON m.event_type = t.event_type AND m.x = a.range AND m.y = b.range), "
    "o AS (SELECT a.range - 1 AS dx, b.range - 1 AS dy FROM range(3) a, range(3) b), "
    "n AS (SELECT c.event_type, c.x, c.y, dx, dy, c.value AS own, g.value FROM g c CROSS JOIN o JOIN g ON g.event_type = c.event_type AND g.x = least(greatest(c.x + dx, 0), 7) AND g.y = least(greatest(c.y + dy, 0), 5)), "
    "i AS (SELECT * FROM n WHERE x + dx BETWEEN 0 AND 7 AND y + dy BETWEEN 0 AND 5) "
)


@query(_PLANE + "SELECT event_type, x, y, round((sum(value) FILTER (dx = 1 AND dy = 0) - sum(value) FILTER (dx = -1 AND dy = 0)) / 2, 4) AS d_x, round((sum(value) FILTER (dx = 0 AND dy = 1) - sum(value) FILTER (dx = 0 AND dy = -1)) / 2, 4) AS d_y FROM n GROUP BY ALL")
def gradient_2d(s, d):
    return _rounded(GR.spatial_gradient(_plane(s, d), _SIZES, ["event_type"]), "d_x", "d_y")


def _rounded(df: DataFrame, *columns: str, n: int = 4) -> DataFrame:
    return df.withColumns({c: _r(F.col(c), n) + 0.0 for c in columns})


@query(_PLANE + "SELECT event_type, x, y, round(sum(value) FILTER (abs(dx) + abs(dy) = 1) - 4 * max(own), 4) + 0.0 AS value FROM n GROUP BY ALL")
def laplace_2d(s, d):
    return _rounded(GR.laplace(_plane(s, d), _SIZES, ["event_type"]), "value")


@query(_PLANE + "SELECT event_type, x, y, max(value) AS value FROM i GROUP BY ALL")
def neighbor_max_2d(s, d):
    return GR.neighbor_reduce(_plane(s, d), _SIZES, ["event_type"], F.max)


@query(_PLANE + "SELECT event_type, x, y, arg_max(value, own * 0 + value) AS most, arg_min(value, value) AS least FROM i GROUP BY ALL")
def at_extreme_neighbor(s, d):
    """The neighbours' values by their own size: the largest and the smallest around."""
    g = _plane(s, d).withColumn("by", F.col("value"))
    a = GR.at_neighbor(g, _SIZES, ["event_type"], "value", "by").withColumnRenamed("value", "most")
    return a.join(GR.at_neighbor(g, _SIZES, ["event_type"], "value", "by", largest=False).withColumnRenamed("value", "least"), ["event_type", "x", "y"])


@query(_PLANE + "SELECT event_type, x, y, CASE WHEN max(own) >= 500 OR count(*) FILTER (value >= 500) = 0 THEN round(max(own), 6) ELSE round(avg(value) FILTER (value >= 500), 6) END AS value, count(*) FILTER (value >= 500) > 0 AS valid FROM i GROUP BY ALL")
def masked_fill(s, d):
    g = _plane(s, d).withColumn("valid", F.col("value") >= 500)
    out = GR.masked_fill(g, _SIZES, ["event_type"])
    return out.withColumn("value", _r(F.col("value"), 6))


@query(_PLANE + "SELECT event_type, x, y, round(coalesce(CASE WHEN max(own) >= 500 THEN max(own) END, avg(value) FILTER (value >= 500 AND abs(dx) + abs(dy) <= 1), 'nan'::DOUBLE), 6) AS value FROM i GROUP BY ALL")
def finite_fill_2d(s, d):
    g = _plane(s, d).withColumn("value", F.when(F.col("value") >= 500, F.col("value")).otherwise(F.lit(float("nan"))))
    return GR.finite_fill(g, _SIZES, ["event_type"], diagonal=False).withColumn("value", _r(F.col("value"), 6))


@query(_PLANE + "SELECT event_type, x, y, round(sum(value * (2 - abs(dx)) * (2 - abs(dy)) / 7.0), 4) AS value FROM i GROUP BY ALL")
def convolve_2d(s, d):
    kernel = {(a, b): (2 - abs(a)) * (2 - abs(b)) / 7 for a in (-1, 0, 1) for b in (-1, 0, 1)}
    return _rounded(GR.convolve(_plane(s, d), _SIZES, ["event_type"], kernel), "value")


@query(_PLANE + "SELECT event_type, x, y, max(value) FILTER (dx = 1 AND dy = -1) AS value_0, max(value) FILTER (dx = -1 AND dy = 0) AS value_1 FROM n GROUP BY ALL")
def index_shift(s, d):
    return GR.index_shift(_plane(s, d), _SIZES, ["event_type"], [(1, -1), (-1, 0)])


@query(_PLANE + "SELECT event_type, x // 2 AS x, y // 2 AS y, round(avg(value), 6) AS value FROM g GROUP BY ALL")
def downsample_2d(s, d):
    return _rounded(GR.downsample2x(_plane(s, d), _SIZES, ["event_type"]), "value", n=6)


@query(_PLANE + ", s AS (SELECT a.range AS sx, b.range AS sy FROM range(2) a, range(2) b) SELECT event_type, 2 * x + sx AS x, 2 * y + sy AS y, round(sum(value * CASE WHEN dx = 0 THEN 0.75 WHEN dx = 2 * sx - 1 THEN 0.25 ELSE 0 END * CASE WHEN dy = 0 THEN 0.75 WHEN dy = 2 * sy - 1 THEN 0.25 ELSE 0 END), 7) AS value FROM n CROSS JOIN s GROUP BY ALL")
def upsample_2d(s, d):
    return _rounded(GR.upsample2x(_plane(s, d), _SIZES, ["event_type"]), "value", n=7)


_POINTS = (
    _PLANE + ", q AS (SELECT x, y, sum(value) AS value FROM g GROUP BY ALL), p AS (SELECT event_id, (event_id % 70) / 10.0 AS px, (event_id % 30) / 6.0 AS py FROM events), "
    "k AS (SELECT event_id, corner, px, py, q.value, abs(1 - cx - (px - floor(px))) * abs(1 - cy - (py - floor(py))) AS w FROM p CROSS JOIN (SELECT 2 * a.range + b.range AS corner, a.range AS cx, b.range AS cy FROM range(2) a, range(2) b) c "
    "JOIN q ON q.x = least(CAST(floor(px) AS BIGINT) + cx, 7) AND q.y = least(CAST(floor(py) AS BIGINT) + cy, 5)) "
)


def _points(s, d) -> tuple[DataFrame, DataFrame]:
    grid = _plane(s, d).groupBy("x", "y").agg(F.sum("value").alias("value"))
    return grid, _t(s, d, "events").select("event_id", (F.col("event_id") % 70 / 10.0).alias("px"), (F.col("event_id") % 30 / 6.0).alias("py"))


@query(_POINTS + "SELECT event_id, round(sum(value * w), 6) AS value FROM k GROUP BY 1")
def grid_sample_2d(s, d):
    grid, points = _points(s, d)
    return GR.grid_sample(grid, points, _SIZES, {"x": "px", "y": "py"}).select("event_id", _r(F.col("value"), 6).alias("value"))


@query(_POINTS + "SELECT event_id, CAST(corner AS INTEGER) AS corner, round(value, 3) AS value FROM k")
def closest_grid_values(s, d):
    grid, points = _points(s, d)
    return GR.closest_grid_values(grid, points, _SIZES, {"x": "px", "y": "py"}).select("event_id", "corner", _r(F.col("value"), 3).alias("value"))


@query(_PLANE + ", q AS (SELECT x, y, sum(value) AS value FROM g GROUP BY ALL) SELECT a.x - 2 AS x, a.y - 1 AS y, round(0.5 * a.value + 0.5 * b.value, 4) AS value FROM q a JOIN q b ON b.x = a.x + 1 AND b.y = a.y WHERE a.x BETWEEN 2 AND 5 AND a.y BETWEEN 1 AND 3")
def sample_subgrid(s, d):
    grid, _ = _points(s, d)
    return _rounded(GR.sample_subgrid(grid, _SIZES, {"x": 2.5, "y": 1.0}, {"x": 4, "y": 3}), "value", n=4)


@query(_BAL + "SELECT g.x, CASE WHEN g.i BETWEEN 0 AND 24 THEN 1 ELSE -1 END * b.value AS value FROM g JOIN b ON b.x = least(((g.i % 50) + 50) % 50, 49 - ((g.i % 50) + 50) % 50)")
def pad_antisymmetric(s, d):
    return B.pad(_balances(s, d), "x", 25, 3, 5, B.antisymmetric)


@query(_BAL + "SELECT g.x, CASE WHEN g.i BETWEEN 0 AND 24 THEN 1 ELSE -1 END * b.value AS value FROM g JOIN b ON b.x = least(((g.i % 48) + 48) % 48, 48 - ((g.i % 48) + 48) % 48)")
def pad_antireflect(s, d):
    return B.pad(_balances(s, d), "x", 25, 3, 5, B.antireflect)


@query(_BAL + "SELECT g.x, round(CASE WHEN g.i BETWEEN 0 AND 24 THEN b.value ELSE 2 * e.value - b.value END, 2) AS value FROM g JOIN b ON b.x = least(((g.i % 48) + 48) % 48, 48 - ((g.i % 48) + 48) % 48) JOIN b e ON e.x = CASE WHEN g.i < 12.5 THEN 0 ELSE 24 END")
def pad_symmetric_gradient(s, d):
    return _rounded(B.pad(_balances(s, d), "x", 25, 3, 5, B.symmetric_gradient), "value", n=2)


@query(_BAL + "SELECT g.x, coalesce(b.value, 7.0) AS value FROM g LEFT JOIN b ON b.x = CASE WHEN g.i < 0 THEN g.i + 25 WHEN g.i < 25 THEN g.i END")
def pad_mixed_sides(s, d):
    return B.pad(_balances(s, d), "x", 25, 3, 5, (B.periodic, 7.0))


@query(_BAL.rsplit(", g AS", 1)[0] + " SELECT x - 2 AS x, value FROM b WHERE x BETWEEN 2 AND 20")
def pad_negative(s, d):
    return B.pad(_balances(s, d), "x", 25, -2, -4, B.boundary)


# --- frames: operators, reductions and structure ---------------------------------------------------


def _customers(s, d) -> TensorFrame:
    df = _t(s, d, "customer").select(F.col("c_nationkey").cast("long").alias("nation"), "c_custkey", F.col("c_acctbal").alias("value"))
    return TensorFrame(df, merge_shapes(batch(nation=25), instance("c_custkey")))


@query("SELECT CAST(c_nationkey AS BIGINT) AS nation, c_custkey, (c_acctbal >= 0 AND c_acctbal < 5000) OR c_acctbal = 9000 AS value FROM customer")
def compare_and_logic(s, d):
    t = _customers(s, d)
    return ((t >= 0) & (t < 5000) | (t == 9000)).df


@query("SELECT CAST(c_nationkey AS BIGINT) AS nation, c_custkey, CAST(floor(c_acctbal / 700) AS BIGINT) AS q, round(c_acctbal - 700 * floor(c_acctbal / 700), 3) AS r, round(abs(c_acctbal) ** 0.5, 5) AS p FROM customer")
def floor_divide_mod_power(s, d):
    t = _customers(s, d)
    q, r, p = (t // 700).cast("bigint").df.withColumnRenamed("value", "q"), _rounded((t % 700).df, "value", n=3).withColumnRenamed("value", "r"), _rounded((abs(t) ** 0.5).df, "value", n=5).withColumnRenamed("value", "p")
    return q.join(r, ["nation", "c_custkey"]).join(p, ["nation", "c_custkey"])


@query("SELECT CAST(o_custkey AS BIGINT) AS cust, o_orderkey, xor(o_orderkey & 255, 5) | 1024 AS bits, (o_orderkey << 2) >> 1 AS moved FROM orders")
def bit_operators(s, d):
    df = _t(s, d, "orders").select(F.col("o_custkey").cast("long").alias("cust"), "o_orderkey", F.col("o_orderkey").cast("long").alias("value"))
    t = TensorFrame(df, merge_shapes(batch("cust"), instance("o_orderkey")))
    bits, moved = (((t & 255) ^ 5) | 1024).df.withColumnRenamed("value", "bits"), ((t << 2) >> 1).df.withColumnRenamed("value", "moved")
    return bits.join(moved, ["cust", "o_orderkey"])


@query("WITH a AS (SELECT l_suppkey AS supp, l_partkey AS part, sum(l_quantity) AS v FROM lineitem GROUP BY ALL), p AS (SELECT p_partkey AS part, p_size AS v FROM part) SELECT supp, round(sum(a.v * p.v), 1) AS value FROM a JOIN p USING (part) GROUP BY 1")
def contract_dual(s, d):
    a = TensorFrame(L.sum_duplicates(_t(s, d, "lineitem").select(F.col("l_suppkey").alias("supp"), F.col("l_partkey").alias("~part"), F.col("l_quantity").alias("value")), "supp", "~part"), merge_shapes(instance("supp"), Shape((Dim("part", "dual"),))))
    p = TensorFrame(_t(s, d, "part").select(F.col("p_partkey").alias("part"), F.col("p_size").cast("double").alias("value")), instance("part"))
    return (a @ p).df.withColumn("value", _r(F.col("value"), 1))


@query("SELECT CAST(c_nationkey AS BIGINT) AS nation, arg_max(c_custkey, (c_acctbal, -c_custkey)) AS largest, arg_min(c_custkey, (c_acctbal, c_custkey)) AS smallest FROM customer GROUP BY 1")
def arg_extremes(s, d):
    t = _customers(s, d)
    a, b = (x.df.withColumnRenamed("c_custkey", n) for x, n in ((t.argmax(), "largest"), (t.argmin(), "smallest")))
    return a.join(b, "nation")


@query("SELECT CAST(c_nationkey AS BIGINT) AS nation, CAST(least(floor((c_acctbal + 1000) / 1100.0), 9) AS BIGINT) AS bin, count(*) AS value FROM customer WHERE c_acctbal BETWEEN -1000 AND 10000 GROUP BY ALL")
def histogram_by_nation(s, d):
    return _customers(s, d).histogram(-1000.0, 10000.0, 10).df


@query("SELECT CAST(c_nationkey AS BIGINT) AS nation, bool_or(c_acctbal > 9000) AS some, bool_and(c_acctbal > -900) AS every, round(sum(c_acctbal), 2) AS isum, round(avg(c_acctbal), 4) AS imean, max(c_acctbal) AS imax FROM customer GROUP BY 1")
def typed_reductions(s, d):
    t = _customers(s, d)
    parts = [(t > 9000).any().df.withColumnRenamed("value", "some"), (t > -900).all().df.withColumnRenamed("value", "every")]
    parts += [_rounded(TYPED[n](t).df, "value", n=k).withColumnRenamed("value", n) for n, k in (("isum", 2), ("imean", 4), ("finite_imax", 4))]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, "nation")
    return out.withColumnRenamed("finite_imax", "imax")


@query("SELECT l_orderkey * 8 + l_linenumber AS flat, l_quantity AS value, l_orderkey // 2 AS half, l_orderkey % 2 AS odd FROM lineitem")
def pack_flatten_unpack(s, d):
    df = _t(s, d, "lineitem").select(F.col("l_orderkey").cast("long").alias("order"), F.col("l_linenumber").cast("long").alias("line"), F.col("l_quantity").alias("value"))
    t = TensorFrame(df, merge_shapes(instance("order"), instance(line=8)))
    back = t.flatten().unpack("flat", order=1 << 40, line=8).unpack("order", half=1 << 39, odd=2).pack(["half", "odd", "line"], "flat")
    return back.df.select("flat", "value", F.floor(F.col("flat") / 16).alias("half"), (F.floor(F.col("flat") / 8) % 2).alias("odd"))


@query("SELECT c.range AS copy, CAST(s_nationkey AS BIGINT) AS nation, round(sum(s_acctbal), 2) AS value FROM supplier, range(3) c WHERE s_nationkey NOT BETWEEN 5 AND 9 GROUP BY ALL")
def expand_slice_off(s, d):
    t = _nations(s, d, "supplier", "s_nationkey", "s_acctbal")
    out = t.slice_off(nation=slice(5, 10)).expand(copy=3)
    return out.map(lambda c: _r(c, 2)).df.withColumn("nation", F.when(F.col("nation") >= 5, F.col("nation") + 5).otherwise(F.col("nation")))


@query("SELECT l_returnflag, l_linestatus, CAST(c AS BIGINT) AS component, round(CASE c WHEN 0 THEN sum(l_quantity) WHEN 1 THEN sum(l_extendedprice) ELSE sum(l_discount) END, 2) AS value FROM lineitem, range(3) r(c) GROUP BY l_returnflag, l_linestatus, c")
def components_to_rows(s, d):
    return _lineitem(s, d).sum().components_to_rows("component").map(lambda c: _r(c, 2)).df


@query("SELECT CAST(c_nationkey AS BIGINT) AS nation, round(sum(c_acctbal), 2) AS customer, round(any_value(s.v), 2) AS supplier FROM customer JOIN (SELECT s_nationkey, sum(s_acctbal) AS v FROM supplier GROUP BY 1) s ON s_nationkey = c_nationkey GROUP BY 1")
def concat_components(s, d):
    a, b = _nations(s, d, "customer", "c_nationkey", "c_acctbal"), _nations(s, d, "supplier", "s_nationkey", "s_acctbal")
    named = lambda t, n: TensorFrame(t.df.withColumnRenamed("value", n), t.dims, (n,))
    return ncat([named(a, "customer"), named(b, "supplier")], "vector").map(lambda c: _r(c, 2)).df


# --- vectors and sparse matrices -------------------------------------------------------------------

_VEC = "WITH v AS (SELECT vec_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z, embedding[4]::DOUBLE AS u, embedding[5]::DOUBLE AS w, embedding[6]::DOUBLE AS q FROM embeddings) "


@query(_VEC + "SELECT vec_id, round(y * q - z * w, 5) + 0.0 AS cx, round(z * u - x * q, 5) + 0.0 AS cy, round(x * w - y * u, 5) + 0.0 AS cz, round(x * cos(z) - y * sin(z), 5) + 0.0 AS rx, round(x * sin(z) + y * cos(z), 5) + 0.0 AS ry, round(x * least(sqrt(x * x + y * y), 0.1) / sqrt(x * x + y * y), 5) + 0.0 AS sx FROM v")
def vector_functions(s, d):
    e = [F.get("embedding", i).cast("double") for i in range(6)]
    c, r, k = V.cross(e[:3], e[3:]), V.rotate(e[:2], e[2]), V.clip_length(e[:2], 0.0, 0.1)
    return _rounded(_t(s, d, "embeddings").select("vec_id", *[x.alias(n) for n, x in zip(("cx", "cy", "cz", "rx", "ry", "sx"), [*c, *r, k[0]], strict=True)]), "cx", "cy", "cz", "rx", "ry", "sx", n=5)


def _line_matrix(s, d) -> DataFrame:
    m = _t(s, d, "lineitem").join(_t(s, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).select(F.col("s_nationkey").cast("long").alias("row"), (F.col("l_linenumber") - 1).cast("long").alias("col"), F.col("l_quantity").alias("value"))
    return m.where(F.col("row") != F.col("col") + 3)


_MATRIX = "WITH m AS (SELECT CAST(s_nationkey AS BIGINT) AS row, CAST(l_linenumber - 1 AS BIGINT) AS col, l_quantity AS value FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE s_nationkey <> l_linenumber + 2), a AS (SELECT row, col, sum(value) AS value FROM m GROUP BY ALL) "


@query(_MATRIX + "SELECT r.range AS row, c.range AS col, round(coalesce(a.value, 0), 1) AS value FROM range(25) r CROSS JOIN range(7) c LEFT JOIN a ON a.row = r.range AND a.col = c.range")
def sparse_to_dense(s, d):
    return SP.dense(_line_matrix(s, d), {"row": 25, "col": 7}).select("row", "col", _r(F.col("value"), 1).alias("value"))


@query(_MATRIX + "SELECT row, col, round(value, 1) AS value FROM a WHERE row <> col UNION ALL SELECT range, range, 1.0 FROM range(7)")
def with_diagonal(s, d):
    a = L.sum_duplicates(_line_matrix(s, d), "row", "col")
    return SP.with_diagonal(a, "row", "col", 1.0, 7).select("row", "col", _r(F.col("value"), 1).alias("value"))


@query(_MATRIX + "SELECT row, round(sum(value * (col + 1)), 1) AS csr, round(sum(value * (col + 1)), 1) AS compact, round(sum(value * (col + 1)), 1) AS moved FROM a GROUP BY 1")
def matrix_vector_formats(s, d):
    a = L.sum_duplicates(_line_matrix(s, d), "row", "col")
    x = s.range(7).select(F.col("id").alias("col"), (F.col("id") + 1).cast("double").alias("x"))
    csr = SP.dot_csr(L.to_csr(a, "row", "col", "value"), x, "row", "col", "x").select("row", _r(F.col("x"), 1).alias("csr"))
    compact = SP.dot_compact(SP.to_compact(a, "row", "col"), x, "row", "col", "x").select("row", _r(F.col("x"), 1).alias("compact"))
    moved = L.matvec(SP.transpose(SP.transpose(a, "row", "col"), "row", "col"), x, "row", "col", "value", "x").select("row", _r(F.col("x"), 1).alias("moved"))
    return csr.join(compact, "row").join(moved, "row")


@query(_MATRIX + "SELECT c_custkey, col, round(value, 1) AS value FROM customer JOIN a ON row = c_nationkey")
def sparse_gather(s, d):
    at = _t(s, d, "customer").select("c_custkey", F.col("c_nationkey").cast("long").alias("at"))
    return SP.gather_rows(L.sum_duplicates(_line_matrix(s, d), "row", "col"), "row", at, "at").select("c_custkey", "col", _r(F.col("value"), 1).alias("value"))


@query(_MATRIX + "SELECT 25 * b.range + row AS row, 7 * b.range + col AS col, round(value, 1) AS value FROM a, range(2) b")
def sparse_batch(s, d):
    a = L.sum_duplicates(_line_matrix(s, d), "row", "col")
    return SP.add_batch(a, "b", 2, "row", "col", 25, 7).select("row", "col", _r(F.col("value"), 1).alias("value"))


@query("WITH e AS (SELECT DISTINCT o_custkey, c_nationkey FROM orders JOIN customer ON c_custkey = o_custkey) SELECT e.o_custkey AS a, e.c_nationkey AS b, round(y.v - x.v, 2) AS value FROM e JOIN (SELECT c_custkey AS k, c_acctbal AS v FROM customer) x ON x.k = o_custkey JOIN (SELECT c_custkey AS k, c_acctbal AS v FROM customer) y ON y.k = c_nationkey")
def map_pairs(s, d):
    nodes = _t(s, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("value"))
    edges = _t(s, d, "orders").join(_t(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_custkey").alias("a"), F.col("c_nationkey").alias("b")).distinct()
    return SP.map_pairs(nodes, edges, "k", "a", "b", lambda x, y: _r(y - x, 2))


@query("SELECT l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope FROM lineitem GROUP BY 1")
def fit_hyperplane(s, d):
    """Of one explaining column, so that SQL can give it; tests fit more."""
    return L.fit_hyperplane(_t(s, d, "lineitem"), ["l_returnflag"], ["l_quantity"], "l_extendedprice").select("l_returnflag", _r(F.get("weights", 0)).alias("slope"))


@query("SELECT page_id, regexp_replace(url, '^(.*)/[^/]*$', '\\1') AS folder FROM pages WHERE url IS NOT NULL")
def split_paths(s, d):
    p = _t(s, d, "pages").where("url is not null")
    return p.select("page_id", IO.split_path(F.col("url"))[0].alias("folder"))


@query("WITH d AS (SELECT 100 + (s_suppkey % 3) AS k, s_suppkey AS id, s_acctbal AS x FROM supplier) SELECT a.id AS l_id, b.id AS r_id, round(least(abs(a.x - b.x), 11000 - abs(a.x - b.x)), 2) AS distance FROM d a JOIN d b ON least(abs(a.x - b.x), 11000 - abs(a.x - b.x)) <= 30")
def range_join_periodic(s, d):
    """Balances on a circle from -1,000 to 10,000."""
    p = _t(s, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("x"))
    return N.range_join_periodic(p, p, "x", 30.0, -1000.0, 10000.0).select("l_id", "r_id", _r(F.col("distance"), 2).alias("distance"))


# --- nearest points, radii, histograms, solvers and decompositions ---------------------------------

_PARTS = "WITH p AS (SELECT p_partkey AS id, p_retailprice AS x, p_size * 20.0 AS y, (p_partkey * 37 % 101) * 5.0 AS z FROM part), q AS (SELECT o_orderkey AS k, o_totalprice / 200 AS x, (o_orderkey * 31 % 1201) * 1.0 AS y, (o_custkey * 17 % 499) * 1.0 AS z FROM orders) "


def _places(s, d) -> tuple[DataFrame, DataFrame]:
    """Parts by price and size, and orders as places to ask from."""
    p = _t(s, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("x"), (F.col("p_size") * 20.0).alias("y"), (F.col("p_partkey") * 37 % 101 * 5.0).alias("z"))
    q = _t(s, d, "orders").select(F.col("o_orderkey").alias("k"), (F.col("o_totalprice") / 200).alias("x"), (F.col("o_orderkey") * 31 % 1201 * 1.0).alias("y"), (F.col("o_custkey") * 17 % 499 * 1.0).alias("z"))
    return p, q


@query(_PARTS + "SELECT k, struct_extract(r, 2) AS id, round(struct_extract(r, 1), 6) AS distance FROM (SELECT k, min(row(sqrt((p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y)), id)) AS r FROM q, p GROUP BY k)")
def nearest_2d(s, d):
    p, q = _places(s, d)
    return N.nearest(p, q, ["x", "y"], "id", "k").select("k", "id", _r(F.col("distance"), 6).alias("distance"))


@query(_PARTS + "SELECT k, struct_extract(r, 2) AS id, round(struct_extract(r, 1), 6) AS distance FROM (SELECT k, min(row(sqrt((p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y) + (p.z - q.z) * (p.z - q.z)), id)) AS r FROM q, p GROUP BY k)")
def nearest_3d(s, d):
    p, q = _places(s, d)
    return N.nearest(p, q, ["x", "y", "z"], "id", "k").select("k", "id", _r(F.col("distance"), 6).alias("distance"))


@query(
    "WITH c AS (SELECT s_suppkey AS id, s_acctbal AS x, (s_suppkey * 37 % 1000) * 1.0 AS y, CASE WHEN s_suppkey % 50 = 0 THEN 900.0 ELSE 20.0 + s_nationkey END AS radius FROM supplier), "
    "g AS (SELECT a.id AS l_id, b.id AS r_id, a.radius, abs(a.x - b.x) AS dx, least(abs(a.y - b.y), 1000 - abs(a.y - b.y)) AS dy FROM c a, c b) SELECT l_id, r_id, round(sqrt(dx * dx + dy * dy), 3) AS distance FROM g WHERE sqrt(dx * dx + dy * dy) <= radius"
)
def range_join_radii(s, d):
    """Suppliers on a cylinder, each with a reach of its own."""
    radius = F.when(F.col("s_suppkey") % 50 == 0, 900.0).otherwise(20.0 + F.col("s_nationkey"))
    p = _t(s, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("x"), (F.col("s_suppkey") * 37 % 1000 * 1.0).alias("y"), radius.alias("radius"))
    return N.range_join_radii(p, p, ["x", "y"], "radius", {"y": (0.0, 1000.0)}).select("l_id", "r_id", _r(F.col("distance"), 3).alias("distance"))


@query(
    "WITH v AS (SELECT l_returnflag, l_discount, CASE WHEN l_quantity > 45 THEN 'nan'::DOUBLE ELSE l_extendedprice END AS price, CASE WHEN l_quantity < 3 THEN -1.0 ELSE l_quantity END AS quantity FROM lineitem), "
    "b AS (SELECT l_returnflag, CASE WHEN price < 5000 THEN 0 WHEN price < 20000 THEN 1 WHEN price < 50000 THEN 2 ELSE 3 END AS p, CASE WHEN quantity < 1 THEN NULL WHEN quantity < 10 THEN 0 WHEN quantity < 25 THEN 1 ELSE 2 END AS q, l_discount FROM v WHERE NOT isnan(price) AND price BETWEEN 0 AND 90000 AND quantity BETWEEN 1 AND 45) "
    "SELECT f.l_returnflag, CAST(x.range AS BIGINT) AS bin_price, CAST(y.range AS BIGINT) AS bin_quantity, round(coalesce(sum(b.l_discount), 0), 2) AS value FROM (SELECT DISTINCT l_returnflag FROM lineitem) f CROSS JOIN range(4) x CROSS JOIN range(3) y LEFT JOIN b ON b.l_returnflag = f.l_returnflag AND b.p = x.range AND b.q = y.range GROUP BY 1, 2, 3"
)
def histogram_2d_weighted(s, d):
    """Discounts by uneven bins of price and quantity; some prices are NaN and some quantities lie outside."""
    t = _t(s, d, "lineitem").select("l_returnflag", "l_discount", F.when(F.col("l_quantity") > 45, F.lit(float("nan"))).otherwise(F.col("l_extendedprice")).alias("price"), F.when(F.col("l_quantity") < 3, -1.0).otherwise(F.col("l_quantity")).alias("quantity"))
    out = R.histogram_nd(t, ["l_returnflag"], {"price": [0, 5000, 20000, 50000, 90000], "quantity": [1, 10, 25, 45]}, "l_discount", fill=True)
    return out.withColumn("value", _r(F.col("value"), 2))


@query(
    "WITH RECURSIVE b AS (SELECT k.range AS half, CAST(n_nationkey AS BIGINT) AS x, round(coalesce(sum(c_acctbal) FILTER (c_custkey % 2 = k.range), 0), 2) AS value FROM nation CROSS JOIN range(2) k LEFT JOIN customer ON n_nationkey = c_nationkey GROUP BY 1, 2), "
    "f AS (SELECT half, 0 AS i, -1 / (8.0::DOUBLE + half) AS c, value / (8.0::DOUBLE + half) AS d FROM b WHERE x = 0 UNION ALL SELECT f.half, f.i + 1, -1 / (8 + f.half + 2 * f.c), (b.value + 2 * f.d) / (8 + f.half + 2 * f.c) FROM f JOIN b ON b.x = f.i + 1 AND b.half = f.half), "
    "r AS (SELECT half, CAST(24 AS BIGINT) AS i, d AS x FROM f WHERE i = 24 UNION ALL SELECT r.half, r.i - 1, f.d - f.c * r.x FROM r JOIN f ON f.i = r.i - 1 AND f.half = r.half) SELECT half, i AS row, round(x, 2) AS x FROM r"
)
def solve_nonsymmetric(s, d):
    """Two drifting systems over the nations, (8 or 9, -2 below, -1 above) x = balances of half of the customers, together."""
    n = _t(s, d, "nation").select(F.col("n_nationkey").cast("long").alias("row")).withColumn("half", F.explode(F.array(F.lit(0).cast("long"), F.lit(1).cast("long"))))
    c = _t(s, d, "customer").groupBy(F.col("c_nationkey").cast("long").alias("row"), (F.col("c_custkey") % 2).alias("half")).agg(F.sum("c_acctbal").alias("y"))
    y = n.join(c, ["row", "half"], "left").select("half", "row", _r(F.coalesce("y", F.lit(0.0)), 2).alias("y"))
    entries = F.array(F.struct(F.lit(0).alias("o"), (8.0 + F.col("half")).alias("value")), F.struct(F.lit(-1).alias("o"), F.lit(-2.0).alias("value")), F.struct(F.lit(1).alias("o"), F.lit(-1.0).alias("value")))
    a = n.select("half", "row", F.explode(entries).alias("e")).select("half", "row", (F.col("row") + F.col("e.o")).alias("col"), F.col("e.value").alias("value")).where("col between 0 and 24")
    return bicgstab(a, y, "row", "col", batch=["half"], tolerance=1e-9).select("half", "row", _r(F.col("x"), 2).alias("x"))


@query(
    "WITH v AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS c FROM embeddings), g AS (SELECT a.c AS i, b.c AS j, sum(a.x * b.x) AS v FROM v a JOIN v b USING (vec_id) GROUP BY 1, 2) "
    "SELECT 1 AS power, round(sum(v) FILTER (i = j), 2) AS moment FROM g UNION ALL SELECT 2, round(sum(v * v), 1) FROM g UNION ALL SELECT 3, round(sum(x.v * y.v * z.v), 0) FROM g x JOIN g y ON y.i = x.j JOIN g z ON z.i = y.j AND z.j = x.i"
)
def singular_moments(s, d):
    """Sums of the embeddings' singular values to the powers 2, 4 and 6: traces of powers of their Gram matrix."""
    values = D.svd(_t(s, d, "embeddings"), "vec_id", "embedding").values
    return s.createDataFrame([(k, round(float((values ** (2 * k)).sum()), n)) for k, n in ((1, 2), (2, 1), (3, 0))], "power int, moment double")


@query("SELECT vec_id, round(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])), 4) AS squared, round(list_sum(CAST(embedding AS DOUBLE[])), 4) + 0.0 AS total FROM embeddings")
def singular_vectors(s, d):
    """Rows put together again from singular vectors and values: their squared norms and sums."""
    out = D.svd(_t(s, d, "embeddings"), "vec_id", "embedding")
    scaled = F.zip_with("left", F.array(*[F.lit(float(x)) for x in out.values]), lambda u, x: u * x)
    sums = F.array(*[F.lit(float(x)) for x in out.right.sum(0)])
    return out.left.withColumn("us", scaled).select("vec_id", _r(L.dot_arrays(F.col("us"), F.col("us"))).alias("squared"), (_r(L.dot_arrays(F.col("us"), sums)) + 0.0).alias("total"))


from axisframe import function_queries  # noqa: E402, F401  registers its queries beside these
