"""Reductions beyond plain aggregates. All are partial aggregations before their shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from axisframe.frame import TensorFrame
from axisframe.functions.elementwise import is_finite, nan
from axisframe.operators.scan import key_of
from axisframe.plans.lineage import cut
from axisframe.shape import DimFilter, non_batch


def min_nan(x: Column) -> Column:
    """NaN wins, as in the maximum."""
    return F.when(F.bool_or(F.isnan(x.cast("double"))), nan()).otherwise(F.min(x))


def _finite(x: Column) -> Column:
    return F.when(is_finite(x), x)


def finite_sum(x: Column) -> Column:
    return F.coalesce(F.sum(_finite(x)), nan())


def finite_mean(x: Column) -> Column:
    return F.coalesce(F.avg(_finite(x)), nan())


def finite_min(x: Column, default: float = float("nan")) -> Column:
    return F.coalesce(F.min(_finite(x)), F.lit(default))


def finite_max(x: Column, default: float = float("nan")) -> Column:
    return F.coalesce(F.max(_finite(x)), F.lit(default))


def finite_std(x: Column) -> Column:
    """Population standard deviation of the finite values."""
    return F.coalesce(F.stddev_pop(_finite(x)), nan())


def weighted_mean(tf: TensorFrame, weight: str, dim: DimFilter = non_batch, where_no_weight: float = float("nan")) -> TensorFrame:
    """Mean of the other components weighted by one; the given value where the weights sum to 0."""
    values = [v for v in tf.values if v != weight]
    total = F.sum(weight)
    rest = tf.dims.without(tf.dims.only(dim) if callable(dim) else dim)
    aggs = [F.when(total != 0, F.sum(F.col(v) * F.col(weight)) / F.when(total != 0, total)).otherwise(where_no_weight).alias(v) for v in values]
    return TensorFrame(tf.df.groupBy(*rest.names).agg(*aggs), rest, values)


#: Bins into which a selection round parts the values between its bounds, and values that are sorted at once in the end.
SELECT_BINS, SELECT_SMALL = 1 << 10, 1 << 16


def quantile(tf: TensorFrame, q: float | dict[str, float], dim: DimFilter = non_batch) -> TensorFrame:
    """Exact, linear between ranks, of the first component; NaN if there is no value. Several come as components."""
    rest = tf.dims.without(tf.dims.only(dim) if callable(dim) else dim)
    wanted = q if isinstance(q, dict) else {tf.values[0]: q}
    return TensorFrame(select_quantiles(tf.df, list(rest.names), tf.values[0], wanted), rest, list(wanted))


def select_quantile(df: DataFrame, keys: list[str], value: str, q: float, bins: int = SELECT_BINS, small: int = SELECT_SMALL) -> DataFrame:
    """Keys and the quantile of each group."""
    return select_quantiles(df, keys, value, {value: q}, bins, small)


def select_quantiles(df: DataFrame, keys: list[str], value: str, qs: dict[str, float], bins: int = SELECT_BINS, small: int = SELECT_SMALL) -> DataFrame:
    """Keys and a column for each of ``qs`` (name -> quantile), exact and linear between ranks, all found together.

    By selection: the wanted ranks of a group lie in intervals of values. A round counts each interval's values
    in bins; the bins that hold wanted ranks are the next intervals, bounded by their own least and greatest
    value, so that a far outlier is alone after one round. An interval of one value is done, and one of at most
    ``small`` values is sorted. No task gathers more of a group. NaN and null take no part; a group without
    other values gets NaN. Null keys are a group.
    """
    if not all(0 <= q <= 1 for q in qs.values()):
        raise ValueError("quantiles lie between 0 and 1")
    v = F.col(value).cast("double")
    rows = df.select(key_of(keys).alias("__k"), F.when(~F.isnan(v), v).alias("__v"))
    ends = rows.groupBy("__k").agg(F.count("__v").alias("__n"), F.min("__v").alias("__lo"), F.max("__v").alias("__hi"))
    place = {name: q * (F.col("__n") - 1) for name, q in qs.items()}
    ends = cut(ends, "quantile-ends")
    ranks = F.array_distinct(F.flatten(F.array(*[F.array(F.floor(p), F.ceil(p)) for p in place.values()])))
    found = ends.where("__n > 0").select("__k", "__lo", "__hi", F.lit(0).cast("long").alias("__before"), F.col("__n").alias("__c"), ranks.alias("__want"))
    rows = rows.where("__v is not null")

    def met(intervals: DataFrame) -> DataFrame:
        """Rows with the interval that they lie in; a group has two intervals a quantile, at most."""
        return rows.join(intervals, "__k").where((F.col("__v") >= F.col("__lo")) & (F.col("__v") <= F.col("__hi")))

    wide = F.col("__hi") - F.col("__lo")
    # halves, where the difference leaves the doubles; infinities go to the ends
    half = lambda c: F.greatest(F.least(c, F.lit(1.7e308)), F.lit(-1.7e308)) / 2
    share = F.when(wide < float("inf"), (F.col("__v") - F.col("__lo")) / F.when(wide > 0, wide)).otherwise((half(F.col("__v")) - half(F.col("__lo"))) / (half(F.col("__hi")) - half(F.col("__lo"))))
    while (found.where("__lo < __hi").agg(F.max("__c")).first()[0] or 0) > small:
        counted = met(found.where("__lo < __hi")).groupBy("__k", "__before", F.least(F.floor(share * bins), F.lit(bins - 1)).alias("__b"))
        counted = counted.agg(F.count("*").alias("__c"), F.min("__v").alias("__lo"), F.max("__v").alias("__hi"), F.first("__want").alias("__want"))
        before = F.col("__before") + F.sum("__c").over(Window.partitionBy("__k", "__before").orderBy("__b")) - F.col("__c")  # over at most ``bins`` rows
        counted = counted.withColumn("__start", before).withColumn("__want", F.filter("__want", lambda r: (r >= F.col("__start")) & (r < F.col("__start") + F.col("__c"))))
        counted = counted.where(F.size("__want") > 0).select("__k", "__lo", "__hi", F.col("__start").alias("__before"), "__c", "__want")
        found = cut(counted.unionByName(found.where("__lo = __hi")), "quantile-intervals")
    done = found.where("__lo = __hi").select("__k", F.explode("__want").alias("__r"), F.col("__lo").alias("__x"))
    ordered = met(found.where("__lo < __hi")).groupBy("__k", "__before").agg(F.sort_array(F.collect_list("__v")).alias("__s"), F.first("__want").alias("__want"))
    picked = F.transform("__want", lambda r: F.struct(r.alias("r"), F.get("__s", (r - F.col("__before")).cast("int")).alias("x")))
    picked = ordered.select("__k", F.explode(picked).alias("p")).select("__k", F.col("p.r").alias("__r"), F.col("p.x").alias("__x"))
    values = done.unionByName(picked).groupBy("__k").agg(F.map_from_entries(F.collect_list(F.struct("__r", "__x"))).alias("__at"))
    at = lambda r: F.try_element_at("__at", r.cast("long"))
    out = []
    for name, p in place.items():
        low, rest = at(F.floor(p)), p - F.floor(p)
        out.append(F.coalesce(F.when(rest == 0, low).otherwise(low + (at(F.ceil(p)) - low) * rest), nan()).alias(name))
    return ends.join(values, "__k", "left").select(*[F.col(f"__k.{k}").alias(k) for k in keys], *out)


def at_extreme(df: DataFrame, keys: list[str], value: str, order: list[str], largest: bool = True) -> DataFrame:
    """The row of each group with the largest (smallest) value; of equals, the first by ``order``.

    One aggregate of a struct, so groups are reduced before the shuffle. NaN is largest and never smallest.
    """
    others = [c for c in df.columns if c not in keys]
    first = F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)])
    best = F.max_by(F.struct(*others), F.struct(F.col(value), _reversed(order))) if largest else F.min_by(F.struct(*others), F.struct(F.col(value), first))
    return df.groupBy(*keys).agg(best.alias("r")).select(*keys, *[F.col(f"r.{c}") for c in others])


def _reversed(order: list[str]) -> Column:
    return F.struct(*[(-F.col(c)).alias(f"o{i}") for i, c in enumerate(order)])


def histogram(df: DataFrame, value: str, low: float, high: float, bins: int) -> DataFrame:
    """Counts of ``bins`` equal bins from ``low`` to ``high``, the last one closed; values outside and NaN don't count."""
    width = (high - low) / bins
    index = F.least(F.floor((F.col(value) - low) / width), F.lit(bins - 1)).cast("long")
    counted = df.where((F.col(value) >= low) & (F.col(value) <= high)).groupBy(index.alias("bin")).agg(F.count("*").alias("n"))
    return df.sparkSession.range(bins).withColumnRenamed("id", "bin").join(counted, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def bin_of(x: Column, edges: list[float]) -> Column:
    """The bin between sorted ``edges`` that holds a value, the last one closed; null for values outside, NaN and null.

    A binary search: each step of a fold over log2 of the bins halves what is left.
    """
    bins = len(edges) - 1
    if bins < 1 or any(a >= b for a, b in zip(edges, edges[1:], strict=False)):
        raise ValueError("edges rise, and there are two of them at least")
    held, x = F.array(*[F.lit(float(e)) for e in edges]), x.cast("double")
    start = F.struct(F.lit(0).alias("a"), F.lit(bins).alias("b"))
    middle = lambda s: F.shiftright(s["a"] + s["b"], 1)

    def half(s: Column, _: Column) -> Column:
        up = F.get(held, middle(s)) <= x
        return F.when(s["b"] - s["a"] <= 1, s).otherwise(F.struct(F.when(up, middle(s)).otherwise(s["a"]).alias("a"), F.when(up, s["b"]).otherwise(middle(s)).alias("b")))

    found = F.aggregate(F.sequence(F.lit(1), F.lit(bins.bit_length() + 1)), start, half, lambda s: s["a"])
    return F.when(~F.isnan(x) & (x >= float(edges[0])) & (x <= float(edges[-1])), found.cast("long"))


def histogram_nd(df: DataFrame, keys: list[str], edges: dict[str, list[float]], weight: str | None = None, name: str = "value", fill: bool = False) -> DataFrame:
    """Keys, a bin column bin_<column> for each of ``edges`` (column -> its rising edges), and the count or sum of weights.

    Bins are half open, the last one of a column closed; a row counts if all its columns lie inside. Values
    outside, NaN and null don't count, nor do rows of null weight; null keys are a key. ``fill`` gives empty
    bins 0, for every key that has rows.
    """
    bins = [f"bin_{c}" for c in edges]
    rows = df.select(*keys, *[bin_of(F.col(c), e).alias(b) for (c, e), b in zip(edges.items(), bins, strict=True)], *([F.col(weight).cast("double").alias("__w")] if weight else []))
    amount = F.sum("__w") if weight else F.count("*")
    inside = rows.where(" and ".join([f"`{b}` is not null" for b in bins] + ["__w is not null"] * bool(weight)))
    counted = inside.groupBy(*keys, *bins).agg(amount.alias(name))
    if not fill:
        return counted
    grid = df.select(*keys).distinct() if keys else df.sparkSession.range(1).select()
    for b, e in zip(bins, edges.values(), strict=True):
        grid = grid.withColumn(b, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(len(e) - 2).cast("long"))))
    zero = F.lit(0.0 if weight else 0).cast("double" if weight else "long")
    grid, counted = grid.withColumn("__c", key_of([*keys, *bins])), counted.select(key_of([*keys, *bins]).alias("__c"), name)
    return grid.join(counted, "__c", "left").select(*keys, *bins, F.coalesce(name, zero).alias(name))


def count_occurrences(values: DataFrame, queries: DataFrame, on: list[str]) -> DataFrame:
    """For every query row, how often its features occur among the values."""
    counted = values.groupBy(*on).agg(F.count("*").alias("n"))
    return queries.join(counted, on, "left").withColumn("n", F.coalesce("n", F.lit(0)))


def rank_of(df: DataFrame, keys: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    """Rank from 0 inside each group."""
    return df.withColumn(name, (F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1).cast("long"))

