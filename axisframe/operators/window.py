"""Scans and neighbourhood operators along one ordered dimension of each group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from axisframe.functions.elementwise import is_finite, nan
from axisframe.operators.scan import key_of


def over(keys: list[str], order: list[str]) -> Window:
    return Window.partitionBy(*keys).orderBy(*order)


def cumulative_sum(value: str, keys: list[str], order: list[str], include_0: bool = False) -> Column:
    """Running sum; with ``include_0`` that of what comes before."""
    w = over(keys, order)
    if include_0:
        return F.coalesce(F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    return F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, 0))


def shift(value: Column, keys: list[str], order: list[str], by: int, outside: str = "boundary") -> Column:
    """The value ``by`` places on; beyond an end: the own value ("boundary": for one place the end's), 0 or NaN."""
    w = over(keys, order)
    moved = F.lead(value, by).over(w) if by >= 0 else F.lag(value, -by).over(w)
    full = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    if outside == "boundary":  # one place beyond the end, the end is the own value
        edge = value if abs(by) <= 1 else F.last(value).over(full) if by >= 0 else F.first(value).over(full)
    else:
        edge = {"zero": F.lit(0.0), "nan": nan()}[outside]
    inside = (F.lead(F.lit(1), by) if by >= 0 else F.lag(F.lit(1), -by)).over(w).isNotNull()
    return F.when(inside, moved).otherwise(edge)


def gradient(value: Column, keys: list[str], order: list[str], dx: float = 1.0, difference: str = "central") -> Column:
    """Finite difference; ends repeat their value."""
    up, low = shift(value, keys, order, 1), shift(value, keys, order, -1)
    return {"central": (up - low) / (2 * dx), "forward": (up - value) / dx, "backward": (value - low) / dx}[difference]


def laplace(value: Column, keys: list[str], order: list[str], dx: float = 1.0) -> Column:
    return (shift(value, keys, order, 1) + shift(value, keys, order, -1) - 2 * value) / (dx * dx)


def neighbor_reduce(how, value: str, keys: list[str], order: list[str], low: int = -1, high: int = 1) -> Column:
    """Aggregate of a window of places around each one, cut at the ends."""
    return how(value).over(over(keys, order).rowsBetween(low, high))


def finite_fill(value: Column, keys: list[str], order: list[str], distance: int = 1) -> Column:
    """Non-finite values become the mean of the finite ones within ``distance`` places, or stay NaN."""
    w = over(keys, order).rowsBetween(-distance, distance)
    near = F.avg(F.when(is_finite(value), value)).over(w)
    return F.when(is_finite(value), value).otherwise(F.coalesce(near, nan()))


def convolve(value: Column, keys: list[str], order: list[str], kernel: list[float]) -> Column:
    """Cross-correlation with an odd kernel, zeros outside."""
    half = len(kernel) // 2
    out = F.lit(0.0)
    for i, k in enumerate(kernel):
        out = out + k * shift(value, keys, order, i - half, "zero") if i != half else out + k * value
    return out


def softmax(df: DataFrame, keys: list[str], value: str, name: str | None = None) -> DataFrame:
    """exp(value) over its sum in each group, by two aggregates joined back, so that no group is one task; null keys are a group."""
    name, rows = name or value, df.withColumn("__k", key_of(keys))
    most = rows.groupBy("__k").agg(F.max(value).alias("__m"))
    rows = rows.join(most, "__k").withColumn("__e", F.exp(F.col(value) - F.col("__m")))
    total = rows.groupBy("__k").agg(F.sum("__e").alias("__s"))
    return rows.join(total, "__k").withColumn(name, F.col("__e") / F.col("__s")).drop("__k", "__m", "__e", "__s")


def soft_max(value: Column, keys: list[str]) -> Column:
    """As :func:`softmax`, as a window expression for groups that fit a task."""
    w = Window.partitionBy(*keys)
    e = F.exp(value - F.max(value).over(w))
    return e / F.sum(e).over(w)
