"""Gather, scatter and masks: joins between an index and a grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Mode -> (aggregate, what cells without an entry hold).
MODES = {
    "add": (F.sum, 0.0), "mean": (F.avg, float("nan")), "max": (F.max, float("-inf")), "min": (F.min, float("inf")), "prod": (F.product, 1.0), "any": (F.bool_or, False), "all": (F.bool_and, True),
}


def gather(values: DataFrame, indices: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """The values at the indices; an index without a value is dropped (or kept with NULL by a left join)."""
    return indices.join(values, on, how)


def placed(entries: DataFrame, sizes: dict[str, int], outside: str = "discard") -> DataFrame:
    """Entries with their indices rounded and, beyond the grid, clamped to it, discarded or taken around."""
    from axisframe.operators.boundary import boundary, periodic

    at = {d: F.rint(F.col(d).cast("double")).cast("long") for d in sizes}
    if outside == "discard":
        moved = entries.withColumns(at)
        for d, n in sizes.items():
            moved = moved.where((F.col(d) >= 0) & (F.col(d) < n))
        return moved
    rule = {"clamp": boundary, "periodic": periodic}[outside]
    return entries.withColumns({d: rule(i, sizes[d]).cast("long") for d, i in at.items()})


def scatter(grid: DataFrame, entries: DataFrame, on: list[str], value: str, mode: str, base: Column | None = None, order: list[str] | None = None, name: str = "value") -> DataFrame:
    """Aggregate entries onto the cells of ``grid``; cells without one keep ``base`` or the mode's default.

    ``update`` keeps the last entry by ``order``. ``add`` and ``prod`` start from the base, ``max`` and ``min`` include it.
    """
    if mode == "update":
        hit = entries.groupBy(*on).agg(F.max_by(value, F.struct(*order)).alias("__v"))
        default = F.lit(float("nan"))
    else:
        f, missing = MODES[mode]
        hit, default = entries.groupBy(*on).agg(f(value).alias("__v")), F.lit(missing)
    out, v = grid.join(hit, on, "left"), F.col("__v")
    if base is not None and mode in ("add", "prod", "max", "min"):
        combined = {"add": v + base, "prod": v * base, "max": F.greatest(v, base), "min": F.least(v, base)}[mode]
    else:
        combined = v
    return out.withColumn(name, F.coalesce(combined, base if base is not None else default)).drop("__v")


def boolean_mask(df: DataFrame, dim: str, mask: Column, keys: list[str] | None = None) -> DataFrame:
    """Rows where the mask holds, re-numbered along ``dim`` inside each of ``keys``; a series is numbered by blocks."""
    return _counted(df.where(mask), dim, keys or []).withColumn(dim, F.col("__one") - 1).drop("__one")


def _counted(df: DataFrame, dim: str, keys: list[str]) -> DataFrame:
    from axisframe.operators.scan import blocked_sum

    return blocked_sum(df.withColumn("__one", F.lit(1).cast("long")), keys, dim, ["__one"])


def nonzero(df: DataFrame, dims: list[str], value: str) -> DataFrame:
    """Indices of the cells that hold something else than 0."""
    return df.where(F.col(value) != 0).select(*dims)


def nonzero_slices(df: DataFrame, keys: list[str], dim: str, mask: Column) -> DataFrame:
    """Runs of consecutive indices where the mask holds: start and stop (exclusive)."""
    runs = _counted(df.where(mask), dim, keys).withColumn("__g", F.col(dim) - F.col("__one"))
    return runs.groupBy(*keys, "__g").agg(F.min(dim).alias("start"), (F.max(dim) + 1).alias("stop")).drop("__g")


def contains(values: DataFrame, queries: DataFrame, on: list[str]) -> DataFrame:
    """Queries with a flag whether their features occur among the values."""
    return queries.join(values.select(*on).distinct().withColumn("__hit", F.lit(True)), on, "left").withColumn("found", F.coalesce("__hit", F.lit(False))).drop("__hit")


def ravel(dims: list[str], sizes: list[int]) -> Column:
    """Linear index, the first dimension outermost."""
    out = F.lit(0).cast("long")
    for d, n in zip(dims, sizes, strict=True):
        out = out * n + F.col(d)
    return out


def unravel(index: Column, dims: list[str], sizes: list[int]) -> dict[str, Column]:
    """The inverse of :func:`ravel`, in whole numbers of 64 bits."""
    out, rest = {}, index
    for d, n in reversed(list(zip(dims, sizes, strict=True))):
        out[d] = F.pmod(rest, F.lit(n))
        rest = F.call_function("div", rest - out[d], F.lit(n))
    return out
