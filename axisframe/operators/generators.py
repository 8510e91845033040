"""Creation operators: index ranges, even spacings and grids made by Spark's own ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def arange(spark: SparkSession, dim: str, start: int, stop: int, step: int = 1) -> DataFrame:
    """Index and value of evenly spaced integers, the stop excluded."""
    return spark.range(len(range(start, stop, step))).select(F.col("id").alias(dim), (start + step * F.col("id")).alias("value"))


def arange_each(df: DataFrame, dim: str, size: Column) -> DataFrame:
    """Every row once per index below its own size: a ragged dimension; rows of size 0 or less go."""
    return df.where(size > 0).withColumn(dim, F.explode(F.sequence(F.lit(0).cast("long"), size.cast("long") - 1)))


def linspace_each(df: DataFrame, dim: str, start: Column, stop: Column, number: int, value: str = "value") -> DataFrame:
    """Every row with ``number`` even steps from its start to its stop, both included."""
    out = df.withColumn(dim, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(number - 1).cast("long"))))
    return out.withColumn(value, start + (stop - start) * F.col(dim) / max(1, number - 1))


def meshgrid(spark: SparkSession, **sizes: int) -> DataFrame:
    """All index tuples of the sizes, from one range; the last name runs fastest."""
    from axisframe.operators.lookup import unravel

    volume = 1
    for n in sizes.values():
        volume *= n
    return spark.range(volume).select(*[c.cast("long").alias(n) for n, c in _ordered(unravel(F.col("id"), list(sizes), list(sizes.values())), sizes)])


def _ordered(columns: dict[str, Column], sizes: dict[str, int]) -> list[tuple[str, Column]]:
    return [(n, columns[n]) for n in sizes]


def fftfreq(index: Column, size: int, dx: float = 1.0) -> Column:
    """Sample frequency of each index of a discrete Fourier transform."""
    return F.when(index < (size + 1) // 2, index).otherwise(index - size) / F.lit(size * dx)


def random_uniform(df: DataFrame, name: str, low: float = 0.0, high: float = 1.0, seed: int = 0) -> DataFrame:
    return df.withColumn(name, low + (high - low) * F.rand(seed))


def random_normal(df: DataFrame, name: str, seed: int = 0) -> DataFrame:
    return df.withColumn(name, F.randn(seed))


def full(spark: SparkSession, value: float, **sizes: int) -> DataFrame:
    """Every cell of the sizes with one value."""
    return meshgrid(spark, **sizes).withColumn("value", F.lit(value))


def zeros(spark: SparkSession, **sizes: int) -> DataFrame:
    return full(spark, 0.0, **sizes)


def ones(spark: SparkSession, **sizes: int) -> DataFrame:
    return full(spark, 1.0, **sizes)


def zeros_like(df: DataFrame, values: list[str]) -> DataFrame:
    """The same cells with zeros."""
    return df.withColumns({v: F.lit(0.0) for v in values})


def ones_like(df: DataFrame, values: list[str]) -> DataFrame:
    return df.withColumns({v: F.lit(1.0) for v in values})


def range_tensor(spark: SparkSession, **sizes: int) -> DataFrame:
    """Every cell with its linear index, the first dimension outermost."""
    from axisframe.operators.lookup import ravel

    return meshgrid(spark, **sizes).withColumn("value", ravel(list(sizes), list(sizes.values())))


def kind_range(spark: SparkSession, kind: str, start: int = 0, **stop: int):
    """A frame of consecutive integers along a dimension of a kind."""
    from axisframe.frame import TensorFrame
    from axisframe.shape import Dim, Shape

    ((name, end),) = stop.items()
    dim = Dim(name, kind, end - start)
    return TensorFrame(arange(spark, dim.name, start, end), Shape((dim,)))
