"""Reductions of unbounded frames with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def windowed_reduce(stream: DataFrame, time: str, keys: list[str], aggregates: list[Column], width: str, late: str) -> DataFrame:
    """Aggregates per key and tumbling window; rows later than ``late`` behind the newest are dropped by the watermark."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width), *keys).agg(*aggregates).select(F.col("window.start").alias("start"), *keys, *[F.col(f"`{n}`") for n in _names(stream, time, width, keys, aggregates)])


def _names(stream: DataFrame, time: str, width: str, keys: list[str], aggregates: list[Column]) -> list[str]:
    return stream.groupBy(F.window(time, width), *keys).agg(*aggregates).columns[1 + len(keys) :]
