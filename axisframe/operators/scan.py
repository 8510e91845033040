"""Scans of long series: blocks are scanned apart and joined with the sums of the blocks before them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from axisframe.plans.lineage import cut

#: Places in a block: what one task sorts of a series.
BLOCK = 1 << 12


def key_of(keys: list[str]) -> Column:
    """Keys as one struct, in which nulls are equal: it groups, parts windows and joins alike, so null keys stay and nothing is shuffled twice."""
    return F.struct(*[F.col(k) for k in keys]) if keys else F.struct(F.lit(0).alias("__all"))


def _sums_before(totals: DataFrame, values: list[str], by: list[str], order: str) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return totals.withColumns({f"__o_{v}": F.coalesce(F.sum(f"__t_{v}").over(w), F.lit(0)) for v in values})


def blocked_sum(df: DataFrame, keys: list[str], order: str, values: list[str], include_0: bool = False, block: int = BLOCK, longest: int | None = None) -> DataFrame:
    """Running sums along the integer ``order`` of each key; a key's series is spread over its blocks.

    Null keys are a key. The sums of blocks are scanned in blocks of blocks, so no window has more than
    ``block`` rows until a series has block**3 places. With ``longest`` given and within a block, the series
    are scanned whole.
    """
    dealt = df.withColumn("__k", key_of(keys))
    rows = (Window.unboundedPreceding, -1) if include_0 else (Window.unboundedPreceding, 0)
    if longest is not None and longest <= block:
        w = Window.partitionBy("__k").orderBy(order).rowsBetween(*rows)
        return dealt.withColumns({v: F.coalesce(F.sum(v).over(w), F.lit(0)) for v in values}).select(*df.columns)
    dealt = dealt.withColumn("__b", F.coalesce(F.floor(F.col(order) / block).cast("long"), F.lit(-1)))
    inside = Window.partitionBy("__k", "__b").orderBy(order).rowsBetween(*rows)
    totals = dealt.groupBy("__k", "__b").agg(*[F.sum(v).alias(f"__t_{v}") for v in values]).withColumn("__bb", F.floor(F.col("__b") / block).cast("long"))
    wide = totals.groupBy("__k", "__bb").agg(*[F.sum(f"__t_{v}").alias(f"__t_{v}") for v in values])
    wide = _sums_before(wide, values, ["__k"], "__bb").select("__k", "__bb", *[F.col(f"__o_{v}").alias(f"__w_{v}") for v in values])
    offsets = _sums_before(totals, values, ["__k", "__bb"], "__b").join(wide, ["__k", "__bb"])
    offsets = offsets.select("__k", "__b", *[(F.col(f"__o_{v}") + F.col(f"__w_{v}")).alias(f"__o_{v}") for v in values])
    out = dealt.withColumns({v: F.coalesce(F.sum(v).over(inside), F.lit(0)) for v in values}).join(offsets, ["__k", "__b"])
    return out.withColumns({v: F.col(v) + F.col(f"__o_{v}") for v in values}).select(*df.columns)


def sorted_rank(df: DataFrame, keys: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    """Rank from 0 inside each group, of any size: rows are sorted over all tasks and numbered part by part.

    The sorted table is written once; a row's rank is its place in its part and group, and the group's rows in
    the parts before. Null keys are a group. Rows that tie in ``order`` come in any order.
    """
    rows = cut(df.withColumn("__k", key_of(keys)).orderBy("__k", *order).withColumn("__n", F.monotonically_increasing_id()).withColumn("__part", F.shiftright("__n", 33)), "sorted")
    sizes = rows.groupBy("__k", "__part").agg(F.count("*").alias("__c"))  # a group's parts are consecutive: as many as it fills
    before = Window.partitionBy("__k").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("__k", "__part", F.coalesce(F.sum("__c").over(before), F.lit(0)).alias("__before"))
    inside = F.row_number().over(Window.partitionBy("__k", "__part").orderBy("__n")) - 1
    return rows.withColumn("__i", inside).join(sizes, ["__k", "__part"]).select(*df.columns, (F.col("__i") + F.col("__before")).cast("long").alias(name))
