"""Connected components by alternating large-star and small-star rounds (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from axisframe.llm._store import cut


def _state(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
    return r.n, r.x


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b) -> (id, root): root is the smallest id reachable; ids without an edge are absent.

    Every round is two aggregations with map-side combine joined back by key, so a hub with very many
    neighbours is no single-task group. Rounds are cut to the shared folder. Null ends are ignored.
    """
    e = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e = cut(e, "edges")
    before = _state(e)
    while before[0]:
        both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").union(low.select("a", F.col("m").alias("b"))).distinct()
        e = cut(small, "edges")
        after = _state(e)
        if after == before:
            break
        before = after
    return e.select(F.col("a").alias("id"), F.col("b").alias("root")).union(e.select(F.col("b"), F.col("b"))).distinct()


def joined_components(label: DataFrame, links: DataFrame) -> DataFrame:
    """``label`` (id, root) after further ``links`` (a, b); unchanged if there are none."""
    more = cut(links, "more-links")
    if more.isEmpty():
        return label
    return components(label.select(F.col("id").alias("a"), F.col("root").alias("b")).union(more))
