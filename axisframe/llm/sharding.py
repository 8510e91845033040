"""Shards of near equal bytes: a minimax contiguous partition of groups of equal texts, with DataFrame functions only.

The groups come in a fixed order: those of at least 1/4096 of all bytes by falling size, then the others by
a hash of their text. The smallest capacity for which a greedy pass needs no more than the given shards is
found by binary search; the cuts are made under that capacity, each as near to an equal share of what is
left as the later shards allow. Greedy passes run over sums of hash ranges, a bounded table. A range that a
cut falls into is split further, until every cut stands between two groups, so the capacity is exact.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from axisframe.llm._store import cut

#: Bits of a text's key; the leading ones name hash ranges, of which the first pass sums 2**TOP_BITS. A range is split by MORE_BITS.
KEY_BITS, TOP_BITS, MORE_BITS = 60, 14, 6
#: Groups of at least 1/LARGE of all bytes, which are LARGE at most, are placed one by one.
LARGE = 4096


class Piece(NamedTuple):
    """A run of the ordered groups: one group, or a range of keys that can be split."""

    bytes: int
    split: bool
    depth: int  # leading bits of the range; -1: a large group
    prefix: int  # their value; of a large group its key


class Plan(NamedTuple):
    """Where the shards begin: the first key of each but the first one, the large groups' shards, and what was found on the way."""

    shards: int
    starts: list[int]
    large: DataFrame
    capacity: int
    sizes: list[int]


def text_key(text: Column) -> Column:
    """Leading 60 bits of the text's MD5; null is empty. Texts that share a key stay together."""
    return F.conv(F.substring(F.md5(F.coalesce(text, F.lit("")).cast("binary")), 1, KEY_BITS // 4), 16, 10).cast("long")


def text_size(text: Column) -> Column:
    return (F.octet_length(F.coalesce(text, F.lit(""))) + 1).cast("long")


class _Line:
    """Prefix sums of the pieces; notes which pieces that can be split a lookup fell into."""

    def __init__(self, pieces: list[Piece]):
        self.pieces, self.at, self.met = pieces, [0], set()
        for p in pieces:
            self.at.append(self.at[-1] + p.bytes)
        self.total = self.at[-1]

    def _inside(self, i: int, x: int) -> bool:
        if self.pieces[i].split:
            self.met.add(i)
            return True
        return False

    def floor(self, x: int) -> int:
        """The last boundary up to x; inside a piece that can be split, x itself."""
        i = bisect_right(self.at, x) - 1
        if self.at[i] == x or x >= self.total:
            return self.at[i]
        return x if self._inside(i, x) else self.at[i]

    def ceil(self, x: int) -> int:
        """The first boundary from x on; inside a piece that can be split, x itself."""
        i = bisect_left(self.at, x)
        if i == len(self.at) or self.at[i] == x:
            return min(x, self.total)
        return x if self._inside(i - 1, x) else self.at[i]

    def feasible(self, capacity: int, shards: int) -> bool:
        p = 0
        for _ in range(shards):
            p = self.floor(p + capacity)
        return p >= self.total

    def capacity(self, shards: int) -> int:
        """The smallest feasible capacity. It is exact if neither it nor the one below, tried last, meets a piece that can be split."""
        least = -(-self.total // shards)
        low, high = least, self.total
        while low < high:
            mid = (low + high) // 2
            low, high = (low, mid) if self.feasible(mid, shards) else (mid + 1, high)
        self.met.clear()
        self.feasible(low, shards)
        if low > least:
            self.feasible(low - 1, shards)
        return low

    def cuts(self, capacity: int, shards: int) -> list[int]:
        """Ends of all shards but the last one."""
        least = [self.total]  # from which the later shards can still take all
        for _ in range(shards - 1):
            least.append(self.ceil(max(0, least[-1] - capacity)))
        out, p = [], 0
        for left, low in zip(range(shards, 1, -1), least[:0:-1], strict=True):
            rest = self.total - p
            if rest:
                low, high = max(low, self.ceil(p + 1)), self.floor(p + capacity)
                x = min(max(p + rest // left, low), high)
                below, above = self.floor(x), min(high, self.ceil(x + 1))
                p = below if below > p and abs((below - p) * left - rest) <= abs((above - p) * left - rest) else above
            out.append(p)
        return out


def _ranges(groups: DataFrame, total: int, depth: int, prefixes: list[int] | None) -> list[Piece]:
    """Sums of the small groups' key ranges of 2**(60 - depth - more) keys, in order."""
    more = TOP_BITS if prefixes is None else min(MORE_BITS, KEY_BITS - depth)
    small = groups.where(F.col("bytes") * LARGE < total)
    if prefixes is not None:
        small = small.where(F.shiftright("key", KEY_BITS - depth).isin(prefixes))
    rows = small.groupBy(F.shiftright("key", KEY_BITS - depth - more).alias("prefix")).agg(F.sum("bytes").alias("bytes"), F.count("*").alias("n")).collect()
    return [Piece(r["bytes"], r["n"] > 1 and depth + more < KEY_BITS, depth + more, r["prefix"]) for r in sorted(rows, key=lambda r: r["prefix"])]


def plan_shards(groups: DataFrame, shards: int = 16) -> Plan:
    """Where to cut ``groups`` (key, bytes), one row for each key."""
    total = groups.agg(F.sum("bytes")).first()[0] or 0
    large = groups.where(F.col("bytes") * LARGE >= total)
    pieces = [Piece(r["bytes"], False, -1, r["key"]) for r in sorted(large.collect(), key=lambda r: (-r["bytes"], r["key"]))]
    pieces += _ranges(groups, total, 0, None)
    while True:
        line = _Line(pieces)
        capacity = line.capacity(shards)
        cuts = line.cuts(capacity, shards)
        if not line.met:
            break
        met: dict[int, list[int]] = {}
        for i in line.met:
            met.setdefault(pieces[i].depth, []).append(pieces[i].prefix)
        finer: dict[tuple[int, int], list[Piece]] = {}
        for depth, prefixes in met.items():
            for p in _ranges(groups, total, depth, prefixes):
                finer.setdefault((depth, p.prefix >> (p.depth - depth)), []).append(p)
        pieces = [q for i, p in enumerate(pieces) for q in (finer[p.depth, p.prefix] if i in line.met else [p])]
    first = [pieces[i] if (i := bisect_left(line.at, x)) < len(pieces) else None for x in cuts]
    # of the small groups, where each further shard begins: before all of them, at a range, or after them
    starts = [1 << KEY_BITS if p is None else 0 if p.depth < 0 else p.prefix << (KEY_BITS - p.depth) for p in first]
    # a large group's shard: how many cuts stand before it, by falling size and key
    behind = [F.lit(0)] + [((F.col("bytes") < p.bytes) | ((F.col("bytes") == p.bytes) & (F.col("key") >= p.prefix))).cast("int") for p in first if p is not None and p.depth < 0]
    ends = [0, *cuts, line.total]
    return Plan(shards, starts, large.select("key", reduce(Column.__add__, behind).alias("large_shard")), capacity, [b - a for a, b in zip(ends, ends[1:], strict=False)])


def with_shard(df: DataFrame, plan: Plan, key: str = "key", name: str = "shard") -> DataFrame:
    """``df`` with the shard of each row's ``key``; the broadcast side has at most LARGE rows."""
    by_key = reduce(Column.__add__, [F.lit(0), *[(F.col(key) >= x).cast("int") for x in plan.starts]])
    large = F.broadcast(plan.large.select(F.col("key").alias(key), "large_shard"))
    return df.join(large, key, "left").withColumn(name, F.coalesce("large_shard", by_key).cast("int")).drop("large_shard")


def _groups(rows: DataFrame) -> DataFrame:
    return cut(rows.groupBy("key").agg(F.sum("size").alias("bytes")), "shard-groups")


def shard_documents(documents: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document row: doc_id, size, text_crc32, law ('bytes'), shard, slot, grown_shard (null).

    Rows of equal texts share a shard; a null text counts as an empty one, of size 1. Slots count a shard's
    rows by rising id (nulls first), then key; rows that repeat an id and a text are interchangeable. A group
    beyond an equal share fills a shard of its own and the others share the rest; with fewer groups than
    shards some stay empty. An empty table gives no rows. Other columns are ignored.
    """
    text = F.col(f"`{text_col}`")
    rows = documents.select(F.col(f"`{id_col}`").alias("doc_id"), text_size(text).alias("size"), F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"), text_key(text).alias("key"))
    rows = cut(rows.withColumn("row", F.monotonically_increasing_id()), "shard-rows")
    placed = with_shard(rows, plan_shards(_groups(rows), shards))
    # in order, numbered by the part of the sort that they fell into and their place there; row parts even the rows of one id
    placed = cut(placed.orderBy(F.asc_nulls_first("doc_id"), "key", "row").withColumn("place", F.monotonically_increasing_id()).withColumn("part", F.shiftright("place", 33)), "shard-places")
    counts = placed.groupBy("shard", "part").agg(F.count("*").alias("n"))
    before = counts.select("shard", "part", F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("shard", "part").orderBy("place"))
    return placed.withColumn("inside", inside).join(before, ["shard", "part"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("inside") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


def write_shards(documents: DataFrame, folder: str, shards: int = 16, text_col: str = "text") -> Plan:
    """Write whole documents, all columns kept, below ``folder``/shard=<n>; returns the plan.

    The texts are read twice and never shuffled: a row's shard is an expression of its text. A shard is as
    many files as there were tasks with rows for it.
    """
    text = F.col(f"`{text_col}`")
    if "shard" in documents.columns:
        raise ValueError("the documents have a column named shard")
    plan = plan_shards(_groups(documents.select(text_size(text).alias("size"), text_key(text).alias("key"))), shards)
    key = "__shard_key"
    with_shard(documents.withColumn(key, text_key(text)), plan, key).drop(key).write.partitionBy("shard").parquet(folder)
    return plan
