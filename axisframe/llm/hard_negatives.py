"""Hard negatives by Fagin's threshold algorithm.

Vectors of whole numbers are dealt into segments, each with one sorted list per dimension. An anchor reads
the lists of its nonzero dimensions in parallel, from the top where its component is positive and from the
bottom where it is negative; what turns up first is scored in full. The inner product of the anchor with the
values reached bounds every vector not seen yet, so a segment is left once that threshold is strictly below
the last ranked score of every window (Fagin, Lotem & Naor, 2003). Positives are ranked first; each of them
opens a window of scores in which negatives are ranked. Anchors come in blocks; only ranked rows are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from axisframe.llm._store import bounded_batches, cut

#: Vectors of a segment, about: rows are dealt by a hash of their number, so no key makes a segment larger.
SEGMENT = 4096
#: Anchors of a block, about: what is sent to each task. More anchors make more blocks, each with its own passes.
ANCHORS = 1024
#: Rows that each list gives before the first test of the threshold; the depth doubles after each.
DEPTH = 4
#: Parts that one window's ranked rows are merged in first.
SALTS = 64

SEGMENT_DDL = "ids array<long>, nums binary, labels binary, vectors binary, lists binary"
LISTS = pa.schema([("ids", pa.list_(pa.int64())), ("nums", pa.binary()), ("labels", pa.binary()), ("vectors", pa.binary()), ("lists", pa.binary())])
RANKED = pa.schema([("anchor", pa.int64()), ("positive", pa.int64()), ("row", pa.int64()), ("id", pa.int64()), ("score", pa.int64())])
RANKED_DDL = "anchor long, positive long, row long, id long, score long"


class Anchor(NamedTuple):
    row: int
    label: int
    vector: np.ndarray


class Ranked:
    """The ``k`` best rows with scores from ``low`` to ``high``: higher scores first, then smaller ids, null ids last."""

    def __init__(self, k: int, low: int | None = None, high: int | None = None):
        self.k, self.low, self.high = k, low, high
        self.score, self.id, self.null, self.row = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64)

    def floor(self) -> int | None:
        """The least score that can still enter; None if any can."""
        return int(self.score[-1]) if len(self.score) == self.k else self.low

    def add(self, score: np.ndarray, ids: np.ndarray, null: np.ndarray, row: np.ndarray) -> None:
        floor = self.floor()
        fits = np.ones(len(score), bool) if floor is None else score >= floor
        if self.high is not None:
            fits &= score <= self.high
        i = np.flatnonzero(fits)
        if not len(i):
            return
        score, ids, null, row = np.r_[self.score, score[i]], np.r_[self.id, ids[i]], np.r_[self.null, null[i]], np.r_[self.row, row[i]]
        top = np.lexsort((row, ids, null, -score))[: self.k]
        self.score, self.id, self.null, self.row = score[top], ids[top], null[top], row[top]


class Lists:
    """A segment: vectors, and for each dimension their numbers by rising component."""

    def __init__(self, batch: pa.RecordBatch, i: int, kind: str, exact_in_double: bool):
        ids = batch.column("ids")[i].values
        self.null, self.id = np.asarray(ids.is_null()), np.asarray(ids.fill_null(0))
        self.row, self.label = (np.frombuffer(batch.column(c)[i].as_buffer(), np.int64) for c in ("nums", "labels"))
        n = len(self.row)
        self.order = np.frombuffer(batch.column("lists")[i].as_buffer(), np.int32).reshape(-1, n)
        whole = np.frombuffer(batch.column("vectors")[i].as_buffer(), kind).reshape(n, len(self.order))
        self.value = np.take_along_axis(whole.T.astype(np.int64), self.order, 1)
        self.vectors = whole.astype(np.float64 if exact_in_double else np.int64)

    def mine(self, a: Anchor, wanted: np.ndarray, windows: list[Ranked]) -> None:
        """Rank the ``wanted`` vectors in the windows."""
        vector = a.vector.astype(self.vectors.dtype)
        n, up, down = len(self.row), np.flatnonzero(a.vector > 0), np.flatnonzero(a.vector < 0)
        left = wanted & (self.row != a.row)
        t, step = 0, DEPTH
        while t < n:
            # no vector that isn't seen has more than this
            threshold = int(a.vector[up] @ self.value[up, n - 1 - t]) + int(a.vector[down] @ self.value[down, t])
            if all((f := w.floor()) is not None and threshold < f for w in windows):
                return
            end = min(n, t + step)
            met = np.zeros(n, bool)
            met[self.order[up, n - end : n - t].ravel()] = True
            met[self.order[down, t:end].ravel()] = True
            if not len(up) and not len(down):
                met[:], end = True, n
            new = np.flatnonzero(met & left)
            if len(new):
                left[new] = False
                score = (self.vectors[new] @ vector).astype(np.int64)
                for w in windows:
                    w.add(score, self.id[new], self.null[new], self.row[new])
            if not left.any():
                return
            t, step = end, 2 * step


def _segments(rows: DataFrame, n: int, dims: int, kind: str) -> DataFrame:
    """The written segments of rows (row, id, label, vector, seg)."""

    def build(table: pa.Table) -> pa.Table:
        lists = table.column("vector").combine_chunks()
        whole = np.zeros((len(lists), dims), np.int64)
        length = np.asarray(lists.value_lengths())
        whole[np.repeat(np.arange(len(lists)), length), np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)] = np.asarray(lists.flatten())
        order = np.argsort(whole.T, axis=1, kind="stable").astype(np.int32)
        out = [[table.column("id").to_pylist()], [np.asarray(table.column("row")).tobytes()], [np.asarray(table.column("label")).tobytes()], [whole.astype(kind).tobytes()], [order.tobytes()]]
        return pa.table([pa.array(x, f.type) for x, f in zip(out, LISTS, strict=True)], schema=LISTS)

    parts = max(1, -(-n // SEGMENT))
    return cut(rows.withColumn("seg", F.pmod(F.xxhash64("row"), F.lit(parts))).groupBy("seg").applyInArrow(build, SEGMENT_DDL), "vector-lists")


def _best(found: DataFrame, by: list[str], k: int) -> DataFrame:
    """The first ``k`` rows of each key, merged part by part first."""
    order = [F.desc("score"), F.asc_nulls_last("id"), F.asc("row")]
    found = found.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy(*by, "salt").orderBy(*order))).where(F.col("rank") <= k).drop("salt")
    return found.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)


def _pass(lists: DataFrame, anchors: list[Anchor], windows: dict[int, list[tuple[int, int | None, int | None]]], k: int, same_label: bool, kind: str, exact: bool) -> DataFrame:
    """Each task's best rows in the anchors' windows (positive row, low, high)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(a, [(p, Ranked(k, low, high)) for p, low, high in windows[a.row]]) for a in anchors if windows.get(a.row)]
        for batch in batches:
            for i in range(batch.num_rows):
                own = Lists(batch, i, kind, exact)
                for a, ranked in held:
                    own.mine(a, (own.label == a.label) == same_label, [r for _, r in ranked])
        for a, ranked in held:
            for p, r in ranked:
                if size := len(r.score):
                    yield pa.record_batch([pa.array(np.full(size, a.row)), pa.array(np.full(size, p)), pa.array(r.row), pa.array(r.id, mask=r.null), pa.array(r.score)], schema=RANKED)

    return lists.mapInArrow(run, RANKED_DDL)


def hard_negatives(vectors: DataFrame, is_anchor: Column, n_positives: int = 5, n_negatives: int = 10, low: int = 30, high: int = 90, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Components become floor(scale * x). Rows with a null label or vector, or a null, NaN or infinite
    component take no part; a shorter vector counts as filled up with zeros. An anchor's positives are its
    ``n_positives`` best other rows of its label; for each, the ``n_negatives`` best rows of other labels
    with scores from ``low`` to ``high`` per cent of the positive's are returned. Ties go to the smaller id,
    null ids last. Rows, not ids, tell anchors, positives and negatives apart, so rows that repeat an id each
    count. An anchor without positives, or without negatives in the window, has no rows. An empty table gives
    none. Other columns are ignored. Labels and ids are whole numbers; scores that could leave 64 bits raise.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    flag = F.coalesce(is_anchor, F.lit(False))
    x = F.transform(F.col(f"`{vector_col}`"), lambda v: v.cast("double") * scale)
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").cast("long").alias("label"), x.alias("x"), flag.alias("anchor"))
    rows = rows.where(F.col("label").isNotNull() & F.col("x").isNotNull()).where(F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))))
    rows = cut(rows.select("id", "label", F.transform("x", lambda v: F.floor(v)).alias("vector"), F.coalesce(F.array_max(F.transform("x", lambda v: F.abs(v))), F.lit(0.0)).alias("most"), "anchor", F.monotonically_increasing_id().alias("row")), "vectors")
    s = rows.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("dims"), F.max("most").alias("most"), F.sum(F.col("anchor").cast("long")).alias("anchors")).first()
    most, dims = int(s["most"] or 0) + 1, s["dims"] or 0
    if dims * most * most >= 1 << 63:
        raise ArithmeticError("inner products of these vectors could leave 64 bits")
    kind = next(k for k, bits in (("int16", 15), ("int32", 31), ("int64", 63)) if most < 1 << bits)
    exact = dims * most * most < 1 << 53
    lists = _segments(rows.select("row", "id", "label", "vector"), s["n"], dims, kind)
    blocks = max(1, -(-(s["anchors"] or 0) // ANCHORS))
    ids = rows.select("row", "id")
    out = []
    for block in range(blocks):
        own = rows.where(F.col("anchor") & (F.pmod(F.xxhash64("row"), F.lit(blocks)) == block)).select("row", "label", "vector").collect()
        anchors = [Anchor(r["row"], r["label"], np.array(r["vector"] + [0] * (dims - len(r["vector"])), np.int64)) for r in own]
        found = _pass(lists, anchors, {a.row: [(-1, None, None)] for a in anchors}, n_positives, True, kind, exact)
        positives = cut(_best(found, ["anchor"], n_positives).select("anchor", F.col("row").alias("positive"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
        windows: dict[int, list] = {}
        for p in positives.collect():  # n_positives for each anchor of the block, at most
            a, b = -(-low * p["positive_score"] // 100), high * p["positive_score"] // 100
            if a <= b:
                windows.setdefault(p["anchor"], []).append((p["positive"], a, b))
        found = _best(_pass(lists, anchors, windows, n_negatives, False, kind, exact), ["anchor", "positive"], n_negatives)
        out.append(found.select("anchor", "positive", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score")).join(positives, ["anchor", "positive"]))
    every = out[0]
    for more in out[1:]:
        every = every.unionByName(more)
    return every.join(ids.select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id")), "anchor").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
