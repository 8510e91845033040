"""Exact duplicate documents: binary-fuse filters per immutable snapshot, exact buckets behind them.

An immutable snapshot's digests are dealt into buckets; each bucket gets a static 3-wise binary-fuse
filter (Graf & Lemire, 2022). Digests of an incoming batch are first grouped among themselves, then
screened by the filters. Only positives go on to the exact buckets, where digests are joined and the
normalised texts' bytes are compared. A filter has no false negatives, so results are exact.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from axisframe.llm._store import bitmap_of, cut, may_hold, new_folder

#: Distinct digests per filter: bounds a task's memory; more digests make more buckets.
BUCKET_KEYS = 250_000
FILTER_SCHEMA = "bucket long, seed long, segment long, segments long, cells binary"


def _slots(keys: np.ndarray, seed: int, segment: int, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """Three cells of each key, in consecutive segments, and its 8-bit fingerprint."""
    h = keys + np.uint64(seed) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    mask = np.uint64(segment - 1)
    a = ((h >> np.uint64(32)) * np.uint64(segments * segment)) >> np.uint64(32)
    b = (a + np.uint64(segment)) ^ ((h >> np.uint64(18)) & mask)
    c = (a + np.uint64(2 * segment)) ^ (h & mask)
    return np.stack([a, b, c], 1).astype(np.int64), ((h ^ (h >> np.uint64(32))) & np.uint64(255)).astype(np.uint8)


def build_filter(keys: np.ndarray) -> tuple[int, int, int, bytes]:
    """(seed, segment length, segments, cells) of a filter that holds all of the uint64 ``keys``."""
    keys = np.unique(keys)
    n = len(keys)
    if not n:
        return 0, 4, 1, bytes(12)
    segment = 1 << max(2, int(math.log(max(n, 2)) / math.log(3.33) + 2.25))
    factor = max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(max(n, 2)))
    segments = max(1, math.ceil(n * factor / segment) - 2)
    for seed in range(1, 1000):
        cell, mark = _slots(keys, seed, segment, segments)
        size = (segments + 2) * segment
        count = np.bincount(cell.ravel(), minlength=size)
        # the sum of the numbers of a cell's remaining keys: with one left, it is that key
        total = np.bincount(cell.ravel(), weights=np.repeat(np.arange(n, dtype=np.float64), 3), minlength=size).astype(np.int64)
        gone, rounds, front, left = np.zeros(n, bool), [], np.flatnonzero(count == 1), n
        while len(front):
            front = front[count[front] == 1]
            key, at = np.unique(total[front], return_index=True)
            if not len(key):
                break
            rounds.append((key, front[at]))
            gone[key] = True
            left -= len(key)
            touched = cell[key].ravel()
            np.subtract.at(count, touched, 1)
            np.subtract.at(total, touched, np.repeat(key, 3))
            front = np.unique(touched)
        if left:
            continue
        cells = np.zeros(size, np.uint8)
        for key, own in reversed(rounds):
            c = cell[key]
            cells[own] = 0
            cells[own] = mark[key] ^ cells[c[:, 0]] ^ cells[c[:, 1]] ^ cells[c[:, 2]]
        return seed, segment, segments, cells.tobytes()
    raise RuntimeError("no seed gives a filter")


def in_filter(keys: np.ndarray, seed: int, segment: int, segments: int, cells: bytes) -> np.ndarray:
    cell, mark = _slots(keys, seed, segment, segments)
    c = np.frombuffer(cells, np.uint8)
    return (c[cell[:, 0]] ^ c[cell[:, 1]] ^ c[cell[:, 2]]) == mark


def normalised(text: Column) -> Column:
    """The text without the six ASCII white-space characters; null is empty."""
    return F.translate(F.coalesce(text, F.lit("")), " \t\n\x0b\x0c\r", "")


def snapshot_filters(groups: DataFrame, buckets: int) -> DataFrame:
    """One filter row per bucket over the distinct ``key`` of ``groups``."""

    def build(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([[key[0], *build_filter(rows["key"].to_numpy().view(np.uint64))]], columns=["bucket", "seed", "segment", "segments", "cells"])

    return groups.select("key", F.pmod("key", F.lit(buckets)).alias("bucket")).distinct().groupBy("bucket").applyInPandas(build, FILTER_SCHEMA)


def screen(groups: DataFrame, filters: DataFrame, buckets: int) -> DataFrame:
    """The rows' distinct ``key`` that a filter may hold."""

    def test(rows: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        if not len(own) or not len(rows):
            return pd.DataFrame({"key": np.zeros(0, np.int64)})
        f = own.iloc[0]
        keys = rows["key"].to_numpy()
        return pd.DataFrame({"key": keys[in_filter(keys.view(np.uint64), int(f.seed), int(f.segment), int(f.segments), f.cells)]})

    dealt = groups.select("key", F.pmod("key", F.lit(buckets)).alias("bucket")).distinct()
    return dealt.groupBy("bucket").cogroup(filters.groupBy("bucket")).applyInPandas(test, "key long")


def _digests(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(f"`{text_col}`")
    return documents.select(F.col(f"`{id_col}`").alias("doc_id"), F.length(F.coalesce(text, F.lit(""))).alias("points"), F.unhex(F.sha2(normalised(text), 256)).alias("digest"))


def _groups(rows: DataFrame) -> DataFrame:
    """Per digest: the row that would stay (most code points, then smallest id, nulls last), how many rows, and a 64-bit key."""
    best = F.min(F.struct((-F.col("points")).alias("p"), F.col("doc_id").isNull().alias("z"), F.col("doc_id").alias("doc_id")))
    return rows.groupBy("digest").agg(best.alias("best"), F.count("*").alias("n")).withColumn("key", F.xxhash64("digest"))


def write_snapshot(documents: DataFrame, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> str:
    """Write an immutable snapshot's digests, groups and filters once, for any number of batches; returns the folder."""
    spark = documents.sparkSession
    folder = folder or new_folder(spark, "snapshot")
    _digests(documents, id_col, text_col).write.parquet(f"{folder}/rows")
    _groups(spark.read.parquet(f"{folder}/rows")).write.parquet(f"{folder}/groups")
    groups = spark.read.parquet(f"{folder}/groups")
    buckets = max(1, -(-groups.count() // BUCKET_KEYS))
    snapshot_filters(groups, buckets).withColumn("buckets", F.lit(buckets)).write.parquet(f"{folder}/filters")
    return folder


def dedup_batch(batch: DataFrame, folder: str, snapshot: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As :func:`exact_dedup` for a batch against the snapshot that :func:`write_snapshot` wrote to ``folder``.

    ``snapshot`` is the snapshot's table itself; only texts whose digests the batch has are read from it.
    """
    spark = batch.sparkSession
    old_rows, old, filters = (spark.read.parquet(f"{folder}/{n}") for n in ("rows", "groups", "filters"))
    buckets = filters.agg(F.max("buckets")).first()[0] or 1
    rows = cut(_digests(batch, id_col, text_col), "digests")
    new = cut(_groups(rows), "groups")
    positive = screen(new, filters.drop("buckets"), buckets)
    # exact buckets: digests of both sides, then the bytes of one text of each
    met = cut(new.join(positive, "key", "left_semi").join(old.select("digest", F.col("best.doc_id").alias("old_id")), "digest").select("digest", F.col("best.doc_id").alias("new_id"), "old_id"), "met")

    def bytes_of(documents: DataFrame, name: str) -> DataFrame:
        """One text's bytes of each digest that met, read by the ids of the rows that stay; rows with a null id are all looked at."""
        ids = met.select(F.xxhash64(f"{name}_id").alias("h"))
        docs = documents.select(F.col(f"`{id_col}`").alias("doc_id"), normalised(F.col(f"`{text_col}`")).alias("text")).where(F.col("doc_id").isNull() | may_hold(bitmap_of(ids, "h"), F.xxhash64("doc_id")))
        docs = docs.select(F.unhex(F.sha2("text", 256)).alias("digest"), F.col("text").cast("binary").alias("bytes"))
        return docs.join(met.select("digest"), "digest", "left_semi").groupBy("digest").agg(F.first("bytes").alias(name))

    same = met.select("digest").join(bytes_of(batch, "new"), "digest").join(bytes_of(snapshot, "old"), "digest").where("new = old").select("digest", F.lit(True).alias("same"))
    # a batch group whose bytes were confirmed joins the snapshot's group; any other stands alone
    side = F.col("old") | F.coalesce("same", F.lit(False))
    sided = old.withColumn("old", F.lit(True)).unionByName(new.withColumn("old", F.lit(False))).join(same, "digest", "left").withColumn("side", side)
    final = sided.groupBy("digest", "side").agg(F.min("best").alias("best"), F.sum("n").alias("group_size"))
    chosen = cut(sided.select("old", "digest", "side").join(final, ["digest", "side"]).select("old", "digest", F.col("best.doc_id").alias("keep_id"), "group_size"), "chosen")
    every = old_rows.withColumn("old", F.lit(True)).unionByName(rows.withColumn("old", F.lit(False)))
    return every.join(chosen, ["old", "digest"]).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"), F.col("old").alias("in_snapshot")
    )


def exact_dedup(documents: DataFrame, is_snapshot: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256, in_snapshot.

    ``is_snapshot`` parts the rows into the immutable snapshot (true) and the incoming batch (false or
    null). Texts are equal when their bytes without white space are equal. Of a group, the row with the
    most code points stays, then the smallest id (null ids last). Null text counts as empty; empty texts
    form one group. Rows that repeat an id, and those with a null one, count each in group_size and share
    its fate. Other columns are ignored. An empty table gives no rows.
    """
    old, new = documents.where(F.coalesce(is_snapshot, F.lit(False))), documents.where(~F.coalesce(is_snapshot, F.lit(False)))
    return dedup_batch(new, write_snapshot(old, id_col=id_col, text_col=text_col), old, id_col, text_col)
