"""Postings (a 64-bit key and a few numbers each) moved through a shuffle in packed runs.

A task collects postings, parts them by the leading bits of their keys and emits one row per bucket: column
after column, byte plane after byte plane, so that the shuffle's compression finds the zeros. The receiving
task unpacks a bucket at a time and sorts it by key. Spark partitions and moves the buckets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Postings that a task collects before it emits them: bounds its memory.
FLUSH = 1 << 18
#: Buckets per shuffle partition: a task holds one bucket at a time.
SPREAD = 2
PACKED = pa.schema([("bucket", pa.int32()), ("n", pa.int32()), ("data", pa.binary())])
PACKED_DDL = "bucket int, n int, data binary"


def bucket_bits(spark) -> int:
    """Leading bits that name a bucket, from the number of shuffle partitions."""
    return min(16, max(4, (SPREAD * int(spark.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length()))


def _planes(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()


class Packer:
    """Collects columns (the first one is the key, uint64) and gives packed runs by bucket."""

    def __init__(self, bits: int):
        self.bits, self.parts, self.n = bits, [], 0

    def add(self, *columns: np.ndarray) -> None:
        if len(columns[0]):
            self.parts.append(columns)
            self.n += len(columns[0])

    def taken(self) -> list[np.ndarray]:
        """All that was collected, as one array a column; the packer is empty then."""
        out = [np.concatenate(c) for c in zip(*self.parts, strict=True)]
        self.parts, self.n = [], 0
        return out

    def pack(self, columns: list[np.ndarray] | None = None) -> pa.RecordBatch:
        columns = self.taken() if columns is None else columns
        lead = (columns[0] >> np.uint64(48)).astype(np.uint16)
        order = np.argsort(lead, kind="stable")
        columns = [c[order] for c in columns]
        bucket = (lead[order] >> np.uint16(16 - self.bits)).astype(np.int32)
        at = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
        end = np.r_[at[1:], len(bucket)]
        data = [b"".join(_planes(c[a:b]) for c in columns) for a, b in zip(at.tolist(), end.tolist(), strict=True)]
        return pa.record_batch([pa.array(bucket[at]), pa.array((end - at).astype(np.int32)), pa.array(data, pa.binary())], schema=PACKED)


def dealt(packed: DataFrame) -> DataFrame:
    """Packed rows by bucket; those with a null bucket (dealt anyhow) come first in their partitions."""
    return packed.repartition(F.coalesce("bucket", F.hash("data"))).sortWithinPartitions("bucket")


def unpacked(n: int, data: memoryview, kinds: list[str]) -> list[np.ndarray]:
    out, at = [], 0
    for kind in kinds:
        size = np.dtype(kind).itemsize
        out.append(np.ascontiguousarray(np.frombuffer(data, np.uint8, n * size, at).reshape(size, n).T).view(kind).ravel())
        at += n * size
    return out


def buckets(batches: Iterator[pa.RecordBatch], kinds: list[str], loose_kinds: list[str] | None = None) -> Iterator[tuple[bool, list[np.ndarray]]]:
    """(false, columns sorted by key) of each bucket; (true, columns as packed) of each row without one."""
    held: list = []
    last = None

    def done() -> list[np.ndarray]:
        columns = [np.concatenate(c) for c in zip(*held, strict=True)]
        order = np.argsort(columns[0], kind="stable")
        return [c[order] for c in columns]

    for batch in batches:
        for bucket, n, data in zip(batch.column("bucket").to_pylist(), batch.column("n").to_pylist(), batch.column("data"), strict=True):
            if bucket is None:
                yield True, unpacked(n, data.as_buffer(), loose_kinds or kinds)
                continue
            if held and bucket != last:
                yield False, done()
                held = []
            last = bucket
            held.append(unpacked(n, data.as_buffer(), kinds))
    if held:
        yield False, done()


def loose(columns: list[np.ndarray]) -> pa.RecordBatch:
    """One packed row without a bucket: dealt anyhow and passed on by :func:`buckets`."""
    return pa.record_batch([pa.array([None], pa.int32()), pa.array([len(columns[0])], pa.int32()), pa.array([b"".join(map(_planes, columns))], pa.binary())], schema=PACKED)


def run_starts(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal keys start, and their lengths."""
    at = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    return at, np.diff(np.r_[at, len(key)])
