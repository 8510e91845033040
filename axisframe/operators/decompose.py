"""Singular values and vectors of tall matrices: a tree of QR factors, then one-sided Jacobi on the small one.

Each task reduces its rows to one triangular factor; factors are stacked and reduced in groups until one is
left (TSQR: Demmel, Grigori, Hoemmen & Langou, 2012), whose size is the square of the columns. The driver
rotates its columns until they are orthogonal. No row of the matrix leaves its task for that.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from axisframe.plans.lineage import cut

#: Columns at most: what is held and sent is their square.
MOST_COLUMNS = 512
#: Rows that a task reduces at a time, and factors that meet in one.
BLOCK_ROWS, FAN_IN = 4096, 8
_FACTOR = pa.schema([("part", pa.int64()), ("factor", pa.binary())])


class SVD(NamedTuple):
    """``values`` by falling size; ``right`` has a row for each column of the matrix and a column for each value; ``left`` is (id, array)."""

    values: np.ndarray
    right: np.ndarray
    left: DataFrame


def triangle(rows: np.ndarray) -> np.ndarray:
    return np.linalg.qr(rows, mode="r")


def jacobi(r: np.ndarray, sweeps: int = 60, tolerance: float = 1e-15) -> tuple[np.ndarray, np.ndarray]:
    """Singular values and right vectors of a small matrix by one-sided rotations; all disjoint pairs of columns of a round turn together."""
    a, n = r.astype(np.float64).copy(), r.shape[1]
    v = np.eye(n)
    order = np.arange(n + n % 2)  # the round-robin schedule; an odd number of columns sits one out
    for _ in range(sweeps):
        off = 0.0
        for _ in range(len(order) - 1):
            p, q = order[: len(order) // 2], order[len(order) // 2 :][::-1]
            real = (p < n) & (q < n)
            p, q = p[real], q[real]
            x, y = a[:, p], a[:, q]
            alpha, beta, gamma = (x * x).sum(0), (y * y).sum(0), (x * y).sum(0)
            size = np.sqrt(alpha * beta)
            turn = (np.abs(gamma) > tolerance * size) & (size > 0)
            if turn.any():
                p, q, alpha, beta, gamma = p[turn], q[turn], alpha[turn], beta[turn], gamma[turn]
                off = max(off, float((np.abs(gamma) / size[turn]).max()))
                zeta = (beta - alpha) / (2 * gamma)
                t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.sqrt(1 + zeta * zeta))
                c = 1 / np.sqrt(1 + t * t)
                for m in (a, v):
                    x, y = m[:, p].copy(), m[:, q].copy()
                    m[:, p], m[:, q] = c * x - c * t * y, c * t * x + c * y
            order = np.r_[order[:1], order[-1:], order[1:-1]]
        if off <= tolerance:
            break
    s = np.sqrt((a * a).sum(0))
    by = np.argsort(-s, kind="stable")
    return s[by], v[:, by]


def svd(df: DataFrame, id_col: str, vector_col: str) -> SVD:
    """Of the matrix whose rows are the arrays of ``vector_col``, all of one length of at most ``MOST_COLUMNS``.

    Rows with a null array take no part, those with null, NaN or infinite entries, or of another length, raise.
    An empty table has no values. Signs of vectors are such that each right vector's entry of largest size is
    positive; vectors of equal values are any basis of theirs. Left vectors of values that are 0 to rounding are 0.
    """
    x = F.transform(F.col(vector_col), lambda v: v.cast("double"))
    rows = df.select(F.col(id_col), x.alias("__x")).where("__x is not null")
    bad = F.exists("__x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    seen = rows.agg(F.min(F.size("__x")).alias("least"), F.max(F.size("__x")).alias("most"), F.coalesce(F.bool_or(bad), F.lit(False)).alias("bad")).first()
    n = seen["most"] or 0
    if seen["bad"] or (seen["least"] or 0) != n or n > MOST_COLUMNS:
        raise ValueError(f"rows need one length of at most {MOST_COLUMNS} and finite entries")

    def reduce_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((0, n))
        for batch in batches:
            flat = np.asarray(batch.column(0).flatten()).reshape(-1, n)
            for a in range(0, len(flat), BLOCK_ROWS):
                held = triangle(np.vstack([held, flat[a : a + BLOCK_ROWS]]))
        if len(held):
            from pyspark import TaskContext

            yield pa.record_batch([pa.array([TaskContext.get().partitionId()]), pa.array([held.tobytes()], pa.binary())], schema=_FACTOR)

    def reduce_factors(key: tuple, table: pa.Table) -> pa.Table:
        whole = np.vstack([np.frombuffer(b, np.float64).reshape(-1, n) for b in table.column("factor").to_pylist()])
        return pa.table([pa.array([key[0].as_py()], pa.int64()), pa.array([triangle(whole).tobytes()], pa.binary())], schema=_FACTOR)

    if not n:
        return SVD(np.zeros(0), np.zeros((n, 0)), rows.select(id_col, F.array().cast("array<double>").alias("left")))
    factors = cut(rows.select("__x").mapInArrow(reduce_rows, "part long, factor binary"), "svd-factors")
    while (count := factors.count()) > 1:
        # evenly many in each group, by the tasks' numbers
        groups = -(-count // FAN_IN)
        factors = cut(factors.groupBy(F.pmod("part", F.lit(groups)).alias("g")).applyInArrow(reduce_factors, "part long, factor binary"), "svd-factors")
    r = np.frombuffer(factors.first()["factor"], np.float64).reshape(-1, n)
    values, right = jacobi(r)
    values, right = values[: len(r)], right[:, : len(r)]
    lead = np.abs(right).argmax(0)
    right = right * np.where(right[lead, np.arange(right.shape[1])] < 0, -1.0, 1.0)
    weight = np.divide(right, values, out=np.zeros_like(right), where=values > n * np.finfo(float).eps * values[0])

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.asarray(batch.column(1).flatten()).reshape(-1, n) @ weight
            offsets = np.arange(0, out.size + 1, max(1, out.shape[1]), dtype=np.int32)
            yield pa.record_batch([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(out.ravel()))], names=[id_col, "left"])

    kind = rows.schema[id_col].dataType.simpleString()
    return SVD(values, right, rows.mapInArrow(project, f"`{id_col}` {kind}, left array<double>"))
