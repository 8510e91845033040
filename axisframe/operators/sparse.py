"""Sparse matrices as coordinate rows (row, col, value): formats, patterns and products."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from axisframe.operators.linalg import from_csr, matvec, sum_duplicates


def dense(coo: DataFrame, sizes: dict[str, int], value: str = "value") -> DataFrame:
    """Every cell of the sizes; repeated entries add up, cells without an entry hold 0."""
    from axisframe.operators.generators import meshgrid

    row, col = sizes
    grid = meshgrid(coo.sparkSession, **sizes)
    return grid.join(sum_duplicates(coo, row, col, value), [row, col], "left").withColumn(value, F.coalesce(value, F.lit(0.0)))


def sparsity(coo: DataFrame, volume: int) -> float:
    """Share of the cells that are stored."""
    return coo.count() / volume if volume else 0.0


def stored_values(coo: DataFrame, value: str = "value") -> DataFrame:
    return coo.select(value)


def stored_indices(coo: DataFrame, dims: list[str]) -> DataFrame:
    return coo.select(*dims)


def tensor_like(pattern: DataFrame, dims: list[str], values: DataFrame | Column, value: str = "value") -> DataFrame:
    """The pattern's entries with new values: an expression of its columns, or those of another table at the same indices."""
    if isinstance(values, DataFrame):
        return pattern.select(*dims).join(values, dims)
    return pattern.select(*dims, values.alias(value))


def same_pattern(a: DataFrame, b: DataFrame, dims: list[str]) -> bool:
    """Whether both store the same cells, the same number of times."""
    count = lambda t, n: t.groupBy(*dims).agg(F.count("*").alias(n))
    return count(a, "n").join(count(b, "m"), dims, "full").where("not (n <=> m)").isEmpty()


def transpose(coo: DataFrame, row: str, col: str) -> DataFrame:
    return coo.select(*[F.col(c).alias({row: col, col: row}.get(c, c)) for c in coo.columns])


def with_diagonal(coo: DataFrame, row: str, col: str, diagonal: DataFrame | float, size: int, value: str = "value") -> DataFrame:
    """The matrix with its diagonal replaced, by one value or by (row, value)."""
    off = coo.where(F.col(row) != F.col(col)).select(row, col, value)
    if not isinstance(diagonal, DataFrame):
        diagonal = coo.sparkSession.range(size).select(F.col("id").alias(row), F.lit(float(diagonal)).alias(value))
    return off.unionByName(diagonal.select(row, F.col(row).alias(col), value))


def gather_rows(coo: DataFrame, row: str, indices: DataFrame, at: str) -> DataFrame:
    """The matrix rows that the indices name, under the index rows' own columns."""
    return indices.join(coo.withColumnRenamed(row, at), at).drop(at)


def add_batch(coo: DataFrame, dim: str, size: int, row: str, col: str, n_rows: int, n_cols: int) -> DataFrame:
    """Block-diagonal matrix of ``size`` copies: a batch dimension baked into the pattern."""
    out = coo.withColumn(dim, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(size - 1).cast("long"))))
    return out.withColumn(row, F.col(dim) * n_rows + F.col(row)).withColumn(col, F.col(dim) * n_cols + F.col(col)).drop(dim)


def sparsified(wide: DataFrame, dims: list[str], components: list[str], dim: str, value: str = "value") -> DataFrame:
    """A dense dimension of columns as an index column."""
    pairs = [F.struct(F.lit(i).cast("long").alias(dim), F.col(c).cast("double").alias(value)) for i, c in enumerate(components)]
    return wide.select(*dims, F.explode(F.array(*pairs)).alias("c")).select(*dims, F.col(f"c.{dim}").alias(dim), F.col(f"c.{value}").alias(value))


def to_compact(coo: DataFrame, row: str, col: str, value: str = "value") -> DataFrame:
    """A row per matrix row with equally many slots: arrays of columns (-1 where a slot is empty) and values."""
    entries = coo.groupBy(row).agg(F.sort_array(F.collect_list(F.struct(F.col(col).alias("col"), F.col(value).alias("value")))).alias("e"))
    most = entries.agg(F.max(F.size("e"))).first()[0] or 0
    slots = F.transform(F.sequence(F.lit(0), F.lit(max(0, most - 1))), lambda i: F.coalesce(F.get("e", i), F.struct(F.lit(-1).cast("long").alias("col"), F.lit(0.0).alias("value"))))
    return entries.select(row, F.transform(slots, lambda s: s["col"]).alias("cols"), F.transform(slots, lambda s: s["value"]).alias("values"))


def compressed_to_compact(csr: DataFrame, row: str, entries: str = "entries") -> DataFrame:
    """From one array of entries a row, without going through single entries again."""
    most = csr.agg(F.max(F.size(entries))).first()[0] or 0
    slots = F.transform(F.sequence(F.lit(0), F.lit(max(0, most - 1))), lambda i: F.coalesce(F.get(entries, i), F.struct(F.lit(-1).cast("long").alias("col"), F.lit(0.0).alias("value"))))
    return csr.select(row, F.transform(slots, lambda s: s["col"]).alias("cols"), F.transform(slots, lambda s: s["value"]).alias("values"))


def from_compact(compact: DataFrame, row: str, col: str, value: str = "value") -> DataFrame:
    entries = F.filter(F.arrays_zip("cols", "values"), lambda e: e["cols"] >= 0)
    return compact.select(row, F.explode(entries).alias("e")).select(row, F.col("e.cols").alias(col), F.col("e.values").alias(value))


def dot_csr(csr: DataFrame, x: DataFrame, row: str, col: str, vec: str) -> DataFrame:
    """Product of a matrix in row arrays with a vector (col, vec)."""
    return matvec(from_csr(csr, row, col, "__m"), x, row, col, "__m", vec)


def dot_compact(compact: DataFrame, x: DataFrame, row: str, col: str, vec: str) -> DataFrame:
    return matvec(from_compact(compact, row, col, "__m"), x, row, col, "__m", vec)


def map_pairs(nodes: DataFrame, edges: DataFrame, node: str, origin: str, target: str, f, value: str = "value") -> DataFrame:
    """f(value at the origin, value at the target) of every stored pair."""
    a, b = (nodes.select(F.col(node).alias(side), F.col(value).alias(f"__{side}")) for side in (origin, target))
    return edges.join(a, origin).join(b, target).select(*edges.columns, f(F.col(f"__{origin}"), F.col(f"__{target}")).alias(value))
