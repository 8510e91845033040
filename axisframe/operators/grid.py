"""Neighbourhood operators on grids of any number of dimensions.

A grid is a table with a column per index and a value column, and any columns as keys. Cells are dealt into tiles
with halos, inside which each finds its neighbours, so a grid of one key is spread over all tasks, only cells at
tiles' edges are copied, and no axis is a window of its own.
"""

from __future__ import annotations

from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from axisframe.functions.elementwise import is_finite, nan
from axisframe.operators.boundary import Rule, as_rule, boundary


def box(dims: int, reach: int = 1) -> list[tuple[int, ...]]:
    """All offsets of a cube around a cell, the cell included."""
    return list(product(range(-reach, reach + 1), repeat=dims))


def axes(dims: int, reach: int = 1) -> list[tuple[int, ...]]:
    """The cell itself, and the offsets along one axis each."""
    out = [(0,) * dims]
    for d in range(dims):
        out += [tuple(k if i == d else 0 for i in range(dims)) for k in range(-reach, reach + 1) if k]
    return out


#: Cells of a tile, about: what one task holds at a time of a grid, with the halo that it reads.
TILE_CELLS = 1 << 14


def tile_side(sizes: dict[str, int], reach: int) -> int:
    """Cells along a tile's edge; wider than the halo, so that a cell is copied to one more tile a dimension at most."""
    return max(2 * reach, round(TILE_CELLS ** (1 / len(sizes))), 1)


def _places(i: Column, n: int, side: int, reach: int, rule: Rule | None) -> Column:
    """Where a cell is read along a dimension: (tile, place in the tile with its halo, whether beyond the grid).

    Besides its own place a cell stands for the places beyond the grid that the rule takes from it.
    """
    beyond = [j for j in (*range(-reach, 0), *range(n, n + reach))] if rule is not None and rule.index is not None else []
    held = [F.when(rule.index(F.lit(j).cast("long"), n) == i, F.struct(F.lit(j).cast("long").alias("j"), F.lit(True).alias("out"))) for j in beyond]
    held = F.array_compact(F.array(F.struct(i.cast("long").alias("j"), F.lit(False).alias("out")), *held))
    last = F.lit((n - 1) // side).cast("long")
    low = lambda j: F.greatest(F.floor((j - reach) / side), F.lit(0).cast("long"))
    high = lambda j: F.least(F.floor((j + reach) / side), last)
    tiles = lambda x: F.transform(F.sequence(F.least(low(x["j"]), high(x["j"])), high(x["j"])), lambda t: F.struct(t.alias("tile"), (x["j"] - t * side + reach).alias("place"), x["out"].alias("out")))
    return F.flatten(F.transform(held, tiles))


def dealt(df: DataFrame, sizes: dict[str, int], reach: int, keys: list[str], values: list[str], rule: Rule | None, side: int) -> DataFrame:
    """The cells with where they are read, __p0, __p1, ...: a row for each tile, so some more at tiles' edges."""
    cells = df.select(*keys, *sizes, *values).where(reduce(lambda a, b: a & b, [(F.col(d) >= 0) & (F.col(d) < n) for d, n in sizes.items()]))
    for k, (d, n) in enumerate(sizes.items()):
        cells = cells.withColumn(f"__p{k}", F.explode(_places(F.col(d), n, side, reach, rule)))
    return cells


def around(df: DataFrame, sizes: dict[str, int], offsets: list[tuple[int, ...]], keys: list[str], values: list[str], rule: Rule | float | None = boundary) -> DataFrame:
    """Keys and indices of each cell, and ``near``: for each offset, in order, the values there as a struct.

    Beyond the grid the rule gives them (a constant also where cells are missing); without one, and where a cell
    is missing, the entry is null. Cells are dealt into tiles; those at a tile's edge go to the tiles that read
    them, too, and a tile's stencils are found inside it. So about each cell is shuffled once, whatever the number
    of offsets. Null keys are a key. Cells outside the sizes, and null indices, are none.
    """
    dims = list(sizes)
    reach = max(1, max((abs(s) for off in offsets for s in off), default=1))
    rule = None if rule is None else as_rule(rule)
    side = tile_side(sizes, reach)
    cells = dealt(df, sizes, reach, keys, values, rule, side)
    edge = {d: min(side, n) + 2 * reach for d, n in sizes.items()}
    stride, at = {}, 1
    for d in reversed(dims):
        stride[d] = at
        at *= edge[d]
    place = reduce(lambda a, b: a + b, [F.col(f"__p{k}.place") * stride[d] for k, d in enumerate(dims)]).cast("int")
    out = reduce(lambda a, b: a | b, [F.col(f"__p{k}.out") for k in range(len(dims))])
    sign = reduce(lambda a, b: a * b, [F.when(F.col(f"__p{k}.out"), -1.0).otherwise(1.0) for k in range(len(dims))]) if rule is not None and rule.flips else None
    held = F.struct(*[(F.col(v) if sign is None else F.col(v) * sign).alias(v) for v in values])
    own = ~out & reduce(lambda a, b: a & b, [(F.col(f"__p{k}.tile") == F.floor(F.col(d) / side)) for k, d in enumerate(dims)])
    entry = F.struct(place.alias("p"), own.alias("own"), held.alias("v"))
    tiles = cells.groupBy(*keys, *[F.col(f"__p{k}.tile").alias(f"__t{k}") for k in range(len(dims))]).agg(F.collect_list(entry).alias("__e"))
    # an empty entry for every place, then the last of each place: the cell if there is one
    none = F.transform(F.sequence(F.lit(0), F.lit(at - 1)), lambda p: F.struct(p.alias("p"), F.lit(None).cast("boolean").alias("own"), F.lit(None).cast(_struct_of(df, values, sign is not None)).alias("v")))
    tiles = tiles.withColumn("__e", F.sort_array(F.concat("__e", none)))
    tiles = tiles.withColumn("__e", F.filter("__e", lambda e, i: F.coalesce(F.get("__e", i + 1)["p"] != e["p"], F.lit(True))))
    shifts = [sum(s * stride[d] for s, d in zip(off, dims, strict=True)) for off in offsets]
    missing = F.struct(*[F.lit(rule.constant).alias(v) for v in values]) if rule is not None and rule.index is None else None

    def read(p: Column) -> Column:
        v = F.get("__e", p)["v"]
        return v if missing is None else F.coalesce(v, missing) if len(values) > 1 else F.struct(F.coalesce(v[values[0]], F.lit(rule.constant)).alias(values[0]))

    stencils = F.transform(F.filter("__e", lambda e: F.coalesce(e["own"], F.lit(False))), lambda e: F.struct(e["p"].alias("p"), F.array(*[read(e["p"] + s) for s in shifts]).alias("near")))
    found = tiles.select(*keys, *[f"__t{k}" for k in range(len(dims))], F.explode(stencils).alias("__s"))
    index = [(F.col(f"__t{k}") * side + F.call_function("div", F.col("__s.p"), F.lit(stride[d])) % edge[d] - reach).cast("long").alias(d) for k, d in enumerate(dims)]
    return found.select(*keys, *index, F.col("__s.near").alias("near"))


def _struct_of(df: DataFrame, values: list[str], double: bool) -> str:
    return "struct<" + ",".join(f"`{v}`:{'double' if double else df.schema[v].dataType.simpleString()}" for v in values) + ">"


def _at(offset: int, value: str) -> Column:
    return F.get("near", offset)[value]


def _there(value: str) -> Column:
    """The values of the neighbours that are there."""
    return F.transform(F.filter("near", lambda c: c.isNotNull()), lambda c: c[value])


def _total(values: Column) -> Column:
    """Sum of what isn't null; null if nothing is left."""
    kept = F.filter(values, lambda v: v.isNotNull())
    return F.when(F.size(kept) > 0, F.aggregate(kept, F.lit(0.0), lambda s, v: s + v))


def _mean(values: Column) -> Column:
    return _total(values) / F.size(F.filter(values, lambda v: v.isNotNull()))


def _weighted(weights: list[float], value: str) -> Column:
    return _total(F.zip_with(F.transform("near", lambda c: c[value]), F.array(*[F.lit(float(w)) for w in weights]), lambda v, w: v * w))


def spatial_gradient(df: DataFrame, sizes: dict[str, int], keys: list[str], value: str = "value", dx: float = 1.0, difference: str = "central", rule: Rule | float = boundary) -> DataFrame:
    """Finite differences along every dimension, in columns d_<dim>."""
    low, up, span = {"central": (-1, 1, 2.0), "forward": (0, 1, 1.0), "backward": (-1, 0, 1.0)}[difference]
    dims = list(sizes)
    one = lambda i, k: tuple(k if j == i else 0 for j in range(len(dims)))
    offsets = [one(i, k) for i in range(len(dims)) for k in (low, up)]
    near = around(df, sizes, offsets, keys, [value], rule)
    return near.select(*keys, *dims, *[((_at(2 * i + 1, value) - _at(2 * i, value)) / (span * dx)).alias(f"d_{d}") for i, d in enumerate(dims)])


def laplace(df: DataFrame, sizes: dict[str, int], keys: list[str], value: str = "value", dx: float = 1.0, rule: Rule | float = boundary) -> DataFrame:
    """Sum over the dimensions of left + right - 2 * centre."""
    offsets = axes(len(sizes))
    near = around(df, sizes, offsets, keys, [value], rule)
    return near.select(*keys, *sizes, (_weighted([-2.0 * len(sizes)] + [1.0] * (len(offsets) - 1), value) / (dx * dx)).alias(value))


#: Aggregates of a neighbourhood that are found in the array itself; any other one groups the exploded cells.
IN_ARRAY = {F.max: F.array_max, F.min: F.array_min, F.sum: _total, F.avg: _mean, F.mean: _mean}


def neighbor_reduce(df: DataFrame, sizes: dict[str, int], keys: list[str], how, value: str = "value", reach: int = 1) -> DataFrame:
    """Aggregate of the cube around each cell, cut at the ends."""
    near = around(df, sizes, box(len(sizes), reach), keys, [value], None)
    if how in IN_ARRAY:
        return near.select(*keys, *sizes, IN_ARRAY[how](_there(value)).alias(value))
    return near.select(*keys, *sizes, F.explode(_there(value)).alias(value)).groupBy(*keys, *sizes).agg(how(value).alias(value))


def neighbor_mean(df: DataFrame, sizes: dict[str, int], keys: list[str], value: str = "value") -> DataFrame:
    return neighbor_reduce(df, sizes, keys, F.avg, value)


def neighbor_sum(df: DataFrame, sizes: dict[str, int], keys: list[str], value: str = "value") -> DataFrame:
    return neighbor_reduce(df, sizes, keys, F.sum, value)


def neighbor_max(df: DataFrame, sizes: dict[str, int], keys: list[str], value: str = "value") -> DataFrame:
    return neighbor_reduce(df, sizes, keys, F.max, value)


def neighbor_min(df: DataFrame, sizes: dict[str, int], keys: list[str], value: str = "value") -> DataFrame:
    return neighbor_reduce(df, sizes, keys, F.min, value)


def at_neighbor(df: DataFrame, sizes: dict[str, int], keys: list[str], value: str, by: str, largest: bool = True, diagonal: bool = True) -> DataFrame:
    """The value at the neighbour (or the cell itself) whose ``by`` is largest or smallest; of equals, at the first offset."""
    offsets = box(len(sizes)) if diagonal else axes(len(sizes))
    near = around(df, sizes, offsets, keys, [value, by], None)
    ranked = F.filter(F.transform("near", lambda c, o: F.struct(c[by].alias("by"), (-o if largest else o).alias("o"), c[value].alias("v"))), lambda c: c["by"].isNotNull())
    return near.select(*keys, *sizes, (F.array_max if largest else F.array_min)(ranked)["v"].alias(value))


def at_neighbor_where(df: DataFrame, sizes: dict[str, int], keys: list[str], value: str, by: str, where, diagonal: bool = True) -> DataFrame:
    """The value at the first neighbour (or the cell itself) that ``where(own, other)`` picks from their ``by``.

    ``where`` is any predicate of two columns: the cell's ``by`` and the neighbour's. A cell of which none is
    picked gets null. Offsets come in order, the last dimension's fastest.
    """
    offsets = box(len(sizes)) if diagonal else axes(len(sizes))
    near = around(df, sizes, offsets, keys, [value, by], None)
    own = F.get("near", offsets.index((0,) * len(sizes)))[by]
    return near.select(*keys, *sizes, F.get(F.filter("near", lambda c: c.isNotNull() & F.coalesce(where(own, c[by]), F.lit(False))), 0)[value].alias(value))


def masked_fill(df: DataFrame, sizes: dict[str, int], keys: list[str], value: str = "value", valid: str = "valid", distance: int = 1, offsets: list[tuple[int, ...]] | None = None) -> DataFrame:
    """Cells that aren't valid get the mean of the valid ones around them, ``distance`` times; (value, valid)."""
    offsets = offsets or box(len(sizes))
    centre = F.get("near", offsets.index((0,) * len(sizes)))
    hit = F.transform(F.filter("near", lambda c: F.coalesce(c[valid], F.lit(False))), lambda c: c[value])
    for _ in range(distance):
        near = around(df, sizes, offsets, keys, [value, valid], None)
        df = near.select(*keys, *sizes, F.when(centre[valid] | (F.size(hit) == 0), centre[value]).otherwise(_mean(hit)).alias(value), (F.size(hit) > 0).alias(valid))
    return df


def finite_fill(df: DataFrame, sizes: dict[str, int], keys: list[str], value: str = "value", distance: int = 1, diagonal: bool = True) -> DataFrame:
    """Non-finite cells get the mean of the finite ones around them (in the cube, or along the axes), or stay NaN."""
    marked = df.select(*keys, *sizes, F.when(is_finite(F.col(value)), F.col(value)).otherwise(nan()).alias(value), is_finite(F.col(value)).alias("__valid"))
    return masked_fill(marked, sizes, keys, value, "__valid", distance, box(len(sizes)) if diagonal else axes(len(sizes))).drop("__valid")


def convolve(df: DataFrame, sizes: dict[str, int], keys: list[str], kernel: dict[tuple[int, ...], float], value: str = "value", rule: Rule | float = 0.0) -> DataFrame:
    """Cross-correlation with a kernel given by offset."""
    near = around(df, sizes, list(kernel), keys, [value], rule)
    return near.select(*keys, *sizes, _weighted(list(kernel.values()), value).alias(value))


def index_shift(df: DataFrame, sizes: dict[str, int], keys: list[str], offsets: list[tuple[int, ...]], value: str = "value", rule: Rule | float = boundary) -> DataFrame:
    """The values at each offset, in columns <value>_0, <value>_1, ..."""
    near = around(df, sizes, offsets, keys, [value], rule)
    return near.select(*keys, *sizes, *[_at(k, value).alias(f"{value}_{k}") for k in range(len(offsets))])


def downsample2x(df: DataFrame, sizes: dict[str, int], keys: list[str], value: str = "value") -> DataFrame:
    """Means of pairs along every dimension; an odd end repeats its last cell."""
    half = [F.floor(F.col(d) / 2).cast("long").alias(d) for d in sizes]
    return df.groupBy(*keys, *half).agg(F.avg(value).alias(value))


def upsample2x(df: DataFrame, sizes: dict[str, int], keys: list[str], value: str = "value", rule: Rule | float = boundary) -> DataFrame:
    """Two cells of each along every dimension: three quarters of it and one of the neighbour on that side."""
    dims = list(sizes)
    near = around(df, sizes, box(len(dims)), keys, [value], rule)
    sides = list(product((0, 1), repeat=len(dims)))
    parts = []
    for side in sides:
        weights = []
        for off in box(len(dims)):
            w = 1.0
            for s, o in zip(side, off, strict=True):
                w *= 0.75 if o == 0 else 0.25 if o == 2 * s - 1 else 0.0
            weights.append(w)
        parts.append(_weighted(weights, value).alias(f"s{len(parts)}"))
    wide = near.select(*keys, *dims, *parts)
    cells = [F.struct(*[(2 * F.col(d) + s).cast("long").alias(d) for d, s in zip(dims, side, strict=True)], F.col(f"s{k}").alias(value)) for k, side in enumerate(sides)]
    return wide.select(*keys, F.explode(F.array(*cells)).alias("c")).select(*keys, *[F.col(f"c.{d}").alias(d) for d in dims], F.col(f"c.{value}").alias(value))


def _corners(points: DataFrame, sizes: dict[str, int], at: dict[str, str], rule: Rule) -> DataFrame:
    """2^d rows per point: corner (number), index columns, and the linear weight."""
    dims = list(sizes)
    low = {d: F.floor(F.col(at[d])) for d in dims}
    cells = []
    for k, side in enumerate(product((0, 1), repeat=len(dims))):
        share = [(F.col(at[d]) - low[d]) if s else 1 - (F.col(at[d]) - low[d]) for d, s in zip(dims, side, strict=True)]
        index = [(low[d] + s).cast("long") for d, s in zip(dims, side, strict=True)]
        placed = [(i if rule.index is None else rule.index(i, sizes[d])).cast("long").alias(d) for d, i in zip(dims, index, strict=True)]
        cells.append(F.struct(F.lit(k).alias("corner"), *placed, reduce(lambda a, b: a * b, share).cast("double").alias("w")))
    names = points.columns
    return points.select(*names, F.explode(F.array(*cells)).alias("__c")).select(*names, F.col("__c.corner").alias("corner"), *[F.col(f"__c.{d}").alias(d) for d in dims], F.col("__c.w").alias("w"))


def closest_grid_values(grid: DataFrame, points: DataFrame, sizes: dict[str, int], at: dict[str, str], value: str = "value", rule: Rule | float = boundary) -> DataFrame:
    """The 2^d grid values around each point: the point's columns, ``corner`` and the value; the last dimension's side runs fastest."""
    rule = as_rule(rule)
    hit = _corners(points, sizes, at, rule).join(grid.select(*sizes, value), list(sizes), "left" if rule.index is None else "inner")
    return hit.select(*points.columns, "corner", F.coalesce(value, F.lit(rule.constant)).alias(value) if rule.index is None else F.col(value))


def grid_sample(grid: DataFrame, points: DataFrame, sizes: dict[str, int], at: dict[str, str], value: str = "value", rule: Rule | float = boundary) -> DataFrame:
    """Linear interpolation at fractional places in any number of dimensions; corners outside follow the rule."""
    rule = as_rule(rule)
    hit = _corners(points, sizes, at, rule).join(grid.select(*sizes, value), list(sizes), "left" if rule.index is None else "inner")
    v = F.coalesce(value, F.lit(rule.constant)) if rule.index is None else F.col(value)
    return hit.groupBy(*points.columns).agg(F.sum(F.col("w") * v).alias(value))


def sample_subgrid(grid: DataFrame, sizes: dict[str, int], start: dict[str, float], size: dict[str, int], value: str = "value") -> DataFrame:
    """A window of the grid from a fractional start on, linearly interpolated."""
    points = grid.select(*sizes).where(reduce(lambda a, b: a & b, [F.col(d) < n for d, n in size.items()]))
    points = points.select(*[F.col(d).alias(f"__i_{d}") for d in sizes], *[(F.col(d) + start[d]).alias(f"__p_{d}") for d in sizes])
    out = grid_sample(grid, points, sizes, {d: f"__p_{d}" for d in sizes}, value)
    return out.select(*[F.col(f"__i_{d}").alias(d) for d in sizes], value)
