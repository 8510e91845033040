"""TensorFrame: a DataFrame whose columns are dimension indices or the labelled components of a value.

Wide encoding: a column per dimension, and a value column per label of the channel dimension (one column
"value" without a channel). Rows are cells; sizes live in the shape, so absent rows are known as absent.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce as fold

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from axisframe.shape import Dim, DimFilter, IncompatibleShapes, Shape, channel, merge_shapes, non_batch, primal


#: Cells that the smaller side of an outer product may have.
OUTER_CELLS = 1 << 16


class TensorFrame:
    def __init__(self, df: DataFrame, dims: Shape, values: tuple[str, ...] | list[str] = ("value",)):
        self.df, self.dims, self.values = df, dims, tuple(values)

    @property
    def shape(self) -> Shape:
        """Dimensions stored as rows, and the channel dimension that the value columns make up."""
        return merge_shapes(self.dims, channel(vector=self.values)) if len(self.values) > 1 else self.dims

    def with_df(self, df: DataFrame, dims: Shape | None = None, values=None) -> TensorFrame:
        return TensorFrame(df, self.dims if dims is None else dims, self.values if values is None else values)

    # --- element-wise -------------------------------------------------------------------------------
    def map(self, f: Callable[[Column], Column]) -> TensorFrame:
        """Apply a column function to every component."""
        return self.with_df(self.df.withColumns({v: f(F.col(v)) for v in self.values}))

    def _binary(self, other, f: Callable[[Column, Column], Column]) -> TensorFrame:
        if not isinstance(other, TensorFrame):
            return self.map(lambda c: f(c, F.lit(other) if not isinstance(other, Column) else other))
        return align(self, other, f)

    def __add__(self, o):
        return self._binary(o, lambda a, b: a + b)

    def __sub__(self, o):
        return self._binary(o, lambda a, b: a - b)

    def __mul__(self, o):
        return self._binary(o, lambda a, b: a * b)

    def __truediv__(self, o):
        from axisframe.functions.elementwise import divide

        return self._binary(o, divide)

    def _whole(self, o) -> bool:
        kinds = [self.dtype, o.dtype if isinstance(o, TensorFrame) else "int" if type(o) is int else "double"]
        return all(k in ("tinyint", "smallint", "int", "bigint") for k in kinds)

    def __floordiv__(self, o):
        """Rounded down; whole numbers stay whole, and null where the divisor is 0."""
        from axisframe.functions import elementwise as E

        return self._binary(o, E.floor_divide if self._whole(o) else E.floor_divide_ieee)

    def __mod__(self, o):
        """Has the divisor's sign; whole numbers stay whole, and null where the divisor is 0."""
        from axisframe.functions import elementwise as E

        return self._binary(o, E.floor_mod if self._whole(o) else E.floor_mod_ieee)

    def __pow__(self, o):
        return self._binary(o, F.pow)

    def _reflected(self, o, f: Callable[[Column, Column], Column]) -> TensorFrame:
        """f(o, own component), for an operand on the left that isn't a frame."""
        return self.map(lambda c: f(o if isinstance(o, Column) else F.lit(o), c))

    def __radd__(self, o):
        return self._reflected(o, lambda a, b: a + b)

    def __rsub__(self, o):
        return self._reflected(o, lambda a, b: a - b)

    def __rmul__(self, o):
        return self._reflected(o, lambda a, b: a * b)

    def __rtruediv__(self, o):
        from axisframe.functions.elementwise import divide

        return self._reflected(o, lambda a, b: divide(a.cast("double"), b.cast("double")))

    def __rfloordiv__(self, o):
        from axisframe.functions import elementwise as E

        return self._reflected(o, E.floor_divide if self._whole(o) else E.floor_divide_ieee)

    def __rmod__(self, o):
        from axisframe.functions import elementwise as E

        return self._reflected(o, E.floor_mod if self._whole(o) else E.floor_mod_ieee)

    def __rpow__(self, o):
        return self._reflected(o, F.pow)

    def __rand__(self, o):
        return self & o

    def __ror__(self, o):
        return self | o

    def __rxor__(self, o):
        return self ^ o

    def __rlshift__(self, o):
        return self._reflected(o, lambda a, b: F.call_function("shiftleft", a, b.cast("int")))

    def __rrshift__(self, o):
        return self._reflected(o, lambda a, b: F.call_function("shiftright", a, b.cast("int")))

    def __lt__(self, o):
        return self._compare(o, lambda a, b: a < b)

    def __le__(self, o):
        return self._compare(o, lambda a, b: a <= b)

    def __gt__(self, o):
        return self._compare(o, lambda a, b: a > b)

    def __ge__(self, o):
        return self._compare(o, lambda a, b: a >= b)

    def __eq__(self, o):
        return self._compare(o, lambda a, b: a == b)

    def __ne__(self, o):
        return ~(self == o)

    __hash__ = object.__hash__

    def _compare(self, o, f) -> TensorFrame:
        """Nothing compares with NaN."""
        known = lambda c: ~F.isnan(c.cast("double"))
        return self._binary(o, lambda a, b: f(a, b) & known(a) & known(b))

    def _logical(self, o, truth, bits) -> TensorFrame:
        boolean = all(self.df.schema[v].dataType.simpleString() == "boolean" for v in self.values)
        return self._binary(o, truth if boolean else bits)

    def __and__(self, o):
        return self._logical(o, lambda a, b: a & b, lambda a, b: a.bitwiseAND(b))

    def __or__(self, o):
        return self._logical(o, lambda a, b: a | b, lambda a, b: a.bitwiseOR(b))

    def __xor__(self, o):
        return self._logical(o, lambda a, b: a != b, lambda a, b: a.bitwiseXOR(b))

    def __invert__(self):
        boolean = all(self.df.schema[v].dataType.simpleString() == "boolean" for v in self.values)
        return self.map((lambda c: ~c) if boolean else F.bitwise_not)

    def __lshift__(self, o):
        return self._binary(o, lambda a, b: F.call_function("shiftleft", a, b.cast("int")))

    def __rshift__(self, o):
        return self._binary(o, lambda a, b: F.call_function("shiftright", a, b.cast("int")))

    def __matmul__(self, o: TensorFrame) -> TensorFrame:
        """Contracts this frame's dual dimensions with the other's primal ones of the same names; without any, multiplies."""
        inner = [d.name for d in self.dims if d.kind == "dual" and d.name[1:] in o.dims]
        if not inner:
            return self * o
        rest, other = self.dims.without(inner), o.dims.without([n[1:] for n in inner])
        left = self.df.select(*rest.names, *[F.col(n).alias(n[1:]) for n in inner], F.col(self.values[0]).alias("__a"))
        joined = left.join(o.df.select(*o.dims.names, F.col(o.values[0]).alias("__b")), [n[1:] for n in inner])
        both = Shape((*rest.dims, *other.dims))
        return TensorFrame(joined.groupBy(*both.names).agg(F.sum(F.col("__a") * F.col("__b")).alias("value")), both)

    def __round__(self, digits: int = 0):
        """To the even neighbour."""
        return self.map(lambda c: F.rint(c * 10**digits) / 10**digits)

    def __neg__(self):
        return self.map(lambda c: -c)

    def __abs__(self):
        return self.map(F.abs)

    # --- structure ----------------------------------------------------------------------------------
    def __getitem__(self, item: dict) -> TensorFrame:
        """Slice by name: an int drops the dimension, a slice keeps it re-numbered, labels pick components."""
        out = self
        for name, s in item.items():
            if name == "vector" and isinstance(s, str):
                out = out.with_df(out.df.select(*out.dims.names, *s.split(",")), values=tuple(s.split(",")))
            elif name not in out.dims:
                continue  # slicing what isn't there does nothing
            elif isinstance(s, int):
                size = out.dims[name].size
                out = out.with_df(out.df.where(F.col(name) == (s + size if s < 0 else s)).drop(name), out.dims.without(name))
            elif isinstance(s, slice):
                size = out.dims[name].size
                start, stop, step = s.indices(size) if size is not None else (s.start or 0, s.stop, s.step or 1)
                cond = F.col(name) >= start
                if stop is not None:
                    cond &= F.col(name) < stop
                cond &= (F.col(name) - start) % step == 0
                count = len(range(start, stop, step)) if stop is not None else None
                out = out.with_df(out.df.where(cond).withColumn(name, ((F.col(name) - start) / step).cast("long")), out.dims.with_size(name, count))
        return out

    def rename(self, names: dict[str, str]) -> TensorFrame:
        return self.with_df(self.df.withColumnsRenamed(names), self.dims.renamed(names))

    def expand(self, **sizes: int) -> TensorFrame:
        """New batch dimensions along which the values repeat, made by rows' own sequences."""
        df, dims = self.df, self.dims
        for name, n in sizes.items():
            df = df.withColumn(name, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))
            dims = merge_shapes(dims, Shape((Dim(name, "batch", n),)))
        return self.with_df(df.select(*dims.names, *self.values), dims)

    def squeeze(self, dim: str) -> TensorFrame:
        """Drop a dimension of size 1."""
        if self.dims[dim].size != 1:
            raise ValueError(f"{dim} has size {self.dims[dim].size}")
        return self.with_df(self.df.drop(dim), self.dims.without(dim))

    def swap_axes(self, a: str, b: str) -> TensorFrame:
        """Two dimensions' places in the order of dimensions, and of columns, exchanged; cells stay what they are."""
        names = [{a: b, b: a}.get(n, n) for n in self.dims.names]
        dims = self.dims.only(names, reorder=True)
        return self.with_df(self.df.select(*dims.names, *self.values), dims)

    def unstack(self, dim: str) -> list[TensorFrame]:
        """A frame per index of a dimension of known size."""
        return [self[{dim: i}] for i in range(self.dims[dim].size)]

    def slice_off(self, **cuts: slice | int) -> TensorFrame:
        """Without the named indices; the rest is numbered anew."""
        out = self
        for name, s in cuts.items():
            size = out.dims[name].size
            gone = set(range(*s.indices(size))) if isinstance(s, slice) else {s % size}
            place = {i: k for k, i in enumerate(i for i in range(size) if i not in gone)}
            new = F.coalesce(*[F.when(F.col(name) == i, F.lit(k).cast("long")) for i, k in place.items()], F.lit(None).cast("long"))
            out = out.with_df(out.df.withColumn(name, new).where(F.col(name).isNotNull()), out.dims.with_size(name, len(place)))
        return out

    def pack(self, names: list[str], packed: str, kind: str = "instance") -> TensorFrame:
        """Dimensions of known sizes as one, the first outermost."""
        from axisframe.operators.lookup import ravel

        sizes = [self.dims[n].size for n in names]
        volume = None if None in sizes[1:] else 1
        for n in sizes if volume else ():
            volume = None if n is None or volume is None else volume * n
        rest = self.dims.without(names)
        df = self.df.select(*rest.names, ravel(names, [n or 1 for n in sizes]).cast("long").alias(packed), *self.values)
        return self.with_df(df, merge_shapes(rest, Shape((Dim(packed, kind, volume),))))

    def unpack(self, packed: str, kind: str = "instance", **sizes: int) -> TensorFrame:
        """The inverse of :meth:`pack`."""
        from axisframe.operators.lookup import unravel

        rest = self.dims.without(packed)
        parts = unravel(F.col(packed), list(sizes), list(sizes.values()))
        df = self.df.select(*rest.names, *[parts[n].cast("long").alias(n) for n in sizes], *self.values)
        return self.with_df(df, merge_shapes(rest, Shape(tuple(Dim(n, kind, k) for n, k in sizes.items()))))

    def flatten(self, flat: str = "flat", batch_too: bool = False) -> TensorFrame:
        """All dimensions but batch ones as one."""
        return self.pack(list((self.dims if batch_too else non_batch(self.dims)).names), flat)

    def with_kind(self, dim: str, kind: str) -> TensorFrame:
        """A dimension as another kind; to and from dual its name gains or loses the mark."""
        bare = dim.lstrip("~")
        new = Dim(bare, kind, self.dims[dim].size, self.dims[dim].labels)
        dims = Shape(tuple(new if d.name == dim else d for d in self.dims))
        return self.with_df(self.df.withColumnRenamed(dim, new.name), dims)

    def components_to_rows(self, dim: str, kind: str = "batch") -> TensorFrame:
        """The value columns as a labelled dimension of rows."""
        pairs = [F.struct(F.lit(i).cast("long").alias(dim), F.col(v).alias("value")) for i, v in enumerate(self.values)]
        df = self.df.select(*self.dims.names, F.explode(F.array(*pairs)).alias("c")).select(*self.dims.names, F.col(f"c.{dim}").alias(dim), F.col("c.value").alias("value"))
        return TensorFrame(df, merge_shapes(self.dims, Shape((Dim(dim, kind, None, self.values),))))

    def cast(self, kind: str) -> TensorFrame:
        return self.map(lambda c: c.cast(kind))

    def bool_to_int(self, bits: int = 32) -> TensorFrame:
        return self.cast({8: "tinyint", 16: "smallint", 32: "int", 64: "bigint"}[bits])

    @property
    def dtype(self) -> str:
        """The common type of the components."""
        kinds = {self.df.schema[v].dataType.simpleString() for v in self.values}
        return kinds.pop() if len(kinds) == 1 else "double"

    # --- reductions ---------------------------------------------------------------------------------
    def reduce(self, how: Callable[[Column], Column], dim: DimFilter = non_batch) -> TensorFrame:
        """Aggregate over ``dim`` (default: all but batch dimensions); the other dimensions are the keys."""
        rest = self.dims.without(self.dims.only(dim) if callable(dim) else dim)
        aggs = [how(F.col(v)).alias(v) for v in self.values]
        df = self.df.groupBy(*rest.names).agg(*aggs) if len(rest) else self.df.agg(*aggs)
        return self.with_df(df, rest)

    def sum(self, dim: DimFilter = non_batch) -> TensorFrame:
        return self.reduce(F.sum, dim)

    def mean(self, dim: DimFilter = non_batch) -> TensorFrame:
        return self.reduce(F.avg, dim)

    def max(self, dim: DimFilter = non_batch) -> TensorFrame:
        return self.reduce(F.max, dim)

    def min(self, dim: DimFilter = non_batch) -> TensorFrame:
        from axisframe.operators.reduce import min_nan

        return self.reduce(min_nan, dim)

    def std(self, dim: DimFilter = non_batch) -> TensorFrame:
        """Population standard deviation."""
        return self.reduce(F.stddev_pop, dim)

    def prod(self, dim: DimFilter = non_batch) -> TensorFrame:
        return self.reduce(F.product, dim)

    def any(self, dim: DimFilter = non_batch) -> TensorFrame:
        return self.reduce(F.bool_or, dim)

    def all(self, dim: DimFilter = non_batch) -> TensorFrame:
        return self.reduce(F.bool_and, dim)

    def finite(self, what: str, dim: DimFilter = non_batch) -> TensorFrame:
        """``what`` of the finite values: sum, mean, min, max or std."""
        from axisframe.operators import reduce as R

        return self.reduce(getattr(R, f"finite_{what}"), dim)

    def quantile(self, q: float | dict[str, float], dim: DimFilter = non_batch) -> TensorFrame:
        """One quantile of the first component, or several as components of these names."""
        from axisframe.operators.reduce import quantile

        return quantile(self, q, dim)

    def median(self, dim: DimFilter = non_batch) -> TensorFrame:
        return self.quantile(0.5, dim)

    def histogram(self, low: float, high: float, bins: int, dim: DimFilter = non_batch) -> TensorFrame:
        """Counts of equal bins of the first component, for each index of the other dimensions."""
        v = F.col(self.values[0])
        rest = self.dims.without(self.dims.only(dim) if callable(dim) else dim)
        at = F.least(F.floor((v - low) / ((high - low) / bins)), F.lit(bins - 1)).cast("long")
        df = self.df.where((v >= low) & (v <= high)).groupBy(*rest.names, at.alias("bin")).agg(F.count("*").alias("value"))
        return TensorFrame(df, merge_shapes(rest, Shape((Dim("bin", "instance", bins),))))

    def _arg(self, largest: bool, dim: DimFilter) -> TensorFrame:
        gone = self.dims.only(dim) if not isinstance(dim, str) else self.dims.only([dim])
        rest = self.dims.without(gone)
        v, index = F.col(self.values[0]), F.struct(*[F.col(n) for n in gone.names])
        order = F.struct(~F.isnan(v.cast("double")), -v if largest else v, index)  # NaN is found first
        picked = F.min_by(index, order).alias("__i")
        df = (self.df.groupBy(*rest.names) if len(rest) else self.df.groupBy()).agg(picked)
        return TensorFrame(df.select(*rest.names, *[F.col(f"__i.{n}").alias(n) for n in gone.names]), rest, gone.names)

    def argmax(self, dim: DimFilter = non_batch) -> TensorFrame:
        """Index of the largest value over ``dim``, a component per dimension; of equals, the first in order of the dimensions.

        NaN, if there is any, is what both ``argmax`` and ``argmin`` find.
        """
        return self._arg(True, dim)

    def argmin(self, dim: DimFilter = non_batch) -> TensorFrame:
        return self._arg(False, dim)

    def cumulative_sum(self, dim: str) -> TensorFrame:
        from axisframe.operators.scan import blocked_sum

        keys = list(self.dims.without(dim).names)
        return self.with_df(blocked_sum(self.df, keys, dim, list(self.values), longest=self.dims[dim].size))


def align(a: TensorFrame, b: TensorFrame, f: Callable[[Column, Column], Column], how: str = "inner") -> TensorFrame:
    """Combine by dimension name: equal indices on shared dimensions, every combination on the others.

    One component goes with each of the other side's; otherwise components go together by label. A side
    without rows for its dimensions (a scalar) has one row; only such a side is paired with everything.
    """
    dims = merge_shapes(a.dims, b.dims)
    shared = [n for n in a.dims.names if n in b.dims]
    right = b.df.select(*b.dims.names, *[F.col(v).alias(f"__b_{v}") for v in b.values])
    left = a.df.select(*a.dims.names, *[F.col(v).alias(f"__a_{v}") for v in a.values])
    if shared:
        same = fold(Column.__and__, [F.col(n).eqNullSafe(F.col(f"__r_{n}")) for n in shared])  # a null index is an index
        df = left.join(right.withColumnsRenamed({n: f"__r_{n}" for n in shared}), same, how)
        df = df.withColumns({n: F.coalesce(n, f"__r_{n}") for n in shared}) if how == "full" else df
    elif not len(b.dims) or not len(a.dims):
        df = left.crossJoin(right)  # with one row
    else:
        small = min((t.dims.volume or OUTER_CELLS + 1 for t in (a, b)))
        if small > OUTER_CELLS:
            raise ValueError(f"an outer product needs a side of at most {OUTER_CELLS} cells, known from its shape")
        df = left.join(F.broadcast(right), how="cross") if (b.dims.volume or OUTER_CELLS + 1) == small else right.join(F.broadcast(left), how="cross")
    names = a.values if len(a.values) >= len(b.values) else b.values
    if len(a.values) > 1 and len(b.values) > 1 and set(a.values) != set(b.values):
        raise ValueError(f"components {a.values} and {b.values}")
    pick = lambda side, t, v: F.col(f"__{side}_{v if len(t.values) > 1 or v in t.values else t.values[0]}")
    return TensorFrame(df.select(*dims.names, *[f(pick("a", a, v), pick("b", b, v)).alias(v) for v in names]), dims, names)


def close(a: TensorFrame, b: TensorFrame, rel_tolerance: float = 1e-5, abs_tolerance: float = 0.0, equal_nan: bool = False) -> bool:
    """Whether all cells of both agree within abs + rel * |b|, and neither has a cell that the other lacks; shapes that don't fit are not close."""
    try:
        merge_shapes(a.dims, b.dims)
    except IncompatibleShapes:
        return False
    no = lambda c: F.isnan(c.cast("double"))
    near = lambda x, y: F.when(no(x) | no(y), no(x) & no(y) & F.lit(equal_nan)).otherwise((x == y) | (F.abs(x - y) <= abs_tolerance + rel_tolerance * F.abs(y)))
    both = align(a, b, lambda x, y: F.coalesce(near(x, y), F.lit(False)), "full")
    holds = both.df.agg(*[F.coalesce(F.bool_and(v), F.lit(True)).alias(v) for v in both.values]).first()
    return all(holds)


def equal(a: TensorFrame, b: TensorFrame, equal_nan: bool = False) -> bool:
    return close(a, b, 0.0, 0.0, equal_nan)


def ncat(frames: list[TensorFrame], name: str, kind: str = "channel") -> TensorFrame:
    """Frames' components behind each other, as labelled components of one frame; shared dimensions are joined."""
    out = frames[0]
    for t in frames[1:]:
        taken = set(out.values) & set(t.values)
        if taken:
            raise ValueError(f"components repeat: {sorted(taken)}")
        shared = [n for n in out.dims.names if n in t.dims]
        out = TensorFrame(out.df.join(t.df, shared), merge_shapes(out.dims, t.dims), (*out.values, *t.values))
    return out


def tcat(frames: list[TensorFrame], kind: str, name: str = "tcat") -> TensorFrame:
    """Frames behind each other along their dimension of a kind; a frame without one counts as one cell."""
    whole = []
    for t in frames:
        own = t.dims.of_kind(kind)
        whole.append(t.rename({own.names[0]: name}) if len(own) else t.with_df(t.df.withColumn(name, F.lit(0).cast("long")), merge_shapes(t.dims, Shape((Dim(name, kind, 1),)))))
    return concat(whole, name)


#: Prefix of a reduction's name for a kind of dimensions.
KIND_PREFIXES = {"d": "dual", "p": "primal", "i": "instance", "s": "spatial", "c": "channel"}


def _typed(name: str, kind: str) -> Callable[[TensorFrame], TensorFrame]:
    dims = primal if kind == "primal" else lambda shape: shape.of_kind(kind)
    if name.startswith("finite_"):
        return lambda t: t.finite(name.removeprefix("finite_"), dims)
    return lambda t: getattr(t, name)(dims)


#: dsum, psum, ..., finite_cstd: reductions over the dimensions of one kind.
TYPED = {
    (f"finite_{p}{n.removeprefix('finite_')}" if n.startswith("finite_") else f"{p}{n}"): _typed(n, kind)
    for n in ("sum", "prod", "mean", "std", "max", "min", "finite_min", "finite_max", "finite_sum", "finite_mean", "finite_std")
    for p, kind in KIND_PREFIXES.items()
}


def stack(frames: dict[str, TensorFrame], name: str, kind: str = "instance") -> TensorFrame:
    """Frames of equal dimensions along a new one; its labels are the keys, in order."""
    from axisframe.shape import Dim

    parts = [t.df.select(F.lit(i).cast("long").alias(name), *t.dims.names, *t.values) for i, t in enumerate(frames.values())]
    dims = merge_shapes(*[t.dims for t in frames.values()], Shape((Dim(name, kind, None, tuple(frames)),)))
    return TensorFrame(fold(DataFrame.unionByName, parts), dims, next(iter(frames.values())).values)


def concat(frames: list[TensorFrame], dim: str) -> TensorFrame:
    """Frames behind each other along ``dim``, whose sizes must be known."""
    parts, at = [], 0
    for t in frames:
        parts.append(t.df.withColumn(dim, (F.col(dim) + at).cast("long")))
        at += t.dims[dim].size
    return TensorFrame(fold(lambda x, y: x.unionByName(y), parts), frames[0].dims.with_size(dim, at), frames[0].values)
