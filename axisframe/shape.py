"""Named, typed dimensions: metadata of a frame, never inferred from its data."""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, replace

#: Canonical order of the kinds.
KINDS = ("batch", "dual", "instance", "spatial", "channel")


class IncompatibleShapes(ValueError):
    """Two shapes disagree on a shared dimension."""


@dataclass(frozen=True)
class Dim:
    name: str
    kind: str
    size: int | None = None
    labels: tuple[str, ...] | None = None

    def __post_init__(self) -> None:
        if self.kind not in KINDS:
            raise ValueError(f"unknown kind {self.kind}")
        if self.kind == "dual" and not self.name.startswith("~"):
            object.__setattr__(self, "name", "~" + self.name)
        if self.labels is not None:
            if len(set(self.labels)) < len(self.labels):
                raise ValueError(f"{self.name}: labels repeat")
            object.__setattr__(self, "size", len(self.labels))


@dataclass(frozen=True)
class Shape:
    dims: tuple[Dim, ...] = ()

    def __post_init__(self) -> None:
        if len(set(self.names)) < len(self.dims):
            raise ValueError(f"dimensions repeat in {self.names}")

    names = property(lambda self: tuple(d.name for d in self.dims))
    sizes = property(lambda self: tuple(d.size for d in self.dims))
    kinds = property(lambda self: tuple(d.kind for d in self.dims))
    rank = property(lambda self: len(self.dims))
    well_defined = property(lambda self: all(d.size is not None for d in self.dims))

    @property
    def volume(self) -> int | None:
        return math.prod(self.sizes) if self.well_defined else None

    def __iter__(self) -> Iterator[Dim]:
        return iter(self.dims)

    def __len__(self) -> int:
        return len(self.dims)

    def __contains__(self, dim: str | Dim) -> bool:
        return (dim.name if isinstance(dim, Dim) else dim) in self.names

    def __getitem__(self, key: int | str) -> Dim:
        return self.dims[key] if isinstance(key, int) else self.dims[self.index(key)]

    def index(self, name: str) -> int:
        return self.names.index(name)

    def only(self, which: DimFilter, reorder: bool = False) -> Shape:
        names = _chosen(self, which)
        return Shape(tuple(self[n] for n in names if n in self)) if reorder else Shape(tuple(d for d in self.dims if d.name in names))

    def without(self, which: DimFilter) -> Shape:
        names = _chosen(self, which)
        return Shape(tuple(d for d in self.dims if d.name not in names))

    def of_kind(self, *kinds: str) -> Shape:
        return Shape(tuple(d for d in self.dims if d.kind in kinds))

    def __and__(self, other: Shape) -> Shape:
        return merge_shapes(self, other)

    def __sub__(self, other: DimFilter) -> Shape:
        return self.without(other)

    def replaced(self, name: str, **changes) -> Shape:
        return Shape(tuple(replace(d, **changes) if d.name == name else d for d in self.dims))

    def renamed(self, names: dict[str, str]) -> Shape:
        return Shape(tuple(replace(d, name=names.get(d.name, d.name)) for d in self.dims))

    def with_size(self, name: str, size: int | None) -> Shape:
        return self.replaced(name, size=size, labels=None)

    def canonical(self) -> Shape:
        return Shape(tuple(sorted(self.dims, key=lambda d: KINDS.index(d.kind))))

    def isdisjoint(self, other: Shape) -> bool:
        return not set(self.names) & set(other.names)

    def to_json(self) -> str:
        return json.dumps([[d.name, d.kind, d.size, d.labels] for d in self.dims])

    @classmethod
    def from_json(cls, text: str) -> Shape:
        return cls(tuple(Dim(n, k, s, tuple(v) if v else None) for n, k, s, v in json.loads(text)))


DimFilter = str | Iterable | Callable | Shape | None


def _chosen(shape: Shape, which: DimFilter) -> list[str]:
    if which is None:
        return []
    if isinstance(which, str):
        return [w.strip() for w in which.split(",") if w.strip()]
    if isinstance(which, Shape):
        return list(which.names)
    if callable(which):
        return list(which(shape).names)
    return [n for w in which for n in _chosen(shape, w.name if isinstance(w, Dim) else w)]


def _maker(kind: str):
    def make(*args, **sizes) -> Shape:
        if len(args) == 1 and isinstance(args[0], Shape):
            return args[0].of_kind(kind)
        dims = [Dim(n.strip(), kind) for a in args for n in a.split(",")]
        for name, size in sizes.items():
            labels = tuple(size.split(",")) if isinstance(size, str) else tuple(size) if isinstance(size, (tuple, list)) else None
            dims.append(Dim(name, kind, size if isinstance(size, int) else None, labels))
        return Shape(tuple(dims))

    make.__name__ = kind
    make.__doc__ = f"New {kind} dimensions by name and size or labels, or a shape's {kind} dimensions."
    return make


batch, dual, instance, spatial, channel = map(_maker, KINDS)


def non_batch(shape: Shape) -> Shape:
    return shape.of_kind(*[k for k in KINDS if k != "batch"])


def non_dual(shape: Shape) -> Shape:
    return shape.of_kind(*[k for k in KINDS if k != "dual"])


def non_instance(shape: Shape) -> Shape:
    return shape.of_kind(*[k for k in KINDS if k != "instance"])


def non_spatial(shape: Shape) -> Shape:
    return shape.of_kind(*[k for k in KINDS if k != "spatial"])


def non_channel(shape: Shape) -> Shape:
    return shape.of_kind(*[k for k in KINDS if k != "channel"])


def primal(shape: Shape) -> Shape:
    return shape.of_kind("instance", "spatial", "channel")


def non_primal(shape: Shape) -> Shape:
    return shape.of_kind("batch", "dual")


def merge_shapes(*shapes: Shape) -> Shape:
    """All dimensions by name; sizes and labels of shared ones must agree, labels in the same order."""
    out: dict[str, Dim] = {}
    for d in (d for s in shapes for d in s):
        have = out.get(d.name)
        if have is None:
            out[d.name] = d
            continue
        if have.kind != d.kind or (have.size is not None and d.size is not None and have.size != d.size) or (have.labels and d.labels and have.labels != d.labels):
            raise IncompatibleShapes(f"{have} and {d}")
        out[d.name] = Dim(d.name, d.kind, have.size if have.size is not None else d.size, have.labels or d.labels)
    return Shape(tuple(out.values())).canonical()


def concat_shapes(*shapes: Shape) -> Shape:
    return Shape(tuple(d for s in shapes for d in s))


def concat_shapes_(*shapes: Shape) -> Shape:
    """As :func:`concat_shapes`; a name that comes again is the same dimension."""
    return merge_shapes(*shapes)


class InvalidShapeSpec(ValueError):
    """A text that isn't a list of dimensions."""


def split_top_level_comma(text: str) -> list[str]:
    """Parts between commas that lie outside parentheses."""
    parts, depth, at = [], 0, 0
    for i, c in enumerate(text):
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            parts.append(text[at:i])
            at = i + 1
    return [p.strip() for p in [*parts, text[at:]] if p.strip()]


def shape_spec(text: str) -> Shape:
    """Parse "x:s=4,points:i,vector:c=(x,y)": name, kind's first letter, size or labels."""
    import re

    letters = {k[0]: k for k in KINDS}
    out = []
    for part in split_top_level_comma(text):
        m = re.fullmatch(r"(~?\w+):([bdisc])(?:=(?:\(([^)]*)\)|(\d+)))?", part)
        if m is None:
            raise InvalidShapeSpec(f"no dimension: {part!r} in {text!r}")
        name, kind, labels, size = m.groups()
        out.append(Dim(name, letters[kind], int(size) if size else None, tuple(v.strip() for v in labels.split(",")) if labels else None))
    return Shape(tuple(out))


def to_spec(shape: Shape) -> str:
    """The text that :func:`shape_spec` reads."""
    tail = lambda d: f"=({','.join(d.labels)})" if d.labels else f"={d.size}" if d.size is not None else ""
    return ",".join(f"{d.name}:{d.kind[0]}{tail(d)}" for d in shape)


def auto(spec: str, default: str = "channel") -> Shape:
    """Dimensions from a spec; those without a kind get the default one, "~" ones are dual."""
    return Shape(tuple(d for part in split_top_level_comma(spec) for d in (shape_spec(part) if ":" in part else (Dim(part, "dual" if part.startswith("~") else default),))))


def pure_merge(*shapes: Shape) -> Shape:
    """Merge shapes that are all of one kind."""
    kinds = {k for s in shapes for k in s.kinds}
    if len(kinds) > 1:
        raise IncompatibleShapes(f"kinds {sorted(kinds)}")
    return merge_shapes(*shapes)


def kind_size(shape: Shape, kind: str) -> int | None:
    """Number of cells that the dimensions of one kind make up."""
    return shape.of_kind(kind).volume


def shape_stack(name: str, kind: str, *shapes: Shape) -> Shape:
    """The shape of frames along a new dimension; sizes that differ are unknown."""
    merged: dict[str, Dim] = {}
    for d in (d for s in shapes for d in s):
        have = merged.get(d.name)
        merged[d.name] = d if have is None or have.size == d.size else replace(have, size=None, labels=None)
    return Shape((*merged.values(), Dim(name, kind, len(shapes)))).canonical()


def unstack_shape(shape: Shape, dim: str) -> list[Shape]:
    """A shape per index of the dimension."""
    if shape[dim].size is None:
        raise ValueError(f"the size of {dim} is unknown")
    return [shape.without(dim)] * shape[dim].size


def after_gather(shape: Shape, item: dict[str, int | slice]) -> Shape:
    """The shape that is left when indices or slices are taken; names that aren't there do nothing."""
    for name, s in item.items():
        if name in shape:
            size = shape[name].size
            shape = shape.without(name) if isinstance(s, int) else shape.with_size(name, None if size is None else len(range(*s.indices(size))))
    return shape


def transposed(shape: Shape) -> Shape:
    """Dual dimensions as channel ones and channel ones as dual ones."""
    swap = {"dual": "channel", "channel": "dual"}
    return Shape(tuple(Dim(d.name.lstrip("~"), swap.get(d.kind, d.kind), d.size, d.labels) for d in shape))


def mask(shape: Shape, names: DimFilter) -> tuple[bool, ...]:
    """Which dimensions are among the named ones."""
    chosen = _chosen(shape, names)
    return tuple(d.name in chosen for d in shape)


def first_index(shape: Shape) -> dict[str, int]:
    return dict.fromkeys(shape.names, 0)
