"""Functions of short vectors, given as one column a component."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def vec(**components: Column | float) -> Column:
    """A labelled vector as a struct."""
    return F.struct(*[(c if isinstance(c, Column) else F.lit(c)).alias(n) for n, c in components.items()])


def const_vec(value: float, *names: str) -> Column:
    return vec(**dict.fromkeys(names, value))


def squared(components: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, [c * c for c in components])


def length(components: list[Column]) -> Column:
    return F.sqrt(squared(components))


def clip_length(components: list[Column], low: float = 0.0, high: float = 1.0) -> list[Column]:
    """The vector with its length brought into the bounds; a zero vector stays."""
    n = length(components)
    to = F.least(F.greatest(n, F.lit(low)), F.lit(high))
    return [F.when(n == 0, c).otherwise(c * to / F.when(n != 0, n)) for c in components]


def cross(a: list[Column], b: list[Column]) -> list[Column]:
    """Of two 3-vectors; of two 2-vectors the one component out of their plane."""
    if len(a) == 2:
        return [a[0] * b[1] - a[1] * b[0]]
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def rotation_matrix(*angles: Column) -> list[list[Column]]:
    """By one angle in the plane; by three about x, then y, then z."""
    if len(angles) == 1:
        c, s = F.cos(angles[0]), F.sin(angles[0])
        return [[c, -s], [s, c]]
    (cx, sx), (cy, sy), (cz, sz) = ((F.cos(a), F.sin(a)) for a in angles)
    return [[cz * cy, cz * sy * sx - sz * cx, cz * sy * cx + sz * sx], [sz * cy, sz * sy * sx + cz * cx, sz * sy * cx - cz * sx], [-sy, cy * sx, cy * cx]]


def rotate(components: list[Column], *angles: Column, invert: bool = False) -> list[Column]:
    m = rotation_matrix(*angles)
    m = [list(r) for r in zip(*m, strict=True)] if invert else m
    return [reduce(lambda a, b: a + b, [w * c for w, c in zip(row, components, strict=True)]) for row in m]
