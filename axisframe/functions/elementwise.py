"""Scalar functions with IEEE semantics: results are NaN or infinite where Spark gives NULL or raises."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def nan() -> Column:
    return F.lit(float("nan"))


def inf() -> Column:
    return F.lit(float("inf"))


def divide(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / F.when(b != 0, b)).otherwise(F.when((a == 0) | F.isnan(a), nan()).otherwise(F.signum(a) * inf()))


def safe_div(a: Column, b: Column) -> Column:
    """0 where the divisor is 0."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a / F.when(b != 0, b))


def round_even(x: Column) -> Column:
    return F.rint(x)


def floor_mod(a: Column, b: Column) -> Column:
    """The remainder with the divisor's sign, in the operands' type; null where the divisor is 0."""
    by = F.when(b != 0, b)
    r = a % by
    return F.when((r != 0) & ((r < 0) != (by < 0)), r + by).otherwise(r)


def floor_divide(a: Column, b: Column) -> Column:
    """Of whole numbers: the largest whole number up to the quotient, exact in 64 bits; null where the divisor is 0."""
    return F.call_function("div", a - floor_mod(a, b), F.when(b != 0, b))


def floor_mod_ieee(a: Column, b: Column) -> Column:
    """As :func:`floor_mod`, in doubles; NaN where the divisor is 0."""
    a, b = a.cast("double"), b.cast("double")
    return F.when(a.isNotNull() & (b == 0), nan()).otherwise(floor_mod(a, b))


def floor_divide_ieee(a: Column, b: Column) -> Column:
    """The quotient by :func:`divide`, rounded down, in doubles; infinite or NaN where the divisor is 0."""
    q = divide(a.cast("double"), b.cast("double"))
    near = F.rint(q)
    return F.when(near > q, near - 1).otherwise(near)


def _log(f, x: Column) -> Column:
    return F.when(F.isnan(x) | (x < 0), nan()).when(x == 0, -inf()).otherwise(f(x))


def log(x: Column) -> Column:
    return _log(F.ln, x)


def log2(x: Column) -> Column:
    return _log(F.log2, x)


def log10(x: Column) -> Column:
    return _log(F.log10, x)


def log1p(x: Column) -> Column:
    return F.when(F.isnan(x) | (x < -1), nan()).when(x == -1, -inf()).otherwise(F.log1p(x))


def minimum(a: Column, b: Column) -> Column:
    """NaN wins."""
    return F.when(F.isnan(a) | F.isnan(b), nan()).otherwise(F.least(a, b))


def maximum(a: Column, b: Column) -> Column:
    return F.greatest(a, b)


def clip(x: Column, low: float | Column = 0.0, high: float | Column = 1.0) -> Column:
    low, high = (v if isinstance(v, Column) else F.lit(v) for v in (low, high))
    return F.when(F.isnan(x), x).otherwise(F.least(F.greatest(x, low), high))


def is_finite(x: Column) -> Column:
    return ~F.isnan(x) & (F.abs(x) != inf())


def is_nan(x: Column) -> Column:
    """Null of null, as the other tests."""
    return F.when(x.isNotNull(), F.isnan(x))


def is_inf(x: Column) -> Column:
    return F.abs(x) == inf()


def nan_to_0(x: Column) -> Column:
    return F.nanvl(x, F.lit(0.0))


def where(condition: Column, a: Column, b: Column) -> Column:
    return F.when(condition, a).otherwise(b)


def equal(a: Column, b: Column) -> Column:
    """NaN equals nothing."""
    return (a == b) & ~F.isnan(a)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def soft_plus(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def factorial(x: Column) -> Column:
    """Exact up to 20, by the gamma function beyond."""
    n = x.cast("int")
    return F.when((n >= 0) & (n <= 20), F.factorial(F.least(F.greatest(n, F.lit(0)), F.lit(20))).cast("double")).otherwise(F.round(F.exp(log_gamma(x.cast("double") + 1))))


def degrees(x: Column) -> Column:
    return F.degrees(x)


def radians(x: Column) -> Column:
    return F.radians(x)


def is_none(x: Column) -> Column:
    return x.isNull()


def to_float(x: Column) -> Column:
    return x.cast("double")


def to_int32(x: Column) -> Column:
    return x.cast("int")


def to_int64(x: Column) -> Column:
    return x.cast("bigint")


def cast_same(*columns: Column) -> list[Column]:
    """All as doubles, in which every number type here has a place."""
    return [c.cast("double") for c in columns]


def safe_mul(a: Column, b: Column) -> Column:
    return a * b


def identity(x: Column) -> Column:
    return x


def close(a: Column, b: Column, rel_tolerance: float = 1e-5, abs_tolerance: float = 0.0) -> Column:
    """|a - b| <= abs + rel * |b|; NaN is close to nothing."""
    return (F.abs(a - b) <= abs_tolerance + rel_tolerance * F.abs(b)) & ~F.isnan(a) & ~F.isnan(b)


# fixed values: Lanczos' coefficients for g = 7
_LANCZOS = (
    0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7,
)


def _log_gamma(x: Column) -> Column:
    """For numbers from a half on (Lanczos, 1964)."""
    y = x - 1
    series = F.lit(_LANCZOS[0])
    for i, c in enumerate(_LANCZOS[1:], 1):
        series = series + F.lit(c) / (y + i)
    t = y + 7.5
    return F.lit(0.5 * math.log(2 * math.pi)) + (y + 0.5) * F.ln(t) - t + F.ln(series)


def log_gamma(x: Column) -> Column:
    """Logarithm of the gamma function's absolute value, as a column expression; infinite at 0, -1, -2, ... and at infinity."""
    x = x.cast("double")
    low = F.when((x < 0.5) & (x > -inf()), x)  # reflected: gamma(x) gamma(1 - x) = pi / sin(pi x)
    sine = F.abs(F.sin(math.pi * (low - F.floor(low))))
    reflected = F.when(low == F.floor(low), inf()).otherwise(math.log(math.pi) - F.ln(F.when(sine > 0, sine)) - _log_gamma(1 - low))
    return F.when(F.isnan(x), x).when(F.abs(x) == inf(), inf()).when(x < 0.5, reflected).otherwise(_log_gamma(F.greatest(x, F.lit(0.5))))


#: Terms of the series below 3, and of the continued fraction from there on.
ERF_TERMS, ERF_FRACTIONS = 60, 60


def erf(x: Column) -> Column:
    """The error function as a column expression: its Maclaurin-like series near 0, a continued fraction beyond 3."""
    x = x.cast("double")
    a = F.abs(x)
    near = F.least(a, F.lit(3.0))
    # erf(x) = 2 / sqrt(pi) * exp(-x^2) * sum 2^n x^(2n+1) / (2n+1)!!, all terms positive
    terms = F.aggregate(
        F.sequence(F.lit(1), F.lit(ERF_TERMS)), F.struct(near.alias("t"), near.alias("s")),
        lambda s, n: F.struct((s["t"] * 2 * near * near / (2 * n + 1)).alias("t"), (s["s"] + s["t"] * 2 * near * near / (2 * n + 1)).alias("s")), lambda s: s["s"],
    )
    small = F.lit(2 / math.sqrt(math.pi)) * F.exp(-near * near) * terms
    far = F.least(F.greatest(a, F.lit(3.0)), F.lit(27.0))
    fraction = F.aggregate(F.sequence(F.lit(ERF_FRACTIONS), F.lit(1), F.lit(-1)), far, lambda s, n: far + (n / 2.0) / s)
    large = 1 - F.exp(-far * far) / (F.lit(math.sqrt(math.pi)) * fraction)
    return F.when(F.isnan(x), nan()).otherwise(F.signum(x) * F.when(a < 3, small).otherwise(large))


#: Spark's own functions that already agree.
PLAIN = {
    "abs": F.abs, "sign": F.signum, "exp": F.exp, "sqrt": F.sqrt, "sin": F.sin, "cos": F.cos, "tan": F.tan, "arcsin": F.asin, "arccos": F.acos, "arctan": F.atan, "sinh": F.sinh, "cosh": F.cosh, "tanh": F.tanh,
    "arcsinh": F.asinh, "arccosh": F.acosh, "arctanh": F.atanh, "ceil": F.ceil, "floor": F.floor, "arctan2": F.atan2, "square": lambda x: x * x,
}
