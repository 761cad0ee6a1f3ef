"""Single-precision arithmetic for columns.

Spark widens quotients, roots and mixed products of floats to double, so every step that must stay in
single precision goes through these helpers.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INT_MIN, INT_MAX = -(1 << 31), (1 << 31) - 1
UINT_MAX = (1 << 32) - 1


def f32(value) -> Column:
    """A float column; numbers become literals."""
    return (value if isinstance(value, Column) else F.lit(value)).cast("float")


def add(a, b) -> Column:
    return (f32(a) + f32(b)).cast("float")


def sub(a, b) -> Column:
    return (f32(a) - f32(b)).cast("float")


def mul(a, b) -> Column:
    return (f32(a) * f32(b)).cast("float")


def div(a, b) -> Column:
    """Quotient; null where the divisor is 0."""
    return F.try_divide(f32(a).cast("double"), f32(b).cast("double")).cast("float")


def sqrt(a) -> Column:
    return F.sqrt(f32(a).cast("double")).cast("float")


def exp(a) -> Column:
    return F.exp(f32(a).cast("double")).cast("float")


def fma(a, b, c) -> Column:
    """a * b + c rounded once: the product of two floats is exact in double."""
    return (f32(a).cast("double") * f32(b).cast("double") + f32(c).cast("double")).cast("float")


def maximum(a, b) -> Column:
    """The larger value; a NaN loses to a number."""
    a, b = f32(a), f32(b)
    return F.greatest(F.nanvl(a, b), F.nanvl(b, a))


def minimum(a, b) -> Column:
    a, b = f32(a), f32(b)
    return F.least(F.nanvl(a, b), F.nanvl(b, a))


def clamp(a, lo, hi) -> Column:
    """Between two bounds; NaN stays NaN."""
    a = f32(a)
    return F.when(F.isnan(a), a).otherwise(F.greatest(f32(lo), F.least(f32(hi), a)))


def round_away(a) -> Column:
    """Nearest whole number, halves away from zero, as a double."""
    return F.round(f32(a).cast("double"), 0)


def to_int(a, lo: int = INT_MIN, hi: int = INT_MAX) -> Column:
    """Truncated to a whole number in [lo, hi]; NaN gives 0."""
    return F.greatest(F.lit(float(lo)), F.least(F.lit(float(hi)), F.nanvl(a.cast("double"), F.lit(0.0)))).cast("long")


def let(value: Column, body) -> Column:
    """Work a value out once per row and bind it in ``body``; deep formulas would else repeat it many times."""
    return F.element_at(F.transform(F.array(value), body), 1)


def is_finite(a: Column) -> Column:
    return ~F.isnan(a) & (F.abs(a) < float("inf"))
