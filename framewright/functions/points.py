"""Point algebra on struct columns of x and y, in single precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import f32 as q


def point(x, y) -> Column:
    return F.struct(q.f32(x).alias("x"), q.f32(y).alias("y"))


def add(a: Column, b: Column) -> Column:
    return point(q.add(a["x"], b["x"]), q.add(a["y"], b["y"]))


def sub(a: Column, b: Column) -> Column:
    return point(q.sub(a["x"], b["x"]), q.sub(a["y"], b["y"]))


def scale(a: Column, k) -> Column:
    return point(q.mul(a["x"], k), q.mul(a["y"], k))


def shrink(a: Column, k) -> Column:
    """Divided by ``k``; null coordinates for 0."""
    return point(q.div(a["x"], k), q.div(a["y"], k))


def negate(a: Column) -> Column:
    return point(-a["x"], -a["y"])


def dot(a: Column, b: Column) -> Column:
    return q.fma(a["x"], b["x"], q.mul(a["y"], b["y"]))


def length(a: Column) -> Column:
    return F.hypot(a["x"].cast("double"), a["y"].cast("double")).cast("float")


def distance(a: Column, b: Column) -> Column:
    return length(sub(a, b))


def along(a: Column, k, b: Column) -> Column:
    """``a * k + b``, each coordinate rounded once."""
    return point(q.fma(a["x"], k, b["x"]), q.fma(a["y"], k, b["y"]))
