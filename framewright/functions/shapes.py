"""Crop shapes: outlines, signed distances, masks and their use on pixels.

Outlines are complex arrays (x + iy), so turning and scaling are plain arithmetic.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# Segments and limits (fixed values).
ELLIPSE_SEGMENTS, CORNER_SEGMENTS, POLYGON_CORNER_SEGMENTS, BEZIER_SEGMENTS = 128, 16, 8, 16
MAX_KOCH_ITERATIONS, MIN_SIDES, MAX_MASK_SIDE = 5, 3, 2048
KINDS = ["rectangle", "rounded_rectangle", "chamfered_rectangle", "ellipse", "polygon", "star", "koch_polygon", "koch_rectangle"]
CORNERS = ["sharp", "rounded", "chamfered", "bezier"]

f4 = np.float32


@dataclass(frozen=True)
class Shape:
    """A tagged union: ``kind`` says which parameters count."""

    kind: str = "rectangle"
    size_pct: float = 0.0  # radius or inset of corners, as a share of the shorter side
    sides: int = MIN_SIDES  # of polygons; points of stars
    rotation_deg: float = 0.0
    corner_style: str = "sharp"
    corner_size: float = 0.0  # radius or inset as a share; tension for bezier
    inner_radius_pct: float = 0.5
    iterations: int = 0

    def sanitized(self) -> "Shape":
        hold = lambda v, hi: min(max(v, 0.0), hi)
        return replace(
            self,
            size_pct=hold(self.size_pct, 0.5),
            sides=max(self.sides, MIN_SIDES),
            corner_size=hold(self.corner_size, 2.0 if self.corner_style == "bezier" else 0.5),
            inner_radius_pct=hold(self.inner_radius_pct, 1.0),
            iterations=min(self.iterations, MAX_KOCH_ITERATIONS),
        )


def _rectangle(w: float, h: float) -> np.ndarray:
    return np.array([0, w, w + 1j * h, 1j * h])


def _arc(center: complex | np.ndarray, radius: float, start: float, stop: float, steps: int) -> np.ndarray:
    return center + radius * np.exp(1j * np.linspace(start, stop, steps + 1))


def _unit(v: np.ndarray) -> np.ndarray:
    size = np.abs(v)
    return np.divide(v, size, out=np.zeros_like(v), where=size > 0)


def _corners(vertices: np.ndarray, style: str, size: float) -> np.ndarray:
    """A polygon with its corners cut, rounded or drawn as curves."""
    before, after = np.roll(vertices, 1), np.roll(vertices, -1)
    if style == "sharp" or size <= 0:
        return vertices
    if style == "bezier":
        tangent = (after - before) * size * 0.5
        c1, c2 = vertices + tangent, np.roll(vertices - tangent, -1)
        t = np.arange(BEZIER_SEGMENTS) / BEZIER_SEGMENTS
        weight = np.stack([(1 - t) ** 3, 3 * (1 - t) ** 2 * t, 3 * (1 - t) * t**2, t**3], axis=1)
        return (np.stack([vertices, c1, c2, after], axis=1) @ weight.T).ravel()
    incoming, outgoing = _unit(vertices - before), _unit(after - vertices)
    room = np.minimum(np.abs(vertices - before), np.abs(after - vertices)) / 2
    if style == "chamfered":
        cut = np.minimum(size, np.stack([np.abs(vertices - before), np.abs(after - vertices)]) / 2)
        return np.stack([vertices - incoming * cut[0], vertices + outgoing * cut[1]], axis=1).ravel()
    half = np.arccos(np.clip((-incoming * outgoing.conj()).real, -0.9999, 0.9999)) / 2
    offset = np.minimum(size / np.tan(half), room)
    center = vertices + _unit(outgoing - incoming) * size / np.sin(half)
    first, last = np.angle(vertices - incoming * offset - center), np.angle(vertices + outgoing * offset - center)
    turn = np.mod(last - first, 2 * np.pi)
    turn[turn == 0] = 2 * np.pi
    return np.concatenate([_arc(c, size, a, a + d, POLYGON_CORNER_SEGMENTS) for c, a, d in zip(center, first, turn)])


def _koch(vertices: np.ndarray, iterations: int) -> np.ndarray:
    """Each edge gets an outward triangle on its middle third, again and again."""
    peak = np.exp(-1j * np.pi / 3)
    for _ in range(iterations):
        third = (np.roll(vertices, -1) - vertices) / 3
        vertices = np.stack([vertices, vertices + third, vertices + third + third * peak, vertices + 2 * third], axis=1).ravel()
    return vertices


def _fitted(points: np.ndarray, w: float, h: float) -> np.ndarray:
    """Scaled alike both ways to fill the bounds, centred."""
    lo = points.real.min() + 1j * points.imag.min()
    span = points.real.max() + 1j * points.imag.max() - lo
    if span.real <= 1.2e-7 or span.imag <= 1.2e-7:
        return points
    k = min(w / span.real, h / span.imag)
    return (points - lo) * k + ((w + 1j * h) - span * k) / 2


def outline(width: int, height: int, shape: Shape) -> np.ndarray:
    """Points (n, 2) of the shape's outline in an image of the given size."""
    w, h = float(max(width, 1)), float(max(height, 1))
    s = shape.sanitized()
    short, middle = min(w, h), (w + 1j * h) / 2
    fit = True
    if s.kind in ("polygon", "koch_polygon"):
        around = np.radians(s.rotation_deg) + 2 * np.pi * np.arange(s.sides) / s.sides
        points = middle + short / 2 * np.exp(1j * around)
        if s.kind == "polygon":
            size = s.corner_size if s.corner_style == "bezier" else min(short * s.corner_size, short / 2)
            points = _corners(points, s.corner_style, size)
        else:
            points = _koch(points, s.iterations)
    elif s.kind == "star":
        k = np.arange(2 * s.sides)
        radius = short / 2 * np.where(k % 2 == 0, 1.0, s.inner_radius_pct)
        points = middle + radius * np.exp(1j * (np.radians(s.rotation_deg) + np.pi * k / s.sides))
    elif s.kind == "koch_rectangle":
        points = _koch(_rectangle(w, h), s.iterations)
    else:
        fit = False
        inset = min(short * s.size_pct, short / 2)
        if s.kind == "ellipse":
            a = 2 * np.pi * np.arange(ELLIPSE_SEGMENTS) / ELLIPSE_SEGMENTS
            points = w / 2 * (1 + np.cos(a)) + 1j * h / 2 * (1 + np.sin(a))
        elif inset <= 0 or s.kind == "rectangle":
            points = _rectangle(w, h)
        elif s.kind == "rounded_rectangle":
            q = np.pi / 2
            centers = [w - inset + 1j * inset, w - inset + 1j * (h - inset), inset + 1j * (h - inset), inset + 1j * inset]
            points = np.concatenate([_arc(c, inset, (k - 1) * q, k * q, CORNER_SEGMENTS) for k, c in enumerate(centers)])
        else:
            points = np.array([inset, w - inset, w + 1j * inset, w + 1j * (h - inset), w - inset + 1j * h, inset + 1j * h, 1j * (h - inset), 1j * inset])
    if fit:
        points = _fitted(points, w, h)
    return np.stack([points.real, points.imag], axis=1).astype(f4)


class OutlineTable:
    """Table function: (idx, x, y) of a shape's outline."""

    def eval(self, width: int, height: int, kind: str, size: float, sides: int, rotation: float, iterations: int) -> Iterator[tuple]:
        shape = Shape(kind, size_pct=size or 0.0, sides=sides or MIN_SIDES, rotation_deg=rotation or 0.0, inner_radius_pct=size or 0.0, iterations=iterations or 0)
        for i, (x, y) in enumerate(outline(width, height, shape).tolist()):
            yield i, x, y


def register(spark: SparkSession) -> None:
    """Make ``crop_outline(width, height, kind, size, sides, rotation, iterations)`` known to SQL."""
    spark.udtf.register("crop_outline", F.udtf(OutlineTable, returnType="idx int, x float, y float"))


def ellipse_point(width: Column, height: Column, i: Column) -> tuple[Column, Column]:
    """x and y of the ``i``-th point of an ellipse's outline; the unit circle's points are constants."""
    angles = np.arange(ELLIPSE_SEGMENTS) * (2 * np.pi / ELLIPSE_SEGMENTS)
    at = lambda values: F.get(F.array(*[F.lit(1 + float(v)) for v in values]), i)
    return width / 2 * at(np.cos(angles)), height / 2 * at(np.sin(angles))


def ellipse_outline(width: Column, height: Column) -> Column:
    """The points of an ellipse's outline as an array expression."""
    point = lambda i: F.struct(*[c.alias(n) for c, n in zip(ellipse_point(width, height, i), "xy")])
    return F.transform(F.sequence(F.lit(0), F.lit(ELLIPSE_SEGMENTS - 1)), point)


def signed_distance(kind: str, px: Column, py: Column, width: Column, height: Column, size_pct: float = 0.0) -> Column:
    """Distance of a pixel centre from the edge of one of the four simple shapes, negative inside."""
    short = F.least(width, height)
    ax, ay = F.abs(px - width / 2), F.abs(py - height / 2)
    inset = short * min(max(size_pct, 0.0), 0.5)

    def box(bx: Column, by: Column) -> Column:
        dx, dy = ax - bx, ay - by
        none = F.lit(0.0)
        return F.sqrt(F.pow(F.greatest(dx, none), 2) + F.pow(F.greatest(dy, none), 2)) + F.least(F.greatest(dx, dy), none)

    if kind == "ellipse":
        return (F.sqrt(F.pow(ax / (width / 2), 2) + F.pow(ay / (height / 2), 2)) - 1) * short / 2
    if kind == "rounded_rectangle":
        return box(width / 2 - inset, height / 2 - inset) - inset
    edge = box(width / 2, height / 2)
    if kind == "chamfered_rectangle":
        return F.greatest(edge, (ax + ay - (width / 2 + height / 2 - inset)) * float(np.sqrt(0.5)))
    return edge


def mask_alpha(distance: Column, softness_px: Column) -> Column:
    soft = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.5 - 0.5 * distance / F.nullif(softness_px, F.lit(0.0))))
    return F.when(softness_px > 0, soft).otherwise(F.when(distance <= 0, 1.0).otherwise(0.0))


def _distance_array(shape: Shape, w: int, h: int) -> np.ndarray:
    s = shape.sanitized()
    y, x = np.mgrid[:h, :w] + 0.5
    ax, ay = np.abs(x - w / 2), np.abs(y - h / 2)
    inset = min(w, h) * s.size_pct

    def box(bx: float, by: float) -> np.ndarray:
        dx, dy = ax - bx, ay - by
        return np.hypot(np.maximum(dx, 0), np.maximum(dy, 0)) + np.minimum(np.maximum(dx, dy), 0)

    if s.kind == "ellipse":
        return (np.hypot(ax / (w / 2), ay / (h / 2)) - 1) * min(w, h) / 2
    if s.kind == "rounded_rectangle":
        return box(w / 2 - inset, h / 2 - inset) - inset
    if s.kind == "chamfered_rectangle":
        return np.maximum(box(w / 2, h / 2), (ax + ay - (w / 2 + h / 2 - inset)) * np.sqrt(0.5))
    return box(w / 2, h / 2)


def _filled(points: np.ndarray, w: int, h: int, fine: int = 4) -> np.ndarray:
    """Coverage of a polygon per pixel, by even-odd crossings on ``fine`` lines a pixel."""
    out = np.zeros((h, w), dtype=f4)
    a, b = points.astype(np.float64), np.roll(points, -1, axis=0).astype(np.float64)
    edges = np.arange(w + 1)
    for k in range(h * fine):
        y = (k + 0.5) / fine
        hit = (a[:, 1] <= y) != (b[:, 1] <= y)
        if not hit.any():
            continue
        p, q = a[hit], b[hit]
        xs = np.sort(p[:, 0] + (y - p[:, 1]) / (q[:, 1] - p[:, 1]) * (q[:, 0] - p[:, 0]))
        for lo, hi in zip(xs[::2], xs[1::2]):
            inside = np.clip(np.minimum(edges[1:], hi) - np.maximum(edges[:-1], lo), 0, 1)
            out[k // fine] += (inside / fine).astype(f4)
    return np.minimum(out, 1)


def mask(width: int, height: int, shape: Shape, softness: float = 0.0) -> np.ndarray:
    """Alpha from 0 to 1 per pixel: by distance for the four simple shapes, else by filling the outline."""
    soft = max(1.0, min(width, height) * 0.5 * softness) if softness > 0 else 0.0
    if shape.kind in ("rectangle", "ellipse", "rounded_rectangle", "chamfered_rectangle"):
        d = _distance_array(shape, width, height)
        return (np.clip(0.5 - 0.5 * d / soft, 0, 1) if soft else (d <= 0)).astype(f4)
    k = min(1.0, MAX_MASK_SIDE / max(width, height))
    w, h = max(1, round(width * k)), max(1, round(height * k))
    hard = _filled(outline(w, h, shape), w, h)
    if soft:
        from ..operators.pixels import _kernel_pass

        sigma = soft * k / 2
        weigh = lambda x: np.exp(-(x * x) / (2 * sigma * sigma))
        hard = hard * _kernel_pass(_kernel_pass(hard, h, 2 * sigma + 1, weigh, 0), w, 2 * sigma + 1, weigh, 1)
    if (w, h) == (width, height):
        return hard.astype(f4)
    ys, xs = ((np.arange(n) + 0.5) * m / n - 0.5 for n, m in ((height, h), (width, w)))
    y0, x0 = np.clip(ys.astype(int), 0, h - 2), np.clip(xs.astype(int), 0, w - 2)
    fy, fx = np.clip(ys - y0, 0, 1)[:, None], np.clip(xs - x0, 0, 1)[None, :]
    top = hard[y0][:, x0] * (1 - fx) + hard[y0][:, x0 + 1] * fx
    low = hard[y0 + 1][:, x0] * (1 - fx) + hard[y0 + 1][:, x0 + 1] * fx
    return (top * (1 - fy) + low * fy).astype(f4)


def apply_mask(img: np.ndarray, shape: Shape, softness: float = 0.0, intensity: float = 1.0, color: tuple[int, int, int] = (0, 0, 0)) -> np.ndarray:
    """Colours outside the shape move towards the vignette colour (cut), and alpha is multiplied (rounded)."""
    if shape.kind == "rectangle" and softness <= 0:
        return img.copy()
    alpha = mask(img.shape[1], img.shape[0], shape, softness)
    out = img.copy()
    if intensity > 0:
        rgb = img[..., :3].astype(f4)
        mix = ((1 - alpha) * f4(intensity))[..., None]
        out[..., :3] = np.clip(rgb + mix * (np.array(color, dtype=f4) - rgb), 0, 255).astype(np.uint8)
    out[..., 3] = np.floor(img[..., 3].astype(f4) * alpha + f4(0.5)).astype(np.uint8)
    return out
