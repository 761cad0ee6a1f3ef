"""Boxes, crop regions and rectangles as column expressions, in single precision throughout."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import f32 as q

# Output sizes of the named presets, in pixels (fixed values).
PRESETS = [
    ("LinkedIn", 400, 400, "Square professional profile photo (400×400)"),
    ("Passport", 413, 531, "Passport photo dimensions (413×531)"),
    ("Instagram", 1080, 1080, "Instagram square post (1080×1080)"),
    ("ID Card", 332, 498, "ID card photo size (332×498)"),
    ("Avatar", 512, 512, "Small square avatar (512×512)"),
    ("Headshot", 600, 800, "Vertical headshot (600×800)"),
    ("Custom", 0, 0, "User-defined custom dimensions"),
]


@dataclass(frozen=True)
class Box:
    """The four columns of a box."""

    x: Column
    y: Column
    width: Column
    height: Column

    @classmethod
    def of(cls, row: Column | str) -> "Box":
        """From a struct column with the fields x, y, width and height."""
        row = F.col(row) if isinstance(row, str) else row
        return cls(*(q.f32(row[c]) for c in ("x", "y", "width", "height")))

    @classmethod
    def named(cls, prefix: str = "", suffix: str = "") -> "Box":
        return cls(*(q.f32(F.col(f"{prefix}{c}{suffix}")) for c in ("x", "y", "width", "height")))

    @property
    def right(self) -> Column:
        return q.add(self.x, self.width)

    @property
    def bottom(self) -> Column:
        return q.add(self.y, self.height)

    @property
    def center_x(self) -> Column:
        return q.fma(self.width, 0.5, self.x)

    @property
    def center_y(self) -> Column:
        return q.fma(self.height, 0.5, self.y)

    @property
    def longest_edge(self) -> Column:
        return q.maximum(self.width, self.height)

    @property
    def area(self) -> Column:
        return q.mul(q.maximum(self.width, 0.0), q.maximum(self.height, 0.0))


def iou(a: Box, b: Box) -> Column:
    """Intersection over union; 0 where the boxes do not overlap or have no area."""
    x1, y1 = q.maximum(a.x, b.x), q.maximum(a.y, b.y)
    x2, y2 = q.minimum(a.right, b.right), q.minimum(a.bottom, b.bottom)
    inter = q.mul(q.sub(x2, x1), q.sub(y2, y1))
    union = q.sub(q.add(a.area, b.area), inter)
    return F.when((x2 <= x1) | (y2 <= y1), q.f32(0.0)).when(union > 0, q.div(inter, union)).otherwise(q.f32(0.0))


def centers_close(a: Box, b: Box, relative: float = 0.5, absolute: float = 8.0) -> Column:
    """Whether centres lie within a share of the longest edge, or within some pixels, of each other."""
    dx, dy = q.sub(b.center_x, a.center_x), q.sub(b.center_y, a.center_y)
    dist = q.fma(dx, dx, q.mul(dy, dy))
    reach = q.mul(q.maximum(q.maximum(a.longest_edge, b.longest_edge), 1.0), relative)
    return (dist < q.mul(reach, reach)) | (dist < q.f32(absolute * absolute))


def crop_region(box: Box, img_w: Column, img_h: Column, out_w: Column, out_h: Column, face_pct: Column, mode: Column, off_x: Column, off_y: Column) -> Column:
    """The source rectangle of a crop, as a struct of x, y, width, height and the four paddings.

    It may reach beyond the image; the paddings say how far.  ``mode`` is center, rule_of_thirds or custom.
    """
    face_h = q.maximum(box.height, 1.0)
    src_h = q.div(face_h, q.div(q.clamp(face_pct, 1.0, 100.0), 100.0))
    aspect = F.when(q.f32(out_h) > 0, q.div(out_w, out_h)).otherwise(q.f32(1.0))
    src_w = q.mul(src_h, aspect)
    half_w, half_h = q.mul(src_w, 0.5), q.mul(src_h, 0.5)
    cx = F.when(mode == "custom", q.add(box.center_x, q.mul(half_w, q.clamp(off_x, -1.0, 1.0)))).otherwise(box.center_x)
    cy = (
        F.when(mode == "rule_of_thirds", q.sub(box.center_y, q.div(src_h, 6.0)))
        .when(mode == "custom", q.add(box.center_y, q.mul(half_h, q.clamp(off_y, -1.0, 1.0))))
        .otherwise(box.center_y)
    )
    x, y = q.to_int(q.round_away(q.sub(cx, half_w))), q.to_int(q.round_away(q.sub(cy, half_h)))
    w, h = (q.to_int(q.round_away(v), 1, q.UINT_MAX) for v in (src_w, src_h))
    none = F.lit(0).cast("long")
    return F.struct(
        x.alias("x"),
        y.alias("y"),
        w.alias("width"),
        h.alias("height"),
        F.greatest(-x, none).alias("pad_left"),
        F.greatest(-y, none).alias("pad_top"),
        F.greatest(x + w - img_w.cast("long"), none).alias("pad_right"),
        F.greatest(y + h - img_h.cast("long"), none).alias("pad_bottom"),
    )


def requires_padding(r: Column) -> Column:
    return (r["pad_left"] > 0) | (r["pad_top"] > 0) | (r["pad_right"] > 0) | (r["pad_bottom"] > 0)


def in_bounds_rect(r: Column) -> Column:
    """The part of a region that lies inside the image, null if there is none."""
    zero = F.lit(0).cast("long")
    w = F.greatest(r["width"] - r["pad_left"] - r["pad_right"], zero)
    h = F.greatest(r["height"] - r["pad_top"] - r["pad_bottom"], zero)
    inside = F.struct((r["x"] + r["pad_left"]).alias("x"), (r["y"] + r["pad_top"]).alias("y"), w.alias("width"), h.alias("height"))
    return F.when((w > 0) & (h > 0), inside)


def _corners(box: Box, max_x: Column, max_y: Column) -> list[Column]:
    return [q.clamp(v, 0.0, m) for v, m in ((box.x, max_x), (box.y, max_y), (box.right, max_x), (box.bottom, max_y))]


def rounded_rect(box: Box, img_w: Column, img_h: Column) -> Column:
    """The box clamped to the image and rounded; null if rounding carries it over the edge."""
    x1, y1, x2, y2 = _corners(box, q.f32(img_w), q.f32(img_h))
    sides = [q.to_int(q.round_away(q.maximum(q.sub(b, a), 1.0)), 0, q.UINT_MAX) for a, b in ((x1, x2), (y1, y2))]
    left, top = (q.to_int(q.round_away(v), 0, q.UINT_MAX) for v in (x1, y1))
    rect = F.struct(left.alias("x"), top.alias("y"), sides[0].alias("width"), sides[1].alias("height"))
    return F.when((left + sides[0] <= img_w) & (top + sides[1] <= img_h), rect)


def truncated_rect(box: Box, img_w: Column, img_h: Column) -> Column:
    """The box truncated to whole pixels and cut at the image's edges."""
    zero = F.lit(0).cast("long")
    last_x, last_y = F.greatest(img_w.cast("long") - 1, zero), F.greatest(img_h.cast("long") - 1, zero)
    x = F.least(q.to_int(q.maximum(box.x, 0.0), 0, q.UINT_MAX), last_x)
    y = F.least(q.to_int(q.maximum(box.y, 0.0), 0, q.UINT_MAX), last_y)
    w = F.least(q.to_int(q.maximum(box.width, 1.0), 0, q.UINT_MAX), F.greatest(img_w.cast("long") - x, zero))
    h = F.least(q.to_int(q.maximum(box.height, 1.0), 0, q.UINT_MAX), F.greatest(img_h.cast("long") - y, zero))
    return F.struct(x.alias("x"), y.alias("y"), w.alias("width"), h.alias("height"))


def annotation_rect(box: Box, img_w: Column, img_h: Column) -> Column:
    """The outline to draw: corners clamped to the last pixel, truncated, at least one pixel each way."""
    x1, y1, x2, y2 = _corners(box, q.f32(F.greatest(img_w - 1, F.lit(0))), q.f32(F.greatest(img_h - 1, F.lit(0))))
    return F.struct(
        q.to_int(x1).alias("x"), q.to_int(y1).alias("y"), q.to_int(q.maximum(q.sub(x2, x1), 1.0)).alias("width"), q.to_int(q.maximum(q.sub(y2, y1), 1.0)).alias("height")
    )


def pixel_index(value: Column, extent: Column) -> Column:
    """A coordinate clamped to [0, extent - 1] and truncated."""
    return F.when(extent <= 0, F.lit(0).cast("long")).otherwise(q.to_int(q.clamp(value, 0.0, q.f32(extent - 1))))


def eye_discs(box: Box, right_eye: Column, left_eye: Column, region: Column, out_w: Column, out_h: Column) -> Column:
    """Both eyes in crop coordinates with a radius, or no discs where no eye is known."""
    w, h = (q.f32(F.greatest(region[c], F.lit(1).cast("long"))) for c in ("width", "height"))
    sx, sy = q.div(out_w, w), q.div(out_h, h)
    radius = q.maximum(q.mul(q.mul(q.div(box.height, h), out_h), 0.12), 4.0)
    disc = lambda e: F.struct(
        q.mul(q.sub(e["x"], region["x"]), sx).alias("x"), q.mul(q.sub(e["y"], region["y"]), sy).alias("y"), radius.alias("radius")
    )
    unknown = (right_eye["x"] == 0) & (right_eye["y"] == 0) & (left_eye["x"] == 0) & (left_eye["y"] == 0)
    return F.when(unknown, F.array().cast("array<struct<x:float,y:float,radius:float>>")).otherwise(F.array(disc(right_eye), disc(left_eye)))


def eye_angle(right_eye: Column, left_eye: Column) -> Column:
    """Angle of the line through the eyes in radians; null where no eye is known."""
    unknown = (right_eye["x"] == 0) & (right_eye["y"] == 0) & (left_eye["x"] == 0) & (left_eye["y"] == 0)
    dy, dx = q.sub(left_eye["y"], right_eye["y"]), q.sub(left_eye["x"], right_eye["x"])
    return F.when(~unknown, F.atan2(dy.cast("double"), dx.cast("double")).cast("float"))


def preset_key(name: Column) -> Column:
    """What preset names are compared by: ASCII letters and digits in lower case."""
    return F.lower(F.regexp_replace(name, "[^A-Za-z0-9]", ""))
