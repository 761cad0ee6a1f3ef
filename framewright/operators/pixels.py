"""Pixel kernels on RGBA arrays, and the Arrow-batched operators that run them over images.

Kernels take and return uint8 arrays of shape (height, width, 4) and work in float32.  Images travel as
rows of width, height and data; a batch holds few rows, so memory stays within some images.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

f4 = np.float32
EPSILON = f4(1e-6)
QUALITY_SIDE = 512


@dataclass(frozen=True)
class Enhancement:
    """Strengths of all filters, named as in settings files (fixed values); the defaults sharpen a little and do nothing else."""

    auto_color: bool = False
    exposure_stops: float = 0.0
    brightness: int = 0
    contrast: float = 1.0
    saturation: float = 1.0
    unsharp_amount: float = 0.6
    unsharp_radius: float = 1.0
    sharpness: float = 0.0
    skin_smooth_amount: float = 0.0
    skin_smooth_sigma_space: float = 3.0
    skin_smooth_sigma_color: float = 25.0
    red_eye_removal: bool = False
    red_eye_threshold: float = 1.5
    background_blur: bool = False
    background_blur_radius: float = 15.0
    background_blur_mask_size: float = 0.6


# Named settings (fixed values).
PRESETS = {
    "natural": Enhancement(auto_color=True, exposure_stops=0.1, contrast=1.1, saturation=1.05, sharpness=0.2),
    "vivid": Enhancement(exposure_stops=0.3, brightness=10, contrast=1.25, saturation=1.3, unsharp_amount=0.9, unsharp_radius=1.2, sharpness=0.5),
    "professional": Enhancement(auto_color=True, exposure_stops=0.2, contrast=1.15, saturation=1.05, unsharp_amount=1.2, sharpness=0.8),
}


def enhancement(preset: str | None = None, **overrides) -> Enhancement:
    """A preset (exact lower-case name; unknown ones give the defaults) with explicit settings over it."""
    return replace(PRESETS.get(preset or "", Enhancement()), **{k: v for k, v in overrides.items() if v is not None})


def _bytes(x: np.ndarray) -> np.ndarray:
    """Rounded half away from zero and held within a byte."""
    return np.clip(np.floor(np.abs(x) + f4(0.5)) * np.sign(x), 0, 255).astype(np.uint8)


def _through(img: np.ndarray, lut: np.ndarray) -> np.ndarray:
    out = img.copy()
    out[..., :3] = lut[img[..., :3]]
    return out


def equalize(img: np.ndarray) -> np.ndarray:
    """Each colour channel through its own equalised histogram."""
    out = img.copy()
    total = img.shape[0] * img.shape[1]
    if not total:
        return out
    for c in range(3):
        cdf = np.cumsum(np.bincount(img[..., c].ravel(), minlength=256))
        low = int(cdf[cdf > 0][0])
        if low < total:
            lut = _bytes(np.maximum(cdf - low, 0).astype(f4) / f4(total - low) * f4(255))
            out[..., c] = lut[img[..., c]]
    return out


VALUES = np.arange(256, dtype=f4)


def exposure(img: np.ndarray, stops: float) -> np.ndarray:
    return _through(img, _bytes(VALUES * np.power(f4(2), f4(np.clip(stops, -2, 2)))))


def brightness(img: np.ndarray, offset: int) -> np.ndarray:
    return _through(img, np.clip(np.arange(256) + offset, 0, 255).astype(np.uint8))


def contrast(img: np.ndarray, multiplier: float) -> np.ndarray:
    m = np.float64(f4(np.clip(multiplier, 0.5, 2)))
    spread = (m * (VALUES / f4(255) - f4(0.5)) + 0.5).astype(f4)
    return _through(img, _bytes(np.clip(spread, 0, 1) * f4(255)))


def saturation(img: np.ndarray, multiplier: float) -> np.ndarray:
    m = f4(np.clip(multiplier, 0, 2.5))
    rgb = img[..., :3].astype(f4)
    grey = rgb[..., 0] * f4(0.299) + rgb[..., 1] * f4(0.587) + rgb[..., 2] * f4(0.114)
    out = img.copy()
    out[..., :3] = _bytes(grey[..., None] * (f4(1) - m) + rgb * m)
    return out


def smooth_skin(img: np.ndarray, amount: float, sigma_space: float, sigma_color: float) -> np.ndarray:
    """Bilateral smoothing with repeated edge pixels, mixed in by ``amount``; one shifted copy at a time."""
    if amount <= 0 or not img.size:
        return img.copy()
    h, w = img.shape[:2]
    r = int(np.ceil(f4(sigma_space) * f4(2)))
    # Padded planes as flat rows, so that a step to a neighbour is one offset; what padding columns get is not read.
    wide = w + 2 * r
    padded = np.pad(img[..., :3].astype(f4).transpose(2, 0, 1), ((0, 0), (r, r), (r, r)), mode="edge")
    planes = np.pad(padded.reshape(3, -1), ((0, 0), (r, r)))
    first, n = r + r * wide, h * wide
    total = planes[:, first : first + n].copy()
    weights = np.ones(n, dtype=f4)  # the pixel itself
    by_color = f4(-0.5) / (f4(sigma_color) * f4(sigma_color))
    apart, part = np.empty((3, n + r * wide + r), dtype=f4), np.empty((3, n), dtype=f4)
    for dy in range(r + 1):
        for dx in range(-r if dy else 1, r + 1):
            # Two pixels weigh each other alike, so a step and its reverse share one map of weights.
            step = dy * wide + dx
            lo, many = first - step, n + step
            d = np.subtract(planes[:, lo : lo + many], planes[:, lo + step : lo + step + many], out=apart[:, :many])
            weight = np.square(d, out=d)[0]
            weight += d[1]
            weight += d[2]
            weight *= by_color
            np.maximum(weight, f4(-80), out=weight)  # adds nothing to a byte either way, and denormal numbers are slow
            np.exp(weight, out=weight)
            weight *= f4(np.exp(-(dx * dx + dy * dy) / (2 * sigma_space * sigma_space)))
            for mine, other in ((weight[step:], first + step), (weight[:n], first - step)):
                total += np.multiply(planes[:, other : other + n], mine, out=part)
                weights += mine
    inner = (total / weights).reshape(3, h, wide)[:, :, r : r + w].transpose(1, 2, 0)
    smooth = _bytes(inner).astype(f4)
    rgb = img[..., :3].astype(np.float64)
    out = img.copy()
    # A product plus a term, rounded once.
    out[..., :3] = _bytes((rgb + f4(min(1.0, amount)) * (smooth - rgb)).astype(f4))
    return out


def remove_red_eye(img: np.ndarray, threshold: float, eyes: list[tuple[float, float, float]] | None = None) -> np.ndarray:
    """Red pixels take the mean of green and blue, inside the given discs or anywhere."""
    rgb = img[..., :3].astype(f4)
    mean = (rgb[..., 1] + rgb[..., 2]) * f4(0.5) + EPSILON
    red = (rgb[..., 0] > mean * f4(threshold)) & (rgb[..., 0] > 80)
    if eyes:
        y, x = np.mgrid[: img.shape[0], : img.shape[1]].astype(f4)
        red &= np.any([(x - f4(a)) ** 2 + (y - f4(b)) ** 2 <= f4(r) ** 2 for a, b, r in eyes], axis=0)
    out = img.copy()
    out[..., 0] = np.where(red, _bytes(mean), img[..., 0])
    return out


def _kernel_weights(n: int, size: int, support: float, weigh: Callable[[np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Places (from n on: none) and weights, summing to 1, of each of ``size`` samples of ``n``; the kernel is widened when shrinking."""
    ratio = n / size
    scale = max(ratio, 1.0)
    centers = (np.arange(size) + 0.5) * ratio
    reach = support * scale
    lo = np.clip(np.floor(centers - reach).astype(int), 0, n - 1)
    span = int(np.ceil(2 * reach)) + 2
    at = lo[:, None] + np.arange(span)[None, :]
    weight = weigh((at + 0.5 - centers[:, None]) / scale) * (at < n)
    return at, (weight / weight.sum(axis=1, keepdims=True)).astype(f4)


def _kernel_pass(img: np.ndarray, size: int, support: float, weigh: Callable[[np.ndarray], np.ndarray], axis: int) -> np.ndarray:
    """Resample one axis to ``size``."""
    n = img.shape[axis]
    at, weight = _kernel_weights(n, size, support, weigh)
    moved = np.moveaxis(img, axis, 0)
    rows = moved.reshape(n, -1).astype(f4)
    out = np.zeros((size, rows.shape[1]), dtype=f4)
    for k in range(at.shape[1]):  # a place of all samples at once, so that nothing as large as the span times the image is made
        out += rows[np.minimum(at[:, k], n - 1)] * weight[:, k, None]
    return np.moveaxis(out.reshape(size, *moved.shape[1:]), 0, axis)


def _band_pass(img: np.ndarray, size: int, support: float, weigh: Callable[[np.ndarray], np.ndarray], axis: int) -> np.ndarray:
    """The same for long kernels, without a change of size: products with a band matrix, some rows at a time, so it stays narrow at any size."""
    n = img.shape[axis]
    at, weight = _kernel_weights(n, size, support, weigh)
    moved = np.moveaxis(img, axis, 0)
    rows = moved.reshape(n, -1).astype(f4)
    out = np.empty_like(rows)
    block = max(32, at.shape[1])
    for k in range(0, n, block):
        here, left, right = at[k : k + block], at[k, 0], min(at[min(k + block, n) - 1, -1] + 1, n)
        band = np.zeros((len(here), right - left), dtype=f4)
        i, j = np.nonzero(here < n)
        band[i, here[i, j] - left] = weight[k : k + block][i, j]
        np.matmul(band, rows[left:right], out=out[k : k + block])
    return np.moveaxis(out.reshape(moved.shape), 0, axis)


def _triangle(x: np.ndarray) -> np.ndarray:
    return np.maximum(0, 1 - np.abs(x))


def _lanczos3(x: np.ndarray) -> np.ndarray:
    return np.where(np.abs(x) < 3, np.sinc(x) * np.sinc(x / 3), 0)


def resize(img: np.ndarray, width: int, height: int, kernel: str = "triangle") -> np.ndarray:
    """To a size, aspect not kept; nearest, triangle or lanczos3."""
    if img.shape[:2] == (height, width):
        return img.copy()
    if kernel == "nearest":
        ys, xs = (np.minimum(((np.arange(n) + 0.5) * m / n).astype(int), m - 1) for n, m in ((height, img.shape[0]), (width, img.shape[1])))
        return img[ys][:, xs]
    support, weigh = (1.0, _triangle) if kernel == "triangle" else (3.0, _lanczos3)
    return _bytes(_kernel_pass(_kernel_pass(img, height, support, weigh, 0), width, support, weigh, 1))


def blur(img: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian, separable, edges renormalised."""
    if sigma <= 0:
        return img.copy()
    weigh = lambda x: np.exp(-(x * x) / (2 * sigma * sigma))
    h, w = img.shape[:2]
    reach = 2 * sigma + 1
    one = _band_pass if reach > 16 else _kernel_pass
    return _bytes(one(one(img, h, reach, weigh, 0), w, reach, weigh, 1))


def unsharp(img: np.ndarray, amount: float, radius: float) -> np.ndarray:
    if amount <= 0 or radius <= 0:
        return img.copy()
    soft = blur(img, radius)[..., :3].astype(f4)
    rgb = img[..., :3].astype(f4)
    out = img.copy()
    out[..., :3] = _bytes(rgb + f4(min(2.0, amount)) * (rgb - soft))
    return out


def blur_background(img: np.ndarray, radius: float, mask_size: float) -> np.ndarray:
    """Blurred outside a centred ellipse, mixed across its edge."""
    if radius <= 0 or not img.size:
        return img.copy()
    h, w = img.shape[:2]
    size = f4(np.clip(mask_size, 0.3, 1.0))
    y, x = np.mgrid[:h, :w].astype(f4)
    d = np.sqrt(((x - f4(w / 2)) / (f4(w / 2) * size)) ** 2 + ((y - f4(h / 2)) / (f4(h / 2) * size)) ** 2)
    mix = np.clip((d - f4(0.9)) * f4(5), 0, 1)[..., None]
    sharp, soft = img.astype(f4), blur(img, radius).astype(f4)
    return _bytes(sharp + mix * (soft - sharp))


def enhance(img: np.ndarray, s: Enhancement, eyes: list[tuple[float, float, float]] | None = None) -> np.ndarray:
    """All filters that the settings turn on, in their fixed order."""
    steps: list[tuple[bool, Callable[[np.ndarray], np.ndarray]]] = [
        (s.auto_color, equalize),
        (s.red_eye_removal, lambda x: remove_red_eye(x, s.red_eye_threshold, eyes)),
        (abs(s.exposure_stops) >= EPSILON, lambda x: exposure(x, s.exposure_stops)),
        (s.brightness != 0, lambda x: brightness(x, s.brightness)),
        (abs(s.contrast - 1) >= EPSILON, lambda x: contrast(x, s.contrast)),
        (abs(s.saturation - 1) >= EPSILON, lambda x: saturation(x, s.saturation)),
        (s.skin_smooth_amount > 0, lambda x: smooth_skin(x, s.skin_smooth_amount, s.skin_smooth_sigma_space, s.skin_smooth_sigma_color)),
        (s.unsharp_amount + s.sharpness > 0, lambda x: unsharp(x, s.unsharp_amount + s.sharpness, s.unsharp_radius)),
        (s.background_blur, lambda x: blur_background(x, s.background_blur_radius, s.background_blur_mask_size)),
    ]
    for on, step in steps:
        if on:
            img = step(img)
    return img


def luma(img: np.ndarray) -> np.ndarray:
    """8-bit grey by the Rec. 709 weights, cut."""
    rgb = img[..., :3].astype(np.uint32)
    return ((2126 * rgb[..., 0] + 7152 * rgb[..., 1] + 722 * rgb[..., 2]) // 10000).astype(np.uint8)


def sharpness(img: np.ndarray) -> float:
    """Variance of the Laplacian of the grey image, first shrunk to fit 512 pixels."""
    h, w = img.shape[:2]
    if max(h, w) > QUALITY_SIDE:
        k = QUALITY_SIDE / max(h, w)
        img = resize(img, max(1, round(w * k)), max(1, round(h * k)))
    g = luma(img).astype(np.int64)
    if min(g.shape) < 3:
        return 0.0
    v = g[:-2, 1:-1] + g[2:, 1:-1] + g[1:-1, :-2] + g[1:-1, 2:] - 4 * g[1:-1, 1:-1]
    return float((v * v).sum() / v.size - (v.sum() / v.size) ** 2)


def crop(img: np.ndarray, region: tuple[int, int, int, int], out_w: int, out_h: int, fill: tuple[int, int, int, int] = (0, 0, 0, 255), angle: float = 0.0) -> np.ndarray:
    """A region of the image, what lies outside filled, turned by ``angle`` about its centre and resized; an output side of 0 keeps the canvas."""
    x, y, w, h = region
    canvas = np.empty((h, w, 4), dtype=np.uint8)
    canvas[:] = fill
    ih, iw = img.shape[:2]
    x0, y0, x1, y1 = max(x, 0), max(y, 0), min(x + w, iw), min(y + h, ih)
    if x0 < x1 and y0 < y1:
        canvas[y0 - y : y1 - y, x0 - x : x1 - x] = img[y0:y1, x0:x1]
    if abs(np.degrees(angle)) >= 0.01:
        canvas = rotate(canvas, angle, fill)
    return resize(canvas, out_w, out_h, "lanczos3") if out_w and out_h else canvas


def rotate(img: np.ndarray, angle: float, fill: tuple[int, int, int, int] = (0, 0, 0, 255)) -> np.ndarray:
    """About the centre by ``angle`` radians, bilinear, same size."""
    h, w = img.shape[:2]
    cx, cy = w / 2, h / 2
    y, x = np.mgrid[:h, :w]
    c, s = np.cos(angle), np.sin(angle)
    sx, sy = c * (x - cx) + s * (y - cy) + cx, -s * (x - cx) + c * (y - cy) + cy
    x0, y0 = np.floor(sx).astype(int), np.floor(sy).astype(int)
    fx, fy = (sx - x0)[..., None].astype(f4), (sy - y0)[..., None].astype(f4)
    inside = (x0 >= 0) & (y0 >= 0) & (x0 < w - 1) & (y0 < h - 1)
    x0, y0 = np.clip(x0, 0, max(w - 2, 0)), np.clip(y0, 0, max(h - 2, 0))
    x1, y1 = np.minimum(x0 + 1, w - 1), np.minimum(y0 + 1, h - 1)
    p = img.astype(f4)
    mixed = (p[y0, x0] * (1 - fx) + p[y0, x1] * fx) * (1 - fy) + (p[y1, x0] * (1 - fx) + p[y1, x1] * fx) * fy
    return np.where(inside[..., None], _bytes(mixed), np.array(fill, dtype=np.uint8))


def thumbnail(img: np.ndarray, side: int = 96) -> np.ndarray:
    h, w = img.shape[:2]
    k = min(side / w, side / h)
    return resize(img, max(1, round(w * k)), max(1, round(h * k)))


def to_tensor(img: np.ndarray, width: int = 640, height: int = 640, kernel: str = "triangle") -> np.ndarray:
    """The detector's input: planes of blue, green and red, 0 to 255, one batch."""
    return resize(img, width, height, kernel)[..., 2::-1].transpose(2, 0, 1)[None].astype(f4)


def annotate(img: np.ndarray, rects: list[tuple[int, int, int, int]], points: list[tuple[int, int]]) -> np.ndarray:
    """Red outlines of rectangles and green discs of radius 2."""
    out = img.copy()
    h, w = img.shape[:2]
    red, green = (255, 0, 0, 255), (0, 255, 0, 255)
    for x, y, rw, rh in rects:
        x1, y1 = min(x + rw, w) - 1, min(y + rh, h) - 1
        out[[y, y1], x : x1 + 1] = red
        out[y : y1 + 1, [x, x1]] = red
    yy, xx = np.mgrid[:h, :w]
    for px, py in points:
        out[(xx - px) ** 2 + (yy - py) ** 2 <= 4] = green
    return out


def composite(img: np.ndarray, fill: tuple[int, int, int]) -> np.ndarray:
    """Over an opaque colour, fractions cut."""
    a = img[..., 3:].astype(f4) / f4(255)
    out = np.empty_like(img)
    out[..., :3] = np.clip(np.floor(img[..., :3] * a + np.array(fill, dtype=f4) * (f4(1) - a)), 0, 255)
    out[..., 3] = 255
    return out


def fill_behind(img: np.ndarray, fill: tuple[int, int, int, int]) -> np.ndarray:
    """What shows through gets a colour that may be see-through itself, fractions cut; opaque pixels stay."""
    a = img[..., 3:].astype(f4) / f4(255)
    behind = f4(fill[3]) / f4(255)
    rgb = img[..., :3].astype(f4) * a + np.array(fill[:3], dtype=f4) * behind * (f4(1) - a)
    alpha = np.minimum((a + behind * (f4(1) - a)) * f4(255), f4(255))
    made = np.clip(np.concatenate([rgb, alpha], axis=2), 0, 255).astype(np.uint8)
    return np.where(a >= 1, img, made)


def pack_rgba(img: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(img).view("<u4")[..., 0]


def unpack_rgba(packed: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(packed).astype("<u4").view(np.uint8).reshape(*packed.shape, 4)


# Operators over rows of images.


#: About so many bytes of made images leave a task at once.
OUT_BYTES = 8_000_000


def map_images(images: DataFrame, kernel: Callable[..., np.ndarray], also: str | None = None) -> DataFrame:
    """``images`` with width, height and data replaced by what ``kernel`` returns; null or misfitting data become null.

    ``also`` names a column whose value the kernel takes beside the pixels.
    """
    names = images.columns
    iw, ih, at = (names.index(c) for c in ("width", "height", "data"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made, lo, size = [], 0, 0

            def flush() -> pa.RecordBatch:
                columns = list(batch.slice(lo, len(made)).columns)
                for i, value in ((iw, lambda m: m.shape[1]), (ih, lambda m: m.shape[0]), (at, lambda m: np.ascontiguousarray(m).tobytes())):
                    columns[i] = pa.array([None if m is None else value(m) for m in made], type=columns[i].type)
                return pa.RecordBatch.from_arrays(columns, names=names)

            for k in range(batch.num_rows):
                w, h, data = (batch.column(i)[k].as_py() for i in (iw, ih, at))
                args = (batch.column(names.index(also))[k].as_py(),) if also else ()
                fits = data is not None and w is not None and h is not None and len(data) == 4 * w * h
                made.append(kernel(np.frombuffer(data, dtype=np.uint8).reshape(h, w, 4), *args) if fits else None)
                size += made[-1].nbytes if fits else 0
                if size > OUT_BYTES:  # what comes out may be far larger than what came in
                    yield flush()
                    made, lo, size = [], k + 1, 0
            if made:
                yield flush()

    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in images.schema.fields])
    return images.mapInArrow(run, schema)


def enhance_images(images: DataFrame, preset: str | None = None, **overrides) -> DataFrame:
    settings = enhancement(preset, **overrides)
    return map_images(images, lambda img: enhance(img, settings))


def score_images(images: DataFrame) -> DataFrame:
    """Add quality_score, the sharpness of each image; null where it has no fitting data."""
    names = images.columns
    iw, ih, at = (names.index(c) for c in ("width", "height", "data"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [
                sharpness(np.frombuffer(d, dtype=np.uint8).reshape(h, w, 4)) if d is not None and w is not None and h is not None and len(d) == 4 * w * h else None
                for w, h, d in zip(*(batch.column(i).to_pylist() for i in (iw, ih, at)))
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=[*names, "quality_score"])

    return images.mapInArrow(run, T.StructType([*images.schema.fields, T.StructField("quality_score", T.DoubleType())]))


#: A face beside its image.
FACE = "struct<face_idx:bigint,x:float,y:float,width:float,height:float,score:float,landmarks:array<struct<x:float,y:float>>>"


def faces_of(rows: np.ndarray) -> list[dict]:
    """Rows of 15 floats as faces, numbered from 0 in their order."""
    names = ("x", "y", "width", "height")
    return [{"face_idx": i, "score": r[14], "landmarks": [{"x": r[k], "y": r[k + 1]} for k in range(4, 14, 2)]} | dict(zip(names, r)) for i, r in enumerate(rows.tolist())]


def per_face(images: DataFrame, work: Callable[[np.ndarray, dict], tuple[np.ndarray, float]], keep: list[str]) -> DataFrame:
    """One row per face of images that hold their faces in an array column: ``keep``, face_idx, score, region, and what ``work`` makes.

    ``work`` takes the image and a face and returns pixels and their score.  An image is read where it lies
    and never crosses a shuffle; its faces go out in one batch.  Rows without fitting data give nothing.
    """
    names = images.columns
    iw, ih, at, faces = (names.index(c) for c in ("width", "height", "data", "faces"))
    face = images.schema["faces"].dataType.elementType
    fields = [*[images.schema[c] for c in keep], *[face[c] for c in ("face_idx", "score", "region")]]
    made = [T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType()), T.StructField("data", T.BinaryType()), T.StructField("quality_score", T.DoubleType())]
    schema = T.StructType([*fields, *made])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                w, h, data, found = (batch.column(i)[k].as_py() for i in (iw, ih, at, faces))
                if not found or data is None or w is None or h is None or len(data) != 4 * w * h:
                    continue
                img = np.frombuffer(data, dtype=np.uint8).reshape(h, w, 4)
                rest = [batch.column(names.index(c))[k].as_py() for c in keep]
                rows = []
                for f in found:
                    out, score = work(img, f)
                    rows.append([*rest, f["face_idx"], f["score"], f["region"], out.shape[1], out.shape[0], np.ascontiguousarray(out).tobytes(), score])
                yield pa.RecordBatch.from_arrays([pa.array(column, type=f.type) for column, f in zip(zip(*rows), arrow)], schema=arrow)

    return images.mapInArrow(run, schema)


def crop_images(faces: DataFrame, out_w: int, out_h: int, fill: tuple[int, int, int, int] = (0, 0, 0, 255)) -> DataFrame:
    """One crop per row: width, height, data and region (x, y, width, height, ...) to the cropped image."""
    names = faces.columns
    iw, ih, at, ir = (names.index(c) for c in ("width", "height", "data", "region"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for w, h, d, r in zip(*(batch.column(i).to_pylist() for i in (iw, ih, at, ir))):
                made.append(crop(np.frombuffer(d, dtype=np.uint8).reshape(h, w, 4), (r["x"], r["y"], r["width"], r["height"]), out_w, out_h, fill) if d is not None and r else None)
            columns = list(batch.columns)
            for i, value in ((iw, lambda m: m.shape[1]), (ih, lambda m: m.shape[0]), (at, lambda m: np.ascontiguousarray(m).tobytes())):
                columns[i] = pa.array([None if m is None else value(m) for m in made], type=columns[i].type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return faces.mapInArrow(run, T.StructType([T.StructField(f.name, f.dataType, True) for f in faces.schema.fields]))


@lru_cache(maxsize=4)
def _session(path: str):
    import onnxruntime

    return onnxruntime.InferenceSession(path, providers=["CPUExecutionProvider"])


def head_rows(outs: list[np.ndarray], side: int, sigmoid: bool = False) -> np.ndarray:
    """Rows of 15 floats from a model's outputs: one output holds them, twelve are the heads of three strides.

    Heads come as cls, obj, bbox and kps for each stride.  Those of four axes are planes (batch, channels,
    rows, columns) and are turned so that a cell's values stand together.  ``sigmoid`` is for models whose
    cls and obj are raw.
    """
    from .detections import decode_tensors, stride_cells

    if len(outs) == 1:
        return outs[0].reshape(-1, 15)
    if len(outs) != 12:
        raise ValueError(f"a model of {len(outs)} outputs is not supported")
    flat = [(o.transpose(0, 2, 3, 1) if o.ndim == 4 else o).reshape(-1) for o in outs]
    if sigmoid:
        flat = [f4(1) / (f4(1) + np.exp(-o.astype(f4))) if k < 6 else o for k, o in enumerate(flat)]
    return np.concatenate([decode_tensors(flat[k], flat[3 + k], flat[6 + k], flat[9 + k], stride, cols) for k, (stride, _, cols) in enumerate(stride_cells(side, side))])


def _model_rows(model_path: str, img: np.ndarray, side: int, sigmoid: bool) -> np.ndarray:
    s = _session(model_path)
    return head_rows(s.run(None, {s.get_inputs()[0].name: to_tensor(img, side, side)}), side, sigmoid)


def detect_faces(images: DataFrame, model_path: str, score: float, nms: float, top_k: int, side: int = 640, sigmoid: bool = False) -> DataFrame:
    """``images`` with the array column faces: detected, scaled, ranked and suppressed where the image lies, without a shuffle."""
    from .detections import postprocess_rows

    names = images.columns
    iw, ih, at = (names.index(c) for c in ("width", "height", "data"))
    field = T.StructField("faces", T.ArrayType(T._parse_datatype_string(FACE)))
    kind = to_arrow_schema(T.StructType([field])).field(0).type

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for w, h, d in zip(*(batch.column(i).to_pylist() for i in (iw, ih, at))):
                if d is None or w is None or h is None or len(d) != 4 * w * h:
                    found.append([])
                    continue
                rows = _model_rows(model_path, np.frombuffer(d, dtype=np.uint8).reshape(h, w, 4), side, sigmoid)
                found.append(faces_of(postprocess_rows(rows, w / side, h / side, score, nms, top_k)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, kind)], names=[*names, "faces"])

    return images.mapInArrow(run, T.StructType([*images.schema.fields, field]))


def detect_images(images: DataFrame, model_path: str, side: int = 640, sigmoid: bool = False) -> DataFrame:
    """Raw rows of 15 floats per image from an ONNX model, loaded once per Python worker.

    ``model_path`` must be readable on every executor; outputs are read as :func:`head_rows` says.
    """
    names = images.columns
    iw, ih, at = (names.index(c) for c in ("width", "height", "data"))

    def rows(img: np.ndarray) -> np.ndarray:
        return _model_rows(model_path, img, side, sigmoid)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [
                rows(np.frombuffer(d, dtype=np.uint8).reshape(h, w, 4)).tolist() if d is not None else []
                for w, h, d in zip(*(batch.column(i).to_pylist() for i in (iw, ih, at)))
            ]
            keep = [i for i in range(len(names)) if i != at]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in keep], pa.array(found, pa.list_(pa.list_(pa.float32())))], names=[*[names[i] for i in keep], "rows"])

    fields = [f for f in images.schema.fields if f.name != "data"]
    return images.mapInArrow(run, T.StructType([*fields, T.StructField("rows", T.ArrayType(T.ArrayType(T.FloatType())))]))
