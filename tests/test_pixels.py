import numpy as np
import pytest

from framewright.functions.shapes import KINDS, Shape, apply_mask, mask, outline
from framewright.operators import pixels as px


def image(h=16, w=12, seed=0):
    img = np.random.default_rng(seed).integers(0, 256, (h, w, 4), dtype=np.uint8)
    img[..., 3] = 255
    return img


def test_tables_and_identities():
    img = image()
    assert (px.brightness(img, 300)[..., :3] == 255).all() and (px.exposure(img, 0) == img).all()
    assert px.contrast(np.full((1, 1, 4), 255, np.uint8), 9).max() == 255
    grey = px.saturation(img, 0.0)
    assert (grey[..., 0] == grey[..., 1]).all() and (px.saturation(img, 1.0) == img).all()
    flat = np.full((4, 4, 4), 77, np.uint8)
    assert (px.equalize(flat) == flat).all()
    ramp = np.repeat(np.arange(100, 116, dtype=np.uint8).reshape(4, 4, 1), 4, axis=2)
    assert px.equalize(ramp)[..., 0].min() == 0 and px.equalize(ramp)[..., 0].max() == 255


def test_filters_leave_flat_images():
    flat = np.full((20, 20, 4), 90, np.uint8)
    for out in (px.blur(flat, 2.5), px.unsharp(flat, 1.5, 1.0), px.smooth_skin(flat, 1.0, 2.0, 25.0), px.blur_background(flat, 5, 0.6), px.resize(flat, 7, 31, "lanczos3")):
        assert (out == 90).all()


def test_smoothing_equals_pixel_by_pixel():
    h, w, sigma, amount = 9, 7, 1.4, np.float32(0.3)
    img = image(h, w)
    img[..., :3] //= 4  # near colours, so that they mix
    r, rgb = 3, img[..., :3].astype(np.float64)
    want = img.copy()
    for y in range(h):
        for x in range(w):
            total, weights = np.zeros(3), 0.0
            for dy in range(-r, r + 1):
                for dx in range(-r, r + 1):
                    other = rgb[min(max(y + dy, 0), h - 1), min(max(x + dx, 0), w - 1)]
                    weight = np.exp(-(dy * dy + dx * dx) / (2 * sigma**2) - ((other - rgb[y, x]) ** 2).sum() / (2 * 25.0**2))
                    total, weights = total + weight * other, weights + weight
            smooth = np.floor(total / weights + 0.5)
            want[y, x, :3] = np.floor((rgb[y, x] + np.float64(amount) * (smooth - rgb[y, x])).astype(np.float32) + 0.5)
    assert (px.smooth_skin(img, 0.3, sigma, 25.0) == want).all() and (want != img).any()


@pytest.mark.parametrize("h,w,sigma", [(1, 1, 2.0), (5, 90, 0.9), (200, 3, 15.0), (7, 150, 9.0)])
def test_blur_of_any_size_equals_plain_sums(h, w, sigma):
    img = image(h, w)

    def plain(n):
        at = np.arange(n)
        lo = np.maximum(np.floor(at + 0.5 - (2 * sigma + 1)), 0)
        far = at[None, :] - lo[:, None]
        weight = np.exp(-((at[None, :] - at[:, None]) ** 2) / (2 * sigma**2)) * (far >= 0) * (far < np.ceil(2 * (2 * sigma + 1)) + 2)
        return weight / weight.sum(axis=1, keepdims=True)

    want = np.einsum("ab,bcd,ec->aed", plain(h), img.astype(np.float64), plain(w))
    got = px.blur(img, sigma).astype(np.float64)
    assert np.abs(got - want).max() < 0.5 + 1e-3


def test_red_eye():
    img = np.full((5, 5, 4), 50, np.uint8)
    img[2, 2] = (200, 40, 60, 255)
    img[0, 0] = (200, 40, 60, 255)
    assert px.remove_red_eye(img, 1.5)[2, 2, 0] == 50
    out = px.remove_red_eye(img, 1.5, [(2.0, 2.0, 1.0)])
    assert out[2, 2, 0] == 50 and out[0, 0, 0] == 200


def test_sharpness_buckets_and_downscaling():
    checks = ((np.arange(64)[:, None] + np.arange(64)[None, :]) % 2 * 255).astype(np.uint8)
    img = np.dstack([checks] * 3 + [np.full_like(checks, 255)])
    assert px.sharpness(img) > 1000 and px.sharpness(np.full((64, 64, 4), 90, np.uint8)) == 0.0
    assert px.sharpness(np.zeros((2, 9, 4), np.uint8)) == 0.0 and px.sharpness(np.zeros((900, 1200, 4), np.uint8)) == 0.0


def test_crop_pads_and_rotates():
    img = image()
    out = px.crop(img, (-2, -3, 8, 9), 0, 0, fill=(1, 2, 3, 4))
    assert out.shape == (9, 8, 4) and tuple(out[0, 0]) == (1, 2, 3, 4) and (out[3:, 2:] == img[:6, :6]).all()
    assert px.crop(img, (0, 0, 8, 8), 20, 10).shape == (10, 20, 4)
    assert (px.rotate(img, 0.0)[1:-1, 1:-1] == img[1:-1, 1:-1]).all()


def test_tensor_layout_and_packing():
    img = image(8, 8)
    t = px.to_tensor(img, 8, 8)
    assert t.shape == (1, 3, 8, 8) and (t[0, 0] == img[..., 2]).all() and (t[0, 2] == img[..., 0]).all()
    assert (px.unpack_rgba(px.pack_rgba(img)) == img).all() and px.pack_rgba(img)[0, 0] & 255 == img[0, 0, 0]
    assert px.thumbnail(image(300, 200)).shape == (96, 64, 4)


def test_composite_cuts_fractions():
    img = np.array([[[100, 100, 100, 127]]], np.uint8)
    assert px.composite(img, (0, 0, 0))[0, 0].tolist() == [49, 49, 49, 255]


@pytest.mark.parametrize("kind", KINDS)
def test_outlines_fill_their_bounds(kind):
    p = outline(120, 80, Shape(kind, size_pct=0.2, sides=5, rotation_deg=17, iterations=2))
    assert p.min() >= -1e-3 and p[:, 0].max() <= 120.01 and p[:, 1].max() <= 80.01
    assert max(p[:, 0].max() - p[:, 0].min() - 120, p[:, 1].max() - p[:, 1].min() - 80) == pytest.approx(0, abs=0.1)
    m = mask(60, 40, Shape(kind, size_pct=0.2, sides=5, iterations=1))
    assert m.shape == (40, 60) and m[20, 30] == 1 and 0 <= m.min() and m.max() <= 1


@pytest.mark.parametrize("style,n", [("sharp", 6), ("chamfered", 12), ("rounded", 54), ("bezier", 96)])
def test_polygon_corners(style, n):
    assert len(outline(100, 100, Shape("polygon", sides=6, corner_style=style, corner_size=0.1))) == n


def test_mask_on_pixels():
    img = np.full((40, 40, 4), 200, np.uint8)
    assert (apply_mask(img, Shape()) == img).all()
    out = apply_mask(img, Shape("ellipse"))
    assert out[0, 0].tolist() == [0, 0, 0, 0] and out[20, 20].tolist() == [200, 200, 200, 200]
    soft = apply_mask(img, Shape("ellipse"), softness=0.5, intensity=0.0)
    assert 0 < soft[20, 1, 3] < 200 and soft[20, 1, 0] == 200
    assert len(outline(50, 50, Shape("koch_rectangle", iterations=9))) == 4 * 4**5


def test_rows_of_images(spark):
    img = image(6, 5)
    df = spark.createDataFrame([(1, 5, 6, img.tobytes()), (2, 5, 6, None), (3, 1, 1, b"x")], "id int, width int, height int, data binary")
    got = {r.id: r for r in px.score_images(px.enhance_images(df, "natural")).collect()}
    want = px.enhance(img, px.PRESETS["natural"])
    assert got[1].data == want.tobytes() and got[1].quality_score == pytest.approx(px.sharpness(want)) and got[2].data is None and got[3].data is None


def test_batches_of_images_are_bounded_by_their_bytes(spark):
    import pyarrow as pa

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"])

    images = spark.range(0, 1500, numPartitions=1).selectExpr("id", "CAST(repeat('x', 65536) AS BINARY) AS data")
    most = max(r["n"] for r in images.mapInArrow(sizes, "n long").collect())
    assert most < 40_000_000
