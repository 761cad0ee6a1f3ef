import numpy as np
import pytest

from framewright.operators import imaging, tiles

TILES = "image long, ty int, tx int, width int, pixels array<int>"


def cut(spark, images, size):
    rows = []
    for k, img in images.items():
        h, w = img.shape
        for ty in range(-(-h // size)):
            for tx in range(-(-w // size)):
                part = img[ty * size : (ty + 1) * size, tx * size : (tx + 1) * size]
                rows.append((k, ty, tx, part.shape[1], part.ravel().tolist()))
    return spark.createDataFrame(rows, TILES)


@pytest.mark.parametrize("size", [1, 3, 8])
def test_tiles_give_what_the_whole_image_gives(spark, size):
    rng = np.random.default_rng(3)
    images = {k: rng.integers(0, 256, shape) for k, shape in enumerate([(7, 9), (8, 8), (1, 5), (2, 2), (3, 3)])}
    images[9] = np.full((6, 6), 40)
    cuts = cut(spark, images, size).repartition(3)
    whole = spark.createDataFrame([(k, v.ravel().tolist()) for k, v in images.items()], "image long, pixels array<int>")
    sharp = {r.image: r.sharpness for r in tiles.sharpness(cuts).collect()}
    for k, v in images.items():
        want = whole.where(f"image = {k}").select(imaging.sharpness(whole.pixels, v.shape[1], v.shape[0])).first()[0]
        assert sharp[k] == pytest.approx(want)
    luts = {(r.image, r.value): r.mapped for r in imaging.equalization_luts(whole, "image").collect()}
    done = {(r.image, r.ty, r.tx): r.pixels for r in tiles.equalized(cuts).collect()}
    for r in cuts.collect():
        assert done[r.image, r.ty, r.tx] == [luts[r.image, p] for p in r.pixels]


def test_no_tiles_and_holes(spark):
    empty = spark.createDataFrame([], TILES)
    assert tiles.sharpness(empty).count() == tiles.equalized(empty).count() == 0
    gap = spark.createDataFrame([(1, 0, 0, 2, [1, 2, 3, 4]), (1, 0, 2, 2, [5, 6, 7, 8]), (1, 5, 5, 1, [])], TILES)
    assert {r.image: r.sharpness for r in tiles.sharpness(gap).collect()} == {1: 0.0}
    assert tiles.with_edges(gap).where("before IS NOT NULL OR after IS NOT NULL").count() == 0
