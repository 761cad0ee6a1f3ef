import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from framewright.functions import f32, geometry
from framewright.functions.geometry import Box

# Crop regions that must come out exactly (fixed values): image, box, output, percentage, mode, offsets, region and paddings.
GOLDEN = [
    ([512, 512], [160.0, 160.0, 140.0, 140.0], [256, 256], 70.0, "center", [0.0, 0.0], [130, 130, 200, 200, 0, 0, 0, 0]),
    ([200, 200], [40.0, 40.0, 140.0, 140.0], [256, 256], 50.0, "center", [0.0, 0.0], [-30, -30, 280, 280, 30, 30, 50, 50]),
    ([500, 500], [0.0, 0.0, 120.0, 120.0], [256, 256], 80.0, "center", [0.0, 0.0], [-15, -15, 150, 150, 15, 15, 0, 0]),
    ([800, 600], [300.0, 200.0, 160.0, 160.0], [400, 400], 60.0, "rule_of_thirds", [0.0, 0.0], [247, 102, 267, 267, 0, 0, 0, 0]),
    ([600, 600], [250.0, 250.0, 120.0, 120.0], [300, 300], 50.0, "custom", [0.5, 0.3], [250, 226, 240, 240, 0, 0, 0, 0]),
    ([1080, 1920], [400.0, 500.0, 300.0, 300.0], [360, 640], 70.0, "center", [0.0, 0.0], [429, 436, 241, 429, 0, 0, 0, 0]),
    ([1920, 1080], [800.0, 400.0, 260.0, 260.0], [640, 360], 65.0, "center", [0.0, 0.0], [574, 330, 711, 400, 0, 0, 0, 0]),
    ([1000, 1000], [450.0, 450.0, 80.0, 80.0], [400, 400], 20.0, "center", [0.0, 0.0], [290, 290, 400, 400, 0, 0, 0, 0]),
]
SCHEMA = "img_w int, img_h int, x float, y float, width float, height float, ow int, oh int, pct float, mode string, hx float, vy float"


def regions(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    r = geometry.crop_region(Box.named(), *(F.col(c) for c in ("img_w", "img_h", "ow", "oh", "pct", "mode", "hx", "vy")))
    return df.select("*", r.alias("r"), geometry.in_bounds_rect(r).alias("inside"), geometry.requires_padding(r).alias("padded")).collect()


def test_golden_regions(spark):
    got = regions(spark, [(*g[0], *g[1], *g[2], g[3], g[4], *g[5]) for g in GOLDEN])
    assert [list(r["r"]) for r in got] == [g[6] for g in GOLDEN]
    assert [r["padded"] for r in got] == [any(g[6][4:]) for g in GOLDEN]


def test_wild_numbers_saturate(spark):
    got = regions(spark, [(10, 10, float("nan"), float("inf"), 5.0, 5.0, 10, 0, 70.0, "center", 0.0, 0.0), (10, 10, 1e30, -1e30, 1.0, 1e20, 1, 1, 1.0, "center", 0.0, 0.0)])
    assert got[0]["r"]["x"] == 0 and got[0]["r"]["y"] == f32.INT_MAX
    assert got[1]["r"]["height"] == f32.UINT_MAX and got[1]["r"]["y"] == f32.INT_MIN


case = st.tuples(st.integers(1, 4096), st.integers(1, 4096), st.floats(0, 1), st.floats(0, 1), st.floats(0.01, 1), st.floats(0.01, 1), st.integers(1, 2048), st.integers(1, 2048), st.floats(1, 100), st.sampled_from(["center", "rule_of_thirds", "custom"]), st.floats(-1.5, 1.5), st.floats(-1.5, 1.5))


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(case, min_size=20, max_size=60))
def test_region_properties(spark, cases):
    rows = [(w, h, x * w * (1 - bw), y * h * (1 - bh), bw * w, bh * h, *rest) for w, h, x, y, bw, bh, *rest in cases]
    for r in regions(spark, rows):
        g, i = r["r"], r["inside"]
        aspect = r["ow"] / r["oh"]
        if g["width"] > 1 and g["height"] > 1:
            assert abs(g["width"] / g["height"] - aspect) <= (1 + aspect) / g["height"] + 1e-3
        assert g["x"] + g["pad_left"] >= 0 and g["y"] + g["pad_top"] >= 0
        assert g["x"] + g["width"] - g["pad_right"] <= r["img_w"] and g["y"] + g["height"] - g["pad_bottom"] <= r["img_h"]
        if i is not None:
            assert 0 <= i["x"] and i["x"] + i["width"] <= r["img_w"] and i["height"] >= 1


def test_rounding_halves_go_away_from_zero(spark):
    got = spark.createDataFrame([(v,) for v in (-0.5, 0.5, 2.5, -2.5, 1.4)], "v float").select(f32.round_away(F.col("v"))).collect()
    assert [r[0] for r in got] == [-1, 1, 3, -3, 1]


def test_overlap_of_touching_and_empty_boxes(spark):
    rows = [(0, 0, 10, 10, 10, 0, 5, 5), (0, 0, 10, 10, 0, 0, 10, 10), (0, 0, 10, 10, 5, 5, 0, 0), (0, 0, 2, 2, 1, 0, 2, 2)]
    df = spark.createDataFrame([tuple(map(float, r)) for r in rows], "x float, y float, width float, height float, x2 float, y2 float, width2 float, height2 float")
    got = [r[0] for r in df.select(geometry.iou(Box.named(), Box.named(suffix="2"))).collect()]
    assert got == [0.0, 1.0, 0.0, pytest.approx(1 / 3)]


def test_rects_at_the_edge(spark):
    df = spark.createDataFrame([(-3.0, 2.0, 20.6, 5.2), (95.5, 95.5, 10.0, 10.0)], "x float, y float, width float, height float")
    b, n = Box.named(), F.lit(100)
    got = df.select(geometry.rounded_rect(b, n, n).alias("a"), geometry.truncated_rect(b, n, n).alias("b"), geometry.annotation_rect(b, n, n).alias("c")).collect()
    assert tuple(got[0]["a"]) == (0, 2, 18, 5) and tuple(got[0]["b"]) == (0, 2, 20, 5) and tuple(got[0]["c"]) == (0, 2, 17, 5)
    assert got[1]["a"] is None and tuple(got[1]["b"]) == (95, 95, 5, 5) and tuple(got[1]["c"]) == (95, 95, 3, 3)


def test_ellipse_outlines_of_every_part(spark, sf_dir):
    import math

    from framewright.plans.catalog import CATALOG

    keys = [r.p_partkey for r in spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey").collect()]
    got = {(r.p_partkey, r.idx): (r.x, r.y) for r in CATALOG["ellipse_outlines"].run(spark, sf_dir).collect()}
    assert max(keys) > 40 and set(got) == {(k, i) for k in keys for i in range(128)}
    for (k, i), (x, y) in got.items():
        turn = i * 2 * math.pi / 128
        assert abs(x - (40 + k % 60) / 2 * (1 + math.cos(turn))) < 1e-3 and abs(y - (30 + k % 50) / 2 * (1 + math.sin(turn))) < 1e-3
