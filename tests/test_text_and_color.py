import colorsys

import pytest
from pyspark.sql import functions as F

from framewright.functions import color, naming


def column(spark, values, expr, kind="string"):
    return [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}").orderBy("i").select(expr(F.col("v"))).collect()]


def test_path_parts(spark):
    paths = ["a/b.tar.gz", ".bashrc", "x/..", "dir/", "plain", None]
    assert column(spark, paths, naming.file_stem) == ["b.tar", ".bashrc", None, "dir", "plain", None]
    assert column(spark, paths, naming.extension) == ["gz", None, None, None, None, None]
    assert column(spark, ["/etc/../x", "..", "a//b"], naming.safe_path) == ["etc/x", "", "a/b"]


def test_suffix_goes_before_the_last_dot(spark):
    assert column(spark, ["a.b.png", "none", ".x"], lambda v: naming.suffixed(v, F.lit("_hq"))) == ["a.b_hq.png", "none_hq", "_hq.x"]


def test_select_guard(spark):
    texts = ["SELECT 1", "  select a from last_update", "SELECT updates FROM t", "DROP TABLE t", "SELECT 1;", "SELECT 'x' -- drop"]
    want = [True, False, True, False, False, False]
    assert column(spark, texts, naming.is_safe_select) == want
    for t, ok in zip(texts, want):
        if ok:
            assert naming.check_select(t) == t
        else:
            with pytest.raises(ValueError):
                naming.check_select(t)


def test_tokens(spark):
    assert column(spark, ["JPG", "tiff", "gif", "Avif"], naming.image_format) == ["jpeg", "tiff", None, "avif"]
    assert column(spark, ["0", "3", "4", "9", "10", "best", "?"], naming.png_compression) == ["fast", "fast", "default", "best", "default", "best", "default"]
    assert column(spark, ["thirds", "Custom", "x"], naming.positioning_mode) == ["rule_of_thirds", "custom", "center"]
    assert column(spark, ["WARNING", "off", "loud"], naming.telemetry_level) == ["warn", "off", "debug"]


def test_hex_and_specs(spark):
    c = lambda v: F.concat_ws(",", *[v[k].cast("string") for k in ("red", "green", "blue", "alpha")])
    assert column(spark, ["#fff", "0x10203040", "#12_34_56", "12345", "#ggg"], lambda v: c(color.hex_color(v))) == ["255,255,255,255", "16,32,48,64", "18,52,86,255", "", ""]
    specs = ["rgb( 1 , 2.5 , 3 )", "rgb(1,2,3,0.5)", "hsv(0, 1, 1)", "hsv(240°,100%,100%)", "1, 2, 3", "1,2", "rgb(256,0,0)", "cmyk(1,2,3)"]
    assert column(spark, specs, lambda v: c(color.color_spec(v))) == ["1,3,3,255", "1,2,3,128", "255,0,0,255", "0,0,255,255", "1,2,3,255", "", "", ""]


def test_conversions_against_the_standard_library(spark):
    rgb = [(r, g, b) for r in (0, 17, 128, 255) for g in (0, 90, 255) for b in (0, 33, 200)]
    df = spark.createDataFrame(rgb, "r int, g int, b int")
    args = [F.col(c) for c in "rgb"]
    hsv, hsl, cmyk = color.rgb_to_hsv(*args), color.rgb_to_hsl(*args), color.rgb_to_cmyk(*args)
    got = df.select("r", "g", "b", hsv.alias("hsv"), hsl.alias("hsl"), color.hsv_to_rgb(*(hsv[c] for c in ("hue", "saturation", "value"))).alias("back"), color.hsl_to_rgb(*(hsl[c] for c in ("hue", "saturation", "lightness"))).alias("back2"), color.cmyk_to_rgb(*(cmyk[c] for c in ("cyan", "magenta", "yellow", "key"))).alias("back3")).collect()
    for x in got:
        h, s, v = colorsys.rgb_to_hsv(x.r / 255, x.g / 255, x.b / 255)
        assert (x.hsv.hue / 360 % 1, x.hsv.saturation, x.hsv.value) == pytest.approx((h, s, v), abs=1e-5)
        h, light, s = colorsys.rgb_to_hls(x.r / 255, x.g / 255, x.b / 255)
        assert (x.hsl.hue / 360 % 1, x.hsl.lightness, x.hsl.saturation) == pytest.approx((h, light, s), abs=1e-5)
        for back in (x.back, x.back2, x.back3):  # fractions are cut on the way back
            assert all(0 <= a - b <= 1 for a, b in zip((x.r, x.g, x.b), back[:3]))
