"""Grey images as arrays of ints: histograms, lookup tables and sharpness as expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import f32 as q


def histogram(images: DataFrame, by: list[str] | None = None, pixels: str = "pixels") -> DataFrame:
    """How often each value occurs, over all images or per group; combined on the map side."""
    return images.select(*(by or []), F.explode(pixels).alias("value")).groupBy(*(by or []), "value").agg(F.count("*").alias("n"))


def equalization_luts(images: DataFrame, image: str, pixels: str = "pixels") -> DataFrame:
    """For each image the value that each of its values maps to when its histogram is equalised.

    The running count is taken within an image, whose values are few; a flat image maps to itself.
    """
    counts = histogram(images, [image], pixels)
    running = Window.partitionBy(image).orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy(image)
    c = counts.withColumns({"cum": F.sum("n").over(running), "total": F.sum("n").over(whole)})
    c = c.withColumn("lowest", F.min("cum").over(whole))
    share = q.mul(q.div(F.col("cum") - F.col("lowest"), F.col("total") - F.col("lowest")), 255.0)
    mapped = F.when(F.col("lowest") == F.col("total"), F.col("value")).otherwise(q.round_away(share).cast("int"))
    return c.select(image, "value", mapped.alias("mapped"))


def _lut(pixels: Column, value: Callable[[Column], Column]) -> Column:
    """Each pixel through a table of 256 values that is worked out once per row."""
    table = F.transform(F.sequence(F.lit(0), F.lit(255)), value)
    return F.element_at(F.transform(F.array(table), lambda t: F.transform(pixels, lambda p: F.get(t, p))), 1)


def brightness(pixels: Column, offset: int) -> Column:
    return F.transform(pixels, lambda p: F.greatest(F.lit(0), F.least(F.lit(255), p + offset)).cast("int"))


def exposure(pixels: Column, stops: float) -> Column:
    """Times two to the power of the stops, within two stops either way."""
    factor = q.f32(2.0 ** max(-2.0, min(2.0, stops)))
    return _lut(pixels, lambda v: F.least(F.lit(255), q.round_away(q.mul(v, factor)).cast("int")))


def contrast(pixels: Column, multiplier: float) -> Column:
    """Distance from middle grey times the multiplier, which is held between 0.5 and 2."""
    m = q.f32(max(0.5, min(2.0, multiplier)))
    spread = lambda v: q.clamp(q.fma(m, q.sub(q.div(v, 255.0), 0.5), 0.5), 0.0, 1.0)
    return _lut(pixels, lambda v: q.round_away(q.mul(spread(v), 255.0)).cast("int"))


def sharpness(pixels: Column, width: int, height: int) -> Column:
    """Population variance of the four-neighbour Laplacian over inner pixels; 0 below three pixels a side."""
    if width < 3 or height < 3:
        return F.lit(0.0)
    across, n = width - 2, float((width - 2) * (height - 2))
    at = lambda i: F.get(pixels, i)
    inner = F.transform(F.sequence(F.lit(0), F.lit(int(n) - 1)), lambda k: ((F.floor(k / across) + 1) * width + k % across + 1).cast("int"))
    laplace = F.transform(inner, lambda i: (at(i - 1) + at(i + 1) + at(i - width) + at(i + width) - 4 * at(i)).cast("long"))

    def variance(ls: Column) -> Column:
        total = F.aggregate(ls, F.lit(0).cast("long"), lambda a, v: a + v).cast("double") / n
        squares = F.aggregate(ls, F.lit(0).cast("long"), lambda a, v: a + v * v).cast("double") / n
        return squares - total * total

    return F.element_at(F.transform(F.array(laplace), variance), 1)


def to_bytes(values: Column) -> Column:
    """An array of ints from 0 to 255 as binary."""
    return F.unhex(F.array_join(F.transform(values, lambda v: F.lpad(F.hex(v.cast("long")), 2, "0")), ""))


def channel(data: Column, k: int, of: int = 4) -> Column:
    """Every ``of``-th byte of binary data from the ``k``-th on, as an array of ints."""
    starts = F.sequence(F.lit(k + 1), F.length(data), F.lit(of))
    return F.transform(starts, lambda i: F.conv(F.hex(F.substring(data, i, F.lit(1))), 16, 10).cast("int"))
