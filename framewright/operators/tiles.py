"""Images of any size as rows of tiles: neighbours exchange their edges, totals are sums over tiles.

A tile is a row (image, ty, tx, width, pixels): its pixels row by row, and how many make a row.  All tiles of an
image have the same size, but those at its right and lower edges may be smaller.  No task holds an image,
and a tile's edges are the only pixels that travel to its neighbours.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .imaging import equalization_luts

KEY = ["image", "ty", "tx"]


def _height() -> Column:
    return F.expr("size(pixels) div width").cast("int")


def _column(x: Column) -> Column:
    """The pixels of a tile's column ``x``."""
    return F.transform(F.sequence(F.lit(0), _height() - 1), lambda y: F.get("pixels", y * F.col("width") + x))


def with_edges(tiles: DataFrame) -> DataFrame:
    """Tiles with the pixels that touch them: above and below (rows), before and after (columns); null where no tile is.

    Each tile sends its four edges to its neighbours; what a tile receives meets in one row before it is joined to it.
    """
    ty, tx, width = F.col("ty"), F.col("tx"), F.col("width")
    last = F.slice("pixels", F.size("pixels") - width + 1, width)
    sent = [
        (ty + 1, tx, "above", last),
        (ty - 1, tx, "below", F.slice("pixels", F.lit(1), width)),
        (ty, tx + 1, "before", _column(width - 1)),
        (ty, tx - 1, "after", _column(F.lit(0))),
    ]
    each = F.explode(F.array(*[F.struct(y.alias("ty"), x.alias("tx"), F.lit(side).alias("side"), edge.alias("edge")) for y, x, side, edge in sent]))
    mail = tiles.where(F.size("pixels") > 0).select("image", each.alias("m")).select("image", "m.*")
    sides = [F.max(F.when(F.col("side") == side, F.col("edge"))).alias(side) for _, _, side, _ in sent]
    return tiles.join(mail.groupBy(*KEY).agg(*sides), KEY, "left")


def laplacian(tiles: DataFrame) -> DataFrame:
    """(image, n, total, squares) of each tile: the four-neighbour Laplacian at the pixels that have all four, in this tile or beside it."""
    w, h = F.col("width"), _height()
    at = lambda x, y: F.get("pixels", y * w + x)

    def value(k: Column) -> Column:
        x, y = (k % w).cast("int"), F.floor(k / w).cast("int")
        left = F.when(x > 0, at(x - 1, y)).otherwise(F.get("before", y))
        right = F.when(x < w - 1, at(x + 1, y)).otherwise(F.get("after", y))
        up = F.when(y > 0, at(x, y - 1)).otherwise(F.get("above", x))
        down = F.when(y < h - 1, at(x, y + 1)).otherwise(F.get("below", x))
        return (left + right + up + down - 4 * F.get("pixels", k)).cast("long")  # null without one of them

    edged = with_edges(tiles).where(F.size("pixels") > 0)
    found = edged.select("image", F.array_compact(F.transform(F.sequence(F.lit(0), F.size("pixels") - 1), value)).alias("ls"))
    add = lambda f: F.aggregate("ls", F.lit(0).cast("long"), lambda a, v: a + f(v))
    return found.select("image", F.size("ls").cast("long").alias("n"), add(lambda v: v).alias("total"), add(lambda v: v * v).alias("squares"))


def sharpness(tiles: DataFrame) -> DataFrame:
    """(image, sharpness): population variance of the Laplacian over the whole image; 0 where no pixel has four neighbours."""
    sums = laplacian(tiles).groupBy("image").agg(*[F.sum(c).alias(c) for c in ("n", "total", "squares")])
    mean = lambda c: F.col(c).cast("double") / F.col("n")
    return sums.select("image", F.when(F.col("n") > 0, mean("squares") - mean("total") * mean("total")).otherwise(F.lit(0.0)).alias("sharpness"))


def equalized(tiles: DataFrame) -> DataFrame:
    """Tiles whose pixels are spread by the histogram of their whole image, which is a table of 256 values at most."""
    luts = equalization_luts(tiles.select("image", "pixels"), "image")
    table = luts.groupBy("image").agg(F.map_from_entries(F.collect_list(F.struct("value", "mapped"))).alias("lut"))
    joined = tiles.join(table, "image", "left")
    full = F.transform(F.sequence(F.lit(0), F.lit(255)), lambda v: F.try_element_at("lut", v))
    spread = F.element_at(F.transform(F.array(full), lambda t: F.transform("pixels", lambda p: F.get(t, p))), 1)
    return joined.select(*KEY, "width", spread.alias("pixels"))
