"""Suppression and matching in images of any number of boxes: rounds of joins over the pairs that matter.

Pairs come from a grid over each image, dealt by cell, so no image is one task.  A greedy choice in order of
score, or of the expected faces, is then found in rounds in which all images, and all parts of an image that
do not touch, go on at once; the rounds end by themselves, and what little is left is finished in one task.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import f32 as q
from ..functions.geometry import Box, centers_close, iou
from . import detections as det
from .parity import MATCH_IOU
from .staging import scratch, stage_out

#: Most cells of a grid along a side.
CELLS = 64
#: A graph of at most so many edges, some megabytes, is finished by one task.
FEW_EDGES = 100_000


def pairs_on_grid(left: DataFrame, right: DataFrame, test: Callable[[Column, Column], Column]) -> DataFrame:
    """Pairs (image, a, b) of rows of an image that share a grid cell and pass ``test`` on a and b.

    Both sides have image, item (a struct) and the extent lo_x, hi_x, lo_y, hi_y within which others matter;
    rows whose extents touch share a cell.  An image has some four rows a cell, but cells no smaller than
    its rows are on the average.  A pair is taken in its first common cell, so no distinct is needed.
    """
    both = left.select("image", "lo_x", "hi_x", "lo_y", "hi_y").union(right.select("image", "lo_x", "hi_x", "lo_y", "hi_y"))
    known = both.groupBy("image").agg(F.count("*").alias("n"), *[e for s in "xy" for e in (F.min(f"lo_{s}").alias(f"min_{s}"), F.max(f"hi_{s}").alias(f"max_{s}"), F.avg(F.col(f"hi_{s}").cast("double") - F.col(f"lo_{s}")).alias(f"size_{s}"))])
    wanted = F.least(F.ceil(F.sqrt(F.col("n") / 4)), F.lit(CELLS))
    span = lambda s: F.col(f"max_{s}").cast("double") - F.col(f"min_{s}")
    cells = lambda s: F.greatest(F.least(wanted, F.coalesce(F.floor(F.try_divide(span(s), F.col(f"size_{s}"))), wanted)), F.lit(1)).cast("int")
    known = stage_out(known.select("image", *[c for s in "xy" for c in (F.col(f"min_{s}"), span(s).alias(f"span_{s}"), cells(s).alias(f"cells_{s}"))]), "grid-bounds")

    def cell(end: str, s: str) -> Column:
        share = F.try_divide(F.col(f"{end}_{s}").cast("double") - F.col(f"min_{s}"), F.col(f"span_{s}"))
        return F.least(F.coalesce(F.floor(share * F.col(f"cells_{s}")), F.lit(0)), F.col(f"cells_{s}") - 1).cast("int")

    def spread(side: DataFrame, name: str) -> DataFrame:
        placed = side.join(known, "image").select("image", F.col("item").alias(name), *[cell(e, s).alias(f"{e}{s}") for s in "xy" for e in ("lo", "hi")])
        each = placed.withColumn("cx", F.explode(F.sequence("lox", "hix"))).withColumn("cy", F.explode(F.sequence("loy", "hiy")))
        return each.select("image", "cx", "cy", name, F.col("lox").alias(f"x_{name}"), F.col("loy").alias(f"y_{name}"))

    first = (F.col("cx") == F.greatest("x_a", "x_b")) & (F.col("cy") == F.greatest("y_a", "y_b"))
    return spread(left, "a").join(spread(right, "b"), ["image", "cx", "cy"]).where(first & test(F.col("a"), F.col("b"))).select("image", "a", "b")


def _dropped_of_few(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """As :func:`dropped`, by one pass from the rows that nothing precedes."""
    after: dict[int, list[int]] = defaultdict(list)
    before: dict[int, int] = defaultdict(int)
    for batch in batches:
        for e, l in zip(*(c.to_pylist() for c in batch.columns)):
            after[e].append(l)
            before[l] += 1
    ready, gone = [e for e in after if not before[e]], set()
    while ready:
        for l in after[ready.pop()]:
            if l in gone:
                continue
            gone.add(l)
            for m in after.get(l, ()):
                before[m] -= 1
                if not before[m] and m not in gone:
                    ready.append(m)
    yield pa.RecordBatch.from_arrays([pa.array(gone, pa.int64())], names=["row"])


def dropped(edges: DataFrame, few_edges: int = FEW_EDGES) -> DataFrame:
    """(row) of each row that a greedy choice drops; edges lead from an earlier row (longs e) to a later one (l) that it would drop.

    A row stays once no undecided row precedes it, and then drops those that it precedes.  Each round decides
    at least the first row of every part of the graph, so the rounds are as many as the longest chain of
    decisions at most.
    """
    found = edges.sparkSession.createDataFrame([], "row long")
    while True:
        if edges.count() <= few_edges:
            return stage_out(found.union(edges.coalesce(1).mapInArrow(_dropped_of_few, "row long")), "crowd-dropped")
        staying = edges.select("e").distinct().join(edges.select(F.col("l").alias("e")), "e", "left_anti")
        gone = stage_out(edges.join(staying, "e").select(F.col("l").alias("row")).distinct(), "crowd-gone")
        found = found.union(gone)
        edges = edges.join(gone, edges["l"] == gone["row"], "left_anti").join(gone.withColumnRenamed("row", "e"), "e", "left_anti")
        edges = stage_out(edges.select("e", "l"), "crowd-edges")


def _choose(rows: DataFrame, alike: list[Column], extent: list[Column], test: Callable[[Box, Box], Column], image: str, index: str, few_edges: int) -> DataFrame:
    """Rows that no better row that stays drops, by score and then index.

    Rows that agree in ``alike`` drop each other and the same others, so only the first of them takes part.
    """
    with scratch(rows.sparkSession) as result:
        order = F.struct((-F.col("score")).alias("o"), F.col(f"`{index}`").alias("i"), F.monotonically_increasing_id().alias("row"))
        item = F.struct(order.alias("order"), *[q.f32(F.col(c)).alias(c) for c in ("x", "y", "width", "height")])
        known = result(rows.select("*", item.alias("__item")), "crowd-rows")
        named = known.select(F.col(f"`{image}`").alias("image"), F.col("__item").alias("item"), *[c.alias(f"k{n}") for n, c in enumerate(alike)], *[c.alias(n) for n, c in zip(("lo_x", "hi_x", "lo_y", "hi_y"), extent)])
        keys = ["image", *(f"k{n}" for n in range(len(alike)))]
        again = stage_out(named.groupBy(*keys).agg(F.min("item.order").alias("best"), F.count("*").alias("n")).where("n > 1"), "crowd-again")
        copies = stage_out(named.join(again, keys).where("item.order.row <> best.row").select(F.col("item.order.row").alias("row")), "crowd-copies")
        single = named.join(copies, F.col("item.order.row") == copies["row"], "left_anti").select("image", "item", "lo_x", "hi_x", "lo_y", "hi_y")
        single = stage_out(single.where("lo_x <= hi_x AND lo_y <= hi_y"), "crowd-single")
        pairs = pairs_on_grid(single, single, lambda a, b: (a["order"] < b["order"]) & test(Box.of(a), Box.of(b)))
        edges = stage_out(pairs.select(F.col("a.order.row").alias("e"), F.col("b.order.row").alias("l")), "crowd-edges")
        gone = result(dropped(edges, few_edges).union(copies), "crowd-gone")
        return known.join(gone, F.col("__item.order.row") == gone["row"], "left_anti").select(*[F.col(f"`{c}`") for c in rows.columns])


def suppress_crowded(rows: DataFrame, threshold: float = det.NMS_THRESHOLD, image: str = "image_id", index: str = "face_idx", few_edges: int = FEW_EDGES) -> DataFrame:
    """As :func:`detections.suppress`, for images of any number of boxes: no task holds an image.

    Boxes without area overlap nothing and stay.
    """
    if threshold <= 0:
        return rows
    box = Box.named()
    alike = [box.x, box.y, box.width, box.height]
    solid = box.area > 0
    extent = [F.when(solid, c) for c in (box.x, box.right, box.y, box.bottom)]
    # What has no area, or may not drop even its own copy, is its own kind.
    alone = F.when(solid & F.lit(threshold < 1), -1).otherwise(F.monotonically_increasing_id())
    return _choose(rows, [*alike, alone], extent, lambda a, b: iou(a, b) > q.f32(threshold), image, index, few_edges)


def dedup_centers_crowded(
    rows: DataFrame, relative: float = det.RELATIVE_DISTANCE, absolute: float = det.ABSOLUTE_DISTANCE, image: str = "image_id", index: str = "face_idx", few_edges: int = FEW_EDGES
) -> DataFrame:
    """As :func:`detections.dedup_centers`, for images of any number of boxes."""
    box = Box.named()
    reach = q.maximum(q.mul(q.maximum(box.longest_edge, 1.0), abs(relative)), abs(absolute)).cast("double") + 1
    extent = [c.cast("double") + s * reach for c in (box.center_x, box.center_y) for s in (-1, 1)]
    alone = F.when(F.lit(absolute != 0 or relative != 0), -1).otherwise(F.monotonically_increasing_id())
    return _choose(rows, [box.center_x, box.center_y, box.longest_edge, alone], extent, lambda a, b: centers_close(a, b, relative, absolute), image, index, few_edges)


_MATCH = "image_id long, e struct<i:long,row:long>, o struct<i:long,row:long>, iou float, delta float"


def _matched_few(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The greedy matches of candidates of few images: each expected face in order takes the best that is free."""
    held = list(batches)
    if not held:
        return
    table = pa.Table.from_batches(held)
    e, o = (table.column(c).combine_chunks().field("row").to_numpy(zero_copy_only=False) for c in ("e", "o"))
    ei, oi = (table.column(c).combine_chunks().field("i").to_numpy(zero_copy_only=False) for c in ("e", "o"))
    order = np.lexsort((o, oi, -table.column("iou").to_numpy(), e, ei))
    used, done, kept = set(), set(), []
    for k in order:
        if e[k] not in done and o[k] not in used:
            done.add(e[k])
            used.add(o[k])
            kept.append(k)
    yield from table.take(pa.array(kept, pa.int64())).to_batches()


def match_crowded(ours: DataFrame, expected: DataFrame, threshold: float = MATCH_IOU, image: str = "image_id", index: str = "face_idx", few_edges: int = FEW_EDGES) -> DataFrame:
    """As :func:`parity.match_greedy`, for images of any number of faces, by deferred acceptance.

    In a round each expected face asks the face of ours that overlaps it most among those that have not
    refused it; one that is asked holds the first in order and from then on refuses all later ones.  Faces of
    ours all prefer in the same order, so what is held when nobody is refused any more is the greedy choice.
    Images are done when that happens in them.
    """

    def side(df: DataFrame) -> DataFrame:
        face = F.struct(F.col(f"`{index}`").cast("long").alias("i"), F.monotonically_increasing_id().alias("row"), *[F.col(c).cast("float").alias(c) for c in ("x", "y", "width", "height", "score")])
        box = Box.of("item")
        known = stage_out(df.select(F.col(f"`{image}`").alias("image"), face.alias("item")), "match-side")
        return known.where(box.area > 0).select("*", box.x.alias("lo_x"), box.right.alias("hi_x"), box.y.alias("lo_y"), box.bottom.alias("hi_y"))

    key = lambda s: F.struct(F.col(f"{s}.i").alias("i"), F.col(f"{s}.row").alias("row"))
    with scratch(ours.sparkSession) as result:
        overlap = lambda a, b: iou(Box.of(a), Box.of(b))
        pairs = pairs_on_grid(side(expected), side(ours), lambda a, b: (overlap(a, b) >= q.f32(threshold)) & (overlap(a, b) > 0))
        pairs = pairs.select("image", key("a").alias("e"), key("b").alias("o"), overlap(F.col("a"), F.col("b")).alias("iou"), (F.col("b.score") - F.col("a.score")).cast("float").alias("delta"))
        left, done = stage_out(pairs, "match-pairs"), None
        while True:
            if left.count() <= few_edges:
                last = left.coalesce(1).mapInArrow(_matched_few, left.schema)
                done = last if done is None else done.union(last)
                break
            asked = left.groupBy("image", "e").agg(F.min_by(F.struct("o", "iou", "delta"), F.struct((-F.col("iou")).alias("v"), F.col("o"))).alias("best"))
            asked = stage_out(asked.select("image", "e", "best.*"), "match-asked")
            held = stage_out(asked.groupBy("image", "o").agg(F.min("e").alias("first"), F.count("*").alias("n")), "match-held")
            still = held.groupBy("image").agg(F.max("n").alias("n")).where("n > 1").select("image")
            settled = stage_out(asked.join(still, "image", "left_anti").select("image", "e", "o", "iou", "delta"), "match-settled")
            done = settled if done is None else done.union(settled)
            going = left.join(still, "image", "left_semi").join(held.select("image", "o", "first"), ["image", "o"], "left")
            left = stage_out(going.where("first IS NULL OR e <= first").select("image", "e", "o", "iou", "delta"), "match-pairs")
        return result(done.select(F.col("image").alias(image), F.col("e.i").alias("expected_idx"), F.col("o.i").alias("our_idx"), "iou", F.col("delta").alias("score_delta")), "matches")
