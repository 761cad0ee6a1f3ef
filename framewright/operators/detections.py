"""Raw detector rows to detections: filter, scale, rank, and greedy suppression per image."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import f32 as q
from ..functions.geometry import Box, centers_close, iou
from .staging import scratch, stage_out

SCORE_THRESHOLD, NMS_THRESHOLD, TOP_K = 0.9, 0.3, 5000
RELATIVE_DISTANCE, ABSOLUTE_DISTANCE = 0.5, 8.0
GRID = 32
#: Below so many boxes in an image a grid does not pay.
GRID_FROM = 200
#: An image of so many boxes, some megabytes, or more is not held by one task.
SWEEP_TO = 100_000
LANDMARKS = ["right_eye", "left_eye", "nose", "right_mouth", "left_mouth"]


def valid_score(score: Column, threshold: float) -> Column:
    return q.is_finite(score) & (score >= q.f32(threshold))


def resize_scales(img_w: Column, img_h: Column, model_w: Column, model_h: Column) -> Column:
    """Source over model size both ways; null unless all four are positive."""
    fine = (img_w > 0) & (img_h > 0) & (model_w > 0) & (model_h > 0)
    return F.when(fine, F.struct(q.div(img_w, model_w).alias("x"), q.div(img_h, model_h).alias("y")))


def scaled(value: Column, scale: Column) -> Column:
    return q.mul(value, scale)


def filter_and_scale(rows: DataFrame, threshold: float = SCORE_THRESHOLD, scale_x: str = "scale_x", scale_y: str = "scale_y") -> DataFrame:
    """Rows with a finite score of at least ``threshold``, scaled to the source, without boxes of no extent.

    Columns that are scaled: x, y, width, height, and those that end in _x or _y.
    """
    cols = []
    for c in rows.columns:
        if c in (scale_x, scale_y):
            continue
        by = scale_x if c in ("x", "width") or c.endswith("_x") else scale_y if c in ("y", "height") or c.endswith("_y") else None
        cols.append(scaled(F.col(c), F.col(by)).alias(c) if by else F.col(c))
    return rows.where(valid_score(F.col("score"), threshold)).select(*cols).where((F.col("width") > 0) & (F.col("height") > 0))


def top_k(rows: DataFrame, k: int = TOP_K, image: str = "image_id", index: str = "face_idx") -> DataFrame:
    """The ``k`` best scores of each image (0: all), ranked from 1; equal scores by index."""
    best = Window.partitionBy(image).orderBy(F.desc("score"), F.asc(index))
    ranked = rows.withColumn("rank", F.row_number().over(best))
    return ranked.where(F.col("rank") <= k) if k else ranked


def _plain_pairs(rows: DataFrame, threshold: float, image: str, index: str) -> DataFrame:
    """Pairs of boxes of one image whose overlap exceeds ``threshold``, lower index first, by a plain self-join."""
    box = F.struct("x", "y", "width", "height")
    a = rows.select(image, F.col(index).alias("a"), box.alias("ba"))
    b = rows.select(image, F.col(index).alias("b"), box.alias("bb"))
    pairs = a.join(b, image).where("a < b").select(image, "a", "b", iou(Box.of("ba"), Box.of("bb")).alias("iou"))
    return pairs.where(F.col("iou") > q.f32(threshold))


def overlap_pairs(rows: DataFrame, threshold: float, image: str = "image_id", index: str = "face_idx") -> DataFrame:
    """Pairs of boxes of one image whose overlap exceeds ``threshold``, lower index first.

    A self-join where no image has many boxes; else pairs would grow with their square, and it is done as
    :func:`overlap_pairs_grid` does.
    """
    crowded = rows.groupBy(image).count().where(F.col("count") >= GRID_FROM)
    return _plain_pairs(rows, threshold, image, index) if crowded.isEmpty() else overlap_pairs_grid(rows, threshold, image=image, index=index)


def scene_bounds(rows: DataFrame, image: str = "image_id") -> DataFrame:
    """Extent of all boxes of each image; null bounds where it has none."""
    box = Box.named()
    found = rows.groupBy(image).agg(F.min("x").alias("min_x"), F.min("y").alias("min_y"), F.max(box.right).alias("max_x"), F.max(box.bottom).alias("max_y"))
    flat = (q.sub(F.col("max_x"), F.col("min_x")) <= 2.0**-23) | (q.sub(F.col("max_y"), F.col("min_y")) <= 2.0**-23)
    return found.select(image, *[F.when(~flat, F.col(c)).alias(c) for c in ("min_x", "min_y", "max_x", "max_y")])


def _spans(first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers from each ``first`` on, as many as ``counts`` says, one after another."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - counts), counts)


def _overlap(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Overlaps, row by row, of boxes (columns x, y, right, bottom, area) in single precision."""
    wide = np.minimum(a[2], b[2]) - np.maximum(a[0], b[0])
    tall = np.minimum(a[3], b[3]) - np.maximum(a[1], b[1])
    inter = np.where((wide > 0) & (tall > 0), wide * tall, np.float32(0))
    union = a[4] + b[4] - inter
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(union > 0, inter / union, np.float32(0))


def _measured(x: np.ndarray, y: np.ndarray, w: np.ndarray, h: np.ndarray) -> np.ndarray:
    """What :func:`_overlap` needs of boxes."""
    x, y, w, h = (v.astype(np.float32) for v in (x, y, w, h))
    return np.stack([x, y, x + w, y + h, np.maximum(w, 0) * np.maximum(h, 0)])


def _sweep(threshold: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For rows (image, index, x, y, width, height) in order of image: pairs (image, a, b, iou), an image at a time.

    In order of x, the boxes that may overlap one follow it up to its right edge.  All images of a batch are
    swept at once, and a million candidates at a time, so only an image's boxes are held, not its pairs.
    """

    def pairs(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        n = rows.num_rows
        if n < 2:
            return
        image = rows.column(0).combine_chunks().dictionary_encode().indices.to_numpy()
        boxes = _measured(*(rows.column(k).to_numpy() for k in range(2, 6)))
        order = np.lexsort((boxes[0], image))
        image, boxes = image[order], boxes[:, order]
        # How many boxes of the images so far begin before each right edge: edges go before beginnings as far right.
        both = np.lexsort((np.repeat([0, 1], n), np.concatenate([boxes[2], boxes[0]]), np.concatenate([image, image])))
        before = np.empty(2 * n, dtype=np.int64)
        before[both] = np.cumsum(both >= n)
        counts = np.maximum(before[:n] - np.arange(1, n + 1), 0)
        ends, lo = np.cumsum(counts), 0
        while lo < n:
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + 1_000_000, "right")))
            i = np.repeat(np.arange(lo, hi), counts[lo:hi])
            j = _spans(np.arange(lo + 1, hi + 1), counts[lo:hi])
            lo = hi
            near = (boxes[1, i] < boxes[3, j]) & (boxes[1, j] < boxes[3, i])
            i, j = i[near], j[near]
            over = _overlap(boxes[:, i], boxes[:, j])
            hit = over > np.float32(threshold)
            i, j, over = order[i[hit]], order[j[hit]], over[hit]
            a, b = (rows.column(1).take(pa.array(k)) for k in (i, j))
            lower = pc.less(a, b)
            made = pa.table([rows.column(0).take(pa.array(i)), pc.if_else(lower, a, b), pc.if_else(lower, b, a), pa.array(over)], names=["image", "a", "b", "iou"])
            yield from made.filter(pc.not_equal(a, b)).combine_chunks().to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            image = batch.column(0).dictionary_encode().indices.to_numpy()
            last = int(np.flatnonzero(image == image[-1])[0])
            if last or (held and held[-1].column(0)[0] != batch.column(0)[0]):
                yield from pairs(pa.Table.from_batches([*held, batch.slice(0, last)]))
                held = []
            held.append(batch.slice(last))
        if held:
            yield from pairs(pa.Table.from_batches(held))

    return run


def overlap_pairs_grid(rows: DataFrame, threshold: float, cells: int = GRID, image: str = "image_id", index: str = "face_idx", small: int = GRID_FROM, large: int = SWEEP_TO) -> DataFrame:
    """As :func:`overlap_pairs`, without comparing all boxes of an image.

    Images of less than ``large`` boxes are swept along x, one image in a task's memory at a time.  Larger ones
    are joined on grid cells: boxes that overlap at all share a cell, and a pair is taken in its first common
    cell only, which needs no distinct.  Images with values that are null or not finite go by self-join, or by
    cells from ``small`` boxes on.
    """
    box = Box.named()
    names = [image, index, "x", "y", "width", "height"]
    rows = rows.select(*names).where(F.col(image).isNotNull() & F.col(index).isNotNull())
    ends = [F.count("*").alias("__n"), F.min("x").alias("__min_x"), F.min("y").alias("__min_y"), F.max(box.right).alias("__max_x"), F.max(box.bottom).alias("__max_y")]
    odd = ~F.coalesce(q.is_finite(box.x) & q.is_finite(box.y) & q.is_finite(box.right) & q.is_finite(box.bottom) & q.is_finite(box.area), F.lit(False))
    with scratch(rows.sparkSession) as result:
        found = stage_out(rows.groupBy(image).agg(*ends, F.max(odd).alias("__odd")).where((F.col("__n") >= large) | F.col("__odd") | F.lit(threshold < 0)), "overlap-images")
        special = None if found.isEmpty() else result(found, "overlap-images")
    swept = rows if special is None else rows.join(special, image, "left_anti").select(*names)
    schema = T.StructType([swept.schema[image], *[T.StructField(c, swept.schema[index].dataType) for c in "ab"], T.StructField("iou", T.FloatType())])
    near = swept.select(image, index, *[q.f32(F.col(c)).alias(c) for c in names[2:]]).repartition(image).sortWithinPartitions(image).mapInArrow(_sweep(threshold), schema)
    if special is None:
        return near

    def cell(v: Column, lo: str, hi: str) -> Column:
        k = F.floor(F.try_divide((v - F.col(lo)).cast("double"), (F.col(hi) - F.col(lo)).cast("double")) * cells)
        return F.coalesce(F.greatest(F.lit(0), F.least(F.lit(cells - 1), k)).cast("int"), F.lit(0))

    known = rows.join(special, image)
    few = _plain_pairs(known.where(F.col("__n") < small).select(*names), threshold, image, index)
    placed = known.where(F.col("__n") >= small).select(
        image,
        F.col(index).alias("i"),
        F.struct("x", "y", "width", "height").alias("box"),
        cell(F.col("x"), "__min_x", "__max_x").alias("cx0"),
        cell(box.right, "__min_x", "__max_x").alias("cx1"),
        cell(F.col("y"), "__min_y", "__max_y").alias("cy0"),
        cell(box.bottom, "__min_y", "__max_y").alias("cy1"),
    )
    spread = placed.withColumn("cx", F.explode(F.sequence("cx0", F.greatest("cx0", "cx1")))).withColumn("cy", F.explode(F.sequence("cy0", F.greatest("cy0", "cy1"))))
    a = spread.select(image, "cx", "cy", F.col("i").alias("a"), F.col("box").alias("ba"), F.col("cx0").alias("ax"), F.col("cy0").alias("ay"))
    b = spread.select(image, "cx", "cy", F.col("i").alias("b"), F.col("box").alias("bb"), F.col("cx0").alias("bx"), F.col("cy0").alias("by"))
    first = (F.col("cx") == F.greatest("ax", "bx")) & (F.col("cy") == F.greatest("ay", "by"))
    pairs = a.join(b, [image, "cx", "cy"]).where((F.col("a") < F.col("b")) & first)
    many = pairs.select(image, "a", "b", iou(Box.of("ba"), Box.of("bb")).alias("iou")).where(F.col("iou") > q.f32(threshold))
    return near.union(few).union(many)


def _fold(sorted_rows: Column, drops: Callable[[Column, Column], Column]) -> Column:
    """Rows that no kept earlier row drops, in order."""
    empty = F.filter(sorted_rows, lambda _: F.lit(False))
    return F.aggregate(sorted_rows, empty, lambda kept, c: F.when(F.exists(kept, lambda o: drops(o, c)), kept).otherwise(F.concat(kept, F.array(c))))


def _ranked_rows(rows: DataFrame, image: str, index: str) -> DataFrame:
    """One row per image with its detections, best score first, index on ties."""
    rest = [c for c in rows.columns if c not in (image, index, "score")]
    packed = F.struct((-F.col("score")).alias("order"), F.col(index).alias("i"), F.struct(*rest).alias("r") if rest else F.lit(None).alias("r"))
    return rows.groupBy(image).agg(F.sort_array(F.collect_list(packed)).alias("ds"))


def _unpacked(kept: DataFrame, columns: list[str], image: str, index: str) -> DataFrame:
    rest = [c for c in columns if c not in (image, index, "score")]
    flat = kept.select(image, F.explode("ds").alias("d"))
    named = {image: F.col(image), index: F.col("d.i"), "score": -F.col("d.order")} | {c: F.col(f"d.r.{c}") for c in rest}
    return flat.select(*[named[c].alias(c) for c in columns])


def suppress(rows: DataFrame, threshold: float = NMS_THRESHOLD, image: str = "image_id", index: str = "face_idx") -> DataFrame:
    """Greedy suppression by overlap: in order of score, a row goes if a kept one overlaps it by more than ``threshold``.

    A fold over each image's sorted array, inside the JVM; no suppression at a threshold of 0 or less.
    """
    if threshold <= 0:
        return rows
    drop = lambda o, c: iou(Box.of(o["r"]), Box.of(c["r"])) > q.f32(threshold)
    ranked = _ranked_rows(rows, image, index)
    return _unpacked(ranked.withColumn("ds", _fold(F.col("ds"), drop)), rows.columns, image, index)


def dedup_centers(rows: DataFrame, relative: float = RELATIVE_DISTANCE, absolute: float = ABSOLUTE_DISTANCE, image: str = "image_id", index: str = "face_idx") -> DataFrame:
    """In order of score, a row goes if its centre lies too near a kept one's."""
    drop = lambda o, c: centers_close(Box.of(o["r"]), Box.of(c["r"]), relative, absolute)
    ranked = _ranked_rows(rows, image, index)
    return _unpacked(ranked.withColumn("ds", _fold(F.col("ds"), drop)), rows.columns, image, index)


def postprocess(rows: DataFrame, score: float = SCORE_THRESHOLD, nms: float = NMS_THRESHOLD, k: int = TOP_K, image: str = "image_id", index: str = "face_idx") -> DataFrame:
    """Filter, scale, top-k, overlap suppression and centre dedup, with one shuffle by image.

    After the window that ranks an image's rows they stay together: both folds run on one sorted array.
    """
    kept = top_k(filter_and_scale(rows, score), k, image, index).drop("rank")
    over = lambda o, c: iou(Box.of(o["r"]), Box.of(c["r"])) > q.f32(nms)
    near = lambda o, c: centers_close(Box.of(o["r"]), Box.of(c["r"]))
    ranked = _ranked_rows(kept, image, index)
    if nms > 0:
        ranked = ranked.withColumn("ds", _fold(F.col("ds"), over))
    return _unpacked(ranked.withColumn("ds", _fold(F.col("ds"), near)), kept.columns, image, index)


def suppress_boxes(boxes: np.ndarray, threshold: float) -> np.ndarray:
    """Numbers of the rows kept, for boxes (x, y, width, height as float32) already in order of score."""
    x, y, w, h = boxes.astype(np.float32).T
    right, bottom = x + w, y + h
    area = np.maximum(w, 0) * np.maximum(h, 0)
    alive, kept = np.ones(len(boxes), dtype=bool), []
    for i in range(len(boxes)):
        if not alive[i]:
            continue
        kept.append(i)
        j = np.flatnonzero(alive[i + 1 :]) + i + 1
        wide = np.minimum(right[i], right[j]) - np.maximum(x[i], x[j])
        tall = np.minimum(bottom[i], bottom[j]) - np.maximum(y[i], y[j])
        inter = np.where((wide > 0) & (tall > 0), wide * tall, np.float32(0))
        union = area[i] + area[j] - inter
        with np.errstate(divide="ignore", invalid="ignore"):
            over = np.where(union > 0, inter / union, np.float32(0)) > np.float32(threshold)
        alive[j[over]] = False
    return np.array(kept, dtype=np.int64)


def separate_centers(boxes: np.ndarray, relative: float = RELATIVE_DISTANCE, absolute: float = ABSOLUTE_DISTANCE) -> np.ndarray:
    """Numbers of the rows kept, for boxes in order of score: one goes if its centre lies too near a kept one's."""
    f = np.float32
    x, y, w, h = boxes.astype(f).T
    cx, cy = (w.astype(np.float64) * 0.5 + x).astype(f), (h.astype(np.float64) * 0.5 + y).astype(f)
    longest = np.maximum(w, h)
    alive, kept = np.ones(len(boxes), dtype=bool), []
    for i in range(len(boxes)):
        if not alive[i]:
            continue
        kept.append(i)
        j = np.flatnonzero(alive[i + 1 :]) + i + 1
        dx, dy = cx[j] - cx[i], cy[j] - cy[i]
        dist = (dx.astype(np.float64) ** 2 + (dy * dy)).astype(f)
        reach = np.maximum(np.maximum(longest[i], longest[j]), f(1)) * f(relative)
        alive[j[(dist < reach * reach) | (dist < f(absolute * absolute))]] = False
    return np.array(kept, dtype=np.int64)


def postprocess_rows(rows: np.ndarray, scale_x: float, scale_y: float, score: float = SCORE_THRESHOLD, nms: float = NMS_THRESHOLD, k: int = TOP_K) -> np.ndarray:
    """As :func:`postprocess` for the rows (n, 15) of one image, where the image lies anyway: best score first."""
    rows = rows.astype(np.float32)
    rows = rows[np.isfinite(rows[:, 14]) & (rows[:, 14] >= np.float32(score))]
    rows = rows * np.array([scale_x, scale_y] * 7 + [1], dtype=np.float32)
    rows = rows[(rows[:, 2] > 0) & (rows[:, 3] > 0)]
    rows = rows[np.argsort(-rows[:, 14], kind="stable")]
    rows = rows[:k] if k else rows
    if nms > 0:
        rows = rows[suppress_boxes(rows[:, :4], nms)]
    return rows[separate_centers(rows[:, :4])]


def _sizes(lists: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def _suppressed(boxes: np.ndarray, sizes: np.ndarray, threshold: float) -> np.ndarray:
    """Which boxes of many images stay; an image's boxes follow each other, best score first.

    As :func:`suppress_boxes`, but the first boxes of all images drop others at once, then the second ones, and so on.
    """
    ends = np.cumsum(sizes)
    starts, alive = ends - sizes, np.ones(boxes.shape[1], dtype=bool)
    going, k = np.flatnonzero(sizes > 1), 0
    while len(going):
        i = starts[going] + k
        stays = alive[i]
        i, counts = i[stays], (ends[going] - starts[going] - k - 1)[stays]
        j, i = _spans(i + 1, counts), np.repeat(i, counts)
        left = alive[j]
        i, j = i[left], j[left]
        alive[j[_overlap(boxes[:, i], boxes[:, j]) > np.float32(threshold)]] = False
        k += 1
        going = going[sizes[going] > k + 1]
    return alive


def _numbered(chosen: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """For each image the places, within it, of its chosen rows."""
    ends = np.cumsum(sizes)
    at = np.flatnonzero(chosen)
    image = np.repeat(np.arange(len(sizes)), sizes)[at]
    offsets = np.concatenate([[0], np.cumsum(np.bincount(image, minlength=len(sizes)))]).astype(np.int32)
    return pa.ListArray.from_arrays(offsets, (at - (ends - sizes)[image]).astype(np.int32))


def suppress_arrow(rows: DataFrame, threshold: float = NMS_THRESHOLD, image: str = "image_id", index: str = "face_idx") -> DataFrame:
    """As :func:`suppress`, vectorised over the images of an Arrow batch, in which they travel as arrays."""
    if threshold <= 0:
        return rows

    @F.arrow_udf("array<int>")
    def kept(x: pa.Array, y: pa.Array, w: pa.Array, h: pa.Array) -> pa.Array:
        sides = [v.flatten().to_numpy(zero_copy_only=False) for v in (x, y, w, h)]
        return _numbered(_suppressed(_measured(*sides), sizes := _sizes(x), threshold), sizes)

    ranked = _ranked_rows(rows, image, index)
    sides = [F.transform("ds", lambda d: d["r"]["x"]), F.transform("ds", lambda d: d["r"]["y"]), F.transform("ds", lambda d: d["r"]["width"]), F.transform("ds", lambda d: d["r"]["height"])]
    chosen = ranked.withColumn("keep", kept(*sides))
    return _unpacked(chosen.withColumn("ds", F.transform("keep", lambda i: F.get("ds", i))), rows.columns, image, index)


# Decoding of the detector's heads.


def stride_cells(model_w: int = 640, model_h: int = 640, strides: tuple[int, ...] = (8, 16, 32)) -> list[tuple[int, int, int]]:
    """(stride, rows, columns) of each head, sizes padded to the largest stride."""
    most = max(strides)
    w, h = (-(-v // most) * most for v in (model_w, model_h))
    return [(s, h // s, w // s) for s in strides]


def stride_heads(model_w: Column, model_h: Column, strides: tuple[int, ...] = (8, 16, 32)) -> Column:
    """As :func:`stride_cells`, for columns of sizes: an array of structs of stride, rows and cols (longs)."""
    most = max(strides)
    w, h = (F.ceil(v / most).cast("long") * most for v in (model_w, model_h))
    return F.array(*[F.struct(F.lit(s).alias("stride"), F.floor(h / s).alias("rows"), F.floor(w / s).alias("cols")) for s in strides])


def decode_cells(heads: DataFrame) -> DataFrame:
    """Boxes, landmarks and scores of head cells.

    ``heads`` has stride, row, col, cls, obj, bbox (4 floats) and kps (10 floats); other columns are kept.
    """
    s, row, col = (q.f32(F.col(c)) for c in ("stride", "row", "col"))
    b, k = F.col("bbox"), F.col("kps")
    raw = q.sqrt(q.mul(q.clamp(F.col("cls"), 0.0, 1.0), q.clamp(F.col("obj"), 0.0, 1.0)))
    w, h = q.mul(q.exp(b[2]), s), q.mul(q.exp(b[3]), s)
    x, y = q.fma(-0.5, w, q.mul(q.add(col, b[0]), s)), q.fma(-0.5, h, q.mul(q.add(row, b[1]), s))
    points = []
    for i, name in enumerate(LANDMARKS):
        points += [q.mul(q.add(k[2 * i], col), s).alias(f"{name}_x"), q.mul(q.add(k[2 * i + 1], row), s).alias(f"{name}_y")]
    rest = [c for c in heads.columns if c not in ("stride", "row", "col", "cls", "obj", "bbox", "kps")]
    return heads.select(*rest, "stride", "row", "col", x.alias("x"), y.alias("y"), w.alias("width"), h.alias("height"), *points, F.when(q.is_finite(raw), raw).otherwise(q.f32(0.0)).alias("score"))


def decode_tensors(cls: np.ndarray, obj: np.ndarray, bbox: np.ndarray, kps: np.ndarray, stride: int, columns: int) -> np.ndarray:
    """The rows of 15 floats of one head, vectorised."""
    f = np.float32
    n = len(cls)
    if len(obj) != n or bbox.size != 4 * n or kps.size != 10 * n:
        raise ValueError("head tensors do not fit together")
    cell = np.arange(n)
    row, col = (cell // columns).astype(f), (cell % columns).astype(f)
    b, k = bbox.reshape(n, 4).astype(f), kps.reshape(n, 5, 2).astype(f)
    out = np.empty((n, 15), dtype=f)
    out[:, 2:4] = np.exp(b[:, 2:4]) * f(stride)
    out[:, 0] = ((col + b[:, 0]) * f(stride)).astype(np.float64) - 0.5 * out[:, 2]
    out[:, 1] = ((row + b[:, 1]) * f(stride)).astype(np.float64) - 0.5 * out[:, 3]
    out[:, 4:14:2] = (k[:, :, 0] + col[:, None]) * f(stride)
    out[:, 5:14:2] = (k[:, :, 1] + row[:, None]) * f(stride)
    score = np.sqrt(np.clip(cls, 0, 1).astype(f) * np.clip(obj, 0, 1).astype(f))
    out[:, 14] = np.where(np.isfinite(score), score, f(0))
    return out
