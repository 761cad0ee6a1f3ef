"""Queries over the driver's tables, one or more for each operator of the survey, with their oracle SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import color, f32, geometry, naming, points, shapes
from ..functions.geometry import Box
from ..operators import detections as det
from ..operators import crowds, imaging, parity, policy, tiles
from ..operators.staging import shared_dir
from ..sources import mapping
from .catalog import DETECTIONS, IMAGE_H, IMAGE_W, detections, query, table

# Building blocks of the oracle's SQL.  Quotients and roots of floats are cast back as they are in Spark.
RIGHT, BOTTOM = "CAST({p}x + {p}width AS FLOAT)", "CAST({p}y + {p}height AS FLOAT)"


def _d(a: str, b: str) -> str:
    return f"CAST(CAST({a} AS DOUBLE) / ({b}) AS FLOAT)"


def _iou(a: str, b: str) -> str:
    r, t = RIGHT, BOTTOM
    x1, y1 = f"greatest({a}x, {b}x)", f"greatest({a}y, {b}y)"
    x2, y2 = f"least({r.format(p=a)}, {r.format(p=b)})", f"least({t.format(p=a)}, {t.format(p=b)})"
    inter = f"CAST(CAST({x2} - {x1} AS FLOAT) * CAST({y2} - {y1} AS FLOAT) AS FLOAT)"
    area = lambda p: f"CAST({p}width * {p}height AS FLOAT)"
    union = f"CAST(CAST({area(a)} + {area(b)} AS FLOAT) - {inter} AS FLOAT)"
    return f"CASE WHEN {x2} <= {x1} OR {y2} <= {y1} THEN CAST(0 AS FLOAT) ELSE CAST(CAST({inter} AS DOUBLE) / {union} AS FLOAT) END"


def _center(side: str, at: str, p: str = "") -> str:
    return f"CAST(CAST({p}{side} AS DOUBLE) * 0.5 + CAST({p}{at} AS DOUBLE) AS FLOAT)"


def _close(a: str, b: str) -> str:
    dx = f"CAST({_center('width', 'x', b)} - {_center('width', 'x', a)} AS FLOAT)"
    dy = f"CAST({_center('height', 'y', b)} - {_center('height', 'y', a)} AS FLOAT)"
    dist = f"CAST(CAST({dx} AS DOUBLE) * CAST({dx} AS DOUBLE) + CAST(CAST({dy} * {dy} AS FLOAT) AS DOUBLE) AS FLOAT)"
    reach = f"CAST(greatest({a}width, {a}height, {b}width, {b}height, CAST(1 AS FLOAT)) * CAST(0.5 AS FLOAT) AS FLOAT)"
    return f"({dist} < CAST({reach} * {reach} AS FLOAT) OR {dist} < 64)"


def _round(e: str) -> str:
    return f"CAST(round(CAST({e} AS DOUBLE)) AS BIGINT)"


def _region(pct: str, ow: str, oh: str, mode: str, ox: str, oy: str, iw: str = IMAGE_W, ih: str = IMAGE_H) -> str:
    """SELECT list of a crop region's eight numbers; needs src_h and src_w to be worked out inline."""
    src_h = f"CAST(CAST(greatest(height, CAST(1 AS FLOAT)) AS DOUBLE) / CAST(CAST(greatest(1, least(100, {pct})) AS DOUBLE) / 100 AS FLOAT) AS FLOAT)"
    src_w = f"CAST({src_h} * CAST(CAST({ow} AS DOUBLE) / {oh} AS FLOAT) AS FLOAT)"
    half_w, half_h = f"CAST({src_w} * CAST(0.5 AS FLOAT) AS FLOAT)", f"CAST({src_h} * CAST(0.5 AS FLOAT) AS FLOAT)"
    bound = lambda o: f"greatest(CAST(-1 AS FLOAT), least(CAST(1 AS FLOAT), CAST({o} AS FLOAT)))"
    cx0, cy0 = _center("width", "x"), _center("height", "y")
    cx = f"CASE WHEN {mode} = 'custom' THEN CAST({cx0} + CAST({half_w} * {bound(ox)} AS FLOAT) AS FLOAT) ELSE {cx0} END"
    cy = f"CASE WHEN {mode} = 'rule_of_thirds' THEN CAST({cy0} - CAST(CAST({src_h} AS DOUBLE) / 6 AS FLOAT) AS FLOAT) WHEN {mode} = 'custom' THEN CAST({cy0} + CAST({half_h} * {bound(oy)} AS FLOAT) AS FLOAT) ELSE {cy0} END"
    x, y = _round(f"CAST({cx} - {half_w} AS FLOAT)"), _round(f"CAST({cy} - {half_h} AS FLOAT)")
    w, h = f"greatest(1, {_round(src_w)})", f"greatest(1, {_round(src_h)})"
    return f"{x} AS rx, {y} AS ry, {w} AS rw, {h} AS rh, greatest(-{x}, 0) AS pad_left, greatest(-{y}, 0) AS pad_top, greatest({x} + {w} - {iw}, 0) AS pad_right, greatest({y} + {h} - {ih}, 0) AS pad_bottom"


def _flat_region(r: str) -> list:
    names = {"x": "rx", "y": "ry", "width": "rw", "height": "rh"}
    return [F.col(f"{r}.{c}").alias(names.get(c, c)) for c in ("x", "y", "width", "height", "pad_left", "pad_top", "pad_right", "pad_bottom")]


QUALITY = "CASE WHEN quality_score > 1000 THEN 'High' WHEN quality_score > 300 THEN 'Medium' ELSE 'Low' END"
QRANK = "CASE WHEN quality_score > 1000 THEN 2 WHEN quality_score > 300 THEN 1 ELSE 0 END"


def _faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detections(spark, sf_dir).withColumn("quality", policy.quality_of(F.col("quality_score")))


FACES = f"(SELECT *, {QUALITY} AS quality, {QRANK} AS qrank FROM ({DETECTIONS}))"


# Detections: filter, scale, rank.

RAW = "(SELECT *, CAST(CAST(800 + image_id % 5 * 200 AS DOUBLE) / 640 AS FLOAT) AS sx, CAST(CAST(600 + image_id % 4 * 150 AS DOUBLE) / 640 AS FLOAT) AS sy FROM ({d}))".format(d=DETECTIONS)


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = detections(spark, sf_dir)
    scales = det.resize_scales(F.expr(IMAGE_W), F.expr(IMAGE_H), F.lit(640), F.lit(640))
    return d.withColumn("s", scales).withColumns({"scale_x": F.col("s.x"), "scale_y": F.col("s.y")}).drop("s")


SCALED = f"""SELECT image_id, face_idx, CAST(x * sx AS FLOAT) AS x, CAST(y * sy AS FLOAT) AS y, CAST(width * sx AS FLOAT) AS width, CAST(height * sy AS FLOAT) AS height, score, quality_score
FROM {RAW} WHERE score >= CAST(0.6 AS FLOAT)"""


@query(SCALED)
def filter_and_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return det.filter_and_scale(_raw(spark, sf_dir), 0.6)


@query(f"SELECT image_id, face_idx, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, face_idx) AS rank FROM ({DETECTIONS})) WHERE rank <= 3")
def top_k_per_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    return det.top_k(detections(spark, sf_dir), 3).select("image_id", "face_idx", "score", F.col("rank").cast("long").alias("rank"))


PAIRS = f"SELECT image_id, a, b, iou FROM (SELECT p.image_id, p.face_idx AS a, q.face_idx AS b, {_iou('p.', 'q.')} AS iou FROM ({DETECTIONS}) p JOIN ({DETECTIONS}) q ON p.image_id = q.image_id AND p.face_idx < q.face_idx) WHERE iou > CAST(0.05 AS FLOAT)"


@query(PAIRS)
def overlap_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return det.overlap_pairs(detections(spark, sf_dir), 0.05)


@query(PAIRS)
def overlap_pairs_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return det.overlap_pairs_grid(detections(spark, sf_dir), 0.05)


# Images of some hundred small boxes, so that the grid is used.
CROWD = {
    "image_id": "l_suppkey",
    "face_idx": "l_orderkey * 100 + l_linenumber",
    "x": "CAST(l_partkey * 37 % 900 AS FLOAT)",
    "y": "CAST(l_orderkey * 53 % 700 AS FLOAT)",
    "width": "CAST(10 + l_quantity AS FLOAT)",
    "height": "CAST(12 + l_quantity AS FLOAT)",
}
CROWDED = "SELECT " + ", ".join(f"{e} AS {n}" for n, e in CROWD.items()) + " FROM lineitem"


@query(
    f"SELECT image_id, a, b, iou, count(*) AS n FROM (SELECT p.image_id, p.face_idx AS a, q.face_idx AS b, {_iou('p.', 'q.')} AS iou FROM ({CROWDED}) p JOIN ({CROWDED}) q ON p.image_id = q.image_id AND p.face_idx < q.face_idx) WHERE iou > CAST(0.3 AS FLOAT) GROUP BY ALL"
)
def crowded_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = table(spark, sf_dir, "lineitem").selectExpr(*[f"{e} AS {n}" for n, e in CROWD.items()])
    return det.overlap_pairs_grid(boxes, 0.3).groupBy("image_id", "a", "b", "iou").agg(F.count("*").alias("n"))


# Images of 5,000 boxes, as many as the parts make.
DENSE = {
    "image_id": "CAST(floor(p_partkey / 5000) AS BIGINT)",
    "face_idx": "p_partkey",
    "x": "CAST(p_partkey * 7919 % 4000 AS FLOAT)",
    "y": "CAST(p_partkey * 104729 % 3000 AS FLOAT)",
    "width": "CAST(20 + p_size AS FLOAT)",
    "height": "CAST(24 + p_size AS FLOAT)",
}
DENSE_BOXES = "SELECT " + ", ".join(f"{e} AS {n}" for n, e in DENSE.items()) + " FROM part"
DENSE_PAIRS = f"SELECT image_id, a, b, iou FROM (SELECT p.image_id, p.face_idx AS a, q.face_idx AS b, {_iou('p.', 'q.')} AS iou FROM ({DENSE_BOXES}) p JOIN ({DENSE_BOXES}) q ON p.image_id = q.image_id AND p.face_idx < q.face_idx) WHERE iou > CAST(0.3 AS FLOAT)"


def _dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr(*[f"{e} AS {n}" for n, e in DENSE.items()])


@query(DENSE_PAIRS)
def dense_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return det.overlap_pairs(_dense(spark, sf_dir), 0.3)


@query(DENSE_PAIRS)
def dense_overlaps_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return det.overlap_pairs_grid(_dense(spark, sf_dir), 0.3)


@query(f"SELECT image_id, min(x) AS min_x, min(y) AS min_y, max({RIGHT.format(p='')}) AS max_x, max({BOTTOM.format(p='')}) AS max_y FROM ({DETECTIONS}) GROUP BY image_id")
def scene_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return det.scene_bounds(detections(spark, sf_dir))


def _greedy(source: str, test: str, tag: str) -> str:
    """CTEs that keep a row unless an earlier kept one meets ``test`` (on p. and q.); the result is ``kept_{tag}``."""
    return f"""r_{tag} AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, face_idx) AS r FROM ({source})),
o_{tag} AS MATERIALIZED (SELECT q.image_id, q.r, list(p.r) AS over FROM r_{tag} p JOIN r_{tag} q ON p.image_id = q.image_id AND p.r < q.r WHERE {test} GROUP BY ALL),
n_{tag} AS MATERIALIZED (SELECT image_id, max(r) AS n FROM r_{tag} GROUP BY image_id),
s_{tag} AS (SELECT image_id, CAST(1 AS BIGINT) AS r, [CAST(1 AS BIGINT)] AS kept FROM n_{tag}
  UNION ALL SELECT s.image_id, s.r + 1, CASE WHEN list_has_any(coalesce(o.over, []), s.kept) THEN s.kept ELSE list_append(s.kept, s.r + 1) END
  FROM s_{tag} s JOIN n_{tag} n ON n.image_id = s.image_id AND s.r < n.n LEFT JOIN o_{tag} o ON o.image_id = s.image_id AND o.r = s.r + 1),
kept_{tag} AS (SELECT d.* EXCLUDE (r) FROM s_{tag} s JOIN n_{tag} n ON s.image_id = n.image_id AND s.r = n.n JOIN r_{tag} d ON d.image_id = s.image_id AND list_contains(s.kept, d.r))"""


OVER = f"{_iou('p.', 'q.')} > CAST(0.3 AS FLOAT)"
NMS_SQL = f"WITH RECURSIVE {_greedy(DETECTIONS, OVER, 'a')} SELECT image_id, face_idx, score FROM kept_a"


@query(NMS_SQL)
def suppress_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return det.suppress(detections(spark, sf_dir)).select("image_id", "face_idx", "score")


@query(NMS_SQL)
def suppress_overlaps_arrow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return det.suppress_arrow(detections(spark, sf_dir)).select("image_id", "face_idx", "score")


@query(f"WITH RECURSIVE {_greedy(DETECTIONS, _close('p.', 'q.'), 'a')} SELECT image_id, face_idx, score FROM kept_a")
def dedup_centers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return det.dedup_centers(detections(spark, sf_dir)).select("image_id", "face_idx", "score")


# Suppression and matching in images of 5,000 boxes, by rounds of joins.

DENSE_SCORED = f"SELECT *, CAST(0.5 + face_idx * 37 % 400 / 1000.0 AS FLOAT) AS score FROM ({DENSE_BOXES})"


def _dense_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dense(spark, sf_dir).withColumn("score", F.expr("CAST(0.5 + face_idx * 37 % 400 / 1000.0D AS FLOAT)"))


DENSE_OVER = f"{_iou('p.', 'q.')} > CAST(0.05 AS FLOAT)"


@query(f"WITH RECURSIVE {_greedy(DENSE_SCORED, DENSE_OVER, 'a')} SELECT image_id, face_idx, score FROM kept_a")
def dense_suppression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crowds.suppress_crowded(_dense_scored(spark, sf_dir), 0.05).select("image_id", "face_idx", "score")


@query(f"WITH RECURSIVE {_greedy(DENSE_SCORED, _close('p.', 'q.'), 'a')} SELECT image_id, face_idx, score FROM kept_a")
def dense_center_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crowds.dedup_centers_crowded(_dense_scored(spark, sf_dir)).select("image_id", "face_idx", "score")


@query(
    f"WITH RECURSIVE t AS (SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, face_idx) AS k FROM ({SCALED})) WHERE k <= 5), "
    f"{_greedy('SELECT * FROM t', OVER, 'a')}, {_greedy('SELECT * FROM kept_a', _close('p.', 'q.'), 'b')} SELECT image_id, face_idx, x, y, width, height, score FROM kept_b"
)
def postprocess(spark: SparkSession, sf_dir: str) -> DataFrame:
    return det.postprocess(_raw(spark, sf_dir), 0.6, 0.3, 5).select("image_id", "face_idx", "x", "y", "width", "height", "score")


# Geometry.


@query(
    f"SELECT image_id, face_idx, {RIGHT.format(p='')} AS box_right, {BOTTOM.format(p='')} AS box_bottom, {_center('width', 'x')} AS cx, {_center('height', 'y')} AS cy, greatest(width, height) AS longest, CAST(width * height AS FLOAT) AS area FROM ({DETECTIONS})"
)
def box_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = Box.named()
    return detections(spark, sf_dir).select(
        "image_id", "face_idx", b.right.alias("box_right"), b.bottom.alias("box_bottom"), b.center_x.alias("cx"), b.center_y.alias("cy"), b.longest_edge.alias("longest"), b.area.alias("area")
    )


MODE = "CASE image_id % 3 WHEN 0 THEN 'center' WHEN 1 THEN 'rule_of_thirds' ELSE 'custom' END"
PCT, OFF_X, OFF_Y = "(10 + face_idx * 17 % 90)", "CAST((image_id % 31 - 15) AS DOUBLE) / 10", "CAST((image_id % 23 - 11) AS DOUBLE) / 10"
PRESET_ROWS = ", ".join(f"({k}, '{n}', {w}, {h})" for k, (n, w, h, _) in enumerate(geometry.PRESETS[:6]))
PRESETTED = f"(SELECT d.*, p.name AS preset, p.w AS ow, p.h AS oh FROM ({DETECTIONS}) d JOIN (VALUES {PRESET_ROWS}) p(k, name, w, h) ON d.image_id % 6 = p.k)"


def _presets(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, n, w, h) for k, (n, w, h, _) in enumerate(geometry.PRESETS)], "k long, preset string, ow int, oh int")


@query(f"SELECT image_id, face_idx, preset, {_region(PCT, 'ow', 'oh', MODE, OFF_X, OFF_Y)} FROM {PRESETTED}")
def crop_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = detections(spark, sf_dir).join(F.broadcast(_presets(spark)), F.expr("image_id % 6 = k"))
    region = geometry.crop_region(Box.named(), F.expr(IMAGE_W), F.expr(IMAGE_H), F.col("ow"), F.col("oh"), F.expr(PCT), F.expr(MODE), F.expr(OFF_X), F.expr(OFF_Y))
    return d.select("image_id", "face_idx", "preset", region.alias("r")).select("image_id", "face_idx", "preset", *_flat_region("r"))


@query(
    f"SELECT image_id, face_idx, pad_left + pad_top + pad_right + pad_bottom > 0 AS padded, CASE WHEN iw > 0 AND ih > 0 THEN rx + pad_left ELSE -1 END AS ix, CASE WHEN iw > 0 AND ih > 0 THEN ry + pad_top ELSE -1 END AS iy, CASE WHEN iw > 0 AND ih > 0 THEN iw ELSE -1 END AS iw, CASE WHEN iw > 0 AND ih > 0 THEN ih ELSE -1 END AS ih "
    f"FROM (SELECT *, greatest(rw - pad_left - pad_right, 0) AS iw, greatest(rh - pad_top - pad_bottom, 0) AS ih FROM (SELECT image_id, face_idx, {_region('70', '400', '400', MODE, OFF_X, OFF_Y)} FROM ({DETECTIONS})))"
)
def crop_in_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    region = geometry.crop_region(Box.named(), F.expr(IMAGE_W), F.expr(IMAGE_H), F.lit(400), F.lit(400), F.lit(70.0), F.expr(MODE), F.expr(OFF_X), F.expr(OFF_Y))
    d = detections(spark, sf_dir).select("image_id", "face_idx", region.alias("r"))
    d = d.select("image_id", "face_idx", geometry.requires_padding(F.col("r")).alias("padded"), geometry.in_bounds_rect(F.col("r")).alias("i"))
    whole = {"ix": "i.x", "iy": "i.y", "iw": "i.width", "ih": "i.height"}
    return d.select("image_id", "face_idx", "padded", *[F.coalesce(c, F.lit(-1)).cast("long").alias(n) for n, c in whole.items()])


def _clamped(e: str, most: str) -> str:
    return f"greatest(CAST(0 AS FLOAT), least(CAST({most} AS FLOAT), {e}))"


@query(
    f"""SELECT image_id, face_idx, CASE WHEN l + w <= iw AND t + h <= ih THEN l ELSE -1 END AS left_px, CASE WHEN l + w <= iw AND t + h <= ih THEN w ELSE -1 END AS width_px,
  CASE WHEN l + w <= iw AND t + h <= ih THEN t ELSE -1 END AS top_px, CASE WHEN l + w <= iw AND t + h <= ih THEN h ELSE -1 END AS height_px,
  least(CAST(trunc(y) AS BIGINT), ih - 1) AS cut_y, least(CAST(trunc(height) AS BIGINT), ih - least(CAST(trunc(y) AS BIGINT), ih - 1)) AS cut_h,
  CAST(trunc({_clamped('y', 'ih - 1')}) AS BIGINT) AS note_y, CAST(trunc(greatest(CAST({_clamped(BOTTOM.format(p=''), 'ih - 1')} - {_clamped('y', 'ih - 1')} AS FLOAT), 1)) AS BIGINT) AS note_h,
  CAST(trunc({_clamped('x', 'iw - 1')}) AS BIGINT) AS pixel_x, CAST(trunc({_clamped(RIGHT.format(p=''), 'iw - 1')}) AS BIGINT) AS pixel_right,
  least(CAST(trunc(x) AS BIGINT), iw - 1) AS cut_x, least(CAST(trunc(width) AS BIGINT), iw - least(CAST(trunc(x) AS BIGINT), iw - 1)) AS cut_w,
  CAST(trunc({_clamped('x', 'iw - 1')}) AS BIGINT) AS note_x, CAST(trunc(greatest(CAST({_clamped(RIGHT.format(p=''), 'iw - 1')} - {_clamped('x', 'iw - 1')} AS FLOAT), 1)) AS BIGINT) AS note_w
FROM (SELECT *, {_round(_clamped('x', 'iw'))} AS l, {_round(_clamped('y', 'ih'))} AS t,
  {_round(f"greatest(CAST({_clamped(RIGHT.format(p=''), 'iw')} - {_clamped('x', 'iw')} AS FLOAT), 1)")} AS w, {_round(f"greatest(CAST({_clamped(BOTTOM.format(p=''), 'ih')} - {_clamped('y', 'ih')} AS FLOAT), 1)")} AS h
  FROM (SELECT *, {IMAGE_W} AS iw, {IMAGE_H} AS ih FROM ({DETECTIONS})))"""
)
def pixel_rects(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, w, h = Box.named(), F.expr(IMAGE_W), F.expr(IMAGE_H)
    d = detections(spark, sf_dir).select(
        "image_id", "face_idx", geometry.rounded_rect(b, w, h).alias("a"), geometry.truncated_rect(b, w, h).alias("b"), geometry.annotation_rect(b, w, h).alias("c"),
        geometry.pixel_index(b.x, w).alias("pixel_x"), geometry.pixel_index(b.right, w).alias("pixel_right"),
    )
    return d.select(
        "image_id", "face_idx", "pixel_x", "pixel_right", F.coalesce("a.y", F.lit(-1)).cast("long").alias("top_px"), F.coalesce("a.height", F.lit(-1)).cast("long").alias("height_px"),
        F.col("b.y").alias("cut_y"), F.col("b.height").alias("cut_h"), F.col("c.y").alias("note_y"), F.col("c.height").alias("note_h"),
        F.coalesce("a.x", F.lit(-1)).cast("long").alias("left_px"), F.coalesce("a.width", F.lit(-1)).cast("long").alias("width_px"), F.col("b.x").alias("cut_x"), F.col("b.width").alias("cut_w"), F.col("c.x").alias("note_x"), F.col("c.width").alias("note_w")
    )


@query(
    f"""SELECT image_id, face_idx, CAST(CAST(rex - rx AS FLOAT) * CAST(CAST(400 AS DOUBLE) / rw AS FLOAT) AS FLOAT) AS eye_x,
  greatest(CAST(CAST(CAST(CAST(height AS DOUBLE) / rh AS FLOAT) * CAST(400 AS FLOAT) AS FLOAT) * CAST(0.12 AS FLOAT) AS FLOAT), CAST(4 AS FLOAT)) AS eye_radius,
  round(atan2(CAST(ley - rey AS FLOAT), CAST(lex - rex AS FLOAT)), 5) AS angle
FROM (SELECT *, CAST(x + width * CAST(0.25 AS FLOAT) AS FLOAT) AS rex, CAST(y + height * CAST(0.5 AS FLOAT) AS FLOAT) AS rey, CAST(x + width * CAST(0.75 AS FLOAT) AS FLOAT) AS lex, CAST(y + height * CAST(0.375 AS FLOAT) AS FLOAT) AS ley,
  {_region('70', '400', '400', "'center'", '0', '0')} FROM ({DETECTIONS}))"""
)
def eye_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = Box.named()
    eye = lambda dx, dy: F.struct(f32.add(b.x, f32.mul(b.width, dx)).alias("x"), f32.add(b.y, f32.mul(b.height, dy)).alias("y"))
    region = geometry.crop_region(b, F.expr(IMAGE_W), F.expr(IMAGE_H), F.lit(400), F.lit(400), F.lit(70.0), F.lit("center"), F.lit(0.0), F.lit(0.0))
    d = detections(spark, sf_dir).withColumns({"re": eye(0.25, 0.5), "le": eye(0.75, 0.375), "r": region})
    discs = geometry.eye_discs(b, F.col("re"), F.col("le"), F.col("r"), F.lit(400), F.lit(400))
    return d.select("image_id", "face_idx", F.get(discs, 0)["x"].alias("eye_x"), F.get(discs, 0)["radius"].alias("eye_radius"), F.round(geometry.eye_angle(F.col("re"), F.col("le")).cast("double"), 5).alias("angle"))


@query(
    f"""SELECT image_id, face_idx, CAST(x + width AS FLOAT) AS sum_x, CAST(y - height AS FLOAT) AS diff_y, {_d('y', '3')} AS third_y,
  CAST(CAST(x AS DOUBLE) * width + CAST(CAST(y * height AS FLOAT) AS DOUBLE) AS FLOAT) AS product, round(CAST(CAST(sqrt(CAST(x AS DOUBLE) * x + CAST(y AS DOUBLE) * y) AS FLOAT) AS DOUBLE), 3) AS size,
  CAST(CAST(x AS DOUBLE) * 0.5 + width AS FLOAT) AS moved_x FROM ({DETECTIONS})"""
)
def point_algebra(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = points.point(F.col("x"), F.col("y")), points.point(F.col("width"), F.col("height"))
    return detections(spark, sf_dir).select(
        "image_id", "face_idx", points.add(a, b)["x"].alias("sum_x"), points.sub(a, b)["y"].alias("diff_y"), points.shrink(a, 3.0)["y"].alias("third_y"),
        points.dot(a, b).alias("product"), F.round(points.length(a).cast("double"), 3).alias("size"), points.along(a, 0.5, b)["x"].alias("moved_x"),
    )


@query("SELECT o_orderkey, o_orderpriority, w AS width, h AS height FROM orders JOIN (VALUES ('idcard', 332, 498), ('avatar', 512, 512), ('linkedin', 400, 400)) p(k, w, h) ON k = ['idcard', 'avatar', 'linkedin', 'none'][o_orderkey % 4 + 1]")
def preset_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = F.element_at(F.array(*map(F.lit, ["id-CARD", "  Avatar", "Linked_In", "none"])), (F.col("o_orderkey") % 4 + 1).cast("int"))
    presets = _presets(spark).select(geometry.preset_key(F.col("preset")).alias("key"), F.col("ow").alias("width"), F.col("oh").alias("height"))
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", geometry.preset_key(asked).alias("key")).join(F.broadcast(presets), "key").drop("key")


# Policy and totals.

BEST = "row_number() OVER (PARTITION BY image_id ORDER BY {keys}, face_idx DESC) = 1"


@query(
    f"""SELECT image_id, face_idx, quality, {_region('70', '413', '531', MODE, OFF_X, OFF_Y)},
  'img' || image_id || '_face' || (face_idx + 1) || CASE quality WHEN 'High' THEN '_highq' WHEN 'Medium' THEN '_medq' ELSE '_lowq' END || '.jpg' AS file_name
FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, face_idx) AS k FROM {FACES} WHERE score >= CAST(0.6 AS FLOAT)) WHERE k <= 5 QUALIFY {BEST.format(keys='qrank DESC, quality_score DESC')})"""
)
def best_crop_per_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _faces(spark, sf_dir).where(det.valid_score(F.col("score"), 0.6))
    best = policy.best_face(det.top_k(d, 5), [policy.quality_rank(F.col("quality")), F.col("quality_score")])
    region = geometry.crop_region(Box.named(), F.expr(IMAGE_W), F.expr(IMAGE_H), F.lit(413), F.lit(531), F.lit(70.0), F.expr(MODE), F.expr(OFF_X), F.expr(OFF_Y))
    name = naming.crop_filename(
        F.concat(F.lit("img"), F.col("image_id").cast("string")), F.col("face_idx"), F.lit(413), F.lit(531), naming.normal_extension(F.lit("jpeg")), F.lit(0), F.lit(None).cast("string"), policy.quality_suffix(F.col("quality"))
    )
    return best.select("image_id", "face_idx", "quality", region.alias("r"), name.alias("file_name")).select("image_id", "face_idx", "quality", *_flat_region("r"), "file_name")


@query(f"SELECT image_id, ['Low', 'Medium', 'High'][max(qrank) + 1] AS best_quality FROM {FACES} GROUP BY image_id")
def best_quality_per_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy.best_quality(_faces(spark, sf_dir))


@query(f"SELECT image_id, face_idx, quality, quality_score, score FROM {FACES} QUALIFY {BEST.format(keys='qrank DESC, quality_score DESC, score DESC')}")
def best_face_three_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = [policy.quality_rank(F.col("quality")), F.col("quality_score"), F.col("score")]
    return policy.best_face(_faces(spark, sf_dir), keys).select("image_id", "face_idx", "quality", "quality_score", "score")


@query(f"SELECT image_id, CASE WHEN best = 2 THEN face_idx ELSE -1 END AS selected_idx FROM (SELECT *, max(qrank) OVER (PARTITION BY image_id) AS best FROM {FACES}) QUALIFY {BEST.format(keys='quality_score DESC')}")
def preview_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = policy.with_image_skip(_faces(spark, sf_dir))
    return policy.best_face(marked, [F.col("quality_score")]).select("image_id", F.when(~F.col("skip_image"), F.col("face_idx")).otherwise(-1).cast("long").alias("selected_idx"))


@query(
    f"SELECT image_id, face_idx, quality, n > 1 AS multi_face, qrank < 1 AS skipped FROM (SELECT *, count(*) OVER (PARTITION BY image_id) AS n, max(qrank) OVER (PARTITION BY image_id) AS best FROM {FACES}) WHERE best = 2"
)
def export_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy.plan_exports(_faces(spark, sf_dir), minimum="Medium", skip_without_high=True).select("image_id", "face_idx", "quality", "multi_face", "skipped")


@query(f"SELECT image_id, face_idx, quality, FALSE AS multi_face, qrank < 1 AS skipped FROM {FACES} QUALIFY {BEST.format(keys='qrank DESC, quality_score DESC')}")
def auto_selected_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One face an image, the best, unless it is below the least quality; what is left is no longer one of several."""
    return policy.plan_exports(_faces(spark, sf_dir), minimum="Medium", auto_select=True).select("image_id", "face_idx", "quality", "multi_face", "skipped")


@query(f"SELECT image_id, face_idx, quality FROM {FACES} WHERE face_idx = 1")
def face_by_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy.select_faces(_faces(spark, sf_dir), F.lit(2)).select("image_id", "face_idx", "quality")


OUTCOMES = f"(SELECT image_id, count(*) AS faces, count(*) FILTER (qrank > 0) AS saved, count(*) FILTER (qrank = 0) AS skipped FROM {FACES} GROUP BY image_id)"


def _outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    low = policy.should_skip(F.col("quality"), F.lit("Medium"))
    return _faces(spark, sf_dir).groupBy("image_id").agg(F.count("*").alias("faces"), F.count_if(~low).alias("saved"), F.count_if(low).alias("skipped"))


@query(f"SELECT count(*) AS images_processed, CAST(sum(faces) AS BIGINT) AS faces_detected, CAST(sum(saved) AS BIGINT) AS crops_saved, CAST(sum(skipped) AS BIGINT) AS crops_skipped_quality FROM {OUTCOMES}")
def run_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy.run_counters(_outcomes(spark, sf_dir))


@query(f"SELECT 'images_processed=' || count(*) || ' faces_detected=' || CAST(sum(faces) AS BIGINT) || ' crops_saved=' || CAST(sum(saved) AS BIGINT) || ' crops_skipped_quality=' || CAST(sum(skipped) AS BIGINT) AS summary FROM {OUTCOMES}")
def summary_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy.summary_line(policy.run_counters(_outcomes(spark, sf_dir)))


@query(
    f"SELECT image_id, face_idx, score, quality FROM {FACES} WHERE NOT (qrank = 0 AND face_idx > 0) UNION ALL SELECT o_orderkey, 100, CAST(1 AS FLOAT), 'High' FROM orders WHERE o_orderkey % 10 = 0"
)
def edited_faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    faces = _faces(spark, sf_dir)
    deleted = faces.where("quality = 'Low' AND face_idx > 0").select("image_id", "face_idx")
    drawn = table(spark, sf_dir, "orders").where("o_orderkey % 10 = 0").select(F.col("o_orderkey").alias("image_id"), F.lit(100).cast("long").alias("face_idx"))
    return policy.with_manual_box(policy.without_faces(faces, deleted), drawn).select("image_id", "face_idx", "score", "quality")


@query("SELECT event_type, count(*) AS samples, round(sum(value), 4) AS total_ms, round(avg(value), 6) AS avg_ms, min(value) AS min_ms, max(value) AS max_ms FROM events GROUP BY event_type")
def timing_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = policy.timing_stats(table(spark, sf_dir, "events"), ["event_type"], "value")
    return s.withColumns({"total_ms": F.round("total_ms", 4), "avg_ms": F.round("avg_ms", 6)})


STATUS = "CASE event_type WHEN 'error' THEN 'Failed' WHEN 'view' THEN 'Completed' WHEN 'click' THEN 'Skipped' WHEN 'signup' THEN 'Processing' ELSE 'Pending' END"


def _statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.selectExpr("event_id AS index", "concat('in/', user_id, '/', event_id, '.png') AS path", f"{STATUS} AS status", "user_id % 4 AS faces_detected", "user_id % 3 AS faces_exported", "CASE WHEN event_type = 'error' THEN props END AS error")


STATUSES = f"(SELECT event_id AS index, 'in/' || user_id || '/' || event_id || '.png' AS path, {STATUS} AS status, user_id % 4 AS faces_detected, user_id % 3 AS faces_exported, CASE WHEN event_type = 'error' THEN props END AS error FROM events)"


@query(f"SELECT count(*) FILTER (status <> 'Failed') AS completed, count(*) FILTER (status = 'Failed') AS failed FROM {STATUSES}")
def batch_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy.batch_totals(_statuses(spark, sf_dir))


@query(f"SELECT index, CASE WHEN status = 'Processing' THEN 'run' WHEN status = 'Failed' THEN 'err' WHEN status = 'Completed' AND faces_exported > 0 THEN 'ok' WHEN status = 'Pending' THEN '—' ELSE 'skip' END AS badge FROM {STATUSES}")
def status_badges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _statuses(spark, sf_dir).select("index", naming.status_badge(F.col("status"), F.col("faces_exported")).alias("badge"))


@query(f"SELECT index, path, error, faces_detected FROM {STATUSES} WHERE status = 'Failed' OR faces_exported = 0")
def failure_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy.failure_log(_statuses(spark, sf_dir))


# Names and tokens.

TEMPLATE = "CASE WHEN o_orderkey % 3 = 0 THEN '{original}-{index}-{width}x{height}' WHEN o_orderkey % 3 = 1 THEN '{original}.{ext}.{timestamp}' END"


@query(
    f"""SELECT o_orderkey, CASE WHEN t IS NULL THEN stem || '_face' || (n + 1) || suffix || '.png' ELSE left(name, length(name) - strpos(reverse(name), '.')) || suffix || right(name, strpos(reverse(name), '.')) END AS file_name, stem || '_face_' || printf('%02d', k) || '.png' AS padded
FROM (SELECT *, CASE WHEN t LIKE '%{{ext}}%' THEN filled ELSE filled || '.png' END AS name FROM (
  SELECT *, replace(replace(replace(replace(replace(replace(t, '{{original}}', stem), '{{index}}', CAST(n + 1 AS VARCHAR)), '{{width}}', '400'), '{{height}}', '500'), '{{ext}}', 'png'), '{{timestamp}}', '1700000000') AS filled
  FROM (SELECT o_orderkey, o_orderkey % 12 AS n, o_orderkey % 150 + 1 AS k, o_orderpriority || CASE WHEN o_orderkey % 5 = 0 THEN '{{index}}' ELSE '' END AS stem, {TEMPLATE} AS t, CASE WHEN o_orderstatus = 'F' THEN '_lowq' ELSE '' END AS suffix FROM orders)))"""
)
def crop_filenames(spark: SparkSession, sf_dir: str) -> DataFrame:
    stem = F.concat("o_orderpriority", F.when(F.expr("o_orderkey % 5 = 0"), "{index}").otherwise(""))
    suffix = F.when(F.col("o_orderstatus") == "F", policy.quality_suffix(F.lit("Low")))
    name = naming.crop_filename(stem, F.expr("o_orderkey % 12"), F.lit(400), F.lit(500), F.lit("png"), F.lit(1700000000), F.expr(TEMPLATE), suffix)
    return table(spark, sf_dir, "orders").select("o_orderkey", name.alias("file_name"), naming.padded_filename(stem, F.expr("o_orderkey % 150 + 1"), F.lit("png")).alias("padded"))


TARGET = "CASE o_orderkey % 5 WHEN 0 THEN '../a/b.' || o_orderkey || '.png' WHEN 1 THEN '/etc/x' WHEN 2 THEN 'dir/./sub/n' || o_orderkey WHEN 3 THEN '..' ELSE 'plain.jpeg' END"


@query(
    """SELECT o_orderkey, 'out' || CASE o_orderkey % 5 WHEN 0 THEN '/a/b.' || o_orderkey WHEN 1 THEN '/etc/x' WHEN 2 THEN '/dir/sub/n' || o_orderkey WHEN 3 THEN '/output' ELSE '/plain' END
  || CASE WHEN o_orderkey % 2 = 0 THEN '_face' || (o_orderkey % 3 + 1) ELSE '' END || '.webp' AS path, CASE o_orderkey % 5 WHEN 0 THEN 'png' WHEN 4 THEN 'jpeg' END AS ext, CASE o_orderkey % 5 WHEN 0 THEN 'png' WHEN 4 THEN 'jpeg' ELSE 'webp' END AS format FROM orders"""
)
def override_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.expr(TARGET)
    path = naming.override_path(F.lit("out"), t, F.lit(".webp"), F.expr("o_orderkey % 3"), F.expr("o_orderkey % 2 = 0"))
    return table(spark, sf_dir, "orders").select("o_orderkey", path.alias("path"), naming.extension(t).alias("ext"), naming.output_format(t, F.lit("webp"), F.lit(True)).alias("format"))


TOKENS = ["best", "2", "07", "8", "huge", "5", "FAST", "300"]
TOKEN = "[" + ", ".join(f"'{t}'" for t in TOKENS) + "][o_orderkey % 8 + 1]"


@query(
    f"""SELECT o_orderkey, CASE o_orderkey % 8 WHEN 0 THEN 'best' WHEN 1 THEN 'fast' WHEN 2 THEN 'best' WHEN 3 THEN 'best' WHEN 6 THEN 'fast' ELSE 'default' END AS compression,
  CASE WHEN o_orderkey % 3 = 0 THEN 'Medium' WHEN o_orderkey % 3 = 1 THEN 'High' END AS quality, CASE o_orderkey % 4 WHEN 0 THEN 'excel' WHEN 1 THEN 'csv' WHEN 2 THEN 'parquet' ELSE 'sqlite' END AS mapping_kind FROM orders WHERE {TOKEN} IS NOT NULL"""
)
def option_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda values, n: F.get(F.array(*map(F.lit, values)), (F.col("o_orderkey") % n).cast("int"))
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        naming.png_compression(pick(TOKENS, 8)).alias("compression"),
        policy.parse_quality(pick([" med ", "HIGH", "best"], 3)).alias("quality"),
        naming.mapping_format(pick(["a/b.XLSX", "t.tsv", "x.pq", "q.db"], 4)).alias("mapping_kind"),
    )


# Colours.

HEX = "'#' || lower(printf('%06x', l_partkey * 7919 % 16777216))"
CHANNELS = "l_partkey * 31 % 256 AS r, l_suppkey * 57 % 256 AS g, l_orderkey * 13 % 256 AS b"


@query("SELECT p_partkey, p_partkey * 7919 % 16777216 // 65536 AS red, p_partkey * 7919 % 65536 // 256 AS green, p_partkey * 7919 % 256 AS blue, CASE WHEN p_partkey % 2 = 0 THEN 255 ELSE 171 END AS alpha FROM part")
def hex_colors(spark: SparkSession, sf_dir: str) -> DataFrame:
    digits = F.lpad(F.hex(F.expr("p_partkey * 7919 % 16777216")), 6, "0")
    text = F.when(F.expr("p_partkey % 2 = 0"), F.concat(F.lit("#"), digits)).otherwise(F.concat(F.lit("0x"), digits, F.lit("_Ab")))
    return table(spark, sf_dir, "part").select("p_partkey", color.hex_color(text).alias("c")).select("p_partkey", *[F.col(f"c.{x}").cast("long").alias(x) for x in ("red", "green", "blue", "alpha")])


SPECS = ["#fA0", "rgb(12, 34.5,255)", "rgb(1,2,3,50%)", "hsv(120deg, 100%, 0.5)", "10,20,30", "rgba(1,2,3,4)", "rgb(1,2)", "300,0,0"]
SPEC_RGBA = ["255,170,0,255", "12,35,255,255", "1,2,3,128", "0,127,0,255", "10,20,30,255", None, None, None]


@query("SELECT p_partkey, CASE p_partkey % 8 " + " ".join(f"WHEN {k} THEN " + (f"'{v}'" if v else "NULL") for k, v in enumerate(SPEC_RGBA)) + " END AS rgba FROM part")
def color_specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = F.get(F.array(*map(F.lit, SPECS)), (F.col("p_partkey") % 8).cast("int"))
    c = color.color_spec(spec)
    text = F.when(c.isNotNull(), F.concat_ws(",", *[c[x].cast("string") for x in ("red", "green", "blue", "alpha")]))
    return table(spark, sf_dir, "part").select("p_partkey", text.alias("rgba"))


UNIT = f"SELECT *, {_d('r', '255')} AS rf, {_d('g', '255')} AS gf, {_d('b', '255')} AS bf FROM (SELECT DISTINCT {CHANNELS} FROM lineitem)"


@query(
    f"""SELECT r, g, b, CASE WHEN hue < 0 THEN CAST(hue + 360 AS FLOAT) ELSE hue END AS hue, CASE WHEN hi = 0 THEN CAST(0 AS FLOAT) ELSE {_d('d', 'hi')} END AS saturation, hi AS value,
  CASE WHEN hi = 0 THEN CAST(0 AS FLOAT) ELSE {_d('CAST(CAST(CAST(1 AS FLOAT) - rf AS FLOAT) - k AS FLOAT)', 'CAST(CAST(1 AS FLOAT) - k AS FLOAT)')} END AS cyan, k AS black
FROM (SELECT *, CAST(CAST(1 AS FLOAT) - hi AS FLOAT) AS k, CASE WHEN d = 0 THEN CAST(0 AS FLOAT)
  WHEN hi = rf THEN CAST(60 * {_d('CAST(gf - bf AS FLOAT)', 'd')} AS FLOAT) WHEN hi = gf THEN CAST(60 * CAST({_d('CAST(bf - rf AS FLOAT)', 'd')} + 2 AS FLOAT) AS FLOAT) ELSE CAST(60 * CAST({_d('CAST(rf - gf AS FLOAT)', 'd')} + 4 AS FLOAT) AS FLOAT) END AS hue
FROM (SELECT *, CAST(hi - lo AS FLOAT) AS d FROM (SELECT *, greatest(rf, gf, bf) AS hi, least(rf, gf, bf) AS lo FROM ({UNIT}))))"""
)
def color_conversions(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "lineitem").selectExpr("l_partkey * 31 % 256 AS r", "l_suppkey * 57 % 256 AS g", "l_orderkey * 13 % 256 AS b").distinct()
    rgb = (F.col("r"), F.col("g"), F.col("b"))
    c = c.select("r", "g", "b", color.rgb_to_hsv(*rgb).alias("hsv"), color.rgb_to_cmyk(*rgb).alias("cmyk"))
    return c.select("r", "g", "b", "hsv.hue", "hsv.saturation", "hsv.value", F.col("cmyk.cyan").alias("cyan"), F.col("cmyk.key").alias("black"))


def _f(e: str) -> str:
    return f"CAST({e} AS FLOAT)"


def _cut(e: str) -> str:
    """To a byte, fractions cut."""
    return f"CAST(trunc(greatest(0, least(255, {e}))) AS BIGINT)"


def _wheel_sql(chroma: str, lift: str) -> str:
    """Red, green and blue of a hue ``h`` of 0 to below 360 with a chroma, lifted."""
    turn = _f(f"fmod({_d('h', '60')}, 2)")
    side = _f(f"({chroma}) * " + _f(f"1 - abs({_f(f'{turn} - 1')})"))
    picks = (("c", "x", "0", "0", "x", "c"), ("x", "c", "c", "x", "0", "0"), ("0", "0", "x", "c", "c", "x"))
    value = {"c": f"({chroma})", "x": side, "0": _f("0")}
    byte = lambda k: _cut(_f(f"{_f(f'{value[k]} + ({lift})')} * 255"))
    return ", ".join("CASE " + " ".join(f"WHEN h < {60 * (n + 1)} THEN {byte(k)}" for n, k in enumerate(by[:5])) + f" ELSE {byte(by[5])} END AS {name}" for by, name in zip(picks, ("red", "green", "blue")))


HUES = "SELECT DISTINCT CAST(l_partkey % 720 AS FLOAT) / CAST(2 AS FLOAT) AS h, CAST(l_suppkey % 9 AS FLOAT) / CAST(8 AS FLOAT) AS s, CAST(l_orderkey % 17 AS FLOAT) / CAST(16 AS FLOAT) AS l FROM lineitem"


def _hues(spark: SparkSession, sf_dir: str) -> DataFrame:
    hue = ("CAST(CAST(l_partkey % 720 AS FLOAT) / 2 AS FLOAT) AS h", "CAST(CAST(l_suppkey % 9 AS FLOAT) / 8 AS FLOAT) AS s", "CAST(CAST(l_orderkey % 17 AS FLOAT) / 16 AS FLOAT) AS l")
    return table(spark, sf_dir, "lineitem").selectExpr(*hue).distinct()


def _rgb_of(c: str) -> list:
    return [F.col(f"{c}.{x}").cast("long").alias(x) for x in ("red", "green", "blue")]


@query(
    f"SELECT h, s, l, {', '.join(f'CASE WHEN s <= 0 THEN grey ELSE {x} END AS {x}' for x in ('red', 'green', 'blue'))} FROM (SELECT h, s, l, {_cut(_f('l * 255'))} AS grey, {_wheel_sql(_f('l * s'), _f('l - ' + _f('l * s')))} FROM ({HUES}))"
)
def hsv_colors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hues(spark, sf_dir).select("h", "s", "l", color.hsv_to_rgb(F.col("h"), F.col("s"), F.col("l")).alias("c")).select("h", "s", "l", *_rgb_of("c"))


HSL_CHROMA = _f(_f("1 - abs(" + _f("l * 2 - 1") + ")") + " * s")


@query(f"SELECT h, s, l, {_wheel_sql(HSL_CHROMA, _f('l - ' + _f(HSL_CHROMA + ' * CAST(0.5 AS FLOAT)')))} FROM ({HUES})")
def hsl_colors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hues(spark, sf_dir).select("h", "s", "l", color.hsl_to_rgb(F.col("h"), F.col("s"), F.col("l")).alias("c")).select("h", "s", "l", *_rgb_of("c"))


@query(f"SELECT h, s, l, {', '.join(_cut(_f(_f('255 * ' + _f(f'1 - {v}')) + ' * ' + _f('1 - l'))) + f' AS {n}' for v, n in (('s', 'red'), ('l', 'green'), (_d('h', '360'), 'blue')))} FROM ({HUES})")
def cmyk_colors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hues(spark, sf_dir).select("h", "s", "l", color.cmyk_to_rgb(F.col("s"), F.col("l"), f32.div(F.col("h"), 360.0), F.col("l")).alias("c")).select("h", "s", "l", *_rgb_of("c"))


@query(
    f"""SELECT r, g, b, CASE WHEN hue < 0 THEN CAST(hue + 360 AS FLOAT) ELSE hue END AS hue, light AS lightness,
  CASE WHEN d = 0 THEN CAST(0 AS FLOAT) ELSE {_d('d', _f('1 - abs(' + _f('CAST(light AS DOUBLE) * 2 - 1') + ')'))} END AS saturation
FROM (SELECT *, {_f(_f('hi + lo') + ' * CAST(0.5 AS FLOAT)')} AS light, CASE WHEN d = 0 THEN CAST(0 AS FLOAT)
  WHEN hi = rf THEN CAST(60 * {_d('CAST(gf - bf AS FLOAT)', 'd')} AS FLOAT) WHEN hi = gf THEN CAST(60 * CAST({_d('CAST(bf - rf AS FLOAT)', 'd')} + 2 AS FLOAT) AS FLOAT) ELSE CAST(60 * CAST({_d('CAST(rf - gf AS FLOAT)', 'd')} + 4 AS FLOAT) AS FLOAT) END AS hue
FROM (SELECT *, CAST(hi - lo AS FLOAT) AS d FROM (SELECT *, greatest(rf, gf, bf) AS hi, least(rf, gf, bf) AS lo FROM ({UNIT}))))"""
)
def hsl_conversions(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "lineitem").selectExpr("l_partkey * 31 % 256 AS r", "l_suppkey * 57 % 256 AS g", "l_orderkey * 13 % 256 AS b").distinct()
    return c.select("r", "g", "b", color.rgb_to_hsl(F.col("r"), F.col("g"), F.col("b")).alias("c")).select("r", "g", "b", "c.hue", "c.lightness", "c.saturation")


# Records.


@query(
    """SELECT image_id, '{"image_id":' || image_id || ',"detections":[' || string_agg('{"score":' || CAST(n AS VARCHAR) || ',"quality":"' || quality || '"}', ',' ORDER BY face_idx) || ']}' AS record
FROM (SELECT *, CAST(round(score * 1000) AS BIGINT) AS n FROM """ + FACES + ") GROUP BY image_id"
)
def detection_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.sinks import detection_json

    return detection_json(_faces(spark, sf_dir).select("image_id", "face_idx", F.round(F.col("score") * 1000).cast("long").alias("score"), "quality"), "image_id")


@query("SELECT c_custkey, base64(encode(c_name || c_mktsegment || c_name || c_mktsegment || c_name || c_mktsegment || c_name)) AS b64 FROM customer")
def base64_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = F.concat(*["c_name", "c_mktsegment"] * 3, "c_name")
    return table(spark, sf_dir, "customer").select("c_custkey", mapping.plain_base64(F.encode(joined, "UTF-8")).alias("b64"))


@query(
    """SELECT image_id, face_idx, CASE WHEN image_id % 4 = 0 THEN NULL ELSE '{' || '"album":"a' || image_id % 7 || '",' || '"generator":"framewright","generator_version":"0.1.0","quality":"' || lower(quality) || '","rank":' || qrank || '}' END AS payload FROM """ + FACES
)
def metadata_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.sinks import metadata_payload

    tags = F.create_map(F.lit("album"), F.concat(F.lit("a"), (F.col("image_id") % 7).cast("string")))
    mode = F.when(F.expr("image_id % 4 = 0"), "strip").otherwise("custom")
    return _faces(spark, sf_dir).select("image_id", "face_idx", metadata_payload(mode, tags, {"quality": F.lower("quality"), "rank": policy.quality_rank(F.col("quality"))}).alias("payload"))


# Mapping tables.

PARTS = "(SELECT p_partkey AS row_no, CASE WHEN p_partkey % 11 = 0 THEN '  ' ELSE '  ' || p_name || ' ' END AS source, CASE WHEN p_partkey % 13 = 0 THEN '' ELSE p_brand END AS output, CAST(p_retailprice AS VARCHAR) AS price FROM part)"


def _part_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr("p_partkey AS row_no", "CASE WHEN p_partkey % 11 = 0 THEN '  ' ELSE concat('  ', p_name, ' ') END AS source", "CASE WHEN p_partkey % 13 = 0 THEN '' ELSE p_brand END AS output")


@query(f"SELECT row_no, trim(source) AS source_path, trim(output) AS output_name FROM {PARTS} WHERE trim(source) <> '' AND trim(output) <> ''")
def mapping_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapping.entries(_part_table(spark, sf_dir), "SOURCE", "#2", keep=["row_no"])


@query("SELECT l_orderkey, mapping_row FROM (SELECT l_orderkey, row_number() OVER (ORDER BY l_orderkey) AS mapping_row FROM (SELECT DISTINCT l_orderkey FROM lineitem))")
def mapping_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapping.with_rank(table(spark, sf_dir, "lineitem").select("l_orderkey").distinct(), "l_orderkey")


@query("SELECT (SELECT count(*) FROM part) AS total_rows, (SELECT count(*) FROM part) > 5 AS truncated, least((SELECT count(*) FROM part), 5) AS shown")
def mapping_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapping.preview_summary(_part_table(spark, sf_dir).drop("row_no"), 5)


@query(
    """SELECT f.file, e.output FROM (SELECT 'd/' || p_name || CASE WHEN p_partkey % 2 = 0 THEN '.png' ELSE '' END AS file, p_name FROM part) f
JOIN (SELECT p_name, arg_min(p_brand, p_partkey) AS output FROM part GROUP BY p_name) e ON e.p_name = f.p_name"""
)
def mapping_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    queue = p.select(F.concat(F.lit("d/"), "p_name", F.when(F.expr("p_partkey % 2 = 0"), ".png").otherwise("")).alias("file"))
    entries = p.select(F.col("p_partkey").alias("entry_no"), F.col("p_name").alias("source_path"), F.col("p_brand").alias("output_name"))
    return mapping.lookup(queue, entries, "file").where("output_name is not null").select("file", F.col("output_name").alias("output"))


@query(
    "SELECT p_partkey, rel AS source_path FROM (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '/abs/' || p_brand WHEN 1 THEN '../' || p_brand WHEN 2 THEN 'x/../' || p_brand ELSE p_brand END AS source, CASE WHEN p_partkey % 4 > 1 THEN p_brand END AS rel FROM part) WHERE rel IN (SELECT p_brand FROM part WHERE p_size > 25)"
)
def mapping_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    entries = p.selectExpr("p_partkey", "CASE p_partkey % 4 WHEN 0 THEN concat('/abs/', p_brand) WHEN 1 THEN concat('../', p_brand) WHEN 2 THEN concat('x/../', p_brand) ELSE p_brand END AS source_path")
    files = p.where("p_size > 25").select(F.col("p_brand").alias("path")).distinct()
    return mapping.existing_targets(entries, files).select("p_partkey", "source_path")


@query("SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, trim(p_name) AS p_name, trim(p_brand) AS p_brand, trim(p_type) AS p_type, CAST(p_size AS VARCHAR) AS p_size FROM part")
def mapping_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapping.read_parquet(spark, f"{sf_dir}/part.parquet").select("p_partkey", "p_name", "p_brand", "p_type", "p_size")


@query("SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, trim(p_name) || ', \"' || trim(p_brand) || '\"' AS source_path, trim(p_type) AS output_name FROM part")
def mapping_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts written as CSV, values with commas and quotes among them, and read as a mapping table."""
    path = f"{shared_dir(spark).rstrip('/')}/mapping-{uuid.uuid4().hex}"
    parts = table(spark, sf_dir, "part").selectExpr("p_partkey", "trim(p_name) || ', \"' || trim(p_brand) || '\"' AS source_path", "' ' || p_type || '  ' AS output_name")
    parts.write.option("header", True).option("escape", '"').csv(path)
    return mapping.read_csv(spark, path)


SELECTED = "SELECT p_name AS source_path, 'drop; delete ' || p_brand || ' -- ' || CAST(max(ps) AS VARCHAR(20)) AS output_name FROM (SELECT p_name, p_brand, p_size AS ps FROM parts) GROUP BY p_name, p_brand"


@query(SELECTED.replace("FROM parts", "FROM part"))
def mapping_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapping.read_select(spark, f"{SELECTED} -- update", parts=table(spark, sf_dir, "part"))


GUARDED = ["SELECT a FROM t", "select last_update from t", "SELECT updated FROM t", "DELETE FROM t", "SELECT 1; SELECT 2", "WITH x AS (SELECT 1) SELECT * FROM x", " SELECT 'drop' ", "SELECT dropped_at FROM t"]


@query("SELECT n_nationkey, n_nationkey % 8 IN (0, 2, 7) AS safe FROM nation")
def select_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    sql = F.get(F.array(*map(F.lit, GUARDED)), F.col("n_nationkey") % 8)
    return table(spark, sf_dir, "nation").select("n_nationkey", naming.is_safe_select(sql).alias("safe"))


# Images from embeddings: 8 x 8 grey pixels.

PIXEL = "CAST(greatest(0, least(255, floor((v + 1) * 127.5))) AS INTEGER)"
PIXELS = f"(SELECT vec_id, i - 1 AS i, {PIXEL} AS p FROM (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings))"


def _images(spark: SparkSession, sf_dir: str) -> DataFrame:
    pixel = lambda v: F.floor(F.greatest(F.lit(0.0), F.least(F.lit(255.0), f32.mul(f32.add(v, 1.0), 127.5)))).cast("int")
    return table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", pixel).alias("pixels"))


@query(f"SELECT p AS value, count(*) AS n FROM {PIXELS} GROUP BY p")
def histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imaging.histogram(_images(spark, sf_dir).select("pixels")).select("value", "n")


EQUALIZED = f"""SELECT vec_id, p AS value, CASE WHEN lowest = 64 THEN p ELSE CAST(round(CAST(CAST(CAST(cum - lowest AS DOUBLE) / (64 - lowest) AS FLOAT) * CAST(255 AS FLOAT) AS DOUBLE)) AS INTEGER) END AS mapped
FROM (SELECT *, min(cum) OVER (PARTITION BY vec_id) AS lowest FROM (SELECT vec_id, p, sum(n) OVER (PARTITION BY vec_id ORDER BY p) AS cum FROM (SELECT vec_id, p, count(*) AS n FROM {PIXELS} GROUP BY vec_id, p)))"""


@query(EQUALIZED)
def equalization_lut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imaging.equalization_luts(_images(spark, sf_dir), "vec_id").select("vec_id", "value", F.col("mapped").cast("int").alias("mapped"))


@query(
    f"""SELECT vec_id, round(list_sum(list_transform(ls, lambda l: CAST(l * l AS DOUBLE))) / 36 - (list_sum(ls) / 36.0) * (list_sum(ls) / 36.0), 4) AS sharpness FROM (
SELECT vec_id, list_transform(list_filter(range(64), lambda i: i % 8 BETWEEN 1 AND 6 AND i // 8 BETWEEN 1 AND 6), lambda i: ps[i] + ps[i + 2] + ps[i - 7] + ps[i + 9] - 4 * ps[i + 1]) AS ls
FROM (SELECT vec_id, list(p ORDER BY i) AS ps FROM {PIXELS} GROUP BY vec_id))"""
)
def laplacian_sharpness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _images(spark, sf_dir).select("vec_id", F.round(imaging.sharpness(F.col("pixels"), 8, 8), 4).alias("sharpness"))


def _listed(expr: str) -> str:
    return f"SELECT vec_id, list({expr} ORDER BY i) AS pixels FROM {PIXELS} GROUP BY vec_id"


@query(_listed("CAST(greatest(0, least(255, p + 40)) AS INTEGER)"))
def brightness_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _images(spark, sf_dir).select("vec_id", imaging.brightness(F.col("pixels"), 40).alias("pixels"))


@query(_listed("CAST(least(255, round(CAST(CAST(p AS FLOAT) * CAST(1.4142135 AS FLOAT) AS DOUBLE))) AS INTEGER)"))
def exposure_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _images(spark, sf_dir).select("vec_id", imaging.exposure(F.col("pixels"), 0.5).alias("pixels"))


@query(
    _listed(
        "CAST(round(CAST(CAST(greatest(0, least(1, CAST(1.25 * (CAST(CAST(CAST(p AS DOUBLE) / 255 AS FLOAT) - CAST(0.5 AS FLOAT) AS FLOAT)) + 0.5 AS FLOAT))) * CAST(255 AS FLOAT) AS FLOAT) AS DOUBLE)) AS INTEGER)"
    )
)
def contrast_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _images(spark, sf_dir).select("vec_id", imaging.contrast(F.col("pixels"), 1.25).alias("pixels"))


@query()
def enhanced_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.pixels import enhance_images

    rgba = F.flatten(F.transform("pixels", lambda p: F.array(p, (p * 3) % 256, (p * 7) % 256, F.lit(255))))
    images = _images(spark, sf_dir).select("vec_id", F.lit(8).alias("width"), F.lit(8).alias("height"), imaging.to_bytes(rgba).alias("data"))
    return enhance_images(images, preset="vivid").select("vec_id", F.sha2("data", 256).alias("sha256"))


@query()
def png_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.sinks import encode_images

    rgba = F.flatten(F.transform("pixels", lambda p: F.array(p, p, p, F.lit(255))))
    images = _images(spark, sf_dir).select("vec_id", F.lit(8).alias("width"), F.lit(8).alias("height"), imaging.to_bytes(rgba).alias("data"))
    return encode_images(images, "png").select("vec_id", F.length("encoded").alias("n_bytes"))


# The same images in colour: kernels over bytes, compared channel by channel.


def _colored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, width, height, data: red is the grey image, green and blue follow from it, alpha too."""
    rgba = F.flatten(F.transform("pixels", lambda p: F.array(p, (p * 3) % 256, (p * 7) % 256, 255 - p % 64)))
    return _images(spark, sf_dir).select("vec_id", F.lit(8).alias("width"), F.lit(8).alias("height"), imaging.to_bytes(rgba).alias("data"))


COLORED = f"(SELECT vec_id, i, p AS r, p * 3 % 256 AS g, p * 7 % 256 AS b, 255 - p % 64 AS a FROM {PIXELS})"


def _kernel(spark: SparkSession, sf_dir: str, kernel) -> DataFrame:
    """Each channel of what a kernel makes of the coloured images, as a list."""
    from ..operators.pixels import map_images

    made = map_images(_colored(spark, sf_dir), kernel)
    return made.select("vec_id", *[imaging.channel(F.col("data"), k).alias(n) for k, n in enumerate(("red", "green", "blue", "alpha"))])


def _channels(source: str, red: str, green: str, blue: str, alpha: str) -> str:
    listed = ", ".join(f"list(CAST({e} AS INTEGER) ORDER BY i) AS {n}" for e, n in ((red, "red"), (green, "green"), (blue, "blue"), (alpha, "alpha")))
    return f"SELECT vec_id, {listed} FROM {source} GROUP BY vec_id"


def _nearest(e: str) -> str:
    """To a byte, halves away from zero."""
    return f"greatest(0, least(255, round(CAST({e} AS DOUBLE))))"


def _grey_mix(c: str) -> str:
    weighted = lambda v, k: _f(f"CAST({v} AS FLOAT) * CAST({k} AS FLOAT)")
    grey = _f(_f(weighted("r", 0.299) + " + " + weighted("g", 0.587)) + " + " + weighted("b", 0.114))
    return _nearest(_f(_f(f"{grey} * {_f('1 - CAST(1.6 AS FLOAT)')}") + " + " + weighted(c, 1.6)))


@query(_channels(COLORED, _grey_mix("r"), _grey_mix("g"), _grey_mix("b"), "a"))
def saturation_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import pixels

    return _kernel(spark, sf_dir, lambda img: pixels.saturation(img, 1.6))


EYE_MEAN = _f(_f(_f("CAST(g AS FLOAT) + CAST(b AS FLOAT)") + " * CAST(0.5 AS FLOAT)") + " + CAST(1e-6 AS FLOAT)")


def _red_eye(where: str) -> str:
    return f"CASE WHEN r > 80 AND r > {_f(EYE_MEAN + ' * CAST(1.5 AS FLOAT)')}{where} THEN {_nearest(EYE_MEAN)} ELSE r END"


@query(_channels(COLORED, _red_eye(""), "g", "b", "a"))
def red_eye_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import pixels

    return _kernel(spark, sf_dir, lambda img: pixels.remove_red_eye(img, 1.5))


@query(_channels(COLORED, _red_eye(" AND (pow(i % 8 - 2, 2) + pow(i // 8 - 2, 2) <= 6.25 OR pow(i % 8 - 5, 2) + pow(i // 8 - 4, 2) <= 1)"), "g", "b", "a"))
def red_eye_in_discs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import pixels

    return _kernel(spark, sf_dir, lambda img: pixels.remove_red_eye(img, 1.5, [(2.0, 2.0, 2.5), (5.0, 4.0, 1.0)]))


def _spread_channel(c: str) -> str:
    return f"""SELECT vec_id, v, CASE WHEN lowest = 64 THEN v ELSE {_nearest(_f(_d('cum - lowest', '64 - lowest') + ' * CAST(255 AS FLOAT)'))} END AS m
FROM (SELECT *, min(cum) OVER (PARTITION BY vec_id) AS lowest FROM (SELECT vec_id, v, sum(n) OVER (PARTITION BY vec_id ORDER BY v) AS cum FROM (SELECT vec_id, {c} AS v, count(*) AS n FROM {COLORED} GROUP BY ALL)))"""


@query(
    f"WITH er AS ({_spread_channel('r')}), eg AS ({_spread_channel('g')}), eb AS ({_spread_channel('b')}) "
    + _channels(f"(SELECT c.vec_id, i, er.m AS rm, eg.m AS gm, eb.m AS bm, a FROM {COLORED} c JOIN er ON er.vec_id = c.vec_id AND er.v = r JOIN eg ON eg.vec_id = c.vec_id AND eg.v = g JOIN eb ON eb.vec_id = c.vec_id AND eb.v = b)", "rm", "gm", "bm", "a")
)
def equalized_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import pixels

    return _kernel(spark, sf_dir, pixels.equalize)


def _over(c: str, fill: int) -> str:
    a = _d("a", "255")
    return f"floor({_f(_f(f'CAST({c} AS FLOAT) * {a}') + ' + ' + _f(f'CAST({fill} AS FLOAT) * ' + _f(f'1 - {a}')))})"


@query(_channels(COLORED, _over("r", 10), _over("g", 200), _over("b", 90), "255"))
def composited_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import pixels

    return _kernel(spark, sf_dir, lambda img: pixels.composite(img, (10, 200, 90)))


def _masked(distance: str, soft: float) -> str:
    """The image behind a mask: colours move towards black by half, alpha is multiplied."""
    alpha = _f(f"greatest(0, least(1, 0.5 - 0.5 * ({distance}) / {soft}))")
    mix = _f(f"{_f('1 - m')} * CAST(0.5 AS FLOAT)")
    toward = lambda c: f"trunc({_f(f'CAST({c} AS FLOAT) + ' + _f(f'{mix} * -CAST({c} AS FLOAT)'))})"
    source = f"(SELECT *, {alpha} AS m FROM (SELECT *, abs(i % 8 + 0.5 - 4)::DOUBLE AS ax, abs(i // 8 + 0.5 - 4)::DOUBLE AS ay FROM {COLORED}))"
    return _channels(source, toward("r"), toward("g"), toward("b"), f"floor({_f(_f('CAST(a AS FLOAT) * m') + ' + CAST(0.5 AS FLOAT)')})")


@query(_masked("(sqrt(pow(ax / 4, 2) + pow(ay / 4, 2)) - 1) * 4", 2.0))
def ellipse_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _kernel(spark, sf_dir, lambda img: shapes.apply_mask(img, shapes.Shape("ellipse"), 0.5, 0.5))


BOX_AT = "sqrt(pow(greatest(ax - {b}, 0), 2) + pow(greatest(ay - {b}, 0), 2)) + least(greatest(ax - {b}, ay - {b}), 0)"


@query(_masked(BOX_AT.format(b=2.0) + " - 2.0", 2.0))
def rounded_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _kernel(spark, sf_dir, lambda img: shapes.apply_mask(img, shapes.Shape("rounded_rectangle", size_pct=0.25), 0.5, 0.5))


@query(_masked(f"greatest({BOX_AT.format(b=4.0)}, (ax + ay - 6.0) * sqrt(0.5))", 2.0))
def chamfered_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _kernel(spark, sf_dir, lambda img: shapes.apply_mask(img, shapes.Shape("chamfered_rectangle", size_pct=0.25), 0.5, 0.5))


@query(f"SELECT channel, value, count(*) AS n FROM (SELECT unnest(['red', 'green', 'blue']) AS channel, unnest([r, g, b]) AS value FROM {COLORED}) GROUP BY ALL")
def channel_histograms(spark: SparkSession, sf_dir: str) -> DataFrame:
    planes = F.array(*[F.struct(F.lit(n).alias("channel"), imaging.channel(F.col("data"), k).alias("pixels")) for k, n in enumerate(("red", "green", "blue"))])
    each = _colored(spark, sf_dir).select(F.explode(planes).alias("p")).select("p.*")
    return imaging.histogram(each, ["channel"])


@query()
def crop_and_enhance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each embedding's image, its pixels drawn as squares of 16: a face cut out, levelled, enlarged and put through all nine filters."""
    import numpy as np

    from ..operators.pixels import Enhancement, map_images
    from ..sources.settings import Settings
    from . import batch

    settings = Settings()
    settings.crop.output_width, settings.crop.output_height, settings.crop.face_height_pct = 96, 120, 60.0
    settings.crop.eye_line_align = True
    tones = {"auto_color": True, "exposure_stops": -0.25, "brightness": -5, "contrast": 0.9, "saturation": 0.8}
    settings.enhance = Enhancement(**tones, unsharp_amount=0.4, unsharp_radius=0.9, sharpness=0.1, skin_smooth_amount=0.25, red_eye_removal=True, background_blur=True)
    at = "x', CAST({} + vec_id % 7 * 3 AS FLOAT), 'y', CAST({} + vec_id % 5 * 4 AS FLOAT)"
    eyes = f"array(named_struct('{at.format(34, 41)}), named_struct('{at.format(52, 44)}))"
    face = f"array(named_struct('face_idx', vec_id, '{at.format(22, 25)}, 'width', 48f, 'height', 56f, 'score', 0.9f, 'landmarks', {eyes}))"
    small = _colored(spark, sf_dir).selectExpr("CAST(vec_id AS STRING) AS path", "8 AS width", "8 AS height", "data", f"{face} AS faces")
    made = batch.crops(map_images(small, lambda img: np.kron(img, np.ones((16, 16, 1), dtype=np.uint8))), None, settings)
    return made.select("path", "width", "height", F.sha2("data", 256).alias("sha256"), F.round("quality_score", 3).alias("quality_score"))


# Images too large for a row: mosaics of 64 tiles, one tile an embedding.

MOSAIC = f"(SELECT vec_id // 64 AS image, vec_id % 8 * 8 + i % 8 AS x, vec_id // 8 % 8 * 8 + i // 8 AS y, p FROM {PIXELS})"


def _mosaics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _images(spark, sf_dir).selectExpr("vec_id div 64 AS image", "CAST(vec_id div 8 % 8 AS INT) AS ty", "CAST(vec_id % 8 AS INT) AS tx", "8 AS width", "pixels")


@query(
    f"""WITH n AS (SELECT *, lag(x) OVER a = x - 1 AND lead(x) OVER a = x + 1 AND lag(y) OVER b = y - 1 AND lead(y) OVER b = y + 1 AS inner_,
  lag(p) OVER a + lead(p) OVER a + lag(p) OVER b + lead(p) OVER b - 4 * p AS v
  FROM {MOSAIC} WINDOW a AS (PARTITION BY image, y ORDER BY x), b AS (PARTITION BY image, x ORDER BY y)),
l AS (SELECT image, v FROM n WHERE inner_)
SELECT image, round(avg(CAST(v * v AS DOUBLE)) - avg(CAST(v AS DOUBLE)) * avg(CAST(v AS DOUBLE)), 4) AS sharpness FROM l GROUP BY image"""
)
def mosaic_sharpness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiles.sharpness(_mosaics(spark, sf_dir)).select("image", F.round("sharpness", 4).alias("sharpness"))


@query(
    f"""WITH c AS (SELECT image, p, sum(n) OVER (PARTITION BY image ORDER BY p) AS cum, sum(n) OVER (PARTITION BY image) AS total FROM (SELECT image, p, count(*) AS n FROM {MOSAIC} GROUP BY image, p)),
m AS (SELECT image, p, CASE WHEN lowest = total THEN p ELSE CAST(round(CAST(CAST(CAST(cum - lowest AS DOUBLE) / (total - lowest) AS FLOAT) * CAST(255 AS FLOAT) AS DOUBLE)) AS INTEGER) END AS mapped FROM (SELECT *, min(cum) OVER (PARTITION BY image) AS lowest FROM c))
SELECT image, CAST(y // 8 AS INTEGER) AS ty, CAST(x // 8 AS INTEGER) AS tx, list(mapped ORDER BY y, x) AS pixels FROM {MOSAIC} JOIN m USING (image, p) GROUP BY image, y // 8, x // 8"""
)
def mosaic_equalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiles.equalized(_mosaics(spark, sf_dir)).drop("width")


# Head tensors.

HEADS = "SELECT l_orderkey AS image_id, CAST(8 * (1 + l_linenumber % 3) AS INTEGER) AS stride, CAST(l_partkey % 80 AS INTEGER) AS row, CAST(l_suppkey % 80 AS INTEGER) AS col, CAST(l_discount * 10 AS FLOAT) AS cls, CAST(l_tax * 12 AS FLOAT) AS obj, CAST(l_quantity / 50 AS FLOAT) AS dx, CAST(l_tax AS FLOAT) AS dy, CAST(l_discount AS FLOAT) AS k FROM lineitem"


@query(
    f"""SELECT image_id, stride, row, col, CAST(CAST(sqrt(CAST(CAST(least(cls, 1) * least(obj, 1) AS FLOAT) AS DOUBLE)) AS FLOAT) AS FLOAT) AS score,
  CAST(CAST(k + CAST(col AS FLOAT) AS FLOAT) * CAST(stride AS FLOAT) AS FLOAT) AS nose_x,
  CAST(-0.5 * CAST(CAST(stride AS FLOAT) AS DOUBLE) + CAST(CAST(CAST(CAST(col AS FLOAT) + dx AS FLOAT) * CAST(stride AS FLOAT) AS FLOAT) AS DOUBLE) AS FLOAT) AS x FROM ({HEADS})"""
)
def decoded_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey AS image_id", "CAST(8 * (1 + l_linenumber % 3) AS INT) AS stride", "CAST(l_partkey % 80 AS INT) AS row", "CAST(l_suppkey % 80 AS INT) AS col",
        "CAST(l_discount * 10 AS FLOAT) AS cls", "CAST(l_tax * 12 AS FLOAT) AS obj", "array(CAST(l_quantity / 50 AS FLOAT), CAST(l_tax AS FLOAT), CAST(0 AS FLOAT), CAST(0 AS FLOAT)) AS bbox",
        "array_repeat(CAST(l_discount AS FLOAT), 10) AS kps",
    )
    return det.decode_cells(t).select("image_id", "stride", "row", "col", "score", "nose_x", "x")


# Each supplier stands for a detector whose input has sides of its own.
MODEL_W, MODEL_H = "(160 + s_suppkey % 9 * 40)", "(128 + s_suppkey % 7 * 56)"
STRIDE = "SELECT s_suppkey, s, {w} // 32 * 32 // s AS cols, {h} // 32 * 32 // s AS rows FROM supplier, (VALUES (8), (16), (32)) t(s)".format(w=f"({MODEL_W} + 31)", h=f"({MODEL_H} + 31)")


@query(f"SELECT s_suppkey, s AS stride, CAST(p // cols AS BIGINT) AS row, CAST(p % cols AS BIGINT) AS col FROM (SELECT *, unnest(range(rows * cols)) AS p FROM ({STRIDE}))")
def stride_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    heads = table(spark, sf_dir, "supplier").select("s_suppkey", F.explode(det.stride_heads(F.expr(MODEL_W), F.expr(MODEL_H))).alias("h")).select("s_suppkey", "h.*")
    cells = heads.select("s_suppkey", "stride", "cols", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") * F.col("cols") - 1)).alias("p"))
    return cells.select("s_suppkey", "stride", F.expr("p div cols").alias("row"), F.expr("p % cols").alias("col"))


# Accuracy.

OURS = f"(SELECT image_id, face_idx, x, y, width, height, score FROM ({DETECTIONS}) WHERE face_idx % 5 < 4)"
SHIFTED = f"(SELECT image_id, face_idx, CAST(x + face_idx % 3 * 9 AS FLOAT) AS x, y, width, height, CAST(1 AS FLOAT) AS score FROM ({DETECTIONS}) WHERE face_idx % 4 < 3)"


def _two_sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    d = detections(spark, sf_dir).drop("quality_score")
    shifted = d.where("face_idx % 4 < 3").withColumns({"x": F.expr("CAST(x + face_idx % 3 * 9 AS FLOAT)"), "score": F.lit(1.0).cast("float")})
    return d.where("face_idx % 5 < 4"), shifted


def _matches(ours: str, expected: str) -> str:
    """CTEs of the greedy matches; the result is ``w``."""
    return f"""t AS MATERIALIZED (SELECT e.image_id, e.face_idx AS e, o.face_idx AS o, {_iou('o.', 'e.')} AS iou, CAST(o.score - e.score AS FLOAT) AS delta FROM {expected} e JOIN {ours} o ON e.image_id = o.image_id),
c AS MATERIALIZED (SELECT image_id, e, list({{'o': o, 'iou': iou, 'delta': delta}} ORDER BY iou DESC, o) AS cs FROM t WHERE iou >= CAST(0.5 AS FLOAT) GROUP BY image_id, e),
g AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY e) AS k, count(*) OVER (PARTITION BY image_id) AS n FROM c),
m AS (SELECT image_id, k, n, cs[1:1] AS hit, e, [cs[1].o] AS used FROM g WHERE k = 1
  UNION ALL SELECT g.image_id, g.k, g.n, list_filter(g.cs, lambda x: NOT list_contains(m.used, x.o))[1:1], g.e, list_concat(m.used, list_transform(list_filter(g.cs, lambda x: NOT list_contains(m.used, x.o))[1:1], lambda x: x.o)) FROM m JOIN g ON g.image_id = m.image_id AND g.k = m.k + 1),
w AS (SELECT image_id, e AS expected_idx, hit[1].o AS our_idx, hit[1].iou AS iou, hit[1].delta AS score_delta FROM m WHERE len(hit) > 0)"""


MATCHES = _matches(OURS, SHIFTED)


@query(f"WITH RECURSIVE {MATCHES} SELECT * FROM w")
def greedy_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parity.match_greedy(*_two_sides(spark, sf_dir))


# Images of 5,000 faces in heaps, where many expected ones want the same of ours.
HEAP = {
    "image_id": "CAST(floor(p_partkey / 5000) AS BIGINT)",
    "face_idx": "p_partkey",
    "x": "CAST(p_partkey % 31 * 90 + p_partkey * 7 % 11 AS FLOAT)",
    "y": "CAST(p_partkey % 29 * 90 + p_partkey * 5 % 13 AS FLOAT)",
    "width": "CAST(60 + p_size % 10 AS FLOAT)",
    "height": "CAST(60 + p_size % 7 AS FLOAT)",
    "score": "CAST(0.5 + p_size / 200.0 AS FLOAT)",
}
HEAPS = "(SELECT " + ", ".join(f"{e} AS {n}" for n, e in HEAP.items()) + " FROM part)"
HEAP_EXPECTED = f"(SELECT image_id, face_idx, CAST(x + face_idx % 3 * 4 AS FLOAT) AS x, y, width, height, CAST(1 AS FLOAT) AS score FROM {HEAPS} WHERE face_idx % 4 < 3)"


@query(f"WITH RECURSIVE {_matches(f'(SELECT * FROM {HEAPS} WHERE face_idx % 5 < 4)', HEAP_EXPECTED)} SELECT * FROM w")
def crowded_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    heaps = table(spark, sf_dir, "part").selectExpr(*[f"{e} AS {n}" for n, e in HEAP.items()])
    expected = heaps.where("face_idx % 4 < 3").withColumns({"x": F.expr("CAST(x + face_idx % 3 * 4 AS FLOAT)"), "score": F.lit(1.0).cast("float")})
    return crowds.match_crowded(heaps.where("face_idx % 5 < 4"), expected)


REGION_TEXT = "concat_ws(':', rx, ry, rw, rh, pad_left, pad_top, pad_right, pad_bottom)"
NAMED_REGION = "SELECT CAST(image_id AS VARCHAR) || '-' || CAST(face_idx AS VARCHAR) AS name, {t} AS region FROM (SELECT image_id, face_idx, {r} FROM {d})"
SIDES = [NAMED_REGION.format(t=REGION_TEXT, r=_region("70", "413", "531", "'center'", "0", "0"), d=d) for d in (OURS, SHIFTED)]


@query(f"SELECT name, a.region AS ours, b.region AS golden, a.region IS NOT DISTINCT FROM b.region AS equal FROM ({SIDES[0]}) a FULL JOIN ({SIDES[1]}) b USING (name)")
def golden_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crop regions of detections beside those of expected faces, by name; missing ones differ."""

    def named(faces: DataFrame) -> DataFrame:
        fixed = [F.lit(413), F.lit(531), F.lit(70.0), F.lit("center"), F.lit(0.0), F.lit(0.0)]
        region = geometry.crop_region(Box.named(), F.expr(IMAGE_W), F.expr(IMAGE_H), *fixed)
        flat = faces.select("image_id", "face_idx", region.alias("r")).select(F.concat_ws("-", "image_id", "face_idx").alias("name"), *_flat_region("r"))
        return flat.select("name", F.expr(REGION_TEXT).alias("region"))

    return parity.compare_named(*map(named, _two_sides(spark, sf_dir)))


CASES = f"""cases AS (SELECT image_id, coalesce(ex, 0) AS expected, coalesce(ou, 0) AS ours, coalesce(ma, 0) AS matched,
  CASE WHEN coalesce(ex, 0) = 0 THEN CASE WHEN coalesce(ou, 0) = 0 THEN 1.0 ELSE 0.0 END ELSE CAST(coalesce(ma, 0) AS DOUBLE) / ex END AS recall,
  CASE WHEN coalesce(ou, 0) = 0 THEN CASE WHEN coalesce(ex, 0) = 0 THEN 1.0 ELSE 0.0 END ELSE CAST(coalesce(ma, 0) AS DOUBLE) / ou END AS precision,
  coalesce(mi, 0) AS mean_iou, coalesce(worst, 1) AS worst_iou
FROM (SELECT image_id, count(*) AS ou FROM {OURS} GROUP BY ALL) FULL JOIN (SELECT image_id, count(*) AS ex FROM {SHIFTED} GROUP BY ALL) USING (image_id)
LEFT JOIN (SELECT image_id, count(*) AS ma, avg(CAST(iou AS DOUBLE)) AS mi, CAST(min(iou) AS DOUBLE) AS worst FROM w GROUP BY ALL) USING (image_id))"""


@query(f"WITH RECURSIVE {MATCHES}, {CASES} SELECT image_id, expected, ours, matched, CAST(recall AS DOUBLE) AS recall, CAST(precision AS DOUBLE) AS precision, round(CAST(mean_iou AS DOUBLE), 6) AS mean_iou, CAST(worst_iou AS DOUBLE) AS worst_iou FROM cases")
def case_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    ours, expected = _two_sides(spark, sf_dir)
    cases = parity.case_accuracy(ours, expected, parity.match_greedy(ours, expected))
    return cases.select("image_id", "expected", "ours", "matched", "recall", "precision", F.round("mean_iou", 6).alias("mean_iou"), "worst_iou")


@query(
    f"WITH RECURSIVE {MATCHES}, {CASES} SELECT count(*) AS images, CAST(sum(expected) AS BIGINT) AS expected, CAST(sum(ours) AS BIGINT) AS ours, CAST(sum(matched) AS BIGINT) AS matched, round(CAST(avg(recall) AS DOUBLE), 6) AS recall, round(CAST(avg(precision) AS DOUBLE), 6) AS precision, round(CAST(sum(mean_iou * matched) / greatest(sum(matched), 1) AS DOUBLE), 6) AS mean_iou, CAST(min(worst_iou) AS DOUBLE) AS worst_iou FROM cases"
)
def dataset_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    ours, expected = _two_sides(spark, sf_dir)
    r = parity.dataset_report(parity.case_accuracy(ours, expected, parity.match_greedy(ours, expected)))
    return r.select("images", "expected", "ours", "matched", *[F.round(c, 6).alias(c) for c in ("recall", "precision", "mean_iou")], "worst_iou")


@query(
    f"WITH RECURSIVE {MATCHES}, {CASES}, s AS (SELECT image_id, CAST(recall AS DOUBLE) AS recall, CAST(precision AS DOUBLE) AS precision FROM cases WHERE recall < 0.999 OR precision < 0.999) SELECT *, (SELECT greatest(count(*) - 5, 0) FROM s) AS more FROM s ORDER BY image_id LIMIT 5"
)
def report_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    ours, expected = _two_sides(spark, sf_dir)
    return parity.gaps(parity.case_accuracy(ours, expected, parity.match_greedy(ours, expected)))


@query(
    f"""WITH a AS (SELECT image_id, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, face_idx) AS rank, x, y FROM {OURS}), b AS (SELECT image_id, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, face_idx) AS rank, x, y FROM {SHIFTED})
SELECT image_id, rank, greatest(abs(CAST(a.x - b.x AS FLOAT)), abs(CAST(a.y - b.y AS FLOAT)), 0) AS diff, greatest(abs(CAST(a.x - b.x AS FLOAT)), abs(CAST(a.y - b.y AS FLOAT))) <= 0.01 AS within FROM a JOIN b USING (image_id, rank)"""
)
def ranked_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    ours, expected = _two_sides(spark, sf_dir)
    c = parity.compare_ranked(ours, expected, ["x", "y"])
    return c.select("image_id", F.col("rank").cast("long").alias("rank"), "diff", "within")


STEM = "('case' || o_orderkey || CASE o_orderkey % 5 WHEN 0 THEN '_g' WHEN 1 THEN '_o' WHEN 2 THEN '_n' ELSE '' END)"


@query(
    f"SELECT stem, category, n FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY stem) AS n FROM (SELECT {STEM} AS stem, CASE o_orderkey % 5 WHEN 0 THEN 'group' WHEN 1 THEN 'occluded' WHEN 2 THEN 'negative' ELSE 'single' END AS category FROM orders)) WHERE n <= 3"
)
def case_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = table(spark, sf_dir, "orders").selectExpr("concat('case', o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN '_g' WHEN 1 THEN '_o' WHEN 2 THEN '_n' ELSE '' END) AS stem")
    return parity.sample_cases(cases).select("stem", "category", F.col("n").cast("long").alias("n"))


# Queue and stream.


@query("SELECT path, min(event_id) AS event_id FROM (SELECT event_id, 'in/' || user_id || '.png' AS path, user_id FROM events) WHERE user_id % 3 > 0 GROUP BY path")
def enqueue_new_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").selectExpr("event_id", "concat('in/', user_id, '.png') AS path", "user_id")
    queued = e.where("user_id % 3 = 0").select("path").distinct()
    return mapping.enqueue(queued, e.select("path", "event_id"), "path", "event_id")


@query("SELECT count(*) AS frame_count, CAST(coalesce(sum(user_id % 4), 0) AS BIGINT) AS total_faces FROM events WHERE event_type <> 'error'")
def stream_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..streaming.frames import totals

    frames = table(spark, sf_dir, "events").selectExpr("event_id AS frame_id", "event_type <> 'error' AS captured", "user_id % 4 AS faces")
    return totals(frames)


@query(
    "SELECT event_id, printf('webcam_frame%06d_face%d.png', n, event_id % 120 + 1) AS file_name FROM (SELECT event_id, 999700 + row_number() OVER (ORDER BY event_id) AS n FROM events WHERE event_type <> 'error')"
)
def frame_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..streaming.frames import frame_name, numbered

    frames = table(spark, sf_dir, "events").selectExpr("event_id AS frame_id", "event_type <> 'error' AS captured")
    n = numbered(frames, start=999_700)  # so that numbers of six and of seven digits occur
    return n.select(F.col("frame_id").alias("event_id"), frame_name(F.col("frame_no"), F.col("frame_id") % 120).alias("file_name"))


# Shapes.


@query(
    "SELECT p_partkey, i AS idx, round((40 + p_partkey % 60) / 2.0 * (1 + cos(i * 2 * pi() / 128)), 4) AS x, round((30 + p_partkey % 50) / 2.0 * (1 + sin(i * 2 * pi() / 128)), 4) AS y FROM (SELECT p_partkey, unnest(range(128)) AS i FROM part)"
)
def ellipse_outlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    numbers = F.sequence(F.lit(0), F.lit(shapes.ELLIPSE_SEGMENTS - 1))
    # A part is a few bytes and makes 128 points: dealt by rows, as its file is one split.
    p = table(spark, sf_dir, "part").select("p_partkey").repartition(4 * spark.sparkContext.defaultParallelism)
    p = p.select("p_partkey", F.explode(numbers).alias("i"))
    x, y = shapes.ellipse_point(F.expr("40 + p_partkey % 60"), F.expr("30 + p_partkey % 50"), F.col("i"))
    return p.select("p_partkey", F.col("i").cast("long").alias("idx"), F.round(x, 4).alias("x"), F.round(y, 4).alias("y"))


GRID_POINT = "SELECT p_partkey, p_partkey % 40 + 0.5 AS px, p_partkey // 40 % 30 + 0.5 AS py FROM part"
BOXED = "sqrt(pow(greatest({dx}, 0), 2) + pow(greatest({dy}, 0), 2)) + least(greatest({dx}, {dy}), 0)"


@query(
    f"""SELECT p_partkey, round(e, 5) AS ellipse, round({BOXED.format(dx='(ax - 14)', dy='(ay - 9)')} - 6, 5) AS rounded, round(greatest({BOXED.format(dx='(ax - 20)', dy='(ay - 15)')}, (ax + ay - 29) * sqrt(0.5)), 5) AS chamfered,
  round(greatest(0, least(1, 0.5 - 0.5 * e / 4)), 5) AS alpha
FROM (SELECT *, (sqrt(pow(ax / 20, 2) + pow(ay / 15, 2)) - 1) * 15 AS e FROM (SELECT p_partkey, CAST(abs(px - 20) AS DOUBLE) AS ax, CAST(abs(py - 15) AS DOUBLE) AS ay FROM ({GRID_POINT})))"""
)
def shape_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").selectExpr("p_partkey", "CAST(p_partkey % 40 + 0.5 AS DOUBLE) AS px", "CAST(p_partkey div 40 % 30 + 0.5 AS DOUBLE) AS py")
    at = (F.col("px"), F.col("py"), F.lit(40.0), F.lit(30.0))
    e = shapes.signed_distance("ellipse", *at)
    return p.select(
        "p_partkey",
        F.round(e, 5).alias("ellipse"),
        F.round(shapes.signed_distance("rounded_rectangle", *at, 0.2), 5).alias("rounded"),
        F.round(shapes.signed_distance("chamfered_rectangle", *at, 0.2), 5).alias("chamfered"),
        F.round(shapes.mask_alpha(e, F.lit(4.0)), 5).alias("alpha"),
    )


OUTLINED = "(SELECT n_nationkey, 120.0::DOUBLE + n_nationkey AS w, 80.0::DOUBLE + 2 * n_nationkey AS h, 3 + n_nationkey % 6 AS n, radians(7.0::DOUBLE * n_nationkey) AS r FROM nation)"


def _outlines(spark: SparkSession, sf_dir: str, kind: str, size: float = 0.0, iterations: int = 0) -> DataFrame:
    shapes.register(spark)
    table(spark, sf_dir, "nation").createOrReplaceTempView("framewright_nation")
    call = f"crop_outline(120 + n_nationkey, 80 + 2 * n_nationkey, '{kind}', CAST({size} AS DOUBLE), 3 + n_nationkey % 6, CAST(7 * n_nationkey AS DOUBLE), {iterations})"
    return spark.sql(f"SELECT n_nationkey, idx, round(CAST(x AS DOUBLE), 2) + 0.0D AS x, round(CAST(y AS DOUBLE), 2) + 0.0D AS y FROM framewright_nation, LATERAL {call}")


def _shown(points: str) -> str:
    return f"SELECT n_nationkey, CAST(idx AS INTEGER) AS idx, round(CAST(CAST(x AS FLOAT) AS DOUBLE), 2) + 0.0::DOUBLE AS x, round(CAST(CAST(y AS FLOAT) AS DOUBLE), 2) + 0.0::DOUBLE AS y FROM ({points})"


def _fit(points: str) -> str:
    """Points (n_nationkey, w, h, idx, x, y) scaled alike both ways to fill the bounds, centred."""
    ends = f"SELECT *, min(x) OVER k AS x0, min(y) OVER k AS y0, max(x) OVER k - min(x) OVER k AS sx, max(y) OVER k - min(y) OVER k AS sy FROM ({points}) WINDOW k AS (PARTITION BY n_nationkey)"
    scaled = f"SELECT *, least(w / sx, h / sy) AS f FROM ({ends})"
    return _shown(f"SELECT n_nationkey, idx, (x - x0) * f + (w - sx * f) / 2 AS x, (y - y0) * f + (h - sy * f) / 2 AS y FROM ({scaled})")


def _around(n: str, radius: str = "1") -> str:
    at = f"r + 2 * pi() * i / ({n})"
    return f"SELECT n_nationkey, w, h, i AS idx, w / 2 + least(w, h) / 2 * {radius} * cos({at}) AS x, h / 2 + least(w, h) / 2 * {radius} * sin({at}) AS y FROM (SELECT *, unnest(range({n})) AS i FROM {OUTLINED})"


def _koched(points: str) -> str:
    """Each edge with an outward triangle on its middle third."""
    after = lambda c: f"coalesce(lead({c}) OVER k, first_value({c}) OVER k)"
    edges = f"SELECT *, ({after('x')} - x) / 3 AS dx, ({after('y')} - y) / 3 AS dy FROM ({points}) WINDOW k AS (PARTITION BY n_nationkey ORDER BY idx)"
    turned = "sin(-pi() / 3)"
    return f"""SELECT n_nationkey, w, h, idx * 4 + j AS idx, x + CASE j WHEN 0 THEN 0 WHEN 1 THEN dx WHEN 2 THEN dx + dx * 0.5 - dy * {turned} ELSE 2 * dx END AS x,
  y + CASE j WHEN 0 THEN 0 WHEN 1 THEN dy WHEN 2 THEN dy + dx * {turned} + dy * 0.5 ELSE 2 * dy END AS y FROM (SELECT *, unnest(range(4)) AS j FROM ({edges}))"""


def _listed_points(points: list[tuple[str, str]]) -> str:
    """Points given by expressions of w, h and an inset q, a fifth of the shorter side."""
    rows = ", ".join(f"{{'i': {k}, 'x': ({x})::DOUBLE, 'y': ({y})::DOUBLE}}" for k, (x, y) in enumerate(points))
    return f"SELECT n_nationkey, w, h, p.i AS idx, p.x AS x, p.y AS y FROM (SELECT n_nationkey, w, h, unnest([{rows}]) AS p FROM (SELECT *, least(w, h) * 0.2 AS q FROM {OUTLINED}))"


RECTANGLE = [("0", "0"), ("w", "0"), ("w", "h"), ("0", "h")]
CHAMFERED = [("q", "0"), ("w - q", "0"), ("w", "q"), ("w", "h - q"), ("w - q", "h"), ("q", "h"), ("0", "h - q"), ("0", "q")]


@query(_shown(_listed_points(RECTANGLE)))
def rectangle_outlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _outlines(spark, sf_dir, "rectangle")


@query(_shown(_listed_points(CHAMFERED)))
def chamfered_outlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _outlines(spark, sf_dir, "chamfered_rectangle", 0.2)


@query(
    _shown(
        "SELECT n_nationkey, c * 17 + j AS idx, [w - q, w - q, q, q][c + 1] + q * cos((c - 1 + j / 16.0) * pi() / 2) AS x, [q, h - q, h - q, q][c + 1] + q * sin((c - 1 + j / 16.0) * pi() / 2) AS y "
        f"FROM (SELECT *, unnest(range(17)) AS j FROM (SELECT *, least(w, h) * 0.2 AS q, unnest(range(4)) AS c FROM {OUTLINED}))"
    )
)
def rounded_outlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _outlines(spark, sf_dir, "rounded_rectangle", 0.2)


@query(_fit(_around("n")))
def polygon_outlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _outlines(spark, sf_dir, "polygon")


@query(_fit(_around("2 * n", "CASE WHEN i % 2 = 0 THEN 1 ELSE 0.4 END")))
def star_outlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _outlines(spark, sf_dir, "star", 0.4)


@query(_fit(_koched(_koched(_around("n")))))
def koch_outlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _outlines(spark, sf_dir, "koch_polygon", iterations=2)


@query(_fit(_koched(_koched(_listed_points(RECTANGLE)))))
def koch_rectangle_outlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _outlines(spark, sf_dir, "koch_rectangle", iterations=2)
