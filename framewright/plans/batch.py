"""The batch job from images and detector rows to named, encoded crops, as one plan."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry, naming
from ..functions.geometry import Box
from ..functions.shapes import apply_mask
from ..operators import detections as det
from ..operators import pixels, policy
from ..sources.settings import Settings
from ..sources.sinks import encode_images, metadata_payload


def detect(rows: DataFrame, settings: Settings, image: str = "path") -> DataFrame:
    """Detections of raw rows (path, face_idx, box, score, scale_x, scale_y)."""
    d = settings.detection
    return det.postprocess(rows, d.score_threshold, d.nms_threshold, d.top_k, image)


def beside(images: DataFrame, faces: DataFrame, broadcast_faces: int = 100_000) -> DataFrame:
    """``images`` with their detected faces as an array column; images without any are left out.

    Few faces, whose number is checked, are broadcast, so that images stay where they are; more are joined
    by path, which moves each image once, however many faces it has.
    """
    flat = [(f"{n}_x", f"{n}_y") for n in det.LANDMARKS]
    if "landmarks" in faces.columns:
        landmarks = F.col("landmarks")
    elif all(c in faces.columns for pair in flat for c in pair):
        landmarks = F.array(*[F.struct(F.col(x).cast("float").alias("x"), F.col(y).cast("float").alias("y")) for x, y in flat])
    else:
        landmarks = F.array().cast("array<struct<x:float,y:float>>")
    face = F.struct(F.col("face_idx").cast("long").alias("face_idx"), *[F.col(c).cast("float").alias(c) for c in ("x", "y", "width", "height", "score")], landmarks.alias("landmarks"))
    grouped = faces.groupBy("path").agg(F.sort_array(F.collect_list(face)).alias("faces"))
    few = faces.limit(broadcast_faces + 1).count() <= broadcast_faces
    return images.join(F.broadcast(grouped) if few else grouped, "path")


def _planned(images: DataFrame, settings: Settings) -> DataFrame:
    """Each face with its region, the angle that levels its eyes, and its eyes in the crop."""
    c = settings.crop
    fixed = [F.lit(v) for v in (c.output_width, c.output_height, c.face_height_pct, c.positioning_mode, c.horizontal_offset, c.vertical_offset)]
    known = lambda f: F.size(f["landmarks"]) >= 2
    eyes = lambda f: (F.get(f["landmarks"], F.lit(0)), F.get(f["landmarks"], F.lit(1)))

    def planned(f: Column) -> Column:
        box = Box.of(f)
        region = geometry.crop_region(box, F.col("width"), F.col("height"), *fixed)
        angle = F.when(known(f), -geometry.eye_angle(*eyes(f))) if c.eye_line_align else F.lit(None).cast("float")
        discs = F.when(known(f), geometry.eye_discs(box, *eyes(f), region, F.lit(c.output_width), F.lit(c.output_height)))
        return F.struct(f["face_idx"].alias("face_idx"), f["score"].alias("score"), region.alias("region"), F.coalesce(angle, F.lit(0.0).cast("float")).alias("angle"), discs.alias("eyes"))

    return images.withColumn("faces", F.transform("faces", planned))


def crops(images: DataFrame, faces: DataFrame | None, settings: Settings, mask_first: bool = False) -> DataFrame:
    """Finished crops of detected faces: path, face_idx, score, region, width, height, data, quality_score, quality.

    ``images`` has path, width, height and data in RGBA, and an array column faces unless ``faces`` are
    given as rows.  Each face is cut out, turned so that its eyes are level, and then enhanced, scored and
    masked; with ``mask_first`` it is masked, filled behind, enhanced at its eyes, and scored.  All that
    happens to an image at once, where it lies.  A column exif of the images is kept for the encoder.
    """
    c, strengths = settings.crop, settings.enhance
    fill = tuple(c.fill_color)

    def masked(img: np.ndarray) -> np.ndarray:
        return apply_mask(img, c.shape, c.vignette_softness, c.vignette_intensity, tuple(c.vignette_color[:3]))

    def work(img: np.ndarray, face: dict) -> tuple[np.ndarray, float]:
        r = face["region"]
        out = pixels.crop(img, (r["x"], r["y"], r["width"], r["height"]), c.output_width, c.output_height, fill, face["angle"] or 0.0)
        if mask_first:
            eyes = [(e["x"], e["y"], e["radius"]) for e in face["eyes"] or []]
            out = pixels.enhance(pixels.fill_behind(masked(out), fill), strengths, eyes or None)
            return out, pixels.sharpness(out)
        out = pixels.enhance(out, strengths)
        return masked(out), pixels.sharpness(out)

    placed = _planned(images if faces is None else beside(images, faces), settings)
    made = pixels.per_face(placed, work, [x for x in ("path", "exif") if x in images.columns])
    return made.withColumn("quality", policy.quality_of(F.col("quality_score")))


def annotated(images: DataFrame) -> DataFrame:
    """Images with an array column faces, outlines and landmarks drawn into them: path (the file name), width, height, data."""
    w, h = F.col("width"), F.col("height")
    mark = lambda f: F.struct(
        geometry.annotation_rect(Box.of(f), w, h).alias("rect"),
        F.transform(f["landmarks"], lambda p: F.struct(geometry.pixel_index(p["x"], w).alias("x"), geometry.pixel_index(p["y"], h).alias("y"))).alias("points"),
    )
    name = F.coalesce(naming.file_name(F.col("path")), F.lit("frame.png"))
    marked = images.select(name.alias("path"), "width", "height", "data", F.transform("faces", mark).alias("marks"))

    def draw(img: np.ndarray, marks: list[dict] | None) -> np.ndarray:
        rects = [tuple(m["rect"][k] for k in ("x", "y", "width", "height")) for m in marks or []]
        return pixels.annotate(img, rects, [(p["x"], p["y"]) for m in marks or [] for p in m["points"]])

    return pixels.map_images(marked, draw, "marks").drop("marks")


def payload(settings: Settings) -> Column:
    """The metadata text of a finished crop."""
    c, m = settings.crop, settings.crop.metadata
    number = lambda v: F.lit(float(v))
    told = F.struct(
        F.lit(c.preset).alias("preset"), F.lit(c.output_width).alias("output_width"), F.lit(c.output_height).alias("output_height"), number(c.face_height_pct).alias("face_height_pct"),
        F.lit(c.positioning_mode).alias("positioning_mode"), number(c.horizontal_offset).alias("horizontal_offset"), number(c.vertical_offset).alias("vertical_offset"),
    )
    fields = {"crop_settings": told} if m.include_crop_settings else {}
    if m.include_quality_metrics:
        fields |= {"quality": F.lower("quality"), "quality_score": F.col("quality_score"), "face_confidence": F.col("score").cast("double")}
    tags = F.create_map(*[F.lit(x) for kv in m.custom_tags.items() for x in kv]) if m.custom_tags else F.create_map().cast("map<string,string>")
    return metadata_payload(F.lit(m.mode), tags, fields)


def encoded(made: DataFrame, settings: Settings) -> DataFrame:
    """path and encoded of named crops, with their metadata; Exif bodies of the source only in mode preserve."""
    c = settings.crop
    exif = F.col("exif") if "exif" in made.columns and c.metadata.mode == "preserve" else F.lit(None).cast("array<binary>")
    ready = made.select("path", "width", "height", "data", payload(settings).alias("payload"), exif.alias("exif"))
    return encode_images(ready, c.output_format, c.png_compression, c.jpeg_quality).select("path", "encoded")


def extension(settings: Settings) -> str:
    return {"jpeg": "jpg", "tiff": "tif"}.get(settings.crop.output_format, settings.crop.output_format)


def exports(made: DataFrame, settings: Settings, template: str | None = None, output_dir: str = "", timestamp: int = 0) -> DataFrame:
    """Crops that pass the quality rules, named and encoded with their metadata: path and encoded."""
    rules = settings.crop.quality_rules
    planned = policy.plan_exports(made, rules.min_quality, rules.auto_skip_no_high_quality, None, rules.auto_select_best_face, image="path")
    suffix = policy.quality_suffix(F.col("quality")) if rules.quality_suffix else F.lit("")
    name = naming.crop_filename(naming.file_stem(F.col("path")), F.col("face_idx"), F.col("width"), F.col("height"), F.lit(extension(settings)), F.lit(timestamp), F.lit(template), suffix)
    kept = planned.where(~F.col("skipped")).withColumn("path", F.concat_ws("/", *([F.lit(output_dir)] if output_dir else []), name))
    return encoded(kept, settings)
