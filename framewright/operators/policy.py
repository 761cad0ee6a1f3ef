"""Quality buckets, skip rules, choice of faces and run totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

QUALITY = ["Low", "Medium", "High"]
MEDIUM_ABOVE, HIGH_ABOVE = 300.0, 1000.0


def quality_of(score: Column) -> Column:
    return F.when(score > HIGH_ABOVE, "High").when(score > MEDIUM_ABOVE, "Medium").otherwise("Low")


def quality_rank(quality: Column) -> Column:
    """0, 1 or 2: names do not sort as qualities do."""
    return F.when(quality == "High", 2).when(quality == "Medium", 1).when(quality == "Low", 0)


def parse_quality(token: Column) -> Column:
    t = F.lower(F.trim(token))
    return F.when(t == "low", "Low").when(t.isin("medium", "med"), "Medium").when(t == "high", "High")


def quality_suffix(quality: Column) -> Column:
    return F.when(quality == "High", "_highq").when(quality == "Medium", "_medq").when(quality == "Low", "_lowq")


def should_skip(quality: Column, minimum: Column) -> Column:
    """Below the minimum, if one is set."""
    return F.coalesce(quality_rank(quality) < quality_rank(minimum), F.lit(False))


def with_image_skip(faces: DataFrame, image: str = "image_id") -> DataFrame:
    """Add skip_image: whether no face of the image is of high quality."""
    best = F.max(quality_rank(F.col("quality"))).over(Window.partitionBy(image))
    return faces.withColumn("skip_image", F.coalesce(best < 2, F.lit(True)))


def best_quality(faces: DataFrame, image: str = "image_id") -> DataFrame:
    best = F.max(quality_rank(F.col("quality")))
    return faces.groupBy(image).agg(best.alias("rank")).select(image, F.element_at(F.array(*map(F.lit, QUALITY)), F.col("rank") + 1).alias("best_quality"))


def best_face(faces: DataFrame, keys: list[Column], image: str = "image_id", index: str = "face_idx") -> DataFrame:
    """The face of each image with the largest keys, compared in order; the last of equals."""
    order = Window.partitionBy(image).orderBy(*[F.desc(k) if isinstance(k, str) else k.desc() for k in keys], F.desc(index))
    return faces.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")


def select_faces(faces: DataFrame, face_index: Column | None = None, auto_select: bool = False, image: str = "image_id", index: str = "face_idx") -> DataFrame:
    """One face by its number from 1 (0 and missing numbers give nothing), else the best of several, else all."""
    if face_index is not None:
        return faces.where(F.col(index) == face_index - 1)
    if auto_select:
        return best_face(faces, [quality_rank(F.col("quality")), F.col("quality_score")], image, index)
    return faces


def plan_exports(faces: DataFrame, minimum: str | None = None, skip_without_high: bool = False, face_index: int | None = None, auto_select: bool = False, image: str = "image_id", index: str = "face_idx") -> DataFrame:
    """Which crops of each image are written, as columns multi_face, skipped and reason on the faces considered.

    The image rule comes first, then the choice of faces, then ``multi_face`` from how many are left, and
    last the rule per crop.
    """
    marked = with_image_skip(faces, image)
    passed = marked.where(~F.col("skip_image")) if skip_without_high else marked
    chosen = select_faces(passed, None if face_index is None else F.lit(face_index), auto_select, image, index)
    multi = (F.count("*").over(Window.partitionBy(image)) > 1).alias("multi_face")
    low = should_skip(F.col("quality"), F.lit(minimum))
    return chosen.drop("skip_image").select("*", multi, low.alias("skipped"))


def run_counters(outcomes: DataFrame) -> DataFrame:
    """Totals of a run, from one row per image: faces, saved, skipped and whether it failed.

    Failed images count as processed.  Plain sums, so retried tasks count once.
    """
    none = F.lit(0).cast("long")
    return outcomes.agg(
        F.count("*").alias("images_processed"),
        F.coalesce(F.sum("faces"), none).alias("faces_detected"),
        F.coalesce(F.sum("saved"), none).alias("crops_saved"),
        F.coalesce(F.sum("skipped"), none).alias("crops_skipped_quality"),
    )


def summary_line(counters: DataFrame) -> DataFrame:
    names = ["images_processed", "faces_detected", "crops_saved", "crops_skipped_quality"]
    return counters.select(F.concat_ws(" ", *[F.concat(F.lit(f"{c}="), F.col(c).cast("string")) for c in names]).alias("summary"))


def with_manual_box(faces: DataFrame, boxes: DataFrame) -> DataFrame:
    """Append boxes drawn by hand: score 1, quality High, no landmarks."""
    drawn = boxes.withColumns({"score": F.lit(1.0).cast("float"), "quality_score": F.lit(1.0), "quality": F.lit("High")})
    return faces.unionByName(drawn, allowMissingColumns=True)


def without_faces(faces: DataFrame, deleted: DataFrame, image: str = "image_id", index: str = "face_idx") -> DataFrame:
    return faces.join(deleted, [image, index], "left_anti")


def timing_stats(samples: DataFrame, by: list[str] | None = None, value: str = "ms") -> DataFrame:
    """Samples, total, mean, least and most; the mean of none is 0."""
    return samples.groupBy(*(by or [])).agg(
        F.count(value).alias("samples"),
        F.coalesce(F.sum(value), F.lit(0.0)).alias("total_ms"),
        F.coalesce(F.avg(value), F.lit(0.0)).alias("avg_ms"),
        F.min(value).alias("min_ms"),
        F.max(value).alias("max_ms"),
    )


def batch_totals(statuses: DataFrame, status: str = "status") -> DataFrame:
    """How many batch items failed, and how many ended in any other way."""
    failed = F.count_if(F.lower(F.col(status)) == "failed")
    return statuses.agg((F.count("*") - failed).alias("completed"), failed.alias("failed"))


def failure_log(statuses: DataFrame) -> DataFrame:
    """Items that failed or exported nothing, in order, for a JSON or CSV writer."""
    bad = (F.lower("status") == "failed") | (F.coalesce("faces_exported", F.lit(0)) == 0)
    return statuses.where(bad).select("index", "path", "error", "faces_detected").orderBy("index")
