"""Accuracy of detections against expected ones: greedy matching, recall and precision, reports."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import detections as det

MATCH_IOU = 0.5
GAP = 0.999


def category(stem: Column) -> Column:
    return F.when(stem.endswith("_g"), "group").when(stem.endswith("_o"), "occluded").when(stem.endswith("_n"), "negative").otherwise("single")


def sample_cases(cases: DataFrame, per_category: int = 3, stem: str = "stem") -> DataFrame:
    """The first cases of each category in order of name."""
    w = Window.partitionBy("category").orderBy(stem)
    return cases.withColumn("category", category(F.col(stem))).withColumn("n", F.row_number().over(w)).where(F.col("n") <= per_category)


def _matched(ours: np.ndarray, n_ours: np.ndarray, expected: np.ndarray, n_expected: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(expected row, our row, overlap) of the matches of many images; an image's boxes follow each other on both sides.

    The first expected boxes of all images choose at once, then the second ones, and so on; the first of equals is taken.
    """
    first_o, first_e = np.cumsum(n_ours) - n_ours, np.cumsum(n_expected) - n_expected
    free, found, k = np.ones(ours.shape[1], dtype=bool), [], 0
    going = np.flatnonzero((n_ours > 0) & (n_expected > 0))
    while len(going):
        e, counts = first_e[going] + k, n_ours[going]
        j = det._spans(first_o[going], counts)
        over = np.where(free[j], det._overlap(expected[:, np.repeat(e, counts)], ours[:, j]), np.float32(-1))
        begins = np.cumsum(counts) - counts
        best = np.maximum.reduceat(over, begins)
        at = np.where(over == np.repeat(best, counts), np.arange(len(over)), len(over))
        at = np.minimum.reduceat(at, begins)
        hit = (best >= np.float32(threshold)) & (best > 0)
        o = j[at[hit]]
        free[o] = False
        found.append((e[hit], o, best[hit]))
        k += 1
        going = going[n_expected[going] > k]
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.float32)
    e, o, v = (np.concatenate(c) for c in zip(*found))
    order = np.argsort(e)
    return e[order], o[order], v[order]


def match_greedy(ours: DataFrame, expected: DataFrame, threshold: float = MATCH_IOU, image: str = "image_id", index: str = "face_idx") -> DataFrame:
    """Each expected face, in order, takes the unused one of ours that overlaps it most, by ``threshold`` at least.

    Returns image, expected_idx, our_idx, iou, score_delta of the matches.  Images travel as arrays, many in
    an Arrow batch; an image has few faces.
    """

    def side(df: DataFrame, s: str) -> DataFrame:
        face = F.struct(F.col(index).cast("long").alias("i"), *[F.col(c).cast("float").alias(c) for c in ("x", "y", "width", "height", "score")])
        packed = df.groupBy(image).agg(F.sort_array(F.collect_list(face)).alias("f"))
        return packed.select(image, F.col("f").alias(f"f{s}"), F.flatten(F.transform("f", lambda d: F.array(d["x"], d["y"], d["width"], d["height"]))).alias(f"b{s}"))

    @F.arrow_udf("array<struct<e:int,o:int,iou:float>>")
    def matched(a: pa.Array, b: pa.Array) -> pa.Array:
        boxes = [det._measured(*x.flatten().to_numpy(zero_copy_only=False).reshape(-1, 4).T) for x in (a, b)]
        n_o, n_e = (det._sizes(x) // 4 for x in (a, b))
        e, o, v = _matched(boxes[0], n_o, boxes[1], n_e, threshold)
        ends = np.cumsum(n_e)
        of = np.searchsorted(ends, e, "right")
        offsets = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(n_e)))]).astype(np.int32)
        places = [(x - (np.cumsum(n) - n)[of]).astype(np.int32) for x, n in ((e, n_e), (o, n_o))]
        return pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([*map(pa.array, places), pa.array(v, pa.float32())], ["e", "o", "iou"]))

    both = side(ours, "o").join(side(expected, "e"), image)
    found = both.select(image, "fo", "fe", F.explode(matched("bo", "be")).alias("m"))
    o, e = F.get("fo", F.col("m.o")), F.get("fe", F.col("m.e"))
    return found.select(image, e["i"].alias("expected_idx"), o["i"].alias("our_idx"), F.col("m.iou").alias("iou"), (o["score"] - e["score"]).cast("float").alias("score_delta"))


def case_accuracy(ours: DataFrame, expected: DataFrame, matches: DataFrame, image: str = "image_id") -> DataFrame:
    """Counts, recall, precision and match statistics of each image that either side knows."""
    a = ours.groupBy(image).agg(F.count("*").alias("ours"))
    b = expected.groupBy(image).agg(F.count("*").alias("expected"))
    delta = F.col("score_delta").cast("double")
    m = matches.groupBy(image).agg(
        F.count("*").alias("matched"),
        F.avg(F.col("iou").cast("double")).alias("mean_iou"),
        F.avg(delta).alias("mean_delta"),
        F.avg(F.abs(delta)).alias("mean_abs_delta"),
        F.min("iou").alias("worst_iou"),
        F.max(F.abs(F.col("score_delta"))).alias("worst_abs_delta"),
    )
    joined = a.join(b, image, "full").join(m, image, "left").fillna(0, ["ours", "expected", "matched"])
    share = lambda n, other: F.when(F.col(n) == 0, F.when(F.col(other) == 0, 1.0).otherwise(0.0)).otherwise(F.col("matched") / F.col(n))
    return joined.select(
        image,
        "expected",
        "ours",
        "matched",
        share("expected", "ours").alias("recall"),
        share("ours", "expected").alias("precision"),
        *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("mean_iou", "mean_delta", "mean_abs_delta")],
        F.coalesce(F.col("worst_iou").cast("double"), F.lit(1.0)).alias("worst_iou"),
        F.coalesce(F.col("worst_abs_delta").cast("double"), F.lit(0.0)).alias("worst_abs_delta"),
    )


def dataset_report(cases: DataFrame) -> DataFrame:
    """One row: recall and precision as means over images, match statistics weighted by matches."""
    weight = F.greatest(F.sum("matched"), F.lit(1))
    mean = lambda c: (F.sum(F.col(c) * F.col("matched")) / weight).alias(c)
    return cases.agg(
        F.count("*").alias("images"),
        F.sum("expected").alias("expected"),
        F.sum("ours").alias("ours"),
        F.sum("matched").alias("matched"),
        F.avg("recall").alias("recall"),
        F.avg("precision").alias("precision"),
        mean("mean_iou"),
        mean("mean_delta"),
        mean("mean_abs_delta"),
        F.min("worst_iou").alias("worst_iou"),
        F.max("worst_abs_delta").alias("worst_abs_delta"),
    )


def gaps(cases: DataFrame, image: str = "image_id", shown: int = 5) -> DataFrame:
    """The first images whose recall or precision falls short, and how many more there are."""
    short = cases.where((F.col("recall") < GAP) | (F.col("precision") < GAP))
    return short.select(image, "recall", "precision").orderBy(image).limit(shown).crossJoin(short.agg(F.greatest(F.count("*") - shown, F.lit(0)).alias("more")))


def compare_named(ours: DataFrame, golden: DataFrame, name: str = "name", value: str = "region") -> DataFrame:
    """Both sides by name, with whether they are exactly equal; missing ones differ."""
    a, b = ours.select(name, F.col(value).alias("ours")), golden.select(name, F.col(value).alias("golden"))
    return a.join(b, name, "full").select(name, "ours", "golden", F.col("ours").eqNullSafe(F.col("golden")).alias("equal"))


def compare_ranked(ours: DataFrame, expected: DataFrame, columns: list[str], tolerance: float = 1e-2, image: str = "image_id", index: str = "face_idx") -> DataFrame:
    """Faces paired by rank of score, with the largest difference of the given columns."""
    w = Window.partitionBy(image).orderBy(F.desc("score"), F.asc(index))
    side = lambda df, s: df.select(image, F.row_number().over(w).alias("rank"), *[F.col(c).alias(f"{c}{s}") for c in columns])
    diff = F.greatest(*[F.abs(F.col(f"{c}_a") - F.col(f"{c}_b")) for c in columns], F.lit(0.0).cast("float"))
    return side(ours, "_a").join(side(expected, "_b"), [image, "rank"]).select(image, "rank", diff.alias("diff"), (diff <= tolerance).alias("within"))
