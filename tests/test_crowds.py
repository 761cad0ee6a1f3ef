import numpy as np
import pytest
from pyspark.sql import functions as F

from framewright.operators import crowds, parity
from framewright.operators import detections as det

BOXES = "image_id long, face_idx long, x float, y float, width float, height float, score float"


def boxes(spark, n, seed, images=3, spread=300, sizes=(5, 60), shift=0.0):
    rng = np.random.default_rng(seed)
    rows = []
    for k in range(n):
        x, y = rng.integers(0, spread, 2) + shift
        w, h = rng.integers(*sizes, 2)
        rows.append((int(k % images), int(k), float(x), float(y), float(w), float(h), float(rng.integers(0, 7) / 8)))
    rows += [(i, n + j, 50.0, 50.0, w, h, 0.5) for i in range(images) for j, (w, h) in enumerate([(30.0, 30.0)] * 5 + [(0.0, 9.0)] * 3 + [(-4.0, 9.0), (1e6, 1e6)])]
    return spark.createDataFrame([*rows, (None, 0, 1.0, 1.0, 5.0, 5.0, 0.5), (99, 0, 1.0, 1.0, 5.0, 5.0, 0.5)], BOXES)


def ids(df):
    return sorted((str(r.image_id), r.face_idx) for r in df.collect())


@pytest.mark.parametrize("threshold,few", [(0.3, 60), (1.0, 10**6)])
def test_suppression_in_rounds_equals_the_fold(spark, threshold, few):
    df = boxes(spark, 200, 1).where("image_id IS NOT NULL")
    assert ids(crowds.suppress_crowded(df, threshold, few_edges=few)) == ids(det.suppress(df, threshold))


def test_centre_dedup_in_rounds_equals_the_fold(spark):
    df = boxes(spark, 200, 2).where("image_id IS NOT NULL")
    assert ids(crowds.dedup_centers_crowded(df, few_edges=60)) == ids(det.dedup_centers(df))


def test_a_chain_is_followed_to_its_end(spark):
    edges = [(k, k + 1) for k in range(7)] + [(10, 11), (10, 12), (11, 12), (12, 13)]
    for few in (0, 100):
        got = crowds.dropped(spark.createDataFrame(edges, "e long, l long"), few_edges=few)
        assert sorted(r.row for r in got.collect()) == [1, 3, 5, 7, 11, 12]


def test_rows_keep_their_columns_and_a_heap_of_copies_is_one(spark):
    df = spark.range(20_000).select(F.lit(1).cast("long").alias("image_id"), F.col("id").alias("face_idx"), *[F.lit(v).cast("float").alias(c) for c, v in (("x", 1), ("y", 2), ("width", 5), ("height", 5), ("score", 0.5))], F.lit("kept").alias("item"))
    got = crowds.suppress_crowded(df)
    assert got.columns == df.columns and [tuple(r)[:2] for r in got.collect()] == [(1, 0)]
    assert [r.face_idx for r in crowds.dedup_centers_crowded(df).collect()] == [0]
    empty = df.where("false")
    assert crowds.suppress_crowded(empty).count() == crowds.dedup_centers_crowded(empty).count() == crowds.match_crowded(empty, df).count() == 0


def matches(df):
    return sorted((str(r.image_id), r.expected_idx, r.our_idx, round(r.iou, 6), round(r.score_delta, 6)) for r in df.collect())


@pytest.mark.parametrize("threshold,few", [(0.5, 20), (0.0, 10**6)])
def test_matching_in_rounds_equals_the_greedy_one(spark, threshold, few):
    ours, expected = boxes(spark, 150, 3, spread=90, sizes=(20, 40)), boxes(spark, 130, 4, spread=90, sizes=(20, 40), shift=0.5)
    known = lambda d: d.where("image_id IS NOT NULL")
    want = matches(parity.match_greedy(known(ours), known(expected), threshold))
    assert matches(crowds.match_crowded(ours, expected, threshold, few_edges=few)) == want and len(want) > 30
