import numpy as np
import pytest
from pyspark.sql import functions as F

from framewright.operators import detections as det
from framewright.operators import parity, policy

BOXES = "image_id long, face_idx long, x float, y float, width float, height float, score float"


def faces(spark, rows):
    return spark.createDataFrame([(1, i, *map(float, r)) for i, r in enumerate(rows)], BOXES)


def test_filter_and_scale(spark):
    df = spark.createDataFrame(
        [(1, 0, 10.0, 20.0, 30.0, 40.0, 12.0, 22.0, 0.95, 2.0, 0.5), (1, 1, 5.0, 5.0, 10.0, 10.0, 1.0, 1.0, 0.2, 2.0, 0.5), (1, 2, 5.0, 5.0, 0.0, 10.0, 1.0, 1.0, 0.9, 2.0, 0.5), (1, 3, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, float("nan"), 2.0, 0.5)],
        "image_id long, face_idx long, x float, y float, width float, height float, nose_x float, nose_y float, score float, scale_x float, scale_y float",
    )
    got = det.filter_and_scale(df, 0.3).collect()
    assert [tuple(r) for r in got] == [(1, 0, 20.0, 10.0, 60.0, 20.0, 24.0, 11.0, pytest.approx(0.95))]


def test_suppression_keeps_the_better(spark):
    df = faces(spark, [(0, 0, 10, 10, 0.99), (1, 1, 10, 10, 0.95), (50, 50, 10, 10, 0.5)])
    for method in (det.suppress, det.suppress_arrow):
        assert sorted(r.face_idx for r in method(df, 0.3).collect()) == [0, 2]
    assert det.suppress(df, 0.0).count() == 3


def test_center_dedup_and_ties(spark):
    df = faces(spark, [(0, 0, 100, 100, 0.9), (40, 0, 100, 100, 0.9), (80, 0, 100, 100, 0.8), (200, 0, 4, 4, 0.7), (205, 0, 4, 4, 0.6)])
    assert sorted(r.face_idx for r in det.dedup_centers(df).collect()) == [0, 2, 3]


def test_fold_and_arrow_agree_on_many(spark):
    rng = np.random.default_rng(1)
    rows = [(int(k % 7), int(k), *map(float, rng.uniform(0, 100, 2)), *map(float, rng.uniform(5, 60, 2)), float(rng.integers(0, 9) / 10)) for k in range(600)]
    df = spark.createDataFrame(rows, BOXES)
    a, b = (sorted((r.image_id, r.face_idx) for r in m(df, 0.3).collect()) for m in (det.suppress, det.suppress_arrow))
    assert a == b and 7 < len(a) < 600
    plain, grid = sorted(det.overlap_pairs(df, 0.1).collect()), sorted(det.overlap_pairs_grid(df, 0.1, small=50).collect())
    assert plain == grid and plain


def test_decoding_agrees_with_numpy(spark):
    rng = np.random.default_rng(2)
    n, cols = 40, 8
    cls, obj = rng.uniform(-0.2, 1.2, n).astype("f4"), rng.uniform(-0.2, 1.2, n).astype("f4")
    bbox, kps = rng.normal(size=(n, 4)).astype("f4"), rng.normal(size=(n, 10)).astype("f4")
    want = det.decode_tensors(cls, obj, bbox.ravel(), kps.ravel(), 16, cols)
    rows = [(i, 16, i // cols, i % cols, float(cls[i]), float(obj[i]), bbox[i].tolist(), kps[i].tolist()) for i in range(n)]
    got = det.decode_cells(spark.createDataFrame(rows, "i int, stride int, row int, col int, cls float, obj float, bbox array<float>, kps array<float>")).orderBy("i").toPandas()
    points = [f"{p}_{a}" for p in det.LANDMARKS for a in "xy"]
    assert np.allclose(got[["x", "y", "width", "height", *points, "score"]].to_numpy(), want, rtol=1e-6, atol=1e-5)
    assert sum(r * c for _, r, c in det.stride_cells()) == 8400
    with pytest.raises(ValueError):
        det.decode_tensors(cls, obj[:-1], bbox, kps, 16, cols)


def test_empty_detections(spark):
    none = spark.createDataFrame([], BOXES)
    assert det.suppress(none).count() == det.dedup_centers(none).count() == det.overlap_pairs_grid(none, 0.1).count() == 0
    assert policy.run_counters(spark.createDataFrame([], "faces long, saved long, skipped long")).first().asDict() == {"images_processed": 0, "faces_detected": 0, "crops_saved": 0, "crops_skipped_quality": 0}


def test_matching_takes_each_face_once(spark):
    ours = faces(spark, [(0, 0, 10, 10, 0.9), (1, 0, 10, 10, 0.8)])
    expected = faces(spark, [(1, 0, 10, 10, 1.0), (0, 0, 10, 10, 1.0), (90, 90, 5, 5, 1.0)])
    m = sorted(tuple(r)[1:3] for r in parity.match_greedy(ours, expected).collect())
    assert m == [(0, 1), (1, 0)]
    case = parity.case_accuracy(ours, expected, parity.match_greedy(ours, expected)).first()
    assert case.recall == pytest.approx(2 / 3) and case.precision == 1.0 and case.worst_iou == 1.0
    lone = parity.case_accuracy(faces(spark, []), expected, parity.match_greedy(faces(spark, []), expected)).first()
    assert (lone.recall, lone.precision, lone.worst_iou) == (0.0, 0.0, 1.0)


def test_policy_ties_and_thresholds(spark):
    df = spark.createDataFrame([(1, k, float(s)) for k, s in enumerate([50, 300, 300.1, 1000, 1500, 1500])], "image_id long, face_idx long, quality_score double").withColumn("quality", policy.quality_of(F.col("quality_score")))
    assert [r.quality for r in df.orderBy("face_idx").collect()] == ["Low", "Low", "Medium", "Medium", "High", "High"]
    assert policy.select_faces(df, auto_select=True).first().face_idx == 5  # the last of equals
    assert policy.select_faces(df, F.lit(0)).count() == 0 and policy.select_faces(df, F.lit(1)).first().face_idx == 0
    plan = policy.plan_exports(df, "Medium", face_index=1).first()
    assert plan.multi_face is False and plan.skipped is True
    assert policy.plan_exports(df.where("quality <> 'High'"), skip_without_high=True).count() == 0


def test_named_and_ranked_comparison(spark):
    a = spark.createDataFrame([("x", 1), ("y", 2)], "name string, region int")
    b = spark.createDataFrame([("x", 1), ("z", 2)], "name string, region int")
    assert {r.name: r.equal for r in parity.compare_named(a, b).collect()} == {"x": True, "y": False, "z": False}


def boxes_of(seed, images, most):
    rnd = np.random.default_rng(seed)
    rows = []
    for image in range(images):
        for i in range(int(rnd.integers(0, most))):
            rows.append((image, i * 3, *(float(v) for v in rnd.integers(0, 200, 2)), *(float(v) for v in rnd.integers(-2, 60, 2))))
    return rows


def test_swept_and_large_and_odd_images_give_the_plain_pairs(spark):
    odd = [(100, 1, float("nan"), 1.0, 9.0, 9.0), (100, 2, 1.0, 1.0, 9.0, 9.0), (100, 3, 2.0, 2.0, 9.0, 9.0), (101, 1, None, 1.0, 9.0, 9.0), (101, 2, 3.0, 1.0, 9.0, 9.0), (None, 1, 1.0, 1.0, 5.0, 5.0), (None, 2, 1.0, 1.0, 5.0, 5.0)]
    rows = boxes_of(1, 12, 260) + odd + [(102, 5, 1.0, 1.0, 5.0, 5.0)] * 2 + [(103, i, 7.0, 7.0, 3.0, 3.0) for i in range(40)]
    df = spark.createDataFrame(rows, "image_id long, face_idx long, x float, y float, width float, height float").repartition(5)
    want = sorted(map(repr, det._plain_pairs(df, 0.1, "image_id", "face_idx").collect()))
    for options in ({}, {"large": 50, "small": 20}, {"large": 1}):
        assert sorted(map(repr, det.overlap_pairs_grid(df, 0.1, **options).collect())) == want and want
    assert sorted(map(repr, det.overlap_pairs(df, 0.1).collect())) == want


def test_images_of_many_boxes_are_not_joined_with_themselves(spark):
    df = spark.createDataFrame(boxes_of(2, 1, 2) + [(7, i, float(i), 1.0, 3.0, 3.0) for i in range(det.GRID_FROM)], "image_id long, face_idx long, x float, y float, width float, height float")
    plan = det.overlap_pairs(df, 0.1)._jdf.queryExecution().toString()
    assert "Join" not in plan


def test_images_are_suppressed_at_once_as_one_by_one():
    rnd = np.random.default_rng(3)
    sizes = rnd.integers(0, 30, 200)
    images = [np.stack([*rnd.integers(0, 90, (2, n)), *rnd.integers(-1, 40, (2, n))], axis=1).astype(np.float32).reshape(n, 4) for n in sizes]
    images[5] = np.where(rnd.random(images[5].shape) < 0.2, np.nan, images[5]).astype(np.float32)
    alive = det._suppressed(det._measured(*np.concatenate(images).T), sizes, 0.3)
    numbers = det._numbered(alive, sizes).to_pylist()
    assert numbers == [det.suppress_boxes(b, 0.3).tolist() for b in images]


def test_images_are_matched_at_once_as_one_by_one():
    rnd = np.random.default_rng(5)
    n_o, n_e = rnd.integers(0, 12, (2, 150))
    box = lambda n: np.stack([*rnd.integers(0, 30, (2, n)), *rnd.integers(-1, 40, (2, n))], axis=1).astype(np.float32).reshape(n, 4)
    ours, expected = [box(n) for n in n_o], [box(n) for n in n_e]
    ours[3] = np.full_like(ours[3], np.nan)
    e, o, v = parity._matched(det._measured(*np.concatenate(ours).T), n_o, det._measured(*np.concatenate(expected).T), n_e, 0.5)
    want, at_o, at_e = [], 0, 0
    for a, b in zip(ours, expected):
        free = [True] * len(a)
        for k, row in enumerate(b):
            over = [float(det._overlap(det._measured(*row[:, None]), det._measured(*x[:, None]))[0]) if free[i] else -1.0 for i, x in enumerate(a)]
            best = int(np.argmax(over)) if over else -1
            if over and over[best] >= 0.5:
                free[best] = False
                want.append((at_e + k, at_o + best, over[best]))
        at_o, at_e = at_o + len(a), at_e + len(b)
    assert list(zip(e.tolist(), o.tolist(), v.tolist())) == want and want
