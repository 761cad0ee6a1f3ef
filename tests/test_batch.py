"""The crop job, the encoder it writes with, the model it may detect with, and the frame loop."""

import hashlib
import json
import os
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from framewright.functions.shapes import Shape, apply_mask
from framewright.operators import detections as det
from framewright.operators import pixels as px
from framewright.plans import batch
from framewright.sources import images, settings, sinks
from framewright.streaming import frames

IMAGE = "path string, width int, height int, data binary"


def picture(h=120, w=160, seed=3):
    img = np.random.default_rng(seed).integers(0, 256, (h, w, 4), dtype=np.uint8)
    img[..., 3] = 255
    return img


def face_rows(spark, faces):
    columns = [c for pair in ((f"{n}_x", f"{n}_y") for n in det.LANDMARKS) for c in pair]
    schema = "path string, face_idx long, x float, y float, width float, height float, score float, " + ", ".join(f"{c} float" for c in columns)
    return spark.createDataFrame(faces, schema)


EYES = (60.0, 50.0, 90.0, 65.0, 75.0, 70.0, 65.0, 85.0, 85.0, 85.0)
NO_EYES = (0.0,) * 10


def region_of(row):
    return tuple(row.region[c] for c in ("x", "y", "width", "height"))


def test_order_of_steps_alignment_and_masks(spark):
    img = picture()
    pics = spark.createDataFrame([("d/a.png", 160, 120, img.tobytes()), ("d/none.png", 160, 120, img.tobytes()), ("d/bad.png", 1, 1, b"x")], IMAGE)
    faces = face_rows(spark, [("d/a.png", 0, 50.0, 30.0, 50.0, 60.0, 0.95, *EYES), ("d/a.png", 1, 5.0, 5.0, 40.0, 40.0, 0.9, *NO_EYES), ("d/bad.png", 0, 0.0, 0.0, 1.0, 1.0, 0.9, *NO_EYES)])
    s = settings.Settings()
    c = s.crop
    c.output_width = c.output_height = 48
    c.fill_color = (10, 20, 30, 255)
    c.shape, c.vignette_softness, c.eye_line_align = Shape("ellipse"), 0.2, True
    s.enhance = px.Enhancement(unsharp_amount=0.0, contrast=1.2, red_eye_removal=True)
    angle = -np.arctan2(np.float32(15), np.float32(30))
    for few in (100, -1):  # faces broadcast, and joined
        beside = batch.beside(pics, faces, few)
        got = {r.face_idx: r for r in batch.crops(beside, None, s).collect()}
        assert set(got) == {0, 1} and all(r.path == "d/a.png" for r in got.values())
    for k, turn in ((0, angle), (1, 0.0)):
        cut = px.enhance(px.crop(img, region_of(got[k]), 48, 48, c.fill_color, turn), s.enhance)
        assert got[k].data == apply_mask(cut, c.shape, 0.2, 1.0, (0, 0, 0)).tobytes() and got[k].quality_score == px.sharpness(cut)
    first = {r.face_idx: r for r in batch.crops(pics, faces, s, mask_first=True).collect()}
    r = first[0]
    box, region = np.array([50, 30, 50, 60]), region_of(r)
    radius = max(4.0, 60 / region[3] * 48 * 0.12)
    eyes = [((x - region[0]) * 48 / region[2], (y - region[1]) * 48 / region[3], radius) for x, y in (EYES[:2], EYES[2:4])]
    want = px.enhance(px.fill_behind(apply_mask(px.crop(img, region, 48, 48, c.fill_color, angle), c.shape, 0.2), c.fill_color), s.enhance, eyes)
    assert (np.frombuffer(r.data, np.uint8) == want.ravel()).all() and r.quality_score == px.sharpness(want) and box.size == 4


def test_crop_and_enhance_does_every_step(spark, sf_dir):
    """Each row of the query against the kernels, one after another."""
    from framewright.plans import queries

    pixels = {r.vec_id: np.array(r.pixels, dtype=np.int64).reshape(8, 8) for r in queries._images(spark, sf_dir).collect()}
    got = {int(r.path): r for r in queries.crop_and_enhance(spark, sf_dir).collect()}
    assert got.keys() == pixels.keys()
    turn = -float(np.float32(np.arctan2(3.0, 18.0)))  # of upright faces, which stay upright
    steps = [
        px.equalize,
        lambda x: px.remove_red_eye(x, 1.5),
        lambda x: px.exposure(x, -0.25),
        lambda x: px.brightness(x, -5),
        lambda x: px.contrast(x, 0.9),
        lambda x: px.saturation(x, 0.8),
        lambda x: px.smooth_skin(x, 0.25, 3.0, 25.0),
        lambda x: px.unsharp(x, 0.4 + 0.1, 0.9),
        lambda x: px.blur_background(x, 15.0, 0.6),
    ]
    changed = [0] * len(steps)
    for v in sorted(pixels)[:35]:
        p = pixels[v]
        img = np.kron(np.dstack([p, p * 3 % 256, p * 7 % 256, 255 - p % 64]), np.ones((16, 16, 1))).astype(np.uint8)
        left, top = 22 + v % 7 * 3 + 24 - 56 / 0.6 * 0.4, 25 + v % 5 * 4 + 28 - 56 / 0.6 * 0.5
        region = (round(left), round(top), 75, 93)
        out = px.crop(img, region, 96, 120, (0, 0, 0, 255), turn)
        for k, step in enumerate(steps):
            before, out = out, step(out)
            changed[k] += (before != out).any()
        assert (got[v].width, got[v].height, got[v].sha256) == (96, 120, hashlib.sha256(out.tobytes()).hexdigest())
        assert got[v].quality_score == pytest.approx(px.sharpness(out), abs=1e-3)
    assert all(changed)


def test_level_eyes_come_out_level():
    img = np.zeros((101, 101, 4), np.uint8)
    img[..., 3] = 255
    img[34:38, 28:32] = img[64:68, 70:74] = 255  # a line falling to the right
    angle = np.arctan2(30, 42)
    out = px.crop(img, (0, 0, 101, 101), 101, 101, angle=-angle)
    ys, xs = np.nonzero(out[..., 0] > 100)
    assert ys.max() - ys.min() < 10 and xs.max() - xs.min() > 40


def test_metadata_goes_into_the_files(spark, tmp_path):
    img = picture()
    exif = b"II*\0\x08\0\0\0\0\0"
    pics = spark.createDataFrame([("d/a.png", 160, 120, img.tobytes(), [exif])], IMAGE + ", exif array<binary>")
    faces = face_rows(spark, [("d/a.png", 0, 50.0, 30.0, 50.0, 60.0, 0.75, *EYES)])
    s = settings.Settings()
    s.crop.metadata.custom_tags = {"job": "7"}
    texts = {}
    for mode in ("preserve", "custom", "strip"):
        s.crop.metadata.mode = mode
        out = batch.exports(batch.crops(pics, faces, s), s, output_dir=mode)
        sinks.write_files(out, str(tmp_path))
        texts[mode] = (tmp_path / mode / "a_face1.png").read_bytes()
    at = texts["custom"].index(b"Framewright\0")
    told = json.loads(texts["custom"][at + 12 : texts["custom"].index(b"}", texts["custom"].rindex(b"quality_score")) + 1])
    assert told["job"] == "7" and told["face_confidence"] == 0.75 and told["crop_settings"]["output_width"] == 400 and told["quality"] in ("low", "medium", "high")
    assert sinks.png_exif(texts["preserve"]) == [exif] and not sinks.png_exif(texts["custom"]) and b"tEXt" not in texts["strip"]
    s.crop.output_format, s.crop.metadata.mode = "jpeg", "custom"
    jpeg = batch.exports(batch.crops(pics, faces, s), s).first()
    assert jpeg.path == "a_face1.jpg" and any(b"urn:framewright" in body for _, body in sinks.jpeg_segments(bytes(jpeg.encoded)))


def test_annotated_images(spark):
    img = picture()
    faces = face_rows(spark, [("d/a.png", 0, 50.4, 30.6, 50.0, 300.0, 0.95, *EYES)])
    beside = batch.beside(spark.createDataFrame([("d/a.png", 160, 120, img.tobytes())], IMAGE), faces)
    r = batch.annotated(beside).first()
    points = [(int(EYES[k]), int(EYES[k + 1])) for k in range(0, 10, 2)]
    assert r.path == "a.png" and r.data == px.annotate(img, [(50, 30, 50, 88)], points).tobytes()


@pytest.mark.parametrize("size", [(8, 8), (37, 53), (1, 1), (64, 200)])
def test_jpeg_is_read_by_others(spark, tmp_path, size):
    h, w = size
    y, x = np.mgrid[:h, :w]
    img = np.dstack([(x * 3) % 256, (y * 2 + 40) % 256, (x + y) % 256, np.full((h, w), 255)]).astype(np.uint8)
    errors = []
    for quality in (95, 50, 5):
        (tmp_path / f"{quality}.jpg").write_bytes(sinks.encode_jpeg(img, quality))
    for r in images.read_decoded(spark, str(tmp_path)).orderBy(F.length("path"), F.desc("path")).collect():
        back = np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, 4)
        assert back.shape == img.shape
        errors.append(np.abs(back.astype(int) - img).mean())
    assert len(errors) == 3 and errors[1] < 6 and max(errors) < 40


def test_jpeg_of_noise_and_of_one_colour(spark, tmp_path):
    noise, flat = picture(80, 96), np.full((24, 16, 4), 130, np.uint8)
    (tmp_path / "a.jpg").write_bytes(sinks.encode_jpeg(noise, 100))
    (tmp_path / "b.jpg").write_bytes(sinks.encode_jpeg(flat, 75))
    a, b = (np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, 4) for r in images.read_decoded(spark, str(tmp_path)).orderBy("path").collect())
    assert np.abs(a.astype(int) - noise)[..., :3].mean() < 2 and (np.abs(b[..., :3].astype(int) - 130) <= 1).all()


def test_code_lengths_stay_within_16():
    counts = np.zeros(256, dtype=np.int64)
    counts[:40] = [int(1.6**k) + 1 for k in range(40)]  # Huffman's own tree would be far deeper
    lengths = sinks._code_lengths(counts)
    assert len(lengths) == 40 and max(lengths.values()) == 16 and sum(2.0**-n for n in lengths.values()) < 1


def field(number, value):
    def varint(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    value = value.encode() if isinstance(value, str) else value
    return varint(number << 3 | 2) + varint(len(value)) + value


def model(outputs):
    """An ONNX file whose outputs are constants, whatever the image."""
    graph = b""
    shape = lambda dims: field(1, field(1, 1) + field(2, b"".join(field(1, field(1, d)) for d in dims)))
    for k, o in enumerate(outputs):
        graph += field(1, field(1, f"c{k}") + field(2, f"o{k}") + field(4, "Identity"))
    graph += field(2, "constants")
    for k, o in enumerate(outputs):
        graph += field(5, b"".join(field(1, d) for d in o.shape) + field(2, 1) + field(8, f"c{k}") + field(9, o.astype("<f4").tobytes()))
    graph += field(11, field(1, "image") + field(2, shape((1, 3, 64, 64))))
    for k, o in enumerate(outputs):
        graph += field(12, field(1, f"o{k}") + field(2, shape(o.shape)))
    return field(1, 8) + field(7, graph) + field(8, field(1, "") + field(2, 13))


def test_detection_with_a_model(spark, tmp_path):
    rng = np.random.default_rng(5)
    rows = np.zeros((1, 6, 15), np.float32)
    rows[0, :, :4] = [[10, 10, 20, 20], [11, 11, 20, 20], [40, 40, 10, 10], [5, 50, 8, 8], [0, 0, 0, 5], [30, 5, 6, 6]]
    rows[0, :, 4:14] = rng.uniform(0, 60, (6, 10))
    rows[0, :, 14] = [0.92, 0.97, 0.95, 0.2, 0.99, np.nan]
    (tmp_path / "one.onnx").write_bytes(model([rows]))
    img = picture(32, 128)
    pics = spark.createDataFrame([("a.png", 128, 32, img.tobytes()), ("b.png", 1, 1, None)], IMAGE)
    found = {r.path: r.faces for r in px.detect_faces(pics, str(tmp_path / "one.onnx"), 0.9, 0.3, 10, side=64).collect()}
    assert found["b.png"] == []
    assert [(f.face_idx, f.x, f.y, f.width, f.height) for f in found["a.png"]] == [(0, 22.0, 5.5, 40.0, 10.0), (1, 80.0, 20.0, 20.0, 5.0)]
    # the same rows through the relational operators
    raw = px.detect_images(pics.where("data is not null"), str(tmp_path / "one.onnx"), side=64).select("path", F.posexplode("rows").alias("face_idx", "r"))
    flat = raw.select("path", "face_idx", *[F.col("r")[k].alias(c) for k, c in enumerate(("x", "y", "width", "height"))], F.col("r")[14].alias("score"), F.lit(2.0).cast("float").alias("scale_x"), F.lit(0.5).cast("float").alias("scale_y"))
    same = det.postprocess(flat, 0.9, 0.3, 10, "path").orderBy(F.desc("score")).collect()
    assert [(r.x, r.y, r.width, r.height) for r in same] == [(f.x, f.y, f.width, f.height) for f in found["a.png"]]


def test_heads_in_planes_and_in_rows_give_the_same(spark, tmp_path):
    rng = np.random.default_rng(6)
    flat, planes = [], []
    for n in (1, 1, 4, 10):
        for _, rows, cols in det.stride_cells(64, 64):
            o = rng.normal(size=(1, rows * cols, n)).astype(np.float32)
            flat.append(o)
            planes.append(o.reshape(1, rows, cols, n).transpose(0, 3, 1, 2))
    want = px.head_rows(flat, 64, sigmoid=True)
    assert (px.head_rows(planes, 64, sigmoid=True) == want).all() and len(want) == sum(r * c for _, r, c in det.stride_cells(64, 64))
    half = 1 / (1 + np.exp(-np.concatenate([o.ravel() for o in flat[:3]]).astype(np.float32)))
    other = 1 / (1 + np.exp(-np.concatenate([o.ravel() for o in flat[3:6]]).astype(np.float32)))
    assert want[:, 14] == pytest.approx(np.sqrt(half * other), rel=1e-5)
    (tmp_path / "heads.onnx").write_bytes(model(planes))
    pics = spark.createDataFrame([("a.png", 64, 64, picture(64, 64).tobytes())], IMAGE)
    got = px.detect_images(pics, str(tmp_path / "heads.onnx"), side=64, sigmoid=True).first().rows
    assert np.array(got, np.float32) == pytest.approx(want)
    with pytest.raises(ValueError):
        px.head_rows(flat[:5], 64)


def test_numpy_and_relational_postprocess_agree(spark):
    rng = np.random.default_rng(7)
    rows = np.zeros((300, 15), np.float32)
    rows[:, :2], rows[:, 2:4], rows[:, 14] = rng.uniform(0, 300, (300, 2)), rng.uniform(1, 60, (300, 2)), rng.permutation(300) / 300
    kept = det.postprocess_rows(rows, 1.5, 0.75, 0.3, 0.3, 200)
    df = spark.createDataFrame([("a", i, *map(float, r[:4]), float(r[14]), 1.5, 0.75) for i, r in enumerate(rows)], "path string, face_idx long, x float, y float, width float, height float, score float, scale_x float, scale_y float")
    same = det.postprocess(df, 0.3, 0.3, 200, "path").orderBy(F.desc("score")).collect()
    assert [(r.x, r.y, r.width, r.height, r.score) for r in same] == [tuple(map(float, (*r[:4], r[14]))) for r in kept] and 20 < len(same) < 200


def test_frame_loop(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    for k in range(5):
        (src / f"f{k}.png").write_bytes(sinks.encode_png(picture(60, 80, seed=k)) if k != 2 else b"broken")
    s = settings.Settings()
    s.crop.output_width = s.crop.output_height = 32
    s.crop.quality_rules.quality_suffix = True
    two = "array(named_struct('face_idx', 0L, 'x', 10f, 'y', 10f, 'width', 30f, 'height', 30f, 'score', 0.9f, 'landmarks', array(named_struct('x', 15f, 'y', 20f))), named_struct('face_idx', 1L, 'x', 40f, 'y', 20f, 'width', 20f, 'height', 20f, 'score', 0.8f, 'landmarks', array(named_struct('x', 15f, 'y', 20f))))"
    each = frames.job(s, lambda df: df.withColumn("faces", F.expr(f"CASE WHEN path LIKE '%f1.png' THEN filter({two}, x -> false) ELSE {two} END")), str(tmp_path / "out"), str(tmp_path / "state"), annotated_dir="marked")
    for _ in range(2):
        frames.run(frames.folder_stream(spark, str(src), 2), lambda df, n: each(frames.decoded(df), n), str(tmp_path / "cp")).awaitTermination(120)
    names = sorted(os.listdir(tmp_path / "out"))
    assert names[0] == "marked" and len(names) == 1 + 2 * 3
    assert {n.split("_")[1] for n in names[1:]} <= {f"frame{k:06d}" for k in range(1, 5)} and len({n.split("_")[1] for n in names[1:]}) == 3
    assert all(n.endswith("_highq.png") or n.endswith("_medq.png") or n.endswith("_lowq.png") for n in names[1:])
    assert sorted(os.listdir(tmp_path / "out" / "marked")) == [f"frame_{k:06d}.png" for k in range(1, 5)]
    last = spark.read.parquet(str(tmp_path / "state")).orderBy(F.desc("batch")).first()
    assert (last.frame_count, last.total_faces) == (4, 6)
    assert images.decode_png((tmp_path / "out" / names[1]).read_bytes()).shape == (32, 32, 4) and struct.calcsize("I") == 4
