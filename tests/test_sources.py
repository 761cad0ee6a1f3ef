import json
import os
import sqlite3
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from framewright.operators import pixels
from framewright.plans import batch
from framewright.sources import images, mapping, settings, sinks, tables


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_csv(spark, tmp_path):
    p = tmp_path / "m.csv"
    p.write_text("source,,output\n a.jpg , x,out-a\n,,\nb.jpg,y,out-b\n")
    df = mapping.read_csv(spark, str(p))
    assert df.columns == ["source", "Column 2", "output"] and sorted(rows(df)) == [("a.jpg", "x", "out-a"), ("b.jpg", "y", "out-b")]
    assert mapping.read_csv(spark, str(p), header=False).columns == ["Column 1", "Column 2", "Column 3"]
    (tmp_path / "p.csv").write_text("source|output\na|b\n")
    assert rows(mapping.read_csv(spark, str(tmp_path / "p.csv"), delimiter="|")) == [("a", "b")]
    (tmp_path / "bad.csv").write_text("a,b\n1,2,3\n")
    with pytest.raises(Exception):
        mapping.read_csv(spark, str(tmp_path / "bad.csv")).collect()


def test_parquet_and_preview(spark, tmp_path):
    spark.createDataFrame([("a", 1, b"\xde\xad"), (None, None, None), ("c", 3, b"")], "s string, n int, b binary").write.parquet(str(tmp_path / "t.parquet"))
    df = mapping.read_mapping(spark, str(tmp_path / "t.parquet"))
    assert sorted(rows(df)) == [("a", "1", "3q0="), ("c", "3", "")]
    shown, total, cut = mapping.preview(df, 1)
    assert (shown.count(), total, cut) == (1, 2, True)


def test_sqlite(spark, tmp_path):
    p = str(tmp_path / "m.db")
    with sqlite3.connect(p) as db:
        db.execute("CREATE TABLE queue (source TEXT, output TEXT, raw BLOB)")
        db.execute("CREATE TABLE Photos (source TEXT, output TEXT)")
        db.executemany("INSERT INTO queue VALUES (?, ?, ?)", [(" a ", "b", b"\xde\xad\xbe\xef"), (None, None, None), ("c", "d", None)])
        db.execute("INSERT INTO Photos VALUES ('p', 'q')")
    assert mapping.catalog(p) == ["Photos", "queue"]
    assert rows(mapping.read_mapping(spark, p)) == [("p", "q")]
    assert sorted(rows(mapping.read_sqlite(spark, p, table="queue"))) == [("a", "b", "3q2+7w=="), ("c", "d", "")]
    assert rows(mapping.read_sqlite(spark, p, query="SELECT output FROM queue WHERE source = 'c'")) == [("d",)]
    with pytest.raises(ValueError):
        mapping.read_sqlite(spark, p, query="DELETE FROM queue")
    reader = tables.SqliteReader(p, 'SELECT * FROM "queue"', "queue", 2)
    assert sum(len(list(reader.read(x))) for x in reader.partitions()) == 3


def test_workbook(spark, tmp_path):
    p = str(tmp_path / "m.xlsx")
    main, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(p, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="One" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}"><si><t>source</t></si><si><t> a.jpg </t></si></sst>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{main}"><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1" t="str"><v>n</v></c></row><row><c r="A2" t="s"><v>1</v></c><c r="B2" t="b"><v>1</v></c><c r="C2"><v>5.0</v></c></row><row><c r="C3"><v>2.5</v></c></row></sheetData></worksheet>')
    assert mapping.catalog(p) == ["One"]
    df = mapping.read_mapping(spark, p)
    assert df.columns == ["source", "Column 2", "n"] and rows(df) == [("a.jpg", "true", "5"), ("", "", "2.5")]


def test_selectors(spark):
    assert [mapping.parse_selector(x) for x in ("#3", " 3 ", "name")] == [3, 3, "name"]
    for bad in ("", "#", "#x"):
        with pytest.raises(ValueError):
            mapping.parse_selector(bad)
    assert mapping.resolve_column(["A", "a"], "a") == "A"
    with pytest.raises(ValueError, match="out of range"):
        mapping.resolve_column(["A"], 1)
    with pytest.raises(ValueError, match="not found"):
        mapping.resolve_column(["A"], "b")
    df = spark.createDataFrame([(" a ", "x"), ("", "y"), ("b", " ")], "s string, o string")
    assert rows(mapping.entries(df, "S", "1")) == [("a", "x")]


def test_paths_stay_inside(spark):
    df = spark.createDataFrame([(x,) for x in ("a/../b", "../b", "/b", "./b", "a/../../b")], "p string")
    assert [r[0] for r in df.select(mapping.normal_path(F.col("p"))).collect()] == ["b", None, None, "b", None]


def test_lookup_takes_the_first_entry(spark):
    queue = spark.createDataFrame([("d/x.png",), ("y",), ("z.jpg",)], "path string")
    entries = spark.createDataFrame([(2, "x.png", "late"), (1, "x", "first"), (3, "y", "why")], "entry_no int, source_path string, output_name string")
    assert {r.path: r.output_name for r in mapping.lookup(queue, entries).collect()} == {"d/x.png": "first", "y": "why", "z.jpg": None}


def test_settings_round_trip(tmp_path):
    p = str(tmp_path / "s.json")
    with open(p, "w") as f:
        json.dump({"detection": {"score_threshold": 7, "nms_threshold": 0.2}, "crop": {"output_width": 0, "face_height_pct": 300, "shape": {"kind": "star", "sides": 1}}, "enhance": {"preset": "x", "contrast": 1.5}, "unknown": 1}, f)
    s = settings.load(p)
    assert (s.detection.score_threshold, s.detection.nms_threshold, s.detection.top_k) == (1.0, 0.2, 5000)
    assert (s.crop.output_width, s.crop.face_height_pct, s.crop.shape.sides, s.enhance.contrast) == (512, 100.0, 3, 1.5)
    settings.save(s, p)
    assert settings.load(p) == s
    o = settings.apply_options(s, {"nms_threshold": 0.5, "skip_low_quality": True, "min_quality": "High"})
    assert (o.detection.nms_threshold, o.crop.face_height_pct, o.crop.quality_rules.min_quality) == (0.5, 70.0, "Medium")
    assert settings.enhancement_from_options({}) is None and settings.enhancement_from_options({"enhance": True, "preset": "vivid", "brightness": 3}).brightness == 3
    assert settings.parse_tags(["b=1", " a = x=y ", "=z", "b=2"]) == {"a": "x=y", "b": "2"}


def image(h=12, w=9, seed=0):
    return np.random.default_rng(seed).integers(0, 256, (h, w, 4), dtype=np.uint8)


def test_png_round_trip_and_metadata():
    img = image()
    for level in sinks.PNG_LEVELS:
        assert (images.decode_png(sinks.encode_png(img, level)) == img).all()
    png = sinks.with_png_metadata(sinks.encode_png(img), '{"a":1}', [b"exif-bytes"])
    assert sinks.png_exif(png) == [b"exif-bytes"] and b'Framewright\0{"a":1}' in png and (images.decode_png(png) == img).all()
    jpeg = sinks.with_jpeg_metadata(b"\xff\xd8\xff\xda", "{}", [b"x" * 70000, b"MM"])
    assert [m for m, _ in sinks.jpeg_segments(jpeg)] == [0xE1, 0xE1]
    tiff = b"II*\0\x08\0\0\0\x01\0" + b"\x12\x01\x03\0\x01\0\0\0\x06\0\0\0" + b"\0\0\0\0"
    turned = sinks.with_jpeg_metadata(b"\xff\xd8\xff\xda", None, [tiff])
    assert images.jpeg_orientation(turned) == 1 and images.exif_orientation(tiff) == 6
    with pytest.raises(ValueError):
        sinks.encode(img, "webp")


def test_spark_reads_what_is_written(spark, tmp_path):
    img = image()
    img[..., 3] = 255
    for kind in ("png", "bmp"):
        d = tmp_path / kind
        d.mkdir()
        (d / f"a.{kind}").write_bytes(sinks.encode(img, kind))
        got = images.read_decoded(spark, str(d)).first()
        assert (np.frombuffer(got.data, dtype=np.uint8).reshape(12, 9, 4) == img).all()
    assert images.read_oriented(spark, str(tmp_path)).count() == 2
    (tmp_path / "png" / "b.TXT").write_text("no image")
    assert [os.path.basename(r.path) for r in images.targets(spark, str(tmp_path)).select("path").collect()] == ["a.bmp", "a.png"]
    with pytest.raises(Exception):
        images.targets(spark, str(tmp_path / "none"))


def test_orientation():
    img = image(4, 6)
    assert images.orient(img, 1) is not None and (images.orient(images.orient(img, 6), 8) == img).all()
    assert (images.orient(img, 3) == img[::-1, ::-1]).all() and images.orient(img, 5).shape == (6, 4, 4)
    tiff = b"II*\0\x08\0\0\0\x01\0" + b"\x12\x01\x03\0\x01\0\0\0\x06\0\0\0" + b"\0\0\0\0"
    assert images.exif_orientation(tiff) == 6 and images.jpeg_orientation(b"\xff\xd8\xff\xda") == 1


def test_batch_job_end_to_end(spark, tmp_path):
    img = np.full((512, 512, 4), 40, dtype=np.uint8)
    img[..., 3] = 255
    checks = ((np.arange(140)[:, None] // 4 + np.arange(160)[None, :] // 4) % 2 * 200 + 30).astype(np.uint8)
    img[140:280, 160:320, :3] = checks[..., None]
    pics = spark.createDataFrame([("in/work.png", 512, 512, img.tobytes())], "path string, width int, height int, data binary")
    raw = spark.createDataFrame(
        [("in/work.png", 0, 160.0, 140.0, 160.0, 140.0, 0.94, 1.0, 1.0), ("in/work.png", 1, 40.0, 320.0, 100.0, 100.0, 0.92, 1.0, 1.0), ("in/work.png", 2, 42.0, 322.0, 100.0, 100.0, 0.91, 1.0, 1.0)],
        "path string, face_idx long, x float, y float, width float, height float, score float, scale_x float, scale_y float",
    )
    s = settings.Settings()
    s.crop.quality_rules.auto_select_best_face = True
    faces = batch.detect(raw, s)
    made = batch.crops(pics, faces, s)
    assert {r.face_idx: r.quality for r in made.collect()} == {0: "High", 1: "Low"}
    out = batch.exports(made, s, output_dir="crops")
    sinks.write_files(out, str(tmp_path))
    written = tmp_path / "crops" / "work_face1.png"
    assert images.decode_png(written.read_bytes()).shape == (400, 400, 4) and os.listdir(tmp_path / "crops") == ["work_face1.png"]


def test_detection_records(spark, tmp_path):
    faces = spark.createDataFrame([("a", 1, 0.5, None), ("a", 0, 0.9, "High")], "image string, face_idx int, score double, quality string")
    assert json.loads(sinks.detection_json(faces).first().record) == {"image": "a", "detections": [{"score": 0.9, "quality": "High"}, {"score": 0.5}]}
    sinks.write_detections(faces, str(tmp_path / "o"))
    with pytest.raises(ValueError):
        sinks.write_detections(faces.where("false"), str(tmp_path / "o2"))
    assert pixels.PRESETS["vivid"].brightness == 10
