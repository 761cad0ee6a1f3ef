import numpy as np
from pyspark.sql import functions as F

from framewright.sources import sinks
from framewright.streaming import frames


def test_folder_stream_counts_frames(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    for k in range(5):
        (src / f"{k}.png").write_bytes(sinks.encode_png(np.full((2, 2, 4), k, np.uint8)))
    (src / "note.txt").write_text("x")
    seen = []
    for _ in range(2):  # the second run finds nothing new
        q = frames.run(frames.folder_stream(spark, str(src), 2), lambda df, n: seen.append(df.count()), str(tmp_path / "cp"))
        q.awaitTermination(60)
    assert sum(seen) == 5 and max(seen) <= 2


def test_totals_on_a_stream(spark, tmp_path):
    spark.createDataFrame([(1, True, 2), (2, False, 9), (3, True, 1)], "frame_id long, captured boolean, faces long").write.parquet(str(tmp_path / "f"))
    stream = spark.readStream.schema("frame_id long, captured boolean, faces long").parquet(str(tmp_path / "f"))
    q = frames.totals(stream).writeStream.outputMode("complete").format("memory").queryName("frame_totals").start()
    q.processAllAvailable()
    q.stop()
    assert tuple(spark.table("frame_totals").first()) == (2, 3)


def test_numbers_skip_failed_captures(spark):
    rows = [(k * 40000, k % 3 != 0) for k in range(9)]
    df = spark.createDataFrame(rows, "frame_id long, captured boolean")
    got = {r.frame_id: r.frame_no for r in frames.numbered(df).collect()}
    assert got == {f: n for n, f in enumerate([f for f, ok in rows if ok], 1)}
    assert frames.numbered(df, limit=2).count() == 2


def test_crop_names(spark):
    df = spark.createDataFrame([(7, 0, "High"), (7, 1, "Low")], "frame_no long, face_idx long, quality string")
    assert [r.file_name for r in frames.frame_crops(df, "Medium").collect()] == ["webcam_frame000007_face1_highq.png"]
    assert frames.frame_crops(df).where(F.col("file_name") == "webcam_frame000007_face2_lowq.png").count() == 1
