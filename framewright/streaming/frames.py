"""Frame streams: numbering, per-frame crops and totals, on Structured Streaming or on batches."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import naming
from ..operators import policy
from ..operators.ranks import with_ranks
from ..plans import batch
from ..sources.images import GLOB, decode_png
from ..sources.settings import Settings
from ..sources.sinks import encode_images, write_files


def folder_stream(spark: SparkSession, path: str, per_trigger: int = 64) -> DataFrame:
    """Frames that appear as image files in a folder, at most so many per micro-batch."""
    return (
        spark.readStream.format("binaryFile")
        .schema("path string, modificationTime timestamp, length bigint, content binary")
        .option("maxFilesPerTrigger", per_trigger)
        .option("pathGlobFilter", GLOB)
        .load(path)
    )


def numbered(frames: DataFrame, start: int = 0, limit: int = 0) -> DataFrame:
    """Captured frames numbered from ``start`` + 1 in order; failed captures take no number; at most ``limit`` (0: all).

    No task has to sort all frames of a long recording.
    """
    out = with_ranks(frames.where("captured"), "frame_id", "frame_no").withColumn("frame_no", F.col("frame_no") + start)
    return out.where(F.col("frame_no") <= start + limit) if limit else out


def frame_name(frame_no: Column, face_idx: Column, ext: str = "png") -> Column:
    """Six digits at least; later frames take as many as they need."""
    return F.format_string(f"webcam_frame%06d_face%d.{ext}", frame_no.cast("long"), (face_idx + 1).cast("long"))


def frame_crops(faces: DataFrame, minimum: str | None = None, ext: str = "png", suffix: bool = True) -> DataFrame:
    """Crops of numbered frames with names, without those below the minimum; no choice of faces as in batches."""
    named = naming.suffixed(frame_name(F.col("frame_no"), F.col("face_idx"), ext), F.coalesce(policy.quality_suffix(F.col("quality")), F.lit("")) if suffix else F.lit(""))
    return faces.where(~policy.should_skip(F.col("quality"), F.lit(minimum))).withColumn("file_name", named)


def decoded(files: DataFrame) -> DataFrame:
    """Files (path, content) as frames: path, captured, width, height, data; what cannot be read is not captured."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for content in batch.column(1).to_pylist():
                try:
                    made.append(decode_png(content))
                except (ValueError, TypeError, IndexError, struct.error, zlib.error):
                    made.append(None)
            columns = [pa.array([None if m is None else f(m) for m in made], t) for f, t in ((lambda m: m.shape[1], pa.int32()), (lambda m: m.shape[0], pa.int32()), (lambda m: m.tobytes(), pa.binary()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([m is not None for m in made]), *columns], names=["path", "captured", "width", "height", "data"])

    return files.select("path", "content").mapInArrow(run, "path string, captured boolean, width int, height int, data binary")


def job(settings: Settings, detect: Callable[[DataFrame], DataFrame], root: str, state: str, annotated_dir: str | None = None) -> Callable[[DataFrame, int], None]:
    """What :func:`run` does with each micro-batch of frames (path, captured, width, height, data).

    ``detect`` adds the array column faces.  Crops are cut, enhanced, scored, skipped below the least
    quality, masked, named by frame and face, and written below ``root``; whole frames with their faces
    drawn in go to ``annotated_dir`` there.  Frames are numbered on through all batches in order of their
    paths; how many came before is a table in the shared folder ``state``, one row for each batch, so a
    batch that is repeated gives its frames the same numbers and replaces its files.
    """

    def each(frames_: DataFrame, batch_id: int) -> None:
        spark = frames_.sparkSession
        before = spark.read.parquet(f"{state}/batch={batch_id - 1}").first() if batch_id else None
        start, faces_before = (before["frame_count"], before["total_faces"]) if before else (0, 0)
        # a micro-batch is bounded, so one task may put its names in order; pixels stay where they are
        order = frames_.where("captured").select("path").withColumn("frame_no", F.row_number().over(Window.orderBy("path")) + start)
        found = detect(frames_.where("captured")).join(F.broadcast(order), "path").persist()
        seen = found.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("faces")), F.lit(0)).alias("faces")).first()
        named = found.withColumn("path", F.col("frame_no").cast("string"))
        made = batch.crops(named, None, settings).withColumn("frame_no", F.col("path").cast("long"))
        rules = settings.crop.quality_rules
        kept = frame_crops(made, rules.min_quality, batch.extension(settings), rules.quality_suffix)
        write_files(batch.encoded(kept.withColumn("path", F.col("file_name")), settings), root)
        if annotated_dir is not None:
            drawn = batch.annotated(found.withColumn("path", F.format_string("frame_%06d.png", F.col("frame_no"))))
            write_files(encode_images(drawn.withColumn("path", F.concat(F.lit(f"{annotated_dir}/"), "path")), "png"), root)
        found.unpersist()
        count = spark.range(1).select(F.lit(start + seen["n"]).cast("long").alias("frame_count"), F.lit(faces_before + seen["faces"]).cast("long").alias("total_faces"))
        count.write.mode("overwrite").parquet(f"{state}/batch={batch_id}")

    return each


def totals(frames: DataFrame) -> DataFrame:
    """Frames captured and faces found; works on batches, and on streams in complete mode."""
    return frames.agg(F.count_if(F.col("captured")).alias("frame_count"), F.coalesce(F.sum(F.when(F.col("captured"), F.col("faces"))), F.lit(0)).cast("long").alias("total_faces"))


def run(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True) -> StreamingQuery:
    """Hand each micro-batch to ``each``; ``once`` stops when all that is there has been taken.

    A batch that is repeated after a failure has the same number, so writers can replace what they wrote.
    """
    writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
