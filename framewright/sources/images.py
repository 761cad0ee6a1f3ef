"""Image files as rows: scanning folders, decoding, orientation."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import naming
from ..operators.staging import scratch

GLOB = "*.{" + ",".join("".join(f"[{c.lower()}{c.upper()}]" for c in e) for e in naming.IMAGE_EXTENSIONS) + "}"


def scan(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """Image files below a folder, sorted part by part of their paths; contents are read only if selected."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).option("pathGlobFilter", GLOB).load(path)
    return found.orderBy(naming.path_key(F.col("path")))


def targets(spark: SparkSession, path: str) -> DataFrame:
    """As :func:`scan`; an error where nothing is found."""
    found = scan(spark, path)
    if found.select("path").isEmpty():
        raise ValueError(f"no images in {path}")
    return found


def read_with_errors(spark: SparkSession, path: str) -> DataFrame:
    """Every image file as path, error, width, height, data in RGBA; a file that the JVM cannot decode is a row with an error and nulls.

    The JVM decodes png, jpeg, bmp, gif and tiff.  Files of no bytes are no rows: Spark does not read them.
    """
    raw = spark.read.format("image").option("dropInvalid", "false").option("recursiveFileLookup", "true").option("pathGlobFilter", GLOB).load(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            path_, w, h, n, d = (batch.column(i).to_pylist() for i in range(5))
            fine = [a > 0 and b > 0 and x is not None and len(x) == a * b * c for a, b, c, x in zip(w, h, n, d)]
            data = [to_rgba(np.frombuffer(x, dtype=np.uint8).reshape(b, a, c)).tobytes() if ok else None for ok, a, b, c, x in zip(fine, w, h, n, d)]
            sizes = [pa.array([v if ok else None for ok, v in zip(fine, side)], pa.int32()) for side in (w, h)]
            errors = pa.array([None if ok else "cannot be decoded" for ok in fine], pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(path_), errors, *sizes, pa.array(data, pa.binary())], names=["path", "error", "width", "height", "data"])

    return raw.select("image.origin", "image.width", "image.height", "image.nChannels", "image.data").mapInArrow(run, "path string, error string, width int, height int, data binary")


def read_decoded(spark: SparkSession, path: str) -> DataFrame:
    """The files of :func:`read_with_errors` that can be decoded, as path, width, height, data."""
    return read_with_errors(spark, path).where("error IS NULL").drop("error")


def failures(read: DataFrame) -> DataFrame:
    """What a run logs of images that failed: path and error; the job goes on without them."""
    return read.where("error IS NOT NULL").select("path", "error")


def read_oriented(spark: SparkSession, path: str, broadcast_tags: int = 100_000) -> DataFrame:
    """As :func:`read_decoded`, turned as each file's orientation tag says.

    Few tags that turn anything, whose number is checked, are broadcast, so that pixels stay where they are.
    """

    def tags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([jpeg_orientation(x) for x in batch.column(1).to_pylist()], pa.int32())], names=["path", "tag"])

    plain = F.regexp_replace("path", "^file:/+", "/").alias("path")
    jpegs = scan(spark, path).where(F.lower("path").rlike(r"\.jpe?g$")).select("path", "content").mapInArrow(tags, "path string, tag int").where("tag > 1").select(plain, "tag")
    with scratch(spark) as result:
        jpegs = result(jpegs, "image-tags")  # each file's head is read once
    few = jpegs.limit(broadcast_tags + 1).count() <= broadcast_tags
    decoded = read_decoded(spark, path).withColumn("path", plain).join(F.broadcast(jpegs) if few else jpegs, "path", "left")

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [orient(np.frombuffer(d, dtype=np.uint8).reshape(h, w, 4), t or 1) for w, h, d, t in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3, 4)))]
            sizes = [pa.array([m.shape[k] for m in made], pa.int32()) for k in (1, 0)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *sizes, pa.array([m.tobytes() for m in made], pa.binary())], names=["path", "width", "height", "data"])

    return decoded.select("path", "width", "height", "data", "tag").mapInArrow(turn, "path string, width int, height int, data binary")


def to_rgba(img: np.ndarray) -> np.ndarray:
    """From one, three (BGR) or four (BGRA) channels."""
    h, w, n = img.shape
    out = np.full((h, w, 4), 255, dtype=np.uint8)
    if n == 1:
        out[..., :3] = img
    else:
        out[..., :3] = img[..., 2::-1]
        if n == 4:
            out[..., 3] = img[..., 3]
    return out


def orient(img: np.ndarray, tag: int) -> np.ndarray:
    """The image as its orientation tag (1 to 8) says it is to be shown."""
    if tag in (5, 6, 7, 8):
        img = img.transpose(1, 0, 2)
    flips = {2: (1,), 3: (0, 1), 4: (0,), 6: (1,), 7: (0, 1), 8: (0,)}.get(tag, ())
    return np.ascontiguousarray(np.flip(img, flips) if flips else img)


def jpeg_orientation(data: bytes) -> int:
    """The orientation tag of a JPEG's Exif segment; 1 without one."""
    at = 2
    while at + 4 <= len(data) and data[at] == 0xFF:
        marker, size = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
        if marker == 0xE1 and data[at + 4 : at + 10] == b"Exif\0\0":
            return exif_orientation(data[at + 10 : at + 2 + size])
        if marker == 0xDA:
            break
        at += 2 + size
    return 1


def exif_orientation(tiff: bytes) -> int:
    order = {b"II": "<", b"MM": ">"}.get(tiff[:2])
    if order is None or len(tiff) < 8:
        return 1
    at = struct.unpack_from(f"{order}I", tiff, 4)[0]
    if at + 2 > len(tiff):
        return 1
    for k in range(struct.unpack_from(f"{order}H", tiff, at)[0]):
        entry = at + 2 + 12 * k
        if entry + 12 > len(tiff):
            break
        tag, kind = struct.unpack_from(f"{order}HH", tiff, entry)
        if tag == 0x0112 and kind == 3:
            value = struct.unpack_from(f"{order}H", tiff, entry + 8)[0]
            return value if 1 <= value <= 8 else 1
    return 1


def decode_png(data: bytes) -> np.ndarray:
    """8-bit grey, RGB, palette-free PNGs, with or without alpha, not interlaced, as RGBA."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG file")
    at, head, packed = 8, None, b""
    while at < len(data):
        size, kind = int.from_bytes(data[at : at + 4], "big"), data[at + 4 : at + 8]
        body = data[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            packed += body
        at += 12 + size
    w, h, depth, color, _, _, interlaced = head
    n = {0: 1, 2: 3, 4: 2, 6: 4}.get(color)
    if depth != 8 or n is None or interlaced:
        raise ValueError("unsupported PNG layout")
    raw = np.frombuffer(zlib.decompress(packed), dtype=np.uint8).reshape(h, 1 + w * n)
    rows = np.zeros((h + 1, w * n), dtype=np.int32)
    for y in range(h):
        kind, line, up = raw[y, 0], raw[y, 1:].astype(np.int32), rows[y]
        if kind == 0:
            rows[y + 1] = line
        elif kind == 2:
            rows[y + 1] = (line + up) & 255
        elif kind == 1:
            rows[y + 1] = np.cumsum(line.reshape(-1, n), axis=0).reshape(-1) & 255
        else:
            out = rows[y + 1]
            for x in range(w * n):
                left, corner = (out[x - n], up[x - n]) if x >= n else (0, 0)
                if kind == 3:
                    guess = (left + up[x]) // 2
                else:
                    p = left + up[x] - corner
                    near = [(abs(p - left), 0, left), (abs(p - up[x]), 1, up[x]), (abs(p - corner), 2, corner)]
                    guess = min(near)[2]
                out[x] = (line[x] + guess) & 255
    img = rows[1:].astype(np.uint8).reshape(h, w, n)
    out = np.full((h, w, 4), 255, dtype=np.uint8)
    out[..., :3] = img[..., :3] if n >= 3 else img[..., :1]
    if n in (2, 4):
        out[..., 3] = img[..., -1]
    return out
