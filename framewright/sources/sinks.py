"""Encoding, metadata and writing of crops and records."""

from __future__ import annotations

import base64
import heapq
import os
import struct
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceWriter, WriterCommitMessage

from .. import __version__

GENERATOR = "framewright"
PNG_LEVELS = {"fast": 1, "default": 6, "best": 9}
PNG_SIGNATURE = b"\x89PNG\r\n\x1a\n"


def png_chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode_png(img: np.ndarray, compression: str = "default") -> bytes:
    h, w = img.shape[:2]
    lines = np.zeros((h, 1 + 4 * w), dtype=np.uint8)
    lines[:, 1:] = img.reshape(h, 4 * w)
    head = struct.pack(">IIBBBBB", w, h, 8, 6, 0, 0, 0)
    return PNG_SIGNATURE + png_chunk(b"IHDR", head) + png_chunk(b"IDAT", zlib.compress(lines.tobytes(), PNG_LEVELS.get(compression, 6))) + png_chunk(b"IEND", b"")


def encode_bmp(img: np.ndarray) -> bytes:
    h, w = img.shape[:2]
    row = -(-3 * w // 4) * 4
    body = np.zeros((h, row), dtype=np.uint8)
    body[:, : 3 * w] = img[::-1, :, 2::-1].reshape(h, 3 * w)
    size = 54 + body.size
    return b"BM" + struct.pack("<IHHI", size, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 24, 0, body.size, 2835, 2835, 0, 0) + body.tobytes()


def encode_tiff(img: np.ndarray) -> bytes:
    """One uncompressed strip of RGBA."""
    h, w = img.shape[:2]
    data = np.ascontiguousarray(img).tobytes()
    at = 8 + len(data)
    extra = at + 2 + 12 * 11 + 4
    entries = [
        (256, 4, 1, w), (257, 4, 1, h), (258, 3, 4, extra), (259, 3, 1, 1), (262, 3, 1, 2), (273, 4, 1, 8),
        (277, 3, 1, 4), (278, 4, 1, h), (279, 4, 1, len(data)), (284, 3, 1, 1), (338, 3, 1, 2),
    ]
    ifd = struct.pack("<H", len(entries)) + b"".join(struct.pack("<HHII", *e) for e in entries) + struct.pack("<I", 0)
    return b"II*\0" + struct.pack("<I", at) + data + ifd + struct.pack("<4H", 8, 8, 8, 8)


# Quantisation steps of light and of colour at quality 50, row by row (fixed values).
LIGHT_STEPS = [
    16, 11, 10, 16, 24, 40, 51, 61, 12, 12, 14, 19, 26, 58, 60, 55, 14, 13, 16, 24, 40, 57, 69, 56, 14, 17, 22, 29, 51, 87, 80, 62,
    18, 22, 37, 56, 68, 109, 103, 77, 24, 35, 55, 64, 81, 104, 113, 92, 49, 64, 78, 87, 103, 121, 120, 101, 72, 92, 95, 98, 112, 100, 103, 99,
]
COLOR_STEPS = [
    17, 18, 24, 47, 99, 99, 99, 99, 18, 21, 26, 66, 99, 99, 99, 99, 24, 26, 56, 99, 99, 99, 99, 99, 47, 66, 99, 99, 99, 99, 99, 99,
    99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99,
]
ZIGZAG = np.array(sorted(range(64), key=lambda k: (k // 8 + k % 8, k % 8 if (k // 8 + k % 8) % 2 == 0 else k // 8)))


def _code_lengths(counts: np.ndarray) -> dict[int, int]:
    """Code length of each symbol that occurs: Huffman's, but at most 16, and no code of ones only."""
    heap = [(int(counts[s]), int(s), (int(s),)) for s in np.flatnonzero(counts)] + [(0, 256, (256,))]  # 256 takes the code of ones
    heapq.heapify(heap)
    depth = dict.fromkeys([s for _, _, (s,) in heap], 0)
    while len(heap) > 1:
        (n, s, one), (m, t, two) = heapq.heappop(heap), heapq.heappop(heap)
        for x in one + two:
            depth[x] += 1
        heapq.heappush(heap, (n + m, max(s, t), one + two))
    sizes = Counter(depth.values())
    for size in range(max(sizes), 16, -1):
        while sizes[size]:  # a pair of leaves moves up, and a shorter leaf makes room for one of them
            short = max(k for k in range(1, size - 1) if sizes[k])
            sizes[size] -= 2
            sizes[size - 1] += 1
            sizes[short] -= 1
            sizes[short + 1] += 2
    sizes[max(k for k in sizes if sizes[k])] -= 1
    order = sorted((x for x in depth if x != 256), key=lambda x: (depth[x], x))
    lengths = [k for k in sorted(sizes) for _ in range(sizes[k])]
    return dict(zip(order, lengths))


def _huffman(symbols: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The table as a segment's body without its class, and code and length by symbol."""
    lengths = _code_lengths(np.bincount(symbols, minlength=256))
    codes, sizes = np.zeros(256, dtype=np.int64), np.zeros(256, dtype=np.int64)
    code = last = 0
    for s, n in lengths.items():
        code <<= n - last
        codes[s], sizes[s], last = code, n, n
        code += 1
    per_size = [sum(n == k for n in lengths.values()) for k in range(1, 17)]
    return bytes(per_size) + bytes(lengths), codes, sizes


def _scan(blocks: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """Tables for first and for other coefficients, and the coded bits, of quantised blocks (n, 64) in zigzag order."""
    first = np.diff(blocks[:, 0], prepend=0)
    block, at = np.nonzero(blocks[:, 1:])
    at = at + 1
    value = blocks[block, at]
    same = np.concatenate([[False], block[1:] == block[:-1]]) if len(block) else np.zeros(0, dtype=bool)
    run = at - np.where(same, np.concatenate([[0], at[:-1]]), 0) - 1
    size = lambda v: np.ceil(np.log2(np.abs(v) + 1)).astype(np.int64)
    extra = lambda v, n: np.where(v < 0, v + (1 << n) - 1, v)
    long = np.repeat(np.arange(len(at)), run // 16)  # runs of 16 zeros
    last = np.zeros(len(blocks), dtype=np.int64)
    np.maximum.at(last, block, at)
    ends = np.flatnonzero(last < 63)
    n0, n1 = size(first), size(value)
    zeros = lambda n: np.zeros(n, dtype=np.int64)
    parts = [  # place, symbol, extra bits, how many
        (np.arange(len(blocks)) * 256, n0, extra(first, n0), n0),
        (block[long] * 256 + at[long] * 3 + 1, zeros(len(long)) + 0xF0, zeros(len(long)), zeros(len(long))),
        (block * 256 + at * 3 + 2, (run % 16) << 4 | n1, extra(value, n1), n1),
        (ends * 256 + 255, zeros(len(ends)), zeros(len(ends)), zeros(len(ends))),
    ]
    tables = [_huffman(parts[0][1]), _huffman(np.concatenate([p[1] for p in parts[1:]]))]
    coded = [(place, tables[k > 0][1][s] << n | bits, tables[k > 0][2][s] + n) for k, (place, s, bits, n) in enumerate(parts)]
    place, code, width = (np.concatenate([c[k] for c in coded]) for k in range(3))
    order = np.argsort(place, kind="stable")
    code, width = code[order], width[order]
    stop = np.cumsum(width)
    bits = (np.repeat(code, width) >> (np.repeat(stop, width) - 1 - np.arange(stop[-1]))) & 1
    bits = np.concatenate([bits, np.ones(-len(bits) % 8, dtype=np.int64)]).astype(np.uint8)
    return tables[0][0], tables[1][0], np.packbits(bits).tobytes().replace(b"\xff", b"\xff\0")


def encode_jpeg(img: np.ndarray, quality: int = 90) -> bytes:
    """Baseline, one scan for each of light and two colours at full size, tables made for the image; alpha is left out."""
    h, w = img.shape[:2]
    q = min(max(int(quality), 1), 100)
    scale = 5000 // q if q < 50 else 200 - 2 * q
    steps = [np.clip((np.array(t) * scale + 50) // 100, 1, 255) for t in (LIGHT_STEPS, COLOR_STEPS)]
    r, g, b = np.moveaxis(np.pad(img[..., :3], ((0, -h % 8), (0, -w % 8), (0, 0)), mode="edge").astype(np.float64), 2, 0)
    light = 0.299 * r + 0.587 * g + 0.114 * b
    planes = [light - 128, (b - light) / 1.772, (r - light) / 1.402]
    k = np.arange(8)
    turn = np.cos((2 * k[None, :] + 1) * k[:, None] * np.pi / 16) * np.where(k == 0, np.sqrt(1 / 8), 0.5)[:, None]
    segment = lambda mark, body: bytes([0xFF, mark]) + struct.pack(">H", len(body) + 2) + body
    out = [b"\xff\xd8", segment(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0")]
    out += [segment(0xDB, bytes([i]) + bytes(t[ZIGZAG].tolist())) for i, t in enumerate(steps)]
    out.append(segment(0xC0, struct.pack(">BHHB", 8, h, w, 3) + bytes([1, 0x11, 0, 2, 0x11, 1, 3, 0x11, 1])))
    for i, plane in enumerate(planes):
        tiles = plane.reshape(plane.shape[0] // 8, 8, -1, 8).transpose(0, 2, 1, 3).reshape(-1, 8, 8)
        flat = (turn @ tiles @ turn.T).reshape(-1, 64) / steps[min(i, 1)]
        head, rest, data = _scan(np.rint(flat).astype(np.int64)[:, ZIGZAG])
        out += [segment(0xC4, b"\x00" + head), segment(0xC4, b"\x10" + rest), segment(0xDA, bytes([1, i + 1, 0, 0, 63, 0])), data]
    return b"".join(out) + b"\xff\xd9"


def encode(img: np.ndarray, kind: str, compression: str = "default", quality: int = 90) -> bytes:
    """png, jpeg, bmp or tiff; no library here has the other formats."""
    if kind == "jpeg":
        return encode_jpeg(img, quality)
    if kind == "png":
        return encode_png(img, compression)
    if kind == "bmp":
        return encode_bmp(img)
    if kind == "tiff":
        return encode_tiff(img)
    raise ValueError(f"no encoder for {kind!r}")


def encode_images(images: DataFrame, kind: str, compression: str = "default", quality: int = 90) -> DataFrame:
    """``images`` with column encoded in place of data; null data stay null.

    Columns payload (text) and exif (array of binary), if there are any, go into png and jpeg files.
    """
    names = images.columns
    told = {c: names.index(c) for c in ("payload", "exif") if c in names}
    put = {"png": with_png_metadata, "jpeg": with_jpeg_metadata}.get(kind)

    def whole(img: np.ndarray, payload: str | None, exif: list[bytes] | None) -> bytes:
        made = encode(img, kind, compression, quality)
        return put(made, payload, exif) if put and (payload is not None or exif) else made

    iw, ih, at = (names.index(c) for c in ("width", "height", "data"))
    fields = [f if f.name != "data" else T.StructField("encoded", T.BinaryType()) for f in images.schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            more = [batch.column(told[c]).to_pylist() if c in told else [None] * batch.num_rows for c in ("payload", "exif")]
            made = [None if d is None else whole(np.frombuffer(d, dtype=np.uint8).reshape(h, w, 4), p, e) for w, h, d, p, e in zip(*(batch.column(i).to_pylist() for i in (iw, ih, at)), *more)]
            columns = list(batch.columns)
            columns[at] = pa.array(made, pa.binary())
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in fields])

    return images.mapInArrow(run, T.StructType(fields))


def _json(value: Column) -> Column:
    """A value of any type as JSON text."""
    return F.regexp_replace(F.to_json(F.array(value)), r"^\[|\]$", "")


def metadata_payload(mode: Column, tags: Column, fields: dict[str, Column], generator: str = GENERATOR) -> Column:
    """JSON of tags and fields, keys in order; fields win over tags; null for mode strip or where there is nothing.

    Fields keep their type: numbers stay numbers, structs become objects, nulls are left out.
    """
    entry = lambda k, v: F.struct(k.alias("k"), v.alias("v"))
    given = F.filter(F.array(*[F.when(v.isNotNull(), entry(F.lit(k), _json(v))) for k, v in fields.items()]), lambda e: e.isNotNull())
    taken = [*fields, "generator", "generator_version"]
    rest = F.filter(F.map_entries(F.coalesce(tags, F.create_map().cast("map<string,string>"))), lambda e: ~e["key"].isin(taken))
    both = F.concat(F.transform(rest, lambda e: entry(e["key"], _json(e["value"]))), given)
    signed = F.concat(both, F.array(entry(F.lit("generator"), F.lit(f'"{generator}"')), entry(F.lit("generator_version"), F.lit(f'"{__version__}"'))))
    text = F.concat(F.lit("{"), F.array_join(F.transform(F.sort_array(signed), lambda e: F.concat(_json(e["k"]), F.lit(":"), e["v"])), ","), F.lit("}"))
    return F.when((F.lower(mode) != "strip") & (F.size(both) > 0), text)


def with_png_metadata(png: bytes, payload: str | None, exif: list[bytes] | None = None, key: bytes = b"Framewright") -> bytes:
    """Put Exif bodies and a text chunk behind the header."""
    end = 8 + 12 + int.from_bytes(png[8:12], "big")
    chunks = [png_chunk(b"eXIf", e) for e in exif or []]
    if payload is not None:
        chunks.append(png_chunk(b"tEXt", key + b"\0" + payload.encode()))
    return png[:end] + b"".join(chunks) + png[end:]


def png_exif(png: bytes) -> list[bytes]:
    at, out = 8, []
    while at + 8 <= len(png):
        size = int.from_bytes(png[at : at + 4], "big")
        if png[at + 4 : at + 8] == b"eXIf":
            out.append(png[at + 8 : at + 8 + size])
        at += 12 + size
    return out


def jpeg_segments(jpeg: bytes) -> list[tuple[int, bytes]]:
    """(marker, body) of the segments before the image data."""
    at, out = 2, []
    while at + 4 <= len(jpeg) and jpeg[at] == 0xFF and jpeg[at + 1] != 0xDA:
        size = int.from_bytes(jpeg[at + 2 : at + 4], "big")
        out.append((jpeg[at + 1], jpeg[at + 4 : at + 2 + size]))
        at += 2 + size
    return out


def without_orientation(tiff: bytes) -> bytes:
    """An Exif body whose orientation says upright, for pixels that have been turned already."""
    order = {b"II": "<", b"MM": ">"}.get(tiff[:2])
    if order is None or len(tiff) < 8:
        return tiff
    at = struct.unpack_from(f"{order}I", tiff, 4)[0]
    out = bytearray(tiff)
    if at + 2 <= len(tiff):
        for k in range(struct.unpack_from(f"{order}H", tiff, at)[0]):
            entry = at + 2 + 12 * k
            if entry + 12 <= len(tiff) and struct.unpack_from(f"{order}HH", tiff, entry) == (0x0112, 3):
                struct.pack_into(f"{order}H", out, entry + 8, 1)
    return bytes(out)


def with_jpeg_metadata(jpeg: bytes, payload: str | None, exif: list[bytes] | None = None) -> bytes:
    """Put Exif bodies and the payload (base64 in an XMP packet) behind the start; what exceeds a segment is left out."""
    bodies = [b"Exif\0\0" + without_orientation(e) for e in exif or []]
    if payload is not None:
        text = base64.b64encode(payload.encode()).decode()
        packet = f'<x:xmpmeta xmlns:x="adobe:ns:meta/"><rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#"><rdf:Description xmlns:f="urn:framewright" f:payload="{text}"/></rdf:RDF></x:xmpmeta>'
        bodies.append(b"http://ns.adobe.com/xap/1.0/\0" + packet.encode())
    parts = [b"\xff\xe1" + struct.pack(">H", len(b) + 2) + b for b in bodies if len(b) + 2 <= 65535]
    return jpeg[:2] + b"".join(parts) + jpeg[2:]


class FileSink(DataSource):
    """Writes rows of (path, encoded) as files below option path; a retried task writes the same file again."""

    @classmethod
    def name(cls) -> str:
        return "encoded_files"

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceWriter:
        return FileWriter(self.options["path"], schema.fieldNames())


class FileWriter(DataSourceArrowWriter):
    def __init__(self, root: str, names: list[str]):
        self.root, self.names = root, names

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        for batch in iterator:
            for path, data in zip(batch.column(self.names.index("path")).to_pylist(), batch.column(self.names.index("encoded")).to_pylist()):
                parts = [p for p in path.split("/") if p not in ("", ".", "..")]
                to = os.path.join(self.root, *parts)
                os.makedirs(os.path.dirname(to), exist_ok=True)
                whole = f"{to}.{os.getpid()}.part"
                with open(whole, "wb") as f:
                    f.write(data)
                os.replace(whole, to)  # readers never see half a file
        return WriterCommitMessage()


def write_files(images: DataFrame, root: str) -> None:
    """Write each row's bytes to its own path below ``root``, which all executors must share."""
    images.sparkSession.dataSource.register(FileSink)
    images.select("path", "encoded").write.format("encoded_files").option("path", root).mode("append").save()


def detection_json(faces: DataFrame, image: str = "image", order: str = "face_idx") -> DataFrame:
    """One record per image with its detections in order; absent fields are left out."""
    rest = [c for c in faces.columns if c not in (image, order)]
    face = F.struct(F.col(order).alias("o"), F.struct(*rest).alias("d"))
    grouped = faces.groupBy(image).agg(F.sort_array(F.collect_list(face)).alias("ds"))
    return grouped.select(image, F.to_json(F.struct(F.col(image), F.transform("ds", lambda x: x["d"]).alias("detections"))).alias("record"))


def write_detections(faces: DataFrame, path: str, image: str = "image", order: str = "face_idx") -> None:
    """Records as JSON lines; an error where there is none."""
    records = detection_json(faces, image, order)
    if records.isEmpty():
        raise ValueError("all images failed")
    records.select("record").write.mode("overwrite").text(path)
