"""Secrets: exact base patterns, in the text and in what is wrapped in it, however often.

A worklist of layers goes round by round.  A round scans each layer for secrets and unwraps what it can:
escapes (URL, Unicode) of the lines that have any, runs of base64, and compressed data in either.  What
comes out are the layers of the next round, rows of their own, so a document with thousands of them is
dealt out; rounds go on until no layer is left.  Each layer carries the place in the document of each of
its characters, so what is found is reported where it stands there, and the hashes of the layers around it,
so data that open to themselves end.
"""

from __future__ import annotations

import base64
import bz2
import codecs
import lzma
import re
import zlib
from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .shared import scratch, stage_out

KINDS = ["assign", "access", "hex"]
SPANS = "array<struct<start:int,kind:int,stop:int>>"
#: Shortest run of base64 that is tried.
MIN_RUN = 16
#: Data that open to more bytes than this are a bomb: what comes after is counted, not scanned.
MAX_BYTES = 1 << 28

_keys = ("password", "passwd", "secret", "token", "apikey", "api_key")
_assign = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?+\x20*+[:=]\x20*+["']?+([A-Za-z0-9+/_.=-]++)""", re.I | re.A)
_access = re.compile(r"AKIA[A-Z0-9]++")
_hex = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}+")


def _marks(alphabet: str) -> bytes:
    """A table for bytes.translate: x for the alphabet, blank for all else."""
    return bytes(120 if chr(c) in alphabet else 32 for c in range(256))


_hex_marks = _marks("0123456789abcdef")
_run_marks = _marks("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-")

# Escapes of escapes (%2541, \\u0041) are undone at once: a backslash may be any number of them, a percent sign too.
_byte_of = re.compile(r"%(?:25)*([0-9A-Fa-f]{2})|\\++x([0-9A-Fa-f]{2})")
_escape = re.compile(
    r"(?P<bytes>(?:%(?:25)*[0-9A-Fa-f]{2})+|(?<!\\)(?:\\++x[0-9A-Fa-f]{2})+)"
    r"|(?<!\\)\\++(?:u(?P<high>[dD][89abAB][0-9A-Fa-f]{2})\\++u(?P<low>[dD][c-fC-F][0-9A-Fa-f]{2})"
    r"|u(?P<four>[0-9A-Fa-f]{4})|u\{(?P<some>[0-9A-Fa-f]{1,6})\}|U(?P<eight>[0-9A-Fa-f]{8})|(?P<quote>[\"']))"
    r"|&\#(?P<decimal>[0-9]{1,7});|&\#[xX](?P<hexadecimal>[0-9A-Fa-f]{1,6});"
)
_run = re.compile(rf"[A-Za-z0-9+/_-]{{{MIN_RUN},}}+={{0,2}}")
_piece = re.compile(rf"[A-Za-z0-9]{{{MIN_RUN},}}+={{0,2}}")
_url_safe = str.maketrans("-_", "+/")
_control = re.compile(rb"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]").search


def _digest(x: str | bytes) -> int:
    return xxhash.xxh64_intdigest(x) - (1 << 63)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, stop) in code points, by start and then kind."""
    out, low = [], text.lower()
    if any(k in low for k in _keys):
        out += [(m.start(), 0, m.end()) for m in _assign.finditer(text) if m.end() - m.start(1) >= 8]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _access.finditer(text) if m.end() - m.start() >= 16]
    if b"x" * 32 in text.encode("utf-8", "replace").translate(_hex_marks):
        out += [(m.start(), 2, m.end()) for m in _hex.finditer(text)]
    return sorted(out)


class _Packed(NamedTuple):
    """Compressed data, and where they lie in the document."""

    data: bytes
    lo: int
    hi: int


class Layer(NamedTuple):
    """A text and where it lies in its document: each character's place, or one stretch for all of them."""

    text: str
    lo: int
    hi: int
    starts: np.ndarray | None
    stops: np.ndarray | None
    around: list[int]

    def place(self, start: int, stop: int) -> tuple[int, int]:
        return (self.lo, self.hi) if self.starts is None else (int(self.starts[start]), int(self.stops[stop - 1]))

    def inner(self, text: str, starts: np.ndarray | None, stops: np.ndarray | None, lo: int, hi: int) -> Layer:
        """A layer inside; its characters' places (None: all of lo to hi) are given within this one."""
        a, b = self.place(lo, hi)
        if starts is not None:
            starts, stops = (None, None) if self.starts is None else (self.starts[starts].astype(np.int32), self.stops[stops - 1].astype(np.int32))
        return Layer(text, a, b, starts, stops, self.around)


def _char(code: int) -> str:
    return chr(code) if 0 < code <= 0x10FFFF and not 0xD800 <= code <= 0xDFFF else "\N{REPLACEMENT CHARACTER}"


def _chars_of(data: bytes) -> tuple[str, np.ndarray]:
    """Bytes as UTF-8, or else a character each, and where each character begins in them, then the end."""
    try:
        text, begins = data.decode(), np.flatnonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)
    except UnicodeDecodeError:
        text, begins = data.decode("latin-1"), np.arange(len(data))
    return text, np.append(begins, len(data))


def _unescaped(layer: Layer, lo: int, hi: int, found: list[re.Match]) -> Iterator[Layer | _Packed]:
    """The line ``lo`` to ``hi`` with all its escapes undone; compressed data among them."""
    text, said, starts, stops, at = layer.text, [], [], [], lo

    def literal(to: int) -> None:
        said.append(text[at:to])
        starts.append(np.arange(at, to))
        stops.append(np.arange(at + 1, to + 1))

    for m in found:
        literal(m.start())
        at = m.end()
        if m["bytes"]:
            units = list(_byte_of.finditer(text, m.start(), m.end()))
            data = bytes(int(u[1] or u[2], 16) for u in units)
            if _opener(data):
                yield _Packed(data, *layer.place(m.start(), m.end()))
            chars, begins = _chars_of(data)
            edges = np.array([u.start() for u in units] + [m.end()])[begins]
            said.append(chars)
            starts.append(edges[:-1])
            stops.append(edges[1:])
            continue
        if m["high"]:
            code = 0x10000 + (int(m["high"], 16) - 0xD800 << 10) + int(m["low"], 16) - 0xDC00
        elif m["quote"]:
            code = ord(m["quote"])
        elif m["decimal"]:
            code = int(m["decimal"])
        else:
            code = int(m["four"] or m["some"] or m["eight"] or m["hexadecimal"], 16)
        said.append(_char(code))
        starts.append([m.start()])
        stops.append([m.end()])
    literal(hi)
    yield layer.inner("".join(said), np.concatenate(starts).astype(int), np.concatenate(stops).astype(int), lo, hi)


def _escapes(layer: Layer) -> Iterator[Layer | _Packed]:
    """Each line with escapes, undone."""
    text = layer.text
    if not ("%" in text or "\\" in text or "&#" in text):
        return
    lo = hi = 0
    held: list[re.Match] = []
    for m in _escape.finditer(text):
        if held and m.start() >= hi:
            yield from _unescaped(layer, lo, hi, held)
            held = []
        if not held:
            lo = text.rfind("\n", hi, m.start()) + 1 or hi
            hi = text.find("\n", m.end())
            hi = len(text) if hi < 0 else hi
        held.append(m)
    if held:
        yield from _unescaped(layer, lo, hi, held)


def _plain(data: bytes) -> bool:
    """Whether bytes, perhaps cut off within a character, are a text without control characters."""
    if _control(data):
        return False
    try:
        codecs.getincrementaldecoder("utf-8")().decode(data)
    except UnicodeDecodeError:
        return False
    return True


def _opener(data: bytes):
    """What opens compressed data (gzip, zlib, bzip2, xz), by their first bytes; None if they are not."""
    if data[:2] == b"\x1f\x8b" or (data[:2] in (b"x\x01", b"x^", b"x\x9c", b"x\xda") and not _plain(data[:64])):
        return zlib.decompressobj(47)
    if data[:3] == b"BZh" and not _plain(data[:64]):
        return bz2.BZ2Decompressor()
    if data[:6] == b"\xfd7zXZ\x00":
        return lzma.LZMADecompressor()
    return None


def _opened(data: bytes, step: int = 1 << 20) -> Iterator[bytes]:
    """The content of compressed data, piece by piece; what is broken ends early."""
    opener = _opener(data)
    try:
        while not opener.eof:
            piece = opener.decompress(data, step)
            data = opener.unconsumed_tail if hasattr(opener, "unconsumed_tail") else b""
            if not piece and not data:
                return
            yield piece
    except (zlib.error, OSError, EOFError, lzma.LZMAError):
        return


def _contents(packed: _Packed, max_bytes: int) -> Iterator[str | _Packed | None]:
    """Lines of compressed data, or what is compressed in them; None once if they open to more than ``max_bytes``.

    No secret crosses a line, so only one line is held.
    """
    pieces = _opened(packed.data)
    head = next(pieces, b"")
    if _opener(head):
        inner = bytearray(head)
        for piece in pieces:
            inner += piece
            if len(inner) > max_bytes:
                yield None
                return
        yield _Packed(bytes(inner), packed.lo, packed.hi)
        return
    held, total = [], 0
    for piece in chain([head], pieces):
        total += len(piece)
        if total > max_bytes:
            yield None
            break
        *lines, rest = piece.split(b"\n")
        for line in lines:
            held.append(line)
            yield b"".join(held).decode("utf-8", "replace")
            held = []
        held.append(rest)
    yield b"".join(held).decode("utf-8", "replace")


def _decoded(layer: Layer, lo: int, run: str) -> Layer | _Packed | None:
    """What a run of base64 at ``lo`` holds, if that is compressed or a text."""
    body = run.rstrip("=")
    if len(body) % 4 == 1:
        return None
    data = base64.b64decode(body.translate(_url_safe) + "=" * (-len(body) % 4))
    if _opener(data):
        return _Packed(data, *layer.place(lo, lo + len(run)))
    if not _plain(data):
        return None
    text, begins = _chars_of(data)
    return layer.inner(text, lo + begins[:-1] * 8 // 6, lo + (begins[1:] * 8 - 1) // 6 + 1, lo, lo + len(run))


def _runs(layer: Layer) -> Iterator[Layer | _Packed]:
    """What the runs of base64 hold; a run that holds nothing may be several, parted by signs of the alphabet."""
    if b"x" * MIN_RUN not in layer.text.encode("utf-8", "replace").translate(_run_marks):
        return
    for m in _run.finditer(layer.text):
        whole = _decoded(layer, m.start(), m.group())
        if whole is not None:
            yield whole
            continue
        for p in _piece.finditer(layer.text, m.start(), m.end()):
            part = _decoded(layer, p.start(), p.group()) if p.group() != m.group() else None
            if part is not None:
                yield part


def unwrapped(layer: Layer, max_bytes: int = MAX_BYTES) -> Iterator[Layer | None]:
    """The layers one step inside; None for data that open to too much."""
    near = [_digest(layer.text), *layer.around]
    queue = (x for find in (_escapes, _runs) for x in find(layer))
    for x in queue:
        if isinstance(x, Layer):
            if _digest(x.text) not in near:
                yield x._replace(around=near)
            continue
        packs, opened = [x], set()
        while packs:  # compressed in compressed
            packed = packs.pop()
            key = _digest(packed.data)
            if key in opened or key in near:
                continue  # opens to itself
            opened.add(key)
            for line in _contents(packed, max_bytes):
                if line is None:
                    yield None
                elif isinstance(line, _Packed):
                    packs.append(line)
                elif line:
                    yield Layer(line, packed.lo, packed.hi, None, None, [*opened, *near])


_FIELDS = f"row long, text string, lo int, hi int, starts array<int>, stops array<int>, around array<long>, spans {SPANS}, unopened int"


def _scan(frame: DataFrame, id_col: str, max_bytes: int) -> DataFrame:
    """For each layer of ``frame`` a row with what it holds (places in the document), and a row for each layer inside."""
    schema = T.StructType([frame.schema[id_col], *T._parse_datatype_string(_FIELDS).fields])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, at, rows, size = batch.column(0), [], [], 0

            def flush() -> pa.RecordBatch:
                made = [pa.array([r[k] for r in rows], type=f.type) for k, f in enumerate(arrow) if k]
                return pa.RecordBatch.from_arrays([ids.take(pa.array(at, type=pa.int64())), *made], schema=arrow)

            for i in range(batch.num_rows):
                row, text, lo, hi, starts, stops, around = (batch.column(k)[i] for k in range(1, batch.num_columns))
                row, text = row.as_py(), text.as_py() or ""
                if not around.is_valid:  # the document itself
                    every = np.arange(len(text) + 1)
                    layer = Layer(text, 0, len(text), every[:-1], every[1:], [])
                else:
                    places = [x.values.to_numpy() if x.is_valid else None for x in (starts, stops)]
                    layer = Layer(text, lo.as_py(), hi.as_py(), *places, around.as_py())
                unopened = 0
                for x in unwrapped(layer, max_bytes):
                    if x is None:
                        unopened += 1
                        continue
                    at.append(i)
                    rows.append((None, row, x.text, x.lo, x.hi, x.starts, x.stops, x.around, None, None))
                    size += len(x.text)
                    if size > 4_000_000:
                        yield flush()
                        at, rows, size = [], [], 0
                spans = sorted({(a, k, b) for s, k, e in base_spans(text) for a, b in [layer.place(s, e)]})
                at.append(i)
                rows.append((None, row, None, None, None, None, None, None, [{"start": a, "kind": k, "stop": b} for a, k, b in spans], unopened))
            yield flush()

    return frame.mapInArrow(run, schema)


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bytes: int = MAX_BYTES) -> DataFrame:
    """One row per row of ``docs``: ``id_col``, base and added spans (start, kind, stop in code points), n_unopened.

    Base spans stand in the text as it is; added ones in what it wraps: percent escapes, escapes of
    characters by number and of quotes, base64 of at least ``MIN_RUN`` signs in a row, and gzip, zlib, bzip2 or xz in those.  An added span
    is the least stretch of the document that holds the secret; in compressed data that is the whole run.
    ``n_unopened`` counts data that open to more than ``max_bytes``; what came before that is scanned.

    A null text counts as empty and has no spans; repeated rows come out alike, each; a null id is kept; an
    empty table gives no rows; other columns are not read, whatever their names.  Ids are never compared.
    An id column named like a result column is refused.
    """
    if id_col.lower() in ("base", "added", "n_unopened"):
        raise ValueError(f"the id column {id_col} has the name of a result column")
    nothing = [F.lit(None).cast(t).alias(n) for n, t in (("lo", "int"), ("hi", "int"), ("starts", "array<int>"), ("stops", "array<int>"), ("around", "array<long>"))]
    frame = docs.select(F.col(f"`{id_col}`").alias("id"), F.monotonically_increasing_id().alias("row"), F.col(f"`{text_col}`").cast("string").alias("text"), *nothing)
    columns = frame.columns
    with scratch(docs.sparkSession) as result:
        first = stage_out(_scan(frame, "id", max_bytes), "secrets-0")
        base = first.where("spans IS NOT NULL").select("id", "row", F.col("spans").alias("base"), "unopened")
        layers, found = first.where("around IS NOT NULL").select(*columns), None
        while not layers.isEmpty():  # ends: what is unwrapped gets shorter, or opens to itself and is dropped
            inside = stage_out(_scan(layers, "id", max_bytes), "secrets-inside")
            some = inside.where("size(spans) > 0 OR unopened > 0").select("row", F.col("spans").alias("more"), F.col("unopened").alias("late"))
            found = some if found is None else found.union(some)
            layers = inside.where("around IS NOT NULL").select(*columns)
        none = F.array().cast(SPANS)
        if found is None:
            return result(base.select(F.col("id").alias(id_col), "base", none.alias("added"), F.col("unopened").cast("long").alias("n_unopened")), "secrets")
        more = found.groupBy("row").agg(F.flatten(F.collect_list("more")).alias("more"), F.sum("late").alias("late"))
        added = F.array_sort(F.array_except(F.coalesce("more", none), "base"))
        unopened = F.col("unopened") + F.coalesce("late", F.lit(0))
        return result(base.join(more, "row", "left").select(F.col("id").alias(id_col), "base", added.alias("added"), unopened.cast("long").alias("n_unopened")), "secrets")


def _listed(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row per row of :func:`find_secrets`: base counts by kind, a hash of the base spans, and all spans listed.

    A row without spans has zeros, the hash of the empty string and an empty list; an empty table gives no rows.
    """
    of = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k))  # noqa: E731  (a second argument would be the place in the array)
    counts = [of(k).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return found.select(id_col, *counts, F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(F.array_sort(F.concat("base", "added"))).alias("spans"))
