"""Byte-level BPE without regular expressions: scans over codepoint classes, then cached pair merging.

Pre-tokenisation is a small automaton.  Its step for one symbol is a function on states, and function
composition is associative, so the states before all characters of a batch come from one parallel
prefix scan over the elements of the finite monoid that the step functions generate.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import unicodedata
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import map_texts, text_groups

# Codepoint classes.
LETTER, NUMBER, SPACE, OTHER = 0, 1, 2, 3
# Code points with the White_Space property (fixed values).
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]

# Symbols that the automaton reads.
S_LETTER, S_ENDS, S_PAIR, S_NUMBER, S_OTHER, S_QUOTE, S_SPACE, S_LEAD, S_LONE, S_RESET = range(10)
# States: closed, in letters, in numbers, in others, in white space, after a leading blank, after an
# opening quote, inside a two-letter contraction.
CLOSED, LETTERS, NUMBERS, OTHERS, SPACES, LEADED, QUOTE, PAIR = range(8)


def _step(state: int, symbol: int) -> tuple[int, bool]:
    """The next state, and whether a token starts at this symbol."""
    if symbol == S_RESET or symbol == S_LONE:
        return CLOSED, True
    if symbol == S_LEAD:
        return LEADED, True
    if symbol == S_SPACE:
        return SPACES, state != SPACES
    if symbol in (S_LETTER, S_ENDS, S_PAIR):
        if state == PAIR:
            return CLOSED, False
        if state == QUOTE and symbol == S_ENDS:
            return CLOSED, False
        if state == QUOTE and symbol == S_PAIR:
            return PAIR, False
        return LETTERS, state not in (LETTERS, LEADED)
    if symbol == S_NUMBER:
        return NUMBERS, state not in (NUMBERS, LEADED)
    if symbol == S_QUOTE and state not in (OTHERS, LEADED, QUOTE):
        return QUOTE, True
    return OTHERS, state not in (OTHERS, LEADED, QUOTE)


@lru_cache(maxsize=1)
def _monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids of the symbols' functions, composition table, application table, and starts by state and symbol."""
    gens = [tuple(_step(s, y)[0] for s in range(8)) for y in range(10)]
    ids = {tuple(range(8)): 0}
    todo = [tuple(range(8))]
    while todo:
        f = todo.pop()
        for g in gens:
            h = tuple(g[x] for x in f)
            if h not in ids:
                ids[h] = len(ids)
                todo.append(h)
    fs = np.array(sorted(ids, key=ids.get), dtype=np.uint8)
    n = len(fs)
    code = {f: i for f, i in ids.items()}
    comp = np.empty((n, n), dtype=np.uint16)
    for i in range(n):
        for j, h in enumerate(fs[:, fs[i]]):
            comp[i, j] = code[tuple(int(x) for x in h)]
    gen = np.array([code[g] for g in gens], dtype=np.uint16)
    starts = np.array([[_step(s, y)[1] for y in range(10)] for s in range(8)], dtype=bool)
    return gen, comp, fs, starts


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    table = np.full(0x110000, OTHER, dtype=np.uint8)
    for cp in range(0x110000):
        kind = unicodedata.category(chr(cp))[0]
        if kind == "L":
            table[cp] = LETTER
        elif kind == "N":
            table[cp] = NUMBER
    table[WHITE_SPACE] = SPACE
    return table


def _states(symbols: np.ndarray) -> np.ndarray:
    """The automaton's state before each symbol, by a blocked associative scan."""
    gen, comp, apply, _ = _monoid()
    n, count = len(symbols), len(apply)
    width = 256
    blocks = -(-n // width)
    ids = np.zeros(blocks * width, dtype=np.uint16)
    ids[:n] = gen[symbols]
    ids = np.ascontiguousarray(ids.reshape(blocks, width).T)
    flat = comp.ravel()
    before = np.empty_like(ids)
    acc = np.zeros(blocks, dtype=np.int32)
    for j in range(width):
        before[j] = acc
        acc = flat[acc * count + ids[j]].astype(np.int32)
    # inclusive scan over the blocks' own functions by doubling
    step = 1
    while step < blocks:
        acc[step:] = flat[acc[:-step] * count + acc[step:]]
        step *= 2
    first = np.zeros(blocks, dtype=np.uint8)
    first[1:] = apply[acc[:-1], CLOSED]
    states = apply.ravel()[before.astype(np.int32) * 8 + first]
    return np.ascontiguousarray(states.T).ravel()[:n]


def boundaries(texts: list[str]) -> tuple[bytes, np.ndarray, np.ndarray]:
    """Byte string of all texts with one separator after each, starts of all tokens in it, and the rank of each text's first token (one more at the end).

    A separator is a token of its own, so text i has the tokens from ``first[i]`` to ``first[i + 1] - 2``.
    """
    joined = "\0".join(texts) + "\0"
    points = np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32)
    ends = np.cumsum([len(x) + 1 for x in texts]) - 1  # where the separators stand
    kind = _classes()[points]
    space = kind == SPACE
    later = np.empty_like(points)
    later[:-1], later[-1] = points[1:], 0
    sep = np.zeros(len(points), dtype=bool)
    sep[ends] = True
    quiet = np.empty(len(points), dtype=bool)  # white space or the text's end follows
    quiet[:-1], quiet[-1] = space[1:] | sep[1:], True
    symbols = np.array([S_LETTER, S_NUMBER, S_SPACE, S_OTHER], dtype=np.uint8)[kind]
    for c in "stmd":
        symbols[points == ord(c)] = S_ENDS
    for c, d in ("re", "ve", "ll"):
        symbols[(points == ord(c)) & (later == ord(d))] = S_PAIR
    symbols[points == ord("'")] = S_QUOTE
    symbols[kind == OTHER] = np.where(points[kind == OTHER] == ord("'"), S_QUOTE, S_OTHER)
    last = space & ~quiet
    symbols[last] = np.where(points[last] == 0x20, S_LEAD, S_LONE)
    symbols[ends] = S_RESET
    starts = np.flatnonzero(_monoid()[3].ravel()[_states(symbols).astype(np.int32) * 10 + symbols])
    first = np.searchsorted(starts, np.concatenate(([0], ends + 1)))
    data = joined.encode("utf-8")
    if len(data) != len(points):
        size = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
        offsets = np.cumsum(size) - size
        starts = offsets[starts]
    return data, starts, first


def merge(piece: bytes, ranks: dict[bytes, int]) -> tuple[int, ...]:
    """Ids of one piece: the adjacent pair of lowest rank, leftmost first, is merged until none has a rank."""
    whole = ranks.get(piece)
    if whole is not None:
        return (whole,)
    if len(piece) > 96:
        return _merge_long(piece, ranks)
    parts = [piece[i : i + 1] for i in range(len(piece))]
    none = len(ranks) + 1
    pair = [ranks.get(a + b, none) for a, b in zip(parts, parts[1:])]
    while pair and (low := min(pair)) < none:
        i = pair.index(low)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del pair[i]
        if i:
            pair[i - 1] = ranks.get(parts[i - 1] + parts[i], none)
        if i < len(pair):
            pair[i] = ranks.get(parts[i] + parts[i + 1], none)
    return tuple(ranks[x] for x in parts)


def _merge_long(piece: bytes, ranks: dict[bytes, int]) -> tuple[int, ...]:
    """As :func:`merge` with a heap over a linked list, for pieces of any length."""
    n = len(piece)
    end, after, prior = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = after[i] if end[i] else n
        if not end[i] or j >= n or end[j] != stop:
            continue
        end[i], after[i], end[j] = stop, after[j], 0
        if after[i] < n:
            prior[after[i]] = i
            if (r := ranks.get(piece[i : end[after[i]]])) is not None:
                heapq.heappush(heap, (r, i, end[after[i]]))
        if (p := prior[i]) >= 0 and (r := ranks.get(piece[p:stop])) is not None:
            heapq.heappush(heap, (r, p, stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = after[i]
    return tuple(out)


class _Cache(dict):
    """Merged pieces; cleared between batches once it holds ``limit`` pieces, so memory is bounded."""

    def __init__(self, ranks: dict[bytes, int], limit: int):
        super().__init__()
        self.ranks, self.limit = ranks, limit

    def __missing__(self, piece: bytes) -> tuple[int, ...]:
        ids = self[piece] = merge(piece, self.ranks)
        return ids

    def trim(self) -> None:
        if len(self) > self.limit:
            self.clear()


class ByteBpe:
    """Encoder and decoder for a rank file (a base64 token and its rank on each line)."""

    def __init__(self, ranks: dict[bytes, int], cache_limit: int = 400_000):
        self.ranks = ranks
        self.vocab = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.vocab[rank] = token
        self.cache = _Cache(ranks, cache_limit)

    @classmethod
    @lru_cache(maxsize=2)
    def load(cls, path: str) -> "ByteBpe":
        with open(path, "rb") as lines:
            return cls({base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())})

    def encode_batch(self, texts: list[str]) -> Iterator[tuple[list[int], np.ndarray]]:
        """For each text its ids, and the byte offset in the text at which each pre-token starts."""
        self.cache.trim()
        data, starts, first = boundaries(texts)
        look = self.cache.__getitem__
        at = starts.tolist()
        for i in range(len(texts)):
            lo, hi = int(first[i]), int(first[i + 1]) - 1  # the separator's token is left out
            pieces = [data[a:b] for a, b in zip(at[lo:hi], at[lo + 1 : hi + 1])]
            yield list(chain.from_iterable(map(look, pieces))), starts[lo:hi] - (starts[lo] if hi > lo else 0)

    def decode(self, ids: Iterable[int]) -> bytes:
        vocab = self.vocab
        return b"".join([vocab[i] for i in ids])


Emit = Callable[[ByteBpe, list[int], np.ndarray], tuple]


def emit_ids(coder: ByteBpe, ids: list[int], offsets: np.ndarray) -> tuple:
    return ids, offsets.tolist()


IDS_SCHEMA = "ids array<int>, piece_offsets array<long>"


def encode_documents(
    docs: DataFrame,
    rank_file: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    emit: Emit = emit_ids,
    emit_schema: str = IDS_SCHEMA,
    batch_chars: int = 1_000_000,
) -> DataFrame:
    """Encode every whole text; one row per row of ``docs``.

    Output: ``id_col`` and what ``emit`` makes of a text's ids and pre-token offsets (by default both).
    ``emit`` runs beside the encoder, so digests need not carry the ids back to the JVM.
    A null text counts as empty and has no ids; repeated rows and null ids are kept; other columns are
    not read.  No shuffle: the work is row by row and memory is bounded by a batch or the longest text.
    """

    def make() -> Callable:
        coder = ByteBpe.load(rank_file)

        def work(texts: list[str], _: list) -> list[tuple]:
            return [emit(coder, ids, offsets) for group in text_groups(texts, batch_chars) for ids, offsets in coder.encode_batch(group)]

        return work

    return map_texts(docs, [id_col], text_col, make, emit_schema)


def decode_documents(encoded: DataFrame, rank_file: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """The bytes that each row's ids stand for, as (``id_col``, ``data`` binary); null ids decode to nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = ByteBpe.load(rank_file)
        for batch in batches:
            data = [b"" if x is None else coder.decode(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, type=pa.binary())], names=[id_col, "data"])

    slim = encoded.select(F.col(id_col), F.col(ids_col).alias("__ids"))
    schema = T.StructType([T.StructField(id_col, slim.schema[id_col].dataType), T.StructField("data", T.BinaryType())])
    return slim.mapInArrow(run, schema)


def emit_digest(coder: ByteBpe, ids: list[int], offsets: np.ndarray) -> tuple:
    """Count, digest of the decimal ids, and digest of the bytes that the ids decode to."""
    return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(coder.decode(ids)).hexdigest()


DIGEST_SCHEMA = "n_tokens long, ids_sha256 string, decoded_sha256 string"
