"""Sum-of-squares packing of tokenised documents into sequences of bounded length.

Pieces are dealt into groups of bounded size; within a group each piece goes where the sum of the squared
counts of open sequences per residual gap becomes smallest.  The sequences still open at the end (at most
one for each gap and count, whatever the group's size) are emptied and packed again, largest first.
"""

from __future__ import annotations

import bisect
import os
import re
import unicodedata
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import flat_map_texts, free_name, scratch, stage_out, text_groups

CAPACITY = 2048
SEPARATOR_ID = 0

# The split pattern of the vocabulary file (fixed value).
WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"""
#: Below this code point any Unicode tables agree on letters, numbers and lower case, and nothing composes.
SETTLED = "\u0180"


class WordBpe:
    """Ids of a lower-casing word BPE file, as the library gives them, as little-endian 32-bit bytes.

    No word spans white space, so a text's ids are those of its chunks between ASCII blanks one after the other.
    Chunks of settled code points are lowered and split here, all new ones at once; the library merges each
    distinct word once.  It gets other chunks as they are, and whole texts that hold a special token's string.
    One cache of bounded size has chunks and words, as a word is its own only word.
    """

    def __init__(self, path: str, cache_limit: int = 1_000_000):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks are the parallel part
        self.whole = Tokenizer.from_file(path)
        self.model = Tokenizer.from_file(path)
        # Words come normalised and split, so the library need only part them at blanks.
        self.model.normalizer = normalizers.Sequence([])
        self.model.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        kinds = {k: re.escape("".join(c for c in map(chr, range(ord(SETTLED))) if unicodedata.category(c)[0] == k)) for k in "LN"}
        pattern = WORDS.replace(r"\p{L}", kinds["L"]).replace(r"\p{N}", kinds["N"]).replace(r"\s", r"\x09-\x0d\x20\x85\xa0")
        self.find = re.compile(rf"{pattern}|\n").findall
        self.special = re.compile("|".join(re.escape(t.content) for t in self.whole.get_added_tokens_decoder().values()) or r"(?!)").search
        self.ends = np.zeros(self.model.get_vocab_size() + 1, dtype=bool)
        for token, i in self.model.get_vocab().items():
            self.ends[i] = token.endswith("</w>")
        self.cache: dict[str, bytes] = {}
        self.limit = cache_limit

    @classmethod
    @lru_cache(maxsize=2)
    def load(cls, path: str) -> "WordBpe":
        return cls(path)

    def _learn_words(self, words: list[str]) -> None:
        """One call encodes many words; a token with the word-end mark closes a word."""
        for at in range(0, len(words), 4000):
            part = words[at : at + 4000]
            ids = np.array(self.model.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, dtype="<u4")
            stops = (np.flatnonzero(self.ends[ids]) + 1).tolist()
            if len(stops) == len(part):
                data = ids.tobytes()
                self.cache.update((w, data[4 * a : 4 * b]) for w, a, b in zip(part, [0, *stops], stops))
            else:
                self.cache.update((w, self._ids(e)) for w, e in zip(part, self.model.encode_batch_fast(part, add_special_tokens=False)))

    @staticmethod
    def _ids(encoding) -> bytes:
        return np.array(encoding.ids, dtype="<u4").tobytes()

    def _learn_chunks(self, chunks: set[str]) -> None:
        cache = self.cache
        settled = [c for c in chunks if c.isascii() or max(c) < SETTLED]
        if len(settled) < len(chunks):
            others = list(chunks.difference(settled))
            cache.update(zip(others, map(self._ids, self.whole.encode_batch_fast(others, add_special_tokens=False))))
        if not settled:
            return
        flat = self.find("\n".join([*settled, ""]).lower())
        words = set(flat)
        words.discard("\n")
        self._learn_words(list(words.difference(cache)))
        look, at = cache.__getitem__, 0
        for c in settled:
            stop = flat.index("\n", at)
            if stop == at + 1:
                cache[c] = look(flat[at])
            else:
                cache[c] = b"".join(map(look, flat[at:stop]))
            at = stop + 1

    def _ids_of(self, chunks: list[str]) -> list[bytes]:
        parts = list(map(self.cache.get, chunks))
        missing = [p is None for p in parts]
        if any(missing):
            if len(self.cache) > self.limit:
                self.cache.clear()
            self._learn_chunks(set(compress(chunks, missing)))
            look = self.cache.__getitem__
            for i in compress(range(len(chunks)), missing):
                parts[i] = look(chunks[i])
        return parts

    def encode_batch(self, texts: list[str]) -> Iterator[bytes]:
        """Ids of each text.  Only distinct chunks become Python objects; their ids are dealt out by number."""
        alone = {i: self._ids(self.whole.encode(x, add_special_tokens=False)) for i, x in enumerate(texts) if "<" in x and self.special(x)}
        split = pc.ascii_split_whitespace(pa.array(["" if i in alone else x for i, x in enumerate(texts)] if alone else texts, pa.large_string()))
        coded = split.values.dictionary_encode()
        parts = self._ids_of(coded.dictionary.to_pylist())
        size = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts)) // 4
        first = np.cumsum(size) - size
        flat = np.frombuffer(b"".join(parts), dtype="<u4")
        chunk = coded.indices.to_numpy()
        n = size[chunk]
        ends = np.concatenate([[0], np.cumsum(n)])
        place = np.repeat(first[chunk] - ends[:-1], n)
        place += np.arange(len(place))
        ids = flat[place]
        bounds = ends[split.offsets.to_numpy()].tolist()
        for i, (a, b) in enumerate(zip(bounds, bounds[1:])):
            yield alone[i] if i in alone else ids[a:b].tobytes()


PIECE_SCHEMA = "piece int, start long, length long, ids_crc32 long"


def cut_pieces(
    docs: DataFrame,
    tokenizer_file: str,
    capacity: int = CAPACITY,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_ids: bool = False,
) -> DataFrame:
    """Tokenise whole texts (null: empty), end each with the separator id, and cut what is longer than ``capacity``.

    One row per piece: ``id_col``, piece, start, length, ids_crc32 and, if asked for, the ids themselves.
    Every document has at least one piece, since an empty one still has its separator.
    """

    def make() -> Callable:
        coder, end = WordBpe.load(tokenizer_file), SEPARATOR_ID.to_bytes(4, "little")

        def work(texts: list[str], _: list) -> Iterator[tuple[int, tuple]]:
            coded = (data for group in text_groups(texts, 4_000_000) for data in coder.encode_batch(group))
            for i, data in enumerate(coded):
                data += end
                for k, at in enumerate(range(0, len(data), 4 * capacity)):
                    part = data[at : at + 4 * capacity]
                    row = (k, at // 4, len(part) // 4, zlib.crc32(part))
                    yield i, (*row, np.frombuffer(part, dtype="<u4").tolist()) if with_ids else row

        return work

    return flat_map_texts(docs, [id_col], text_col, make, PIECE_SCHEMA + (", ids array<long>" if with_ids else ""))


def _place(lengths: list[int], capacity: int) -> tuple[list[list[int]], list[int]]:
    """Items of each bin, every item put where the sum of squares becomes smallest, and the bins left open."""
    counts = np.zeros(capacity + 1, dtype=np.int64)
    big = np.iinfo(np.int64).max // 4
    waiting: list[list[int]] = [[] for _ in range(capacity + 1)]  # bins by gap
    items: list[list[int]] = []
    for i, s in enumerate(lengths):
        if not 0 < s <= capacity:
            raise ValueError(f"item of {s} does not fit {capacity}")
        gap, best = capacity, 2 * counts[capacity - s] + 1 if s < capacity else 0
        if s < capacity:
            if counts[s] and 1 - 2 * counts[s] < best:
                gap, best = s, 1 - 2 * counts[s]
            here = counts[s + 1 : capacity]
            if len(here):
                change = np.where(here > 0, 2 * (counts[1 : capacity - s] - here) + 2, big)
                k = int(change.argmin())
                if change[k] < best:
                    gap = s + 1 + k
        if gap == capacity:
            b = len(items)
            items.append([])
        else:
            b = waiting[gap].pop()
            counts[gap] -= 1
        items[b].append(i)
        if gap > s:
            waiting[gap - s].append(b)
            counts[gap - s] += 1
    return items, [b for bins in waiting for b in bins]


def _best_fit(lengths: list[int], capacity: int) -> tuple[list[list[int]], list[int]]:
    """As :func:`_place`, but every item goes to the fullest bin that has room, the oldest on ties."""
    items: list[list[int]] = []
    gaps: list[tuple[int, int]] = []
    for i, s in enumerate(lengths):
        at = bisect.bisect_left(gaps, (s, -1))
        if at == len(gaps):
            room, b = capacity, len(items)
            items.append([])
        else:
            room, b = gaps.pop(at)
        items[b].append(i)
        if room > s:
            bisect.insort(gaps, (room - s, b))
    return items, [b for _, b in gaps]


def sum_of_squares(lengths: list[int], capacity: int = CAPACITY) -> tuple[list[int], list[int]]:
    """Bin and offset of each item, in the order given.

    Opening a bin for an item of size s adds 2 N(capacity - s) + 1 to the sum of squares; filling a bin of
    gap g adds 2 (N(g - s) - N(g)) + 2, or 1 - 2 N(s) where it closes.  The smallest change wins, the
    smallest gap on ties, the bin filled last among those of a gap.  Bins left open are then emptied and
    their items placed again by the same rule, largest first, as long as that needs fewer bins; what then
    is still open gets best fit instead, if that needs fewer.
    """
    items, left = _place(lengths, capacity)
    for rule in (_place, _best_fit):
        while left:
            again = sorted((i for b in left for i in items[b]), key=lambda i: (-lengths[i], i))
            fresh, still = rule([lengths[i] for i in again], capacity)
            if len(fresh) >= len(left):
                break
            gone = set(left)
            items = [x for b, x in enumerate(items) if b not in gone]
            left = [len(items) + b for b in still]
            items += [[again[i] for i in x] for x in fresh]
    bins, offsets = [0] * len(lengths), [0] * len(lengths)
    for b, members in enumerate(items):
        at = 0
        for i in members:
            bins[i], offsets[i] = b, at
            at += lengths[i]
    return bins, offsets


def pack_pieces(pieces: DataFrame, n_groups: int, capacity: int = CAPACITY, id_col: str = "doc_id") -> DataFrame:
    """Add sequence_id and offset to pieces: gapless from 0 within a sequence, at most ``capacity`` in all.

    Groups are dealt by a hash of each row's number, so no document, source, length or repeated row gathers
    in one of them, and each is packed by one task whose memory the group's size bounds.  ``pieces`` has to
    be a written table, whose rows keep their numbers; then a lost task repeats the same placement, as rows
    are first ordered by a second hash; rows that tie are equal.  Ids stay in Arrow, so ids of any type,
    nulls and large numbers among them, come out as they were.
    """
    order = [id_col, "piece", "start", "length", "ids_crc32"]
    group, rank, row = (free_name(c, pieces.columns) for c in ("__group", "__rank", "__row"))
    columns = [F.col(f"`{c}`") for c in order]
    numbered = pieces.select(*columns, F.monotonically_increasing_id().alias(row))
    dealt = numbered.select(*columns, F.xxhash64(F.lit(1), *columns).alias(rank), F.pmod(F.xxhash64(row), F.lit(n_groups)).alias(group))
    schema = T.StructType([*dealt.schema.fields[:-2], T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def pack(table: pa.Table) -> pa.Table:
        number = table.column(group)[0].as_py()
        table = table.take(pc.sort_indices(table, [(c, "ascending") for c in (rank, "piece", "length", "ids_crc32")])).drop_columns([rank, group])
        bins, offsets = sum_of_squares(table.column("length").to_pylist(), capacity)
        table = table.append_column("sequence_id", pa.array([number << 36 | b for b in bins], pa.int64()))
        return table.append_column("offset", pa.array(offsets, pa.int64()))

    return dealt.groupBy(group).applyInArrow(pack, schema)


def pack_documents(
    docs: DataFrame,
    tokenizer_file: str,
    capacity: int = CAPACITY,
    id_col: str = "doc_id",
    text_col: str = "text",
    group_pieces: int = 20_000,
) -> DataFrame:
    """Pack all documents into sequences of at most ``capacity`` tokens.

    Returns one row per piece: ``id_col``, piece, start, length, ids_crc32, sequence_id, offset.  Null
    texts count as empty, ids of any type come out untouched (nulls too), repeated rows are packed each,
    an empty table gives no rows, very long texts are cut, other columns are not read.  An id column with
    the name of a result column is refused.  Only the small piece rows are shuffled, never a text.
    ``group_pieces`` bounds a task's work; a group wastes about one sequence, one in some thousands.
    """
    if id_col.lower() in ("piece", "start", "length", "ids_crc32", "sequence_id", "offset"):
        raise ValueError(f"the id column {id_col} has the name of a result column")
    with scratch(docs.sparkSession) as result:
        pieces = stage_out(cut_pieces(docs, tokenizer_file, capacity, id_col, text_col), "pieces")
        groups = max(1, -(-pieces.count() // group_pieces))
        return result(pack_pieces(pieces, groups, capacity, id_col), "packed")
