"""Fill-in-the-middle: a document's units are cut in three and put in another order between sentinels.

Where a unit begins is a predicate of two adjacent bytes, so a text falls into chunks that overlap by one
byte and are counted independently, all chunks of a batch of texts at once.  Prefix sums of the counts give
each text's number of units and lead both cuts to the chunks that own them; only those are scanned again.
Everything else (hashes, form, putting together, restoring) is Spark expressions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import text_or_empty

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Bytes of a chunk, and about how many are looked at in one go.
CHUNK, BLOCK = 4096, 1 << 20


def _blank(b: np.ndarray) -> np.ndarray:
    return (b == 32) | ((b >= 9) & (b <= 13))


#: Whether a unit begins at a byte, from the byte before and the byte itself.  Every text's first byte begins one.
UNITS: dict[str, Callable[[np.ndarray, np.ndarray], np.ndarray]] = {
    "codepoints": lambda before, here: (here & 0xC0) != 0x80,
    "words": lambda before, here: _blank(before) & ~_blank(here),  # a word and the blanks after it
    "lines": lambda before, here: before == 10,  # a line and its break
}


class Chunks:
    """Unit counts of the chunks of all texts of a batch; ``starts`` holds the texts' first bytes, then the end."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, units: str, chunk: int = CHUNK, block: int = BLOCK):
        self.data, self.starts, self.begins = data, starts, UNITS[units]
        sizes = np.diff(starts)
        per_text = -(-sizes // chunk)
        self.first = np.concatenate([[0], np.cumsum(per_text)])  # first chunk of each text
        within = np.arange(self.first[-1]) - np.repeat(self.first[:-1], per_text)
        self.at = np.concatenate([np.repeat(starts[:-1], per_text) + within * chunk, starts[-1:]])
        counts = np.zeros(len(self.at), dtype=np.int64)
        lo, n = 0, len(self.at) - 1
        while lo < n:  # as many chunks as make a block
            hi = min(n, max(lo + 1, int(np.searchsorted(self.at, self.at[lo] + block, "right")) - 1))
            flags = self._flags(lo, hi)
            counts[lo + 1 : hi + 1] = np.add.reduceat(flags, self.at[lo:hi] - self.at[lo], dtype=np.int64)
            lo = hi
        self.before = np.cumsum(counts)  # units before each chunk, in the whole batch
        self.units = np.diff(self.before[self.first])

    def _flags(self, lo: int, hi: int) -> np.ndarray:
        """Where units begin in chunks ``lo`` to ``hi``; the byte before the first of them is looked at too."""
        a, b = self.at[lo], self.at[hi]
        here = self.data[a:b]
        before = np.empty_like(here)
        before[1:] = here[:-1]
        before[:1] = self.data[a - 1] if a else 0
        flags = self.begins(before, here)
        texts = self.starts[np.searchsorted(self.starts, a) : np.searchsorted(self.starts, b)]
        flags[texts - a] = True
        return flags

    def offsets(self, texts: np.ndarray, ranks: np.ndarray) -> np.ndarray:
        """For each text and rank, the bytes of the text before its unit of that rank; its size if there is none."""
        out = np.diff(self.starts)[texts]
        inside = np.flatnonzero(ranks < self.units[texts])
        wanted = self.before[self.first[texts[inside]]] + ranks[inside]
        owners = np.searchsorted(self.before, wanted, "right") - 1
        for k, owner, rank in zip(inside, owners, wanted):
            place = np.flatnonzero(self._flags(owner, owner + 1))[rank - self.before[owner]]
            out[k] = self.at[owner] + place - self.starts[texts[k]]
        return out


def _parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column without nulls, and where each value starts in them, then the end."""
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    starts = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32, count=len(column) + 1, offset=column.offset * (8 if wide else 4)).astype(np.int64)
    return np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8), starts


def cut_points(slim: DataFrame, units: str, chunk: int = CHUNK) -> DataFrame:
    """``slim`` (last columns: text without nulls, longs h1 and h2) plus n and the bytes before both cuts, a <= b."""
    names = slim.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            text, h1, h2 = batch.columns[-3:]
            found = Chunks(*_parts(text), units, chunk)
            every, n = np.arange(batch.num_rows), found.units
            ranks = np.sort(np.stack([h1.to_numpy() % (n + 1), h2.to_numpy() % (n + 1)]), axis=0)
            made = [pa.array(x) for x in (n, found.offsets(every, ranks[0]), found.offsets(every, ranks[1]))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*names, "n", "a", "b"])

    extra = [T.StructField(c, T.LongType()) for c in ("n", "a", "b")]
    return slim.mapInArrow(run, T.StructType([*slim.schema.fields, *extra]))


def fill_in_middle(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", units: str = "codepoints", seed: int = 1, rate: int = 90, spm_rate: int = 20
) -> DataFrame:
    """One row per row of ``docs``: ``id_col``, n (units), form, prefix_chars, middle_chars, output.

    A document's hash, from ``seed`` and its id, cuts it before two units; ``rate`` percent are rearranged
    (psm, or spm for ``spm_rate`` percent of those), unless a text is empty or holds a sentinel; the others
    are plain, with null lengths.

    A null text counts as empty and a null id as the empty string; rows with the same id are cut alike if
    their texts are equal; an empty table gives no rows; other columns are not read, whatever their names.
    An id column named like a result column is refused.
    """
    if id_col.lower() in ("n", "form", "prefix_chars", "middle_chars", "output"):
        raise ValueError(f"the id column {id_col} has the name of a result column")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))), 256)
    h1, h2, h3, h4 = (F.conv(F.substring("d", 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4))
    read = docs.select(F.col(f"`{id_col}`").alias("id"), digest.alias("d"), text_or_empty(f"`{text_col}`").cast("string").alias("text"))
    special = F.lit(False)
    for mark in (PREFIX, SUFFIX, MIDDLE):
        special = special | F.contains("text", F.lit(mark))
    form = F.when((F.col("text") == "") | special | (h3 % 100 >= rate), "plain").when(h4 % 100 < spm_rate, "spm").otherwise("psm")
    cut = cut_points(read.select("id", form.alias("form"), "text", h1.alias("h1"), h2.alias("h2")), units)
    raw, a, b = F.col("text").cast("binary"), F.col("a").cast("int"), F.col("b").cast("int")
    end = F.octet_length("text")
    parts = cut.select(
        "id",
        "n",
        "form",
        "text",
        F.substring(raw, F.lit(1), a).cast("string").alias("prefix"),
        F.substring(raw, a + 1, b - a).cast("string").alias("middle"),
        F.substring(raw, b + 1, end - b).cast("string").alias("suffix"),
    )
    moved = F.col("form") != "plain"
    output = (
        F.when(F.col("form") == "psm", F.concat(F.lit(PREFIX), "prefix", F.lit(SUFFIX), "suffix", F.lit(MIDDLE), "middle"))
        .when(F.col("form") == "spm", F.concat(F.lit(SUFFIX), "suffix", F.lit(PREFIX), "prefix", F.lit(MIDDLE), "middle"))
        .otherwise(F.col("text"))
    )
    return parts.select(
        F.col("id").alias(id_col),
        "n",
        "form",
        F.when(moved, F.char_length("prefix").cast("long")).alias("prefix_chars"),
        F.when(moved, F.char_length("middle").cast("long")).alias("middle_chars"),
        output.alias("output"),
    )


def restored(output: Column, form: Column) -> Column:
    """The document again: no sentinel overlaps itself or another, and a rearranged text holds none of its own."""

    def between(first: str, last: str | None) -> Column:
        after = F.substring(output, F.locate(first, output) + len(first), F.char_length(output))
        return after if last is None else F.substring(output, F.locate(first, output) + len(first), F.locate(last, output) - F.locate(first, output) - len(first))

    def joined(prefix_end: str, suffix_end: str) -> Column:
        return F.concat(between(PREFIX, prefix_end), between(MIDDLE, None), between(SUFFIX, suffix_end))

    return F.when(form == "psm", joined(SUFFIX, MIDDLE)).when(form == "spm", joined(MIDDLE, PREFIX)).otherwise(output)


def digests(made: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row per row of :func:`fill_in_middle`: its numbers, and hashes of the output and of the text restored from it."""
    return made.select(
        id_col,
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )
