"""Personal data: exact base patterns, and identifiers that bootstrapped contexts add.

Base spans of four kinds come from fixed patterns.  They are the seeds: the words to their left and right
become lexical patterns; a word is a whole run of letters and digits of the text, the same where patterns are
made and where their words are counted, so a word that a span cuts is none.  Tokens that look only loosely like an identifier are candidates.  Patterns and
instances form a bipartite graph that Spark scores in rounds: a pattern by the share of all its word's
occurrences that stand at known instances of a kind (with enough different ones), an instance by the
patterns it is seen in.  Candidates that reach the threshold join the known instances of the next round,
and their occurrences become spans; rounds go on until none is new.  Base spans always stay.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import count as count_up

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import free_name, map_texts, scratch, stage_out, text_or_empty

KINDS = ["email", "ip", "card", "phone"]
#: Bits of the filter of words to count.
WORD_SLOTS = 1 << 20
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"

_domain = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+").match
# A start inside a run of digits matches no better than the run's own start, so only that is tried.
_ip = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}").finditer
_card = re.compile(r"[0-9](?:[\x20-]?[0-9])++").finditer
_phone = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]").finditer
_digit = re.compile(r"[0-9]").search
_not_digit = re.compile(r"[^0-9]+")
_word = re.compile(r"\w+").finditer
_words = re.compile(r"\w+").findall
_word_sign = re.compile(r"\w").match

# Loose shapes of candidates, tried in this order.
_loose = [
    (0, re.compile(r"[^\s@]+@[^\s@]+").fullmatch),
    (1, re.compile(r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}|(?:[0-9A-Fa-f]{0,4}:){3,7}[0-9A-Fa-f]{1,4}").fullmatch),
    (2, re.compile(r"(?:[0-9]-?){13,19}").fullmatch),
    (3, re.compile(r"(?:[().+/-]*[0-9]){7,15}").fullmatch),
]

SPANS = "array<struct<kind:int,start:int,stop:int>>"


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        if i % 2:
            n = n * 2 - 9 if n > 4 else n * 2
        total += n
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost local part before each @, not reaching into the match before; linear in the text."""
    floor, at = 0, text.find("@")
    while at >= 0:
        head = text[floor:at]
        local = len(head) - len(head.rstrip(LOCAL))
        found = _domain(text, at + 1) if local else None
        if found:
            yield at - local, found.end()
            floor = found.end()
        else:
            floor = at + 1
        at = text.find("@", max(floor, at + 1))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, stop) in code points, by kind and then start."""
    out = []
    if "@" in text:
        out += [(0, a, b) for a, b in _emails(text)]
    if _digit(text):
        for m in _ip(text):
            if all(len(p) <= 3 and int(p or "0") <= 255 for p in (x.lstrip("0") for x in m.group().split("."))):
                out.append((1, m.start(), m.end()))
        for m in _card(text):
            digits = m.group().replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append((2, m.start(), m.end()))
        if "+" in text:
            for m in _phone(text):
                if 8 <= len(_not_digit.sub("", m.group())) <= 15:
                    out.append((3, m.start(), m.end()))
    return out


def _cut(text: str, at: int) -> bool:
    """Whether a word goes on across a place."""
    return 0 < at < len(text) and _word_sign(text[at - 1]) is not None and _word_sign(text[at]) is not None


def _near(text: str, start: int, stop: int) -> tuple[str | None, str | None]:
    """The words before and after, in lower case, whole at any length; only as much text is looked at as it takes.

    Words are those of the whole text, as they are counted: where the span cuts one, it has none on that side.
    """
    left = right = None
    size = 64
    while left is None and not _cut(text, start):
        lo = max(0, start - size)
        last = None
        for last in _word(text[lo:start]):
            pass
        if last and (last.start() or not lo):
            left = last.group().lower()
        elif not lo:
            break
        size *= 4
    size = 64
    while right is None and not _cut(text, stop):
        hi = min(len(text), stop + size)
        first = next(_word(text[stop:hi]), None)
        if first and (stop + first.end() < hi or hi == len(text)):
            right = first.group().lower()
        elif hi == len(text):
            break
        size *= 4
    return left, right


def occurrences(text: str, spans: list[tuple[int, int, int]]) -> list[tuple]:
    """(kind, start, stop, instance, known, left, right) of base spans and of candidates that touch none."""
    out = [(k, a, b, text[a:b].lower(), True, *_near(text, a, b)) for k, a, b in spans]
    if not (_digit(text) or "@" in text):
        return out
    taken = sorted((a, b) for _, a, b in spans)
    at = 0
    for m in re.finditer(r"\S+", text):
        word = m.group()
        if not ("@" in word or _digit(word)):
            continue
        core = word.strip(".,;:!?\"'()[]<>")
        start = m.start() + word.find(core) if core else m.start()
        stop = start + len(core)
        while at < len(taken) and taken[at][1] <= m.start():
            at += 1
        if any(a < stop and start < b for a, b in taken[max(0, at - 1) : at + 4]):
            continue
        for kind, fits in _loose:
            if fits(core):
                out.append((kind, start, stop, core.lower(), False, *_near(text, start, stop)))
                break
    return out


_OCC = "array<struct<kind:int,start:int,stop:int,inst:string,known:boolean,left:string,right:string>>"


def _scan(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, th, base, occ) of all documents; th is a hash of the text."""
    text = text_or_empty(text_col)
    slim = docs.select(F.col(id_col).alias("id"), F.xxhash64(text, F.length(text)).alias("th"), text.alias("text"))
    names = ("kind", "start", "stop", "inst", "known", "left", "right")

    def make() -> Callable:
        def work(texts: list[str], _: list) -> list[tuple]:
            out = []
            for x in texts:
                spans = base_spans(x)
                out.append(([{"kind": k, "start": a, "stop": b} for k, a, b in spans], [dict(zip(names, o)) for o in occurrences(x, spans)]))
            return out

        return work

    return map_texts(slim, ["id", "th"], "text", make, f"base {SPANS}, occ {_OCC}")


class _Wanted(dict):
    """A word in lower case, or None where its slot of the filter is empty."""

    def __init__(self, bits: bytes):
        super().__init__()
        self.bits = bits

    def __missing__(self, word: str) -> str | None:
        if len(self) > 500_000:
            self.clear()
        low = word.lower()
        slot = xxhash.xxh64_intdigest(low, seed=42) & (WORD_SLOTS - 1)
        hit = self[word] = low if self.bits[slot >> 3] >> (slot & 7) & 1 else None
        return hit


def word_filter(words: DataFrame) -> bytes:
    """One bit for each hash slot that a word falls into; its size is fixed, and so is the number of rows collected."""
    slot = F.xxhash64("word").bitwiseAND(WORD_SLOTS - 1)
    blocks = words.select(F.shiftright(slot, 6).cast("int").alias("block"), F.expr("shiftleft(1L, cast(xxhash64(word) & 63 AS int))").alias("bit")).groupBy("block").agg(F.bit_or("bit").alias("bits"))
    table = np.zeros(WORD_SLOTS // 64, dtype="<i8")
    for r in blocks.collect():  # at most WORD_SLOTS / 64 rows
        table[r["block"]] = r["bits"]
    return table.tobytes()


def count_words(docs: DataFrame, text_col: str, words: DataFrame) -> DataFrame:
    """(word, total) over all texts for the given words.

    A filter of fixed size, one bit for each hash slot, goes to the tasks, so they count little else.
    """
    wanted = docs.sparkSession.sparkContext.broadcast(word_filter(words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hit, counts = _Wanted(wanted.value), Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])
            counts.clear()
            return out

        for batch in batches:
            for x in batch.column(0).to_pylist():
                counts.update(filter(None, map(hit.__getitem__, _words(x))))
                if len(counts) > 400_000:
                    yield flush()
        yield flush()

    counted = docs.select(text_or_empty(text_col).alias("text")).mapInArrow(run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("total")).join(words, "word", "left_semi")


def bootstrap(occ: DataFrame, count: Callable[[DataFrame], DataFrame], min_support: int = 5, min_precision: float = 0.2, accept: float = 0.5) -> DataFrame:
    """Accepted candidates as (kind, inst), from occurrences; ``count`` gives (word, total) of a table of words.

    A pattern (side, word, kind) is trusted with at least ``min_support`` different known instances and
    ``min_precision`` of the word's occurrences; an instance scores 1 - product of (1 - precision).
    Known instances only become more, so the rounds end: after the first that adds none.
    """
    sides = F.array(F.struct(F.lit("L").alias("side"), F.col("left").alias("word")), F.struct(F.lit("R").alias("side"), F.col("right").alias("word")))
    edges = stage_out(
        occ.select("kind", "inst", "known", F.explode(sides).alias("s"))
        .where("s.word is not null")
        .groupBy("kind", "inst", "known", "s.side", "s.word")
        .agg(F.count("*").alias("times")),
        "pii-edges",
    )
    # A pattern can come to admit an instance only if it has candidates and enough instances in all.
    hopeful = edges.groupBy("kind", "side", "word").agg(F.count("*").alias("n"), F.count_if(~F.col("known")).alias("open")).where((F.col("n") > min_support) & (F.col("open") > 0))
    hopeful = stage_out(hopeful.select("kind", "side", "word"), "pii-hopeful")
    accepted = edges.sparkSession.createDataFrame([], "kind int, inst string")
    if hopeful.isEmpty():
        return accepted
    useful = stage_out(edges.join(hopeful, ["kind", "side", "word"], "left_semi"), "pii-useful")
    totals = stage_out(count(hopeful.select("word").distinct()), "pii-totals")
    for k in count_up():
        known = useful.where("known").select("kind", "inst", "side", "word", "times")
        known = known.union(useful.where("not known").join(accepted, ["kind", "inst"], "left_semi").select("kind", "inst", "side", "word", "times"))
        patterns = (
            known.groupBy("kind", "side", "word")
            .agg(F.count("*").alias("support"), F.sum("times").alias("hits"))
            .where(F.col("support") >= min_support)
            .join(totals, "word")
            .withColumn("precision", F.col("hits") / F.col("total"))
            .where(F.col("precision") >= min_precision)
        )
        scores = (
            useful.where("not known")
            .join(patterns.select("kind", "side", "word", "precision"), ["kind", "side", "word"])
            .groupBy("kind", "inst")
            .agg((1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("precision"), F.lit(1e-9)))))).alias("score"))
            .where(F.col("score") >= accept)
        )
        new = stage_out(scores.select("kind", "inst").union(accepted).distinct(), f"pii-known-{k}")
        grown = new.count() > accepted.count()
        accepted = new
        if not grown:
            return accepted


def _found(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Tables of the base spans of all rows, and of spans that the contexts add by document key (id, th, added)."""
    with scratch(docs.sparkSession) as result:
        rows = stage_out(_scan(docs, id_col, text_col), "pii-scan")
        occ = rows.select("id", "th", F.explode("occ").alias("o")).select("id", "th", "o.*")
        accepted = bootstrap(occ, lambda words: count_words(docs, text_col, words))
        hits = occ.where("not known").join(accepted, ["kind", "inst"], "left_semi")
        added = result(hits.groupBy("id", "th").agg(F.sort_array(F.collect_set(F.struct("kind", "start", "stop"))).alias("added")), "pii-added")
        return result(rows.select("id", "th", "base"), "pii-base"), added


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``id_col``, base and added spans (kind, start, stop in code points).

    Null texts count as empty and have no spans; rows with the same id and the same text come out alike; a
    null id is kept; an empty table gives no rows; other columns are not read.  Texts, words and
    candidates of any length are taken whole, in linear time.
    """
    found, added = _found(docs, id_col, text_col)
    added = added.withColumnsRenamed({"id": "__id", "th": "__th"})
    joined = found.join(added, found["id"].eqNullSafe(added["__id"]) & (found["th"] == added["__th"]), "left")
    return joined.select(F.col("id").alias(id_col), "base", F.coalesce("added", F.array().cast(SPANS)).alias("added"))


def _listed(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row per row of :func:`find_personal_data`: base counts by kind, a hash of the base spans, and all spans listed.

    A row without spans has zeros, the hash of the empty string and an empty list; an empty table gives no rows.
    """

    def tally(kind: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")

    counts = [tally(k).alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return found.select(id_col, *counts, F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(F.sort_array(F.concat("base", "added"))).alias("spans"))


def redact_text(text: str, spans: list[tuple[int, int, int]]) -> str:
    """``text`` with each span, or run of overlapping spans, replaced by the name of its first kind."""
    out, at, stop = [], 0, -1
    for a, b, kind in sorted((a, b, k) for k, a, b in spans):
        if a < stop:
            if b > stop:
                at = stop = b
            continue
        out += [text[at:a], f"<{KINDS[kind].upper()}>"]
        at = stop = b
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", broadcast_rows: int = 10_000) -> DataFrame:
    """``docs`` with all personal data replaced by its kind's name; every column kept, null texts stay null.

    Repeated rows come out alike, each; a null id is a document like others; an empty table gives no
    rows; columns may have any names.  Added spans are joined by the document's key: broadcast if there
    are at most ``broadcast_rows`` documents with any and ten times as many spans, else by a shuffle.
    """
    names = docs.columns
    key, other, th, more = (free_name(c, names) for c in ("__key", "__id", "__th", "__added"))
    added = _found(docs, id_col, text_col)[1].withColumnsRenamed({"id": other, "th": th, "added": more})
    n, spans = added.agg(F.count("*"), F.sum(F.size(more))).first()
    few = n <= broadcast_rows and (spans or 0) <= 10 * broadcast_rows
    text = text_or_empty(text_col)
    keyed = docs.withColumn(key, F.xxhash64(text, F.length(text)))
    matched = F.col(f"`{id_col}`").eqNullSafe(F.col(other)) & (F.col(key) == F.col(th))
    joined = keyed.join(F.broadcast(added) if few else added, matched, "left")
    place = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            more = batch.column(len(names)).to_pylist()
            texts = [
                x if x is None else redact_text(x, [*base_spans(x), *[(s["kind"], s["start"], s["stop"]) for s in add or ()]])
                for x, add in zip(batch.column(place).to_pylist(), more)
            ]
            columns = list(batch.columns[: len(names)])
            columns[place] = pa.array(texts, type=columns[place].type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return joined.select(*[F.col(f"`{c}`") for c in names], more).mapInArrow(run, docs.schema)
