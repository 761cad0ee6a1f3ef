"""Near-duplicate documents: consistent weighted sampling over TF-IDF shingles, banded, verified.

1. Exact copies (same words in the same order) meet by key and are one node from there on.
2. Document frequencies of five-word shingles go into a count-min sketch of fixed size over all documents.
   A weight is term frequency times ln(1 + N / (df + N / 4)); the sketch errs by a fixed share of N at
   any size of the corpus, far below that pseudo-count.
3. Improved consistent weighted sampling draws 64 samples of a document's weighted shingles; 16 bands of
   four are its buckets.
4. In a bucket every member is compared with the bucket's leader.  Members that stay apart from it are
   compared with all others of another component: in small buckets pair by pair, in larger ones block by block
   in matrix products, so that no pair becomes a row.  Nothing is left out but pairs already in one component.
5. A pair is linked if its weighted Jaccard similarity, from all shingles, is at least 0.8.  Classes are
   the connected components.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import connected_components, free_name, map_texts, roots, scratch, stage_out, text_or_empty

WORDS = 5
THRESHOLD = 0.8
BANDS, ROWS = 16, 4
#: Buckets of more members than this are compared in blocks of about so many documents and bytes.
FEW = 8
BLOCK_ROWS, BLOCK_BYTES = 256, 2_000_000
#: Shingle levels that one matrix product covers, and its rounding; pairs within that are looked at again.
WIDE, SLACK = 4096, 1e-4
SKETCH_WIDTH, SKETCH_DEPTH = 1 << 16, 2
SKETCH_BLOCK = 32
#: Share of the corpus added to each document frequency: idf lies between ln 5 (found nowhere) and ln 1.8 (everywhere).
PSEUDO = 0.25
#: Weights lie on the grid 2 ** (level / LEVELS_PER_OCTAVE).  The lowest is that of a shingle found once here
#: and everywhere else; from there a byte reaches beyond the shingles that the longest text of 2 GB can repeat.
LEVELS_PER_OCTAVE, LOWEST, HIGHEST = 8, -12, 243
TABLE_BITS = 16
SEED = 20240607

_find = re.compile(r"\w+").findall


class _WordHashes(dict):
    def __missing__(self, word: str) -> int:
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


@lru_cache(maxsize=1)
def _word_hashes() -> _WordHashes:
    return _WordHashes()


def word_hashes(text: str) -> np.ndarray:
    cache = _word_hashes()
    if len(cache) > 1_000_000:
        cache.clear()
    words = _find(text.lower())
    return np.fromiter(map(cache.__getitem__, words), dtype=np.uint64, count=len(words))


def shingle_hashes(hashes: np.ndarray, words: int = WORDS) -> np.ndarray:
    """Hashes of all runs of ``words`` words, in order; a shorter text with words is one shingle."""
    n = len(hashes)
    if n == 0:
        return hashes
    span = min(words, n)
    out = hashes[: n - span + 1].copy()
    for j in range(1, span):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out += hashes[j : n - span + 1 + j]
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xD6E8FEB86659FD93)
    out ^= out >> np.uint64(29)
    return out


def _slots(shingles: np.ndarray) -> list[np.ndarray]:
    a = (shingles & np.uint64(SKETCH_WIDTH - 1)).astype(np.int64)
    b = ((shingles >> np.uint64(24)) & np.uint64(SKETCH_WIDTH - 1)).astype(np.int64) + SKETCH_WIDTH
    return [a, b][:SKETCH_DEPTH]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _first_pass(slim: DataFrame) -> DataFrame:
    """(id, th, k1, k2) of each row, the key null without words, and each task's sketch in blocks as (block, counts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(SKETCH_DEPTH * SKETCH_WIDTH, dtype=np.int64)
        names = ["id", "th", "k1", "k2", "block", "counts"]
        for batch in batches:
            k1, k2 = [], []
            for text in batch.column(2).to_pylist():
                hashes = word_hashes(text)
                if not len(hashes):
                    k1.append(None)
                    k2.append(None)
                    continue
                key = xxhash.xxh3_128_intdigest(hashes.tobytes())
                k1.append(_signed(key >> 64))
                k2.append(_signed(key & ((1 << 64) - 1)))
                for slots in _slots(np.unique(shingle_hashes(hashes))):
                    np.add.at(sketch, slots, 1)
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.list_(pa.int64()))], names=names)
        blocks = sketch.reshape(-1, SKETCH_BLOCK)
        full = np.flatnonzero(blocks.any(axis=1))
        none = pa.nulls(len(full), pa.int64())
        yield pa.RecordBatch.from_arrays([none, none, none, none, pa.array(full, pa.int32()), pa.array(list(blocks[full]), pa.list_(pa.int64()))], names=names)

    return slim.mapInArrow(run, "id long, th long, k1 long, k2 long, block int, counts array<long>")


def idf_table(sketch_blocks: DataFrame, n_docs: int) -> np.ndarray:
    """Relative inverse document frequencies (1 for a shingle found nowhere) by sketch slot; its size is fixed."""
    sums = sketch_blocks.groupBy("block").agg(*[F.sum(F.col("counts")[i]).alias(f"c{i}") for i in range(SKETCH_BLOCK)])
    df = np.zeros((SKETCH_DEPTH * SKETCH_WIDTH // SKETCH_BLOCK, SKETCH_BLOCK))
    for row in sums.collect():  # at most 4096 rows
        df[row["block"]] = row[1:]
    n = max(1, n_docs)
    return (np.log1p(n / (df.ravel() + PSEUDO * n)) / np.log1p(1 / PSEUDO)).astype(np.float32)


def weighted_shingles(hashes: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles in order, and the levels of their TF-IDF weights."""
    shingles, tf = np.unique(shingle_hashes(hashes), return_counts=True)
    slots = _slots(shingles)
    rare = idf[slots[0]]
    for s in slots[1:]:
        rare = np.maximum(rare, idf[s])  # the least count is the nearest
    levels = np.rint(LEVELS_PER_OCTAVE * np.log2(tf * rare))
    return shingles, np.clip(levels, LOWEST, HIGHEST).astype(np.int16)


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64(SEED))
    size = 1 << TABLE_BITS
    r, c, beta = rng.gamma(2, 1, size), rng.gamma(2, 1, size), rng.uniform(0, 1, size)
    odd = rng.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return r, np.log(c), beta, odd


@lru_cache(maxsize=256)
def _level(level: int) -> tuple[np.ndarray, np.ndarray]:
    """ln a and t of each table entry at a weight level."""
    r, log_c, beta, _ = _tables()
    t = np.floor(level / LEVELS_PER_OCTAVE * np.log(2) / r + beta)
    return (log_c - r * (t - beta + 1)).astype(np.float32), t.astype(np.int64)


def band_keys(shingles: np.ndarray, levels: np.ndarray) -> list[int]:
    """One bucket key per band.  Equal ln a go to the smaller shingle, which is consistent too."""
    _, _, _, odd = _tables()
    k = len(odd)
    kinds = np.unique(levels)
    best, pick, turn = np.full(k, np.inf, dtype=np.float32), np.zeros(k, dtype=np.uint64), np.zeros(k, dtype=np.int64)
    for kind in kinds:
        log_a, t = _level(int(kind))
        own = shingles if len(kinds) == 1 else shingles[levels == kind]
        for at in range(0, len(own), 4096):
            part = own[at : at + 4096]
            index = (odd[:, None] * part[None, :]) >> np.uint64(64 - TABLE_BITS)
            a = log_a[index]
            j = a.argmin(axis=1)
            low = a[np.arange(k), j]
            better = (low < best) | ((low == best) & (part[j] < pick))
            best = np.where(better, low, best)
            pick = np.where(better, part[j], pick)
            turn = np.where(better, t[index[np.arange(k), j]], turn)
    sample = pick * np.uint64(0x9E3779B97F4A7C15) ^ turn.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    data = sample.reshape(BANDS, ROWS)
    return [_signed(xxhash.xxh64_intdigest(data[b].tobytes(), seed=b + 1)) for b in range(BANDS)]


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Sum of minima over sum of maxima of two documents' weights (shingles in order, levels)."""
    wa, wb = np.exp2(a[1] / LEVELS_PER_OCTAVE), np.exp2(b[1] / LEVELS_PER_OCTAVE)
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    shared = np.minimum(wa[i], wb[j]).sum()
    total = wa.sum() + wb.sum() - shared
    return float(shared / total) if total else 0.0


def _payload(shingles: np.ndarray, levels: np.ndarray) -> bytes:
    """Upper halves of the shingles in order, then the levels above the lowest."""
    return (shingles >> np.uint64(32)).astype("<u4").tobytes() + (levels - LOWEST).astype(np.uint8).tobytes()


def _unpack(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(data) // 5
    high, levels = np.frombuffer(data, dtype="<u4", count=n), np.frombuffer(data, dtype=np.uint8, offset=4 * n).astype(np.int16) + LOWEST
    if n > 1 and (high[1:] == high[:-1]).any():  # halves that coincide stay apart by their place
        rank = np.arange(n) - np.searchsorted(high, high)
        return high.astype(np.uint64) << np.uint64(32) | rank.astype(np.uint64), levels
    return high.astype(np.uint64) << np.uint64(32), levels


def _verify(spark: SparkSession, pairs: DataFrame, payloads: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) that are similar enough."""
    left = payloads.select(F.col("id").alias("a"), F.col("payload").alias("pa"))
    right = payloads.select(F.col("id").alias("b"), F.col("payload").alias("pb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [i for i, (x, y) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())) if weighted_jaccard(_unpack(x), _unpack(y)) >= threshold]
            at = pa.array(keep, type=pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at)], names=["a", "b"])

    return pairs.join(left, "a").join(right, "b").select("a", "b", "pa", "pb").mapInArrow(run, "a long, b long")


def alike(a: list[tuple[np.ndarray, np.ndarray]], b: list[tuple[np.ndarray, np.ndarray]], threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the documents (shingles in order, levels) of two lists that are similar enough; all pairs are compared.

    A sum of minima is a product: each level that a shingle has anywhere is a column, a document has those up
    to its own level, and a column weighs what its level adds to the one below.
    """
    totals = [np.array([np.exp2(levels / LEVELS_PER_OCTAVE).sum() for _, levels in docs]) for docs in (a, b)]
    sides = [(np.concatenate([d[0] for d in docs]), np.concatenate([d[1] for d in docs]).astype(np.int64), np.repeat(np.arange(len(docs)), [len(d[0]) for d in docs])) for docs in (a, b)]
    common = np.intersect1d(sides[0][0], sides[1][0])
    shared = np.zeros((len(a), len(b)))
    if len(common):
        keyed = []
        for shingles, levels, row in sides:
            at = np.minimum(np.searchsorted(common, shingles), len(common) - 1)
            both = common[at] == shingles
            keyed.append((at[both] << 8 | levels[both] - LOWEST, row[both]))
        columns = np.unique(np.concatenate([k for k, _ in keyed]))
        of, weight = columns >> 8, np.exp2(((columns & 255) + LOWEST) / LEVELS_PER_OCTAVE)
        first = np.searchsorted(of, of)
        step = (weight - np.where(first == np.arange(len(of)), 0, np.roll(weight, 1))).astype(np.float32)
        spread = []
        for key, row in keyed:
            own = np.searchsorted(columns, key)
            n = own - first[own] + 1
            column = np.repeat(first[own] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            order = np.argsort(column, kind="stable")
            spread.append((column[order], np.repeat(row, n)[order]))
        for lo in range(0, len(columns), WIDE):
            dense = []
            for (column, row), docs in zip(spread, (a, b)):
                p, q = np.searchsorted(column, [lo, lo + WIDE])
                x = np.zeros((len(docs), min(WIDE, len(columns) - lo)), dtype=np.float32)
                x[row[p:q], column[p:q] - lo] = 1
                dense.append(x)
            shared += (dense[0] * step[lo : lo + WIDE]) @ dense[1].T
    similarity = shared / np.maximum(totals[0][:, None] + totals[1] - shared, 1e-300)
    i, j = np.nonzero(similarity >= threshold - SLACK)
    good = similarity[i, j] >= threshold + SLACK
    for k in np.flatnonzero(~good):
        good[k] = weighted_jaccard(a[i[k]], b[j[k]]) >= threshold
    return i[good], j[good]


def _compare_blocks(blocks: DataFrame, threshold: float) -> DataFrame:
    """Links (a, b) between the components in pairs of blocks (bucket, apart, cell, docs) that have one apart: a forest of each pair."""
    cells = blocks.select("bucket", "apart", "cell")
    other = cells.select("bucket", F.col("apart").alias("apart2"), F.col("cell").alias("cell2"))
    pairs = stage_out(cells.where("apart").join(other, "bucket").where("not apart2 or cell <= cell2").select("bucket", "cell", "apart2", "cell2"), "near-block-pairs")
    one = blocks.where("apart").select("bucket", "cell", F.col("docs").alias("one"))
    two = blocks.select("bucket", F.col("apart").alias("apart2"), F.col("cell").alias("cell2"), F.col("docs").alias("two"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                one, two = (batch.column(c)[k].as_py() for c in (0, 1))
                i, j = alike([_unpack(d["payload"]) for d in one], [_unpack(d["payload"]) for d in two], threshold)
                both = one + two
                ids, component = (np.array([d[c] for d in both], dtype=np.int64) for c in ("id", "component"))
                j = j + len(one)
                new = component[i] != component[j]
                _, node = np.unique(component, return_inverse=True)
                root = roots(int(node.max()) + 1, node[i[new]], node[j[new]])[node]
                _, least = np.unique(node, return_index=True)  # a document of each component
                moved = np.flatnonzero(root != node)
                yield pa.RecordBatch.from_arrays([pa.array(ids[moved]), pa.array(ids[least[root[moved]]])], names=["a", "b"])

    joined = pairs.join(one, ["bucket", "cell"]).join(two, ["bucket", "apart2", "cell2"]).select("one", "two")
    return joined.mapInArrow(run, "a long, b long")


def _link_buckets(spark: SparkSession, banded: DataFrame, fetch: Callable[[DataFrame], DataFrame], threshold: float) -> DataFrame:
    """Components (id, component) of the links found between documents (id, bands) that share buckets.

    Every member of a bucket is compared with its leader.  Those whose component then is another are apart;
    they are compared with each other and with the members that are not apart.
    """
    members = banded.select("id", F.explode("bands").alias("bucket"))
    order = F.xxhash64("bucket", "id")  # another order in each bucket, so the leaders differ
    leader = members.groupBy("bucket").agg(F.min(F.struct(order.alias("o"), F.col("id"))).alias("l"), F.count("*").alias("n")).where("n > 1").select("bucket", F.col("l.id").alias("leader"))
    leader = stage_out(leader, "near-leaders")  # so that the join with it can part a bucket
    pairing = stage_out(members.join(leader, "bucket").where("id <> leader"), "near-members")  # only buckets of two and more
    payloads = fetch(pairing.select("id").union(pairing.select(F.col("leader").alias("id"))).distinct())
    labels = stage_out(payloads.select("id", F.col("id").alias("component")), "near-labels")
    tested = None

    def join(good: DataFrame, tag: str) -> None:
        """Join the components of linked documents (a, b)."""
        nonlocal labels
        # Only components that a new link joins are worked on, and only then relabelled.
        by = lambda c: labels.select(F.col("id").alias(c), F.col("component").alias(f"c{c}"))
        joined = connected_components(good.join(by("a"), "a").join(by("b"), "b").select(F.col("ca").alias("a"), F.col("cb").alias("b")), f"near-joined-{tag}")
        moved = joined.select(F.col("id").alias("component"), F.col("component").alias("now"))
        labels = stage_out(labels.join(moved, "component", "left").select("id", F.coalesce("now", "component").alias("component")), f"near-labels-{tag}")

    def compare(pairing: DataFrame, tag: str) -> None:
        """Test the pairs (id, leader) that are new, and join the components of those that link."""
        nonlocal tested
        fresh = pairing.select(F.greatest("id", "leader").alias("a"), F.least("id", "leader").alias("b")).distinct()
        tested = stage_out(fresh if tested is None else fresh.join(tested, ["a", "b"], "left_anti"), f"near-pairs-{tag}")
        join(stage_out(_verify(spark, tested, payloads, threshold), f"near-links-{tag}"), tag)

    def unsettled(tag: str) -> tuple[DataFrame, DataFrame]:
        """Members (bucket, id, component, apart) of buckets of three and more with some apart from the leader, and the sizes n."""
        lead = pairing.select("bucket", F.col("leader").alias("id")).distinct().join(labels, "id")
        others = pairing.select("bucket", "id").join(labels, "id").join(lead.select("bucket", F.col("component").alias("first")), "bucket")
        all_members = others.select("bucket", "id", "component", (F.col("component") != F.col("first")).alias("apart")).union(lead.select("bucket", "id", "component", F.lit(False)))
        held = stage_out(all_members, f"near-held-{tag}")
        return held, held.groupBy("bucket").agg(F.count("*").alias("n"), F.max("apart").alias("any")).where("any and n > 2").select("bucket", "n")

    compare(pairing, "leader")
    held, sizes = unsettled("few")
    few = stage_out(held.join(sizes.where(F.col("n") <= FEW), "bucket").select("bucket", "id", "component", "apart"), "near-few")
    mate = few.select("bucket", F.col("id").alias("leader"), F.col("component").alias("other"), F.col("apart").alias("apart2"))
    compare(few.where("apart").join(mate, "bucket").where("component <> other and (not apart2 or id < leader)").select("id", "leader"), "few")
    held, sizes = unsettled("blocks")
    large = held.join(sizes.where(F.col("n") > FEW), "bucket").select("bucket", "id", "component", "apart")
    large = stage_out(large.join(payloads.select("id", F.length("payload").alias("size")), "id"), "near-large")
    cut = large.groupBy("bucket", "apart").agg(F.ceil(F.greatest(F.count("*") / BLOCK_ROWS, F.sum("size") / BLOCK_BYTES)).alias("cells"))
    cut = stage_out(cut, "near-cut")  # so that a bucket's rows need not meet for the join
    cell = F.pmod(F.xxhash64("id"), F.greatest("cells", F.lit(1)))
    dealt = stage_out(large.join(cut, ["bucket", "apart"]).select("bucket", "apart", cell.alias("cell"), "id", "component"), "near-dealt")
    doc = F.struct("id", "component", "payload")
    blocks = stage_out(dealt.join(payloads, "id").groupBy("bucket", "apart", "cell").agg(F.collect_list(doc).alias("docs")), "near-blocks")
    join(stage_out(_compare_blocks(blocks, threshold), "near-links-blocks"), "blocks")
    return labels


def _classes(docs: DataFrame, id_col: str, text_col: str, threshold: float) -> DataFrame:
    """A table of all rows with an id: id, th (hash of the text), class_id, kept (stands for its class).

    A node is a distinct sequence of words, whatever ids its rows have, so rows of one id with other texts
    never join classes or lose each other.
    """
    spark = docs.sparkSession
    text = text_or_empty(text_col)
    slim = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.xxhash64(text).alias("th"), text.alias("text")).where("id is not null")
    with scratch(spark) as result:
        first = stage_out(_first_pass(slim), "near-first")
        rows = first.where("block is null").select("id", "th", "k1", "k2")
        idf = idf_table(first.where("block is not null").select("block", "counts"), rows.where("k1 is not null").count())
        shared_idf = spark.sparkContext.broadcast(idf)

        # Nodes get numbers when their table is written; their representative is the row of the smallest id.
        place = F.struct("id", "th")
        groups = rows.where("k1 is not null").groupBy("k1", "k2").agg(F.min(place).alias("rep"))
        groups = stage_out(groups.select("k1", "k2", "rep", F.monotonically_increasing_id().alias("node")), "near-groups")

        def make() -> Callable:
            seen: set[int] = set()
            idf = shared_idf.value

            def work(texts: list[str], kept: list) -> list[tuple]:
                out = []
                for text in texts:
                    hashes = word_hashes(text)
                    key = xxhash.xxh3_128_intdigest(hashes.tobytes())
                    if not len(hashes) or key in seen:  # a copy's buckets are those of the first
                        out.append((None, None, None))
                        continue
                    if len(seen) > 1_000_000:
                        seen.clear()
                    seen.add(key)
                    out.append((_signed(key >> 64), _signed(key & ((1 << 64) - 1)), band_keys(*weighted_shingles(hashes, idf))))
                return out

            return work

        banded = map_texts(slim, [], "text", make, "k1 long, k2 long, bands array<long>").where("k1 is not null")
        # The same text met by several tasks has the same bands.
        nodes = stage_out(banded.groupBy("k1", "k2").agg(F.first("bands").alias("bands")).join(groups, ["k1", "k2"]).select(F.col("node").alias("id"), "bands"), "near-bands")

        def fetch(ids: DataFrame) -> DataFrame:
            """Weighted shingles of the nodes that are in some bucket with another, from their representative's row."""

            def make() -> Callable:
                idf = shared_idf.value
                return lambda texts, _: [(_payload(*weighted_shingles(word_hashes(t), idf)),) for t in texts]

            wanted = groups.join(ids.select(F.col("id").alias("node")), "node", "left_semi").select("node", F.col("rep.id").alias("id"), F.col("rep.th").alias("th"))
            chosen = slim.join(wanted.hint("merge"), ["id", "th"]).select("node", "text")
            return stage_out(map_texts(chosen, ["node"], "text", make, "payload binary").dropDuplicates(["node"]).withColumnRenamed("node", "id"), "near-payloads")

        labels = _link_buckets(spark, nodes, fetch, threshold).withColumnsRenamed({"id": "node"})
        joined = stage_out(groups.join(labels, "node", "left").select("k1", "k2", "rep", F.coalesce("component", "node").alias("component")), "near-joined")
        heads = stage_out(joined.groupBy("component").agg(F.min("rep").alias("head")), "near-heads")
        known = stage_out(joined.join(heads, "component").select("k1", "k2", "head"), "near-known")
        found = rows.join(known, ["k1", "k2"], "left")  # rows without words have no key
        class_id = F.coalesce(F.col("head.id"), F.col("id"))
        return result(found.select("id", "th", class_id.alias("class_id"), F.coalesce(F.col("head") == place, F.lit(True)).alias("kept")), "near-classes")


def near_duplicate_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``docs``: ``id_col``, class_id (smallest id of its class) and kept (stands for its class).

    Words are runs of letters and digits in lower case.  Texts with the same words in the same order are
    copies; a text of one to four words is one shingle; null texts and texts without words are classes of
    their own.  Classes are made of texts: rows that share an id but not their words are in the class of
    their own words each, and both are kept if both come first there, so no text is lost.  Repeated rows
    (same id and text) come out alike; a row with a null id has a null class and is kept.  An empty table
    gives no rows; other columns are not read.
    """
    found = _classes(docs, id_col, text_col, threshold)
    without = docs.where(F.col(f"`{id_col}`").isNull()).select(F.lit(None).cast("long").alias("id"), F.lit(None).cast("long").alias("class_id"), F.lit(True).alias("kept"))
    return found.select("id", "class_id", "kept").union(without).select(F.col("id").alias(id_col), "class_id", "kept")


def keep_one_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that stand for their class, all columns kept.

    Of repeated rows (same id and text) the one whose other columns hash least stays, whole.  Null texts and
    texts without words stay, as do all rows with a null id; an empty table gives no rows; columns of any
    name pass through.  Only the rows to drop, or to choose among, are found by joins.
    """
    names = docs.columns
    key, gone_id, gone_th, mark = (free_name(c, names) for c in ("__key", "__id", "__th", "__mark"))
    own = F.col(f"`{id_col}`").cast("long")
    with scratch(docs.sparkSession) as result:
        classes = _classes(docs, id_col, text_col, threshold)
        # One row for each (id, text) that does not simply pass: dropped, or kept but found more than once.
        marked = classes.groupBy("id", "th").agg(F.first("kept").alias("kept"), F.count("*").alias("n")).where("not kept or n > 1")
        marked = result(marked.select(F.col("id").alias(gone_id), F.col("th").alias(gone_th), F.col("kept").alias(mark)), "near-marked")
    keyed = docs.withColumn(key, F.xxhash64(text_or_empty(text_col)))
    matched = (own == F.col(gone_id)) & (F.col(key) == F.col(gone_th))
    columns = [F.col(f"`{c}`") for c in names]
    single = keyed.join(marked.hint("merge"), matched, "left_anti").select(*columns)
    again = marked.where(F.col(mark))
    if again.isEmpty():
        return single
    order = F.xxhash64(F.to_json(F.struct(*columns)))
    repeated = keyed.join(again.hint("merge"), matched).groupBy(gone_id, gone_th).agg(F.min_by(F.struct(*columns), order).alias(mark))
    return single.unionByName(repeated.select(F.col(f"{mark}.*")))
