import hashlib
import math
import re
import zlib
from collections import Counter

import pytest

from framewright.llm import importance

COLUMNS = ["doc_id", "n_features", "weight", "score", "rank"]


def plain(docs, target, percent=5, min_words=20, seed=42, orders=3, buckets=10_000):
    """The draw by definition, over lists of (id, text) and of texts; rows in rank order, undrawn ones after."""

    def hashed(text):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        return len(ws), [zlib.crc32(" ".join(ws[i : i + n]).encode()) % buckets for n in range(1, orders + 1) for i in range(len(ws) - n + 1)]

    found = [(i, *hashed(t)) for i, t in docs]
    s, t = Counter(b for _, _, bs in found for b in bs), Counter(b for x in target for b in hashed(x)[1])
    total, wanted = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log(((t[b] + 1) * (total + buckets)) / ((s[b] + 1) * (wanted + buckets)))) for b in s}
    rows = []
    for i, n, bs in found:
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in bs)
        rows.append((n >= min_words, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), i, len(bs), weight))
    k = percent * sum(r[0] for r in rows) // 100
    rows.sort(key=lambda r: (not r[0], -r[1], (r[2] is not None, r[2] or 0)))
    return [(i, n, w, score, place if place <= k else None) for place, (_, score, i, n, w) in enumerate(rows, 1)]


def same(got, want):
    assert sorted(map(repr, (tuple(r[c] for c in COLUMNS) for r in got.collect()))) == sorted(map(repr, want))


def test_whole_table_against_a_plain_version(spark, sf_dir):
    docs, target = (spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("documents", "benchmark"))
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    same(importance.importance_resample(docs, target), plain(rows, [r["text"] for r in target.collect()]))


def test_edges_and_ties(spark):
    words = " ".join(f"w{k}" for k in range(30))
    rows = [(1, None), (2, ""), (3, "one"), (4, "one TWO"), (5, "Été \x00ÉTÉ x\x7fy z9"), (6, words), (6, words), (6, words), (None, words), (None, words), (7, words + " more"), (8, "a " * 20_000), (9, "a\n" * 19)]
    target = ["w1 w2 w3", None, "", "a a a"]
    docs = spark.createDataFrame([(*r, "x", 3, 4) for r in rows], "doc_id long, text string, words string, __row int, bucket int")
    wanted = spark.createDataFrame([(x,) for x in target], "text string")
    for percent, min_words in ((50, 20), (100, 1), (0, 20)):
        same(importance.importance_resample(docs, wanted, percent=percent, min_words=min_words), plain(rows, target, percent, min_words))
    same(importance.importance_resample(docs, wanted, orders=2, buckets=7, seed=1, percent=40), plain(rows, target, 40, seed=1, orders=2, buckets=7))


@pytest.mark.parametrize("partitions", [1, 5])
def test_repeated_rows_have_ranks_in_a_row(spark, partitions):
    rows = [(5, "a b " * 10)] * 40 + [(k, f"c{k} d " * 10) for k in range(10, 20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(partitions)
    wanted = spark.createDataFrame([("a b",)], "text string")
    same(importance.importance_resample(docs, wanted, percent=60), plain(rows, ["a b"], 60))


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    one = spark.createDataFrame([(1, "a " * 25)], "doc_id long, text string")
    assert importance.importance_resample(none, one).count() == 0
    same(importance.importance_resample(one, none, percent=100), plain([(1, "a " * 25)], [], 100))
