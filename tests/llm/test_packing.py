import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from framewright.llm import packing
from framewright.llm.shared import text_groups

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_same_ids_as_the_library():
    model = Tokenizer.from_file(PATH)
    random.seed(1)
    alphabet = list("ab'stremvdl  \n\t.,!19é中 　\U0001f600'’ſΣΑİ\0ǅ٣") + ["é", "ͅ", "<|endoftext|>", "\x1c", "\x85", "K", "Å"]
    texts = ["".join(random.choice(alphabet) for _ in range(random.randint(0, 30))) for _ in range(4000)] + ["", "a" * 500, "word " * 5000]
    coder = packing.WordBpe(PATH, cache_limit=50)
    got = [np.frombuffer(d, "<u4").tolist() for g in text_groups(texts, 3000) for d in coder.encode_batch(g)]
    assert got == [e.ids for e in model.encode_batch(texts, add_special_tokens=False)]


def test_same_ids_for_every_code_point():
    model, coder = Tokenizer.from_file(PATH), packing.WordBpe(PATH)
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for at in range(0, len(points), 50_000):
        texts = [f"ab{c}Cd{c} {c}9" for c in points[at : at + 50_000]]
        got = [np.frombuffer(d, "<u4").tolist() for d in coder.encode_batch(texts)]
        assert got == [e.ids for e in model.encode_batch(texts, add_special_tokens=False)]


def squares(gaps):
    return sum(gaps.count(g) ** 2 for g in set(gaps) if g)


def brute(lengths, capacity, value=squares):
    """Bins, as lists of items, after trying every place for every item.

    The least value wins, then the smallest gap, then the bin filled last; a new bin loses ties.
    """
    bins = []  # the one filled last comes last
    for i, s in enumerate(lengths):
        gaps = [capacity - sum(lengths[k] for k in b) for b in bins]
        tries = [(value([*gaps[:b], g - s, *gaps[b + 1 :]]), g, -b) for b, g in enumerate(gaps) if g >= s] + [(value([*gaps, capacity - s]), capacity, 1)]
        b = -min(tries)[2]
        bins.append([*(bins.pop(b) if b >= 0 else []), i])
    return bins


def brute_again(lengths, capacity):
    """As ``brute``, then bins that are not full once more, largest items first, while that saves bins; at last by best fit."""
    bins = brute(lengths, capacity)
    for value in (squares, lambda gaps: 0):
        while True:
            loads = [sum(lengths[i] for i in b) for b in bins]
            items = sorted((i for b, load in zip(bins, loads) if load < capacity for i in b), key=lambda i: (-lengths[i], i))
            fresh = brute([lengths[i] for i in items], capacity, value)
            if len(fresh) >= sum(load < capacity for load in loads):
                break
            bins = [b for b, load in zip(bins, loads) if load == capacity] + [[items[k] for k in b] for b in fresh]
    return bins


def test_every_item_goes_where_the_squares_become_smallest():
    rng = random.Random(2)
    for _ in range(150):
        lengths = [rng.randint(1, 12) for _ in range(40)]
        bins, _ = packing.sum_of_squares(lengths, 12)
        loads = lambda found: sorted(sum(lengths[i] for i in b) for b in found)
        assert loads([i for i, b in enumerate(bins) if b == k] for k in range(max(bins) + 1)) == loads(brute_again(lengths, 12))


def test_bins_are_full_and_gapless():
    rng = random.Random(3)
    lengths = [min(2048, 1 + int(rng.expovariate(1 / 600))) for _ in range(4000)]
    bins, offsets = packing.sum_of_squares(lengths)
    at = {}
    for i in sorted(range(len(bins)), key=lambda i: (bins[i], offsets[i])):
        assert offsets[i] == at.get(bins[i], 0)
        at[bins[i]] = offsets[i] + lengths[i]
    assert max(at.values()) <= 2048 and len(at) <= -(-sum(lengths) // 2048) + 3
    assert packing.sum_of_squares([]) == ([], []) and packing.sum_of_squares([2048, 2048])[0] == [0, 1]


def test_documents(spark):
    long = "word " * 5000
    docs = spark.createDataFrame([(1, long, 0), (2, None, 0), (3, "", 0), (None, "a b", 0), (2, None, 0)], "doc_id long, text string, start int")
    rows = packing.pack_documents(docs, PATH, group_pieces=2).collect()
    assert len(rows) == 3 + 4
    model = Tokenizer.from_file(PATH)
    ids = [*model.encode(long, add_special_tokens=False).ids, 0]
    for r in rows:
        if r.doc_id == 1:
            part = ids[r.start : r.start + r.length]
            assert r.start == 2048 * r.piece and r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
    assert sum(r.length for r in rows if r.doc_id == 1) == len(ids) and sum(r.length for r in rows if r.doc_id in (2, 3)) == 3
    spans = sorted((r.sequence_id, r.offset, r.length) for r in rows)
    for (a, o, n), (b, p, _) in zip(spans, spans[1:]):
        assert p == (o + n if a == b else 0)
    assert packing.pack_documents(docs.where("false"), PATH).count() == 0


def test_ids_of_documents_come_out_untouched(spark):
    for kind, ids in (("long", [2**60 + 1, None, 2**60 + 1, -(2**63)]), ("string", ["b", None, "", "b"])):
        docs = spark.createDataFrame([(i, "one two three") for i in ids], f"doc_id {kind}, text string")
        rows = packing.pack_documents(docs, PATH).collect()
        assert sorted((r.doc_id for r in rows), key=repr) == sorted(ids, key=repr)
        assert len({(r.sequence_id, r.offset) for r in rows}) == 4 and {r.length for r in rows} == {4}
    names = docs.withColumnsRenamed({"doc_id": "__group", "text": "__text"})
    assert packing.pack_documents(names, PATH, id_col="__group", text_col="__text").count() == 4
