import random
from itertools import combinations

import numpy as np
import pytest

from framewright.llm import neardup as nd
from framewright.llm.shared import connected_components


def words(rng, n):
    return ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n)]


def corpus(seed=7):
    rng = random.Random(seed)
    rows, n = [], 0
    for size in (1, 1, 2, 3, 12):
        for _ in range(6):
            base = words(rng, rng.randint(60, 200))
            for k in range(size):
                own = list(base)
                for _ in range(k % 3):
                    own[rng.randrange(len(own))] = "changed" + str(rng.random())
                rows.append((n, " ".join(own)))
                n += 1
    return rows


def components(ids, linked):
    label = {i: i for i in ids}
    for _ in ids:
        for a, b in linked:
            label[a] = label[b] = min(label[a], label[b])
    return label


def test_classes_equal_brute_force(spark):
    rows = corpus()
    got = {r.doc_id: (r.class_id, r.kept) for r in nd.near_duplicate_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    n = len(rows)
    df = {}
    sets = {i: nd.word_hashes(t) for i, t in rows}
    for h in sets.values():
        for s in np.unique(nd.shingle_hashes(h)).tolist():
            df[s] = df.get(s, 0) + 1
    weight = lambda c: np.log1p(n / (c + n / 4)) / np.log1p(4)
    bags = {}
    for i, h in sets.items():
        s, tf = np.unique(nd.shingle_hashes(h), return_counts=True)
        bags[i] = {k: t * weight(df[k]) for k, t in zip(s.tolist(), tf.tolist())}
    pairs, unsure = [], set()
    for a, b in combinations(bags, 2):
        keys = bags[a].keys() | bags[b].keys()
        j = sum(min(bags[a].get(k, 0), bags[b].get(k, 0)) for k in keys) / sum(max(bags[a].get(k, 0), bags[b].get(k, 0)) for k in keys)
        if abs(j - 0.8) < 0.03:  # weights lie on a grid
            unsure |= {a, b}
        if j >= 0.8:
            pairs.append((a, b))
    want = components(bags, pairs)
    wrong = [i for i in want if got[i][0] != want[i] and want[i] not in unsure and i not in unsure]
    assert not wrong and len(set(want.values())) < n
    assert all(kept == (i == c) for i, (c, kept) in got.items())


def test_rows_that_share_ids_lose_no_text(spark):
    rng = random.Random(19)
    one, two = " ".join(words(rng, 80)), " ".join(words(rng, 90))
    docs = spark.createDataFrame([(2, one, "a"), (5, one, "b"), (5, two, "c"), (7, two, "d"), (7, two, "e"), (9, two.upper(), "f")], "doc_id long, text string, __key string")
    got = sorted((r.doc_id, r.class_id, r.kept) for r in nd.near_duplicate_classes(docs).collect())
    assert got == [(2, 2, True), (5, 2, False), (5, 5, True), (7, 5, False), (7, 5, False), (9, 5, False)]
    assert sorted(tuple(r) for r in nd.keep_one_each(docs).collect()) == [(2, one, "a"), (5, two, "c")]
    again = docs.where("doc_id = 7")
    assert [r.doc_id for r in nd.keep_one_each(again).collect()] == [7]


def test_samples_agree_as_often_as_the_sets_are_alike():
    rng = np.random.default_rng(8)
    agree = []
    for _ in range(40):
        s = np.unique(rng.integers(0, 2**63, 400, dtype=np.uint64))
        a, b = s[:350], s[50:]
        flat = lambda x: np.zeros(len(x), dtype=np.int16)
        agree.append(sum(x == y for x, y in zip(nd.band_keys(a, flat(a)), nd.band_keys(b, flat(b)))) / nd.BANDS)
    assert np.mean(agree) == pytest.approx((300 / len(s)) ** nd.ROWS, abs=0.06)


def test_weighted_jaccard():
    a = (np.array([1, 2, 3], dtype=np.uint64), np.array([0, 8, 0]))
    b = (np.array([2, 3, 4], dtype=np.uint64), np.array([0, 0, 0]))
    assert nd.weighted_jaccard(a, b) == pytest.approx(2 / (4 + 3 - 2))
    assert nd.weighted_jaccard(a, a) == 1.0 and nd.weighted_jaccard((a[0][:0], a[1][:0]), b) == 0.0
    s = np.sort(np.random.default_rng(1).integers(0, 2**63, 99, dtype=np.uint64))
    assert nd.weighted_jaccard(nd._unpack(nd._payload(s, np.zeros(99))), nd._unpack(nd._payload(s, np.zeros(99)))) == 1.0


def test_a_group_of_200_near_copies(spark, monkeypatch):
    # all levels: leaders, small buckets and blocks; the classes are those of all pairs
    monkeypatch.setattr(nd, "BLOCK_ROWS", 16)
    rng = random.Random(20)
    base, rows = words(rng, 120), []
    for k in range(200):
        own = list(base)
        for _ in range(rng.randint(0, 7)):
            own[rng.randrange(len(own))] = f"own{rng.random()}"
        rows.append((k, " ".join(own)))
    rows += [(200 + k, " ".join([*base[:70], *words(rng, 30)])) for k in range(60)]  # share a passage below the threshold
    held = {}
    table = nd.idf_table
    monkeypatch.setattr(nd, "idf_table", lambda blocks, n: held.setdefault("idf", table(blocks, n)))
    got = {r.doc_id: r.class_id for r in nd.near_duplicate_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    bags = {i: nd.weighted_shingles(nd.word_hashes(t), held["idf"]) for i, t in rows}
    pairs = [(a, b) for a, b in combinations(bags, 2) if nd.weighted_jaccard(bags[a], bags[b]) >= nd.THRESHOLD]
    want = components(bags, pairs)
    assert got == want and 30 < len(set(want.values())) < 240


def test_edges_of_the_contract(spark):
    long = " ".join(words(random.Random(9), 20000))
    rows = [(1, "a b c", "x"), (5, "A  b, C!", "x"), (2, None, "x"), (3, "", "x"), (None, "a b c", "x"), (4, "?!", "x"), (6, long, "x"), (7, long + " end", "x"), (1, "a b c", "x"), (8, "a b d", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, class_id string")
    got = nd.near_duplicate_classes(docs).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: (r.class_id, r.kept) for r in got}
    assert by == {1: (1, True), 5: (1, False), 2: (2, True), 3: (3, True), None: (None, True), 4: (4, True), 6: (6, True), 7: (6, False), 8: (8, True)}
    left = nd.keep_one_each(docs)
    assert left.columns == docs.columns and sorted(str(r.doc_id) for r in left.collect()) == ["1", "2", "3", "4", "6", "8", "None"]
    assert nd.near_duplicate_classes(docs.where("false")).count() == 0


def test_components(spark):
    rng = random.Random(10)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + k, 1001 + k) for k in range(60)] + [(5000, 5000 + k) for k in range(200)]
    ids = {x for e in edges for x in e if e[0] != e[1]}
    want = components(ids, [e for e in edges if e[0] != e[1]])
    df = spark.createDataFrame(edges, "a long, b long")
    for few in (10_000, 0):  # one task; rounds
        assert {r.id: r.component for r in connected_components(df, few_edges=few).collect()} == want


def linked(spark, groups):
    """Classes by _link_buckets of documents (id: set of shingles) in groups; a group shares one bucket, and nothing else."""
    docs = {i: np.sort(np.array(sorted(s), dtype=np.uint64)) << np.uint64(32) for g in groups for i, s in g.items()}
    payloads = spark.createDataFrame([(i, bytearray(nd._payload(s, np.zeros(len(s))))) for i, s in docs.items()], "id long, payload binary")
    bands = [(i, [-1 - k, *(1000 * i + b for b in range(1, nd.BANDS))]) for k, g in enumerate(groups) for i in g]
    banded = spark.createDataFrame(bands, "id long, bands array<long>")
    return {r.id: r.component for r in nd._link_buckets(spark, banded, lambda ids: payloads.join(ids, "id", "left_semi"), nd.THRESHOLD).collect()}


def test_large_bucket_is_compared_whole(spark):
    # 40 pairs of near copies that share a template below the threshold, all in one bucket
    template = set(range(1, 71))
    docs = {2 * k + c: template | {1000 * k + 100 + x for x in range(28)} | {1000 * k + 900 + c} for k in range(40) for c in (0, 1)}
    assert linked(spark, [docs]) == {i: i - i % 2 for i in docs}


def test_blocks_compare_all_pairs():
    rng = np.random.default_rng(15)
    docs = []
    for _ in range(60):
        s = np.sort(rng.choice(60, rng.integers(30, 60), replace=False)).astype(np.uint64)
        docs.append((s, rng.integers(-6, 12, len(s)) if rng.random() < 0.5 else np.zeros(len(s), dtype=np.int64)))
    a, b = docs[:25], docs[20:]
    for t in (0.3, 0.5, 0.8):
        i, j = nd.alike(a, b, t)
        assert set(zip(i.tolist(), j.tolist())) == {(x, y) for x in range(len(a)) for y in range(len(b)) if nd.weighted_jaccard(a[x], b[y]) >= t}


def test_small_buckets_are_compared_pair_by_pair(spark):
    # A-B and B-C link, A-C does not: one of the two links is not with the leader unless B leads
    chain = lambda k: {3 * k + c: {1000 * k + 7 * c + x for x in range(1, 71)} for c in range(3)}
    # D-E and F-G link, and of the rest only E-F: neither the leader H nor the least of each component sees it
    runs = lambda k, first: {first + c: {1000 * k + 7 * c + x for x in range(1, 71)} for c in range(4)} | {first + 4: {1000 * k + 500 + x for x in range(70)}}
    groups = [chain(k) for k in range(24)] + [runs(100 + k, 500 + 5 * k) for k in range(12)]
    want = {i: min(g) if i - min(g) < 4 else i for g in groups for i in g}
    assert linked(spark, groups) == want


def test_weights_have_no_ceiling(spark):
    """Texts that differ in how often one shingle stands in them, 20,000 times and more, are as far apart as they are."""
    often = "same " * 60_004
    rare = "same " * 20_004
    shingles, levels = nd.weighted_shingles(nd.word_hashes(often), np.ones(nd.SKETCH_DEPTH * nd.SKETCH_WIDTH, dtype=np.float32))
    assert len(shingles) == 1 and levels[0] == round(8 * np.log2(60_000)) and nd._unpack(nd._payload(shingles, levels))[1].tolist() == levels.tolist()
    rows = [(1, often), (2, rare), (3, "same " * 58_004), (4, "a b c d e f g")]
    got = {r.doc_id: r.class_id for r in nd.near_duplicate_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 2, 3: 1, 4: 4}
    one, two = (nd._unpack(nd._payload(*nd.weighted_shingles(nd.word_hashes(t), np.ones(nd.SKETCH_DEPTH * nd.SKETCH_WIDTH, dtype=np.float32)))) for t in (often, rare))
    assert nd.weighted_jaccard(one, two) < 0.4 and [len(x) for x in nd.alike([one], [two], 0.8)] == [0, 0]
