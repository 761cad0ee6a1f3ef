import numpy as np

from framewright.llm import vectors

SCHEMA = "vec_id long, embedding array<float>, n_links string"


def brute(rows):
    good = [(i, np.array(v, dtype=np.float64)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    ids = [i for i, _ in good]
    u = np.array([v / np.linalg.norm(v) for _, v in good])
    a = u @ u.T >= 0.9
    np.fill_diagonal(a, False)
    label = np.array(ids)
    while True:
        new = np.array([min([label[k], *label[a[k]]]) for k in range(len(ids))])
        if (new == label).all():
            break
        label = new
    return {i: (int(n), int(c), bool(c == i)) for i, n, c in zip(ids, a.sum(axis=1), label)}


def sample():
    rng = np.random.default_rng(13)
    centers = rng.normal(size=(12, 16))
    near = [(c + rng.normal(size=16) * s).astype("f4").tolist() for c in centers for s in (0.05, 0.15, 0.3, 0.3, 0.45)]
    far = rng.normal(size=(150, 16)).astype("f4").tolist()
    copies = [far[0]] * 5 + [[2 * x for x in far[1]]]
    return [(100 + i, v) for i, v in enumerate(near + far + copies)]


def test_links_equal_brute_force(spark):
    rows = sample()
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], SCHEMA)
    want = brute(rows)
    for tile in (4096, 20):
        got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vectors.near_vectors(df, tile_rows=tile).collect()}
        assert got == want
    assert sum(n for n, _, _ in want.values()) > 50


def test_bound_drops_no_pair():
    rng = np.random.default_rng(14)
    a = rng.normal(size=(80, 16))
    b = np.vstack([a[:40] + rng.normal(size=(40, 16)) * 0.3, rng.normal(size=(40, 16))])
    axes = np.linalg.qr(rng.normal(size=(16, 16)))[0]
    for t in (0.2, 0.5, 0.9):
        i, j = (np.concatenate(x) for x in zip(*vectors.compare_tiles(a, b, axes, t, False)))
        u, v = (x / np.linalg.norm(x, axis=1)[:, None] for x in (a, b))
        assert set(zip(i.tolist(), j.tolist())) == set(zip(*(x.tolist() for x in np.nonzero(u @ v.T >= t))))


def test_vectors_of_several_lengths_are_compared_length_by_length(spark):
    rows = sample()
    others = [(1000 + i, v[:8]) for i, v in rows[:30]] + [(2000, [1.0] * 65)]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vectors.near_vectors(spark.createDataFrame([(i, v, "x") for i, v in rows + others], SCHEMA), tile_rows=16).collect()}
    assert got == brute(rows) | brute(others[:-1]) | {2000: (0, 2000, True)}


def test_clustered_tiles_apart_are_not_compared(spark, monkeypatch):
    rng = np.random.default_rng(23)
    centers = np.linalg.qr(rng.normal(size=(12, 12)))[0]
    rows = [(i, (centers[i % 12] + rng.normal(size=12) * 0.05).tolist()) for i in range(240)]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, n_links string")
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vectors.near_vectors(df, tile_rows=10).collect()} == brute(rows)


def test_tiles_cover_all_rows():
    y = np.random.default_rng(24).normal(size=(1000, 3))
    parts = list(vectors.cut_tiles(y, np.arange(1000), 64))
    assert sorted(np.concatenate(parts).tolist()) == list(range(1000)) and max(map(len, parts)) <= 64 and len(parts) == 16


def test_unusable_vectors_link_with_nothing(spark):
    v = [1.0, 2.0]
    rows = [(1, v), (2, v), (3, None), (4, [0.0, 0.0]), (5, [None, 2.0]), (6, [float("nan"), 1.0]), (7, [float("inf"), 1.0]), (None, v), (8, [1.0]), (2, v), (9, [1e30, 2e30]), (10, [])]
    got = vectors.near_vectors(spark.createDataFrame([(i, x, "x") for i, x in rows], SCHEMA)).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.vec_id, []).append((r.n_links, r.component_id, r.kept))
    assert by[1] == [(3, 1, True)] and by[2] == [(3, 1, False)] * 2 and by[9] == [(3, 1, False)] and by[None] == [(0, None, True)]
    assert all(by[k] == [(0, k, True)] for k in (3, 4, 5, 6, 7, 8, 10))
    empty = spark.createDataFrame([], SCHEMA)
    assert vectors.near_vectors(empty).count() == 0
    assert vectors.near_vectors(spark.createDataFrame([(1, None, "x")], SCHEMA)).first().kept is True
