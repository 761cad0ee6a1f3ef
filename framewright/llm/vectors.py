"""Exact cosine links between all vectors, by tiles ordered along principal components.

Equal vectors are one row with a count.  The rest is turned to the principal axes of the whole table, dealt
by ranges of the first and cut into tiles by halving along the others.  A tile's box holds its coordinates
on the leading axes and the length of what follows; tiles whose boxes lie too far apart are not compared.
A pair of tiles is compared by its leading coordinates first: their product plus the product of what is
left of both lengths bounds the cosine, so a pair is dropped as soon as it cannot reach the threshold;
survivors get further coordinates and at last the cosine in doubles.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import connected_components, roots, scratch, stage_out

THRESHOLD = 0.9
TILE_ROWS = 4096
#: So many tiles are cut from one range of the first axis; a tile's box has so many leading axes.
RANGE_TILES, BOX_AXES = 8, 8
#: Rows of a tile that are compared at a time, and pairs whose coordinates are gathered at a time.
STRIPE, GATHER = 1024, 1 << 15
#: Shares of the coordinates after which the bound is looked at.
STOPS = (0.375, 0.6875)
#: Above the rounding of single-precision products.
SLACK = 1e-4


def _usable(v: Column) -> Column:
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & fine & F.exists(v, lambda x: x != 0)


def principal_axes(vectors: DataFrame, dims: int) -> np.ndarray:
    """Orthogonal axes (as columns, most of the unit vectors' squared length first) from all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dims, dims))
        for batch in batches:
            if batch.num_rows:
                x = _units(_matrix(batch.column(0), dims))
                total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(range(dims), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], names=["i", "row"])

    parts = vectors.select("v").mapInArrow(run, "i int, row array<double>")
    rows = parts.groupBy("i").agg(*[F.sum(F.col("row")[k]).alias(f"s{k}") for k in range(dims)]).collect()  # one row per dimension
    m = np.zeros((dims, dims))
    for r in rows:
        m[r["i"]] = r[1:]
    values, axes = np.linalg.eigh((m + m.T) / 2)
    return np.ascontiguousarray(axes[:, np.argsort(-values)])


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.float64).reshape(-1, dims)


def _units(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # very long or short vectors keep a finite length
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _led(x: np.ndarray, axes: np.ndarray, stops: list[int]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Principal coordinates, and the length of what follows each stop."""
    y = x @ axes
    return y, [np.sqrt((y[:, k:] ** 2).sum(axis=1)) for k in stops]


def compare_tiles(a: np.ndarray, b: np.ndarray, axes: np.ndarray, threshold: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers of the pairs of ``a`` and ``b`` that link, stripe by stripe; of the upper triangle only if both are the same tile."""
    dims = a.shape[1]
    stops = [max(1, round(dims * s)) for s in STOPS]
    ua, ub = _units(a), _units(b)
    (ya, ra), (yb, rb) = _led(ua, axes, stops), _led(ub, axes, stops)
    k = stops[0]
    # the suffix norms are one more coordinate of the leading product
    left = np.hstack([ya[:, :k], ra[0][:, None]]).astype(np.float32)
    right = np.hstack([yb[:, :k], rb[0][:, None]]).astype(np.float32)
    for top in range(0, len(left), STRIPE):
        bound = left[top : top + STRIPE] @ right.T
        i, j = np.nonzero(bound >= threshold - SLACK)
        i += top
        if same:
            up = i < j
            i, j = i[up], j[up]
        keep = np.zeros(len(i), dtype=bool)
        for at in range(0, len(i), GATHER):
            p, q = i[at : at + GATHER], j[at : at + GATHER]
            part = np.einsum("ij,ij->i", ya[p, : stops[1]], yb[q, : stops[1]])
            near = np.flatnonzero(part + ra[1][p] * rb[1][q] >= threshold - 1e-9)
            keep[at + near] = np.einsum("ij,ij->i", ua[p[near]], ub[q[near]]) >= threshold
        yield i[keep], j[keep]


def cut_tiles(y: np.ndarray, rows: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """``rows`` of the coordinates ``y`` in parts of at most ``size``, halved along the axis on which they spread most."""
    if len(rows) <= size:
        yield rows
        return
    axis = int(np.argmax(y[rows].max(axis=0) - y[rows].min(axis=0)))
    rows = rows[np.argsort(y[rows, axis], kind="stable")]
    half = -(-len(rows) // (2 * size)) * size  # whole tiles to the left
    yield from cut_tiles(y, rows[:half], size)
    yield from cut_tiles(y, rows[half:], size)


def _linked(distinct: DataFrame, dims: int, kind: str, threshold: float, tile_rows: int) -> DataFrame:
    """Counts and forest edges (rep, links, root) of distinct vectors (v, rep, copies) of one length, several rows for a vector."""
    spark = distinct.sparkSession
    n = distinct.count()
    shared_axes = spark.sparkContext.broadcast(principal_axes(distinct, dims))

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = shared_axes.value[:, 0]
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(0), dims)
                data = pa.array([r.tobytes() for r in x.astype(kind)], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(_units(x) @ first), data], names=["rep", "copies", "p", "data"])

    projected = distinct.select("v", "rep", "copies").mapInArrow(project, "rep long, copies long, p double, data binary")
    ranges = max(1, -(-n // (RANGE_TILES * tile_rows)))
    ordered = projected.repartitionByRange(ranges, "p", "rep").coalesce(ranges)  # no more even where ranges are cut finer

    def tile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["tile", "lo", "hi", "reps", "copies", "data"]
        kinds = [pa.int64(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]

        def made(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held)
            reps, copies = (table.column(c).to_numpy() for c in (0, 1))
            x = np.frombuffer(b"".join(table.column(3).to_pylist()), dtype=kind).reshape(-1, dims)
            y = _units(x.astype(np.float64)) @ shared_axes.value
            lead = min(BOX_AXES, dims)
            box = np.hstack([y[:, :lead], np.sqrt((y[:, lead:] ** 2).sum(axis=1))[:, None]])
            for rows in cut_tiles(box, np.argsort(reps, kind="stable"), tile_rows):
                values = [int(reps[rows[0]]), box[rows].min(axis=0), box[rows].max(axis=0), reps[rows], copies[rows], x[rows].tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names=names)

        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= 2 * RANGE_TILES * tile_rows:
                yield from made(held)
                held, size = [], 0
        if size:
            yield from made(held)

    tiles = stage_out(ordered.mapInArrow(tile, "tile long, lo array<double>, hi array<double>, reps array<long>, copies array<long>, data binary"), "vec-tiles")

    # Unit vectors that link are at most this far apart, so also their leading coordinates and what follows.
    reach = float(np.sqrt(max(0.0, 2 - 2 * threshold))) + 1e-9
    cell = F.explode(F.sequence(F.floor(F.col("lo")[0] / reach), F.floor(F.col("hi")[0] / reach) + 1)).alias("cell")
    cells = tiles.select("tile", "lo", "hi", cell)
    other = tiles.select(F.col("tile").alias("tile2"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"), cell)
    gaps = F.zip_with(F.zip_with("lo2", "hi", lambda x, y: x - y), F.zip_with("lo", "hi2", lambda x, y: x - y), lambda x, y: F.greatest(x, y, F.lit(0.0)))
    far = F.aggregate(gaps, F.lit(0.0), lambda acc, g: acc + g * g)
    pairs = cells.join(other, "cell").where("tile <= tile2").where(far <= reach * reach).select("tile", "tile2").distinct()
    one = tiles.select("tile", F.col("reps").alias("ra"), F.col("copies").alias("ca"), F.col("data").alias("da"))
    two = tiles.select(F.col("tile").alias("tile2"), F.col("reps").alias("rb"), F.col("copies").alias("cb"), F.col("data").alias("db"))

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        axes = shared_axes.value
        for batch in batches:
            for k in range(batch.num_rows):
                ta, tb, ra, ca, da, rb, cb, db = (batch.column(i)[k].as_py() for i in range(8))
                a, b = (np.frombuffer(x, dtype=kind).reshape(-1, dims).astype(np.float64) for x in (da, db))
                same = ta == tb
                reps, copies = (np.array(ra), np.array(ca)) if same else (np.array(ra + rb), np.array(ca + cb))
                links, root = np.zeros(len(reps), dtype=np.int64), np.arange(len(reps))
                for i, j in compare_tiles(a, b, axes, threshold, same):
                    j = j if same else j + len(ra)
                    np.add.at(links, i, copies[j])
                    np.add.at(links, j, copies[i])
                    new = root[i] != root[j]
                    root = roots(len(reps), np.concatenate([i[new], np.arange(len(reps))]), np.concatenate([j[new], root]))
                hit = np.flatnonzero(links)
                yield pa.RecordBatch.from_arrays([pa.array(reps[hit]), pa.array(links[hit]), pa.array(reps[root[hit]])], names=["rep", "links", "root"])

    compared = pairs.join(one, "tile").join(two, "tile2").select("tile", "tile2", "ra", "ca", "da", "rb", "cb", "db")
    return stage_out(compared.mapInArrow(link, "rep long, links long, root long"), "vec-links")


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = THRESHOLD, tile_rows: int = TILE_ROWS) -> DataFrame:
    """One row per row of ``vectors``: ``id_col``, n_links (other rows linked directly), component_id, kept.

    Linked are rows of the same length whose cosine in double precision is at least ``threshold``; the
    component is the smallest id reachable, and kept is id = component.  Rows that are null, zero, or hold
    null or non-finite components link with nothing; so does a row with a null id, whose component is null
    and which is kept.  Vectors of several lengths in one table are compared length by length.  Repeated
    rows link with each other.  An empty table gives no rows; other columns are not read.
    Tiles hold ``tile_rows`` rows at most.  A task gets two tiles and returns a count and one edge of a
    spanning forest per row, never the pairs.
    """
    spark = vectors.sparkSession
    given = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vec_col}`").alias("v"))
    # Components that came as floats travel as floats, which is the same number in half the bytes.
    kind = "<f4" if isinstance(given.schema["v"].dataType.elementType, T.FloatType) else "<f8"
    slim = given.select("id", F.col("v").cast("array<double>").alias("v"))
    with scratch(spark) as result:
        usable = slim.where(F.col("id").isNotNull() & _usable(F.col("v")))
        distinct = stage_out(usable.groupBy("v").agg(F.min("id").alias("rep"), F.count("*").alias("copies")), "vec-distinct")
        lengths = distinct.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("k")).where("k > 1").orderBy("n").collect()  # one row per length
        linked = [_linked(distinct.where(F.size("v") == r["n"]), r["n"], kind, threshold, tile_rows) for r in lengths]
        none = spark.createDataFrame([], "rep long, links long, root long")
        linked = functools.reduce(DataFrame.union, linked) if linked else none
        labels = connected_components(linked.select(F.col("rep").alias("a"), F.col("root").alias("b")), "vec").withColumnRenamed("id", "rep")
        counts = linked.groupBy("rep").agg(F.sum("links").alias("links"))
        known = distinct.join(counts, "rep", "left").join(labels, "rep", "left")
        known = result(known.select("v", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "rep").alias("component")), "vec-known")
    keyed = slim.withColumn("k", F.when(F.col("id").isNotNull() & _usable(F.col("v")), F.col("v")))
    joined = keyed.join(known.withColumnRenamed("v", "k"), "k", "left")
    component = F.coalesce("component", "id")
    return joined.select(
        F.col("id").alias(id_col),
        F.coalesce(F.col("links") + F.col("copies") - 1, F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"),
    )
