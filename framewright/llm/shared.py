"""Pieces that several operators of this subpackage use: scratch tables, expression helpers, components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..operators.staging import CHECKPOINT_KEY, scratch, shared_dir, stage_out  # noqa: F401


def free_name(base: str, *taken: list[str]) -> str:
    """``base``, with as many underscores before it as it takes to be no column of ``taken``, in whatever case."""
    used = {c.lower() for names in taken for c in names}
    while base.lower() in used:
        base = f"_{base}"
    return base


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and bind it in ``body``, whatever the optimiser inlines."""
    return F.element_at(F.transform(F.array(value), body), 1)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def text_groups(texts: list[str], chars: int = 1_000_000) -> Iterator[list[str]]:
    """Runs of texts of about so many characters; a longer text stands alone, whole."""
    held, size = [], 0
    for x in texts:
        if held and size + len(x) > chars:
            yield held
            held, size = [], 0
        held.append(x)
        size += len(x) + 1
    if held:
        yield held


def map_texts(
    docs: DataFrame,
    keep: list[str],
    text_col: str,
    make: Callable[[], Callable[[list[str], list[list]], list[tuple]]],
    out_schema: str,
) -> DataFrame:
    """One output row per row of ``docs``: the columns ``keep`` untouched, then what ``make()`` returns for the texts.

    ``make`` runs once per task and returns a function from a batch's texts (null: empty) and the kept
    columns' values to one tuple a text.  Only ``keep`` and the text column are read.  Kept columns stay
    in Arrow, so null or large integers keep their value.
    """
    fields = T._parse_datatype_string(out_schema).fields
    slim = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text_col}`").cast("string").alias(free_name("__text", keep)))
    schema = T.StructType([*slim.schema.fields[:-1], *fields])
    arrow = to_arrow_schema(T.StructType(fields))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            if not batch.num_rows:
                continue
            kept = batch.columns[:-1]
            texts = ["" if x is None else x for x in batch.column(batch.num_columns - 1).to_pylist()]
            rows = work(texts, kept)
            made = [pa.array([r[k] for r in rows], type=f.type) for k, f in enumerate(arrow)]
            yield pa.RecordBatch.from_arrays([*kept, *made], names=[*batch.schema.names[:-1], *arrow.names])

    return slim.mapInArrow(run, schema)


def flat_map_texts(
    docs: DataFrame,
    keep: list[str],
    text_col: str,
    make: Callable[[], Callable[[list[str], list[list]], Iterator[tuple[int, tuple]]]],
    out_schema: str,
) -> DataFrame:
    """As :func:`map_texts`, but the function yields (index of the text in the batch, row), any number for a text."""
    fields = T._parse_datatype_string(out_schema).fields
    slim = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text_col}`").cast("string").alias(free_name("__text", keep)))
    schema = T.StructType([*slim.schema.fields[:-1], *fields])
    arrow = to_arrow_schema(T.StructType(fields))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            if not batch.num_rows:
                continue
            kept = batch.columns[:-1]
            texts = ["" if x is None else x for x in batch.column(batch.num_columns - 1).to_pylist()]
            at, rows = [], []

            def flush() -> pa.RecordBatch:
                took = [c.take(pa.array(at, type=pa.int64())) for c in kept]
                made = [pa.array([r[k] for r in rows], type=f.type) for k, f in enumerate(arrow)]
                return pa.RecordBatch.from_arrays([*took, *made], names=[*batch.schema.names[:-1], *arrow.names])

            for i, row in work(texts, kept):
                at.append(i)
                rows.append(row)
                if len(rows) >= 50_000:
                    yield flush()
                    at, rows = [], []
            if rows:
                yield flush()

    return slim.mapInArrow(run, schema)


def roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest number of each number's component (0 to n - 1), by minima over the pairs and pointer jumping."""
    label = np.arange(n)
    while len(i):
        low = np.minimum(label[i], label[j])
        new = label.copy()
        for at in (i, j, label[i], label[j]):
            np.minimum.at(new, at, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    return label


def _components_of_few(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    if held:
        a, b = (np.concatenate([h[k] for h in held]) for k in (0, 1))
        ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ids[roots(len(ids), at[: len(a)], at[len(a) :])])], names=["id", "component"])


#: A graph with at most so many distinct edges is finished by one task.
FEW_EDGES = 200_000


def connected_components(edges: DataFrame, tag: str = "components", max_rounds: int = 40, few_edges: int = FEW_EDGES) -> DataFrame:
    """Smallest reachable id of each vertex of an undirected graph, as (id, component).

    ``edges`` has longs ``a`` and ``b``.  A graph of at most ``few_edges`` edges, whose size is checked, is
    finished by one task in some megabytes.  A larger one takes rounds: each points a vertex at the smallest
    label among its neighbours and then at that label's own label (pointer jumping), so the rounds grow with
    the logarithm of the diameter.  Minima combine on the map side and both joins are plain equi-joins
    whose skewed sides the adaptive planner splits, so a hub with a third of all edges is dealt out.
    Every round is a table in the shared folder.
    """
    slim = edges.select(F.least("a", "b").cast("long").alias("a"), F.greatest("a", "b").cast("long").alias("b")).where("a <> b")
    single = stage_out(slim.distinct(), f"{tag}-edges")
    if single.count() <= few_edges:
        return stage_out(single.coalesce(1).mapInArrow(_components_of_few, "id long, component long"), f"{tag}-few")
    both = single.union(single.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = stage_out(
        both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("label")),
        f"{tag}-0",
    )
    for k in range(1, max_rounds + 1):
        near = both.join(labels, F.col("b") == F.col("id")).groupBy("a").agg(F.min("label").alias("m"))
        own = labels.join(near, F.col("id") == F.col("a")).select("id", F.col("label").alias("old"), F.least("label", "m").alias("label"))
        jump = labels.select(F.col("id").alias("label"), F.col("label").alias("next"))
        new = stage_out(
            own.join(jump, "label", "left").select("id", F.least("label", F.coalesce("next", "label")).alias("label"), "old"),
            f"{tag}-{k}",
        )
        labels = new.select("id", "label")
        if new.where("label <> old").isEmpty():
            return labels.select("id", F.col("label").alias("component"))
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
