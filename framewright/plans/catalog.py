"""The registered queries: name, Spark callable, and the SQL that an oracle runs on the same tables.

There are no images in the tables, so detections, head tensors, images and statuses are derived from them
by fixed expressions, given once as SQL text that both engines read.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


CATALOG: dict[str, Query] = {}


def query(sql: str | None = None) -> Callable:
    """Register a callable under its own name."""

    def take(run: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        CATALOG[run.__name__] = Query(run, sql)
        return run

    return take


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


FACE_ORDER = "l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate"
DETECTION = {
    "image_id": "l_orderkey",
    "face_idx": f"CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY {FACE_ORDER}) - 1 AS BIGINT)",
    "x": "CAST(l_partkey % 900 AS FLOAT)",
    "y": "CAST((l_suppkey * 7 + l_linenumber * 53) % 700 AS FLOAT)",
    "width": "CAST(120 + 3 * l_quantity AS FLOAT)",
    "height": "CAST(124 + 4 * l_quantity AS FLOAT)",
    "score": "CAST(0.5 + 5 * l_discount AS FLOAT)",
    "quality_score": "l_extendedprice / 40",
}
DETECTIONS = "SELECT " + ", ".join(f"{e} AS {n}" for n, e in DETECTION.items()) + " FROM lineitem"
IMAGE_W, IMAGE_H = "(800 + image_id % 5 * 200)", "(600 + image_id % 4 * 150)"


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faces of images from lineitem: image_id, face_idx, box, score, quality_score."""
    return table(spark, sf_dir, "lineitem").selectExpr(*[f"{e} AS {n}" for n, e in DETECTION.items()])


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best crop of each image: filtered, ranked, with its region and file name."""
    from . import queries

    return queries.best_crop_per_image(spark, sf_dir)


def load() -> None:
    """Fill the catalogue."""
    from . import queries  # noqa: F401


load()
