"""Tables between the jobs of an operator, in the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    The cluster names it in ``spark.checkpoint.dir``.  Only where that is unset and everything runs in this
    process (a local session, as in tests) a temporary folder is made and recorded in the session.
    """
    found = spark.conf.get(CHECKPOINT_KEY, None)
    if not found:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise ValueError(f"{CHECKPOINT_KEY} must name a folder that the driver and all executors of {master} share")
        made = tempfile.mkdtemp(prefix="framewright-")
        atexit.register(shutil.rmtree, made, ignore_errors=True)
        found = f"file://{made}"
        spark.conf.set(CHECKPOINT_KEY, found)
    return found


#: Tables of each open scratch, the innermost last.
_open: ContextVar[tuple[list[str], ...]] = ContextVar("open", default=())


def _write(df: DataFrame, tag: str, owner: list[str] | None) -> DataFrame:
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{tag}-{uuid.uuid4().hex}"
    if owner is not None:
        owner.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stage_out(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    This cuts the lineage: a lost executor costs a re-read, never a recomputation of what came before,
    and the files are visible to every node.  Within :func:`scratch` the table goes when that ends.
    """
    scopes = _open.get()
    return _write(df, tag, scopes[-1] if scopes else None)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """Tables that :func:`stage_out` writes inside are deleted at the end, also after an error.

    It gives a function that writes what has to outlive it: that table belongs to the scratch around this
    one, or, if there is none, to whoever owns the folder.
    """
    mine: list[str] = []
    outer = _open.get()
    token = _open.set((*outer, mine))
    try:
        yield lambda df, tag: _write(df, tag, outer[-1] if outer else None)
    finally:
        _open.reset(token)
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        for path in mine:
            place = jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(conf).delete(place, True)
