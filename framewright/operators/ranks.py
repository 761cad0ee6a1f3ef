"""Running numbers over a whole table without a task that sorts all of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import scratch, stage_out

#: Low bits of a row number, which count within a partition.
_WITHIN = (1 << 33) - 1


def with_ranks(rows: DataFrame, order: str, name: str) -> DataFrame:
    """Number rows from 1 in the order of a column, nulls first, as a column ``name``; equal ones in any order.

    Rows are dealt by ranges of rows, however their values lie, and equal values by row too, so no range
    holds much more than its share; a rank is a row's place in its range plus the sizes of the ranges before.
    """
    keys = [F.asc_nulls_first(order), F.asc("__row")]
    here = F.monotonically_increasing_id().bitwiseAND(_WITHIN)
    with scratch(rows.sparkSession) as result:
        sorted_ = rows.withColumn("__row", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
        dealt = result(sorted_.select("*", F.spark_partition_id().alias("__range"), here.alias("__here")).drop("__row"), "ranks")
        sizes = stage_out(dealt.groupBy("__range").agg(F.count("*").alias("__n")), "ranks-sizes")  # one row a range
        before = F.expr("coalesce(sum(__n) OVER (ORDER BY __range ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)")
        starts = result(sizes.select("__range", before.alias("__before")), "ranks-starts")
    placed = dealt.join(F.broadcast(starts), "__range")
    return placed.withColumn(name, F.col("__before") + F.col("__here") + 1).drop("__range", "__before", "__here")
