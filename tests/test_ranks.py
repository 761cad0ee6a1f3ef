from pyspark.sql import functions as F

from framewright.operators.ranks import with_ranks


def test_ranks_of_hashed_tied_and_missing_values(spark):
    hashed = spark.range(2000).select(F.xxhash64("id").alias("v"), F.col("id").alias("other"))
    df = hashed.union(spark.range(500).select(F.lit(7).cast("long"), "id")).union(spark.range(3).select(F.lit(None).cast("long"), "id"))
    df = df.union(spark.createDataFrame([((1 << 53) + 1, 1), (1 << 53, 2)], "v long, other long")).repartition(5)
    got = with_ranks(df, "v", "n").collect()
    assert sorted(r.n for r in got) == list(range(1, 2506))
    by_rank = [r.v for r in sorted(got, key=lambda r: r.n)]
    assert by_rank == [None] * 3 + sorted(v for v in by_rank if v is not None)
    assert with_ranks(df.where("false"), "v", "n").count() == 0


def test_equal_values_are_dealt_out(spark):
    """A value that all rows share does not gather in one range."""
    df = spark.range(40_000).select(F.lit(1).alias("v"), "id")
    dealt = df.withColumn("__row", F.monotonically_increasing_id()).repartitionByRange(4, F.asc_nulls_first("v"), F.asc("__row"))
    assert dealt.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] < 20_000
    assert with_ranks(df, "v", "n").agg(F.count_distinct("n"), F.max("n")).first()[:] == (40_000, 40_000)
