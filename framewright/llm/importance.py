"""Importance resampling towards a target: documents weighed by hashed n-grams, drawn with Gumbel noise.

Everything is Spark SQL.  Words are exploded by position, and the runs that begin there are hashed into a
fixed number of buckets, once: the hashes are a table, some two bytes a feature.  Buckets are counted with
map-side sums in both corpora; a gain for each bucket goes to the tasks (their number is fixed); gains are
summed where a document's hashes lie, and only a row of numbers per document is shuffled and sorted.  Ranks
are positions within sorted ranges plus the sizes of the ranges before, so no task sees all documents.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import scratch, stage_out, text_or_empty

BUCKETS = 10_000
#: What parts words: all of ASCII but digits and letters.
BETWEEN = "".join(chr(c) for c in range(128) if not chr(c).isalnum())
#: Low bits of a row number, which count within a partition.
_WITHIN = (1 << 33) - 1


def words_of(text: Column) -> Column:
    """Runs of digits, letters and all that is not ASCII; only A-Z are put in lower case."""
    plain = F.translate(text, string.ascii_uppercase + BETWEEN, string.ascii_lowercase + " " * len(BETWEEN))
    return F.array_remove(F.split(plain, " "), "")


def features(docs: DataFrame, keep: list[str], text_col: str, orders: int, buckets: int) -> DataFrame:
    """(``keep``, n_words, bucket): a row for each run of 1 to ``orders`` words of each text, and nulls for the runs that its end cuts off.

    A text without words has rows with a null bucket only.
    """
    placed = docs.select(*keep, words_of(text_or_empty(text_col)).alias("words")).select(*keep, "words", F.posexplode_outer("words").alias("at", "word"))

    def run(length: int) -> Column:
        parts = [F.get("words", F.col("at") + k) for k in range(length)]
        said = F.concat(*[x for p in parts for x in (p, F.lit(" "))][:-1])
        return (F.crc32(said.cast("binary")) % buckets).cast("int")

    hashed = placed.select(*keep, F.size("words").alias("n_words"), F.array(*[run(n) for n in range(1, orders + 1)]).alias("runs"))
    # Never empty, but a plain explode would have its argument computed once more by a filter.
    return hashed.select(*keep, "n_words", F.explode_outer("runs").alias("bucket"))


def gains(hashed: DataFrame, target: DataFrame, buckets: int) -> DataFrame:
    """(bucket, gain): thousandths of the log of how much likelier the target is to have the bucket; one row a bucket, always.

    Both tables have a column bucket, nulls in it count for nothing; counts are smoothed by one.
    """

    def counted(df: DataFrame, name: str) -> DataFrame:
        return stage_out(df.where("bucket IS NOT NULL").groupBy("bucket").agg(F.count("*").alias(name)), f"dsir-{name}")

    mine, theirs = counted(hashed, "s"), counted(target, "t")
    total, wanted = (x.agg(F.coalesce(F.sum(c), F.lit(0)).cast("double")).first()[0] for x, c in ((mine, "s"), (theirs, "t")))
    every = hashed.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    s, t = (F.coalesce(c, F.lit(0)).cast("double") for c in ("s", "t"))
    ratio = ((t + 1) * F.lit(total + buckets)) / ((s + 1) * F.lit(wanted + buckets))
    both = every.join(mine, "bucket", "left").join(theirs, "bucket", "left")
    return stage_out(both.select("bucket", F.floor(F.lit(1000.0) * F.log(ratio)).alias("gain")), "dsir-gains")


def gumbel(doc_id: Column, seed: int) -> Column:
    """Thousandths of a Gumbel variate that depends on the seed and the id only."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def ranked(scored: DataFrame, order: list[Column], tag: str) -> DataFrame:
    """``scored`` with ``place``, from 1, in the given order: a distributed sort and the sizes of the ranges before.

    The order should leave no ties, or a hot key's rows all land in one range.
    """
    here = F.monotonically_increasing_id().bitwiseAND(_WITHIN)
    dealt = scored.repartitionByRange(*order).sortWithinPartitions(*order)
    dealt = stage_out(dealt.select("*", F.spark_partition_id().alias("__range"), here.alias("__here")), tag)
    sizes = dealt.groupBy("__range").agg(F.count("*").alias("__n"))  # one row a range
    before = F.expr("coalesce(sum(__n) OVER (ORDER BY __range ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)")
    starts = stage_out(sizes.select("__range", before.alias("__before")), f"{tag}-starts")
    placed = dealt.join(F.broadcast(starts), "__range")
    return placed.withColumn("place", F.col("__before") + F.col("__here") + 1).drop("__range", "__here", "__before")


def importance_resample(
    docs: DataFrame,
    target: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_text_col: str = "text",
    percent: int = 5,
    min_words: int = 20,
    seed: int = 42,
    orders: int = 3,
    buckets: int = BUCKETS,
) -> DataFrame:
    """One row per row of ``docs``: ``id_col``, n_features, weight, score, rank (null if not drawn).

    Of the documents with at least ``min_words`` words, ``percent`` in a hundred are drawn without
    replacement: the highest scores, which are weights plus noise; ties go to the smaller id.  Nothing
    but the draw leaves documents out.

    A null text counts as empty: no features, weight 0, never drawn.  A null id has the noise of the empty
    string and comes before all others in a tie; repeated rows are documents each, with equal scores and
    ranks in a row.  An empty target, like an empty table of documents, gives smoothed counts only.
    Columns but the id and the text are not read, whatever their names.
    """
    slim = docs.select(F.monotonically_increasing_id().alias("__row"), F.col(f"`{id_col}`").alias("__id"), F.col(f"`{text_col}`").cast("string").alias("__text"))
    theirs = target.select(F.col(f"`{target_text_col}`").cast("string").alias("__text"))
    with scratch(docs.sparkSession) as result:
        hashed = stage_out(features(slim, ["__row", "__id"], "__text", orders, buckets), "dsir-features")
        gain = gains(hashed, features(theirs, [], "__text", orders, buckets), buckets)
        found = hashed.join(F.broadcast(gain), "bucket", "left")
        weighed = found.groupBy("__row", "__id", "n_words").agg(F.count("bucket").alias("n_features"), F.coalesce(F.sum("gain"), F.lit(0)).alias("weight"))
        scored = weighed.select("*", (F.col("weight") + gumbel(F.col("__id"), seed)).alias("score"), (F.col("n_words") >= min_words).alias("able"))
        scored = stage_out(scored, "dsir-scores")
        drawn = scored.agg(F.count_if("able")).first()[0] * percent // 100
        order = [F.desc("able"), F.desc("score"), F.asc_nulls_first("__id"), F.asc("__row")]
        rank = F.when(F.col("able") & (F.col("place") <= drawn), F.col("place"))
        done = ranked(scored, order, "dsir-sorted")
        return result(done.select(F.col("__id").alias(id_col), "n_features", "weight", "score", rank.alias("rank")), "dsir-ranks")
