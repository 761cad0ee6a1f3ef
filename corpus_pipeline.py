"""From raw documents to packed training sequences, in five stages.

Each stage works on all that the one before kept, is written as Parquet in the shared folder and read
again.  All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.llm import lines, neardup, packing, pii, rules
from framewright.llm.shared import free_name, scratch, stage_out

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def _recounted(docs: DataFrame, like: DataFrame) -> DataFrame:
    """The columns of ``like``, with n_chars, if there is one, of the text as it is now."""
    counted = docs.withColumn("n_chars", F.char_length("text").cast(like.schema["n_chars"].dataType)) if "n_chars" in like.columns else docs
    return counted.select(*[F.col(f"`{c}`") for c in like.columns])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go.

    A null or empty text has no words and goes; repeated rows are judged alike, each; ids, nulls among them,
    and further columns of any name play no part; an empty table stays empty.
    """
    return rules.keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeats of runs of lines go, and documents of which no line with a word is left by that.

    A null text stays null and an empty one empty; repeated rows (same id and text) come out alike; a null
    id comes first; columns of any name keep their values, but n_chars is counted anew; an empty table
    stays empty.
    """
    n_lines, n_removed = free_name("__lines", docs.columns), free_name("__removed", docs.columns)
    done = lines.dedup_lines(docs, counts=(n_lines, n_removed))
    return _recounted(done.where(~((F.col(n_removed) > 0) & (F.col(n_removed) == F.col(n_lines)))), docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays.

    Of repeated rows (same id and text) one stays; rows that share an id only are judged by their texts;
    texts without words, null ones among them, and rows with a null id stay; columns of any name keep
    their values; an empty table stays empty.
    """
    return neardup.keep_one_each(docs)


def pii_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data give way to the name of their kind.

    A null text stays null; repeated rows come out alike, each; columns of any name keep their values, but
    n_chars is counted anew; an empty table stays empty.
    """
    return _recounted(pii.redact(docs), docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in sequences.

    A null text counts as empty and has one piece; repeated rows are packed each; ids come out untouched;
    columns of other names are not read; an empty table gives no pieces.
    """
    return packing.pack_documents(docs, TOKENIZER)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("pii_redaction", pii_redaction),
    ("best_fit_packing", best_fit_packing),
]

#: Near-dedup's samples, the context graph and the tokenizer are beyond SQL; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the last one's rows.  What lies between them is deleted at the end."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with scratch(spark) as result:
        for name, stage in STAGES[:-1]:
            docs = stage_out(stage(spark, docs, sf_dir), f"pipeline-{name}")
        return result(STAGES[-1][1](spark, docs, sf_dir), "pipeline")
