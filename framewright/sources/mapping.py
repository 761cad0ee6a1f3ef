"""Mapping tables: which source image goes to which output name, from CSV, Parquet, SQLite or workbooks.

Values are strings, names come from the header, and a column is picked by name in any case or by a
position counted from 0.
"""

from __future__ import annotations

import os
import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import naming
from ..operators.ranks import with_ranks
from .tables import SqliteSource, WorkbookSource, list_tables, list_sheets

DEFAULT_PREVIEW = 32


def plain_base64(value: Column) -> Column:
    """Standard alphabet in one line: Spark breaks lines after 76 characters by default."""
    return F.regexp_replace(F.base64(value), r"[\r\n]", "")


def header_names(raw: list[str], width: int | None = None) -> list[str]:
    """Trimmed names; blank ones and those beyond the header are numbered from 1."""
    names = [x.strip() for x in raw] + [""] * max(0, (width or 0) - len(raw))
    return [x or f"Column {i + 1}" for i, x in enumerate(names)]


def as_strings(df: DataFrame) -> DataFrame:
    """All columns as trimmed strings, null as empty, binary as base64."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        text = plain_base64(c) if isinstance(f.dataType, T.BinaryType) else F.to_json(c) if isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType)) else F.trim(c.cast("string"))
        cols.append(F.coalesce(text, F.lit("")).alias(f.name))
    return df.select(*cols)


def without_blank_rows(df: DataFrame) -> DataFrame:
    return df.where(F.concat_ws("", *[F.col(f"`{c}`") for c in df.columns]) != "")


def read_csv(spark: SparkSession, path: str, header: bool = True, delimiter: str = ",", breaks_in_values: bool = False) -> DataFrame:
    """Rows of another width than the first are an error, as is a file without any row.

    A quote in a quoted value is written twice.  Line breaks in values are read if ``breaks_in_values`` says so,
    which leaves each file to one task; else they are an error.
    """
    options = {"sep": delimiter, "escape": '"', "multiLine": str(breaks_in_values).lower(), "header": "false", "mode": "FAILFAST", "ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true", "encoding": "UTF-8"}
    first = spark.read.options(**options).csv(path).limit(1).collect()
    if not first:
        raise ValueError(f"{path} has no rows")
    raw = [x or "" for x in first[0]]
    names = header_names(raw) if header else header_names([], len(raw))
    schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(names))])
    body = spark.read.schema(schema).options(**options | {"header": str(header).lower(), "enforceSchema": "true"}).csv(path)
    return without_blank_rows(as_strings(body.toDF(*names)))


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return without_blank_rows(as_strings(spark.read.parquet(path)))


def read_sqlite(spark: SparkSession, path: str, table: str | None = None, query: str | None = None) -> DataFrame:
    """A guarded SELECT, or a table, or the first table by name."""
    if query is not None:
        naming.check_select(query)
    elif table is None:
        tables = list_tables(path)
        if not tables:
            raise ValueError(f"{path} has no tables")
        table = tables[0]
    spark.dataSource.register(SqliteSource)
    options = {"path": path} | ({"query": query} if query is not None else {"table": table})
    return without_blank_rows(as_strings(spark.read.format("sqlite_rows").options(**options).load()))


def read_select(spark: SparkSession, query: str, **tables: DataFrame) -> DataFrame:
    """A query over the given tables, under the names they are given, as a mapping table.

    The query stands as a subquery, where Spark's grammar has no place for anything that writes, sets or
    lists, nor for a second statement; so words in literals, names and comments do no harm.
    """
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    text = query.strip().removesuffix(";")
    return without_blank_rows(as_strings(spark.sql(f"SELECT * FROM (\n{text}\n)")))


def read_workbook(spark: SparkSession, path: str, sheet: str | None = None, header: bool = True) -> DataFrame:
    """A sheet of an xlsx, xlsm or ods file, by name or the first."""
    spark.dataSource.register(WorkbookSource)
    options = {"path": path, "header": str(header).lower()} | ({"sheet": sheet} if sheet else {})
    return without_blank_rows(as_strings(spark.read.format("workbook_rows").options(**options).load()))


def kind_of(path: str) -> str:
    ext = os.path.splitext(path)[1].lower().lstrip(".")
    return "excel" if ext in ("xlsx", "xls", "xlsm", "ods") else "parquet" if ext in ("parquet", "pq") else "sqlite" if ext in ("db", "sqlite", "sqlite3") else "csv"


def read_mapping(spark: SparkSession, path: str, kind: str | None = None, header: bool = True, delimiter: str = ",", sheet: str | None = None, table: str | None = None, query: str | None = None) -> DataFrame:
    kind = kind or kind_of(path)
    if kind == "excel":
        return read_workbook(spark, path, sheet, header)
    if kind == "parquet":
        return read_parquet(spark, path)
    if kind == "sqlite":
        return read_sqlite(spark, path, table, query)
    if kind == "csv":
        return read_csv(spark, path, header, delimiter)
    raise ValueError(f"unknown mapping format {kind!r}")


def catalog(path: str, kind: str | None = None) -> list[str]:
    """Sheets of a workbook, tables of a database by lower-case name, nothing for other kinds."""
    kind = kind or kind_of(path)
    return list_sheets(path) if kind == "excel" else list_tables(path) if kind == "sqlite" else []


def preview(df: DataFrame, limit: int = DEFAULT_PREVIEW) -> tuple[DataFrame, int, bool]:
    """The first rows, how many there are, and whether some are left out."""
    limit = max(1, limit)
    total = df.count()
    return df.limit(limit), total, total > limit


def preview_summary(df: DataFrame, limit: int = DEFAULT_PREVIEW) -> DataFrame:
    limit = max(1, limit)
    return df.agg(F.count("*").alias("total_rows")).select("total_rows", (F.col("total_rows") > limit).alias("truncated"), F.least("total_rows", F.lit(limit)).cast("long").alias("shown"))


def parse_selector(text: str) -> int | str:
    """``#3`` or ``3`` is a position counted from 0, anything else a name."""
    text = text.strip()
    if not text:
        raise ValueError("empty column selector")
    digits = text[1:].strip() if text.startswith("#") else text
    if re.fullmatch(r"[0-9]+", digits):
        return int(digits)
    if text.startswith("#"):
        raise ValueError(f"bad column position {text!r}")
    return text


def resolve_column(columns: list[str], selector: int | str) -> str:
    """The column that a selector means; the first of equal names."""
    if isinstance(selector, int):
        if not 0 <= selector < len(columns):
            raise ValueError(f"column {selector} is out of range: there are {len(columns)}")
        return columns[selector]
    for c in columns:
        if c.casefold() == selector.casefold() and c.isascii() == selector.isascii():
            return c
    raise ValueError(f"column {selector!r} not found")


def entries(df: DataFrame, source: str, output: str, keep: list[str] | None = None) -> DataFrame:
    """source_path and output_name of all rows that have both; only the chosen columns are read."""
    pick = lambda s: F.trim(F.col(f"`{resolve_column(df.columns, parse_selector(s))}`").cast("string"))
    chosen = df.select(*(keep or []), pick(source).alias("source_path"), pick(output).alias("output_name"))
    return chosen.where((F.col("source_path") != "") & (F.col("output_name") != ""))


def normal_path(path: Column) -> Column:
    """A relative path without dots; null where it leads outside or is absolute."""

    def walk(acc: Column, part: Column) -> Column:
        up = F.when(F.size(acc["at"]) == 0, F.struct(acc["at"].alias("at"), F.lit(False).alias("inside"))).otherwise(
            F.struct(F.slice(acc["at"], F.lit(1), F.greatest(F.size(acc["at"]) - 1, F.lit(0))).alias("at"), acc["inside"].alias("inside"))
        )
        return F.when(part.isin("", "."), acc).when(part == "..", up).otherwise(F.struct(F.concat(acc["at"], F.array(part)).alias("at"), acc["inside"].alias("inside")))

    end = F.aggregate(F.split(path, "/"), F.struct(F.array().cast("array<string>").alias("at"), F.lit(True).alias("inside")), walk)
    return F.when(~path.startswith("/") & end["inside"], F.array_join(end["at"], "/"))


def existing_targets(entries_: DataFrame, files: DataFrame, file_path: str = "path") -> DataFrame:
    """Entries whose source stays inside the folder and exists, with the path made plain."""
    plain = entries_.withColumn("source_path", normal_path(F.col("source_path"))).where("source_path is not null")
    return plain.join(files.select(F.col(file_path).alias("source_path")), "source_path", "left_semi")


def lookup(queue: DataFrame, entries_: DataFrame, path: str = "path", order: str = "entry_no") -> DataFrame:
    """Each queued file with the output name of the first entry that names it, by file name or by stem.

    Two equi-joins and the smaller entry number; no nested loop over both tables.
    """
    first = entries_.groupBy("source_path").agg(F.min(F.struct(order, "output_name")).alias("e"))
    side = lambda c: first.select(F.col("source_path").alias(c), F.col("e").alias(f"e_{c}"))
    q = queue.withColumns({"__name": naming.file_name(F.col(path)), "__stem": naming.file_stem(F.col(path))})
    joined = q.join(side("__name"), "__name", "left").join(side("__stem"), "__stem", "left")
    found = F.least("e___name", "e___stem")  # least skips nulls
    return joined.select(*queue.columns, found["output_name"].alias("output_name"))


def enqueue(queued: DataFrame, found: DataFrame, path: str = "path", order: str = "position") -> DataFrame:
    """Found files that are not queued yet, each once, at its first position."""
    first = found.groupBy(path).agg(F.min(order).alias(order))
    return first.join(queued.select(path), path, "left_anti")


def with_rank(entries_: DataFrame, order: str) -> DataFrame:
    """Number entries from 1 in the order of an integer column."""
    return with_ranks(entries_, order, "mapping_row")
