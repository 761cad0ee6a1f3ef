"""Runs a query beside its SQL and compares the rows."""

import glob
import os

import duckdb


def connect(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def rows(frame, columns):
    return sorted(map(tuple, frame[columns].astype(object).where(frame[columns].notna(), None).map(lambda v: repr(v.tolist()) if hasattr(v, "tolist") else str(v)).values.tolist()))


def fetched(df):
    """As pandas, where nullable whole numbers stay whole numbers."""
    whole = [f.name for f in df.schema if f.dataType.typeName() in ("byte", "short", "integer", "long")]
    return df.toPandas().astype(dict.fromkeys(whole, "Int64"))


def assert_same(spark, sf_dir, run, sql):
    got, want = fetched(run(spark, sf_dir)), connect(sf_dir).sql(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    a, b = rows(got, columns), rows(want, columns)
    assert len(a) == len(b)
    assert a == b
