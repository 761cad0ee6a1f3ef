import pytest

import __spark_entry__ as entry
from framewright.llm.queries import ORACLE_SQL, QUERIES
from oracle import assert_same

IDS = ["doc_id", "vec_id", "conv_id"]


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, sf_dir, name):
    assert_same(spark, sf_dir, QUERIES[name], ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_covers_its_table(spark, sf_dir, name):
    got = QUERIES[name](spark, sf_dir)
    assert name.split("_")[0] in {f"op{n}" for n in range(1, 14)}
    key = next(c for c in IDS if c in got.columns)
    table = {"doc_id": "documents", "vec_id": "embeddings", "conv_id": "conversations"}[key]
    want = spark.read.parquet(f"{sf_dir}/{table}.parquet").select(key).distinct()
    assert want.join(got, key, "left_anti").count() == 0


def test_all_are_registered(spark):
    assert set(QUERIES) <= set(entry.queries()) and "pipeline" in entry.queries()
