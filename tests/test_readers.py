import zipfile

import numpy as np
import pytest
from pyspark.errors import AnalysisException

from framewright.sources import images, mapping, sinks, tables

ODS = """<?xml version="1.0"?><office:document-content xmlns:office="urn:oasis:names:tc:opendocument:xmlns:office:1.0" xmlns:table="urn:oasis:names:tc:opendocument:xmlns:table:1.0" xmlns:text="urn:oasis:names:tc:opendocument:xmlns:text:1.0">
<office:body><office:spreadsheet><table:table table:name="one">
<table:table-row><table:table-cell><text:p>a</text:p></table:table-cell><table:table-cell table:number-columns-repeated="3000"/><table:table-cell table:number-columns-repeated="2"><text:p>z</text:p></table:table-cell><table:table-cell table:number-columns-repeated="9999"/></table:table-row>
<table:table-row><table:table-cell table:number-columns-repeated="16384"/></table:table-row>
</table:table></office:spreadsheet></office:body></office:document-content>"""


def test_values_after_many_blank_cells_keep_their_columns(tmp_path):
    path = tmp_path / "wide.ods"
    with zipfile.ZipFile(path, "w") as book:
        book.writestr("content.xml", ODS)
    with zipfile.ZipFile(path) as book:
        rows = list(tables._ods_rows(book, "one"))
    assert all(not r for r in rows[1:]) and rows[0] == ["a", *[""] * 3000, "z", "z"]


def test_files_that_cannot_be_decoded_are_rows_with_an_error(spark, tmp_path):
    img = np.full((4, 5, 4), 200, dtype=np.uint8)
    (tmp_path / "good.png").write_bytes(sinks.encode(img, "png"))
    (tmp_path / "broken.png").write_bytes(sinks.encode(img, "png")[:40])
    (tmp_path / "junk.jpg").write_bytes(b"xx")
    read = images.read_with_errors(spark, str(tmp_path))
    got = {r.path.rsplit("/", 1)[1]: (r.error is None, r.width, r.height, None if r.data is None else len(r.data)) for r in read.collect()}
    assert got == {"good.png": (True, 5, 4, 80), "broken.png": (False, None, None, None), "junk.jpg": (False, None, None, None)}
    assert images.failures(read).count() == 2 and images.read_decoded(spark, str(tmp_path)).count() == 1
    for most in (100, -1):
        assert images.read_oriented(spark, str(tmp_path), broadcast_tags=most).count() == 1


WRITES = """DROP TABLE t|DROP VIEW t|INSERT INTO t VALUES (1)|WITH a AS (SELECT 1) INSERT INTO t SELECT * FROM a|FROM t INSERT INTO u SELECT *|CREATE TABLE u AS SELECT 1
CREATE OR REPLACE TEMP VIEW t AS SELECT 1|DELETE FROM t|UPDATE t SET a = 1|TRUNCATE TABLE t|ALTER TABLE t RENAME TO u|SET a = 1|CACHE TABLE t|ADD JAR x|SHOW TABLES|EXPLAIN SELECT 1
SELECT 1; DROP TABLE t|SELECT 1) ; DROP TABLE t; SELECT * FROM (SELECT 1|INSERT OVERWRITE DIRECTORY '/tmp/x' USING parquet SELECT 1|USE default|REFRESH TABLE t""".replace("\n", "|").split("|")


@pytest.mark.parametrize("query", WRITES)
def test_nothing_but_a_query_is_taken(spark, query):
    with pytest.raises(AnalysisException):
        mapping.read_select(spark, query, t=spark.range(1).selectExpr("id AS a"))


def test_queries_of_any_form_are_taken(spark):
    t = spark.createDataFrame([("a", 1), ("b", 2), ("", None)], "s string, updated int")
    for query, want in (
        ("SELECT s, 'drop; table' AS x FROM t WHERE updated > 1; ", [("b", "drop; table")]),
        ("WITH delete_me AS (SELECT s FROM t) SELECT s, 1 AS x FROM delete_me /* insert */ -- drop", [("a", "1"), ("b", "1"), ("", "1")]),
        ("FROM t SELECT s, updated", [("a", "1"), ("b", "2")]),  # a row of blanks goes
    ):
        assert sorted(map(tuple, mapping.read_select(spark, query, t=t).collect())) == sorted(want)


def test_csv_values_with_quotes_commas_and_breaks(spark, tmp_path):
    (tmp_path / "a.csv").write_text('source,name\n"a, ""b"".png",c\n"two\nlines.png",d\n')
    got = mapping.read_csv(spark, str(tmp_path / "a.csv"), breaks_in_values=True).collect()
    assert sorted(map(tuple, got)) == [('a, "b".png', "c"), ("two\nlines.png", "d")]
    with pytest.raises(Exception, match="(?i)malformed"):
        mapping.read_csv(spark, str(tmp_path / "a.csv")).collect()
