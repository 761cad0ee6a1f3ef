import duckdb
import pytest

import __spark_entry__ as entry
from framewright.plans.catalog import CATALOG
from oracle import assert_same


@pytest.mark.parametrize("name", sorted(n for n, q in CATALOG.items() if q.sql))
def test_query_equals_its_sql(spark, sf_dir, name):
    assert_same(spark, sf_dir, CATALOG[name].run, CATALOG[name].sql)


@pytest.mark.parametrize("name", sorted(n for n, q in CATALOG.items() if not q.sql))
def test_query_without_sql_gives_rows(spark, sf_dir, name):
    assert CATALOG[name].run(spark, sf_dir).count() > 0


def test_entry(spark, sf_dir):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_grid_and_plain_overlaps_agree(spark, sf_dir):
    one, two = (CATALOG[n].run(spark, sf_dir).collect() for n in ("overlap_pairs", "overlap_pairs_grid"))
    assert sorted(one) == sorted(two) and one


#: Pixels are worked out in single precision: in double precision each of these would be one less.
ROUNDED_UP = [-0.03529411926865578, 0.011764705181121826, -0.019607845693826675]
DRAWN = "histogram equalization_lut laplacian_sharpness brightness_filter exposure_filter contrast_filter saturation_filter red_eye_filter red_eye_in_discs equalized_channels composited_images ellipse_masks rounded_masks chamfered_masks channel_histograms mosaic_sharpness mosaic_equalized"


@pytest.fixture(scope="module")
def edge_pixels(tmp_path_factory):
    folder = tmp_path_factory.mktemp("edge-pixels")
    values = ", ".join(f"{v}::FLOAT" for v in ROUNDED_UP)
    sql = f"SELECT v::BIGINT AS vec_id, list_transform(range(64), lambda i: CASE WHEN i % 5 = 0 THEN [{values}][i % 3 + 1] ELSE ((i * 37 + v * 11) % 200 / 100.0 - 1)::FLOAT END) AS embedding, 0 AS label FROM range(128) t(v)"
    duckdb.sql(f"COPY ({sql}) TO '{folder}/embeddings.parquet' (FORMAT parquet)")
    return str(folder)


@pytest.mark.parametrize("name", DRAWN.split())
def test_pixels_on_the_edge_of_a_value(spark, edge_pixels, name):
    assert_same(spark, edge_pixels, CATALOG[name].run, CATALOG[name].sql)


def test_outlines_are_dealt_by_rows(spark, sf_dir):
    assert CATALOG["ellipse_outlines"].run(spark, sf_dir).rdd.getNumPartitions() > 1
