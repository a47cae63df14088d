"""Stars at negative pixels are part of their mosaic's image."""

import pytest

import __spark_entry__ as entry


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("stars")
    rows = [(10 * r + c, "m", 16.0 * c - 72, 16.0 * r - 72, float(10 * r + c)) for r in range(8) for c in range(8)]  # cells -5 to 2
    spark.createDataFrame(rows, "star_id long, mosaic_key string, x double, y double, flux double").write.parquet(str(at / "star_fits.parquet"))
    return str(at)


def cells(spark, folder, name, *columns):
    return sorted(tuple(r) for r in entry.queries()[name](spark, folder).select(*columns).collect())


def test_all_cells_count(spark, folder):
    means = [(r, c, 10 * (4 * r + 1.5) + 4 * c + 1.5, 16) for r in (0, 1) for c in (0, 1)]
    assert cells(spark, folder, "block_reduce_whole", "r", "c", "v", "n") == means
    assert cells(spark, folder, "bilinear_whole", "y", "x", "v") == [(r - 5, c - 5, 10 * (r + 0.25) + c + 0.375) for r in range(7) for c in range(7)]
    assert cells(spark, folder, "local_max_whole", "y", "x", "v", "rank") == [(2, 2, 77.0, 1)]


def test_shift_keeps_every_cell(spark, folder):
    got = cells(spark, folder, "cubic_shift_whole", "y", "x")
    assert got == [(y, x) for y in range(-5, 3) for x in range(-5, 3)]
