"""Queries over mosaics too large for one aggregate, where nothing is small enough to broadcast, against their SQL."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from skyloom.functions import robust


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at, rng = tmp_path_factory.mktemp("stars"), np.random.default_rng(4)
    cells = [(m, y, x) for m, n in (("wide", 40), ("b", 8), ("c", 9)) for y in range(n) for x in range(n)]
    rows = [(k, m, 16.0 * x + 3, 16.0 * y + 3, float(rng.exponential(10) + (500 if y % 7 == 3 and x % 7 == 3 else 0)), 0.1) for k, (m, y, x) in enumerate(cells)]
    spark.createDataFrame(rows, "star_id long, mosaic_key string, x double, y double, flux double, rms_residual double").withColumn("loaded_at", F.lit(None).cast("timestamp")).write.parquet(str(at / "star_fits.parquet"))
    return str(at)


@pytest.mark.parametrize("name", ["detect_sources", "weighted_sources", "width_refine"])
def test_sources_of_large_mosaics(spark, folder, monkeypatch, name):
    monkeypatch.setattr(robust, "SMALL_GROUP", 200)
    usual = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1k")
    try:
        got = entry.queries()[name](spark, folder).toPandas()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", usual)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW star_fits AS SELECT * FROM read_parquet('{folder}/star_fits.parquet/*.parquet')")
    want = con.execute(entry.oracle_sql()[name]).fetchdf()[list(got.columns)]
    order = list(got.columns[:3])
    assert len(want) and got.sort_values(order).values.tolist() == want.sort_values(order).values.tolist()


def test_masked_cells_of_large_mosaics(spark, tmp_path, monkeypatch):
    """Cells of no weight, some of them the brightest around, are neither sources nor neighbours in mosaics of any size."""
    rng, weights = np.random.default_rng(5), [0.1, None, 0.2, 0.0, float("nan"), 0.1, float("inf")]
    cells = [(m, y, x) for m, n in (("wide", 40), ("long", 30), ("c", 9)) for y in range(n) for x in range(n)]
    rows = [(k, m, 16.0 * x + 3, 16.0 * y + 3, float(rng.exponential(10) + (500 if y % 4 == 3 and x % 4 == 3 else 0)), weights[k % 7]) for k, (m, y, x) in enumerate(cells)]
    # a second fit in every third cell: the weight may be one star's, the flux the other's
    rows += [(k + len(rows), m, x + 4, y + 4, flux + 1, weights[(k + 3) % 7]) for k, m, x, y, flux, _ in rows[::3]]
    spark.createDataFrame(rows, "star_id long, mosaic_key string, x double, y double, flux double, rms_residual double").withColumn("loaded_at", F.lit(None).cast("timestamp")).write.parquet(str(tmp_path / "star_fits.parquet"))
    monkeypatch.setattr(robust, "SMALL_GROUP", 200)
    usual = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1k")
    try:
        got = entry.queries()["weighted_sources"](spark, str(tmp_path)).toPandas()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", usual)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW star_fits AS SELECT * FROM read_parquet('{tmp_path}/star_fits.parquet/*.parquet')")
    want = con.execute(entry.oracle_sql()["weighted_sources"]).fetchdf()[list(got.columns)]
    order = list(got.columns[:3])
    assert len(want) and got.sort_values(order).values.tolist() == want.sort_values(order).values.tolist()
