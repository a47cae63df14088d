"""Footprints of every exposure are regions, not only those of the first."""

import os

import __spark_entry__ as entry


def test_every_exposure_has_a_footprint(spark, tmp_path):
    rows = [(1, 1, 10.0, 20.0), (2, 7, 10.001, 20.0), (3, 7, 50.0, -60.0), (4, 9, 50.0, -60.0), (5, 2, None, 3.0), (6, 2, 10.0, 95.0)]
    df = spark.createDataFrame([(*r, 0.031) for r in rows], "frame_id bigint, exposure int, ra_deg double, dec_deg double, pixscale_arcsec double")
    df.union(df.limit(2)).write.parquet(os.path.join(tmp_path, "frames.parquet"))
    got = [tuple(r) for r in entry.queries()["p1_footprints"](spark, str(tmp_path)).collect()]
    assert sorted(got) == [(a, b, False) for a, b in ((1, 1), (1, 2), (2, 1), (2, 2), (3, 3), (3, 4), (4, 3), (4, 4))]
