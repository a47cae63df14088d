import pytest

from skyloom.sources import documents

FRAME = "filename string, visit int, exposure int, detector string, group_key string, dx double, dy double, background_offset double, n_detected int, n_matched int, residual_rms_px double, residual_max_px double, is_reference boolean, visit_dx double, visit_dy double"


def test_registrations_round_trip(spark, tmp_path):
    rows = [(f"f{i}", i % 2, i, "nrca1", "g", 3.0, 4.0, None, 9, 8, float("nan") if i == 0 else 0.5, 0.9, i == 0, 0.0, 0.0) for i in range(5)]
    f = spark.createDataFrame(rows, FRAME)
    documents.write_registrations(f, str(tmp_path / "r"), "visit")
    back = documents.registration_frames(spark, str(tmp_path / "r"), lines=True).select(f.columns)
    want = [r[:10] + (None,) + r[11:] if r[2] == 0 else r for r in rows]
    assert sorted(map(tuple, back.collect()), key=lambda r: r[0]) == want
    whole = spark.read.json(str(tmp_path / "r")).orderBy("visit").collect()
    assert [(w.n_frames, w.rms_shift_px) for w in whole] == [(3, 5.0), (2, 5.0)]
    assert [x.exposure for x in whole[0].frames] == [0, 2, 4]


def test_grid_is_written_once(spark, tmp_path):
    cards = spark.createDataFrame([("a", "GRDNX", 10.0), ("a", "CRVAL1", 1.5), ("b", "GRDNX", 3.0)], "file_name string, card string, value double")
    path = str(tmp_path / "grid")
    documents.write_grid(cards, path)
    assert sorted(documents.read_grid(spark, path).collect()) == sorted(cards.collect())
    with pytest.raises(Exception, match="(?i)exist"):
        documents.write_grid(cards, path)


def test_bands_stay_in_parquet(spark, tmp_path):
    cube = spark.createDataFrame([(1, 2, 3, 4)], "cx int, red int, green int, blue int")
    documents.with_bands(cube, {"red": "F444W", "green": "F200W", "blue": "F090W"}, 0.031).write.parquet(str(tmp_path / "cube"))
    meta = {f.name: f.metadata for f in spark.read.parquet(str(tmp_path / "cube")).schema}
    assert meta["green"] == {"BAND2": "F200W", "PIXSCALE": 0.031} and meta["cx"] == {}


def test_groups(spark, tmp_path):
    documents.write_groups(spark.createDataFrame([("g", 1.5, None)], "k string, v double, w double"), str(tmp_path / "g"))
    assert [tuple(r) for r in spark.read.json(str(tmp_path / "g")).collect()] == [("g", 1.5)]
