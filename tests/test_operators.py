"""Matching, graphs, clipping, images, planning, sources and streams on small tables."""

import json
import math
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyloom.functions import robust
from skyloom.operators import graphs, images, matching, planning
from skyloom.sources import documents, files, fits
from skyloom.streaming import arrivals


def catalogue(spark, xy, grp="g"):
    return spark.createDataFrame([(grp, i, float(x), float(y)) for i, (x, y) in enumerate(xy)], "grp string, id bigint, x double, y double")


def test_planted_shift_is_recovered(spark):
    rng = np.random.default_rng(11)
    p = rng.uniform(0, 2000, (60, 2))
    t = matching.translation(matching.nearest(catalogue(spark, p), catalogue(spark, p + [0.3, -0.2]), 10.0)).first()
    assert (t["n"], t["dx"], t["dy"]) == (60, pytest.approx(0.3), pytest.approx(-0.2))


def test_matches_against_brute_force(spark):
    rng = np.random.default_rng(5)
    a, b = rng.uniform(0, 60, (120, 2)).round(0), rng.uniform(0, 60, (110, 2)).round(0)  # many ties
    d2 = ((a[:, None] - b[None]) ** 2).sum(2)
    near = {i: min(range(len(b)), key=lambda j: (d2[i, j], j)) for i in range(len(a)) if d2[i].min() <= 25}
    back = {j: min(range(len(a)), key=lambda i: (d2[i, j], i)) for j in range(len(b)) if d2[:, j].min() <= 25}
    A, B = catalogue(spark, a), catalogue(spark, b)
    pick = lambda df: {(r["a_id"], r["b_id"]) for r in df.collect()}
    assert pick(matching.nearest(A, B, 5.0)) == set(near.items())
    assert pick(matching.mutual_nearest(A, B, 5.0)) == {(i, j) for i, j in near.items() if back[j] == i}
    offers = {}
    for i, j in near.items():
        offers.setdefault(j, []).append((d2[i, j], i))
    assert pick(matching.one_to_one(A, B, 5.0)) == {(min(o)[1], j) for j, o in offers.items()}
    far = {r["a_id"] for r in matching.nearest_distance(A, B, 5.0).filter("distance = double('Infinity')").collect()}
    assert far == set(range(len(a))) - set(near)


def test_zero_deviation_clips_every_unequal_value(spark):
    df = spark.createDataFrame([("a", 1.0)] * 4 + [("a", 501.0), ("b", 1.0), ("b", 3.0), ("c", None)], "k string, v double")
    got = {r["k"]: (r["coverage"], r["kept"], r["value"]) for r in robust.stacked(df, ["k"], "v", mean=True).collect()}
    assert got == {"a": (5, 4, 1.0), "b": (2, 2, 2.0), "c": (0, 0, None)}


def test_whole_percentiles_are_exact(spark):
    v = np.random.default_rng(1).normal(size=20_001).round(3)
    df = spark.createDataFrame([(float(x),) for x in v] + [(None,), (float("nan"),)], "v double")
    at = [0.0, 0.01, 0.5, 0.995, 1.0]
    assert robust.whole_percentiles(df, "v", at, accuracy=500) == pytest.approx(np.quantile(v, at), abs=1e-12)
    assert robust.whole_percentiles(df.filter("v > 99"), "v", [0.5]) == [None]


def test_connected_groups(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (200, 200)] + [(None, 3)] + [(500, 500 + k) for k in range(1, 60)]
    got = {r["node"]: r["root"] for r in graphs.connected(spark.createDataFrame(chain, "a int, b int"), "a", "b").collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100, 200: 200, **{500 + k: 500 for k in range(60)}}


def test_visit_shifts_recover_the_truth_up_to_a_constant(spark):
    truth = {"v1": (0.0, 0.0), "v2": (3.0, -2.0), "v3": (1.0, 1.0), "v4": (-2.0, 0.5)}
    rng, rows = np.random.default_rng(3), []
    for a in truth:
        for b in truth:
            if a < b:
                d = np.subtract(truth[b], truth[a]) + rng.normal(0, 0.02, (40, 2))
                rows += [("g", a, b, float(x), float(y)) for x, y in -d * -1]
    e = graphs.pair_edges(spark.createDataFrame(rows, "grp string, a string, b string, dx double, dy double"))
    got = {r["node"]: (r["dx"], r["dy"]) for r in graphs.visit_shifts(e).collect()}
    for v, (x, y) in truth.items():  # corrections are the negated shifts
        assert got[v][0] - got["v1"][0] == pytest.approx(-x, abs=0.02) and got[v][1] - got["v1"][1] == pytest.approx(-y, abs=0.02)


def test_brightest_separated(spark):
    s = spark.createDataFrame([("g", 1, 0.0, 0.0, 9.0), ("g", 2, 1.0, 0.0, 8.0), ("g", 3, 2.0, 0.0, 7.0), ("g", 4, 5.0, 0.0, 7.0)], "grp string, id bigint, x double, y double, flux double")
    assert {r["id"] for r in graphs.brightest_separated(s, 2.0).collect()} == {1, 3, 4}


def dense(spark, a):
    return spark.createDataFrame([("g", y, x, float(a[y, x])) for y in range(a.shape[0]) for x in range(a.shape[1]) if not math.isnan(a[y, x])], "grp string, y bigint, x bigint, v double").withColumn("rows", F.lit(a.shape[0])).withColumn("cols", F.lit(a.shape[1]))


def test_cubic_shift_moves_a_smooth_image(spark):
    yy, xx = np.mgrid[0:70, 0:80]
    star = lambda dx, dy: 100 * np.exp(-((xx - 40 - dx) ** 2 + (yy - 35 - dy) ** 2) / 18)
    a = star(0, 0)
    shifts = spark.createDataFrame([("g", 0.37, -0.61, 0.0)], "grp string, dx double, dy double, background double")
    got = np.full(a.shape, np.nan)
    for r in images.cubic_shift(dense(spark, a), shifts).collect():
        got[r["y"], r["x"]] = r["v"]
    assert np.abs(got - star(0.37, -0.61)).max() < 0.1


def test_bilinear_and_block_mean(spark):
    yy, xx = np.mgrid[0:9, 0:10]
    a = 2.0 * xx + 3 * yy
    a[4, 4] = np.nan
    got = {(r["y"], r["x"]): r["v"] for r in images.bilinear(dense(spark, a), 0.5, 0.25).collect()}
    assert len(got) == 8 * 9 - 4 and all(v == pytest.approx(2 * (x + 0.25) + 3 * (y + 0.5)) for (y, x), v in got.items())
    blocks = {(r["r"], r["c"]): r["v"] for r in images.block_mean(dense(spark, a), 4).collect()}
    assert set(blocks) == {(0, 0), (0, 1), (1, 0), (1, 1)} and blocks[0, 0] == pytest.approx(np.nanmean(a[:4, :4]))


def test_tangent_plane_round_trip(spark):
    df = spark.createDataFrame([(1.0, 0.5, 1.01, 0.49), (6.28, 1.55, 0.3, 1.56), (0.0, -1.5707, 3.0, -1.57)], "a double, d double, l double, b double")
    xi, eta = images.tan_plane(F.col("l"), F.col("b"), F.col("a"), F.col("d"))
    lon, lat = images.tan_sky(xi, eta, F.col("a"), F.col("d"))
    for r in df.select(F.sin(lon - F.col("l")).alias("x"), (lat - F.col("b")).alias("y")).collect():
        assert abs(r["x"]) < 1e-9 and abs(r["y"]) < 1e-12


def test_stretch_refuses_a_wrong_scale():
    with pytest.raises(ValueError):
        images.asinh_stretch(F.lit(1.0), 2.0, 1.0)


def test_every_point_is_owned_once(spark):
    p = catalogue(spark, [(0, 0), (63.9, 64), (64, 64), (-1, 127.5), (10, 60)])
    h = planning.with_halo(p, 64, 8)
    assert {r["id"]: r["n"] for r in h.filter("interior").groupBy("id").agg(F.count("*").alias("n")).collect()} == {i: 1 for i in range(5)}
    assert h.filter("id = 2").count() == 4


def test_reconciled_states(spark):
    plan = spark.createDataFrame([("a", 1), ("b", 2), ("c", 0), ("d", None)], "filename string, expected_size bigint")
    disk = spark.createDataFrame([("a", 1), ("b", 3), ("c", 0), ("e", 5)], "filename string, actual_size bigint")
    assert {r["filename"]: r["state"] for r in planning.reconciled(plan, disk).collect()} == {"a": "ok", "b": "size_mismatch", "c": "size_mismatch", "d": "missing", "e": "extra"}


def test_name_parts(spark):
    df = spark.createDataFrame([("jw02731001001_02103_00007_nrcalong_cal.fits",), (" JW02731001003_02103_00010_NRCB4_I2D.FITS",), ("other.txt",), (None,)], "n string")
    got = [tuple(r) for r in df.select(*planning.name_parts(F.col("n"))).collect()]
    assert got == [("02731", "001", 1, 7, "nrcalong", "cal"), ("02731", "001", 3, 10, "nrcb4", "i2d"), (None, None, -1, -1, None, None), (None, None, -1, -1, None, None)]


def test_fits_round_trip(spark, tmp_path):
    spark.dataSource.register(fits.FitsSource)
    a = np.arange(300 * 7, dtype=np.float32).reshape(300, 7)
    a[3, 2] = np.nan
    (tmp_path / "in.fits").write_bytes(fits.image_bytes(a, [("EXTNAME", "SCI"), ("CRVAL1", 160.5), ("NOTE", "it's")]))
    px = spark.read.format("fits").option("hdu", "SCI").load(str(tmp_path / "in.fits"))
    assert px.count() == a.size and px.filter("v IS NULL").select("y", "x").collect() == [(3, 2)]
    assert px.agg(F.sum("v")).first()[0] == pytest.approx(np.nansum(a.astype(float)))
    head = spark.read.format("fits").option("what", "headers").load(str(tmp_path / "*.fits")).first()
    assert (head["name"], head["header"]["NOTE"], head["header"]["CRVAL1"]) == ("SCI", "it's", "160.5")
    out = str(tmp_path / "out")
    px.repartition(1).select("y", "x", "v").write.format("fits").option("width", 7).mode("append").save(out)
    back = spark.read.format("fits").load(out + "/*.fits")
    assert back.filter("v IS NOT NULL").join(px, ["y", "x", "v"]).count() == a.size - 1


def test_sections_and_registrations(spark, tmp_path):
    p = str(tmp_path / "r.json")
    documents.put_section(p, "a", {"x": 1})
    documents.put_section(p, "b", {"y": 2})
    documents.put_section(p, "a", {"z": 3})
    assert documents.section(p, "a") == {"z": 3} and documents.section(p, "b") == {"y": 2} and documents.section(p, "c") == {}
    q = tmp_path / "f.json"
    q.write_text('{"frames": [{"filename": "f", "dx": 0.5, "residual_rms_px": NaN}]}')
    r = documents.registration_frames(spark, str(q)).first()
    assert (r["dx"], r["residual_rms_px"], r["visit_dx"]) == (0.5, None, 0.0)


def test_stream_counts_repeated_deliveries_once(spark, tmp_path):
    t0 = datetime(2024, 1, 1)
    rows = [(i, t0 + timedelta(minutes=i), "k", float(i)) for i in range(180)]
    spark.createDataFrame(rows + rows[:30], "id bigint, at timestamp, key string, v double").repartition(3).write.parquet(str(tmp_path / "in"))
    s = arrivals.readings(spark, str(tmp_path / "in"), "id bigint, at timestamp, key string, v double")
    q = arrivals.windowed(s, "at", "key", "id", "v").writeStream.format("memory").queryName("w").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination(120)
    assert all(r["n"] == 60 for r in spark.table("w").collect())


@pytest.mark.parametrize("small", [100_000, 50])
def test_group_percentiles_are_exact(spark, small, monkeypatch):
    monkeypatch.setattr(robust, "SMALL_GROUP", small)
    rng = np.random.default_rng(6)
    rows = [(k, float(v), float(v) ** 2 if i % 7 else None) for k, n in (("a", 1), ("b", 2), ("c", 3000), ("d", 801)) for i, v in enumerate(rng.normal(size=n).round(2))]
    df = spark.createDataFrame([*rows, ("a", float("nan"), None), ("e", None, None)], "k string, v double, u double")
    got = {r["k"]: r for r in robust.group_percentiles(df, ["k"], {"m": ("v", 0.5), "p": ("v", 0.99), "u": ("u", 0.16)}, accuracy=200).collect()}
    for k in "abcd":
        v, u = [r[1] for r in rows if r[0] == k], [r[2] for r in rows if r[0] == k and r[2] is not None]
        assert got[k]["m"] == pytest.approx(np.quantile(v, 0.5), abs=1e-12) and got[k]["p"] == pytest.approx(np.quantile(v, 0.99), abs=1e-12)
        assert (got[k]["u"] is None and not u) or got[k]["u"] == pytest.approx(np.quantile(u, 0.16), abs=1e-12)
    assert "e" not in got


def test_frames_are_moved_onto_common_pixels(spark):
    yy, xx = np.mgrid[0:9, 0:10]
    a = 2.0 * xx + 3 * yy
    frames = dense(spark, a).select("grp", F.lit(1).alias("frame"), "y", "x", "v").unionByName(dense(spark, a).select("grp", F.lit(2).alias("frame"), "y", "x", "v"))
    shifts = spark.createDataFrame([("g", 1, 0.0, 0.0), ("g", 2, 1.25, -2.5)], "grp string, frame int, sy double, sx double")
    got = {(r["frame"], r["y"], r["x"]): r["v"] for r in images.moved(frames, shifts).collect()}
    assert all(v == pytest.approx(2 * x + 3 * y) for (f, y, x), v in got.items() if f == 1)
    assert all(v == pytest.approx(2 * (x + 2.5) + 3 * (y - 1.25)) for (f, y, x), v in got.items() if f == 2) and sum(f == 2 for f, _, _ in got) > 40


def test_sources_have_centroids_and_ties_count_once(spark):
    rng = np.random.default_rng(1)
    a = rng.normal(10, 1, (40, 40))
    a[10, 10], a[10, 11], a[30, 20], a[30, 21] = 100.0, 55.0, 80.0, 80.0
    got = {(r["y"], r["x"]): r for r in images.sources(dense(spark, a).drop("rows", "cols"), 10.0).collect()}
    assert set(got) == {(10, 10), (30, 20)} and 10.2 < got[10, 10]["cx"] < 10.45 and 20.4 < got[30, 20]["cx"] < 20.6


def test_filter_specs(spark):
    rows = [(1, "F444W", "CLEAR"), (2, "f444w ", "F405N"), (3, "F200W", None), (4, "F200W", "F164N"), (5, None, "CLEAR")]
    df = spark.createDataFrame(rows, "id int, f string, p string")
    ids = lambda specs: {r["id"] for r in df.filter(planning.of_specs(F.col("f"), F.col("p"), specs)).collect()}
    assert ids(["F444W"]) == {1, 2} and ids(["F444W;F405N"]) == {2} and ids(["F444W;F405N", "f200w"]) == {2} and ids(["F444W", "F200W;CLEAR"]) == {1, 3}


def test_listing_and_manifest(spark, tmp_path):
    for d, n in (("a", "x_cal.fits"), ("b", "x_cal.fits"), ("b", "y_cal.fits"), ("b", "z.txt")):
        (tmp_path / d).mkdir(exist_ok=True)
        (tmp_path / d / n).write_bytes(b"1" * (3 if d == "b" else 1))
    got = {r["name"]: r["length"] for r in files.listing(spark, str(tmp_path)).collect()}
    assert got == {"x_cal.fits": 3, "y_cal.fits": 3}
    rows = spark.createDataFrame([("a,b", 1), ('quo"te', None)], "name string, size bigint")
    files.write_manifest(rows, str(tmp_path / "m"))
    assert sorted(map(tuple, files.read_manifest(spark, str(tmp_path / "m"), "name string, size bigint").collect())) == [("a,b", 1), ('quo"te', None)]


SHIFTS = {1: (-0.49, -0.65), 2: (0.12, 0.04), 3: (0.07, 0.23), 4: (0.18, 0.22)}


def solved(spark, pairs, n=200, **how):
    rows = [("f", a, b, n, SHIFTS[b][0] - SHIFTS[a][0], SHIFTS[b][1] - SHIFTS[a][1], 0.06) for a, b in pairs]
    return graphs.visit_shifts(spark.createDataFrame(rows, "grp string, a int, b int, n int, dx double, dy double, mad double"), **how).orderBy("node").collect()


def test_the_gauge_visit_stays_and_consensus_is_a_diagnosis(spark):
    got = solved(spark, [(2, 1), (3, 1), (4, 1)] * 2)
    assert [r["is_consensus"] for r in got] == [False, True, True, True] and {r["gauge"] for r in got} == {1}
    assert (got[0]["dx"], got[0]["dy"]) == (0.0, 0.0) and max(r["residual_rms"] for r in got) < 1e-6
    for r in got:
        assert r["dx"] == pytest.approx(SHIFTS[1][0] - SHIFTS[r["node"]][0]) and r["dy"] == pytest.approx(SHIFTS[1][1] - SHIFTS[r["node"]][1])
    third = solved(spark, [(1, 2), (2, 3), (3, 4)], gauge=3)
    assert third[2]["dx"] == 0.0 and third[0]["dx"] == pytest.approx(SHIFTS[3][0] - SHIFTS[1][0])
    with pytest.raises(Exception, match="not among the nodes"):
        solved(spark, [(1, 2)], gauge=7)


def test_edges_weigh_by_root_n_over_scatter(spark):
    rows = [("f", 1, 2, 400, 1.0, 0.0, 0.1), ("f", 1, 2, 100, 4.0, 0.0, 0.2), ("f", 1, 2, 0, 2.0, 0.0, 0.0)]
    got = graphs.visit_shifts(spark.createDataFrame(rows, "grp string, a int, b int, n int, dx double, dy double, mad double")).filter("node = 2").first()
    w, z = np.array([200.0, 50.0, 20.0]), np.array([1.0, 4.0, 2.0])
    t = (w * z).sum() / w.sum()
    assert got["dx"] == pytest.approx(-t) and got["residual_rms"] == pytest.approx(math.sqrt((w * (t - z) ** 2).sum() / w.sum() / 2))


def test_brightest_separated_walks_the_whole_order(spark):
    # 900 bright stars in one spot come before the distant ones
    rng = np.random.default_rng(5)
    rows = [("g", i, float(x), float(y), float(f)) for i, (x, y, f) in enumerate(zip(rng.uniform(0, 40, 900), rng.uniform(0, 40, 900), rng.integers(500, 900, 900)))]
    rows += [("g", 1_000 + k, 1_000.0 + 50 * k, 0.0, 1.0) for k in range(30)]
    taken = []
    for r in sorted(rows, key=lambda r: (-r[4], r[1])):
        if all(math.hypot(r[2] - t[2], r[3] - t[3]) >= 6.0 for t in taken):
            taken.append(r)
    df = spark.createDataFrame(rows + rows[:9], "grp string, id bigint, x double, y double, flux double")
    assert {r["id"] for r in graphs.brightest_separated(df, 6.0).collect()} == {t[1] for t in taken}
    assert {r["id"] for r in graphs.brightest_separated(df, 6.0, 12).collect()} == {t[1] for t in taken[:12]}


def test_percentiles_of_groups_of_any_size(spark):
    rng = np.random.default_rng(2)
    rows = [("big", float(v)) for v in rng.normal(size=4_000).round(2)] + [("same", 3.0)] * 900 + [("small", float(k)) for k in range(7)] + [(None, 1.0), (None, 4.0), ("small", None), ("small", float("nan"))]
    df = spark.createDataFrame(rows, "g string, v double").repartition(3)
    wanted = {"lo": ("v", 0.01), "mid": ("v", 0.5), "hi": ("v", 0.995)}
    for most in (100_000, 200):
        got = {r["g"]: (r["lo"], r["mid"], r["hi"]) for r in robust.group_percentiles(df, ["g"], wanted, most=most).collect()}
        for g in ("big", "same", "small", None):
            v = [x for k, x in rows if k == g and x is not None and x == x]
            assert got[g] == pytest.approx(tuple(np.percentile(v, [1, 50, 99.5])))
    v = [x for _, x in rows if x is not None and x == x]
    assert robust.whole_percentiles(df, "v", [0.1, 0.9], most=300) == pytest.approx(list(np.percentile(v, [10, 90])))
    cut = {most: sorted((r["g"] or "", r["v"], r["_kept"] or 0.0) for r in robust.clipped_large(df.filter("v IS NOT NULL AND NOT isnan(v)"), ["g"], "v", 1.5, 3, most=most).collect()) for most in (100_000, 200)}
    assert cut[200] == cut[100_000]


def test_rows_are_numbered_in_groups_of_any_size(spark):
    df = spark.createDataFrame([(k % 3, k * 7 % 5_003) for k in range(5_003)], "g int, id int")
    got = robust.numbered(df, ["g"], "id", most=100).collect()
    for g in range(3):
        own = sorted((r["id"], r["_i"], r["_n"]) for r in got if r["g"] == g)
        assert [x[1] for x in own] == list(range(len(own))) and {x[2] for x in own} == {len(own)}
