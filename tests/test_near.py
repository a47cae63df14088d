"""Points near points and in regions, against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyloom.functions import triangles
from skyloom.operators import near


def frame(spark, rows, shape="id bigint, plane string, x double, y double, z string"):
    return spark.createDataFrame(rows, shape)


def pairs(df):
    got = [tuple(r) for r in df.collect()]
    assert len(got) == len(set(got))
    return set(got)


@pytest.mark.parametrize("leaf_rows", [40_000, 40])
def test_flat_pairs_are_those_of_brute_force(spark, leaf_rows):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(1500):  # a third in one spot, one plane with most rows
        crowd = i % 3 == 0
        x, y = (rng.normal(50, 3, 2) if crowd else rng.uniform(-100, 300, 2)).round(1)
        rows.append((i, "a" if i % 5 else "b", float(x), float(y), "clash"))
    rows += [(5000 + k, "a", float(v), 0.0, "t") for k, v in enumerate((700.0, 702.0, 704.0, 704.0))]  # exactly at the distance, one spot twice
    dirty = [(9000, "a", None, 1.0, None), (9001, "a", float("nan"), 1.0, None), (9002, "a", float("inf"), 1.0, None), (9003, None, 1.0, 1.0, None), (None, "a", 1.0, 1.0, None)]
    df = frame(spark, rows + rows[:50] + dirty)
    at = near.flat_plane(df, "id", F.col("plane"), "x", "y")
    want = {(min(a[0], b[0]), max(a[0], b[0])) for a in rows for b in rows if a[0] < b[0] and a[1] == b[1] and math.hypot(a[2] - b[2], a[3] - b[3]) <= 2.0 + 1e-9}
    assert pairs(near.near_pairs(at, 2.0, leaf_rows=leaf_rows)) == want


@pytest.mark.parametrize("leaf_rows", [40_000, 60])
def test_sphere_pairs_cross_poles_meridian_and_cube_edges(spark, leaf_rows):
    rng = np.random.default_rng(2)
    centres = [(0, 90), (10, -90), (0, 0), (359.9999, 0), (45, 0), (45, math.degrees(math.atan(1 / math.sqrt(2)))), (135, 35.2644), (200, 44.9), (90, 45), (-0.001, 12), (720.5, -30)]
    rows = []
    for lon, lat in centres:
        for _ in range(60):
            d = rng.normal(0, 8 / 3600, 2)
            la = lat + d[1]
            lo = lon + (d[0] / max(0.02, math.cos(math.radians(lat))) if abs(lat) < 89.9 else rng.uniform(0, 360))
            rows.append((len(rows), float(lo), float(max(-90, min(90, la)))))
    radius = math.radians(10 / 3600)
    u = near.unit(np.array([r[1] for r in rows]), np.array([r[2] for r in rows]))
    d = 2 * np.arcsin(np.minimum(1, np.linalg.norm(u[:, None] - u[None], axis=2) / 2))
    want = {(int(i), int(j)) for i, j in zip(*np.nonzero(d <= radius)) if i < j}
    bad = [(9000, 10.0, 99.99), (9001, None, 1.0), (9002, 1.0, float("nan")), (9003, float("inf"), 1.0)]
    df = spark.createDataFrame(rows + rows[:9] + bad, "frame_id int, ra double, dec double")
    assert pairs(near.near_pairs(near.sky_plane(df, "frame_id", "ra", "dec"), radius, sphere=True, leaf_rows=leaf_rows)) == want


def test_empty_table_has_no_pairs(spark):
    at = near.flat_plane(frame(spark, []), "id", F.col("plane"), "x", "y")
    assert near.near_pairs(at, 2.0).count() == 0


def test_all_rows_in_one_spot(spark):
    at = near.flat_plane(frame(spark, [(i, "a", 1.5, 1.5, None) for i in range(40)]), "id", F.col("plane"), "x", "y")
    assert near.near_pairs(at, 2.0, leaf_rows=10).count() == 40 * 39 // 2


def star_polygon(rng, n):
    a = np.sort(rng.uniform(0, 2 * np.pi, n))
    r = rng.uniform(2, 10, n)
    return np.column_stack([r * np.cos(a), r * np.sin(a)])


def area(p):
    return abs((p[:, 0] * np.roll(p[:, 1], -1) - np.roll(p[:, 0], -1) * p[:, 1]).sum()) / 2


def test_ear_clipping_keeps_the_area_of_concave_polygons():
    rng = np.random.default_rng(3)
    polys = [star_polygon(rng, n) for n in (3, 4, 5, 9, 24, 30, 60, 200)]
    polys += [polys[3][::-1], np.vstack([polys[2], polys[2][:1]])]  # clockwise; closed
    owner, t = triangles.ear_clip(polys)
    for k, p in enumerate(polys):
        assert sum(area(x) for x in t[owner == k]) == pytest.approx(area(p), rel=1e-9)
        assert (owner == k).sum() == len(np.unique(p, axis=0)) - 2


def test_polygons_without_area_have_no_triangles():
    owner, t = triangles.ear_clip([np.empty((0, 2)), np.array([[0, 0], [1, 1]]), np.array([[0, 0], [1, 1], [2, 2]]), np.array([[0, 0], [1, np.nan], [2, 2]])])
    assert len(owner) == len(t) == 0


def holds(p, x, y):
    """Even-odd test of one point."""
    inside = False
    for (x0, y0), (x1, y1) in zip(p, np.roll(p, 1, 0)):
        if (y0 > y) != (y1 > y) and x < (x1 - x0) * (y - y0) / (y1 - y0) + x0:
            inside = not inside
    return inside


@pytest.mark.parametrize("leaf_rows", [40_000, 50])
def test_regions_of_points(spark, leaf_rows):
    rng = np.random.default_rng(4)
    polys = {k: star_polygon(rng, 5 + k) + rng.uniform(-10, 10, 2) for k in range(12)}
    pts = rng.uniform(-20, 20, (800, 2))
    at = spark.createDataFrame([(i, 0, float(x), float(y)) for i, (x, y) in enumerate(pts)] * 2, "id bigint, z bigint, x double, y double")
    reg = spark.createDataFrame([(k, 0, p.tolist()) for k, p in polys.items()] + [(99, 0, None), (98, 0, [[0.0, 0.0]])], "region_id bigint, z bigint, ring array<array<double>>")
    got = near.regions_of(at, reg, leaf_rows).collect()
    assert {(r[0], r[1]) for r in got} == {(i, k) for i, (x, y) in enumerate(pts) for k, p in polys.items() if holds(p, x, y)}
    assert len(got) == len({(r[0], r[1]) for r in got})


def test_a_point_on_a_shared_boundary_goes_to_one_region(spark):
    squares = [(7, [[0.0, 0.0], [2.0, 0.0], [2.0, 2.0], [0.0, 2.0]]), (3, [[2.0, 0.0], [4.0, 0.0], [4.0, 2.0], [2.0, 2.0]])]
    reg = spark.createDataFrame([(k, 0, r) for k, r in squares], "region_id bigint, z bigint, ring array<array<double>>")
    at = spark.createDataFrame([(1, 0, 2.0, 1.0), (2, 0, 1.0, 1.0), (3, 0, 0.0, 1.5), (4, 0, 3.0, 1.0), (5, 0, 9.0, 9.0)], "id bigint, z bigint, x double, y double")
    got = {tuple(r) for r in near.regions_of(at, reg).collect()}
    assert got == {(1, 3, True), (2, 7, False), (3, 7, True), (4, 3, False)}


def test_sky_regions_over_the_pole(spark):
    ring = [[0.0, 89.0], [90.0, 89.0], [180.0, 89.0], [270.0, 89.0]]
    rings = near.sky_rings(spark.createDataFrame([(1, ring)], "region_id bigint, ring array<array<double>>"))
    at = near.sky_plane(spark.createDataFrame([(1, 33.0, 89.9), (2, 10.0, 88.0), (3, 200.0, 89.5)], "id bigint, a double, b double"), "id", "a", "b")
    assert {r[0] for r in near.regions_of(at, rings).collect()} == {1, 3}


def test_rows_at_one_spot_are_split(spark):
    rows = [(i, "a", 10.0, 20.0, "") for i in range(400)] + [(1000 + i, "a", 10.0 + 0.5 * (i % 7), 20.0, "") for i in range(60)] + [(2000 + i, "b", float(i), 0.0, "") for i in range(90)]
    at = near.flat_plane(frame(spark, rows + rows[:80]), "id", F.col("plane"), "x", "y")
    want = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[1] == b[1] and math.hypot(a[2] - b[2], a[3] - b[3]) <= 2.0 + 1e-9}
    assert near.place_cuts(at.select("z", "x", "y"), 50).split.max() > 4
    assert pairs(near.near_pairs(at, 2.0, leaf_rows=50)) == want
    square = [(7, [[5.0, 15.0], [15.0, 15.0], [15.0, 25.0], [5.0, 25.0]]), (8, [[10.0, 20.0], [30.0, 20.0], [30.0, 40.0]])]
    z = at.filter("x = 10 AND y = 20").select("z").first()[0]
    regions = spark.createDataFrame([(k, z, r) for k, r in square], "region_id bigint, z bigint, ring array<array<double>>")
    got = near.regions_of(at.filter(F.col("z") == z), regions, leaf_rows=50)
    assert {r["id"] for r in got.filter("region_id = 7").collect()} >= {r[0] for r in rows[:400]}
    assert got.count() == got.distinct().count()


def test_regions_over_a_third_of_the_sphere(spark):
    rng = np.random.default_rng(4)
    v = rng.normal(size=(3_000, 3))
    v /= np.linalg.norm(v, axis=1)[:, None]
    rows = [(i, math.degrees(math.atan2(p[1], p[0])), math.degrees(math.asin(p[2]))) for i, p in enumerate(v)]
    rings = {1: [[-60.0, -50.0], [60.0, -50.0], [60.0, 50.0], [-60.0, 50.0]], 2: [[100.0, 10.0], [170.0, 10.0], [170.0, 80.0], [100.0, 80.0]], 3: [[0.0, 40.0], [120.0, 40.0], [240.0, 40.0]]}

    def inside(p, ring):  # convex rings: left of every great circle
        c = near.unit(np.array([x[0] for x in ring]), np.array([x[1] for x in ring]))
        side = np.array([np.cross(c[k - 1], c[k]) @ p for k in range(len(c))])
        return (side > 0).all()

    want = {(i, k) for i, p in enumerate(v) for k, ring in rings.items() if inside(p, ring)}
    at = near.sky_plane(spark.createDataFrame(rows, "id int, ra double, dec double"), "id", "ra", "dec")
    regions = near.sky_rings(spark.createDataFrame(list(rings.items()), "region_id bigint, ring array<array<double>>"))
    assert {(r["id"], r["region_id"]) for r in near.regions_of(at, regions).collect()} == want and len(want) > 800
