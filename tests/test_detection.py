import math

import numpy as np
import pytest

from skyloom.operators import detection, planning

PX = "grp string, y bigint, x bigint, v double"


def field(stars, size=48, seed=0, sigma=1.27):
    """Pixels of a noisy image with Gaussian stars (y, x, height)."""
    rng = np.random.default_rng(seed)
    y, x = np.mgrid[:size, :size]
    v = 10 + rng.normal(0, 1, (size, size))
    for sy, sx, h in stars:
        v += h * np.exp(-((y - sy) ** 2 + (x - sx) ** 2) / (2 * sigma * sigma))
    return v


def rows(v, grp="m"):
    return [(grp, int(y), int(x), float(v[y, x])) for y in range(v.shape[0]) for x in range(v.shape[1])]


def dense(v):
    """The matched filter on the whole array: (y, x) of the stars."""
    taps, scale = detection.kernel(3.0)
    n = v.shape[0]
    big = np.pad(v, 4)
    height = sum(w * big[2 + j : n + 6 + j, 2 + i : n + 6 + i] for j, i, w in taps).round(6)
    limit = 5 * 1.4826 * np.median(np.abs(v - np.median(v))) * scale
    found = set()
    for y in range(n):
        for x in range(n):
            h, around = height[y + 2, x + 2], [height[y + 2 + j, x + 2 + i] for j, i, _ in taps]
            others = [big[y + 4 + j, x + 4 + i] for j, i, _ in taps if (j, i) != (0, 0)]
            if h > limit and h >= max(around) and 0.2 <= (v[y, x] - np.mean(others)) / h <= 1:
                found.add((y, x))
    return found


def test_matched_finds_stars_and_no_noise(spark):
    at = [(10, 12, 80.0), (30, 8, 40.0), (24, 35, 200.0)]
    v = field(at)
    got = detection.matched(spark.createDataFrame(rows(v), PX)).collect()
    inner = {(r.y, r.x) for r in got if 3 <= r.y < 45 and 3 <= r.x < 45}
    assert inner == {(y, x) for y, x, _ in at}
    assert {(r.y, r.x) for r in got} <= dense(v)
    assert [r.rank for r in sorted(got, key=lambda r: -r.height)] == list(range(1, len(got) + 1))


def test_matched_nulls_ties_and_nothing(spark):
    flat = rows(np.full((8, 8), 3.0), "flat") + [("flat", 20, 20, None)]
    twins = rows(field([(10, 10, 90.0)], 24), "twin a") + rows(field([(10, 10, 90.0)], 24), "twin b")
    got = detection.matched(spark.createDataFrame(flat + twins, PX)).collect()
    a, b = ({(r.y, r.x, r.height) for r in got if r.grp == g} for g in ("twin a", "twin b"))
    assert a == b and any((y, x) == (10, 10) for y, x, _ in a)
    assert not any(r.grp == "flat" and 2 <= r.y < 6 and 2 <= r.x < 6 for r in got)
    assert detection.matched(spark.createDataFrame([], PX)).count() == 0


def test_widths(spark):
    sigma = 1.2
    v = field([(20, 20, 1e6)], 41, sigma=sigma) - 10
    p = spark.createDataFrame([("m", 20, 20, 6)], "grp string, y bigint, x bigint, half bigint")
    got = detection.widths(p, spark.createDataFrame(rows(v), PX)).collect()
    assert got[0].width == pytest.approx(math.sqrt(2) * sigma, rel=0.01)
    even = spark.createDataFrame(rows(np.ones((5, 5))), PX)
    assert detection.widths(spark.createDataFrame([("m", 2, 2, 1)], p.schema), even).count() == 0


def test_area_keeps_the_sum(spark):
    v = field([], 12)
    got = detection.area_resampled(spark.createDataFrame(rows(v) + [("m", 40, 40, None)], PX), 2.5, 0.3, -0.8).collect()
    assert sum(r.v * r.covered for r in got) * 2.5**2 == pytest.approx(v.sum())
    assert max(r.covered for r in got) == pytest.approx(1.0)
    same = detection.area_resampled(spark.createDataFrame(rows(v), PX), 1.0, 0.0, 0.0).collect()
    assert {(r.y, r.x): r.v for r in same} == {(y, x): w for _, y, x, w in rows(v)}


def test_stage_kinds(spark):
    assert planning.stage_kinds(" subset_i2d, cal") == ["cal", "subset_i2d"]
    for bad in ("", "cal,raw"):
        with pytest.raises(ValueError):
            planning.stage_kinds(bad)
    names = ["jw02731001002_02103_00001_nrca1_cal.fits", "jw02731-o001_t017_nircam_clear-f335m_i2d.fits", "jw02731001002_02103_00001_nrca1_i2d.fits", "jw02731001002_02103_00001_nrcb1_i2d.fits", "note.txt", None]
    plan = spark.createDataFrame([(n, n and n.split("_")[3] if n and n.count("_") == 4 else None, 2) for n in names], "filename string, detector string, visit int")
    assert [r.category for r in planning.staged(plan).collect()] == ["cal", "combined_i2d", "subset_i2d", None, None, None]
    got = spark.createDataFrame([("RA---TAN-SIP",), ("DEC--TAN",), (None,)], "c string")
    assert [r[0] for r in got.select(planning.plain_projection(got.c)).collect()] == ["RA---TAN", "DEC--TAN", None]
