"""Images as pixel tables ``(grp, y, x, v)`` with missing pixels absent: resampling, reduction, peaks and stretches."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyloom.functions import robust

BAND = 64
_POLE = 3**0.5 - 2  # of the cubic B-spline's inverse filter
_REACH = 12  # taps on either side; the filter has fallen to 1e-7 there


def block_mean(image: DataFrame, size: int, height: str = "rows", width: str = "cols") -> DataFrame:
    """Mean of the present pixels of each ``size`` x ``size`` block; the ragged last rows and columns are dropped.

    The image's extent is in columns ``height`` and ``width`` (pixels counted from 0).
    """
    whole = (F.col("y") < F.floor(F.col(height) / size) * size) & (F.col("x") < F.floor(F.col(width) / size) * size)
    by, bx = F.floor(F.col("y") / size).cast("bigint"), F.floor(F.col("x") / size).cast("bigint")
    return image.filter(whole).groupBy("grp", by.alias("r"), bx.alias("c")).agg(F.avg("v").alias("v"), F.count("v").alias("n"))


def bilinear(image: DataFrame, dy: float, dx: float) -> DataFrame:
    """The image sampled at (y + dy, x + dx), 0 <= dy, dx < 1; a sample that touches a missing pixel is missing."""
    taps = F.array(*[F.struct(F.lit(j).alias("j"), F.lit(i).alias("i"), F.lit((1 - abs(j - dy)) * (1 - abs(i - dx))).alias("w")) for j in (0, 1) for i in (0, 1)])
    e = image.filter("v IS NOT NULL").withColumn("t", F.explode(taps)).select("grp", (F.col("y") - F.col("t.j")).alias("y"), (F.col("x") - F.col("t.i")).alias("x"), (F.col("v") * F.col("t.w")).alias("wv"))
    return e.groupBy("grp", "y", "x").agg(F.sum("wv").alias("v"), F.count("*").alias("n")).filter("n = 4").drop("n")


def moved(frames: DataFrame, shifts: DataFrame) -> DataFrame:
    """Each frame's image ``(grp, frame, y, x, v)`` moved by its own ``(grp, frame, sy, sx)`` onto the common pixels, bilinearly.

    A sample that touches a missing pixel is missing; frames without a shift are left out.
    """
    part = lambda c: (-F.col(c) - F.floor(-F.col(c)))
    s = shifts.select("grp", "frame", F.floor(-F.col("sy")).cast("bigint").alias("oy"), F.floor(-F.col("sx")).cast("bigint").alias("ox"), part("sy").alias("fy"), part("sx").alias("fx"))
    taps = F.array(*[F.struct(F.lit(j).alias("j"), F.lit(i).alias("i"), ((F.col("fy") if j else 1 - F.col("fy")) * (F.col("fx") if i else 1 - F.col("fx"))).alias("w")) for j in (0, 1) for i in (0, 1)])
    e = frames.filter("v IS NOT NULL").join(s, ["grp", "frame"]).withColumn("t", F.explode(taps))
    e = e.select("grp", "frame", (F.col("y") - F.col("oy") - F.col("t.j")).alias("y"), (F.col("x") - F.col("ox") - F.col("t.i")).alias("x"), (F.col("v") * F.col("t.w")).alias("wv"))
    return e.groupBy("grp", "frame", "y", "x").agg(F.sum("wv").alias("v"), F.count("*").alias("n")).filter("n = 4").drop("n")


def sources(image: DataFrame, sigma: float = 5.0) -> DataFrame:
    """Pixels ``sigma`` scaled MADs above their group's median that no pixel of their 3 x 3 square outshines (a tie goes to the smaller (y, x)).

    ``(grp, y, x, v, n, cy, cx, width)``: ``cy``, ``cx`` is the centroid and ``width`` the root mean square distance from it of
    the square's present pixels, weighted by their height over the median where positive.
    """
    mid = robust.group_percentiles(image, ["grp"], {"level": ("v", 0.5)})
    off = image.join(mid, "grp").withColumn("off", F.abs(F.col("v") - F.col("level")))
    mad = robust.group_percentiles(off, ["grp"], {"mad": ("off", 0.5)})
    at = off.join(mad, "grp").withColumn("up", F.greatest(F.col("v") - F.col("level"), F.lit(0.0)))
    high = at.filter(F.col("v") > F.col("level") + sigma * 1.4826 * F.col("mad")).select("grp", F.col("y").alias("py"), F.col("x").alias("px"), F.col("v").alias("pv"))
    around = F.array(*[F.struct(F.lit(j).alias("j"), F.lit(i).alias("i")) for j in (-1, 0, 1) for i in (-1, 0, 1)])
    square = high.withColumn("o", F.explode(around)).withColumn("y", F.col("py") + F.col("o.j")).withColumn("x", F.col("px") + F.col("o.i")).drop("o")
    c = square.join(at.select("grp", "y", "x", "v", "up"), ["grp", "y", "x"])
    beats = (F.col("v") > F.col("pv")) | ((F.col("v") == F.col("pv")) & (F.struct("y", "x") < F.struct("py", "px")))
    dy, dx = F.col("y") - F.col("py"), F.col("x") - F.col("px")
    m = c.groupBy("grp", "py", "px").agg(
        F.first("pv").alias("v"), F.count("*").alias("n"), F.bool_or(beats).alias("beaten"), F.sum("up").alias("w"), F.sum(F.col("up") * dy).alias("wy"), F.sum(F.col("up") * dx).alias("wx"), F.sum(F.col("up") * (dy * dy + dx * dx)).alias("wr"),
    )
    my, mx = F.col("wy") / F.col("w"), F.col("wx") / F.col("w")
    return m.filter("NOT beaten").select("grp", F.col("py").alias("y"), F.col("px").alias("x"), "v", "n", (F.col("py") + my).alias("cy"), (F.col("px") + mx).alias("cx"), F.sqrt(F.greatest(F.col("wr") / F.col("w") - my * my - mx * mx, F.lit(0.0))).alias("width"))


def local_peaks(image: DataFrame, half: int = 5, percent: float = 0.99, most: int = 30) -> DataFrame:
    """Each group's ``most`` brightest pixels that are the maximum of their square and at or above its ``percent`` percentile.

    A pixel that outshines a peak is above the percentile, too, so only pixels above it are looked at. The square's
    maximum is taken along rows, then along columns: 2 x (2 half + 1) copies instead of (2 half + 1) squared.
    """
    high = robust.group_percentiles(image, ["grp"], {"limit": ("v", percent)})
    bright = image.join(high, "grp").filter(F.col("v") >= F.col("limit")).select("grp", "y", "x", "v")
    offsets = F.explode(F.sequence(F.lit(-half), F.lit(half)))
    rows = bright.withColumn("o", offsets).groupBy("grp", "y", (F.col("x") + F.col("o")).alias("x")).agg(F.max("v").alias("m"))
    square = rows.withColumn("o", offsets).groupBy("grp", (F.col("y") + F.col("o")).alias("y"), "x").agg(F.max("m").alias("m"))
    peaks = bright.join(square, ["grp", "y", "x"]).filter(F.col("v") >= F.col("m"))
    w = Window.partitionBy("grp").orderBy(F.desc("v"), "y", "x")
    return peaks.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most).select("grp", "y", "x", "v", "rank")


def _spline_taps(shift: float) -> np.ndarray:
    """Weights of pixels k - REACH .. k + REACH for the cubic-spline value at k - shift."""
    j = np.arange(-2 * _REACH, 2 * _REACH + 1)
    inverse = -6 * _POLE / (1 - _POLE**2) * _POLE ** np.abs(j)

    def b3(t: np.ndarray) -> np.ndarray:
        t = np.abs(t)
        return np.where(t < 1, 2 / 3 - t * t + t**3 / 2, np.where(t < 2, (2 - t) ** 3 / 6, 0))

    k = np.arange(-_REACH, _REACH + 1)
    return np.array([(inverse * b3(-shift - i - j)).sum() for i in k])


def _shift_axis(image: DataFrame, along: str, across: str) -> DataFrame:
    """One pass along an axis over bands of ``BAND`` lines; lines are edge-extended at the image's ends."""

    def shift(p: pd.DataFrame) -> pd.DataFrame:
        n, lines = int(p["extent"].iloc[0]), p[across].to_numpy() % BAND
        dense = np.zeros((BAND, n))
        dense[lines, p[along]] = p["f"]
        taps = _spline_taps(float(p["shift"].iloc[0]))
        wide = np.pad(dense, ((0, 0), (_REACH, _REACH)), "edge")
        out = sum(w * wide[:, i : i + n] for i, w in enumerate(taps))
        y, x = np.nonzero(np.isin(np.arange(BAND), lines)[:, None] & np.ones(n, bool))
        p0 = p.iloc[0]
        return pd.DataFrame({"grp": p0["grp"], along: x, across: y + int(p0["band"]) * BAND, "f": out[y, x]})[["grp", "y", "x", "f"]]

    banded = image.withColumn("band", F.floor(F.col(across) / BAND))
    return banded.groupBy("grp", "band").applyInPandas(shift, "grp string, y bigint, x bigint, f double")


def cubic_shift(image: DataFrame, shifts: DataFrame, height: str = "rows", width: str = "cols") -> DataFrame:
    """The image moved by ``(grp, dx, dy, background)`` with a cubic B-spline, less the background.

    Missing pixels count as 0 and are masked again afterwards by the image as it was. A
    pixel's neighbours beyond the image are its edge. Groups without a shift are left out.
    """
    full = image.filter("v IS NOT NULL").join(shifts, "grp")
    by_x = _shift_axis(full.select("grp", "y", "x", F.col("v").alias("f"), F.col(width).alias("extent"), F.col("dx").alias("shift")), "x", "y")
    extent = full.groupBy("grp").agg(F.max(height).alias("extent"), F.max("dy").alias("shift"))
    by_y = _shift_axis(by_x.join(extent, "grp"), "y", "x")
    return full.select("grp", "y", "x", "background").join(by_y, ["grp", "y", "x"]).select("grp", "y", "x", (F.col("f") - F.col("background")).alias("v"))


def asinh_stretch(v: Column, low: float, high: float, background: float = 0.0, softening: float | None = None) -> Column:
    """``v`` on [0, 1]: asinh of its height over the background, with ``low`` to ``high`` as full scale."""
    soft = 0.1 * (high - low) if softening is None else softening
    if not (soft > 0 and high > low):
        raise ValueError("softening must be positive and high above low")
    scaled = lambda x: F.asinh((x - F.lit(background)) / F.lit(soft))
    y0, y1 = scaled(F.lit(low)), scaled(F.lit(high))
    y = (scaled(v) - y0) / (y1 - y0)
    return F.when(v.isNotNull(), F.least(F.greatest(y, F.lit(0.0)), F.lit(1.0)))


def quantised(stretched: Column) -> Column:
    """On 0 to 65535, half to even; missing is 0."""
    return F.coalesce(F.rint(stretched * F.lit(65535.0)).cast("int"), F.lit(0))


def stored_int16(u16: Column) -> Column:
    """A 16-bit unsigned value as it is stored: less 32768."""
    return (u16 - 32768).cast("smallint")


def tan_plane(lon: Column, lat: Column, lon0: Column, lat0: Column) -> tuple[Column, Column]:
    """Tangent-plane (xi, eta) in radians of directions in radians; null behind the tangent point."""
    c = F.sin(lat0) * F.sin(lat) + F.cos(lat0) * F.cos(lat) * F.cos(lon - lon0)
    xi = F.cos(lat) * F.sin(lon - lon0) / c
    eta = (F.cos(lat0) * F.sin(lat) - F.sin(lat0) * F.cos(lat) * F.cos(lon - lon0)) / c
    return F.when(c > 0, xi), F.when(c > 0, eta)


def tan_sky(xi: Column, eta: Column, lon0: Column, lat0: Column) -> tuple[Column, Column]:
    """Directions (radians) of tangent-plane positions: the inverse of ``tan_plane``."""
    down = F.cos(lat0) - eta * F.sin(lat0)
    return lon0 + F.atan2(xi, down), F.atan2(F.sin(lat0) + eta * F.cos(lat0), F.sqrt(xi * xi + down * down))
