"""Star detection on pixel tables ``(grp, y, x, v)``: a matched filter, its shape tests, and widths from moments."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyloom.functions import robust
from skyloom.session import written

FWHM_PER_SIGMA = 2.0 * math.sqrt(2.0 * math.log(2.0))


def kernel(fwhm: float) -> tuple[list[tuple[int, int, float]], float]:
    """Taps (dy, dx, weight) of a Gaussian of zero sum within 1.5 sigma or 2 pixels, and how it scales noise."""
    sigma = fwhm / FWHM_PER_SIGMA
    reach = max(2.0, 1.5 * sigma)
    n = int(reach)
    g = {(j, i): math.exp(-(j * j + i * i) / (2 * sigma * sigma)) for j in range(-n, n + 1) for i in range(-n, n + 1) if j * j + i * i <= reach * reach}
    mean = sum(g.values()) / len(g)
    power = sum(w * w for w in g.values()) - mean * mean * len(g)
    return [(j, i, (w - mean) / power) for (j, i), w in g.items()], 1 / math.sqrt(power)


def _taps(of: list[tuple]) -> Column:
    return F.explode(F.array(*[F.struct(F.lit(j).alias("j"), F.lit(i).alias("i"), *[F.lit(float(w)).alias("w") for w in rest]) for j, i, *rest in of]))


def matched(image: DataFrame, fwhm: float = 3.0, sigma: float = 5.0, most: int = 400) -> DataFrame:
    """Each group's ``most`` strongest stars: peaks of the image filtered by a Gaussian, ``sigma`` scaled MADs high.

    ``(grp, y, x, v, height, sharpness, roundness, rank)``. ``height`` is that of the best fitting Gaussian; no pixel within
    the kernel is higher (equal ones all come out). ``sharpness``, 0.2 to 1, is the pixel's rise over the mean of the others
    in the kernel, by the height; ``roundness``, -1 to 1, compares the filtered image's quadrants. A missing pixel counts
    as 0 and is no star; a group whose pixels are all alike has the smallest float as noise.
    """
    taps, scale = kernel(fwhm)
    side = max(j for j, _, _ in taps)
    mid = robust.group_percentiles(image, ["grp"], {"level": ("v", 0.5)})
    off = image.join(mid, "grp").withColumn("off", F.abs(F.col("v") - F.col("level")))
    mad = robust.group_percentiles(off, ["grp"], {"mad": ("off", 0.5)})
    limit = mad.select("grp", (F.greatest(1.4826 * F.col("mad"), F.lit(1.1754943508222875e-38)) * sigma * scale).alias("limit"))
    e = image.filter("v IS NOT NULL").withColumn("t", _taps(taps))
    e = e.select("grp", (F.col("y") - F.col("t.j")).alias("y"), (F.col("x") - F.col("t.i")).alias("x"), "v", (F.col("v") * F.col("t.w")).alias("wv"), ((F.col("t.j") == 0) & (F.col("t.i") == 0)).alias("own"))
    conv = written(e.groupBy("grp", "y", "x").agg(F.round(F.sum("wv"), 6).alias("height"), F.sum("v").alias("all"), F.max(F.when(F.col("own"), F.col("v"))).alias("v")), "filtered")
    # only what is above the limit can outshine a star
    high = written(conv.join(limit, "grp").filter(F.col("height") > F.col("limit")).select("grp", "y", "x", "v", "all", "height"), "high")
    best = high.withColumn("t", _taps([(j, i) for j, i, _ in taps])).groupBy("grp", (F.col("y") + F.col("t.j")).alias("y"), (F.col("x") + F.col("t.i")).alias("x")).agg(F.max("height").alias("best"))
    sharp = F.try_divide(F.col("v") - (F.col("all") - F.col("v")) / (len(taps) - 1), F.col("height"))
    peaks = high.filter("v IS NOT NULL").join(best, ["grp", "y", "x"]).filter("height >= best").withColumn("sharpness", sharp).filter("sharpness BETWEEN 0.2 AND 1.0")
    square = [(j, i, _quadrant(j, i)) for j in range(-side, side + 1) for i in range(-side, side + 1) if (j, i) != (0, 0)]
    around = peaks.select("grp", F.col("y").alias("py"), F.col("x").alias("px")).withColumn("t", _taps(square)).select("grp", "py", "px", (F.col("py") + F.col("t.j")).alias("y"), (F.col("px") + F.col("t.i")).alias("x"), F.col("t.w").alias("sign"))
    shape = around.join(conv.select("grp", "y", "x", "height"), ["grp", "y", "x"]).groupBy("grp", F.col("py").alias("y"), F.col("px").alias("x")).agg(F.sum(F.col("sign") * F.col("height")).alias("two"), F.sum(F.abs("height")).alias("four"))
    found = peaks.join(shape, ["grp", "y", "x"]).withColumn("roundness", F.try_divide(2 * F.col("two"), F.col("four"))).filter("roundness BETWEEN -1.0 AND 1.0")
    w = Window.partitionBy("grp").orderBy(F.desc("height"), "y", "x")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most).select("grp", "y", "x", "v", "height", "sharpness", "roundness", "rank")


def _quadrant(j: int, i: int) -> int:
    """-1 in the quadrants right of and below or left of and above a peak, 1 in the others; each takes one half-axis."""
    if j <= 0 and i > 0 or j >= 0 and i < 0:
        return -1
    return 1


def widths(peaks: DataFrame, image: DataFrame) -> DataFrame:
    """``(grp, y, x, width)`` of peaks ``(grp, y, x, half)``: the root mean square distance from the centroid in their square of half-width ``half``.

    Pixels weigh by their height over the square's lowest pixel; a square without height has no width and no row.
    """
    o = lambda: F.explode(F.sequence(-F.col("half"), F.col("half")))
    p = peaks.select("grp", F.col("y").alias("py"), F.col("x").alias("px"), "half").withColumn("j", o()).withColumn("i", o())
    c = p.select("grp", "py", "px", (F.col("py") + F.col("j")).alias("y"), (F.col("px") + F.col("i")).alias("x"), "j", "i").join(image, ["grp", "y", "x"])
    s = lambda e: F.sum(e)
    v, j, i = F.col("v"), F.col("j"), F.col("i")
    r = j * j + i * i
    m = c.groupBy("grp", F.col("py").alias("y"), F.col("px").alias("x")).agg(
        F.min("v").alias("lo"), F.count("*").alias("n"), s(v).alias("sv"), s(j).alias("sj"), s(i).alias("si"), s(r).alias("sr"), s(v * j).alias("vj"), s(v * i).alias("vi"), s(v * r).alias("vr"),
    )
    w = F.col("sv") - F.col("lo") * F.col("n")
    my, mx, mr = (F.try_divide(F.col(a) - F.col("lo") * F.col(b), w) for a, b in (("vj", "sj"), ("vi", "si"), ("vr", "sr")))
    return m.filter(w > 0).select("grp", "y", "x", F.sqrt(F.greatest(mr - my * my - mx * mx, F.lit(0.0))).alias("width"))


def area_resampled(image: DataFrame, ratio: float, dy: float, dx: float) -> DataFrame:
    """The image on pixels ``ratio`` times as wide, moved by (dy, dx) of its own pixels: means weighted by the area of overlap.

    ``(grp, y, x, v, covered)``; ``covered`` is the share of the new pixel under present ones.
    """

    def cut(c: str, d: float) -> tuple[Column, Column]:
        return (F.col(c) + d) / ratio, (F.col(c) + 1 + d) / ratio

    (y0, y1), (x0, x1) = cut("y", dy), cut("x", dx)
    cells = lambda a, b: F.explode(F.sequence(F.floor(a), F.ceil(b) - 1))
    e = image.filter("v IS NOT NULL").withColumn("ty", cells(y0, y1)).withColumn("tx", cells(x0, x1))
    side = lambda a, b, t: F.least(b, F.col(t) + 1) - F.greatest(a, F.col(t).cast("double"))
    e = e.withColumn("w", side(y0, y1, "ty") * side(x0, x1, "tx")).filter("w > 1e-12")
    return e.groupBy("grp", F.col("ty").alias("y"), F.col("tx").alias("x")).agg((F.sum(F.col("v") * F.col("w")) / F.sum("w")).alias("v"), F.sum("w").alias("covered"))
