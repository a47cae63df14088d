"""Queries of grids, footprints, plans, detection and gauge reports, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skyloom.functions import robust
from skyloom.operators import detection, images, planning
from skyloom.plans import imaging, mosaic, stacking
from skyloom.plans.mosaic import SOURCES_SQL
from skyloom.plans.stacking import STARS_SQL, stars
from skyloom.session import table, written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# -- grids and footprints ------------------------------------------------------------------------------------

MARGIN, LAST = 32, 2047.0

_PLACED = """f AS (SELECT DISTINCT frame_id, exposure, visit, lower(trim(detector)) AS detector, regexp_extract(lower(filename), '^(jw[0-9]{8})', 1) AS field, radians(ra_deg) AS lon, radians(dec_deg) AS lat, radians(pixscale_arcsec / 3600) AS s FROM frames
  WHERE isfinite(ra_deg) AND isfinite(dec_deg) AND abs(dec_deg) <= 90 AND isfinite(pixscale_arcsec) AND pixscale_arcsec > 0)"""


def _sky_sql(source: str, out: str) -> str:
    """CTEs that bring pixels (px, py) of frame (lon, lat, s) to those (gx, gy) of frame (lon0, lat0, s0)."""
    return f"""{out}_w AS (SELECT *, (px - 1023.5::double) * s AS xi, (py - 1023.5::double) * s AS eta, cos(lat) - (py - 1023.5::double) * s * sin(lat) AS down FROM {source}),
{out}_k AS (SELECT *, lon + atan2(xi, down) AS l, atan2(sin(lat) + eta * cos(lat), sqrt(xi * xi + down * down)) AS b FROM {out}_w),
{out}_c AS (SELECT *, sin(lat0) * sin(b) + cos(lat0) * cos(b) * cos(l - lon0) AS c FROM {out}_k),
{out} AS (SELECT *, CASE WHEN c > 0 THEN cos(b) * sin(l - lon0) / c / s0 + 1023.5::double END AS gx, CASE WHEN c > 0 THEN (cos(lat0) * sin(b) - sin(lat0) * cos(b) * cos(l - lon0)) / c / s0 + 1023.5::double END AS gy FROM {out}_c)"""


def _placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames with a place on the sky."""
    ok = (F.abs("dec_deg") <= 90.0) & (F.abs("ra_deg") < float("inf")) & (F.col("pixscale_arcsec") > 0) & (F.col("pixscale_arcsec") < float("inf"))
    return table(spark, sf_dir, "frames").filter(ok).select(
        "frame_id", "exposure", "visit", F.lower(F.trim("detector")).alias("detector"), F.regexp_extract(F.lower("filename"), "^(jw[0-9]{8})", 1).alias("field"),
        F.radians("ra_deg").alias("lon"), F.radians("dec_deg").alias("lat"), F.radians(F.col("pixscale_arcsec") / 3600).alias("s"),
    ).distinct()


def _on(px: Column, py: Column) -> tuple[Column, Column]:
    """Pixels of the frame (lon, lat, s) as pixels of the frame (lon0, lat0, s0); null behind its tangent point."""
    half, s = LAST / 2, F.col("s")
    lon, lat = images.tan_sky((px - half) * s, (py - half) * s, F.col("lon"), F.col("lat"))
    u, v = images.tan_plane(lon, lat, F.col("lon0"), F.col("lat0"))
    return u / F.col("s0") + half, v / F.col("s0") + half


@query(f"""WITH {_PLACED}, g AS (SELECT field, visit, frame_id AS reference, lon AS lon0, lat AS lat0, s AS s0 FROM f QUALIFY row_number() OVER (PARTITION BY field, visit ORDER BY exposure, frame_id) = 1),
t AS (SELECT f.*, reference, lon0, lat0, s0, px, py FROM f JOIN g USING (field, visit) CROSS JOIN (SELECT unnest([0.0::double, 2047.0]) AS px) CROSS JOIN (SELECT unnest([0.0::double, 2047.0]) AS py)),
{_sky_sql('t', 'p')}, e AS (SELECT field, visit, reference, count(DISTINCT frame_id) AS frames, min(gx) AS x0, max(gx) AS x1, min(gy) AS y0, max(gy) AS y1 FROM p WHERE gx IS NOT NULL GROUP BY ALL)
SELECT field, visit, reference, frames, CAST(ceil(round(x1 - x0, 6)) AS BIGINT) + 64 AS nx, CAST(ceil(round(y1 - y0, 6)) AS BIGINT) + 64 AS ny, round(1024.5::double - x0 + 32, 6) AS crpix_x, round(1024.5::double - y0 + 32, 6) AS crpix_y FROM e""")
def visit_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The grid that holds all frames of a visit: its first exposure's, with the reference pixel moved so that all corners and 32 pixels more fit.

    Extents are taken to a millionth of a pixel before they are rounded up. Corners behind the first exposure's tangent point are left out.
    """
    f = _placed(spark, sf_dir)
    g = f.groupBy("field", "visit").agg(F.min_by(F.struct(F.col("frame_id").alias("reference"), F.col("lon").alias("lon0"), F.col("lat").alias("lat0"), F.col("s").alias("s0")), F.struct("exposure", "frame_id")).alias("g")).select("field", "visit", "g.*")
    ends = F.explode(F.array(F.lit(0.0), F.lit(LAST)))
    c = f.join(g, ["field", "visit"]).withColumn("px", ends).withColumn("py", ends)
    gx, gy = _on(F.col("px"), F.col("py"))
    c = c.select("field", "visit", "reference", "frame_id", gx.alias("gx"), gy.alias("gy")).filter("gx IS NOT NULL")
    e = c.groupBy("field", "visit", "reference").agg(F.count_distinct("frame_id").alias("frames"), F.min("gx").alias("x0"), F.max("gx").alias("x1"), F.min("gy").alias("y0"), F.max("gy").alias("y1"))
    side = lambda a: (F.ceil(F.round(F.col(f"{a}1") - F.col(f"{a}0"), 6)).cast("bigint") + 2 * MARGIN).alias(f"n{a}")
    crpix = lambda a: F.round(LAST / 2 + 1 - F.col(f"{a}0") + MARGIN, 6).alias(f"crpix_{a}")
    return e.select("field", "visit", "reference", "frames", side("x"), side("y"), crpix("x"), crpix("y"))


# The cards of a grid file, and what they hold.
_CARDS = {
    "CRVAL1": "(ra0 + ra1) / 2", "CRVAL2": "(dec0 + dec1) / 2", "CRPIX1": "(nx + 1) / 2.0D", "CRPIX2": "(ny + 1) / 2.0D", "CDELT1": "-0.031D / 3600", "CDELT2": "0.031D / 3600", "GRDNX": "nx", "GRDNY": "ny",
    "GRDSCL": "0.031D", "GRDFRA1": "ra0", "GRDFRA2": "ra1", "GRDFDE1": "dec0", "GRDFDE2": "dec1", "GRDFRUS": "used", "GRDFRTT": "total",
}


@query(f"WITH u AS ({imaging.SQL['region_union']}) " + " UNION ALL ".join(f"SELECT file_name, '{k}' AS card, CAST({v.replace('D', '::double')} AS DOUBLE) AS value FROM u" for k, v in _CARDS.items()))
def grid_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The north-up grid over a listing's footprints as the cards of its header."""
    u = imaging.region_union(spark, sf_dir)
    cards = F.array(*[F.struct(F.lit(k).alias("card"), F.expr(f"CAST({v} AS DOUBLE)").alias("value")) for k, v in _CARDS.items()])
    return u.select("file_name", F.inline(cards))


@query(f"""WITH {_PLACED}, g AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY field, visit, detector ORDER BY exposure, frame_id) = 1),
k AS (SELECT unnest(range(48)) * 2047 / 47.0::double AS k), r AS (SELECT a.field, a.frame_id AS frame_a, b.frame_id AS frame_b, a.lon, a.lat, a.s, b.lon AS lon0, b.lat AS lat0, b.s AS s0 FROM g a JOIN g b ON a.field = b.field AND a.frame_id < b.frame_id
  WHERE sin(a.lat) * sin(b.lat) + cos(a.lat) * cos(b.lat) * cos(a.lon - b.lon) > cos(1024 * sqrt(2.0::double) * (a.s + b.s))),
t AS (SELECT r.*, kx.k AS px, ky.k AS py FROM r CROSS JOIN k kx CROSS JOIN k ky), {_sky_sql('t', 'p')}
SELECT field, frame_a, frame_b, round(count(*) FILTER (gx BETWEEN -1e-6::double AND 2047.000001::double AND gy BETWEEN -1e-6::double AND 2047.000001::double) / 2304.0::double, 9) AS fraction FROM p GROUP BY ALL""")
def footprint_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of first exposures (one a visit and detector) of a field whose discs meet: the share of 48 x 48 points of one inside the other's footprint."""
    f = _placed(spark, sf_dir)
    g = f.groupBy("field", "visit", "detector").agg(F.min_by(F.struct("frame_id", "lon", "lat", "s"), F.struct("exposure", "frame_id")).alias("g")).select("field", "g.*")
    b = g.select("field", F.col("frame_id").alias("frame_b"), F.col("lon").alias("lon0"), F.col("lat").alias("lat0"), F.col("s").alias("s0"))
    near = F.sin("lat") * F.sin("lat0") + F.cos("lat") * F.cos("lat0") * F.cos(F.col("lon") - F.col("lon0")) > F.cos(1024 * F.sqrt(F.lit(2.0)) * (F.col("s") + F.col("s0")))
    pairs = g.withColumnRenamed("frame_id", "frame_a").join(b, "field").filter(F.col("frame_a") < F.col("frame_b")).filter(near)
    k = F.explode(F.transform(F.sequence(F.lit(0), F.lit(47)), lambda i: i * LAST / 47.0))
    gx, gy = _on(F.col("px"), F.col("py"))
    at = pairs.withColumn("px", k).withColumn("py", k).select("field", "frame_a", "frame_b", gx.alias("gx"), gy.alias("gy"))
    inside = lambda c: F.col(c).between(-1e-6, LAST + 1e-6)
    return at.groupBy("field", "frame_a", "frame_b").agg(F.round(F.count_if(inside("gx") & inside("gy")) / 2304.0, 9).alias("fraction"))


# -- plans ---------------------------------------------------------------------------------------------------


@query(f"""WITH {imaging._LATEST.rstrip()}, n AS (SELECT i.*, regexp_matches(i.filename, '^jw[0-9]{{11}}_[0-9]{{5}}_[0-9]{{5}}_nrc[ab]([1-4]|long)_(cal|i2d)\\.fits?$') AS single FROM i WHERE upper(trim(filter_name)) IN ('F200W', 'F444W')),
c AS (SELECT filename, expected_size, CASE WHEN single AND filename LIKE '%\\_cal.fit%' ESCAPE '\\' THEN 'cal' WHEN filename LIKE '%\\_i2d.fits' ESCAPE '\\' AND NOT single THEN 'combined_i2d'
  WHEN single AND ((lower(trim(detector)) = 'nrca1' AND visit IN (1, 2, 3, 4)) OR visit = 1) THEN 'subset_i2d' END AS category FROM n)
SELECT c.filename, category, CASE WHEN c.expected_size > 0 AND v.actual_size = c.expected_size THEN 'existing' ELSE 'new' END AS state FROM c LEFT JOIN v USING (filename) WHERE category IN ('cal', 'combined_i2d', 'subset_i2d')""")
def stage_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second stage's files of two filters with category and state: all single calibrated files, combined mosaics, and the single mosaics used to check them."""
    p = planning.staged(imaging._plan(spark, sf_dir).filter(planning.folded(F.col("filter_name")).isin("F200W", "F444W")))
    p = p.filter(F.col("category").isin(planning.stage_kinds("subset_i2d, cal ,combined_i2d")))
    j = p.join(imaging._disk(spark, sf_dir), "filename", "left")
    fits = (F.col("expected_size") > 0) & (F.col("actual_size") == F.col("expected_size"))
    return j.select("filename", "category", F.when(fits, "existing").otherwise("new").alias("state"))


# -- colour --------------------------------------------------------------------------------------------------


@query("WITH m AS (" + imaging.SQL["rgb_mask"] + ") " + " UNION ALL ".join(f"SELECT CAST({i} AS INTEGER) AS band, cx, cy, {c} AS dn FROM m WHERE whole" for i, c in enumerate(("red", "green", "blue"))))
def band_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The colour cube band by band, as viewers take it: pixels that all three bands have."""
    m = imaging.rgb_mask(spark, sf_dir).filter("whole")
    bands = F.array(*[F.struct(F.lit(i).alias("band"), F.col(c).alias("dn")) for i, c in enumerate(("red", "green", "blue"))])
    return m.select("cx", "cy", F.inline(bands)).select("band", "cx", "cy", "dn")


@query("WITH p AS (" + imaging.SQL["color_plan"] + f"""), {STARS_SQL}, im AS (SELECT mosaic_key AS grp, filter_name, CAST(floor(y / 16.0::double) AS BIGINT) AS y, CAST(floor(x / 16.0::double) AS BIGINT) AS x, max(flux) AS v FROM stars WHERE isfinite(flux) GROUP BY ALL),
s AS (SELECT grp, filter_name, y, x, v - background AS v, low, high, softening FROM im JOIN p USING (filter_name))
SELECT grp, filter_name, y, x, round(v, 9) AS v, round(CASE WHEN high > low THEN least(greatest((asinh(v / softening) - asinh(low / softening)) / (asinh(high / softening) - asinh(low / softening)), 0.0), 1.0) END, 9) AS stretched FROM s""")
def tile_stretch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each mosaic's image less its filter's background, on the stretch that all share. Without a range there is no stretched value."""
    plan = written(imaging.color_plan(spark, sf_dir).select("filter_name", "background", "low", "high", "softening"), "plan")  # one row a filter
    s = stars(spark, sf_dir, "filter_name", "flux").withColumn("flux", robust.finite(F.col("flux"))).filter("flux IS NOT NULL")
    im = s.groupBy(F.col("mosaic_key").alias("grp"), "filter_name", *[F.floor(F.col(c) / imaging.CELL).cast("bigint").alias(c) for c in ("y", "x")]).agg(F.max("flux").alias("v"))
    up = im.join(plan, "filter_name").withColumn("v", F.col("v") - F.col("background"))
    a = lambda c: F.asinh(F.try_divide(c, "softening"))
    at = F.least(F.greatest(F.try_divide(a("v") - a("low"), a("high") - a("low")), F.lit(0.0)), F.lit(1.0))
    return up.select("grp", "filter_name", "y", "x", F.round("v", 9).alias("v"), F.round(F.when(F.col("high") > F.col("low"), at), 9).alias("stretched"))


# -- resampling and detection --------------------------------------------------------------------------------

RATIO, OFF_Y, OFF_X = 2.0129, 0.3, 0.7


@query(mosaic._CELLS_SQL + f"""u AS (SELECT *, (y + {OFF_Y}::double) / {RATIO}::double AS y0, (y + 1 + {OFF_Y}::double) / {RATIO}::double AS y1, (x + {OFF_X}::double) / {RATIO}::double AS x0, (x + 1 + {OFF_X}::double) / {RATIO}::double AS x1 FROM im),
t AS (SELECT *, unnest(range(CAST(floor(x0) AS BIGINT), CAST(ceil(x1) AS BIGINT))) AS tx FROM (SELECT *, unnest(range(CAST(floor(y0) AS BIGINT), CAST(ceil(y1) AS BIGINT))) AS ty FROM u)),
w AS (SELECT *, (least(y1, ty + 1) - greatest(y0, ty)) * (least(x1, tx + 1) - greatest(x0, tx)) AS w FROM t)
SELECT grp, ty AS y, tx AS x, round(sum(v * w) / sum(w), 6) AS v, round(sum(w), 6) AS covered FROM w WHERE w > 1e-12 GROUP BY ALL""")
def area_reproject(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each mosaic's image on pixels twice as wide, by area."""
    return detection.area_resampled(mosaic.cells(spark, sf_dir), RATIO, OFF_Y, OFF_X).withColumns({c: F.round(c, 6) for c in ("v", "covered")})


_TAPS, _NOISE = detection.kernel(3.0)
_DAO = f"""k AS (SELECT * FROM (VALUES {", ".join(f"({j}, {i}, {w!r}::double)" for j, i, w in _TAPS)}) k(j, i, w)),
lm AS (SELECT grp, 1.4826::double * median(off) * 5 * {_NOISE!r}::double AS lim FROM (SELECT grp, abs(v - median(v) OVER (PARTITION BY grp)) AS off FROM im) GROUP BY grp),
cv AS (SELECT grp, im.y - j AS y, im.x - i AS x, round(sum(v * w), 6) AS height, sum(v) AS s, max(v) FILTER (j = 0 AND i = 0) AS v FROM im CROSS JOIN k GROUP BY ALL),
hi AS (SELECT cv.* FROM cv JOIN lm USING (grp) WHERE height > lim),
mx AS (SELECT grp, y + j AS y, x + i AS x, max(height) AS best FROM hi CROSS JOIN k GROUP BY ALL),
pk AS (SELECT hi.*, (v - (s - v) / {len(_TAPS) - 1}) / height AS sharpness FROM hi JOIN mx USING (grp, y, x) WHERE v IS NOT NULL AND height >= best),
q AS (SELECT j, i, CASE WHEN (j <= 0 AND i > 0) OR (j >= 0 AND i < 0) THEN -1.0::double ELSE 1 END AS sign FROM (SELECT unnest(range(-2, 3)) AS j) CROSS JOIN (SELECT unnest(range(-2, 3)) AS i) WHERE j <> 0 OR i <> 0),
sh AS (SELECT a.grp, a.y, a.x, sum(sign * cv.height) AS two, sum(abs(cv.height)) AS four FROM (SELECT grp, pk.y, pk.x, y + j AS ny, x + i AS nx, sign FROM pk CROSS JOIN q WHERE sharpness BETWEEN 0.2 AND 1.0) a JOIN cv ON cv.grp = a.grp AND cv.y = ny AND cv.x = nx GROUP BY ALL),
r AS (SELECT pk.*, 2 * two / four AS roundness FROM pk JOIN sh USING (grp, y, x) WHERE four > 0 AND 2 * two / four BETWEEN -1.0 AND 1.0)
SELECT grp, CAST(floor(y / 32) AS BIGINT) AS ty, CAST(floor(x / 32) AS BIGINT) AS tx, y, x, v, height, round(sharpness, 6) AS sharpness, round(roundness, 6) AS roundness, CAST(rank AS INTEGER) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY height DESC, y, x) AS rank FROM r) WHERE rank <= 400"""


@query(mosaic._CELLS_SQL + _DAO)
def matched_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 400 strongest stars of each mosaic's image by a matched filter, with the tile that owns them."""
    d = detection.matched(written(mosaic.cells(spark, sf_dir), "image"))
    tile = lambda c: F.floor(F.col(c) / 32).cast("bigint").alias(f"t{c}")
    return d.select("grp", tile("y"), tile("x"), "y", "x", "v", "height", F.round("sharpness", 6).alias("sharpness"), F.round("roundness", 6).alias("roundness"), "rank")


@query(f"""WITH {STARS_SQL}, im AS (SELECT mosaic_key AS grp, CAST(floor(y / 16.0::double) AS BIGINT) AS y, CAST(floor(x / 16.0::double) AS BIGINT) AS x, max(flux) AS v FROM stars WHERE isfinite(flux) GROUP BY ALL HAVING count(*) FILTER (isfinite(rms_residual) AND rms_residual > 0) > 0),
""" + "d AS (WITH " + SOURCES_SQL + ") SELECT grp, y, x, v, n, cy, cx, width, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY v DESC, y, x) AS rank FROM d) WHERE rank <= 8000")
def weighted_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 8,000 brightest sources of each mosaic's image, whose weight is the number of fits with a residual; cells of no weight are masked."""
    s = stars(spark, sf_dir, "flux", "rms_residual").withColumn("flux", robust.finite(F.col("flux"))).filter("flux IS NOT NULL")
    im = s.groupBy(F.col("mosaic_key").alias("grp"), *[F.floor(F.col(c) / imaging.CELL).cast("bigint").alias(c) for c in ("y", "x")]).agg(F.max("flux").alias("v"), F.count_if(robust.finite(F.col("rms_residual")) > 0).alias("weight"))
    d = mosaic.rounded_sources(written(im.filter("weight > 0").drop("weight"), "image"))
    return d.withColumn("rank", F.row_number().over(Window.partitionBy("grp").orderBy(F.desc("v"), "y", "x"))).filter("rank <= 8000")


@query(f"""WITH {STARS_SQL}, px AS (SELECT mosaic_key, CAST(floor(y / 16.0::double) AS BIGINT) AS y, CAST(floor(x / 16.0::double) AS BIGINT) AS x, max(flux) FILTER (star_id % 2 = 1) AS a, max(flux) FILTER (star_id % 2 = 0) AS b FROM stars WHERE isfinite(flux) GROUP BY ALL),
im AS (SELECT mosaic_key || ':a' AS grp, y, x, a AS v FROM px WHERE a IS NOT NULL AND b IS NOT NULL UNION ALL SELECT mosaic_key || ':b', y, x, b FROM px WHERE a IS NOT NULL AND b IS NOT NULL),
""" + SOURCES_SQL)
def joint_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources of two images of a mosaic (odd and even stars, ``grp`` ends in a or b), each seen only where the other has pixels, too."""
    s = stars(spark, sf_dir, "flux").withColumn("flux", robust.finite(F.col("flux"))).filter("flux IS NOT NULL")
    of = lambda odd: F.max(F.when(F.col("star_id") % 2 == odd, F.col("flux")))
    px = s.groupBy("mosaic_key", *[F.floor(F.col(c) / imaging.CELL).cast("bigint").alias(c) for c in ("y", "x")]).agg(of(1).alias("a"), of(0).alias("b")).filter("a IS NOT NULL AND b IS NOT NULL")
    both = px.select("mosaic_key", "y", "x", F.explode(F.create_map(F.lit(":a"), F.col("a"), F.lit(":b"), F.col("b"))).alias("side", "v"))
    return mosaic.rounded_sources(written(both.select(F.concat("mosaic_key", "side").alias("grp"), "y", "x", "v"), "image"))


def _widths_sql(peaks: str, name: str) -> str:
    return f"""{name}_e AS (SELECT *, unnest(range(-half, half + 1)) AS i FROM (SELECT grp, y AS py, x AS px, half, unnest(range(-half, half + 1)) AS j FROM {peaks})),
{name}_m AS (SELECT e.grp, py, px, sum(v - lo) AS w, sum((v - lo) * j) AS wj, sum((v - lo) * i) AS wi, sum((v - lo) * (j * j + i * i)) AS wr FROM (SELECT e.*, v, min(v) OVER (PARTITION BY e.grp, py, px) AS lo FROM {name}_e e JOIN im ON im.grp = e.grp AND im.y = py + j AND im.x = px + i) e GROUP BY ALL),
{name} AS (SELECT grp, py AS y, px AS x, round(sqrt(greatest(wr / w - wj / w * wj / w - wi / w * wi / w, 0)), 6) AS width FROM {name}_m WHERE w > 1e-9)"""


@query(mosaic._CELLS_SQL + f"d AS (WITH {SOURCES_SQL}), d1 AS (SELECT grp, y, x, CAST(1 AS BIGINT) AS half FROM d), {_widths_sql('d1', 'w1')}, m1 AS (SELECT grp, count(*) AS n, median(width) AS width FROM w1 GROUP BY grp),\n"
       f"d2 AS (SELECT d.grp, y, x, CAST(greatest(1, ceil(2 * m1.width)) AS BIGINT) AS half FROM d JOIN m1 USING (grp)), {_widths_sql('d2', 'w2')}, m2 AS (SELECT grp, count(*) AS n, median(width) AS width FROM w2 GROUP BY grp)\n"
       "SELECT grp, m2.n, round(m1.width, 6) AS first_width, round(m2.width, 6) AS width, m2.n >= 8 AS is_measured FROM m1 JOIN m2 USING (grp)")  # fmt: skip
def width_refine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mosaic's median source width, measured twice: the first answer sets the squares of the second. Measured: eight sources or more."""
    im = written(mosaic.cells(spark, sf_dir), "image")
    d = written(images.sources(im).select("grp", "y", "x"), "peaks")

    def median_width(peaks: DataFrame) -> DataFrame:
        w = written(detection.widths(peaks, im).withColumn("width", F.round("width", 6)), "widths")
        return w.groupBy("grp").agg(F.count("*").alias("n")).join(robust.group_percentiles(w, ["grp"], {"width": ("width", 0.5)}), "grp")

    first = written(median_width(d.withColumn("half", F.lit(1).cast("bigint"))), "hint")
    second = median_width(d.join(first, "grp").select("grp", "y", "x", F.greatest(F.lit(1), F.ceil(2 * F.col("width"))).cast("bigint").alias("half")))
    # a median of two six-digit widths often ends in a half, which the SQL rounds as the product with 10^6 falls
    six = lambda c: F.round(F.col(c) * 1e6) / 1e6
    return second.join(first.select("grp", six("width").alias("first_width")), "grp").select("grp", "n", "first_width", six("width").alias("width"), (F.col("n") >= 8).alias("is_measured"))


# -- gauge and build reports ---------------------------------------------------------------------------------


@query(f"WITH {stacking._R} SELECT field, visit, group_key, count(*) AS n, group_key || ': ' || count(*) || ' matched' AS reason FROM m GROUP BY field, visit, group_key HAVING count(*) < 20")
def gauge_skipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups with too few readings for a gauge."""
    m = stacking.measured(spark, sf_dir, "group_key", "visit", "dx", "dy").groupBy("field", "visit", "group_key").agg(F.count("*").alias("n"))
    return m.filter("n < 20").withColumn("reason", F.concat("group_key", F.lit(": "), F.col("n").cast("string"), F.lit(" matched")))


@query(stacking._GAUGE + """, d AS (SELECT gg.field, gg.visit, offset_median, (dx_median - vv.dx) * (dx_median - vv.dx) + (dy_median - vv.dy) * (dy_median - vv.dy) AS d2 FROM gg JOIN vv ON gg.field = vv.field AND gg.visit IS NOT DISTINCT FROM vv.visit),
s AS (SELECT field, visit, count(*) AS groups, max(offset_median) - min(offset_median) AS spread, sqrt(avg(d2)) AS internal_rms FROM d GROUP BY ALL),
p AS (SELECT vv.field, vv.visit, sqrt((vv.dx - an.dx) * (vv.dx - an.dx) + (vv.dy - an.dy) * (vv.dy - an.dy)) AS away FROM vv JOIN an USING (field))
SELECT s.field, s.visit, groups, round(spread, 9) AS spread, round(internal_rms, 9) AS internal_rms, round(away, 9) AS away, row_number() OVER (PARTITION BY s.field ORDER BY round(away, 9) DESC, s.visit) = 1 AS is_worst FROM s JOIN p ON s.field = p.field AND s.visit IS NOT DISTINCT FROM p.visit""")
def gauge_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far a visit's groups disagree, and how far it is from its field's anchor; the worst visit is the furthest."""
    g, v, a = stacking._gauge_groups(spark, sf_dir), stacking._gauge_visits(spark, sf_dir), stacking.gauge_anchor(spark, sf_dir)
    on = lambda x, y: (x["field"] == y["field"]) & x["visit"].eqNullSafe(y["visit"])
    x, y = g["dx_median"] - v["dx"], g["dy_median"] - v["dy"]
    d = g.join(v, on(g, v)).select(g["field"], g["visit"], "offset_median", (x * x + y * y).alias("d2"))
    s = d.groupBy("field", "visit").agg(F.count("*").alias("groups"), F.round(F.max("offset_median") - F.min("offset_median"), 9).alias("spread"), F.round(F.sqrt(F.avg("d2")), 9).alias("internal_rms"))
    a = a.select("field", "visit", F.round("separation", 9).alias("away"))
    j = s.join(a, on(s, a)).select(s["field"], s["visit"], "groups", "spread", "internal_rms", "away")
    worst = j.groupBy("field").agg(F.min_by(F.struct("visit"), F.struct(-F.col("away"), "visit")).alias("w"))
    return j.join(worst, "field").withColumn("is_worst", F.col("visit").eqNullSafe(F.col("w.visit"))).drop("w")


@query(f"""WITH {STARS_SQL}, c AS (SELECT DISTINCT mosaic_key AS grp, CAST(floor(x / 128) AS BIGINT) AS cx, CAST(floor(y / 128) AS BIGINT) AS cy FROM stars),
t AS (SELECT grp, CAST(floor(cx / 4) AS BIGINT) AS tx, CAST(floor(cy / 4) AS BIGINT) AS ty, count(*) / 16.0::double AS fraction FROM c GROUP BY ALL HAVING count(*) / 16.0::double >= 0.9),
n AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY ty, tx) - 1 AS i, count(*) OVER (PARTITION BY grp) AS n FROM t)
SELECT grp, tx, ty, fraction FROM n WHERE list_contains([CAST(round_even(k * (n - 1) / 23.0::double, 0) AS BIGINT) FOR k IN range(0, 24)], i)""")
def covered_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """About 24 evenly spaced tiles of each mosaic among those that are covered to nine tenths."""
    t = planning.covered_tiles(stars(spark, sf_dir).withColumnRenamed("mosaic_key", "grp"), 512, 128).filter("fraction >= 0.9")
    return planning.evenly_spaced(t, ["grp"], ["ty", "tx"], 24).select("grp", "tx", "ty", "fraction")


@query("WITH t AS (" + mosaic.SQL["grid_tiles"] + ") SELECT field, count(*) AS tiles, count(*) FILTER (frames > 0) AS used_tiles, max(frames) AS most_frames, round(avg(frames) FILTER (frames > 0), 9) AS mean_frames, CAST(sum(pixels) AS BIGINT) AS loaded_pixels FROM t GROUP BY field")
def tile_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a build of each field loads: tiles, frames a tile at most and on average, pixels."""
    t = mosaic.grid_tiles(spark, sf_dir)
    used = F.when(F.col("frames") > 0, F.col("frames"))
    return t.groupBy("field").agg(F.count("*").alias("tiles"), F.count(used).alias("used_tiles"), F.max("frames").alias("most_frames"), F.round(F.avg(used), 9).alias("mean_frames"), F.sum("pixels").alias("loaded_pixels"))


@query("WITH b AS (" + mosaic.SQL["mosaic_build"] + ") SELECT grp, count(*) AS pixels, count(*) FILTER (coverage > 0) AS covered, max(coverage) AS max_depth, CAST(sum(coverage - kept) AS BIGINT) AS clipped FROM b GROUP BY grp")
def depth_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each built mosaic: pixels, those with a value, the most exposures at one, values clipped."""
    b = mosaic.mosaic_build(spark, sf_dir)
    return b.groupBy("grp").agg(F.count("*").alias("pixels"), F.count_if(F.col("coverage") > 0).alias("covered"), F.max("coverage").alias("max_depth"), F.sum(F.col("coverage") - F.col("kept")).alias("clipped"))
