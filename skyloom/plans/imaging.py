"""Queries of images, geometry, stretches, selection and inventory, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skyloom.functions import robust
from skyloom.operators import graphs, images, planning
from skyloom.plans.stacking import STARS_SQL, stars
from skyloom.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# -- images: the flux of each mosaic's stars on cells of 16 px ----------------------------------------------

CELL = 16.0


def image(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = stars(spark, sf_dir, "flux").withColumn("flux", robust.finite(F.col("flux"))).filter("flux IS NOT NULL AND x >= 0 AND y >= 0")
    px = s.groupBy(F.col("mosaic_key").alias("grp"), F.floor(F.col("y") / CELL).cast("bigint").alias("y"), F.floor(F.col("x") / CELL).cast("bigint").alias("x")).agg(F.max("flux").alias("v"))
    w = px.groupBy("grp").agg((F.max("y") + 1).alias("rows"), (F.max("x") + 1).alias("cols"))
    return px.join(w, "grp")


_IMAGE = f"""WITH {STARS_SQL}, px AS (SELECT mosaic_key AS grp, CAST(floor(y / 16.0::double) AS BIGINT) AS y, CAST(floor(x / 16.0::double) AS BIGINT) AS x, max(flux) AS v
  FROM stars WHERE isfinite(flux) AND x >= 0 AND y >= 0 GROUP BY ALL),
im AS (SELECT *, max(y) OVER (PARTITION BY grp) + 1 AS rows, max(x) OVER (PARTITION BY grp) + 1 AS cols FROM px)
"""


@query(_IMAGE + "SELECT grp, y // 4 AS r, x // 4 AS c, round(avg(v), 9) AS v, count(v) AS n FROM im WHERE y < rows // 4 * 4 AND x < cols // 4 * 4 GROUP BY ALL")
def block_reduce(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images.block_mean(image(spark, sf_dir), 4).withColumn("v", F.round("v", 9))


@query(_IMAGE + """, t AS (SELECT grp, y - j AS y, x - i AS x, v * (1 - abs(j - 0.25)) * (1 - abs(i - 0.375)) AS wv FROM (SELECT *, unnest([0, 1]) AS j FROM (SELECT *, unnest([0, 1]) AS i FROM im)))
SELECT grp, y, x, round(sum(wv), 9) AS v FROM t GROUP BY ALL HAVING count(*) = 4""")
def bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images.bilinear(image(spark, sf_dir).drop("rows", "cols"), 0.25, 0.375).withColumn("v", F.round("v", 9))


@query(_IMAGE + """, h AS (SELECT grp, quantile_cont(v, 0.99) AS lim FROM im GROUP BY grp),
o AS (SELECT grp, y + j AS y, x + i AS x, v FROM (SELECT *, unnest(range(-5, 6)) AS j FROM (SELECT *, unnest(range(-5, 6)) AS i FROM im))),
m AS (SELECT grp, y, x, max(v) AS m FROM o GROUP BY ALL)
SELECT grp, y, x, v, CAST(rank AS INTEGER) AS rank FROM (SELECT im.grp, im.y, im.x, im.v, row_number() OVER (PARTITION BY im.grp ORDER BY im.v DESC, im.y, im.x) AS rank
  FROM im JOIN h USING (grp) JOIN m ON im.grp = m.grp AND im.y = m.y AND im.x = m.x WHERE im.v >= lim AND im.v >= m.m) WHERE rank <= 30""")
def local_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images.local_peaks(image(spark, sf_dir).drop("rows", "cols"))


def _shifts(im: DataFrame) -> DataFrame:
    return robust.group_percentiles(im, ["grp"], {"background": ("v", 0.5)}).select("grp", F.lit(0.37).alias("dx"), F.lit(-0.61).alias("dy"), "background")


@query()
def cubic_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    im = image(spark, sf_dir)
    return images.cubic_shift(im, _shifts(im))


# -- the same over whole mosaics: pixels may be negative ----------------------------------------------------


def whole_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every star with a finite position on the cells of its mosaic, counted from the mosaic's smallest cell (``y0``, ``x0``)."""
    s = stars(spark, sf_dir, "flux").withColumn("flux", robust.finite(F.col("flux"))).filter("flux IS NOT NULL")
    px = s.groupBy(F.col("mosaic_key").alias("grp"), F.floor(F.col("y") / CELL).cast("bigint").alias("y"), F.floor(F.col("x") / CELL).cast("bigint").alias("x")).agg(F.max("flux").alias("v"))
    ends = px.groupBy("grp").agg(F.min("y").alias("y0"), F.min("x").alias("x0"), F.max("y").alias("y1"), F.max("x").alias("x1"))
    rows, cols = F.col("y1") - F.col("y0") + 1, F.col("x1") - F.col("x0") + 1
    return px.join(ends, "grp").select("grp", (F.col("y") - F.col("y0")).alias("y"), (F.col("x") - F.col("x0")).alias("x"), "v", rows.alias("rows"), cols.alias("cols"), "y0", "x0")


def _mosaic_cells(spark: SparkSession, sf_dir: str, f: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``f`` of the whole images, its cells counted from the mosaic's own zero again."""
    im = whole_image(spark, sf_dir)
    at = im.select("grp", "y0", "x0").distinct()
    return f(im.drop("y0", "x0")).join(at, "grp").withColumn("y", F.col("y") + F.col("y0")).withColumn("x", F.col("x") + F.col("x0")).drop("y0", "x0")


_WHOLE = f"""WITH {STARS_SQL}, im AS (SELECT mosaic_key AS grp, CAST(floor(y / 16.0::double) AS BIGINT) AS y, CAST(floor(x / 16.0::double) AS BIGINT) AS x, max(flux) AS v
  FROM stars WHERE isfinite(flux) GROUP BY ALL)
"""


@query(_WHOLE + """, k AS (SELECT grp, y - min(y) OVER w AS y, x - min(x) OVER w AS x, v, max(y) OVER w - min(y) OVER w + 1 AS rows, max(x) OVER w - min(x) OVER w + 1 AS cols FROM im WINDOW w AS (PARTITION BY grp))
SELECT grp, y // 4 AS r, x // 4 AS c, round(avg(v), 9) AS v, count(v) AS n FROM k WHERE y < rows // 4 * 4 AND x < cols // 4 * 4 GROUP BY ALL""")
def block_reduce_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks are counted from the mosaic's smallest cell."""
    return images.block_mean(whole_image(spark, sf_dir), 4).withColumn("v", F.round("v", 9))


@query(_WHOLE + """, t AS (SELECT grp, y - j AS y, x - i AS x, v * (1 - abs(j - 0.25)) * (1 - abs(i - 0.375)) AS wv FROM (SELECT *, unnest([0, 1]) AS j FROM (SELECT *, unnest([0, 1]) AS i FROM im)))
SELECT grp, y, x, round(sum(wv), 9) AS v FROM t GROUP BY ALL HAVING count(*) = 4""")
def bilinear_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mosaic_cells(spark, sf_dir, lambda im: images.bilinear(im, 0.25, 0.375).withColumn("v", F.round("v", 9)))


@query(_WHOLE + """, h AS (SELECT grp, quantile_cont(v, 0.99) AS lim FROM im GROUP BY grp),
o AS (SELECT grp, y + j AS y, x + i AS x, v FROM (SELECT *, unnest(range(-5, 6)) AS j FROM (SELECT *, unnest(range(-5, 6)) AS i FROM im))),
m AS (SELECT grp, y, x, max(v) AS m FROM o GROUP BY ALL)
SELECT grp, y, x, v, CAST(rank AS INTEGER) AS rank FROM (SELECT im.grp, im.y, im.x, im.v, row_number() OVER (PARTITION BY im.grp ORDER BY im.v DESC, im.y, im.x) AS rank
  FROM im JOIN h USING (grp) JOIN m ON im.grp = m.grp AND im.y = m.y AND im.x = m.x WHERE im.v >= lim AND im.v >= m.m) WHERE rank <= 30""")
def local_max_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mosaic_cells(spark, sf_dir, images.local_peaks)


@query()
def cubic_shift_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    def shifted(im: DataFrame) -> DataFrame:
        return images.cubic_shift(im, _shifts(im))

    return _mosaic_cells(spark, sf_dir, shifted)


@query(f"""WITH {STARS_SQL}, c AS (SELECT CAST(floor(x / 256) AS BIGINT) AS cx, CAST(floor(y / 256) AS BIGINT) AS cy, filter_name, flux FROM stars WHERE isfinite(flux)),
p AS (SELECT cx, cy, median(flux) FILTER (filter_name = 'F444W') AS r, median(flux) FILTER (filter_name = 'F200W') AS g, median(flux) FILTER (filter_name = 'F090W') AS b FROM c GROUP BY ALL)
SELECT cx, cy, r IS NOT NULL AND g IS NOT NULL AND b IS NOT NULL AND r <> 0 AND g <> 0 AND b <> 0 AS whole,
  CASE WHEN r IS NOT NULL AND g IS NOT NULL AND b IS NOT NULL AND r <> 0 AND g <> 0 AND b <> 0 THEN CAST(round_even(least(greatest((asinh(r / 9.9::double) - asinh(1.0::double / 9.9::double)) / (asinh(100.0::double / 9.9::double) - asinh(1.0::double / 9.9::double)), 0.0), 1.0) * 65535.0::double, 0) AS INTEGER) ELSE 0 END AS red,
  CASE WHEN r IS NOT NULL AND g IS NOT NULL AND b IS NOT NULL AND r <> 0 AND g <> 0 AND b <> 0 THEN CAST(round_even(least(greatest((asinh(g / 9.9::double) - asinh(1.0::double / 9.9::double)) / (asinh(100.0::double / 9.9::double) - asinh(1.0::double / 9.9::double)), 0.0), 1.0) * 65535.0::double, 0) AS INTEGER) ELSE 0 END AS green,
  CASE WHEN r IS NOT NULL AND g IS NOT NULL AND b IS NOT NULL AND r <> 0 AND g <> 0 AND b <> 0 THEN CAST(round_even(least(greatest((asinh(b / 9.9::double) - asinh(1.0::double / 9.9::double)) / (asinh(100.0::double / 9.9::double) - asinh(1.0::double / 9.9::double)), 0.0), 1.0) * 65535.0::double, 0) AS INTEGER) ELSE 0 END AS blue FROM p""")
def rgb_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three channels on one grid; a pixel is black in all bands unless every band has a value other than 0."""
    s = stars(spark, sf_dir, "filter_name", "flux").select(F.floor(F.col("x") / 256).cast("bigint").alias("cx"), F.floor(F.col("y") / 256).cast("bigint").alias("cy"), "filter_name", robust.finite(F.col("flux")).alias("flux")).filter("flux IS NOT NULL")
    p = s.groupBy("cx", "cy").pivot("filter_name", ["F444W", "F200W", "F090W"]).agg(F.median("flux")).withColumnsRenamed({"F444W": "r", "F200W": "g", "F090W": "b"})
    whole = F.coalesce((F.col("r") != 0) & (F.col("g") != 0) & (F.col("b") != 0), F.lit(False))
    dn = lambda c: F.when(whole, images.quantised(images.asinh_stretch(F.col(c), 1.0, 100.0, softening=9.9))).otherwise(0)
    return p.select("cx", "cy", whole.alias("whole"), dn("r").alias("red"), dn("g").alias("green"), dn("b").alias("blue"))


@query("""SELECT event_id, CAST(round_even(least(greatest((asinh(value / 10.0::double) - asinh(1.0::double / 10.0::double)) / (asinh(101.0::double / 10.0::double) - asinh(1.0::double / 10.0::double)), 0.0), 1.0) * 65535.0::double, 0) AS INTEGER) AS dn,
  CAST(round_even(least(greatest((asinh(value / 10.0::double) - asinh(1.0::double / 10.0::double)) / (asinh(101.0::double / 10.0::double) - asinh(1.0::double / 10.0::double)), 0.0), 1.0) * 65535.0::double, 0) AS INTEGER) - 32768 AS stored FROM events""")
def asinh_stretch_u16(spark: SparkSession, sf_dir: str) -> DataFrame:
    dn = images.quantised(images.asinh_stretch(F.col("value"), 1.0, 101.0))
    return table(spark, sf_dir, "events").select("event_id", dn.alias("dn"), images.stored_int16(dn).cast("int").alias("stored"))


@query(f"WITH {STARS_SQL} SELECT quantile_cont(flux, 0.01) AS low, quantile_cont(flux, 0.995) AS high FROM stars WHERE isfinite(flux)")
def shared_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Limits of one stretch shared by all channels: percentiles of the pooled flux."""
    lo, hi = robust.whole_percentiles(stars(spark, sf_dir, "flux"), "flux", [0.01, 0.995])
    return spark.createDataFrame([(lo, hi)], "low double, high double")


@query(f"""WITH {STARS_SQL}, l AS (SELECT mosaic_key, quantile_cont(flux, 0.01) AS lo, quantile_cont(flux, 0.995) AS hi FROM stars WHERE isfinite(flux) GROUP BY 1)
SELECT star_id, round(least(greatest(asinh((flux - (lo + hi) / 2) / (greatest(hi - lo, 1e-12) / 2)), -1.0), 1.0), 9) AS shown FROM stars JOIN l USING (mosaic_key) WHERE isfinite(flux)""")
def display_stretch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each star's flux on its own mosaic's display scale: asinh about the centre of its percentiles."""
    s = stars(spark, sf_dir, "flux").select("star_id", "mosaic_key", robust.finite(F.col("flux")).alias("flux")).filter("flux IS NOT NULL")
    lim = robust.group_percentiles(s, ["mosaic_key"], {"lo": ("flux", 0.01), "hi": ("flux", 0.995)})
    y = F.asinh((F.col("flux") - (F.col("lo") + F.col("hi")) / 2) / (F.greatest(F.col("hi") - F.col("lo"), F.lit(1e-12)) / 2))
    return s.join(lim, "mosaic_key").select("star_id", F.round(F.least(F.greatest(y, F.lit(-1.0)), F.lit(1.0)), 9).alias("shown"))


# -- geometry -------------------------------------------------------------------------------------------


@query("""WITH f AS (SELECT DISTINCT frame_id, visit, detector, exposure, regexp_extract(lower(filename), '^(jw[0-9]+)_', 1) AS g, radians(ra_deg) AS lon, radians(dec_deg) AS lat, pixscale_arcsec AS s FROM frames
  WHERE isfinite(ra_deg) AND isfinite(dec_deg) AND abs(dec_deg) <= 90),
r AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY g, detector ORDER BY exposure, frame_id) = 1),
t AS (SELECT f.frame_id, f.s, sin(r.lat) * sin(f.lat) + cos(r.lat) * cos(f.lat) * cos(f.lon - r.lon) AS c, cos(f.lat) * sin(f.lon - r.lon) AS u, cos(r.lat) * sin(f.lat) - sin(r.lat) * cos(f.lat) * cos(f.lon - r.lon) AS v FROM f JOIN r ON f.g = r.g AND f.detector = r.detector)
SELECT frame_id, round(degrees(u / c) * 3600 / s, 4) AS x_px, round(degrees(v / c) * 3600 / s, 4) AS y_px FROM t WHERE c > 0""")
def tan_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frame centres in pixels about the first exposure of their visit and detector."""
    f = table(spark, sf_dir, "frames").filter((F.abs("dec_deg") <= 90.0) & (F.abs("ra_deg") < float("inf")))
    f = f.select("frame_id", "detector", "exposure", F.regexp_extract(F.lower("filename"), "^(jw[0-9]+)_", 1).alias("g"), F.radians("ra_deg").alias("lon"), F.radians("dec_deg").alias("lat"), F.col("pixscale_arcsec").alias("s")).distinct()
    first = f.groupBy("g", "detector").agg(F.min_by(F.struct("lon", "lat"), F.struct("exposure", "frame_id")).alias("r"))
    xi, eta = images.tan_plane(F.col("lon"), F.col("lat"), F.col("r.lon"), F.col("r.lat"))
    px = lambda v: F.round(F.degrees(v) * 3600 / F.col("s"), 4)
    return f.join(first, ["g", "detector"]).select("frame_id", px(xi).alias("x_px"), px(eta).alias("y_px")).filter("x_px IS NOT NULL")


@query("""WITH w AS (SELECT line_id, list_filter(regexp_split_to_array(trim(upper(raw_line)), '\\s+'), lambda x: x <> '') AS q, raw_line FROM (SELECT DISTINCT line_id, regexp_extract(raw_line, '^[^",]*,[^",]*,"?([^",]*)"?$', 1) AS raw_line FROM obs_lines)),
n AS (SELECT line_id, [TRY_CAST(x AS DOUBLE) FOR x IN q[2:]] AS v FROM w WHERE q[1] = 'POLYGON' AND len(q) >= 7 AND len(q) % 2 = 1),
c AS (SELECT line_id, list_filter(v, lambda x, i: i % 2 = 1) AS ra, list_filter(v, lambda x, i: i % 2 = 0) AS dec FROM n WHERE len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0)
SELECT line_id, list_min(ra) AS ra0, list_max(ra) AS ra1, list_min(dec) AS dec0, list_max(dec) AS dec1,
  CAST(ceil((list_max(ra) - list_min(ra)) * 3600 / 0.031::double) + 60 AS BIGINT) AS nx, CAST(ceil((list_max(dec) - list_min(dec)) * 3600 / 0.031::double) + 60 AS BIGINT) AS ny FROM c""")
def s_region_bbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Box and grid shape of each footprint that parses; the right ascension's wrap is not handled."""
    text = F.regexp_extract("raw_line", r'^[^",]*,[^",]*,"?([^",]*)"?$', 1)
    q = table(spark, sf_dir, "obs_lines").select("line_id", F.filter(F.split(F.trim(F.upper(text)), r"\s+"), lambda x: x != "").alias("q")).distinct()
    ok = (F.get("q", F.lit(0)) == "POLYGON") & (F.size("q") >= 7) & (F.size("q") % 2 == 1)
    v = q.filter(ok).select("line_id", F.transform(F.slice("q", 2, F.greatest(F.size("q") - 1, F.lit(0))), lambda x: x.try_cast("double")).alias("v"))
    v = v.filter(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    ra, dec = F.filter("v", lambda x, i: i % 2 == 0), F.filter("v", lambda x, i: i % 2 == 1)
    v = v.select("line_id", F.array_min(ra).alias("ra0"), F.array_max(ra).alias("ra1"), F.array_min(dec).alias("dec0"), F.array_max(dec).alias("dec1"))
    cells = lambda a, b: (F.ceil((F.col(b) - F.col(a)) * 3600 / 0.031) + 60).cast("bigint")
    return v.withColumn("nx", cells("ra0", "ra1")).withColumn("ny", cells("dec0", "dec1"))


@query("SELECT DISTINCT frame_id, pixscale_arcsec / 3600 AS pixscale_deg, pixscale_arcsec * 2048 AS side_arcsec, round(0.25 * pixscale_arcsec, 12) AS shift_arcsec FROM frames WHERE isfinite(pixscale_arcsec) AND pixscale_arcsec > 0")
def unit_convert(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = table(spark, sf_dir, "frames").filter((F.col("pixscale_arcsec") > 0) & (F.col("pixscale_arcsec") < float("inf")))
    s = F.col("pixscale_arcsec")
    return f.select("frame_id", (s / 3600).alias("pixscale_deg"), (s * 2048).alias("side_arcsec"), F.round(0.25 * s, 12).alias("shift_arcsec")).distinct()


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stars(spark, sf_dir).select(F.col("mosaic_key").alias("grp"), F.col("star_id").alias("id"), "x", "y")


@query(f"""WITH {STARS_SQL}, c AS (SELECT DISTINCT mosaic_key AS grp, CAST(floor(x / 64) AS BIGINT) AS cx, CAST(floor(y / 64) AS BIGINT) AS cy FROM stars)
SELECT grp, CAST(floor(cx / 16) AS BIGINT) AS tx, CAST(floor(cy / 16) AS BIGINT) AS ty, count(*) AS cells, count(*) / 256.0::double AS fraction FROM c GROUP BY ALL""")
def tile_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planning.covered_tiles(_points(spark, sf_dir), 1024, 64)


@query(f"""WITH {STARS_SQL}, c AS (SELECT DISTINCT mosaic_key AS grp, CAST(floor(x / 64) AS BIGINT) AS cx, CAST(floor(y / 64) AS BIGINT) AS cy FROM stars),
t AS (SELECT grp, CAST(floor(cx / 16) AS BIGINT) AS tx, CAST(floor(cy / 16) AS BIGINT) AS ty, count(*) / 256.0::double AS fraction FROM c GROUP BY ALL),
n AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY ty, tx) - 1 AS i, count(*) OVER (PARTITION BY grp) AS n FROM t)
SELECT grp, tx, ty, fraction FROM n WHERE list_contains([CAST(round_even(k * (n - 1) / 23.0::double, 0) AS BIGINT) FOR k IN range(0, 24)], i)""")
def sampled_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """24 evenly spaced tiles of each mosaic."""
    t = planning.covered_tiles(_points(spark, sf_dir), 1024, 64)
    return planning.evenly_spaced(t, ["grp"], ["ty", "tx"], 24).select("grp", "tx", "ty", "fraction")


_BOX = "greatest(6, ceil(4 * fwhm_px / 2.3548::double))"


@query(f"""WITH {STARS_SQL}, b AS (SELECT mosaic_key AS grp, star_id, x - {_BOX} AS x0, y - {_BOX} AS y0, x + {_BOX} AS x1, y + {_BOX} AS y1 FROM stars WHERE isfinite(fwhm_px)),
t AS (SELECT grp, star_id, tx, unnest(range(CAST(floor(y0 / 128) AS BIGINT), CAST(ceil(y1 / 128) AS BIGINT))) AS ty FROM (SELECT *, unnest(range(CAST(floor(x0 / 128) AS BIGINT), CAST(ceil(x1 / 128) AS BIGINT))) AS tx FROM b))
SELECT grp, tx, ty, count(*) AS patches FROM t GROUP BY ALL""")
def tile_frame_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many star patches each tile must load."""
    half = F.greatest(F.lit(6), F.ceil(4 * F.col("fwhm_px") / 2.3548))
    b = stars(spark, sf_dir, "fwhm_px").filter(robust.finite(F.col("fwhm_px")).isNotNull()).select(F.col("mosaic_key").alias("grp"), (F.col("x") - half).alias("x0"), (F.col("y") - half).alias("y0"), (F.col("x") + half).alias("x1"), (F.col("y") + half).alias("y1"))
    return planning.tiles_touched(b, 128).groupBy("grp", "tx", "ty").agg(F.count("*").alias("patches"))


@query(SQL["tile_frame_overlap"].replace("SELECT grp, tx, ty, count(*) AS patches FROM t GROUP BY ALL", ", u AS (SELECT grp, tx, ty, count(*) AS patches FROM t GROUP BY ALL) SELECT grp, count(*) AS tiles, max(patches) AS most, round(avg(patches), 9) AS mean, CAST(sum(patches) AS BIGINT) AS loads FROM u GROUP BY grp"))
def mosaic_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles, loads and depth of a build over each mosaic."""
    t = QUERIES["tile_frame_overlap"](spark, sf_dir)
    return t.groupBy("grp").agg(F.count("*").alias("tiles"), F.max("patches").alias("most"), F.round(F.avg("patches"), 9).alias("mean"), F.sum("patches").alias("loads"))


@query(f"""WITH {STARS_SQL}, h AS (SELECT mosaic_key AS grp, star_id AS id, x, y, tx, unnest(range(CAST(floor((y - 24) / 256) AS BIGINT), CAST(floor((y + 24) / 256) AS BIGINT) + 1)) AS ty FROM
(SELECT *, unnest(range(CAST(floor((x - 24) / 256) AS BIGINT), CAST(floor((x + 24) / 256) AS BIGINT) + 1)) AS tx FROM stars))
SELECT grp, tx, ty, count(*) AS seen, count(*) FILTER (tx = floor(x / 256) AND ty = floor(y / 256)) AS owned FROM h GROUP BY ALL""")
def halo_interior(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stars that each haloed tile sees and those that it owns; every star is owned once."""
    h = planning.with_halo(_points(spark, sf_dir), 256, 24)
    return h.groupBy("grp", "tx", "ty").agg(F.count("*").alias("seen"), F.count_if("interior").alias("owned"))


@query(f"""WITH {STARS_SQL}, s AS (SELECT mosaic_key AS grp, CASE WHEN isfinite(fwhm_px) THEN fwhm_px END AS f, x, y FROM stars), k AS (SELECT * FROM s WHERE f IS NOT NULL),
a AS (SELECT grp, count(*) AS n, avg(x) AS mx, avg(y) AS my, avg(f) AS mf FROM k GROUP BY grp),
b AS (SELECT grp, n, mx, my, mf, sum((x - mx) * (x - mx)) AS xx, sum((y - my) * (y - my)) AS yy, sum((x - mx) * (y - my)) AS xy, sum((x - mx) * (f - mf)) AS xf, sum((y - my) * (f - mf)) AS yf FROM k JOIN a USING (grp) GROUP BY ALL)
SELECT grp, n, round((yy * xf - xy * yf) / (xx * yy - xy * xy), 9) AS gx, round((xx * yf - xy * xf) / (xx * yy - xy * xy), 9) AS gy, round(mf, 6) AS mean FROM b WHERE xx * yy - xy * xy > 0""")
def planar_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gradient of the star width over each mosaic: least squares on x and y from centred sums."""
    k = stars(spark, sf_dir, "fwhm_px").select(F.col("mosaic_key").alias("grp"), robust.finite(F.col("fwhm_px")).alias("f"), "x", "y").filter("f IS NOT NULL")
    a = k.groupBy("grp").agg(F.avg("x").alias("mx"), F.avg("y").alias("my"), F.avg("f").alias("mf"))
    x, y, f = F.col("x") - F.col("mx"), F.col("y") - F.col("my"), F.col("f") - F.col("mf")
    b = k.join(a, "grp").groupBy("grp").agg(F.count("*").alias("n"), F.first("mf").alias("mf"), F.sum(x * x).alias("xx"), F.sum(y * y).alias("yy"), F.sum(x * y).alias("xy"), F.sum(x * f).alias("xf"), F.sum(y * f).alias("yf"))
    det = F.col("xx") * F.col("yy") - F.col("xy") * F.col("xy")
    gx, gy = (F.col("yy") * F.col("xf") - F.col("xy") * F.col("yf")) / det, (F.col("xx") * F.col("yf") - F.col("xy") * F.col("xf")) / det
    return b.filter(det > 0).select("grp", "n", F.round(gx, 9).alias("gx"), F.round(gy, 9).alias("gy"), F.round("mf", 6).alias("mean"))


@query("""WITH RECURSIVE c AS (SELECT DISTINCT mosaic_key AS grp, CAST(floor(x / 256) AS BIGINT) AS cx, CAST(floor(y / 256) AS BIGINT) AS cy FROM star_fits WHERE isfinite(x) AND isfinite(y)),
k AS (SELECT grp, cx, cy, grp || ':' || cx || ':' || cy AS node FROM c),
e AS (SELECT a.node, b.node AS other FROM k a JOIN k b ON a.grp = b.grp AND ((a.cx = b.cx AND abs(a.cy - b.cy) = 1) OR (a.cy = b.cy AND abs(a.cx - b.cx) = 1))),
r AS (SELECT node, node AS root FROM e UNION SELECT e.other, r.root FROM r JOIN e ON r.node = e.node)
SELECT node, min(root) AS root FROM r GROUP BY node""")
def connected_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Covered cells of each mosaic that touch, with the group they form."""
    c = _points(spark, sf_dir).select("grp", F.floor(F.col("x") / 256).cast("bigint").alias("cx"), F.floor(F.col("y") / 256).cast("bigint").alias("cy")).distinct()
    node = lambda x, y: F.concat_ws(":", "grp", x.cast("string"), y.cast("string"))
    here = c.select("grp", node(F.col("cx"), F.col("cy")).alias("node"), F.explode(F.array(*[F.struct((F.col("cx") + i).alias("x"), (F.col("cy") + j).alias("y")) for i, j in ((0, 1), (1, 0))])).alias("t"))
    e = here.select("node", node(F.col("t.x"), F.col("t.y")).alias("other"))
    there = c.select(node(F.col("cx"), F.col("cy")).alias("other"))
    return graphs.connected(e.join(there, "other", "left_semi"), "node", "other")


@query("""WITH f AS (SELECT mosaic_key AS grp, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM star_fits WHERE isfinite(x) AND isfinite(y) GROUP BY 1)
SELECT a.grp AS a, b.grp AS b, round(greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0)) / ((a.x1 - a.x0) * (a.y1 - a.y0)), 9) AS share
FROM f a JOIN f b ON a.grp < b.grp WHERE a.x1 > a.x0 AND a.y1 > a.y0 AND left(a.grp, 5) = left(b.grp, 5)""")
def overlap_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of one mosaic's pixel range another of its series covers."""
    f = _points(spark, sf_dir).groupBy("grp").agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1")).withColumn("series", F.left("grp", F.lit(5)))
    a, b = (f.select("series", *[F.col(c).alias(f"{p}_{c}") for c in ("grp", "x0", "x1", "y0", "y1")]) for p in "ab")
    side = lambda c: F.greatest(F.lit(0.0), F.least(f"a_{c}1", f"b_{c}1") - F.greatest(f"a_{c}0", f"b_{c}0"))
    area = (F.col("a_x1") - F.col("a_x0")) * (F.col("a_y1") - F.col("a_y0"))
    return a.join(b, "series").filter((F.col("a_grp") < F.col("b_grp")) & (F.col("a_x1") > F.col("a_x0")) & (F.col("a_y1") > F.col("a_y0"))).select(F.col("a_grp").alias("a"), F.col("b_grp").alias("b"), F.round(side("x") * side("y") / area, 9).alias("share"))


# -- masks, names and inventory -----------------------------------------------------------------------------


@query("SELECT event_id, CASE WHEN isfinite(value) AND event_type <> 'error' THEN value END AS v FROM events")
def dq_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of rows without the do-not-use bit, which errors carry."""
    bits = F.when(F.col("event_type") == "error", F.lit(1)).otherwise(F.lit(0))
    return table(spark, sf_dir, "events").select("event_id", F.when(bits.bitwiseAND(1) == 0, robust.finite(F.col("value"))).alias("v"))


@query("SELECT DISTINCT frame_id FROM frames WHERE upper(trim(filter_name)) IN ('F200W', 'F444W') AND upper(trim(detector)) IN ('NRCA1', 'NRCB4', 'NRCALONG') AND upper(trim(coalesce(pupil, 'CLEAR'))) IN ('CLEAR')")
def selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = table(spark, sf_dir, "frames").withColumn("pupil", F.coalesce("pupil", F.lit("CLEAR")))
    return planning.selected(f, filter_name=["f200w ", "F444W"], detector=["nrca1", "nrcb4", "nrcalong"], pupil=["clear"]).select("frame_id").distinct()


@query("SELECT upper(trim(filter_name)) AS filter_name, array_to_string(list_sort(list(DISTINCT upper(trim(coalesce(pupil, 'CLEAR'))))), ',') AS pupils, count(DISTINCT upper(trim(coalesce(pupil, 'CLEAR')))) > 1 AS is_mixed FROM frames GROUP BY 1")
def mixed_pupils(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planning.one_pupil(table(spark, sf_dir, "frames"))


_NAME = "'^jw([0-9]{5})([0-9]{3})([0-9]{3})_([0-9]{5})_([0-9]{5})_(nrc[ab](?:[1-4]|long))_(cal|i2d)\\.fits?$'"
_NAME_COLS = ", ".join(
    [f"nullif(regexp_extract(n, {_NAME}, {k}), '') AS {c}" for k, c in ((1, "program"), (2, "observation"), (6, "detector"), (7, "kind"))]
    + [f"coalesce(TRY_CAST(nullif(regexp_extract(n, {_NAME}, {k}), '') AS INTEGER), -1) AS {c}" for k, c in ((3, "visit"), (5, "exposure"))]
)


@query(f"SELECT DISTINCT n AS filename, {_NAME_COLS} FROM (SELECT lower(trim(filename)) AS n FROM download_items)")
def filename_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.lower(F.trim("filename"))
    return table(spark, sf_dir, "download_items").select(n.alias("filename"), *planning.name_parts(F.col("filename"))).distinct()


@query("""SELECT DISTINCT lower(trim(filename)) AS filename, lower(trim(filename)) LIKE '%nrc%' AS is_camera, lower(trim(filename)) LIKE '%_i2d.fits' AS is_combined,
  'Products/' || obs_id || '/' || lower(trim(filename)) AS path, upper(trim(filter_name)) || ';' || upper(trim(coalesce(pupil, 'CLEAR'))) AS bandpass FROM download_items""")
def product_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.lower(F.trim("filename"))
    band = F.concat_ws(";", planning.folded(F.col("filter_name")), planning.folded(F.coalesce("pupil", F.lit("CLEAR"))))
    return table(spark, sf_dir, "download_items").select(n.alias("filename"), n.contains("nrc").alias("is_camera"), n.endswith("_i2d.fits").alias("is_combined"), F.concat(F.lit("Products/"), "obs_id", F.lit("/"), n).alias("path"), band.alias("bandpass")).distinct()


_LATEST = """i AS (SELECT lower(trim(filename)) AS filename, expected_size, filter_name, kind, visit, detector, lower(trim(status)) AS status FROM download_items
  QUALIFY row_number() OVER (PARTITION BY lower(trim(filename)) ORDER BY recorded_at DESC, expected_size DESC NULLS LAST) = 1),
v AS (SELECT lower(trim(filename)) AS filename, actual_size FROM verify_rows QUALIFY row_number() OVER (PARTITION BY lower(trim(filename)) ORDER BY checked_at DESC, actual_size DESC NULLS LAST) = 1),
rc AS (SELECT coalesce(i.filename, v.filename) AS filename, expected_size, actual_size, CASE WHEN i.filename IS NULL THEN 'extra' WHEN v.filename IS NULL THEN 'missing'
  WHEN expected_size > 0 AND expected_size = actual_size THEN 'ok' ELSE 'size_mismatch' END AS state FROM i FULL JOIN v ON i.filename = v.filename)
"""


def _plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "download_items")
    t = t.select(F.lower(F.trim("filename")).alias("filename"), "expected_size", "filter_name", "kind", "visit", "detector", F.lower(F.trim("status")).alias("status"), "recorded_at")
    return planning.latest(t, "filename", "recorded_at", "expected_size")


def _disk(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "verify_rows").select(F.lower(F.trim("filename")).alias("filename"), "actual_size", "checked_at")
    return planning.latest(t, "filename", "checked_at", "actual_size")


@query(f"WITH {_LATEST} SELECT filename, coalesce(expected_size, -1) AS expected_size, coalesce(actual_size, -1) AS actual_size, state FROM rc")
def reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planned against found files; a size that is not there is -1."""
    r = planning.in_report_order(planning.reconciled(_plan(spark, sf_dir), _disk(spark, sf_dir)))
    return r.select("filename", F.coalesce("expected_size", F.lit(-1)).alias("expected_size"), F.coalesce("actual_size", F.lit(-1)).alias("actual_size"), "state")


@query(f"WITH {_LATEST} SELECT state, count(*) AS files, CAST(coalesce(sum(coalesce(expected_size, actual_size)), 0) AS BIGINT) AS bytes, state IN ('size_mismatch', 'extra') AS always_gates FROM rc GROUP BY state")
def verify_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = planning.reconciled(_plan(spark, sf_dir), _disk(spark, sf_dir))
    return r.groupBy("state").agg(F.count("*").alias("files"), F.coalesce(F.sum(F.coalesce("expected_size", "actual_size")), F.lit(0)).alias("bytes")).withColumn("always_gates", F.col("state").isin("size_mismatch", "extra"))


@query(f"WITH {_LATEST} SELECT i.filename FROM i JOIN v ON i.filename = v.filename AND i.expected_size = v.actual_size")
def already_there(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, d = _plan(spark, sf_dir), _disk(spark, sf_dir).withColumnRenamed("actual_size", "expected_size")
    return p.join(d, ["filename", "expected_size"], "left_semi").select("filename")


@query(f"WITH {_LATEST} SELECT filter_name, kind, coalesce(visit, -1) AS visit, detector, count(*) AS files, round(coalesce(sum(expected_size), 0) / 1e6, 3) AS mb FROM i GROUP BY GROUPING SETS ((filter_name, kind, visit, detector), ())")
def summary_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files and megabytes by filter, kind, visit and detector, and in all (visit -1)."""
    p = _plan(spark, sf_dir)
    keys = [F.col(c) for c in ("filter_name", "kind", "visit", "detector")]
    t = p.groupingSets([keys, []], *keys).agg(F.count("*").alias("files"), F.round(F.coalesce(F.sum("expected_size"), F.lit(0)) / 1e6, 3).alias("mb"))
    return t.withColumn("visit", F.coalesce("visit", F.lit(-1)))


@query(f"""WITH {_LATEST} SELECT i.kind, count(*) AS planned, count(v.filename) AS existing, count(*) - count(v.filename) AS pending, count(*) FILTER (status NOT IN ('ok', 'skipped')) AS failed,
  round(coalesce(sum(expected_size) FILTER (v.filename IS NULL), 0) / 1e9, 6) AS pending_gb FROM i LEFT JOIN v ON i.filename = v.filename AND i.expected_size = v.actual_size GROUP BY i.kind""")
def stage_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, d = _plan(spark, sf_dir), _disk(spark, sf_dir).select("filename", F.col("actual_size").alias("expected_size"), F.lit(True).alias("there"))
    j = p.join(d, ["filename", "expected_size"], "left")
    pending = F.sum(F.when(F.col("there").isNull(), F.col("expected_size")))
    return j.groupBy("kind").agg(
        F.count("*").alias("planned"), F.count("there").alias("existing"), (F.count("*") - F.count("there")).alias("pending"), F.count_if(~F.col("status").isin("ok", "skipped")).alias("failed"),
        F.round(F.coalesce(pending, F.lit(0)) / 1e9, 6).alias("pending_gb"),
    )


@query("""SELECT filters, count(*) AS total, count(*) FILTER (region = '') AS missing FROM (SELECT DISTINCT line_id, upper(trim(regexp_extract(raw_line, '^([^",]*),([^",]*),([^",]*)$', 2))) AS filters,
  trim(regexp_extract(raw_line, '^([^",]*),([^",]*),([^",]*)$', 3)) AS region FROM obs_lines) GROUP BY filters""")
def obs_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations and lacking footprints by filter."""
    r = r'^([^",]*),([^",]*),([^",]*)$'
    t = table(spark, sf_dir, "obs_lines").select("line_id", F.upper(F.trim(F.regexp_extract("raw_line", r, 2))).alias("filters"), F.trim(F.regexp_extract("raw_line", r, 3)).alias("region")).distinct()
    return t.groupBy("filters").agg(F.count("*").alias("total"), F.count_if(F.col("region") == "").alias("missing"))


@query("SELECT DISTINCT upper(trim(filter_name)) AS filter_name FROM frames WHERE filter_name IS NOT NULL")
def distinct_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "frames").filter("filter_name IS NOT NULL").select(planning.folded(F.col("filter_name")).alias("filter_name")).distinct().orderBy("filter_name")


@query("""SELECT DISTINCT filter_name || CASE WHEN pupil IS NULL OR upper(pupil) = 'CLEAR' THEN '' ELSE ';' || upper(pupil) END AS channel, lower(filter_name) AS stem,
  CASE WHEN filter_name IN ('F444W', 'F200W', 'F090W') AND coalesce(upper(pupil), 'CLEAR') = 'CLEAR' THEN 'rgb' ELSE 'feature' END AS role FROM frames WHERE filter_name IS NOT NULL""")
def channel_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The channels that frames belong to: a bandpass is a filter and its pupil."""
    p = F.coalesce(F.upper("pupil"), F.lit("CLEAR"))
    f = table(spark, sf_dir, "frames").filter("filter_name IS NOT NULL")
    label = F.concat("filter_name", F.when(p == "CLEAR", F.lit("")).otherwise(F.concat(F.lit(";"), p)))
    role = F.when(F.col("filter_name").isin("F444W", "F200W", "F090W") & (p == "CLEAR"), "rgb").otherwise("feature")
    return f.select(label.alias("channel"), F.lower("filter_name").alias("stem"), role.alias("role")).distinct()


@query("""WITH p AS (SELECT DISTINCT star_id, amp, pedestal, fwhm_major_px / 2.3548200450309493::double AS a, fwhm_minor_px / 2.3548200450309493::double AS b FROM star_fits WHERE isfinite(amp) AND isfinite(pedestal) AND fwhm_major_px > 0 AND fwhm_minor_px > 0 AND isfinite(fwhm_major_px))
SELECT star_id, CAST(k AS INTEGER) AS offset_px, round(pedestal + amp * exp(-(k * k) / (2 * a * a)), 6) AS along, round(pedestal + amp * exp(-(k * k) / (2 * b * b)), 6) AS across FROM (SELECT *, unnest([0, 1, 2]) AS k FROM p)""")
def gaussian_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each fitted profile at 0, 1 and 2 pixels along its axes."""
    s = table(spark, sf_dir, "star_fits").select("star_id", robust.finite(F.col("amp")).alias("amp"), robust.finite(F.col("pedestal")).alias("pedestal"), (F.col("fwhm_major_px") / 2.3548200450309493).alias("a"), (F.col("fwhm_minor_px") / 2.3548200450309493).alias("b"))
    s = s.filter("amp IS NOT NULL AND pedestal IS NOT NULL AND a > 0 AND b > 0 AND a < double('Infinity')").distinct().withColumn("k", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    at = lambda c: F.round(F.col("pedestal") + F.col("amp") * F.exp(-(F.col("k") * F.col("k")) / (2 * F.col(c) * F.col(c))), 6)
    return s.select("star_id", F.col("k").alias("offset_px"), at("a").alias("along"), at("b").alias("across"))


@query(f"""WITH {STARS_SQL}, n AS (SELECT mosaic_key, star_id, flux, row_number() OVER (PARTITION BY mosaic_key ORDER BY star_id) - 1 AS i, count(*) OVER (PARTITION BY mosaic_key) AS n FROM stars WHERE isfinite(flux))
SELECT mosaic_key, star_id, flux FROM n WHERE i % greatest(1, n // 200) = 0""")
def strided_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every k-th star of a mosaic in id order, k = max(1, stars // 200): a sampling operator."""
    s = stars(spark, sf_dir, "flux").select("mosaic_key", "star_id", robust.finite(F.col("flux")).alias("flux")).filter("flux IS NOT NULL")
    s = robust.numbered(s, ["mosaic_key"], "star_id")
    return s.filter(F.expr("_i % greatest(1, _n div 200) = 0")).select("mosaic_key", "star_id", "flux")


@query(
    "WITH b AS ("
    + SQL["s_region_bbox"].replace("FROM c", "FROM c")
    + """), f AS (SELECT DISTINCT line_id, file_name FROM obs_lines)
SELECT file_name, count(*) AS total, count(b.line_id) AS used, min(ra0) AS ra0, max(ra1) AS ra1, min(dec0) AS dec0, max(dec1) AS dec1,
  CAST(ceil((max(ra1) - min(ra0)) * 3600 / 0.031::double) + 60 AS BIGINT) AS nx, CAST(ceil((max(dec1) - min(dec0)) * 3600 / 0.031::double) + 60 AS BIGINT) AS ny
FROM f LEFT JOIN b USING (line_id) GROUP BY file_name HAVING count(b.line_id) > 0"""
)
def region_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Box and north-up grid over all footprints of a listing, and how many of its rows have one."""
    f = table(spark, sf_dir, "obs_lines").select("line_id", "file_name").distinct()
    b = QUERIES["s_region_bbox"](spark, sf_dir)
    u = f.join(b, "line_id", "left").groupBy("file_name").agg(
        F.count("*").alias("total"), F.count("ra0").alias("used"), F.min("ra0").alias("ra0"), F.max("ra1").alias("ra1"), F.min("dec0").alias("dec0"), F.max("dec1").alias("dec1"))
    cells = lambda a, b: (F.ceil((F.col(b) - F.col(a)) * 3600 / 0.031) + 60).cast("bigint")
    return u.filter("used > 0").withColumn("nx", cells("ra0", "ra1")).withColumn("ny", cells("dec0", "dec1"))


@query(f"""WITH {STARS_SQL}, l AS (SELECT filter_name, floor(x / 512) AS tx, floor(y / 512) AS ty, mosaic_key, median(pedestal) AS level FROM stars WHERE isfinite(pedestal) GROUP BY ALL),
b AS (SELECT filter_name, median(level) AS background, count(*) AS tiles FROM l GROUP BY 1), q AS (SELECT quantile_cont(flux, 0.01) AS lo, quantile_cont(flux, 0.995) AS hi FROM stars WHERE isfinite(flux))
SELECT filter_name, tiles, background, lo AS low, hi AS high, 0.1::double * (hi - lo) AS softening FROM b CROSS JOIN q""")
def color_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a colour build needs: each channel's background and the stretch that all share."""
    lo, hi = robust.whole_percentiles(stars(spark, sf_dir, "flux"), "flux", [0.01, 0.995])
    s = stars(spark, sf_dir, "filter_name", "pedestal").select("filter_name", "mosaic_key", F.floor(F.col("x") / 512).alias("tx"), F.floor(F.col("y") / 512).alias("ty"), robust.finite(F.col("pedestal")).alias("v"))
    tile = s.filter("v IS NOT NULL").groupBy("filter_name", "mosaic_key", "tx", "ty").agg(F.median("v").alias("level"))
    n = tile.groupBy("filter_name").agg(F.count("*").alias("tiles"))
    level = robust.group_percentiles(tile, ["filter_name"], {"background": ("level", 0.5)})
    shared = {"low": lo, "high": hi, "softening": None if lo is None else 0.1 * (hi - lo)}
    return n.join(level, "filter_name").withColumns({k: F.lit(v).cast("double") for k, v in shared.items()})
