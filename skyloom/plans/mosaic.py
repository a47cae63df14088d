"""Queries of the mosaic build: frames on a grid, tiles, registration applied, combined; and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skyloom.functions import robust
from skyloom.operators import images, matching, planning
from skyloom.plans.imaging import whole_image
from skyloom.plans.stacking import STARS_SQL, clip_sql, stars
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


# -- frames and their solutions ---------------------------------------------------------------------------


@query("""WITH s AS (SELECT filename, arg_max({'dx': dx, 'dy': dy, 'r': is_reference, 'i': reg_id}, {'a': solved_at, 'b': reg_id}) AS s FROM frame_registrations GROUP BY filename),
v AS (SELECT regexp_extract(filename, '^(jw[0-9]{8})', 1) AS field, visit, median(visit_dx) AS visit_dx, median(visit_dy) AS visit_dy FROM (SELECT DISTINCT reg_id, filename, visit, visit_dx, visit_dy FROM frame_registrations WHERE isfinite(visit_dx) AND isfinite(visit_dy)) GROUP BY 1, 2),
f AS (SELECT DISTINCT frame_id, filename, visit FROM frames)
SELECT frame_id, s.s.i AS reg_id, CASE WHEN isfinite(s.s.dx) THEN s.s.dx END AS dx, CASE WHEN isfinite(s.s.dy) THEN s.s.dy END AS dy, v.visit_dx, v.visit_dy,
  coalesce(CASE WHEN isfinite(s.s.dx) THEN s.s.dx END, 0) + coalesce(v.visit_dx, 0) AS total_dx, coalesce(CASE WHEN isfinite(s.s.dy) THEN s.s.dy END, 0) + coalesce(v.visit_dy, 0) AS total_dy, s.filename IS NOT NULL AS is_solved
FROM f LEFT JOIN s USING (filename) LEFT JOIN v ON v.field = regexp_extract(f.filename, '^(jw[0-9]{8})', 1) AND v.visit = f.visit""")
def frame_solutions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every frame with the latest solution of its file and the correction of its visit; a frame without either is not moved by it."""
    r = table(spark, sf_dir, "frame_registrations")
    field = F.regexp_extract("filename", "^(jw[0-9]{8})", 1).alias("field")
    last = r.groupBy("filename").agg(F.max_by(F.struct("reg_id", "dx", "dy"), F.struct("solved_at", "reg_id")).alias("s")).select("filename", "s.*", F.lit(True).alias("there"))
    v = r.select("reg_id", field, "visit", robust.finite(F.col("visit_dx")).alias("visit_dx"), robust.finite(F.col("visit_dy")).alias("visit_dy")).distinct().filter("visit_dx IS NOT NULL AND visit_dy IS NOT NULL")
    v = v.groupBy("field", "visit").agg(F.median("visit_dx").alias("visit_dx"), F.median("visit_dy").alias("visit_dy"))
    f = table(spark, sf_dir, "frames").select("frame_id", "filename", "visit", field).distinct()
    j = f.join(last, "filename", "left").join(v, ["field", "visit"], "left").withColumns({c: robust.finite(F.col(c)) for c in ("dx", "dy")})
    total = lambda c: F.coalesce(c, F.lit(0.0)) + F.coalesce(f"visit_{c}", F.lit(0.0))
    return j.select("frame_id", "reg_id", "dx", "dy", "visit_dx", "visit_dy", total("dx").alias("total_dx"), total("dy").alias("total_dy"), F.coalesce("there", F.lit(False)).alias("is_solved"))


@query("""SELECT DISTINCT frame_id, upper(trim(filter_name)) IN ('F444W', 'F200W', 'F335M') AS any_pupil, coalesce(upper(trim(filter_name)) IN ('F444W', 'F200W') AND upper(trim(coalesce(pupil, 'CLEAR'))) IN ('CLEAR', 'F405N'), false) AS named_pupil FROM frames WHERE filter_name IS NOT NULL""")
def filter_specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames asked for by filters alone, and by filters of which some name a pupil."""
    f = table(spark, sf_dir, "frames").filter("filter_name IS NOT NULL")
    a = planning.of_specs(F.col("filter_name"), F.col("pupil"), ["F444W", "f200w ", "F335M"])
    b = planning.of_specs(F.col("filter_name"), F.col("pupil"), ["F444W;F405N", "F200W; clear"])
    return f.select("frame_id", a.alias("any_pupil"), b.alias("named_pupil")).distinct()


# -- frames on their field's grid ----------------------------------------------------------------------------

SIDE, GRID, PAD, EDGE, TILE = 2048, 8192, 8, 17, 2048
CRPIX_X, CRPIX_Y = 4096.3, 4095.7  # the grid's reference pixel, at its tangent point

_FRAMES = """f AS (SELECT DISTINCT frame_id, exposure, regexp_extract(lower(filename), '^(jw[0-9]{8})', 1) AS field, radians(ra_deg) AS lon, radians(dec_deg) AS lat, radians(pixscale_arcsec / 3600) AS s FROM frames
  WHERE isfinite(ra_deg) AND isfinite(dec_deg) AND abs(dec_deg) <= 90 AND isfinite(pixscale_arcsec) AND pixscale_arcsec > 0),
g AS (SELECT field, lon AS lon0, lat AS lat0, s AS s0 FROM f QUALIFY row_number() OVER (PARTITION BY field ORDER BY exposure, frame_id) = 1),
e AS (SELECT px, py FROM (SELECT unnest(range(17)) * 2047 / 16.0::double AS px) a, (SELECT unnest(range(17)) * 2047 / 16.0::double AS py) b WHERE px IN (0, 2047) OR py IN (0, 2047)),
t AS (SELECT f.*, lon0, lat0, s0, (px - 1023.5::double) * s AS xi, (py - 1023.5::double) * s AS eta FROM f JOIN g USING (field) CROSS JOIN e),
w AS (SELECT *, cos(lat) - eta * sin(lat) AS down FROM t),
k AS (SELECT *, lon + atan2(xi, down) AS l, atan2(sin(lat) + eta * cos(lat), sqrt(xi * xi + down * down)) AS b FROM w),
c AS (SELECT *, sin(lat0) * sin(b) + cos(lat0) * cos(b) * cos(l - lon0) AS c FROM k),
p AS (SELECT frame_id, field, cos(b) * sin(l - lon0) / c / s0 + 4096.3::double AS gx, (cos(lat0) * sin(b) - sin(lat0) * cos(b) * cos(l - lon0)) / c / s0 + 4095.7::double AS gy FROM c WHERE c > 0),
bx AS (SELECT frame_id, field, greatest(CAST(floor(min(gx)) AS BIGINT) - 8, 0) AS x0, least(CAST(ceil(max(gx)) AS BIGINT) + 9, 8192) AS x1, greatest(CAST(floor(min(gy)) AS BIGINT) - 8, 0) AS y0, least(CAST(ceil(max(gy)) AS BIGINT) + 9, 8192) AS y1
  FROM p GROUP BY frame_id, field HAVING count(*) >= 3)"""


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    ok = (F.abs("dec_deg") <= 90.0) & (F.abs("ra_deg") < float("inf")) & (F.col("pixscale_arcsec") > 0) & (F.col("pixscale_arcsec") < float("inf"))
    f = table(spark, sf_dir, "frames").filter(ok).select(
        "frame_id", "exposure", F.regexp_extract(F.lower("filename"), "^(jw[0-9]{8})", 1).alias("field"), F.radians("ra_deg").alias("lon"), F.radians("dec_deg").alias("lat"), F.radians(F.col("pixscale_arcsec") / 3600).alias("s"),
    ).distinct()
    grid = f.groupBy("field").agg(F.min_by(F.struct(F.col("lon").alias("lon0"), F.col("lat").alias("lat0"), F.col("s").alias("s0")), F.struct("exposure", "frame_id")).alias("g")).select("field", "g.*")
    step = (SIDE - 1) / (EDGE - 1)
    edge = [(i * step, j * step) for i in range(EDGE) for j in range(EDGE) if i in (0, EDGE - 1) or j in (0, EDGE - 1)]
    e = f.join(grid, "field").withColumn("e", F.explode(F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in edge])))
    xi, eta = (F.col("e.x") - (SIDE - 1) / 2) * F.col("s"), (F.col("e.y") - (SIDE - 1) / 2) * F.col("s")
    lon, lat = images.tan_sky(xi, eta, F.col("lon"), F.col("lat"))
    e = e.select("frame_id", "field", "lon0", "lat0", "s0", lon.alias("l"), lat.alias("b"))
    u, v = images.tan_plane(F.col("l"), F.col("b"), F.col("lon0"), F.col("lat0"))
    p = e.select("frame_id", "field", (u / F.col("s0") + CRPIX_X).alias("gx"), (v / F.col("s0") + CRPIX_Y).alias("gy")).filter("gx IS NOT NULL")
    low = lambda c: F.greatest(F.floor(F.min(c)).cast("bigint") - PAD, F.lit(0))
    high = lambda c: F.least(F.ceil(F.max(c)).cast("bigint") + 1 + PAD, F.lit(GRID))
    b = p.groupBy("frame_id", "field").agg(F.count("*").alias("n"), low("gx").alias("x0"), high("gx").alias("x1"), low("gy").alias("y0"), high("gy").alias("y1"))
    return b.filter("n >= 3").drop("n")


@query(f"WITH {_FRAMES} SELECT * FROM bx WHERE x1 > x0 AND y1 > y0")
def frame_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each frame's pixel box on its field's north-up grid: 64 samples of its edge before the tangent point, padded, clamped to the grid."""
    return _boxes(spark, sf_dir).filter("x1 > x0 AND y1 > y0")


@query(f"""WITH {_FRAMES}, ty AS (SELECT unnest(range(4)) AS ty), tx AS (SELECT unnest(range(4)) AS tx), fl AS (SELECT DISTINCT field FROM f),
q AS (SELECT field, frame_id, x0, x1, y0, y1, ty, tx FROM bx JOIN ty ON y0 < (ty + 1) * 2048 AND y1 > ty * 2048 JOIN tx ON x0 < (tx + 1) * 2048 AND x1 > tx * 2048 WHERE x1 > x0 AND y1 > y0),
n AS (SELECT field, ty, tx, count(*) AS frames, CAST(sum((least(x1, (tx + 1) * 2048) - greatest(x0, tx * 2048)) * (least(y1, (ty + 1) * 2048) - greatest(y0, ty * 2048))) AS BIGINT) AS pixels FROM q GROUP BY ALL)
SELECT fl.field, ty.ty, tx.tx, 4096.3::double - tx.tx * 2048 AS crpix_x, 4095.7::double - ty.ty * 2048 AS crpix_y, coalesce(frames, 0) AS frames, coalesce(pixels, 0) AS pixels
FROM fl CROSS JOIN ty CROSS JOIN tx LEFT JOIN n ON n.field = fl.field AND n.ty = ty.ty AND n.tx = tx.tx""")
def grid_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tile of each field's grid, row by row, with its own reference pixel, the frames it loads and their pixels in it."""
    b = _boxes(spark, sf_dir)
    fields = table(spark, sf_dir, "frames").filter((F.abs("dec_deg") <= 90.0) & (F.abs("ra_deg") < float("inf")) & (F.col("pixscale_arcsec") > 0) & (F.col("pixscale_arcsec") < float("inf")))
    fields = fields.select(F.regexp_extract(F.lower("filename"), "^(jw[0-9]{8})", 1).alias("field")).distinct()
    k = F.explode(F.sequence(F.lit(0), F.lit(GRID // TILE - 1)))
    tiles = fields.withColumn("ty", k).withColumn("tx", k)
    at = planning.tiles_touched(b, TILE)
    side = lambda c: F.least(F.col(f"{c}1"), (F.col(f"t{c}") + 1) * TILE) - F.greatest(F.col(f"{c}0"), F.col(f"t{c}") * TILE)
    n = at.groupBy("field", "ty", "tx").agg(F.count("*").alias("frames"), F.sum(side("x") * side("y")).alias("pixels"))
    j = tiles.join(n, ["field", "ty", "tx"], "left")
    return j.select("field", "ty", "tx", (F.lit(CRPIX_X) - F.col("tx") * TILE).alias("crpix_x"), (F.lit(CRPIX_Y) - F.col("ty") * TILE).alias("crpix_y"), F.coalesce("frames", F.lit(0)).alias("frames"), F.coalesce("pixels", F.lit(0)).alias("pixels"))


# -- build: register, move, combine --------------------------------------------------------------------------

CELL, RADIUS, CELLS_A_TILE = 64.0, 10.0, 32

_BUILD = f"""WITH {STARS_SQL}, s AS (SELECT mosaic_key AS grp, CAST(star_id % 4 AS INTEGER) AS frame, star_id AS id, x, y, flux, CAST(floor(x / 10) AS BIGINT) AS cx, CAST(floor(y / 10) AS BIGINT) AS cy FROM stars),
n1 AS (SELECT *, unnest([-1, 0, 1]) AS ox FROM s WHERE frame = 0), n2 AS (SELECT *, unnest([-1, 0, 1]) AS oy FROM n1),
pr AS (SELECT a.grp, a.frame, a.id AS a_id, b.id AS b_id, b.x - a.x AS dx, b.y - a.y AS dy, (b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y) AS d2 FROM s a JOIN n2 b ON a.grp = b.grp AND a.cx = b.cx + b.ox AND a.cy = b.cy + b.oy WHERE a.frame > 0),
nn AS (SELECT * FROM pr WHERE d2 <= 100.0 QUALIFY row_number() OVER (PARTITION BY grp, a_id ORDER BY d2, b_id) = 1),
tr AS (SELECT grp, frame, median(dx) AS dx, median(dy) AS dy FROM nn GROUP BY ALL UNION ALL SELECT grp, 0, 0, 0 FROM (SELECT DISTINCT grp FROM s)),
px AS (SELECT grp, frame, CAST(floor(y / 64.0::double) AS BIGINT) AS y, CAST(floor(x / 64.0::double) AS BIGINT) AS x, max(flux) AS v FROM s WHERE isfinite(flux) GROUP BY ALL),
m AS (SELECT px.*, -dy / 64.0::double AS uy, -dx / 64.0::double AS ux FROM px JOIN tr USING (grp, frame)),
tp AS (SELECT *, unnest([0, 1]) AS i FROM (SELECT *, unnest([0, 1]) AS j FROM m)),
mv AS (SELECT grp, frame, y - CAST(floor(uy) AS BIGINT) - j AS y, x - CAST(floor(ux) AS BIGINT) - i AS x, round(sum(v * (CASE j WHEN 1 THEN uy - floor(uy) ELSE 1 - (uy - floor(uy)) END) * (CASE i WHEN 1 THEN ux - floor(ux) ELSE 1 - (ux - floor(ux)) END)), 9) AS v FROM tp GROUP BY ALL HAVING count(*) = 4),
"""


def _frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stars of each mosaic as four exposures of it."""
    return stars(spark, sf_dir, "flux").select(F.col("mosaic_key").alias("grp"), (F.col("star_id") % 4).cast("int").alias("frame"), F.col("star_id").alias("id"), "x", "y", robust.finite(F.col("flux")).alias("flux"))


@query(_BUILD + clip_sql("mv", "grp, y, x", "3.0", 3) + """ SELECT grp, CAST(floor(y / 32) AS BIGINT) AS ty, CAST(floor(x / 32) AS BIGINT) AS tx, y, x, count(v) AS coverage, count(k) AS kept, round(median(k), 6) AS value FROM c3 GROUP BY grp, y, x""")
def mosaic_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mosaic from its exposures: each is matched with the first one, moved by the median shift and combined pixel by pixel with clipping.

    The exposures' pixels are the brightest star of each cell. ``ty``, ``tx`` is the tile that owns a pixel.
    """
    s = written(_frames(spark, sf_dir), "exposures")
    key = lambda frame: F.concat_ws(":", "grp", frame.cast("string")).alias("grp")
    others = s.filter("frame > 0").select(key(F.col("frame")), "id", "x", "y")
    first = s.filter("frame = 0").withColumn("k", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3)))).select(key(F.col("k")), "id", "x", "y")
    t = matching.translation(matching.nearest(others, first, RADIUS)).select(F.regexp_extract("grp", "^(.*):[0-9]$", 1).alias("grp"), F.substring_index("grp", ":", -1).cast("int").alias("frame"), (F.col("dy") / CELL).alias("sy"), (F.col("dx") / CELL).alias("sx"))
    still = s.select("grp").distinct().select("grp", F.lit(0).alias("frame"), F.lit(0.0).alias("sy"), F.lit(0.0).alias("sx"))
    cell = lambda c: F.floor(F.col(c) / CELL).cast("bigint").alias(c)
    px = s.filter("flux IS NOT NULL").groupBy("grp", "frame", cell("y"), cell("x")).agg(F.max("flux").alias("v"))
    m = images.moved(px, t.unionByName(still)).withColumn("v", F.round("v", 9))
    tile = lambda c: F.floor(F.col(c) / CELLS_A_TILE).cast("bigint").alias(f"t{c}")
    return robust.stacked(m, ["grp", "y", "x"], "v").select("grp", tile("y"), tile("x"), "y", "x", "coverage", "kept", F.round("value", 6).alias("value"))


@query(f"""WITH {STARS_SQL}, px AS (SELECT mosaic_key AS grp, CAST(floor(y / 16.0::double) AS BIGINT) AS y, CAST(floor(x / 16.0::double) AS BIGINT) AS x, max(flux) FILTER (star_id % 2 = 1) AS a, max(flux) FILTER (star_id % 2 = 0) AS b FROM stars WHERE isfinite(flux) GROUP BY ALL),
d AS (SELECT grp, CAST(floor(y / 32) AS BIGINT) AS ty, CAST(floor(x / 32) AS BIGINT) AS tx, b - a AS d FROM px WHERE a IS NOT NULL AND b IS NOT NULL),
m AS (SELECT *, median(d) OVER w AS med FROM d WINDOW w AS (PARTITION BY grp, ty, tx)), s AS (SELECT *, 1.4826::double * median(abs(d - med)) OVER w AS s FROM m WINDOW w AS (PARTITION BY grp, ty, tx)),
k AS (SELECT *, abs(d - med) < 3.0::double * greatest(s, 1e-12::double) AS ok FROM s)
SELECT grp, ty, tx, count(*) AS n, any_value(med) AS median_diff, any_value(s) AS mad_diff, count(*) FILTER (ok) AS n_clean, round(avg(d) FILTER (ok), 6) AS clean_mean, round(sqrt(avg(d * d) FILTER (ok)), 6) AS clean_rms FROM k GROUP BY grp, ty, tx""")
def tile_diff_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two images of each mosaic (odd and even stars) on the pixels both have: per tile their difference, whole and within 3 MADs of the tile's median."""
    s = stars(spark, sf_dir, "flux").withColumn("flux", robust.finite(F.col("flux"))).filter("flux IS NOT NULL")
    cell = lambda c: F.floor(F.col(c) / 16.0).cast("bigint").alias(c)
    of = lambda odd: F.max(F.when(F.col("star_id") % 2 == odd, F.col("flux")))
    px = s.groupBy(F.col("mosaic_key").alias("grp"), cell("y"), cell("x")).agg(of(1).alias("a"), of(0).alias("b")).filter("a IS NOT NULL AND b IS NOT NULL")
    d = px.select("grp", F.floor(F.col("y") / 32).cast("bigint").alias("ty"), F.floor(F.col("x") / 32).cast("bigint").alias("tx"), (F.col("b") - F.col("a")).alias("d"))
    w = Window.partitionBy("grp", "ty", "tx")  # at most 1,024 pixels
    d = d.withColumn("med", F.median("d").over(w)).withColumn("s", F.lit(1.4826) * F.median(F.abs(F.col("d") - F.col("med"))).over(w))
    ok = F.when(F.abs(F.col("d") - F.col("med")) < 3.0 * F.greatest("s", F.lit(1e-12)), F.col("d"))
    return d.groupBy("grp", "ty", "tx").agg(
        F.count("*").alias("n"), F.first("med").alias("median_diff"), F.first("s").alias("mad_diff"), F.count(ok).alias("n_clean"), F.round(F.avg(ok), 6).alias("clean_mean"), F.round(F.sqrt(F.avg(ok * ok)), 6).alias("clean_rms"),
    )


_CELLS_SQL = f"WITH {STARS_SQL}, im AS (SELECT mosaic_key AS grp, CAST(floor(y / 16.0::double) AS BIGINT) AS y, CAST(floor(x / 16.0::double) AS BIGINT) AS x, max(flux) AS v FROM stars WHERE isfinite(flux) GROUP BY ALL),\n"

# the sources of an image im (grp, y, x, v)
SOURCES_SQL = """l AS (SELECT *, median(v) OVER (PARTITION BY grp) AS level FROM im), q AS (SELECT *, greatest(v - level, 0) AS up, median(abs(v - level)) OVER (PARTITION BY grp) AS mad FROM l),
h AS (SELECT grp, y AS py, x AS px, v AS pv FROM q WHERE v > level + 5.0::double * 1.4826::double * mad), o AS (SELECT *, unnest([-1, 0, 1]) AS i FROM (SELECT *, unnest([-1, 0, 1]) AS j FROM h)),
c AS (SELECT o.grp, py, px, pv, q.v, up, q.y - py AS dy, q.x - px AS dx, q.v > pv OR (q.v = pv AND (q.y < py OR (q.y = py AND q.x < px))) AS beats FROM o JOIN q ON q.grp = o.grp AND q.y = py + j AND q.x = px + i),
m AS (SELECT grp, py, px, any_value(pv) AS v, count(*) AS n, bool_or(beats) AS beaten, sum(up * dy) / sum(up) AS my, sum(up * dx) / sum(up) AS mx, sum(up * (dy * dy + dx * dx)) / sum(up) AS r FROM c GROUP BY ALL)
SELECT grp, py AS y, px AS x, v, n, round(py + my, 6) AS cy, round(px + mx, 6) AS cx, round(sqrt(greatest(r - my * my - mx * mx, 0)), 6) AS width FROM m WHERE NOT beaten"""


@query(_CELLS_SQL + SOURCES_SQL)
def detect_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources of each mosaic's image: cells far above its median that outshine their neighbours, with centroid and width from moments."""
    return rounded_sources(written(cells(spark, sf_dir), "image"))


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole image of each mosaic, counted from the mosaic's own zero."""
    im = whole_image(spark, sf_dir)
    return im.select("grp", (F.col("y") + F.col("y0")).alias("y"), (F.col("x") + F.col("x0")).alias("x"), "v")


def rounded_sources(image: DataFrame) -> DataFrame:
    r: Callable[[str], Column] = lambda c: F.round(c, 6).alias(c)
    return images.sources(image).select("grp", "y", "x", "v", "n", r("cy"), r("cx"), r("width"))
