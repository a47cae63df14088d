"""Queries of robust stacking, matching, registration and gauges, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skyloom.functions import robust
from skyloom.operators import graphs, matching
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


def clip_sql(source: str, keys: str, sigma: str, rounds: int, width: str = "mad", least: int = 3) -> str:
    """CTEs c0.. of the clip rounds over ``source`` (keys, v): the last one has column k."""
    out = [f"c0 AS (SELECT *, count(v) OVER (PARTITION BY {keys}) AS n_all, v AS k FROM {source})"]
    for i in range(rounds):
        mid = f"median(k) OVER (PARTITION BY {keys})"
        spread = f"1.482602218505602::double * median(abs(k - m)) OVER (PARTITION BY {keys})" if width == "mad" else f"stddev_pop(k) OVER (PARTITION BY {keys})"
        out.append(f"m{i} AS (SELECT *, {mid} AS m FROM c{i})")
        out.append(f"s{i} AS (SELECT *, {spread} AS s FROM m{i})")
        out.append(f"c{i + 1} AS (SELECT * EXCLUDE (m, s, k), CASE WHEN n_all < {least} OR (k >= m - {sigma}::double * s AND k <= m + {sigma}::double * s) THEN k END AS k FROM s{i})")
    return ",\n".join(out)


# -- stacks -----------------------------------------------------------------------------------------

_PIXELS = "src AS (SELECT l_orderkey AS pixel, l_extendedprice AS v FROM lineitem)"


@query(f"WITH {_PIXELS}, {clip_sql('src', 'pixel', '1.5', 3)} SELECT pixel, count(v) AS coverage, count(k) AS kept, median(k) AS value FROM c3 GROUP BY pixel")
def stack_sigma_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("pixel"), "l_extendedprice")
    return robust.stacked(rows, ["pixel"], "l_extendedprice", sigma=1.5)


@query(f"WITH {_PIXELS}, {clip_sql('src', 'pixel', '1.5', 3)} SELECT pixel, count(v) AS coverage, count(k) AS kept, round(avg(k), 6) AS value FROM c3 GROUP BY pixel")
def stack_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("pixel"), "l_extendedprice")
    return robust.stacked(rows, ["pixel"], "l_extendedprice", sigma=1.5, mean=True).withColumn("value", F.round("value", 6))


def stars(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Each star once, with a finite position and these columns of it: no others are read or shuffled."""
    rows = table(spark, sf_dir, "star_fits").select("star_id", "mosaic_key", "x", "y", *columns).distinct()
    return rows.withColumn("x", robust.finite(F.col("x"))).withColumn("y", robust.finite(F.col("y"))).filter("x IS NOT NULL AND y IS NOT NULL AND mosaic_key IS NOT NULL")


STARS_SQL = "stars AS (SELECT DISTINCT * EXCLUDE (loaded_at) FROM star_fits WHERE isfinite(x) AND isfinite(y) AND mosaic_key IS NOT NULL)"


@query(f"""WITH {STARS_SQL}, src AS (SELECT mosaic_key, CAST(floor(x / 64) AS BIGINT) AS cx, CAST(floor(y / 64) AS BIGINT) AS cy, CASE WHEN isfinite(flux) THEN flux END AS v FROM stars),
{clip_sql("src", "mosaic_key, cx, cy", "3.0", 3)} SELECT mosaic_key, cx, cy, count(v) AS coverage, count(k) AS kept, median(k) AS value FROM c3 GROUP BY ALL""")
def stack_star_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    cell = stars(spark, sf_dir, "flux").select("mosaic_key", F.floor(F.col("x") / 64).cast("bigint").alias("cx"), F.floor(F.col("y") / 64).cast("bigint").alias("cy"), robust.finite(F.col("flux")).alias("flux"))
    return robust.stacked(cell, ["mosaic_key", "cx", "cy"], "flux")


@query("""WITH m AS (SELECT l_suppkey AS k, l_extendedprice AS v, median(l_extendedprice) OVER (PARTITION BY l_suppkey) AS med FROM lineitem)
SELECT k, count(v) AS n, any_value(med) AS med, 1.4826::double * median(abs(v - med)) AS sigma FROM m GROUP BY k""")
def mad_sigma(spark: SparkSession, sf_dir: str) -> DataFrame:
    return robust.mad_sigma(table(spark, sf_dir, "lineitem").withColumnRenamed("l_suppkey", "k"), ["k"], "l_extendedprice")


_REGS = """regs AS (SELECT DISTINCT * EXCLUDE (loaded_at) FROM frame_registrations WHERE NOT coalesce(is_reference, false)),
rms AS (SELECT group_key, CASE WHEN isfinite(residual_rms_px) THEN residual_rms_px END AS v FROM regs)"""


def registrations(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Each measurement once, with these columns of it."""
    rows = table(spark, sf_dir, "frame_registrations").filter(~F.coalesce("is_reference", F.lit(False)))
    return rows.select("reg_id", *columns).distinct()


@query(f"WITH {_REGS}, {clip_sql('rms', 'group_key', '3.0', 1)} SELECT group_key, count(v) AS n, count(k) AS kept, median(k) AS med FROM c1 GROUP BY group_key")
def mad_clip_one_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = registrations(spark, sf_dir, "group_key", "residual_rms_px").select("group_key", robust.finite(F.col("residual_rms_px")).alias("v"))
    return robust.clipped(rows, ["group_key"], "v", 3.0, 1).groupBy("group_key").agg(F.count("v").alias("n"), F.count("_kept").alias("kept"), F.median("_kept").alias("med"))


@query(f"""WITH regs AS (SELECT DISTINCT * EXCLUDE (loaded_at) FROM frame_registrations), src AS (SELECT group_key, CASE WHEN isfinite(background_offset) THEN background_offset END AS v FROM regs),
{clip_sql("src", "group_key", "3.0", 3, "std")} SELECT group_key, count(k) AS kept, median(k) AS background FROM c3 GROUP BY group_key""")
def background_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "frame_registrations").select("reg_id", "group_key", "background_offset").distinct().select("group_key", robust.finite(F.col("background_offset")).alias("v"))
    return robust.clipped(rows, ["group_key"], "v", 3.0, 3, "std").groupBy("group_key").agg(F.count("_kept").alias("kept"), F.median("_kept").alias("background"))


@query(f"""WITH {STARS_SQL}, src AS (SELECT mosaic_key, CASE WHEN isfinite(fwhm_px) THEN fwhm_px END AS v, axis_ratio FROM stars), {clip_sql("src", "mosaic_key", "3.0", 3, "std", 4)},
d AS (SELECT *, median(k) OVER (PARTITION BY mosaic_key) AS mid FROM c3)
SELECT mosaic_key, count(v) AS n, count(k) AS kept, any_value(mid) AS fwhm_px, 1.4826::double * median(abs(k - mid)) AS scatter_px, median(CASE WHEN k IS NOT NULL THEN axis_ratio END) AS axis_ratio FROM d GROUP BY mosaic_key""")
def fwhm_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stars(spark, sf_dir, "fwhm_px", "axis_ratio").select("mosaic_key", robust.finite(F.col("fwhm_px")).alias("v"), "axis_ratio")
    c = written(robust.clipped_large(rows, ["mosaic_key"], "v", 3.0, 3, 4).withColumn("axis_ratio", F.when(F.col("_kept").isNotNull(), F.col("axis_ratio"))), "kept")
    mid = robust.group_percentiles(c, ["mosaic_key"], {"fwhm_px": ("_kept", 0.5), "axis_ratio": ("axis_ratio", 0.5)})
    off = c.join(mid.select("mosaic_key", "fwhm_px"), "mosaic_key").withColumn("off", F.abs(F.col("_kept") - F.col("fwhm_px")))
    mad = robust.group_percentiles(off, ["mosaic_key"], {"mad": ("off", 0.5)})
    n = c.groupBy("mosaic_key").agg(F.count("v").alias("n"), F.count("_kept").alias("kept"))
    return n.join(mid, "mosaic_key", "left").join(mad, "mosaic_key", "left").select("mosaic_key", "n", "kept", "fwhm_px", (F.lit(1.4826) * F.col("mad")).alias("scatter_px"), "axis_ratio")


@query(f"""WITH {STARS_SQL}, t AS (SELECT mosaic_key, floor(x / 512) AS tx, floor(y / 512) AS ty, CASE WHEN isfinite(pedestal) THEN pedestal END AS v FROM stars),
m AS (SELECT *, median(v) OVER w AS c FROM t WINDOW w AS (PARTITION BY mosaic_key, tx, ty)),
s AS (SELECT *, 1.4826::double * median(abs(v - c)) OVER w AS s FROM m WINDOW w AS (PARTITION BY mosaic_key, tx, ty)),
k AS (SELECT *, CASE WHEN s = 0 OR abs(v - c) <= 3.0::double * s THEN v END AS k FROM s),
l AS (SELECT mosaic_key, tx, ty, CASE WHEN count(k) >= 16 THEN median(k) ELSE median(v) END AS level FROM k GROUP BY ALL)
SELECT mosaic_key, count(level) AS tiles, median(level) AS level FROM l GROUP BY mosaic_key""")
def source_free_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per mosaic the median of its tiles' pedestal levels; a tile is clipped once where at least 16 values survive."""
    t = stars(spark, sf_dir, "pedestal").select("mosaic_key", F.floor(F.col("x") / 512).alias("tx"), F.floor(F.col("y") / 512).alias("ty"), robust.finite(F.col("pedestal")).alias("v"))
    w = Window.partitionBy("mosaic_key", "tx", "ty")
    t = t.withColumn("c", F.median("v").over(w)).withColumn("s", F.lit(1.4826) * F.median(F.abs(F.col("v") - F.col("c"))).over(w))
    t = t.withColumn("k", F.when((F.col("s") == 0) | (F.abs(F.col("v") - F.col("c")) <= 3.0 * F.col("s")), F.col("v")))
    level = t.groupBy("mosaic_key", "tx", "ty").agg(F.when(F.count("k") >= 16, F.median("k")).otherwise(F.median("v")).alias("level"))
    return level.groupBy("mosaic_key").agg(F.count("level").alias("tiles"), F.median("level").alias("level"))


# -- matches ----------------------------------------------------------------------------------------

RADIUS = 10.0


def catalogues(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The stars of each mosaic in two catalogues, odd ids and even ids."""
    s = stars(spark, sf_dir).select(F.col("mosaic_key").alias("grp"), F.col("star_id").alias("id"), "x", "y")
    return s.filter("id % 2 = 1"), s.filter("id % 2 = 0")


_PAIRS = f"""WITH {STARS_SQL},
c AS (SELECT mosaic_key AS grp, star_id AS id, x, y, CAST(floor(x / 10) AS BIGINT) AS cx, CAST(floor(y / 10) AS BIGINT) AS cy, filter_name, flux FROM stars),
b1 AS (SELECT *, unnest([-1, 0, 1]) AS ox FROM c WHERE id % 2 = 0), b2 AS (SELECT *, unnest([-1, 0, 1]) AS oy FROM b1),
pr AS (SELECT a.grp, a.id AS a_id, b.id AS b_id, b.x - a.x AS dx, b.y - a.y AS dy, a.filter_name, a.flux AS fa, b.flux AS fb,
        (b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y) AS d2
      FROM c a JOIN b2 b ON a.grp = b.grp AND a.cx = b.cx + b.ox AND a.cy = b.cy + b.oy WHERE a.id % 2 = 1),
p AS (SELECT * FROM pr WHERE d2 <= 100.0),
n AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY grp, a_id ORDER BY d2, b_id) = 1),
r AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY grp, b_id ORDER BY d2, a_id) = 1),
g AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY grp, b_id ORDER BY d2, a_id) = 1)
"""


@query(_PAIRS + "SELECT grp, a_id, b_id, dx, dy, d2 FROM n")
def nearest_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.nearest(*catalogues(spark, sf_dir), RADIUS)


@query(_PAIRS + "SELECT n.grp, n.a_id, n.b_id, n.dx, n.dy, n.d2 FROM n JOIN r ON n.grp = r.grp AND n.a_id = r.a_id AND n.b_id = r.b_id")
def mutual_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.mutual_nearest(*catalogues(spark, sf_dir), RADIUS)


@query(_PAIRS + "SELECT grp, a_id, b_id, dx, dy, d2 FROM g")
def greedy_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.one_to_one(*catalogues(spark, sf_dir), RADIUS)


@query(_PAIRS + "SELECT c.grp, c.id AS a_id, coalesce(sqrt(n.d2), 'inf'::double) AS distance FROM c LEFT JOIN n ON c.grp = n.grp AND c.id = n.a_id WHERE c.id % 2 = 1")
def nearest_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.nearest_distance(*catalogues(spark, sf_dir), RADIUS)


_SHIFT = """, w AS (SELECT *, median(dx) OVER (PARTITION BY grp) AS mx, median(dy) OVER (PARTITION BY grp) AS my FROM n)
SELECT grp, count(*) AS n, any_value(mx) AS dx, any_value(my) AS dy, round(sqrt(avg((dx - mx) * (dx - mx) + (dy - my) * (dy - my))), 9) AS residual_rms,
  round(sqrt(max((dx - mx) * (dx - mx) + (dy - my) * (dy - my))), 9) AS residual_max FROM w GROUP BY grp"""


@query(_PAIRS + _SHIFT)
def translation_solve(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = matching.translation(matching.nearest(*catalogues(spark, sf_dir), RADIUS))
    return t.withColumn("residual_rms", F.round("residual_rms", 9)).withColumn("residual_max", F.round("residual_max", 9))


@query(_PAIRS + """, w AS (SELECT filter_name, dx, dy, sqrt(d2) AS d, median(dx) OVER (PARTITION BY filter_name) AS mx, median(dy) OVER (PARTITION BY filter_name) AS my FROM n)
SELECT filter_name AS channel, count(*) AS n, any_value(mx) AS dx, any_value(my) AS dy, median(d) AS raw_distance, round(avg(CASE WHEN d <= 0.5 THEN 1.0 ELSE 0.0 END), 9) AS within,
  sqrt(any_value(mx) * any_value(mx) + any_value(my) * any_value(my)) < 0.25 AS negligible FROM w GROUP BY filter_name""")
def cross_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per filter the shift of its stars' nearest matches, and whether it is negligible."""
    a, b = catalogues(spark, sf_dir)
    names = stars(spark, sf_dir, "filter_name").select(F.col("star_id").alias("a_id"), "filter_name")
    m = written(matching.nearest(a, b, RADIUS).join(names, "a_id").select("filter_name", "dx", "dy", F.sqrt("d2").alias("d")), "matches")
    n = m.groupBy("filter_name").agg(F.count("*").alias("n"), F.round(F.avg((F.col("d") <= 0.5).cast("double")), 9).alias("within"))
    p = robust.group_percentiles(m, ["filter_name"], {"dx": ("dx", 0.5), "dy": ("dy", 0.5), "raw_distance": ("d", 0.5)})
    small = F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")) < 0.25
    return n.join(p, "filter_name").select(F.col("filter_name").alias("channel"), "n", "dx", "dy", "raw_distance", "within", small.alias("negligible"))


@query(_PAIRS + """, d AS (SELECT filter_name, sqrt(d2) AS d, median(sqrt(d2)) OVER (PARTITION BY filter_name) AS med FROM g)
SELECT filter_name, count(*) AS n, any_value(med) AS median_px, round(sqrt(avg(d * d)), 9) AS rms_px, quantile_cont(d, 0.16) AS p16_px, quantile_cont(d, 0.84) AS p84_px,
  1.4826::double * median(abs(d - med)) AS mad_sigma_px, round(avg(CASE WHEN d <= 0.5 THEN 1.0 ELSE 0.0 END), 9) AS within FROM d GROUP BY filter_name""")
def star_offset_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = stars(spark, sf_dir, "filter_name").select(F.col("star_id").alias("a_id"), "filter_name")
    m = written(matching.one_to_one(*catalogues(spark, sf_dir), RADIUS).join(names, "a_id").select("filter_name", F.sqrt("d2").alias("d")), "matches")
    p = robust.group_percentiles(m, ["filter_name"], {"median_px": ("d", 0.5), "p16_px": ("d", 0.16), "p84_px": ("d", 0.84)})
    off = m.join(p, "filter_name").select("filter_name", F.abs(F.col("d") - F.col("median_px")).alias("off"))
    mad = robust.group_percentiles(off, ["filter_name"], {"mad": ("off", 0.5)})
    n = m.groupBy("filter_name").agg(F.count("*").alias("n"), F.round(F.sqrt(F.avg(F.col("d") * F.col("d"))), 9).alias("rms_px"), F.round(F.avg((F.col("d") <= 0.5).cast("double")), 9).alias("within"))
    return n.join(p, "filter_name").join(mad, "filter_name").withColumn("mad_sigma_px", F.lit(1.4826) * F.col("mad")).drop("mad")


@query(_PAIRS + """, d AS (SELECT filter_name, fb - fa AS d FROM g WHERE isfinite(fa) AND isfinite(fb)),
m AS (SELECT *, median(d) OVER (PARTITION BY filter_name) AS med FROM d), s AS (SELECT *, 1.4826::double * median(abs(d - med)) OVER (PARTITION BY filter_name) AS s FROM m)
SELECT filter_name, count(*) AS n, any_value(med) AS median_diff, round(avg(d), 6) AS mean_diff, round(sqrt(avg(d * d)), 6) AS rms_diff, any_value(s) AS mad_diff,
  quantile_cont(d, 0.01) AS p1, quantile_cont(d, 0.99) AS p99, count(*) FILTER (abs(d - med) < 3.0::double * greatest(s, 1e-12::double)) AS n_clean,
  round(avg(d) FILTER (abs(d - med) < 3.0::double * greatest(s, 1e-12::double)), 6) AS clean_mean FROM s GROUP BY filter_name""")
def diff_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flux differences of matched stars, whole and without the outlying ones."""
    f = stars(spark, sf_dir, "filter_name", "flux").select("star_id", "filter_name", robust.finite(F.col("flux")).alias("flux"))
    m = matching.one_to_one(*catalogues(spark, sf_dir), RADIUS)
    m = m.join(f.select(F.col("star_id").alias("a_id"), "filter_name", F.col("flux").alias("fa")), "a_id").join(f.select(F.col("star_id").alias("b_id"), F.col("flux").alias("fb")), "b_id")
    d = written(m.select("filter_name", (F.col("fb") - F.col("fa")).alias("d")).filter("d IS NOT NULL"), "differences")
    p = robust.group_percentiles(d, ["filter_name"], {"median_diff": ("d", 0.5), "p1": ("d", 0.01), "p99": ("d", 0.99)})
    off = d.join(p, "filter_name").withColumn("off", F.abs(F.col("d") - F.col("median_diff")))
    mad = robust.group_percentiles(off, ["filter_name"], {"mad": ("off", 0.5)}).select("filter_name", (F.lit(1.4826) * F.col("mad")).alias("mad_diff"))
    clean = F.when(F.col("off") < 3.0 * F.greatest(F.col("mad_diff"), F.lit(1e-12)), F.col("d"))
    n = off.join(mad, "filter_name").groupBy("filter_name").agg(
        F.count("*").alias("n"), F.round(F.avg("d"), 6).alias("mean_diff"), F.round(F.sqrt(F.avg(F.col("d") * F.col("d"))), 6).alias("rms_diff"), F.count(clean).alias("n_clean"), F.round(F.avg(clean), 6).alias("clean_mean"),
    )
    return n.join(p, "filter_name").join(mad, "filter_name")


@query(f"""WITH {STARS_SQL} SELECT filter_name, star_id, flux, CAST(rn AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY filter_name ORDER BY flux DESC, star_id) AS rn FROM stars WHERE isfinite(flux)) WHERE rn <= 400""")
def topk_flux(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 400 brightest stars of each filter."""
    s = stars(spark, sf_dir, "filter_name", "flux").withColumn("flux", robust.finite(F.col("flux"))).filter("flux IS NOT NULL")
    w = Window.partitionBy("filter_name").orderBy(F.desc("flux"), "star_id")
    return s.withColumn("rank", F.row_number().over(w)).filter("rank <= 400").select("filter_name", "star_id", "flux", "rank")


_BRIGHT = """stars AS (SELECT DISTINCT * EXCLUDE (loaded_at) FROM star_fits WHERE isfinite(x) AND isfinite(y) AND mosaic_key IS NOT NULL AND isfinite(flux)),
c AS (SELECT mosaic_key AS grp, star_id AS id, x, y, flux, CAST(floor(x / 12) AS BIGINT) AS cx, CAST(floor(y / 12) AS BIGINT) AS cy FROM stars),
n1 AS (SELECT *, unnest([-1, 0, 1]) AS ox FROM c), n2 AS (SELECT *, unnest([-1, 0, 1]) AS oy FROM n1),
e AS MATERIALIZED (SELECT a.id AS a, b.id AS b FROM c a JOIN n2 b ON a.grp = b.grp AND a.cx = b.cx + b.ox AND a.cy = b.cy + b.oy WHERE a.id <> b.id AND (b.flux > a.flux OR (b.flux = a.flux AND b.id < a.id))
  AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) < 144.0)"""


def _bright_sql(rounds: int = 12) -> str:
    """Rounds of: stars all of whose brighter neighbours are refused are accepted, and refuse theirs."""
    out = ["WITH " + _BRIGHT, "r0 AS (SELECT a FROM e WHERE false)", "e0 AS (SELECT * FROM e)"]
    for k in range(rounds):
        out.append(f"x{k + 1} AS MATERIALIZED (SELECT DISTINCT a FROM e{k} WHERE b NOT IN (SELECT a FROM e{k}))")
        out.append(f"r{k + 1} AS (SELECT a FROM r{k} UNION ALL SELECT a FROM x{k + 1})")
        out.append(f"e{k + 1} AS MATERIALIZED (SELECT * FROM e{k} WHERE a NOT IN (SELECT a FROM x{k + 1}) AND b NOT IN (SELECT a FROM x{k + 1}))")
    return ",\n".join(out) + f"\nSELECT grp, id, x, y, flux FROM c WHERE id NOT IN (SELECT a FROM r{rounds}) QUALIFY row_number() OVER (PARTITION BY grp ORDER BY flux DESC, id) <= 600"


@query(_bright_sql())
def bright_separated(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = stars(spark, sf_dir, "flux").select(F.col("mosaic_key").alias("grp"), F.col("star_id").alias("id"), "x", "y", robust.finite(F.col("flux")).alias("flux")).filter("flux IS NOT NULL")
    return graphs.brightest_separated(s, 12.0, 600)


# -- registrations, gauges and visit graphs -------------------------------------------------------------

_R = """regs AS (SELECT DISTINCT * EXCLUDE (loaded_at) FROM frame_registrations), m AS (SELECT *, regexp_extract(group_key, '^p(.*)_v[0-9]+_', 1) AS field FROM regs WHERE NOT coalesce(is_reference, false) AND isfinite(dx) AND isfinite(dy))"""


def measured(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    r = registrations(spark, sf_dir, *columns).withColumn("dx", robust.finite(F.col("dx"))).withColumn("dy", robust.finite(F.col("dy")))
    return r.filter("dx IS NOT NULL AND dy IS NOT NULL").withColumn("field", F.regexp_extract("group_key", "^p(.*)_v[0-9]+_", 1))


@query(f"""WITH {_R} SELECT reg_id, dx + visit_dx AS total_dx, dy + visit_dy AS total_dy,
  greatest(abs(dx), abs(dy), abs(coalesce(visit_dx, 0)), abs(coalesce(visit_dy, 0))) >= 0.01 AS applied, CASE WHEN n_detected > 0 THEN n_matched / n_detected::double END AS match_rate FROM m""")
def registration_derived(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = [F.abs(F.col(x)) for x in ("dx", "dy")] + [F.abs(F.coalesce(F.col(x), F.lit(0.0))) for x in ("visit_dx", "visit_dy")]
    rate = F.when(F.col("n_detected") > 0, F.col("n_matched") / F.col("n_detected"))
    return measured(spark, sf_dir, "group_key", "dx", "dy", "visit_dx", "visit_dy", "n_detected", "n_matched").select("reg_id", (F.col("dx") + F.col("visit_dx")).alias("total_dx"), (F.col("dy") + F.col("visit_dy")).alias("total_dy"), (F.greatest(*c) >= 0.01).alias("applied"), rate.alias("match_rate"))


@query(f"""WITH {_R}, a AS (SELECT field, count(*) AS frames, median(sqrt(dx * dx + dy * dy)) AS median_shift, round(sqrt(avg(dx * dx + dy * dy)), 9) AS rms_shift,
  round(avg(CASE WHEN isfinite(residual_rms_px) THEN residual_rms_px END), 9) AS mean_residual, count(*) FILTER (greatest(abs(dx), abs(dy)) >= 0.01) AS moved FROM m GROUP BY field) SELECT * FROM a""")
def registration_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    d2 = F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")
    return measured(spark, sf_dir, "group_key", "dx", "dy", "residual_rms_px").groupBy("field").agg(
        F.count("*").alias("frames"), F.median(F.sqrt(d2)).alias("median_shift"), F.round(F.sqrt(F.avg(d2)), 9).alias("rms_shift"),
        F.round(F.avg(robust.finite(F.col("residual_rms_px"))), 9).alias("mean_residual"), F.count_if(F.greatest(F.abs("dx"), F.abs("dy")) >= 0.01).alias("moved"),
    )


@query(f"WITH {_R} SELECT group_key, reg_id, CAST(row_number() OVER (PARTITION BY group_key ORDER BY exposure, filename, reg_id) AS INTEGER) AS place FROM m")
def registration_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("group_key").orderBy("exposure", "filename", "reg_id")
    return measured(spark, sf_dir, "group_key", "exposure", "filename", "dx", "dy").select("group_key", "reg_id", F.row_number().over(w).alias("place"))


_GAUGE = f"""WITH {_R}, w AS (SELECT *, median(dx) OVER (PARTITION BY group_key) AS mx, median(dy) OVER (PARTITION BY group_key) AS my, sqrt(dx * dx + dy * dy) AS o FROM m),
w2 AS (SELECT *, median(o) OVER (PARTITION BY group_key) AS mo FROM w),
gg AS (SELECT field, visit, group_key, any_value(mx) AS dx_median, any_value(my) AS dy_median, any_value(mo) AS offset_median, median(abs(o - mo)) AS offset_mad, count(*) AS n FROM w2 GROUP BY ALL HAVING count(*) >= 20),
vv AS (SELECT field, visit, median(dx_median) AS dx, median(dy_median) AS dy, count(*) AS groups, sqrt(median(dx_median) * median(dx_median) + median(dy_median) * median(dy_median)) AS shift FROM gg GROUP BY ALL),
an AS (SELECT * FROM vv QUALIFY row_number() OVER (PARTITION BY field ORDER BY shift, visit) = 1)
"""


def _gauge_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("group_key")
    m = measured(spark, sf_dir, "group_key", "visit", "dx", "dy").withColumn("o", F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy"))).withColumn("mo", F.median("o").over(w))
    g = m.groupBy("field", "visit", "group_key").agg(F.median("dx").alias("dx_median"), F.median("dy").alias("dy_median"), F.first("mo").alias("offset_median"), F.median(F.abs(F.col("o") - F.col("mo"))).alias("offset_mad"), F.count("*").alias("n"))
    return g.filter("n >= 20")


@query(_GAUGE + "SELECT * FROM gg")
def gauge_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gauge_groups(spark, sf_dir)


def _gauge_visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    dx, dy = F.median("dx_median"), F.median("dy_median")
    return _gauge_groups(spark, sf_dir).groupBy("field", "visit").agg(dx.alias("dx"), dy.alias("dy"), F.count("*").alias("groups"), F.sqrt(dx * dx + dy * dy).alias("shift"))


@query(_GAUGE + "SELECT * FROM vv")
def gauge_visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gauge_visits(spark, sf_dir)


@query(_GAUGE + """SELECT vv.field, vv.visit, an.visit AS anchor, sqrt((vv.dx - an.dx) * (vv.dx - an.dx) + (vv.dy - an.dy) * (vv.dy - an.dy)) AS separation FROM vv JOIN an USING (field)""")
def gauge_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance of each visit from its field's anchor, the visit with the smallest shift."""
    v = _gauge_visits(spark, sf_dir)
    anchor = v.groupBy("field").agg(F.min_by(F.struct("visit", "dx", "dy"), F.struct("shift", "visit")).alias("a"))
    x, y = F.col("dx") - F.col("a.dx"), F.col("dy") - F.col("a.dy")
    return v.join(anchor, "field").select("field", "visit", F.col("a.visit").alias("anchor"), F.sqrt(x * x + y * y).alias("separation"))


@query(_GAUGE + "SELECT field, group_key, offset_median FROM gg WHERE offset_median > 0.4 * 1.0")
def suspect_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gauge_groups(spark, sf_dir).filter("offset_median > 0.4D * 1.0D").select("field", "group_key", "offset_median")


def _visit_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = measured(spark, sf_dir, "group_key", "visit", "exposure", "dx", "dy").groupBy("field", "group_key", "visit", "exposure").agg(F.avg("dx").alias("x"), F.avg("dy").alias("y"))
    a = m.select("field", "exposure", F.col("group_key").alias("a"), F.col("visit").alias("va"), F.col("x").alias("xa"), F.col("y").alias("ya"))
    b = m.select("field", "exposure", F.col("group_key").alias("b"), F.col("visit").alias("vb"), F.col("x").alias("xb"), F.col("y").alias("yb"))
    j = a.join(b, ["field", "exposure"]).filter("a < b AND va <> vb")
    return j.select(F.col("field").alias("grp"), "a", "b", (F.col("xb") - F.col("xa")).alias("dx"), (F.col("yb") - F.col("ya")).alias("dy"))


_EDGES = f"""WITH {_R}, e AS (SELECT field, group_key, visit, exposure, avg(dx) AS x, avg(dy) AS y FROM m GROUP BY ALL),
d AS (SELECT a.field AS grp, a.group_key AS a, b.group_key AS b, b.x - a.x AS dx, b.y - a.y AS dy FROM e a JOIN e b ON a.field = b.field AND a.exposure = b.exposure AND a.group_key < b.group_key AND a.visit <> b.visit),
d1 AS (SELECT *, median(dx) OVER w AS mx, median(dy) OVER w AS my, count(*) OVER w AS n_all FROM d WINDOW w AS (PARTITION BY grp, a, b)),
d2 AS (SELECT *, 1.4826::double * median(abs(dx - mx)) OVER w AS sx, 1.4826::double * median(abs(dy - my)) OVER w AS sy FROM d1 WINDOW w AS (PARTITION BY grp, a, b)),
d3 AS (SELECT * FROM d2 WHERE n_all >= 20 AND (sx = 0 OR abs(dx - mx) <= 3.0 * sx) AND (sy = 0 OR abs(dy - my) <= 3.0 * sy)),
d4 AS (SELECT *, median(dx) OVER w AS kx, median(dy) OVER w AS ky FROM d3 WINDOW w AS (PARTITION BY grp, a, b)),
ed AS (SELECT grp, a, b, count(*) AS n, any_value(kx) AS dx, any_value(ky) AS dy, median(abs(dx - kx)) + median(abs(dy - ky)) AS mad FROM d4 GROUP BY ALL HAVING count(*) >= 20)
"""


@query(_EDGES + "SELECT grp, a, b, n, round(dx, 9) AS dx, round(dy, 9) AS dy, round(mad, 9) AS mad FROM ed")
def edge_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shifts between groups of different visits of a field."""
    e = graphs.pair_edges(_visit_differences(spark, sf_dir))
    return e.select("grp", "a", "b", "n", F.round("dx", 9).alias("dx"), F.round("dy", 9).alias("dy"), F.round("mad", 9).alias("mad"))


_VISITS = """, z AS (SELECT grp, CAST(regexp_extract(a, '_v([0-9]+)_', 1) AS INTEGER) AS a, CAST(regexp_extract(b, '_v([0-9]+)_', 1) AS INTEGER) AS b, sqrt(greatest(n, 1)) / greatest(mad, 0.05) AS w, dx, dy FROM ed)"""


def _visit_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges between the groups of two visits, with the visits as ends."""
    e = graphs.pair_edges(_visit_differences(spark, sf_dir))
    visit = lambda c: F.regexp_extract(c, "_v([0-9]+)_", 1).cast("int").alias(c)
    return e.select("grp", visit("a"), visit("b"), "n", "dx", "dy", "mad")


@query(_EDGES + _VISITS + """, h AS (SELECT grp, a AS node, -1.0 AS s, w, dx, dy FROM z UNION ALL SELECT grp, b, 1.0, w, dx, dy FROM z)
SELECT grp, node, round(sum(w), 6) AS w, round(sum(s * dx * w), 6) AS wdx, round(sum(s * dy * w), 6) AS wdy FROM h GROUP BY grp, node""")
def visit_normal_eq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Diagonal and right-hand side of the visit graph's normal equations."""
    e = _visit_edges(spark, sf_dir)
    h = e.select("grp", F.col("a").alias("node"), F.lit(-1.0).alias("s"), "n", "dx", "dy", "mad").unionAll(e.select("grp", "b", F.lit(1.0), "n", "dx", "dy", "mad"))
    w = graphs.edge_weight()
    return h.groupBy("grp", "node").agg(F.round(F.sum(w), 6).alias("w"), F.round(F.sum(F.col("s") * F.col("dx") * w), 6).alias("wdx"), F.round(F.sum(F.col("s") * F.col("dy") * w), 6).alias("wdy"))


# two or three visits a field: Cramer's rule for the visits besides the smallest, which is pinned
@query(_EDGES + _VISITS + """, o AS (SELECT grp, least(a, b) AS a, greatest(a, b) AS b, w, CASE WHEN a < b THEN dx ELSE -dx END AS dx, CASE WHEN a < b THEN dy ELSE -dy END AS dy FROM z),
vs AS (SELECT grp, list_sort(list(DISTINCT v)) AS v FROM (SELECT grp, a AS v FROM o UNION ALL SELECT grp, b FROM o) GROUP BY grp),
vsum AS (SELECT grp, v, sum(w) AS sw, sum(w * (dx * dx + dy * dy)) AS ww,
  coalesce(sum(w) FILTER (a = v[1] AND b = v[2]), 0) AS w12, coalesce(sum(w) FILTER (a = v[1] AND b = v[3]), 0) AS w13, coalesce(sum(w) FILTER (a = v[2] AND b = v[3]), 0) AS w23,
  coalesce(sum(w * dx) FILTER (a = v[1] AND b = v[2]), 0) AS x12, coalesce(sum(w * dx) FILTER (a = v[1] AND b = v[3]), 0) AS x13, coalesce(sum(w * dx) FILTER (a = v[2] AND b = v[3]), 0) AS x23,
  coalesce(sum(w * dy) FILTER (a = v[1] AND b = v[2]), 0) AS y12, coalesce(sum(w * dy) FILTER (a = v[1] AND b = v[3]), 0) AS y13, coalesce(sum(w * dy) FILTER (a = v[2] AND b = v[3]), 0) AS y23
  FROM o JOIN vs USING (grp) GROUP BY grp, v),
vdet AS (SELECT *, CASE WHEN len(v) = 2 THEN w12 ELSE (w12 + w23) * (w13 + w23) - w23 * w23 END AS det FROM vsum),
vt AS (SELECT *, CASE WHEN len(v) = 2 THEN x12 / det ELSE ((x12 - x23) * (w13 + w23) + w23 * (x13 + x23)) / det END AS tx2, CASE WHEN len(v) = 2 THEN y12 / det ELSE ((y12 - y23) * (w13 + w23) + w23 * (y13 + y23)) / det END AS ty2,
  CASE WHEN len(v) = 3 THEN ((w12 + w23) * (x13 + x23) + w23 * (x12 - x23)) / det ELSE 0 END AS tx3, CASE WHEN len(v) = 3 THEN ((w12 + w23) * (y13 + y23) + w23 * (y12 - y23)) / det ELSE 0 END AS ty3 FROM vdet),
vr AS (SELECT *, sqrt(greatest(ww - 2 * (tx2 * x12 + ty2 * y12 + tx3 * x13 + ty3 * y13 + (tx3 - tx2) * x23 + (ty3 - ty2) * y23) + w12 * (tx2 * tx2 + ty2 * ty2) + w13 * (tx3 * tx3 + ty3 * ty3)
  + w23 * ((tx3 - tx2) * (tx3 - tx2) + (ty3 - ty2) * (ty3 - ty2)), 0) / sw / 2) AS rms FROM vt)
SELECT grp, v[k] AS node, round(CASE k WHEN 1 THEN 0 WHEN 2 THEN tx2 ELSE tx3 END, 6) + 0 AS dx, round(CASE k WHEN 1 THEN 0 WHEN 2 THEN ty2 ELSE ty3 END, 6) + 0 AS dy, round(rms, 6) AS residual_rms, v[1] AS gauge, true AS is_consensus
FROM (SELECT *, unnest(range(1, len(v) + 1)) AS k FROM vr)""")
def visit_solve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shift of each visit of a field from its smallest visit: the correction negated."""
    t = graphs.visit_shifts(_visit_edges(spark, sf_dir))
    return t.withColumns({"dx": F.round(-F.col("dx"), 6) + F.lit(0.0), "dy": F.round(-F.col("dy"), 6) + F.lit(0.0), "residual_rms": F.round("residual_rms", 6)})
