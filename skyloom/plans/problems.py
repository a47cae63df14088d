"""Queries of the general data problems (p1 to p5) over their whole tables, and their SQL."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.operators import badrows, copies, drift, near, spikes
from skyloom.session import table, written

STAR_RADIUS_PX = 2.0
FRAME_RADIUS_ARCSEC = 10.0


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    stars = near.flat_plane(table(spark, sf_dir, "star_fits"), "star_id", F.col("mosaic_key"), "x", "y")
    frames = near.sky_plane(table(spark, sf_dir, "frames"), "frame_id", "ra_deg", "dec_deg")
    radius = math.radians(FRAME_RADIUS_ARCSEC / 3600)
    return (
        near.near_pairs(stars, STAR_RADIUS_PX)
        .select(F.lit("star").alias("point_kind"), "id_a", "id_b")
        .unionByName(near.near_pairs(frames, radius, sphere=True).select(F.lit("frame").alias("point_kind"), "id_a", "id_b"))
    )


P1_SQL = """
WITH s AS (SELECT DISTINCT star_id, mosaic_key, x, y FROM star_fits WHERE isfinite(x) AND isfinite(y)),
sb AS (SELECT *, CAST(floor(x / 3) AS BIGINT) AS cx, CAST(floor(y / 3) AS BIGINT) AS cy FROM s),
so AS (SELECT *, unnest([-1, 0, 1]) AS ox FROM sb),
sn AS (SELECT *, unnest([-1, 0, 1]) AS oy FROM so),
f AS (SELECT DISTINCT frame_id, radians(ra_deg - 360 * floor(ra_deg / 360)) AS lon, radians(dec_deg) AS lat
      FROM frames WHERE isfinite(ra_deg) AND isfinite(dec_deg) AND abs(dec_deg) <= 90),
v AS (SELECT frame_id, cos(lat) * cos(lon) AS x, cos(lat) * sin(lon) AS y, sin(lat) AS z FROM f),
fb AS (SELECT *, CAST(floor(x / 1e-4) AS BIGINT) AS cx, CAST(floor(y / 1e-4) AS BIGINT) AS cy, CAST(floor(z / 1e-4) AS BIGINT) AS cz FROM v),
f1 AS (SELECT *, unnest([-1, 0, 1]) AS ox FROM fb),
f2 AS (SELECT *, unnest([-1, 0, 1]) AS oy FROM f1),
fn AS (SELECT *, unnest([-1, 0, 1]) AS oz FROM f2)
SELECT 'star' AS point_kind, a.star_id AS id_a, b.star_id AS id_b
FROM sb a JOIN sn b ON a.mosaic_key = b.mosaic_key AND a.cx = b.cx + b.ox AND a.cy = b.cy + b.oy AND a.star_id < b.star_id
WHERE sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= 2.0 + 2e-9
UNION ALL
SELECT 'frame', a.frame_id, b.frame_id
FROM fb a JOIN fn b ON a.cx = b.cx + b.ox AND a.cy = b.cy + b.oy AND a.cz = b.cz + b.oz AND a.frame_id < b.frame_id
WHERE 2 * asin(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)) / 2) <= radians(10.0 / 3600) * (1 + 1e-9)
"""


FRAME_SIDE_PX = 2048


def _in_footprints(frames: DataFrame, of: Column) -> DataFrame:
    """Frames and the square footprints, of the frames with a valid position and ``of``, that their centres lie in."""
    half = F.radians(F.col("pixscale_arcsec") * F.lit(FRAME_SIDE_PX / 2 / 3600))
    ra, dec = F.radians("ra_deg"), F.radians("dec_deg")

    def corner(sx: int, sy: int):
        down = F.cos(dec) - sy * half * F.sin(dec)
        lat = F.atan2(F.sin(dec) + sy * half * F.cos(dec), F.sqrt(half * half + down * down))
        return F.array(F.degrees(ra + F.atan2(sx * half, down)), F.degrees(lat))

    ok = of & (F.abs("dec_deg") <= 90.0) & (F.abs("ra_deg") < float("inf"))
    rings = frames.filter(ok).select(F.col("frame_id").alias("region_id"), F.array(corner(-1, -1), corner(1, -1), corner(1, 1), corner(-1, 1)).alias("ring")).distinct()
    at = near.sky_plane(frames, "frame_id", "ra_deg", "dec_deg")
    return near.regions_of(at, near.sky_rings(rings)).select(F.col("id").alias("frame_id"), "region_id", "on_boundary")


def p1_footprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames whose centre lies in the square footprint of any frame with a valid position."""
    return _in_footprints(table(spark, sf_dir, "frames"), F.lit(True))


def p1_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of ``p1_footprints`` whose regions are first exposures."""
    return _in_footprints(table(spark, sf_dir, "frames"), F.col("exposure") == 1)


P1_REGIONS_SQL = """
WITH f AS (SELECT DISTINCT frame_id, exposure, radians(pixscale_arcsec * 1024 / 3600) AS h, radians(ra_deg) AS lon, radians(dec_deg) AS lat
           FROM frames WHERE isfinite(ra_deg) AND isfinite(dec_deg) AND abs(dec_deg) <= 90),
v AS (SELECT *, cos(lat) * cos(lon) AS x, cos(lat) * sin(lon) AS y, sin(lat) AS z FROM f),
b AS (SELECT *, CAST(floor(x / 1e-3) AS BIGINT) AS cx, CAST(floor(y / 1e-3) AS BIGINT) AS cy, CAST(floor(z / 1e-3) AS BIGINT) AS cz FROM v),
r1 AS (SELECT *, unnest([-1, 0, 1]) AS ox FROM b WHERE exposure = 1 AND h IS NOT NULL),
r2 AS (SELECT *, unnest([-1, 0, 1]) AS oy FROM r1),
r AS (SELECT *, unnest([-1, 0, 1]) AS oz FROM r2),
t AS (SELECT p.frame_id, r.frame_id AS region_id, r.h, sin(r.lat) * sin(p.lat) + cos(r.lat) * cos(p.lat) * cos(p.lon - r.lon) AS c,
        cos(p.lat) * sin(p.lon - r.lon) AS xi, cos(r.lat) * sin(p.lat) - sin(r.lat) * cos(p.lat) * cos(p.lon - r.lon) AS eta
      FROM b p JOIN r ON p.cx = r.cx + r.ox AND p.cy = r.cy + r.oy AND p.cz = r.cz + r.oz)
SELECT frame_id, region_id, false AS on_boundary FROM t WHERE c > 0 AND abs(xi / c) <= h AND abs(eta / c) <= h
"""


P1_FOOTPRINTS_SQL = """
WITH f AS (SELECT DISTINCT frame_id, radians(pixscale_arcsec * 1024 / 3600) AS h, radians(ra_deg) AS lon, radians(dec_deg) AS lat
           FROM frames WHERE isfinite(ra_deg) AND isfinite(dec_deg) AND abs(dec_deg) <= 90),
v AS (SELECT *, cos(lat) * cos(lon) AS x, cos(lat) * sin(lon) AS y, sin(lat) AS z FROM f),
b AS (SELECT *, CAST(floor(x / 1e-3) AS BIGINT) AS cx, CAST(floor(y / 1e-3) AS BIGINT) AS cy, CAST(floor(z / 1e-3) AS BIGINT) AS cz FROM v),
r1 AS (SELECT *, unnest([-1, 0, 1]) AS ox FROM b WHERE h IS NOT NULL),
r2 AS (SELECT *, unnest([-1, 0, 1]) AS oy FROM r1),
r AS (SELECT *, unnest([-1, 0, 1]) AS oz FROM r2),
t AS (SELECT p.frame_id, r.frame_id AS region_id, r.h, sin(r.lat) * sin(p.lat) + cos(r.lat) * cos(p.lat) * cos(p.lon - r.lon) AS c,
        cos(p.lat) * sin(p.lon - r.lon) AS xi, cos(r.lat) * sin(p.lat) - sin(r.lat) * cos(p.lat) * cos(p.lon - r.lon) AS eta
      FROM b p JOIN r ON p.cx = r.cx + r.ox AND p.cy = r.cy + r.oy AND p.cz = r.cz + r.oz)
SELECT frame_id, region_id, false AS on_boundary FROM t WHERE c > 0 AND abs(xi / c) <= h AND abs(eta / c) <= h
"""


def _plan_and_disk(spark: SparkSession, sf_dir: str) -> DataFrame:
    def side(name: str, seen: str, size: str) -> DataFrame:
        return table(spark, sf_dir, name).select(
            copies.folded(F.col("filename")).alias("filename"), F.col(seen).alias("seen"), F.col(size).alias("size"),
            copies.folded(F.col("status")).alias("status"), copies.folded_path(F.col("local_path")).alias("local_path"),
        )

    return copies.differences(
        side("download_items", "recorded_at", "expected_size"), side("verify_rows", "checked_at", "actual_size"),
        "filename", "seen", ["size", "status", "local_path"], ("missing_in_verify", "missing_in_items"),
    )


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plan_and_disk(spark, sf_dir).select(F.col("key").alias("filename"), "field_name")


def p2_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The differences with the values of both sides."""
    return _plan_and_disk(spark, sf_dir).withColumnRenamed("key", "filename")


_P2_CTE = r"""
WITH i AS (SELECT lower(trim(filename)) AS filename, expected_size AS size, lower(trim(status)) AS status,
             replace(lower(trim(coalesce(local_path, ''))), '\', '/') AS local_path,
             row_number() OVER (PARTITION BY lower(trim(filename)) ORDER BY recorded_at DESC NULLS LAST, expected_size DESC NULLS LAST) AS rn FROM download_items),
v AS (SELECT lower(trim(filename)) AS filename, actual_size AS size, lower(trim(status)) AS status,
             replace(lower(trim(coalesce(local_path, ''))), '\', '/') AS local_path,
             row_number() OVER (PARTITION BY lower(trim(filename)) ORDER BY checked_at DESC NULLS LAST, actual_size DESC NULLS LAST) AS rn FROM verify_rows),
b AS (SELECT coalesce(i.filename, v.filename) AS filename, i.filename IS NULL AS no_i, v.filename IS NULL AS no_v,
             i.size AS s1, v.size AS s2, i.status AS t1, v.status AS t2, i.local_path AS p1, v.local_path AS p2
      FROM (SELECT * FROM i WHERE rn = 1) i FULL JOIN (SELECT * FROM v WHERE rn = 1) v ON i.filename = v.filename),
d AS (SELECT filename, 'missing_in_verify' AS field_name, NULL AS left_value, NULL AS right_value FROM b WHERE no_v
UNION ALL SELECT filename, 'missing_in_items', NULL, NULL FROM b WHERE no_i
UNION ALL SELECT filename, 'size', CAST(s1 AS VARCHAR), CAST(s2 AS VARCHAR) FROM b WHERE NOT no_i AND NOT no_v AND s1 IS DISTINCT FROM s2
UNION ALL SELECT filename, 'status', t1, t2 FROM b WHERE NOT no_i AND NOT no_v AND t1 IS DISTINCT FROM t2
UNION ALL SELECT filename, 'local_path', p1, p2 FROM b WHERE NOT no_i AND NOT no_v AND p1 IS DISTINCT FROM p2)
"""
P2_SQL = _P2_CTE + "SELECT filename, field_name FROM d"
P2_VALUES_SQL = _P2_CTE + "SELECT filename, field_name, left_value, right_value FROM d"


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = badrows.parsed_rows(table(spark, sf_dir, "obs_lines"), "line_id", "raw_line")
    return rows.filter(F.col("reason").isNotNull()).select(F.col("id").alias("line_id"), "reason").distinct()


def p3_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The valid rows, typed."""
    rows = badrows.parsed_rows(table(spark, sf_dir, "obs_lines"), "line_id", "raw_line")
    return rows.filter(F.col("reason").isNull()).select(F.col("id").alias("line_id"), "obs_id", F.array_join("filters", ";").alias("filters"), F.size("ring").alias("n_corners")).distinct()


def p3_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files read again as physical lines, without knowing where records start."""
    lines = table(spark, sf_dir, "obs_lines").dropDuplicates(["line_id"])
    lines = lines.select("file_name", "line_no", F.posexplode(F.split("raw_line", "\n")))
    found = badrows.parsed_files(lines, "file_name", "line_no", "col", block_lines=1_000, pos="pos")
    label = (F.col("first_line") * 1000 + F.col("first_pos")).alias("first_line")  # of a line beyond the thousandth of its record not unique: line_no and pos are
    return found.select("file_name", label, F.col("first_line").alias("line_no"), F.col("first_pos").alias("pos"), "n_lines", "obs_id", "reason")


_P3_CTE = r"""
WITH r AS (SELECT DISTINCT line_id, coalesce(raw_line, '') AS t FROM obs_lines),
q AS (SELECT *, regexp_full_match(t, '("([^"]|"")*"|[^",]*)(,("([^"]|"")*"|[^",]*))*') AS ok FROM r),
c AS (SELECT *, ok AND regexp_full_match(t, '("([^"]|"")*"|[^",]*)(,("([^"]|"")*"|[^",]*)){2}') AS three,
        regexp_extract(t, '^("(?:[^"]|"")*"|[^",]*),("(?:[^"]|"")*"|[^",]*),("(?:[^"]|"")*"|[^",]*)$', ['a', 'b', 'c']) AS g FROM q),
u AS (SELECT line_id, ok, three,
        CASE WHEN g.a LIKE '"%' THEN replace(substr(g.a, 2, length(g.a) - 2), '""', '"') ELSE g.a END AS obs_id,
        CASE WHEN g.b LIKE '"%' THEN replace(substr(g.b, 2, length(g.b) - 2), '""', '"') ELSE g.b END AS filters,
        CASE WHEN g.c LIKE '"%' THEN replace(substr(g.c, 2, length(g.c) - 2), '""', '"') ELSE g.c END AS s_region FROM c),
w AS (SELECT *, list_filter(regexp_split_to_array(upper(s_region), '\s+'), lambda x: x <> '') AS words FROM u),
n AS (SELECT *, [TRY_CAST(x AS DOUBLE) FOR x IN words[2:]] AS nums,
        len(list_filter(words[2:], lambda x: NOT regexp_full_match(x, '[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)(E[+-]?[0-9]+)?'))) AS odd FROM w),
z AS (SELECT *, CASE WHEN NOT ok THEN 'quoting' WHEN NOT three THEN 'columns' WHEN trim(obs_id, E' \t\n\r') = '' THEN 'obs_id'
  WHEN NOT regexp_full_match(upper(filters), '\s*F[0-9]{3}(W2|W|M|N)\s*(;\s*(CLEAR|F[0-9]{3}(W2|W|M|N))\s*)?') THEN 'filters'
  WHEN len(words) > 0 AND NOT coalesce(words[1] = 'POLYGON' AND odd = 0 AND len(nums) >= 6 AND len(nums) % 2 = 0
    AND len(list_filter(nums, lambda x, i: x IS NULL OR (i % 2 = 1 AND NOT x BETWEEN 0 AND 360) OR (i % 2 = 0 AND NOT x BETWEEN -90 AND 90))) = 0, false) THEN 's_region' END AS reason FROM n)
"""
P3_SQL = _P3_CTE + "SELECT line_id, reason FROM z WHERE reason IS NOT NULL"
P3_ROWS_SQL = _P3_CTE + r"""SELECT line_id, trim(obs_id, E' \t\n\r') AS obs_id, regexp_replace(upper(filters), '\s', '', 'g') AS filters, CAST(len(nums) / 2 AS INTEGER) AS n_corners FROM z WHERE reason IS NULL"""

# Known record starts (a row of the table is one record) against what is found in the files' lines. In a file alone,
# what follows a broken quote up to the next line that starts a whole record belongs to the broken record.
P3_FILES_SQL = _P3_CTE + r""", o AS (SELECT DISTINCT file_name, CAST(line_no AS BIGINT) AS line_no, length(coalesce(raw_line, '')) - length(replace(coalesce(raw_line, ''), chr(10), '')) + 1 AS n,
    CASE WHEN reason IN ('quoting', 'columns', 'obs_id') THEN NULL ELSE trim(z.obs_id, E' \t\n\r') END AS obs_id, z.reason,
    z.three AND regexp_matches(raw_line, '^[^\s",][^",\n]*,') AS is_start FROM obs_lines JOIN z USING (line_id)),
g AS (SELECT *, sum(CASE WHEN is_start THEN 1 ELSE 0 END) OVER (PARTITION BY file_name ORDER BY line_no) AS grp FROM o),
b AS (SELECT *, min(line_no) FILTER (reason = 'quoting') OVER (PARTITION BY file_name, grp) AS broken FROM g),
e AS (SELECT *, sum(n) FILTER (line_no >= broken) OVER (PARTITION BY file_name, grp) AS to_end FROM b)
SELECT file_name, line_no * 1000 AS first_line, line_no, CAST(0 AS BIGINT) AS pos, CAST(CASE WHEN line_no = broken THEN to_end ELSE n END AS INTEGER) AS n_lines, obs_id, reason
FROM e WHERE broken IS NULL OR line_no <= broken"""


def _gauges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return written(drift.fields_of(table(spark, sf_dir, "gauge_records"), "series_key", "file_name", "produced_at", "group_key", "record_id", "payload"), "fields")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.changes_of(_gauges(spark, sf_dir)).select(F.col("file").alias("file_name"), "field_name", "change_kind")


def p4_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The changes with the file compared against, the old name and the types."""
    return drift.changes_of(_gauges(spark, sf_dir)).select(F.col("series").alias("series_key"), F.col("file").alias("file_name"), "previous_file", "field_name", "old_name", "change_kind", "old_type", "new_type")


def p4_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All gauge values of all files under consistent names, each field a number or a text throughout its series."""
    long = _gauges(spark, sf_dir)
    return drift.consistent(long, drift.changes_of(long)).select(F.col("id").alias("record_id"), F.col("series").alias("series_key"), F.col("file").alias("file_name"), F.col("grp").alias("group_key"), "field_name", "number", "text")


def p4_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All gauge values of all files under consistent names, each field cast to its one type over the files of its series."""
    long = _gauges(spark, sf_dir)
    return drift.united(long, drift.changes_of(long)).select(F.col("id").alias("record_id"), F.col("series").alias("series_key"), F.col("file").alias("file_name"), F.col("grp").alias("group_key"), "field_name", "type", "integer", "number", "boolean", "text", "spelling")


def p4_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The union schema of each series and the fields promoted in it."""
    long = _gauges(spark, sf_dir)
    return drift.promotions(long, drift.changes_of(long)).withColumnRenamed("series", "series_key")


_P4_CTE = r"""
WITH RECURSIVE r AS MATERIALIZED (SELECT DISTINCT series_key AS s, file_name AS f, produced_at, group_key AS g, record_id, regexp_replace(payload, '([:\[,]\s*)-?NaN', '\1null', 'g') AS p FROM gauge_records),
k AS (SELECT s, f, produced_at, g, record_id, p, unnest(json_keys(p)) AS name FROM r WHERE json_valid(p) AND json_type(p) = 'OBJECT'),
t AS (SELECT s, f, produced_at, g, record_id, name, json_type(p, '$."' || name || '"') AS jt, json_extract_string(p, '$."' || name || '"') AS val FROM k),
v AS MATERIALIZED (SELECT DISTINCT s, f, produced_at, g, record_id, name, CASE WHEN jt IN ('BIGINT', 'UBIGINT', 'HUGEINT') THEN 1 WHEN jt = 'DOUBLE' THEN 2 WHEN jt = 'BOOLEAN' THEN 4 WHEN jt = 'NULL' OR isnan(TRY_CAST(val AS DOUBLE)) THEN 0 ELSE 8 END AS ty, val,
  CASE WHEN jt = 'NULL' OR isnan(TRY_CAST(val AS DOUBLE)) THEN NULL WHEN jt = 'BOOLEAN' THEN 'b:' || val ELSE coalesce(CAST(TRY_CAST(val AS DOUBLE) AS VARCHAR), 's:' || val) END AS same FROM t),
h0 AS (SELECT s, f, name, max(produced_at) AS made_at, bit_or(ty) AS m FROM v GROUP BY ALL),
h AS MATERIALIZED (SELECT s, f, name, made_at, CASE WHEN m IN (0, 1, 2, 4) THEN m WHEN m = 3 THEN 2 ELSE 8 END AS ty FROM h0),
fi AS MATERIALIZED (SELECT s, f, max(made_at) AS made_at, lag(f) OVER (PARTITION BY s ORDER BY max(made_at), f) AS pf, row_number() OVER (PARTITION BY s ORDER BY max(made_at), f) AS i FROM h GROUP BY s, f),
came AS (SELECT fi.s, fi.f, fi.pf, a.name FROM fi JOIN h a ON a.s = fi.s AND a.f = fi.f WHERE pf IS NOT NULL AND NOT EXISTS (SELECT 1 FROM h b WHERE b.s = fi.s AND b.f = fi.pf AND b.name = a.name)),
went AS (SELECT fi.s, fi.f, fi.pf, b.name FROM fi JOIN h b ON b.s = fi.s AND b.f = fi.pf WHERE NOT EXISTS (SELECT 1 FROM h a WHERE a.s = fi.s AND a.f = fi.f AND a.name = b.name)),
w AS (SELECT DISTINCT s, f, name, g, same FROM v WHERE same IS NOT NULL AND g IS NOT NULL),
kept AS (SELECT c.s, c.f, o.name AS old, c.name AS new, a.g, max(CASE WHEN a.same = b.same THEN 1 ELSE 0 END) AS eq FROM came c JOIN went o ON c.s = o.s AND c.f = o.f
  JOIN w a ON a.s = c.s AND a.f = c.f AND a.name = c.name JOIN w b ON b.s = c.s AND b.f = c.pf AND b.name = o.name AND b.g = a.g GROUP BY ALL),
sc AS (SELECT s, f, old, new, count(*) AS n, avg(eq) AS share FROM kept GROUP BY ALL HAVING avg(eq) >= 0.5),
rn AS MATERIALIZED (SELECT s, f, old, new FROM sc QUALIFY row_number() OVER (PARTITION BY s, f, new ORDER BY share DESC, n DESC, old, new) = 1 AND row_number() OVER (PARTITION BY s, f, old ORDER BY share DESC, n DESC, old, new) = 1),
ev AS (SELECT rn.s, rn.f, new AS field_name, old AS old_name, 'renamed' AS kind, b.ty AS told, a.ty AS tnew FROM rn JOIN fi USING (s, f) JOIN h a ON a.s = rn.s AND a.f = rn.f AND a.name = new JOIN h b ON b.s = rn.s AND b.f = pf AND b.name = old
  UNION ALL SELECT c.s, c.f, c.name, NULL, 'added', NULL, a.ty FROM came c JOIN h a ON a.s = c.s AND a.f = c.f AND a.name = c.name WHERE NOT EXISTS (SELECT 1 FROM rn WHERE rn.s = c.s AND rn.f = c.f AND rn.new = c.name)
  UNION ALL SELECT c.s, c.f, c.name, NULL, 'removed', b.ty, NULL FROM went c JOIN h b ON b.s = c.s AND b.f = c.pf AND b.name = c.name WHERE NOT EXISTS (SELECT 1 FROM rn WHERE rn.s = c.s AND rn.f = c.f AND rn.old = c.name)),
stay AS (SELECT fi.s, fi.f, a.name AS field_name, NULL AS old_name, b.ty AS told, a.ty AS tnew FROM fi JOIN h a ON a.s = fi.s AND a.f = fi.f JOIN h b ON b.s = fi.s AND b.f = fi.pf AND b.name = a.name UNION ALL SELECT s, f, field_name, old_name, told, tnew FROM ev WHERE kind = 'renamed'),
ch AS (SELECT * FROM ev UNION ALL SELECT s, f, field_name, old_name, 'type', told, tnew FROM stay WHERE told <> tnew AND told > 0 AND tnew > 0),
back AS (SELECT h.s, h.f, h.name, h.name AS first_name, fi.i FROM h JOIN fi USING (s, f) UNION ALL
  SELECT b.s, b.f, b.name, coalesce(rn.old, b.first_name), b.i - 1 FROM back b JOIN fi ON fi.s = b.s AND fi.i = b.i LEFT JOIN rn ON rn.s = b.s AND rn.f = fi.f AND rn.new = b.first_name WHERE b.i > 1),
fn AS (SELECT s, f, name, first_name FROM back WHERE i = 1),
named AS MATERIALIZED (SELECT v.*, first_name FROM v JOIN fn USING (s, f, name) WHERE val IS NOT NULL AND ty > 0),
ki AS (SELECT s, first_name, bool_and(same NOT LIKE 'b:%' AND same NOT LIKE 's:%') AND bool_or(ty IN (1, 2)) AS is_number FROM named GROUP BY ALL)
"""
_P4_NAME = "CASE {} WHEN 0 THEN 'none' WHEN 1 THEN 'integer' WHEN 2 THEN 'number' WHEN 4 THEN 'boolean' WHEN 8 THEN 'string' END"
P4_SQL = _P4_CTE + "SELECT f AS file_name, field_name, kind AS change_kind FROM ch"
P4_LOG_SQL = _P4_CTE + f"SELECT s AS series_key, f AS file_name, pf AS previous_file, field_name, old_name, kind AS change_kind, {_P4_NAME.format('told')} AS old_type, {_P4_NAME.format('tnew')} AS new_type FROM ch JOIN fi USING (s, f)"
P4_TABLE_SQL = _P4_CTE + "SELECT record_id, s AS series_key, f AS file_name, g AS group_key, first_name AS field_name, CASE WHEN is_number THEN TRY_CAST(val AS DOUBLE) END AS number, CASE WHEN NOT is_number THEN val END AS text FROM named JOIN ki USING (s, first_name)"
P4_SCHEMA_SQL = _P4_CTE + f""", pm AS (SELECT s, first_name, f, name, bit_or(ty) AS m FROM named GROUP BY ALL), px AS (SELECT *, CASE WHEN m IN (0, 1, 2, 4) THEN m WHEN m = 3 THEN 2 ELSE 8 END AS ft FROM pm),
un AS (SELECT s, first_name, bit_or(m) AS m, list_sort(list(DISTINCT ft)) AS each, count(DISTINCT name) AS n_names, count(DISTINCT f) AS n_files FROM px GROUP BY ALL), uy AS (SELECT *, CASE WHEN m IN (0, 1, 2, 4) THEN m WHEN m = 3 THEN 2 ELSE 8 END AS ut FROM un)
SELECT s AS series_key, first_name AS field_name, {_P4_NAME.format('ut')} AS type, array_to_string([{_P4_NAME.format('x')} FOR x IN each], ',') AS seen, n_names, n_files, len(list_filter(each, lambda x: x <> ut)) > 0 AS is_promoted FROM uy"""


P4_UNION_SQL = _P4_CTE + f""", un AS (SELECT s, first_name, bit_or(ty) AS m, bool_or(ty = 1 AND TRY_CAST(val AS BIGINT) IS NULL) AS beyond FROM named GROUP BY ALL),
uy AS (SELECT *, CASE WHEN m = 1 AND beyond THEN 8 WHEN m IN (0, 1, 2, 4) THEN m WHEN m = 3 THEN 2 ELSE 8 END AS ut FROM un)
SELECT record_id, s AS series_key, f AS file_name, g AS group_key, first_name AS field_name, {_P4_NAME.format('ut')} AS type, CASE WHEN ut = 1 THEN TRY_CAST(val AS BIGINT) END AS integer, CASE WHEN ut = 2 THEN TRY_CAST(val AS DOUBLE) END AS number,
  CASE WHEN ut = 4 THEN val = 'true' END AS boolean, CASE WHEN ut = 8 THEN val END AS text, val AS spelling FROM named JOIN uy USING (s, first_name)"""


def _registrations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "frame_registrations").filter(~F.coalesce("is_reference", F.lit(False)))
    rms, peak, dx, n, top = (F.col(c) for c in ("residual_rms_px", "residual_max_px", "dx", "n_matched", "n_detected"))
    return spikes.scored(
        rows, "group_key", "solved_at", "reg_id",
        {"residual_rms_px": (rms, (rms < 0) | (F.nanvl(peak, F.lit(None)) < rms)), "dx": (dx, F.abs(dx) > 2048.0), "n_matched": (n, (n < 0) | (n > top))},
    )


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spikes.flagged(_registrations(spark, sf_dir)).select(F.col("id").alias("reg_id"), "field_name", "flag")


def p5_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every reading with its level and isolation score."""
    return _registrations(spark, sf_dir).select(F.col("source").alias("group_key"), F.col("id").alias("reg_id"), "field_name", "value", "level", "score", "rule")


P5_SQL = """
WITH r AS (SELECT DISTINCT reg_id, group_key, solved_at, residual_rms_px, residual_max_px, dx, n_matched, n_detected FROM frame_registrations WHERE NOT coalesce(is_reference, false)),
l AS (SELECT reg_id, group_key, solved_at, 'residual_rms_px' AS field_name, residual_rms_px AS v,
        coalesce(residual_rms_px < 0 OR (NOT isnan(residual_max_px) AND residual_rms_px > residual_max_px), false) AS bad FROM r
  UNION ALL SELECT reg_id, group_key, solved_at, 'dx', dx, coalesce(abs(dx) > 2048, false) FROM r
  UNION ALL SELECT reg_id, group_key, solved_at, 'n_matched', n_matched::double, coalesce(n_matched < 0 OR n_matched > n_detected, false) FROM r),
n AS (SELECT *, CASE WHEN isnan(v) THEN NULL ELSE v END AS x, row_number() OVER w AS i FROM l WINDOW w AS (PARTITION BY group_key, field_name ORDER BY solved_at, reg_id)),
b AS (SELECT *, CASE WHEN x = lag(x) OVER w THEN 0 ELSE 1 END AS brk FROM n WINDOW w AS (PARTITION BY group_key, field_name ORDER BY i)),
g AS (SELECT *, sum(brk) OVER (PARTITION BY group_key, field_name ORDER BY i) AS run FROM b),
s AS (SELECT *, count(*) OVER (PARTITION BY group_key, field_name, run) >= 6 AS stuck FROM g),
c AS (SELECT *, median(x) OVER (PARTITION BY group_key, field_name ORDER BY i ROWS BETWEEN 7 PRECEDING AND 7 FOLLOWING) AS level FROM s
      WHERE x IS NOT NULL AND NOT isinf(x) AND NOT bad AND NOT stuck),
m AS (SELECT group_key, field_name, 1.4826::double * quantile_disc(abs(x - level), 0.5) AS scatter FROM c GROUP BY ALL)
SELECT reg_id, field_name, CASE WHEN bad OR isinf(x) THEN 'impossible' ELSE 'stuck' END AS flag FROM s WHERE x IS NOT NULL AND (bad OR isinf(x) OR stuck)
UNION ALL
SELECT reg_id, field_name, 'spike' FROM c JOIN m USING (group_key, field_name) WHERE abs(x - level) > 10 * scatter
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found, "p1_footprints": p1_footprints, "p1_regions": p1_regions, "p2_found": p2_found, "p2_values": p2_values, "p3_found": p3_found, "p3_rows": p3_rows,
    "p3_files": p3_files, "p4_found": p4_found, "p4_log": p4_log, "p4_table": p4_table, "p4_union": p4_union, "p4_schema": p4_schema, "p5_found": p5_found, "p5_scores": p5_scores,
}
SQL: dict[str, str] = {"p1_found": P1_SQL, "p1_footprints": P1_FOOTPRINTS_SQL, "p1_regions": P1_REGIONS_SQL, "p2_found": P2_SQL, "p2_values": P2_VALUES_SQL, "p3_found": P3_SQL, "p3_rows": P3_ROWS_SQL, "p3_files": P3_FILES_SQL, "p4_found": P4_SQL, "p4_log": P4_LOG_SQL, "p4_table": P4_TABLE_SQL, "p4_schema": P4_SCHEMA_SQL, "p4_union": P4_UNION_SQL, "p5_found": P5_SQL}
