"""File selection, name parsing and inventory of plans against disks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The parts of a product file's name.
_CAL = r"^jw([0-9]{5})([0-9]{3})([0-9]{3})_([0-9]{5})_([0-9]{5})_(nrc[ab](?:[1-4]|long))_(cal|i2d)\.fits?$"


def folded(c: Column) -> Column:
    return F.upper(F.trim(c))


def selected(frames: DataFrame, **allowed: list[str]) -> DataFrame:
    """Rows whose columns are among the allowed values, without regard to case and blanks; an empty list allows any."""
    for column, values in allowed.items():
        if values:
            frames = frames.filter(folded(F.col(column)).isin([v.strip().upper() for v in values]))
    return frames


def one_pupil(frames: DataFrame, filter_name: str = "filter_name", pupil: str = "pupil") -> DataFrame:
    """``(filter_name, pupils, is_mixed)``: filters whose frames must not be stacked together have several pupils; a null pupil is CLEAR."""
    p = folded(F.coalesce(F.col(pupil), F.lit("CLEAR")))
    return frames.groupBy(folded(F.col(filter_name)).alias("filter_name")).agg(F.array_join(F.array_sort(F.collect_set(p)), ",").alias("pupils"), (F.count_distinct(p) > 1).alias("is_mixed"))


def name_parts(name: Column) -> list[Column]:
    """program, observation, visit, exposure (-1 where the name has none), detector, kind (null where not a product)."""
    n = F.lower(F.trim(name))
    part = lambda k: F.nullif(F.regexp_extract(n, _CAL, k), F.lit(""))
    number = lambda k: F.coalesce(part(k).cast("int"), F.lit(-1))
    return [part(1).alias("program"), part(2).alias("observation"), number(3).alias("visit"), number(5).alias("exposure"), part(6).alias("detector"), part(7).alias("kind")]


def filter_parts(spec: Column) -> tuple[Column, Column]:
    """(filter, pupil) of ``FILTER[;PUPIL]``; no pupil is CLEAR."""
    s = F.split(folded(spec), ";")
    return F.get(s, F.lit(0)), F.coalesce(F.nullif(F.trim(F.get(s, F.lit(1))), F.lit("")), F.lit("CLEAR"))


def of_specs(filter_name: Column, pupil: Column, specs: list[str]) -> Column:
    """Whether a product's filter and pupil are asked for by specs ``FILTER`` (any pupil) or ``FILTER;PUPIL``.

    As soon as one spec names a pupil, only the named pupils pass, for every filter. A null pupil is CLEAR.
    """
    parts = [s.strip().upper().split(";") for s in specs]
    pupils = [p[1].strip() for p in parts if len(p) > 1 and p[1].strip()]
    wanted = folded(filter_name).isin([p[0].strip() for p in parts])
    return wanted & folded(F.coalesce(pupil, F.lit("CLEAR"))).isin(pupils) if pupils else wanted


# The second stage's categories in their order.
STAGE_KINDS = ("cal", "combined_i2d", "subset_i2d")


def stage_kinds(spec: str) -> list[str]:
    """The categories a comma list names, in their own order; an unknown or no name is an error."""
    wanted = [k.strip() for k in spec.split(",") if k.strip()]
    unknown = sorted(set(wanted) - set(STAGE_KINDS))
    if unknown or not wanted:
        raise ValueError(f"unknown categories {unknown}" if unknown else "no category named")
    return [k for k in STAGE_KINDS if k in wanted]


def staged(plan: DataFrame) -> DataFrame:
    """``category`` of each planned file: single calibrated files, combined mosaics, and single mosaics of detector nrca1 in visits 1 to 4 or of visit 1; else null."""
    single = F.col("filename").rlike(_CAL)
    subset = ((F.lower(F.trim("detector")) == "nrca1") & F.col("visit").isin(1, 2, 3, 4)) | (F.col("visit") == 1)
    category = F.when(single & F.col("filename").rlike(r"_cal\.fits?$"), "cal").when(~single & F.col("filename").endswith("_i2d.fits"), "combined_i2d").when(single & subset, "subset_i2d")
    return plan.withColumn("category", category)


def plain_projection(ctype: Column) -> Column:
    """A projection's name without its distortion suffix."""
    return F.regexp_replace(ctype, "-SIP$", "")


def latest(rows: DataFrame, key: str, seen: str, *ties: str) -> DataFrame:
    """The last row of each key, combined before the shuffle."""
    rest = [c for c in rows.columns if c != key]
    last = rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(F.col(seen), *ties)).alias("s"))
    return last.select(key, "s.*")


def reconciled(plan: DataFrame, disk: DataFrame, key: str = "filename", expected: str = "expected_size", actual: str = "actual_size") -> DataFrame:
    """Every file of either side with ``ok``, ``size_mismatch`` (an expected size of 0 or null never fits), ``missing`` or ``extra``."""
    p = plan.select(key, F.col(expected).alias("expected_size"), F.lit(True).alias("planned"))
    d = disk.select(key, F.col(actual).alias("actual_size"), F.lit(True).alias("there"))
    j = p.join(d, key, "full_outer")
    fits = (F.col("expected_size") > 0) & (F.col("expected_size") == F.col("actual_size"))
    status = F.when(F.col("planned").isNull(), "extra").when(F.col("there").isNull(), "missing").when(fits, "ok").otherwise("size_mismatch")
    return j.select(key, "expected_size", "actual_size", status.alias("state"))


def in_report_order(rows: DataFrame) -> DataFrame:
    """``place`` of each reconciled file: fitting ones first, then by state and name."""
    return rows.orderBy(F.col("state") != "ok", "state", "filename")


def covered_tiles(points: DataFrame, tile: int, stride: int) -> DataFrame:
    """Share of a tile's ``stride`` cells that hold a point: ``(grp, tx, ty, cells, fraction)``."""
    cell = points.select("grp", F.floor(F.col("x") / stride).cast("bigint").alias("cx"), F.floor(F.col("y") / stride).cast("bigint").alias("cy")).distinct()
    per = tile // stride
    return cell.groupBy("grp", F.floor(F.col("cx") / per).cast("bigint").alias("tx"), F.floor(F.col("cy") / per).cast("bigint").alias("ty")).agg(F.count("*").alias("cells"), (F.count("*") / float(per * per)).alias("fraction"))


def evenly_spaced(rows: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    """About ``n`` rows of each group, evenly spaced in its order: those at round(linspace(0, count - 1, n)), each once."""
    w = Window.partitionBy(*keys)
    r = rows.withColumn("_i", F.row_number().over(w.orderBy(*order)) - 1).withColumn("_n", F.count("*").over(w))
    # row i is taken where some k has round(k (count - 1) / (n - 1)) = i, half to even
    k = F.sequence(F.lit(0), F.lit(n - 1))
    at = F.transform(k, lambda x: F.rint(x * (F.col("_n") - 1) / F.lit(float(max(1, n - 1)))).cast("int"))
    return r.filter(F.array_contains(at, F.col("_i"))).drop("_i", "_n")


def tiles_touched(boxes: DataFrame, tile: int) -> DataFrame:
    """One row for each tile a box ``(x0, y0, x1, y1)``, half-open, overlaps: the range join with a tile grid as an equi-join key."""
    k = lambda c, less: F.floor((F.col(c) - less) / tile).cast("bigint")
    b = boxes.filter("x1 > x0 AND y1 > y0").withColumn("tx", F.explode(F.sequence(k("x0", 0), F.ceil(F.col("x1") / tile).cast("bigint") - 1)))
    return b.withColumn("ty", F.explode(F.sequence(k("y0", 0), F.ceil(F.col("y1") / tile).cast("bigint") - 1)))


def with_halo(points: DataFrame, tile: int, halo: int) -> DataFrame:
    """Each point for every tile whose halo holds it; ``interior`` is true for exactly one of them."""
    box = points.withColumns({"x0": F.col("x") - halo, "x1": F.col("x") + halo, "y0": F.col("y") - halo, "y1": F.col("y") + halo})
    k = lambda c: F.floor(F.col(c) / tile).cast("bigint")
    e = box.withColumn("tx", F.explode(F.sequence(k("x0"), k("x1")))).withColumn("ty", F.explode(F.sequence(k("y0"), k("y1"))))
    return e.withColumn("interior", (F.col("tx") == k("x")) & (F.col("ty") == k("y"))).drop("x0", "x1", "y0", "y1")
