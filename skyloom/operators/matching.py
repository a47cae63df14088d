"""Nearest-neighbour matches between catalogues, as equi-joins on grid cells.

Catalogues hold ``(grp, id, x, y)``. Cells are as wide as the radius, so a match is in
the same or a neighbouring cell: one side is exploded to nine cells and the
join is on (grp, cell). Ties go to the smaller id. Positions must be finite.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyloom.functions import robust


def _cell(c: str, radius: float) -> Column:
    return F.floor(F.col(c) / F.lit(radius)).cast("bigint")


def pairs_within(a: DataFrame, b: DataFrame, radius: float) -> DataFrame:
    """All ``(grp, a_id, b_id, dx, dy, d2)`` with b at most ``radius`` from a; dx, dy = b - a."""
    around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    left = a.select("grp", F.col("id").alias("a_id"), F.col("x").alias("ax"), F.col("y").alias("ay"), _cell("x", radius).alias("cx"), _cell("y", radius).alias("cy"))
    right = b.select("grp", F.col("id").alias("b_id"), F.col("x").alias("bx"), F.col("y").alias("by_"), _cell("x", radius).alias("cx0"), _cell("y", radius).alias("cy0"), F.explode(around).alias("o"))
    right = right.select("grp", "b_id", "bx", "by_", (F.col("cx0") + F.col("o.i")).alias("cx"), (F.col("cy0") + F.col("o.j")).alias("cy"))
    j = left.join(right, ["grp", "cx", "cy"]).withColumn("dx", F.col("bx") - F.col("ax")).withColumn("dy", F.col("by_") - F.col("ay"))
    j = j.withColumn("d2", F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy"))
    return j.filter(F.col("d2") <= radius * radius).select("grp", "a_id", "b_id", "dx", "dy", "d2")


def _first(df: DataFrame, by: str, then: str) -> DataFrame:
    """The row with the smallest (d2, then) of each ``(grp, by)``, combined before the shuffle."""
    rest = [c for c in df.columns if c not in ("grp", by)]
    best = df.groupBy("grp", by).agg(F.min_by(F.struct(*rest), F.struct("d2", then)).alias("s"))
    return best.select("grp", by, "s.*").select(*df.columns)


def nearest(a: DataFrame, b: DataFrame, radius: float) -> DataFrame:
    """For each a its nearest b; a b may serve several."""
    return _first(pairs_within(a, b, radius), "a_id", "b_id")


def nearest_distance(a: DataFrame, b: DataFrame, radius: float) -> DataFrame:
    """``(grp, a_id, distance)`` for every a; infinite where no b is within ``radius``."""
    near = nearest(a, b, radius).select("grp", "a_id", F.sqrt("d2").alias("distance"))
    return a.select("grp", F.col("id").alias("a_id")).join(near, ["grp", "a_id"], "left").withColumn("distance", F.coalesce("distance", F.lit(float("inf"))))


def mutual_nearest(a: DataFrame, b: DataFrame, radius: float) -> DataFrame:
    """Pairs that are each other's nearest."""
    p = pairs_within(a, b, radius)
    back = _first(p, "b_id", "a_id").select("grp", "a_id", "b_id")
    return _first(p, "a_id", "b_id").join(back, ["grp", "a_id", "b_id"])


def one_to_one(a: DataFrame, b: DataFrame, radius: float) -> DataFrame:
    """Each a offers itself to its nearest b, which takes the closest offer; the others are dropped, not matched again."""
    return _first(nearest(a, b, radius), "b_id", "a_id")


def translation(matches: DataFrame) -> DataFrame:
    """Per group: ``n``, median ``dx``, ``dy``, and rms and largest distance from that shift."""
    shift = robust.group_percentiles(matches, ["grp"], {"mx": ("dx", 0.5), "my": ("dy", 0.5)})
    m = matches.join(shift, "grp")
    r2 = (F.col("dx") - F.col("mx")) * (F.col("dx") - F.col("mx")) + (F.col("dy") - F.col("my")) * (F.col("dy") - F.col("my"))
    return m.groupBy("grp").agg(F.count("*").alias("n"), F.first("mx").alias("dx"), F.first("my").alias("dy"), F.sqrt(F.avg(r2)).alias("residual_rms"), F.sqrt(F.max(r2)).alias("residual_max"))
