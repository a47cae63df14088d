"""Robust statistics of groups: medians, median absolute deviations and iterated clipping.

All medians are exact. ``clipped`` and ``mad_sigma`` use windows, ``stacked`` an array: their groups are
one pixel's, tile's or source's values, whose number the survey bounds. Groups that grow with
the table (a filter, a mosaic) take ``group_percentiles`` and ``clipped_large``, which
gather no group; a whole column, ``whole_percentiles``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyloom.session import written

MAD_SCALE = 1.4826
MAD_SCALE_FULL = 1.482602218505602  # the factor of the combine step


def finite(c: Column) -> Column:
    """Null where the value is null, NaN or infinite."""
    return F.when(F.abs(c) < float("inf"), c)


def rms(c: Column) -> Column:
    return F.sqrt(F.avg(c * c))


def mad_sigma(df: DataFrame, keys: list[str], value: str, scale: float = MAD_SCALE) -> DataFrame:
    """Per group: ``n``, ``med`` and ``sigma``, the scaled median absolute deviation. Nulls are left out; a group of nulls has none."""
    w = Window.partitionBy(*keys)
    dev = df.withColumn("_med", F.median(value).over(w)).withColumn("_dev", F.abs(F.col(value) - F.col("_med")))
    return dev.groupBy(*keys).agg(F.count(value).alias("n"), F.first("_med").alias("med"), (F.lit(scale) * F.median("_dev")).alias("sigma"))


def clipped(df: DataFrame, keys: list[str], value: str, sigma: float, rounds: int, width: str = "mad", least: int = 3) -> DataFrame:
    """``df`` with ``_kept``: ``value`` where it survives ``rounds`` of clipping about its group's median, else null.

    ``width``: ``mad`` (zero clips every unequal value) or ``std`` (population standard
    deviation). Bounds are inclusive. Groups of under ``least`` values are not clipped.
    Rounds after convergence change nothing. A group of nulls keeps nothing.
    """
    w = Window.partitionBy(*keys)
    out = df.withColumn("_n", F.count(value).over(w)).withColumn("_kept", F.col(value))
    for _ in range(rounds):
        out = out.withColumn("_c", F.median("_kept").over(w))
        spread = F.lit(MAD_SCALE_FULL) * F.median(F.abs(F.col("_kept") - F.col("_c"))).over(w) if width == "mad" else F.stddev_pop("_kept").over(w)
        out = out.withColumn("_s", spread)
        inside = (F.col("_kept") >= F.col("_c") - sigma * F.col("_s")) & (F.col("_kept") <= F.col("_c") + sigma * F.col("_s"))
        out = out.withColumn("_kept", F.when((F.col("_n") < least) | inside, F.col("_kept")))
    return out.drop("_c", "_s")


def stacked(df: DataFrame, keys: list[str], value: str, sigma: float = 3.0, rounds: int = 3, mean: bool = False) -> DataFrame:
    """Sigma-clipped combine of each pixel's values: ``coverage`` (before clipping), ``kept``, ``value``.

    Under three values: their plain median or mean; none: null, with coverage 0. As ``clipped`` with ``mad``, but a
    pixel's values (as many as exposures see it) are one sorted array after a single shuffle, clipped where they are.
    """
    g = df.groupBy(*keys).agg(F.sort_array(F.collect_list(value)).alias("_s")).withColumn("coverage", F.size("_s").cast("bigint"))
    for _ in range(rounds):
        g = g.withColumn("_c", _middle("_s"))
        g = g.withColumn("_d", F.sort_array(F.transform("_s", lambda v: F.abs(v - F.col("_c")))))
        g = g.withColumn("_w", F.lit(sigma) * (F.lit(MAD_SCALE_FULL) * _middle("_d")))
        inside = F.filter("_s", lambda v: (v >= F.col("_c") - F.col("_w")) & (v <= F.col("_c") + F.col("_w")))
        g = g.withColumn("_s", F.when(F.col("coverage") < 3, F.col("_s")).otherwise(inside)).drop("_c", "_d", "_w")
    kept = F.size("_s").cast("bigint")
    total = F.aggregate("_s", F.lit(0.0), lambda a, v: a + v)
    return g.select(*keys, "coverage", kept.alias("kept"), (F.try_divide(total, kept) if mean else _middle("_s")).alias("value"))


def _middle(c: str) -> Column:
    """The median of a sorted array; null where it is empty."""
    at = lambda i: F.get(c, F.floor(i / 2).cast("int")) * 0.5
    return at(F.size(c) - 1) + at(F.size(c))


SMALL_GROUP = 100_000


def _same(a: DataFrame, b: DataFrame, keys: list[str]) -> Column:
    on = F.lit(True)
    for k in keys:
        on &= a[k].eqNullSafe(b[f"_{k}"])
    return on


def by_size(df: DataFrame, keys: list[str], most: int | None = None) -> tuple[DataFrame, DataFrame | None]:
    """``df``'s rows of groups of at most ``most`` rows, which a task may hold, and those of the larger groups (None where there are none). A group with a null key counts as small."""
    known = F.lit(True)
    for k in keys:
        known &= F.col(k).isNotNull()
    large = written(df.filter(known).groupBy(*keys).agg(F.count("*").alias("_rows")).filter(F.col("_rows") > (most or SMALL_GROUP)).select(*[F.col(k).alias(f"_{k}") for k in keys]), "large")
    if large.isEmpty():
        return df, None
    return df.join(large, _same(df, large, keys), "left_anti"), df.join(large, _same(df, large, keys), "left_semi")


def group_percentiles(df: DataFrame, keys: list[str], wanted: dict[str, tuple[str, float]], accuracy: int = 10_000, most: int | None = None) -> DataFrame:
    """Per group exact, linearly interpolated percentiles: ``wanted`` maps a name to (column, percentile).

    Groups of up to ``most`` rows are one aggregate. In larger ones sketches, combined before the
    shuffle, bracket each percentile's rank, again inside the bracket until it holds at most ``most``
    values; only these are ordered. Null and NaN are left out; a group without a value has none.
    """
    value = lambda c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))
    small, large = by_size(df, keys, most)
    out = small.groupBy(*keys).agg(*[F.percentile(value(c), F.lit(p)).alias(name) for name, (c, p) in wanted.items()]).dropna("all", subset=list(wanted))
    # written: a join may take a bare union for partitioned by the keys, which it no longer is once one side is re-planned while running
    return out if large is None else written(out.unionByName(_large_percentiles(large, keys, wanted, accuracy, most or SMALL_GROUP)), "percentiles")


def _large_percentiles(df: DataFrame, keys: list[str], wanted: dict[str, tuple[str, float]], accuracy: int, most: int) -> DataFrame:
    names, w = list(wanted), [*keys, "w"]
    of = F.array(*[F.struct(F.lit(i).alias("w"), F.col(c).cast("double").alias("v")) for i, (c, _) in enumerate(wanted.values())])
    long = written(df.select(*keys, F.explode(of).alias("e")).select(*keys, "e.w", "e.v").filter("v IS NOT NULL AND NOT isnan(v)"), "values")
    rank = F.get(F.array(*[F.lit(p) for _, p in wanted.values()]), F.col("w")) * (F.col("n") - 1)
    at = written(long.groupBy(*w).agg(F.count("*").alias("n")).select(*w, rank.alias("rank"), F.col("n").alias("inside"), F.lit(0).cast("bigint").alias("below"), F.lit(float("-inf")).alias("lo"), F.lit(float("inf")).alias("hi")), "ranks")
    steps = 64
    while True:
        wide = at.filter((F.col("inside") > most) & (F.col("lo") < F.col("hi")))
        if wide.isEmpty():
            break
        held = long.join(wide.select(*w, "lo", "hi"), w).filter(F.col("v").between(F.col("lo"), F.col("hi")))
        sketch = held.groupBy(*w).agg(F.percentile_approx("v", [k / steps for k in range(steps + 1)], accuracy).alias("q"))
        # the narrowest pair of sketched values that surely has both neighbours of the rank between them
        near = (F.col("rank") - F.col("below")) / F.col("inside") * steps
        lo, hi = F.get("q", F.greatest(F.lit(0), F.floor(near) - 1).cast("int")), F.get("q", F.least(F.lit(steps), F.ceil(near) + 1).cast("int"))
        cut = wide.join(sketch, w).select(*w, lo.alias("l"), hi.alias("h"))
        counted = long.join(cut, w).groupBy(*w).agg(F.count_if(F.col("v") < F.col("l")).alias("b"), F.count_if(F.col("v").between(F.col("l"), F.col("h"))).alias("i"), F.first("l").alias("l"), F.first("h").alias("h"))
        # kept only where both neighbours are inside: a sketch may be off
        sure = (F.col("b") <= F.floor("rank")) & (F.ceil("rank") < F.col("b") + F.col("i")) & (F.col("i") < F.col("inside"))
        new = at.join(counted, w, "left").withColumn("ok", F.coalesce(sure, F.lit(False)))
        pick = lambda a, b: F.when(F.col("ok"), F.col(a)).otherwise(F.col(b))
        moved = written(new.select(*w, "rank", pick("i", "inside").alias("inside"), pick("b", "below").alias("below"), pick("l", "lo").alias("lo"), pick("h", "hi").alias("hi"), "ok"), "ranks")
        done = not moved.filter("ok").limit(1).count()
        at = moved.drop("ok")
        if done:  # nothing narrows any more: many equal values
            break
    counts = long.join(at, w).filter(F.col("v").between(F.col("lo"), F.col("hi"))).groupBy(*w, "v").agg(F.count("*").alias("c"), F.first("rank").alias("rank"), F.first("below").alias("below"))
    run = counts.withColumn("upto", F.sum("c").over(Window.partitionBy(*w).orderBy("v")) + F.col("below"))
    got = run.groupBy(*w).agg(F.min(F.when(F.col("upto") > F.floor("rank"), F.col("v"))).alias("a"), F.min(F.when(F.col("upto") > F.ceil("rank"), F.col("v"))).alias("b"), F.first("rank").alias("rank"))
    value = F.col("a") + (F.col("b") - F.col("a")) * (F.col("rank") - F.floor("rank"))
    return got.groupBy(*keys).agg(*[F.max(F.when(F.col("w") == i, value)).alias(name) for i, name in enumerate(names)])


def clipped_large(df: DataFrame, keys: list[str], value: str, sigma: float, rounds: int, least: int = 3, most: int | None = None) -> DataFrame:
    """As ``clipped`` with ``width="std"``, for groups of any size: those of over ``most`` rows are written once, and each round only adds a small table of bounds."""
    small, large = by_size(df, keys, most)
    out = clipped(small, keys, value, sigma, rounds, "std", least)
    if large is None:
        return out
    base = written(large, "clip")
    n = base.groupBy(*keys).agg(F.count(value).alias("_n"))
    bounds = n.select(*keys, "_n", F.lit(float("-inf")).alias("_lo"), F.lit(float("inf")).alias("_hi"))
    kept = F.when((F.col("_n") < least) | F.col(value).between(F.col("_lo"), F.col("_hi")), F.col(value))
    for _ in range(rounds):
        now = base.join(bounds, keys).withColumn("_kept", kept)
        s = now.groupBy(*keys).agg(F.stddev_pop("_kept").alias("_s"))
        c = _large_percentiles(now, keys, {"_c": ("_kept", 0.5)}, 10_000, most or SMALL_GROUP)
        lo, hi = F.col("_c") - sigma * F.col("_s"), F.col("_c") + sigma * F.col("_s")
        bounds = written(bounds.join(s, keys, "left").join(c, keys, "left").select(*keys, "_n", F.greatest("_lo", lo).alias("_lo"), F.least("_hi", hi).alias("_hi")), "bounds")
    return out.unionByName(base.join(bounds, keys).withColumn("_kept", kept).drop("_lo", "_hi"))


def whole_percentiles(df: DataFrame, value: str, at: list[float], accuracy: int = 10_000, most: int | None = None) -> list[float | None]:
    """Exact, linearly interpolated percentiles of a whole column without gathering it: as of one group of any size."""
    v = df.select(F.lit(0).alias("k"), finite(F.col(value).cast("double")).alias("v")).filter("v IS NOT NULL")
    found = group_percentiles(v, ["k"], {f"p{i}": ("v", p) for i, p in enumerate(at)}, accuracy, most).first()
    return [None if found is None else found[f"p{i}"] for i in range(len(at))]


def numbered(df: DataFrame, keys: list[str], order: str, most: int | None = None) -> DataFrame:
    """``_i``, each row's place in its group by the number ``order`` (from 0; equal ones in any order), and ``_n``, the group's rows.

    Groups of over ``most`` rows are cut by sketched quantiles; rows are numbered in their slab, slabs by running counts.
    """
    few = df.groupBy(*keys).agg(F.count("*").alias("_n"), F.percentile_approx(order, [k / 512 for k in range(1, 512)], 10_000).alias("_q"))
    few = few.select(*[F.col(k).alias(f"_{k}") for k in keys], "_n", F.when(F.col("_n") > (most or SMALL_GROUP), F.array_distinct("_q")).alias("_q"))
    slab = F.coalesce(F.size(F.filter("_q", lambda c: c < F.col(order))), F.lit(0))
    at = df.join(few, _same(df, few, keys)).withColumn("_slab", slab).drop("_q", *[f"_{k}" for k in keys])
    counts = at.groupBy(*keys, "_slab").agg(F.count("*").alias("_c"))
    before = Window.partitionBy(*keys).orderBy("_slab").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("_slab").alias("_s"), F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_before"))
    at = at.join(counts, _same(at, counts, keys) & (at["_slab"] == counts["_s"]))
    place = F.row_number().over(Window.partitionBy(*keys, "_slab").orderBy(order)) - 1 + F.col("_before")
    return at.withColumn("_i", place).drop("_slab", "_s", "_before", *[f"_{k}" for k in keys])
