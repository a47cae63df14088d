"""Implausible measurements per source: impossible, stuck and spiking readings.

1. Rows are sorted by (source, time, id) into range partitions. A source with a third of all
   rows is many partitions, and so are rows of one and the same time.
2. In each partition, with ``HALO`` rows of either neighbour, every reading gets a running
   level, its distance from it and from the distance before, and its run length.
3. Per source, combined before the shuffle: the usual scatter and the seasonal residual of
   each time of day.
4. One isolation forest a source: where its rows are few, each tree takes 64 of them by hash, else all
   rows are shared out over the trees as counts of cells of like features, whose scores the readings take.
5. A reading whose score stands apart from all the scores of its source is a candidate; an exact
   check against ten scatters follows. Explicit rules flag impossible and stuck readings.

The forest of a source is grown from the same rows or counts with the same choices wherever there
are readings of it, so scores do not depend on how a source is cut.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyloom.functions import isolation
from skyloom.session import written

SIDE = 7  # readings on either side of a reading that make its level
STUCK = 6
LONGEST_RUN = 16  # longer runs look alike to the forest
HALO = 256
GROUP_ROWS, MOST_ROWS, MANY_GROUPS = 5_000, 500_000, 2_000
FEW_ROWS = 2_048  # the rows of so small a source are all at hand in a task; each of its 32 trees takes 64 of them, so that a row may be in none
SKETCHED = 50_000  # a sketch gives the median of fewer readings exactly; of more, only where to look
FINE = 8  # cells a unit of arsinh: about 1/8 scatter wide near the level, an eighth of the distance far off
APART = 2.0
SATURATED = 32.0  # scatters beyond which a feature does not grow, so that a huge spike hides no other
SLOTS, SLOT_US = 8, 10_800_000_000
NO_ID = -(2**63)
SCORED = "source string, id bigint, field_name string, value double, level double, scatter double, score double, apart double, rule string, counts boolean"
CELLED = f"part int, {SCORED}, cell bigint, grows int"
FOREST = "source string, field_name string, cell bigint, parts array<int>, score double, apart double"


def _levels(v: np.ndarray, bad: np.ndarray, seg: np.ndarray) -> tuple[np.ndarray, ...]:
    """(level, distance, step, run, rule, counts) of one field of rows sorted by segment and time."""
    n = len(v)
    there = ~np.isnan(v)
    bad = there & (bad | np.isinf(v))
    # runs of rows with exactly the same value; a missing reading ends a run
    same = np.r_[False, (v[1:] == v[:-1]) & (seg[1:] == seg[:-1])]
    start = np.flatnonzero(~same)
    length = np.diff(np.r_[start, n])
    run = np.repeat(length, length)
    stuck = there & (run >= STUCK)
    counts = there & ~bad & ~stuck
    rule = np.where(bad, 1, np.where(stuck, 2, 0)).astype(np.int32)
    level = np.full(n, np.nan)
    if counts.any():
        x, xseg = v[counts], seg[counts]
        window = (np.cumsum(counts) - counts)[:, None] + np.arange(-SIDE, SIDE + 1)
        inside = (window >= 0) & (window < len(x))
        window = np.clip(window, 0, len(x) - 1)
        inside &= xseg[window] == seg[:, None]
        w = np.sort(np.where(inside, x[window], np.inf), 1)
        m, r = inside.sum(1), np.arange(n)
        some = m > 0
        level[some] = ((w[r, np.maximum(m - 1, 0) // 2] + w[r, np.minimum(m // 2, 2 * SIDE)]) / 2)[some]
    off = np.where(there & ~np.isnan(level), np.clip(np.where(there, v, 0), -1e300, 1e300) - np.nan_to_num(level), 0.0)
    step = off - np.r_[0, off[:-1]] * (np.r_[-1, seg[:-1]] == seg)
    return level, off, step, np.minimum(run, LONGEST_RUN).astype(np.int32), rule, counts


def _table(batches: Iterator[pa.RecordBatch]) -> pa.Table | None:
    found = list(batches)
    return pa.Table.from_batches(found).combine_chunks() if found else None


def _sorted_parts(rows: DataFrame, group_rows: int, slab_rows: int | None) -> tuple[DataFrame, int]:
    """Rows in order of (source, time, id), cut into ``part``; ``head`` and ``tail`` mark those its neighbours see."""
    n = rows.count()
    size = min(max(group_rows, n // MANY_GROUPS), max(group_rows, MOST_ROWS), slab_rows or MOST_ROWS)
    parts = max(1, math.ceil(n / size))

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = _table(batches)
        if t is None:
            return
        i = np.arange(t.num_rows)
        t = t.append_column("part", pa.array(np.full(len(i), TaskContext.get().partitionId(), np.int32)))
        t = t.append_column("head", pa.array(i < HALO)).append_column("tail", pa.array(i >= len(i) - HALO))
        yield from t.to_batches()

    ordered = rows.repartitionByRange(parts, "source", "at", "id").sortWithinPartitions("source", "at", "id")
    shape = ", ".join(f"{c} {t}" for c, t in rows.dtypes)
    return written(ordered.mapInArrow(number, f"{shape}, part int, head boolean, tail boolean"), "ordered"), parts


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def scored(rows: DataFrame, source: str, at: str, id: str, fields: dict[str, tuple[Column, Column]], slab_rows: int | None = None, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Every reading with its level, its source's scatter, its isolation score and rule.

    ``(source, id, field_name, value, level, scatter, score, apart, rule, counts)``.
    ``fields`` maps a name to (value, condition under which it is impossible); an
    infinite value is impossible too, a null condition is not. Null and NaN are no
    readings and have no row. ``rule`` is ``impossible`` or ``stuck`` (one of at least
    six rows in a row with the same value) or null; ``counts`` marks readings that make
    up levels. ``scatter`` is 1.4826 times the median distance from the level; ``apart`` tells how far
    the score is above the median score of all the source's readings, in scaled median absolute deviations.
    Rows repeated within a source (same time and id) count once, with the largest values
    where they differ. Rows without source are one source of their own; rows without a
    time come first. Equally early rows are ordered by id.

    A partition has about ``group_rows`` rows (``slab_rows`` at most). At its ends a level
    uses the ``HALO`` rows of the neighbour: where over 249 rows in a row hold no counted
    reading, it rests on the nearer side only.
    """
    names = list(fields)
    base = rows.select(
        F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source"), F.coalesce(F.unix_micros(F.col(at).cast("timestamp")), F.lit(-(2**62))).alias("at"), F.coalesce(F.col(id).cast("bigint"), F.lit(NO_ID)).alias("id"),
        *[v.cast("double").alias(f"v{i}") for i, (v, _) in enumerate(fields.values())], *[F.coalesce(b, F.lit(False)).alias(f"b{i}") for i, (_, b) in enumerate(fields.values())],
    )
    once = base.groupBy("source", "at", "id").agg(*[F.max(f"v{i}").alias(f"v{i}") for i in range(len(names))], *[F.max(f"b{i}").alias(f"b{i}") for i in range(len(names))])
    ordered, parts = _sorted_parts(once, group_rows, slab_rows)
    halo = ordered.filter("head AND part > 0").withColumn("part", F.col("part") - 1).unionByName(ordered.filter(f"tail AND part < {parts - 1}").withColumn("part", F.col("part") + 1))
    seen = ordered.withColumn("own", F.lit(True)).unionByName(halo.withColumn("own", F.lit(False))).drop("head", "tail")

    each = ", ".join(f"v{i} double, level{i} double, off{i} double, step{i} double, run{i} int, rule{i} int, counts{i} boolean" for i in range(len(names)))
    leveled = f"part int, source string, id bigint, slot int, key bigint, cut boolean, {each}"

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = _table(batches)
        code = t.column("source").combine_chunks().dictionary_encode()
        src, at_, ids = code.indices.to_numpy(), t.column("at").to_numpy(), t.column("id").to_numpy()
        order = np.lexsort((ids, at_, src))
        src, at_, ids, own = src[order], at_[order], ids[order], t.column("own").to_numpy()[order]
        key = (isolation.fraction(isolation.mixed(ids, at_)) * 2.0**53).astype(np.int64)
        cut = (np.bincount(src[~own], minlength=len(code.dictionary)) > 0)[src]  # other partitions may hold the source, too
        k = np.flatnonzero(own)
        out = [pa.array(np.full(len(k), t.column("part")[0].as_py(), np.int32)), code.dictionary.take(pa.array(src[k])), pa.array(ids[k]), pa.array((at_[k] // SLOT_US % SLOTS).astype(np.int32)), pa.array(key[k]), pa.array(cut[k])]
        for i in range(len(names)):
            v = t.column(f"v{i}").to_numpy()[order]
            out += [pa.array(c[k]) for c in (v, *_levels(v, t.column(f"b{i}").to_numpy()[order], src))]
        yield pa.RecordBatch.from_arrays(out, _names(leveled))

    levels = written(seen.repartition(parts, "part").groupBy("part").applyInArrow(measure, leveled), "levels")

    season = levels.groupBy("source", "slot").agg(F.array(*[F.percentile_approx(F.when(~F.isnan(f"v{i}"), F.col(f"off{i}")), 0.5, 1_000) for i in range(len(names))]).alias("m"))
    season = season.groupBy("source").agg(F.map_from_entries(F.collect_list(F.struct("slot", "m"))).alias("season"))
    about = written(_usual(levels, len(names)).join(season, "source"), "about")
    few = levels.filter("cut").join(about.filter(F.col("n") <= FEW_ROWS).select("source", "parts").filter("size(parts) > 1"), "source")
    few = few.withColumn("part", F.explode("parts")).select(F.lit(2).alias("kind"), *levels.columns)
    told = about.select(F.lit(1).alias("kind"), F.explode("parts").alias("part"), "source", "n", F.xxhash64("source").alias("seed"), "usual", "season")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = _table(batches)
        kind = t.column("kind").to_numpy()
        code = t.column("source").combine_chunks().dictionary_encode()
        src = code.indices.to_numpy()
        seed = np.zeros(len(code.dictionary), np.int64)
        n, usual_, season_ = np.zeros(len(code.dictionary)), np.full((len(code.dictionary), len(names)), np.nan), np.zeros((len(code.dictionary), SLOTS, len(names)))
        told_ = np.flatnonzero(kind == 1)
        for s, r in zip(src[told_], t.select(["n", "seed", "usual", "season"]).take(pa.array(told_)).to_pylist()):
            n[s], seed[s], usual_[s] = r["n"], r["seed"], [np.nan if x is None else x for x in r["usual"]]
            for slot, m in r["season"]:
                season_[s, slot] = [0.0 if x is None else x for x in m]
        rows_ = np.flatnonzero(kind != 1)
        t, src, kind = t.take(pa.array(rows_)), src[rows_], kind[rows_]
        slot, ids, key = t.column("slot").to_numpy(), t.column("id").to_numpy(), t.column("key").to_numpy()
        cut = np.bincount(src[kind == 2], minlength=len(n)) > 0
        alone = n[src] <= FEW_ROWS
        grows = alone & np.where(cut[src], kind == 2, True)
        for i, name in enumerate(names):
            v, level, off, step, run = (t.column(f"{c}{i}").to_numpy() for c in ("v", "level", "off", "step", "run"))
            rule, counts = t.column(f"rule{i}").to_numpy(), t.column(f"counts{i}").to_numpy()
            unit = 1.4826 * usual_[src, i]

            def relative(d: np.ndarray, unit: np.ndarray = unit) -> np.ndarray:
                some = unit > 0
                return np.clip(np.where(some, d / np.where(some, unit, 1.0), np.sign(d) * SATURATED), -SATURATED, SATURATED)

            features = np.column_stack([relative(off), relative(step), relative(off - season_[src, slot, i]), np.log1p(run.astype(float))])
            q = np.rint(np.arcsinh(features[:, :3]) * FINE).astype(np.int64) + 64
            cell = q[:, 0] << 19 | q[:, 1] << 12 | q[:, 2] << 5 | run
            s, z, w = np.zeros(len(v)), np.zeros(len(v)), np.flatnonzero(alone)
            fit = (grows & ~np.isnan(v) & (rule != 1))[w]
            if len(w):
                s[w] = isolation.scores(src[w], features[w], fit, key[w], isolation.mixed(seed, i).view(np.int64))
                z[w] = isolation.apart(s[w], src[w], fit)
            k = np.flatnonzero((kind == 0) & ~np.isnan(v))
            said = pa.array(np.array(["", "impossible", "stuck"])[rule[k]], mask=rule[k] == 0)
            shown = pa.array(ids[k], mask=ids[k] == NO_ID)
            yield pa.RecordBatch.from_arrays(
                [t.column("part").combine_chunks().take(pa.array(k)), code.dictionary.take(pa.array(src[k])), shown, pa.array([name] * len(k), pa.string()), pa.array(v[k]), pa.array(level[k]), pa.array(unit[k], from_pandas=True), pa.array(s[k]), pa.array(z[k]), said.cast(pa.string()), pa.array(counts[k]), pa.array(cell[k], mask=alone[k]), pa.array((rule[k] != 1).astype(np.int32))],
                _names(CELLED),
            )

    def forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = _table(batches)
        code, field = t.column("source").combine_chunks().dictionary_encode(), np.array([names.index(x) for x in t.column("field_name").to_pylist()])
        cell, weight = t.column("cell").to_numpy(), t.column("n").to_numpy().astype(float)
        group = code.indices.to_numpy().astype(np.int64) * len(names) + field
        seed = np.zeros(len(code.dictionary) * len(names), np.int64)
        seed[group] = isolation.mixed(t.column("seed").to_numpy(), field).view(np.int64)
        features = np.column_stack([*[np.sinh(((cell >> s & 127) - 64) / FINE) for s in (19, 12, 5)], np.log1p((cell & 31).astype(float))])
        s = isolation.counted(group, features, weight, seed, cell)
        yield from pa.table([t.column(c) for c in _names(FOREST)[:3]] + [t.column("parts").cast(pa.list_(pa.int32())), pa.array(s), pa.array(isolation.counted_apart(s, group, weight))], _names(FOREST)).to_batches()

    both = levels.withColumn("kind", F.lit(0)).unionByName(few).unionByName(told, allowMissingColumns=True)
    one = written(both.repartition(parts, "part").groupBy("part").applyInArrow(score, CELLED), "celled")
    same = one.filter("cell IS NOT NULL").groupBy("source", "field_name", "cell").agg(F.sum("grows").alias("n"), F.collect_set("part").alias("parts")).withColumn("seed", F.xxhash64("source"))
    cells = same.withColumn("bucket", F.pmod("seed", F.lit(parts))).groupBy("bucket").applyInArrow(forest, FOREST)
    at = ["part", "source", "field_name", "cell"]  # a cell of many readings is joined part by part
    cells = cells.select(F.explode("parts").alias("part"), *at[1:], F.col("score").alias("_score"), F.col("apart").alias("_apart"))
    found = one.join(cells, at, "left").withColumn("score", F.coalesce("_score", "score")).withColumn("apart", F.coalesce("_apart", "apart"))
    return found.select(*_names(SCORED))


def _usual(levels: DataFrame, fields: int, most: int | None = None) -> DataFrame:
    """``(source, n, parts, usual)``: a source's rows, where they are, and each field's median distance from the level (the lower of two) over all of them."""
    off = [F.when(F.col(f"counts{i}"), F.abs(F.col(f"v{i}") - F.col(f"level{i}"))) for i in range(fields)]
    most = most or SKETCHED
    sketch = levels.groupBy("source").agg(F.count("*").alias("n"), F.collect_set("part").alias("parts"), F.array(*[F.percentile_approx(d, F.array(F.lit(0.5), F.lit(0.4999), F.lit(0.5001)), 100_000) for d in off]).alias("q"))
    sketch = written(sketch, "sketch")
    usual = sketch.select("source", "n", "parts", F.transform("q", lambda q: F.get(q, F.lit(0))).alias("usual"))
    wide = sketch.filter(F.col("n") > most)
    if wide.isEmpty():
        return usual
    ends = wide.select("source", F.posexplode("q").alias("i", "q")).select("source", "i", F.get("q", F.lit(1)).alias("lo"), F.get("q", F.lit(2)).alias("hi"))
    long = levels.select("source", F.posexplode(F.array(*off)).alias("i", "d")).filter("d IS NOT NULL").join(ends, ["source", "i"])
    # what lies outside the sketch's bracket is counted, what lies inside ordered
    inside = F.when(F.col("d").between(F.col("lo"), F.col("hi")), F.col("d"))
    c = long.withColumn("d", F.when(F.col("d") < F.col("lo"), F.lit(float("-inf"))).otherwise(F.coalesce(inside, F.lit(float("inf"))))).groupBy("source", "i", "d").agg(F.count("*").alias("c"))
    w = Window.partitionBy("source", "i")
    c = c.withColumn("upto", F.sum("c").over(w.orderBy("d"))).withColumn("all", F.sum("c").over(w))
    exact = c.filter(F.col("upto") > F.floor((F.col("all") - 1) / 2)).groupBy("source", "i").agg(F.min("d").alias("d"))
    exact = exact.groupBy("source").agg(F.map_from_entries(F.collect_list(F.struct("i", "d"))).alias("exact"))
    return usual.join(exact, "source", "left").withColumn("usual", F.transform("usual", lambda u, i: F.coalesce(F.try_element_at("exact", i), u))).drop("exact")


def flagged(readings: DataFrame, times: float = 10.0, apart: float = APART) -> DataFrame:
    """Flags of scored readings: ``(source, id, field_name, value, level, scatter, score, flag)``.

    The rules' flags come first. ``spike``: a reading whose isolation score stands ``apart``
    scaled median absolute deviations or more above its source's scores, and that is further
    from its level than ``times`` the source's scatter. Readings that are far off but as the
    source usually is (every day at one time, or as often as not) are no spikes.
    """
    off = F.abs(F.col("value") - F.col("level"))
    spike = F.col("counts") & (F.col("apart") >= apart) & (off > times * F.col("scatter"))
    return readings.withColumn("flag", F.coalesce("rule", F.when(spike, F.lit("spike")))).filter(F.col("flag").isNotNull()).select("source", "id", "field_name", "value", "level", "scatter", "score", "flag")
