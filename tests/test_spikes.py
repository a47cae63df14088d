"""Flags against a plain loop over each source, with whole and cut sources."""

import math
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyloom.functions import isolation
from skyloom.operators import spikes

T0 = datetime(2024, 1, 1)


def flags(spark, rows, **how):
    df = spark.createDataFrame(rows, "src string, id bigint, at timestamp, v double, top double, level string")
    s = spikes.scored(df, "src", "at", "id", {"v": (F.col("v"), (F.col("v") < 0) | (F.col("v") > F.col("top")))}, **how)
    return {(r["id"], r["flag"]) for r in spikes.flagged(s).collect()}


def brute(rows):
    out = set()
    rows = sorted({r[:5] for r in rows}, key=lambda r: (r[0], r[2], r[1]))
    for src in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == src]
        v = [r[3] if r[3] is not None else math.nan for r in own]
        bad = [not math.isnan(x) and (x < 0 or math.isinf(x) or (r[4] is not None and x > r[4])) for x, r in zip(v, own)]
        stuck, i = [False] * len(v), 0
        while i < len(v):
            j = i
            while j + 1 < len(v) and v[j + 1] == v[i]:
                j += 1
            if j - i >= 5:
                stuck[i : j + 1] = [True] * (j - i + 1)
            i = j + 1
        ok = [k for k in range(len(v)) if not math.isnan(v[k]) and not bad[k] and not stuck[k]]
        x = np.array([v[k] for k in ok])
        level = np.array([np.median(x[max(0, p - 7) : p + 8]) for p in range(len(x))])
        off = np.abs(x - level)
        scatter = 1.4826 * np.sort(off)[(len(off) - 1) // 2] if len(off) else 0
        out |= {(own[k][1], "impossible") for k in range(len(v)) if bad[k]} | {(own[k][1], "stuck") for k in range(len(v)) if stuck[k] and not bad[k]}
        out |= {(own[ok[p]][1], "spike") for p in range(len(x)) if off[p] > 10 * scatter}
    return out


def sources(seed=1, sizes=(40, 90, 700)):
    rng, rows = np.random.default_rng(seed), []
    for s, n in enumerate(sizes):
        base = 5 + 3 * s + np.linspace(0, 2, n) + np.where(np.arange(n) > n // 2, 4, 0)  # slow change and a lasting new level
        v = list(base + rng.normal(0, 0.05 * (s + 1), n))
        for k in rng.choice(n - 20, n // 20, replace=False):
            v[k] += rng.choice([-1, 1]) * rng.uniform(15, 40) * 0.05 * (s + 1)
        v[n // 4 : n // 4 + 7] = [v[n // 4]] * 7
        v[3], v[5], v[9], v[11], v[13] = -1.0, float("inf"), float("nan"), None, 1e6
        rows += [(f"s{s}", 10_000 * s + k, T0 + timedelta(minutes=int(11 * k)), None if x is None else float(x), 1e5, "clash") for k, x in enumerate(v)]
    return rows


@pytest.mark.parametrize("slab", [20_000, 100])
def test_flags_are_those_of_a_plain_loop(spark, slab):
    rows = sources()
    assert flags(spark, rows + rows[::9], slab_rows=slab, group_rows=300) == brute(rows)


def test_runs_over_the_ends_of_slabs(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(10, 1, 600)
    for k in range(0, 590, 50):
        v[k : k + 6] = v[k]
    rows = [("one", k, T0 + timedelta(seconds=k), float(x), None, "") for k, x in enumerate(v)]
    assert flags(spark, rows, slab_rows=50) == brute(rows)


def test_odd_sources(spark):
    rows = [("empty", 1, T0, None, None, ""), ("single", 2, T0, 1.0, None, ""), (None, 3, None, 2.0, None, ""), ("same", 4, T0, 1.0, None, ""), ("same", 5, T0, 1.0, None, "")]
    assert flags(spark, rows) == set()
    assert flags(spark, []) == set()


def test_every_reading_is_scored(spark):
    rows = sources()
    df = spark.createDataFrame(rows, "src string, id bigint, at timestamp, v double, top double, level string")
    s = spikes.scored(df, "src", "at", "id", {"v": (F.col("v"), F.col("v") < 0), "w": (F.col("v") * 2, F.lit(None).cast("boolean"))})
    readings = sum(r[3] is not None and not math.isnan(r[3]) for r in rows)
    assert s.filter("score IS NOT NULL AND score BETWEEN 0 AND 1").count() == 2 * readings


def test_forest_isolates_outliers():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(2000, 3))
    x[::100] += 12
    s = isolation.scores(np.repeat(np.arange(4), 500), x, np.ones(2000, bool))
    out = np.zeros(2000, bool)
    out[::100] = True
    assert s[out].min() > np.quantile(s[~out], 0.99)
    assert isolation.scores(np.zeros(5, int), np.ones((5, 2)), np.ones(5, bool)).tolist() == pytest.approx([0.5] * 5, abs=0.3)


def table_of(spark, rows):
    return spark.createDataFrame(rows, "src string, id bigint, at timestamp, v double, top double, level string")


def test_scores_do_not_depend_on_how_sources_are_cut(spark):
    rows = sources(seed=5, sizes=(60, 5_000, 300))
    rows += [("late", 90_000 + k, T0, float(k % 7) + 0.01 * k, None, "") for k in range(3_000)]  # all at one time
    fields = {"v": (F.col("v"), F.col("v") < 0)}
    whole, cut = ({(r["id"]): tuple(r)[3:] for r in spikes.scored(table_of(spark, rows), "src", "at", "id", fields, group_rows=g).collect()} for g in (100_000, 700))
    assert len(whole) > 8_000 and whole == cut


def test_many_spikes_of_very_different_size(spark):
    rng, rows = np.random.default_rng(8), []
    for s, (n, spiked) in enumerate([(70, 5), (70, 8), (2_000, 100)] * 6):
        v = 5 + rng.normal(0, 0.05, n)
        at = rng.choice(np.arange(8, n - 8), spiked, replace=False)
        v[at] += rng.choice([-1, 1], spiked) * 0.05 * np.exp(rng.uniform(np.log(14), np.log(2_000), spiked))
        rows += [(f"s{s}", 10_000 * s + k, T0 + timedelta(minutes=11 * k), float(x), None, "") for k, x in enumerate(v)]
    assert flags(spark, rows) == brute(rows)


def test_the_forest_decides_what_is_usual_for_a_source(spark):
    # every fourth reading of the source is far higher: further than ten scatters, yet as it always is
    rng, n = np.random.default_rng(6), 800
    v = 5 + rng.normal(0, 0.05, n)
    v[1::4] += 0.9
    v[402] += 4.0
    rows = [("daily", k, T0 + timedelta(hours=3 * k), float(x), None, "") for k, x in enumerate(v)]
    s = spikes.scored(table_of(spark, rows), "src", "at", "id", {"v": (F.col("v"), F.lit(False))}).cache()
    without = {r["id"] for r in spikes.flagged(s, apart=-math.inf).collect()}
    got = {r["id"] for r in spikes.flagged(s).collect()}
    assert 402 in got and len(got) <= 5  # those beside the spike may stand apart, too
    assert len(without) > 150 and 402 in without


def test_scores_of_a_large_source_are_set_apart_from_all_of_them(spark):
    rng, n = np.random.default_rng(11), 7_000
    v = 5 + rng.normal(0, 0.05, n)
    v[5::70] += 1.5
    rows = [("large", k, T0 + timedelta(minutes=7 * k), float(x), None, "") for k, x in enumerate(v)]
    got = spikes.scored(table_of(spark, rows), "src", "at", "id", {"v": (F.col("v"), F.lit(False))}, group_rows=900).toPandas()
    lower = lambda x: np.sort(x)[(len(x) - 1) // 2]
    s = got["score"].to_numpy()
    off = s - lower(s)
    assert len(s) == n and got["apart"].to_numpy() == pytest.approx(off / (1.4826 * lower(np.abs(off))))
    assert (got.set_index("id").loc[np.arange(5, n, 70), "apart"] > spikes.APART).all()


def test_counted_rows_score_as_rows():
    rng = np.random.default_rng(12)
    group, weight, seed = np.repeat([0, 1], 150), rng.integers(0, 40, 300).astype(float), np.array([5, 6])
    x, number = rng.normal(size=(300, 3)), np.arange(300)
    x[7], x[160], weight[7], weight[160] = 20.0, -20.0, 1, 0
    s = isolation.counted(group, x, weight, seed, number)
    assert s[:150].argmax() == 7 and s[150:].argmax() == 10  # a lone row, and one that is scored only
    mixed = rng.permutation(300)
    assert (isolation.counted(group[mixed], x[mixed], weight[mixed], seed, number[mixed]) == s[mixed]).all()
    all_rows = np.repeat(np.arange(300), weight.astype(int))
    want = isolation.apart(s[all_rows], group[all_rows], np.ones(len(all_rows), bool))
    assert isolation.counted_apart(s, group, weight)[all_rows] == pytest.approx(want)


def test_scatter_of_sources_beyond_the_sketch(spark, monkeypatch):
    df, fields = table_of(spark, sources(seed=3)), {"v": (F.col("v"), F.col("v") < 0), "w": (F.round("v"), F.lit(False))}
    scatter = lambda: {(r["id"], r["field_name"]): r["scatter"] for r in spikes.scored(df, "src", "at", "id", fields, group_rows=300).collect()}
    sketched = scatter()
    monkeypatch.setattr(spikes, "SKETCHED", 80)
    assert len(sketched) > 1_600 and scatter() == sketched  # so small a source is exact either way
